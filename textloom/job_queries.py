"""Queries of jobs, formats and whole crawls, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import urls
from textloom.functions.keys import key_column, letter_hash_column
from textloom.functions.stem import stemmed_vocabulary
from textloom.lineage import checkpointed, shared_folder
from textloom.operators.context import Context
from textloom.operators.dataset import Dataset, Destroyed, PairDataset
from textloom.plans import crawl, graph, index, search
from textloom.queries import ANCHORS, CLEAN, CUT, EDGES, HOST, LANG, LOWERED, POSITIONS, STOPPED, TERMS_SQL, _docs, _edges, _nodes, _terms, load, query
from textloom.sources import formats, tables


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _rows(spark, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# jobs and storage


@query("SELECT 'Worked, and the arguments are: alpha,beta,gamma' AS output")
def job_output(spark, folder):
    """What a job puts out is what its run gives back."""
    job = lambda context, arguments: context.output("Worked, and the arguments are: " + ",".join(sorted(arguments)))
    return _rows(spark, [(Context.run(spark, _folder(spark, "job"), job, ["gamma", "alpha", "beta"]),)], "output string")


@query("SELECT CAST(count(*) AS VARCHAR) || ' of ' || CAST((SELECT count(*) FROM region) AS VARCHAR) AS output FROM nation")
def job_store(spark, folder):
    """A job reads and writes tables through its context."""

    def job(context, _):
        names = load(spark, folder, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("region"))
        context.store.save("pt-nations", names)
        regions = context.from_table("pt-nations", F.col("region")).distinct()
        context.output(f"{context.store.count('pt-nations')} of {regions.count()}")

    return _rows(spark, [(Context.run(spark, _folder(spark, "job"), job, []),)], "output string")


@query("SELECT '3' AS during, true AS same_rows")
def concurrency_level(spark, folder):
    """A job sets its tasks per shuffle; results don't depend on it."""
    before, counts = spark.conf.get("spark.sql.shuffle.partitions"), []
    during = []

    def job(context, arguments):
        for tasks in arguments:
            context.set_concurrency_level(int(tasks))
            during.append(spark.conf.get("spark.sql.shuffle.partitions"))
            counts.append(sorted(map(tuple, load(spark, folder, "orders").groupBy("o_orderstatus").count().collect())))

    try:
        Context.run(spark, _folder(spark, "job"), job, ["7", "3"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return _rows(spark, [(during[-1], counts[0] == counts[1])], "during string, same_rows boolean")


@query("SELECT name, true AS raises FROM (VALUES ('collect'), ('count'), ('distinct'), ('flat_map'), ('take')) t(name)")
def destroyed(spark, folder):
    """After destroy() every use of a bag raises."""
    data = Dataset.from_table(load(spark, folder, "region"), F.col("r_name"))
    data.destroy()
    uses = {"collect": data.collect, "count": data.count, "distinct": data.distinct, "flat_map": lambda: data.flat_map(F.array), "take": lambda: data.take(1)}
    out = []
    for name, use in uses.items():
        try:
            use()
            out.append((name, False))
        except Destroyed:
            out.append((name, True))
    return _rows(spark, out, "name string, raises boolean")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation GROUP BY 1")
def pair_save(spark, folder):
    """A bag of pairs saved as a table: a row per key, its values in one cell."""
    pairs = PairDataset(load(spark, folder, "nation").select(F.col("n_regionkey").cast("string").alias("key"), F.col("n_name").alias("value")))
    store = tables.TableStore(spark, _folder(spark, "store"))
    pairs.save_as_table(store, "pt-pairs")
    return store.read("pt-pairs").select("key", F.array_join("value", ",").alias("value"))


@query("SELECT DISTINCT p_type AS term FROM part")
def line_file(spark, folder):
    """Distinct lines of a text file."""
    path = _folder(spark, "lines")
    load(spark, folder, "part").select("p_type").write.text(path)
    return formats.line_set(spark, path)


@query("SELECT s_name AS key, CAST(s_nationkey AS VARCHAR) AS nation, CAST(s_suppkey AS VARCHAR) AS number FROM supplier")
def wire_format(spark, folder):
    """Rows written in the wire format and read back."""
    rows = load(spark, folder, "supplier").select("s_name", F.col("s_nationkey").cast("string").alias("nation"), F.col("s_suppkey").cast("string").alias("number"))
    keyed = rows.withColumn("s_name", key_column(F.col("s_name")))
    back = formats.wide_rows(formats.wire_rows(keyed, "s_name", "nation", "number"))
    cell = lambda name: F.col("cells")[name].cast("string").alias(name)
    return back.select(key_column(F.col("key"), decode=True).alias("key"), cell("nation"), cell("number"))


CODE = "CASE WHEN regexp_matches(c, '[A-Za-z0-9-]') THEN c ELSE '_' || format('{:x}', unicode(c)) END"


@query(f"SELECT url, list_reduce(list_transform(string_split(url, ''), lambda c: {CODE}), lambda a, b: a || b) AS name, url AS back FROM pages")
def key_codec(spark, folder):
    """Keys as names that file systems take, and back."""
    name = key_column(F.col("url"))
    return load(spark, folder, "pages").select("url", name.alias("name")).withColumn("back", key_column(F.col("name"), decode=True))


DIGIT = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
BYTES = f"list_transform(range(0, 20), lambda k: {DIGIT.format('CAST(2 * k + 1 AS INTEGER)')} * 16 + {DIGIT.format('CAST(2 * k + 2 AS INTEGER)')})"
LETTERS = "list_transform(b, lambda x: chr(CAST(97 + x % 26 AS INTEGER)) || CASE WHEN x < 26 THEN 'a' ELSE chr(CAST(97 + 2 * (x // 26) AS INTEGER)) END)"


@query(
    f"SELECT n_name, list_reduce({LETTERS}, lambda x, y: x || y) AS hash FROM (SELECT n_name, list_transform({BYTES}, lambda x:"
    " CASE WHEN x > 0 AND x < 128 THEN x WHEN x = 0 THEN 255 ELSE x - 1 END) AS b FROM (SELECT n_name, sha1(n_name) AS h FROM nation))"
)
def letter_hash(spark, folder):
    return load(spark, folder, "nation").select("n_name", letter_hash_column(F.col("n_name")).alias("hash"))


@query("SELECT true AS within_bounds, true AS a_subset")
def sample_bounds(spark, folder):
    """A sample of seven tenths has a size within five deviations, and no element that wasn't there."""
    data = Dataset.from_table(load(spark, folder, "events"), F.col("event_id").cast("string"))
    n, taken = data.count(), data.sample(0.7, 42)
    size = taken.count()
    kept = taken.df.join(data.df.distinct(), "value", "left_semi").count()
    return _rows(spark, [(abs(size - 0.7 * n) <= 5 * (0.21 * n) ** 0.5, kept == size)], "within_bounds boolean, a_subset boolean")


@query("SELECT l_returnflag AS key, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1")
def aggregate_by_key(spark, folder):
    pairs = PairDataset(load(spark, folder, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("value")))
    return pairs.aggregate_by_key(lambda v: F.round(F.sum(v), 2)).df


@query("SELECT CAST(o_orderkey AS VARCHAR) AS first, o_orderstatus || ',' || o_orderpriority AS rest FROM orders")
def split_limit(spark, folder):
    """A split with a limit leaves the rest whole."""
    joined = F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_orderpriority")
    parts = F.split(joined, ",", 2)
    return load(spark, folder, "orders").select(parts[0].alias("first"), parts[1].alias("rest"))


@query("SELECT url, url AS decoded FROM pages")
def url_decode(spark, folder):
    return load(spark, folder, "pages").select("url", F.url_decode(F.url_encode("url")).alias("decoded"))


# words and stems

CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
OVER_0, OVER_1 = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}", f"^({CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
EXACTLY_1, HAS_VOWEL = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}({VOWELS})?$", f"^({CONSONANTS})?[aeiouy]"
SHORT = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"


def _stem_sql(words: str) -> str:
    """Porter's steps over a query with one column, term: each a CASE over the last one's word."""
    is_ = lambda pattern, of: f"regexp_matches({of}, '{pattern}')"
    rest = lambda n: f"left(w, length(w) - {n})"

    def endings(table: dict[str, str], condition: str) -> str:
        longest = sorted(table, key=len, reverse=True)
        return "CASE " + " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN {is_(condition, rest(len(e)))} THEN {rest(len(e))} || '{table[e]}' ELSE w END" for e in longest) + " ELSE w END"

    from textloom.functions.stem import STEP_2, STEP_3, STEP_4

    cut = f"CASE WHEN ends_with(w, 'ed') AND {is_(HAS_VOWEL, rest(2))} THEN {rest(2)} WHEN ends_with(w, 'ing') AND {is_(HAS_VOWEL, rest(3))} THEN {rest(3)} END"
    fourth = " ".join(
        f"WHEN ends_with(w, '{e}') THEN CASE WHEN {is_(OVER_1, rest(len(e)))}" + (" AND regexp_matches(left(w, length(w) - 3), '[st]$')" if e == "ion" else "") + f" THEN {rest(len(e))} ELSE w END"
        for e in sorted(STEP_4, key=len, reverse=True)
    )
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {rest(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {rest(1)} ELSE w END",
        # past and continuous forms, then what the cut word needs
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {is_(OVER_0, rest(3))} THEN {rest(1)} ELSE w END WHEN ({cut}) IS NULL THEN w"
        f" WHEN regexp_matches({cut}, '(at|bl|iz)$') THEN ({cut}) || 'e'"
        f" WHEN length({cut}) > 1 AND right({cut}, 1) = right(left({cut}, length({cut}) - 1), 1) AND regexp_matches({cut}, '[^aeiouylsz]$') THEN left({cut}, length({cut}) - 1)"
        f" WHEN regexp_matches({cut}, '{SHORT}') THEN ({cut}) || 'e' ELSE ({cut}) END",
        f"CASE WHEN ends_with(w, 'y') AND {is_(HAS_VOWEL, rest(1))} THEN {rest(1)} || 'i' ELSE w END",
        endings(STEP_2, OVER_0),
        endings(STEP_3, OVER_0),
        f"CASE {fourth} ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({is_(OVER_1, rest(1))} OR {is_(EXACTLY_1, rest(1))} AND NOT {is_(SHORT, rest(1))}) THEN {rest(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {is_(OVER_1, 'w')} THEN {rest(1)} ELSE w END",
    ]
    # a y in front is a consonant: a capital keeps it one
    sql = f"SELECT term, CASE WHEN starts_with(term, 'y') THEN 'Y' || substr(term, 2) ELSE term END AS w FROM ({words}) WHERE length(term) > 2"
    for step in steps:
        sql = f"SELECT term, {step} AS w FROM ({sql})"
    return f"SELECT term, CASE WHEN starts_with(term, 'y') THEN 'y' || substr(w, 2) ELSE w END AS stem FROM ({sql}) UNION ALL SELECT term, term FROM ({words}) WHERE length(term) <= 2"


@query(_stem_sql(TERMS_SQL))
def porter_stem(spark, folder):
    return stemmed_vocabulary(_terms(spark, folder))


LOWER_POSITIONS = POSITIONS.replace("string_split(text, ' ')", "string_split(lower(regexp_replace(text, '[^a-zA-Z ]+', '', 'g')), ' ')")
STEMMED = (
    f"p AS MATERIALIZED ({LOWER_POSITIONS}), v AS MATERIALIZED ({_stem_sql('SELECT DISTINCT term FROM p')}),"
    " s AS (SELECT doc, term, position FROM p UNION ALL SELECT p.doc, v.stem, p.position FROM p JOIN v ON p.term = v.term WHERE v.stem <> v.term)"
)


def _plain_docs(spark, folder) -> DataFrame:
    """The documents in small ASCII letters."""
    return _docs(spark, folder).withColumn("text", F.lower(F.regexp_replace("text", "[^a-zA-Z ]+", "")))


@query(f"WITH {STEMMED} SELECT doc, term, count(*) AS tf, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM s GROUP BY 1, 2")
def index_with_stems(spark, folder):
    """Postings under each word and, where it differs, its stem."""
    post = index.build(_plain_docs(spark, folder))
    return post.select("doc", "term", "tf", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


QUERY = "Relational hopping the SKY"
EXPANDED = "('relat'), ('relational'), ('hop'), ('hopping'), ('the'), ('sky')"


@query(f"SELECT * FROM (VALUES {EXPANDED}) t(term)")
def query_expansion(spark, folder):
    """A query's words and their stems, in small letters, once each."""
    return _rows(spark, [(t,) for t in search.query_terms("relational hopping the SKY")], "term string")


@query(
    f"WITH {STEMMED}, t AS (SELECT doc, term, count(*) AS tf FROM s GROUP BY 1, 2), n AS (SELECT doc, sqrt(sum(tf * tf)) AS l2 FROM t GROUP BY 1),"
    " f AS (SELECT term, count(*) AS df FROM t GROUP BY 1) SELECT t.doc, round(0.15 * sum(tf / l2 * ln((SELECT count(*) FROM documents) / df)), 6) AS score"
    " FROM t JOIN n ON t.doc = n.doc JOIN f ON t.term = f.term WHERE t.term IN ('thing', 'things', 'ones', 'on', 'er') GROUP BY 1"
)
def search_with_stems(spark, folder):
    """Ranked search over a stored index with stems: the query's words are expanded, the index is read by term."""
    n_docs, n_bytes = _docs(spark, folder).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    store = tables.TableStore(spark, _folder(spark, "index"))
    stored = store.save("pt-index", index.blocks(_plain_docs(spark, folder), n_bytes), index.SMALL_PAGES)
    none = _rows(spark, [], "doc long, rank double")
    terms = search.query_terms("things ones er")
    assert terms == ["thing", "things", "on", "ones", "er"], terms
    return search.search(index.opened(stored, "doc", "tf", "l2"), none, terms, n_docs).select("doc", F.round("score", 6).alias("score"))


@query("SELECT w AS term, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> '' GROUP BY 1")
def query_term_counts(spark, folder):
    """How often each word is asked for; part names stand in for a log of queries."""
    return search.term_counts(load(spark, folder, "part").select(F.col("p_name").alias("query")))


# urls and crawls

LINKS = [
    ("/x#f", "https://a.com:443/b/c.html", "https://a.com:443/x", "https://a.com:443/x"),
    ("blah.html", "https://a.com/b/c.html", "https://a.com:443/b/blah.html", "https://a.com:443/b/blah.html"),
    ("blah.html#x", "http://a.com:8000/b/c.html", "http://a.com:8000/b/blah.html", "http://a.com:80/b/blah.html"),
    ("../x", "http://a.com:80/b/c/d/e.html", "http://a.com:80/b/c/d/x", "http://a.com:80/b/c/d/x"),
    ("../../x", "http://a.com:80/b/c/d/e.html", "http://a.com:80/b/c/d/x", "http://a.com:80/b/c/x"),
    ("#top", "http://a.com:80/b/c.html", "http://a.com:80/b/", "http://a.com:80/b/c.html"),
    ("http://o.com/y z", "https://a.com:443/b", "http://o.com:443/y%20z", "http://o.com:80/y z"),
    ("https://o.com:99/y", "http://a.com:80/b", "https://o.com:99/y", "https://o.com:99/y"),
    ("http://o.com", "http://a.com:80/b", "http://o.com:80/", "http://o.com:80/"),
    ("pic.JPG", "http://a.com:80/b/c", None, "http://a.com:80/b/pic.JPG"),
    ("ftp://a.com/x", "http://a.com:80/", None, "ftp://a.com:80/x"),
    ("/1/2/3/4/5/6", "http://a.com:80/", None, "http://a.com:80/1/2/3/4/5/6"),
    ("/1/../2/./3", "http://a.com:80/", "http://a.com:80/1/2/3", "http://a.com:80/1/../2/./3"),
]
_quoted = lambda x: "NULL" if x is None else f"'{x}'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_quoted, row))})" for row in LINKS) + ") t(href, base, crawled, linked)")
def url_normalize_forms(spark, folder):
    """Rooted, relative, climbing, absolute and fragment links under both normalizers."""
    rows = _rows(spark, [row[:2] for row in LINKS], "href string, base string")
    return rows.select("href", "base", urls.crawl_url(F.col("href"), F.col("base")).alias("crawled"), urls.graph_url(F.col("href"), F.col("base")).alias("linked"))


HOSTS = [("en.wikipedia.org", 25000), ("scholar.google.com", 25000), ("www.google.com", 200), ("a.example.com", 200), ("techcrunch.com", 25000)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{h}', {n})" for h, n in HOSTS) + ") t(host, cap)")
def host_cap_classes(spark, folder):
    return _rows(spark, [(h,) for h, _ in HOSTS], "host string").select("host", urls.host_cap(F.col("host")).alias("cap"))


@query("SELECT url FROM pages ORDER BY url LIMIT CASE WHEN (SELECT count(DISTINCT url) FROM pages) > 40 THEN 4 ELSE 40 END")
def frontier_prune(spark, folder):
    """A frontier of over 40 urls keeps its first four."""
    return crawl.prune(crawl.start(load(spark, folder, "pages")), 40, 4)


@query("SELECT d.doc_id AS url, CASE WHEN p.url IS NULL THEN '404' ELSE '200' END AS status, coalesce(length(left(p.html, 3000)), 0) AS length"
       " FROM documents d LEFT JOIN pages p ON p.url = 'x' UNION ALL SELECT p.page_id, '200', length(left(p.html, 3000)) FROM pages p")  # fmt: skip
def fetch_pages(spark, folder):
    """Stored pages as the web: what is there has status 200 and is read up to a cap, what isn't has 404."""
    pages = load(spark, folder, "pages")
    there = pages.select("page_id", F.col("url"))
    missing = load(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("gone:"), "doc_id").alias("url"))
    asked = there.unionByName(missing)
    return crawl.fetch(asked, pages, 3000, by=("url", "page_id")).select(F.col("page_id").alias("url"), "status", "length")


DICTIONARY = "SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents)"
CLEANED = (
    f"SELECT url, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT url, unnest(l) AS w, unnest(range(len(l))) AS i FROM (SELECT url,"
    f" {CUT.format('c')} AS l FROM (SELECT url, {LOWERED.format('c0')} AS c FROM (SELECT url, {CLEAN} AS c0 FROM pages WHERE {LANG} IN ('', 'en')"
    f" OR {LANG} LIKE 'en-%')))) WHERE w <> '' AND w NOT IN ({STOPPED}) AND w IN ({DICTIONARY}) GROUP BY 1"
)


@query(CLEANED)
def cleaned_by_dictionary(spark, folder):
    words = load(spark, folder, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("term")).distinct()
    return crawl.cleaned(load(spark, folder, "pages").select("url", "html"), words).select("url", F.array_join("words", " ").alias("words"))


_LINK = ANCHORS.format(1, "href").replace("SELECT page_id,", "SELECT url,") + f" WHERE {LANG} IN ('', 'en') OR {LANG} LIKE 'en-%'"
_PROTOCOL = "regexp_extract(url, '^([a-z]+)://', 1)"
FOLLOWED = (
    f"SELECT DISTINCT url, {_PROTOCOL} || '://' || {HOST} || ':' || CASE WHEN {_PROTOCOL} = 'https' THEN '443' ELSE '80' END"
    f" || replace(regexp_replace(href, '#.*$', ''), ' ', '%20') AS dst FROM ({_LINK})"
    " WHERE href LIKE '/%' AND NOT regexp_matches(lower(href), '\\.(jpg|jpeg|gif|png|txt)$')"
)
CAPPED = (
    "SELECT url, string_agg(' <a href=\"' || dst || '\"></a>', '' ORDER BY dst) AS links FROM (SELECT url, dst, row_number() OVER (PARTITION BY url ORDER BY sha1(dst), dst) AS n"
    f" FROM ({FOLLOWED}) WHERE NOT regexp_matches(dst, '{'|'.join(urls.UNWANTED)}')) WHERE n <= 30 GROUP BY 1"
)


@query(
    f"SELECT url, coalesce(words, '') || coalesce(links, '') AS page, CAST(length(coalesce(words, '') || coalesce(links, '')) AS INTEGER) AS length"
    f" FROM ({CLEANED.replace(f' AND w IN ({DICTIONARY})', '')}) FULL JOIN ({CAPPED}) USING (url)"
)
def cleaned_with_links(spark, folder):
    """Pages as a crawl stores them: words without stop words, then the links as empty anchors."""
    return crawl.cleaned_with_links(load(spark, folder, "pages").select("url", "html"))


SITE = "http://{}.test:80/n"


def _site(spark, folder) -> DataFrame:
    """A page per node of the part and supplier graph, with a link to each of its neighbours."""
    links = _edges(spark, folder).distinct().select("src", F.format_string('<a href="http://%s.test/n">x</a>', "dst").alias("a"))
    html = links.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list("a")), "").alias("html"))
    nodes = _nodes(_edges(spark, folder))
    return nodes.join(html, F.col("node") == F.col("src"), "left").select(F.format_string("http://%s.test:80/n", "node").alias("url"), F.coalesce("html", F.lit("")).alias("html"))


SITE_SQL = (
    "h AS (SELECT DISTINCT src, dst, 'http://' || dst || '.test:80/n' AS u FROM e),"
    " l AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sha1(u), u) AS n FROM h) WHERE n <= 30),"
    # s10 moved to p2; hosts that begin with p3 want no visits
    " m AS (SELECT src, CASE WHEN dst = 's10' THEN 'p2' ELSE dst END AS dst FROM l),"
    " x AS (SELECT src, dst FROM m WHERE dst NOT LIKE 'p3%' AND dst <> 's10')"
)


@query(
    f"WITH RECURSIVE {EDGES}, {SITE_SQL}, f(url, depth) USING KEY (url) AS (SELECT 'p1', 0 UNION SELECT x.dst, min(f.depth + 1) FROM f JOIN x ON f.url = x.src"
    " WHERE x.dst NOT IN (SELECT url FROM recurring.f) GROUP BY 1),"
    " c AS (SELECT f.url, f.depth, coalesce((SELECT string_agg(dst, ',' ORDER BY 'http://' || dst || '.test/n') FROM (SELECT DISTINCT src, dst FROM e) q WHERE q.src = f.url), '') AS links FROM f)"
    " SELECT 'http://' || url || '.test:80/n' AS url, depth, first_value('http://' || url || '.test:80/n') OVER (PARTITION BY links ORDER BY depth, 'http://' || url || '.test:80/n') AS canonical FROM c"
)
def crawl_site(spark, folder):
    """A whole crawl until nothing is left: links capped by page, robots, a redirect, content seen before."""
    store = tables.TableStore(spark, _folder(spark, "site"))
    pages = store.save("pt-pages", _site(spark, folder))  # stored pages, as a crawl has them: urls are read without them
    hosts = _nodes(_edges(spark, folder)).where("node like 'p3%'").select(F.concat("node", F.lit(".test")).alias("host"), F.lit("User-agent: *\nDisallow: /n").alias("robots"))
    hosts = checkpointed(hosts)
    moved = _rows(spark, [(SITE.format("s10"), SITE.format("p2"))], "url string, target string")
    return crawl.crawl(_rows(spark, [("http://p1.test/n",)], "url string"), pages, hosts, moved)


# graphs

MOST_ROUNDS = 40


@query(
    f"WITH {EDGES.replace('AS (', 'AS MATERIALIZED (')}, "
    + ", ".join(
        f"r{k} AS MATERIALIZED (SELECT n.node, coalesce(g.got, 0) + 0.15 AS rank FROM r{k - 1} n LEFT JOIN (SELECT w.dst AS node, sum(r.rank * w.part) AS got FROM w JOIN r{k - 1} r ON w.src = r.node GROUP BY 1) g ON n.node = g.node)"
        for k in range(1, MOST_ROUNDS + 1)
    )
    + ", d AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, max(abs(a.rank - b.rank)) AS most FROM r{k} a JOIN r{k - 1} b ON a.node = b.node" for k in range(1, MOST_ROUNDS + 1))
    + "), z AS (SELECT min(k) AS k FROM d WHERE most <= 0.01), every AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, node, rank FROM r{k}" for k in range(1, MOST_ROUNDS + 1))
    + ") SELECT node, round(rank, 4) AS rank FROM every JOIN z USING (k)"
)
def pagerank_converged(spark, folder):
    edges = _edges(spark, folder)
    return graph.pagerank(_nodes(edges), edges, 0.01, most=MOST_ROUNDS)[0].select("node", F.round("rank", 4).alias("rank"))
