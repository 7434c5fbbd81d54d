"""Index, search, PageRank and crawl goldens."""

import pytest
from pyspark.sql import functions as F

from textloom.plans import crawl, graph, index, search

CORPUS = [("1", "apples bananas coconuts"), ("2", "dates elderberries figs"), ("3", "guavas hazelnuts guavas")]


@pytest.fixture(scope="module")
def post(spark):
    return index.build(spark.createDataFrame(CORPUS, "doc string, text string")).cache()


def test_index_has_words_and_stems(post):
    found = {(r["term"], r["doc"]): (r["tf"], r["positions"]) for r in post.collect()}
    assert found["apples", "1"] == (1, [1]) and found["appl", "1"] == (1, [1])
    assert found["guavas", "3"] == (2, [1, 3]) and found["guava", "3"] == (2, [1, 3])
    assert len(found) == 16


def test_norms(post):
    assert post.where("doc = '3'").select("l2").distinct().first()[0] == pytest.approx((4 + 4 + 1 + 1) ** 0.5)


def test_merge_prefers_new(spark):
    old = spark.createDataFrame([("t", "1", 1), ("u", "1", 1)], "term string, doc string, tf int")
    new = spark.createDataFrame([("t", "1", 5)], "term string, doc string, tf int")
    assert sorted(tuple(r) for r in index.merge(old, new).collect()) == [("t", "1", 5), ("u", "1", 1)]


def test_search(spark, post):
    ranks = spark.createDataFrame([("1", 2.0)], "doc string, rank double")
    terms = search.query_terms("apples guavas guavas")
    assert terms == ["appl", "apples", "guava", "guavas"]
    found = search.search(post, ranks, terms, 3).collect()
    assert [r["doc"] for r in found] == ["1", "3"]


def test_pagerank_golden(spark):
    edges = spark.createDataFrame([("1", "2"), ("2", "1"), ("2", "3"), ("3", "1"), ("3", "unknown")][:4], "src string, dst string")
    nodes = spark.createDataFrame([("1",), ("2",), ("3",)], "node string")
    ranks, rounds = graph.pagerank(nodes, edges, 0.001)
    found = {r["node"]: r["rank"] for r in ranks.collect()}
    assert found == pytest.approx({"1": 1.191681575822917, "2": 1.1637322274926893, "3": 0.644586196684393}, abs=1e-9)
    assert rounds == 13


def test_pagerank_drops_unknown_and_dangling(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("a", "gone"), ("a", "b")], "src string, dst string")
    found = {r["node"]: r["rank"] for r in graph.pagerank_fixed(nodes, edges, 1).collect()}
    assert found == pytest.approx({"a": 0.15, "b": 0.575})


def test_frontier(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    found = crawl.frontier(spark.createDataFrame([("a",)], "url string"), links)
    assert sorted(tuple(r) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_page_links_and_prune(spark):
    pages = spark.createDataFrame([("http://a.com/x", '<a href="/y">1</a><a href="/login">2</a><a href="/p.png">3</a><a href="/no/1">4</a>')], "url string, html string")
    found = crawl.page_links(pages, [(False, "^/no.*$")]).collect()
    assert [r["dst"] for r in found] == ["http://a.com:80/y"]
    front = spark.createDataFrame([(f"u{k:02d}",) for k in range(20)], "url string")
    assert crawl.prune(front, 10, 5).count() == 5 and crawl.prune(front).count() == 20


def test_cleaned_uses_a_dictionary(spark):
    pages = spark.createDataFrame([("u", "<html>The apple and pear</html>"), ("v", '<html lang="fr">pomme</html>')], "url string, html string")
    assert [tuple(r) for r in crawl.cleaned(pages).collect()] == [("u", ["apple", "pear"])]
    words = spark.createDataFrame([("pear",)], "term string")
    assert crawl.cleaned(pages, words).first()["words"] == ["pear"]


def test_spelling(spark):
    terms = spark.createDataFrame([("apple",), ("ample",), ("pear",)], "term string")
    found = {r["word"]: (r["suggestion"], r["distance"]) for r in search.correct(terms, ["aple", "pea", "zzzz", "bpple"]).collect()}
    assert found == {"aple": ("ample", 1), "bpple": ("apple", 1)}
    assert [r["term"] for r in search.autocomplete(terms.select(F.col("term")), "AP").collect()] == ["apple"]


def test_crawl(spark):
    a = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    base = "http://s.com:80"
    pages = spark.createDataFrame(
        [
            (f"{base}/", a("/one", "/two", "/no/x", "/gone", "/moved")), (f"{base}/one", a("/", "/three")), (f"{base}/two", "same"),
            (f"{base}/three", "same"), (f"{base}/no/x", "hidden"), (f"{base}/new", "target"),
        ],
        "url string, html string",
    )
    seeds = spark.createDataFrame([("http://s.com",)], "url string")
    robots = spark.createDataFrame([("s.com", "User-agent: *\nDisallow: /no")], "host string, robots string")
    redirects = spark.createDataFrame([(f"{base}/moved", f"{base}/new")], "url string, target string")
    found = {r["url"][len(base) :]: (r["depth"], r["canonical"][len(base) :]) for r in crawl.crawl(seeds, pages, robots, redirects).collect()}
    assert found == {"/": (0, "/"), "/one": (1, "/one"), "/two": (1, "/two"), "/new": (1, "/new"), "/three": (2, "/two")}
    assert crawl.crawl(seeds, pages, cap=2).count() == 2
    late = crawl.crawl(seeds, pages, robots, redirects, defer=0.3)
    assert {r["url"][len(base) :] for r in late.collect()} == set(found)
    assert crawl.crawl(seeds, pages, rounds=1).count() == 1


def test_crawl_waits_for_slow_hosts_and_prunes(spark):
    a = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    names = [f"/{k}" for k in range(8)]
    pages = spark.createDataFrame([("http://s.com:80/", a(*names)), *[(f"http://s.com:80{n}", n) for n in names]], "url string, html string")
    seeds = spark.createDataFrame([("http://s.com",)], "url string")
    robots = spark.createDataFrame([("s.com", "User-agent: *\nCrawl-delay: 2")], "host string, robots string")
    found = {r["url"]: r["depth"] for r in crawl.crawl(seeds, pages, robots, round_ms=4000).collect()}
    assert len(found) == 9 and sorted(found.values()) == [0, 1, 1, 2, 2, 3, 3, 4, 4]  # two pages a round
    assert crawl.crawl(seeds, pages, most_waiting=10).count() == 9 and crawl.crawl(seeds, pages, most_waiting=7).count() == 1
    assert sorted(r["url"] for r in crawl.start(seeds, pages.select("url")).collect())[0] == "http://s.com"


def test_redirect_chains(spark):
    hops = spark.createDataFrame([(str(k), str(k + 1)) for k in range(1, 6)], "url string, target string")
    urls = spark.createDataFrame([("1",), ("3",), ("9",)], "url string")
    assert sorted(r["url"] for r in crawl.resolve_redirects(urls, hops).collect()) == ["6", "9"]


def test_an_index_without_stems_deals_texts_once(spark):
    docs = spark.createDataFrame(CORPUS, "doc string, text string")
    plan = index.build(docs, stems=False)._jdf.queryExecution().optimizedPlan().toString()
    built = index.build(docs, stems=False)
    physical = built._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1 and plan.count("Generate") == 1


def test_counting_needs_no_rows_of_words(spark):
    """Words are counted where their documents lie: with stems, too, only texts are dealt, and nothing is sorted by word."""
    docs = spark.createDataFrame(CORPUS, "doc string, text string")
    for built in (index.build(docs), index.build(docs, stems=False, only=["figs"])):
        physical = built._jdf.queryExecution().executedPlan().toString()
        assert physical.count("Exchange") == 1 and physical.count("Sort ") == 1 and "Window" not in physical and "Aggregate" not in physical


def test_build_against_plain_python(spark, monkeypatch):
    rows = [(k % 7, text) for k, text in enumerate(["ones on ones", "", " \x01 one  on", None, "ü ü\n x", "running runs run", "x " * 300, "ones", "on one", "\t", "x x"])]
    docs = spark.createDataFrame(rows, "doc long, text string")
    for stems in (False, True):
        places = {}
        for doc, text in rows:
            for at, word in enumerate((text or "").split(" "), 1):
                if word.strip("".join(map(chr, range(33)))):
                    for term in {word, search.stem(word)} if stems else {word}:
                        places.setdefault((doc, term), []).append(at)
        squares = {}
        for (doc, _), found in places.items():
            squares[doc] = squares.get(doc, 0) + len(found) ** 2
        expected = {key: (len(found), sorted(found), pytest.approx(squares[key[0]] ** 0.5)) for key, found in places.items()}
        built = index.build(docs, stems=stems).collect()
        assert len(built) == len(expected) and {(r["doc"], r["term"]): (r["tf"], r["positions"], r["l2"]) for r in built} == expected
        some = index.build(docs, stems=stems, only=["on", "x"]).collect()
        assert {(r["doc"], r["term"]): (r["tf"], r["positions"], r["l2"]) for r in some} == {k: v for k, v in expected.items() if k[1] in ("on", "x")}
        lists = {r["term"]: (r["docs"], r["n"]) for r in index.document_lists(docs, stems=stems).collect()}
        assert lists == {t: (sorted(d for d, u in places if u == t), sum(len(f) for (_, u), f in places.items() if u == t)) for _, t in places}
    cut = index.build(docs.limit(1), words=F.array(F.lit("b"), F.lit(None).cast("string"), F.lit("b")), stems=False).collect()
    assert [(r["term"], r["tf"], r["positions"]) for r in cut] == [("b", 2, [1, 3])]


def test_a_stored_index_opens_to_the_same_rows(spark, tmp_path):
    """Blocks, whatever the number of tasks, have every posting once, in order of term within a task, and are read by term."""
    rows = [(k % 7, text) for k, text in enumerate(["ones on ones", "", " \x01 one  on", None, "running runs run", "x " * 300, "ones", "on one", "x x"])]
    for docs in (spark.createDataFrame(rows, "doc long, text string"), spark.createDataFrame(CORPUS, "doc string, text string")):
        whole = sorted(map(tuple, index.build(docs).collect()))
        for n_bytes, tasks in ((0, 1), (2 * index.TASK_BYTES, 3)):
            stored = index.blocks(docs, n_bytes)
            assert stored.rdd.getNumPartitions() == tasks
            assert all(part == sorted(part) for part in stored.select("term").rdd.map(lambda r: r["term"]).glom().collect())
            assert sorted(map(tuple, index.opened(stored, "doc", "tf", "positions", "l2").collect())) == whole
    assert index.blocks(docs.where("doc = 'none'"), 0).count() == 0
    stored.write.options(**index.SMALL_PAGES).parquet(f"{tmp_path}/index")
    found = index.opened(spark.read.parquet(f"{tmp_path}/index"), "doc", "tf").where(F.col("term").isin("guava", "figs"))
    assert sorted(map(tuple, found.collect())) == [("figs", "2", 1), ("guava", "3", 2)]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [figs,guava])" in scan and "ReadSchema: struct<term:string,doc:array<string>,tf:array<bigint>>" in scan


def test_search_with_stems_deals_no_postings(spark, folder, monkeypatch):
    """Of the index that it stores only texts are dealt, and every posting is in it."""
    from textloom import job_queries
    from textloom.sources.tables import TableStore

    kept = []
    monkeypatch.setattr(TableStore, "save", lambda self, name, rows, *options, real=TableStore.save: kept.append((rows, real(self, name, rows, *options))) or kept[-1][1])
    assert job_queries.search_with_stems(spark, folder).count()
    ((rows, stored),) = kept
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert index.opened(stored, "doc").count() == job_queries.index_with_stems(spark, folder).count()


def test_documents_stay_whole_between_batches():
    import pyarrow as pa

    from textloom.functions.counts import whole_documents

    kinds = pa.schema([("doc", pa.int64()), ("words", pa.string())])
    batches = [pa.RecordBatch.from_pydict({"doc": d, "words": ["abcdef"] * len(d)}, kinds) for d in ([1, 1, 2, 3], [3, 3, 3], [3, 4, 5], [])]
    for limit in (1, 6, 13, 1000):
        cut = [rows.column("doc").to_pylist() for rows in whole_documents(iter(batches), limit)]
        assert sum(cut, []) == [1, 1, 2, 3, 3, 3, 3, 3, 4, 5]
        assert all(not set(a) & set(b) for a, b in zip(cut, cut[1:]))


def test_a_small_front_goes_to_the_pages(spark, monkeypatch):
    """Stored pages aren't dealt for a small front; a large front gives the same crawl."""
    pages = spark.createDataFrame([("http://s.com:80/", '<a href="/a">x</a><a href="/gone">x</a>'), ("http://s.com:80/a", "y")], "url string, html string")
    seeds, found = spark.createDataFrame([("http://s.com",)], "url string"), []
    sent = []
    monkeypatch.setattr(crawl.F, "broadcast", lambda df, real=F.broadcast: sent.append(df) or real(df))
    for most in (crawl.SMALL_FRONT, 0):
        monkeypatch.setattr(crawl, "SMALL_FRONT", most)
        found.append(sorted(map(tuple, crawl.crawl(seeds, pages).collect())))
        assert len(sent) == 4  # two joins with pages in each of two rounds, none for a large front
    assert found[0] == found[1] and [r[1] for r in found[0]] == [0, 1]
