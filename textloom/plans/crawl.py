"""Offline crawl: a breadth-first frontier over stored pages and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import anchors, clean_html, is_english, is_stop_word, page_words
from textloom.functions.urls import HOST_CAP, crawl_delay_ms, crawl_url, host_cap, is_unwanted, parse_url, robots_allowed, robots_allowed_by_text
from textloom.lineage import checkpointed

LINKS_PER_PAGE = 30
MOST_CHARS = 2_000_000
#: A front of up to so many urls (some 100 bytes each) goes to where the stored pages lie, and no page is dealt for it.
SMALL_FRONT = 200_000


def start(seeds: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """url: the seeds and what a former crawl left to do, once each."""
    return (seeds if saved is None else seeds.select("url").union(saved.select("url"))).select("url").distinct()


def fetch(urls: DataFrame, pages: DataFrame, most: int = MOST_CHARS, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """url, status, html, length of each url from stored pages (url, html): at most `most` characters are read.

    Where several pages are stored under one url, `by` names the columns of both tables that tell them apart.
    """
    found = urls.select(*by).join(pages.select(*by, F.substring("html", 1, most).alias("html"), F.lit("200").alias("status")), list(by), "left")
    return found.select(*by, F.coalesce("status", F.lit("404")).alias("status"), "html", F.coalesce(F.length("html"), F.lit(0)).alias("length"))


def frontier(seeds: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """url, depth: everything that links (src, dst) reach from seeds (url), with its distance.

    Each round joins only the new front to the links and drops what was seen; lineage is cut every round.
    """
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    front, depth = seen, 0
    links = checkpointed(links.select("src", "dst").distinct().repartition("src"))
    while rounds is None or depth < rounds:
        depth += 1
        found = front.join(links, front.url == links.src).select(F.col("dst").alias("url")).distinct()
        front = checkpointed(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def cap_hosts(urls: DataFrame, order: Column, cap: int | Column = HOST_CAP) -> DataFrame:
    """At most `cap` rows of each host, the first in the given order."""
    host = parse_url(F.col("url"))["host"]
    ranked = urls.withColumn("host", host).withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy(order)))
    return ranked.where(F.col("nth") <= cap)


def first_with_content(pages: DataFrame, order: str) -> DataFrame:
    """url, canonical: the page that had the same content first (itself, for the first)."""
    mark = F.sha1(F.col("html").cast("binary"))
    first = pages.groupBy(mark.alias("mark")).agg(F.min_by("url", order).alias("canonical"))
    return pages.withColumn("mark", mark).join(first, "mark").select("url", "canonical")


def prune(front: DataFrame, above: int = 1000, keep: int = 100) -> DataFrame:
    """The front, or its first `keep` where it has over `above`."""
    return front.orderBy("url").limit(keep) if front.limit(above + 1).count() > above else front


def page_links(pages: DataFrame, rules: list[tuple[bool, str]] | None = None, most: int = LINKS_PER_PAGE) -> DataFrame:
    """src, dst: links that a crawl would follow; at most `most` a page, chosen by hash of the link."""
    found = pages.select(F.col("url").alias("src"), F.explode(anchors(F.col("html"))["href"]).alias("href"))
    named = found.select("src", crawl_url(F.col("href"), F.col("src")).alias("dst")).where("dst is not null").distinct()
    kept = named.where(~is_unwanted(F.col("dst")))
    if rules:
        kept = kept.where(robots_allowed(parse_url(F.col("dst"))["path"], rules))
    return sample_links(kept, most)


def sample_links(links: DataFrame, most: int = LINKS_PER_PAGE) -> DataFrame:
    """At most `most` links (src, dst) of each source, those whose hashes come first: repeatable chance."""
    order = Window.partitionBy("src").orderBy(F.sha1(F.col("dst").cast("binary")), "dst")
    return links.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")


def cleaned(pages: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """url, words of English pages without stop words; only words of the dictionary, where one is given."""
    english = pages.where(is_english(F.col("html")))
    words = english.select("url", F.posexplode(page_words(clean_html(F.col("html")))).alias("at", "word")).where(~is_stop_word(F.col("word")))
    if dictionary is not None:
        words = words.join(dictionary.select(F.col("term").alias("word")).distinct(), "word", "left_semi")
    return words.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select("url", F.transform("w", lambda x: x["word"]).alias("words"))


def cleaned_with_links(pages: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """url, page, length: a page as the crawl stores it, its words and then its links as empty anchors."""
    links = page_links(pages.where(is_english(F.col("html")))).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("links"))
    both = cleaned(pages, dictionary).join(links.withColumnRenamed("src", "url"), "url", "full")  # a url may have several pages
    anchors_of = F.transform("links", lambda u: F.concat(F.lit(' <a href="'), u, F.lit('"></a>')))
    page = F.concat(F.coalesce(F.array_join("words", " "), F.lit("")), F.coalesce(F.array_join(anchors_of, ""), F.lit("")))
    return both.select("url", page.alias("page"), F.length(page).alias("length"))


MOST_REDIRECTS = 3


def resolve_redirects(urls: DataFrame, redirects: DataFrame, most: int = MOST_REDIRECTS) -> DataFrame:
    """The urls (url, ...) with url followed through redirects (url, target); longer chains are dropped."""
    hops = redirects.select(F.col("url").alias("from"), "target")
    for _ in range(most):
        urls = urls.join(hops, F.col("url") == F.col("from"), "left").withColumn("url", F.coalesce("target", "url")).drop("from", "target")
    return urls.join(hops, F.col("url") == F.col("from"), "left_anti")


def crawl(
    seeds: DataFrame,
    pages: DataFrame,
    robots: DataFrame | None = None,
    redirects: DataFrame | None = None,
    cap: int | None = None,
    defer: float = 0.0,
    rounds: int | None = None,
    most_waiting: int | None = None,
    round_ms: float | None = None,
) -> DataFrame:
    """An offline crawl: url, depth, canonical of the stored pages (url, html) that a crawler would store.

    Each round takes the front, puts off a repeatable share of it, follows redirects, respects robots
    (host, robots) and the cap of pages per host over all rounds (by default that of the host's class), reads
    the pages that are there, and goes on to their links that are new. canonical is the url that showed the
    same content first. With most_waiting, a longer front is pruned to a tenth of that. With round_ms, what a
    round takes, hosts are read no faster than their crawl delay allows; what has to wait comes again.
    """
    front = checkpointed(seeds.select(crawl_url(F.col("url"), F.col("url")).alias("url")).where("url is not null").distinct())
    seen, stored, depth = front, None, 0
    pages = pages.select("url", "html")
    while (rounds is None or depth < rounds) and (size := front.count()):
        sent = F.broadcast if size <= SMALL_FRONT else lambda urls: urls
        late = F.pmod(F.xxhash64("url", F.lit(depth)), F.lit(1000)) < int(defer * 1000)
        waiting, now = front.where(late), front.where(~late)
        if redirects is not None:
            now = resolve_redirects(now, redirects).distinct()
            if stored is not None:
                now = now.join(stored.select("url"), "url", "left_anti")
        now = now.withColumn("host", parse_url(F.col("url"))["host"]).withColumn("robots", F.lit(""))
        if robots is not None:
            path = parse_url(F.col("url"))["path"]
            ruled = now.drop("robots").join(robots.select("host", "robots"), "host", "left").withColumn("robots", F.coalesce("robots", F.lit("")))
            now = ruled.where(robots_allowed_by_text(F.col("robots"), path))
        there = pages.select("url").join(sent(now.select("url").distinct()), "url").distinct()
        now = now.join(there, "url", "left_semi")  # what is not there doesn't count
        before = now.select("host").distinct().select("host", F.lit(0).alias("had"), F.lit(None).cast("int").alias("last"))
        if stored is not None:
            before = stored.groupBy(parse_url(F.col("url"))["host"].alias("host")).agg(F.count(F.lit(1)).alias("had"), F.max("depth").alias("last"))
        most = host_cap(F.col("host")) if cap is None else F.lit(cap)
        nth = F.row_number().over(Window.partitionBy("host").orderBy("url"))
        now = now.withColumn("nth", nth).join(before, "host", "left").where(F.col("nth") + F.coalesce("had", F.lit(0)) <= most)
        if round_ms is not None:
            delay = crawl_delay_ms(F.col("robots"))
            rested = F.coalesce((F.lit(depth) - F.col("last")) * round_ms >= delay, F.lit(True))
            on_time = rested & (F.col("nth") <= F.greatest(F.lit(1), F.floor(F.lit(round_ms) / delay)))
            now = checkpointed(now)
            waiting, now = waiting.unionByName(now.where(~on_time).select("url")), now.where(on_time)
        fresh = checkpointed(pages.join(sent(now.select("url")), "url").withColumn("depth", F.lit(depth)))
        stored = fresh if stored is None else stored.unionByName(fresh)
        found = checkpointed(page_links(fresh).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti"))
        seen, depth, front = seen.unionByName(found), depth + 1, found
        if defer or round_ms is not None:
            front = checkpointed(found.unionByName(waiting))
        if most_waiting is not None:
            front = checkpointed(prune(front, most_waiting, most_waiting // 10))
    if stored is None:
        stored = front.join(pages, "url").withColumn("depth", F.lit(0))
    order = stored.withColumn("order", F.struct("depth", "url"))
    return order.select("url", "depth").join(first_with_content(order.select("url", "html", "order"), "order"), "url")
