"""URL, text, key and stemming functions."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text, urls
from textloom.functions.keys import decode_key, encode_key, letter_hash, letter_pair
from textloom.functions.stem import stem, stemmed_vocabulary


def one(spark, of, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(of(*map(F.col, names))).first()[0]


@pytest.mark.parametrize(
    ("url", "parts"),
    [
        ("http://foo.com:8000/a/b?c=1#d", ("http", "foo.com", "8000", "/a/b?c=1#d")),
        ("https://foo.com", ("https", "foo.com", None, "/")),
        ("/a/b", (None, None, None, "/a/b")),
        ("a//b", ("", "b", None, "/")),
        ("//host/x", (None, None, None, "//host/x")),
        ("", (None, None, None, "")),
    ],
)
def test_parse_url(spark, url, parts):
    assert tuple(one(spark, urls.parse_url, url)) == parts


@pytest.mark.parametrize(
    ("url", "base", "crawled", "linked"),
    [
        ("/x#f", "https://a.com:443/b/c.html", "https://a.com:443/x", "https://a.com:443/x"),
        ("blah.html", "https://a.com:8000/b/c.html", "https://a.com:8000/b/blah.html", "https://a.com:8000/b/blah.html".replace("8000", "443")),
        ("http://o.com/y z", "https://a.com:443/b", "http://o.com:443/y%20z", "http://o.com:80/y z"),
        ("pic.JPG", "http://a.com/b/c", None, "http://a.com:80/b/pic.JPG"),
        ("ftp://a.com/x", "http://a.com/", None, "ftp://a.com:80/x"),
        ("/1/2/3/4/5/6", "http://a.com/", None, "http://a.com:80/1/2/3/4/5/6"),
    ],
)
def test_normalizers(spark, url, base, crawled, linked):
    assert one(spark, urls.crawl_url, url, base) == crawled
    assert one(spark, urls.graph_url, url, base) == linked


def test_graph_url_climbs(spark):
    base = "http://a.com:80/b/c/d/e.html"
    assert one(spark, urls.graph_url, "../x", base) == "http://a.com:80/b/c/d/x"
    assert one(spark, urls.graph_url, "../../x", base) == "http://a.com:80/b/c/x"
    assert one(spark, urls.graph_url, "#top", base) == base


def test_filters(spark):
    assert one(spark, urls.is_page_url, "http://a.com/b.html?x=.png") and not one(spark, urls.is_page_url, "http://a.com/b.PNG#x")
    assert one(spark, urls.is_unwanted, "http://www.youtube.com/x") and not one(spark, urls.is_unwanted, "http://a.com/")
    assert one(spark, lambda u, s: urls.is_indexable(u, s), "http://a.com/", "200")
    assert not one(spark, lambda u, s: urls.is_indexable(u, s), "http://a.com/../b", "200")
    assert not one(spark, lambda u, s: urls.is_indexable(u, s), "http://a.com/", None)
    assert one(spark, urls.shallow_path, "/a/../b/./c") == "/a/b/c" and one(spark, urls.shallow_path, "/1/2/3/4/5/6") is None


ROBOTS = "User-agent: other\nDisallow: /\nUser-agent: *\nAllow: /a/b\nDisallow: /a*x?\nDisallow:\nDisallow: /c.d"


@pytest.mark.parametrize(("path", "allowed"), [("/a/b/x?", True), ("/a/c/x?1", False), ("/a/c/x", True), ("/czd", False), ("/", True)])
def test_robots(spark, path, allowed):
    assert one(spark, lambda p: urls.robots_allowed(p, urls.robots_rules(ROBOTS)), path) is allowed
    assert one(spark, urls.robots_allowed_by_text, ROBOTS, path) is allowed


def test_robots_agent_sections():
    assert urls.robots_rules(ROBOTS, "OTHER") == [(False, "^/.*$")]
    assert urls.robots_rules("no rules here") == []


def test_robots_rules_are_no_patterns(spark):
    text = "User-agent: *\nDisallow: /a(b\nDisallow: /c+d[1]$\nDisallow: /x*(y)"
    for path, allowed in (("/a(b/c", False), ("/ab", True), ("/c+d[1]$e", False), ("/ccd1", True), ("/x--(y)", False), ("/xy", True)):
        assert one(spark, lambda p: urls.robots_allowed(p, urls.robots_rules(text)), path) is allowed
        assert one(spark, urls.robots_allowed_by_text, text, path) is allowed


def test_crawl_delay(spark):
    assert one(spark, urls.crawl_delay_ms, "Crawl-delay: 2\nx") == 2000
    assert one(spark, urls.crawl_delay_ms, "crawl-delay: soon") == 1000


def test_html(spark):
    page = '<html lang="EN-us"><script src="a">x</script><style a="b">p{}</style><A class="c" HREF="/u">t  <b>\nx</b></A>  <p>Hi,  12ab</p>'
    assert one(spark, text.is_english, page) and one(spark, text.is_english, "<html>") and not one(spark, text.is_english, '<html lang="de">')
    assert [tuple(a) for a in one(spark, text.anchors, page)] == [("/u", "t <b> x</b>")]
    assert "x</script>" not in one(spark, text.clean_html, page) and "p{}" not in one(spark, text.clean_html, page)
    assert one(spark, text.page_words, "<p>Hi, 12ab</p>") == ["hi", "12", "ab"]
    assert one(spark, text.index_words, "a  \tb\t c") == ["a", None, "\tb\t", "c"]


# The letters of the bytes of that digest, one by one.
PAIRS = "mm wk ke ce te ga yi ci do ke lc ji qi cg lo ei zk zo hq am".split()


def test_keys():
    # sha1 of "abc" is a9 99 3e 36 47 06 81 6a ba 3e 25 71 78 50 c2 6c 9c d0 d8 9d
    assert letter_hash("abc") == "".join(PAIRS)
    assert letter_pair(0) == "aa" and letter_pair(25) == "za" and letter_pair(26) == "ac" and letter_pair(255) == "vs"
    assert all(c.islower() for c in letter_hash("x"))
    assert encode_key("a/b é") == "a_2fb_20_e9" and decode_key("a_2fb_20_e9") == "a/b é"


STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "matting": "mat", "meetings": "meet",
    "relational": "relat", "conditional": "condit", "rational": "ration", "hopping": "hop", "hoping": "hope", "falling": "fall", "happy": "happi",
    "sky": "sky", "generalizations": "gener", "oscillators": "oscil", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate",
    "controll": "control", "roll": "roll", "at": "at", "possibly": "possibl", "archaeology": "archaeolog", "electricity": "electr", "Cats": "Cat",
}


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    found = stemmed_vocabulary(spark.createDataFrame([(w,) for w in [*STEMS, *STEMS]], "w string"))
    assert {r["term"]: r["stem"] for r in found.collect()} == STEMS
