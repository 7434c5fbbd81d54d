"""Page extraction: parser, held-out pages, the given pages."""

import pytest

from textloom.llm import html_blocks as hb
from textloom.llm.layouts import labelled_pages


@pytest.fixture(scope="module")
def field():
    return hb.trained()


def scores(field, pages):
    """F1 of content blocks."""
    hit = extra = missed = 0
    for page, labels in pages:
        found = hb.blocks(page)
        assert len(found) == len(labels)
        for got, label in zip(field.decode(found), labels):
            hit, extra, missed = hit + (got and label), extra + (got and not label), missed + (label and not got)
    return 2 * hit / (2 * hit + extra + missed)


def test_unseen_pages_of_known_layouts(field):
    assert scores(field, labelled_pages(200, seed=31)) >= 0.98


def test_held_out_families_of_layouts(field):
    """Skeletons, class words and interface words that training never saw."""
    assert scores(field, labelled_pages(300, seed=32, held_out=True)) >= 0.95


def test_viterbi_is_the_best_path(field):
    import itertools

    page = hb.blocks(labelled_pages(1, seed=5)[0][0])[:9]
    own = hb.features(page)

    def score(path):
        out = field.first[path[0]]
        for k, label in enumerate(path):
            out += label * sum(field.weights.get(f, 0.0) for f in own[k])
            out += field.moves[path[k - 1]][label] if k else 0
        return out

    best = max(itertools.product((0, 1), repeat=len(page)), key=score)
    assert score(best) == pytest.approx(score(field.decode(page)))


PROSE = [
    "Sentences of real prose stand here, and they go on for quite a while so that one can read them. A second one follows.",
    "The second paragraph tells more of the story, with commas, clauses and a proper end of its own.",
    "In the third one it all comes to its close, after which nothing is left to say about the matter.",
]
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in PROSE)
MENU = "<ul>" + "".join(f'<li><a href="/{k}">{k}</a></li>' for k in ("Home", "News", "Sport", "About")) + "</ul>"
REPLIES = "<h3>2 comments</h3><p>Nice text, thanks for writing it all down here.</p><p>I do not agree with any of this at all.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="x1">{MENU}</div><div class="c7">{PARAGRAPHS}</div><div class="z">© 2020 Example Ltd. All rights reserved.</div></body>',
        f'<html><body><nav>{MENU}</nav><article>{PARAGRAPHS}</article><div class="feedback">{REPLIES}</div></body></html>',
        f'<html><body><nav>{MENU}</nav><article>{PARAGRAPHS}</article><div class="zq9">{REPLIES}</div></body></html>',
        f'<html><body><div class="c7">{PARAGRAPHS}</div><div class="k2"><p>We use cookies to improve your visit.</p><button>Accept</button></div></body></html>',
        f'<html><body><nav>{MENU}</nav><article><object data="x"><p>{PROSE[0]}</p><select><p>{PROSE[1]}</p><p>{PROSE[2]}</p></article></body></html>',
        f"<html><body><article><p>{PROSE[0]}</p><img alt='don't' src=x><p>{PROSE[1]}</p><p class='b>{PROSE[2]}</p></article></body></html>",
        f'<html><body><article><p>{PROSE[0]}</p><img src="data:image/png;base64,{"iVBORw0K" * 12_500}"><p>{PROSE[1]}</p><p>{PROSE[2]}</p></article></body></html>',
        PARAGRAPHS,
    ],
)
def test_pages_without_telling_names(field, page):
    assert hb.main_text(field, page) == "\n".join(PROSE)


def test_very_deep_pages():
    deep = hb.blocks("<div>x" * 30_000 + "</div>" * 30_000 + "<p>y</p>")
    assert [b.text for b in deep] == ["x"] * 30_000 + ["y"] and max(len(b.path) for b in deep) == hb.DEEPEST
    assert deep[-1].path == ("p",)


def test_malformed_pages_take_linear_time(field):
    n = 100_000
    for page in ("<" * n, "<a " * n, "<a b='" * n, "<script" * n, "<svg>" * n, "</p" * n, '<a href="x' * n, "&" * n, "<!--" * n, '<a b="<">' * n, "<a x='\">" * n, "<p>" * 20_000 + "x"):
        hb.main_text(field, page)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
        ("<p>a <b>b<br>c</p> d", ["a b c", "d"]),
        ("<script>var t='</p>';</script>x<!-- <p>no</p> --><style>y</style>z", ["x", "z"]),
        ("<ul><li>one<li>two <i>2</i></ul>", ["one", "two 2"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p title='a>b'>q</p></div></p>r", ["q", "r"]),
        ("x<!-- never closed <p>y", ["x"]),
        ("a < b &lt;tag&gt; &#233;&nbsp;c", ["a < b <tag> é c"]),
        ("<script>open", []),
        ("x<template>no</template>y<svg>z", ["x", "y z"]),
        ("<p>a<textarea>b<p>c", ["a", "b", "c"]),
        ("<object>a</object> b<iframe>c</iframe><p>d <unfinished", ["a b", "d"]),
        ("a<!-->b<!--->c<!doctype x>d</>e", ["abcde"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in hb.blocks(page)] == texts


def test_given_pages(spark, folder, field):
    """Their articles are marked up as such; what surrounds them is not content."""
    import html
    import re

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = {r["page_id"]: r for r in hb.extract(pages, field).collect()}
    for r in pages.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<(?:br|b)>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        text = "\n".join(x for x in parts if x)
        assert rows[r["page_id"]]["text"] == text and rows[r["page_id"]]["n_chars"] == len(text)


def test_odd(spark, field):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<nav>menu</nav>"), (3, "u", "<nav>menu</nav>"), (None, "u", "<article><p>" + "long text. " * 50_000 + "</article>"), (5, "u", "<" * 20_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = hb.extract(pages, field).collect()
    assert len(found) == 6 and {r["text"] for r in found if r["page_id"] in (1, 2, 3)} == {""}
    assert max(r["n_chars"] for r in found) == 11 * 50_000 - 1
    assert hb.extract(pages.limit(0), field).count() == 0


def test_long_attributes():
    long = "iVBORw0KGgo>" * 400_000
    page = f"<body><p>One.</p><img src=\"data:image/png;base64,{long}\"><div data-x='{long}' class=\"content\"><p>Two.</p></div></body>"
    found = hb.blocks(page)
    assert [b.text for b in found] == ["One.", "Two."]
    assert found[1].path == hb.blocks(page.replace(long, "x"))[1].path


def test_stray_quotes_end_with_their_tag():
    page = "<p title=\"it\"s\">One.</p>" + "<p>filler</p>" * 1000 + "<p class='b>Two.</p>"
    assert [b.text for b in hb.blocks(page)] == ["One.", *["filler"] * 1000, "Two."]
