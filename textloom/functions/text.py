"""Page and word functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that carry no meaning in search.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out
    on off over under again further then once here there when where why how all any both each few more most
    other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Patterns of anchors, scripts, styles, tags and punctuation.
ANCHOR = r'(?is)<a\s+(?:[^>]*?\s+)?href="([^"]*)"[^>]*>(.*?)</a>'
SCRIPT = r"<script[^>]*>[\s\S]*?</script>"
STYLE = r"<style[^>]*>[\s\S]*?</style>"
TAG = r"<[^>]*>"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def anchors(html: Column) -> Column:
    """array<struct<href, text>> of a page's links, in order; link text with white space collapsed."""
    hrefs, texts = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    return F.zip_with(hrefs, texts, lambda h, t: F.struct(h.alias("href"), F.trim(F.regexp_replace(t, r"\s+", " ")).alias("text")))


def strip_scripts(html: Column) -> Column:
    return F.regexp_replace(html, SCRIPT, "")


def strip_styles(html: Column) -> Column:
    """Removes whole style elements, as is meant; attributes and bodies of any length."""
    return F.regexp_replace(html, STYLE, "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s{2,}", " ")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, TAG, " ")


def plain_lower(text: Column) -> Column:
    """ASCII punctuation to spaces, then lower case."""
    return F.lower(F.regexp_replace(text, PUNCTUATION, " "))


def clean_html(html: Column) -> Column:
    """Scripts and styles out, runs of white space to one space."""
    return collapse_spaces(strip_styles(strip_scripts(html)))


def page_words(html: Column) -> Column:
    """Words of a page as the crawler cuts them: at white space and where digits meet other characters."""
    return F.filter(F.split(plain_lower(strip_tags(html)), r"\s+|(?<=\d)(?=\D)|(?<=\D)(?=\d)"), lambda w: w != "")


def index_words(text: Column) -> Column:
    """Words as the indexer cuts them: at single spaces; blank words keep their place (null)."""
    return F.transform(F.split(text, " "), lambda w: F.when(w.rlike(r"[^\x00-\x20]"), w))


def is_stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)


def is_english(html: Column) -> Column:
    """By the lang attribute of the html element; pages without one count as English."""
    lang = F.lower(F.regexp_extract(html, r'(?i)<html\s+(?:[^>]*?\s+)?lang="([^"]+)"', 1))
    return (lang == "") | (lang == "en") | lang.startswith("en-")
