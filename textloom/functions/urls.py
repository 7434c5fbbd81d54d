"""URL functions: two normalizers (of the crawler and of the link graph), filters, robots rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings that are not pages, patterns of unwanted hosts and pages.
SKIPPED_ENDINGS = (".jpg", ".jpeg", ".gif", ".png", ".txt")
UNWANTED = (
    "mailto", "\\+tel", "snapchat", "youtube", "whatsapp", "telegram", "linkedin", "twitter", "amazon", "ebay", "alibaba", "etsy", "flickr",
    "tumblr", "wordpress", "paypal", "drive.google", "dropbox", "glassdoor", "indeed", "github", "gitlab", "bitbucket", "login", "register", "cgi-bin",
)
AGENT = "textloom-crawler"
DEEPEST = 5
LONGEST = 2048
HOST_CAP, HOST_CAP_STANDARD = 200, 25_000
# Hosts that may have more pages; a part of the host's name is enough.
STANDARD_HOSTS = (
    "wikipedia", "reddit", "medium", "bbc", "cnn", "nytimes", "stackoverflow", "imdb", "allrecipes", "epicurious", "quora", "researchgate",
    "scholar.google.com", "arxiv.org", "forbes", "healthline", "webmd", "bloomberg", "tripadvisor", "sciencedirect", "theguardian", "washingtonpost", "cnet", "techcrunch",
)


def host_cap(host: Column) -> Column:
    """How many pages of a host are crawled."""
    known = F.lit(False)
    for name in STANDARD_HOSTS:
        known = known | F.contains(host, F.lit(name))
    return F.when(known, HOST_CAP_STANDARD).otherwise(HOST_CAP)


def parse_url(url: Column) -> Column:
    """struct<protocol, host, port, path>; query and fragment stay in path, missing parts are null.

    A URL without "//" after its first character is all path; a host without a path has "/".
    """
    given = F.instr(url, "//") > 1
    part = lambda k: F.when(given, F.regexp_extract(url, r"(?s)^(.*?).//([^/]*)(.*)$", k))
    authority = part(2)
    ported = F.instr(authority, ":") > 1
    return F.struct(
        part(1).alias("protocol"),
        F.when(given, F.when(ported, F.substring_index(authority, ":", 1)).otherwise(authority)).alias("host"),
        F.when(given & ported, F.regexp_extract(authority, r"(?s)^[^:]+:(.*)$", 1)).alias("port"),
        F.when(given, F.when(part(3) == "", "/").otherwise(part(3))).otherwise(url).alias("path"),
    )


def shallow_path(path: Column) -> Column:
    """The path without ../ and ./, or null where it has over five parts."""
    short = F.regexp_replace(path, r"\.\./|\./", "")
    parts = F.filter(F.split(short, "/"), lambda x: (x != "") & (x != ".."))
    return F.when(F.size(parts) <= DEEPEST, short)


def _or(value: Column, other: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(other)


def _up_to_slash(path: Column) -> Column:
    """All up to the last slash, with it."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def crawl_url(url: Column, base: Column) -> Column:
    """A link as the crawler visits it (proto://host:port/path), or null where it doesn't.

    Parts that are missing come from the base, whose port is the protocol's own where it has none.
    """
    own, at = parse_url(url), parse_url(base)
    protocol = _or(own["protocol"], at["protocol"])
    port = F.coalesce(_or(own["port"], at["port"]), F.when(F.lower(protocol) == "https", "443").otherwise("80"))
    path = shallow_path(_or(own["path"], at["path"]))
    skipped = F.lower(path).rlike("(" + "|".join(e.replace(".", "\\.") for e in SKIPPED_ENDINGS) + ")$")
    bare = F.replace(F.regexp_replace(path, r"(?s)#.*$", ""), F.lit(" "), F.lit("%20"))
    full = F.when(bare.startswith("/"), bare).otherwise(F.concat(_up_to_slash(at["path"]), bare))
    wanted = F.lower(protocol).isin("http", "https") & ~skipped
    return F.when(wanted, F.trim(F.concat(protocol, F.lit("://"), _or(own["host"], at["host"]), F.lit(":"), port, full)))


def graph_url(url: Column, base: Column) -> Column:
    """A link as the link graph names it: port by protocol, fragments cut, ../ resolved."""
    own, at = parse_url(url), parse_url(base)
    default = lambda p: F.when(p == "https", "443").otherwise("80")
    protocol = _or(own["protocol"], at["protocol"])
    path = F.regexp_replace(own["path"], r"(?s)#.*$", "")
    ups = F.regexp_extract(path, r"^((?:\.\./)*)", 1)
    steps = (F.length(ups) / 3).cast("int")
    # each ../ takes one part from the base's path
    climbed = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), at["path"], lambda acc, _: F.regexp_extract(acc, r"(?s)^(.*/)[^/]*.$", 1))
    parent = F.when(path.startswith("/"), "").when(steps > 0, climbed).when(path != "", _up_to_slash(at["path"])).otherwise(at["path"])
    port = _or(own["port"], default(protocol))
    return F.concat(protocol, F.lit("://"), _or(own["host"], at["host"]), F.lit(":"), port, parent, F.regexp_replace(path, r"^(?:\.\./)+", ""))


def is_page_url(url: Column) -> Column:
    """http or https, and not one of the skipped endings before query and fragment."""
    path = F.lower(F.regexp_extract(url, r"(?s)^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    return url.rlike("^(http|https)://") & ~path.rlike("(" + "|".join(e.replace(".", "\\.") for e in SKIPPED_ENDINGS) + ")$")


def is_unwanted(url: Column) -> Column:
    return url.rlike("|".join(UNWANTED))


def is_indexable(url: Column, status: Column) -> Column:
    """No "..", at most 2048 characters, status 200; nulls are not indexed."""
    return F.coalesce(~F.contains(url, F.lit("..")) & (F.length(url) <= LONGEST) & (status == "200"), F.lit(False))


def _pattern(rule: str) -> str:
    """A rule's path as a pattern: * is any run, a dot any character, all else stands for itself."""
    return "".join(".*" if c == "*" else "\\" + c if c in "?()[]{}+^$|\\" else c for c in rule)


def robots_rules(text: str, agent: str = AGENT) -> list[tuple[bool, str]]:
    """(allow, pattern) rules of the first section for the agent, else for *; empty rules are left out."""
    for wanted in (agent, "*"):
        rules, inside = [], False
        for line in map(str.strip, text.split("\n")):
            name, _, value = line.partition(":")
            if name.lower() == "user-agent":
                inside = value.strip().lower() == wanted.lower() and not rules
            elif inside and name in ("Allow", "Disallow"):
                rules.append((name == "Allow", value.strip()))
        if rules:
            return [(a, "^" + _pattern(p) + ".*$") for a, p in rules if p]
    return []


def robots_allowed(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """The first rule that matches decides; without one the path is allowed. Dots match any character."""
    out = F.lit(True)
    for allow, pattern in reversed(rules):
        out = F.when(path.rlike(pattern), F.lit(allow)).otherwise(out)
    return out


def robots_allowed_by_text(robots: Column, path: Column) -> Column:
    """The same where every row has its own robots text: parsed once per distinct text and batch."""

    @F.pandas_udf("boolean")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import re

        for texts, paths in batches:
            known = {t: [(a, re.compile(p, re.DOTALL)) for a, p in robots_rules(t or "")] for t in texts.unique()}
            yield pd.Series([next((a for a, p in known[t] if p.match(x or "")), True) for t, x in zip(texts, paths)], dtype=bool)

    return decide(robots, path)


def crawl_delay_ms(robots: Column) -> Column:
    """Milliseconds of the first crawl-delay, 1000 where there is none or it is no number."""
    value = F.regexp_extract(robots, r"(?i)crawl-delay:([^\n]*)", 1)
    return F.coalesce(F.trim(value).try_cast("double") * 1000, F.lit(1000.0))


def may_fetch(now_ms: Column, last_ms: Column, delay_ms: Column) -> Column:
    return F.coalesce((last_ms <= 0) | (now_ms - last_ms >= delay_ms), F.lit(True))
