"""Personal data: exact base patterns, and offset-preserving deobfuscation on top of them.

A transducer rewrites disguises (look-alike letters, wide digits, invisible characters, spelled digits,
"at" and "dot" in words or brackets) and keeps, for every character it puts out, the source span it
came from. The same detectors run over the rewritten text; what they find is mapped back to source
characters and added unless a base span of the same kind overlaps it. Base spans always stay. What
overlaps one and reaches beyond it (the base pattern saw a part of a disguised identifier) is not counted
twice: it goes into a column of its own, ``wider``, and ``redact`` covers it too.

Defined cases: a null text is empty; empty texts give counts of 0 and empty strings; texts of any
length are scanned whole in linear time; null doc_ids, repeated rows and further columns pass.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like Latin ones, and characters that don't show.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TIMES = {"double": 2, "triple": 3}
#: Any letters end a domain but words of running text that are no top-level label ("at the dot of ten").
NO_ENDING = "the|of|and|or|but|if|then|than|that|this|these|those|there|their|they|he|she|we|you|his|her|its|our|your|with|for|from|on|was|were|are|has|have|had|not|when|where|which|who|what|how"
ENDING = rf"(?!(?:{NO_ENDING})\b)[A-Za-z]{{2,}}\b"
#: After a plain dot a capital begins a sentence ("at noon.It"), unless the ending is a frequent one.
DOT_ENDING = rf"(?:(?:com|org|net|edu|gov|info|io|de|fr|es|uk)\b|(?-i:(?=[a-z]+\b|[A-Z]+\b)){ENDING})"

STRANGE = re.compile("[" + "".join(LOOKALIKES) + INVISIBLE + "！-～٠-٩۰-۹०-९]")
_WORD = "(?:(?:double|triple)[ -])?(?:" + "|".join(DIGIT_WORDS) + ")"
RULES = re.compile(
    # nothing begins at a blank behind a blank: runs of white space are passed at one look each
    rf"(?:(?=\S)|(?<!\s))(?:(?P<strange>{STRANGE.pattern})"
    r"|(?P<at>(?:(?<!\s)\s++)?[\[({<]\s*at\s*[\])}>]\s*|(?<=\w)\s+at\s+(?=[\w-]+\s*[\[({]\s*dot\s*[\])}]\s*\w)"
    rf"|(?<=\w)\s+at\s+(?=[\w-]+(?:\s+dot\s+[\w-]+)*\s+dot\s+{ENDING})"
    rf"|(?<=\w)\s+at\s+(?=[\w-]+(?:\.[\w-]+)*\.{DOT_ENDING}))"
    r"|(?P<dot>(?:(?<!\s)\s++)?[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|(?<=\w)\s+dot\s+(?=\w))"
    rf"|(?P<plus>\bplus[ -]+(?=[0-9]|{_WORD}\b))"
    rf"|(?P<digits>\b{_WORD}(?:[ -]+{_WORD})+\b|\b{_WORD}(?=[ ().-]{{1,2}}[0-9]| dot [0-9])"
    rf"|(?:(?<=[0-9][ (-])|(?<=[0-9][ ().-][ (-])|(?<=[0-9]\.)|(?<=[0-9] dot )){_WORD}\b))",
    re.IGNORECASE,
)
_DIGITS = "|".join(DIGIT_WORDS)
_TIMES = f"(?:(?:{'|'.join(TIMES)})[ -])?"
#: What every alternative of RULES but that of strange characters holds in lower-case text. Each begins with
#: plain letters or signs, which are looked for fast; only texts with one of these meet RULES itself.
#: re.IGNORECASE lets U+0131, U+017F and U+212A stand for i, s and k; texts with those take RULES at once.
HINTS = tuple(
    re.compile(p)
    for p in (
        r"at(?<!\wat)(?:\s*[\])}>]|\s+(?=[\w-]+\s*[\[({]\s*dot|[\w-]+(?:\s+dot\s+[\w-]+)*\s+dot\s|[\w-]+(?:\.[\w-]+)*\.[a-z]{2}))",
        r"dot(?<!\wdot)(?:\s*[\])}>]|\s+\w)",
        r"\.\s*[\])}>]",
        rf"plus(?<!\wplus)[ -]+(?:[0-9]|{_TIMES}(?:{_DIGITS}))",
        rf"[0-9](?:[ ().-]{{1,2}}| dot )(?:{_DIGITS}|{'|'.join(TIMES)})",
        *[rf"{w}(?<!\w{w})(?=[ -]+{_TIMES}(?:{_DIGITS})\b|[ ().-]{{1,2}}[0-9]| dot [0-9])" for w in DIGIT_WORDS],
    )
)
FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")
FOLDS = str.maketrans("\u0131\u017f", "is")

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            out.append((start, found.end()))
            floor = found.end()
            at = text.find("@", floor)
        else:
            floor = at + 1  # no later match can reach back over this sign
            at = text.find("@", floor)
    return out


def _ips(text: str) -> list[Span]:
    # leading zeros go first: a part may have any number of them
    parts = lambda found: [p.lstrip("0") or "0" for p in found.split(".")]
    return [m.span() for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in parts(m[0]))]


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, leftmost and non-overlapping within the kind."""
    return {"email": _emails(text) if "@" in text else [], "ip": _ips(text), "card": _cards(text), "phone": _phones(text) if "+" in text else []}


def _plain(char: str) -> str:
    if char in INVISIBLE:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    digit = unicodedata.digit(char, None)
    return str(digit) if digit is not None else chr(ord(char) - 0xFEE0)


def transduce(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The rewritten text, and for each of its characters the source span [start, end)."""
    while_rewriting = [(text, np.arange(len(text)), np.arange(1, len(text) + 1))]
    for wanted in (("strange",), ("at", "dot", "plus", "digits")):  # letters first, then the words they spell
        source, starts, ends = while_rewriting.pop()
        parts, lows, highs, done = [], [], [], 0

        def emit(new: str, a: int, b: int) -> None:
            parts.append(new)
            lows.append(np.full(len(new), starts[a] if len(starts) else 0))
            highs.append(np.full(len(new), ends[b - 1] if len(ends) else 0))

        for m in (STRANGE if wanted == ("strange",) else RULES).finditer(source):
            a, b = m.span()
            parts.append(source[done:a])
            lows.append(starts[done:a])
            highs.append(ends[done:a])
            kind = "strange" if wanted == ("strange",) else m.lastgroup
            if kind == "strange":
                emit(_plain(m[0]), a, b)
            elif kind in ("at", "dot", "plus"):
                emit({"at": "@", "dot": ".", "plus": "+"}[kind], a, b)
            else:
                times, opened = 1, a
                for w in re.finditer(r"[^ -]+", m[0]):
                    word = w[0].lower().translate(FOLDS).replace("\u0307", "")
                    if word in TIMES:
                        times, opened = TIMES[word], a + w.start()
                    else:
                        emit(DIGIT_WORDS[word] * times, opened if times > 1 else a + w.start(), a + w.end())
                        times = 1
            done = b
        parts.append(source[done:])
        lows.append(starts[done:])
        highs.append(ends[done:])
        while_rewriting.append(("".join(parts), np.concatenate(lows).astype(np.int64), np.concatenate(highs).astype(np.int64)))
    return while_rewriting[0]


def suspicious(text: str) -> bool:
    """Whether the transducer could change the text; cheap for ordinary texts."""
    if not text.isascii() and STRANGE.search(text):
        return True
    if text.isascii() or FOLDED.search(text) is None:
        low = text.lower()
        if not any(hint.search(low) for hint in HINTS):
            return False
    return RULES.search(text) is not None


Found = list[tuple[str, int, int]]


def three_kinds_of_spans(text: str) -> tuple[Found, Found, Found]:
    """Base spans, all spans, and spans that are wider than a base span they overlap, each as (kind, start, end)
    by start and then kind."""
    base = base_spans(text)
    added: Found = []
    wider: Found = []
    if suspicious(text):
        plain, low, high = transduce(text)
        for kind, found in base_spans(plain).items():
            own = base[kind]  # ascending and apart from each other
            ends = [b for _, b in own]
            for a, b in found:
                a, b = int(low[a]), int(high[b - 1])
                k = bisect.bisect_right(ends, a)
                if k == len(own) or own[k][0] >= b:
                    added.append((kind, a, b))
                elif a < own[k][0] or b > own[k][1]:
                    wider.append((kind, a, b))
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    first = sorted(((k, a, b) for k in KINDS for a, b in base[k]), key=order)
    return first, sorted(first + added, key=order), sorted(wider, key=order)


def all_spans(text: str) -> tuple[Found, Found]:
    """Base spans, and all spans."""
    return three_kinds_of_spans(text)[:2]


def redact(text: str | None) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    text = text or ""
    _, every, wider = three_kinds_of_spans(text)
    out, done = [], 0
    for kind, a, b in sorted(every + wider, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, a count per kind, base_sha256, spans, n_spans, wider."""

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                counts, shas, spans, more = [[] for _ in KINDS], [], [], []
                for text in part.column("text").to_pylist():
                    base, every, wider = three_kinds_of_spans(text or "")
                    for k, kind in enumerate(KINDS):
                        counts[k].append(sum(s[0] == kind for s in every))
                    shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(every))
                    more.append(_joined(wider))
                total = pa.array([sum(c) for c in zip(*counts)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string()), total, pa.array(more, pa.string())],
                    names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans", "wider"],
                )

    columns = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, wider string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, columns)
