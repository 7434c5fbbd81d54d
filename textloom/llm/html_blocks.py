"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into its leaf blocks: runs of text between the edges of block-level elements. Features
of a block are

* its path: the tags of its ancestors and the words of their class, id and role attributes, as they are;
* its shape: length, links, sentences and signs, and the shapes of its neighbours;
* its place: how much of the page's prose its container holds, and where it lies to the hub, the deepest
  element that holds most of the prose.

Two labels, content and other, form a chain along the page; weights are trained by gradient ascent on the
likelihood of labelled pages, and Viterbi decodes. Which tags and words tell something is learned: the
labelled pages (``layouts``) are invented ones, many of them without any class, with classes that mean
nothing, or without an article element. Training is seeded and takes some seconds once per driver; a few
thousand weights go out.

Defined cases: a null page is empty; a page without text, or with none that is content, gives an empty
string; unclosed, stray and nested elements close as browsers close them, roughly; tags end as the HTML
standard has it (a quote counts only behind "="), but a quote that never closes ends with its tag; elements count
as ancestors to a depth of 100; scripts,
styles, comments and unfinished tags give no text; a frame, graphic or template without its closing tag
swallows nothing; repeated rows and further columns pass.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices
from textloom.llm.layouts import labelled_pages

#: Text, and an ordinary tag behind it; what doesn't match is looked at sign by sign.
ORDINARY = re.compile(r"([^<]*+)<(/?)([A-Za-z][A-Za-z0-9]*+)((?:[^>=\"']|=\"[^\"<>]*+\")*+)>")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
PLAIN_TAG = re.compile(r"[^>=]*>")
STOP = re.compile(r"[>=]")
VALUE = re.compile(r"\s*([\"']?)")
BARE = re.compile(r"[^\s>]*")
MARK = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Words of a class: runs of letters, cut where a capital follows a small letter.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var object".split())
#: Elements whose inside is no markup or no text of the page, up to their closing tag.
RAW = frozenset("script style textarea iframe noscript template svg math noembed noframes xmp".split())
#: Those that swallow the rest of the page if they aren't closed, as browsers have it.
OPEN_ENDED = frozenset("script style".split())
CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
#: Elements nested deeper than this don't count as ancestors: a page that never closes them stays linear.
DEEPEST = 100
#: Elements that a start tag of the same kind, or of a block for p, closes.
CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
SCOPES = frozenset("article aside body div footer form header main nav section table td th blockquote figure html".split())


def tag_end(page: str, at: int, lost: set[str]) -> int:
    """Where the tag whose name ends at `at` ends (behind its ">"), or -1. Quotes in `lost` have no partner ahead."""
    if found := PLAIN_TAG.match(page, at):
        return found.end()
    while found := STOP.search(page, at):
        at = found.end()
        if found[0] == ">":
            return at
        value = VALUE.match(page, at)
        at = value.end()
        if quote := value[1]:
            close = -1 if quote in lost else page.find(quote, at)
            if close >= 0:
                at = close + 1
                continue
            lost.add(quote)
        at = BARE.match(page, at).end()
    return -1


@functools.lru_cache(maxsize=4096)
def _step(tag: str, attributes: str) -> str:
    """Tag and the distinct words of its class, id and role, as one path step."""
    words = {w.lower() for m in MARK.finditer(attributes) for w in WORD.findall(m[1] or m[2] or m[3] or "") if len(w) > 1}
    return " ".join([tag, *sorted(words)])


class Block:
    """A leaf block: steps and numbers of the block-level elements around it, its text, how much of it is linked."""

    __slots__ = ("path", "chain", "text", "links")

    def __init__(self, path: tuple[str, ...], chain: tuple[int, ...], text: str, links: int) -> None:
        self.path, self.chain, self.text, self.links = path, chain, text, links


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, without empty ones; one pass, whatever the markup."""
    out: list[Block] = []
    names: list[str] = []
    steps: list[str | None] = []  # None for inline elements
    numbers: list[int] = []
    parts: list[str] = []
    lost: set[str] = set()
    unclosed: set[str] = set()
    beyond: Counter = Counter()  # open elements too deep to be kept
    links, made, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                path, chain = tuple(steps), tuple(numbers)
                if None in path:
                    path, chain = tuple([s for s in path if s is not None]), tuple([n for n, s in zip(chain, path) if s is not None])
                out.append(Block(path, chain, text, min(links, len(text))))
            parts.clear()
        links = 0

    def cut_to(k: int) -> None:
        del names[k:], steps[k:], numbers[k:]
        beyond.clear()  # they were within what is closed now

    while at < len(page):
        if found := ORDINARY.match(page, at):
            text, closing, tag, attributes = found.groups()
            end = found.end()
            if text:
                if "a" in names and not text.isspace():
                    links += len(text)
                parts.append(text)
            tag = tag.lower()
        else:
            opened = page.find("<", at)
            if opened < 0:
                opened = len(page)
            if opened > at:
                text = page[at:opened]
                if "a" in names and not text.isspace():
                    links += len(text)
                parts.append(text)
                at = opened
                continue
            sign = page[at + 1 : at + 2]
            closing = sign == "/"
            name = NAME.match(page, at + 1 + closing)
            if name is None:
                if page.startswith("<!--", at):
                    if page.startswith((">", "->"), at + 4):
                        at = page.index(">", at) + 1
                        continue
                    end = page.find("-->", at + 4)
                    at = len(page) if end < 0 else end + 3
                elif sign and sign in "!?/":
                    end = page.find(">", at)
                    at = len(page) if end < 0 else end + 1
                else:
                    parts.append("<")
                    at += 1
                continue
            tag = name[0].lower()
            end = tag_end(page, name.end(), lost)
            if end < 0:
                break  # an unfinished tag
            attributes = page[name.end() : end - 1]
        at = end
        if closing:
            if beyond[tag]:
                beyond[tag] -= 1
                if tag not in INLINE:
                    flush()
            elif tag in names:
                inline = tag in INLINE
                if not inline:
                    flush()
                k = len(names) - 1 - names[::-1].index(tag)
                if not inline or not any(n in SCOPES for n in names[k:]):
                    if any(n not in INLINE for n in names[k:]):
                        flush()
                    cut_to(k)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        if tag in RAW:
            close = None if tag in unclosed else CLOSING[tag].search(page, at)
            if close is not None:
                end = page.find(">", close.end())
                at = len(page) if end < 0 else end + 1
            elif tag in OPEN_ENDED:
                break
            else:
                unclosed.add(tag)
            if tag in ("svg", "math"):
                parts.append(" ")
            else:
                flush()
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            stop = CLOSES.get(tag)
            for k in range(len(names) - 1, -1, -1):
                if stop is None and names[k] in SCOPES or stop and names[k] in stop:
                    break
                if names[k] == (tag if stop else "p"):
                    cut_to(k)
                    break
            if tag in ("body", "frameset") and "head" in names:
                cut_to(names.index("head"))
        if attributes.endswith("/"):
            continue
        if len(names) >= DEEPEST:
            beyond[tag] += 1
        else:
            names.append(tag)
            numbers.append(made)
            made += 1
            # long attributes are not worth keeping in the cache
            steps.append(None if inline else tag if not attributes else (_step if len(attributes) <= 4000 else _step.__wrapped__)(tag, attributes))
    flush()
    return out


#: Prose: a block of at least so many characters that ends a sentence and is hardly linked.
PROSE_CHARS, PROSE_LINKS = 40, 0.3
HUB_SHARE = 0.6
FEW_WORDS = 8
ENDS = frozenset(".!?…:;。！？")


def path_features(path: tuple[str, ...]) -> list[str]:
    steps = [s.split(" ") for s in path]
    tags = [s[0] for s in steps]
    out = {f"tag {t}" for t in tags} | {f"word {w}" for s in steps for w in s[1:]}
    out.update(f"start {w[:4]}" for s in steps for w in s[1:] if len(w) > 4)
    near = next((s for s in reversed(steps) if len(s) > 1), [])
    out.update(f"near {w}" for w in near[1:])
    leaf, above = (["none", "none", *tags])[:-3:-1]
    return sorted(out | {f"leaf {leaf}", f"leaf {leaf} in {above}", f"deep {min(len(tags), 8)}", f"named {len(near) > 1}"})


def own_shape(block: Block) -> tuple[int, ...]:
    """Length, links, sentences, whether it ends one, begins with a capital, and speaks of rights."""
    text = block.text
    n = len(text)
    share = block.links / n
    ends = text[-1] in ENDS
    stops = text.count(". ") + text.count("! ") + text.count("? ")
    rights = "©" in text[:80] or (n < 400 and "rights reserved" in text.lower())
    return min(11, n.bit_length()), 0 if not block.links else 1 if share < PROSE_LINKS else 2 if share < 0.8 else 3, min(3, stops), int(ends), int(text[0].isupper()), int(rights)


def shape_features(key: tuple) -> list[str]:
    (length, links, stops, ends, upper, rights), before, after, place = key
    size = lambda s: -1 if s is None else 0 if s[0] < 6 else 1 if s[0] < 8 else 2
    linked = lambda s: -1 if s is None else s[1]
    return [
        "bias", f"length {length}", f"links {links}", f"stops {stops}", f"ends {ends}", f"upper {upper}", f"rights {rights}", f"rights {rights} {size((length,))}", f"length {length} ends {ends}", f"length {length} links {links}",
        f"before {size(before)} {linked(before)}", f"after {size(after)} {linked(after)}", f"between {size(before)} {size((length,))} {size(after)}", f"place {place}",
    ]


def bucket(share: float) -> int:
    return 0 if share <= 0 else 1 if share < 0.1 else 2 if share < 0.3 else 3 if share < HUB_SHARE else 4


def place_features(key: tuple) -> list[str]:
    prose, linked, count, hub, side, below, leaf, alone = key
    return [f"alone {alone}", f"holds {prose}", f"holds {prose} linked {linked}", f"linked {linked}", f"count {count}", f"hub {hub} {side}", f"hub {hub} {side} leaf {leaf}", f"hub {hub} below {below}", f"hub {hub} below {below} leaf {leaf}"]


def word_features(text: str) -> list[str]:
    """Words of short blocks."""
    words = text.lower().split(None, FEW_WORDS)
    return [f"says {w.strip('.,:;!?()')}" for w in words] if len(words) <= FEW_WORDS else []


def keys(page: list[Block]) -> list[tuple[tuple, tuple, tuple]]:
    """For each block what its path, shape and place features follow from."""
    shapes = [own_shape(b) for b in page]
    prose = [len(b.text) if len(b.text) >= PROSE_CHARS and s[3] and b.links < PROSE_LINKS * len(b.text) else 0 for b, s in zip(page, shapes)]
    if not any(prose):  # no sentences at all: any text that is not linked
        prose = [len(b.text) if not b.links else 0 for b in page]
    total = max(1, sum(prose))
    held: dict[int, list[int]] = {}
    for b, p in zip(page, prose):
        for number in b.chain[:-1] or b.chain:
            sums = held.setdefault(number, [0, 0, 0, 0])
            sums[0] += p
            sums[1] += len(b.text)
            sums[2] += b.links
            sums[3] += 1
    hub, first, last = -1, 0, len(page) - 1
    for number, sums in held.items():  # numbers rise with depth along a chain
        if sums[0] >= HUB_SHARE * total and number > hub:
            hub = number
    inside = [k for k, b in enumerate(page) if prose[k] and hub in b.chain]
    if inside:
        first, last = inside[0], inside[-1]
    alone = not any(b.links or len(b.path) > 1 for b in page)  # a fragment, of text alone
    out, n = [], len(page)
    for k, b in enumerate(page):
        place = (k if k < 2 else 2 if k * 4 < n else 3 if k * 4 < 3 * n else 4 if k < n - 2 else 5 + k - (n - 2))
        shape = shapes[k], shapes[k - 1][:2] if k else None, shapes[k + 1][:2] if k + 1 < n else None, place
        sums = held[b.chain[-2] if len(b.chain) > 1 else b.chain[0]] if b.chain else [0, 1, 0, 1]
        side = "lead" if k < first else "tail" if k > last else "mid"
        below, near = "", 0
        if hub in b.chain:
            near, rest = 1, b.path[b.chain.index(hub) + 1 :]
            below = rest[0].split(" ", 1)[0] if len(rest) > 1 else ""
        leaf = b.path[-1].split(" ", 1)[0] if b.path else "none"
        out.append((b.path, shape, (bucket(sums[0] / total), bucket(sums[2] / max(1, sums[1])), min(3, sums[3].bit_length()), near, side, below, leaf, alone)))
    return out


PARTS = (path_features, shape_features, place_features)


def features(page: list[Block]) -> list[list[str]]:
    """All features of each block."""
    return [[f for of, key in zip(PARTS, own) for f in of(key)] + word_features(b.text) for b, own in zip(page, keys(page))]


class Field:
    """Weights of the chain: features for content against other, label by next label, first label."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, first: np.ndarray) -> None:
        self.weights, self.moves, self.first = weights, moves.tolist(), first.tolist()
        self.known: tuple[dict, dict, dict] = ({}, {}, {})

    def _of(self, which: int, key: tuple) -> float:
        """Summed weights of what follows from a key; keys repeat from page to page."""
        known = self.known[which]
        if (own := known.get(key)) is None:
            if len(known) > 50_000:
                known.clear()
            own = known[key] = sum(self.weights.get(f, 0.0) for f in PARTS[which](key))
        return own

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi labels of a page's blocks."""
        back, best, weights = [], None, self.weights
        (stay0, rise), (fall, stay1) = self.moves
        for block, (path, shape, place) in zip(page, keys(page)):
            score = self._of(0, path) + self._of(1, shape) + self._of(2, place)
            for f in word_features(block.text):
                score += weights.get(f, 0.0)
            if best is None:
                best = self.first[0], self.first[1] + score
                continue
            zero, one = best
            back.append((one + fall > zero + stay0, one + stay1 > zero + rise))
            best = max(zero + stay0, one + fall), max(zero + rise, one + stay1) + score
        if best is None:
            return []
        labels = [int(best[1] > best[0])]
        for steps in reversed(back):
            labels.append(int(steps[labels[-1]]))
        return labels[::-1]


#: A feature counts if it is on so many of the labelled pages: names that mean nothing are on few.
LEAST_PAGES = 5


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Field:
    """Maximum likelihood with a ridge, by Adam; forward and backward sums run over all pages at once."""
    every = [features(page) for page, _ in pages]
    seen = Counter(f for page in every for f in {f for own in page for f in own})
    names = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_PAGES))}
    longest, size = max(len(b) for b, _ in pages), len(names)
    gold = np.full((len(pages), longest), -1)
    rows, columns = [], []
    for p, (_, labels) in enumerate(pages):
        gold[p, : len(labels)] = labels
        for k, own in enumerate(every[p]):
            found = [names[f] for f in own if f in names]
            columns += found
            rows += [p * longest + k] * len(found)
    rows, columns = np.array(rows), np.array(columns)
    real, both = gold >= 0, gold[:, 1:] >= 0
    theta = np.zeros(size + 6)
    slow, fast = np.zeros_like(theta), np.zeros_like(theta)

    def gathered(content: np.ndarray, pairs: dict[tuple[int, int], np.ndarray], first: np.ndarray) -> np.ndarray:
        moves = [(pairs[a, b] * both).sum() for a in (0, 1) for b in (0, 1)]
        return np.concatenate([np.bincount(columns, weights=content.ravel()[rows], minlength=size), moves, first])

    pairs = {(a, b): (gold[:, :-1] == a) & (gold[:, 1:] == b) for a in (0, 1) for b in (0, 1)}
    target = gathered((gold == 1).astype(float), pairs, np.array([(gold[:, 0] == a).sum() for a in (0, 1)]))
    for step in range(1, rounds + 1):
        moves, first = theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        content = np.bincount(rows, weights=theta[columns], minlength=gold.size).reshape(gold.shape)
        score = np.stack([np.zeros_like(content), content], axis=2)
        forth, behind = np.zeros_like(score), np.zeros_like(score)
        forth[:, 0] = first + score[:, 0]
        for k in range(1, longest):
            now = np.logaddexp(forth[:, k - 1, :1] + moves[0], forth[:, k - 1, 1:] + moves[1]) + score[:, k]
            forth[:, k] = np.where(real[:, k, None], now, forth[:, k - 1])
        for k in range(longest - 2, -1, -1):
            ahead = score[:, k + 1] + behind[:, k + 1]
            now = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
            behind[:, k] = np.where(real[:, k + 1, None], now, 0)
        total = np.logaddexp(forth[:, -1, 0], forth[:, -1, 1])[:, None]
        chance = np.exp(forth[:, :, 1] + behind[:, :, 1] - total) * real
        pairs = {(a, b): np.exp(forth[:, :-1, a] + moves[a, b] + score[:, 1:, b] + behind[:, 1:, b] - total) * both for a in (0, 1) for b in (0, 1)}
        one = chance[:, 0].sum()
        slope = (target - gathered(chance, pairs, np.array([real[:, 0].sum() - one, one]))) / len(pages) - ridge * theta
        slow = 0.9 * slow + 0.1 * slope
        fast = 0.99 * fast + 0.01 * slope**2
        theta = theta + rate * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(theta[k]) for f, k in names.items()}, theta[size : size + 4].reshape(2, 2), theta[size + 4 :])


@functools.lru_cache(maxsize=1)
def trained() -> Field:
    return train([(blocks(page), labels) for page, labels in labelled_pages()])


def main_text(field: Field, page: str | None) -> str:
    """Blocks labelled content, one line each."""
    found = blocks(page or "")
    return "\n".join(b.text for b, label in zip(found, field.decode(found)) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    field = field or trained()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(field, page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
