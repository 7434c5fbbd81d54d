"""Invented web pages with the label of each leaf block, to train and to test page extraction.

A page is an article among menus, headers, footers, sidebars, notices, adverts, forms, shares and reader
comments, in one of several skeletons. How it names its parts differs by page: by telling elements, by
telling class words, by classes that mean nothing, or not at all. What can't be told by name can be told
by shape: articles then hold most of the page's prose.

``held_out=True`` gives families of layouts that training never sees: other skeletons, other class words
and other interface words.
"""

from __future__ import annotations

import random

SYLLABLES = "an be co do er fa gi ho in ka lo mu ne on pa re si ti um ver wa zo".split()
#: Class words by kind of part, the frequent ones first: those of training, and those held out.
NAMES = {
    "menu": ("nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager toc", "topnav mainmenu crumbs flyout"),
    "top": ("header masthead banner topbar logo brand", "hero sitehead"),
    "bottom": ("footer foot copyright colophon legal bottom", "imprint baseline"),
    "side": ("sidebar aside side rail widget related recommended trending popular more", "flank teaser"),
    "notice": ("notice cookie cookies consent alert gdpr popup modal overlay toast", "privacy dialogue"),
    "advert": ("ad ads advert adverts advertisement sponsor sponsored promo promotion", "dfp outbrain"),
    "form": ("form newsletter subscribe signup login search contact", "enroll mailing"),
    "talk": ("comment comments reply replies discussion disqus respond thread reviews feedback responses opinions guestbook", "remarks talkback"),
    "share": ("share sharing social tools tags byline meta", "spread follow"),
    "body": ("article content post entry story main text body prose", "longread copy"),
}
#: What such parts say, in their first or only words.
SAYS = {
    "menu": ("home news sport about contact products services blog sitemap", "start archive team"),
    "top": ("welcome", "hello"),
    "bottom": ("copyright terms privacy imprint contact", "disclaimer"),
    "side": ("related popular latest more trending recommended", "also"),
    "notice": ("we use cookies to improve accept all this site uses", "your privacy matters"),
    "advert": ("advertisement sponsored buy now offer sale ad", "deal today"),
    "form": ("subscribe sign up email name send search password login your", "join enter"),
    "talk": ("comments reply says wrote posted replies report", "answer"),
    "share": ("share tweet print email facebook follow posted by", "pin save"),
}
SKELETONS = ("article", "article", "article", "main", "main article", "div", "div", "div", "section", "bare", "nested")
HELD_SKELETONS = ("table", "twice", "flat")


def _page(rng: random.Random, held_out: bool) -> tuple[str, list[int]]:
    out: list[str] = []
    labels: list[int] = []
    # names: telling elements and classes; telling classes on divs; classes without meaning; nothing at all
    naming = rng.choice(["elements", "elements", "elements", "classes", "classes", "meaningless", "meaningless", "none"])
    skeleton = rng.choice(HELD_SKELETONS if held_out else SKELETONS)
    if naming == "elements" and skeleton in ("div", "section", "bare", "nested", "table", "twice", "flat") and rng.random() < 0.5:
        naming = "classes"
    told = naming in ("elements", "classes") and (skeleton in ("article", "main", "main article") or naming == "classes")
    coded: dict[str, str] = {}

    def word() -> str:
        return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))

    def words(low: int, high: int, end: str = "") -> str:
        """Some words; in running text now and then with a sentence's end between them."""
        n, parts = rng.randint(low, max(low, high)), []
        for k in range(n):
            w = word()
            if k and parts[-1][-1] == ".":
                w = w.capitalize()
            parts.append(w + ("." if end and 2 < k < n - 2 and rng.random() < 0.1 else "," if rng.random() < 0.04 and k < n - 1 else ""))
        text = " ".join(parts)
        return text[:1].upper() + text[1:] + end

    def add(markup: str, *own: int) -> None:
        out.append(markup)
        labels.extend(own)

    def mark(kind: str) -> str:
        """A class or id attribute for a part, or none."""
        if naming == "none" or naming == "elements" and rng.random() < 0.3:
            return ""
        if naming == "meaningless":
            name = coded.setdefault(kind, rng.choice([f"{rng.choice('abcxyz')}{rng.randint(1, 99)}", word(), f"css-{word()}"]))
            return f' class="{name}"'
        names = NAMES[kind][held_out].split()
        name = rng.choices(names, [1 / (k + 1) for k in range(len(names))])[0]
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}-{word()}"', f' class="{name} {word()}"', f' class="{word()}-{name}"', f' class="{word()}{name.capitalize()}"'])

    def says(kind: str, low: int, high: int, end: str = "") -> str:
        text = words(low, high, end)
        if kind in SAYS and rng.random() < 0.5:
            own = rng.choice(SAYS[kind][held_out].split())
            text = own.capitalize() + " " + text[:1].lower() + text[1:] if high > 1 else own.capitalize()
        return text

    def element(name: str) -> str:
        return name if naming == "elements" else "div"

    def menu() -> None:
        k = rng.randint(2, 8)
        tag = rng.choice([element("nav"), element("nav"), "ul", "div"])
        items = [f'<a href="/{word()}">{says("menu", 1, 3)}</a>' for _ in range(k)]
        own = "" if tag == "nav" and rng.random() < 0.5 else mark("menu")
        if tag != "ul" and rng.random() < 0.2:  # links in a row are one block
            add(f"<{tag}{own}>{' '.join(items)}</{tag}>", 0)
            return
        listed = "".join(f"<li>{x}</li>" for x in items)
        add(f"<ul{own}>{listed}</ul>" if tag == "ul" else f"<{tag}{own}><ul>{listed}</ul></{tag}>", *[0] * k)

    def plain(tag: str, kind: str, low: int, high: int, count: int = 1, titled: float = 0.0) -> None:
        own = "" if tag not in ("div", "section") and rng.random() < 0.5 else mark(kind)
        inside = rng.choice(["", "p", "p", "div"])
        add(f"<{tag}{own}>")
        if rng.random() < titled:
            add(f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{says(kind, 1, 3)}</{h}>", 0)
        for _ in range(count):
            text = says(kind, low, high, rng.choice([".", ".", "", "!"]))
            if rng.random() < 0.25:
                text = f'<a href="#">{text}</a>'
            add(f"<{inside or 'div'}>{text}</{inside or 'div'}>" if inside or count > 1 or titled else text, 0)
        add(f"</{tag}>")

    def links() -> None:
        """A box of links to other pages."""
        k = rng.randint(2, 6)
        tag = rng.choice([element("aside"), "div"])
        add(f"<{tag}{mark('side')}><h3>{says('side', 1, 3)}</h3><ul>" + "".join(f'<li><a href="/{word()}">{words(3, 9)}</a></li>' for _ in range(k)) + f"</ul></{tag}>", *[0] * (k + 1))

    def talk(most: int) -> None:
        """Reader comments: who and when, then what, at most `most` words each."""
        tag = rng.choice([element("section"), "div", "ol"])
        kind = "li" if tag == "ol" else "div"
        add(f"<{tag}{mark('talk')}><h3>{says('talk', 1, 2)}</h3>", 0)
        for _ in range(rng.randint(1, 4)):
            by = f'<div{mark("share")}><a href="/u/{word()}">{word().capitalize()}</a> {rng.randint(1, 28)}.{rng.randint(1, 12)}.20{rng.randint(10, 24)}</div>' if rng.random() < 0.6 else ""
            add(f"<{kind}>{by}<p>{words(3, most, rng.choice(['.', '!', '?']))}</p></{kind}>", *[0] * (1 + bool(by)))
        add(f"</{tag}>")

    def asked() -> None:
        """A form with its controls."""
        fields = rng.randint(0, 2)
        add(f"<form{rng.choice(['', mark('form')])}>")
        if rng.random() < 0.7:
            add(f"<p>{says('form', 2, 20)}</p>", 0)
        for _ in range(fields):
            add(f"<div><label>{says('form', 1, 2)}</label> <input name=\"q\"></div>", 0)
        if rng.random() < 0.3:
            add(f"<select><option>{word()}<option>{word()}</select>", 0, 0)
        add(f"<button>{says('form', 1, 2)}</button></form>", 0)

    few = 60 if told else 25  # without names, what stands around an article is shorter than its prose

    def outside() -> None:
        kind = rng.randrange(9)
        if kind == 0:
            menu()
        elif kind == 1:
            plain(element("aside"), "side", 3, min(few, 40), rng.randint(1, 3 if told else 2), 0.3)
        elif kind == 2:
            links()
        elif kind == 3:
            plain(rng.choice(["div", "section"]), "notice", 5, min(few, 40))
        elif kind == 4:
            plain("div", "advert", 2, 30 if told else 15)
        elif kind == 5:
            asked()
        elif kind == 6:
            plain("div", "share", 1, 10)
        elif kind == 7:
            plain("div", "form", 3, 20)
        else:
            talk(few)

    def article(inner: bool) -> None:
        """The article's own blocks, with strange ones between where they are told by name."""
        if rng.random() < 0.15:
            add(f"<header><h1>{words(2, 9)}</h1></header>", 1)
        elif rng.random() < 0.9:
            add(f"<h1>{words(1, 9)}</h1>", 1)
        as_div = rng.random() < 0.12
        for k in range(rng.randint(1, 14) if told else rng.randint(4, 14)):
            longest = rng.choice([4, 20, 120]) if told else rng.choice([20, 60, 120])
            text = words(1 if told and rng.random() < 0.3 else min(longest, 8), longest, rng.choice([".", ".", ".", "!", ""]) if told else ".")
            if told and rng.random() < 0.04:
                text = " | ".join(text.split(" "))
            kind = rng.random()
            if as_div:
                add(f"<div>{text}</div>", 1)
            elif kind < 0.1:
                add(f"<p><b>{text}<br>", 1)
            elif kind < 0.72:
                add(f"<p>{text}</p>", 1)
            elif kind < 0.78:
                add(f'<p>{text} <a href="/{word()}">{words(1, 4)}</a> {word()}.</p>', 1)
            elif kind < 0.83:
                add(f"<h2>{words(1, 6)}</h2><p>{words(8, 60, '.')}</p>", 1, 1)
            elif kind < 0.87:
                items = rng.randint(2, 4)
                add("<ul>" + "".join(f"<li>{words(1 if told else 4, 15, rng.choice(['', '.']))}" for _ in range(items)) + "</ul>", *[1] * items)
            elif kind < 0.89:
                add(f"<blockquote><p>{text}</p></blockquote>", 1)
            elif kind < 0.91:
                add(f"<pre>{text}</pre>", 1)
            elif kind < 0.93 and told:
                add(f"<table><tr><td>{words(1, 4)}<td>{words(1, 4)}</table>", 1, 1)
            elif kind < 0.95:
                add(f'<figure><img src="/{word()}.jpg" alt="{word()}"><figcaption>{words(3, 14, ".")}</figcaption></figure>', 1)
            elif inner and told:
                outside()
            else:
                add(f"<p>{text}</p>", 1)

    if rng.random() < 0.05:  # a fragment: nothing but text
        if rng.random() < 0.4:
            add(words(6, 120, "."), 1)
        else:
            article(False)
        return "".join(out), labels
    add(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{words(2, 8)}</title>', 0)
    add("<style>p{margin:0}</style><script>var t=\"</p>\";</script></head><body>")
    cells = skeleton == "table"
    if skeleton in ("nested", "twice", "flat") or naming != "elements" and rng.random() < 0.4:
        add(f"<div{mark('body') if naming == 'meaningless' else ''}>")
        wrapped = True
    else:
        wrapped = False
    if rng.random() < 0.4:
        plain(element("header"), "top", 1, 8, rng.randint(1, 2))
    if rng.random() < 0.8:
        menu()
    if cells:
        add("<table><tr><td>")
    for _ in range(rng.randint(0, 3)):
        outside()
    add("<!-- note -->")
    if cells:
        add("<td>")
    open_tags = {
        "article": ["article"], "main": ["main"], "main article": ["main", "article"], "div": ["div" + mark("body")], "section": ["section" + mark("body")],
        "bare": [], "nested": ["div" + mark("body"), "div", "div" + mark("body")], "table": [], "twice": ["section" + mark("body"), "div" + mark("body")], "flat": ["div" + mark("body"), "span"],
    }[skeleton]
    for tag in open_tags:
        add(f"<{tag}>")
    article(bool(open_tags))
    if told and open_tags and rng.random() < 0.2:
        talk(few)
    for tag in reversed(open_tags):
        add(f"</{tag.split(' ')[0]}>")
    if rng.random() < 0.25:
        talk(few)
    if cells:
        add("<td>")
    for _ in range(rng.randint(0, 2)):
        outside()
    if cells:
        add("</table>")
    if rng.random() < 0.9:
        tag = element("footer")
        if not open_tags and rng.random() < 0.5:
            tag = "p"
        if rng.random() < 0.5 or tag == "p":
            add(f"<{tag}{mark('bottom') if tag != 'p' else ''}>{rng.choice(['&copy; ', '© ', '' if tag != 'p' else '© '])}{word()}.example {rng.choice(['', '&middot; '])}{words(2, 14, rng.choice(['.', '']))}</{tag}>", 0)
        else:
            plain(tag, "bottom", 2, 20, rng.randint(1, 2))
    if wrapped:
        add("</div>")
    return "".join(out) + "</body></html>", labels


def labelled_pages(n: int = 900, seed: int = 7, held_out: bool = False) -> list[tuple[str, list[int]]]:
    """Invented pages and the label of each of their leaf blocks, in order."""
    rng = random.Random(seed)
    return [_page(rng, held_out) for _ in range(n)]
