r"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Every block element and every run of text between block boundaries is a node with the label content or not. A
parent-child potential (by the child's kind of tag) ties a node to its parent, and a node potential weighs the words
of its class, id and role, or a text run's length, links and punctuation. One pass of messages up the tree and one
down give each node's exact marginal (sum-product); text runs of at least one half are the main text. Both kinds of
potentials are counted from labelled pages: HTML whose elements carry ``data-content="yes"`` or ``"no"`` for
themselves and what they hold. ``labelled_pages`` makes such pages from templates.

Defined results: null and empty html, and pages without content, give an empty text. Character references are
decoded, white space inside a block becomes one space, blocks are joined by an empty line in page order; nothing else
is dropped or capped. Unclosed elements end where their parent ends or the next block of their kind begins.
"""

from __future__ import annotations

import html as htmllib
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 1200
SEED = 20
#: Log odds that the cues of one text run may come to.
MOST_TOLD = 3.0
#: Elements named for what is no main text: so many more of them within it count as none than are seen.
AGAINST, NOT_MAIN = 5, ("form", "nav", "header", "footer", "aside")
#: Log odds that the cues of all text runs of one list may come to.
MOST_LISTED = 2.0

# A quote counts behind an equals sign only; one that is never closed takes the rest of the page, as does a tag that is not.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=["']).*+|[^\s>"'][^\s>]*+)?+)*+"""
_TAG = re.compile(rf"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)({_REST})(>|\Z))", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "noscript", "iframe", "template", "title", "xmp", "noframes", "svg", "video", "audio", "canvas", "object")}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Words whose use in a short text may tell what its block is; what they tell is learned.
_TOLD = frozenset("comment comments reply replies responses related share follow subscribe newsletter advertisement sponsored cookies cookie tags menu search login popular trending recommended discussion".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_KINDS = {
    "article": "article", "main": "main", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form",
    "p": "p", "blockquote": "p", "pre": "p", "h1": "h1", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "menu": "list",
    "li": "item", "dt": "item", "dd": "item", "table": "table", "thead": "row", "tbody": "row", "tfoot": "row", "tr": "row", "td": "cell", "th": "cell", "caption": "cell",
    "div": "box", "section": "box", "center": "box", "figure": "figure", "figcaption": "figure", "details": "box", "summary": "h", "address": "footer", "body": "root", "html": "root",
    "dialog": "aside", "button": "form", "select": "form", "option": "form", "optgroup": "form", "label": "form", "legend": "form",
}
#: A new element ends open ones of these kinds, up to the nearest of the bounds.
_ENDS = {"p": ("p",), "item": ("item",), "row": ("row", "cell"), "cell": ("cell",)}
_BOUNDS = frozenset(("box", "article", "main", "nav", "aside", "header", "footer", "form", "list", "table", "root"))


@dataclass
class Page:
    """DOM nodes in document order: parents come before children."""

    parent: list[int] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    cues: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[bool] = field(default_factory=list)


def _run_cues(text: str, linked: int, within: str) -> list[str]:
    """What a run's form says; headings and items are short and open wherever they stand, so theirs says so apart."""
    place = f"{within}:" if within in ("item", "cell", "h1", "h") else ""
    n = len(text)
    share = linked / n
    lower = text.lower() if n < 400 else ""
    told = _TOLD.intersection(_WORD.findall(lower)) if n < 40 and text.count(" ") < 3 else ()
    return [
        f"{place}len{min(9, n.bit_length())}",
        "links0" if not linked else "links1" if share < 0.4 else "links2" if share < 0.9 else "links3",
        place + ("ends" if text[-1] in ".!?…:;\"'" else "open"),
        *(["mark"] if text[0] in "©|»›" or "©" in text or lower.startswith("copyright") or "all rights reserved" in lower else []),
        *(f"told:{w}" for w in sorted(told)),
    ]


def parse(source: str) -> Page:
    """The page's block elements and text runs. Scripts, styles and other raw elements have no nodes."""
    page = Page()
    parent, kind, cues, texts, labels = page.parent, page.kind, page.cues, page.text, page.label
    stack: list[tuple[str, int]] = []  # open block elements: tag, node
    run: list[str] = []
    linked = [0]
    in_link = 0
    seen: set[str] = set()

    def node(what: str, found: list[str], text: str | None, label: str) -> int:
        if not stack and what != "root":  # a page without body has one all the same
            stack.append(("body", node("root", [], None, "")))
        up = stack[-1][1] if stack else -1
        parent.append(up)
        kind.append(what)
        cues.append(found)
        texts.append(text)
        labels.append(label == "yes" if label else up >= 0 and labels[up])
        return len(parent) - 1

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            # a text that repeats on its page is no further evidence: its node goes with its parent
            node("text", [] if text in seen else _run_cues(text, min(linked[0], len(text)), kind[stack[-1][1]] if stack else "root"), text, "")
            seen.add(text)
        run.clear()
        linked[0] = 0

    def said(piece: str) -> None:
        if "&" in piece:
            piece = htmllib.unescape(piece)
        run.append(piece)
        if in_link:
            linked[0] += len(piece.strip())

    at, end = 0, len(source)
    search = _TAG.search
    while at < end:
        m = search(source, at)
        if not m:
            said(source[at:])
            break
        if m.start() > at:
            said(source[at : m.start()])
        at = m.end()
        slash, tag, rest = m[1], m[2], m[3]
        if not tag or not m[4]:
            continue  # a comment or declaration, or a tag that never ends
        tag = tag.lower()
        what = _KINDS.get(tag)
        if slash:
            if what:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif tag == "a":
                in_link = 0
            continue
        if tag in _RAW:
            close = _RAW[tag].search(source, at)
            at = close.start() if close else end
            continue
        if what:
            flush()
            for ended in _ENDS.get(what, ()):
                for i in range(len(stack) - 1, -1, -1):
                    k = kind[stack[i][1]]
                    if k == ended:
                        del stack[i:]
                        break
                    if k in _BOUNDS:
                        break
            if what not in ("p", "item", "row", "cell") and stack and kind[stack[-1][1]] == "p" and stack[-1][0] == "p":
                stack.pop()
            found, label = [], ""
            if rest:
                for a in _ATTR.finditer(rest):
                    name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if name in ("class", "id", "role", "itemprop"):
                        found += _WORD.findall(value.lower())
                    elif name == "data-content":
                        label = value
                    elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                        found.append("hidden")
            i = node(what, found, None, label)
            if not rest.endswith("/") or tag not in _VOID:
                stack.append((tag, i))
        elif tag == "br" or tag == "hr":
            run.append(" ")
            if tag == "hr":
                flush()
        elif tag == "a":
            in_link = 1
    flush()
    return page


def is_prose(text: str, cues: Sequence[str]) -> bool:
    """Whether a text run is a sentence or more, and not a link's."""
    return len(text) >= 40 and " " in text and text[-1] in ".!?…:;\"'" and not {"links2", "links3"}.intersection(cues)


def bounded(page: Page, told: Sequence[float]) -> list[float]:
    """Log odds of nodes by their cues, where a text run's come to ``MOST_TOLD`` at most, and those of all runs of a list to ``MOST_LISTED``.

    The runs of a list are alike, so each is no evidence of its own: they share one.
    """
    n = len(page.parent)
    listed = [-1] * n
    runs: Counter = Counter()
    for i in range(n):
        up = page.parent[i]
        listed[i] = i if page.kind[i] == "list" else listed[up] if up >= 0 else -1
        if page.kind[i] == "text" and listed[i] >= 0:
            runs[listed[i]] += 1

    def most(i: int) -> float:
        return MOST_LISTED / runs[listed[i]] if listed[i] >= 0 else MOST_TOLD

    return [max(-most(i), min(most(i), u)) if page.kind[i] == "text" else u for i, u in enumerate(told)]


@dataclass(frozen=True)
class TreeModel:
    """Log odds of content: ``edge`` by child kind and parent label, ``cue`` by cue."""

    edge: dict[str, tuple[float, float]]
    cue: dict[str, float]
    root: float

    def marginals(self, page: Page, body: bool = False) -> list[float]:
        """The probability of content of each node, by sum-product on the tree; with ``body``, given that the body and boxes without names are content.

        What text runs say of themselves is bounded (``bounded``), so that a few do not outweigh the tree.
        """
        n = len(page.parent)
        cue, edge = self.cue, self.edge
        up = [sum(cue.get(c, 0.0) for c in page.cues[i]) for i in range(n)]
        up = bounded(page, up)
        sent = [0.0] * n
        exp, log = math.exp, math.log
        chance = {k: (1 / (1 + exp(-a)), 1 / (1 + exp(-b))) for k, (a, b) in edge.items()}
        default = chance["box"]
        for i in range(n - 1, -1, -1):
            p0, p1 = chance.get(page.kind[i], default)
            up[i] = x = max(-30.0, min(30.0, up[i]))
            e = exp(x)
            sent[i] = log((1 - p1 + p1 * e) / (1 - p0 + p0 * e))
            if page.parent[i] >= 0:
                up[page.parent[i]] += sent[i]
        belief = up
        for i in range(n):
            p0, p1 = chance.get(page.kind[i], default)
            above = belief[page.parent[i]] - sent[i] if page.parent[i] >= 0 else self.root
            if body and (page.kind[i] == "root" or page.kind[i] == "box" and not page.cues[i]):
                belief[i] = 30.0
                continue
            e = exp(max(-30.0, min(30.0, above)))
            belief[i] = up[i] + log((p0 + p1 * e) / (1 - p0 + (1 - p1) * e))
        return [1 / (1 + exp(-max(-60.0, min(60.0, b)))) for b in belief]

    def main_text(self, source: str | None) -> str:
        """Text runs that are content, joined by empty lines."""
        if not source:
            return ""
        page = parse(source)
        found = self.chosen(page)
        if not found and any(t is not None and is_prose(t, c) for t, c in zip(page.text, page.cues, strict=True)):
            # no block stands out: the main text is what the body and boxes without names hold, but for what tells otherwise
            found = self.chosen(page, body=True)
        return "\n\n".join(found)

    def chosen(self, page: Page, body: bool = False) -> list[str]:
        return [t for t, m in zip(page.text, self.marginals(page, body), strict=True) if t is not None and m >= 0.5]


def train(pages: Iterable[str], smooth: float = 0.5) -> TreeModel:
    """Counts the potentials from labelled pages."""
    edges: dict[str, Counter] = defaultdict(Counter)
    cues: dict[bool, Counter] = {True: Counter(), False: Counter()}
    nodes: Counter = Counter()
    for source in pages:
        page = parse(source)
        for i, up in enumerate(page.parent):
            y = page.label[i]
            edges[page.kind[i]][up >= 0 and page.label[up], y] += 1
            group = "text" if page.kind[i] == "text" else "element"
            nodes[group, y] += 1
            cues[y].update(set(page.cues[i]))

    def odds(a: float, b: float) -> float:
        return math.log((a + smooth) / (b + smooth))

    edge = {k: (odds(c[False, True], c[False, False]), odds(c[True, True], c[True, False] + AGAINST * (k in NOT_MAIN))) for k, c in edges.items()}
    known = {}
    for c in cues[True].keys() | cues[False].keys():
        group = "text" if re.match(r"(\w+:)?(len\d|ends$|open$)|links\d|mark$|told:", c) else "element"
        known[c] = odds(cues[True][c], cues[False][c]) - odds(nodes[group, True], nodes[group, False])
    # words that head other blocks head parts of articles too: that they are there speaks for nothing
    known = {c: min(v, 0.0) if c.startswith("told:") else v for c, v in known.items()}
    return TreeModel(edge, known, -5.0)


# -- labelled pages -------------------------------------------------------------------------------------------------


def _words(rng: random.Random, low: int, high: int) -> list[str]:
    syllables = ("an", "ber", "co", "der", "en", "fi", "ga", "hin", "is", "jo", "ka", "lo", "mi", "no", "or", "pa", "qui", "re", "sa", "ti", "un", "ver", "wi", "za")
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]


def _sentence(rng: random.Random, low: int = 1, high: int = 18) -> str:
    return " ".join(_words(rng, low, high)).capitalize() + rng.choice("....!?")


def _prose(rng: random.Random) -> str:
    text = " ".join(_sentence(rng) for _ in range(rng.choice((1, 1, 2, 4, 7))))
    if rng.random() < 0.12:
        text = text.rstrip(".!?") + rng.choice(("", "***", " |", "$$$", ",", " &amp;"))
    if rng.random() < 0.15:
        text = re.sub(r" (\w+) ", r' <a href="/\1">\1</a> ', text, count=1)
    return text


def _links(rng: random.Random, low: int = 2, high: int = 8) -> str:
    return "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in _words(rng, low, high)) + "</ul>"


def _unknown(rng: random.Random) -> str:
    """An attribute that says nothing, or none: pages often have such."""
    name = f"{rng.choice('bcdgjkqvwxz')}{rng.randint(1, 99)}"
    return rng.choice(("", f' class="{name}"', f' id="{name}"'))


def _box(rng: random.Random, names: str, inner: str, tags: str = "div div section aside") -> str:
    tag, name = rng.choice(tags.split()), rng.choice(names.split())
    return f'<{tag} {rng.choice(("class", "class", "class", "id"))}="{name}" data-content="no">{inner}</{tag}>'


def _plain(rng: random.Random, n: int) -> str:
    return "".join(f"<p>{_prose(rng)}</p>" for _ in range(n))


def _said(rng: random.Random) -> str:
    """What a reader says, in one of many forms."""
    shape = rng.choice(('<div class="comment"><p>{}</p></div>', '<li class="comment"><b>ann</b> {}</li>', "<p>{}</p>", "<p><b>bob</b>: {}</p>", '<div class="reply">{}</div>', "<blockquote>{}</blockquote>", "<div>{}</div>"))
    return "".join(shape.format(_prose(rng)) for _ in range(rng.randint(1, 4)))


def _told(rng: random.Random, words: str) -> str:
    """A heading of a block, which says what the block is."""
    tag, text = rng.choice(("h2", "h3", "h4", "p", "div")), rng.choice(words.split())
    text = rng.choice((text.capitalize(), f"{rng.randint(1, 40)} {text}", f"{text.capitalize()} {_words(rng, 1, 1)[0]}"))
    return f"<{tag}>{text}</{tag}>"


def _rows_of_links(rng: random.Random) -> str:
    return rng.choice(" | , · ".split(" ")).join(f'<a href="/{w}">{" ".join(_words(rng, 1, 3))}</a>' for w in _words(rng, 2, 6))


def _advert(rng: random.Random) -> str:
    inner = rng.choice((_sentence(rng), _plain(rng, 1), f'<a href="/x">{_sentence(rng)}</a>'))
    return _box(rng, "ad ads advert advertisement banner-ad sponsored promo promotion sponsor ad-slot adbox", inner, "div div div aside section")


def _sidebar(rng: random.Random) -> str:
    inner = rng.choice((_links(rng), f"<h3>{_sentence(rng, 1, 3)}</h3>{_links(rng)}", _plain(rng, 1), f"<h2>{_sentence(rng, 1, 3)}</h2>{_plain(rng, 1)}"))
    return _box(rng, "sidebar side-bar side related related-posts widget widgets popular trending recommended more-stories toc", inner, "aside aside div section")


def _comments(rng: random.Random) -> str:
    head = f"<h2>{_sentence(rng, 1, 3)}</h2>" * rng.randint(0, 1)
    return _box(rng, "comments comment-list reader-comments discussion responses replies user-comments disqus_thread comment-thread respond", head + _said(rng), "section section div div aside ol")


def _notice(rng: random.Random) -> str:
    inner = rng.choice((_plain(rng, 1), _sentence(rng), f"{_sentence(rng)} <button>{_words(rng, 1, 2)[0]}</button>"))
    return _box(rng, "notice cookie-notice cookie cookies consent alert gdpr cookie-banner privacy-notice warning popup modal overlay newsletter subscribe paywall disclaimer", inner, "div div section aside")


def _form(rng: random.Random) -> str:
    name = rng.choice(("search", "signup", "login", "newsletter", "contact-form"))
    return f'<form data-content="no" class="{name}"><label>{_sentence(rng, 1, 3)}</label><input name="q"><select><option>{_words(rng, 1, 1)[0]}</option></select><button>{_words(rng, 1, 1)[0]}</button>{_plain(rng, rng.randint(0, 1))}</form>'


def _meta(rng: random.Random) -> str:
    return _box(rng, "share social social-links breadcrumb breadcrumbs tags pagination pager menu navbar nav-links author-bio byline meta post-meta", rng.choice((_links(rng), _rows_of_links(rng), _sentence(rng, 1, 4))), "div div ul section")


def _unnamed(rng: random.Random) -> str:
    """Boxes without a telling name: what they hold must tell."""
    inner = (
        _told(rng, "comments comment replies responses discussion") + _said(rng),
        _told(rng, "related popular trending recommended") + _links(rng),
        _told(rng, "share follow tags menu") + _rows_of_links(rng),
        _told(rng, "subscribe newsletter advertisement sponsored cookies") + _plain(rng, 1),
        _rows_of_links(rng),
        _links(rng, 3, 9),
    )
    tag = rng.choice(("div", "div", "section"))
    return f'<{tag}{_unknown(rng)} data-content="no">{rng.choice(inner)}</{tag}>'


def _unseen(rng: random.Random) -> str:
    """Boxes that the page hides."""
    how = rng.choice((" hidden", ' style="display:none"', ' style="color:red; visibility: hidden"', ' aria-hidden="true"'))
    tag = rng.choice(("div", "div", "section"))
    return f'<{tag}{_unknown(rng)}{how} data-content="no">{rng.choice((_prose(rng), _plain(rng, 2)))}</{tag}>'


def _by_role(rng: random.Random) -> str:
    role, inner = rng.choice((("navigation", _links(rng)), ("contentinfo", _prose(rng)), ("complementary", _plain(rng, 1)), ("banner", _sentence(rng, 1, 4)), ("search", _sentence(rng, 1, 3)), ("alert", _sentence(rng))))
    return f'<div role="{role}" data-content="no">{inner}</div>'


#: Kinds of blocks that are not main text, by name.
FAMILIES = {
    "nav": lambda rng: f'<nav data-content="no">{_links(rng)}</nav>',
    "advert": _advert,
    "sidebar": _sidebar,
    "comments": _comments,
    "notice": _notice,
    "form": _form,
    "meta": _meta,
    "aside": lambda rng: f'<aside data-content="no">{rng.choice((_plain(rng, 1), _links(rng), _sentence(rng)))}</aside>',
    "raw": lambda rng: rng.choice(("<script>var a='</p>';</script>", "<style>p{margin:0}</style>", "<noscript>turn it on</noscript>", "<svg><text>drawn</text></svg>", "<!-->", "<!-- a -- b --!>")),
    "unnamed": _unnamed,
    "unseen": _unseen,
    "role": _by_role,
}


def _boilerplate(rng: random.Random, families: Sequence[str]) -> str:
    """One block that is not main text, marked so."""
    return FAMILIES[rng.choice(families)](rng)


def _foot(rng: random.Random) -> str:
    mark = rng.choice(("&copy; ", "Copyright 2020 ", "Copyright ", "© "))
    said = rng.choice((f"{mark}{_prose(rng)}", f"<p>{mark}{_sentence(rng, 1, 4)}</p>", f"{_sentence(rng, 1, 5)} All rights reserved."))
    return rng.choice((
        f'<footer data-content="no">{rng.choice(("&copy; ", "", "<p>"))}{_prose(rng)}</footer>',
        f'<footer data-content="no">{rng.choice(("&copy; ", "", "<p>"))}{_prose(rng)}</footer>',
        _box(rng, "footer site-footer foot copyright", _prose(rng), "div"),
        f'<div{_unknown(rng)} data-content="no">{said}</div>',
    ))


def _heading(rng: random.Random) -> str:
    """A heading within an article; its words may be those that head other blocks."""
    level, text = rng.randint(2, 4), _sentence(rng, 1, 6)
    if rng.random() < 0.15:
        word = rng.choice(sorted(_TOLD))
        text = rng.choice((word.capitalize(), f"{word.capitalize()} {_words(rng, 1, 1)[0]}", f"{_words(rng, 1, 1)[0].capitalize()} {word}"))
    return f"<h{level}>{text}</h{level}>"


def _short(rng: random.Random) -> str:
    """A block of an article that says little."""
    few = " ".join(_words(rng, 1, 4))
    if rng.random() < 0.1:
        few = rng.choice(sorted(_TOLD)).capitalize() + rng.choice(("", ".", f" {few}"))
    link = f'<a href="/{_words(rng, 1, 1)[0]}">{few}</a>'
    return rng.choice((f"<p>{few}</p>", f"<p>{few}.</p>", f"<sub>{few}</sub>", f"<pre>{few}</pre>", f"<p>{link}</p>", f"<p>{few} {link}</p>", f"<code>{few}</code>"))


def _terms(rng: random.Random) -> str:
    return "<dl>" + "".join(f"<dt>{' '.join(_words(rng, 1, 3)).capitalize()}</dt><dd>{rng.choice((' '.join(_words(rng, 1, 4)), _prose(rng)))}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>"


def _references(rng: random.Random) -> str:
    """A list of links that belongs to an article."""
    tag = rng.choice(("ul", "ol"))
    return f"<{tag}>" + "".join(f'<li><a href="/{w}">{rng.choice((w, _sentence(rng, 1, 5)))}</a>{rng.choice(("", "", " " + _sentence(rng, 1, 5)))}</li>' for w in _words(rng, 1, 5)) + f"</{tag}>"


def _article(rng: random.Random, families: Sequence[str]) -> str:
    parts = [f"<h1>{_sentence(rng, 1, 9)}</h1>"] if rng.random() < 0.8 else []
    short = rng.random() < 0.08
    for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 12))):
        kind = rng.random()
        if short or kind < 0.06:
            parts.append(_short(rng))
        elif kind < 0.09:
            parts.append(_terms(rng))
        elif kind < 0.12:
            parts.append(_references(rng))
        elif kind < 0.66:
            parts.append(rng.choices(("<p>{}</p>", "<p><b>{}<br>", "<div>{}</div>", '<div class="para">{}</div>'), (85, 8, 5, 2))[0].format(_prose(rng)))
        elif kind < 0.76:
            parts.append(_heading(rng))
        elif kind < 0.84:
            long = rng.random() < 0.5
            parts.append("<ul>" + "".join(f"<li>{_prose(rng) if long else ' '.join(_words(rng, 1, 4)).capitalize()}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.89:
            parts.append(f"<blockquote>{rng.choice((_prose(rng), '<p>' + _prose(rng) + '</p>'))}</blockquote>")
        elif kind < 0.93:
            parts.append("<table><tr>" + "".join(f"<td>{_sentence(rng, 1, 5)}</td>" for _ in range(3)) + "</tr></table>")
        elif kind < 0.96:
            parts.append(f"<figure><img src=x><figcaption>{_sentence(rng)}</figcaption></figure>")
        else:
            parts.append(f"<pre>{_prose(rng)}</pre>")
    for _ in range(rng.choice((0, 0, 0, 1, 2))):
        parts.insert(rng.randint(0, len(parts)), _boilerplate(rng, families))
    inner = "".join(parts)
    if rng.random() < 0.2:
        inner = f'<div class="{rng.choice(("entry-content", "article-body", "post-content", "text", "body"))}">{inner}</div>'
    if rng.random() < 0.06:
        return f"<!--bare-->{inner}"
    if rng.random() < 0.02:
        # boxes within boxes, none with a name that tells
        for _ in range(rng.randint(1, 3)):
            inner = f"<div{_unknown(rng)}>{inner}</div>"
        return f"<!--bare-->{inner}"
    tag = rng.choice(("article", "article", "article", "main", "div", "section"))
    name = rng.choice(("content", "main-content", "article", "post", "entry", "story", "article-body", "post-content", "main"))
    attr = f' {rng.choice(("class", "id"))}="{name}"' if rng.random() < (0.8 if tag in ("div", "section") else 0.3) else rng.choice((_unknown(rng), ' role="main"' if tag == "div" else ""))
    whole = f'<{tag}{attr} data-content="yes">{inner}</{tag}>'
    return f'<{rng.choice(("div", "main"))} class="{rng.choice(("wrapper", "container", "page", "layout", "row"))}">{whole}{_boilerplate(rng, families) if rng.random() < 0.5 else ""}</div>' if rng.random() < 0.3 else whole


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED, families: Sequence[str] = tuple(FAMILIES)) -> list[str]:
    """Pages whose elements say by ``data-content`` whether they hold main text; ``families`` are the kinds of other blocks."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        top = [f'<header data-content="no">{rng.choice((_sentence(rng, 1, 4), "<h1>" + _sentence(rng, 1, 3) + "</h1>", _links(rng)))}</header>'] if rng.random() < 0.5 else []
        top += [_boilerplate(rng, families) for _ in range(rng.randint(0, 3))]
        bottom = [_boilerplate(rng, families) for _ in range(rng.randint(0, 3))]
        article = _article(rng, families)
        label = "yes" if article.startswith("<!--bare-->") else "no"  # the body itself holds the text
        body = "".join([*top, article, *bottom, _foot(rng) if rng.random() < 0.9 else ""])
        page = f'<head><title>{_sentence(rng, 1, 5)}</title><style>p{{}}</style></head><body data-content="{label}">{body}</body>'
        out.append(f'<!DOCTYPE html><html data-content="no">{page}</html>')
    return out


def main_text(model: TreeModel, column: str = "html") -> Column:
    """Column of main texts of a column of pages."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([model.main_text(p) for p in pages], dtype=object)

    return extract(column)


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    model = model or train(labelled_pages())
    rows = pages.select("page_id", "url", main_text(model).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
