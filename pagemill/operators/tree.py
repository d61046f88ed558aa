"""Which tag closes which: the element of every tag of a page, where tags are left out, crossed or repeated.

This needs a stack, which no window has: tags of a page go to Python in Arrow batches as one array of short marks, and come back
as numbers, in the order of a page whose elements all nest. Texts stay in the JVM.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose start ends an open p.
ENDS_P = frozenset((
    "div", "p", "ul", "ol", "dl", "li", "dd", "dt", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "header", "footer", "nav", "aside", "pre", "hr", "form",
    "fieldset", "figure", "figcaption", "address", "main", "center", "details", "summary", "dialog",
))
# For each kind of element that a start tag ends, what it ends and the elements beyond which it does not look.
SCOPES = {
    "p": (frozenset(("p",)), frozenset(("button", "td", "th", "caption", "table", "template", "html", "ul", "ol", "dl", "li"))),
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "table", "td", "th", "caption", "template", "html"))),
    "term": (frozenset(("dt", "dd")), frozenset(("dl", "ul", "ol", "li", "table", "td", "th", "caption", "template", "html"))),
    "cell": (frozenset(("td", "th")), frozenset(("tr", "thead", "tbody", "tfoot", "table", "caption", "template", "html"))),
    "a": (frozenset(("a",)), frozenset((
        "p", "div", "li", "ul", "ol", "dl", "dd", "dt", "table", "td", "th", "tr", "caption", "blockquote", "section", "article", "header", "footer", "nav", "aside", "main", "form", "fieldset",
        "figure", "button", "h1", "h2", "h3", "h4", "h5", "h6", "template", "html",
    ))),
    "caption": (frozenset(("caption",)), frozenset(("table", "template"))),
    "option": (frozenset(("option",)), frozenset(("select", "template"))),
    "optgroup": (frozenset(("optgroup",)), frozenset(("select", "template"))),
    "select": (frozenset(("select",)), frozenset(("template",))),
}
# What a new row and a new section of a table end, up to the table.
ROW, SECTION = frozenset(("td", "th", "tr")), frozenset(("td", "th", "tr", "thead", "tbody", "tfoot", "caption"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that a head holds; any other ends it.
IN_HEAD = frozenset(("title", "meta", "link", "base", "style", "script", "noscript", "template"))


class _Nest:
    """The open elements of one page, and its tags as they nest."""

    def __init__(self) -> None:
        self.of: list[int] = []  # the mark's number; of an end tag that is implied, -1 less its start tag's number
        self.element: list[int] = []  # place of the element's start tag
        self.parent: list[int] = []
        self.end: list[int] = []
        self.stack: list[tuple[str, int, int]] = []  # tag, place of its start, number of its mark
        self.count: Counter = Counter()

    def put(self, of: int, element: int | None = None) -> int:
        at = len(self.of)
        self.of.append(of)
        self.element.append(at if element is None else element)
        self.parent.append(self.stack[-1][1] if self.stack else -1)
        self.end.append(at)
        return at

    def start(self, of: int, tag: str) -> None:
        at = self.put(of)
        self.stack.append((tag, at, of))
        self.count[tag] += 1

    def close(self, n: int, of: int | None = None) -> None:
        """Ends the innermost n elements; the outermost of them by the mark ``of``, the others by implied end tags."""
        for left in range(n, 0, -1):
            tag, at, start = self.stack.pop()
            self.count[tag] -= 1
            self.end[at] = self.put(of if of is not None and left == 1 else -1 - start, at)

    def depth_of(self, target: frozenset, boundary: frozenset) -> int:
        """How many elements lie from the innermost of ``target`` up; 0 if there is none this side of the boundary."""
        for n, (tag, _, _) in enumerate(reversed(self.stack), 1):
            if tag in target:
                return n
            if tag in boundary:
                break
        return 0

    def close_scope(self, scope: str) -> bool:
        n = self.depth_of(*SCOPES[scope])
        self.close(n)
        return n > 0

    def close_in_table(self, target: frozenset) -> None:
        n = 0
        for i, (tag, _, _) in enumerate(reversed(self.stack), 1):
            if tag in target:
                n = i
            elif tag in ("table", "template", "caption"):
                break
        self.close(n)

    def opens(self, tag: str) -> bool:
        """Ends what the start tag implies to end; whether it begins an element itself."""
        count = self.count
        if count["head"] and not count["template"] and tag not in IN_HEAD:
            self.close(self.depth_of(frozenset(("head",)), frozenset()))
        if tag == "select" and count["select"] and self.close_scope("select"):
            return False
        if tag == "option":
            if count["select"]:
                self.close_scope("option")
            elif self.stack and self.stack[-1][0] == "option":
                self.close(1)
        elif tag == "optgroup" and count["select"]:
            self.close_scope("option")
            self.close_scope("optgroup")
        elif tag == "a" and count["a"]:
            self.close_scope("a")
        elif tag in SECTION and tag != "caption":
            if count["table"]:
                if count["caption"]:
                    self.close_scope("caption")
                if tag in ("td", "th"):
                    self.close_scope("cell")
                else:
                    self.close_in_table(ROW if tag == "tr" else SECTION)
        elif tag in ENDS_P:
            if count["p"]:
                self.close_scope("p")
            if tag in _HEADINGS and self.stack and self.stack[-1][0] in _HEADINGS:
                self.close(1)
            elif tag == "li" and count["li"]:
                self.close_scope("li")
            elif tag in ("dt", "dd") and (count["dt"] or count["dd"]):
                self.close_scope("term")
        return True


def nest(marks: list[str]) -> _Nest:
    """The tags of a page as they nest.

    A mark is a tag's name behind what it is: ``<`` start, ``/`` end, ``.`` without content, ``!`` ended at once; ``t`` is text
    and ``x`` nothing. An end tag ends the nearest open element of its name with all within it, not beyond a
    template; one without such an element goes. What a template holds goes.
    """
    page = _Nest()
    hidden: list[str] = []  # open templates and, within them, what their own end tags may end
    for i, mark in enumerate(marks):
        what, tag = mark[:1], mark[1:]
        if what == "x":
            continue
        if hidden:
            if what == "<" and tag == "template":
                hidden.append(tag)
            elif what == "/" and tag == "template":
                hidden.pop()
            continue
        if what == "t":
            page.put(i)
        elif what == "/":
            if page.count[tag]:
                page.close(page.depth_of(frozenset((tag,)), frozenset()), i)
        elif tag == "template":
            if what == "<":
                hidden.append(tag)
        elif what == ".":
            if page.opens(tag):
                page.put(i)
        elif page.opens(tag):
            page.start(i, tag)
            if what == "!":
                page.close(1)
    page.close(len(page.stack))
    return page


def _nested(marks: pa.Array) -> pa.Array:
    flat = marks.flatten().to_pylist()
    sizes = np.asarray(marks.value_lengths().fill_null(0))
    pages, at = [], 0
    for n in sizes:
        pages.append(nest(flat[at : at + n]))
        at += n
    offsets = np.cumsum([0, *[len(p.of) for p in pages]])
    columns = [pa.array(np.concatenate([np.array(getattr(p, c), dtype=np.int32) for p in pages] or [np.empty(0, dtype=np.int32)])) for c in ("of", "element", "parent", "end")]
    rows = pa.StructArray.from_arrays(columns, ["of", "el", "up", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def nested(marks: Column) -> Column:
    """For an array of marks (``nest``), an array of (of, el, up, end) of the tags and texts as they nest.

    ``of`` is the number of the mark, or for an implied end tag -1 less that of its start tag; ``el`` the place where the
    row's element starts, ``up`` its parent's (-1 for none), ``end`` the place where the element ends.
    """
    return F.arrow_udf(_nested, "array<struct<of: int, el: int, up: int, end: int>>")(marks)
