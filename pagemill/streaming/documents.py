"""Documents that arrive in pieces: state per document until its last piece, then one whole row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.operators import markup, tree


def _gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int | None, empty: str | bytes) -> Iterator[pd.DataFrame]:
    pieces, numbers, last = state.get if state.exists else ([], [], -1)
    if state.hasTimedOut:
        state.remove()
        return
    got = dict(zip(numbers, pieces, strict=True))
    for pdf in batches:
        for seq, chunk, end in zip(pdf["seq"], pdf["chunk"], pdf["is_last"], strict=True):
            got[int(seq)] = empty if chunk is None else chunk
            last = int(seq) if end else last
    if last >= 0 and len(got) == last + 1:
        if state.exists:
            state.remove()
        yield pd.DataFrame({"key": [key[0]], "html": [empty.join(got[i] for i in range(last + 1))]})
    else:
        state.update((list(got.values()), list(got), last))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)


def _assembled(stream: DataFrame, ttl_ms: int | None, kind: str, empty: str | bytes) -> DataFrame:
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    state = f"pieces array<{kind}>, numbers array<int>, last int"
    return stream.groupBy("key").applyInPandasWithState(lambda k, b, s: _gather(k, b, s, ttl_ms, empty), f"key bigint, html {kind}", state, "append", timeout)


def assemble(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """key and html of each finished document of a stream (key, seq, chunk, is_last).

    Pieces may come in any order and again; a document is out once all up to its last are there. A null piece is an empty
    one. With ``ttl_ms``, unfinished ones are forgotten so long after their latest piece; a query that is to end by itself
    (availableNow) needs it unset, as time-outs always ask for one more batch.
    """
    return _assembled(stream, ttl_ms, "string", "")


def assemble_bytes(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """key, html and valid of each finished document whose pieces are bytes, cut anywhere, within characters too.

    Documents that are not valid UTF-8 come with html null and valid false.
    """
    valid = F.is_valid_utf8("html")
    return _assembled(stream, ttl_ms, "binary", b"").select("key", F.when(valid, F.decode("html", "UTF-8")).alias("html"), valid.alias("valid"))


#: Elements within which a document may be cut: they mark nothing themselves.
CONTAINERS = frozenset(("html", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "center"))
#: Blocks that an empty line follows.
_PARTED = frozenset(("p", "ul", "ol", "table", "pre", "blockquote", "hr", "div", "section", "article", "main", "nav", "aside", *markup.HEADINGS))
_TOKEN = re.compile(markup.TOKEN.replace(r"\z", r"\Z"))
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")


def finished(tail: str, containers: list[str]) -> tuple[int, list[str]]:
    """How much of a document's tail will not change with what follows, and the containers that are open there.

    ``containers`` are those open where the tail begins. What is finished ends behind a block that an empty line follows, where
    nothing but containers is open, and before anything but a line break.
    """
    page, cut, opened = tree._Nest(), 0, containers
    for tag in containers:
        page.start(0, tag)
    at = 0
    ended = None
    for m in _TOKEN.finditer(tail):
        token = m[0]
        name = _NAME.match(token)
        tag = name[1].lower() if name else ""
        whole = token.endswith(">") and (tag not in (*markup.RAW, *markup.PLAIN) or token.startswith("</"))
        if m.end() == len(tail) and not whole:
            break
        if ended is not None and tag != "br":
            cut, opened = ended
        ended = None
        at = m.end()
        if not tag or tag in markup.RAW:
            continue
        if token.startswith("</"):
            if page.count[tag]:
                page.close(page.depth_of(frozenset((tag,)), frozenset()), 0)
        elif tag in markup.PLAIN:
            page.opens(tag)
            page.start(0, tag)
        elif page.opens(tag) and tag not in markup.VOID:
            page.start(0, tag)
            if token.endswith("/>"):
                page.close(1)
        if tag in _PARTED and (token.startswith("</") or tag == "hr") and all(t in CONTAINERS for t, _, _ in page.stack):
            ended = (at, [t for t, _, _ in page.stack])
    return cut, opened


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tail, containers, due, last, nth, numbers, chunks = state.get if state.exists else ("", "", 0, -1, 0, [], [])
    waiting = dict(zip(numbers, chunks, strict=True))
    for pdf in batches:
        for seq, chunk, end in zip(pdf["seq"], pdf["chunk"], pdf["is_last"], strict=True):
            if int(seq) >= due:
                waiting[int(seq)] = "" if chunk is None else chunk
            last = int(seq) if end else last
    while due in waiting:
        tail += waiting.pop(due)
        due += 1
    open_ = containers.split()
    done = last >= 0 and due > last
    cut, opened = (len(tail), []) if done else finished(tail, open_)
    if not done:
        state.update((tail[cut:], " ".join(opened), due, last, nth + (cut > 0), list(waiting), list(waiting.values())))
    elif state.exists:
        state.remove()
    if cut:
        yield pd.DataFrame({"key": [key[0]], "nth": [nth], "html": ["".join(f"<{t}>" for t in open_) + tail[:cut]], "is_last": [done]})


def fragments(stream: DataFrame) -> DataFrame:
    """key, nth, html and is_last: the finished parts of the documents of a stream (key, seq, chunk, is_last), as soon as they are.

    A part begins with the containers that are open, so each is a page of its own; what they convert to, joined by empty
    lines, is what the whole document converts to. The state of a document is its last block, as far as it has come, and pieces that came too early. Pieces may come in any order, and again until their document ends, when
    its state goes.
    """
    state = "tail string, containers string, due int, last int, nth int, numbers array<int>, chunks array<string>"
    return stream.groupBy("key").applyInPandasWithState(_advance, "key bigint, nth int, html string, is_last boolean", state, "append", GroupStateTimeout.NoTimeout)
