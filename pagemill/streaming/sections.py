"""Sections of Markdown documents that arrive in pieces, as soon as they are finished: the same that ``corpus.sections`` finds."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_SPACE = " \t\n\x0b\f\r"
_ENDS = "\r\x85\u2028\u2029"
_HEADING = re.compile(rf"(#{{1,6}}) ([^\n{_ENDS}]+)")
_RULE = re.compile(rf"(-{{3,}}|\*{{3,}}|_{{3,}})[{_ENDS}]?\Z")


@dataclass
class Reader:
    """What must be known of a document's lines so far, its unfinished section, and the last finished one, which waits to be told whether it is the document's last."""

    tail: str = ""
    due: int = 0
    last: int = -1
    waiting: dict[str, str] = field(default_factory=dict)
    begun: bool = False
    line: int = 0
    fences: int = 0
    rules: int = 0
    fronted: bool = False
    seen: list[int] = field(default_factory=lambda: [0] * 7)
    headers: dict[str, str] = field(default_factory=dict)
    lines: list[str] = field(default_factory=list)
    code: str | None = None
    before: int = 0
    nth: int = 0
    ready: dict | None = None

    def read(self, line: str, levels: list[int]) -> Iterator[dict]:
        """Takes the next line; gives the section before the last finished one."""
        fence = line.startswith("```")
        self.fences += fence
        dashes = line.strip(" ") == "---"
        self.rules += dashes
        self.fronted |= dashes and self.line == 0
        free = not fence and self.fences % 2 == 0 and not (self.fronted and dashes and self.rules <= 2)
        heading = _HEADING.match(line) if free else None
        level = len(heading[1]) if heading else 0
        self.seen[level] += level > 0
        again = level in levels and self.seen[level] > 1
        if again or (free and not level and _RULE.match(line.strip(" "))):
            yield from self.finish()
        if again:
            self.headers = {h: t for h, t in self.headers.items() if int(h[1]) <= level}
        if level:
            self.headers[f"h{level}"] = re.sub("[*_`]", "", heading[2]).strip(" ")
        if fence and self.fences % 2 == 1 and self.code is None:
            self.code = line[3:].strip(" ") or None
        self.lines.append(line)
        self.line += 1

    def finish(self) -> Iterator[dict]:
        """Ends the section."""
        content = "\n".join(self.lines).rstrip(_SPACE)
        if content:
            if self.ready:
                yield self.ready
            self.nth += 1
            n = len(self.lines)
            headers = dict(sorted(self.headers.items()))
            self.ready = {"nth": self.nth, "content": content, "headers": headers, "code": self.code, "loc_from": self.before + 1, "loc_to": self.before + 1 + n}
            self.before += n
        self.lines, self.code = [], None

    def take(self, piece: str, ends: bool, levels: list[int]) -> Iterator[dict]:
        """Takes more of the text."""
        self.tail += piece
        if not self.begun:
            self.tail = self.tail.lstrip(_SPACE)
            self.begun = bool(self.tail)
        if self.begun or ends:
            *whole, self.tail = self.tail.split("\n")
            for line in [*whole, self.tail] if ends else whole:
                yield from self.read(line, levels)
        if ends:
            yield from self.finish()
            if self.ready:
                yield self.ready | {"loc_to": self.ready["loc_to"] - 1}


def _split(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, levels: list[int]) -> Iterator[pd.DataFrame]:
    reader = Reader(**json.loads(state.get[0])) if state.exists else Reader()
    for pdf in batches:
        for seq, chunk, end in zip(pdf["seq"], pdf["chunk"], pdf["is_last"], strict=True):
            if int(seq) >= reader.due:
                reader.waiting[str(int(seq))] = "" if chunk is None else chunk
            reader.last = int(seq) if end else reader.last
    out: list[dict] = []
    while str(reader.due) in reader.waiting:
        out += reader.take(reader.waiting.pop(str(reader.due)), reader.due == reader.last, levels)
        reader.due += 1
    if reader.last < 0 or reader.due <= reader.last:
        state.update((json.dumps(asdict(reader)),))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out).assign(key=key[0])[["key", "nth", "content", "headers", "code", "loc_from", "loc_to"]]


def sections(stream: DataFrame, levels: tuple[int, ...] = (2, 3, 4, 5, 6)) -> DataFrame:
    """key, nth, content, headers, code, loc_from and loc_to of the sections of a stream of pieces (key, seq, chunk, is_last).

    A section leaves when the next one is finished, or its document is; so the state of a document is two sections, and pieces
    that came too early. Pieces may come in any order, and again until their document ends.
    """
    out = "key bigint, nth int, content string, headers map<string,string>, code string, loc_from int, loc_to int"
    return stream.groupBy("key").applyInPandasWithState(lambda k, b, s: _split(k, b, s, list(levels)), out, "reader string", "append", GroupStateTimeout.NoTimeout)
