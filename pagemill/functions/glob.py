"""Address patterns: globs compiled on the driver to regular expressions that Catalyst evaluates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import url as U


def to_regex(glob: str) -> str:
    """A regular expression for a glob: ``*`` within a segment, ``**`` across segments, ``?``, ``[..]`` and ``{a,b}``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("/**", i) and (i + 3 == len(glob) or glob[i + 3] in "/,}"):
            out += "(?:/.*)?"
            i += 3
            continue
        if glob.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
            continue
        if glob.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out += "[" + glob[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def _target(url: Column) -> Column:
    return F.concat(U.path_of(url), F.regexp_extract(url, r"^[^?#]*([?#].*)$", 1))


def parse_pattern(pattern: str) -> tuple[str, str, bool]:
    """Base address, path pattern, and whether it is a glob."""
    full = pattern if "://" in pattern else f"https://{pattern}"
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*://[^/*?\[{]*)(.*)$", full)
    base, rest = (m[1], m[2]) if m else (full, "")
    is_glob = bool(re.search(r"[*?\[{]", rest))
    return base.lower(), rest or "/", is_glob


def starting_url(pattern: str) -> str:
    """Where a crawl of the pattern starts: the last whole directory before the first wildcard."""
    base, path, is_glob = parse_pattern(pattern)
    if not is_glob:
        return base + (path if path != "/" else "")
    before = path[: re.search(r"[*?\[{]", path).start()]
    return base + (before[: before.rfind("/") + 1] or "/")


def matches(url: Column, pattern: str, suffixes: Sequence[str] = ()) -> Column:
    """Whether an address is of the pattern's host and matches its path.

    With a list of public ``suffixes``, all hosts of the pattern's registrable domain count as its host.
    """
    base, path, is_glob = parse_pattern(pattern)
    if not is_glob:
        return F.lit(True)
    if path.endswith("*") and not path.endswith(("**", "/*")):
        path = f"{{{path[:-1]},{path[:-1]}/**}}"
    same = U.origin_of(url) == base
    if suffixes:
        same |= registrable_domain(U.host_of(url), suffixes) == registrable_domain(U.host_of(F.lit(base)), suffixes)
    return same & _target(url).rlike(to_regex(path))


def excluded(url: Column, patterns: Sequence[str]) -> Column:
    """Whether any exclusion matches: whole addresses, rooted paths, or bare patterns with or without leading slash."""

    def one(p: str) -> Column:
        if "://" in p:
            return matches(url, p) if parse_pattern(p)[2] else url == p
        if p.startswith("/"):
            return _target(url).rlike(to_regex(p[:-2] + "/**" if p.endswith("/*") else p))
        return _target(url).rlike(to_regex(p)) | F.substr(_target(url), F.lit(2)).rlike(to_regex(p))

    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(False))


def wanted(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    """Whether a crawl or a sitemap may give an address: none of ``exclude`` matches, and any of ``include`` if there are any."""
    taken = reduce(lambda a, b: a | b, [matches(url, p, suffixes) for p in include], F.lit(not include))
    return taken & ~excluded(url, exclude)


def registrable_domain(host: Column, suffixes: Sequence[str]) -> Column:
    """The label before the longest public suffix, with it. ``suffixes`` is the list to use; one label if none matches."""
    known = "|".join(re.escape(s) for s in sorted(suffixes, key=len, reverse=True))
    by_list = F.regexp_extract(F.lower(host), rf"([^.]+\.(?:{known}))$", 1)
    return F.when(by_list != "", by_list).otherwise(F.regexp_extract(F.lower(host), r"([^.]+\.[^.]+)$", 1))
