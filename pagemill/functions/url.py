"""URL functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key prefixes of tracking parameters that links lose when cleaned.
TRACKING_PREFIXES = ("utm_", "fbclid", "gclid", "mc_eid", "msclkid", "oly_")
# Parameters that a crawl ignores when it compares addresses.
IGNORED_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "msclkid", "twclid",
    "li_fat_id", "mc_cid", "mc_eid", "ref", "source", "sessionid", "session_id", "sid", "_ga", "_gl", "_hsenc", "_hsmi", "_openstat", "yclid", "ymclid", "spm", "scm",
)
# Paths that hold no content.
IGNORED_PATHS = ("/cdn-cgi/", "/_next/", "/_nuxt/", "/__", "/wp-admin/", "/wp-json/", "/wp-includes/", "/wp-content/uploads/", "/api/", "/assets/", "/static/")
PAGE_EXTENSIONS = r"(?i)\.(?:html?|php|aspx?|jsp)$"


def query_of(url: Column) -> Column:
    """The text between the first ``?`` and ``#``; empty if there is none."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_of(url: Column) -> Column:
    """The path, ``/`` if the address ends after its host."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def origin_of(url: Column) -> Column:
    """Scheme and host, lower-cased; empty for relative addresses."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def host_of(url: Column) -> Column:
    """The host without port, lower-cased; empty for relative addresses."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def strip_tracking(url: Column) -> Column:
    """Drops query parameters whose key begins like a tracking parameter; order and fragment stay."""
    keep = F.filter(F.split(query_of(url), "&"), lambda p: ~p.rlike("^(" + "|".join(TRACKING_PREFIXES) + ")"))
    query = F.array_join(keep, "&")
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    fragment = F.regexp_extract(url, r"^[^#]*(#.*)$", 1)
    cleaned = F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")), fragment)
    return F.when(url.rlike(r"^[^?#]*\?"), cleaned).otherwise(url)


def resolve(url: Column, origin: Column, clean: bool = False) -> Column:
    """An address made absolute against an origin: no base path, no dot segments beyond a leading ``./``."""
    at = F.rtrim(origin, F.lit("/"))
    out = (
        F.when((url == "") | url.startswith("#"), url)
        .when(url.startswith("//"), F.concat(F.lit("https:"), url))
        .when(url.rlike(r"^[0-9A-Za-z+.-]+:"), url)
        .when(F.coalesce(at, F.lit("")) == "", url)
        .when(url.startswith("/"), F.concat(at, url))
        .when(url.startswith("./"), F.concat(at, F.substr(url, F.lit(2))))
        .otherwise(F.concat(at, F.lit("/"), url))
    )
    return strip_tracking(out) if clean else out


def normalize(url: Column) -> Column:
    """An address for comparison: no fragment, no ignored parameters, the others by name, no slash at the end."""
    parts = F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*IGNORED_PARAMS))
    indexed = F.transform(parts, lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(indexed), lambda s: s["p"]), "&")
    base = F.concat(origin_of(url), path_of(url))
    return F.regexp_replace(F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))), "/$", "")


def is_autolink(url: Column) -> Column:
    return url.rlike(r"^(?i:https?|ftp|mailto):[^\s<>]*$")


def is_empty_link(href: Column) -> Column:
    """Links that lead nowhere: ``#`` and scripting or data schemes, however spaced."""
    bare = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]++|(?<![\x00-\x20])[\x00-\x20]++$", ""), r"[\t\r\n]", "")
    return (bare == "#") | bare.rlike(r"^(?i:javascript|data|vbscript):")


def is_safe(url: Column, link: bool = True) -> Column:
    """Whether safe HTML may carry the address: relative, http(s), and for links also mailto, tel and ftp."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]++|(?<![\x00-\x20])[\x00-\x20]++$", ""), r"[\t\r\n]", "")
    schemes = "https?|mailto|tel|ftp" if link else "https?"
    return ~bare.rlike(r"^[^/?#]*:") | bare.rlike(f"^(?i:{schemes}):")


def safe_filename(url: Column, host: bool = False) -> Column:
    """The path of a page's Markdown file: path segments with all but word characters and ``-`` replaced."""
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.regexp_replace(s, r"[^A-Za-z0-9_-]", "-"))
    if host:
        segments = F.concat(F.array(F.regexp_replace(F.regexp_extract(url, r"://([^/?#:]*)", 1), r"[^A-Za-z0-9_-]", "-")), segments)
        segments = F.when(F.size(F.filter(F.split(path_of(url), "/"), lambda s: s != "")) == 0, F.concat(segments, F.array(F.lit("index")))).otherwise(segments)
    name = F.array_join(segments, "/")
    return F.concat(F.when(name == "", F.lit("index")).otherwise(name), F.lit(".md"))


def file_to_url(path: Column) -> Column:
    """The address of a local HTML file: no ``.html``, no ``/index``, a leading slash."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), r"/index$", "")
    rooted = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.when(rooted.isin("/index", "/"), F.lit("/")).otherwise(rooted)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def group_prefix(path: Column, depth: int) -> Column:
    """The first segments of a path."""
    return F.concat(F.lit("/"), F.array_join(F.slice(segments(path), 1, depth), "/"))


def is_content(url: Column) -> Column:
    """Whether an address looks like a page: no ignored path, and a page's extension or none."""
    path = path_of(url)
    ignored = reduce(lambda a, b: a | b, [path.startswith(p) for p in IGNORED_PATHS])
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return ~ignored & (~last.contains(".") | last.rlike(PAGE_EXTENSIONS))


def is_markdown_route(path: Column) -> Column:
    """Whether a server may answer the route with Markdown."""
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    return ~(path.rlike(r"^/(api(/|$)|_|@)")) & (~last.contains(".") | last.endswith(".md"))
