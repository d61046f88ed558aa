"""Links, page metadata and the crawl frontier."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import glob as G
from pagemill.functions import text as T
from pagemill.functions import url as U
from pagemill.operators import markup as M
from pagemill.operators import selectors as S
from pagemill.operators.progress import Progress


def links(pages: DataFrame, origin: Column | None = None, clean: bool = True) -> DataFrame:
    """page_id, pos (from 0), href, url and text of every link of a page's tree, in page order.

    What stands in comments, scripts and templates is no link; a link without an end tag ends where its parent does, or where
    the next one begins. ``origin`` may use page_id and url.
    """
    # page and address together are the key, so that rows which share an id stay apart and no join follows
    rows = M.tokens(pages.select(F.struct("page_id", "url").alias("page"), "html"), "page")
    found = S.extract(rows.where("kind = 'text' or tag = 'a'"), ["a[href]"]).withColumn("href", F.col("attributes")["href"]).where("href is not null")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1
    at = origin if origin is not None else U.origin_of(F.col("url"))
    told = found.select("key.page_id", "key.url", nth.alias("pos"), "href", F.col("text_content").alias("text"))
    return told.select("page_id", "pos", "href", U.resolve(F.col("href"), at, clean).alias("url"), "text")


def host_links(pages: DataFrame) -> DataFrame:
    """page_id and links: the absolute addresses on the page's own host, as written, fragments and tracking included.

    Each address once, in page order; ``metadata`` gives the other kind of list, normalized and of one origin.
    """
    found = links(pages, clean=False).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("found"))
    rows = pages.select("page_id", U.host_of(F.col("url")).alias("host")).join(found.withColumnRenamed("page_id", "of"), F.col("page_id").eqNullSafe(F.col("of")), "left")
    urls = F.array_distinct(F.transform(F.filter("found", lambda x: U.host_of(x["url"]) == F.col("host")), lambda x: x["url"]))
    return rows.select("page_id", F.coalesce(urls, F.array().cast("array<string>")).alias("links"))


def metadata(pages: DataFrame, domains: Sequence[str] = ()) -> DataFrame:
    """page_id, title, description, keywords, author and links of every page.

    The first non-empty value in page order counts; the title falls back to og:title, then to the address's path. Links
    are those of the page's origin, and of the hosts ``domains``.
    """
    rows = M.tokens(pages)
    p = M.in_page()
    rows = rows.withColumn("in_title", (F.lag("tag").over(p) == "title") & (F.lag("kind").over(p) == "open") & (F.col("kind") == "text"))
    name = F.lower(F.coalesce(M.attribute(F.col("token"), "name"), M.attribute(F.col("token"), "property")))
    rows = rows.withColumn("name", F.when(F.col("tag") == "meta", name)).withColumn("said", F.when(F.col("in_title"), F.trim(F.regexp_replace(T.decode_entities(F.col("token")), r"\s+", " "))).otherwise(F.trim(M.attribute(F.col("token"), "content"))))

    def first(test: Column) -> Column:
        return F.min(F.when(test & (F.col("said") != ""), F.struct("pos", "said")))["said"]

    href = F.when(M.is_open("a"), M.attribute(F.col("token"), "href"))
    facts = rows.groupBy("key").agg(
        F.coalesce(first(F.col("in_title")), first(F.col("name") == "og:title")).alias("title"),
        first(F.col("name").isin("description", "og:description")).alias("description"),
        first(F.col("name") == "keywords").alias("keywords"),
        first(F.col("name") == "author").alias("author"),
        F.array_sort(F.collect_list(F.when(href.isNotNull(), F.struct("pos", href.alias("href"))))).alias("hrefs"),
    )
    out = pages.select(F.col("page_id"), F.col("url")).join(facts, F.col("page_id") == F.col("key"), "left")
    urls = F.array_distinct(F.transform("hrefs", lambda h: U.normalize(U.resolve(h["href"], U.origin_of(F.col("url"))))))
    same = F.filter(urls, lambda u: u.startswith(U.origin_of(F.col("url"))) | U.host_of(u).isin(*domains))
    return out.select("page_id", F.coalesce("title", U.path_of(F.col("url"))).alias("title"), "description", "keywords", "author", F.coalesce(same, F.array().cast("array<string>")).alias("links"))


def first_by_url(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """The first page of each normalized address."""
    first = F.row_number().over(Window.partitionBy("norm").orderBy(order))
    return pages.withColumn("norm", U.normalize(F.col("url"))).withColumn("nth", first).where("nth = 1").drop("nth")


def capped_variants(urls: DataFrame, most: int = 5, order: str = "page_id") -> DataFrame:
    """At most so many addresses with a query for each path; those without one all stay."""
    path = F.concat(U.origin_of(F.col("url")), U.path_of(F.col("url")))
    rows = urls.withColumn("path", path).withColumn("with_query", F.col("url").contains("?"))
    nth = F.row_number().over(Window.partitionBy("path", "with_query").orderBy(order))
    return rows.withColumn("nth", nth).where(~F.col("with_query") | (F.col("nth") <= most)).drop("nth", "with_query", "path")


@dataclass(frozen=True)
class CrawlConfig:
    """What a crawl takes: how deep, how many pages in all and in one wave (in order of address), and which addresses.

    ``include`` and ``exclude`` are address patterns, ``domains`` hosts besides those of the seeds, ``variants`` how many
    addresses with a query a path may have in one wave. With public ``suffixes`` patterns cover subdomains.
    """

    max_depth: int = 3
    max_pages: int | None = None
    per_wave: int | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    variants: int = 5


def crawl_site(seeds: DataFrame, edges: DataFrame, config: CrawlConfig, progress: Progress | None = None) -> DataFrame:
    """url and depth of the addresses that a crawl with ``config`` takes from ``seeds`` (url) over ``edges`` (src, dst).

    Links to hosts other than those of the seeds and of ``domains`` go before the first wave, by a semi join. The edges
    are written once: every wave reads them, and filters on addresses would otherwise repeat what makes the addresses.
    ``progress`` counts the edges and the addresses of each wave; it needs a session with a folder for checkpoints.
    """
    edges = edges.select("src", "dst")
    edges = _written(progress.watch(edges, "edges", sources=F.approx_count_distinct("src")) if progress else edges)
    own = seeds.select(U.host_of(F.col("url")).alias("host")).distinct()
    if config.domains:
        own = own.unionByName(seeds.sparkSession.createDataFrame([(d.lower(),) for d in config.domains], "host string")).distinct()
    url = F.col("dst")
    taken = edges.where(U.is_content(url) & G.wanted(url, config.include, config.exclude, config.suffixes)).withColumn("host", U.host_of(url))
    taken = taken.join(own, "host", "left_semi").select("src", "dst")
    return crawl(seeds, taken, config.max_depth, lambda wave: capped_variants(wave, config.variants, "url"), config.max_pages, config.per_wave, progress)


def _written(rows: DataFrame) -> DataFrame:
    """The rows as a checkpoint, or persisted in sessions that have no folder for one."""
    spark = rows.sparkSession
    return rows.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() else rows.persist()


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int, keep=lambda df: df, max_pages: int | None = None, per_wave: int | None = None, progress: Progress | None = None) -> DataFrame:
    """url and depth of all addresses that links reach from the seeds within ``max_depth`` steps, breadth first.

    Each wave joins the frontier with the links and takes away what was seen; ``keep`` may filter a wave. Waves are
    written to checkpoints where the session has a folder for them. ``per_wave`` and ``max_pages`` (seeds included)
    take the first addresses of a wave in their order.
    """
    # every wave reads the links: what makes them runs once
    edges = _written(edges.select("src", "dst"))
    seen = seeds.select("url", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for step in range(1, max_depth + 1):
        found = frontier.select(F.col("url").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("url")).distinct()
        frontier = keep(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(step)))
        room = [per_wave] if per_wave is not None else []
        if max_pages is not None:
            room.append(max(max_pages - seen.count(), 0))
        if room:
            frontier = frontier.orderBy("url").limit(min(room))
        frontier = _written(progress.watch(frontier, f"wave {step}") if progress else frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def site_facts(pages: DataFrame, order: str = "page_id", name: str | None = None, description: str | None = None) -> DataFrame:
    """origin, name and description of every site. ``pages``: url, title, description and an order.

    The name is the given one, else the home page's title, else the host; the description the given one, else the home
    page's, else that of the site's first page.
    """
    home = (U.path_of(F.col("url")) == "/") & ~F.col("url").rlike("[?#]")
    # an empty value is none
    said = lambda c: F.when(F.col(c) != "", F.col(c))
    found = pages.select(order, U.origin_of(F.col("url")).alias("origin"), U.host_of(F.col("url")).alias("host"), home.alias("home"), said("title").alias("title"), said("description").alias("description"))
    facts = found.groupBy("origin").agg(
        F.min(F.when(F.col("home"), F.struct(order, "title", "description"))).alias("front"), F.min(F.struct(order, "description")).alias("first"), F.first("host").alias("host")
    )
    chosen = F.coalesce(F.lit(name or None), F.col("front.title"), F.col("host")).alias("name")
    return facts.select("origin", chosen, F.coalesce(F.lit(description or None), F.col("front.description"), F.col("first.description")).alias("description"))


def latency(log: DataFrame, by: str, ms: Column) -> DataFrame:
    """by, total, least, most and n of the latencies ``ms`` of a fetch log; rows without one do not count."""
    return log.groupBy(by).agg(F.sum(ms).alias("total"), F.min(ms).alias("least"), F.max(ms).alias("most"), F.count(ms).alias("n"))


SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/sitemap-index.xml")


def first_sitemaps(sites: DataFrame, files: DataFrame) -> DataFrame:
    """origin and url of each site's first usable sitemap: those its robots.txt names in order, then the usual places.

    ``sites``: origin, sitemaps (an array, null for none). ``files``: url, xml of what could be fetched.
    """
    usual = F.array(*[F.concat("origin", F.lit(p)) for p in SITEMAP_PATHS])
    tried = sites.select("origin", F.posexplode(F.concat(F.coalesce("sitemaps", F.array().cast("array<string>")), usual)).alias("rank", "url"))
    usable = files.where(F.contains("xml", F.lit("<urlset")) | F.contains("xml", F.lit("<sitemapindex"))).select("url").distinct()
    return tried.join(usable, "url").groupBy("origin").agg(F.min_by("url", "rank").alias("url"))


def robots(files: DataFrame, text: str = "text") -> DataFrame:
    """Adds sitemaps (all lines) and crawl_delay (the first number) of robots.txt files."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)Sitemap:[^\S\n]*([^\n]*)"), F.lit(1)), lambda s: F.trim(s))
    delay = F.regexp_extract(text, r"(?i)Crawl-delay:\s*(\d+(?:\.\d+)?)", 1)
    return files.withColumn("sitemaps", found).withColumn("crawl_delay", delay.try_cast("double"))


def sitemap_urls(files: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows (all columns but the source), kind (urlset or sitemapindex) and loc of sitemap files; others give none."""
    kind = F.when(F.contains(F.col(xml), F.lit("<sitemapindex")), "sitemapindex").when(F.contains(F.col(xml), F.lit("<urlset")), "urlset")
    locs = F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    rows = files.withColumn("kind", kind).where("kind is not null").select("*", F.posexplode(locs).alias("pos", "loc"))
    cdata = F.regexp_extract("loc", r"(?s)^<!\[CDATA\[(.*?)\]\]>$", 1)
    return rows.withColumn("loc", F.when(cdata != "", F.trim(cdata)).otherwise(T.decode_entities(F.col("loc")))).drop(xml)


def expand_sitemaps(roots: DataFrame, files: DataFrame, max_depth: int = 5) -> DataFrame:
    """All page addresses below the sitemaps ``roots`` (url); ``files`` (url, xml) are those that can be read."""
    found = sitemap_urls(files)
    edges = found.where("kind = 'sitemapindex'").select(F.col("url").alias("src"), F.col("loc").alias("dst"))
    reached = crawl(roots, edges, max_depth)
    return found.where("kind = 'urlset'").join(reached.select("url"), "url", "left_semi").select(F.col("loc").alias("url")).distinct()
