"""Conversion by options: presets, filters, front matter, styles, tag overrides, cleaning and wrapping in one plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import clean
from pagemill.operators import convert, frontmatter, markup, selectors


@dataclass(frozen=True)
class Options:
    """How pages are converted.

    ``frontmatter`` puts the head's fields before the text and takes the title out of it; ``more`` are additional fields.
    ``styles`` applies utility classes. ``names`` renders elements as others, ``marks`` gives inline elements their own
    marks. ``steps`` are those cleaning steps that differ from ``cleaning`` (all but folding empty lines).
    """

    isolate_main: bool = False
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    frontmatter: bool = False
    more: Mapping[str, str] = field(default_factory=dict)
    styles: bool = False
    cleaning: bool = False
    steps: Mapping[str, bool] = field(default_factory=dict)
    names: Mapping[str, str] = field(default_factory=dict)
    marks: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    wrap: int | None = None

    @classmethod
    def minimal(cls, **changes) -> Options:
        """The preset for language models; each part can be switched off or replaced by name."""
        return replace(cls(isolate_main=True, exclude=convert.MINIMAL, frontmatter=True, styles=True, cleaning=True), **changes)


def pages_to_markdown(pages: DataFrame, options: Options | None = None, origin: Column | None = None) -> DataFrame:
    """page_id and markdown of every page; a page that renders nothing has an empty text."""
    options = options or Options()
    whole = markup.tokens(pages)
    rows = convert.renamed(whole, options.names)
    if options.styles:
        rows = frontmatter.styled(rows)
    if options.isolate_main:
        rows = markup.isolate_main(rows)
    if options.exclude:
        rows = selectors.exclude(rows, options.exclude)
    if options.include:
        rows = selectors.include(rows, options.include)
    if options.frontmatter:
        rows = markup.without_head(rows)
    md = convert.for_all(pages, convert.to_markdown(rows, origin, options.cleaning, marks=options.marks))
    text = F.col("markdown")
    if options.cleaning:
        text = clean.clean_markdown(text, **options.steps)
    if options.wrap:
        text = clean.hard_wrap(text, options.wrap)
    md = md.withColumn("markdown", text)
    if not options.frontmatter:
        return md
    head = frontmatter.fields(whole).select(F.col("page_id").alias("of"), frontmatter.yaml(F.col("title"), F.col("meta"), options.more).alias("head"))
    joined = md.join(head, F.col("page_id").eqNullSafe(F.col("of")), "left")
    return joined.select("page_id", F.rtrim(F.concat(F.coalesce("head", F.lit("")), "markdown"), F.lit("\n")).alias("markdown"))


def answers_to_markdown(pages: DataFrame, options: Options | None = None, content_type: str = "content_type") -> DataFrame:
    """page_id and markdown of answers of several types: Markdown passes as it is, all else is converted as HTML."""
    passes = F.coalesce(F.lower(content_type).startswith("text/markdown"), F.lit(False))
    converted = pages_to_markdown(pages.where(~passes), options)
    return converted.unionByName(pages.where(passes).select("page_id", F.coalesce("html", F.lit("")).alias("markdown")))
