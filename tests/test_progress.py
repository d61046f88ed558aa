"""Counts of stages equal what the stages give."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import links
from pagemill.operators.progress import Progress
from pagemill.plans import site


def test_crawl(spark):
    edges = spark.createDataFrame([(f"https://a.b/{i}", f"https://a.b/{j}") for i in range(20) for j in (2 * i + 1, 2 * i + 2, i)], "src string, dst string")
    progress = Progress()
    found = links.crawl_site(spark.createDataFrame([("https://a.b/0",)], "url string"), edges, links.CrawlConfig(max_depth=3), progress)
    by_depth = {f"wave {r.depth}": r.n for r in found.where("depth > 0").groupBy("depth").agg(F.count("*").alias("n")).collect()}
    counts = progress.counts()
    assert by_depth == {"wave 1": 2, "wave 2": 4, "wave 3": 8} == {k: v["rows"] for k, v in counts.items() if k != "edges"}
    assert counts["edges"]["rows"] == 60 and 18 <= counts["edges"]["sources"] <= 22


def test_site(spark, sf):
    progress = Progress()
    pages, _ = site.site(spark.read.parquet(f"{sf}/pages.parquet"), strip=False, progress=progress)
    rows = pages.collect()
    assert progress.counts() == {"pages": {"rows": len(rows), "characters": sum(len(r.markdown) for r in rows), "untitled": 0}}
    with pytest.raises(ValueError, match="watched already"):
        progress.watch(pages, "pages")
