"""Fetches as a stream: the same page functions over Structured Streaming.

An extension: the batch operators need none of it. State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrail.functions.pages import page_kind
from citetrail.functions.urls import normalize_url


def changed_pages(fetches: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Fetches without those that bring the same text of the same address again within the delay; failures are left out."""
    good = fetches.where("success and markdown is not null").withColumns({"norm_url": normalize_url(F.col("url")), "digest": F.md5("markdown")})
    return good.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["norm_url", "digest"])


def kind_counts(fetches: DataFrame, window: str = "1 day", delay: str = "24 hours") -> DataFrame:
    """start, kind, n_pages: pages per kind and window of fetching; a fetch later than the delay no longer counts."""
    kind = page_kind(*(F.col(c) for c in ("success", "url", "title", "markdown")))
    return fetches.withWatermark("fetched_at", delay).groupBy(F.window("fetched_at", window), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_pages")).select(F.col("window.start").alias("start"), "kind", "n_pages")
