"""Pages by address, from a table of fetches or a crawl service."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrail.functions.dates import is_fresh
from citetrail.functions.pages import with_best_content
from citetrail.functions.urls import normalize_url
from citetrail.models.http import post_json, with_retries
from citetrail.runtime import materialise


class PageSource(Protocol):
    """Adds success, markdown, page_title and links to rows with a column `url`; a page not to be had has success false."""

    def fetch(self, rows: DataFrame) -> DataFrame: ...


def flatten_links(links: Column) -> Column:
    """Links with an address, internal ones first; no text becomes an empty one."""
    inside = lambda x: F.coalesce(x["internal"], F.lit(False))
    ordered = F.concat(F.filter(links, inside), F.filter(links, lambda x: ~inside(x)))
    return F.transform(F.filter(ordered, lambda x: x["href"].isNotNull()), lambda x: F.struct(x["href"].alias("href"), F.coalesce(x["text"], F.lit("")).alias("text"), inside(x).alias("internal")))


class CorpusSource:
    """The last good fetch of an address in a table, by its normalised form; failures are not kept. `now` and `hours` limit its age.

    A page's text is the best of its fitted text (a column `fit`, if there is one) and its markdown.
    """

    def __init__(self, corpus: DataFrame, now: Column | None = None, hours: int = 24) -> None:
        rows = corpus.where("success and markdown is not null").withColumn("_u", normalize_url(F.col("url")))
        rows = with_best_content(rows, F.col("fit") if "fit" in rows.columns else F.lit(""), F.col("markdown"), "markdown").where("markdown <> ''")
        if now is not None:
            rows = rows.where(is_fresh(F.col("fetched_at"), now, hours))
        self.pages = rows.groupBy("_u").agg(F.max_by(F.struct("markdown", F.coalesce("title", F.lit("")).alias("page_title"), flatten_links(F.col("links")).alias("links")), F.coalesce("fetched_at", F.lit(0).cast("timestamp"))).alias("_p"))

    def fetch(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumn("_u", normalize_url(F.col("url"))).join(self.pages, "_u", "left").drop("_u")
        return out.select("*", F.col("_p").isNotNull().alias("success"), F.coalesce("_p.markdown", F.lit("")).alias("markdown"), F.coalesce("_p.page_title", F.lit("")).alias("page_title"), F.col("_p.links").alias("links")).drop("_p")


def pages_of(urls: list[str], reply: dict) -> list[dict]:
    """A page for each address of a request: by the address in the reply, else by place where the reply has as many results."""
    found, results = read_crawl_reply(reply), reply.get("results", [])
    none = {"success": False, "markdown": "", "page_title": "", "links": []}
    moved = [found.get(r.get("url", ""), none) if isinstance(r, dict) and r.get("url") not in urls else none for r in results] if len(results) == len(urls) else [none] * len(urls)
    return [{"url": u, **found.get(u, m)} for u, m in zip(urls, moved, strict=True)]


def read_crawl_reply(reply: dict) -> dict[str, dict]:
    """Results of a crawl reply by address (not by place): markdown as text or as an object with raw_markdown."""
    out = {}
    for r in reply.get("results", []):
        md, meta, links = r.get("markdown"), r.get("metadata") or {}, r.get("links") or {}
        lists = [("internal", True), ("external", False)] if isinstance(links, dict) else [(None, False)]
        flat = [(x["href"], x.get("text") or "", inside) for name, inside in lists for x in (links.get(name) or [] if name else links) if isinstance(x, dict) and isinstance(x.get("href"), str)]
        title = meta.get("og:title") if meta.get("og:title") is not None else meta.get("title")
        out[r.get("url", "")] = {"success": bool(r.get("success")), "markdown": md if isinstance(md, str) else (md or {}).get("raw_markdown") or "", "page_title": title or "", "links": flat}
    return out


def fitted_text(endpoint: str, url: str, timeout: float) -> str:
    """A page's fitted text from the service's second endpoint; empty whatever goes wrong."""
    try:
        got = post_json(endpoint + "/md", {"url": url, "f": "fit", "q": None, "c": "0"}, timeout).get("markdown")
    except Exception:
        return ""
    return got if isinstance(got, str) else ""


class CrawlService:
    """Pages from a crawl service over HTTP, five addresses a request; a failed request leaves its pages failed.

    The fitted texts of a request's pages are asked for at the same time; the best of both is the page's text, and a
    page without any is failed. A reply that names a page by another address (after a redirect) is matched by its place.
    """

    def __init__(self, endpoint: str, batch: int = 5, timeout: float = 30.0, concurrency: int = 4) -> None:
        self.endpoint, self.batch, self.timeout, self.concurrency = endpoint, batch, timeout, concurrency

    def fetch(self, rows: DataFrame) -> DataFrame:
        endpoint, size, timeout = self.endpoint, self.batch, self.timeout

        def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(size) as pool:
                for pdf in batches:
                    todo, out = pdf["url"].tolist(), []
                    for k in range(0, len(todo), size):
                        part = todo[k : k + size]
                        fits = pool.map(lambda u: fitted_text(endpoint, u, timeout), part)
                        got = with_retries(lambda u=part: json.dumps(post_json(endpoint + "/crawl", {"urls": u}, timeout)), 2, lambda s: None)
                        out += [{**page, "fit": fit} for page, fit in zip(pages_of(part, json.loads(got) if got else {}), fits, strict=True)]
                    yield pd.DataFrame(out, columns=["url", "success", "markdown", "page_title", "links", "fit"])

        asked = rows.select("url").distinct().repartition(self.concurrency)
        pages = asked.mapInPandas(get, "url string, success boolean, markdown string, page_title string, links array<struct<href:string,text:string,internal:boolean>>, fit string")
        pages = with_best_content(pages, F.col("fit"), F.col("markdown"), "markdown").drop("fit")
        return rows.join(pages.withColumn("success", F.col("success") & (F.col("markdown") != "")), "url", "left")


class CachedSource:
    """Keeps what another source brings: successes in a table at `path`, everything in this process, both for so many hours.

    A page found in neither is asked for. The table has a row per fetch, keyed by the SHA-256 of the address, so parts
    are only added; the last one that has not run out counts. Files that cannot be read count as not there.
    """

    SCHEMA = "key string, url string, success boolean, markdown string, page_title string, links array<struct<href:string,text:string,internal:boolean>>, expires_at timestamp"

    def __init__(self, inner: PageSource, path: str, hours: int = 24, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> None:
        self.inner, self.path, self.hours, self.now, self.memory = inner, path, hours, now, None

    def _held(self, spark: SparkSession) -> DataFrame:
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(self.path)
        rows = spark.read.schema(self.SCHEMA).option("ignoreCorruptFiles", "true").parquet(self.path)
        rows = rows if self.memory is None else rows.unionByName(self.memory)
        fresh = rows.where(F.col("expires_at") > F.lit(self.now()))
        return fresh.groupBy("key").agg(F.max_by(F.struct("success", "markdown", "page_title", "links"), "expires_at").alias("p")).select("key", "p.*")

    def fetch(self, rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        asked = materialise(rows.select("url").distinct().withColumn("key", F.sha2("url", 256)))
        hits = materialise(asked.join(self._held(spark), "key"))
        misses = materialise(asked.join(hits.select("key"), "key", "left_anti"))
        found = hits
        if not misses.isEmpty():
            until = F.lit(self.now() + timedelta(hours=self.hours))
            got = materialise(self.inner.fetch(misses).select("key", "url", "success", "markdown", "page_title", "links", until.alias("expires_at")))
            got.where("success").write.mode("append").parquet(self.path)
            self.memory = got if self.memory is None else materialise(self.memory.unionByName(got))
            found = hits.unionByName(got.drop("expires_at"))
        return rows.join(found.drop("key"), "url", "left")
