"""Replies of services, retries, and pages from a table."""

from __future__ import annotations

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from citetrail.functions.urls import is_url, split_requests
from citetrail.models.http import HttpModel, with_retries
from citetrail.schema import PAGE
from citetrail.sources.corpus import CachedSource, CorpusSource, CrawlService, pages_of, read_crawl_reply


def test_crawl_reply():
    got = read_crawl_reply(
        {"results": [
            {"url": "a", "success": True, "markdown": {"raw_markdown": "text"}, "metadata": {"title": "T", "og:title": "OG"}, "links": {"external": [{"href": "e"}], "internal": [{"href": "i", "text": "x"}, {"text": "no address"}]}},
            {"url": "b", "success": False, "markdown": "m", "links": [{"href": "z"}, "bad"]}, {"url": "c", "markdown": 3 and None}]}
    )
    assert got["a"] == {"success": True, "markdown": "text", "page_title": "OG", "links": [("i", "x", True), ("e", "", False)]}
    assert got["b"]["links"] == [("z", "", False)] and got["c"]["markdown"] == "" and not got["c"]["success"]


def test_retries():
    pauses, calls = [], []

    def fail():
        calls.append(1)
        raise OSError

    assert with_retries(fail, 2, pauses.append) is None and len(calls) == 3 and pauses == [1.0, 2.0]
    assert with_retries(lambda: "ok", 2, pauses.append) == "ok"


def test_corpus(spark):
    t = lambda h: dt.datetime(2024, 1, 2, h)
    rows = [("https://a.test/x?ref=1", True, "old", "T", [], {}, t(1)), ("https://A.test/x", True, "new", None, None, {}, t(5)), ("https://a.test/x", False, None, "", [], {}, t(9)), ("https://b.test/", True, "stale", "", [], {}, dt.datetime(2023, 1, 1))]
    source = CorpusSource(spark.createDataFrame(rows, PAGE), F.lit("2024-01-02 12:00:00").cast("timestamp"), 24)
    asked = spark.createDataFrame([("https://a.test/x#y",), ("https://b.test/",), ("https://c.test/",)], "url string")
    assert {r.url: (r.success, r.markdown, r.page_title) for r in source.fetch(asked).collect()} == {"https://a.test/x#y": (True, "new", ""), "https://b.test/": (False, "", ""), "https://c.test/": (False, "", "")}


def test_request_check(spark):
    df = spark.createDataFrame([("https://a.test/",), ("",), ("word",), (None,)], "u string")
    assert [r.ok for r in df.select(is_url(F.col("u")).alias("ok")).collect()] == [True, False, False, False]
    good, rejects = split_requests(df, "u")
    assert good.count() == 1 and {r.u: r.reason for r in rejects.collect()} == {"": "empty", None: "empty", "word": "not an address"}


def test_redirected_reply():
    reply = {"results": [{"url": "https://new.test/", "success": True, "markdown": "moved"}, {"url": "b", "success": True, "markdown": "b"}]}
    assert [p["markdown"] for p in pages_of(["a", "b"], reply)] == ["moved", "b"]
    assert [p["success"] for p in pages_of(["a", "b", "c"], reply)] == [False, True, False]
    assert [p["success"] for p in pages_of(["a"], {})] == [False]


def test_model_requests():
    m = HttpModel({"model": "s"}, {"model": "l"}, {"model": "v"})
    assert m.body("edge", "x")[1]["chat_template_kwargs"] == {"enable_thinking": False} and m.body("phantom", "x")[0] == {"model": "l"}
    assert "chat_template_kwargs" not in m.body("summary", "x")[1] and m.body("summary", "x")[1]["max_tokens"] == 2048


class Service(BaseHTTPRequestHandler):
    """A crawl service and a model for vectors, on this machine."""

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/md":
            out = {"markdown": "Fitted text of the page that goes on. " * 20 if "fit" in asked["url"] else 7}
        elif self.path == "/crawl":
            out = {"results": [{"url": u, "success": True, "markdown": "" if "blank" in u else "Raw text of the page. " * 30, "metadata": {"title": "T"}} for u in asked["urls"]]}
        else:
            if "bad" in asked["input"]:
                self.send_error(500)
                return
            out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(asked["input"])))]}
        body = json.dumps(out).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def endpoint():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_crawl_service(spark, endpoint):
    urls = ["https://a.test/fit", "https://a.test/raw", "https://a.test/blank"]
    got = {r.url: r for r in CrawlService(endpoint, concurrency=2).fetch(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got[urls[0]].markdown.startswith("Fitted") and got[urls[1]].markdown.startswith("Raw") and got[urls[1]].page_title == "T"
    assert [got[u].success for u in urls] == [True, True, False]


def test_vectors_in_batches(spark, endpoint, monkeypatch):
    m = HttpModel({"model": "s"}, {"model": "l"}, {"model": "v", "url": endpoint + "/embed"}, concurrency=1, dims=2, embed_batch=2)
    texts = spark.createDataFrame([("a",), ("bb",), ("bad",), ("ccc",), ("dddd",)], "claim string").coalesce(1)
    got = {r.claim: r.embedding for r in m.embed(texts).collect()}
    zero = [0.0, 0.0]
    lost = [c for c, v in got.items() if v == zero]
    assert "bad" in lost and len(lost) <= 2 and all(v == [float(len(c)), 1.0] for c, v in got.items() if v != zero)


def test_cache(spark, tmp_path):
    class Inner:
        asked: list = []

        def fetch(self, rows):
            urls = sorted(r.url for r in rows.collect())
            self.asked.append(urls)
            return rows.select("*", (~F.col("url").contains("gone")).alias("success"), F.lit("text").alias("markdown"), F.lit("T").alias("page_title"), F.array().cast("array<struct<href:string,text:string,internal:boolean>>").alias("links"))

    clock = [dt.datetime(2024, 1, 1, tzinfo=dt.UTC)]
    rows = lambda *u: spark.createDataFrame([(x, 1) for x in u], "url string, n int")
    inner, path = Inner(), str(tmp_path / "cache")
    source = CachedSource(inner, path, 24, lambda: clock[0])
    assert {r.url: r.success for r in source.fetch(rows("https://a.test/", "https://gone.test/", "https://a.test/")).collect()} == {"https://a.test/": True, "https://gone.test/": False}
    source.fetch(rows("https://a.test/", "https://gone.test/")).collect()  # failures are kept in this process
    assert inner.asked == [["https://a.test/", "https://gone.test/"]]
    other = CachedSource(inner, path, 24, lambda: clock[0])
    assert other.fetch(rows("https://a.test/", "https://gone.test/")).count() == 2 and inner.asked[1:] == [["https://gone.test/"]]
    clock[0] += dt.timedelta(hours=25)
    other.fetch(rows("https://a.test/")).collect()
    assert inner.asked[2:] == [["https://a.test/"]]
