"""Answers from a chat service over HTTP. Nothing uses it unless it is asked for."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from citetrail.models.base import INSTRUCTIONS

#: Texts of one request for vectors; a request that fails leaves only its own texts without.
EMBED_BATCH = 64
# Tokens a reply may have, by operator.
MAX_TOKENS = {"classify": 4096, "claims": 8192, "edge": 2048, "phantom": 2048, "match": 1024, "summary": 2048}


def with_retries(call: Callable[[], str], retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The call's result; after each failure but the last a pause of one second more; none when all fail."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception:
            if attempt < retries:
                sleep(attempt + 1.0)
    return None


def post_json(url: str, body: dict, timeout: float, key: str = "") -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})})
    with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
        return json.load(r)


class HttpModel:
    """Two chat models, the large one for edges, and one for vectors; `concurrency` tasks ask at a time.

    The large model is told not to think aloud unless `thinking` is set.
    """

    def __init__(self, small: dict, large: dict, vectors: dict, concurrency: int = 4, dims: int = 768, thinking: bool = False, embed_batch: int = EMBED_BATCH) -> None:
        self.small, self.large, self.vectors, self.concurrency, self.dims = small, large, vectors, concurrency, dims
        self.thinking, self.embed_batch = thinking, embed_batch

    def body(self, operator: str, prompt: str) -> tuple[dict, dict]:
        """The model asked, and the request."""
        big = operator in ("edge", "phantom")
        m = self.large if big else self.small
        out = {"model": m["model"], "temperature": 0.1, "max_tokens": MAX_TOKENS[operator], "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": INSTRUCTIONS[operator]}, {"role": "user", "content": prompt}]}
        return m, out | ({"chat_template_kwargs": {"enable_thinking": self.thinking}} if big else {})

    def reply(self, requests: DataFrame) -> DataFrame:
        body = self.body

        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                raw = []
                for op, prompt in zip(pdf["operator"], pdf["prompt"], strict=True):
                    m, asked = body(op, prompt)
                    raw.append(with_retries(lambda b=asked, m=m: post_json(m["url"], b, m.get("timeout", 60), m.get("key", ""))["choices"][0]["message"]["content"] or ""))
                yield pdf.assign(raw=raw)

        return requests.select("key", "operator", "prompt").repartition(self.concurrency).mapInPandas(answer, "key string, operator string, prompt string, raw string")

    def embed(self, texts: DataFrame) -> DataFrame:
        """Vectors in the order of the texts, in requests of `embed_batch`; all zero where a request was given up."""
        conf, dims, size = self.vectors, self.dims, self.embed_batch

        def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                claims, found = pdf["claim"].tolist(), []
                for lo in range(0, len(claims), size):
                    part = claims[lo : lo + size]
                    got = with_retries(lambda b={"model": conf["model"], "input": part}: json.dumps(post_json(conf["url"], b, conf.get("timeout", 30), conf.get("key", ""))))
                    rows = sorted(json.loads(got)["data"], key=lambda r: r["index"]) if got else []
                    found += [r["embedding"] for r in rows] if len(rows) == len(part) else [[0.0] * dims] * len(part)
                yield pdf.assign(embedding=found)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "embedding")
        return texts.repartition(self.concurrency).mapInPandas(vectors, fields + ", embedding array<float>")
