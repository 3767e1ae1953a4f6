"""Sizes of texts in tokens of a public tokenizer's vocabulary (a rank file given by its path)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default vocabulary; any rank file with at most 65,536 ids may be given instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of such rank files, in its form without needless backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Tokens from which a text's length is no sign of less quality.
FULL_TOKENS = 200
#: Least weight of a document.
LEAST_WEIGHT = 0.05

# Bytes that are white space, and digits and signs.
_SPACE = b" \t\r\n\x0b\x0c"
_SIGNS = b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_shipped: set[tuple[str, str]] = set()


def ship_vocabulary(spark: SparkSession, vocabulary: str) -> None:
    """Send the rank file to every executor, once per application."""
    key = (spark.sparkContext.applicationId, vocabulary)
    if key not in _shipped and os.path.exists(vocabulary):
        spark.sparkContext.addFile(vocabulary)
        _shipped.add(key)


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    """Read once per Python worker, from the path or from what `ship_vocabulary` sent."""
    with open(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Size that marks a row of frequencies among bags.
FREQUENCIES = -1


def token_bags(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens, ids binary, tfs binary: a text's size, its different tokens (uint16, ascending) and how often each occurs (uint32). Null texts are empty.

    Each task adds a row whose tokens are FREQUENCIES and whose tfs say in how many of its texts a token occurs.
    """
    ship_vocabulary(docs.sparkSession, vocabulary)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        df = np.zeros(1 << 16, np.uint32)
        none = None
        for pdf in batches:
            n, ids, tfs = [], [], []
            for t in pdf["text"]:
                u = np.array(enc.encode_ordinary(t), np.uint16)
                u.sort()
                first = np.flatnonzero(np.concatenate((u[:1] == u[:1], u[1:] != u[:-1])))
                own = u[first]
                df[own] += 1
                n.append(len(u))
                ids.append(own.tobytes())
                tfs.append(np.diff(first, append=len(u)).astype(np.uint32).tobytes())
            none = pdf["doc_id"].iloc[:1] if none is None else none
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": n, "ids": ids, "tfs": tfs})
        some = np.flatnonzero(df)
        if len(some):
            yield pd.DataFrame({"doc_id": none.to_numpy(), "tokens": FREQUENCIES, "ids": [some.astype(np.uint16).tobytes()], "tfs": [df[some].tobytes()]})

    return base.mapInPandas(count, f"doc_id {dict(base.dtypes)['doc_id']}, tokens long, ids binary, tfs binary")


def letter_share(text: str) -> float:
    """The part of a text's bytes, but for white space, that are no digits or signs of ASCII: what tables, codes and formulas lower."""
    signs = text.encode().translate(None, _SPACE)
    return len(signs.translate(None, _SIGNS)) / len(signs) if signs else 0.0


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, quality: str | None = None) -> DataFrame:
    """doc_id, source, tokens, weight: a text's size and quality weight, in LEAST_WEIGHT to 1. Null texts are empty.

    quality names a column of weights (null: 1); without it a weight is `letter_share`, less below FULL_TOKENS tokens.
    """
    ship_vocabulary(docs.sparkSession, vocabulary)
    given = F.coalesce(F.col(quality).cast("double"), F.lit(1.0)) if quality else F.lit(None).cast("double")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"), given.alias("given"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) for t in pdf["text"]]
            weight = pdf["given"] if quality else [letter_share(t) * min(1.0, k / FULL_TOKENS) for t, k in zip(pdf["text"], n, strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": n, "weight": weight})

    sized = base.mapInPandas(count, f"doc_id {dict(base.dtypes)['doc_id']}, source string, tokens long, weight double")
    return sized.withColumn("weight", F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(1.0), "weight")))
