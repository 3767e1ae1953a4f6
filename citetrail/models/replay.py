"""Answers from a table of earlier replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ReplayModel:
    """Replies by request key, else by operator and the first line of the prompt; none for the rest. Vectors by claim text, else all zero."""

    def __init__(self, replies: DataFrame, vectors: DataFrame | None = None, dims: int = 768) -> None:
        self.replies, self.vectors, self.dims = replies, vectors, dims

    def reply(self, requests: DataFrame) -> DataFrame:
        by_key = self.replies.where("key is not null").groupBy("key").agg(F.min("raw").alias("_a"))
        by_line = self.replies.where("key is null").groupBy("operator", "subject").agg(F.min("raw").alias("_b"))
        out = requests.withColumn("subject", F.substring_index("prompt", "\n", 1)).join(by_key, "key", "left").join(by_line, ["operator", "subject"], "left")
        return out.withColumn("raw", F.coalesce("_a", "_b")).drop("_a", "_b", "subject")

    def embed(self, texts: DataFrame) -> DataFrame:
        zero = F.array_repeat(F.lit(0.0).cast("float"), self.dims)
        if self.vectors is None:
            return texts.withColumn("embedding", zero)
        v = self.vectors.groupBy("claim").agg(F.any_value("embedding").alias("_v"))
        return texts.join(v, "claim", "left").withColumn("embedding", F.coalesce("_v", zero)).drop("_v")
