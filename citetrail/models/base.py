"""What an analysis asks of models, and the texts it asks with.

A client answers requests as a column of raw text: a null answer is one that was given up, and the readers of replies
turn it into defaults. Requests are keyed by a hash of all that is asked, so answers can be kept and replayed.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each kind of request asks for; replies are JSON objects with the fields named.
INSTRUCTIONS = {
    "classify": "Describe the page: title, sourceType, publisher, date, snippet, sourceUrls from the list of links that the text relies on, and unlinkedSources it mentions without a link.",
    "claims": "List the factual claims of the text: claim, entities, attribution, and triples of subject, subjectType, predicate, object, objectType, context.",
    "edge": "Compare the downstream text with its source: sourceFidelity and editorialization from 0 to 1, and concerns.",
    "phantom": "Judge how the text uses a source it does not link: sourceFidelity and editorialization from 0 to 1, concerns, and attributedClaims.",
    "match": "Name by number the pairs that are the same source: matches.",
    "summary": "Sum up in two or three sentences how well the article's claims are supported: text.",
}


class ModelClient(Protocol):
    """Answers requests(key, operator, prompt, ...) with a column `raw`, and texts with vectors."""

    def reply(self, requests: DataFrame) -> DataFrame: ...

    def embed(self, texts: DataFrame) -> DataFrame:
        """Adds `embedding` to rows with a column `claim`."""
        ...


def request_key(operator: str, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(operator), F.lit(INSTRUCTIONS[operator]), prompt), 256)


def ask(model: ModelClient, rows: DataFrame, operator: str, prompt: Column) -> DataFrame:
    """Adds `raw`, the model's answer to the prompt. Equal requests are asked once."""
    keyed = rows.withColumns({"_prompt": prompt}).withColumn("_key", request_key(operator, F.col("_prompt")))
    requests = keyed.select(F.col("_key").alias("key"), F.lit(operator).alias("operator"), F.col("_prompt").alias("prompt")).distinct()
    answers = model.reply(requests).select(F.col("key").alias("_key"), "raw")
    return keyed.join(answers, "_key", "left").drop("_key", "_prompt")
