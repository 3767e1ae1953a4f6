"""Model replies as text to typed columns. Only true JSON types count: a number in quotes is no number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citetrail.schema import ENTITY_TYPES, SOURCE_TYPES


def parse_json(raw: Column) -> Column:
    """A variant of the text, else of what lies between its first { and its last }, else null."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1)))


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_at(v: Column, path: str, default: str | None = "") -> Column:
    """A JSON string, else the default."""
    x = get(v, path)
    return F.when(kind_of(x) == "STRING", F.try_variant_get(v, path, "string")).otherwise(F.lit(default))


def is_number(v: Column) -> Column:
    return F.coalesce(kind_of(v).rlike(r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"), F.lit(False))


def unit_number(v: Column, path: str, default: float = 0.5) -> Column:
    """A JSON number held to 0..1, else the default."""
    return F.when(is_number(get(v, path)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_variant_get(v, path, "double")))).otherwise(F.lit(default))


def items(v: Column, path: str) -> Column:
    """array<variant>: the members of a JSON array, else none."""
    return F.coalesce(F.when(kind_of(get(v, path)).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>")), F.array().cast("array<variant>"))


def texts(v: Column, path: str, most: int | None = None) -> Column:
    """The strings among the members of a JSON array; others are dropped, not turned into text."""
    kept = F.transform(F.filter(items(v, path), lambda x: kind_of(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return kept if most is None else F.slice(kept, 1, most)


def one_of(value: Column, known: list[str], default: str) -> Column:
    return F.when(value.isin(*known), value).otherwise(F.lit(default))


def source_type(v: Column, path: str = "$.sourceType") -> Column:
    return one_of(text_at(v, path), SOURCE_TYPES, "secondary-reporting")


def entity_type(v: Column, path: str) -> Column:
    return one_of(text_at(v, path), ENTITY_TYPES, "concept")


def has_text(v: Column, path: str) -> Column:
    return F.coalesce(kind_of(get(v, path)) == "STRING", F.lit(False))


def classification(raw: Column) -> Column:
    """A reply on what a page is: strings empty by default, the snippet up to 300 characters, up to ten addresses and ten unlinked sources with a description."""
    v = parse_json(raw)
    unlinked = F.transform(
        F.filter(items(v, "$.unlinkedSources"), lambda s: has_text(s, "$.description")),
        lambda s: F.struct(
            text_at(s, "$.description").alias("description"), text_at(s, "$.canonicalKey").alias("canonicalKey"), source_type(s).alias("sourceType"), text_at(s, "$.publisher").alias("publisher"), text_at(s, "$.date").alias("date")
        ),
    )
    return F.struct(
        text_at(v, "$.title").alias("title"),
        source_type(v).alias("sourceType"),
        text_at(v, "$.publisher").alias("publisher"),
        text_at(v, "$.date").alias("date"),
        F.substring(text_at(v, "$.snippet"), 1, 300).alias("snippet"),
        texts(v, "$.sourceUrls", 10).alias("sourceUrls"),
        F.slice(unlinked, 1, 10).alias("unlinkedSources"),
    )


def triples(v: Column, path: str) -> Column:
    """Triples whose subject, predicate and object are strings; the predicate in lower case."""
    ok = F.filter(items(v, path), lambda t: has_text(t, "$.subject") & has_text(t, "$.predicate") & has_text(t, "$.object"))
    return F.transform(
        ok,
        lambda t: F.struct(
            text_at(t, "$.subject").alias("subject"),
            entity_type(t, "$.subjectType").alias("subjectType"),
            F.lower(text_at(t, "$.predicate")).alias("predicate"),
            text_at(t, "$.object").alias("object"),
            entity_type(t, "$.objectType").alias("objectType"),
            F.nullif(text_at(t, "$.context"), F.lit("")).alias("context"),
        ),
    )


def claims(raw: Column, most: int = 15) -> Column:
    """Claims that are strings, with the strings among their entities, and their triples."""
    v = parse_json(raw)
    ok = F.filter(items(v, "$.claims"), lambda c: has_text(c, "$.claim"))
    return F.slice(
        F.transform(ok, lambda c: F.struct(text_at(c, "$.claim").alias("claim"), texts(c, "$.entities").alias("entities"), text_at(c, "$.attribution").alias("attribution"), triples(c, "$.triples").alias("triples"))), 1, most
    )


def edge_scores(raw: Column) -> Column:
    v = parse_json(raw)
    return F.struct(unit_number(v, "$.sourceFidelity").alias("sourceFidelity"), unit_number(v, "$.editorialization").alias("editorialization"), texts(v, "$.concerns").alias("concerns"), texts(v, "$.attributedClaims").alias("attributedClaims"))


def matches(raw: Column) -> Column:
    """Positions from 0 of the matches a reply numbers from 1; others are dropped."""
    v = parse_json(raw)
    return F.array_distinct(F.transform(F.filter(items(v, "$.matches"), is_number), lambda x: F.try_variant_get(x, "$", "int") - 1))


def link_list(links: Column, most: int = 50) -> Column:
    """The lines of a prompt that list links: each address once by its first place, with its text if it has one."""
    once = F.filter(links, lambda x, i: F.array_position(links["href"], x["href"]) == i + 1)
    line = lambda x: F.when(F.coalesce(x["text"], F.lit("")) != "", F.concat(F.lit("- "), x["href"], F.lit(' ("'), x["text"], F.lit('")'))).otherwise(F.concat(F.lit("- "), x["href"]))
    return F.array_join(F.transform(F.slice(once, 1, most), line), "\n")
