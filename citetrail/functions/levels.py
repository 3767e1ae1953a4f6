"""Levels and labels shown beside an edge or a list."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from citetrail.functions.dates import half_up

# Labels of kinds of sources.
LABELS = {
    "primary-study": "primary study", "press-release": "press release", "wire-service": "wire service", "secondary-reporting": "reporting", "opinion": "opinion",
    "official-statement": "statement", "data-source": "data", "interview": "interview",
}


def fidelity_level(v: Column) -> Column:
    return F.when(v >= 0.75, "high").when(v >= 0.5, "medium").otherwise("low")


def editorial_level(v: Column) -> Column:
    return F.when(v >= 0.6, "high").when(v >= 0.3, "medium").otherwise("low")


def percent(v: Column) -> Column:
    return half_up(v * 100)


def label(source_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), source_type), source_type)


def counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))


def first_text(*options: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(o != "", o) for o in options))
