"""Vectors as arrays of numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null for vectors of different lengths or with a null value."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is all zero, null where lengths differ or a value is null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))


def is_usable(v: Column, dims: int | None = None) -> Column:
    """Whether a vector has only finite values, one of them not 0, and so many of them if given."""
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok & (F.size(v) == dims) if dims else ok, F.lit(False))


def unit(a: Column) -> Column:
    """array<double>: a vector at length 1, so cosines of many pairs take one product each; null values and a zero vector give null."""
    d = F.transform(a, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(F.array(F.struct(d.alias("d"), F.nullif(norm, F.lit(0.0)).alias("n"))), lambda s: F.transform(s["d"], lambda x: x / s["n"]))[0]
