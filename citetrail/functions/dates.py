"""Date functions over columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """The nearest whole number, halves upward."""
    return F.floor(x + 0.5)


def temporal_gap(source: Column, downstream: Column) -> Column:
    """How far apart two dates are: months or weeks the source is older, weeks it is newer; null within 14 days or without a date."""
    days = half_up((F.unix_micros(downstream.cast("timestamp")) - F.unix_micros(source.cast("timestamp"))) / 86_400_000_000)
    months, weeks = half_up(days / 30), half_up(days / 7)
    older = F.when(months >= 2, F.concat(F.lit("~"), months.cast("string"), F.lit(" months older"))).otherwise(F.concat(F.lit("~"), weeks.cast("string"), F.lit(" weeks older")))
    return F.when(days > 14, older).when(days < -14, F.concat(F.lit("~"), half_up(F.abs(days) / 7).cast("string"), F.lit(" weeks newer")))


def is_fresh(fetched_at: Column, now: Column, hours: int = 24) -> Column:
    return fetched_at + F.make_dt_interval(hours=F.lit(hours)) > now


def relative_time(at: Column, now: Column) -> Column:
    """just now, minutes, hours or days ago."""
    s = F.floor((F.unix_micros(now) - F.unix_micros(at)) / 1_000_000)
    m, h = F.floor(s / 60), F.floor(s / 3600)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(unit + " ago"))
    return F.when(s < 60, "just now").when(m < 60, ago(m, "m")).when(h < 24, ago(h, "h")).otherwise(ago(F.floor(h / 24), "d"))
