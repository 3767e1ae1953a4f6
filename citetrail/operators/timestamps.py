"""Mixed timestamp formats and time zones to one instant in UTC (problem 5).

Texts are taken apart by column expressions only. Local times then meet a table of zone-offset intervals, exploded by
zone and local year, in an as-of join: two intervals that hold the time mean it occurs twice, none that clocks skipped
it, one gives its offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetrail.runtime import join_sized, materialise

# Month names by language (English, German, French, Spanish), in the order of the months.
MONTHS = [
    ["january", "jan", "januar", "jänner", "janvier", "janv", "enero", "ene"],
    ["february", "feb", "februar", "février", "févr", "febrero"],
    ["march", "mar", "märz", "mars", "marzo"],
    ["april", "apr", "avril", "avr", "abril", "abr"],
    ["may", "mai", "mayo"],
    ["june", "jun", "juni", "juin", "junio"],
    ["july", "jul", "juli", "juillet", "juil", "julio"],
    ["august", "aug", "août", "agosto", "ago"],
    ["september", "sep", "sept", "septembre", "septiembre", "setiembre"],
    ["october", "oct", "oktober", "okt", "octobre", "octubre"],
    ["november", "nov", "novembre", "noviembre"],
    ["december", "dec", "dezember", "dez", "décembre", "déc", "diciembre", "dic"],
]
# Offsets of zone abbreviations, in minutes east of UTC; of ambiguous ones the most used meaning.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "msd": 240, "trt": 180, "ist": 330, "idt": 180,
    "wat": 60, "cat": 120, "sast": 120, "eat": 180, "mut": 240, "gst": 240, "irst": 210, "pkt": 300, "uzt": 300, "yekt": 300, "npt": 345, "omst": 360, "mmt": 390, "ict": 420, "wib": 420, "krat": 420, "novt": 420,
    "sgt": 480, "hkt": 480, "myt": 480, "pht": 480, "phst": 480, "wita": 480, "awst": 480, "irkt": 480, "jst": 540, "kst": 540, "wit": 540, "yakt": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "vlat": 600,
    "pgt": 600, "chst": 600, "lhst": 630, "magt": 660, "sbt": 660, "nzst": 720, "nzdt": 780, "fjt": 720, "pett": 720, "chast": 765, "chadt": 825, "tot": 780, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "hast": -600, "hdt": -540, "sst": -660, "brt": -180, "brst": -120, "art": -180, "uyt": -180, "clt": -240, "clst": -180,
    "bot": -240, "vet": -240, "gyt": -240, "pyt": -240, "cot": -300, "pet": -300, "ect": -300, "azot": -60, "cvt": -60,
}
# Weekday names by language, as an alternation.
WEEKDAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|lunes|martes|miércoles|jueves|viernes|sábado|domingo"

#: Local years that a calendar with zones reaches; times outside use the rules of the first or last.
YEARS = (2, 9998)


def _month_number(name: Column) -> Column:
    pairs = [F.lit(x) for i, names in enumerate(MONTHS, 1) for n in names for x in (n, i)]
    return F.try_element_at(F.create_map(*[p if k % 2 == 0 else p.cast("int") for k, p in enumerate(pairs)]), name)


def parse_dates(df: DataFrame, text: str, order: Column) -> DataFrame:
    """Adds `p`: struct<day, secs, micros, off_secs, zone, epoch_us, odd_zone>, null where the text fixes no day.

    day counts from 1970-01-01, secs is the time of day (0 without a time), micros what is finer (digits beyond are cut).
    off_secs is an offset in the text, zone a zone named there (lower case); epoch_us an instant given as a number of
    seconds, milliseconds, microseconds or nanoseconds; odd_zone an abbreviation whose offset is not known. `order` is `dmy` or `mdy` for numeric dates that do not start
    with a four-digit year (null: dmy). Impossible dates or times, and texts that name no day, give null. A rest of the
    text that is no time is ignored: the day's start.
    """
    s = F.lower(F.regexp_replace(F.col(text), r"(?U)[\s\u200b\ufeff]+", " "))
    s = F.trim(F.regexp_replace(F.trim(s), r"^(?:published|updated|posted)(?: on)?:? ", ""))
    df = df.withColumn("_s", s)
    c = F.col("_s")
    day = rf"(?:(?:{WEEKDAYS})\.?,? )?"
    # Each pattern has its groups in one order: the three parts of the date, then what follows it.
    shapes = {
        "ymd": r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:$|[t, ]+(.*)$)",
        "compact": r"^(\d{4})(\d{2})(\d{2})(?:$|[t ]?(\d{2}\d{2}(?:\d{2})?.*)$)",
        "num": rf"^{day}(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})(?:$|[t, ]+(.*)$)",
        "dmon": rf"^{day}(\d{{1,2}})(?:\.|er|st|nd|rd|th|º)?(?: de| of)? (\p{{L}}+)\.?,?(?: de)? (\d{{4}})(?:$|[t, ]+(.*)$)",
        "mond": rf"^{day}(\p{{L}}+)\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:$|[t, ]+(.*)$)",
        "cjk": r"^(\d{4}) ?年 ?(\d{1,2}) ?月 ?(\d{1,2}) ?日(?:$| ?(.*)$)",
        "ordinal": r"^(\d{4})-?(\d{3})()(?:$|[t ]+(.*)$)",
        "week": r"^(\d{4})-?w(\d{2})-?(\d)(?:$|[t ]+(.*)$)",
    }
    parts = F.when(c.rlike(r"^(?:\d{10}|\d{13}|\d{16}|\d{19})$"), F.concat(F.lit("epoch|"), c))
    for name, rx in shapes.items():
        parts = parts.when(c.rlike(rx), F.regexp_replace(c, rx, f"{name}|$1|$2|$3|$4"))
    # Split once: later columns refer to the fields by position, so no pattern is matched twice.
    df = df.withColumn("_f", F.split(parts, r"\|", 5))
    df = df.withColumns({"_k": F.col("_f")[0], **{f"_g{i}": F.get("_f", F.lit(i)) for i in (1, 2, 3, 4)}})
    k = F.col("_k")
    i1, i2, i3 = (F.col(f"_g{i}").try_cast("int") for i in (1, 2, 3))
    mdy = order.eqNullSafe(F.lit("mdy"))
    year = F.when(k.isin("num", "dmon", "mond"), F.when(F.length("_g3") == 2, i3 + 2000).otherwise(i3)).otherwise(i1)
    month = (
        F.when(k == "num", F.when(mdy, i1).otherwise(i2)).when(k == "dmon", _month_number(F.col("_g2"))).when(k == "mond", _month_number(F.col("_g1"))).when(k.isin("ordinal", "week"), F.lit(1)).otherwise(i2)
    )
    dom = F.when(k == "num", F.when(mdy, i2).otherwise(i1)).when(k == "dmon", i1).when(k == "mond", i2).when(k.isin("ordinal", "week"), F.lit(1)).otherwise(i3)
    df = df.withColumns({"_y": year, "_m": month, "_d": dom})
    y, m, d = F.col("_y"), F.col("_m"), F.col("_d")
    df = df.withColumn("_n", F.unix_date(F.concat_ws("-", y, m, d).try_cast("date")).cast("long"))
    first = F.col("_n")  # of ordinal and week dates: 1 January
    monday1 = first + 3 - F.pmod(first + 6, F.lit(7))  # the Monday of the week of 4 January; 1970-01-01 was a Thursday
    df = df.withColumn("_n", F.when(k == "ordinal", first + i2 - 1).when((k == "week") & i3.between(1, 7), monday1 + (i2 - 1) * 7 + i3 - 1).when(~k.isin("ordinal", "week"), first))
    date = F.date_from_unix_date(F.col("_n").cast("int"))
    days = F.when(F.when(k == "ordinal", F.year(date) == y).when(k == "week", F.weekofyear(date) == i2).otherwise(True), F.col("_n"))
    clock = r"^(?:at |à |um |a las |t|, )?(\d{1,2}) ?(?::|h|時) ?(\d{2})(?::(\d{2})(?:[.,](\d+))?)? ?((?:a\.?m|p\.?m)(?![a-z])\.?)?(?: ?(?:uhr|h|分)(?![a-z]))? ?(z|(?:utc|gmt)?[+-]\d{2}:?(?:\d{2})?|[a-z]{2,5}|[a-z_]+(?:/[a-z_+-]+)+)?$"
    tight = r"^(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?()(z|[+-]\d{2}:?(?:\d{2})?)?$"
    rest = F.col("_g4")
    fields = "$1|$2|$3|$4|$5|$6"
    df = df.withColumn("_t", F.split(F.when(rest.rlike(clock), F.regexp_replace(rest, clock, fields)).when((k == "compact") & rest.rlike(tight), F.regexp_replace(rest, tight, fields)), r"\|", 6))
    t = [F.get("_t", F.lit(i)) for i in range(6)]
    df = df.withColumns({"_h": t[0].try_cast("int"), "_mi": t[1].try_cast("int"), "_se": F.coalesce(t[2].try_cast("int"), F.lit(0)), "_fr": t[3], "_ap": F.substring(t[4], 1, 1), "_z": t[5]})
    h, ap, z = F.col("_h"), F.col("_ap"), F.col("_z")
    hour = F.when(ap == "a", F.when(h == 12, 0).otherwise(h)).when(ap == "p", F.when(h == 12, 12).otherwise(h + 12)).otherwise(h)
    possible = F.when(F.col("_t").isNull(), True).otherwise((hour < 24) & (F.col("_mi") < 60) & (F.col("_se") < 60) & (ap.isin("a", "p").eqNullSafe(False) | h.between(1, 12)))
    sign = F.when(F.regexp_extract(z, r"([+-])", 1) == "-", -1).otherwise(1)
    numeric = F.when(z.rlike(r"[+-]\d"), sign * (F.regexp_extract(z, r"[+-](\d{2})", 1).try_cast("int") * 3600 + F.coalesce(F.regexp_extract(z, r"[+-]\d{2}:?(\d{2})", 1).try_cast("int"), F.lit(0)) * 60))
    abbr = F.try_element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), z) * 60
    digits = F.length("_s")
    scale = F.when(digits == 10, F.lit(1_000_000)).when(digits == 13, F.lit(1_000)).otherwise(F.lit(1)).cast("long")
    number = F.when(k == "epoch", F.when(digits == 19, F.expr("try_cast(_s as bigint) div 1000")).otherwise(c.try_cast("long") * scale))
    p = F.when(
        number.isNotNull() | (days.isNotNull() & possible),
        F.struct(
            days.alias("day"),
            F.when(F.col("_t").isNotNull(), hour * 3600 + F.col("_mi") * 60 + F.col("_se")).otherwise(0).cast("long").alias("secs"),
            F.coalesce(F.rpad(F.substring(F.col("_fr"), 1, 6), 6, "0").try_cast("long"), F.lit(0).cast("long")).alias("micros"),
            F.coalesce(numeric, abbr).cast("long").alias("off_secs"),
            F.when(z.contains("/"), z).alias("zone"),
            number.alias("epoch_us"),
            F.when(z.rlike("^[a-z]{2,5}$") & abbr.isNull(), z).alias("odd_zone"),
        ),
    )
    return df.withColumn("p", p).drop("_s", "_f", "_k", "_g1", "_g2", "_g3", "_g4", "_y", "_m", "_d", "_n", "_t", "_h", "_mi", "_se", "_fr", "_ap", "_z")


def _offset_intervals(name: str, years: tuple[int, int]) -> list[tuple[float, float, int]]:
    """(from, to, offset) in UTC seconds, in order, over the years and a day on both sides."""
    zone = ZoneInfo(name)

    def off(t: int) -> int:
        return int((datetime.fromtimestamp(t, UTC)).astimezone(zone).utcoffset().total_seconds())

    lo = int(datetime(years[0], 1, 1, tzinfo=UTC).timestamp()) - 400 * 86400
    hi = int(datetime(years[1] + 1, 1, 1, tzinfo=UTC).timestamp()) + 2 * 86400
    out, start, now, t = [], lo, off(lo), lo
    while t < hi:
        nxt = min(t + 7 * 86400, hi)
        if off(nxt) != now:
            a, b = t, nxt
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if off(mid) == now else (a, mid)
            out.append((start, b, now))
            start, now = b, off(b)
            t = b
        else:
            t = nxt
    return [*out, (start, hi, now)]


def zone_intervals(pairs: DataFrame) -> DataFrame:
    """zone (lower case), year, spans array<struct<lo, hi, off>>: per row of `pairs` (zone, year) the offset intervals that touch the local year, in local seconds, in the order of time.

    Zones are names of the zone database in any case; its rules go on for years to come. At most one row per zone and
    year that occurs, however many records there are.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {z.lower(): z for z in available_timezones()}
        for pdf in batches:
            rows = []
            for zone, year in zip(pdf["zone"], pdf["year"], strict=True):
                a = (datetime(year, 1, 1) - datetime(1970, 1, 1)) // timedelta(seconds=1)
                b = (datetime(year + 1, 1, 1) - datetime(1970, 1, 1)) // timedelta(seconds=1)
                spans = [(x + o, y + o, o) for x, y, o in _offset_intervals(names[zone], (year, year))]
                rows.append((zone, year, [s for s in spans if s[1] > a - 86400 and s[0] < b + 86400]))
            yield pd.DataFrame(rows, columns=["zone", "year", "spans"])

    return pairs.select("zone", "year").mapInPandas(make, "zone string, year int, spans array<struct<lo:bigint,hi:bigint,off:bigint>>")


def resolve_local(df: DataFrame, zone: str, local: str) -> DataFrame:
    """Adds `off` (seconds) and `clock` (`once`, `twice`, `skipped`, null without a zone known) for local seconds in a zone.

    A time that occurs twice takes the first offset; one that clocks skip takes the offset before the change. `df` is a
    materialised table: it is read once for the zones and years that occur, and once for the join.
    """
    year = F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(local) / 86400).cast("int")))
    df = df.withColumns({"_zone": F.lower(F.col(zone)), "_year": F.least(F.greatest(year, F.lit(YEARS[0])), F.lit(YEARS[1]))})
    known = [z.lower() for z in sorted(available_timezones())]
    spans = materialise(zone_intervals(df.where(F.col("_zone").isin(known) & F.col("_year").isNotNull()).select(F.col("_zone").alias("zone"), F.col("_year").alias("year")).distinct()))
    df = join_sized(df, spans.select(F.col("zone").alias("_zone"), F.col("year").alias("_year"), "spans"), ["_zone", "_year"], "left", spans.count(), 20_000)
    t = F.col(local)
    df = df.withColumn("_hit", F.filter("spans", lambda x: (x["lo"] <= t) & (t < x["hi"]))).withColumn("_before", F.filter("spans", lambda x: x["hi"] <= t))
    n = F.size("_hit")
    off = F.when(n >= 1, F.col("_hit")[0]["off"]).otherwise(F.try_element_at("_before", F.lit(-1))["off"])
    clock = F.when(F.col("spans").isNull(), None).when(n >= 2, "twice").when(n == 1, "once").otherwise("skipped")
    return df.withColumns({"off": off, "clock": clock}).drop("_zone", "_year", "_hit", "_before", "spans")


def site_host(url: str) -> Column:
    """The host of a url in lower case, without user, port and a leading `www.` or `m.`."""
    host = F.regexp_extract(F.trim(F.col(url)), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(F.col(url).isNotNull(), F.regexp_replace(F.lower(host), r"^(?:www|m)\.", ""))


def normalise_dates(records: DataFrame, sites: DataFrame, id_col: str, text: str, url: str) -> DataFrame:
    """record_id, utc_micros, clock: one instant per record whose text fixes at least a day.

    An offset, abbreviation or known zone in the text holds; otherwise the zone of the url's site, or UTC where the url is
    null or its site unknown. An abbreviation or zone that is not known fixes no instant: utc_micros is null and clock
    `unknown`. Null, empty and undated texts give no row; ids that repeat give one row (of different instants the least);
    null ids are kept as one record. `sites` has a row per host (fixed in number, so it is broadcast) with zone_name and
    date_order; a host given twice counts once, its least zone. Columns other than those named are not read.
    """
    site = sites.groupBy(F.lower("host").alias("host")).agg(F.min("zone_name").alias("zone_name"), F.min("date_order").alias("date_order"))
    base = records.select(F.col(id_col).alias("record_id"), F.col(text).alias("text"), site_host(url).alias("host")).join(F.broadcast(site), "host", "left")
    parsed = parse_dates(base, "text", F.col("date_order")).select("record_id", "p", "zone_name")
    known = [z.lower() for z in sorted(available_timezones())]
    p = F.col("p")
    unknown = F.coalesce(p["odd_zone"], F.when(~p["zone"].isin(known), p["zone"]))
    zone = F.when(p["off_secs"].isNull() & p["epoch_us"].isNull() & unknown.isNull(), F.coalesce(p["zone"], "zone_name", F.lit("UTC")))
    # Parsed once: written before it is read for the zones that occur and for the join. Undated records are dropped only
    # when read back, as a filter on parsed fields would repeat the whole parsing in its condition.
    timed = materialise(parsed.select("record_id", "p", unknown.isNotNull().alias("_odd"), zone.alias("_z"), (p["day"] * 86400 + p["secs"]).alias("_t"))).where("p is not null")
    timed = resolve_local(timed, "_z", "_t")
    offset = F.coalesce(p["off_secs"], "off", F.lit(0))
    micros = F.coalesce(p["epoch_us"], F.when(~F.col("_odd"), (F.col("_t") - offset) * 1_000_000 + p["micros"]))
    clock = F.when(F.col("_odd"), "unknown").otherwise(F.col("clock"))
    one = timed.select("record_id", micros.alias("utc_micros"), clock.alias("clock"))
    return one.groupBy("record_id").agg(F.min("utc_micros").alias("utc_micros"), F.coalesce(F.min_by("clock", "utc_micros"), F.min("clock")).alias("clock"))
