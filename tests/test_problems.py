"""Orphan references, hierarchies and timestamps: edge cases, and plain restatements on random inputs."""

from __future__ import annotations

import datetime as dt
import random
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from citetrail.operators import hierarchy as H
from citetrail.operators.orphans import Child, orphan_counts, orphan_references
from citetrail.operators.timestamps import normalise_dates

T = lambda d, m=1: dt.datetime(2024, m, d)
PARENT = "analysis_id string, node_id string, loaded_at timestamp, deleted_at timestamp, ref_id string"
CHILD = "id string, analysis_id string, source_node_id string, loaded_at timestamp, key string, gone string"


def test_orphans(spark):
    parents = spark.createDataFrame(
        [("t", " S-1 ", T(1), None, ""), ("t", "s-2", T(5), None, ""), ("t", "s-3", T(1), None, ""), ("t", "s-3", T(3), T(3), ""), ("t", "s-4", T(2), T(2), ""), ("t", "s-4", T(3), None, ""), ("t", None, T(1), None, ""), ("t", "s-5", None, None, ""),
         ("t", "s-6", T(1), None, ""), ("t", "s-6", T(1), T(1), "")], PARENT)
    refs = [("a", "t", "s-1", T(2)), ("b", "t", "S-2", T(2)), ("c", "t", "s-2 ", T(5)), ("d", "t", "s-3", T(2)), ("e", "t", "s-4", T(9, 2)), ("f", "t", "nope", T(9, 2)), ("g", "t", "  ", T(2)), ("h", "t", None, T(2)), ("i", "x", "s-1", T(2)), ("j", None, "s-1", T(2)), ("k", "t", "s-5", T(2)), ("l", "t", "s-6", T(2)), ("m", "t", "s-1", None), ("a", "t", "s-1", T(2))]
    child = spark.createDataFrame([(*r, "", "") for r in refs], CHILD)
    got = orphan_references(parents, [Child("edges", child)])
    assert {(r.ref_id, r.period, r.reason) for r in got.collect()} == {
        ("b", "2024-01", "late"), ("d", "2024-01", "deleted"), ("f", "2024-02", "missing"), ("i", "2024-01", "missing"), ("j", "2024-01", "missing"), ("k", "2024-01", "missing"), ("l", "2024-01", "deleted"), ("m", None, "late")}
    assert {(r.period, r.reason): r.n_refs for r in orphan_counts(got).collect()}[("2024-01", "missing")] == 3
    assert orphan_references(parents.limit(0), [Child("edges", child)]).count() == 11
    assert orphan_references(parents, [Child("edges", child.limit(0))]).count() == 0


def brute(links):
    nodes, kids, src = set(), {}, set()
    for c, p in links:
        nodes |= {c, p}
        kids.setdefault(p, set()).add(c)
        src.add(c)

    def reach(start):
        seen, level, d = {}, {start}, 0
        while level:
            d += 1
            level = {k for n in level for k in kids.get(n, ())} - set(seen)
            seen |= {k: d for k in level}
        return seen

    out = set()
    for r in nodes - src:
        out |= {(r, r, 0), *((n, r, d) for n, d in reach(r).items())}
    return out | {(n, "(cycle)", -1) for n in nodes if n in reach(n)}


def test_hierarchy(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for s in range(14):
        n = rng.randrange(2, 14)
        links = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randrange(1, 2 * n))} if s else {(f"c{i + 1}", f"c{i}") for i in range(30)} | {("c5", "c20")}
        rows += [(f"t{s}", c.upper() if rng.random() < 0.3 else f" {c}", p) for c, p in links] * 2
        want |= {(f"t{s}", *x) for x in brute(links)}
    rows += [("t1", None, "x"), ("t1", "x", "  "), ("t1", "", "x")]
    df = spark.createDataFrame(rows, "analysis_id string, source_node_id string, target_node_id string").withColumn("scope", F.lit("clash"))
    for task_rows in (H.TASK_ROWS, 40, 0):
        assert {tuple(r) for r in H.hierarchy(df, task_rows=task_rows).select("scope", "node", "root", "depth").collect()} == want
    assert H.hierarchy(df.limit(0)).count() == 0


def test_paths_and_descendants(spark):
    df = spark.createDataFrame([("t", "b", "a"), ("t", "c", "b"), ("t", "c", "a"), ("t", "d", "c")], "analysis_id string, source_node_id string, target_node_id string")
    for task_rows in (H.TASK_ROWS, 0):
        assert {(r.node, r.path) for r in H.paths_from_roots(df, task_rows=task_rows).collect()} == {("a", "a"), ("b", "a/b"), ("c", "a/c"), ("d", "a/c/d")}
        assert {(r.node, r.descendant, r.depth) for r in H.descendants(df, task_rows=task_rows).collect()} == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)}


def test_small_and_large_scopes_agree(spark):
    rng = random.Random(5)
    rows = [(f"t{s}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for s, n in enumerate((3, 9, 30)) for _ in range(int(1.3 * n))]
    df = spark.createDataFrame([*rows, (None, "b", "a")], "analysis_id string, source_node_id string, target_node_id string")
    for f in (H.paths_from_roots, H.descendants):
        one, all_ = f(df), f(df, task_rows=0)
        assert one.columns == all_.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, all_.collect()))


def test_dates(spark):
    sites = spark.createDataFrame([("a.test", "America/New_York", "mdy"), ("b.test", "Europe/Berlin", "dmy"), ("b.test", "Europe/Berlin", "dmy")], "host string, zone_name string, date_order string")
    utc = lambda *a, us=0: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp()) * 1_000_000 + us
    A, B = "https://www.a.test/x", "https://M.B.test/y"
    cases = {
        ("2023-03-12 02:30", A): utc(2023, 3, 12, 7, 30),  # skipped: offset before
        ("2023-11-05 01:30", A): utc(2023, 11, 5, 5, 30),  # twice: first
        ("2023-03-26 02:30", B): utc(2023, 3, 26, 1, 30),
        ("2023-10-29 02:30", B): utc(2023, 10, 29, 0, 30),
        ("12/5/2021 9:57 p.m.", A): utc(2021, 12, 6, 2, 57),
        ("5/12/21", B): utc(2021, 12, 4, 23),
        ("13/1/2021", A): None,
        ("2024-02-29", None): utc(2024, 2, 29),
        ("2023-02-29", None): None,
        ("Published: Wed, 14 Sep 2022 09:37:26 -0330 ", B): utc(2022, 9, 14, 13, 7, 26),
        ("6 Nov 2022 2:29 AM CST", B): utc(2022, 11, 6, 8, 29),
        ("2021-05-03 20:04:37 America/Los_Angeles", B): utc(2021, 5, 4, 3, 4, 37),
        ("2021-05-03 20:04:37 Mars/Olympus", B): None,
        ("2021-05-03 20:04:37 QZT", B): None,
        ("2021-05-03 12:00 SGT", A): utc(2021, 5, 3, 4),
        ("2021-05-03 12:00 HKT", A): utc(2021, 5, 3, 4),
        ("1965-07-01 12:00", A): utc(1965, 7, 1, 16),
        ("2055-07-01 12:00", A): utc(2055, 7, 1, 16),
        ("9999-12-31 12:00", None): utc(9999, 12, 31, 12),
        ("1er juin 2021 à 13h33", None): utc(2021, 6, 1, 13, 33),
        ("27. Mai 2022, 12:05 Uhr", None): utc(2022, 5, 27, 12, 5),
        ("30 de agosto de 2021, 02:36 h", None): utc(2021, 8, 30, 2, 36),
        ("2025年5月14日", None): utc(2025, 5, 14),
        ("2020-366", None): utc(2020, 12, 31),
        ("2021-366", None): None,
        ("2020-W53-5", None): utc(2021, 1, 1),
        ("2021-W53-1", None): None,
        ("20250507T201410Z", B): utc(2025, 5, 7, 20, 14, 10),
        ("1604329612", B): 1604329612 * 10**6,
        ("1678655019552", B): 1678655019552 * 10**3,
        ("1749990810191449", B): 1749990810191449,
        ("2022-05-29T13:45:35.123456789Z", B): utc(2022, 5, 29, 13, 45, 35, us=123456),
        ("2022-05-29 25:00", B): None,
        ("12:61", None): None,
        ("March 2024", None): None,
        ("last week", None): None,
        ("", None): None,
        (None, None): None,
    }
    rows = [(str(i), d, u, "x") for i, (d, u) in enumerate(cases)] * 2
    got = {r.record_id: r.utc_micros for r in normalise_dates(spark.createDataFrame(rows, "id string, date string, url string, zone_name string"), sites, "id", "date", "url").collect()}
    assert {d: got.get(str(i)) for i, d in enumerate(cases)} == cases
    odd = {i for i, (d, _) in enumerate(cases) if d and ("Mars" in d or "QZT" in d)}
    assert {int(i) for i, m in got.items() if m is None} == odd
    assert normalise_dates(spark.createDataFrame([], "id string, date string, url string"), sites, "id", "date", "url").count() == 0


def test_all_local_hours(spark):
    zone = ZoneInfo("Australia/Sydney")
    sites = spark.createDataFrame([("a.test", "Australia/Sydney", "dmy")], "host string, zone_name string, date_order string")
    times = [dt.datetime(2023, 3, 31) + dt.timedelta(minutes=30 * k) for k in range(150)] + [dt.datetime(2023, 9, 30) + dt.timedelta(minutes=30 * k) for k in range(150)]
    rows = [(str(i), t.isoformat(sep=" "), "https://a.test/") for i, t in enumerate(times)]
    got = {r.record_id: r.utc_micros for r in normalise_dates(spark.createDataFrame(rows, "id string, date string, url string"), sites, "id", "date", "url").collect()}
    for i, t in enumerate(times):
        want = t - t.replace(tzinfo=zone, fold=0).utcoffset()
        assert got[str(i)] == int((want - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6, t
