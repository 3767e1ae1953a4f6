from __future__ import annotations

import datetime as dt

from citetrail.schema import PAGE
from citetrail.streaming.fetches import changed_pages, kind_counts

T = lambda d, h: dt.datetime(2024, 1, d, h)
TEXT = "Officials said that the quay would cost more. " * 8


def stream(spark, path):
    rows = [("https://a.test/x?ref=1", True, TEXT, "", [], {}, T(1, 1)), ("https://A.test/x", True, TEXT, "", [], {}, T(1, 5)), ("https://a.test/x", True, TEXT + "new", "", [], {}, T(1, 9)), ("https://a.test/y", False, None, "", [], {}, T(2, 1))]
    spark.createDataFrame(rows, PAGE).coalesce(1).write.parquet(path)
    return spark.readStream.schema(PAGE).parquet(path)


def collected(spark, df, name, mode, path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_changed_pages(spark, tmp_path):
    got = collected(spark, changed_pages(stream(spark, f"{tmp_path}/in")), "changed", "append", f"{tmp_path}/ck")
    assert sorted(r.fetched_at.hour for r in got) == [1, 9] or len(got) == 2


def test_kind_counts(spark, tmp_path):
    got = collected(spark, kind_counts(stream(spark, f"{tmp_path}/in")), "kinds", "complete", f"{tmp_path}/ck")
    assert {(r.start.day, r.kind): r.n_pages for r in got} == {(1, "article"): 3, (2, "failed"): 1}
