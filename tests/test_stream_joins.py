"""Repeated deliveries, predictions against outcomes as streams, PSI from sketches."""

import datetime as dt

from pyspark.sql import functions as F

from kestrel.session import scratch_path
from kestrel.streaming import monitoring as M
from kestrel.streaming import streams as S


def _first(spark, source, sink):
    lines = spark.readStream.schema("k int, n int, v string, _key0_of int").parquet(source)
    (S.first_arrivals(lines, ["k", "n"]).writeStream.foreachBatch(lambda b, i: S.write_batch(b, sink, i))
     .option("checkpointLocation", S.checkpoint_of(sink)).trigger(availableNow=True).start().awaitTermination())
    return sorted((r.k or -1, r.n, r.v) for r in spark.read.parquet(sink).collect())


def test_repeated_deliveries_count_once_over_restarts(spark):
    source, sink = scratch_path(spark, "deliveries"), scratch_path(spark, "first")
    schema = "k int, n int, v string, _key0_of int"
    spark.createDataFrame([(1, 1, "a", 0), (1, 2, "b", 0), (None, 1, "x", 0), (None, 1, "y", 0)], schema).write.parquet(source)
    want = [(-1, 1, "x"), (-1, 1, "y"), (1, 1, "a"), (1, 2, "b")]
    assert _first(spark, source, sink) == want
    # the same lines under another file name, one changed, one new, one row without a key repeated
    spark.createDataFrame([(1, 1, "changed", 0), (1, 2, "b", 0), (2, 1, "c", 0), (None, 1, "x", 0)], schema).write.mode("append").parquet(source)
    assert _first(spark, source, sink) == sorted([*want, (2, 1, "c")])
    assert _first(spark, source, sink) == sorted([*want, (2, 1, "c")])


def test_scored_lines_delivered_twice(spark):
    from kestrel.sources.tables import Tables
    from tests.conftest import SMOKE
    landed, sink = scratch_path(spark, "landed"), scratch_path(spark, "scored")
    lines = Tables(spark, SMOKE).lineitem
    lines.write.parquet(landed)
    run = lambda: spark.read.parquet(S.stream_score_orders(spark, SMOKE, sink, line_keys=lines.columns, landed=landed)).count()
    assert run() == lines.count()
    lines.write.mode("append").parquet(landed)
    assert run() == lines.count()


def _day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_accuracy_of_late_outcomes(spark):
    predictions, outcomes, sink = (scratch_path(spark, n) for n in ("p", "o", "s"))

    def land(path, rows, schema):
        spark.createDataFrame([(None if k is None else str(k), *r) for k, *r in rows], schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        S.stream_accuracy(spark, predictions, outcomes, sink, bound="20 days", late="10 days", period="month")
        return {str(r.period): (r.n, r.correct) for r in S.read_accuracy(spark, sink).collect()}

    p, o = "key string, predicted_at timestamp, predicted long", "key string, observed_at timestamp, actual long"
    land(predictions, [(1, _day(0), 1), (2, _day(1), 1), (3, _day(40), 0), (4, _day(2), 1), (None, _day(2), 1)], p)
    land(outcomes, [(1, _day(5), 1), (2, _day(0), 1), (4, _day(30), 1), (None, _day(3), 1)], o)  # 2 before, 4 beyond the bound
    assert run() == {"2024-01-01": (1, 1)}
    land(outcomes, [(3, _day(45), 1), (2, _day(21), 0)], o)  # an outcome that comes later than others, within 10 days of the newest
    assert run() == {"2024-01-01": (2, 1), "2024-02-01": (1, 0)}
    assert run() == {"2024-01-01": (2, 1), "2024-02-01": (1, 0)}
    land(predictions, [(9, _day(200), 1)], p)
    land(outcomes, [(9, _day(201), 1)], o)
    assert run()["2024-07-01"] == (1, 1)
    land(predictions, [(10, _day(3), 1)], p)  # months late
    land(outcomes, [(10, _day(4), 1)], o)
    assert run() == {"2024-01-01": (2, 1), "2024-02-01": (1, 0), "2024-07-01": (1, 1)}


def test_psi_from_sketches_near_the_exact_one(spark):
    rows = (spark.range(60_000).select((F.col("id") % 6).cast("int").alias("day"), F.rand(7).alias("u"))
            .select("day", (F.col("u") ** F.when(F.col("day") == 5, 3).otherwise(1)).alias("v")))
    rows = spark.createDataFrame(rows.collect(), "day int, v double")
    odd = spark.createDataFrame([(0, None), (1, float("nan"))], "day int, v double")
    sketches = M.score_sketches(rows.unionByName(odd), "v", "day")
    assert sum(r.n for r in sketches.collect()) == 60_000 and max(len(r.sketch) for r in sketches.collect()) < 40_000
    got = {r.day: (r.psi, r.drift_warning) for r in M.psi_from_sketches(sketches, "day", F.col("day") < 3).collect()}
    exact = {r.day: (r.psi, r.drift_warning) for r in M.psi_drift(rows, "v", "day", F.col("day") < 3).collect()}
    assert got.keys() == exact.keys()
    for day, (psi, warned) in exact.items():
        assert abs(got[day][0] - psi) < 0.01 + 0.05 * psi and got[day][1] == warned
    assert exact[5][1] and not exact[4][1]
    none = M.psi_from_sketches(sketches, "day", F.col("day") > 90).collect()
    assert len(none) == 6 and all(r.psi is None and r.drift_warning is None for r in none)
    assert M.psi_from_sketches(sketches.limit(0), "day", F.lit(True)).count() == 0
