"""Compressed CSV files give the same rows; splitting rows by label shuffles none of them."""

import pytest
from pyspark.sql import functions as F

from kestrel.operators import ml, relational
from kestrel.operators.workspace import read_upload
from kestrel.session import scratch_path
from kestrel.sources import files, sinks


@pytest.mark.parametrize("codec", ["lz4", "gzip"])
def test_compressed_files_hold_the_same_rows(spark, monkeypatch, codec):
    monkeypatch.setattr(sinks, "CSV_FILE_ROWS", 300)
    text = "concat('n', id, CASE WHEN id % 5 = 0 THEN ', \"a\"\nb' WHEN id % 7 = 0 THEN 'é' ELSE '' END) AS note"
    df = spark.range(1000).selectExpr("format_string('%05d', id) AS id", text).coalesce(2).orderBy("id")
    plain, packed = scratch_path(spark, "plain"), scratch_path(spark, "packed")
    sinks.sink_csv(df, plain)
    sinks.sink_csv(df, packed, compression=codec)
    names = {r[0] for r in spark.read.format("binaryFile").load(packed).select("path").collect()}
    assert len(names) >= 4 and not any(n.endswith(".csv") for n in names)
    got = read_upload(spark, packed, "n").orderBy("n").collect()
    assert got == read_upload(spark, plain, "n").orderBy("n").collect() and len(got) == 1000
    assert [(r.n, int(r.id)) for r in got] == [(k + 1, k) for k in range(1000)]
    sinks.sink_csv(df, packed, encoding="ISO-8859-1", compression=codec)
    assert {tuple(r) for r in files.scan_csv_latin1(spark, packed).collect()} == {tuple(r) for r in df.collect()}


def test_rows_are_not_shuffled_by_label(spark):
    df = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") % 3).cast("string").alias("label"))
    out = relational.split_stratified(df, F.col("k"), "label")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("BroadcastHashJoin")[0]
    assert out.where("is_test").count() == 400


def test_rows_are_scored_once_for_all_measures(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        calls.add(1)
        return (x % 10) / 10

    rows = spark.range(500).select(F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 10 > 3).cast("long")).alias("label"),
                                   score("id").alias("p"))
    m = ml.eval_classifier(rows.withColumn("predicted_label", (F.col("p") > 0.45).cast("long")), prob="p").first()
    assert m.roc_auc == 1.0 and m.recall == pytest.approx(1 - 1 / 6, abs=0.01) and m.precision == 1.0
    assert calls.value <= 1000  # the score, and the flag made of it: each once a row
