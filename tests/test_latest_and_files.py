from pyspark.sql import functions as F

from kestrel.operators import latest as L
from kestrel.sources import files as FS
from kestrel.sources import sinks as SK


def test_keep_latest_tie_break(spark):
    df = spark.createDataFrame([(1, "2001-01-02", "a"), (1, "2001-01-02", "b"), (1, "2001-01-01", "c"),
                                (2, "2000-01-01", "d")], "k int, d string, id string")
    got = {r["k"]: r["id"] for r in L.keep_latest(df, ["k"], [F.col("d").desc(), F.col("id").desc()]).collect()}
    assert got == {1: "b", 2: "d"}


def test_row_number_in_source_contiguous(spark):
    df = spark.range(0, 1000, numPartitions=7)
    rn = L.row_number_in_source(df, "rn")
    assert sorted(r["rn"] for r in rn.collect()) == list(range(1, 1001))


def test_file_order_numbering_multi_file(spark, tmp_path):
    base = tmp_path / "csv"
    base.mkdir()
    # unequal file sizes: Spark packs / orders splits by size, numbering must not
    (base / "part-0.csv").write_text("v\n" + "\n".join(str(i) for i in range(0, 3)) + "\n")
    (base / "part-1.csv").write_text("v\n" + "\n".join(str(i) for i in range(3, 300)) + "\n")
    (base / "part-2.csv").write_text("v\n" + "\n".join(str(i) for i in range(300, 310)) + "\n")
    df = spark.read.option("header", True).csv(str(base))
    got = sorted((r["row_number"], int(r["v"])) for r in FS.number_rows_in_file_order(df).collect())
    assert got == [(i + 1, i) for i in range(310)]


def test_insert_if_absent_and_soft_delete(spark, tmp_path):
    from datetime import datetime
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    SK.sink_append(a, path)
    b = spark.createDataFrame([("y", 9), ("z", 3), ("z", 4)], "k string, v int")
    assert SK.sink_insert_if_absent(b, path, ["k"], order=["v"]) == 1
    got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {"x": 1, "y": 2, "z": 3}
    s = spark.createDataFrame([("x", True, datetime(2001, 1, 1))], "k string, is_active boolean, updated_at timestamp")
    p2 = str(tmp_path / "s")
    SK.sink_append(s, p2)
    SK.sink_soft_delete(spark, p2, ["k"], F.col("k") == "x", datetime(2001, 6, 1))
    cur = SK.current_version(spark.read.parquet(p2), ["k"]).first()
    assert cur["is_active"] is False


def test_encoding_fallback(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_bytes("name\nS\xe3o Paulo\n".encode("latin-1"))
    assert FS.detect_encoding(spark, str(p)) == "ISO-8859-1"
    q = tmp_path / "utf.csv"
    q.write_bytes("name\nS\xe3o Paulo\n".encode("utf-8"))
    assert FS.detect_encoding(spark, str(q)) == "UTF-8"
