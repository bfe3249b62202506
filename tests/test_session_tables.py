import pytest


def test_scans_keep_their_partitions(spark):
    """A table is opened as it lies: no shuffle is put over the scan."""
    from kestrel.sources.tables import Tables
    plan = Tables(spark, "/root/testdata/sf0.001").lineitem._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_checkpoint_root_uses_session_setting(spark):
    from kestrel.session import checkpoint_root, scratch_path
    root = checkpoint_root(spark)
    assert root == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "x").startswith(root + "/x-")


def test_materialize_reads_fixed_partitions(spark):
    from pyspark.sql import functions as F
    from kestrel.session import materialize
    df = spark.range(0, 1000).repartitionByRange(5, "id").withColumn("pid", F.spark_partition_id())
    m = materialize(df)
    a = {(r["id"], r["pid"]) for r in m.collect()}
    b = {(r["id"], r["pid"]) for r in m.collect()}
    assert a == b and len(a) == 1000


def test_cluster_requires_shared_folder(monkeypatch, spark):
    from kestrel import session as S

    class FakeConf:
        def get(self, key, default=None):
            return default

    class FakeSC:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class FakeSpark:
        conf = FakeConf()
        sparkContext = FakeSC()

    with pytest.raises(RuntimeError):
        S.checkpoint_root(FakeSpark())
