"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from datetime import date

from pyspark.sql import SparkSession

# Reports are reproducible: every "now()/current_date" of the reference is
# replaced by this explicit date unless the caller passes another one.
DEFAULT_AS_OF = date(2001, 6, 1)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "kestrel") -> SparkSession:
    """Session with AQE (coalescing + skew-join splitting) and UTC clock.

    The number of shuffle partitions and the driver's memory stay as the
    cluster configures them unless the caller asks (``shuffle_partitions``,
    ``KESTREL_DRIVER_MEMORY``); a local master, where the driver does all the
    work, gets 16 GB.

    ANSI mode stays on (Spark 4 default), so operators use try_* casts
    and try_divide wherever the reference tolerated bad values.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    memory = os.environ.get("KESTREL_DRIVER_MEMORY", "16g" if master and master.startswith("local") else None)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    spark = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # wide ETL projections generate methods above the JVM's 8 KB JIT limit;
        # without this flag they run interpreted (several times slower)
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compile_wide_projections(spark: SparkSession) -> None:
    """Wide projections (the ETL's has 50 columns) fused into one method of more than
    8,000 bytes are never compiled by the JVM, unless it was started with
    ``-XX:-DontCompileHugeMethods``.  Beyond that size Spark shall cut them into small
    methods instead.  A limit that the cluster sets itself stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, "8000")


_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    A folder set through ``SparkContext.setCheckpointDir`` counts as well.
    Only when there is neither (local tests) do we create one under the
    system temp dir.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    # kept here: the setting itself can't be changed in a running session
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="kestrel-ckpt-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint root for written tables."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "frame"):
    """Parquet in the shared folder, read back: several branches of one plan
    see the same rows, columns are pruned, and a lost executor re-reads files
    instead of recomputing (and re-sampling)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
