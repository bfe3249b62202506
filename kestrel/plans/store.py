"""Written intermediate tables (the ETL outputs and the warehouse).

The source application runs its ETL once and every later job reads the
stored clean / feature tables; the warehouse is stored too.  Here each such
table is produced by its Spark job on first use, written as Parquet under
the shared folder named by ``spark.checkpoint.dir`` and read back from
there afterwards.  The written table cuts the lineage: a lost executor
re-reads files instead of recomputing the joins that built them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from kestrel.session import scratch_path

_PATHS: dict[tuple, str] = {}
_LOCKS: dict[tuple, threading.Lock] = {}
_GUARD = threading.Lock()


def stored(spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, scope, name)
    with _GUARD:
        lock = _LOCKS.setdefault(key, threading.Lock())
    with lock:  # one builder per table even when jobs run concurrently
        path = _PATHS.get(key)
        if path is None:
            path = scratch_path(spark, f"table-{name}")
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
            _PATHS[key] = path
    return spark.read.parquet(path)


def build_all(getters: Iterable[Callable[[], DataFrame]], parallel: int = 4) -> None:
    """Write several stored tables as concurrent Spark jobs (independent
    tables overlap; a shared dependency is still built once)."""
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        for f in [pool.submit(g) for g in getters]:
            f.result()


def forget(spark: SparkSession) -> None:
    """Drop the table registry of this application (tests)."""
    app = spark.sparkContext.applicationId
    for k in [k for k in _PATHS if k[0] == app]:
        del _PATHS[k]
