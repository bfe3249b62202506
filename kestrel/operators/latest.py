"""Keep-latest, ranking and contiguous row numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per ``keys`` under ``order`` (``distinct on`` semantics).

    ``row_number() = 1`` lets Catalyst insert a WindowGroupLimit below the
    shuffle, so each map task forwards at most one row per key: a key that
    holds a third of the data is reduced before it is exchanged.  Callers
    end ``order`` with a unique column so ties are deterministic.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def latest_inventory(inv: DataFrame) -> DataFrame:
    return keep_latest(inv, ["product_id", "location_id"],
                       [F.col("snapshot_date").desc(), F.col("snapshot_id").desc()])


def nearest_forecast(fc: DataFrame, as_of) -> DataFrame:
    """First forecast on/after ``as_of``: date ascending, newest creation."""
    return keep_latest(fc.where(F.col("forecast_date") >= F.lit(as_of)),
                       ["product_id", "location_id"],
                       [F.col("forecast_date").asc(), F.col("created_at").desc(),
                        F.col("forecast_horizon_days").asc()])


def latest_inventory_rec(rec: DataFrame) -> DataFrame:
    return keep_latest(rec, ["product_id", "location_id"],
                       [F.col("recommendation_date").desc(), F.col("created_at").desc(),
                        F.col("inventory_recommendation_id").desc()])


def latest_supplier_score(scores: DataFrame) -> DataFrame:
    return keep_latest(scores, ["supplier_id"],
                       [F.col("score_date").desc(), F.col("created_at").desc()])


def latest_delay_prediction(pred: DataFrame) -> DataFrame:
    return keep_latest(pred, ["shipment_id"],
                       [F.col("created_at").desc(), F.col("predicted_delay_probability").desc()])


def row_number_in_source(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Contiguous 1..n numbering in scan order without a global window.

    Per-partition counts (one small row per partition) are turned into
    offsets by a cumulative sum over partitions, joined back, and added to
    the in-partition position.  No single task ever holds all rows.
    """
    with_pos = (df.withColumn("_pid", F.spark_partition_id())
                  .withColumn("_mid", F.monotonically_increasing_id()))
    # position inside the partition: the low 33 bits of the generated id
    with_pos = with_pos.withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    return _number(with_pos.drop("_mid"), name)


def _number(placed: DataFrame, name: str) -> DataFrame:
    """Number rows that know their partition and their place in it: the
    partitions before (one row each) give the offset."""
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    return (placed.join(offsets, "_pid")
            .withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_pos") + 1)
            .drop("_pid", "_pos", "_off"))


def rank_leaderboard(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """1-based position by ``score`` descending (ties broken by the other
    columns), without a single-partition window: range partitioning, a sort
    inside each partition, written once (the numbering reads it twice and
    sampled range bounds must not change between reads), then contiguous
    numbering from per-partition offsets."""
    order = [F.col(score).desc()] + [F.col(c).asc() for c in df.columns if c != score]
    from kestrel.session import materialize
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumns({"_pid": F.spark_partition_id(),
                                             "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    return _number(placed, name)
