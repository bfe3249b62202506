"""Filters, joins, aggregations, sorts, dedupe and deterministic sampling."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions import columns as C
from kestrel.session import materialize

# --- filters --------------------------------------------------------------------


def lookup_ci(df: DataFrame, column: str, value: str, order: list[Column]) -> DataFrame:
    """Case-insensitive equality, first hit under ``order`` (top-1)."""
    return df.where(F.lower(F.col(column)) == F.lower(F.lit(value))).orderBy(*order).limit(1)


def filter_high_risk_supplier(scores: DataFrame) -> DataFrame:
    return scores.where(F.lower(F.coalesce(F.col("risk_tier").cast("string"), F.lit("")))
                        .isin(*C.HIGH_RISK_TIERS))


def filter_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.dropna(subset=[column])


def filter_in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(*values))


# --- joins ----------------------------------------------------------------------


def join_anti_new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose natural key is not stored yet (insert-if-absent input)."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")


def join_embedded(fact: DataFrame, dim: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join a dimension and fill its columns with defaults when absent."""
    out = fact.join(dim, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def join_map_lookup(df: DataFrame, mapping: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Attribute lookup from a key -> attributes map with defaults (left join)."""
    return join_embedded(df, mapping, key, defaults)


# --- aggregations ---------------------------------------------------------------


def agg_value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def topk_categories(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """k most frequent values; partial counts, then TakeOrderedAndProject."""
    return agg_value_counts(df, column).orderBy(F.col("count").desc(), F.col(column)).limit(k)


def reindex_categories(counts: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Fixed output order with missing levels kept (count 0)."""
    spark = counts.sparkSession
    lv = spark.createDataFrame([(v, i) for i, v in enumerate(levels)], [column, "level_order"])
    return (F.broadcast(lv).join(counts, column, "left")
            .select(column, "level_order", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def agg_crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Two-way counts; pivot values are passed so no extra distinct job runs."""
    return (df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1)))
            .fillna(0, subset=[str(v) for v in values]))


def agg_crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """Long form (row, col, count): for high-cardinality keys."""
    return df.groupBy(row, col).agg(F.count(F.lit(1)).alias("count"))


def agg_crosstab_rownorm(df: DataFrame, row: str, col: str) -> DataFrame:
    """Row-normalised shares: counts / row total, totals joined back."""
    cnt = agg_crosstab_long(df, row, col)
    tot = cnt.groupBy(row).agg(F.sum("count").alias("_tot"))
    return cnt.join(tot, row).select(row, col, (F.col("count") / F.col("_tot")).alias("share"))


def agg_duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates beyond the first (null-safe, exact).

    Rows are first reduced to a 64-bit hash with map-side partial counts;
    only rows whose hash repeats go through the exact whole-row grouping.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.withColumn("_h", F.xxhash64(*cols))
    repeated = hashed.groupBy("_h").count().where(F.col("count") > 1).select("_h")
    cand = hashed.join(repeated, "_h", "left_semi").drop("_h")
    exact = cand.groupBy(*cols).count()
    return exact.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def agg_null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[(F.count_if(F.col(f"`{c}`").isNull()) if c in df.columns else F.lit(None).cast("long"))
                    .alias(f"{c}_nulls") for c in columns])


def agg_minmax(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def agg_class_balance(df: DataFrame, label: str) -> DataFrame:
    cnt = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("_tot"))
    return cnt.crossJoin(F.broadcast(tot)).select(label, "n", (F.col("n") / F.col("_tot")).alias("share"))


def agg_target_stats(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"))


def agg_histogram(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """Equal-width bins between min and max; the max value lands in the last bin."""
    mm = df.agg(F.min(column).alias("_mn"), F.max(column).alias("_mx"))
    b = F.least(F.width_bucket(F.col(column), F.col("_mn"), F.col("_mx"), F.lit(bins)), F.lit(bins))
    return (df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(mm))
            .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count")))


# --- sorts, dedupe, sampling ---------------------------------------------------------


def dedupe_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key under ``order`` (min_by with partial aggregation)."""
    others = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
            .select(key, "_r.*"))


def order_hash(key: Column, seed: int = 42) -> Column:
    """A number of 60 bits from a row key, the same in any engine: the head of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def sample_rows(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows without replacement, deterministic (hash order)."""
    return df.withColumn("_u", order_hash(key, seed)).orderBy("_u", key).limit(n).drop("_u")


def _test_rows(counts: DataFrame, test_share: float) -> DataFrame:
    """(stratum, want): ceil(share * n) test rows in all, dealt over the strata in
    proportion; what flooring leaves goes to the largest remainders, then the
    smallest strata (one row per stratum)."""
    share, every = F.lit(Decimal(str(test_share))), Window.partitionBy(F.lit(0))
    whole = F.sum("n").over(every)
    total = F.ceil(whole.cast("decimal(24,0)") * share).cast("decimal(18,0)")
    out = counts.withColumns({"_all": whole, "_total": total})
    exact = (F.col("n").cast("decimal(18,0)") * F.col("_total")).cast("decimal(38,0)")
    out = out.withColumn("_rest", exact % F.col("_all").cast("decimal(38,0)"))
    out = out.withColumn("_floor", ((exact - F.col("_rest")) / F.col("_all").cast("decimal(20,0)")).cast("long"))
    out = out.withColumn("_place", F.row_number().over(every.orderBy(F.col("_rest").desc(), "stratum")))
    left = F.col("_total").cast("long") - F.sum("_floor").over(every)
    return out.withColumn("want", F.col("_floor") + (F.col("_place") <= left).cast("long")).select("stratum", "want")


def split_stratified(df: DataFrame, key: Column, label: str | None, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: in each label the rows with the smallest key hashes, as
    many as the label's rounded share asks for, the same rows every run.

    The k-th smallest hash of a label is found without a sort: counts per hash
    range (65,536 of them) tell the range it lies in, counts within that range
    the sub-range, and the few rows left there are numbered.  ``key`` identifies
    rows; rows that share a key go together.  What is found, one row a label, is
    broadcast: labels are few, so a shuffle by label would leave a task for each.
    """
    stratum = F.lit("all") if label is None else F.col(f"`{label}`").cast("string")
    slim = materialize(df.select(stratum.alias("stratum"), key.alias("key"), order_hash(key, seed).alias("h")), "split")
    slim = slim.withColumns({"r1": F.shiftright("h", 44), "r2": F.shiftright("h", 28).bitwiseAND(0xFFFF)})
    want = _test_rows(slim.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), test_share)

    def crossing(rows: DataFrame, wanted: DataFrame, ranges: str, keep: list[str]) -> DataFrame:
        """The range of each stratum in which the wanted number is reached, and how many are wanted there."""
        counts = rows.groupBy("stratum", *keep, ranges).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("stratum").orderBy(ranges))
        counts = counts.withColumn("upto", upto)
        found = counts.join(wanted.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s")))
        found = found.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
        return found.select("stratum", *keep, ranges, (F.col("want") - F.col("upto") + F.col("n")).alias("want"))

    def inside(ranges: DataFrame, names: list[str]) -> DataFrame:
        at = ranges.select(F.col("stratum").alias("s"), *[F.col(c).alias(f"at_{c}") for c in names])
        same = F.col("stratum").eqNullSafe(F.col("s"))
        for c in names:
            same &= F.col(c) == F.col(f"at_{c}")
        return slim.join(at, same).select(*slim.columns)

    first = materialize(crossing(slim, want, "r1", []), "split-range")
    second = materialize(crossing(inside(first, ["r1"]), first.select("stratum", "want"), "r2", ["r1"]), "split-range")
    few = inside(second, ["r1", "r2"]).withColumn("_n", F.row_number().over(Window.partitionBy("stratum").orderBy("h", "key")))
    last = (few.join(second.select(F.col("stratum").alias("s"), "want"), F.col("stratum").eqNullSafe(F.col("s")) & (F.col("_n") == F.col("want")))
            .select(F.col("stratum").alias("_s"), F.col("h").alias("_h"), F.col("key").alias("_k")))
    h = order_hash(key, seed)
    below = (h < F.col("_h")) | ((h == F.col("_h")) & (key <= F.col("_k")))
    return df.join(F.broadcast(last), stratum.eqNullSafe(F.col("_s")), "left").withColumn("is_test", F.coalesce(below, F.lit(False))).drop("_s", "_h", "_k")


def split_train_test(df: DataFrame, key: Column, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: ceil(share * n) rows, the same rows every run."""
    return split_stratified(df, key, None, test_share, seed)
