"""Delay classifier, sales regressor, rule scorers, metrics and registry.

Forests are grown on all training rows (``grow``); splits are stable hash splits of
exact sizes (same rows every run, no ``randomSplit`` re-evaluation hazards); metrics
are SQL aggregates over the scored rows; models persist as PipelineModel.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel import schemas as S
from kestrel.functions import columns as C
from kestrel.operators.forest import with_scores
from kestrel.operators.forest_model import ForestModel
from kestrel.operators.grow import Settings, grow
from kestrel.operators.ranks import value_ranks
from kestrel.operators.relational import split_stratified, split_train_test
from kestrel.session import materialize

# Forest settings of the source models.
FOREST_TREES = 200
FOREST_DEPTH = 15
SEED = 42
# Stands in for min_samples_split = 10: 5 rows per child.
MIN_INSTANCES_PER_NODE = 5
# Quantile bins of a numeric feature.
BINS = 32


def encode_input(df: DataFrame, categoricals: list[str], numerics: list[str]) -> DataFrame:
    """Categoricals as text with missing -> 'nan'; numerics coerced, missing -> 0."""
    types = dict(df.dtypes)
    return df.withColumns({
        **{c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in categoricals},
        **{c: F.coalesce(C.parse_number(c, types[c]), F.lit(0.0)) for c in numerics}})


def encode_categoricals(categoricals: list[str]) -> StringIndexer:
    """Sorted label codes (alphabetical) of all columns in one pass; unseen
    values go to an extra index."""
    return StringIndexer(inputCols=categoricals, outputCols=[f"{c}_idx" for c in categoricals],
                         stringOrderType="alphabetAsc", handleInvalid="keep")


def label_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, label, code, n_rows): every column's distinct labels numbered
    from 0 in sorted order.  All columns are stacked and reduced in one pass, and
    numbered by distributed ranks, so no label list reaches the driver."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("label")) for c in columns])).alias("x")
    labels = materialize(df.select(cells).select("x.*").groupBy("column_name", "label").agg(F.count(F.lit(1)).alias("n_rows")), "labels")
    codes = value_ranks(labels, "label", ["column_name"]).select("column_name", "label", F.col("before").alias("code"))
    return codes.join(labels, ["column_name", "label"])


def with_codes(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with ``<column>_code`` of :func:`label_codes` (null for a label not in the table)."""
    for c in columns:
        own = codes.where(F.col("column_name") == c).select(F.col("label").alias("_label"), F.col("code").alias(f"{c}_code"))
        df = df.join(own, F.col(f"`{c}`") == F.col("_label"), "left").drop("_label")
    return df


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """w = n / (k * n_class) per row (class counts: one small aggregate)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias("weight"))
    return df.join(F.broadcast(w), label)


def training_rows(train: DataFrame, key: str, columns: list[str], limit: int | None) -> DataFrame:
    """The prepared rows of a fit, written once: all of them, or the ``limit``
    with the smallest key hashes (a top-k, not a full sort).  They are dealt
    evenly over the cores, since a forest reads them many times."""
    rows = train.select(*columns)
    if limit is not None:
        rows = train.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit).select(*columns)
    return materialize(rows, "train").repartition(train.sparkSession.sparkContext.defaultParallelism)


def fit_forest(train: DataFrame, categoricals: list[str], numerics: list[str], n_rows: int, weights: list[float] | None,
               num_trees: int, max_depth: int, seed: int, bins: int = BINS) -> PipelineModel:
    """A forest on all rows of ``train`` (features, ``label``, ``row_hash``): with ``weights``
    of the classes a classifier, else a regression.  Square root or third of the features at a node."""
    indexer, bucketizer = encode_categoricals(categoricals).fit(train), binning(train, numerics, bins)
    inputs = [f"{c}_idx" for c in categoricals] + [f"{c}_bin" for c in numerics]
    sizes = [len(labels) + 1 for labels in indexer.labelsArray] + [len(cuts) for cuts in bucketizer.getSplitsArray()]
    mtry = math.ceil(math.sqrt(len(inputs)) if weights else len(inputs) / 3)
    settings = Settings(sizes, [False] * len(categoricals) + [True] * len(numerics), weights, mtry, max_depth, MIN_INSTANCES_PER_NODE, seed)
    path = grow(bucketizer.transform(indexer.transform(train)), F.col("row_hash"), inputs, n_rows, num_trees, settings)
    return PipelineModel([indexer, bucketizer, ForestModel(path, inputs, sizes, len(weights or ()))])


def train_delay_classifier(df: DataFrame, num_trees: int = FOREST_TREES, max_depth: int = FOREST_DEPTH,
                           seed: int = SEED, key: str = "row_key") -> tuple[PipelineModel, DataFrame]:
    """Forest on the 10 delay features of all training rows (stratified 80 %), balanced
    class weights; returns (model, test rows)."""
    cats, nums, target = S.DELAY_CATEGORICALS, S.DELAY_NUMERICS, S.DELAY_TARGET
    d = encode_input(df.where(F.col(target).isNotNull()), cats, nums) \
        .withColumn("label", F.col(target).cast("double"))
    d = split_stratified(d, F.col(key), "label", 0.2, seed)
    train = materialize(d.where(~F.col("is_test")).select(*cats, *nums, "label", F.xxhash64(key).alias("row_hash")), "train")
    known = {int(r.label): r for r in balanced_weights(train.select("label"), "label").groupBy("label", "weight")
             .agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    weights = [known[c].weight if c in known else 0.0 for c in range(max([1, *known]) + 1)]
    return fit_forest(train, cats, nums, sum(r.n for r in known.values()), weights, num_trees, max_depth, seed), d.where(F.col("is_test"))


def binning(df: DataFrame, numerics: list[str], bins: int = BINS) -> Bucketizer:
    """Quantile bins of all numeric columns, from one pass of mergeable sketches.
    A value's bin is what the forest sees, in training and in scoring alike."""
    cuts = df.select(*[F.col(c).cast("double") for c in numerics]).approxQuantile(
        numerics, [k / bins for k in range(1, bins)], 1 / (8 * bins))
    edge = float("inf")
    return Bucketizer(splitsArray=[[-edge, *sorted({c for c in own if abs(c) != edge and c == c} or {0.0}), edge] for own in cuts],
                      inputCols=numerics, outputCols=[f"{c}_bin" for c in numerics], handleInvalid="keep")


def binned_cells(rows: DataFrame, categoricals: list[str], numerics: list[str], bucketizer: Bucketizer,
                 classes: bool = False) -> DataFrame:
    """All rows reduced to distinct (categories, bins) with ``weight``, the number or
    weight of their rows, and their mean ``label`` (with ``classes``: distinct labels).

    The variance gain of a split depends on the rows through these sums
    alone, so a forest grown on the cells sees every row.  Partial aggregation
    shrinks the rows before the shuffle; the number of cells is bounded by the
    categories and bins, not by the rows.
    """
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    key = [*categoricals, *[f"{c}_bin" for c in numerics]]
    binned = bucketizer.transform(rows).withColumn("_w", weight)
    if classes:
        return binned.groupBy(*key, "label").agg(F.sum("_w").alias("weight"))
    return binned.groupBy(*key).agg(F.sum("_w").alias("weight"), (F.sum(F.col("label") * F.col("_w")) / F.sum("_w")).alias("label"))


def train_sales_regressor(df: DataFrame, num_trees: int = FOREST_TREES, max_depth: int = FOREST_DEPTH,
                          seed: int = SEED, key: str = "row_key", bins: int = BINS) -> tuple[PipelineModel, DataFrame]:
    """Forest for the sales amount on all training rows (80 %); returns (model, test rows)."""
    cats, nums, target = S.DELAY_CATEGORICALS, S.DEMAND_NUMERICS, S.DEMAND_TARGET
    d = encode_input(df.where(F.col(target).isNotNull()), cats, nums) \
        .withColumn("label", F.col(target).cast("double"))
    d = split_train_test(d, F.col(key), 0.2, seed)
    train = materialize(d.where(~F.col("is_test")).select(*cats, *nums, "label", F.xxhash64(key).alias("row_hash")), "train")
    return fit_forest(train, cats, nums, train.count(), None, num_trees, max_depth, seed, bins), d.where(F.col("is_test"))


def score_delay_batch(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Label, P(late), P(on time) per row, rounded to 4 places."""
    cats, nums = S.DELAY_CATEGORICALS, S.DELAY_NUMERICS
    out = with_scores(model, encode_input(df, cats, nums))
    p = vector_to_array("probability")
    return out.withColumns({"predicted_label": F.col("prediction").cast("long"),
                            "late_probability": C.round_half_even(p[1], 4),
                            "on_time_probability": C.round_half_even(p[0], 4)})


def score_demand_batch(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(encode_input(df, S.DELAY_CATEGORICALS, S.DEMAND_NUMERICS))
    return out.withColumn("predicted_sales", C.round_half_even("prediction", 2))


# --- rule scorers (fallback models) ---------------------------------------------------------

def rule_score_delay(df: DataFrame) -> DataFrame:
    """Flag if days <= 2 or sales > 1500; P(late) = .75 + min(sales/10000, .2)
    for days <= 2, .12 for days >= 5, else .38.  Missing days -> 4, sales -> 100."""
    days = F.coalesce(F.col("scheduled_shipping_days").cast("double"), F.lit(4.0))
    sales = F.coalesce(F.col("sales").cast("double"), F.lit(100.0))
    p = (F.when(days <= 2, F.lit(0.75) + F.least(sales / F.lit(10000.0), F.lit(0.20)))
         .when(days >= 5, F.lit(0.12)).otherwise(F.lit(0.38)))
    return df.withColumns({"predicted_label": ((days <= 2) | (sales > 1500)).cast("long"),
                           "late_probability": C.round_half_even(p, 4),
                           "on_time_probability": C.round_half_even(F.lit(1.0) - p, 4)})


def rule_score_demand(df: DataFrame) -> DataFrame:
    """max(180 * (1.1 - discount/100) + 1.5 * benefit, 15); defaults 10 / 20."""
    disc = F.coalesce(F.col("discount_rate_pct").cast("double"), F.lit(10.0))
    ben = F.coalesce(F.col("benefit_per_order").cast("double"), F.lit(20.0))
    pred = F.greatest(F.lit(180.0) * (F.lit(1.1) - disc / F.lit(100.0)) + ben * F.lit(1.5), F.lit(15.0))
    return df.withColumn("predicted_sales", C.round_half_even(pred, 2))


# --- metrics ------------------------------------------------------------------------------------

def agg_confusion_matrix(scored: DataFrame, label: str = "label", pred: str = "predicted_label") -> DataFrame:
    return scored.groupBy(F.col(label).cast("long").alias("actual"),
                          F.col(pred).cast("long").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def eval_classifier(scored: DataFrame, label: str = "label", pred: str = "predicted_label",
                    prob: str | None = None) -> DataFrame:
    """accuracy / precision / recall / F1 (positive class 1) from confusion
    counts; exact ROC AUC when a probability column is given."""
    y, p = F.col(label).cast("long").alias("y"), F.col(pred).cast("long").alias("said")
    cells = scored.groupBy(y, p, *([_probability(scored, prob).alias("p")] if prob else [])).agg(F.count(F.lit(1)).alias("n"))
    if prob:
        cells = materialize(cells, "scored-cells")  # rows are scored once for both
    both = lambda a, b: F.coalesce(F.sum(F.when((F.col("y") == a) & (F.col("said") == b), F.col("n"))), F.lit(0))
    c = cells.agg(both(1, 1).alias("tp"), both(0, 1).alias("fp"), both(1, 0).alias("fn"), both(0, 0).alias("tn"))
    dec = lambda x: F.col(x).cast("decimal(38,9)")
    prec = F.try_divide(dec("tp"), dec("tp") + dec("fp"))
    rec = F.try_divide(dec("tp"), dec("tp") + dec("fn"))
    out = c.select(
        F.bround((dec("tp") + dec("tn")) / (dec("tp") + dec("tn") + dec("fp") + dec("fn")), 4).cast("double")
        .alias("accuracy"),
        F.bround(F.coalesce(prec, F.lit(0)), 4).cast("double").alias("precision"),
        F.bround(F.coalesce(rec, F.lit(0)), 4).cast("double").alias("recall"),
        F.bround(F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0)), 4).cast("double").alias("f1_score"))
    if not prob:
        return out
    pos = F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0))
    ranked = cells.where(F.col("y").isNotNull()).groupBy("p").agg(F.sum("n").alias("n_rows"), pos.alias("n_pos"))
    return out.crossJoin(F.broadcast(_auc_of(ranked)))  # one row each


def _probability(scored: DataFrame, prob: str) -> Column:
    plain = scored.schema[prob].dataType.typeName() in ("double", "float")
    return (F.col(prob) if plain else vector_to_array(prob)[1]).cast("double")


def roc_auc(scored: DataFrame, label: str, prob: str) -> DataFrame:
    """``roc_auc``: exact area under the ROC curve from the rank sum of the positives,
    tied probabilities sharing their average rank; null if a class is missing.

    Rows are reduced to distinct probabilities with their counts before they are
    ranked; sums are integers, so the result doesn't depend on partitioning.
    """
    return _auc_of(scored.where(F.col(label).isNotNull()).groupBy(_probability(scored, prob).alias("p")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label).cast("long") == 1).alias("n_pos")))


def _auc_of(cells: DataFrame) -> DataFrame:
    """The area from distinct probabilities ``p`` with ``n_rows`` and ``n_pos``."""
    cells = materialize(cells, "auc")
    ranks = value_ranks(cells, "p", weight="n_rows").select("p", "cnt", "before")
    d = lambda c: F.col(c).cast("decimal(18,0)")
    twice = (d("n_pos") * (2 * d("before") + d("cnt") + 1)).cast("decimal(38,0)")  # pos * 2 * average rank
    sums = ranks.join(cells, "p").agg(F.sum(twice).alias("r"), F.sum("n_pos").alias("pos"), F.sum(F.col("cnt") - F.col("n_pos")).alias("neg"))
    pos, neg = (F.col(c).cast("decimal(19,0)") for c in ("pos", "neg"))
    over = (F.col("r") - (pos * (pos + 1)).cast("decimal(38,0)")).cast("decimal(38,0)")
    return sums.select(C.round_half_even(F.try_divide(over, (2 * pos * neg).cast("decimal(38,0)")), 4).cast("double").alias("roc_auc"))


def eval_class_report(scored: DataFrame, label: str = "label", pred: str = "predicted_label") -> DataFrame:
    """Per class precision / recall / F1 / support, from the confusion counts
    (one small group-by over the scored rows; classes x classes rows after it)."""
    cells = agg_confusion_matrix(scored, label, pred)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    actual = cells.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    said = cells.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("said"))
    per = actual.join(said, "cls", "full").where("cls IS NOT NULL").fillna(0, ["support", "tp", "said"])
    d = lambda x: F.col(x).cast("decimal(38,9)")
    prec = F.coalesce(F.try_divide(d("tp"), d("said")), F.lit(0))
    rec = F.coalesce(F.try_divide(d("tp"), d("support")), F.lit(0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0))
    return per.select("cls", F.bround(prec, 4).cast("double").alias("precision"),
                      F.bround(rec, 4).cast("double").alias("recall"), F.bround(f1, 4).cast("double").alias("f1"),
                      F.col("support").cast("long").alias("support"))


def eval_regressor(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """RMSE, MAE, R^2 and MAPE (zero actuals masked) in one aggregation."""
    y, p = F.col(label), F.col(pred)
    e = y - p
    agg = scored.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                     F.sum(e * e).alias("sse"), F.var_pop(y).alias("vy"), F.count(F.lit(1)).alias("n"),
                     F.avg(F.when(y != 0, F.abs(e / y))).alias("ape"))
    return agg.select(C.round_half_even(F.sqrt("mse"), 4).alias("rmse"), C.round_half_even("mae", 4).alias("mae"),
                      C.round_half_even(F.lit(1.0) - F.col("sse") / (F.col("vy") * F.col("n")), 4).alias("r2"),
                      C.round_half_even(F.col("ape") * 100, 2).alias("mape"))


def feature_importance(model: PipelineModel, spark: SparkSession, features: list[str]) -> DataFrame:
    """Importances of the fitted forest, largest first (one small row each)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda t: -t[1])
    return spark.createDataFrame(rows, "feature string, importance double")


# --- persistence and registry -------------------------------------------------------------------

def model_save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def model_load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def registry_row(spark: SparkSession, name: str, version: str, algorithm: str, metrics: DataFrame,
                 artifact_path: str, target: str, trained_at: datetime, status: str = "active") -> DataFrame:
    """Registry entry with the metrics row as JSON (built on the executors)."""
    return metrics.select(
        F.lit(name).alias("model_name"), F.lit(version).alias("model_version"), F.lit(algorithm).alias("algorithm"),
        F.to_json(F.struct(*metrics.columns)).alias("metrics"), F.lit(artifact_path).alias("artifact_path"),
        F.lit(target).alias("target_column"), F.lit(trained_at).cast("timestamp").alias("trained_at"),
        F.lit(status).alias("status"), C.resolve_model_type(F.lit(name)).alias("model_type"),
        F.lit(status == "active").alias("is_active"))


def registry_one_active(registry: DataFrame) -> DataFrame:
    """Violations: more than one active model per type, or a duplicated
    (name, version)."""
    many = registry.where("is_active").groupBy("model_type").agg(F.count(F.lit(1)).alias("n")) \
                   .where(F.col("n") > 1).select(F.lit("one_active_per_type").alias("rule"),
                                                 F.col("model_type").alias("key"))
    dup = registry.groupBy("model_name", "model_version").agg(F.count(F.lit(1)).alias("n")) \
                  .where(F.col("n") > 1).select(F.lit("name_version_unique").alias("rule"),
                                                F.concat_ws(":", "model_name", "model_version").alias("key"))
    return many.unionByName(dup)

