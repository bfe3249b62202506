"""Seed jobs: reference rows from scored suppliers and optimised SKUs into stored tables.

Each job looks stored keys up, inserts only what is missing (anti-join, then
append) and maps codes to stored ids for the dependent rows, so running it
again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import scoring
from kestrel.sources.sinks import sink_insert_if_absent


def _with_id(df: DataFrame, id_col: str, code_col: str) -> DataFrame:
    """A deterministic surrogate key from the natural key."""
    return df.withColumn(id_col, F.sha2(F.col(code_col).cast("string"), 256))


def seed_suppliers_and_scores(scores: DataFrame, root: str, score_date, model_id: str) -> dict[str, int]:
    """Suppliers that are not stored yet, then the score cards of the date for
    suppliers without one.  Returns the inserted counts."""
    spark = scores.sparkSession
    suppliers = _with_id(scoring.seed_suppliers(scores), "supplier_id", "supplier_code").withColumn("is_active", F.lit(True))
    n_suppliers = sink_insert_if_absent(suppliers, f"{root}/dim_suppliers", ["supplier_code"], ["supplier_name"])
    ids = spark.read.parquet(f"{root}/dim_suppliers").select("supplier_code", "supplier_id")
    cards = (scoring.seed_supplier_scores(scores, score_date).join(ids, "supplier_code").drop("supplier_code")
             .withColumns({"model_id": F.lit(model_id), "explanation": F.lit('{"notes": "Initial seed scorecard"}')}))
    n_scores = sink_insert_if_absent(cards, f"{root}/supplier_performance_scores", ["supplier_id", "score_date"])
    return {"suppliers": n_suppliers, "scores": n_scores}


def seed_products_and_recommendations(skus: DataFrame, inventory: DataFrame, root: str, location_id: str,
                                      recommendation_date, model_id: str) -> dict[str, int]:
    """Products that are not stored yet, then the date's recommendations at the
    location for products without one.  Returns the inserted counts."""
    spark = skus.sparkSession
    products = _with_id(scoring.seed_products(skus), "product_id", "sku")
    n_products = sink_insert_if_absent(products, f"{root}/dim_products", ["sku"], ["product_name"])
    ids = spark.read.parquet(f"{root}/dim_products").select("sku", "product_id")
    recs = (scoring.seed_recommendations(inventory, location_id, recommendation_date)
            .withColumn("sku", F.col("sku").cast("string")).join(ids, "sku").drop("sku")
            .withColumn("model_id", F.lit(model_id)))
    n_recs = sink_insert_if_absent(recs, f"{root}/inventory_recommendations", ["product_id", "location_id", "recommendation_date"])
    return {"products": n_products, "recommendations": n_recs}
