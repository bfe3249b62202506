"""Raw file -> clean table + feature table (one lazy projection each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel import schemas as S
from kestrel.functions import columns as C


# Text that a pandas CSV read turns into a missing value.
PANDAS_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def normalize_na_tokens(df: DataFrame) -> DataFrame:
    """Text cells equal to a pandas NA token become null (no trimming)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.col(f"`{c}`").isin(*PANDAS_NA_TOKENS), F.lit(None).cast("string"))
                           .otherwise(F.col(f"`{c}`")) for c in text})


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Raw header -> snake_case; names not in the map are kept."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim every text column; blank / 'nan' / 'None' become null."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: C.clean_string(c) for c in text})


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """List-driven numeric coercion; bad text -> null; absent columns skipped."""
    types = dict(df.dtypes)
    return df.withColumns({c: C.to_number(c, types[c]) for c in columns if c in types})


def parse_datetimes(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: C.parse_datetime(c) for c in columns if c in df.columns})


def zipcodes_to_text(df: DataFrame, columns: list[str]) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({c: C.to_int_string(c, types[c]) for c in columns if c in types})


def drop_sensitive(df: DataFrame, columns: list[str] = S.SENSITIVE_ORDER_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def derive_order_columns(df: DataFrame) -> DataFrame:
    rate = dict(df.dtypes)["order_item_discount_rate"]
    return df.withColumns({
        "delivery_delay_days": C.delivery_delay("actual_shipping_days", "scheduled_shipping_days"),
        "shipping_ahead_days": C.delivery_delay("scheduled_shipping_days", "actual_shipping_days"),
        "late_delivery_flag": C.late_flag("late_delivery_risk"),
        "is_profitable_flag": C.positive_flag("benefit_per_order"),
        "profit_margin_pct": C.profit_margin_pct("benefit_per_order", "sales"),
        "discount_rate_pct": C.discount_pct("order_item_discount_rate", rate),
        "order_month": C.month_number("order_date"),
        "order_weekday": C.weekday_name("order_date"),
        "shipping_month": C.month_number("shipping_date"),
        "shipping_weekday": C.weekday_name("shipping_date"),
        "customer_zipcode_missing": C.missing_indicator("customer_zipcode"),
        "order_zipcode_missing": C.missing_indicator("order_zipcode"),
    })


def clean_orders(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Order items: rename -> trim -> coerce -> dates -> zip text -> drop PII
    -> derive -> (clean, 24-column features)."""
    df = rename_columns(raw, S.ORDERS_COLUMN_MAP)
    df = clean_strings(df)
    df = coerce_numeric(df, S.ORDERS_NUMERIC)
    df = parse_datetimes(df, S.ORDERS_DATETIME)
    df = zipcodes_to_text(df, S.ORDERS_ZIPCODES)
    clean = derive_order_columns(drop_sensitive(df))
    return clean, clean.select(*S.ORDERS_FEATURES)


def derive_sku_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "defect_rate_out_of_range_flag": C.positive_flag("defect_rate_raw", 1.0),
        "quality_pass_flag": C.equals_flag("inspection_result", "Pass"),
        "quality_fail_flag": C.equals_flag("inspection_result", "Fail"),
        "inventory_gap": F.col("availability") - F.col("stock_levels"),
        "sell_through_rate": C.safe_ratio("products_sold", "stock_levels"),
        "revenue_per_unit_sold": C.safe_ratio("revenue_generated", "products_sold"),
        "shipping_cost_per_unit": C.safe_ratio("shipping_cost", "order_quantities"),
        "manufacturing_cost_per_unit": C.safe_ratio("manufacturing_costs", "production_volumes"),
        "lead_time_gap_days": F.col("source_lead_time_days") - F.col("manufacturing_lead_time_days"),
        "supply_pressure_index": C.safe_ratio("products_sold", "availability"),
    })


def clean_skus(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SKUs: rename -> trim -> coerce -> derive -> (clean, 27-column features)."""
    df = rename_columns(raw, S.SKUS_COLUMN_MAP)
    df = clean_strings(df)
    df = coerce_numeric(df, S.SKUS_NUMERIC)
    clean = derive_sku_columns(df)
    return clean, clean.select(*S.SKUS_FEATURES)


# --- validation report (one aggregation pass over the raw rows) -----------------

def _duplicate_rows(raw: DataFrame) -> DataFrame:
    """Full-row duplicates beyond the first occurrence (null-safe, hash pre-filter)."""
    from kestrel.operators.relational import agg_duplicate_rows
    return agg_duplicate_rows(raw)


def dq_report_orders(raw: DataFrame) -> DataFrame:
    stats = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count_if(F.col("`Product Description`").isNull()) if "Product Description" in raw.columns
         else F.lit(None).cast("long")).alias("product_description_nulls"),
        (F.count_if(F.col("`Order Zipcode`").isNull()) if "Order Zipcode" in raw.columns
         else F.lit(None).cast("long")).alias("order_zipcode_nulls"),
        (F.count_if(F.col("Late_delivery_risk").try_cast("double") == 1) if "Late_delivery_risk" in raw.columns
         else F.lit(None).cast("long")).alias("late_delivery_count"))
    return (stats.crossJoin(_duplicate_rows(raw))
            .select("rows", F.lit(len(raw.columns)).cast("long").alias("columns"), "duplicate_rows",
                    "product_description_nulls", "order_zipcode_nulls", "late_delivery_count"))


def dq_report_skus(raw: DataFrame) -> DataFrame:
    stats = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count_if(F.col("`Defect rates`").try_cast("double") > 1) if "Defect rates" in raw.columns
         else F.lit(None).cast("long")).alias("defect_rate_out_of_range_count"),
        (F.count_if(F.col("`Inspection results`") == "Pending") if "Inspection results" in raw.columns
         else F.lit(None).cast("long")).alias("pending_inspection_count"))
    return (stats.crossJoin(_duplicate_rows(raw))
            .select("rows", F.lit(len(raw.columns)).cast("long").alias("columns"), "duplicate_rows",
                    "defect_rate_out_of_range_count", "pending_inspection_count"))
