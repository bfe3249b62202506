"""Scalar Column functions (JVM-side, whole-stage-codegen friendly).

Each helper returns a ``Column``; none of them touches data or runs an
action.  Null and rounding rules follow the source application:
pandas ``round`` is half-to-even (``bround``), SQL ``round`` on numerics
is half-away-from-zero (``round`` on DECIMAL), JavaScript ``Math.round``
is half-toward-+inf (``floor(x + 0.5)``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the source application's.
# ---------------------------------------------------------------------------
NULL_TOKENS = ["", "nan", "None"]
VALID_RISK_LEVELS = ["low", "medium", "high", "critical"]
HIGH_RISK_TIERS = ["high", "high risk", "critical"]
# service level (percent) -> Z score; anything else uses 1.65
Z_SCORES = {90: 1.28, 95: 1.65, 99: 2.33}
DEFAULT_Z = 1.65
# ordered substring rules for model_type
MODEL_TYPE_RULES = [
    (["delay"], "delay_prediction"),
    (["demand", "forecast"], "demand_forecast"),
    (["supplier", "score"], "supplier_scoring"),
    (["inventory", "optim"], "inventory_optimization"),
]
MODEL_TYPE_DEFAULT = "recommendation"
# text that is a number: decimal with an optional exponent, or an infinity
NUMBER_TEXT = r"(?i)^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?)$"

# types whose values are the same doubles with and without the way through text
NUMBER_TYPES = ("double", "bigint", "int", "smallint", "tinyint")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- rounding ---------------------------------------------------------------

def round_half_up(c, scale: int) -> Column:
    """Decimal HALF_UP rounding of a double, returned as double.

    Going through DECIMAL(38,9) removes binary-representation noise so the
    result equals SQL ``round(numeric, n)`` in other engines too.
    """
    return F.round(col(c).cast("decimal(38,9)"), scale).cast("double")


def round_half_even(c, scale: int) -> Column:
    """pandas/numpy ``.round(n)`` (banker's rounding)."""
    return F.bround(col(c).cast("decimal(38,9)"), scale).cast("double")


def js_round(c) -> Column:
    """JavaScript ``Math.round``: half toward +infinity."""
    return F.floor(col(c) + F.lit(0.5))


# --- §2.4 cleaning ------------------------------------------------------------

def clean_string(c) -> Column:
    """Trim, then blank / 'nan' / 'None' become null."""
    t = F.trim(col(c))
    return F.when(t.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(t)


def parse_number(c, dtype: str | None = None) -> Column:
    """Text or number to double as Python's ``float`` reads it, else null.

    The cast alone would take Java suffixes (``12.5d``, ``3f``); not-a-number
    becomes null, as a missing value is.  ``dtype``: the column's type, if known;
    a number that is a double or an integer already isn't turned into text.
    """
    if dtype in NUMBER_TYPES:
        return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))
    t = F.trim(col(c).cast("string"))
    return F.when(t.rlike(NUMBER_TEXT), F.nanvl(t.try_cast("double"), F.lit(None).cast("double")))


def to_number(c, dtype: str | None = None) -> Column:
    """``pd.to_numeric(errors='coerce')``: bad text becomes null."""
    return parse_number(c, dtype)


def to_int_string(c, dtype: str | None = None) -> Column:
    """numeric -> half-even round -> integer text (nullable)."""
    return F.rint(to_number(c, dtype)).cast("long").cast("string")


def parse_datetime(c, fmt: str = "M/d/yyyy H:mm") -> Column:
    """month/day/year hour:minute; unparseable text becomes null."""
    return F.try_to_timestamp(col(c), F.lit(fmt))


def safe_ratio(num, den, multiplier: float = 1.0) -> Column:
    """(num / den) * multiplier; null when den is zero or missing."""
    r = F.try_divide(col(num), col(den))
    return r * F.lit(multiplier) if multiplier != 1.0 else r


def month_number(c) -> Column:
    return F.month(col(c)).cast("long")


def weekday_name(c) -> Column:
    """Full English day name (pandas ``day_name``)."""
    return F.date_format(col(c), "EEEE")


def missing_indicator(c) -> Column:
    return col(c).isNull().cast("long")


def delivery_delay(actual, scheduled) -> Column:
    return col(actual) - col(scheduled)


def late_flag(c) -> Column:
    return F.coalesce(col(c), F.lit(0)).cast("long")


def positive_flag(c, threshold: float = 0.0) -> Column:
    """``(x > t).astype(int)`` in pandas: missing compares False -> 0."""
    return F.coalesce(col(c) > F.lit(threshold), F.lit(False)).cast("long")


def equals_flag(c, value: str) -> Column:
    """``.eq(v)`` on a nullable string column: missing stays missing."""
    return (col(c) == F.lit(value)).cast("long")


def profit_margin_pct(benefit, sales) -> Column:
    return safe_ratio(benefit, sales, 100.0)


def discount_pct(rate, dtype: str | None = None) -> Column:
    return to_number(rate, dtype) * F.lit(100)


def safe_float(c, default: float = 0.0) -> Column:
    return F.coalesce(parse_number(c), F.lit(float(default)))


def safe_int(c, default: int = 0) -> Column:
    """``int(float(x))``: parse as double, truncate toward zero."""
    return F.coalesce(parse_number(c).try_cast("long"), F.lit(int(default)))


def truthy(c) -> Column:
    """Python truthiness on a loosely typed value kept as text:
    null, '' and numeric zero are falsy."""
    s = col(c).cast("string")
    num = parse_number(s)
    return s.isNotNull() & (s != F.lit("")) & F.coalesce(num != F.lit(0.0), F.lit(True))


def first_truthy(*cols, default=None) -> Column:
    """``a or b or ... or default`` over alias columns (as text)."""
    out = F.lit(default) if default is not None else F.lit(None).cast("string")
    for c in reversed(cols):
        out = F.when(truthy(c), col(c).cast("string")).otherwise(out)
    return out


def slug_code(c) -> Column:
    """spaces -> '_', then lower case."""
    return F.lower(F.replace(col(c), F.lit(" "), F.lit("_")))


def normalize_risk_tier(c) -> Column:
    """First word, lower-cased, if a valid risk level; else 'medium'."""
    first = F.lower(F.split(F.trim(col(c).cast("string")), r"\s+").getItem(0))
    return F.when(first.isin(*VALID_RISK_LEVELS), first).otherwise(F.lit("medium"))


def resolve_model_type(c) -> Column:
    name = F.lower(col(c))
    out = F.lit(MODEL_TYPE_DEFAULT)
    for needles, label in reversed(MODEL_TYPE_RULES):
        cond = None
        for n in needles:
            hit = name.contains(n)
            cond = hit if cond is None else (cond | hit)
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def price_from_cost(cost, multiplier: float = 1.5, default_cost: float = 10.0) -> Column:
    return F.coalesce(col(cost).cast("double"), F.lit(default_cost)) * F.lit(multiplier)


def rationale_text(stock, reorder_point, at_risk) -> Column:
    word = F.when(col(at_risk) == 1, F.lit("below")).otherwise(F.lit("above"))
    return F.format_string("Current stock %s is %s reorder point %s.",
                           col(stock).cast("string"), word, col(reorder_point).cast("string"))


def country_from_name(name) -> Column:
    n = col(name)
    return F.when(n.contains("1") | n.contains("3"), F.lit("USA")).otherwise(F.lit("Germany"))


def region_from_name(name) -> Column:
    n = col(name)
    return F.when(n.contains("1") | n.contains("3"), F.lit("Americas")).otherwise(F.lit("Europe"))


def monthly_to_daily(c, days: int = 30, default: float = 20.0) -> Column:
    """forecasted monthly demand -> daily, 2 decimals (Python round)."""
    return F.when(col(c).isNull(), F.lit(default)).otherwise(
        round_half_even(col(c).cast("double") / F.lit(float(days)), 2))


def date_diff_floor0(actual, promised) -> Column:
    """greatest(actual - promised, 0), null when either date is null."""
    d = F.datediff(col(actual), col(promised))
    return F.when(d.isNull(), F.lit(None).cast("int")).otherwise(F.greatest(d, F.lit(0)))


def is_delayed(actual, expected) -> Column:
    """null when undelivered, else actual > expected."""
    return col(actual) > col(expected)


def below_or_at(a, b) -> Column:
    """``case when a <= b then true else false end`` (null -> false)."""
    return F.coalesce(col(a) <= col(b), F.lit(False))


def pct_or_zero(num, den, scale: int = 2) -> Column:
    """coalesce(round(num*100/nullif(den,0), 2), 0) on DECIMAL inputs."""
    ratio = F.try_divide(col(num).cast("decimal(38,6)") * F.lit(100), col(den).cast("decimal(38,6)"))
    return F.coalesce(F.round(ratio, scale), F.lit(0)).cast("double")


def effect_size_label(v) -> Column:
    c = col(v)
    return (F.when(c < 0.1, "negligible").when(c < 0.3, "small")
            .when(c < 0.5, "medium").otherwise("large"))


def risk_tier_cut(score) -> Column:
    """Right-closed bins (-1,40] High, (40,70] Medium, (70,101] Low; else null."""
    s = col(score)
    return (F.when((s > -1) & (s <= 40), "High Risk")
            .when((s > 40) & (s <= 70), "Medium Risk")
            .when((s > 70) & (s <= 101), "Low Risk"))


def risk_tier_whatif(score) -> Column:
    """>= 70 Low, < 40 High, else Medium (what-if screen boundaries)."""
    s = col(score)
    return F.when(s >= 70, "Low Risk").when(s < 40, "High Risk").otherwise("Medium Risk")


def z_for_service_level(level) -> Column:
    out = F.lit(DEFAULT_Z)
    for lvl, z in sorted(Z_SCORES.items(), reverse=True):
        out = F.when(col(level) == F.lit(lvl), F.lit(z)).otherwise(out)
    return out
