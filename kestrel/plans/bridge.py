"""Bridge from the driver's TPC-H-like tables to the supply-chain model.

The driver tables carry no supply-chain columns, so every column below is
a deterministic expression of them.  Everything is lazy DataFrame code:
dimension tables with a fixed cardinality (region: 5 rows, nation: 25
rows) are broadcast explicitly; every other join is left to AQE, which
broadcasts a side only after measuring it against
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merges.

Line key (unique per lineitem row):
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, int(l_quantity))
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.session import DEFAULT_AS_OF
from kestrel.sources.tables import Tables

# Order priority -> shipping mode and scheduled days.
PRIORITY_MODES = [
    ("1-URGENT", "Same Day", 0),
    ("2-HIGH", "First Class", 1),
    ("3-MEDIUM", "Second Class", 2),
]
DEFAULT_MODE = ("Standard Class", 4)
# Carriers derived from l_linenumber % 5.
CARRIER_MODES = ["road", "rail", "ocean", "air", "multimodal"]


def line_key() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       F.col("l_quantity").cast("int"))


def shipping_mode(priority: Column) -> Column:
    out = F.lit(DEFAULT_MODE[0])
    for prio, mode, _ in reversed(PRIORITY_MODES):
        out = F.when(priority == prio, F.lit(mode)).otherwise(out)
    return out


def scheduled_days(priority: Column) -> Column:
    out = F.lit(DEFAULT_MODE[1])
    for prio, _, days in reversed(PRIORITY_MODES):
        out = F.when(priority == prio, F.lit(days)).otherwise(out)
    return out


def undelivered() -> Column:
    return (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")


def _geo(t: Tables) -> DataFrame:
    """nation + region: 25 rows by definition of the schema -> broadcast."""
    return F.broadcast(t.nation.join(F.broadcast(t.region),
                                     F.col("n_regionkey") == F.col("r_regionkey"))
                       .select("n_nationkey", "n_name", "r_name"))


# ---------------------------------------------------------------------------
# Raw files (strings, raw headers) as the ETL would receive them
# ---------------------------------------------------------------------------

def order_lines(t: Tables, lineitem: DataFrame | None = None) -> DataFrame:
    """lineitem (or a batch of new lines) joined to orders, customer,
    geography and part."""
    li = (lineitem if lineitem is not None else t.lineitem).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                           "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
                           "l_linestatus", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                        "o_orderpriority")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    # both are facts: always shuffled by the order key, which also spreads a
    # line table that arrives in few files
    return (li.join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
              .join(c, F.col("o_custkey") == F.col("c_custkey"))
              .join(_geo(t), F.col("c_nationkey") == F.col("n_nationkey"))
              .join(p, F.col("l_partkey") == F.col("p_partkey")))


def raw_orders(t: Tables, lineitem: DataFrame | None = None) -> DataFrame:
    """Order-items file as a pandas CSV read yields it: 53 raw headers (plus
    the line key); numeric fields typed, text and date fields as text."""
    prio = F.col("o_orderpriority")
    actual = F.pmod(F.datediff(F.col("l_shipdate"), F.col("o_orderdate")), F.lit(7))
    sched = scheduled_days(prio)
    net = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    benefit = net - F.col("l_quantity") * F.col("p_retailprice")
    late = (actual > sched).cast("int")
    s = lambda c: c.cast("string")
    n = lambda c: c.cast("double")  # noqa: E731  numbers typed as a pandas CSV read infers them
    cols = {
        "Type": F.when(F.col("o_orderstatus") == "F", "DEBIT")
                 .when(F.col("o_orderstatus") == "O", "TRANSFER").otherwise("CASH"),
        "Days for shipping (real)": n(actual),
        "Days for shipment (scheduled)": n(sched),
        "Benefit per order": n(benefit),
        "Sales per customer": n(net),
        "Delivery Status": F.when(late == 1, "Late delivery").otherwise("Shipping on time"),
        "Late_delivery_risk": n(late),
        "Category Id": F.lit(None).cast("double"),
        "Category Name": F.col("p_type"),
        "Customer City": F.lit(None).cast("string"),
        "Customer Country": F.col("n_name"),
        "Customer Email": F.concat(F.lit("customer"), s(F.col("c_custkey")), F.lit("@mail.test")),
        "Customer Fname": F.col("c_name"),
        "Customer Id": n(F.col("o_custkey")),
        "Customer Lname": F.lit("XXXXXXXXX"),
        "Customer Password": F.lit("XXXXXXXXX"),
        "Customer Segment": F.col("c_mktsegment"),
        "Customer State": F.lit(None).cast("string"),
        "Customer Street": F.lit("XXXXXXXXX"),
        "Customer Zipcode": F.when(F.col("c_custkey") % 10 == 0, F.lit(None))
                             .otherwise(n(10000 + F.col("c_custkey") % 90000)),
        "Department Id": F.lit(None).cast("double"),
        "Department Name": F.col("p_brand"),
        "Latitude": F.lit(None).cast("double"),
        "Longitude": F.lit(None).cast("double"),
        "Market": F.col("r_name"),
        "Order City": F.lit(None).cast("string"),
        "Order Country": F.col("n_name"),
        "Order Customer Id": n(F.col("o_custkey")),
        "order date (DateOrders)": F.date_format("o_orderdate", "M/d/yyyy H:mm"),
        "Order Id": n(F.col("l_orderkey")),
        "Order Item Cardprod Id": n(F.col("l_partkey")),
        "Order Item Discount": n(F.col("l_extendedprice") * F.col("l_discount")),
        "Order Item Discount Rate": n(F.col("l_discount")),
        "Order Item Id": n(F.col("l_orderkey") * 8 + F.col("l_linenumber")),
        "Order Item Product Price": n(F.col("p_retailprice")),
        "Order Item Profit Ratio": F.lit(None).cast("double"),
        "Order Item Quantity": n(F.col("l_quantity")),
        "Sales": n(F.col("l_extendedprice")),
        "Order Item Total": n(net),
        "Order Profit Per Order": n(benefit),
        "Order Region": F.col("n_name"),
        "Order State": F.lit(None).cast("string"),
        "Order Status": F.col("o_orderstatus"),
        "Order Zipcode": F.when(F.col("l_orderkey") % 5 == 0, F.lit(None))
                          .otherwise(n(10000 + F.col("l_orderkey") % 90000)),
        "Product Card Id": n(F.col("l_partkey")),
        "Product Category Id": F.lit(None).cast("double"),
        "Product Description": F.lit(None).cast("string"),
        "Product Image": F.concat(F.lit("http://images.test/"), s(F.col("l_partkey"))),
        "Product Name": F.col("p_name"),
        "Product Price": n(F.col("p_retailprice")),
        "Product Status": F.lit(0.0),
        "shipping date (DateOrders)": F.date_format("l_shipdate", "M/d/yyyy H:mm"),
        "Shipping Mode": shipping_mode(prio),
        "Line Key": line_key(),
    }
    return order_lines(t, lineitem).select(*[v.alias(k) for k, v in cols.items()])


def part_sales(t: Tables) -> DataFrame:
    """Per-part line statistics (partial aggregation before the shuffle)."""
    return (t.lineitem.groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("sold"),
        F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).alias("revenue"),
        F.count(F.lit(1)).alias("lines"),
        F.avg((F.col("l_returnflag") == "R").cast("int")).alias("return_share")))


def raw_skus(t: Tables) -> DataFrame:
    """SKU file: one row per part, 24 raw headers (numbers typed, text as text).

    Supplier of a part: s_suppkey = p_partkey % count(supplier).  The count
    is a one-row aggregate, broadcast into the part scan.
    """
    n_supp = t.supplier.agg(F.count(F.lit(1)).alias("n_supp"))
    sup = (t.supplier.select("s_suppkey", "s_name", "s_nationkey")
           .join(_geo(t), F.col("s_nationkey") == F.col("n_nationkey"))
           .select("s_suppkey", "s_name", F.col("n_name").alias("s_nation")))
    p = (t.part.select("p_partkey", "p_type", "p_size", "p_retailprice")
         .crossJoin(F.broadcast(n_supp))
         .withColumn("supp_key", F.col("p_partkey") % F.col("n_supp")))
    joined = (p.join(part_sales(t), F.col("p_partkey") == F.col("l_partkey"), "left")
               .join(sup, F.col("supp_key") == F.col("s_suppkey"), "left"))
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    n = lambda c: c.cast("double")  # noqa: E731  numbers typed as a pandas CSV read infers them
    ship_cost = F.col("p_retailprice") * F.lit(0.01)
    mfg_cost = F.col("p_retailprice") * F.lit(0.6)
    cols = {
        "Product type": F.col("p_type"),
        "SKU": F.concat(F.lit("SKU"), s(k)),
        "Price": n(F.col("p_retailprice")),
        "Availability": n((k * 11) % 100),
        "Number of products sold": n(F.coalesce(F.col("sold"), F.lit(0.0))),
        "Revenue generated": n(F.coalesce(F.col("revenue").cast("double"), F.lit(0.0))),
        "Customer demographics": F.element_at(
            F.array(*[F.lit(x) for x in ["Male", "Female", "Non-binary", "Unknown"]]),
            (k % 4 + 1).cast("int")),
        "Stock levels": n(F.col("p_size") * 40),
        "Lead times": n(1 + (k * 7) % 30),
        "Order quantities": n(F.coalesce(F.col("lines"), F.lit(0))),
        "Shipping times": n(1 + k % 10),
        "Shipping carriers": F.concat(F.lit("Carrier "), s(k % 3 + 1)),
        "Shipping costs": n(ship_cost),
        "Supplier name": F.col("s_name"),
        "Location": F.col("s_nation"),
        "Lead time": n(1 + (k * 3) % 30),
        "Production volumes": n(F.col("p_size") * 20),
        "Manufacturing lead time": n(1 + k % 20),
        "Manufacturing costs": n(mfg_cost),
        "Inspection results": F.when(k % 3 == 0, "Pass").when(k % 3 == 1, "Fail")
                               .otherwise("Pending"),
        "Defect rates": n(F.col("return_share") * F.lit(5.0)),
        "Transportation modes": F.element_at(
            F.array(*[F.lit(x) for x in ["Road", "Rail", "Air", "Sea"]]), (k % 4 + 1).cast("int")),
        "Routes": F.concat(F.lit("Route "), F.element_at(
            F.array(*[F.lit(x) for x in ["A", "B", "C"]]), (k % 3 + 1).cast("int"))),
        "Costs": n(mfg_cost + ship_cost),
    }
    return joined.select(*[v.alias(k2) for k2, v in cols.items()])


# ---------------------------------------------------------------------------
# Warehouse star schema
# ---------------------------------------------------------------------------

class Warehouse:
    """Dimension and fact tables derived from the test tables (all lazy)."""

    def __init__(self, t: Tables, as_of: date = DEFAULT_AS_OF):
        self.t = t
        self.as_of = as_of

    # -- dimensions ---------------------------------------------------------
    def dim_products(self) -> DataFrame:
        return self.t.part.select(
            F.col("p_partkey").alias("product_id"),
            F.concat(F.lit("SKU"), F.col("p_partkey").cast("string")).alias("sku"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            (F.col("p_retailprice").cast("decimal(12,2)") * F.lit(Decimal("0.6"))).cast("decimal(12,2)").alias("unit_cost"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("unit_price"))

    def dim_locations(self) -> DataFrame:
        return _geo(self.t).select(
            F.col("n_nationkey").alias("location_id"),
            F.concat(F.lit("LOC-"), F.col("n_nationkey").cast("string")).alias("location_code"),
            F.col("n_name").alias("location_name"),
            F.when(F.col("n_nationkey") % 2 == 0, "warehouse").otherwise("distribution_center")
             .alias("location_type"),
            F.col("r_name").alias("region"))

    def dim_suppliers(self) -> DataFrame:
        return (self.t.supplier.join(_geo(self.t), F.col("s_nationkey") == F.col("n_nationkey"))
                .select(F.col("s_suppkey").alias("supplier_id"),
                        F.concat(F.lit("SUP-"), F.col("s_suppkey").cast("string")).alias("supplier_code"),
                        F.col("s_name").alias("supplier_name"),
                        F.col("n_name").alias("country"),
                        F.col("r_name").alias("region"),
                        (1 + F.col("s_suppkey") % 14).cast("int").alias("default_lead_time_days")))

    def dim_carriers(self) -> DataFrame:
        """Carriers present in the shipments (l_linenumber % 5)."""
        modes = F.array(*[F.lit(m) for m in CARRIER_MODES])
        return (self.t.lineitem.select((F.col("l_linenumber") % 5).cast("int").alias("carrier_id"))
                .distinct()
                .select("carrier_id",
                        F.concat(F.lit("CAR-"), F.col("carrier_id").cast("string")).alias("carrier_code"),
                        F.concat(F.lit("Carrier "), F.col("carrier_id").cast("string")).alias("carrier_name"),
                        F.element_at(modes, F.col("carrier_id") + 1).alias("transport_mode")))

    # -- facts ---------------------------------------------------------------
    def fact_purchase_orders(self) -> DataFrame:
        li = self.t.lineitem
        d = F.to_date("l_shipdate")
        qty = F.col("l_quantity").cast("int")
        u = undelivered()
        return li.select(
            line_key().alias("po_number"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_partkey").alias("product_id"),
            F.date_add(d, -10).alias("order_date"),
            d.alias("expected_delivery_date"),
            F.when(u, F.lit(None).cast("date"))
             .otherwise(F.date_add(d, ((F.col("l_orderkey") + F.col("l_partkey")) % 7 - 3).cast("int")))
             .alias("actual_delivery_date"),
            qty.alias("ordered_quantity"),
            F.when(u, F.lit(0)).otherwise((qty - F.col("l_orderkey") % 2).cast("int")).alias("received_quantity"),
            F.when(F.col("l_returnflag") == "R",
                   F.floor((qty - F.col("l_orderkey") % 2) / 10).cast("int")).otherwise(F.lit(0))
             .alias("defect_quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity") * F.lit(0.6)).cast("decimal(38,9)").cast("decimal(12,2)")
             .alias("unit_cost"),
            F.when(u, "placed").when(F.col("l_linestatus") == "F", "received").otherwise("closed")
             .alias("status"))

    def fact_inventory_snapshots(self) -> DataFrame:
        li = self.t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
        p = self.t.part.select("p_partkey", "p_size", "p_retailprice")
        s = self.t.supplier.select("s_suppkey", "s_nationkey")
        g = (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
               .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
               .groupBy(F.col("l_partkey").alias("product_id"),
                        F.col("s_nationkey").alias("location_id"),
                        F.to_date(F.date_trunc("month", "l_shipdate")).alias("snapshot_date"))
               .agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("q"),
                    F.max("p_size").alias("size"), F.max("p_retailprice").alias("price")))
        on_hand = (F.col("size") * 4 + F.col("q") % 50).cast("int")
        unit_cost = (F.col("price").cast("decimal(12,2)") * F.lit(Decimal("0.6"))).cast("decimal(12,2)")
        rop = ((F.col("product_id") * 13) % 150).cast("int")
        return (g.select(
            F.concat_ws("-", "product_id", "location_id", "snapshot_date").alias("snapshot_id"),
            "product_id", "location_id", "snapshot_date", "q",
            on_hand.alias("on_hand_quantity"),
            F.least(on_hand, (F.col("q") % 20).cast("int")).alias("reserved_quantity"),
            rop.alias("reorder_point"),
            F.floor(rop / 3).cast("int").alias("safety_stock"),
            unit_cost.alias("unit_cost"))
            .withColumn("available_quantity", F.col("on_hand_quantity") - F.col("reserved_quantity"))
            .withColumn("inventory_value",
                        (F.col("on_hand_quantity") * F.col("unit_cost")).cast("decimal(14,2)")))

    def fact_sales_demand(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        c = self.t.customer.select("c_custkey", "c_nationkey")
        g = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
               .join(c, F.col("o_custkey") == F.col("c_custkey"))
               .groupBy(F.to_date("o_orderdate").alias("demand_date"),
                        F.col("l_partkey").alias("product_id"),
                        F.col("c_nationkey").alias("location_id"))
               .agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("q"),
                    F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).alias("revenue")))
        return g.select("demand_date", "product_id", "location_id",
                        F.col("q").alias("quantity_demanded"),
                        (F.col("q") - F.col("q") % 5).alias("quantity_sold"),
                        (F.col("q") % 5).alias("lost_sales_quantity"),
                        "revenue")

    def fact_shipments(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                    "l_quantity", "l_extendedprice", "l_returnflag",
                                    "l_linestatus", "l_shipdate")
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
        c = self.t.customer.select("c_custkey", "c_nationkey")
        s = self.t.supplier.select("s_suppkey", "s_nationkey")
        d = F.to_date("l_shipdate")
        u = undelivered()
        qty = F.col("l_quantity").cast("int")
        df = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
                .join(c, F.col("o_custkey") == F.col("c_custkey"))
                .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
                .select(line_key().alias("shipment_id"),
                        line_key().alias("shipment_number"),
                        (F.col("l_linenumber") % 5).cast("int").alias("carrier_id"),
                        F.col("s_nationkey").alias("source_location_id"),
                        F.col("c_nationkey").alias("destination_location_id"),
                        F.col("l_suppkey").alias("supplier_id"),
                        F.col("l_partkey").alias("product_id"),
                        d.alias("ship_date"),
                        F.date_add(d, scheduled_days(F.col("o_orderpriority"))).alias("expected_delivery_date"),
                        F.when(u, F.lit(None).cast("date"))
                         .otherwise(F.date_add(d, ((F.col("l_orderkey") + F.col("l_partkey")) % 7).cast("int")))
                         .alias("actual_delivery_date"),
                        qty.alias("shipped_quantity"),
                        F.when(u, F.lit(0)).otherwise(qty).alias("delivered_quantity"),
                        (F.col("l_extendedprice").cast("decimal(12,2)") * F.lit(Decimal("0.02"))).cast("decimal(12,2)")
                         .alias("freight_cost"),
                        (100 + (F.col("l_orderkey") % 50) * 10).cast("decimal(10,2)").alias("distance_km"),
                        F.when(u, "in_transit").otherwise("delivered").alias("status")))
        from kestrel.functions.columns import date_diff_floor0, is_delayed
        return (df.withColumn("delay_days", date_diff_floor0("actual_delivery_date", "expected_delivery_date"))
                  .withColumn("is_delayed", is_delayed("actual_delivery_date", "expected_delivery_date")))

    # -- model outputs ----------------------------------------------------------
    def demand_forecasts(self) -> DataFrame:
        """Two horizons (7, 30 days) per stocked (product, location)."""
        keys = self.fact_inventory_snapshots().select("product_id", "location_id").distinct()
        base = ((F.col("product_id") * 7 + F.col("location_id") * 3) % 40 - 10).cast("int")
        h = F.explode(F.array(F.lit(7), F.lit(30))).alias("forecast_horizon_days")
        return (keys.select("product_id", "location_id", h)
                .select("product_id", "location_id", "forecast_horizon_days",
                        F.date_add(F.lit(self.as_of),
                                   base - F.when(F.col("forecast_horizon_days") == 30, 5).otherwise(0))
                         .alias("forecast_date"),
                        (F.col("product_id") % 50 + F.col("location_id") + F.col("forecast_horizon_days"))
                         .cast("decimal(14,2)").alias("predicted_quantity"),
                        F.date_sub(F.lit(self.as_of), F.col("forecast_horizon_days")).cast("timestamp")
                         .alias("created_at")))

    def inventory_recommendations(self) -> DataFrame:
        inv = self.fact_inventory_snapshots()
        avail, rop = F.col("available_quantity"), F.col("reorder_point")
        return inv.select(
            F.concat_ws("-", F.lit("REC"), "snapshot_id").alias("inventory_recommendation_id"),
            "product_id", "location_id",
            F.col("snapshot_date").alias("recommendation_date"),
            F.col("on_hand_quantity").alias("current_stock"),
            F.col("q").cast("decimal(14,2)").alias("forecasted_demand"),
            "reorder_point", "safety_stock",
            F.greatest(rop * 2 - avail, F.lit(0)).cast("int").alias("recommended_order_quantity"),
            F.when(avail <= rop / 2, "high").when(avail <= rop, "medium").otherwise("low").alias("priority"),
            F.when(F.col("snapshot_date") >= F.add_months(F.lit(self.as_of), -12), "open")
             .otherwise("completed").alias("status"),
            F.col("snapshot_date").cast("timestamp").alias("created_at"))

    def business_recommendations(self) -> DataFrame:
        """One reorder recommendation per at-risk inventory recommendation."""
        rec = self.inventory_recommendations().where(F.col("current_stock") <= F.col("reorder_point") * 2)
        short = F.col("reorder_point") - F.col("current_stock")
        return rec.select(
            F.concat_ws("-", F.lit("BR"), "inventory_recommendation_id").alias("business_recommendation_id"),
            "inventory_recommendation_id", "product_id", "location_id",
            F.lit("reorder").alias("recommendation_type"),
            F.when(short > 60, "critical").when(short > 30, "high").when(short > 0, "medium")
             .otherwise("low").alias("severity"),
            "status", "created_at")

    def supplier_performance_scores(self) -> DataFrame:
        """Monthly score history per supplier from its purchase orders."""
        po = self.fact_purchase_orders()
        on_time = (F.col("actual_delivery_date").isNotNull()
                   & (F.col("actual_delivery_date") <= F.col("expected_delivery_date"))).cast("int")
        g = (po.groupBy("supplier_id",
                        F.last_day("expected_delivery_date").alias("score_date"))
               .agg(F.count(F.lit(1)).alias("n"), F.sum(on_time).alias("on_time"),
                    F.sum("received_quantity").alias("received"),
                    F.sum("defect_quantity").alias("defects"),
                    F.sum((F.col("status") != "placed").cast("int")).alias("done")))
        d5 = lambda c: c.cast("decimal(5,2)")
        delivery = d5(F.round(F.col("on_time").cast("decimal(20,4)") * 100 / F.col("n"), 2))
        quality = d5(F.round(F.lit(100) - F.coalesce(
            F.try_divide(F.col("defects").cast("decimal(20,4)") * 100, F.col("received").cast("decimal(20,4)")),
            F.lit(0)), 2))
        cost = d5(((F.col("supplier_id") * 37) % 100).cast("decimal(5,2)"))
        reliability = d5(F.round(F.col("done").cast("decimal(20,4)") * 100 / F.col("n"), 2))
        scored = g.select("supplier_id", "score_date", delivery.alias("delivery_score"),
                          quality.alias("quality_score"), cost.alias("cost_score"),
                          reliability.alias("reliability_score"))
        w = lambda x: F.lit(Decimal(x))
        overall = d5(F.round(F.col("quality_score") * w("0.30") + F.col("delivery_score") * w("0.25")
                             + F.col("cost_score") * w("0.25") + F.col("reliability_score") * w("0.20"), 2))
        return (scored.withColumn("overall_score", overall)
                .withColumn("risk_tier", F.when(F.col("overall_score") <= 40, "high")
                            .when(F.col("overall_score") <= 70, "medium").otherwise("low"))
                .withColumn("created_at", F.col("score_date").cast("timestamp")))

    def shipment_delay_predictions(self) -> DataFrame:
        """Rule-scored prediction per shipment; carrier 0 also has an older one."""
        sh = self.fact_shipments()
        lead = F.datediff("expected_delivery_date", "ship_date")
        # decimal arithmetic end to end: exact in every engine
        prob = (F.when(lead <= 2, F.lit(Decimal("0.75"))
                       + F.least(F.col("freight_cost") * F.lit(Decimal("0.005")), F.lit(Decimal("0.20"))))
                .when(lead >= 5, F.lit(Decimal("0.12"))).otherwise(F.lit(Decimal("0.38"))))
        cur = sh.select("shipment_id", prob.cast("decimal(5,4)").alias("predicted_delay_probability"),
                        F.lit(None).cast("decimal(8,2)").alias("predicted_delay_days"),
                        F.when(prob >= 0.7, "high").when(prob >= 0.3, "medium").otherwise("low").alias("risk_level"),
                        F.col("ship_date").cast("timestamp").alias("created_at"))
        old = (sh.where(F.col("carrier_id") == 0)
                 .select("shipment_id", F.lit(Decimal("0.5")).cast("decimal(5,4)").alias("predicted_delay_probability"),
                         F.lit(None).cast("decimal(8,2)").alias("predicted_delay_days"),
                         F.lit("medium").alias("risk_level"),
                         F.date_sub("ship_date", 1).cast("timestamp").alias("created_at")))
        return cur.unionByName(old)


def supplier_products(t: Tables) -> DataFrame:
    """Bridge of (supplier, product) pairs that occur on order lines."""
    return (t.lineitem.groupBy(F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("product_id"))
            .agg(F.min("l_quantity").cast("int").alias("min_order_quantity"),
                 F.count(F.lit(1)).alias("lines"))
            .withColumn("is_preferred", F.col("lines") >= 2))


def fact_customer_orders(t: Tables) -> DataFrame:
    """One customer order line per lineitem (order number = line key)."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    c = t.customer.select("c_custkey", "c_nationkey")
    u = undelivered()
    return (t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(c, F.col("o_custkey") == F.col("c_custkey"))
            .select(line_key().alias("order_number"), F.col("c_nationkey").alias("customer_location_id"),
                    F.col("l_partkey").alias("product_id"), F.to_date("o_orderdate").alias("order_date"),
                    F.when(u, F.lit(None).cast("date")).otherwise(F.to_date("l_shipdate")).alias("actual_delivery_date"),
                    F.col("l_quantity").cast("int").alias("ordered_quantity"),
                    F.when(u, F.lit(0)).otherwise(F.col("l_quantity").cast("int")).alias("fulfilled_quantity"),
                    F.when(u, "open").otherwise("fulfilled").alias("status")))
