"""Schemas, column maps and domains of the supply-chain data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Raw header -> snake_case name, order items file (53 columns).
# ---------------------------------------------------------------------------
ORDERS_COLUMN_MAP = {
    "Type": "payment_type",
    "Days for shipping (real)": "actual_shipping_days",
    "Days for shipment (scheduled)": "scheduled_shipping_days",
    "Benefit per order": "benefit_per_order",
    "Sales per customer": "sales_per_customer",
    "Delivery Status": "delivery_status",
    "Late_delivery_risk": "late_delivery_risk",
    "Category Id": "category_id",
    "Category Name": "category_name",
    "Customer City": "customer_city",
    "Customer Country": "customer_country",
    "Customer Email": "customer_email",
    "Customer Fname": "customer_first_name",
    "Customer Id": "customer_id",
    "Customer Lname": "customer_last_name",
    "Customer Password": "customer_password",
    "Customer Segment": "customer_segment",
    "Customer State": "customer_state",
    "Customer Street": "customer_street",
    "Customer Zipcode": "customer_zipcode",
    "Department Id": "department_id",
    "Department Name": "department_name",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "Market": "market",
    "Order City": "order_city",
    "Order Country": "order_country",
    "Order Customer Id": "order_customer_id",
    "order date (DateOrders)": "order_date",
    "Order Id": "order_id",
    "Order Item Cardprod Id": "order_item_cardprod_id",
    "Order Item Discount": "order_item_discount",
    "Order Item Discount Rate": "order_item_discount_rate",
    "Order Item Id": "order_item_id",
    "Order Item Product Price": "order_item_product_price",
    "Order Item Profit Ratio": "order_item_profit_ratio",
    "Order Item Quantity": "order_item_quantity",
    "Sales": "sales",
    "Order Item Total": "order_item_total",
    "Order Profit Per Order": "order_profit_per_order",
    "Order Region": "order_region",
    "Order State": "order_state",
    "Order Status": "order_status",
    "Order Zipcode": "order_zipcode",
    "Product Card Id": "product_card_id",
    "Product Category Id": "product_category_id",
    "Product Description": "product_description",
    "Product Image": "product_image",
    "Product Name": "product_name",
    "Product Price": "product_price",
    "Product Status": "product_status",
    "shipping date (DateOrders)": "shipping_date",
    "Shipping Mode": "shipping_mode",
}

# Raw header -> snake_case name, SKU file (24 columns).
SKUS_COLUMN_MAP = {
    "Product type": "product_type",
    "SKU": "sku",
    "Price": "product_price",
    "Availability": "availability",
    "Number of products sold": "products_sold",
    "Revenue generated": "revenue_generated",
    "Customer demographics": "customer_demographics",
    "Stock levels": "stock_levels",
    "Lead times": "source_lead_time_days",
    "Order quantities": "order_quantities",
    "Shipping times": "shipping_times",
    "Shipping carriers": "shipping_carrier",
    "Shipping costs": "shipping_cost",
    "Supplier name": "supplier_name",
    "Location": "supplier_location",
    "Lead time": "manufacturing_lead_time_days",
    "Production volumes": "production_volumes",
    "Manufacturing lead time": "manufacturing_process_lead_time_days",
    "Manufacturing costs": "manufacturing_costs",
    "Inspection results": "inspection_result",
    "Defect rates": "defect_rate_raw",
    "Transportation modes": "transportation_mode",
    "Routes": "route",
    "Costs": "total_costs",
}

# PII / bulky columns removed from the clean order items.
SENSITIVE_ORDER_COLUMNS = [
    "customer_email", "customer_password", "customer_first_name", "customer_last_name",
    "customer_street", "product_description", "product_image",
]

# Numeric columns of the order items file.
ORDERS_NUMERIC = [
    "actual_shipping_days", "scheduled_shipping_days", "benefit_per_order",
    "sales_per_customer", "late_delivery_risk", "category_id", "customer_id",
    "customer_zipcode", "department_id", "latitude", "longitude", "order_customer_id",
    "order_id", "order_item_cardprod_id", "order_item_discount", "order_item_discount_rate",
    "order_item_id", "order_item_product_price", "order_item_profit_ratio",
    "order_item_quantity", "sales", "order_item_total", "order_profit_per_order",
    "order_zipcode", "product_card_id", "product_category_id", "product_price",
    "product_status",
]
ORDERS_DATETIME = ["order_date", "shipping_date"]
ORDERS_ZIPCODES = ["customer_zipcode", "order_zipcode"]

# Numeric columns of the SKU file.
SKUS_NUMERIC = [
    "product_price", "availability", "products_sold", "revenue_generated", "stock_levels",
    "source_lead_time_days", "order_quantities", "shipping_times", "shipping_cost",
    "manufacturing_lead_time_days", "production_volumes",
    "manufacturing_process_lead_time_days", "manufacturing_costs", "defect_rate_raw",
    "total_costs",
]

# Feature projections.
ORDERS_FEATURES = [
    "order_id", "order_item_id", "product_card_id", "customer_id", "order_date",
    "shipping_date", "actual_shipping_days", "scheduled_shipping_days",
    "delivery_delay_days", "shipping_ahead_days", "late_delivery_flag",
    "benefit_per_order", "sales", "profit_margin_pct", "order_item_discount_rate",
    "discount_rate_pct", "customer_segment", "market", "order_region", "order_status",
    "shipping_mode", "product_name", "category_name", "department_name",
]
SKUS_FEATURES = [
    "sku", "product_type", "supplier_name", "supplier_location", "product_price",
    "availability", "products_sold", "revenue_generated", "stock_levels", "inventory_gap",
    "sell_through_rate", "source_lead_time_days", "manufacturing_lead_time_days",
    "lead_time_gap_days", "shipping_times", "shipping_cost", "shipping_cost_per_unit",
    "production_volumes", "manufacturing_costs", "manufacturing_cost_per_unit",
    "inspection_result", "defect_rate_raw", "defect_rate_out_of_range_flag",
    "quality_pass_flag", "quality_fail_flag", "transportation_mode", "route",
]

# Model feature lists.
DELAY_CATEGORICALS = ["shipping_mode", "order_region", "category_name", "market",
                      "customer_segment", "department_name"]
DELAY_NUMERICS = ["sales", "discount_rate_pct", "scheduled_shipping_days", "benefit_per_order"]
DELAY_TARGET = "late_delivery_flag"
DEMAND_NUMERICS = ["discount_rate_pct", "benefit_per_order", "scheduled_shipping_days"]
DEMAND_TARGET = "sales"

# Upload schemas (column -> default), in declaration order.
SHIPMENT_SCHEMA = {
    "shipping_mode": "Standard Class",
    "days_for_shipment_scheduled": 4,
    "days_for_shipping_real": 4,
    "order_item_discount": 0.0,
    "order_item_discount_rate": 0.0,
    "order_item_profit_ratio": 0.1,
    "order_item_quantity": 1,
    "sales": 100.0,
    "order_item_total": 100.0,
    "benefit_per_order": 10.0,
    "sales_per_customer": 100.0,
    "category_name": "Unknown",
    "customer_segment": "Consumer",
    "market": "US",
    "order_region": "Central",
}
INVENTORY_SCHEMA = {
    "sku": "",
    "product_type": "general",
    "supplier_name": "Unknown",
    "stock_levels": 0,
    "products_sold": 0,
    "lead_time_days": 7,
    "avg_daily_demand": 0.0,
    "std_daily_demand": 0.0,
    "safety_stock": 0,
    "reorder_point": 0,
    "stockout_risk": 0,
    "reorder_qty": 0,
    "revenue_at_risk": 0.0,
}
SUPPLIER_SCHEMA = {
    "supplier_name": "Unknown",
    "quality_score": 50.0,
    "delivery_score": 50.0,
    "cost_score": 50.0,
    "reliability_score": 50.0,
    "overall_score": 50.0,
    "risk_tier": "medium",
}
UPLOAD_SCHEMAS = {"shipment": SHIPMENT_SCHEMA, "inventory": INVENTORY_SCHEMA,
                  "supplier": SUPPLIER_SCHEMA}
DETECTION_THRESHOLD = 0.3

# Alias columns read by the serving layer (first truthy wins).
SUPPLIER_ALIASES = {
    "supplier_name": ["supplier_name", "Supplier", "supplier"],
    "quality_score": ["quality_score", "Quality Score"],
    "delivery_score": ["delivery_score", "Delivery Score"],
    "cost_score": ["cost_score", "Cost Score"],
    "reliability_score": ["reliability_score", "Reliability Score"],
    "overall_score": ["overall_score", "Overall Score"],
    "risk_tier": ["risk_tier", "Risk Tier"],
}
INVENTORY_ALIASES = {
    "sku": ["sku", "SKU", "product_sku"],
    "product_type": ["product_type", "category", "Product Type"],
    "supplier_name": ["supplier_name", "Supplier", "supplier"],
    "stock_levels": ["stock_levels", "stock", "current_stock", "stock_level"],
    "reorder_point": ["reorder_point", "Reorder Point"],
    "safety_stock": ["safety_stock", "Safety Stock"],
    "reorder_qty": ["reorder_qty", "recommended_order_quantity", "Reorder Qty"],
    "avg_daily_demand": ["avg_daily_demand", "Daily Demand"],
    "unit_cost": ["unit_cost", "Unit Cost"],
}
KPI_LATE_ALIASES = ["late_delivery_flag", "late_shipment", "late"]
KPI_SALES_ALIASES = ["sales", "order_item_total", "total"]
KPI_PROFIT_ALIASES = ["benefit_per_order", "profit", "benefit"]

# Enum domains of the warehouse.
ENUMS = {
    "app_role": ["admin", "analyst", "manager", "executive"],
    "location_type": ["supplier", "warehouse", "distribution_center", "port", "store", "customer"],
    "transport_mode": ["road", "rail", "ocean", "air", "multimodal"],
    "purchase_order_status": ["planned", "placed", "in_transit", "received", "cancelled", "closed"],
    "customer_order_status": ["planned", "open", "partially_fulfilled", "fulfilled", "cancelled", "returned"],
    "shipment_status": ["planned", "in_transit", "delivered", "delayed", "cancelled"],
    "etl_status": ["running", "success", "failed", "partial"],
    "data_quality_severity": ["info", "warning", "error", "critical"],
    "model_type": ["demand_forecast", "delay_prediction", "supplier_scoring",
                   "inventory_optimization", "recommendation"],
    "risk_level": ["low", "medium", "high", "critical"],
    "recommendation_status": ["open", "accepted", "rejected", "completed", "expired"],
    "recommendation_type": ["reorder", "supplier_risk", "logistics_intervention",
                            "demand_planning", "inventory_rebalance"],
}

# Core warehouse tables (21) the catalogue check expects.
WAREHOUSE_TABLES = [
    "profiles", "etl_batch_runs", "data_quality_issues", "raw_source_files",
    "raw_source_records", "dim_locations", "dim_products", "dim_suppliers",
    "supplier_products", "dim_carriers", "fact_purchase_orders", "fact_customer_orders",
    "fact_sales_demand", "fact_inventory_snapshots", "fact_shipments", "model_registry",
    "demand_forecasts", "shipment_delay_predictions", "supplier_performance_scores",
    "inventory_recommendations", "business_recommendations",
]
BI_VIEWS = ["bi_executive_kpis", "bi_inventory_dashboard", "bi_supplier_dashboard",
            "bi_logistics_dashboard", "bi_inventory_recommendations"]

# Violation rows follow the data-quality issue table.
ISSUE_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("record_key", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
])

# Workspace records: one semi-structured payload per source row.
WORKSPACE_RECORD_SCHEMA = T.StructType([
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("user_email", T.StringType(), False),
    T.StructField("row_number", T.LongType(), False),
    T.StructField("payload", T.StringType(), True),
])
