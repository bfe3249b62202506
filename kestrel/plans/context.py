"""One place that wires tables -> raw files -> clean/feature tables."""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from kestrel import schemas as S
from kestrel.operators import etl
from kestrel.plans.bridge import Warehouse, raw_orders, raw_skus
from kestrel.plans.store import stored
from kestrel.session import DEFAULT_AS_OF, compile_wide_projections
from kestrel.sources.tables import Tables

_WAREHOUSE_TABLES = ["dim_products", "dim_locations", "dim_suppliers", "dim_carriers", "fact_purchase_orders",
                     "fact_inventory_snapshots", "fact_sales_demand", "fact_shipments", "demand_forecasts",
                     "inventory_recommendations", "business_recommendations", "supplier_performance_scores",
                     "shipment_delay_predictions"]


# what the stored tables are built from
_SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


class StoredWarehouse(Warehouse):
    """Warehouse whose tables are built once and then read from Parquet."""

    def __init__(self, t: Tables, as_of: date, scope: str):
        super().__init__(t, as_of)
        self._scope = scope

    def __getattribute__(self, name):
        attr = object.__getattribute__(self, name)
        if name in _WAREHOUSE_TABLES:
            build = attr
            return lambda: stored(self.t.spark, self._scope, name, build)
        return attr


class Context:
    """Tables of one data folder.  With ``materialize`` the ETL outputs and
    warehouse tables are written once and read back (production shape);
    without it every query is one lineage from the raw tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: date = DEFAULT_AS_OF, materialize: bool = True):
        self.spark = spark
        compile_wide_projections(spark)
        self.t = Tables(spark, sf_dir)
        self.as_of = as_of
        self.materialize = materialize
        self._scope = f"{self.t.sf_dir}|{as_of.isoformat()}|{self._files() if materialize else ''}"
        self.wh = StoredWarehouse(self.t, as_of, self._scope) if materialize else Warehouse(self.t, as_of)

    def _files(self) -> str:
        """Digest of the source tables' files (name, length, time): new or changed
        files make new stored tables.  A listing through Hadoop, no Spark job."""
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        found = []
        for table in _SOURCES:
            path = hadoop.Path(f"{self.t.sf_dir}/{table}.parquet")
            fs = path.getFileSystem(conf)
            if fs.exists(path):
                found += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(path)]
        return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()

    def _stored(self, name: str, build) -> DataFrame:
        return stored(self.spark, self._scope, name, build) if self.materialize else build()

    def raw_orders(self) -> DataFrame:
        return raw_orders(self.t)

    def raw_skus(self) -> DataFrame:
        return raw_skus(self.t)

    def orders_clean(self) -> DataFrame:
        """Clean order items (ETL output)."""
        return self._stored("orders_clean", lambda: etl.clean_orders(self.raw_orders())[0])

    def orders(self) -> DataFrame:
        """Order-item feature table (24 columns) = projection of the clean table."""
        return self.orders_clean().select(*S.ORDERS_FEATURES)

    def skus_clean(self) -> DataFrame:
        return self._stored("skus_clean", lambda: etl.clean_skus(self.raw_skus())[0])

    def skus(self) -> DataFrame:
        """SKU feature table (27 columns)."""
        return self.skus_clean().select(*S.SKUS_FEATURES)
