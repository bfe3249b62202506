import duckdb
import pytest

import __spark_entry__ as E
from kestrel.sources.tables import TABLES

SMOKE = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and set(df.columns) >= {"shipping_mode", "total_orders", "late_shipments"}


def test_oracle_keys_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 150


@pytest.mark.parametrize("name", ["agg_shipping_mode_kpis", "bi_executive_kpis", "bi_supplier_dashboard",
                                  "score_suppliers", "optimize_inventory", "kruskal_wallis", "dq_range_checks",
                                  "psi_drift"])
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    got = E.queries()[name](spark, SMOKE).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda df: sorted(tuple(None if v != v else v for v in r)
                             for r in df[cols].astype(object).itertuples(index=False, name=None))
    assert norm(got) == norm(want)


def test_contract_imports_without_spark():
    """The driver may ask for oracle_sql() before any session exists."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import __spark_entry__ as E; o = E.oracle_sql(); q = E.queries(); "
            "assert set(o) <= set(q) and len(o) > 150")
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True, timeout=300)
