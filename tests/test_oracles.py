import math

import duckdb
import pytest

from shelfspark import catalog

TABLES = "region nation customer supplier part orders lineitem documents".split()
SOME = ["v01_daily_product_warehouse_metrics", "v02_supplier_performance_summary", "v04_warehouse_service_profile", "f04_sku_risk_baseline", "s06_sku_risk_governed", "s10_management_counts", "i04_impact_overall", "k09_top_risk_skus", "d10_stockout_levels", "d14_tradeoff_zones", "vz10_days_of_supply_bins", "db16_slice_by_sku", "db20_kpi_tiles", "dc05_contract_run", "dp03_cardinality", "q12_validation_summary", "p46_written_conclusion_overclaiming_risk", "ex20_tiers", "ex27_pattern_count", "jn11_reconcile", "ag10_skewness", "ag13_mode", "ag18_levels", "wn03_running_sum"]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value if value is None or isinstance(value, (int, str)) else str(value)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, data)
    result = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == theirs


def test_every_query_has_its_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", ["db09_slice_totals", "db10_slice_by_month", "db16_slice_by_sku", "db20_kpi_tiles"])
def test_slices_over_all_months(spark, data, name):
    test_query_equals_oracle(spark, data, f"{name}_all_months")


def test_all_months_are_all_months(spark, data):
    months = lambda name: {r.month for r in catalog.QUERIES[name](spark, data).select("month").distinct().collect()}
    assert months("db10_slice_by_month_all_months") == months("db02_monthly_sku_fact") > months("db10_slice_by_month")
    assert sum(n.endswith("_all_months") for n in catalog.QUERIES) == 17
    assert not any("1996-01-01' AND DATE" in sql for n, sql in catalog.ORACLES.items() if n.endswith("_all_months"))
