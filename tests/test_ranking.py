from decimal import Decimal

from pyspark.sql import functions as F

from shelfspark import registry
from shelfspark.catalog import QUERIES
from shelfspark.functions.expressions import finite
from shelfspark.operators import quality, registered_quality
from shelfspark.plans import views
from shelfspark.plans.ranking import ranked, top_of_all, top_of_groups


def test_ranks_and_running_sums(spark):
    rows = spark.range(5000).select("id", (F.col("id") * 31 % 97).alias("v")).repartition(6)
    got = ranked(rows, [F.col("v").desc(), F.col("id")], "place", ["v"]).orderBy("place").collect()
    want = sorted([(-(i * 31 % 97), i) for i in range(5000)])
    running = 0
    for place, (row, (v, i)) in enumerate(zip(got, want, strict=True), 1):
        running -= v
        assert (row.id, row.place, row.n_all, row.running_v) == (i, place, 5000, Decimal(running))
    assert {r.all_v for r in got} == {Decimal(running)}
    assert ranked(rows.limit(0), [F.col("id")]).count() == 0


def test_group_limit_is_planned(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = top_of_groups(rows, ["g"], [F.col("id").desc()], 2)
    assert sorted((r.g, r.id, r["rank"]) for r in top.collect()) == [(0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r["rank"]) for r in top_of_all(rows, [F.col("id").desc()], 2).orderBy("rank").collect()] == [(999, 1), (998, 2)]


def test_no_window_over_all_entities(spark, data):
    """Ranks of entities come from ranges: no plan has a window without partition above them."""
    for name in ("i03a_impact_by_sku", "d08_value_concentration", "wn06_first_rank"):
        plan = registry.PLANS[name](registry.tables(spark, data))._jdf.queryExecution().optimizedPlan().toString()
        assert name in QUERIES and "Window" in plan and "SinglePartition" not in plan
        assert all("_part" in line for line in plan.split("\n") if "Window [" in line)


def test_planted_gaps_fail(spark):
    """A gap of 0.3 is far beyond the rate's tolerance and within that of amounts."""
    names = ["trapped_gap", "excess_gap", "delay_gap", "sku_gap", "warehouse_gap", "supplier_gap", "category_gap", "fact_gap", "snap_gap"]
    lines = lambda gap: {r.check_name: (r.status, r.observed) for r in registered_quality.agreement_lines(spark.createDataFrame([(*[gap] * len(names), 1.0)], ", ".join(f"{n} double" for n in [*names, "opportunity"]))).collect()}
    small, large = lines(0.3), lines(1.5)
    assert small.pop("dashboard_official_snapshot_present_and_reconciled") == ("FAIL", 0.3)
    assert all(status == "PASS" for status, _ in small.values())
    del large["impact_opportunity_non_negative"]
    assert large.pop("supplier_delay_proxy_consistency") == ("WARN", 1.5) and all(v == ("FAIL", 1.5) for v in large.values())
    negative = spark.createDataFrame([(*[0.0] * len(names), -1.0)], ", ".join(f"{n} double" for n in [*names, "opportunity"]))
    assert registered_quality.agreement_lines(negative).filter("status = 'FAIL'").first().check_name == "impact_opportunity_non_negative"


def test_reports_against_figures(spark):
    health = spark.createDataFrame([(0.9512, 0.0488, 12_340_000.0)], "overall_fill_rate double, overall_stockout_rate double, total_lost_sales_revenue double")
    right = "Overall fill rate is **95.12%** and a **4.90%** unit stockout rate. Lost sales exposure is **EUR 12.3M**."
    status = lambda *texts: [(r.status, r.observed is None) for r in registered_quality.report_checks(spark.createDataFrame([(t,) for t in texts], "text string"), health).collect()]
    assert status(right, None, "no figure") == [("PASS", False)] * 3
    assert status("nothing") == [("FAIL", True), ("FAIL", True), ("WARN", True)]
    assert status(right, "Overall fill rate is **97.0%**. Lost sales exposure is **EUR 20.0M**") == [("FAIL", False), ("PASS", False), ("WARN", False)]


def test_value_mismatches_are_found(spark):
    products = spark.createDataFrame([("a", 2.0)], "product_id string, unit_cost double")
    stock = spark.createDataFrame([("2020-01-01", "w", "a", 3, 6.0), ("2020-01-02", "w", "a", 3, 7.5), ("2020-01-03", "w", "a", 1, 2.04), ("2020-01-04", "w", "a", 1, 9.0)], "snapshot_date string, warehouse_id string, product_id string, on_hand_units long, inventory_value double")
    got = [(r.snapshot_date, r.inventory_value, r.expected_value) for r in quality.value_mismatches(stock, products).collect()]
    assert got == [("2020-01-04", 9.0, 2.0), ("2020-01-02", 7.5, 6.0)]


def test_large_amounts_add_up(spark):
    """Days of 9e11 each: their sum is beyond what a sum of first amounts is cast to."""
    daily = spark.sql("SELECT 'w' AS warehouse_id, 'r' AS region, date_add(DATE '2020-01-01', CAST(id AS INT)) AS date, 1L AS units_demanded, 1L AS units_fulfilled, 0L AS units_lost_sales, 9e11D AS lost_sales_revenue, 1.0D AS days_of_supply, 9e11D AS inventory_value, 1L AS on_hand_units, 1L AS on_order_units FROM range(20)")
    twice = daily.unionByName(daily)
    warehouses = spark.createDataFrame([("w", "W", 10)], "warehouse_id string, warehouse_name string, storage_capacity_units long")
    row = views.warehouse_profile(twice, warehouses).first()
    assert row.lost_sales_value == 3.6e13 and row.inventory_value == 1.8e12


def test_finite(spark):
    got = spark.sql("SELECT explode(array(1.5D, double('inf'), double('-inf'), double('nan'), null)) AS x").select(finite("x").alias("y")).collect()
    assert [r.y for r in got] == [1.5, 0.0, 0.0, 0.0, 0.0]
