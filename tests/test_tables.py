"""Written tables: partitions that are replaced and pruned, buckets that meet without an exchange, states that merge."""

import pathlib

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import quality
from shelfspark.operators.registered import base, prepared, skus, states
from shelfspark.operators.registered_facts import fact
from shelfspark.plans import scoring
from shelfspark.plans.views import daily_metrics, supplier_performance
from shelfspark.sources import fixtures
from shelfspark.sources.files import read_partitioned, write_partitioned
from shelfspark.sources.fixtures import GRAIN, Tables
from shelfspark.sources.scratch import scratch


@pytest.fixture(scope="module")
def tables(spark, data):
    return Tables(spark, data)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_are_replaced_one_by_one_and_pruned(spark):
    rows = spark.range(600).select((F.col("id") % 3).cast("int").alias("month"), "id")
    path = scratch(spark)
    write_partitioned(rows, path, "month")
    folder = pathlib.Path(path.removeprefix("file:"))
    before = {p.name: p.stat().st_mtime_ns for p in folder.glob("month=*/*.parquet")}
    write_partitioned(rows.filter("month = 1 and id < 30"), path, "month")
    after = {p.name: p.stat().st_mtime_ns for m in (0, 2) for p in folder.glob(f"month={m}/*.parquet")}
    assert after and all(before[name] == at for name, at in after.items())
    back = read_partitioned(spark, path, rows.schema)
    assert {r.month: r["count"] for r in back.groupBy("month").count().collect()} == {0: 200, 1: 10, 2: 200}
    one = back.filter("month = 2")
    assert one.count() == 200 and "PartitionFilters: [isnotnull(month" in plan_of(one)
    assert {row.f.split("month=")[1][0] for row in one.select(F.input_file_name().alias("f")).distinct().collect()} == {"2"}


def test_facts_meet_without_an_exchange(spark, tables):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = tables._demand.join(tables._stock, GRAIN)
        plan = plan_of(facts)
        daily = daily_metrics(tables._demand, tables._stock, tables.products, tables.warehouses, tables.product_classification, on=GRAIN)
        assert "SortMergeJoin [pk" in plan and "Exchange" not in plan and plan.count("lineitem") == 0
        assert "hashpartitioning(pk" not in plan_of(daily)
        by_text = daily_metrics(tables.demand_history, tables.inventory_snapshots, tables.products, tables.warehouses, tables.product_classification)
        assert daily.exceptAll(by_text).isEmpty() and by_text.count() == daily.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_new_month_is_added_to_states_alone(spark, tables):
    prepared = scoring.scoring_input(tables.daily, base(tables))
    whole = scoring.partial_states(prepared)
    last = prepared.agg(F.max("month")).first()[0]
    path = scratch(spark)
    write_partitioned(scoring.partial_states(prepared.filter(F.col("month") < last)), path, "month")
    folder = pathlib.Path(path.removeprefix("file:"))
    before = {p: p.stat().st_mtime_ns for p in folder.glob("month=*/*.parquet")}
    write_partitioned(scoring.partial_states(prepared.filter(F.col("month") == last)), path, "month")
    assert before and all(p.stat().st_mtime_ns == at for p, at in before.items()) and (folder / f"month={last}").exists()
    added = read_partitioned(spark, path, whole.schema)
    for keys in (scoring.SKU_KEYS, scoring.SUPPLIER_KEYS, scoring.SEGMENT_KEYS):
        a, b = scoring.entity_measures(added, keys), scoring.entity_measures(whole, keys)
        assert a.exceptAll(b).isEmpty() and a.count() == b.count()


def test_states_count_days_once_for_every_grain(tables):
    """Days of a supplier or segment are the union of its SKU-locations' days, whatever they share; no plan multiplies rows."""
    for keys in (scoring.SUPPLIER_KEYS, scoring.SEGMENT_KEYS):
        measures = scoring.entity_measures(states(tables), keys)
        assert "Expand" not in plan_of(measures)
        want = {tuple(r)[:-1]: r[-1] for r in tables.daily.groupBy(*keys).agg(F.countDistinct("date")).collect()}
        assert {tuple(r)[:-1]: r[-1] for r in measures.select(*keys, "active_days").collect()} == want


def test_facts_grow_in_buckets_and_group_by_product_without_an_exchange(spark, tables, monkeypatch):
    """More lines give more buckets; states, risk and monthly fact start from product buckets and move no day."""
    monkeypatch.setattr(fixtures, "BUCKET_LINES", 800)
    many = Tables(spark, tables.folder)
    assert many.buckets > tables.buckets == 4
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan_of(many._demand.join(many._stock, GRAIN))
        assert "Exchange" not in plan_of(many.daily.groupBy("product_id", "warehouse_id").agg(F.sum("units_demanded")))
        moved = [plan_of(scoring.partial_states(prepared(many))), plan_of(scoring.entity_measures(states(many), scoring.SKU_KEYS))]
        assert all("hashpartitioning(product_id" not in line or "warehouse_id" not in line for plan in moved for line in plan.split("\n"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert many.daily.exceptAll(tables.daily).isEmpty() and many.daily.count() == tables.daily.count()
    assert fact(many).exceptAll(fact(tables)).isEmpty() and skus(many).exceptAll(skus(tables)).isEmpty() and skus(many).count() == skus(tables).count() > 0


def test_suppliers_merge_without_months_and_states_are_not_written(spark, tables):
    """Sums travel without months, losses and days by month alone; an entity without a key stays. Amounts are sums of longs."""
    days = states(tables)
    odd = days.unionByName(days.limit(50).withColumn("supplier_id", F.lit(None).cast("string")))
    apart, merged = (scoring.entity_measures(odd, scoring.SUPPLIER_KEYS, months_apart=x) for x in (True, False))
    assert apart.select(*merged.columns).exceptAll(merged).isEmpty() and apart.count() == merged.count() > 1 and not apart.filter("supplier_id is null").isEmpty()
    assert skus(tables).count() > 0 and "states" not in tables._kept
    assert "decimal(28" not in plan_of(scoring.partial_states(prepared(tables)))


def test_large_dimensions_are_met_by_sorting(spark, data, monkeypatch):
    """Parts, suppliers and customers of more rows than the driver should hold are not broadcast, however small their files are."""
    usual = Tables(spark, data)
    monkeypatch.setattr(fixtures, "BROADCAST_ROWS", 1, raising=False)
    large = Tables(spark, data)
    for df, joins in ((large.purchase_orders, 3), (supplier_performance(large.purchase_orders, large.suppliers), 4), (large.by_product(base(large), "supplier_risk_score_base"), 1)):
        plan = plan_of(df)
        assert plan.count("SortMergeJoin") >= joins and "BroadcastHashJoin [pk" not in plan and "BroadcastHashJoin [o_" not in plan and "BroadcastHashJoin [supplier_id" not in plan
    checks = quality.raw_checks(large.inventory_snapshots, large.purchase_orders, large.products, large.suppliers, large.demand_history)
    assert "BroadcastHashJoin [product_id" not in plan_of(checks) and "BroadcastHashJoin [pk" not in plan_of(checks)
    assert large.purchase_orders.exceptAll(usual.purchase_orders).isEmpty() and large.purchase_orders.count() == usual.purchase_orders.count()
    assert large.daily.exceptAll(usual.daily).isEmpty() and large.daily.count() == usual.daily.count()
