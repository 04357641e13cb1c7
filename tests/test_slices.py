"""Slices read from the facet cube equal slices of the fact."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import facts, quality
from shelfspark.operators.registered_facts import cube, fact
from shelfspark.registry import PLANS
from shelfspark.sources.fixtures import Tables


@pytest.fixture(scope="module")
def tables(spark, data):
    return Tables(spark, data)


def rows(df):
    return sorted(map(repr, df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).collect()))


def test_ten_random_facet_sets(tables):
    whole, cells = fact(tables), cube(tables)
    pick = random.Random(9)
    values = {d: sorted(r[0] for r in whole.select(d).distinct().collect()) for d in ("region", "warehouse_id", "category", "supplier_id", "abc_class", "product_id", "month")}
    kinds = [(set(), facts.slice_totals), (set(), facts.by_month), ({"warehouse_id", "region"}, lambda f: facts.by_warehouse(f, tables.warehouses)), ({"category"}, facts.by_category), ({"region"}, facts.by_region), ({"category", "region"}, facts.by_segment)]
    for i in range(10):
        chosen = pick.sample(["region", "warehouse_id", "category", "supplier_id", "abc_class", "product_id"], pick.randrange(0, 4))
        months = tuple(pick.sample(values["month"], 2)) if i % 3 else None  # in any order
        shown = facts.Slice({d: "ALL" if pick.random() < 0.2 else pick.choice(values[d]) for d in chosen}, months)
        keys, summed = kinds[i % len(kinds)]
        assert rows(summed(facts.slice_rows(cells, whole, shown, keys))) == rows(summed(shown.of(whole))), (shown, keys)


def test_cells_are_pruned_and_few(tables):
    cells = cube(tables)
    assert cells.select("cuboid").distinct().count() == len(facts.cuboids()) == 24
    found = facts.cells(cells, {"category"})
    assert "PartitionFilters: [isnotnull(cuboid" in found._jdf.queryExecution().executedPlan().toString()
    months, categories = (fact(tables).select(c).distinct().count() for c in ("month", "category"))
    assert 0 < found.count() <= months * categories


def test_values_are_parameters(tables):
    whole = fact(tables)
    assert facts.Slice({"category": "x' OR '1'='1"}).of(whole).count() == 0
    with pytest.raises(ValueError, match="no such facets"):
        facts.Slice({"category = '' OR 1": "x"}).of(whole)
    assert facts.Slice({"region": "ALL"}).of(whole) is whole


def test_every_check_finds_its_fault(spark):
    """One planted fault a check: each count is that fault's and no other's."""
    day = date(2020, 1, 1)
    demand = [(day, "w", str(i), 10, 10, 0, 0) for i in range(12)]
    demand[0] = (*demand[0][:3], 10, 11, -1, 0)  # above demand, negative
    demand[1] = (*demand[1][:3], 10, 8, 2, 0)  # a loss without its flag
    demand[2] = (*demand[2][:3], 0, 1, -1, 0)  # activity without demand, negative
    demand.append(demand[5])
    stock = [(day, "w", str(i), 5, 0, 1, 4, 10.0) for i in range(12)]
    stock[0] = (*stock[0][:3], 5, 0, 1, 3, 10.0)  # available is not what is left
    stock[1] = (*stock[1][:3], 5, 0, 1, 4, 10.2)  # another value
    stock[2] = (*stock[2][:3], 5, -1, 1, 4, 10.0)
    stock += [stock[7], stock[7], stock[8]]
    orders = [("a", day, day, day, 1, 1), ("b", day, date(2019, 1, 1), day, 1, 1), ("c", day, day, day, -1, 1), ("a", day, day, day, 1, 1)]
    products = [(str(i), "c", 2.0, None if i == 3 else 3.0) for i in range(12)]
    frame = spark.createDataFrame
    got = quality.validation(
        frame(demand, "date date, warehouse_id string, product_id string, units_demanded long, units_fulfilled long, units_lost_sales long, stockout_flag long"),
        frame(stock, "snapshot_date date, warehouse_id string, product_id string, on_hand_units long, on_order_units long, reserved_units long, available_units long, inventory_value double"),
        frame(orders, "po_id string, order_date date, expected_arrival_date date, actual_arrival_date date, ordered_units long, received_units long"),
        frame(products, "product_id string, category string, unit_cost double, unit_price double"),
    )
    assert {r.check_name: (r.issue_count, r.status) for r in got.collect()} == {
        "fill_rate_out_of_bounds": (1, "FAIL"), "stockout_logic_inconsistencies": (1, "FAIL"), "zero_demand_denominator_sanity": (1, "FAIL"), "impossible_negative_values": (4, "FAIL"), "duplicate_keys_demand_history": (1, "FAIL"),
        "inventory_value_consistency": (1, "FAIL"), "available_units_consistency": (1, "FAIL"), "duplicate_keys_inventory_snapshots": (2, "FAIL"), "po_date_inconsistencies": (1, "FAIL"), "duplicate_keys_purchase_orders": (1, "FAIL"), "critical_null_fields": (1, "FAIL"),
    }


def test_validation_reads_each_table_once(spark, tables):
    plan = quality.validation(tables.demand_history, tables.inventory_snapshots, tables.purchase_orders, tables.products)._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.split("\n") if "Relation" in line]
    assert "Expand" not in plan and sum("spark_catalog" in r for r in reads) == 2 and sum("l_orderkey" in r for r in reads) == 1, reads


def test_days_as_bitmaps(spark):
    """Days around the first of 1970, of two buckets, of two parts merged; gaps are the complement."""
    days = spark.sql("SELECT date_add(DATE '1970-01-01', x) AS d FROM VALUES (-40000), (-9), (-1), (0), (1), (7), (8), (32768), (32769), (NULL) t(x)")
    parts = quality.day_bitmaps(days.filter("d < DATE '1970-01-05'"), ["d"]).unionByName(quality.day_bitmaps(days.filter("d > DATE '1969-12-30'"), ["d"]))
    merged = quality.merged_bitmaps(parts)
    want = sorted(r.d for r in days.filter("d is not null").collect())
    assert sorted(r.day for r in quality.days_of(merged).collect()) == want
    assert merged.agg(F.sum(F.bitmap_count("days"))).first()[0] == len(want)
    gaps = quality.missing_dates(days.filter("d >= DATE '1969-12-20' AND d < DATE '1980-01-01'"), ["d"]).collect()
    assert len(gaps) == 8 + 9 - 1 + 1 - 6 + 1 and all(r.day not in want for r in gaps)
    assert quality.missing_dates(days.limit(0), ["d"]).count() == 0
    row = quality.date_coverage("t", days, ["d"]).first()
    assert (row.distinct_dates, row.expected_days, row.missing_days) == (9, 72770, 72761)


def test_a_slice_makes_its_own_roll_up_only(spark, data):
    """Totals write one cell a month, not the cube; the cells are those of the cube."""
    alone = Tables(spark, data)
    totals = PLANS["db09_slice_totals_all_months"](alone)
    assert "facet cube" not in alone._kept and alone._kept["cells by month"].count() == fact(alone).select("month").distinct().count()
    assert rows(totals) == rows(facts.slice_totals(fact(alone)))
    for columns in (["month", "supplier_id"], ["month", "region", "category"]):
        found = facts.cells(cube(alone), set(columns)).select(facts.roll_up(fact(alone), columns).columns)
        assert rows(found) == rows(facts.roll_up(fact(alone), columns))
