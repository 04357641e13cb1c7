"""Contracts, profiles and checks. Each table is read once for all conditions that concern it."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.expressions import fill_ratio, ratio
from shelfspark.plans.selection import quantiles, quantiles_of_tables

CHECK = "check_name string, layer string, method string, status string, severity string, observed string, expected string, details string"


def count_rows(condition: Column) -> Column:
    """Rows where a condition holds (unknown: not)."""
    return F.coalesce(F.sum(F.when(condition, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"))


def nulls(columns: list[str]) -> Column:
    """Null cells over some columns."""
    return reduce(lambda a, b: a + b, [count_rows(F.col(c).isNull()) for c in columns])


def negatives(columns: list[str]) -> Column:
    """Negative cells over some columns."""
    return reduce(lambda a, b: a + b, [count_rows(F.col(c) < 0) for c in columns])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: duplicated, how many rows repeat a key that has come before."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicated"), count_rows(F.col("n") > 1).alias("keys"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# -- contracts --------------------------------------------------------------------------------------------------------


CONTRACT_RESULT = "table_name string, check_name string, severity string, status string, observed long, expected long, details string"


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def contract_results(name: str, df: DataFrame, required: list[str], keys: list[str], critical: list[str], non_negative: list[str]) -> DataFrame:
    """Results of one table's contract: required columns, then unique key, critical nulls, non-negative fields.

    A missing required column ends the contract with one failed result, as the rest cannot be judged.
    """
    missing = missing_columns(df, required)
    head = df.sparkSession.createDataFrame([(name, "required_columns_present", "HIGH", "FAIL" if missing else "PASS", len(missing), 0, "missing: " + ", ".join(missing) if missing else "all required columns")], CONTRACT_RESULT)
    if missing:
        return head
    counted = df.agg(nulls(critical).alias("nulls"), negatives(non_negative).alias("negatives")) if non_negative else df.agg(nulls(critical).alias("nulls"), F.lit(0).cast("long").alias("negatives"))
    row = counted.crossJoin(duplicate_keys(df, keys))  # one row each
    checks = [("unique_key", "HIGH", "duplicated", ", ".join(keys)), ("critical_not_null", "HIGH", "nulls", ", ".join(critical)), ("non_negative", "HIGH", "negatives", ", ".join(non_negative) or "none")]
    structs = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("check_name"), F.lit(s).alias("severity"), F.when(F.col(v) == 0, "PASS").otherwise("FAIL").alias("status"), F.col(v).alias("observed"), F.lit(0).cast("long").alias("expected"), F.lit(d).alias("details")) for c, s, v, d in checks]
    return head.unionByName(row.select(F.inline(F.array(*structs))))


def run_contracts(spark: SparkSession, contracts: DataFrame, folder: str, fmt: str = "parquet") -> DataFrame:
    """Results of every contract of a document (rows of ``read_contracts``) over the files in ``folder``.

    A table without a file has one failed result. A document names a few tables, so its rows are read by the driver.
    """
    results = []
    for c in contracts.collect():
        try:
            df = spark.read.format(fmt).option("header", True).load(f"{folder}/{c.path}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            results.append(spark.createDataFrame([(c.name, "table_exists", "HIGH", "FAIL", 1, 0, f"missing: {c.path}")], CONTRACT_RESULT))
            continue
        results.append(contract_results(c.name, df, c.required_columns or [], c.unique_key or [], c.critical_columns or [], c.non_negative or []))
    return union(results) if results else spark.createDataFrame([], CONTRACT_RESULT)


def contract_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("checks"), count_rows(F.col("status") == "FAIL").alias("failed"), count_rows(F.col("status") == "WARN").alias("warned"))


# -- profiles ---------------------------------------------------------------------------------------------------------


def table_summary(name: str, df: DataFrame, keys: list[str], non_negative: list[str], bounded: dict[str, tuple[float, float]], domains: dict[str, list]) -> DataFrame:
    """rows, columns, duplicate keys, share of null cells, impossible values (below 0, out of bounds, out of domain)."""
    impossible = [count_rows(F.col(c) < 0) for c in non_negative]
    impossible += [count_rows((F.col(c) < lo) | (F.col(c) > hi)) for c, (lo, hi) in bounded.items()]
    impossible += [count_rows(F.col(c).isNull() | ~F.col(c).isin(*values)) for c, values in domains.items()]
    total = reduce(lambda a, b: a + b, impossible, F.lit(0).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("row_count"), nulls(df.columns).alias("nulls"), total.alias("impossible_values")).crossJoin(duplicate_keys(df, keys).select(F.col("duplicated").alias("duplicate_key_rows")))  # one row each
    return row.select(F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"), "duplicate_key_rows", ratio("nulls", F.col("row_count") * len(df.columns), 0.0).alias("null_rate"), "impossible_values")


def null_profile(name: str, df: DataFrame) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("n"), *[count_rows(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns])
    return row.select(F.inline(F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"null_{c}").alias("null_count"), ratio(f"null_{c}", "n", 0.0).alias("null_rate")) for c in df.columns])))


def cardinality(name: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each column, its most frequent one (the smallest of equals) and that one's share.

    Values of all columns are counted in one shuffle, already summed by task.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])))
    counted = long.filter("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("top")
    out = counted.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("rows"), top)
    return out.select(F.lit(name).alias("table_name"), "column_name", "distinct_values", F.col("top.value").alias("top_value"), ratio(-F.col("top.k"), "rows", 0.0).alias("top_share"))


def distributions(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Least, percentiles, most, mean, deviation, bias-corrected skewness and p99 over p50 of columns of tables."""
    points = quantiles_of_tables(tables, [0.5, 0.95, 0.99])
    return union([distribution(name, df, columns, points[name]) for name, (df, columns) in tables.items()])


def distribution(name: str, df: DataFrame, columns: list[str], points: dict[str, list[float | None]]) -> DataFrame:
    """The lines of one table, of whose columns p50, p95 and p99 are known."""
    parts = []
    for c in columns:
        x, n = F.col(c).cast("double"), F.count(F.col(c)).cast("double")
        known = [F.lit(p).cast("double").alias(q) for p, q in zip(points[c], ("p50", "p95", "p99"), strict=True)]
        skew = F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
        parts.append(F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.min(x).alias("min"), *known, F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), skew.alias("skew")).alias(f"d_{c}"))
    row = df.agg(*parts).select(F.inline(F.array(*[F.col(f"d_{c}") for c in columns])))
    return row.withColumn("p99_p50_ratio", ratio("p99", "p50", 0.0))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of different values of each column, exact.

    Several exact distinct counts in one aggregate copy every row for each column before it is summed. Here a row gives each
    column's value once, equal ones are dropped by task, and what is shuffled are the different values of each task.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])))
    counted = long.filter("v is not null").distinct().groupBy("i").agg(F.count("v").alias("n"))
    return counted.agg(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(columns)])


def day_bitmaps(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, bucket, days: the days of each date column as bits, 32768 days to a bucket.

    Bitmaps are made by task and merged by ``or``, so days of months, tables or files can be kept and joined later.
    """
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), number(c).alias("d")) for c in columns]))).filter("d is not null")
    return long.groupBy("column_name", F.bitmap_bucket_number("d").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("d")).alias("days"))


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Bitmaps of several parts as one."""
    return bitmaps.groupBy("column_name", "bucket").agg(F.bitmap_or_agg("days").alias("days"))


def days_of(bitmaps: DataFrame) -> DataFrame:
    """column_name and day of every bit that is set."""
    byte = F.col("byte")
    number = F.conv(F.hex(byte), 16, 10).cast("int")
    each = bitmaps.select("column_name", "bucket", "days", F.explode(F.sequence(F.lit(0), F.length("days") - 1)).alias("at")).withColumn("byte", F.substring(F.col("days"), F.col("at") + 1, F.lit(1)))
    bits = each.filter(F.hex(byte) != "00").select("column_name", "bucket", "at", number.alias("number"), F.explode(F.array(*map(F.lit, range(8)))).alias("bit"))
    found = bits.filter(F.expr("shiftright(number, bit) & 1 = 1"))
    # the positions of a bucket count up from its first number where that is positive, and down from it elsewhere
    place, bucket = F.col("at") * 8 + F.col("bit"), F.col("bucket")
    number = F.when(bucket > 0, (bucket - 1) * 32768 + place + 1).otherwise(bucket * 32768 - place)
    return found.select("column_name", F.date_add(F.lit("1970-01-01").cast("date"), number.cast("int")).alias("day"))


def date_coverage(name: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """First, last, different, expected and missing days of each date column, from its bitmap."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    ends = ends.select(F.inline(F.array(*[F.struct(F.lit(c).alias("date_column"), F.col(f"lo_{c}").alias("min_date"), F.col(f"hi_{c}").alias("max_date")) for c in columns])))
    counted = day_bitmaps(df, columns).groupBy(F.col("column_name").alias("date_column")).agg(F.sum(F.bitmap_count("days")).alias("distinct_dates"))
    both = ends.join(counted, "date_column", "left").withColumn("distinct_dates", F.coalesce("distinct_dates", F.lit(0)))
    both = both.withColumn("expected_days", (F.datediff("max_date", "min_date") + 1).cast("long"))
    return both.select(F.lit(name).alias("table_name"), "date_column", "min_date", "max_date", "distinct_dates", "expected_days", F.greatest(F.col("expected_days") - F.col("distinct_dates"), F.lit(0)).alias("missing_days"))


def missing_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and day of every day between a column's first and last that no row has: the complement of its bitmap."""
    found = days_of(day_bitmaps(df, columns))
    spans = found.groupBy("column_name").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    every = spans.select("column_name", F.explode(F.sequence("lo", "hi")).alias("day"))
    return every.join(found, ["column_name", "day"], "left_anti")


def orphans(child: str, df: DataFrame, key: str, parent: str, of: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key, compared as text, no parent has. Null keys are no orphans."""
    keys = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    lost = keys.join(of.select(F.col(parent_key).cast("string").alias("k")).distinct(), "k", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("orphan_rows")).select(F.lit(child).alias("child_table"), F.lit(key).alias("child_key"), F.lit(parent).alias("parent_table"), "orphan_rows", F.when(F.col("orphan_rows") == 0, "PASS").otherwise("FAIL").alias("status"))


def key_reconciliation(demand: DataFrame, inventory: DataFrame) -> DataFrame:
    """Keys that only one of the two facts has."""
    a = demand.select("date", "warehouse_id", "product_id").distinct().withColumn("d", F.lit(1))
    b = inventory.select(F.col("snapshot_date").alias("date"), "warehouse_id", "product_id").distinct().withColumn("i", F.lit(1))
    both = a.join(b, ["date", "warehouse_id", "product_id"], "full")
    return both.agg(count_rows(F.col("i").isNull()).alias("demand_only"), count_rows(F.col("d").isNull()).alias("inventory_only"), count_rows(F.col("d").isNotNull() & F.col("i").isNotNull()).alias("matched"))


def attribute_mismatch(df: DataFrame, key: str, column: str, master: DataFrame, master_column: str) -> DataFrame:
    """Rows whose attribute differs from the master's; a missing master is a mismatch."""
    joined = df.join(master.select(key, F.col(master_column).alias("_master")), key, "left")
    return joined.agg(F.count(F.lit(1)).alias("rows"), count_rows(~F.col(column).eqNullSafe(F.col("_master"))).alias("mismatched"))


def cube_completeness(name: str, df: DataFrame, day: str) -> DataFrame:
    """Rows against days times warehouses times products."""
    row = df.agg(F.count(F.lit(1)).alias("observed_rows")).crossJoin(distinct_counts(df, [day, "warehouse_id", "product_id"]))  # one row each
    return row.select(F.lit(name).alias("table_name"), "observed_rows", (F.col(day) * F.col("warehouse_id") * F.col("product_id")).alias("expected_rows")).withColumn("gap_rows", F.col("expected_rows") - F.col("observed_rows"))


def supplier_signal(suppliers: DataFrame, orders: DataFrame, least: int = 100) -> DataFrame:
    counted = suppliers.select("supplier_id").join(orders.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n")), "supplier_id", "left").na.fill(0, ["n"])
    return counted.agg(count_rows(F.col("n") == 0).alias("zero_po_suppliers"), count_rows(F.col("n") < least).alias("low_po_suppliers"))


def skew_flags(inventory: DataFrame) -> DataFrame:
    parts = [("days_of_supply", 8.0), ("inventory_value", 15.0)]
    row = quantiles(inventory, {c: [0.5, 0.99] for c, _ in parts})
    rows = [F.struct(F.lit(c).alias("column_name"), ratio(F.col(c)[1], F.col(c)[0], 0.0).alias("p99_p50_ratio"), F.lit(limit).alias("skew_limit")) for c, limit in parts]
    return row.select(F.inline(F.array(*rows))).withColumn("severity", F.when(F.col("p99_p50_ratio") > F.col("skew_limit"), "Medium").otherwise("Info"))


def quality_issues(summary: DataFrame, keys: DataFrame, checks: DataFrame) -> DataFrame:
    """Issues found by the profiles, in order of severity; one line if there is none."""
    none = summary.sparkSession.createDataFrame([("none", "Info", "all tables", 0)], "issue_category string, severity string, object_name string, issue_rows long")
    one = lambda df, category, severity, name, n: df.filter(n > 0).select(F.lit(category).alias("issue_category"), F.lit(severity).alias("severity"), name.cast("string").alias("object_name"), n.cast("long").alias("issue_rows"))
    found = union([
        one(summary, "duplicates", "High", F.col("table_name"), F.col("duplicate_key_rows")), one(summary, "impossible values", "High", F.col("table_name"), F.col("impossible_values")),
        one(keys, "referential integrity", "High", F.concat("child_table", F.lit("."), "child_key"), F.col("orphan_rows")), one(checks, "validation", "High", F.col("check_name"), F.col("issue_count")),
    ])
    rank = F.when(F.col("severity") == "High", 1).when(F.col("severity") == "Medium", 2).when(F.col("severity") == "Low", 3).otherwise(4)
    empty = found.agg((F.count(F.lit(1)) == 0).alias("is_empty"))
    return found.unionByName(none.crossJoin(empty).filter("is_empty").drop("is_empty")).withColumn("severity_rank", rank)  # one row each


def generation_health(demand: DataFrame, inventory: DataFrame, orders: DataFrame) -> DataFrame:
    """Rates that a data set should show: fill, stockout days, late orders, days over 35, and how many SKUs are chronic."""
    sums = demand.agg(fill_ratio(F.sum("units_fulfilled"), F.sum("units_demanded")).alias("fill_rate"), F.avg("stockout_flag").alias("stockout_day_rate"))
    late = orders.agg(F.avg("late_delivery_flag").alias("late_rate"))
    over = inventory.agg(F.avg(F.when(F.col("days_of_supply") > 35, 1.0).otherwise(0.0)).alias("excess_day_rate"))
    dos = inventory.groupBy("product_id").agg(F.avg("days_of_supply").alias("d")).agg(count_rows(F.col("d") > 35).alias("chronic_excess_skus"))
    out = demand.groupBy("product_id").agg(F.avg("stockout_flag").alias("s")).agg(count_rows(F.col("s") > 0.12).alias("chronic_stockout_skus"))
    return sums.crossJoin(late).crossJoin(over).crossJoin(dos).crossJoin(out)  # one row each


# -- validation -------------------------------------------------------------------------------------------------------


def _lines(row: DataFrame, names: list[str]) -> DataFrame:
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("issue_count")) for n in names])))


def checked(df: DataFrame, conditions: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """One row from one read of a table: how many rows meet each condition, and with ``keys`` also
    duplicated (rows that repeat a key that has come before) and repeated_keys.

    With keys, conditions are counted for each key in the same shuffle that finds the repeated ones.
    """
    counts = [count_rows(c).alias(n) for n, c in conditions.items()]
    if not keys:
        return df.agg(*counts)
    n = F.col("_n")
    by_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *counts)
    return by_key.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in conditions], F.coalesce(F.sum(n - 1), F.lit(0)).cast("long").alias("duplicated"), count_rows(n > 1).alias("repeated_keys"))


def demand_conditions() -> dict[str, Column]:
    fill = ratio("units_fulfilled", "units_demanded", None)
    lost, served, asked = F.col("units_lost_sales"), F.col("units_fulfilled"), F.col("units_demanded")
    return {
        "fill_rate_out_of_bounds": (fill < 0) | (fill > 1),
        "stockout_logic_inconsistencies": ((F.col("stockout_flag") == 1) & (lost == 0)) | ((F.col("stockout_flag") == 0) & (lost > 0)) | (served + lost != asked),
        "zero_demand_denominator_sanity": (asked == 0) & ((served > 0) | (lost > 0)),
        "negatives": (asked < 0) | (served < 0) | (lost < 0),
    }


def stock_conditions(tolerance: float = 0.05) -> dict[str, Column]:
    """Conditions over stock with the unit_cost of its product."""
    units = [F.col(c) < 0 for c in ("on_hand_units", "on_order_units", "reserved_units", "available_units", "inventory_value")]
    return {
        "inventory_value_consistency": F.abs(F.col("inventory_value") - F.col("on_hand_units").cast("double") * F.col("unit_cost")) > tolerance,
        "available_units_consistency": F.col("available_units") != F.col("on_hand_units") - F.col("reserved_units"),
        "negatives": reduce(lambda a, b: a | b, units),
    }


def order_conditions() -> dict[str, Column]:
    return {
        "po_date_inconsistencies": (F.col("expected_arrival_date") < F.col("order_date")) | (F.col("actual_arrival_date") < F.col("order_date")),
        "negatives": (F.col("ordered_units") < 0) | (F.col("received_units") < 0),
    }


def validation(demand: DataFrame, inventory: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Eleven checks of the raw tables as (check_name, issue_count, status). Each table is read once, its keys counted with its rows."""
    priced = inventory.join(products.select("product_id", "unit_cost"), "product_id", "left")
    d = checked(demand, demand_conditions(), ["date", "warehouse_id", "product_id"])
    i = checked(priced, stock_conditions(), ["snapshot_date", "warehouse_id", "product_id"])
    o = checked(orders, order_conditions(), ["po_id"])
    p = products.agg(nulls(["product_id", "category", "unit_cost", "unit_price"]).alias("critical_null_fields"))
    named = {"negatives": "impossible_negative_values"}
    lines = []
    for table, row in (("demand_history", d), ("inventory_snapshots", i), ("purchase_orders", o), ("products", p)):
        names = {c: named.get(c, f"duplicate_keys_{table}" if c == "repeated_keys" else c) for c in row.columns if c != "duplicated"}
        lines.append(_lines(row.select(*[F.col(c).alias(n) for c, n in names.items()]), list(names.values())))
    counted = union(lines).groupBy("check_name").agg(F.sum("issue_count").alias("issue_count"))
    return counted.withColumn("status", F.when(F.col("issue_count") == 0, "PASS").otherwise("FAIL"))


def value_mismatches(inventory: DataFrame, products: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Every row behind a failed value check, the largest differences first."""
    joined = inventory.join(products.select("product_id", "unit_cost"), "product_id").withColumn("expected_value", F.col("on_hand_units").cast("double") * F.col("unit_cost"))
    gap = F.abs(F.col("inventory_value") - F.col("expected_value"))
    return joined.filter(gap > tolerance).select("snapshot_date", "warehouse_id", "product_id", "inventory_value", "expected_value").orderBy(gap.desc(), "snapshot_date", "warehouse_id", "product_id")


def duplicate_rows(df: DataFrame, keys: list[str], n: int = 100) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return counted.orderBy(F.col("rows").desc(), *keys).limit(n)


# -- pre-delivery checks ----------------------------------------------------------------------------------------------


def checks_from(row: DataFrame, layer: str, specs: list[tuple[str, str, str, Column, str]]) -> DataFrame:
    """A check line for each (name, severity, observed column, condition to pass, status otherwise) of a one-row frame."""
    lines = [F.struct(F.lit(n).alias("check_name"), F.lit(layer).alias("layer"), F.lit(s).alias("severity"), F.when(ok, "PASS").otherwise(bad).alias("status"), F.col(o).cast("double").alias("observed")) for n, s, o, ok, bad in specs]
    return row.select(F.inline(F.array(*lines)))


def zero(name: str, severity: str, column: str) -> tuple[str, str, str, Column, str]:
    return (name, severity, column, F.col(column) == 0, "FAIL")


def demand_checks(demand: DataFrame) -> DataFrame:
    lost, served, asked = F.col("units_lost_sales"), F.col("units_fulfilled"), F.col("units_demanded")
    shared = demand_conditions()
    conditions = {"bounds": shared["fill_rate_out_of_bounds"], "balance": served + lost != asked, "flag": (F.col("stockout_flag") == 1) != (lost > 0), "zero": shared["zero_demand_denominator_sanity"]}
    keys = ["date", "warehouse_id", "product_id"]
    row = checked(demand, conditions | {"n": F.lit(True)}, keys).crossJoin(distinct_counts(demand, keys))  # one row each
    row = row.withColumn("gap", F.abs(F.col("date") * F.col("warehouse_id") * F.col("product_id") - F.col("n")))
    return checks_from(row, "raw", [
        zero("rowcount_dense_demand_history", "HIGH", "gap"), zero("duplicates_demand_history", "HIGH", "duplicated"), zero("fill_rate_logic_bounds_raw", "CRITICAL", "bounds"), zero("demand_balance_units", "CRITICAL", "balance"), zero("stockout_flag_logic", "CRITICAL", "flag"), zero("denominator_zero_demand_with_activity_raw", "CRITICAL", "zero"),
    ])


def raw_checks(inventory: DataFrame, orders: DataFrame, products: DataFrame, suppliers: DataFrame, demand: DataFrame) -> DataFrame:
    priced = inventory.join(products.select("product_id", "unit_cost"), "product_id", "left")
    cells = lambda columns: {f"below_{c}": F.col(c) < 0 for c in columns}
    stock_cells, order_cells = cells(["on_hand_units", "on_order_units", "reserved_units", "available_units", "inventory_value"]), cells(["ordered_units", "received_units"])
    below = lambda conditions: reduce(lambda a, b: a + b, map(F.col, conditions))
    value = stock_conditions(0.11)["inventory_value_consistency"] | F.col("unit_cost").isNull()
    stock = checked(priced, {"value": value, "available": stock_conditions()["available_units_consistency"], **stock_cells}, ["snapshot_date", "warehouse_id", "product_id"])
    stock = stock.select("value", "available", F.col("duplicated").alias("inventory_twice"), below(stock_cells).alias("stock_below"))
    ordered = checked(orders, order_cells, ["po_id"]).select(F.col("duplicated").alias("orders_twice"), below(order_cells).alias("orders_below"))
    row = stock.crossJoin(ordered).crossJoin(demand.agg(negatives(["units_demanded", "units_fulfilled", "units_lost_sales"]).alias("demand_below")))
    row = row.crossJoin(products.agg(nulls(["product_id", "category", "unit_cost", "unit_price", "supplier_id"]).alias("product_nulls")))
    row = row.crossJoin(suppliers.agg(nulls(["supplier_id", "supplier_name", "supplier_region"]).alias("supplier_nulls")))  # one row each
    row = row.withColumn("cells", F.col("stock_below") + F.col("orders_below") + F.col("demand_below"))
    return checks_from(row, "raw", [
        zero("duplicates_inventory_snapshots", "HIGH", "inventory_twice"), zero("duplicates_purchase_orders", "HIGH", "orders_twice"), zero("products_critical_nulls", "HIGH", "product_nulls"), zero("suppliers_critical_nulls", "HIGH", "supplier_nulls"), zero("impossible_negative_values", "CRITICAL", "cells"),
        zero("inventory_value_consistency_raw", "CRITICAL", "value"), zero("available_units_consistency_raw", "CRITICAL", "available"),
    ])


def daily_checks(daily: DataFrame, demand: DataFrame, products: DataFrame, risk: DataFrame, fact: DataFrame) -> DataFrame:
    lost, served, asked = F.col("units_lost_sales"), F.col("units_fulfilled"), F.col("units_demanded")
    keys = ["date", "warehouse_id", "product_id"]
    d = daily.join(products.select("product_id", "unit_price"), "product_id", "left").agg(
        F.count(F.lit(1)).alias("daily_rows"), count_rows((F.col("fill_rate") < 0) | (F.col("fill_rate") > 1)).alias("bounds"), count_rows((F.col("stockout_flag") == 1) != (lost > 0)).alias("flag"), count_rows((asked == 0) & ((served > 0) | (lost > 0))).alias("zero"),
        nulls(["date", "warehouse_id", "product_id", "units_demanded", "fill_rate", "inventory_value"]).alias("daily_nulls"), count_rows(F.col("unit_price").isNull() | (F.abs(F.col("lost_sales_revenue") - lost.cast("double") * F.col("unit_price")) > 0.11)).alias("revenue"),
        (F.countDistinct("product_id") * F.countDistinct("warehouse_id")).alias("pairs"),
    )
    scores = [c for c in risk.columns if c.endswith("_score")]
    s = risk.agg(F.count(F.lit(1)).alias("risk_rows"), count_rows(reduce(lambda a, b: a | b, [(F.col(c) < 0) | (F.col(c) > 100) for c in scores])).alias("scores"), nulls(["product_id", "warehouse_id", "supplier_id", "governance_priority_score", "risk_tier", "main_risk_driver", "recommended_action"]).alias("risk_nulls"))
    f = fact.agg(F.count(F.lit(1)).alias("fact_rows"), (F.countDistinct("month") * F.countDistinct("product_id") * F.countDistinct("warehouse_id")).alias("fact_grain"))
    row = d.crossJoin(s).crossJoin(f).crossJoin(duplicate_keys(daily, keys)).crossJoin(demand.agg(F.count(F.lit(1)).alias("demand_rows")))  # one row each
    row = row.withColumns({"grain_gap": F.abs(F.col("fact_grain") - F.col("fact_rows")), "row_gap": F.abs(F.col("daily_rows") - F.col("demand_rows")), "risk_gap": F.abs(F.col("pairs") - F.col("risk_rows"))})
    return checks_from(row, "processed", [
        zero("daily_duplicate_keys", "HIGH", "keys"), zero("daily_fill_rate_bounds", "HIGH", "bounds"), zero("daily_stockout_logic", "HIGH", "flag"), zero("sku_score_bounds", "HIGH", "scores"), zero("dashboard_expected_grain", "HIGH", "grain_gap"), zero("rowcount_daily_equals_demand_history", "HIGH", "row_gap"),
        zero("rowcount_sku_risk_expected_grain", "HIGH", "risk_gap"), zero("duplicates_daily_product_warehouse_metrics", "HIGH", "duplicated"), zero("daily_critical_nulls", "HIGH", "daily_nulls"), zero("sku_risk_critical_nulls", "HIGH", "risk_nulls"), zero("lost_sales_revenue_consistency_daily", "HIGH", "revenue"),
        zero("denominator_zero_demand_with_activity_daily", "CRITICAL", "zero"),
    ])
