"""KPI library: service, inventory, supplier, trade-off and action lists. Callers order the rows they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.expressions import c, dos_bucket, dos_cap, fill_ratio, floored_share, loss_ratio, money_mean, money_sum, month_of, rate, share, slow_moving, weighted
from shelfspark.plans.ranking import ranked
from shelfspark.plans.selection import exact_quantiles
from shelfspark.sources.scratch import stored

UNITS = ("units_demanded", "units_fulfilled", "units_lost_sales")


def _units(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names or UNITS]


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"fill_rate": fill_ratio("units_fulfilled", "units_demanded"), "stockout_rate": loss_ratio("units_lost_sales", "units_demanded")})


def first(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows in an order that the last columns make total."""
    return df.orderBy(*order).limit(n)


def by_amount(name: str) -> Column:
    """Descending order of an amount, to the cent, so that sums in another order rank alike."""
    return F.round(c(name), 2).desc_nulls_last()


# -- stand-alone KPIs over raw tables ---------------------------------------------------------------------------------


def overall_fill_rate(demand: DataFrame) -> DataFrame:
    return demand.agg(*_units("units_demanded", "units_fulfilled")).withColumn("overall_fill_rate", fill_ratio("units_fulfilled", "units_demanded"))


def unit_stockout_rate(demand: DataFrame) -> DataFrame:
    return demand.agg(*_units("units_lost_sales", "units_demanded")).withColumn("stockout_rate", loss_ratio("units_lost_sales", "units_demanded"))


def lost_sales_by_category(demand: DataFrame, products: DataFrame) -> DataFrame:
    """Units are summed by product before the join, so the fact is shuffled once, as few rows."""
    lost = demand.groupBy("product_id").agg(F.sum("units_lost_sales").alias("units"))
    joined = lost.join(products.select("product_id", "category", "unit_price"), "product_id")
    return joined.groupBy("category").agg(F.sum("units").alias("lost_units"), money_sum(F.col("units").cast("double") * F.col("unit_price")).alias("lost_revenue"))


def inventory_by_category(inventory: DataFrame, products: DataFrame) -> DataFrame:
    joined = inventory.join(products.select("product_id", "category"), "product_id")
    return joined.groupBy("category").agg(money_mean("inventory_value").alias("avg_inventory_value"), F.max("inventory_value").alias("peak_inventory_value"))


def days_of_supply_spread(inventory: DataFrame) -> DataFrame:
    days = F.col("days_of_supply")
    points = exact_quantiles(inventory, {"days_of_supply": [0.25, 0.5, 0.75, 0.9]})[()]["days_of_supply"]
    row = inventory.agg(F.min(days).alias("dos_min"), F.max(days).alias("dos_max"), F.avg(days).alias("dos_avg"))
    return row.select("dos_min", *[F.lit(p).cast("double").alias(n) for p, n in zip(points, ("dos_p25", "dos_p50", "dos_p75", "dos_p90"), strict=True)], "dos_max", "dos_avg")


def supplier_on_time(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    full = fill_ratio("received_units", "ordered_units")
    record = orders.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("po_count"), rate(F.col("late_delivery_flag") == 0).alias("on_time_delivery_rate"), F.avg(full).alias("in_full_rate"))
    return record.join(suppliers.select("supplier_id", "supplier_name"), "supplier_id").select("supplier_id", "supplier_name", "po_count", "on_time_delivery_rate", "in_full_rate")


def warehouse_comparison(daily: DataFrame, profile: DataFrame) -> DataFrame:
    totals = daily.groupBy("warehouse_id").agg(*[F.sum(u).alias(f"total_{u}") for u in UNITS])
    named = {"warehouse_fill_rate": "fill_rate", "warehouse_lost_sales_rate": "stockout_rate", "avg_inventory_value": "inventory_value", "avg_days_of_supply": "average_days_of_supply"}
    joined = totals.join(profile, "warehouse_id")
    return joined.select("warehouse_id", "region", *[f"total_{u}" for u in UNITS], *[F.col(v).alias(k) for k, v in named.items()])


def _both_risks(service: DataFrame, inventory: DataFrame) -> DataFrame:
    return service.join(inventory.drop("category"), ["product_id", "warehouse_id"])


def quadrant_summary(service: DataFrame, inventory: DataFrame) -> DataFrame:
    low, heavy = F.col("fill_rate") < 0.95, F.col("excess_inventory_day_rate") >= 0.20
    zone = F.when(low & heavy, "Dual Failure: Low Service + Excess Inventory").when(low, "Service Risk").when(heavy, "Working Capital Risk").otherwise("Balanced")
    return _both_risks(service, inventory).groupBy(zone.alias("tradeoff_zone")).agg(
        F.count(F.lit(1)).alias("sku_warehouse_count"), F.avg("fill_rate").alias("avg_fill_rate"), F.avg("stockout_day_rate").alias("avg_stockout_day_rate"), F.avg("excess_inventory_day_rate").alias("avg_excess_day_rate"),
        money_sum("lost_sales_revenue").alias("total_lost_revenue"), money_sum("avg_inventory_value").alias("total_avg_inventory_value"),
    )


def top_risk_skus(service: DataFrame, inventory: DataFrame, n: int = 25) -> DataFrame:
    dos = F.least(F.col("avg_days_of_supply") / 60.0, F.lit(1.0))
    score = weighted((0.40, F.col("stockout_day_rate")), (0.30, F.col("excess_inventory_day_rate")), (0.15, F.col("slow_moving_day_rate")), (0.10, 1.0 - F.col("fill_rate")), (0.05, dos)) * F.lit(100.0)
    scored = _both_risks(service, inventory).withColumn("risk_score", score)
    top = first(scored, n, F.round("risk_score", 6).desc(), by_amount("lost_sales_revenue"), F.col("product_id"), F.col("warehouse_id"))
    # the rank is given among the rows that are left
    order = Window.orderBy(F.round("risk_score", 6).desc(), by_amount("lost_sales_revenue"), "product_id", "warehouse_id")
    keep = ["product_id", "warehouse_id", "category", "abc_class", "fill_rate", "stockout_day_rate", "excess_inventory_day_rate", "slow_moving_day_rate", "avg_days_of_supply", "lost_sales_revenue", "avg_inventory_value", "risk_score"]
    return top.select(*keep, F.row_number().over(order).alias("risk_rank"))


def value_curve(values: DataFrame, *keys: str) -> DataFrame:
    """Entities in order of value with rank, percentile, running value and its share of the total.

    Values are ranked and summed over many tasks (``ranked``).
    """
    order = [F.round("avg_inventory_value", 6).desc(), *[F.col(k) for k in keys]]
    placed = ranked(stored(values).withColumn("value", F.col("avg_inventory_value").cast("decimal(18,6)")), order, "value_rank", ["value"])
    running, total = F.col("running_value").cast("double"), F.col("all_value").cast("double")
    return placed.select(
        *values.columns, "value_rank", (F.col("value_rank") / F.col("n_all")).alias("rank_percentile"), running.alias("cumulative_inventory_value"), total.alias("total_inventory_value"), share(running, total).alias("cumulative_value_share"),
    )


def capital_concentration(inventory: DataFrame, products: DataFrame, classification: DataFrame, top: float = 0.20) -> DataFrame:
    """The products with the most stock value that make up ``top`` of all products."""
    means = inventory.groupBy("product_id").agg(money_mean("inventory_value").alias("avg_inventory_value"))
    named = means.join(products.select("product_id", "category"), "product_id").join(classification.select("product_id", "abc_class"), "product_id", "left")
    return value_curve(named, "product_id").filter(F.col("rank_percentile") <= top).withColumnRenamed("total_inventory_value", "total_portfolio_value").drop("value_rank")


# -- diagnostics over the daily fact ----------------------------------------------------------------------------------


def service_health(daily: DataFrame) -> DataFrame:
    row = daily.agg(*[F.sum(u).alias(f"total_{u}") for u in UNITS], money_sum("lost_sales_revenue").alias("total_lost_sales_revenue"), money_sum("service_gap_units").alias("total_service_gap_units"))
    return row.withColumns({"overall_fill_rate": fill_ratio("total_units_fulfilled", "total_units_demanded"), "overall_stockout_rate": loss_ratio("total_units_lost_sales", "total_units_demanded")})


def monthly_service(daily: DataFrame) -> DataFrame:
    grouped = daily.groupBy(month_of().alias("month")).agg(*_units(), money_sum("lost_sales_revenue").alias("lost_sales_revenue"), F.avg("days_of_supply").alias("avg_days_of_supply"), rate(F.col("promo_flag") == 1).alias("promo_mix_rate"))
    return _rates(grouped)


def service_by(daily: DataFrame, key: str, stock: bool = False) -> DataFrame:
    """Service of a dimension, as a ratio of sums and as a mean of daily ratios; ``stock`` adds stock means."""
    more = [F.avg("days_of_supply").alias("avg_days_of_supply"), money_mean("inventory_value").alias("avg_inventory_value")] if stock else []
    grouped = daily.groupBy(key).agg(*_units(), money_sum("lost_sales_revenue").alias("lost_sales_revenue"), F.avg("fill_rate").alias("avg_row_fill_rate"), F.avg("stockout_flag").alias("stockout_day_rate"), *more)
    return _rates(grouped)


def warehouse_columns(profile: DataFrame) -> DataFrame:
    return profile.select("warehouse_id", "warehouse_name", "region", "warehouse_service_risk_proxy", "fill_rate", "stockout_rate", "lost_sales_value", "average_days_of_supply", "inventory_value", "capacity_pressure_proxy")


def inventory_efficiency(daily: DataFrame) -> DataFrame:
    days, value = F.col("days_of_supply"), F.col("inventory_value")
    points = exact_quantiles(daily, {"days_of_supply": [0.5, 0.9, 0.99], "inventory_value": [0.95]})[()]
    row = daily.agg(
        F.avg(days).alias("avg_days_of_supply"), money_mean(value).alias("avg_inventory_value"), rate(days > dos_cap()).alias("excess_inventory_day_rate"), rate(slow_moving()).alias("slow_moving_day_rate"),
    )
    known = lambda p, n: F.lit(p).cast("double").alias(n)
    spread = [known(p, f"{n}_days_of_supply") for p, n in zip(points["days_of_supply"], ("median", "p90", "p99"), strict=True)]
    return row.select("avg_days_of_supply", *spread, "avg_inventory_value", known(points["inventory_value"][0], "p95_inventory_value"), "excess_inventory_day_rate", "slow_moving_day_rate")


def days_of_supply_histogram(daily: DataFrame) -> DataFrame:
    counted = daily.groupBy(dos_bucket().alias("dos_bucket")).agg(F.count(F.lit(1)).alias("row_count"), F.avg("days_of_supply").alias("avg_dos_in_bucket"))
    all_rows = counted.agg(F.sum("row_count").alias("n"))
    return counted.crossJoin(F.broadcast(all_rows)).select("dos_bucket", "row_count", share("row_count", "n").alias("row_share"), "avg_dos_in_bucket")  # six rows


def value_concentration(daily: DataFrame) -> DataFrame:
    return value_curve(daily.groupBy("product_id", "category").agg(money_mean("inventory_value").alias("avg_inventory_value")), "product_id", "category")


def excess_exposure(daily: DataFrame) -> DataFrame:
    over = F.col("days_of_supply") > dos_cap()
    return daily.groupBy("category").agg(
        rate(over).alias("excess_inventory_day_rate"), rate(slow_moving()).alias("slow_moving_day_rate"), money_mean("inventory_value").alias("avg_inventory_value"), money_sum(F.when(over, F.col("inventory_value")).otherwise(0.0)).alias("excess_inventory_value_proxy")
    )


def stockout_levels(daily: DataFrame) -> DataFrame:
    """Losses by warehouse, by region and by category, in one pass."""
    levels = {"warehouse": "warehouse_id", "region": "region", "category": "category"}
    grouped = daily.groupingSets([[F.col(k)] for k in levels.values()], *levels.values()).agg(F.grouping_id(*levels.values()).alias("g"), *_units("units_demanded", "units_lost_sales"), money_sum("lost_sales_revenue").alias("lost_sales_revenue"))
    place = {"warehouse": 3, "region": 5, "category": 6}
    level = F.coalesce(*[F.when(F.col("g") == g, F.lit(n)) for n, g in place.items()])
    segment = F.coalesce(*[F.when(F.col("g") == place[n], F.col(k)) for n, k in levels.items()])
    return grouped.select(level.alias("level"), segment.alias("segment"), "units_demanded", "units_lost_sales", loss_ratio("units_lost_sales", "units_demanded").alias("stockout_rate"), "lost_sales_revenue")


def stockout_patterns(daily: DataFrame) -> DataFrame:
    """SKU-locations by how often and how strongly they run out: months first, then the pair."""
    pair = ["product_id", "warehouse_id"]
    months = daily.groupBy(*pair, month_of().alias("month")).agg(F.sum("units_demanded").alias("d"), F.sum("units_lost_sales").alias("l"))
    pairs = months.groupBy(*pair).agg(loss_ratio(F.sum("l"), F.sum("d")).alias("r"), rate(F.col("l") > 0).alias("m"))
    strong, often = F.col("r") >= 0.08, F.col("m")
    pattern = F.when(strong & (often >= 0.50), "Systematic").when(strong, "Episodic High-Intensity").when(often >= 0.35, "Frequent Low-Intensity").otherwise("Low/Contained")
    return pairs.groupBy(pattern.alias("stockout_pattern")).agg(F.count(F.lit(1)).alias("sku_warehouse_count"), F.avg("r").alias("avg_stockout_rate"), F.avg("m").alias("avg_active_month_ratio"))


def top_lost_sales(daily: DataFrame, n: int = 50) -> DataFrame:
    keys = ["product_id", "warehouse_id", "region", "category"]
    sums = daily.groupBy(*keys).agg(*_units("units_demanded", "units_lost_sales"), money_sum("lost_sales_revenue").alias("lost_sales_revenue"))
    return first(sums.withColumn("stockout_rate", loss_ratio("units_lost_sales", "units_demanded")), n, by_amount("lost_sales_revenue"), F.col("product_id"), F.col("warehouse_id"))


def supplier_downstream(performance: DataFrame, daily: DataFrame) -> DataFrame:
    """Every supplier with the demand behind it; without demand its rates are null."""
    sums = daily.groupBy("supplier_id").agg(*_units(), money_sum("lost_sales_revenue").alias("downstream_lost_sales_revenue"))
    joined = performance.join(sums, "supplier_id", "left")
    return joined.withColumns({"downstream_stockout_rate": loss_ratio("units_lost_sales", "units_demanded"), "downstream_fill_rate": fill_ratio("units_fulfilled", "units_demanded")}).drop("units_fulfilled")


def _pairs(daily: DataFrame, *more: str) -> DataFrame:
    sums = daily.groupBy("product_id", "warehouse_id", "category", "abc_class", *more).agg(
        *_units(), F.avg("days_of_supply").alias("avg_days_of_supply"), money_mean("inventory_value").alias("avg_inventory_value"), money_sum("lost_sales_revenue").alias("lost_sales_revenue")
    )
    return _rates(sums.withColumn("dos_cap", dos_cap()))


def _zones() -> dict[str, Column]:
    dos, cap, fill = F.col("avg_days_of_supply"), F.col("dos_cap"), F.col("fill_rate")
    return {"Overstocked and Under-Serving": (dos > cap) & (fill < 0.95), "Understocked Revenue Exposure": (dos <= 8) & (F.col("stockout_rate") >= 0.08), "Balanced Efficient": (fill >= 0.97) & dos.between(8, cap), "Service Protected but Capital Heavy": (dos > cap) & (fill >= 0.97)}


def tradeoff_zones(daily: DataFrame) -> DataFrame:
    """SKU-locations by zone; the first zone that fits counts."""
    zone = F.coalesce(*[F.when(test, F.lit(name)) for name, test in _zones().items()], F.lit("Transitional / Monitor"))
    return _pairs(daily).groupBy(zone.alias("tradeoff_zone")).agg(
        F.count(F.lit(1)).alias("sku_warehouse_count"), *[F.avg(x).alias(f"avg_{x}") for x in ("fill_rate", "stockout_rate")], F.avg("avg_days_of_supply").alias("avg_days_of_supply"),
        money_sum("lost_sales_revenue").alias("total_lost_sales_revenue"), money_sum("avg_inventory_value").alias("total_avg_inventory_value"),
    )


def unbalanced(daily: DataFrame, n: int = 80) -> DataFrame:
    tests = {k: v for k, v in _zones().items() if k != "Balanced Efficient"}
    kind = F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests.items()])
    found = _pairs(daily, "supplier_id").withColumn("imbalance_type", kind).filter("imbalance_type is not null").drop("units_demanded", "units_fulfilled", "units_lost_sales")
    return first(found, n, by_amount("lost_sales_revenue"), by_amount("avg_inventory_value"), F.col("product_id"), F.col("warehouse_id"))


def action_skus(risk: DataFrame, daily: DataFrame, n: int = 40) -> DataFrame:
    measures = daily.groupBy("product_id", "warehouse_id").agg(money_sum("lost_sales_revenue").alias("lost_sales_revenue"), money_mean("inventory_value").alias("avg_inventory_value"), F.avg("days_of_supply").alias("avg_days_of_supply"), F.avg("fill_rate").alias("avg_fill_rate"))
    keep = risk.select("product_id", "warehouse_id", "supplier_id", "governance_priority_score", "risk_tier", "main_risk_driver", "recommended_action")
    return first(keep.join(measures, ["product_id", "warehouse_id"], "left"), n, F.round("governance_priority_score", 6).desc(), by_amount("lost_sales_revenue"), F.col("product_id"), F.col("warehouse_id"))


def action_suppliers(performance: DataFrame, daily: DataFrame) -> DataFrame:
    return supplier_downstream(performance, daily).drop("units_demanded", "units_lost_sales", "downstream_fill_rate")


def action_segments(risk: DataFrame, daily: DataFrame, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    measures = daily.groupBy("product_id", "warehouse_id").agg(money_sum("lost_sales_revenue").alias("lost"), money_mean("inventory_value").alias("value"))
    scored = risk.select("product_id", "warehouse_id", "governance_priority_score", "risk_tier", "main_risk_driver")
    joined = scored.join(products.select("product_id", "category"), "product_id").join(F.broadcast(warehouses.select("warehouse_id", "region")), "warehouse_id").join(measures, ["product_id", "warehouse_id"], "left")
    shares = {"service_risk": "Service Risk", "excess_inventory": "Excess Inventory", "supplier_risk": "Supplier Risk"}
    return joined.groupBy("category", "region").agg(
        F.count(F.lit(1)).alias("sku_warehouse_count"), F.avg("governance_priority_score").alias("avg_governance_priority_score"), F.count_if(F.col("risk_tier").isin("High", "Critical")).alias("high_or_critical_count"),
        money_sum("lost").alias("total_lost_sales_revenue"), money_sum("value").alias("total_avg_inventory_value"), *[rate(F.col("main_risk_driver") == v).alias(f"{k}_driver_share") for k, v in shares.items()],
    )


def headline(regions: DataFrame, warehouses: DataFrame, categories: DataFrame, curve: DataFrame, patterns: DataFrame, zones: DataFrame, suppliers: DataFrame, skus: DataFrame, excess: DataFrame, segments: DataFrame) -> DataFrame:
    """One row of the facts that a summary opens with, out of the other results."""
    best = lambda name, by, order=F.max: order(F.struct(F.round(by, 6).alias("v"), F.col(name).alias("n")))["n"]
    count = lambda df, key, value, out: df.agg(F.coalesce(F.max(F.when(F.col(key) == value, F.col("sku_warehouse_count"))), F.lit(0)).alias(out))
    rows = [
        regions.agg(best("region", F.col("fill_rate")).alias("best_region"), best("region", F.col("fill_rate"), F.min).alias("worst_region")),
        warehouses.agg(best("warehouse_id", F.col("warehouse_service_risk_proxy")).alias("worst_warehouse")),
        categories.agg(best("category", F.col("lost_sales_revenue")).alias("worst_category")),
        curve.agg(floored_share(money_sum(F.when(F.col("rank_percentile") <= 0.20, F.col("avg_inventory_value")).otherwise(0.0)), money_sum("avg_inventory_value")).alias("top_20_value_share")),
        count(patterns, "stockout_pattern", "Systematic", "systematic_count"), count(zones, "tradeoff_zone", "Overstocked and Under-Serving", "dual_failure_count"), count(zones, "tradeoff_zone", "Balanced Efficient", "balanced_count"),
        zones.agg(F.coalesce(F.max(F.when(F.col("tradeoff_zone") == "Overstocked and Under-Serving", F.col("total_lost_sales_revenue"))), F.lit(0.0)).alias("dual_failure_lost_sales")),
        suppliers.agg(best("supplier_id", F.col("supplier_service_risk_proxy")).alias("top_supplier")), skus.agg(best("product_id", F.col("governance_priority_score")).alias("top_sku")),
        excess.agg(best("category", F.col("excess_inventory_value_proxy")).alias("inventory_heavy_category")), segments.agg(best("category", F.col("avg_governance_priority_score")).alias("top_segment_category")),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.crossJoin(row)  # one row each
    return out
