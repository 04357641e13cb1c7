"""Intermediate views at the grains that later operators build on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expressions import criticality_weight, dbl, dos_cap, fill_ratio, flag, loss_ratio, money_mean, money_sum, money_total, rate, slow_moving, weighted
from shelfspark.schemas import DAILY_COLUMNS


def daily_metrics(demand: DataFrame, inventory: DataFrame, products: DataFrame, warehouses: DataFrame, classification: DataFrame, on: Sequence[str] = ("date", "warehouse_id", "product_id"), parts: int | None = None) -> DataFrame:
    """One row for each day, warehouse and product with demand and stock: service, stock and lost revenue.

    The two facts meet on three keys; where ``on`` names others that say the same (integers, by which both facts are
    bucketed), they meet on these without an exchange. Dimensions are left to the optimizer, which broadcasts them
    while they are small; with ``parts`` the facts are dealt by product to so many partitions before. A product without a
    class stays, unclassified.
    """
    stock = inventory.withColumnRenamed("snapshot_date", "date").select(*on, "on_hand_units", "on_order_units", "available_units", "days_of_supply", "inventory_value")
    facts = demand.drop("region").join(stock, list(on)).drop(*set(on) - set(DAILY_COLUMNS))
    facts = facts.repartition(parts, "product_id") if parts else facts
    named = facts.join(products.select("product_id", "category", "supplier_id", "unit_price", "target_service_level"), "product_id").join(warehouses.select("warehouse_id", "region"), "warehouse_id")
    full = named.join(classification, "product_id", "left")
    gap = F.col("target_service_level") * dbl("units_demanded") - dbl("units_fulfilled")
    return full.withColumns({
        "fill_rate": fill_ratio("units_fulfilled", "units_demanded"),
        "lost_sales_revenue": dbl("units_lost_sales") * F.col("unit_price"),
        "service_gap_units": F.greatest(gap, F.lit(0.0)),
    }).select(*DAILY_COLUMNS)


def supplier_performance(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Delivery record of every supplier; one without orders counts as punctual and complete."""
    delay = F.datediff("actual_arrival_date", "expected_arrival_date").cast("double")
    lead = F.datediff("actual_arrival_date", "order_date").cast("double")
    record = orders.groupBy("supplier_id").agg(
        rate(F.col("late_delivery_flag") == 0).alias("otd"), F.avg(F.greatest(delay, F.lit(0.0))).alias("delay"), F.coalesce(F.stddev_samp(lead), F.lit(0.0)).alias("spread"),
        fill_ratio(F.sum("received_units"), F.sum("ordered_units")).alias("received"),
    )
    one = F.lit(1.0)
    proxy = F.lit(100.0) * weighted((0.40, one - F.col("otd")), (0.20, F.least(F.col("delay") / 10.0, one)), (0.20, F.least(F.col("spread") / 8.0, one)), (0.20, one - F.col("received")))
    joined = suppliers.select("supplier_id", "supplier_name").join(record.withColumn("proxy", proxy), "supplier_id", "left")
    names = {"on_time_delivery_rate": ("otd", 1.0), "average_delay_days": ("delay", 0.0), "lead_time_variability": ("spread", 0.0), "received_vs_ordered_fill_rate": ("received", 1.0), "supplier_service_risk_proxy": ("proxy", 0.0)}
    return joined.select("supplier_id", "supplier_name", *[F.coalesce(F.col(x), F.lit(d)).alias(n) for n, (x, d) in names.items()])


def product_profile(daily: DataFrame, products: DataFrame) -> DataFrame:
    """Stock behaviour of each product over all warehouses."""
    grouped = daily.join(products.select("product_id", "product_name"), "product_id").groupBy("product_id").agg(
        F.max("product_name").alias("product_name"), F.max("category").alias("category"), F.max("abc_class").alias("abc_class"),
        F.avg("on_hand_units").alias("average_inventory_units"), money_mean("inventory_value").alias("average_inventory_value"), F.avg("days_of_supply").alias("average_days_of_supply"),
        rate(F.col("stockout_flag") == 1).alias("stockout_frequency"), F.avg("fill_rate").alias("fill_rate_average"), money_sum("lost_sales_revenue").alias("lost_sales_exposure"),
        rate(slow_moving()).alias("slow_moving_inventory_proxy"), rate(F.col("days_of_supply") > dos_cap()).alias("excess_inventory_proxy"),
    )
    one = F.lit(1.0)
    risk = weighted((0.45, F.col("excess_inventory_proxy")), (0.30, F.col("slow_moving_inventory_proxy")), (0.15, F.least(F.col("average_days_of_supply") / 60.0, one)), (0.10, F.least(F.col("average_inventory_value") / 50000.0, one)))
    return grouped.withColumn("working_capital_risk_proxy", F.lit(100.0) * risk)


def warehouse_profile(daily: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Service and load of each warehouse: days first, then the mean or sum of days."""
    days = daily.groupBy("warehouse_id", "region", "date").agg(
        F.sum("units_demanded").alias("d"), F.sum("units_fulfilled").alias("f"), F.sum("units_lost_sales").alias("l"), money_sum("lost_sales_revenue").alias("lost"), F.avg("days_of_supply").alias("dos"),
        money_sum("inventory_value").alias("value"), F.sum(F.col("on_hand_units") + F.col("on_order_units")).alias("pipeline"),
    )
    sized = days.join(F.broadcast(warehouses.select("warehouse_id", "warehouse_name", "storage_capacity_units")), "warehouse_id")
    total = sized.groupBy("warehouse_id").agg(
        F.max("warehouse_name").alias("warehouse_name"), F.max("region").alias("region"), fill_ratio(F.sum("f"), F.sum("d")).alias("fill_rate"), loss_ratio(F.sum("l"), F.sum("d")).alias("stockout_rate"),
        money_total("lost").alias("lost_sales_value"), F.avg("dos").alias("average_days_of_supply"), (money_total("value") / F.nullif(F.count("value"), F.lit(0)).cast("double")).alias("inventory_value"),
        F.avg(dbl("pipeline") / F.nullif(dbl("storage_capacity_units"), F.lit(0.0))).alias("capacity_pressure_proxy"),
    )
    one = F.lit(1.0)
    risk = weighted((0.40, F.col("stockout_rate")), (0.30, one - F.col("fill_rate")), (0.20, F.least(F.col("capacity_pressure_proxy"), one)), (0.10, F.least(F.col("average_days_of_supply") / 50.0, one)))
    return total.withColumn("warehouse_service_risk_proxy", F.lit(100.0) * risk)


def inventory_risk(daily: DataFrame) -> DataFrame:
    """Overstock signals of each product in each warehouse. An unclassified product is never in excess."""
    over = (F.col("days_of_supply") > dos_cap()) & F.col("abc_class").isNotNull()
    grouped = daily.groupBy("product_id", "warehouse_id", "category", "abc_class").agg(
        F.avg("days_of_supply").alias("avg_days_of_supply"), money_mean("inventory_value").alias("avg_inventory_value"), rate(over).alias("excess_inventory_day_rate"), rate(slow_moving()).alias("slow_moving_day_rate")
    )
    one = F.lit(1.0)
    grouped = grouped.withColumn("dos_stretch_ratio", F.col("avg_days_of_supply") / dos_cap())
    risk = weighted((0.45, F.least(F.col("dos_stretch_ratio") / 2.25, one)), (0.35, F.least(F.col("excess_inventory_day_rate") / 0.40, one)), (0.20, F.least(F.col("slow_moving_day_rate") / 0.12, one)))
    return grouped.withColumn("inventory_risk_score_base", F.lit(100.0) * risk)


def service_risk(daily: DataFrame) -> DataFrame:
    """Service failure signals of each product in each warehouse."""
    keys = ["product_id", "warehouse_id", "category", "supplier_id", "criticality_level"]
    sums = daily.groupBy(*keys).agg(
        F.sum("units_demanded").alias("units_demanded"), F.sum("units_fulfilled").alias("units_fulfilled"), F.sum("units_lost_sales").alias("units_lost_sales"), money_sum("service_gap_units").alias("gap"),
        money_sum("lost_sales_revenue").alias("lost_sales_revenue"), F.avg("stockout_flag").alias("stockout_day_rate"),
    )
    rated = sums.withColumns({"fill_rate": fill_ratio("units_fulfilled", "units_demanded"), "stockout_rate": loss_ratio("units_lost_sales", "units_demanded"), "service_gap_rate": loss_ratio("gap", "units_demanded")})
    one = F.lit(1.0)
    risk = weighted(
        (0.35, F.least((one - F.col("fill_rate")) / 0.15, one)), (0.30, F.least(F.col("service_gap_rate") / 0.20, one)), (0.20, F.least(criticality_weight("criticality_level", 0.3) / 0.85, one)), (0.15, F.least(F.col("stockout_rate") / 0.18, one))
    )
    return rated.select(*keys, "units_demanded", "units_fulfilled", "units_lost_sales", "fill_rate", "stockout_rate", "stockout_day_rate", "service_gap_rate", "lost_sales_revenue", (F.lit(100.0) * risk).alias("service_risk_score_base"))


def flagged(daily: DataFrame) -> DataFrame:
    """The daily fact with its policy cap and its excess and slow-moving days (0.0 or 1.0)."""
    return daily.withColumns({"dos_cap": dos_cap(), "excess_day": flag(F.col("days_of_supply") > dos_cap()), "slow_moving_day": flag(slow_moving())})
