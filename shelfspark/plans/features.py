"""Refined profiles and the baseline SKU risk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expressions import argmax, clip, fill_ratio, loss_ratio, money_mean, money_sum, risk_tier, scaled, unit, weighted
from shelfspark.plans.selection import exact_quantiles
from shelfspark.plans.views import flagged
from shelfspark.sources.scratch import stored

DRIVERS = (("service_risk_score", "Service Risk"), ("stockout_risk_score", "Stockout Risk"), ("excess_inventory_score", "Excess Inventory"), ("supplier_risk_score", "Supplier Risk"), ("working_capital_risk_score", "Working Capital"))

#: Advice of the baseline table by main driver (fixed texts).
BASELINE_ACTIONS = {
    "Service Risk": "Increase safety stock and tighten replenishment cycle for affected SKU-location.",
    "Stockout Risk": "Raise reorder point and protect promotional allocation to reduce lost sales.",
    "Excess Inventory": "Reduce order-up-to level and trigger markdown/transfer for overstock exposure.",
    "Supplier Risk": "Escalate supplier performance plan and evaluate secondary sourcing options.",
    "Working Capital": "Rebalance network inventory and enforce stricter MOQ/order frequency controls.",
}


def supplier_features(performance: DataFrame) -> DataFrame:
    """The supplier record with each part of its proxy kept between 0 and 1, rounded to two places."""
    late, short = unit(1.0 - F.col("on_time_delivery_rate")), unit(1.0 - F.col("received_vs_ordered_fill_rate"))
    proxy = weighted((0.40, late), (0.20, unit(F.col("average_delay_days") / 10.0)), (0.20, unit(F.col("lead_time_variability") / 8.0)), (0.20, short))
    return performance.withColumn("supplier_service_risk_proxy", F.round(F.lit(100.0) * proxy, 2))


def product_features(profile: DataFrame) -> DataFrame:
    """The product profile with a capital proxy that scales value by its 95th percentile over products."""
    (top,) = exact_quantiles(profile, {"average_inventory_value": [0.95]})[()]["average_inventory_value"]
    value = unit(F.col("average_inventory_value") / F.nullif(F.lit(top).cast("double"), F.lit(0.0)))
    proxy = weighted((0.45, F.col("excess_inventory_proxy")), (0.25, F.col("slow_moving_inventory_proxy")), (0.20, unit(F.col("average_days_of_supply") / 60.0)), (0.10, value))
    return profile.withColumn("working_capital_risk_proxy", F.round(F.lit(100.0) * proxy, 2))


def warehouse_features(profile: DataFrame) -> DataFrame:
    parts = ((0.40, unit("stockout_rate")), (0.30, unit(1.0 - F.col("fill_rate"))), (0.20, unit("capacity_pressure_proxy")), (0.10, unit(F.col("average_days_of_supply") / 50.0)))
    return profile.withColumn("warehouse_service_risk_proxy", F.round(F.lit(100.0) * weighted(*parts), 2))


def baseline_risk(daily: DataFrame, suppliers: DataFrame, products: DataFrame) -> DataFrame:
    """First risk table: product, warehouse and supplier with five scores, priority, tier, driver and advice.

    ``suppliers`` and ``products`` are the refined profiles.
    """
    sums = flagged(daily).groupBy("product_id", "warehouse_id", "supplier_id").agg(
        F.sum("units_demanded").alias("d"), F.sum("units_fulfilled").alias("f"), F.sum("units_lost_sales").alias("l"), money_sum("service_gap_units").alias("gap"), F.avg("stockout_flag").alias("stockouts"),
        F.avg("excess_day").alias("excess"), F.avg("slow_moving_day").alias("slow"), F.avg("days_of_supply").alias("dos"), money_mean("inventory_value").alias("value"), money_sum("lost_sales_revenue").alias("lost"),
    )
    joined = sums.join(suppliers.select("supplier_id", F.col("supplier_service_risk_proxy").alias("supplier_proxy")), "supplier_id", "left")
    joined = joined.join(products.select("product_id", F.col("working_capital_risk_proxy").alias("capital_proxy")), "product_id", "left").na.fill(0.0, ["supplier_proxy", "capital_proxy"])
    joined = stored(joined)  # read for the bounds and for the scores
    bounds = joined.agg(*[f(x).alias(f"{n}_{x}") for x in ("value", "lost") for n, f in (("low", F.min), ("high", F.max))])
    rated = joined.crossJoin(F.broadcast(bounds))  # one row
    gap, hundred = loss_ratio("gap", "d"), F.lit(100.0)
    scored = rated.withColumns({
        "service_risk_score": hundred * weighted((0.65, unit(gap / 0.25)), (0.35, unit((1.0 - fill_ratio("f", "d")) / 0.15))),
        "stockout_risk_score": hundred * weighted((0.70, unit(F.col("stockouts") / 0.25)), (0.30, unit(loss_ratio("l", "d") / 0.20))),
        "excess_inventory_score": hundred * weighted((0.70, unit(F.col("excess") / 0.40)), (0.30, unit(F.col("dos") / 60.0))),
        "supplier_risk_score": clip("supplier_proxy", 0.0, 100.0),
        "working_capital_risk_score": hundred * weighted((0.55, F.col("capital_proxy") / 100.0), (0.25, unit(F.col("slow") / 0.30)), (0.20, scaled("value", "low_value", "high_value", 100.0, 50.0) / 100.0)),
    })
    names = [n for n, _ in DRIVERS]
    weights = (0.26, 0.22, 0.18, 0.16, 0.10)
    priority = weighted(*[(w, F.col(n)) for w, n in zip(weights, names, strict=True)], (0.08, scaled("lost", "low_lost", "high_lost", 100.0, 50.0)))
    scored = scored.withColumn("governance_priority_score", F.round(priority, 2)).withColumns({"risk_tier": risk_tier("governance_priority_score"), "main_risk_driver": argmax(DRIVERS)})
    advice = F.coalesce(*[F.when(F.col("main_risk_driver") == k, F.lit(v)) for k, v in BASELINE_ACTIONS.items()])
    return scored.select("product_id", "warehouse_id", "supplier_id", *names, "governance_priority_score", "risk_tier", "main_risk_driver", advice.alias("recommended_action"))
