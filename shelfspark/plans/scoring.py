"""Governed scores of SKU-locations, suppliers and segments, and the queue over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expressions import argmax, clip, criticality_weight, day_bit, dbl, exact_sum, floored_share, linear_score, log_share_score, money_parts, money_whole, month_of, ratio, risk_tier, safe_divide, scaled, unit, weighted
from shelfspark.plans.features import DRIVERS
from shelfspark.plans.views import flagged
from shelfspark.schemas import Policy

SCORES = [name for name, _ in DRIVERS]

#: Advice by main driver for each kind of entity (fixed texts).
ACTIONS = {
    "Service Risk": {
        "sku_warehouse": "review reorder point and raise safety stock",
        "supplier": "review service target by SKU class and stabilize replenishment cadence",
        "segment": "review planning assumptions and rebalance stock across warehouses",
    },
    "Stockout Risk": {
        "sku_warehouse": "expedite replenishment and rebalance stock across warehouses",
        "supplier": "expedite replenishment on constrained supplier lanes",
        "segment": "raise safety stock for critical SKUs and protect promotion allocation",
    },
    "Excess Inventory": {
        "sku_warehouse": "reduce safety stock and review assortment strategy",
        "supplier": "review MOQ and order cadence to reduce overstock propagation",
        "segment": "rebalance stock across warehouses and reduce order-up-to levels",
    },
    "Supplier Risk": {
        "sku_warehouse": "investigate supplier reliability and qualify backup source",
        "supplier": "investigate supplier reliability and execute corrective action plan",
        "segment": "review sourcing mix and supplier dependency for this segment",
    },
    "Working Capital": {
        "sku_warehouse": "review planning assumptions and tighten order-up-to policy",
        "supplier": "review planning assumptions and align procurement with demand volatility",
        "segment": "review assortment strategy and release cash from slow-moving inventory",
    },
}

SKU_KEYS, SUPPLIER_KEYS, SEGMENT_KEYS = ["product_id", "warehouse_id", "supplier_id", "category", "region"], ["supplier_id"], ["category", "region"]
PRIORITY = (0.24, 0.22, 0.18, 0.16, 0.14, 0.06)


def supplier_base(performance: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Base risk of each supplier from its delivery record."""
    late, short = unit(1.0 - F.col("on_time_delivery_rate")), unit(1.0 - F.col("received_vs_ordered_fill_rate"))
    parts = ((0.45, linear_score(late, *p.late)), (0.20, linear_score(clip("average_delay_days", 0.0), *p.delay)), (0.20, linear_score(clip("lead_time_variability", 0.0), *p.lead_time)), (0.15, linear_score(short, *p.underfill)))
    return performance.withColumn("supplier_risk_score_base", clip(weighted(*parts), 0.0, 100.0)).drop("supplier_service_risk_proxy")


def scoring_input(daily: DataFrame, base: DataFrame, on: str = "supplier_id") -> DataFrame:
    """The daily fact with month, flags and the columns that are weighted by demand (at least 1). ``base`` is by supplier, or ``on`` by product."""
    w = clip(dbl("units_demanded"), 1.0)
    joined = flagged(daily).join(base.select(on, "supplier_risk_score_base"), on, "left")
    return joined.withColumns({
        "month": month_of(), "demand_weight": w, "weighted_criticality": criticality_weight("criticality_level", 0.6) * w, "weighted_dos_cap": F.col("dos_cap") * w,
        "weighted_supplier_risk": F.coalesce("supplier_risk_score_base", F.lit(50.0)) * w,
    })


_UNITS = ["units_demanded", "units_fulfilled", "units_lost_sales"]
_DAYS = ["stockout_flag", "excess_day", "slow_moving_day", "days_of_supply"]
_AMOUNTS = ["service_gap_units", "inventory_value", "lost_sales_revenue", "demand_weight", "weighted_criticality", "weighted_dos_cap", "weighted_supplier_risk"]
_PARTS = [f"{n}_{part}" for n in _AMOUNTS for part in ("high", "low")]
_COUNTS = [f"n_{n}" for n in [*_DAYS, "inventory_value"]]


def day_states(prepared: DataFrame) -> DataFrame:
    """The states of single days: a lazy projection, so that only the columns that measures ask for are read and merged.

    An amount is two longs (``money_parts``), so merging them in any order gives the same sums. The days with rows are one
    bit each, which ``bit_or`` merges without counting a day twice.
    """
    parts = [p.alias(f"{n}_{part}") for n in _AMOUNTS for part, p in zip(("high", "low"), money_parts(n), strict=True)]
    return prepared.select(*SKU_KEYS, "month", *_UNITS, *_DAYS, *parts, *[F.col(n[2:]).isNotNull().cast("long").alias(n) for n in _COUNTS], day_bit().alias("day_bits"))


def merged_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of a coarser grain (keys and month)."""
    return states.groupBy(*keys, "month").agg(*[F.sum(n).alias(n) for n in [*_UNITS, *_DAYS, *_PARTS, *_COUNTS]], F.bit_or("day_bits").alias("day_bits"))


def partial_states(prepared: DataFrame) -> DataFrame:
    """Sums, counts and days of each SKU-location and month: what every measure of every coarser grain is merged from.

    Months part the rows, so a new month is new states only.
    """
    return merged_states(day_states(prepared), SKU_KEYS)


def entity_measures(states: DataFrame, keys: list[str], months_apart: bool = False) -> DataFrame:
    """Measures of entities of any grain from daily or monthly states; persistence is the share of months with losses.

    With ``months_apart``, for entities that are many and not parted like the states, sums are merged without months and
    only losses and days travel by month.
    """
    total = lambda n: (money_whole(F.sum(f"{n}_high"), F.sum(f"{n}_low")) if n in _AMOUNTS else F.sum(n)).cast("double")
    mean = lambda n: total(n) / F.nullif(total(f"n_{n}"), F.lit(0.0))
    sums = {n: F.sum(n) for n in _UNITS} | {n: total(n) for n in _AMOUNTS if n != "inventory_value"}
    sums |= {"stockout_frequency": mean("stockout_flag"), "excess_day_rate": mean("excess_day"), "slow_moving_rate": mean("slow_moving_day"), "average_days_of_supply": mean("days_of_supply"), "average_inventory_value": mean("inventory_value")}
    sums |= {"inventory_value_sum": total("inventory_value")}
    monthly = {"active_days": F.sum(F.bit_count("day_bits")), "stockout_active_month_ratio": F.avg((F.col("units_lost_sales") > 0).cast("double"))}
    if months_apart:
        months = merged_states(states, keys).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[f.alias(n) for n, f in monthly.items()])
        whole = states.groupBy(*keys).agg(*[f.alias(n) for n, f in sums.items()])
        joined = whole.join(months, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])
    else:
        joined = merged_states(states, keys).groupBy(*keys).agg(*[f.alias(n) for n, f in (sums | monthly).items()])
    by_weight = lambda x: safe_divide(x, "demand_weight")
    return joined.withColumns({
        "fill_rate": safe_divide("units_fulfilled", "units_demanded"), "stockout_rate": safe_divide("units_lost_sales", "units_demanded"), "service_gap_rate": safe_divide("service_gap_units", "units_demanded"),
        "criticality_index": by_weight("weighted_criticality"), "dos_stretch": F.coalesce(ratio("average_days_of_supply", by_weight("weighted_dos_cap"), None), F.lit(0.0)),
        "supplier_risk_score": clip(by_weight("weighted_supplier_risk"), 0.0, 100.0),
    }).drop("demand_weight", "weighted_criticality", "weighted_dos_cap", "weighted_supplier_risk")


def priority(weights: tuple[float, ...] = PRIORITY) -> Column:
    """Priority of the five scores, and of the smaller of service and excess risk."""
    return clip(weighted(*zip(weights, [*map(F.col, SCORES), F.least("service_risk_score", "excess_inventory_score")], strict=True)), 0.0, 100.0)


def company_total(daily: DataFrame) -> DataFrame:
    """One row: all_lost and all_value of the whole daily fact."""
    return daily.agg(*[exact_sum(n).cast("double").alias(a) for n, a in (("lost_sales_revenue", "all_lost"), ("inventory_value", "all_value"))])


def component_scores(measures: DataFrame, total: DataFrame, p: Policy = Policy()) -> DataFrame:
    """Shares of the company's ``total``, five scores, priority, tier and main driver."""
    out = measures.crossJoin(F.broadcast(total))  # one row
    out = out.withColumns({"lost_sales_share": floored_share("lost_sales_revenue", "all_lost"), "inventory_value_share": floored_share("inventory_value_sum", "all_value")})
    lost, held = log_share_score("lost_sales_share", *p.lost_share), log_share_score("inventory_value_share", *p.inventory_share)
    stretch, bounded = linear_score(clip("dos_stretch", 0.0), *p.dos_stretch), lambda x, b: linear_score(unit(x), *b)
    out = out.withColumns({
        "service_risk_score": clip(weighted((0.35, bounded(1.0 - F.col("fill_rate"), p.fill_gap)), (0.30, bounded("service_gap_rate", p.service_gap)), (0.20, bounded("criticality_index", p.criticality)), (0.15, lost)), 0.0, 100.0),
        "stockout_risk_score": clip(weighted((0.55, bounded("stockout_rate", p.stockout_rate)), (0.30, bounded("stockout_active_month_ratio", p.persistence)), (0.15, lost)), 0.0, 100.0),
        "excess_inventory_score": clip(weighted((0.45, stretch), (0.35, bounded("excess_day_rate", p.excess_days)), (0.20, held)), 0.0, 100.0),
        "working_capital_risk_score": clip(weighted((0.45, stretch), (0.30, bounded("slow_moving_rate", p.slow_moving)), (0.25, held)), 0.0, 100.0),
        "supplier_risk_score": clip("supplier_risk_score", 0.0, 100.0),
    })
    return out.withColumn("governance_priority_score", priority()).withColumns({"risk_tier": risk_tier("governance_priority_score"), "main_risk_driver": argmax(DRIVERS)}).drop("all_lost", "all_value")


def action(driver: Column, tier: Column, entity: str) -> Column:
    """Advice by driver and kind of entity; a low tier is only watched."""
    out = F.when(tier == "Low", "monitor only")
    for name, by_entity in ACTIONS.items():
        if entity in by_entity:
            out = out.when(driver == name, by_entity[entity])
    return out.otherwise("review planning assumptions")


def _advised(df: DataFrame, entity: str) -> DataFrame:
    return df.withColumn("recommended_action", action(F.col("main_risk_driver"), F.col("risk_tier"), entity))


_HEAD = [*SCORES, "governance_priority_score", "risk_tier", "main_risk_driver", "recommended_action"]
_TAIL = ["lost_sales_share", "inventory_value_share", "lost_sales_revenue", "inventory_value_sum"]


def sku_risk(states: DataFrame, total: DataFrame) -> DataFrame:
    scored = component_scores(entity_measures(states, SKU_KEYS), total)
    return _advised(scored, "sku_warehouse").select(*SKU_KEYS, *_HEAD, "fill_rate", "stockout_rate", "service_gap_rate", "excess_day_rate", "slow_moving_rate", "dos_stretch", *_TAIL)


def supplier_risk(states: DataFrame, base: DataFrame, total: DataFrame) -> DataFrame:
    """Scores of suppliers; a supplier's own base score stands for the demand-weighted one."""
    joined = entity_measures(states, SUPPLIER_KEYS, months_apart=True).join(base, "supplier_id", "left")
    joined = joined.withColumn("supplier_risk_score", F.coalesce("supplier_risk_score_base", "supplier_risk_score"))
    record = ["on_time_delivery_rate", "average_delay_days", "lead_time_variability", "received_vs_ordered_fill_rate"]
    return _advised(component_scores(joined, total), "supplier").select("supplier_id", "supplier_name", *_HEAD, *record, "fill_rate", "stockout_rate", *_TAIL)


def segment_risk(states: DataFrame, total: DataFrame) -> DataFrame:
    scored = component_scores(entity_measures(states, SEGMENT_KEYS), total)
    return _advised(scored, "segment").select(F.concat("category", F.lit(" | "), "region").alias("segment_id"), "category", "region", *_HEAD, "fill_rate", "stockout_rate", *_TAIL)


def priority_queue(skus: DataFrame, suppliers: DataFrame, segments: DataFrame) -> DataFrame:
    """All entities in one queue."""
    keep = [*_HEAD, "lost_sales_revenue", "inventory_value_sum"]
    one = lambda df, kind, key, name: df.select(F.lit(kind).alias("entity_type"), key.alias("entity_id"), name.alias("entity_name"), *keep)
    sku = one(skus, "sku_warehouse", F.concat("product_id", F.lit("|"), "warehouse_id"), F.concat("product_id", F.lit(" @ "), "warehouse_id"))
    return sku.unionByName(one(suppliers, "supplier", F.col("supplier_id"), F.col("supplier_name"))).unionByName(one(segments, "segment", F.col("segment_id"), F.col("segment_id")))


def queue_facts(queue: DataFrame) -> DataFrame:
    """For each kind of entity: how many are High or Critical, and the first in the queue."""
    top = F.max(F.struct("governance_priority_score", "lost_sales_revenue", "entity_id"))
    counted = queue.groupBy("entity_type").agg(F.count_if(F.col("risk_tier").isin("High", "Critical")).alias("high_or_critical"), top.alias("top"))
    return counted.select("entity_type", "high_or_critical", F.col("top.entity_id").alias("top_entity"), F.col("top.governance_priority_score").alias("top_score"))


def legacy_composite(signals: DataFrame) -> DataFrame:
    """Older composite of six signals, each scaled by its own range (a constant one counts as 0.5)."""
    names = ["stockout_day_rate", "excess_inventory_rate", "slow_moving_rate", "lead_time_cv", "demand_cv"]
    both = signals.withColumn("both", F.col("stockout_day_rate") * F.col("excess_inventory_rate"))
    bounds = both.agg(*[f(x).alias(f"{n}_{x}") for x in [*names, "both"] for n, f in (("low", F.min), ("high", F.max))])
    part = lambda x: scaled(x, f"low_{x}", f"high_{x}", 1.0, 0.5)
    score = weighted((0.35, part("stockout_day_rate")), (0.35, part("excess_inventory_rate")), (0.15, part("both")), (0.05, part("slow_moving_rate")), (0.05, part("lead_time_cv")), (0.05, part("demand_cv")))
    return both.crossJoin(F.broadcast(bounds)).withColumn("composite_risk", F.round(F.lit(100.0) * score, 2)).select(*signals.columns, "composite_risk")
