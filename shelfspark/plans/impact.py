"""Money impact: lost margin, trapped capital, supplier delay, and what twelve months could recover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expressions import clip, dos_cap, flag, loss_ratio, money_sum, money_total, slow_moving, unit, weighted
from shelfspark.plans.ranking import ranked, top_of_all
from shelfspark.schemas import Assumptions
from shelfspark.sources.scratch import stored

AMOUNTS = ["lost_sales_revenue", "lost_sales_margin_proxy", "excess_inventory_value_proxy", "trapped_working_capital_proxy", "slow_moving_value_proxy", "supplier_delay_impact_proxy"]

#: What each line of the summary means (fixed texts).
DEFINITIONS = {
    "analysis_days": "Observed period length (days)",
    "annualization_factor": "365 / analysis_days",
    "lost_sales_revenue_observed": "Observed lost sales value from stockout unmet demand",
    "excess_inventory_value_proxy_observed": "Proxy value of inventory above ABC DOS policy caps",
    "trapped_working_capital_proxy_observed": "Proxy of inefficient inventory capital (excess + incremental slow-moving)",
    "slow_moving_value_proxy_observed": "Observed inventory value in slow-moving days",
    "supplier_delay_impact_proxy_observed": "Proxy lost-sales value associated with supplier delay severity",
    "lost_sales_revenue_annualized": "Annualized observed lost sales value from stockouts",
    "excess_inventory_value_proxy_annualized": "Annualized proxy value of inventory above DOS policy caps",
    "trapped_working_capital_proxy_annualized": "Annualized inefficient working-capital proxy",
    "slow_moving_value_proxy_annualized": "Annualized slow-moving inventory value proxy",
    "supplier_delay_impact_proxy_annualized": "Annualized supplier delay impact proxy",
    "opportunity_total_12m_proxy": "Estimated 12-month value pool: margin recovery + WC release",
}


def delay_factor(performance: DataFrame, a: Assumptions = Assumptions()) -> DataFrame:
    late, delay, spread = unit(1.0 - F.col("on_time_delivery_rate")), unit(F.col("average_delay_days") / a.delay_norm), unit(F.col("lead_time_variability") / a.lead_time_norm)
    factor = unit(weighted(*zip(a.delay_weights, (late, delay, spread), strict=True)))
    return performance.select("supplier_id", "supplier_name", factor.alias("supplier_delay_factor"), "on_time_delivery_rate", "average_delay_days", "lead_time_variability")


def valued(daily: DataFrame, products: DataFrame, factors: DataFrame, a: Assumptions = Assumptions(), on: str = "supplier_id") -> DataFrame:
    """The daily fact with its amounts: margin lost, excess, slow-moving and trapped value, delay impact. ``factors`` are by supplier, or ``on`` by product."""
    margin = F.when(F.col("unit_price") > 0, clip(F.col("unit_price") - F.col("unit_cost"), 0.0) / F.nullif("unit_price", F.lit(0.0))).otherwise(0.0)
    named = daily.join(products.select("product_id", "product_name", margin.alias("margin")), "product_id", "left").join(factors.select(on, "supplier_delay_factor"), on, "left")
    out = named.withColumns({"gross_margin_rate": clip(F.coalesce("margin", F.lit(a.missing_margin)), 0.0, a.top_margin), "supplier_delay_factor": F.coalesce("supplier_delay_factor", F.lit(a.missing_delay))}).drop("margin")
    days = F.col("days_of_supply")
    excess = unit(F.when(days > 0, clip(days - dos_cap(), 0.0) / F.nullif(days, F.lit(0.0))).otherwise(0.0))
    out = out.withColumns({"excess_inventory_value_proxy": F.col("inventory_value") * excess, "slow_moving_value_proxy": F.col("inventory_value") * flag(slow_moving())})
    rest = clip(F.col("slow_moving_value_proxy") - F.col("excess_inventory_value_proxy"), 0.0)
    return out.withColumns({
        "trapped_working_capital_proxy": F.col("excess_inventory_value_proxy") + a.slow_weight * rest, "lost_sales_margin_proxy": F.col("lost_sales_revenue") * F.col("gross_margin_rate"),
        "supplier_delay_impact_proxy": F.col("lost_sales_revenue") * F.col("supplier_delay_factor"),
    })


def annual_factor(daily: DataFrame) -> DataFrame:
    """One row: analysis_days and annualization_factor."""
    return daily.agg(F.countDistinct("date").alias("analysis_days")).select("analysis_days", (365.0 / F.greatest("analysis_days", F.lit(1))).alias("annualization_factor"))


def _opportunity(df: DataFrame, a: Assumptions) -> DataFrame:
    factor = F.col("annualization_factor")
    out = df.withColumns({f"{x}_annualized": F.col(f"{x}_observed") * factor for x in AMOUNTS})
    out = out.withColumns({"opportunity_margin_recovery_12m_proxy": F.col("lost_sales_margin_proxy_annualized") * a.margin_recovery, "opportunity_wc_release_12m_proxy": F.col("trapped_working_capital_proxy_annualized") * a.capital_release})
    return out.withColumn("opportunity_total_12m_proxy", F.col("opportunity_margin_recovery_12m_proxy") + F.col("opportunity_wc_release_12m_proxy"))


def sums_by(amounts: DataFrame, keys: list[str]) -> DataFrame:
    """Units and observed amounts of entities of any grain."""
    return amounts.groupBy(*keys).agg(F.sum("units_demanded").alias("units_demanded"), F.sum("units_lost_sales").alias("units_lost_sales"), *[money_sum(x).alias(f"{x}_observed") for x in AMOUNTS])


def impact_by(amounts: DataFrame, keys: list[str], a: Assumptions = Assumptions(), top: int | None = None, days: DataFrame | None = None) -> DataFrame:
    """Observed and annualized amounts, opportunity, its share and rank for entities of any grain (the first ``top`` of them).

    A year's amount is the observed one times one factor, so it is taken after summing. Ranks are given over many
    tasks; equal opportunities go by their keys. ``days`` is the daily fact that the amounts are of, where that is at hand.
    """
    entities = stored(sums_by(amounts, keys))  # read for the total and for the ranks
    out = _opportunity(entities.crossJoin(F.broadcast(annual_factor(amounts if days is None else days))), a).drop("analysis_days", "annualization_factor")  # one row
    total = out.agg(money_total("opportunity_total_12m_proxy").alias("pool"))
    shared = out.crossJoin(F.broadcast(total))  # one row
    order = [F.round(F.col("opportunity_total_12m_proxy") * 1e4).desc(), *map(F.col, keys)]  # to four places
    shared = shared.withColumns({
        "stockout_rate": loss_ratio("units_lost_sales", "units_demanded"), "opportunity_share": F.when(F.col("pool") > 0, F.col("opportunity_total_12m_proxy") / F.nullif("pool", F.lit(0.0))).otherwise(0.0),
    }).drop("pool")
    return ranked(shared, order, "opportunity_rank").drop("n_all") if top is None else top_of_all(shared, order, top, "opportunity_rank")


def overall(amounts: DataFrame, a: Assumptions = Assumptions(), days: DataFrame | None = None) -> DataFrame:
    """Thirteen lines of metric, value and definition."""
    row = amounts.agg(*[money_sum(x).alias(f"{x}_observed") for x in AMOUNTS]).crossJoin(annual_factor(amounts if days is None else days))  # one row each
    row = _opportunity(row, a).withColumn("analysis_days", F.col("analysis_days").cast("double"))
    lines = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(d).alias("definition")) for m, d in DEFINITIONS.items()])
    return row.select(F.inline(lines))


def priorities(by_sku: DataFrame, by_warehouse: DataFrame, by_supplier: DataFrame, by_category: DataFrame, top: int = 15) -> DataFrame:
    """The first ``top`` of each kind of entity by rank, in one table."""
    keep = ["opportunity_rank", "opportunity_total_12m_proxy", "opportunity_margin_recovery_12m_proxy", "opportunity_wc_release_12m_proxy", "lost_sales_revenue_annualized", "trapped_working_capital_proxy_annualized", "supplier_delay_impact_proxy_annualized", "opportunity_share"]
    one = lambda df, kind, key, name: df.filter(F.col("opportunity_rank") <= top).select(F.lit(kind).alias("entity_type"), key.alias("entity_id"), name.alias("entity_name"), *keep)
    sku = one(by_sku, "SKU", F.concat("product_id", F.lit("|"), "warehouse_id"), F.concat("product_name", F.lit(" @ "), "warehouse_id"))
    warehouse, supplier = one(by_warehouse, "Warehouse", F.col("warehouse_id"), F.col("warehouse_name")), one(by_supplier, "Supplier", F.col("supplier_id"), F.col("supplier_name"))
    return sku.unionByName(warehouse).unionByName(supplier).unionByName(one(by_category, "Category", F.col("category"), F.col("category")))
