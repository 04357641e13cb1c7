"""Registration of views, features, scores, impact and KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expressions import legacy_class
from shelfspark.operators import kpis
from shelfspark.oracles.base import AMOUNTS, CAP, SCORES, SLOW, div, mean_money, money, rate
from shelfspark.plans import features, impact, scoring, views
from shelfspark.registry import register
from shelfspark.sources.fixtures import Tables

U = "CAST(sum(units_demanded) AS BIGINT) AS units_demanded, CAST(sum(units_fulfilled) AS BIGINT) AS units_fulfilled, CAST(sum(units_lost_sales) AS BIGINT) AS units_lost_sales"
FILL, LOSS = div("sum(units_fulfilled)", "sum(units_demanded)", "1"), div("sum(units_lost_sales)", "sum(units_demanded)", "0")
LOST = f"{money('lost_sales_revenue')} AS lost_sales_revenue"


# what several results start from


def performance(t: Tables) -> DataFrame:
    return t.spread(t.keep("performance", lambda: views.supplier_performance(t.purchase_orders, t.suppliers)), "supplier")


def suppliers(t: Tables) -> DataFrame:
    return features.supplier_features(performance(t))


def products(t: Tables) -> DataFrame:
    return features.product_features(views.product_profile(t.daily, t.products))


def warehouses(t: Tables) -> DataFrame:
    return features.warehouse_features(views.warehouse_profile(t.daily, t.warehouses))


def base(t: Tables) -> DataFrame:
    return scoring.supplier_base(performance(t))


def prepared(t: Tables) -> DataFrame:
    return scoring.scoring_input(t.daily, t.by_product(base(t), "supplier_risk_score_base"), "product_id")


def states(t: Tables) -> DataFrame:
    """States of the days of SKU-locations: all scores are merged from them. Not written, as months of a SKU-location are hardly fewer than its days."""
    return scoring.day_states(prepared(t))


def total(t: Tables) -> DataFrame:
    return scoring.company_total(t.daily)


def skus(t: Tables) -> DataFrame:
    return t.bucket("sku risk", lambda: scoring.sku_risk(states(t), total(t)))


def queue(t: Tables) -> DataFrame:
    return scoring.priority_queue(skus(t), scoring.supplier_risk(states(t), base(t), total(t)), scoring.segment_risk(states(t), total(t)))


def amounts(t: Tables) -> DataFrame:
    return impact.valued(t.daily, t.products.hint("shuffle_hash"), t.by_product(impact.delay_factor(performance(t)), "supplier_delay_factor"), on="product_id")


IMPACT_KEYS = {"sku": ["product_id", "product_name", "warehouse_id", "category", "supplier_id"], "warehouse": ["warehouse_id", "region"], "supplier": ["supplier_id"], "category": ["category"]}


def impacts(t: Tables, kind: str, top: int | None = None) -> DataFrame:
    out = impact.impact_by(amounts(t), IMPACT_KEYS[kind], top=top, days=t.daily)
    if kind == "warehouse":
        out = out.join(F.broadcast(t.warehouses.select("warehouse_id", "warehouse_name")), "warehouse_id", "left")
    if kind == "supplier":
        out = out.join(impact.delay_factor(performance(t)).drop("supplier_delay_factor"), "supplier_id", "left")
    return out


for _name in ("products", "suppliers", "warehouses", "product_classification", "demand_history", "inventory_snapshots", "purchase_orders"):
    register(f"io02_raw_{_name}", lambda t, n=_name: t.raw(n), f"SELECT * FROM {_name}")

register("v01_daily_product_warehouse_metrics", lambda t: t.daily, "SELECT * FROM daily")
register("v02_supplier_performance_summary", performance, "SELECT * FROM supplier_perf")
register("v03_product_inventory_profile", lambda t: views.product_profile(t.daily, t.products), "SELECT * FROM product_prof")
register("v04_warehouse_service_profile", lambda t: views.warehouse_profile(t.daily, t.warehouses), "SELECT * FROM warehouse_prof")
register("v05_inventory_risk_base", lambda t: views.inventory_risk(t.daily), "SELECT * FROM inventory_base")
register("v06_service_risk_base", lambda t: views.service_risk(t.daily), "SELECT * FROM service_base")
register("f01_supplier_features", suppliers, "SELECT * FROM supplier_feat")
register("f02_product_features", products, "SELECT * FROM product_feat")
register("f03_warehouse_features", warehouses, "SELECT * FROM warehouse_feat")
register("f04_sku_risk_baseline", lambda t: features.baseline_risk(t.daily, suppliers(t), products(t)), "SELECT * FROM sku_risk_baseline")

register("s01_supplier_base_score", base, "SELECT * FROM supplier_base")
register(
    "s02_scoring_input",
    lambda t: prepared(t).groupBy("month").agg(F.count(F.lit(1)).alias("days"), *[F.sum(x).cast("double").alias(x) for x in ("demand_weight", "excess_day", "slow_moving_day")], *[kpis.money_sum(x).alias(x) for x in ("weighted_criticality", "weighted_dos_cap", "weighted_supplier_risk")]),
    f"""SELECT month, count(*) AS days, sum(w) AS demand_weight, sum(excess_day) AS excess_day, sum(slow_day) AS slow_moving_day, {money('crit * w')} AS weighted_criticality, {money('cap * w')} AS weighted_dos_cap, {money('base * w')} AS weighted_supplier_risk FROM x_scoring GROUP BY month""",
)
_MEASURES = ["fill_rate", "stockout_rate", "service_gap_rate", "excess_day_rate", "slow_moving_rate", "dos_stretch", "stockout_active_month_ratio", "lost_sales_revenue", "inventory_value_sum", "stockout_frequency", "average_days_of_supply", "average_inventory_value", "active_days"]
register("s03_entity_measures_by_region", lambda t: scoring.entity_measures(states(t), scoring.SEGMENT_KEYS).select("category", "region", *_MEASURES), f"SELECT category, region, {', '.join(_MEASURES)} FROM x_segment_measures")
register(
    "s04_component_scores",
    lambda t: scoring.component_scores(scoring.entity_measures(states(t), scoring.SEGMENT_KEYS), total(t)).select("category", "region", *scoring.SCORES, "governance_priority_score", "risk_tier", "main_risk_driver"),
    f"SELECT category, region, {', '.join(scoring.SCORES)}, governance_priority_score, risk_tier, main_risk_driver FROM segment_risk",
)
register("s05_recommended_actions", lambda t: queue(t).groupBy("entity_type", "main_risk_driver", "risk_tier", "recommended_action").agg(F.count(F.lit(1)).alias("entities")), "SELECT entity_type, main_risk_driver, risk_tier, recommended_action, count(*) AS entities FROM queue GROUP BY ALL")
_TAIL = "lost_sales_share, inventory_value_share, lost_sales_revenue, inventory_value_sum"
register("s06_sku_risk_governed", skus, f"SELECT product_id, warehouse_id, supplier_id, category, region, {SCORES}, fill_rate, stockout_rate, service_gap_rate, excess_day_rate, slow_moving_rate, coalesce(dos_stretch, 0) AS dos_stretch, {_TAIL} FROM sku_risk")
register("s07_supplier_risk", lambda t: scoring.supplier_risk(states(t), base(t), total(t)), f"SELECT supplier_id, supplier_name, {SCORES}, on_time_delivery_rate, average_delay_days, lead_time_variability, received_vs_ordered_fill_rate, fill_rate, stockout_rate, {_TAIL} FROM supplier_risk")
register("s08_segment_risk", lambda t: scoring.segment_risk(states(t), total(t)), f"SELECT category || ' | ' || region AS segment_id, category, region, {SCORES}, fill_rate, stockout_rate, {_TAIL} FROM segment_risk")
register("s09_master_priority_queue", queue, "SELECT * FROM queue")
register(
    "s10_management_counts",
    lambda t: scoring.queue_facts(queue(t)),
    "SELECT entity_type, count(*) FILTER (WHERE risk_tier IN ('High', 'Critical')) AS high_or_critical, max(struct_pack(a := governance_priority_score, b := lost_sales_revenue, c := entity_id)).c AS top_entity, max(governance_priority_score) AS top_score FROM queue GROUP BY entity_type",
)


def _signals(t: Tables) -> DataFrame:
    spread = lambda x: F.coalesce(F.stddev_samp(x) / F.nullif(F.avg(x), F.lit(0.0)), F.lit(0.0))
    per = views.flagged(t.daily).groupBy("product_id").agg(F.avg("stockout_flag").alias("stockout_day_rate"), F.avg("excess_day").alias("excess_inventory_rate"), F.avg("slow_moving_day").alias("slow_moving_rate"), spread(F.col("units_demanded").cast("double")).alias("demand_cv"))
    leads = t.purchase_orders.groupBy("product_id").agg(spread(F.datediff("actual_arrival_date", "order_date").cast("double")).alias("lead_time_cv"))
    return per.join(leads, "product_id", "left").na.fill(0.0, ["lead_time_cv"])


def _mm(x: str) -> str:
    return f"(CASE WHEN min({x}) OVER () = max({x}) OVER () THEN 0.5 ELSE ({x} - min({x}) OVER ()) / nullif(max({x}) OVER () - min({x}) OVER (), 0) END)"


_LEGACY = f"""SELECT *, round(100 * (CAST(0.35 AS DOUBLE) * {_mm('stockout_day_rate')} + CAST(0.35 AS DOUBLE) * {_mm('excess_inventory_rate')} + CAST(0.15 AS DOUBLE) * {_mm('(stockout_day_rate * excess_inventory_rate)')} + CAST(0.05 AS DOUBLE) * {_mm('slow_moving_rate')}
    + CAST(0.05 AS DOUBLE) * {_mm('lead_time_cv')} + CAST(0.05 AS DOUBLE) * {_mm('demand_cv')}), 2) AS composite_risk FROM (SELECT a.*, coalesce(lead_time_cv, 0) AS lead_time_cv FROM (SELECT product_id, avg(stockout_flag) AS stockout_day_rate, {rate(f'days_of_supply > {CAP}')} AS excess_inventory_rate,
    {rate(SLOW)} AS slow_moving_rate, coalesce(stddev_samp(CAST(units_demanded AS DOUBLE)) / nullif(avg(CAST(units_demanded AS DOUBLE)), 0), 0) AS demand_cv FROM daily GROUP BY product_id) a
    LEFT JOIN (SELECT product_id, coalesce(stddev_samp(CAST(actual_arrival_date - order_date AS DOUBLE)) / nullif(avg(CAST(actual_arrival_date - order_date AS DOUBLE)), 0), 0) AS lead_time_cv FROM purchase_orders GROUP BY product_id) b ON a.product_id = b.product_id)"""
register("s11_legacy_composite", lambda t: scoring.legacy_composite(_signals(t)), _LEGACY)
def _classes(t: Tables) -> DataFrame:
    return scoring.legacy_composite(_signals(t)).groupBy(legacy_class("composite_risk").alias("risk_class")).agg(F.count(F.lit(1)).alias("products"))


register("s12_legacy_class", _classes, f"SELECT CASE WHEN composite_risk >= 50 THEN 'Critical' WHEN composite_risk >= 35 THEN 'High' WHEN composite_risk >= 20 THEN 'Medium' ELSE 'Low' END AS risk_class, count(*) AS products FROM ({_LEGACY}) GROUP BY 1")

register("i01_supplier_delay_factor", lambda t: impact.delay_factor(performance(t)), "SELECT * FROM delay_factor")
_AMOUNT_COLUMNS = ["date", "warehouse_id", "product_id", "product_name", "gross_margin_rate", "supplier_delay_factor", *AMOUNTS]
register("i02_daily_impact", lambda t: amounts(t).select(*_AMOUNT_COLUMNS), f"SELECT {', '.join(_AMOUNT_COLUMNS)} FROM valued")
register("i03a_impact_by_sku", lambda t: impacts(t, "sku"), "SELECT * FROM impact_sku")
register("i03b_impact_by_warehouse", lambda t: impacts(t, "warehouse"), "SELECT i.*, warehouse_name FROM impact_warehouse i LEFT JOIN warehouses w ON w.warehouse_id = i.warehouse_id")
register("i03c_impact_by_supplier", lambda t: impacts(t, "supplier"), "SELECT i.*, supplier_name, on_time_delivery_rate, average_delay_days, lead_time_variability FROM impact_supplier i LEFT JOIN supplier_perf w ON w.supplier_id = i.supplier_id")
register("i03d_impact_by_category", lambda t: impacts(t, "category"), "SELECT * FROM impact_category")


def _summary_sql() -> str:
    names = {f"{x}_observed": money(x) for x in AMOUNTS} | {f"{x}_annualized": f"{money(x)} * max(factor)" for x in AMOUNTS}
    values = {"analysis_days": "CAST(max(analysis_days) AS DOUBLE)", "annualization_factor": "max(factor)"} | names
    values["opportunity_total_12m_proxy"] = f"{money('lost_sales_margin_proxy')} * max(factor) * CAST(0.35 AS DOUBLE) + {money('trapped_working_capital_proxy')} * max(factor) * CAST(0.25 AS DOUBLE)"
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {values[m]} AS value, '{d}' AS definition FROM valued, annual" for m, d in impact.DEFINITIONS.items())


register("i04_impact_overall", lambda t: impact.overall(amounts(t), days=t.daily), _summary_sql())
_OPP = "opportunity_rank, opportunity_total_12m_proxy, opportunity_margin_recovery_12m_proxy, opportunity_wc_release_12m_proxy, lost_sales_revenue_annualized, trapped_working_capital_proxy_annualized, supplier_delay_impact_proxy_annualized, opportunity_share"
register(
    "i05_opportunity_priority",
    lambda t: impact.priorities(*[impacts(t, k, 15) for k in ("sku", "warehouse", "supplier", "category")]),
    f"""SELECT 'SKU' AS entity_type, product_id || '|' || warehouse_id AS entity_id, product_name || ' @ ' || warehouse_id AS entity_name, {_OPP} FROM impact_sku WHERE opportunity_rank <= 15
    UNION ALL SELECT 'Warehouse', i.warehouse_id, warehouse_name, {_OPP} FROM impact_warehouse i LEFT JOIN warehouses w ON w.warehouse_id = i.warehouse_id WHERE opportunity_rank <= 15
    UNION ALL SELECT 'Supplier', i.supplier_id, supplier_name, {_OPP} FROM impact_supplier i LEFT JOIN suppliers s ON s.supplier_id = i.supplier_id WHERE opportunity_rank <= 15
    UNION ALL SELECT 'Category', category, category, {_OPP} FROM impact_category WHERE opportunity_rank <= 15""",
)

# -- KPIs -------------------------------------------------------------------------------------------------------------

register("k01_overall_fill_rate", lambda t: kpis.overall_fill_rate(t.demand_history), f"SELECT CAST(sum(units_demanded) AS BIGINT) AS units_demanded, CAST(sum(units_fulfilled) AS BIGINT) AS units_fulfilled, {FILL} AS overall_fill_rate FROM demand_history")
register("k02_unit_stockout_rate", lambda t: kpis.unit_stockout_rate(t.demand_history), f"SELECT CAST(sum(units_lost_sales) AS BIGINT) AS units_lost_sales, CAST(sum(units_demanded) AS BIGINT) AS units_demanded, {LOSS} AS stockout_rate FROM demand_history")
register("k03_lost_sales_by_category", lambda t: kpis.lost_sales_by_category(t.demand_history, t.products), f"SELECT category, CAST(sum(units_lost_sales) AS BIGINT) AS lost_units, {money('CAST(units_lost_sales AS DOUBLE) * unit_price')} AS lost_revenue FROM demand_history h JOIN products p ON p.product_id = h.product_id GROUP BY category")
register("k04_inventory_value_by_category", lambda t: kpis.inventory_by_category(t.inventory_snapshots, t.products), f"SELECT category, {mean_money('inventory_value')} AS avg_inventory_value, max(inventory_value) AS peak_inventory_value FROM inventory_snapshots i JOIN products p ON p.product_id = i.product_id GROUP BY category")
register(
    "k05_days_of_supply_distribution",
    lambda t: kpis.days_of_supply_spread(t.inventory_snapshots),
    "SELECT min(days_of_supply) AS dos_min, quantile_cont(days_of_supply, 0.25) AS dos_p25, quantile_cont(days_of_supply, 0.5) AS dos_p50, quantile_cont(days_of_supply, 0.75) AS dos_p75, quantile_cont(days_of_supply, 0.9) AS dos_p90, max(days_of_supply) AS dos_max, avg(days_of_supply) AS dos_avg FROM inventory_snapshots",
)
register("k06_supplier_on_time_in_full", lambda t: kpis.supplier_on_time(t.purchase_orders, t.suppliers), f"SELECT s.supplier_id, supplier_name, count(*) AS po_count, {rate('late_delivery_flag = 0')} AS on_time_delivery_rate, avg({div('received_units', 'ordered_units', '1')}) AS in_full_rate FROM purchase_orders o JOIN suppliers s ON s.supplier_id = o.supplier_id GROUP BY s.supplier_id, supplier_name")
register(
    "k07_warehouse_service_comparison",
    lambda t: kpis.warehouse_comparison(t.daily, views.warehouse_profile(t.daily, t.warehouses)),
    f"SELECT p.warehouse_id, p.region, CAST(sum(units_demanded) AS BIGINT) AS total_units_demanded, CAST(sum(units_fulfilled) AS BIGINT) AS total_units_fulfilled, CAST(sum(units_lost_sales) AS BIGINT) AS total_units_lost_sales, {FILL} AS warehouse_fill_rate, {LOSS} AS warehouse_lost_sales_rate, max(p.inventory_value) AS avg_inventory_value, max(p.average_days_of_supply) AS avg_days_of_supply FROM daily d JOIN warehouse_prof p ON p.warehouse_id = d.warehouse_id GROUP BY p.warehouse_id, p.region",
)
register(
    "k08_quadrant_summary",
    lambda t: kpis.quadrant_summary(views.service_risk(t.daily), views.inventory_risk(t.daily)),
    f"""SELECT CASE WHEN fill_rate < 0.95 THEN CASE WHEN excess_inventory_day_rate >= 0.2 THEN 'Dual Failure: Low Service + Excess Inventory' ELSE 'Service Risk' END WHEN excess_inventory_day_rate >= 0.2 THEN 'Working Capital Risk' ELSE 'Balanced' END AS tradeoff_zone, count(*) AS sku_warehouse_count,
    avg(fill_rate) AS avg_fill_rate, avg(stockout_day_rate) AS avg_stockout_day_rate, avg(excess_inventory_day_rate) AS avg_excess_day_rate, {money('lost_sales_revenue')} AS total_lost_revenue, {money('avg_inventory_value')} AS total_avg_inventory_value
    FROM service_base s JOIN inventory_base i ON s.product_id = i.product_id AND s.warehouse_id = i.warehouse_id GROUP BY 1""",
)
register(
    "k09_top_risk_skus",
    lambda t: kpis.top_risk_skus(views.service_risk(t.daily), views.inventory_risk(t.daily)),
    """SELECT *, row_number() OVER (ORDER BY round(risk_score, 6) DESC, round(lost_sales_revenue, 2) DESC, product_id, warehouse_id) AS risk_rank FROM (SELECT s.product_id, s.warehouse_id, s.category, abc_class, fill_rate, stockout_day_rate, excess_inventory_day_rate, slow_moving_day_rate, avg_days_of_supply, lost_sales_revenue, avg_inventory_value,
    (CAST(0.4 AS DOUBLE) * stockout_day_rate + CAST(0.3 AS DOUBLE) * excess_inventory_day_rate + CAST(0.15 AS DOUBLE) * slow_moving_day_rate + CAST(0.1 AS DOUBLE) * (1 - fill_rate) + CAST(0.05 AS DOUBLE) * least(avg_days_of_supply / 60, 1)) * 100 AS risk_score
    FROM service_base s JOIN inventory_base i ON s.product_id = i.product_id AND s.warehouse_id = i.warehouse_id) QUALIFY risk_rank <= 25""",
)


def _curve(values: str, keys: str, total: str) -> str:
    order = f"ORDER BY round(avg_inventory_value, 6) DESC, {keys}"
    exact = "CAST(avg_inventory_value AS DECIMAL(18,6))"
    return f"""SELECT *, cumulative_inventory_value / nullif({total}, 0) AS cumulative_value_share FROM (SELECT *, row_number() OVER ({order}) AS value_rank, CAST(row_number() OVER ({order}) AS DOUBLE) / count(*) OVER () AS rank_percentile,
    CAST(sum({exact}) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumulative_inventory_value, CAST(sum({exact}) OVER () AS DOUBLE) AS {total} FROM ({values}))"""


register(
    "k10_working_capital_concentration",
    lambda t: kpis.capital_concentration(t.inventory_snapshots, t.products, t.product_classification),
    "SELECT * EXCLUDE (value_rank) FROM (" + _curve(f"SELECT i.product_id, category, abc_class, {mean_money('inventory_value')} AS avg_inventory_value FROM inventory_snapshots i JOIN products p ON p.product_id = i.product_id LEFT JOIN product_classification c ON c.product_id = i.product_id GROUP BY ALL", "product_id", "total_portfolio_value") + ") WHERE rank_percentile <= 0.2",
)
_VALUES = f"SELECT product_id, category, {mean_money('inventory_value')} AS avg_inventory_value FROM daily GROUP BY product_id, category"

# -- diagnostics ------------------------------------------------------------------------------------------------------

_T = ", ".join(f"CAST(sum({u}) AS BIGINT) AS total_{u}" for u in kpis.UNITS)
register("d01_service_health", lambda t: kpis.service_health(t.daily), f"SELECT {_T}, {money('lost_sales_revenue')} AS total_lost_sales_revenue, {money('service_gap_units')} AS total_service_gap_units, {FILL} AS overall_fill_rate, {LOSS} AS overall_stockout_rate FROM daily")
register("d02_monthly_service", lambda t: kpis.monthly_service(t.daily), f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, {U}, {LOST}, avg(days_of_supply) AS avg_days_of_supply, {rate('promo_flag = 1')} AS promo_mix_rate, {FILL} AS fill_rate, {LOSS} AS stockout_rate FROM daily GROUP BY 1")
_SERVICE = f"{U}, {LOST}, avg(fill_rate) AS avg_row_fill_rate, avg(stockout_flag) AS stockout_day_rate"
_STOCK = f"avg(days_of_supply) AS avg_days_of_supply, {mean_money('inventory_value')} AS avg_inventory_value"
register("d03_service_by_region", lambda t: kpis.service_by(t.daily, "region"), f"SELECT region, {_SERVICE}, {FILL} AS fill_rate, {LOSS} AS stockout_rate FROM daily GROUP BY region")
_WAREHOUSE = "SELECT warehouse_id, warehouse_name, region, warehouse_service_risk_proxy, fill_rate, stockout_rate, lost_sales_value, average_days_of_supply, inventory_value, capacity_pressure_proxy FROM warehouse_feat"
register("d04_service_by_warehouse", lambda t: kpis.warehouse_columns(warehouses(t)), _WAREHOUSE)
register("d05_service_by_category", lambda t: kpis.service_by(t.daily, "category", stock=True), f"SELECT category, {_SERVICE}, {_STOCK}, {FILL} AS fill_rate, {LOSS} AS stockout_rate FROM daily GROUP BY category")
register(
    "d06_inventory_efficiency",
    lambda t: kpis.inventory_efficiency(t.daily),
    f"SELECT avg(days_of_supply) AS avg_days_of_supply, quantile_cont(days_of_supply, 0.5) AS median_days_of_supply, quantile_cont(days_of_supply, 0.9) AS p90_days_of_supply, quantile_cont(days_of_supply, 0.99) AS p99_days_of_supply, {mean_money('inventory_value')} AS avg_inventory_value, quantile_cont(inventory_value, 0.95) AS p95_inventory_value, {rate(f'days_of_supply > {CAP}')} AS excess_inventory_day_rate, {rate(SLOW)} AS slow_moving_day_rate FROM daily",
)
_BUCKET = "CASE WHEN days_of_supply < 5 THEN '00_<5' WHEN days_of_supply < 10 THEN '01_5_to_10' WHEN days_of_supply < 20 THEN '02_10_to_20' WHEN days_of_supply < 35 THEN '03_20_to_35' WHEN days_of_supply < 50 THEN '04_35_to_50' ELSE '05_50_plus' END"
register("d07_days_of_supply_histogram", lambda t: kpis.days_of_supply_histogram(t.daily), f"SELECT {_BUCKET} AS dos_bucket, count(*) AS row_count, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM daily) AS row_share, avg(days_of_supply) AS avg_dos_in_bucket FROM daily GROUP BY 1")
register("d08_value_concentration", lambda t: kpis.value_concentration(t.daily), _curve(_VALUES, "product_id, category", "total_inventory_value"))
register("d09_excess_exposure", lambda t: kpis.excess_exposure(t.daily), f"SELECT category, {rate(f'days_of_supply > {CAP}')} AS excess_inventory_day_rate, {rate(SLOW)} AS slow_moving_day_rate, {mean_money('inventory_value')} AS avg_inventory_value, {money(f'CASE WHEN days_of_supply > {CAP} THEN inventory_value ELSE 0 END')} AS excess_inventory_value_proxy FROM daily GROUP BY category")
_LEVEL = "CAST(sum(units_demanded) AS BIGINT) AS units_demanded, CAST(sum(units_lost_sales) AS BIGINT) AS units_lost_sales, " + f"{LOSS} AS stockout_rate, {LOST}"
register("d10_stockout_levels", lambda t: kpis.stockout_levels(t.daily), " UNION ALL ".join(f"SELECT '{n}' AS level, {k} AS segment, {_LEVEL} FROM daily GROUP BY {k}" for n, k in (("warehouse", "warehouse_id"), ("region", "region"), ("category", "category"))))
register(
    "d11_stockout_patterns",
    lambda t: kpis.stockout_patterns(t.daily),
    """SELECT CASE WHEN r >= 0.08 THEN CASE WHEN m >= 0.5 THEN 'Systematic' ELSE 'Episodic High-Intensity' END WHEN m >= 0.35 THEN 'Frequent Low-Intensity' ELSE 'Low/Contained' END AS stockout_pattern, count(*) AS sku_warehouse_count, avg(r) AS avg_stockout_rate, avg(m) AS avg_active_month_ratio
    FROM (SELECT product_id, warehouse_id, CASE WHEN sum(d) = 0 THEN 0 ELSE CAST(sum(l) AS DOUBLE) / nullif(sum(d), 0) END AS r, avg(CASE WHEN l > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS m FROM (SELECT product_id, warehouse_id, date_trunc('month', date) AS mo, sum(units_demanded) AS d, sum(units_lost_sales) AS l FROM daily GROUP BY ALL) GROUP BY ALL) GROUP BY 1""",
)
register("d12_top_lost_sales", lambda t: kpis.top_lost_sales(t.daily), f"SELECT * FROM (SELECT product_id, warehouse_id, region, category, CAST(sum(units_demanded) AS BIGINT) AS units_demanded, CAST(sum(units_lost_sales) AS BIGINT) AS units_lost_sales, {LOSS} AS stockout_rate, {LOST} FROM daily GROUP BY product_id, warehouse_id, region, category) ORDER BY round(lost_sales_revenue, 2) DESC, product_id, warehouse_id LIMIT 50")
_DOWN = f"(SELECT supplier_id, CAST(sum(units_demanded) AS BIGINT) AS units_demanded, CAST(sum(units_lost_sales) AS BIGINT) AS units_lost_sales, {LOSS} AS downstream_stockout_rate, {FILL} AS downstream_fill_rate, {money('lost_sales_revenue')} AS downstream_lost_sales_revenue FROM daily GROUP BY supplier_id)"
register("d13_supplier_downstream", lambda t: kpis.supplier_downstream(suppliers(t), t.daily), f"SELECT s.*, d.* EXCLUDE (supplier_id) FROM supplier_feat s LEFT JOIN {_DOWN} d ON d.supplier_id = s.supplier_id")
_PAIRS = f"(SELECT product_id, warehouse_id, category, abc_class, supplier_id, {FILL} AS fill_rate, {LOSS} AS stockout_rate, {_STOCK}, {LOST}, {CAP} AS dos_cap FROM daily GROUP BY product_id, warehouse_id, category, abc_class, supplier_id)"
_OVER, _UNDER, _HEAVY = "avg_days_of_supply > dos_cap AND fill_rate < 0.95", "avg_days_of_supply <= 8 AND stockout_rate >= 0.08", "avg_days_of_supply > dos_cap AND fill_rate >= 0.97"
_ZONES = f"SELECT CASE WHEN {_OVER} THEN 'Overstocked and Under-Serving' WHEN {_UNDER} THEN 'Understocked Revenue Exposure' WHEN fill_rate >= 0.97 AND avg_days_of_supply BETWEEN 8 AND dos_cap THEN 'Balanced Efficient' WHEN {_HEAVY} THEN 'Service Protected but Capital Heavy' ELSE 'Transitional / Monitor' END AS tradeoff_zone, count(*) AS sku_warehouse_count, avg(fill_rate) AS avg_fill_rate, avg(stockout_rate) AS avg_stockout_rate, avg(avg_days_of_supply) AS avg_days_of_supply, {money('lost_sales_revenue')} AS total_lost_sales_revenue, {money('avg_inventory_value')} AS total_avg_inventory_value FROM {_PAIRS} GROUP BY 1"
register("d14_tradeoff_zones", lambda t: kpis.tradeoff_zones(t.daily), _ZONES)
register("d15_unbalanced_skus", lambda t: kpis.unbalanced(t.daily), f"SELECT *, CASE WHEN {_OVER} THEN 'Overstocked and Under-Serving' WHEN {_UNDER} THEN 'Understocked Revenue Exposure' ELSE 'Service Protected but Capital Heavy' END AS imbalance_type FROM {_PAIRS} WHERE ({_OVER}) OR ({_UNDER}) OR ({_HEAVY}) ORDER BY round(lost_sales_revenue, 2) DESC, round(avg_inventory_value, 2) DESC, product_id, warehouse_id LIMIT 80")
_MEANS = f"(SELECT product_id, warehouse_id, {LOST}, {_STOCK}, avg(fill_rate) AS avg_fill_rate FROM daily GROUP BY product_id, warehouse_id)"
register("d16_action_skus", lambda t: kpis.action_skus(skus(t), t.daily), f"SELECT s.product_id, s.warehouse_id, supplier_id, governance_priority_score, risk_tier, main_risk_driver, recommended_action, i.lost_sales_revenue, i.avg_inventory_value, i.avg_days_of_supply, i.avg_fill_rate FROM sku_risk s LEFT JOIN {_MEANS} i ON i.product_id = s.product_id AND i.warehouse_id = s.warehouse_id ORDER BY round(governance_priority_score, 6) DESC, round(i.lost_sales_revenue, 2) DESC, s.product_id, s.warehouse_id LIMIT 40")
register("d17_action_warehouses", lambda t: kpis.warehouse_columns(warehouses(t)), _WAREHOUSE)
register("d18_action_suppliers", lambda t: kpis.action_suppliers(suppliers(t), t.daily), f"SELECT s.*, downstream_lost_sales_revenue, downstream_stockout_rate FROM supplier_feat s LEFT JOIN {_DOWN} d ON d.supplier_id = s.supplier_id")
_SEGMENTS = f"""SELECT s.category, s.region, count(*) AS sku_warehouse_count, avg(governance_priority_score) AS avg_governance_priority_score, count(*) FILTER (WHERE risk_tier IN ('High', 'Critical')) AS high_or_critical_count, {money('i.lost_sales_revenue')} AS total_lost_sales_revenue,
    {money('i.avg_inventory_value')} AS total_avg_inventory_value, {rate("main_risk_driver = 'Service Risk'")} AS service_risk_driver_share, {rate("main_risk_driver = 'Excess Inventory'")} AS excess_inventory_driver_share, {rate("main_risk_driver = 'Supplier Risk'")} AS supplier_risk_driver_share
    FROM sku_risk s LEFT JOIN {_MEANS} i ON i.product_id = s.product_id AND i.warehouse_id = s.warehouse_id GROUP BY s.category, s.region"""
register("d19_action_segments", lambda t: kpis.action_segments(skus(t), t.daily, t.products, t.warehouses), _SEGMENTS)


def _headline(t: Tables) -> DataFrame:
    zones = kpis.tradeoff_zones(t.daily)
    sku = skus(t)
    return kpis.headline(
        kpis.service_by(t.daily, "region"), warehouses(t), kpis.service_by(t.daily, "category", stock=True), kpis.value_concentration(t.daily), kpis.stockout_patterns(t.daily), zones, suppliers(t), sku, kpis.excess_exposure(t.daily), kpis.action_segments(sku, t.daily, t.products, t.warehouses)
    )


_best = lambda df, name, by, f="max": f"(SELECT {f}(struct_pack(v := round({by}, 6), n := {name})).n FROM ({df}))"
_count = lambda key, value, df: f"coalesce((SELECT max(sku_warehouse_count) FROM ({df}) WHERE {key} = '{value}'), 0)"


def _register_headline() -> None:
    region, category = f"SELECT region, {FILL} AS fill_rate FROM daily GROUP BY region", f"SELECT category, {money('lost_sales_revenue')} AS lost FROM daily GROUP BY category"
    patterns = """SELECT count(*) FILTER (WHERE r >= 0.08 AND m >= 0.5) AS n FROM (SELECT product_id, warehouse_id, CASE WHEN sum(d) = 0 THEN 0 ELSE CAST(sum(l) AS DOUBLE) / nullif(sum(d), 0) END AS r, avg(CASE WHEN l > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS m FROM (SELECT product_id, warehouse_id, date_trunc('month', date) AS mo, sum(units_demanded) AS d, sum(units_lost_sales) AS l FROM daily GROUP BY ALL) GROUP BY ALL)"""
    curve = _curve(_VALUES, "product_id, category", "total_inventory_value")
    excess = f"SELECT category, {money(f'CASE WHEN days_of_supply > {CAP} THEN inventory_value ELSE 0 END')} AS x FROM daily GROUP BY category"
    register(
        "d20_headline_facts",
        _headline,
        f"""SELECT {_best(region, 'region', 'fill_rate')} AS best_region, {_best(region, 'region', 'fill_rate', 'min')} AS worst_region, {_best('FROM warehouse_feat', 'warehouse_id', 'warehouse_service_risk_proxy')} AS worst_warehouse, {_best(category, 'category', 'lost')} AS worst_category,
        (SELECT {money('CASE WHEN rank_percentile <= 0.2 THEN avg_inventory_value ELSE 0 END')} / greatest({money('avg_inventory_value')}, 1) FROM ({curve})) AS top_20_value_share, ({patterns}) AS systematic_count, {_count('tradeoff_zone', 'Overstocked and Under-Serving', _ZONES)} AS dual_failure_count,
        {_count('tradeoff_zone', 'Balanced Efficient', _ZONES)} AS balanced_count, coalesce((SELECT max(total_lost_sales_revenue) FROM ({_ZONES}) WHERE tradeoff_zone = 'Overstocked and Under-Serving'), 0) AS dual_failure_lost_sales, {_best('FROM supplier_feat', 'supplier_id', 'supplier_service_risk_proxy')} AS top_supplier,
        {_best('FROM sku_risk', 'product_id', 'governance_priority_score')} AS top_sku, {_best(excess, 'category', 'x')} AS inventory_heavy_category, {_best(_SEGMENTS, 'category', 'avg_governance_priority_score')} AS top_segment_category""",
    )


_register_headline()
