"""Registration of chart data, the monthly fact and its slices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from shelfspark.operators import facts, kpis
from shelfspark.operators.registered import FILL, LOSS, LOST, U, amounts, skus, suppliers, warehouses
from shelfspark.oracles.base import PARTS, dbl, mean_money, money, part
from shelfspark.plans import impact
from shelfspark.registry import ORACLES, PLANS, register
from shelfspark.sources.fixtures import Tables

U2 = "CAST(sum(units_demanded) AS BIGINT) AS units_demanded, CAST(sum(units_fulfilled) AS BIGINT) AS units_fulfilled"
register("vz01_monthly_trend", lambda t: facts.trend(t.daily), f"SELECT CAST(date_trunc('month', date) AS DATE) AS month, {U}, {LOST}, {FILL} AS fill_rate, {LOSS} AS stockout_rate FROM daily GROUP BY 1")
register("vz02_fill_rate_by_category", lambda t: facts.fill_by_category(t.daily), f"SELECT category, {U2}, {FILL} AS fill_rate FROM daily GROUP BY category")
register("vz03_lost_sales_by_region", lambda t: facts.lost_by_region(t.daily), f"SELECT region, {LOST} FROM daily GROUP BY region")
_TOTAL = "CAST(total_inventory_value AS DECIMAL(24,6))"
register(
    "vz04_category_inventory_share",
    lambda t: facts.category_shares(t.daily),
    f"""SELECT *, total_inventory_value / CAST(sum({_TOTAL}) OVER () AS DOUBLE) AS inventory_share, CAST(sum({_TOTAL}) OVER (ORDER BY total_inventory_value DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(sum({_TOTAL}) OVER () AS DOUBLE) AS cumulative_share
    FROM (SELECT category, {mean_money('inventory_value')} AS avg_inventory_value, {money('inventory_value')} AS total_inventory_value FROM daily GROUP BY category)""",
)
register("vz05_category_region_scatter", lambda t: facts.category_region(t.daily), f"SELECT category, region, {U2}, {mean_money('inventory_value')} AS avg_inventory_value, {LOST}, {FILL} AS fill_rate FROM daily GROUP BY category, region")
register("vz06_sku_ranking", lambda t: facts.sku_ranking(skus(t), t.products), "SELECT s.product_id, warehouse_id, product_name, s.product_id || ' | ' || warehouse_id AS sku_label, governance_priority_score, risk_tier, main_risk_driver FROM sku_risk s LEFT JOIN products p ON p.product_id = s.product_id")
register("vz07_excess_exposure", lambda t: facts.excess_by_category(skus(t)), "SELECT *, excess_inventory_value_proxy * round(avg_excess_rate, 9) AS excess_exposure_proxy FROM (SELECT category, CAST(sum(CAST(inventory_value_sum AS DECIMAL(24,6))) AS DOUBLE) AS excess_inventory_value_proxy, avg(excess_day_rate) AS avg_excess_rate FROM sku_risk GROUP BY category)")
register(
    "vz08_top_slow_moving",
    lambda t: facts.top_slow_moving(skus(t)),
    f"SELECT *, product_id || ' | ' || warehouse_id AS sku_label FROM (SELECT product_id, warehouse_id, {money('inventory_value_sum * slow_moving_rate')} AS slow_moving_value_proxy, avg(slow_moving_rate) AS slow_moving_rate FROM sku_risk GROUP BY product_id, warehouse_id) ORDER BY round(slow_moving_value_proxy, 2) DESC, product_id, warehouse_id LIMIT 15",
)
_heat = lambda floor, rows: f"SELECT supplier_id, supplier_name, 1 - on_time_delivery_rate AS otd_gap, average_delay_days / greatest(max(average_delay_days) OVER (), {dbl(floor)}) AS avg_delay_norm, lead_time_variability / greatest(max(lead_time_variability) OVER (), {dbl(floor)}) AS lt_variability_norm, supplier_service_risk_proxy / greatest(max(supplier_service_risk_proxy) OVER (), {dbl(floor)}) AS risk_proxy_norm FROM {rows}"
register("vz09_supplier_heatmap", lambda t: facts.supplier_heat(suppliers(t), 1e-9), _heat(1e-9, "supplier_feat"))
_WIDTH = "((SELECT max(days_of_supply) - min(days_of_supply) FROM daily) / 60)"
register(
    "vz10_days_of_supply_bins",
    lambda t: facts.days_histogram(t.daily),
    f"""SELECT bin, (SELECT min(days_of_supply) FROM daily) + bin * {_WIDTH} AS bin_start, days, (SELECT quantile_cont(days_of_supply, 0.9) FROM daily) AS p90, (SELECT quantile_cont(days_of_supply, 0.99) FROM daily) AS p99
    FROM (SELECT CAST(coalesce(least(floor((days_of_supply - (SELECT min(days_of_supply) FROM daily)) / nullif({_WIDTH}, 0)), 59), 0) AS BIGINT) AS bin, count(*) AS days FROM daily GROUP BY 1)""",
)
register("vz11_warehouse_quadrant", lambda t: facts.quadrant(warehouses(t), "warehouse_id", "fill_rate", "inventory_value"), "SELECT warehouse_id, fill_rate, inventory_value, median(fill_rate) OVER () AS fill_line, median(inventory_value) OVER () AS value_line FROM warehouse_feat")

# -- monthly fact -----------------------------------------------------------------------------------------------------

part("proxies", "SELECT date, region, warehouse_id, product_id, category, supplier_id, abc_class, units_demanded, units_fulfilled, units_lost_sales, lost_sales_revenue, inventory_value, days_of_supply, excess_inventory_value_proxy AS excess_inventory_proxy, slow_moving_value_proxy AS slow_moving_proxy, trapped_working_capital_proxy AS trapped_wc_proxy, lost_sales_margin_proxy FROM valued")
_cents = ", ".join(f"CAST(round(sum(CAST({x} AS DECIMAL(18,6))), 2) AS DOUBLE) AS {x}" for x in facts._CENTS)
part("month_fact", f"SELECT *, CAST(units_lost_sales > 0 AS INTEGER) AS stockout_month_flag FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, region, warehouse_id, product_id, category, supplier_id, abc_class, {U}, {_cents}, CAST(round(CAST(avg(days_of_supply) AS DECIMAL(18,6)), 2) AS DOUBLE) AS avg_days_of_supply, count(DISTINCT date) AS observation_days FROM proxies GROUP BY 1, 2, 3, 4, 5, 6, 7)")
#: The slice that the registered queries show: two years, given from the later to the earlier month.
SHOWN = facts.Slice({"region": "ALL"}, (date(1997, 12, 1), date(1996, 1, 1)))
part("shown", "SELECT * FROM month_fact WHERE month BETWEEN DATE '1996-01-01' AND DATE '1997-12-01'")


def fact(t: Tables) -> DataFrame:
    return t.bucket("monthly fact", lambda: facts.monthly_fact(facts.daily_proxies(amounts(t))))


class AllMonths:
    """Tables of which the slices show every month, from the data's first to its last."""

    def __init__(self, t: Tables):
        self._tables = t

    def __getattr__(self, name: str) -> object:
        return getattr(self._tables, name)


def shown(t: Tables | AllMonths) -> DataFrame:
    return fact(t) if isinstance(t, AllMonths) else SHOWN.of(fact(t))


def cube(t: Tables | AllMonths) -> DataFrame:
    """The facet cube, written once by cuboid: for slices by facets not known before. It is many times the fact where suppliers are many."""
    return t.write("facet cube", lambda: facts.facet_cube(fact(t)), "cuboid")


def shown_cells(t: Tables | AllMonths, *keys: str) -> DataFrame:
    """Cells of the slice shown, of the smallest roll-up that has ``keys``; only that roll-up is made, once."""
    columns = facts.smallest({*keys, *SHOWN.dimensions()})
    found = t.write(f"cells by {', '.join(columns)}", lambda: facts.roll_up(fact(t), columns))
    return found if isinstance(t, AllMonths) else SHOWN.of(found)


register("db01_daily_proxies", lambda t: facts.daily_proxies(amounts(t)), "SELECT * FROM proxies")
register("db02_monthly_sku_fact", fact, "SELECT * FROM month_fact")
_SCORES = ["service_risk_score", "stockout_risk_score", "excess_inventory_score", "supplier_risk_score", "working_capital_risk_score", "governance_priority_score"]
_EXTRACT = f"SELECT product_id, warehouse_id, supplier_id, {', '.join(f'round({c} + 1e-10, 4) AS {c}' for c in _SCORES)}, risk_tier, main_risk_driver, recommended_action FROM sku_risk"
register("db03_sku_risk_extract", lambda t: facts.risk_extract(skus(t)), _EXTRACT)
register(
    "db04_official_snapshot",
    lambda t: facts.snapshot(kpis.service_health(t.daily), impact.overall(amounts(t), days=t.daily)),
    f"""SELECT {FILL} AS overall_fill_rate, {LOSS} AS overall_stockout_rate, {money('lost_sales_revenue')} AS total_lost_sales_revenue, {money('trapped_working_capital_proxy')} AS trapped_working_capital_proxy_observed,
    {money('lost_sales_margin_proxy')} * max(factor) * {dbl(0.35)} + {money('trapped_working_capital_proxy')} * max(factor) * {dbl(0.25)} AS opportunity_total_12m_proxy FROM valued, annual""",
)
_FACETS = " UNION ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value FROM month_fact WHERE {d} IS NOT NULL AND CAST({d} AS VARCHAR) <> ''" for d in facts.DIMENSIONS)
register("db05_dimension_codes", lambda t: facts.dictionary(fact(t)), f"SELECT dimension, value, row_number() OVER (PARTITION BY dimension ORDER BY value) - 1 AS code FROM ({_FACETS})")
_PRINT = [*facts.DIMENSIONS, *kpis.UNITS, "observation_days", "stockout_month_flag"]
register("db06_fact_fingerprint", lambda t: facts.fingerprint(fact(t), _PRINT), f"SELECT count(*) AS rows, bit_xor(h) AS hash_xor, CAST(sum(h) AS VARCHAR) AS hash_sum FROM (SELECT CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'coalesce(CAST({c} AS VARCHAR), chr(32)[2:])' for c in _PRINT)})), 1, 12) AS BIGINT) AS h FROM month_fact)".replace("chr(32)[2:]", "''"))
register("db07_facet_values", lambda t: facts.facet_values(fact(t)), _FACETS)
register("db08_fact_slice", lambda t: facts.Slice({"region": "ASIA", "abc_class": "A", "category": "ALL"}, SHOWN.months).of(fact(t)), "SELECT * FROM shown WHERE region = 'ASIA' AND abc_class = 'A'")
S = "CAST(sum(units_demanded) AS BIGINT) AS demand, CAST(sum(units_fulfilled) AS BIGINT) AS fulfilled, CAST(sum(units_lost_sales) AS BIGINT) AS lost"
B = f"{money('lost_sales_revenue')} AS lost_sales, {money('inventory_value')} AS inventory"
E = f"{money('excess_inventory_proxy')} AS excess, {money('trapped_wc_proxy')} AS trapped"
R = f"{FILL} AS fill_rate, {LOSS} AS stockout_rate"
W = f"{money('avg_days_of_supply * observation_days')} / nullif(sum(observation_days), 0) AS avg_dos"
_SCENARIO = f"excess_inventory_proxy + {dbl(0.5)} * greatest(slow_moving_proxy - excess_inventory_proxy, 0)"
part("s_totals", f"SELECT {S}, {B}, {E}, {money(_SCENARIO)} AS trapped_scenario, {money('slow_moving_proxy')} AS slow, {money('lost_sales_margin_proxy')} AS lost_margin, {R}, {money('lost_sales_margin_proxy')} * {dbl(0.35)} + {money(_SCENARIO)} * {dbl(0.25)} AS scenario_opportunity_12m FROM shown")
part("s_warehouse", f"SELECT s.*, warehouse_name FROM (SELECT warehouse_id, region, {S}, {B}, {W}, {R} FROM shown GROUP BY warehouse_id, region) s LEFT JOIN warehouses w ON w.warehouse_id = s.warehouse_id")
part("s_category", f"SELECT category, {S}, {B}, {E}, {W}, {R} FROM shown GROUP BY category")
part("s_region", f"SELECT region, {S}, {B}, {R} FROM shown GROUP BY region")
part("s_supplier", f"SELECT s.*, supplier_name, on_time_delivery_rate, average_delay_days, lead_time_variability, supplier_service_risk_proxy FROM (SELECT supplier_id, {S}, {B}, {R} FROM shown GROUP BY supplier_id) s LEFT JOIN supplier_feat f ON f.supplier_id = s.supplier_id")
part("s_segment", f"SELECT category, region, category || '|' || region AS segment, {S}, {B}, {W}, {R} FROM shown GROUP BY category, region")
part("s_extract", _EXTRACT)
part(
    "s_sku",
    f"""SELECT s.*, product_name, {', '.join(_SCORES)}, risk_tier, main_risk_driver, recommended_action FROM (SELECT product_id, warehouse_id, supplier_id, category, region, abc_class, {S}, {B}, {E}, {W}, {R}, avg(CAST(stockout_month_flag AS DOUBLE)) AS stockout_persistence FROM shown GROUP BY 1, 2, 3, 4, 5, 6) s
    LEFT JOIN s_extract x ON x.product_id = s.product_id AND x.warehouse_id = s.warehouse_id AND x.supplier_id = s.supplier_id LEFT JOIN products p ON p.product_id = s.product_id""",
)


def s_warehouse(t: Tables) -> DataFrame:
    return facts.by_warehouse(shown_cells(t, "warehouse_id", "region"), t.warehouses)


def s_supplier(t: Tables) -> DataFrame:
    return facts.by_supplier(shown_cells(t, "supplier_id"), suppliers(t))


def s_sku(t: Tables) -> DataFrame:
    return facts.by_sku(shown(t), skus(t), t.products)


register("db09_slice_totals", lambda t: facts.slice_totals(shown_cells(t)), "SELECT * FROM s_totals")
register("db10_slice_by_month", lambda t: facts.by_month(shown_cells(t)), f"SELECT month, {S}, {B}, {R} FROM shown GROUP BY month")
register("db11_slice_by_warehouse", s_warehouse, "SELECT * FROM s_warehouse")
register("db12_slice_by_category", lambda t: facts.by_category(shown_cells(t, "category")), "SELECT * FROM s_category")
register("db13_slice_by_region", lambda t: facts.by_region(shown_cells(t, "region")), "SELECT * FROM s_region")
register("db14_slice_by_supplier", s_supplier, "SELECT * FROM s_supplier")
register("db15_slice_by_segment", lambda t: facts.by_segment(shown_cells(t, "category", "region")), "SELECT * FROM s_segment")
register("db16_slice_by_sku", s_sku, "SELECT * FROM s_sku")
part("s_otd", "SELECT sum(on_time_delivery_rate * demand) / greatest(sum(demand), 1) AS weighted_supplier_otd FROM s_supplier")
register("db17_weighted_supplier_otd", lambda t: facts.weighted_otd(s_supplier(t)), "SELECT * FROM s_otd")
register(
    "db18_posture",
    lambda t: facts.posture(facts.slice_totals(shown_cells(t)), s_sku(t)),
    "SELECT b AS balanced_share, CASE WHEN fill_rate < 0.95 AND b < 0.35 THEN 'critical' WHEN stockout_rate > 0.05 OR excess > inventory * 0.18 THEN 'watch' ELSE 'stable' END AS posture FROM s_totals, (SELECT CAST(count(*) FILTER (WHERE fill_rate >= 0.97 AND avg_dos BETWEEN 8 AND 35) AS DOUBLE) / greatest(count(*), 1) AS b FROM s_sku)",
)
_pick = lambda rows, name, by: f"(SELECT {name} FROM {rows} ORDER BY {by}, 1 LIMIT 1)"
_desc = lambda x: f"-round({x} + 1e-10, 6)"
_asc = lambda x: f"round({x} + 1e-10, 6)"
_SKU_NAME = "product_id || ' @ ' || warehouse_id"
_TOP_SKU, _BY_EXPOSURE = _pick("s_sku", _SKU_NAME, _desc("governance_priority_score")), _pick("s_supplier", "supplier_id", _desc("stockout_rate * lost_sales"))
_BY_FILL, _BY_EXCESS = _pick("s_warehouse", "warehouse_id", _asc("fill_rate")), _pick("s_category", "category", _desc("excess"))
_rows = lambda label, pairs: " UNION ALL ".join(f"SELECT {i} AS place, '{n}' AS {label}, {p} AS pick" for i, (n, p) in enumerate(pairs, 1))
register(
    "db19_callouts",
    lambda t: facts.callouts(s_sku(t), s_supplier(t), s_warehouse(t), facts.by_category(shown_cells(t, "category")), facts.by_segment(shown_cells(t, "category", "region"))),
    _rows("eyebrow", [("Priority 1", _TOP_SKU), ("Supplier escalation", _BY_EXPOSURE), ("Warehouse pressure", _BY_FILL), ("Capital concentration", _BY_EXCESS)]),
)
_three = lambda good, fair: f"CASE WHEN {good} THEN 'positive' WHEN {fair} THEN 'watch' ELSE 'critical' END"
_TILES = [
    ("Fill Rate", "fill_rate", _three("fill_rate >= 0.97", "fill_rate >= 0.95")), ("Stockout Rate", "stockout_rate", _three("stockout_rate <= 0.02", "stockout_rate <= 0.05")), ("Lost Sales Value", "lost_sales", "CASE WHEN lost_sales <= 500000 THEN 'neutral' ELSE 'critical' END"),
    ("12M Opportunity", "scenario_opportunity_12m", "'positive'"), ("Working Capital at Risk", "trapped", "CASE WHEN trapped <= inventory * 0.12 THEN 'neutral' ELSE 'watch' END"), ("Excess Inventory", "excess", "CASE WHEN excess <= inventory * 0.08 THEN 'positive' ELSE 'watch' END"),
    ("Supplier OTD", "weighted_supplier_otd", _three("weighted_supplier_otd >= 0.92", "weighted_supplier_otd >= 0.88")), ("High-Risk SKU Count", "CAST(risky AS DOUBLE)", _three("risky <= 20", "risky <= 50")),
]
register(
    "db20_kpi_tiles",
    lambda t: facts.tiles(facts.slice_totals(shown_cells(t)), s_sku(t), facts.weighted_otd(s_supplier(t))),
    " UNION ALL ".join(f"SELECT '{n}' AS label, {v} AS value, {tone} AS tone FROM s_totals, s_otd, (SELECT count(*) FILTER (WHERE risk_tier IN ('High', 'Critical')) AS risky FROM s_sku)" for n, v, tone in _TILES),
)
register("db21_top_supplier_heatmap", lambda t: facts.supplier_heat(s_supplier(t), 1.0, 10), _heat(1.0, "(SELECT * FROM s_supplier ORDER BY round(supplier_service_risk_proxy, 6) DESC, supplier_id LIMIT 10)"))
register("db22_warehouse_quadrant_means", lambda t: facts.quadrant(s_warehouse(t), "warehouse_id", "fill_rate", "inventory", "mean"), "SELECT warehouse_id, fill_rate, inventory, avg(fill_rate) OVER () AS fill_line, avg(inventory) OVER () AS value_line FROM s_warehouse")
register(
    "db23_detail_table",
    lambda t: facts.detail(s_sku(t), "Supplier R", "governance_priority_score"),
    "SELECT * FROM s_sku WHERE contains(lower(concat_ws(' ', product_id, product_name, warehouse_id, supplier_id, main_risk_driver, recommended_action)), 'supplier r') ORDER BY round(governance_priority_score, 6) DESC, product_id, warehouse_id, supplier_id LIMIT 250",
)
register(
    "db24_slice_reconciliation",
    lambda t: facts.reconciled(facts.snapshot(kpis.service_health(t.daily), impact.overall(amounts(t), days=t.daily)), facts.slice_totals(fact(t))),
    f"""SELECT fill_diff, stockout_diff, lost_diff, fill_diff > 0.0005 OR stockout_diff > 0.0005 OR lost_diff > 1 AS mismatch FROM (SELECT abs(a.f - b.f) AS fill_diff, abs(a.s - b.s) AS stockout_diff, abs(a.l - b.l) AS lost_diff FROM (SELECT {FILL} AS f, {LOSS} AS s, {money('lost_sales_revenue')} AS l FROM daily) a,
    (SELECT {FILL} AS f, {LOSS} AS s, {money('lost_sales_revenue')} AS l FROM month_fact) b)""",
)
register(
    "db25_narrative_picks",
    lambda t: facts.narrative(s_sku(t), s_supplier(t), s_warehouse(t), facts.by_category(shown_cells(t, "category"))),
    _rows("fact", [("top_sku", _TOP_SKU), ("supplier_by_exposure", _BY_EXPOSURE), ("supplier_by_stockout", _pick("s_supplier", "supplier_id", _desc("stockout_rate"))), ("warehouse_by_lost_sales", _pick("s_warehouse", "warehouse_id", _desc("lost_sales"))), ("warehouse_by_fill", _BY_FILL), ("category_by_excess", _BY_EXCESS)]),
)
_list = lambda name, rows, ident, by, n=None: f"SELECT '{name}' AS list, row_number() OVER (ORDER BY {by}, {ident}) AS place, {ident} AS id FROM {rows}" + (f" QUALIFY place <= {n}" if n else "")
register(
    "db26_ranked_lists",
    lambda t: facts.ranked_lists(s_warehouse(t), facts.by_category(shown_cells(t, "category")), facts.by_region(shown_cells(t, "region")), s_supplier(t), s_sku(t)),
    " UNION ALL ".join(
        f"SELECT * FROM ({x})"
        for x in (
            _list("warehouses_by_fill", "s_warehouse", "warehouse_id", _asc("fill_rate")), _list("categories_by_fill", "s_category", "category", _asc("fill_rate")), _list("regions_by_lost_sales", "s_region", "region", _desc("lost_sales")), _list("suppliers_by_otd", "s_supplier", "supplier_id", _asc("on_time_delivery_rate")),
            _list("suppliers_by_variability", "s_supplier", "supplier_id", _desc("lead_time_variability")), _list("suppliers_by_stockout", "s_supplier", "supplier_id", _desc("stockout_rate"), 12), _list("warehouses_by_stockout", "s_warehouse", "warehouse_id", _desc("stockout_rate"), 12),
            _list("skus_by_priority", "s_sku", f"({_SKU_NAME})", _desc("governance_priority_score"), 15),
        )
    ),
)
register("db27_empty_slice", lambda t: facts.is_empty(facts.Slice({"region": "ATLANTIS"}).of(fact(t))), "SELECT count(*) = 0 AS is_empty FROM month_fact WHERE region = 'ATLANTIS'")


def _over_all_months(name: str) -> None:
    """The slice query ``name`` once more, over the whole monthly fact; its oracle lacks the filter by month."""
    plan = PLANS[name]
    register(f"{name}_all_months", lambda t: plan(AllMonths(t)))
    ORACLES[f"{name}_all_months"] = ORACLES[name].replace(f"shown AS ({PARTS['shown']})", "shown AS (SELECT * FROM month_fact)")


for _name in [n for n in PLANS if "db09" <= n[:4] <= "db26" and n[:4] != "db24"]:
    _over_all_months(_name)
