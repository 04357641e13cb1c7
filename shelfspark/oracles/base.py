"""Named parts of the oracle SQL and a way to put together those that a query needs."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}


def money(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,6))) AS DOUBLE)"


def mean_money(x: str) -> str:
    return f"({money(x)} / nullif(count({x}), 0))"


def div(a: str, b: str, zero: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN {zero} ELSE CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) END)"


def rate(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN CAST(1 AS DOUBLE) ELSE 0 END)"


def unit(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def linear(x: str, good: float, bad: float) -> str:
    return f"least(greatest(({x} - {dbl(good)}) / {dbl(bad - good)} * 100, 0), 100)"


def log_share(x: str, low: float, high: float) -> str:
    ln = lambda v: f"ln({v} + {dbl(1e-12)})"
    return f"least(greatest(({ln(f'greatest({x}, 0)')} - {ln(dbl(low))}) / ({ln(dbl(high))} - {ln(dbl(low))}) * 100, 0), 100)"


CAP = "(CASE abc_class WHEN 'A' THEN CAST(20 AS DOUBLE) WHEN 'B' THEN 30 ELSE 45 END)"
SLOW = "(available_units > 0 AND units_fulfilled = 0)"
TIER = "CASE WHEN {0} IS NULL OR {0} <= -0.001 THEN 'nan' WHEN {0} <= 35 THEN 'Low' WHEN {0} <= 55 THEN 'Medium' WHEN {0} <= 75 THEN 'High' WHEN {0} <= 1000 THEN 'Critical' ELSE 'nan' END"


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def query(select: str) -> str:
    """``select`` behind the parts it names, and those that they name."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(PARTS[name])
                if name not in needed:
                    needed.append(name)

    visit(select)
    return ("WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in needed) + "\n" if needed else "") + select


ABC = "CASE WHEN p_partkey % 10 < 2 THEN 'A' WHEN p_partkey % 10 < 5 THEN 'B' ELSE 'C' END"
part("x_places", "SELECT n_nationkey, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
part("x_bounds", "SELECT min(s_suppkey) AS first, count(*) AS n FROM supplier")
part(
    "products",
    f"""SELECT 'SKU-' || p_partkey AS product_id, p_name AS product_name, p_type AS category, p_retailprice * ({dbl(0.4)} + CAST(p_partkey % 5 AS DOUBLE) * {dbl(0.05)}) AS unit_cost, p_retailprice AS unit_price,
    CAST(30 * p_size AS BIGINT) AS shelf_life_days, 'SUP-' || (first + p_partkey % n) AS supplier_id, CAST(3 + p_size % 25 AS BIGINT) AS lead_time_days,
    CASE {ABC} WHEN 'A' THEN {dbl(0.98)} WHEN 'B' THEN {dbl(0.95)} ELSE {dbl(0.9)} END AS target_service_level FROM part, x_bounds""",
)
part(
    "suppliers",
    f"""SELECT 'SUP-' || s_suppkey AS supplier_id, s_name AS supplier_name, r_name AS supplier_region, {dbl(0.7)} + CAST(s_suppkey % 6 AS DOUBLE) * {dbl(0.05)} AS reliability_score,
    5 + s_suppkey % 20 AS average_lead_time_days, {dbl(0.1)} + CAST(s_suppkey % 5 AS DOUBLE) * {dbl(0.1)} AS lead_time_variability, 100 + 50 * (s_suppkey % 10) AS minimum_order_qty
    FROM supplier JOIN x_places ON s_nationkey = n_nationkey""",
)
part("warehouses", "SELECT 'WH-' || r_regionkey AS warehouse_id, r_name AS warehouse_name, r_name AS region, CAST(20000 + 5000 * r_regionkey AS BIGINT) AS storage_capacity_units FROM region")
part("product_classification", f"SELECT 'SKU-' || p_partkey AS product_id, {ABC} AS abc_class, CASE {ABC} WHEN 'A' THEN 'High' WHEN 'B' THEN 'Medium' ELSE 'Low' END AS criticality_level FROM part")
part(
    "x_lines",
    """SELECT l.*, l_partkey AS pk, CAST(n_regionkey AS BIGINT) AS rk, r_name, CAST(l_shipdate AS DATE) AS d, CAST(o_orderdate AS DATE) AS ordered, CAST(l_quantity AS BIGINT) AS units
    FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN x_places ON c_nationkey = n_nationkey""",
)
part(
    "x_days",
    """SELECT d, rk, r_name, pk, CAST(sum(CASE WHEN pk % 20 = 7 AND l_returnflag = 'N' THEN 0 ELSE units END) AS BIGINT) AS demanded,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity * (pk % 5) / CAST(10 AS DOUBLE)) AS BIGINT) ELSE 0 END) AS BIGINT) AS lost FROM x_lines GROUP BY d, rk, r_name, pk""",
)
part(
    "demand_history",
    f"""SELECT d AS date, 'WH-' || rk AS warehouse_id, 'SKU-' || pk AS product_id, r_name AS region, demanded AS units_demanded, demanded - lost AS units_fulfilled, lost AS units_lost_sales,
    CAST(lost > 0 AS BIGINT) AS stockout_flag, CAST(p_type = 'PROMO' AS BIGINT) AS promo_flag, {dbl(0.9)} + {dbl(0.02)} * CAST(month(d) AS DOUBLE) AS seasonality_index FROM x_days JOIN part ON pk = p_partkey""",
)
part("x_stock", "SELECT d, rk, pk, (pk * 37 + dayofyear(d) * 11 + rk * 5) % 61 AS k FROM x_days")
part(
    "inventory_snapshots",
    f"""SELECT d AS snapshot_date, 'WH-' || rk AS warehouse_id, product_id, k * 5 + pk % 7 AS on_hand_units, (pk * 3 + dayofyear(d)) % 40 AS on_order_units, pk % 7 AS reserved_units, k * 5 AS available_units,
    CAST(k * 5 + pk % 7 AS DOUBLE) * unit_cost AS inventory_value, CAST(k AS DOUBLE) * ({dbl(0.25)} + CAST(pk % 8 AS DOUBLE) * {dbl(0.25)}) AS days_of_supply FROM x_stock JOIN products ON product_id = 'SKU-' || pk""",
)
part(
    "purchase_orders",
    """SELECT po_id, supplier_id, product_id, warehouse_id, order_date, expected_arrival_date, actual_arrival_date, ordered_units, received_units, CAST(actual_arrival_date > expected_arrival_date AS BIGINT) AS late_delivery_flag FROM (
    SELECT 'PO-' || l_orderkey || '-' || l_linenumber || '-' || pk || '-' || l_suppkey AS po_id, 'SUP-' || l_suppkey AS supplier_id, 'SKU-' || pk AS product_id, 'WH-' || min(rk) AS warehouse_id, min(ordered) AS order_date,
    min(ordered + CAST(3 + p_size % 25 AS INTEGER)) AS expected_arrival_date,
    max(ordered + CAST(greatest(1, 3 + p_size % 25 + (l_orderkey * 5 + l_suppkey * 3 + l_linenumber) % 12 - 6 + l_suppkey % 5) AS INTEGER)) AS actual_arrival_date,
    CAST(sum(units) AS BIGINT) AS ordered_units, CAST(sum(units - CAST(floor(l_quantity * l_discount) AS BIGINT)) AS BIGINT) AS received_units
    FROM x_lines JOIN part ON pk = p_partkey GROUP BY l_orderkey, l_linenumber, pk, l_suppkey)""",
)
part(
    "daily",
    f"""SELECT h.date, h.warehouse_id, w.region, h.product_id, category, supplier_id, abc_class, criticality_level, units_demanded, units_fulfilled, units_lost_sales, stockout_flag,
    {div('units_fulfilled', 'units_demanded', '1')} AS fill_rate, promo_flag, on_hand_units, on_order_units, available_units, days_of_supply, inventory_value,
    CAST(units_lost_sales AS DOUBLE) * unit_price AS lost_sales_revenue, greatest(target_service_level * CAST(units_demanded AS DOUBLE) - CAST(units_fulfilled AS DOUBLE), CAST(0 AS DOUBLE)) AS service_gap_units
    FROM demand_history h JOIN inventory_snapshots s ON h.date = s.snapshot_date AND h.warehouse_id = s.warehouse_id AND h.product_id = s.product_id
    JOIN products p ON p.product_id = h.product_id JOIN warehouses w ON w.warehouse_id = h.warehouse_id LEFT JOIN product_classification c ON c.product_id = h.product_id""",
)
part(
    "x_record",
    f"""SELECT supplier_id, {rate('late_delivery_flag = 0')} AS otd, avg(greatest(CAST(actual_arrival_date - expected_arrival_date AS DOUBLE), 0)) AS delay,
    coalesce(stddev_samp(CAST(actual_arrival_date - order_date AS DOUBLE)), 0) AS spread, {div('sum(received_units)', 'sum(ordered_units)', '1')} AS received FROM purchase_orders GROUP BY supplier_id""",
)
part(
    "supplier_perf",
    f"""SELECT s.supplier_id, supplier_name, coalesce(otd, 1) AS on_time_delivery_rate, coalesce(delay, 0) AS average_delay_days, coalesce(spread, 0) AS lead_time_variability, coalesce(received, 1) AS received_vs_ordered_fill_rate,
    coalesce(100 * ({dbl(0.4)} * (1 - otd) + {dbl(0.2)} * least(delay / 10, 1) + {dbl(0.2)} * least(spread / 8, 1) + {dbl(0.2)} * (1 - received)), 0) AS supplier_service_risk_proxy
    FROM suppliers s LEFT JOIN x_record r ON r.supplier_id = s.supplier_id""",
)
part(
    "product_prof",
    f"""SELECT *, 100 * ({dbl(0.45)} * excess_inventory_proxy + {dbl(0.3)} * slow_moving_inventory_proxy + {dbl(0.15)} * least(average_days_of_supply / 60, 1) + {dbl(0.1)} * least(average_inventory_value / 50000, 1)) AS working_capital_risk_proxy
    FROM (SELECT d.product_id, max(product_name) AS product_name, max(d.category) AS category, max(abc_class) AS abc_class, avg(on_hand_units) AS average_inventory_units, {mean_money('inventory_value')} AS average_inventory_value,
    avg(days_of_supply) AS average_days_of_supply, {rate('stockout_flag = 1')} AS stockout_frequency, avg(fill_rate) AS fill_rate_average, {money('lost_sales_revenue')} AS lost_sales_exposure,
    {rate(SLOW)} AS slow_moving_inventory_proxy, {rate(f'days_of_supply > {CAP}')} AS excess_inventory_proxy FROM daily d JOIN products p ON p.product_id = d.product_id GROUP BY d.product_id)""",
)
part(
    "warehouse_prof",
    f"""SELECT *, 100 * ({dbl(0.4)} * stockout_rate + {dbl(0.3)} * (1 - fill_rate) + {dbl(0.2)} * least(capacity_pressure_proxy, 1) + {dbl(0.1)} * least(average_days_of_supply / 50, 1)) AS warehouse_service_risk_proxy
    FROM (SELECT t.warehouse_id, max(warehouse_name) AS warehouse_name, max(w.region) AS region, {div('sum(f)', 'sum(d)', '1')} AS fill_rate, {div('sum(l)', 'sum(d)', '0')} AS stockout_rate, {money('lost')} AS lost_sales_value,
    avg(dos) AS average_days_of_supply, {mean_money('value')} AS inventory_value, avg(pipeline / nullif(CAST(storage_capacity_units AS DOUBLE), 0)) AS capacity_pressure_proxy
    FROM (SELECT warehouse_id, date, sum(units_demanded) AS d, sum(units_fulfilled) AS f, sum(units_lost_sales) AS l, {money('lost_sales_revenue')} AS lost, avg(days_of_supply) AS dos, {money('inventory_value')} AS value,
    CAST(sum(on_hand_units + on_order_units) AS DOUBLE) AS pipeline FROM daily GROUP BY warehouse_id, date) t JOIN warehouses w ON w.warehouse_id = t.warehouse_id GROUP BY t.warehouse_id)""",
)
part(
    "inventory_base",
    f"""SELECT *, 100 * ({dbl(0.45)} * least(dos_stretch_ratio / {dbl(2.25)}, 1) + {dbl(0.35)} * least(excess_inventory_day_rate / {dbl(0.4)}, 1) + {dbl(0.2)} * least(slow_moving_day_rate / {dbl(0.12)}, 1)) AS inventory_risk_score_base
    FROM (SELECT product_id, warehouse_id, category, abc_class, avg(days_of_supply) AS avg_days_of_supply, {mean_money('inventory_value')} AS avg_inventory_value, {rate(f'abc_class IS NOT NULL AND days_of_supply > {CAP}')} AS excess_inventory_day_rate,
    {rate(SLOW)} AS slow_moving_day_rate, avg(days_of_supply) / {CAP} AS dos_stretch_ratio FROM daily GROUP BY product_id, warehouse_id, category, abc_class)""",
)
part(
    "service_base",
    f"""SELECT product_id, warehouse_id, category, supplier_id, criticality_level, units_demanded, units_fulfilled, units_lost_sales, fill_rate, stockout_rate, stockout_day_rate, service_gap_rate, lost_sales_revenue,
    100 * ({dbl(0.35)} * least((1 - fill_rate) / {dbl(0.15)}, 1) + {dbl(0.3)} * least(service_gap_rate / {dbl(0.2)}, 1) + {dbl(0.2)} * least((CASE criticality_level WHEN 'High' THEN {dbl(1.0)} WHEN 'Medium' THEN {dbl(0.6)} ELSE {dbl(0.3)} END) / {dbl(0.85)}, 1)
    + {dbl(0.15)} * least(stockout_rate / {dbl(0.18)}, 1)) AS service_risk_score_base
    FROM (SELECT product_id, warehouse_id, category, supplier_id, criticality_level, CAST(sum(units_demanded) AS BIGINT) AS units_demanded, CAST(sum(units_fulfilled) AS BIGINT) AS units_fulfilled, CAST(sum(units_lost_sales) AS BIGINT) AS units_lost_sales,
    {div('sum(units_fulfilled)', 'sum(units_demanded)', '1')} AS fill_rate, {div('sum(units_lost_sales)', 'sum(units_demanded)', '0')} AS stockout_rate, avg(stockout_flag) AS stockout_day_rate,
    {div(money('service_gap_units'), 'sum(units_demanded)', '0')} AS service_gap_rate, {money('lost_sales_revenue')} AS lost_sales_revenue FROM daily GROUP BY product_id, warehouse_id, category, supplier_id, criticality_level)""",
)
part(
    "supplier_feat",
    f"""SELECT * EXCLUDE (supplier_service_risk_proxy), round(100 * ({dbl(0.4)} * {unit('1 - on_time_delivery_rate')} + {dbl(0.2)} * {unit('average_delay_days / 10')} + {dbl(0.2)} * {unit('lead_time_variability / 8')}
    + {dbl(0.2)} * {unit('1 - received_vs_ordered_fill_rate')}), 2) AS supplier_service_risk_proxy FROM supplier_perf""",
)
part(
    "product_feat",
    f"""SELECT * EXCLUDE (working_capital_risk_proxy), round(100 * ({dbl(0.45)} * excess_inventory_proxy + {dbl(0.25)} * slow_moving_inventory_proxy + {dbl(0.2)} * {unit('average_days_of_supply / 60')}
    + {dbl(0.1)} * {unit('average_inventory_value / (SELECT quantile_cont(average_inventory_value, 0.95) FROM product_prof)')}), 2) AS working_capital_risk_proxy FROM product_prof""",
)
part(
    "warehouse_feat",
    f"""SELECT * EXCLUDE (warehouse_service_risk_proxy), round(100 * ({dbl(0.4)} * {unit('stockout_rate')} + {dbl(0.3)} * {unit('1 - fill_rate')} + {dbl(0.2)} * {unit('capacity_pressure_proxy')}
    + {dbl(0.1)} * {unit('average_days_of_supply / 50')}), 2) AS warehouse_service_risk_proxy FROM warehouse_prof""",
)


def driver(service: str = "service_risk_score", stockout: str = "stockout_risk_score", excess: str = "excess_inventory_score", supplier: str = "supplier_risk_score", capital: str = "working_capital_risk_score") -> str:
    top = f"greatest({service}, {stockout}, {excess}, {supplier}, {capital})"
    return f"CASE {top} WHEN {service} THEN 'Service Risk' WHEN {stockout} THEN 'Stockout Risk' WHEN {excess} THEN 'Excess Inventory' WHEN {supplier} THEN 'Supplier Risk' WHEN {capital} THEN 'Working Capital' END"


def _baseline() -> None:
    from shelfspark.plans.features import BASELINE_ACTIONS

    minmax = lambda x: f"(CASE WHEN min({x}) OVER () = max({x}) OVER () THEN 50 ELSE ({x} - min({x}) OVER ()) / nullif(max({x}) OVER () - min({x}) OVER (), 0) * 100 END)"
    part(
        "x_baseline",
        f"""SELECT t.product_id, warehouse_id, t.supplier_id, 100 * ({dbl(0.65)} * {unit(f'gap / {dbl(0.25)}')} + {dbl(0.35)} * {unit(f'(1 - fill) / {dbl(0.15)}')}) AS service_risk_score,
    100 * ({dbl(0.7)} * {unit(f'stockouts / {dbl(0.25)}')} + {dbl(0.3)} * {unit(f'loss / {dbl(0.2)}')}) AS stockout_risk_score, 100 * ({dbl(0.7)} * {unit(f'excess / {dbl(0.4)}')} + {dbl(0.3)} * {unit('dos / 60')}) AS excess_inventory_score,
    least(greatest(coalesce(supplier_service_risk_proxy, 0), 0), 100) AS supplier_risk_score,
    100 * ({dbl(0.55)} * (coalesce(working_capital_risk_proxy, 0) / 100) + {dbl(0.25)} * {unit(f'slow / {dbl(0.3)}')} + {dbl(0.2)} * ({minmax('value')} / 100)) AS working_capital_risk_score, {minmax('lost')} AS lost_scaled
    FROM (SELECT product_id, warehouse_id, supplier_id, {div(money('service_gap_units'), 'sum(units_demanded)', '0')} AS gap, {div('sum(units_fulfilled)', 'sum(units_demanded)', '1')} AS fill, {div('sum(units_lost_sales)', 'sum(units_demanded)', '0')} AS loss,
    avg(stockout_flag) AS stockouts, {rate(f'days_of_supply > {CAP}')} AS excess, {rate(SLOW)} AS slow, avg(days_of_supply) AS dos, {mean_money('inventory_value')} AS value, {money('lost_sales_revenue')} AS lost
    FROM daily GROUP BY product_id, warehouse_id, supplier_id) t LEFT JOIN supplier_feat s ON s.supplier_id = t.supplier_id LEFT JOIN product_feat f ON f.product_id = t.product_id""",
    )
    advice = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BASELINE_ACTIONS.items())
    part(
        "sku_risk_baseline",
        f"""SELECT * EXCLUDE (lost_scaled), {TIER.format('governance_priority_score')} AS risk_tier, CASE main_risk_driver {advice} END AS recommended_action
    FROM (SELECT *, round({dbl(0.26)} * service_risk_score + {dbl(0.22)} * stockout_risk_score + {dbl(0.18)} * excess_inventory_score + {dbl(0.16)} * supplier_risk_score + {dbl(0.1)} * working_capital_risk_score + {dbl(0.08)} * lost_scaled, 2) AS governance_priority_score,
    {driver()} AS main_risk_driver FROM x_baseline)""",
    )


_baseline()

part(
    "supplier_base",
    f"""SELECT * EXCLUDE (supplier_service_risk_proxy), least(greatest({dbl(0.45)} * {linear(unit('1 - on_time_delivery_rate'), 0.05, 0.45)} + {dbl(0.2)} * {linear('greatest(average_delay_days, 0)', 0.5, 5.0)}
    + {dbl(0.2)} * {linear('greatest(lead_time_variability, 0)', 1.5, 10.0)} + {dbl(0.15)} * {linear(unit('1 - received_vs_ordered_fill_rate'), 0.0, 0.08)}, 0), 100) AS supplier_risk_score_base FROM supplier_perf""",
)
part(
    "x_scoring",
    f"""SELECT d.*, CAST(date_trunc('month', d.date) AS DATE) AS month, {CAP} AS cap, CASE WHEN days_of_supply > {CAP} THEN CAST(1 AS DOUBLE) ELSE 0 END AS excess_day, CASE WHEN {SLOW} THEN CAST(1 AS DOUBLE) ELSE 0 END AS slow_day,
    CASE criticality_level WHEN 'High' THEN {dbl(1.0)} WHEN 'Medium' THEN {dbl(0.6)} WHEN 'Low' THEN {dbl(0.3)} ELSE {dbl(0.6)} END AS crit, greatest(CAST(units_demanded AS DOUBLE), 1) AS w, coalesce(supplier_risk_score_base, 50) AS base
    FROM daily d LEFT JOIN supplier_base b ON b.supplier_id = d.supplier_id""",
)


def _entity(name: str, keys: list[str], own: str = "", entity: str = "") -> None:
    from shelfspark.plans.scoring import ACTIONS

    k = ", ".join(keys)
    on = " AND ".join(f"m.{x} = a.{x}" for x in keys)
    part(
        f"x_{name}_measures",
        f"""SELECT a.*, stockout_active_month_ratio FROM (SELECT {k}, sum(units_demanded) AS d, sum(units_fulfilled) AS f, sum(units_lost_sales) AS l, {div('sum(units_fulfilled)', 'sum(units_demanded)', '0')} AS fill_rate,
    {div('sum(units_lost_sales)', 'sum(units_demanded)', '0')} AS stockout_rate, {div(money('service_gap_units'), 'sum(units_demanded)', '0')} AS service_gap_rate, avg(excess_day) AS excess_day_rate, avg(slow_day) AS slow_moving_rate,
    {money('crit * w')} / {money('w')} AS crit, avg(days_of_supply) / nullif({money('cap * w')} / {money('w')}, 0) AS dos_stretch, least(greatest({money('base * w')} / {money('w')}, 0), 100) AS weighted_supplier,
    {money('lost_sales_revenue')} AS lost_sales_revenue, {money('inventory_value')} AS inventory_value_sum, avg(stockout_flag) AS stockout_frequency, avg(days_of_supply) AS average_days_of_supply, {mean_money('inventory_value')} AS average_inventory_value,
    {money('service_gap_units')} AS service_gap_units, count(DISTINCT date) AS active_days FROM x_scoring GROUP BY {k}) a
    JOIN (SELECT {k}, avg(CASE WHEN lost > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS stockout_active_month_ratio FROM (SELECT {k}, month, sum(units_lost_sales) AS lost FROM x_scoring GROUP BY {k}, month) GROUP BY {k}) m ON {on}""",
    )
    part(
        f"x_{name}_shares",
        f"""SELECT e.*, lost_sales_revenue / greatest((SELECT {money('lost_sales_revenue')} FROM daily), 1) AS lost_sales_share, inventory_value_sum / greatest((SELECT {money('inventory_value')} FROM daily), 1) AS inventory_value_share,
    least(greatest({own or 'weighted_supplier'}, 0), 100) AS supplier_risk_score{", b.* EXCLUDE (supplier_id)" if own else ""} FROM x_{name}_measures e {"LEFT JOIN supplier_base b ON b.supplier_id = e.supplier_id" if own else ""}""",
    )
    lost, held, stretch = log_share("lost_sales_share", 0.0005, 0.08), log_share("inventory_value_share", 0.001, 0.12), linear("greatest(dos_stretch, 0)", 1.0, 2.25)
    part(
        f"x_{name}_scores",
        f"""SELECT *, least(greatest({dbl(0.35)} * {linear(unit('1 - fill_rate'), 0.01, 0.15)} + {dbl(0.3)} * {linear(unit('service_gap_rate'), 0.0, 0.2)} + {dbl(0.2)} * {linear(unit('crit'), 0.45, 0.85)} + {dbl(0.15)} * {lost}, 0), 100) AS service_risk_score,
    least(greatest({dbl(0.55)} * {linear(unit('stockout_rate'), 0.01, 0.18)} + {dbl(0.3)} * {linear(unit('stockout_active_month_ratio'), 0.1, 0.65)} + {dbl(0.15)} * {lost}, 0), 100) AS stockout_risk_score,
    least(greatest({dbl(0.45)} * {stretch} + {dbl(0.35)} * {linear(unit('excess_day_rate'), 0.05, 0.4)} + {dbl(0.2)} * {held}, 0), 100) AS excess_inventory_score,
    least(greatest({dbl(0.45)} * {stretch} + {dbl(0.3)} * {linear(unit('slow_moving_rate'), 0.01, 0.12)} + {dbl(0.25)} * {held}, 0), 100) AS working_capital_risk_score FROM x_{name}_shares""",
    )
    advice = " ".join(f"WHEN '{d}' THEN '{a[entity]}'" for d, a in ACTIONS.items())
    part(
        f"{name}_risk",
        f"""SELECT *, CASE WHEN risk_tier = 'Low' THEN 'monitor only' ELSE CASE main_risk_driver {advice} ELSE 'review planning assumptions' END END AS recommended_action FROM (SELECT *, {TIER.format('governance_priority_score')} AS risk_tier FROM (SELECT *,
    least(greatest({dbl(0.24)} * service_risk_score + {dbl(0.22)} * stockout_risk_score + {dbl(0.18)} * excess_inventory_score + {dbl(0.16)} * supplier_risk_score + {dbl(0.14)} * working_capital_risk_score + {dbl(0.06)} * least(service_risk_score, excess_inventory_score), 0), 100) AS governance_priority_score,
    {driver()} AS main_risk_driver FROM x_{name}_scores))""",
    )


_entity("sku", ["product_id", "warehouse_id", "supplier_id", "category", "region"], entity="sku_warehouse")
_entity("supplier", ["supplier_id"], own="coalesce(supplier_risk_score_base, weighted_supplier)", entity="supplier")
_entity("segment", ["category", "region"], entity="segment")
SCORES = "service_risk_score, stockout_risk_score, excess_inventory_score, supplier_risk_score, working_capital_risk_score, governance_priority_score, risk_tier, main_risk_driver, recommended_action"
part(
    "queue",
    f"""SELECT 'sku_warehouse' AS entity_type, product_id || '|' || warehouse_id AS entity_id, product_id || ' @ ' || warehouse_id AS entity_name, {SCORES}, lost_sales_revenue, inventory_value_sum FROM sku_risk
    UNION ALL SELECT 'supplier', supplier_id, supplier_name, {SCORES}, lost_sales_revenue, inventory_value_sum FROM supplier_risk
    UNION ALL SELECT 'segment', category || ' | ' || region, category || ' | ' || region, {SCORES}, lost_sales_revenue, inventory_value_sum FROM segment_risk""",
)
part(
    "delay_factor",
    f"""SELECT supplier_id, supplier_name, {unit(f"{dbl(0.45)} * {unit('1 - on_time_delivery_rate')} + {dbl(0.35)} * {unit('average_delay_days / 7')} + {dbl(0.2)} * {unit('lead_time_variability / 10')}")} AS supplier_delay_factor,
    on_time_delivery_rate, average_delay_days, lead_time_variability FROM supplier_perf""",
)
part(
    "valued",
    f"""SELECT *, excess_inventory_value_proxy + {dbl(0.5)} * greatest(slow_moving_value_proxy - excess_inventory_value_proxy, 0) AS trapped_working_capital_proxy, lost_sales_revenue * gross_margin_rate AS lost_sales_margin_proxy,
    lost_sales_revenue * supplier_delay_factor AS supplier_delay_impact_proxy FROM (SELECT d.*, product_name, least(greatest(coalesce(CASE WHEN unit_price > 0 THEN greatest(unit_price - unit_cost, 0) / unit_price ELSE 0 END, {dbl(0.3)}), 0), {dbl(0.9)}) AS gross_margin_rate,
    coalesce(supplier_delay_factor, {dbl(0.25)}) AS supplier_delay_factor, inventory_value * {unit(f'CASE WHEN days_of_supply > 0 THEN greatest(days_of_supply - {CAP}, 0) / nullif(days_of_supply, 0) ELSE 0 END')} AS excess_inventory_value_proxy,
    inventory_value * (CASE WHEN {SLOW} THEN CAST(1 AS DOUBLE) ELSE 0 END) AS slow_moving_value_proxy FROM daily d LEFT JOIN products p ON p.product_id = d.product_id LEFT JOIN delay_factor f ON f.supplier_id = d.supplier_id)""",
)
part("annual", "SELECT count(DISTINCT date) AS analysis_days, CAST(365 AS DOUBLE) / greatest(count(DISTINCT date), 1) AS factor FROM daily")
AMOUNTS = ["lost_sales_revenue", "lost_sales_margin_proxy", "excess_inventory_value_proxy", "trapped_working_capital_proxy", "slow_moving_value_proxy", "supplier_delay_impact_proxy"]


def _impact(name: str, keys: list[str]) -> None:
    k = ", ".join(keys)
    part(
        f"impact_{name}",
        f"""SELECT *, CASE WHEN sum(CAST(opportunity_total_12m_proxy AS DECIMAL(18,6))) OVER () > 0 THEN opportunity_total_12m_proxy / CAST(sum(CAST(opportunity_total_12m_proxy AS DECIMAL(18,6))) OVER () AS DOUBLE) ELSE 0 END AS opportunity_share,
    row_number() OVER (ORDER BY round(opportunity_total_12m_proxy, 4) DESC, {k}) AS opportunity_rank FROM (SELECT *, opportunity_margin_recovery_12m_proxy + opportunity_wc_release_12m_proxy AS opportunity_total_12m_proxy
    FROM (SELECT *, lost_sales_margin_proxy_annualized * {dbl(0.35)} AS opportunity_margin_recovery_12m_proxy, trapped_working_capital_proxy_annualized * {dbl(0.25)} AS opportunity_wc_release_12m_proxy
    FROM (SELECT a.*, {", ".join(f"{x}_observed * factor AS {x}_annualized" for x in AMOUNTS)} FROM (SELECT {k}, CAST(sum(units_demanded) AS BIGINT) AS units_demanded, CAST(sum(units_lost_sales) AS BIGINT) AS units_lost_sales,
    {div('sum(units_lost_sales)', 'sum(units_demanded)', '0')} AS stockout_rate, {", ".join(f"{money(x)} AS {x}_observed" for x in AMOUNTS)} FROM valued GROUP BY {k}) a, annual)))""",
    )


_impact("sku", ["product_id", "product_name", "warehouse_id", "category", "supplier_id"])
_impact("warehouse", ["warehouse_id", "region"])
_impact("supplier", ["supplier_id"])
_impact("category", ["category"])
