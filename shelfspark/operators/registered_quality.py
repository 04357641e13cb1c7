"""Registration of contracts, profiles, validation, pre-delivery checks and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expressions import argmax, money_sum, money_total, risk_tier
from shelfspark.operators import facts, gates, kpis, quality
from shelfspark.operators.registered import FILL, LOSS, amounts, impacts, skus
from shelfspark.operators.registered_facts import fact
from shelfspark.oracles.base import TIER, driver, money, part
from shelfspark.oracles.doubles import DOUBLES
from shelfspark.plans import features, impact, scoring
from shelfspark.registry import register
from shelfspark.schemas import KEYS, RAW
from shelfspark.sources.fixtures import Tables

NON_NEGATIVE = {
    "products": ["unit_cost", "unit_price", "shelf_life_days", "lead_time_days"], "suppliers": ["average_lead_time_days", "lead_time_variability", "minimum_order_qty"], "warehouses": ["storage_capacity_units"],
    "inventory_snapshots": ["on_hand_units", "on_order_units", "reserved_units", "available_units", "inventory_value", "days_of_supply"], "demand_history": ["units_demanded", "units_fulfilled", "units_lost_sales", "seasonality_index"], "purchase_orders": ["ordered_units", "received_units"], "product_classification": [],
}
BOUNDED = {"products": {"target_service_level": (0.0, 1.0)}, "suppliers": {"reliability_score": (0.0, 1.0)}}
DOMAINS = {"demand_history": {"stockout_flag": [0, 1], "promo_flag": [0, 1]}, "purchase_orders": {"late_delivery_flag": [0, 1]}, "product_classification": {"abc_class": ["A", "B", "C"], "criticality_level": ["Low", "Medium", "High"]}}
DATES = {"inventory_snapshots": ["snapshot_date"], "demand_history": ["date"], "purchase_orders": ["order_date", "expected_arrival_date", "actual_arrival_date"]}
DIMS = {"products": ["category", "supplier_id", "shelf_life_days"], "suppliers": ["supplier_region", "supplier_name"], "warehouses": ["region", "warehouse_name"], "inventory_snapshots": ["warehouse_id", "product_id"], "demand_history": ["warehouse_id", "product_id", "region", "promo_flag"], "purchase_orders": ["supplier_id", "warehouse_id", "product_id"], "product_classification": ["abc_class", "criticality_level"]}
METRICS = {"products": ["unit_cost", "unit_price", "lead_time_days", "target_service_level"], "suppliers": ["reliability_score", "average_lead_time_days", "lead_time_variability", "minimum_order_qty"], "warehouses": ["storage_capacity_units"], "inventory_snapshots": ["on_hand_units", "on_order_units", "reserved_units", "available_units", "days_of_supply"], "demand_history": ["units_demanded", "units_fulfilled", "units_lost_sales", "stockout_flag"], "purchase_orders": ["ordered_units", "received_units", "late_delivery_flag"]}
FOREIGN = [("products", "supplier_id", "suppliers"), ("inventory_snapshots", "product_id", "products"), ("inventory_snapshots", "warehouse_id", "warehouses"), ("demand_history", "product_id", "products"), ("demand_history", "warehouse_id", "warehouses"), ("purchase_orders", "supplier_id", "suppliers"), ("purchase_orders", "product_id", "products"), ("purchase_orders", "warehouse_id", "warehouses"), ("product_classification", "product_id", "products")]
CRITICAL = {n: [*KEYS[n], *[c for c in ("unit_cost", "unit_price", "supplier_name", "region", "units_demanded", "on_hand_units", "ordered_units", "abc_class") if c in RAW[n].names]] for n in RAW}


def _all(t: Tables, one) -> DataFrame:  # noqa: ANN001
    return quality.union([one(n, t.raw(n)) for n in RAW])


_dup = lambda n: f"(SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM {n} GROUP BY {', '.join(KEYS[n])}))"
_nulls = lambda n, cols: f"(SELECT CAST({' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in cols)} AS BIGINT) FROM {n})"
_negs = lambda n, cols: f"(SELECT CAST({' + '.join(f'count(*) FILTER (WHERE {c} < 0)' for c in cols)} AS BIGINT) FROM {n})" if cols else "CAST(0 AS BIGINT)"


def contracts(t: Tables) -> DataFrame:
    return t.keep("contracts", lambda: _all(t, lambda n, df: quality.contract_results(n, df, RAW[n].names, KEYS[n], CRITICAL[n], NON_NEGATIVE[n])))


def _contract_sql(check: str | None = None) -> str:
    lines = []
    for n in RAW:
        rows = {"required_columns_present": ("CAST(0 AS BIGINT)", "all required columns"), "unique_key": (_dup(n), ", ".join(KEYS[n])), "critical_not_null": (_nulls(n, CRITICAL[n]), ", ".join(CRITICAL[n])), "non_negative": (_negs(n, NON_NEGATIVE[n]), ", ".join(NON_NEGATIVE[n]) or "none")}
        lines += [f"SELECT '{n}' AS table_name, '{c}' AS check_name, 'HIGH' AS severity, CASE WHEN o = 0 THEN 'PASS' ELSE 'FAIL' END AS status, o AS observed, CAST(0 AS BIGINT) AS expected, '{d}' AS details FROM (SELECT {sql} AS o)" for c, (sql, d) in rows.items() if check in (None, c)]
    return " UNION ALL ".join(lines)


for _key, _check in (("dc01_required_columns", "required_columns_present"), ("dc02_unique_keys", "unique_key"), ("dc03_critical_nulls", "critical_not_null"), ("dc04_non_negative", "non_negative")):
    register(_key, lambda t, c=_check: contracts(t).filter(F.col("check_name") == c), _contract_sql(_check))
register("dc05_contract_run", contracts, _contract_sql())
register("dc05_contract_summary", lambda t: quality.contract_summary(contracts(t)), f"SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'WARN') AS warned FROM ({_contract_sql()})")


def summaries(t: Tables) -> DataFrame:
    return _all(t, lambda n, df: quality.table_summary(n, df, KEYS[n], NON_NEGATIVE[n], BOUNDED.get(n, {}), DOMAINS.get(n, {})))


def _summary_sql(n: str) -> str:
    tests = [f"count(*) FILTER (WHERE {c} < 0)" for c in NON_NEGATIVE[n]] + [f"count(*) FILTER (WHERE {c} < {a} OR {c} > {b})" for c, (a, b) in BOUNDED.get(n, {}).items()]
    tests += [f"count(*) FILTER (WHERE {c} IS NULL OR {c} NOT IN ({', '.join(repr(v) for v in vs)}))" for c, vs in DOMAINS.get(n, {}).items()]
    cols = RAW[n].names
    return f"SELECT '{n}' AS table_name, count(*) AS row_count, {len(cols)} AS column_count, {_dup(n)} AS duplicate_key_rows, CAST({_nulls(n, cols)} AS DOUBLE) / greatest(count(*) * {len(cols)}, 1) AS null_rate, CAST({' + '.join(tests) or '0'} AS BIGINT) AS impossible_values FROM {n}"


_SUMMARIES = " UNION ALL ".join(map(_summary_sql, RAW))
register("dp01_table_summary", summaries, _SUMMARIES)
register("dp02_null_profile", lambda t: _all(t, quality.null_profile), " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / greatest(count(*), 1) AS null_rate FROM {n}" for n in RAW for c in RAW[n].names))
register(
    "dp03_cardinality",
    lambda t: quality.union([quality.cardinality(n, t.raw(n), cols) for n, cols in DIMS.items()]),
    " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS table_name, '{c}' AS column_name, count(*) OVER () AS distinct_values, v AS top_value, CAST(k AS DOUBLE) / CAST(sum(k) OVER () AS DOUBLE) AS top_share FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k FROM {n} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY k DESC, v LIMIT 1)" for n, cols in DIMS.items() for c in cols),
)
_Q = lambda c, q: f"quantile_cont({c}, {q})"
register(
    "dp04_distribution",
    lambda t: quality.distributions({n: (t.raw(n), cols) for n, cols in METRICS.items()}),
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS column_name, min({x}) AS min, {_Q(x, 0.5)} AS p50, {_Q(x, 0.95)} AS p95, {_Q(x, 0.99)} AS p99, max({x}) AS max, avg({x}) AS mean, stddev_samp({x}) AS std, skewness({x}) AS skew, CASE WHEN {_Q(x, 0.5)} = 0 THEN 0 ELSE {_Q(x, 0.99)} / nullif({_Q(x, 0.5)}, 0) END AS p99_p50_ratio FROM {n}" for n, cols in METRICS.items() for c in cols for x in [f"CAST({c} AS DOUBLE)"]),
)
register(
    "dp05_date_coverage",
    lambda t: quality.union([quality.date_coverage(n, t.raw(n), cols) for n, cols in DATES.items()]),
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS date_column, min({c}) AS min_date, max({c}) AS max_date, count(DISTINCT {c}) AS distinct_dates, CAST(max({c}) - min({c}) + 1 AS BIGINT) AS expected_days, greatest(CAST(max({c}) - min({c}) + 1 AS BIGINT) - count(DISTINCT {c}), 0) AS missing_days FROM {n}" for n, cols in DATES.items() for c in cols),
)


def foreign_keys(t: Tables) -> DataFrame:
    return quality.union([quality.orphans(n, t.raw(n), k, p, t.raw(p), k) for n, k, p in FOREIGN])


_FOREIGN = " UNION ALL ".join(f"SELECT '{n}' AS child_table, '{k}' AS child_key, '{p}' AS parent_table, count(*) AS orphan_rows, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM {n} c WHERE c.{k} IS NOT NULL AND c.{k} NOT IN (SELECT {k} FROM {p})" for n, k, p in FOREIGN)
register("dp06_foreign_keys", foreign_keys, _FOREIGN)
_DK, _IK = "SELECT DISTINCT date AS d, warehouse_id, product_id FROM demand_history", "SELECT DISTINCT snapshot_date AS d, warehouse_id, product_id FROM inventory_snapshots"
register("dp07_key_reconciliation", lambda t: quality.key_reconciliation(t.demand_history, t.inventory_snapshots), f"SELECT (SELECT count(*) FROM ({_DK} EXCEPT {_IK})) AS demand_only, (SELECT count(*) FROM ({_IK} EXCEPT {_DK})) AS inventory_only, (SELECT count(*) FROM ({_DK} INTERSECT {_IK})) AS matched")
register("dp08_region_mismatch", lambda t: quality.attribute_mismatch(t.demand_history, "warehouse_id", "region", t.warehouses, "region"), "SELECT count(*) AS rows, count(*) FILTER (WHERE d.region IS DISTINCT FROM w.region) AS mismatched FROM demand_history d LEFT JOIN warehouses w ON w.warehouse_id = d.warehouse_id")
register("dp09_po_supplier_mismatch", lambda t: quality.attribute_mismatch(t.purchase_orders, "product_id", "supplier_id", t.products, "supplier_id"), "SELECT count(*) AS rows, count(*) FILTER (WHERE d.supplier_id IS DISTINCT FROM w.supplier_id) AS mismatched FROM purchase_orders d LEFT JOIN products w ON w.product_id = d.product_id")
_missing = lambda n, c: f"SELECT '{n}' AS table_name, '{c}' AS column_name, CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(min({c}), max({c}), INTERVAL 1 DAY)) AS d FROM {n}) WHERE CAST(d AS DATE) NOT IN (SELECT DISTINCT {c} FROM {n} WHERE {c} IS NOT NULL)"
register(
    "dp05_missing_days", lambda t: quality.union([quality.missing_dates(t.raw(n), cols).select(F.lit(n).alias("table_name"), "column_name", "day") for n, cols in DATES.items()]), " UNION ALL ".join(_missing(n, c) for n, cols in DATES.items() for c in cols)
)
register(
    "dp10_cube_completeness",
    lambda t: quality.cube_completeness("demand_history", t.demand_history, "date").unionByName(quality.cube_completeness("inventory_snapshots", t.inventory_snapshots, "snapshot_date")),
    " UNION ALL ".join(f"SELECT *, expected_rows - observed_rows AS gap_rows FROM (SELECT '{n}' AS table_name, count(*) AS observed_rows, count(DISTINCT {d}) * count(DISTINCT warehouse_id) * count(DISTINCT product_id) AS expected_rows FROM {n})" for n, d in (("demand_history", "date"), ("inventory_snapshots", "snapshot_date"))),
)
register("dp11_supplier_signal", lambda t: quality.supplier_signal(t.suppliers, t.purchase_orders), "SELECT count(*) FILTER (WHERE n = 0) AS zero_po_suppliers, count(*) FILTER (WHERE n < 100) AS low_po_suppliers FROM (SELECT s.supplier_id, count(po_id) AS n FROM suppliers s LEFT JOIN purchase_orders o ON o.supplier_id = s.supplier_id GROUP BY 1)")
_skew = lambda c, limit: f"SELECT '{c}' AS column_name, r AS p99_p50_ratio, CAST({limit} AS DOUBLE) AS skew_limit, CASE WHEN r > {limit} THEN 'Medium' ELSE 'Info' END AS severity FROM (SELECT CASE WHEN {_Q(c, 0.5)} = 0 THEN 0 ELSE {_Q(c, 0.99)} / nullif({_Q(c, 0.5)}, 0) END AS r FROM inventory_snapshots)"
register("dp12_skew_flags", lambda t: quality.skew_flags(t.inventory_snapshots), _skew("days_of_supply", 8) + " UNION ALL " + _skew("inventory_value", 15))

# -- validation -------------------------------------------------------------------------------------------------------

_FR = "CAST(units_fulfilled AS DOUBLE) / nullif(units_demanded, 0)"
_more = lambda n: f"(SELECT count(*) FROM (SELECT 1 FROM {n} GROUP BY {', '.join(KEYS[n])} HAVING count(*) > 1))"
_anyneg = lambda n, cols: f"(SELECT count(*) FROM {n} WHERE {' OR '.join(f'{c} < 0' for c in cols)})"
_UNITS = ["units_demanded", "units_fulfilled", "units_lost_sales"]
_STOCK = ["on_hand_units", "on_order_units", "reserved_units", "available_units", "inventory_value"]
_ORDER = ["ordered_units", "received_units"]
_ZERO = "units_demanded = 0 AND (units_fulfilled > 0 OR units_lost_sales > 0)"
_value = lambda gap: f"(SELECT count(*) FROM inventory_snapshots i JOIN products p ON p.product_id = i.product_id WHERE abs(inventory_value - CAST(on_hand_units AS DOUBLE) * unit_cost) > {gap})"
VALIDATION = {
    "q01": ("duplicate_keys_inventory_snapshots", _more("inventory_snapshots")),
    "q02": ("duplicate_keys_demand_history", _more("demand_history")),
    "q03": ("duplicate_keys_purchase_orders", _more("purchase_orders")),
    "q04": ("critical_null_fields", _nulls("products", ["product_id", "category", "unit_cost", "unit_price"])),
    "q05": ("impossible_negative_values", f"{_anyneg('inventory_snapshots', _STOCK)} + {_anyneg('demand_history', _UNITS)} + {_anyneg('purchase_orders', _ORDER)}"),
    "q06": ("fill_rate_out_of_bounds", f"(SELECT count(*) FROM demand_history WHERE {_FR} < 0 OR {_FR} > 1)"),
    "q07": ("stockout_logic_inconsistencies", "(SELECT count(*) FROM demand_history WHERE (stockout_flag = 1 AND units_lost_sales = 0) OR (stockout_flag = 0 AND units_lost_sales > 0) OR units_fulfilled + units_lost_sales <> units_demanded)"),
    "q08": ("inventory_value_consistency", _value(0.05)),
    "q09": ("po_date_inconsistencies", "(SELECT count(*) FROM purchase_orders WHERE expected_arrival_date < order_date OR actual_arrival_date < order_date)"),
    "q10": ("zero_demand_denominator_sanity", f"(SELECT count(*) FROM demand_history WHERE {_ZERO})"),
    "q11": ("available_units_consistency", "(SELECT count(*) FROM inventory_snapshots WHERE available_units <> on_hand_units - reserved_units)"),
}


def validated(t: Tables) -> DataFrame:
    return t.keep("validated", lambda: quality.validation(t.demand_history, t.inventory_snapshots, t.purchase_orders, t.products))


_line = lambda name, sql: f"SELECT '{name}' AS check_name, o AS issue_count, CASE WHEN o = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT CAST({sql} AS BIGINT) AS o)"
for _id, (_name, _sql) in VALIDATION.items():
    register(f"{_id}_{_name}", lambda t, n=_name: validated(t).filter(F.col("check_name") == n), _line(_name, _sql))
_VALIDATION = " UNION ALL ".join(_line(n, s) for n, s in VALIDATION.values())
register("q12_validation_summary", validated, _VALIDATION)
register("q13_value_mismatch_rows", lambda t: quality.value_mismatches(t.inventory_snapshots, t.products), "SELECT snapshot_date, warehouse_id, i.product_id, inventory_value, CAST(on_hand_units AS DOUBLE) * unit_cost AS expected_value FROM inventory_snapshots i JOIN products p ON p.product_id = i.product_id WHERE abs(inventory_value - CAST(on_hand_units AS DOUBLE) * unit_cost) > 0.05 ORDER BY abs(inventory_value - CAST(on_hand_units AS DOUBLE) * unit_cost) DESC, 1, 2, 3")
_ISSUES = f"""SELECT 'duplicates' AS issue_category, 'High' AS severity, table_name AS object_name, duplicate_key_rows AS issue_rows FROM ({_SUMMARIES}) WHERE duplicate_key_rows > 0 UNION ALL SELECT 'impossible values', 'High', table_name, impossible_values FROM ({_SUMMARIES}) WHERE impossible_values > 0
    UNION ALL SELECT 'referential integrity', 'High', child_table || '.' || child_key, orphan_rows FROM ({_FOREIGN}) WHERE orphan_rows > 0 UNION ALL SELECT 'validation', 'High', check_name, issue_count FROM ({_VALIDATION}) WHERE issue_count > 0"""
part("x_issues", _ISSUES)
register("dp13_quality_issues", lambda t: quality.quality_issues(summaries(t), foreign_keys(t), validated(t)), "SELECT *, CASE severity WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END AS severity_rank FROM (SELECT * FROM x_issues UNION ALL SELECT 'none', 'Info', 'all tables', CAST(0 AS BIGINT) WHERE NOT EXISTS (SELECT 1 FROM x_issues))")
register(
    "dp14_generation_health",
    lambda t: quality.generation_health(t.demand_history, t.inventory_snapshots, t.purchase_orders),
    f"SELECT (SELECT {FILL} FROM demand_history) AS fill_rate, (SELECT avg(stockout_flag) FROM demand_history) AS stockout_day_rate, (SELECT avg(late_delivery_flag) FROM purchase_orders) AS late_rate, (SELECT avg(CASE WHEN days_of_supply > 35 THEN CAST(1 AS DOUBLE) ELSE 0 END) FROM inventory_snapshots) AS excess_day_rate, (SELECT count(*) FROM (SELECT 1 FROM inventory_snapshots GROUP BY product_id HAVING avg(days_of_supply) > 35)) AS chronic_excess_skus, (SELECT count(*) FROM (SELECT 1 FROM demand_history GROUP BY product_id HAVING avg(stockout_flag) > 0.12)) AS chronic_stockout_skus",
)

# -- pre-delivery checks ----------------------------------------------------------------------------------------------


def agreement(t: Tables) -> DataFrame:
    """Sums taken a second way: impact tables against the overall figures, the monthly fact and snapshot against the daily fact."""
    valued = amounts(t)
    lost = valued.agg(*[money_sum(x).alias(x) for x in impact.AMOUNTS])
    summary = impact.overall(valued, days=t.daily).agg(*[F.max(F.when(F.col("metric") == f"{x}_observed", F.col("value"))).alias(f"s_{x}") for x in ("trapped_working_capital_proxy", "excess_inventory_value_proxy")], F.max(F.when(F.col("metric") == "opportunity_total_12m_proxy", F.col("value"))).alias("opportunity"))
    row = lost.crossJoin(summary)
    for kind in ("sku", "warehouse", "supplier", "category"):
        row = row.crossJoin(impact.sums_by(valued, {"sku": ["product_id", "warehouse_id"], "warehouse": ["warehouse_id"], "supplier": ["supplier_id"], "category": ["category"]}[kind]).agg(money_total("lost_sales_revenue_observed").alias(f"by_{kind}")))
    direct = valued.groupBy("supplier_id").agg(money_sum(F.col("lost_sales_revenue") * F.col("supplier_delay_factor")).alias("again"))
    delay = impacts(t, "supplier").join(direct, "supplier_id").agg(F.max(F.abs(F.col("supplier_delay_impact_proxy_observed") - F.col("again"))).alias("delay_gap"))
    month = fact(t).agg(*[F.sum(x).alias(f"m_{x}") for x in _UNITS], *[money_sum(x).alias(f"m_{x}") for x in ("lost_sales_revenue", "inventory_value")])
    day = t.daily.agg(*[F.sum(x).alias(f"d_{x}") for x in _UNITS], *[money_sum(x).alias(f"d_{x}") for x in ("lost_sales_revenue", "inventory_value")])
    row = row.crossJoin(delay).crossJoin(month).crossJoin(day)  # one row each
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    fact_gap = reduce(lambda a, b: a + b, [gap(f"m_{x}", f"d_{x}") for x in [*_UNITS, "lost_sales_revenue", "inventory_value"]])
    snap = facts.reconciled(facts.snapshot(kpis.service_health(t.daily), impact.overall(valued, days=t.daily)), facts.slice_totals(fact(t)))
    row = row.withColumns({"trapped_gap": gap("trapped_working_capital_proxy", "s_trapped_working_capital_proxy"), "excess_gap": gap("excess_inventory_value_proxy", "s_excess_inventory_value_proxy"), "fact_gap": fact_gap, **{f"{k}_gap": gap(f"by_{k}", "lost_sales_revenue") for k in ("sku", "warehouse", "supplier", "category")}})
    return agreement_lines(row.crossJoin(snap.select(F.greatest("fill_diff", "stockout_diff").alias("snap_gap"))))  # one row


def agreement_lines(row: DataFrame) -> DataFrame:
    """Checks of the gaps of one row, as they are: nothing is rounded before it is compared."""
    close = lambda c, most=1.0: F.col(c) <= most
    within = [("aggregation_lost_sales_%s_to_overall" % k, "HIGH", f"{k}_gap", close(f"{k}_gap"), "FAIL") for k in ("sku", "warehouse", "supplier", "category")]
    money_checks = quality.checks_from(row, "impact", [
        ("working_capital_proxy_overall_consistency", "HIGH", "trapped_gap", close("trapped_gap"), "FAIL"), ("excess_inventory_proxy_overall_consistency", "HIGH", "excess_gap", close("excess_gap"), "FAIL"), ("supplier_delay_proxy_consistency", "HIGH", "delay_gap", close("delay_gap"), "WARN"), *within,
        ("impact_opportunity_non_negative", "HIGH", "opportunity", F.col("opportunity") >= 0, "FAIL"),
    ])
    board = [("dashboard_metric_reconciliation", "HIGH", "fact_gap", close("fact_gap"), "FAIL"), ("dashboard_official_snapshot_present_and_reconciled", "HIGH", "snap_gap", close("snap_gap", 0.0005), "FAIL")]
    lines = money_checks.unionByName(quality.checks_from(row, "dashboard", board))
    return lines.withColumn("observed", F.when(F.col("check_name") == "impact_opportunity_non_negative", F.round("observed", 2)).otherwise(F.col("observed")))


def scoring_checks(t: Tables) -> DataFrame:
    """The risk table against its own formulas, and how stable its first 25 are under other weights."""
    risk = skus(t)
    row = risk.agg(
        F.max(F.abs(F.col("governance_priority_score") - scoring.priority())).alias("formula"), quality.count_rows(F.col("risk_tier") != risk_tier("governance_priority_score")).alias("tier"), quality.count_rows(F.col("main_risk_driver") != argmax(features.DRIVERS)).alias("driver"),
        quality.count_rows((F.col("risk_tier") != "Low") & (F.lower(F.trim("recommended_action")) == "monitor only")).alias("action"),
    )
    keys = ["product_id", "warehouse_id"]
    top = lambda weights: kpis.first(risk.withColumn("s", F.round(scoring.priority(weights), 6)), 25, F.col("s").desc(), *map(F.col, keys)).select(*keys)
    base = top(scoring.PRIORITY)
    overlaps = [base.join(top(w), keys, "left_semi").agg((F.count(F.lit(1)) / 25.0).alias("o")) for w in ((0.30, 0.19, 0.17, 0.16, 0.12, 0.06), (0.20, 0.20, 0.21, 0.16, 0.17, 0.06))]
    row = row.crossJoin(quality.union(overlaps).agg(F.min("o").alias("stability")))  # one row
    stable = quality.checks_from(row, "scoring", [("scoring_formula_consistency", "HIGH", "formula", F.col("formula") <= 0.05, "FAIL"), quality.zero("scoring_tier_consistency", "HIGH", "tier"), quality.zero("scoring_main_driver_consistency", "MEDIUM", "driver"), quality.zero("scoring_action_policy_non_low_not_monitor_only", "HIGH", "action"), ("scoring_top25_stability_under_weight_perturbation", "MEDIUM", "stability", F.col("stability") >= 0.65, "WARN")])
    weak = (F.col("check_name") == "scoring_top25_stability_under_weight_perturbation") & (F.col("observed") < 0.50)
    return stable.withColumn("status", F.when(weak, "FAIL").otherwise(F.col("status"))).withColumn("observed", F.round("observed", 4))


def contract_checks(t: Tables) -> DataFrame:
    row = quality.contract_summary(contracts(t))
    return quality.checks_from(row, "analytics", [quality.zero("data_contract_blocking_failures", "HIGH", "failed"), ("data_contract_warning_sanity", "MEDIUM", "warned", F.col("warned") == 0, "WARN")])


GROUPS = {
    "demand": lambda t: quality.demand_checks(t.demand_history),
    "raw": lambda t: quality.raw_checks(t.inventory_snapshots, t.purchase_orders, t.products, t.suppliers, t.demand_history),
    "daily": lambda t: quality.daily_checks(t.daily, t.demand_history, t.products, skus(t), fact(t)),
    "agreement": agreement,
    "scoring": scoring_checks,
    "contract": contract_checks,
}


def group(t: Tables, name: str) -> DataFrame:
    """The checks of one group; a few rows, kept because every gate and single check reads them."""
    return t.keep(f"checks {name}", lambda: GROUPS[name](t))


def all_checks(t: Tables) -> DataFrame:
    """Every check in one table; the eleven of the raw validation among them."""
    raw = validated(t).select("check_name", F.lit("raw").alias("layer"), F.lit("HIGH").alias("severity"), "status", F.col("issue_count").cast("double").alias("observed"))
    return quality.union([*[group(t, name) for name in GROUPS], raw])


_grain = "(SELECT count(DISTINCT {0}) * count(DISTINCT warehouse_id) * count(DISTINCT product_id) - count(*) FROM {1})"
_S = ["service_risk_score", "stockout_risk_score", "excess_inventory_score", "supplier_risk_score", "working_capital_risk_score", "governance_priority_score"]
_sum = lambda x, n: f"(SELECT {money(x)} FROM {n})"
_weights = lambda w: " + ".join(f"CAST({x} AS DOUBLE) * {c}" for x, c in zip(w, [*_S[:5], "least(service_risk_score, excess_inventory_score)"], strict=True))
_top = lambda w: f"(SELECT product_id, warehouse_id FROM (SELECT product_id, warehouse_id, round(least(greatest({_weights(w)}, 0), 100), 6) AS s FROM sku_risk) ORDER BY s DESC, product_id, warehouse_id LIMIT 25)"
_overlap = lambda w: f"(SELECT count(*) / CAST(25 AS DOUBLE) FROM (SELECT * FROM {_top(scoring.PRIORITY)} INTERSECT SELECT * FROM {_top(w)}))"
# number: (name, layer, severity, observed, condition to pass over o, status otherwise, part of all checks)
_P: dict[str, tuple] = {
    "p01": ("daily_duplicate_keys", "processed", "HIGH", "(SELECT count(*) FROM (SELECT 1 FROM daily GROUP BY date, warehouse_id, product_id HAVING count(*) > 1))"),
    "p02": ("daily_fill_rate_bounds", "processed", "HIGH", "(SELECT count(*) FROM daily WHERE fill_rate < 0 OR fill_rate > 1)"),
    "p03": ("daily_stockout_logic", "processed", "HIGH", "(SELECT count(*) FROM daily WHERE (stockout_flag = 1) <> (units_lost_sales > 0))"),
    "p04": ("sku_score_bounds", "processed", "HIGH", f"(SELECT count(*) FROM sku_risk WHERE {' OR '.join(f'{s} NOT BETWEEN 0 AND 100' for s in _S)})"),
    "p05": ("dashboard_expected_grain", "processed", "HIGH", "abs(" + _grain.format("month", "month_fact") + ")"),
    "p06": ("rowcount_dense_demand_history", "raw", "HIGH", "abs(" + _grain.format("date", "demand_history") + ")"),
    "p07": ("rowcount_daily_equals_demand_history", "processed", "HIGH", "abs((SELECT count(*) FROM daily) - (SELECT count(*) FROM demand_history))"),
    "p08": ("rowcount_sku_risk_expected_grain", "processed", "HIGH", "abs((SELECT count(DISTINCT product_id) * count(DISTINCT warehouse_id) FROM daily) - (SELECT count(*) FROM sku_risk))"),
    "p09": ("duplicates_demand_history", "raw", "HIGH", _dup("demand_history")),
    "p10": ("duplicates_inventory_snapshots", "raw", "HIGH", _dup("inventory_snapshots")),
    "p11": ("duplicates_purchase_orders", "raw", "HIGH", _dup("purchase_orders")),
    "p12": ("duplicates_daily_product_warehouse_metrics", "processed", "HIGH", "(SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM daily GROUP BY date, warehouse_id, product_id))"),
    "p13": ("products_critical_nulls", "raw", "HIGH", _nulls("products", ["product_id", "category", "unit_cost", "unit_price", "supplier_id"])),
    "p14": ("suppliers_critical_nulls", "raw", "HIGH", _nulls("suppliers", ["supplier_id", "supplier_name", "supplier_region"])),
    "p15": ("daily_critical_nulls", "processed", "HIGH", _nulls("daily", ["date", "warehouse_id", "product_id", "units_demanded", "fill_rate", "inventory_value"])),
    "p16": ("sku_risk_critical_nulls", "processed", "HIGH", _nulls("sku_risk", ["product_id", "warehouse_id", "supplier_id", "governance_priority_score", "risk_tier", "main_risk_driver", "recommended_action"])),
    "p17": ("impossible_negative_values", "raw", "CRITICAL", f"{_negs('inventory_snapshots', _STOCK)} + {_negs('demand_history', _UNITS)} + {_negs('purchase_orders', _ORDER)}"),
    "p18": ("fill_rate_logic_bounds_raw", "raw", "CRITICAL", VALIDATION["q06"][1]),
    "p19": ("demand_balance_units", "raw", "CRITICAL", "(SELECT count(*) FROM demand_history WHERE units_fulfilled + units_lost_sales <> units_demanded)"),
    "p20": ("stockout_flag_logic", "raw", "CRITICAL", "(SELECT count(*) FROM demand_history WHERE (stockout_flag = 1) <> (units_lost_sales > 0))"),
    "p21": ("lost_sales_revenue_consistency_daily", "processed", "HIGH", "(SELECT count(*) FROM daily d LEFT JOIN products p ON p.product_id = d.product_id WHERE unit_price IS NULL OR abs(lost_sales_revenue - CAST(units_lost_sales AS DOUBLE) * unit_price) > 0.11)"),
    "p22": ("inventory_value_consistency_raw", "raw", "CRITICAL", _value(0.11)),
    "p23": ("available_units_consistency_raw", "raw", "CRITICAL", VALIDATION["q11"][1]),
    "p24": ("working_capital_proxy_overall_consistency", "impact", "HIGH", f"abs({_sum('trapped_working_capital_proxy', 'valued')} - {_sum('trapped_working_capital_proxy_observed', 'impact_category')})", "o <= 1"),
    "p25": ("excess_inventory_proxy_overall_consistency", "impact", "HIGH", f"abs({_sum('excess_inventory_value_proxy', 'valued')} - {_sum('excess_inventory_value_proxy_observed', 'impact_category')})", "o <= 1"),
    "p26": ("supplier_delay_proxy_consistency", "impact", "HIGH", f"abs({_sum('supplier_delay_impact_proxy', 'valued')} - {_sum('supplier_delay_impact_proxy_observed', 'impact_supplier')})", "o <= 1", "WARN"),
    **{f"p{27 + i}": (f"aggregation_lost_sales_{k}_to_overall", "impact", "HIGH", f"abs({_sum('lost_sales_revenue_observed', f'impact_{k}')} - {_sum('lost_sales_revenue', 'daily')})", "o <= 1") for i, k in enumerate(("sku", "warehouse", "supplier", "category"))},
    "p31": ("impact_opportunity_non_negative", "impact", "HIGH", f"(SELECT round({money('lost_sales_margin_proxy')} * max(factor) * CAST(0.35 AS DOUBLE) + {money('trapped_working_capital_proxy')} * max(factor) * CAST(0.25 AS DOUBLE), 2) FROM valued, annual)", "o >= 0"),
    "p32": ("denominator_zero_demand_with_activity_raw", "raw", "CRITICAL", VALIDATION["q10"][1]),
    "p33": ("denominator_zero_demand_with_activity_daily", "processed", "CRITICAL", f"(SELECT count(*) FROM daily WHERE {_ZERO})"),
    "p34": ("scoring_formula_consistency", "scoring", "HIGH", f"(SELECT round(max(abs(governance_priority_score - least(greatest({_weights(scoring.PRIORITY)}, 0), 100))), 4) FROM sku_risk)", "o <= 0.05"),
    "p35": ("scoring_tier_consistency", "scoring", "HIGH", f"(SELECT count(*) FROM sku_risk WHERE risk_tier <> {TIER.format('governance_priority_score')})"),
    "p36": ("scoring_main_driver_consistency", "scoring", "MEDIUM", f"(SELECT count(*) FROM sku_risk WHERE main_risk_driver <> {driver()})"),
    "p37": ("scoring_action_policy_non_low_not_monitor_only", "scoring", "HIGH", "(SELECT count(*) FROM sku_risk WHERE risk_tier <> 'Low' AND lower(trim(recommended_action)) = 'monitor only')"),
    "p38": ("scoring_top25_stability_under_weight_perturbation", "scoring", "MEDIUM", f"round(least({_overlap((0.30, 0.19, 0.17, 0.16, 0.12, 0.06))}, {_overlap((0.20, 0.20, 0.21, 0.16, 0.17, 0.06))}), 4)", "o >= 0.65", "WARN"),
    "p39": ("data_contract_blocking_failures", "analytics", "HIGH", f"(SELECT count(*) FROM ({_contract_sql()}) WHERE status = 'FAIL')"),
    "p40": ("data_contract_warning_sanity", "analytics", "MEDIUM", f"(SELECT count(*) FROM ({_contract_sql()}) WHERE status = 'WARN')", "o = 0", "WARN"),
    "p41": ("dashboard_metric_reconciliation", "dashboard", "HIGH", " + ".join([f"abs((SELECT sum({u}) FROM daily) - (SELECT sum({u}) FROM month_fact))" for u in _UNITS] + [f"abs({_sum(x, 'daily')} - {_sum(x, 'month_fact')})" for x in ("lost_sales_revenue", "inventory_value")]), "o <= 1"),
    "p42": ("dashboard_official_snapshot_present_and_reconciled", "dashboard", "HIGH", f"greatest(abs((SELECT {FILL} FROM daily) - (SELECT {FILL} FROM month_fact)), abs((SELECT {LOSS} FROM daily) - (SELECT {LOSS} FROM month_fact)))", "o <= 0.0005"),
}


def _p_line(name: str, layer: str, severity: str, sql: str, ok: str = "o = 0", bad: str = "FAIL") -> str:
    low = "WHEN o < 0.5 THEN 'FAIL' " if name.startswith("scoring_top25") else ""
    return f"SELECT '{name}' AS check_name, '{layer}' AS layer, '{severity}' AS severity, CASE WHEN {ok} THEN 'PASS' {low}ELSE '{bad}' END AS status, o AS observed FROM (SELECT CAST({sql} AS DOUBLE) AS o)"


_OF = {**dict.fromkeys(("p06", "p09", "p18", "p19", "p20", "p32"), "demand"), **dict.fromkeys(("p10", "p11", "p13", "p14", "p17", "p22", "p23"), "raw"), **dict.fromkeys(("p01", "p02", "p03", "p04", "p05", "p07", "p08", "p12", "p15", "p16", "p21", "p33"), "daily"), **dict.fromkeys([f"p{i}" for i in (*range(24, 32), 41, 42)], "agreement"), **dict.fromkeys([f"p{i}" for i in range(34, 39)], "scoring"), **dict.fromkeys(("p39", "p40"), "contract")}
for _id, _spec in _P.items():
    register(f"{_id}_{_spec[0]}", lambda t, g=_OF[_id], n=_spec[0]: group(t, g).filter(F.col("check_name") == n), _p_line(*_spec))

#: Words that claim causes, and words that hedge (fixed values).
CAUSAL, HEDGING = r"(?i)\b(caused|proves|guarantees|certainly|always|directly attributable)\b", r"(?i)\b(proxy|estimated|signal|directional|assumption|caveat|likely)\b"


def overclaiming(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Causal and hedging words over all texts, and a warning where causes are claimed more often than hedged."""
    count = lambda p: F.coalesce(F.sum(F.regexp_count(F.col(text_col), F.lit(p))), F.lit(0)).cast("long")
    row = texts.agg(count(CAUSAL).alias("causal_terms"), count(HEDGING).alias("hedging_terms"))
    return row.withColumn("status", F.when(F.col("causal_terms") > F.col("hedging_terms"), "WARN").otherwise("PASS"))


#: What a summary's sentences look like, one figure each (fixed values): check, severity, pattern, factor to its unit, figure, tolerance, status otherwise.
STATEMENTS = (
    ("executive_summary_fill_rate_consistency", "HIGH", r"Overall fill rate is \*\*([0-9]+\.[0-9]+)%\*\*", 0.01, "overall_fill_rate", 0.001, "FAIL"),
    ("executive_summary_stockout_rate_consistency", "HIGH", r"\*\*([0-9]+\.[0-9]+)%\*\* unit stockout rate", 0.01, "overall_stockout_rate", 0.001, "FAIL"),
    ("executive_summary_lost_sales_consistency", "MEDIUM", r"Lost sales exposure is \*\*EUR ([0-9.]+)M\*\*", 1e6, "total_lost_sales_revenue", 200_000.0, "WARN"),
)


def report_checks(texts: DataFrame, health: DataFrame, text_col: str = "text") -> DataFrame:
    """Figures that texts state against the one row of ``health``, all in one pass; observed is the largest gap, null where no text states it.

    A figure that no text states is not confirmed: its check does not pass. One that some text states wrongly neither.
    """
    stated = {s[0]: F.try_to_number(F.regexp_extract(F.col(text_col), s[2], 1), F.lit("999999999999.999999")).cast("double") * s[3] for s in STATEMENTS}
    ends = texts.agg(*[f(x).alias(f"{n}_{k}") for n, x in stated.items() for k, f in (("low", F.min), ("high", F.max))])
    row = ends.crossJoin(health)  # one row each
    gaps = {s[0]: F.greatest(F.abs(F.col(f"{s[0]}_low") - F.col(s[4])), F.abs(F.col(f"{s[0]}_high") - F.col(s[4]))) for s in STATEMENTS}
    return quality.checks_from(row.withColumns(gaps), "reporting", [(n, severity, n, F.coalesce(F.col(n) <= tolerance, F.lit(False)), bad) for n, severity, _, _, _, tolerance, bad in STATEMENTS])


def _stated_sql(name: str, severity: str, pattern: str, factor: float, figure: str, tolerance: float, bad: str) -> str:
    actual = {"overall_fill_rate": FILL, "overall_stockout_rate": LOSS, "total_lost_sales_revenue": money("lost_sales_revenue")}[figure]
    return f"SELECT '{name}' AS check_name, 'reporting' AS layer, '{severity}' AS severity, CASE WHEN coalesce(o <= {tolerance}, false) THEN 'PASS' ELSE '{bad}' END AS status, o AS observed FROM (SELECT max(abs(x - a)) AS o FROM (SELECT TRY_CAST(regexp_extract(text, '{pattern}', 1) AS DOUBLE) * {factor} AS x FROM documents), (SELECT {actual} AS a FROM daily))"


for _number, _statement in zip((43, 44, 45), STATEMENTS, strict=True):
    DOUBLES[f"p{_number}_{_statement[0]}"] = "observed"
    register(f"p{_number}_{_statement[0]}", lambda t, n=_statement[0]: t.keep("report checks", lambda: report_checks(t.read("documents"), kpis.service_health(t.daily))).filter(F.col("check_name") == n), _stated_sql(*_statement))


def stated_rate(texts: DataFrame, pattern: str, actual: DataFrame, tolerance: float, scale: float = 1.0) -> DataFrame:
    """The number that texts state (group 1 of a pattern) against a one-row figure: value, actual, status."""
    found = F.try_to_number(F.regexp_replace(F.regexp_extract("text", pattern, 1), ",", ""), F.lit("999999999999.999999")).cast("double") / scale
    stated = texts.agg(F.max(found).alias("stated"))
    row = stated.crossJoin(actual.toDF("actual"))  # one row each
    return row.withColumn("status", F.when(F.abs(F.col("stated") - F.col("actual")) <= tolerance, "PASS").otherwise("FAIL"))


_re2 = lambda p: f"CAST(coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS BIGINT)"
register("p46_written_conclusion_overclaiming_risk", lambda t: overclaiming(t.read("documents")), f"SELECT *, CASE WHEN causal_terms > hedging_terms THEN 'WARN' ELSE 'PASS' END AS status FROM (SELECT {_re2(CAUSAL)} AS causal_terms, {_re2(HEDGING)} AS hedging_terms FROM documents)")

_CHECKS = " UNION ALL ".join([*[_p_line(*s) for s in _P.values()], f"SELECT check_name, 'raw', 'HIGH', status, CAST(issue_count AS DOUBLE) FROM ({_VALIDATION})"])
part("x_checks", _CHECKS)
register("g01_unified_checks", all_checks, "SELECT * FROM x_checks")
_n = lambda where: f"count(*) FILTER (WHERE {where})"
_HARD = "severity IN ('BLOCKER', 'CRITICAL', 'HIGH')"
part("x_counts", f"SELECT {_n('''status = 'FAIL' AND layer IN ('raw', 'processed', 'dashboard', 'scoring')''')} AS technical, {_n('''status = 'FAIL' AND layer IN ('impact', 'scoring', 'reporting', 'dashboard')''')} AS analytical, {_n(f'''status = 'FAIL' AND {_HARD}''')} AS hard_fail, {_n('''status = 'FAIL' AND severity IN ('BLOCKER', 'CRITICAL')''')} AS blocker_fail_count, {_n('''status = 'FAIL' AND severity = 'HIGH' ''')} AS high_fail_count, {_n(f'''status = 'WARN' AND {_HARD}''')} AS high_warn_count FROM x_checks")
part("x_states", "SELECT *, technical = 0 AS valid, technical = 0 AND analytical = 0 AND high_warn_count = 0 AS accepted, technical > 0 OR hard_fail > 0 OR high_warn_count > 0 AS blocked FROM x_counts")
register(
    "g02_release_states",
    lambda t: gates.release_states(all_checks(t)),
    " UNION ALL ".join(
        f"SELECT '{k}' AS state_name, CASE WHEN {v} THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN blocked THEN 'publish-blocked' WHEN accepted THEN 'decision-support only' WHEN valid THEN 'screening-grade only' ELSE 'not-classified' END AS release_classification, blocker_fail_count, high_fail_count, high_warn_count FROM x_states"
        for k, v in (("technically_valid", "valid"), ("analytically_acceptable", "accepted"), ("decision_support_only", "accepted"), ("screening_grade_only", "valid AND NOT accepted"), ("not_committee_grade", "true"), ("publish_blocked", "blocked"))
    ),
)
_W = "CASE severity WHEN 'CRITICAL' THEN 35 WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 10 WHEN 'LOW' THEN 5 ELSE 10 END"
register("g03_confidence_score", lambda t: gates.confidence(all_checks(t)), f"SELECT s AS confidence_score, CASE WHEN s >= 90 THEN 'High' WHEN s >= 75 THEN 'Moderate-High' WHEN s >= 60 THEN 'Moderate' ELSE 'Low' END AS band FROM (SELECT CAST(greatest(100 - coalesce(sum(CASE status WHEN 'FAIL' THEN {_W} WHEN 'WARN' THEN floor({_W} * 0.4) ELSE 0 END), 0), 0) AS BIGINT) AS s FROM x_checks)")
register("g04_gate_summary", lambda t: gates.gate(all_checks(t)), "SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'FAIL') AS fails, count(*) FILTER (WHERE status = 'WARN') AS warns, count(*) FILTER (WHERE status <> 'PASS') AS not_passed, count(*) FILTER (WHERE status IN ('FAIL', 'WARN') AND severity IN ('BLOCKER', 'CRITICAL', 'HIGH')) > 0 OR count(*) = 0 AS publish_blocked FROM x_checks")
