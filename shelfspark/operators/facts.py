"""Chart data, the monthly fact, and its slices by facets, month range and scenario."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.expressions import day_bit, dbl, exact_sum, fill_ratio, loss_ratio, money_mean, money_sum, money_total, month_of, range_norm, ratio
from shelfspark.operators.kpis import UNITS, by_amount, first
from shelfspark.plans.digests import content_digest
from shelfspark.plans.selection import exact_quantiles

DIMENSIONS = ("month", "region", "warehouse_id", "product_id", "category", "supplier_id", "abc_class")
_CENTS = ("lost_sales_revenue", "inventory_value", "excess_inventory_proxy", "slow_moving_proxy", "trapped_wc_proxy", "lost_sales_margin_proxy")

# -- charts -----------------------------------------------------------------------------------------------------------


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"fill_rate": fill_ratio("units_fulfilled", "units_demanded"), "stockout_rate": loss_ratio("units_lost_sales", "units_demanded")})


def trend(daily: DataFrame) -> DataFrame:
    return _rates(daily.groupBy(month_of().alias("month")).agg(*[F.sum(u).alias(u) for u in UNITS], money_sum("lost_sales_revenue").alias("lost_sales_revenue")))


def fill_by_category(daily: DataFrame) -> DataFrame:
    return daily.groupBy("category").agg(*[F.sum(u).alias(u) for u in UNITS[:2]]).withColumn("fill_rate", fill_ratio("units_fulfilled", "units_demanded"))


def lost_by_region(daily: DataFrame) -> DataFrame:
    return daily.groupBy("region").agg(money_sum("lost_sales_revenue").alias("lost_sales_revenue"))


def category_shares(daily: DataFrame) -> DataFrame:
    """Share and running share of stock value by category, the largest first. Categories are few."""
    sums = daily.groupBy("category").agg(money_mean("inventory_value").alias("avg_inventory_value"), money_sum("inventory_value").alias("total_inventory_value"))
    total = sums.agg(F.sum(F.col("total_inventory_value").cast("decimal(24,6)")).cast("double").alias("whole"))
    order = Window.orderBy(F.col("total_inventory_value").desc(), "category")
    running = F.sum(F.col("total_inventory_value").cast("decimal(24,6)")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    return sums.crossJoin(F.broadcast(total)).select("category", "avg_inventory_value", "total_inventory_value", ratio("total_inventory_value", "whole", None).alias("inventory_share"), ratio(running, "whole", None).alias("cumulative_share"))  # one row


def category_region(daily: DataFrame) -> DataFrame:
    grouped = daily.groupBy("category", "region").agg(*[F.sum(u).alias(u) for u in UNITS[:2]], money_mean("inventory_value").alias("avg_inventory_value"), money_sum("lost_sales_revenue").alias("lost_sales_revenue"))
    return grouped.withColumn("fill_rate", fill_ratio("units_fulfilled", "units_demanded"))


def sku_ranking(risk: DataFrame, products: DataFrame) -> DataFrame:
    named = risk.join(products.select("product_id", "product_name"), "product_id", "left")
    return named.select("product_id", "warehouse_id", F.coalesce("product_name", "product_id").alias("product_name"), F.concat("product_id", F.lit(" | "), "warehouse_id").alias("sku_label"), "governance_priority_score", "risk_tier", "main_risk_driver")


def excess_by_category(risk: DataFrame) -> DataFrame:
    """Value sum times mean excess rate; the sum is of all stock value, as the name does not say."""
    sums = risk.groupBy("category").agg(F.sum(F.col("inventory_value_sum").cast("decimal(24,6)")).cast("double").alias("excess_inventory_value_proxy"), F.avg("excess_day_rate").alias("avg_excess_rate"))
    return sums.withColumn("excess_exposure_proxy", F.col("excess_inventory_value_proxy") * F.round("avg_excess_rate", 9))


def top_slow_moving(risk: DataFrame, n: int = 15) -> DataFrame:
    pairs = risk.groupBy("product_id", "warehouse_id").agg(money_sum(F.col("inventory_value_sum") * F.col("slow_moving_rate")).alias("slow_moving_value_proxy"), F.avg("slow_moving_rate").alias("slow_moving_rate"))
    top = first(pairs, n, by_amount("slow_moving_value_proxy"), F.col("product_id"), F.col("warehouse_id"))
    return top.withColumn("sku_label", F.concat("product_id", F.lit(" | "), "warehouse_id"))


def supplier_heat(suppliers: DataFrame, floor: float, n: int | None = None) -> DataFrame:
    """Supplier signals, each over its largest (at least ``floor``); of the ``n`` riskiest where given."""
    if n is not None:
        suppliers = first(suppliers, n, F.round("supplier_service_risk_proxy", 6).desc(), F.col("supplier_id"))
    signals = {"avg_delay_norm": "average_delay_days", "lt_variability_norm": "lead_time_variability", "risk_proxy_norm": "supplier_service_risk_proxy"}
    tops = suppliers.agg(*[F.greatest(F.max(x), F.lit(floor)).alias(f"top_{n_}") for n_, x in signals.items()])
    return suppliers.crossJoin(F.broadcast(tops)).select("supplier_id", "supplier_name", (1.0 - F.col("on_time_delivery_rate")).alias("otd_gap"), *[(F.col(x) / F.col(f"top_{n_}")).alias(n_) for n_, x in signals.items()])  # one row


def days_histogram(daily: DataFrame, bins: int = 60) -> DataFrame:
    """Equal bins from the least to the most days of supply, with the 90th and 99th percentile on each row."""
    days = F.col("days_of_supply")
    p90, p99 = exact_quantiles(daily, {"days_of_supply": [0.9, 0.99]})[()]["days_of_supply"]
    edges = daily.agg(F.min(days).alias("low"), F.max(days).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.least(F.floor((days - F.col("low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    placed = daily.select("days_of_supply").crossJoin(F.broadcast(edges)).withColumn("bin", F.coalesce(place, F.lit(0)))  # one row
    counted = placed.groupBy("bin", "low", "high").agg(F.count(F.lit(1)).alias("days"))
    return counted.select("bin", (F.col("low") + F.col("bin") * width).alias("bin_start"), "days", F.lit(p90).cast("double").alias("p90"), F.lit(p99).cast("double").alias("p99"))


def quadrant(df: DataFrame, key: str, fill: str, value: str, middle: str = "median") -> DataFrame:
    """Places on a service and stock quadrant with its two lines, medians or means."""
    if middle == "median":
        points = exact_quantiles(df, {fill: [0.5], value: [0.5]})[()]
        return df.select(key, fill, value, *[F.lit(points[c][0]).cast("double").alias(n) for c, n in ((fill, "fill_line"), (value, "value_line"))])
    lines = df.agg(F.avg(fill).alias("fill_line"), F.avg(value).alias("value_line"))
    return df.select(key, fill, value).crossJoin(F.broadcast(lines))  # one row


# -- monthly fact -----------------------------------------------------------------------------------------------------


def daily_proxies(valued: DataFrame) -> DataFrame:
    """The amounts of the impact model under the names of the monthly fact."""
    names = {"excess_inventory_proxy": "excess_inventory_value_proxy", "slow_moving_proxy": "slow_moving_value_proxy", "trapped_wc_proxy": "trapped_working_capital_proxy"}
    return valued.select("date", "region", "warehouse_id", "product_id", "category", "supplier_id", "abc_class", *UNITS, "lost_sales_revenue", "inventory_value", "days_of_supply", *[F.col(v).alias(k) for k, v in names.items()], "lost_sales_margin_proxy")


def _cents(x: str) -> Column:
    return F.round(exact_sum(x), 2).cast("double")


def monthly_fact(proxies: DataFrame) -> DataFrame:
    """One row for each month and product, warehouse and their attributes; amounts to the cent. Days are counted as bits."""
    grouped = proxies.groupBy(month_of().alias("month"), *DIMENSIONS[1:]).agg(
        *[F.sum(u).alias(u) for u in UNITS], *[_cents(x).alias(x) for x in _CENTS], F.round(F.avg("days_of_supply").cast("decimal(18,6)"), 2).cast("double").alias("avg_days_of_supply"), F.bit_count(F.bit_or(day_bit())).cast("long").alias("observation_days")
    )
    return grouped.withColumn("stockout_month_flag", (F.col("units_lost_sales") > 0).cast("int"))


def risk_extract(risk: DataFrame) -> DataFrame:
    scores = [n for n in risk.columns if n.endswith("_score")]
    return risk.select("product_id", "warehouse_id", "supplier_id", *[F.round(F.col(n) + 1e-10, 4).alias(n) for n in scores], "risk_tier", "main_risk_driver", "recommended_action")


def snapshot(health: DataFrame, overall: DataFrame) -> DataFrame:
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    return health.select("overall_fill_rate", "overall_stockout_rate", "total_lost_sales_revenue").crossJoin(overall.agg(pick("trapped_working_capital_proxy_observed"), pick("opportunity_total_12m_proxy")))  # one row each


def facet_values(fact: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """dimension and value: what each dimension can be filtered by."""
    long = fact.select(F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])))
    return long.filter("value is not null and value <> ''").distinct()


def dictionary(fact: DataFrame) -> DataFrame:
    """dimension, code (from 0, in order of value) and value. A dimension's values are numbered in one task."""
    return facet_values(fact).withColumn("code", F.row_number().over(Window.partitionBy("dimension").orderBy("value")) - 1)


def coded(fact: DataFrame, codes: DataFrame) -> DataFrame:
    """The fact with codes in place of the values of its dimensions (null where it has none)."""
    for d in DIMENSIONS:
        mine = codes.filter(F.col("dimension") == d).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        fact = fact.join(mine, fact[d].cast("string") == F.col("_value"), "left").withColumn(d, F.col("_code")).drop("_value", "_code")
    return fact


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows, and the exclusive or and sum of a hash of each row: the same for any order of rows."""
    return content_digest(df, columns)


@dataclass(frozen=True)
class Slice:
    """Facets to filter by (dimension -> value; "ALL" and absent ones do not filter) and a month range in any order."""

    facets: dict[str, str] = field(default_factory=dict)
    months: tuple[date, date] | None = None

    def dimensions(self) -> set[str]:
        """The dimensions that the facets filter by."""
        named = {d for d, value in self.facets.items() if value != "ALL"}
        if unknown := named - set(DIMENSIONS):
            raise ValueError(f"no such facets: {', '.join(sorted(unknown))}")
        return named

    def of(self, fact: DataFrame) -> DataFrame:
        """The rows of a fact or of cube cells; values and bounds are parameters of the statement."""
        args = {d: self.facets[d] for d in sorted(self.dimensions())}
        conditions = [f"{d} = :{d}" for d in args]
        if self.months:
            args |= {"first_month": min(self.months), "last_month": max(self.months)}
            conditions.append("month BETWEEN :first_month AND :last_month")
        return fact.sparkSession.sql(f"SELECT * FROM {{rows}} WHERE {' AND '.join(conditions)}", args=args, rows=fact) if conditions else fact


#: Dimensions of the cube, each alone or with what it decides (a warehouse has one region).
CUBE = (("region", "warehouse_id"), ("category",), ("supplier_id",), ("abc_class",))
CUBE_COLUMNS = ["month", *[c for group in CUBE for c in group]]
_CUBED = (*_CENTS, "extra_slow", "day_weight")


def measured(fact: DataFrame) -> DataFrame:
    """The fact with what its slices need beside its columns: slow-moving value beyond excess, and days weighted by rows."""
    extra = F.greatest(F.col("slow_moving_proxy") - F.col("excess_inventory_proxy"), F.lit(0.0))
    return fact.withColumns({"extra_slow": extra, "day_weight": F.col("avg_days_of_supply") * F.col("observation_days")})


def cuboids() -> list[list[str]]:
    """The column lists of all roll-ups: month with each choice of none or one level of every group of ``CUBE``."""
    levels = [[group[:n] for n in range(len(group) + 1)] for group in CUBE]
    return [["month", *[c for level in choice for c in level]] for choice in product(*levels)]


def _merging(first: bool) -> list[Column]:
    """Sums of a cell, from the fact (``first``) or from finer cells."""
    return [F.sum(u).alias(u) for u in (*UNITS, "observation_days")] + [F.sum(F.col(x).cast("decimal(18,6)") if first else F.col(x)).alias(x) for x in _CUBED]


def roll_up(fact: DataFrame, columns: list[str]) -> DataFrame:
    """The cells of one roll-up, straight from the monthly fact."""
    return measured(fact).groupBy(*columns).agg(*_merging(True))


def facet_cube(fact: DataFrame) -> DataFrame:
    """Cells of every roll-up of the monthly fact over its facets, products left out: sums that merge.

    Cells of all facets come first, and the roll-ups from these, so rows are multiplied by the number of roll-ups only
    when products are summed already. ``cuboid`` tells which columns a cell has (a bit for each that it has not).
    """
    cells = roll_up(fact, CUBE_COLUMNS)
    sets = [[F.col(c) for c in columns] for columns in cuboids()]
    return cells.groupingSets(sets, *[F.col(c) for c in CUBE_COLUMNS]).agg(F.grouping_id().cast("int").alias("cuboid"), *_merging(False))


def slice_rows(cube: DataFrame, fact: DataFrame, shown: Slice, keys: set[str] = frozenset()) -> DataFrame:
    """What a slice grouped by ``keys`` is summed from: cube cells, or the fact where it needs a product."""
    needed = {*keys, *shown.dimensions()}
    return shown.of(cells(cube, needed) if needed <= set(CUBE_COLUMNS) else fact)


def smallest(needed: set[str]) -> list[str]:
    """The columns of the smallest roll-up that has those ``needed``."""
    return min((c for c in cuboids() if needed <= set(c)), key=len)


def cells(cube: DataFrame, needed: set[str]) -> DataFrame:
    """The cells of the smallest roll-up that has the columns ``needed``; written by cuboid, only these are read."""
    chosen = smallest(needed)
    missing = sum(1 << i for i, c in enumerate(reversed(CUBE_COLUMNS)) if c not in chosen)
    return cube.filter(F.col("cuboid") == missing)


_SUMS = {"demand": "units_demanded", "fulfilled": "units_fulfilled", "lost": "units_lost_sales"}


def _summed(fact: DataFrame, keys: list[str], amounts: dict[str, str], weighted_days: bool = False, *others: Column) -> DataFrame:
    fact = fact if "day_weight" in fact.columns else measured(fact)
    more = [(money_total("day_weight") / F.nullif(F.sum("observation_days"), F.lit(0))).alias("avg_dos")] if weighted_days else []
    grouped = fact.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in _SUMS.items()], *[money_total(v).alias(k) for k, v in amounts.items()], *more, *others)
    return grouped.withColumns({"fill_rate": fill_ratio("fulfilled", "demand"), "stockout_rate": loss_ratio("lost", "demand")})


_BASE = {"lost_sales": "lost_sales_revenue", "inventory": "inventory_value"}
_EXCESS = {"excess": "excess_inventory_proxy", "trapped": "trapped_wc_proxy"}


def slice_totals(fact: DataFrame, margin_rate: float = 0.35, release_rate: float = 0.25, slow_weight: float = 0.5) -> DataFrame:
    """One row of totals and of what a scenario could recover. Trapped value is taken on monthly sums here."""
    row = _summed(fact, [], _BASE | _EXCESS | {"extra": "extra_slow", "slow": "slow_moving_proxy", "lost_margin": "lost_sales_margin_proxy"})
    row = row.withColumn("trapped_scenario", F.col("excess") + slow_weight * F.col("extra")).drop("extra")
    return row.withColumn("scenario_opportunity_12m", F.col("lost_margin") * margin_rate + F.col("trapped_scenario") * release_rate)


def by_month(fact: DataFrame) -> DataFrame:
    return _summed(fact, ["month"], _BASE)


def by_warehouse(fact: DataFrame, warehouses: DataFrame) -> DataFrame:
    named = F.broadcast(warehouses.select("warehouse_id", "warehouse_name"))
    return _summed(fact, ["warehouse_id", "region"], _BASE, weighted_days=True).join(named, "warehouse_id", "left").withColumn("warehouse_name", F.coalesce("warehouse_name", "warehouse_id"))


def by_category(fact: DataFrame) -> DataFrame:
    return _summed(fact, ["category"], _BASE | _EXCESS, weighted_days=True)


def by_region(fact: DataFrame) -> DataFrame:
    return _summed(fact, ["region"], _BASE)


def by_supplier(fact: DataFrame, performance: DataFrame) -> DataFrame:
    record = ["on_time_delivery_rate", "average_delay_days", "lead_time_variability", "supplier_service_risk_proxy"]
    joined = _summed(fact, ["supplier_id"], _BASE).join(performance.select("supplier_id", "supplier_name", *record), "supplier_id", "left")
    return joined.withColumn("supplier_name", F.coalesce("supplier_name", "supplier_id")).na.fill(0.0, record)


def by_segment(fact: DataFrame) -> DataFrame:
    return _summed(fact, ["category", "region"], _BASE, weighted_days=True).withColumn("segment", F.concat("category", F.lit("|"), "region"))


def by_sku(fact: DataFrame, risk: DataFrame, products: DataFrame) -> DataFrame:
    """SKU-locations of a slice with persistence and governed scores (0, Low and Service Risk where unscored)."""
    keys = ["product_id", "warehouse_id", "supplier_id", "category", "region", "abc_class"]
    joined = _summed(fact, keys, _BASE | _EXCESS, True, F.avg(dbl("stockout_month_flag")).alias("stockout_persistence"))
    scores = risk_extract(risk)
    out = joined.join(scores, ["product_id", "warehouse_id", "supplier_id"], "left").join(products.select("product_id", "product_name"), "product_id", "left")
    numbers = [c for c in scores.columns if c.endswith("_score")]
    return out.na.fill(0.0, numbers).na.fill({"risk_tier": "Low", "main_risk_driver": "Service Risk", "recommended_action": "review planning assumptions"}).withColumn("product_name", F.coalesce("product_name", "product_id"))


def weighted_otd(suppliers: DataFrame) -> DataFrame:
    return suppliers.agg((F.sum(F.col("on_time_delivery_rate") * F.col("demand")) / F.greatest(F.sum("demand"), F.lit(1))).alias("weighted_supplier_otd"))


def posture(totals: DataFrame, skus: DataFrame) -> DataFrame:
    """Share of balanced SKU-locations and the slice's posture."""
    fine = (F.col("fill_rate") >= 0.97) & F.col("avg_dos").between(8, 35)
    row = totals.crossJoin(skus.agg((F.count_if(fine) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("balanced_share")))  # one row each
    state = F.when((F.col("fill_rate") < 0.95) & (F.col("balanced_share") < 0.35), "critical").when((F.col("stockout_rate") > 0.05) | (F.col("excess") > F.col("inventory") * 0.18), "watch").otherwise("stable")
    return row.select("balanced_share", state.alias("posture"))


def _pick(df: DataFrame, name: Column, by: Column, largest: bool = True) -> DataFrame:
    """One row: the name with the largest (or smallest) figure, ties to the first name."""
    key = F.round(by + 1e-10, 6)
    return df.select(name.cast("string").alias("n"), (-key if largest else key).alias("v")).agg(F.min(F.struct("v", "n")).alias("x")).select(F.col("x.n").alias("pick"))


def _picks(parts: list[tuple[str, DataFrame]], label: str) -> DataFrame:
    out = None
    for place, (name, df) in enumerate(parts, 1):
        row = df.select(F.lit(place).alias("place"), F.lit(name).alias(label), "pick")
        out = row if out is None else out.unionByName(row)
    return out


def _sku_name() -> Column:
    return F.concat("product_id", F.lit(" @ "), "warehouse_id")


def callouts(skus: DataFrame, suppliers: DataFrame, warehouses: DataFrame, categories: DataFrame, segments: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` of five picks that a reader should start with."""
    strain = (1.0 - F.col("fill_rate")) * 0.65 + range_norm("avg_dos", 20.0, 70.0) * 0.35
    parts = [
        ("Priority 1", _pick(skus, _sku_name(), F.col("governance_priority_score"))), ("Supplier escalation", _pick(suppliers, F.col("supplier_id"), F.col("stockout_rate") * F.col("lost_sales"))), ("Warehouse pressure", _pick(warehouses, F.col("warehouse_id"), F.col("fill_rate"), False)),
        ("Capital concentration", _pick(categories, F.col("category"), F.col("excess"))), ("Trade-off lens", _pick(segments, F.col("segment"), strain)),
    ]
    return _picks(parts[:n], "eyebrow").filter("pick is not null")


def narrative(skus: DataFrame, suppliers: DataFrame, warehouses: DataFrame, categories: DataFrame) -> DataFrame:
    parts = [
        ("top_sku", _pick(skus, _sku_name(), F.col("governance_priority_score"))), ("supplier_by_exposure", _pick(suppliers, F.col("supplier_id"), F.col("stockout_rate") * F.col("lost_sales"))), ("supplier_by_stockout", _pick(suppliers, F.col("supplier_id"), F.col("stockout_rate"))),
        ("warehouse_by_lost_sales", _pick(warehouses, F.col("warehouse_id"), F.col("lost_sales"))), ("warehouse_by_fill", _pick(warehouses, F.col("warehouse_id"), F.col("fill_rate"), False)), ("category_by_excess", _pick(categories, F.col("category"), F.col("excess"))),
    ]
    return _picks(parts, "fact")


def tiles(totals: DataFrame, skus: DataFrame, otd: DataFrame) -> DataFrame:
    """Eight key figures with their tone."""
    row = totals.crossJoin(otd).crossJoin(skus.agg(F.count_if(F.col("risk_tier").isin("High", "Critical")).alias("risky")))  # one row each

    def tone(good: Column, fair: Column | None, names: tuple[str, str, str]) -> Column:
        out = F.when(good, names[0])
        return (out.when(fair, names[1]) if fair is not None else out).otherwise(names[2])

    three = ("positive", "watch", "critical")
    c = F.col
    figures = [
        ("Fill Rate", c("fill_rate"), tone(c("fill_rate") >= 0.97, c("fill_rate") >= 0.95, three)), ("Stockout Rate", c("stockout_rate"), tone(c("stockout_rate") <= 0.02, c("stockout_rate") <= 0.05, three)),
        ("Lost Sales Value", c("lost_sales"), tone(c("lost_sales") <= 500000, None, ("neutral", "", "critical"))), ("12M Opportunity", c("scenario_opportunity_12m"), F.lit("positive")),
        ("Working Capital at Risk", c("trapped"), tone(c("trapped") <= c("inventory") * 0.12, None, ("neutral", "", "watch"))), ("Excess Inventory", c("excess"), tone(c("excess") <= c("inventory") * 0.08, None, ("positive", "", "watch"))),
        ("Supplier OTD", c("weighted_supplier_otd"), tone(c("weighted_supplier_otd") >= 0.92, c("weighted_supplier_otd") >= 0.88, three)), ("High-Risk SKU Count", c("risky").cast("double"), tone(c("risky") <= 20, c("risky") <= 50, three)),
    ]
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("label"), v.alias("value"), t.alias("tone")) for n, v, t in figures])))


def detail(skus: DataFrame, query: str = "", key: str = "governance_priority_score", descending: bool = True, n: int = 250) -> DataFrame:
    """SKU-locations whose text contains ``query``, in the order of one column, at most ``n``."""
    blob = F.lower(F.concat_ws(" ", "product_id", "product_name", "warehouse_id", "supplier_id", "main_risk_driver", "recommended_action"))
    found = skus.filter(F.contains(blob, F.lit(query.lower().strip()))) if query.strip() else skus
    order = F.round(key, 6) if dict(skus.dtypes)[key] == "double" else F.col(key)
    return first(found, n, order.desc_nulls_last() if descending else order.asc_nulls_last(), F.col("product_id"), F.col("warehouse_id"), F.col("supplier_id"))


def reconciled(snap: DataFrame, totals: DataFrame) -> DataFrame:
    """Whether a slice agrees with the official snapshot: rates to 0.0005, lost sales to 1."""
    row = snap.crossJoin(totals.select("fill_rate", "stockout_rate", "lost_sales"))  # one row each
    diffs = {"fill_diff": ("overall_fill_rate", "fill_rate"), "stockout_diff": ("overall_stockout_rate", "stockout_rate"), "lost_diff": ("total_lost_sales_revenue", "lost_sales")}
    row = row.select(*[F.abs(F.col(a) - F.col(b)).alias(n) for n, (a, b) in diffs.items()])
    return row.withColumn("mismatch", (F.col("fill_diff") > 0.0005) | (F.col("stockout_diff") > 0.0005) | (F.col("lost_diff") > 1))


def is_empty(fact: DataFrame) -> DataFrame:
    return fact.agg((F.count(F.lit(1)) == 0).alias("is_empty"))


def ranked_lists(warehouses: DataFrame, categories: DataFrame, regions: DataFrame, suppliers: DataFrame, skus: DataFrame) -> DataFrame:
    """list, place and id of the ordered lists of a slice; supplier and warehouse lists by stockout end at 12, SKUs at 15."""

    def one(name: str, df: DataFrame, ident: Column, by: Column, descending: bool, n: int | None) -> DataFrame:
        key = F.round(by + 1e-10, 6)
        rows = df.select(F.lit(name).alias("list"), ident.alias("id"), (-key if descending else key).alias("k"))
        placed = (rows.orderBy("k", "id").limit(n) if n else rows).withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy("k", "id")))
        return placed.select("list", "place", "id")

    c = F.col
    lists = [
        one("warehouses_by_fill", warehouses, c("warehouse_id"), c("fill_rate"), False, None), one("categories_by_fill", categories, c("category"), c("fill_rate"), False, None), one("regions_by_lost_sales", regions, c("region"), c("lost_sales"), True, None),
        one("suppliers_by_otd", suppliers, c("supplier_id"), c("on_time_delivery_rate"), False, None), one("suppliers_by_variability", suppliers, c("supplier_id"), c("lead_time_variability"), True, None),
        one("suppliers_by_stockout", suppliers, c("supplier_id"), c("stockout_rate"), True, 12), one("warehouses_by_stockout", warehouses, c("warehouse_id"), c("stockout_rate"), True, 12), one("skus_by_priority", skus, _sku_name(), c("governance_priority_score"), True, 15),
    ]
    out = lists[0]
    for df in lists[1:]:
        out = out.unionByName(df)
    return out
