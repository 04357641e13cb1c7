"""Registration of the primitives (sources, expressions, filters, joins, aggregates, windows, sets), each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark import schemas
from shelfspark.functions import expressions as x
from shelfspark.operators.facts import Slice, detail
from shelfspark.operators.registered import skus
from shelfspark.operators.registered_facts import fact
from shelfspark.oracles.base import CAP, SLOW, TIER, div, linear, log_share, money, rate
from shelfspark.oracles.doubles import DOUBLES
from shelfspark.plans.ranking import ranked, top_of_all, top_of_groups
from shelfspark.plans.selection import quantiles
from shelfspark.registry import register as _register
from shelfspark.sources.fixtures import Tables

#: Name: what makes the column (columns need a session, which is not there on import), and its SQL.
Columns = dict[str, tuple[Callable[[], Column], str]]
PRODUCT, ORDER, DAY = ["product_id"], ["po_id"], ["date", "warehouse_id", "product_id"]


def register(name: str, plan, sql: str, doubles: str = "") -> None:
    """Register a primitive; ``doubles`` names its columns of type double."""
    if doubles:
        DOUBLES[name] = doubles
    _register(name, plan, sql)


def project(name: str, table: str, keys: list[str], columns: Columns, doubles: str = "") -> None:
    """A projection: keys of a table and named expressions."""
    register(
        name, lambda t: t.raw(table).select(*keys, *[e().alias(n) for n, (e, _) in columns.items()]), f"SELECT {', '.join([*keys, *[f'{s} AS {n}' for n, (_, s) in columns.items()]])} FROM {table}", doubles
    )


def total(name: str, table: str, columns: Columns, by: str = "", doubles: str = "") -> None:
    """An aggregate of a table, of all its rows or by a key."""
    pick = ", ".join([*([by] if by else []), *[f"{s} AS {n}" for n, (_, s) in columns.items()]])
    register(name, lambda t: t.raw(table).groupBy(*([by] if by else [])).agg(*[e().alias(n) for n, (e, _) in columns.items()]), f"SELECT {pick} FROM {table}{f' GROUP BY {by}' if by else ''}", doubles)


def rows(name: str, table: str, plan, where: str, keys: list[str]) -> None:
    """A filter: the keys of the rows that pass."""
    register(name, lambda t: plan(t.raw(table)).select(*keys), f"SELECT {', '.join(keys)} FROM {table} WHERE {where}")


c, lit, D = F.col, F.lit, x.dbl
DEM, FUL, LOST = "CAST(units_demanded AS DOUBLE)", "CAST(units_fulfilled AS DOUBLE)", "CAST(units_lost_sales AS DOUBLE)"

# sources: typed tables, views
for table, keys in (("products", PRODUCT), ("suppliers", ["supplier_id"]), ("warehouses", ["warehouse_id"]), ("product_classification", PRODUCT), ("demand_history", DAY), ("inventory_snapshots", ["snapshot_date", *DAY[1:]]), ("purchase_orders", ORDER)):
    total(f"io02_typed_{table}", table, {"n_rows": (lambda: F.count(lit(1)), "count(*)"), "n_keys": (lambda keys=keys: F.countDistinct(*keys), f"count(DISTINCT ({', '.join(keys)}))" if len(keys) > 1 else f"count(DISTINCT {keys[0]})")})


def _by_sql(t: Tables) -> DataFrame:
    t.demand_history.createOrReplaceTempView("demand_history")
    return t.spark.sql("SELECT warehouse_id, SUM(units_demanded) AS units FROM demand_history GROUP BY warehouse_id")


register("io04_named_view", _by_sql, "SELECT warehouse_id, CAST(sum(units_demanded) AS BIGINT) AS units FROM demand_history GROUP BY warehouse_id")
register("io07_expected_columns", lambda t: t.daily.select(*schemas.DAILY_COLUMNS).groupBy("warehouse_id").agg(F.count(lit(1)).alias("n")), "SELECT warehouse_id, count(*) AS n FROM daily GROUP BY warehouse_id")

# expressions
project("ex01_projection", "products", PRODUCT, {"sku_name": (lambda: c("product_name"), "product_name"), "margin": (lambda: c("unit_price") - c("unit_cost"), "unit_price - unit_cost")}, "margin")
project("ex02_case", "products", PRODUCT, {"size": (lambda: F.when(c("lead_time_days") < 10, "short").when(c("lead_time_days") < 20, "middle").otherwise("long"), "CASE WHEN lead_time_days < 10 THEN 'short' WHEN lead_time_days < 20 THEN 'middle' ELSE 'long' END")})
project("ex03_fill_ratio", "demand_history", DAY, {"fill": (lambda: x.fill_ratio("units_fulfilled", "units_demanded"), div("units_fulfilled", "units_demanded", "1"))}, "fill")
project("ex04_loss_ratio", "demand_history", DAY, {"loss": (lambda: x.loss_ratio("units_lost_sales", "units_demanded"), div("units_lost_sales", "units_demanded", "0"))}, "loss")
project("ex05_safe_divide", "demand_history", DAY, {"fill": (lambda: x.safe_divide("units_fulfilled", "units_demanded"), f"coalesce({div('units_fulfilled', 'units_demanded', '0')}, 0)")}, "fill")
project("ex06_safe_divide_by_zero", "inventory_snapshots", ["snapshot_date", *DAY[1:]], {"cover": (lambda: x.ratio("on_order_units", "available_units", 0.0), div("on_order_units", "available_units", "0"))}, "cover")
project("ex07_share", "demand_history", DAY, {"share": (lambda: x.share("units_lost_sales", "units_demanded"), div("units_lost_sales", "units_demanded", "NULL")), "floored": (lambda: x.floored_share("units_lost_sales", "units_demanded"), f"{LOST} / greatest({DEM}, 1)")}, "share floored")
project("ex08_cast", "products", PRODUCT, {"days": (lambda: D("lead_time_days"), "CAST(lead_time_days AS DOUBLE)"), "life": (lambda: c("shelf_life_days").cast("string"), "CAST(shelf_life_days AS VARCHAR)")}, "days")
project("ex09_greatest_least", "purchase_orders", ORDER, {"most": (lambda: F.greatest("ordered_units", "received_units"), "greatest(ordered_units, received_units)"), "least": (lambda: F.least("ordered_units", "received_units"), "least(ordered_units, received_units)")})
project("ex10_clip", "inventory_snapshots", ["snapshot_date", *DAY[1:]], {"bounded": (lambda: x.clip("days_of_supply", 5.0, 60.0), "least(greatest(days_of_supply, 5), 60)")}, "bounded")
project("ex13_arithmetic", "purchase_orders", ORDER, {"gap": (lambda: F.abs(c("ordered_units") - c("received_units")), "abs(ordered_units - received_units)")})
project("ex14_log", "products", PRODUCT, {"log_price": (lambda: F.log(c("unit_price") + lit(1e-12)), "ln(unit_price + CAST(1e-12 AS DOUBLE))")}, "log_price")
project("ex15_round", "products", PRODUCT, {"life": (lambda: F.round(c("shelf_life_days") / lit(7.0), 2), "round(shelf_life_days / CAST(7 AS DOUBLE), 2)")}, "life")
project("ex16_days_between", "purchase_orders", ORDER, {"delay": (lambda: F.datediff("actual_arrival_date", "expected_arrival_date").cast("double"), "CAST(actual_arrival_date - expected_arrival_date AS DOUBLE)")}, "delay")
project("ex17_month", "demand_history", DAY, {"month": (lambda: x.month_of(), "CAST(date_trunc('month', date) AS DATE)"), "label": (lambda: F.date_format("date", "yyyy-MM-01"), "strftime(date, '%Y-%m-01')")})
total("ex18_day_span", "demand_history", {"span": (lambda: F.datediff(F.max("date"), F.min("date")) + 1, "max(date) - min(date) + 1"), "to_year": (lambda: lit(365.0) / F.greatest(F.countDistinct("date"), lit(1)), "CAST(365 AS DOUBLE) / greatest(count(DISTINCT date), 1)")}, doubles="to_year")
project("ex19_value_map", "product_classification", PRODUCT, {"weight": (lambda: x.criticality_weight("criticality_level", 0.6), "CASE criticality_level WHEN 'High' THEN CAST(1 AS DOUBLE) WHEN 'Medium' THEN 0.6 WHEN 'Low' THEN 0.3 ELSE 0.6 END")}, "weight")
project("ex20_tiers", "inventory_snapshots", ["snapshot_date", *DAY[1:]], {"tier": (lambda: x.risk_tier("days_of_supply"), TIER.format("days_of_supply"))})
project(
    "ex21_row_argmax", "inventory_snapshots", ["snapshot_date", *DAY[1:]],
    {"largest": (lambda: x.argmax([("on_hand_units", "hand"), ("on_order_units", "order"), ("reserved_units", "reserved")]), "CASE WHEN on_hand_units >= on_order_units AND on_hand_units >= reserved_units THEN 'hand' WHEN on_order_units >= reserved_units THEN 'order' ELSE 'reserved' END")},
)
project("ex22_concat", "demand_history", DAY, {"place": (lambda: F.concat("product_id", lit("|"), "warehouse_id"), "product_id || '|' || warehouse_id")})
project("ex23_lower_trim", "products", PRODUCT, {"is_promo": (lambda: F.lower(F.trim("category")) == "promo", "lower(trim(category)) = 'promo'")})
rows("ex24_text_search", "products", lambda t: t.filter(F.contains(F.lower(F.concat_ws(" ", "product_id", "product_name", "category")), lit("sku-1"))), "contains(lower(concat_ws(' ', product_id, product_name, category)), 'sku-1')", PRODUCT)
rows("ex25_pattern", "products", lambda t: t.filter(c("product_id").rlike("7$|-1.*3$")), "regexp_matches(product_id, '7$|-1.*3$')", PRODUCT)
project("ex26_pattern_number", "purchase_orders", ORDER, {"line": (lambda: F.regexp_extract("po_id", r"^PO-\d+-(\d+)-", 1).cast("long"), r"CAST(regexp_extract(po_id, '^PO-\d+-(\d+)-', 1) AS BIGINT)")})
register(
    "ex27_pattern_count", lambda t: t.read("documents").select("doc_id", F.regexp_count("text", lit(r"(?i)\b(the|and|of)\b")).cast("long").alias("n")),
    r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\b(the|and|of)\b')) AS BIGINT) AS n FROM documents",
)


def _ranged(top: float, constant: float):
    def plan(t: Tables) -> DataFrame:
        bounds = t.products.agg(F.min("unit_price").alias("low"), F.max("unit_price").alias("high"))
        return t.products.crossJoin(F.broadcast(bounds)).select("product_id", x.scaled("unit_price", "low", "high", top, constant).alias("scaled"))  # one row

    return plan, f"SELECT product_id, CASE WHEN low = high THEN {constant} ELSE (unit_price - low) / nullif(high - low, 0) * {top} END AS scaled FROM products, (SELECT min(unit_price) AS low, max(unit_price) AS high FROM products)"


register("ex28_scale_100", *_ranged(100.0, 50.0), "scaled")
register("ex29_scale_1", *_ranged(1.0, 0.5), "scaled")
project("ex30_linear_score", "inventory_snapshots", ["snapshot_date", *DAY[1:]], {"score": (lambda: x.linear_score("days_of_supply", 10.0, 50.0), linear("days_of_supply", 10.0, 50.0))}, "score")
project("ex31_log_share_score", "products", PRODUCT, {"score": (lambda: x.log_share_score(c("unit_price") / lit(1e6), 0.0005, 0.01), log_share("(unit_price / CAST(1e6 AS DOUBLE))", 0.0005, 0.01))}, "score")
project("ex32_range_norm", "products", PRODUCT, {"norm": (lambda: x.range_norm(D("lead_time_days"), 5.0, 20.0), "least(greatest((CAST(lead_time_days AS DOUBLE) - 5) / 15, 0), 1)"), "none": (lambda: x.range_norm("unit_price", 1.0, 1.0), "CAST(0 AS DOUBLE)")}, "norm none")
BUCKETS = "CASE " + " ".join(f"WHEN days_of_supply < {bound} THEN '{label}'" for bound, label in x.DOS_BUCKETS) + " ELSE '05_50_plus' END"
project("ex33_buckets", "inventory_snapshots", ["snapshot_date", *DAY[1:]], {"bucket": (lambda: x.dos_bucket(), BUCKETS)})
project("ex34_supply_cap", "product_classification", PRODUCT, {"cap": (lambda: x.dos_cap(), CAP)}, "cap")
project("ex35_flags", "daily", DAY, {"excess": (lambda: x.flag(c("days_of_supply") > x.dos_cap()), f"CASE WHEN days_of_supply > {CAP} THEN CAST(1 AS DOUBLE) ELSE 0 END"), "slow": (lambda: x.flag(x.slow_moving()), f"CASE WHEN {SLOW} THEN CAST(1 AS DOUBLE) ELSE 0 END")}, "excess slow")

# filters
rows("fi01_comparisons", "demand_history", lambda t: t.filter((c("units_demanded") > 20) & ~(c("promo_flag") == 1) | (c("stockout_flag") == 1)), "(units_demanded > 20 AND NOT promo_flag = 1) OR stockout_flag = 1", DAY)
rows("fi02_ranges_and_sets", "daily", lambda t: t.filter(c("days_of_supply").between(10, 30) & c("abc_class").isin("A", "B") & c("category").isNotNull() & (c("region") != "ASIA")), "days_of_supply BETWEEN 10 AND 30 AND abc_class IN ('A', 'B') AND category IS NOT NULL AND region <> 'ASIA'", DAY)
rows("fi03_outside_domain", "daily", lambda t: t.filter(c("abc_class").isNull() | ~c("abc_class").isin("A", "B")), "abc_class IS NULL OR abc_class NOT IN ('A', 'B')", DAY)
register("fi04_having", lambda t: t.purchase_orders.groupBy("product_id", "order_date").count().filter("count > 1"), 'SELECT product_id, order_date, count(*) AS "count" FROM purchase_orders GROUP BY ALL HAVING count(*) > 1')

# joins
PAIR = ["warehouse_id", "product_id"]
register("jn01_facts", lambda t: t.demand_history.join(t.inventory_snapshots.withColumnRenamed("snapshot_date", "date"), DAY).select(*DAY, "units_demanded", "on_hand_units"), "SELECT d.date, d.warehouse_id, d.product_id, units_demanded, on_hand_units FROM demand_history d JOIN inventory_snapshots i ON d.date = snapshot_date AND d.warehouse_id = i.warehouse_id AND d.product_id = i.product_id")
register("jn02_dimension", lambda t: t.purchase_orders.join(t.suppliers, "supplier_id").select("po_id", "supplier_name"), "SELECT po_id, supplier_name FROM purchase_orders JOIN suppliers USING (supplier_id)")
register("jn03_left_dimension", lambda t: t.products.join(t.product_classification, "product_id", "left").select("product_id", "abc_class"), "SELECT product_id, abc_class FROM products LEFT JOIN product_classification USING (product_id)")
register("jn04_master_to_aggregate", lambda t: t.products.join(t.purchase_orders.groupBy("product_id").count(), "product_id", "left").select("product_id", F.coalesce("count", lit(0)).alias("n")), "SELECT product_id, coalesce(n, 0) AS n FROM products LEFT JOIN (SELECT product_id, count(*) AS n FROM purchase_orders GROUP BY 1) USING (product_id)")
register(
    "jn05_aggregates", lambda t: t.demand_history.groupBy(PAIR).agg(F.sum("units_demanded").alias("demanded")).join(t.purchase_orders.groupBy(PAIR).agg(F.sum("ordered_units").alias("ordered")), PAIR),
    "SELECT * FROM (SELECT warehouse_id, product_id, CAST(sum(units_demanded) AS BIGINT) AS demanded FROM demand_history GROUP BY ALL) JOIN (SELECT warehouse_id, product_id, CAST(sum(ordered_units) AS BIGINT) AS ordered FROM purchase_orders GROUP BY ALL) USING (warehouse_id, product_id)",
)
for side, one, two in (("without_orders", "demand_history", "purchase_orders"), ("without_demand", "purchase_orders", "demand_history")):
    register(f"jn07_pairs_{side}", lambda t, one=one, two=two: t.raw(one).select(PAIR).distinct().join(t.raw(two).select(PAIR).distinct(), PAIR, "left_anti"), f"SELECT DISTINCT warehouse_id, product_id FROM {one} EXCEPT SELECT warehouse_id, product_id FROM {two}")
register("jn08_orphans", lambda t: t.daily.filter("product_id IS NOT NULL").join(t.product_classification.filter("abc_class = 'A'").select("product_id").distinct(), "product_id", "left_anti").groupBy("warehouse_id").agg(F.count(lit(1)).alias("orphans")), "SELECT warehouse_id, count(*) AS orphans FROM daily WHERE product_id NOT IN (SELECT product_id FROM product_classification WHERE abc_class = 'A') GROUP BY 1")
register("jn09_scalar", lambda t: t.products.crossJoin(F.broadcast(t.products.agg(F.max("unit_price").alias("top")))).select("product_id", (c("unit_price") / c("top")).alias("of_top")), "SELECT product_id, unit_price / (SELECT max(unit_price) FROM products) AS of_top FROM products", "of_top")  # one row
register("jn11_reconcile", lambda t: t.daily.join(t.products.select("product_id", "category").withColumnRenamed("category", "own"), "product_id", "left").groupBy("warehouse_id").agg(F.count_if(~c("category").eqNullSafe(c("own"))).alias("differs")), "SELECT warehouse_id, count(*) FILTER (d.category IS DISTINCT FROM p.category) AS differs FROM daily d LEFT JOIN products p USING (product_id) GROUP BY 1")

# aggregates
FOUR = {"sum": (lambda: F.sum("units_demanded"), "CAST(sum(units_demanded) AS BIGINT)"), "mean": (lambda: F.avg("units_demanded"), "avg(units_demanded)"), "low": (lambda: F.min("units_demanded"), "min(units_demanded)"), "high": (lambda: F.max("units_demanded"), "max(units_demanded)"), "n": (lambda: F.count(lit(1)), "count(*)")}
total("ag01_global", "demand_history", FOUR, doubles="mean")
total("ag02_grouped", "demand_history", FOUR, "product_id", "mean")
total("ag03_conditional_rate", "purchase_orders", {"late": (lambda: x.rate(c("late_delivery_flag") == 1), rate("late_delivery_flag = 1"))}, "supplier_id", "late")
total("ag04_conditional_counts", "purchase_orders", {"late": (lambda: F.count_if(c("late_delivery_flag") == 1), "count(*) FILTER (late_delivery_flag = 1)"), "late_units": (lambda: F.sum(F.when(c("late_delivery_flag") == 1, c("ordered_units")).otherwise(0)), "CAST(sum(CASE WHEN late_delivery_flag = 1 THEN ordered_units ELSE 0 END) AS BIGINT)")}, "supplier_id")
total("ag05_ratio_of_sums", "demand_history", {"fill": (lambda: x.fill_ratio(F.sum("units_fulfilled"), F.sum("units_demanded")), div("sum(units_fulfilled)", "sum(units_demanded)", "1"))}, "warehouse_id", "fill")
total("ag06_mean_of_ratios", "demand_history", {"fill": (lambda: F.avg(x.fill_ratio("units_fulfilled", "units_demanded")), f"avg({div('units_fulfilled', 'units_demanded', '1')})")}, "warehouse_id", "fill")
total("ag07_sample_deviation", "purchase_orders", {"spread": (lambda: F.coalesce(F.stddev_samp("ordered_units"), lit(0.0)), "coalesce(stddev_samp(ordered_units), 0)")}, "supplier_id", "spread")
SHARES = {"p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99}


def _quantiles(t: Tables) -> DataFrame:
    return quantiles(t.inventory_snapshots, {"days_of_supply": list(SHARES.values())}, ["warehouse_id"]).select("warehouse_id", *[c("days_of_supply")[i].alias(n) for i, n in enumerate(SHARES)])


register("ag08_quantiles", _quantiles, f"SELECT warehouse_id, {', '.join(f'quantile_cont(days_of_supply, {q}) AS {n}' for n, q in SHARES.items())} FROM inventory_snapshots GROUP BY warehouse_id", "p25 p50 p90 p99")
register("ag09_median", lambda t: quantiles(t.inventory_snapshots, {"on_hand_units": [0.5]}, ["warehouse_id"]).select("warehouse_id", c("on_hand_units")[0].alias("middle")), "SELECT warehouse_id, median(on_hand_units) AS middle FROM inventory_snapshots GROUP BY warehouse_id", "middle")


def _skewness() -> Column:
    n = F.count("on_hand_units").cast("double")
    return F.skewness("on_hand_units") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, lit(0.0))


total("ag10_skewness", "inventory_snapshots", {"skew": (_skewness, "skewness(on_hand_units)")}, "warehouse_id", "skew")
total("ag11_distinct", "demand_history", {"days": (lambda: F.countDistinct("date"), "count(DISTINCT date)"), "products": (lambda: F.countDistinct("product_id"), "count(DISTINCT product_id)")}, "warehouse_id")
register("ag12_repeated_keys", lambda t: t.purchase_orders.groupBy("product_id", "warehouse_id").count().agg(F.sum(c("count") - 1).alias("repeats")), "SELECT CAST(count(*) - count(DISTINCT (product_id, warehouse_id)) AS BIGINT) AS repeats FROM purchase_orders")
register(
    "ag13_mode", lambda t: t.demand_history.groupBy("warehouse_id", "units_demanded").count().groupBy("warehouse_id").agg(F.max_by("units_demanded", F.struct("count", "units_demanded")).alias("mode"), (F.max("count") / F.sum("count")).alias("share")),
    "SELECT warehouse_id, max_by(units_demanded, (n, units_demanded)) AS mode, max(n) / CAST(sum(n) AS DOUBLE) AS share FROM (SELECT warehouse_id, units_demanded, count(*) AS n FROM demand_history GROUP BY ALL) GROUP BY 1", "share",
)
total("ag14_null_rates", "daily", {f"{k}_null": (lambda k=k: F.avg(c(k).isNull().cast("double")), f"avg(CAST({k} IS NULL AS INTEGER))") for k in ("abc_class", "category", "supplier_id")}, doubles="abc_class_null category_null supplier_id_null")
register("ag15_two_levels", lambda t: t.demand_history.groupBy("product_id", x.month_of().alias("month")).agg(F.sum("units_demanded").alias("u")).groupBy("product_id").agg(F.avg("u").alias("a_month"), F.count(lit(1)).alias("months")), "SELECT product_id, avg(u) AS a_month, count(*) AS months FROM (SELECT product_id, date_trunc('month', date) AS m, sum(units_demanded) AS u FROM demand_history GROUP BY ALL) GROUP BY 1", "a_month")
WEIGHT = f"greatest({DEM}, 1)"


def _weight() -> Column:
    return F.greatest(D("units_demanded"), lit(1.0))


total("ag16_weighted_mean", "daily", {"dos": (lambda: x.safe_divide(x.money_sum(_weight() * c("days_of_supply")), x.money_sum(_weight())), f"{money(f'{WEIGHT} * days_of_supply')} / {money(WEIGHT)}")}, "category", "dos")
register("ag18_levels", lambda t: t.daily.groupingSets([["region"], ["category"]], "region", "category").agg(F.grouping("region").cast("long").alias("by_category"), F.sum("units_lost_sales").alias("lost")).select(F.coalesce("region", "category").alias("segment"), "by_category", "lost"), "SELECT coalesce(region, category) AS segment, CAST(grouping(region) AS BIGINT) AS by_category, CAST(sum(units_lost_sales) AS BIGINT) AS lost FROM daily GROUP BY GROUPING SETS ((region), (category))")
total("ag19_carried_label", "daily", {"category": (lambda: F.max("category"), "max(category)"), "region": (lambda: F.max("region"), "max(region)")}, "product_id")

# windows, sorts, sets
register("wn01_row_number", lambda t: t.products.withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy(c("unit_price").desc(), "product_id"))).select("product_id", "nth"), "SELECT product_id, row_number() OVER (PARTITION BY category ORDER BY unit_price DESC, product_id) AS nth FROM products")
register("wn02_total", lambda t: t.products.crossJoin(F.broadcast(t.products.agg(F.count(lit(1)).alias("n"), x.money_sum("unit_price").alias("all_prices")))).select("product_id", "n", "all_prices"), f"SELECT product_id, (SELECT count(*) FROM products) AS n, (SELECT {money('unit_price')} FROM products) AS all_prices FROM products", "all_prices")  # one row
MONTHS = "SELECT warehouse_id, CAST(date_trunc('month', date) AS DATE) AS month, sum(units_demanded) AS u FROM demand_history GROUP BY ALL"
register("wn03_running_sum", lambda t: t.demand_history.groupBy("warehouse_id", x.month_of().alias("month")).agg(F.sum("units_demanded").alias("u")).select("warehouse_id", "month", F.sum("u").over(Window.partitionBy("warehouse_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)).alias("so_far")), f"SELECT warehouse_id, month, CAST(sum(u) OVER (PARTITION BY warehouse_id ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM ({MONTHS})")
register("wn04_over_aggregate", lambda t: t.daily.groupBy("category").agg(F.count(lit(1)).alias("n")).withColumn("share", c("n") / F.sum("n").over(Window.partitionBy())), "SELECT category, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM daily GROUP BY 1", "share")
register("wn07_share_of_total", lambda t: t.daily.groupBy("category").agg(F.sum("units_lost_sales").alias("lost")).withColumn("share", x.share("lost", F.sum("lost").over(Window.partitionBy()))).select("category", "share"), f"SELECT category, {div('sum(units_lost_sales)', 'sum(sum(units_lost_sales)) OVER ()', 'NULL')} AS share FROM daily GROUP BY 1", "share")
register("sl02_top", lambda t: t.products.orderBy(c("unit_price").desc(), "product_id").limit(25).select("product_id", "unit_price"), "SELECT product_id, unit_price FROM products ORDER BY unit_price DESC, product_id LIMIT 25", "unit_price")
register("so01_union_all", lambda t: t.demand_history.select(*PAIR, lit("demand").alias("kind")).unionByName(t.purchase_orders.select(*PAIR, lit("order").alias("kind"))).groupBy("warehouse_id", "kind").agg(F.count(lit(1)).alias("n")), "SELECT warehouse_id, kind, count(*) AS n FROM (SELECT warehouse_id, 'demand' AS kind FROM demand_history UNION ALL SELECT warehouse_id, 'order' FROM purchase_orders) GROUP BY ALL")
register("so03_distinct", lambda t: t.purchase_orders.select("supplier_id", "product_id").distinct(), "SELECT DISTINCT supplier_id, product_id FROM purchase_orders")
register("so04_overlap", lambda t: t.demand_history.select(PAIR).distinct().join(t.purchase_orders.select(PAIR), PAIR, "left_semi").agg(F.count(lit(1)).alias("shared")), "SELECT count(*) AS shared FROM (SELECT warehouse_id, product_id FROM demand_history INTERSECT SELECT warehouse_id, product_id FROM purchase_orders)")

# what other plans use inside, by itself over whole tables
project(
    "ex11_coalesce", "purchase_orders", ORDER,
    {"units": (lambda: F.coalesce(F.nullif("received_units", lit(0)), c("ordered_units")), "coalesce(nullif(received_units, 0), ordered_units)"), "arrived": (lambda: F.coalesce(c("actual_arrival_date"), c("expected_arrival_date")), "coalesce(actual_arrival_date, expected_arrival_date)")},
)
_COVER = "on_hand_units / CAST(nullif(on_order_units, 0) AS DOUBLE)"
project(
    "ex12_nullif_and_infinity", "inventory_snapshots", ["snapshot_date", *DAY[1:]],
    {"cover": (lambda: D("on_hand_units") / F.nullif(D("on_order_units"), lit(0.0)), _COVER), "finite_cover": (lambda: x.finite(F.when(c("on_order_units") == 0, lit(float("inf"))).otherwise(D("on_hand_units") / F.nullif(D("on_order_units"), lit(0.0)))), f"coalesce({_COVER}, 0)")}, "cover finite_cover",
)


def _lost(t: Tables, *keys: str) -> DataFrame:
    return t.demand_history.groupBy(*keys).agg(F.sum("units_lost_sales").alias("lost"))


_LOST = "(SELECT {0}, CAST(sum(units_lost_sales) AS BIGINT) AS lost FROM demand_history GROUP BY {0})"
_by_lost = lambda: [c("lost").desc(), c("product_id")]
_RANKED = "(SELECT *, row_number() OVER (ORDER BY lost DESC, product_id) AS place, count(*) OVER () AS n FROM " + _LOST.format("product_id") + ")"
register("fi05_ranked_filter", lambda t: top_of_groups(_lost(t, "warehouse_id", "product_id"), ["warehouse_id"], _by_lost(), 3, "place").withColumn("place", c("place").cast("long")), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY warehouse_id ORDER BY lost DESC, product_id) AS place FROM {_LOST.format('warehouse_id, product_id')}) WHERE place <= 3")
register("fi06_facets", lambda t: Slice({"region": "ASIA", "category": "ALL"}, (date(1997, 12, 1), date(1996, 1, 1))).of(fact(t)).groupBy("month", "warehouse_id").agg(F.sum("units_demanded").alias("units"), F.count(lit(1)).alias("n")), "SELECT month, warehouse_id, CAST(sum(units_demanded) AS BIGINT) AS units, count(*) AS n FROM month_fact WHERE region = 'ASIA' AND month BETWEEN DATE '1996-01-01' AND DATE '1997-12-01' GROUP BY ALL")
register(
    "fi07_first_rows", lambda t: _lost(t, "warehouse_id", "product_id").groupBy("warehouse_id").agg(F.max(F.struct("lost", "product_id")).alias("top"), F.min(F.struct("lost", "product_id")).alias("low")).select("warehouse_id", c("top.product_id").alias("most"), c("top.lost").alias("most_lost"), c("low.product_id").alias("least")),
    f"SELECT warehouse_id, max(x).product_id AS most, max(x).lost AS most_lost, min(x).product_id AS least FROM (SELECT warehouse_id, struct_pack(lost := lost, product_id := product_id) AS x FROM {_LOST.format('warehouse_id, product_id')}) GROUP BY warehouse_id",
)
register(
    "jn06_measures_to_entities", lambda t: skus(t).select(*DAY[1:], "governance_priority_score").join(_lost(t, *DAY[1:]).filter("lost > 0"), DAY[1:], "left").withColumn("lost", F.coalesce("lost", lit(0))),
    f"SELECT s.warehouse_id, s.product_id, governance_priority_score, coalesce(lost, 0) AS lost FROM sku_risk s LEFT JOIN (SELECT * FROM {_LOST.format('warehouse_id, product_id')} WHERE lost > 0) l ON l.warehouse_id = s.warehouse_id AND l.product_id = s.product_id", "governance_priority_score",
)
register(
    "jn10_lookup_with_defaults", lambda t: t.purchase_orders.join(t.suppliers.filter("supplier_region = 'ASIA'").select("supplier_id", "supplier_name", "supplier_region"), "supplier_id", "left").select(*ORDER, F.coalesce("supplier_name", "supplier_id").alias("supplier"), F.coalesce("supplier_region", lit("elsewhere")).alias("place")),
    "SELECT po_id, coalesce(supplier_name, o.supplier_id) AS supplier, coalesce(supplier_region, 'elsewhere') AS place FROM purchase_orders o LEFT JOIN (SELECT * FROM suppliers WHERE supplier_region = 'ASIA') s ON s.supplier_id = o.supplier_id",
)
register(
    "ag17_day_weighted_mean", lambda t: fact(t).groupBy("warehouse_id").agg((x.money_sum(c("avg_days_of_supply") * c("observation_days")) / F.sum("observation_days")).alias("days")),
    f"SELECT warehouse_id, {money('avg_days_of_supply * observation_days')} / sum(observation_days) AS days FROM month_fact GROUP BY warehouse_id", "days",
)


def _by_alias(t: Tables) -> DataFrame:
    t.purchase_orders.createOrReplaceTempView("purchase_orders")
    return t.spark.sql("SELECT trunc(order_date, 'month') AS month, CASE WHEN late_delivery_flag = 1 THEN 'late' ELSE 'on time' END AS arrival, count(*) AS n FROM purchase_orders GROUP BY 1, arrival")


register("ag20_group_by_alias", _by_alias, "SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, CASE WHEN late_delivery_flag = 1 THEN 'late' ELSE 'on time' END AS arrival, count(*) AS n FROM purchase_orders GROUP BY 1, 2")
register("wn05_rank_percentile", lambda t: ranked(_lost(t, "product_id"), _by_lost(), "place").select("product_id", (c("place") / c("n_all")).alias("percentile")), f"SELECT product_id, CAST(place AS DOUBLE) / n AS percentile FROM {_RANKED}", "percentile")
register("wn06_first_rank", lambda t: ranked(_lost(t, "product_id"), _by_lost(), "place").drop("n_all"), f"SELECT product_id, lost, place FROM {_RANKED}")
register(
    "wn08_cumulative_share", lambda t: ranked(_lost(t, "product_id"), _by_lost(), "place", ["lost"]).select("product_id", x.share("running_lost", "all_lost").alias("cumulative_share")),
    f"SELECT product_id, CAST(sum(lost) OVER (ORDER BY lost DESC, product_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(lost) OVER () AS cumulative_share FROM {_LOST.format('product_id')}", "cumulative_share",
)
register("sl01_mixed_order", lambda t: ranked(t.products.select("category", "unit_price", "product_id"), [c("category").asc(), c("unit_price").desc(), c("product_id").asc()], "place").select("product_id", "place"), "SELECT product_id, row_number() OVER (ORDER BY category, unit_price DESC, product_id) AS place FROM products")
register("sl03_top_by_rank", lambda t: top_of_all(_lost(t, "product_id"), _by_lost(), 15, "place").withColumn("place", c("place").cast("long")), f"SELECT product_id, lost, place FROM {_RANKED} WHERE place <= 15")
register("sl04_sorted_head", lambda t: _lost(t, "product_id").orderBy(*_by_lost()).limit(25), f"SELECT product_id, lost FROM {_RANKED} WHERE place <= 25")
register(
    "sl05_chosen_order", lambda t: detail(skus(t).join(t.products.select("product_id", "product_name"), "product_id"), key="fill_rate", descending=False, n=250).select(*DAY[1:], "fill_rate"),
    "SELECT warehouse_id, product_id, fill_rate FROM sku_risk ORDER BY round(fill_rate, 6), product_id, warehouse_id, supplier_id LIMIT 250", "fill_rate",
)
register(
    "so02_blocks", lambda t: t.suppliers.select(lit("supplier").alias("kind"), c("supplier_id").alias("id"), c("average_lead_time_days").alias("lead_days")).unionByName(t.products.select(lit("product").alias("kind"), c("product_id").alias("id"), c("lead_time_days").alias("lead_days"))).unionByName(t.warehouses.select(lit("warehouse").alias("kind"), c("warehouse_id").alias("id")), allowMissingColumns=True),
    "SELECT 'supplier' AS kind, supplier_id AS id, average_lead_time_days AS lead_days FROM suppliers UNION ALL SELECT 'product', product_id, lead_time_days FROM products UNION ALL SELECT 'warehouse', warehouse_id, NULL FROM warehouses",
)
