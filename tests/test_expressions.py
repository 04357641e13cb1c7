import pytest
from pyspark.sql import functions as F

from shelfspark.functions import expressions as ex
from shelfspark.plans import scoring


def values(spark, column, rows, name="x"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], f"{name} double").select(column).collect()]


def test_risk_tier_edges(spark):
    assert values(spark, ex.risk_tier("x"), [35.0, 35.1, 55.0, 55.1, 75.0, 75.1, None, -1.0]) == ["Low", "Medium", "Medium", "High", "High", "Critical", "nan", "nan"]


def test_linear_score_clips(spark):
    assert values(spark, ex.linear_score("x", 0.0, 1.0), [-1.0, 0.0, 0.5, 1.0, 2.0]) == [0, 0, 50, 100, 100]
    with pytest.raises(ValueError):
        ex.linear_score("x", 1.0, 1.0)


def test_log_share_bounds(spark):
    low, high = values(spark, ex.log_share_score("x", 0.001, 0.1), [0.0, 1.0])
    assert (low, high) == (0.0, 100.0)
    with pytest.raises(ValueError):
        ex.log_share_score("x", 0.0, 0.1)


def test_legacy_class(spark):
    assert values(spark, ex.legacy_class("x"), [10.0, 25.0, 40.0, 60.0]) == ["Low", "Medium", "High", "Critical"]


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (None, 2)], "n int, d int")
    got = df.select(ex.fill_ratio("n", "d"), ex.loss_ratio("n", "d"), ex.share("n", "d"), ex.safe_divide("n", "d")).collect()
    assert tuple(got[0]) == (1.0, 0.0, None, 0.0) and tuple(got[1]) == (0.5,) * 4 and tuple(got[2]) == (None, None, None, 0.0)


def test_low_tier_is_only_watched(spark):
    action = scoring.action(F.lit("Service Risk"), F.col("t"), "sku_warehouse")
    got = spark.createDataFrame([("Low",), ("High",)], "t string").select(action).collect()
    assert got[0][0] == "monitor only" and got[1][0] == "review reorder point and raise safety stock"


def test_constant_signals_scale_to_the_middle(spark):
    df = spark.createDataFrame([(0.1, 0.9, 0.2, 0.1, 0.2, 0.3), (0.3, 0.7, 0.4, 0.1, 0.2, 0.3)], "stockout_day_rate double, service_level double, excess_inventory_rate double, slow_moving_rate double, lead_time_cv double, demand_cv double")
    better, worse = [r.composite_risk for r in scoring.legacy_composite(df).orderBy("stockout_day_rate").collect()]
    assert worse > better and better == 7.5


def test_amounts_round_to_six_places_as_in_the_oracle(spark):
    """Halves of a millionth, whose shortest text often says another side than their product with 10^6, as DuckDB casts them."""
    import duckdb
    from pyspark.sql import functions as F

    from shelfspark.functions.expressions import exact, money_sum

    rows = [(i, sign * (k * 7919 % 10**n + 0.5) / 1e6) for i, (k, n, sign) in enumerate((k, n, sign) for k in range(300) for n in (4, 8, 10) for sign in (1, -1))]
    df = spark.createDataFrame(rows, "i int, x double")
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = dict(con.execute("SELECT i, CAST(x AS DECIMAL(18,6)) FROM t").fetchall())
    assert {r.i: r.y for r in df.select("i", exact("x").alias("y")).collect()} == want
    assert {r.i: r.y for r in df.groupBy("i").agg(money_sum("x").alias("y")).collect()} == {i: float(v) for i, v in want.items()}
    assert any(r.y != want[r.i] for r in df.select("i", F.col("x").cast("decimal(18,6)").alias("y")).collect())
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS x").select(exact("x").alias("y")).first().y is None


def test_results_are_rounded_as_in_the_oracle(spark):
    import duckdb

    from shelfspark.registry import rounded

    rows = [(i, (k * 7919 % 10**n + 0.5) / 1e6 * (-1) ** i - 1e-10) for i, (k, n) in enumerate((k, n) for k in range(300) for n in (4, 8, 10, 12))]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = dict(con.execute("SELECT i, round(x + 1e-10, 6) FROM t").fetchall())
    df = spark.createDataFrame([*rows, (-1, None), (-2, float("inf"))], "i int, x double")
    assert {r.i: r.x for r in rounded(df).collect()} == want | {-1: None, -2: float("inf")}


def test_money_sums_are_exact_beyond_a_long(spark):
    """Sums of both parts of amounts equal sums of decimals: negative, huge and null amounts, and more in all than a long of millionths holds."""
    from decimal import Decimal

    rows = [9e11 + 1 / 3, -0.000001, -123456789.123457, 0.0, None, 1e-7] * 20
    df = spark.createDataFrame([(x,) for x in rows], "x double")
    got = df.agg(ex.exact_sum("x").alias("sum"), F.sum(ex.exact("x")).alias("want"), ex.money_sum("x").alias("double")).first()
    assert got["sum"] == got.want > Decimal(2**63) / 10**6 and got.double == float(got.want)
    assert df.filter("x is null").agg(ex.exact_sum("x").alias("y")).first().y is None
