import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.plans.selection import exact_quantiles, quantiles

SHARES = [0.0, 0.001, 0.25, 0.5, 0.77, 0.99, 1.0]


def close(got, values):
    return np.allclose(got, np.quantile(values, SHARES), rtol=1e-12, atol=1e-300)


def test_a_million_distinct_values_and_ties(spark):
    rows = spark.range(1_000_000).select((F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 7).alias("distinct"), F.least(F.col("id") % 1000, F.lit(600)).cast("double").alias("ties"))
    got = exact_quantiles(rows, {"distinct": SHARES, "ties": SHARES})[()]
    i = np.arange(1_000_000)
    assert close(got["distinct"], (i * 7919 % 1_000_003) / 7) and close(got["ties"], np.minimum(i % 1000, 600).astype(float))


def test_uneven_values(spark):
    """Values over 200 orders of magnitude, an outlier, signs and extremes: bins of one width are refined."""
    pick = np.random.default_rng(1)
    columns = {"wide": 10.0 ** pick.uniform(-100, 100, 4000), "outlier": np.append(pick.normal(size=3999), 1e300), "signed": pick.standard_cauchy(4000), "huge": np.append(pick.normal(size=3998), [1.7e308, -1.7e308])}
    rows = spark.createDataFrame(list(zip(*[c.tolist() for c in columns.values()], strict=True)), ", ".join(f"{n} double" for n in columns))
    for name, got in exact_quantiles(rows, dict.fromkeys(columns, SHARES))[()].items():
        assert close(got, columns[name]), name


def test_groups_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), (None, 5.0), ("b", None), ("c", float("nan")), ("c", float("inf")), ("c", 3.0), ("c", 1.0)], "g string, x double")
    got = {r.g: list(r.x) for r in quantiles(rows, {"x": [0.5, 1.0]}, ["g"]).collect()}
    assert got == {"a": [1.5, 2.0], None: [5.0, 5.0], "b": [None, None], "c": [3.0, float("inf")]}
    assert exact_quantiles(rows.limit(0), {"x": [0.5]}) == {(): {"x": [None]}} and quantiles(rows.limit(0), {"x": [0.5]}, ["g"]).count() == 0
    with pytest.raises(ValueError, match="too many groups"):
        exact_quantiles(spark.range(5000).selectExpr("id AS g", "1.0 AS x"), {"x": [0.5]}, ["g"])


def test_no_percentile_in_plans(spark, data):
    from shelfspark import registry
    from shelfspark.catalog import QUERIES  # noqa: F401

    for name in ("ag08_quantiles", "ag09_median", "dp04_distribution", "dp12_skew_flags", "k05_days_of_supply", "d06_inventory_efficiency", "f02_product_features", "vz10_days_histogram", "vz11_warehouse_quadrant"):
        name = next(n for n in registry.PLANS if n.startswith(name.split("_")[0] + "_"))
        plan = registry.PLANS[name](registry.tables(spark, data))._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "percentile" not in plan.replace("rank_percentile", "") and "median(" not in plan, name
