import pytest

from shelfspark.operators import gates, quality
from shelfspark.operators.registered_quality import overclaiming, stated_rate
from shelfspark.schemas import RAW
from shelfspark.sources import files

CONTRACT = {"required": ["id", "value", "qty"], "keys": ["id"], "critical": ["value"], "non_negative": ["qty"]}


def statuses(df):
    return {r.check_name: r.status for r in quality.contract_results("t", df, **CONTRACT).collect()}


def test_contract(spark):
    good = spark.createDataFrame([(1, "a", 1), (2, "b", 0)], "id int, value string, qty int")
    assert set(statuses(good).values()) == {"PASS"}
    assert statuses(good.drop("qty")) == {"required_columns_present": "FAIL"}
    bad = spark.createDataFrame([(1, "a", 1), (1, "b", -1)], "id int, value string, qty int")
    assert statuses(bad) == {"required_columns_present": "PASS", "unique_key": "FAIL", "critical_not_null": "PASS", "non_negative": "FAIL"}
    assert set(statuses(good.limit(0)).values()) == {"PASS"}


@pytest.mark.parametrize(("layer", "status", "expected"), [("raw", "PASS", "decision-support only"), ("dashboard", "FAIL", "publish-blocked"), ("reporting", "WARN", "publish-blocked")])
def test_release_matrix(spark, layer, status, expected):
    checks = spark.createDataFrame([("a", "raw", "HIGH", "PASS"), ("b", layer, "HIGH", status)], "check_name string, layer string, severity string, status string")
    rows = gates.release_states(checks).collect()
    assert len(rows) == 6 and {r.release_classification for r in rows} == {expected}
    assert gates.confidence(checks).first().confidence_score == {"PASS": 100, "FAIL": 80, "WARN": 92}[status]


def test_no_result_blocks(spark):
    empty = spark.createDataFrame([], "check_name string, layer string, severity string, status string")
    assert gates.gate(empty).first().publish_blocked


def test_texts(spark):
    texts = spark.createDataFrame([("This always proves it; overall fill rate is 92.3%",), ("a proxy",)], "text string")
    row = overclaiming(texts).first()
    assert (row.causal_terms, row.hedging_terms, row.status) == (2, 1, "WARN")
    actual = spark.createDataFrame([(0.923,)], "x double")
    assert stated_rate(texts, r"fill rate is ([0-9.]+)%", actual, 0.001, 100.0).first().status == "PASS"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("WH-1", "a", "EU", 5)], RAW["warehouses"])
    files.write_table(df, f"{tmp_path}/w", "csv", RAW["warehouses"].names)
    assert files.read_csv(spark, f"{tmp_path}/w", RAW["warehouses"]).collect() == df.collect()
    assert files.optional(spark, f"{tmp_path}/none", RAW["warehouses"]).count() == 0
    with pytest.raises(ValueError):
        files.write_table(df.drop("region"), f"{tmp_path}/x", "csv", RAW["warehouses"].names)


def test_every_mismatch_is_shown(spark):
    """More rows than a first page, in order of their differences; rows within the tolerance are left out."""
    stock = spark.range(300).selectExpr("DATE '2020-01-01' AS snapshot_date", "'w' AS warehouse_id", "CAST(id AS STRING) AS product_id", "10L AS on_hand_units", "20.0D + IF(id < 250, 1 + id, 0.01D) AS inventory_value")
    products = spark.range(300).selectExpr("CAST(id AS STRING) AS product_id", "2.0D AS unit_cost")
    rows = quality.value_mismatches(stock, products).collect()
    assert [r.product_id for r in rows] == [str(i) for i in range(249, -1, -1)] and {r.expected_value for r in rows} == {20.0}
