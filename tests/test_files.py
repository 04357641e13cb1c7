"""CSV with rejects, contracts as documents, sinks that refuse, digest trees."""

import datetime
import json
import pathlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators import quality
from shelfspark.plans import digests
from shelfspark.sources import files
from shelfspark.sources.scratch import scratch

KINDS = T.StructType([T.StructField("k", T.StringType()), T.StructField("day", T.DateType()), T.StructField("n", T.LongType())])


def local(spark):
    folder = pathlib.Path(scratch(spark).removeprefix("file:"))
    folder.mkdir(parents=True)
    return folder


def test_rejected_lines_stay_whole(spark):
    folder = local(spark)
    (folder / "a.csv").write_text('k,day,n\na,05.03.2020,1\nb,31.02.2020,2\n"c, quoted",06.03.2020,3\n')
    (folder / "b.csv").write_text("k,day,n\nd,07.03.2020,x\ne,08.03.2020\nf,09.03.2020,,more\ng,,\n")
    good, rejected = files.tolerant_csv(spark, str(folder), KINDS, "dd.MM.yyyy")
    rows = sorted(map(tuple, good.collect()))
    assert rows == [("a", datetime.date(2020, 3, 5), 1), ("c, quoted", datetime.date(2020, 3, 6), 3), ("g", None, None)]
    assert sorted(r._rejected for r in rejected.collect()) == ["b,31.02.2020,2", "d,07.03.2020,x", "e,08.03.2020", "f,09.03.2020,,more"]
    assert good.select("k").count() == 3 and rejected.filter("file like '%b.csv'").count() == 3


def test_inferred_types_and_views(spark):
    folder = local(spark)
    (folder / "a.csv").write_text("n,x,s\n1,1.5,a\n2,2.5,b\n")
    df = files.read_csv(spark, str(folder), view="from_csv")
    assert df.dtypes == [("n", "int"), ("x", "double"), ("s", "string")] and spark.sql("SELECT sum(n) AS s FROM from_csv").first().s == 3


def test_contract_documents(spark):
    """A missing column ends a contract, a missing file fails it, and the other checks count rows."""
    folder, document = local(spark), local(spark)
    spark.createDataFrame([(1, -2.0, None), (1, 3.0, "x")], "id long, cost double, name string").write.parquet(str(folder / "good"))
    spark.createDataFrame([(1,)], "id long").write.parquet(str(folder / "short"))
    one = lambda name: {"name": name, "path": name, "required_columns": ["id", "cost"], "unique_key": ["id"], "critical_columns": ["name"], "non_negative": ["cost"]}
    (document / "contracts.json").write_text(json.dumps({"tables": [one("good"), one("short"), one("gone")]}, indent=2))
    contracts = files.read_contracts(spark, str(document))
    assert [tuple(r) for r in contracts.collect()] == [(n, n, ["id", "cost"], ["id"], ["name"], ["cost"]) for n in ("good", "short", "gone")]
    got = [(r.table_name, r.check_name, r.status, r.observed) for r in quality.run_contracts(spark, contracts, str(folder)).collect()]
    assert sorted(got) == [
        ("gone", "table_exists", "FAIL", 1), ("good", "critical_not_null", "FAIL", 1), ("good", "non_negative", "FAIL", 1), ("good", "required_columns_present", "PASS", 0), ("good", "unique_key", "FAIL", 1), ("short", "required_columns_present", "FAIL", 1),
    ]


def test_only_a_missing_path_is_an_empty_source(spark):
    folder = local(spark)
    assert files.optional(spark, str(folder / "none"), KINDS).count() == 0
    with pytest.raises(Exception, match="no_such_format"):
        files.optional(spark, str(folder), KINDS, fmt="no_such_format").count()


def test_sink_refuses_missing_columns(spark):
    path = scratch(spark)
    with pytest.raises(ValueError, match="missing columns: b, c"):
        files.write_table(spark.range(3).selectExpr("id AS a"), path, expected=["a", "b", "c"])
    assert not pathlib.Path(path.removeprefix("file:")).exists()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") % 7).alias("v"))


def test_equal_tables_open_nothing(rows):
    found = digests.reconcile(rows, rows.repartition(5).orderBy("v"), ["k"], ["v"])
    assert found.opened == [] and found.rows.count() == 0


def test_one_changed_row_opens_one_range(rows):
    changed = rows.withColumn("v", F.when(F.col("k") == "k777", F.lit(99).cast("long")).otherwise(F.col("v")))
    found = digests.reconcile(rows, changed, ["k"], ["v"])
    assert len(found.opened) == 1 and [tuple(r) for r in found.rows.collect()] == [("k777", "changed")]
    plan = found.rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") >= 2  # only rows of that range are joined


def test_lost_added_null_and_repeated_rows(spark, rows):
    left = rows.unionByName(spark.createDataFrame([(None, 1), ("same", None), ("twice", 1), ("twice", 2)], "k string, v long"))
    right = rows.filter("k <> 'k5'").unionByName(spark.createDataFrame([(None, 2), ("same", None), ("twice", 2), ("twice", 2), ("new", 1)], "k string, v long"))
    found = digests.reconcile(left, right, ["k"], ["v"])
    assert {tuple(r) for r in found.rows.collect()} == {("k5", "only_left"), ("new", "only_right"), (None, "changed"), ("twice", "changed")}
    assert 0 < len(found.opened) <= 4
    got = digests.reconciliation(left, right.limit(0), ["k"], ["v"]).first()
    assert got.only_left == 20_003 and got.only_right == got.changed == 0


def test_trees_fold_to_the_table(rows):
    leaves = digests.tree(rows, ["k"], ["v"])
    top = digests.inner_nodes(leaves, digests.LEAVES).first()
    whole = rows.select(F.xxhash64("k", "v").alias("h")).agg(*digests.folded(F.col("h"))).first()
    assert tuple(top)[1:] == tuple(whole)
