"""Registration of file sources and sinks, contracts read as documents, and table digests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expressions import month_of
from shelfspark.operators import quality
from shelfspark.operators.registered_quality import CRITICAL, NON_NEGATIVE
from shelfspark.oracles.doubles import DOUBLES
from shelfspark.plans import digests
from shelfspark.registry import register
from shelfspark.schemas import KEYS, RAW
from shelfspark.sources import files
from shelfspark.sources.fixtures import Tables
from shelfspark.sources.scratch import scratch, stored

#: What is written to files here: dimensions, whose contracts are then read and run.
DIMENSIONS = ("products", "suppliers", "warehouses", "product_classification")


def _csv(t: Tables, name: str) -> str:
    path = scratch(t.spark)
    files.write_table(t.raw(name), path, "csv", RAW[name].names)
    return path


def csv_inferred(t: Tables) -> DataFrame:
    """Products through a CSV file whose types are inferred, read by SQL under a name."""
    files.read_csv(t.spark, _csv(t, "products"), view="csv_products")
    return t.spark.sql("SELECT category, count(*) AS n, sum(lead_time_days) AS lead_days, max(unit_price) AS top_price, typeof(max(shelf_life_days)) AS inferred FROM csv_products GROUP BY category")


DOUBLES["io01_csv_inferred"] = "top_price"
register("io01_csv_inferred", csv_inferred, "SELECT category, count(*) AS n, CAST(sum(lead_time_days) AS BIGINT) AS lead_days, max(unit_price) AS top_price, 'int' AS inferred FROM products GROUP BY category")


def csv_with_rejects(t: Tables) -> DataFrame:
    """Orders through a CSV file with dates, and with a line for each supplier whose date is none: good rows and rejects."""
    path = _csv(t, "purchase_orders")
    kinds = RAW["purchase_orders"]
    spoilt = {"supplier_id": F.col("supplier_id"), "order_date": F.lit("31/02/1996")}
    broken = t.suppliers.select(*[spoilt.get(f.name, F.lit("1996-01-01" if f.dataType.simpleString() == "date" else "7")).alias(f.name) for f in kinds.fields])
    broken.write.mode("append").option("header", True).csv(path)
    good, rejected = files.tolerant_csv(t.spark, path, kinds)
    good = good.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("n"), F.min("order_date").alias("first_order"), F.sum("ordered_units").alias("units"))
    lines = rejected.groupBy(F.split(F.col(files.REJECTED), ",")[1].alias("supplier_id")).agg(F.count(F.lit(1)).alias("rejected"))
    return good.join(lines, "supplier_id", "left")


register("io03_csv_dates", csv_with_rejects, "SELECT supplier_id, count(*) AS n, min(order_date) AS first_order, CAST(sum(ordered_units) AS BIGINT) AS units, CAST(1 AS BIGINT) AS rejected FROM purchase_orders GROUP BY supplier_id")


def views_replaced(t: Tables) -> DataFrame:
    """A view over a view; the first is replaced after, and the second goes on with what it was made of."""
    files.named(t.product_classification.filter("abc_class = 'A'"), "classified")
    files.named(t.spark.sql("SELECT criticality_level, count(*) AS n FROM classified GROUP BY criticality_level"), "levels")
    files.named(t.product_classification, "classified")
    return t.spark.sql("SELECT 'levels' AS view_name, criticality_level, n FROM levels UNION ALL SELECT 'classified', criticality_level, count(*) FROM classified GROUP BY criticality_level")


register("io05_named_views", views_replaced, "SELECT 'levels' AS view_name, criticality_level, count(*) AS n FROM product_classification WHERE abc_class = 'A' GROUP BY 2 UNION ALL SELECT 'classified', criticality_level, count(*) FROM product_classification GROUP BY 2")


def month_overwritten(t: Tables) -> DataFrame:
    """Demand by month as a partitioned table, of which the last month is then replaced by a revision (twice the demand)."""
    demand = t.demand_history.withColumn("month", month_of())
    path = scratch(t.spark)
    files.write_partitioned(demand, path, "month")
    table = files.read_partitioned(t.spark, path, demand.schema)
    last = table.agg(F.max("month")).first()[0]
    revised = table.filter(F.col("month") == last).withColumn("units_demanded", F.col("units_demanded") * 2)
    files.write_partitioned(stored(revised), path, "month")  # Spark does not replace what it is reading
    back = files.read_partitioned(t.spark, path, demand.schema)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("units_demanded").alias("units"))


register(
    "io06_partitioned_sink", month_overwritten,
    "SELECT month, count(*) AS n, CAST(sum(CASE WHEN month = last THEN 2 ELSE 1 END * units_demanded) AS BIGINT) AS units FROM (SELECT *, max(month) OVER () AS last FROM (SELECT units_demanded, date_trunc('month', date) AS month FROM demand_history)) GROUP BY month",
)


def sink_checked(t: Tables) -> DataFrame:
    """Each table through the sink with the columns that it must have; of products a second time without unit_cost, which the sink refuses."""
    lines = []
    for name, df in [*[(n, t.raw(n)) for n in DIMENSIONS], ("products", t.products.drop("unit_cost"))]:
        path, refused = scratch(t.spark), ""
        try:
            files.write_table(df, path, expected=RAW[name].names)
        except ValueError as error:
            refused = str(error)
        written = files.optional(t.spark, path, df.schema)
        lines.append(written.agg(F.count(F.lit(1)).alias("rows_written")).select(F.lit(name).alias("table_name"), F.lit(refused).alias("refused"), "rows_written"))
    return quality.union(lines)


register("io07_sink_columns", sink_checked, " UNION ALL ".join([f"SELECT '{n}' AS table_name, '' AS refused, count(*) AS rows_written FROM {n}" for n in DIMENSIONS] + ["SELECT 'products', 'missing columns: unit_cost', 0"]))


def contract_document(t: Tables, missing: str | None = None) -> tuple[str, str]:
    """(document, folder): the contracts of the dimensions as one JSON document, and their tables as files.

    The file of products lacks unit_cost, and the table named ``missing`` has no file.
    """
    folder, document = scratch(t.spark), scratch(t.spark)
    for name in DIMENSIONS:
        if name != missing:
            files.write_table(t.raw(name).drop("unit_cost") if name == "products" else t.raw(name), f"{folder}/{name}")
    tables = [{"name": n, "path": n, "required_columns": RAW[n].names, "unique_key": KEYS[n], "critical_columns": CRITICAL[n], "non_negative": NON_NEGATIVE[n]} for n in DIMENSIONS]
    t.spark.createDataFrame([(json.dumps({"tables": tables}, indent=1),)], "value string").coalesce(1).write.text(document)
    return document, folder


def contract_source(t: Tables, missing: str | None = "warehouses") -> DataFrame:
    """Results of a contract document over files: a missing file, a missing column, and checks of the others."""
    document, folder = contract_document(t, missing)
    return quality.run_contracts(t.spark, files.read_contracts(t.spark, document), folder)


def _file_contracts(missing: str | None, check: str | None = None) -> str:
    from shelfspark.operators.registered_quality import _contract_sql

    kept = [n for n in DIMENSIONS if n not in (missing, "products")]
    lines = [f"SELECT * FROM ({_contract_sql(check)}) WHERE table_name IN ({', '.join(map(repr, kept))})"]
    lines.append("SELECT 'products', 'required_columns_present', 'HIGH', 'FAIL', 1, 0, 'missing: unit_cost'")
    if missing:
        lines.append(f"SELECT '{missing}', 'table_exists', 'HIGH', 'FAIL', 1, 0, 'missing: {missing}'")
    return " UNION ALL ".join(lines)


register("io08_contract_source", contract_source, _file_contracts("warehouses"))
register("dc01_required_columns_of_files", lambda t: contract_source(t, None).filter("check_name = 'required_columns_present'"), _file_contracts(None, "required_columns_present"))


def optional_sources(t: Tables) -> DataFrame:
    """Rows of a source that is there and of one that is not."""
    there, gone = f"{t.folder}/supplier.parquet", f"{t.folder}/no_such_table.parquet"
    one = lambda name, path: files.optional(t.spark, path, t.read("supplier").schema).agg(F.count(F.lit(1)).alias("n"), F.count("s_suppkey").alias("keys")).select(F.lit(name).alias("source_name"), "n", "keys")
    return one("supplier", there).unionByName(one("no_such_table", gone))


register("io09_optional_source", optional_sources, "SELECT 'supplier' AS source_name, count(*) AS n, count(s_suppkey) AS keys FROM supplier UNION ALL SELECT 'no_such_table', 0, 0")

# -- digests ----------------------------------------------------------------------------------------------------------


def _text_columns(name: str) -> list[str]:
    """Columns whose text is the same in every engine: all but floating-point ones."""
    return [f.name for f in RAW[name].fields if f.dataType.simpleString() != "double"]


def _digest_sql(name: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _text_columns(name)) + ")"
    return f"SELECT '{name}' AS table_name, count(*) AS rows, bit_xor(h) AS hash_xor, CAST(sum(h) AS VARCHAR) AS hash_sum FROM (SELECT CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) AS h FROM {name})"


register("ag21_content_digest", lambda t: quality.union([digests.content_digest(t.raw(n), _text_columns(n)).withColumn("table_name", F.lit(n)) for n in RAW]), " UNION ALL ".join(map(_digest_sql, RAW)))
_GRAIN = ["date", "warehouse_id", "product_id"]
_SIDES = """(SELECT * FROM (SELECT date, warehouse_id, product_id, units_demanded AS a, 1 AS l FROM demand_history) x FULL JOIN (SELECT date, warehouse_id, product_id, units_demanded AS b, 1 AS r FROM daily) y USING (date, warehouse_id, product_id))"""
register(
    "jn11_digest_reconciliation", lambda t: digests.reconciliation(t.demand_history, t.daily, _GRAIN, ["units_demanded"]),
    f"SELECT CAST(0 AS BIGINT) AS opened_ranges, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, count(*) FILTER (a <> b) AS changed FROM {_SIDES}",
)
