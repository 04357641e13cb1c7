"""Readers and writers of CSV, Parquet and contract documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.sources.scratch import scratch, stored

CONTRACT = T.StructType([T.StructField("tables", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("path", T.StringType()), *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("required_columns", "unique_key", "critical_columns", "non_negative")],
])))])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, view: str | None = None, sampling: float = 1.0) -> DataFrame:
    """A CSV table with a header; ``view`` names it for SQL. Without a schema types are inferred from a share of the lines."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True).option("samplingRatio", sampling)).csv(path)
    return named(df, view) if view else df


REJECTED = "_rejected"


def tolerant_csv(spark: SparkSession, path: str, schema: T.StructType, date_format: str = "yyyy-MM-dd") -> tuple[DataFrame, DataFrame]:
    """Good rows of a CSV table with a header, and its rejected lines as text (column ``_rejected``) with their file.

    A line is rejected if a value does not parse to its type or date format, or if it has too few or too many values; it
    stays whole for whoever mends it. The text is parsed once, into a table that both results are read from.
    """
    read = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED).option("dateFormat", date_format)
    parsed = read.schema(T.StructType([*schema.fields, T.StructField(REJECTED, T.StringType())])).csv(path)
    lines = stored(parsed.withColumn("file", F.input_file_name()))
    good = lines.filter(F.col(REJECTED).isNull()).select(*schema.names)
    return good, lines.filter(F.col(REJECTED).isNotNull()).select(REJECTED, "file")


def named(df: DataFrame, view: str) -> DataFrame:
    df.createOrReplaceTempView(view)
    return df


def optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """The table at a path, or an empty one where there is none."""
    try:
        return spark.read.schema(schema).format(fmt).option("header", True).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", expected: list[str] | None = None) -> None:
    """Overwrite a table; missing expected columns are an error before anything is written."""
    if missing := sorted(set(expected or []) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Write a table partitioned by columns; of a table that is there only the partitions that ``df`` has are replaced.

    Rows are dealt out by those columns before, a large partition to several tasks and small ones to one together, so that a
    partition is a few files.
    """
    dealt = df.hint("rebalance", *by) if by else df
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A partitioned table. A filter on its partition columns leaves the other partitions unread."""
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, n: int, *by: str) -> DataFrame:
    """``df`` from a new table of ``n`` buckets by the columns ``by``: tables alike in these meet on them without an exchange.

    ``df`` should be dealt to ``n`` partitions by the same columns before, so that each task writes its own buckets only.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return spark.read.table(name)


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each table of a contract document: name, path and its lists of columns."""
    return spark.read.schema(CONTRACT).option("multiLine", True).json(path).select(F.explode("tables").alias("t")).select("t.*")
