"""Ranks and running sums over all rows of a table, without bringing them to one task."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.sources.scratch import stored


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank", sums: Sequence[str] = ()) -> DataFrame:
    """``df`` with its place in a total order (from 1), n_all, and running_x and all_x (decimals) for each column x of ``sums``.

    Rows are sorted in ranges over many tasks and written with the number of their range, so that a lost executor cannot
    deal them anew. Ranges are numbered inside; what comes before a range is one row for each range.
    """
    spark, part, kind = df.sparkSession, "_part", "decimal(38,6)"
    none, amount = F.lit(0).cast(kind), lambda x: F.col(x).cast(kind)
    ranges = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counted = ranges.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(amount(x)), none).alias(x) for x in sums])
    totals = sorted(tuple(r) for r in counted.collect())  # a row for each range
    before, rows = [0, *[Decimal(0)] * len(sums)], []
    for number, *amounts in totals:
        rows.append((number, *before))
        before = [b + a for b, a in zip(before, amounts, strict=True)]
    lead = spark.createDataFrame(rows, ", ".join([f"{part} int", "_n long", *[f"_{x} {kind}" for x in sums]]))
    inside = Window.partitionBy(part).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranges.withColumns({rank: F.row_number().over(inside).cast("long")} | {f"running_{x}": F.coalesce(F.sum(amount(x)).over(so_far), none) for x in sums})
    placed = numbered.join(F.broadcast(lead), part)  # a row for each range
    columns = [(F.col(rank) + F.col("_n")).alias(rank), F.lit(before[0]).cast("long").alias("n_all")]
    columns += [c for i, x in enumerate(sums, 1) for c in ((F.col(f"running_{x}") + F.col(f"_{x}")).alias(f"running_{x}"), F.lit(before[i]).cast(kind).alias(f"all_{x}"))]
    return placed.select(*df.columns, *columns)


def top_of_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group. The filter stands directly on the rank, so each task keeps ``n`` rows of a group before they are shuffled."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def top_of_all(df: DataFrame, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of all, ranked: each task keeps ``n``, and only these are ranked together."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))
