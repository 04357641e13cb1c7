"""The seven raw tables of the supply chain, derived from a retail order schema by integer arithmetic."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.sources.files import bucketed, read_partitioned, write_partitioned
from shelfspark.sources.scratch import scratch


#: Day, region and part: the integer keys of both daily facts.
GRAIN = ["pk", "rk", "d"]
#: Order lines that one bucket of a written fact stands for: a task's memory does not grow with the table.
BUCKET_LINES = 400_000
#: A table of more rows than this is never broadcast whole: a compressed file's bytes say little about what its rows take in the driver.
BROADCAST_ROWS = 200_000


class Tables:
    """Raw tables of one folder, as lazy DataFrames. Nothing is read before an action."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._kept: dict[str, DataFrame] = {}
        self._rows: dict[str, int] = {}

    def many(self, name: str) -> bool:
        """Whether a table has too many rows for the driver, as its files' footers count them."""
        if name not in self._rows:
            self._rows[name] = self.read(name).count()
        return self._rows[name] > BROADCAST_ROWS

    def spread(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, a row or less for each row of the table ``name``, to be met by sorting where that table has too many rows to be broadcast."""
        return df.hint("merge") if self.many(name) else df

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A result that several queries start from, computed once (in memory, on disk beyond it)."""
        if name not in self._kept:
            self._kept[name] = make().persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept[name]

    def write(self, name: str, make: Callable[[], DataFrame], *by: str) -> DataFrame:
        """A result that several queries start from, written once to the shared folder, partitioned by the columns ``by``."""
        if name not in self._kept:
            made = make()
            path = scratch(self.spark)
            write_partitioned(made, path, *by)
            self._kept[name] = read_partitioned(self.spark, path, made.schema)
        return self._kept[name]

    def bucket(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A result by SKU that several queries start from, written once in buckets of ``product_id``.

        What is grouped or joined by product and more, starting from such a table, needs no exchange; only the columns
        that a query names are read. ``make`` starts from such a table or is dealt to as many partitions.
        """
        if name not in self._kept:
            self._kept[name] = bucketed(make(), self.buckets, "product_id")
        return self._kept[name]

    @cached_property
    def buckets(self) -> int:
        """How many buckets the facts have: more for more order lines."""
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(least, math.ceil(self.read("lineitem").count() / BUCKET_LINES))  # counted from the files' footers

    def dealt(self, df: DataFrame, *by: str) -> DataFrame:
        """``df`` dealt by its keys where it is larger than the default number of partitions is meant for."""
        return df.repartition(self.buckets, *by) if self.buckets > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else df

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def products(self) -> DataFrame:
        part = self.read("part")
        bounds = self.read("supplier").agg(F.min("s_suppkey").alias("first"), F.count(F.lit(1)).alias("n"))
        abc = _abc(F.col("p_partkey"))
        named = part.crossJoin(F.broadcast(bounds)).select(  # one row of bounds
            F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            (F.col("p_retailprice") * (F.lit(0.40) + (F.col("p_partkey") % 5).cast("double") * F.lit(0.05))).alias("unit_cost"),
            F.col("p_retailprice").alias("unit_price"),
            (30 * F.col("p_size")).cast("long").alias("shelf_life_days"),
            F.concat(F.lit("SUP-"), F.col("first") + F.col("p_partkey") % F.col("n")).alias("supplier_id"),
            (3 + F.col("p_size") % 25).cast("long").alias("lead_time_days"),
            F.when(abc == "A", 0.98).when(abc == "B", 0.95).otherwise(0.90).alias("target_service_level"),
        )
        return self.spread(named, "part")

    @cached_property
    def suppliers(self) -> DataFrame:
        places = self.read("nation").join(F.broadcast(self.read("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        key = F.col("s_suppkey")
        named = self.read("supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("SUP-"), key).alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.col("r_name").alias("supplier_region"),
            (F.lit(0.70) + (key % 6).cast("double") * F.lit(0.05)).alias("reliability_score"),
            (5 + key % 20).alias("average_lead_time_days"),
            (F.lit(0.10) + (key % 5).cast("double") * F.lit(0.10)).alias("lead_time_variability"),
            (100 + 50 * (key % 10)).alias("minimum_order_qty"),
        )
        return self.spread(named, "supplier")

    @cached_property
    def warehouses(self) -> DataFrame:
        return self.read("region").select(
            F.concat(F.lit("WH-"), F.col("r_regionkey")).alias("warehouse_id"), F.col("r_name").alias("warehouse_name"), F.col("r_name").alias("region"), (20000 + 5000 * F.col("r_regionkey").cast("long")).alias("storage_capacity_units")
        )

    @cached_property
    def product_classification(self) -> DataFrame:
        abc = _abc(F.col("p_partkey"))
        classes = self.read("part").select(F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("product_id"), abc.alias("abc_class"), F.when(abc == "A", "High").when(abc == "B", "Medium").otherwise("Low").alias("criticality_level"))
        return self.spread(classes, "part")

    @cached_property
    def _lines(self) -> DataFrame:
        """Order lines, what is summed later derived before they are dealt, so that few columns travel."""
        lines = self.read("lineitem").withColumns({"pk": F.col("l_partkey"), "d": F.to_date("l_shipdate"), "units": F.col("l_quantity").cast("long")})
        demanded = F.when((F.col("pk") % 20 == 7) & (F.col("l_returnflag") == "N"), 0).otherwise(F.col("units"))
        lost = F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_quantity") * (F.col("pk") % 5) / F.lit(10.0))).otherwise(0)
        received = F.col("units") - F.floor(F.col("l_quantity") * F.col("l_discount")).cast("long")
        return lines.select("l_orderkey", "l_linenumber", "l_suppkey", "pk", "d", "units", demanded.alias("demanded"), lost.alias("lost"), received.alias("received"))

    def _ordered(self, lines: DataFrame) -> DataFrame:
        """Order lines with the day of their order and the region of their customer; places are few."""
        places = self.read("nation").join(F.broadcast(self.read("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        buyers = self.read("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").cast("long").alias("rk"))
        orders = self.read("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("ordered"))
        orders = self.dealt(orders, "o_custkey") if self.many("customer") else orders
        orders = orders.join(self.spread(buyers, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "ordered", "rk")
        return self.dealt(lines, "l_orderkey").join(self.dealt(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))

    def _with_part(self, lines: DataFrame, *columns: F.Column) -> DataFrame:
        """Order lines with columns of their part."""
        part = self.read("part").select("p_partkey", *columns)
        lines = self.dealt(lines, "pk") if self.many("part") else lines
        return lines.join(self.spread(part, "part"), F.col("pk") == F.col("p_partkey"))

    @cached_property
    def _days(self) -> DataFrame:
        """What both facts are made from, read from the lines once: a row for each day, region and part, with the part's cost.

        It is written in buckets of its keys (a join takes buckets by all of its keys only), so that facts projected from it
        meet without moving.
        """
        cost = (F.col("p_retailprice") * (F.lit(0.40) + (F.col("p_partkey") % 5).cast("double") * F.lit(0.05))).alias("cost")
        lines = self._with_part(self._ordered(self._lines), cost, (F.col("p_type") == "PROMO").cast("long").alias("promo"))
        dealt = lines.select(*GRAIN, "cost", "promo", "demanded", "lost").repartition(self.buckets, *GRAIN)
        days = dealt.groupBy(*GRAIN).agg(F.min("cost").alias("cost"), F.min("promo").alias("promo"), F.sum("demanded").cast("long").alias("demanded"), F.sum("lost").cast("long").alias("lost"))
        regions = self.read("region").groupBy(F.col("r_regionkey").cast("long").alias("rk")).agg(F.min("r_name").alias("region"))
        return bucketed(days.join(F.broadcast(regions), "rk").select(*GRAIN, "region", "cost", "promo", "demanded", "lost"), self.buckets, *GRAIN)

    @cached_property
    def _demand(self) -> DataFrame:
        return self._days.select(
            *GRAIN,
            F.col("d").alias("date"),
            F.concat(F.lit("WH-"), F.col("rk")).alias("warehouse_id"),
            F.concat(F.lit("SKU-"), F.col("pk")).alias("product_id"),
            "region",
            F.col("demanded").alias("units_demanded"),
            (F.col("demanded") - F.col("lost")).alias("units_fulfilled"),
            F.col("lost").alias("units_lost_sales"),
            (F.col("lost") > 0).cast("long").alias("stockout_flag"),
            F.col("promo").alias("promo_flag"),
            (F.lit(0.90) + F.lit(0.02) * F.month("d").cast("double")).alias("seasonality_index"),
        )

    @cached_property
    def _stock(self) -> DataFrame:
        day, pk = F.dayofyear("d"), F.col("pk")
        k = (pk * 37 + day * 11 + F.col("rk") * 5) % 61
        on_hand = k * 5 + pk % 7
        return self._days.select(
            *GRAIN,
            F.col("d").alias("snapshot_date"),
            F.concat(F.lit("WH-"), F.col("rk")).alias("warehouse_id"),
            F.concat(F.lit("SKU-"), pk).alias("product_id"),
            on_hand.alias("on_hand_units"),
            ((pk * 3 + day) % 40).alias("on_order_units"),
            (pk % 7).alias("reserved_units"),
            (k * 5).alias("available_units"),
            (on_hand.cast("double") * F.col("cost")).alias("inventory_value"),
            (k.cast("double") * (F.lit(0.25) + (pk % 8).cast("double") * F.lit(0.25))).alias("days_of_supply"),
        )

    @cached_property
    def demand_history(self) -> DataFrame:
        return self._demand.drop(*GRAIN)

    @cached_property
    def inventory_snapshots(self) -> DataFrame:
        return self._stock.drop(*GRAIN)

    @cached_property
    def purchase_orders(self) -> DataFrame:
        # parts first: lines dealt by their order are grouped where they are
        lines = self._ordered(self._with_part(self._lines, (3 + F.col("p_size") % 25).alias("lead")))
        late = F.greatest(F.lit(1), F.col("lead") + (F.col("l_orderkey") * 5 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 12 - 6 + F.col("l_suppkey") % 5)
        lines = lines.withColumns({"expected": F.date_add("ordered", F.col("lead").cast("int")), "actual": F.date_add("ordered", late.cast("int"))})
        keys = ["l_orderkey", "l_linenumber", "pk", "l_suppkey"]
        grouped = lines.groupBy(*keys).agg(
            F.min("rk").alias("rk"), F.min("ordered").alias("order_date"), F.min("expected").alias("expected_arrival_date"), F.max("actual").alias("actual_arrival_date"),
            F.sum("units").alias("ordered_units"), F.sum("received").alias("received_units"),
        )
        dash = F.lit("-")
        return grouped.select(
            F.concat(F.lit("PO-"), "l_orderkey", dash, "l_linenumber", dash, "pk", dash, "l_suppkey").alias("po_id"),
            F.concat(F.lit("SUP-"), "l_suppkey").alias("supplier_id"),
            F.concat(F.lit("SKU-"), "pk").alias("product_id"),
            F.concat(F.lit("WH-"), "rk").alias("warehouse_id"),
            "order_date", "expected_arrival_date", "actual_arrival_date", "ordered_units", "received_units",
            (F.col("actual_arrival_date") > F.col("expected_arrival_date")).cast("long").alias("late_delivery_flag"),
        )

    def raw(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def daily(self) -> DataFrame:
        """The canonical daily fact, written once, as nearly every operator starts from it."""
        from shelfspark.plans.views import daily_metrics

        small = lambda df: df.hint("shuffle_hash")  # noqa: E731 - a bucket's days or products; the fact need not be sorted
        return self.bucket("daily", lambda: daily_metrics(self._demand, small(self._stock), small(self.products), self.warehouses, small(self.product_classification), on=GRAIN, parts=self.buckets))

    def by_product(self, suppliers: DataFrame, *columns: str) -> DataFrame:
        """Columns of suppliers for each product, so that a fact by product meets them without moving."""
        named = self.products.select("product_id", "supplier_id").join(self.spread(suppliers.select("supplier_id", *columns), "supplier"), "supplier_id", "left")
        return named.select("product_id", *columns).hint("shuffle_hash")


def _abc(key: F.Column) -> F.Column:
    return F.when(key % 10 < 2, "A").when(key % 10 < 5, "B").otherwise("C")
