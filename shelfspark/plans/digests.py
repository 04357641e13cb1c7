"""Digest trees: tables are compared by folded row hashes, and only key ranges whose digests differ are opened."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.sources.scratch import stored

#: Leaves of a tree, and leaves below one of its inner nodes.
LEAVES, FAN_OUT = 4096, 64


def text_hash(columns: Sequence[str]) -> Column:
    """48 bits of a row's values as text (null: empty), the same in any engine that has MD5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def folded(h: Column) -> list[Column]:
    """Count, exclusive or and sum of hashes: the same in any order, and mergeable. A row twice changes count and sum."""
    return [F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum")]


def merged() -> list[Column]:
    return [F.sum("rows").alias("rows"), F.bit_xor("hash_xor").alias("hash_xor"), F.sum("hash_sum").alias("hash_sum")]


def content_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, hash_xor and hash_sum (text) of a table, whatever the order of its rows."""
    return df.select(text_hash(columns).alias("h")).agg(*folded(F.col("h"))).withColumn("hash_sum", F.col("hash_sum").cast("string"))


def leaf_of(keys: Sequence[str], leaves: int = LEAVES) -> Column:
    """The range of key hashes that a row belongs to."""
    return F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("int")


def tree(df: DataFrame, keys: Sequence[str], values: Sequence[str], leaves: int = LEAVES) -> DataFrame:
    """leaf, rows, hash_xor, hash_sum: the digest of each range of keys, summed by task before the shuffle; ``leaves`` rows at most."""
    hashed = df.select(leaf_of(keys, leaves).alias("leaf"), F.xxhash64(*keys, *values).alias("h"))
    return hashed.groupBy("leaf").agg(*folded(F.col("h")))


def inner_nodes(leaves: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """The level above: a digest for each ``fan_out`` leaves."""
    return leaves.groupBy(F.floor(F.col("leaf") / fan_out).cast("int").alias("node")).agg(*merged())


def _differing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose digests are not the same on both sides."""
    parts = ["rows", "hash_xor", "hash_sum"]
    other = b.select(F.col(key).alias("_k"), *[F.col(p).alias(f"_{p}") for p in parts])
    same = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts]
    both = a.join(other, F.col(key) == F.col("_k"), "full")
    return both.filter(~(same[0] & same[1] & same[2])).select(F.coalesce(key, "_k").alias(key))


@dataclass(frozen=True)
class Reconciled:
    """What two tables disagree on: rows (keys, status), ranges opened and ranges in all."""

    rows: DataFrame
    opened: list[int]
    leaves: int


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], leaves: int = LEAVES, fan_out: int = FAN_OUT) -> Reconciled:
    """Keys that only ``a`` or only ``b`` has, or whose values differ: status only_left, only_right or changed.

    Both sides are read once for their trees. Digests are compared from the top: below an inner node that agrees no
    leaf is looked at, and only rows of leaves that differ are read again and joined, so equal tables are never
    shuffled. Values compare null-safe. A repeated key is compared as the multiset of its values. Two tables of one
    content have one digest; that two others share all three parts of one is as unlikely as a 64-bit collision.
    """
    trees = [stored(tree(df, keys, values, leaves)) for df in (a, b)]
    nodes = _differing(*[inner_nodes(t, fan_out) for t in trees], "node")
    inside = [t.withColumn("node", F.floor(F.col("leaf") / fan_out).cast("int")).join(nodes, "node", "left_semi").drop("node") for t in trees]
    opened = sorted(r.leaf for r in _differing(*inside, "leaf").collect())  # ``leaves`` numbers at most
    wanted = F.array_contains(F.array(*map(F.lit, opened)), leaf_of(keys, leaves)) if opened else F.lit(False)
    state = F.sort_array(F.collect_list(F.xxhash64(*values) if values else F.lit(0)))
    grouped = [df.filter(wanted).groupBy(*keys).agg(state.alias(side)) for df, side in ((a, "left_side"), (b, "right_side"))]
    right = grouped[1].select(*[F.col(k).alias(f"_{k}") for k in keys], "right_side")
    met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = grouped[0].join(right, met, "full").filter(~F.col("left_side").eqNullSafe(F.col("right_side")))
    status = F.when(F.col("right_side").isNull(), "only_left").when(F.col("left_side").isNull(), "only_right").otherwise("changed")
    return Reconciled(both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], status.alias("status")), opened, leaves)


def reconciliation(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row: opened_ranges, only_left, only_right and changed."""
    found = reconcile(a, b, keys, values)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("only_left", "only_right", "changed")]
    return found.rows.agg(*counts).select(F.lit(len(found.opened)).cast("long").alias("opened_ranges"), "only_left", "only_right", "changed")
