"""Exact quantiles by distributed selection: bins are counted, and only the bins that hold a wanted rank are looked into again."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.sources.scratch import stored

#: Bins that a range of values is cut into in one pass; values up to which a range is listed value by value instead.
BINS, LISTED = 1024, 1024
#: Ranges (groups x columns x ranks) that one call may follow; the driver holds a few numbers for each.
MOST_RANGES = 4096


@dataclass(frozen=True)
class Range:
    """Values from low to high of one column of one group: how many there are, and how many lie below."""

    low: float
    high: float
    n: int
    before: int


def places(q: float, n: int) -> tuple[int, int, float]:
    """Ranks (from 0) of the two neighbours of a quantile of n values, and the weight of the second."""
    at = q * (n - 1)
    return math.floor(at), math.ceil(at), at - math.floor(at)


def _bins(long: DataFrame, followed: dict[tuple, list[Range]], keys: Sequence[str]) -> dict[tuple, list[tuple[Range, list[Range]]]]:
    """Each range with its bins in ascending order, from one pass over the values."""
    spark = long.sparkSession
    kinds = {f.name: f.dataType for f in long.schema.fields}
    schema = ", ".join([f"{k} {kinds[k].simpleString()}" for k in (*keys, "name")]) + ", at int, low double, high double, n long"
    rows = [(*of, i, r.low, r.high, r.n) for of, ranges in followed.items() for i, r in enumerate(ranges)]
    known = spark.createDataFrame(rows, schema).withColumnsRenamed({k: f"_{k}" for k in (*keys, "name")})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "name")]
    met = long.join(F.broadcast(known), [*same, F.col("x") >= F.col("low"), F.col("x") <= F.col("high")])  # MOST_RANGES rows at most
    half = lambda c: F.col(c) / 2  # noqa: E731 - a difference of halves does not overflow
    width = half("high") - half("low")
    place = F.when((F.col("n") <= LISTED) | (width == 0) | (F.abs("x") == math.inf), F.col("x")).otherwise(F.floor((half("x") - half("low")) / width * BINS).cast("double"))
    counted = met.groupBy(*[f"_{k}" for k in (*keys, "name")], "at", place.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    found: dict[tuple, list] = defaultdict(list)
    for r in counted.collect():  # BINS rows for each range at most
        found[(*tuple(r)[: len(keys) + 1], r.at)].append((r.lo, r.hi, r.k))
    out: dict[tuple, list[tuple[Range, list[Range]]]] = {}
    for of, ranges in followed.items():
        out[of] = []
        for i, r in enumerate(ranges):
            before, parts = r.before, []
            for lo, hi, k in sorted(found[(*of, i)]):
                parts.append(Range(lo, hi, k, before))
                before += k
            out[of].append((r, parts))
    return out


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], keys: Sequence[str] = ()) -> dict[tuple, dict[str, list[float | None]]]:
    """Interpolated quantiles of some columns for each group of ``keys``: {key values: {column: [a value for each wanted share]}}.

    The values are written once, without the other columns. Each pass counts the bins of all ranges of all columns
    and groups, summed by task first; a range that holds a wanted rank goes on with the least and greatest value of
    its bin, until it holds one value only. Ranges of few values are listed at once, so a pass divides a range by
    ``BINS`` or ends it. Nulls and NaN are left out; a group without values has null quantiles.

    Meant for few large groups: beyond ``MOST_RANGES`` ranges it is an error (there a window for each group is the plan).
    """
    return _selected(stored(_long(df, list(wanted), keys)), wanted, keys)


def quantiles_of_tables(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], shares: Sequence[float]) -> dict[str, dict[str, list[float | None]]]:
    """{table: {column: its quantiles}} for some columns of several tables, all in the same passes."""
    parts = [_long(df, columns, (), f"{table}.") for table, (df, columns) in tables.items()]
    found = _selected(stored(reduce(DataFrame.unionByName, parts)), {f"{t}.{c}": shares for t, (_, columns) in tables.items() for c in columns}, ())[()]
    return {t: {c: found[f"{t}.{c}"] for c in columns} for t, (_, columns) in tables.items()}


def _long(df: DataFrame, columns: Sequence[str], keys: Sequence[str], prefix: str = "") -> DataFrame:
    """keys, name, x: a row for each value of each column."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(prefix + c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])))


def _selected(written: DataFrame, wanted: Mapping[str, Sequence[float]], keys: Sequence[str]) -> dict[tuple, dict[str, list[float | None]]]:
    long = written.filter("x is not null and not isnan(x)")
    groups = [tuple(r) for r in written.select(*keys).distinct().limit(MOST_RANGES + 1).collect()] if keys else [()]
    if len(groups) * sum(2 * len(q) for q in wanted.values()) > MOST_RANGES:
        raise ValueError("too many groups to select quantiles of")
    whole = long.groupBy(*keys, "name").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).collect()
    size = {tuple(r)[: len(keys) + 1]: Range(r.low, r.high, r.n, 0) for r in whole}
    ranks = {(*g, c): sorted({p for q in wanted[c] for p in places(q, size[(*g, c)].n)[:2]}) for g in groups for c in wanted if (*g, c) in size}
    value: dict[tuple, dict[int, float]] = {of: {} for of in ranks}
    followed = {of: [size[of]] for of in ranks}
    while followed := {of: r for of, r in followed.items() if r}:
        ahead: dict[tuple, list[Range]] = {}
        closed = {of: [r for r in ranges if r.low == r.high] for of, ranges in followed.items()}
        open_ = {of: kept for of, ranges in followed.items() if (kept := [r for r in ranges if r.low < r.high])}
        for of, found in (_bins(long, open_, keys) if open_ else {}).items():
            ahead[of] = [part for _, parts in found for part in parts if any(part.before <= k < part.before + part.n for k in ranks[of])]
        for of, ranges in [*closed.items(), *ahead.items()]:
            for r in ranges:
                if r.low == r.high:
                    value[of].update((k, r.low) for k in ranks[of] if r.before <= k < r.before + r.n)
        followed = {of: [r for r in ranges if r.low < r.high] for of, ranges in ahead.items()}

    def between(of: tuple, q: float) -> float | None:
        if of not in value:
            return None
        a, b, w = places(q, size[of].n)
        return value[of][a] * (1 - w) + value[of][b] * w if w else value[of][a]

    return {g: {c: [between((*g, c), q) for q in shares] for c, shares in wanted.items()} for g in groups}


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], keys: Sequence[str] = ()) -> DataFrame:
    """``exact_quantiles`` as rows: the keys, and for each column an array of its quantiles."""
    found = exact_quantiles(df, wanted, keys)
    kinds = dict(df.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{c} array<double>" for c in wanted])
    return df.sparkSession.createDataFrame([(*g, *[of[c] for c in wanted]) for g, of in found.items()], schema)
