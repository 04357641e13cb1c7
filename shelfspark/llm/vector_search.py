"""Exact top-k search by vector-approximation files.

Every vector is kept twice: exact, and as a few bits for each component that name the cell it lies in. Queries
scan the cells only; the bounds of the inner product that cells give rule out nearly all vectors. Exact vectors
are then read from the best bound on, until no bound left can reach the kth result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import stored

#: Factor before a component is cut to a whole number, and the bound on such numbers.
SCALE, LIMIT = 256, 1 << 26
#: Bits of a cell, vectors in a block of cells, queries in a block, one block in so many that goes first.
BITS, BLOCK, QUERIES, LEADS = 6, 4096, 512, 64
#: Pairs of vector and query that a task scans, and the most tasks of a scan.
TASK_PAIRS, MOST_TASKS = 100_000_000, 200_000
#: Exact vectors that are read first, as a multiple of the results wanted.
FIRST = 4


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (32-bit whole numbers, little-endian) of the vectors that take part."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    rows = rows.filter(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)))
    kind = rows.schema["id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            whole = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
            if len(whole) and np.abs(whole).max() >= LIMIT:
                raise ValueError(f"a component is beyond {LIMIT // SCALE}")
            offsets = pa.py_buffer(((at - at[0]) * 4).astype(np.int32).tobytes())
            blobs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(whole.astype("<i4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs], names=["id", "v"])

    return rows.mapInArrow(packed, f"id {kind}, v binary")


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """key, v, ids: each different vector once, with its ``k`` + 1 smallest ids.

    Equal vectors score alike and ties go to smaller ids, so a list of k takes no others, whichever of them is
    the query. Rows that repeat id and vector are one.
    """
    order = Window.partitionBy("v").orderBy("id")
    first = vectors.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    grouped = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return stored(grouped.select(F.monotonically_increasing_id().alias("key"), "v", "ids"))


@dataclass(frozen=True)
class Cells:
    """Bounds of the cells of each component, for vectors of one length: low[i, c] to high[i, c]."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def between(cls, cuts: list[list[int]]) -> Cells:
        """From the quantiles of each component, its least and greatest value among them."""
        n = 1 << BITS
        low, high = np.zeros((len(cuts), n)), np.zeros((len(cuts), n))
        for i, values in enumerate(cuts):
            starts = sorted(set(values))[:n]
            low[i], high[i] = starts[-1], values[-1]
            low[i, : len(starts)] = starts
            high[i, : len(starts)] = [*[x - 1 for x in starts[1:]], values[-1]]
        return cls(low, high)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(np.unique(low), column, "right") - 1 for low, column in zip(self.low, x.T, strict=True)], axis=1).astype(np.uint8) if x.size else np.zeros(x.shape, np.uint8)

    def pack(self, codes: np.ndarray) -> bytes:
        return np.packbits(np.unpackbits(codes[:, :, None], axis=2)[:, :, 8 - BITS :].reshape(len(codes), -1), axis=1).tobytes()

    def unpack(self, blob: bytes, n: int) -> np.ndarray:
        dims = len(self.low)
        bits = np.unpackbits(np.frombuffer(blob, np.uint8).reshape(n, -1), axis=1)[:, : dims * BITS].reshape(n, dims, BITS)
        return (bits * (1 << np.arange(BITS - 1, -1, -1)).astype(np.uint8)).sum(axis=2, dtype=np.uint8)

    def bounds(self, codes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products, queries x vectors; rounding errors widen them."""
        at = np.arange(len(self.low))
        low, high = self.low[at, codes], self.high[at, codes]
        q = queries.astype(np.float64)
        size = np.abs(q)
        centre, half = q @ ((low + high) / 2).T, size @ ((high - low) / 2).T
        half += 1e-12 * (size @ np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=1, initial=0.0))[:, None]
        return centre - half, centre + half


def cells_of(distinct: DataFrame) -> dict[int, Cells]:
    """Cells for each length of vectors, cut at quantiles of all different vectors."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, x, _ in by_length(batch.column(0)):
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(x.size, n)), pa.array(np.tile(np.arange(n), len(x))), pa.array(x.ravel())], names=["dims", "i", "x"])

    values = distinct.select("v").mapInArrow(spread, "dims long, i long, x int")
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    cuts = values.groupBy("dims", "i").agg(F.min("x").alias("low"), F.percentile_approx("x", steps, 2000).alias("cuts"), F.max("x").alias("high")).orderBy("dims", "i").collect()
    found: dict[int, list[list[int]]] = {0: []}
    for r in cuts:  # one row for each component, not for each vector
        found.setdefault(r.dims, []).append([r.low, *r.cuts, r.high])
    return {n: Cells.between(c) for n, c in found.items()}


def by_length(blobs: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, vectors, their places) for each length among packed vectors."""
    items = blobs.to_pylist()
    lengths = np.array([len(b) // 4 for b in items])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), np.frombuffer(b"".join(items[i] for i in at), "<i4").reshape(len(at), n), at


def _blocks(rows: DataFrame, size: int, encode: object) -> DataFrame:
    """dims, n, keys, data, leads: packed blocks of the rows key, v; ``encode`` makes the data of (dims, vectors)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        made = 0

        def block(dims: int) -> pa.RecordBatch:
            nonlocal made
            keys, x = (np.concatenate(parts) for parts in zip(*held.pop(dims), strict=True))
            made += 1
            row = {"dims": [dims], "n": [len(keys)], "keys": [keys.astype("<i8").tobytes()], "data": [encode(dims, x)], "leads": [made % LEADS == 1]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, batch.num_rows, size):
                for n, x, at in by_length(batch.column(1).slice(start, size)):
                    held.setdefault(n, []).append((keys[start + at], x))
                    if sum(len(k) for k, _ in held[n]) >= size:
                        yield block(n)
        for n in list(held):
            yield block(n)

    return rows.select("key", "v").mapInArrow(blocks, "dims long, n long, keys binary, data binary, leads boolean")


class Scan:
    """Scans blocks of cells for blocks of queries; keeps the best lower bounds of each query as it goes."""

    def __init__(self, cells: dict[int, Cells], want: int):
        self.cells, self.want = cells, want
        self.best: dict[bytes, np.ndarray] = {}

    def pair(self, q_keys: bytes, q_data: bytes, dims: int, n: int, data: bytes) -> np.ndarray:
        """Upper bounds, queries x vectors; ``best`` holds the greatest lower bounds of each query, unordered."""
        queries = np.frombuffer(q_data, "<i4").reshape(len(q_keys) // 8, dims)
        cells = self.cells[dims]
        lower, upper = cells.bounds(cells.unpack(data, n), queries)
        seen = self.best.get(q_keys)
        both = lower if seen is None else np.hstack([seen, lower])
        if both.shape[1] < self.want:
            both = np.hstack([both, np.full((len(both), self.want - both.shape[1]), -np.inf)])
        self.best[q_keys] = -np.partition(-both, self.want - 1, axis=1)[:, : self.want]
        return upper


def _pairs(blocks: DataFrame, asked: DataFrame, pairs: int) -> DataFrame:
    """Blocks of cells beside blocks of queries. No row of either side meets another alone, and neither is
    shuffled: Spark reads the files of one side once for each part of the other (or broadcasts a small one)."""
    tasks = min(MOST_TASKS, max(1, math.ceil(pairs / TASK_PAIRS)))
    return blocks.repartition(tasks).crossJoin(asked.select(F.col("dims").alias("q_dims"), F.col("keys").alias("q_keys"), F.col("data").alias("q_data"), *[c for c in asked.columns if c == "floors"]))


def _floors(blocks: DataFrame, asked: DataFrame, cells: dict[int, Cells], want: int, pairs: int) -> DataFrame:
    """q_key, floor: a score that ``want`` different vectors of the leading blocks surely reach."""

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(cells, want)
        for batch in batches:
            for r in batch.to_pylist():
                if r["dims"] == r["q_dims"]:
                    scan.pair(r["q_keys"], r["q_data"], r["dims"], r["n"], r["data"])
        for keys, best in scan.best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<i8")), pa.array(list(best), pa.list_(pa.float64()))], names=["q_key", "best"])

    best = _pairs(blocks.filter("leads"), asked, pairs).mapInArrow(led, "q_key long, best array<double>")
    return best.groupBy("q_key").agg(F.get(F.sort_array(F.flatten(F.collect_list("best")), asc=False), want - 1).alias("floor"))


def _survivors(blocks: DataFrame, asked: DataFrame, cells: dict[int, Cells], want: int, pairs: int) -> DataFrame:
    """q_key, key, upper: pairs that bounds alone cannot rule out."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(cells, want)
        for batch in batches:
            for r in batch.to_pylist():
                if r["dims"] != r["q_dims"]:
                    continue
                upper = scan.pair(r["q_keys"], r["q_data"], r["dims"], r["n"], r["data"])
                floor = np.maximum(np.frombuffer(r["floors"], "<f8"), scan.best[r["q_keys"]].min(axis=1))
                i, j = np.nonzero(upper >= floor[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["q_keys"], "<i8")[i]), pa.array(np.frombuffer(r["keys"], "<i8")[j]), pa.array(upper[i, j])], names=["q_key", "key", "upper"])

    return _pairs(blocks, asked, pairs).mapInArrow(scanned, "q_key long, key long, upper double")


def inner_products(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact inner products of packed vectors of one length."""
    return pd.Series([int(np.frombuffer(x, "<i4").astype(np.int64) @ np.frombuffer(y, "<i4").astype(np.int64)) for x, y in zip(a, b, strict=True)], dtype="int64")


def search(df: DataFrame, is_query: str, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, ``id_col``, score: the ``k`` greatest inner products of each query with other vectors.

    Components are multiplied by 256 and cut to whole numbers. Queries are the rows where the SQL condition
    ``is_query`` on ``id_col`` holds, candidates all rows but those of the query's own id; ties go to smaller
    ids. Null ids and vectors that are null or hold a null or non-finite component take no part; a component
    of 2^18 or more is an error. Vectors meet those of their own length (empty ones score 0). Rows that repeat
    id and vector count once. Other columns are ignored.

    Results are exact: a vector is left out only where its upper bound lies below a score that k + 1 different
    vectors reach. Thresholds come from leading blocks first, so a query keeps a number of vectors that does
    not grow with the table. Of those the best bounds are read first; their exact scores say which others
    can still matter, and these are read too. Equal vectors are scanned once.
    """
    want = k + 1
    vectors = stored(whole_vectors(df, id_col, vector_col))
    distinct = distinct_vectors(vectors, k)
    cells = cells_of(distinct)
    queries = vectors.filter(F.expr(is_query.replace(id_col, "id")))
    askers = stored(queries.select("v").distinct().select(F.monotonically_increasing_id().alias("key"), "v"))
    pairs = distinct.count() * askers.count()
    blocks = stored(_blocks(distinct, BLOCK, lambda dims, x: cells[dims].pack(cells[dims].codes(x))))
    asked = stored(_blocks(askers, QUERIES, lambda dims, x: x.tobytes()))
    floors = _floors(blocks, asked, cells, want, math.ceil(pairs / LEADS))
    asked = stored(_with_floors(asked, floors))
    left = stored(_survivors(blocks, asked, cells, want, pairs))

    inner_product = F.pandas_udf(inner_products, "long")
    exact, q_exact = distinct.select("key", "v", "ids"), askers.select(F.col("key").alias("q_key"), F.col("v").alias("q_v"))
    scored = lambda rows: rows.join(q_exact, "q_key").join(exact, "key").select("q_key", "ids", inner_product("q_v", "v").alias("score"))
    best_bounds = Window.partitionBy("q_key").orderBy(F.desc("upper"), "key")
    first = stored(scored(left.withColumn("n", F.row_number().over(best_bounds)).filter(F.col("n") <= FIRST * want).drop("n")))
    best_scores = Window.partitionBy("q_key").orderBy(F.desc("score"))
    cut = first.withColumn("n", F.row_number().over(best_scores)).filter(F.col("n") == want).select("q_key", F.col("score").alias("cut"))
    last = left.withColumn("n", F.row_number().over(best_bounds)).filter(F.col("n") > FIRST * want).join(cut, "q_key").filter(F.col("upper") >= F.col("cut"))
    found = first.unionByName(scored(last.select("q_key", "key", "upper"))).select("q_key", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), "id")
    tops = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= want)
    lists = tops.groupBy("q_key").agg(F.array_sort(F.collect_list(F.struct("n", "score", "id"))).alias("top"))
    lists = lists.join(askers.select(F.col("key").alias("q_key"), "v"), "q_key").select("v", "top")
    own = queries.distinct().join(lists, "v").select(F.col("id").alias("query_id"), F.slice(F.filter("top", lambda x: x["id"] != F.col("id")), 1, k).alias("top"))
    ranked = own.select("query_id", F.posexplode("top").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), "hit.score")


def _with_floors(asked: DataFrame, floors: DataFrame) -> DataFrame:
    """Blocks of queries with the floors of their queries (64-bit floats, no floor: minus infinity)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.frombuffer(r["keys"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([r["keys"]] * len(keys)), pa.array(np.arange(len(keys)))], names=["q_key", "keys", "at"])

    none = F.lit(float("-inf"))
    places = asked.select("keys").mapInArrow(keyed, "q_key long, keys binary, at long").withColumn("block", F.xxhash64("keys")).drop("keys")
    in_order = F.array_sort(F.collect_list(F.struct("at", F.coalesce("floor", none).alias("floor"))))
    lists = places.join(floors, "q_key", "left").groupBy("block").agg(F.transform(in_order, lambda x: x["floor"]).alias("floors"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(x, "<f8").tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lists, pa.binary())], names=["dims", "keys", "data", "floors"])

    joined = asked.withColumn("block", F.xxhash64("keys")).join(lists, "block")
    return joined.select("dims", "keys", "data", "floors").mapInArrow(packed, "dims long, keys binary, data binary, floors binary")


def search_sql(modulus: int = 50, k: int = 5) -> str:
    """The same in DuckDB for ``embeddings``, with every ``modulus``-th id as a query."""
    return f"""
WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT DISTINCT vec_id, list_transform(e, lambda x: floor({SCALE} * x)) AS e FROM n WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % {modulus} = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}
"""
