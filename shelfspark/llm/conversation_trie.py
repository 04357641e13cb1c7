"""Conversation prefix trie: which first turns conversations share, and what storing them once saves.

A count-min sketch of prefix digests screens first: an estimate of one proves that a prefix belongs to a
single conversation, so its node and all below it are written where they are read. Only the other prefixes
are shuffled and grouped exactly, and their estimates say over how many salts a hot one is dealt.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import stored

#: Hash rows of the sketch and bounds of the counters in each; 16 MiB at most. Counters sent as one value.
HASHES, WIDTHS, CHUNK = 4, (1 << 10, 1 << 20), 1 << 16
#: Rows of one prefix that meet its group under one salt.
SALT_ROWS = 4096
#: Conversation ids joined to one value before they go to the task that hashes their node's ids.
BLOCK_IDS = 1 << 16
#: Conversations in a block that shares its first one's turns, and turns that may be taken from that one.
BLOCK, TAKEN = 100, 6


def taken(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its block."""
    return F.crc32(conv_id.cast("string").cast("binary")) % TAKEN


def rebuilt_prefixes(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """c, depth, d1, d2, chars, len: every prefix of every rebuilt conversation, in order within a task.

    d1 and d2 are 128 bits for the turns up to ``depth``, chars counts code points of the last text and len
    all turns. Depth 0 stands for the conversation itself. Turns are ordered by number (nulls first), role and
    text. Positions and digests come from windows that stream and spill, not from one value per conversation.
    """
    rows = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(a) for n, a in ((role_col, "role"), (text_col, "text"))])
    numbered = rows.withColumn("pos", F.row_number().over(Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    own = stored(numbered.select("c", "pos", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("second half"), "role", "text").alias("t2"), F.length("text").cast("long").alias("chars")))
    turn = ["pos", "t1", "t2", "chars"]
    heads = own.filter(F.col("pos") == 1).select("c", (F.col("c") - F.col("c") % BLOCK).alias("b"), taken(F.col("c")).alias("h"))
    shared = own.filter((F.col("c") % BLOCK == 0) & (F.col("pos") < TAKEN)).withColumnRenamed("c", "b")
    first = heads.join(shared, "b").filter("pos <= h").select("c", F.lit(1).alias("part"), *turn)
    rest = own.filter(F.col("pos") > taken(F.col("c"))).select("c", F.lit(2).alias("part"), *turn)
    zero = F.lit(0).cast("long")
    whole = heads.select("c", F.lit(0).alias("part"), F.lit(0).alias("pos"), zero.alias("t1"), zero.alias("t2"), zero.alias("chars"))
    so_far = Window.partitionBy("c").orderBy("part", "pos")
    depth = whole.unionByName(first).unionByName(rest).withColumn("depth", F.row_number().over(so_far).cast("long") - 1)
    digest = lambda t: F.bit_xor(F.when(F.col("depth") > 0, F.xxhash64("depth", t)).otherwise(zero)).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    return depth.select("c", "depth", digest("t1").alias("d1"), digest("t2").alias("d2"), "chars", F.max("depth").over(Window.partitionBy("c")).alias("len"))


def cells(d1: np.ndarray, d2: np.ndarray, width: int) -> np.ndarray:
    """The counters of digests: one of ``width`` (a power of two) in each hash row."""
    a, b = d1.view(np.uint64), d2.view(np.uint64) | np.uint64(1)
    shift = np.uint64(64 - (width.bit_length() - 1))
    return np.stack([((a + np.uint64(i) * b) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64) for i in range(HASHES)])


def sketch(digests: DataFrame, width: int) -> np.ndarray:
    """Count-min counters (hash rows x width) of the columns d1, d2, summed task by task and chunk by chunk."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((HASHES, width), np.uint32)
        for batch in batches:
            for row, at in zip(counts, cells(*[c.to_numpy(zero_copy_only=False) for c in batch.columns], width), strict=True):
                np.add.at(row, at, np.uint32(1))
        flat = counts.ravel()
        for k in range(0, len(flat), CHUNK):
            if flat[k : k + CHUNK].any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // CHUNK], pa.int32()), "counts": pa.array([zlib.compress(flat[k : k + CHUNK].tobytes(), 1)], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                counts = np.frombuffer(zlib.decompress(blob), np.uint32)
                sums[k] = sums[k] + counts if k in sums else counts
        for k, counts in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    kind = "chunk int, counts binary"
    parts = digests.select("d1", "d2").mapInArrow(counted, kind).repartition("chunk").mapInArrow(added, kind)
    flat = np.zeros(HASHES * width, np.uint32)
    for r in parts.collect():  # 16 MiB at most, whatever the input
        counts = np.frombuffer(r.counts, np.uint32)
        flat[r.chunk * CHUNK : r.chunk * CHUNK + len(counts)] = counts
    return flat.reshape(HASHES, width)


def _screened(prefixes: DataFrame, counters: Broadcast, width: int) -> DataFrame:
    """The prefixes below the root with est and kind: 0 is possibly shared, 1 surely alone with a known parent,
    2 surely alone below a possibly shared one.

    A prefix is alone if its own estimate or that of a shorter prefix of the same conversation is one. Only
    rows that a task reads one after the other count for that: where a file is cut inside a conversation, the
    first row after the cut stays possibly shared.
    """

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counters.value
        last_c, last_depth, last_alone = None, -1, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            c, depth, d1, d2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            est = np.min([row[at] for row, at in zip(counts, cells(d1, d2, width), strict=True)], axis=0).astype(np.int64)
            follows = np.empty(n, bool)
            follows[0] = last_c == c[0] and last_depth == depth[0] - 1
            follows[1:] = (c[1:] == c[:-1]) & (depth[1:] == depth[:-1] + 1)
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(follows, -1, at))  # -1: goes on from the batch before
            proof = np.maximum.accumulate(np.where((est == 1) & (depth > 0) & (follows | (depth == 1)), at, -1))
            alone = (proof >= np.maximum(start, 0)) | ((start < 0) & last_alone)
            before = np.concatenate([[last_alone], alone[:-1]]) & follows
            kind = np.where(~alone, 0, np.where((depth == 1) | before, 1, 2))
            last_c, last_depth, last_alone = c[-1], depth[-1], bool(alone[-1])
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(est), pa.array(kind.astype(np.int32))], names=[*batch.schema.names, "est", "kind"])
            yield out.filter(pa.array(depth > 0))

    columns = ["c", "depth", "d1", "d2", "chars", "len"]
    return prefixes.select(*columns).mapInArrow(screened, ", ".join(f"{n} long" for n in columns) + ", est long, kind int")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(key, first row, row after the last) of each run of equal d1, d2."""
    d1, d2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
    cuts = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
    bounds = [0, *cuts.tolist(), len(d1)] if len(d1) else [0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield (int(d1[a]), int(d2[a])), a, b


def id_digests(ends: DataFrame) -> DataFrame:
    """d1, d2, ends_sha256 of rows d1, d2, c: the hash of each key's ids, ascending and joined by commas.

    Ids are sorted by range and joined in blocks, so a key with very many ids reaches the task that hashes it
    as few rows, which are hashed one after the other as they come.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        block = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, int(ids[0]))] + [pa.array([",".join(map(str, ids))])], names=["d1", "d2", "first", "ids"])
        for batch in batches:
            c = batch.column(2).to_pylist()
            for k, a, b in _runs(batch):
                if ids and (k != key or len(ids) >= BLOCK_IDS):
                    yield block()
                    ids = []
                key, ids = k, ids + c[a:b]
        if ids:
            yield block()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=["d1", "d2", "ends_sha256"])
        for batch in batches:
            for k, ids in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(3).to_pylist(), strict=True):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key:
                    yield row()
                key, digest = k, hashlib.sha256(ids.encode())
        if key:
            yield row()

    joined = ends.select("d1", "d2", "c").repartitionByRange("d1", "d2", "c").sortWithinPartitions("d1", "d2", "c").mapInArrow(blocks, "d1 long, d2 long, first long, ids string")
    return joined.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(hashed, "d1 long, d2 long, ends_sha256 string")


def trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations (the root has none).

    Columns: conv_id (smallest conversation that starts so), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens (over the subtree: conversations less one, times code points of
    the node's last text) and ends_sha256 (of the ids of the conversations that end here). Rows with a null
    conversation id are left out; null roles and texts are empty; repeated turns follow each other. No
    conversations: no rows. Other columns are ignored.

    A conversation adds to every node on its path: as smallest member of nodes it brings their savings, as
    smallest member of a leaf that leaf. So all sums over subtrees are one sum over rows by digest.
    """
    prefixes = stored(rebuilt_prefixes(turns, id_col, turn_col, role_col, text_col))
    n, first = prefixes.agg(F.count(F.lit(1)), F.min("c")).first()
    width = min(max(1 << (4 * n).bit_length(), WIDTHS[0]), WIDTHS[1])
    counters = turns.sparkSession.sparkContext.broadcast(sketch(prefixes.filter("depth > 0"), width))
    screened = stored(_screened(prefixes, counters, width))
    counters.destroy()

    c, zero, one = F.col("c"), F.lit(0).cast("long"), F.lit(1).cast("long")
    maybe = screened.filter("kind = 0").withColumn("salts", F.ceil(F.col("est") / SALT_ROWS))
    groups = maybe.groupBy("d1", "d2").agg(F.count(c).alias("n"), F.min(c).alias("rep"), F.count_if(F.col("depth") == F.col("len")).alias("ends"), F.max("salts").alias("salts"))
    dealt = groups.withColumn("salt", F.explode(F.sequence(zero, F.col("salts") - 1))).drop("salts")
    rows = maybe.withColumn("salt", F.pmod(F.xxhash64("c"), F.col("salts"))).join(dealt, ["d1", "d2", "salt"])
    columns = ["c", "depth", "d1", "d2", "chars", "len", "kind"]
    heads = screened.filter("kind = 2").select(*columns, one.alias("n"), c.alias("rep"), (F.col("depth") == F.col("len")).cast("long").alias("ends"))
    path = Window.partitionBy("c").orderBy("depth")
    all_path, below = path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), path.rowsBetween(0, Window.unboundedFollowing)
    own_leaf = (F.col("depth") < F.col("len")) | ((F.col("ends") == F.col("n")) & (F.col("rep") == c))
    walked = rows.select(*columns, "n", "rep", "ends").unionByName(heads).select(
        *columns, "n", "rep", "ends",
        F.when(F.col("depth") == 1, first).when(F.lag("depth").over(path) == F.col("depth") - 1, F.lag("rep").over(path)).otherwise(c).alias("parent"),
        ((F.col("depth") < F.col("len")) & F.coalesce(F.lead("rep").over(path) == c, F.lit(True))).cast("long").alias("child"),
        F.last(own_leaf.cast("long")).over(all_path).alias("leaf"),
        F.sum(F.when(F.col("rep") == c, (F.col("n") - 1) * F.col("chars")).otherwise(zero)).over(below).alias("saved"),
    )
    walked = stored(walked)

    empty, own_id = F.sha2(F.lit("").cast("binary"), 256), lambda x: F.sha2(x.cast("string").cast("binary"), 256)
    ends_here = F.col("depth") == F.col("len")
    out = lambda df, *values: df.select(*[v.alias(name) for name, v in zip(("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), values, strict=True)])
    alone = lambda df, parent: out(df, c, F.col("depth"), parent, one, (F.col("depth") < F.col("len")).cast("long"), one, zero, F.when(ends_here, own_id(c)).otherwise(empty))
    tails = alone(screened.filter("kind = 1"), F.when(F.col("depth") == 1, first).otherwise(c))
    tails = tails.unionByName(alone(walked.filter("kind = 2"), F.col("parent")))

    summed = walked.filter("kind = 0").groupBy("d1", "d2").agg(
        F.min(c).alias("conv_id"), F.max("depth").alias("depth"), F.max(F.when(F.col("rep") == c, F.col("parent"))).alias("parent"), F.max("n").alias("n"), F.sum("child").alias("children"),
        F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.max(F.when(ends_here, c)).alias("end"),
    )
    turnless = prefixes.filter("len = 0").select("d1", "d2", "c")
    digests = id_digests(stored(walked.filter(ends_here & (F.col("kind") == 0) & (F.col("ends") > 1)).select("d1", "d2", "c").unionByName(turnless)))
    root_key = (F.col("d1") == 0) & (F.col("d2") == 0)
    named = summed.join(digests, ["d1", "d2"], "left")
    ends = F.coalesce("ends_sha256", F.when(F.col("end").isNotNull(), own_id(F.col("end"))), empty)
    shared = out(named, F.col("conv_id"), F.col("depth"), F.col("parent"), F.col("n"), F.col("children"), F.col("leaves"), F.col("saved"), ends)

    nodes = stored(tails.unionByName(shared))
    top = nodes.filter("depth = 1").agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    top = top.join(prefixes.filter("depth = 0").agg(F.count(c).alias("n"), F.min(c).alias("conv_id")).withColumn("one", F.lit(1)), F.col("one") == 1)  # one row each
    top = top.join(digests.filter(root_key).select("ends_sha256", F.lit(1).alias("same")), F.col("one") == F.col("same"), "left").filter("n > 0")
    none = F.lit(None).cast("long")
    root = out(top, F.col("conv_id"), zero, none, F.col("n"), F.col("children"), F.coalesce("leaves", one), F.coalesce("saved", zero), F.coalesce("ends_sha256", empty))
    return nodes.unionByName(root)


#: The same in DuckDB, for ``conversations``.
SQL = """
WITH l AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT c, turns, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
        lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END)), CAST(4294967295 AS BIGINT)) % 6 AS INT) AS h FROM l),
r AS (SELECT k.c, list_concat(coalesce(b.turns[1:h], []), k.turns[h + 1:]) AS s FROM k LEFT JOIN l b ON b.c = k.c - k.c % 100),
p AS (SELECT c, s[1:d] AS s, d, d = n AS ends FROM (SELECT c, s, len(s) AS n, unnest(range(len(s) + 1)) AS d FROM r)),
g AS (SELECT s, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM p GROUP BY s, d),
e AS (SELECT s, d, conv_id, n, ids, (SELECT count(*) FROM g x WHERE x.d = g.d + 1 AND x.s[1:g.d] = g.s) AS children, CASE WHEN d > 0 THEN (n - 1) * length(s[d].t) ELSE 0 END AS saved FROM g),
u AS (SELECT s[1:k] AS s, k AS d, sum(CAST(children = 0 AS INT)) AS leaves, sum(saved) AS saved FROM (SELECT s, saved, children, unnest(range(d + 1)) AS k FROM e) GROUP BY s[1:k], k)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, CAST(e.n AS BIGINT) AS n_convs, CAST(e.children AS BIGINT) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(e.ids) AS ends_sha256
FROM e JOIN u ON u.s = e.s AND u.d = e.d LEFT JOIN g a ON a.d = e.d - 1 AND a.s = e.s[1:e.d - 1] AND e.d > 0
"""
