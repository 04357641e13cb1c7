"""Token-id shards: raw id payloads with a minimal perfect hash index over document keys.

A shard file is: header, hash levels (sizes and bits), one fingerprint, offset and length per slot, the
keys in ascending order, then the raw ids of its documents in that order, and one closing newline.
A key's slot comes from the levels in constant time; the stored fingerprint tells a foreign key apart.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import slices, stored
from shelfspark.llm.word_ids import id_bytes, word_ids

MAGIC = b"IDSHARD1"
_HEADER = struct.Struct("<8sIIQQ")  # magic, id width, levels, documents, ids
#: Bits of a hash level for each key that is left: more bits, fewer levels.
GAMMA = 2


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, null: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """64-bit hashes of keys: the id, whether it is null, and how many equal ids came before."""
    extra = seen.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64)
    return mix(mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ mix(extra + np.uint64(0xD1B54A32D192ED03)))


def _level(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix(hashes + step) % np.uint64(size)).astype(np.int64)


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash by levels of bits: at each level the keys that are alone keep their bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        self.rank = np.cumsum(flat) - 1
        self.first = np.cumsum([0, *[len(x) for x in levels]])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys of a shard have one 64-bit hash")
        left, levels = hashes, []
        while len(left):
            size = max(64, GAMMA * len(left))
            at = _level(left, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """A slot for each hash; -1 if no level has it (surely a foreign key)."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = _level(hashes[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.rank[self.first[k] + at[hit]]
            left = left[~hit]
        return out


@dataclass
class Shard:
    """An opened shard file."""

    ids: np.ndarray
    null: np.ndarray
    seen: np.ndarray
    index: PerfectHash
    marks: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    payload: np.ndarray

    @classmethod
    def open(cls, blob: bytes) -> Shard:
        magic, width, n_levels, n, n_ids = _HEADER.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        at = _HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        sizes = take("<u8", n_levels)
        levels = [np.unpackbits(take("u1", -(-int(s) // 8)), count=int(s)).astype(bool) for s in sizes]
        marks, offsets, lengths = take("<u4", n), take("<u8", n), take("<u4", n)
        ids, seen, null = take("<i8", n), take("<u4", n), take("u1", n)
        return cls(ids, null, seen, PerfectHash(levels), marks, offsets, lengths, take(f"<u{width}", n_ids))

    def find(self, ids: np.ndarray, null: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where the shard does not hold the key."""
        hashes = key_hash(ids, null, seen)
        slots = self.index.slots(hashes)
        known = slots >= 0
        known[known] = self.marks[slots[known]] == fingerprints(hashes[known])
        return np.where(known, slots, -1)


def build_shard(ids: np.ndarray, null: np.ndarray, documents: list[bytes], width: int) -> bytes:
    """A shard file's bytes, of documents in ascending order of their keys."""
    n = len(documents)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    seen = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    hashes = key_hash(ids, null, seen)
    index = PerfectHash.build(hashes)
    lengths = np.array([len(d) // 4 for d in documents], np.int64)
    offsets = np.cumsum(lengths) - lengths
    slots = index.slots(hashes)
    marks, at, size = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u4")
    marks[slots], at[slots], size[slots] = fingerprints(hashes), offsets, lengths
    payload = np.frombuffer(b"".join(documents), "<u4").astype(f"<u{width}")
    parts = [_HEADER.pack(MAGIC, width, len(index.levels), n, len(payload)), np.array([len(x) for x in index.levels], "<u8").tobytes()]
    parts += [np.packbits(x).tobytes() for x in index.levels]
    parts += [marks.tobytes(), at.tobytes(), size.tobytes(), ids.astype("<i8").tobytes(), seen.astype("<u4").tobytes(), null.astype("u1").tobytes(), payload.tobytes()]
    return b"".join(parts)


def write_shards(df: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20) -> None:
    """Encode every row's whole text (null: empty), add ``end_id``, and write shard files under ``out``.

    Files hold contiguous ranges of ``id_col`` (integers; null first) in ascending order; equal ids follow
    each other in order of text and get occurrence numbers as part of their key. ``shard_bytes`` of text
    make a shard, so that a task's memory does not grow with the table. Spark's text writer puts each
    shard's bytes into one file, wherever ``out`` lies; an empty table writes no shard.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    end = id_bytes(end_id)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids, null, documents = word_ids(path), [], [], []
        for batch in slices(batches):
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            null.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            documents += model.encode(batch.column(1).to_pylist(), end)
        if documents:
            blob = build_shard(np.concatenate(ids), np.concatenate(null), documents, model.width)
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["value"])

    ranges = rows.repartitionByRange(max(1, -(-total // shard_bytes)), "id").sortWithinPartitions("id", "text")
    ranges.mapInArrow(shard, "value binary").select(F.col("value").cast("string")).write.text(out)


def _contents(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.format("binaryFile").load(out).filter(F.col("length") > 0)


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """One row per document in the shard files under ``out``, each found through its shard's index.

    doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers). Each shard is read by one task; shard totals are summed over one row a shard.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            shard = Shard.open(batch.column(0)[0].as_py())
            slots = shard.find(shard.ids, shard.null, shard.seen)
            if (slots < 0).any():
                raise ValueError("a shard's index does not find one of its keys")
            at, size = shard.offsets[slots].astype(np.int64), shard.lengths[slots].astype(np.int64)
            words = memoryview(shard.payload.astype("<u4").tobytes())
            crc = np.array([zlib.crc32(words[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)], np.int64)
            null, n = shard.null.astype(bool), len(slots)
            first = pa.array([None if null[0] else int(shard.ids[0])] * n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shard.ids, pa.int64(), mask=null), first, pa.array(at), pa.array(size), pa.array(crc)], names=["doc_id", "first_id", "at", "n_tokens", "ids_crc32"])

    rows = stored(_contents(spark, out).select("content").mapInArrow(opened, "doc_id bigint, first_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"))
    totals = rows.groupBy("first_id").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("first_id").alias("shard"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    joined = rows.join(starts, F.col("first_id").eqNullSafe(F.col("shard")))
    return joined.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """path and first_id of every shard under ``out``, from a small table beside the shards.

    It is made by the first call, which opens every shard; later calls read the table alone.
    """
    path = f"{out.rstrip('/')}-manifest"
    schema = "path string, first_id bigint"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            shard = Shard.open(batch.column(1)[0].as_py())
            held = shard.ids[shard.null == 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(held[0]) if len(held) else None], pa.int64())], names=["path", "first_id"])

    _contents(spark, out).select("path", "content").mapInArrow(heads, schema).filter("first_id is not null").write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def lookup(spark: SparkSession, out: str, keys: DataFrame, id_col: str = "doc_id", max_shards: int = 1_000_000) -> DataFrame:
    """ids (array of long) of the documents that ``keys`` names; keys that no shard holds give no row.

    First occurrences of repeated ids are returned. The ``manifest`` says which one shard's range holds a key; only
    these files are opened, and the index of each gives a key's place in constant time. Shard starts are held by the
    driver (more than ``max_shards`` of them is an error: write larger shards).
    """
    found = manifest(spark, out).orderBy("first_id").limit(max_shards + 1).collect()
    if len(found) > max_shards:
        raise ValueError(f"more than {max_shards} shards")
    firsts, paths = np.array([r.first_id for r in found], np.int64), [r.path for r in found]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(firsts, batch.column(0).to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([paths[k] if k >= 0 else None for k in at], pa.string())], names=["id", "path"])

    def fetched(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").to_numpy()
        if not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64()))})
        shard = Shard.open(right.column("content")[0].as_py())
        slots = shard.find(ids, np.zeros(len(ids), bool), np.zeros(len(ids), np.int64))
        hit = slots >= 0
        at, size = shard.offsets[slots[hit]].astype(np.int64), shard.lengths[slots[hit]].astype(np.int64)
        return pa.table({"id": pa.array(ids[hit]), "ids": pa.array([shard.payload[a : a + n].astype(np.int64) for a, n in zip(at, size, strict=True)], pa.list_(pa.int64()))})

    wanted = keys.select(F.col(id_col).cast("bigint").alias("id")).filter("id is not null").distinct()
    if not paths:
        return wanted.select(F.col("id").alias(id_col), F.array().cast("array<bigint>").alias("ids")).limit(0)
    routes = stored(wanted.mapInArrow(routed, "id bigint, path string").filter("path is not null"))
    opened = [r.path for r in routes.select("path").distinct().collect()]  # max_shards at most
    if not opened:
        return wanted.select(F.col("id").alias(id_col), F.array().cast("array<bigint>").alias("ids")).limit(0)
    contents = spark.read.format("binaryFile").load(opened).select("path", "content")
    got = routes.groupBy("path").cogroup(contents.groupBy("path")).applyInArrow(fetched, "id bigint, ids array<bigint>")
    return got.withColumnRenamed("id", id_col)
