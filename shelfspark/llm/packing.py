"""Packing by minimum bin slack: a bitset subset-sum picks the lengths that fill each window best."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import slices, stored
from shelfspark.llm.word_ids import id_bytes, word_ids

#: Documents that a task packs together; what they leave over goes on to the next ones.
WINDOW_DOCS = 2048
#: Tasks whose left-over pieces are packed together.
TAIL_TASKS = 256
#: Bytes of ids in the rows that a task holds before it hands them on.
HELD_BYTES = 4 << 20
_SCHEMA = "doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, task bigint, ids binary"


class Pool:
    """Pieces by length. A piece is (document id, start, tokens of the document, its ids as bytes)."""

    def __init__(self) -> None:
        self.pieces: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []
        self.total = 0

    def add(self, piece: tuple) -> None:
        n = len(piece[3]) // 4
        if n not in self.pieces:
            self.pieces[n] = []
            insort(self.lengths, n)
        self.pieces[n].append(piece)
        self.total += n

    def take(self, n: int) -> tuple:
        piece = self.pieces[n].pop()
        if not self.pieces[n]:
            del self.pieces[n]
            self.lengths.remove(n)
        self.total -= n
        return piece

    def best(self, target: int) -> list[int]:
        """The multiset of lengths whose sum comes closest to ``target`` from below.

        Bit t of ``reach`` tells whether t can be summed. Counts enter as powers of two; walking the
        steps backwards gives how many of each length the best sum takes.
        """
        reach, mask, steps = 1, (1 << (target + 1)) - 1, []
        for n in reversed(self.lengths[: bisect_right(self.lengths, target)]):
            left, k = min(len(self.pieces[n]), target // n), 1
            while left:
                k = min(k, left)
                steps.append((n, k, reach))
                reach |= (reach << (n * k)) & mask
                left -= k
                k *= 2
            if reach >> target:
                break
        at, out = reach.bit_length() - 1, []
        for n, k, before in reversed(steps):
            if not before >> at & 1:
                out += [n] * k
                at -= n * k
        return out

    def sequence(self, capacity: int) -> list[tuple]:
        """The pieces of one sequence: the longest, what fills the rest best, and a cut for what is open."""
        out = [self.take(self.lengths[-1])]
        open_ = capacity - len(out[0][3]) // 4
        for n in self.best(open_) if open_ else ():
            out.append(self.take(n))
            open_ -= n
        if open_ and self.lengths:  # every length that is left is larger than what is open
            doc, start, tokens, ids = self.take(self.lengths[0])
            out.append((doc, start, tokens, ids[: 4 * open_]))
            self.add((doc, start + open_, tokens, ids[4 * open_ :]))
        return out


class Packer:
    """Turns pieces into rows; sequences are numbered from ``base``."""

    def __init__(self, capacity: int, base: int, task: int, keep_ids: bool):
        self.capacity, self.next, self.task, self.keep = capacity, base, task, keep_ids
        self.pool, self.rows, self.held = Pool(), [], 0

    def put(self, sequence: list[tuple]) -> None:
        at = 0
        for doc, start, tokens, ids in sequence:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next, at, self.task, ids if self.keep else None))
            at += len(ids) // 4
        self.held += 4 * at * self.keep
        self.next += 1

    def document(self, doc: object, ids: bytes) -> None:
        size, tokens = 4 * self.capacity, len(ids) // 4
        full = len(ids) // size * size
        for a in range(0, full, size):
            self.put([(doc, a // 4, tokens, ids[a : a + size])])
        if full < len(ids):
            self.pool.add((doc, full // 4, tokens, ids[full:]))

    def drain(self, least: int) -> None:
        while self.pool.total >= max(least, 1):
            self.put(self.pool.sequence(self.capacity))

    def leave(self) -> None:
        """What is left is less than a sequence: it goes out without a number, with its ids."""
        for pieces in self.pool.pieces.values():
            self.rows += [(doc, start, len(ids) // 4, zlib.crc32(ids), tokens, None, None, self.task, ids) for doc, start, tokens, ids in pieces]
        self.pool = Pool()

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        self.rows, self.held = [], 0
        return out


def _schema(doc: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", doc), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task")], ("ids", pa.binary())])


def pack(df: DataFrame, path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Whole texts (null: empty) are encoded, ``end_id`` is added, and documents are cut only at ``capacity``
    or where no set of whole pieces fills a sequence. Tasks pack what they read, without a shuffle; what a
    task leaves (less than one sequence) is packed again with that of ``TAIL_TASKS`` tasks, so one
    sequence of so many tasks stays short. Repeated rows are packed each, an empty table gives no rows,
    other columns are ignored. ``keep_ids`` adds each piece's ids (binary, unsigned 32-bit).
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind, end = rows.schema["doc_id"].dataType.simpleString(), id_bytes(end_id)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task, count, schema = word_ids(path), TaskContext.get().partitionId(), 0, None
        packer = Packer(capacity, task << 32, task, keep_ids)
        for batch in slices(batches):
            schema = schema or _schema(batch.column(0).type)
            for doc, ids in zip(batch.column(0).to_pylist(), model.encode(batch.column(1).to_pylist(), end), strict=True):
                packer.document(doc, ids)
            count += batch.num_rows
            if count >= WINDOW_DOCS:
                count = 0
                packer.drain(8 * capacity)
            if len(packer.rows) >= 4 * WINDOW_DOCS or packer.held >= HELD_BYTES:
                yield packer.batch(schema)
        if schema:
            packer.drain(capacity)
            packer.leave()
            yield packer.batch(schema)

    def again(tails: pa.Table) -> pa.Table:
        tails = tails.sort_by([("task", "ascending"), ("ids_crc32", "ascending"), ("start", "ascending")])
        group = tails.column("task")[0].as_py() // TAIL_TASKS
        packer = Packer(capacity, (1 << 62) + (group << 32), group, keep_ids)
        for x in tails.select(["doc_id", "start", "doc_tokens", "ids"]).to_pylist():
            packer.pool.add((x["doc_id"], x["start"], x["doc_tokens"], x["ids"]))
        packer.drain(1)
        return pa.Table.from_batches([packer.batch(_schema(tails.schema.field("doc_id").type))])

    first = stored(rows.mapInArrow(packed, _SCHEMA.format(kind=kind)))
    tails = first.filter(F.col("sequence_id").isNull()).withColumn("tail_group", F.floor(F.col("task") / TAIL_TASKS))
    rest = tails.groupBy("tail_group").applyInArrow(lambda t: again(t.drop(["tail_group"])), _SCHEMA.format(kind=kind))
    whole = first.filter(F.col("sequence_id").isNotNull()).unionByName(rest)
    wanted = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    return whole.select(F.col("doc_id").alias(id_col), *wanted)
