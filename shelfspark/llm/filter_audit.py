"""Filter interaction audit: what each order of five document filters keeps, removes and removes twice.

Four filters look at one text. The fifth fails copies of a smaller id: texts are range-partitioned by prefixes
that grow as far as the boundaries need, and each partition inserts its whole texts into a compressed trie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import slices, stored

#: Bytes of text that one trie holds, and up to which copies are gathered before the shuffle.
TRIE_BYTES, GATHER_BYTES, GATHER_ROWS = 32 << 20, 16 << 20, 50_000
#: Bytes of the first prefix of the range key; each of the longer ones stands as a digest.
PREFIXES = (32, 256, 4096)
FILTERS = "ABCDE"
_CAPITALS, _ODD, _FOLLOWING = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits 0 to 3: filters A to D that a text (UTF-8) fails. Words are what ASCII white space parts."""
    words = text.split()
    n = len(text)
    capitals = n - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _FOLLOWING))
    odd = len(text.translate(None, _ODD)) < n
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * points) << 2 | odd << 3


class Node:
    """A node of a compressed trie: the bytes that lead to it, its children by first byte, and what ends here."""

    __slots__ = ("children", "end", "label")

    def __init__(self, label: bytes):
        self.label, self.children, self.end = label, {}, None


class Trie:
    """Whole texts; a terminal holds the smallest id with its parts (one for each row) and the failures of the text."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def terminal(self, text: bytes) -> Node:
        node, at, n = self.root, 0, len(text)
        while at < n:
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                return child
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            low, high = 1, min(len(child.label), n - at)
            while low < high:  # the longest part of the label that the text goes along with
                mid = (low + high + 1) // 2
                low, high = (mid, high) if text.startswith(child.label[:mid], at) else (low, mid - 1)
            fork = Node(child.label[:low])
            child.label = child.label[low:]
            fork.children[child.label[0]] = child
            node.children[text[at]] = fork
            node, at = fork, at + low
        return node

    def insert(self, text: bytes, key: object, part: str, bits: int) -> list[tuple]:
        """Insert a row; returns the rows (id, part, bits) that are now known to repeat a smaller id's text."""
        node = self.terminal(text)
        if node.end is None or key < node.end[0]:
            beaten = [(node.end[0], p, node.end[2]) for p in node.end[1]] if node.end else []
            node.end = (key, [part], bits)
            return beaten
        if key == node.end[0]:
            node.end[1].append(part)
            return []
        return [(key, part, bits)]

    def firsts(self) -> Iterator[tuple]:
        """The rows (id, part, bits) whose texts no smaller id has."""
        left = [self.root]
        while left:
            node = left.pop()
            left.extend(node.children.values())
            if node.end:
                yield from ((node.end[0], part, node.end[2]) for part in node.end[1])


def _marked(docs: DataFrame, id_col: str, part_col: str, text_col: str) -> DataFrame:
    """id, part, bits, copy and text of each row: text only where copy is still open (null).

    Copies inside a batch of a task are told apart here, so that a text that fills a third of all rows
    travels once for each batch.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple]] = {}
        size = count = 0
        for batch in slices(batches):
            of = batch.column(0).type
            for key, part, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if text not in held:
                    held[text] = []
                    size += len(text)
                held[text].append((key, part))
                count += 1
            if size > GATHER_BYTES or count > GATHER_ROWS:
                yield from _gathered(held, of)
                held, size, count = {}, 0, 0
        if held:
            yield from _gathered(held, of)

    return rows.mapInArrow(marked, f"id {kind}, part string, bits int, copy boolean, text binary")


def _gathered(held: dict[bytes, list[tuple]], of: pa.DataType) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for text, rows in held.items():
        bits, first = failures(text), min((k for k, _ in rows if k is not None), default=None)
        for key, part in rows:
            opened = key is not None and key == first
            out.append((key, part, bits, None if opened else key is not None, text if opened else None))
    types = (of, pa.string(), pa.int32(), pa.bool_(), pa.binary())
    for start in range(0, len(out), 1024):
        columns = zip(*out[start : start + 1024], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "part", "bits", "copy", "text"])


def masks(docs: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """id, part and mask (bits 0 to 4: filters A to E that the text fails) of each row.

    Null texts and parts are empty. A row without an id neither fails E nor makes others fail it; rows
    that repeat one id and text don't fail it through each other. Other columns are ignored.

    The range key is the first 32 bytes of a text and digests of its first 256, of its first 4096 and of all
    bytes: boundaries fall at the shortest prefix that parts the rows evenly, equal texts are never parted, and
    what shares a long prefix stays together. Partitions are cut by bytes of text, so a trie is bounded; a text
    with copies everywhere brings one row for each batch of the first pass.
    """
    marked = stored(_marked(docs, id_col, part_col, text_col))
    kind = marked.schema["id"].dataType.simpleString()
    opened = marked.filter("text is not null")
    size = opened.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    longer = [F.xxhash64(F.substring("text", 1, n)) for n in PREFIXES[1:]]
    dealt = opened.repartitionByRange(max(1, math.ceil(size / TRIE_BYTES)), F.substring("text", 1, PREFIXES[0]), *longer, F.xxhash64("text"))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, of = Trie(), None
        out = lambda rows, copy: pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], of), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] | copy << 4 for r in rows], pa.int32())], names=["id", "part", "mask"]
        )
        for batch in slices(batches):
            of = batch.column(0).type
            copies: list[tuple] = []
            for key, part, bits, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                copies += trie.insert(text, key, part, bits)
            yield out(copies, 1)
        if of is not None:
            firsts = list(trie.firsts())
            for start in range(0, len(firsts), 8192):
                yield out(firsts[start : start + 8192], 0)

    late = dealt.select("id", "part", "bits", "text").mapInArrow(decided, f"id {kind}, part string, mask int")
    early = marked.filter("text is null").select("id", "part", F.col("bits").bitwiseOR(F.col("copy").cast("int") * 16).alias("mask"))
    return stored(early.unionByName(late)).withColumnsRenamed({"id": id_col})


#: (order, step, bit of its filter, bits of the filters before it) for every order of the filters.
STEPS = [("".join(o), i + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in o[:i])) for o in permutations(FILTERS) for i, f in enumerate(o)]
ORDERS = math.factorial(len(FILTERS))
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _reduced(part: pd.DataFrame) -> pd.DataFrame:
    """All steps of all orders from the counts of at most 32 masks of one part."""
    rows = [tuple(map(int, r)) for r in part[["mask", "n", "good", "toxic"]].itertuples(index=False)]
    out = []
    for order, step, bit, before in STEPS:
        removed = [r for r in rows if r[0] & bit and not r[0] & before]
        out.append((
            part["part"].iloc[0], order, step, sum(r[1] for r in rows if not r[0] & (before | bit)), sum(r[1] for r in removed), sum(r[1] for r in rows if r[0] & bit and r[0] & before),
            sum(r[1] for r in rows if r[0] == bit), sum(r[2] for r in removed), sum(r[3] for r in removed), sum(r[1] * ORDERS // r[0].bit_count() for r in rows if r[0] & bit),
        ))
    return pd.DataFrame(out, columns=["part", "filter_order", "step", *_COUNTS])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """part, filter_order, step and counts: one row for each part, order of the five filters and step.

    kept: rows left after the step; removed: rows that it removes; redundant: rows that fail its filter but
    were removed before; unique_fails: rows that fail its filter only; good_lost, toxic_lost: removed rows
    labelled quality = 1, toxic = 1; shapley: what its filter removes, summed over all orders (of a row that
    fails m filters each is the first in 1/m of the orders). Of repeated labels one with 1 is enough; null
    labels and ids count as no label. No documents: no rows. See ``masks`` for nulls and repeated rows.

    Masks are counted before they are shuffled, so a part reaches its reduction as 32 rows at most.
    """
    rows = masks(docs, id_col, part_col, text_col).select(F.col(id_col).alias("id"), "part", "mask")
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max((F.col(c) == 1).cast("long")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    failed = rows.filter("mask <> 0 and id is not null").groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("k")).join(known, "id")
    zero = F.lit(0).cast("long")
    labelled = failed.groupBy("part", "mask").agg(*[F.coalesce(F.sum(F.col("k") * F.col(n)), zero).alias(n) for n in ("good", "toxic")])
    counted = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    both = counted.unionByName(labelled.withColumn("n", zero)).groupBy("part", "mask").agg(*[F.sum(n).alias(n) for n in ("n", "good", "toxic")])
    return both.groupBy("part").applyInPandas(_reduced, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in _COUNTS))


#: The same in DuckDB, for ``documents`` and ``labels``.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS again FROM d),
m AS (SELECT doc_id, part, CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT)
        + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(again AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
g AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(f, bit)),
o AS (SELECT [a, b, c, d, e] AS fs FROM (SELECT a.f AS a, b.f AS b, c.f AS c, d.f AS d, e.f AS e FROM f a, f b, f c, f d, f e
      WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f)),
s AS (SELECT array_to_string(fs, '') AS filter_order, i AS step, bit, (SELECT coalesce(sum(y.bit), 0) FROM f y WHERE list_contains(fs[1:i - 1], y.f)) AS before
      FROM (SELECT fs, unnest(range(1, 6)) AS i FROM o) JOIN f ON f.f = fs[i])
SELECT part, filter_order, CAST(step AS INT) AS step,
  CAST(coalesce(sum(n) FILTER (mask & CAST(before AS INT) = 0 AND mask & bit = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mask & CAST(before AS INT) = 0 AND mask & bit > 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & CAST(before AS INT) > 0 AND mask & bit > 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & CAST(before AS INT) = 0 AND mask & bit > 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (mask & CAST(before AS INT) = 0 AND mask & bit > 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit > 0), 0) AS BIGINT) AS shapley
FROM g CROSS JOIN s GROUP BY part, filter_order, step
"""
