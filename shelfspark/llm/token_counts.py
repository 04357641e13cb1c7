"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import MEMO_ENTRIES, slices, space_segments


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    held = set(own)
    return [chr(b) if b in held else chr(next(rest)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts under a byte-level BPE file, by merging pairs until none is known."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pieces = regex.compile(pattern).findall
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        alphabet = byte_alphabet()
        symbol = {c: i for i, c in enumerate(alphabet)}
        self.byte_symbol = [symbol[c] for c in alphabet]
        # (left symbol, right symbol) -> (rank, symbol that replaces them)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            new = symbol.setdefault(left + right, len(symbol))
            self.merges[symbol[left], symbol[right]] = (rank, new)
        self.by_piece: dict[str, int] = {}
        self.by_segment = _Segments(self)

    def piece(self, piece: str) -> int:
        """Initial symbols less merges: the lowest-rank adjacent pair goes first, the leftmost of equals."""
        symbols = [self.byte_symbol[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        merges = self.merges
        heap = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        count = n
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one side has been merged since
            symbols[i], symbols[j] = new, -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, symbols[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, symbols[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbols[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], symbols[h], new))
        return count

    def run(self, text: str) -> int:
        """Tokens of a text by itself: special strings count one each, the rest by pieces."""
        total = 0
        for part in self.split_special(text) if self.split_special else (text,):
            if part in self.special:
                total += 1
                continue
            for piece in self.pieces(part):
                n = self.by_piece.get(piece)
                if n is None:
                    n = self.piece(piece)
                    if len(piece) <= 64:
                        self.by_piece[piece] = n
                total += n
        return total

    def count(self, text: str) -> int:
        segments = space_segments(text)
        if segments is None:
            return self.run(text)
        return self.run(segments[0]) + sum(map(self.by_segment.__getitem__, segments[1:]))

    def trim(self) -> None:
        if len(self.by_piece) > MEMO_ENTRIES:
            self.by_piece.clear()
        if len(self.by_segment) > MEMO_ENTRIES:
            self.by_segment.clear()


class _Segments(dict):
    """Counts of segments with the space before them, made when first asked for."""

    def __init__(self, counter: MergeCounter):
        self.counter = counter

    def __missing__(self, segment: str) -> int:
        n = self.counter.run(" " + segment)
        if len(segment) <= 64:
            self[segment] = n
        return n


@lru_cache(maxsize=2)
def _counter(path: str, pattern: str) -> MergeCounter:
    return MergeCounter(path, pattern)


def count_tokens(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_bytes (UTF-8) and n_tokens of the whole text.

    ``path`` names a byte-level BPE file that every executor can open, ``pattern`` its pre-split. Nulls
    count as empty texts (0 bytes, 0 tokens), repeated rows are counted each, other columns are ignored,
    and an empty table gives an empty result. There is no shuffle; each worker keeps a bounded memo of
    words it has merged.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch in slices(batches):
            texts = pc.fill_null(batch.column(1), "")
            counts = [counter.count(t) for t in texts.to_pylist()]
            counter.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(pc.cast(texts, pa.large_binary())).cast(pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
