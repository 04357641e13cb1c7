"""Byte-level BPE over Arrow batches: the tokenizers library under ranks, with offsets, and the way back."""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from shelfspark.llm.common import MEMO_ENTRIES, slices, space_segments
from shelfspark.llm.token_counts import byte_alphabet


class ByteBPE:
    """A tokenizers model made from a ranks file: bytes become characters, ranks become merges.

    A pair may be merged whenever the joined bytes have a rank, so every split of a token into two known
    tokens becomes a merge, in the order of the token's rank; a piece that is a token stays whole.
    """

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.alphabet = byte_alphabet()
        # the way back: id -> characters of the vocabulary -> bytes
        back = {c: b for b, c in enumerate(self.alphabet)}
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = bytes(back[c] for c in self.spell(token))
        self.memo: dict[str, bytes] = {}

    def spell(self, token: bytes) -> str:
        return "".join([self.alphabet[b] for b in token])

    @cached_property
    def library(self) -> Tokenizer:
        """Made when first used: decoding does without it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
        ranks, merges = self.ranks, []
        for token in sorted(ranks, key=ranks.get):
            merges += [(self.spell(token[:i]), self.spell(token[i:])) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        made = Tokenizer(models.BPE(vocab={self.spell(token): rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True))
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(self.pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return made

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; words go to the library once."""
        cut = [space_segments(t) for t in texts]
        whole = [t for t, s in zip(texts, cut, strict=True) if s is None] + [s[0] for s in cut if s]
        encoded = iter(self._ids(whole))
        first = [next(encoded) if s is None else b"" for s in cut]
        heads = [next(encoded) if s else b"" for s in cut]
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        new = [s for s in set().union(*[s[1:] for s in cut if s]) if s not in self.memo]
        self.memo.update(zip(new, self._ids([" " + s for s in new]), strict=True))
        get = self.memo.__getitem__
        return [f if s is None else h + b"".join(map(get, s[1:])) for f, h, s in zip(first, heads, cut, strict=True)]

    def offsets(self, texts: list[str]) -> list[tuple[bytes, list[int], list[int]]]:
        """Ids with the first and the end character of each; ids that share a split character share its offsets."""
        out = []
        for e in self.library.encode_batch(texts, add_special_tokens=False):
            out.append((np.array(e.ids, "<u4").tobytes(), [a for a, _ in e.offsets], [b for _, b in e.offsets]))
        return out

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


class CharacterStream:
    """Text of ids that come a few at a time: bytes of a split character wait for the rest of it."""

    def __init__(self, model: ByteBPE):
        self.model, self.held = model, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: bytes, final: bool = False) -> str:
        return self.held.decode(self.model.decode(ids), final)


@lru_cache(maxsize=2)
def _model(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def _keyed(df: DataFrame, id_col: str, value: F.Column) -> tuple[DataFrame, str]:
    rows = df.select(F.col(id_col).alias("id"), value.alias("value"))
    return rows, rows.schema["id"].dataType.simpleString()


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``id_col`` and ids (binary, little-endian unsigned 32-bit) of each row's whole text.

    With ``offsets`` also starts and ends (character positions, arrays). Null texts are empty; every row
    of ``df`` gives one row, repeated rows too; other columns are ignored. No shuffle.
    """
    rows, kind = _keyed(df, id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, pattern)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            if offsets:
                ids, starts, ends = zip(*model.offsets(texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["id", "ids", "starts", "ends"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.encode(texts), pa.binary())], names=["id", "ids"])

    more = ", starts array<int>, ends array<int>" if offsets else ""
    return rows.mapInArrow(encoded, f"id {kind}, ids binary{more}").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col`` and decoded (binary) of ids as ``encode`` returns them; ``keep`` names columns to carry on.

    Bytes are exact even where an id ends inside a character; ``cast("string")`` gives the text of whole
    id lists. Null ids decode to no bytes; an id outside the vocabulary is an error.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("value"), *keep)
    kind = rows.schema["id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, pattern)
        for batch in slices(batches):
            out = pa.array([model.decode(x) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out, *batch.columns[2:]], names=["id", "decoded", *keep])

    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(decoded, f"id {kind}, decoded binary{kept}").withColumnRenamed("id", id_col)


def id_count(ids: F.Column) -> F.Column:
    return (F.octet_length(ids) / 4).cast("long")
