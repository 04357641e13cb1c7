"""Ids of whole texts under a word-level BPE file of the tokenizers library, words encoded once."""

from __future__ import annotations

import os
import struct
from collections.abc import Sequence
from functools import lru_cache

from shelfspark.llm.common import MEMO_ENTRIES, plain_word, word_segments
from shelfspark.llm.token_counts import byte_alphabet


def packed_ids(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Encodes texts with a tokenizer that drops white space, so that words can be encoded by themselves."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        self.spell = dict(enumerate(byte_alphabet()))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [packed_ids(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _part_ids(self, parts: list[str]) -> list[bytes]:
        """Runs of letters go to the library's model at once; the rest through its normaliser and splits."""
        merge, spell = self.library.model.tokenize, self.spell
        plain = list(map(plain_word, parts))
        other = iter(self._ids([p for p, is_plain in zip(parts, plain, strict=True) if not is_plain]))
        spelt = (p if p.isascii() else p.encode().decode("latin-1").translate(spell) for p in parts)  # ASCII letters spell themselves
        return [packed_ids([t.id for t in merge(s)]) if is_plain else next(other) for s, is_plain in zip(spelt, plain, strict=True)]

    def encode(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """Ids of each text, then ``end``, as little-endian unsigned 32-bit integers."""
        cut = [word_segments(t, self.special) for t in texts]
        whole = iter(self._ids([t for t, s in zip(texts, cut, strict=True) if s is None]))
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        new = [w for w in set().union(*[s for s in cut if s]) if w not in self.memo]
        self.memo.update(zip(new, self._part_ids(new), strict=True))
        get = self.memo.__getitem__
        return [(next(whole) if s is None else b"".join(map(get, s))) + end for s in cut]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def id_bytes(value: int) -> bytes:
    return packed_ids([value])
