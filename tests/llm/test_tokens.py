import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspark.llm import byte_bpe, common, packing, token_counts, token_shards
from shelfspark.llm.common import scratch
from shelfspark.llm.word_ids import WordIds

JSON, RANKS, WORDS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
PARTS = ["a", "aa", "Ab", " ", "  ", "\n", "=", "é", "漢", "1", "'s", "<|endoftext|>", "the ", ".", ",", "..", "_", "\x1c", "́", "ß", "Σ", "İ", "😀", "-", "—", "\x85", " "]
SCHEMA = "doc_id long, text string, ids string, value string, task int"


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) * rng.choice((1, 1, 2, 7)) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, long and repeated texts, a null and a repeated id, and columns with clashing names."""
    texts = [None, "", "x" * 3000, "word " * 9000, "same text here", "same text here", *random_texts(60, 5)]
    rows = [(i if i != 7 else None, t, "i", "v", 1) for i, t in enumerate(texts)] + [(4, "same text here", "i", "v", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_counts_equal_the_library():
    counter, library = token_counts.MergeCounter(JSON, P.PATTERN), Tokenizer.from_file(JSON)
    for text in random_texts(3000):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_count_tokens(spark, docs):
    library = Tokenizer.from_file(JSON)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, JSON, P.PATTERN).collect())
    assert got == sorted((i or -1, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in plain_texts(docs))
    assert token_counts.count_tokens(docs.limit(0), JSON, P.PATTERN).count() == 0


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, docs, tik):
    model = byte_bpe.ByteBPE(RANKS, P.PATTERN)
    for text in random_texts(2000, 2):
        ids = model.encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text) and model.decode(ids) == text.encode()
    ids = byte_bpe.encode(docs, RANKS, P.PATTERN, offsets=True)
    for r in ids.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert len(r.starts) == len(r.ids) // 4 and all(0 <= a <= b <= len(r.text or "") for a, b in zip(r.starts, r.ends, strict=True))
    back = byte_bpe.decode(ids, RANKS, P.PATTERN, keep=("ids",)).select("doc_id", F.sha2("decoded", 256).alias("h")).collect()
    assert sorted((r.doc_id or -1, r.h) for r in back) == sorted((i or -1, hashlib.sha256(t.encode()).hexdigest()) for i, t in plain_texts(docs))


def test_split_characters_wait(tik):
    stream = byte_bpe.CharacterStream(byte_bpe.ByteBPE(RANKS, P.PATTERN))
    ids = tik.encode_ordinary("漢字😀")
    assert "".join(stream.push(np.array([i], "<u4").tobytes()) for i in ids) + stream.push(b"", True) == "漢字😀"


def test_word_ids_equal_the_library():
    model = WordIds(WORDS)
    for text in random_texts(4000, 3):
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == model.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_bytes_decide_as_patterns_do():
    """Texts of one byte a character are judged by tables of bytes: the same for every character, alone and beside another."""
    every = [chr(c) for c in range(0x180)] + [chr(c) + d for c in range(0x180) for d in ".,_a \x85\xb5\u0131"]
    for text in every:
        assert common._touching(text) == (common._TOUCHING.search(text) is not None), text
        if common._NOT_LATIN.search(text):
            assert common.word_segments(text) == (None if common._ODD_CONTROL.search(text) else text.split()), text
        else:
            low = text.lower()
            assert common.word_segments(text) == (low if common._TOUCHING.search(low) else low.replace(".", " . ").replace(",", " , ")).split(), text
        assert common.plain_word(text) == (common._LETTERS.fullmatch(text) is not None and text.lower() == text), text


def test_special_tokens_are_looked_for_in_raw_text():
    model = WordIds(WORDS)
    for text in ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "x <|endoftext|> y <|ENDOFTEXT|> z", "a<|StartOfText|>b", "a <|endoftext|> B.", "A <|ENDOFTEXT|>. 漢"]:
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == model.library.encode(text, add_special_tokens=False).ids, repr(text)


def expected_ids(docs, end):
    library = Tokenizer.from_file(WORDS)
    return [(i, np.array([*library.encode(t, add_special_tokens=False).ids, end], "<u4")) for i, t in sorted(plain_texts(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]


def test_shards(spark, docs):
    out = scratch(spark)
    token_shards.write_shards(docs, out, WORDS, end_id=1, shard_bytes=20_000)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_shards.read_shards(spark, out).collect())
    start, want = 0, []
    for i, ids in expected_ids(docs, 1):
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [g[0] for g in got] == [w[0] for w in want] and sorted(g[1:] for g in got if g[1] is not None) == sorted(w[1:] for w in want if w[1] is not None)
    keys = spark.createDataFrame([(i,) for i in (0, 2, 20, 999, None)], "doc_id long")
    found = {r.doc_id: r.ids for r in token_shards.lookup(spark, out, keys).collect()}
    ids = dict(expected_ids(docs, 1))
    assert found == {i: ids[i].tolist() for i in (0, 2, 20)}


def test_one_key_opens_one_file(spark, docs, monkeypatch):
    """After the first lookup has written the manifest no file but the key's own is read."""
    out = scratch(spark)
    token_shards.write_shards(docs, out, WORDS, end_id=1, shard_bytes=20_000)
    one = spark.createDataFrame([(2,)], "doc_id long")
    first = token_shards.lookup(spark, out, one).collect()
    monkeypatch.setattr(token_shards, "_contents", None)  # what opens all shards
    again = token_shards.lookup(spark, out, one)
    assert again.collect() == first and len(first) == 1
    opened = [f for f in again.inputFiles() if f.startswith(out if ":" in out else f"file:{out}") or f"{out}/" in f]
    assert len(opened) == 1 and token_shards.manifest(spark, out).count() > 1
    assert token_shards.lookup(spark, out, spark.createDataFrame([(-7,)], "doc_id long")).count() == 0


def test_perfect_hash_is_minimal():
    hashes = token_shards.mix(np.arange(5000, dtype=np.uint64))
    index = token_shards.PerfectHash.build(hashes)
    assert sorted(index.slots(hashes)) == list(range(5000))
    with pytest.raises(ValueError):
        token_shards.PerfectHash.build(np.array([1, 1], np.uint64))


def test_no_shards_of_no_documents(spark, docs):
    out = scratch(spark)
    token_shards.write_shards(docs.limit(0), out, WORDS, end_id=1)
    assert token_shards.read_shards(spark, out).count() == 0


def test_best_fill_is_exhaustive():
    rng = random.Random(4)
    for _ in range(200):
        pool, lengths = packing.Pool(), [rng.randint(1, 20) for _ in range(rng.randint(0, 8))]
        for n in lengths:
            pool.add((0, 0, n, b"\0" * 4 * n))
        target, sums = rng.randint(1, 40), {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        picked = pool.best(target)
        assert sum(picked) == max(s for s in sums if s <= target) and all(picked.count(n) <= lengths.count(n) for n in picked)


def test_packing(spark, docs):
    rows = packing.pack(docs.filter("doc_id is not null and doc_id <> 4").repartition(3, "doc_id"), WORDS, end_id=2, capacity=256).collect()
    ids, documents, sequences = dict(expected_ids(docs, 2)), defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        documents[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in (*documents.values(), *sequences.values()):
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
    fills = [sum(n for _, n in s) for s in sequences.values()]
    assert max(fills) == 256 and sum(f < 256 for f in fills) == 1
    assert {d: sum(n for _, n in p) for d, p in documents.items()} == {i: len(x) for i, x in ids.items() if i is not None and i != 4}
    assert packing.pack(docs.limit(0), WORDS, end_id=2).count() == 0
