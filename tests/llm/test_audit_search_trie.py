"""Filter audit, vector search and conversation trie against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import conversation_trie, filter_audit, vector_search

# ---- filter audit


def brute_masks(rows):
    """(part, mask) of rows (id, text, part)."""
    out = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = [
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            re.search("[#$%&*|]", text) is not None,
            i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        ]
        out.append((part or "", sum(b << k for k, b in enumerate(fails))))
    return out


def brute_audit(rows, labels):
    masks = list(zip([r[0] for r in rows], *zip(*brute_masks(rows), strict=True), strict=True))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    removed, out = Counter(), {}
    for part in {m[1] for m in masks}:
        mine = [(i, m) for i, p, m in masks if p == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [i for i, m in left if m & bit]
                left = [x for x in left if not x[1] & bit]
                failing = sum(1 for _, m in mine if m & bit)
                removed[part, f] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(m == bit for _, m in mine), sum(i in good for i in gone), sum(i in toxic for i in gone))
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, mask string, part int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}


def test_audit_equals_brute_force(spark):
    pick = random.Random(5)
    words = lambda n: " ".join(pick.choice("alpha beta gamma delta Epsilon ZETA eta theta iota kappa".split()) + str(pick.randrange(300)) for _ in range(n))
    shared = words(900)
    texts = [words(pick.randrange(60, 160)) for _ in range(25)] + [shared + words(2) for _ in range(6)] + [shared, "", None, "ÀÉ é" * 20, "A\x0bB\x1cC D", "50% #1", "x" * 200_000]
    rows = [(i, pick.choice(texts), pick.choice(["en", "de", None, ""])) for i in range(120)]
    rows += [(7, rows[7][1], "en"), (7, "another text", "fr"), (None, shared, "en"), (None, None, None)]
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_no_documents(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}


def test_audit_without_labels(spark):
    rows = [(2, "same", "en"), (1, "same", "en"), (3, "same", None)]
    got = audited(spark, rows, [])
    assert got == brute_audit(rows, []) and got["", "EABCD", 1][1] == 1


def test_copies_across_batches_and_partitions(spark, monkeypatch):
    """Copies of one text in every task, gathered in batches of two rows, under tries of 1000 bytes."""
    monkeypatch.setattr(filter_audit, "GATHER_ROWS", 2)
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 1000)
    stem = "template of forty words or so, " * 20
    rows = [(1000 - i, stem if i % 3 else stem + str(i // 6), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = {r.doc_id: r.mask >> 4 for r in filter_audit.masks(docs).collect()}
    first = {}
    for i, text, _ in sorted(rows):
        first.setdefault(text, i)
    assert got == {i: int(first[t] < i) for i, t, _ in rows}


def test_trie_holds_whole_texts():
    pick = random.Random(3)
    texts = ["".join(pick.choice("ab") for _ in range(pick.randrange(0, 12))).encode() for _ in range(400)]
    trie, beaten = filter_audit.Trie(), []
    for i, text in enumerate(texts):
        beaten += trie.insert(text, -i if i % 2 else i, "p", 0)
    least = {}
    for i, text in enumerate(texts):
        key = -i if i % 2 else i
        least[text] = min(least.get(text, key), key)
    assert sorted(x[0] for x in trie.firsts()) == sorted(least.values()) and len(beaten) == len(texts) - len(least)


# ---- vector search


def brute_search(rows, k):
    kept = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, q in kept:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in kept if j != i and len(c) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def searched(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS score", "'x' AS rank", "vec_id AS id")
    got = vector_search.search(df, "vec_id % 50 = 0", k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("block", [16, 4096])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_search, "BLOCK", block)
    monkeypatch.setattr(vector_search, "QUERIES", 3)
    pick = np.random.default_rng(2)
    rows = [(i, (pick.normal(size=8) * (40 if i == 77 else 1)).tolist()) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(400, 460)]  # copies, more than k, queries among them
    rows += [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, rows[1][1]), (550, [1.0, 2.0]), (551, [0.5, -0.5]), (600, []), (601, []), (7, rows[7][1])]
    assert searched(spark, rows) == brute_search(rows, 5)


def test_search_of_few_vectors(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(0, [1.0, 0.0])]) == []
    assert searched(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])]) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    with pytest.raises(Exception, match="beyond"):
        searched(spark, [(0, [1e9])])


def test_bounds_hold():
    pick = np.random.default_rng(4)
    x = np.floor(pick.standard_t(2, size=(500, 6)) * 50).astype(np.int64)
    cuts = [[int(c.min()), *np.quantile(c, np.arange(1, 64) / 64).astype(int).tolist(), int(c.max())] for c in x.T]
    cells = vector_search.Cells.between(cuts)
    codes = cells.codes(x)
    assert (cells.unpack(cells.pack(codes), len(x)) == codes).all()
    at = np.arange(6)
    assert (cells.low[at, codes] <= x).all() and (x <= cells.high[at, codes]).all()
    lower, upper = cells.bounds(codes, x[:20])
    assert (lower <= x[:20] @ x.T).all() and (upper >= x[:20] @ x.T).all()


# ---- conversation trie


def brute_trie(rows):
    own = {}
    for c, *turn in rows:
        if c is not None:
            own.setdefault(c, []).append(turn)
    key = lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or "")
    own = {c: [(r or "", t or "") for _, r, t in sorted(turns, key=key)] for c, turns in own.items()}
    built = {c: own.get(c - c % 100, [])[:h] + turns[h:] for c, turns in own.items() for h in [zlib.crc32(str(c).encode()) % 6]}
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = lambda node: [u for u in members if u[: len(node)] == node]
    children = Counter(u[:-1] for u in members if u)
    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == list(node))))
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in below(node) if u)
        leaves = sum(children[u] == 0 for u in below(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children[node], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def built(spark, rows):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, c string")
    return sorted(map(tuple, conversation_trie.trie(df).collect()), key=lambda r: (r[0], r[1]))


def conversations(n, seed, width=3):
    pick = random.Random(seed)
    return [(c, t, pick.choice(["user", "assistant"]) if t % 2 else "user", pick.choice(["yes", "no", "ünü", "a longer answer"][:width])) for c in range(n) for t in range(pick.randrange(1, 9))]


@pytest.mark.parametrize("width", [1 << 20, 1 << 4])
def test_trie_equals_brute_force(spark, monkeypatch, width):
    """With a wide sketch and with one so narrow that nearly every prefix is possibly shared; few rows a salt and a block."""
    monkeypatch.setattr(conversation_trie, "WIDTHS", (1 << 4, width))
    monkeypatch.setattr(conversation_trie, "SALT_ROWS", 10)
    monkeypatch.setattr(conversation_trie, "BLOCK_IDS", 4)
    rows = conversations(230, 8)
    rows += [(300 + i, t, "user", f"{i} {t}") for i in range(5) for t in range(7)]  # alone from the first own turn
    rows += [(5, None, None, None), (6, 2, "user", "again"), (6, 2, "user", "again"), (400, 0, "system", "x" * 50_000), (None, 1, "user", "lost"), (512, 1, None, None)]
    assert built(spark, rows) == brute_trie(rows)


def test_trie_of_few_conversations(spark):
    assert built(spark, []) == []
    for rows in ([(7, 1, "user", "a")], [(1, 1, "user", "a"), (2, 1, "user", "a")], [(c, 0, "user", "hello") for c in range(0, 2000, 7)]):
        assert built(spark, rows) == brute_trie(rows)


def test_cut_files_keep_the_trie(spark):
    """Prefixes in an order and in files in which conversations are cut: what is not proven alone is grouped."""
    rows = conversations(120, 4)
    prefixes = conversation_trie.rebuilt_prefixes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    below = prefixes.filter("depth > 0")
    counts = spark.sparkContext.broadcast(conversation_trie.sketch(below, 1 << 12))
    whole = {(r.c, r.depth) for r in below.collect()}
    for cut in (prefixes, prefixes.repartition(5, "depth").sortWithinPartitions("c", "depth")):
        marked = conversation_trie._screened(cut, counts, 1 << 12).collect()
        n = Counter((r.d1, r.d2) for r in marked)
        assert {(r.c, r.depth) for r in marked} == whole and all(r.est >= n[r.d1, r.d2] for r in marked)
        assert all(n[r.d1, r.d2] == 1 for r in marked if r.kind)


def test_empty_vectors_have_places():
    assert [(n, len(x), at.tolist()) for n, x, at in vector_search.by_length(pa.array([b"", b"\0" * 8, b""], pa.binary()))] == [(0, 2, [0, 2]), (2, 1, [1])]
