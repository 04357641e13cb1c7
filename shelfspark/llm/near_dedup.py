"""Near duplicates by Order MinHash: minimum occurrence-labelled word k-mers in text order, then alignment.

A sketch takes the few smallest (hashed) k-mers of a text and keeps the order they stand in, so that it
tells moved text apart and collides with a probability that follows edit similarity. Texts that share a
sketch are candidates; a banded alignment of their words decides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import MEMO_ENTRIES, fresh, slices, stored

#: Words in a k-mer, k-mers in a sketch, sketches of a text, least similarity. K-mers choose candidates only. Where every
#: fifth word is edited no k-mer of five words is left, but half of those of two words are; a sketch of four of them in
#: text order is as rare in unlike texts as one of eight words in a row.
WORDS, PICKS, SKETCHES, SIMILARITY = 2, 4, 80, 0.8
#: Sketches of texts with fewer words than ``SHORT_WORDS``: the few k-mers that edits leave there vary more.
SHORT_SKETCHES, SHORT_WORDS = 128, 100
#: Rounds in which what still shares a bucket with another class is compared to a new member of the bucket,
#: so that large classes are joined before the pairs that are left are compared one by one. The first round
#: looks at one bucket in ``FIRST_OF``: copies share many, and the others need not be compared twice.
ROUNDS, FIRST_OF = 3, 4
#: In the last pass: texts that make a block of a group, bins of a text's word counts, and bins of all texts' counts.
BLOCK_ROWS, BINS, COUNT_BINS = 1024, 1024, 1 << 18
#: There, finer bins that tell which pairs only one text has: these can bring no texts together and are not handed on.
FINE_BINS = 1 << 24
#: There, word pairs before each one that tell whether two texts have met before.
BEFORE = 2
#: Rows of that pass in one Python call, about: many groups, whole ones.
PART_ROWS = 20_000
#: Characters of the texts that are aligned in one Python call, about: whole groups.
PART_CHARS = 8_000_000
#: Bins that a task hands on as one value.
_RUN = 1 << 14
_FINE_RUN = 1 << 20
#: Pairs whose bins are compared at a time.
_PAIRS = 4096
#: Pairs that wait for their words to decide, so that one that meets in several places is aligned once.
_WAITING = 1 << 20
#: Texts' word pairs that a task looks at together, about, and those of one pair that it hands on as one row.
_FLUSH, _CHUNK = 400_000, 256
#: Hash values held at a time while sketches are made.
_BLOCK, _LARGEST = 1 << 20, np.uint64((1 << 64) - 1)
_find_words = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    """Lower-case words; a text without any is one word as it stands, an empty one has none."""
    found = _find_words(text.lower())
    return found or [text.strip()] * bool(text.strip())


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def labelled_kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers of a text in order, each with the number of equal ones before it."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    joined = np.zeros(n, np.uint64)
    for i in range(k):
        joined = joined * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    joined = _mix(joined)
    order = np.argsort(joined, kind="stable")
    inverse = joined[order]
    first = np.ones(n, bool)
    first[1:] = inverse[1:] != inverse[:-1]
    at = np.arange(n)
    seen = np.empty(n, np.uint64)
    seen[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return _mix(joined + seen * np.uint64(0xA24BAED4963EE407))


class Sketcher:
    """``number`` sketches of a text, or ``short_number`` where it has fewer than ``SHORT_WORDS`` words."""

    def __init__(self, k: int = WORDS, picks: int = PICKS, number: int = SKETCHES, short_number: int = SHORT_SKETCHES):
        self.k, self.picks, self.number, self.words = k, picks, number, _WordHashes()
        numbers = np.arange(1, max(number, short_number) + 1, dtype=np.uint64)
        self.seeds = _mix(numbers)[:, None]
        self.odd = (_mix(numbers + np.uint64(1 << 40)) | np.uint64(1))[:, None]

    def keys(self, words: list[str]) -> np.ndarray:
        """One bucket key a sketch: its number and the picked k-mers in text order."""
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        kmers = labelled_kmers(hashes, self.k)
        n, picks = len(kmers), min(self.picks, len(kmers))
        if not n:
            return np.zeros(0, np.int64)
        out, step = [], max(1, _BLOCK // n)
        number = len(self.seeds) if len(words) < SHORT_WORDS else self.number
        for a in range(0, number, step):
            seeds, odd = self.seeds[a : min(a + step, number)], self.odd[a : min(a + step, number)]
            drawn = (kmers[None, :] ^ seeds) * odd
            drawn ^= drawn >> np.uint64(31)
            every, smallest = np.arange(len(seeds)), []
            for _ in range(picks):
                smallest.append(drawn.argmin(axis=1))
                drawn[every, smallest[-1]] = _LARGEST
            key = seeds[:, 0]
            for at in np.sort(np.stack(smallest), axis=0):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + kmers[at])
            out.append(key)
        return np.concatenate(out).view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, k: int = WORDS, picks: int = PICKS, number: int = SKETCHES, short_number: int = SHORT_SKETCHES) -> DataFrame:
    """id, digest (128 bits of the words in order, hexadecimal) and keys (array of long) of each row."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(k, picks, number, short_number)
        for batch in slices(batches):
            digests, keys = [], []
            if len(maker.words) > MEMO_ENTRIES:
                maker.words.clear()
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                digests.append(xxhash.xxh3_128_hexdigest("\0".join(words)))
                keys.append(maker.keys(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "keys"])

    return rows.mapInArrow(sketched, f"id {kind}, digest string, keys array<bigint>")


def distance_within(a: list, b: list, limit: int) -> bool:
    """Whether the edit distance of two sequences is at most ``limit``.

    Common ends and a bag bound come first. Then a bit-parallel alignment over the band of diagonals that
    such a distance can reach: bit i of a column stands for the cell i below the band's upper edge, and
    the score is followed along the lower edge, then along the last row.
    """
    if abs(len(a) - len(b)) > limit:
        return False
    if a == b or not limit:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= limit:
        return True
    mine, other = Counter(a), Counter(b)
    if (mine - other).total() > limit or (other - mine).total() > limit:
        return False
    where: dict = {}
    for p, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << p
    width = 2 * limit + 1
    mask, lowest = (1 << width) - 1, 1 << (width - 1)
    plus, minus, score, row = ((1 << (limit + 1)) - 1) << limit, 0, limit, 1 << (width - 2)
    most = limit + len(b) - (len(a) - limit)  # from here the score cannot come down to the limit
    for column, x in enumerate(b):
        match = where.get(x, 0)
        match = (match >> (column - limit) if column >= limit else match << (limit - column)) & mask
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        right_plus = minus | (mask & ~(diagonal | plus))
        right_minus = diagonal & plus
        if column < len(a) - limit:
            score += not diagonal & lowest
        else:
            score += bool(right_plus & row) - bool(right_minus & row)
            row >>= 1
        if score > most:
            return False
        down = diagonal >> 1
        plus, minus = right_minus | (mask & ~(down | right_plus)), down & right_plus
    return score <= limit


def similar(a: list, b: list, similarity: float) -> bool:
    """Whether 1 - distance / length of the longer is at least ``similarity``."""
    return distance_within(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """label and other_label of the pairs (id, label, other, other_label) whose texts align."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            held: dict[str, list[str]] = {}
            for column in (2, 3):
                held.update((t, words_of(t)) for t in set(batch.column(column).to_pylist()) - held.keys())
            keep = [similar(held[s], held[t], similarity) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["label", "other_label"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["id"].dataType.simpleString()
    first = pairs.join(texts, "id").withColumnRenamed("text", "text_a")
    both = first.join(texts.select(F.col("id").alias("other"), F.col("text").alias("text_b")), "other")
    return both.select("label", "other_label", "text_a", "text_b").mapInArrow(aligned, f"label {kind}, other_label {kind}")


def _word_pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of two words in a row, each with the number of equal ones before it; one word stands alone."""
    return labelled_kmers(hashes, 2)


def _rare_pairs(df: DataFrame, choose: Callable[[np.ndarray], np.ndarray], meets: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """For each word pair (token) that ``choose`` takes of texts of ``df`` (id, label, text), in its order: the texts that have it.

    Arrays hold, for each text under the token, id, label, n_words, at (the token's place there) and the ``BEFORE`` tokens before it (0
    where there are none). A task puts ``_CHUNK`` texts at most of those it looks at together in one row, so that
    a frequent pair is few rows. Pairs for which ``meets`` is false keep their place but are not handed on.
    """
    kind, names = df.schema["id"].dataType.simpleString(), [f"before_{k}" for k in range(1, BEFORE + 1)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, texts, rows, count = _WordHashes(), [], [], 0

        def together() -> pa.RecordBatch:
            ids, labels = (pa.chunked_array([x.column(c) for x in texts]).combine_chunks() for c in (0, 1))
            token, of, *columns = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.argsort(token, kind="stable")
            token, of = token[order], pa.array(of[order])
            new = np.r_[True, token[1:] != token[:-1]]
            nth = np.arange(len(token)) - np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            starts = np.flatnonzero(nth % _CHUNK == 0)
            ends = pa.array(np.r_[starts, len(token)].astype(np.int32))
            arrays = [ids.take(of), labels.take(of), *(pa.array(c[order]) for c in columns)]
            return pa.RecordBatch.from_arrays([pa.array(token[starts]), *(pa.ListArray.from_arrays(ends, x) for x in arrays)], names=["token", "id", "label", "n_words", "at", *names])

        for batch in slices(batches):
            if len(known) > MEMO_ENTRIES:
                known.clear()
            first = sum(x.num_rows for x in texts)
            texts.append(batch.select(["id", "label"]))
            for row, text in enumerate(batch.column(2)):
                words = words_of(text.as_py())
                tokens = choose(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                at = np.flatnonzero(meets(tokens))
                tokens = tokens.view(np.int64)
                before = [np.where(at >= k, tokens[np.maximum(at - k, 0)], 0) for k in range(1, BEFORE + 1)]
                rows.append((tokens[at], np.full(len(at), first + row), np.full(len(at), len(words), np.int32), at.astype(np.int32), *before))
                count += len(at)
            if count >= _FLUSH:
                yield together()
                texts, rows, count = [], [], 0
        if count:
            yield together()

    return df.select("id", "label", "text").mapInArrow(made, f"token bigint, id array<{kind}>, label array<{kind}>, n_words array<int>, at array<int>, " + ", ".join(f"{n} array<bigint>" for n in names))


def _fine_bins(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64) % FINE_BINS


def pair_counts(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often pairs of words fall in each of ``COUNT_BINS`` bins, over the column text of all rows; and a bit for each of ``FINE_BINS`` bins: whether two fall there.

    Tasks count for themselves and hand on packed runs of ``_RUN`` bins (``_FINE_RUN`` fine ones, under negative numbers); the
    sums are ``COUNT_BINS`` numbers and ``FINE_BINS`` bits, whatever the table's size.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, fine = _WordHashes(), np.zeros(COUNT_BINS, np.int64), np.zeros(FINE_BINS, np.uint8)
        for batch in slices(batches):
            if len(known) > MEMO_ENTRIES:
                known.clear()
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                tokens = _word_pairs(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                np.add.at(total, (tokens % np.uint64(COUNT_BINS)).astype(np.int64), 1)
                bins, n = np.unique(_fine_bins(tokens), return_counts=True)
                fine[bins] = np.minimum(fine[bins] + np.minimum(n, 2), 2)
        for numbers, size, sign in ((total, _RUN, 1), (fine, _FINE_RUN, -1)):
            for run in range(0, len(numbers), size):
                if numbers[run : run + size].any():
                    at = run if sign > 0 else -1 - run
                    yield pa.RecordBatch.from_pydict({"run": pa.array([at], pa.int64()), "counts": pa.array([zlib.compress(numbers[run : run + size].tobytes(), 1)], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for run, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                more = np.frombuffer(zlib.decompress(blob), np.int64 if run >= 0 else np.uint8)
                sums[run] = sums.get(run, 0) + more if run >= 0 else np.minimum(sums.get(run, 0) + more, 2)
        for run, counts in sums.items():
            packed = counts if run >= 0 else np.packbits(counts > 1)
            yield pa.RecordBatch.from_pydict({"run": pa.array([run], pa.int64()), "counts": pa.array([packed.tobytes()], pa.binary())})

    kind = "run bigint, counts binary"
    out, twice = np.zeros(COUNT_BINS, np.int64), np.zeros(FINE_BINS // 8, np.uint8)
    for r in df.select("text").mapInArrow(counted, kind).repartition("run").mapInArrow(added, kind).collect():
        if r.run >= 0:
            out[r.run : r.run + _RUN] = np.frombuffer(r.counts, np.int64)
        else:
            start = (-1 - r.run) // 8
            twice[start : start + _FINE_RUN // 8] = np.frombuffer(r.counts, np.uint8)
    return out, twice


def _rest(entries: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """id, label, other, other_label: every pair of two classes that aligns, of all texts in buckets with two classes.

    An edit spoils two pairs of neighbouring words at most, so texts within the similarity share
    f(m) = m - 1 - 2 * floor((1 - similarity) * m) pairs, m words in the longer. They share one of the first
    2 * (1 - similarity) * n + 2 of the rarest pairs of a text of n words, in one order for all texts, for f falls by one at
    most as m grows. Equal pairs are told apart by the number of those before, so the bound holds for
    repeated ones. So texts meet under what is rare in them, and the first pair that two share must leave f(m)
    pairs to share from there on in both. Where one of the ``BEFORE`` pairs before is shared too, the texts have
    met under it, and it is decided there; so a passage that thousands have brings two texts together about once.

    Texts under one pair are dealt to blocks, and a group holds two blocks of a few numbers for each text, so that the
    texts of a pair are written again only beyond ``BLOCK_ROWS`` of them (n texts: each n / ``BLOCK_ROWS`` times). Of a group
    only the texts that meet another one are handed on, not their pairs: those are made again where a whole group is
    aligned, to which each text travels once (``_aligned``).
    """
    mixed = entries.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    rows = stored(texts.join(entries.join(mixed, "key").select("id", "label").distinct(), "id").select("id", "label", "text"))
    shared = rows.sparkSession.sparkContext.broadcast(pair_counts(rows))

    def rarest(words: np.ndarray) -> np.ndarray:
        tokens = _word_pairs(words)
        seen = shared.value[0][(tokens % np.uint64(COUNT_BINS)).astype(np.int64)]
        # those that only one text has come first: they take places, and no text meets another under them
        return tokens[np.lexsort((tokens, seen, in_two_texts(tokens)))[: 2 * int((1 - similarity) * len(words) + 1e-9) + 2]]

    def in_two_texts(tokens: np.ndarray) -> np.ndarray:
        bins = _fine_bins(tokens)
        return (shared.value[1][bins >> 3] >> (7 - (bins & 7)).astype(np.uint8) & 1).astype(bool)

    meets = _rare_pairs(rows, rarest, in_two_texts)  # made twice: in a table it would be larger than the texts
    groups = meets.groupBy("token").agg(F.sum(F.size("id")).alias("n"), F.min(F.array_min("label")).alias("low"), F.max(F.array_max("label")).alias("high"))
    groups = stored(groups.filter("low <> high").select("token", "n", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")))
    parts = -(-(groups.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) // PART_ROWS)
    own = F.pmod(F.xxhash64(F.col("id")[0], F.lit("block")), F.col("blocks")).alias("own")  # a row's texts stay together
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")
    dealt = meets.join(groups.drop("n"), "token").select(*meets.columns, own, blocks)
    dealt = dealt.withColumns({"one": F.least("own", "with"), "two": F.greatest("own", "with")}).drop("with")
    kind = entries.schema["id"].dataType.simpleString()

    befores = [f"before_{k}" for k in range(1, BEFORE + 1)]
    listed = ["id", "label", "n_words", "at", *befores]

    def meeting(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        of = pc.list_parent_indices(part.column("id"))
        part = pa.table({c: pc.list_flatten(part.column(c)) if c in listed else part.column(c).take(of) for c in part.column_names})
        part = part.select(["id", "label", "place", "side", "n_words", "at", *befores]).sort_by("place").combine_chunks()
        meets = np.zeros(part.num_rows, bool)
        for i, j in _candidates(part, similarity):
            meets[i] = meets[j] = True
        return part.filter(pa.array(meets, pa.bool_()))

    side = F.when(F.col("one") == F.col("two"), 0).when(F.col("own") == F.col("one"), 1).otherwise(2)  # two blocks meet each other, one meets itself
    dealt = dealt.withColumns({"place": F.xxhash64("token", "one", "two"), "side": side}).withColumn("part", F.pmod("place", F.lit(max(1, parts))))
    columns = f"id {kind}, label {kind}, place bigint, side int, n_words int, at int, " + ", ".join(f"{n} bigint" for n in befores)
    members = dealt.select("part", "place", "side", *listed).groupBy("part").applyInArrow(meeting, columns)
    return _aligned(stored(members), rows, similarity)


def _candidates(members: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in ``members``, in order of place, of the pairs of two classes that may align and have not met before: some for each step between rows."""
    place, side, n, at = (members.column(c).to_numpy() for c in ("place", "side", "n_words", "at"))
    before = [members.column(f"before_{k}").to_numpy() for k in range(1, BEFORE + 1)]
    code = members.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    ahead = np.maximum(n - 1, 1) - at
    i, step = np.arange(len(place)), 0
    while len(i):  # each row with the one so many rows further on, as long as any place reaches so far
        step += 1
        i = i[i + step < len(place)]
        i = i[place[i] == place[i + step]]
        j = i + step
        longer = np.maximum(n[i], n[j])
        limit = ((1 - similarity) * longer + 1e-9).astype(np.int64)
        near = (code[i] != code[j]) & ((side[i] == 0) | (side[i] != side[j])) & (np.abs(n[i] - n[j]) <= limit)
        near = np.flatnonzero(near & (np.minimum(ahead[i], ahead[j]) >= longer - 1 - 2 * limit))
        for x in before:
            for y in before:
                x_i, y_j = x[i[near]], y[j[near]]
                near = near[(x_i != y_j) | (x_i == 0)]
        if len(near):
            yield i[near], j[near]


def _aligned(members: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """id, label, other, other_label of the pairs of ``members`` of one place that may meet (``_candidates``) and whose texts align.

    Pairs are made where they are looked at, so what is handed on are a place's members, in proportion to its texts. Each of
    their texts (``rows``: id, label, text) is brought there once: two blocks of texts at most. Pairs whose lengths or
    binned word counts differ by more than the edit distance go first, many at a time; words decide the rest.
    """
    ends = lambda c: members.select(c, "id").distinct()
    n_chars = ends("place").join(rows.select("id", F.length("text").alias("n_chars")), "id").agg(F.sum("n_chars")).first()[0] or 0
    members = members.withColumn("part", F.pmod("place", F.lit(max(1, -(-n_chars // PART_CHARS)))))
    texts = ends("part").join(rows, "id").select(F.col("part").alias("text_part"), F.col("id").alias("text_id"), F.col("label").alias("text_label"), "text")
    kind = rows.schema["id"].dataType.simpleString()

    def checked(met: pa.Table, texts: pa.Table) -> pa.Table:
        codes: dict[str, int] = {}
        held = [np.array([codes.setdefault(w, len(codes)) for w in words_of(t.as_py())], np.int32) for t in texts.column("text")]
        bins = np.zeros((len(held), BINS), np.uint8)
        for row, words in zip(bins, held, strict=True):
            row[:] = np.minimum(np.bincount(words % BINS, minlength=BINS), 255)
        n = np.array([len(words) for words in held], np.int64)
        # an id that repeats has several texts, and each of them is looked at
        texts = texts.append_column("text_at", pa.array(np.arange(len(held))))
        met = met.join(texts.select(["text_id", "text_at"]), "id", "text_id", join_type="inner", use_threads=False).sort_by("place").combine_chunks()
        text_at = met.column("text_at").to_numpy()
        found, waiting = [np.zeros(0, np.int64)], []

        def decided() -> None:
            for key in np.setdiff1d(np.concatenate([np.zeros(0, np.int64), *waiting]), found[0]):
                i, j = divmod(int(key), len(held))
                if similar(held[i].tolist(), held[j].tolist(), similarity):
                    found.append(np.array([key]))
            waiting.clear()
            found[:] = [np.unique(np.concatenate(found))]

        for left, right in _candidates(met, similarity):
            left, right = text_at[left], text_at[right]
            for start in range(0, len(left), _PAIRS):
                i, j = left[start : start + _PAIRS], right[start : start + _PAIRS]
                limit = ((1 - similarity) * np.maximum(n[i], n[j]) + 1e-9).astype(np.int64)
                apart = bins[i].astype(np.int16) - bins[j]
                more = np.maximum(apart, 0).sum(axis=1, dtype=np.int64)
                near = (np.abs(n[i] - n[j]) <= limit) & (more <= limit) & (more - apart.sum(axis=1, dtype=np.int64) <= limit)
                waiting.append(np.minimum(i, j)[near] * len(held) + np.maximum(i, j)[near])
            if sum(map(len, waiting)) >= _WAITING:
                decided()
        decided()
        ids, labels = (texts.column(c).combine_chunks() for c in ("text_id", "text_label"))
        one, other = (pa.array(x) for x in (found[0] // max(1, len(held)), found[0] % max(1, len(held))))
        out = pa.table({"id": ids.take(one), "label": labels.take(one), "other": ids.take(other), "other_label": labels.take(other)})
        later = pc.greater(out.column("id"), out.column("other"))
        swapped = {c: pc.if_else(later, out.column(o), out.column(c)) for c, o in (("id", "other"), ("label", "other_label"), ("other", "id"), ("other_label", "label"))}
        return pa.table(swapped)

    met = members.groupBy("part").cogroup(texts.groupBy("text_part")).applyInArrow(checked, f"id {kind}, label {kind}, other {kind}, other_label {kind}")
    return met.distinct()


def components(links: DataFrame) -> DataFrame:
    """id, label for each end of ``links`` (two columns): the smallest id that it reaches.

    Each round every node moves to the smallest of its neighbours, and on to where that one moves; links
    then join the nodes moved to, and those within one node go. Links shrink from round to round, until none
    is left. Each round is written to the shared folder.
    """
    one, two = links.columns
    edges = stored(links.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).filter("a <> b").distinct())
    labels = None
    while True:
        moves = edges.select(F.col("b").alias("id"), F.col("a").alias("to")).union(edges.select("a", "a")).groupBy("id").agg(F.min("to").alias("to"))
        further = moves.select(F.col("id").alias("to"), F.col("to").alias("further"))
        moves = stored(moves.join(further, "to", "left").select("id", F.coalesce("further", "to").alias("to")))
        if labels is None:
            labels = moves.withColumnRenamed("to", "label")
        else:
            labels = stored(labels.join(moves.select(F.col("id").alias("label"), "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        moved = edges.join(moves.select(F.col("id").alias("a"), F.col("to").alias("new_a")), "a").join(moves.select(F.col("id").alias("b"), F.col("to").alias("new_b")), "b")
        edges = stored(moved.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).filter("a <> b").distinct())
        if edges.isEmpty():
            return labels


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = WORDS, picks: int = PICKS,
    number: int = SKETCHES, short_number: int = SHORT_SKETCHES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per row of ``df``: ``id_col``, class_id (smallest id of its class) and copies (rows with the same words).

    Classes are the connected components of links between texts whose words align to ``similarity`` or
    more (1 - edit distance / words of the longer text). Texts with the same words are one text from the
    start. Candidates share one of ``number`` (``short_number`` below ``SHORT_WORDS`` words) sketches of ``picks``
    k-mers. In each bucket all members are compared to one of them, which then leaves it, and again, for
    ``rounds``, the others to another, so that large classes are joined with work in proportion to their
    members. Then all pairs of texts in buckets that still hold two classes are compared that share rare
    pairs of words as links must (``_rest``): no bucket is cut or left out.

    Words are runs of letters and digits: where a script sets no spaces a clause is one word, and copies
    there are found by their equal clauses. Aligning a pair takes words times a fifth of the words, in bits,
    on one core: a minute at a million words.

    Null and empty texts are one text; a text without words counts as one word. Rows without an id keep a
    null class. Ids that repeat are one node of the graph. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = stored(sketches(rows, "id", "text", k, picks, number, short_number))
    same = made.filter("id is not null").groupBy("digest").agg(F.min("id").alias("text_id"), F.count(F.lit(1)).alias("copies"))
    members = stored(made.select("id", "digest").join(same, "digest", "left").select("id", "text_id", "copies"))
    texts_of = members.select("text_id").filter("text_id is not null").distinct()
    entries = made.join(texts_of, made["id"] == texts_of["text_id"], "left_semi").select("id", F.explode("keys").alias("key"))
    # counted in each task first, so a bucket of many texts is a few rows in the shuffle
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    entries = stored(entries.join(shared, "key"))
    texts = stored(rows.join(entries.select("id").distinct(), "id", "left_semi").distinct())

    labels = stored(texts.select("id", F.col("id").alias("label")).distinct())
    entries = entries.withColumn("label", F.col("id"))
    for turn in range(rounds + 1):
        if turn < rounds:
            draw = F.xxhash64("id", F.lit(turn))
            first = F.pmod("key", F.lit(FIRST_OF)) == 0
            looked_at = entries if turn else entries.filter(first)
            heads = looked_at.groupBy("key").agg(F.min(F.struct(draw.alias("draw"), "id", "label")).alias("head"), F.min("label").alias("low"), F.max("label").alias("high"))
            heads = heads.filter("low <> high").select("key", F.col("head.id").alias("other"), F.col("head.label").alias("other_label"))
            # a bucket of one class stays one, and what the others were compared to has no pair left there: the rest is written again
            mixed = stored(looked_at.join(heads, "key"))
            pairs = mixed.filter("label <> other_label").select("id", "label", "other", "other_label").distinct()
            links = _verified(pairs, texts, similarity)
            mixed = mixed.filter("id <> other").select("id", "key", "label")
            entries = mixed if turn else mixed.unionByName(entries.filter(~first))
        else:
            links = _rest(entries, texts, similarity).select("label", "other_label")
        links = stored(links.distinct())
        if links.isEmpty():
            continue
        new = components(links).select(F.col("id").alias("label"), F.col("label").alias("new_label"))
        moved = F.coalesce("new_label", "label").alias("label")
        labels = stored(labels.join(new, "label", "left").select("id", moved))
        if turn < rounds:
            entries = stored(entries.join(new, "label", "left").select("id", "key", moved))
    labels = labels.withColumnRenamed("id", "text_id")
    result = members.join(labels, "text_id", "left")
    known = F.col("id").isNotNull()
    return result.select(F.col("id").alias(id_col), F.when(known, F.coalesce("label", "text_id")).alias("class_id"), F.when(known, F.col("copies")).alias("copies"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``df`` that stand for their class: those of its smallest id, once where rows repeat it.

    Of rows that repeat the id, the one with the smallest text stays. Rows without an id stay.
    """
    head, nth = fresh(df, "_head", "_nth")
    classes = near_duplicates(df, id_col, text_col, **options)
    heads = classes.filter(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias(head)).distinct()
    with_id = df.join(heads, df[id_col] == heads[head], "left_semi")
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    once = with_id.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).drop(nth)
    return once.unionByName(df.filter(F.col(id_col).isNull()))
