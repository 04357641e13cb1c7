"""Toxicity by a convolutional text classifier: hashed word embeddings, several widths, max pooling, in numpy."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import MEMO_ENTRIES, slices, stored

_find_words = re.compile(r"\w+").findall
#: Words of texts that are scored together, some more if the last text is long.
SCORED_WORDS = 8192


@dataclass(frozen=True)
class Settings:
    """Shape and training of the classifier."""

    buckets: int = 1 << 18
    size: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 16
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    epochs: int = 8
    batch_words: int = 20_000
    rate: float = 0.01
    row_rate: float = 0.1
    seed: int = 7
    #: Training rows that one task learns from at a time, on the average; what such shards learn is averaged.
    shard_rows: int = 4096
    #: A feature that fewer training rows have is left out: such a row could be learnt by heart.
    least_seen: int = 3
    #: One in so many training rows is kept for the thresholds.
    calibration: int = 5
    #: A language with fewer rows of either label than this gets the threshold of all languages.
    least_rows: int = 15


_WORD, _PREFIX = zlib.crc32(b"w"), zlib.crc32(b"p")


def word_features(word: str, s: Settings) -> list[int]:
    """Buckets of a word: the word itself and those of its beginnings that are shorter than it."""
    raw, crc, buckets, length = word.encode("utf-8", "surrogatepass"), zlib.crc32, s.buckets, len(word)
    found = [crc(raw, _WORD) % buckets]
    if len(raw) == length:
        found += [crc(raw[:n], _PREFIX) % buckets for n in s.prefixes if n < length]
    else:
        found += [crc(word[:n].encode("utf-8", "surrogatepass"), _PREFIX) % buckets for n in s.prefixes if n < length]
    return found


def words_of(text: str) -> list[str]:
    return _find_words(text.lower())


@dataclass
class Model:
    """Weights, and thresholds by language (None: all languages)."""

    s: Settings
    table: np.ndarray
    filters: list[np.ndarray]
    shift: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, s: Settings) -> Model:
        rng = np.random.default_rng(s.seed)
        table = rng.normal(0, 0.05, (s.buckets + 1, s.size)).astype(np.float32)
        table[-1] = 0  # stands for no feature
        filters = [rng.normal(0, (2 / (w * s.size)) ** 0.5, (w, s.size, s.filters)).astype(np.float32) for w in s.widths]
        n = len(s.widths) * s.filters
        return cls(s, table, filters, np.zeros(n, np.float32), rng.normal(0, 0.1, n).astype(np.float32), 0.0)

    def answers(self, vectors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's answer at every word of texts that stand one after another, and where each text starts.

        A text shorter than the widest filter takes that filter's room, with words of zeros behind it. Where a
        window would reach beyond its text the answer is below all others.
        """
        s, widest = self.s, max(self.s.widths)
        room = np.maximum(sizes, widest)
        starts = np.cumsum(room) - room
        total = int(room.sum())
        if total > len(vectors):
            padded = np.zeros((total, s.size), np.float32)
            padded[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(vectors))] = vectors
            vectors = padded
        parts = np.concatenate([w.transpose(0, 2, 1).reshape(-1, s.size) for w in self.filters]) @ vectors.T
        out, first, left = np.empty((len(s.widths) * s.filters, total), np.float32), 0, np.repeat(starts + room, room) - np.arange(total)
        words_left, begins = left - np.repeat(room - sizes, room), np.zeros(total, bool)
        begins[starts] = True
        for k, w in enumerate(s.widths):
            answer = out[k * s.filters : (k + 1) * s.filters]
            answer[:] = parts[first : first + s.filters]
            for i in range(1, w):
                answer[:, : total - i] += parts[first + i * s.filters : first + (i + 1) * s.filters, i:]
            first += w * s.filters
            answer[:, np.flatnonzero((words_left < w) & ~begins)] = -np.inf  # a text's first window always counts
        return out, starts

    def pooled_all(self, vectors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, each filter's largest answer over its word vectors, and where it stands (-1: nowhere above 0)."""
        out, starts = self.answers(vectors, sizes)
        place = np.stack([out[:, a:b].argmax(axis=1) for a, b in zip(starts, [*starts[1:], out.shape[1]], strict=True)])
        top = out[np.arange(len(out)), starts[:, None] + place] + self.shift
        return np.maximum(top, 0), np.where(top > 0, place, -1)

    def pooled(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text."""
        top, place = self.pooled_all(vectors, np.array([len(vectors)]))
        return top[0], place[0]

    def score(self, pooled: np.ndarray) -> np.ndarray:
        z = np.clip(pooled.astype(np.float64) @ self.out.astype(np.float64) + self.bias, -30, 30)
        return 1 / (1 + np.exp(-z))


class Words:
    """Words of texts as numbers, with the buckets of each word's features (``s.buckets`` stands for none)."""

    def __init__(self, s: Settings):
        self.s, self.index, self.wide = s, {}, 1 + len(s.prefixes)
        self.flat = array("i")

    def encode(self, text: str) -> list[int]:
        get = self.index.get
        return [n if (n := get(w)) is not None else self.place(w) for w in words_of(text)]

    def place(self, word: str) -> int:
        n = self.index[word] = len(self.index)
        found = word_features(word, self.s)
        self.flat.extend(found + [self.s.buckets] * (self.wide - len(found)))
        return n

    def features(self, first: int = 0) -> np.ndarray:
        """Buckets of the words from number ``first`` on, a row for each."""
        return np.array(self.flat[first * self.wide :], np.int32).reshape(-1, self.wide)


class Scorer:
    """Scores texts, some thousand words at a time; vectors of words are kept for the next texts."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.words, self.known = Words(self.model.s), 0
        self.vectors = np.zeros((1024, self.model.s.size), np.float32)

    def _learn(self) -> None:
        """Vectors of the words that are new."""
        if (n := len(self.words.index)) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros((max(n - len(self.vectors), len(self.vectors)), self.model.s.size), np.float32)])
        self.vectors[self.known : n] = self.model.table[self.words.features(self.known)].sum(axis=1)
        self.known = n

    def score(self, text: str) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str]) -> list[float]:
        found, rows, sizes = [], [], []
        for k, text in enumerate(texts):
            rows += (words := self.words.encode(text))
            sizes.append(len(words))
            if len(rows) < SCORED_WORDS and k + 1 < len(texts):
                continue
            self._learn()
            out, starts = self.model.answers(self.vectors[np.array(rows, np.int64)], np.array(sizes))
            top = np.maximum.reduceat(out, starts, axis=1).T + self.model.shift
            found += self.model.score(np.maximum(top, 0)).tolist()
            rows, sizes = [], []
            if self.known > MEMO_ENTRIES // 2:
                self.clear()
        return found


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.n, self.m, self.v = rate, 0, {}, {}

    def step(self, name: object, weights: np.ndarray, grad: np.ndarray) -> None:
        m = self.m[name] = 0.9 * self.m.get(name, 0.0) + 0.1 * grad
        v = self.v[name] = 0.99 * self.v.get(name, 0.0) + 0.01 * grad * grad
        weights -= (self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-8)).astype(weights.dtype)


def lean(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far each bucket's log odds for label 1 are from none, less their error. ``seen``: rows of each label (first axis) that have it, of ``n``."""
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    error = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    return np.sign(odds) * np.maximum(np.abs(odds) - 1.64 * error, 0)


def start(seen: np.ndarray, n: np.ndarray, s: Settings) -> Model:
    """The model that training starts from: embeddings along one direction by as much as their bucket leans to
    label 1, and the first filter of each width along it too. Features of few rows are nothing."""
    model, way = Model.fresh(s), np.full(s.size, s.size**-0.5, np.float32)
    often = seen.sum(axis=0) >= s.least_seen
    model.table[~often] = 0
    model.table += np.where(often, lean(seen, n), 0)[:, None].astype(np.float32) * way
    model.table[-1] = 0
    for k, weights in enumerate(model.filters):
        weights[:, :, 0] += way
        model.out[k * s.filters] = 0.5
    return model


def train(first: Model, often: np.ndarray, documents: list[np.ndarray], labels: np.ndarray, features: np.ndarray, seed: int) -> Model:
    """What ``first`` becomes by texts (numbers of words, whose buckets are in ``features``) with labels 0 and 1; only
    buckets that are ``often`` count. Gradients pass through the windows that max pooling picked."""
    s, rng = first.s, np.random.default_rng((first.s.seed + 1, seed))
    model = replace(first, table=first.table.copy(), filters=[w.copy() for w in first.filters], shift=first.shift.copy(), out=first.out.copy())
    features = np.where(often[features], features, s.buckets)
    features.sort(axis=1)
    features = features[:, : max(1, int((features < s.buckets).sum(axis=1).max(initial=0)))]
    # words without any feature that counts are one word
    known = features[:, 0] < s.buckets
    number = np.where(known, np.cumsum(known), 0)
    features = np.concatenate([np.full((1, features.shape[1]), s.buckets, features.dtype), features[known]])
    documents = [number[d] for d in documents]
    adam, squares, bias = _Adam(s.rate), np.full(len(model.table), 1e-2, np.float32), np.zeros(1, np.float32)
    sizes = np.array([len(d) for d in documents])
    for _ in range(s.epochs):
        batch, held = [], 0
        order = rng.permutation(len(documents))
        for k, d in enumerate(order):
            batch.append(d)
            held += sizes[d]
            if held < s.batch_words and k + 1 < len(order):
                continue
            adam.n += 1
            _step(model, [documents[d] for d in batch], labels[batch], features, adam, squares, bias)
            batch, held = [], 0
    return model


def _added(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the sum of the values that stand at it."""
    wide = values.shape[1]
    places = (at[:, None] * wide + np.arange(wide)).ravel()
    return np.bincount(places, values.ravel(), n * wide).reshape(n, wide).astype(np.float32)


def _step(model: Model, batch: list[np.ndarray], labels: np.ndarray, features: np.ndarray, adam: _Adam, squares: np.ndarray, bias: np.ndarray) -> None:
    """One descent on a batch: dense weights by moments, touched embedding rows by their own step sizes."""
    s = model.s
    words, inverse = np.unique(np.concatenate(batch), return_inverse=True)
    known = model.table[features[words]].sum(axis=1)
    grads = [np.zeros_like(w) for w in model.filters]
    sizes = np.array([len(d) for d in batch])
    pooled, places = model.pooled_all(known[inverse], sizes)
    push = (model.score(pooled) - labels) / len(batch)
    out_grad, bias_grad = push @ pooled, push.sum()
    back = np.where(places >= 0, push[:, None] * model.out, 0).astype(np.float32)
    shift_grad, begins = back.sum(axis=0), np.cumsum(sizes) - sizes
    moved, by = [], []
    for k, (w, weights) in enumerate(zip(s.widths, model.filters, strict=True)):
        part = slice(k * s.filters, (k + 1) * s.filters)
        for i in range(w):
            at = places[:, part] + i
            on = (back[:, part] != 0) & (at < sizes[:, None])
            text, filter_ = np.nonzero(on)
            rows, scale = inverse[begins[text] + at[text, filter_]], back[:, part][text, filter_][:, None]
            felt = np.zeros((*on.shape, s.size), np.float32)
            felt[text, filter_] = known[rows] * scale
            grads[k][i] = felt.sum(axis=0).T
            moved.append(rows)
            by.append(weights[i].T[filter_] * scale)
    pushes = _added(np.concatenate(moved), np.concatenate(by), len(known))
    touched = np.flatnonzero(pushes.any(axis=1))
    rows = features[words[touched]]
    flat, inverse = np.unique(rows.ravel(), return_inverse=True)
    total = _added(inverse.ravel(), np.repeat(pushes[touched], rows.shape[1], axis=0), len(flat))
    total[flat == s.buckets] = 0
    squares[flat] += (total**2).mean(axis=1)
    model.table[flat] -= s.row_rate * total / np.sqrt(squares[flat])[:, None]
    for i, g in enumerate(grads):
        adam.step(i, model.filters[i], g)
    adam.step("shift", model.shift, shift_grad)
    adam.step("out", model.out, out_grad)
    adam.step("bias", bias, np.array([bias_grad], np.float32))
    model.bias = float(bias[0])


def best_threshold(low: np.ndarray, high: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> float:
    """The middle of the gap between bins of scores (the highest first) at which F1 is highest; hits and rows are weighted."""
    f1 = 2 * np.cumsum(hits) / np.maximum(np.cumsum(rows) + hits.sum(), 1e-9)
    k = int(f1.argmax())
    return float((low[k] + (high[k + 1] if k + 1 < len(low) else 0.0)) / 2)


def learnable(id_col: str) -> Column:
    """Whether a row's label may be learnt from; the other rows stay for tests."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def seen_buckets(rows: DataFrame, s: Settings) -> np.ndarray:
    """How many rows of label 0 and of label 1 have each bucket, counted by task and summed: as many rows as buckets at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(s), np.zeros((2, s.buckets + 1), np.int64)
        for batch in slices(batches):
            texts = [list(set(words.encode(text))) for text in batch.column(0).to_pylist()]
            features = words.features()
            for found, label in zip(texts, batch.column(1).to_pylist(), strict=True):
                seen[label, np.unique(features[np.array(found, np.int64)])] += 1
            if len(words.index) > MEMO_ENTRIES // 2:
                words = Words(s)
        found = np.flatnonzero(seen[:, : s.buckets].any(axis=0))
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found, seen[0, found], seen[1, found])], names=["bucket", "n0", "n1"])

    summed = rows.select("text", "label").mapInArrow(counted, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    seen = np.zeros((2, s.buckets + 1))
    seen[:, summed["bucket"].to_numpy()] = summed["n0"].to_numpy(), summed["n1"].to_numpy()
    return seen


#: Changes of weights are summed as whole numbers of this part of 1, so that no order of tasks changes the sum.
_PART = 1 << 24


def _dense(model: Model) -> np.ndarray:
    """All weights but the embeddings, in rows as wide as these."""
    flat = np.concatenate([*[w.ravel() for w in model.filters], model.shift, model.out, [model.bias]])
    return np.append(flat, np.zeros(-len(flat) % model.s.size)).reshape(-1, model.s.size)


def learnt(rows: DataFrame, first: Model, seen: np.ndarray, shards: int) -> Model:
    """``first`` after all ``rows`` (id, text, label): each shard of them trains it by itself, and what they change is averaged.

    Rows are dealt to shards by the hash of their ids. A bucket's change is the mean over the shards that change it, so that
    rare features learn as fast in many shards as in one. A task adds up its shards' changes; the driver gets one model.
    """
    s, columns = first.s, [f"d{i}" for i in range(first.s.size)]
    shared = rows.sparkSession.sparkContext.broadcast((first, seen.sum(axis=0) >= s.least_seen))

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, often), before = shared.value, None
        table, times, dense, n = np.zeros(first.table.shape, np.int64), np.zeros(len(first.table), np.int64), 0, 0
        words, documents, labels = Words(s), [], []

        def end() -> None:
            nonlocal words, documents, labels, dense, n
            model = train(first, often, documents, np.array(labels, np.float64), words.features(), before)
            changed = np.flatnonzero((model.table != first.table).any(axis=1))
            table[changed] += np.rint((model.table[changed].astype(np.float64) - first.table[changed]) * _PART).astype(np.int64)
            times[changed] += 1
            dense, n = dense + np.rint((_dense(model) - _dense(first)) * _PART).astype(np.int64), n + 1
            words, documents, labels = Words(s), [], []

        for batch in slices(batches):
            for shard, text, label in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if documents and shard != before:
                    end()
                before = shard
                documents.append(np.array(words.encode(text), np.int32))
                labels.append(label)
        if documents:
            end()
            changed = np.flatnonzero(times)
            values = np.concatenate([table[changed], dense])
            keys, many = np.concatenate([changed, -1 - np.arange(len(dense))]), np.concatenate([times[changed], np.full(len(dense), n)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(many), *[pa.array(values[:, i]) for i in range(s.size)]], names=["bucket", "n", *columns])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int")).repartition(min(4 * shards, max(shards, 4000)), "shard")
    sent = dealt.sortWithinPartitions("shard", F.xxhash64("id"), "text").select("shard", "text", "label").mapInArrow(trained, f"bucket long, n long, {', '.join(f'{c} long' for c in columns)}")
    means = sent.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).select("bucket", *[(F.col(c) / F.col("n") / float(_PART)).cast("float").alias(c) for c in columns]).toArrow()
    bucket, change = means["bucket"].to_numpy(), np.stack([means[c].to_numpy() for c in columns], axis=1)
    model, weights = replace(first, table=first.table.copy(), thresholds={}), _dense(first)
    model.table[bucket[bucket >= 0]] += change[bucket >= 0]
    weights[-1 - bucket[bucket < 0]] += change[bucket < 0]
    flat, model.filters = weights.ravel(), []
    for w in first.filters:
        model.filters.append(flat[: w.size].reshape(w.shape).astype(np.float32))
        flat = flat[w.size :]
    k = len(first.shift)
    model.shift, model.out, model.bias = flat[:k].astype(np.float32), flat[k : 2 * k].astype(np.float32), float(flat[2 * k])
    return model


def set_thresholds(rows: DataFrame, model: Model, share: float) -> None:
    """The model's thresholds, from all ``rows`` (text, label, lang) that it did not learn from, as if ``share`` of them had label 1.

    Scores are counted in bins of a 256th of their log odds, so the driver gets some thousand rows a language.
    """
    model.thresholds = {None: 0.5}
    scored = score(rows.withColumn("row", F.struct("label", "lang")), model, "row").select("row.label", "row.lang", "score")
    z = F.log(F.col("score") / (1 - F.col("score")))
    bins = scored.groupBy("lang", F.floor(z * 256).alias("bin")).agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    found = bins.toPandas()
    drawn = found["hits"].sum() / max(found["n"].sum(), 1)
    if not 0 < drawn < 1:
        return
    for lang, mine in [(None, found), *found.groupby("lang")]:
        if lang is not None and min(mine["hits"].sum(), (mine["n"] - mine["hits"]).sum()) < model.s.least_rows:
            continue
        ranked = mine.groupby("bin").agg({"hits": "sum", "n": "sum", "low": "min", "high": "max"}).sort_index(ascending=False)
        hits = ranked["hits"].to_numpy() * (share / drawn)
        model.thresholds[lang] = best_threshold(ranked["low"].to_numpy(), ranked["high"].to_numpy(), hits, hits + (ranked["n"] - ranked["hits"]).to_numpy() * ((1 - share) / (1 - drawn)))


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """A classifier of ``documents`` from all ``labels`` rows that ``learnable`` allows.

    Every such row is read: four fifths of them, by the hash of their ids, are learnt in shards by many tasks, the others set
    the thresholds. The driver gets counts and one model. Scores are set to the share of label 1 among all learnable rows.
    Languages only choose thresholds, never a score; a null language is the empty one. An id with both labels
    counts as label 1. Without rows of both labels every score is that share.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & learnable("id"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    # one in so many of each label's rows is set aside, counted within parts of the ids, so that few rows of a label are not drawn unevenly
    parts = F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(max(1, round(sum(counts.values()) / settings.shard_rows))))
    place = F.row_number().over(Window.partitionBy(parts, "label").orderBy(F.xxhash64("id"), "id"))
    chosen = usable.groupBy("id").agg(F.max("label").alias("label")).withColumn("aside", place % settings.calibration == 0)
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    if documents.schema[id_col].dataType == labels.schema[id_col].dataType:
        texts = texts.filter(learnable("id"))
    # sorted on both sides at any size: what is shuffled grows with the texts
    rows = stored(texts.join(chosen.hint("merge"), "id")) if 0 < share < 1 else None
    n = np.zeros(2)
    for r in rows.filter("not aside").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect() if rows is not None else []:
        n[r["label"]] = r["n"]
    if not n.all():
        model = Model.fresh(settings)
        model.out[:] = 0
        model.bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        model.thresholds = {None: 0.5}
        return model
    learning = rows.filter("not aside")
    seen = seen_buckets(learning, settings)
    model = learnt(learning, start(seen, n, settings), seen, max(1, round(n.sum() / settings.shard_rows)))
    model.bias += float(np.log(share / (1 - share)) - np.log(n[1] / n[0]))
    set_thresholds(rows.filter("aside"), model, share)
    return model


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, score (0 to 1) of each row's whole text, and rejected: score at or over its language's threshold.

    Null and empty texts get the score of no words. Rows stay as they are many; other columns are ignored.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer, limits = Scorer(model), model.thresholds
        for batch in slices(batches):
            scores = scorer.scores(batch.column(1).to_pylist())
            over = [x >= limits.get(lang, limits[None]) for x, lang in zip(scores, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(over, pa.bool_())], names=["id", "score", "rejected"])

    return rows.mapInArrow(scored, f"id {kind}, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_clean(documents: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``documents``, all columns, whose score is under their language's threshold.

    Null and empty texts are scored as no words, a null language is the empty one, as in ``score``; repeated
    rows are judged alike. No shuffle.
    """
    shared, names = documents.sparkSession.sparkContext.broadcast(model), documents.columns
    text_at, lang_at = names.index(text_col), names.index(lang_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer, limits = Scorer(model), model.thresholds
        for batch in slices(batches):
            texts, langs = batch.column(text_at).to_pylist(), batch.column(lang_at).to_pylist()
            stays = [x < limits.get(lang or "", limits[None]) for x, lang in zip(scorer.scores([t or "" for t in texts]), langs, strict=True)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return documents.mapInArrow(kept, documents.schema)
