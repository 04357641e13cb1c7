"""Chroma audio fingerprints: pitch-class frames, filters over their integral image, packed integers, alignment."""

from __future__ import annotations

import io
import math
import struct
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import slices, stored

Decoder = Callable[[object], tuple[np.ndarray, int]]


@dataclass(frozen=True)
class Settings:
    """How a fingerprint is made and matched."""

    rate: int = 4000
    frame: int = 1024
    hop: int = 256
    #: Lowest and highest frequency that counts, in Hz.
    low: float = 100.0
    high: float = 1900.0
    #: Frames that a filter looks at.
    span: int = 16
    #: Filter answers (log ratios) that part the four values of a filter.
    steps: tuple[float, float, float] = (-0.3, 0.0, 0.3)
    #: Integers that make a search key, frames between them, and bands: a key takes one band of each integer's bits,
    #: so that a wrong bit spoils the keys of its band alone.
    picks: int = 5
    stride: int = 4
    bands: int = 4
    #: Keys that must agree on an offset, the largest share of wrong bits over the common frames, and their least
    #: number: over 24 frames unlike melodies differ in a quarter of the bits or more.
    votes: int = 2
    bit_error: float = 0.2
    least_frames: int = 24


#: The integer of frames without any sound: equal energies on both sides of every filter.
SILENCE = np.uint32(0xFFFFFFFF)
#: Share of a new rate up to which tones pass when samples are resampled to it.
PASS = 0.46


def wav(data: object) -> tuple[np.ndarray, int]:
    """Samples (mean of channels, -1 to 1) and rate of a PCM WAV file of 8, 16, 24 or 32 bits.

    Null values and what is no such file have no samples; of a file that breaks off, whole frames count.
    """
    nothing = np.zeros(0, np.float32), 1
    if not data:
        return nothing
    try:
        with wave.open(io.BytesIO(data)) as f:
            raw, channels, width, rate = f.readframes(f.getnframes()), f.getnchannels(), f.getsampwidth(), f.getframerate()
    except (wave.Error, EOFError, struct.error, ValueError, RuntimeError):
        return nothing
    if width not in (1, 2, 3, 4) or channels < 1 or rate < 1:
        return nothing
    raw = np.frombuffer(raw, np.uint8)[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:
        samples = (raw[:, 0].astype(np.float32) - 128) / 128
    else:  # the high bytes of a 32-bit integer
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - width :] = raw
        samples = wide.view("<i4")[:, 0].astype(np.float32) / float(1 << 31)
    return samples.reshape(-1, channels).mean(axis=1), rate


def resampled(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate. What the new rate cannot hold is filtered out first (a windowed sinc), or it would come back as lower tones."""
    if rate == to or not len(samples):
        return samples
    if rate > to:
        half = math.ceil(24 * rate / to)
        at = np.arange(-half, half + 1)
        taps = np.sinc(2 * PASS * to / rate * at) * np.hanning(2 * half + 3)[1:-1]
        samples = np.convolve(samples, (taps / taps.sum()).astype(np.float32))[half : half + len(samples)]
    at = np.arange(int(len(samples) * to / rate)) * (rate / to)
    return np.interp(at, np.arange(len(samples)), samples).astype(np.float32)


class Chroma:
    """Turns samples into packed integers, one for each place where a filter span fits."""

    def __init__(self, s: Settings):
        self.s = s
        freqs = np.fft.rfftfreq(s.frame, 1 / s.rate)
        on = (freqs >= s.low) & (freqs <= s.high)
        pitch = np.zeros(len(freqs), np.int64)
        pitch[on] = np.round(12 * np.log2(freqs[on] / 440.0)).astype(np.int64) % 12
        self.fold = np.zeros((len(freqs), 12), np.float32)
        self.fold[np.flatnonzero(on), pitch[on]] = 1
        self.window = np.hanning(s.frame).astype(np.float32)
        self.filters = self._filters()

    def _filters(self) -> list[tuple[str, int, int, int]]:
        """Sixteen filters by rule: kind, first pitch class, number of them, frames; each gives two bits."""
        kinds = ("time", "pitch", "cross", "middle")
        return [(kinds[i % 4], (5 * i) % 8, 4 + 2 * (i % 3 == 0), self.s.span // (1 + (i // 4) % 2)) for i in range(16)]

    def frames(self, samples: np.ndarray, rate: int) -> np.ndarray:
        """Energy of the twelve pitch classes in each frame, scaled to length 1; silent frames are 0."""
        s = self.s
        samples = resampled(samples, rate, s.rate)
        if len(samples) < s.frame:
            return np.zeros((0, 12), np.float32)
        cut = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), s.frame)[:: s.hop]
        energy = np.abs(np.fft.rfft(cut * self.window, axis=1)) ** 2 @ self.fold
        norm = np.linalg.norm(energy, axis=1, keepdims=True)
        return np.where(norm > 1e-6, energy / np.maximum(norm, 1e-6), 0)

    def integers(self, samples: np.ndarray, rate: int) -> np.ndarray:
        """Unsigned 32-bit integers: the filters' answers over the integral image, two Gray-coded bits each."""
        s, chroma = self.s, self.frames(samples, rate)
        n = len(chroma) - s.span + 1
        if n <= 0:
            return np.zeros(0, np.uint32)
        image = np.zeros((len(chroma) + 1, 13))
        image[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)
        t = np.arange(n)

        def area(a: int, b: int, y: int, z: int) -> np.ndarray:
            return image[t + b, z] - image[t + a, z] - image[t + b, y] + image[t + a, y]

        out = np.zeros(n, np.uint32)
        for kind, y, height, width in self.filters:
            z, m, h = min(y + height, 12), (y + min(y + height, 12)) // 2, width // 2
            if kind == "time":
                a, b = area(0, h, y, z), area(h, width, y, z)
            elif kind == "pitch":
                a, b = area(0, width, y, m), area(0, width, m, z)
            elif kind == "cross":
                a, b = area(0, h, y, m) + area(h, width, m, z), area(0, h, m, z) + area(h, width, y, m)
            else:
                q = width // 4
                a, b = area(q, width - q, y, z), area(0, q, y, z) + area(width - q, width, y, z)
            level = np.searchsorted(s.steps, np.log((np.maximum(a, 0) + 0.01) / (np.maximum(b, 0) + 0.01)), side="right").astype(np.uint32)
            out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
        return out


def search_keys(integers: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places: each joins one band of the bits of ``picks`` integers at equal distances.

    A band that stays the same over these integers gives no key there: silence, a held note or a steady beat would
    meet everywhere under it, and say nothing. Where all bands stay (a held note) there is none.
    """
    n = len(integers) - (s.picks - 1) * s.stride
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = np.stack([integers[i * s.stride : i * s.stride + n] for i in range(s.picks)]).astype(np.uint64)
    width, keys, places = 32 // s.bands, [], []
    for band in range(s.bands):
        bits = (parts >> np.uint64(band * width)) & np.uint64((1 << width) - 1)
        at = np.flatnonzero((bits != bits[0]).any(axis=0))
        key = np.full(len(at), band, np.uint64)
        for p in bits[:, at]:
            key = (key ^ p) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys.append(key)
        places.append(at)
    return np.concatenate(keys).view(np.int64), np.concatenate(places)


def best_run(a: np.ndarray, b: np.ndarray, offset: int, s: Settings) -> tuple[int, int, float, float]:
    """start, frames, bit error and gain of the run of ``a`` that fits ``b`` best, ``b`` being ``offset`` ahead.

    A frame gains what is left to the allowed share of wrong bits, and silence in both gains nothing; the run
    with the greatest sum is it, so its share is within the limit. No gain: no frames.
    """
    first, last = max(0, -offset), min(len(a), len(b) - offset)
    if last <= first:
        return 0, 0, 1.0, 0.0
    x, y = a[first:last], b[first + offset : last + offset]
    wrong = np.bitwise_count(x ^ y).astype(np.int64)
    gain = np.where((x == SILENCE) & (y == SILENCE), 0.0, s.bit_error * 32 - wrong)
    total = np.concatenate([[0.0], gain.cumsum()])
    end = int((total - np.minimum.accumulate(total)).argmax())
    start = int(total[: end + 1].argmin())
    n = end - start
    return first + start, n, float(wrong[start:end].sum()) / (32 * n) if n else 1.0, float(total[end] - total[start])


def fingerprint(df: DataFrame, id_col: str, media_col: str, decode: Decoder = wav, settings: Settings = Settings()) -> DataFrame:
    """``id_col``, n_frames, digest and prints (binary: unsigned 32-bit integers) of each recording.

    ``decode`` turns a value of ``media_col`` into samples and their rate. Null, broken and too short
    recordings have no integers. Rows stay as they are many; other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = rows.schema["id"].dataType.simpleString()

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chroma = Chroma(settings)
        for batch in slices(batches):
            prints = [chroma.integers(*decode(x)).astype("<u4") for x in batch.column(1).to_pylist()]
            blobs = [p.tobytes() for p in prints]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) for p in prints], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(b) for b in blobs]), pa.array(blobs, pa.binary())], names=["id", "n_frames", "digest", "prints"])

    return rows.mapInArrow(printed, f"id {kind}, n_frames bigint, digest string, prints binary").withColumnRenamed("id", id_col)


def _postings(prints: DataFrame, s: Settings) -> DataFrame:
    """class_id, key, place for each place of each key of each class."""
    kind = prints.schema["class_id"].dataType.simpleString()

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys, places = [], [], []
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, p = search_keys(np.frombuffer(blob, "<u4"), s)
                ids += [i] * len(k)
                keys.append(k)
                places.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], names=["class_id", "key", "place"])

    return prints.select("class_id", "prints").mapInArrow(posted, f"class_id {kind}, key bigint, place bigint")


def search(prints: DataFrame, is_query: str, id_col: str, settings: Settings = Settings()) -> DataFrame:
    """One row per recording: ``id_col``, class_id, n_frames, is_query and, for queries, matches.

    Recordings with equal integers are one class, named by its smallest id. For each class with a row where
    the SQL condition ``is_query`` holds, matches lists the other classes that align with it, in order of
    class_id: class_id, offset (frames by which the other is ahead), start and frames (the part of the query
    that aligns), votes (keys on that offset) and bit_error over that part. A query's own class is not
    listed, other rows have null matches, and recordings without integers match nothing. Recordings of
    silence or one held note have no keys: they match by class alone.

    Keys of queries meet equal keys of all classes, at every place; votes are summed by offset before they are
    shuffled, and every offset with enough of them is checked bit by bit for its best run. Of one class the
    run with the greatest gain is listed (the smallest offset of equals). Ids should be unique; rows with a
    null id keep a null class.
    """
    s = settings
    marked = stored(prints.withColumn("is_query", F.expr(f"coalesce({is_query}, false)")))
    classes = marked.filter(F.col(id_col).isNotNull()).groupBy("digest").agg(F.min(id_col).alias("class_id"), F.max("is_query").alias("asks"))
    heads = marked.join(classes, "digest").filter((F.col(id_col) == F.col("class_id")) & (F.col("n_frames") > 0))
    heads = stored(heads.select("class_id", "asks", "prints").dropDuplicates(["class_id"]))
    index = _postings(heads, s)
    asked = _postings(heads.filter("asks"), s).select(F.col("class_id").alias("query_id"), "key", F.col("place").alias("query_place"))
    met = asked.join(index, "key").filter("query_id <> class_id")
    votes = met.groupBy("query_id", "class_id", (F.col("place") - F.col("query_place")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    candidates = votes.filter(F.col("votes") >= s.votes)
    kind = marked.schema[id_col].dataType.simpleString()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = batch.to_pydict()
            runs = [best_run(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), offset, s) for a, b, offset in zip(x["a"], x["b"], x["offset"], strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*runs, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            found = pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=["query_id", "class_id", "offset", "votes", "start", "frames", "bit_error", "gain"])
            yield found.filter(pa.array([n >= s.least_frames for _, n, _, _ in runs], pa.bool_()))

    pairs = candidates.join(heads.select(F.col("class_id").alias("query_id"), F.col("prints").alias("a")), "query_id").join(heads.select("class_id", F.col("prints").alias("b")), "class_id")
    columns = ["offset", "start", "frames", "votes"]
    schema = f"query_id {kind}, class_id {kind}, offset bigint, votes bigint, start bigint, frames bigint, bit_error double, gain double"
    found = pairs.select("query_id", "class_id", "offset", "votes", "a", "b").mapInArrow(compared, schema)
    best = F.max_by(F.struct(*columns, "bit_error"), F.struct("gain", -F.col("offset"))).alias("best")
    found = found.groupBy("query_id", "class_id").agg(best).select("query_id", "class_id", "best.*")
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("class_id", *columns, "bit_error"))).alias("found"))
    rows = marked.join(classes.select(F.col("digest").alias("class_digest"), "class_id"), F.col("digest") == F.col("class_digest"), "left").join(lists, F.col("class_id") == F.col("query_id"), "left")
    none = F.array().cast(lists.schema["found"].dataType)
    own = F.when(F.col(id_col).isNotNull(), F.col("class_id")).alias("class_id")
    return rows.select(id_col, own, "n_frames", "is_query", F.when(F.col("is_query"), F.coalesce("found", none)).alias("matches"))


#: Samples of a note, and steps of a value to the next pitch class, in ``melody``.
NOTE, STEPS = 512, 48


@lru_cache(maxsize=1)
def _notes() -> np.ndarray:
    t = np.arange(NOTE) / Settings.rate
    pitch = 220.0 * 2 ** (np.arange(12) / 12)[:, None]
    return np.vstack([np.sin(2 * np.pi * pitch * t) + 0.3 * np.sin(4 * np.pi * pitch * t), np.zeros(NOTE)]).astype(np.float32)


def melody(values: object) -> tuple[np.ndarray, int]:
    """A recording of a list of numbers: a note for each, its pitch class by the number (null: a pause)."""
    at = [12 if v is None or v != v else int(np.floor(v * STEPS)) % 12 for v in values or ()]
    return _notes()[at].ravel() if at else np.zeros(0, np.float32), Settings.rate
