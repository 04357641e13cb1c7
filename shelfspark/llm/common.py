"""What the training-data operators share: table access, shared scratch, whitespace-safe segments."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Entries that a worker's memo of encoded words may hold before it starts anew (bounds memory, not work).
MEMO_ENTRIES = 400_000
#: Texts that are turned into Python strings at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder that ``spark.checkpoint.dir`` names.

    Only where that setting is absent (tests on one machine) a local folder is set as checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        base = held or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        if not held:
            spark.sparkContext.setCheckpointDir(base)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/shelfspark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after them as far as ``df`` has such columns already."""
    taken, found = {n.lower() for n in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small pieces, so that few texts are Python strings at one time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Two white-space characters in a row, white space at an end, or a control character on which regex engines differ.
_ODD_SPACE = re.compile(r"\s\s|^\s|\s$|[\x1c-\x1f\x85\u180e\u200b\ufeff]")
_ODD_CONTROL = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]")


def space_segments(text: str) -> list[str] | None:
    """The parts between single spaces, or None if cutting there could change a GPT-style split.

    Each part after the first is meant with the space before it: in such a text a space only ever
    belongs to the piece that follows it, so parts can be encoded by themselves.
    """
    return None if not text or _ODD_SPACE.search(text) else text.split(" ")


#: Anything but Latin letters, digits, plain punctuation and white space on which engines agree.
_NOT_LATIN = re.compile("[^\t-\r -~\xa0-\u012f\u0132-\u017f]")
_TOUCHING = re.compile(r"[^\w\s]{2}|_")
_LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\u012f\u0132-\u017f]+")
#: The same for texts of one byte a character: bytes that ``_NOT_LATIN`` lets pass, and each byte as a sign, ``_`` or a letter.
_LATIN_BYTES = bytes(c for c in range(256) if not _NOT_LATIN.match(chr(c)))
_SIGN_BYTES = bytes(ord("_" if chr(c) == "_" else "." if re.match(r"[^\w\s]", chr(c)) else "a") for c in range(256))


def _one_byte(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def _touching(text: str) -> bool:
    """Whether two signs stand side by side, or an underscore anywhere."""
    if (flat := _one_byte(text)) is None:
        return _TOUCHING.search(text) is not None
    kinds = flat.translate(_SIGN_BYTES)
    return b".." in kinds or b"_" in kinds


def word_segments(text: str, special: Iterable[str] = ()) -> list[str] | None:
    """Parts of a text that a lower-casing tokenizer without white space can encode by themselves.

    Latin texts are put in lower case, and full stops and commas that touch no other sign stand alone, so
    that fewer parts differ. None if the text holds a control character on which engines differ, or if
    lower case makes one of the ``special`` tokens, which a tokenizer looks for in the raw text.
    """
    flat = _one_byte(text)
    if _NOT_LATIN.search(text) if flat is None else flat.translate(None, _LATIN_BYTES):
        return None if _ODD_CONTROL.search(text) else text.split()
    raw, text = text, text.lower()
    if any(text.count(token) != raw.count(token) for token in special):
        return None
    if not _touching(text):
        text = text.replace(".", " . ").replace(",", " , ")
    return text.split()


def plain_word(part: str) -> bool:
    """Whether a part is one run of lower-case Latin letters, which every normaliser leaves as it is."""
    if part.isascii():
        return part.isalpha() and part.islower()
    return _LETTERS.fullmatch(part) is not None and part.lower() == part
