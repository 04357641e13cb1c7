"""Canonical exact fingerprints: normalised, folded text, a wide hash, bytes compared within equal buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import stored

#: Java's Unicode white space and the C0 separators.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Makes the second half of the wide hash another function of the text than the first.
_SECOND = "second half"
#: Stands for a null id where ids are ordered.
NULL_KEY = -(1 << 63)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, and each run of white space as one space, none at the ends.

    Null is the empty text. Texts beyond ASCII go to the ICU library that Spark carries.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    compose = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    ascii_only = F.octet_length(text) == F.length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(compose(fold(compose(text))))
    return F.trim(F.regexp_replace(folded, _SPACE, " "))


def wide_hash(text: Column) -> Column:
    """128 bits of xxhash as 32 hexadecimal digits."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(digits(F.xxhash64(text)), digits(F.xxhash64(F.lit(_SECOND), text)))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_cols: tuple[str, ...] = ("text",), keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, and for each text column its fingerprint, named ``<column>_fingerprint``.

    Two texts of ``df`` (of any row, any of the columns) have the same fingerprint exactly if their canonical
    texts are the same bytes: it is the wide hash, and where different canonical texts share a hash, all
    but the first of them (in byte order) get their place in that order appended. Null texts are empty,
    repeated rows stay, an id may repeat with different texts; a row without an id gets the hash alone.

    Hashes of all rows are grouped. Only rows with a hash that occurs more than once send their text, and
    of equal texts one copy a task. If ``df`` is hash-partitioned by ``id_col`` (behind a join on it), no row
    moves with its text.
    """
    names = [f"_text{i}" for i in range(len(text_cols))]
    kept = [f"_keep{i}" for i in range(len(keep))]
    texts = df.select(F.col(id_col).alias("_id"), *[F.col(c).alias(n) for c, n in zip(text_cols, names, strict=True)], *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    canon = texts.select("_id", *kept, *[canonical(F.col(n)).alias(n) for n in names])
    hashed = canon.select("_id", *kept, *[wide_hash(F.col(n)).alias(n) for n in names])

    def bytes_of(ids: DataFrame) -> DataFrame:
        """id, canonical text and hash of each text of the rows with these ids."""
        some = texts.select("_id", *names).join(ids, "_id", "left_semi").select("_id", *[canonical(F.col(n)).alias(n) for n in names])
        return some.select("_id", F.explode(F.array(*names)).alias("_canon")).withColumn("_hash", wide_hash(F.col("_canon")))

    # rows that share a hash with another text: half of the hash is enough to find them all
    each = canon.select("_id", F.explode(F.array(*[F.xxhash64(F.col(n)) for n in names])).alias("_half"))
    shared = each.groupBy("_half").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    suspects = bytes_of(each.join(shared.select("_half"), "_half", "left_semi").select("_id").distinct())
    clashing = suspects.select("_hash", "_canon").distinct().groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash")
    # what follows handles rows whose hash stands for different bytes: none, but for forged texts
    clashes = bytes_of(suspects.select("_id", "_hash").join(clashing, "_hash", "left_semi").select("_id").distinct())
    different = clashes.select("_hash", "_canon").distinct()
    places = different.withColumn("_place", F.row_number().over(Window.partitionBy("_hash").orderBy("_canon")) - 1).filter("_place > 0")
    of_id = clashes.join(places, ["_hash", "_canon"]).groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("_hash", "_place"))).alias("_places"))

    marked = hashed.join(of_id, "_id", "left")
    outs = [F.concat_ws("-", F.col(n), F.try_element_at(F.col("_places"), F.col(n)).cast("string")).alias(f"{c}_fingerprint") for c, n in zip(text_cols, names, strict=True)]
    return marked.select(F.col("_id").alias(id_col), *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], *outs)


def exact_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint, class_id (smallest id with that fingerprint) and copies (rows in the class)."""
    marked = fingerprint(df, id_col, (text_col,)).select(F.col(id_col).alias("_id"), F.col(f"{text_col}_fingerprint").alias("fingerprint"))
    classes = marked.groupBy("fingerprint").agg(F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return marked.join(classes, "fingerprint").select(F.col("_id").alias(id_col), "fingerprint", "class_id", "copies")


def neighbours(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and next_id: the next smaller id, for the smallest the largest. Ids are taken once, without nulls.

    Ids are sorted over many tasks; only the first and the last id of each task meet in one.
    """
    key = ids.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct()
    tasks = 4 * ids.sparkSession.sparkContext.defaultParallelism
    sorted_ = key.repartitionByRange(tasks, F.col("_id").desc()).sortWithinPartitions(F.col("_id").desc())
    # the id of a task and the place in it, as one long
    placed = stored(sorted_.select("_id", F.monotonically_increasing_id().alias("_at"))).withColumn("_task", F.shiftright("_at", 33))
    ends = placed.groupBy("_task").agg(F.max("_id").alias("_first"), F.min("_id").alias("_last"))
    chain = Window.orderBy(F.col("_first").desc())
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    across = ends.select("_last", F.coalesce(F.lead("_first").over(chain), F.max("_first").over(whole)).alias("_across"))
    inside = placed.withColumn("_inside", F.lead("_id").over(Window.partitionBy("_task").orderBy("_at")))
    joined = inside.join(across, inside["_id"] == across["_last"], "left")
    return joined.select(F.col("_id").alias(id_col), F.coalesce("_inside", "_across").alias("next_id"))


def edited_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, next_key, text and edited: the last half of each text (in code points, rounded down) gives way to
    the first as many (or all) of the next text, in descending order of ids; after the last comes the first.

    key is ``id_col`` (integers; a null counts as ``NULL_KEY``, the smallest). Null texts are empty. Of rows
    that repeat an id, the smallest text stands for the id as a next text. The result is hash-partitioned by
    key: whole texts move once, and once more their halves.
    """
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_KEY))
    rows = df.select(key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    needs = rows.groupBy("key").agg(F.max(half).alias("_need"))
    chain = stored(neighbours(needs, "key").join(needs, "key").select(F.col("key").alias("_for"), "next_id", "_need"))
    heads = rows.join(chain, rows["key"] == chain["next_id"]).select("_for", "next_id", F.substring("text", F.lit(1), F.col("_need")).alias("_head"))
    heads = heads.groupBy("_for").agg(F.min("next_id").alias("next_key"), F.min("_head").alias("_head"))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("_head", F.lit(1), half))
    return rows.join(heads, rows["key"] == heads["_for"]).select("key", "next_key", "text", edited.alias("edited"))
