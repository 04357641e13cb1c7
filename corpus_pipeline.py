"""Corpus pipeline: toxic documents go, boilerplate lines go, one document of each near-duplicate group stays, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import line_dedup, near_dedup, packing, toxicity
from shelfspark.llm.common import fresh, stored, table

#: Share of a source's documents from which a line is boilerplate. At sf0.1 (500 documents a source) repeated lines
#: stand in up to 66 documents, so a fifth finds none and this share finds those in 3 or more.
LINE_RATIO = 0.005

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, fitted on the labelled ones among ``docs``, scores under their language's threshold."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ``LINE_RATIO`` of their source's documents have, three at least; n_chars follows.

    Lines that a fifth have go everywhere, and emptied documents stay. Rarer ones go only where at least half
    of the text is left: copies of one document repeat all of their lines, and the next stage keeps one of them.
    """
    few, often, n_dropped = fresh(docs, "_few", "_often", "n_dropped")
    common = line_dedup.drop_boilerplate(docs, "source", "text").withColumnRenamed(n_dropped, often)
    common = stored(common.select(*docs.columns, often)).withColumn(few, F.col("text"))  # the text is written once
    left = line_dedup.drop_boilerplate(common, "source", "text", LINE_RATIO)
    keeps = F.col(n_dropped).eqNullSafe(0) | (F.length("text") * 2 < F.length(few))
    dropped = F.col(often) + F.when(keeps, 0).otherwise(F.col(n_dropped))
    left = left.withColumns({n_dropped: dropped, "text": F.when(keeps, F.col(few)).otherwise(F.col("text"))})
    n_chars = F.when(F.col(n_dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, with their ids, in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("near_dedup", drop_near_duplicates), ("packing", pack)]

#: A trained classifier and a tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
