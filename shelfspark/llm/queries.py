"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import audio, byte_bpe, conversation_trie, filter_audit, fingerprints, line_dedup, near_dedup, packing, preferences, token_counts, token_shards, toxicity, vector_search
from shelfspark.llm.common import scratch, stored, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~toxicity.learnable("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "rejected")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = fingerprints.edited_texts(table(spark, sf_dir, "documents"))
    edited = edited.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})
    marked = stored(fingerprints.fingerprint(edited, "key", ("text", "edited"), keep=("next_key", "n_chars", "edited_sha256")))
    following = marked.groupBy(F.col("key").alias("next_key")).agg(F.min("text_fingerprint").alias("next_fingerprint"))
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return marked.join(following, "next_key").select(
        F.when(F.col("key") != fingerprints.NULL_KEY, F.col("key")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.col("text_fingerprint").alias("fingerprint"),
        F.col("edited_fingerprint").alias("edited_fingerprint"),
        like("text_fingerprint", "edited_fingerprint").alias("near_edited"),
        like("text_fingerprint", "next_fingerprint").alias("near_next"),
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made of the vectors: a note for each number. A vector with the label of the first of its
    fifty ids quotes half of that one's recording at its end. Each fiftieth recording is searched in all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("notes"))
    first = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("block"), F.col("label").alias("block_label"), F.slice("notes", 17, 32).alias("quote"))
    joined = vectors.join(first, (F.col("vec_id") - F.pmod("vec_id", F.lit(50))) == F.col("block"), "left")
    quotes = F.when((F.col("label") == F.col("block_label")) & (F.col("vec_id") != F.col("block")), F.col("quote")).otherwise(F.array().cast("array<double>"))
    prints = audio.fingerprint(joined.select("vec_id", F.concat("notes", quotes).alias("recording")), "vec_id", "recording", decode=audio.melody)
    return audio.search(prints, "vec_id % 50 = 0", "vec_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern)
    back = byte_bpe.decode(ids, path, pattern, keep=("ids",))
    return back.select("doc_id", byte_bpe.id_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.html_text(F.col("html")).alias("text"))
    # lines are counted and dropped in two passes; the text is made from the pages once
    return line_dedup.drop_boilerplate(stored(pages), "host", "text").select("page_id", "host", "n_lines", "n_dropped", "text")


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_preferences(preferences.swapped(preferences.conversations(table(spark, sf_dir, "conversations"))))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    token_shards.write_shards(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_shards.read_shards(spark, out)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprints": op3_fingerprints,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_audio_fingerprints": op5_audio_fingerprints,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_preferences": op8_preferences,
    "op9_token_shards": op9_token_shards,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_search": op12_vector_search,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES: dict[str, str] = {
    "op7_line_dedup": line_dedup.pages_sql(),
    "op8_preferences": preferences.swapped_sql(),
    "op11_filter_audit": filter_audit.SQL,
    "op12_vector_search": vector_search.search_sql(),
    "op13_conversation_trie": conversation_trie.SQL,
}
