import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shelfspark.llm import line_dedup, near_dedup, toxicity
from shelfspark.llm.common import stored


def stages(spark, folder):
    """documents, and what each stage makes of its predecessor's rows."""
    seen = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], folder)))
    return seen


@pytest.fixture(scope="module")
def small(spark, data):
    return [df.collect() for df in stages(spark, data)]


def test_toxicity_stage_scores_every_text(spark, data, small):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    scorer, limits = toxicity.Scorer(model), model.thresholds
    kept = [r for r in small[0] if scorer.score(r.text or "") < limits.get(r.lang, limits[None])]
    assert sorted(kept, key=repr) == sorted(small[1], key=repr)


def test_line_stage_equals_brute_force(small):
    plain = lambda line: re.sub("[ \t\r\f\xa0]+", " ", line).strip(" ")
    pages, found = Counter(r.source for r in small[1]), Counter()
    for r in small[1]:
        found.update({(r.source, plain(line)) for line in (r.text or "").split("\n") if plain(line)})
    drop = {(s, line) for (s, line), n in found.items() if n >= line_dedup.LEAST_PAGES and n >= pages[s] * line_dedup.RATIO}
    want = {r.doc_id: "\n".join(line for line in (r.text or "").split("\n") if (r.source, plain(line)) not in drop) for r in small[1]}
    assert drop and {r.doc_id: r.text for r in small[2]} == want
    assert all(r.n_chars == len(r.text) for r in small[2] if r.text != next(x.text for x in small[1] if x.doc_id == r.doc_id))


def without_frequent(rows, ratio):
    """(text, dropped lines) of each (source, text) without the lines that a share of the source's rows has, three at least."""
    plain = lambda line: re.sub("[ \t\r\f\xa0]+", " ", line).strip(" ")
    pages, found = Counter(s for s, _ in rows), Counter()
    for s, text in rows:
        found.update({(s, plain(line)) for line in text.split("\n") if plain(line)})
    drop = {k for k, n in found.items() if n >= line_dedup.LEAST_PAGES and n >= pages[k[0]] * ratio}
    kept = [[line for line in text.split("\n") if (s, plain(line)) not in drop] for s, text in rows]
    return [("\n".join(k), text.count("\n") + 1 - len(k)) for k, (_, text) in zip(kept, rows, strict=True)]


def test_both_shares_of_the_line_stage_equal_brute_force(spark):
    """At sf0.01, where lines of 0.005 of a source go as well, and texts that would lose half keep theirs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    often = without_frequent([(r.source, r.text or "") for r in rows], line_dedup.RATIO)
    rare = without_frequent([(r.source, text) for r, (text, _) in zip(rows, often, strict=True)], corpus_pipeline.LINE_RATIO)
    want, halves = {}, 0
    for r, (text, n), (less, m) in zip(rows, often, rare, strict=True):
        keeps = not m or len(less) * 2 < len(text)
        halves += bool(m and keeps)
        want[r.doc_id] = (text if keeps else less, r.n_chars if not n + (0 if keeps else m) else len(text if keeps else less))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert got == want and halves and sum(m for _, m in rare) > 3 * sum(n for _, n in often) > 0


def test_stages_take_odd_rows(spark, data):
    """Nulls in every column, empty texts, repeated rows and columns with the names of helpers: every stage runs and keeps its contract."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (5001, None, "en", "s", 0), (5002, "", None, None, 0), (5003, "one word", "en", "s", 8), (5003, "one word", "en", "s", 8)], docs.schema)
    rows = docs.unionByName(odd).selectExpr("*", "1 AS n_lines", "'x' AS label", "2 AS _hits", "doc_id AS text_id")
    seen = [rows]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], data)))
        assert name == "packing" or seen[-1].columns == rows.columns, name
    counts = [df.count() for df in seen]
    assert counts[0] >= counts[1] == counts[2] >= counts[3] > 0
    clean, kept = ({r.doc_id for r in df.select("doc_id").collect()} for df in (seen[1], seen[3]))
    assert kept <= clean and (None in kept) == (None in clean) and (5003 in kept) == (5003 in clean)
    assert len(kept & {5001, 5002}) == min(1, len(clean & {5001, 5002})) and {r.doc_id for r in seen[4].select("doc_id").distinct().collect()} == kept


def test_near_duplicate_stage_equals_brute_force(small):
    rows = sorted(small[2], key=lambda r: r.doc_id)
    words = [near_dedup.words_of(r.text or "") for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (words[i] == words[j] or (words[i] and words[j] and near_dedup.similar(words[i], words[j], near_dedup.SIMILARITY))):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert len(set(label)) < len(rows)
    assert sorted(r.doc_id for r in small[3]) == [rows[i].doc_id for i in sorted(set(label))]
    assert {r.doc_id: r for r in small[3]} == {rows[i].doc_id: rows[i] for i in set(label)}


def test_packing_stage_holds_every_id_once(small):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in small[3]}
    filled, reached = Counter(), Counter()
    for r in sorted(small[4], key=lambda r: (r.doc_id, r.start)):
        assert r.start == reached[r.doc_id] and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        reached[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert reached == {i: len(x) for i, x in ids.items()} and max(filled.values()) <= 4096


def test_pipeline_holds_the_packed_ids(small):
    assert small[4] and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in small[4])


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    seen = stages(spark, folder)
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    assert ids[0] >= ids[1] == ids[2] >= ids[3] == ids[4]
    assert all(df.columns == seen[0].columns for df in seen[:4])
    gone = ids[0] - ids[1]
    assert sum(labels.get(i) == 1 for i in gone) > 0.85 * sum(v == 1 for v in labels.values())
    assert sum(labels.get(i) == 0 for i in gone) < 0.03 * len(labels)


def test_rare_lines_go_and_copies_stay_whole(spark):
    """300 documents a source: a line in 6 of them goes; ten copies of one document keep their lines for the next stage."""
    own = lambda i: f"own text of number {i}, " * 5
    texts = [f"{own(i)}\nLicensed under X." if i < 6 else own(i) for i in range(300)] + ["one whole text\nof two lines"] * 10
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert all(got[i].text == (own(i) if i < 300 else texts[i]) and got[i].n_chars == len(got[i].text) for i in range(310))


def test_lines_are_dropped_at_a_larger_size(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = corpus_pipeline.drop_boilerplate(spark, docs, folder).withColumnRenamed("text", "rest")
    changed = docs.join(left.select("doc_id", "rest"), "doc_id").filter("rest <> text")
    licenses = lambda c: changed.filter(f"{c} like '%GNU General Public License%'").count()
    assert left.count() == docs.count() and changed.count() > 1000 and licenses("text") > 2 * licenses("rest")


def test_no_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data))
        assert docs.count() == 0
