import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import audio, fingerprints, line_dedup, near_dedup, preferences, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, label int"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", len(t or ""), "k", 1) for i, t in enumerate(texts)], SCHEMA)


def canon(text):
    fold = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(fold.split())


TEXTS = ["Straße  ONE", "STRASSE one", "café", "CAFÉ", "ﬁne", "fine", "", None, " ", "x" * 5000, "漢字", "a", "A ", "same", "same"]


def test_canonical_texts(spark):
    got = frame(spark, TEXTS).select("text", fingerprints.canonical(F.col("text")).alias("c")).collect()
    assert [r.c for r in got] == [canon(r.text) for r in got]


def test_fingerprints_follow_canonical_texts(spark):
    rows = fingerprints.fingerprint(frame(spark, TEXTS), keep=("key",)).collect()
    by = {r.doc_id: r.text_fingerprint for r in rows}
    assert len(rows) == len(TEXTS)
    for i, a in enumerate(TEXTS):
        for j, b in enumerate(TEXTS):
            assert (by[i] == by[j]) == (canon(a) == canon(b))
    assert {r.doc_id: r.class_id for r in fingerprints.exact_classes(frame(spark, TEXTS)).collect()}[14] == 13
    assert fingerprints.fingerprint(frame(spark, [])).count() == 0


def test_bytes_decide_where_hashes_are_equal(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda t: F.length(t).cast("string"))
    real = F.xxhash64
    monkeypatch.setattr(fingerprints.F, "xxhash64", lambda *c: F.length(c[-1]).cast("long"))
    got = {r.doc_id: r.text_fingerprint for r in fingerprints.fingerprint(frame(spark, ["ab", "AB ", "cd", "e", "ef"])).collect()}
    monkeypatch.setattr(fingerprints.F, "xxhash64", real)
    assert got[0] == got[1] and len(set(got.values())) == 4


def test_edited_texts(spark):
    ids = [5, 1, 90, 33, None]
    texts = ["abcdefg", "12", None, "😀é漢字", "zz"]
    order = sorted(((i if i is not None else fingerprints.NULL_KEY), t or "") for i, t in zip(ids, texts, strict=True))[::-1]
    got = {r.key: (r.next_key, r.edited) for r in fingerprints.edited_texts(frame(spark, texts, ids)).collect()}
    for n, (key, text) in enumerate(order):
        following = order[(n + 1) % len(order)]
        half = len(text) // 2
        assert got[key] == (following[0], text[: len(text) - half] + following[1][:half])


def slow_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_banded_alignment_is_exact():
    rng = random.Random(0)
    for _ in range(1500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        b = list(a) if rng.random() < 0.7 else [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 5)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.choice("abcd"))
        for k in range(7):
            assert near_dedup.distance_within(a, b, k) == (slow_distance(a, b) <= k)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(60, 200))]
        if rng.random() < 0.4:
            base[10:10] = passage
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, len(copy) // 40)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [None, "", "!!!", "one", "one", "Two Words", "two, words."]
    words = [near_dedup.words_of(t or "") for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if words[i] == words[j] or (words[i] and words[j] and near_dedup.similar(words[i], words[j], 0.8)):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    df = frame(spark, texts)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == label
    kept = near_dedup.keep_one(df.unionByName(df.limit(3)).unionByName(frame(spark, ["no id"], [None])))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(label)) and kept.columns == df.columns
    assert kept.filter("doc_id is null").count() == 1
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_frequent_word_pair_is_few_rows(spark):
    """Texts of a task stand together under a word pair: 600 texts with one passage, three rows of texts a pair and task."""
    passage = " ".join(f"common{k}" for k in range(30))
    df = spark.createDataFrame([(i, i, f"own{i} {passage}") for i in range(600)], "id long, label long, text string").coalesce(1)
    got = near_dedup._rare_pairs(df, near_dedup._word_pairs, lambda tokens: np.arange(len(tokens)) % 2 == 1).collect()
    assert len(got) == 15 * 3 and {len(r.id) for r in got} == {256, 88}
    for r in got:
        assert len(set(r.id)) == len(r.id) and r.id == r.label and set(r.n_words) == {31} and len(set(r.at)) == 1
        assert set(r.before_2) == {0} if r.at[0] == 1 else len(set(r.before_1)) == 1


def test_last_pass_links_texts_of_two_blocks(spark, monkeypatch):
    """Blocks of two texts and rows of one: each pair of texts of two labels still meets."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 2)
    passage = " ".join(f"common{k}" for k in range(30))
    texts = spark.createDataFrame([(i, f"{passage} own{i}") for i in range(9)], "id long, text string").repartition(9)
    entries = texts.select("id", F.lit(1).alias("key"), F.col("id").alias("label"))
    got = {(r.id, r.other) for r in near_dedup._rest(entries, texts, 0.8).collect()}
    assert {tuple(sorted(x)) for x in got} == {(i, j) for i in range(9) for j in range(i + 1, 9)}



def test_last_pass_hands_on_members_and_not_their_pairs(spark, monkeypatch):
    """Texts that share three quarters of their words meet all, but few align: what is handed on grows with texts, not with pairs."""
    rng = random.Random(6)
    passage, own = " ".join(f"common{k}" for k in range(60)), lambda i: " ".join(f"own{i}x{rng.randrange(10**6)}" for _ in range(20))
    texts = [f"{passage} {own(i)}" for i in range(80)]
    texts += [f"{texts[i]} more" for i in range(3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    entries = rows.select("id", F.lit(1).alias("key"), F.col("id").alias("label"))
    handed_on, aligned = [], near_dedup._aligned
    monkeypatch.setattr(near_dedup, "_aligned", lambda found, *more: handed_on.append(found.count()) or aligned(found, *more))
    got = {(r.id, r.other) for r in near_dedup._rest(entries, rows, 0.8).collect()}
    assert got == {(i, 80 + i) for i in range(3)} and handed_on[0] <= 4 * len(texts)


def test_pairs_that_meet_only_beside_a_large_class(spark, monkeypatch):
    """One passage as all sketches: every text is in the same buckets, most are of one class, and heads are drawn from it."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7, raising=False)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    large, pairs = [word() for _ in range(60)], [[word() for _ in range(60)] for _ in range(5)]
    texts = [" ".join([*large[:i], word(), *large[i + 1 :]]) for i in range(60)] + [" ".join([*p, *more]) for p in pairs for more in ([], [word()])]
    whole = near_dedup.sketches
    monkeypatch.setattr(near_dedup, "sketches", lambda *a: whole(*a).withColumn("keys", F.array(F.lit(1).cast("long"))))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: 0 if i < 60 else i - i % 2 for i in range(70)}


@pytest.mark.parametrize("spread", ["random", "even"])
def test_recall_of_candidates_down_to_the_least_similarity(spread):
    """Substitutions at random places and at every 5th to 10th: the share of pairs of 0.8 or more that meet in a bucket."""
    rng, maker = random.Random(5), near_dedup.Sketcher()
    for n in (30, 60, 100, 150, 400, 800):
        for every in (5, 6, 7, 10):
            met = 0
            for _ in range(150):
                a = [f"w{rng.randrange(5000)}" for _ in range(n)]
                b = list(a)
                for i in rng.sample(range(n), n // every) if spread == "random" else range(rng.randrange(every), n, every)[: n // every]:
                    b[i] = f"new{rng.randrange(5000)}"
                assert near_dedup.similar(a, b, 0.8)
                met += bool(set(maker.keys(a).tolist()) & set(maker.keys(b).tolist()))
            assert met >= (0.9 if every == 5 else 0.95) * 150, (n, every, met)


def test_last_pass_pairs_all_that_may_align(spark, monkeypatch):
    """Against every pair of one bucket, by the same bounds, over lengths of many bands."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 5)
    rng = random.Random(8)
    texts = []
    for i in range(60):
        words = [rng.choice("abcdefghij") for _ in range(rng.choice((1, 2, 3, 4, 5, 8, 10, 20, 25, 31, 32, 40)))]
        if i >= 3 and rng.random() < 0.6:
            words = texts[i - 3].split()
            words += ["z"] * (len(words) // rng.choice((4, 5, 8)))
        texts.append(" ".join(words))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    entries = spark.createDataFrame([(i, k, i // 3) for i in range(60) for k in (1, 2 + i % 2)], "id long, key long, label long")
    got = {(r.id, r.other) for r in near_dedup._rest(entries, rows, 0.8).collect()}
    words = [near_dedup.words_of(t) for t in texts]
    want = {(i, j) for j in range(60) for i in range(j) if i // 3 != j // 3 and near_dedup.similar(words[i], words[j], 0.8)}
    assert want and want <= got and len(got) < 60 * 59 / 4


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 150), (150, 199)]
    got = {r.id: r.label for r in near_dedup.components(spark.createDataFrame(chain, "id long, other long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 150: 150, 199: 150, 200: 150}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    hits = np.mean([(r.score >= 0.3) == bool(r.toxic) for r in rows])
    good, bad = [r.score for r in rows if not r.toxic], [r.score for r in rows if r.toxic]
    assert hits > 0.9 and np.mean([[g < b for g in good] for b in bad]) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [None, "", "word " * 5000, "漢字"])
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == 4 and toxicity.keep_clean(docs, model).columns == docs.columns
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [f"{'bad' if i % 2 else 'fine'} text {i}" for i in range(40)] + [None])
    model = toxicity.fit(docs, labels, toxicity.Settings(epochs=20, least_rows=2))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([scores[i] for i in range(1, 40, 2)]) > 0.6 > 0.4 > np.mean([scores[i] for i in range(0, 40, 2)])


def test_null_language_is_the_empty_one(spark):
    docs = spark.createDataFrame([(0, "some text", None), (1, "some text", "")], "doc_id long, text string, lang string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for own in (0.0, 2.0):
        model.thresholds = {None: 2.0 - own, "": own}
        rejected = {r.doc_id: r.rejected for r in toxicity.score(docs, model).collect()}
        assert rejected == {0: own == 0.0, 1: own == 0.0} and toxicity.keep_clean(docs, model).count() == (0 if own == 0.0 else 2)


def test_convolution_and_its_gradient():
    """Pooled answers against loops over windows, and one step against the slope of the loss."""
    s = toxicity.Settings(buckets=64, size=4, filters=3, row_rate=1e-3)
    rng, model = np.random.default_rng(2), toxicity.Model.fresh(s)
    vectors = rng.normal(0, 1, (9, 4)).astype(np.float32)
    pooled, places = model.pooled(vectors)
    for k, w in enumerate(s.widths):
        for f in range(s.filters):
            answers = [sum(float(vectors[t + i] @ model.filters[k][i][:, f]) for i in range(w)) for t in range(9 - w + 1)]
            assert abs(pooled[k * 3 + f] - max(0.0, *answers)) < 1e-4 and (max(answers) <= 0 or places[k * 3 + f] == int(np.argmax(answers)))

    class Slopes:
        def step(self, name, weights, grad):
            self.__dict__.setdefault("found", {})[name] = grad

    model.table[:-1] = rng.normal(0, 1, (64, 4))
    features, batch, labels = np.arange(5)[:, None], [np.array([0, 1, 2, 1, 3]), np.array([4, 2])], np.array([1.0, 0.0])
    loss = lambda: -np.mean([np.log(p if y else 1 - p) for d, y in zip(batch, labels) for p in [float(model.score(model.pooled(model.table[features[d]].sum(axis=1))[0]))]])
    slopes, table = Slopes(), model.table.copy()
    toxicity._step(model, batch, labels, features, slopes, np.full(65, 1e-2, np.float32), np.zeros(1, np.float32))
    model.table[:] = table
    for k, weights in enumerate(model.filters):
        for at in [(0, 0, 0), (0, 2, 1), (len(weights) - 1, 3, 2)]:
            kept = weights[at]
            weights[at] = kept + 1e-2
            high = loss()
            weights[at] = kept - 1e-2
            low = loss()
            weights[at] = kept
            assert abs((high - low) / 2e-2 - slopes.found[k][at]) < 2e-2


def test_line_dedup(spark):
    pages = [("a.org", f"Menu\nbody {i}\n\n  Foot  ") for i in range(8)] + [("a.org", "Foot\nfoot\nbody 1"), ("b.org", "Menu\nFoot"), (None, None), (None, "Menu"), ("c.org", "")]
    df = spark.createDataFrame([(i, h, t, "x", 1) for i, (h, t) in enumerate(pages)], "page_id long, host string, text string, _drop string, pages int").withColumnRenamed("_drop", "drop")
    got = {r.page_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_boilerplate(df, "host", "text").collect()}
    assert got[0] == ("body 0\n", 3, 2) and got[8] == ("foot\nbody 1", 3, 1) and got[9] == ("Menu\nFoot", 2, 0) and got[10] == ("", 0, 0) and got[12] == ("", 0, 0)
    assert line_dedup.drop_boilerplate(df.limit(0), "host", "text").count() == 0


def test_clashing_names(spark):
    names = "_host _drop _left _head _nth host label".split()
    df = spark.createDataFrame([(i, f"Menu\nbody {i} text", "s", *names) for i in range(6)], f"doc_id long, text string, source string, {', '.join(f'{n} string' for n in names)}")
    rows = line_dedup.drop_boilerplate(df, "source", "text").orderBy("doc_id").collect()
    assert [r.text for r in rows] == [f"body {i} text" for i in range(6)] and all([r[n] for n in names] == names for r in rows)
    kept = near_dedup.keep_one(df.unionByName(df))
    assert kept.columns == df.columns and sorted(kept.collect()) == sorted(df.collect())


def test_line_counts_never_overwrite_columns(spark):
    df = spark.createDataFrame([(i, "h", f"Menu\n{i}", 77, "d") for i in range(4)], "page_id long, host string, text string, n_lines long, N_DROPPED string")
    row = line_dedup.drop_boilerplate(df, "host", "text").first()
    assert row.n_lines == 77 and row.N_DROPPED == "d" and row["n_lines_"] == 2 and row["n_dropped_"] == 1


def slow_html_text(html):
    """An extractor of its own: signs one by one, no pattern of the operator."""
    def element(text, start, name):
        low = text.lower()
        rest = low[start + 1 :]
        if name == "!--":
            end = low.find("-->", start + 4) if rest.startswith("!--") else -1
            return end + 3 if end >= 0 else 0
        if not rest.startswith(name):
            return 0
        at, gap = start + 1 + len(name), low[start + 1 + len(name) : start + 2 + len(name)]
        if name == "head" and gap not in (">", " ", "\t", "\r", "\n"):
            return 0
        opened = low.find(">", at)
        closed = low.find(f"</{name}>", opened + 1) if opened >= 0 else -1
        return closed + len(name) + 3 if closed >= 0 else 0

    out, at = [], 0
    while at < len(html):
        end = max((element(html, at, name) for name in ("!--", "head", "script", "style")), default=0) if html[at] == "<" else 0
        if not end:
            out.append(html[at])
        at = end or at + 1
    blocks = set("p br div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 article nav footer header section main aside table tr td th form pre blockquote body html".split())
    html, out, at = "".join(out), [], 0
    while at < len(html):
        end = html.find(">", at) if html[at] == "<" else -1
        inside = html[at + 1 : end].removeprefix("/").lower() if end >= 0 else ""
        name = next((inside[:k] for k, c in enumerate(inside + " ") if c in " \t\r\n/"), "")
        out.append("\n" if end >= 0 and name in blocks else html[at])
        at = end + 1 if end >= 0 and name in blocks else at + 1
    html, text, at = "".join(out), "", 0
    while at < len(html):
        end = html.find(">", at) if html[at] == "<" else -1
        text += "" if end >= 0 else html[at]
        at = end + 1 if end >= 0 else at + 1
    for name, sign in {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "copy": "©", "middot": "·", "amp": "&"}.items():
        text = text.replace(f"&{name};", sign)
    lines = [" ".join(w for w in line.replace("\xa0", " ").replace("\t", " ").replace("\r", " ").replace("\f", " ").split(" ") if w) for line in text.split("\n")]
    return "\n".join(line for line in lines if line)


def test_html_text_equals_a_slow_extractor(spark, data):
    rng = random.Random(6)
    parts = [" ", "\t", "\n", "\r", "\xa0", "a", "b", "é", "&amp;", "&lt;", "&copy;", "&nbsp;", "<p>", "</P >", "<br/>", "<b>", "<", "!--", "-->", "<!--", "<script>", "</script>", "<head>", "</HEAD>", "<header>", "<head x>", "<style a>", "</style>", "-", ">"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    pages += [r.html or "" for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, html string").select("i", line_dedup.html_text(F.col("html")).alias("text"))
    assert {r.i: r.text for r in got.collect()} == {i: slow_html_text(p) for i, p in enumerate(pages)}


def test_lines_equal_a_slow_count(spark):
    rng = random.Random(7)
    line = lambda: "".join(rng.choice([" ", "\t", "\xa0", "a", "b"]) for _ in range(rng.randint(0, 4)))
    rows = [(i, f"h{i % 3}", "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(200)]
    tidy = lambda x: " ".join(w for w in x.replace("\t", " ").replace("\xa0", " ").split(" ") if w)
    pages, found = {}, {}
    for _, h, t in rows:
        pages[h] = pages.get(h, 0) + 1
        for x in {tidy(x) for x in t.split("\n")} - {""}:
            found[h, x] = found.get((h, x), 0) + 1
    drop = {k for k, n in found.items() if n >= 3 and n >= pages[k[0]] * 0.1}
    want = {i: "\n".join(x for x in t.split("\n") if (h, tidy(x)) not in drop) for i, h, t in rows}
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "id long, h string, text string"), "h", "text", 0.1).collect()
    assert drop and {r.id: r.text for r in got} == want and all(r.n_lines == sum(bool(tidy(x)) for x in rows[r.id][2].split("\n")) for r in got)


def test_large_boilerplate_is_joined_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, "h", f"Menu\n{i}") for i in range(9)], "page_id long, host string, text string")
    small = line_dedup.drop_boilerplate(df, "host", "text").orderBy("page_id").collect()
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert line_dedup.drop_boilerplate(df, "host", "text").orderBy("page_id").collect() == small and small[0].n_dropped == 1


def test_html(spark):
    html = "<html><head><title>t</title></head><body><script>var t='</p>';</script><nav><ul><li>One</li></ul></nav><!-- x --><p>A &amp; B<br>next</p></body></html>"
    row = spark.createDataFrame([(html, "https://www.Ex.org:80/a")], "html string, url string").select(line_dedup.html_text(F.col("html")), line_dedup.host_of(F.col("url"))).first()
    assert tuple(row) == ("One\nA & B\nnext", "ex.org")


def test_preferences(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "yes"), (1, 0, "user", "r"), (1, 1, "assistant", "no"), (1, 2, "user", "bye"), (2, 0, "user", None), (6, None, None, "x"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, chosen string")
    got = {r.conv_id: r for r in preferences.format_preferences(preferences.swapped(preferences.conversations(df))).collect()}
    assert set(got) == {0, 1, 2, 6}
    assert got[0].prompt == "<|im_start|>user\nq<|im_end|>\n" and got[0].chosen.endswith("yes<|im_end|>\n") and got[0].rejected.endswith("no<|im_end|>\n") and got[0].chosen_mask == "22x0 14x1"
    assert got[1].rejected == "<|im_start|>assistant\nyes<|im_end|>\n" and got[1].chosen_mask == "22x0 13x1 17x0 14x0"
    assert got[2].n_prompt_turns == 1 and got[2].chosen == got[2].rejected == ""
    assert preferences.format_preferences(preferences.swapped(preferences.conversations(df.limit(0)))).count() == 0


def test_audio(spark):
    rng = np.random.default_rng(1)
    notes = [rng.normal(0, 0.2, 64).tolist() for _ in range(6)]
    rows = [(0, notes[0]), (1, notes[1]), (2, notes[2] + notes[0][10:50]), (3, notes[0]), (4, None), (5, [0.1]), (6, notes[0][20:] + notes[3]), (None, notes[4])]
    df = spark.createDataFrame([(i, n, "d") for i, n in rows], "rec long, notes array<double>, digest string")
    prints = audio.fingerprint(df, "rec", "notes", decode=audio.melody)
    got = {r.rec: r for r in audio.search(prints, "rec = 0", "rec").collect()}
    assert got[3].class_id == 0 and got[None].class_id is None and got[4].n_frames == 0 and got[1].matches is None
    found = {m.class_id: m for m in got[0].matches}
    assert set(found) == {2, 6} and found[2].offset == 2 * (64 - 10) and found[6].offset == -40 and all(m.bit_error < 0.05 for m in found.values())
    assert audio.search(audio.fingerprint(df.limit(0), "rec", "notes", decode=audio.melody), "rec = 0", "rec").count() == 0


def test_audio_search_equals_all_offsets(spark):
    """Noise, shifts that are no whole hop, repeats, silence and a held note, against every offset of every pair."""
    s, rng = audio.Settings(), np.random.default_rng(9)
    notes = [rng.normal(0, 0.2, 40).tolist() for _ in range(8)]
    rows = {i: (n, 0, 0.0) for i, n in enumerate(notes)}
    rows |= {10: (notes[0], 100, 0.1), 11: (notes[1][5:35], 60, 0.2), 12: ([None] * 30 + notes[2][:25], 0, 0.05), 13: (notes[3][10:] * 2, 30, 0.0), 14: (notes[4] + [None] * 30 + notes[5], 90, 0.1), 15: ([None] * 60, 0, 0.0), 16: ([0.1] * 60, 0, 0.0), 17: (notes[6][:4] + notes[7][:20] + notes[6][24:], 0, 0.0)}

    def noisy(row):
        samples, rate = audio.melody(row["notes"])
        return samples[row["cut"] :] + np.random.default_rng(row["cut"]).normal(0, row["noise"], len(samples) - row["cut"]).astype(np.float32), rate

    df = spark.createDataFrame([(i, {"notes": n, "cut": c, "noise": z}) for i, (n, c, z) in rows.items()], "id long, media struct<notes: array<double>, cut: long, noise: double>")
    chroma = audio.Chroma(s)
    prints = {i: chroma.integers(*noisy({"notes": n, "cut": c, "noise": z})) for i, (n, c, z) in rows.items()}
    want = {}
    for i, a in prints.items():
        for j, b in prints.items():
            runs = [(audio.best_run(a, b, o, s), o) for o in range(-len(a) + 1, len(b))] if i != j and i not in (15, 16) else []
            long = [(gain, -o, frames) for (_, frames, _, gain), o in runs if frames >= s.least_frames]
            if long:
                want[i, j] = max(long)
    got = {(r.id, m.class_id): m for r in audio.search(audio.fingerprint(df, "id", "media", decode=noisy), "true", "id").collect() for m in r.matches}
    assert {(0, 10), (1, 11), (2, 12), (3, 13), (4, 14), (5, 14), (7, 17)} <= set(got) <= set(want)
    assert len(got) >= 0.9 * len(want) and sum(got[k].frames == want[k][2] for k in got) >= 0.9 * len(got)
    for (i, j), m in got.items():
        a, b = prints[i][m.start : m.start + m.frames], prints[j][m.start + m.offset : m.start + m.offset + m.frames]
        assert abs(sum(int(x ^ y).bit_count() for x, y in zip(a.tolist(), b.tolist(), strict=True)) / (32 * m.frames) - m.bit_error) < 1e-9 and m.bit_error <= 0.2


def test_high_tones_do_not_fold_into_low_ones():
    """A recording at 44.1 kHz with loud tones above what 4 kHz can hold gives the integers of the music alone."""
    s, rate = audio.Settings(), 44_100
    chroma, t = audio.Chroma(s), np.arange(8 * 44_100) / 44_100
    rng = np.random.default_rng(6)
    pitch = 220.0 * 2 ** (np.repeat(rng.integers(0, 24, 64), len(t) // 64 + 1)[: len(t)] / 12)
    music = np.sin(2 * np.pi * np.cumsum(pitch) / rate).astype(np.float32)
    high = sum(np.sin(2 * np.pi * f * t) for f in (2300.0, 3100.0, 5000.0, 9777.0)).astype(np.float32)
    clean, loud = chroma.integers(music, rate), chroma.integers(music + high, rate)
    assert len(clean) > 80 and np.bitwise_count(clean ^ loud).sum() / (32 * len(clean)) < 0.02
    direct = chroma.integers(np.sin(2 * np.pi * np.cumsum(pitch) / rate)[np.round(np.arange(int(len(t) * 4000 / rate)) * rate / 4000).astype(int)].astype(np.float32), 4000)
    assert np.bitwise_count(clean[: len(direct)] ^ direct[: len(clean)]).sum() / (32 * len(direct)) < 0.1
    assert len(audio.resampled(music[:0], rate, 4000)) == 0 and len(audio.resampled(music[:5], rate, 4000)) == 0


@pytest.mark.parametrize("kind", ["clicks", "drone"])
def test_steady_sounds_have_few_keys(kind):
    """Twelve recordings of a click track or of a drone with noise: no key stands in very many places."""
    s, chroma, seen = audio.Settings(), audio.Chroma(audio.Settings()), {}
    t = np.arange(30 * s.rate) / s.rate
    for i in range(12):
        noise = np.random.default_rng(i).normal(0, 0.02, len(t))
        sound = ((np.arange(len(t)) % 2000) < 40) * np.sin(2 * np.pi * 440 * t) if kind == "clicks" else np.sin(2 * np.pi * 220 * t) + np.sin(2 * np.pi * 330 * t)
        integers = chroma.integers((sound + noise).astype(np.float32), s.rate)
        keys, places = audio.search_keys(integers, s)
        assert len(keys) == len(places)
        for k in keys.tolist():
            seen[k] = seen.get(k, 0) + 1
    assert not seen or max(seen.values()) < 500


def test_broken_and_deep_wav():
    import io
    import wave

    for width in (1, 2, 3, 4):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(width)
            f.setframerate(8000)
            f.writeframes((b"\x00" * (width - 1) + (b"\xc0" if width == 1 else b"\x40")) * 500)
        whole = out.getvalue()
        assert np.allclose(audio.wav(whole)[0], 0.5, atol=1e-2) and len(audio.wav(whole)[0]) == 500
        for cut in range(len(whole)):
            audio.wav(whole[:cut])
        assert len(audio.wav(whole[:-1])[0]) == 499


def test_wav():
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.array([[16384, 0]] * 9000, "<i2").tobytes())
    samples, rate = audio.wav(out.getvalue())
    assert rate == 8000 and len(samples) == 9000 and abs(samples[0] - 0.25) < 1e-6
    assert len(audio.wav(b"junk")[0]) == len(audio.wav(None)[0]) == 0



@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    rows = [tuple(r[names.index(c)] for c in df.columns) for r in result.fetchall()]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, rows))


def test_word_pairs_of_one_text_only_are_not_handed_on(spark):
    """The last pass hands on pairs that two texts have, each with its place among all; of texts that share nothing it hands on next to none."""
    texts = [" ".join(f"w{i}x{j}" for j in range(120)) + " same two words" for i in range(60)]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, label long, text string")
    counts, twice = near_dedup.pair_counts(df)
    assert counts.sum() == 60 * 122
    choose = lambda words: near_dedup._word_pairs(words)
    bins = lambda tokens: near_dedup._fine_bins(tokens)
    two = lambda tokens: (twice[bins(tokens) >> 3] >> (7 - (bins(tokens) & 7)).astype("uint8") & 1).astype(bool)
    made = near_dedup._rare_pairs(df, choose, two).collect()
    shared = [r for r in made if r["at"] in (120, 121)]
    assert len(shared) == 120 and len({r.token for r in shared}) == 2 and len(made) < 120 + 60
    assert all(r.before_1 != 0 and r.before_2 != 0 for r in shared)


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that only some of many labelled rows have, those with the largest hashes, is learnt; shards give what their rows say, whatever their order."""
    rows = spark.range(13000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    usable = rows.filter(toxicity.learnable("doc_id"))
    late = usable.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").offset(3000)
    docs = rows.join(late.select("doc_id", F.lit(True).alias("late")), "doc_id", "left")
    word = F.when(F.col("late"), "zebra").when(F.col("toxic") == 1, "bad").otherwise("fine")
    docs = docs.select("doc_id", F.concat(F.lit("some text "), word).alias("text"), F.lit("en").alias("lang"))
    model = toxicity.fit(docs, rows)
    scorer = toxicity.Scorer(model)
    assert usable.count() > 9000 and late.count() > 1000
    assert scorer.score("some text zebra") > 0.9 and scorer.score("some text bad") > 0.9 and scorer.score("some text fine") < 0.1 and scorer.score("some text quokka") < 0.9
    again = toxicity.fit(docs.repartition(7, "text"), rows.repartition(3))
    assert (again.table == model.table).all() and again.bias == model.bias and again.thresholds == model.thresholds


def test_toxicity_texts_scored_together_are_scored_alike():
    """Texts of any length beside others get the score they get alone."""
    model, rng = toxicity.Model.fresh(toxicity.Settings()), np.random.default_rng(3)
    model.table[:-1] = rng.normal(0, 1, model.table[:-1].shape)
    texts = ["", "a", "a b", "a b c", "", " ".join(f"w{i}" for i in range(20000)), "c a", ""]
    together, alone = toxicity.Scorer(model).scores(texts), [toxicity.Scorer(model).score(t) for t in texts]
    assert np.allclose(together, alone, atol=1e-5) and len(set(alone)) == 6
