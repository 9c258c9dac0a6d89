"""What is learned: word vectors, language profiles, and the record flow with both."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenary.operators import embedding, languages, records, topics

from .compare import DATA


def corpus(seed=3):
    """Texts of made-up topics: each speaks with 24 words of its own among common ones; (label, text)."""
    rng = random.Random(seed)
    words = [["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) + str() for _ in range(24)] for _ in range(8)]
    common = ["the", "of", "and", "to", "in", "is", "for", "with"]
    texts = []
    for k in range(600):
        t = k % 8
        texts.append((t, " ".join(rng.choice(words[t]) if rng.random() < 0.5 else rng.choice(common) for _ in range(60))))
    return words, common, texts


def test_word_vectors_tell_topics_by_words_that_descriptions_lack(spark):
    """Descriptions hold six words of a topic, texts the others: only what stands together in the corpus tells."""
    words, common, texts = corpus()
    rng = random.Random(4)
    about = [(str(t), ", ".join(w[:6])) for t, w in enumerate(words)]
    asked = [(str(t), " ".join(rng.choice(words[t][6:]) if rng.random() < 0.6 else rng.choice(common) for _ in range(12))) for t in range(8) for _ in range(25)]
    learned = embedding.encoder(embedding.fit(spark.createDataFrame(texts, "label int, text string"), dims=16, contexts=200))
    right = {}
    for name, encode in (("learned", learned), ("hashed", topics.hashed_encoder())):
        tags = topics.nearest(encode, about, k=1, threshold=-1.0)([t for _, t in asked])
        right[name] = np.mean([got == [want] for got, (want, _) in zip(tags, asked, strict=True)])
    assert right["learned"] >= 0.95 and right["learned"] > right["hashed"] + 0.3, right


def test_word_vectors_of_documents_find_their_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    encode = embedding.encoder(embedding.fit(docs, dims=32, contexts=300, words=3000))
    rows = [(r["text"], r["lang"]) for r in docs.filter("lang IS NOT NULL AND length(text) > 300").collect()]
    vectors, lang = encode([t for t, _ in rows]), np.array([x for _, x in rows])
    near = vectors @ vectors.T - 9 * np.eye(len(rows))
    assert (lang[near.argmax(axis=1)] == lang).mean() >= 0.97


def test_pairs_are_those_of_a_plain_count(spark, monkeypatch):
    texts = ["a b a c", "b", None, "", "c a\nb", "A x1y a"] * 3
    known = {"a": 0, "b": 1, "c": 2, "x": 3, "y": 4}
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {(r["w"], r["c"]): r["n"] for r in embedding.cooccurrences(df, known, contexts=3, window=2).collect()}
    monkeypatch.setattr(embedding, "DENSE", 0)
    assert {(r["w"], r["c"]): r["n"] for r in embedding.cooccurrences(df, known, contexts=3, window=2).collect()} == got
    want = Counter()
    for t in texts:
        w = [x for x in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()]
        for i, x in enumerate(w):
            for j, y in enumerate(w):
                if i != j and abs(i - j) <= 2 and known[y] < 3:
                    want[known[x], known[y]] += 1
    assert got == dict(want)
    assert {r["word"]: r["n"] for r in embedding.vocabulary(df, least=7).collect()} == {"a": 15, "b": 9}


def test_factors_are_those_of_the_whole_decomposition(spark):
    rng = np.random.default_rng(5)
    m = (rng.random((60, 5)) @ rng.random((5, 30))) * (rng.random((60, 30)) < 0.9)
    rows = [(i, [int(c) for c in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for i, r in enumerate(m)]
    got = {r["w"]: np.array(r["vector"]) for r in embedding.factored(spark.createDataFrame(rows, "w long, cs array<int>, xs array<double>").repartition(4), 30, 4, rounds=12).collect()}
    u, s, _ = np.linalg.svd(m)
    want = u[:, :4] * np.sqrt(s[:4])
    got = np.array([got[i] for i in range(60)])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-3)


def test_a_corpus_without_words(spark):
    vectors = embedding.fit(spark.createDataFrame([(None,), ("",), ("12 34",)], "text string"))
    encode = embedding.encoder(vectors)
    assert vectors.count() == 0 and not encode(["some words", "", None]).any()
    assert languages.judge(languages.trained(spark.createDataFrame([], "text string, lang string")))(["some words"]) == ["unknown"]


def test_language_profiles_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL AND length(text) >= 20")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    judges = languages.judge(languages.trained(docs.filter(~held)))
    got = docs.filter(held).select("lang", languages.judged_language(F.col("text"), judges).alias("told")).collect()
    assert len(got) > 150 and np.mean([r["lang"] == r["told"] for r in got]) >= 0.99


def test_language_profiles_of_many_languages_and_scripts(spark):
    """Languages of made-up alphabets and habits, short texts, held out."""
    rng = random.Random(9)
    letters = ["abcdefghij", "abcdefghijklm", "ñáéabcd", "абвгдежз", "αβγδεζη", "अआइईउऊ", "あいうえおか"]
    habits = [[f"{a}{b}" for a in x for b in rng.sample(x, 3)] for x in letters]
    text = lambda k, n: " ".join("".join(rng.choice(habits[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(str(k), text(k, 40)) for k in range(7) for _ in range(20)]
    judges = languages.judge(languages.trained(spark.createDataFrame(rows, "lang string, text string")))
    asked = [(str(k), text(k, 12)) for k in range(7) for _ in range(30)]
    assert np.mean([a == b for (a, _), b in zip(asked, judges([t for _, t in asked]), strict=True)]) >= 0.98
    assert judges(["", None, "ʘʘʘ ǂǂ"]) == ["unknown"] * 3


def test_runs_are_counted_alike_either_way():
    rng = random.Random(6)
    words = list({"".join(rng.choice("abcdé日ж") for _ in range(rng.randrange(1, 9))) for _ in range(400)})
    times = np.array([rng.randrange(1, 50) for _ in words])
    few, many = languages.counted_runs(words, times), languages.counted_runs(words, times, most=0)
    want = Counter()
    for w, m in zip(words, times.tolist(), strict=True):
        for n in (1, 2, 3):
            for run in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)):
                if run != " ":
                    want[sum(ord(c) << (21 * k) for k, c in enumerate(run))] += m
    assert dict(zip(*map(np.ndarray.tolist, few), strict=True)) == dict(zip(*map(np.ndarray.tolist, many), strict=True)) == dict(want)


def test_models_are_stored_and_used_by_records(spark, tmp_path):
    words, common, texts = corpus()
    rows = spark.createDataFrame([(f"{t} " + x, "xx" if k % 2 else "yy") for k, (t, x) in enumerate(texts)], "text string, lang string")
    rows = rows.withColumn("text", F.when(F.col("lang") == "xx", F.col("text")).otherwise(F.translate("text", "aeiou", "öüäëï")))
    models = records.fit_models(rows, rows, path=str(tmp_path / "models"), dims=16, contexts=200)
    again = records.Models.stored(spark, str(tmp_path / "models"))
    assert np.allclose(models.encode(["bada the", "of"]), again.encode(["bada the", "of"]))
    raw = spark.createDataFrame([(1, "https://a.b/c", "blog", "", "", [], "", "", [texts[0][1]]), (2, "https://a.b/c", "blog", "", "", [], "", "", [texts[1][1].translate(str.maketrans("aeiou", "öüäëï"))])],
                                "doc_id long, url string, source_type string, title string, author string, authors array<string>, published_date string, description string, raw_text_sections array<string>")
    got = {r["doc_id"]: r["language"] for r in records.analysed(raw, "2026-04-01", models=again).filter("language <> 'unknown'").collect()}
    assert got == {1: "xx", 2: "yy"}
