"""The traps of each rule, one by one, against values worked out by hand or by plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.functions import dates, folds, scores, urls
from lumenary.functions import text as T

AS_OF = "2026-04-01"


def values(spark, rows, expr, schema="x string"):
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r["y"] for r in frame.select("i", expr.alias("y")).orderBy("i").collect()]




@pytest.mark.parametrize(("f", "cases"), [
    (urls.is_valid, [("ftp://x.com", False), ("https://", False), ("HTTP://x.com", True), ("", False), (None, False)]),
    (urls.source_type, [("https://a.com/?ref=youtube.com", "youtube"), ("https://www.ncbi.nlm.nih.gov/pubmed/123456", "pubmed"), ("https://a.com", "blog"), (None, "blog")]),
    (urls.video_id, [("https://youtube.com/watch?v=abc&t=1", "abc"), ("https://youtube.com/shorts/ID1", "ID1"), ("https://youtu.be/XyZ", "XyZ"),
                     ("https://www.youtube-nocookie.com/embed/abcdefghijk", "abcdefghijk"), ("https://youtube.com/", None)]),
    (urls.article_id, [("https://pubmed.ncbi.nlm.nih.gov/39801619/", "39801619"), ("https://pubmed.ncbi.nlm.nih.gov/12345/", None)]),
    (urls.region, [("https://x.co.uk", "UK"), ("https://x.co.uk:8080", "unknown"), ("https://a.medium.com", "global"), ("https://x.org", "unknown"), ("https://nih.gov", "US")]),
    (T.clean_text, [("<p>A&amp;B</p>", "A&B"), ("&amp;lt;b&amp;gt;", "<b>"), ("a\x0bb\x01c", "a bc"), ("  x y\x1c", "x y")]),
    (T.is_boilerplate, [("We respect your privacy in this long article", True), ("x" * 14, True), ("x" * 15, False), ("COPYRIGHT 2024 by someone", True)]),
    (T.is_noise, [("Leave a reply to this thread", True), ("x" * 19, True), ("x" * 20, False)]),
    (T.sentences, [("A b. c. D", ["A b. c.", "D"]), ("Fin. École", ["Fin. École"]), ("", []), ("Who? Me! Yes.", ["Who?", "Me!", "Yes."])]),
    (dates.video_date, [("20240925", "2024-09-25"), ("2024", "2024"), ("", "")]),
    (lambda x: dates.normal_date(x, AS_OF), [("03/04/2024", "2024-03-04"), ("no date here", "no date here"), ("", "unknown"), (None, "unknown"), ("unknown", "unknown"),
                                              ("2024-11-20", "2024-11-20"), ("2024-11-20T10:00:00Z", "2024-11-20"), ("Nov 5, 2020", "2020-11-05"), ("5 Nov 2020", "2020-11-05"),
                                              ("20240925", "2024-09-25"), ("2024", "2024-04-01"), ("published on June 3rd, 2021", "2021-06-03"), ("2024-13-45", "2024-13-45")]),
    (lambda x: dates.page_date(x, AS_OF), [("certainly no date", "certainly "), ("", ""), ("2024-01-02", "2024-01-02")]),
    (lambda x: urls.domain_authority(x, F.lit("blog")), [("https://excell.com", 1.0), ("https://mit.edu", 1.0), ("https://x.edu.cn", 0.8), ("https://a.blogspot.com", 0.2), ("", 0.3), ("https://q.zz", 0.4)]),
])
def test_by_value(spark, f, cases):
    assert values(spark, [c for c, _ in cases], f(F.col("x"))) == [want for _, want in cases]


def test_article_dates(spark):
    rows = [("2024", "Nov", None), ("2024", "Winter", "3"), ("", "1", "1"), ("2024", "012", "5")]
    got = values(spark, rows, dates.article_date(F.col("y"), F.col("m"), F.col("d")), "y string, m string, d string")
    assert got == ["2024-11-01", "2024-01-03", "", "2024-012-05"]


def test_authors(spark):
    rows = [("unknown", "blog", 0.15), (" Unknown ", "blog", 0.2), ("   ", "blog", 0.2), ("Admin", "pubmed", 0.2), ("United Cats", "youtube", 0.85), ("Yossi Matias", "blog", 0.7),
            ("Maya", "blog", 0.55), ("maya", "blog", 0.45), (None, "pubmed", 0.3), ("Ann Lee", "other", 0.5), ("Oracle Staff", "blog", 0.8), ("Ab", "youtube", 0.2)]
    got = values(spark, rows, scores.author_credibility(F.col("a"), F.array().cast("array<string>"), F.col("k")), "a string, k string, w double")
    assert got == [w for *_, w in rows]


GOLDEN = [("blog", 0.7, 0.9, 0.85, 0.85, 0.1, 0.72), ("blog", 0.7, 0.8, 0.85, 0.7, 0.1, 0.67), ("blog", 0.7, 0.9, 0.85, 0.7, 0.1, 0.69),
          ("youtube", 0.85, 1.0, 0.6, 1.0, 0.15, 0.71), ("youtube", 0.85, 1.0, 0.6, 0.75, 0.15, 0.64), ("pubmed", 0.95, 0.7, 1.0, 1.0, 0.85, 0.89)]


def test_golden_scores(spark):
    got = values(spark, GOLDEN, scores.trust(*map(F.col, "aqdrm"), F.col("k")), "k string, a double, q double, d double, r double, m double, w double")
    assert got == [g[-1] for g in GOLDEN]


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(1)
    xs = [0.715, 0.7150000000000001, 0.005, 0.995, 1.0, 0.0] + [rng.randrange(1001) / 1000 for _ in range(500)] + [rng.random() for _ in range(500)]
    xs += [rng.choice((0.2, 0.35, 0.3)) * rng.randrange(21) / 20 + 0.15 * rng.randrange(21) / 20 for _ in range(1000)]
    xs = [x for x in xs if x <= 1]
    assert values(spark, xs, scores.round2(F.col("x")), "x double") == [round(x, 2) for x in xs]


def test_recency(spark):
    rows = [("2030-01-01", "blog", 1.0), ("no date", "youtube", 0.4), ("unknown", "youtube", 0.3), ("unknown", "pubmed", 0.6), ("", "blog", 0.4), ("2025-12-01", "youtube", 1.0),
            ("2020-01-01", "pubmed", 0.7), ("2020-01-01", "blog", 0.3), ("2010-01-01", "pubmed", 0.5), ("2023-06-01", "other", 0.7)]
    got = values(spark, rows, scores.recency(F.col("d"), dates.parse_date(F.col("d"), AS_OF), F.col("k"), AS_OF), "d string, k string, w double")
    assert got == [w for *_, w in rows]


def test_content_quality_and_disclaimer(spark):
    frame = spark.createDataFrame([
        (0, [], "", "unknown", "youtube", []), (1, [], "", "unknown", "pubmed", []), (2, [], "", "unknown", "blog", []),
        (3, ["word " * 1600] + ["x y"] * 8, "d" * 51, "T", "blog", []), (4, ["x"], "Not medical advice", "T", "blog", ["healthcare"]), (5, ["x"], "", "T", "youtube", ["public health"]),
        (6, ["Background: a", "Methods: b", "Results: c"], "", "T", "pubmed", ["biotechnology"]), (7, ["y" * 501], "https://a.b/c " + "z" * 201, "T", "youtube", ["finance"]),
    ], "i int, s array<string>, d string, t string, k string, g array<string>")
    c = F.col
    got = frame.select("i", scores.content_quality(c("s"), c("d"), c("t"), c("k")).alias("q"), scores.medical_disclaimer(c("g"), c("s"), c("d"), c("k")).alias("m")).orderBy("i").collect()
    assert [r["q"] for r in got] == [0.5, 0.5, 0.3, 1.0, 0.35, 0.5, 0.95, 1.0]
    assert [r["m"] for r in got] == [0.5, 0.7, 0.5, 0.5, 1.0, 0.15, 0.85, 0.5]


# Folds against plain statements of their rules.


def kept_sections(sections):
    kept = []
    for s in sections:
        n = s.lower().strip()
        if not any(n == k or ((n in k or k in n) and abs(len(n) - len(k)) < 50) for k, _ in kept):
            kept.append((n, s))
    return [s for _, s in kept]


def short_merged(chunks, least=50):
    out = []
    for c in chunks:
        if out and len(out[-1]) < least:
            out[-1] += " " + c
        else:
            out.append(c)
    return out


def split_sentences(t):
    return [x for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", t) if (x := s.strip())]


def long_split(chunks, most):
    out = []
    for c in chunks:
        if len(c) <= most:
            out.append(c)
            continue
        run = ""
        for s in split_sentences(c):
            if run and len(run) + 1 + len(s) > most:
                out.append(run.strip())
                run = s
            else:
                run = f"{run} {s}"
        out += [run.strip()] if run.strip() else []
    return out


def blocks(segments, size=200):
    out, run = [], ""
    for s in filter(str.strip, segments):
        run = f"{run} {s}"
        if len(run) > size:
            out.append(run.strip())
            run = ""
    return out + ([run.strip()] if run.strip() else [])


def random_arrays(n, seed, words=("Hello", "world.", "A", "section!", "x", "Tail?", "more")):
    rng = random.Random(seed)
    return [[" ".join(rng.choice(words) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(9))] for _ in range(n)]


@pytest.mark.parametrize(("fold", "plain"), [
    (folds.drop_near_duplicates, kept_sections), (folds.merge_short, short_merged), (lambda x: folds.split_long(x, 40), lambda c: long_split(c, 40)),
    (lambda x: folds.merge_transcript(x, 60), lambda s: blocks(s, 60)),
    (folds.sentence_groups, lambda x: [" ".join(p[i : i + 3]) for s in x for p in [split_sentences(s)] for i in range(0, len(p), 3)]),
])
def test_folds(spark, fold, plain):
    arrays = [*random_arrays(400, 7), [], ["s" * 100, "s" * 100 + "t" * 50], ["s" * 100, "s" * 100 + "t" * 49], ["a" * 10, "b" * 20, "c" * 60, "d" * 5], ["x" * 2000], ["p" * 100, "q" * 100]]
    assert values(spark, [(a,) for a in arrays], fold(F.col("x")), "x array<string>") == [plain(a) for a in arrays]


def test_chunks_by_type(spark):
    rows = [(["One. Two. Three. Four. " + "W" * 60], "pubmed"), (["a", " ", "b" * 60, "c"], "blog"), ([], "pubmed"), ([], "youtube")]
    got = values(spark, rows, folds.content_chunks(F.col("s"), F.col("k")), "s array<string>, k string")
    assert got == [["One. Two. Three. Four. " + "W" * 60], ["a " + "b" * 60, "c"], [], []]


def test_rule_data_is_whole():
    assert len(R.TOPICS) == 20 and len(R.TRUSTED_CHANNELS) == 25 and len(R.INSTITUTIONAL) == 20 and len(R.CORPORATE) == 13 and len(R.DISCLAIMERS) == 10
    assert all(abs(sum(w) - 1) < 1e-9 for w in R.WEIGHTS.values())


def test_the_index_keeps_what_the_fold_keeps(spark):
    """Sections that contain each other at either end, of lengths about those of keys, with and without some too short for one."""
    import random

    from lumenary.functions import folds

    def fold(texts):
        kept = []
        for i, n in enumerate(texts):
            if not any(abs(len(texts[k]) - len(n)) < 50 and (n in texts[k] or texts[k] in n) for k in kept):
                kept.append(i)
        return kept

    rng, records = random.Random(2), []
    for t in range(80):
        base = ["".join(rng.choice("ab cdé日") for _ in range(rng.choice([0, 1, 5, 14, 15, 16, 26, 30, 58, 64, 65, 66, 90, 107, 108, 200]))) for _ in range(25)]
        texts = []
        for _ in range(150):
            b, r = rng.choice(base), rng.random()
            a = rng.randrange(max(1, min(60, len(b))))
            texts.append(b if r < 0.3 else b[a:] if r < 0.5 else b[: len(b) - a] if r < 0.7 else "".join(rng.choice("xyz") for _ in range(a)) + b if r < 0.85 else b + "q" * a)
        records.append([x for x in texts if len(x) >= 15] if t % 2 else texts)
    for texts in records:
        assert folds.first_of_each(texts) == fold(texts)
    rows = [(i, [x.strip() for x in r]) for i, r in enumerate(records[:12])] + [(90, []), (91, None), (92, ["A", "a", None])]
    got = spark.createDataFrame(rows, "i int, xs array<string>").select("i", folds.drop_near_duplicates(F.col("xs")).alias("a"), folds.drop_near_duplicates(F.col("xs"), indexed=120).alias("b")).collect()
    for r in got:
        assert r["a"] == r["b"], r["i"]
        if r["i"] < 12:
            assert r["a"] == [dict(rows)[r["i"]][k] for k in fold(dict(rows)[r["i"]])]


def test_a_record_of_many_sections(spark):
    import random
    import time

    from lumenary.functions import folds

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(90)) for _ in range(rng.randrange(4, 40))) for _ in range(20_000)]
    began = time.perf_counter()
    assert spark.createDataFrame([(texts + texts[:5000],)], "xs array<string>").select(F.size(folds.drop_near_duplicates(F.col("xs"), indexed=2000))).first()[0] >= 19_000
    assert time.perf_counter() - began < 60
