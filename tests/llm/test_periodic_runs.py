"""Periodic runs against a plain search, over short sequences, words of hard texts and whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lumenary.llm import periodic_runs as p

from ..compare import DATA, connection, same


def plain(w, least=12):
    """Every maximal stretch of a period, of which the smallest period stays."""
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


def found(w, least=12):
    return sorted(zip(*[x.tolist() for x in p.tandem_runs(np.array(w, np.int64), least)], strict=True))


def test_every_short_sequence():
    for n in range(1, 9):
        for w in itertools.product(range(3 if n < 8 else 2), repeat=n):
            assert found(w, 2) == plain(w, 2), w


def test_random_and_planted_sequences():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randrange(1, 70), rng.choice([1, 2, 2, 3, 4, 8])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5:
            a, q = rng.randrange(n), rng.randrange(1, n + 1)
            w = [w[i] if i < a else w[a + (i - a) % q] for i in range(n)]
        least = rng.choice([2, 4, 12])
        assert found(w, least) == plain(w, least), w


def test_words_known_for_their_runs():
    x, y = [0], [0, 1]
    for _ in range(10):
        x, y = y, y + x
    assert found(y, 2) == plain(y, 2)  # Fibonacci
    thue = [bin(i).count("1") % 2 for i in range(512)]
    assert found(thue, 2) == plain(thue, 2)  # no overlaps
    assert found([3] * 3000) == [(0, 3000, 1)]
    assert found([i % 999 for i in range(99_900)]) == [(0, 99_900, 999)]


def hard():
    rng, texts = random.Random(7), [None, "", " \t\n\x0b\x0c\r", "one", "x " * 11, "x " * 12, "a b " * 6, "\t".join("abcdef" * 2), "\n".join("abcdef" * 2 + "a"), "A a " * 9, "é ß " * 9, "a\x85b c\xa0d " * 9, "x " * 30_000]
    for n in (5, 40, 300, 300, 900):
        w = [f"w{rng.randrange(50)}" for _ in range(n)]
        at, q = rng.randrange(n), rng.randrange(1, 20)
        texts += [" ".join(w), " ".join(w[:at] + w[at : at + q] * 7 + w[at:]), " ".join(w + w), " ".join((w[:9] + ["x"] * 14) * 3 + w[::-1])]
    line = "the same line stands here many times over"
    texts += ["\n".join([line, "between one", line, "between two", line]), "\n".join([line] * 4), " ".join(f"u{i % 70_000}" for i in range(150_000))]
    return list(enumerate(texts)) + [(5, texts[5]), (5, texts[5]), (None, texts[6])]


def told(doc_id, w):
    runs, gone = plain(w), set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    most = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *most, most[1] and 1000 * most[1] // most[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % q] for i in range(n)]
    return told(doc_id, w)


def test_operator(spark):
    rows = [r for r in hard() if not r[1] or len(r[1]) < 40_000]  # the plain search is quadratic
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "runs", "n_words", "collapsed")})
    got = p.periodic_runs(docs.repartition(3)).collect()
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain(w)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=repr) == sorted(want, key=repr)


def test_very_long_texts(spark):
    docs = spark.createDataFrame([r for r in hard() if r[1] and len(r[1]) >= 40_000], "doc_id long, text string")
    assert sorted((r["n_words"], [tuple(x) for x in r["runs"]]) for r in p.periodic_runs(docs).collect()) == [(30_000, [(0, 30_000, 1)]), (150_000, [(0, 150_000, 70_000)])]


def test_empty(spark):
    assert p.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_over_made_periods(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(i % 90))) for i in range(300)]
    rows += [(i + 300, t) for i, t in hard() if i is not None and (not t or len(t) < 40_000)] + [(None, "a b"), (5, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in p.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((contract(*r) for r in rows), key=repr)


def test_sql(spark):
    same(spark, connection(), p.op12_periodic_runs, p.SQL, DATA)
