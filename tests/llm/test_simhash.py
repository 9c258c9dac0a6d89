"""SimHash near duplicates against a plain statement of the contract."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenary.llm import simhash as s
from lumenary.llm.common import Scratch

from ..compare import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(fps, radius=2):
    """The smallest place that each reaches."""
    fps, label = np.array(fps, np.uint64), np.arange(len(fps))
    close = [np.flatnonzero(np.bitwise_count(fps ^ f) <= radius) for f in fps]
    while True:
        new = np.array([label[c].min() for c in close])
        if (new == label).all():
            return label
        label = new


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))  # so the smallest place is that of the smallest id
    fps = [plain(t) for _, t in rows]
    return sorted(((i, f"{f:016x}", rows[g][0]) for (i, _), f, g in zip(rows, fps, groups(fps), strict=True)), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hard():
    rng, texts = random.Random(3), [None, "", " \t\n\x0b\x0c\r", "one", "One", "a b", "A B", "a b c", "x " * 5000, "É é ß Σ", "日本語 テスト 日本", "a\x85b c\xa0d e f", "tab\tsep\nline\rret\x1cx"]
    base = [f"w{rng.randrange(60)}" for _ in range(400)]
    for k in range(60):
        w = list(base)
        for _ in range(k // 10):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"v{rng.randrange(999)}" for _ in range(rng.randrange(3, 80))) for _ in range(60)]
    texts.append(" ".join(f"v{rng.randrange(999)}" for _ in range(150_000)))
    return [(7 * i % 1000, t) for i, t in enumerate(texts)] + [(7, ""), (7, ""), (None, "one"), (None, "alone in its group of words"), (21, texts[3])]


@pytest.mark.parametrize("block", [1, 3, 512])
def test_near_duplicates(spark, block):
    docs = spark.createDataFrame(hard(), "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(5) for c in ("fp", "mask", "bits", "rep", "component_id", "label", "node", "of", "fingerprint", "group", "g")})
    assert collected(s.near_duplicates(docs.repartition(3), block=block)) == brute(hard())


def test_empty(spark):
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    rows = [tuple(r.values()) for r in pq.read_table(DATA / "documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    assert collected(s.op11_simhash(spark, str(DATA))) == brute(rows)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_blocks_lose_no_link(spark, radius):
    """Dense families, about random centres that agree on half their bits; blocks are cut wherever they can be."""
    rng = random.Random(radius)
    half, fps = rng.getrandbits(32), set()
    for _ in range(30):
        centre = half << 32 | rng.getrandbits(32)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    fps = sorted(fps)
    df = spark.createDataFrame([(s.signed(f),) for f in fps], "fp long")
    links = s.links_in(s.in_blocks(df, radius, 4, Scratch(spark, "blocks")), radius).collect()
    place = {s.signed(f): i for i, f in enumerate(fps)}
    forest = s.Forest(len(fps))
    forest.join(np.array([place[r["a"]] for r in links]), np.array([place[r["b"]] for r in links]))
    assert (forest.root == groups(fps, radius)).all()


@pytest.mark.parametrize("n, block", [(1, 1), (64, 64), (65, 65), (1000, 1000), (1000, 7), (2000, 300)])
def test_bit_slices(n, block):
    """Blocks of any size, also over several words, against plain distances."""
    rng = np.random.default_rng(n + block)
    centre = rng.integers(0, 1 << 63, 1 + n // 40, dtype=np.uint64)
    fps = centre[rng.integers(0, len(centre), n)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    root = s.near(fps, np.arange(0, n, block), 2).root
    for at in range(0, n, block):
        assert (root[at : at + block] - at == groups(fps[at : at + block])).all()
