"""Language identification by hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A letter trigram's vector binds (multiplies) those of
its letters, permuted (rotated) by their places; a document bundles (sums) the vectors of its trigrams as
often as they occur, over its whole text; a language's prototype bundles the unit vectors of its training
documents. The prediction is the prototype of the largest cosine. The prototypes are fitted on at most
about ``train_docs`` documents; they hold ``DIM`` numbers a language.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.batches import slices
from lumenary.llm.common import Scratch, small_side, table

DIM = 1024
CLASSES = 512  # 0: no letter; letters up to U+017F for themselves, the rest dealt over 127 classes
BLOCK = 8192


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.uint16)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            out[c] = 1 + (c if c < 384 else 384 + c * 40503 % 127)
    return out


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(20260101).choice(np.array([-1, 1], np.int8), (CLASSES, DIM))


def _vectors(trigrams: np.ndarray) -> np.ndarray:
    one, a, b, c = _letters(), trigrams // CLASSES**2, trigrams // CLASSES % CLASSES, trigrams % CLASSES
    return (np.roll(one, 2, 1)[a] * np.roll(one, 1, 1)[b] * one[c]).astype(np.float32)


def bundles(texts: list[str | None]) -> np.ndarray:
    """A row for each text; of zeros where it has no letter."""
    whole = "\n".join((t or "").replace("\n", " ").lower() for t in texts) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes, doc = _classes()[points], np.cumsum(points == 10)
    keep = (codes > 0) | (np.concatenate([[0], codes[:-1]]) > 0) | (points == 10)
    codes, doc = np.concatenate([[0], codes[keep], [0]]).astype(np.int64), doc[keep]
    mid = np.flatnonzero(codes[1:-1])  # trigrams have a letter in the middle, so none spans two texts
    tri = (codes[mid] * CLASSES + codes[mid + 1]) * CLASSES + codes[mid + 2]
    key, n = np.unique((doc[mid] << 27) + tri, return_counts=True)
    at, tri = key >> 27, key & ((1 << 27) - 1)
    first = np.searchsorted(at, np.arange(len(texts) + 1))
    kinds, which = np.unique(tri, return_inverse=True)
    out = np.zeros((len(texts), DIM), np.float32)
    n = n.astype(np.float32)
    shared = _vectors(kinds) if len(kinds) <= BLOCK else None
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        for lo in range(a, b, BLOCK):
            hi = min(b, lo + BLOCK)
            out[k] += n[lo:hi] @ (shared[which[lo:hi]] if shared is not None else _vectors(tri[lo:hi]))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def fit(docs: DataFrame, train_docs: int = 4000) -> dict[str, np.ndarray]:
    """Unit prototypes from (text, lang) rows; null languages and texts teach nothing."""
    some = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = -(-train_docs * (1 << 20) // max(1, some.count()))  # of the rows that can teach
    some = some.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < share)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in slices(batch):
                for lang, v in zip(langs[at : at + len(texts)], _unit(bundles(texts)), strict=True):
                    total[lang] = total.get(lang, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.astype(float).tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    sums = some.mapInArrow(add, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x"))
    rows = sums.groupBy("lang", "k").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in rows.collect():  # DIM rows a language
        out.setdefault(r["lang"], np.zeros(DIM))[r["k"]] = r["x"]
    return {lang: _unit(v).astype(np.float32) for lang, v in sorted(out.items())}


def predicted(texts: list[str | None], prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The languages and cosines of texts; of equal cosines the language that comes first by name."""
    langs, matrix = list(prototypes), np.array(list(prototypes.values()), np.float32).reshape(-1, DIM)
    v = bundles(texts)
    some = v.any(axis=1) & bool(langs)
    cos = _unit(v) @ matrix.T if langs else np.zeros((len(texts), 1))
    best = cos.argmax(axis=1)
    return [langs[k] if ok else "und" for k, ok in zip(best, some, strict=True)], np.where(some, cos.max(axis=1), 0).clip(0, 1)


def prediction(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """A struct of lang_pred and score. Texts alone go to the Python workers; other columns stay where they are."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(col: pa.Array) -> pa.Array:
        found: list[str] = []
        scores = [np.zeros(0)]
        for _, texts in slices(pa.RecordBatch.from_arrays([col], ["text"])):
            lang, score = predicted(texts, prototypes)
            found += lang
            scores.append(score.astype(float))
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (cosine, 0 to 1) of each row of ``docs`` (doc_id, text).

    A text that is null, empty or without letters is ``und`` with score 0, as is every text where there is no
    prototype; of languages that tie the first by name is taken; repeated rows each get their row, an empty table
    gives none; other columns are not read.
    """
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), prediction(F.col("text"), prototypes).alias("p"))
    return got.select("doc_id", "p.lang_pred", "p.score")


def recognised(docs: DataFrame, prototypes: dict[str, np.ndarray], least: float = 0.08, least_letters: int = 40) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is recognised with a cosine of ``least`` or more. Texts of fewer
    than ``least_letters`` letters, whose few trigrams say little, stay if they have a letter at all.

    Texts alone go to the Python workers, and only keys of those that are rejected come back; whole rows stay in the JVM."""
    if not prototypes:
        return docs.filter(F.lit(False))
    keys = lambda text: (F.xxhash64(text), F.xxhash64(text, F.lit("language")))
    some = docs.select("text").filter(F.col("text").rlike(r"\p{L}"))
    judged = some.select(*[k.alias(f"key_{i}") for i, k in enumerate(keys(F.col("text")))], prediction(F.col("text"), prototypes).alias("p"),
                         F.when(F.length("text") < 20 * least_letters, F.length(F.regexp_replace("text", r"[^\p{L}]+", "")) < least_letters).otherwise(False).alias("few"))
    rejected = judged.filter((F.col("p.lang_pred") == "und") | ((F.col("p.score") < least) & ~F.col("few")))
    rejected = Scratch(docs.sparkSession, "language").keep(rejected.select("key_0", "key_1").distinct())
    first, second = keys(docs["text"])
    same = (first == rejected["key_0"]) & (second == rejected["key_1"])
    return docs.filter(docs["text"].rlike(r"\p{L}")).join(small_side(rejected, rejected.count()), same, "left_anti")


def held_out(modulus: int = 5, remainder: int = 0):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = fit(docs.filter(~held_out()))
    return identify(docs, prototypes).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
