"""Toxicity: cumulative-link ordinal regression over sparse word features.

P(grade <= k) = sigmoid(threshold_k - w . x): all thresholds share the weights w. x holds 1 + log(count) of
the words (letters and digits, A-Z lower-cased) that a bounded sample of labelled rows ties to the label either way. The
labels say toxic or not. Grades of toxic rows come from outside the model that is fitted to them: a binary
model is fitted on four fifths of the rows, with words of its own choice, and scores the last fifth, five times over; toxic rows
fall into grades 1 to 3 by thirds of that score, the others have grade 0. Rows that are near copies of each other (a
verified overlap of words) count as one row between them, and stand in one fifth. The result is the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.batches import GAPS, Words, mix, slices
from lumenary.llm.common import Scratch, table

GRADES, FOLDS = 4, 5
LEAST_TOXIC = 0.3  # of P(grade > 0)
SKETCH, BAND = 24, 3  # min-hashes of a row, and how many of them make a key under which near copies meet
Row = tuple[np.ndarray, np.ndarray]


def word_counts(texts: list[str | None]) -> Iterator[Row]:
    """The distinct word hashes of each text, sorted, and their counts."""
    words = Words(texts, gaps=GAPS)
    h = words.hashes()
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        yield np.unique(h[a:b], return_counts=True)


def near_groups(rows: list[Row], least: float = 0.8) -> np.ndarray:
    """A group number of each row: rows that share a key of min-hashes join if their word sets have a Jaccard similarity of ``least``."""
    group, first = np.arange(len(rows)), {}
    salts = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    for k, (keys, _) in enumerate(rows):
        if not len(keys):
            continue
        sketch = [int(mix(keys ^ salt).min()) for salt in salts]
        for band in range(0, SKETCH, BAND):
            other = first.setdefault((band, *sketch[band : band + BAND]), k)
            if group[other] != group[k]:
                both = len(np.intersect1d(keys, rows[other][0], assume_unique=True))
                if both >= least * (len(keys) + len(rows[other][0]) - both):
                    group[group == group[k]] = group[other]
    return group


class Sparse:
    """Features of rows: value 1 + log(count) at (row, column) for the words of each row that ``words`` has."""

    def __init__(self, rows: list[Row], words: np.ndarray):
        size = np.array([len(k) for k, _ in rows], np.int64)
        keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in rows]])
        counts = np.concatenate([np.zeros(0), *[n for _, n in rows]])
        self.shape = len(rows), len(words)
        at = np.minimum(np.searchsorted(words, keys), max(0, len(words) - 1))
        hit = words[at] == keys if len(words) else np.zeros(len(keys), bool)
        self.row, self.col, self.value = np.repeat(np.arange(len(rows)), size)[hit], at[hit], 1 + np.log(counts[hit])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.shape[1])


def vocabulary(rows: list[Row], toxic: np.ndarray, weight: np.ndarray, least_rows: float = 4.0, least_z: float = 4.0) -> np.ndarray:
    """Words of ``least_rows`` rows or more whose share among toxic rows differs from that among the others by ``least_z`` standard errors."""
    size = [len(k) for k, _ in rows]
    words, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in rows]]), return_inverse=True)
    bad = np.bincount(at, np.repeat(weight * toxic, size), len(words))
    n = np.bincount(at, np.repeat(weight, size), len(words))
    all_bad, all_n = (weight * toxic).sum(), weight.sum()
    if not 0 < all_bad < all_n:
        return words[:0]
    p, q = bad / all_bad, (n - bad) / (all_n - all_bad)
    share = n / all_n
    z = (p - q) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / all_bad + 1 / (all_n - all_bad)))
    return words[(n >= least_rows) & (np.abs(z) >= least_z)]


def log_likelihood(z: np.ndarray, cuts: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """Log P(grade) of each row."""
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    one = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    return np.log(np.maximum(one(edge[grade + 1] - z) - one(edge[grade] - z), 1e-12))


def fit_ordinal(x: Sparse, grade: np.ndarray, weight: np.ndarray, grades: int = GRADES, penalty: float = 1e-4, steps: int = 600, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by penalised maximum likelihood (Adam steps; gaps between thresholds stay positive)."""
    k, total = x.shape[1], max(weight.sum(), 1e-9)
    p = np.zeros(k + grades - 1)
    p[k] = 3.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    one = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        w, gaps = p[:k], np.exp(np.clip(p[k + 1 :], -5, 4))
        edge = np.concatenate([[-np.inf], p[k] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        z = x.dot(w)
        hi, lo = one(edge[grade + 1] - z), one(edge[grade] - z)
        like = np.maximum(hi - lo, 1e-9) / weight
        dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
        cut = np.bincount(grade, -dhi, grades)[:-1] + np.bincount(grade, dlo, grades)[1:]  # of the negative log-likelihood
        g = np.concatenate([x.back(dhi - dlo) / total + penalty * w, [cut.sum() / total], np.cumsum(cut[::-1])[::-1][1:] / total * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate / (1 + t / 60) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:k], p[k] + np.concatenate([[0], np.cumsum(np.exp(np.clip(p[k + 1 :], -5, 4)))])


class Model:
    """``held_out``: the share of toxic rows, and of others, that reach LEAST_TOXIC by models that were not fitted on them."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, cuts: np.ndarray, held_out: tuple[float, float] = (0.0, 0.0)):
        self.words, self.weights, self.cuts, self.held_out = words, weights, cuts, held_out

    def grades(self, z: np.ndarray) -> np.ndarray:
        """P(grade = 0), ..., P(grade = GRADES - 1) of each row."""
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None] - z[:, None], -30, 30)))
        return np.diff(np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1), axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """w . x of each text."""
        words = Words(texts, gaps=GAPS)
        h, k = words.hashes(), len(self.words)
        if not k:
            return np.zeros(words.n)
        at = np.minimum(np.searchsorted(self.words, h), k - 1)
        hit = self.words[at] == h
        cell, n = np.unique(words.doc[hit] * k + at[hit], return_counts=True)
        return np.bincount(cell // k, (1 + np.log(n)) * self.weights[cell % k], words.n)


def fit_arrays(rows: list[Row], toxic: np.ndarray) -> Model:
    """Fits on all rows; a group of near copies weighs as much as one row."""
    toxic = toxic.astype(bool)
    group = near_groups(rows)
    _, at, size = np.unique(group, return_inverse=True, return_counts=True)
    weight = 1.0 / size[at] if len(rows) else np.zeros(0)
    words = vocabulary(rows, toxic, weight)
    if not len(words):
        return Model(words, np.zeros(0), np.array([4.0, 5.0, 6.0]))
    fold = (mix(group.astype(np.uint64) + np.uint64(1)) >> np.uint64(40)).astype(np.int64) % FOLDS
    outside, p = np.zeros(len(rows)), np.zeros(len(rows))
    for k in range(FOLDS):
        train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        own = vocabulary([rows[i] for i in train], toxic[train], weight[train])
        if len(own) and len(test):
            w, cut = fit_ordinal(Sparse([rows[i] for i in train], own), toxic[train].astype(np.int64), weight[train], 2, steps=200)
            outside[test] = Sparse([rows[i] for i in test], own).dot(w) - cut[0]
            p[test] = 1 / (1 + np.exp(-np.clip(outside[test], -30, 30)))
    grade = np.where(toxic, 1 + np.searchsorted(np.quantile(outside[toxic], [1 / 3, 2 / 3]), outside, "right"), 0)
    held_out = tuple(float((weight * (p >= LEAST_TOXIC))[rest].sum() / max(weight[rest].sum(), 1e-9)) for rest in (toxic, ~toxic))
    return Model(words, *fit_ordinal(Sparse(rows, words), grade, weight), held_out)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 12000, most_bytes: int = 64 << 20) -> Model:
    """Fits on about ``most_rows`` of the labelled rows at most, taken by a hash of their ids, and of these on as many as hold
    about ``most_bytes`` of distinct words; rows without a label of 0 or 1 and labels without a document teach nothing."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), "toxic")
    share = -(-most_rows * (1 << 20) // max(1, known.count()))
    some = known.filter(F.pmod(F.xxhash64("label_id", F.lit("toxic")), F.lit(1 << 20)) < share).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    some = scratch.keep(some, 2 * most_rows)
    mine = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("label_id"))  # about most_rows rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch):
                found = list(word_counts(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), batch.column("toxic").slice(at, len(texts)),
                     pa.array([k.tobytes() for k, _ in found], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in found], pa.binary())],
                    ["doc_id", "toxic", "words", "counts"])

    got = mine.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(count, "doc_id long, toxic int, words binary, counts binary")
    got = scratch.keep(got)
    size = got.agg(F.sum(F.octet_length("words") + F.octet_length("counts"))).first()[0] or 0
    rows = got.filter(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1 << 20)) < -(-most_bytes * (1 << 20) // max(1, size))).orderBy("doc_id", "words", "counts").collect()
    return fit_arrays([(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], "<i4")) for r in rows], np.array([r["toxic"] for r in rows], int))


SCHEMA = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), grade (the likeliest; of equals the lowest), p_toxic (that of a grade above 0) and
    toxic (p_toxic >= LEAST_TOXIC) for each row of ``docs`` (doc_id, text). Null and empty texts have no words; repeated
    rows each get their row; an empty table gives an empty result; other columns are not read."""

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in slices(batch):
                p = model.grades(model.scores(texts))
                above = 1 - p[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), pa.array(p @ np.arange(GRADES)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(above), pa.array(above >= LEAST_TOXIC)],
                    ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(grade, SCHEMA)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return graded(docs, fit(docs, table(spark, sf_dir, "labels")))
