"""Quality classifier: a sparse ensemble of rules from tree paths, weighted by lasso logistic regression.

Statistics of whole texts are the inputs. Shallow boosted trees are grown on a bounded sample of labelled
rows; the path to every node is a rule, a conjunction of comparisons of statistics. Lasso logistic
regression (proximal gradient steps) keeps few of them, and what is kept becomes one Spark column
expression over the statistics. Labels, languages, sources and ids are no inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.batches import Words, slices
from lumenary.llm.common import Scratch, table
from lumenary.llm.quality_rules import base_counts, char_histograms

STATS = ["log_words", "word_chars", "symbols", "dup_lines", "repeats", "distinct", "neighbours", "short_words", "long_words",
         "upper", "digits", "stops", "marks", "spaces", "lines"]


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATS for each text; shares of words or characters but for the first two."""
    words = Words(texts, lower=False)
    base, hist, h = base_counts(words, texts), char_histograms(words).astype(float), words.hashes()
    n, total = np.maximum(1, base["n_words"]).astype(float), np.maximum(1, hist.sum(axis=1))
    length = words.ends - words.starts
    count = lambda flags: np.bincount(words.doc, weights=flags, minlength=words.n)
    order = np.lexsort((h, words.doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    distinct = np.bincount(words.doc[order], weights=new, minlength=words.n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    lines = np.array([(t or "").count("\n") + 1 for t in texts], float)
    return np.column_stack([
        np.log1p(base["n_words"]), base["word_chars"] / n, hist[:, 7] / n, base["n_dup_lines"] / lines, base["n_repeat_words"] / n,
        distinct / n, count(same) / n, count(length <= 2) / n, count(length >= 12) / n,
        hist[:, 2] / total, hist[:, 3] / total, hist[:, 6] / n, hist[:, 8] / total, hist[:, 4] / total, lines / n])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of each row of ``docs`` (doc_id, text)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, texts in slices(batch):
                s = statistics(texts)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), *[pa.array(c) for c in s.T]], ["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(describe, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which must hold


def grow(x: np.ndarray, residual: np.ndarray, depth: int, least: int, rng: np.random.Generator, path: Rule = ()) -> list[tuple[Rule, np.ndarray]]:
    """The nodes below the root of a regression tree on ``residual``, each with the rows it holds (as a mask)."""

    def below(rows: np.ndarray, path: Rule) -> list[tuple[Rule, np.ndarray]]:
        if len(path) >= depth or rows.sum() < 2 * least:
            return []
        best, r = (1e-9, None, None), residual[rows]
        for k in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
            v = x[rows, k]
            for cut in np.unique(np.round(np.quantile(v, np.linspace(0.02, 0.98, 25)), 6)):
                low = v <= cut
                n = int(low.sum())
                if least <= n <= len(v) - least:
                    gain = r[low].sum() ** 2 / n + r[~low].sum() ** 2 / (len(v) - n) - r.sum() ** 2 / len(v)
                    if gain > best[0]:
                        best = (gain, int(k), float(cut))
        if best[1] is None:
            return []
        out = []
        for above in (False, True):
            mask = rows & ((x[:, best[1]] > best[2]) == above)
            node = (*path, (best[1], above, best[2]))
            out += [(node, mask), *below(mask, node)]
        return out

    return below(np.ones(len(x), bool), path)


def rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, seed: int = 7) -> list[Rule]:
    """The distinct paths of boosted trees; each tree sees half of the rows."""
    rng, score, out = np.random.default_rng(seed), np.zeros(len(y)), {}
    for _ in range(trees):
        some = rng.random(len(y)) < 0.5
        if not some.any():
            continue
        residual = y - 1 / (1 + np.exp(-score))
        found = grow(x[some], residual[some], depth, max(5, len(y) // 400), rng)
        for rule, _ in found:
            out[rule] = None
        parents = {r[:-1] for r, _ in found}
        for rule, mask in found:
            if rule not in parents:  # a leaf
                p = 1 / (1 + np.exp(-score[some][mask]))
                step = residual[some][mask].sum() / max(1e-3, (p * (1 - p)).sum())
                score += rate * np.clip(step, -4, 4) * holds(x, rule)
    return list(out)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return np.logical_and.reduce([(x[:, k] > cut) == above for k, above, cut in rule])


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an l1 penalty, by accelerated proximal gradient; the intercept goes free."""
    n, k = z.shape
    w = v = np.zeros(k)
    b = c = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    rate = 4 / (np.linalg.norm(z, 2) ** 2 / n + 1) if k else 1.0
    for t in range(steps):
        g = 1 / (1 + np.exp(-(z @ v + c))) - y
        nw = v - rate * (z.T @ g) / n
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - rate * penalty)
        nb = c - rate * g.mean()
        v, c = nw + t / (t + 3) * (nw - w), nb + t / (t + 3) * (nb - b)
        w, b = nw, nb
    return w, b


Model = tuple[list[tuple[Rule, float]], float]


def fit_arrays(x: np.ndarray, y: np.ndarray, penalty: float = 0.001) -> Model:
    if not len(y) or y.min() == y.max():
        return [], 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    found = rules(x, y)
    z = np.column_stack([holds(x, r) for r in found]).astype(float) if found else np.zeros((len(y), 0))
    w, b = lasso(z, y, penalty)
    return [(r, float(v)) for r, v in zip(found, w, strict=True) if abs(v) > 1e-6], float(b)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> Model:
    """Fits on about ``most_rows`` of the labelled rows at most, taken by a hash of their ids."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), "quality")
    share = -(-most_rows * (1 << 20) // max(1, known.count()))
    some = known.filter(F.pmod(F.xxhash64("label_id", F.lit("quality")), F.lit(1 << 20)) < share).groupBy("label_id").agg(F.max("quality").alias("quality"))
    some = Scratch(docs.sparkSession, "quality").keep(some)
    mine = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("label_id"), "left_semi")  # about most_rows rows
    rows = with_statistics(mine).join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).orderBy("doc_id").select(*STATS, "quality").collect()
    data = np.array([tuple(r) for r in rows], float).reshape(-1, len(STATS) + 1)
    return fit_arrays(data[:, :-1], data[:, -1])


def expression(model: Model) -> Column:
    """The score, 0 to 1, as a column over STATS."""
    kept, intercept = model

    def test(k: int, above: bool, cut: float) -> Column:
        return F.col(STATS[k]) > cut if above else F.col(STATS[k]) <= cut

    parts = [F.when(reduce(lambda a, b: a & b, [test(*c) for c in rule]), w).otherwise(0.0) for rule, w in kept]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(intercept))))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the STATS of each row of ``docs``; a null text is an empty one, and both are scored;
    repeated rows each get their row; an empty table gives an empty result; columns other than doc_id and text are not read."""
    return with_statistics(docs).withColumn("score", expression(model))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from lumenary.llm.language import held_out

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(4, 2)))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
