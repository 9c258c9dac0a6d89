"""Word vectors from a corpus, and texts as weighted means of them.

Words that stand near the same words get near vectors: counts of word and context within a window, over every text, become
positive pointwise mutual information, whose matrix (frequent words by the most frequent of them) is factored by a randomised
singular value decomposition. Counting, weighting and the products with the matrix are Spark's; its size has a bound that
parameters set, whatever the corpus, and so have the small matrices (contexts by dimensions) that pass through the driver.
The vectors are a table, stored once and loaded once per worker.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.sources.scratch import kept, shared_folder

VECTORS = "word string, n bigint, vector array<float>"
#: Pairs counted in a task before they are summed up, and sums that a task holds before it passes them on.
HELD = 2_000_000
_WORD = re.compile(r"[^\W\d_]+")
#: Words times contexts up to which a task counts in one array.
DENSE = 1 << 23


def words_of(text: str | None) -> list[str]:
    """The words of a text: runs of letters (categories L of Unicode) in lower case."""
    found = _WORD.findall(text.lower()) if text else []
    if not "".join(found).isalpha():  # numbers that are no digits, such as fractions, end words too
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


def vocabulary(texts: DataFrame, text: str = "text", words: int = 20_000, least: int = 3) -> DataFrame:
    """word, n of the ``words`` most frequent words that stand ``least`` times or more. Words are summed in the task that reads them first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(words_of(t))
                if len(found) > HELD // 8:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
                    found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    each = texts.select(F.col(text).alias("t")).mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(words)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, of = np.unique(keys, return_inverse=True)
    return keys, np.bincount(of, counts, len(keys)).astype(np.int64)


def cooccurrences(texts: DataFrame, known: dict[str, int], text: str = "text", contexts: int = 2_000, window: int = 5) -> DataFrame:
    """w, c, n: how often the word of number w has that of number c (one of the first ``contexts``) within ``window`` words on either
    side. Pairs are summed in the task that reads them, then by word and context."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        width = len(number) * contexts
        whole = np.zeros(width if width <= DENSE else 0, np.int64)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new: list[np.ndarray] = []
        gap = [-1] * window
        size = 0

        def pairs(numbers: list[int]) -> np.ndarray:
            at, out = np.array(numbers, np.int64), []
            for d in range(1, window + 1):
                a, b = at[:-d], at[d:]
                there = (a >= 0) & (b >= 0)
                a, b = a[there], b[there]
                out += [a[b < contexts] * contexts + b[b < contexts], b[a < contexts] * contexts + a[a < contexts]]
            return np.concatenate(out)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys // contexts), pa.array(keys % contexts), pa.array(counts)], ["w", "c", "n"])

        for batch in batches:
            numbers: list[int] = []
            for t in [*batch.column(0).to_pylist(), None]:
                numbers += [number.get(w, -1) for w in words_of(t)] + gap
                if t is None or len(numbers) > 100_000:
                    found = pairs(numbers)
                    numbers = []
                    if len(whole):
                        whole += np.bincount(found, minlength=width)
                        continue
                    new.append(found)
                    size += len(found)
                if size > HELD:
                    keys, counts = summed(np.concatenate([keys, *new]), np.concatenate([counts, np.ones(size, np.int64)]))
                    new, size = [], 0
                    if len(keys) > HELD:
                        yield told()
                        keys, counts = keys[:0], counts[:0]
        if len(whole):
            keys = np.flatnonzero(whole)
            counts = whole[keys]
            yield told()
        elif size or len(keys):
            keys, counts = summed(np.concatenate([keys, *new]), np.concatenate([counts, np.ones(size, np.int64)]))
            yield told()

    each = texts.select(F.col(text).alias("t")).mapInArrow(count, "w long, c long, n long")
    return each.groupBy("w", "c").agg(F.sum("n").alias("n"))


def informative(pairs: DataFrame) -> DataFrame:
    """``pairs`` (w, c, n) with their positive pointwise mutual information, ppmi. Sums by word and by context have bounded sizes."""
    by_word = pairs.groupBy(F.col("w").alias("_w")).agg(F.sum("n").alias("nw"))
    by_context = pairs.groupBy(F.col("c").alias("_c")).agg(F.sum("n").alias("nc"))
    total = by_word.agg(F.sum("nw").alias("total"))
    both = pairs.join(F.broadcast(by_word), F.col("w") == F.col("_w")).join(F.broadcast(by_context), F.col("c") == F.col("_c")).crossJoin(F.broadcast(total))  # one row
    ppmi = F.log(F.col("n") * F.col("total") / (F.col("nw").cast("double") * F.col("nc")))
    return both.select("w", "c", "n", ppmi.alias("ppmi")).filter("ppmi > 0")


def _dense(batch: pa.RecordBatch, contexts: int, most: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, matrix) of some rows (w, cs, xs) at a time."""
    for at in range(0, len(batch), most):
        rows = batch.slice(at, most)
        cs, xs = rows.column("cs"), rows.column("xs")
        row = np.repeat(np.arange(len(rows)), np.diff(cs.offsets.to_numpy()))
        out = np.zeros((len(rows), contexts), np.float32)
        out[row, cs.flatten().to_numpy()] = xs.flatten().to_numpy()
        yield rows.column("w").to_numpy(), out


def squared(matrix: DataFrame, contexts: int, by: np.ndarray) -> np.ndarray:
    """The matrix's transpose times the matrix times ``by``: each task sums up its rows, so one small matrix comes from each."""
    shared = matrix.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, by = np.zeros(shared.value.shape), shared.value.astype(np.float32)
        for batch in batches:
            for _, rows in _dense(batch, contexts):
                total += rows.T @ (rows @ by)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = matrix.mapInArrow(run, "part binary").collect()
    shared.destroy()
    return sum((np.frombuffer(r["part"]).reshape(by.shape) for r in parts), np.zeros(by.shape))


def factored(matrix: DataFrame, contexts: int, dims: int, rounds: int = 2, seed: int = 17) -> DataFrame:
    """w and vector: the rows of ``matrix`` (w, cs, xs; sparse, of ``contexts`` columns) in the ``dims`` leading directions of a
    randomised decomposition, each scaled by the inverse root of its singular value."""
    more = min(contexts, dims + 16)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((contexts, more)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(squared(matrix, contexts, basis))[0]
    value, turn = np.linalg.eigh(basis.T @ squared(matrix, contexts, basis))
    value, turn = value[::-1][:dims], turn[:, ::-1][:, :dims]
    some = value > max(value[0], 0) * 1e-12 if len(value) else np.zeros(0, bool)
    to = basis @ turn[:, some] / np.sqrt(np.sqrt(value[some]))
    shared = matrix.sparkSession.sparkContext.broadcast(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, rows in _dense(batch, contexts):
                vectors = rows @ shared.value
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))], ["w", "vector"])

    return matrix.mapInArrow(run, "w long, vector array<float>")


def fit(texts: DataFrame, text: str = "text", dims: int = 96, words: int = 20_000, contexts: int = 2_000, window: int = 5, least: int = 3,
        seed: int = 17, path: str | None = None) -> DataFrame:
    """word, n and vector of the ``words`` most frequent words of a corpus, stored at ``path`` (a new shared folder without one).

    Every text is read whole; null and wordless ones have no part, and a corpus without words gives an empty table. Parameters bound
    the matrix at ``words`` by ``contexts`` numbers."""
    spark = texts.sparkSession
    path = path or shared_folder(spark, "embedding")
    known = [(r["word"], r["n"]) for r in vocabulary(texts, text, words, least).collect()]  # as many as ``words``
    if not known:
        return kept(spark.createDataFrame([], VECTORS), f"{path}/vectors")
    contexts = min(contexts, len(known))
    pairs = kept(cooccurrences(texts, {w: k for k, (w, _) in enumerate(known)}, text, contexts, window), f"{path}/pairs")
    entry = F.struct(F.col("c").cast("int").alias("c"), F.col("ppmi").alias("x"))
    rows = informative(pairs).groupBy("w").agg(F.array_sort(F.collect_list(entry)).alias("e"))  # of ``contexts`` entries at most
    matrix = kept(rows.select("w", F.col("e.c").alias("cs"), F.col("e.x").alias("xs")).coalesce(16), f"{path}/matrix")
    names = spark.createDataFrame([(k, w, n) for k, (w, n) in enumerate(known)], "k long, word string, n long")
    got = factored(matrix, contexts, dims, seed=seed).join(F.broadcast(names), F.col("w") == F.col("k"))
    return kept(got.select("word", "n", "vector").coalesce(1), f"{path}/vectors")


class WordVectors:
    """Unit vectors of texts: means of their words' vectors, rare words weighing more, less the corpus's own mean. Texts without a known
    word are zero."""

    def __init__(self, words: list[str], counts: np.ndarray, vectors: np.ndarray, smooth: float = 1e-3):
        self.number = {w: k for k, w in enumerate(words)}
        share = counts / max(1, counts.sum())
        self.weight = smooth / (smooth + share)
        self.vectors = vectors.astype(np.float64)
        self.mean = (share * self.weight) @ self.vectors / max(1e-12, (share * self.weight).sum()) if len(words) else np.zeros(vectors.shape[1])

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        for k, text in enumerate(texts):
            at = [n for w in words_of(text) if (n := self.number.get(w)) is not None]
            if at:
                mean = self.weight[at] @ self.vectors[at] / self.weight[at].sum() - self.mean
                out[k] = mean / max(1e-12, np.linalg.norm(mean))
        return out


def encoder(vectors: DataFrame) -> Callable[[list[str]], np.ndarray]:
    """An encoder from a table of vectors, whose size the fit's parameters bound: workers get it once each."""
    rows = vectors.orderBy(F.desc("n"), "word").collect()
    size = len(rows[0]["vector"]) if rows else 1
    model = WordVectors([r["word"] for r in rows], np.array([r["n"] for r in rows], np.float64), np.array([r["vector"] for r in rows]).reshape(len(rows), size))
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    return lambda texts: shared.value(texts)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The vectors that ``fit`` has stored at ``path``."""
    return spark.read.schema(VECTORS).parquet(f"{path}/vectors")
