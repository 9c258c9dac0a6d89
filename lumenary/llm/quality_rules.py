"""Quality rules: distribution divergence from language references, beside fixed base counts.

Two histograms describe a text: of character classes, and of common words (each of its language's common
words for itself, all others together). The references are the same histograms over all documents of each
language. A document fails where the Jensen-Shannon distance (base 2, 0 to 1) to the nearest language
reference is above a limit, if the text is long enough for the histogram to mean something.

Words are counted in ``BUCKETS`` hash buckets, so what a task gathers is bounded. A word is common in a
language if its bucket has at least ``COMMON`` of the language's words, so there are at most 1 / COMMON of
them. Every language with ``LEAST_WORDS`` words or more has a reference; documents labelled with a language that has none
are not held against the others'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.batches import Words, per_text, shingles, slices
from lumenary.llm.common import Scratch, table

BUCKETS, COMMON, LEAST_WORDS = 1 << 14, 0.002, 2000
LANGS_HELD = 64  # languages that a task counts before it hands on what it has
SYMBOLS = "#*$%&|<>"
LIMITS = {"chars": 0.3, "words": 0.42}
GUARDS = {"chars": 200, "words": 60}  # characters, words


def _class_table() -> np.ndarray:
    """The class of each byte: a multi-byte character counts once, by its first byte."""
    out = np.full(256, 9, np.uint8)
    for c in range(128):
        x = chr(c)
        out[c] = (0 if x in "aeiou" else 1 if "a" <= x <= "z" else 2 if "A" <= x <= "Z" else 3 if x.isdigit() else 4 if x == " "
                  else 5 if x == "\n" else 6 if x in ".,;:!?" else 7 if x in SYMBOLS else 8)
    out[128:192] = 10  # goes on
    return out


CHAR_CLASSES = 10
_class_of = _class_table()


def char_histograms(words: Words) -> np.ndarray:
    doc = np.repeat(np.arange(words.n), words.lengths + 1)
    cls = _class_of[words.data].astype(np.int64)
    out = np.bincount(doc * 11 + cls, minlength=words.n * 11).reshape(-1, 11)[:, :CHAR_CLASSES]
    out[:, 5] -= 1  # the line feed that ends each text here
    return out


def word_buckets(words: Words) -> np.ndarray:
    return (words.hashes() >> np.uint64(50)).astype(np.int64)


def base_counts(words: Words, texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; ``words`` must keep case."""
    cls, data = _class_of[words.data], words.data
    space = (data == 32) | ((data >= 9) & (data <= 13))
    dup = np.zeros(words.n, np.int64)
    for k, t in enumerate(texts):
        if t and "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
            dup[k] = len(lines) - len(set(lines))
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_text(words, ~space & (cls != 10)),
        "n_symbols": per_text(words, cls == 7),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(words),
    }


def repeated_words(words: Words, size: int = 3) -> np.ndarray:
    """Words of each text inside a window of ``size`` words that the text has twice or more."""
    h = words.hashes()
    if len(h) < size:
        return np.zeros(words.n, np.int64)
    w = shingles(h, size)
    doc = words.doc[: len(w)]
    inside = doc == words.doc[size - 1 :]
    key = np.where(inside, w ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
    _, which, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = inside & (n[which] > 1)
    hit = np.zeros(len(h), bool)
    for k in range(size):
        hit[k : k + len(w)] |= twice
    return np.bincount(words.doc, weights=hit, minlength=words.n).astype(np.int64)


def references(docs: DataFrame, most_langs: int = 1000) -> dict[str, dict[str, np.ndarray]]:
    """Of each language: ``chars``, ``common`` (buckets) and ``words`` (their shares, the rest's last).

    Counted over every row with a language. The ``most_langs`` languages of the most words have one, so at most
    (1 / COMMON + CHAR_CLASSES) * most_langs rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, np.ndarray] = {}
        tokens: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in slices(batch):
                own = np.array(langs[at : at + len(texts)], object)
                words = Words(texts, lower=False)
                hist, buckets = char_histograms(words), word_buckets(words)
                for lang in set(own):
                    mine = own == lang
                    chars[lang] = chars.get(lang, 0) + hist[mine].sum(axis=0)
                    tokens[lang] = tokens.get(lang, 0) + np.bincount(buckets[mine[words.doc]], minlength=BUCKETS)
                if len(chars) > LANGS_HELD:
                    yield from told(chars, tokens)
                    chars, tokens = {}, {}
        yield from told(chars, tokens)

    def told(chars: dict, tokens: dict) -> Iterator[pa.RecordBatch]:
        for lang in chars:
            keys = np.flatnonzero(tokens[lang])
            for kind, key, n in ((0, np.arange(CHAR_CLASSES), chars[lang]), (1, keys, tokens[lang][keys])):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "kind", "key", "n"])

    some = docs.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = some.mapInArrow(count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counts = Scratch(docs.sparkSession, "references").keep(counts)
    totals = counts.filter("kind = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    totals = totals.filter(F.col("total") >= LEAST_WORDS).orderBy(F.desc("total"), "lang").limit(most_langs)
    out: dict[str, dict] = {}
    for r in counts.join(F.broadcast(totals), "lang").filter(f"kind = 0 or n >= {COMMON} * total").collect():
        at = out.setdefault(r["lang"], {"chars": np.zeros(CHAR_CLASSES), "found": {}, "total": r["total"]})
        if r["kind"] == 0:
            at["chars"][r["key"]] = r["n"]
        else:
            at["found"][r["key"]] = r["n"]
    return {lang: reference(x["chars"], x["found"], x["total"]) for lang, x in sorted(out.items())}


def reference(chars: np.ndarray, found: dict[int, int], total: int) -> dict[str, np.ndarray]:
    common = np.array(sorted(found), np.int64)
    n = np.array([found[k] for k in common], float)
    return {"chars": chars / max(1, chars.sum()), "common": common, "words": np.append(n, total - n.sum()) / max(1, total)}


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distance of each row of shares ``p`` to ``q``."""
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(axis=-1)

    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def divergences(words: Words, refs: dict[str, dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, words): each text's distance to the nearest reference; 0 without references."""
    hist, buckets = char_histograms(words), word_buckets(words)
    share = hist / np.maximum(1, hist.sum(axis=1, keepdims=True))
    chars, toks = np.full(words.n, 1.0), np.full(words.n, 1.0)
    for ref in refs.values():
        width = len(ref["common"]) + 1
        at = np.minimum(np.searchsorted(ref["common"], buckets), max(0, width - 2))
        place = np.where(ref["common"][at] == buckets, at, width - 1) if width > 1 else np.zeros(len(buckets), np.int64)
        n = np.bincount(words.doc * width + place, minlength=words.n * width).reshape(-1, width)
        chars = np.minimum(chars, jensen_shannon(share, ref["chars"]))
        toks = np.minimum(toks, jensen_shannon(n / np.maximum(1, words.counts)[:, None], ref["words"]))
    return (chars, toks) if refs else (np.zeros(words.n), np.zeros(words.n))


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, chars_distance double, words_distance double")


def judged(docs: DataFrame, refs: dict[str, dict[str, np.ndarray]], limits: dict = LIMITS, guards: dict = GUARDS) -> DataFrame:
    """The base counts and the verdict for each row of ``docs`` (doc_id, text and, if it is there, lang).

    Null and empty texts have no words and fail the base; texts shorter than a guard are not held against
    that histogram; repeated rows each get their row; without references, and for a lang that is not null and has none,
    nothing diverges; an empty table gives an empty result; other columns are not read."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            foreign = np.array([x is not None and x not in refs for x in batch.column("lang").to_pylist()], bool)
            for at, texts in slices(batch):
                words = Words(texts, lower=False)
                base = base_counts(words, texts)
                chars, toks = (np.where(foreign[at : at + len(texts)], 0.0, x) for x in divergences(words, refs))
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                far = ((chars > limits["chars"]) & (base["word_chars"] >= guards["chars"])) | ((toks > limits["words"]) & (base["n_words"] >= guards["words"]))
                values = {"doc_id": ids.slice(at, len(texts)), **base, "base_failed": failed, "kept": ~failed & ~far, "chars_distance": chars, "words_distance": toks}
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values.values()], list(values))

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).mapInArrow(judge, SCHEMA)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, references(docs))
