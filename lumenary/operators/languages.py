"""Language detection by naive Bayes, over runs of letters or over word beginnings.

``trained`` counts runs of one to three letters in labelled texts, smoothed for what a language's texts do not hold; ``judge`` takes
these profiles to the worker, where each text's runs update the odds of the languages, batch by batch and without a shuffle.

``profile`` and ``detected`` go by word beginnings, as a join of all words of a table with profiles of a bounded size, and a sum.

Without labelled texts ``detector`` judges by the frequent words of the languages in the rules, or by the script.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.functions.text import SPACE
from lumenary.operators.embedding import words_of

PROFILE = 300


def _starts(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), rf"{SPACE}+"), lambda w: w != ""), lambda w: F.substring(w, 1, 3))


def profile(labelled: DataFrame, text: str, lang: str, size: int = PROFILE, most_langs: int = 200) -> DataFrame:
    """lang, start and weight: the logarithm of the share of each of a language's ``size`` most frequent beginnings, for the
    ``most_langs`` languages of the most beginnings; so it has size * most_langs rows at most."""
    counts = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(_starts(F.col(text))).alias("start")).groupBy("lang", "start").agg(F.count("*").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").limit(most_langs)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "start")
    kept = counts.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= size)
    return kept.join(F.broadcast(total), "lang").select("lang", "start", F.log((F.col("n") + 1) / (F.col("total") + 1)).alias("weight"))


def detected(texts: DataFrame, key: str, text: str, profiles: DataFrame) -> DataFrame:
    """key and language; unknown for texts under LANGUAGE_MIN_CHARS and those that no profile knows a beginning of.

    A beginning that a profile lacks weighs ln(1e-5). Words meet the profiles (of bounded size) in the task that reads the text, and
    are summed there: a row for each language of a text is all that is shuffled."""
    enough = texts.filter(F.length(text) >= R.LANGUAGE_MIN_CHARS)
    starts = enough.select(key, F.explode(_starts(F.col(text))).alias("start"))
    gain = starts.join(F.broadcast(profiles), "start").groupBy(key, "lang").agg(F.sum(F.col("weight") - F.log(F.lit(1e-5))).alias("gain"))
    best = gain.groupBy(key).agg(F.max(F.struct(F.round("gain", 6).alias("gain"), F.col("lang").alias("lang"))).alias("best"))
    return texts.select(key).join(best, key, "left").select(key, F.coalesce("best.lang", F.lit(R.UNKNOWN)).alias("language"))


def word_gains() -> list[tuple[str, str, float]]:
    """(word, language, gain) of the frequent words: the logarithm of a share that falls with the rank, over that of a missing word."""
    out = []
    for lang, words in R.LANGUAGE_WORDS.items():
        ranked = words.split()
        total = sum(1 / (r + 2) for r in range(len(ranked)))
        out += [(word, lang, log(1 / (r + 2) / total) - log(1e-5)) for r, word in enumerate(ranked)]
    return out


def detector() -> Callable[[str | None], str]:
    """A function from a text to its language."""
    gains: dict[str, list[tuple[str, float]]] = {}
    for word, lang, gain in word_gains():
        gains.setdefault(word, []).append((lang, gain))
    scripts = {lang: re.compile(f"[{chars}]") for lang, chars in R.LANGUAGE_SCRIPTS.items()}
    first = min(chars[0] for chars in R.LANGUAGE_SCRIPTS.values())

    def judge(text: str | None) -> str:
        if len(text or "") < R.LANGUAGE_MIN_CHARS:
            return R.UNKNOWN
        if max(text) >= first:  # else no script but Latin
            letters = sum(c.isalpha() for c in text)
            written = {lang: len(chars.findall(text)) for lang, chars in scripts.items()}
            if written["ja"] * 10 >= written["zh-cn"]:  # Japanese mixes its own signs with Chinese ones
                written["ja"], written["zh-cn"] = written["ja"] and written["ja"] + written["zh-cn"], 0 if written["ja"] else written["zh-cn"]
            lang, n = max(written.items(), key=lambda x: x[1])
            if 2 * n > letters:
                return lang
        sums: dict[str, float] = {}
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            for lang, gain in gains.get(word, ()):
                sums[lang] = sums.get(lang, 0.0) + gain
        return max(sums, key=lambda lang: (round(sums[lang], 6), lang)) if sums else R.UNKNOWN

    return judge


def detected_in(text: Column) -> Column:
    """The language of ``text``; unknown under LANGUAGE_MIN_CHARS and where no frequent word and no script tells."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = detector()
        for texts in batches:
            yield pd.Series([judge(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


#: Letters of a run at most; the share of a run that no text of a language has, in SHARES-ths; runs below the least share are not kept.
RUN, SHARES, UNSEEN, LEAST_SHARE = 3, 10_000, 0.5, 2e-6
HELD = 100_000  # words that a task keeps at once
GRAMS = "lang string, run bigint, gain double"


def runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(run, text): the runs of up to RUN letters of texts of plain words, as one number each. Words begin and end with a blank, which is
    a letter of a run but never alone or inside one."""
    padded = [f" {t} " if t else "" for t in texts]
    letters = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    blank, out, of = letters == 32, [], []
    for n in range(1, RUN + 1):
        code, good = np.zeros(max(0, len(letters) - n + 1), np.int64), np.ones(max(0, len(letters) - n + 1), bool)
        for k in range(n):
            part = slice(k, len(letters) - n + 1 + k)
            code |= letters[part] << (21 * k)
            if n == 1 or 0 < k < n - 1:
                good &= ~blank[part]
        good &= text[: len(code)] == text[n - 1 :][: len(code)]
        out.append(code[good])
        of.append(text[: len(code)][good])
    return np.concatenate(out), np.concatenate(of)


def counted_runs(words: list[str], times: np.ndarray, most: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """(run, how often) over ``words`` that stand so many ``times``: counted by place where their letters are few, else sorted."""
    letters = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    known = np.flatnonzero(np.bincount(letters))  # the blank is the first
    if len(known) ** RUN > most or known[0] != 32:
        code, of = runs(words)
        code, place = np.unique(code, return_inverse=True)
        return code, np.bincount(place, times[of], len(code)).astype(np.int64)
    number = np.zeros(int(known[-1]) + 1, np.int64)
    number[known] = np.arange(len(known))
    at, n_of = number[letters], np.repeat(times, np.fromiter(map(len, words), np.int64, len(words)) + 2)
    out, counts = [], []
    for n in range(1, RUN + 1):
        end = len(at) - n + 1
        code, good = np.zeros(end, np.int64), np.ones(end, bool)
        for k in range(n):
            code = code * len(known) + at[k : end + k]
            if n == 1 or 0 < k < n - 1:
                good &= at[k : end + k] > 0
        if n == 2:
            good &= (at[:end] > 0) | (at[1:] > 0)  # two blanks stand between words
        elif n == 3:
            good &= (at[:end] > 0) | (at[1 : end + 1] > 0)
        total = np.bincount(code[good], n_of[:end][good], len(known) ** n).astype(np.int64)
        some = np.flatnonzero(total)
        out.append(sum(known[some // len(known) ** (n - 1 - k) % len(known)] << (21 * k) for k in range(n)))
        counts.append(total[some])
    return np.concatenate(out), np.concatenate(counts)


def trained(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, run, gain of each run of letters in the labelled texts: the logarithm of its share among the language's runs of that length, over
    that of a run no text of it has. Words, then their runs, are summed in the task that reads them; shares have a least value, so a language has 3 / LEAST_SHARE
    runs at most. Texts without a label or words have no part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, counted in words.items():
                if not counted:
                    continue
                code, n = counted_runs(list(counted), np.fromiter(counted.values(), np.int64, len(counted)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], ["lang", "run", "n"])
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, words.values())) > HELD:
                    yield from told()
        yield from told()

    texts = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = texts.mapInArrow(count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    length = F.when(F.col("run") < 1 << 21, 1).when(F.col("run") < 1 << 42, 2).otherwise(3)
    counts = counts.withColumn("length", length)
    total = counts.groupBy("lang", "length").agg(F.sum("n").alias("total"))  # three rows a language
    share = F.col("n") / F.col("total")
    return (counts.join(F.broadcast(total), ["lang", "length"]).filter(share >= LEAST_SHARE)
            .select("lang", "run", F.log(1 + share * (SHARES / UNSEEN)).alias("gain")))


class Profiles:
    """Judges texts by the profiles that ``trained`` gives."""

    def __init__(self, rows: list[tuple[str, int, float]]):
        self.langs = sorted({r[0] for r in rows}, reverse=True)  # of languages that tie the last by name
        place = {lang: k for k, lang in enumerate(self.langs)}
        self.runs, of = np.unique(np.array([r[1] for r in rows], np.int64), return_inverse=True)
        self.gains = np.zeros((len(self.runs), len(self.langs)))
        self.gains[of, [place[r[0]] for r in rows]] = [r[2] for r in rows]

        self.known: dict[str, int] = {}  # words seen of late, by row of what they gain
        self.of_words = np.zeros((0, len(self.langs)))

    def _gains(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > HELD:
            self.known, self.of_words, new = {}, self.of_words[:0], list(dict.fromkeys(words))
        if new:
            code, of = runs(new)
            place = np.minimum(np.searchsorted(self.runs, code), len(self.runs) - 1)
            there = self.runs[place] == code
            gains = np.stack([np.bincount(of[there], self.gains[place[there], k], len(new)) for k in range(len(self.langs))], axis=1)
            self.known.update((w, len(self.of_words) + k) for k, w in enumerate(new))
            self.of_words = np.concatenate([self.of_words, gains])
        return self.of_words[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def __call__(self, texts: list[str | None], most: int = 1 << 20) -> list[str]:
        """The language of each text; unknown where no run is known. Texts are taken some at a time."""
        out, at = [R.UNKNOWN] * len(texts), 0
        while at < len(texts) and self.langs:
            to, size, words, first, of = at, 0, [], [], []
            while to < len(texts) and (to == at or size < most):
                if found := words_of(texts[to]):
                    of.append(to)
                    first.append(len(words))
                    words += found
                    size += len(texts[to])
                to += 1
            if words:
                sums = np.add.reduceat(self._gains(words), first, axis=0).round(6)
                for k, best, most_gained in zip(of, sums.argmax(axis=1), sums.max(axis=1), strict=True):
                    if most_gained > 0:
                        out[k] = self.langs[best]
            at = to
        return out


def judge(profiles: DataFrame) -> Callable[[list[str | None]], list[str]]:
    """A function from texts to their languages; the profiles, of a bounded size, go to each worker once."""
    shared = profiles.sparkSession.sparkContext.broadcast(Profiles([tuple(r) for r in profiles.select("lang", "run", "gain").collect()]))
    return lambda texts: shared.value(texts)


def judged_language(text: Column, judges: Callable[[list[str | None]], list[str]]) -> Column:
    """The language of ``text``; unknown under LANGUAGE_MIN_CHARS and where no run of letters is known."""

    @F.arrow_udf("string")
    def told(words: pa.Array) -> pa.Array:
        return pa.array(judges(words.to_pylist()), pa.string())

    return told(long_enough(text))


def long_enough(text: Column) -> Column:
    return F.when(F.length(text) >= R.LANGUAGE_MIN_CHARS, text)
