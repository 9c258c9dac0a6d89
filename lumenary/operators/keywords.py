"""Keyphrases of single texts by statistical features, after the published YAKE method (Campos et al., 2020).

A word scores low (well) if it stands in capitals, early, often, in many sentences and next to few different
words. A phrase of up to ``size`` words combines its words' scores; phrases too like a better one go.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from statistics import median, pstdev

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.operators.topics import keyword_tags

STOPWORDS = frozenset(
    "a about above after again all also an and any are as at be because been before being below between both but by can could did do does "
    "down during each few for from further had has have having he her here his how i if in into is it its itself just may me more most my "
    "no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these "
    "they this those through to too under until up very was we were what when where which while who why will with would you your".split())
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_PIECE = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*|[^\w\s]")


def _plain(word: str) -> bool:
    return len(word) > 2 and word.lower() not in STOPWORDS and not word.isdigit()


def word_scores(sentences: list[list[str]]) -> dict[str, float]:
    count, capital, acronym, places = Counter(), Counter(), Counter(), defaultdict(list)
    left, right = defaultdict(Counter), defaultdict(Counter)
    for at, words in enumerate(sentences):
        for k, w in enumerate(words):
            if not w[0].isalnum():
                continue
            low = w.lower()
            count[low] += 1
            capital[low] += k > 0 and w[0].isupper()
            acronym[low] += len(w) > 1 and w.isupper()
            places[low].append(at)
            if k and words[k - 1][0].isalnum():
                left[low][words[k - 1].lower()] += 1
                right[words[k - 1].lower()][low] += 1
    kept = [n for w, n in count.items() if _plain(w)]
    usual, most = (sum(kept) / len(kept) + pstdev(kept), max(count.values())) if kept else (1.0, 1)
    out = {}
    for w, n in count.items():
        case = max(capital[w], acronym[w]) / (1 + math.log(n))
        place = math.log(math.log(3 + median(set(places[w]))))
        spread = sum(len(c[w]) / sum(c[w].values()) for c in (left, right) if c[w])
        relation = 1 + spread * n / most
        out[w] = relation * place / (case + (n / usual) / relation + (len(set(places[w])) / len(sentences)) / relation)
    return out


def keyphrases(text: str | None, size: int = 2, top: int = 20, alike: float = 0.7) -> list[tuple[str, float]]:
    """The ``top`` phrases in lower case, best (lowest score) first."""
    sentences = [p for s in _SENTENCE.split(text or "") if (p := _PIECE.findall(s))]
    score, count = word_scores(sentences) if sentences else {}, Counter()
    for words in sentences:
        for n in range(1, size + 1):
            for k in range(len(words) - n + 1):
                part = words[k : k + n]
                if all(w[0].isalnum() for w in part) and _plain(part[0]) and _plain(part[-1]):
                    count[" ".join(part).lower()] += 1
    value = {}
    for phrase, n in count.items():
        parts = [score[w] for w in phrase.split(" ")]
        value[phrase] = math.prod(parts) / (n * (1 + sum(parts)))
    out: list[tuple[str, float]] = []
    for phrase, v in sorted(value.items(), key=lambda x: (x[1], x[0])):
        if all(SequenceMatcher(None, phrase, other).ratio() <= alike for other, _ in out):
            out.append((phrase, v))
            if len(out) == top:
                break
    return out


def with_keyphrases(text: Column, size: int = 2, top: int = 20) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[p for p, _ in keyphrases(t, size, top)] for t in texts])

    return F.pandas_udf(run, "array<string>")(text)


def tags_with_keyphrases(text: Column, topics: list[tuple[str, str]] | None = None) -> Column:
    """Keyword tags where a phrase of a topic may stand in the text or in one of its keyphrases."""
    both = F.concat_ws("\n", text, F.array_join(with_keyphrases(text), "\n"))  # no topic phrase spans a line end
    return keyword_tags(both, topics or R.TOPICS)


#: What may stand between two words of a keyphrase other than the one blank that the phrase has there.
_OTHERWISE = re.compile(r"_|\s\s|[^\S ]")


def tags_of_keyphrases(text: str | None, topics: list[tuple[str, str]] | None = None) -> list[str]:
    """The tags of which a phrase of the description stands in a keyphrase of the text but may not stand in the text itself.

    A keyphrase is words that follow each other, with a blank between. Where the text has one blank between its words, the keyphrase is a part
    of it, and so is what stands in the keyphrase: then there is nothing to add, and no keyphrases are worked out."""
    if not text or not _OTHERWISE.search(text):
        return []
    phrases = [p for p, _ in keyphrases(text)]
    return [tag for tag, about in topics or R.TOPICS if any(part in p for part in about.lower().split(", ") for p in phrases)]
