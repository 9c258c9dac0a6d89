"""Topic tags: vocabulary terms in the text, and nearest topic vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.functions.text import contains_any


def keyword_tags(text: Column, topics: list[tuple[str, str]] | None = None) -> Column:
    """The tags, in vocabulary order, of which the tag or a phrase of the description stands in the text, also inside words."""
    low = F.lower(text)
    # No higher-order function: compiled as a whole, with the lower case worked out once.
    tags = [F.when(contains_any(low, [tag.lower(), *about.lower().split(", ")]), F.lit(tag)).otherwise("") for tag, about in topics or R.TOPICS]
    return F.array_remove(F.array(*tags), "")


class Phrases:
    """All phrases of the topics as one automaton, which passes over a text once, whatever their number."""

    def __init__(self, topics: list[tuple[str, str]]):
        self.names = [tag for tag, _ in topics]
        self.tags: dict[str, int] = {}  # of each phrase, as bits
        for k, (tag, about) in enumerate(topics):
            for phrase in (tag.lower(), *about.lower().split(", ")):
                self.tags[phrase] = self.tags.get(phrase, 0) | 1 << k
        always = self.tags.pop("", 0)  # the empty phrase stands in every text
        self.always, self.every = always, (1 << len(topics)) - 1
        try:
            import ahocorasick
        except ImportError:
            # The longest phrase from each place on, with the tags of all phrases that begin it.
            longest = sorted(self.tags, key=len, reverse=True)
            begun = {p: sum(1 << k for k in range(len(topics)) if any(self.tags[q] >> k & 1 for q in longest if p.startswith(q))) for p in longest}
            pattern = re.compile(f"(?=({'|'.join(map(re.escape, longest))}))") if longest else None
            self.matches = lambda text: (begun[m[1]] for m in pattern.finditer(text)) if pattern else ()
        else:
            automaton = ahocorasick.Automaton()
            for phrase, tags in self.tags.items():
                automaton.add_word(phrase, tags)
            automaton.make_automaton()
            self.matches = (lambda text: (tags for _, tags in automaton.iter(text))) if self.tags else lambda text: ()

    def __call__(self, text: str | None) -> list[str]:
        """The tags, in vocabulary order, of a text in lower case; it is left as soon as all are found."""
        if text is None:
            return []
        found = self.always
        for tags in self.matches(text):
            found |= tags
            if found == self.every:
                break
        return [name for k, name in enumerate(self.names) if found >> k & 1]


_phrases: dict[tuple, Phrases] = {}


def phrase_tags(text: Column, topics: list[tuple[str, str]] | None = None) -> Column:
    """As ``keyword_tags``, for long texts and large vocabularies: one pass over each text, in batches, where that one searches
    for a phrase at a time."""
    topics = tuple(map(tuple, topics or R.TOPICS))

    @F.arrow_udf("array<string>")
    def tags(texts: pa.Array) -> pa.Array:
        if topics not in _phrases:
            _phrases[topics] = Phrases(list(topics))
        look = _phrases[topics]
        return pa.array([look(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return tags(F.lower(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where one is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def top_k(similarities: Column, k: int = R.TOP_K_TAGS, threshold: float = R.SIMILARITY_THRESHOLD) -> Column:
    """The places (from 0) of the k largest of at least ``threshold``, largest first; of equals the later place first."""
    pairs = F.transform(similarities, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    best = F.sort_array(F.filter(pairs, lambda p: p["s"] >= threshold), asc=False)
    return F.transform(F.slice(best, 1, k), lambda p: p["i"])


def merged_tags(semantic: Column, keyword: Column, most: int = R.TOP_K_TAGS) -> Column:
    return F.slice(F.array_union(semantic, keyword), 1, most)


Encoder = Callable[[list[str]], np.ndarray]


def hashed_encoder(dim: int = 384) -> Encoder:
    """Unit vectors of hashed words and letter trigrams: an encoder that needs no model file."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                for part in (word, *(f"#{word}#"[i : i + 3] for i in range(len(word)))):
                    h = zlib.crc32(part.encode())
                    row[h % dim] += 1.0 if h >> 31 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return encode


def embedded(text: Column, encoder: Encoder | None = None) -> Column:
    """Vectors of texts, encoded batch by batch; an encoder is made once per worker by its caller."""
    encode = encoder or hashed_encoder()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encode([t or "" for t in texts]).astype(float)))

    return F.pandas_udf(run, "array<double>")(text)


def nearest(encoder: Encoder | None = None, topics: list[tuple[str, str]] | None = None,
            k: int = R.TOP_K_TAGS, threshold: float = R.SIMILARITY_THRESHOLD) -> Callable[[list[str | None]], list[list[str]]]:
    """A function from texts to the tags of the nearest topic descriptions; one matrix product per call."""
    topics, encode = topics or R.TOPICS, encoder or hashed_encoder()
    names, matrix = [t for t, _ in topics], encode([about for _, about in topics])

    def tags(texts: list[str | None]) -> list[list[str]]:
        sims = encode([t or "" for t in texts]) @ matrix.T
        order = np.argsort(sims, axis=1, kind="stable")[:, ::-1][:, :k]
        return [[names[i] for i in row if s[i] >= threshold] if t else [] for row, s, t in zip(order, sims, texts, strict=True)]

    return tags


def semantic_tags(text: Column, encoder: Encoder | None = None, topics: list[tuple[str, str]] | None = None,
                  k: int = R.TOP_K_TAGS, threshold: float = R.SIMILARITY_THRESHOLD) -> Column:
    """The tags of the nearest topic descriptions; one matrix product per batch of texts."""
    tags = nearest(encoder, topics, k, threshold)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(tags(list(texts)))

    return F.pandas_udf(run, "array<string>")(text)
