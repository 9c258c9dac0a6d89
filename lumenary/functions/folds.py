"""Order-dependent folds over the sections of a record, each within its row."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.functions.text import bound, sentences, strip

_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def _not_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


#: Letters by which places are ordered, and places from which the least is taken; letters of keys from there on.
GRAM, CHOICE, KEYS = 4, 12, (4, 16, 48)
SHORTEST = GRAM + CHOICE - 1


def drop_near_duplicates(sections: Column, fold: Callable[[Column], Column] = lambda s: strip(F.lower(s)), indexed: int | None = None) -> Column:
    """Keeps a section unless an earlier kept one equals it or, within NEAR_DUPLICATE_CHARS in length, contains it
    or stands in it; compared in lower case, or as ``fold`` has it.

    Each is folded and measured once; the fold holds the places of those kept and no texts, as it is copied at every step. Sections that are
    not near in length cost a comparison of two numbers, of others the longer is searched for the shorter. Records of ``indexed`` sections or
    more go to Python, where ``first_of_each`` finds in an index what to compare with."""
    measured = F.transform(sections, lambda s: bound(fold(s), lambda n: F.struct(n.alias("n"), F.length(n).alias("l"), s.alias("s"))))

    def like(k: Column, c: Column) -> Column:
        return (F.abs(k["l"] - c["l"]) < R.NEAR_DUPLICATE_CHARS) & F.when(k["l"] >= c["l"], F.contains(k["n"], c["n"])).otherwise(F.contains(c["n"], k["n"]))

    def pairwise(m: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(m)), lambda i: i < F.size(m))
        return F.aggregate(places, F.array().cast("array<int>"),
                           lambda acc, i: bound(F.get(m, i), lambda c: F.when(F.exists(acc, lambda k: like(F.get(m, k), c)), acc).otherwise(F.array_append(acc, i))))

    if indexed is None:
        return bound(measured, lambda m: F.transform(pairwise(m), lambda i: F.get(m, i)["s"]))

    @F.arrow_udf("array<int>")
    def places(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else first_of_each(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    long = F.size(sections) >= indexed
    found = places(F.when(long, F.transform(sections, fold)))
    return F.when(long, F.transform(found, lambda i: F.get(sections, i))).otherwise(
        bound(measured, lambda m: F.transform(pairwise(m), lambda i: F.get(m, i)["s"])))


def _keys(text: str, near: int) -> set[str | None]:
    """From the least place of each of the first windows on, as many letters as all texts have from there that are near enough in length to
    contain this one or stand in it; of several lengths where no one serves all."""
    n = len(text)
    order = [zlib.crc32(text[k : k + GRAM].encode("utf-8", "surrogatepass")) for k in range(min(n - GRAM + 1, near + CHOICE - 1))]
    places = {k + (part := order[k : k + CHOICE]).index(min(part)) for k in range(len(order) - CHOICE + 1)}
    lengths = [e for e, longer in zip(KEYS, (*KEYS[1:], None), strict=True) if n >= CHOICE - 1 + e and (longer is None or n - near + 1 < CHOICE - 1 + longer)]
    return {text[p : p + e] for e in lengths for p in places if p + e <= n}


def first_of_each(texts: list[str], near: int = R.NEAR_DUPLICATE_CHARS) -> list[int]:
    """The places of the folded sections that stay. One that contains another, and is less than ``near`` longer, holds the other's beginning
    at one of its first places, so the key of that beginning is among its own: only sections that share a key are
    compared. Those too short for one, and those that may contain such if there are any, share one too."""
    index: dict[str | None, list[str]] = {}
    out, seen, short = [], set(), any(len(t) < SHORTEST for t in texts)
    for i, text in enumerate(texts):
        if text in seen:
            continue
        keys = _keys(text, near) | ({None} if short and len(text) < SHORTEST + near else set())
        if not any(abs(len(k) - len(text)) < near and (k in text or text in k) for a in keys for k in index.get(a, ())):
            seen.add(text)
            out.append(i)
            for a in keys:
                index.setdefault(a, []).append(text)
    return out


def merge_short(chunks: Column, least: int = R.MIN_CHUNK) -> Column:
    """Appends the next chunk while the one being built is under ``least`` characters; the last is kept as it is."""
    return bound(chunks, lambda parts: F.when(F.size(parts) > 0, F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(_none().alias("out"), F.get(parts, F.lit(0)).alias("buf")),
        lambda a, c: F.when(
            F.length(a["buf"]) < least, F.struct(a["out"].alias("out"), F.concat(a["buf"], F.lit(" "), c).alias("buf")),
        ).otherwise(F.struct(F.array_append(a["out"], a["buf"]).alias("out"), c.alias("buf"))),
        lambda a: F.array_append(a["out"], a["buf"]))).otherwise(parts))


def split_long(chunks: Column, most: int = R.MAX_CHUNK) -> Column:
    """Packs the sentences of each chunk over ``most`` characters into pieces up to it; a longer sentence stays whole."""

    def packed(chunk: Column) -> Column:
        return F.aggregate(
            sentences(chunk), F.struct(_none().alias("out"), F.lit("").alias("buf")),
            lambda a, s: F.when(
                (F.length(a["buf"]) + F.length(s) + 1 > most) & (a["buf"] != ""),
                F.struct(F.array_append(a["out"], strip(a["buf"])).alias("out"), s.alias("buf")),
            ).otherwise(F.struct(a["out"].alias("out"), F.concat(a["buf"], F.lit(" "), s).alias("buf"))),
            lambda a: F.when(strip(a["buf"]) != "", F.array_append(a["out"], strip(a["buf"]))).otherwise(a["out"]))

    return F.flatten(F.transform(chunks, lambda c: F.when(F.length(c) <= most, F.array(c)).otherwise(packed(c))))


def sentence_groups(sections: Column, size: int = R.SENTENCES_PER_GROUP) -> Column:
    """The sentences of each section, ``size`` to a chunk."""

    def grouped(parts: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(size))
        return F.when(F.size(parts) > 0, F.transform(starts, lambda i: F.array_join(F.slice(parts, i + 1, F.lit(size)), " "))).otherwise(_none())

    return F.flatten(F.transform(sections, lambda s: bound(sentences(s), grouped)))


def merge_transcript(segments: Column, block: int = R.TRANSCRIPT_BLOCK) -> Column:
    """Joins segments until the running block, each preceded by a blank, is longer than ``block``."""
    return F.aggregate(
        F.filter(segments, lambda s: strip(s) != ""), F.struct(_none().alias("out"), F.lit("").alias("buf")),
        lambda a, s: F.when(
            F.length(a["buf"]) + 1 + F.length(s) > block,
            F.struct(F.array_append(a["out"], strip(F.concat(a["buf"], F.lit(" "), s))).alias("out"), F.lit("").alias("buf")),
        ).otherwise(F.struct(a["out"].alias("out"), F.concat(a["buf"], F.lit(" "), s).alias("buf"))),
        lambda a: F.when(strip(a["buf"]) != "", F.array_append(a["out"], strip(a["buf"]))).otherwise(a["out"]))


def content_chunks(sections: Column, source_type: Column) -> Column:
    """The chunks of a record: sentence groups for abstracts, sections otherwise, then short ones merged and long ones split."""
    parts = F.when(source_type == "pubmed", sentence_groups(sections)).otherwise(F.filter(sections, lambda s: strip(s) != ""))
    return _not_blank(split_long(merge_short(F.coalesce(parts, _none()))))
