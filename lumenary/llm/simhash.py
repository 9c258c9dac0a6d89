"""SimHash near duplicates by bit-sliced comparison.

A fingerprint holds the majority of each bit over the hashes of a text's shingles. Equal fingerprints fall together first, so
that only distinct ones are compared. Two that differ in at most r bits agree on two of r + 2 bands of bits at least: every
fingerprint goes to a block for each two bands, by their bits. A block of too many members is cut further, by two of r + 2
bands of the bits that are still free, until it is small or so few bits are free that their values bound it. Within a block
bit planes stand vertically, 64 fingerprints a word: one query bit against a plane tells 64 differences at once, carry-save
counters add them up two planes at a time, and words all of whose lanes exceed the radius are abandoned on the way. A block
tells only links that connect what it has not connected yet; components over these links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.batches import columns, slices
from lumenary.llm.common import Scratch, small_side, table
from lumenary.llm.components import components

BITS = 64
#: Members from which a block is cut further, as long as more than ``FREE`` of its bits are free.
BLOCK, FREE = 512, 16
#: Words compared at a time, and planes after which lanes beyond the radius are looked for.
CHUNK, STRIDE = 1 << 15, 8


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``size`` words of the lower-cased text, repeats included; of all of them where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six white space characters
    if not words:
        return
    size, joined = min(size, len(words)), b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts, ends, hashed = [0, *[e + 1 for e in ends[:-1]]], ends[size - 1 :], xxhash.xxh64_intdigest
    for at in range(0, len(ends), 1 << 16):
        yield np.array([hashed(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=False)], np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """Bit k is one if it is in more than half of the hashes; zero for a text without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, size):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (as a signed long) of every row; texts go through in slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch):
                fp = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
                yield columns(doc_id=batch.column("doc_id").slice(at, len(texts)), fp=fp)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def masks(fixed: int, radius: int) -> list[int]:
    """``fixed`` and two of ``radius`` + 2 bands of the other bits, each way: two values that agree on ``fixed`` and differ in
    ``radius`` bits at most agree on one of these."""
    free = [b for b in range(BITS) if not fixed >> b & 1]
    cuts = [len(free) * k // (radius + 2) for k in range(radius + 3)]
    bands = [sum(1 << b for b in free[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return list(dict.fromkeys(fixed | a | b for a, b in combinations(bands, 2)))


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def in_blocks(fps: DataFrame, radius: int, block: int, scratch: Scratch) -> DataFrame:
    """mask, bits and fp: every fingerprint of ``fps`` (fp, distinct) in each of its blocks, which are small or of few free bits."""

    def keyed(rows: DataFrame, by: dict[int, list[int]]) -> DataFrame:
        """``rows`` (mask, fp) in the blocks of the masks that follow from their own."""
        ways = [F.when(F.col("mask") == signed(m), F.array(*[F.struct(F.lit(signed(k)).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(k))).alias("v")) for k in nxt]))
                for m, nxt in by.items()]
        to = rows.withColumn("to", F.explode(F.coalesce(*ways)))
        return to.select(F.col("to.m").alias("mask"), F.col("to.v").alias("bits"), "fp")

    level = masks(0, radius)
    rows, out = keyed(fps.select(F.lit(0).cast("long").alias("mask"), "fp"), {0: level}), None
    while level and BITS - level[0].bit_count() > FREE:
        heavy = scratch.keep(rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > block).select(F.col("mask").alias("hm"), F.col("bits").alias("hb")))
        n = heavy.count()
        if not n:
            break
        found = (F.col("mask") == F.col("hm")) & (F.col("bits") == F.col("hb"))
        done = rows.join(small_side(heavy, n), found, "left_anti")
        out = done if out is None else out.unionByName(done)
        cut = {m: masks(m, radius) for m in level}
        rows = keyed(rows.join(small_side(heavy, n), found, "left_semi").select("mask", "fp"), cut).distinct()
        level = sorted({k for nxt in cut.values() for k in nxt}, key=int.bit_count)
    return rows if out is None else out.unionByName(rows)


class Forest:
    """Connected rows, each with the smallest of its tree; ``join`` takes arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up


def near(fps: np.ndarray, first: np.ndarray, radius: int) -> Forest:
    """Connects the ``fps`` within ``radius`` of each other in one block; ``first`` has where each block begins."""
    n = len(fps)
    size = np.diff(np.append(first, n))
    words = -(-size // 64)  # every block has words of its own
    word0 = np.concatenate([[0], np.cumsum(words)])
    block = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - first[block]
    lane = word0[block] * 64 + place
    row_of = np.full(int(word0[-1]) * 64, -1, np.int64)
    row_of[lane] = np.arange(n)
    flat, planes = np.zeros(len(row_of), np.uint8), np.empty((BITS, int(word0[-1])), np.uint64)
    for b in range(BITS):
        flat[lane] = (fps >> np.uint64(b)) & np.uint64(1)
        planes[b] = np.packbits(flat, bitorder="little").view("<u8")
    flat[:] = 0
    flat[lane] = 1
    there = np.packbits(flat, bitorder="little").view("<u8")
    forest = Forest(n)
    own = lane // 64
    todo = (word0[block + 1] - own)  # words from a row's own one to the last of its block
    ends = np.cumsum(todo)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        query = np.repeat(np.arange(at, to), todo[at:to])
        word = np.arange(len(query)) - np.repeat(np.cumsum(todo[at:to]) - todo[at:to], todo[at:to]) + own[query]
        # Of the row's own word the lanes after it.
        later = np.where(word == own[query], ~((np.uint64(2) << (lane[query] % 64).astype(np.uint64)) - np.uint64(1)), ~np.uint64(0))
        query, word, alive = within(fps, planes, query, word, there[word] & later, radius)
        k, bit = np.nonzero(np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        forest.join(query[k], row_of[word[k] * 64 + bit])
        at = to
    return forest


def within(fps: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (query, word) of which lanes are within the radius, and these lanes, of those that are ``alive``."""
    deep = radius.bit_length()
    order = [b for low in range(BITS // 4) for b in range(low, BITS, BITS // 4)]  # bits of different bands in turn, as those of a block's own bands tell nothing
    some = np.flatnonzero(alive)
    query, word, alive = query[some], word[some], alive[some]
    counters = [np.zeros(len(query), np.uint64) for _ in range(deep)]
    over = np.zeros(len(query), np.uint64)
    value = fps[query]
    for k in range(0, BITS, 2):
        x, y = (planes[b][word] ^ (np.uint64(0) - ((value >> np.uint64(b)) & np.uint64(1))) for b in order[k : k + 2])
        half = counters[0] ^ x
        carry = (counters[0] & x) | (half & y)
        counters[0] = half ^ y
        for c in range(1, deep):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        over |= carry
        if (k + 2) % STRIDE == 0:
            beyond, equal = over.copy(), ~over
            for c in reversed(range(deep)):
                if radius >> c & 1:
                    equal &= counters[c]
                else:
                    beyond |= equal & counters[c]
                    equal &= ~counters[c]
            alive = alive & ~beyond
            some = np.flatnonzero(alive)
            if len(some) < len(alive):
                query, word, alive, over, value = query[some], word[some], alive[some], over[some], value[some]
                counters = [c[some] for c in counters]
            if not len(some):
                break
    return query, word, alive


def links_in(blocks: DataFrame, radius: int) -> DataFrame:
    """a and b of each link that connects fingerprints of a block (mask, bits, fp) that were not yet connected there."""
    dealt = blocks.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")

    def told(mask: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])))
        alone = np.repeat(np.diff(np.append(new, len(fp))) == 1, np.diff(np.append(new, len(fp))))
        kept = np.flatnonzero(~alone)
        if not len(kept):
            return columns(a=np.zeros(0, np.int64), b=np.zeros(0, np.int64))
        mask, bits, fp = mask[kept], bits[kept], fp[kept]
        first = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])))
        root = near(fp.view(np.uint64), first, radius).root
        linked = np.flatnonzero(root != np.arange(len(root)))
        return columns(a=fp[linked], b=fp[root[linked]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            got = [batch.column(c).to_numpy() for c in ("mask", "bits", "fp")]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            mask, bits, _ = held
            last = int(np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])))[-1]) if len(mask) else 0
            if last:  # whole blocks go; the last one may go on
                yield told(*[x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield told(*held)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (the smallest doc_id that links reach) of every row.

    Null, empty and wordless texts have fingerprint zero and link like any other; texts of fewer words than a shingle are one
    shingle; a row without doc_id has a fingerprint, and belongs to its group without naming it (a group of none but such rows has no
    component_id); repeated rows each have their row; an empty table gives an empty result; other columns are not read."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, size))
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    n = classes.count()
    links = scratch.keep(links_in(in_blocks(classes.select("fp"), radius, block, scratch), radius))
    labels = components(links, scratch)
    groups = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("label", "fp").alias("group"))
    least = groups.groupBy("group").agg(F.min("rep").alias("component_id")).withColumnRenamed("group", "g")
    named = scratch.keep(groups.join(least, F.col("group") == F.col("g")).select(F.col("fp").alias("of"), "component_id"), n)
    scratch.drop_all_but(rows, named)
    return rows.join(small_side(named, n), F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)
