"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes of its distinct word shingles. Documents with one set are one class, and
the join runs over classes. Shingles are ordered rare ones first; a shingle is frequent if its bucket in a
fixed-size count over the whole corpus stands out. Let a set of n shingles miss at most d of them in any
set that it may link with. Its prefix is extended until it holds d + 1 signatures' worth of shingles: each
rare shingle counts one and is indexed alone; frequent shingles are dealt into groups by hash, of which
each counts one less than it holds, and are indexed as pairs within their group. Whatever d shingles are
missing, two linked sets then share a single or a pair (the shorter prefix lies in the other one wherever
they agree). The number of groups goes with the size class of the pair, so that groups hold few shingles;
a set is indexed for its own class and the next.

Signatures shared by several classes form blocks; of blocks with the same members one stays. Each member is first verified with its block's smallest
member, and the links' components found; then only pairs of one block in different components are left
to verify. They are compared where the block's members meet, first by compact profiles, then by the whole sets of those that
the profiles let link; what is told are links between components, so rows go with a block's members and not their square.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.llm.batches import Words, mix, shingle_sets, slices
from lumenary.llm.common import Scratch, fresh, small_side, table
from lumenary.llm.components import components

BUCKETS = 1 << 16
FEW, PART, PART_BYTES = 32, 1024, 8 << 20  # members up to which a block is one part, and of a part of a larger block; bytes of a part's sets
EARLIER = 32
WIDE = 200  # plain rows that one with a profile or a set counts for
SEEN = 1 << 20  # copies that a task remembers, to index each only once; more are indexed again, which changes nothing


class Similarity:
    """Jaccard similarity of ``num`` / ``den`` or more, in whole numbers."""

    def __init__(self, num: int = 85, den: int = 100):
        self.num, self.den = num, den
        self.least = next(n for n in range(1, 10 * den) if self.misses(n) or self.links(n, n + 1, n))  # smaller sets link with equal ones only
        self.levels = [self.least]
        while self.levels[-1] < 1 << 40:
            self.levels.append(self.levels[-1] * den // num + 1)

    def misses(self, n: int) -> int:
        """How many of n shingles may be missing in a set that still links."""
        return (self.den - self.num) * n // self.den

    def links(self, n: int, m: int, both: int) -> bool:
        return self.den * both >= self.num * (n + m - both)

    def level(self, n: int) -> int:
        return bisect_right(self.levels, n) - 1

    def groups(self, level: int) -> int:
        return max(1, self.misses(self.levels[level]) * 2 // 3)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 63-bit sums over a set."""
    return int(mix(s).sum() >> np.uint64(1)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() >> np.uint64(1))


def signatures(s: np.ndarray, counts: np.ndarray, frequent: float, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, places in the order; 0 for pairs) of a set, which may be bounded by place only for singles."""
    n = len(s)
    if n < sim.least:
        return s[:0], np.zeros(0, np.int32)
    often = counts[(s >> np.uint64(48)).astype(np.int64)]
    often = np.where(often > frequent, often, 0)
    order = np.lexsort((s, often))
    s, often = s[order], often[order]
    need, rare = sim.misses(n) + 1, int((often == 0).sum())
    single = s[: min(rare, need)]
    sigs, places = [mix(single)], [np.arange(len(single), dtype=np.int32)]
    if rare < need:
        rest = s[rare:]
        own = sim.level(n)
        for level in (own, own + 1):
            group = (mix(rest) >> np.uint64(20)).astype(np.int64) % sim.groups(level)
            by = np.argsort(group, kind="stable")
            fresh = np.ones(len(by), bool)
            fresh[1:] = group[by][1:] != group[by][:-1]
            more = np.ones(len(rest), bool)
            more[by[fresh]] = False  # the first of each group adds nothing yet
            end = int(np.searchsorted(np.cumsum(more), need - rare)) + 1
            at = by[by < end]  # the prefix, group by group, each in order
            for gap in range(1, len(at)):
                pair = group[at[gap:]] == group[at[:-gap]]
                if not pair.any():
                    break
                got = mix(mix(rest[at[:-gap][pair]]) * np.uint64(3) + rest[at[gap:][pair]] + np.uint64(level + 1))
                sigs.append(got)
                places.append(np.zeros(len(got), np.int32))
    return np.concatenate(sigs), np.concatenate(places)


def profile(s: np.ndarray) -> bytes:
    """How many items of a set fall into each of 256, 1024 or 4096 ranges, a byte each; empty if one does not fit."""
    bits = 8 if len(s) < 1500 else 10 if len(s) < 8000 else 12
    n = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return n.astype(np.uint8).tobytes() if n.max(initial=0) < 256 else b""


def shared_at_most(p: pa.Buffer, q: pa.Buffer, n: int) -> int:
    """The most items that sets with these profiles can share."""
    a, b = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    if not len(a) or not len(b):
        return n
    if len(a) != len(b):
        size = min(len(a), len(b))
        a, b = (x.reshape(size, -1).sum(axis=1) for x in (a, b))
    return int(np.minimum(a, b).sum())


def _sets(batches: Iterator[pa.RecordBatch], size: int, *more: str) -> Iterator[tuple]:
    """The sets of each slice of texts, after the slice's values of the columns ``more``."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in more]
        for at, texts in slices(batch):
            yield *(c[at : at + len(texts)] for c in cols), list(shingle_sets(Words(texts), size))


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names.split())


def near_duplicates(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reached by links) of each row of ``docs``.

    Null, empty and wordless texts have an empty set and link with nothing, not even each other; rows with
    equal sets link whatever their texts and ids; repeated rows, and rows of one doc_id with different texts, each get
    their row; a row without doc_id links as any other does, and its component_id is null only if no row it reaches
    has a doc_id; an empty table gives an empty result; other columns are not read."""
    return linked(docs, Similarity(num, den), shingle, Scratch(docs.sparkSession, "jaccard")).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, sim: Similarity, shingle: int, scratch: Scratch, prints: Callable[[np.ndarray], tuple[int, int]] = fingerprint) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component (a number; null without words) and component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (kind 0) of doc_id, text_key, set size and fingerprints; then (kind 1) of bucket and count."""
        counts, seen = np.zeros(BUCKETS, np.int64), set()
        for ids, keys, sets in _sets(batches, shingle, "doc_id", "text_key"):
            own = [prints(s) for s in sets]
            for s, p in zip(sets, own, strict=True):
                if p not in seen:
                    if len(seen) < SEEN:
                        seen.add(p)
                    counts += np.bincount((s >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
            yield _batch("kind doc_id text_key n fp fp2", np.zeros(len(ids), np.int32), pa.array(ids, pa.int64()), np.array(keys, np.int64), np.array([len(s) for s in sets], np.int64),
                         np.array([p[0] for p in own], np.int64), np.array([p[1] for p in own], np.int64))
        some = np.flatnonzero(counts)
        none = np.zeros(len(some), np.int64)
        yield _batch("kind doc_id text_key n fp fp2", np.ones(len(some), np.int32), some, none, counts[some], none, none)

    described = scratch.keep(docs.mapInArrow(describe, "kind int, doc_id long, text_key long, n long, fp long, fp2 long"))
    rows = described.filter("kind = 0").drop("kind")
    counts = np.zeros(BUCKETS, np.int64)
    for r in described.filter("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        counts[r["doc_id"]] = r["n"]
    mean = counts.mean()
    frequent = float(mean + 8 * np.sqrt(mean) + 30)
    # Of each class its smallest doc_id (null where none has one) and a text that goes with it.
    classes = rows.filter("n > 0").groupBy("fp", "fp2", "n").agg(
        F.min("doc_id").alias("rep"), F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("rep_text"))
    classes = scratch.keep(classes, rows.count())
    # Classes go by fp; those few that share theirs with another class by fp2.
    twins = {r["fp"] for r in classes.groupBy("fp").count().filter("count > 1").select("fp").collect()}

    def key(s: np.ndarray) -> int:
        p = prints(s)
        return p[1] if p[0] in twins else p[0]

    node = F.when(F.col("fp").isin(list(twins)), F.col("fp2")).otherwise(F.col("fp")) if twins else F.col("fp")
    classes = classes.withColumn("node", node)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signatures of each set, and a row with its profile, whose sig is null."""
        seen = set()
        for (sets,) in _sets(batches, shingle):
            out: list[list] = [[], [], [], []]
            told: list[tuple] = []
            for s in sets:
                p = key(s) if len(s) >= sim.least else None
                if p is None or p in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(p)
                sigs, places = signatures(s, counts, frequent, sim)
                for col, v in zip(out, (sigs.view(np.int64), np.full(len(sigs), p, np.int64), np.full(len(sigs), len(s), np.int32), places), strict=True):
                    col.append(v)
                told.append((p, len(s), profile(s)))
            if told:
                n = sum(map(len, out[0]))
                sig, fp, size, place = (np.concatenate(c) for c in out)
                yield _batch("sig fp n place profile", sig, fp, size, place, pa.nulls(n, pa.binary()))
                yield _batch("sig fp n place profile", pa.nulls(len(told), pa.int64()), pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.int32()),
                             np.zeros(len(told), np.int32), pa.array([t[2] for t in told], pa.binary()))

    indexed = scratch.keep(docs.select("text").mapInArrow(index, "sig long, fp long, n int, place int, profile binary"))
    # One shuffle by signature serves the blocks and their members: both sides of the join read it, so both name all its columns.
    signed = indexed.filter("sig is not null").select("sig", "fp", "n", "place").repartition("sig")
    blocks = signed.groupBy("sig").agg(F.min("fp").alias("pivot"), F.max("fp").alias("last"), F.min("n").alias("least_n"), F.min("place").alias("least_place"))
    blocks = blocks.filter("pivot <> last and least_n > 0 and least_place >= 0").select(F.col("sig").alias("block"), "pivot")
    member = signed.join(blocks.hint("shuffle_hash"), F.col("sig") == F.col("block")).groupBy("sig", "fp", "pivot").agg(F.min("n").alias("n"), F.min("place").alias("place"))
    # Blocks with the same members say the same; one of them stays, with each member's smallest place.
    block = Window.partitionBy("sig")
    group = F.xxhash64(F.bit_xor(F.xxhash64("fp")).over(block), F.bit_xor(F.xxhash64("fp", F.lit(1))).over(block), F.count("*").over(block))
    member = member.withColumn("group", group).groupBy("group", "fp", "pivot").agg(F.min("n").alias("n"), F.min("place").alias("place")).withColumnRenamed("group", "sig")
    member = scratch.keep(member, indexed.count() // 2)
    members = member.count()

    # Each member with its block's pivot. Only one task's copy of a class's profile is needed.
    size = classes.select(F.col("node").alias("p"), F.col("n").alias("size"))
    first = member.filter(F.col("fp") != F.col("pivot")).select("fp", "pivot", "n").distinct()
    first = (first.join(size, F.col("pivot") == F.col("p")).filter(may_link(sim, F.col("n"), F.lit(0), F.col("size"), F.lit(0)))
             .select(F.least("fp", "pivot").alias("a"), F.greatest("fp", "pivot").alias("b")).distinct())
    first = scratch.keep(first, members)
    inside = member.select(F.col("fp").alias("id")).distinct()
    profiles = indexed.filter("sig is null").select("fp", F.col("n").cast("long").alias("n"), "profile").join(inside, F.col("fp") == F.col("id"), "left_semi")
    profiles = scratch.keep(profiles.groupBy("fp").agg(F.first("n").alias("n"), F.first("profile").alias("profile")), classes.count())
    scratch.drop(indexed)
    texts = classes.select("node", "rep", "rep_text")
    near = scratch.keep(profiled(first, profiles, sim), WIDE * first.count())
    sets = scratch.keep(described_sets(docs, near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), texts, key, shingle, scratch))
    links = scratch.keep(compared(near, sets, sim), WIDE * near.count())
    scratch.drop(first, near, sets)
    labels = scratch.keep(components(links, scratch), 2 * links.count())

    # What is left: pairs of a block whose components differ.
    named = member.select("sig", "fp", "n", "place").join(labels, F.col("fp") == F.col("node"), "left").select("sig", "fp", "n", "place", F.coalesce("label", "fp").alias("label"))
    named = scratch.keep(named, members)
    scratch.drop(member)
    more = meetings(named, profiles, docs, texts, key, shingle, sim, scratch, members)
    scratch.drop(named, profiles)
    links = links.unionByName(more)
    labels = scratch.keep(components(links, scratch), 2 * links.count())

    n = labels.count()
    reps = classes.select(F.col("node").alias("of"), "rep")
    least = small_side(labels, n).join(reps, F.col("node") == F.col("of")).groupBy("label").agg(F.min("rep").alias("component_id"))
    named = labels.join(small_side(least.withColumnRenamed("label", "l"), n), F.col("label") == F.col("l")).select(F.col("node").alias("of"), "label", "component_id")
    named = small_side(scratch.keep(named, n), n)
    classes = classes.join(named, F.col("node") == F.col("of"), "left").select(
        F.col("fp").alias("f"), F.col("fp2").alias("f2"), F.col("n").alias("m"), F.coalesce("label", "node").alias("component"),
        F.when(F.col("label").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    known = rows.filter("n > 0").join(classes, (F.col("fp") == F.col("f")) & (F.col("fp2") == F.col("f2")) & (F.col("n") == F.col("m")))
    out = known.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component", "component_id")
    return out.unionByName(rows.filter("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")))


def may_link(sim: Similarity, n: Column, place: Column, m: Column, place2: Column) -> Column:
    """Whether sets of n and m items can link whose first shared item stands at these places: as if all behind it were shared."""
    most = F.least(n - place, m - place2).cast("long")
    return (sim.den * F.least(n, m) >= sim.num * F.greatest(n, m)) & ((sim.num + sim.den) * most >= sim.num * (n + m).cast("long"))


def meetings(named: DataFrame, profiles: DataFrame, docs: DataFrame, texts: DataFrame, key, shingle: int, sim: Similarity, scratch: Scratch, members: int) -> DataFrame:
    """Links (a, b) that join the components which the members of a block have between them.

    Members come together by block, twice: with their profiles, after which those stay that some other member's
    profile lets link; then with their whole sets. Rows are members, never pairs: a block's pairs live inside a worker,
    which compares no two that its links connect already and tells no more links than it has members. A block
    of more than FEW members is dealt by hash into parts of about PART members and PART_BYTES of sets, and each two parts meet in
    one place, so no place gets more rows the larger a block is. Each member brings the first EARLIER of its
    blocks, and a pair that meets in one of them too is left to that."""
    open_blocks = named.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"), F.sum("n").alias("items")).filter("lo <> hi")
    left = scratch.keep(named.join(open_blocks.select(F.col("sig").alias("block"), "members", "items").hint("shuffle_hash"), F.col("sig") == F.col("block")).drop("block"), members)
    few, large = left.filter(F.col("members") <= FEW), left.filter(F.col("members") > FEW)
    x, y = few.alias("x"), few.alias("y")
    some = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") != F.col("y.label"))
                  & may_link(sim, F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place")), "left_semi")
    parts = F.ceil(F.greatest(F.col("members") / PART, F.col("items") * 8 / PART_BYTES)).cast("int")
    some = scratch.keep(some.select("sig", "fp", "n", "label", F.lit(1).alias("parts")).unionByName(large.select("sig", "fp", "n", "label", parts.alias("parts"))), members)
    scratch.drop(left)
    first = some.groupBy("fp").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, EARLIER).alias("earlier")).withColumnRenamed("fp", "r")  # no longer than the member's own signatures
    brought = profiles.select(F.col("fp").alias("profiled"), "profile").join(first, F.col("profiled") == F.col("r")).drop("r")
    dealt = some.join(brought, F.col("fp") == F.col("profiled")).withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("sig", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp", "label", "n", "earlier", "profile")

    def stay(rows: pa.Table) -> pa.RecordBatch:
        keep = np.zeros(len(rows), bool)
        for k, rest in candidates(rows, sim, [x.as_buffer() for x in rows.column("profile")]):
            keep[k] = True
            keep[rest] = True
        return rows.drop_columns(["profile"]).filter(pa.array(keep, pa.bool_())).combine_chunks().to_batches() if keep.any() else []

    kinds = "sig long, i int, j int, part int, fp long, label long, n int, earlier array<long>"
    stayed = scratch.keep(met(dealt, stay, kinds), WIDE * some.count())
    sets = described_sets(docs, stayed.select(F.col("fp").alias("id")).distinct(), texts, key, shingle, scratch)
    whole = stayed.join(sets, F.col("fp") == F.col("id")).drop("id")

    def join(rows: pa.Table) -> list[pa.RecordBatch]:
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("items")]
        fp, label = rows.column("fp").to_numpy(), rows.column("label").to_numpy()
        _, root = np.unique(label, return_inverse=True)
        out: list[tuple[int, int]] = []
        for k, rest in candidates(rows, sim, [profile(s) for s in items]):
            for m in rest[root[rest] != root[k]].tolist():
                if root[m] != root[k] and sim.links(len(items[k]), len(items[m]), len(np.intersect1d(items[k], items[m], assume_unique=True))):
                    root[root == root[m]] = root[k]
                    out.append((fp[k], fp[m]))
        return [_batch("a b", np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64))] if out else []

    links = scratch.keep(met(whole, join, "a long, b long").distinct(), stayed.count())
    scratch.drop(some, stayed)
    return links


def met(dealt: DataFrame, meet, kinds: str) -> DataFrame:
    """What ``meet`` makes of the rows of each place (sig, i, j)."""
    together = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at_key = [], None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("sig", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if to > at:
                    if held and at_key != tuple(keys[at]):
                        yield from meet(pa.Table.from_batches(held))
                        held = []
                    at_key = tuple(keys[at])
                    held.append(batch.slice(at, to - at))
        if held:
            yield from meet(pa.Table.from_batches(held))

    return together.mapInArrow(by_place, kinds)


def met_before(earlier: list[np.ndarray], chunk: int = 512) -> np.ndarray:
    """Whether each two of the rows have one of their earlier blocks in common."""
    row = np.repeat(np.arange(len(earlier)), [len(e) for e in earlier])
    out = np.zeros((len(earlier), len(earlier)), bool)
    _, block, count = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    _, block = np.unique(np.where(count[block] > 1, block, -1), return_inverse=True)  # those of one row alone fall together as 0 ...
    block = block - (1 if (count == 1).any() else 0)  # ... and go
    for low in range(0, int(block.max(initial=-1)) + 1, chunk):
        some = (block >= low) & (block < low + chunk)
        has = np.zeros((len(earlier), min(chunk, int(block.max()) + 1 - low)), np.float32)
        has[row[some], block[some] - low] = 1
        out |= has @ has.T > 0
    return out


def candidates(rows: pa.Table, sim: Similarity, profiles: list) -> Iterator[tuple[int, np.ndarray]]:
    """(k, later rows) of one meeting of two parts (or of one with itself): pairs that differ in label, meet nowhere earlier and have profiles that let them link."""
    part, label, n = (rows.column(c).to_numpy() for c in ("part", "label", "n"))
    n = n.astype(np.int64)
    here = rows.column("sig")[0].as_py()
    across = rows.column("i")[0] != rows.column("j")[0]
    before = met_before([e[e < here] for e in (x.values.to_numpy() for x in rows.column("earlier"))])
    raw = [np.frombuffer(x, np.uint8) for x in profiles]
    size = min([len(x) for x in raw if len(x)], default=1)
    # A profile that is missing lets everything pass.
    matrix = np.array([x.reshape(size, -1).sum(axis=1, dtype=np.int32) if len(x) else np.full(size, 1 << 30, np.int32) for x in raw])
    for k in range(len(n) - 1):
        rest = np.flatnonzero(~before[k, k + 1 :]) + k + 1
        if across:
            rest = rest[part[rest] != part[k]]
        rest = rest[(label[rest] != label[k]) & (sim.den * np.minimum(n[rest], n[k]) >= sim.num * np.maximum(n[rest], n[k]))]
        if len(rest):
            both = np.minimum(np.minimum(matrix[rest], matrix[k]).sum(axis=1, dtype=np.int64), np.minimum(n[rest], n[k]))
            rest = rest[sim.den * both >= sim.num * (n[rest] + n[k] - both)]
            if len(rest):
                yield k, rest


def described_sets(docs: DataFrame, ids: DataFrame, texts: DataFrame, key, shingle: int, scratch: Scratch) -> DataFrame:
    """id and items (the whole set) of the classes ``ids``, one row each."""
    n = ids.count()
    ids = scratch.keep(ids.join(texts, F.col("id") == F.col("node")).select("id", "rep", "rep_text"), n)
    some = docs.join(small_side(ids, n), docs["doc_id"].eqNullSafe(ids["rep"]) & (docs["text_key"] == ids["rep_text"]), "left_semi").select("text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for (sets,) in _sets(batches, shingle):
            found = {key(s): s for s in sets}
            found = {p: s for p, s in found.items() if p not in seen}
            if len(seen) < SEEN:
                seen.update(found)
            yield _batch("id items", pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary()))

    return some.mapInArrow(describe, "id long, items binary").groupBy("id").agg(F.first("items").alias("items"))


def beside(pairs: DataFrame, known: DataFrame, *cols: str) -> DataFrame:
    """(a, b) with both sides' columns; ``known`` goes by its first column."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(known.select(F.col(known.columns[0]).alias(f"id_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in cols]), F.col(side) == F.col(f"id_{side}")).drop(f"id_{side}")
    return out


def profiled(pairs: DataFrame, profiles: DataFrame, sim: Similarity) -> DataFrame:
    """The (a, b) that their profiles let link."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [sim.links(n, m, shared_at_most(p.as_buffer(), q.as_buffer(), min(n, m))) for n, m, p, q in zip(
                batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), batch.column("profile_a"), batch.column("profile_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return beside(pairs, profiles, "n", "profile").mapInArrow(possible, "a long, b long")


def compared(pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """The (a, b) that link by their whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
                p, q = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                keep.append(sim.links(len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return beside(pairs, sets, "items").mapInArrow(compare, "a long, b long")


def one_of_each(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each component stays: that of the smallest doc_id (rows
    without doc_id come last; of several with that doc_id, the text of the smallest hash; of repeated rows one). Rows without
    words, whose texts may be null, link with nothing and all stay."""
    scratch = Scratch(docs.sparkSession, "one-of-each")
    found = scratch.keep(linked(docs, Similarity(num, den), shingle, scratch).filter("component is not null").select("component", "doc_id", "text_key"))
    scratch.drop_all_but(found)
    # The smallest doc_id, then the smallest text key that goes with it: plain minima, which are partly taken before the shuffle.
    least = found.groupBy("component").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")).filter("n > 1").withColumnRenamed("component", "c")
    several = scratch.keep(found.join(least, F.col("component") == F.col("c")).drop("c"))
    rows = several.count()
    chosen = several.filter(F.col("doc_id").eqNullSafe(F.col("least_id"))).groupBy("component").agg(F.min("text_key").alias("least_key")).withColumnRenamed("component", "c")
    chosen = several.join(chosen, F.col("component") == F.col("c")).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("text_key") == F.col("least_key")))
    marked_id, marked_key, key = (fresh(c, docs) for c in ("marked_id", "marked_key", "own_key"))
    marks = scratch.keep(chosen.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).filter("n > 1 or not stays")
                         .select(F.col("doc_id").alias(marked_id), F.col("text_key").alias(marked_key), "stays"), rows)
    scratch.drop_all_but(marks)
    n = marks.count()
    marked = docs["doc_id"].cast("long").eqNullSafe(marks[marked_id]) & (F.xxhash64(docs["text"]) == marks[marked_key])
    kept = docs.join(small_side(marks, n), marked, "left_anti")
    again = marks.filter("stays").select(marked_id, marked_key)  # rows that stay, but once
    if again.isEmpty():
        return kept
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(marked_id)) & (F.col(key) == F.col(marked_key))
    once = docs.withColumn(key, F.xxhash64("text")).join(small_side(again, n), same, "left_semi")
    return kept.unionByName(once.dropDuplicates(["doc_id", key]).drop(key))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node) c USING (doc_id)
"""
