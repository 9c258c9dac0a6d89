"""Periodic runs of words: every maximal stretch that repeats itself at a distance, by way of tandem repeats.

The Gusfield-Stoye method in arrays, over all texts of a slice at once. A text's suffixes are sorted by doubling, which also
names every substring of 2 ** k words, so that common extensions, forward and backward, take a step for each k. Lempel-Ziv
blocks follow from each position's longest earlier occurrence. Next to the block borders stand the tandem repeats that cover
every leftmost one; from them a walk along suffix links, a rotation each step, completes the vocabulary of repeats. A
repeat's locus in the suffix tree is the interval of sorted suffixes that begin with it, which are its occurrences;
occurrences of one period at consecutive places merge into a run. Only repeats of a primitive root matter, since a run goes
by its smallest period.

A run of ``least`` words or more has each of its words in a stretch of half as many words that stands twice in it. What no such stretch
covers is therefore left out before; what remains falls into segments, in which runs lie as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.batches import Words, columns, mix, shingles, slices
from lumenary.llm.common import table

SLICE = 1 << 20


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts``, its place that many times, and beside it 0, 1, ..."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


class Suffixes:
    """Sorted suffixes of a sequence of letters, with names of all substrings of 2 ** k letters: equal ones have equal names.

    No name is given twice for substrings cut off by the end of the sequence. Memory is n * log n numbers, n being the sequence's length."""

    def __init__(self, letters: np.ndarray):
        n = self.n = len(letters)
        name, names = np.unique(letters, return_inverse=True)[1].astype(np.int64), []
        while True:
            names.append(np.append(name, -1).astype(np.int32))
            if int(name.max(initial=-1)) == n - 1:
                break
            beyond = np.zeros(n, np.int64)
            width = 1 << (len(names) - 1)
            beyond[: n - width] = name[width:] + 1
            key = name * (n + 1) + beyond
            order = np.argsort(key)
            key = key[order]
            name = np.empty(n, np.int64)
            name[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        self.names, self.rank = np.array(names), names[-1][:-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters agree from i and j (different places) on."""
        i, j, first = i.copy(), j.copy(), i
        for k in reversed(range(len(self.names))):
            step = (self.names[k][i] == self.names[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - first

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters agree from i and j on backwards, these included; -1 stands before the sequence."""
        i, j, first = i.copy(), j.copy(), i
        for k in reversed(range(len(self.names))):
            x, y = i - (1 << k) + 1, j - (1 << k) + 1
            step = ((x >= 0) & (y >= 0) & (self.names[k][np.maximum(x, 0)] == self.names[k][np.maximum(y, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return first - i

    def named(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two names that tell substrings of one length apart."""
        k = np.minimum(np.frexp(length.astype(np.float64))[1] - 1, len(self.names) - 1)
        return self.names[k, i], self.names[k, i + length - (1 << k)]

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        a, b = self.named(i, length)
        c, d = self.named(np.minimum(j, self.n - length), length)
        return (a == c) & (b == d) & (j + length <= self.n)

    def locus(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval [low, high) of sorted suffixes that begin with ``length`` letters from i."""
        found = self.rank[i].astype(np.int64)
        low, top = np.zeros(len(i), np.int64), found.copy()  # suffix ``top`` is in the interval
        high, bottom = np.full(len(i), self.n, np.int64), found.copy()  # so is ``bottom``, ``high`` is not
        for _ in range(int(self.n).bit_length() + 1):
            mid = (low + top) // 2
            inside = self.same(i, self.order[mid], length)
            top, low = np.where(inside, mid, top), np.where(inside | (low >= top), low, mid + 1)
            mid = (bottom + high) // 2
            inside = self.same(i, self.order[np.minimum(mid, self.n - 1)], length) & (mid < high)
            bottom, high = np.where(inside, mid, bottom), np.where(inside | (high <= bottom + 1), high, mid)
        return top, bottom + 1

    def earlier(self) -> np.ndarray:
        """The length of the longest substring from each place on that also begins at an earlier place."""
        n, least = self.n, [self.order]
        while 2 << (len(least) - 1) <= n:
            half = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        before, after = np.arange(n), np.arange(1, n + 1)
        for k in reversed(range(len(least))):
            low = before - (1 << k)
            before = np.where((low >= 0) & (least[k][np.maximum(low, 0)] > self.order), low, before)
            most = len(least[k]) - 1
            after = np.where((after <= most) & (least[k][np.minimum(after, most)] > self.order), after + (1 << k), after)
        out, own = np.zeros(n, np.int64), self.order
        for near, there in ((np.maximum(before - 1, 0), before > 0), (np.minimum(after, n - 1), after < n)):
            out[own[there]] = np.maximum(out[own[there]], self.ahead(own[there], own[near[there]]))
        return out


def blocks(earlier: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin: each is the longest that also begins earlier, or one letter."""
    out, at, steps = [], 0, np.maximum(earlier, 1).tolist()
    while at < len(steps):
        out.append(at)
        at += steps[at]
    return np.array(out, np.int64)


def covering(s: Suffixes, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of tandem repeats next to block borders: the leftmost of each kind is one of them or a rotation on from one."""
    h = blocks(s.earlier())
    size = np.diff(np.append(h, s.n))
    letters = np.append(letters, -1)  # what stands after the last
    starts, periods = [], []
    # Repeats that begin in a block, and reach the next one.
    b, k = spread(size)
    border, k = h[b] + size[b], k + 1
    some = letters[border] == letters[border - k]
    border, k = border[some], k[some]
    q = border - k
    right, left = s.ahead(border, q), s.back(border - 1, q - 1)
    some = right + left >= k
    starts.append(np.maximum(q - left, q - k + 1)[some])
    periods.append(k[some])
    # Repeats that begin before a block, have their middle in it, and end in it or the next one.
    b, k = spread(size + np.append(size[1:], 0))
    k = k + 1
    inside = (h[b] > 0) & (h[b] + k < s.n)
    b, k = b[inside], k[inside]
    some = (letters[h[b]] == letters[h[b] + k]) & (letters[h[b] - 1] == letters[h[b] + k - 1])
    b, k = b[some], k[some]
    right, left = s.ahead(h[b], h[b] + k), s.back(h[b] - 1, h[b] + k - 1)
    start = np.maximum(h[b] - left, h[b] - k + 1)
    some = (right + left >= k) & (start + k <= h[b] + size[b])
    starts.append(start[some])
    periods.append(k[some])
    return np.concatenate(starts), np.concatenate(periods)


def primitive(s: Suffixes, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the root of each repeat is no power of a shorter one."""
    out, most = np.ones(len(start), bool), int(period.max(initial=1))
    divisor = np.zeros(most + 1, np.int64)  # the smallest prime divisor
    for p in range(2, most + 1):
        if p * p > most:
            break
        if not divisor[p]:
            some = divisor[p * p :: p]
            some[some == 0] = p
    divisor = np.where(divisor, divisor, np.arange(most + 1))
    rest = period.copy()
    while (rest > 1).any():
        todo = np.flatnonzero(rest > 1)
        p = divisor[rest[todo]]
        shorter = period[todo] // p
        out[todo] &= ~s.same(start[todo], start[todo] + shorter, 2 * period[todo] - shorter)
        rest[todo] //= p
    return out


def tandem_runs(letters: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and smallest period of every run of at least ``least`` letters and two periods, by period and start."""
    if not len(letters):
        return (np.zeros(0, np.int64),) * 3
    s = Suffixes(letters)
    start, period = covering(s, letters)
    both = np.unique(start * (s.n + 1) + period)
    start, period = both // (s.n + 1), both % (s.n + 1)
    whole = primitive(s, start, period)
    start, period = start[whole], period[whole]
    # The walk: each suffix link drops the first letter, and the repeat rotates as long as the next one agrees; after a whole period all are known.
    steps = np.minimum(s.ahead(start, start + period) - period + 1, period)
    of, step = spread(steps)
    start, period = start[of] + step, period[of]
    a, b = s.named(start, 2 * period)
    order = np.lexsort((b, a, period))
    a, b, start, period = a[order], b[order], start[order], period[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (period[1:] != period[:-1]))[: len(a)]
    start, period = start[new], period[new]
    # Occurrences, and those of consecutive places together.
    low, high = s.locus(start, 2 * period)
    of, step = spread(high - low)
    start, period = s.order[low[of] + step], period[of]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    edge = np.flatnonzero(np.append(True, (start[1:] != start[:-1] + 1) | (period[1:] != period[:-1]))[: len(start)])
    last = np.append(edge[1:], len(start))[: len(edge)] - 1
    length = start[last] - start[edge] + 2 * period[edge]
    some = length >= least
    return start[edge][some], length[some], period[edge][some]


def segments(hashes: np.ndarray, text: np.ndarray, least: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The words, by place, that can be in runs, and the segment of each: stretches covered by half as many words as ``least`` that stand twice in
    the segment before. Each round leaves out no run, so their number bears on the time alone."""
    gram = (least + 1) // 2
    at, part = np.arange(len(hashes)), text.astype(np.int64)
    for _ in range(rounds):
        if len(at) < gram:
            return at[:0], part[:0]
        key = mix(shingles(hashes[at], gram) + mix(part[: len(at) - gram + 1].astype(np.uint64)))
        key_of = np.flatnonzero(part[: len(at) - gram + 1] == part[gram - 1 :])
        order = key_of[np.argsort(key[key_of])]
        twice = key[order[1:]] == key[order[:-1]]
        cover = np.zeros(len(at) + 1, np.int64)
        again = np.union1d(order[1:][twice], order[:-1][twice])
        np.add.at(cover, again, 1)
        np.add.at(cover, again + gram, -1)
        kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        if len(kept) == len(at):
            break
        at, part = at[kept], part[kept]
        new = np.append(True, (np.diff(kept) > 1) | (part[1:] != part[:-1]))[: len(kept)]
        part = np.cumsum(new) - 1
        long = np.bincount(part, minlength=1)[part] >= least if len(part) else np.zeros(0, bool)
        at, part = at[long], part[long]
    return at, part


def runs_in(words: Words, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start (among all words of the slice), length and period of the runs of all texts, by start and period."""
    hashes = words.hashes()
    at, part = segments(hashes, words.doc, least)
    _, letter = np.unique(hashes[at], return_inverse=True)
    start, length, period = tandem_runs(part * (len(letter) + 1) + letter, least)
    start = at[start]  # segments are stretches without gaps
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


KIND = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 12) -> DataFrame:
    """key, n_words, runs (start, length and period in words, by start and period) and collapsed of every row: the words, joined by
    one blank, that no run holds after its first period.

    Words are ``[^\\x20\\x09-\\x0D]+``; a run is a stretch of words with smallest period q, of ``least`` words and 2 * q at least, that no
    neighbouring word extends. Null, empty and wordless texts have no words and no runs, and collapse to the empty text; repeated rows, and
    rows without a key, each have theirs; an empty table gives an empty result; other columns are not read. A text is looked at as a whole,
    so memory goes with the longest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch, most=SLICE):
                words = Words(texts, lower=False)
                start, length, period = runs_in(words, least)
                gone = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                runs = pa.StructArray.from_arrays([pa.array(start - words.first[words.doc[start]]), pa.array(length), pa.array(period)], fields=list(KIND))
                kept = []
                for a, b, t in zip(words.first[:-1], words.first[1:], texts, strict=True):
                    own = (t or "").encode("utf-8", "surrogatepass").split()  # at the same six characters
                    kept.append(b" ".join([w for w, x in zip(own, gone[a:b].tolist(), strict=True) if not x] if gone[a:b].any() else own))
                yield columns(key=batch.column("key").slice(at, len(texts)), n_words=words.counts, collapsed=pa.array(kept, pa.binary()).cast(pa.string()),
                              runs=pa.ListArray.from_arrays(pa.array(np.searchsorted(start, words.first), pa.int32()), runs))

    kind = dict(docs.dtypes)[key]
    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_words bigint, collapsed string, runs array<struct<start: bigint, length: bigint, period: bigint>>")
    return got.select(F.col("key").alias(key), "n_words", "runs", "collapsed")


def planted(text: Column, doc_id: Column) -> Column:
    """The text, of one id in ten with its words from some place on made periodic, as the contract of the query states."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Within a higher-order function, so that the words are split once.
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(text)), F.lit(0))
    return F.when((h % 10 == 0) & text.isNotNull(), changed).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    got = got.withColumn("most", most)
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("most.start")).alias("start"), F.col("most.length").alias("length"), (-F.col("most.period")).alias("period"),
                      F.expr("1000 * most.length div -most.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# Every two equal stretches of six words of a text at their distance q; consecutive ones of one distance are a repetition of period q.
SQL = rf"""
WITH RECURSIVE step AS (SELECT b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) r(b) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
lookup AS (SELECT list(c ORDER BY b) AS l FROM step WHERE k = 8),
o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_prepend(CAST({0xFFFFFFFF} AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1])), CAST({0xFFFFFFFF} AS BIGINT)) AS h FROM documents, lookup),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM g),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 6), ' ') AS s FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM d WHERE n >= 12)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM win x JOIN win y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
island AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM pair) GROUP BY doc_id, q, z),
run AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM island WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM d) LEFT JOIN gone USING (doc_id, i) WHERE gone.doc_id IS NULL GROUP BY doc_id),
told AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
  first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS m FROM run GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, m.start AS start, m.length AS length, m.period AS period, 1000 * m.length // m.period AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
