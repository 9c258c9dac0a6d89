"""Packing by first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document's ids (its tokens, then an end id) are cut into full-length pieces and a tail. Documents are
dealt at random, by a hash, into groups of bounded size; within a group the pieces are placed longest
first, each into the first open bin that still has room. The tournament tree holds at each node the
largest free capacity below it, so the first bin that fits is found in as many steps as the tree is high.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 0
_tokenizers: dict[str, object] = {}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tokenizer:
    """Ids of a public vocabulary file. Texts that spell a special token go the way that knows it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Whole

        self.whole = Whole.from_file(path)
        self.special = [str(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        try:  # the same vocabulary as ranks, where it lies beside: the same ids, several times faster
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
        except (ImportError, OSError):
            self.fast = None

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


class Bins:
    """Free capacities of bins as a tournament tree; ``place`` is first fit."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of the first bin with room for ``length``."""
        tree, k = self.tree, 1
        while k < self.leaves:
            k *= 2
            if tree[k] < length:
                k += 1
        at, offset = k - self.leaves, self.capacity - tree[k]
        tree[k] -= length
        while k > 1:
            k //= 2
            tree[k] = max(tree[2 * k], tree[2 * k + 1])
        return at, offset


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces of equal length keep their order."""
    bins, where = Bins(max(1, len(lengths)), capacity), np.zeros((len(lengths), 2), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        where[k] = bins.place(int(lengths[k]))
    return where[:, 0], where[:, 1]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, ids: bool = False) -> DataFrame:
    """The pieces of each document, and a salt that tells equal ones of a task apart; with ``ids`` also what they hold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        seen: Counter = Counter()
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            out = 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                got = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                for a in range(0, len(got), capacity):
                    part = got[a : a + capacity]
                    crc = zlib.crc32(part.tobytes())
                    key = (doc_id.as_py(), a, crc)
                    for col, x in zip(rows, (doc_id.as_py(), a, len(part), crc, len(got), seen[key], part.tolist() if ids else None), strict=True):
                        col.append(x)
                    seen[key] += 1
                out += len(got)
                if out > 500_000:
                    yield made(rows)
                    rows, out = [[] for _ in range(7)], 0
            yield made(rows)

    def made(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names[: len(kinds)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + ", salt long" + ", ids array<long>" * ids)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, group_docs: int = 4096, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null texts are empty and give the end id alone; repeated rows are packed each for itself; a null doc_id is one like any
    other; an empty table gives an empty result. A group holds the pieces of about ``group_docs`` documents, whatever their
    number, and however often one doc_id or one row occurs; the
    bins of a group are numbered within it, and sequence ids are group * 2^32 + bin.
    """
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, tokenizer_path, capacity, ids)
    # A piece's own content deals it, so neither a very long document nor a repeated id falls into one group; equal rows go by their task and their number in it.
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", F.expr(f"start div {capacity * 256}"), "ids_crc32", F.when(F.col("salt") > 0, F.spark_partition_id()), "salt"), F.lit(groups))).drop("salt")
    schema = PIECES + ", ids array<long>" * ids + ", sequence_id long, offset long"

    def place(key: tuple, got: pa.Table) -> pa.Table:
        got = got.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]).drop_columns("group")
        at, offset = first_fit_decreasing(got["length"].to_numpy(), capacity)
        first = key[0].as_py() << 32
        return got.append_column("sequence_id", pa.array(at + first)).append_column("offset", pa.array(offset))

    return dealt.groupBy("group").applyInArrow(place, schema)


def op9_tree_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lumenary.llm.common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)
