"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is a fixed grid of cells. Every shard stands on it at ``vnodes`` places; a cell belongs to the
first virtual node clockwise. Shard capacities add up to the number of rows and differ by one at most, so
once every key stands, counts differ by one at most. Each shard first takes the keys of its own cells in
ring order; keys that overflow a full shard go on clockwise to the next virtual node whose shard has room.
Only the counts of the cells (as many rows as the grid has cells, whatever the data's size) reach the
driver, where ``walk`` lays out which ranks of which cell go where. Ranks are taken by parts of a cell of
bounded size, so a key with a third of all rows is ranked in many tasks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenary.llm.common import Scratch, small_side, table

CELLS = 8192


def ring(shards: int, vnodes: int, cells: int) -> tuple[list[int], list[int]]:
    """(places, shards that stand there), clockwise; of two on one place the lower shard stays."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            place = int.from_bytes(hashlib.md5(f"{s}:{v}".encode()).digest()[:8], "big") % cells
            at[place] = min(s, at.get(place, s))
    for s in range(shards):
        if s not in at.values():
            at[next(p for p in range(cells) if p not in at)] = s
    places = sorted(at)
    return places, [at[p] for p in places]


def walk(counts: dict[int, int], shards: int, vnodes: int, cells: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where each cell's keys, by their rank in it, go."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    places, owner = ring(shards, vnodes, cells)
    out, over = [], []

    def put(cell: int, first: int, n: int, s: int) -> int:
        n = min(n, room[s])
        if n:
            out.append((cell, first, first + n, s, filled[s]))
            filled[s] += n
            room[s] -= n
        return n

    for cell in sorted(counts):
        k = bisect_left(places, cell) % len(places)
        took = put(cell, 0, counts[cell], owner[k])
        if took < counts[cell]:
            over.append((cell, took, counts[cell] - took, k))
    for cell, first, left, k in over:
        while left:
            k = (k + 1) % len(places)
            took = put(cell, first, left, owner[k])
            first, left = first + took, left - took
    return out


def assign_shards(docs: DataFrame, shards: int = 16, vnodes: int = 128, cells: int = CELLS, part_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text).

    Null texts count as empty, a null doc_id is a key like any other, rows that repeat are placed each for
    itself, and an empty table gives an empty result; other columns are not read. A cell of more than ``part_rows`` rows is
    ranked in parts of about that size.
    """
    spark, cell = docs.sparkSession, F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int")
    rows = docs.select(
        "doc_id", cell.alias("cell"), F.lit(0).alias("sub"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # At most ``cells`` rows come to the driver, however large the table is.
    counts = {r["cell"]: r["n"] for r in docs.select(cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    by_cell = defaultdict(list)
    for c, first, end, s, slot in walk(counts, shards, vnodes, cells):
        by_cell[c].append((first, end, s, slot))
    plan = spark.createDataFrame(
        [(c, parts) for c, parts in by_cell.items()],
        "cell int, parts array<struct<first: bigint, end: bigint, shard: int, slot: bigint>>",
    )
    large = {c: -(-n // part_rows) for c, n in counts.items() if n > part_rows}
    if large:
        # Rows of a large cell are dealt by content, equal ones by the task that reads them; written, since both passes below must see one dealing.
        subs = spark.createDataFrame(list(large.items()), "large int, subs int")
        dealt = rows.join(F.broadcast(subs), F.col("cell") == F.col("large"), "left")
        sub = F.coalesce(F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.spark_partition_id()), F.col("subs")), F.lit(0)).cast("int")
        scratch = Scratch(spark, "sharding")
        rows = scratch.keep(dealt.select("doc_id", "cell", sub.alias("sub"), "size", "text_crc32"))
        ahead = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
        parts = sum(large.values())
        offsets = scratch.keep(rows.groupBy("cell", "sub").agg(F.count("*").alias("n"))
                               .select(F.col("cell").alias("c"), F.col("sub").alias("s"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")), parts + cells)
        rows = rows.join(small_side(offsets, parts + cells), (F.col("cell") == F.col("c")) & (F.col("sub") == F.col("s")), "left").drop("c", "s")
        offset = F.coalesce("offset", F.lit(0))
    else:
        offset = F.lit(0)
    order = Window.partitionBy("cell", "sub").orderBy(F.xxhash64("doc_id", F.lit("rank")), "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", (F.row_number().over(order) - 1 + offset).cast("long"))
    part = F.filter("parts", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["end"]))[0]
    return (
        ranked.join(F.broadcast(plan), "cell")  # bounded by the number of cells
        .withColumn("part", part)
        .select("doc_id", "size", "text_crc32", F.col("part.shard").alias("shard"),
                (F.col("part.slot") + F.col("rank") - F.col("part.first")).alias("slot"))
    )


def op4_ring_sharding(spark, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
