"""A Merkle manifest of a table: leaf, subroot and root digests, and for every row a proof that it stands in the root.

Rows are leaves of one tree for each value of a group column, in the order of a key; the trees' roots, in the order of
the group values, are the leaves of a last tree. Every ``arity`` consecutive nodes become their digest, the last run as it
is, until one node remains. This is the broadcast variant: leaves are ranked by a range sort and cut into blocks of
``arity ** height`` consecutive ones, which tasks reduce each to one node, keeping of every leaf the siblings on its way
there. Blocks grow with the table, so that the nodes above them are few (``top_nodes``); the driver builds that upper tree
and broadcasts for every block the siblings on its way to the root, with which executors finish the proofs and fold each
row's own leaf up to the root. Where the groups alone are more than ``top_nodes``, the upper tree is built the same way,
from a table of its blocks, and nothing of it passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.llm.common import BROADCAST_BYTES, Scratch, small_side, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a block at least and at most, as a power of the arity, and the number of blocks beyond which they grow.
LOW, HIGH, TOP_NODES = 5, 11, 32_768


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def levels(nodes: list[bytes], arity: int, height: int | None = None) -> list[list[bytes]]:
    """The levels of a tree, leaves first, until one node remains or, given ``height``, so many levels above the leaves."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        now = out[-1]
        out.append([hashlib.sha256(b"".join(now[i : i + arity])).hexdigest().encode() for i in range(0, len(now), arity)])
    return out


def path(tree: list[list[bytes]], at: int, arity: int) -> list[tuple[bytes, bytes]]:
    """(siblings before, siblings after) the node on each level, on the way from leaf ``at`` to the top."""
    out = []
    for level in tree[:-1]:
        first = at - at % arity
        out.append((b"".join(level[first:at]), b"".join(level[at + 1 : first + arity])))
        at //= arity
    return out


def fold(node: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in steps:
        node = hashlib.sha256(before + node + after).hexdigest().encode()
    return node


def ranked(leaves: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Adds pos (the row's place from 0 among its ``grp``, by ``order``) and n (rows of the group). No group is sorted in one
    place: rows go by range, and only the counts of a group by part are summed up."""
    whole = leaves.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    kept = scratch.keep(whole.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    first = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = kept.groupBy(F.col("part").alias("p"), F.col("grp").alias("g")).agg(F.count("*").alias("m"), F.min("at").alias("least"))
    whole_n = Window.partitionBy("g")
    ahead = scratch.keep(parts.select("p", "g", "least", F.coalesce(F.sum("m").over(first), F.lit(0)).alias("ahead"), F.sum("m").over(whole_n).alias("n")))
    # As many rows as there are parts and groups.
    return (kept.join(small_side(ahead, ahead.count()), (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
            .select(*leaves.columns, (F.col("at") - F.col("least") + F.col("ahead")).alias("pos"), "n"))


def reduced(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """Each row of ``nodes`` (grp, pos, n, leaf, own: hex digests; others go on) with its ``block``, the siblings on its way up
    the block (``steps``, binary, of each node, before and after), ``folded`` (``own`` folded up) and, on a block's first row, ``node``."""
    size = arity**height
    dealt = nodes.withColumn("block", F.floor(F.col("pos") / size)).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    added = "steps array<struct<before: binary, after: binary>>, folded string, node string"
    at = {c: dealt.columns.index(c) for c in ("grp", "block", "n", "leaf", "own")}

    def whole(rows: pa.Table) -> pa.RecordBatch:
        leaf, own, n = rows["leaf"].to_pylist(), rows["own"].to_pylist(), rows["n"][0].as_py()
        tree = levels([x.encode() for x in leaf], arity, height if n > size else None)
        ways = [path(tree, i, arity) for i in range(len(leaf))]
        steps = [[{"before": bytes.fromhex(b.decode()), "after": bytes.fromhex(a.decode())} for b, a in way] for way in ways]
        folded = [fold(x.encode(), way).decode() for x, way in zip(own, ways, strict=True)]
        node = [tree[-1][0].decode()] + [None] * (len(leaf) - 1)
        kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
        out = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
        return pa.RecordBatch.from_arrays([*out, pa.array(steps, kind), pa.array(folded, pa.string()), pa.array(node, pa.string())],
                                          [*rows.column_names, "steps", "folded", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one block, which has a bounded size
        last = None
        for batch in batches:
            keys = list(zip(batch.column(at["grp"]).to_pylist(), batch.column(at["block"]).to_pylist(), strict=True))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and keys[a] != last:
                    yield whole(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = keys[a]
        if held:
            yield whole(pa.Table.from_batches(held))

    schema = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    return dealt.mapInArrow(run, f"{schema}, {added}")


def _upper(blocks: list[tuple], arity: int) -> tuple[dict, dict, str]:
    """From (grp, block, node) of all blocks: the steps from each block to the root, subroot by group, and the root."""
    trees: dict = {}
    for grp, _, node in sorted(blocks, key=lambda b: (b[0] is not None, (b[0] or "").encode("utf-8", "surrogatepass"), b[1])):
        trees.setdefault(grp, []).append(node.encode())
    trees = {g: levels(nodes, arity) for g, nodes in trees.items()}
    top = levels([t[-1][0] for t in trees.values()], arity)
    above = {g: path(top, i, arity) for i, g in enumerate(trees)}
    steps = {(g, b): path(t, b, arity) + above[g] for g, t in trees.items() for b in range(len(t[0]))}
    return steps, {g: t[-1][0].decode() for g, t in trees.items()}, top[-1][0].decode()


STEPS = "array<struct<before: string, after: string>>"


def _suffixes(blocks: DataFrame, arity: int, top_nodes: int, n: int, scratch: Scratch) -> DataFrame:
    """g, b, above (steps from the block to the root), subroot and root of every block."""
    spark, schema = blocks.sparkSession, f"g string, b bigint, above {STEPS}, subroot string, root string"
    if n <= top_nodes:
        got = [tuple(r) for r in blocks.select("grp", "block", "node").collect()]
        steps, subroots, root = _upper(got, arity) if got else ({}, {}, "")
        rows = [(g, b, [(x.decode(), y.decode()) for x, y in way], subroots[g], root) for (g, b), way in steps.items()]
        most = sum(128 * len(r[2]) + 200 for r in rows)
        out = spark.createDataFrame(rows, schema)
        return F.broadcast(out) if most <= BROADCAST_BYTES else out

    # More groups than the driver takes: the blocks of a group make its subroot in a task, as a group has ``top_nodes`` blocks at most ...
    def tree(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        up = levels([x.encode() for x in rows["node"].to_pylist()], arity)
        ways = [[(x.decode(), y.decode()) for x, y in path(up, i, arity)] for i in range(len(up[0]))]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        ways = pa.array([[{"before": x, "after": y} for x, y in w] for w in ways], kind)
        return pa.table({"g": rows["grp"].cast(pa.string()), "b": rows["block"], "way": ways, "subroot": pa.array([up[-1][0].decode()] * len(rows), pa.string())})

    within = scratch.keep(blocks.select("grp", "block", "node").groupBy("grp").applyInArrow(tree, f"g string, b bigint, way {STEPS}, subroot string"))
    # ... and the subroots are leaves of one more tree, made like the trees below.
    roots = within.filter("b = 0").select(F.lit("").alias("grp"), F.col("g").alias("name"), F.col("subroot").alias("leaf"), F.col("subroot").alias("own"))
    top = _proved(roots, ["name"], arity, top_nodes, scratch)
    top = top.select(F.col("name").alias("of"), F.col("way").alias("over"), F.col("root"))
    return within.join(top, F.col("g").eqNullSafe(F.col("of"))).select("g", "b", F.concat("way", "over").alias("above"), "subroot", "root")


def _proved(leaves: DataFrame, order: list[str], arity: int, top_nodes: int, scratch: Scratch) -> DataFrame:
    """``leaves`` (grp, leaf, own, ...) with way (all steps to the root), subroot, root and folded_root."""
    placed = ranked(leaves, order, scratch)
    groups = placed.filter("pos = 0").select("n")
    blocks_at = [F.sum(F.ceil(F.col("n") / arity**h)).alias(str(h)) for h in range(LOW, HIGH + 1)]
    counts = groups.agg(*blocks_at).first()
    height = next((h for h in range(LOW, HIGH) if (counts[str(h)] or 0) <= top_nodes), HIGH)
    done = scratch.keep(reduced(placed, arity, height))
    blocks = done.filter("node is not null")
    above = _suffixes(blocks, arity, top_nodes, counts[str(height)] or 0, scratch)
    hexed = F.transform("steps", lambda s: F.struct(F.lower(F.hex(s["before"])).alias("before"), F.lower(F.hex(s["after"])).alias("after")))
    up = F.aggregate("above", F.col("folded"), lambda node, s: digest(s["before"], node, s["after"]))
    return (done.join(above, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
            .select(*leaves.columns, F.concat(hexed, "above").alias("way"), "subroot", "root", up.alias("folded_root")))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", altered: dict[str, Column] | None = None,
             arity: int = 3, top_nodes: int = TOP_NODES) -> DataFrame:
    """key, group, leaf, subroot, root, proof (steps of the siblings before and after on the way up) and folded_root of every row.

    ``altered`` gives fields other values, as a holder of the row may have them; the leaf of these values, folded with the
    manifest's siblings, is folded_root, which equals root if nothing was altered. The group goes in as text, nulls first and
    then by UTF-8 bytes; rows go by key, nulls first, those of one key by their digest, so repeated rows are leaves of their own. Null
    fields count as ``-``, empty texts as ``0:``; an empty table gives an empty result; other columns are not read."""
    altered = altered or {}
    leaf = digest(*[field(F.col(c)) for c in fields])
    own = digest(*[field(altered.get(c, F.col(c))) for c in fields])
    leaves = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), leaf.alias("leaf"), own.alias("own"))
    scratch = Scratch(docs.sparkSession, "manifest")
    leaves = scratch.keep(leaves)  # so that the range sort, which samples first, reads no text
    out = _proved(leaves, ["key", "leaf", "own"], arity, top_nodes, scratch)
    return out.select(F.col("key").alias(key), F.col("grp").alias(group), "leaf", "subroot", "root", F.col("way").alias("proof"), "folded_root")


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; of ids with an even checksum the holder's text lacks its line ends."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    held = F.when(odd, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(table(spark, sf_dir, "documents"), altered={"text": held})
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels_within: int = 14, levels_over: int = 8) -> str:
    """SQL over trees of 3 ** 14 leaves a source and 3 ** 8 sources at most: a table for each level."""
    def value(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"

    head, bare = " || ".join(map(value, FIELDS[:-1])), "replace(text, chr(10), '')"
    # CRC-32 of the decimal id, byte by byte.
    ctes = ["step AS (SELECT b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) r(b) UNION ALL "
            f"SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8)",
            "lookup AS (SELECT list(c ORDER BY b) AS l FROM step WHERE k = 8)",
            f"d AS (SELECT doc_id, source, xor(list_reduce(list_prepend(CAST({0xFFFFFFFF} AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), "
            f"lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1])), CAST({0xFFFFFFFF} AS BIGINT)) AS crc, sha256({head} || {value('text')}) AS leaf, "
            f"sha256({head} || {value(bare)}) AS bare FROM documents, lookup)",
            "r AS MATERIALIZED (SELECT doc_id, leaf, CASE WHEN crc % 2 = 0 THEN bare ELSE leaf END AS own, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, "
            "row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos FROM d)",
            "w0 AS MATERIALIZED (SELECT s AS g, pos, leaf AS d FROM r)",
            "p0 AS MATERIALIZED (SELECT doc_id, s AS g, pos, own AS f, '' AS sib FROM r)"]

    def climb(name: str, way: str, height: int) -> None:
        for i in range(height):
            now, nxt = f"{name}{i}", f"{name}{i + 1}"
            ctes.append(f"{nxt} AS MATERIALIZED (SELECT g, pos // 3 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d "
                        f"FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {now}) GROUP BY g, pos // 3)")
            ctes.append(f"{way}{i + 1} AS MATERIALIZED (SELECT p.doc_id, p.g, p.pos // 3 AS pos, CASE WHEN many THEN sha256(coalesce(string_agg(n.d, '' ORDER BY n.pos) FILTER (n.pos < p.pos), '') || p.f || "
                        f"coalesce(string_agg(n.d, '' ORDER BY n.pos) FILTER (n.pos > p.pos), '')) ELSE p.f END AS f, p.sib || coalesce(string_agg(n.d, '' ORDER BY n.pos) FILTER (n.pos <> p.pos), '') AS sib "
                        f"FROM {way}{i} p JOIN (SELECT *, count(*) OVER (PARTITION BY g) > 1 AS many FROM {now}) n ON p.g = n.g AND p.pos // 3 = n.pos // 3 GROUP BY p.doc_id, p.g, p.pos, p.f, p.sib, many)")

    climb("w", "p", levels_within)
    ctes.append(f"t0 AS MATERIALIZED (SELECT 0 AS g, g AS pos, d FROM w{levels_within})")
    ctes.append(f"q0 AS MATERIALIZED (SELECT doc_id, 0 AS g, g AS pos, f, sib FROM p{levels_within})")
    climb("t", "q", levels_over)
    return (f"WITH RECURSIVE {', '.join(ctes)} SELECT r.doc_id, r.leaf, w.d AS subroot, t.d AS root, sha256(q.sib) AS proof_sha256, q.f AS folded_root, q.f = t.d AS verified "
            f"FROM r JOIN q{levels_over} q ON r.doc_id = q.doc_id JOIN w{levels_within} w ON w.g = r.s, t{levels_over} t")


SQL = _sql()
