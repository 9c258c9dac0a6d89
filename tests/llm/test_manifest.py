"""The Merkle manifest against a plain statement of its contract."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lumenary.llm import manifest as m

from ..compare import DATA, connection, same

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def up(nodes, at):
    """(the top, [(siblings before, after)]) of a list of digests, seen from one of them."""
    steps = []
    while len(nodes) > 1:
        first = at - at % 3
        steps.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        nodes, at = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], at // 3
    return nodes[0], steps


def brute(rows, altered):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r), leaf_of(altered(r))))
        leaves[s] = [leaf_of(r) for r in by[s]]
    subroots = [up(leaves[s], 0)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        root, over = up(subroots, k)
        for i, r in enumerate(by[s]):
            steps = up(leaves[s], i)[1] + over
            node = leaf_of(altered(r))
            for before, after in steps:
                node = sha(before, node, after)
            out.append((r[0], leaves[s][i], subroots[k], root, sha(*[x for b in steps for x in b]), node, node == root))
    return sorted(out, key=repr)


def altered(r):
    odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
    return (*r[:4], r[4].replace("\n", "")) if odd else r


def hard(n=300):
    rows = [(i, [None, "a", "a", "a", "é", "", "Z", f"s{i}"][i % 8], [None, "", "de"][i % 3], [None, i][i % 2], [None, "", "x\ny", "ü\n\n日本", "line " * i][i % 5]) for i in range(n)]
    return [*rows, rows[3], rows[3], rows[4], (None, "a", None, None, None), (None, "a", None, None, "t\n"), (-5, "a", "-", 0, "\n" * 9), (7, "only", "x", 1, "long \n" * 50_000)]


@pytest.mark.parametrize("low, top_nodes", [(0, 10_000), (1, 10_000), (2, 10_000), (5, 10_000), (1, 9), (0, 3)])
def test_manifest(spark, monkeypatch, low, top_nodes):
    """Blocks of one leaf to 243, the upper tree on the driver or, with few nodes allowed there, from tables."""
    monkeypatch.setattr(m, "LOW", low)
    rows = hard(300 if top_nodes > 9 else 60)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "grp", "leaf", "own", "pos", "n", "block", "steps", "node", "g", "b", "part", "at", "root")})
    held = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = m.manifest(docs.repartition(3), altered={"text": held}, top_nodes=top_nodes)
    got = got.select("doc_id", "leaf", "subroot", "root", m.proof_digest(F.col("proof")), "folded_root", F.col("folded_root") == F.col("root"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, altered)


def test_one_row_and_none(spark):
    one = m.manifest(spark.createDataFrame([(1, "s", None, None, "t")], SCHEMA)).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] == leaf_of((1, "s", None, None, "t")) and not one["proof"]
    assert m.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_change_shows(spark):
    rows = hard(40)
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA)
    for field, other in (("lang", F.lit("xx")), ("n_chars", F.lit(-1)), ("text", F.concat(F.coalesce("text", F.lit("")), F.lit("!")))):
        assert m.manifest(docs, altered={field: other}).filter("folded_root = root").count() == 0
    assert m.manifest(docs).filter("folded_root <> root").count() == 0


def test_sql(spark):
    same(spark, connection(), m.op13_merkle_manifest, m.SQL, DATA)
