"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a minimum by node and a join, so no node's neighbours are ever gathered in one place; the
number of rounds grows with the logarithm of the longest chain. A round's links replace the last one's as
a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import Scratch


def _star(links: DataFrame) -> DataFrame:
    """links (u, v): every v of a node u with the smallest of u and its v's."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return links.join(least, F.col("u") == F.col("w")).drop("w")


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, label (the smallest node that it reaches) of every node with a link; links are (a, b), either way round."""
    n = links.count()
    now = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), n)
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        nxt = scratch.keep(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
                           .filter("u <> v").distinct(), n)
        scratch.drop(now)
        now, was = nxt, mark
        r = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        n, mark = r["n"], (r["n"], r["x"])
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
