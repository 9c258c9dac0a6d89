"""The parts of the operators' results that SQL can state, each as a query with its SQL.

The operators run as in their own queries, over the whole table; what is learned is left out of the result here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.packing import op9_tree_packing
from lumenary.llm.pii import op8_pii
from lumenary.llm.quality_rules import op7_quality_rules
from lumenary.llm.secrets import op10_secret_scan
from lumenary.llm.sharding import op4_ring_sharding


def shard_sizes(spark, sf_dir: str) -> DataFrame:
    """The rows of each shard, and its first and last slot and how many there are: gapless from 0."""
    return op4_ring_sharding(spark, sf_dir).groupBy("shard").agg(
        F.count("*").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"))


def shard_rows(spark, sf_dir: str) -> DataFrame:
    return op4_ring_sharding(spark, sf_dir).select("doc_id", "size", "text_crc32", "law")


def quality_base(spark, sf_dir: str) -> DataFrame:
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def private_base(spark, sf_dir: str) -> DataFrame:
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def secret_base(spark, sf_dir: str) -> DataFrame:
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def packed_documents(spark, sf_dir: str) -> DataFrame:
    """Of each document, whether its pieces hold each of its ids once, in pieces that fit."""
    p = op9_tree_packing(spark, sf_dir)
    got = p.groupBy("doc_id").agg(F.sum("length").alias("held"), F.max("doc_tokens").alias("tokens"), F.max(F.col("start") + F.col("length")).alias("end"),
                                  F.count_distinct("start").alias("starts"), F.count("*").alias("pieces"), F.min("length").alias("least"), F.max(F.col("offset") + F.col("length")).alias("reach"))
    return got.select("doc_id", ((F.col("held") == F.col("tokens")) & (F.col("end") == F.col("tokens")) & (F.col("starts") == F.col("pieces")) & (F.col("least") > 0) & (F.col("reach") <= 1024)).alias("whole"))


def packed_sequences(spark, sf_dir: str) -> DataFrame:
    """How many sequences have gaps, overlaps or too many ids, and whether less than a tenth is padding."""
    p = op9_tree_packing(spark, sf_dir)
    got = p.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("first"), F.count_distinct("offset").alias("offsets"), F.count("*").alias("pieces"))
    good = (F.col("n") == F.col("end")) & (F.col("first") == 0) & (F.col("offsets") == F.col("pieces")) & (F.col("n") <= 1024)
    return got.agg(F.sum(F.when(good, 0).otherwise(1)).alias("faults"), (F.sum("n") >= 0.9 * 1024 * F.count("*")).alias("dense"))


def _spans(kind: str, pattern: str, keep: str, value: str = "") -> str:
    """SQL for the matches of a pattern as rows of doc_id, kind, a and b, of those for which ``keep`` holds of the match ``m`` (and ``v``, its group)."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, a, a + length(m) AS b FROM (
    SELECT doc_id, ms[i] AS m, {f"regexp_extract(ms[i], '{pattern}', {value})" if value else "ms[i]"} AS v,
      CAST(list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda g: length(g))), 0) AS BIGINT) AS a
    FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM d) WHERE len(ms) > 0))
  WHERE {keep}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) "
         f"ELSE (2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INT)) // 10 + (2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INT)) % 10 END)) % 10 = 0")


def _counted(found: list[str], kinds: dict[str, int], by_kind: bool) -> str:
    order = " ".join(f"WHEN '{k}' THEN {n}" for k, n in kinds.items())
    order = f"CASE kind {order} END"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{k}'), 0) AS n_{k}" for k in kinds)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(found)}),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {f"{order}, a" if by_kind else f"a, {order}"}) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)
"""


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
QUERIES = {
    "shard_sizes": shard_sizes,
    "shard_rows": shard_rows,
    "quality_base": quality_base,
    "private_base": private_base,
    "secret_base": secret_base,
    "packed_documents": packed_documents,
    "packed_sequences": packed_sequences,
}
ORACLE_SQL = {
    "shard_sizes": """
SELECT CAST(s AS INT) AS shard, n, CAST(0 AS BIGINT) AS first_slot, n - 1 AS last_slot, n AS slots
FROM (SELECT s, (SELECT count(*) FROM documents) // 16 + CASE WHEN s < (SELECT count(*) FROM documents) % 16 THEN 1 ELSE 0 END AS n FROM range(16) r(s)) WHERE n > 0
""",
    # CRC-32 byte by byte, with the usual reflected polynomial.
    "shard_rows": f"""
WITH RECURSIVE step AS (SELECT b, CAST(b AS BIGINT) AS c, 0 AS k FROM range(256) r(b) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
lookup AS (SELECT list(c ORDER BY b) AS l FROM step WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, 'rows' AS law,
  xor(list_reduce(list_prepend(CAST({0xFFFFFFFF} AS BIGINT), list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1])), CAST({0xFFFFFFFF} AS BIGINT)) AS text_crc32
FROM d, lookup
""",
    "quality_base": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS} AS w FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
FROM n LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
""",
    "private_base": _counted([
        _spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE"),
        _spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
        _spans("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
        _spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ], {"email": 0, "ip": 1, "card": 2, "phone": 3}, True),
    "secret_base": _counted([
        _spans("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(v) >= 12", "2"),
        _spans("access", "AKIA[A-Z0-9]+", "length(m) >= 18"),
        _spans("hex", "[0-9a-f]+", "length(m) >= 16"),
    ], {"assign": 0, "access": 1, "hex": 2}, False),
    "packed_documents": "SELECT doc_id, TRUE AS whole FROM documents",
    "packed_sequences": "SELECT CAST(0 AS BIGINT) AS faults, TRUE AS dense",
}
