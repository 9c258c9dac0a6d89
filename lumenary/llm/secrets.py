"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The models are first-order Markov chains over printable ASCII, one of random strings and one of ordinary
identifiers. They are trained on labelled samples: positives are digests of running numbers in three
common spellings (base64, base64 without signs, upper-case base 32-like hex letters) and what the fixed
patterns found in the sampled documents; negatives are the other words of the sampled documents
that are too short to be candidates, as they stand, in capitals and run together as names are, and running numbers. The
sample is at most about ``sample_docs`` documents; only the table of transition counts (at most 95 * 95
rows) reaches the driver. Every token of ``LEAST`` characters or more that overlaps no pattern match is scored by the mean
log ratio of its transitions; the shorter it is, the more it has to reach (``SLOPE`` for each character under ``LONG``).
Everything that runs over the texts is a DataFrame expression.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import table

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of fewer characters fails and holds no other match, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
#: Tokens that the models look at.
SIGN = "A-Za-z0-9+/_=-"
LEAST, LONG = 12, 20  # characters of a candidate, and from which on a plain word is one too
#: A candidate of fewer than LONG characters is more than a word of lower-case letters after at most one capital.
CANDIDATE = rf"(?<![{SIGN}])(?:[{SIGN}]{{{LONG},}}|(?=[A-Z]?[a-z]*+[{SIGN}])[{SIGN}]{{{LEAST},{LONG - 1}}}(?![{SIGN}]))"
KINDS = ("assign", "access", "hex", "random")
SLOPE = 0.05
SYMBOLS = 95  # printable ASCII from the space on
SPAN = "array<struct<start: int, kind_no: int, end: int, kind: string, value: string>>"


def matches(text: Column, pattern: str, kind: str, group: int | None = None, least: int = 0) -> Column:
    """The matches of ``pattern`` as spans in code points; of those whose ``group`` is shorter than ``least``, none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("whole"), values.alias("value"))
    k = KINDS.index(kind)
    spans = F.aggregate(
        F.slice(zipped, F.lit(1), F.size(found)),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, m: F.struct(
            (a["at"] + F.length(m["gap"]) + F.length(m["whole"])).alias("at"),
            F.array_append(a["out"], F.struct(
                (a["at"] + F.length(m["gap"])).alias("start"), F.lit(k).alias("kind_no"),
                (a["at"] + F.length(m["gap"]) + F.length(m["whole"])).alias("end"), F.lit(kind).alias("kind"),
                m["value"].alias("value"))).alias("out")),
        lambda a: a["out"])
    if least:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    return F.concat(matches(text, ASSIGN, "assign", 2, 12), matches(text, ACCESS, "access"), matches(text, HEX, "hex"))


def _pairs(tokens: DataFrame) -> DataFrame:
    """token, label -> counts of (label, first, second) character numbers."""
    each = tokens.select("label", F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substr(token, i, 2))")).alias("pair"))
    a, b = F.ascii("pair") - 32, F.ascii(F.substring("pair", 2, 1)) - 32
    return (each.select("label", a.alias("a"), b.alias("b")).filter(f"a between 0 and {SYMBOLS - 1} and b between 0 and {SYMBOLS - 1}")
            .groupBy("label", "a", "b").agg(F.count("*").alias("n")))


def train(docs: DataFrame, sample_docs: int = 1000, synthetic: int = 2000) -> list[float]:
    """The log-likelihood ratio of each transition, at first * SYMBOLS + second."""
    spark = docs.sparkSession
    rows = max(1, docs.count())
    share = min(1 << 20, -(-sample_docs * (1 << 20) // rows))
    some = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", F.lit("markov")), F.lit(1 << 20)) < share)
    some = some.filter(F.col("text").isNotNull()).withColumn("found", base_spans(F.col("text")))
    secret = some.select(F.explode("found.value").alias("token"))
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    made = spark.range(synthetic).select(F.explode(F.array(
        F.base64(F.unhex(digest)), F.translate(F.base64(F.unhex(digest)), "+/=", ""),
        F.translate(F.substring(digest, 1, 20), "abcdef0123", "QWERTYUIOP"))).alias("token"))
    word = (some.select(F.explode(F.split("text", r"[^A-Za-z0-9+/_=-]+")).alias("token"), F.col("found.value").alias("values"))
            .filter(F.length("token").between(4, LEAST - 1) & ~F.exists("values", lambda v: F.contains(v, F.col("token")))).select("token"))
    plain = word.select(F.explode(F.array("token", F.upper("token"), F.concat(F.initcap("token"), F.initcap("token")))).alias("token"))
    number = spark.range(synthetic).select((F.pmod(F.col("id") * 48271, F.lit(10**9)) * 7919 + F.col("id")).cast("string").alias("token"))
    tokens = (secret.unionByName(made).filter(F.length("token") >= 2).withColumn("label", F.lit(1))
              .unionByName(plain.unionByName(number).withColumn("label", F.lit(0))))
    counts = {(r["label"], r["a"], r["b"]): r["n"] for r in _pairs(tokens).collect()}  # at most 2 * 95 * 95 rows
    total = {(y, a): sum(counts.get((y, a, b), 0) for b in range(SYMBOLS)) for y in (0, 1) for a in range(SYMBOLS)}

    seen = {(y, b): sum(counts.get((y, a, b), 0) for a in range(SYMBOLS)) for y in (0, 1) for b in range(SYMBOLS)}
    every = {y: sum(seen[y, b] for b in range(SYMBOLS)) for y in (0, 1)}

    def log_p(y: int, a: int, b: int) -> float:
        alone = (seen[y, b] / max(1, every[y]) + 1 / SYMBOLS) / 2  # what a rare first character falls back to
        return math.log((counts.get((y, a, b), 0) + 5 * alone) / (total[y, a] + 5))

    # A transition that neither sample has says nothing.
    known = {(a, b) for _, a, b in counts}
    return [log_p(1, a, b) - log_p(0, a, b) if (a, b) in known else 0.0 for a in range(SYMBOLS) for b in range(SYMBOLS)]


def score(token: Column, model: list[float]) -> Column:
    """The mean log ratio of a token's transitions."""
    ratios = F.from_json(F.lit(json.dumps([round(x, 5) for x in model])), "array<double>")  # folded to one literal
    code = lambda i: F.ascii(F.substr(token, i, F.lit(1))) - 32
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0),
                        lambda a, i: a + F.coalesce(F.get(ratios, code(i) * SYMBOLS + code(i + 1)), F.lit(0.0)))
    return total / (F.length(token) - 1)


def with_spans(docs: DataFrame, model: list[float], threshold: float = 1.8) -> DataFrame:
    """``docs`` with __base and __spans: pattern matches, and these with the tokens that the models hold for random."""
    text = F.coalesce("text", F.lit(""))
    based = docs.withColumn("__base", F.array_sort(base_spans(text))).withColumn("__tokens", matches(text, CANDIDATE, "random"))
    free = F.filter("__tokens", lambda t: ~F.exists("__base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
                    & (score(t["value"], model) >= threshold + SLOPE * F.greatest(LONG - F.length(t["value"]), F.lit(0))))
    return based.withColumn("__spans", F.when(F.size("__tokens") > 0, F.array_sort(F.concat("__base", free))).otherwise(F.col("__base"))).drop("__tokens")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, model: list[float] | None = None, threshold: float = 1.8) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) and found (array) of each row.

    Null texts count as empty; repeated rows each get their row; an empty table trains on the synthetic
    sample alone and gives an empty result; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    got = with_spans(docs, model or train(docs), threshold)
    n = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
                      joined(F.col("__spans")).alias("spans"), F.col("__spans").alias("found"))


def redacted(docs: DataFrame, model: list[float] | None = None, threshold: float = 1.8, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one), and n_chars to match."""
    # The caller's columns go along in one, so that none clashes with those made here.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    got = with_spans(own, model or train(docs), threshold)
    whole = F.aggregate(
        "__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
            .otherwise(a["out"]).alias("out")),
        lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)))
    out = got.select("row", F.when(F.size("__spans") > 0, whole).otherwise(F.col("text")).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents")).drop("found")
