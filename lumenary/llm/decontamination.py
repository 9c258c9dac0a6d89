"""Benchmark decontamination: a prefix-filtered set join that finds item windows contained in documents.

A window is ``window`` consecutive words of a benchmark item (all of a shorter item). As a set of word
shingles, a window is contained in a document only if every one of its shingles is, so with the shingles
ordered by rarity over all documents a prefix of one, the rarest, is necessary and sufficient to look for
(length |W| - 1.0 * |W| + 1). Two passes over the texts: the first counts the shingles that benchmark
items have (a window with a shingle that no document has is dropped); the second joins each document
position with the windows whose rarest shingle stands there, bounds the window's place by the document's
length, and verifies the words one by one. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, Scratch, ascii_lower, small_side, table

#: What stands between words. Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased, so A-Z are in words here.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHINGLE = 2


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """words, length and items of each distinct window of ``items`` (item_id, text)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), word_array(ascii_lower(F.col("text"))).alias("w"))
    w = w.filter(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    each = w.select("item", "length", F.explode(F.expr("transform(sequence(1, size(w) - length + 1), i -> slice(w, i, length))")).alias("words"))
    return each.groupBy("words", "length").agg(F.collect_set("item").alias("items"))


def _key(first: Column, *rest: Column) -> Column:
    """A shingle as text. Full lower case only widens the candidates: exact words are verified later."""
    return F.concat_ws(" ", F.lower(first), *[F.lower(x) for x in rest])


def _positions(docs: DataFrame, size: int, sentinel: bool) -> DataFrame:
    """A row for each word position of each text, with the shingle that begins there; null past the last.

    With ``sentinel`` one row more, at position n_words, stands for the document itself."""
    words = docs.select("doc_id", "text", word_array(F.col("text")).alias("w")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "w", F.size("w").alias("n_words"))
    over = F.concat("w", F.array(F.lit(None).cast("string"))) if sentinel else F.col("w")
    rows = words.select("doc_id", "text_key", "w", "n_words", F.posexplode(over).alias("pos", "word"))
    rest = [F.get("w", F.col("pos") + k) for k in range(1, size)]
    fits = F.col("pos") + size <= F.col("n_words")
    return rows.withColumn("key", F.when(fits, _key(F.col("word"), *rest)))


def _hint(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df.hint("merge")


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, n_words, copies, spans (start, length) and items found."""
    wins = item_windows(items, window)
    sizes = wins.select(F.coalesce(F.sum(F.length(F.concat_ws(" ", "words")) * 3 + 64), F.lit(0)).alias("bytes"),
                        F.array_sort(F.collect_set(F.least("length", F.lit(SHINGLE)))).alias("sizes")).first()
    fits = sizes["bytes"] <= BROADCAST_BYTES  # else the same join by shuffle
    wins = wins.withColumn("size", F.least("length", F.lit(SHINGLE)))
    each = wins.select("words", "length", "items", "size", F.posexplode(F.expr(
        "transform(sequence(1, length - size + 1), i -> lower(concat_ws(' ', slice(words, i, size))))")).alias("at", "key"))
    vocabulary = each.select("size", "key").distinct()
    counts = None
    for size in sizes["sizes"]:
        found = (_positions(docs, size, False).select("key").filter(F.col("key").isNotNull())
                 .join(_hint(vocabulary.filter(F.col("size") == size).select("key"), fits), "key")
                 .groupBy("key").agg(F.count("*").alias("n")).withColumn("size", F.lit(size)))
        counts = found if counts is None else counts.unionByName(found)
    if counts is None:  # no item has a word
        counts = vocabulary.withColumn("n", F.lit(0).cast("long")).limit(0)
    ordered = Window.partitionBy("words").orderBy("n", "key", "at")
    whole = F.count("n").over(Window.partitionBy("words")) == F.count("*").over(Window.partitionBy("words"))
    prefix = (each.join(counts, ["size", "key"], "left").withColumn("whole", whole)
              .filter("whole").withColumn("r", F.row_number().over(ordered)).filter("r = 1")
              .select("size", "key", "at", "length", "items", F.concat_ws(" ", "words").alias("window_text")))
    prefix = Scratch(docs.sparkSession, "decontamination").keep(prefix)  # by far smaller than the documents; read once per size
    every = None
    for k, size in enumerate(sizes["sizes"] or [1]):
        rows = _positions(docs, size, k == 0)
        if fits:  # the words stay in the task that reads the text
            rows = rows.withColumn("around", F.col("w")).withColumn("place", F.col("pos"))
        else:
            keys = prefix.filter(F.col("size") == size).select(F.col("key").alias("known_key")).distinct()
            if keys.count() <= BROADCAST_ROWS:  # only positions at which a window's rarest shingle stands are shuffled with their words
                rows = rows.join(F.broadcast(keys), F.col("key") == F.col("known_key"), "left")
                rows = rows.filter(F.col("known_key").isNotNull() | (F.col("pos") == F.col("n_words"))).drop("known_key")
            low = F.greatest(F.col("pos") - window, F.lit(0))
            rows = rows.withColumn("around", F.slice("w", low + 1, 2 * window + 1)).withColumn("place", F.col("pos") - low)
        rows = rows.drop("w")
        p = prefix.filter(F.col("size") == size).drop("size").withColumnRenamed("key", "prefix_key")
        start = F.col("pos") - F.col("at")
        same = ((F.col("key") == F.col("prefix_key")) & (start >= 0) & (start + F.col("length") <= F.col("n_words"))
                & (ascii_lower(F.concat_ws(" ", F.slice("around", F.greatest(F.col("place") - F.col("at"), F.lit(0)) + 1, F.col("length")))) == F.col("window_text")))
        hit = rows.join(_hint(p, fits), same, "left").filter(F.col("window_text").isNotNull() | (F.col("pos") == F.col("n_words")))
        hit = hit.select("doc_id", "text_key", "n_words",
                         F.when(F.col("window_text").isNotNull(), F.struct(start.alias("start"), "length")).alias("span"), "items",
                         (F.lit(k == 0) & (F.col("pos") == F.col("n_words"))).cast("long").alias("row"))
        every = hit if every is None else every.unionByName(hit)
    return every.groupBy("doc_id", "text_key", "n_words").agg(
        F.sum("row").alias("copies"), F.collect_set("span").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans: Column) -> Column:
    """Positions inside any of the spans, each counted once."""
    return F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (array), items_sha256 and contaminated for each row of ``docs``.

    Null and wordless texts have no words and are never hit; items without words hit nothing; items with one
    text are all reported; repeated rows each get the row of their text; empty tables give what follows
    from that. Columns other than doc_id and text (item_id and text of the items) are not read.
    """
    found = occurrences(docs.select("doc_id", "text"), items, window)
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs. A row goes by its own doc_id and text, so clean rows with
    a null doc_id, or with the doc_id of a contaminated one, stay."""
    found = occurrences(docs.select("doc_id", "text"), items, window).filter(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct()
    found = Scratch(docs.sparkSession, "contaminated").keep(found)
    same = docs["doc_id"].eqNullSafe(found["hit_id"]) & (F.xxhash64(docs["text"]) == found["hit_key"])
    return docs.join(small_side(found, found.count()), same, "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.drop("items")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (
  SELECT DISTINCT doc_id, i, k.n, item
  FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
        FROM places, (SELECT DISTINCT n FROM wins) WHERE i + n - 1 <= len(w)) k JOIN wins USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
