"""From raw to normalised, enriched, scored and exported records: narrow projections, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.functions import scores
from lumenary.functions.dates import normal_date, parse_date
from lumenary.functions.folds import content_chunks, drop_near_duplicates
from lumenary.functions.text import bound, clean_text, is_boilerplate, may_hold_boilerplate, missing, present
from lumenary.functions.urls import domain_authority, is_valid, region, source_type
from lumenary.sources.scratch import kept, shared_folder


@dataclass(frozen=True)
class Models:
    """What is learned: an encoder of texts, and a judge of the languages of texts. Without them texts are encoded by
    hashing, and languages told by frequent words."""

    encode: Callable[[list[str]], np.ndarray] | None = None
    detect: Callable[[list[str | None]], list[str]] | None = None

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> Models:
        """The models that ``fit_models`` has stored at ``path``."""
        from lumenary.operators import embedding, languages

        return cls(embedding.encoder(embedding.stored(spark, path)), languages.judge(spark.read.schema(languages.GRAMS).parquet(f"{path}/languages")))


def fit_models(texts: DataFrame, labelled: DataFrame, path: str | None = None, text: str = "text", lang: str = "lang", **fit) -> Models:
    """Models of all ``texts`` and of the ``labelled`` ones, stored at ``path`` (a new shared folder without one)."""
    from lumenary.operators import embedding, languages

    path = path or shared_folder(texts.sparkSession, "models")
    embedding.fit(texts, text, path=path, **fit)
    kept(languages.trained(labelled, text, lang), f"{path}/languages")
    return Models.stored(texts.sparkSession, path)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each worked out once however results are filtered, joined or grouped by them.

    Catalyst pushes a filter below the projection that makes what it asks for, with that expression written out in its place:
    a chain of such columns would be written out many times over, and a Python function ends where it cannot be evaluated. It does
    not push filters on what a generator gives below that, while those on other columns go on to the scan."""
    name = "__settled"
    while name in df.columns:
        name += "_"
    others = [c for c in df.columns if c not in columns]
    made = df.withColumn(name, F.struct(*[c.alias(n) for n, c in columns.items()]))
    # Outer, as from a plain one a filter on the array would be inferred; it has one entry always.
    return made.select(*others, F.inline_outer(F.array(name)))


def routed(urls: DataFrame) -> DataFrame:
    """``urls`` (url, ...) with is_valid and source_type."""
    return urls.withColumn("is_valid", is_valid(F.col("url"))).withColumn("source_type", source_type(F.col("url")))


def author_display(author: Column, channel: Column, authors: Column) -> Column:
    return F.coalesce(present(author), present(channel), present(F.array_join(authors, ", ")), F.lit(R.UNKNOWN))


def cleaned(sections: Column, indexed: int | None = None) -> Column:
    """Cleaned, without empty, boilerplate and near-duplicate sections, null where there are none to clean; ``indexed`` as for ``drop_near_duplicates``.

    Cleaned texts have no white space but blanks, so trimming is enough, and the boilerplate patterns run over records
    that hold a part of one only."""
    texts = F.filter(F.transform(sections, clean_text), lambda s: s != "")
    kept = bound(texts, lambda t: F.when(may_hold_boilerplate(F.array_join(t, "\n")), F.filter(t, lambda s: ~is_boilerplate(s)))
                 .otherwise(F.filter(t, lambda s: F.length(F.trim(s)) >= R.BOILERPLATE_MIN_CHARS)))
    # Not F.trim itself: it takes a second argument, as which transform would pass the place, whose digit would be trimmed off.
    return F.when(sections.isNotNull(), drop_near_duplicates(F.transform(kept, lambda s: F.trim(s)), F.lower, indexed))


def normalised(raw: DataFrame, as_of: str, tolerant_dates: bool = True, indexed: int | None = None) -> DataFrame:
    """Raw records (url, source_type, title, author, authors, channel_name, published_date, description, raw_text_sections)
    in the normalised shape; other columns go on. ``published_on`` is the date that published_date names, or null. Sources
    whose dates are known to be in a native shape do without ``tolerant_dates`` and so without Python, as do those without records of
    ``indexed`` sections or more."""
    own = ["url", "source_type", "title", "author", "authors", "channel_name", "journal", "published_date", "description", "raw_text_sections"]
    channel = F.col("channel_name") if "channel_name" in raw.columns else F.lit(None).cast("string")
    made = settled(
        raw.withColumn("channel_name", channel),
        published_date=normal_date(F.col("published_date"), as_of, tolerant_dates),
        published_on=parse_date(F.when(~missing(F.col("published_date")), F.col("published_date")), as_of, tolerant_dates),
        cleaned_sections=cleaned(F.col("raw_text_sections"), indexed))
    return made.select(
        *[c for c in raw.columns if c not in own],
        F.col("url").alias("source_url"), "source_type",
        F.coalesce(present(F.col("title")), F.lit(R.UNKNOWN)).alias("title"),
        author_display(F.col("author"), F.col("channel_name"), F.col("authors")).alias("author_display"),
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors_list"),
        "published_date", "published_on",
        F.coalesce("description", F.lit("")).alias("description"),
        "cleaned_sections")


def topic_text(record: DataFrame | None = None) -> Column:
    return F.trim(F.concat_ws(" ", present(F.col("title")), present(F.col("description")), F.slice("cleaned_sections", 1, 3)))


def language_text() -> Column:
    return F.trim(F.concat_ws(" ", F.slice("cleaned_sections", 1, 5), present(F.col("description")), F.when(~missing(F.col("title")), F.col("title"))))


def judged(language: Column, topics: Column, with_tags: bool = True, models: Models | None = None) -> Column:
    """A struct of language (of the text ``language``), semantic_tags and phrase_tags (those that only keyphrases tell; of the text
    ``topics``; null without ``with_tags``). Two short texts go to Python; the records stay where they are."""
    from lumenary.operators.keywords import tags_of_keyphrases
    from lumenary.operators.languages import detector, long_enough
    from lumenary.operators.topics import nearest

    models = models or Models()
    near = nearest(models.encode) if with_tags else None

    @F.arrow_udf("language string, semantic_tags array<string>, phrase_tags array<string>")
    def judge(texts: pa.Array, about: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        langs = pa.array(models.detect(texts) if models.detect else map(detector(), texts), pa.string())
        about = about.to_pylist()
        tags = near(about) if near else [None] * len(about)
        phrases = map(tags_of_keyphrases, about) if near else [None] * len(about)
        return pa.StructArray.from_arrays([langs, pa.array(tags, pa.list_(pa.string())), pa.array(phrases, pa.list_(pa.string()))], ["language", "semantic_tags", "phrase_tags"])

    return judge(long_enough(language) if models.detect else language, topics)


def enriched(records: DataFrame, language: Column | None = None, tags: Column | None = None, models: Models | None = None) -> DataFrame:
    """Adds language, region, topic_tags (semantic ones before keyword ones) and content_chunks. Language and semantic tags are by
    ``models``, where there are any."""
    from lumenary.operators.topics import keyword_tags, merged_tags

    if language is None or tags is None:
        named = F.when(~missing(F.col("title")), F.col("title")), F.when(~missing(F.col("description")), F.col("description"))
        topic = F.trim(F.concat_ws(" ", *named, F.slice("cleaned_sections", 1, 3)))
        records = records.withColumn("__judged", judged(language_text(), topic, tags is None, models))
        language = language if language is not None else F.col("__judged.language")
    if tags is None:
        said, phrased = keyword_tags(topic_text()), F.col("__judged.phrase_tags")
        both = F.filter(F.array(*[F.lit(tag) for tag, _ in R.TOPICS]), lambda t: F.array_contains(said, t) | F.array_contains(phrased, t))
        tags = merged_tags(F.col("__judged.semantic_tags"), F.when(F.size(phrased) > 0, both).otherwise(said))
    return (settled(records, language=language, topic_tags=F.slice(tags, 1, R.TOP_K_TAGS)).drop("__judged")
            .withColumn("region", region(F.col("source_url")))
            .withColumn("content_chunks", content_chunks(F.col("cleaned_sections"), F.col("source_type"))))


def keyword_tags_only() -> dict[str, Column]:
    """Enrichment with the detected language, and of the tags the keyword ones."""
    from lumenary.operators.topics import keyword_tags

    return {"tags": keyword_tags(topic_text())}


def keyword_only() -> dict[str, Column]:
    """Enrichment without detection and semantic tags, all of it native: what the SQL of the named queries states."""
    from lumenary.operators.topics import keyword_tags

    return {"language": F.lit(R.UNKNOWN), "tags": keyword_tags(topic_text())}


def scored(records: DataFrame, as_of: str) -> DataFrame:
    """Adds the five signals and trust_score."""
    kind = F.col("source_type")
    out = settled(
        records,
        author_credibility=scores.author_credibility(F.col("author_display"), F.col("authors_list"), kind),
        content_quality=scores.content_quality(F.col("cleaned_sections"), F.col("description"), F.col("title"), kind),
        domain_authority=domain_authority(F.col("source_url"), kind),
        recency_score=scores.recency(F.col("published_date"), F.col("published_on"), kind, as_of),
        medical_disclaimer_score=scores.medical_disclaimer(F.col("topic_tags"), F.col("cleaned_sections"), F.col("description"), kind))
    return out.withColumn("trust_score", scores.trust(
        F.col("author_credibility"), F.col("content_quality"), F.col("domain_authority"), F.col("recency_score"), F.col("medical_disclaimer_score"), kind))


BASE = ["source_url", "source_type", "author", "published_date", "language", "region", "topic_tags", "trust_score", "content_chunks"]
SIGNALS = ["author_credibility", "content_quality", "domain_authority", "recency_score", "medical_disclaimer_score"]


def exported(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The nine columns of the base output, after ``keys``."""
    return records.withColumn("author", F.col("author_display")).select(*keys, *BASE)


def detailed(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The base output with title, description and the signals rounded to three places."""
    return records.withColumn("author", F.col("author_display")).select(
        *keys, *BASE, "title", "description", F.struct(*[F.round(c, 3).alias(c) for c in SIGNALS]).alias("trust_signals"))


def analysed(raw: DataFrame, as_of: str, tolerant_dates: bool = True, indexed: int | None = None, **enrichment) -> DataFrame:
    return scored(enriched(normalised(raw, as_of, tolerant_dates, indexed), **enrichment), as_of)


def summary(results: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Counts by type, mean trust to two places and, given the asked-for ``total`` rows, how many failed."""
    by_type = [F.count_if(F.col("source_type") == t).alias(t) for t in R.SOURCE_TYPES]
    out = results.agg(F.count("*").alias("processed"), *by_type, F.avg(F.coalesce("trust_score", F.lit(0.0))).alias("mean_trust"))
    if total is None:
        return out
    return out.join(F.broadcast(total.agg(F.count("*").alias("total_urls"))), F.lit(True)).withColumn("failed", F.col("total_urls") - F.col("processed"))


def chunk_words(chunks: Column) -> Column:
    """Words over all chunks, as pieces between white space."""
    return F.aggregate(F.transform(chunks, lambda c: F.size(F.split(c, r"\s+"))), F.lit(0), lambda a, n: a + n)


def display_title(title: Column, url: Column) -> Column:
    return F.coalesce(present(title), url)
