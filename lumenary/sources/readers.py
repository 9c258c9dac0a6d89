"""Sources: URL lists, request bodies, text areas, page and metadata dumps, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.functions.text import strip


def default_urls(spark: SparkSession) -> DataFrame:
    return url_list(spark, R.DEFAULT_URLS)


def url_list(spark: SparkSession, urls: list[str]) -> DataFrame:
    """pos, url of a list given by the caller."""
    return spark.createDataFrame(list(enumerate(urls)), "pos bigint, url string")


def request_bodies(spark: SparkSession, path: str) -> DataFrame:
    """request, pos, url of JSON bodies: a list under urls, or one under url."""
    body = spark.read.schema("urls array<string>, url string").json(path).withColumn("request", F.monotonically_increasing_id())
    asked = F.coalesce("urls", F.when(F.col("url").isNotNull(), F.array("url")), F.array().cast("array<string>"))
    return body.select("request", F.posexplode(asked).alias("pos", "url"))


def text_area(text: DataFrame, column: str = "value") -> DataFrame:
    """pos, url of pasted text: its lines, stripped, without blank ones."""
    lines = F.filter(F.transform(F.split(column, "\n"), strip), lambda s: s != "")
    return text.select(F.posexplode(lines).alias("pos", "url"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("url", "html")


def video_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a line; documents that do not parse give no metadata."""
    from lumenary.operators.videos import METADATA

    return spark.read.schema(METADATA).option("mode", "PERMISSIVE").json(path).filter(F.col("id").isNotNull())


def articles(spark: SparkSession, path: str) -> DataFrame:
    """pmid, xml from files that each hold one article's document."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.regexp_extract("value", r"<PMID[^>]*>\s*(\d+)", 1).alias("pmid"), F.col("value").alias("xml"))


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """Exported results, those of single requests included; None where nothing was exported."""
    from lumenary.sources.writers import exists

    return spark.read.schema(RESULT).option("recursiveFileLookup", True).json(path) if exists(spark, path) else None


SIGNALS = "struct<author_credibility: double, content_quality: double, domain_authority: double, recency_score: double, medical_disclaimer_score: double>"
RESULT = ("source_url string, source_type string, author string, published_date string, language string, region string, topic_tags array<string>, "
          f"trust_score double, content_chunks array<string>, title string, description string, trust_signals {SIGNALS}")
