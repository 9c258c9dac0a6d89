"""The facade: what a service or a command line calls."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.functions.urls import article_id, video_id
from lumenary.operators import records
from lumenary.operators.articles import article_records
from lumenary.operators.html import filled, whole_pages, with_page_fields
from lumenary.operators.videos import transcripts, video_records
from lumenary.sources import readers, writers
from lumenary.sources.scratch import kept, shared_folder

VERSION = "1.0.0"
#: Sections of a record from which near copies are found by an index.
LONG = 2000
STORED = f"pos bigint, {readers.RESULT}"
RAW = ["title", "author", "authors", "channel_name", "journal", "published_date", "description", "raw_text_sections"]


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


class Engine:
    """Runs URLs through routing, extraction, normalisation, enrichment and scoring over content fetched beforehand.

    pages (url, html), parsed (url, title, author, authors, published_date, description, raw_text_sections: what a primary
    extractor gave; ``html.parsed_articles`` is one, and used where only pages are given), metadata (see videos.METADATA), segments (video_id, pos, text) and articles (pmid, xml) are tables;
    any may be missing. URLs without content keep their row and are scored on what is known. ``models`` are those of ``records.fit_models``."""

    def __init__(self, spark: SparkSession, as_of: str, *, pages: DataFrame | None = None, parsed: DataFrame | None = None, metadata: DataFrame | None = None,
                 segments: DataFrame | None = None, articles: DataFrame | None = None, out_dir: str | None = None,
                 tags: Callable[[], Column] | None = None, language: Callable[[], Column] | None = None, models: records.Models | None = None):
        from lumenary.operators.videos import METADATA

        self.spark, self.as_of, self.out_dir, self.tags, self.language, self.models = spark, as_of, out_dir, tags, language, models
        self.pages = pages if pages is not None else _empty(spark, "url string, html string")
        self.parsed = parsed
        self.metadata = metadata if metadata is not None else _empty(spark, METADATA)
        self.segments = segments if segments is not None else _empty(spark, "video_id string, pos int, text string")
        self.articles = articles if articles is not None else _empty(spark, "pmid string, xml string")
        self.batch: DataFrame | None = None
        self.requests: str | None = None  # the folder of single results
        self.since: dict[str, None] = {}  # names of those since the last batch

    def health(self) -> dict[str, str]:
        return {"status": "ok", "version": VERSION}

    def raw(self, urls: DataFrame) -> DataFrame:
        """Raw records of the valid rows of ``urls`` (pos, url); repeated URLs each keep their row."""
        routed = records.routed(urls).filter("is_valid").drop("is_valid")
        asked = lambda kind: routed.filter(F.col("source_type") == kind)

        def known(content: DataFrame, rows: DataFrame, key: str) -> DataFrame:
            """The content of the asked-for keys, one row each: of several the one of the least hash of its values, whatever order
            they come in. Only what is asked for is shuffled."""
            asked_for, rest = content.join(rows.select(key).distinct(), key, "left_semi"), [c for c in content.columns if c != key]
            one = asked_for.groupBy(key).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("__one"))
            return one.select(key, *[F.col("__one")[c].alias(c) for c in rest])

        page_of = lambda rows: known(self.pages, rows, "url")

        own = page_of(asked("blog"))
        if self.parsed is not None:
            blogs = filled(asked("blog").join(known(self.parsed, asked("blog"), "url"), "url", "left"), with_page_fields(own, self.as_of))
        else:
            blogs = asked("blog").join(whole_pages(own, self.as_of), "url", "left")
        videos = video_records(asked("youtube").withColumn("video_id", video_id(F.col("url"))), self.metadata,
                               transcripts(self.segments, "video_id", "pos", "text")).drop("video_id")
        papers = asked("pubmed").withColumn("pmid", article_id(F.col("url")))
        xml = papers.select("url", "pmid").distinct().join(known(self.articles, papers, "pmid"), "pmid", "left").select("url", "xml")
        paper = article_records(xml, page_of(papers))
        papers = papers.drop("pmid").join(paper, "url", "left")

        def shaped(df: DataFrame) -> DataFrame:
            arrays = ("authors", "raw_text_sections")
            none = {c: F.array().cast("array<string>") if c in arrays else F.lit("") for c in RAW}
            return df.select("pos", "url", "source_type", *[(F.coalesce(F.col(c), none[c]) if c in df.columns else none[c]).alias(c) for c in RAW])

        return shaped(blogs).unionByName(shaped(videos)).unionByName(shaped(papers))

    def analyse(self, urls: DataFrame) -> DataFrame:
        extra = {k: f() for k, f in (("tags", self.tags), ("language", self.language)) if f}
        return records.detailed(records.analysed(self.raw(urls), self.as_of, indexed=LONG, models=self.models, **extra), ("pos",))

    def run(self, urls: DataFrame | list[str]) -> DataFrame:
        """The detailed results of a batch, with pos; they replace the cached ones. ValueError for no URLs."""
        if isinstance(urls, list):
            if not urls:
                raise ValueError("No URLs provided.")
            urls = readers.url_list(self.spark, urls)
        elif urls.isEmpty():
            raise ValueError("No URLs provided.")
        self.batch, self.since = self.analyse(urls), {}
        return self.batch

    @property
    def cached(self) -> DataFrame | None:
        """The last batch and the single results since: two frames, however many those are."""
        one = self.spark.read.schema(STORED).parquet(*[f"{self.requests}/{r}" for r in self.since]) if self.since else None
        return one if self.batch is None else self.batch if one is None else self.batch.unionByName(one)

    def summary(self, urls: DataFrame, results: DataFrame) -> DataFrame:
        return records.summary(results, urls)

    def run_one(self, url: str, request: str | None = None) -> DataFrame:
        """The result of one URL, which joins the cached ones and what is written; ValueError if it is not valid. A result is stored under
        ``request`` (a new name without one), so that a call made again with the same name, as after a failure, replaces it and adds nothing."""
        request = request or uuid.uuid4().hex
        if not re.fullmatch(r"[\w-]+", request):
            raise ValueError(f"No name for a request: {request}")
        self.requests = self.requests or (f"{self.out_dir}/requests" if self.out_dir else shared_folder(self.spark, "requests"))
        got = kept(self.analyse(readers.url_list(self.spark, [url])).coalesce(1), f"{self.requests}/{request}")
        if got.isEmpty():
            raise ValueError(f"Could not process URL: {url}")
        self.since[request] = None
        if self.out_dir:
            writers.write_combined(got.drop("pos"), f"{self.out_dir}/combined/one-{request}")
            if not writers.exists(self.spark, f"{self.out_dir}/done/{request}"):
                writers.write_by_type(got.drop("pos"), f"{self.out_dir}/by_type", append=True)
                writers.touch(self.spark, f"{self.out_dir}/done/{request}")
        return got

    def run_default(self) -> DataFrame:
        return self.run(list(R.DEFAULT_URLS))

    def write(self, results: DataFrame, append: bool = False) -> tuple[str | None, str | None]:
        kept = results.drop("pos").persist()
        try:
            return writers.write_combined(kept, f"{self.out_dir}/combined", append), writers.write_by_type(kept, f"{self.out_dir}/by_type", append)
        finally:
            kept.unpersist()

    def results(self) -> tuple[str, DataFrame | None]:
        """("success", rows) of the cache or else of the last export; ("empty", None) where there is neither."""
        if (cached := self.cached) is not None:
            return "success", cached
        stored = readers.results(self.spark, f"{self.out_dir}/combined") if self.out_dir else None
        return ("success", stored) if stored is not None else ("empty", None)
