"""Article records from XML, and the chain of sources that fills them."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenary.functions.dates import article_date
from lumenary.operators.html import with_article_page_fields
from lumenary.operators.records import settled

FIELDS = "title string, names array<struct<last: string, fore: string, initials: string>>, journal string, year string, month string, day string"


def _article(xml: str | None, *whole_text: bool) -> tuple:
    """The fields of an article, and its abstract once for each of ``whole_text``."""
    try:
        root = ElementTree.fromstring(xml) if xml else None
    except ElementTree.ParseError:
        root = None
    at = None if root is None else root.find(".//PubmedArticle/MedlineCitation/Article")
    if at is None:
        return (None,) * (6 + len(whole_text))
    names = [(a.findtext("LastName"), a.findtext("ForeName"), a.findtext("Initials")) for a in at.iterfind("AuthorList/Author")]
    parts = [[(t.get("Label"), "".join(t.itertext()) if whole else t.text or "") for t in at.iterfind("Abstract/AbstractText")] for whole in whole_text]
    day = at.find("Journal/JournalIssue/PubDate")
    when = [None] * 3 if day is None else [day.findtext(k, d) for k, d in (("Year", ""), ("Month", "01"), ("Day", "01"))]
    return (at.findtext("ArticleTitle"), names, at.findtext("Journal/Title"), *when, *parts)


def _read(articles: DataFrame, *whole_text: bool) -> DataFrame:
    """``articles`` (..., xml) with a: their fields, parsed once, and an abstract (abstract0, ...) for each of ``whole_text``."""
    abstracts = [f"abstract{k}" for k in range(len(whole_text))]
    names = [*[f.split()[0] for f in ("title", "names", "journal", "year", "month", "day")], *abstracts]
    schema = ", ".join([FIELDS, *[f"{a} array<struct<label: string, text: string>>" for a in abstracts]])

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for xml in batches:
            yield pd.DataFrame([_article(x, *whole_text) for x in xml], columns=names)

    return articles.withColumn("a", F.pandas_udf(read, schema)(F.col("xml")))


def _sections(abstract: str) -> Column:
    part = lambda p: F.when(F.coalesce(p["label"], F.lit("")) != "", F.concat(p["label"], F.lit(": "), F.trim(p["text"]))).otherwise(F.trim(p["text"]))
    return F.transform(abstract, part)


def _named() -> dict[str, Column]:
    name = lambda n: F.trim(F.concat(F.coalesce(F.nullif(n["fore"], F.lit("")), n["initials"], F.lit("")), F.lit(" "), n["last"]))
    authors = F.transform(F.filter("a.names", lambda n: F.coalesce(n["last"], F.lit("")) != ""), name)
    return {"title": F.trim("a.title"), "author": F.array_join(authors, ", "), "authors": authors, "journal": F.trim("a.journal"),
            "published_date": F.when(F.col("a.year").isNotNull(), article_date(F.col("a.year"), F.col("a.month"), F.col("a.day")))}


def with_article_fields(articles: DataFrame, whole_text: bool = True) -> DataFrame:
    """``articles`` (..., xml) as raw records. ``whole_text`` takes all text of an abstract part, also in and after
    nested markup; without it only what stands before the first nested element. XML that does not parse gives nulls."""
    got, sections = _read(articles, whole_text), _sections("a.abstract0")
    return got.select(*[c for c in articles.columns if c != "xml"], *[c.alias(n) for n, c in _named().items()],
                      F.array_join(sections, " ").alias("description"), sections.alias("raw_text_sections"))


def article_records(articles: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """One record per row of ``articles`` (key, xml) from three sources in a row, each asked only where those before gave no title: the
    XML with the first text of each abstract part, the XML with all text, and the article's page (``pages``: key, html). As ``chained``, but
    XML is parsed once, and only pages that are asked for."""
    got = _read(articles.select(key, "xml"), False, True)
    first, whole = _sections("a.abstract0"), _sections("a.abstract1")
    untitled = F.coalesce(F.trim("a.title"), F.lit("")) == ""
    sections = F.when(untitled & (F.size(whole) > 0), whole).otherwise(first)
    said = F.when(untitled & (F.array_join(whole, " ") != ""), F.array_join(whole, " ")).otherwise(F.array_join(first, " "))
    out = settled(got, **_named(), description=said, raw_text_sections=sections).select(key, *RECORD)
    asked = pages.select(F.col(key).alias("_key"), F.col("html").alias("_html"))
    both = out.join(asked, (F.col(key) == F.col("_key")) & (F.coalesce("title", F.lit("")) == ""), "left")
    page = with_article_page_fields(both.select(F.struct(key, *RECORD).alias("r"), F.col("_html").alias("html")))

    def pick(c: str) -> Column:
        has = F.size(c) > 0 if c in ("authors", "raw_text_sections") else F.coalesce(F.col(c), F.lit("")) != ""
        return F.when((F.coalesce("r.title", F.lit("")) == "") & F.coalesce(has, F.lit(False)), F.col(c)).otherwise(F.col(f"r.{c}")).alias(c)

    return page.select(F.col(f"r.{key}").alias(key), *[pick(c) for c in RECORD])


RECORD = ["title", "author", "authors", "journal", "published_date", "description", "raw_text_sections"]


def chained(attempts: list[DataFrame], key: str) -> DataFrame:
    """One record per key from attempts in order. Attempts go on until one has a title; of those made, the last that has
    a field says what it is, so fields of earlier, partial attempts survive."""
    out = attempts[0].select(key, *RECORD)
    for nxt in attempts[1:]:
        more = nxt.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in RECORD])
        both = out.join(more, F.col(key) == F.col("_key"), "left")
        done = F.coalesce(F.col("title"), F.lit("")) != ""

        def pick(c: str):
            new = F.col(f"_{c}")
            has = F.size(new) > 0 if c in ("authors", "raw_text_sections") else F.coalesce(new, F.lit("")) != ""
            return F.when(~done & F.coalesce(has, F.lit(False)), new).otherwise(F.col(c)).alias(c)

        out = both.select(key, *[pick(c) for c in RECORD])
    return out
