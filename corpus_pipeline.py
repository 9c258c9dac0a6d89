"""The corpus pipeline: from raw documents to packed training sequences.

Stages, each over all that the one before kept: language ID (documents whose language is not recognised
go), near duplicates (one document of each group stays), benchmark decontamination (documents with a
window of a benchmark item go), secret scan (secrets are masked in the text), packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenary.llm import decontamination, jaccard_join, language, packing, secrets
from lumenary.llm.common import Scratch, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the profiles, fitted on the labelled ones, recognise.

    Null, empty and letterless texts go, since they have no language; texts of a few letters and repeated rows stay, each
    row by itself; whole texts of any length are looked at; of languages that tie the first by name is taken; without labelled
    rows nothing is recognised, and an empty table gives an empty result. Other columns go through as they are."""
    return language.recognised(docs, language.fit(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group linked by five-word shingles at 0.8 or more.

    Of repeated rows one stays; rows without an id come last in their group; of a group's rows of one id and different texts that of
    the smallest text hash stays; texts that are null or have no words link with nothing and all stay; an
    empty table gives an empty result. Other columns go through as they are."""
    return jaccard_join.one_of_each(docs, shingle=5, num=80, den=100)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no ten-word window of a benchmark item occurs.

    Null, empty and wordless texts stay; each row goes by its own id and text, so repeated rows share a verdict and rows that only share
    an id do not; empty tables of documents or items leave what there is. Other columns go through as they are."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets masked and n_chars to match.

    Null texts stay null, and so does their n_chars; empty texts and texts without secrets stay as they are; repeated rows each stay; of
    spans that overlap one mark remains; an empty table gives an empty result. Other columns go through as they are."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it stands in which training sequence.

    Null and empty texts are the end id alone; repeated rows, and rows without an id, are packed each for itself; texts of any length are
    cut into as many pieces as they need; an empty table gives an empty result; other columns are not read."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("ngram_jaccard_join", without_near_duplicates),
    ("benchmark_decontamination", without_benchmarks),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Learned profiles and models have no SQL; tests hold the stages against plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row over ``documents``; each one's output is written, and the one before it removed."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
