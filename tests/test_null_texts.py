"""Documents without a text, of every type of source and description, held against SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenary.operators import records
from lumenary.plans.queries import ORACLE_SQL, QUERIES

from .compare import connection, same


@pytest.fixture(scope="module")
def nulls(tmp_path_factory):
    folder = tmp_path_factory.mktemp("nulls")
    texts = [None, "", "A text of some length that is no medical advice.\nIts second line says as much as that.", None] * 30
    langs = ["en", "de", "en", None] * 30
    table = {"doc_id": range(len(texts)), "text": texts, "lang": langs, "source": ["web"] * len(texts), "n_chars": [len(t or "") for t in texts]}
    pq.write_table(pa.table({k: list(v) for k, v in table.items()}), folder / "documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["trust_detailed", "trust_score", "disclaimer", "chunk_all", "language_text", "sections_clean"])
def test_null_texts_agree_with_sql(spark, nulls, name):
    same(spark, connection(nulls), QUERIES[name], ORACLE_SQL[name], nulls)


def test_null_sections_stay_null(spark):
    rows = spark.createDataFrame([(None,), ([],), ([""],)], "x array<string>")
    assert [r[0] for r in rows.select(records.cleaned(F.col("x"))).collect()] == [None, [], []]
