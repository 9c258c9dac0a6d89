"""Records of lines that begin and end with the digits of their place, held against SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenary.operators import records
from lumenary.plans.queries import ORACLE_SQL, QUERIES

from .compare import connection, same


def line(place: int) -> str:
    return f"{place} of the numbers that stand at either end of line {'abcdefghijklm'[place] * 60} are told by {place}"


def test_cleaning_keeps_the_digits_of_places(spark):
    sections = [line(i) for i in range(13)] + ["\x01 a blank stands beside a control here \x02"]
    got = spark.createDataFrame([(sections,)], "x array<string>").select(records.cleaned(F.col("x"))).first()[0]
    assert got == [*sections[:13], "a blank stands beside a control here"]


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    folder = tmp_path_factory.mktemp("lines")
    texts = ["\n".join(line(i) for i in range(n)) for n in (1, 2, 4, 13)] + ["The card is 4072374829496490", "Two lines of text.\nThe host is 16.155.205.171", "", None, "\x01 a blank beside a control"]
    table = {"doc_id": range(1, len(texts) + 1), "text": texts, "lang": ["en"] * len(texts), "source": ["web"] * len(texts), "n_chars": [len(t or "") for t in texts]}
    pq.write_table(pa.table({k: list(v) for k, v in table.items()}), folder / "documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["sections_clean", "language_text", "chunk_all", "trust_detailed"])
def test_lines_agree_with_sql(spark, lines, name):
    same(spark, connection(lines), QUERIES[name], ORACLE_SQL[name], lines)
