"""References in pages: named ones are closed by a semicolon; held against SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenary.operators import html
from lumenary.plans.queries import ORACLE_SQL, QUERIES

from .compare import connection, same


@pytest.mark.parametrize(("page", "want"), [
    ("&amp;&amp;&amp", "&&&amp"), ("&amp;&amp;&am", "&&&am"), ("a & b &", "a & b &"), ("&copy; &eacute;&lt;b&gt;", "© é<b>"), ("&copying; &copy2024", "&copying; &copy2024"),
    ("&amp;copy;", "&copy;"), ("&#39;&#x41;", "'A"), ("&notin; &notit;", "∉ &notit;"),
])
def test_named_references_are_closed(page, want):
    root = html.parse(f"<title>{page}</title><p title='{page.replace("'", '')}'>{page}</p><script>{page}</script>")
    p = root.find(lambda e: e.tag == "p")
    assert p.parts == [want] and p.attrs["title"] == want and html.title(root, "") == want
    assert "".join(root.find(lambda e: e.tag == "script").strings()) == page


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    heads = ["Cut &amp;&amp;&amp", "Cut &amp;&am", "Cut &", "Whole &amp; closed &quot;", "Cut &quot"]
    bodies = [f"<html><head><title>{h}</title></head><body><article><h1>{h}</h1><p>A paragraph of some length &amp;c, that ends as the title does: {h}</p></article></body></html>" for h in heads]
    pq.write_table(pa.table({"page_id": list(range(len(heads))), "url": [f"https://x.org/{i}" for i in range(len(heads))], "html": bodies}), folder / "pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["html_fields", "parsed_pages"])
def test_pages_agree_with_sql(spark, pages, name):
    same(spark, connection(pages), QUERIES[name], ORACLE_SQL[name], pages)
