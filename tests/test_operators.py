"""Extraction, topics, records, engine, sinks and stream."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.operators import html, records, topics
from lumenary.operators.articles import chained, with_article_fields
from lumenary.operators.languages import detected, profile
from lumenary.operators.videos import transcripts
from lumenary.plans.engine import Engine
from lumenary.sources import readers, writers
from lumenary.streaming.incremental import append_analysed, append_each, stream_records

AS_OF = "2026-04-01"
PAGE = """<!doctype html><html><head><title>A page</title><meta name="author" content=" Ann Lee "><meta property="article:published_time" content="2024-05-06T07:08:09Z">
<meta name="description" content="What it says"></head><body><script>var t = "</p><p>no";</script><nav><p>Subscribe to our newsletter today</p></nav>
<article><p>First a <b>bold</b> paragraph of the page &copy; here.<p>Second one, unclosed, long enough<!-- not <p>this</p> -->
<div><p>Third in a box, long enough as well</p></div><p>short</p></article></body></html>"""


def fields(page, glue=" "):
    root = html.parse(page)
    return html.title(root, glue), html.author(root, glue), html.raw_date(root, glue), html.description(root), html.paragraphs(root, glue)


def test_page_fields():
    title, author, date, about, body = fields(PAGE)
    assert (title, author, date, about) == ("A page", "Ann Lee", "2024-05-06T07:08:09Z", "What it says")
    assert body == ["First a bold paragraph of the page © here.", "Second one, unclosed, long enough", "Third in a box, long enough as well", "short"]
    assert fields(PAGE, "")[4][0] == "First aboldparagraph of the page © here."


@pytest.mark.parametrize(("page", "want"), [
    ('<meta property="og:title" content=" Social "><title>T</title>', "Social"), ("<title>T <b>x</b></title><h1>Head</h1>", "Head"), ("<h1>He<i>ad</i></h1>", "He ad"), ("", ""), (None, ""),
])
def test_titles(page, want):
    assert fields(page)[0] == want


@pytest.mark.parametrize(("page", "want"), [
    ('<script type="application/ld+json">{"author": {"name": "In Data"}}</script><meta name="author" content="M">', "In Data"),
    ('<script type="application/ld+json">{bad</script><script type="application/ld+json">{"author": [{"name": "First"}, "x"]}</script>', "First"),
    ('<script type="application/ld+json">[{"author": "In List"}]</script><meta property="article:author" content="Meta">', "Meta"),
    ('<script type="application/ld+json">{"author": "Str"}</script>', "Str"), ('<p class="post ByLine">By Someone</p>', "By Someone"), ("<p>x</p>", ""),
])
def test_authors(page, want):
    assert fields(page)[1] == want


def test_bodies_and_dates():
    long = "A paragraph that is surely longer than thirty characters"
    assert fields(f"<p>{long}</p><p>short</p>")[4] == [long]
    assert fields(f'<article></article><div class="x post-content"><p>in</p></div><p>{long}</p>')[4] == ["in"]
    assert fields("<time datetime='2020-02-02'>x</time>")[2] == "2020-02-02"
    assert fields("<time>3 May 2021</time>")[2] == "3 May 2021"


def test_gaps_are_filled_from_the_page(spark):
    page = spark.createDataFrame([("u1", PAGE), ("u2", PAGE), ("u3", PAGE), ("u4", None)], "url string, html string")
    schema = "url string, title string, author string, authors array<string>, published_date string, description string, raw_text_sections array<string>"
    first = spark.createDataFrame([("u1", "T", "A", ["A"], "2020-01-01", "", ["s"]), ("u2", "T", "", [], "", "", ["s"]), ("u3", None, None, None, None, None, None), ("u4", None, None, None, None, None, None)], schema)
    got = {r["url"]: r for r in html.filled(first, html.with_page_fields(page, AS_OF)).collect()}
    assert (got["u1"]["description"], got["u1"]["author"]) == ("", "A")
    assert (got["u2"]["title"], got["u2"]["author"], got["u2"]["published_date"], got["u2"]["description"], got["u2"]["raw_text_sections"]) == ("T", "Ann Lee", "2024-05-06", "What it says", ["s"])
    assert got["u3"]["title"] == "A page" and len(got["u3"]["raw_text_sections"]) == 3
    assert got["u4"]["title"] == "" and got["u4"]["raw_text_sections"] == []


XML = """<S><PubmedArticle><MedlineCitation><PMID>39801619</PMID><Article><ArticleTitle> A title </ArticleTitle><AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author>
<Author><LastName>Li</LastName><Initials>B</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList><Journal><Title>J</Title><JournalIssue><PubDate><Year>2024</Year><Month>Nov</Month></PubDate></JournalIssue></Journal>
<Abstract><AbstractText Label="METHODS">We <i>did</i> it.</AbstractText><AbstractText>End.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></S>"""


def test_articles(spark):
    frame = spark.createDataFrame([("1", XML), ("2", "<broken"), ("3", None), ("4", "<S/>")], "pmid string, xml string")
    got = {r["pmid"]: r for r in with_article_fields(frame).collect()}
    assert (got["1"]["title"], got["1"]["author"], got["1"]["authors"], got["1"]["published_date"]) == ("A title", "Ann Lee, B Li", ["Ann Lee", "B Li"], "2024-11-01")
    assert got["1"]["raw_text_sections"] == ["METHODS: We did it.", "End."] and got["1"]["description"] == "METHODS: We did it. End."
    assert {r["pmid"]: r for r in with_article_fields(frame, whole_text=False).collect()}["1"]["raw_text_sections"] == ["METHODS: We", "End."]
    assert all(got[k]["title"] is None for k in "234")


ARTICLE_PAGE = """<h1 class="heading-title">The  title</h1><div class="authors-list"><span><a class="full-name">Ann Lee</a></span><a class="full-name">Bo Li</a></div>
<div class="journal-actions"><button class="journal-title">J</button></div><span class="cit">2023 May;1(2):3</span><div id="eng-abstract"><p>One.</p><p> </p><p>Two.</p></div>"""


def test_article_pages_and_the_chain(spark):
    page = html.with_article_page_fields(spark.createDataFrame([("u", ARTICLE_PAGE)], "url string, html string"))
    row = page.first()
    assert (row["title"], row["authors"], row["journal"], row["published_date"], row["raw_text_sections"]) == ("The  title", ["Ann Lee", "Bo Li"], "J", "2023", ["One.", "Two."])
    untitled = XML.replace("<ArticleTitle> A title </ArticleTitle>", "")
    for xml, title, date in ((XML, "A title", "2024-11-01"), (untitled, "The  title", "2023"), (None, "The  title", "2023")):
        first = with_article_fields(spark.createDataFrame([("u", xml)], "url string, xml string"))
        got = chained([first, page], "url").first()
        assert (got["title"], got["published_date"]) == (title, date)
    bare = html.with_article_page_fields(spark.createDataFrame([("u", "<h1 class='heading-title'>Only</h1>")], "url string, html string"))
    got = chained([with_article_fields(spark.createDataFrame([("u", untitled)], "url string, xml string")), bare], "url").first()
    assert (got["title"], got["author"]) == ("Only", "Ann Lee, B Li")  # what the partial attempt had survives


def test_the_chain_of_articles_is_its_attempts_one_by_one(spark):
    from lumenary.operators.articles import article_records

    nested = XML.replace("<ArticleTitle> A title </ArticleTitle>", "").replace("</AbstractText>", " <i>more</i> tail</AbstractText>")
    rows = [("a", XML), ("b", XML.replace("<ArticleTitle> A title </ArticleTitle>", "")), ("c", None), ("d", "<broken"), ("e", nested), ("f", nested), ("g", XML), ("h", None)]
    xml = spark.createDataFrame(rows, "url string, xml string")
    pages = spark.createDataFrame([(u, ARTICLE_PAGE) for u in "abcdg"] + [("f", "<h1 class='heading-title'>Only</h1>"), ("h", None)], "url string, html string")
    want = chained([with_article_fields(xml, whole_text=False), with_article_fields(xml), html.with_article_page_fields(pages)], "url")
    got = article_records(xml, pages)
    assert got.columns == want.columns
    blank = lambda r: {k: v or None for k, v in r.asDict().items()}
    assert sorted(map(blank, got.collect()), key=lambda r: r["url"]) == sorted(map(blank, want.collect()), key=lambda r: r["url"])
    parses = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    assert (parses(got), parses(want)) == (2, 3)  # XML once, pages once


def test_a_page_is_parsed_once_for_both_extractors(spark):
    pages = [("a", PAGE), ("b", "<title>T</title><p>x</p>"), ("c", None), ("d", ""), ("e", "<body><p>A paragraph that is long enough to be content.</p><h1>H <b>x</b></h1><time datetime='2021-02-03'>x</time></body>"), ("f", ARTICLE_PAGE)]
    df = spark.createDataFrame(pages, "url string, html string")
    want = html.filled(html.parsed_articles(df, AS_OF), html.with_page_fields(df, AS_OF))
    got = html.whole_pages(df, AS_OF)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_topics(spark):
    frame = spark.createDataFrame([("He quietly did it",), ("Machine Learning for HOSPITALS",), ("",), (None,)], "t string")
    assert [r["g"] for r in frame.select(topics.keyword_tags(F.col("t")).alias("g")).collect()] == [["data engineering"], ["machine learning", "healthcare", "education"], [], []]
    sims = spark.createDataFrame([([0.5, 0.9, 0.9, 0.1],), ([0.1],), ([0.35, 0.4, 0.5, 0.6, 0.7, 0.8],)], "s array<double>")
    assert [r["i"] for r in sims.select(topics.top_k(F.col("s")).alias("i")).collect()] == [[2, 1, 0], [], [5, 4, 3, 2, 1]]
    merged = spark.createDataFrame([(["b", "a"], ["c", "a", "d"])], "s array<string>, k array<string>")
    assert merged.select(topics.merged_tags(F.col("s"), F.col("k"))).first()[0] == ["b", "a", "c", "d"]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 8)), rng.normal(size=(20, 8))
    a[0] = 0
    frame = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<double>, b array<double>")
    got = np.array([r["c"] for r in frame.select("i", topics.cosine(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()])
    norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    assert np.allclose(got, np.where(norm > 0, (a * b).sum(axis=1) / np.maximum(norm, 1e-12), 0))
    one = topics.hashed_encoder()
    v = one(["a text about machine learning", "", "a text about machine learning"])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1]) and np.allclose(v[0], v[2])
    text = spark.createDataFrame([(R.TOPICS[7][1],), ("",)], "t string")
    tags = [r["t"] for r in text.select(topics.semantic_tags(F.col("t")).alias("t")).collect()]
    assert tags[0][0] == "public health" and tags[1] == []
    assert len(text.select(topics.embedded(F.col("t")).alias("v")).first()["v"]) == 384


def test_languages(spark):
    words = {"en": "the and with water", "de": "der und mit wasser"}
    labelled = spark.createDataFrame([(i, f"{w} " * 5, lang) for i, (lang, w) in enumerate(words.items())], "i int, t string, lang string")
    texts = spark.createDataFrame([(0, "und der wasser mit der"), (1, "with the water and the"), (2, "short"), (3, "zzz " * 10), (4, None)], "i int, t string")
    got = {r["i"]: r["language"] for r in detected(texts, "i", "t", profile(labelled, "t", "lang")).collect()}
    assert got == {0: "de", 1: "en", 2: "unknown", 3: "unknown", 4: "unknown"}


def test_languages_without_labels(spark):
    from lumenary.operators.languages import detected_in

    texts = {"en": "The results of the study were not what they had been", "de": "Die Ergebnisse der Studie sind nicht das, was wir wollten", "fr": "Les résultats de cette étude ne sont pas dans le rapport",
             "es": "Los resultados del estudio no son los que se esperaban", "ja": "この研究の結果は予想とは異なるものでした。とても面白い", "zh-cn": "这项研究的结果与我们的预期完全不同，需要进一步分析讨论",
             "ru": "Результаты исследования были не такими, как мы думали", "el": "Τα αποτελέσματα της μελέτης δεν ήταν αναμενόμενα"}
    rows = [*texts.items(), ("unknown", "the and of"), ("unknown", "zzz " * 10), ("unknown", None), ("unknown", "12345 67890 12345 67890")]
    got = spark.createDataFrame(rows, "want string, t string").select("want", detected_in(F.col("t")).alias("got")).collect()
    assert [r["got"] for r in got] == [w for w, _ in rows]


def test_records_have_language_and_semantic_tags(spark, tmp_path):
    about = dict(R.TOPICS)["public health"]
    page = f"<title>{about}</title><article><p>The results of the study were not what they had been</p></article>"
    url = "https://blog.example/x"
    row = Engine(spark, AS_OF, pages=spark.createDataFrame([(url, page)], "url string, html string")).run([url]).first()
    assert row["language"] == "en"
    text = f"{about} The results of the study were not what they had been"
    frame = spark.createDataFrame([(text,)], "t string")
    semantic, keyword = frame.select(topics.semantic_tags(F.col("t")), topics.keyword_tags(F.col("t"))).first()
    assert semantic and row["topic_tags"] == list(dict.fromkeys([*semantic, *keyword]))[:5] != keyword[:5]
    raw = spark.createDataFrame([(1, url, "blog", about, "", [], "", "", ["The results of the study were not what they had been"])],
                                "doc_id long, url string, source_type string, title string, author string, authors array<string>, published_date string, description string, raw_text_sections array<string>")
    raw.write.parquet(str(tmp_path / "in"))
    append_analysed(stream_records(spark, str(tmp_path / "in"), raw.schema), str(tmp_path / "out"), str(tmp_path / "state"), AS_OF).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).first()
    assert (streamed["language"], streamed["topic_tags"]) == ("en", row["topic_tags"])


@pytest.fixture
def engine(spark, tmp_path):
    pages = spark.createDataFrame([("https://blog.google/a", PAGE), ("https://pubmed.ncbi.nlm.nih.gov/12345678/", ARTICLE_PAGE)], "url string, html string")
    metadata = spark.createDataFrame([("abcdefghijk", "Video", "", "Stanford Medicine", "20260121", "Line one is long enough\nshort\nhttps://a.b")], "id string, title string, channel string, uploader string, upload_date string, description string")
    segments = spark.createDataFrame([("abcdefghijk", 1, "b" * 100), ("abcdefghijk", 0, "a" * 100), ("abcdefghijk", 2, "tail of the talk")], "video_id string, pos int, text string")
    articles = spark.createDataFrame([("39801619", XML)], "pmid string, xml string")
    return Engine(spark, AS_OF, pages=pages, metadata=metadata, segments=segments, articles=articles, out_dir=str(tmp_path / "out"))


URLS = ["https://blog.google/a", "not a url", "https://www.youtube.com/watch?v=abcdefghijk", "https://pubmed.ncbi.nlm.nih.gov/39801619/", "https://pubmed.ncbi.nlm.nih.gov/12345678/",
        "https://gone.example/x", "https://www.youtube.com/watch?v=zzzzzzzzzzz", "https://blog.google/a"]


def test_engine_runs_a_batch(spark, engine):
    results = engine.run(URLS)
    got = {r["pos"]: r for r in results.collect()}
    assert sorted(got) == [0, 2, 3, 4, 5, 6, 7]  # invalid ones go, unreachable and repeated ones stay
    assert got[0]["title"] == "A page" and got[0]["author"] == "Ann Lee" and got[0]["published_date"] == "2024-05-06" and got[0]["trust_score"] == got[7]["trust_score"]
    assert got[2]["author"] == "Stanford Medicine" and got[2]["published_date"] == "2026-01-21" and got[2]["content_chunks"] == ["a" * 100 + " " + "b" * 100, "tail of the talk"]
    assert got[3]["author"] == "Ann Lee, B Li" and got[3]["region"] == "US" and got[3]["trust_signals"]["domain_authority"] == 1.0
    assert got[4]["title"] == "The  title" and got[4]["content_chunks"] == ["One. Two."] or got[4]["content_chunks"] == []
    assert got[5]["author"] == "unknown" and got[5]["published_date"] == "unknown" and got[5]["content_chunks"] == []
    assert got[6]["trust_signals"]["author_credibility"] == 0.2
    counts = engine.summary(readers.url_list(spark, URLS), results).first()
    assert (counts["total_urls"], counts["processed"], counts["failed"], counts["blog"], counts["youtube"], counts["pubmed"]) == (8, 7, 1, 3, 2, 2)


def test_engine_api(spark, engine):
    assert engine.health()["status"] == "ok" and engine.results() == ("empty", None)
    with pytest.raises(ValueError, match="No URLs"):
        engine.run([])
    with pytest.raises(ValueError, match="Could not process"):
        engine.run_one("nope")
    engine.run_one(URLS[0])
    engine.run_one(URLS[2])
    state, rows = engine.results()
    assert state == "success" and rows.count() == 2
    again = Engine(spark, AS_OF, out_dir=engine.out_dir)
    state, rows = again.results()
    assert state == "success" and rows.count() == 2 and rows.schema.simpleString() == spark.createDataFrame([], readers.RESULT).schema.simpleString()
    assert engine.run_default().count() == 6


def test_single_requests_join_the_batch_once_each(spark, engine):
    """However many there are the plan stays flat, and one made again adds nothing; a new batch replaces them."""
    batch = engine.run(URLS[:3])
    for k in range(5):
        engine.run_one(URLS[2 * (k % 2)], request=f"r{k}")
    before = engine.cached._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    for k in (0, 3, 3):
        engine.run_one(URLS[2 * (k % 2)], request=f"r{k}")
    assert engine.cached.count() == batch.count() + 5
    assert engine.cached._jdf.queryExecution().optimizedPlan().toString().count("Relation") == before
    assert sorted(r["source_type"] for r in engine.cached.filter("trust_score > 0").collect()) == ["blog"] * 4 + ["youtube"] * 3
    again = Engine(spark, AS_OF, pages=engine.pages, metadata=engine.metadata, segments=engine.segments, out_dir=engine.out_dir)
    again.run_one(URLS[0], request="r0")  # by another process, after a failure
    assert readers.results(spark, f"{engine.out_dir}/combined").count() == 5
    by_type = spark.read.json(f"{engine.out_dir}/by_type")
    assert {r["source_type"]: r["count"] for r in by_type.groupBy("source_type").count().collect()} == {"blog": 3, "youtube": 2}
    with pytest.raises(ValueError, match="No name"):
        engine.run_one(URLS[0], request="../x")
    engine.run(URLS[:1])
    assert engine.cached.count() == 1
    engine.run_one(URLS[0], request="after")
    assert engine.cached.count() == 2


def test_the_primary_extractor_finds_the_content(spark):
    page = """<html><head><title>T</title><meta name="author" content="By Ann Lee, Bo Li and Cy Ray"><meta name="date" content="2024-05-06"></head><body>
    <div class="menu"><p>Go here</p><p>Go there</p></div><nav><p>A long paragraph that stands in the navigation and is no content at all</p></nav>
    <div id="a"><div id="b"><p>The first paragraph of the content, which is long enough.</p><p>The second one, as long as that or longer.</p><p>short one that stays here</p></div>
    <p>A closing paragraph outside of the inner box.</p></div><footer><p>Some footer text that goes on and on and on and on, and on, and on, and on, and on, longer than all.</p></footer></body></html>"""
    rows = html.parsed_articles(spark.createDataFrame([("u", page), ("v", "<p>x</p>"), ("w", None)], "url string, html string"), AS_OF)
    got = {r["url"]: r for r in rows.collect()}
    assert got["u"]["title"] == "T" and got["u"]["authors"] == ["Ann Lee", "Bo Li", "Cy Ray"] and got["u"]["published_date"] == "2024-05-06"
    assert got["u"]["raw_text_sections"] == ["The first paragraph of the content, which is long enough.", "The second one, as long as that or longer.", "short one that stays here"]
    assert [got[u]["title"] for u in "vw"] == [None, None] and [got[u]["raw_text_sections"] for u in "vw"] == [None, None]


def test_one_of_several_contents_is_the_same_whatever_their_order(spark):
    url = "https://blog.example/x"
    pages = [(url, f"<title>Page {k}</title><article><p>A paragraph that is number {k} of several.</p></article>") for k in range(6)]
    got = {Engine(spark, AS_OF, pages=spark.createDataFrame(order, "url string, html string").repartition(n)).run([url]).first()["title"] for order, n in ((pages, 1), (pages[::-1], 3), (pages[3:] + pages[:3], 2))}
    assert len(got) == 1


def test_cleaning_stands_once_in_every_plan(spark):
    """What sections cost is paid once, whatever reads them: neither chunks nor signals repeat the cleaning."""
    from lumenary.plans import queries

    for name in ("sections_clean", "chunk_all", "trust_score", "trust_detailed", "topic_keyword", "word_counts", "language_text"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("&nbsp;") == 1, name


def test_boilerplate_parts_are_needed_by_the_patterns(spark):
    from lumenary.functions.text import BOILERPLATE_PARTS, is_boilerplate, may_hold_boilerplate

    assert len(BOILERPLATE_PARTS) == sum(p.count("|") + 1 for p in R.BOILERPLATE)
    odd = ["All RIGHTS reserved by them", "SUB\u017fcribe to what we write", "coo\u212aIE notice of this page", "s\u0130gn-up for a letter now", "s\u0131gn up for a letter now", "COPYRIGHT 2024 by me and you", "copyright by me and by you", "plain words only in here"]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select("x", is_boilerplate(F.col("x")).alias("is"), may_hold_boilerplate(F.col("x")).alias("may")).collect()
    assert all(r["may"] for r in rows if r["is"]) and not rows[-1]["may"] and sum(r["is"] for r in rows) >= 4


def test_sinks(spark, engine, tmp_path):
    rows = engine.run(URLS).drop("pos")
    assert writers.write_combined(rows.limit(0), str(tmp_path / "none")) is None and not (tmp_path / "none").exists()
    writers.write_by_type(rows, str(tmp_path / "t"))
    writers.write_by_type(rows.filter("source_type = 'blog'").limit(1), str(tmp_path / "t"))
    back = spark.read.schema(readers.RESULT).json(str(tmp_path / "t"))
    assert {r["source_type"]: r["count"] for r in back.groupBy("source_type").count().collect()} == {"blog": 1, "youtube": 2, "pubmed": 2}
    path = writers.export_array(rows, str(tmp_path / "deep" / "all.json"))
    data = json.loads(open(path, encoding="utf-8").read())
    assert len(data) == 7 and list(data[0])[:3] == ["source_url", "source_type", "author"] and "©" in open(path, encoding="utf-8").read()


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_an_array_is_what_one_writer_would_write(spark, tmp_path, n):
    """Byte for byte, in the order of pos, with nulls, line ends and letters beyond ASCII, over whatever stood there."""
    rows = spark.range(n).select((F.lit(n) - F.col("id")).alias("pos"), (F.col("id") * 2).alias("a.b"), F.lit('é\n"日').alias("t"), F.lit(None).cast("string").alias("z"), F.array(F.col("id") / 4).alias("l"))
    (tmp_path / "all.json").write_text("what stood there")
    path = writers.export_array(rows.repartition(7), str(tmp_path / "all.json"))
    want = [{"a.b": 2 * i, "t": 'é\n"日', "z": None, "l": [i / 4]} for i in reversed(range(n))]
    assert open(path, encoding="utf-8").read() == json.dumps(want, indent=2, ensure_ascii=False)
    assert [p for p in os.listdir(tmp_path) if not p.startswith(".")] == ["all.json"]


def test_transcripts_of_any_length(spark):
    """Blocks folded as segments pass are those of the whole transcript, also over many batches, with keys that repeat or lack."""
    import random

    from lumenary.operators.videos import transcript_blocks

    rng = random.Random(3)
    rows = [(v, p, rng.choice([None, "", " ", "\u00a0x ", "y" * 250, "some words", "日本 " * rng.randrange(9)])) for v in ("a", "b", None, "c") for p in range(300)] + [("a", 7, "again")] * 3 + [("d", 0, " ")]
    df = spark.createDataFrame(rows, "id string, p int, t string").repartition(3)
    want = {(r["id"], k, b) for r in transcripts(df, "id", "p", "t").collect() for k, b in enumerate(r["blocks"])}
    assert {tuple(r) for r in transcript_blocks(df, "id", "p", "t").collect()} == want
    long = spark.range(400_000).select(F.lit("v").alias("id"), F.col("id").alias("p"), F.lit("a segment of ten words that goes on for a while").alias("t"))
    got = transcript_blocks(long, "id", "p", "t").agg(F.count("*"), F.max("pos"), F.sum(F.length("block"))).first()
    assert (got[0], got[1]) == (80_000, 79_999)


def test_sources(spark, tmp_path):
    (tmp_path / "body.json").write_text('{"urls": ["a", "b"]}\n{"url": "c"}\n{}\n')
    assert sorted(r["url"] for r in readers.request_bodies(spark, str(tmp_path / "body.json")).collect()) == ["a", "b", "c"]
    area = spark.createDataFrame([(" a \n\n\t\nb",)], "value string")
    assert [(r["pos"], r["url"]) for r in readers.text_area(area).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "v.json").write_text('{"id": "x", "title": "T", "view_count": 3, "tags": ["q"]}\nbroken\n')
    assert [(r["id"], r["view_count"], r["tags"]) for r in readers.video_metadata(spark, str(tmp_path / "v.json")).collect()] == [("x", 3, ["q"])]
    (tmp_path / "a.xml").write_text(XML)
    assert readers.articles(spark, str(tmp_path / "a.xml")).first()["pmid"] == "39801619"
    assert readers.results(spark, str(tmp_path / "nothing")) is None and readers.default_urls(spark).count() == 6


def test_transcripts_keep_order(spark):
    rows = [("v", 2, "c"), ("v", 0, "a"), ("v", 1, " "), ("w", 0, "x" * 201), ("w", 1, None)]
    got = {r["id"]: r["blocks"] for r in transcripts(spark.createDataFrame(rows, "id string, p int, t string"), "id", "p", "t").collect()}
    assert got == {"v": ["a c"], "w": ["x" * 201]}


def test_stream_by_batch_function(spark, tmp_path):
    from lumenary.plans.queries import raw_records

    docs = spark.createDataFrame([(i, f"A line of document {i} that is long enough.\nAnother line") for i in range(6)], "doc_id long, text string")
    raw_records(docs).write.parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema(raw_records(docs).schema).parquet(str(tmp_path / "in"))
    append_each(stream, lambda batch, n: out.extend(batch.collect()), str(tmp_path / "state"), AS_OF, ("doc_id",)).awaitTermination()
    want = {r["doc_id"]: r["trust_score"] for r in records.detailed(records.analysed(raw_records(docs), AS_OF), ("doc_id",)).collect()}
    assert {r["doc_id"]: r["trust_score"] for r in out} == want


def test_bands(spark):
    from lumenary.functions.scores import trust_band

    rows = spark.createDataFrame([(0.7,), (0.4,), (0.39,), (None,)], "s double").select(trust_band(F.col("s")).alias("b")).collect()
    assert [(r["b"]["band"], r["b"]["percent"]) for r in rows] == [("green", 70), ("amber", 40), ("rose", 39), ("rose", 0)]
    assert records.summary(spark.createDataFrame([], "source_type string, trust_score double")).first()["processed"] == 0


@pytest.mark.parametrize("name", ["trust_detailed", "page_trust", "trust_score"])
def test_results_can_be_filtered_and_grouped_by_every_column(spark, name):
    from lumenary.plans import queries

    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    got = rows.collect()
    for c in rows.columns:
        value = got[0][c]
        assert rows.filter(F.col(c) == F.lit(value)).count() == sum(r[c] == value for r in got), c
    some = [c for c in rows.columns if c in ("language", "topic_tags", "trust_score")]
    assert rows.groupBy(*some).count().count() == len({tuple(r[c] for c in some) for r in got})
    assert rows.filter("trust_score > 0.5").count() == sum(r["trust_score"] > 0.5 for r in got)


def test_engine_results_can_be_filtered_and_joined(spark, engine):
    results = engine.run(URLS)
    got = results.collect()
    english = [r for r in got if r["language"] == "en"]
    assert english and sorted(r["pos"] for r in results.filter("language = 'en'").collect()) == sorted(r["pos"] for r in english)
    for c in ("title", "author", "topic_tags", "content_chunks", "trust_score", "region", "published_date"):
        value = english[0][c]
        kept = F.col(c) == (F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, list) else F.lit(value))
        assert results.filter(kept).count() == sum(r[c] == value for r in got), c
    langs = results.select("language", "trust_score").distinct().filter("language <> 'unknown'")
    assert results.join(langs, ["language", "trust_score"]).count() == sum(r["language"] != "unknown" for r in got)
    assert results.filter("trust_signals.content_quality >= 0 AND size(topic_tags) >= 0").count() == len(got)


def test_a_filter_on_a_source_column_reaches_the_scan(spark, tmp_path):
    """Filters on what records come with go below the cleaning; those on what is worked out do not repeat it."""
    from lumenary.plans import queries

    rows = queries.QUERIES["trust_score"](spark, "/root/testdata/sf0.001")
    by_id = rows.filter("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in by_id
    by_score = rows.filter("trust_score > 0.5")._jdf.queryExecution().optimizedPlan().toString()
    assert by_score.count("&nbsp;") == 1


def test_own_names_of_the_barrier_may_be_taken(spark):
    df = spark.createDataFrame([(1, 2)], "__settled int, __settled_ int")
    got = records.settled(df, x=F.col("__settled") + 1, __settled=F.col("__settled_") * 5)
    assert [r.asDict() for r in got.collect()] == [{"__settled_": 2, "x": 2, "__settled": 10}]


def test_one_pass_finds_what_a_search_for_each_phrase_does(spark, monkeypatch):
    """Phrases inside words, inside each other and overlapping, with and without the compiled automaton."""
    import builtins
    import random

    made = [("ab", "abc, b c, xx"), ("bc", "abcd, a"), ("data", "data science, big data, \u00e9t\u00e9"), ("science of data", "x|y, (z)")]
    rng = random.Random(1)
    texts = ["", None, "DATA SCIENCE OF DATA", "b cx x|y", "\u00c9T\u00c9 (Z)", *["".join(rng.choice("abcd x|y") for _ in range(30)) for _ in range(200)]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(topics.keyword_tags(F.col("t"), made).alias("a"), topics.phrase_tags(F.col("t"), made).alias("b")).collect()
    assert [r["a"] for r in got if r["a"] is not None] == [r["b"] for r in got if r["a"] is not None]
    compiled, real = topics.Phrases(made), builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ImportError()) if name == "ahocorasick" else real(name, *a, **k))
    plain = topics.Phrases(made)
    assert [plain((t or "").lower()) for t in texts] == [compiled((t or "").lower()) for t in texts]
