from pyspark.sql import functions as F

from lumenary.operators.keywords import keyphrases, tags_with_keyphrases

TEXT = ("Graph databases store nodes and edges. A graph database answers path queries quickly. "
        "Many teams use Graph databases for fraud detection. The weather was fine on that day.")


def test_phrases_that_matter_come_first():
    found = [p for p, _ in keyphrases(TEXT)]
    assert "graph databases" in found[:3]
    assert all(len(p.split()) <= 2 and "the" not in p.split() for p in found)
    assert len(found) == len(set(found)) <= 20
    assert [v for _, v in keyphrases(TEXT)] == sorted(v for _, v in keyphrases(TEXT))


def test_odd_texts():
    assert keyphrases(None) == keyphrases("") == keyphrases("the of and") == keyphrases("... !!!") == []
    assert keyphrases("Word") == keyphrases("Word")


def test_tags(spark):
    frame = spark.createDataFrame([("Drug discovery, and drones.",), ("",), (None,)], "t string")
    assert [r["g"] for r in frame.select(tags_with_keyphrases(F.col("t")).alias("g")).collect()] == [["medical research", "robotics"], [], []]


def test_records_take_tags_that_only_keyphrases_tell(spark):
    """Words with something other than one blank between; elsewhere keyphrases add nothing to what the text says."""
    import random

    from lumenary.operators import keywords, records

    schema = "doc_id long, url string, source_type string, title string, author string, authors array<string>, published_date string, description string, raw_text_sections array<string>"
    raw = spark.createDataFrame([(k, "https://a.b/c", "blog", t, "", [], "", "", []) for k, t in enumerate(["All about data_visualization and drones", "All about data visualization and drones", "Plain"])], schema)
    got = {r["doc_id"]: r["topic_tags"] for r in records.analysed(raw, "2026-04-01").collect()}
    assert "data science" in got[0] and "data science" in got[1] and got[2] == []
    plain = records.analysed(raw, "2026-04-01", **records.keyword_only()).filter("doc_id = 0").first()["topic_tags"]
    assert "data science" not in plain  # the text alone does not tell
    rng = random.Random(2)
    words = "data science big Data, machine learning (deep) learning search engines - drones actuators CRISPR the of and".split()
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))
        phrases = [p for p, _ in keywords.keyphrases(text)]
        assert all(p in text.lower() for p in phrases), (text, phrases)
