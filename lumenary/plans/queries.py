"""Named queries over the test tables, one per operator group, each with its SQL where there is any.

``documents`` has no URL, author or date, so the record queries derive them from doc_id by rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.functions import dates, folds, scores, urls
from lumenary.functions import text as T
from lumenary.operators import embedding, keywords, languages, records, topics
from lumenary.operators.articles import with_article_fields
from lumenary.operators.html import parsed_articles, with_article_page_fields, with_page_fields
from lumenary.operators.videos import transcript_blocks, transcripts, video_records
from lumenary.plans import oracle as O
from lumenary.sources import readers, writers
from lumenary.sources.scratch import kept, shared_folder
from lumenary.streaming.incremental import append_analysed, stream_records

AS_OF = "2026-04-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else O.text(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names}))"


# URLs: those of pages, and a list that reaches every rule.

URLS = [
    *R.DEFAULT_URLS, "http://x.com", "HTTP://X.com/A", "ftp://x.com/a", "https://", "https:///path", "no url", "", "//host.org/x",
    "https://a.com/?ref=youtube.com", "https://www.ncbi.nlm.nih.gov/pubmed/123456", "https://www.youtube.com/watch?v=abc&t=1",
    "https://youtube.com/shorts/ID1", "https://www.youtube.com/embed/ID2/more", "https://youtu.be/XyZ", "https://youtu.be/", "https://m.youtube.com/watch?t=2&v=a%20b",
    "https://www.youtube-nocookie.com/embed/abcdefghijk", "https://www.youtube.com/user/abcdefghijk", "https://www.youtube.com/watch?v=",
    "https://pubmed.ncbi.nlm.nih.gov/12345/", "https://pubmed.ncbi.nlm.nih.gov/12345678901", "https://excell.com", "https://mit.edu/x", "https://x.edu.cn",
    "https://a.blogspot.com", "https://x.co.uk", "https://x.co.uk:8080", "https://user@x.co.in/p?q=1#f", "https://a.medium.com", "https://x.org", "https://bbc.co.uk/news",
    "https://blog.example.ac.uk", "https://army.mil", "https://www.who.int", "https://Research.Google/pubs", "https://x.de", "https://x.fr?y", "https://x.jp#z",
    "https://www.healthline.com/a", "https://state.gov", "https://github.com/a/b", "https://a.wordpress.com/1",
]


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = values(spark, [(u,) for u in URLS], "url string")
    return table(spark, sf_dir, "pages").select("url").unionByName(more)


_URLS = f"(SELECT url FROM pages UNION ALL SELECT url FROM {sql_values([(u,) for u in URLS], 'url')}) u"


@query(f"SELECT url, regexp_matches(url, '^(?i:https?)://[^/?#]+') AS is_valid FROM {_URLS}")
def url_validate(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", urls.is_valid(F.col("url")).alias("is_valid"))


@query(f"SELECT url, {O.kind('url')} AS source_type FROM {_URLS}")
def url_classify(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", urls.source_type(F.col("url")).alias("source_type"))


@query(f"SELECT url, {O.host('url')} AS netloc FROM {_URLS}")
def url_netloc(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", urls.netloc(F.col("url")).alias("netloc"))


@query(f"SELECT url, {O.region('url')} AS region FROM {_URLS}")
def url_region(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", urls.region(F.col("url")).alias("region"))


@query(f"SELECT url, {O.domain('url', O.kind('url'))} AS domain_authority FROM {_URLS}")
def url_domain_authority(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", urls.domain_authority(F.col("url"), urls.source_type(F.col("url"))).alias("domain_authority"))


_HOST = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_PATH = "trim(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/')"
_STANDARD = (f"coalesce(url_decode(nullif(regexp_extract(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '(?:^|&)v=([^&]+)', 1), '')), "
             f"nullif(regexp_extract({_PATH}, '^(?:shorts|embed|v)/([^/]*)', 1), ''))")


@query(f"SELECT url, CASE WHEN contains({_HOST}, 'youtube.com') AND {_STANDARD} IS NOT NULL THEN {_STANDARD} WHEN contains({_HOST}, 'youtu.be') THEN nullif({_PATH}, '') "
       f"ELSE nullif(regexp_extract(url, '(?:v=|/)([a-zA-Z0-9_-]{{11}})', 1), '') END AS video_id FROM {_URLS}")
def video_id(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", urls.video_id(F.col("url")).alias("video_id"))


@query(f"SELECT url, nullif(regexp_extract(url, '/(\\d{{6,10}})/?', 1), '') AS article_id FROM {_URLS}")
def pubmed_id(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", urls.article_id(F.col("url")).alias("article_id"))


# Text.


@query(f"SELECT page_id, {O.clean('html')} AS cleaned FROM pages")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html")).alias("cleaned"))


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


_LINES = "(SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) x"


@query(f"SELECT doc_id, pos, {O.strip('line')} AS line FROM {_LINES} WHERE NOT {O.boilerplate('line')}")
def boilerplate_filter(spark, sf_dir):
    return _lines(spark, sf_dir).filter(~T.is_boilerplate(F.col("line"))).select("doc_id", "pos", T.strip(F.col("line")).alias("line"))


@query(f"SELECT doc_id, pos, line FROM {_LINES} WHERE NOT {O.noise('line')}")
def noise_filter(spark, sf_dir):
    return _lines(spark, sf_dir).filter(~T.is_noise(F.col("line")))


_SECTIONS = f"(SELECT doc_id, {O.cleaned('string_split(text, chr(10))')} AS sections FROM documents) x"


@query(f"SELECT doc_id, array_to_string(sections, chr(10)) AS sections, len(sections) AS n_sections FROM {_SECTIONS}")
def sections_clean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", records.cleaned(F.split("text", "\n")).alias("s"))
    return docs.select("doc_id", F.array_join("s", "\n").alias("sections"), F.size("s").cast("long").alias("n_sections"))


@query(f"SELECT doc_id, array_to_string(s, chr(10)) AS sentences, len(s) AS n FROM (SELECT doc_id, {O.sentences('text')} AS s FROM documents) x")
def sentence_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.array_join("s", "\n").alias("sentences"), F.size("s").cast("long").alias("n"))


def _folded(spark, sf_dir, fold):
    docs = table(spark, sf_dir, "documents").select("doc_id", fold(F.split("text", "\n")).alias("c"))
    return docs.select("doc_id", F.array_join("c", "\n").alias("chunks"), F.size("c").cast("long").alias("n"))


def _folded_sql(fold: str) -> str:
    return f"SELECT doc_id, array_to_string(c, chr(10)) AS chunks, len(c) AS n FROM (SELECT doc_id, {fold} AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) x"


@query(_folded_sql(O.groups("l")))
def abstract_groups(spark, sf_dir):
    return _folded(spark, sf_dir, folds.sentence_groups)


@query(_folded_sql(O.merge_short("l")))
def merge_short(spark, sf_dir):
    return _folded(spark, sf_dir, folds.merge_short)


@query(_folded_sql(O.split_long("l")))
def split_long(spark, sf_dir):
    return _folded(spark, sf_dir, folds.split_long)


@query(f"SELECT CAST(conv_id AS VARCHAR) AS video_id, array_to_string({O.transcript('segs')}, chr(10)) AS blocks FROM "
       "(SELECT conv_id, list(coalesce(text, '') ORDER BY turn, text) AS segs FROM conversations GROUP BY conv_id) x")
def transcript_merge(spark, sf_dir):
    segments = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), "turn", "text")
    return transcripts(segments, "video_id", "turn", "text").select("video_id", F.array_join("blocks", "\n").alias("blocks"))


@query(f"SELECT CAST(conv_id AS VARCHAR) AS video_id, CAST(i - 1 AS BIGINT) AS pos, b[i] AS block FROM (SELECT conv_id, b, unnest(range(1, len(b) + 1)) AS i FROM "
       f"(SELECT conv_id, {O.transcript('segs')} AS b FROM (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, text) AS segs FROM conversations GROUP BY conv_id)))")
def transcript_stream(spark, sf_dir):
    """Blocks of transcripts, folded as sorted segments pass."""
    segments = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), "turn", "text")
    return transcript_blocks(segments, "video_id", "turn", "text")


# Authors and dates.

AUTHORS = [
    ("", "", ""), ("Yossi Matias", "", ""), ("", "TED", ""), ("", "", "Ann Lee|Bo Li"), ("unknown", "Chan", "A B"), (" Admin ", "", ""), ("Maya", "", ""), ("maya", "", ""),
    ("United Cats", "", ""), ("Google Cloud", "", ""), ("Mayo Clinic", "x", "y"), ("Al", "", ""), ("Jane Doe", "", "Jane Doe|Max Roe|Zoe Poe"), ("Stanford Medicine", "", ""), ("   ", "", ""),
    ("The Meta Team", "", ""), ("O'Neil", "", ""), ("Dept of Health", "", "One Two|Three Four"),
]


def _dealt(spark, sf_dir, rows: list[tuple], names: str, *more) -> DataFrame:
    """Each document, ``more`` of it, and the row of ``rows`` that its id picks."""
    options = F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(names.split(), r, strict=True)]) for r in rows])
    return table(spark, sf_dir, "documents").select("doc_id", F.struct(*more).alias("m"), F.get(options, F.expr(f"CAST(doc_id % {len(rows)} AS INT)")).alias("r")).select("doc_id", "r.*", *(["m.*"] if more else []))


def _authors(spark, sf_dir):
    """An author, channel and list of names for each document; every fifth signs with the first words of its text."""
    rows = _dealt(spark, sf_dir, AUTHORS, "author channel names", F.expr(_SIGNED).alias("signed"))
    rows = rows.withColumn("author", F.when(F.col("doc_id") % 5 == 0, F.col("signed")).otherwise(F.col("author")))
    return rows.withColumn("authors", F.filter(F.split("names", r"\|"), lambda n: n != ""))


_SIGNED = "trim(regexp_replace(substr(coalesce(text, ''), 1, 24), '[^A-Za-z]+', ' '))"  # the first words, in SQL of both engines but for what follows
_AUTHORS = (f"(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN {_SIGNED[:-2]}, 'g')) ELSE author END AS author, channel, names, list_filter(string_split(names, '|'), lambda n: n <> '') AS authors "
            f"FROM documents JOIN {sql_values([(i, *a) for i, a in enumerate(AUTHORS)], 'id, author, channel, names')} ON id = doc_id % {len(AUTHORS)}) x")
_DISPLAY = "coalesce(nullif(author, ''), nullif(channel, ''), nullif(array_to_string(authors, ', '), ''), 'unknown')"


@query(f"SELECT doc_id, {_DISPLAY} AS author_display FROM {_AUTHORS}")
def normalize_author(spark, sf_dir):
    return _authors(spark, sf_dir).select("doc_id", records.author_display(F.col("author"), F.col("channel"), F.col("authors")).alias("author_display"))


@query("SELECT doc_id, source_type, " + O.author("a", "authors", "source_type") + f" AS author_credibility FROM (SELECT *, {_DISPLAY} AS a FROM {_AUTHORS}), "
       "(VALUES ('blog'), ('youtube'), ('pubmed'), ('other')) k(source_type)")
def author_credibility(spark, sf_dir):
    kinds = F.explode(F.array(*map(F.lit, ["blog", "youtube", "pubmed", "other"]))).alias("source_type")
    rows = _authors(spark, sf_dir).select("doc_id", "authors", records.author_display(F.col("author"), F.col("channel"), F.col("authors")).alias("a"), kinds)
    return rows.select("doc_id", "source_type", scores.author_credibility(F.col("a"), F.col("authors"), F.col("source_type")).alias("author_credibility"))


_RENDERED = {0: ("yyyy-MM-dd", "%Y-%m-%d"), 1: ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"), 2: ("MMM d, yyyy", "%b %-d, %Y"), 3: ("d MMM yyyy", "%-d %b %Y"), 4: ("yyyyMMdd", "%Y%m%d"), 5: ("MM/dd/yyyy", "%m/%d/%Y")}


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN 'unknown' WHEN o_orderkey % 9 = 7 THEN 'no date here' "
       "ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published_date FROM orders")
def normalize_date(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    raw = F.when(F.col("o_orderkey") % 9 == 8, "").when(F.col("o_orderkey") % 9 == 7, "no date here")
    for k, (pattern, _) in _RENDERED.items():
        raw = raw.when(F.col("o_orderkey") % 6 == k, F.date_format("o_orderdate", pattern))
    return orders.select("o_orderkey", dates.normal_date(raw, AS_OF).alias("published_date"))


PARTS = [("2024", "Nov", None), ("2024", "Winter", "3"), ("", "1", "1"), (None, "Jan", "2"), ("2020", "7", "x"), ("2019", None, None), ("2021", "DEC", "31"), ("1999", "012", "100")]


@query("SELECT doc_id, CASE WHEN coalesce(y, '') = '' THEN '' ELSE y || '-' || CASE WHEN lower(coalesce(m, '01')) IN ('jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec') "
       "THEN lpad(CAST((position(lower(m) IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3 AS VARCHAR), 2, '0') WHEN regexp_full_match(coalesce(m, '01'), '\\d+') THEN "
       "lpad(coalesce(m, '01'), CAST(greatest(2, length(coalesce(m, '01'))) AS INTEGER), '0') ELSE '01' END || '-' || CASE WHEN regexp_full_match(coalesce(d, '01'), '\\d+') THEN "
       f"lpad(coalesce(d, '01'), CAST(greatest(2, length(coalesce(d, '01'))) AS INTEGER), '0') ELSE '01' END END AS published_date FROM documents JOIN {sql_values([(i, *p) for i, p in enumerate(PARTS)], 'id, y, m, d')} ON id = doc_id % {len(PARTS)}")
def pubmed_date(spark, sf_dir):
    rows = _dealt(spark, sf_dir, PARTS, "y m d")
    return rows.select("doc_id", dates.article_date(F.col("y"), F.col("m"), F.col("d")).alias("published_date"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '2024' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published_date FROM orders")
def video_date(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "2024").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.video_date(raw).alias("published_date"))


# Records derived from documents.

_NAMES = ["Yossi Matias", "", "Mayo Clinic", "Google", "maya", "staff", "Ann Lee, Bo Li, Cy Ray", "TEDx Talks", "unknown"]
_SITES = ["https://blog.google/a/", "https://www.youtube.com/watch?v=abcdefghij", "https://pubmed.ncbi.nlm.nih.gov/3980", "https://x.co.uk/p/", "https://a.medium.com/", "https://example.org/", "https://mit.edu/"]
_ABOUT = ["", "Healthcare notes for patient care. Not medical advice.", "Data pipelines and search engines, see https://a.example/b for more of the same and then some.",
          "Clinical trials in oncology: background: methods: results: a short account that goes on for well over fifty characters.", "Quietly done."]


def _pick(options: list[str], key: str) -> str:
    """One of ``options`` by key, in SQL that both engines read."""
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {O.text(x)}" for i, x in enumerate(options)) + " END"


_FIELDS = {
    "source_type": "CASE doc_id % 3 WHEN 0 THEN 'blog' WHEN 1 THEN 'youtube' ELSE 'pubmed' END",
    "url": f"concat({_pick(_SITES, 'doc_id')}, CAST(doc_id AS STRING))",
    "title": "CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('Report ', CAST(doc_id AS STRING)) END",
    "author": _pick(_NAMES, "doc_id"),
    "description": _pick(_ABOUT, "doc_id"),
}


def raw_records(docs: DataFrame) -> DataFrame:
    """documents as raw source records, by rules on doc_id."""
    day = F.expr("date_add(DATE'2015-01-01', CAST(doc_id * 37 % 4200 AS INT))")
    return docs.select(
        "doc_id", *[F.expr(e).alias(c) for c, e in _FIELDS.items()],
        F.when(F.expr(f"{_FIELDS['author']} LIKE '%, %'"), F.split(F.expr(_FIELDS["author"]), ", ")).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("published_date"), F.split("text", "\n").alias("raw_text_sections"))


def _analysed(spark, sf_dir):
    """For what language does not bear on: keyword tags, and nothing that leaves the JVM."""
    return records.analysed(raw_records(table(spark, sf_dir, "documents")), AS_OF, tolerant_dates=False, **records.keyword_only())


def _chunked(spark, sf_dir):
    rows = records.normalised(raw_records(table(spark, sf_dir, "documents")), AS_OF, tolerant_dates=False)
    return rows.select("doc_id", folds.content_chunks(F.col("cleaned_sections"), F.col("source_type")).alias("content_chunks"))


_RAW = f"""r AS (SELECT doc_id, {', '.join(f"{e} AS {c}" for c, e in _FIELDS.items()).replace('AS STRING', 'AS VARCHAR')},
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE DATE '2015-01-01' + CAST(doc_id * 37 % 4200 AS INTEGER) END AS day, {O.cleaned('string_split(text, chr(10))')} AS sections FROM documents),
n AS (SELECT *, coalesce(nullif(title, ''), 'unknown') AS t, coalesce(nullif(author, ''), 'unknown') AS a, coalesce(CAST(day AS VARCHAR), 'unknown') AS published_date,
  CASE WHEN author LIKE '%, %' THEN string_split(author, ', ') ELSE [] END AS authors FROM r),
e AS (SELECT *, {O.region('url')} AS region, list_slice({O.tags("lower(trim(concat_ws(' ', t, nullif(description, ''), CASE WHEN len(sections) > 0 THEN array_to_string(list_slice(sections, 1, 3), ' ') END)))")}, 1, 5) AS topic_tags FROM n),
s AS (SELECT *, {O.author('a', 'authors', 'source_type')} AS author_credibility, {O.content('sections', 'description', 't', 'source_type')} AS content_quality,
  {O.domain('url', 'source_type')} AS domain_authority, {O.recency('published_date', 'day', 'source_type', AS_OF)} AS recency_score,
  {O.disclaimer('topic_tags', 'sections', 'description', 'source_type')} AS medical_disclaimer_score FROM e),
f AS (SELECT *, {O.trust('source_type', 'author_credibility', 'content_quality', 'domain_authority', 'recency_score', 'medical_disclaimer_score')} AS trust_score FROM s)"""


@query(f"WITH {_RAW} SELECT doc_id, source_type, trust_score, author_credibility, content_quality, domain_authority, recency_score, medical_disclaimer_score FROM f")
def trust_score(spark, sf_dir):
    return _analysed(spark, sf_dir).select("doc_id", "source_type", "trust_score", *records.SIGNALS)


def _signal(name: str):
    def run(spark, sf_dir):
        return _analysed(spark, sf_dir).select("doc_id", name)

    run.__name__ = {"recency_score": "recency", "medical_disclaimer_score": "disclaimer"}.get(name, name)
    return query(f"WITH {_RAW} SELECT doc_id, {name} FROM f")(run)


content_quality, recency, disclaimer = map(_signal, ("content_quality", "recency_score", "medical_disclaimer_score"))


_LANGUAGE_TEXT = "trim(concat_ws(' ', CASE WHEN len(sections) > 0 THEN array_to_string(list_slice(sections, 1, 5), ' ') END, nullif(description, ''), CASE WHEN t <> 'unknown' THEN t END))"
_ODDS = languages.SHARES / languages.UNSEEN
_LANGUAGE = O.language_by_profiles("n", "doc_id", _LANGUAGE_TEXT, languages.LEAST_SHARE, _ODDS)


def _judges(spark, sf_dir) -> records.Models:
    """A judge of languages, by profiles of the labelled documents."""
    profiles = languages.trained(table(spark, sf_dir, "documents"))
    return records.Models(detect=languages.judge(kept(profiles, f"{shared_folder(spark, 'queries')}/languages")))


@query(f"WITH {_RAW}, l AS {_LANGUAGE}, c AS (SELECT *, {O.chunks('sections', 'source_type')} AS chunks FROM f JOIN l USING (doc_id)) SELECT doc_id, url AS source_url, source_type, a AS author, published_date, language, region, "
       "array_to_string(topic_tags, '|') AS topic_tags, trust_score, array_to_string(chunks, chr(10)) AS content_chunks, t AS title, description, "
       "round(author_credibility, 3) AS author_credibility, round(content_quality, 3) AS content_quality, round(domain_authority, 3) AS domain_authority, "
       "round(recency_score, 3) AS recency_score, round(medical_disclaimer_score, 3) AS medical_disclaimer_score FROM c")
def trust_detailed(spark, sf_dir):
    """Whole records, with the language detected by profiles; of the tags the keyword ones, as SQL has no encoder."""
    raw = raw_records(table(spark, sf_dir, "documents"))
    rows = records.detailed(records.analysed(raw, AS_OF, tolerant_dates=False, models=_judges(spark, sf_dir), **records.keyword_tags_only()), ("doc_id",))
    flat = {"topic_tags": F.array_join("topic_tags", "|"), "content_chunks": F.array_join("content_chunks", "\n")}
    return rows.select("doc_id", *[flat.get(c, F.col(c)).alias(c) for c in rows.columns if c not in ("doc_id", "trust_signals")], "trust_signals.*")


@query(f"WITH {_RAW}, l AS {_LANGUAGE}, x AS (SELECT * FROM f JOIN l USING (doc_id)), m AS (SELECT language, source_type, avg(trust_score) AS mean_trust, count(*) AS n FROM x GROUP BY language, source_type) "
       "SELECT doc_id, x.language, x.source_type, trust_score, n, array_to_string(topic_tags, '|') AS topic_tags FROM x JOIN m ON x.language = m.language AND x.source_type = m.source_type "
       "WHERE x.language IN ('en', 'de') AND trust_score >= mean_trust AND len(topic_tags) > 0 AND content_quality > 0.2")
def trust_above_mean(spark, sf_dir):
    """Records of two languages that have a topic and score no less than the mean of their language and type: results filtered, grouped and joined by what is worked out."""
    raw = raw_records(table(spark, sf_dir, "documents"))
    rows = records.detailed(records.analysed(raw, AS_OF, tolerant_dates=False, models=_judges(spark, sf_dir), **records.keyword_tags_only()), ("doc_id",))
    means = rows.groupBy("language", "source_type").agg(F.avg("trust_score").alias("mean_trust"), F.count("*").alias("n"))
    best = rows.join(means, ["language", "source_type"]).filter(
        F.col("language").isin("en", "de") & (F.col("trust_score") >= F.col("mean_trust")) & (F.size("topic_tags") > 0) & (F.col("trust_signals.content_quality") > 0.2))
    return best.select("doc_id", "language", "source_type", "trust_score", "n", F.array_join("topic_tags", "|").alias("topic_tags"))


@query(f"WITH {_RAW}, c AS (SELECT doc_id, {O.chunks('sections', 'source_type')} AS chunks FROM f) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, chunks[i] AS chunk FROM "
       "(SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM c)")
def chunk_all(spark, sf_dir):
    # Outer: from a plain one a filter on the chunks is inferred, which would work them out twice.
    rows = _chunked(spark, sf_dir).select("doc_id", F.posexplode_outer("content_chunks").alias("pos", "chunk"))
    return rows.filter(F.col("pos").isNotNull())


# Topics and vectors.


@query(f"WITH {_RAW} SELECT doc_id, array_to_string({O.tags("lower(description || ' ' || array_to_string(sections, ' '))")}, '|') AS tags FROM r")
def topic_keyword(spark, sf_dir):
    rows = records.normalised(raw_records(table(spark, sf_dir, "documents")), AS_OF, tolerant_dates=False)
    return rows.select("doc_id", F.array_join(topics.phrase_tags(F.concat_ws(" ", F.col("description"), F.array_join("cleaned_sections", " "))), "|").alias("tags"))


@query(f"WITH {_RAW}, m AS (SELECT doc_id, topic_tags AS k, CASE doc_id % 3 WHEN 0 THEN ['finance', 'healthcare'] WHEN 1 THEN ['robotics'] ELSE CAST([] AS VARCHAR[]) END AS s FROM e) "
       "SELECT doc_id, array_to_string(list_slice(list_concat(s, list_filter(k, lambda x: NOT list_contains(s, x))), 1, 5), '|') AS tags FROM m")
def topic_merge(spark, sf_dir):
    rows = records.enriched(records.normalised(raw_records(table(spark, sf_dir, "documents")), AS_OF, tolerant_dates=False), **records.keyword_only())
    semantic = F.expr("CASE doc_id % 3 WHEN 0 THEN array('finance', 'healthcare') WHEN 1 THEN array('robotics') ELSE CAST(array() AS ARRAY<STRING>) END")
    return rows.select("doc_id", F.array_join(topics.merged_tags(semantic, F.col("topic_tags")), "|").alias("tags"))


def _centroids(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    mean = each.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("centroid"))


_COSINE = """WITH c AS (SELECT label, list(x ORDER BY k) AS centroid FROM (SELECT label, k, avg(CAST(x AS DOUBLE)) AS x FROM
  (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY label, k) GROUP BY label),
s AS (SELECT vec_id, c.label AS topic, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS sim FROM embeddings, c)"""


def _with_topics(spark, sf_dir):
    """Each vector with all label centroids, as one value: a row of as many entries as there are labels."""
    centroids = _centroids(spark, sf_dir)
    every = centroids.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("topics"), F.count("*").alias("n"))
    if centroids.count() * 8 * 1024 <= 48 << 20:  # of up to 1024 numbers
        every = F.broadcast(every)
    return table(spark, sf_dir, "embeddings").crossJoin(every.drop("n")).select("vec_id", "embedding", "topics")


@query(_COSINE + " SELECT vec_id, topic, round(sim, 6) AS sim FROM s")
def vector_cosine(spark, sf_dir):
    each = _with_topics(spark, sf_dir).select("vec_id", "embedding", F.explode("topics").alias("t"))
    return each.select("vec_id", F.col("t.label").alias("topic"), F.round(topics.cosine(F.col("embedding"), F.col("t.centroid")), 6).alias("sim"))


@query(_COSINE + " SELECT vec_id, topic, rank FROM (SELECT vec_id, topic, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic DESC) AS INTEGER) AS rank FROM s WHERE sim >= 0.05) WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    """The best labels of each vector, found within its row."""
    sims = F.transform("topics", lambda t: topics.cosine(F.col("embedding"), t["centroid"]))
    best = _with_topics(spark, sf_dir).select("vec_id", "topics", F.posexplode(topics.top_k(sims, 5, 0.05)).alias("rank", "at"))
    return best.select("vec_id", F.get("topics", F.col("at"))["label"].alias("topic"), (F.col("rank") + 1).alias("rank"))


# Summaries.


@query(f"WITH {_RAW} SELECT count(*) AS processed, count_if(source_type = 'blog') AS blog, count_if(source_type = 'youtube') AS youtube, count_if(source_type = 'pubmed') AS pubmed, "
       "round(avg(trust_score), 6) AS mean_trust FROM f")
def summary_trust(spark, sf_dir):
    return records.summary(_analysed(spark, sf_dir)).withColumn("mean_trust", F.round("mean_trust", 6))


@query(f"SELECT count(*) AS total_urls, count_if(ok) AS processed, count_if(NOT ok) AS failed FROM (SELECT regexp_matches(url, '^(?i:https?)://[^/?#]+') AS ok FROM {_URLS})")
def summary_counts(spark, sf_dir):
    ok = urls.is_valid(F.col("url"))
    return _urls(spark, sf_dir).agg(F.count("*").alias("total_urls"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"))


@query(f"WITH {_RAW}, c AS (SELECT doc_id, {O.chunks('sections', 'source_type')} AS chunks FROM f) SELECT doc_id, len(chunks) AS n_chunks, "
       "coalesce(list_sum(list_transform(chunks, lambda x: len(regexp_split_to_array(x, '[\\s\\x0b]+')))), 0) AS n_words FROM c")
def word_counts(spark, sf_dir):
    rows = _chunked(spark, sf_dir)
    return rows.select("doc_id", F.size("content_chunks").cast("long").alias("n_chunks"), records.chunk_words(F.col("content_chunks")).cast("long").alias("n_words"))


@query(f"WITH {_RAW} SELECT doc_id, CASE WHEN trust_score >= 0.7 THEN 'green' WHEN trust_score >= 0.4 THEN 'amber' ELSE 'rose' END AS band, CAST(floor(trust_score * 100 + 0.5) AS INTEGER) AS percent, "
       "round(157 - 157 * trust_score, 6) AS ring_offset FROM f")
def trust_band(spark, sf_dir):
    rows = _analysed(spark, sf_dir).select("doc_id", scores.trust_band(F.col("trust_score")).alias("b"))
    return rows.select("doc_id", "b.band", "b.percent", F.round("b.ring_offset", 6).alias("ring_offset"))


# Language.

@query(f"WITH {_RAW} SELECT doc_id, {_LANGUAGE_TEXT} AS language_text FROM n")
def language_text(spark, sf_dir):
    return records.normalised(raw_records(table(spark, sf_dir, "documents")), AS_OF, tolerant_dates=False).select("doc_id", records.language_text().alias("language_text"))


def _starts_sql(x: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(lower({x}), '{O.WS}+'), lambda w: w <> ''), lambda w: substring(w, 1, 3))"


@query(f"""WITH k AS (SELECT lang, start, count(*) AS n FROM (SELECT lang, unnest({_starts_sql('text')}) AS start FROM documents WHERE lang IS NOT NULL) GROUP BY ALL),
t AS (SELECT lang, sum(n) AS total FROM k GROUP BY lang),
p AS (SELECT lang, start, ln((n + 1) / (total + 1)) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, start) AS r FROM k) JOIN t USING (lang) WHERE r <= {languages.PROFILE}),
s AS (SELECT doc_id, start, count(*) AS n FROM (SELECT doc_id, unnest({_starts_sql('text')}) AS start FROM documents WHERE length(text) >= {R.LANGUAGE_MIN_CHARS}) GROUP BY ALL),
g AS (SELECT doc_id, lang, round(sum(n * (weight - ln(1e-5))), 6) AS gain FROM s JOIN p USING (start) GROUP BY ALL),
b AS (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gain DESC, lang DESC) AS r FROM g) WHERE r = 1)
SELECT doc_id, coalesce(b.lang, 'unknown') AS language FROM documents d LEFT JOIN b USING (doc_id)""")
def language_detect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages.detected(docs, "doc_id", "text", languages.profile(docs, "text", "lang"))


@query(f"SELECT doc_id, language FROM {O.language_by_profiles('documents', 'doc_id', 'text', languages.LEAST_SHARE, _ODDS)}")
def language_profiles(spark, sf_dir):
    """The language of every document by runs of letters, learned from the labelled ones."""
    judges = _judges(spark, sf_dir).detect
    return table(spark, sf_dir, "documents").select("doc_id", languages.judged_language(F.col("text"), judges).alias("language"))


@query("SELECT doc_id, word_language, text_language FROM (SELECT doc_id, language AS text_language FROM "
       f"{O.language_by_profiles('documents', 'doc_id', 'text', languages.LEAST_SHARE, _ODDS)}) JOIN (SELECT doc_id, language AS word_language FROM {O.language('documents', 'doc_id', 'text', languages.word_gains())}) USING (doc_id)")
def language_compared(spark, sf_dir):
    """Learned profiles beside the frequent words that stand in for them where there are no labelled texts."""
    judges = _judges(spark, sf_dir).detect
    return table(spark, sf_dir, "documents").select("doc_id", languages.detected_in(F.col("text")).alias("word_language"), languages.judged_language(F.col("text"), judges).alias("text_language"))


_PAIRS = dict(words=400, contexts=100, window=3)


@query(f"""WITH t AS (SELECT doc_id, {O.plain_words('text')} AS t FROM documents),
w AS (SELECT doc_id, unnest(string_split(t, ' ')) AS word, unnest(range(len(string_split(t, ' ')))) AS i FROM t WHERE t <> ''),
v AS (SELECT word, k FROM (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS k FROM w GROUP BY word) WHERE k < {_PAIRS['words']}),
p AS (SELECT doc_id, i, word, k FROM w JOIN v USING (word)),
n AS (SELECT a.word AS word, b.word AS context, count(*) AS n FROM p a JOIN (SELECT * FROM p WHERE k < {_PAIRS['contexts']}) b ON a.doc_id = b.doc_id AND a.i <> b.i AND abs(a.i - b.i) <= {_PAIRS['window']} GROUP BY ALL)
SELECT word, context, n, round(x, 6) AS ppmi FROM (SELECT word, context, n, ln(n * sum(n) OVER () / (CAST(sum(n) OVER (PARTITION BY word) AS DOUBLE) * sum(n) OVER (PARTITION BY context))) AS x FROM n) WHERE x > 0""")
def word_pairs(spark, sf_dir):
    """How often frequent words stand near each other, and how much more than by chance: what word vectors are factored from."""
    docs = table(spark, sf_dir, "documents")
    known = [r["word"] for r in embedding.vocabulary(docs, words=_PAIRS["words"]).collect()]
    pairs = kept(embedding.cooccurrences(docs, {w: k for k, w in enumerate(known)}, contexts=_PAIRS["contexts"], window=_PAIRS["window"]), f"{shared_folder(spark, 'queries')}/pairs")
    names = spark.createDataFrame(list(enumerate(known)), "k long, name string")
    rows = embedding.informative(pairs).join(F.broadcast(names), F.col("w") == F.col("k")).select(F.col("name").alias("word"), "c", "n", "ppmi")
    rows = rows.join(F.broadcast(names), F.col("c") == F.col("k"))  # as many names as words are asked for
    return rows.select("word", F.col("name").alias("context"), "n", F.round("ppmi", 6).alias("ppmi"))


# Pages, sinks, stream.


def _page_rows(spark, pages: DataFrame, key: str, glue: str = "") -> DataFrame:
    rows = with_page_fields(pages.select(key, "url", "html"), AS_OF, glue)
    return rows.withColumn("paragraphs", F.array_join("raw_text_sections", "\n")).withColumn("n", F.size("raw_text_sections")).drop("raw_text_sections", "authors")


def _plain(x: str) -> str:
    """Text of an element without markup or references, as far as the test pages have any."""
    return f"""trim(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13))"""


@query(f"""WITH a AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
p AS (SELECT page_id, url, t, list_filter(list_transform(string_split(body, '<p>')[2:], lambda q: {_plain("split_part(q, '</p>', 1)")}), lambda q: NOT {O.noise('q')}) AS ps FROM a)
SELECT page_id, url, {_plain('t')} AS title, '' AS author, '' AS published_date, '' AS description, array_to_string(ps, chr(10)) AS paragraphs, CAST(len(ps) AS INTEGER) AS n FROM p""")
def html_fields(spark, sf_dir):
    """Title, author, date, description and paragraphs of every page."""
    return _page_rows(spark, table(spark, sf_dir, "pages"), "page_id")


@query(f"""WITH a AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
p AS (SELECT page_id, t, list_filter(list_transform(string_split(body, '<p>')[2:], lambda q: {_plain("split_part(q, '</p>', 1)")}), lambda q: q <> '') AS ps FROM a)
SELECT page_id, CASE WHEN list_max(list_transform(ps, lambda q: length(q))) >= 25 THEN {_plain('t')} END AS title,
  CASE WHEN list_max(list_transform(ps, lambda q: length(q))) >= 25 THEN array_to_string(list_filter(ps, lambda q: NOT {O.noise('q')}), chr(10)) END AS sections FROM p""")
def parsed_pages(spark, sf_dir):
    """The primary article extractor over every page; null where a page has no content."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return parsed_articles(pages, AS_OF).select(F.col("url").cast("long").alias("page_id"), "title", F.array_join("raw_text_sections", "\n").alias("sections"))


# Pages, articles and videos around the words of documents, so that SQL can say what is to be found in them.

_WORDS = "trim(concat('Words ', regexp_replace(substr(text, 1, 160), '[^A-Za-z]+', ' '{})))"
_SAID = f"d AS (SELECT doc_id, {_WORDS.format(", 'g'")} AS s FROM documents)"


def _said(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_WORDS.format("")).alias("s"))


_PAGES = [
    '<html><head><title>Other</title><meta property="og:title" content=" {s} "><meta name="author" content="Ann {i}"><meta property="article:published_time" content="2024-05-06T07:08:09Z">'
    '<meta property="og:description" content="About {s}"></head><body><nav><p>Subscribe to our newsletter today</p></nav><article><p>First {s} &amp; more of it</p><p>Second <b>{s}</b> that goes on<p>short</p></article></body></html>',
    '<html><head><script type="application/ld+json">{{"author": [{{"name": "In Data {i}"}}, "x"]}}</script><meta name="description" content="{s}"></head><body><h1>Head <i>{s}</i></h1>'
    '<time datetime="2021-02-03">x</time><div role="main"><p>{s} in main</p><p>Leave a reply to {s}</p></div><p>outside the box of text</p></body></html>',
    '<title>Plain {i}</title><p class="post ByLine">By Someone</p><meta name="pubdate" content="3 May 2020"><div class="entry-content"><p>{s} &lt;tag&gt; &copy; 2</p></div>',
]


def _filled(shape: str) -> str:
    """SQL, for both engines, of a text with {s} and {i} filled in."""
    parts = shape.replace("{{", "\0").replace("}}", "\1").replace("{s}", "\2s\2").replace("{i}", "\2CAST(doc_id AS STRING)\2").replace("\0", "{").replace("\1", "}").split("\2")
    return "concat(" + ", ".join(O.text(x) if k % 2 == 0 else x for k, x in enumerate(parts)) + ")"


def _page_fields_sql(glue: str) -> str:
    return f"""WITH {_SAID}, f AS (SELECT doc_id, s, doc_id % 4 AS k FROM d),
p AS (SELECT *, list_filter(CASE k WHEN 0 THEN ['First ' || s || ' & more of it', 'Second{glue}' || s || '{glue}that goes on', 'short'] WHEN 1 THEN [s || ' in main', 'Leave a reply to ' || s] WHEN 2 THEN [s || ' <tag> © 2'] ELSE [] END,
  lambda q: NOT {O.noise('q')}) AS ps FROM f)
SELECT doc_id, concat('https://x.org/', doc_id) AS url, CASE k WHEN 0 THEN s WHEN 1 THEN 'Head{glue}' || s WHEN 2 THEN 'Plain ' || doc_id ELSE '' END AS title,
  CASE k WHEN 0 THEN 'Ann ' || doc_id WHEN 1 THEN 'In Data ' || doc_id WHEN 2 THEN 'By Someone' ELSE '' END AS author, CASE k WHEN 0 THEN '2024-05-06' WHEN 1 THEN '2021-02-03' WHEN 2 THEN '2020-05-03' ELSE '' END AS published_date,
  CASE k WHEN 0 THEN 'About ' || s WHEN 1 THEN s ELSE '' END AS description, array_to_string(ps, chr(10)) AS paragraphs, CAST(len(ps) AS INTEGER) AS n FROM p"""


def _filled_pages(spark, sf_dir) -> DataFrame:
    html = "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {_filled(x)}" for k, x in enumerate(_PAGES)) + " END"
    return _said(spark, sf_dir).select("doc_id", F.expr("concat('https://x.org/', doc_id)").alias("url"), F.expr(html).alias("html"))


@query(_page_fields_sql(""))
def page_fields(spark, sf_dir):
    """Each source of each field: social and plain titles, headings, linked data, bylines, dates of three kinds, four kinds of body, no page at all."""
    return _page_rows(spark, _filled_pages(spark, sf_dir), "doc_id")


@query(_page_fields_sql(" "))
def page_fields_spaced(spark, sf_dir):
    """The same with a blank between the text nodes of an element."""
    return _page_rows(spark, _filled_pages(spark, sf_dir), "doc_id", " ")


_XML = ('<PubmedArticleSet><PubmedArticle><MedlineCitation><Article><ArticleTitle> {s} </ArticleTitle><AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author>'
        '<Author><LastName>Li{i}</LastName><Initials>B</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList><Journal><Title>Journal {i}</Title><JournalIssue><PubDate>'
        '<Year>2019</Year><Month>Nov</Month></PubDate></JournalIssue></Journal><Abstract><AbstractText Label="BACKGROUND">{s} <i>in</i> the tail</AbstractText><AbstractText> {s} </AbstractText></Abstract>'
        '</Article></MedlineCitation></PubmedArticle></PubmedArticleSet>')


@query(f"""WITH {_SAID}, x AS (SELECT doc_id, s, doc_id % 5 < 4 AS ok FROM d)
SELECT doc_id, CASE WHEN ok THEN s END AS title, CASE WHEN ok THEN 'Ann Lee, B Li' || doc_id END AS author, CASE WHEN ok THEN 'Journal ' || doc_id END AS journal, CASE WHEN ok THEN '2019-11-01' END AS published_date,
  CASE WHEN ok THEN 'BACKGROUND: ' || s || ' in the tail ' || s END AS description, CASE WHEN ok THEN 'BACKGROUND: ' || s || ' ' || s END AS first_text FROM x""")
def article_xml(spark, sf_dir):
    """Articles as XML, read with all text of an abstract part and with what stands before its first nested element; every fifth is broken."""
    xml = _said(spark, sf_dir).select("doc_id", F.expr(f"CASE WHEN doc_id % 5 < 4 THEN {_filled(_XML)} ELSE '<PubmedArticleSet>' END").alias("xml"))
    first = with_article_fields(xml, whole_text=False).select("doc_id", F.col("description").alias("first_text"))
    return with_article_fields(xml).select("doc_id", "title", "author", "journal", "published_date", "description").join(first, "doc_id")


_ARTICLE_PAGE = ('<h1 class="heading-title"> {s} </h1><div class="authors-list"><a class="full-name">Ann Lee</a><a class="full-name">Bo {i}</a></div><div class="journal-actions"><button class="journal-title">J. {i}</button></div>'
                 '<span class="cit">2018 Mar;5(2)</span><div id="eng-abstract"><p>{s} first</p><p> </p><p><b>Aim:</b> {s}</p></div>')


@query(f"WITH {_SAID} SELECT doc_id, s AS title, 'Ann Lee, Bo ' || doc_id AS author, 'J. ' || doc_id AS journal, '2018' AS published_date, s || ' first Aim:' || s AS description, 2 AS n FROM d")
def article_page(spark, sf_dir):
    pages = _said(spark, sf_dir).select("doc_id", F.expr(_filled(_ARTICLE_PAGE)).alias("html"))
    return with_article_page_fields(pages).select("doc_id", "title", "author", "journal", "published_date", "description", F.size("raw_text_sections").alias("n"))


@query(f"""WITH {_SAID}, l AS (SELECT doc_id, s, list_filter(['Line ' || s, 'shorter', s || ' end'], lambda q: length(q) > {R.DESCRIPTION_LINE_CHARS}) AS said FROM d)
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN s ELSE '' END AS title, CASE doc_id % 3 WHEN 0 THEN 'Channel ' || doc_id WHEN 1 THEN 'Uploader' ELSE '' END AS author, CASE WHEN doc_id % 3 < 2 THEN '2024-09-25' ELSE '' END AS published_date,
  CASE WHEN doc_id % 6 = 0 THEN 'spoken ' || s WHEN doc_id % 3 < 2 THEN array_to_string(said, chr(10)) ELSE '' END AS sections FROM l""")
def video_fields(spark, sf_dir):
    """Metadata with a channel, with an uploader only or missing; content from the transcript or else from the description."""
    said = _said(spark, sf_dir).withColumn("video_id", F.expr("concat('v', doc_id)"))
    metadata = said.filter("doc_id % 3 < 2").select(
        F.col("video_id").alias("id"), F.col("s").alias("title"), F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('Channel ', doc_id) ELSE '' END").alias("channel"), F.lit("Uploader").alias("uploader"),
        F.lit("20240925").alias("upload_date"), F.expr("concat('Line ', s, '\n shorter \n', s, ' end')").alias("description"))
    segments = said.filter("doc_id % 6 = 0").select("video_id", F.lit(1).alias("pos"), F.expr("concat('spoken ', s)").alias("text"))
    rows = video_records(said.select("doc_id", "video_id"), metadata, transcripts(segments, "video_id", "pos", "text"))
    return rows.select("doc_id", "title", "author", "published_date", F.array_join("raw_text_sections", "\n").alias("sections"))


@query()
def page_trust(spark, sf_dir):
    """Pages from HTML to trust score, with the language by profiles of the documents; semantic tags by hashing (by vectors: topic_semantic)."""
    raw = with_page_fields(table(spark, sf_dir, "pages").select("page_id", "url", "html"), AS_OF).withColumn("source_type", urls.source_type(F.col("url")))
    rows = records.detailed(records.analysed(raw, AS_OF, models=_judges(spark, sf_dir)), ("page_id",))
    return rows.select("page_id", "source_url", "title", "language", F.array_join("topic_tags", "|").alias("topic_tags"), "trust_score", F.size("content_chunks").alias("n_chunks"))


@query()
def topic_semantic(spark, sf_dir):
    """Nearest topic descriptions by word vectors of the documents, merged with the keyword tags."""
    docs = table(spark, sf_dir, "documents").select("text").unionByName(values(spark, [(about,) for _, about in R.TOPICS] * 3, "text string"))
    encode = embedding.encoder(embedding.fit(docs, words=3_000, contexts=400, dims=48))
    rows = records.normalised(raw_records(table(spark, sf_dir, "documents")), AS_OF, tolerant_dates=False).select("doc_id", records.topic_text().alias("text"))
    both = topics.merged_tags(topics.semantic_tags(F.col("text"), encode), topics.keyword_tags(F.col("text")))
    return rows.select("doc_id", F.array_join(both, "|").alias("tags"))


@query()
def topic_keyphrases(spark, sf_dir):
    """Keyphrases of the text that topics are looked for in, and the tags found with them."""
    rows = records.normalised(raw_records(table(spark, sf_dir, "documents")), AS_OF, tolerant_dates=False).select("doc_id", records.topic_text().alias("text"))
    return rows.select("doc_id", F.array_join(keywords.with_keyphrases(F.col("text")), "|").alias("phrases"), F.array_join(keywords.tags_with_keyphrases(F.col("text")), "|").alias("tags"))


@query(f"WITH {_RAW} SELECT url AS source_url, source_type, trust_score FROM f")
def export_roundtrip(spark, sf_dir):
    path = shared_folder(spark, "queries")
    writers.write_combined(records.detailed(_analysed(spark, sf_dir)), f"{path}/combined")
    return readers.results(spark, f"{path}/combined").select("source_url", "source_type", "trust_score")


@query(f"WITH {_RAW} SELECT CAST(row_number() OVER (ORDER BY trust_score DESC, doc_id) - 1 AS BIGINT) AS pos, url AS source_url, trust_score, t AS title FROM f")
def export_ordered(spark, sf_dir):
    """All records in one JSON array, best first, read back with their places in it."""
    path = f"{shared_folder(spark, 'queries')}/all.json"
    rows = _analysed(spark, sf_dir).withColumn("pos", F.struct((-F.col("trust_score")).alias("s"), F.col("doc_id").alias("i")))
    writers.export_array(rows.select("pos", "source_url", "trust_score", "title"), path)
    back = spark.read.option("multiLine", True).schema("source_url string, trust_score double, title string").json(path)  # one file, so one task, in order
    return back.select(F.monotonically_increasing_id().alias("pos"), "*")


@query(f"WITH {_RAW} SELECT source_type, count(*) AS n FROM f GROUP BY source_type")
def dynamic_overwrite(spark, sf_dir):
    """All types are written, then blogs again: the folders of the others stay."""
    path, rows = shared_folder(spark, "queries"), records.exported(_analysed(spark, sf_dir))
    writers.write_by_type(rows, path)
    writers.write_by_type(rows.filter("source_type = 'blog'"), path)
    return spark.read.schema(readers.RESULT).json(path).groupBy("source_type").agg(F.count("*").alias("n"))


@query(f"WITH {_RAW} SELECT doc_id, trust_score FROM f")
def stream_append(spark, sf_dir):
    """The batch result by way of a stream of files."""
    path = shared_folder(spark, "queries")
    raw = raw_records(table(spark, sf_dir, "documents"))
    raw.repartition(4, "doc_id").write.parquet(f"{path}/in")
    append_analysed(stream_records(spark, f"{path}/in", raw.schema, 2), f"{path}/out", f"{path}/state", AS_OF, ("doc_id",), **records.keyword_only()).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "trust_score")
