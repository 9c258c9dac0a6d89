"""URL checks, routing and ids as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenary import rules as R
from lumenary.functions.text import contains_any, present


def netloc(url: Column) -> Column:
    """The lower-cased authority, with any user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def is_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def source_type(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.when(low.rlike(R.VIDEO_URL), "youtube").when(low.rlike(R.ARTICLE_URL), "pubmed").otherwise("blog")


def _decoded(value: Column) -> Column:
    return F.try_url_decode(value)


def video_id(url: Column) -> Column:
    """The id of a video URL, or null: the query's v, a known path, the path of a short host, else any 11 id characters."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    standard = F.coalesce(
        _decoded(present(F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1))),
        present(F.regexp_extract(path, r"^(?:shorts|embed|v)/([^/]*)", 1)))
    loose = present(F.regexp_extract(url, r"(?:v=|/)([a-zA-Z0-9_-]{11})", 1))
    return (F.when(F.contains(host, F.lit("youtube.com")) & standard.isNotNull(), standard)
            .when(F.contains(host, F.lit("youtu.be")), present(path)).otherwise(loose))


def article_id(url: Column) -> Column:
    return present(F.regexp_extract(url, r"/(\d{6,10})/?", 1))


def ends_with_any(text: Column, ends: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(text, F.lit(e)) for e in ends])


def region(url: Column) -> Column:
    """US hosts, then global hosts, then the longest known suffix; unknown otherwise."""
    host = netloc(url)
    out = F.when(contains_any(host, R.US_HOSTS), "US").when(contains_any(host, R.GLOBAL_HOSTS), "global")
    for suffix in sorted(R.SUFFIX_REGIONS, key=len, reverse=True):
        out = out.when(F.endswith(host, F.lit(suffix)), R.SUFFIX_REGIONS[suffix])
    return out.otherwise(R.UNKNOWN)


def domain_authority(url: Column, kind: Column) -> Column:
    host = netloc(url)
    out = F.when(F.coalesce(url, F.lit("")) == "", R.DOMAIN_NO_URL)
    for score, names in R.DOMAIN_TIERS:
        out = out.when(contains_any(host, names), score)
        if score == 1.0:
            out = out.when(ends_with_any(host, R.TOP_SUFFIXES), score)
    for name, score in R.DOMAIN_DEFAULTS.items():
        out = out.when(kind == name, score)
    return out.otherwise(R.DOMAIN_OTHER)
