"""Dates as text: native patterns first, a tolerant parser for what is left."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenary import rules as R

#: (shape, Spark pattern) that the tolerant parser reads alike, so most dates never leave the JVM.
_SHAPES = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$", None),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
]


def _native(raw: Column) -> Column:
    out = F.lit(None).cast("date")
    for shape, pattern in reversed(_SHAPES):
        parsed = F.to_date(F.try_to_timestamp(raw, F.lit(pattern))) if pattern else F.to_date(F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")))
        out = F.when(raw.rlike(shape), parsed).otherwise(out)
    return out


def _tolerant(as_of: str) -> Column:
    @F.pandas_udf("string")
    def parse(raw: pd.Series) -> pd.Series:
        from datetime import datetime

        from dateutil.parser import parse as read

        filled = datetime.fromisoformat(as_of)

        def one(x: str | None) -> str | None:
            try:
                return read(x, fuzzy=True, default=filled).strftime("%Y-%m-%d") if x else None
            except (ValueError, OverflowError, TypeError):
                return None

        return raw.map(one)

    return parse


def parse_date(raw: Column, as_of: str, tolerant: bool = True) -> Column:
    """The date that ``raw`` names, or null; parts that it leaves out come from ``as_of``. Without ``tolerant`` only the
    native shapes are read, and no row crosses to Python."""
    native = _native(raw)
    if not tolerant:
        return native
    rest = F.when(native.isNull(), raw)  # null for the rest, so the parser is not called on it
    return F.coalesce(native, F.to_date(F.try_to_timestamp(_tolerant(as_of)(rest), F.lit("yyyy-MM-dd"))))


def normal_date(raw: Column, as_of: str, tolerant: bool = True) -> Column:
    """ISO text; unknown where missing, the text itself where it names no date."""
    gone = F.coalesce(raw, F.lit("")).isin("", R.UNKNOWN)
    return F.when(gone, R.UNKNOWN).otherwise(F.coalesce(F.date_format(parse_date(raw, as_of, tolerant), "yyyy-MM-dd"), raw))


def page_date(raw: Column, as_of: str) -> Column:
    """As ``normal_date`` for a page's own date: empty where missing, ten characters where it names no date."""
    raw = F.coalesce(raw, F.lit(""))
    return F.when(raw == "", "").otherwise(F.coalesce(F.date_format(parse_date(raw, as_of), "yyyy-MM-dd"), F.left(raw, F.lit(10))))


def video_date(raw: Column) -> Column:
    """YYYYMMDD as ISO text, anything not of eight characters as it is."""
    return F.when(F.length(raw) == 8, F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))).otherwise(raw)


_MONTHS = {name: f"{k:02d}" for k, name in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def _two_digits(x: Column) -> Column:
    return F.lpad(x, F.greatest(F.length(x), F.lit(2)), F.lit("0"))


def article_date(year: Column, month: Column, day: Column) -> Column:
    """ISO text of parts: a month by its English short name or digits, else 01; a day that is no number 01; no year, none."""
    year, month, day = F.coalesce(year, F.lit("")), F.coalesce(month, F.lit("01")), F.coalesce(day, F.lit("01"))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair]), F.lower(month))
    number = r"^\d+$"
    m = F.coalesce(named, F.when(month.rlike(number), _two_digits(month)), F.lit("01"))
    d = F.when(day.rlike(number), _two_digits(day)).otherwise("01")
    return F.when(year == "", "").otherwise(F.concat_ws("-", year, m, d))


def age_years(published: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), published) / F.lit(365.25)
