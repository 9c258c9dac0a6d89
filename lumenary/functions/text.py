"""Text cleaning and filtering as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenary import rules as R

#: White space as Unicode has it, with the separators U+001C-U+001F and U+0085.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
SENTENCE_END = rf"(?<=[.!?]){SPACE}+(?=[A-Z])"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))  # blanks are all the white space that is left


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once however often it is used: what stands under a higher-order function is
    interpreted, without a search for common parts."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def present(text: Column) -> Column:
    """Null for null and empty."""
    return F.nullif(text, F.lit(""))


def missing(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).isin("", R.UNKNOWN)


def clean_text(text: Column) -> Column:
    """Tags out, entities decoded once in a fixed order (the ampersand first), white space squeezed, controls out."""
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(squeeze(text), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of ``words`` stands in ``text``; each is a plain substring search."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def is_noise(section: Column) -> Column:
    return contains_any(F.lower(section), R.NOISE_PHRASES) | (F.length(section) < R.NOISE_MIN_CHARS)


def is_boilerplate(section: Column) -> Column:
    return section.rlike("(?iu)" + "|".join(R.BOILERPLATE)) | (F.length(strip(section)) < R.BOILERPLATE_MIN_CHARS)


#: Of each alternative of the boilerplate patterns a part that it cannot do without, in lower case.
BOILERPLATE_PARTS = [max(re.findall(r"[a-z ]+", one), key=len) for pattern in R.BOILERPLATE for one in pattern.strip("()").split("|")]


#: Letters beyond ASCII that match ASCII ones when case is ignored.
ODD_LETTERS = ["\u017f", "\u0130", "\u0131", "\u212a"]


def may_hold_boilerplate(text: Column) -> Column:
    """False only if no section of ``text`` can match a boilerplate pattern: plain searches."""
    return bound(text, lambda t: bound(F.lower(t), lambda low: contains_any(low, BOILERPLATE_PARTS)) | contains_any(t, ODD_LETTERS))


def without_noise(sections: Column) -> Column:
    return F.filter(sections, lambda s: ~is_noise(s))


def without_boilerplate(sections: Column) -> Column:
    return F.transform(F.filter(sections, lambda s: ~is_boilerplate(s)), strip)


def lines(text: Column, longer_than: int = 0) -> Column:
    """The stripped lines of a text with more than ``longer_than`` characters."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: F.length(s) > longer_than)


def sentences(text: Column) -> Column:
    """Pieces between sentence ends that an ASCII capital follows."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def word_count(text: Column) -> Column:
    parts = F.split(text, rf"{SPACE}+")
    return F.size(F.array_remove(parts, ""))
