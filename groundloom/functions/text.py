"""String functions as columns."""

from __future__ import annotations

import json
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is stripped at both ends of a name.
EDGES = string.punctuation + " "
WORD = r"(?U)\w+"


def squeeze(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize(x: Column) -> Column:
    """Lower case, white space collapsed, punctuation stripped at the ends, one leading article dropped."""
    low = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\s+", " ")
    return F.regexp_replace(F.btrim(low, F.lit(EDGES)), "^(a|an|the) ", "")


def contains_words(longer: Column, shorter: Column) -> Column:
    """Whether shorter stands in longer with no word character next to it. Both normalized; empty is in nothing."""
    # Few pairs of names get past the plain test, so few patterns are made.
    quoted = F.replace(shorter, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return (shorter != "") & F.contains(longer, shorter) & F.rlike(longer, F.concat(F.lit(r"(?U)(?<!\w)\Q"), quoted, F.lit(r"\E(?!\w)")))


def word_runs(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def is_true(x: Column) -> Column:
    """A flag given as a boolean, a number or a string."""
    low = F.lower(strip(x.cast("string")))
    return F.coalesce(low.isin("true", "yes") | (F.coalesce(low.try_cast("double"), F.lit(0.0)) != 0), F.lit(False))


def shown_value(x: Column) -> Column:
    """A scalar in a fact; null is unknown, not false."""
    return F.coalesce(x.cast("string"), F.lit("null (unknown)"))


def cache_key(x: Column, params: dict) -> Column:
    """SHA-256 of the extraction's parameters and a text."""
    return F.sha2(F.concat(F.lit(json.dumps(params, sort_keys=True)), F.char(F.lit(0)), F.coalesce(x, F.lit(""))), 256)
