"""Column functions on plain text: trimming, folding, splitting."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of line and text clean-up.
QUOTES = {"‘": "'", "“": '"', "”": '"'}  # the closing single quote is left as it is
DROPPED = "￾"
SPACE_BEFORE = r"(?U)\s+([;,.:)])"
SPACE_AFTER = r"(?U)([(\[])\s+"
CLAUSE_CUT = r"(?iU);\s*|,\s+(?:and|but|however|whereas)\s+"
SENTENCE_CUT = r"(?U)(?<=[.!?])\s+"
PREAMBLE = r"(?iU)^(?:here'?s|here is|sure[,!]?|certainly[,!]?|simplified version|plain english)[^\n]*?:\s*"
ITEM = r"\(\s*(?:[a-z]|([a-z])\1|i{1,3}|iv|v|vi{0,3}|ix|x)\s*\)"
HEADLESS = rf"(?iU)^(?:(?:(?:or|and)\s*,?\s*)?if\b|{ITEM})"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c.cast("string")) == "")


def norm_text(c: Column) -> Column:
    """Trimmed, lower case, single spaces; null stays null."""
    return collapse(F.lower(strip(c)))


def pair_key(premise: Column, hypothesis: Column) -> Column:
    """Key of a pair for exact matches after normalisation; a missing side counts as empty."""
    empty = F.lit("")
    return F.concat_ws(" ||| ", F.coalesce(norm_text(premise), empty), F.coalesce(norm_text(hypothesis), empty))


def normalize_line(c: Column) -> Column:
    marks = "".join(QUOTES) + DROPPED
    return strip(collapse(F.translate(c, marks, "".join(QUOTES.values()))))


def clean_unit_text(c: Column) -> Column:
    closed = F.regexp_replace(normalize_line(c), SPACE_BEFORE, "$1")
    return strip(F.regexp_replace(closed, SPACE_AFTER, "$1"))


def _parts(c: Column, cut: str) -> Column:
    return F.filter(F.transform(F.split(strip(c), cut), strip), lambda x: x != "")


def clause_split(c: Column) -> Column:
    """Parts between semicolons, and commas before and, but, however or whereas."""
    return _parts(c, CLAUSE_CUT)


def sentence_split(c: Column) -> Column:
    return _parts(c, SENTENCE_CUT)


def paragraph_split(c: Column) -> Column:
    return _parts(c, r"(?U)\n\s*\n")


def strip_preamble(c: Column) -> Column:
    """Without one leading announcement such as "Here is a simplified version:", up to the first line's first colon."""
    return strip(F.regexp_replace(strip(c), PREAMBLE, ""))


def is_headless(c: Column) -> Column:
    """A branch ("or, if ...") or a lettered or roman item ("(a) ...") that lacks its head."""
    return F.coalesce(c.rlike(HEADLESS), F.lit(False))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; no built-in function does it."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")
