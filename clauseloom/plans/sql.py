"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from clauseloom.functions import legal
from clauseloom.functions.legal import STOP_WORDS, WORD_VALUES

WORD = r"\b(" + "|".join(sorted(WORD_VALUES, key=lambda w: (-len(w), w))) + r")\b"
DIGITS = r"\b(\d{1,3}(,\d{3})+(\.\d+)?|\d+(\.\d+)?)\b"
PROHIBITS = r"\b(shall|must|may|can)\s+not\b|\bcannot\b"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '^\s+', ''), '\s+$', '')"


def norm(t: str) -> str:
    return rf"regexp_replace(lower({strip(t)}), '\s+', ' ', 'g')"


def pair_key(a: str, b: str) -> str:
    return f"concat(coalesce({norm(a)}, ''), ' ||| ', coalesce({norm(b)}, ''))"


def tags(t: str) -> str:
    rest = f"regexp_replace(lower({t}), '{PROHIBITS}', ' ', 'g')"
    return (
        f"list_filter([CASE WHEN regexp_matches({rest}, '\\b(shall|must)\\b') THEN '{legal.OBLIGATION}' END, "
        f"CASE WHEN regexp_matches({rest}, '\\b(may|can)\\b') THEN '{legal.PERMISSION}' END, "
        f"CASE WHEN regexp_matches(lower({t}), '{PROHIBITS}') THEN '{legal.PROHIBITION}' END], lambda x: x IS NOT NULL)"
    )


def lex(t: str) -> str:
    masked = f"regexp_replace(regexp_replace(lower({t}), '{DIGITS}', ' ', 'g'), '{WORD}', ' ', 'g')"
    words = f"list_filter(regexp_extract_all({masked}, '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(STOP_WORDS)}))"
    return f"list_sort(list_distinct(list_concat({tags(t)}, {words})))"


def numbers(t: str) -> str:
    """Plain digits and number words, which is all that the templates hold."""
    values = "map {" + ", ".join(f"'{w}': '{v}'" for w, v in WORD_VALUES.items()) + "}"
    digits = f"list_transform(regexp_extract_all(lower({t}), '\\b\\d+\\b'), lambda d: CAST(CAST(d AS BIGINT) AS VARCHAR))"
    words = f"list_transform(regexp_extract_all(lower({t}), '{WORD}'), lambda w: {values}[w])"
    return f"list_sort(list_distinct(list_concat({digits}, {words})))"


def conflict(a: str, b: str) -> str:
    def flip(x: str, y: str) -> str:
        return f"(list_contains({tags(x)}, '{legal.PROHIBITION}') AND NOT list_contains({tags(y)}, '{legal.PROHIBITION}') AND list_contains({tags(y)}, '{legal.PERMISSION}'))"

    return f"({flip(a, b)} OR {flip(b, a)})"


def drop_nulls(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def label_id(c: str) -> str:
    low = f"lower({strip(c)})"
    return (
        f"CASE {low} WHEN 'contradiction' THEN 0 WHEN 'entailment' THEN 1 WHEN 'neutral' THEN 2 ELSE "
        f"CASE WHEN regexp_matches({low}, '^[+-]?\\d+(\\.\\d*)?$') AND CAST({low} AS DOUBLE) IN (0, 1, 2) THEN CAST(CAST({low} AS DOUBLE) AS INT) END END"
    )


def has_preamble(t: str) -> str:
    """An announcement at the text's begin, and a colon in its first line."""
    words = " OR ".join(f"starts_with(lower({strip(t)}), '{w}')" for w in ("heres", "here''s", "here is", "sure", "certainly", "simplified version", "plain english"))
    return f"(({words}) AND contains(split_part({strip(t)}, chr(10), 1), ':'))"


def preamble_cut(t: str) -> str:
    return f"CASE WHEN {has_preamble(t)} THEN substr({strip(t)}, strpos({strip(t)}, ':') + 1) ELSE {t} END"
