"""Column functions on statute language: numbers, modality, tokens, flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import strip

# Words that carry no content, modal tags, number words, roles and cross references.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "by", "with", "is", "are", "be", "was", "were", "this", "that", "any", "such",
    "as", "at", "he", "she", "they", "who", "which", "been", "have", "has", "from", "its", "their",
)
OBLIGATION, PERMISSION, PROHIBITION = "LEGAL_MODAL_OBLIGATION", "LEGAL_MODAL_PERMISSION", "LEGAL_MODAL_PROHIBITION"
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
DIGITS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
TEENS = {
    "zero": 0, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19,
}
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
    "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16, "seventeenth": 17,
    "eighteenth": 18, "nineteenth": 19, "twentieth": 20,
}
# Each pattern tries a character first that all its matches begin with: word borders of Unicode texts cost more than that.
NUMBER = r"(?U)(?=\d)(?<![A-Za-z])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?![A-Za-z])"
ROLES = (
    "magistrate", "judge", "court", "minister", "child", "parent", "guardian", "person", "officer", "commissioner", "police",
    "defendant", "plaintiff", "director", "secretary", "president", "government", "public servant", "wife", "husband", "surgeon",
)
CROSS_REFERENCES = (
    "this section", "that section", "last preceding section", "preceding section", "subsection", "chapter", "this code", "hereinafter",
)
OBLIGES, PERMITS = r"(?U)(?=[sm])\b(?:shall|must)\b(?!\s+not\b)", r"(?U)(?=[mc])\b(?:may|can)\b(?!\s+not\b)"
PROHIBITS = r"(?U)(?=[smc])(?:\b(?:shall|must|may|can)\s+not\b|\bcannot\b)"
MODAL = r"(?iU)\b(?:shall|may|must)\b"
EXCEPTION = r"(?iU)\b(?:if|unless|provided that|provided further that|except|notwithstanding)\b"

#: Every number word and its value; "one" alone is an article as often as a number and isn't counted.
WORD_VALUES: dict[str, int] = (
    {f"{t}-{d}": a + b for t, a in TENS.items() for d, b in DIGITS.items()} | TENS | TEENS | {w: v for w, v in DIGITS.items() if w != "one"} | ORDINALS
)


def _word_pattern(words) -> str:
    """Any of words, the longest first; one branch for each first letter, so that few places of a text try any word at all."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by_first.setdefault(w[0], []).append(w[1:])
    branches = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items()))
    return rf"(?U)(?=[{''.join(sorted(by_first))}])\b(?:{branches})\b"


WORD_NUMBER = _word_pattern(WORD_VALUES)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed a single time however often it is used; conditions would compute it again in each branch."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical_number(c: Column) -> Column:
    """5,000 and 5000 alike, 3.50 as 3.5, 007 as 7, 0.00 as 0."""
    plain = F.regexp_replace(F.regexp_replace(c, ",", ""), r"^0+(?=\d)", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _word_map() -> Column:
    return F.create_map(*[F.lit(x) for w, v in WORD_VALUES.items() for x in (w, str(v))])


def word_number(c: Column) -> Column:
    """Value of a single number word as text, null for other words."""
    return F.try_element_at(_word_map(), F.lower(c))


def extract_numbers(c: Column) -> Column:
    """Distinct canonical numbers of a text, from digits and from words, sorted."""
    digits = F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1)), canonical_number)
    values = _word_map()
    words = F.transform(F.regexp_extract_all(F.lower(c), F.lit(WORD_NUMBER), F.lit(0)), lambda w: F.element_at(values, w))
    return F.array_sort(F.array_union(digits, words))


def modality_tags(c: Column) -> Column:
    """Tags for prohibition (a modal with "not"), and for obligation and permission by modals without it."""
    t = F.lower(c)
    return F.array_compact(
        F.array(
            F.when(t.rlike(OBLIGES), OBLIGATION),
            F.when(t.rlike(PERMITS), PERMISSION),
            F.when(t.rlike(PROHIBITS), PROHIBITION),
        )
    )


def lexical_tokens(c: Column) -> Column:
    """Distinct content words and modal tags, numbers masked first; sorted."""
    masked = F.regexp_replace(F.regexp_replace(F.lower(c), NUMBER, " "), WORD_NUMBER, " ")
    words = F.filter(F.regexp_extract_all(masked, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    return F.array_sort(F.array_union(modality_tags(c), words))


def number_tokens(c: Column) -> Column:
    """Numbers of the lower-cased text, as the tokenizer masks them."""
    return extract_numbers(F.lower(c))


def tokenize(c: Column) -> Column:
    return F.array_sort(F.array_union(lexical_tokens(c), number_tokens(c)))


def lexical_overlap(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(lexical_tokens(a), lexical_tokens(b)))


def modal_conflict(a: Column, b: Column) -> Column:
    """One text prohibits, the other doesn't and permits."""
    tags = F.struct(modality_tags(a).alias("a"), modality_tags(b).alias("b"))
    return once(tags, lambda t: tags_conflict(t["a"], t["b"]))


def tags_conflict(a: Column, b: Column) -> Column:
    """modal_conflict of two texts' tags, or of their lexical tokens, which the tags are among."""

    def flip(x: Column, y: Column) -> Column:
        return F.array_contains(x, PROHIBITION) & ~F.array_contains(y, PROHIBITION) & F.array_contains(y, PERMISSION)

    return flip(a, b) | flip(b, a)


def legal_flags(c: Column) -> dict[str, Column]:
    """The six 0/1 features of a legal unit's text."""
    low, bare = F.lower(c), strip(c)
    some_role = F.lit(False)
    for role in ROLES:
        some_role = some_role | low.contains(role)
    flags = {
        "has_modal": c.rlike(MODAL),
        "has_exception": c.rlike(EXCEPTION),
        "has_numbers": c.rlike(r"(?U)\b\d+\b"),
        "has_roles": some_role,
        "needs_context": low.rlike(r"(?U)\b(?:" + "|".join(CROSS_REFERENCES) + r")\b"),
        "bad_fragment": (F.length(bare) < 35) | (bare.rlike("[:;]$") & (F.length(bare) < 120)),
    }
    return {k: v.cast("int").alias(k) for k, v in flags.items()}


def with_legal_flags(df: DataFrame, text: str) -> DataFrame:
    return df.select("*", *legal_flags(F.col(text)).values())
