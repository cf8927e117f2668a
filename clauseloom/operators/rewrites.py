"""Quality of rewrites: readability, overlap with a reference, winners, slices, defects."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions.text import PREAMBLE, is_blank, strip

# The published readability formulas' factors and the marks of format defects.
FKGL = (0.39, 11.8, -15.59)
ARI = (4.71, 0.5, -21.43)
BULLET = r"(?mdU)^\s*(?:[-*•]|\d+[.)])\s+"
LEAKED = r"(?iU)\b(?:original|source|provision|simplified|output|answer)\s*(?:text|version)?\s*:"


#: Classes of a character, as bits.
IN_WORD, LETTER, VOWEL, LAST_E, STOP, SPACE, LINE_END = 1, 2, 4, 8, 16, 32, 64
_COUNTS = T.StructType([T.StructField(n, T.LongType()) for n in ("sentences", "words", "letters", "syllables")])


@lru_cache(1)
def _classes() -> np.ndarray:
    """The classes of every code point; a worker makes the table once."""
    out = np.zeros(0x110000, np.uint8)
    for code in range(len(out)):
        if unicodedata.category(chr(code))[0] in "LN":
            out[code] = IN_WORD | LETTER
    marks = {"'": IN_WORD, " \t\n\x0b\f\r": SPACE, "\x85\u2028\u2029": LINE_END, ".!?": STOP, "aeiouy": VOWEL, "e": LAST_E}
    for chars, bit in marks.items():
        for c in chars:
            out[ord(c)] |= bit
    return out


def scan_counts(texts: list[str]) -> np.ndarray:
    """(sentences, words, letters and digits, syllables) of lower-case texts, by one pass of table look-ups over all of them.

    Sentences are runs of stops before white space or the end, one at least. A
    word's syllables are its vowel groups without a silent last e, one at least:
    over a text these are all vowel groups, less the words' silent e's, and one for
    each word that then has none.
    """
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    start, full = end - size, size > 0
    kind = _classes()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
    before, after = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[start[full]] = after[end[full] - 1] = 0  # nothing reaches into a neighbour's text
    last = np.zeros(len(kind), bool)
    last[end[full] - 1] = True
    closing = np.zeros(len(kind), bool)  # a line end as a text's last character ends it too
    closing[:-1] = last[1:] & (kind[1:] & LINE_END > 0)
    closing[start[full]] &= size[full] > 1
    has = lambda k, bit: k & bit > 0
    ended = has(kind, STOP) & (has(after, SPACE) | last | closing)
    begins = has(kind, IN_WORD) & ~has(before, IN_WORD)
    groups = has(kind, VOWEL) & ~has(before, VOWEL)
    silent = has(kind, LAST_E) & has(before, IN_WORD) & ~has(before, VOWEL) & ~has(after, IN_WORD)
    word = np.cumsum(begins) - 1
    voiced = np.bincount(word[has(kind, VOWEL) & ~silent], minlength=int(begins.sum()))
    bare = np.zeros(len(kind), bool)
    bare[np.flatnonzero(begins)[voiced == 0]] = True

    def total(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        return upto[end] - upto[start]

    return np.stack([np.maximum(total(ended), 1), total(begins), total(has(kind, LETTER)), total(groups) - total(silent) + total(bare)], 1)


@F.arrow_udf(_COUNTS)
def _scanned(low: pa.Array) -> pa.Array:
    """Counts of lower-case texts; about a million characters are in memory at a time, a longer text alone."""
    texts = low.to_pylist()
    parts, part, size = [], [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size > 1 << 20:
            parts.append(scan_counts(part))
            part, size = [], 0
    if part:
        parts.append(scan_counts(part))
    counts = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
    return pa.StructArray.from_arrays([pa.array(c) for c in counts.T.copy()], _COUNTS.names)


def _counts(c: Column) -> tuple[Column, Column, Column, Column]:
    """(sentences, words, letters and digits, syllables) of a text."""
    scanned = _scanned(F.lower(c))
    return tuple(scanned[n] for n in _COUNTS.names)


def _formula(c: Column, kind: str) -> Column:
    sentences, words, letters, syllables = _counts(c)
    a, b, k = FKGL if kind == "fkgl" else ARI
    value = (
        F.lit(a) * words / sentences + F.lit(b) * syllables / words + k
        if kind == "fkgl"
        else F.lit(a) * letters / words + F.lit(b) * words / sentences + k
    )
    return F.when(~is_blank(c) & (words > 0), value)


def fkgl(c: Column) -> Column:
    """Flesch-Kincaid grade level; null for a text without words."""
    return _formula(c, "fkgl")


def ari(c: Column) -> Column:
    """Automated readability index; null for a text without words."""
    return _formula(c, "ari")


# The endings of the published algorithm's second, third and fourth step, in its order.
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant, each counted once a run."""
    return len(re.findall("vc", re.sub("v+", "v", re.sub("c+", "c", _shape(stem)))))


def _shape(w: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel behind a consonant."""
    out = ""
    for k, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and k and out[-1] == "c") else "c"
    return out


def _closed(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(1 << 16)
def _stem(w: str) -> str:
    """The published suffix stripping algorithm of 1980, for words over three letters."""
    if len(w) <= 3:
        return w
    has_vowel = lambda x: "v" in _shape(x)
    for end, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + put
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            base = w[: len(w) - len(end)]
            if w.endswith(end) and has_vowel(base):
                double = len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz"
                w = base + "e" if base.endswith(("at", "bl", "iz")) else base[:-1] if double else base + "e" if _measure(base) == 1 and _closed(base) else base
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (SECOND, THIRD):
        for end, put in table:
            if w.endswith(end):
                base = w[: len(w) - len(end)]
                w = base + put if _measure(base) > 0 else w
                break
    for end in FOURTH:
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _closed(base)):
            w = base
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: one integer of as many bits as the shorter text has words.

    Bit i of `open_` is cleared where the table's row for the words of the longer
    text so far rises at word i; a word updates the row in a few operations on whole
    integers, that is on as many places at once as a machine word has bits.
    """
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    open_ = full
    for w in a:
        if hit := places.get(w):
            met = open_ & hit
            open_ = ((open_ + met) | (open_ - met)) & full
    return len(b) - open_.bit_count()


def _rouge(stem: bool):
    @F.pandas_udf(T.DoubleType())
    def run(ref: pd.Series, pred: pd.Series) -> pd.Series:
        cut = lambda t: [_stem(w) if stem else w for w in re.findall("[a-z0-9]+", t.lower())]

        def one(a, b):
            if a is None or b is None or not a.strip() or not b.strip():
                return None
            x, y = cut(a), cut(b)
            k = _lcs(x, y) if x and y else 0
            return 2 * k / (len(x) + len(y)) if k else 0.0

        return pd.Series([one(a, b) for a, b in zip(ref, pred, strict=True)], dtype="float64")

    return run


def rouge_l(ref: Column, pred: Column, stem: bool = True) -> Column:
    """F-measure of the longest common subsequence of words; null if either side is blank."""
    return _rouge(stem)(ref, pred)


def model_averages(scores: DataFrame, by: str = "model") -> DataFrame:
    """Mean of each metric (rows by, metric, value as text or number), ignoring what is no number, to three places, and how many counted."""
    v = F.col("value").try_cast("double")
    v = F.when(~F.isnan(v), v)
    return scores.groupBy(by, "metric").agg(F.bround(F.avg(v), 3).alias("mean"), F.count(v).alias("n"))


def row_wins(scores: DataFrame, low: tuple[str, ...] = ("fkgl", "ari")) -> DataFrame:
    """Rows on which a model has the best value of a metric (lowest for `low`); ties go to the first model by name."""
    best = F.when(F.col("metric").isin(*low), -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("example_id", "metric").orderBy(best.desc_nulls_last(), "model")
    first = scores.where("value is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.groupBy("model", "metric").agg(F.count(F.lit(1)).alias("wins"))


def slice_by_flag(scores: DataFrame, flag: str, value: str = "value") -> DataFrame:
    """Mean by model for rows without and with the flag, and the drop between them."""
    p = scores.groupBy("model").pivot(flag, [0, 1]).agg(F.avg(value))
    return p.select("model", F.col("0").alias("without"), F.col("1").alias("with"), (F.col("0") - F.col("1")).alias("drop"))


def exact_copies(outputs: DataFrame) -> DataFrame:
    same = strip(F.col("output")) == strip(F.col("source_text"))
    return outputs.groupBy("model").agg(F.count_if(F.coalesce(same, F.lit(False))).alias("n_copies"), F.count(F.lit(1)).alias("n_rows"))


def format_defects(outputs: DataFrame) -> DataFrame:
    o = F.col("output")
    return outputs.groupBy("model").agg(
        F.count_if(strip(o).rlike(PREAMBLE)).alias("n_preamble"), F.count_if(o.rlike(BULLET)).alias("n_bullets"), F.count_if(o.rlike(LEAKED)).alias("n_leaked_label")
    )


def source_vs_gold(df: DataFrame) -> DataFrame:
    """Mean readability of the sources and of the gold rewrites."""
    sides = df.select(F.inline(F.array(F.struct(F.lit("source").alias("side"), F.col("source_text").alias("t")), F.struct(F.lit("gold").alias("side"), F.col("simple_text").alias("t")))))
    graded = sides.select("side", fkgl(F.col("t")).alias("fkgl"), ari(F.col("t")).alias("ari"))
    return graded.groupBy("side").agg(F.bround(F.avg("fkgl"), 3).alias("fkgl"), F.bround(F.avg("ari"), 3).alias("ari"), F.count("fkgl").alias("n"))
