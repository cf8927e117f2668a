"""Fill-in-the-middle forms of documents, cut with a compressed set of unit boundaries.

The boundaries between a text's units are byte offsets. They are kept as a set in
the manner of Roaring bitmaps: one container for every 65,536 offsets, which is a
sorted array, a bitmap or a list of runs, whatever is smallest (a stretch of ASCII
is one run), and the cumulative cardinalities of the containers. The offset of
the k-th boundary is found by a search of the cardinalities and a select inside
one container. Only a text's offsets come back from Python; texts are cut and
joined, and rebuilt, by built-in functions.

Defined cases: a null text counts as empty; empty texts, and texts that hold a
sentinel, stay plain; a null id draws as an empty one; rows that repeat an id draw
alike; very long texts are cut whole, their set takes at most an eighth of their
size; an empty table gives an empty one; all of the caller's columns stay, and
the result's column gets a name that none of them has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPAN = 1 << 16
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True


def char_starts(b: np.ndarray, before: int) -> np.ndarray:
    """Where code points begin in a stretch of UTF-8."""
    return (b & 0xC0) != 0x80


def word_starts(b: np.ndarray, before: int) -> np.ndarray:
    """Where words of non-blank bytes begin; `before` is the byte in front of the stretch."""
    blank = BLANKS[b]
    return ~blank & np.concatenate([[BLANKS[before]], blank[:-1]])


class ArrayContainer:
    def __init__(self, bits: np.ndarray):
        self.low = np.flatnonzero(bits).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(bits, bitorder="little").tobytes()
        packed = np.frombuffer(self.words.ljust(-(-len(self.words) // 8) * 8, b"\0"), "<u8")
        self.upto = np.cumsum(np.bitwise_count(packed), dtype=np.int32)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, "right"))
        k -= int(self.upto[at - 1]) if at else 0
        word = int.from_bytes(self.words[8 * at : 8 * at + 8], "little")
        for _ in range(k):
            word &= word - 1
        return 64 * at + (word & -word).bit_length() - 1


class RunContainer:
    def __init__(self, first: np.ndarray, length: np.ndarray):
        self.first, self.upto = first, np.cumsum(length)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, "right"))
        return int(self.first[at]) + k - (int(self.upto[at - 1]) if at else 0)


def container(bits: np.ndarray, card: int):
    """The smallest container of the set bits: 2 bytes an array's entry, 4 a run, an eighth of the span a bitmap."""
    if card == len(bits):
        return RunContainer(np.zeros(1, np.int64), np.array([card]))
    edge = np.diff(bits.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first = np.flatnonzero(edge == 1)
    sizes = {"array": 2 * card, "run": 4 * len(first), "bitmap": len(bits) // 8 + 8}
    kind = min(sizes, key=sizes.get)
    if kind == "run":
        return RunContainer(first, np.flatnonzero(edge == -1) - first)
    return ArrayContainer(bits) if kind == "array" else BitmapContainer(bits)


class BoundarySet:
    """The offsets where units of a text begin, 0 always among them, and the text's end as the last boundary."""

    def __init__(self, text: np.ndarray, starts=char_starts):
        self.end, self.containers, cards = len(text), [], []
        for at in range(0, len(text), SPAN):
            bits = starts(text[at : at + SPAN], int(text[at - 1]) if at else 32)
            if not at:
                bits[0] = True
            card = int(np.count_nonzero(bits))
            self.containers.append(container(bits, card))
            cards.append(card)
        self.upto = np.cumsum(cards, dtype=np.int64) if cards else np.zeros(0, np.int64)
        self.n = int(self.upto[-1]) if cards else 0

    def select(self, k: int) -> int:
        """The offset of boundary k; boundary n is the end."""
        if k >= self.n:
            return self.end
        c = int(np.searchsorted(self.upto, k, "right"))
        return c * SPAN + self.containers[c].select(k - (int(self.upto[c - 1]) if c else 0))


CUTS = "struct<n:long,first:long,second:long,from:long,to:long>"
UNITS = {"char": char_starts, "word": word_starts}


def cut_points(unit: str):
    """(text as bytes, two draws) -> number of units n, both cuts in units (the draws modulo n + 1, smaller first) and in bytes."""
    starts = UNITS[unit]

    def run(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, x, y in columns:
            # offsets and bytes without a copy; a null text has no bytes
            _, offsets, data = text.buffers()
            ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(text.type) else np.int32)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            out = np.zeros((5, len(text)), np.int64)
            for i, (a, b) in enumerate(zip(x.to_pylist(), y.to_pylist(), strict=True)):
                marks = BoundarySet(raw[ends[i] : ends[i + 1]], starts)
                lo, hi = sorted((a % (marks.n + 1), b % (marks.n + 1)))
                out[:, i] = marks.n, lo, hi, marks.select(lo), marks.select(hi)
            yield pa.StructArray.from_arrays([pa.array(c) for c in out], ["n", "first", "second", "from", "to"])

    return F.arrow_udf(run, CUTS)


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20, unit: str = "char",
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), out: str = "fim",
) -> DataFrame:
    """docs with `out`: n, form (plain, psm, spm), first and second cut in units (null if plain), text."""
    p, s, m = marks
    text, cut, name = unused(docs.columns, "_text"), unused(docs.columns, "_cut"), unused(docs.columns, out)
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ready = docs.withColumn(text, body).withColumn(cut, cut_points(unit)(F.col(text).cast("binary"), h1, h2))
    holds = F.lit(False)
    for x in marks:
        holds = holds | F.col(text).contains(x)
    form = F.when((F.col(text) == "") | holds | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    raw, a, b = F.col(text).cast("binary"), F.col(cut)["from"].cast("int"), F.col(cut)["to"].cast("int")
    piece = lambda at, size: F.substring(raw, at + 1, size).cast("string")
    prefix, middle, suffix = piece(F.lit(0), a), piece(a, b - a), piece(b, F.octet_length(text) - b)
    shown = (
        F.when(form == "plain", F.col(text)).when(form == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
    )
    made = F.struct(
        F.col(cut)["n"].alias("n"), form.alias("form"), F.when(form != "plain", F.col(cut)["first"]).alias("first"),
        F.when(form != "plain", F.col(cut)["second"]).alias("second"), shown.alias("text"),
    )
    return ready.select(*[F.col(f"`{c}`") for c in docs.columns], made.alias(name))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that `output` was made from. No text of these forms holds a sentinel, so its parts stand between them."""
    parts = F.split(output, "|".join(re.escape(x) for x in marks), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n, form, sizes of prefix and middle, digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs.select(id_col, text_col), id_col, text_col)
    f = lambda c: F.col(made.columns[-1])[c]
    return made.select(
        F.col(id_col), f("n").alias("n"), f("form").alias("form"), f("first").alias("prefix_chars"), (f("second") - f("first")).alias("middle_chars"),
        F.sha2(f("text"), 256).alias("output_sha256"), F.sha2(restore(f("text"), f("form")), 256).alias("restored_sha256"),
    )
