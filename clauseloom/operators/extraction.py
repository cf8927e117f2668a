"""Statute pages to candidate rows: positioned words, lines, pages, sections, units.

Sections and units are found in one pass over lines that are dealt by document and
sorted inside partitions. Rows stream through Arrow batches; what is carried from
line to line, and from batch to batch, is the state of one document's open section:
its lines up to the first page break, where its page becomes known, and the open
unit's text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clauseloom.functions.legal import legal_flags
from clauseloom.functions.text import DROPPED, clean_unit_text, is_blank, normalize_line, strip
from clauseloom.plans.shared import written

# Marks of sections, units and margin notes, and the share of a page that is margin.
SECTION = r"(?U)^\d+[A-Z]?\."
SECTION_MARK = re.compile(r"(\d+[A-Z]?)\.(?:\s|$)")
AMENDMENT = r"(?U)^\[\s*\d+.*\]$"
CHAPTER = r"(?iU)^CHAPTER\b"
CHAPTER_LINE = re.compile(r"CHAPTER\b", re.I)
SUBSECTION = re.compile(r"\((\d+)\)\s*")
PROVISO = re.compile(r"Provided(?:\s+further)?\s+that\b", re.I)
EXPLANATION = re.compile("Explanation", re.I)
ILLUSTRATIONS = re.compile(r"Illustrations?\.?$", re.I)
LETTER_OR_ROMAN = re.compile(r"\((?:[a-z]|[ivxlcdm]+)\)", re.I)
LEFT_MARGIN, WIDE_MARGIN = 0.20, 0.22
SHORT_LINE, SHORT_NOTE = 60, 80


def _joined(c: str, *order: str, sep: str) -> Column:
    """Texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, c))), lambda x: x[c]), sep)


def words_to_lines(words: DataFrame) -> DataFrame:
    """Lines with their box and text: words from left to right, ties by number."""
    return words.groupBy("doc_id", "page", "page_width", "block_no", "line_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        _joined("word", "x0", "word_no", sep=" ").alias("text"),
    )


def is_margin_noise(text: Column, width: Column, x0: Column, x1: Column, heading: str = "PENAL CODE") -> Column:
    """Blank lines, amendment notes, the running head and what stands in the margin."""
    t = normalize_line(text)
    opens = t.rlike(SECTION) | t.rlike(CHAPTER)
    return (
        is_blank(t) | t.rlike(AMENDMENT) | (t == heading)
        | ((x1 < width * WIDE_MARGIN) & (F.length(t) < SHORT_NOTE))
        | ((x0 < width * LEFT_MARGIN) & (F.length(t) < SHORT_LINE) & ~opens)
    )


def drop_margin_noise(lines: DataFrame, heading: str = "PENAL CODE") -> DataFrame:
    noise = is_margin_noise(F.col("text"), F.col("page_width"), F.col("x0"), F.col("x1"), heading)
    return lines.where(~noise).withColumn("text", normalize_line(F.col("text")))


def lines_to_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page, text): lines from top to bottom."""
    return lines.groupBy("doc_id", "page").agg(_joined("text", "y0", "x0", "block_no", "line_no", sep="\n").alias("text"))


def merge_pages(pages: DataFrame) -> DataFrame:
    """One text per document with page marks; blank pages are skipped."""
    marked = pages.where(~is_blank(F.col("text"))).withColumn("text", F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n"), strip(F.col("text"))))
    return marked.groupBy("doc_id").agg(_joined("text", "page", sep="\n\n").alias("text"))


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line_idx, line) of pages that aren't blank."""
    full = pages.where(~is_blank(F.col("text")))
    return full.select("doc_id", "page", F.posexplode(F.split(strip(F.col("text")), "\n")).alias("line_idx", "line"))


#: Rows of an Arrow batch that a scan gives back.
BATCH_ROWS = 4096
_DROP = dict.fromkeys(map(ord, DROPPED))
_UNSEEN = object()


def _section_mark(line: str, lo: int, hi: int) -> str | None:
    """The number that opens a section; four digits are a year."""
    m = SECTION_MARK.match(line)
    if not m:
        return None
    digits = m[1].rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return m[1] if (len(m[1]) != 4 or digits != m[1]) and len(digits) < 19 and lo <= int(digits) <= hi else None


def scan_sections(lines: Iterator[tuple], lo: int, hi: int) -> Iterator[tuple]:
    """Sorted (doc, page, line_idx, line) -> these with section_no, section_id and page_start; lines before a document's first section go.

    page_start is the page that begins first after the section's own first page and
    before the next section does; a page's mark stands in front of its lines, so a
    section that ends with its page still holds the mark of the next.
    """
    doc, no, mark, first, start, held = _UNSEEN, 0, None, None, None, None

    def release() -> Iterator[tuple]:
        for row in held or ():
            yield (*row, no, mark, start)

    for row in lines:
        if row[0] != doc or doc is _UNSEEN:
            yield from release()
            doc, no, mark, held = row[0], 0, None, None
        if held is not None and row[1] != first:
            start = row[1]
            yield from release()
            held = None
        opened = _section_mark(row[3], lo, hi)
        if opened is not None:
            yield from release()
            no, mark, first, start, held = no + 1, opened, row[1], None, []
        if held is not None:
            held.append(row)
        elif mark is not None:
            yield (*row, no, mark, start)
    yield from release()


def _kind(line: str) -> tuple[str | None, str]:
    """Type and label of the unit that a line opens; no type where it opens none."""
    if m := SUBSECTION.match(line):
        return "subsection", m[1]
    if PROVISO.match(line):
        return "proviso", "provided_that"
    if EXPLANATION.match(line):
        return "explanation", "explanation"
    return ("illustrations_header", "illustrations") if ILLUSTRATIONS.match(line) else (None, "")


def scan_units(lines: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of `scan_sections` -> (doc, section_no, section_id, page_start, unit_no, label, type, text, seq).

    unit_no counts the lines of a section that open a unit; what stands before the
    first is unit 0. seq counts a document's units whose cleaned text isn't empty.
    """
    section, unit, seq = _UNSEEN, None, 0

    def close() -> Iterator[tuple]:
        nonlocal seq
        if unit:
            (doc, no, mark, start), unit_no, kind, label, texts = unit
            if kind == "illustrations_header" and any(map(LETTER_OR_ROMAN.match, texts[1:])):
                kind = "illustration"
            text = " ".join(texts)
            seq += bool(text.translate(_DROP).strip())
            yield doc, no, mark, start, unit_no, label, kind or "section_body", text, seq

    for doc, _, _, line, no, mark, start in lines:
        line = line.strip()
        if not line or CHAPTER_LINE.match(line):
            continue
        kind, label = _kind(line)
        if section is _UNSEEN or (doc, no) != section[:2]:
            yield from close()
            if section is _UNSEEN or doc != section[0]:
                seq = 0
            section, unit = (doc, no, mark, start), None
        if unit is None or kind:
            before = unit[1] if unit else 0
            if unit:
                yield from close()
            unit = (section, before + bool(kind), kind, label, [])
        unit[4].append(line)
    yield from close()


def _scan(rows: DataFrame, order: list[str], columns: list[str], step: Callable[[Iterator[tuple]], Iterator[tuple]], out: str) -> DataFrame:
    """`step` over the rows of whole documents in order; `out` are its columns behind doc_id and page (page_start)."""
    doc, page = rows.schema["doc_id"].dataType, rows.schema["page"].dataType
    types = {"doc": doc, "page": page, "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
    schema = T.StructType([T.StructField(n, types[t]) for n, t in (x.split() for x in out.split(","))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (r for b in batches for k in range(0, b.num_rows, BATCH_ROWS) for r in zip(*(b.column(c).slice(k, BATCH_ROWS).to_pylist() for c in columns), strict=True))
        for part in batched(step(flat), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

    return rows.select(*columns).repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(run, schema)


_LINE, _FOUND = ["doc_id", "page", "line_idx", "line"], ["section_no", "section_id", "page_start"]
_UNITS = "doc_id doc,section_no long,section_id string,page_start page,unit_no long,unit_label string,unit_type string,text string,seq long"


def find_sections(lines: DataFrame, lo: int = 1, hi: int = 500) -> DataFrame:
    """lines with section_no (its ordinal in the document), section_id and page_start; lines before the first section go."""
    out = "doc_id doc,page page,line_idx int,line string,section_no long,section_id string,page_start page"
    return _scan(lines, ["page", "line_idx"], _LINE, lambda rows: scan_sections(rows, lo, hi), out)


def split_units(section_lines: DataFrame) -> DataFrame:
    """Units of each section: doc_id, section_no, section_id, page_start, unit_no, unit_label, unit_type, text."""
    return _scan(section_lines, ["section_no", "page", "line_idx"], [*_LINE, *_FOUND], scan_units, _UNITS).drop("seq")


def section_units(lines: DataFrame, lo: int = 1, hi: int = 500) -> DataFrame:
    """What find_sections and split_units give one after the other, in one pass, with seq, a document's running number of units."""
    return _scan(lines, ["page", "line_idx"], _LINE, lambda rows: scan_units(scan_sections(rows, lo, hi)), _UNITS)


def rows_before(counts: DataFrame, doc: str, n: str, out: str) -> DataFrame:
    """doc and `out`, the sum of n over all documents of smaller id.

    Documents are ranged into parts by id, summed inside each part, and moved by the
    sums of the parts before, so that no window spans more than a part, or one row
    per part.
    """
    parts = written(counts.repartitionByRange(doc).withColumn("_part", F.spark_partition_id()), "counts")  # both uses below see the same parts
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(n).over(earlier(Window.partitionBy("_part").orderBy(doc))), F.lit(0))
    sums = parts.groupBy("_part").agg(F.sum(n).alias("_s"))
    moved = sums.select("_part", F.coalesce(F.sum("_s").over(earlier(Window.orderBy("_part"))), F.lit(0)).alias("_before"))
    return parts.withColumn("_in", within).join(F.broadcast(moved), "_part").select(doc, (F.col("_in") + F.col("_before")).alias(out))


def build_candidates(pages: DataFrame, act_name: str, lo: int = 1, hi: int = 500) -> DataFrame:
    """The candidate table: one row per non-empty unit, numbered in document order."""
    cleaned = section_units(page_lines(pages), lo, hi).withColumn("source_text", clean_unit_text(F.col("text"))).where("source_text != ''")
    units = written(cleaned.drop("text"), "units")
    before = rows_before(units.groupBy("doc_id").agg(F.max("seq").alias("_c")), "doc_id", "_c", "_base")
    no = (F.col("_base") + F.col("seq")).cast("string")
    # By a merge: written units are so small as files that Spark would send them, or all documents' counts, through the driver.
    named = units.hint("merge").join(before, "doc_id").withColumn("_no", F.when(F.length(no) < 5, F.lpad(no, 5, "0")).otherwise(no))
    empty = F.lit("")
    return named.select(
        F.concat(F.lit("SL"), "_no").alias("example_id"),
        F.lit(act_name).alias("act_name"), F.concat(F.lit("Section "), F.col("section_id")).alias("section_id"), "unit_label", "unit_type",
        F.col("page_start").cast("int").alias("page_start"), "source_text", *legal_flags(F.col("source_text")).values(),
        empty.alias("simple_text"), empty.alias("split"), empty.alias("notes"),
    )
