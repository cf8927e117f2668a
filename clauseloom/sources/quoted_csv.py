"""CSV files with quoted line breaks, read by many tasks a file.

Spark's text source splits a file at any line break, also inside quotes. Where a
split's first line stands, inside quotes or not, follows from the splits before it.
Each split first says, in a pass over its own lines, what it makes of either
beginning: whether its end is inside quotes if its begin is, and if its begin
isn't. These pairs compose in order, so one narrow row a split tells every split
how it begins. A second pass cuts records: those that lie in one split leave it
whole; a record over a border leaves each of its splits as a fragment, and the few
fragments are joined. Records are then parsed by the built-in CSV parser.

A quote opens a cell only at the cell's begin, as the parser has it; a quote inside
an unquoted cell is text. Line breaks inside cells stay as they are. All input goes through Spark's reader, so a path may be
in any store that Spark reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.plans.shared import written

#: Splits that may begin inside quotes; larger splits make fewer.
MOST_INSIDE = 500_000
RECORD, HEAD, TAIL = 0, 1, 2
_BATCH = 4096


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted cell is open at a line's end, given whether one is at its begin."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line.startswith('"', at):
                inside, at = True, at + 1
                continue
        else:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            inside = False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1


def _transitions(sep: str):
    """(path, start, value) in order -> one row a split: its end after a begin outside, and inside, quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, out, into = None, False, True

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*split, out, into)], ["path", "start", "outside", "inside"])

        for b in batches:
            for path, start, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (path, start) != split:
                    if split:
                        yield row()
                    split, out, into = (path, start), False, True
                if line is not None:  # lines without quotes change nothing and come as nulls
                    out, into = ends_inside(line, out, sep), ends_inside(line, into, sep)
        if split:
            yield row()

    return run


def _cut(sep: str):
    """(path, start, value, last, inside) in order -> (path, start, seq, kind, text): whole records, and fragments at a split's begin and end.

    A cell that a file never closes ends with the file.
    """

    def records(rows: Iterator[tuple]) -> Iterator[tuple]:
        split, lines, seq, open_, head, final = None, [], 0, False, False, False

        def rest() -> Iterator[tuple]:
            if lines:
                yield (*split, seq, HEAD if head else RECORD if final else TAIL, "\n".join(lines))

        for path, start, line, last, inside in rows:
            if (path, start) != split:
                yield from rest()
                split, lines, seq, open_, head, final = (path, start), [], 0, bool(inside), bool(inside), last
            lines.append(line)
            open_ = ends_inside(line, open_, sep)
            if not open_:
                yield (*split, seq, HEAD if head else RECORD, "\n".join(lines))
                lines, seq, head = [], seq + 1, False
        yield from rest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        part = []
        for r in records(rows):
            part.append(r)
            if len(part) == _BATCH:
                yield _batch(part)
                part = []
        if part:
            yield _batch(part)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"path": pa.string(), "start": pa.int64(), "seq": pa.int64(), "kind": pa.int32(), "text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


def split_begins(lines: DataFrame, sep: str = ",") -> DataFrame:
    """path, start, inside of the splits of lines (path, start, value) that begin inside quotes; a table."""
    told = lines.select("path", "start", F.when(F.col("value").contains('"'), F.col("value")))
    maps = told.mapInArrow(_transitions(sep), "path string, start long, outside boolean, inside boolean")
    ordered = maps.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "outside", "inside"))).alias("m"))  # one entry a split of the file
    begin = F.expr("named_struct('now', false, 'at', cast(array() as array<bigint>))")

    def step(acc, m):
        return F.struct(
            F.when(acc["now"], m["inside"]).otherwise(m["outside"]).alias("now"),
            F.when(acc["now"], F.concat(acc["at"], F.array(m["start"]))).otherwise(acc["at"]).alias("at"),
        )

    return written(ordered.select("path", F.explode(F.aggregate("m", begin, step, lambda acc: acc["at"])).alias("start"), F.lit(True).alias("inside")), "begins")


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(text, first): the records of all files under path, and whether a record is its file's first. Blank lines are no records."""
    source = F.col("_metadata")
    last = source["file_block_start"] + source["file_block_length"] >= source["file_size"]
    lines = spark.read.option("lineSep", "\n").text(path).select(source["file_path"].alias("path"), source["file_block_start"].alias("start"), "value", last.alias("last"))
    begins = split_begins(lines, sep)
    n = begins.count()
    if n > MOST_INSIDE:
        raise ValueError(f"{n} splits begin inside quotes; raise spark.sql.files.maxPartitionBytes")
    # A broadcast join leaves a split's lines in order.
    met = lines.join(F.broadcast(begins), ["path", "start"], "left") if n else lines.withColumn("inside", F.lit(False))
    cut = met.select("path", "start", "value", "last", "inside").mapInArrow(_cut(sep), "path string, start long, seq long, kind int, text string")
    whole = cut.where(F.col("kind") == RECORD).select("text", ((F.col("start") == 0) & (F.col("seq") == 0)).alias("first"))
    if n:
        pieces = cut.where(F.col("kind") != RECORD)
        order = Window.partitionBy("path").orderBy("start", "kind")  # two rows a split at most, heads first
        of = pieces.withColumn("no", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
        piece = F.struct("start", "kind", "text")
        joined = of.groupBy("path", "no").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.min_by("seq", F.struct("start", "kind")).alias("seq"))
        text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
        whole = whole.unionByName(joined.select(text.alias("text"), ((F.col("p")[0]["start"] == 0) & (F.col("seq") == 0)).alias("first")))
    # A record ends before a carriage return of its line end.
    return whole.withColumn("text", F.regexp_replace("text", r"\r\z", "")).where("text != ''")


def read_quoted_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Columns as text, named by the first file's header; every file's first record is its header."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep)
    schema = reader.csv(path).schema  # reads one record
    rows = csv_records(spark, path, sep).where("not first")
    parsed = F.from_csv("text", schema.toDDL(), {"escape": '"', "sep": sep, "multiLine": "true", "mode": "PERMISSIVE"})
    return rows.select(parsed.alias("r")).select("r.*")
