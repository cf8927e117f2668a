"""Readers with declared schemas, writers, and resuming from what is already written."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.text import is_blank
from clauseloom.sources.quoted_csv import read_quoted_csv
from clauseloom.sources.run_log import WARNING, log_runs

NLI_SCHEMA = (
    "nli_id string, source_id string, statute string, section_number string, split string, span_ids string, premise string, claim_id string, "
    "hypothesis string, gold_label string, error_type string"
)
NLI_REQUIRED, EVAL_REQUIRED = ("premise", "hypothesis", "gold_label"), ("source_text", "simple_text")


def _csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """A CSV with header, every column as text; quoted cells may hold line breaks and doubled quotes. A missing file or column is an error."""
    df = read_quoted_csv(spark, path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path}: missing columns {missing}")
    return df


def read_nli(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Labelled pairs as text columns, with the set's name; columns a file lacks are null."""
    df = _csv(spark, path, NLI_REQUIRED)
    names = [part.split()[0] for part in NLI_SCHEMA.split(",")]
    more = [c for c in df.columns if c not in names]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names], *more, F.lit(dataset).alias("dataset"))


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, EVAL_REQUIRED)


def _write(df: DataFrame, path: str, fmt: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode).partitionBy(*(by or []))
    (w.option("header", True).option("escape", '"') if fmt == "csv" else w).format(fmt).save(path)


def write_pages(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Pages as a table, or (fmt "text") as one text with page headers."""
    if fmt != "text":
        return _write(df, path, fmt)
    text = F.concat(F.lit("--- PAGE "), F.col("page").cast("string"), F.lit(" ---\n\n"), F.col("text"), F.lit("\n"))
    return df.repartitionByRange("doc_id", "page").sortWithinPartitions("doc_id", "page").select(text.alias("value")).write.text(path)


def write_candidates(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(df, path, fmt)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(df, path, fmt, ["dataset"])


def write_confusion(df: DataFrame, path: str, fmt: str = "csv") -> None:
    _write(df, path, fmt, ["dataset"])


def write_summary(df: DataFrame, path: str, fmt: str = "csv") -> None:
    _write(df, path, fmt)


def write_overlength(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The quarantine of pairs over the length limit."""
    _write(df, path, fmt)


def write_v2_splits(splits: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Each split under its name in a new folder; nothing that exists is touched."""
    for name, df in splits.items():
        _write(df, f"{path}/{name}", fmt)


def write_runs(df: DataFrame, path: str, key: str, ts: str = "ts") -> str:
    """Log a set of run records by date, once for each key; see `run_log`."""
    if ts not in df.columns:
        logging.getLogger(__name__).error("run records without %s were not written to %s", ts, path)
        return WARNING
    return log_runs(df.withColumn("run_date", F.to_date(ts)), path, key, ["run_date"])


def resume_missing(df: DataFrame, done: DataFrame, key: str, output: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows still to do, rows done with their outputs): done where an output isn't blank.

    Of a key's outputs the one with the highest `order` counts, without `order` the highest itself.
    """
    full = done.where(~is_blank(F.col(output))).groupBy(key).agg(F.max_by(output, F.col(order or output)).alias(output))
    return df.join(full, key, "left_anti"), df.join(full, key)


def fingerprint(df: DataFrame, columns: list[str]) -> Row:
    """One row that tells multisets of rows apart, in any order: count, and sum and xor of two 64-bit hashes of each row; tasks send one row each."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    parts = [f(h).alias(f"{n}{k}") for k, h in enumerate((one, two)) for n, f in (("sum", lambda h: F.sum(h.cast("decimal(20,0)"))), ("xor", F.bit_xor))]
    return df.agg(F.count(F.lit(1)).alias("n"), *parts).first()


def write_checkpoint(done: DataFrame, path: str, key: str) -> None:
    """Outputs so far, and beside them the fingerprint of their keys."""
    done.write.parquet(f"{path}/rows")
    mark = fingerprint(done.sparkSession.read.parquet(f"{path}/rows"), [key])
    done.sparkSession.createDataFrame([mark.asDict()], _MARK).coalesce(1).write.json(f"{path}/mark")


_MARK = "n long, sum0 decimal(38,0), xor0 long, sum1 decimal(38,0), xor1 long"


def checkpoint_fits(df: DataFrame, path: str, key: str) -> bool:
    """Whether a written checkpoint belongs to df: the same keys as often, in any order. The checkpoint's rows are not read."""
    mark = df.sparkSession.read.schema(_MARK).json(f"{path}/mark").first()
    return mark is not None and tuple(mark) == tuple(fingerprint(df, [key]))


def with_checkpoint(df: DataFrame, done: DataFrame, key: str) -> bool:
    """Whether rows done belong to df: the same keys as often, in any order, told by fingerprints without a shuffle of rows."""
    return tuple(fingerprint(df, [key])) == tuple(fingerprint(done, [key]))
