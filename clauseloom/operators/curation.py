"""Validation, leakage removal and class balance of labelled pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.text import is_blank, nfc, pair_key, strip
from clauseloom.operators.prefilter import key_filter, may_match
from clauseloom.operators.scoring import LABELS
from clauseloom.plans.shared import written

# Columns every set must have, the longest input, weights against imbalance.
REQUIRED = ("premise", "hypothesis", "gold_label")
MAX_INPUT = 20_000
BOOST = {"contradiction": 1.5}


def each_label() -> Column:
    """The three labels as rows (gold_label_id, label), for every row it is selected with."""
    return F.inline(F.array(*[F.struct(F.lit(i).alias("gold_label_id"), F.lit(k).alias("label")) for i, k in enumerate(LABELS)]))


def validate_provisions(df: DataFrame, max_len: int = MAX_INPUT) -> tuple[DataFrame, DataFrame]:
    """(valid rows with composed text, rejected rows with a reason); length counts after composition."""
    composed = df.withColumn("text", nfc("text"))
    reason = F.when(is_blank(F.col("text")), "blank").when(F.length("text") > max_len, "too_long")
    marked = composed.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def gold_label_id(c: Column) -> Column:
    """0, 1 or 2 from a label's name or a whole number; null for anything else."""
    low = F.lower(strip(c.cast("string")))
    named = F.lit(None).cast("int")
    for i, k in enumerate(LABELS):
        named = F.when(low == k, i).otherwise(named)
    number = F.when(low.rlike(r"^[+-]?\d+(\.\d*)?$"), low.try_cast("double"))
    whole = F.when((number == F.floor(number)) & number.between(0, 2), number.cast("int"))
    return F.coalesce(named, whole)


def duplicate_ids(df: DataFrame, col: str = "nli_id", by: str | None = None) -> DataFrame:
    """Rows beyond the first of each id, null counting as a value; 0 where the column is absent."""
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(_repeats(df, col).alias("duplicate_ids"))


def validate_nli(df: DataFrame, by: str = "dataset") -> DataFrame:
    """One row per set: rows, blank sides, unusable labels, repeated ids, rows per label, and whether the set may be used."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.groupBy(by).agg(*_checks(df)).withColumn("usable", _usable())


def _repeats(df: DataFrame, col: str) -> Column:
    if col not in df.columns:
        return F.lit(0).cast("long")
    return (F.count(F.lit(1)) - F.countDistinct(col) - F.coalesce(F.max(F.col(col).isNull().cast("int")), F.lit(0))).cast("long")


def _checks(df: DataFrame) -> list[Column]:
    label = gold_label_id(F.col("gold_label"))
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(is_blank(F.col("premise"))).alias("blank_premise"),
        F.count_if(is_blank(F.col("hypothesis"))).alias("blank_hypothesis"),
        F.count_if(label.isNull()).alias("bad_labels"),
        _repeats(df, "nli_id").alias("duplicate_ids"),
        *[F.count_if(label == i).alias(f"n_{k}") for i, k in enumerate(LABELS)],
    ]


def _usable() -> Column:
    return (F.col("blank_premise") + F.col("blank_hypothesis") + F.col("bad_labels")) == 0


def validate_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """`validate_nli` of named sets that are tables of their own, one row each, empty ones too.

    A set without a required column has its rows counted, the columns named in
    `missing`, nulls for the checks, and isn't usable; the others are checked all the same.
    """
    counted = ["blank_premise", "blank_hypothesis", "bad_labels", "duplicate_ids", *(f"n_{k}" for k in LABELS)]
    rows = []
    for name, df in sets.items():
        missing = [x for x in REQUIRED if x not in df.columns]
        unseen = [F.count(F.lit(1)).alias("n_rows"), *[F.lit(None).cast("long").alias(x) for x in counted]]
        report = df.agg(*(unseen if missing else _checks(df)))
        named = F.array(*map(F.lit, missing)).cast("array<string>").alias("missing")
        rows.append(report.select(F.lit(name).alias("dataset"), named, "*", (F.lit(False) if missing else _usable()).alias("usable")))
    return reduce(DataFrame.unionByName, rows)


def offending_rows(df: DataFrame) -> DataFrame:
    """Rows that fail a check, with the checks they fail."""
    faults = F.array_compact(
        F.array(
            F.when(is_blank(F.col("premise")), "blank_premise"), F.when(is_blank(F.col("hypothesis")), "blank_hypothesis"), F.when(gold_label_id(F.col("gold_label")).isNull(), "bad_label")
        )
    )
    return df.withColumn("faults", faults).where(F.size("faults") > 0)


def _train_keys(train: DataFrame) -> DataFrame:
    return train.select(pair_key(F.col("premise"), F.col("hypothesis")).alias("_key")).distinct()


def _apart(eval_df: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that may leak with their key and its hash, rows that don't leak, train keys): most rows are told by a filter of train's keys and aren't shuffled."""
    t = written(_train_keys(train).select(F.xxhash64("_key").alias("_thash"), F.col("_key").alias("_tkey")), "train_keys")
    words = key_filter(t.select(F.col("_thash").alias("h")), t.count())
    e = eval_df.withColumn("_key", pair_key(F.col("premise"), F.col("hypothesis"))).withColumn("_hash", F.xxhash64("_key"))
    may = may_match(words, F.col("_hash"), eval_df.sparkSession)
    return e.where(may), e.where(~may).drop("_key", "_hash"), t


def _same(e: DataFrame, t: DataFrame) -> Column:
    """Keys meet by hash first, so the shuffle sorts numbers, and by the whole key then."""
    return (e["_hash"] == t["_thash"]) & (e["_key"] == t["_tkey"])


def with_leak(eval_df: DataFrame, train: DataFrame) -> DataFrame:
    """eval_df with leaked."""
    may, clean, t = _apart(eval_df, train)
    met = may.join(t, _same(may, t), "left").select(*eval_df.columns, F.col("_tkey").isNotNull().alias("leaked"))
    return met.unionByName(clean.withColumn("leaked", F.lit(False)))


def remove_leakage(eval_df: DataFrame, train: DataFrame) -> DataFrame:
    """Rows of eval_df whose normalised pair isn't in train; repeats inside eval_df stay."""
    may, clean, t = _apart(eval_df, train)
    return may.join(t, _same(may, t), "left_anti").drop("_key", "_hash").unionByName(clean)


def leaked_rows(eval_df: DataFrame, train: DataFrame) -> DataFrame:
    may, _, t = _apart(eval_df, train)
    return may.join(t, _same(may, t), "left_semi").drop("_key", "_hash")


def leakage_report(eval_df: DataFrame, train: DataFrame, split: str = "split") -> DataFrame:
    """Before, removed and kept by split, by split and label, and by split and error type, in one pass; check_leaks is what a second pass would find."""
    flagged = with_leak(eval_df, train).withColumn("label", F.col("gold_label")).withColumn("etype", F.coalesce("error_type", F.lit("(none)")))
    sets = flagged.groupingSets([[split], [split, "label"], [split, "etype"]], split, "label", "etype").agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if("leaked").alias("n_removed"), F.grouping("label").alias("_gl"), F.grouping("etype").alias("_ge")
    )
    return sets.select(
        split,
        F.when(F.col("_gl") == 0, "label").when(F.col("_ge") == 0, "error_type").otherwise("all").alias("level"),
        F.when(F.col("_gl") == 0, F.col("label")).when(F.col("_ge") == 0, F.col("etype")).alias("value"),
        "n_before",
        "n_removed",
        (F.col("n_before") - F.col("n_removed")).alias("n_kept"),
    )


def label_distribution(df: DataFrame, by: str = "dataset") -> DataFrame:
    """Rows per set and label, zeros included."""
    counts = df.groupBy(by, "gold_label_id").agg(F.count(F.lit(1)).alias("n"))
    frame = df.select(by).distinct().select(by, each_label())
    return frame.join(counts, [by, "gold_label_id"], "left").select(by, "gold_label_id", "label", F.coalesce("n", F.lit(0)).alias("n"))


def heldout_combined(internal: DataFrame, external: DataFrame) -> DataFrame:
    """Both sets, repeats kept."""
    return internal.unionByName(external, allowMissingColumns=True)


def class_weights(df: DataFrame, boost: dict[str, float] | None = None) -> DataFrame:
    """Per label, rows / (3 x its rows), an absent label counting one row, times its boost."""
    boost = BOOST if boost is None else boost
    n = df.agg(*[F.count_if(F.col("gold_label_id") == i).alias(k) for i, k in enumerate(LABELS)])  # one row
    counts = F.create_map(*[x for k in LABELS for x in (F.lit(k), F.col(k))])
    whole = n.select(counts.alias("_n"), sum((F.col(k) for k in LABELS[1:]), F.col(LABELS[0])).alias("total")).select("_n", "total", each_label())
    whole = whole.withColumn("n", F.col("_n")[F.col("label")])
    factor = F.lit(1.0)
    for k, v in boost.items():
        factor = F.when(F.col("label") == k, v).otherwise(factor)
    weight = F.col("total") / (len(LABELS) * F.greatest("n", F.lit(1))) * factor
    return whole.select("gold_label_id", "label", "n", weight.alias("weight"))
