"""Metrics of predictions: one pass for all models and sets, three labels each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.operators.scoring import LABELS


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows by set and gold label, a column per predicted label, zeros kept for labels without rows."""
    ids = F.explode(F.array(*[F.lit(i) for i in range(len(LABELS))]))
    counts = df.groupBy(*by, "gold_label_id").pivot("pred_label_id", list(range(len(LABELS)))).count()
    frame = df.select(*by).distinct().withColumn("gold_label_id", ids)
    filled = frame.join(counts, [*by, "gold_label_id"], "left")
    return filled.select(*by, "gold_label_id", *[F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias(f"pred_{k}") for i, k in enumerate(LABELS)])


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """accuracy, precision, recall, F1 and support of each label, macro and weighted F1, rounded to six places; 0 for 0/0."""
    sums = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("gold_label_id") == F.col("pred_label_id")).alias("hits")]
    for i, k in enumerate(LABELS):
        gold, pred = F.col("gold_label_id") == i, F.col("pred_label_id") == i
        sums += [F.count_if(gold & pred).alias(f"tp_{k}"), F.count_if(gold).alias(f"support_{k}"), F.count_if(pred).alias(f"said_{k}")]
    m = df.groupBy(*by).agg(*sums)
    for k in LABELS:
        m = m.withColumn(f"precision_{k}", _share(F.col(f"tp_{k}"), F.col(f"said_{k}"))).withColumn(f"recall_{k}", _share(F.col(f"tp_{k}"), F.col(f"support_{k}")))
        p, r = F.col(f"precision_{k}"), F.col(f"recall_{k}")
        m = m.withColumn(f"f1_{k}", _share(2 * p * r, p + r))
    f1 = [F.col(f"f1_{k}") for k in LABELS]
    weighted = sum((F.col(f"f1_{k}") * F.col(f"support_{k}") for k in LABELS), F.lit(0.0))
    out = [
        (F.col("hits") / F.col("n_rows")).alias("accuracy"), ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"), (weighted / F.col("n_rows")).alias("weighted_f1"),
        *[F.col(f"{x}_{k}") for k in LABELS for x in ("precision", "recall", "f1")],
    ]
    named = m.select(*by, "n_rows", *out, *[f"support_{k}" for k in LABELS])
    keep = {*by, "n_rows", *(f"support_{k}" for k in LABELS)}
    return named.select(*[F.col(c) if c in keep else F.bround(c, 6).alias(c) for c in named.columns])


def incorrect_predictions(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Wrong rows in fixed columns of fixed widths."""
    wrong = df.where("gold_label_id != pred_label_id")
    return wrong.select(*[F.rpad(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, w), w, " ").alias(c) for c, w in widths.items()])


def errors_by_type(df: DataFrame) -> DataFrame:
    """Wrong rows per gold label and error type with subtotals per label and a total; levels tell a subtotal from a null."""
    wrong = df.where("gold_label_id != pred_label_id").withColumn("error_type", F.coalesce("error_type", F.lit("(none)")))
    return wrong.rollup("gold_label_id", "error_type").agg(F.count(F.lit(1)).alias("n_errors"), F.grouping_id().cast("int").alias("level"))


def leaderboard(m: DataFrame, by: str = "model") -> DataFrame:
    """Models ranked by F1 on contradictions, then its recall, then macro-F1; one row per model."""
    order = [F.col("f1_contradiction").desc(), F.col("recall_contradiction").desc(), F.col("macro_f1").desc(), F.col(by)]
    return m.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), by, "f1_contradiction", "recall_contradiction", "macro_f1")


def run_deltas(m: DataFrame, attempt: str, values: list[str], by: list[str]) -> DataFrame:
    """Each attempt's values against the one before it, and the direction."""
    w = Window.partitionBy(*by).orderBy(attempt)
    long = m.select(*by, attempt, F.inline(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("value")) for v in values])))
    w = Window.partitionBy(*by, "metric").orderBy(attempt)
    d = long.withColumn("previous", F.lag("value").over(w)).where("previous is not null").withColumn("delta", F.col("value") - F.col("previous"))
    return d.withColumn("direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("same"))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """The epoch of each run with the highest macro-F1, the earliest step of equals; epoch_num counts log rows from 1."""
    log, best = Window.partitionBy("run").orderBy("step"), Window.partitionBy("run").orderBy(F.col("eval_macro_f1").desc(), "step")
    return epochs.withColumn("epoch_num", F.row_number().over(log)).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
