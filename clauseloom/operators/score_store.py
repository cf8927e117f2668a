"""Scores of pairs kept across runs: a run scores only pairs that no run before it has scored.

A pair is known by a 128-bit hash of its two texts, and a model by its name. Texts
travel once, to where new pairs are made distinct and scored; stored scores are
narrow rows, in folders by model and by the first two digits of the hash, and meet
the caller's rows by hash. Failed pairs are not stored, so that the next run tries
them again. New scores are appended by one job that commits as a whole, before the
caller gets its rows, one file a folder or few; a run that is repeated after it may
store a score twice, and readers take one.

Defined cases: a null text counts as itself, apart from an empty one; pairs without
evidence are given back as `batch_score` has them and are not stored; an empty
table gives an empty one; all of the caller's columns stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.operators.scoring import MakeScorer, batch_score, pair_hash
from clauseloom.plans.shared import written

STORED = "key string, l0 double, l1 double, l2 double"
LOGITS = ("l0", "l1", "l2")


def _model_path(store: str, model: str) -> str:
    return f"{store}/model=m{hashlib.md5(model.encode()).hexdigest()}"  # noqa: S324  a name, no secret


def stored_scores(spark: SparkSession, store: str, model: str) -> DataFrame:
    """key and logits of all pairs that the model has scored, one row a key."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_model_path(store, model))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STORED)
    read = spark.read.schema(STORED).parquet(_model_path(store, model))
    return read.groupBy("key").agg(*[F.max(x).alias(x) for x in LOGITS])


def score_with_store(df: DataFrame, make_scorer: MakeScorer, store: str, model: str, evidence: str = "evidence_text", claim: str = "claim_text", **how) -> DataFrame:
    """df with l0, l1, l2 and error, as `batch_score` gives them. df is read twice, for new pairs and for its rows: write a costly one first."""
    spark = df.sparkSession
    keyed = df.withColumn("_pair", pair_hash(evidence, claim))
    known = written(stored_scores(spark, store, model), "known")  # the table that this run reads, whatever is appended meanwhile
    # By all three columns: the first texts of a hash, as an aggregate, would have all rows sorted.
    new = keyed.select("_pair", evidence, claim).distinct().join(known.select(F.col("key").alias("_pair")), "_pair", "left_anti")
    scored = batch_score(new, make_scorer, evidence=evidence, claim=claim, **how).select(F.col("_pair").alias("key"), *LOGITS, "error")
    fresh = written(scored, "fresh")
    good = fresh.where("error is null and l0 is not null").drop("error")
    # Rows of a folder come to one task; else each task writes a file in each of 256 folders.
    dealt = good.withColumn("bucket", F.concat(F.lit("b"), F.substring("key", 1, 2))).repartition("bucket")
    dealt.write.mode("append").partitionBy("bucket").parquet(_model_path(store, model))
    every = known.withColumn("error", F.lit(None).cast("string")).unionByName(fresh)
    return keyed.join(every.withColumnRenamed("key", "_pair"), "_pair", "left").drop("_pair")
