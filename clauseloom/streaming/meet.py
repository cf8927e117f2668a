"""Claims and provisions that arrive apart, in any order, and meet in a kept table.

What is kept is one table a batch: a row for each provision that came, and one for
each claim, with whether it waits. A batch is joined to the table of the batch
before by one shuffle on the provision and windows that all begin with it, in
built-in functions; the table it writes is what it keeps and tells, too.

A claim that arrives after its provision leaves at once; one that arrives before it
waits. A claim whose provision doesn't come within `wait` leaves without one, and a
provision that no claim names within `wait` leaves by itself; both leave with the
first batch behind that time. Time is the processing time of a batch, so no row is
late and none is dropped: a provision that comes after its claims have left is kept
for claims to come, and a claim that comes after `keep` waits anew. Each claim id of
a provision leaves once while it is kept: what arrives again is passed over.

A batch passes over all that is kept, so it costs as much with few new rows as with
many; a stream that goes on has one batch each `every` seconds, with new files or
without. A provision with very many claims is sorted and spilled, not held. Defined
cases: rows without an id of their provision meet under one key like any other; a
provision that arrives again keeps its first text, and is kept longer; a null claim
text is a claim, and a null claim id the same as an empty one.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseloom.operators.linking import link_claims
from clauseloom.operators.spans import evidence_units, explode_spans, spans_with_fallback

PROVISIONS, CLAIMS = "provision_id string, text string", "provision_id string, claim_id string, claim_text string"
MATCHED, NO_PROVISION, NO_CLAIMS = "matched", "no_provision", "no_claims"
STORE = "spark.sql.streaming.stateStore.providerClass"  # nothing here needs it; it stays as the caller has it
#: Kinds p and c. at: when a row came; touched: when its provision's key last had a row; waits: a claim without a provision so far; settled: a provision
#: that had a claim or was told without; met: what a row leaves as in this batch, which is matched, too, for a provision whose claims leave.
KEPT = "provision_id string, kind string, claim_id string, body string, at long, touched long, waits boolean, settled boolean, met string"
EVERY = 60.0


def meet_batch(kept: DataFrame, rows: DataFrame, now: int, wait_ms: int, keep_ms: int) -> DataFrame:
    """KEPT rows behind a batch of rows (provision_id, kind, claim_id, body) at the time `now`, in milliseconds; kept: those behind the batch before."""
    c, claim = F.col, F.col("kind") == "c"
    fresh = F.when(claim, c("at")).otherwise(c("touched")) + keep_ms > now
    old = kept.withColumn("fresh", fresh).where(c("fresh") | c("waits")).withColumn("body", F.when(~claim | c("waits"), c("body"))).drop("met")
    new = rows.select(
        "provision_id", "kind", "claim_id", "body", F.lit(now).alias("at"), F.lit(now).alias("touched"), claim.alias("waits"), F.lit(False).alias("settled"), F.lit(True).alias("fresh"),
        F.monotonically_increasing_id().alias("nth"),
    )
    every = old.withColumn("nth", F.lit(-1).cast("long")).unionByName(new).repartition("provision_id")
    key = Window.partitionBy("provision_id")
    same = Window.partitionBy("provision_id", "kind", F.coalesce("claim_id", F.lit("")), "fresh").orderBy("nth")
    first = every.select("*", F.bool_or(c("nth") >= 0).over(key).alias("_new"), F.row_number().over(same).alias("_nth")).where((c("_nth") == 1) | ~c("fresh"))
    met = first.select("*", F.bool_or(~claim).over(key).alias("_known"), F.bool_or("waits").over(key).alias("_asked"))
    due, asked = c("at") + wait_ms <= now, c("_asked") & c("_known")
    says = (
        F.when(claim & c("waits"), F.when(c("_known"), MATCHED).when(due, NO_PROVISION))
        .when(~claim & asked, MATCHED)
        .when(~claim & ~c("settled") & due, NO_CLAIMS)
    )
    return met.withColumn("met", says).select(
        "provision_id", "kind", "claim_id", "body", "at", F.when(c("_new"), now).otherwise(c("touched")).alias("touched"), (c("waits") & c("met").isNull()).alias("waits"),
        (c("settled") | (~claim & c("met").isNotNull())).alias("settled"), "met",
    )


def verify_met(met: DataFrame) -> DataFrame:
    """KEPT rows that leave -> with the evidence of matched claims: provision_id, claim_id, claim_text, evidence columns, met."""
    claims = lambda says: met.where((F.col("kind") == "c") & says).select("provision_id", "claim_id", F.col("body").alias("claim_text"), "met")
    matched = F.col("met") == MATCHED
    provisions = met.where((F.col("kind") == "p") & matched).select("provision_id", F.col("body").alias("text"))
    units = evidence_units(explode_spans(spans_with_fallback(provisions)))
    linked = link_claims(claims(matched).drop("met"), units, provisions).withColumn("met", F.lit(MATCHED))
    alone = met.where(F.col("met") == NO_CLAIMS).select("provision_id", F.lit(None).cast("string").alias("claim_id"), F.lit(None).cast("string").alias("claim_text"), "met")
    return linked.unionByName(claims(F.col("met") == NO_PROVISION).unionByName(alone), allowMissingColumns=True)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stream_meet(
    spark: SparkSession, provisions: str, claims: str, sink: str, checkpoint: str, wait: float = 3600.0, keep: float = 7 * 86400.0, available_now: bool = True, every: float = EVERY
) -> StreamingQuery:
    """Append verified claims, of files of provisions and of claims under two folders, to `sink`; `wait`, `keep` and `every` in seconds.

    What is kept stands in the checkpoint's folder, for the last batch and the one
    before. A batch that is run again after a failure reads the one before and
    replaces its own part of both the table and the sink, so each record is there
    once. What is due leaves with the next batch, which a clock's rows bring where no
    file does; a run over what is available may have none.
    """
    p = spark.readStream.schema(PROVISIONS).json(provisions).select("provision_id", F.lit("p").alias("kind"), F.lit(None).cast("string").alias("claim_id"), F.col("text").alias("body"))
    c = spark.readStream.schema(CLAIMS).json(claims).select("provision_id", F.lit("c").alias("kind"), "claim_id", F.col("claim_text").alias("body"))
    none = F.lit(None).cast("string")
    ticks = spark.readStream.format("rate").option("numPartitions", 1).load().where("value < 0").select(none.alias("provision_id"), none.alias("kind"), none.alias("claim_id"), none.alias("body"))

    def write(batch: DataFrame, batch_id: int) -> None:
        at = lambda k: f"{checkpoint}/kept/batch={k}"
        own = batch.sparkSession
        before = own.read.schema(KEPT).parquet(at(batch_id - 1)) if batch_id else own.createDataFrame([], KEPT)
        meet_batch(before, batch, time.time_ns() // 1_000_000, int(wait * 1000), int(keep * 1000)).write.mode("overwrite").parquet(at(batch_id))
        left = spark.read.schema(KEPT).parquet(at(batch_id)).where("met is not null")  # in the caller's session, whose plans adapt
        verify_met(left).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        if batch_id > 1:
            _delete(spark, at(batch_id - 2))

    writer = p.unionByName(c).unionByName(ticks).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{every} seconds")).start()
