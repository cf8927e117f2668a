"""Provisions and claims that arrive as files, verified micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseloom.operators.claims import extraction_warnings
from clauseloom.operators.linking import link_claims
from clauseloom.operators.spans import evidence_units, explode_spans, spans_with_fallback

#: A provision arrives with its claims, so that linking needs nothing outside its micro-batch.
INPUT = "provision_id string, act_name string, text string, simplified_text string, claims array<struct<claim_id:string,claim_text:string>>"


def verify(provisions: DataFrame) -> DataFrame:
    """Linked claims with extraction warnings of provisions that carry their claims."""
    spans = spans_with_fallback(provisions)
    units = evidence_units(explode_spans(spans))
    claims = provisions.select("provision_id", "simplified_text", F.inline("claims")).withColumn(
        "extraction_warnings", extraction_warnings(F.col("claim_text"), F.col("simplified_text"))
    )
    return link_claims(claims.drop("simplified_text"), units, provisions)


def stream_verify(spark: SparkSession, source: str, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append verified claims of new files under `source` to `sink`; the checkpoint says what is done.

    A micro-batch that is run again after a failure replaces its own part of the
    sink, so that every provision is logged once.
    """
    stream = spark.readStream.schema(INPUT).json(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # read for spans, claims and sources
        try:
            verify(held).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
