"""Exact dedup by content-defined chunk recipes.

Every text is normalised (each run of space, tab, line feed, vertical tab, form
feed or carriage return becomes one space), cut at content-defined boundaries
and described by the ordered list of its chunks' 128-bit hashes, its recipe. Two
texts with different recipes differ, so only texts whose recipe repeats are
looked at again: their chunks are compared byte by byte under each hash, and a
hash that names more than one chunk gets an ordinal per chunk. Texts are equal
when their ordered lists of such verified identifiers are. A text thus moves at
most once, and only its narrow recipe is grouped and joined.

Defined cases: a null text counts as empty; empty texts are equal to each other;
a null id is never the one that stays unless all ids of its group are null;
rows that repeat both id and text are all marked kept, and `deduplicate` returns
one of them; an empty table gives an empty result; other columns are ignored by
`dedup_report`, whatever their names, and pass through `deduplicate`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import bounded, settle, small, unused

_UNEVEN = re.compile(r"[ \t-\r]{2,}|[\t-\r]")
_GEAR = np.random.default_rng(20240611).integers(0, 2**32, 256, dtype=np.uint32)
#: Bytes: no cut before MIN or after MAX of a chunk, one in AVG positions is a candidate.
MIN_CHUNK, AVG_CHUNK, MAX_CHUNK = 512, 2048, 65536
HASH_BYTES = 16
#: Rows of a common chunk meet in so many places first.
SALTS = 16


def normalise(text: str | None) -> bytes:
    return _UNEVEN.sub(" ", text or "").encode("utf-8", "surrogatepass")


def chunks(data: bytes) -> list[bytes]:
    """Cut where a hash of the last 16 bytes has its low bits clear, so that equal content is cut alike."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [data] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    found = np.flatnonzero((h & np.uint32(AVG_CHUNK - 1)) == 0) + 1
    out, at = [], 0
    for cut in [*found.tolist(), n]:
        while cut - at > MAX_CHUNK:
            out.append(data[at : at + MAX_CHUNK])
            at += MAX_CHUNK
        if cut - at >= MIN_CHUNK or (cut == n and cut > at):
            out.append(data[at:cut])
            at = cut
    return out


def _hash(chunk: bytes, size: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:size]


def _recipes(size: int):
    def run(batches):
        for b in small(batches):
            sha, recipe = [], []
            for text in b.column(1).to_pylist():
                data = normalise(text)
                sha.append(hashlib.sha256(data).hexdigest())
                recipe.append(b"".join(_hash(c, size) for c in chunks(data)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sha), pa.array(recipe, pa.binary())], ["id", "tie", "sha", "recipe"])

    return run


def _chunk_rows(size: int):
    """Distinct (hash, chunk) of each batch."""

    def run(batches):
        for b in small(batches):
            seen = {(_hash(c, size), c) for text in b.column(1).to_pylist() for c in chunks(normalise(text))}
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in seen], pa.binary()), pa.array([c for _, c in seen], pa.binary())], ["hash", "chunk"]
            )

    return run


def _listed_chunks(size: int):
    def run(batches):
        for b in small(batches):
            rows = [
                (i, hashlib.sha256(data).hexdigest(), at, _hash(c, size), c)
                for i, text in enumerate(b.column(1).to_pylist())
                for data in [normalise(text)]
                for at, c in enumerate(chunks(data))
            ]
            kinds = [None, pa.string(), pa.int32(), pa.binary(), pa.binary()]
            made = [pa.array([r[k] for r in rows], kinds[k]) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *made], ["id", "sha", "at", "hash", "chunk"])

    return run


def _decided(docs: DataFrame, id_col: str, text_col: str, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """One row per input row: id, tie (a hash of the raw text), keep_id, group_size, kept, text_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tied = narrow.select("id", "text", F.xxhash64("text").alias("tie"))
    rows = settle(tied.mapInArrow(_recipes(hash_bytes), f"id {kind}, tie long, sha string, recipe binary"), "recipes")

    repeated = settle(
        rows.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "repeated"
    )
    again = settle(rows.join(repeated.where("length(recipe) > 0").select("recipe"), "recipe", "left_semi").select("id").distinct(), "again")
    texts = narrow.join(bounded(again), narrow["id"].eqNullSafe(again["id"]), "left_semi")
    # A common chunk comes once from every task, so what meets is first halved and halved again by the tasks' numbers.
    seen = texts.mapInArrow(_chunk_rows(hash_bytes), "hash binary, chunk binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = seen.groupBy("hash", "salt").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    clash = settle(part.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("hash"), "clashes")
    rows, groups = rows.withColumn("key", F.col("recipe")), repeated.withColumnRenamed("recipe", "key")
    if not clash.isEmpty():  # one hash names several chunks: list the chunks of those texts by (hash, ordinal)
        listed = texts.mapInArrow(_listed_chunks(hash_bytes), f"id {kind}, sha string, at int, hash binary, chunk binary")
        listed = listed.dropDuplicates(["id", "sha", "at"])
        named = (
            listed.join(clash, "hash", "left_semi")
            .select("hash", "chunk")
            .distinct()
            .withColumn("no", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))
        )
        verified = (
            listed.join(named, ["hash", "chunk"], "left")
            .groupBy("id", "sha")
            .agg(F.sort_array(F.collect_list(F.struct("at", "hash", "no"))).alias("l"))
            .select("id", "sha", F.to_json("l").cast("binary").alias("verified"))
        )
        rows = (
            rows.alias("r")
            .join(verified.alias("v"), F.expr("r.id <=> v.id and r.sha = v.sha"), "left")
            .selectExpr("r.id", "r.tie", "r.sha", "coalesce(v.verified, r.recipe) as key")
        )
        groups = settle(rows.groupBy("key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    # Groups are a table by now, so that a join with a hot group is one whose large side can be split.
    met = rows.join(groups, "key", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return met.select(
        "id", "tie", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256")
    )


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = HASH_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. `hash_bytes` under 16 is for tests of collisions."""
    return _decided(docs, id_col, text_col, hash_bytes).drop("tie").withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns.

    Rows are decided by (id, hash of the raw text) on narrow rows; texts are passed
    once, and move only where the dropped rows are too many to be sent to them.
    """
    all_rows = settle(_decided(docs, id_col, text_col), "decided")
    stay = all_rows.where("kept").groupBy("id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("tie").alias("low"))
    more = settle(stay.where("n > 1").drop("n"), "more")  # rows that repeat an id with an equal text
    gone = all_rows.where("not kept").select("id", "tie")
    tie = F.xxhash64(docs[text_col].cast("string"))
    some = not more.isEmpty()
    if some:
        again = all_rows.where("kept").alias("r").join(more.alias("m"), F.expr("r.id <=> m.id and r.text_sha256 = m.text_sha256")).selectExpr("r.id", "r.tie", "r.tie = m.low as first")
        gone = gone.unionByName(again.where("not first").select("id", "tie"))
    gone = settle(gone.distinct().toDF("_gone_id", "_gone_tie"), "gone")
    left = docs.join(bounded(gone), docs[id_col].eqNullSafe(gone["_gone_id"]) & (tie == gone["_gone_tie"]), "left_anti")
    if not some:
        return left
    twice = settle(again.where("first").groupBy("id", "tie").count().where("count > 1").select(F.col("id").alias("_gone_id"), F.col("tie").alias("_gone_tie")), "twice")
    met = left[id_col].eqNullSafe(twice["_gone_id"]) & (tie == twice["_gone_tie"])
    name = unused(docs.columns, "_tie")
    once = left.join(bounded(twice), met, "left_semi").withColumn(name, F.xxhash64(F.col(text_col).cast("string"))).dropDuplicates([id_col, name]).drop(name)
    return left.join(bounded(twice), met, "left_anti").unionByName(once)
