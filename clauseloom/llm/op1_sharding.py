"""Sharding by extendible hashing, in DataFrame functions only.

A directory is indexed by the leading bits of a hash of each row's key. A bucket
over the byte limit splits on its next bit, all others stay as they are, so
depths differ and shards follow the data. Bytes are first summed per prefix of
`depth` bits (partial sums before the shuffle); a bucket of the directory is the
shortest prefix whose rows fit. Where prefixes of that depth are still too large,
only their rows are hashed deeper, 8 bits a round, to the end of the hash.

Defined cases: a row larger than the limit gets a shard of its own (`alone`);
rows with equal keys share all bits, so a bucket that no bit can split becomes a
chain of pages, each within the limit, filled by prefix sums over hashed parts of
the chain; a null key hashes as a marker of its own; a null text has 0 bytes; an
empty table has no shard. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import running_total, settle

#: The directory has a row a shard and is a table, so any size will do.
SHARD_BYTES = 128 * 1024 * 1024
HASH_BITS = 60
_FIRST, _STEP = 4, 8


def _prefix(bits) -> F.Column:
    """The leading `bits` (a column or number) of the hash `h`, as a number."""
    return F.expr(f"shiftright(h, {HASH_BITS} - {bits})") if isinstance(bits, str) else F.shiftright("h", HASH_BITS - bits)


def shard_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, hash_bits: int = HASH_BITS
) -> DataFrame:
    """One row per input row: id, n_bytes, shard (text), depth, prefix, page, shard_bytes, alone.

    `shard` is the bucket's bits ('root' for none), with '+page' where a chain
    has pages and '!' and a hash for a row of its own. `hash_bits` below 60 is
    for tests of chains.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000null"))
    text = F.col(text_col).cast("string")
    rows = settle(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
            F.shiftleft(F.shiftright(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), HASH_BITS - hash_bits), HASH_BITS - hash_bits).alias("h"),
            F.xxhash64(text).alias("tie"),
        ),
        "sized",
    )
    small = rows.where(F.col("n_bytes") <= shard_bytes)
    n_rows, total = small.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    depth = min(hash_bits, max(0, math.ceil(math.log2(max(1, (total or 0) / shard_bytes)))) + _FIRST)
    buckets, rounds, low = None, [], 0
    todo = small
    while True:
        cells = settle(todo.groupBy(_prefix(depth).alias("p")).agg(F.sum("n_bytes").alias("b")), "cells")
        by_depth = (
            cells.select(F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth"), "p", "b")
            .groupBy("depth", F.expr(f"shiftright(p, {depth} - depth)").alias("prefix"))
            .agg(F.sum("b").alias("bucket_bytes"))
        )
        fits = (F.col("bucket_bytes") <= shard_bytes) | (F.col("depth") == hash_bits)
        up = by_depth.where(f"bucket_bytes > {shard_bytes}").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        leaf = by_depth.where(fits).withColumn("parent", F.shiftright("prefix", 1))
        whole = leaf.where("depth = 0") if low == 0 else leaf.limit(0)
        found = whole.select("depth", "prefix", "bucket_bytes").unionByName(
            leaf.join(up, ["depth", "parent"], "left_semi").select("depth", "prefix", "bucket_bytes")
        )
        found = settle(found.withColumn("cell_depth", F.lit(depth)), "buckets")
        buckets = found if buckets is None else buckets.unionByName(found)
        rounds.append(depth)
        over = cells.where(f"b > {shard_bytes}").select("p")
        if depth >= hash_bits or over.isEmpty():
            break
        todo = todo.join(over, _prefix(depth) == over["p"], "left_semi")
        low, depth = depth, min(hash_bits, depth + _STEP)
    # Each bucket names the cells of its own round, so that rows meet it by one equality.
    placed = None
    for at in rounds:
        mine = buckets.where(F.col("cell_depth") == at).withColumn(
            "p", F.explode(F.expr(f"sequence(shiftleft(prefix, {at} - depth), shiftleft(prefix + 1, {at} - depth) - 1)"))
        )
        got = small.withColumn("p", _prefix(at)).join(mine.drop("cell_depth"), "p").drop("p")
        placed = got if placed is None else placed.unionByName(got)
    chained = buckets.where(F.col("bucket_bytes") > shard_bytes)
    bits = F.when(F.col("depth") == 0, F.lit("root")).otherwise(F.lpad(F.bin("prefix"), F.col("depth").cast("int"), "0"))
    plain = placed.where(F.col("bucket_bytes") <= shard_bytes).select(
        "id", "n_bytes", bits.alias("shard"), "depth", "prefix", F.lit(0).cast("long").alias("page"), F.col("bucket_bytes").alias("shard_bytes"), F.lit(False).alias("alone")
    )
    if not chained.isEmpty():
        plain = plain.unionByName(_paged(placed.where(F.col("bucket_bytes") > shard_bytes), bits, shard_bytes, n_rows))
    alone = rows.where(F.col("n_bytes") > shard_bytes).select(
        "id", "n_bytes", F.concat(F.lit("!"), F.hex("h"), F.lit("-"), F.hex("tie")).alias("shard"), F.lit(HASH_BITS).alias("depth"),
        F.col("h").alias("prefix"), F.lit(0).cast("long").alias("page"), F.col("n_bytes").alias("shard_bytes"), F.lit(True).alias("alone"),
    )
    return plain.unionByName(alone).withColumnRenamed("id", id_col)


def _paged(chain: DataFrame, bits, shard_bytes: int, n_rows: int) -> DataFrame:
    """Pages of buckets whose rows all share their bits: halves of the limit by running bytes, large rows one to a page."""
    half = shard_bytes // 2
    rows = settle(chain, "chains").withColumn("w", F.when(F.col("n_bytes") > half, half).otherwise(F.col("n_bytes")).cast("long"))
    run = running_total(rows.withColumn("big", F.col("n_bytes") > half), ["depth", "prefix", "big"], "w", [F.col("tie"), F.col("id"), F.col("n_bytes")], n_rows, "start")
    paged = run.withColumn("page", F.when(F.col("big"), -1 - F.floor(F.col("start") / max(1, half))).otherwise(F.floor(F.col("start") / max(1, half))).cast("long"))
    sizes = paged.groupBy("depth", "prefix", "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    return paged.join(sizes, ["depth", "prefix", "page"]).select(
        "id", "n_bytes", F.concat(bits, F.lit("+"), F.col("page")).alias("shard"), "depth", "prefix", "page", "shard_bytes", F.lit(False).alias("alone")
    )
