"""Shared helpers: tables written to the cluster's folder, components, prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.plans.shared import fresh_path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """name, with as many underscores behind it as no column's name needs."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of two longs that a join may hold on every executor; more are shuffled.
FEW_ROWS = 500_000


def bounded(keys: DataFrame) -> DataFrame:
    """Narrow keys (a written table) for a join: broadcast up to FEW_ROWS counted rows, else shuffled and hashed."""
    return F.broadcast(keys) if keys.limit(FEW_ROWS + 1).count() <= FEW_ROWS else keys.hint("shuffle_hash")


def small(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most `rows` rows and `size` bytes (a larger row alone), so that few texts are Python objects at a time."""
    for b in batches:
        todo = [b.slice(at, rows) for at in range(b.num_rows - 1 - (b.num_rows - 1) % rows, -1, -rows)]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node.

    Alternates large-star and small-star rounds. Each round is a group-by on
    the node and a join back. Hubs are reduced by map-side minimums, and the
    minimums are tables of their own, so that the join back of a hub is one
    whose large side can be split. Nodes without an
    edge to another node do not appear. Null ends are ignored.
    """
    now = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "lowest")
        large = settle(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        low2 = settle(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = (
            large.join(low2, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low2.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = settle(small, "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def running_total(
    rows: DataFrame, group: list[str], value: str, ties: list, n_rows: int, out: str, per: int = 256, fan: int = 4096
) -> DataFrame:
    """Exclusive prefix sum `out` of `value` inside each group, in an order fixed by the rows' own values.

    A group may hold most rows, so none is ordered in one task: rows fall into
    hashed buckets of about `per` rows of the whole table, each bucket is summed
    in a window of its own, and the buckets' totals are summed level by level,
    `fan` at a time.
    """
    buckets = max(1, n_rows // per)
    keyed = rows.withColumn("_b", F.pmod(F.xxhash64(*ties), F.lit(buckets)))
    inside = Window.partitionBy(*group, "_b").orderBy(*ties).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    offsets = _offsets(keyed.groupBy(*group, "_b").agg(F.sum(value).alias("_s")), group, buckets, fan)
    on = [local[g].eqNullSafe(offsets[g]) for g in group] + [local["_b"] == offsets["_b"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return local.join(offsets, cond).select(*[local[c] for c in rows.columns], (local["_in"] + offsets["_o"]).alias(out))


def _offsets(sums: DataFrame, group: list[str], buckets: int, fan: int) -> DataFrame:
    """(group, _b, _o): the sum over all earlier buckets of the group."""
    before = lambda *extra: Window.partitionBy(*group, *extra).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    if buckets <= fan:
        return sums.select(*group, "_b", F.coalesce(F.sum("_s").over(before()), F.lit(0)).alias("_o"))
    up = sums.withColumn("_p", F.floor(F.col("_b") / fan))
    local = up.withColumn("_i", F.coalesce(F.sum("_s").over(before("_p")), F.lit(0)))
    above = _offsets(
        up.groupBy(*group, F.col("_p").alias("_b")).agg(F.sum("_s").alias("_s")), group, -(-buckets // fan), fan
    ).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_pb"), F.col("_o").alias("_po"))
    cond = local["_p"] == above["_pb"]
    for i, g in enumerate(group):
        cond = cond & local[g].eqNullSafe(above[f"_g{i}"])
    return local.join(above, cond).select(*group, "_b", (F.col("_i") + F.col("_po")).alias("_o"))
