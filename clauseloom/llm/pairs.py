"""Exact links inside candidate groups of any size, without a row per pair.

A group is cut into blocks of bounded size by a hash of its members; each pair of
blocks is one unit of work that meets in one place, compares its members in
memory and gives back one count per member and the edges of a spanning forest.
A group's work so spreads over (blocks squared) units, a unit's memory is bounded,
and the rows that leave it are as many as its members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import small

#: compare(group, a, b) of two lists of payloads gives a boolean matrix of links.
Compare = Callable[[object, list, list], np.ndarray]
#: Groups are cut into at least so many blocks as soon as these hold FEW members each, so that a large group is never two tasks' work; callers may give another number than FEW.
LEAST_BLOCKS, FEW = 8, 32


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, row or column + rows) that keep everything connected that `links` connects, one less than its nodes."""
    n, m = links.shape
    none = n + m
    row, col = np.arange(n), np.full(m, none)
    while True:
        col = np.minimum(col, np.where(links, row[:, None], none).min(axis=0, initial=none))
        new = np.minimum(row, np.where(links, col[None, :], none).min(axis=1, initial=none))
        if (new == row).all():
            break
        row = new
    child = np.flatnonzero(row != np.arange(n))
    return [*zip(row[child].tolist(), child.tolist(), strict=True), *((int(col[j]), n + j) for j in np.flatnonzero(col < none).tolist())]


def units(batches: Iterator[pa.RecordBatch], same: Callable[[tuple], tuple]) -> Iterator[tuple[tuple, list, list, bool]]:
    """(key, left rows, right rows, whether both are one block) of each unit of sorted batches; rows (grp, i, j, right, node, ...) by node once."""
    rows = (r for b in small(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, part in groupby(rows, key=lambda r: r[:3]):
        once = {same(r): r for r in part}.values()
        left = [r for r in once if not r[3]]
        one = key[1] == key[2]
        yield key, left, left if one else [r for r in once if r[3]], one


def by_node(row: tuple) -> tuple:
    return row[3:5]


def blocks(n: Column, weight: Column, per_block: int, block_weight: int, few: int = FEW) -> Column:
    """Into how many blocks a group of n members is cut: `per_block` members or `block_weight` of weight each on average.

    A member moves once for each block, so where payloads are large `few` is better no less than `per_block`.
    """
    few = F.least(F.lit(LEAST_BLOCKS), F.ceil(n / few))
    return F.greatest(F.ceil(n / per_block), F.ceil(weight / block_weight), few, F.lit(1)).cast("long")


def spread(members: DataFrame, grp: str, nb: str, cols: list[str]) -> DataFrame:
    """Each member once for every unit of its block: grp, i, j, right, node and cols. Units are sorted inside partitions dealt by unit."""
    cut = members.withColumn("_blk", F.pmod(F.xxhash64("node"), F.col(nb)))
    out = cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(nb) - 1)))
    return out.select(F.col(grp).alias("grp"), F.least("_blk", "_other").alias("i"), F.greatest("_blk", "_other").alias("j"), (F.col("_blk") > F.col("_other")).alias("right"), "node", *cols)


def dealt(work: DataFrame) -> DataFrame:
    n = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")


def link_units(work: DataFrame, compare: Compare) -> DataFrame:
    """work: grp, i, j, right, node, copies, payload -> kind, node, other, value.

    kind 'n': value more linked rows (copies counted) for node; kind 'e': an edge
    (node, other) of the links' forest.
    """
    kind = work.schema["node"].dataType.simpleString()

    def run(batches):
        node_type = pa.binary() if kind == "binary" else pa.int64()
        for key, left, right, one in units(batches, by_node):
            if not left or not right or (one and len(left) < 2):
                continue
            links = compare(key[0], [r[6] for r in left], [r[6] for r in right])
            if one:
                np.fill_diagonal(links, False)
            if not links.any():
                continue
            names = [r[4] for r in left] + [r[4] for r in right]
            out = list(zip(names, (links @ np.array([r[5] for r in right])).tolist(), strict=False))
            if not one:
                out += zip(names[len(left) :], (np.array([r[5] for r in left]) @ links).tolist(), strict=True)
            out = [(x, c) for x, c in out if c]
            edges = [(names[a], names[b]) for a, b in forest(links) if names[a] != names[b]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["n"] * len(out) + ["e"] * len(edges)), pa.array([x for x, _ in out] + [a for a, _ in edges], node_type),
                    pa.array([None] * len(out) + [b for _, b in edges], node_type), pa.array([c for _, c in out] + [None] * len(edges), pa.int64()),
                ],
                ["kind", "node", "other", "value"],
            )

    return dealt(work).mapInArrow(run, f"kind string, node {kind}, other {kind}, value long")


def link_groups(members: DataFrame, compare: Compare, per_block: int, block_weight: int) -> DataFrame:
    """members: grp, node, copies, weight, payload -> links of all pairs in each group, as `link_units` gives them."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"), F.sum("weight").alias("_w"))
    cut = members.join(sizes, "grp").withColumn("_nb", blocks(F.col("_n"), F.col("_w"), per_block, block_weight))
    return link_units(spread(cut, "grp", "_nb", ["copies", "payload"]), compare)
