"""Hard negatives of embeddings by vertical scans with shrinking candidate sets.

Vectors become integers. An anchor meets rows in blocks that are stored by
dimension. A block's dimensions are read in the order of the anchor's magnitudes,
largest first; what the unread dimensions can still add at least and at most
follows from each dimension's smallest and largest value in the block. Rows that
can no longer be among the best, or can no longer end inside a window of scores,
leave the candidate bitmap; those that stay until the last dimension have exact
scores. A first scan over rows of the anchor's label finds its positives, a second
one over rows of other labels finds the negatives inside each positive's window.

Anchors are cut into blocks like rows, and each pair of an anchor block and a row
block is a unit of work of its own, whose memory is bounded whatever share of the
rows a label has; at most `positives` or `negatives` rows for each anchor (and
positive) leave it. Every anchor meets every row that it has to: that is the
operation, a stated set of queries against all rows.

Defined cases: rows with a null label or vector, or with null or non-finite
components, take no part; nor do those whose scaled length is 2^31 or more, whose
scores need not fit a long. Vectors of different lengths don't meet. Ties go by
smaller id, null ids last, then by row. Rows that repeat an id are rows of their
own, and each is another row's positive; a null id is no anchor. An anchor without
positives or negatives has no rows. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import bounded, settle

ANCHORS, ROWS, STEP = 512, 16_384, 8
EVERY, SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 50, 256, 5, 3, 50, 95
#: Squared lengths up to this give scores that doubles hold exactly.
EXACT = 2.0**52


class Block:
    """Rows by dimension, with each dimension's smallest and largest value."""

    def __init__(self, q: np.ndarray):
        exact = (np.square(q.astype(np.float64)).sum(axis=1) < EXACT).all()
        self.dims = np.ascontiguousarray(q.T.astype(np.float64 if exact else np.int64))
        self.low, self.high = self.dims.min(axis=1).astype(np.float64), self.dims.max(axis=1).astype(np.float64)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, narrow) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the bitmap `alive` that `narrow` never ruled out, and their scores.

        narrow(least, most) says which candidates stay, by bounds of their scores.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        weight = anchor[order].astype(np.float64)
        a, b = weight * self.low[order], weight * self.high[order]
        slack = 1e-12 * np.maximum(np.abs(a), np.abs(b)).sum()  # bounds are doubles, scores may be longer
        tail = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0.0)
        least, most = tail(np.minimum(a, b)) - slack, tail(np.maximum(a, b)) + slack
        # Integers that doubles don't hold are multiplied as integers.
        if self.dims.dtype == np.float64 and np.square(weight).sum() >= EXACT:
            self.dims = self.dims.astype(np.int64)
        x = anchor.astype(self.dims.dtype)
        rows = np.flatnonzero(alive)
        score = np.zeros(len(rows), self.dims.dtype)
        for k in range(0, len(order), STEP):
            dims = order[k : k + STEP]
            part = self.dims[dims] if len(rows) == self.dims.shape[1] else self.dims[np.ix_(dims, rows)]
            score = score + x[dims] @ part
            if k + STEP < len(order):
                stay = narrow(score + least[k + STEP], score + most[k + STEP])
                rows, score = rows[stay], score[stay]
            if not len(rows):
                break
        return rows, score.astype(np.int64)


def among_best(k: int):
    """Candidates that can be among the k highest: the k-th highest lower bound is a score that k rows reach."""

    def narrow(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        if len(least) <= k:
            return np.ones(len(least), bool)
        return most >= np.partition(least, len(least) - k)[len(least) - k]

    return narrow


def in_windows(windows: list[tuple[int, int]], k: int):
    """Candidates that can be among the k highest scores inside one of the windows (both ends belong to them)."""

    def narrow(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(least), bool)
        for lo, hi in windows:
            floor = lo
            sure = least[(least >= lo) & (most <= hi)]
            if len(sure) >= k:
                floor = np.partition(sure, len(sure) - k)[len(sure) - k]
            stay |= (most >= floor) & (least <= hi)
        return stay

    return narrow


def best(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Positions in `rows` of the k highest scores; ties by id, nulls last, then by key."""
    if len(rows) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        near = np.arange(len(rows))
    r = rows[near]
    return near[np.lexsort((keys[r], ids[r], null[r], -score[near]))[:k]]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _matrix(t: pa.Table) -> np.ndarray:
    q = t.column("q").combine_chunks()
    return q.flatten().to_numpy().reshape(len(t), -1) if len(q.flatten()) else np.zeros((len(t), 0), np.int64)


def _identity(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, 0 for nulls, and which are null."""
    ids = t.column("id").combine_chunks()
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)


FOUND = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _found(parts: list[tuple]) -> pa.Table:
    """(anchor, place, rows, ids, nulls, scores) of one list each, as a table."""
    if not parts:
        return FOUND.empty_table()
    rep = lambda i: np.repeat([p[i] for p in parts], [len(p[2]) for p in parts])
    cat = lambda i: np.concatenate([p[i] for p in parts])
    return pa.table([rep(0), rep(1).astype(np.int32), cat(2), pa.array(cat(3), pa.int64(), mask=cat(4)), cat(5)], schema=FOUND)


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return FOUND.empty_table()
        block, keys, (ids, null), out = Block(_matrix(right)), _column(right, "row"), _identity(right), []
        for me, q in zip(_column(left, "row"), _matrix(left), strict=True):
            rows, score = block.scan(q, keys != me, among_best(k))
            top = best(rows, score, ids, null, keys, k)
            r = rows[top]
            out.append((me, 0, keys[r], ids[r], null[r], score[top]))
        return _found(out)

    return run


def _negatives(k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return FOUND.empty_table()
        block, keys, (ids, null), out = Block(_matrix(right)), _column(right, "row"), _identity(right), []
        names, label = np.unique(_column(right, "label"), return_inverse=True)
        scores = left.column("scores").to_pylist()
        for me, mine, of, q in zip(_column(left, "row"), left.column("label").to_pylist(), scores, _matrix(left), strict=True):
            windows = [window(s, low, high) for s in of]
            open_ = sorted({w for w in windows if w[0] <= w[1]})
            if not open_:
                continue
            at = np.searchsorted(names, mine)
            other = label != at if at < len(names) and names[at] == mine else np.ones(len(label), bool)
            rows, score = block.scan(q, other, in_windows(open_, k))
            for place, (lo, hi) in enumerate(windows):
                inside = np.flatnonzero((score >= lo) & (score <= hi))
                if len(inside):
                    top = inside[best(rows[inside], score[inside], ids, null, keys, k)]
                    r = rows[top]
                    out.append((me, place, keys[r], ids[r], null[r], score[top]))
        return _found(out)

    return run


def _units(rows: DataFrame, anchors: DataFrame, group: list[str], also: list[str], scan) -> DataFrame:
    """All pairs of an anchor block and a row block of each group, scanned."""
    n, m = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), anchors.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"))
    counted = n.join(m, group).select(*group, F.ceil(F.col("_n") / ROWS).alias("_nb"), F.ceil(F.col("_m") / ANCHORS).alias("_na"))
    sizes = settle(counted, "groups")
    blocks = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    block = lambda c: F.pmod(F.xxhash64("row"), F.col(c))
    unit = [*group, "_i", "_j"]
    left = anchors.join(bounded(sizes), group).withColumn("_i", block("_na")).withColumn("_j", F.explode(blocks("_nb")))
    right = rows.join(bounded(sizes), group).withColumn("_j", block("_nb")).withColumn("_i", F.explode(blocks("_na")))
    mine, theirs = ["row", "q", *also], ["row", "id", "q", "label"]
    # Aliases, as both sides may come from one table.
    pick = lambda df, cols: df.select(*[F.col(c).alias(c) for c in [*unit, *[c for c in cols if c not in unit]]]).groupBy(*unit)
    return pick(left, mine).cogroup(pick(right, theirs)).applyInArrow(scan, "anchor long, place int, row long, id long, score long")


def _best_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchor: Column | None = None, scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where `anchor` holds, by default those whose id is a multiple of 50. Scores are inner products of floor(scale * x).
    """
    asked = (F.col(id_col) % EVERY == 0) if anchor is None else anchor
    picked = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"),
        F.coalesce(asked & F.col(id_col).isNotNull(), F.lit(False)).alias("asked"),
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    length = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * scale + 1, F.lit(2.0)))
    fit = picked.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & finite).where(length < 2.0**62)
    whole = fit.select("id", "label", "asked", F.size("vec").alias("len"), F.transform("vec", lambda x: F.floor(x * scale)).alias("q"))
    rows = settle(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")  # rows are numbered by the table
    anchors = rows.where("asked")
    near = _units(rows, anchors.drop("id"), ["len", "label"], [], _positives(positives))
    chosen = _best_of(near, ["anchor"], positives).select("anchor", F.struct("rank", F.col("id").alias("pid"), "score").alias("p"))
    listed = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list("p")).alias("p"))  # `positives` entries at most
    found = settle(anchors.join(listed, anchors["row"] == listed["anchor"]).select("row", "id", "label", "len", "q", "p"), "positives")
    queries = found.select("row", "label", "len", "q", F.transform("p", lambda x: x["score"]).alias("scores"))
    far = _units(rows, queries, ["len"], ["label", "scores"], _negatives(negatives, low, high))
    ranked = _best_of(far, ["anchor", "place"], negatives)
    told = found.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "p")
    return ranked.join(told, "anchor").select(
        "anchor_id", F.col("p")[F.col("place")]["pid"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("p")[F.col("place")]["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


def mined_negatives(vectors: DataFrame) -> DataFrame:
    """The registered mining: a seventh of the labels moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", moved.alias("label")))
