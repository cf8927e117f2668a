"""Best-fit packing by a configuration linear program over the histogram of lengths.

Documents become ids, documents over the capacity are cut into pieces of the
capacity (the first piece takes the remainder), and the pieces' lengths are
counted. Over that histogram (at most `capacity` entries, whatever the corpus)
the covering program "fewest sequences so that every length is covered" is solved
by multiplicative weights: a length's price falls exponentially with the share
of it that is covered, and a knapsack dynamic program finds the configurations of
the highest price. The fractional solution is rounded to whole sequences, the
pieces that the rounding leaves have a program of their own, and so on; the few
that the last one leaves go, longest first, into the tightest open sequences.
Pieces of a length are numbered by distributed prefix sums and look up their place by
number, so nothing but the histogram and the configurations leaves the tasks.

Defined cases: a null text is empty and has the end id alone; equal documents are
packed each; an empty table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import running_total, settle, small
from clauseloom.llm.tokens import byte_level_ids, only, task

CAPACITY, ROUNDS, STEP = 1024, 40, 0.1
#: Prices this much below the highest are used in a round too; the least filling of a used configuration, against the best with the same longest piece.
SLACK, FILL = 0.02, 0.99


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Dynamic program over capacities: the highest price that fits in each, and the item it takes (-1: the next smaller capacity's)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        n = np.searchsorted(lengths, c, "right")
        worth = best[c - lengths[:n]] + prices[:n]
        k = int(worth.argmax())
        if worth[k] > best[c - 1]:
            best[c], took[c] = worth[k], k
        else:
            best[c] = best[c - 1]
    return best, took


def _filled(k: int, lengths: np.ndarray, took: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The best configuration that holds item k, as (item, copies), copies at most its count."""
    out = {k: 1}
    c = capacity - int(lengths[k])
    while c > 0:
        i = int(took[c])
        if i < 0 or out.get(i, 0) >= counts[i]:
            c -= 1
        else:
            out[i] = out.get(i, 0) + 1
            c -= int(lengths[i])
    return tuple(sorted(out.items()))


def solve(left: dict[int, int], capacity: int, rounds: int = ROUNDS, step: float = STEP) -> tuple[np.ndarray, np.ndarray, dict[tuple, float]]:
    """(lengths, counts, uses): a fractional cover of the histogram by configurations, as uses of each.

    A round solves one knapsack and uses every configuration whose price is
    within SLACK of the highest, each by `step` of what would cover its scarcest
    length; in the end all uses are scaled so that the least covered length is
    covered once.
    """
    lengths = np.array(sorted(left))
    counts = np.array([left[x] for x in lengths], float)
    uses: dict[tuple, float] = defaultdict(float)
    covered = np.zeros(len(lengths))
    for _ in range(rounds):
        prices = np.exp(-(covered - covered.min())) * lengths / capacity
        best, took = knapsack(lengths, prices, capacity)
        worth = prices + best[capacity - lengths]
        for config in {_filled(int(k), lengths, took, counts, capacity) for k in np.flatnonzero(worth >= (1 - SLACK) * worth.max())}:
            idx, copies = np.array(config).T
            width = step * float((counts[idx] / copies).min())
            uses[config] += width
            covered[idx] += width * copies / counts[idx]
    least = covered.min()
    if least <= 0:  # so few rounds that a length was never used: what is used keeps its share
        least = covered[covered > 0].min()
    return lengths, counts, {c: x / least for c, x in uses.items()}


def rounded(lengths: np.ndarray, counts: np.ndarray, uses: dict[tuple, float], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Whole uses of the configurations, and the pieces that these leave.

    A configuration is used if it is filled to FILL of the best with the same longest
    piece. Uses are rounded by their running sum, those with the longest piece first, so
    many small uses are not all rounded to none; a use takes no more pieces than last.
    Pieces of uses that are not made are kept from later configurations, as the next
    program has better ones for them.
    """
    rest, kept, out, carry = counts.astype(np.int64), np.zeros(len(counts)), [], 0.0
    fill = {c: sum(int(lengths[i]) * n for i, n in c) for c in uses}
    best = {c[-1][0]: f for c, f in sorted(fill.items(), key=lambda cf: cf[1])}
    for config in sorted(uses, key=lambda c: (-c[-1][0], -fill[c], -uses[c], c)):
        idx, copies = np.array(config).T
        wanted, whole = uses[config], 0
        if fill[config] >= FILL * best[config[-1][0]]:
            carry += wanted
            wanted = int(carry)
            carry -= wanted
            whole = min(wanted, int((np.maximum(rest[idx] - kept[idx], 0) // copies).min()))
        if whole > 0:
            out.append((whole, {int(lengths[i]): n for i, n in config}))
            rest[idx] -= whole * copies
        kept[idx] += (wanted - whole) * copies
    return out, {int(x): int(n) for x, n in zip(lengths, rest, strict=True) if n}


def program(hist: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """(sequences, {length: pieces in each}) of the rounded programs, and the pieces left.

    What one rounding leaves is a smaller histogram with a program of its own, until
    a rounding places fewer than a tenth of the pieces that it got.
    """
    left = dict(hist)
    full = left.pop(capacity, 0)
    out = [(full, {capacity: 1})] if full else []
    while left:
        got, rest = rounded(*solve(left, capacity, rounds), capacity)
        out += got
        before, after = sum(left.values()), sum(rest.values())
        left = rest
        if before - after < before / 10:
            break
    return out, left


def configurations(hist: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: pieces in each}) that hold the histogram exactly: the program's, and best fit for the few pieces it leaves."""
    out, left = program(hist, capacity, rounds)
    return out + best_fit(left, capacity)


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Longest first, each into the tightest open sequence; equal sequences are kept as one with a count."""
    room: dict[int, list[list]] = defaultdict(list)  # space left -> [count, contents]
    for length in sorted(hist, reverse=True):
        todo = hist[length]
        for space in range(length, capacity):
            while todo and room.get(space):
                count, held = room[space].pop()
                per = min(space // length, max(1, todo // count))
                m = min(count, todo // per)
                if m < count:
                    room[space].append([count - m, held])
                room[space - per * length].append([m, {**held, length: held.get(length, 0) + per}])
                todo -= m * per
            if not todo:
                break
        per = capacity // length
        for n, each in ((todo // per, per), (1 if todo % per else 0, todo % per)):
            if n:
                room[capacity - each * length].append([n, {length: each}])
    return [(count, held) for groups in room.values() for count, held in groups]


def place(configs: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """length -> rows (first number of the piece, first sequence, copies in each, offset of the first copy), by number."""
    seen: dict[int, int] = defaultdict(int)
    rows: dict[int, list] = defaultdict(list)
    sequence = 0
    for count, held in configs:
        at = 0
        for length, n in sorted(held.items(), reverse=True):
            rows[length].append((seen[length], sequence, n, at))
            seen[length] += count * n
            at += length * n
        sequence += count
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids)."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    @task
    def run(batches):
        encode = only(byte_level_ids(tokenizer))
        for b in small(batches):
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(encode.many(b.column(1))):
                ids += end
                n = len(ids) // 4
                cut = n % capacity or capacity
                edges = [0, *range(cut, n + 1, capacity)]
                for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    row.append(i), piece.append(k), start.append(x), length.append(y - x)
                    crc.append(zlib.crc32(ids[4 * x : 4 * y]))
                    if with_ids:
                        kept.append(ids[4 * x : 4 * y])
            made = {"id": b.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(made | ({"ids": pa.array(kept, pa.binary())} if with_ids else {}))

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (a written table with id, piece, length, ids_crc32) with sequence_id and offset."""
    hist = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    table = cut.sparkSession.sparkContext.broadcast(place(configurations(hist, capacity)))  # a few configurations per length
    numbered = running_total(cut.withColumn("one", F.lit(1)), ["length"], "one", [F.col("id"), F.col("piece"), F.col("ids_crc32"), F.col("start")], sum(hist.values()), "no")

    def run(batches):
        for b in batches:
            length, no = (b.column(c).to_numpy() for c in ("length", "no"))
            seq, off = np.empty(len(no), np.int64), np.empty(len(no), np.int64)
            for x in np.unique(length):
                mine, t = length == x, table.value[int(x)]
                k = np.searchsorted(t[:, 0], no[mine], "right") - 1
                nth = no[mine] - t[k, 0]
                seq[mine], off[mine] = t[k, 1] + nth // t[k, 2], t[k, 3] + nth % t[k, 2] * x
            keep = [c for c in b.schema.names if c not in ("no", "one")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"
    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = settle(pieces(docs, tokenizer, id_col, text_col, end_id, capacity), "pieces")
    return pack(cut, capacity).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian unsigned 32-bit), pieces (id, piece, length) in order."""
    cut = settle(pieces(docs, tokenizer, id_col, text_col, end_id, capacity, with_ids=True), "pieces")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "id", "piece", "length")))
    packed = pack(cut, capacity).groupBy("sequence_id").agg(parts.alias("p"))
    return packed.select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["id"].alias(id_col), x["piece"], x["length"])).alias("pieces"),
    )
