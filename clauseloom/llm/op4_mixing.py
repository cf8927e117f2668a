"""Mixing sources to target weights by fixed-length blocks of words.

The words of a source form one stream, in an order fixed by hashes of its rows,
cut into blocks of `block` words. A source's target says how many of its words
the mix takes: whole passes over its blocks and a last part of a pass. The output
is a row of shards of `shard_slots` slots. The number of slots that each source
has in each shard is drawn from a multinomial law under the condition that a
source's slots add up to its target (a multivariate hypergeometric law), by
splitting the range of shards in halves from the root down with a seeded
generator, so every task draws its own shards and reruns agree. Sources are drawn
in pages of PAGE: a split first divides its slots among the pages, then a page's
among its sources, so a task holds one number a page and the sources of one page,
however many there are. The draw is exact at any number of slots. A source's k-th
slot goes to block perm(k) by a keyed pseudorandom permutation of its blocks,
another in each pass, and slots meet blocks in a join by source and index.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating; they
share `share` of all words by weight, none above `most` times its own size, the
excess shared again by weight among the others.

Defined cases: a null text has no words; a document without words takes none; a
null source is a source of its own; repeated rows are laid in the stream one by
one; an empty table gives an empty mix. Other columns are ignored by the plan.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import running_total, settle, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK, SHARD_SLOTS, SEED = 128, 1024, 20240917
#: Sources of a page; shards that a task draws, for each page; slots up to which the generator draws alone, and picks one by one.
PAGE, CHUNK, DIRECT, SINGLE = 1024, 64, 1 << 29, 1000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with no (from 0), weight and target. One row per source, so its windows are small."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("no"), F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("no", (F.row_number().over(order) - 1)).withColumn("weight", w)
    cap = F.col("source_size") * F.lit(most)
    filled = Window.orderBy(F.col("ratio"), F.col("no"))
    level = (
        named.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
        .withColumn("water", (F.col("all") - F.col("capped")) / F.col("open"))
        # the first source, from the smallest ratio on, whose cap is above the water line
        .withColumn("line", F.min(F.when(F.col("ratio") >= F.col("water"), F.struct("ratio", "no", "water"))).over(Window.partitionBy()))
    )
    target = F.when(F.col("line").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("line.water") * F.col("weight")))
    return level.select("source", "source_size", "no", "weight", target.alias("target"))


def _permute(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n), at k: four Feistel rounds, walked until inside the range."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    out, left = k.astype(np.uint64), np.ones(len(k), bool)
    keys = np.random.default_rng([SEED, key % 2**63]).integers(1, 2**63, 4).astype(np.uint64)
    while left.any():
        x = out[left]
        a, b = x >> np.uint64(half), x & mask
        for r in keys:
            f = (b + r) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, (a ^ (f >> np.uint64(32))) & mask
        out[left] = (a << np.uint64(half)) | b
        left = out >= n
    return out.astype(np.int64)


def _position(value: int, n: int, key: int) -> int:
    """The k with _permute(k) = value: the rounds undone, walked back into the range."""
    half = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    mask, whole = (1 << half) - 1, (1 << 64) - 1
    keys = [int(x) for x in np.random.default_rng([SEED, key % 2**63]).integers(1, 2**63, 4)]
    while True:
        a, b = value >> half, value & mask
        for r in reversed(keys):
            f = (a + r) * 0x9E3779B97F4A7C15 & whole
            f = (f ^ (f >> 29)) * 0xBF58476D1CE4E5B9 & whole
            a, b = (b ^ (f >> 32)) & mask, a
        value = (a << half) | b
        if value < n:
            return value


def _source_plan(block: int):
    """For each source its blocks, slots and the words that its last slot leaves out, so that it takes round(target) words."""

    def one(no: int, size: int, target: float) -> tuple[int, int, int]:
        want = min(round(target), math.floor(2 * size)) if size else 0
        n = -(-size // block)
        passes, rest = divmod(want, size) if size else (0, 0)
        slots, cut = passes * n, 0
        if rest:
            short = n * block - size  # words that the last block of the stream lacks
            early = short and _position(n - 1, n, no * 64 + passes) < -(-rest // block)
            j = -(-(rest + short * bool(early)) // block)
            slots, cut = slots + j, j * block - short * bool(early) - rest
        return n, slots, cut

    def run(frames):
        for f in frames:
            made = [one(*r) for r in zip(f["no"].tolist(), f["source_size"].tolist(), f["target"].tolist(), strict=True)]
            yield pd.DataFrame({"no": f["no"]} | {c: np.array([m[k] for m in made], np.int64) for k, c in enumerate(("blocks", "slots", "cut"))})

    return run


def draw(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each colour are among n balls drawn without replacement, for any counts.

    Beyond the generator's range every ball is first taken by itself with
    probability n over all; as all sets of a size are equally likely then, what is
    too much or too little is drawn again out of those taken or left: about the
    root of n balls, so few rounds are needed.
    """
    total = int(counts.sum())
    if total < DIRECT:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    if n > total - n:
        return counts - draw(counts, total - n, rng)
    if n <= SINGLE:
        left, got = counts.copy(), np.zeros_like(counts)
        for k in range(n):
            i = int(np.searchsorted(np.cumsum(left), rng.integers(total - k), "right"))
            left[i] -= 1
            got[i] += 1
        return got
    got = rng.binomial(counts, n / total)
    over = int(got.sum()) - n
    return got - draw(got, over, rng) if over > 0 else got + draw(counts - got, -over, rng)


def _draw(page_slots: np.ndarray, n_shards: int, chunk: int, shard_slots: int):
    """For rows (page, chunk, its sources), the page's rows (shard, slot, no, epoch, block_no, cut) of the mix in the chunk's shards."""
    all_slots = int(page_slots.sum())

    def split(low: int, mid: int, high: int, pages: np.ndarray, own: np.ndarray, page: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a range of shards' slots by page and by this page's source, those in the shards before mid."""
        left = draw(pages, min(mid * shard_slots, all_slots) - low * shard_slots, np.random.default_rng([SEED, low, high]))
        return left, draw(own, int(left[page]), np.random.default_rng([SEED, low, high, 1 + page]))

    def shards(low, high, pages, own, before, page):
        if not own.sum():
            return
        if high - low == 1:
            yield low, pages, own, before
            return
        mid = (low + high) // 2
        lp, lo = split(low, mid, high, pages, own, page)
        yield from shards(low, mid, lp, lo, before, page)
        yield from shards(mid, high, pages - lp, own - lo, before + lo, page)

    def chunk_of(at: int, pages, own, page):
        low, high, before = 0, -(-n_shards // chunk), np.zeros_like(own)
        while high - low > 1:
            mid = (low + high) // 2
            lp, lo = split(low * chunk, mid * chunk, min(high * chunk, n_shards), pages, own, page)
            if at < mid:
                high, pages, own = mid, lp, lo
            else:
                low, before, pages, own = mid, before + lo, pages - lp, own - lo
        yield from shards(at * chunk, min((at + 1) * chunk, n_shards), pages, own, before, page)

    def run(frames):
        for f in frames:
            for page, at, sources in zip(f["page"].tolist(), f["chunk"].tolist(), f["sources"], strict=True):
                no, blocks, slots, cut = np.array([[s["no"], s["blocks"], s["slots"], s["cut"]] for s in sources], np.int64).T
                for shard, pages, own, before in chunk_of(at, page_slots, slots, page):
                    parts = []
                    for i in np.flatnonzero(own).tolist():
                        k = np.arange(before[i], before[i] + own[i])
                        epoch, place, block = k // blocks[i], k % blocks[i], np.empty(len(k), np.int64)
                        for e in np.unique(epoch):
                            block[epoch == e] = _permute(place[epoch == e], int(blocks[i]), int(no[i]) * 64 + int(e))
                        parts.append((np.full(len(k), no[i]), epoch, block, np.where(k == slots[i] - 1, cut[i], 0)))
                    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    first = int(pages[:page].sum())
                    slot = np.random.default_rng([SEED, shard]).permutation(int(pages.sum()))[first : first + len(cols[0])]
                    yield pd.DataFrame(dict(zip(("shard", "slot", "no", "epoch", "block_no", "cut"), (np.full(len(slot), shard), slot, *cols), strict=True)))

    return run


def mix_slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The drawn mix of targets (no, source_size, target): shard, slot, no, epoch, block_no, cut (words its end leaves out)."""
    spark = targets.sparkSession
    wide = targets.select(F.col("no").cast("long").alias("no"), "source_size", "target").mapInPandas(_source_plan(block), "no long, blocks long, slots long, cut long")
    plan = settle(wide.where("slots > 0"), "plan")
    paged = plan.withColumn("page", F.floor(F.col("no") / PAGE))
    totals = {r[0]: r[1] for r in paged.groupBy("page").agg(F.sum("slots")).collect()}  # one number for PAGE sources
    page_slots = np.array([totals.get(k, 0) for k in range(max(totals, default=-1) + 1)], np.int64)
    n_shards = -(-int(page_slots.sum()) // shard_slots)
    chunk = CHUNK * max(1, len(page_slots))
    n_chunks = -(-n_shards // chunk)
    lists = paged.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("no", "blocks", "slots", "cut"))).alias("sources"))  # PAGE sources at most
    work = lists.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_chunks - 1)))))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n_chunks * max(1, len(page_slots)), n_shards // 16384))
    return work.repartition(n, "page", "chunk").mapInPandas(_draw(page_slots, n_shards, chunk, shard_slots), "shard long, slot long, no long, epoch long, block_no long, cut long")


def _placed(sized: DataFrame) -> DataFrame:
    """sized with start, the words of the source in front of each row.

    Rows that repeat an id, a text and a source are laid behind each other, one
    place for all of them, and are numbered by their rows only where there are
    such; no key, however often it repeats, is one task's work.
    """
    key = ["source", "id", "tie", "size"]
    kinds = sized.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row")).withColumn("words", F.col("size") * F.col("copies"))
    kinds = settle(kinds, "kinds")
    placed = settle(running_total(kinds, ["source"], "words", [F.col("id"), F.col("tie"), F.col("size")], kinds.count(), "start"), "placed")
    many = placed.where("copies > 1")
    single = placed.where("copies = 1").select(*sized.columns, "start")
    if many.isEmpty():
        return single
    alike = many.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("start").alias("_start"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    repeated = settle(sized.join(alike, same).select(*sized.columns, "_start", F.lit(1).alias("_one")), "repeated")
    numbered = running_total(repeated, key, "_one", [F.col("row")], repeated.count(), "_nth")
    return single.unionByName(numbered.select(*sized.columns, (F.col("_start") + F.col("_nth") * F.col("size")).alias("start")))


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE,
    most: float = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, row_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: id, size, source_size, target, no, start, row (row_col's, else a number) of each document; spans: the mix
    itself, one row per part of a slot: shard, slot, place (words before it in the slot), epoch, no, start (its document's), word_from, word_to."""
    text = F.col(text_col).cast("string")
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    sized = settle(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(text).alias("tie"), row.alias("row"),
        ),
        "sized",
    )
    targets = settle(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share=share, most=most), "targets")
    placed = _placed(sized)
    rows = settle(
        placed.join(targets, placed["source"].eqNullSafe(targets["source"])).select("id", "size", "source_size", "target", F.col("no").cast("long").alias("no"), "start", "row"), "rows"
    )
    slots = mix_slots(targets, block, shard_slots)
    parts = rows.where("size > 0").select(
        "no", "start", "size", "source_size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block_no")
    )
    block_from = F.col("block_no") * block
    parts = parts.withColumn("word_from", F.greatest(F.lit(0), block_from - F.col("start"))).withColumn("word_to", F.least("size", block_from + block - F.col("start")))
    # Spark can't tell how many slots the draws make, so it must not take them for a table to broadcast.
    met = slots.hint("merge").join(parts, ["no", "block_no"]).withColumn(
        "word_to", F.least("word_to", F.least(block_from + block, F.col("source_size")) - F.col("cut") - F.col("start"))
    )
    spans = met.where("word_to > word_from").select(
        "shard", "slot", (F.col("start") + F.col("word_from") - block_from).alias("place"), "epoch", "no", "start", "word_from", "word_to"
    )
    return rows, spans


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken."""
    rows, spans = mix_plan(docs, id_col, text_col, source_col, **how)
    taken = spans.groupBy("no", "start").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    full = rows.where("size > 0").join(taken, ["no", "start"], "left").select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    none = rows.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return full.unionByName(none).withColumnRenamed("id", id_col)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as rows of docs: for each document and pass the words that the mix takes of it; n_chars follows the text.

    A document taken whole keeps its text; of others the words taken are joined by single spaces.
    """
    row, text, of_ = (unused(docs.columns, x) for x in ("_row", "_mixed", "_of"))  # docs' columns may have any name
    held = settle(docs.withColumn(row, F.monotonically_increasing_id()), "held")  # rows are numbered by the table
    rows, spans = mix_plan(held, id_col, text_col, source_col, row_col=row, **how)
    runs = spans.groupBy("no", "start", "epoch").agg(F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("runs"), F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    of = rows.where("size > 0").join(runs, ["no", "start"]).select(*[F.col(c).alias(f"{of_}_{c}") for c in ("row", "size", "runs", "taken")])
    met = held.join(of, F.col(row) == F.col(f"{of_}_row"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))
    picked = F.array_join(F.flatten(F.transform(f"{of_}_runs", lambda r: F.slice(words, r["word_from"].cast("int") + 1, (r["word_to"] - r["word_from"]).cast("int")))), " ")
    new = met.withColumn(text, F.when(F.col(f"{of_}_taken") == F.col(f"{of_}_size"), F.col(text_col)).otherwise(picked))
    out = [F.col(text).alias(c) if c == text_col else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return new.select(*out)
