"""Self-join of texts by n-gram Jaccard similarity: MinHash banding, then full n-gram sets.

A text's n-grams are its runs of five words (letters and digits, lower case).
Texts with the same n-gram set form a class, named by a 128-bit hash of the set,
and are represented once. A class's MinHash signature is cut into bands; bands and
rows are chosen so that a pair at the threshold is met with at least the target
recall. Classes with equal hashes of a band are a bucket. A bucket's pairs belong
to it only if no earlier band's bucket has them, which band hashes alone tell, so
first the members of such pairs are found by ids and band hashes (in blocks, see
pairs), and only for these n-gram sets are joined and compared in full. Chains of
buckets are never taken together. Links between classes count all their copies;
copies of one class link with each other.

Defined cases: a null text, and any text with fewer than five words, has no
n-grams and links with nothing; a null id links with nothing and keeps its row;
rows that repeat an id are documents of their own, with the same text copies of
each other, with another text whatever that text is; an empty table gives an empty
result; other columns are ignored, or passed on by `drop_near_duplicates`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import bounded, connected, settle, small
from clauseloom.llm.pairs import blocks, by_node, dealt, link_units, spread, units
from clauseloom.llm.tokens import Memo, only, task

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_U64 = np.uint64


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of `rows` rows that meet a pair at the threshold with at least `recall`."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _words_of(part: str) -> bytes:
    return b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in _WORD.findall(part.lower()))


_MEMO = Memo(_words_of)


def begin() -> None:
    """At a task's start. Tasks name this function and not the memo, which would travel with them."""
    only(_MEMO)


def ngrams(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words."""
    w = np.frombuffer(b"".join(map(_MEMO.__getitem__, (text or "").split(" "))), "<u8")
    if len(w) < n:
        return np.empty(0, _U64)
    h = np.zeros(len(w) - n + 1, _U64)
    for k in range(n):
        h = _mix(h * _U64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def _signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash by multiply-and-add over 2**64, in slices that stay in cache."""
    low = np.full(len(a), 2**64 - 1, _U64)
    for at in range(0, len(grams), 512):
        low = np.minimum(low, (grams[at : at + 512, None] * a + b).min(axis=0))
    return low


def _signer(n: int, bands: int, rows: int):
    rng = np.random.default_rng(71)
    a = rng.integers(1, 2**63, bands * rows).astype(_U64) * _U64(2) + _U64(1)
    b = rng.integers(0, 2**63, bands * rows).astype(_U64)

    @task
    def run(batches):
        begin()
        for batch in small(batches):
            keys, bands_out, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                g = ngrams(text, n)
                sizes.append(len(g))
                if not len(g):
                    keys.append(None), bands_out.append(None)
                    continue
                keys.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest())
                sig = _mix(_signature(g, a, b)).reshape(bands, rows)
                h = np.arange(bands, dtype=_U64)
                for k in range(rows):
                    h = _mix(h * _U64(0x9E3779B97F4A7C15) + sig[:, k])
                bands_out.append(h.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands_out, pa.list_(pa.int64())), batch.column(2)],
                ["id", "n_ngrams", "node", "bands", "tie"],
            )

    return run


def _first_met(bands: int, threshold: float):
    """Of each unit of a bucket, the rows with a partner that no earlier band meets and whose set is near enough in size."""

    def run(batches):
        for (grp, i, j), left, right, one in units(batches, by_node):
            if not left or not right or (one and len(left) < 2):
                continue
            met = _unmet(grp, [r[5] for r in left], [r[5] for r in right], bands)
            met &= _sizes_fit(np.array([r[6] for r in left]), np.array([r[6] for r in right]), threshold)
            if one:
                np.fill_diagonal(met, False)
            out = [r for r, m in zip(left, met.any(axis=1).tolist(), strict=True) if m] + ([] if one else [r for r, m in zip(right, met.any(axis=0).tolist(), strict=True) if m])
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["grp", "i", "j", "right", "node", "bands"])

    return run


def _unmet(band: int, left: list[bytes], right: list[bytes], bands: int) -> np.ndarray:
    """Pairs of a bucket, all equal in `band`, that are equal in no band before it."""
    a, b = (np.frombuffer(b"".join(x[: 8 * bands] for x in side), ">i8").reshape(-1, bands) for side in (left, right))
    out = np.ones((len(a), len(b)), bool)
    for k in range(int(np.flatnonzero(a[0] == band)[0])):
        out &= a[:, k][:, None] != b[:, k][None, :]
    return out


def _sizes_fit(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum.outer(a, b) >= threshold * np.maximum.outer(a, b) - 1e-9


def _payloads(n: int):
    """The n-gram set of each class; rows whose text isn't the class's set are left out."""

    @task
    def run(batches):
        begin()
        for batch in small(batches):
            keep, load = [], []
            for i, (text, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "key")), strict=True)):
                g = ngrams(text, n).tobytes()
                if hashlib.blake2b(g, digest_size=16).digest() == key:
                    keep.append(i)
                    load.append(g)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), batch.column("copies").take(at), pa.array(load, pa.binary())], ["node", "copies", "grams"])

    return run


def _jaccard(bands: int, threshold: float):
    def compare(band: int, left: list[bytes], right: list[bytes]) -> np.ndarray:
        lg, rg = ([np.frombuffer(x, _U64, offset=8 * bands) for x in rows] for rows in (left, right))
        nl, nr = np.array([len(g) for g in lg]), np.array([len(g) for g in rg])
        met = _unmet(band, left, right, bands) & _sizes_fit(nl, nr, threshold)
        one = left == right  # a block with itself: each pair once, and no member with itself
        if one:
            met = np.triu(met, 1)
        if met.sum() <= 4 * (len(left) + len(right)):  # few candidates: one merge each
            out = np.zeros_like(met)
            for i, j in zip(*np.nonzero(met), strict=True):
                both = len(np.intersect1d(lg[i], rg[j], assume_unique=True))
                out[i, j] = both >= threshold * (nl[i] + nr[j] - both) - 1e-9
            return out | out.T if one else out
        # many: n-grams that several members hold become columns of 0/1 matrices, a slice of columns at a time
        every = np.concatenate(lg + rg)
        uniq, count = np.unique(every, return_counts=True)
        shared = uniq[count > 1]
        both = np.zeros(met.shape, np.float32)
        rows_of = lambda sets: (np.repeat(np.arange(len(sets)), [len(g) for g in sets]), np.concatenate(sets))
        (li, lv), (ri, rv) = rows_of(lg), rows_of(rg)
        lc, rc = np.searchsorted(shared, lv), np.searchsorted(shared, rv)
        lok, rok = (lc < len(shared)) & (shared[np.minimum(lc, len(shared) - 1)] == lv), (rc < len(shared)) & (shared[np.minimum(rc, len(shared) - 1)] == rv)
        li, lc, ri, rc = li[lok], lc[lok], ri[rok], rc[rok]
        for at in range(0, len(shared), 4096):
            x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
            m = (lc >= at) & (lc < at + 4096)
            x[li[m], lc[m] - at] = 1
            m = (rc >= at) & (rc < at + 4096)
            y[ri[m], rc[m] - at] = 1
            both += x @ y.T
        met &= both >= threshold * (nl[:, None] + nr[None, :] - both) - 1e-6
        return met | met.T if one else met

    return compare


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS,
    per_block: int = 512,
) -> DataFrame:
    """One row per input row: id, n_ngrams, class_id (smallest id with the same n-gram set), class_size, n_links, component_id, kept."""
    signed, whole = _joined(docs, id_col, text_col, n, threshold, recall, rows, per_block)
    return _report(signed, whole).drop("tie").withColumnRenamed("id", id_col)


def _joined(docs: DataFrame, id_col: str, text_col: str, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, per_block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(signed rows: id, n_ngrams, node, bands, tie; classes: node, class_id, class_size, n_links, component_id)."""
    bands = bands_for(threshold, recall, rows)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tied = narrow.select("id", "text", F.xxhash64("text").alias("tie"))
    signed = settle(tied.mapInArrow(_signer(n, bands, rows), "id long, n_ngrams long, node binary, bands array<long>, tie long"), "signatures")
    usable = signed.where("id is not null and node is not null")
    same = usable.groupBy("node").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n_ngrams").alias("size"))
    # From here on a class goes by its number in this table, which moves in fewer bytes than its hash, the key.
    classes = settle(same.withColumnRenamed("node", "key").withColumn("node", F.monotonically_increasing_id()), "classes")

    keyed = classes.select(F.explode("bands").alias("band"), "node", "size")
    buckets = settle(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams")).where("n > 1"), "buckets")
    packed = F.unhex(F.array_join(F.transform("bands", lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    in_buckets = keyed.drop("size").join(buckets, "band").withColumn("nb", blocks(F.col("n"), F.col("grams") * 8, per_block, 16 << 20, few=per_block))
    described = in_buckets.join(classes.select("node", packed.alias("bands"), "size"), "node")
    need = settle(dealt(spread(described, "band", "nb", ["bands", "size"])).mapInArrow(_first_met(bands, threshold), "grp long, i long, j long, right boolean, node long, bands binary"), "needed")

    wanted = settle(classes.select("class_id", "node", "key", "copies").join(need.select("node").distinct(), "node"), "wanted")
    ids = wanted.select("class_id").distinct()
    texts = narrow.join(bounded(ids), narrow["id"] == ids["class_id"], "left_semi")  # only these texts move
    loaded = texts.join(wanted.hint("shuffle_hash"), texts["id"] == wanted["class_id"]).select("text", "node", "key", "copies")
    sets = loaded.mapInArrow(_payloads(n), "node long, copies long, grams binary")  # read once, so not written
    work = need.join(sets, "node").select("grp", "i", "j", "right", "node", "copies", F.concat("bands", "grams").alias("payload"))
    found = settle(link_units(work, _jaccard(bands, threshold)), "links")

    links = found.where("kind = 'n'").groupBy("node").agg(F.sum("value").alias("others"))
    parts = connected(found.where("kind = 'e'"), "node", "other")
    met = classes.select("node", "key", "class_id", "copies").join(links, "node", "left").join(parts, "node", "left")
    lowest = met.where("component is not null").groupBy("component").agg(F.min("class_id").alias("lowest"))
    whole = met.join(lowest, "component", "left").select(
        F.col("key").alias("node"), "class_id", F.col("copies").alias("class_size"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("lowest", "class_id").alias("component_id")
    )
    return signed, settle(whole, "classes")


def _report(signed: DataFrame, whole: DataFrame) -> DataFrame:
    """id, tie (a hash of the text), n_ngrams, class_id, class_size, n_links, component_id, kept of every row."""
    done = signed.where("id is not null and node is not null").select("id", "tie", "n_ngrams", "node").join(whole, "node").drop("node")
    alone = signed.where("id is null or node is null").select(
        "id", "tie", "n_ngrams", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return done.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each group, the one with the smallest id.

    Rows go by id and text, so a document whose id a near copy repeats stays; rows
    that repeat both (exact copies, which `op8` drops) stay or go together.
    """
    signed, whole = _joined(docs, id_col, text_col, **how)
    gone = settle(_report(signed, whole).where("not kept").select(F.col("id").alias("_gone_id"), F.col("tie").alias("_gone_tie")).distinct(), "gone")
    same = (docs[id_col] == gone["_gone_id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["_gone_tie"])
    return docs.join(bounded(gone), same, "left_anti")
