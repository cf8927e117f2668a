"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label form a class and are represented once. In each pass the
classes are ordered lexicographically by label and by a concatenation of random
hyperplane bits, each is compared with its next `window` neighbours, and pairs
whose cosine in double precision reaches the threshold are kept as verified
edges. The union of all passes' edges gives components. A window can't list all
partners of a vector in a dense group, so inside every component all pairs are
then compared in blocks (see pairs), which counts every link and caps none.

How many passes and how wide a window it takes depends on how many vectors a label
has and how they crowd, so it is measured first: PROBES rows of the table get a
partner at exactly the threshold in a random direction, and one narrow pass over
all rows counts how many lie between the two in each of the next PASSES orders. The
cheapest number of passes and window that would bring RECALL of these pairs
together is taken, with never less than PASSES and WINDOW. The probes are a bounded
sample; every row is in every pass.

Windows end at the border of a task; each pass has other borders. Recall against
brute force is in the README and in the tests.

Defined cases: a vector that is null, zero or holds null or non-finite components
links with nothing and keeps its row, so does one whose label or id is null;
vectors of another length link with nothing of this one; rows that repeat an id
are vectors of their own, whatever they hold; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import connected, settle
from clauseloom.llm.pairs import link_groups

THRESHOLD, PASSES, WINDOW, BITS, SEED = 0.98, 10, 48, 60, 606
ROWS_PER_TASK = 20_000
#: Rows that are probed, the share of their pairs that the passes should bring together, and the passes and windows to choose from.
PROBES, RECALL, MOST_PASSES, WINDOWS = 512, 0.97, 60, (48, 96, 192, 384, 768, 1536)
#: What a pass costs besides its comparisons, in comparisons a row.
PASS_COST = 100


def _usable(vec: str) -> F.Column:
    """Finite, without nulls, and not zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vec).isNotNull() & fine & F.exists(vec, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signs(unit: np.ndarray, seed: int, bits: int) -> np.ndarray:
    """Keys of a pass: hyperplane signs, the first the most significant; planes depend on the vectors' length only."""
    planes = np.random.default_rng([SEED, seed, unit.shape[1]]).standard_normal((unit.shape[1], bits))
    return (unit @ planes > 0) @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _keys(vectors: pd.Series, seeds: list[int], bits: int) -> np.ndarray:
    """One column of keys for each pass."""
    out = np.zeros((len(vectors), len(seeds)), np.int64)
    size = vectors.str.len().to_numpy()
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        unit = _unit(np.frombuffer(b"".join(vectors.iloc[at]), "<f8").reshape(len(at), -1))
        for k, seed in enumerate(seeds):
            out[at, k] = _signs(unit, seed, bits)
    return out


def _project(seed: int, bits: int):
    """Adds the pass's key."""

    def run(frames):
        for f in frames:
            if len(f):
                yield f.assign(key=_keys(f["vec"], [seed], bits)[:, 0])

    return run


def _partner(vec: bytes, threshold: float, rng: np.random.Generator) -> bytes:
    """A vector whose cosine with vec is the threshold, in a random direction; of one component, vec itself."""
    v = _unit(np.frombuffer(vec, "<f8").reshape(1, -1))[0]
    u = rng.standard_normal(len(v))
    u -= (u @ v) * v
    length = np.linalg.norm(u)
    return vec if length < 1e-9 else (threshold * v + np.sqrt(1 - threshold**2) * u / length).astype("<f8").tobytes()


def _between(probes: pd.DataFrame, seeds: list[int], bits: int):
    """For each pass and probe the rows of its label between the probe and its partner, both ends counted; partial sums of a task."""
    a, b = _keys(probes["vec"], seeds, bits), _keys(probes["partner"], seeds, bits)
    low, high = np.minimum(a, b), np.maximum(a, b)
    of = probes.groupby("label").indices

    def run(frames):
        found = np.zeros(low.shape, np.int64)
        for f in frames:
            for label, rows in f.groupby("label"):
                at = of.get(label)
                if at is not None:
                    keys = np.sort(_keys(rows["vec"], seeds, bits), axis=0)
                    for k in range(len(seeds)):
                        found[at, k] += np.searchsorted(keys[:, k], high[at, k], "right") - np.searchsorted(keys[:, k], low[at, k], "left")
        probe, k = np.nonzero(found)
        yield pd.DataFrame({"probe": probe, "pass": np.asarray(seeds, np.int64)[k], "n": found[probe, k]})

    return run


def choose(counts: np.ndarray, passes: int, window: int, recall: float = RECALL) -> tuple[int, int, float]:
    """(passes, window, share of probes brought together), the cheapest that reaches recall, else the best; counts by probe and pass."""
    best = None
    for w in sorted({window, *(x for x in WINDOWS if x > window)}):
        met = np.maximum.accumulate(counts <= w, axis=1).mean(axis=0)
        enough = np.flatnonzero(met >= recall)
        p = max(passes, int(enough[0]) + 1) if len(enough) else counts.shape[1]
        rank = (min(met[min(p, len(met)) - 1], recall), -p * (w + PASS_COST))
        if best is None or rank > best[0]:
            best = (rank, p, w, float(met[min(p, len(met)) - 1]))
    return best[1:]


def tuned(classes: DataFrame, threshold: float, passes: int = PASSES, window: int = WINDOW) -> tuple[int, int, float]:
    """Passes and window for these rows, and the share of probed pairs that they bring together."""
    picked = classes.select("node", "label", "vec").orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(PROBES).toPandas()  # PROBES vectors
    if not len(picked):
        return passes, window, 1.0
    rng = np.random.default_rng(SEED)
    probes = picked.assign(partner=[_partner(v, threshold, rng) for v in picked["vec"]])
    counts = np.zeros((len(probes), 0), np.int64)
    while True:
        seeds = list(range(counts.shape[1], counts.shape[1] + PASSES))
        told = classes.select("label", "vec").mapInPandas(_between(probes, seeds, BITS), "probe long, pass long, n long").groupBy("probe", "pass").agg(F.sum("n").alias("n")).collect()
        more = np.zeros((len(probes), PASSES), np.int64)  # PROBES times PASSES numbers
        for probe, k, n in told:
            more[probe, k - seeds[0]] = n
        counts = np.concatenate([counts, more], 1)
        best = choose(counts, passes, window)
        # More passes are of use only while they would be cheaper than the wider window.
        if counts.shape[1] >= MOST_PASSES or (best[2] >= RECALL and best[0] * (best[1] + PASS_COST) <= (counts.shape[1] + 1) * (window + PASS_COST)):
            return best


def _windows(window: int, threshold: float):
    """Edges between each row and its next `window` rows, reduced to one edge per row and linked stretch."""

    def run(frames):
        last: pd.DataFrame | None = None
        for f in frames:
            if not len(f):
                continue
            both = f if last is None else pd.concat([last, f], ignore_index=True)
            last = both.tail(window)
            node, label, size = both["node"].to_numpy(), both["label"].to_numpy(), both["vec"].str.len().to_numpy()
            width = int(size.max())
            x = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in both["vec"]), "<f8").reshape(len(both), -1)
            x = _unit(x)
            out = []
            for d in range(1, min(window, len(both) - 1) + 1):
                near = (np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold) & (label[:-d] == label[d:]) & (size[:-d] == size[d:])
                if near.any():
                    out.append(pd.DataFrame({"a": node[:-d][near], "b": node[d:][near]}))
            if out:
                # the nearest and the farthest partner behind each row hold a sorted stretch together; others stay too unless they repeat a tie
                e = pd.concat(out, ignore_index=True)
                yield _thin(e)

    return run


def _thin(e: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the edges."""
    ids, inv = np.unique(e[["a", "b"]].to_numpy(), return_inverse=True)
    inv = inv.reshape(-1, 2)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[inv[:, 0]], root[inv[:, 1]])
        new = root.copy()
        np.minimum.at(new, inv[:, 0], low)
        np.minimum.at(new, inv[:, 1], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[child], "b": ids[root[child]]})


def _cosine(threshold: float):
    def compare(_, left: list[bytes], right: list[bytes]) -> np.ndarray:
        out = np.zeros((len(left), len(right)), bool)
        ls, rs = np.array([len(v) for v in left]), np.array([len(v) for v in right])
        for s in np.intersect1d(ls, rs):
            i, j = np.flatnonzero(ls == s), np.flatnonzero(rs == s)
            unit = [_unit(np.frombuffer(b"".join(side[k] for k in at), "<f8").reshape(len(at), -1)) for side, at in ((left, i), (right, j))]
            out[np.ix_(i, j)] = unit[0] @ unit[1].T >= threshold
        return out

    return compare


def _pack(frames):
    """Vectors as little-endian doubles."""
    for f in frames:
        yield f.assign(vec=[np.asarray(v, "<f8").tobytes() for v in f["vec"]])


def embedding_links(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    fit = F.coalesce(_usable("vec") & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    packed = settle(rows.where(fit).mapInPandas(_pack, "id long, label string, vec binary"), "vectors")
    same = packed.groupBy("label", "vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = settle(same.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are fixed by the table
    n = max(1, -(-classes.count() // ROWS_PER_TASK))
    edges = None
    passes, window, _ = tuned(classes, threshold, passes, window)
    for k in range(passes):
        keyed = classes.select("node", "low", "label", "vec").mapInPandas(_project(k, BITS), "node long, low long, label string, vec binary, key long")
        ordered = keyed.repartitionByRange(n, "label", "key", "low").sortWithinPartitions("label", "key", "low")
        found = settle(ordered.mapInPandas(_windows(window, threshold), "a long, b long"), "pass")
        edges = found if edges is None else edges.unionByName(found)
    parts = settle(connected(edges, "a", "b"), "components")
    members = classes.join(parts, "node").select(F.col("component").alias("grp"), "node", "copies", F.octet_length("vec").cast("long").alias("weight"), F.col("vec").alias("payload"))
    found = settle(link_groups(members, _cosine(threshold), 512, 16 << 20), "links")
    others = found.where("kind = 'n'").groupBy("node").agg(F.sum("value").alias("others"))
    met = classes.join(others, "node", "left").join(parts, "node", "left")
    lowest = met.where("component is not null").groupBy("component").agg(F.min("low").alias("lowest"))
    whole = met.join(lowest, "component", "left").select(
        "label", "vec", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("lowest", "low").alias("component_id")
    )
    done = packed.join(whole, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~fit).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
