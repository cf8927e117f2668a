import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseloom.llm import op6_embedding_dedup as op6
from clauseloom.llm import op7_ngram_join as op7
from clauseloom.llm import op8_exact_dedup as op8
from clauseloom.llm.pairs import forest

LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(20_000))
TEXTS = ["a b", "a  b", "a\n\tb", None, "", " ", "\v", "x", LONG, LONG.replace(" ", "  "), LONG + "!", "a b ", "é\r\nb", "é b", "a b"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, True) for r in rows], "doc_id long, text string, keep_id string, n_links int, kept boolean")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("hash_bytes", [16, 1])  # one byte: different chunks share a hash
def test_exact_groups(spark, hash_bytes):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (4, ""), (None, "alone"), (3, LONG[:5000]), (90, LONG[:5000] + "?")]
    got = op8.dedup_report(frame(spark, rows), hash_bytes=hash_bytes).collect()
    want = {}
    for i, t in rows:
        want.setdefault(norm(t), []).append(i)
    expected = sorted(
        str((i, min((x for x in want[norm(t)] if x is not None), default=None), len(want[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())) for i, t in rows
    )
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == expected
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_filter_keeps_every_column_and_one_row_of_each_text(spark):
    rows = [(3, "a b", 7), (3, "a  b", 8), (3, "a  b", 9), (4, "a b", 1), (None, "x", 2), (None, "x", 3), (5, "y", 4), (6, None, 5), (6, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text_sha long").withColumn("_tie", F.lit("mine"))
    got = op8.deduplicate(docs)
    assert got.columns == ["doc_id", "text", "_text_sha", "_tie"]
    got = [(r.doc_id, norm(r.text), r._tie) for r in got.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(3, "a b", "mine"), (None, "x", "mine"), (5, "y", "mine"), (6, "", "mine")]))


def test_exact_filter(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "a b")]
    kept = op8.deduplicate(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "n_links", "kept"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({norm(t): i for i, t in reversed(list(enumerate(TEXTS)))}.values())
    assert op8.dedup_report(frame(spark, [])).collect() == [] and op8.deduplicate(frame(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.integers(0, 5000))
def test_chunks_join_to_the_text(data, at):
    data = data * 30
    assert b"".join(op8.chunks(data)) == data and all(len(c) <= op8.MAX_CHUNK for c in op8.chunks(data))


def test_chunks_follow_content():
    data = np.random.default_rng(0).integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    a, b = set(op8.chunks(data)), set(op8.chunks(b"shifted by a bit" + data))
    assert len(a & b) > 0.95 * len(a)


def edit(words, rng, n):
    w = list(words)
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(w)


def texts(seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(25):
        base = [f"w{rng.integers(4000)}" for _ in range(int(rng.integers(5, 300)))]
        out += [" ".join(base)] + [edit(base, rng, min(len(base), int(rng.integers(1, 6)))) for _ in range(4)]
        out += [" ".join(base).upper() + "!"] * (g % 3)
    return out + [None, "", "too few words here", "too few words here", "one two three four five", "one, two three FOUR five."]


def brute(rows):
    sets = [(i, frozenset(zip(*(w[k:] for k in range(5)), strict=False))) for i, t in rows for w in [re.findall(r"[^\W_]+", (t or "").lower())]]
    links = {i: 0 for i, _ in sets}
    comp = {i: i for i, _ in sets}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            x, y = sorted((top(i), top(j)))
            comp[y] = x
    return {i: (links[i], top(i)) for i in links}


@pytest.mark.parametrize("per_block", [512, 3])  # small blocks: groups span several units of work
def test_ngram_links_are_all_found(spark, per_block):
    rows = list(enumerate(texts()))
    got = {r.doc_id: (r.n_links, r.component_id) for r in op7.ngram_join(frame(spark, rows), per_block=per_block).collect()}
    assert got == brute(rows)


def test_large_near_copy_group(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edit(base, rng, 2)) for i in range(300)] + [(1000 + i, " ".join(base)) for i in range(50)]
    got = {r.doc_id: (r.n_links, r.component_id) for r in op7.ngram_join(frame(spark, rows), per_block=64).collect()}
    assert got == brute(rows)


def test_a_group_within_a_block_moves_once(spark, monkeypatch):
    rng, tables, settle = np.random.default_rng(2), {}, op7.settle
    monkeypatch.setattr(op7, "settle", lambda df, label: (out := settle(df, label), tables.setdefault(label, out))[0])
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edit(base, rng, 2)) for i in range(200)]
    got = {r.doc_id: (r.n_links, r.component_id) for r in op7.ngram_join(frame(spark, rows)).collect()}
    assert got == brute(rows)
    assert tables["needed"].groupBy("grp", "node").count().agg(F.max("count")).first()[0] == 1  # no member in several units
    assert "sets" not in tables and tables["needed"].schema["node"].dataType.simpleString() == "bigint"


def test_ngram_defined_cases(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")]
    got = sorted(str((r.doc_id, r.n_links, r.class_size, r.component_id, r.kept)) for r in op7.ngram_join(frame(spark, rows)).collect())
    assert got == sorted(map(str, [(None, 0, 1, None, True), (1, 1, 2, 1, True), (1, 1, 2, 1, True), (2, 0, 1, 2, True), (3, 0, 1, 3, True)]))
    assert op7.ngram_join(frame(spark, [])).collect() == []
    rows = list(enumerate(texts()))
    stay = sorted(r.doc_id for r in op7.drop_near_duplicates(frame(spark, rows)).collect())
    assert stay == sorted(i for i, (_, c) in brute(rows).items() if i == c)


def test_bands_reach_the_recall():
    b = op7.bands_for(0.8, 0.9999, 5)
    assert 1 - (1 - 0.8**5) ** b >= 0.9999 > 1 - (1 - 0.8**5) ** (b - 1)


def vectors(rng):
    out = []
    for g in range(30):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 8)) if g else 150):  # the first group is wider than a window
            out.append((base + rng.standard_normal(16) * 0.04).tolist())
    return out


def test_vector_links(spark):
    rng = np.random.default_rng(5)
    vs = vectors(rng)
    rows = [(i, v, i % 2) for i, v in enumerate(vs)] + [(900, vs[0], 0), (901, vs[0], 0), (902, vs[0], None), (903, None, 0), (904, [0.0] * 16, 0), (905, [float("nan")] * 16, 0), (906, [None] + vs[0][1:], 0), (907, [2 * x for x in vs[0]], 0), (908, vs[0][:8], 0), (None, vs[0], 0)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, label int, kept string, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in op6.embedding_links(df, window=16).collect()}
    good = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, comp = {i: 0 for i, _, _ in rows if i is not None}, {i: i for i, _, _ in rows if i is not None}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for (i, a, la), (j, b, lb) in itertools.combinations(good, 2):
        if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
            links[i] += 1
            links[j] += 1
            x, y = sorted((top(i), top(j)))
            comp[y] = x
    assert {k: v for k, v in got.items() if k is not None} == {i: (links[i], top(i)) for i in links} and got[None] == (0, None)
    assert op6.embedding_links(df.limit(0)).collect() == []


def test_ids_repeated_with_other_vectors_keep_their_links(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0001]), (3, [1.0001, 0.0]), (4, [1e200, 1e200]), (5, [1e200, 1.01e200]), (6, [1e-170, -1e-170]), (7, [1e-170, -1.01e-170])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in op6.embedding_links(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6)]


def test_ids_repeated_with_other_texts_keep_their_links(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (5, b + " other end"), (5, "nothing like the others at all")]
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in op7.ngram_join(frame(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (5, 0, 5), (5, 2, 1)]
    stay = sorted((r.doc_id, r.text) for r in op7.drop_near_duplicates(frame(spark, rows)).collect())
    assert stay == [(1, a), (1, b), (5, "nothing like the others at all")]


def test_forest_keeps_everything_connected():
    rng = np.random.default_rng(4)
    for n, m, p in ((1, 1, 1.0), (5, 7, 0.2), (30, 20, 0.03), (40, 40, 0.5)):
        links = rng.random((n, m)) < p

        def parts(edges, size=n + m):
            comp = list(range(size))
            for a, b in [*edges] * size:
                comp[a] = comp[b] = min(comp[a], comp[b])
            return comp

        kept = forest(links)
        assert parts(kept) == parts([(i, n + j) for i, j in zip(*np.nonzero(links), strict=True)]) and len(kept) < n + m


def test_chained_groups_stay_apart(spark):
    """A chain of texts, each near the next only, is one component but never one group of candidates."""
    words = [f"w{i}" for i in range(100 + 2 * 120)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100])) for i in range(120)]
    got = {r.doc_id: (r.n_links, r.component_id) for r in op7.ngram_join(frame(spark, rows)).collect()}
    assert got == brute(rows) and {c for _, c in got.values()} == {0}


def crowded(n, pairs, mutual, rng, d=64):
    """n unit vectors of one mutual cosine, and partners of the first `pairs` at cosine 0.982."""
    center = np.eye(d)[0]
    x = rng.standard_normal((n, d))
    x[:, 0] = 0
    x = np.sqrt(mutual) * center + np.sqrt(1 - mutual) * x / np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal((pairs, d))
    u -= (u * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    return np.concatenate([x, 0.982 * x[:pairs] + np.sqrt(1 - 0.982**2) * u / np.linalg.norm(u, axis=1, keepdims=True)])


def test_a_crowded_label_keeps_its_links(spark, monkeypatch):
    """20,000 vectors of mutual cosine 0.9 beside a sparse label, in several tasks; ten passes with windows of 48 find about 0.88 of the pairs."""
    monkeypatch.setattr(op6, "ROWS_PER_TASK", 4000)
    rng = np.random.default_rng(4)
    x, pairs = crowded(20_000, 400, 0.9, rng), 400
    y = crowded(2000, 50, 0.0, rng)
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(100_000 + i, v.tolist(), "s") for i, v in enumerate(y)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(6)
    got = {r.vec_id: r for r in op6.embedding_links(vectors).where("n_links > 0").collect()}
    assert np.mean([20_000 + i in got and i in got for i in range(pairs)]) >= 0.95
    assert np.mean([102_000 + i in got for i in range(50)]) >= 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_passes_and_windows_follow_the_counts():
    near = np.ones((100, 60), np.int64)
    assert op6.choose(near[:, :10], 10, 48)[:2] == (10, 48)
    rng = np.random.default_rng(0)
    far = np.where(rng.random((400, 60)) < 0.1, 40, rng.integers(60, 3000, (400, 60)))
    p, w, met = op6.choose(far, 10, 48)
    assert met >= op6.RECALL and 10 < p <= 60 and w >= 48
    assert op6.choose(np.full((100, 60), 10**6), 10, 48)[2] == 0
