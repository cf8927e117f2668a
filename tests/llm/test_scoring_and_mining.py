import hashlib
import itertools
import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseloom.llm import op11_lattice_lm as op11
from clauseloom.llm import op12_fill_in_middle as op12
from clauseloom.llm import op13_hard_negatives as op13

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = "ab é" * 60_000


# ---- fill in the middle


def bits_of(kind):
    n = 5000
    bits = np.zeros(n, bool)
    if kind == "array":
        bits[:: 97] = True
    elif kind == "run":
        bits[10:4000] = bits[4500:] = True
    else:
        bits[:] = np.random.default_rng(1).random(n) < 0.4
    return bits


@pytest.mark.parametrize(("kind", "cls"), [("array", op12.ArrayContainer), ("run", op12.RunContainer), ("bitmap", op12.BitmapContainer)])
def test_containers_select(kind, cls):
    bits = bits_of(kind)
    made = op12.container(bits, int(bits.sum()))
    assert isinstance(made, cls)
    assert [made.select(k) for k in range(int(bits.sum()))] == np.flatnonzero(bits).tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "漢", "😀", " ", "bc" * 500, "ß" * 3000]), max_size=40).map("".join))
def test_boundaries_are_code_points(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    marks = op12.BoundarySet(raw)
    ends = [0, *itertools.accumulate(len(c.encode()) for c in text)]
    assert marks.n == len(text)
    assert [marks.select(k) for k in range(0, len(ends), max(1, len(ends) // 300))] == ends[:: max(1, len(ends) // 300)]
    assert marks.select(len(text)) == len(raw)


def test_boundaries_of_many_containers():
    raw = np.frombuffer(LONG.encode(), np.uint8)
    marks = op12.BoundarySet(raw)
    assert len(marks.containers) == -(-len(raw) // op12.SPAN) > 3
    for k in (0, 1, 60_000, 65_535, 65_536, 200_001, len(LONG) - 1, len(LONG)):
        assert marks.select(k) == len(LONG[:k].encode())


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y, z = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{z}<P>{x}<M>{y}" if spm else f"<P>{x}<S>{z}<M>{y}"


def test_fill_in_middle_against_plain_python(spark):
    texts = ["", None, "a", "é😀\n漢", "has <P> inside", "<", "<S", "x<M>", "$1 \\Q|\\E", LONG, "tie", "tie"]
    rows = [(i, t) for i in range(12) for t in texts] + [(None, "null id"), (-5, "below")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fim", F.lit("mine")).withColumn("_text", F.lit(1)).withColumn("n", F.lit(2))
    made = op12.fill_in_middle(docs)
    assert made.columns == [*docs.columns, "fim_"]
    whole = made.select("doc_id", "text", "fim_.*", op12.restore(F.col("fim_.text"), F.col("fim_.form")).alias("back")).collect()
    assert len(whole) == len(rows)
    for r in whole:
        assert r.back == (r[1] or "")
        n, form, a, m, out = plain_fim(r.doc_id, r[1])
        assert (r.n, r.form, r.first, None if r.second is None else r.second - r.first, r[6]) == (n, form, a, m, out)
    report = op12.fill_in_middle_report(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((i, *plain_fim(i, t)[:4], sha(plain_fim(i, t)[4]), sha(t or "")) for i, t in rows)
    assert Counter(map(tuple, report.collect())) == want
    assert {"plain", "psm", "spm"} == {r.form for r in whole}


def test_fill_in_middle_by_words_and_of_nothing(spark):
    docs = spark.createDataFrame([(i, "one  two\tthree four") for i in range(30)], "doc_id long, text string")
    for r in op12.fill_in_middle(docs, unit="word", percent=100, marks=("[p]", "[s]", "[m]")).select("doc_id", "fim.*").collect():
        assert r.n == 4 and not r.text.startswith("[p]wo")
        assert sorted(r.text.replace("[p]", " ").replace("[s]", " ").replace("[m]", " ").split()) == ["four", "one", "three", "two"]
    assert op12.fill_in_middle_report(docs.limit(0)).collect() == []


# ---- lattice scores


def segmentations(lat, x):
    if not x:
        yield []
    for j in range(1, len(x) + 1):
        if x[:j] in lat.pieces:
            yield from ([lat.pieces[x[:j]], *rest] for rest in segmentations(lat, x[j:]))


def test_lattice_sums_all_segmentations(monkeypatch):
    lat = op11.lattice(PIECES)
    logq = np.log(lat.prior)
    words = [w.encode() for w in ("the", "nation", "ß漢字x", "", "▁▁", "\U000f0041q")] + [b"\xff\xfea"]
    weight = np.array([1.0, 2, 3, 4, 5, 6, 7])
    z, counts = lat.run(words, logq, weight)
    want = np.zeros(len(logq))
    for w, k, got in zip(words, weight, z, strict=True):
        paths = list(segmentations(lat, lat.symbols(w)))
        p = np.array([math.exp(logq[path].sum()) for path in paths])
        assert got == pytest.approx(math.log(p.sum()), rel=1e-12)
        for path, share in zip(paths, p / p.sum(), strict=True):
            np.add.at(want, path, k * share)
    assert np.allclose(counts, want)
    monkeypatch.setattr(op11, "LONG", 2)  # every word by its own recursion
    z2, counts2 = lat.run(words, logq, weight)
    assert np.allclose(z, z2) and np.allclose(counts, counts2)


def test_words_of_a_slice_are_counted_once_each():
    texts = [b"The the\tTHE cat", None, b"", b" \n ", b"\xc3\x89T\xc3\xa9 cat\x0b\xff\xfe the", b"\xe3\x80\x80 a\xc2\xa0b", b" the "]
    at, words, number = op11.coded(pa.array(texts, pa.binary()).slice(0, 7))
    got = [[] for _ in texts]
    for i, k in zip(at.tolist(), number.tolist(), strict=True):
        got[i].append(words[k].as_py())
    assert got == [(t or b"").lower().split() for t in texts] and len(set(words.to_pylist())) == len(words)
    known = (pa.array([b"the", b"cat"]), np.array([1.0, 2.0]), np.array([1, 0]), np.array([-1.0, -3.0]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.binary())], ["id", "text"])
    rows = [r for b in op11._parts(SimpleNamespace(value=known))([batch]) for r in b.to_pylist()]
    own = {r["id"]: (r["n"], r["known"], r["logc"], r["lp"]) for r in rows if r["word"] is None}
    assert own == {0: (4, 3, 5.0, -6.0), 1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0), 4: (4, 1, 3.0, -4.0), 5: (2, 0, 0, 0), 6: (1, 1, 1.0, -1.0)}
    rare = sorted((r["id"], r["word"], r["n"]) for r in rows if r["word"] is not None)
    assert rare == [(4, b"\xc3\x89t\xc3\xa9", 1), (4, b"\xff\xfe", 1), (5, b"a\xc2\xa0b", 1), (5, b"\xe3\x80\x80", 1)]


def test_very_long_word_has_its_full_lattice():
    lat = op11.lattice(PIECES)
    logq = np.log(lat.prior)
    word = b"anation" * 3000
    alone = lat.run([word], logq)[0][0]
    assert alone == pytest.approx(lat.batch([lat.symbols(word)], logq, None)[0][0], rel=1e-9)


def test_model_is_a_distribution():
    """Shares of all training words by the whole way, the pieces' way and the end make 1."""
    c = np.array([5.0, 1, 1, 1, 2, 2])
    m = op11.Model(6, 3, 2, int(c.sum()), 4, np.zeros(1))
    whole = (10 ** m.word(c, np.full(6, -np.inf))).sum()
    assert whole + math.exp(m.log_back) + math.exp(m.log_end) == pytest.approx(1)


def plain_scores(rows, logq):
    """The same model without Spark."""
    lat = op11.lattice(PIECES)
    out = [None if i is None else zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    words = [(t or "").encode().lower().split() for _, t in rows]
    c = Counter(w for held, ws in zip(out, words, strict=True) if not held for w in ws)
    ends = sum(not held for held in out)
    once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
    m = op11.Model(len(c), once, twice, sum(c.values()), ends, logq)
    for (i, _), held, ws in zip(rows, out, words, strict=True):
        z, _ = lat.run(ws, logq) if ws else (np.zeros(0), None)
        cs = np.array([c[w] for w in ws], float)
        base = sum(math.log10((k + 1) / (m.n_tokens + m.types + 1)) for k in [*cs, ends])
        yield i, bool(held), len(ws) + 1, int((cs > 0).sum()) + (ends > 0), m.n_tokens, base, m.word(cs, z).sum() + m.log_end / math.log(10)


ODD = ["The cat and THE hat", "the cat", None, "", " \t\n", "É é ǅ the", "x" * 9000, "nation " * 4000, "the cat", "\x1cthe\x85cat"]


@pytest.mark.parametrize("hot", [0, 3, 100_000])
def test_scores_against_plain_python(spark, hot):
    rows = [(i, t) for i in range(6) for t in ODD] + [(None, "the null id"), (None, "the null id"), (None, None), (3, "the cat"), (-9, "fresh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit("c"))
    got = op11.lattice_scores(docs, PIECES, hot=hot, rounds=1).collect()
    c = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in (t or "").encode().lower().split())
    lat = op11.lattice(PIECES)
    n = op11.PRIOR * lat.prior + lat.run(list(c), np.log(lat.prior), np.ones(len(c)))[1]
    want = sorted(plain_scores(rows, np.log(n / n.sum())), key=str)
    got = sorted(map(tuple, got), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_scores_of_nothing_and_without_training(spark):
    docs = spark.createDataFrame([(i, "the cat") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert op11.lattice_scores(docs.limit(0), PIECES).collect() == []
    for r in op11.lattice_scores(docs, PIECES).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
        assert -30 < r.score < 0


# ---- hard negatives


def plain_negatives(rows, every=50):
    """rows: (id, vec, label) -> the contract's rows, by all pairs."""
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, q, y) in enumerate(fine):
        if a is None or a % every:
            continue
        met = [(sum(s * t for s, t in zip(q, w, strict=True)), i, z) for j, (i, w, z) in enumerate(fine) if j != k and len(w) == len(q)]
        met.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        for p, i, _ in [r for r in met if r[2] == y][:5]:
            inside = [r for r in met if r[2] != y and 50 * p <= 100 * r[0] <= 95 * p]
            out += [(a, i, n + 1, j, p, s) for n, (s, j, _) in enumerate(inside[:3])]
    return Counter(out)


@pytest.mark.parametrize("sizes", [(512, 16_384), (2, 7)])
def test_negatives_against_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(op13, "ANCHORS", sizes[0])
    monkeypatch.setattr(op13, "ROWS", sizes[1])
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(0.4, 1, 12).round(2).tolist(), int(rng.integers(0, 3))) for i in range(0, 1200, 5)]
    rows += [(i, [0.5] * 12, i % 3) for i in range(2000, 2040)]  # ties
    rows += [(50, [1.0] * 12, 1), (50, [1.0] * 12, 1), (None, [1.0] * 12, 1), (None, [0.9] * 12, 2), (-100, [-1.0] * 12, 0), (100, None, 1), (150, [1.0] * 12, None)]
    rows += [(200, [float("nan")] * 12, 1), (201, [float("inf"), *[0.0] * 11], 2), (202, [None, *[1.0] * 11], 2), (250, [0.0] * 12, 2), (300, [2.0, 1.0], 1), (301, [2.0, 1.5], 1), (302, [1.0, 1.4], 2), (350, [], 1), (351, [], 1), (352, [], 2)]
    rows += [(400, [2e6] * 12, 1), (401, [1.9e6] * 12, 1), (402, [1e6, *[1.5e6] * 11], 2)]  # longer than doubles hold exactly
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("q", F.lit("mine")).withColumn("row", F.lit(0))
    got = Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in op13.hard_negatives(vectors).collect())
    # of rows that repeat an id and a content, either may stand in an anchor's place: ids and scores are the same
    assert got == plain_negatives(rows)


def test_negatives_of_nothing_of_one_label_and_too_long_rows(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.5], 1) for i in range(60)] + [(100, [1e30, 1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert op13.mined_negatives(vectors.limit(0)).collect() == []
    assert op13.hard_negatives(vectors).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 6), st.booleans())
def test_scan_loses_no_candidate(seed, k, few):
    rng = np.random.default_rng(seed)
    q = rng.integers(-3 if few else -300, 4 if few else 300, (200, 24))
    a = rng.integers(-300, 300, 24)
    block, true = op13.Block(q), q @ a
    rows, score = block.scan(a, np.ones(200, bool), op13.among_best(k))
    assert (score == true[rows]).all()
    assert sorted(score)[-k:] == sorted(true)[-k:] and set(np.flatnonzero(true >= sorted(true)[-k])) <= set(rows)
    lo, hi = sorted(rng.integers(true.min(), true.max() + 1, 2))
    rows, score = block.scan(a, np.ones(200, bool), op13.in_windows([(lo, hi)], k))
    inside = np.sort(true[(true >= lo) & (true <= hi)])[-k:]
    assert (np.sort(score[(score >= lo) & (score <= hi)])[-k:] == inside).all()
    if len(inside):
        assert set(np.flatnonzero((true >= inside[0]) & (true <= hi))) <= set(rows)
