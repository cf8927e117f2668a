import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from clauseloom.llm import op1_sharding as op1
from clauseloom.llm import op2_toxicity as op2
from clauseloom.llm import op3_line_quality as op3
from clauseloom.llm import op4_mixing as op4


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2.0) for r in rows], "doc_id long, text string, source string, lang string, size string, shard int, target double")


def rows_of(n=400, seed=0):
    rng = np.random.default_rng(seed)
    names = ["a"] * 12 + ["b", "c", "Z", None, "é"]
    return [(i, " ".join(f"w{rng.integers(500)}" for _ in range(int(rng.integers(0, 120)))), names[int(rng.integers(len(names)))], "en") for i in range(n)] + [(900, None, "a", "en"), (901, " \n ", "q", "en")]


def targets(sizes):
    """The reshared targets, by repetition."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, out = 1.5 * sum(sizes.values()), {}
    while True:
        open_w = sum(w[s] for s in order if s not in out)
        rest = total - sum(out.values())
        over = [s for s in order if s not in out and rest * w[s] / open_w > 2 * sizes[s]]
        if not over:
            return out | {s: rest * w[s] / open_w for s in order if s not in out}
        out |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [7, 128])
def test_mix_meets_targets(spark, block):
    rows = rows_of()
    got = op4.mix_report(frame(spark, rows), block=block, shard_slots=16).collect()
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    per = Counter()
    for i, _, s, _ in rows:
        per[s] += size[i]
    want = targets(per)
    src = {i: s for i, _, s, _ in rows}
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == per[src[r.doc_id]] and r.target == pytest.approx(want[src[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        taken[src[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in per)
    assert sorted(map(tuple, op4.mix_report(frame(spark, rows).repartition(3), block=block, shard_slots=16).collect())) == sorted(map(tuple, got))


def test_slots_fill_shards_without_overlap(spark):
    rows = rows_of(200, 1)
    plan_rows, spans = op4.mix_plan(frame(spark, rows), block=16, shard_slots=8)
    by = {}
    for s in spans.collect():
        by.setdefault((s.shard, s.slot), []).append((s.place, s.word_to - s.word_from))
    shards = Counter(k for k, _ in by)
    assert set(Counter(shards.values())) <= {8, min(shards.values())} and len(shards) > 5
    for parts in by.values():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n
        assert at <= 16


def test_mixed_documents(spark):
    rows = [*rows_of(150, 2), (0, rows_of(150, 2)[0][1], rows_of(150, 2)[0][2], "en")]
    report = {}
    for r in op4.mix_report(frame(spark, rows)).collect():
        report[r.doc_id] = report.get(r.doc_id, 0) + r.taken
    mixed = op4.mix_documents(frame(spark, rows))
    assert mixed.columns == frame(spark, []).columns
    words = Counter()
    text = {i: Counter((t or "").split()) for i, t, *_ in rows}
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert not Counter(r.text.split()) - text[r.doc_id]
    assert {k: v for k, v in report.items() if v} == dict(words)
    assert op4.mix_report(frame(spark, [])).collect() == []


def test_mix_keeps_the_callers_columns(spark):
    rows = rows_of(40, 6)
    docs = frame(spark, rows).selectExpr("*", "'t' AS _tie", "'c' AS _copy", "'m' AS _mixed", "'o' AS _of", "'n' AS _new")
    got = op4.mix_documents(docs)
    assert got.columns == docs.columns
    assert {(r._tie, r._copy, r._mixed, r._of, r._new) for r in got.collect()} == {("t", "c", "m", "o", "n")}


def test_draws_beyond_the_generators_range():
    """Mean and variance of the multivariate hypergeometric law for more slots than the generator takes at once."""
    counts, n = np.array([3 << 30, 1 << 30, 1000, 7], np.int64), (1 << 31) - 12345
    total = int(counts.sum())
    for left in (n, total - n, 900, total - 900):
        got = np.array([op4.draw(counts, left, np.random.default_rng([left, k])) for k in range(400)])
        assert (got.sum(1) == left).all() and (got >= 0).all() and (got <= counts).all()
        p = counts / total
        mean, var = left * p, left * p * (1 - p) * (total - left) / (total - 1)
        assert (np.abs(got.mean(0) - mean) <= 4.5 * np.sqrt(var / 400) + 1e-9).all()
        seen = var > 1  # rarer colours never come in 400 draws
        assert (np.abs(got.var(0) / var - 1)[seen] < 0.45).all() and seen.sum() >= 2
    small = np.array([op4.draw(np.array([6, 4]), 5, np.random.default_rng(k))[0] for k in range(50)])
    assert small.min() >= 1 and small.max() <= 5


def test_draws_over_many_sources(spark, monkeypatch):
    """Pages of sources: every slot of every source is drawn once, shards are full, and small ranges give the same law at any size."""
    monkeypatch.setattr(op4, "PAGE", 64)
    monkeypatch.setattr(op4, "DIRECT", 100)
    rows = [(k, int(k % 37) * 11, float(k % 37) * 11 * (1.5 if k % 2 else 2)) for k in range(1000)]
    targets = spark.createDataFrame(rows, "no long, source_size long, target double")
    got = op4.mix_slots(targets, block=8, shard_slots=32).toPandas()
    full = got.groupby("shard").size()
    assert (full.iloc[:-1] == 32).all() and len(got.drop_duplicates(["shard", "slot"])) == len(got)
    assert len(got.drop_duplicates(["no", "epoch", "block_no"])) == len(got)
    for no, mine in got.groupby("no"):
        _, size, target = rows[no]
        words = np.minimum(8, size - 8 * mine["block_no"]).sum() - mine["cut"].sum()
        assert words == min(round(target), 2 * size)
    assert set(got["no"]) == {no for no, size, _ in rows if size}


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        p = op4._permute(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n)) and all(op4._position(int(v), n, 5) == k for k, v in enumerate(p[:50]))


def shard_check(got, rows, limit):
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
        assert r.alone or r.shard_bytes <= limit
    assert all(r.shard_bytes == sizes[r.shard] for r in got)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes) for r in got) == sorted((i is None, i or 0, len((t or "").encode())) for i, t, *_ in rows)


def test_shards_fit_and_split_only_where_needed(spark):
    rows = [*rows_of(500, 3), (777, "x" * 5000, "a", "en"), (None, "n" * 10, None, None)]
    got = op1.shard_rows(frame(spark, rows), shard_bytes=2000).collect()
    shard_check(got, rows, 2000)
    plain = {r.shard for r in got if not r.alone}
    parents = {s[:-1] for s in plain}
    by_prefix = lambda p: sum(r.n_bytes for r in got if not r.alone and r.shard.startswith(p))
    assert all(by_prefix(p) > 2000 for p in parents)  # a parent was split because it didn't fit
    assert [r.shard for r in got if r.alone and r.doc_id == 777] and len(plain) > 8
    assert op1.shard_rows(frame(spark, [])).collect() == []


def test_equal_keys_chain(spark):
    rows = [(5, "y" * (10 + i % 90), "a", "en") for i in range(300)] + [(i, "z" * 50, "a", "en") for i in range(100, 140)]
    for bits in (60, 3):
        got = op1.shard_rows(frame(spark, rows), shard_bytes=400, hash_bits=bits).collect()
        shard_check(got, rows, 400)


def labelled(spark, n=900):
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(n):
        words = [f"{'abcdefgh'[rng.integers(8)]}{rng.integers(300)}" for _ in range(int(rng.integers(5, 60)))]
        toxic = i % 5 == 0
        if toxic:
            for k in rng.choice(len(words), 2):
                words[k] = "vile" + "xyz"[rng.integers(3)]
        good = i % 3 != 0
        lines = [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
        if not good:
            lines = [x.upper().replace(" ", "!! ") + "!!" for x in lines]
        docs.append((i, "\n".join(lines), "s", "de" if i % 4 else "en"))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, "s", "en"), (n + 1, "", None, None), (n + 2, "v " * 30_000, "s", "en"), (None, "no id", None, None)]
    return frame(spark, docs), spark.createDataFrame([*labels, (0, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def accuracy(got, labels, name, fold, out):
    y = {r.doc_id: r[name] for r in labels.collect() if r[name] is not None}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % fold == out) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    return sum(r.predicted == y[r.doc_id] for r in held) / len(held)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = op2.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and accuracy(got, labels, "toxic", 4, 2) > 0.95
    kept = op2.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    toxic = {r.doc_id for r in labels.collect() if r.toxic}
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) < 10
    none = op2.toxicity_scores(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert op2.toxicity_scores(docs.limit(0), labels).collect() == []


def test_every_language_has_a_threshold_from_all_its_labels(spark):
    """One vile word is toxic in English, three are in the rarer language, of which a sample of 200 holds few toxic rows."""
    rng, rows = np.random.default_rng(8), []
    for i in range(4000):
        rare, vile = i % 20 == 0, int(rng.integers(4)) if i % 3 == 0 else 0
        words = [f"w{k}" for k in rng.integers(300, size=30)] + [f"vile{k}" for k in range(vile)]
        rows.append((i, " ".join(words), "s", "es" if rare else None if i % 20 == 1 else "en", int(vile == 3 if rare else vile > 0)))
    docs, labels = frame(spark, [r[:4] for r in rows]), spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, toxic int")
    model = op2.train(docs, labels, rows=200)
    got = {r.doc_id: r for r in op2.toxicity_scores(docs, labels, model=model).collect()}
    cuts = {r.lang: r.cut for r in model.thresholds.collect()}
    assert set(cuts) == {"en", "es"} and cuts["es"] > cuts["en"]
    assert {r.threshold for i, r in got.items() if rows[i][3] is None} == {model.threshold}
    assert {r.threshold for i, r in got.items() if rows[i][3] == "es"} == {cuts["es"]}
    # the labels that the thresholds come from: all outside the held-out fold that the fit did not see
    y = {i: t for i, *_, t in rows if not got[i].held_out and i not in set(model.fit_ids)}
    assert len(model.fit_ids) == 160 and len(y) > 2500
    f1 = lambda cut: 2 * sum(t for i, t in y.items() if got[i].score >= cut) / (sum(y.values()) + sum(got[i].score >= cut for i in y))
    assert f1(model.threshold) >= max(f1(got[i].score) for i in list(y)[::10]) - 0.005


def test_quality(spark):
    docs, labels = labelled(spark)
    got = op3.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and accuracy(got, labels, "quality", 5, 0) > 0.95
    assert len({r.score for r in op3.quality_scores(docs, labels.limit(0)).collect()}) == 1
    assert op3.quality_scores(docs.limit(0), labels).collect() == []
    lines = op3.line_labels(docs.where("doc_id < 30"), op3.train(docs, labels))
    assert lines.where("doc_id = 0 and good").isEmpty() and not lines.where("doc_id = 1 and good").isEmpty()


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    emit, n_lines, trans, first = rng.standard_normal(9), np.array([4, 0, 3, 2]), rng.standard_normal((2, 2)), rng.standard_normal(2)
    got, _, _ = op3.forward_backward(emit, n_lines, trans, first)
    at = 0
    for n in n_lines:
        w = np.zeros((n, 2))
        for code in range(2**n if n else 0):
            y = [code >> k & 1 for k in range(n)]
            p = np.exp(first[y[0]] + sum(emit[at + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            for k in range(n):
                w[k, y[k]] += p
        if n:
            assert np.allclose(got[at : at + n], w / w.sum(1, keepdims=True))
        at += n


def test_lines_of_the_other_kind_are_found(spark):
    """Lines planted in documents of the other kind, which no label names, are labelled one by one."""
    docs, labels = labelled(spark)
    field = op3.train(docs, labels)
    rng, texts, truth = np.random.default_rng(12), [], []
    for k in range(60):
        lines = [(" ".join(f"{'abcdefgh'[rng.integers(8)]}{rng.integers(300)}" for _ in range(8)), 1 - k % 2) for _ in range(int(rng.integers(6, 14)))]
        for at in rng.choice(len(lines), 2, replace=False):
            lines[at] = (lines[at][0], k % 2)
        texts.append("\n".join(x if good else x.upper().replace(" ", "!! ") + "!!" for x, good in lines))
        truth += [good for _, good in lines]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.good for r in op3.line_labels(rows, field).orderBy("doc_id", "line_no").collect()]
    same = np.array(got) == np.array(truth, bool)
    assert same.mean() > 0.9


def test_logits_are_the_convolution():
    """The tables' shifted sums and maxima against embeddings, filters and maxima spelled out."""
    rng, model = np.random.default_rng(3), op2.Model()
    model.U, model.c = rng.standard_normal(len(model.U)), 0.3
    texts = ["", "one", "one two", "some words that go on, and on; even Further!", "x " * 500]
    ids = [op2.word_ids(t) for t in texts]
    want = []
    for raw in ids:
        keys = np.frombuffer(raw, "<i4").reshape(-1, op2._KEYS)
        emb = np.concatenate([model.E[keys].sum(1), np.zeros((op2._PAD, op2.DIM))])
        emb = np.concatenate([emb, np.zeros((1, op2.DIM))]) if not len(keys) else emb
        feats = []
        for w in op2.WIDTHS:
            conv = [sum(emb[i + j] @ model.W[w][j] for j in range(w) if i + j < len(emb)) for i in range(len(keys) + 1)]
            feats.append(np.maximum(np.max(conv, axis=0) + model.B[w], 0))
        want.append(np.concatenate(feats) @ model.U + model.c)
    assert np.allclose(op2.logits(model.tables(), ids), want, atol=1e-4) and np.allclose(op2.logits(model.tables(), ids, words=1), want, atol=1e-4)


def test_clashing_columns_pass_through(spark):
    docs, labels = labelled(spark, 200)
    docs = docs.selectExpr("*", "1 AS _y", "2 AS _id", "3 AS _score", "4 AS _text", "5 AS bin", "6 AS n", "7 AS score")
    kept = op2.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {(r._y, r._id, r._score, r.score) for r in kept.collect()} == {(1, 2, 3, 7)}
    assert op3.quality_scores(docs, labels).count() == docs.count()


def test_toxic_rows_go_by_narrow_keys(spark, monkeypatch):
    docs, labels = labelled(spark, 200)
    more = docs.where("doc_id < 20").withColumn("lang", F.lit(None).cast("string")).unionByName(docs.where("doc_id < 10")).unionByName(docs.where("doc_id < 30").withColumn("text", F.lit("other words")))
    docs, tables, settle = docs.unionByName(more), {}, op2.settle
    monkeypatch.setattr(op2, "settle", lambda df, label: (out := settle(df, label), tables.setdefault(label, out))[0])
    kept = Counter(r.doc_id for r in op2.drop_toxic(docs, labels).collect())
    assert "text" not in tables["scored"].columns and tables["scored"].count() == docs.count()
    assert kept == Counter(r.doc_id for r in op2.toxicity_scores(docs, labels).collect() if not r.toxic) and sum(kept.values()) < docs.count()


def test_a_mix_of_100000_equal_rows(spark):
    """Rows that repeat an id and a text are numbered in parts, and each is taken at most twice."""
    n = 100_000
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"), F.col("id").alias("_row"))
    docs = docs.unionByName(spark.createDataFrame([(1, "four five", "t", -1), (None, None, "s", -2), (None, "", None, -3)], "doc_id long, text string, source string, _row long"))
    report = op4.mix_report(docs).groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most"), F.max("target").alias("target")).collect()
    got = {(r.doc_id, r.size): r for r in report}
    assert got[None, 3].n == n and got[None, 0].n == 2 and got[1, 2].n == 1
    assert got[None, 3].taken == round(got[None, 3].target) and got[None, 3].most <= 6
    mixed = op4.mix_documents(docs)
    assert mixed.columns == docs.columns
    per_row = mixed.where("source = 's'").groupBy("_row").agg(F.sum(F.size(F.split("text", " "))).alias("w")).agg(F.sum("w"), F.max("w"), F.count(F.lit(1))).first()
    assert per_row[0] == got[None, 3].taken and per_row[1] <= 6
