import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseloom.operators import curation, evaluation, rewrites, scoring, status


def predictions(spark, matrix):
    rows = [("m", g, p) for g, r in enumerate(matrix) for p, n in enumerate(r) for _ in range(n)]
    return spark.createDataFrame(rows, "model string, gold_label_id int, pred_label_id int")


def test_published_matrix(spark):
    df = predictions(spark, [(145, 11, 2), (4, 360, 3), (1, 0, 196)])
    m = evaluation.metrics(df, ["model"]).first()
    assert (m.accuracy, m.macro_f1, m.recall_contradiction, m.f1_contradiction) == (0.970914, 0.967364, 0.917722, 0.941558)
    c = evaluation.confusion(df, ["model"]).orderBy("gold_label_id").collect()
    assert [tuple(r)[2:] for r in c] == [(145, 11, 2), (4, 360, 3), (1, 0, 196)]


def test_absent_labels_count_zero(spark):
    m = evaluation.metrics(predictions(spark, [(2, 0, 0)]), ["model"]).first()
    assert (m.accuracy, m.f1_neutral, m.support_neutral) == (1.0, 0.0, 0)
    assert len(evaluation.confusion(predictions(spark, [(2, 0, 0)]), ["model"]).collect()) == 3


def test_class_weights(spark):
    rows = [(0,)] * 537 + [(1,)] * 1420 + [(2,)] * 710
    w = {r.label: r.weight for r in curation.class_weights(spark.createDataFrame(rows, "gold_label_id int")).collect()}
    assert w == pytest.approx({"contradiction": 2.483240223463687, "entailment": 0.6260563380281691, "neutral": 1.2521126760563381})


def test_gold_labels(spark):
    cases = {" Entailment ": 1, "2": 2, "1.0": 1, "1.5": None, "3": None, "1.0d": None, "nan": None, "": None, "NEUTRAL": 2}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(curation.gold_label_id(F.col("v"))).collect()] == list(cases.values())


def test_validation_limits(spark):
    df = spark.createDataFrame([("a", ""), ("b", "  "), ("c", "x" * 20_000), ("d", "x" * 20_001), ("e", "é"), ("f", None)], "provision_id string, text string")
    ok, bad = curation.validate_provisions(df)
    assert {r.provision_id: len(r.text) for r in ok.collect()} == {"c": 20_000, "e": 1}
    assert {r.provision_id: r.reason for r in bad.collect()} == {"a": "blank", "b": "blank", "d": "too_long", "f": "blank"}


def test_leakage(spark):
    e = spark.createDataFrame([("a", " P  x", "H", "1", "e", "s"), ("b", "p", "h", "0", None, "s"), ("c", "p", "h", "0", None, "s")], "nli_id string, premise string, hypothesis string, gold_label string, error_type string, split string")
    t = spark.createDataFrame([("p x", "h"), ("p x", "h")], "premise string, hypothesis string")
    assert [r.nli_id for r in curation.leaked_rows(e, t).collect()] == ["a"]
    kept = curation.remove_leakage(e, t)
    assert sorted(r.nli_id for r in kept.collect()) == ["b", "c"] and curation.leaked_rows(kept, t).isEmpty()
    rep = {(r.level, r.value): (r.n_before, r.n_removed) for r in curation.leakage_report(e, t).collect()}
    assert rep == {("all", None): (3, 1), ("label", "1"): (1, 1), ("label", "0"): (2, 0), ("error_type", "e"): (1, 1), ("error_type", "(none)"): (2, 0)}


def test_softmax_and_reasons(spark):
    df = scoring.with_nli_label(spark.createDataFrame([(1.0, 5.0, 0.5), (2.0, 2.0, 1.0)], "l0 double, l1 double, l2 double"))
    a, b = df.collect()
    assert a.raw_label == "entailment" and a.label == "supported" and math.isclose(a.confidence, math.exp(4) / (math.exp(4) + 1 + math.exp(-0.5)))
    assert b.raw_label == "contradiction" and b.label == "unsupported"
    rows = [(0.2, 0.5, 0.3, 0.5, None), (0.2, 0.5, 0.4, 0.5, "bad_sum"), (float("nan"), 0.5, 0.3, 0.5, "not_finite"), (-0.1, 0.8, 0.3, 0.8, "out_of_range"), (0.2, 0.5, 0.3, 0.4, "confidence_mismatch")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double, d double, w string").orderBy("i")
    assert [r[0] for r in got.select(scoring.probs_reason(*map(F.col, "abcd"))).collect()] == [r[-1] for r in rows]


def test_scorer_failures_stay_alone(spark):
    def make():
        def score(ev, cl):
            if "bad" in cl:
                raise ValueError("no")
            return np.array([[1.0, float("nan") if c == "nan" else 2.0, 0.0] for c in cl])

        return score

    def broken():
        raise OSError("no model")

    df = spark.createDataFrame([("e", "a"), ("e", "bad"), ("e", "nan"), (None, "x")], "evidence_text string, claim_text string").coalesce(1)
    assert [r.error for r in scoring.batch_score(df, make).collect()] == [None, "inference_failed", "invalid_output", None]
    assert [r.error for r in scoring.batch_score(df, broken).collect()] == ["model_unavailable"] * 3 + [None]


def test_generator_retries(spark):
    def make():
        seen = {}

        def say(t):
            seen[t] = seen.get(t, 0) + 1
            if t == "busy" and seen[t] == 1:
                raise ConnectionError("again")
            if t == "wrong":
                raise ValueError("never")
            return t.upper()

        return say

    df = spark.createDataFrame([("ok",), ("busy",), ("wrong",)], "t string").coalesce(1)
    assert [(r.output, r.attempts) for r in scoring.batch_generate(df, make, "t").collect()] == [("OK", 1), ("BUSY", 2), (None, 1)]


def test_status_order(spark):
    runs = spark.createDataFrame([("a", "success", "success", "success"), ("b", "success", "failed", "success"), ("c", "success", "success", "success")], "run_id string, span_status string, simplify_status string, claim_status string")
    claims = spark.createDataFrame([("a", "e", "lexical_overlap", False, None, ["zero_lexical_overlap"], None), ("c", "e", "lexical_overlap", True, None, None, None)], "run_id string, evidence_text string, evidence_method string, evidence_ambiguity boolean, verification_reason string, extraction_warnings array<string>, verification_warnings array<string>")
    got = {r.run_id: (r.overall, r.evidence_status) for r in status.overall_status(status.stage_status(claims, runs)).collect()}
    assert got == {"a": ("success", "success"), "b": ("failed", "skipped"), "c": ("partial", "ambiguous")}


def test_rewrites(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat"), ("the cat sat on", "a cat on"), ("", "x"), (None, "x"), ("a", "b")], "a string, b string").coalesce(1)
    got = [r[0] for r in df.select(rewrites.rouge_l(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(2 * 2 / 7) and got[2:] == [None, None, 0.0]
    one = spark.createDataFrame([("The cat sat on the mat.",)], "t string").select(rewrites.fkgl(F.col("t")), rewrites.ari(F.col("t"))).first()
    assert one[0] == pytest.approx(0.39 * 6 + 11.8 - 15.59) and one[1] == pytest.approx(4.71 * 17 / 6 + 3 - 21.43)


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=90), st.lists(st.sampled_from("abcdef"), max_size=90))
def test_common_subsequence_by_bits(a, b):
    assert rewrites._lcs(a, b) == table_lcs(a, b)


def test_common_subsequence_of_10000_words():
    rng = random.Random(1)
    a, b = ([f"w{rng.randrange(300)}" for _ in range(10_000)] for _ in range(2))
    start = time.perf_counter()
    rewrites._lcs(a, b)
    assert time.perf_counter() - start < 0.1  # about 10 ms on an idle core
    assert rewrites._lcs(a, a) == 10_000


def plain_counts(t):
    """The four counts by patterns, one word at a time."""
    words = re.findall(r"(?:[^\W_]|')+", t)
    syllables = 0
    for w in words:
        n = len(re.findall("[aeiouy]+", w))
        if len(w) > 1 and w.endswith("e") and w[-2] not in "aeiouy":
            n -= 1
        syllables += max(n, 1)
    sentences = len(re.findall(r"[.!?]+(?=[ \t\n\x0b\f\r]|[\x85\u2028\u2029]?\Z)", t))
    return [max(sentences, 1), len(words), sum(c.isalnum() for c in t), syllables]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["e", "the", "a", "y", "rhythm", "'", "1", "é", "ß", "漢", ".", "?!", " ", "\n", "\x85", "_", "😀", "table", "ee"]), max_size=14).map("".join), max_size=6))
def test_counts_of_texts_by_one_scan(texts):
    if texts:
        assert rewrites.scan_counts(texts).tolist() == [plain_counts(t) for t in texts]
