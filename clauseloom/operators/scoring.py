"""Model scores to labels, and hooks for models that the caller brings."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The canonical labels by id, what they mean for a claim, codes worth another call, limits.
LABELS = ("contradiction", "entailment", "neutral")
MEANING = {"entailment": "supported", "contradiction": "unsupported"}
TRANSIENT = (429, 500, 502, 503, 504)
MAX_LENGTH, SPECIAL_TOKENS = 512, 3
SUM_TOLERANCE, MAX_TOLERANCE = 1e-3, 1e-6

#: make_scorer() loads a model and returns score(evidence, claims) -> array of three logits a row.
MakeScorer = Callable[[], Callable[[list[str], list[str]], np.ndarray]]


def claim_label(raw: Column) -> Column:
    """supported, unsupported, or uncertain for anything else."""
    low = F.lower(F.trim(raw))
    out = F.lit("uncertain")
    for k, v in MEANING.items():
        out = F.when(low == k, v).otherwise(out)
    return out


def probs_reason(p0: Column, p1: Column, p2: Column, confidence: Column) -> Column:
    """Why three probabilities and a confidence are no valid output; null for a valid one."""
    ps = [p0, p1, p2]
    lost = p0.isNull() | p1.isNull() | p2.isNull() | confidence.isNull()
    wild = out = F.lit(False)
    for p in (*ps, confidence):
        wild = wild | F.isnan(p) | (F.abs(p) == float("inf"))
        out = out | (p < 0) | (p > 1)
    return (
        F.when(lost, "missing")
        .when(wild, "not_finite")
        .when(out, "out_of_range")
        .when(F.abs(p0 + p1 + p2 - 1) > SUM_TOLERANCE, "bad_sum")
        .when(F.abs(confidence - F.greatest(*ps)) > MAX_TOLERANCE, "confidence_mismatch")
    )


def with_nli_label(df: DataFrame, l0: str = "l0", l1: str = "l1", l2: str = "l2") -> DataFrame:
    """df with prob_* of the logits' softmax, confidence, raw_label (the first of equals) and label."""
    ls = [F.col(x).cast("double") for x in (l0, l1, l2)]
    top = F.greatest(*ls)
    es = [F.exp(x - top) for x in ls]
    probs = [(e / (es[0] + es[1] + es[2])).alias(f"prob_{k}") for e, k in zip(es, LABELS, strict=True)]
    with_p = df.select("*", *probs)
    ps = [F.col(f"prob_{k}") for k in LABELS]
    raw = F.when((ps[0] >= ps[1]) & (ps[0] >= ps[2]), LABELS[0]).when(ps[1] >= ps[2], LABELS[1]).otherwise(LABELS[2])
    return with_p.select("*", F.greatest(*ps).alias("confidence"), raw.alias("raw_label"), claim_label(raw).alias("label"))


def label_order(model_labels: DataFrame) -> DataFrame:
    """model -> order: native positions (from 1) of the canonical labels; null unless each is named exactly once."""
    low = model_labels.withColumn("label", F.lower(F.trim("label")))
    per = low.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("label")).alias("names"), F.collect_list(F.struct("label", (F.col("native_idx") + 1).alias("i"))).alias("at")
    )
    fine = (F.col("n") == len(LABELS)) & (F.col("names") == F.array(*[F.lit(x) for x in LABELS]))
    place = lambda k: F.filter("at", lambda x: x["label"] == k)[0]["i"]
    return per.select("model", F.when(fine, F.array(*map(place, LABELS))).alias("order"))


def canonical_probs(scores: DataFrame, model_labels: DataFrame) -> DataFrame:
    """scores (model, probs array in the model's order) with prob_* in canonical order; null where a model's labels are unusable."""
    # One row per model; the label table is small by nature, and Spark picks the join.
    met = scores.join(label_order(distinct_labels(model_labels)), "model", "left")
    return met.select(*scores.columns, *[F.try_element_at("probs", F.col("order")[i].cast("int")).alias(f"prob_{k}") for i, k in enumerate(LABELS)])


def distinct_labels(model_labels: DataFrame) -> DataFrame:
    return model_labels.dropDuplicates(["model", "native_idx"])


def pair_length(df: DataFrame, counter: Column | None = None) -> DataFrame:
    """df with n_tokens of (premise, hypothesis): words and marks plus the special tokens of a pair, unless a counter is given."""
    rule = r"(?U)[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
    default = F.regexp_count(F.coalesce("premise", F.lit("")), F.lit(rule)) + F.regexp_count(F.coalesce("hypothesis", F.lit("")), F.lit(rule)) + SPECIAL_TOKENS
    return df.withColumn("n_tokens", default if counter is None else counter)


def length_gate(df: DataFrame, max_length: int = MAX_LENGTH) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, rows that don't); nothing is truncated."""
    over = F.col("n_tokens") > max_length
    return df.where(~over), df.where(over)


def length_stats(df: DataFrame, by: str = "dataset", max_length: int = MAX_LENGTH) -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("n_tokens").alias("max_tokens"), F.avg("n_tokens").alias("avg_tokens"), F.count_if(F.col("n_tokens") > max_length).alias("n_over")
    )


def verify_reason(evidence: Column, error: Column) -> Column:
    """Reason a claim stays unverified; null where a label stands."""
    return (
        F.when(F.coalesce(evidence, F.lit("")) == "", "no_evidence")
        .when(error == "model_unavailable", "nli_model_unavailable")
        .when(error == "input_too_long", "nli_input_too_long")
        .when(error == "invalid_output", "nli_invalid_output")
        .when(error.isNotNull(), "nli_inference_failed")
    )


def batch_score(df: DataFrame, make_scorer: MakeScorer, batch_size: int = 16, evidence: str = "evidence_text", claim: str = "claim_text") -> DataFrame:
    """df with l0, l1, l2 and error from a scorer that each worker loads once.

    A scorer that can't be loaded marks the rows; a batch that fails is scored row
    by row, so one bad row leaves its neighbours alone. Rows without evidence are
    not sent.
    """
    cols = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, broken = None, False
        for f in frames:
            out = f.copy()
            scores, errors = np.full((len(f), 3), np.nan), np.full(len(f), None, object)
            todo = np.flatnonzero(f[evidence].fillna("").to_numpy() != "")
            if len(todo) and scorer is None and not broken:
                try:
                    scorer = make_scorer()
                except Exception:  # noqa: BLE001  any failure to load is a column of the result
                    broken = True
            for at in range(0, len(todo), batch_size):
                part = todo[at : at + batch_size]
                if broken:
                    errors[part] = "model_unavailable"
                    continue
                for rows in ([part], [[i] for i in part]):
                    failed = False
                    for r in rows:
                        try:
                            scores[r] = np.asarray(scorer(f[evidence].iloc[r].tolist(), f[claim].iloc[r].tolist()), float).reshape(len(r), 3)
                            errors[r] = np.where(np.isfinite(scores[r]).all(axis=1), None, "invalid_output")
                        except Exception:  # noqa: BLE001
                            failed = True
                            errors[r] = "inference_failed"
                    if not failed:
                        break
            out["l0"], out["l1"], out["l2"], out["error"] = *scores.T, errors
            yield out

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", l0 double, l1 double, l2 double, error string"
    scored = df.mapInPandas(run, schema)
    return scored.select(*cols, *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in ("l0", "l1", "l2")], "error")


def pair_hash(evidence: str, claim: str) -> Column:
    """128 bits of a pair of texts, each behind its length, so that no two pairs read alike; null apart from empty."""
    side = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.md5(F.concat(side(evidence), side(claim)))


def score_once(df: DataFrame, make_scorer: MakeScorer, evidence: str = "evidence_text", claim: str = "claim_text", **how) -> DataFrame:
    """batch_score on distinct pairs only, joined back by a 128-bit hash of the pair, so texts move once; `score_store` keeps scores across runs.

    df is read twice, for its pairs and for its rows: write a costly one first.
    """
    keyed = df.withColumn("_pair", pair_hash(evidence, claim))
    scored = batch_score(keyed.select("_pair", evidence, claim).distinct(), make_scorer, evidence=evidence, claim=claim, **how)
    return keyed.join(scored.select("_pair", "l0", "l1", "l2", "error"), "_pair", "left").drop("_pair")


class TransientError(Exception):
    """A failed call with a status code; those of TRANSIENT and lost connections (None) are worth another call."""

    def __init__(self, status: int | None = None):
        super().__init__(status)
        self.status = status


def is_transient(e: Exception) -> bool:
    return isinstance(e, ConnectionError) or (isinstance(e, TransientError) and (e.status is None or e.status in TRANSIENT))


def batch_generate(
    df: DataFrame, make_generator: Callable[[], Callable[[str], str]], source: str, max_attempts: int = 2,
    transient: Callable[[Exception], bool] = is_transient, max_source_tokens: int | None = None, wait: float = 0.0,
) -> DataFrame:
    """df with output, attempts and gen_error from a caller's generator; only transient failures are tried again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, broken = None, None
        for f in frames:
            outs = []
            if make is None and broken is None:
                try:
                    make = make_generator()
                except Exception as e:  # noqa: BLE001  any failure to load is a column of the result
                    broken = f"{type(e).__name__}: {e}"
            for text in f[source]:
                if broken:
                    outs.append((None, 0, broken))
                    continue
                said, error, n = None, None, 0
                prompt = text if max_source_tokens is None or text is None else " ".join(text.split()[:max_source_tokens])
                while n < max_attempts and said is None:
                    n += 1
                    try:
                        said, error = make(prompt), None
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        if not transient(e):
                            break
                        time.sleep(wait)
                outs.append((said, n, error))
            out = f.copy()
            out["output"], out["attempts"], out["gen_error"] = zip(*outs, strict=True) if outs else ([], [], [])
            yield out

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", output string, attempts int, gen_error string"
    return df.mapInPandas(run, schema)


def usable_claims(raw: str) -> bool:
    """Whether an answer is a strict JSON list of claims; the same rule as `claims.parse_claims`, for a caller that may ask again."""
    try:
        items = json.loads(re.sub(r"```(?:json)?", "", raw).strip().strip("`").strip())
    except ValueError:
        return False
    whole = lambda x: isinstance(x, dict) and isinstance(x.get("claim_id"), str) and isinstance(x.get("claim_text"), str) and x["claim_text"].strip()
    return isinstance(items, list) and bool(items) and all(map(whole, items))


def claims_with_retries(
    df: DataFrame, make_generators: Callable[[], list[Callable[[str], str]]], source: str, max_calls: int = 3, usable: Callable[[str], bool] = usable_claims,
    transient: Callable[[Exception], bool] = is_transient, wait: float = 0.0, trip: int | None = None,
) -> DataFrame:
    """df with raw, calls and call_error: the first usable answer within max_calls calls, which the prompts share.

    A transient failure is tried again with the same prompt, an answer that isn't
    usable with the next one; any other failure ends a row's calls. Generators that
    can't be loaded are a column of the result. With `trip`, a worker that meets so
    many rows in a row whose calls ended by a failure that isn't transient stops
    calling: its further rows have no calls and the error "circuit_open".
    """

    def ask(makers, text) -> tuple[str | None, int, str | None, bool]:
        calls, error = 0, None
        for make in makers:
            while calls < max_calls:
                calls += 1
                try:
                    raw, error = make(text), None
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                    if not transient(e):
                        return None, calls, error, True
                    if calls < max_calls:
                        time.sleep(wait)
                    continue
                if raw is not None and usable(raw):
                    return raw, calls, None, False
                break
        return None, calls, error, False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        makers, broken, failures = None, None, 0
        for f in frames:
            if makers is None and broken is None:
                try:
                    makers = make_generators()
                except Exception as e:  # noqa: BLE001  any failure to load is a column of the result
                    broken = f"{type(e).__name__}: {e}"
            rows = []
            for text in f[source]:
                if broken:
                    rows.append((None, 0, broken))
                elif trip is not None and failures >= trip:
                    rows.append((None, 0, "circuit_open"))
                else:
                    *row, hard = ask(makers, text)
                    failures = failures + 1 if hard else 0
                    rows.append(tuple(row))
            out = f.copy()
            out["raw"], out["calls"], out["call_error"] = zip(*rows, strict=True) if rows else ([], [], [])
            yield out

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", raw string, calls int, call_error string")


def build_predictions(df: DataFrame) -> DataFrame:
    """df (gold_label_id, prob_*) with gold and predicted names, confidence and probabilities to six places, and correct."""
    ps = [F.col(f"prob_{k}") for k in LABELS]
    pred = F.when((ps[0] >= ps[1]) & (ps[0] >= ps[2]), 0).when(ps[1] >= ps[2], 1).otherwise(2)
    names = F.array(*[F.lit(x) for x in LABELS])
    named = df.withColumn("_pred", pred)
    return named.select(
        *[c for c in df.columns if not c.startswith("prob_")],
        F.try_element_at(names, F.col("gold_label_id") + 1).alias("gold_label_name"),
        F.try_element_at(names, F.col("_pred") + 1).alias("pred_label"),
        F.bround(F.greatest(*ps), 6).alias("confidence"),
        (F.col("_pred") == F.col("gold_label_id")).alias("correct"),
        *[F.bround(p, 6).alias(f"prob_{k}") for p, k in zip(ps, LABELS, strict=True)],
    )

