"""Toxicity by a convolutional text classifier, trained in numpy.

A word (letters and digits, lower case) is embedded as the sum of the hashed
embeddings of itself and of its first four and five letters, so inflected forms
share what was learned; filters of several widths slide over the whole text, each
keeps its maximum, and a linear layer scores the maxima. Gradients flow through the winning windows only. It is
fitted on the driver on a bounded sample of labelled rows (`TRAIN_ROWS`), a fifth
of which is kept for a logistic fit that makes the score a probability. Decision
thresholds are chosen from all labelled rows outside the held-out fold that the
fit did not see, scored in tasks and counted by language and score bin. Language
decides the threshold only, never the score.

A language's threshold has the highest F1 on its own counts and on those of all
languages, the latter at the weight of `PRIOR` toxic rows, so it follows its own
labels more the more there are. A null language, and one without such labelled
rows, has the threshold of all.

In tasks, embedding times filter is a table per hashed word, so scoring a text is
lookups, shifted sums and maxima over all its words.

Defined cases: a null text is empty and gets the score of no words; without
labelled rows, or with one class only, every score is the smoothed rate of the
label; repeated rows are scored each; an empty table gives an empty result; other
columns are ignored by `toxicity_scores` and pass through `drop_toxic`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import bounded, settle, small, unused
from clauseloom.llm.labelled import best_bin, held_out, highest, platt, sample, sigmoid
from clauseloom.llm.tokens import Memo, only, task

TRAIN_ROWS, FOLDS, HELD_OUT = 6000, 4, 2
BUCKETS, DIM, WIDTHS, FILTERS, STEMS = 1 << 17, 8, (1, 2, 3), 4, (4, 5)
#: Chosen by cross-validation among the labelled rows outside the held-out fold.
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.2, 99
#: Toxic rows that the counts of all languages weigh as in a language's threshold; score bins for each unit of log-odds.
PRIOR, BINS = 5, 256
#: The contract's fixed cut for `predicted`.
CUT = 0.3
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PAD = max(WIDTHS) - 1


def _bucket(s: str) -> int:
    return 1 + zlib.crc32(s.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)


def _ids_of(part: str) -> bytes:
    words = _WORD.findall(part.lower())
    return np.array([[_bucket(w), *(_bucket(f"{k}:{w[:k]}") if len(w) >= k else 0 for k in STEMS)] for w in words], "<i4").tobytes()


_MEMO = Memo(_ids_of)
_KEYS = 1 + len(STEMS)
_GAP = np.zeros((_PAD + 1) * _KEYS, "<i4").tobytes()


def begin() -> None:
    """At a task's start. Tasks name this function and not the memo, which would travel with them."""
    only(_MEMO)


def word_ids(text: str) -> bytes:
    return b"".join(map(_MEMO.__getitem__, text.split(" ")))


def _laid(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' ids behind each other, with empty words between, and their starts."""
    lens = np.array([len(x) // (4 * _KEYS) + _PAD + 1 for x in ids], np.int64)
    flat = np.frombuffer(_GAP.join(ids) + _GAP, "<i4").reshape(-1, _KEYS)
    return flat, np.cumsum(lens) - lens


class Model:
    """Weights: embedding E, filters W[k] of width k (k, DIM, FILTERS) with biases, output U and c; a, b calibrate."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.E = rng.normal(0, 0.05, (BUCKETS, DIM))
        self.E[0] = 0
        self.W = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS}
        self.B = {w: np.zeros(FILTERS) for w in WIDTHS}
        self.U = rng.normal(0, 0.1, len(WIDTHS) * FILTERS)
        self.c, self.a, self.b = 0.0, 1.0, 0.0
        self.threshold, self.thresholds, self.fit_ids, self.fit_names = 0.5, None, [], []

    def fit(self, ids: list[bytes], y: np.ndarray) -> None:
        """Adagrad on the logistic loss; embeddings start from the words' smoothed log-odds in one of their dimensions."""
        n_pos, n_neg = y.sum(), len(y) - y.sum()
        seen = [np.unique(np.frombuffer(x, "<i4")) for x in ids]
        pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for s, t in zip(seen, y, strict=True):
            (pos if t else neg)[s] += 1
        odds = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))
        self.E[pos + neg < 3] = 0  # too rare to tell
        self.E[:, 0] = np.where(pos + neg < 3, 0, np.clip(odds, -2, 4)) / _KEYS
        for w in WIDTHS:
            self.W[w][:, 0, 0] = 1 / w
            self.U[WIDTHS.index(w) * FILTERS] = 1.0
        self.c = -2.0
        acc = {"E": np.full((BUCKETS, DIM), 1e-2), "U": np.full_like(self.U, 1e-2), "c": 1e-2}
        acc |= {w: np.full_like(self.W[w], 1e-2) for w in WIDTHS} | {("B", w): np.full(FILTERS, 1e-2) for w in WIDTHS}
        rng = np.random.default_rng(SEED + 1)
        for epoch in range(EPOCHS):
            order, rate = rng.permutation(len(ids)), RATE / (1 + epoch)
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                self._step([ids[i] for i in pick], y[pick], acc, rate)

    def _step(self, ids: list[bytes], y: np.ndarray, acc: dict, rate: float) -> None:
        flat, starts = _laid(ids)
        emb = self.E[flat].sum(1)
        ends = np.append(starts[1:], len(flat)) - _PAD
        feats, wins = [], []
        for w in WIDTHS:
            conv = sum(emb[j : len(flat) - _PAD + j] @ self.W[w][j] for j in range(w))
            win = np.stack([conv[s:e].argmax(0) + s for s, e in zip(starts, ends, strict=True)])
            feats.append(np.maximum(np.take_along_axis(conv, win, 0) + self.B[w], 0))
            wins.append(win)
        x = np.concatenate(feats, 1)
        err = (sigmoid(x @ self.U + self.c) - y) / len(y)
        dx = err[:, None] * self.U * (x > 0)

        def move(value, grad, key):
            acc[key] += grad * grad
            return value - rate * grad / np.sqrt(acc[key])

        rows, grads = [], []
        for k, w in enumerate(WIDTHS):
            d = dx[:, k * FILTERS : (k + 1) * FILTERS]
            dw = np.empty_like(self.W[w])
            for j in range(w):
                at = wins[k] + j
                dw[j] = np.einsum("bf,bfd->df", d, emb[at])
                rows.append(flat[at].reshape(-1, _KEYS))
                grads.append((d[:, :, None] * self.W[w][j].T).reshape(-1, DIM))
            self.W[w], self.B[w] = move(self.W[w], dw, w), move(self.B[w], d.sum(0), ("B", w))
        self.U, self.c = move(self.U, x.T @ err + 1e-4 * self.U, "U"), move(self.c, err.sum(), "c")
        hit = np.concatenate(rows).ravel()
        order = np.argsort(hit, kind="stable")
        uniq, first = np.unique(hit[order], return_index=True)
        g = np.add.reduceat(np.concatenate(grads)[order // _KEYS], first)
        acc["E"][uniq] += g * g
        self.E[uniq] -= rate * g / np.sqrt(acc["E"][uniq])
        self.E[0] = 0

    def tables(self) -> dict:
        """What tasks need: for every hashed word, embedding times filter at each offset, as single floats."""
        t = np.concatenate([self.E @ self.W[w][j] for w in WIDTHS for j in range(w)], 1).astype(np.float32)
        return {"t": t, "B": np.concatenate([self.B[w] for w in WIDTHS]), "U": self.U, "c": self.c, "a": self.a, "b": self.b}


def logits(tables: dict, ids: list[bytes], words: int = 1 << 15) -> np.ndarray:
    """The classifier's output for each document; about `words` words are in memory at a time, a longer document alone."""
    out, part, size = [], [], 0

    def flush():
        flat, starts = _laid(part)
        g = tables["t"][flat[:, 0]]
        for k in range(1, _KEYS):
            g += tables["t"][flat[:, k]]
        n, at, feats = len(flat) - _PAD, 0, []
        across = (starts[1:, None] - np.arange(1, _PAD + 1)).ravel()  # windows that would reach into the next document
        for w in WIDTHS:
            conv = g[:n, at : at + FILTERS].copy()
            for j in range(1, w):
                conv += g[j : n + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            conv[across] = -np.inf
            feats.append(np.maximum.reduceat(conv, starts, axis=0))
        x = np.maximum(np.concatenate(feats, 1) + tables["B"], 0)
        out.append(x @ tables["U"] + tables["c"])

    for x in ids:
        part.append(x)
        size += len(x) // (4 * _KEYS)
        if size >= words:
            flush()
            part, size = [], 0
    if part:
        flush()
    return np.concatenate(out) if out else np.empty(0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """The fitted classifier; `fit_ids` are the ids that it learned from, `fit_names` these as text. Thresholds come from `set_thresholds`."""
    got = sample(docs, labels, label, FOLDS, HELD_OUT, rows, id_col, text_col, [])
    ids, y = [word_ids(r[1]) for r in got], np.array([r[0] for r in got], float)
    check = np.arange(len(got)) % 5 == 4
    model = Model()
    if y[~check].size and 0 < y[~check].sum() < (~check).sum():
        model.fit([x for x, c in zip(ids, check, strict=True) if not c], y[~check])
        model.fit_ids, model.fit_names = (sorted({r[name] for r, c in zip(got, check, strict=True) if not c}) for name in ("_id", "_name"))
        model.a, model.b = platt(logits(model.tables(), [x for x, c in zip(ids, check, strict=True) if c]), y[check])
    else:
        model.a, model.b = platt(np.zeros(len(y)), y)
    return model


def set_thresholds(model: Model, scored: DataFrame, labels: DataFrame, label: str = "toxic") -> None:
    """From scored rows (id, lang, score): the threshold of all, and a table (lang, cut) of those of the languages."""
    known = highest(labels, label, scored.columns[0], FOLDS, HELD_OUT)
    rows = scored.toDF("_id", "lang", "score").join(known, "_id")
    if model.fit_ids:
        fit = scored.sparkSession.createDataFrame(pa.table({"_name": model.fit_names}))  # from Arrow, as rows of Python start workers of another kind
        rows = rows.join(F.broadcast(fit), F.col("_id").cast("string") == fit["_name"], "left_anti")  # TRAIN_ROWS ids at most
    odds = F.log(F.col("score") / (1 - F.col("score")))
    counts = settle(rows.groupBy("lang", F.floor(odds * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("hits")), "bins")
    every = counts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toPandas()  # at most 60 BINS + 1 rows
    toxic = int(every["hits"].sum())
    model.thresholds = None
    if not toxic:
        model.threshold = 1.0
        return
    model.threshold = float(best_bin(every, BINS))
    weight = min(1.0, PRIOR / toxic)
    prior = every.assign(n=every["n"] * weight, hits=every["hits"] * weight)

    def run(key, own):
        return pd.DataFrame({"lang": [key[0]], "cut": [best_bin(pd.concat([own[["bin", "n", "hits"]], prior]), BINS)]})

    own = counts.where("lang is not null").groupBy("lang").applyInPandas(run, "lang string, cut double")
    model.thresholds = settle(own, "thresholds")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, threshold (its language's), toxic (score at or above it)."""
    model = model or train(docs, labels, id_col, text_col)
    tables = docs.sparkSession.sparkContext.broadcast(model.tables())  # BUCKETS rows
    scored = settle(_scored(docs.select(F.col(id_col), F.col(text_col).cast("string"), F.col(lang_col).cast("string").alias("lang")), tables, id_col), "scores")
    set_thresholds(model, scored.withColumnRenamed("id", id_col), labels)
    return with_threshold(model, scored, "lang", "threshold").select(
        F.col("id").alias(id_col), held_out("id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
        "threshold", (F.col("score") >= F.col("threshold")).alias("toxic"),
    )


def with_threshold(model: Model, df: DataFrame, lang_col: str | None, name: str) -> DataFrame:
    """df with `name`, the threshold of its language, or of all where that has none."""
    if model.thresholds is None or lang_col is None:
        return df.withColumn(name, F.lit(model.threshold))
    lang = unused(df.columns, "_lang")
    cuts = bounded(model.thresholds.select(F.col("lang").alias(lang), F.col("cut").alias(name)))
    return df.join(cuts, df[lang_col].cast("string") == cuts[lang], "left").drop(lang).withColumn(name, F.coalesce(F.col(name), F.lit(model.threshold)))


def _score_batches(tables):
    def run(texts: list) -> pa.Array:
        t = tables.value
        return pa.array(sigmoid(t["a"] * logits(t, [word_ids(x or "") for x in texts]) + t["b"]), pa.float64())

    return run


def _scored(rows: DataFrame, tables, id_col: str) -> DataFrame:
    score = _score_batches(tables)

    @task
    def run(batches):
        begin()
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], score(b.column(1).to_pylist())], ["id", "lang", *b.schema.names[3:], "score"])

    more = "".join(f"{c} {t}, " for c, t in rows.dtypes[3:])
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, lang string, {more}score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those at or above their language's threshold, with all their columns.

    Every text is scored once: scores are written without the texts, as thresholds are known only after all scores. Rows go
    by id, text's hash and language, which fix score and threshold; texts move only where the dropped rows are too many to be
    sent to them. Without a column `lang_col` all documents have the threshold of all.
    """
    model = train(docs, labels, id_col, text_col)
    tables = docs.sparkSession.sparkContext.broadcast(model.tables())
    known = lang_col in docs.columns
    lang = docs[lang_col].cast("string") if known else F.lit(None).cast("string")
    text = docs[text_col].cast("string")
    tie = F.xxhash64(text)
    scored = settle(_scored(docs.select(docs[id_col], text, lang.alias("lang"), tie.alias("tie")), tables, id_col), "scored")
    set_thresholds(model, scored.select(F.col("id").alias(id_col), "lang", "score"), labels)
    cut = with_threshold(model, scored, "lang" if known else None, "cut").where(~(F.col("score") < F.col("cut")))
    gone = settle(cut.select(F.col("id").alias("_gone_id"), F.col("tie").alias("_gone_tie"), F.col("lang").alias("_gone_lang")).distinct(), "gone")
    same = docs[id_col].eqNullSafe(gone["_gone_id"]) & (tie == gone["_gone_tie"])
    return docs.join(bounded(gone), same & lang.eqNullSafe(gone["_gone_lang"]) if known else same, "left_anti")
