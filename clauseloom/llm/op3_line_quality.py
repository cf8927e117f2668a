"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of kinds of
characters, its length, the share of distinct words, whether the document repeats
it, and the same of the line before and after. The field is fitted on the driver
by maximum likelihood on a bounded sample of labelled documents (`TRAIN_ROWS`).
Only documents are labelled, their lines are latent: a first field without
transitions and neighbours learns what lines of good and of bad documents look
like by themselves; by it, and by `PRIOR` in favour of their document's label,
lines get labels of their own. Whole documents of one kind would teach the field
that a line is as its neighbours are, so documents with lines of the other kind
spliced in join them, and the field is fitted on all these chains. Features are
scaled to one spread while it is fitted, so that small shares count as much as
large numbers. A document's quality is the mean of its
lines' forward-backward marginals weighted by their length, turned into a
probability by a logistic fit on a part of the sample that the field hasn't seen.

Defined cases: a null or empty text has no lines and gets the rate of good
documents; without labelled rows, or with one class only, every score is the
smoothed rate of the label; repeated rows are scored each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import small
from clauseloom.llm.labelled import held_out, platt, sample, sigmoid

TRAIN_ROWS, FOLDS, HELD_OUT = 5000, 5, 0
ROUNDS, RATE = 150, 0.1
#: Log-odds by which a document's label counts in the label of each of its lines.
PRIOR = 2.0
#: One of so many documents is also used with lines of the other kind, one to so many of its own lines.
SPLICED, SPLICE_LINES, SEED = 2, 4, 5
CUT = 0.3
_OWN, _NEAR = 11, 5  # features of a line itself, and how many of them its neighbours lend
N_FEATURES = 1 + _OWN + 2 * (_NEAR + 1)
_KINDS = np.zeros((5, 256), np.uint8)
_KINDS[0, [*range(65, 91)]] = 1
_KINDS[1, [ord(c) for c in "!#$%&*+=<>@^_~\\{}[]"]] = 1
_KINDS[2, ord("|")] = 1
_KINDS[3, [*range(48, 58)]] = 1
_KINDS[4, [ord(c) for c in ".,;:?()'\"-"]] = 1


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lines of each text, bytes of each line). A text without characters has no lines."""
    lens, words, distinct, again, n_lines = [], [], [], [], []
    for t in texts:
        lines = t.split("\n") if t else []
        n_lines.append(len(lines))
        seen: dict[str, int] = {}
        for line in lines:
            seen[line] = seen.get(line, 0) + 1
        for line in lines:
            w = line.split()
            words.append(len(w))
            distinct.append(len(set(w)))
            again.append(seen[line] > 1)
    total = sum(n_lines)
    if not total:
        return np.zeros((0, N_FEATURES)), np.array(n_lines, np.int64), np.zeros(0)
    buf = np.frombuffer(("\n".join(t for t in texts if t) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lens = (ends - starts).astype(float)
    size = np.maximum(lens, 1)
    shares = [np.add.reduceat(k[buf], starts, dtype=np.int32) / size for k in _KINDS]
    words, distinct = np.array(words, float), np.array(distinct, float)
    w = np.maximum(words, 1)
    own = np.stack([*shares, np.log1p(lens) / 5, lens < 40, distinct / w, (distinct / w) * np.minimum(words, 60) / 60, np.array(again), np.minimum(lens / w, 30) / 10], 1)
    doc = np.repeat(np.arange(len(texts)), n_lines)
    lend = own[:, [0, 1, 2, 7, 9]]
    before, after = np.zeros((total, _NEAR + 1)), np.zeros((total, _NEAR + 1))
    same = doc[1:] == doc[:-1]
    before[1:][same] = np.column_stack([lend[:-1], np.ones(total - 1)])[same]
    after[:-1][same] = np.column_stack([lend[1:], np.ones(total - 1)])[same]
    return np.column_stack([np.ones(total), own, before, after]), np.array(n_lines, np.int64), lens


def forward_backward(emit: np.ndarray, n_lines: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of the two states of every line, expected transitions of all chains, expected first states).

    emit: score of the state 'good' of each line against 'bad'. Chains go side by
    side, the longest first, so that those still running are the first ones.
    """
    has = np.flatnonzero(n_lines > 0)
    order = has[np.argsort(-n_lines[has], kind="stable")]
    ends = np.cumsum(n_lines)
    starts, size = (ends - n_lines)[order], n_lines[order]
    e = np.exp(np.stack([np.zeros_like(emit), np.clip(emit, -25, 25)], 1))
    move, alpha, beta = np.exp(trans), np.ones_like(e), np.ones_like(e)
    running = np.searchsorted(-size, -np.arange(size.max() if len(size) else 0), "left")  # chains with more than t lines
    for t, m in enumerate(running):
        at = starts[:m] + t
        a = (np.exp(first) if t == 0 else alpha[at - 1] @ move) * e[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(running) - 1, 0, -1):
        at = starts[: running[t]] + t
        b = e[at] * beta[at]
        x = alpha[at - 1][:, :, None] * move * b[:, None, :]
        pairs += ((x / x.sum((1, 2), keepdims=True)) / size[: running[t], None, None]).sum(0)
        b = b @ move.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    return p, pairs, (p[starts] / size[:, None]).sum(0)


def splice(texts: list[str], y: np.ndarray, n_lines: np.ndarray, lines: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Documents with lines of the other kind put in at random places, and the labels of all their lines."""
    rng = np.random.default_rng(SEED)
    at = np.cumsum(n_lines) - n_lines
    rows = [(t.split("\n"), lines[a : a + n]) for t, a, n in zip(texts, at, n_lines, strict=True)]
    pool = {k: [x for (doc, own), kind in zip(rows, y, strict=True) if kind == k for x, label in zip(doc, own, strict=False) if label == k and x] for k in (0, 1)}
    out, labels = [], []
    for (doc, own), kind in zip(rows, y, strict=True):
        if len(own) < 2 or rng.integers(SPLICED) or not pool[1 - int(kind)]:
            continue
        doc, own, donors = list(doc), own.tolist(), pool[1 - int(kind)]
        for _ in range(max(1, len(doc) // SPLICE_LINES)):
            k = int(rng.integers(len(doc) + 1))
            doc.insert(k, donors[int(rng.integers(len(donors)))])
            own.insert(k, float(1 - kind))
        out.append("\n".join(doc))
        labels += own
    return out, np.array(labels, float)


class Field:
    """Weights of 'good' against 'bad', transitions, first states; a, b turn a document's mean into a probability."""

    def __init__(self):
        self.w, self.trans, self.first, self.a, self.b, self.rate = np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2), 1.0, 0.0, 0.5

    def fit(self, texts: list[str], y: np.ndarray) -> None:
        """From documents' labels: first the lines' own labels, then chains of these, with lines of the other kind spliced in."""
        x, n_lines, _ = line_features(texts)
        label = np.repeat(y, n_lines)
        alone = np.zeros(N_FEATURES, bool)
        alone[: 1 + _OWN] = True
        self._climb(x, n_lines, label, alone, chained=False)
        lines = (x @ self.w + PRIOR * (2 * label - 1) >= 0).astype(float)
        more, more_lines = splice(texts, y, n_lines, lines)
        x2, n2, _ = line_features(more)
        self._climb(np.concatenate([x, x2]), np.concatenate([n_lines, n2]), np.concatenate([lines, more_lines]), np.ones(N_FEATURES, bool), chained=True)

    def _climb(self, x: np.ndarray, n_lines: np.ndarray, label: np.ndarray, used: np.ndarray, chained: bool) -> None:
        """Adam on the likelihood of the lines' labels; each document counts once, whatever its lines. Without chains, lines stand alone."""
        has = n_lines > 0
        weight = np.repeat(1 / np.maximum(n_lines, 1), n_lines)
        n = max(1, has.sum())
        spread = x.std(0) if len(x) else np.zeros(N_FEATURES)
        scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 1)  # shares of characters are small numbers, and steps are of one size
        x = x * scale
        first_line = (np.cumsum(n_lines) - n_lines)[has]
        inside = np.ones(len(label), bool)
        inside[first_line] = False
        at = np.flatnonzero(inside)
        seen, start, state = np.zeros((2, 2)), np.zeros(2), label.astype(int)
        np.add.at(seen, (state[at - 1], state[at]), weight[at])
        np.add.at(start, state[first_line], weight[first_line])
        theta = np.zeros(N_FEATURES + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for r in range(1, ROUNDS + 1):
            w, trans, first = theta[:N_FEATURES], theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[-2:]
            if chained:
                p, pairs, firsts = forward_backward(x @ w, n_lines, trans, first)
                grad = np.concatenate([x.T @ ((label - p[:, 1]) * weight), (seen - pairs).ravel(), start - firsts])
            else:
                grad = np.concatenate([x.T @ ((label - sigmoid(x @ w)) * weight), np.zeros(6)])
            grad = grad / n - 1e-4 * theta
            grad[:N_FEATURES] *= used
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta + RATE * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        self.w, self.trans, self.first = theta[:N_FEATURES] * scale, theta[N_FEATURES : N_FEATURES + 4].reshape(2, 2), theta[-2:]

    def quality(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, as log-odds; nan for a text without lines."""
        x, n_lines, size = line_features(texts)
        p, _, _ = forward_backward(x @ self.w, n_lines, self.trans, self.first)
        out = np.full(len(texts), np.nan)
        has = np.flatnonzero(n_lines > 0)
        if len(has):
            at = (np.cumsum(n_lines) - n_lines)[has]
            weight = size + 1
            q = np.clip(np.add.reduceat(p[:, 1] * weight, at) / np.add.reduceat(weight, at), 1e-4, 1 - 1e-4)
            out[has] = np.log(q / (1 - q))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.quality(texts)
        return np.where(np.isnan(z), self.rate, sigmoid(self.a * np.nan_to_num(z) + self.b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Field:
    got = sample(docs, labels, label, FOLDS, HELD_OUT, rows, id_col, text_col, [])
    texts, y = [r[1] for r in got], np.array([r[0] for r in got], float)
    field = Field()
    field.rate = float((y.sum() + 1) / (len(y) + 2))
    check = np.arange(len(got)) % 5 == 4
    fit = [t for t, c in zip(texts, check, strict=True) if not c]
    if fit and 0 < y[~check].sum() < len(fit):
        field.fit(fit, y[~check])
        z = field.quality([t for t, c in zip(texts, check, strict=True) if c])
        fine = ~np.isnan(z)
        field.a, field.b = platt(z[fine], y[check][fine])
    else:
        field.a, field.b = platt(np.zeros(len(y)), y)
    return field


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    field = field or train(docs, labels, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in small(batches):
            score = field.score([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, score double")
    return rows.select(F.col("id").alias(id_col), held_out("id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def line_labels(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line: id, line_no, line, p_good, good."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in small(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            x, n_lines, _ = line_features(texts)
            p = forward_backward(x @ field.w, n_lines, field.trans, field.first)[0][:, 1]
            row = np.repeat(np.arange(len(texts)), n_lines)
            lines = [line for t in texts if t for line in t.split("\n")]
            no = np.arange(len(row)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(no, pa.int32()), pa.array(lines, pa.string()), pa.array(p), pa.array(p >= 0.5)], ["id", "line_no", "line", "p_good", "good"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id {kind}, line_no int, line string, p_good double, good boolean").withColumnRenamed("id", id_col)
