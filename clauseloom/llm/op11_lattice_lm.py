"""Document probabilities by a unigram model over all segmentations into subwords.

A token (a word of non-blank bytes, A to Z in lower case) is written by one of two
ways: as a whole, with the discounted share it has among the training tokens, or
piece by piece, every piece of an existing vocabulary with a probability of its
own. The probability of the pieces' way is the sum over all segmentations of the
word's lattice, computed by a forward recursion in log space. Pieces start at word
borders or inside words, so a document's probability is the product over its tokens,
which is how one lattice over the whole text would factor.

The vocabulary's own scores weight the pieces first. Rounds of expectation and
maximisation over all distinct words of the training documents then refit them:
each task sends the expected counts of the pieces, at most one row a piece, so the
driver holds numbers of the vocabulary's size only. Characters that the vocabulary
lacks are spelled in its byte pieces.

Words are counted over all documents. The most frequent HOT of them are known to
every task, which so reads a text once and settles most tokens by itself; the
others meet their counts in a join by word. Frequent words are never a join's key.

Defined cases: a null or empty text is one end token. Rows that repeat an id are
documents of their own, equal ones get equal scores. A null id is not held out.
Without training documents all counts are 0 and pieces keep the vocabulary's
weights. Words of any length have their full lattice. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from clauseloom.llm.common import settle, small
from clauseloom.llm.labelled import held_out
from clauseloom.llm.tokens import only

FOLDS, OUT = 7, 2
#: Frequent words that every task knows, and the bytes such a word may have.
HOT, HOT_BYTES = 100_000, 64
#: Texts whose words a task counts at a time, and rounds of fitting.
ROWS, ROUNDS = 2048, 2
#: Words of a lattice batch, cells of its table, and symbols from which on a word has a recursion of its own.
WORDS, CELLS, LONG = 4096, 400_000, 4096
#: What the vocabulary's own weights count in a refit, in tokens.
PRIOR = 100.0
WORD_MARK, BYTE_MARK = "▁", 0xF0000
#: An existing score is a piece's rank with a minus; weights fall with the rank as word frequencies do.
RANK_SHIFT, BYTE_RANK = 50, 40_000


class Lattice:
    """All segmentations of words into the pieces of a vocabulary file."""

    def __init__(self, path: str):
        sp = SentencePieceProcessor(model_file=path)
        self.pieces, weight = {}, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i) or WORD_MARK in p[1:]:
                continue
            if sp.is_byte(i):
                p, rank = chr(BYTE_MARK + int(p[3:5], 16)), BYTE_RANK
            else:
                rank = -sp.get_score(i)
            if p not in self.pieces:
                self.pieces[p] = len(weight)
                weight.append(1 / (RANK_SHIFT + rank))
        self.prior = np.array(weight) / sum(weight)
        self.alphabet = {p for p in self.pieces if len(p) == 1 and p != WORD_MARK and ord(p) < BYTE_MARK}
        #: piece -> number, and -1 for what only begins a piece
        self.table = {p[:j]: -1 for p in self.pieces for j in range(1, len(p))} | self.pieces

    def symbols(self, word: bytes) -> str:
        """The word behind its mark; characters that are no piece of their own become byte symbols."""
        s = word.decode("utf-8", "surrogateescape")
        if self.alphabet.issuperset(s):
            return WORD_MARK + s
        spell = lambda c: "".join(chr(BYTE_MARK + b) for b in c.encode("utf-8", "surrogateescape"))
        return WORD_MARK + "".join(c if c in self.alphabet else spell(c) for c in s)

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of every piece at every place."""
        w, s, e, p, get = [], [], [], [], self.table.get
        for k, x in enumerate(words):
            for i in range(len(x)):
                for j in range(i + 1, len(x) + 1):
                    piece = get(x[i:j])
                    if piece is None:
                        break
                    if piece >= 0:
                        w.append(k)
                        s.append(i)
                        e.append(j)
                        p.append(piece)
        return tuple(np.array(c, np.int64) for c in (w, s, e, p))

    def batch(self, words: list[str], logq: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probabilities of words, and the expected counts of the pieces in `weight` copies of each."""
        w, s, e, p = self.arcs(words)
        size = np.array([len(x) for x in words])
        forward = _recursion(w, s, e, logq[p], len(words), int(size.max()), np.zeros(len(words), np.int64), False)
        z = forward[np.arange(len(words)), size]
        if weight is None:
            return z, None
        backward = _recursion(w, e, s, logq[p], len(words), int(size.max()), size, True)
        share = np.exp(forward[w, s] + logq[p] + backward[w, e] - z[w]) * weight[w]
        return z, np.bincount(p, share, len(logq))

    def alone(self, x: str, logq: np.ndarray, weight: float | None) -> tuple[float, np.ndarray | None]:
        """The same for one word of any length, in memory of a number for each symbol."""
        n, get, q = len(x), self.table.get, logq.tolist()

        def ends(i: int) -> Iterator[tuple[int, int]]:
            for j in range(i + 1, n + 1):
                piece = get(x[i:j])
                if piece is None:
                    return
                if piece >= 0:
                    yield j, piece

        forward = np.full(n + 1, -np.inf)
        forward[0] = 0
        for i in range(n):
            for j, piece in ends(i):
                forward[j] = np.logaddexp(forward[j], forward[i] + q[piece])
        z = float(forward[n])
        if weight is None:
            return z, None
        backward, counts = np.full(n + 1, -np.inf), np.zeros(len(logq))
        backward[n] = 0
        for i in range(n - 1, -1, -1):
            for j, piece in ends(i):
                step = q[piece] + backward[j]
                backward[i] = np.logaddexp(backward[i], step)
                counts[piece] += weight * math.exp(forward[i] + step - z)
        return z, counts

    def run(self, words: list[bytes], logq: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of words piece by piece; with weights also the expected counts of the pieces."""
        out, counts = np.zeros(len(words)), None if weight is None else np.zeros(len(logq))
        texts = [self.symbols(w) for w in words]
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        at = 0
        while at < len(order):
            longest = len(texts[order[at]])
            if longest > LONG:
                take = order[at : at + 1]
                z, more = self.alone(texts[take[0]], logq, None if weight is None else float(weight[take[0]]))
            else:
                # sorted by length: the table is as wide as the batch's last word
                n = 1
                while at + n < len(order) and n < WORDS and (len(texts[order[at + n]]) + 1) * (n + 1) <= CELLS and len(texts[order[at + n]]) <= LONG:
                    n += 1
                take = order[at : at + n]
                z, more = self.batch([texts[k] for k in take], logq, None if weight is None else weight[take])
            out[take] = z
            if counts is not None:
                counts += more
            at += len(take)
        return out, counts


def _recursion(w, frm, to, step, n_words: int, width: int, origin: np.ndarray, down: bool) -> np.ndarray:
    """Log sums of all paths from each word's `origin` to each place, along arcs frm -> to; place by place, all words at a time."""
    table = np.full((n_words, width + 1), -np.inf)
    table[np.arange(n_words), origin] = 0
    order = np.lexsort((w, to))
    w, frm, to, step = w[order], frm[order], to[order], step[order]
    cut = np.searchsorted(to, np.arange(width + 2))
    for place in range(width - 1, -1, -1) if down else range(1, width + 1):
        a, b = cut[place], cut[place + 1]
        if a == b:
            continue
        mine = w[a:b]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        table[mine[first], place] = np.logaddexp.reduceat(table[mine, frm[a:b]] + step[a:b], first)
    return table


@cache
def lattice(path: str) -> Lattice:
    return Lattice(path)


def coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of texts (binary): each word's text and number, and the distinct words by number; bytes split at ASCII white space, A to Z in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    at, words = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy())), lists.flatten().dictionary_encode()
    number, words = words.indices.to_numpy(), words.dictionary.view(pa.binary())
    full = pc.binary_length(words).to_numpy()[number] > 0  # white space at a text's ends gives empty strings
    return at[full], words, number[full]


def count_words(docs: DataFrame) -> DataFrame:
    """train, text -> word, n (in all documents), c (in training documents); a batch sends a row for each distinct word."""

    def run(batches):
        only(None)
        for b in small(batches, ROWS):
            at, words, number = coded(b.column("text"))
            train = pc.fill_null(b.column("train"), False).to_numpy(zero_copy_only=False)
            n, c = (np.bincount(x, minlength=len(words)) for x in (number, number[train[at]]))
            yield pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(c)], ["word", "n", "c"]).filter(pa.array(n > 0))

    return docs.mapInArrow(run, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def fit_pieces(words: DataFrame, path: str, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Log probabilities of the pieces: the vocabulary's weights, refitted to the distinct training words, each counted once."""
    lat = lattice(path)
    q = lat.prior
    for _ in range(rounds):
        logq = np.log(q)

        def expect(batches, logq=logq):
            only(None)
            lat, total = lattice(path), np.zeros(len(logq))
            for b in small(batches, 20_000):
                total += lat.run(b.column("word").to_pylist(), logq, np.ones(b.num_rows))[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["piece", "n"])

        found = words.where("c > 0").select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # one row a piece
        n = prior * lat.prior
        for piece, k in found:
            n[piece] += k
        q = n / n.sum()
    return np.log(q)


class Model:
    """Shares of whole words, of the pieces' way and of the end, from counts of counts."""

    def __init__(self, types: int, once: int, twice: int, n_tokens: int, ends: int, logq: np.ndarray):
        self.n_tokens, self.types = n_tokens + ends, types + (ends > 0)
        self.discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        whole = self.n_tokens + 2  # the end and the pieces' way have one token more, so that neither is impossible
        self.log_whole, self.log_back = math.log(whole), math.log((self.discount * types + 1) / whole)
        self.ends, self.log_end, self.logq = ends, math.log((ends + 1) / whole), logq

    def word(self, c: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """log10 probability of words with training counts c and natural log lattice probabilities."""
        whole = np.log(np.where(c > 0, np.maximum(c - self.discount, 1e-300), 1)) - self.log_whole
        return np.logaddexp(np.where(c > 0, whole, -np.inf), self.log_back + pieces) / math.log(10)


def score_words(words: DataFrame, model: Model, path: str) -> DataFrame:
    """words with lp, the log10 probability of one occurrence."""

    def run(batches):
        only(None)
        lat = lattice(path)
        for b in small(batches, 20_000):
            z, _ = lat.run(b.column("word").to_pylist(), model.logq)
            lp = model.word(b.column("c").to_numpy(), z)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), b.column("c"), pa.array(lp)], ["word", "n", "c", "lp"])

    return words.select("word", "n", "c").mapInArrow(run, "word binary, n long, c long, lp double")


def _hot(spark: SparkSession, words: DataFrame, hot: int):
    """The most frequent words (at most `hot`, of at most HOT_BYTES bytes each), their log10(c + 1), 1 if c > 0, and lp."""
    top = words.where(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("n"), "word").limit(hot).select("word", "c", "lp").toArrow().combine_chunks()
    c, lp = (top.column(x).to_numpy() for x in ("c", "lp"))
    return spark.sparkContext.broadcast((pa.array(top.column("word").to_pylist(), pa.binary()), np.log10(c + 1.0), (c > 0).astype(np.int64), lp))


PARTS = "key binary, word binary, n long, known long, logc double, lp double"


def _parts(known):
    """Each document's sums over the words that are known here (word is null), and a row for each other word."""

    def run(batches):
        only(None)
        hot, logc, known_, lp = known.value
        for b in small(batches, ROWS):
            rows, texts = b.num_rows, b.column("text")
            at, words, number = coded(texts)
            place = pc.fill_null(pc.index_in(words, value_set=hot), -1).to_numpy()[number]
            met = place >= 0
            mine, place = at[met], place[met]
            sums = [np.bincount(mine, x[place], rows) for x in (known_, logc, lp)]
            rare, times = np.unique(at[~met] * len(words) + number[~met], return_counts=True)
            row, word = np.divmod(rare, max(1, len(words)))
            every, none = pa.array(np.concatenate([np.arange(rows), row])), np.zeros(len(rare))
            keys = pa.array([hashlib.blake2b(t or b"", digest_size=16).digest() for t in texts.to_pylist()], pa.binary())
            n, seen, x, y = (np.concatenate(c) for c in ((np.bincount(at, minlength=rows), times), (sums[0].astype(np.int64), none.astype(np.int64)), (sums[1], none), (sums[2], none)))
            found = pa.concat_arrays([pa.nulls(rows, pa.binary()), words.take(pa.array(word))])
            arrays = [b.column("id").take(every), keys.take(every), found, pa.array(n), pa.array(seen), pa.array(x), pa.array(y)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "word", "n", "known", "logc", "lp"])

    return run


def lattice_scores(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").cast("binary").alias("text")
    training = docs.select((~held_out(id_col, FOLDS, OUT)).alias("train"), text)
    words = settle(count_words(training), "words")
    seen = F.col("c") > 0
    shape = words.agg(F.count_if(seen), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = training.where("train").count()
    model = Model(*shape, ends, fit_pieces(words, path, rounds))
    scored = settle(score_words(words, model, path), "word_scores")
    kind = docs.schema[id_col].dataType.simpleString()
    parts = settle(docs.select(F.col(id_col).alias("id"), text).mapInArrow(_parts(_hot(spark, scored, hot)), f"id {kind}, {PARTS}"), "parts")
    rare = parts.where("word is not null").select("id", "key", "word", "n")
    met = rare.join(scored.select("word", "c", "lp"), "word").select(
        "id", "key", F.lit(0).alias("docs"), F.lit(0).cast("long").alias("n"), F.when(seen, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * F.log10(F.col("c") + 1.0)).alias("logc"), (F.col("n") * F.col("lp")).alias("lp"),
    )
    own = parts.where("word is null").select("id", "key", F.lit(1).alias("docs"), "n", "known", "logc", "lp")
    # Rows of one id and one text are added together and taken apart again: each has an equal share.
    sums = own.unionByName(met).groupBy("id", "key").agg(*[F.sum(c).alias(c) for c in ("docs", "n", "known", "logc", "lp")])
    each = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("docs"))))
    share = lambda c: F.col(c) / F.col("docs")
    whole = lambda c: share(c).cast("long")
    n_tokens, known_end = whole("n") + 1, 1 if ends else 0
    base = share("logc") + math.log10(ends + 1) - n_tokens * math.log10(model.n_tokens + model.types + 1)
    return each.select(
        F.col("id").alias(id_col), held_out("id", FOLDS, OUT).alias("held_out"), n_tokens.alias("n_tokens"), (whole("known") + known_end).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (share("lp") + model.log_end / math.log(10)).alias("score"),
    )
