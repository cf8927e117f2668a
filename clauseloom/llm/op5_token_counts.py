"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary is encoded by itself; those that come
back as the one token they name are proven. A text is cut into the tokenizer's
pre-tokens; a pre-token that is a proven string counts one without any merge, and
only the others are merged, by the library. Counts of pre-tokens and of stretches
of text between spaces are remembered per worker in bounded memos.

Defined cases: a null or empty text has no tokens; a text with an added special
token's string in it goes to the library whole, which by default reads that
string as the special token; repeated rows are counted each; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import small
from clauseloom.llm.tokens import BYTE_LEVEL, RUN, ByteLevel, sizes, load, only, task

_WORKER: dict = {}


def proven_tokens(path: str) -> set[str]:
    """Vocabulary strings that, alone, are one pre-token and encode as exactly the token they name."""
    tok = load(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    named = [(i, tok.decode([i])) for i in range(tok.get_vocab_size())]
    named = [(i, s) for i, s in named if s and s not in special and "�" not in s and BYTE_LEVEL.fullmatch(s)]
    return {s for (i, s), e in zip(named, tok.encode_batch([s for _, s in named], add_special_tokens=False), strict=True) if e.ids == [i]}


class Counter(ByteLevel):
    """Texts -> numbers of tokens. New chunks are cut into pre-tokens: proven ones count one unmerged, the library merges the rest."""

    def __init__(self, path: str, proven: set[str]):
        super().__init__(path)
        self.proven = proven

    def whole(self, text: str) -> int:
        return len(self.ids(text))

    def total(self, half: np.ndarray, values: list, number: np.ndarray, ends: np.ndarray) -> list:
        chunk = np.array(values, np.int64)[half].reshape(-1, 2).sum(1)
        return np.diff(np.concatenate([[0], np.cumsum(chunk[number])])[ends]).tolist()

    def learn(self, new: list[str]) -> list:
        proven, out, todo = self.proven, {}, {}
        for c in new:
            if c.startswith(self.MARK):
                out[c] = self.whole(c[1:])
                continue
            word = " " + c
            if word in proven:
                out[c] = 1
                continue
            pre = [word] if c.isalpha() else BYTE_LEVEL.findall(word)
            rest = [p for p in pre if p not in proven]
            out[c] = len(pre) - len(rest)
            for p in rest:
                todo.setdefault(p, []).append(c)
        spaced = [p for p in todo if p[0] == " " and len(p) > 1 and not p[1].isspace()]  # joined, these stay apart
        for p in todo.keys() - set(spaced):
            n = self.whole(p)
            for c in todo[p]:
                out[c] += n
        for at in range(0, len(spaced), RUN):
            some = spaced[at : at + RUN]
            _, cuts = self.parts("".join(some), np.cumsum(sizes(some)), self.width)
            for p, n in zip(some, np.diff(cuts, prepend=0).tolist(), strict=True):
                for c in todo[p]:
                    out[c] += n
        return [out[c] for c in new]


def counter(path: str, proof) -> Counter:
    """This worker's counter, made once from the broadcast proof."""
    if path not in _WORKER:
        _WORKER[path] = Counter(path, proof.value)
    return only(_WORKER[path])


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. `tokenizer` is the path of a byte-level BPE file on every node."""
    kind = docs.schema[id_col].dataType.simpleString()
    proof = docs.sparkSession.sparkContext.broadcast(proven_tokens(tokenizer))  # at most one string per vocabulary entry

    @task
    def run(batches):
        count = counter(tokenizer, proof)
        for b in small(batches):
            texts = pc.fill_null(b.column(1), "")
            n = count.many(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
