"""Token ids and counts of whole texts by public tokenizer files, with what repeats encoded once.

A text is cut into chunks at spaces where the tokenizer's pre-tokens always end, so
a text's ids are its chunks' ids in order. Values of chunks are remembered per
worker in a memo bounded in bytes; the chunks of a whole slice of texts that it
doesn't hold go to the library together, many in one call, and the bytes that each
token stands for tell which ids are whose. Texts with special tokens' strings or
with white space that regular expression engines define differently go to the
library whole. Tests compare all of it with the library on whole texts.
"""

from __future__ import annotations

import ctypes
import os
import re
import string
import struct
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Bytes of one generation of an encoder's and of a words' memo; two are kept, so what was used lately survives. Longer keys than MEMO_CHARS are not kept.
MEMO_BYTES, WORD_BYTES, MEMO_CHARS = 24 << 20, 8 << 20, 48
#: What an entry takes besides its key's and value's own bytes: two objects' heads and a dict's slot.
ENTRY_BYTES = 200
#: Chunks that go to the library in one call.
RUN = 128
#: Strings of punctuation in a memo.
TAILS = 20_000
#: The pre-token pattern of byte-level files; a fixed value of the format.
BYTE_LEVEL = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_UNEVEN, _CUT = r" [ \t-\r]", r" ([^ \t-\r])"  # for Arrow
_UNCLEAR = "[\x1c-\x1f\x85 ᠎ -‏ -  ⁠　﻿]"
_LATIN = re.compile("[^\x00-įĲ-ſ]")
#: Byte-level files name bytes by characters: printing ones of Latin-1 stand for themselves, the others are numbered from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_NAMES = {b: b for b in _PLAIN} | {b: 256 + n for n, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}
_SPACE = chr(_NAMES[32])


def named(word: str) -> str:
    """The UTF-8 bytes of a word by the names that byte-level files give them."""
    return word.encode().decode("latin-1").translate(_NAMES)


def halved(chunks: pa.StringArray) -> pa.StringArray:
    """Twice as many strings: of each chunk what comes before ASCII punctuation at its end, and that; the whole and nothing where no letter or digit is before."""
    core = pc.ascii_rtrim(chunks, string.punctuation)
    size, cut = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (chunks, core))
    cut = np.where(pc.match_substring_regex(core, r"[\pL\pN]$").to_numpy(zero_copy_only=False), cut, size)
    ends = np.cumsum(np.column_stack([cut, size - cut]).ravel())
    at = np.concatenate([[0], ends]).astype(np.int32)
    _, offsets, data = pa.concat_arrays([chunks.slice(0, 0), chunks]).buffers()
    first = np.frombuffer(offsets, np.int32)[0] if len(chunks) else 0
    return pa.StringArray.from_buffers(2 * len(chunks), pa.py_buffer(at + first), data)


def listed(strings: pa.Array) -> list[str]:
    """to_pylist, which goes string by string, in one call."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def gathered(ids: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ids, as long as `size` says, by their numbers, and the sizes of these."""
    many = size[number]
    to = np.cumsum(many)
    return ids[np.repeat((np.cumsum(size) - size)[number] - to + many, many) + np.arange(to[-1] if len(to) else 0)], many


_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]
_LIVE: list = []
_MODELS: dict[str, Tokenizer] = {}
_LIBC = ctypes.CDLL(None)  # gives freed memory back, which the allocator keeps otherwise


def only(owner):
    """owner, with the memos of all other operators emptied and all other files' models let go: a worker outlives many stages, what it holds must not add up."""
    for memo in _LIVE:
        if memo is not owner:
            memo.forget()
    for path in _MODELS.keys() - {getattr(owner, "path", None)}:
        del _MODELS[path]
    _trim()
    return owner


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def rest() -> None:
    """At a task's end: all memos are emptied. A file's model stays for the stage's next task, until `only` lets it go."""
    for memo in _LIVE:
        memo.forget()
    _trim()


def task(run):
    """run, which maps a task's batches, and `rest` behind it: else idle workers keep a memo while stages without Python need the memory."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            rest()

    return whole


class Memo(dict):
    """key -> make(key), in two generations bounded in bytes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0
        _LIVE.append(self)

    def forget(self) -> None:
        self.old, self.held = {}, 0
        self.clear()

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if self.held >= WORD_BYTES:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += ENTRY_BYTES + len(key) + len(value)
        return value


def load(path: str) -> Tokenizer:
    if path not in _MODELS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _MODELS[path] = tok
    return _MODELS[path]


class Encoder:
    """Texts -> values; a value of a text is what `total` makes of its chunks' values. `cut`, `halves` and `learn` depend on the kind of file.

    A slice's chunks are cut and numbered in Arrow, distinct ones once more into a
    part that ends in a letter or digit and ASCII punctuation behind it, where
    pre-tokens always end, so Python looks at each distinct part of a slice once.
    """

    def __init__(self, path: str):
        self.path = path
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.forget()
        _LIVE.append(self)

    @property
    def tok(self) -> Tokenizer:
        return load(self.path)

    def forget(self) -> None:
        self.now, self.old, self.held = {}, {}, 0

    def __call__(self, text: str):
        return self.many([text])[0]

    def many(self, texts: pa.Array | list[str]) -> list:
        """The values of texts, in order; null is empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        whole = self.unclear(texts)
        lists = self.cut(pc.if_else(whole, "", texts) if pc.any(whole).as_py() else texts)
        coded = lists.flatten().dictionary_encode()
        out = self.total(*self.halves(halved(coded.dictionary)), coded.indices.to_numpy(), lists.offsets.to_numpy())
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.whole(texts[i].as_py())
        return out

    def total(self, half: np.ndarray, values: list, number: np.ndarray, ends: np.ndarray) -> list:
        """Each text's ids. A chunk is values[half[2 * k]] and values[half[2 * k + 1]], a text the chunks number[i] between two ends."""
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids, size = gathered(np.frombuffer(b"".join(values), "<u4"), size, half)
        ids, size = gathered(ids, size.reshape(-1, 2).sum(1), number)
        raw, at = ids.tobytes(), (4 * np.concatenate([[0], np.cumsum(size)])[ends]).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def known(self, chunks: list[str]) -> list:
        """The values of distinct chunks, by the memo."""
        if self.held >= MEMO_BYTES:
            self.now, self.old, self.held = {}, self.now, 0
        now, old, new = self.now, self.old, []
        out = list(map(now.get, chunks))
        for i in [i for i, v in enumerate(out) if v is None]:
            c = chunks[i]
            v = old.get(c)
            if v is None:
                new.append(i)
            else:
                now[c] = out[i] = v
                self.held += ENTRY_BYTES + 5 * len(c)
        fresh = [chunks[i] for i in new]
        for i, c, v in zip(new, fresh, self.learn(fresh), strict=True):
            out[i] = v
            if len(c) <= MEMO_CHARS:
                now[c] = v
                self.held += ENTRY_BYTES + 5 * len(c)
        return out

    def unclear(self, texts: pa.Array) -> pa.Array:
        """Whether the library must see a text whole."""
        found = pc.match_substring_regex(texts, _UNCLEAR)
        for s in self.special:
            found = pc.or_(found, pc.match_substring(texts, s))
        return found

    def letters(self, names: list[str]) -> list[bytes]:
        """Ids of pre-tokens, given by the names that byte-level files give their bytes, straight by the library's model."""
        model = self.tok.model.tokenize
        return [_PACK[len(t)](*t) if len(t) < len(_PACK) else np.array(t, "<u4").tobytes() for t in ([x.id for x in model(name)] for name in names)]

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def whole(self, text: str):
        return self.ids(text).tobytes()

    def parts(self, joined: str, ends: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The ids of a joined text and how many of them come up to each of `ends`, in bytes."""
        ids = self.ids(joined)
        at = np.cumsum(width[ids])
        cuts = np.searchsorted(at, ends)
        if len(at) != cuts[-1] + 1 or (at[cuts] != ends).any():
            raise ValueError("tokens and chunks end at different bytes")
        return ids, (cuts + 1).tolist()


def sizes(chunks: list[str]) -> np.ndarray:
    return np.array([len(c) if c.isascii() else len(c.encode("utf-8", "surrogatepass")) for c in chunks])


class ByteLevel(Encoder):
    """Byte-level BPE: one space before a word belongs to it.

    White space in front of that space is split off, so no pre-token crosses a
    single space before a non-space. A chunk stands for ' ' + chunk; a text's first
    chunk, which has no space before it, is kept under MARK + chunk. Punctuation
    behind a chunk has a memo of its own, as it has no space before it.
    """

    MARK = "\0"

    def forget(self) -> None:
        super().forget()
        self.tails = {}

    def __init__(self, path: str):
        super().__init__(path)
        self.width = np.array([len(self.tok.id_to_token(i) or "") for i in range(self.tok.get_vocab_size())])

    def unclear(self, texts: pa.Array) -> pa.Array:
        return pc.or_(super().unclear(texts), pc.match_substring(texts, self.MARK))

    def cut(self, texts: pa.Array) -> pa.ListArray:
        texts, at = pc.binary_join_element_wise(self.MARK, texts, ""), " "
        if pc.any(pc.match_substring_regex(texts, _UNEVEN)).as_py():
            at = "\x1f"  # in no clear text
            texts = pc.replace_substring_regex(texts, _CUT, at + r"\1")
        return pc.split_pattern(texts, at)

    def halves(self, pairs: pa.Array) -> tuple[np.ndarray, list]:
        first, last = (pairs.take(pa.array(np.arange(k, len(pairs), 2))).dictionary_encode() for k in (0, 1))
        values = self.known(listed(first.dictionary))
        half = np.column_stack([first.indices.to_numpy(), last.indices.to_numpy() + len(values)]).ravel()
        if len(self.tails) > TAILS:
            self.tails = {}
        for t in listed(last.dictionary):
            v = self.tails.get(t)
            if v is None:
                v = self.whole(t)
                if len(t) <= MEMO_CHARS:
                    self.tails[t] = v
            values.append(v)
        return half, values

    def learn(self, new: list[str]) -> list:
        out, rest, names, whose = [None] * len(new), [], [], []
        for i, c in enumerate(new):
            first = c.startswith(self.MARK)
            word = c[1:] if first else c
            if word.isascii() and word.isalpha():
                names.append(word if first else _SPACE + word)
                whose.append(i)
            elif word.isalpha() and not _LATIN.search(word):
                names.append(named(word if first else " " + word))
                whose.append(i)
            elif first:
                out[i] = self.whole(word)
            else:
                rest.append(i)
        for i, v in zip(whose, self.letters(names), strict=True):
            out[i] = v
        for at in range(0, len(rest), RUN):
            some = [new[i] for i in rest[at : at + RUN]]
            ids, cuts = self.parts(" " + " ".join(some), np.cumsum(sizes(some) + 1), self.width)
            raw, a = ids.tobytes(), 0
            for i, b in zip(rest[at : at + RUN], cuts, strict=True):
                out[i] = raw[4 * a : 4 * b]
                a = b
        return out


class WordLevel(Encoder):
    """BPE with word ends on lower-cased words; chunks are what white space parts.

    In clear texts lower case changes single characters, and composing them changes nothing.
    """

    def __init__(self, path: str):
        super().__init__(path)
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.width = np.array([len(x.removesuffix("</w>")) for x in names])

    def unclear(self, texts: pa.Array) -> pa.Array:
        # lower-cased, a text may hold a special token's string that it doesn't hold as it is
        return pc.or_(super().unclear(pc.ascii_lower(texts)), pc.match_substring_regex(texts, _LATIN.pattern))

    def cut(self, texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(pc.replace_substring(texts, "\xa0", " "))

    def halves(self, pairs: pa.Array) -> tuple[np.ndarray, list]:
        coded = pc.utf8_lower(pairs).dictionary_encode()
        return coded.indices.to_numpy(), self.known(listed(coded.dictionary))

    def learn(self, new: list[str]) -> list:
        out, rest, names, whose = [b""] * len(new), [], [], []
        for i, c in enumerate(new):
            if c.isalpha():
                names.append(c if c.isascii() else named(c))
                whose.append(i)
            elif c:
                rest.append(i)
        for i, v in zip(whose, self.letters(names), strict=True):
            out[i] = v
        for at in range(0, len(rest), RUN):
            some = [new[i] for i in rest[at : at + RUN]]
            ids, cuts = self.parts(" ".join(some), np.cumsum(sizes(some)), self.width)
            raw, a = ids.tobytes(), 0
            for i, b in zip(rest[at : at + RUN], cuts, strict=True):
                out[i] = raw[4 * a : 4 * b]
                a = b
        return out


@cache
def byte_level_ids(path: str) -> ByteLevel:
    """text -> ids as little-endian unsigned 32-bit integers."""
    return ByteLevel(path)


@cache
def word_level_ids(path: str) -> WordLevel:
    """text -> ids as little-endian unsigned 32-bit integers."""
    return WordLevel(path)
