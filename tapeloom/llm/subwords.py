"""Subword ids of whole texts through a public tokenizer, word by word.

``word_bpe_49k.json`` drops white space and never joins text across it, so the ids
of a text are those of its words in order. Every task asks the tokenizer once for
each new word (lower case, as the tokenizer folds it anyway) and gathers the rest.
"""

from __future__ import annotations

import os

import numpy as np

from tapeloom.llm.words import Chunk, folded, ragged, words

TOKENIZER = "word_bpe_49k.json"
# Words that a worker remembers before it starts over (about 150 MB).
REMEMBERED = 2_000_000
# Slots to begin with; the table grows with the words it holds.
_SLOTS = 1 << 16
_ASK = 5_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def marks(chunk: Chunk) -> np.ndarray:
    """Single marks between an ASCII letter and the end of a word.

    The tokenizer splits there in any case; without them far fewer words differ.
    """
    buf, out = chunk.buf, np.zeros(len(chunk.buf), dtype=bool)
    if len(buf) > 1:
        out[1:] = _MARK[buf[1:]] & _LETTER[buf[:-1]]
        last = np.zeros(len(buf), dtype=bool)
        last[:-1] = _BLANK[buf[1:]]
        inner = chunk.off[(chunk.off > 0) & (chunk.off <= len(buf))]
        last[inner - 1] = True
        out &= last
    return out


def tokenizer_file(name: str) -> str:
    """A path as it is, or the place of a public vocabulary file on this machine."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """Codes and their numbers in open addressing, looked up and filled by whole arrays."""

    def __init__(self, slots: int = _SLOTS) -> None:
        self.key = np.zeros(slots, dtype=np.uint64)
        self.number = np.zeros(slots, dtype=np.int32)
        self.used = 0

    def _probe(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each code, or the free slot where it would go; whether it is there."""
        at = (codes & np.uint64(len(self.key) - 1)).astype(np.int64)
        key = self.key[at]
        open_ = np.flatnonzero((key != codes) & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.key) - 1)
            key[open_] = self.key[at[open_]]
            k = key[open_]
            open_ = open_[(k != codes[open_]) & (k != 0)]
        return at, key == codes

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the codes, -1 where unknown."""
        at, there = self._probe(codes)
        return np.where(there, self.number[at], -1)

    def add(self, codes: np.ndarray) -> None:
        """Number distinct new codes from ``used`` on."""
        numbers = self.used + np.arange(len(codes))
        self.used += len(codes)
        if self.used > 0.7 * len(self.key):  # one row may hold more words than fit
            held = np.flatnonzero(self.key)
            codes = np.concatenate([self.key[held], codes])
            numbers = np.concatenate([self.number[held], numbers])
            size = len(self.key)
            while self.used > 0.5 * size:
                size *= 2
            self.key, self.number = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int32)
        while len(codes):
            at, _ = self._probe(codes)
            _, first = np.unique(at, return_index=True)
            self.key[at[first]], self.number[at[first]] = codes[first], numbers[first]
            rest = np.ones(len(codes), dtype=bool)
            rest[first] = False
            codes, numbers = codes[rest], numbers[rest]


class WordEncoder:
    """Ids of words, remembered by their code."""

    def __init__(self, name: str = TOKENIZER) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(tokenizer_file(name))
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self._forget()

    def _forget(self) -> None:
        self.table = Table()
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.begin = np.zeros(1 << 18, dtype=np.int64)

    def _learn(self, texts: list[str], codes: np.ndarray) -> None:
        for i in range(0, len(texts), _ASK):
            some = texts[i:i + _ASK]
            place = np.cumsum([0] + [len(t) + 1 for t in some])
            found = self.model.encode(" ".join(some), add_special_tokens=False)
            heads = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            counts = np.bincount(np.searchsorted(place, heads, side="right") - 1, minlength=len(some))
            known = self.table.used
            used = int(self.begin[known])
            while used + len(heads) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while known + len(some) >= len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.ids[used:used + len(heads)] = found.ids
            self.begin[known + 1:known + len(some) + 1] = used + np.cumsum(counts)
            self.table.add(codes[i:i + _ASK])

    def numbers(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of the chunk, and where each row's words begin."""
        ws = words(chunk, cut=marks(chunk))
        codes = np.maximum(ws.code, np.uint64(1))
        if self.table.used > REMEMBERED:
            self._forget()
        out = self.table.find(codes)
        new = np.flatnonzero(out < 0)
        if len(new):
            unknown, first = np.unique(codes[new], return_index=True)
            at = new[first]
            raw = folded(chunk.buf).tobytes()
            self._learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(ws.start[at].tolist(), ws.end[at].tolist())],
                        unknown)
            out[new] = self.table.find(codes[new])
        return out, ws.at

    def counts(self, chunk: Chunk) -> np.ndarray:
        """How many ids each row of the chunk has."""
        n, at = self.numbers(chunk)
        ends = np.concatenate([[0], np.cumsum(self.begin[n + 1] - self.begin[n])])
        return np.diff(ends[at])

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunk's rows, one after another, and where each row's begin."""
        n, at = self.numbers(chunk)
        begin = self.begin[n]
        size = self.begin[n + 1] - begin
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[ragged(begin, size)], ends[at]

    def with_end(self, chunk: Chunk, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each row."""
        ids, at = self.encode(chunk)
        rows = len(at) - 1
        out = np.full(len(ids) + rows, end_id, dtype=np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(at))] = ids
        return out, at + np.arange(rows + 1)
