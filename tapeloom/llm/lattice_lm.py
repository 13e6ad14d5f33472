"""Language-model scores from a subword lattice.

The vocabulary is that of a public tokenizer and never changes. Its scores set the prior
of a unigram over pieces, and one round of expected counts over the training words (every
distinct word with its count, all segmentations weighted) fits it. A word's probability
is the sum over all its segmentations, by a forward recursion in log space; a text's is
the product over its words and one end.

Beside it stands the plain word unigram with add-one smoothing, over counts of all
training text. Words with many occurrences are so few that their counts are sent to the
tasks; the rest of the words meet their counts in hash buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.subwords import Table, tokenizer_file
from tapeloom.llm.words import POWERS, VALUE, Words, chunks, folded, mix, ragged, row_of, with_digests, words
from tapeloom.session import cut_lineage

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD = 7, 2
# Words with at least 1 / HOT of all training tokens are sent to the tasks: HOT of them at most.
HOT = 50_000
# Training tokens a hash bucket stands for; distinct words a task holds before it passes them on.
BUCKET_TOKENS, FLUSH_WORDS = 4_000_000, 200_000
# Scored words a worker remembers; bytes from which a word is worked on alone.
REMEMBERED, LONG = 1_000_000, 96
# Bytes of long words that are learned from together, about.
LONG_BYTES = 65_536
# Weight of the vocabulary's own scores against the expected counts, in pieces.
PRIOR = 1_000.0
_SPACE = "▁"


class Vocabulary(NamedTuple):
    pieces: list[bytes]
    prior: np.ndarray


def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """Pieces as bytes (a blank marks a word's begin) and prior probabilities from their scores.

    A merge vocabulary scores by rank, so the prior falls with the rank as word frequencies
    do. All single bytes are pieces, which gives every text a probability.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            # The tokenizer's text is folded here, so pieces that differ by case of A-Z are one.
            p = model.id_to_piece(i).replace(_SPACE, " ").encode()
            p = folded(np.frombuffer(p, dtype=np.uint8)).tobytes()
            found[p] = found.get(p, 0.0) + 1.0 / (10.0 + abs(model.get_score(i)))
    for b in range(256):
        found.setdefault(bytes([b]), 1e-5)
    prior = np.array(list(found.values()))
    return Vocabulary(list(found), prior / prior.sum())


class Lattice:
    """All segmentations of words, many words of equal length at a time."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray) -> None:
        self.log_p = np.concatenate([log_p, [-np.inf]])  # entry -1: no piece
        self.longest = max(map(len, pieces))
        self.id = {p: i for i, p in enumerate(pieces)}
        up, _ = POWERS.get(self.longest + LONG + 2)
        codes = [int((VALUE[np.frombuffer(p, dtype=np.uint8)] * up[:len(p)]).sum(dtype=np.uint64)) for p in pieces]
        self.table = Table(1 << 17)
        self.table.add(mix(np.array(codes, dtype=np.uint64)))
        self.sizes = {len(p) for p in pieces}
        self.lengths = np.array(sorted(self.sizes))

    def _edges(self, group: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(from, to) -> (rows, piece ids) of the pieces in a matrix of words."""
        n, size = group.shape
        up, down = POWERS.get(self.longest + LONG + 2)
        run = np.zeros((size + 1, n), dtype=np.uint64)
        np.cumsum((VALUE[group] * up[:size]).T, axis=0, out=run[1:])
        out = {}
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                if j - i in self.sizes:
                    ids = self.table.find(mix((run[j] - run[i]) * down[i]))
                    rows = np.flatnonzero(ids >= 0)
                    if len(rows):
                        out[i, j] = rows, ids[rows]
        return out

    def _forward(self, edges: dict, n: int, size: int) -> np.ndarray:
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0.0
        for (i, j), (rows, ids) in edges.items():
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.log_p[ids])
        return alpha

    def _alone(self, word: bytes) -> float:
        """Forward recursion of one long word."""
        alpha = [0.0] + [-np.inf] * len(word)
        for j in range(1, len(word) + 1):
            found = [alpha[i] + self.log_p[k] for i in range(max(0, j - self.longest), j)
                     if (k := self.id.get(word[i:j])) is not None]
            top = max(found)
            alpha[j] = top + float(np.log(sum(np.exp(x - top) for x in found)))
        return alpha[-1]

    def _groups(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 8_192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, matrix of their bytes with a blank in front) for words under LONG bytes."""
        for n in np.unique(size[size < LONG]).tolist():
            every = np.flatnonzero(size == n)
            for k in range(0, len(every), most):
                some = every[k:k + most]
                group = np.full((len(some), n + 1), 0x20, dtype=np.uint8)
                group[:, 1:] = flat[start[some][:, None] + np.arange(n)]
                yield some, group

    def log_probabilities(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Natural logs of the marginal probability of each word (a slice of ``flat``)."""
        out = np.zeros(len(start))
        for some, group in self._groups(flat, start, size):
            out[some] = self._forward(self._edges(group), *group.shape)[-1]
        for k in np.flatnonzero(size >= LONG).tolist():
            out[k] = self._alone(b" " + flat[start[k]:start[k] + size[k]].tobytes())
        return out

    def expected_counts(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of every piece over all segmentations, words weighted by ``count``."""
        out = np.zeros(len(self.log_p) - 1)
        for some, group in self._groups(flat, start, size):
            edges = self._edges(group)
            alpha = self._forward(edges, *group.shape)
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0.0
            for (i, j), (rows, ids) in reversed(edges.items()):
                beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + self.log_p[ids])
            for (i, j), (rows, ids) in edges.items():
                share = np.exp(alpha[i, rows] + self.log_p[ids] + beta[j, rows] - alpha[-1, rows]) * count[some[rows]]
                out += np.bincount(ids, weights=share, minlength=len(out))
        long_ = np.flatnonzero(size >= LONG)
        long_ = long_[np.argsort(size[long_], kind="stable")]
        k = 0
        while k < len(long_):
            # Words of about one length; the block length bounds what a step holds, however long they are.
            end = k + 1
            while end < len(long_) and (end + 1 - k) * int(size[long_[end]]) <= LONG_BYTES and size[long_[end]] <= 1.25 * size[long_[k]]:
                end += 1
            some = long_[k:end]
            self._long_counts([flat[start[w]:start[w] + size[w]] for w in some.tolist()], count[some], out)
            k = end
        return out

    def _starts(self, group: np.ndarray, ends: np.ndarray, a: int, b: int) -> np.ndarray:
        """Ids of the pieces of each length that start at rows a .. b - 1 of a matrix of words (-1: none, or beyond the word)."""
        part = group[a:b + self.longest]
        up, down = POWERS.get(len(part) + 1)
        run = np.zeros((len(part) + 1, group.shape[1]), dtype=np.uint64)
        np.cumsum(VALUE[part] * up[:len(part), None], axis=0, out=run[1:])
        ids = np.empty((b - a, len(self.lengths), group.shape[1]), dtype=np.int32)
        at = np.arange(b - a)
        for k, n in enumerate(self.lengths.tolist()):
            found = self.table.find(mix((run[at + n] - run[at]) * down[at, None]).ravel()).reshape(b - a, -1)
            ids[:, k] = np.where(a + at[:, None] + n <= ends, found, -1)
        return ids

    def _long_counts(self, raw: list[np.ndarray], count: np.ndarray, out: np.ndarray) -> None:
        """Add the expected uses in long words, forward and backward over blocks of positions."""
        ends = np.array([len(w) + 1 for w in raw])
        most = int(ends.max())
        group = np.zeros((most + self.longest, len(raw)), dtype=np.uint8)
        group[0] = 0x20
        for r, w in enumerate(raw):
            group[1:len(w) + 1, r] = w
        rows, block = np.arange(len(raw)), max(64, LONG_BYTES // (4 * len(raw)))
        blocks = [(a, min(a + block, most)) for a in range(0, most, block)]
        alpha = np.full((most + self.longest + 1, len(raw)), -np.inf)
        alpha[0] = 0.0
        for a, b in blocks:
            log_p = self.log_p[self._starts(group, ends, a, b)]
            for i in range(a, b):
                to = i + self.lengths
                alpha[to] = np.logaddexp(alpha[to], alpha[i] + log_p[i - a])
        total = alpha[ends, rows]
        beta = np.full(alpha.shape, -np.inf)
        beta[ends, rows] = 0.0
        for a, b in reversed(blocks):
            ids = self._starts(group, ends, a, b)
            log_p = self.log_p[ids]
            for i in range(b - 1, a - 1, -1):
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(log_p[i - a] + beta[i + self.lengths], axis=0))
            at, k, r = np.nonzero(ids >= 0)
            used = ids[at, k, r]
            share = np.exp(alpha[a + at, r] + self.log_p[used] + beta[a + at + self.lengths[k], r] - total[r]) * count[r]
            out += np.bincount(used, weights=share, minlength=len(out))


def is_held(doc_id, folds: int = FOLDS, held: int = HELD) -> bool:
    """Whether a document is kept from learning; one without an id is."""
    return doc_id is None or crc32(str(doc_id).encode()) % folds == held


def training_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the training rows, A-Z folded: counted in the tasks first, then summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, texts, sizes = [], [], [], []

        def flush() -> pa.RecordBatch:
            code, flat, size = np.concatenate(codes), np.concatenate(texts), np.concatenate(sizes)
            _, first, back = np.unique(code, return_index=True, return_inverse=True)
            n = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
            begin = np.cumsum(size) - size
            out = flat[ragged(begin[first], size[first])]
            ends = np.concatenate([[0], np.cumsum(size[first])]).astype(np.int64)
            word = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(out)])
            for held in (codes, counts, texts, sizes):
                held.clear()
            return pa.record_batch([word.cast(pa.binary()), pa.array(n)], names=["word", "n"])

        for batch in batches:
            learn = np.array([not is_held(i) for i in batch.column(0).to_pylist()], dtype=bool)
            for chunk in chunks(batch.column(1)):
                ws = words(chunk)
                own = learn[chunk.first + row_of(ws.at)]
                code, first, back = np.unique(ws.code[own], return_index=True, return_inverse=True)
                if not len(code):
                    continue
                at = np.flatnonzero(own)[first]
                size = ws.end[at] - ws.start[at]
                codes.append(code)
                counts.append(np.bincount(back))
                texts.append(folded(chunk.buf)[ragged(ws.start[at], size)])
                sizes.append(size)
                if sum(map(len, codes)) >= FLUSH_WORDS:
                    yield flush()
        if codes:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, off[:-1], np.diff(off)


def fit(counted: DataFrame, ends: int, vocab: Vocabulary) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end, from one round of expected counts.

    ``counted`` holds every distinct training word; one row per piece comes back.
    """
    spark = counted.sparkSession
    held = spark.sparkContext.broadcast((vocab.pieces, np.log(vocab.prior)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*held.value)
        total = np.zeros(len(lattice.log_p) - 1)
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += lattice.expected_counts(*_slices(batch.column(0)), n)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])

    found = counted.select("word", "n").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = PRIOR * vocab.prior
    for r in found:
        counts[r["piece"]] += r["n"]
    all_ = counts.sum() + ends + 1.0
    return np.log(counts / all_), float(np.log((ends + 1.0) / all_))


class _Scores:
    """Log probabilities of words, remembered by their code."""

    def __init__(self, lattice: Lattice) -> None:
        self.lattice = lattice
        self._forget()

    def _forget(self) -> None:
        self.table, self.value = Table(1 << 20), np.zeros(1 << 18)

    def of(self, buf: np.ndarray, ws: Words) -> np.ndarray:
        if self.table.used > REMEMBERED:
            self._forget()
        codes = np.maximum(ws.code, np.uint64(1))
        at = self.table.find(codes)
        new = np.flatnonzero(at < 0)
        if len(new):
            unknown, first = np.unique(codes[new], return_index=True)
            w = new[first]
            got = self.lattice.log_probabilities(folded(buf), ws.start[w], ws.end[w] - ws.start[w])
            used = self.table.used
            while used + len(got) > len(self.value):
                self.value = np.concatenate([self.value, np.zeros_like(self.value)])
            self.value[used:used + len(got)] = got
            self.table.add(unknown)
            at[new] = self.table.find(codes[new])
        return self.value[at]


# Rows that meet in a bucket: counts of words, words of texts, or a text with what its task knows of it.
_PARTS = "bucket int, codes binary, counts binary, uids binary, uid long, doc_id {id}, n_tokens long, base double, known long, score double"
_SUMS = "uid long, doc_id {id}, n_tokens long, base double, known long, score double"
_NAMES = ["bucket", "codes", "counts", "uids", "uid", "doc_id", "n_tokens", "base", "known", "score"]


def _buckets(code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and where each bucket begins."""
    bucket = (mix(code) % np.uint64(n)).astype(np.int32)
    return np.argsort(bucket, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])


def count_parts(counted: DataFrame, n: int, id_type: str) -> DataFrame:
    """The counts as bucket rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, start, size = _slices(batch.column(0))
            if not len(start):
                continue
            flat = flat[ragged(start, size)]
            end = np.cumsum(size)
            code = word_codes(flat, end - size, end)
            order, at = _buckets(code, n)
            code, c = code[order], batch.column(1).to_numpy(zero_copy_only=False)[order]
            used = np.flatnonzero(np.diff(at))
            empty = pa.nulls(len(used))
            yield _part(used, [code[at[b]:at[b + 1]].tobytes() for b in used], [c[at[b]:at[b + 1]].tobytes() for b in used],
                        empty, empty, empty, empty, empty, empty, empty)

    schema = _PARTS.format(id=id_type)
    kind = _id_arrow(counted, id_type)

    def _part(*cols) -> pa.RecordBatch:
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), kind, pa.int64(), pa.float64(), pa.int64(), pa.float64()]
        return pa.record_batch([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names=_NAMES)

    return counted.select("word", "n").mapInArrow(run, schema)


def _id_arrow(df: DataFrame, id_type: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(id_type))


def word_codes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of words given as slices, as ``words`` gives them to folded text."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + (1 << 20), side="right")))
        a, b = start[i], end[j - 1]
        up, down = POWERS.get(b - a + 1)
        run = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(VALUE[flat[a:b]] * up[:-1], out=run[1:])
        out[i:j] = (run[end[i:j] - a] - run[start[i:j] - a]) * down[start[i:j] - a]
        i = j
    return with_digests(mix(out), flat, start, end)


def text_parts(docs: DataFrame, model: tuple, hot: tuple[np.ndarray, np.ndarray], n: int) -> DataFrame:
    """Every row scored by the lattice, and its words without a hot count in buckets."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast((model, hot))
    kind = _id_arrow(docs, id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (pieces, log_p, log_end), (hot_code, hot_count) = held.value
        scores = _Scores(Lattice(pieces, log_p))
        base, seen = TaskContext.get().partitionId() << 36, 0
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), kind, pa.int64(), pa.float64(), pa.int64(), pa.float64()]
        codes, uids, held_words = [], [], 0

        def flush() -> pa.RecordBatch:
            code, uid = np.concatenate(codes), np.concatenate(uids)
            order, at = _buckets(code, n)
            code, uid = code[order], uid[order]
            used = np.flatnonzero(np.diff(at))
            none = pa.nulls(len(used))
            cols = [pa.array(used.astype(np.int32)), pa.array([code[at[b]:at[b + 1]].tobytes() for b in used], pa.binary()),
                    none.cast(pa.binary()), pa.array([uid[at[b]:at[b + 1]].tobytes() for b in used], pa.binary())]
            codes.clear()
            uids.clear()
            return pa.record_batch(cols + [none.cast(t) for t in types[4:]], names=_NAMES)

        for batch in batches:
            for chunk in chunks(batch.column(1)):
                ws = words(chunk)
                rows = len(ws.at) - 1
                row = row_of(ws.at)
                uid = base + seen + np.arange(rows)
                seen += rows
                sure = np.bincount(row, weights=scores.of(chunk.buf, ws), minlength=rows) if len(row) else np.zeros(rows)
                where = np.minimum(np.searchsorted(hot_code, ws.code), max(len(hot_code) - 1, 0))
                is_hot = hot_code[where] == ws.code if len(hot_code) else np.zeros(len(ws.code), dtype=bool)
                plain = np.bincount(row[is_hot], weights=np.log10(hot_count[where[is_hot]] + 1.0), minlength=rows)
                known = np.bincount(row[is_hot], minlength=rows)
                codes.append(ws.code[~is_hot])
                uids.append(uid[row[~is_hot]])
                held_words += int((~is_hot).sum())
                none = pa.nulls(rows).cast(pa.binary())
                yield pa.record_batch([
                    pa.array((uid % n).astype(np.int32)), none, none, none, pa.array(uid), batch.column(0).slice(chunk.first, rows),
                    pa.array(np.diff(ws.at) + 1), pa.array(plain.astype(float)), pa.array(known.astype(np.int64)),
                    pa.array((sure + log_end) / np.log(10.0))], names=_NAMES)
                if held_words >= 1_000_000:
                    yield flush()
                    held_words = 0
        if held_words:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, _PARTS.format(id=id_type))


_OWN = ["uid", "doc_id", "n_tokens", "base", "known", "score"]


def meet(parts: DataFrame, n: int, id_type: str) -> DataFrame:
    """Per bucket, sums over the words of each text with their counts, packed by bucket of the text; texts' rows pass through."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = table.filter(pc.is_valid(table["uid"])).select(["bucket", *_OWN])

        def flat(name: str, kind, other: str) -> np.ndarray:
            rows = table.filter(pc.and_(pc.is_valid(table[name]), pc.is_valid(table[other])))
            return np.frombuffer(b"".join(rows[name].to_pylist()), dtype=kind)

        code, count = flat("codes", np.uint64, "counts"), flat("counts", np.int64, "counts")
        word, uid = flat("codes", np.uint64, "uids"), flat("uids", np.int64, "uids")
        order = np.argsort(code)
        code, count = code[order], count[order]
        where = np.minimum(np.searchsorted(code, word), max(len(code) - 1, 0))
        hit = code[where] == word if len(code) else np.zeros(len(word), dtype=bool)
        users, back = np.unique(uid[hit], return_inverse=True)
        base = np.bincount(back, weights=np.log10(count[where[hit]] + 1.0), minlength=len(users)).astype(float)
        known = np.bincount(back, minlength=len(users)).astype(np.int64)
        bucket = users % n
        order = np.argsort(bucket, kind="stable")
        at = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n))])
        used = np.flatnonzero(np.diff(at))
        packed = [pa.array([x[order][at[b]:at[b + 1]].tobytes() for b in used.tolist()], pa.binary()) for x in (users, base, known)]
        sums = pa.table([pa.array(used.astype(np.int32)), *packed], names=["bucket", "uids", "bases", "knowns"])
        out = pa.concat_tables([own, sums], promote_options="default")
        return out.select(["bucket", "uids", "bases", "knowns", *_OWN])

    return parts.groupBy("bucket").applyInArrow(
        run, f"bucket int, uids binary, bases binary, knowns binary, {_SUMS.format(id=id_type)}")


def total(met: DataFrame, id_type: str) -> DataFrame:
    """One row a text: what its task knew and the sums of all buckets."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = table.filter(pc.is_valid(table["uid"])).select(_OWN)
        own = own.take(pc.sort_indices(own["uid"]))
        packed = table.filter(pc.is_valid(table["uids"]))
        uid, base, known = (np.frombuffer(b"".join(packed[c].to_pylist()), dtype=t)
                            for c, t in (("uids", np.int64), ("bases", np.float64), ("knowns", np.int64)))
        row = np.searchsorted(own["uid"].to_numpy(), uid)
        more = np.bincount(row, weights=base, minlength=own.num_rows), np.bincount(row, weights=known, minlength=own.num_rows)
        out = own.set_column(3, "base", pa.array(own["base"].to_numpy() + more[0]))
        return out.set_column(4, "known", pa.array(own["known"].to_numpy() + more[1].astype(np.int64)))

    return met.groupBy("bucket").applyInArrow(run, _SUMS.format(id=id_type))


def score(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is its end alone. Rows without an id are held out. Repeated rows
    are learned from and scored each for itself. With no training row nothing is known and
    the pieces keep the vocabulary's own scores. Other columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    ends = docs.filter(fold != HELD).count()
    counted = cut_lineage(training_words(docs))
    of_all = counted.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, distinct = (of_all["n"] or 0) + ends, of_all["v"] + (ends > 0)
    vocab = vocabulary(name)
    model = (vocab.pieces, *fit(counted, ends, vocab))
    # At most HOT words can have that share of all tokens.
    rows = counted.filter(F.col("n") * HOT >= max(n_all, 1)).collect()
    flat = np.frombuffer(b"".join(bytes(r["word"]) for r in rows), dtype=np.uint8)
    end = np.cumsum([len(r["word"]) for r in rows], dtype=np.int64)
    code = word_codes(flat, np.concatenate([[0], end])[:-1].astype(np.int64), end) if rows else np.zeros(0, np.uint64)
    count = np.array([r["n"] for r in rows], dtype=np.float64)
    order = np.argsort(code)
    n = 1 + n_all // BUCKET_TOKENS
    cold = counted.filter(F.col("n") * HOT < max(n_all, 1))
    parts = text_parts(docs, model, (code[order], count[order]), n).unionByName(count_parts(cold, n, id_type))
    sums = total(meet(parts, n, id_type), id_type)
    size = float(np.log10(n_all + distinct + 1.0))
    end_base = float(np.log10(ends + 1.0))
    return sums.select(
        "doc_id", F.coalesce(fold == HELD, F.lit(True)).alias("held_out"), "n_tokens",
        (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + end_base - F.col("n_tokens") * size).alias("base_score"), "score")
