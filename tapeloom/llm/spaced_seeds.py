"""Benchmark decontamination by spaced-seed hashing.

A mask looks at some of a run of words and ignores the others, so a hit survives
substitutions at the ignored places. Hashes of benchmark and training text under the same
masks are joined; every hit fixes an alignment, along which windows of words are compared
and up to ``SUBSTITUTIONS`` of them may differ. With these masks no such window goes unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.words import PUNCTUATION, Chunk, Words, chunks, mix, row_of, words

# Together they hit every run of WINDOW words with at most SUBSTITUTIONS of them changed (a test tries all).
MASKS = ("11101011", "11010010011")
WINDOW, SUBSTITUTIONS = 13, 2
# Shorter benchmark items must be found word for word; under SHORTEST words they say nothing.
SHORTEST = 3
# Bytes of benchmark text that are sent to the tasks at once; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_FILTER_BITS = 22


class Index(NamedTuple):
    """Seeds of a block of items: sorted hashes with item and place; the items' words."""

    masks: list[tuple[int, ...]]
    hash: list[np.ndarray]
    item: list[np.ndarray]
    place: list[np.ndarray]
    code: np.ndarray
    at: np.ndarray
    ids: list


def text_words(chunk: Chunk) -> Words:
    """Runs of letters and digits; case of A-Z and ASCII punctuation don't matter."""
    return words(chunk, blanks=PUNCTUATION)


def seeds(code: np.ndarray, row: np.ndarray, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every placement of a mask inside a row."""
    span = offsets[-1] + 1
    n = len(code) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(n, span, dtype=np.uint64)
    for k, o in enumerate(offsets):
        h += code[o:o + n] * _FACTORS[k]
    first = np.flatnonzero(row[:n] == row[span - 1:])
    return mix(h[first]), first


def build_index(ids: list, texts: list[str]) -> Index:
    """Seeds of benchmark items: the masks for long items, all words at once for those under WINDOW."""
    parts = [(text_words(c), c.first) for c in chunks(pa.array(texts, pa.string()))]
    code = np.concatenate([w.code for w, _ in parts]) if parts else np.zeros(0, np.uint64)
    size = np.concatenate([np.diff(w.at) for w, _ in parts]) if parts else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    row = row_of(at)
    masks = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS]
    masks += [tuple(range(n)) for n in sorted({int(n) for n in size if SHORTEST <= n < WINDOW})]
    found = []
    for m, offsets in enumerate(masks):
        h, first = seeds(code, row, offsets)
        length = size[row[first]]
        own = length >= WINDOW if m < len(MASKS) else length == len(offsets)
        h, first = h[own], first[own]
        order = np.argsort(h, kind="stable")
        found.append((h[order], row[first[order]], first[order]))
    return Index(masks, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found], code, at, list(ids))


class Overlap(NamedTuple):
    row: int
    item: int
    item_words: int
    covered: int
    matched: int
    first_word: int


def _verified(ws: Words, index: Index, row: int, item: int, shift: int) -> tuple[int, int, int] | None:
    """(covered, matched, first word) of an item aligned with a row, or None without a good window."""
    a, b = index.at[item], index.at[item + 1]
    size = b - a
    window = min(WINDOW, size)
    allowed = SUBSTITUTIONS if size >= WINDOW else 0
    lo, hi = max(0, ws.at[row] - shift), min(size, ws.at[row + 1] - shift)
    if hi - lo < window:
        return None
    same = ws.code[lo + shift:hi + shift] == index.code[a + lo:a + hi]
    run = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(run[window:] - run[:-window] >= window - allowed)
    if not len(good):
        return None
    inside = np.zeros(hi - lo + 1, dtype=np.int64)
    np.add.at(inside, good, 1)
    np.add.at(inside, good + window, -1)
    inside = np.cumsum(inside)[:-1] > 0
    return int(inside.sum()), int((inside & same).sum()), int(lo + good[0] + shift - ws.at[row])


def _filters(index: Index) -> list[np.ndarray]:
    out = []
    for h in index.hash:
        bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bits[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        out.append(bits)
    return out


def overlaps(chunk: Chunk, index: Index, bits: list[np.ndarray]) -> list[Overlap]:
    """The best verified overlap of every (row, item) of a chunk."""
    ws = text_words(chunk)
    row = row_of(ws.at)
    tries = []
    for m, offsets in enumerate(index.masks):
        if not len(index.hash[m]):
            continue
        h, first = seeds(ws.code, row, offsets)
        some = np.flatnonzero(bits[m][(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        lo = np.searchsorted(index.hash[m], h[some])
        n = np.searchsorted(index.hash[m], h[some], side="right") - lo
        some, lo, n = some[n > 0], lo[n > 0], n[n > 0]
        for s, a, k in zip(first[some].tolist(), lo.tolist(), n.tolist()):
            # An alignment is the row, the item, and how far the row's words lie behind the item's.
            tries.append(np.column_stack([np.full(k, row[s]), index.item[m][a:a + k],
                                          s - (index.place[m][a:a + k] - index.at[index.item[m][a:a + k]])]))
    best: dict[tuple[int, int], Overlap] = {}
    for r, i, shift in (np.unique(np.concatenate(tries), axis=0).tolist() if tries else ()):
        v = _verified(ws, index, r, i, shift)
        if v and (((r, i) not in best) or v > (best[r, i].covered, best[r, i].matched, best[r, i].first_word)):
            best[r, i] = Overlap(chunk.first + r, i, int(index.at[i + 1] - index.at[i]), *v)
    return list(best.values())


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes of the whole benchmark, one bounded block after another (null texts have no words)."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("_t"))
    total = items.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "_t"), F.lit(n)) == k).collect()
        yield build_index([r["item_id"] for r in rows], [r["_t"] for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps (doc_id, item_id, item_words, covered_words, matched_words, first_word) of all rows.

    Clean documents have no row; a null text has no words; repeated rows repeat theirs.
    """
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item.simpleString()}, item_words int, covered_words int, matched_words int, first_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            bits = _filters(index)
            for batch in batches:
                found = [o for c in chunks(batch.column(1)) for o in overlaps(c, index, bits)]
                ids = pa.array([index.ids[o.item] for o in found], _arrow_type(item))
                numbers = [pa.array([o[k] for o in found], t) for k, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.int32()), (5, pa.int64()))]
                yield pa.record_batch([batch.column(0).take(pa.array([o.row for o in found], pa.int64())), ids, *numbers], names=[
                    "doc_id", "item_id", "item_words", "covered_words", "matched_words", "first_word"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, all columns as they were."""
    at = docs.columns.index("text")
    for index in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            bits = _filters(index)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for c in chunks(batch.column(at)):
                    keep[[o.row for o in overlaps(c, index, bits)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
