"""Token ids as packed matrices: best-fit-decreasing with a segment tree over capacities.

Every task packs the pieces of its own documents, block by block, so nothing is
shuffled and a block bounds the memory. Texts longer than a row are split without
loss; a row holds the ids, where its segments begin and end, and where positions
start again (at zero, or at the place in the document for a later piece).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.subwords import TOKENIZER, WordEncoder
from tapeloom.llm.words import chunks
from tapeloom.session import scratch_path

ROW = 2048
# Ids that a task packs at once.
BLOCK_IDS = 1 << 22


class CapacityTree:
    """Open bins by room left; finds the least room that still fits, in log2(capacity) steps."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the least room of at least ``size``."""
        i = size + self.leaves
        if not self.count[i]:
            # Climb to the first right-hand neighbour that holds a bin, then go down its left edge.
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        bin_ = self.bins[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, bin_


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items in descending size, equal sizes in their order."""
    tree, bins = CapacityTree(capacity), []
    for k in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
        found = tree.take(sizes[k])
        if found is None:
            found = capacity, len(bins)
            bins.append([])
        room, b = found
        bins[b].append(k)
        tree.put(room - sizes[k], b)
    return bins


MATRIX = ("sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, "
          "pieces array<int>, starts array<long>")


def packed_rows(docs: DataFrame, row: int = ROW, tokenizer: str = TOKENIZER, end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """Rows of ``row`` little-endian unsigned 16-bit ids (``pad_id`` after ``n_tokens``).

    ``cu_seqlens`` has the segment ends from 0 on; segment i is piece ``pieces[i]`` of
    ``doc_ids[i]`` and its first id has position ``starts[i]`` in that document. A null or
    empty text is a segment with the end id alone. Needs a vocabulary under 65,536.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder(tokenizer)  # of this task alone: a reused worker would go on holding it
        base, made = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []
        held_ids = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, held_ids
            out = []
            for members in best_fit_decreasing([len(p[3]) for p in held], row):
                matrix = np.full(row, pad_id, dtype="<u2")
                ends = np.cumsum([0] + [len(held[k][3]) for k in members])
                for k, a, b in zip(members, ends[:-1], ends[1:]):
                    matrix[a:b] = held[k][3]
                out.append((base + made, matrix.tobytes(), int(ends[-1]), ends.tolist(), [held[k][0] for k in members],
                            [held[k][1] for k in members], [held[k][2] for k in members]))
                made += 1
            held, held_ids = [], 0
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()),
                     pa.list_(pa.int64())]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[
                "sequence_id", "ids", "n_tokens", "cu_seqlens", "doc_ids", "pieces", "starts"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1)):
                ids, at = enc.with_end(chunk, end_id)
                ids = ids.astype("<u2")
                for d in range(len(at) - 1):
                    for k, a in enumerate(range(at[d], at[d + 1], row)):
                        part = ids[a:min(a + row, at[d + 1])]
                        held.append((names[chunk.first + d], k, int(a - at[d]), part))
                        held_ids += len(part)
                        if held_ids >= BLOCK_IDS:
                            yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATRIX)


def write_matrix(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write ``packed_rows`` as Parquet to a path that all executors share, and return it as read back."""
    packed_rows(docs, **options).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def crc32_of(used: DataFrame) -> DataFrame:
    """Add ids_crc32 of the used part of each row (built-in function on the stored bytes)."""
    return used.withColumn("ids_crc32", F.crc32(F.expr("substring(ids, 1, 2 * n_tokens)")))


def packed_digest(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the matrix and describe every stored row.

    ``position_resets`` are the places in the row where positions start again, ``reset_to``
    the position there. An empty table gives no rows.
    """
    path = path or scratch_path(docs.sparkSession, "token-matrix")
    return crc32_of(write_matrix(docs, path, **options)).select(
        "sequence_id", "n_tokens", F.size("doc_ids").alias("n_segments"), "ids_crc32", "cu_seqlens", "doc_ids", "pieces",
        F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("position_resets"), F.col("starts").alias("reset_to"))


def unpack(ids: bytes, cu_seqlens: list[int]) -> list[list[int]]:
    """Segments of one stored row."""
    flat = np.frombuffer(ids, dtype="<u2")
    return [flat[a:b].tolist() for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:])]
