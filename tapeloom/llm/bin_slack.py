"""Best-fit packing by minimum bin slack.

Pieces of equal length are interchangeable, so a packing is planned on the number of
pieces of each length: at most ``capacity`` counts, however large the corpus. Per bin,
the longest piece left is fixed and a bitset subset-sum over the lengths left finds the
fullest combination beside it. The combination is then used as often as the counts
allow (it stays the fullest one while its lengths last), so the plan has a few thousand
patterns at most. Spark numbers the pieces of each length and looks their places up.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.subwords import TOKENIZER, WordEncoder
from tapeloom.llm.words import SMALL_CHUNK, chunks
from tapeloom.session import cut_lineage

CAPACITY = 2048
# Pieces of one length that one task numbers, on average.
NUMBERED = 100_000


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of whole texts.

    A text becomes its ids and ``end_id``; only longer ones are cut, every ``capacity``
    ids. A null or empty text is one piece of one id; a null doc_id stays null; repeated
    rows are documents of their own; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder(tokenizer)  # of this task alone: a reused worker would go on holding it
        for batch in batches:
            for chunk in chunks(batch.column(1), SMALL_CHUNK):
                ids, at = enc.with_end(chunk, end_id)
                raw = ids.astype("<u4").tobytes()
                rows, pieces, starts, sizes, sums = [], [], [], [], []
                for d in range(len(at) - 1):
                    for k, a in enumerate(range(at[d], at[d + 1], capacity)):
                        b = min(a + capacity, at[d + 1])
                        rows.append(chunk.first + d)
                        pieces.append(k)
                        starts.append(a - at[d])
                        sizes.append(b - a)
                        sums.append(crc32(raw[4 * a:4 * b]))
                yield pa.record_batch([
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                ], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Plan(NamedTuple):
    """Rows by (length, from): ranks ``from`` on of a length go to ``times`` bins from ``bin`` on, at ``offset``."""

    length: np.ndarray
    begin: np.ndarray
    times: np.ndarray
    bin: np.ndarray
    offset: np.ndarray


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths (with repeats) whose sum is the greatest that ``room`` allows."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length], room // length)
        k = 1
        while left:
            k = min(k, left)
            more = reach | (reach << (k * length)) & mask
            if more != reach:
                steps.append((length, k, reach))
                reach = more
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + k
            at -= k * length
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Minimum bin slack over the counts of each length, all 1 to ``capacity``."""
    left = {int(x): int(n) for x, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest({x: n for x, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        offset = 0
        for x, n in sorted(chosen.items(), reverse=True):
            rows.append((x, used[x], times, bins, offset))
            offset += n * x
            used[x] += n * times
            left[x] -= n * times
            if not left[x]:
                del left[x]
        bins += times
    return Plan(*(np.array(c, dtype=np.int64) for c in zip(*sorted(rows)))) if rows else Plan(*[np.zeros(0, np.int64)] * 5)


def rank_in_length(pieces: DataFrame, numbered: int = NUMBERED) -> DataFrame:
    """Add ``rank``, the 0-based number of a piece among those of its length.

    Lengths are salted by the document, numbered per (length, salt) and shifted by the
    sizes of the salts before, so a length with a third of all pieces is many tasks' work.
    """
    salts = max(1, -(-pieces.count() // numbered))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (salted.withColumn("_rn", F.row_number().over(inside)).join(shift, ["length", "_salt"])
            .withColumn("rank", F.col("_shift") + F.col("_rn") - 1).drop("_salt", "_rn", "_shift"))


def place(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Add sequence_id and offset to ranked pieces. The plan's size is bounded by the capacity alone."""
    held = ranked.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        shift = np.int64(1 << 42)
        key = p.length * shift + p.begin
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = np.searchsorted(key, length * shift + rank, side="right") - 1
            i = rank - p.begin[row]
            seq = p.bin[row] + i % p.times[row]
            off = p.offset[row] + i // p.times[row] * length
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*keep, pa.array(seq), pa.array(off)], names=[
                "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = 0) -> DataFrame:
    """Every piece of ``docs`` with its sequence and place; an empty table gives no rows."""
    pieces = cut_lineage(token_pieces(docs, capacity, tokenizer, end_id))
    # One row per length: at most `capacity` of them.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return place(rank_in_length(pieces), plan_bins(counts, capacity))
