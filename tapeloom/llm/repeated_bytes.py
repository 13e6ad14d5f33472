"""Removal of long repeated byte strings, by suffix arrays over sharded contexts.

A string of ``LENGTH`` bytes repeats only where its anchor does: the smallest hash of a
32-byte gram inside it, which the string alone decides. So every start of a string belongs
to one anchor, and equal strings meet in the shard of their anchor's hash, cut out with
the bytes around it. Anchors that occur once drop out. Shards are sorted by induced
sorting (``induced``), and permuted common prefixes of ``LENGTH`` or more mark the starts.

An anchor with more than ``GROUP`` different contexts would make one shard long; its strings
are compared by 64-bit codes instead. One with more than ``LARGE`` occurrences would make
one task's group large; the codes of its strings meet in hash buckets, where a task sends
each code once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.induced import common_prefixes, suffix_arrays
from tapeloom.llm.words import POWERS, VALUE, Chunk, chunks, mix, ragged

LENGTH, GRAM = 200, 32
# Different contexts of an anchor that a suffix array holds at most, and occurrences that one task's group does.
GROUP, LARGE = 64, 4_096
# Text a bucket of contexts stands for, symbols of a shard to aim at and of the shards sorted at once, and context bytes a task holds.
BUCKET_BYTES, SHARD, SORTED, FLUSH = 6 << 20, 4_096, 1_500_000, 4 << 20


def _codes(buf: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes."""
    n = len(buf) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = POWERS.get(len(buf) + 1)
    run = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(VALUE[buf] * up[:-1], out=run[1:])
    return mix((run[size:] - run[:-size]) * down[:n])


def anchors(chunk: Chunk, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, hash, first start in the row, starts) of the anchors that starts of ``length``-byte strings have."""
    code = _codes(chunk.buf, gram)
    width = length - gram + 1
    low = np.uint64(0xFFFFFFFF)
    least = (code & ~low) | np.arange(len(code), dtype=np.uint64)
    k = 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:]) if len(least) > k else least[:0]
        k *= 2
    if k < width:
        d = width - k
        least = np.minimum(least[:-d], least[d:]) if len(least) > d else least[:0]
    at = (least & low).astype(np.int64)
    size = np.diff(chunk.off) - length + 1
    first = np.flatnonzero(size > 0)
    place = ragged(chunk.off[:-1][first], size[first])
    row = np.repeat(first, size[first])
    a = at[place]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    return row[begin], code[a[begin]], place[begin] - chunk.off[row[begin]], np.diff(np.append(begin, len(place)))


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text): a key that tells apart different rows and none of a row's copies."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("k1"),
                       F.xxhash64(text, F.col("doc_id").isNull()).alias("k2"), F.col("doc_id"), text.alias("text"))


def anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """One row per anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                row, code, first, many = anchors(chunk, length)
                at = pa.array(chunk.first + row)
                yield pa.record_batch([pa.array(code.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at),
                                       pa.array(first.astype(np.int32)), pa.array(many.astype(np.int32))],
                                      names=["f", "k1", "k2", "lo", "many"])

    return rows.select("k1", "k2", "text").mapInArrow(run, "f long, k1 long, k2 long, lo int, many int")


_PART = "bucket int, kind int, f binary, k1 binary, k2 binary, lo binary, many binary, size binary, raw binary"
_PART_NAMES = ["bucket", "kind", "f", "k1", "k2", "lo", "many", "size", "raw"]
_RUN = "k1 long, k2 long, lo int, many int"


def _pack(kind: int, bucket: np.ndarray, buckets: int, columns: list[np.ndarray], raw: tuple | None = None) -> pa.RecordBatch:
    """One row per bucket of the columns' entries; ``raw`` is (bytes, start, size) of a slice for each entry."""
    order = np.argsort(bucket, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    used = np.flatnonzero(np.diff(at)).tolist()
    out = [pa.array(used, pa.int32()), pa.array([kind] * len(used), pa.int32())]
    for c in columns:
        c = c[order]
        out.append(pa.array([c[at[b]:at[b + 1]].tobytes() for b in used], pa.binary()))
    if raw is not None:
        flat, start, size = raw
        start, size = start[order], size[order]
        out.append(pa.array([size[at[b]:at[b + 1]].astype(np.int32).tobytes() for b in used], pa.binary()))
        out.append(pa.array([flat[ragged(start[at[b]:at[b + 1]], size[at[b]:at[b + 1]])].tobytes() for b in used], pa.binary()))
    while len(out) < len(_PART_NAMES):
        out.append(pa.nulls(len(used), pa.binary()))
    return pa.record_batch(out, names=_PART_NAMES)


def context_parts(rows: DataFrame, kept: DataFrame, length: int, buckets: int, large: int) -> DataFrame:
    """Contexts of anchors by bucket of their hash (kind 0); codes of the strings of frequent anchors by bucket (1).

    A code that a task holds several times is settled there (kind 2) and sent on once.
    """
    found = kept.groupBy("k1", "k2").agg(F.collect_set(F.struct("f", "lo", "many", "often")).alias("found"))
    joined = rows.join(found, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: list[tuple] = []
        starts: list[tuple] = []
        held = [0, 0]

        def cut() -> pa.RecordBatch:
            f, k1, k2, lo, many, size = (np.concatenate([c[i] for c in contexts]) for i in range(6))
            flat = np.concatenate([c[6] for c in contexts])
            contexts.clear()
            held[0] = 0
            bucket = (mix(f.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            return _pack(0, bucket, buckets, [f, k1, k2, lo, many], (flat, np.cumsum(size) - size, size))

        def settle() -> Iterator[pa.RecordBatch]:
            code, k1, k2, lo = (np.concatenate([c[i] for c in starts]) for i in range(4))
            starts.clear()
            held[1] = 0
            order = np.lexsort((lo, k2, k1, code))
            code, k1, k2, lo = code[order], k1[order], k2[order], lo[order]
            new = np.ones(len(code), dtype=bool)
            new[1:] = code[1:] != code[:-1]
            times = np.diff(np.append(np.flatnonzero(new), len(code)))
            twice = np.repeat(times > 1, times)
            yield _pack(2, (mix(k2[twice].view(np.uint64)) % np.uint64(buckets)).astype(np.int32), buckets, [code[twice], k1[twice], k2[twice], lo[twice]])
            bucket = (mix(code[new]) % np.uint64(buckets)).astype(np.int32)
            yield _pack(1, bucket, buckets, [code[new], k1[new], k2[new], lo[new], times.astype(np.int32)])

        for batch in batches:
            names = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            lists = names["found"]
            off = lists.offsets.to_numpy()
            item = lists.flatten()
            f, lo, many, often = (item.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            off = off - off[0]
            key1, key2 = (names[c].to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for chunk in chunks(names["text"]):
                rows_ = np.arange(chunk.first, chunk.first + len(chunk.off) - 1)
                size = off[rows_ + 1] - off[rows_]
                at = ragged(off[rows_], size)
                row = np.repeat(np.arange(len(rows_)), size)
                place = chunk.off[row] + lo[at]
                rare = often[at] <= large
                r, p, a = row[rare], place[rare], at[rare]
                width = many[a].astype(np.int64) + length - 1
                contexts.append((f[a], key1[rows_[r]], key2[rows_[r]], lo[a], many[a], width, chunk.buf[ragged(p, width)]))
                held[0] += int(width.sum())
                if held[0] >= FLUSH:
                    yield cut()
                if not rare.all():
                    r, p, a = row[~rare], place[~rare], at[~rare]
                    every = ragged(p, many[a].astype(np.int64))
                    r = np.repeat(r, many[a])
                    starts.append((_codes(chunk.buf, length)[every], key1[rows_[r]], key2[rows_[r]],
                                   (every - chunk.off[r]).astype(np.int32)))
                    held[1] += len(every)
                    if held[1] >= FLUSH // 4:
                        yield from settle()
        if contexts:
            yield cut()
        if starts:
            yield from settle()

    return joined.select("k1", "k2", "doc_id", "text", "found").mapInArrow(run, _PART)


def _flat(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), dtype=kind)


def _runs(k1: np.ndarray, k2: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """Starts as runs (k1, k2, first, how many); a start may come more than once."""
    order = np.lexsort((lo, k2, k1))
    k1, k2, lo = k1[order], k2[order], lo[order].astype(np.int64)
    new = np.ones(len(lo), dtype=bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (lo[1:] > lo[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(lo))[:len(begin)] - 1
    return [k1[begin], k2[begin], lo[begin].astype(np.int32), (lo[end] - lo[begin] + 1).astype(np.int32)]


def _sort(contexts: list[bytes], shard: list[int], length: int) -> list[np.ndarray]:
    """For each of distinct contexts, which of its starts have a string that another start in its shard has."""
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    flat = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    # Symbol 1 ends a context, 0 a shard.
    closes = np.ones(len(contexts), dtype=bool)
    closes[:-1] = np.diff(shard) != 0
    width = size + 1 + closes
    begin = np.cumsum(width) - width
    text = np.zeros(int(width.sum()), dtype=np.int32)
    text[ragged(begin, size)] = flat.astype(np.int32) + 2
    text[begin + size] = 1
    off = np.concatenate([[0], begin[closes] + width[closes]]).astype(np.int64)
    plcp, phi = common_prefixes(text, off, suffix_arrays(text, off, np.full(len(off) - 1, 258)))
    found = plcp >= length
    found[phi[np.flatnonzero(found)]] = True
    return [found[a:a + n] for a, n in zip(begin.tolist(), (size - length + 1).tolist())]


def _compare(contexts: list[bytes], many: list[int], length: int) -> list[np.ndarray]:
    """As ``_sort`` for the contexts of one anchor, by codes of their strings."""
    codes = [_codes(np.frombuffer(c, dtype=np.uint8), length) for c in contexts]
    size = [len(c) for c in codes]
    _, back = np.unique(np.concatenate(codes), return_inverse=True)
    found = np.bincount(back, weights=np.repeat(many, size))[back] > 1
    return np.split(found, np.cumsum(size)[:-1])


def sort_contexts(f: np.ndarray, raw: list[bytes], length: int, most: int = GROUP) -> list[np.ndarray]:
    """For each context, which of its starts have a string that another start has, by suffix arrays.

    Equal contexts of an anchor repeat one another and are sorted once, if the anchor has
    others. Distinct ones share a shard with those of the same anchor, and short groups with
    one another; groups of like size are sorted together.
    """
    first: dict[tuple[int, bytes], int] = {}
    of = np.array([first.setdefault((a, b), len(first)) for a, b in zip(f.tolist(), raw)], dtype=np.int64)
    many = np.bincount(of, minlength=len(first))
    group: dict[int, list[tuple[bytes, int]]] = {}
    for (a, b), k in first.items():
        group.setdefault(a, []).append((b, k))
    out = [np.zeros(0, bool)] * len(first)
    sorted_ = []
    for members in group.values():
        if len(members) == 1:
            b, k = members[0]
            out[k] = np.full(len(b) - length + 1, many[k] > 1)
        elif len(members) > most:
            for (_, k), m in zip(members, _compare([b for b, _ in members], [int(many[k]) for _, k in members], length)):
                out[k] = m
        else:
            sorted_.append(members)
    sorted_.sort(key=lambda members: -sum(len(b) + 1 for b, _ in members))
    batch: list[bytes] = []
    numbers: list[int] = []
    shard: list[int] = []
    held, used = 0, 0

    def flush() -> None:
        for k, m in zip(numbers, _sort(batch, shard, length) if batch else ()):
            out[k] = np.ones(len(m), dtype=bool) if many[k] > 1 else m
        for x in (batch, numbers, shard):
            x.clear()

    for members in sorted_:
        if held >= SORTED:
            flush()
            held = used = 0
        if used >= SHARD:
            used = 0
        for b, k in members:
            shard.append(shard[-1] + (not used) if shard else 0)
            batch.append(b)
            numbers.append(k)
            used += len(b) + 1
            held += len(b) + 1
    flush()
    return [out[k] for k in of.tolist()]


def repeated_starts(parts: DataFrame, length: int, group: int) -> DataFrame:
    """Runs of starts whose string starts elsewhere too."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        some = table.filter(pc.equal(table["kind"], 0))
        if some.num_rows:
            f, k1, k2 = (_flat(some, c, np.int64) for c in ("f", "k1", "k2"))
            lo, size = _flat(some, "lo", np.int32), _flat(some, "size", np.int32).astype(np.int64)
            raw = b"".join(some["raw"].to_pylist())
            end = np.cumsum(size).tolist()
            marks = sort_contexts(f, [raw[a:b] for a, b in zip([0, *end[:-1]], end)], length, group)
            many = np.array([len(m) for m in marks], dtype=np.int64)
            hit = np.concatenate(marks)
            at = np.repeat(lo.astype(np.int64), many) + ragged(np.zeros(len(many), np.int64), many)
            out.append(_runs(np.repeat(k1, many)[hit], np.repeat(k2, many)[hit], at[hit]))
        some = table.filter(pc.equal(table["kind"], 1))
        if some.num_rows:
            code, k1, k2 = (_flat(some, c, np.int64) for c in ("f", "k1", "k2"))
            lo, times = _flat(some, "lo", np.int32), _flat(some, "many", np.int32)
            _, back = np.unique(code, return_inverse=True)
            hit = np.bincount(back, weights=times)[back] > 1
            out.append(_runs(k1[hit], k2[hit], lo[hit]))
        some = table.filter(pc.equal(table["kind"], 2))
        if some.num_rows:
            out.append(_runs(_flat(some, "k1", np.int64), _flat(some, "k2", np.int64), _flat(some, "lo", np.int32)))
        columns = [np.concatenate([o[i] for o in out]) for i in range(4)]
        return pa.table([pa.array(c) for c in columns], names=["k1", "k2", "lo", "many"])

    return parts.groupBy("bucket").applyInArrow(run, _RUN)


def removed(rows: DataFrame, runs: DataFrame, length: int, keep_text: bool = False) -> DataFrame:
    """Every row with what is left of its bytes once those that repeated strings cover are gone."""
    of = runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "many")).alias("runs"))
    joined = rows.join(of, ["k1", "k2"], "left")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column(3).cast(pa.large_string())
            for i in range(batch.num_rows):
                text = texts[i].as_py().encode()
                spans = batch.column(4)[i].as_py()
                parts, at, gone, n = [], 0, 0, 0
                if spans:
                    end = 0
                    for s in sorted((s["lo"], s["many"]) for s in spans):
                        a, b = s[0], s[0] + s[1] + length - 1
                        if a > end or not n:
                            parts.append(text[at:a])
                            n += 1
                            gone += b - a
                        else:
                            gone += max(0, b - end)
                        end = max(end, b)
                        at = end
                parts.append(text[at:])
                left = b"".join(parts)
                out.append((len(text), gone, n, hashlib.sha256(left).hexdigest(), left))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            columns = columns or [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())]
            yield pa.record_batch([batch.column(2), *columns[:4 + keep_text]],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:5 + keep_text])

    return joined.select("k1", "k2", "doc_id", "text", "runs").mapInArrow(run, schema)


def dedupe(docs: DataFrame, length: int = LENGTH, group: int = GROUP, large: int = LARGE, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row (with ``keep_text`` also the bytes kept).

    A byte goes if a ``length``-byte string that starts anywhere else too covers it. A null
    text counts as empty; a row and its copy repeat one another; other columns are not read.
    """
    rows = keyed(docs)
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = 1 + total // BUCKET_BYTES
    found = anchor_rows(rows, length)
    often = found.groupBy("f").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    kept = found.join(often, "f").select("f", "k1", "k2", "lo", "many", F.least("often", F.lit(2**31 - 1)).cast("int").alias("often"))
    parts = context_parts(rows, kept, length, buckets, large)
    return removed(rows, repeated_starts(parts, length, group), length, keep_text)
