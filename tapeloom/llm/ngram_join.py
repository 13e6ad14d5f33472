"""N-gram Jaccard join with prefix filters under several global orders.

Sets are the distinct word n-grams of a text. Under any global order of n-grams, two sets
that reach the threshold share one among the first n - ceil(t * n) + 1 of each. All orders
here put n-grams of one set only first (they can't be shared), so near-unique texts drop
out at once; the orders differ in how they rank the others. A candidate pair must share a
prefix entry under every order, fit in size, and pass a parity-bitmap bound, before its
n-grams are compared.

Copies of a set are one node, named by a 64-bit hash of the set, wherever and however often
its rows occur. Links are found in two rounds: every text against the most
shared text of each of its lists, then, exactly, all pairs of the lists whose texts are not
connected yet. So a large group of copies costs one comparison per text, and no link
between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.components import components
from tapeloom.llm.words import SMALL_CHUNK, chunks, combine, mix, ragged, row_of, words
from tapeloom.session import cut_lineage

# N-grams that a bucket stands for on average, and that a task holds before it passes them on.
BUCKET_GRAMS, FLUSH_GRAMS = 3_000_000, 640_000
# A bucket's n-grams are compared in 2 ** SLICE_BITS parts, by their first bits, so that only one part is sorted at a time.
SLICE_BITS = 4
# Ids of copies or of dropped documents that are broadcast at most (about 32 MB).
SPARE_IDS = 4_000_000
# An n-gram in at least this share of all texts is hot: it is ranked last and never gathered.
HOT_SHARE = 1 / 256
_HOT_COUNT = np.int32(2**31 - 1)
_SEEDS = (np.uint64(0), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
BITS = 512


def gram_sets(chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a chunk's rows, sorted within a row, and where each row's begin.

    A row of fewer words has its whole sequence as one n-gram; a row without words has none.
    """
    ws = words(chunk)
    count = np.diff(ws.at)
    row = row_of(ws.at)
    size = len(ws.code) - n + 1
    codes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if size > 0:
        first = np.flatnonzero(row[:size] == row[n - 1:])
        codes.append(combine([ws.code[first + k] for k in range(n)]))
        rows.append(row[first])
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            at = ws.at[short]
            codes.append(combine([ws.code[at + j] for j in range(k)]))
            rows.append(short)
    code, row = np.concatenate(codes), np.concatenate(rows)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[new], row[new]
    return code, np.searchsorted(row, np.arange(len(count) + 1))


def _signatures(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free 64-bit sums of each row's set."""
    out = []
    for x in (code, mix(code ^ _SEEDS[1])):
        run = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x, out=run[1:])
        out.append((run[at[1:]] - run[at[:-1]]).view(np.int64))
    return np.diff(at), *out


def _nodes(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of each row's set and the node that stands for all equal sets."""
    size, s1, s2 = _signatures(code, at)
    return size, mix(s1.view(np.uint64) ^ mix(s2.view(np.uint64) + size.astype(np.uint64))).view(np.int64)


def _bitmaps(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity bitmaps: bit h of a row is the parity of its n-grams that hash to h."""
    rows = len(at) - 1
    slot = np.repeat(np.arange(rows), np.diff(at)) * BITS + (mix(code ^ _SEEDS[2]) % np.uint64(BITS)).astype(np.int64)
    slot, times = np.unique(slot, return_counts=True)
    bits = np.zeros(rows * BITS, dtype=bool)
    bits[slot[times % 2 == 1]] = True
    return np.packbits(bits.reshape(rows, BITS), axis=1, bitorder="little").view("<i8")


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, node) of every row, and (code, times) of n-grams frequent within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "node", "code", "times"]
        held, texts = [], 0

        def frequent() -> pa.RecordBatch:
            code, times = np.unique(np.concatenate(held), return_counts=True)
            own = times >= max(8, texts * HOT_SHARE / 2)
            none = pa.nulls(int(own.sum()), pa.int64())
            return pa.record_batch([none, none, none, pa.array(code[own].view(np.int64)), pa.array(times[own])], names=names)

        for batch in batches:
            for chunk in chunks(batch.column(1), SMALL_CHUNK):
                code, at = gram_sets(chunk, n)
                size, node = _nodes(code, at)
                held.append(code)
                texts += len(size)
                none = pa.nulls(len(size), pa.int64())
                yield pa.record_batch([batch.column(0).slice(chunk.first, len(size)), pa.array(size), pa.array(node),
                                       none, none], names=names)
                if sum(map(len, held)) >= FLUSH_GRAMS:
                    yield frequent()
                    held.clear()
                    texts = 0
        if held:
            yield frequent()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n long, node long, code long, times long")


_PART = "bucket int, kind int, ids binary, runs binary, codes binary, counts binary"
_NAMES = ["bucket", "kind", "ids", "runs", "codes", "counts"]


def _parts(kind: int, bucket: np.ndarray, buckets: int, ids: np.ndarray, codes: np.ndarray, counts: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket with its entries; an id that several running entries have is stored once, with their number."""
    order = np.argsort(bucket, kind="stable")
    bucket, ids, codes = bucket[order], ids[order], codes[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(ids))).astype(np.int32)
    heads, run_edges = ids[first], np.searchsorted(first, edges)
    used = np.flatnonzero(np.diff(edges)).tolist()

    def cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.array([values[at[b]:at[b + 1]].tobytes() for b in used], pa.binary())

    last = pa.nulls(len(used), pa.binary()) if counts is None else cut(counts[order], edges)
    return pa.record_batch([pa.array(used, pa.int32()), pa.array([kind] * len(used), pa.int32()), cut(heads, run_edges),
                            cut(runs, run_edges), cut(codes, edges), last], names=_NAMES)


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _flat(table: pa.Table, column: str, dtype, kind: int | None = None) -> np.ndarray:
    """The values of all rows, or of those of one kind, without a copy of the rows."""
    views = [np.frombuffer(x.as_buffer(), dtype=dtype) for x, k in zip(table[column], table["kind"].to_pylist()) if kind is None or k == kind]
    return np.concatenate(views) if views else np.zeros(0, dtype)


def _ids(table: pa.Table, kind: int | None = None) -> np.ndarray:
    return np.repeat(_flat(table, "ids", np.int64, kind), _flat(table, "runs", np.int32, kind))


def gram_parts(docs: DataFrame, n: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """N-grams by bucket of the n-gram (kind 0); hot ones (1) and sizes with bitmaps (2) by bucket of the node.

    Equal sets that a task holds at once are sent once; others meet under the same node.
    """
    held_hot = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = held_hot.value
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            code = np.concatenate([h[0] for h in held])
            size = np.concatenate([h[1] for h in held])
            at = np.concatenate([[0], np.cumsum(size)])
            own = np.sort(np.unique(_nodes(code, at)[1], return_index=True)[1])
            code = code[ragged(at[own], size[own])]
            size = size[own]
            at = np.concatenate([[0], np.cumsum(size)])
            ids = _nodes(code, at)[1]
            yield _parts(2, _bucket(ids, buckets), buckets, ids, _bitmaps(code, at), size.astype(np.int64))
            entry = np.repeat(ids, size)
            is_hot = np.isin(code, hot)
            yield _parts(1, _bucket(entry[is_hot], buckets), buckets, entry[is_hot], code[is_hot])
            yield _parts(0, _bucket(code[~is_hot], buckets), buckets, entry[~is_hot], code[~is_hot])
            held.clear()

        for batch in batches:
            for chunk in chunks(batch.column(1), SMALL_CHUNK):
                code, at = gram_sets(chunk, n)
                ids = batch.column(0).slice(chunk.first, len(at) - 1)
                size = np.diff(at)
                own = (size > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
                held.append((code[ragged(at[:-1][own], size[own])], size[own]))
                if sum(len(h[0]) for h in held) >= FLUSH_GRAMS:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PART)


def _times(code: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal codes."""
    new = np.ones(len(code), dtype=bool)
    new[1:] = code[1:] != code[:-1]
    return np.diff(np.append(np.flatnonzero(new), len(code)))


def _distinct(ids: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of id and code once, by id and code; rows of one set in several tasks send theirs again."""
    order = np.lexsort((code, ids))
    ids, code = ids[order], code[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (code[1:] != code[:-1])
    return ids[new], code[new]


def _shared(ids: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of codes that two ids or more have, by code and id, with how many have them."""
    order = np.argsort(code, kind="stable")
    times = _times(code[order])
    many = np.repeat(times > 1, times)
    ids, code = _distinct(ids[order[many]], code[order[many]])
    order = np.argsort(code, kind="stable")
    ids, code = ids[order], code[order]
    times = _times(code)
    count = np.repeat(times, times)
    many = count > 1
    return ids[many], code[many], count[many].astype(np.int32)


def shared_grams(parts: DataFrame, buckets: int) -> DataFrame:
    """Entries of n-grams that two sets or more have, with how many have them, by bucket of the node; others pass through."""

    def run(table: pa.Table) -> pa.Table:
        ids, code = _ids(table, 0), _flat(table, "codes", np.uint64, 0)
        part = (code >> np.uint64(64 - SLICE_BITS)).astype(np.uint8)
        found = [_shared(ids[at], code[at]) for at in (np.flatnonzero(part == k) for k in range(1 << SLICE_BITS))]
        del ids, code, part
        ids, code, count = (np.concatenate(x) for x in zip(*found))
        del found
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        out = _parts(1, _bucket(ids, buckets), buckets, ids, code[order], count[order])
        return pa.concat_tables([table.filter(pc.greater(table["kind"], 0)), pa.Table.from_batches([out]).cast(table.schema)])

    return parts.groupBy("bucket").applyInArrow(run, _PART)


_NODE = ("doc_id long, n int, own int, bits array<long>, grams array<long>, pre1 array<long>, pre2 array<long>, "
         "pre3 array<long>")


def prefixes(parts: DataFrame, percent: int) -> DataFrame:
    """Nodes whose prefixes hold a shared n-gram.

    Each comes with its bitmap, its shared n-grams and its prefix entries under each order.
    """

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pc.equal(table["kind"], 2))
        node, size = _ids(own), _flat(own, "counts", np.int64)
        bits = _flat(own, "codes", np.int64).reshape(-1, BITS // 64)
        order = np.argsort(node, kind="stable")
        node, first = np.unique(node[order], return_index=True)
        size, bits = size[order][first], bits[order][first]
        entries = table.filter(pc.equal(table["kind"], 1))
        counted, hot = entries.filter(pc.is_valid(entries["counts"])), entries.filter(pc.is_null(entries["counts"]))
        more = _distinct(_ids(hot), _flat(hot, "codes", np.uint64))
        ids = np.concatenate([_ids(counted), more[0]])
        code = np.concatenate([_flat(counted, "codes", np.uint64), more[1]])
        count = _flat(counted, "counts", np.int32)
        count = np.concatenate([count, np.full(len(ids) - len(count), _HOT_COUNT)])
        row = np.searchsorted(node, ids)
        have = np.bincount(row, minlength=len(node))
        own = np.maximum(size - have, 0)
        room = size - -(-percent * size // 100) + 1 - own
        play = np.flatnonzero((room > 0) & (have > 0))
        keep = np.isin(row, play)
        row, code, count = row[keep], code[keep], count[keep]
        classes = (count, np.floor(np.log2(count)).astype(np.int32) // 2, np.minimum(count, 64) // 64)
        pre = []
        for seed, rank in zip(_SEEDS, classes):
            order = np.lexsort((mix(code ^ seed), rank, row))
            r, c = row[order], code[order]
            at = np.arange(len(r)) - np.searchsorted(r, r)
            some = at < room[r]
            pre.append(_lists(c[some].view(np.int64), r[some], play))
        order = np.lexsort((code, row))
        return pa.table([pa.array(node[play]), pa.array(size[play].astype(np.int32)), pa.array(own[play].astype(np.int32)),
                         _lists(bits[play].reshape(-1), np.repeat(play, BITS // 64), play),
                         _lists(code[order].view(np.int64), row[order], play), *pre],
                        names=["doc_id", "n", "own", "bits", "grams", "pre1", "pre2", "pre3"])

    return parts.groupBy("bucket").applyInArrow(run, _NODE)


def _lists(values: np.ndarray, row: np.ndarray, rows: np.ndarray) -> pa.Array:
    """A list for each of ``rows`` (ascending) of the values whose row it is."""
    off = np.searchsorted(row, np.concatenate([rows, [np.iinfo(np.int64).max]]))
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


def _fits(percent: int) -> Column:
    """Size and bitmap bounds of a pair (columns with suffix a and b)."""
    n, m = F.col("n_a").cast("long"), F.col("n_b").cast("long")
    need = F.ceil((n + m) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))
    differ = sum((F.bit_count(F.get("bits_a", k).bitwiseXOR(F.get("bits_b", k))) for k in range(BITS // 64)), F.lit(0))
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m))
            & (F.least(n - F.col("own_a"), m - F.col("own_b")) >= need) & (differ <= n + m - 2 * need))


def _suffixed(df: DataFrame, s: str, *shared: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in shared else f"{c}_{s}") for c in df.columns])


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) that share a prefix entry under every order and whose sets reach the threshold."""
    slim = nodes.select("doc_id", "pre2", "pre3")
    for side in "ab":
        pairs = pairs.join(_suffixed(slim, side).withColumnRenamed(f"doc_id_{side}", side), side)
    pairs = pairs.filter(F.arrays_overlap("pre2_a", "pre2_b") & F.arrays_overlap("pre3_a", "pre3_b")).select("a", "b")
    full = nodes.select("doc_id", "n", "grams")
    for side in "ab":
        pairs = pairs.join(_suffixed(full, side).withColumnRenamed(f"doc_id_{side}", side), side)
    both = F.size(F.array_intersect("grams_a", "grams_b")).cast("long")
    return pairs.filter(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def links(nodes: DataFrame, percent: int) -> DataFrame:
    """Verified links that connect every two texts which links connect."""
    lists = nodes.select("doc_id", "n", "own", "bits", F.explode("pre1").alias("gram"))
    centre = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("_many"), F.min(F.struct("own", "n", "doc_id")).alias("_c")).filter(
        "_many > 1").select("gram", F.col("_c.doc_id").alias("b"))
    lists = cut_lineage(lists.join(centre, "gram"))
    nodes = cut_lineage(nodes.join(lists.select("doc_id").distinct(), "doc_id", "left_semi"))
    near = lists.filter("doc_id != b").select(F.col("doc_id").alias("a"), "n", "own", "bits", "b").dropDuplicates(["a", "b"])
    near = near.select("a", "b", *[F.col(c).alias(f"{c}_a") for c in ("n", "own", "bits")]).join(
        _suffixed(nodes.select("doc_id", "n", "own", "bits"), "b").withColumnRenamed("doc_id_b", "b"), "b")
    first = cut_lineage(verified(near.filter(_fits(percent)).select("a", "b"), nodes, percent))

    known = components(first)
    at = lists.drop("b").join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "comp", F.coalesce("component", "doc_id")).drop("component")
    # Lists that lie in one component have nothing left to find.
    split = at.groupBy("gram").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi").select("gram")
    at = cut_lineage(at.join(split, "gram"))
    a, b = _suffixed(at, "a", "gram"), _suffixed(at, "b", "gram")
    rest = a.join(b, "gram").filter((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("comp_a") != F.col("comp_b")) & _fits(percent))
    rest = rest.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
    return first.unionByName(verified(rest, nodes, percent))


def _sent(ids: DataFrame) -> DataFrame:
    """Stored ids, sent to the tasks if they are few by count, so that the texts they meet aren't shuffled."""
    return F.broadcast(ids) if ids.count() <= SPARE_IDS else ids


def without_copies(docs: DataFrame, member: DataFrame) -> DataFrame:
    """The rows of ``docs`` but for documents whose every set (doc_id, node in ``member``) has a smaller document.

    One document speaks for a set, so copies don't send its n-grams again. A list of ids that is
    short by count is sent to the tasks; a longer one meets the rows by a shuffle, which moves
    less than the n-grams of so many copies would.
    """
    speaks = member.groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    spare = cut_lineage(member.select("doc_id").distinct().join(speaks, "doc_id", "left_anti").select(F.col("doc_id").alias("_id")))
    return docs.join(_sent(spare), docs["doc_id"].cast("long") == F.col("_id"), "left_anti")


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is the least id reachable by links.

    Sets of n-word shingles link when 100 * intersection >= percent * union. A text without
    words has an empty set and links with nothing; rows with one id are one document; a row
    without an id links with nothing and has no component. Other columns are not read.
    """
    sig = cut_lineage(signatures(docs, n))
    rows = sig.filter("n is not null").select("doc_id", "n", "node")
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("grams")).first()
    buckets = 1 + (size["grams"] or 0) // BUCKET_GRAMS
    # A hot n-gram is in a share of all texts, so there are at most (n-grams a text) / HOT_SHARE.
    frequent = sig.filter("code is not null").groupBy("code").agg(F.sum("times").alias("t")).filter(
        F.col("t") >= max(64, size["rows"] * HOT_SHARE)).select("code").collect()
    hot = np.array([r["code"] for r in frequent], dtype=np.int64).view(np.uint64)

    member = rows.filter("n > 0 and doc_id is not null").select("doc_id", "node").distinct()
    shared = shared_grams(gram_parts(without_copies(docs, member), n, buckets, hot), buckets)
    nodes = cut_lineage(prefixes(shared, percent))
    # A document with several sets under its id ties their nodes together.
    tied = member.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("_hi")).filter("b < _hi")
    ties = member.join(tied, "doc_id").select(F.col("node").alias("a"), "b")
    found = components(links(nodes, percent).unionByName(ties))
    least = member.groupBy("node").agg(F.min("doc_id").alias("_d")).join(found, "node", "left").select(
        "node", "_d", F.coalesce("component", "node").alias("_k"))
    least = least.join(least.groupBy("_k").agg(F.min("_d").alias("_c")), "_k").select("node", "_c")
    of = member.join(least, "node").groupBy("doc_id").agg(F.min("_c").alias("_c"))
    return rows.join(of, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_c", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the least of its group, all columns as they were; rows without an id stay.

    Of rows with the same id and text one stays.
    """
    groups = similar_groups(docs, n, percent).filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("component_id").alias("_least"))
    groups = cut_lineage(groups.filter("_id != _least or _rows > 1"))
    same = docs["doc_id"].cast("long") == F.col("_id")
    again = docs.join(_sent(groups.filter("_id = _least").select("_id")), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(_sent(groups.select("_id")), same, "left_anti").union(again)
