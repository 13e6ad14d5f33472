import random
import tempfile
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import bin_slack as bs
from tapeloom.llm import subwords as sw
from tapeloom.llm import token_matrix as tm
from tapeloom.llm import token_rollup as tr
from tapeloom.llm.words import chunks
from tests.llm.common import ODD, SMALL, clashing, documents, small_documents

STRANGE = ODD + ["A B.C, d's don't I'LL <|endoftext|> 12 3", "naïve İstanbul ΑΣ. é́ x y   日本語。", "w. w w, ww.. .w", "́a ́"]


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(sw.tokenizer_file(sw.TOKENIZER))
    t.encode_special_tokens = True
    return t


def ids_of(model, text):
    return model.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [1, 400, 1 << 20])
def test_ids_equal_the_tokenizers(model, monkeypatch, limit):
    monkeypatch.setattr(sw, "REMEMBERED", 300)
    monkeypatch.setattr(sw, "_SLOTS", 64)
    texts = STRANGE + [r["text"] for r in small_documents()[:60]]
    enc = sw.WordEncoder()
    for c in chunks(pa.array(texts, pa.string()), limit):
        ids, at = enc.encode(c)
        assert enc.counts(c).tolist() == np.diff(at).tolist()
        for d in range(len(at) - 1):
            assert ids[at[d]:at[d + 1]].tolist() == ids_of(model, texts[c.first + d])


def test_fullest_equals_all_subsets():
    rng = random.Random(5)
    for _ in range(200):
        counts = dict(Counter(rng.randrange(1, 15) for _ in range(rng.randrange(8))))
        room = rng.randrange(1, 40)
        got = bs.fullest(counts, room)
        assert all(n <= counts[x] for x, n in got.items())
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def check_places(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("numbered", [100_000, 7])
def test_pieces_fill_sequences_without_gaps(spark, model, monkeypatch, numbered):
    monkeypatch.setattr(bs.rank_in_length, "__defaults__", (numbered,))
    texts = STRANGE + [r["text"] for r in small_documents()]
    ids = [*range(len(texts) - 2), 3, None]
    rows = bs.pack(clashing(documents(spark, texts, ids), "rank", "length")).collect()
    bins = check_places(rows, bs.CAPACITY)
    want = Counter()
    for i, t in zip(ids, texts):
        flat = [*ids_of(model, t), 0]
        for k, a in enumerate(range(0, len(flat), bs.CAPACITY)):
            part = flat[a:a + bs.CAPACITY]
            want[i, k, a, len(part), crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert bins <= -(-sum(r["length"] for r in rows) // bs.CAPACITY) + 1
    assert bs.pack(documents(spark, []).limit(0)).count() == 0


def test_best_fit_equals_a_plain_scan():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([7, 16, 33])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(30))]
        got = tm.best_fit_decreasing(sizes, capacity)
        rooms: list[int] = []
        for x in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= x]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - x)
            else:
                rooms.append(capacity - x)
        assert sorted(k for b in got for k in b) == list(range(len(sizes)))
        assert sorted(capacity - sum(sizes[k] for k in b) for b in got) == sorted(rooms)


@pytest.mark.parametrize("row, block", [(2048, 1 << 22), (64, 500)])
def test_matrix_gives_the_ids_back(spark, model, monkeypatch, row, block):
    monkeypatch.setattr(tm, "BLOCK_IDS", block)
    texts = STRANGE + [r["text"] for r in small_documents()[:50]]
    docs = clashing(documents(spark, texts), "ids", "pieces").repartition(2)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/matrix"
    stored = tm.write_matrix(docs, path, row=row).collect()
    assert len({r["sequence_id"] for r in stored}) == len(stored)
    found = defaultdict(dict)
    for r in stored:
        assert len(r["ids"]) == 2 * row and r["cu_seqlens"][-1] == r["n_tokens"] <= row
        assert not any(r["ids"][2 * r["n_tokens"]:])
        for i, p, s, part in zip(r["doc_ids"], r["pieces"], r["starts"], tm.unpack(r["ids"], r["cu_seqlens"])):
            assert s == p * row
            found[i][p] = part
    for i, t in enumerate(texts):
        assert [x for p in sorted(found[i]) for x in found[i][p]] == [*ids_of(model, t), 0]
    digest = tm.packed_digest(docs, path, row=row).collect()
    by = {r["sequence_id"]: r for r in stored}
    for r in digest:
        assert r["ids_crc32"] == crc32(by[r["sequence_id"]]["ids"][:2 * r["n_tokens"]])
        assert r["position_resets"] == r["cu_seqlens"][:-1] and r["n_segments"] == len(r["doc_ids"])
    assert tm.packed_digest(docs.limit(0)).count() == 0


def store(spark):
    return tr.Rollup(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/rollup")


def totals(s):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in s.totals().collect()}


def test_batches_count_once(spark):
    def changes(*rows):
        return spark.createDataFrame(rows, tr.CHANGES)

    s = store(spark)
    assert totals(s) == {} and s.committed() == []
    load = changes((1, "insert", "a", "en", "v1", 10), (2, "insert", "a", "en", "v1", 5), (2, "insert", "a", "en", "v1", 7),
                   (3, "insert", None, None, "v1", 4), (None, "insert", "a", "en", "v1", 1), (None, "delete", "a", "en", "v1", 1))
    assert s.commit("b1", load) and not s.commit("b1", load)
    assert totals(s) == {("a", "en", "v1"): (3, 18), (None, None, "v1"): (1, 4)}
    # A batch whose commit row is missing counts for nothing and can be written again.
    changes((9, "insert", "a", "en", "v1", 99)).limit(1).write.parquet(f"{s.path}/state/b2")
    assert totals(s)["a", "en", "v1"] == (3, 18)
    assert s.commit("b2", changes((1, "revise", "b", "en", "v1", 12), (2, "delete", "", "", "v1", None), (2, "insert", "a", "en", "v1", 1),
                                  (8, "delete", "a", "en", "v1", 3), (1, "insert", "a", "en", "v2", None)))
    assert totals(s) == {("a", "en", "v1"): (1, 1), ("b", "en", "v1"): (1, 12), (None, None, "v1"): (1, 4), ("a", "en", "v2"): (1, 0)}
    assert s.commit("b3", changes((2, "insert", "c", "de", "v1", 3), (3, "delete", None, None, "v1", 0)).withColumn("seq", F.lit("x")))
    assert totals(s)["c", "de", "v1"] == (1, 3) and (None, None, "v1") not in totals(s)
    assert s.commit("b4", changes((1, "insert", "a", "en", "v1", 1)).limit(0)) and s.committed() == ["b1", "b2", "b3", "b4"]


def test_corpus_totals_equal_plain_counting(spark, model):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = small_documents()
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    enc = tr._rank_encoder("byte_bpe_50k.tiktoken")
    want = defaultdict(lambda: [0, 0])
    for r in rows:
        if first[r["text"]] == r["doc_id"]:
            for v, n in (("word_bpe_49k.json", len(ids_of(model, r["text"])) + 1), ("byte_bpe_50k.tiktoken", len(enc.encode_ordinary(r["text"])))):
                cell = want[r["source"], r["lang"], v]
                cell[0] += 1
                cell[1] += n
    s = store(spark)
    tr.corpus_totals(docs, s)
    assert totals(s) == {k: tuple(v) for k, v in want.items()}
    empty = store(spark)
    assert tr.corpus_totals(clashing(docs, "version", "action").limit(0), empty).count() == 0
