import math
import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import lattice_lm as lm
from tapeloom.llm import spaced_seeds as ss
from tapeloom.llm import zstd_quality as zq
from tapeloom.llm.words import chunks, words
from tests.llm.common import ODD, SMALL, clashing, documents, small_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(FOLD))


def test_words_equal_plain_matching():
    texts = ODD + ["Äb c" * 10, "tail"] + [r["text"] for r in small_documents()[:60]]
    codes = {}
    for limit in (1, 50, 1 << 20):
        for c in chunks(pa.array(texts, pa.string()), limit):
            ws = words(c)
            for d in range(len(ws.at) - 1):
                got = [bytes(c.buf[a:b]).decode().translate(FOLD) for a, b in
                       zip(ws.start[ws.at[d]:ws.at[d + 1]], ws.end[ws.at[d]:ws.at[d + 1]])]
                assert got == tokens(texts[c.first + d])
                for w, k in zip(got, ws.code[ws.at[d]:ws.at[d + 1]].tolist()):
                    assert codes.setdefault(w, k) == k
    assert len(set(codes.values())) == len(codes)


def marginal(word, log_p):
    """Sum over all segmentations, by plain recursion over prefixes."""
    word = b" " + word.encode()
    alpha = [0.0] + [None] * len(word)
    for j in range(1, len(word) + 1):
        xs = [alpha[i] + log_p[word[i:j]] for i in range(j) if alpha[i] is not None and word[i:j] in log_p]
        top = max(xs)
        alpha[j] = top + math.log(sum(math.exp(x - top) for x in xs))
    return alpha[-1]


def test_expected_counts_equal_enumeration():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b" ab", b"ba"]
    log_p = np.log(np.array([.1, .2, .2, .1, .2, .1, .1]))
    lattice = lm.Lattice(pieces, log_p)
    flat, start, size = np.frombuffer(b"abba", dtype=np.uint8), np.array([0, 2, 1]), np.array([2, 2, 3])
    got = lattice.expected_counts(flat, start, size, np.array([2.0, 1.0, 3.0]))
    want = np.zeros(len(pieces))
    for word, n in ((b" ab", 2), (b" ba", 1), (b" bba", 3)):
        ways = []
        for k in range(len(word)):
            for cut in combinations(range(1, len(word)), k):
                parts = [word[a:b] for a, b in zip((0, *cut), (*cut, len(word)))]
                if all(p in pieces for p in parts):
                    ways.append((math.exp(sum(log_p[pieces.index(p)] for p in parts)), parts))
        total = sum(w for w, _ in ways)
        for w, parts in ways:
            for p in parts:
                want[pieces.index(p)] += n * w / total
    assert np.allclose(got, want)


def test_expected_counts_of_long_words(monkeypatch):
    pieces = [b" ", b"a", b"b", b"ab", b" a", b" ab", b"abba", b"bbbbb"]
    log_p = np.log(np.array([.1, .2, .2, .1, .1, .1, .1, .1]))
    rng = random.Random(3)
    raw = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (5, 95, 96, 97, 110, 300, 301, 3_000)]
    weight = [1.0, 2.0, 3.0, 1.0, 5.0, 2.0, 1.0, 4.0]
    want = np.zeros(len(pieces))
    for word, c in zip(raw, weight):
        word = b" " + word
        edges = [(i, i + len(p), k) for i in range(len(word)) for k, p in enumerate(pieces) if word.startswith(p, i)]
        alpha, beta = ([-math.inf] * (len(word) + 1) for _ in range(2))
        alpha[0] = beta[-1] = 0.0
        for i, j, k in edges:
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + log_p[k])
        for i, j, k in reversed(edges):
            beta[i] = np.logaddexp(beta[i], beta[j] + log_p[k])
        for i, j, k in edges:
            want[k] += c * math.exp(alpha[i] + log_p[k] + beta[j] - alpha[-1])
    size = np.array([len(w) for w in raw])
    # All bytes are explained: a count of pieces times their lengths.
    assert np.isclose(want @ [len(p) for p in pieces], np.dot(size + 1, weight))
    for most in (1, 700, 65_536):
        monkeypatch.setattr(lm, "LONG_BYTES", most, raising=False)
        got = lm.Lattice(pieces, log_p).expected_counts(
            np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(size) - size, size, np.array(weight))
        assert np.allclose(got, want)


@pytest.mark.parametrize("hot, bucket", [(50_000, 4_000_000), (20, 3_000), (1, 10)])
def test_scores_equal_plain_counting(spark, monkeypatch, hot, bucket):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", bucket)
    rows = [(r["doc_id"], r["text"]) for r in small_documents()[:80]] + [(1000 + i, t) for i, t in enumerate(ODD)]
    rows += [(3, "again the same id"), (3, "again the same id"), (None, "no id")]
    docs = clashing(documents(spark, [t for _, t in rows], [i for i, _ in rows]), "uid", "score", "n")
    train = [(i, t) for i, t in rows if i is not None and crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    got = lm.score(docs).collect()
    assert len(got) == len(rows)
    vocab = lm.vocabulary()
    counts = lm.PRIOR * vocab.prior
    lattice = lm.Lattice(vocab.pieces, np.log(vocab.prior))
    ws = sorted(c)
    raw = [w.encode() for w in ws]
    end = np.cumsum([len(w) for w in raw])
    counts = counts + lattice.expected_counts(np.frombuffer(b"".join(raw), dtype=np.uint8), end - [len(w) for w in raw],
                                              np.array([len(w) for w in raw]), np.array([c[w] for w in ws], dtype=float))
    all_ = counts.sum() + len(train) + 1
    log_p = dict(zip(vocab.pieces, np.log(counts / all_)))
    want = Counter()
    for i, t in rows:
        ts = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts) + math.log10((len(train) + 1) / (n + v + 1))
        model = sum(marginal(w, log_p) for w in ts if len(w) < 400) + math.log((len(train) + 1) / all_)
        want[i, i is None or crc32(str(i).encode()) % 7 == 2, len(ts) + 1, sum(c[w] > 0 for w in ts) + 1, n, round(base, 5),
             round(model / math.log(10), 4) if all(len(w) < 400 for w in ts) else None] += 1
    have = Counter()
    long_ = {i for i, t in rows if any(len(w) >= 400 for w in tokens(t))}
    for r in got:
        have[r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5),
             None if r["doc_id"] in long_ else round(r["score"], 4)] += 1
    assert have == want


def test_scores_of_empty_tables(spark):
    assert lm.score(documents(spark, []).limit(0)).count() == 0
    only_held = documents(spark, ["a b"], [next(i for i in range(99) if crc32(str(i).encode()) % 7 == 2)])
    r = lm.score(only_held).first()
    assert (r["n_known"], r["train_tokens"], r["n_tokens"]) == (0, 0, 3) and r["score"] < 0


def test_masks_see_every_window():
    for a, b in combinations(range(ss.WINDOW), 2):
        assert any(all(m[k] == "0" or p + k not in (a, b) for k in range(len(m)))
                   for m in ss.MASKS for p in range(ss.WINDOW - len(m) + 1))


def test_leaks_equal_plain_search(spark):
    ws = [f"w{i}" for i in range(60)]
    item = " ".join(ws[:40])
    changed = ws[:40]
    changed[3] = changed[9] = "other"
    far = [w if i % 4 else "x" for i, w in enumerate(ws[:40])]
    texts = [None, "", "clean text " * 30, "start " + item + " end", "A, " + ", ".join(changed).upper() + "!", " ".join(far),
             "intro " + " ".join(ws[10:23]) + " outro", " ".join(ws[10:22]), "Short item here.", "short item there"]
    bench = spark.createDataFrame([(7, item), (8, "short item here"), (9, None), (10, "a"), (7, item)], "item_id long, text string")
    docs = clashing(documents(spark, texts), "item_id", "covered_words")
    got = {(r["doc_id"], r["item_id"]) for r in ss.leaks(docs, bench).collect()}
    assert got == {(3, 7), (4, 7), (6, 7), (8, 8)}
    kept = ss.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 5, 7, 9}
    assert ss.leaks(docs, bench.limit(0)).count() == 0 and ss.clean(docs.limit(0), bench).count() == 0


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {tuple(r) for r in ss.leaks(docs, bench).collect()}
    monkeypatch.setattr(ss.blocks, "__defaults__", (3_000,))
    assert {tuple(r) for r in ss.leaks(docs, bench).collect()} == one and one


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in zq.classify(clashing(docs, "score", "quality"), labels).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.values())
    assert sum(r["predicted"] == q for r, q in held) / len(held) > 0.93


def test_classifier_takes_odd_rows(spark):
    docs = documents(spark, ODD + ["x"], [*range(len(ODD)), None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in zq.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)] + [(None, 0, 0), (2, 0, 1), (4, None, 0)], none.schema)
    assert all(r["score"] > 0.99 for r in zq.classify(docs, one).collect())
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], none.schema)
    assert zq.classify(docs, both).count() == len(ODD) + 1 and zq.classify(docs.limit(0), both).count() == 0


def test_classifier_learns_from_whole_texts(spark):
    rng = random.Random(6)
    vocab = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    names = [[f"{kind}{rng.randrange(10**6)}" for _ in range(60)] for kind in ("bad", "good")]
    texts = []
    for i in range(240):
        head = " ".join(rng.choice(vocab) for _ in range(1_500))
        assert len(head) > 8_192
        texts.append(head + " " + " ".join(rng.choice(names[i % 2]) for _ in range(500)))
    docs = documents(spark, texts).repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(240)], "doc_id long, quality int, toxic int")
    model = zq.fit(docs, labels)
    assert b"good" in model.good and b"bad" in model.bad
    # The curve's lengths are those of whole texts.
    assert model.mean[3] > math.log(10_000)
    held = [r for r in zq.classify(docs, labels).collect() if r["held_out"]]
    assert held and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in held)
