"""Positive-unlabelled toxicity: the fit against plain loops, counts against plain counting, held-out accuracy."""

import math
import re
import zlib

import numpy as np
import pytest

from tapeloom.llm import toxicity_pu as tp
from tests.llm.common import ODD, clashing, documents

LABELS = "doc_id long, quality int, toxic int"


def learns(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def plain_fit(texts, positive, inputs, prior, steps):
    """The same steps one text and one word at a time."""
    w, m, v = [0.0] * inputs + [math.log(prior / (1 - prior))], [0.0] * (inputs + 1), [0.0] * (inputs + 1)
    n_p, n_u = sum(positive), len(positive) - sum(positive)
    turned = 0
    for k in range(1, steps + 1):
        z = [w[-1] + sum(w[j] for j in t) for t in texts]
        r_u = sum(math.log(1 + math.exp(s)) for s, y in zip(z, positive) if not y) / n_u
        r_p = prior * sum(math.log(1 + math.exp(s)) for s, y in zip(z, positive) if y) / n_p
        g = [tp.RIDGE * x for x in w[:-1]] + [0.0]
        turned += r_u < r_p
        for t, s, y in zip(texts, z, positive):
            p = 1 / (1 + math.exp(-s))
            if r_u >= r_p:
                d = -prior / n_p * (1 - p) - prior / n_p * p if y else p / n_u
            else:
                d = prior / n_p * p if y else -p / n_u
            for j in [*t, inputs]:
                g[j] += d
        for j in range(inputs + 1):
            m[j] = 0.9 * m[j] + 0.1 * g[j]
            v[j] = 0.999 * v[j] + 0.001 * g[j] ** 2
            w[j] -= tp.RATE * (m[j] / (1 - 0.9**k)) / (math.sqrt(v[j] / (1 - 0.999**k)) + 1e-8)
    return w, turned


def test_fit_matches_plain_steps(monkeypatch):
    monkeypatch.setattr(tp, "STEPS", 120)
    rng = np.random.default_rng(3)
    texts = [sorted(set(rng.integers(0, 12, rng.integers(0, 6)).tolist())) for _ in range(60)]
    positive = [0 in t or 1 in t for t in texts]
    row = np.repeat(np.arange(60), [len(t) for t in texts])
    place = np.array([j for t in texts for j in t])
    got = tp.non_negative_fit(row, place, np.array(positive), 12, 0.6)
    want, turned = plain_fit(texts, positive, 12, 0.6, 120)
    assert 0 < turned < 120
    assert np.allclose(got, want, rtol=1e-6, atol=1e-8)


def corpus(n):
    """Texts of common and rare words; every seventh also holds words of a toxic list, and is marked so."""
    rng = np.random.default_rng(11)
    texts, toxic = [], []
    for i in range(n):
        t = [f"common{k}" for k in rng.integers(0, 40, 30)] + [f"rare{i}x{k}" for k in range(5)]
        toxic.append(int(i % 7 == 0))
        if toxic[-1]:
            t += [("Nasty,", "VILE", "awful!", "rotten")[k] for k in rng.integers(0, 4, 3)]
        rng.shuffle(t)
        texts.append(" ".join(t))
    return texts, toxic


def test_counts_and_held_out_accuracy(spark):
    texts, toxic = corpus(700)
    docs = documents(spark, texts)
    # Half of the clean rows have no label.
    labels = spark.createDataFrame([(i, None, t) for i, t in enumerate(toxic) if t or i % 2], LABELS)
    taught = [i for i in range(700) if toxic[i] and learns(i)]
    bags = [set(re.findall("[a-z0-9]+", t.lower())) for t in texts]
    n = {}
    for i in taught:
        for w in bags[i]:
            n[w] = n.get(w, 0) + 1
    want = set()
    for w, k in n.items():
        p, q = k / len(taught), sum(w in b for b in bags) / 700
        if k >= tp.SUPPORT and (p - q) / math.sqrt(max(q * (1 - q), 1 / 700) / len(taught)) >= tp.TELLING:
            want.add(w)
    model = tp.fit(docs, labels)
    assert {"nasty", "vile", "awful", "rotten"} <= want and len(model.codes) == len(want)
    got = tp.classify(docs, labels).collect()
    assert len(got) == 700 and all(r["held_out"] == (not learns(r["doc_id"])) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    caught = sum(r["predicted"] for r in held if toxic[r["doc_id"]])
    assert not any(r["predicted"] for r in held if not toxic[r["doc_id"]])
    assert len(held) > 100 and caught >= 0.85 * sum(toxic[r["doc_id"]] for r in held)


def test_held_out_labels_teach_nothing(spark):
    texts, toxic = corpus(200)
    docs = documents(spark, texts)
    rows = [(i, 1, t) for i, t in enumerate(toxic)]
    turned = [(i, 0, t if learns(i) else 1 - t) for i, _, t in rows]
    a, b = (tp.fit(docs, spark.createDataFrame(r, LABELS)) for r in (rows, turned))
    assert np.array_equal(a.codes, b.codes) and np.array_equal(a.weights, b.weights) and a.constant == b.constant


def test_odd_rows_repeats_and_long_texts(spark):
    texts, toxic = corpus(140)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (3, 1, None), (5, 1, 1), (5, 1, 0)], LABELS)
    extra = ODD + ["word " * 600_000 + "vile nasty awful", texts[0], texts[0]]
    ids = list(range(140)) + list(range(1000, 1000 + len(ODD))) + [2000, 0, 0]
    docs = clashing(documents(spark, texts + extra, ids), "positive", "bag", "_x", "score", "held_out", "n")
    docs = docs.unionByName(docs.filter("doc_id = 7").withColumn("doc_id", docs["doc_id"] * None))
    got = {}
    for r in tp.classify(docs, labels).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == 140 + len(extra) + 1
    assert got[None][0]["held_out"] and got[None][0]["predicted"] == 1
    assert got[1000][0]["score"] == got[1001][0]["score"] == got[1002][0]["score"] < 0.5
    assert got[2000][0]["predicted"] == 1 and len(got[0]) == 3 and len({r["score"] for r in got[0]}) == 1


@pytest.mark.parametrize("toxic,low,high", [([], 0, 0.01), ([0, 0], 0, 0.01), ([1, 1], 0.99, 1)])
def test_without_both_classes(spark, toxic, low, high):
    docs = documents(spark, ["a b", None, "c"])
    got = tp.classify(docs, spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], LABELS)).collect()
    assert all(low <= r["score"] <= high for r in got) and len(got) == 3
    assert tp.classify(documents(spark, []), spark.createDataFrame([], LABELS)).count() == 0
