import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import induced as sa
from tapeloom.llm import repeated_bytes as rb
from tests.llm.common import ODD, clashing, documents, small_documents


def shards_of(rng):
    out = []
    for _ in range(rng.randrange(1, 12)):
        n, letters = rng.randrange(60), rng.choice([1, 2, 3, 20])
        s = [rng.randrange(1, letters + 1) for _ in range(n)]
        out.append(((s[:max(1, n // 4)] * 5)[:n] if n and rng.random() < 0.4 else s) + [0])
    return out


@pytest.mark.parametrize("seed", range(40))
def test_suffix_arrays_equal_plain_sorting(seed):
    shards = shards_of(random.Random(seed))
    text, off = np.array(sum(shards, [])), np.cumsum([0] + [len(s) for s in shards])
    got = sa.suffix_arrays(text, off, np.full(len(shards), 25))
    plcp, phi = sa.common_prefixes(text, off, got)
    for s, a in zip(shards, off):
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert (got[a:a + len(s)] - a).tolist() == order
        for x, y in zip(order[1:], order):
            k = next(k for k in range(len(s)) if s[x + k] != s[y + k])
            assert (plcp[a + x], phi[a + x]) == (k, a + y)


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        left = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("group, large", [(64, 4096), (2, 9), (0, 0)])
def test_removed_bytes_equal_plain_search(spark, monkeypatch, group, large):
    monkeypatch.setattr(rb, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(rb, "FLUSH", 9_000)
    rng = random.Random(group)
    words = ["".join(rng.choice("abcdeé ") for _ in range(7)) for _ in range(500)]
    common = " ".join(rng.sample(words, 45))
    base = " ".join(rng.sample(words, 120))
    texts = list(ODD) + [r["text"] for r in small_documents()[:40]]
    texts += [" ".join(rng.sample(words, rng.randrange(40))) + common + " ".join(rng.sample(words, 30)) for _ in range(12)]
    texts += [base[:k] + "X" + base[k:] for k in rng.sample(range(len(base)), 8)] + [base, base, "ab" * 300, "q" * 450, base[:199], common[:200]]
    ids = [*range(len(texts) - 2), None, None]
    docs = clashing(documents(spark, texts, ids), "k1", "runs", "f").repartition(3)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                 for r in rb.dedupe(docs, group=group, large=large).collect())
    want = sorted((-1 if i is None else i, *w) for i, w in zip(ids, plain(texts, 200)))
    assert got == want


def test_rows_and_their_copies_repeat_one_another(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    docs = documents(spark, [text, text, "short"], [1, 1, 2])
    got = sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in rb.dedupe(docs, keep_text=True).collect())
    assert got == [(1, 300, b""), (1, 300, b""), (2, 0, b"short")]
    assert rb.dedupe(docs.limit(0)).count() == 0


def test_no_suffix_comes_before_the_first_of_a_shard():
    """op5: the steps of the induced sort look up once whether a place is induced; -1 stands for no suffix."""
    kind, first = np.array([True, False, True, True, False]), np.array([0, 3])
    assert sa._preceded(kind, first).tolist() == [False, True, False, False, True, False]
    assert not sa._preceded(kind, first)[-1]
