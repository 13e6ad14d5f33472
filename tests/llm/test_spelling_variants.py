"""Spelling variants against plain counting and all pairs of words."""

import random
import re
import zlib
from collections import Counter

from tapeloom.llm import spelling_variants as sv
from tests.llm.common import ODD, clashing, documents, small_documents

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, r))
    return sorted(out)


def run(docs):
    return sorted(map(tuple, sv.variants(docs).collect()))


def test_small_tables_match_all_pairs(spark):
    rows = [(d["doc_id"], d["text"]) for d in small_documents()[:60]]
    assert run(documents(spark, [t for _, t in rows], [i for i, _ in rows])) == brute(rows)


def test_odd_rows_ties_repeats_and_long_runs(spark):
    texts = ODD + ["Colour colour COLOUR color color color color color color colr colr colr", "colours " * 3 + "couleur " * 5,
                   "étude étudé étudé étudé étude étude ÉTUDE", "abcde abcde abcde abcdf abcdf abcdf bbcde bbcde bbcde",
                   ("y" * 60_000 + " ") * 3 + ("y" * 60_001 + " ") * 6, "tied1tiedA tiedA tiedA tiedB tiedB tiedB tiedC tiedC tiedC"]
    rows = list(enumerate(texts)) + [(3, texts[13]), (None, texts[14]), (None, None)]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    assert run(clashing(docs, "word", "n", "_key", "root", "a")) == brute(rows)


def test_many_words_of_one_chunk_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(sv, "PAIRS", 6)
    monkeypatch.setattr(sv, "HOT_ROWS", 10)
    rng = random.Random(4)
    words = {"shared" + "".join(rng.choice("ab") for _ in range(rng.randint(3, 7))) for _ in range(120)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(5, 7))) + "common" for _ in range(80)}
    rows = [(i, " ".join(f"{w} " * rng.randint(1, 12) for w in words)) for i in range(3)]
    want = brute(rows)
    assert run(documents(spark, [t for _, t in rows], [i for i, _ in rows])) == want
    assert sum(w[2] for w in want) > 400


def test_no_words_no_rows(spark):
    assert run(documents(spark, [])) == [] == run(documents(spark, [None, "", "1 2 3"]))
