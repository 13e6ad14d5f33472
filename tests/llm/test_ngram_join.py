import random
import re

import pytest

from tapeloom.llm import ngram_join as nj
from tapeloom.llm.components import components
from tests.llm.common import ODD, clashing, documents, small_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    ws = WORD.findall((text or "").translate(FOLD))
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def grouped(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i)) for i, s in sets)


def near_copies(seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    out = []
    for k in range(40):
        ws = list(base)
        for _ in range(rng.randrange(7)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(ws[:rng.choice([120, 118, 110])]))
    return out + [" ".join(base)] * 5 + [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(20)]


@pytest.mark.parametrize("n, percent, hot", [(3, 90, 1 / 256), (5, 80, 1 / 256), (3, 60, 1 / 8)])
def test_groups_equal_all_pairs(spark, monkeypatch, n, percent, hot):
    monkeypatch.setattr(nj, "HOT_SHARE", hot)
    monkeypatch.setattr(nj, "BUCKET_GRAMS", 2_000)
    monkeypatch.setattr(nj, "FLUSH_GRAMS", 3_000)
    texts = ODD + near_copies(n) + near_copies(9) + [r["text"] for r in small_documents()[:70]] + ["one two", "One  two"]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)] + [(5, "one two three"), (5, "four five six seven"), (None, texts[20])]
    docs = clashing(documents(spark, [t for _, t in rows], [i for i, _ in rows]), "n", "node", "component_id").repartition(3)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"])
                 for r in nj.similar_groups(docs, n, percent).collect())
    assert got == grouped(rows, n, percent)


def test_keep_one_of_each_group(spark):
    docs = clashing(documents(spark, ["a b c d e f g"] * 4 + ["", None, "other text of its own here"], [9, 4, 6, None, 1, 2, 3]), "_gone2", "n")
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 1, 2, 3, 4]
    assert nj.keep_one(docs.limit(0)).count() == 0


def test_repeated_rows_keep_their_links(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(12):
        ws = [f"t{k}w{i}" for i in range(404)]
        other = ws[:-30] + [f"t{k}x{i}" for i in range(30)]
        a, b = 1000 - 2 * k, 999 - 2 * k
        rows += [(a, " ".join(ws))] * 3 + [(b, " ".join(other))]
        want[a] = want[b] = b
    # Two sets of unlike size under one id, each with a near copy.
    short, long_ = [f"s{i}" for i in range(50)], [f"l{i}" for i in range(400)]
    rows += [(2000, " ".join(short)), (2000, " ".join(long_)), (2001, " ".join(short[:-2])), (2002, " ".join(long_[:-9]))]
    want |= {2000: 2000, 2001: 2000, 2002: 2000}
    # Half of either set is like neither.
    rows += [(2003, " ".join(short[:25] + long_[:25]))]
    want[2003] = 2003
    rng.shuffle(rows)
    parts = [documents(spark, [t], [i]) for i, t in rows]
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.union(p)
    got = {(r["doc_id"], r["component_id"]) for r in nj.similar_groups(docs, 5, 80).collect()}
    assert got == set(want.items())


def test_keep_one_of_repeated_rows(spark):
    texts = ["a b c d e f g"] * 3 + ["other words"] + [""] * 2 + [None] * 2 + ["p q r s t u"] * 2
    ids = [4, 4, 4, 4, 1, 1, None, None, 9, 8]
    kept = nj.keep_one(documents(spark, texts, ids).repartition(4))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in kept.collect()) == [
        (-1, ""), (-1, ""), (1, ""), (4, "a b c d e f g"), (4, "other words"), (8, "p q r s t u")]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 300)] + [(900, 901), (902, 901)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(300), 0), 900: 900, 901: 900, 902: 900}


@pytest.mark.parametrize("limit", [0, 1_000])
def test_copies_are_spoken_for(spark, monkeypatch, limit):
    """Ids with a set of their own, or the least of a set, stay; groups are the same by broadcast and by shuffle."""
    monkeypatch.setattr(nj, "SPARE_IDS", limit)
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    texts, ids = [a, a, b, b, a, None, "", a + " x", a], [5, 3, 4, 8, 9, 10, 11, 12, None]
    docs = documents(spark, texts + [b], ids + [9])
    member = nj.signatures(docs, 3).filter("n > 0 and doc_id is not null").select("doc_id", "node").distinct()
    left = nj.without_copies(docs, member)
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [3, 4, 10, 11, 12]
    assert left.filter("doc_id is null").count() == 1
    got = {r["doc_id"]: r["component_id"] for r in nj.similar_groups(docs, 3, 90).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 4: 3, 8: 3, 10: 10, 11: 11, 12: 3, None: None}


def test_dropped_copies_are_not_joined_by_a_shuffle_of_the_texts(spark):
    """Pipeline, near_duplicates: every text was shuffled twice to meet a few ids, 2 x the input on disk."""
    rows = [(i, " ".join(f"w{(i // 2) * 50 + k}" for k in range(30))) for i in range(10)] + [(0, "again"), (0, "again")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = nj.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
        plan = kept._jdf.queryExecution().toString()
        assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan
        assert sorted((r["doc_id"], r["text"][:5]) for r in kept.collect()) == sorted(
            [(i, rows[i][1][:5]) for i in range(0, 10, 2)] + [(0, "again")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
