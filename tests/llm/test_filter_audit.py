"""The filter audit against plain counting over every order."""

import re
from collections import Counter
from itertools import permutations

import pytest

from tapeloom.llm import filter_audit
from tests.llm.common import ODD, clashing, documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    sets = []
    for i, text, source in rows:
        x = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", x)
        f = set()
        if len(ws) < 200:
            f.add("A")
        if 100 * len(set(ws)) < 50 * len(ws):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", x)) > 2 * len(x):
            f.add("C")
        if re.search("[#$%&*|]", x):
            f.add("D")
        if i is not None and any(j is not None and j < i and (y or "") == x for j, y, _ in rows):
            f.add("E")
        sets.append((source or "", f, i in good, i in toxic))
    out, shap = {}, Counter()
    for order in permutations("ABCDE"):
        for part, f, g, t in sets:
            first = next((x for x in order if x in f), None)
            if first:
                shap[part, first] += 1
            for k, x in enumerate(order):
                r = out.setdefault((part, "".join(order), k + 1), [0] * 6)
                here, gone = first == x, bool(f & set(order[:k]))
                r[0] += not f & set(order[:k + 1])
                r[1] += here
                r[2] += x in f and gone
                r[3] += f == {x}
                r[4] += here and g
                r[5] += here and t
    return sorted((*k, *v, shap[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


def test_every_order_matches_plain_counting(spark):
    long = " ".join(f"word{i}" for i in range(250))
    rows = [(i, t, ("a", "b", None)[i % 3]) for i, t in enumerate(ODD)]
    rows += [(100, long, "a"), (101, long, "b"), (99, long + " ", "a"), (102, long + " SHOUT" * 30, ""), (103, "same " * 300, "b"),
             (104, "same " * 300, "b"), (105, long + " $5 |", "a"), (106, long, None), (None, long, "a"), (None, None, None),
             (101, long, "b"), (101, "another text under the same id", "b"), (107, "x " * 400_000, "a")]
    labels = [(100, 1, 0), (101, 1, 1), (101, 0, None), (104, None, 1), (2, 1, 1), (None, 1, 1), (9999, 1, 1)]
    got = filter_audit.audit(clashing(rows_of(spark, rows), "part", "bits", "_h", "_id", "n"), spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_hot_texts_are_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_ROWS", 5)
    monkeypatch.setattr(filter_audit, "SALT_ROWS", 2)
    rows = [(1000 - i, "copied text", "s") for i in range(40)] + [(i, f"own text {i}", "s") for i in range(20)] + [(30, "pair", "s"), (31, "pair", "s")]
    got = filter_audit.audit(rows_of(spark, rows).repartition(7), spark.createDataFrame([(1000, 1, 0)], LABELS))
    assert sorted(map(tuple, got.collect())) == brute(rows, [(1000, 1, 0)])


def test_no_documents_no_parts(spark):
    assert filter_audit.audit(documents(spark, []), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("text,bits", [(None, 1), ("", 1), ("a " * 200, 2), ("a b " * 100, 2), ("AB " + "c" * 96 + " ", 1), ("ABC" + "c" * 97, 5)])
def test_bounds_of_the_filters(spark, text, bits):
    from pyspark.sql import functions as F

    assert documents(spark, [text]).select(filter_audit.text_failures(F.col("text"))).first()[0] == bits
