import hashlib
import re
from collections import Counter

import pytest

from tapeloom.llm import personal_data as pii
from tapeloom.llm import quality_rules as qr
from tests.llm.common import ODD, clashing, documents, small_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


CASES = [
    *ODD, "é a.b@c.d_e@f.g x@y @z.w a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.000255 9.9.9", "4111 1111 1111 1111, 4111-1111-1111-1112",
    "0" * 5000, "+1 (555) 123-4567 or +49.30.1234567x +1 +12 3", "a" * 4000 + "@", "é4111111111111111é 1 2 3 4 5 6 7 8 9 0 1 2 3 4",
    "pay to IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433", 'ssn 123-45-6789; 123-45-6789',
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "+1 555 123 4567@x.com 10.0.0.1", " ".join(f"u{i}@h.io" for i in range(700)),
]


def test_spans_equal_plain_matching(spark):
    texts = CASES + [r["text"] for r in small_documents()]
    got = {r["doc_id"]: r for r in pii.report(clashing(documents(spark, texts), "kind", "_text", "spans")).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, t, want, r["spans"])
        assert set(want) <= set(r["spans"].split(",")) | {""}
        kinds = Counter(w.split(":")[0] for w in want)
        assert [r[f"n_{k}"] for k in PATTERNS] == [kinds[k] for k in PATTERNS]


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32", "IBAN GB82WEST12345698765433", "ssn 123-45-6789", "part 123-45-6789",
             "password: Abcdefgh1234567890xyz", "word Abcdefgh1234567890xyzab"]
    got = [r["spans"] for r in pii.report(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got[:4] == ["iban:5:32", "", "national_id:4:15", ""] and got[4].startswith("secret:") and got[5] == ""


def test_mask_replaces_every_span_and_keeps_columns(spark):
    texts = [None, "", "é a@b.co +1 555 123 4567@x.com end", "clean", "x 4111111111111111, 10.0.0.1"]
    docs = clashing(documents(spark, texts), "_row", "at")
    out = pii.mask(docs)
    assert out.columns == docs.columns
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert got[0] is None and got[1] == "" and got[3] == "clean" and got[4] == "x [CARD], [IP]"
    assert not any(base_spans(t) for t in got)
    assert pii.mask(docs.limit(0)).count() == 0


def base_counts(text):
    text = text or ""
    ws = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    many = Counter(win)
    inside = {i + k for i, w in enumerate(win) if many[w] > 1 for k in range(3)}
    n, rep = len(ws), len(inside)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 50 or 100 * rep > 50 * n


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_equal_plain_counting(spark):
    texts = ODD + [r["text"] for r in small_documents()]
    out = qr.judge(clashing(documents(spark, texts), "n_words", "_codes", "kept"), labels(spark, [(15, 1, 0), (15, 1, 0), (None, 1, 0)]))
    for r in out.collect():
        assert [r[c] for c in NAMES] == list(base_counts(texts[r["doc_id"]])), texts[r["doc_id"]]
        assert r["kept"] is False or not r["base_failed"]


def test_verdict_uses_the_ratio(spark):
    good = "the quick fox ran over the old stone wall and then it slept under a tall tree until noon " * 4
    words = [f"w{i}" for i in range(400)]
    clean = [" ".join(words[i:i + 80]) + " the fox" for i in range(0, 300, 10)]
    junk = [" ".join(f"{w}###" for w in words[i:i + 80]) for i in range(0, 300, 10)]
    docs = documents(spark, clean + junk + [good])
    out = {r["doc_id"]: r for r in qr.judge(docs, labels(spark, [(i, 1, 0) for i in range(0, 30, 2)])).collect()}
    assert all(out[i]["kept"] for i in range(30))
    assert not any(out[i]["kept"] for i in range(30, 60))


def test_keep_good_keeps_columns_and_takes_empty_tables(spark):
    docs = clashing(documents(spark, [None, "tail " * 70, " ".join(f"w{i}" for i in range(60))]), "_row", "llr", "n_words")
    out = qr.keep_good(docs, labels(spark, []))
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [2]
    assert qr.keep_good(docs.limit(0), labels(spark, [])).count() == 0
    assert qr.judge(docs.limit(0), labels(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [24, 2])
def test_long_texts_compare_all_windows(spark, monkeypatch, bits):
    monkeypatch.setattr(qr, "_POSITION_BITS", bits)
    texts = ["a b c d a b c e f g h i j", "p q r s t u v w x y"]
    got = [r["n_repeat_words"] for r in qr.text_counts(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == [6, 0]
