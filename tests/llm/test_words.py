"""Codes of words: long regular words must not share one."""

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm.subwords import WordEncoder
from tapeloom.llm.words import chunks, words


def thue_morse(size, a="a", b="b"):
    bits = np.array([bin(i).count("1") % 2 for i in range(size)])
    return "".join(np.where(bits == 0, a, b)), "".join(np.where(bits == 0, b, a))


def codes(text, **how):
    return words(next(chunks(pa.array([text]))), **how).code.tolist()


@pytest.mark.parametrize("size", [8, 16, 32, 64, 128, 1024, 4096, 1 << 20])
def test_alternating_words_have_codes_of_their_own(size):
    one, two = thue_morse(size)
    got = codes(f"{one} {two} {one} {one.upper()}")
    assert got[0] != got[1] and got[0] == got[2] == got[3]
    plain = codes(f"{one} {one.upper()}", fold=False)
    assert plain[0] == got[0] and plain[1] != plain[0]


@pytest.mark.parametrize("size", [1024, 4096])
def test_ids_of_alternating_words_are_their_own(size):
    one, two = thue_morse(size)
    enc = WordEncoder()
    ids, at = enc.encode(next(chunks(pa.array([one, two, f"x {two} {one}"]))))
    for k, text in enumerate([one, two, f"x {two} {one}"]):
        assert ids[at[k]:at[k + 1]].tolist() == enc.model.encode(text, add_special_tokens=False).ids


def test_alternating_words_link_and_score_apart(spark):
    from tapeloom.llm import ngram_join
    from tests.llm.common import documents

    one, two = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(4))
    got = ngram_join.similar_groups(documents(spark, [f"{one} {rest}", f"{two} {rest}", f"{one} {rest}"]), 3, 90)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {0: 0, 1: 1, 2: 0}
