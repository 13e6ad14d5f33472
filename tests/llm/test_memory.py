"""What the Python workers of near_duplicates and packing hold at once."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tapeloom.llm import bin_slack, ngram_join


class Given:
    """Stands for a DataFrame (without one, nothing but the task is traced) and gives the function back that would run in a task."""

    schema = {"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}

    def select(self, *columns):
        return self

    groupBy = select

    def mapInArrow(self, f, schema):
        return f

    applyInArrow = mapInArrow


def peak(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_bucket_is_compared_in_parts():
    rng = np.random.default_rng(1)
    n = 1_000_000
    code = rng.integers(0, 2**64, n, dtype=np.uint64)
    code[: n // 10] = code[n // 10: n // 5]  # each of these in two sets
    ids = np.repeat(np.arange(n // 100), 100)
    table = pa.Table.from_batches([ngram_join._parts(0, np.zeros(n, np.int32), 1, ids, code)])
    out, most = peak(lambda: ngram_join.shared_grams(Given(), 4)(table))
    assert most < 40 * n
    own = out.filter(pc.equal(out["kind"], 1))
    got = sorted(zip(ngram_join._ids(own).tolist(), ngram_join._flat(own, "codes", np.uint64).tolist()))
    assert got == sorted(zip(ids[: n // 5].tolist(), code[: n // 5].tolist()))
    assert (ngram_join._flat(own, "counts", np.int32) == 2).all()


def test_packing_holds_little_beside_its_words():
    text = " ".join(f"word{k % 5000}" for k in range(1500))
    batch = pa.record_batch([pa.array(range(300)), pa.array([text] * 300)], names=["doc_id", "text"])
    out, most = peak(lambda: sum(b.num_rows for b in bin_slack.token_pieces(Given())(iter([batch]))))
    assert out >= 300 and most < 24_000_000
