import pyarrow.parquet as pq

import corpus_pipeline as cp
from tapeloom.llm import quality_rules as qr
from tests.llm.common import SMALL
from tests.llm.test_native import base_counts, base_spans
from tests.llm.test_ngram_join import grouped


def stored(df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = stored(cp.quality(spark, docs, SMALL), tmp_path, "quality")
    verdict = {r["doc_id"]: r["kept"] for r in qr.judge(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {i for i, k in verdict.items() if k} and not any(base_counts(texts[i])[-1] for i in kept)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    assert not any(labels.get(i) == 0 for i in kept)

    single = stored(cp.near_duplicates(spark, good, SMALL), tmp_path, "single")
    want = {i for i, _, c in grouped([(i, texts[i]) for i in kept], 5, 80) if i == c}
    assert {r["doc_id"] for r in single.collect()} == want and want < kept

    clean = stored(cp.decontamination(spark, single, SMALL), tmp_path, "clean")
    left = {r["doc_id"] for r in clean.collect()}
    items = [r["text"] for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    holds = {i for i in want if any(t in texts[i] for t in items)}
    assert not holds & left and holds

    masked = stored(cp.private_data(spark, clean, SMALL), tmp_path, "masked")
    rows = masked.collect()
    assert masked.columns == docs.columns and {r["doc_id"] for r in rows} == left
    for r in rows:
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert bool(base_spans(texts[r["doc_id"]])) <= (r["text"] != texts[r["doc_id"]])

    packed = cp.packing(spark, masked, SMALL)
    assert {r["doc_id"] for r in packed.collect()} == left


def test_run_gives_the_last_stages_rows(spark):
    rows = cp.run(spark, SMALL).collect()
    assert rows and len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
