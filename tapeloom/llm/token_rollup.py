"""Token totals by source, language and tokenizer version, kept by signed deltas.

A batch of changes is stored by its id in three steps: its document rows, the signed sums
they make, then a commit row. Readers see committed batches only, so a batch that failed
half-way counts for nothing and is simply written again, and one that was committed is not
applied a second time. Totals are sums over deltas; no total is ever rewritten.

The store has one writer at a time. It lives in a folder that all executors share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.subwords import WordEncoder, tokenizer_file
from tapeloom.llm.words import chunks

GROUPS = ["source", "lang", "version"]
CHANGES = "doc_id long, action string, source string, lang string, version string, n_tokens long"
_STATE = "doc_id long, version string, alive boolean, source string, lang string, n_tokens long, seq long"
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long"
_COMMIT = "batch_id string, seq long"
_RANKS: dict = {}
_WORDS: dict = {}


def _word_encoder(name: str) -> WordEncoder:
    """The word tokenizer, once per worker: what one task has learned of the words serves the next."""
    if name not in _WORDS:
        _WORDS[name] = WordEncoder(name)
    return _WORDS[name]


def _rank_encoder(name: str):
    """The public byte-level tokenizer with the given ranks, once per worker."""
    if name not in _RANKS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokenizer_file(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _RANKS[name] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _RANKS[name]


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens) of every whole text; a null or empty text has none.

    ``tokenizer`` is a public vocabulary file: ``word_bpe_49k.json`` or one of ``*.tiktoken``;
    its name is the version.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None if tokenizer.endswith(".tiktoken") else _word_encoder(tokenizer)
        for batch in batches:
            parts = [np.zeros(0, np.int64)]
            for chunk in chunks(batch.column(3)):
                if words is None:
                    raw = chunk.buf.tobytes()
                    enc = _rank_encoder(tokenizer)
                    parts.append(np.array([len(enc.encode_ordinary(raw[a:b].decode())) for a, b in
                                           zip(chunk.off[:-1], chunk.off[1:])], dtype=np.int64))
                else:
                    parts.append(words.counts(chunk))
            yield pa.record_batch([*(batch.column(k) for k in range(3)), pa.array(np.concatenate(parts))],
                                  names=["doc_id", "source", "lang", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text").mapInArrow(
        run, "doc_id long, source string, lang string, n_tokens long")
    return out.withColumn("version", F.lit(tokenizer))


class Rollup:
    """A store of change batches below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, kind: str, batches: list[str], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{b}" for b in batches])

    def committed(self) -> list[str]:
        """Ids of the batches that count, in order."""
        try:
            rows = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits/*")
            return [r["batch_id"] for r in rows.orderBy("seq").collect()]
        except AnalysisException:  # nothing committed yet
            return []

    def state(self) -> DataFrame:
        """The latest row of every (doc_id, version) that was ever changed."""
        log = self._read("state", self.committed(), _STATE)
        return log.groupBy("doc_id", "version").agg(F.max_by(F.struct("alive", "source", "lang", "n_tokens"), "seq").alias("r")).select(
            "doc_id", "version", "r.*")

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, language and version; a null group is one of its own."""
        deltas = self._read("delta", self.committed(), _DELTA)
        return deltas.groupBy(*GROUPS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter(
            "n_docs != 0 or n_tokens != 0")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply inserts, deletes and revised counts; False, and no work, for a batch that counts already.

        ``changes`` has the columns of CHANGES. An insert or revision states the count of a document under a
        version, whatever was there before; deleting what isn't there changes nothing. Of several
        changes to one document and version in a batch, a delete wins, then the largest count, then
        the least source and language.
        Rows without an id can't be found again: inserted ones add to the totals, others change nothing.
        """
        before = self.committed()
        if batch_id in before:
            return False
        seq = len(before)
        pick = Window.partitionBy("doc_id", "version").orderBy(
            (F.col("action") != "delete").cast("int"), F.col("n_tokens").desc_nulls_last(), "source", "lang")
        some = changes.select(*[f.strip().split()[0] for f in CHANGES.split(",")])
        named = some.filter("doc_id is not null").withColumn("_k", F.row_number().over(pick)).filter("_k = 1")
        loose = some.filter("doc_id is null and action = 'insert'")
        rows = named.unionByName(loose.withColumn("_k", F.lit(1))).select(
            "doc_id", "version", (F.col("action") != "delete").alias("alive"), "source", "lang",
            F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.lit(seq).cast("long").alias("seq"))
        rows.write.mode("overwrite").parquet(f"{self.path}/state/{batch_id}")

        new = self._read("state", [batch_id], _STATE)
        touched = new.filter("doc_id is not null").select("doc_id", "version")
        old = self.state().filter("alive").join(touched, ["doc_id", "version"], "left_semi")
        signed = old.select(*GROUPS, F.lit(-1).alias("s"), "n_tokens").unionByName(
            new.filter("alive").select(*GROUPS, F.lit(1).alias("s"), "n_tokens"))
        delta = signed.groupBy(*GROUPS).agg(F.sum("s").cast("long").alias("n_docs"), F.sum(F.col("s") * F.col("n_tokens")).alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/delta/{batch_id}")
        self.spark.createDataFrame([(batch_id, seq)], _COMMIT).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/commits/{batch_id}")
        return True


def with_action(counts: DataFrame, action: str) -> DataFrame:
    return counts.withColumn("action", F.lit(action))


def copies(docs: DataFrame) -> DataFrame:
    """doc_ids of documents whose whole text an earlier id has, by two 64-bit codes and the length."""
    key = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_a"), F.xxhash64("text", F.lit(1)).alias("_b"),
        F.length("text").alias("_n"))
    least = key.groupBy("_a", "_b", "_n").agg(F.min("doc_id").alias("_first"))
    return key.join(least, ["_a", "_b", "_n"]).filter("doc_id > _first").select("doc_id").distinct()


def corpus_totals(docs: DataFrame, store: Rollup, versions: tuple[str, ...] = ("word_bpe_49k.json", "byte_bpe_50k.tiktoken")) -> DataFrame:
    """Totals after a corpus was loaded, delivered again, cleared of exact copies and recounted.

    Batches: all documents under each version; the first batch once more (without effect);
    deletes of documents whose text an earlier one has; and, for the first version, counts
    revised by one end id a document.
    """
    for v in versions:
        store.commit(f"load-{v}", with_action(token_counts(docs, v), "insert"))
    store.commit(f"load-{versions[0]}", with_action(token_counts(docs, versions[0]), "insert"))
    gone = copies(docs)
    store.commit("copies", with_action(store.state().join(gone, "doc_id", "left_semi"), "delete"))
    revised = store.state().filter((F.col("version") == versions[0]) & F.col("alive")).withColumn("n_tokens", F.col("n_tokens") + 1)
    store.commit("ends", with_action(revised, "revise"))
    return store.totals()
