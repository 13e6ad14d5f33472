"""Toxicity learned from confirmed toxic texts and unlabelled ones.

Only positives are trusted. The risk of a linear classifier over the words of a text is
estimated from positives and unlabelled texts with the share of toxic text as class prior;
where the estimated risk on negatives falls below zero (the sign of overfitting), the step
goes the other way: the non-negative positive-unlabelled estimator of Kiryo et al. (2017).
Several classifiers, each with its own part of the unlabelled texts, are trained in tasks
and their weights averaged. Words are weighed by how much more common they are in toxic
text than in all text; those counts cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.words import _SEPARATES, PUNCTUATION, chunks, row_of, words
from tapeloom.session import cut_lineage

# Labelled rows that the classifiers are fitted on, at most: confirmed toxic ones, and others whose label isn't looked at.
POSITIVES, UNLABELLED = 4_000, 12_000
# Words of toxic texts that are counted in all text, and the most telling ones that become inputs.
SUPPORT, CANDIDATES, INPUTS = 3, 65_536, 4_096
# Classifiers; steps, rate and ridge of their fit; standard errors by which an input must be more common in toxic text.
BAGS, STEPS, RATE, RIDGE, TELLING = 3, 400, 0.05, 5e-5, 4.0
CUT = 0.5
_BLANKS = PUNCTUATION | _SEPARATES


class Model(NamedTuple):
    """Sorted word codes, their weights and the constant."""

    codes: np.ndarray
    weights: np.ndarray
    constant: float


def fold_of(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def _hits(column: pa.Array, codes: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, code or place in ``codes``): the distinct words of each whole text, or those among ``codes``."""
    for chunk in chunks(column):
        w = words(chunk, blanks=_BLANKS)
        row, code = row_of(w.at), w.code
        if codes is not None:
            place = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[place] == code if len(codes) else np.zeros(len(code), dtype=bool)
            row, code = row[known], place[known]
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        yield chunk.first, len(chunk.off) - 1, row[new], code[new]


def _signed(codes: np.ndarray) -> pa.Array:
    return pa.array(codes.view(np.int64))


def document_words(texts: DataFrame) -> DataFrame:
    """(code, n): in how many of a task's texts each word occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, code in _hits(batch.column(0)):
                c, n = np.unique(code, return_counts=True)
                yield pa.record_batch([_signed(c), pa.array(n)], names=["code", "n"])

    return texts.select("text").mapInArrow(run, "code long, n long")


def count_known(docs: DataFrame, codes: np.ndarray) -> dict[int, int]:
    """In how many of all documents each of ``codes`` (at most CANDIDATES) occurs, by place."""
    held = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, _, _, place in _hits(batch.column(0), known):
                total += np.bincount(place, minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["place", "n"])

    found = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    return {r["place"]: r["n"] for r in found.collect()}


def telling_words(toxic: DataFrame, docs: DataFrame) -> np.ndarray:
    """Codes (sorted) of words far more common in the toxic texts than in all documents."""
    common = document_words(toxic).groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT).orderBy(
        F.desc("n"), "code").limit(CANDIDATES).collect()
    if not common:
        return np.zeros(0, dtype=np.uint64)
    codes = np.array([r["code"] for r in common], dtype=np.int64).view(np.uint64)
    order = np.argsort(codes)
    codes, mine = codes[order], np.array([r["n"] for r in common], dtype=float)[order]
    everywhere = count_known(docs, codes)
    n_toxic, n_all = toxic.count(), docs.count()
    p = mine / max(n_toxic, 1)
    q = np.array([everywhere.get(i, 0) for i in range(len(codes))]) / max(n_all, 1)
    lead = (p - q) / np.sqrt(np.maximum(q * (1 - q), 1 / max(n_all, 1)) / max(n_toxic, 1))
    best = np.lexsort((codes, -lead))[:INPUTS]
    return np.sort(codes[best[lead[best] >= TELLING]])


def non_negative_fit(row: np.ndarray, place: np.ndarray, positive: np.ndarray, inputs: int, prior: float) -> np.ndarray:
    """Weights and constant of a linear logistic classifier under the non-negative risk.

    ``row``/``place`` are the inputs each text has, ``positive`` marks the confirmed rows, the
    others are unlabelled. Full-batch steps from zero, so a fit that runs again gives the same.
    """
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    w = np.zeros(inputs + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.where(positive, prior / max(n_p, 1), 1 / max(n_u, 1))
    for k in range(1, STEPS + 1):
        z = np.clip(np.bincount(row, w[place], len(positive)) + w[-1], -30, 30)
        p, loss = 1 / (1 + np.exp(-z)), np.log1p(np.exp(z))
        negative = np.sum((share * loss)[~positive]) - np.sum((share * loss)[positive])
        # The risk of the positives as negatives is taken from that of all text; below zero only this part is mended.
        if negative >= 0:
            slope = np.where(positive, -share, share * p)
        else:
            slope = np.where(positive, share * p, -share * p)
        g = np.append(np.bincount(place, slope[row], inputs), slope.sum())
        g[:-1] += RIDGE * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def _input_rows(texts: DataFrame, codes: np.ndarray) -> DataFrame:
    """(positive, bag, inputs): the places of each text's inputs; a positive goes into every bag, another into one."""
    held = texts.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[np.ndarray] = []
            for _, rows, row, place in _hits(batch.column(2), held.value):
                lists += np.split(place, np.searchsorted(row, np.arange(1, rows)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["positive", "bag", "inputs"])

    return texts.select("positive", "bag", "text").mapInArrow(run, "positive boolean, bag int, inputs array<long>")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, prior: float | None = None) -> Model:
    """Fit on labelled rows whose crc32(doc_id as text) mod ``folds`` is not ``held``; ``prior`` defaults to their toxic share.

    Labels that are null or contradict one another are left out; a row that is there again
    teaches once. The labelled texts are drawn by a hash of the id; those in the unlabelled part
    are taken whatever their label. Without toxic rows every score is near 0, without others near 1.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(folds) != held)).groupBy("doc_id").agg(
        F.min("toxic").alias("_t"), F.max("toxic").alias("_z")).filter("_t = _z").select("doc_id", "_t", F.xxhash64("doc_id").alias("_o"))
    known = cut_lineage(known)
    n, toxic_n = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("_t"), F.lit(0))).first()
    none = np.zeros(0, dtype=np.uint64)
    if not toxic_n or toxic_n == n:
        return Model(none, np.zeros(0), -30.0 if not toxic_n else 30.0)
    prior = toxic_n / n if prior is None else prior
    toxic = known.filter("_t = 1").orderBy("_o", "doc_id").limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    plain = known.orderBy("_o", "doc_id").limit(UNLABELLED).select("doc_id", F.lit(False).alias("positive"))
    chosen = F.broadcast(toxic.unionByName(plain))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id").withColumn("_x", F.xxhash64("text"))
    texts = cut_lineage(texts.dropDuplicates(["doc_id", "_x", "positive"]).select("doc_id", "positive", "text"))
    codes = telling_words(texts.filter("positive"), docs)
    every = F.sequence(F.lit(0), F.lit(BAGS - 1))
    one = F.array(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(BAGS)).cast("int"))
    rows = _input_rows(texts.withColumn("bag", F.explode(F.when(F.col("positive"), every).otherwise(one))), codes)
    size = len(codes)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.asarray(x, dtype=np.int64) for x in pdf["inputs"]]
        row, place = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
        w = non_negative_fit(row, place, pdf["positive"].to_numpy(bool), size, prior)
        return pd.DataFrame({"place": np.arange(size + 1), "weight": w})

    # A bag holds POSITIVES + UNLABELLED texts of INPUTS places at most.
    fitted = rows.groupBy("bag").applyInPandas(train, T.StructType([T.StructField("place", T.LongType()), T.StructField("weight", T.DoubleType())]))
    mean = np.zeros(size + 1)
    for r in sorted(map(tuple, fitted.collect())):
        mean[r[0]] += r[1]
    bags = rows.select("bag").distinct().count()
    mean /= max(bags, 1)
    return Model(codes, mean[:-1], float(mean[-1]))


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) of every row's whole text; a null or empty text has the score of no words."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # INPUTS codes and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            z = np.full(batch.num_rows, m.constant)
            for first, rows, row, place in _hits(batch.column(1), m.codes):
                z[first:first + rows] += np.bincount(row, m.weights[place], rows) if len(m.codes) else 0
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Scores of all rows with ``held_out``, whether a row was kept from learning (null ids count as held out)."""
    return score(docs, fit(docs, labels, folds, held)).select(
        "doc_id", F.coalesce(fold_of(folds) == held, F.lit(True)).alias("held_out"), "score", "predicted")
