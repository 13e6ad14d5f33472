"""Quality by compression: dictionaries of good and bad labelled text, and the difference in size they leave.

Text like the good examples compresses better with their dictionary, text like the bad
ones with the other. Sizes are summed over pieces of a text (a long text teaches the
compressor its own words, which would hide the dictionaries). A logistic curve over the
difference, normalised by the plain compressed size, turns it into a probability; the
text's own rates and its length enter the curve too, as repetitive text shrinks alike
under any dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.words import chunks
from tapeloom.session import cut_lineage

# Labelled texts of each class that the dictionaries are built from, and others for the curve, at most.
DICTIONARY_DOCS, CURVE_DOCS = 1_500, 1_500
# Bytes of a dictionary and of a piece; pieces that a dictionary is trained on, drawn from everywhere in its texts.
DICTIONARY_BYTES, PIECE, DICTIONARY_PIECES = 49_152, 1_024, 12_000
LEVEL = 3
CUT = 0.3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class _Sizer:
    """Compressed sizes with no, the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        import zstandard as z

        def made(raw: bytes | None):
            if not raw:
                return z.ZstdCompressor(level=LEVEL)
            d = z.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(level=LEVEL, dict_data=d)

        self.plain, self.good, self.bad = made(None), made(good), made(bad)

    def sizes(self, text: bytes) -> tuple[int, int, int, int]:
        """Sizes with the good, the bad and no dictionary, over all pieces, and the length."""
        g = b = p = 0
        for i in range(0, len(text), PIECE):
            part = text[i:i + PIECE]
            g += len(self.good.compress(part))
            b += len(self.bad.compress(part))
            p += len(self.plain.compress(part))
        return g, b, p, len(text)


def inputs(sizes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Normalised difference, plain rate, rate with the good dictionary, log length; all 0 for an empty text."""
    g, b, p, n = np.array(sizes, dtype=float).reshape(-1, 4).T
    p, n = np.maximum(p, 1), np.maximum(n, 1)
    return np.column_stack([(b - g) / p, np.where(p > 1, p / n, 0.0), g / n, np.log(n)])


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    z = (x - model.mean) / model.scale @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary trained on pieces of texts; their bytes as they are where there are too few to train on."""
    import zstandard as z

    total = sum(map(len, pieces))
    if len(pieces) >= 64 and total >= 64 * 1024:
        try:
            return z.train_dictionary(min(DICTIONARY_BYTES, total // 8), pieces).as_bytes()
        except z.ZstdError:
            pass
    # Magic numbers aside, any bytes serve as a raw dictionary of recent content.
    return b" " + b"".join(pieces)[:DICTIONARY_BYTES]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights of a lightly regularised logistic fit by Newton steps, classes as they occur."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(a.shape[1]), 1e-2 * np.eye(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def _pieces(texts: DataFrame) -> DataFrame:
    """(_y, _h, _p): every piece of every text with a hash to draw by."""
    raw, rest = F.col("text").cast("binary"), F.length(F.col("text").cast("binary"))
    cut = F.transform(F.sequence(F.lit(1), rest, F.lit(PIECE)),
                      lambda i: F.struct(F.xxhash64("doc_id", "_x", i).alias("h"), F.substring(raw, i, F.lit(PIECE)).alias("p")))
    return texts.filter("text <> ''").select("_y", F.explode(cut).alias("_c")).select("_y", F.col("_c.h").alias("_h"), F.col("_c.p").alias("_p"))


def _sizes(sizer: _Sizer, column: pa.Array) -> list[tuple[int, int, int, int]]:
    """The sizer's figures of every whole text of a column."""
    out: list[tuple[int, int, int, int]] = []
    for chunk in chunks(column):
        raw = chunk.buf.tobytes()
        out += [sizer.sizes(raw[a:b]) for a, b in zip(chunk.off[:-1], chunk.off[1:])]
    return out


def _curve_sizes(texts: DataFrame, good: bytes, bad: bytes) -> list:
    """(_y, g, b, p, n) of every text, by id; the texts stay in their tasks."""
    held = texts.sparkSession.sparkContext.broadcast((good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = _Sizer(*held.value)
        for batch in batches:
            found = np.array(_sizes(sizer, batch.column(2)), dtype=np.int64).reshape(-1, 4)
            yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, found.T)], names=["_y", "_i", "g", "b", "p", "n"])

    return sorted(texts.select(F.col("_y").cast("int"), F.xxhash64("doc_id", "_x").alias("_i"), "text").mapInArrow(
        run, "_y int, _i long, g long, b long, p long, n long").collect(), key=tuple)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Model:
    """Fit on a bounded sample of whole labelled texts whose crc32(doc_id as text) mod ``folds`` is not ``held``.

    The first texts of each class by a hash of the id build the dictionaries and the next
    ones the curve, so no text is judged by a dictionary that holds it. Only ids, drawn pieces
    and sizes come to the driver; a row that is there again teaches once. Labels that are null
    or contradict one another are left out; with one class only, every score is that class's.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != held)).groupBy("doc_id").agg(
        F.min("quality").alias("_y"), F.max("quality").alias("_z")).filter("_y = _z").select("doc_id", "_y")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    most = DICTIONARY_DOCS + CURVE_DOCS
    parts = [known.filter(F.col("_y") == y).orderBy(*order).limit(most) for y in (0, 1)]
    sample = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("_x")).join(
        F.broadcast(parts[0].union(parts[1])), "doc_id")
    rows = sample.select("doc_id", "_x", "_y", F.xxhash64("doc_id").alias("_h")).distinct().orderBy("_h", "doc_id", "_x").limit(2 * most).collect()
    by: dict[int, list[tuple]] = {0: [], 1: []}
    for r in rows:
        by[r["_y"]].append((r["doc_id"], r["_x"]))
    if not by[0] or not by[1]:
        flat = np.zeros(5)
        flat[-1] = 30.0 if by[1] else -30.0 if by[0] else 0.0
        return Model(b"", b"", np.zeros(4), np.ones(4), flat)
    # Half of a small class at most goes into its dictionary.
    cut = {y: min(DICTIONARY_DOCS, (len(t) + 1) // 2) for y, t in by.items()}
    learns = [(*k, True) for y in (0, 1) for k in by[y][:cut[y]]]
    judges = [(*k, False) for y in (0, 1) for k in (by[y][cut[y]:] or by[y])]
    schema = T.StructType([sample.schema["doc_id"], T.StructField("_x", T.LongType()), T.StructField("_learns", T.BooleanType())])
    chosen = docs.sparkSession.createDataFrame(learns + judges, schema)
    texts = cut_lineage(sample.join(F.broadcast(chosen), ["doc_id", "_x"]).dropDuplicates(["doc_id", "_x", "_learns"]))
    pieces = _pieces(texts.filter("_learns"))
    drawn = [pieces.filter(F.col("_y") == y).orderBy("_h", "_p").limit(DICTIONARY_PIECES).collect() for y in (1, 0)]
    good, bad = (_dictionary([bytes(r["_p"]) for r in d]) for d in drawn)
    found = _curve_sizes(texts.filter("not _learns"), good, bad)
    return Model(good, bad, *logistic(inputs([tuple(r)[2:] for r in found]), np.array([r["_y"] for r in found], dtype=float)))


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) of every row's whole text; a null or empty text has the curve's value for no text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY_BYTES each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        sizer = _Sizer(m.good, m.bad)
        for batch in batches:
            p = probability(m, inputs(_sizes(sizer, batch.column(1))))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))],
                                  names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Scores of all rows with ``held_out``, whether a row was kept from learning (null ids count as held out)."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return score(docs, fit(docs, labels, folds, held)).select(
        "doc_id", F.coalesce(fold == held, F.lit(True)).alias("held_out"), "score", "predicted")
