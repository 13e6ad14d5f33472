"""Quality rules: text counts and a hashed n-gram log-likelihood ratio, in SQL functions only.

Every text is a bag of hashed n-grams: its words, word pairs and word endings. Two
multinomials over the hash buckets are estimated, one from trusted documents and one
from the raw corpus; a document's score is the mean over its n-grams of
log(p_trusted / p_raw), and the same threshold decides on every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
# Buckets of hashed n-grams: the size of both multinomials.
BUCKETS = 10_000
# Trusted documents that the target multinomial is fitted on, at most.
TRUSTED_DOCS = 20_000
# Nats per n-gram below which a text is rejected.
THRESHOLD = -0.2
MIN_WORDS = 50
# Positions kept beside a window's hash while windows are sorted; longer texts compare all windows in full.
_POSITION_BITS = 24


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK, -1), "")


def _window_codes(codes: Column) -> Column:
    """A 64-bit code of every 3-word window."""
    heads = F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 2, F.lit(0)))
    return F.transform(heads, lambda c, i: F.xxhash64(c, F.get(codes, i + 1), F.get(codes, i + 2)))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words, the words inside 3-word windows of ``_windows`` that occur twice or more.

    A sort of plain longs (code with its low bits replaced by the position) leaves the few
    windows that can be equal; those are compared in full. Each array is a column of its
    own: inside a lambda an expression would be computed again for every element.
    """
    low = (1 << _POSITION_BITS) - 1

    def high(c: Column) -> Column:
        return F.shiftright(c, _POSITION_BITS)

    def beside(c: Column, array: str, j: Column, same) -> Column:
        return F.coalesce(same(c, F.get(array, j - 1)), F.lit(False)) | F.coalesce(same(c, F.get(array, j + 1)), F.lit(False))

    df = df.withColumn("_packed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform(
        "_windows", lambda c, i: c.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))))
    near = F.transform(F.filter("_packed", lambda c, j: beside(c, "_packed", j, lambda x, y: high(x) == high(y))),
                       lambda c: c.bitwiseAND(F.lit(low)))
    every = F.sequence(F.lit(0).cast("long"), F.size("_windows").cast("long") - 1)
    near = F.when(F.size("_windows") > low, every).otherwise(near)
    df = df.withColumn("_near", F.when(F.col("_packed").isNotNull(), near))
    df = df.withColumn("_full", F.sort_array(F.transform(
        "_near", lambda p: F.struct(F.get("_windows", p.cast("int")).alias("c"), p.alias("p")))))
    df = df.withColumn("_at", F.sort_array(F.transform(
        F.filter("_full", lambda s, j: beside(s, "_full", j, lambda x, y: x["c"] == y["c"])), lambda s: s["p"])))
    three = F.lit(3).cast("long")
    steps = F.transform("_at", lambda p, j: F.least(three, F.coalesce(F.get("_at", j + 1) - p, three)))
    none = F.lit(0).cast("long")
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, none, lambda a, x: a + x), none)).drop(
        "_packed", "_near", "_full", "_at")


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts of every whole text (null: no words).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; the
    columns _codes and _ends (codes of words and of their last three characters) stay for the score.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", words_of(t))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.select(
        "*",
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"),
        F.transform("_words", lambda w: F.xxhash64(F.substring(w, -3, 3), F.lit(3))).alias("_ends"),
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    ).drop("_words")
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    out = out.withColumn("_windows", _window_codes(F.col("_codes")))
    out = _repeat_words(out).drop("_windows")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _gram_buckets(buckets: int) -> list[Column]:
    """Bucket arrays of the words, word pairs and endings of a row; a word said twice running is one kind of pair."""
    b = F.lit(buckets)
    codes, ends = F.col("_codes"), F.col("_ends")
    return [
        F.transform(codes, lambda c: F.pmod(c, b).cast("int")),
        F.zip_with(codes, F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))),
                   lambda x, y: F.pmod(F.when(x == y, F.lit(7).cast("long")).otherwise(F.xxhash64(x, y)), b).cast("int")),
        F.transform(ends, lambda c: F.pmod(c, b).cast("int")),
    ]


def trusted_ids(labels: DataFrame, most: int = TRUSTED_DOCS) -> DataFrame:
    """At most ``most`` doc_ids marked as good, the first by a hash of the id."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_trusted"))
    return good.distinct().orderBy(F.xxhash64("_trusted"), "_trusted").limit(most)


def bucket_weights(counted: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(p_trusted / p_raw) of every bucket, add-one smoothed; all zero without trusted text.

    The raw multinomial counts every document. ``trusted`` is bounded, so it is broadcast;
    what comes back is one row per bucket.
    """
    grams = counted.join(F.broadcast(trusted), F.col("doc_id") == F.col("_trusted"), "left").select(
        F.col("_trusted").isNotNull().cast("long").alias("_good"), F.explode(F.concat(*_gram_buckets(buckets))).alias("_b"))
    raw, good = [0] * buckets, [0] * buckets
    for r in grams.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.sum("_good").alias("g")).collect():
        raw[r["_b"]], good[r["_b"]] = r["n"], r["g"]
    if not sum(good):
        return [0.0] * buckets
    from math import log

    all_raw, all_good = sum(raw) + buckets, sum(good) + buckets
    return [log((g + 1) / all_good) - log((n + 1) / all_raw) for g, n in zip(good, raw)]


def with_score(counted: DataFrame, weights: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Add llr (mean log-likelihood ratio of the n-grams; 0 without words) and kept."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.lit(0.0)
    for grams in _gram_buckets(len(weights)):
        total = total + F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return counted.withColumn("llr", F.when(F.col("n_words") > 0, total / (3.0 * F.col("n_words"))).otherwise(F.lit(0.0))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS,
          trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """Counts, score and verdict of every row of ``docs``, and nothing else of its columns but doc_id and text.

    A null text counts as empty and is rejected (no words); repeated rows are judged alike;
    labels without a good row leave the base rules alone to decide.
    """
    counted = text_counts(docs.select("doc_id", "text"))
    weights = bucket_weights(counted, trusted_ids(labels, trusted_docs), buckets)
    return with_score(counted, weights, threshold).drop("_codes", "_ends")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns as they were."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    held = docs.select(row, F.col("doc_id"), F.col("text"))
    counted = text_counts(held)
    weights = bucket_weights(text_counts(docs.select("doc_id", "text")), trusted_ids(labels))
    # A filter on the verdict alone would be pushed below the arrays it is made from, and compute
    # them anew for every element; it stops at a column that isn't deterministic.
    judged = with_score(counted, weights).select("_row", "kept", F.monotonically_increasing_id().alias("_at"))
    return judged.filter(F.col("kept") & (F.col("_at") >= 0)).select(*[F.col("_row")[c].alias(c) for c in names])
