"""What five filters remove together and alone, in every order they can be applied in.

A document that fails several filters is removed by the first of them, so what a filter
seems to remove depends on its place. Each document becomes a combination of failure
bits; the figures of all orders follow from the counts of the combinations. Repeated
texts are marked by a left-semi join on the hash, the exact text and a smaller doc_id.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage

FILTERS = "ABCDE"
_BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
# A text with this many rows, and with more than this share of all rows, has its rows dealt over salts.
HOT_ROWS, HOT_SHARE, SALT_ROWS = 5_000, 0.001, 2_500


def text_failures(text: Column, words: int = 200) -> Column:
    """Bits of the filters that look at one text: A few words, B few distinct words, C capitals, D symbols.

    Words are runs of anything but blanks and \\t..\\r, case-sensitive; a null text is empty.
    """
    t = F.coalesce(text, F.lit(""))
    found = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, distinct = F.size(found), F.size(F.array_distinct(found))
    size = F.char_length(t)
    capitals = size - F.char_length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))

    def bit(fails: Column, f: str) -> Column:
        return F.when(fails, F.lit(_BIT[f])).otherwise(F.lit(0))

    return (bit(n < words, "A") + bit(100 * distinct.cast("long") < 50 * n, "B") + bit(100 * capitals.cast("long") > 2 * size, "C")
            + bit(t.rlike("[#$%&*|]"), "D"))


def repeated(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Those rows of ``texts`` (_id, _h, _text, ...) whose text some smaller _id has too.

    ``rows`` are the same rows without texts. A text moves only where its hash occurs under
    several ids. On the right of the semi join is one row per text, its least id; the rows of
    a text that many have are dealt over salts. A null id is never smaller and has no smaller one.
    """
    groups = rows.filter("_id IS NOT NULL").groupBy("_h").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most")
    groups = cut_lineage(groups.drop("_most"))
    total = rows.count()
    # At most 1 / HOT_SHARE texts can hold more than that share of the rows, so this is small whatever the corpus.
    hot = groups.filter((F.col("_n") >= HOT_ROWS) & (F.col("_n") > HOT_SHARE * total)).select(
        F.col("_h").alias("_g"), F.ceil(F.col("_n") / SALT_ROWS).cast("int").alias("_salts"))
    salted = texts.filter("_id IS NOT NULL").join(F.broadcast(hot), F.col("_h") == F.col("_g"), "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int"))).drop("_g", "_salts")

    def spread(df: DataFrame) -> DataFrame:
        n = F.coalesce(F.col("_salts"), F.lit(1))
        return df.join(F.broadcast(hot), F.col("_h") == F.col("_g"), "left").withColumn(
            "_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_g", "_salts")

    moved = salted.join(spread(groups.select("_h")), ["_h", "_salt"], "left_semi")
    first = spread(moved.groupBy("_h", "_text").agg(F.min("_id").alias("_first")))
    a, b = moved.alias("a"), first.alias("b")
    return a.join(b, (F.col("a._h") == F.col("b._h")) & (F.col("a._salt") == F.col("b._salt")) & (F.col("a._text") == F.col("b._text"))
                  & (F.col("b._first") < F.col("a._id")), "left_semi").drop("_salt")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each source by the set of filters they fail.

    A null source counts as the empty one. A row that is there again counts again; a document
    is good (toxic) if any of its labels is. Rows without id have no label.
    """
    t = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"),
                    F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    t = t.withColumn("_h", F.sha2("_text", 256))
    rows = cut_lineage(t.select("_id", "_h", "part", text_failures(F.col("_text")).alias("_bits")))
    again = repeated(t.select("_id", "_h", "_text"), rows.select("_id", "_h")).select("_id", "_h").distinct()
    # One row per document and text with its own failures, and one for each that the semi join marks.
    key = ["_id", "_h"]
    own = rows.groupBy(*key, "part", "_bits").agg(F.count(F.lit(1)).alias("_n"))
    marked = own.select(*key, "part", "_bits", "_n", F.lit(False).alias("_e")).unionByName(
        own.join(again, key, "left_semi").select(*key, "part", "_bits", F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_e")))
    failed = marked.groupBy(*key, "part", "_bits").agg(F.sum("_n").alias("_n"), F.max("_e").alias("_e")).select(
        "_id", "part", F.when(F.col("_e"), F.col("_bits") + _BIT["E"]).otherwise(F.col("_bits")).alias("bits"), "_n")
    flags = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    bare = failed.filter("_id IS NULL").select("part", "bits", "_n", F.lit(0).alias("_good"), F.lit(0).alias("_toxic"))
    known = failed.filter("_id IS NOT NULL").join(flags, "_id", "left").select("part", "bits", "_n", "_good", "_toxic").unionByName(bare)
    return known.groupBy("part", "bits").agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.coalesce("_good", F.lit(0))).alias("good"),
        F.sum(F.col("_n") * F.coalesce("_toxic", F.lit(0))).alias("toxic"))


def _with_steps(parts: DataFrame) -> DataFrame:
    """Every row with every order and step: the filter's bit and the bits of those before it."""
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    s = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = [(F.instr("filter_order", f), _BIT[f]) for f in FILTERS]
    return s.withColumns({"bit": sum((F.when(i == F.col("step"), b).otherwise(0) for i, b in at), F.lit(0)),
                          "before": sum((F.when(i < F.col("step"), b).otherwise(0) for i, b in at), F.lit(0))})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part, order and step: documents kept, removed, failing but gone already, failing this filter alone,
    good and toxic ones removed, and the filter's removals summed over all orders.

    A part's combinations are 32 at most, so one row holds them. No documents: no parts, no rows.
    """
    parts = combinations(docs, labels).groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("_c"))
    s = _with_steps(parts)
    bit, before = F.col("bit"), F.col("before")
    zero = F.lit(0).cast("long")

    def total(value, keep) -> Column:
        return F.aggregate("_c", zero, lambda acc, c: acc + F.when(keep(c["bits"]), value(c)).otherwise(zero))

    def n(c):
        return c["n"]

    def fails(m):
        return m.bitwiseAND(bit) != 0

    def gone(m):
        return m.bitwiseAND(before) != 0

    orders = 120
    alone = F.aggregate("_c", zero, lambda acc, c: acc + F.when(fails(c["bits"]), c["n"] * orders / F.bit_count(c["bits"])).otherwise(zero).cast("long"))
    return s.select(
        "part", "filter_order", "step",
        total(n, lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total(n, lambda m: fails(m) & ~gone(m)).alias("removed"),
        total(n, lambda m: fails(m) & gone(m)).alias("redundant"),
        total(n, lambda m: m == bit).alias("unique_fails"),
        total(lambda c: c["good"], lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        total(lambda c: c["toxic"], lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        alone.alias("shapley"))
