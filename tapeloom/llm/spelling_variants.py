"""Spelling variants: words one edit apart, found by asymmetric chunks, and the frequent form of each.

A word is cut into two chunks. One inserted, deleted or replaced code point leaves one of
them whole: the first where it was, the second moved by the difference in length, which is
none or one. So a word and one as long or one longer are compared only if a chunk of the
first is a gram of the second at such a place; grams elsewhere can meet no chunk. Where too
many words share a chunk, the rest of the word is cut in two again and a chunk of it joins
the key, so that no group of words is ever paired off as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage

# Pairs of one key at most; keys with more are cut further.
PAIRS = 4_096
# A key with this many rows and this share of all rows is marked by a (then short) broadcast list instead of a join.
HOT_ROWS, HOT_SHARE = 5_000, 0.001


def noisy_words(docs: DataFrame) -> DataFrame:
    """(word): every run of letters (A-Z, a-z, U+00C0..U+00FF) of every text, A-Z in lower case.

    Where 97 divides the crc32 h of ``<doc_id>:<run>``, code point h % length is left out. A null
    text has no runs; a null id counts as an empty one.
    """
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
                       F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    return runs.withColumn("_h", h).select(F.when(F.col("_h") % 97 == 0, cut).otherwise(F.col("_run")).alias("word"))


def vocabulary(docs: DataFrame, letters: int = 5, times: int = 3) -> DataFrame:
    """(word, n): words of at least ``letters`` code points found at least ``times`` times."""
    return noisy_words(docs).filter(F.char_length("word") >= letters).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the key of what they keep: all but the code points _lo.._hi of a word of _size code points."""
    length, kept = F.char_length("word"), F.col("_size") - F.col("_hi")
    head = F.substring("word", F.lit(1), F.col("_lo"))
    tail = F.substring("word", length - kept + 1, kept)
    return rows.withColumn("_key", F.xxhash64("_size", "_lo", "_hi", head, tail))


def _halves(lo: Column, hi: Column) -> list[tuple[Column, Column]]:
    mid = F.floor((lo + hi) / 2).cast("int")
    return [(lo, mid), (mid, hi)]


def _first_rows(words: DataFrame) -> DataFrame:
    """The two chunks of every word, and its grams for the chunks of words one shorter (_longer)."""
    size = F.char_length("word")
    parts = [F.struct(s.cast("int").alias("_size"), a.cast("int").alias("_lo"), b.cast("int").alias("_hi"), F.lit(longer).alias("_longer"))
             for s, longer in ((size, False), (size - 1, True)) for a, b in _halves(F.lit(0), s)]
    return words.select("word", "n", F.explode(F.array(*parts)).alias("_p")).select("word", "n", "_p.*")


def _cut_again(rows: DataFrame) -> DataFrame:
    """The same words with what their key left out cut in two, one half kept in turn."""
    parts = [F.struct(a.alias("_lo"), b.alias("_hi")) for a, b in _halves(F.col("_lo"), F.col("_hi"))]
    return rows.select("word", "n", "_size", "_longer", F.explode(F.array(*parts)).alias("_p")).select(
        "word", "n", "_size", "_p._lo", "_p._hi", "_longer")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): every unordered pair of words that differ by exactly one code point, once."""
    rows = cut_lineage(_keyed(_first_rows(words)))
    found = None
    while True:
        base = F.count_if(~F.col("_longer"))
        more = F.count_if(F.col("_longer"))
        g = rows.groupBy("_key").agg(base.alias("_b"), more.alias("_l"), F.max(F.col("_hi") - F.col("_lo")).alias("_open"))
        pairs = F.col("_b") * (F.col("_b") - 1) / 2 + F.col("_b") * F.col("_l")
        g = cut_lineage(g.filter(pairs > 0).withColumn("_split", (pairs > PAIRS) & (F.col("_open") > 1)))
        total = rows.count()
        hot = g.filter(F.col("_split") & (F.col("_b") + F.col("_l") >= HOT_ROWS) & (F.col("_b") + F.col("_l") > HOT_SHARE * total)).select("_key")
        # Fewer than 1 / HOT_SHARE keys.
        rest = rows.join(F.broadcast(hot), "_key", "left_anti").join(g.select("_key", "_split"), "_key")
        many = rows.join(F.broadcast(hot), "_key", "left_semi")
        rest = cut_lineage(rest)
        few = rest.filter(~F.col("_split"))
        a, b = few.filter(~F.col("_longer")).alias("a"), few.alias("b")
        met = a.join(b, (F.col("a._key") == F.col("b._key")) & (F.col("b._longer") | (F.col("a.word") < F.col("b.word")))).filter(
            F.levenshtein("a.word", "b.word", 1) == 1).select(
            F.col("a.word").alias("a"), F.col("a.n").alias("an"), F.col("b.word").alias("b"), F.col("b.n").alias("bn"))
        found = met if found is None else found.unionByName(met)
        rows = many.unionByName(rest.filter("_split").select(many.columns))
        rows = cut_lineage(_keyed(_cut_again(rows)))
        if rows.isEmpty():
            # An edit between two chunks leaves both whole.
            return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: where following forms ends.

    Pointers double each round; a form is twice as frequent as its word, so chains are short.
    """
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        a, b = now.alias("a"), now.alias("b")
        step = cut_lineage(a.join(b, F.col("a.root") == F.col("b.word"), "left").select(
            F.col("a.word").alias("word"), F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("_moved")))
        now = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return now


def variants(docs: DataFrame, letters: int = 5, times: int = 3) -> DataFrame:
    """word, n, n_near, form, form_n and root of the whole vocabulary of ``docs``.

    The form is the near word of largest n (ties: least in code-point order), if it is at
    least twice as frequent as the word, else null. No words, no rows.
    """
    words = cut_lineage(vocabulary(docs, letters, times))
    p = near_pairs(words)
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    best = F.min_by(F.struct(F.col("b").alias("form"), F.col("bn").alias("form_n")), F.struct(-F.col("bn"), F.col("b")))
    near = both.groupBy(F.col("a").alias("word"), F.col("an")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("_f"))
    follows = F.col("_f.form_n") >= 2 * F.col("an")
    near = cut_lineage(near.select("word", "n_near", F.when(follows, F.col("_f.form")).alias("form"), F.when(follows, F.col("_f.form_n")).alias("form_n")))
    ends = roots(near.filter("form IS NOT NULL"))
    return words.join(near, "word", "left").join(ends, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
