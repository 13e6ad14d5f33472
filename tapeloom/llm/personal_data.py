"""Personal data in whole texts, in SQL functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for
account numbers, byte range for addresses), and context words shortly before a span
adjust its score. The patterns are the given ones with the backtracking taken out
(possessive quantifiers where nothing that follows could use a shorter match), so a
long run of digits or letters costs one pass.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points before a span in which context words count.
CONTEXT = 40
# Score from which a proposal of an added kind is a span; base kinds always are.
ACCEPT = 0.6
BOOST = 0.35
_BLOCK = 128


class Kind(NamedTuple):
    name: str
    pattern: str
    score: float
    context: str
    base: bool


_LOCAL = "A-Za-z0-9._%+-"
# The kinds in their order, their patterns and the context words of four languages.
KINDS = [
    Kind("email", f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", 0.9,
         "mail|correo|courriel|kontakt|contact", True),
    Kind("ip", "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}", 0.6, "ip|address|host|server|adresse|servidor|serveur", True),
    Kind("card", "[0-9](?:[\\x20-]?[0-9])++", 0.9, "card|visa|credit|karte|tarjeta|carte", True),
    Kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|fax|mobile|telefon|llame|appel", True),
    Kind("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8,
         "iban|account|bank|konto|cuenta|compte", False),
    Kind("national_id", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4,
         "ssn|social|security|tax|passport|steuer|seguro|fiscal", False),
    Kind("secret", "(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+", 0.3, "token|secret|key|password|passwd|pwd|clave", False),
]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        v = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks has remainder 1 (letters count as 10 to 35)."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    """Checksum and range checks of one match."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(f"^{part}(?:\\.{part}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 13) & (n <= 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        n = F.length(_digits(m))
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        a = F.regexp_replace(m, "\\x20", "")
        return F.when((F.length(a) >= 15) & (F.length(a) <= 34), mod97(a)).otherwise(F.lit(False))
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _last(a: Column, otherwise: int) -> Column:
    return F.coalesce(F.get(a, F.size(a) - 1), F.lit(otherwise))


def running(lengths: Column) -> Column:
    """Inclusive running sums of an int array, in blocks so that a long array isn't copied for every entry."""
    none = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    inner = F.transform(blocks, lambda x: F.aggregate(x, none, lambda acc, v: F.concat(acc, F.array(_last(acc, 0) + v))))
    carry = F.aggregate(F.transform(inner, lambda x: _last(x, 0)), F.array(F.lit(0)),
                        lambda acc, v: F.concat(acc, F.array(_last(acc, 0) + v)))
    return F.flatten(F.zip_with(inner, F.slice(carry, F.lit(1), F.size(inner)), lambda x, c: F.transform(x, lambda v: v + c)))


SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _spans(kind: Kind, text: Column, matches: Column) -> Column:
    """Confirmed spans of one kind, in code points, from the matches and the gaps between them."""
    gaps = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches,
                       lambda g, m: F.struct(F.char_length(g).alias("g"), F.char_length(m).alias("m"), m.alias("s")))
    ends = running(F.transform(pairs, lambda p: p["g"] + p["m"]))
    placed = F.zip_with(pairs, ends, lambda p, e: F.struct((e - p["m"]).alias("a"), e.alias("b"), p["s"].alias("s")))
    right = F.filter(placed, lambda p: confirmed(kind.name, p["s"]))

    def scored(p: Column) -> Column:
        from_ = F.greatest(p["a"] - CONTEXT, F.lit(0))
        near = F.lower(F.substring(text, from_ + 1, p["a"] - from_))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(f"(?:{kind.context})"), F.lit(BOOST)).otherwise(F.lit(0.0)))
        return F.struct(F.lit(kind.name).alias("kind"), p["a"].alias("start"), p["b"].alias("end"), score.alias("score"))

    out = F.transform(right, scored)
    return out if kind.base else F.filter(out, lambda s: s["score"] >= ACCEPT)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add _base and _spans: arrays of (kind, start, end, score), by kind and then start.

    A null text counts as empty and has no spans; every row stands for itself.
    """
    none = F.array().cast(f"array<{SPAN}>")
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({f"_m_{k.name}": F.regexp_extract_all("_text", F.lit(k.pattern), F.lit(0)) for k in KINDS})
    out = out.withColumns({
        f"_s_{k.name}": F.when(F.size(f"_m_{k.name}") > 0, _spans(k, F.col("_text"), F.col(f"_m_{k.name}"))).otherwise(none)
        for k in KINDS})
    out = out.withColumn("_base", F.concat(*[F.col(f"_s_{k.name}") for k in KINDS if k.base]))
    out = out.withColumn("_spans", F.concat("_base", *[F.col(f"_s_{k.name}") for k in KINDS if not k.base]))
    return out.drop(*[f"_{p}_{k.name}" for p in "ms" for k in KINDS])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(
        s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every row; scores in the order of the spans."""
    found = find(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k.name) for k in KINDS if k.base], F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
        F.array_join(F.transform("_spans", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"))


def _masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("z"), s["kind"].alias("k"))))
    start = F.struct(F.lit("").alias("out"), text.alias("rest"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["z"]
        fresh = s["a"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(acc["rest"], F.lit(1), s["a"] - acc["at"]),
                                     F.lit("["), F.upper(s["k"]), F.lit("]"))).otherwise(acc["out"])
        rest = F.when(end > acc["at"], F.substring(acc["rest"], end - acc["at"] + 1, F.char_length(acc["rest"]))).otherwise(acc["rest"])
        return F.struct(out.alias("out"), rest.alias("rest"), F.greatest(end, acc["at"]).alias("at"))

    return F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], acc["rest"]))


def mask(docs: DataFrame) -> DataFrame:
    """Every row with its text masked; a null text stays null, other columns stay as they are."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    found = find(held).withColumn("_new", F.when(F.size("_spans") > 0, _masked(F.col("_text"), F.col("_spans"))).otherwise(F.col("text")))
    return found.select(*[F.col("_new").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in names])
