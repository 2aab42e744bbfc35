"""Personal data by regular expressions, checksums and context, in built-in functions only.

Expressions propose spans, kind by kind; checks confirm them (parts of an address at most 255, Luhn, digits of a phone
number, modulo 97 for IBAN); words nearby raise the score. The kinds of BASE stand on their check alone. The kinds added
(iban, ssn) are reported from a score of ACCEPT on: an IBAN has that by its checksum, a national number needs a word.

Positions come from marking: matches are enclosed in a private-use character that the text is cleared of first (by another
one, so that no position moves), and running lengths of the pieces between marks are the offsets, in code points.

Nulls and odd input: a null text is empty and has no spans; long texts are never cut; loops over digits are bounded or
possessive, so that no text makes the matcher recurse deeply. Repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_names, table

MARK, PLAIN = "\ue000", "\ue001"
ACCEPT = 0.7
#: Code points on either side in which context words count, and what one adds to the score.
NEAR, BONUS = 48, 0.25

# Each expression finds the same spans as the stated one. Where the stated one repeats a group without end,
# the run's limits are tested instead: its matches are whole runs, and only those of 13 to 19 digits can be cards.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
SCORES = {"email": 0.75, "ip": 0.7, "card": 0.7, "phone": 0.7, "iban": 0.75, "ssn": 0.5}
CONTEXT = {
    "email": "mail|contact|write|kontakt|courriel|correo",
    "ip": "address|server|host|login|adresse",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|anruf",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|taxpayer",
}


def _cheap(kind: str, t: Column) -> Column:
    """A quick test that no text with a span of this kind fails."""
    if kind == "email":
        return F.contains(t, F.lit("@"))
    if kind == "phone":
        return F.contains(t, F.lit("+"))
    return t.rlike({"ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}[kind])


def _mod97(s: Column) -> Column:
    """The remainder of an IBAN by 97, digit by digit after the first four characters went to the end."""
    moved = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        n = F.ascii(c) - F.when(c <= F.lit("9"), 48).otherwise(55)
        return F.pmod(acc * F.when(n > 9, 100).otherwise(10) + n, F.lit(97))

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(F.regexp_replace(m, r"(?<![0-9])0+(?=[0-9])", ""), r"\."), lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        bare = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(bare).between(15, 34) & (_mod97(bare) == 1)
    if kind == "ssn":
        return ~F.substring(digits, 1, 3).isin("000", "666") & (F.substring(digits, 1, 1) != "9") & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000")
    return F.lit(True)


_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one; in two levels, so that many pieces don't take their square in time."""
    starts = F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(_BLOCK))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = F.transform(starts, lambda s: total(F.slice(lengths, s + 1, F.lit(_BLOCK))))

    def inner(s: Column, i: Column) -> Column:
        block = F.slice(lengths, s + 1, F.lit(_BLOCK))
        before = total(F.slice(sums, F.lit(1), i))
        return F.transform(block, lambda _, j: before + total(F.slice(block, F.lit(1), j)))

    return F.flatten(F.transform(starts, inner))


def spans(text: Column, kind: str) -> Column:
    """An array of (kind, start, end, score) of the confirmed spans of one kind, by start; text must not be null."""
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK, -1)
    at = _running(F.transform(parts, F.length))
    found = F.filter(F.arrays_zip(parts.alias("m"), at.alias("s")), lambda _, i: F.pmod(i, F.lit(2)) == 1)

    def scored(x: Column) -> Column:
        m, s = x["m"], x["s"]
        near = F.lower(F.concat(F.substring(text, F.greatest(s - NEAR, F.lit(0)) + 1, F.least(s, F.lit(NEAR))), F.lit(" "), F.substring(text, s + F.length(m) + 1, F.lit(NEAR))))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})"), F.lit(BONUS)).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s.cast("long").alias("start"), (s + F.length(m)).cast("long").alias("end"), score.alias("score"))

    good = F.transform(F.filter(found, lambda x: _confirmed(kind, x["m"])), scored)
    good = good if kind in BASE else F.filter(good, lambda x: x["score"] >= ACCEPT)
    return F.when(_cheap(kind, text), good).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column of spans for each kind, __<kind>, in place of any of that name; others stay and may have any names."""
    mine = {f"__{k}" for k in PATTERNS}
    cols = docs.columns
    plain, (own,) = plain_names(docs, text)
    t = plain.withColumn("cleared", F.translate(F.coalesce(F.col(own), F.lit("")), MARK, PLAIN))
    t = t.withColumns({f"__{k}": spans(F.col("cleared"), k) for k in PATTERNS})
    return t.select(*(F.col(c).alias(n) for c, n in zip(plain.columns, cols) if n not in mine), *(f"__{k}" for k in PATTERNS))


def joined(*columns: Column) -> Column:
    return F.array_join(F.transform(F.concat(*columns), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all spans of all kinds replaced by <KIND>; where spans overlap, the whole stretch by the first one's. A null
    text stays null; columns may have any names."""
    cols = docs.columns
    docs, (text,) = plain_names(docs, text)
    found = find(docs, text)
    everything = F.array_sort(F.transform(F.concat(*(F.col(f"__{k}") for k in PATTERNS)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substring(F.col(text), acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        inside = x["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(new).alias("out"))

    done = F.aggregate(everything, state, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"].cast("int") + 1, F.length(text))))
    return found.withColumn(text, done).drop(*(f"__{k}" for k in PATTERNS)).toDF(*cols)


def op8(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = {k: F.col(f"__{k}") for k in PATTERNS}
    every = F.concat(*kinds.values())
    return found.select(
        "doc_id",
        *(F.size(kinds[k]).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(*(kinds[k] for k in BASE)), 256).alias("base_sha256"),
        joined(*kinds.values()).alias("spans"),
        F.array_join(F.transform(every, lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )
