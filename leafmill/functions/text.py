"""Text: escaping, normal forms, grams and how much of one text another one holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def html_escape(x: Column, quotes: bool = True) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def markdown_escape(x: Column) -> Column:
    """Backslash, asterisk and underscore with a backslash before."""
    for c in ("\\", "*", "_"):
        x = F.replace(x, F.lit(c), F.lit("\\" + c))
    return x


def markdown_cell(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


@F.pandas_udf(T.StringType())
def casefold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode case folding, which no built-in does."""
    for s in batches:
        yield s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def integrity_form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC without white space and format characters, which no built-in does."""
    import unicodedata

    def one(x: str | None) -> str | None:
        return None if x is None else "".join(c for c in unicodedata.normalize("NFKC", x) if not c.isspace() and unicodedata.category(c) != "Cf")

    for s in batches:
        yield s.map(one)


def plain_form(x: Column) -> Column:
    """integrity_form for text that is in NFKC already, by built-ins."""
    return F.regexp_replace(x, r"[\s\p{Z}\p{Cf}]", "")


def grams(x: Column, n: int) -> Column:
    """The distinct n-character strings of a text; none if it is shorter."""
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def sequence_coverage(source: Column, output: Column) -> Column:
    """Share of the source's 3-character strings (single characters below 12) that the output has; both in plain form. Null of a null."""
    a = F.when(F.length(source) < 12, grams(source, 1)).otherwise(grams(source, 3))
    b = F.when(F.length(source) < 12, grams(output, 1)).otherwise(grams(output, 3))
    return F.when(F.length(source) == 0, 1.0).when(F.length(output) == 0, 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)))


def english_words(x: Column) -> Column:
    """Words of A-Z in lower case. A word cut by a hyphen at a line's end is joined if the whole word occurs in the text."""
    folded = F.lower(x)
    whole = F.regexp_extract_all(folded, F.lit("[a-z]+"), F.lit(0))
    cut = F.regexp_extract_all(folded, F.lit("[a-z]+-[ \\t]*\\r?\\n[ \\t]*[a-z]+"), F.lit(0))
    known = F.filter(cut, lambda c: F.array_contains(whole, F.regexp_replace(c, "-[ \\t]*\\r?\\n[ \\t]*", "")))
    joined = F.aggregate(known, folded, lambda acc, c: F.replace(acc, c, F.regexp_replace(c, "-[ \\t]*\\r?\\n[ \\t]*", "")))
    return F.regexp_extract_all(F.when(F.size(known) > 0, joined).otherwise(folded), F.lit("[a-z]+"), F.lit(0))


def pairs_of(words: Column) -> Column:
    """Neighbouring words, joined by a space."""
    return F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))


#: Words with inner hyphens and apostrophes or single CJK characters, and hyphens.
MIXED_WORD = "[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*|[\u3400-\u9fff]"
HYPHENS = "[-‐‑]"


def mixed_words(x: Column) -> Column:
    """Words and CJK characters in lower case, after hyphens between letters, and white space after them, are taken out."""
    joined = F.regexp_replace(x, f"(?<=[A-Za-z]){HYPHENS}[\\s\\p{{Z}}]*(?=[A-Za-z])", "")
    return F.transform(F.regexp_extract_all(joined, F.lit(MIXED_WORD), F.lit(0)), F.lower)


#: Characters that some embedded fonts have for a hyphen and an apostrophe.
MISREAD = {"\uff27": "-", "\U001001b3": "'"}


def repaired_words(x: Column) -> Column:
    """A text with MISREAD characters put right inside words: one that touches an ASCII letter on one side and has another,
    maybe after white space, on the other side. All others stay."""
    for wrong, right in MISREAD.items():
        x = F.regexp_replace(x, f"(?<=[A-Za-z]){wrong}(?=[\\s\\p{{Z}}]*[A-Za-z])", right)
        x = F.regexp_replace(x, f"([A-Za-z][\\s\\p{{Z}}]*){wrong}(?=[A-Za-z])", f"$1{right}")
    return x


#: Marks of a link, and the words of a page number.
LINKS = ("http://", "https://", "www.", "doi.org")
PAGE_WORDS = {"page": "page", "before": "第", "after": "页", "all": "共"}


def page_furniture(x: Column) -> Column:
    """Whether a text has a link, a counter (3/10) or an English page number in it, or is but a page number: bare, between
    two dashes, or a Chinese one with or without the number of all pages."""
    w = PAGE_WORDS
    line = F.regexp_replace(x, "^\\s+|\\s+$", "")
    number = lambda most: f"\\d(?:\\s*\\d){{0,{most - 1}}}"
    dash = "[\\p{Pd}−]"
    own, every = (rf"{w[k]}\s*{number(6)}\s*{w['after']}" for k in ("before", "all"))
    whole = [number(4), rf"{dash}\s*{number(4)}\s*{dash}", rf"{own}(?:\s*{every})?", rf"{every}\s*{own}"]
    found = line.rlike("^(?:" + "|".join(whole) + ")$")
    for link in LINKS:
        found |= F.contains(F.lower(x), F.lit(link))
    return found | x.rlike(r"(?<!\S)\d+\s*/\s*\d+(?!\S)") | x.rlike(rf"(?i)\b{w['page']}\s+\d+")


def backed_fragment(fragment: Column, sources: Column) -> Column:
    """Whether a short page's text is of one of the source pages: 12 characters or more, no page furniture, and 0.7 of its
    strings in a source that isn't blank. False for nulls."""
    covered = F.exists(sources, lambda s: (F.trim(s) != "") & (sequence_coverage(plain_form(fragment), plain_form(s)) >= 0.70))
    return F.coalesce((F.length(plain_form(fragment)) >= 12) & ~page_furniture(fragment) & covered, F.lit(False))


def multiset_recall(source: Column, output: Column) -> Column:
    """Sum of the smaller counts over the source's size; 1 for an empty source. Time is that of sorting."""
    return F.when(F.size(source) == 0, 1.0).otherwise(_common(source, output) / F.size(source))


def _common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection: elements get their number among equal ones, and these pairs are distinct."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbered(x: Column) -> Column:
    """Each element with its number among equal ones: runs of the sorted array, written out again."""

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda v, i: F.when((i == 0) | (F.get(s, i - 1) != v), i)), lambda i: i.isNotNull())
        return let(first, lambda p: F.flatten(F.transform(p, lambda at, j: one(s, at, F.coalesce(F.get(p, j + 1), F.size(s)) - at - 1))))

    def one(s: Column, at: Column, last: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.concat_ws("\x01", F.get(s, at), k.cast("string")))

    return let(F.array_sort(x), runs)


def suspicious(x: Column) -> Column:
    """Whether a text has replacement, private-use, surrogate or control characters (but line ends and tabs)."""
    return x.rlike("[\\x{FFFD}\\p{Co}\\p{Cs}]|[\\p{Cc}&&[^\\n\\r\\t]]")


def page_counters(x: Column) -> Column:
    """Distinct (current, total) of counters like 3/10, in order; those beyond their total are none."""
    found = F.regexp_extract_all(x, F.lit("(?<![0-9/])([0-9]{1,5})\\s*/\\s*([0-9]{1,5})(?![0-9/])"), F.lit(0))
    split = F.transform(found, lambda m: F.struct(F.trim(F.get(F.split(m, "/"), F.lit(0))).cast("int").alias("current"), F.trim(F.get(F.split(m, "/"), F.lit(1))).cast("int").alias("total")))
    return F.array_distinct(F.filter(split, lambda p: (p["current"] >= 1) & (p["current"] <= p["total"])))


def cjk_spacing(x: Column) -> Column:
    """Without the spaces between two CJK characters, with one between CJK and Latin letters or digits."""
    han = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}"
    x = F.regexp_replace(x, f"(?<=[{han}])[ \\t]+(?=[{han}])", "")
    return F.regexp_replace(x, f"(?<=[{han}])[ \\t]*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[ \\t]*(?=[{han}])", " ")
