"""Cells of a sheet: values of mixed kinds in one column, with the order, equality and tests that sheets have.

A cell is STRUCT<kind, num, str, iso>. kind: 0 number or boolean (a boolean is 1 or 0), 1 date or time (iso has it),
2 text, 3 blank. Blank text ('') is text here; only tests for blankness treat it like a blank.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = "struct<kind:tinyint,num:double,str:string,iso:string>"
NUMBER, DATE, TEXT, BLANK = range(4)


def _cell(kind: Column, num: Column | None = None, text: Column | None = None, iso: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(kind.cast("tinyint").alias("kind"), (none if num is None else num).cast("double").alias("num"), (none if text is None else text).cast("string").alias("str"), (none if iso is None else iso).cast("string").alias("iso"))


def number_cell(x: Column) -> Column:
    return _cell(F.when(x.isNull(), BLANK).otherwise(NUMBER), num=x)


def text_cell(x: Column) -> Column:
    return _cell(F.when(x.isNull(), BLANK).otherwise(TEXT), text=x)


def date_cell(x: Column) -> Column:
    return _cell(F.when(x.isNull(), BLANK).otherwise(DATE), iso=iso_text(x))


def blank_cell() -> Column:
    return _cell(F.lit(BLANK))


def iso_text(ts: Column) -> Column:
    """ISO text of a timestamp; fractions only if there are any."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, dict[str, str]]:
    """What case folding does to single characters, by Python's rule: characters, what each becomes, and those that become several."""
    one, several = {}, {}
    for i in range(0x80, 0x20000):
        c = chr(i)
        if not 0xD800 <= i < 0xE000 and (f := c.casefold()) != c:
            (one if len(f) == 1 else several)[c] = f
    return "".join(one), "".join(one.values()), several


def fold(x: Column) -> Column:
    """Unicode case folding by built-ins: each character's own folding, so the same as functions.text.casefold."""
    ascii_, (old, new, several) = F.lower(x), _foldings()
    other = F.translate(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), old, new)
    rare = other
    for c, f in several.items():
        rare = F.replace(rare, F.lit(c), F.lit(f))
    return F.when(x.rlike("^[\\x00-\\x7F]*$"), ascii_).when(x.rlike("[" + "".join(several) + "]"), rare).otherwise(other)


def number_text(x: Column) -> Column:
    """A number as text: whole numbers without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def text_of(c: Column) -> Column:
    """str() of a cell, '' for a blank one."""
    return F.when(c["kind"] == NUMBER, number_text(c["num"])).when(c["kind"] == DATE, c["iso"]).when(c["kind"] == TEXT, c["str"]).otherwise("")


def is_blank(c: Column) -> Column:
    return (c["kind"] == BLANK) | ((c["kind"] == TEXT) & (c["str"] == ""))


def sort_key(c: Column, reverse: bool = False) -> list[Column]:
    """Numbers, then dates, then text without regard to case, then blanks; reversed as a whole. Ties are the caller's."""
    return [k.desc() if reverse else k.asc() for k in sort_columns(c)]


def sort_columns(c: Column) -> list[Column]:
    """What sort_key sorts by, one after another."""
    return [c["kind"], F.coalesce(c["num"], F.lit(0.0)), F.coalesce(c["iso"], F.lit("")), F.coalesce(fold(c["str"]), F.lit(""))]


def group_key(c: Column) -> Column:
    """Equal for cells that count as duplicates: 1, 1.0 and true are one; blanks are one; text keeps its case."""
    return F.struct(c["kind"], F.coalesce(c["num"], F.lit(0.0)).alias("n"), F.coalesce(c["str"], F.lit("")).alias("s"), F.coalesce(c["iso"], F.lit("")).alias("i"))


OPERATORS = ("equals", "not_equals", "contains", "not_contains", "starts_with", "ends_with", "greater_than", "greater_equal", "less_than", "less_equal", "is_blank", "not_blank")


def matches(c: Column, operator: str, value: object = None, case_sensitive: bool = False) -> Column:
    """One of OPERATORS of a cell against a literal: equality as of sheets, text tests on str(), order within one kind."""
    if operator == "is_blank":
        return is_blank(c)
    if operator == "not_blank":
        return ~is_blank(c)
    number = float(value) if isinstance(value, (int, float)) else None
    if operator in ("equals", "not_equals"):
        if value is None:
            same = c["kind"] == BLANK
        elif number is not None:
            same = (c["kind"] == NUMBER) & (c["num"] == number)
        else:
            same = (c["kind"] == TEXT) & ((c["str"] == value) if case_sensitive else (fold(c["str"]) == fold(F.lit(value))))
        same = F.coalesce(same, F.lit(False))
        return same if operator == "equals" else ~same
    if operator in ("contains", "not_contains", "starts_with", "ends_with"):
        text, want = text_of(c), F.lit("" if value is None else str(value))
        if not case_sensitive:
            text, want = fold(text), fold(want)
        hit = {"contains": F.contains, "not_contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[operator](text, want)
        return ~hit if operator == "not_contains" else hit
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator}")
    side, kind, want = (c["num"], NUMBER, F.lit(number)) if number is not None else (c["str"], TEXT, F.lit(value))
    test = {"greater_than": side > want, "greater_equal": side >= want, "less_than": side < want, "less_equal": side <= want}[operator]
    return F.coalesce((c["kind"] == kind) & test, F.lit(False))
