"""Text that the end of a page cut in two: words whose halves stand on neighbouring pages, and the last words of a sentence alone
on the next page. Neighbours meet by their number in one order of all pages, so no task holds a document; whether a word is one is
asked of the words of its own document, a relation of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_furniture
from .ranks import checkpoints, numbered

# A sentence's last words: most characters and words; what stands before them: fewest characters and words.
TAIL = {"characters": 48, "words": 4}
BEFORE = {"characters": 24, "words": 4}
FURNITURE = 180
ENGLISH = "[A-Za-z]+(?:['’-][A-Za-z]+)*"
SENTENCE_END = f"^(?=[a-z]){ENGLISH}(?:\\s+{ENGLISH}){{0,{TAIL['words'] - 1}}}[.!?][\"'’”)\\]]?$"
HYPHEN = "[-‐­]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def _edges(pages: DataFrame) -> DataFrame:
    """Adds lines, and first and last: number and text of the first and last line that is neither blank nor page furniture."""
    every = F.split(F.coalesce("text", F.lit("")), "\n")
    shown = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), strip(x).alias("x"))), lambda s: (s["x"] != "") & ~((F.length(s["x"]) <= FURNITURE) & page_furniture(s["x"])))
    p = pages.withColumn("lines", every).withColumn("__shown", shown)
    return p.withColumn("first", F.get("__shown", F.lit(0))).withColumn("last", F.when(F.size("__shown") > 0, F.get("__shown", F.size("__shown") - 1))).withColumn("only", F.size("__shown") == 1).drop("__shown")


def _counted(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, word, n: how often the wanted words of a document stand in it."""
    words = pages.select("doc", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0))).alias("word"))
    return words.join(wanted.distinct(), ["doc", "word"], "left_semi").groupBy("doc", "word").agg(F.count("*").alias("n"))


def _cuts(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """n, kind, taken, whole_line: what page n takes from the page after it, and whether that is the whole first line there."""
    ends = edges.select("n", "doc", F.col("last.x").alias("end"))
    begins = edges.select((F.col("n") - 1).alias("n"), F.col("doc").alias("__doc"), F.col("first.x").alias("begin"))
    met = ends.join(begins, "n").filter((F.col("doc") == F.col("__doc")) & F.col("end").isNotNull() & F.col("begin").isNotNull()).drop("__doc")
    met = met.withColumn("tail", F.regexp_extract("end", f"(\\p{{L}}+){HYPHEN}?$", 1)).withColumn("head", F.regexp_extract("begin", "^(\\p{Ll}\\p{L}*)", 1))
    halves = (F.col("tail") != "") & (F.col("head") != "")
    met = met.withColumn("whole", F.when(halves, F.lower(F.concat("tail", "head")))).withColumn("half", F.when(halves, F.lower("tail")))
    wanted = met.filter(halves).select("doc", F.explode(F.array("whole", "half")).alias("word"))
    counts = _counted(pages, wanted)
    of = lambda name: counts.select(F.col("doc").alias(f"__d_{name}"), F.col("word").alias(f"__w_{name}"), F.col("n").alias(f"n_{name}"))
    for name in ("whole", "half"):
        c = of(name)
        met = met.join(c, (F.col("doc") == F.col(f"__d_{name}")) & (F.col(name) == F.col(f"__w_{name}")), "left")
    word = (F.coalesce("n_whole", F.lit(0)) > 0) & (F.col("end").rlike(f"{HYPHEN}$") | (F.coalesce("n_half", F.lit(0)) <= 1))
    words = lambda c: F.regexp_count(c, F.lit(ENGLISH))
    sentence = (F.length("end") >= BEFORE["characters"]) & (words("end") >= BEFORE["words"]) & F.col("end").rlike("[A-Za-z]$")
    sentence &= (F.length("begin") <= TAIL["characters"]) & words("begin").between(1, TAIL["words"]) & F.col("begin").rlike(SENTENCE_END)
    kind = F.when(word, "word").when(sentence, "sentence")
    return met.withColumn("kind", kind).filter("kind is not null").select("n", "kind", F.when(F.col("kind") == "word", F.col("head")).otherwise(F.col("begin")).alias("taken"), ((F.col("kind") == "sentence") | (F.col("head") == F.col("begin"))).alias("whole_line"))


def join_fragments(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """doc, page, text, kind and taken: the pages with each cut word or sentence whole on the page where it begins.

    A page ends and begins with its first and last lines that aren't blank or page furniture. Letters at the end and small
    letters at the beginning of the next page are one word (kind "word") if the document has that word somewhere, and if
    there is a hyphen or the first half is no other word of the document. Otherwise one to four English words that end a
    sentence, alone on their line, join a line of four words or more that ends in a letter (kind "sentence"). All is judged by
    the pages as they were; a page whose only line goes to the page before takes nothing itself. Pages without a document, and
    null texts, join nothing and stay as they are; pages of one number are in order of their texts."""
    t = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(text).alias("text"))
    checkpoints(pages.sparkSession)
    every = numbered(t, [F.col("doc"), F.col("page"), F.col("text")], "n")
    e = _edges(every)
    ends = e.select("n", "doc", "first", "last", "only").checkpoint()  # many steps ask for them
    cuts = _cuts(ends, every).checkpoint()
    given = cuts.select((F.col("n") + 1).alias("n"), F.col("whole_line").alias("all_given"))
    blocked = ends.select("n", "only").join(given, "n").filter("only and all_given").select("n")
    cuts = cuts.join(blocked, "n", "left_anti")
    loses = cuts.select((F.col("n") + 1).alias("n"), F.col("taken").alias("gone"))
    p = e.join(cuts.select("n", "kind", "taken"), "n", "left").join(loses, "n", "left")
    rest = lambda x: F.regexp_replace(F.substring(strip(x), F.length("gone") + 1, F.length(x)), "^\\s+", "")
    end = lambda x: F.regexp_replace(x, "\\s+$", "")
    grown = lambda x: F.when(F.col("kind") == "word", F.concat(F.regexp_replace(end(x), f"{HYPHEN}$", ""), "taken")).otherwise(F.concat_ws(" ", end(x), "taken"))
    lost = lambda i: F.col("gone").isNotNull() & (i == F.col("first.i"))
    after = lambda x, i: F.when(lost(i), rest(x)).otherwise(x)
    line = lambda x, i: F.struct((lost(i) & (after(x, i) == "")).alias("empty"), F.when(F.col("kind").isNotNull() & (i == F.col("last.i")), grown(after(x, i))).otherwise(after(x, i)).alias("x"))
    new = F.array_join(F.transform(F.filter(F.transform("lines", line), lambda s: ~s["empty"]), lambda s: s["x"]), "\n")
    changed = F.col("kind").isNotNull() | F.col("gone").isNotNull()
    return p.select(F.col("doc").alias(doc), F.col("page").alias(page), F.when(changed, new).otherwise(F.col("text")).alias(text), "kind", "taken")


