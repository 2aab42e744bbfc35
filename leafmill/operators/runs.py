"""Runs: the stretches of one format that paragraphs consist of. Replacing across runs, Markdown and HTML of runs and tables, and
tracked changes as a tree of numbered nodes.

Runs have doc, block (a paragraph's number in its document), run (its number in the paragraph), style (of the paragraph), text,
bold, italic, underline, strike and link; table, row and cell are null outside of tables. One paragraph, and one table, are one row
at a time; documents are put together from these."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape

FORMAT = ("bold", "italic", "underline", "strike", "link")


def _true(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


# ---- replacing -------------------------------------------------------------------------------------------------------


def _between(text: Column, needle: str, case_sensitive: bool) -> tuple[Column, Column]:
    """What stands between the occurrences of needle, from the left and without overlap, and how long each occurrence is."""
    pattern = ("" if case_sensitive else "(?iu)") + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", needle)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.split(text, pattern, -1), F.transform(found, F.length)


def _sums(sizes: Column) -> Column:
    """0 and the running sums of an array of numbers."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))


def _replaced(runs: Column, needle: str, new: str, case_sensitive: bool) -> Column:
    """An array of runs (n, text) after one replacement. An occurrence goes to the run where it begins, whole; what the other
    runs have of it goes."""
    whole = F.array_join(F.transform(runs, lambda r: r["text"]), "")
    kept, long = _between(whole, needle, case_sensitive)
    # a piece k of kept text begins after the k pieces and k occurrences before it
    begins = F.zip_with(_sums(F.transform(kept, F.length)), _sums(long), lambda a, b: a + b)
    pieces = F.zip_with(kept, F.slice(begins, F.lit(1), F.size(kept)), lambda t, a: F.struct(a.alias("a"), (a + F.length(t)).alias("z"), t.alias("t")))
    ends = _sums(F.transform(runs, lambda r: F.length(r["text"])))

    def of_run(pieces_: Column, last: Column, a: Column, z: Column) -> Column:
        def part(p: Column, k: Column) -> Column:
            own = F.substring(p["t"], F.greatest(a - p["a"], F.lit(0)) + 1, F.greatest(F.least(z, p["z"]) - F.greatest(a, p["a"]), F.lit(0)))
            return F.concat(own, F.when((k < last) & (a <= p["z"]) & (p["z"] < z), new).otherwise(""))

        return F.array_join(F.transform(pieces_, part), "")

    held = F.struct(pieces.alias("pieces"), (F.size(kept) - 1).alias("last"), ends.alias("ends"))
    done = F.transform(F.array(held), lambda h: F.transform(runs, lambda r, i: F.struct(r["n"].alias("n"), of_run(h["pieces"], h["last"], F.get(h["ends"], i), F.get(h["ends"], i + 1)).alias("text"))))
    return F.get(done, F.lit(0))


def replace_runs(runs: DataFrame, replacements: Mapping[str, str], case_sensitive: bool = True) -> DataFrame:
    """Runs after each needle, in turn, is replaced in its paragraph's whole text, wherever runs begin and end in it. A
    replacement has the format of the run where the needle begins; runs that nothing is left of stay, empty. A needle that a
    replacement gives anew isn't replaced again by the same one. Empty needles are skipped; null texts are empty if their
    paragraph has a replacement at all, and stay otherwise. No needle at all is an error."""
    if not replacements:
        raise ValueError("nothing to replace")
    text = F.coalesce("text", F.lit(""))
    given = F.array_sort(F.collect_list(F.struct(F.col("run").alias("n"), text.alias("text"))))
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = runs.repartition(parts, "doc", "block").groupBy("doc", "block").agg(given.alias("__was"))  # no task collects before runs are dealt
    new = F.col("__was")
    for i, (needle, to) in enumerate((k, v) for k, v in replacements.items() if k):
        p = p.withColumn(f"__now{i}", _replaced(new, needle, to, case_sensitive))
        new = F.col(f"__now{i}")
    changed = p.filter(new != F.col("__was")).select("doc", "block", F.explode(new).alias("__r")).select(F.col("doc").alias("__doc"), F.col("block").alias("__block"), F.col("__r.n").alias("__run"), F.col("__r.text").alias("__text"))
    on = runs["doc"].eqNullSafe(F.col("__doc")) & runs["block"].eqNullSafe(F.col("__block")) & runs["run"].eqNullSafe(F.col("__run"))
    columns = [F.coalesce("__text", "text").alias("text") if c == "text" else F.col(c) for c in runs.columns]
    return runs.join(changed, on, "left").select(*columns)


# ---- markup ----------------------------------------------------------------------------------------------------------


def _wrapped(x: Column, when: Column, before: str, after: str) -> Column:
    return F.when(when, F.concat(F.lit(before), x, F.lit(after))).otherwise(x)


def markdown_run() -> Column:
    """A run's text with its marks escaped, between those of its format and within its link; an empty run is nothing."""
    x = F.regexp_replace(F.coalesce("text", F.lit("")), r"([\\*_])", r"\\$1")
    bold, italic = _true(F.col("bold")), _true(F.col("italic"))
    x = F.when(bold & italic, F.concat(F.lit("***"), x, F.lit("***"))).when(bold, F.concat(F.lit("**"), x, F.lit("**"))).when(italic, F.concat(F.lit("*"), x, F.lit("*"))).otherwise(x)
    x = _wrapped(x, _true(F.col("strike")), "~~", "~~")
    x = F.when(F.coalesce("link", F.lit("")) != "", F.concat(F.lit("["), x, F.lit("]("), F.regexp_replace("link", r"([()\s])", r"\\$1"), F.lit(")"))).otherwise(x)
    return F.when(F.coalesce("text", F.lit("")) == "", "").otherwise(x)


def html_run() -> Column:
    x = F.replace(html_escape(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit("<br>"))
    for name, tag in (("bold", "strong"), ("italic", "em"), ("underline", "u"), ("strike", "s")):
        x = _wrapped(x, _true(F.col(name)), f"<{tag}>", f"</{tag}>")
    x = F.when(F.coalesce("link", F.lit("")) != "", F.concat(F.lit('<a href="'), html_escape(F.col("link")), F.lit('">'), x, F.lit("</a>"))).otherwise(x)
    return F.when(F.coalesce("text", F.lit("")) == "", "").otherwise(x)


def _level(style: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(style, F.lit(""))), "^heading\\s*([1-6])", 1)


def markdown_paragraph(style: Column, x: Column) -> Column:
    level, low = _level(style), F.lower(F.coalesce(style, F.lit("")))
    head = F.when(level != "", F.concat(F.repeat(F.lit("#"), level.try_cast("int")), F.lit(" "))).when(low.contains("list bullet"), "- ").when(low.contains("list number"), "1. ")
    return F.when(head.isNotNull(), F.rtrim(F.concat(head, x))).otherwise(x)


def html_paragraph(style: Column, x: Column) -> Column:
    level, low = _level(style), F.lower(F.coalesce(style, F.lit("")))
    tag = F.when(level != "", F.concat(F.lit("h"), level)).when(low.contains("list bullet") | low.contains("list number"), "li").otherwise("p")
    return F.concat(F.lit("<"), tag, F.lit(">"), x, F.lit("</"), tag, F.lit(">"))


def _in_order(order: list[str], value: str) -> Column:
    """The values of a group in order, nulls first, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda s: s["__v"])


def _documents(runs: DataFrame, piece: Column, paragraph, cell_text, cell_parts: str, table, between: str) -> DataFrame:
    runs = runs.withColumn("__piece", piece).withColumn("__plain", F.coalesce("text", F.lit("")))
    p = runs.groupBy("doc", "block", "table", "row", "cell").agg(F.min("style").alias("style"), F.array_join(_in_order(["run"], "__piece"), "").alias("marked"), F.array_join(_in_order(["run"], "__plain"), "").alias("plain"))
    outside = p.filter("table is null").select("doc", "block", paragraph(F.col("style"), F.col("marked")).alias("__line"))
    inside = p.filter("table is not null").withColumn("__inner", cell_text)
    cells = inside.groupBy("doc", "table", "row", "cell").agg(F.array_join(_in_order(["block"], "__inner"), cell_parts).alias("__cell"), F.min("block").alias("block"))
    rows = cells.groupBy("doc", "table", "row").agg(_in_order(["cell"], "__cell").alias("__row"), F.min("block").alias("block"))
    tables = rows.groupBy("doc", "table").agg(_in_order(["row"], "__row").alias("__rows"), F.min("block").alias("block")).select("doc", "block", table(F.col("__rows")).alias("__line"))
    return outside.unionByName(tables).groupBy("doc").agg(F.array_join(_in_order(["block"], "__line"), between).alias("text"))


def _table_markdown(rows: Column) -> Column:
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)), "\n")


def _table_html(rows: Column) -> Column:
    def row(r: Column, i: Column) -> Column:
        tag = F.when(i == 0, "th").otherwise("td")
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<"), tag, F.lit(">"), c, F.lit("</"), tag, F.lit(">"))), ""), F.lit("</tr>"))

    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))


def runs_markdown(runs: DataFrame) -> DataFrame:
    """doc and text: each document's Markdown, paragraphs and tables in the order of blocks with an empty line between. Tables
    have plain cells, pipes escaped and line ends as <br>, and shorter rows filled up. Null texts are empty, null formats none;
    runs of one number are in order of their texts."""
    cell = F.replace(F.replace(F.col("plain"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    return _documents(runs, markdown_run(), markdown_paragraph, cell, "<br>", _table_markdown, "\n\n")


def runs_html(runs: DataFrame) -> DataFrame:
    """doc and text: each document's HTML, paragraphs and tables in the order of blocks, a line each. Cells have their
    paragraphs; those of a table's first row are heads."""
    return _documents(runs, html_run(), html_paragraph, html_paragraph(F.col("style"), F.col("marked")), "", _table_html, "\n")


# ---- tracked changes ---------------------------------------------------------------------------------------------------

#: What wraps new text, and what wraps old text.
NEW, OLD = ("insert", "move_to"), ("delete", "move_from")
#: Nodes that only mark a place or a range.
MARKERS = ("marker", "comment")


def apply_revisions(nodes: DataFrame, mode: str) -> DataFrame:
    """The nodes that stay, with format as it is then, after all changes are accepted or rejected.

    nodes are numbered as a tree is walked: doc, enter, leave (greater than those of all nodes within), kind, text, format, mark
    and parent (the enter of the node that a "format" node belongs to, whose format is the one before the change). Kinds in NEW
    and OLD wrap text: one goes with all that it holds, however nested, the other only lets go of it. Markers always go. Numbers
    of one document differ; a node without any is in no wrapper. Intervals nest, so a node is within a wrapper that goes if one
    before it ends after it: a running maximum tells."""
    if mode not in ("accept", "reject"):
        raise ValueError(mode)
    gone = OLD if mode == "accept" else NEW
    before = Window.partitionBy("doc").orderBy("enter").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("kind").isin(*gone), F.col("leave"))).over(before)
    kind = F.coalesce("kind", F.lit(""))
    kept = nodes.withColumn("__reach", reach).filter(F.coalesce(F.col("__reach") < F.col("enter"), F.lit(True)) & ~kind.isin(*NEW, *OLD, *MARKERS)).drop("__reach")
    if mode == "reject":
        old = kept.filter(kind == "format").groupBy(F.col("doc").alias("__doc"), F.col("parent").alias("__of")).agg(F.min_by("format", "enter").alias("__format"), F.lit(True).alias("__changed"))
        joined = kept.join(old, (F.col("doc") == F.col("__doc")) & (F.col("enter") == F.col("__of")), "left")
        kept = joined.select(*(F.when(F.col("__changed"), F.col("__format")).otherwise(F.col(c)).alias(c) if c == "format" else F.col(c) for c in nodes.columns))
    return kept.filter(kind != "format")


def revised_text(nodes: DataFrame, mode: str) -> DataFrame:
    """doc, paragraph (1, 2, ...), text: the text nodes that stay. A paragraph whose mark goes (mark is in OLD and changes are
    accepted, or in NEW and they are rejected) runs on into the next one. Paragraphs without text stay, empty; text outside of
    any paragraph is left out."""
    gone = OLD if mode == "accept" else NEW
    by = Window.partitionBy("doc").orderBy("enter")
    kept = apply_revisions(nodes, mode)
    begins = F.col("kind") == "paragraph"
    last = F.last(F.when(begins, F.coalesce("mark", F.lit("")).isin(*gone)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("__runs_on", F.coalesce(last, F.lit(False)))
    kept = kept.withColumn("paragraph", F.sum(F.when(begins & ~F.col("__runs_on"), 1).otherwise(0)).over(by))
    own = F.when(F.col("kind") == "text", F.struct("enter", F.coalesce("text", F.lit("")).alias("t")))
    return kept.filter("paragraph > 0").groupBy("doc", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda s: s["t"]), "").alias("text"))
