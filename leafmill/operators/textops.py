"""Texts of documents: integrity of an output against its source, counters, replacement, merge and markup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import english_words, html_escape, markdown_cell, markdown_escape, multiset_recall, page_counters, pairs_of, plain_form, sequence_coverage

#: Gates: least sequence, word and pair recall, and where a warning ends.
GATES = {"editable": ((0.80, 0.80, 0.70), (0.95, 0.95, 0.90)), "hybrid": ((0.90, 0.90, 0.90), (0.90, 0.90, 0.90)), "high_recall": ((0.90, 0.98, 0.85), (0.90, 0.98, 0.85))}  # fixed values


def integrity(pairs: DataFrame, source: str = "source", output: str = "output") -> DataFrame:
    """Adds coverage, word_recall, pair_recall, char_recall and char_precision of output against source."""
    a, b = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(output), F.lit(""))
    # words and forms are columns of their own, so that they are computed once
    found = pairs.withColumns({"__wa": english_words(a), "__wb": english_words(b), "__na": plain_form(a), "__nb": plain_form(b)})
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    found = found.withColumns({"__ca": chars(F.col("__na")), "__cb": chars(F.col("__nb"))})
    wa, wb, ca, cb = (F.col(c) for c in ("__wa", "__wb", "__ca", "__cb"))
    return found.withColumns({
        "coverage": sequence_coverage(F.col("__na"), F.col("__nb")),
        "word_recall": multiset_recall(wa, wb),
        "pair_recall": F.when(F.size(wa) < 2, 1.0).otherwise(multiset_recall(pairs_of(wa), pairs_of(wb))),
        "char_recall": multiset_recall(ca, cb),
        "char_precision": multiset_recall(cb, ca),
    }).drop("__wa", "__wb", "__na", "__nb", "__ca", "__cb")


def word_recall_by_rows(pairs: DataFrame, key: str, source: str = "source", output: str = "output") -> DataFrame:
    """word_recall for texts of any length: words are rows, counted with partial aggregates, not arrays."""

    def counts(column: str, name: str) -> DataFrame:
        return pairs.select(key, F.explode(english_words(F.coalesce(F.col(column), F.lit("")))).alias("w")).groupBy(key, "w").agg(F.count("*").alias(name))

    both = counts(source, "a").join(counts(output, "b"), [key, "w"], "left")
    got = both.groupBy(key).agg((F.sum(F.least("a", F.coalesce("b", F.lit(0)))) / F.sum("a")).alias("word_recall"))
    return pairs.select(key).join(got, key, "left").select(key, F.coalesce("word_recall", F.lit(1.0)).alias("word_recall"))


def block_pair_recall(blocks: DataFrame, outputs: DataFrame, key: str, text: str = "text", output: str = "output") -> DataFrame:
    """key and pair_recall of outputs (key, output): the share of the neighbouring words within each block (key, text) of
    the source, none across blocks, that the output has as often; 1 without any. Pairs are rows, counted with partial
    aggregates, so a text may be of any length. Nulls are empty texts."""

    def counts(rows: DataFrame, column: str, name: str) -> DataFrame:
        words = rows.select(key, english_words(F.coalesce(F.col(column), F.lit(""))).alias("w"))
        return words.select(key, F.explode(pairs_of(F.col("w"))).alias("w")).groupBy(key, "w").agg(F.count("*").alias(name))

    both = counts(blocks, text, "a").join(counts(outputs, output, "b"), [key, "w"], "left")
    got = both.groupBy(key).agg((F.sum(F.least("a", F.coalesce("b", F.lit(0)))) / F.sum("a")).alias("pair_recall"))
    return outputs.select(key).join(got, key, "left").select(key, F.coalesce("pair_recall", F.lit(1.0)).alias("pair_recall"))


def gate(kind: str) -> Column:
    """pass, warn or fail of the recalls of integrity()."""
    least, fine = GATES[kind]
    names = ("coverage", "word_recall", "pair_recall")
    ok = lambda bounds: (F.col(names[0]) >= bounds[0]) & (F.col(names[1]) >= bounds[1]) & (F.col(names[2]) >= bounds[2])
    return F.when(~ok(least), "fail").when(~ok(fine), "warn").otherwise("pass")


def verdict() -> Column:
    """Pass or fail of a rewrite: words are waived if the characters are nearly all there and in place."""
    near = (F.col("char_recall") >= 0.9995) & (F.col("char_precision") >= 0.9995) & (F.col("coverage") >= 0.995)
    words = (F.col("word_recall") >= 0.985) & (F.col("pair_recall") >= 0.97)
    return (F.col("coverage") >= 0.985) & (F.col("char_recall") >= 0.995) & (near | words)


def boundary_recovery(coverage: Column, compact: Column, source_words: Column, output_words: Column) -> Column:
    """Whether an output restored word boundaries that its source had lost."""
    n, m = F.size(source_words), F.size(output_words)
    return (coverage >= 0.92) & (compact >= 0.98) & (m >= n + 2) & (m >= F.ceil(n * 1.2)) & F.exists(source_words, lambda w: F.length(w) >= 18)


def candidate_quality(pairs: DataFrame, source: str = "source", output: str = "output") -> DataFrame:
    """integrity() with recovered, whether the output only restored lost word boundaries, and text_passed, whether its text is
    good enough to be edited: it is if recovered, or if it does not fail the editable gate. Null texts are empty."""
    words = {"__sw": english_words(F.coalesce(F.col(source), F.lit(""))), "__ow": english_words(F.coalesce(F.col(output), F.lit("")))}
    found = integrity(pairs, source, output).withColumns(words)
    found = found.withColumn("__compact", sequence_coverage(F.array_join("__sw", ""), F.array_join("__ow", "")))
    found = found.withColumn("recovered", boundary_recovery(F.col("coverage"), F.col("__compact"), F.col("__sw"), F.col("__ow")))
    return found.withColumn("text_passed", F.col("recovered") | (gate("editable") != "fail")).drop("__sw", "__ow", "__compact")


def counter_conflicts(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key and total of page counters whose total comes with more than one current page."""
    c = pages.select(key, F.explode(page_counters(F.coalesce(F.col(text), F.lit("")))).alias("c"))
    return c.groupBy(key, F.col("c.total").alias("total")).agg(F.count_distinct("c.current").alias("currents")).filter("currents > 1")


def drop_repeated_counters(paragraphs: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Without the paragraphs that repeat the counter of the one before."""
    own = F.regexp_extract(F.trim(F.col(text)), "^([0-9]{1,5}\\s*/\\s*[0-9]{1,5})$", 1)
    bare = F.regexp_replace(own, "\\s", "")
    last = F.lag("__counter").over(Window.partitionBy(key).orderBy(order))
    p = paragraphs.withColumn("__counter", bare).withColumn("__last", last)
    return p.filter((F.col("__counter") == "") | F.col("__last").isNull() | (F.col("__counter") != F.col("__last"))).drop("__counter", "__last")


def drop_blank_lines(paragraphs: DataFrame, text: str, content: str | None = None) -> DataFrame:
    """Without paragraphs of white space; those with other content (a drawing, a break) stay."""
    blank = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\s", "")) == ""
    return paragraphs.filter(~blank | F.coalesce(F.col(content), F.lit(False))) if content else paragraphs.filter(~blank)


def paragraphs_text(blocks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Each document's paragraphs joined by line feeds in order."""
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def block_markdown(style: Column, text: Column, bold: Column, italic: Column) -> Column:
    """A paragraph as Markdown by its style: Heading 1-6, List Bullet, List Number, else plain; runs bold or italic."""
    body = markdown_escape(text)
    body = F.when(bold & italic, F.concat(F.lit("***"), body, F.lit("***"))).when(bold, F.concat(F.lit("**"), body, F.lit("**"))).when(italic, F.concat(F.lit("*"), body, F.lit("*"))).otherwise(body)
    level = F.regexp_extract(style, "^Heading ([1-6])$", 1)
    return F.when(level != "", F.concat(F.repeat(F.lit("#"), level.try_cast("int")), F.lit(" "), body)).when(style.startswith("List Bullet"), F.concat(F.lit("- "), body)).when(style.startswith("List Number"), F.concat(F.lit("1. "), body)).otherwise(body)


def block_html(style: Column, text: Column, bold: Column, italic: Column) -> Column:
    body = html_escape(text)
    body = F.when(italic, F.concat(F.lit("<i>"), body, F.lit("</i>"))).otherwise(body)
    body = F.when(bold, F.concat(F.lit("<b>"), body, F.lit("</b>"))).otherwise(body)
    level = F.regexp_extract(style, "^Heading ([1-6])$", 1)
    tag = F.when(level != "", F.concat(F.lit("h"), level)).when(style.startswith("List"), F.lit("li")).otherwise(F.lit("p"))
    return F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">"))


def markdown_row(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_cell(F.coalesce(c, F.lit(""))) for c in cells)), F.lit(" |"))


def mail_merge(records: DataFrame, template: str, fields: Sequence[str], filename: str | None = None, index: str = "index") -> DataFrame:
    """text and filename for each record: {{field}} replaced, {index:03d} and {field} in the file name. A placeholder of the
    file name that is no field is an error. The template is a literal, so nothing is joined."""
    text: Column = F.lit(template)
    for f in fields:
        text = F.replace(text, F.lit("{{" + f + "}}"), F.coalesce(F.col(f).cast("string"), F.lit("")))
    name = _format(filename, fields, index) if filename else F.format_string("document_%03d", F.col(index))
    return records.select(index, text.alias("text"), name.alias("filename"))


def _format(pattern: str, fields: Sequence[str], index: str) -> Column:
    import re

    parts: list[Column] = []
    for literal, name, width in re.findall(r"([^{}]+)|\{(\w+)(?::0(\d+)d)?\}", pattern):
        if literal:
            parts.append(F.lit(literal))
        elif name == "index":
            n = F.col(index).cast("string")
            parts.append(F.lpad(n, F.greatest(F.lit(int(width)), F.length(n)), "0") if width else n)
        elif name in fields:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
        else:
            raise KeyError(name)
    return F.concat(*parts)


def replace_words(text: Column, replacements: Mapping[str, str], case_sensitive: bool = True) -> Column:
    """As sheets.replace_text, where an empty needle is skipped and no replacement at all is an error."""
    from .sheets import replace_text

    if not replacements:
        raise ValueError("nothing to replace")
    return replace_text(text, {k: v for k, v in replacements.items() if k}, case_sensitive)


def strip_links(html: Column) -> Column:
    """HTML without its links; what they show stays."""
    return F.regexp_replace(html, "(?i)</?a(?:\\s[^>]*)?>", "")


def strip_images(html: Column) -> Column:
    return F.regexp_replace(html, "(?i)<img(?:\\s[^>]*)?/?>", "")


def map_fonts(font: Column, replacements: Mapping[str, str], default: str | None = None) -> Column:
    """A font's replacement without regard to case, else the default, else the font."""
    table = F.create_map(*(F.lit(x) for k, v in replacements.items() for x in (k.casefold(), v))) if replacements else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(table, F.lower(font)), F.lit(default), font)


def apply_revisions(runs: DataFrame, mode: str, kind: str = "revision") -> DataFrame:
    """Runs after tracked changes are accepted (insertions stay, deletions go) or rejected; comments go."""
    if mode not in ("accept", "reject"):
        raise ValueError(mode)
    gone = "delete" if mode == "accept" else "insert"
    return runs.filter(F.coalesce(F.col(kind), F.lit("")) != gone).filter(F.coalesce(F.col(kind), F.lit("")) != "comment")


def headers_footers(sections: DataFrame, header: str = "", footer: str = "", replace: bool = True) -> DataFrame:
    """Header and footer of every section, replaced or continued on a new line; an empty text changes nothing."""

    def new(column: str, text: str) -> Column:
        if not text:
            return F.col(column)
        old = F.coalesce(F.col(column), F.lit(""))
        return F.lit(text) if replace else F.when(old == "", text).otherwise(F.concat(old, F.lit("\n" + text)))

    return sections.withColumns({"header": new("header", header), "footer": new("footer", footer)})


def typography(runs: DataFrame, font: str = "", size: float = 0, spacing: float = 0) -> DataFrame:
    """Font, size and line spacing of every run; '' and 0 leave them."""
    if size < 0 or spacing < 0:
        raise ValueError("sizes are positive")
    new = {**({"font": F.lit(font)} if font else {}), **({"size": F.lit(float(size))} if size else {}), **({"line_spacing": F.lit(float(spacing))} if spacing else {})}
    return runs.withColumns(new) if new else runs
