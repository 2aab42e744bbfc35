"""Pages of documents: relations with a document, a one-based page number and what is on the page."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import page_list, page_ranges


def numbered(pages: DataFrame, doc: str, order: str, name: str = "page") -> DataFrame:
    return pages.withColumn(name, F.row_number().over(Window.partitionBy(doc).orderBy(order)))


def merge(pages: DataFrame, doc: str, page: str, order: Column | None = None) -> DataFrame:
    """All documents as one, in their order: adds out_page. The number is a page's own plus the pages of the documents
    before, so only a row for each document is put in one order."""
    sizes = pages.groupBy(doc).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(order if order is not None else F.col(doc)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(doc).alias("__doc"), before.alias("__before"))
    return pages.join(starts, F.col(doc).eqNullSafe(F.col("__doc"))).withColumn("out_page", F.col(page) + F.col("__before")).drop("__doc", "__before")


def _literals(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def split(pages: DataFrame, doc: str, page: str, ranges: str, most: int) -> DataFrame:
    """A part for each range (they may overlap): adds part and out_page. `most`: pages of the longest document."""
    parts = _literals(pages, [(i, lo, hi) for i, (lo, hi) in enumerate(page_ranges(ranges, most), 1)], "part int, lo int, hi int")
    inside = pages.join(F.broadcast(parts), F.col(page).between(F.col("lo"), F.col("hi")))  # as many rows as the list has ranges
    return inside.withColumn("out_page", F.col(page) - F.col("lo") + 1).drop("lo", "hi")


def extract(pages: DataFrame, page: str, wanted: str, most: int, doc: str | None = None) -> DataFrame:
    """The wanted pages in the order asked for: adds out_page."""
    at = _literals(pages, [(p, i) for i, p in enumerate(page_list(wanted, most), 1)], "__p int, __i int")
    found = pages.join(F.broadcast(at), F.col(page) == F.col("__p")).drop("__p")
    keys = [doc] if doc else []
    return found.withColumn("out_page", F.row_number().over(Window.partitionBy(*keys).orderBy("__i"))).drop("__i")


def delete(pages: DataFrame, doc: str, page: str, gone: str, most: int) -> DataFrame:
    """The other pages, numbered anew. A document that would lose all of them is an error."""
    left = pages.filter(~F.col(page).isin(page_list(gone, most)))
    empty = pages.select(doc).distinct().join(left.select(doc).distinct(), doc, "left_anti").limit(1).collect()
    if empty:
        raise ValueError(f"document {empty[0][0]} would have no page left")
    return numbered(left, doc, page, "out_page")


def insert(base: DataFrame, extra: DataFrame, page: str, position: int, wanted: str | None = None, most: int | None = None) -> DataFrame:
    """The wanted pages of extra before a page of base; the position after the last one appends. Adds out_page, origin."""
    n = base.agg(F.max(page)).first()[0] or 0
    if not 1 <= position <= n + 1:
        raise ValueError(f"position is outside 1-{n + 1}")
    e = extract(extra, page, wanted or "", most or (extra.agg(F.max(page)).first()[0] or 0))
    k = e.count()
    a = base.withColumns({"out_page": F.when(F.col(page) < position, F.col(page)).otherwise(F.col(page) + k), "origin": F.lit("base")})
    return a.unionByName(e.withColumns({"out_page": F.col("out_page") + position - 1, "origin": F.lit("inserted")}))


def rotate(pages: DataFrame, page: str, rotation: str, wanted: Sequence[int] | None, angle: int) -> DataFrame:
    if angle % 90:
        raise ValueError("pages turn by multiples of 90")
    on = F.lit(True) if wanted is None else F.col(page).isin(list(wanted))
    return pages.withColumn(rotation, F.when(on, F.pmod(F.col(rotation) + angle, F.lit(360))).otherwise(F.col(rotation)))


def header_footer(pages: DataFrame, doc: str, page: str, template: str = "{page}/{total}", header: str = "", footer: str = "") -> DataFrame:
    """Adds header and footer, the footer with the page template filled in."""
    total = F.count("*").over(Window.partitionBy(doc))
    number = F.replace(F.replace(F.lit(template), F.lit("{page}"), F.col(page).cast("string")), F.lit("{total}"), total.cast("string"))
    return pages.withColumns({"header": F.lit(header), "footer": F.concat_ws(" ", *([F.lit(footer)] if footer else []), number)})


def text_of_documents(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, text with form feeds between pages, blank_pages (the first ten) and all_blank."""
    t = F.coalesce(F.col(text), F.lit(""))
    got = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), t.alias("t")))).alias("__pages"))
    blank = F.filter("__pages", lambda x: F.trim(F.regexp_replace(x["t"], "\\s", "")) == "")
    return got.select(doc, F.array_join(F.transform("__pages", lambda x: x["t"]), "\n\f\n").alias("text"), F.slice(F.transform(blank, lambda x: x["p"]), 1, 10).alias("blank_pages"), (F.size(blank) == F.size("__pages")).alias("all_blank"))


def blank_matches(documents: DataFrame, doc: str) -> DataFrame:
    """doc, source_page, rendered_page: blank pages of a source (0, 1, ...) with blank pages of its rendering, in order and
    one to one. Each takes the nearest to where it should be by the page counts that comes after the last one taken and is
    within two pages, the counts' difference and two, or 4 percent; the earlier of two as near. documents: source_blank and
    rendered_blank (arrays), source_pages and rendered_pages; one of nulls matches nothing."""
    sources = F.array_sort(F.array_distinct(F.array_compact("source_blank")))
    within = F.greatest(F.lit(2.0), F.abs(F.col("rendered_pages") - F.col("source_pages")) + 2.0, F.col("rendered_pages") * 0.04)
    none = F.array().cast("array<struct<source_page:int,rendered_page:int>>")

    def take(found: Column, page: Column) -> Column:
        due = (page + 0.5) / F.greatest(F.lit(1), F.col("source_pages")) * F.col("rendered_pages") - 0.5
        last = F.when(F.size(found) > 0, F.element_at(found, -1)["rendered_page"]).otherwise(-1)
        free = F.filter(F.array_compact("rendered_blank"), lambda r: (r > last) & (F.abs(r - due) <= F.col("__within")))
        best = F.array_min(F.transform(free, lambda r: F.struct(F.abs(r - due).alias("off"), r.cast("int").alias("r"))))["r"]
        return F.when(F.size(free) > 0, F.array_append(found, F.struct(page.cast("int").alias("source_page"), best.alias("rendered_page")))).otherwise(found)

    d = documents.withColumn("__within", within)
    return d.withColumn("__m", F.aggregate(sources, none, take)).select(doc, F.inline("__m"))


# The share of a page that one mark, or all marks, may fill; that of its cell that a mark fills; what an empty cell costs.
MARKS = {"one": 0.86, "all": 0.92, "cell": 0.78, "empty": 0.08}


def watermark_grid(pages: DataFrame) -> DataFrame:
    """page, mark (from 0), x, y and scale: where the middles of a page's watermarks lie, and how much smaller they are drawn so that,
    turned, they fit. pages has page, width, height, count (1 or more), mark_width, mark_height and angle in degrees.

    Of all numbers of rows the one is taken that gives a turned mark the most room, less a little for each cell that stays empty;
    of equal ones the one with the fewest empty cells, then with the fewest rows. Rows and marks count from the top right; a last
    row that isn't full stands in the middle. Pages with nulls, or without a mark, have none."""
    turn = F.radians(F.pmod("angle", F.lit(180.0)))
    c, s = F.abs(F.cos(turn)), F.abs(F.sin(turn))
    box = lambda a, b: F.greatest(F.lit(1.0), F.col("mark_width") * a + F.col("mark_height") * b)
    p = pages.dropna(subset=["width", "height", "count", "mark_width", "mark_height", "angle"]).filter("count >= 1").withColumns({"__w": box(c, s), "__h": box(s, c)})
    n = F.col("count")

    def grid(rows: Column) -> Column:
        columns = F.ceil(n / rows)
        wide, high, empty = F.col("width") * MARKS["all"] / columns, F.col("height") * MARKS["all"] / rows, rows * columns - n
        room = F.least(wide / F.col("__w"), high / F.col("__h")) / (1.0 + empty * MARKS["empty"])
        return F.struct(room.alias("room"), (-empty).alias("full"), (-rows).alias("few"), columns.alias("columns"), wide.alias("wide"), high.alias("high"))

    p = p.withColumn("g", F.array_max(F.transform(F.sequence(F.lit(1), n), grid))).withColumn("mark", F.explode(F.sequence(F.lit(0), n - 1)))
    columns, rows = F.col("g.columns"), -F.col("g.few")
    row = F.floor(F.col("mark") / columns)
    own = F.least(columns, n - row * columns)
    x = F.col("width") / 2 + (own - 1 - 2 * (F.col("mark") % columns)) * F.col("g.wide") / 2
    y = F.col("height") / 2 + (rows - 1 - 2 * row) * F.col("g.high") / 2
    fits = lambda a, b: F.least(F.lit(1.0), a / F.col("__w"), b / F.col("__h"))
    scale = F.when(n == 1, fits(F.col("width") * MARKS["one"], F.col("height") * MARKS["one"])).otherwise(fits(F.col("g.wide") * MARKS["cell"], F.col("g.high") * MARKS["cell"]))
    one = lambda side, value: F.when(n == 1, F.col(side) / 2).otherwise(value)
    return p.select("page", "mark", one("width", x).alias("x"), one("height", y).alias("y"), scale.alias("scale"))


def page_features(pages: DataFrame, doc: str) -> DataFrame:
    """Per document whether it needs a fixed layout, from page counts chars, lines, images, drawings, items, two_column."""
    heavy = ((F.col("lines") >= 12) & (F.col("items") >= 80)) | ((F.col("images") >= 1) & (F.col("drawings") >= 8) & (F.col("items") >= 24))
    got = pages.groupBy(doc).agg(F.count_if(F.col("chars") >= 80).alias("text_pages"), F.count_if(F.col("two_column")).alias("two_column_pages"), F.count_if(heavy).alias("heavy_pages"), F.count("*").alias("n_pages"))
    two = (F.col("text_pages") > 0) & (F.col("two_column_pages") >= F.ceil(F.col("text_pages") * 0.35))
    return got.withColumn("fixed_layout", two | (F.col("heavy_pages") > 0))


def fill_form(fields: DataFrame, values: dict[str, str]) -> DataFrame:
    """Form fields (name, value) with new values; names that the form lacks are an error."""
    have = {r[0] for r in fields.filter(F.col("name").isin(list(values))).select("name").distinct().collect()}
    if unknown := sorted(set(values) - have):
        raise ValueError("unknown fields: " + ", ".join(unknown))
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return fields.withColumn("value", F.coalesce(F.element_at(pairs, F.col("name")), F.col("value")))


def add_markup(annotations: DataFrame, rows: list[tuple]) -> DataFrame:
    """Annotations and new ones: (page, kind, x, y, width, height, color, opacity, comment)."""
    for r in rows:
        if r[1] not in ("highlight", "underline", "strikeout", "note", "signature", "watermark"):
            raise ValueError(f"no markup {r[1]}")
    return annotations.unionByName(_literals(annotations, rows, annotations.schema))


def tables_of_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, row and cells of the tables of HTML pages, by built-ins."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "\\s+", " "))
    t = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit("(?is)<table\\b[^>]*>(.*?)</table\\s*>"), F.lit(1))).alias("table", "__t"))
    r = t.select(key, "table", F.posexplode(F.regexp_extract_all("__t", F.lit("(?is)<tr\\b[^>]*>(.*?)</tr\\s*>"), F.lit(1))).alias("row", "__r"))
    return r.select(key, "table", "row", F.transform(F.regexp_extract_all("__r", F.lit("(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]\\s*>"), F.lit(1)), clean).alias("cells"))


def stacked_tables(rows: DataFrame, key: str, table: str, row: str) -> DataFrame:
    """Tables of a page under one another with one blank row between: adds out_row."""
    w = Window.partitionBy(key).orderBy(table, row)
    return rows.withColumn("out_row", F.row_number().over(w) + F.dense_rank().over(Window.partitionBy(key).orderBy(table)) - 1)


def outside_tables(chars: DataFrame, tables: DataFrame, page: str = "page") -> DataFrame:
    """Characters (page, cx, cy) whose centre no table box of the page holds."""
    tables = tables.select(page, "x0", "x1", "y0", "y1").distinct()  # equal boxes hold the same
    inside = (chars[page] == tables[page]) & chars["cx"].between(tables["x0"], tables["x1"]) & chars["cy"].between(tables["y0"], tables["y1"])
    return chars.join(tables, inside, "left_anti")


def union_documents(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
