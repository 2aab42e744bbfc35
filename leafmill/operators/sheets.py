"""Sheets: rows of cells with an explicit ordinal. Nothing depends on the order of partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import TEXT, fold, is_blank, matches, sort_columns, sort_key
from .ranks import numbered


def _within(sheet: Sequence[str]) -> Window:
    return Window.partitionBy(*sheet) if sheet else Window.partitionBy()


def _first_order(df: DataFrame, columns: Sequence[str], order: str) -> list[tuple]:
    """Distinct values of columns in the order in which they first come."""
    rows = df.groupBy(*columns).agg(F.min(order).alias("__at")).orderBy("__at").collect()
    return [tuple(r[c] for c in columns) for r in rows]


def sort_rows(df: DataFrame, cell: str, order: str, sheet: Sequence[str] = (), reverse: bool = False) -> DataFrame:
    """Adds pos, the place of each row of its sheet when sorted by one cell; ties keep their order, also when reversed."""
    if not sheet:  # one sheet, of any size
        return numbered(df, [*sort_columns(F.col(cell)), F.col(order)], "pos", down=len(sort_columns(F.col(cell))) if reverse else 0)
    return df.withColumn("pos", F.row_number().over(_within(sheet).orderBy(*sort_key(F.col(cell), reverse), F.col(order).asc())))


def filter_rows(df: DataFrame, cell: str, operator: str, value: object = None, case_sensitive: bool = False) -> DataFrame:
    """Adds hidden: rows stay, those that don't match are marked."""
    return df.withColumn("hidden", ~matches(F.col(cell), operator, value, case_sensitive))


def deduplicate(df: DataFrame, keys: Sequence[Column | str], order: str, sheet: Sequence[str] = ()) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy(*sheet, *keys).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def replace_text(text: Column, replacements: Mapping[str, str], case_sensitive: bool = True, exact: bool = False) -> Column:
    """Replacements one after another, each on what the one before left."""
    for old, new in replacements.items():
        if exact:
            text = F.when((text == old) if case_sensitive else (fold(text) == old.casefold()), F.lit(new)).otherwise(text)
        elif case_sensitive:
            text = F.replace(text, F.lit(old), F.lit(new))
        else:
            quoted, literal = "(?iu)\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E", new.replace("\\", "\\\\").replace("$", "\\$")
            text = F.regexp_replace(text, quoted, literal)
    return text


def replace_cells(df: DataFrame, cells: Sequence[str], replacements: Mapping[str, str], case_sensitive: bool = True, exact: bool = False) -> DataFrame:
    """replace_text on the text cells of some columns; numbers and dates stay."""
    return df.withColumns({c: F.when(F.col(c)["kind"] == TEXT, F.col(c).withField("str", replace_text(F.col(c)["str"], replacements, case_sensitive, exact))).otherwise(F.col(c)) for c in cells})


def split_column(df: DataFrame, column: str, delimiter: str, maxsplit: int = -1, width: int | None = None, prefix: str | None = None) -> DataFrame:
    """column split into as many columns as the widest row has parts (one aggregate, unless width is given).

    A null splits into one empty part; rows with fewer parts have nulls; empty parts at the end stay."""
    parts = F.split(F.coalesce(F.col(column).cast("string"), F.lit("")), "\\Q" + delimiter + "\\E", -1 if maxsplit < 0 else maxsplit + 1)
    split = df.withColumn("__parts", parts)
    n = width or split.agg(F.max(F.size("__parts"))).first()[0] or 1
    name = prefix or column
    at = df.columns.index(column)
    new = [F.get("__parts", F.lit(i)).alias(name if i == 0 else f"{name}_{i + 1}") for i in range(n)]
    return split.select(*df.columns[:at], *new, *df.columns[at + 1 :])


def drop_blank_rows(df: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Without the rows whose every cell is null or ''."""
    full = F.lit(False)
    for c in cells:
        full = full | (F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    return df.filter(full)


def blank_columns(df: DataFrame, cells: Sequence[str]) -> list[str]:
    """The columns that are null or '' in every row, by one aggregate."""
    row = df.agg(*(F.max((F.col(c).isNotNull() & (F.col(c).cast("string") != "")).cast("int")).alias(c) for c in cells)).first()
    return [c for c in cells if not row[c]]


def drop_blank_columns(df: DataFrame, cells: Sequence[str]) -> DataFrame:
    return df.drop(*blank_columns(df, cells))


FUNCTIONS = ("sum", "count", "average", "max", "min")


def _measure(function: str, value: str) -> Column:
    """A group's value: 0 where it has no numbers; count is of full cells, or of rows if none is full."""
    number = F.expr(f"try_cast(`{value}` AS double)")
    if function == "count":
        full = F.count_if(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
        return F.when(full > 0, full).otherwise(F.count(F.lit(1))).cast("double")
    made = {"sum": F.sum, "average": F.avg, "max": F.max, "min": F.min}[function](number)
    return F.coalesce(made, F.lit(0.0))


def pivot_summary(df: DataFrame, rows: Sequence[str], columns: Sequence[str], data: str | None, function: str, order: str, total: str = "总计", captions: Mapping[tuple, str] | None = None) -> DataFrame:
    """Groups by rows and columns to a sheet with a total for each row.

    Rows and columns come in the order in which their keys first appear (order); a missing combination is 0; the total
    is over the raw values, so that an average of it is a true mean. Without rows there is one group, 全部; without
    columns the one column is <function>_<data>, or 记录数 without data, where every row counts 1."""
    if function not in FUNCTIONS:
        raise ValueError(f"unknown function {function}")
    if data is None:
        function, data = "count", "__one"
        df = df.withColumn("__one", F.lit(1))
    groups = [*rows] or ["分组"]
    if not rows:
        df = df.withColumn("分组", F.lit("全部"))
    base = df.groupBy(*groups).agg(F.min(order).alias("__at"), _measure(function, data).alias(total))
    if columns:
        keys = _first_order(df, columns, order)
        named = {k: (captions or {}).get(k) or " / ".join(f"{c}={'' if v is None else v}" for c, v in zip(columns, k)) for k in keys}
        label = F.concat_ws(" / ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))
        plain = [" / ".join(f"{c}={'' if v is None else v}" for c, v in zip(columns, k)) for k in keys]
        wide = df.withColumn("__label", label).groupBy(*groups).pivot("__label", plain).agg(_measure(function, data).alias("v"))
        for p, k in zip(plain, keys):
            if named[k] != p:
                wide = wide.withColumnRenamed(p, named[k])
        names = [named[k] for k in keys]
        left, right = base.alias("b"), wide.alias("w")
        on = F.lit(True)
        for g in groups:
            on = on & F.col(f"b.{g}").eqNullSafe(F.col(f"w.{g}"))
        base = left.join(right, on).select(*(f"b.{g}" for g in groups), "b.__at", *(F.coalesce(F.col(f"w.`{n}`"), F.lit(0.0)).alias(n) for n in names), f"b.{total}")
    else:
        base = base.withColumnRenamed(total, "记录数" if data == "__one" else f"{function}_{data}")
    return base.orderBy("__at").drop("__at")


SCALE = ("F8696B", "FFEB84", "63BE7B")  # fixed values: low, middle, high


def conditional_fill(value: Column, operator: str, threshold: float, fill: str = "FFF2CC") -> Column:
    """The fill that a cell rule gives, or null."""
    test = {"greaterThan": value > threshold, "greaterThanOrEqual": value >= threshold, "lessThan": value < threshold, "lessThanOrEqual": value <= threshold, "equal": value == threshold, "notEqual": value != threshold}[operator]
    return F.when(test, F.lit(fill))


def color_scale(df: DataFrame, column: str, sheet: Sequence[str] = ()) -> DataFrame:
    """Adds fill: between the colours of the least, the median and the greatest value, linearly. The three come from one
    aggregate that is joined back, not from a window over all rows."""
    stats = df.groupBy(*sheet).agg(F.min(column).alias("__lo"), F.percentile(column, F.lit(0.5)).alias("__mid"), F.max(column).alias("__hi"))
    joined = df.join(stats, list(sheet)) if sheet else df.crossJoin(F.broadcast(stats))  # one row
    low = F.col(column) <= F.col("__mid")
    share = F.when(low, F.coalesce((F.col(column) - F.col("__lo")) / F.nullif(F.col("__mid") - F.col("__lo"), F.lit(0)), F.lit(0))).otherwise(F.coalesce((F.col(column) - F.col("__mid")) / F.nullif(F.col("__hi") - F.col("__mid"), F.lit(0)), F.lit(0)))

    def part(i: int) -> Column:
        a, b, c = (int(x[i : i + 2], 16) for x in SCALE)
        return F.lpad(F.hex(F.when(low, F.lit(a) + share * (b - a)).otherwise(F.lit(b) + share * (c - b)).cast("int")), 2, "0")

    return joined.withColumn("fill", F.when(F.col(column).isNotNull(), F.concat(*map(part, (0, 2, 4))))).drop("__lo", "__mid", "__hi")


def formula_rule(formula: str, fill: str = "FFF2CC") -> Column:
    """A rule that is an SQL expression over the row."""
    return F.when(F.expr(formula), F.lit(fill))


def merge_conflicts(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Full cells inside a merged range other than its first; cells: sheet,row,col,value; merges: sheet,r0,c0,r1,c1."""
    inside = (F.col("row").between(F.col("r0"), F.col("r1"))) & F.col("col").between(F.col("c0"), F.col("c1"))
    full = F.col("value").isNotNull() & (F.col("value") != "")
    return cells.join(merges, "sheet").filter(inside & full & ~((F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0")))).select(cells["sheet"], "row", "col", "value", "r0", "c0", "r1", "c1")


def unmerge_fill(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with those of each merged range filled with the value of the range's first cell. The ranges are expanded to
    their cells, so the join is by position."""
    spread = merges.select("sheet", "r0", "c0", F.explode(F.sequence("r0", "r1")).alias("row"), "c1").select("sheet", "r0", "c0", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    anchors = cells.select("sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("value").alias("__fill"))
    filled = spread.join(anchors, ["sheet", "r0", "c0"], "left").select("sheet", "row", "col", "__fill", F.lit(True).alias("__in"))
    return cells.join(filled, ["sheet", "row", "col"], "full").select("sheet", "row", "col", F.when(F.col("__in"), F.col("__fill")).otherwise(F.col("value")).alias("value"))


def formulas_to_values(formulas: DataFrame, cached: DataFrame, keys: Sequence[str], missing: str = "warn") -> DataFrame:
    """Formulas with their cached values by position; a missing one keeps its formula (warn) or is an error that names the first five."""
    out = formulas.join(cached, list(keys), "left").withColumn("missing", F.col("formula").isNotNull() & F.col("cached").isNull())
    if missing == "error":
        bad = out.filter("missing").orderBy(*keys).limit(5).select(*keys).collect()
        if bad:
            raise ValueError("no cached value: " + ", ".join(str(tuple(r)) for r in bad))
    return out.withColumn("value", F.coalesce("cached", "formula"))


def manage_sheets(sheets: DataFrame, rename: Mapping[str, str] = {}, delete: Sequence[str] = (), copy: Mapping[str, str] = {}, order: Sequence[str] = ()) -> DataFrame:
    """book, ordinal (from 0), sheet, source and error: each book's sheets after renames, deletions, copies and the reorder, in that
    order. sheets has book, ordinal and sheet. A book where a name is wrong stays as it was, with the first error. The sheets of one
    book are one row at a time."""
    was = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "sheet"))), lambda x: F.struct(x["sheet"].alias("sheet"), x["sheet"].alias("source")))
    b = sheets.groupBy("book").agg(was.alias("__was")).withColumns({"__now": F.col("__was"), "error": F.lit(None).cast("string")})
    now = F.col("__now")
    has = lambda name: F.exists(now, lambda x: x["sheet"] == name)

    def step(b: DataFrame, wrong: Column, new: Column) -> DataFrame:
        return b.withColumn("error", F.coalesce("error", wrong)).withColumn("__now", new)

    for old, new in rename.items():
        taken = has(new) if new != old else F.lit(False)
        wrong = F.when(~has(old), f"no sheet {old}").when(taken, f"can't rename {old} to {new}")
        b = step(b, wrong, F.transform(now, lambda x: F.struct(F.when(x["sheet"] == old, new).otherwise(x["sheet"]).alias("sheet"), x["source"].alias("source"))))  # noqa: B023
    for name in delete:
        wrong = F.when(~has(name), f"no sheet {name}").when(F.size(now) == 1, "the last sheet can't be deleted")
        b = step(b, wrong, F.filter(now, lambda x: x["sheet"] != name))  # noqa: B023
    for old, new in copy.items():
        source = F.get(F.filter(now, lambda x: x["sheet"] == old), F.lit(0))["source"]  # noqa: B023
        wrong = F.when(~has(old), f"no sheet {old}").when(has(new), f"can't copy {old} to {new}")
        b = step(b, wrong, F.array_append(now, F.struct(F.lit(new).alias("sheet"), source.alias("source"))))
    if order:
        names = F.array_sort(F.transform(now, lambda x: x["sheet"]))
        wrong = F.when(names != F.array(*map(F.lit, sorted(order))), "the order must name every sheet once")
        b = step(b, wrong, F.transform(F.array(*map(F.lit, order)), lambda n: F.get(F.filter(now, lambda x: x["sheet"] == n), F.lit(0))))
    kept = F.when(F.col("error").isNull(), now).otherwise(F.col("__was"))
    return b.select("book", "error", F.posexplode(kept).alias("ordinal", "x")).select("book", "ordinal", "x.sheet", "x.source", "error")


def header_names(cells: DataFrame, place: str, text: str, sheet: Sequence[str] = ()) -> DataFrame:
    """Adds name to the header cells of sheets (place from 1): the text, or column_<place> where there is none, and from the
    second cell of equal names on _<how many there were so far>."""
    own = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.concat(F.lit("column_"), F.col(place).cast("string"))).otherwise(F.col(text))
    nth = F.row_number().over(Window.partitionBy(*sheet, "__own").orderBy(place))
    tail = F.when(F.col("__nth") > 1, F.concat(F.lit("_"), F.col("__nth").cast("string"))).otherwise("")
    return cells.withColumn("__own", own).withColumn("__nth", nth).withColumn("name", F.concat("__own", tail)).drop("__own", "__nth")


def csv_line(columns: Sequence[Column], delimiter: str = ",") -> Column:
    """A row of a CSV file: fields with the delimiter, a quote or a line end are quoted, quotes doubled; nulls are empty."""
    special = "[\"\\r\\n" + "\\" + delimiter + "]"

    def field(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(s.rlike(special), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(delimiter, *map(field, columns))


def xml_rows(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """order and xml: <row index=".."><cell column="A">..</cell>..</row>, blank cells empty."""
    from ..functions.text import html_escape
    from ..functions.values import column_letters

    cells = [F.concat(F.lit(f'<cell column="{column_letters(i)}">'), html_escape(F.coalesce(F.col(c).cast("string"), F.lit("")), quotes=False), F.lit("</cell>")) for i, c in enumerate(columns, 1)]
    return df.select(order, F.concat(F.lit('<row index="'), F.col(order).cast("string"), F.lit('">'), *cells, F.lit("</row>")).alias("xml"))


def records_json(df: DataFrame, columns: Sequence[str], header: bool = True) -> DataFrame:
    """json: each row as an object, or as an array without header; nulls stay."""
    value = F.struct(*columns) if header else F.array(*(F.col(c).cast("string") for c in columns))
    return df.withColumn("json", F.to_json(value, {"ignoreNullFields": "false"}))
