"""Queries over the test tables, one for each operator, with the SQL that gives the same rows.

Each entry is (query, SQL or None). The queries go through the operators; the SQL states their result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import text as X
from ..functions import values as V
from ..operators import frames as FR
from ..operators import geometry as G
from ..operators import media as M
from ..operators import pages as P
from ..operators import scans as SC
from ..operators import sheets as S
from ..operators import textops as TX
from ..operators.ranks import numbered
from . import catalog as CAT
from . import runner as R

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Query, str | None]] = {}


def entry(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        ENTRIES[name] = (f, sql)
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- sheets ----------------------------------------------------------------------------------------------------------

for _rev in (False, True):

    @entry(f"sort_rows_{'desc' if _rev else 'asc'}", f"SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY lower(c_mktsegment) {'DESC' if _rev else ''}, c_custkey) AS pos FROM customer")
    def _sort(spark, d, rev=_rev):
        t = read(spark, d, "customer").select("c_custkey", "c_mktsegment", C.text_cell(F.col("c_mktsegment")).alias("cell"))
        return S.sort_rows(t, "cell", "c_custkey", reverse=rev).select("c_custkey", "c_mktsegment", F.col("pos").cast("long").alias("pos"))


@entry("sort_mixed_cells", """
WITH m AS (SELECT c_custkey AS k, c_custkey % 4 AS w, c_acctbal AS num, c_name AS s FROM customer)
SELECT k, row_number() OVER (ORDER BY CASE w WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, CASE WHEN w = 0 THEN num ELSE 0 END,
  CASE WHEN w = 1 THEN strftime(TIMESTAMP '2020-01-01' + to_days((k % 50)::INT), '%Y-%m-%dT%H:%M:%S') ELSE '' END, CASE WHEN w = 2 THEN lower(s) ELSE '' END, k) AS pos FROM m""")
def _mixed(spark, d):
    k = F.col("c_custkey")
    date = F.expr("timestamp'2020-01-01' + make_dt_interval(CAST(c_custkey % 50 AS int))")
    cell = F.when(k % 4 == 0, C.number_cell(F.col("c_acctbal"))).when(k % 4 == 1, C.date_cell(date)).when(k % 4 == 2, C.text_cell(F.col("c_name"))).otherwise(C.blank_cell())
    return S.sort_rows(read(spark, d, "customer").select(k.alias("k"), cell.alias("cell")), "cell", "k").select("k", F.col("pos").cast("long").alias("pos"))


_FILTERS = {
    "equals": ("text", "standard brass", "lower(p_type) = 'standard brass'"), "not_equals": ("text", "standard brass", "lower(p_type) <> 'standard brass'"),
    "contains": ("text", "BRASS", "contains(lower(p_type), 'brass')"), "not_contains": ("text", "BRASS", "NOT contains(lower(p_type), 'brass')"),
    "starts_with": ("text", "promo", "starts_with(lower(p_type), 'promo')"), "ends_with": ("text", "STEEL", "ends_with(lower(p_type), 'steel')"),
    "greater_than": ("number", 25, "p_size > 25"), "greater_equal": ("number", 25, "p_size >= 25"), "less_than": ("number", 25, "p_size < 25"), "less_equal": ("number", 25, "p_size <= 25"),
    "is_blank": ("null", None, "p_size % 7 = 0"), "not_blank": ("null", None, "p_size % 7 <> 0"),
}
for _op, (_kind, _value, _sql) in _FILTERS.items():

    @entry(f"filter_{_op}", f"SELECT p_partkey, NOT ({_sql}) AS hidden FROM part")
    def _filter(spark, d, op=_op, kind=_kind, value=_value):
        cell = {"text": C.text_cell(F.col("p_type")), "number": C.number_cell(F.col("p_size")), "null": C.number_cell(F.when(F.col("p_size") % 7 != 0, F.col("p_size")))}[kind]
        return S.filter_rows(read(spark, d, "part").select("p_partkey", cell.alias("cell")), "cell", op, value).select("p_partkey", "hidden")


@entry("filter_hidden_export", "SELECT concat_ws(',', p_partkey::VARCHAR, p_brand) AS line, p_size <= 40 AS hidden FROM part")
def _hidden(spark, d):
    t = S.filter_rows(read(spark, d, "part").withColumn("cell", C.number_cell(F.col("p_size"))), "cell", "greater_than", 40)
    return t.select(S.csv_line([F.col("p_partkey"), F.col("p_brand")]).alias("line"), "hidden")


@entry("dedupe_first", "SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) n FROM lineitem) WHERE n = 1")
def _dedupe(spark, d):
    t = read(spark, d, "lineitem").withColumn("__o", F.struct("l_linenumber", "l_partkey"))
    return S.deduplicate(t, ["l_orderkey", "l_returnflag"], "__o").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")


@entry("replace_sequential", "SELECT p_partkey, replace(replace(p_type, 'STANDARD', 'PLAIN'), 'PLAIN B', 'B') AS p_type FROM part")
def _replace(spark, d):
    return read(spark, d, "part").select("p_partkey", S.replace_text(F.col("p_type"), {"STANDARD": "PLAIN", "PLAIN B": "B"}).alias("p_type"))


@entry("replace_exact", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'first' ELSE p_brand END AS p_brand FROM part")
def _replace_exact(spark, d):
    return read(spark, d, "part").select("p_partkey", S.replace_text(F.col("p_brand"), {"Brand#11": "first"}, exact=True).alias("p_brand"))


@entry("replace_ci", "SELECT doc_id, regexp_replace(text, 'the', 'THE', 'gi') AS text FROM documents")
def _replace_ci(spark, d):
    return read(spark, d, "documents").select("doc_id", S.replace_text(F.col("text"), {"the": "THE"}, case_sensitive=False).alias("text"))


@entry("split_column", "SELECT p_partkey, a[1] AS p_name, a[2] AS p_name_2, a[3] AS p_name_3 FROM (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)")
def _split(spark, d):
    return S.split_column(read(spark, d, "part").select("p_partkey", "p_name"), "p_name", " ", width=3)


@entry("split_maxsplit", "SELECT p_partkey, string_split(p_type, ' ')[1] AS p_type, CASE WHEN contains(p_type, ' ') THEN substr(p_type, instr(p_type, ' ') + 1) END AS p_type_2 FROM part")
def _maxsplit(spark, d):
    return S.split_column(read(spark, d, "part").select("p_partkey", "p_type"), "p_type", " ", maxsplit=1, width=2)


@entry("drop_blank_rows", "SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''")
def _blank_rows(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return S.drop_blank_rows(lines, ["line"])


@entry("drop_blank_cols", "SELECT n_nationkey, n_name FROM nation")
def _blank_cols(spark, d):
    t = read(spark, d, "nation").select("n_nationkey", "n_name", F.lit("").alias("empty"), F.lit(None).cast("string").alias("none"))
    return S.drop_blank_columns(t, t.columns)


_FLAGS = "A F O N R".split()
for _f, _agg in {"sum": "sum", "count": "count", "average": "avg", "max": "max", "min": "min"}.items():
    _q = lambda c, a=_agg: f"coalesce({a}(l_quantity) FILTER ({c}), 0)::DOUBLE"

    @entry(f"pivot_{_f}", f"""SELECT l_returnflag, {_q("l_linestatus = 'O'")} AS status_O, {_q("l_linestatus = 'F'")} AS status_F, {_q("true")} AS total FROM lineitem GROUP BY l_returnflag""")
    def _pivot(spark, d, f=_f):
        t = read(spark, d, "lineitem").withColumn("__o", F.struct("l_orderkey", "l_linenumber"))
        return S.pivot_summary(t, ["l_returnflag"], ["l_linestatus"], "l_quantity", f, "__o", total="total", captions={("O",): "status_O", ("F",): "status_F"})


@entry("pivot_count_only", "SELECT o_orderpriority, count(*)::DOUBLE AS \"记录数\" FROM orders GROUP BY 1")
def _pivot_count(spark, d):
    return S.pivot_summary(read(spark, d, "orders"), ["o_orderpriority"], [], None, "sum", "o_orderkey")


@entry("pivot_all_blank_group", "SELECT o_orderstatus, CASE WHEN count(v) > 0 THEN count(v) ELSE count(*) END::DOUBLE AS count_v FROM (SELECT o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS v FROM orders) GROUP BY 1")
def _pivot_blank(spark, d):
    t = read(spark, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")))
    return S.pivot_summary(t, ["o_orderstatus"], [], "v", "count", "o_orderkey")


@entry("cond_format_cell", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'FFF2CC' END AS fill FROM orders")
def _cond(spark, d):
    return read(spark, d, "orders").select("o_orderkey", S.conditional_fill(F.col("o_totalprice"), "greaterThan", 200000).alias("fill"))


@entry("cond_format_formula", "SELECT p_partkey, CASE WHEN p_size * 2 > p_retailprice / 20 THEN 'FFF2CC' END AS fill FROM part")
def _formula(spark, d):
    return read(spark, d, "part").select("p_partkey", S.formula_rule("p_size * 2 > p_retailprice / 20").alias("fill"))


def _hexpart(i: int) -> str:
    a, b, c = (int(x[i : i + 2], 16) for x in S.SCALE)
    return f"lpad(hex(CASE WHEN v <= mid THEN trunc({a} + s * ({b - a})) ELSE trunc({b} + s * ({c - b})) END::BIGINT), 2, '0')"


@entry("color_scale", f"""WITH t AS (SELECT p_partkey, p_size::DOUBLE AS v, min(p_size) OVER ()::DOUBLE AS lo, quantile_cont(p_size, 0.5) OVER ()::DOUBLE AS mid, max(p_size) OVER ()::DOUBLE AS hi FROM part),
u AS (SELECT *, CASE WHEN v <= mid THEN coalesce((v - lo) / nullif(mid - lo, 0), 0) ELSE coalesce((v - mid) / nullif(hi - mid, 0), 0) END AS s FROM t)
SELECT p_partkey, {_hexpart(0)} || {_hexpart(2)} || {_hexpart(4)} AS fill FROM u""")
def _scale(spark, d):
    t = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    return S.color_scale(t, "v").select("p_partkey", "fill")


@entry("unmerge_fill", "SELECT n_regionkey::INT AS \"row\", n_nationkey::INT AS col, CASE WHEN n_nationkey BETWEEN 5 AND 9 AND n_regionkey BETWEEN 1 AND 2 THEN (SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey = 5) ELSE n_name END AS value FROM nation WHERE NOT (n_nationkey BETWEEN 5 AND 9 AND n_regionkey BETWEEN 1 AND 2) UNION ALL SELECT r::INT, c::INT, (SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey = 5) FROM range(1, 3) a(r), range(5, 10) b(c)")
def _unmerge(spark, d):
    cells = read(spark, d, "nation").select(F.lit("s").alias("sheet"), F.col("n_regionkey").cast("int").alias("row"), F.col("n_nationkey").cast("int").alias("col"), F.col("n_name").alias("value"))
    merges = spark.createDataFrame([("s", 1, 5, 2, 9)], "sheet string, r0 int, c0 int, r1 int, c1 int")
    return S.unmerge_fill(cells, merges).select("row", "col", "value")


@entry("merge_conflicts", "SELECT n_regionkey::INT AS \"row\", n_nationkey::INT AS col, n_name AS value FROM nation WHERE n_regionkey BETWEEN 0 AND 2 AND n_nationkey BETWEEN 0 AND 9 AND NOT (n_regionkey = 0 AND n_nationkey = 0)")
def _conflicts(spark, d):
    cells = read(spark, d, "nation").select(F.lit("s").alias("sheet"), F.col("n_regionkey").cast("int").alias("row"), F.col("n_nationkey").cast("int").alias("col"), F.col("n_name").alias("value"))
    return S.merge_conflicts(cells, spark.createDataFrame([("s", 0, 0, 2, 9)], "sheet string, r0 int, c0 int, r1 int, c1 int")).select("row", "col", "value")


@entry("formula_cache_join", "SELECT o_orderkey, coalesce(c_name, '=LOOKUP(' || o_custkey || ')') AS value, c_name IS NULL AS missing FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey")
def _cache(spark, d):
    f = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.concat(F.lit("=LOOKUP("), F.col("o_custkey").cast("string"), F.lit(")")).alias("formula"))
    c = read(spark, d, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("cached"))
    return S.formulas_to_values(f, c, ["k"]).select("o_orderkey", "value", "missing")


#: Of each nation's market segments, its sheets, one is renamed, one goes, one is copied, and all are put in order by name.
_SHEETS = """b AS (SELECT c_nationkey AS book, list(c_mktsegment ORDER BY k) AS n FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY ALL) GROUP BY c_nationkey),
r AS (SELECT *, CASE WHEN NOT list_contains(n, 'BUILDING') THEN 'no sheet BUILDING' END AS e1, list_transform(n, lambda x: {'s': CASE x WHEN 'BUILDING' THEN 'HOUSES' ELSE x END, 'o': x}) AS m1 FROM b),
d AS (SELECT *, coalesce(e1, CASE WHEN NOT list_contains(n, 'FURNITURE') THEN 'no sheet FURNITURE' WHEN len(n) = 1 THEN 'the last sheet can''t be deleted' END) AS e2, list_filter(m1, lambda x: x.s <> 'FURNITURE') AS m2 FROM r),
c AS (SELECT *, coalesce(e2, CASE WHEN NOT list_contains(n, 'MACHINERY') THEN 'no sheet MACHINERY' END) AS e3, list_append(m2, {'s': 'TOOLS', 'o': 'MACHINERY'}) AS m3 FROM d),
f AS (SELECT *, coalesce(e3, CASE WHEN list_sort(list_transform(m3, lambda x: x.s)) <> ['AUTOMOBILE', 'HOUSEHOLD', 'HOUSES', 'MACHINERY', 'TOOLS'] THEN 'the order must name every sheet once' END) AS error FROM c),
g AS (SELECT book, error, CASE WHEN error IS NULL THEN list_transform(['TOOLS', 'HOUSEHOLD', 'AUTOMOBILE', 'HOUSES', 'MACHINERY'], lambda x: list_filter(m3, lambda y: y.s = x)[1]) ELSE list_transform(n, lambda x: {'s': x, 'o': x}) END AS z FROM f)"""


@entry("sheet_reorder", f"WITH {_SHEETS} SELECT book, i::INT AS ordinal, z[i + 1].s AS sheet, z[i + 1].o AS source, error FROM (SELECT *, unnest(range(len(z))) AS i FROM g)")
def _sheets(spark, d):
    t = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("book"), F.col("c_mktsegment").alias("sheet")).agg(F.min("c_custkey").alias("ordinal"))
    return S.manage_sheets(t, {"BUILDING": "HOUSES"}, ["FURNITURE"], {"MACHINERY": "TOOLS"}, ["TOOLS", "HOUSEHOLD", "AUTOMOBILE", "HOUSES", "MACHINERY"])


@entry("header_dedupe", """WITH h AS (SELECT c_nationkey AS sheet, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE c_mktsegment END AS header FROM customer),
o AS (SELECT *, CASE WHEN header = '' THEN 'column_' || place ELSE header END AS own FROM h),
n AS (SELECT *, count(*) OVER (PARTITION BY sheet, own ORDER BY place) AS nth FROM o) SELECT sheet, place, own || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS name FROM n""")
def _header(spark, d):
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long")
    cells = read(spark, d, "customer").select(F.col("c_nationkey").alias("sheet"), place.alias("place"), F.when(F.col("c_custkey") % 4 != 3, F.col("c_mktsegment")).alias("header"))
    return S.header_names(cells, "place", "header", ["sheet"]).select("sheet", "place", "name")


@entry("export_csv_row", "SELECT n_nationkey::VARCHAR || ',' || CASE WHEN contains(n_name, ',') THEN '\"' || n_name || '\"' ELSE n_name END || ',' || n_regionkey AS line FROM nation")
def _csv(spark, d):
    return read(spark, d, "nation").select(S.csv_line([F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")]).alias("line"))


@entry("export_txt", "SELECT n_nationkey::VARCHAR || chr(9) || n_name AS line FROM nation")
def _txt(spark, d):
    return read(spark, d, "nation").select(S.csv_line([F.col("n_nationkey"), F.col("n_name")], "\t").alias("line"))


@entry("export_json", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def _json(spark, d):
    return S.records_json(read(spark, d, "nation"), ["n_nationkey", "n_name"]).select("json")


@entry("export_xml", "SELECT n_nationkey, '<row index=\"' || n_nationkey || '\"><cell column=\"A\">' || n_nationkey || '</cell><cell column=\"B\">' || replace(replace(replace(n_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</cell></row>' AS xml FROM nation")
def _xml(spark, d):
    return S.xml_rows(read(spark, d, "nation"), ["n_nationkey", "n_name"], "n_nationkey")


# ---- pages -----------------------------------------------------------------------------------------------------------

_PAGES = "WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS page, text, role FROM conversations) "


def _conv(spark, d) -> DataFrame:
    return P.numbered(read(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "page", "text", "role")


@entry("pages_merge", _PAGES + "SELECT conv_id, page, row_number() OVER (ORDER BY conv_id, page) AS out_page FROM p")
def _merge(spark, d):
    return P.merge(_conv(spark, d), "conv_id", "page").select("conv_id", "page", F.col("out_page").cast("long").alias("out_page"))


@entry("pages_split", _PAGES + "SELECT conv_id, page, part, page - lo + 1 AS out_page FROM p, (VALUES (1, 1, 2), (2, 2, 3)) r(part, lo, hi) WHERE page BETWEEN lo AND hi")
def _page_split(spark, d):
    return P.split(_conv(spark, d), "conv_id", "page", "1-2,2-3", 3).select("conv_id", "page", "part", "out_page")


@entry("pages_extract", _PAGES + "SELECT conv_id, page, row_number() OVER (PARTITION BY conv_id ORDER BY i)::INT AS out_page FROM p JOIN (VALUES (3, 1), (1, 2)) w(q, i) ON page = q")
def _extract(spark, d):
    return P.extract(_conv(spark, d), "page", "3,1", 3, "conv_id").select("conv_id", "page", "out_page")


@entry("pages_delete", _PAGES + "SELECT conv_id, page, row_number() OVER (PARTITION BY conv_id ORDER BY page)::INT AS out_page FROM p WHERE page <> 2")
def _delete(spark, d):
    return P.delete(_conv(spark, d), "conv_id", "page", "2", 2).select("conv_id", "page", "out_page")


@entry("pages_insert", "SELECT n_nationkey AS id, CASE WHEN n_nationkey + 1 < 3 THEN n_nationkey + 1 ELSE n_nationkey + 3 END::INT AS out_page, 'base' AS origin FROM nation UNION ALL SELECT * FROM (VALUES (3, 3, 'inserted'), (1, 4, 'inserted')) t(id, out_page, origin)")
def _insert(spark, d):
    a = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") + 1).alias("page"))
    b = read(spark, d, "region").select(F.col("r_regionkey").alias("id"), (F.col("r_regionkey") + 1).alias("page"))
    return P.insert(a, b, "page", 3, "4,2").select("id", "out_page", "origin")


@entry("pages_rotate", _PAGES + "SELECT conv_id, page, CASE WHEN page IN (1, 3) THEN (page * 90 + 270) % 360 ELSE page * 90 END AS rotation FROM p")
def _rotate(spark, d):
    return P.rotate(_conv(spark, d).withColumn("rotation", F.col("page") * 90), "page", "rotation", [1, 3], 270).select("conv_id", "page", "rotation")


@entry("page_footer", _PAGES + "SELECT conv_id, page, '' AS header, page || '/' || count(*) OVER (PARTITION BY conv_id) AS footer FROM p")
def _footer(spark, d):
    return P.header_footer(_conv(spark, d), "conv_id", "page").select("conv_id", "page", "header", "footer")


@entry("pages_text_join", _PAGES + "SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(12) || chr(10) ORDER BY page) AS text, bool_and(trim(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) = '') AS all_blank FROM p GROUP BY conv_id")
def _text_join(spark, d):
    return P.text_of_documents(_conv(spark, d), "conv_id", "page", "text").select("conv_id", "text", "all_blank")


@entry("fixed_layout", "SELECT conv_id, count(*) FILTER (length(text) >= 80) AS text_pages, count(*) FILTER (length(text) > 300) AS two_column_pages, count(*) FILTER (false) AS heavy_pages, count(*) AS n_pages, (count(*) FILTER (length(text) >= 80) > 0 AND count(*) FILTER (length(text) > 300) >= ceil(count(*) FILTER (length(text) >= 80) * 0.35)) AS fixed_layout FROM conversations GROUP BY conv_id")
def _fixed(spark, d):
    p = _conv(spark, d).withColumns({"chars": F.length("text"), "two_column": F.coalesce(F.length("text") > 300, F.lit(False)), **{c: F.lit(0) for c in ("lines", "items", "images", "drawings")}})
    return P.page_features(p, "conv_id")


@entry("watermark_grid", """
WITH p AS (SELECT p_partkey AS page, 300 + p_size * 12.0 AS w, 900 - p_size * 11.0 AS h, p_partkey % 7 + 1 AS n, 20.0 + p_partkey % 160 AS mw, 10.0 + p_partkey % 30 AS mh, radians((p_partkey * 7) % 180) AS a FROM part),
q AS (SELECT *, greatest(1.0, mw * abs(cos(a)) + mh * abs(sin(a))) AS rw, greatest(1.0, mw * abs(sin(a)) + mh * abs(cos(a))) AS rh FROM p),
g AS (SELECT *, unnest(range(1, n + 1)) AS r FROM q), k AS (SELECT *, ceil(n / r)::BIGINT AS c FROM g),
s AS (SELECT *, w * 0.92 / c AS cw, h * 0.92 / r AS ch, least(w * 0.92 / c / rw, h * 0.92 / r / rh) / (1.0 + (r * c - n) * 0.08) AS score FROM k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, r * c - n, r) = 1),
m AS (SELECT *, unnest(range(n)) AS i FROM b)
SELECT page, i::INT AS mark, round(CASE WHEN n = 1 THEN w / 2 ELSE w / 2 + (least(c, n - i // c * c) - 1 - 2 * (i % c)) * cw / 2 END, 6) AS x, round(CASE WHEN n = 1 THEN h / 2 ELSE h / 2 + (r - 1 - 2 * (i // c)) * ch / 2 END, 6) AS y,
  round(CASE WHEN n = 1 THEN least(1.0, w * 0.86 / rw, h * 0.86 / rh) ELSE least(1.0, cw * 0.78 / rw, ch * 0.78 / rh) END, 9) AS scale FROM m""")
def _grid(spark, d):
    k = F.col("p_partkey")
    sizes = {"width": 300 + F.col("p_size") * F.lit(12.0), "height": 900 - F.col("p_size") * F.lit(11.0), "count": (k % 7 + 1).cast("int"), "mark_width": F.lit(20.0) + k % 160, "mark_height": F.lit(10.0) + k % 30, "angle": ((k * 7) % 180).cast("double")}
    got = P.watermark_grid(read(spark, d, "part").select(k.alias("page"), *(c.alias(n) for n, c in sizes.items())))
    return got.select("page", "mark", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("scale", 9).alias("scale"))


@entry("fill_form", "SELECT r_name AS name, CASE r_name WHEN 'ASIA' THEN 'x' ELSE r_regionkey::VARCHAR END AS value FROM region")
def _form(spark, d):
    return P.fill_form(read(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("value")), {"ASIA": "x"})


@entry("page_markup", "SELECT page_id::INT AS page, 'highlight' AS kind FROM pages UNION ALL SELECT 7, 'note'")
def _markup(spark, d):
    return _marked(read(spark, d, "pages"))


def _marked(pages: DataFrame) -> DataFrame:
    a = pages.select(F.col("page_id").cast("int").alias("page"), F.lit("highlight").alias("kind"), *(F.lit(1.0).alias(c) for c in ("x", "y", "width", "height")), F.lit("#ffff00").alias("color"), F.lit(0.45).alias("opacity"), F.lit(None).cast("string").alias("comment"))
    return P.add_markup(a, [(7, "note", 1.0, 1.0, 2.0, 2.0, "#ffff00", 1.0, "please check")]).select("page", "kind")


_LIST = r"(?is)<li\b[^>]*>(.*?)</li\s*>"


@entry("html_list_items", "SELECT page_id, list_transform(regexp_extract_all(html, '" + _LIST + "', 1), lambda x: regexp_replace(x, '<[^>]*>', '', 'g'))::VARCHAR[] AS items FROM pages")
def _items(spark, d):
    return read(spark, d, "pages").select("page_id", F.transform(F.regexp_extract_all("html", F.lit(_LIST), F.lit(1)), lambda x: F.regexp_replace(x, "<[^>]*>", "")).alias("items"))


_ORDER_TABLES = "WITH o AS (SELECT o_orderkey, o_custkey % 3 AS tables FROM orders), t AS (SELECT o_orderkey, unnest(range(tables))::INT AS tab FROM o WHERE tables > 0) "


@entry("html_tables_text", _ORDER_TABLES + ", r AS (SELECT o_orderkey, tab, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY o_orderkey, tab ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS nth FROM t JOIN lineitem ON l_orderkey = o_orderkey) SELECT o_orderkey, tab AS \"table\", nth::INT AS \"row\", tab || chr(9) || l_linenumber || ' & ' || l_partkey || chr(9) AS cells, (row_number() OVER (PARTITION BY o_orderkey ORDER BY tab, nth) + tab)::INT AS out_row FROM r")
def _tables(spark, d):
    cell = lambda x: F.concat(F.lit("<td class='n'> "), x, F.lit(" </td>"))
    line = lambda n, x: F.concat(F.lit("<TR>"), F.concat(F.lit("<th>"), n.cast("string"), F.lit("</th>")), cell(F.concat(F.lit("<b>"), x["l_linenumber"].cast("string"), F.lit("</b> &\n"), x["l_partkey"].cast("string"))), F.lit("<td></td></TR>"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = read(spark, d, "lineitem").repartition(parts, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("rows"))
    o = read(spark, d, "orders").join(rows, "o_orderkey")
    made = F.transform(F.sequence(F.lit(1), F.col("o_custkey") % 3), lambda n: F.concat(F.lit("<p>text</p><table border=1>"), F.array_join(F.transform("rows", lambda x: line(n - 1, x)), "\n"), F.lit("</table>")))
    pages = o.select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.array_join(made, "")).otherwise("<p>no table</p>").alias("html"))
    return P.stacked_tables(P.tables_of_html(pages, "o_orderkey", "html"), "o_orderkey", "table", "row").select("o_orderkey", "table", "row", F.concat_ws("\t", "cells").alias("cells"), "out_row")


@entry("strip_links", "SELECT page_id, regexp_replace(html, '(?i)</?a(?:\\s[^>]*)?>', '', 'g') AS html FROM pages")
def _links(spark, d):
    return read(spark, d, "pages").select("page_id", TX.strip_links(F.col("html")).alias("html"))


@entry("outside_tables", "SELECT c.l_orderkey, c.l_linenumber FROM lineitem c WHERE NOT EXISTS (SELECT 1 FROM part t WHERE t.p_partkey % 50 = c.l_partkey % 50 AND c.l_quantity BETWEEN t.p_size AND t.p_size + 10 AND c.l_linenumber BETWEEN 0 AND 4)")
def _outside(spark, d):
    return _outside_of(spark, d, read(spark, d, "part"))


def _outside_of(spark, d, parts: DataFrame) -> DataFrame:
    c = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).alias("page"), F.col("l_quantity").alias("cx"), F.col("l_linenumber").alias("cy"))
    t = parts.select((F.col("p_partkey") % 50).alias("page"), F.col("p_size").alias("x0"), (F.col("p_size") + 10).alias("x1"), F.lit(0).alias("y0"), F.lit(4).alias("y1"))
    return P.outside_tables(c, t).select("l_orderkey", "l_linenumber")


@entry("blank_matches", None)
def _blank_matches(spark, d):
    t = read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("doc")).agg(F.collect_set(F.when(F.col("l_linenumber") < 3, F.col("l_partkey") % 60)).alias("source_blank"), F.collect_set(F.when(F.col("l_linenumber") > 2, F.col("l_suppkey") % 64)).alias("rendered_blank"))
    return P.blank_matches(t.withColumns({"source_pages": F.lit(60), "rendered_pages": F.lit(64)}), "doc")


@entry("inline_matches", None)
def _inline_matches(spark, d):
    k = F.col("p_partkey")
    box = [((k % 5) * 0.03 + i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    t = read(spark, d, "part").select((k % 97).alias("page"), k.alias("ord"), *box, (F.col("p_size") % 4).alias("width"), (F.col("p_size") % 3).alias("height"))
    return M.inline_matches(t.filter(F.col("ord") % 2 == 0), t.filter(F.col("ord") % 2 == 1).withColumnRenamed("ord", "block"), "page")


# ---- text ------------------------------------------------------------------------------------------------------------


@entry("mail_merge", "SELECT c_custkey AS index, 'Dear ' || c_name || ', of ' || c_mktsegment || ': ' || c_custkey || '.' AS text, lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INT, '0') || '_' || c_name AS filename FROM customer")
def _mail(spark, d):
    r = read(spark, d, "customer").withColumn("index", F.col("c_custkey"))
    return TX.mail_merge(r, "Dear {{c_name}}, of {{c_mktsegment}}: {{c_custkey}}.", ["c_name", "c_mktsegment", "c_custkey"], "{index:03d}_{c_name}")


@entry("markdown_escape", "SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), '*', '\\*'), '_', '\\_') AS text FROM documents")
def _md(spark, d):
    return read(spark, d, "documents").select("doc_id", X.markdown_escape(F.col("text")).alias("text"))


@entry("html_escape", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS text FROM documents")
def _esc(spark, d):
    return read(spark, d, "documents").select("doc_id", X.html_escape(F.col("text")).alias("text"))


@entry("block_markdown", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '## ' || u WHEN 1 THEN '- ' || u WHEN 2 THEN '1. ' || u ELSE '**' || u || '**' END AS line FROM (SELECT page_id, replace(url, '_', '\\_') AS u FROM pages)")
def _block(spark, d):
    k = F.col("page_id") % 4
    style = F.when(k == 0, "Heading 2").when(k == 1, "List Bullet").when(k == 2, "List Number").otherwise("Normal")
    return read(spark, d, "pages").select("page_id", TX.block_markdown(style, F.col("url"), k == 3, F.lit(False)).alias("line"))


@entry("block_html", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<h1>' || u || '</h1>' WHEN 1 THEN '<li>' || u || '</li>' ELSE '<p><b>' || u || '</b></p>' END AS line FROM (SELECT page_id, replace(url, '&', '&amp;') AS u FROM pages)")
def _block_html(spark, d):
    k = F.col("page_id") % 3
    style = F.when(k == 0, "Heading 1").when(k == 1, "List Bullet").otherwise("Normal")
    return read(spark, d, "pages").select("page_id", TX.block_html(style, F.col("url"), k == 2, F.lit(False)).alias("line"))


@entry("paragraphs_text", "SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _para(spark, d):
    return TX.paragraphs_text(read(spark, d, "conversations"), "conv_id", "turn", "text")


@entry("drop_blank_lines", "SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(regexp_replace(line, '\\s', '', 'g')) <> ''")
def _blank_lines(spark, d):
    return TX.drop_blank_lines(read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")), "line")


# outputs are sources that lost a stretch: texts up to 4,000 characters are compared here as arrays, word_recall_rows takes all
#: All items, and beside each its first 0 to 13 characters, so that empty and short texts are measured, too.
_ITEMS = "s AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -item_id - 1, substr(text, 1, item_id % 14) FROM benchmark)"
_PAIRS = f"WITH {_ITEMS}, p AS (SELECT item_id, text AS a, replace(substr(text, 1, 40) || substr(text, 61), 'th', 'ht') AS b FROM s) "


def _damaged(spark, d) -> DataFrame:
    t = F.col("text")
    items = read(spark, d, "benchmark").select("item_id", "text")
    items = items.unionByName(items.select((-F.col("item_id") - 1).alias("item_id"), F.substring(t, F.lit(1), F.col("item_id") % 14).alias("text")))
    return items.select("item_id", t.alias("source"), F.replace(F.concat(F.substring(t, 1, 40), F.substr(t, F.lit(61))), F.lit("th"), F.lit("ht")).alias("output"))


_NORM = "regexp_replace({0}, '[\\s\\pZ\\p{{Cf}}]', '', 'g')"
_SHINGLES = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"


_COVERAGE = f"""CASE WHEN length(na) = 0 THEN 1.0 WHEN length(nb) = 0 THEN 0.0 WHEN length(na) < 12 THEN len(list_intersect(list_distinct(string_split(na, '')), list_distinct(string_split(nb, '')))) / len(list_distinct(string_split(na, '')))
  ELSE len(list_intersect({_SHINGLES.format("na")}, {_SHINGLES.format("nb")})) / len({_SHINGLES.format("na")}) END"""


@entry("ngram_coverage", _PAIRS + f", n AS (SELECT item_id, {_NORM.format('a')} AS na, {_NORM.format('b')} AS nb FROM p) SELECT item_id, round({_COVERAGE}, 9) AS coverage FROM n")
def _coverage(spark, d):
    return TX.integrity(_damaged(spark, d)).select("item_id", F.round("coverage", 9).alias("coverage"))


def _recall_sql(of: str) -> str:
    """The share of a text's elements that the other one has as often, 1 where it has none."""
    return _PAIRS + f""", x AS (SELECT item_id, unnest({of.format("a")}) AS w FROM p), y AS (SELECT item_id, unnest({of.format("b")}) AS w FROM p),
cx AS (SELECT item_id, w, count(*) AS n FROM x WHERE w <> '' GROUP BY ALL), cy AS (SELECT item_id, w, count(*) AS n FROM y GROUP BY ALL),
z AS (SELECT item_id, sum(least(cx.n, coalesce(cy.n, 0))) / sum(cx.n) AS recall FROM cx LEFT JOIN cy USING (item_id, w) GROUP BY item_id)
SELECT item_id, round(coalesce(recall, 1.0), 9) AS recall FROM p LEFT JOIN z USING (item_id)"""


_WORDS_SQL = "regexp_extract_all(lower({0}), '[a-z]+')"


@entry("word_recall", _recall_sql(_WORDS_SQL))
def _word_recall(spark, d):
    return TX.integrity(_damaged(spark, d)).select("item_id", F.round("word_recall", 9).alias("recall"))


@entry("word_recall_rows", _recall_sql(_WORDS_SQL))
def _word_rows(spark, d):
    return TX.word_recall_by_rows(_damaged(spark, d), "item_id").select("item_id", F.round("word_recall", 9).alias("recall"))


@entry("bigram_recall", _recall_sql("list_transform(list_zip(" + _WORDS_SQL + "[:-2], " + _WORDS_SQL + "[2:]), lambda z: z[1] || ' ' || z[2])"))
def _bigram(spark, d):
    return TX.integrity(_damaged(spark, d)).select("item_id", F.round("pair_recall", 9).alias("recall"))


@entry("char_recall", _recall_sql("string_split(" + _NORM + ", '')"))
def _char(spark, d):
    return TX.integrity(_damaged(spark, d)).select("item_id", F.round("char_recall", 9).alias("recall"))


_GATES = _PAIRS + f""", n AS (SELECT item_id, {_NORM.format("a")} AS na, {_NORM.format("b")} AS nb, {_WORDS_SQL.format("a")} AS wa, {_WORDS_SQL.format("b")} AS wb FROM p),
k AS (SELECT item_id, 'c' AS kind, unnest(string_split(na, '')) AS v, 0 AS side FROM n UNION ALL SELECT item_id, 'c', unnest(string_split(nb, '')), 1 FROM n
  UNION ALL SELECT item_id, 'w', unnest(wa), 0 FROM n UNION ALL SELECT item_id, 'w', unnest(wb), 1 FROM n
  UNION ALL SELECT item_id, 'p', unnest(list_transform(list_zip(wa[:-2], wa[2:]), lambda z: z[1] || ' ' || z[2])), 0 FROM n
  UNION ALL SELECT item_id, 'p', unnest(list_transform(list_zip(wb[:-2], wb[2:]), lambda z: z[1] || ' ' || z[2])), 1 FROM n),
m AS (SELECT item_id, kind, v, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM k WHERE v <> '' GROUP BY ALL),
r AS (SELECT item_id, kind, sum(least(x, y)) / nullif(sum(x), 0) AS recall, sum(least(x, y)) / nullif(sum(y), 0) AS back FROM m GROUP BY ALL),
g AS (SELECT n.item_id, CASE WHEN length(na) = 0 THEN 1.0 WHEN length(nb) = 0 THEN 0.0 WHEN length(na) < 12 THEN len(list_intersect(list_distinct(string_split(na, '')), list_distinct(string_split(nb, '')))) / len(list_distinct(string_split(na, '')))
  ELSE len(list_intersect({_SHINGLES.format("na")}, {_SHINGLES.format("nb")})) / len({_SHINGLES.format("na")}) END AS cov,
  coalesce(w.recall, 1.0) AS wr, coalesce(q.recall, 1.0) AS pr, coalesce(c.recall, 1.0) AS cr, coalesce(c.back, 1.0) AS cp FROM n
  LEFT JOIN r w ON w.item_id = n.item_id AND w.kind = 'w' LEFT JOIN r q ON q.item_id = n.item_id AND q.kind = 'p' LEFT JOIN r c ON c.item_id = n.item_id AND c.kind = 'c')
SELECT item_id, CASE WHEN cov < 0.8 OR wr < 0.8 OR pr < 0.7 THEN 'fail' WHEN cov < 0.95 OR wr < 0.95 OR pr < 0.9 THEN 'warn' ELSE 'pass' END AS editable, CASE WHEN cov < 0.9 OR wr < 0.9 OR pr < 0.9 THEN 'fail' ELSE 'pass' END AS hybrid,
  cov >= 0.985 AND cr >= 0.995 AND ((cr >= 0.9995 AND cp >= 0.9995 AND cov >= 0.995) OR (wr >= 0.985 AND pr >= 0.97)) AS rewrite FROM g"""


@entry("integrity_gates", _GATES)
def _gates(spark, d):
    p = TX.integrity(_damaged(spark, d))
    return p.select("item_id", TX.gate("editable").alias("editable"), TX.gate("hybrid").alias("hybrid"), TX.verdict().alias("rewrite"))


_LOST = "WITH p AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN replace(text, ' ', '') ELSE text END AS a, CASE WHEN item_id % 3 = 0 THEN replace(text, 'th', 'ht') ELSE text END AS b FROM benchmark)"
_COVERED = "CASE WHEN length({0}) = 0 THEN 1.0 WHEN length({1}) = 0 THEN 0.0 WHEN length({0}) < 12 THEN len(list_intersect(list_distinct(string_split({0}, '')), list_distinct(string_split({1}, '')))) / len(list_distinct(string_split({0}, ''))) ELSE len(list_intersect({2}, {3})) / len({2}) END"
_COMPACT = _COVERED.format("ca", "cb", _SHINGLES.format("ca"), _SHINGLES.format("cb"))
_QUALITY = _GATES[len(_PAIRS) : _GATES.rindex("SELECT item_id, CASE WHEN cov")]


@entry("candidate_quality", f"""{_LOST}{_QUALITY.rstrip()}, j AS (SELECT item_id, wa, wb, array_to_string(wa, '') AS ca, array_to_string(wb, '') AS cb FROM n),
f AS (SELECT item_id, len(wb) >= len(wa) + 2 AND len(wb) >= ceil(len(wa) * 1.2) AND len(list_filter(wa, lambda x: length(x) >= 18)) > 0 AND {_COMPACT} >= 0.98 AS more FROM j)
SELECT item_id, cov >= 0.92 AND more AS recovered, (cov >= 0.92 AND more) OR (cov >= 0.8 AND wr >= 0.8 AND pr >= 0.7) AS text_passed FROM g JOIN f USING (item_id)""")
def _quality(spark, d):
    t, k = F.col("text"), F.col("item_id")
    lost = F.when(k % 2 == 0, F.replace(t, F.lit(" "), F.lit(""))).otherwise(t)
    swapped = F.when(k % 3 == 0, F.replace(t, F.lit("th"), F.lit("ht"))).otherwise(t)
    return TX.candidate_quality(read(spark, d, "benchmark").select("item_id", lost.alias("source"), swapped.alias("output"))).select("item_id", "recovered", "text_passed")


_MIXED = "regexp_extract_all(regexp_replace(regexp_replace(text, '([A-Za-z])[-‐‑][\\s\\pZ]*([A-Za-z])', '\\1\\2', 'g'), '([A-Za-z])[-‐‑][\\s\\pZ]*([A-Za-z])', '\\1\\2', 'g'), '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*|[\\x{3400}-\\x{9fff}]')"


@entry("mixed_words", f"SELECT doc_id, len(w) AS n_words, lower(array_to_string(w, ' ')) AS words FROM (SELECT doc_id, {_MIXED} AS w FROM documents)")
def _mixed_words(spark, d):
    w = X.mixed_words(F.col("text"))
    return read(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words"))


_TURNS = "WITH b AS (SELECT conv_id, turn, " + _WORDS_SQL.format("text") + " AS w FROM conversations), o AS (SELECT conv_id, " + _WORDS_SQL.format("replace(string_agg(text, ' ' ORDER BY turn, text), 'an', 'na')") + " AS w FROM conversations GROUP BY conv_id), "
_NEXT = "unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) AS v"


@entry("block_pair_recall", _TURNS + f"x AS (SELECT conv_id, {_NEXT} FROM b), y AS (SELECT conv_id, {_NEXT} FROM o), cx AS (SELECT conv_id, v, count(*) AS n FROM x GROUP BY ALL), cy AS (SELECT conv_id, v, count(*) AS n FROM y GROUP BY ALL), r AS (SELECT conv_id, sum(least(cx.n, coalesce(cy.n, 0))) / sum(cx.n) AS recall FROM cx LEFT JOIN cy USING (conv_id, v) GROUP BY conv_id) SELECT conv_id, round(coalesce(recall, 1.0), 9) AS recall FROM o LEFT JOIN r USING (conv_id)")
def _block_pairs(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    out = whole.select("conv_id", F.replace(F.array_join(F.transform("t", lambda x: x["text"]), " "), F.lit("an"), F.lit("na")).alias("output"))
    return TX.block_pair_recall(c, out, "conv_id").select("conv_id", F.round("pair_recall", 9).alias("recall"))


@entry("suspicious_chars", "SELECT doc_id, regexp_matches(text, '[\\x{FFFD}\\p{Co}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]') AS suspicious FROM documents")
def _suspicious(spark, d):
    return read(spark, d, "documents").select("doc_id", X.suspicious(F.col("text")).alias("suspicious"))


_COUNTED = "SELECT event_id, user_id % 40 AS doc, (event_id % 9 + 1) || ' / ' || (event_id % 5 + 3) AS t FROM events"


@entry("counter_conflict", f"WITH e AS ({_COUNTED}), c AS (SELECT doc, trim(string_split(t, '/')[1])::INT AS cur, trim(string_split(t, '/')[2])::INT AS total FROM e) SELECT doc, total, count(DISTINCT cur) AS currents FROM c WHERE cur <= total GROUP BY ALL HAVING count(DISTINCT cur) > 1")
def _conflict(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 40).alias("doc"), F.concat((F.col("event_id") % 9 + 1).cast("string"), F.lit(" / "), (F.col("event_id") % 5 + 3).cast("string")).alias("t"))
    return TX.counter_conflicts(e, "doc", "t")


@entry("counter_adjacent", "WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'text' ELSE (event_id % 2 + 1) || '/9' END AS t FROM events), l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM e) SELECT event_id, t FROM l WHERE t = 'text' OR p IS NULL OR p <> t")
def _adjacent(spark, d):
    t = F.when(F.col("event_id") % 3 == 0, "text").otherwise(F.concat((F.col("event_id") % 2 + 1).cast("string"), F.lit("/9")))
    return TX.drop_repeated_counters(read(spark, d, "events").select("event_id", "user_id", t.alias("t")), "user_id", "event_id", "t").select("event_id", "t")


@entry("cjk_spacing", "SELECT r_regionkey, '中文 ' || r_name || ' 字' AS text FROM region")
def _cjk(spark, d):
    return read(spark, d, "region").select("r_regionkey", X.cjk_spacing(F.concat(F.lit("中 文"), F.col("r_name"), F.lit("字"))).alias("text"))


@entry("font_map", "SELECT p_partkey, CASE lower(p_brand) WHEN 'brand#11' THEN 'one' WHEN 'brand#12' THEN 'two' ELSE 'rest' END AS font FROM part")
def _font(spark, d):
    return read(spark, d, "part").select("p_partkey", TX.map_fonts(F.col("p_brand"), {"BRAND#11": "one", "Brand#12": "two"}, "rest").alias("font"))


@entry("revisions", "SELECT event_id FROM events WHERE event_type <> 'error'")
def _revisions(spark, d):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "insert")
    return TX.apply_revisions(read(spark, d, "events").select("event_id", kind.alias("revision")), "accept").select("event_id")


# ---- media -----------------------------------------------------------------------------------------------------------


@entry("sha_dedupe_manifest", "SELECT doc_id, sha256(text) AS sha256, CASE WHEN min(doc_id) OVER (PARTITION BY sha256(text)) <> doc_id THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of FROM documents")
def _sha(spark, d):
    return M.duplicates(read(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "sha256", "duplicate_of")


@entry("media_members", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS number, 'b_' || lpad((row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey))::VARCHAR, greatest(3, length((row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey))::VARCHAR))::INT, '0') || '_image' || p_size || '-' || p_partkey || '.png' AS out_name FROM part")
def _members(spark, d):
    return _member_names(read(spark, d, "part"))


def _member_names(parts: DataFrame) -> DataFrame:
    t = parts.select("p_partkey", F.concat(F.col("p_brand"), F.lit("/b.xlsx")).alias("path"), F.concat(F.lit("xl/media/image"), F.col("p_size").cast("string"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"))
    return M.members(t, "path", "name", "xl/media/", M.IMAGE_SUFFIXES).select("p_partkey", F.col("number").cast("long").alias("number"), "out_name")


@entry("resize_fit", "SELECT p_partkey, greatest(1, round_even(w * least(200 / w, 100 / h), 0))::INT AS width, greatest(1, round_even(h * least(200 / w, 100 / h), 0))::INT AS height FROM (SELECT p_partkey, (p_size * 10 + 7)::DOUBLE AS w, (p_partkey % 97 + 5)::DOUBLE AS h FROM part)")
def _fit(spark, d):
    t = read(spark, d, "part").select("p_partkey", (F.col("p_size") * 10 + 7).cast("double").alias("w"), (F.col("p_partkey") % 97 + 5).cast("double").alias("h"))
    w, h = M.fit(F.col("w"), F.col("h"), 200, 100)
    return t.select("p_partkey", w.alias("width"), h.alias("height"))


@entry("stitch_offsets", "SELECT p_partkey, floor((max(p_size) OVER (PARTITION BY p_brand) - p_size) / 2)::BIGINT AS x, coalesce(sum(p_size * 2 + 3) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS y, (sum(p_size * 2) OVER (PARTITION BY p_brand) + 3 * (count(*) OVER (PARTITION BY p_brand) - 1))::BIGINT AS canvas_height FROM part")
def _stitch(spark, d):
    t = read(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").alias("width"), (F.col("p_size") * 2).alias("height"))
    return M.stitch(t, "p_brand", "p_partkey", spacing=3).select("p_partkey", "x", "y", "canvas_height")


@entry("rename_index", "SELECT s_suppkey, 'photo_' || lpad((row_number() OVER (ORDER BY s_suppkey))::VARCHAR, greatest(3, length((row_number() OVER (ORDER BY s_suppkey))::VARCHAR))::INT, '0') || '.jpg' AS new_name FROM supplier")
def _rename(spark, d):
    return _new_names(read(spark, d, "supplier"))


def _new_names(files: DataFrame) -> DataFrame:
    t = files.select("s_suppkey", F.col("s_name").alias("stem"), F.lit("jpg").alias("suffix"))
    return M.renamed(t, "s_suppkey", "stem", "suffix", "photo_{index:03d}").select("s_suppkey", "new_name")


@entry("histogram_stats", "WITH h AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT p_brand, sum(n) AS t FROM h GROUP BY 1) SELECT p_brand, count(*) AS colors, round(max(n) / first(t), 9) AS dominant, round(sum(-(n / t) * log2(n / t)), 9) AS entropy FROM h JOIN t USING (p_brand) GROUP BY p_brand")
def _hist(spark, d):
    return M.histogram_stats(read(spark, d, "part"), "p_brand", "p_size").select("p_brand", "colors", F.round("dominant", 9).alias("dominant"), F.round("entropy", 9).alias("entropy"))


@entry("best_quality", "SELECT p_brand, coalesce(max(p_size) FILTER (p_retailprice <= 1200), min(p_size)) AS p_size FROM part WHERE p_size >= 10 GROUP BY 1")
def _quality(spark, d):
    return M.best_quality(read(spark, d, "part"), "p_brand", "p_size", "p_retailprice", 1200, 10)


@entry("slideshow_frames", "WITH s AS (SELECT r_regionkey AS slide, lead(r_regionkey) OVER (ORDER BY r_regionkey) AS nxt, row_number() OVER (ORDER BY r_regionkey) - 1 AS n FROM region), f AS (SELECT *, unnest(range(CASE WHEN nxt IS NULL THEN 4 ELSE 6 END)) AS k FROM s) SELECT n * 6 + k AS frame, slide, CASE WHEN k >= 4 THEN nxt END AS next_slide, CASE WHEN k >= 4 THEN (k - 3) / 3.0::DOUBLE ELSE 0.0 END AS alpha FROM f")
def _crossfade(spark, d):
    return M.crossfade(read(spark, d, "region").select(F.col("r_regionkey").alias("k")), "k", 4, 1.0, 0.5)


@entry("pixels_mosaic", None)
def _pixels(spark, d):
    img = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.pmod((x * 1000).cast("int"), F.lit(256))), 2, "0")), "")).alias("data"))
    return M.map_pixels(img, M.mosaic(4)).select("key", "width", "height", F.sha2("data", 256).alias("pixels"))


# ---- frames ----------------------------------------------------------------------------------------------------------

_BITS = "list_reduce(list_prepend(0::BIGINT, list_transform(embedding, lambda x: (x > list_sort(embedding[2:])[32])::BIGINT)), lambda a, b: CASE WHEN a >= 4611686018427387904 OR a < -4611686018427387904 THEN xor(a << 1, 0) ELSE a * 2 END + b)"
_BITSTRING = "array_to_string(list_transform(embedding, lambda x: CASE WHEN x > list_sort(embedding[2:])[32] THEN '1' ELSE '0' END), '')"


def _hashes(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", FR.hash_bits(F.col("embedding")).alias("bits"))


@entry("phash_bits", f"SELECT vec_id, {_BITSTRING} AS bits FROM embeddings")
def _bits(spark, d):
    return _hashes(spark, d).select("vec_id", F.lpad(F.bin("bits"), 64, "0").alias("bits"))


_NEAR = 12


@entry("phash_classes", f"""WITH h AS (SELECT vec_id, ({_BITSTRING})::BIT AS b FROM embeddings)
SELECT y.vec_id, (SELECT min(x.vec_id) FROM h x WHERE x.vec_id < y.vec_id AND bit_count(xor(x.b, y.b)) <= {_NEAR}) AS near_before FROM h y""")
def _classes(spark, d):
    return FR.nearest_before(_hashes(spark, d), "vec_id", "bits", _NEAR).select("vec_id", "near_before")


_T = "epoch(ts)"


def _signal(spark, d) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return read(spark, d, "events").select("event_id", "user_id", (micros / 1000000.0).alias("t"), "value")


@entry("sample_ticks", "WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS t FROM events), s AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS t0, max(t) OVER (PARTITION BY user_id) AS t1 FROM e), k AS (SELECT *, floor((t - t0) / greatest(1.0, (t1 - t0) / 50))::BIGINT AS tick FROM s) SELECT user_id, tick, min(t) AS t FROM k GROUP BY user_id, tick")
def _ticks(spark, d):
    return FR.sample_ticks(_signal(spark, d), "user_id", "t", most=50).select("user_id", "tick", "t")


_CHANGES = "WITH c AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS t, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS change FROM events) "
_MAD = _CHANGES + ", m AS (SELECT user_id, quantile_cont(change, 0.5) AS med FROM c GROUP BY 1), v AS (SELECT user_id, first(med) AS med, quantile_cont(abs(change - med), 0.5) AS mad FROM c JOIN m USING (user_id) GROUP BY 1), h AS (SELECT user_id, coalesce(greatest(5.0, med + 1.0 * mad), 5.0) AS threshold FROM v) "


@entry("change_metrics", _CHANGES + "SELECT event_id, round(change, 9) AS change FROM c")
def _change(spark, d):
    return FR.changes(_signal(spark, d), "user_id", "t", "value", "event_id").select("event_id", F.round("change", 9).alias("change"))


@entry("mad_threshold", _MAD + "SELECT user_id, round(threshold, 9) AS threshold FROM h")
def _mad(spark, d):
    c = FR.changes(_signal(spark, d), "user_id", "t", "value", "event_id")
    return FR.thresholds(c, "user_id", 5.0, times=1.0).groupBy("user_id").agg(F.round(F.first("threshold"), 9).alias("threshold"))


def _flagged(spark, d) -> DataFrame:
    c = FR.thresholds(FR.changes(_signal(spark, d), "user_id", "t", "value", "event_id"), "user_id", 5.0, times=1.0)
    return c.withColumn("flag", F.coalesce(F.col("change") > F.col("threshold"), F.lit(False)))


@entry("segments", _MAD + ", f AS (SELECT c.*, coalesce(change > threshold, false) AS flag FROM c JOIN h USING (user_id)), s AS (SELECT *, sum(flag::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS segment FROM f) SELECT user_id, segment::BIGINT AS segment, min(t) AS first_ts, max(t) AS last_ts, count(*) AS frames FROM s GROUP BY user_id, segment")
def _segments(spark, d):
    return FR.segments(_flagged(spark, d), "user_id", "t", "flag", "event_id")


@entry("accepted_boundaries", _MAD.replace("WITH c", "WITH RECURSIVE c", 1) + """, f AS (SELECT c.event_id, c.user_id, t FROM c JOIN h USING (user_id) WHERE change > threshold),
a AS (SELECT user_id, min(t) AS t FROM f GROUP BY user_id UNION ALL SELECT user_id, t FROM (SELECT a.user_id, min(f.t) AS t FROM a JOIN f ON f.user_id = a.user_id AND f.t - a.t >= 3600 GROUP BY a.user_id, a.t)),
k AS (SELECT min(event_id) AS event_id FROM f JOIN a USING (user_id, t) GROUP BY user_id, t) SELECT event_id, event_id IN (SELECT event_id FROM k) AS boundary FROM events""")
def _accepted(spark, d):
    return FR.accepted_boundaries(_flagged(spark, d), "user_id", "t", "flag", 3600.0, "event_id").select("event_id", "boundary")


@entry("merged_segments", None)
def _merged(spark, d):
    s = FR.segments(_flagged(spark, d), "user_id", "t", "flag", "event_id").withColumn("level", F.col("frames") * 1.0)
    return FR.merge_segments(s, "user_id", least=2, near=0.5)


@entry("stability_support", """
WITH c AS (SELECT event_id, user_id AS u, epoch_us(ts) / 1000000.0 / 100000.0 AS t, value AS v FROM events),
a AS (SELECT *, row_number() OVER w AS n, t - lag(t) OVER w AS gap, abs(v - lag(v) OVER w) AS off FROM c WINDOW w AS (PARTITION BY u ORDER BY t, event_id)),
q AS (SELECT u, max(n) AS last_n, coalesce(least(1.05, greatest(0.3, 2.25 * quantile_cont(gap, 0.3) FILTER (gap > 1e-6))), 0.3) AS reach FROM a GROUP BY u),
s AS (SELECT a.*, last_n, reach, coalesce(gap > 1e-6 AND gap <= reach + 1e-6 AND off <= 40, false) AS still FROM a JOIN q USING (u)),
r AS (SELECT *, sum((NOT still)::INT) OVER (PARTITION BY u ORDER BY n) AS run FROM s),
w AS (SELECT x.u, x.n AS lo, z.n AS hi FROM r x JOIN r y ON y.u = x.u AND y.n = x.n + 1 JOIN r z ON z.u = x.u AND z.run = y.run AND z.n >= x.n + 2
  WHERE z.t - x.t >= 0.55 AND z.t - x.t <= greatest(1.15, least(2.5, x.reach * 2.2)) AND abs(z.v - x.v) <= 25),
b AS (SELECT r.event_id, r.u, r.n, last_n, count(w.lo) AS support FROM r LEFT JOIN w ON w.u = r.u AND r.n BETWEEN lo AND hi GROUP BY ALL),
e AS (SELECT z.u, z.still AS calm, coalesce(z.still AND y.still AND x.still AND z.t - k.t >= 0.32 AND abs(z.v - k.v) <= 25, false) AS short
  FROM r z LEFT JOIN r y ON y.u = z.u AND y.n = z.n - 1 LEFT JOIN r x ON x.u = z.u AND x.n = z.n - 2 LEFT JOIN r k ON k.u = z.u AND k.n = z.n - 3 WHERE z.n = z.last_n)
SELECT event_id, support + CASE WHEN max(support) OVER (PARTITION BY u) > 0 THEN (short AND last_n - n < 4)::INT + (calm AND last_n - n < 2)::INT ELSE 0 END AS support FROM b JOIN e USING (u)""")
def _stable(spark, d):
    near = lambda most: lambda x, y: F.abs(y["value"] - x["value"]) <= most
    c = _signal(spark, d).select("event_id", "user_id", "value", (F.col("t") / 100000.0).alias("t"))
    return FR.stable_support(c, "user_id", "t", near(40), near(25), "event_id").select("event_id", "support")


@entry("choose_candidate", "WITH b AS (SELECT p_brand, p_partkey, p_retailprice AS s, max(p_retailprice) OVER (PARTITION BY p_brand) AS top FROM part WHERE p_size > 25 OR p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 25)) SELECT p_brand, max(p_partkey) AS p_partkey FROM b WHERE s >= top - 50 GROUP BY 1")
def _choose(spark, d):
    t = read(spark, d, "part").withColumn("support", (F.col("p_size") > 25).cast("int"))
    return FR.choose(t, "p_brand", "p_retailprice", "support", "p_partkey", 50).select("p_brand", "p_partkey")


def _slides(spark, d) -> DataFrame:
    e = _signal(spark, d).withColumn("slide", F.col("event_id") % 7)
    return e.groupBy("user_id", "slide").agg(F.collect_list(F.struct(F.round("t").alias("start"), (F.round("t") + F.floor(F.abs("value")) % 11).alias("end"))).alias("occurrences"), F.max("t").alias("duration"))


_OCC = "WITH o AS (SELECT user_id, event_id % 7 AS slide, round(epoch_us(ts) / 1000000.0) AS s, round(epoch_us(ts) / 1000000.0) + floor(abs(value))::BIGINT % 11 AS e FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, slide ORDER BY s, e) AS n FROM o), f AS (SELECT user_id, slide, s AS fs, e AS fe FROM r WHERE n = 1), a AS (SELECT f.user_id, f.slide, fs, CASE WHEN fe - fs <= 2.25 THEN coalesce((SELECT r.s FROM r WHERE r.user_id = f.user_id AND r.slide = f.slide AND r.n > 1 AND r.e - r.s >= greatest(4.0, (fe - fs) * 2.5) ORDER BY r.n LIMIT 1), fs) ELSE fs END AS anchor_start FROM f) "


@entry("occurrence_anchor", _OCC + "SELECT user_id, slide, anchor_start FROM a")
def _anchor(spark, d):
    return _slides(spark, d).select("user_id", "slide", FR.anchor(F.col("occurrences"))["start"].alias("anchor_start"))


@entry("timeline_order", _OCC + "SELECT user_id, slide, CASE WHEN anchor_start = fs THEN 'first_occurrence' ELSE 'short_preview_deferred' END AS reason, row_number() OVER (PARTITION BY user_id ORDER BY anchor_start, fs, slide) AS position FROM a")
def _timeline(spark, d):
    return FR.timeline(_slides(spark, d), "user_id", "occurrences", "slide").select("user_id", "slide", "reason", F.col("position").cast("long").alias("position"))


@entry("timeline_faults", _OCC + ", d AS (SELECT user_id, median(t) AS until FROM (SELECT user_id, epoch_us(ts) / 1000000.0 AS t FROM events) GROUP BY 1) SELECT user_id, slide FROM a JOIN d USING (user_id) WHERE anchor_start > until + 0.05")
def _faults(spark, d):
    half = _signal(spark, d).groupBy("user_id").agg(F.percentile("t", F.lit(0.5)).alias("until"))  # a recording that ends too soon
    t = FR.timeline(_slides(spark, d), "user_id", "occurrences", "slide").join(half, "user_id").withColumn("duration", F.col("until"))
    return FR.timeline_faults(t, "user_id", "duration").select("user_id", "slide")


@entry("nearest_stable", "WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0 AS t, floor(abs(value))::BIGINT % 5 AS support, value AS quality FROM events), q AS (SELECT event_id, user_id, t FROM e) SELECT q.event_id, (SELECT f.t FROM e f WHERE f.user_id = q.user_id AND abs(f.t - q.t) <= 40000 ORDER BY f.support DESC, f.quality DESC, f.t DESC LIMIT 1) AS frame_ts FROM q")
def _nearest(spark, d):
    f = _signal(spark, d).withColumns({"support": F.floor(F.abs("value")) % 5, "quality": F.col("value")})
    r = f.select("event_id", "user_id", "t")
    return FR.nearest_stable(r, f.select("user_id", F.col("t").alias("ft"), "support", "quality"), "user_id", "t", "ft", "support", "quality", 40000.0).select("event_id", "frame_ts")


@entry("gray_correlation", "SELECT p_brand, round(corr(p_size, p_retailprice), 9) AS correlation FROM part GROUP BY 1")
def _corr(spark, d):
    t = read(spark, d, "part").select("p_brand", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return FR.gray_correlation(t, ["p_brand"], "a", "b").select("p_brand", F.round("correlation", 9).alias("correlation"))


@entry("modal_medoid", "WITH c AS (SELECT l_suppkey, floor(l_quantity / 16) AS cell, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, arg_max(cell, n * 1000 - cell) AS cell FROM c GROUP BY 1) SELECT l.l_suppkey, (min({'o': abs(l_quantity - (m.cell * 16 + 7.5)), 'k': l_orderkey, 'v': l_quantity})).v AS l_quantity FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey AND floor(l_quantity / 16) = m.cell GROUP BY 1")
def _medoid(spark, d):
    return FR.modal_medoid(read(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_orderkey")


@entry("multiframe_fuse", """
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS nr, l_quantity::DOUBLE AS q, (l_partkey % 20)::DOUBLE AS p, l_extendedprice AS sharp, l_discount AS d FROM lineitem),
m AS (SELECT k, quantile_cont(q, 0.5) AS mq, quantile_cont(p, 0.5) AS mp, max(d) AS edge FROM s GROUP BY k),
o AS (SELECT s.*, edge, (abs(q - mq) + abs(p - mp)) / 2 AS off FROM s JOIN m USING (k)),
a AS (SELECT *, quantile_cont(off, 0.5) OVER (PARTITION BY k) AS mad, 1 / (1 + (off / 4) * (off / 4)) AS w FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY off <= greatest(7, mad * 2.5 + 2) DESC, sharp DESC, nr, q, p) AS place FROM a),
g AS (SELECT k, mad <= 5.5 AS stable, sum(w) AS total, sum(w * q) / sum(w) * (1 - edge) + max(q) FILTER (place = 1) * edge AS q, sum(w * p) / sum(w) * (1 - edge) + max(p) FILTER (place = 1) * edge AS p FROM r GROUP BY k, mad, edge)
SELECT k AS l_orderkey, stable, round(total, 6) AS total, CASE WHEN stable AND total >= 1.5 THEN round(least(255, q), 6) END AS q, CASE WHEN stable AND total >= 1.5 THEN round(least(255, p), 6) END AS p FROM g""")
def _fuse(spark, d):
    t = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_partkey") % 20).alias("p"), "l_extendedprice", "l_discount")
    f = FR.fuse(t, ["l_orderkey"], "l_linenumber", ["q", "p"], "l_extendedprice", "l_discount")
    return f.select("l_orderkey", "stable", *(F.round(c, 6).alias(c) for c in ("total", "q", "p")))


@entry("repair_plan", None)
def _repair(spark, d):
    p = read(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("doc"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("at"), F.col("n_name").alias("value"))
    a = spark.createDataFrame([(i, 1, "insert_page", 2, "new") for i in range(5)] + [(0, 2, "replace_page_frame", 1, "frame"), (0, 3, "repair_region", 1, "box")], "doc long, ord int, kind string, at int, value string")
    return FR.apply_plan(p, a)


def _pictures(spark, d) -> DataFrame:
    """Vectors as pictures of 8 by 8 pixels: a signal of grey levels, edges where it is positive, ink and notes where it is high."""
    k, v = F.col("vec_id"), F.col("embedding")
    byte = lambda x: F.lpad(F.hex(F.pmod((x * 1000).cast("int"), F.lit(256))), 2, "0")
    over = lambda least: lambda x: F.when(x > least, "01").otherwise("00")
    image = lambda one: F.unhex(F.array_join(F.transform(v, one), ""))
    size = (F.lit(8).alias("width"), F.lit(8).alias("height"))
    return read(spark, d, "embeddings").select((k % 50).alias("seq"), k.alias("vec_id"), (F.floor(k / 50) * 0.5).alias("ts"), *size, image(byte).alias("gray"), image(over(0)).alias("edges"), image(over(0.1)).alias("ink"), image(over(0.25)).alias("notes"), FR.hash_bits(v).alias("hash"))


@entry("video_slides", None)
def _video_slides(spark, d):
    return SC.slides(_pictures(spark, d))


@entry("accepted_slides", None)
def _accepted_slides(spark, d):
    p = _pictures(spark, d).withColumnRenamed("vec_id", "segment")
    again = p.withColumn("segment", -F.col("segment") - 1)  # the same pictures, shown before
    scored = p.unionByName(again).withColumns({"score": F.pmod("segment", F.lit(7)) / 7, "doubtful": F.pmod("segment", F.lit(3))})
    return SC.accepted_slides(scored)


@entry("same_structure", None)
def _same_structure(spark, d):
    p, k = _pictures(spark, d), F.col("vec_id")
    tall = lambda c: F.concat(*[F.col(c)] * 4)
    side = lambda s, ink: [tall("gray").alias(f"gray_{s}"), tall("edges").alias(f"edges_{s}"), tall(ink).alias(f"ink_{s}")]
    none = F.lit(None).cast("binary").alias("ignored")
    first = p.select(k.alias("a"), "width", (F.col("height") * 4).alias("height"), none, *side("a", "notes"))
    second = p.select(k.alias("b"), (k - k % 2).alias("a"), *side("b", "notes"))  # even pictures against themselves and the next one
    return SC.same_structure(first.join(second, "a")).select("a", "b", "same")


@entry("connected_boxes", None)
def _connected(spark, d):
    return G.connected_boxes(_pictures(spark, d).select(F.col("vec_id").alias("key"), "width", "height", F.col("edges").alias("mask")))


# ---- geometry --------------------------------------------------------------------------------------------------------


@entry("interval_merge", "WITH i AS (SELECT l_suppkey, l_partkey AS lo, l_partkey + l_quantity::BIGINT AS hi FROM lineitem), r AS (SELECT *, max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), k AS (SELECT *, sum((reach IS NULL OR lo > reach + 3)::INT) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM r) SELECT l_suppkey, min(lo) AS lo, max(hi) AS hi, count(*) AS merged FROM k GROUP BY l_suppkey, isl")
def _intervals(spark, d):
    t = read(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("hi"))
    return G.merge_intervals(t, ["l_suppkey"], "lo", "hi", 3)


@entry("rule_groups", None)
def _rule_groups(spark, d):
    x0, y = (F.col("l_partkey") % 5) * 20.0, (F.col("l_orderkey") % 50) * 15.0
    box = {"x0": x0, "x1": x0 + 40 + F.col("l_quantity") * 8, "y0": y, "y1": y + 1, "page_width": F.lit(612.0), "page_height": F.lit(792.0)}
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return G.rule_groups(read(spark, d, "lineitem").withColumns({**box, "page": F.floor(F.col("l_orderkey") / 50), "key": key}))


def _lines(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("page"), (F.col("l_partkey") % 300).cast("double").alias("x0"), (F.col("l_partkey") % 300 + F.col("l_quantity") * 4).alias("x1"), F.col("l_quantity").alias("weight"))


_LINES = "WITH l AS (SELECT l_orderkey % 200 AS page, (l_partkey % 300)::DOUBLE AS x0, l_partkey % 300 + l_quantity * 4 AS x1, l_quantity AS weight FROM lineitem) "


@entry("column_profile", _LINES + "SELECT page, coalesce(sum(weight) FILTER (x1 <= 250), 0) AS left_weight, coalesce(sum(weight) FILTER (x0 >= 250), 0) AS right_weight, coalesce(sum(weight) FILTER (x1 > 250 AND x0 < 250), 0) AS across_weight, count(*) FILTER (x1 <= 250) AS left_lines FROM l GROUP BY page")
def _profile(spark, d):
    return G.column_profile(_lines(spark, d), "page", F.lit(250.0)).select("page", *(F.col(c).cast("double").alias(c) for c in ("left_weight", "right_weight", "across_weight")), "left_lines")


@entry("best_split", _LINES + ", s AS (SELECT page, split, coalesce(sum(weight) FILTER (x1 <= split * 500.0 / 100), 0) AS l, coalesce(sum(weight) FILTER (x0 >= split * 500.0 / 100), 0) AS r FROM l, range(22, 79) t(split) GROUP BY ALL) SELECT page, arg_max(split, {'s': round(l + r + 0.35 * least(l, r), 6), 'k': -split})::INT AS split, round(max(l + r + 0.35 * least(l, r)), 6) AS score FROM s GROUP BY page")
def _best(spark, d):
    return G.best_split(_lines(spark, d), "page", 500.0).select("page", F.col("split").cast("int").alias("split"), F.round("score", 6).alias("score"))


@entry("layout_choice", """WITH s AS (SELECT p_partkey, p_size * 40.0::DOUBLE + 100 AS width, p_partkey % 37 * 60.0::DOUBLE + 200 AS height FROM part),
p(paper, pw, ph, i) AS (VALUES ('A4', 595.0::DOUBLE, 842.0::DOUBLE, 0), ('A3', 842.0, 1191.0, 1)), m(margin, mm, k) AS (VALUES ('normal', 50.0::DOUBLE, 0), ('narrow', 18.0, 1)), t(orientation, j) AS (VALUES ('portrait', 0), ('landscape', 1)),
c AS (SELECT *, pw * ph AS area, greatest(72.0, CASE j WHEN 0 THEN pw ELSE ph END - 2 * mm) AS uw, greatest(72.0, CASE j WHEN 0 THEN ph ELSE pw END - 2 * mm) AS uh FROM s, p, m, t),
z AS (SELECT *, least(1.0, uw / greatest(1.0, width)) AS scale FROM c),
n AS (SELECT *, greatest(1, ceil(greatest(1.0, height) * scale / uh - 1e-9))::BIGINT AS n_pages, scale >= 0.9 AS ok FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY ok DESC, CASE WHEN ok THEN area ELSE -scale END, CASE WHEN ok THEN -scale ELSE area END, n_pages, k, CASE WHEN ok THEN j ELSE 0 END, i, j) AS nth FROM n)
SELECT p_partkey, width, height, paper, orientation, margin, n_pages, scale FROM r WHERE nth = 1""")
def _layout(spark, d):
    s = read(spark, d, "part").select("p_partkey", (F.col("p_size") * 40.0 + 100).alias("width"), (F.col("p_partkey") % 37 * 60.0 + 200).alias("height"))
    return G.layout_choice(s, [("A4", 595.0, 842.0), ("A3", 842.0, 1191.0)], [("normal", 50.0), ("narrow", 18.0)])


def _boxes(spark, d) -> DataFrame:
    p = F.col("p_partkey")
    return read(spark, d, "part").select((p % 40).alias("page"), p.alias("key"), (p * 7919 % 1000).cast("double").alias("x0"), (p * 104729 % 1000).cast("double").alias("y0"), (p * 7919 % 1000 + F.col("p_size")).cast("double").alias("x1"), (p * 104729 % 1000 + F.col("p_size")).cast("double").alias("y1"))


_BOXES = "WITH RECURSIVE b AS (SELECT p_partkey % 40 AS page, p_partkey AS k, (p_partkey * 7919 % 1000)::DOUBLE AS x0, (p_partkey * 104729 % 1000)::DOUBLE AS y0, (p_partkey * 7919 % 1000 + p_size)::DOUBLE AS x1, (p_partkey * 104729 % 1000 + p_size)::DOUBLE AS y1 FROM part), e AS (SELECT a.page, a.k AS a, c.k AS b, greatest(0, c.x0 - a.x1, a.x0 - c.x1) AS gx, greatest(0, c.y0 - a.y1, a.y0 - c.y1) AS gy, coalesce(greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) / nullif(least(a.x1 - a.x0, c.x1 - c.x0), 0), 0) AS ox, coalesce(greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) / nullif(least(a.y1 - a.y0, c.y1 - c.y0), 0), 0) AS oy FROM b a JOIN b c ON a.page = c.page AND a.k < c.k), n AS (SELECT page, a, b FROM e WHERE (gx = 0 AND gy = 0) OR (gx <= 4 AND oy >= 0.6) OR (gy <= 4 AND ox >= 0.6)) "


@entry("box_neighbours", _BOXES + "SELECT page, a, b FROM n")
def _neighbours(spark, d):
    return G.neighbours(_boxes(spark, d), "page", "key", 4.0)


@entry("components", _BOXES + ", s AS (SELECT a, b FROM n UNION SELECT b, a FROM n), r AS (SELECT k AS node, k AS root FROM b UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node) SELECT node AS key, min(root) AS cluster FROM r GROUP BY node")
def _components(spark, d):
    return G.clusters(_boxes(spark, d), "page", "key", 4.0).select("key", "cluster")


@entry("greedy_unions", None)
def _greedy(spark, d):
    return G.greedy_unions(_boxes(spark, d).withColumn("ord", F.col("key")), 10.0)


@entry("union_area", None)
def _area(spark, d):
    return G.union_area(_boxes(spark, d))


@entry("reading_order", "WITH i AS (SELECT p_partkey AS key, p_partkey % 20 AS page, p_size::DOUBLE AS cy, CASE WHEN p_partkey % 9 = 0 THEN 'full' WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS col FROM part), b AS (SELECT *, sum((col = 'full')::INT) OVER (PARTITION BY page ORDER BY cy, key) AS band FROM i) SELECT key, row_number() OVER (PARTITION BY page ORDER BY band, CASE col WHEN 'full' THEN 0 WHEN 'left' THEN 1 ELSE 2 END, cy, key) AS position FROM b")
def _reading(spark, d):
    p = F.col("p_partkey")
    t = read(spark, d, "part").select(p.alias("key"), (p % 20).alias("page"), F.col("p_size").cast("double").alias("cy"), F.lit(0.0).alias("x0"), F.when(p % 9 == 0, "full").when(p % 2 == 0, "left").otherwise("right").alias("col"))
    return G.reading_order(t, "page", "key").select("key", F.col("position").cast("long").alias("position"))


@entry("line_rows", None)
def _rows(spark, d):
    p = F.col("p_partkey")
    t = read(spark, d, "part").select((p % 20).alias("page"), (p * 37 % 500).cast("double").alias("x"), (p * 91 % 700).cast("double").alias("y"), F.col("p_size").cast("double").alias("width"), F.col("p_name").alias("text"))
    return G.line_rows(t, 3.0, 20.0)


def _page_lines(spark, d) -> DataFrame:
    p = F.col("p_partkey")
    x = (p * 37 % 700).cast("double")
    t = read(spark, d, "part").select((p % 20).alias("page"), p.alias("key"), x.alias("x"), (x + F.col("p_size") * 6 + 100).alias("x1"), (F.floor(p / 20) * 300 + p % 7 * 90).cast("double").alias("y"))
    return t


@entry("page_columns", """WITH l AS (SELECT p_partkey AS key, p_partkey % 20 AS page, (p_partkey * 37 % 700)::DOUBLE AS x, p_partkey * 37 % 700 + p_size * 6.0::DOUBLE + 100 AS x1 FROM part),
t AS (SELECT page, count(*) FILTER (x1 <= 540 AND x < 500) >= greatest(4, round_even(count(*) * 0.14, 0)) AND count(*) FILTER (x >= 460 AND x1 > 500) >= greatest(4, round_even(count(*) * 0.14, 0)) AS two FROM l GROUP BY page)
SELECT key, CASE WHEN NOT two THEN 'main' WHEN x1 - x >= 620 OR (x < 380 AND x1 > 620) THEN 'full' WHEN x1 <= 540 THEN 'left' WHEN x >= 460 THEN 'right' ELSE 'full' END AS col FROM l JOIN t USING (page)""")
def _page_columns(spark, d):
    t = _page_lines(spark, d)
    return t.join(G.two_columns(t, "page", 1000.0), "page").select("key", G.column_of(F.col("x"), F.col("x1"), 1000.0, F.col("two_column")).alias("col"))


@entry("paragraph_breaks", """WITH l AS (SELECT p_partkey AS key, p_partkey % 20 AS page, (p_partkey * 37 % 700)::DOUBLE AS x, (p_partkey // 20 * 300 + p_partkey % 7 * 90)::DOUBLE AS y, CASE WHEN p_partkey % 31 = 0 THEN 13.0 ELSE 10.0 END AS fs,
  p_partkey % 23 = 0 AS bold, CASE WHEN p_partkey % 3 = 0 THEN 'line ' || p_partkey || '.' WHEN p_partkey % 5 = 0 THEN 'Smith, J.' ELSE 'line ' || p_partkey END AS t, p_partkey % 2 AS col FROM part),
m AS (SELECT page, quantile_cont(fs, 0.5) AS med FROM l GROUP BY page), h AS (SELECT l.*, med, fs >= med * 1.18 OR bold AS heading FROM l JOIN m USING (page)),
p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(fs) OVER w AS pfs, lag(t) OVER w AS pt, lag(heading) OVER w AS ph, lag(col) OVER w AS pc FROM h WINDOW w AS (PARTITION BY page ORDER BY key)),
n AS (SELECT *, (px IS NULL OR pc <> col OR ph OR heading OR y - py - 240 < -96 OR y - py - 240 > 360 OR abs(fs - pfs) > greatest(1.2, med * 0.16) OR (pt LIKE '%.' AND (x - px > greatest(120, fs * 12) OR t LIKE 'Smith,%')))::INT AS new FROM p)
SELECT key, sum(new) OVER (PARTITION BY page ORDER BY key)::BIGINT AS paragraph FROM n""")
def _paragraphs(spark, d):
    p = F.col("key")
    text = F.when(p % 3 == 0, F.concat(F.lit("line "), p.cast("string"), F.lit("."))).when(p % 5 == 0, "Smith, J.").otherwise(F.concat(F.lit("line "), p.cast("string")))
    t = _page_lines(spark, d).select("page", "key", "x", "y", F.lit(240.0).alias("height"), F.when(p % 31 == 0, 13.0).otherwise(10.0).alias("font_size"), (p % 23 == 0).alias("bold"), text.alias("text"), (p % 2).alias("col"))
    return G.paragraphs(t, "page", "key").select("key", F.col("paragraph").cast("long").alias("paragraph"))


@entry("interval_subtract", """WITH r AS (SELECT p_partkey % 50 AS k, p_partkey AS id, (p_partkey % 211)::DOUBLE AS lo, (p_partkey % 211 + p_size)::DOUBLE AS hi FROM part),
g AS (SELECT DISTINCT s_suppkey % 50 AS k, (s_suppkey * 13 % 211)::DOUBLE AS lo, (s_suppkey * 13 % 211 + 5)::DOUBLE AS hi FROM supplier),
c AS (SELECT r.k, r.id, r.lo AS rlo, r.hi AS rhi, g.lo, g.hi FROM r JOIN g ON r.k = g.k AND g.lo < r.hi AND g.hi > r.lo),
e AS (SELECT k, id, rlo AS at, rhi FROM c UNION SELECT k, id, hi, rhi FROM c WHERE hi < rhi),
s AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.id = e.id AND c.lo <= e.at AND c.hi > e.at)),
p AS (SELECT s.k, s.id, s.at AS lo, least(s.rhi, coalesce((SELECT min(c.lo) FROM c WHERE c.id = s.id AND c.lo > s.at), s.rhi)) AS hi FROM s)
SELECT k, id, lo, hi FROM p WHERE hi - lo >= 18 UNION ALL SELECT k, id, lo, hi FROM r WHERE id NOT IN (SELECT id FROM c)""")
def _subtract(spark, d):
    p = F.col("p_partkey")
    rows = read(spark, d, "part").select((p % 50).alias("k"), p.alias("id"), (p % 211).cast("double").alias("lo"), (p % 211 + F.col("p_size")).cast("double").alias("hi"))
    gone = read(spark, d, "supplier").select((F.col("s_suppkey") % 50).alias("k"), (F.col("s_suppkey") * 13 % 211).cast("double").alias("lo"), (F.col("s_suppkey") * 13 % 211 + 5).cast("double").alias("hi"))
    return G.subtract_intervals(rows, gone, "k", "lo", "hi")


# ---- catalogue and scalars -------------------------------------------------------------------------------------------


#: Events as requests: each asks for one of the catalogue's operators, in order of their ids.
_IDS = sorted(CAT.operators())
_CATALOG = "c(i, id, status) AS (VALUES " + ", ".join(f"({i}, '{x}', '{CAT.operators()[x].status}')" for i, x in enumerate(_IDS)) + ")"


def _requests(spark, d) -> DataFrame:
    return read(spark, d, "events").withColumn("operation", F.element_at(F.array(*map(F.lit, _IDS)), (F.col("event_id") % len(_IDS) + 1).cast("int")))


@entry("catalog_summary", f"WITH {_CATALOG} SELECT split_part(id, '.', 1) AS family, status, count(*) AS n, count(DISTINCT id) AS operators FROM events JOIN c ON i = event_id % {len(_IDS)} GROUP BY ALL")
def _catalog(spark, d):
    known = CAT.catalog(spark).withColumnRenamed("id", "operation")
    return _requests(spark, d).join(F.broadcast(known), "operation").groupBy("family", "status").agg(F.count("*").alias("n"), F.count_distinct("operation").alias("operators"))


@entry("pdf_safety", """
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'damaged' WHEN doc_id % 4 = 3 THEN 'encrypted' WHEN doc_id % 4 > 0 THEN 'signed' ELSE 'plain' END AS state FROM documents)
SELECT doc_id, state, coalesce(state IN ('damaged', 'signed'), false) AS refused FROM s""")
def _safety(spark, d):
    k = F.col("doc_id")
    part = lambda i, text: F.when(k % 4 == i, text).otherwise("")
    catalog = F.concat(F.lit("%PDF-1.7\n1 0 obj\n<< /Type /Catalog "), part(1, "/Perms << /DocMDP 3 0 R >> "), F.lit(">>\nendobj\n"))
    field = F.concat(F.lit("2 0 obj\n<< /FT "), part(2, "/Sig /V << /ByteRange [0 1 2 3] >>"), part(0, "/Sig"), part(1, "/Tx"), F.lit(" >>\nendobj\n"))
    trailer = F.concat(F.lit("trailer\n<< /Root 1 0 R "), part(3, "/Encrypt 4 0 R "), F.lit(">>\n"))
    content = F.when(k % 7 == 0, "%PDF-1.7\n").otherwise(F.concat(catalog, field, trailer)).cast("binary")
    files = read(spark, d, "documents").select("doc_id", F.concat(k, F.when(k % 5 == 0, ".txt").otherwise(".PDF")).alias("path"), content.alias("content"))
    return R.safety(files, encrypted=False).select("doc_id", "state", "refused")


#: Values that requests give, and what becomes of them for the parameters that pages are rotated and counted by.
_VALUES = ("90", "abc", "", "180", "x", "1e1", "-5", "true")


@entry("catalog_parameters", """
WITH v AS (SELECT event_id, ['90', 'abc', '', '180', 'x', '1e1', '-5', 'true'][event_id % 8 + 1] AS value FROM events), n AS (SELECT *, try_cast(value AS DOUBLE) AS x FROM v)
SELECT event_id, name, CASE WHEN name = 'rows' AND value = '' THEN '' WHEN name = 'rows' AND x >= 1 AND x <= 200 AND x = floor(x) THEN x::BIGINT::VARCHAR WHEN name = 'kind' AND value IN ('90', '180') THEN value WHEN name = 'kind' AND value = '' THEN '' END AS value,
  CASE WHEN name = 'other' THEN 'unknown parameter' WHEN value = '' THEN NULL WHEN name = 'rows' AND (x IS NULL OR x <> floor(x)) THEN 'no integer' WHEN name = 'rows' AND NOT (x BETWEEN 1 AND 200) THEN 'outside its bounds' WHEN name = 'kind' AND value NOT IN ('90', '180') THEN 'no choice' END AS error
FROM n, (SELECT unnest(['rows', 'kind', 'other']) AS name)""")
def _parameters(spark, d):
    table = spark.createDataFrame([("op", 0, "rows", "integer", "3", False, 1.0, 200.0, []), ("op", 1, "kind", "choice", "90", False, None, None, ["90", "180"])], CAT.parameters(spark).schema)
    value = F.element_at(F.array(*map(F.lit, _VALUES)), (F.col("event_id") % len(_VALUES) + 1).cast("int"))
    asked = read(spark, d, "events").select("event_id", F.lit("op").alias("operation"), F.explode(F.array(F.lit("rows"), F.lit("kind"), F.lit("other"))).alias("name"), value.alias("value"))
    return CAT.normalized(asked, table).select("event_id", "name", "value", "error")


_ASKED = ("sort", "pages media", "WORD  to", "pdf", "nothing here", "")


@entry("catalog_search")
def _search(spark, d):
    asked = read(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("p_partkey") % len(_ASKED) + 1).cast("int")).alias("query"))
    return CAT.search_all(CAT.catalog(spark), asked, "query").select("p_partkey", "query", F.size("found").alias("n"), F.array_join("found", " ").alias("found"))


@entry("clock_text", "SELECT s_suppkey, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS clock FROM (SELECT s_suppkey, s_suppkey * 1234 AS ms FROM supplier)")
def _clock(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", V.clock(F.col("s_suppkey") * F.lit(1234) / F.lit(1000.0)).alias("clock"))


@entry("clock_ranges", "WITH m AS (SELECT s_suppkey, greatest(0, s_suppkey * 1234 - 9000) AS a, s_suppkey * 1234 + 61500 AS b FROM supplier), c AS (SELECT s_suppkey, unnest([a, b]) AS ms, unnest([0, 1]) AS side FROM m) SELECT s_suppkey, string_agg(lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0'), '–' ORDER BY side) AS times FROM c GROUP BY s_suppkey")
def _clock_ranges(spark, d):
    start = (F.col("s_suppkey") * 1234 - 9000) / F.lit(1000.0)
    return read(spark, d, "supplier").select("s_suppkey", V.clock_range(start, F.col("s_suppkey") * 1.234 + 61.5).alias("times"))


@entry("clock_parse", "SELECT s_suppkey, (s_suppkey % 24 * 3600 + s_suppkey % 60 * 60 + s_suppkey % 59)::DOUBLE AS seconds FROM supplier")
def _parse(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select("s_suppkey", V.seconds_column(F.concat_ws(":", (k % 24).cast("string"), (k % 60).cast("string"), (k % 59).cast("string"))).alias("seconds"))


@entry("natural_sort", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS pos FROM part")
def _natural(spark, d):
    t = read(spark, d, "part").select("p_partkey", F.concat(F.lit("image"), F.col("p_size").cast("string"), F.lit(".png")).alias("name"))
    return numbered(t, [V.natural_key(F.col("name")), F.col("p_partkey")], "pos").select("p_partkey", "pos")


@entry("lower_quantile", "SELECT p_brand, list_sort(list(p_size))[floor((count(*) - 1) * 0.35)::INT + 1] AS q FROM part GROUP BY 1")
def _quantile(spark, d):
    return read(spark, d, "part").groupBy("p_brand").agg(F.collect_list("p_size").alias("v")).select("p_brand", V.lower_quantile(F.col("v"), 0.35).alias("q"))


def queries() -> dict[str, Query]:
    return {n: q for n, (q, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in ENTRIES.items() if s}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Shipped lines of a year by flag and status, with a total: a filter and a summary."""
    t = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate").withColumn("__o", F.struct("l_orderkey", "l_linenumber"))
    return S.pivot_summary(t.filter("l_shipdate >= timestamp'1994-01-01'"), ["l_returnflag"], ["l_linestatus"], "l_quantity", "sum", "__o", total="total")


from . import page_queries  # noqa: E402, F401  its entries
