"""Queries over pages, words and runs of text: more entries of queries.ENTRIES, with SQL where it expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import advances as AD
from ..operators import audit as AU
from ..operators import boundaries as BD
from ..operators import candidates as CD
from ..operators import fragments as FG
from ..operators import regions as RG
from ..operators import runs as RN
from . import runner as R
from .queries import entry, read

# ---- regions ---------------------------------------------------------------------------------------------------------


def _laid_out(spark, d) -> tuple[DataFrame, ...]:
    """Order lines as the marks of pages, twelve orders to a page: lines of text, images, drawings and rules by line number."""
    o, p, n, q = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity")
    t = read(spark, d, "lineitem").withColumn("page", F.floor(o / 12))
    at = lambda wide, high, x, y: {"x0": x, "y0": y, "x1": x + wide, "y1": y + high}
    y = (o % 12) * 62.0 + n * 8.0
    text = F.when(p % 31 == 0, F.concat(F.lit("Figure "), q.cast("int").cast("string"), F.lit(": view"))).when(p % 29 == 0, F.lit("a � b")).otherwise(F.concat_ws(" ", "l_returnflag", F.lit("order of"), "l_orderkey", F.lit("parts"), "l_partkey", F.lit("shipped to the buyer with care")))
    math = F.when(p % 11 == 0, F.lit(0.5)).otherwise(0.0)
    lines = t.filter(n <= 3).withColumns({**at(40 + q * 5, 11.0, (p % 300).cast("double"), y), "text": text, "math": math})
    images = t.filter(n == 4).filter(p % 5 == 0).withColumns(at(20 + q * 2, 20 + q, (p % 400).cast("double"), y))
    drawings = t.filter(n == 5).withColumns({**at(q, q / 2, (p % 500).cast("double"), y), "items": (p % 110).cast("int"), "white": p % 13 == 0})
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rules = t.filter(n >= 6).withColumns({**at(250 + q, 1.0, (p % 5) * 10.0, y), "key": key})
    sizes = t.select("page").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    kept = ["page", "x0", "y0", "x1", "y1"]
    return lines.select(*kept, "text", "math"), images.select(kept), drawings.select(*kept, "items", "white"), rules.select(*kept, "key"), sizes


@entry("page_regions")
def _page_regions(spark, d):
    return RG.islands(*_laid_out(spark, d))


@entry("page_assessment")
def _page_assessment(spark, d):
    lines, images, drawings, rules, sizes = _laid_out(spark, d)
    return RG.assessed(lines, RG.islands(lines, images, drawings, rules, sizes), sizes)


# ---- words across pages, and lost spaces ------------------------------------------------------------------------------

#: Conversations as documents whose pages cut the last word of each turn: its last three letters begin the next turn's text,
#: a hyphen stands where they were if the turn is even; a turn that ends a sentence in a short line leaves it to the next turn.
_CUT = """c AS (SELECT *, regexp_replace(coalesce(text, ''), '[^{L}]+$', '') AS s FROM conversations),
m AS (SELECT *, right(s, 3) AS moved, left(s, greatest(length(s) - 3, 0)) || CASE WHEN turn % 2 = 0 THEN '-' ELSE '' END AS kept FROM c),
p AS (SELECT conv_id AS doc, turn AS page, coalesce(lag(moved) OVER (PARTITION BY conv_id ORDER BY turn), '') || chr(10) || CASE WHEN turn % 5 = 4 THEN 'of the matter.' || chr(10) ELSE '' END || kept AS text FROM m)"""


@entry("page_fragments", rf"""
WITH {_CUT.format(L=r"\p{L}")},
l AS (SELECT doc, page, text, string_split(text, chr(10)) AS lines FROM p),
s AS (SELECT *, list_filter(list_transform(lines, lambda x, i: {{'i': i, 'x': regexp_replace(x, '^\s+|\s+$', '', 'g')}}), lambda z: z.x <> '' AND NOT (length(z.x) <= 180 AND (
  regexp_matches(z.x, '^(\d(\s*\d){{0,3}}|[\p{{Pd}}−]\s*\d(\s*\d){{0,3}}\s*[\p{{Pd}}−])$') OR regexp_matches(lower(z.x), 'https?://|www\.|doi\.org') OR regexp_matches(z.x, '(^|\s)\d+\s*/\s*\d+(\s|$)') OR regexp_matches(z.x, '(?i)\bpage\s+\d+')))) AS shown FROM l),
e AS (SELECT doc, page, text, lines, shown[1] AS f, shown[len(shown)] AS z, len(shown) = 1 AS single, row_number() OVER (ORDER BY doc, page) AS n FROM s),
t AS (SELECT a.n, a.doc, a.z.x AS e, b.f.x AS b, regexp_extract(a.z.x, '(\p{{L}}+)[-‐­]?$', 1) AS tail, regexp_extract(b.f.x, '^(\p{{Ll}}\p{{L}}*)', 1) AS head FROM e a JOIN e b ON b.n = a.n + 1 AND a.doc = b.doc WHERE a.z IS NOT NULL AND b.f IS NOT NULL),
w AS (SELECT doc, word, count(*) AS c FROM (SELECT doc, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM p) GROUP BY ALL),
k AS (SELECT t.*, CASE WHEN tail <> '' AND head <> '' AND whole.c > 0 AND (regexp_matches(e, '[-‐­]$') OR half.c <= 1) THEN 'word'
  WHEN length(e) >= 24 AND len(regexp_extract_all(e, '[A-Za-z]+([''’-][A-Za-z]+)*')) >= 4 AND regexp_matches(e, '[A-Za-z]$') AND length(b) <= 48 AND regexp_matches(b, '^[a-z][A-Za-z]*([''’-][A-Za-z]+)*(\s+[A-Za-z]+([''’-][A-Za-z]+)*){{0,3}}[.!?]["''’”)\]]?$') THEN 'sentence' END AS kind
  FROM t LEFT JOIN w whole ON whole.doc = t.doc AND whole.word = lower(tail || head) LEFT JOIN w half ON half.doc = t.doc AND half.word = lower(tail)),
g AS (SELECT n, kind, CASE kind WHEN 'word' THEN head ELSE b END AS taken, kind = 'sentence' OR head = b AS whole FROM k WHERE kind IS NOT NULL),
x AS (SELECT g.* FROM g JOIN e USING (n) LEFT JOIN g i ON i.n = g.n - 1 WHERE NOT (single AND coalesce(i.whole, false))),
o AS (SELECT e.*, x.kind, x.taken, i.taken AS gone FROM e LEFT JOIN x USING (n) LEFT JOIN x i ON i.n = e.n - 1),
r AS (SELECT *, list_transform(lines, lambda v, i: CASE WHEN gone IS NOT NULL AND i = f.i THEN ltrim(substr(trim(v), length(gone) + 1)) ELSE v END) AS cut FROM o)
SELECT doc AS conv_id, page AS turn, kind, taken, CASE WHEN kind IS NULL AND gone IS NULL THEN text ELSE array_to_string(list_filter(list_transform(cut, lambda v, i: CASE WHEN kind IS NOT NULL AND i = z.i THEN
  CASE kind WHEN 'word' THEN regexp_replace(rtrim(v), '[-‐­]$', '') || taken ELSE rtrim(v) || ' ' || taken END WHEN gone IS NOT NULL AND i = f.i AND v = '' THEN NULL ELSE v END), lambda v: v IS NOT NULL), chr(10)) END AS text FROM r""")
def _page_fragments(spark, d):
    by = Window.partitionBy("conv_id").orderBy("turn")
    s = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\p{L}]+$", "")
    t = read(spark, d, "conversations").withColumn("s", s).withColumn("moved", F.right("s", F.lit(3)))
    kept = F.concat(F.left("s", F.greatest(F.length("s") - 3, F.lit(0))), F.when(F.col("turn") % 2 == 0, "-").otherwise(""))
    text = F.concat(F.coalesce(F.lag("moved").over(by), F.lit("")), F.lit("\n"), F.when(F.col("turn") % 5 == 4, "of the matter.\n").otherwise(""), kept)
    return FG.join_fragments(t.select("conv_id", "turn", text.alias("text")), "conv_id", "turn")


@entry("restored_words")
def _restored_words(spark, d):
    t = read(spark, d, "benchmark")
    costs = BD.word_costs(t, "text")
    t = t.withColumn("glued", F.regexp_replace("text", "(?<=[A-Za-z]) (?=[A-Za-z])", "")).withColumn("restored", BD.restore(F.col("glued"), costs))
    recall, precision = BD.boundary_measures(F.col("text"), F.col("glued"), F.col("restored"))
    return t.select("item_id", "restored", recall.alias("boundary_recall"), precision.alias("boundary_precision"))


# ---- runs ------------------------------------------------------------------------------------------------------------

#: Parts as runs: a document of seven parts, a paragraph for each, or one cell of a table for those of every third document;
#: its name, its placeholder cut in two, and its brand in runs of their own.
_RUNS = """s AS (SELECT p_partkey // 7 AS doc, p_partkey AS block, p_partkey // 7 % 3 = 0 AS tabled, p_partkey % 7 AS k, * FROM part),
r AS (SELECT doc, block, u.run, CASE WHEN tabled THEN 0 END AS t, CASE WHEN tabled THEN k // 2 END AS tr, CASE WHEN tabled THEN k % 2 END AS tc, CASE k WHEN 1 THEN 'Heading 2' WHEN 2 THEN 'List Bullet' WHEN 3 THEN 'List Number' ELSE 'Normal' END AS style,
  u.text, u.run = 1 AS bold, p_size % 3 = 0 AS italic, u.run = 3 AS underline, p_size % 5 = 0 AND u.run = 2 AS strike, CASE WHEN u.run = 4 THEN 'http://x/' || p_partkey END AS link
  FROM (SELECT *, unnest([{run: 1, text: p_name || ' {{na'}, {run: 2, text: 'me}} *_' || p_type || '|'}, {run: 3, text: chr(10) || p_brand || ' & <b> {{name}}'}, {run: 4, text: CASE WHEN p_size % 2 = 0 THEN 'see' ELSE '' END}]) AS u FROM s))"""


def _part_runs(spark, d) -> DataFrame:
    key, size, k = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 7
    tabled = F.floor(key / 7) % 3 == 0
    run = lambda n, *x: F.struct(F.lit(n).alias("run"), F.concat(*x).alias("text"))
    texts = F.array(run(1, "p_name", F.lit(" {{na")), run(2, F.lit("me}} *_"), "p_type", F.lit("|")), run(3, F.lit("\n"), "p_brand", F.lit(" & <b> {{name}}")), run(4, F.when(size % 2 == 0, "see").otherwise("")))
    n = F.col("run")
    style = F.when(k == 1, "Heading 2").when(k == 2, "List Bullet").when(k == 3, "List Number").otherwise("Normal")
    placed = {"doc": F.floor(key / 7), "block": key, "table": F.when(tabled, 0), "row": F.when(tabled, F.floor(k / 2)), "cell": F.when(tabled, k % 2), "style": style}
    told = {"bold": n == 1, "italic": size % 3 == 0, "underline": n == 3, "strike": (size % 5 == 0) & (n == 2), "link": F.when(n == 4, F.concat(F.lit("http://x/"), key.cast("string")))}
    return read(spark, d, "part").withColumns(placed).select("*", F.explode(texts).alias("x")).select(*placed, "x.run", "x.text", "p_size", "p_partkey").withColumns(told).drop("p_size", "p_partkey")


@entry("replace_runs", """
SELECT p_partkey // 7 AS doc, p_partkey AS block, u.run, u.text FROM (SELECT *, unnest([{run: 1, text: replace(p_name || ' N-', 'a', 'aa')}, {run: 2, text: replace(' *_' || p_type || '|', 'a', 'aa')}, {run: 3, text: replace(chr(10) || p_brand || ' & <b> N-', 'a', 'aa')}, {run: 4, text: CASE WHEN p_size % 2 = 0 THEN 'see' ELSE '' END}]) AS u FROM part)""")
def _replace_runs(spark, d):
    return RN.replace_runs(_part_runs(spark, d), {"{{name}}": "N-", "a": "aa"}).select("doc", "block", "run", "text")


@entry("runs_markdown", rf"""
WITH {_RUNS},
m AS (SELECT *, regexp_replace(text, '([\\*_])', '\\\1', 'g') AS e FROM r),
x AS (SELECT *, CASE WHEN text = '' THEN '' ELSE CASE WHEN link IS NOT NULL THEN '[' ELSE '' END || CASE WHEN strike THEN '~~' ELSE '' END || CASE WHEN bold AND italic THEN '***' || e || '***' WHEN bold THEN '**' || e || '**' WHEN italic THEN '*' || e || '*' ELSE e END
  || CASE WHEN strike THEN '~~' ELSE '' END || CASE WHEN link IS NOT NULL THEN '](' || link || ')' ELSE '' END END AS v FROM m),
p AS (SELECT doc, block, t, tr, tc, any_value(style) AS style, string_agg(v, '' ORDER BY run) AS v, string_agg(text, '' ORDER BY run) AS plain FROM x GROUP BY ALL),
o AS (SELECT doc, block, CASE style WHEN 'Heading 2' THEN '## ' || v WHEN 'List Bullet' THEN '- ' || v WHEN 'List Number' THEN '1. ' || v ELSE v END AS line FROM p WHERE t IS NULL),
c AS (SELECT doc, tr, min(block) AS block, list(replace(replace(plain, '|', '\|'), chr(10), '<br>') ORDER BY tc) AS cells FROM p WHERE t IS NOT NULL GROUP BY doc, tr),
w AS (SELECT *, max(len(cells)) OVER (PARTITION BY doc) AS wide, row_number() OVER (PARTITION BY doc ORDER BY tr) AS i FROM c),
l AS (SELECT doc, block, i, '| ' || array_to_string(list_concat(cells, list_transform(range(wide - len(cells)), lambda z: '')), ' | ') || ' |' || CASE WHEN i = 1 THEN chr(10) || '| ' || array_to_string(list_transform(range(wide), lambda z: '---'), ' | ') || ' |' ELSE '' END AS line FROM w),
u AS (SELECT doc, min(block) AS block, string_agg(line, chr(10) ORDER BY i) AS line FROM l GROUP BY doc UNION ALL SELECT * FROM o)
SELECT doc, string_agg(line, chr(10) || chr(10) ORDER BY block) AS text FROM u GROUP BY doc""")
def _runs_markdown(spark, d):
    return RN.runs_markdown(_part_runs(spark, d))


@entry("runs_html", rf"""
WITH {_RUNS},
m AS (SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') AS e FROM r),
x AS (SELECT *, CASE WHEN text = '' THEN '' ELSE CASE WHEN link IS NOT NULL THEN '<a href="' || link || '">' ELSE '' END || CASE WHEN strike THEN '<s>' ELSE '' END || CASE WHEN underline THEN '<u>' ELSE '' END || CASE WHEN italic THEN '<em>' ELSE '' END || CASE WHEN bold THEN '<strong>' ELSE '' END || e
  || CASE WHEN bold THEN '</strong>' ELSE '' END || CASE WHEN italic THEN '</em>' ELSE '' END || CASE WHEN underline THEN '</u>' ELSE '' END || CASE WHEN strike THEN '</s>' ELSE '' END || CASE WHEN link IS NOT NULL THEN '</a>' ELSE '' END END AS v FROM m),
p AS (SELECT doc, block, t, tr, tc, CASE any_value(style) WHEN 'Heading 2' THEN 'h2' WHEN 'Normal' THEN 'p' ELSE 'li' END AS tag, string_agg(v, '' ORDER BY run) AS v FROM x GROUP BY ALL),
q AS (SELECT *, '<' || tag || '>' || v || '</' || tag || '>' AS line, min(tr) OVER (PARTITION BY doc) = tr AS head FROM p),
c AS (SELECT doc, tr, min(block) AS block, string_agg(CASE WHEN head THEN '<th>' || line || '</th>' ELSE '<td>' || line || '</td>' END, '' ORDER BY tc) AS cells FROM q WHERE t IS NOT NULL GROUP BY doc, tr),
u AS (SELECT doc, min(block) AS block, '<table>' || string_agg('<tr>' || cells || '</tr>', '' ORDER BY tr) || '</table>' AS line FROM c GROUP BY doc UNION ALL SELECT doc, block, line FROM q WHERE t IS NULL)
SELECT doc, string_agg(line, chr(10) ORDER BY block) AS text FROM u GROUP BY doc""")
def _runs_html(spark, d):
    return RN.runs_html(_part_runs(spark, d))


#: Events as trees: a document for each user; each event a paragraph with a wrapper that holds a wrapper and two texts, a format change and a marker.
_NODES = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 20 AS b FROM events),
n AS (SELECT user_id AS doc, b + u.a AS enter, b + u.z AS leave, u.kind, u.text, u.format, CASE WHEN u.kind = 'paragraph' THEN CASE event_id % 7 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' END END AS mark, b + u.of AS parent FROM (SELECT *, unnest([
  {a: 0, z: 19, kind: 'paragraph', text: NULL, format: 'now', of: NULL}, {a: 1, z: 2, kind: CASE WHEN event_id % 4 = 0 THEN 'format' ELSE 'marker' END, text: NULL, format: 'was', of: 0},
  {a: 3, z: 14, kind: ['insert', 'delete', 'move_to', 'move_from', 'run'][event_id % 5 + 1], text: NULL, format: NULL, of: NULL}, {a: 4, z: 9, kind: ['delete', 'insert', 'run'][event_id % 3 + 1], text: NULL, format: NULL, of: NULL},
  {a: 5, z: 6, kind: 'text', text: event_type, format: NULL, of: NULL}, {a: 10, z: 11, kind: 'text', text: '/' || event_id, format: NULL, of: NULL}, {a: 15, z: 16, kind: 'text', text: ';', format: NULL, of: NULL}]) AS u FROM e))"""


def _event_nodes(spark, d) -> DataFrame:
    e, b = F.col("event_id"), F.col("b")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (e % by + 1).cast("int"))
    none = F.lit(None).cast("string")
    node = lambda a, z, kind, text=none, format=none, of=F.lit(None).cast("int"): F.struct(F.lit(a).alias("a"), F.lit(z).alias("z"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"), format.alias("format"), of.alias("of"))
    nodes = F.array(
        node(0, 19, "paragraph", format=F.lit("now")), node(1, 2, F.when(e % 4 == 0, "format").otherwise("marker"), format=F.lit("was"), of=F.lit(0)),
        node(3, 14, pick(("insert", "delete", "move_to", "move_from", "run"), 5)), node(4, 9, pick(("delete", "insert", "run"), 3)),
        node(5, 6, "text", F.col("event_type")), node(10, 11, "text", F.concat(F.lit("/"), e.cast("string"))), node(15, 16, "text", F.lit(";")),
    )
    t = read(spark, d, "events").withColumn("b", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * 20).select("*", F.explode(nodes).alias("u"))
    mark = F.when(F.col("u.kind") == "paragraph", F.when(e % 7 == 0, "insert").when(e % 7 == 1, "delete"))
    return t.select(F.col("user_id").alias("doc"), (b + F.col("u.a")).alias("enter"), (b + F.col("u.z")).alias("leave"), "u.kind", "u.text", "u.format", mark.alias("mark"), (b + F.col("u.of")).alias("parent"))


for _mode, _out, _old in (("accept", "'delete', 'move_from'", "format"), ("reject", "'insert', 'move_to'", "CASE WHEN kind = 'paragraph' AND EXISTS (SELECT 1 FROM n c WHERE c.doc = k.doc AND c.kind = 'format' AND c.parent = k.enter) THEN 'was' ELSE format END")):
    _KEPT = f"k AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n w WHERE w.doc = n.doc AND w.kind IN ({_out}) AND w.enter < n.enter AND w.leave > n.enter) AND kind NOT IN ('insert', 'delete', 'move_to', 'move_from', 'marker', 'format'))"

    @entry(f"revisions_{_mode}", f"WITH {_NODES}, {_KEPT} SELECT doc, enter, kind, text, {_old} AS format FROM k")
    def _revisions_tree(spark, d, mode=_mode):
        return RN.apply_revisions(_event_nodes(spark, d), mode).select("doc", "enter", "kind", "text", "format")

    @entry(f"revised_text_{_mode}", f"""WITH {_NODES}, {_KEPT},
g AS (SELECT doc, enter, leave, count(*) FILTER (NOT coalesce(before, '') IN ({_out})) OVER (PARTITION BY doc ORDER BY enter) AS paragraph FROM (SELECT *, lag(mark) OVER (PARTITION BY doc ORDER BY enter) AS before FROM k WHERE kind = 'paragraph'))
SELECT g.doc, paragraph, coalesce(string_agg(k.text, '' ORDER BY k.enter), '') AS text FROM g LEFT JOIN k ON k.doc = g.doc AND k.kind = 'text' AND k.enter BETWEEN g.enter AND g.leave GROUP BY g.doc, paragraph""")
    def _revised_text(spark, d, mode=_mode):
        return RN.revised_text(_event_nodes(spark, d), mode)


# ---- names -----------------------------------------------------------------------------------------------------------


@entry("unique_names", r"""
WITH w AS (SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS o, l_suppkey, l_extendedprice, CASE WHEN l_partkey % 10 = 0 THEN 'page_' || (l_suppkey % 9) || '.png' WHEN l_partkey % 3 = 0 THEN 'page.png' ELSE 'part' || (l_partkey % 50) END AS name FROM lineitem),
h AS (SELECT DISTINCT 'page_' || s_suppkey || '.png' AS name FROM supplier WHERE s_suppkey % 4 = 0 UNION SELECT DISTINCT 'part' || n_nationkey FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o, l_suppkey, l_extendedprice) - 1 + (name IN (SELECT name FROM h))::INT AS k FROM w),
t AS (SELECT DISTINCT regexp_extract(name, '^(.*)_([1-9][0-9]*)(\.[^.]*)?$', 1) AS s, regexp_extract(name, '^(.*)_([1-9][0-9]*)(\.[^.]*)?$', 2)::BIGINT AS t, regexp_extract(name, '^(.*)_([1-9][0-9]*)(\.[^.]*)?$', 3) AS x FROM (SELECT name FROM h UNION SELECT name FROM w) WHERE regexp_matches(name, '_[1-9][0-9]*(\.[^.]*)?$')),
g AS (SELECT s, x, t, t - row_number() OVER (PARTITION BY s, x ORDER BY t) AS before FROM t),
f AS (SELECT s, x, i AS t, row_number() OVER (PARTITION BY s, x ORDER BY i) AS k FROM (SELECT DISTINCT s, x, unnest(range(1, (SELECT count(*) FROM w) + (SELECT count(*) FROM t) + 1)) AS i FROM (SELECT DISTINCT s, x FROM t)) n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.s = n.s AND t.x = n.x AND t.t = n.i)),
c AS (SELECT r.*, regexp_replace(name, '\.[^.]*$', '') AS stem, regexp_extract(name, '(\.[^.]*)$', 1) AS suffix FROM r)
SELECT o, l_suppkey, l_extendedprice, name, CASE WHEN c.k = 0 THEN name ELSE stem || '_' || coalesce(f.t, c.k) || suffix END AS unique_name FROM c LEFT JOIN f ON f.s = stem AND f.x = suffix AND f.k = c.k""")
def _unique_names(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    name = F.when(p % 10 == 0, F.concat(F.lit("page_"), (s % 9).cast("string"), F.lit(".png"))).when(p % 3 == 0, "page.png").otherwise(F.concat(F.lit("part"), (p % 50).cast("string")))
    t = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10_000_000 + p * 10 + F.col("l_linenumber")).alias("o"), "l_suppkey", "l_extendedprice", name.alias("name"))
    taken = read(spark, d, "supplier").filter("s_suppkey % 4 = 0").select(F.concat(F.lit("page_"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("name"))
    taken = taken.union(read(spark, d, "nation").select(F.concat(F.lit("part"), F.col("n_nationkey").cast("string"))))
    t = t.withColumn("__order", F.struct("o", "l_suppkey", "l_extendedprice"))
    return R.unique_names(t, "name", "__order", taken).drop("__order")


# ---- letters, candidates and enhanced pictures ---------------------------------------------------------------------------


@entry("letter_advances", """
WITH l AS (SELECT l_orderkey AS page, l_linenumber // 4 AS line, row_number() OVER (PARTITION BY l_orderkey, l_linenumber // 4 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, chr((97 + l_partkey % 26)::INT) AS text,
  l_returnflag AS font, 8 + (l_quantity % 7) * 0.5 AS size, (l_linenumber % 4) * (4 + l_suppkey % 9) + l_discount * 10 AS x, l_tax * 10 AS y FROM lineitem),
a AS (SELECT *, round_even(greatest(1.0, size) * 2, 0) / 2 AS bucket, ((lead(x) OVER w - x) * 1.0 + (lead(y) OVER w - y) * 0.0) / 1.0 AS a FROM l WINDOW w AS (PARTITION BY page, line ORDER BY n)),
f AS (SELECT * FROM a WHERE a BETWEEN 0.05 AND greatest(1.0, size) * 1.8),
m AS (SELECT level, CASE WHEN level < 3 THEN font END AS font, CASE WHEN level < 2 THEN bucket END AS bucket, CASE WHEN level < 1 THEN text END AS text, a FROM f, (SELECT unnest(range(4)) AS level)),
g AS (SELECT level, font, bucket, text, list_sort(list(a)) AS v, count(*) AS n FROM m GROUP BY level, font, bucket, text),
q AS (SELECT *, v[floor((n - 1) * CASE level WHEN 0 THEN 0.25 ELSE 0.35 END)::INT + 1] AS adv FROM g WHERE level > 0 OR n >= 3)
SELECT page, line, a.n, a.text, coalesce(l0.adv, l1.adv, l2.adv, l3.adv) AS expected, CASE WHEN l0.adv IS NOT NULL THEN 'letter' WHEN l1.adv IS NOT NULL THEN 'size' WHEN l2.adv IS NOT NULL THEN 'font' WHEN l3.adv IS NOT NULL THEN 'all' END AS expected_by
FROM a LEFT JOIN q l0 ON l0.level = 0 AND l0.font = a.font AND l0.bucket = a.bucket AND l0.text = a.text LEFT JOIN q l1 ON l1.level = 1 AND l1.font = a.font AND l1.bucket = a.bucket LEFT JOIN q l2 ON l2.level = 2 AND l2.font = a.font LEFT JOIN q l3 ON l3.level = 3""")
def _letter_advances(spark, d):
    o, n, p, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    line = F.floor(n / 4)
    by = Window.partitionBy(o, line).orderBy(n, p, s, "l_extendedprice")
    told = {"page": o, "line": line, "n": F.row_number().over(by), "text": F.char(97 + p % 26), "font": F.col("l_returnflag"), "size": 8 + (F.col("l_quantity") % 7) * 0.5, "x": (n % 4) * (4 + s % 9) + F.col("l_discount") * 10, "y": F.col("l_tax") * 10}
    none = F.lit(None).cast("double")
    t = read(spark, d, "lineitem").select(*(c.alias(name) for name, c in told.items()), none.alias("dx"), none.alias("dy"))
    return AD.expected(t, AD.model(AD.advances(t))).select("page", "line", "n", "text", "expected", "expected_by")


@entry("candidate_frames")
def _candidate_frames(spark, d):
    """Events as scans of their users' recordings, in segments of 3 to 80 scans."""
    t = read(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e11).alias("ts"))
    scans = t.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).select(F.col("user_id").alias("seq"), "n", "ts", F.floor(F.col("ts") * 25).alias("frame"))
    ends = scans.filter((F.col("n") % 97 == 2) | (F.col("n") % 83 == 0)).withColumn("next", F.lead("n").over(Window.partitionBy("seq").orderBy("n")))
    segments = ends.filter("next is not null").select("seq", F.col("n").alias("segment"), F.col("n").alias("first"), (F.col("next") - 1).alias("last"))
    return CD.frames_to_read(CD.schedule(segments, scans, 25.0))


def _planes(spark, d) -> DataFrame:
    """Vectors as pictures of 8 by 8 pixels in three colours."""
    v = F.col("embedding")
    byte = lambda c: F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(F.pmod((x * c).cast("int"), F.lit(256))), 2, "0")), ""))
    return read(spark, d, "embeddings").select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), byte(300).alias("red"), byte(400).alias("green"), byte(500).alias("blue"))


@entry("chosen_frames")
def _chosen_frames(spark, d):
    k = F.col("vec_id")
    c = _planes(spark, d).select((k % 20).alias("seq"), (F.floor(k / 20) % 5).alias("segment"), k.alias("at"), "width", "height", "red", "green", "blue", F.lit(None).cast("binary").alias("ignored"), (k % 4).alias("support"))
    return CD.chosen(c).select("seq", "segment", "at", "score")


@entry("audited_pictures")
def _audited_pictures(spark, d):
    """Vectors as grey pictures of 8 by 32 pixels, the enhanced one of each brighter in a part; tiles of 8 pixels."""
    k, v = F.col("vec_id"), F.col("embedding")
    grey = lambda more: F.unhex(F.array_join(F.transform(F.flatten(F.array(v, v, v, v)), lambda x, i: F.lpad(F.hex(F.least(F.lit(255), F.pmod((x * 300).cast("int"), F.lit(200)) + more(i))), 2, "0")), ""))
    shift = lambda i: F.when((k % 3 > 0) & (i >= 128) & (i < 128 + 64 * (k % 3)), F.pmod(i * k, F.lit(60)).cast("int")).otherwise(F.lit(2))
    t = read(spark, d, "embeddings").select(k.alias("key"), F.lit(8).alias("width"), F.lit(32).alias("height"), F.lit(1).alias("channels"), (k % 2 == 0).alias("photo"), grey(lambda i: F.lit(0)).alias("source"), grey(shift).alias("output"))
    return AU.audited(t, 8).withColumn("pixels", F.sha2("pixels", 256))
