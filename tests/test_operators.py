"""Corner cases with known results, and what has no SQL form against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import cells as C
from leafmill.functions import text as X
from leafmill.functions import values as V
from leafmill.operators import frames as FR
from leafmill.operators import geometry as G
from leafmill.operators import media as M
from leafmill.operators import pages as P
from leafmill.operators import sheets as S
from leafmill.operators import textops as TX
from leafmill.plans import catalog, runner
from leafmill.sources import ooxml


def test_crosstab(spark):
    rows = [(1, "华东", "一季度", 10), (2, "华东", "二季度", 20), (3, "华南", "一季度", 5), (4, "华南", "二季度", 15)]
    t = spark.createDataFrame(rows, ["o", "地区", "季度", "金额"])
    got = S.pivot_summary(t, ["地区"], ["季度"], "金额", "sum", "o")
    assert got.columns == ["地区", "季度=一季度", "季度=二季度", "总计"]
    assert [tuple(r) for r in got.collect()] == [("华东", 10, 20, 30), ("华南", 5, 15, 20)]
    r = spark.createDataFrame([(1, "A", "一"), (2, "A", "二"), (3, "B", "三")], ["o", "分类", "内容"])
    assert [tuple(x) for x in S.pivot_summary(r, ["分类"], [], None, "sum", "o").collect()] == [("A", 2), ("B", 1)]


def test_sort_and_filter(spark):
    t = spark.createDataFrame([(1, "高", 3), (2, "低", 1), (3, "中", 2)], "o int, name string, v int").withColumn("c", C.number_cell(F.col("v")))
    assert [r["name"] for r in S.sort_rows(t, "c", "o").orderBy("pos").collect()] == ["低", "中", "高"]
    mixed = spark.createDataFrame([(1, "b"), (2, None), (3, "A")], "o int, s string").withColumn("c", C.text_cell(F.col("s")))
    assert [r["o"] for r in S.sort_rows(mixed, "c", "o").orderBy("pos").collect()] == [3, 1, 2]
    assert [r["o"] for r in S.sort_rows(mixed, "c", "o", reverse=True).orderBy("pos").collect()] == [2, 1, 3]
    assert [r["hidden"] for r in S.filter_rows(mixed, "c", "equals", "a").orderBy("o").collect()] == [True, True, False]
    assert [r["hidden"] for r in S.filter_rows(mixed, "c", "greater_than", 1).collect()] == [True] * 3


def test_small_languages():
    assert V.page_set("1-3, 5, 8-", 10) == [0, 1, 2, 4, 7, 8, 9]
    assert V.page_set("全部", 3) == [0, 1, 2]
    with pytest.raises(ValueError):
        V.page_set("9", 3)
    assert V.page_list("3,1,3", 3) == [3, 1]
    assert V.page_ranges("1-2,2-", 3) == [(1, 2), (2, 3)]
    with pytest.raises(ValueError):
        V.page_ranges("3-1", 3)
    assert V.safe_filename("报表:/2026*?") == "报表__2026__"
    assert V.a1_range("B2:A10") == (2, 1, 10, 2) and V.column_index("AA") == 27 and V.column_letters(27) == "AA"
    assert V.seconds("01:02:03") == 3723 and V.seconds("2:03") == 123
    with pytest.raises(ValueError):
        V.seconds("1:75")
    assert V.color("#fff") == (255, 255, 255) and V.bgr((1, 2, 3)) == 0x030201
    with pytest.raises(ValueError):
        V.strict_json('{"a": 1, "a": 2}')
    assert V.smart_value("1.5") == 1.5 and V.smart_value("x") == "x" and V.comma_list("a，b,,") == ["a", "b"]
    assert V.even_picks(10, 4) == [0, 3, 6, 9] and sorted(["a10", "a9", "a"], key=V.natural_order) == ["a", "a9", "a10"]


def test_catalog():
    ops = catalog.operators()
    assert len(ops) == 101 and sum(o.status == "core" for o in ops.values()) == 73
    for o in ops.values():
        if o.capability == "ready":
            assert o.resolve()
    with pytest.raises(ValueError):
        ops["pdf.rotate"].normalize({"angle": "45"})
    with pytest.raises(ValueError):
        ops["pdf.rotate"].normalize({"nothing": 1})
    assert ops["excel.split_column"].normalize({"maxsplit": "2"})["maxsplit"] == 2
    with pytest.raises(NotImplementedError):
        ops["pdf.ocr"].resolve()


def test_runner(spark):
    files = spark.createDataFrame([(0, "a.txt", bytearray(b"first")), (1, "b.txt", bytearray(b"broken")), (2, "c.txt", bytearray(b"last"))], "input_idx long, path string, content binary")

    def work(x):
        if x == b"broken":
            raise ValueError("no")
        return x.upper()

    got = runner.run_each(runner.validate(files, [".txt"]), work)
    s = runner.summary(got).first()
    assert (s["completed"], s["failed"], s["outcome"]) == (2, 1, "partial") and s["errors"][0]["path"] == "b.txt"
    with pytest.raises(ValueError):
        runner.validate(files, ["pdf"])
    names = spark.createDataFrame([(1, "a.csv"), (2, "a.csv"), (3, "b.csv")], "o int, n string")
    assert [r["unique_name"] for r in runner.unique_names(names, "n", "o").orderBy("o").collect()] == ["a.csv", "a_1.csv", "b.csv"]
    req = runner.prepare_request('{"operation": "pdf.decrypt", "inputs": ["a.pdf"], "parameters": {"password": "x"}}')
    assert req["shown"]["password"] == "***"


def test_pages(spark):
    a = spark.createDataFrame([("甲", 1, "A1"), ("甲", 2, "A2"), ("乙", 1, "B1")], "doc string, page int, t string")
    m = P.merge(a, "doc", "page", F.when(F.col("doc") == "甲", 0).otherwise(1))
    assert [r["t"] for r in m.orderBy("out_page").collect()] == ["A1", "A2", "B1"]
    assert [r["t"] for r in P.extract(m.select("t", F.col("out_page").alias("page")), "page", "3,1", 3).orderBy("out_page").collect()] == ["B1", "A1"]
    assert [r["t"] for r in P.insert(a.filter("doc = '甲'"), a.filter("doc = '乙'"), "page", 2).orderBy("out_page").collect()] == ["A1", "B1", "A2"]
    with pytest.raises(ValueError):
        P.delete(a.filter("doc = '乙'"), "doc", "page", "1", 1)


def test_packages(spark):
    data = ooxml.workbook({"数据": [["Name", "N", "F"], ["Bob", 2, "=B2*2"], [None, True, "x & y"]]})
    files = spark.createDataFrame([("a.xlsx", bytearray(data)), ("bad.xlsx", bytearray(b"no"))], "path string, content binary")
    got = ooxml.cells(files).collect()
    cells = {(r["row"], r["col"]): r for r in got if r["error"] is None}
    assert cells[2, 1]["value"] == "Bob" and cells[2, 3]["formula"] == "=B2*2" and cells[3, 2]["kind"] == "bool" and cells[3, 3]["value"] == "x & y"
    assert [r["path"] for r in got if r["error"]] == ["bad.xlsx"]
    doc = ooxml.word_document([("Heading1", "客户"), ("Normal", "a < b")])
    rows = ooxml.paragraphs(spark.createDataFrame([("a.docx", bytearray(doc))], "path string, content binary")).orderBy("block").collect()
    assert [(r["style"], r["text"]) for r in rows] == [("Heading1", "客户"), ("Normal", "a < b")]
    assert {r["part_name"] for r in ooxml.parts(files.limit(1)).collect()} >= {"xl/workbook.xml"}


def test_text(spark):
    t = spark.createDataFrame([("ﬁn e​", "real-\ntime x"), (None, None)], "a string, b string")
    assert t.select(X.integrity_form("a").alias("a")).first()["a"] == "fine"
    assert t.select(X.english_words(F.col("b")).alias("w")).first()["w"] == ["real", "time", "x"]
    joined = spark.createDataFrame([("real-\ntime realtime",)], "b string").select(X.english_words(F.col("b")).alias("w")).first()["w"]
    assert joined == ["realtime", "realtime"]
    assert t.select(X.casefold("a").alias("a")).collect()[1]["a"] is None


def test_accepted_boundaries(spark):
    rows = [("v", float(i), i, i % 2 == 0) for i in range(10)]
    t = spark.createDataFrame(rows, "s string, t double, k int, f boolean")
    got = [r["k"] for r in FR.accepted_boundaries(t, "s", "t", "f", 3.0, "k").filter("boundary").orderBy("k").collect()]
    assert got == [0, 4, 8]


def test_fold(spark):
    from leafmill.functions import cells as C

    chars = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]
    words = ["".join(chars[i : i + 40]) for i in range(0, len(chars), 40)] + ["Straße", "ΑΣ ΟΔΟΣ", "ﬁx", "İI", "", "ABC"]
    t = spark.createDataFrame([(w,) for w in words], "w string")
    for r in t.select("w", C.fold(F.col("w")).alias("f")).collect():
        assert r["f"] == r["w"].casefold()


@pytest.mark.parametrize("down", [0, 1])
def test_numbered(spark, down):
    from leafmill.operators.ranks import numbered

    rows = [(i, (i * 37) % 11 if i % 13 else None) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "k long, v long").repartition(7), [F.col("v"), F.col("k")], "n", down).collect()
    order = sorted(rows, key=lambda r: ((r[1] is None, -(r[1] or 0)) if down else (r[1] is not None, r[1] or 0), r[0]))
    assert [r["k"] for r in sorted(got, key=lambda r: r["n"])] == [k for k, _ in order] and sorted(r["n"] for r in got) == list(range(1, 501))
    assert numbered(spark.createDataFrame([], "k long, v long"), [F.col("k")]).count() == 0


def test_names_and_lists():
    assert V.safe_filename("CONIN$.txt") == "_CONIN$.txt" and V.safe_filename("...") == "file"
    long = V.safe_filename("\U0001f389" * 100)
    assert len(long.encode("utf-16-le")) // 2 == 159 and long.startswith("\U0001f389" * 74 + "_")
    assert V.comma_list(" a b ，, c,") == ["a b", "c"] and V.comma_list(" , ") is None and V.comma_list(None) is None
    assert V.smart_value(" 3 ") == 3 and V.smart_value("  ") == ""


def test_recall_of_multisets(spark):
    from collections import Counter

    from leafmill.functions.text import multiset_recall

    pairs = [(["a", "a", "b", "c"], ["a", "b", "b"]), ([], ["x"]), (["x"], []), (["q"] * 3000 + ["r"], ["q"] * 1200), (list("hello world"), list("hold"))]
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", multiset_recall(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r["r"] == (sum((Counter(r["a"]) & Counter(r["b"])).values()) / len(r["a"]) if r["a"] else 1.0)


def test_near_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(4)]
    signed = [v - (1 << 64) if v >> 63 else v & ((1 << 64) - 1) for v in (x & ((1 << 64) - 1) for x in values)]
    t = spark.createDataFrame(list(enumerate(signed)), "k int, h long")
    got = {(r["a"], r["b"]) for r in FR.near_pairs(t, "k", "h", 5).collect()}
    firsts = {h: min(i for i, x in enumerate(signed) if x == h) for h in signed}
    want = {(i, j) for i, x in enumerate(signed) for j, y in enumerate(signed) if i < j and firsts[x] == i and ((firsts[y] == j and bin((x ^ y) & ((1 << 64) - 1)).count("1") <= 5) or x == y)}
    assert got == want


def test_components_and_area(spark):
    t = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 9)], "a int, b int")
    assert {r["node"]: r["component"] for r in G.components(t).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 9: 7}
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0, 2.0), (1, 2, 1.0, 1.0, 3.0, 3.0)], "page long, ord int, x0 double, y0 double, x1 double, y1 double")
    assert G.union_area(boxes).first()["area"] == 7.0
    near = boxes.select("page", F.col("ord").alias("key"), "x0", "y0", "x1", "y1")
    assert {r["cluster"] for r in G.clusters(near, "page", "key", 4.0).collect()} == {1}


def test_pixels(spark):
    x = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    t = spark.createDataFrame([("a", 4, 4, 3, bytearray(x.tobytes())), ("bad", 9, 9, 3, bytearray(b"123"))], M.PIXELS)

    def run(f):
        return {r["key"]: r for r in M.map_pixels(t, f).collect()}

    got = run(M.rotate(90))
    assert np.array_equal(np.frombuffer(got["a"]["data"], np.uint8).reshape(4, 4, 3), np.rot90(x)) and got["bad"]["data"] is None
    assert run(M.crop(1, 1, 3, 2))["a"]["width"] == 2 and run(M.resize(2, 2))["a"]["height"] == 2
    assert run(M.border((1, 2, 3, 4), (9, 9, 9)))["a"]["height"] == 10
    for f in M.FILTERS.values():
        assert run(f)["a"]["data"] is not None
    m = np.frombuffer(run(M.mosaic(2))["a"]["data"], np.uint8).reshape(4, 4, 3)
    assert (m[0, 0] == m[1, 1]).all()
    assert 0 <= M.perceptual_bits(np.outer(np.arange(32), np.arange(32))) < 1 << 64


def test_plan(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc long, at int, value string")
    acts = spark.createDataFrame([(1, 1, "insert_page", 2, "x"), (1, 2, "insert_page", 2, "y"), (1, 3, "replace_page_frame", 1, "A")], "doc long, ord int, kind string, at int, value string")
    assert [r["value"] for r in FR.apply_plan(pages, acts).orderBy("out_page").collect()] == ["A", "x", "y", "b"]


def test_stream(spark, tmp_path):
    from leafmill.streaming.segmentation import boundaries

    src = str(tmp_path / "in")
    spark.createDataFrame([("u", float(i), v) for i, v in enumerate([0.0, 9.0, 0.0, 0.0, 9.0])], "k string, t double, v double").write.parquet(src)
    s = boundaries(spark.readStream.schema("k string, t double, v double").parquet(src), "k", "t", "v", 5.0, 2.0)
    q = s.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["at"] for r in spark.sql("SELECT at FROM found ORDER BY at").collect()] == [1.0, 4.0]


def test_words_and_repair(spark):
    rows = [("well-\nknown a-b-c don't 中文ab", ["wellknown", "abc", "don't", "中", "文", "ab"]), ("Ａ x- 1", ["x", "1"]), ("", []), (None, None)]
    t = spark.createDataFrame([(a,) for a, _ in rows], "s string")
    assert [r[0] for r in t.select(X.mixed_words(F.col("s"))).collect()] == [b for _, b in rows]
    wrong = {"wellＧknown": "well-known", "itＧ s": "it- s", "a \U001001b3b": "a 'b", "Ｇ": "Ｇ", "1Ｇa": "1Ｇa", "aＧ": "aＧ", "aＧbＧc": "a-b-c", "a\u00a0Ｇb": "a\u00a0-b", "中Ｇa": "中Ｇa"}
    t = spark.createDataFrame([(a,) for a in wrong], "s string")
    assert [r[0] for r in t.select(X.repaired_words(F.col("s"))).collect()] == list(wrong.values())


def test_page_furniture(spark):
    yes = ["12", " 1 2 ", "- 7 -", "\u2014 1 0 \u2212", "\u7b2c 3 \u9875", "\u7b2c3\u9875 \u5171 10 \u9875", "\u5171 10 \u9875\u7b2c 3 \u9875", "see WWW.x.y", "at HTTPS://a", "doi.org/1", "x 3 / 10 y", "3/10", "Page  4", "on page 4 of 9"]
    no = ["12345", "- 7", "a 12", "\u7b2c \u9875", "x3/10", "3/10y", "pages 4", "frontpage 4", "page four", "", "\u7b2c1234567\u9875"]
    t = spark.createDataFrame([(x,) for x in [*yes, *no]], "s string")
    assert [r[0] for r in t.select(X.page_furniture(F.col("s"))).collect()] == [True] * len(yes) + [False] * len(no)


def test_backed_fragment(spark):
    page = "the quick brown fox jumps over the lazy dog"
    rows = [("quick brown fox jumps", True), ("short", False), ("quick brown fox jumps 3 / 9", False), ("nothing of this text is there", False), (None, False), ("PAGE 3 quick brown fox jumps", False)]
    t = spark.createDataFrame([(a, ["", " ", page]) for a, _ in rows], "s string, p array<string>")
    assert [r[0] for r in t.select(X.backed_fragment(F.col("s"), F.col("p"))).collect()] == [b for _, b in rows]


def test_block_pairs(spark):
    blocks = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "a b"), (2, "c d"), (3, "a"), (4, None), (5, "a b a b")], "k int, text string")
    outputs = spark.createDataFrame([(1, "a b c"), (2, "b c d"), (3, "x"), (4, ""), (5, "a b"), (6, None)], "k int, output string")
    got = {r["k"]: r["pair_recall"] for r in TX.block_pair_recall(blocks, outputs, "k").collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 1.0, 4: 1.0, 5: pytest.approx(1 / 3), 6: 1.0}


def test_json_and_intervals(spark):
    from collections import OrderedDict
    from dataclasses import dataclass
    from pathlib import PurePosixPath

    @dataclass
    class Point:
        x: int
        p: object

    assert V.json_safe({1: Point(2, PurePosixPath("a/b")), "n": float("nan"), "s": {2, 1}, "t": (1, OrderedDict(a=None))}) == {"1": {"x": 2, "p": "a/b"}, "n": None, "s": [1, 2], "t": [1, {"a": None}]}
    assert V.json_object('{"a": 1}') == {"a": 1} and V.json_records('[{"a": 1}]') == [{"a": 1}] and V.json_records("{}") == {}
    for bad in ("[1]", "3", "x"):
        with pytest.raises(ValueError):
            V.json_records(bad)
        with pytest.raises(ValueError):
            V.json_object(bad)
    r = spark.sql("SELECT interval '1 02:00:00.5' day to second AS i, -1.0D AS a, cast(null AS double) AS b").select(V.interval_seconds(F.col("i")), V.clock_range(F.col("a"), F.col("b"))).first()
    assert tuple(r) == (93600.5, "00:00:00.000–00:00:00.000")


def test_blank_matches(spark):
    rng = random.Random(2)
    docs = []
    for i in range(300):
        n, m = rng.randrange(1, 90), rng.randrange(1, 90)
        docs.append((i, [rng.randrange(n) for _ in range(rng.randrange(6))], [rng.randrange(m) for _ in range(rng.randrange(9))], n, m))
    docs.append((900, None, [1], 3, 3))
    docs.append((901, [1], [None, 1], 3, 3))
    want = [(901, 1, 1)]
    for i, a, b, n, m in docs[:-2]:
        last = -1
        for page in sorted(set(a)):
            due = (page + 0.5) / max(1, n) * m - 0.5
            free = [r for r in sorted(set(b)) if r > last and abs(r - due) <= max(2, abs(m - n) + 2, m * 0.04)]
            if free:
                last = min(free, key=lambda r: abs(r - due))
                want.append((i, page, last))
    t = spark.createDataFrame(docs, "doc int, source_blank array<int>, rendered_blank array<int>, source_pages int, rendered_pages int")
    assert sorted(tuple(r) for r in P.blank_matches(t, "doc").collect()) == sorted(want)


def test_inline_matches(spark):
    rng = random.Random(3)
    image = lambda: (*[i + rng.randrange(4) * 0.03 for i in range(4)], rng.randrange(1, 4), rng.randrange(1, 3))
    placed = [(rng.randrange(12), i, *image()) for i in range(90)]
    blocks = [(rng.randrange(11), i, *image()) for i in range(90)]
    used, want = set(), {}
    for page, o, *p in placed:
        near = [(abs(b[4] - p[4]) + abs(b[5] - p[5]), k) for q, k, *b in blocks if q == page and k not in used and max(abs(x - y) for x, y in zip(b[:4], p[:4])) <= 0.05]
        want[o] = min(near)[1] if near else None
        used.add(want[o])
    schema = "page int, {} int, x0 double, y0 double, x1 double, y1 double, width int, height int"
    got = M.inline_matches(spark.createDataFrame(placed, schema.format("ord")), spark.createDataFrame(blocks, schema.format("block")), "page")
    assert {r["ord"]: r["block"] for r in got.collect()} == want and any(want.values())


def test_listing(spark):
    t = catalog.catalog(spark)
    ready = catalog.listing(t, "image", True)
    assert {r["family"] for r in ready.collect()} == {"image"} and {r["capability"] for r in ready.collect()} == {"ready"}
    assert catalog.listing(t).count() == 101 and catalog.listing(t, query="no such operator").count() == 0


def test_paragraph_edges(spark):
    schema = "page int, key int, x double, y double, height double, font_size double, bold boolean, text string, col string"
    line = lambda k, y, text="words", size=10.0, col="main", x=0.0, bold=False: (1, k, x, float(y), 240.0, size, bold, text, col)
    rows = [line(1, 0), line(2, 300), line(3, 1000), line(4, 1300, size=12.0), line(5, 1600), line(6, 1900, "ended."), line(7, 2200, x=130.0), line(8, 2500, "ended."), line(9, 2800, "Smith, J. 2001"), line(10, 3100, None), line(11, 3400, col="left"), line(12, 3700, col="left", bold=None)]
    t = G.paragraphs(spark.createDataFrame(rows, schema), "page", "key").orderBy("key")
    assert [r["paragraph"] for r in t.collect()] == [1, 1, 2, 3, 4, 4, 5, 5, 6, 6, 7, 8]
    empty = spark.createDataFrame([], schema)
    assert G.paragraphs(empty, "page", "key").count() == 0
