"""Packages read and written as a data source, resampled and turned pictures, and the catalogue over many requests."""

import math
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import media as M
from leafmill.operators import pages as P
from leafmill.operators import sheets as S
from leafmill.plans import catalog
from leafmill.sources import packages as PK


def test_packages_are_whole_or_not_there(spark, tmp_path):
    spark.dataSource.register(PK.Packages)
    rng = random.Random(1)
    want = {f"p{i}.docx": [(f"word/{k}.xml", rng.randbytes(rng.randint(0, 500))) for k in range(rng.randint(1, 6))] for i in range(20)}
    rows = [(p, n, k, bytearray(b)) for p, parts in want.items() for k, (n, b) in enumerate(parts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "package string, part string, place int, payload binary").repartition(3)
    out = str(tmp_path / "out")
    os.makedirs(out)
    PK.to_packages(df).write.format("packages").mode("append").save(out)
    assert sorted(os.listdir(out)) == sorted(want)
    got = {}
    for r in spark.read.format("packages").load(out).orderBy("path", "place").collect():
        got.setdefault(os.path.basename(r.path), []).append((r.part, bytes(r.payload)))
    assert got == want
    with zipfile.ZipFile(os.path.join(out, "p0.docx")) as z:
        assert z.testzip() is None
    # names that are there already: nothing of the job is seen
    more = spark.createDataFrame([("p0.docx", "a", 0, bytearray(b"x")), ("new.docx", "a", 0, bytearray(b"y"))], df.schema)
    with pytest.raises(Exception, match="p0.docx"):
        PK.to_packages(more).write.format("packages").mode("append").save(out)
    assert sorted(os.listdir(out)) == sorted(want)
    PK.to_packages(more).write.format("packages").mode("overwrite").save(out)
    assert sorted(os.listdir(out)) == sorted([*want, "new.docx"])
    one = spark.read.format("packages").load(os.path.join(out, "p0.docx")).collect()
    assert [(r.part, bytes(r.payload)) for r in one] == [("a", b"x")]
    # a task that fails leaves no half file, nor do the others of its job
    bad = df.filter("package < 'p2'").withColumn("package", F.concat(F.lit("f"), "package")).withColumn("payload", F.when(F.col("place") == 1, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("payload")))
    for wrong in (PK.to_packages(bad), df.filter("place = 0").withColumn("package", F.lit("../x")), df.repartition(1).sortWithinPartitions("place", "package")):
        with pytest.raises(Exception):
            wrong.write.format("packages").mode("append").save(out)
        assert sorted(os.listdir(out)) == sorted([*want, "new.docx"])
    empty = str(tmp_path / "empty")
    os.makedirs(empty)
    PK.to_packages(df.filter("false")).write.format("packages").mode("append").save(empty)
    assert os.listdir(empty) == [] and spark.read.format("packages").load(empty).count() == 0


def plain_kernel(name, d):
    a = abs(d)
    if name == "box":
        return 1.0 if -0.5 <= d < 0.5 else 0.0
    if name == "linear":
        return max(0.0, 1 - a)
    if name == "cubic":
        return 1.5 * a**3 - 2.5 * a * a + 1 if a < 1 else -0.5 * a**3 + 2.5 * a * a - 4 * a + 2 if a < 2 else 0.0
    sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
    return sinc(a) * sinc(a / 3) if a < 3 else 0.0


def plain_side(row, to, name):
    n, out = len(row), []
    for i in range(to):
        middle, stretch = (i + 0.5) * n / to, max(1.0, n / to)
        w = [plain_kernel(name, (k + 0.5 - middle) / stretch) for k in range(n)]
        out.append(sum(a * b for a, b in zip(row, w)) / sum(w))
    return out


@pytest.mark.parametrize("name", list(M.KERNELS))
def test_resampling_by_its_kernel(name):
    rng = np.random.default_rng(2)
    for h, w, th, tw in ((5, 7, 3, 4), (4, 4, 9, 6), (6, 3, 6, 2), (1, 1, 3, 2), (8, 9, 1, 1)):
        x = rng.integers(0, 256, (h, w, 2), dtype=np.uint8)
        got = M.resampled(x, tw, th, name)
        for ch in range(2):
            wide = [plain_side(r, tw, name) for r in x[..., ch].astype(float).tolist()] if tw != w else x[..., ch].astype(float).tolist()
            tall = [plain_side(list(c), th, name) for c in zip(*wide)] if th != h else [list(c) for c in zip(*wide)]
            want = np.array([list(r) for r in zip(*tall)])
            assert got[..., ch].shape == (th, tw) and np.abs(got[..., ch] - np.clip(want, 0, 255)).max() <= 0.5 + 1e-6
    flat = np.full((7, 5, 1), 93, np.uint8)
    assert (M.resampled(flat, 3, 11, name) == 93).all() and (M.resampled(x, 9, 8, name) == x).all()


def test_turned_pictures():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (5, 8, 3), dtype=np.uint8)
    assert (M.rotate(90)(x) == np.rot90(x)).all() and (M.rotate(-90)(x) == np.rot90(x, 3)).all()
    for angle in (10, 45.5, 133, -30):
        got, t = M.rotate(angle, 17)(x), math.radians(angle)
        h, w = 5, 8
        nw, nh = math.ceil(abs(w * math.cos(t)) + abs(h * math.sin(t)) - 1e-9), math.ceil(abs(w * math.sin(t)) + abs(h * math.cos(t)) - 1e-9)
        assert got.shape == (nh, nw, 3)
        for y in range(nh):
            for z in range(nw):
                u, v = z - (nw - 1) / 2, y - (nh - 1) / 2
                sx, sy = u * math.cos(t) - v * math.sin(t) + (w - 1) / 2, u * math.sin(t) + v * math.cos(t) + (h - 1) / 2
                want = np.zeros(3)
                for py in range(math.floor(sy), math.floor(sy) + 2):
                    for px in range(math.floor(sx), math.floor(sx) + 2):
                        area = max(0.0, 1 - abs(sx - px)) * max(0.0, 1 - abs(sy - py))
                        want += area * (x[py, px].astype(float) if 0 <= py < h and 0 <= px < w else 17.0)
                assert np.abs(got[y, z] - want).max() <= 0.5 + 1e-6
    assert (M.rotate(30, 40)(np.full((6, 6, 1), 40, np.uint8)) == 40).all()


def test_sheets_of_many_books(spark):
    rows = [("a", 1, "y"), ("a", 0, "x"), ("a", 2, "z"), ("b", 0, "x"), ("c", 0, "y")]
    df = spark.createDataFrame(rows, "book string, ordinal int, sheet string")

    def done(*a):
        out = {}
        for r in S.manage_sheets(df, *a).orderBy("book", "ordinal").collect():
            out.setdefault(r.book, []).append((r.sheet, r.source, r.error))
        return out

    got = done({"x": "w"}, ["z"], {"w": "v"}, ["v", "y", "w"])
    assert got["a"] == [("v", "x", None), ("y", "y", None), ("w", "x", None)]
    assert got["b"] == [("x", "x", "no sheet z")] and got["c"] == [("y", "y", "no sheet x")]
    assert done({}, ["x"])["b"] == [("x", "x", "the last sheet can't be deleted")]
    assert {b: v[0][2] for b, v in done({"x": "y"}).items()} == {"a": "can't rename x to y", "b": None, "c": "no sheet x"}
    assert done({}, [], {"x": "y"})["a"][0][2] == "can't copy x to y" and done({"x": "x"})["b"] == [("x", "x", None)]
    assert done({}, [], {}, ["x", "y"])["a"][0][2] == "the order must name every sheet once"


def test_marks_stay_on_their_page(spark):
    pages = [(i, 100.0 + 40 * (i % 9), 500.0 - 30 * (i % 11), i % 12 + 1, 5.0 + i, 9.0, float(13 * i)) for i in range(120)] + [(500, None, 1.0, 1, 1.0, 1.0, 0.0), (501, 1.0, 1.0, 0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(pages, "page int, width double, height double, count int, mark_width double, mark_height double, angle double")
    got = {}
    for r in P.watermark_grid(df).collect():
        got.setdefault(r.page, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {p[0]: p[3] for p in pages[:120]}
    for p in pages[:120]:
        t = math.radians(p[6])
        w, h = (p[4] * abs(math.cos(t)) + p[5] * abs(math.sin(t))), (p[4] * abs(math.sin(t)) + p[5] * abs(math.cos(t)))
        marks = got[p[0]]
        for m in marks:
            assert m.x - w * m.scale / 2 >= -1e-9 and m.x + w * m.scale / 2 <= p[1] + 1e-9 and m.y - h * m.scale / 2 >= -1e-9 and m.y + h * m.scale / 2 <= p[2] + 1e-9
        for a in marks:
            for b in marks:
                assert a is b or abs(a.x - b.x) >= w * a.scale - 1e-9 or abs(a.y - b.y) >= h * a.scale - 1e-9


def test_requests_against_the_catalogue(spark):
    ops, rows, want = catalog.operators(), [], []
    values = [None, "", "1", "1.5", "-3", "abc", "true", "否", "inf", "1e400", "2", "auto", "png"]
    for o in ops.values():
        for p in o.parameters:
            for v in values:
                rows.append((o.id, p.name, v))
                try:
                    new = p.normalize(v)
                    want.append((True, None if new is None else new))
                except (ValueError, OverflowError):
                    want.append((False, None))
    rows.append((next(iter(ops)), "no such parameter", "1"))
    want.append((False, None))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, operation string, name string, value string")
    got = {r.i: r for r in catalog.normalized(df, catalog.parameters(spark)).collect()}
    for i, (fine, new) in enumerate(want):
        r = got[i]
        assert (r.error is None) == fine, (rows[i], r)
        if fine and isinstance(new, bool):
            assert r.value == str(new).lower()
        elif fine and isinstance(new, (int, float)):
            assert float(r.value) == new
        elif fine:
            assert r.value == (None if new is None else str(new)), rows[i]
    queries = ["sort", "pages media", "WORD to", "", "图", "pdf", "zzz", "image.  crop", None]
    table = catalog.catalog(spark)
    found = {r.q: r.found for r in catalog.search_all(table, spark.createDataFrame([(q,) for q in queries], "q string"), "q").collect()}
    for q in queries:
        assert found[q] == ([] if q is None else sorted(r.id for r in catalog.search(table, q).collect())), q
