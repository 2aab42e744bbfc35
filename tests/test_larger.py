"""Steps that grew faster than their tables: equal rows as one kind, and groups that are dealt before they are collected."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import frames as FR
from leafmill.operators import geometry as G
from leafmill.operators import media as M
from leafmill.operators import pages as P
from leafmill.operators import regions as RG
from leafmill.operators import runs as RN
from leafmill.plans import catalog

BOX = "page long, key long, x0 double, y0 double, x1 double, y1 double"


def plan(df):
    return df._jdf.queryExecution().toString()


def near(a, b, gap=4.0):
    across = lambda s: max(0.0, b[s] - a[s + 2], a[s] - b[s + 2])
    share = lambda s: max(0.0, min(a[s + 2], b[s + 2]) - max(a[s], b[s])) / (min(a[s + 2] - a[s], b[s + 2] - b[s]) or float("inf"))
    x, y = across(2), across(3)
    return (x == 0 and y == 0) or (x <= gap and share(3) >= 0.6) or (y <= gap and share(2) >= 0.6)


@pytest.mark.parametrize("keys", [1000, 40])
def test_equal_boxes(spark, keys):
    """all pairs and clusters, though equal boxes meet as one kind; keys alone or repeated."""
    rng = random.Random(keys)
    rows = []
    for i in range(90):
        x, y = rng.randrange(0, 300, 30), rng.randrange(0, 90, 30)
        rows.append((i % 2, i if keys > 90 else rng.randrange(keys), float(x), float(y), x + rng.choice((10.0, 27.0)), y + 20.0))
    t = spark.createDataFrame([*rows, (0, None, 0.0, 0.0, 5.0, 5.0), (1, 2000, None, 0.0, 5.0, 5.0)], BOX)
    want = {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and near(a, b)}
    got = [tuple(r) for r in G.neighbours(t, "page", "key", 4.0).collect()]
    assert sorted(got) == sorted(want)
    low = {r[1]: r[1] for r in rows}
    for _ in low:
        for _, a, b in want:
            low[a] = low[b] = min(low[a], low[b])
    assert {(r["key"], r["cluster"]) for r in G.clusters(t, "page", "key", 4.0).collect()} == {*low.items(), (None, None), (2000, 2000)}
    assert keys < 90 or G._near_kinds(G._kinds(t, "page", "key"), "page", 4.0, 0.6).count() < len(want)


def test_many_equal_blocks(spark):
    """each placement with the nearest free block, against a loop over all blocks; the plan pairs no rows."""
    rng = random.Random(5)
    of = lambda n: [(k % 2, k, *(c + rng.choice((0.0, 0.04, 0.08)) for c in (0.0, 1.0, 2.0, 3.0)), rng.randrange(3), rng.choice((1, 2, None))) for k in range(n)]
    placed, blocks = of(120), of(100)
    schema = "page long, {} long, x0 double, y0 double, x1 double, y1 double, width int, height int"
    got = M.inline_matches(spark.createDataFrame(placed, schema.format("ord")), spark.createDataFrame(blocks, schema.format("block")), "page")
    want, taken = [], set()
    for p in placed:
        fit = []
        for b in blocks:
            if b[0] == p[0] and max(abs(x - y) for x, y in zip(p[2:6], b[2:6])) <= 0.05:
                w, h = max(1, b[6]), max(1, b[7] or 1)
                fit.append((p[7] is not None, abs(w - p[6]) + abs(h - p[7]) if p[7] is not None else 0, b[1]))
        free = [f for f in sorted(fit) if (p[0], f[2]) not in taken]
        block = free[0][2] if free else None
        taken.add((p[0], block))
        want.append((p[0], p[1], block))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "Join" not in plan(got)


def test_nearest_before(spark, monkeypatch):
    """F8: the smallest key before a row's own with a near hash, over several blocks, copies and nulls."""
    monkeypatch.setattr(FR, "BLOCK", 20)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = [(k, rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.choice((0, 2, 6, 7))))) for k in range(150)]
    t = spark.createDataFrame([*((k, h - (1 << 64) if h >> 63 else h) for k, h in rows), (500, None)], "k long, h long")
    want = {(k, next((o for o, g in rows if o < k and (g ^ h).bit_count() <= 12), None)) for k, h in rows} | {(500, None)}
    assert {(r["k"], r["near_before"]) for r in FR.nearest_before(t, "k", "h", 12).collect()} == want


def test_dealt_before_collected(spark):
    """equal boxes are one, options a list in each row, groups collected after rows are dealt, queries cut once."""
    sheets = spark.createDataFrame([(1, 500.0, 700.0), (1, 500.0, 700.0), (2, 2000.0, 90.0)], "k long, width double, height double")
    chosen = G.layout_choice(sheets, [("A4", 595.0, 842.0), ("A3", 842.0, 1191.0)], [("normal", 50.0), ("narrow", 18.0)])
    assert "NestedLoop" not in plan(chosen) and [r["k"] for r in chosen.orderBy("k").collect()] == [1, 2]
    runs = spark.createDataFrame([(1, 1, 1, "ab"), (1, 1, 2, "c")], "doc long, block long, run int, text string")
    assert "REPARTITION_BY_NUM" in plan(RN.replace_runs(runs, {"bc": "x"}))
    spans = spark.createDataFrame([(1, 0, 5), (1, 7, 9), (1, 20, 21)], "k long, lo long, hi long")
    merged = G.merge_intervals(spans, ["k"], "lo", "hi", 3)
    assert "REPARTITION_BY_NUM" in plan(merged) and sorted(tuple(r) for r in merged.collect()) == [(1, 0, 9, 2), (1, 20, 21, 1)]
    chars = spark.createDataFrame([(1, 5.0, 5.0), (1, 50.0, 5.0)], "page long, cx double, cy double")
    tables = spark.createDataFrame([(1, 0.0, 9.0, 0.0, 9.0)] * 3, "page long, x0 double, x1 double, y0 double, y1 double")
    outside = P.outside_tables(chars, tables)
    assert "Aggregate" in plan(outside) and [r["cx"] for r in outside.collect()] == [50.0]
    asked = catalog.search_all(catalog.catalog(spark), spark.createDataFrame([("pdf merge",)], "q string"), "q")
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 1


def test_pages_in_tasks(spark):
    """pages are folded many to a batch, whatever its cuts, and regions once for what asks for them."""
    rules = spark.createDataFrame([(p, f"{p}-{k}", 50.0, 100.0 + 20 * k, 400.0, 101.0 + 20 * k, 612.0, 792.0) for p in range(60) for k in range(p % 4)], "page long, key string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        groups = G.rule_groups(rules)
        assert "FlatMapGroupsInPandas" not in plan(groups)
        assert sorted((r["page"], r["key"], r["group"]) for r in groups.collect()) == sorted((p, f"{p}-{k}", 0) for p in range(60) for k in range(p % 4) if p % 4 > 1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    sizes = spark.createDataFrame([(1, 612.0, 792.0)], "page long, width double, height double")
    box = "page long, x0 double, y0 double, x1 double, y1 double"
    lines = spark.createDataFrame([(1, 50.0, 50.0, 500.0, 62.0, "some words of a line", 0.0)], box + ", text string, math double")
    none = lambda more: spark.createDataFrame([], box + more)
    found = RG.islands(lines, none(""), none(", items int, white boolean"), none(", key string"), sizes)
    assert "InPandas" in plan(found)
    told = RG.assessed(lines, found, sizes)
    assert "InPandas" not in plan(told) and [r["whole"] for r in told.collect()] == [None]
