"""Every query of the reference's operators against its SQL, on the smallest tables."""

import glob
import math
import os

import numpy as np
import pytest

from leafmill.plans import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", list(Q.ENTRIES))
def test_query(spark, duck, name):
    query, sql = Q.ENTRIES[name]
    got = query(spark, DATA)
    rows = got.collect()
    if sql is None:
        assert got.columns
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(got.columns)
    a = sorted(tuple(norm(r[c]) for c in order) for r in rows)
    b = sorted(tuple(norm(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    import __spark_entry__ as e

    rows = {r["l_returnflag"]: r for r in e.entry(spark).collect()}
    assert set(rows) == {"A", "N", "R"}
    for r in rows.values():
        assert r["total"] == r["l_linestatus=O"] + r["l_linestatus=F"]
    assert set(e.oracle_sql()) <= set(e.queries())


# ---- whole tables: more rows than the subsets that the SQL of some queries names


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """A folder of tables whose ids go beyond those subsets, and their rows."""
    d = str(tmp_path_factory.mktemp("whole"))
    ids = range(1, 3301)
    part = [(i, f"part {i}", "Brand#1" if i % 3 else "Brand#2", i * 31 % 50 + 1) for i in ids]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i, f"c{i}", "AUTO") for i in range(1, 1102)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(i, f"s{i}") for i in range(1, 1102)], "s_suppkey long, s_name string").write.parquet(f"{d}/supplier.parquet")
    return d, part


def _box_rows(part):
    return [(k % 40, k, k * 7919 % 1000, k * 104729 % 1000, k * 7919 % 1000 + s, k * 104729 % 1000 + s) for k, _, _, s in part]


def _near(part):
    found = set()
    pages = {}
    for b in _box_rows(part):
        pages.setdefault(b[0], []).append(b)
    for page, boxes in pages.items():
        for i, (_, k, x0, y0, x1, y1) in enumerate(boxes):
            for _, j, u0, v0, u1, v1 in boxes[i + 1 :]:
                gx, gy = max(0, u0 - x1, x0 - u1), max(0, v0 - y1, y0 - v1)
                ox, oy = max(0, min(x1, u1) - max(x0, u0)) / min(x1 - x0, u1 - u0), max(0, min(y1, v1) - max(y0, v0)) / min(y1 - y0, v1 - v0)
                if gx == gy == 0 or (gx <= 4 and oy >= 0.6) or (gy <= 4 and ox >= 0.6):
                    found.add((page, k, j))
    return found


def test_all_boxes(spark, whole):
    d, part = whole
    near = _near(part)
    assert any(b > 3000 for _, _, b in near)
    run = lambda name: Q.ENTRIES[name][0](spark, d).collect()
    got = [(r["page"], r["a"], r["b"]) for r in run("box_neighbours")]
    assert len(got) == len(near) and set(got) == near
    root = {k: k for k, *_ in part}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for _, a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r["key"]: r["cluster"] for r in run("components")} == {k: find(k) for k in root}
    grids = {}
    unions = {}
    for page, _, x0, y0, x1, y1 in _box_rows(part):
        grid = grids.setdefault(page, np.zeros((1100, 1100), bool))
        grid[x0:x1, y0:y1] = True
        for u in unions.setdefault(page, []):
            if math.hypot(max(0, x0 - u[2], u[0] - x1), max(0, y0 - u[3], u[1] - y1)) <= 10:
                u[:] = min(u[0], x0), min(u[1], y0), max(u[2], x1), max(u[3], y1)
                break
        else:
            unions[page].append([x0, y0, x1, y1])
    assert {r["page"]: r["area"] for r in run("union_area")} == {p: int(g.sum()) for p, g in grids.items()}
    assert {(r["page"], r["cluster"]): [r["x0"], r["y0"], r["x1"], r["y1"]] for r in run("greedy_unions")} == {(p, i): u for p, us in unions.items() for i, u in enumerate(us)}


def test_all_rows(spark, whole):
    d, part = whole
    run = lambda name: Q.ENTRIES[name][0](spark, d).collect()
    assert {r["p_partkey"] for r in run("layout_choice")} == {p[0] for p in part}
    assert sorted(r["text"] for r in run("line_rows")) == sorted(p[1] for p in part)
    want = {}
    for brand in ("Brand#1", "Brand#2"):
        for n, (k, _, _, s) in enumerate(sorted((p for p in part if p[2] == brand), key=lambda p: (p[3], p[0])), 1):
            want[k] = (n, f"b_{n:03d}_image{s}-{k}.png")
    assert {r["p_partkey"]: (r["number"], r["out_name"]) for r in run("media_members")} == want
    assert {r["s_suppkey"]: r["new_name"] for r in run("rename_index")} == {i: f"photo_{i:03d}.jpg" for i in range(1, 1102)}
    assert {(r["index"], r["text"], r["filename"]) for r in run("mail_merge")} == {(i, f"Dear c{i}, of AUTO: {i}.", f"{i:03d}_c{i}") for i in range(1, 1102)}


def test_all_events_tables_and_pages(spark, duck):
    run = lambda name: Q.ENTRIES[name][0](spark, DATA).collect()
    events = duck.sql("SELECT event_id, user_id, epoch_us(ts) / 1000000.0, floor(abs(value))::BIGINT % 5, value FROM events").fetchall()
    users = {}
    for e in events:
        users.setdefault(e[1], []).append(e)
    want = {e[0]: max((s, q, t) for _, _, t, s, q in users[e[1]] if abs(t - e[2]) <= 40000)[2] for e in events}
    got = run("nearest_stable")
    assert len(got) == len(events) and {r["event_id"]: r["frame_ts"] for r in got} == want
    tables = {}
    for k, size in duck.sql("SELECT p_partkey, p_size FROM part").fetchall():
        tables.setdefault(k % 50, []).append(size)
    cells = duck.sql("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem").fetchall()
    outside = sorted((o, n) for o, n, k, q in cells if not any(s <= q <= s + 10 and 0 <= n <= 4 for s in tables.get(k % 50, [])))
    assert sorted((r["l_orderkey"], r["l_linenumber"]) for r in run("outside_tables")) == outside
    pages = [(k, "highlight") for (k,) in duck.sql("SELECT page_id FROM pages").fetchall()]
    assert sorted((r["page"], r["kind"]) for r in run("page_markup")) == sorted([*pages, (7, "note")])
