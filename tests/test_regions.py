"""Regions of pages against plain loops over every pair, and what follows from them."""

import math
import random
import re

import pytest

from leafmill.operators import regions as R

W, H = 600.0, 800.0


def page(rng):
    """lines (box, text, math), images, drawings (box, items, white), rules."""

    def box(w, h):
        x, y = rng.uniform(-5, W - 20), rng.uniform(0, H - 10)
        return (x, y, x + rng.uniform(2, w), y + rng.uniform(1, h))

    lines = []
    for _ in range(rng.randint(0, 25)):
        text = rng.choice(["Figure 3: a view", "Table 2. numbers", "x = y", "plain words of some length that go on and on here", "label", "bad � one", "", None, "more plain text here"])
        lines.append((box(rng.choice([60, 300]), 14), text, rng.choice([0.0, 0.0, 0.5, 0.1, None])))
    images = [box(160, 160) for _ in range(rng.choice([0, 1, 2, 6]))] + [box(20, 20) for _ in range(rng.choice([0, 2]))]
    drawings = [(box(60, 60), rng.choice([1, 5, 50, 120, None]), rng.random() < 0.2) for _ in range(rng.choice([0, 3, 30, 70]))]
    rules = []
    for _ in range(rng.choice([0, 0, 1, 2])):
        x, y, w = rng.uniform(20, 200), rng.uniform(50, 600), rng.uniform(160, 380)
        rules += [(x, y + 20 * k, x + w, y + 20 * k + 1) for k in range(rng.randint(2, 6))]
    if rng.random() < 0.3:
        x0, y1, x1, y0 = images[0] if images else (5.0, 90.0, 300.0, 10.0)
        images.append((x1, y1, x0, y0))  # corners the wrong way round
    return lines, images, drawings, rules


def clip(b, by):
    x0, y0, x1, y1 = min(b[0], b[2]), min(b[1], b[3]), max(b[0], b[2]), max(b[1], b[3])
    return max(0.0, x0 - by), max(0.0, y0 - by), min(W, x1 + by), min(H, y1 + by)


def union(*bs):
    return min(b[0] for b in bs), min(b[1] for b in bs), max(b[2] for b in bs), max(b[3] for b in bs)


def area(b):
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def shared(a, b, k):
    return max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k]))


def apart(a, b, k):
    return max(a[k] - b[k + 2], b[k] - a[k + 2], 0)


def far(a, b):
    return math.hypot(apart(a, b, 0), apart(a, b, 1))


def centre(b):
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def holds(r, b):
    x, y = centre(b)
    return r[0] <= x <= r[2] and r[1] <= y <= r[3]


def merge(regions, gap):
    """regions: (box, kinds, reasons, parts); any two within gap become one, until none are."""
    regions = list(regions)
    again = True
    while again:
        again = False
        for i in range(len(regions)):
            for j in range(i):
                if far(regions[i][0], regions[j][0]) <= gap:
                    a, b = regions.pop(i), regions.pop(j)
                    regions.append((union(a[0], b[0]), a[1] | b[1], a[2] | b[2], a[3] + b[3]))
                    again = True
                    break
            if again:
                break
    return regions


def naive(lines, images, drawings, groups):
    page_area = W * H
    told = [(clip(b, 0.0), t or "", m or 0.0) for b, t, m in lines]
    caption = [bool(re.match(r"\s*(?:fig(?:ure)?|table)\.?\s*[0-9ivxlcdm]+(?:\s|[:.]|$)", t, re.I)) for _, t, _ in told]
    body = [b[3] > H * 0.06 and b[1] < H * 0.97 for b, _, _ in told]
    out = []
    pictures = [b for b in (clip(i, 0.75) for i in images) if area(b) / page_area >= 0.0015]
    left = set(range(len(pictures)))
    while left:
        group, todo = [], [left.pop()]
        while todo:
            i = todo.pop()
            group.append(i)
            for j in list(left):
                a, b = pictures[i], pictures[j]
                part = [shared(a, b, k) / max(1.0, min(a[k + 2] - a[k], b[k + 2] - b[k])) for k in (0, 1)]
                upper, lower = min(a[3], b[3]), max(a[1], b[1])
                parted = lower >= upper and any(c and upper <= centre(x[0])[1] <= lower for c, x in zip(caption, told))
                if (apart(a, b, 0) <= 36 and part[1] >= 0.45) or (apart(a, b, 1) <= 20 and part[0] >= 0.45 and not parted):
                    left.remove(j)
                    todo.append(j)
        box = union(*(pictures[i] for i in group))
        if len(group) > 1 or area(box) / page_area >= 0.01:
            out.append((box, {"figure"}, {"images"}, len(group)))
    strokes = []
    for b, n, white in drawings:
        b, n = clip(b, 0.75), max(1, n or 1)
        if not (white and n <= 1 and area(b) / page_area >= 0.05) and not (b[3] <= 80 and b[3] - b[1] <= 3 and n < 40):
            strokes.append((b, set(), {n}, 1))
    lists = [(b, k, r, p) for b, k, r, p in strokes]
    # items add up, so they are carried beside
    totals = [(b, {"vector"}, {"dense drawing"}, (p, next(iter(r)))) for b, k, r, p in lists]
    again = True
    while again:
        again = False
        for i in range(len(totals)):
            for j in range(i):
                if far(totals[i][0], totals[j][0]) <= 4.0:
                    a, b = totals.pop(i), totals.pop(j)
                    totals.append((union(a[0], b[0]), a[1], a[2], (a[3][0] + b[3][0], a[3][1] + b[3][1])))
                    again = True
                    break
            if again:
                break
    vectors = [(b, k, r, p[0]) for b, k, r, p in totals if p[1] >= 100 or p[0] >= 40 or (p[1] >= 40 and area(b) / page_area >= 0.02)]
    out += merge(vectors, 32.0)
    for rules in groups:
        if len(rules) < 3:
            continue
        rules = [clip(r, 0.0) for r in rules]
        box, ys = union(*rules), [centre(r)[1] for r in rules]
        rows = [b for b, _, _ in told if min(ys) - 3 <= centre(b)[1] <= max(ys) + 3 and shared(box, b, 0) >= 0.20 * min(b[2] - b[0], box[2] - box[0])]
        if rows:
            out.append((clip(union(box, *rows), 1.5), {"table"}, {"ruled table"}, len(rules)))
    bad = ["�" in t for _, t, _ in told]
    prose = [len(re.findall("[A-Za-z]{3,}", t)) >= 4 and len(re.sub(r"\s", "", t)) >= 36 for _, t, _ in told]
    supports = [i for i in range(len(told)) if body[i] and not caption[i] and not prose[i] and told[i][2] > 0]
    formulas = []
    for i, (b, t, m) in enumerate(told):
        if body[i] and not caption[i] and not prose[i] and not bad[i] and m >= 0.30 and (b[2] - b[0]) / W <= 0.65 and abs(centre(b)[0] - W / 2) / W <= 0.30:
            near = [told[j][0] for j in supports if abs(centre(told[j][0])[1] - centre(b)[1]) <= 22 and far(b, told[j][0]) <= 12]
            formulas.append((union(b, *near), {"formula"}, {"formula"}, 1))
    out += merge(formulas, 8.0)
    out += merge([(clip(b, 1.5), {"encoding"}, {"unreadable characters"}, 1) for i, (b, _, _) in enumerate(told) if bad[i] and body[i]], 1.0)
    grown = []
    for base, kinds, reasons, parts in out:
        if not kinds & {"formula", "encoding"}:
            box = base
            for i, (b, t, _) in enumerate(told):
                part = shared(base, b, 0) * shared(base, b, 1) / max(area(b), 1e-9)
                n = len(t.strip(" "))
                beside = (apart(base, b, 1) <= 16 and shared(base, b, 0) > 0) or (apart(base, b, 0) <= 16 and shared(base, b, 1) > 0 and n <= 32)
                label = beside and b[3] - b[1] <= 24 and n <= 180
                if label and not holds(base, b) and part <= 0 and caption[i]:
                    continue
                if holds(base, b) or part >= 0.10 or label:
                    box = union(box, b)
            base = clip(box, 2.5)
        grown.append((base, kinds, reasons, parts))
    out = merge([r for r in grown if r[1] == {"vector"}], 32.0) + [r for r in grown if r[1] != {"vector"}]
    text = [b for i, (b, _, _) in enumerate(told) if body[i] and not caption[i]]
    while True:
        was = sorted(r[0] for r in out)
        out = merge(out, 1.0)
        out = [(union(box, *(b for b in text if holds(box, b) or shared(box, b, 0) * shared(box, b, 1) >= 0.35 * max(area(b), 1e-9))), k, r, p) for box, k, r, p in out]
        if sorted(r[0] for r in out) == was:
            break
    out.sort(key=lambda r: (r[0][1], r[0][0], r[0][3], r[0][2]))
    return [(n, *box, next(iter(k)) if len(k) == 1 else "complex", ", ".join(sorted(r)), p) for n, (box, k, r, p) in enumerate(out)]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    pages = [page(rng) for _ in range(60)] + [([], [], [], [])]
    corners = "x0 double, y0 double, x1 double, y1 double"
    lines = spark.createDataFrame([(p, *b, t, m) for p, x in enumerate(pages) for b, t, m in x[0]] + [(0, None, 1.0, 2.0, 3.0, "x", 0.0), (None, 1.0, 1.0, 2.0, 3.0, "x", 0.0), (999, 1.0, 1.0, 2.0, 3.0, "x", 0.0)], f"page long, {corners}, text string, math double")
    images = spark.createDataFrame([(p, *b) for p, x in enumerate(pages) for b in x[1]], f"page long, {corners}")
    drawings = spark.createDataFrame([(p, *b, n, w) for p, x in enumerate(pages) for b, n, w in x[2]], f"page long, {corners}, items int, white boolean")
    rules = spark.createDataFrame([(p, i, *b) for p, x in enumerate(pages) for i, b in enumerate(x[3])], f"page long, key long, {corners}")
    sizes = spark.createDataFrame([(p, W, H) for p in range(len(pages))], "page long, width double, height double")
    return pages, lines, images, drawings, rules, sizes


def test_regions_against_plain_loops(spark, made):
    pages, lines, images, drawings, rules, sizes = made
    got = {}
    for r in R.islands(lines, images, drawings, rules, sizes).orderBy("page", "region").collect():
        got.setdefault(r.page, []).append(tuple(r)[1:])
    of = {}
    for r in R.rule_groups(rules.join(sizes, "page").withColumnsRenamed({"width": "page_width", "height": "page_height"})).collect():
        of.setdefault(r.page, {}).setdefault(r.group, []).append(pages[r.page][3][r.key])
    for p, (a, b, c, _) in enumerate(pages):
        want = naive(a, b, c, list(of.get(p, {}).values()))
        have = got.get(p, [])
        assert [(x[0], *x[5:7]) for x in have] == [(x[0], *x[5:7]) for x in want], p
        for x, y in zip(have, want):
            assert x[1:5] == pytest.approx(y[1:5])
    kinds = {x[5] for v in got.values() for x in v}
    assert kinds >= {"figure", "vector", "table", "formula", "encoding", "complex"}


def test_pages_are_assessed(spark, made):
    pages, lines, images, drawings, rules, sizes = made
    found = R.islands(lines, images, drawings, rules, sizes).cache()
    boxes = {}
    for r in found.collect():
        boxes.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1))
    got = {r.page: r for r in R.assessed(lines, found, sizes).collect()}
    assert len(got) == len(pages)
    for p, x in enumerate(pages):
        plain = lambda t: len(re.sub(r"\s", "", t or ""))
        mine = boxes.get(p, [])
        free = [t for b, t, _ in x[0] if not any(holds(r, b) or shared(r, b, 0) * shared(r, b, 1) >= 0.35 * max(area(b), 1e-9) for r in mine)]
        r = got[p]
        assert (r.regions, r.characters, r.editable) == (len(mine), sum(plain(t) for _, t, _ in x[0]), sum(map(plain, free)))
        assert r.share == pytest.approx(min(1.0, sum(map(area, mine)) / (W * H)))
        if r.characters < 8:
            assert r.whole == "little or no text"
        elif r.share >= 0.85:
            assert r.whole == "regions fill the page"
        elif r.editable < 8:
            assert r.whole == "no text outside of regions"
        elif any("�" in (t or "") for t in free):
            assert r.whole == "unreadable characters outside of regions"
        else:
            assert r.whole in (None, "many figures in two columns", "a wide region at the bottom")
    assert len({r.whole for r in got.values()}) >= 4


def test_pages_kept_whole(spark):
    corners = "x0 double, y0 double, x1 double, y1 double"
    sizes = spark.createDataFrame([(p, 100.0, 100.0) for p in range(4)], "page long, width double, height double")
    kept = lambda p, kind, *b: (p, 0, *map(float, b), kind, "x", 1)
    found = [kept(0, "figure", x, y, x + 30, y + 30) for x in (5, 60) for y in (5, 50)] + [kept(1, "table", 5, 60, 95, 98)] + [kept(2, "table", 5, 60, 80, 98)] + [kept(3, "figure", 1, 1, 62, 20)] * 4
    regions = spark.createDataFrame(found, f"page long, region int, {corners}, kind string, reasons string, parts int")
    lines = spark.createDataFrame([(p, 40.0, 45.0, 55.0, 48.0, "some words to keep") for p in range(4)], f"page long, {corners}, text string")
    assert {r.page: r.whole for r in R.assessed(lines, regions, sizes).collect()} == {0: "many figures in two columns", 1: "a wide region at the bottom", 2: None, 3: None}
