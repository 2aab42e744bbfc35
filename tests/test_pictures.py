"""Still stretches, fused pixels, slides shown again, printed pages, connected parts, table rules and refused files, each against a plain walk."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import frames as FR
from leafmill.operators import geometry as G
from leafmill.operators import scans as SC
from leafmill.operators import textops as TX
from leafmill.plans import runner as R


def supported(ts, v, quiet, strict):
    n, support = len(ts), [0] * len(ts)
    near = lambda i, j, most: abs(v[i] - v[j]) <= most
    steps = [b - a for a, b in zip(ts, ts[1:])]
    forward = [s for s in steps if s > 1e-6]
    reach = min(1.05, max(0.30, 2.25 * float(np.percentile(forward, 30)))) if forward else 0.30
    still = [1e-6 < s <= reach + 1e-6 and near(i, i + 1, quiet) for i, s in enumerate(steps)]
    for a in range(n):
        for b in range(a + 2, n):
            if 0.55 <= ts[b] - ts[a] <= max(1.15, min(2.5, reach * 2.2)) and all(still[a + 1 : b]) and near(a, b, strict):
                support[a : b + 1] = [x + 1 for x in support[a : b + 1]]
    if any(support):
        short = n >= 4 and ts[-1] - ts[-4] >= 0.32 and all(still[-3:]) and near(-4, -1, strict)
        support = [x + (short and n - i <= 4) + (still[-1] and n - i <= 2) for i, x in enumerate(support)]
    return support


def test_stable_support(spark):
    rng, table, want = random.Random(3), [], {}
    for seq in range(150):
        step = rng.choice([0.1, 0.25, 0.4, 0.9, 3.0])
        ts, v, at = [], [], 0.0
        for _ in range(rng.choice([1, 2, 3, 4, 12, 30])):
            at += rng.choice([0.0, step, step, step, step * 1.5, step * 4])
            ts.append(at)
            v.append(rng.choice([0.0, 0.0, 1.0, 2.0, 9.0]))
        want |= {(seq, i): s for i, s in enumerate(supported(ts, v, 1.0, 1.0))}
        table += [(seq, i, t, x) for i, (t, x) in enumerate(zip(ts, v))]
    table += [(None, 0, 1.0, 0.0), (999, 0, None, 0.0)]
    want |= {(None, 0): 0, (999, 0): 0}
    rng.shuffle(table)
    near = lambda a, b: F.abs(a["v"] - b["v"]) <= 1
    got = FR.stable_support(spark.createDataFrame(table, "seq long, i long, ts double, v double"), "seq", "ts", near, near, "i")
    assert {(r["seq"], r["i"]): r["support"] for r in got.collect()} == want
    assert sum(s > 1 for s in want.values()) > 50
    assert got.limit(0).columns == ["seq", "i", "ts", "v", "support"]


def test_fuse(spark):
    rng, table, want = random.Random(4), [], {}
    for pixel in range(300):
        n = rng.randrange(1, 9)
        frames = [(f, *(min(255, max(0, rng.choice([100, 100, 100, 104, 180]) + rng.randrange(-3, 4))) for _ in range(3)), rng.choice([None, 0.0, 1.0, 5.0])) for f in range(n)]
        edge = rng.choice([None, 0.0, 0.25, 1.0])
        table += [(pixel, *f, edge) for f in frames]
        px = np.array([f[1:4] for f in frames], float)
        off = np.abs(px - np.median(px, axis=0)).mean(axis=1)
        mad, w = np.median(off), 1 / (1 + (off / 4) ** 2)
        sharp = [(-1.0 if f[4] is None else f[4]) if d <= max(7.0, mad * 2.5 + 2) else -2.0 for f, d in zip(frames, off)]
        mixed = (px * w[:, None]).sum(axis=0) / w.sum() * (1 - (edge or 0)) + px[int(np.argmax(sharp))] * (edge or 0)
        want[pixel] = mixed if mad <= 5.5 and w.sum() >= 1.5 else None
    table.append((1000, 0, None, 1, 1, 0.0, 0.0))
    rng.shuffle(table)
    got = FR.fuse(spark.createDataFrame(table, "p long, f long, r int, g int, b int, sharp double, edge double"), ["p"], "f", ["r", "g", "b"], "sharp", "edge")
    rows = {r["p"]: r for r in got.collect()}
    assert set(rows) == set(want)
    for p, x in want.items():
        assert (rows[p]["r"] is None) == (x is None)
        if x is not None:
            assert [rows[p][c] for c in "rgb"] == pytest.approx(list(x))
    assert 50 < sum(x is not None for x in want.values()) < 290


def grown(mask, by=1):
    h, w = len(mask), len(mask[0])
    return [[any(mask[v][u] for v in range(max(0, y - by), min(h, y + by + 1)) for u in range(max(0, x - by), min(w, x + by + 1))) for x in range(w)] for y in range(h)]


def cells(mask):
    return {(y, x) for y, row in enumerate(mask) for x, m in enumerate(row) if m}


def correlated(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    size = (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / size if size > 1e-9 else None


def one_slide(a, b):
    far = bin(a["hash"] ^ b["hash"]).count("1")
    ga, gb = sum(a["gray"], []), sum(b["gray"], [])
    alike = correlated(ga, gb) or 0.0
    off = sum(abs(x - y) for x, y in zip(ga, gb)) / len(ga) / 255
    ea, eb, wa, wb = cells(a["edges"]), cells(b["edges"]), cells(grown(a["edges"])), cells(grown(b["edges"]))
    kept = len(ea & wb) / max(1, len(ea)), len(eb & wa) / max(1, len(eb))
    shared = len(ea & eb) / max(1, len(ea | eb))
    if far <= 10 and alike >= 0.938 and off <= 0.060 and min(kept) >= 0.78 and shared >= 0.55:
        return True
    own, theirs = ea - wb, eb - wa
    coloured = len((own & cells(a["ink"])) | (theirs & cells(b["ink"]))) / max(1, len(own | theirs))
    notes = sorted(len(cells(x["notes"])) / len(ga) for x in (a, b))
    return far <= 12 and alike >= 0.82 and off <= 0.015 and max(kept) >= 0.98 and shared >= 0.50 and coloured >= 0.45 and notes[0] <= 0.001 and notes[1] >= 0.004


def blob(mask):
    return bytes(int(v) for row in mask for v in row)


def picture(rng, base=None):
    """A page of lines, or one like it: with noise, handwriting, or parts redrawn."""
    h, w = 18, 32
    if base is None:
        gray = [[230] * w for _ in range(h)]
        edges = [[False] * w for _ in range(h)]
        for _ in range(8):
            y, x = rng.randrange(h), rng.randrange(w - 12)
            for u in range(x, x + rng.randrange(3, 12)):
                gray[y][u], edges[y][u] = 30, True
        none = [[False] * w for _ in range(h)]
        return {"gray": gray, "edges": edges, "ink": none, "notes": none, "hash": rng.getrandbits(63)}
    new = {k: [list(r) for r in v] if k != "hash" else v for k, v in base.items()}
    kind = rng.choice(["noise", "noise", "write", "redraw"])
    for _ in range(rng.choice([0, 1, 3, 11])):
        new["hash"] ^= 1 << rng.randrange(63)
    if kind == "noise":
        y, x = rng.randrange(h), rng.randrange(w)
        new["gray"][y][x] = rng.randrange(256)
    else:
        y, x = rng.randrange(h), rng.randrange(w - 9)
        for u in range(x, x + rng.randrange(4, 9)):
            new["gray"][y][u], new["edges"][y][u] = (190, True) if kind == "write" else (30, True)
            if kind == "write":
                new["ink"][y][u] = new["notes"][y][u] = True
    return new


def test_accepted_slides(spark):
    rng, table, want = random.Random(5), [], {}
    for seq in range(25):
        shown, held = [], []
        for i in range(rng.randrange(1, 14)):
            p = picture(rng, rng.choice(shown)) if shown and rng.random() < 0.75 else picture(rng)
            shown.append(p)
            score, doubtful = rng.choice([0.1, 0.1005, 0.2, -0.1, 0.0]), rng.randrange(3)
            table.append((seq, i, 32, 18, *(blob(p[c]) for c in ("gray", "edges", "ink", "notes")), p["hash"], score, doubtful))
            at = next((k for k, h in enumerate(held) if one_slide(h[0], p)), None)
            if at is None:
                held.append((p, score, doubtful, i))
                at = len(held) - 1
            elif score - held[at][1] > 0.01 * max(abs(held[at][1]), 0.001) and doubtful <= held[at][2]:
                held[at] = p, score, doubtful, i
            want[seq, i] = at
        last = {h[3] for h in held}
        want |= {(seq, i): (want[seq, i], i in last) for i in range(len(shown))}
    rng.shuffle(table)
    schema = "seq long, segment long, width int, height int, gray binary, edges binary, ink binary, notes binary, hash long, score double, doubtful long"
    got = SC.accepted_slides(spark.createDataFrame([*table, (None, *table[0][1:])], schema))
    assert {(r["seq"], r["segment"]): (r["slide"], r["stands"]) for r in got.collect()} == want
    assert 20 < sum(not s for _, s in want.values())
    assert SC.accepted_slides(spark.createDataFrame([], schema)).collect() == []


def one_page(a, b, ignored):
    free = {(y, x) for y in range(18) for x in range(32)} - cells(grown(grown(a["ink"])) if any(map(any, a["ink"])) else a["ink"]) - cells(grown(grown(b["ink"])) if any(map(any, b["ink"])) else b["ink"]) - cells(ignored)
    if len(free) < 128:
        return False
    off = {c: abs(a["gray"][c[0]][c[1]] - b["gray"][c[0]][c[1]]) for c in free}
    changed, mean = sum(o >= 18 for o in off.values()) / len(free), sum(off.values()) / len(free) / 255
    edge = len((cells(a["edges"]) ^ cells(b["edges"])) & free) / len(free)
    order = sorted(free)
    alike = correlated([a["gray"][y][x] for y, x in order], [b["gray"][y][x] for y, x in order])
    both = [[p or q for p, q in zip(r, s)] for r, s in zip(a["edges"], b["edges"])]
    near = [off[c] for c in cells(grown(both)) & free]
    printed = sum(o >= 13 for o in near) / len(near) if near else changed
    kept = (1.0 if alike is None else alike) >= 0.955 and (printed <= 0.30 or changed <= 0.025)
    added = changed <= 0.040 and mean <= 0.018 and edge <= 0.035 and printed <= 0.36
    return changed <= 0.085 and mean <= 0.030 and edge <= 0.075 and (kept or added)


def test_same_structure(spark):
    rng, table, want = random.Random(6), [], {}
    none = [[False] * 32 for _ in range(18)]
    for k in range(150):
        a = picture(rng)
        b = a
        for _ in range(rng.randrange(0, 9)):
            b = picture(rng, b)
        if k % 10 == 0:
            b = picture(rng)
        ignored = [[k % 5 == 0 and (y < 6 or k % 25 == 0 and y < 15) for _ in range(32)] for y in range(18)]
        table.append((k, 32, 18, *(blob(p[c]) for c in ("gray", "edges", "ink") for p in (a, b)), blob(ignored) if k % 5 == 0 else None, "x"))
        want[k] = one_page(a, b, ignored if k % 5 == 0 else none)
    table += [(1000, 32, 18, None, *table[0][4:]), (1001, 0, 18, *table[0][3:]), (1002, None, 18, *table[0][3:])]
    want |= {1000: None, 1001: None, 1002: None}
    schema = "pair long, width int, height int, gray_a binary, gray_b binary, edges_a binary, edges_b binary, ink_a binary, ink_b binary, ignored binary, same string"
    got = SC.same_structure(spark.createDataFrame(table, schema))
    assert {r["pair"]: r["same"] for r in got.collect()} == want
    assert 20 < sum(v is True for v in want.values()) < 140


def test_connected_boxes(spark):
    rng, table, want = random.Random(7), [], []
    for k in range(120):
        w, h = rng.randrange(1, 14), rng.randrange(1, 14)
        mask = [[rng.random() < rng.choice([0.2, 0.5]) for _ in range(w)] for _ in range(h)]
        table.append((k, w, h, blob(mask)))
        left, part = cells(mask), 0
        for y in range(h):
            for x in range(w):
                todo, seen = [(y, x)] if (y, x) in left else [], []
                while todo:
                    c = todo.pop()
                    if c in left:
                        left.remove(c)
                        seen.append(c)
                        todo += [(c[0] + i, c[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
                if seen:
                    ys, xs = [c[0] for c in seen], [c[1] for c in seen]
                    want.append((k, part, min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(seen)))
                    part += 1
    table += [(500, 3, 3, None), (501, 3, 3, b"\1"), (502, 0, 0, b""), (503, None, 3, b"\1\1\1"), (504, 2, 1, b"\0\0")]
    got = G.connected_boxes(spark.createDataFrame(table, "key long, width int, height int, mask binary"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def grouped(rules, wide, high, least):
    """Groups of one page's rules (key, x0, y0, x1, y1), joined pass by pass."""
    left = sorted((r for r in rules if r[3] - r[1] >= max(96, wide * 0.25)), key=lambda r: ((r[2] + r[4]) / 2, r[1], r[0]))
    out = []
    while left:
        group, grew = [left.pop(0)], True
        while grew:
            x0, y0, x1, y1 = min(r[1] for r in group), min(r[2] for r in group), max(r[3] for r in group), max(r[4] for r in group)

            def fits(r):
                own, other = max(1, x1 - x0), max(1, r[3] - r[1])
                near = abs((r[1] + r[3]) / 2 - (x0 + x1) / 2) <= wide * 0.08 and max(r[2] - y1, y0 - r[4], 0) <= high * 0.30
                return near and min(own, other) / max(own, other) >= 0.70 and max(0, min(x1, r[3]) - max(x0, r[1])) / max(1, min(x1 - x0, r[3] - r[1])) >= 0.75

            new = [r for r in left if fits(r)]
            left = [r for r in left if r not in new]
            group += new
            grew = bool(new)
        if len({round((r[2] + r[4]) / 2, 1) for r in group}) >= least:
            out.append({r[0] for r in group})
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_rule_groups(spark, least):
    rng, table, want = random.Random(8), [], []
    for page in range(60):
        rules = []
        for k in range(rng.randrange(0, 25)):
            x0, y = rng.choice([50, 60, 300, 310]), rng.choice([40, 60, 61, 200, 260, 520, 700])
            rules.append((k, float(x0), float(y), x0 + rng.choice([90.0, 150.0, 200.0, 230.0, 480.0]), y + 1.0))
        table += [(page, *r, 600.0, 800.0, "x") for r in rules]
        want += [(page, i, frozenset(g)) for i, g in enumerate(grouped(rules, 600.0, 800.0, least))]
    rng.shuffle(table)
    table.append((0, 100, None, 1.0, 300.0, 2.0, 600.0, 800.0, "x"))
    schema = "page long, key long, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, group string"
    got = {}
    for r in G.rule_groups(spark.createDataFrame(table, schema), least).collect():
        got.setdefault((r["page"], r["group"]), set()).add(r["key"])
    assert sorted((p, g, sorted(k)) for (p, g), k in got.items()) == sorted((p, g, sorted(k)) for p, g, k in want)
    assert len(want) > 40


def test_candidate_quality(spark):
    joined, words = "internationalorganizations standards", "international organizations standards apply here"
    rows = [(1, joined.replace(" ", "") + "applyhere", words), (2, words, words), (3, words, "nothing of it"), (4, None, None), (5, words, None)]
    got = {r["k"]: (r["recovered"], r["text_passed"]) for r in TX.candidate_quality(spark.createDataFrame(rows, "k long, source string, output string")).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, False), 4: (False, True), 5: (False, False)}


def pdf(objects, trailer="/Root 1 0 R"):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects.items()) + b"trailer\n<< " + trailer.encode() + b" >>\n"


def packed(parts):
    """An object stream of objects by number."""
    head, body = b"", b""
    for n, x in parts.items():
        head += b"%d %d " % (n, len(body))
        body += x + b" "
    data = zlib.compress(head + body)
    return b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(parts), len(head), len(data), data)


CATALOG = b"<< /Type /Catalog >>"
CASES = {
    "plain": [pdf({1: CATALOG}), pdf({1: CATALOG, 2: b"<< /FT /Sig >>"}), pdf({1: CATALOG, 2: b"<< /FT /Sig /V 3 0 R >>", 3: b"<< /M (now) >>"}), pdf({1: CATALOG, 2: b"<< /FT /Tx /V << /Contents <00> >> >>"}),
              pdf({1: CATALOG, 2: b"<< /Length 20 >>\nstream\n/Encrypt 1 0 R /Perms << >>\nendstream"}), pdf({5: packed({1: CATALOG, 2: b"<< /FT /Sig >>"})})],
    "signed": [pdf({1: b"<< /Perms << /DocMDP 2 0 R >> >>"}), pdf({1: CATALOG, 2: b"<< /FT /Sig /V 3 0 R >>", 3: b"<< /ByteRange [0 1 2 3] >>"}), pdf({1: CATALOG, 2: b"<< /V << /Contents <00> >> /FT /Sig >>"}),
               pdf({3: b"<< /ByteRange [0 1 2 3] >>", 5: packed({1: CATALOG, 2: b"<< /FT /Sig /V 3 0 R >>"})})],
    "encrypted": [pdf({1: CATALOG}, "/Root 1 0 R /Encrypt 9 0 R"), pdf({1: b"<< /Perms 3 0 R >>"}, "/Encrypt << /V 1 >> /Root 1 0 R")],
    "damaged": [b"", None, b"PK\3\4", b"%PDF-1.7", pdf({2: CATALOG}), pdf({1: CATALOG, 5: packed({2: b"<< >>"}).replace(b"stream\nx", b"stream\ny")})],
}


def test_safety(spark):
    files = [(f"{state}{i}.PDF", c, state) for state, cases in CASES.items() for i, c in enumerate(cases)]
    table = spark.createDataFrame([*files, ("a.txt", CASES["signed"][0], None), (None, CASES["signed"][0], None)], "path string, content binary, want string")
    for encrypted, signed in [(True, True), (False, True), (True, False)]:
        rows = R.safety(table, encrypted, signed).collect()
        assert [r["state"] for r in rows] == [r["want"] for r in rows]
        wrong = {"damaged"} | ({"encrypted"} if encrypted else set()) | ({"signed"} if signed else set())
        assert [r["refused"] for r in rows] == [r["want"] in wrong for r in rows]
    assert R.only_safe(table.filter("want = 'plain'")).count() == len(CASES["plain"])
    with pytest.raises(ValueError, match="signed0.PDF is signed"):
        R.only_safe(table.filter("want in ('plain', 'signed')"))


