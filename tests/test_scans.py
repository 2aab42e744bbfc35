"""Slides of synthetic recordings against a plain walk over their scans."""

import math
import random
from statistics import median

import numpy as np
import pytest

from leafmill.operators import scans as SC

W, H = 16, 12
SCHEMA = "seq long, ts double, width int, height int, gray binary, edges binary, hash long"


def page(rng, ink=40):
    gray = np.full((H, W), 240)
    edges = np.zeros((H, W), bool)
    for _ in range(ink):
        y, x = rng.randrange(H), rng.randrange(W)
        gray[y, x], edges[y, x] = rng.randrange(100), True
    return gray, edges, rng.getrandbits(64)


def recording(seed, step):
    """Pages shown for a while, noise, dissolves, pages that gain lines, single odd frames."""
    rng = random.Random(seed)
    out, at = [], 0.0
    gray, edges, bits = page(rng)
    for _ in range(rng.randrange(6, 12)):
        kind = rng.choice(["cut", "cut", "dissolve", "reveal", "flash", "tone"])
        if kind == "dissolve":
            g, e, b = page(rng)
            steps = rng.randrange(2, 7)
            order = [(y, x) for y in range(H) for x in range(W)]
            rng.shuffle(order)
            for i in range(1, steps + 1):
                gray, edges = gray.copy(), edges.copy()
                for y, x in order[(i - 1) * W * H // steps : i * W * H // steps]:
                    gray[y, x], edges[y, x] = g[y, x], e[y, x]
                bits ^= 1 << rng.randrange(64)
                out.append((at, gray, edges, bits))
                at += step
            bits = b
        elif kind == "reveal":
            g, e, _ = page(rng, rng.randrange(3, 25))
            gray, edges, bits = np.where(e, g, gray), edges | e, bits ^ rng.getrandbits(64) & rng.getrandbits(64)
        elif kind == "tone":
            gray, bits = np.clip(gray + rng.choice([-30, 25]), 0, 255), rng.getrandbits(64)
        else:
            gray, edges, bits = page(rng)
        for _ in range(1 if kind == "flash" else rng.randrange(1, 9)):
            shown = gray.copy()
            shown[rng.randrange(H), rng.randrange(W)] = rng.randrange(256)
            out.append((at, shown, edges, bits ^ (1 << rng.randrange(64))))
            at += step
    return out


def measured(a, b, mask):
    (_, ga, ea, ha), (_, gb, eb, hb) = a, b
    off = [abs(int(ga[y, x]) - int(gb[y, x])) for y in range(H) for x in range(W) if mask[y, x]]
    kept = sum(any(eb[v, u] for v in range(max(0, y - 1), min(H, y + 2)) for u in range(max(0, x - 1), min(W, x + 2))) for y in range(H) for x in range(W) if ea[y, x])
    return sum(o >= 18 for o in off) / len(off), sum(off) / len(off) / 255, float((ea != eb).mean()), bin(ha ^ hb).count("1"), kept / ea.sum() if ea.any() else 0.0


def walk(scans, sensitivity, mask):
    """first and last scan of each slide, decided scan by scan."""
    if not scans:
        return []
    ch, ed, ha = SC.CHANGE[sensitivity]
    sch, sed = SC.SPARSE[sensitivity]
    steps = [None] + [measured(a, b, mask) for a, b in zip(scans, scans[1:])]
    mid = lambda i: median(s[i] for s in steps[1:])
    dev = lambda i: median(abs(s[i] - mid(i)) for s in steps[1:])
    begins = [0]
    if len(scans) > 1:
        lc, le, lt = max(ch, mid(0) + 6 * dev(0)), max(ed, mid(2) + 5 * dev(2)), max(0.012, mid(2) + 2.5 * dev(2))
        every = max(0.001, scans[1][0] - scans[0][0])
        least, reach = max(1, round(1 / every)), max(2, min(6, math.ceil(3 / every)))
        for i in range(1, len(scans)):
            if i - begins[-1] < least:
                continue
            c, m, e, h, _ = steps[i]
            new = c >= lc and (e >= le or h >= ha or m >= 0.065)
            new |= h >= ha + 3 and ((e >= le * 1.45 and c >= lc * 0.72) or (m >= 0.05 and e >= lt) or (c >= sch and e >= sed and m >= 0.01))
            for k in range(2, reach + 1):
                if new or i - k < begins[-1]:
                    break
                c, m, e, h, kept = measured(scans[i - k], scans[i], mask)
                moved = sum(s[0] >= 0.01 or s[1] >= 0.003 or s[2] >= 0.008 for s in steps[i - k + 1 : i + 1])
                far = (c >= lc * 0.88 and (e >= le * 0.82 or h >= ha + 2 or m >= 0.05)) or (c >= sch and e >= sed and m >= 0.012 and h >= ha + 2)
                more = scans[i][2].sum() >= scans[i - k][2].sum() * 0.96 and kept >= 0.88
                new = moved >= max(2, k // 2) and far and not more
            if new:
                begins.append(i)
    ends = [b - 1 for b in begins[1:]] + [len(scans) - 1]
    out = []
    for first, last in zip(begins, ends):
        if out:
            calm = [n for n in range(out[-1][0], first) if scans[n][0] <= scans[first - 1][0] - 1]
            before = scans[calm[-1] if calm else first - 1]
            c, m, e, _, kept = measured(before, scans[last], mask)
            if first == last or (kept >= 0.975 and scans[last][2].sum() >= 0.96 * max(1, before[2].sum()) and c <= 0.24 and m <= 0.05 and e <= 0.14):
                out[-1][1] = last
                continue
        out.append([first, last])
    return [tuple(x) for x in out]


def rows(seq, scans):
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return [(seq, t, W, H, g.astype(np.uint8).tobytes(), e.astype(np.uint8).tobytes(), signed(h)) for t, g, e, h in scans]


@pytest.mark.parametrize("sensitivity,ignored", [("balanced", []), ("sensitive", [(0, 0, 5, 4)]), ("conservative", [(0, 0, 16, 12)])])
def test_slides(spark, sensitivity, ignored):
    films = {i: recording(i, [0.25, 0.5, 1.0, 2.0][i % 4]) for i in range(24)}
    films[100] = films[0][:1]
    films[101] = films[1][:2]
    mask = SC.usable(W, H, ignored)
    table = [r for i, f in films.items() for r in rows(i, f)]
    random.Random(1).shuffle(table)
    got = {}
    for r in SC.slides(spark.createDataFrame([*table, (None, *table[0][1:])], SCHEMA), sensitivity, ignored).orderBy("seq", "segment").collect():
        got.setdefault(r["seq"], []).append((r["first"], r["last"]))
    want = {i: walk(f, sensitivity, mask) for i, f in films.items()}
    assert got == want
    assert sum(map(len, want.values())) > 3 * len(want)


def test_no_scans(spark):
    assert SC.slides(spark.createDataFrame([], SCHEMA)).collect() == []
