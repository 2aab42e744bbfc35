"""Schedules of frames, scores from pixels, audited pictures and letters' advances, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import advances as AD
from leafmill.operators import audit as AU
from leafmill.operators import candidates as CD


def half_even(x):
    return round(x)


def evenly(values, k):
    if k <= 0:
        return []
    if len(values) <= k:
        return list(values)
    return sorted({values[half_even(i * (len(values) - 1) / max(k - 1, 1))] for i in range(k)})


def scheduled(first, last, ts, frame, fps):
    positions = list(range(first, last + 1))
    if len(positions) > 16:
        step = (last - first) / 11
        positions = sorted({last if i == 11 else half_even(first + i * step) for i in range(12)} | {first, first + 1, last - 1, last})
    base = {frame[p] for p in positions}
    start, end = frame[first], frame[last]
    dense = {start, end}
    if fps > 0 and end > start:
        elapsed = ts[last] - ts[first]
        local = (end - start) / elapsed if elapsed > 1e-6 else fps
        stride = max(1, half_even((local if local > 0 else fps) / 8))
        head = next((frame[p] for p in range(first, last + 1) if ts[p] >= ts[first] + 2.0), end)
        tail = start
        for p in range(first, last + 1):
            if ts[p] <= ts[last] - 1.25:
                tail = frame[p]
        dense |= set(range(start, head + 1, stride)) | {head} | set(range(tail, end + 1, stride)) | {tail, end}
    if len(base | dense) <= 32:
        return sorted(base | dense)
    if len(dense) > 32:
        return evenly(sorted(dense), 32)
    return sorted(dense | set(evenly(sorted(base - dense), 32 - len(dense))))


def test_schedules(spark):
    rng = random.Random(3)
    scans, segments, want = [], [], {}
    for seq in range(30):
        every, n = rng.choice([0.25, 0.5, 1.0, 2.0]), rng.randint(1, 120)
        ts = [round(i * every, 3) for i in range(n)]
        frame = [int(t * 25) for t in ts]
        scans += [(seq, i, t, f) for i, (t, f) in enumerate(zip(ts, frame))]
        at, k = 0, 0
        while at < n:
            last = min(n - 1, at + rng.choice([0, 1, 3, 12, 17, 40, 100]))
            segments.append((seq, k, at, last))
            want[seq, k] = scheduled(at, last, ts, frame, 25.0)
            at, k = last + 1, k + 1
    s, c = spark.createDataFrame([*segments, (0, 99, 500, 510)], "seq int, segment int, first int, last int"), spark.createDataFrame(scans, "seq int, n int, ts double, frame long").repartition(3)
    got = CD.schedule(s, c, 25.0)
    assert {(r.seq, r.segment): r.frames for r in got.collect()} == want
    assert max(map(len, want.values())) == 32
    merged = {(r.seq, r.frame): r.segments for r in CD.frames_to_read(got).collect()}
    assert merged == {(q, f): sorted(k for (p, k), fs in want.items() if p == q and f in fs) for (q, _), fs0 in want.items() for f in fs0}


def plain_edges(g, least):
    h, w = len(g), len(g[0])
    at = lambda y, x: g[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    out = []
    for y in range(h):
        row = []
        for x in range(w):
            gx = at(y - 1, x + 1) + 2 * at(y, x + 1) + at(y + 1, x + 1) - at(y - 1, x - 1) - 2 * at(y, x - 1) - at(y + 1, x - 1)
            gy = at(y + 1, x - 1) + 2 * at(y + 1, x) + at(y + 1, x + 1) - at(y - 1, x - 1) - 2 * at(y - 1, x) - at(y - 1, x + 1)
            row.append(abs(gx) + abs(gy) >= least)
        out.append(row)
    return out


def plain_scores(group, h, w):
    """group: (planes, ignored, support) in order."""
    edges, sharp, written = [], [], []
    for planes, ignored, _ in group:
        g = [[(299 * planes[0][y][x] + 587 * planes[1][y][x] + 114 * planes[2][y][x]) // 1000 for x in range(w)] for y in range(h)]
        at = lambda y, x: g[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]  # noqa: E731, B023
        bend = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * g[y][x] for y in range(h) for x in range(w)]
        sharp.append(sum(b * b for b in bend) / len(bend) - (sum(bend) / len(bend)) ** 2)
        edges.append(sum(map(sum, plain_edges(g, CD.EDGE))) / (h * w))
        old, hits, usable = group[0][0], 0, 0
        for y in range(h):
            for x in range(w):
                if ignored is not None and ignored[y][x]:
                    continue
                usable += 1
                was, now = [p[y][x] for p in old], [p[y][x] for p in planes]
                hits += max(abs(a - b) for a, b in zip(was, now)) >= 24 and max(now[1], now[2]) - now[0] >= 40 and (now[2] - was[2] >= 24 or now[1] - was[1] >= 24)
        written.append(hits / max(1, usable))
    low, high = np.percentile(sharp, 10), np.percentile(sharp, 90)
    norm = [min(1.0, max(0.0, (s - low) / (high - low))) if high - low > max(1e-6, abs(low) * 1e-6) else 0.0 for s in sharp]
    return [e + 0.006 * s - 2.4 * p + 0.0015 * (u or 0) for e, s, p, (_, _, u) in zip(edges, norm, written, group)]


def test_scores_come_from_pixels(spark):
    rng, rows, want, best = random.Random(5), [], {}, {}
    h, w = 6, 9
    plane = lambda: [[rng.choice([0, 40, 128, 255]) for _ in range(w)] for _ in range(h)]
    flat = lambda p: bytes(v for r in p for v in r)
    for segment in range(25):
        group = []
        base = [plane() for _ in range(3)]
        for at in range(rng.randint(1, 6)):
            planes = [[list(r) for r in p] for p in base]
            for _ in range(rng.randint(0, 12)):
                planes[rng.choice([1, 2])][rng.randrange(h)][rng.randrange(w)] = rng.choice([0, 255])
            ignored = [[rng.random() < 0.2 for _ in range(w)] for _ in range(h)] if segment % 3 == 0 else None
            group.append((planes, ignored, rng.choice([0, 0, 1, 3, None])))
            rows.append((1, segment, at, w, h, *(flat(p) for p in planes), None if ignored is None else flat(ignored), group[-1][2]))
        scores = plain_scores(group, h, w)
        want |= {(segment, at): s for at, s in enumerate(scores)}
        pool = [i for i, g in enumerate(group) if (g[2] or 0) > 0] or range(len(group))
        top = max(scores[i] for i in pool)
        best[segment] = max(i for i in pool if scores[i] >= top - 0.0035)
    rows += [(2, 0, 0, w, h, None, rows[0][6], rows[0][7], None, 0), (2, 0, 1, w, h, *rows[0][5:8], None, 0), (2, 1, 0, w, 99, *rows[0][5:8], None, 0)]
    df = spark.createDataFrame(rows, "seq int, segment int, at int, width int, height int, red binary, green binary, blue binary, ignored binary, support int").repartition(3)
    got = CD.scored(df).collect()
    assert len(got) == len(rows) and CD.scored(df).columns == [*df.columns, "score"]
    for r in got:
        assert r.score == (None if r.seq == 2 else pytest.approx(want[r.segment, r["at"]], abs=1e-12))
    assert {r.segment: r["at"] for r in CD.chosen(df).collect()} == best


def plain_measures(a, b, y0, y1, x0, x1):
    pixels = [(y, x) for y in range(y0, y1) for x in range(x0, x1)]
    va, vb = [int(a[p]) for p in pixels], [int(b[p]) for p in pixels]
    n, ma, mb = len(pixels), sum(va) / len(pixels), sum(vb) / len(pixels)
    saa, sbb, sab = sum((v - ma) ** 2 for v in va), sum((v - mb) ** 2 for v in vb), sum((p - ma) * (q - mb) for p, q in zip(va, vb))
    flat_a, flat_b = len(set(va)) == 1, len(set(vb)) == 1
    out = {"alike": 1.0 if flat_a and flat_b else 0.0 if flat_a or flat_b else sab / math.sqrt(saa * sbb), "off": sum(abs(p - q) for p, q in zip(va, vb)) / n}
    for name, least in (("", CD.EDGE), ("strong_", AU.STRONG_EDGE)):
        ea, eb = plain_edges(a.tolist(), least), plain_edges(b.tolist(), least)
        h, w = a.shape
        had, has = sum(ea[y][x] for y, x in pixels), sum(eb[y][x] for y, x in pixels)
        kept = sum(ea[y][x] and any(eb[v][u] for v in range(max(0, y - 1), min(h, y + 2)) for u in range(max(0, x - 1), min(w, x + 2))) for y, x in pixels)
        out[name + "kept"] = kept / had if had else 1.0
        out[name + "ratio"] = has / had if had else float(has) if has else 1.0
    return out


def test_tiles_are_measured_at_once():
    rng = np.random.default_rng(0)
    for h, w, tile in ((13, 22, 5), (8, 8, 8), (3, 40, 16)):
        a = rng.integers(0, 256, (h, w))
        b = np.clip(a + rng.integers(-60, 60, (h, w)), 0, 255)
        b[:5, :5] = a[:5, :5] = 7
        got = AU.measures(a, b, tile)
        for i, y in enumerate(range(0, h, tile)):
            for j, x in enumerate(range(0, w, tile)):
                for k, v in plain_measures(a, b, y, min(h, y + tile), x, min(w, x + tile)).items():
                    assert got[k][i, j] == pytest.approx(v), k


def test_pictures_are_audited(spark):
    rng = np.random.default_rng(1)
    base = np.kron(rng.integers(0, 2, (12, 12)), np.ones((4, 4), int)) * 180 + 30
    pictures = []
    for k in range(8):
        a = np.stack([base, base, np.roll(base, 1, 0)], 2).astype(np.uint8)
        b = np.clip(a.astype(int) + rng.integers(-3, 4, a.shape), 0, 255).astype(np.uint8)
        if k in (1, 2):
            b[16:32, :16] = 128  # a tile lost
        if k == 3:
            b = 255 - a
        if k == 4:
            b = a.copy()
        pictures.append((a, b, k % 2 == 0))
    rows = [(str(k), 48, 48, 3, photo, a.tobytes(), b.tobytes()) for k, (a, b, photo) in enumerate(pictures)]
    rows += [("none", 48, 48, 3, None, None, rows[0][6]), ("size", 47, 48, 3, True, rows[0][5], rows[0][6]), ("zero", 0, 0, 0, True, b"", b"")]
    df = spark.createDataFrame(rows, "key string, width int, height int, channels int, photo boolean, source binary, output binary")
    got = {r.key: r for r in AU.audited(df, 16).collect()}
    assert all(got[k].pixels is None and got[k].passed is None for k in ("none", "size", "zero"))
    for k, (a, b, photo) in enumerate(pictures):
        r = got[str(k)]
        one, two = (CD.grey(x[..., 0], x[..., 1], x[..., 2]) for x in (a, b))
        whole = plain_measures(one, two, 0, 48, 0, 48) | {"off": float(np.abs(a.astype(int) - b).mean())}
        assert [r[m] for m in AU.MEASURES] == pytest.approx([whole[m] for m in AU.MEASURES])
        assert r.passed == AU.passes(whole, photo)
        out = np.frombuffer(bytes(r.pixels), np.uint8).reshape(a.shape)
        if not r.passed:
            assert (out == a).all() and (r.tiles, r.risky) == (1, 1)
            continue
        bad = np.zeros((48, 48))
        for y in range(0, 48, 16):
            for x in range(0, 48, 16):
                m = plain_measures(one, two, y, y + 16, x, x + 16)
                bad[y : y + 16, x : x + 16] = bool(AU.risky({n: np.array(v) for n, v in m.items()}, photo))
        assert (r.tiles, r.risky) == (9, int(bad.sum()) // 256)
        if not bad.any():
            assert (out == b).all()
            continue
        kernel = [math.exp(-0.5 * i * i) for i in range(-3, 4)]  # the blend is one pixel wide here
        clamp = lambda i: min(max(i, 0), 47)
        weight = np.array([[sum(kernel[i + 3] * kernel[j + 3] * bad[clamp(y + i), clamp(x + j)] for i in range(-3, 4) for j in range(-3, 4)) / sum(kernel) ** 2 for x in range(48)] for y in range(48)])
        want = b * (1 - weight[..., None]) + a * weight[..., None]
        assert np.abs(out - want).max() <= 1 + 1e-6 and (out[20:28, 4:12] == a[20:28, 4:12]).mean() > 0.9
    assert [got[str(k)].passed for k in (3, 4)] == [False, True] and sum(got[str(k)].risky > 0 for k in (1, 2)) >= 1


def test_advances_of_letters(spark):
    rng = random.Random(7)
    letters, lines = [], {}
    for page in range(3):
        for line in range(30):
            x, direction = 0.0, rng.choice([(1.0, 0.0), (None, None), (0.0, 2.0)])
            for n in range(rng.randint(1, 15)):
                font, size, text = rng.choice(["f", "g", None]), rng.choice([0.5, 10.0, 10.2, 10.25, 12.0]), rng.choice(["a", "b", "c", " ", ""])
                letters.append((page, line, n, text, font, size, x if direction[1] != 2.0 else 5.0, 0.0 if direction[1] != 2.0 else x, *direction))
                lines.setdefault((page, line), []).append(letters[-1])
                x += rng.choice([0.01, 1.0, 4.0, 5.5, 6.0, 30.0])
    df = spark.createDataFrame(letters, "page int, line int, n int, text string, font string, size double, x double, y double, dx double, dy double").repartition(3)
    found = []
    for row in lines.values():
        for p, q in zip(row, row[1:]):
            dx, dy = (1.0, 0.0) if p[8] is None else (p[8], p[9])
            a = ((q[6] - p[6]) * dx + (q[7] - p[7]) * dy) / math.hypot(dx, dy)
            if p[3].strip() and q[3].strip() and 0.05 <= a <= max(1.0, p[5]) * 1.8 and p[4]:
                found.append((p[4], round(max(1.0, p[5]) * 2) / 2, p[3], a))
    got = AD.advances(df)
    assert sorted((r.font, r.bucket, r.letter, round(r.advance, 9)) for r in got.collect()) == sorted((*f[:3], round(f[3], 9)) for f in found)
    want = {}
    for keep, q in ((3, 0.25), (2, 0.35), (1, 0.35), (0, 0.35)):
        groups = {}
        for f in found:
            groups.setdefault(f[:keep], []).append(f[3])
        for key, v in groups.items():
            if keep < 3 or len(v) >= 3:
                want[3 - keep, *key] = sorted(v)[int((len(v) - 1) * q)]
    learned = AD.model(got)
    assert {(r.level, *[x for x in (r.font, r.bucket, r.letter) if x is not None]): r.advance for r in learned.collect()} == pytest.approx(want)
    told = AD.expected(df, learned)
    assert told.columns == [*df.columns, "expected", "expected_by"] and told.count() == len(letters)
    for r in told.collect():
        keys = [(0, r.font, round(max(1.0, r["size"]) * 2) / 2, r.text), (1, r.font, round(max(1.0, r["size"]) * 2) / 2), (2, r.font), (3,)]
        level = next(i for i, k in enumerate(keys) if k in want)
        assert (r.expected, r.expected_by) == (pytest.approx(want[keys[level]]), AD.LEVELS[level])
    assert AD.expected(df, AD.model(got.filter("false"))).filter(F.col("expected").isNotNull()).count() == 0
