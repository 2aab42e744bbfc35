"""Decontamination, hard negatives and ranked search against brute force on small tables with nulls, odd texts, ties and repeats."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import balltree, decontam, fmindex, hardneg, tiered, words

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, items string, spans int, `__id` int"


def fold(text):
    return LETTERS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def tables(seed=0, n=60, vocab=30):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocab)] + ["Ünï", "ünï", "日本", "É", "x1", "İ"]
    some = lambda k: rng.choice([" ", "\n", ", ", "--"]).join(rng.choice(names) for _ in range(k))
    items = [(i, some(rng.randint(1, 40))) for i in range(12)] + [(12, None), (13, ""), (14, "?! ,"), (15, "w1"), (None, some(14)), (3, some(20))]
    items.append(items[2])
    docs = []
    for i in range(n):
        parts = [some(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = fold(rng.choice(items)[1])
            a = rng.randint(0, len(w))
            parts += [" ".join(w[a : a + rng.randint(1, 25)]).upper(), some(rng.randint(0, 9))]
        docs.append((i, rng.choice(["", " "]).join(parts), "kept", 1, 2))
    docs += [(n, None, None, None, None), (n + 1, "", "a", 1, 1), (n + 2, ".. ..", "a", 1, 1), (n + 3, "w1 " * 3000, "a", 1, 1), (None, items[1][1], None, 1, 1), (5, "other text of an id " + items[4][1], "b", 1, 1), docs[7], docs[7]]
    return docs, items


@pytest.fixture(scope="module")
def data():
    return tables()


@pytest.fixture(scope="module")
def frames(spark, data):
    return spark.createDataFrame(data[0], DOCS).repartition(3), spark.createDataFrame(data[1], "item_id long, text string")


def decontaminated(docs, items, width):
    phrases = collections.defaultdict(set)
    for item, text in items:
        w = fold(text)
        for p in range(max(len(w) - width + 1, 1) if w else 0):
            phrases[tuple(w[p : p + width])].add("" if item is None else str(item))
    out = []
    for doc, text, *_ in docs:
        w = fold(text)
        hit, found = set(), set()
        for size in {len(p) for p in phrases}:
            for p in range(len(w) - size + 1):
                if got := phrases.get(tuple(w[p : p + size])):
                    hit |= set(range(p, p + size))
                    found |= got
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return out


def spread(spans):
    return [w for s in spans for w in range(s["first"], s["last"] + 1)]


def test_word_hashes_are_those_of_words():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB9 ,é日.\n_Z`[") for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["a" * 3_000_000, "b c " * 400_000]
    import pyarrow as pa

    from leafmill.llm.common import utf8

    h, at = words.of_rows(*utf8(pa.array(texts)))
    seen = {}
    for i, t in enumerate(texts):
        w = fold(t)
        assert len(w) == at[i + 1] - at[i]
        for x, y in zip(w, h[at[i] : at[i + 1]].tolist()):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
    v = words.Vocabulary(h[::7])
    known = set(h[::7].tolist())
    assert ((v.number(h) > 0) == [x in known for x in h.tolist()]).all()
    assert not words.Vocabulary(np.zeros(0, np.uint64)).number(h).any()


def test_fm_index_finds_every_occurrence():
    rng = random.Random(1)
    for _ in range(150):
        m = rng.choice([1, 2, 5, 300])
        strings = [[rng.randint(1, m) for _ in range(rng.randint(1, 50))] for _ in range(rng.randint(0, 10))]
        strings += strings[:3] * rng.choice([0, 1, 4])
        s = np.array([x for y in strings for x in [*y, 0]], np.int32)
        index = fmindex.FmIndex(s, every=rng.choice([1, 3, 16]))
        phrases = np.array([[rng.randint(1, m + 2) for _ in range(4)] for _ in range(25)])
        sizes = np.array([rng.randint(0, 4) for _ in range(25)])
        which, place = index.locate(*index.ranges(phrases, sizes))
        want = {(i, j) for i in range(25) if sizes[i] for j in range(len(s)) if s[j : j + sizes[i]].tolist() == phrases[i][: sizes[i]].tolist()}
        assert set(zip(which.tolist(), place.tolist())) == want and len(which) == len(want)


@pytest.mark.parametrize("block", [decontam.BLOCK, 40])
def test_decontamination_against_brute_force(spark, data, frames, block):
    got = decontam.find(*frames, block=block).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2:]))
    assert sorted(((r.id, r.n_words, spread(r.spans), r["items"]) for r in got), key=key) == sorted(decontaminated(*data, decontam.WINDOW), key=key)
    for r in got:
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.spans, r.spans[1:]))


def test_small_shards_give_the_same(spark, data, frames, monkeypatch):
    sent = spark.sparkContext.broadcast(decontam.Phrases([(r.item, bytes(r.words)) for p in decontam.blocks(frames[1], "text", "item_id") for r in p.collect()], decontam.WINDOW))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in data[0]], pa.int64()), pa.array([0] * len(data[0]), pa.int64()), pa.array([d[1] for d in data[0]])], names=["id", "print", "text"])
    whole = [r for b in decontam._search(sent, True)([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(decontam, "SHARD_BYTES", 1)
    monkeypatch.setattr(decontam, "_SLICE", 300)
    assert [r for b in decontam._search(sent, True)([batch.slice(i, 2) for i in range(0, len(batch), 2)]) for r in b.to_pylist()] == whole


def test_decontaminated_texts_keep_the_rest(spark, data, frames):
    cleaned = decontam.clean(*frames)
    assert cleaned.columns == frames[0].columns
    hits = collections.Counter()
    for doc, n, hit, _ in decontaminated(*data, decontam.WINDOW):
        hits[doc, n - len(hit)] += 1
    assert collections.Counter((r.doc_id, len(fold(r.text))) for r in cleaned.collect()) == hits
    assert cleaned.filter("doc_id = 60").first().text is None and cleaned.filter("items is null").count() == 2


def test_nothing_to_search(spark, frames):
    none = frames[1].filter("false")
    assert decontam.find(frames[0], none).filter("size(items) > 0 or size(spans) > 0").count() == 0
    assert decontam.find(frames[0].filter("false"), frames[1]).count() == 0
    assert tiered.search(frames[0], none).count() == 0 and tiered.search(frames[0].filter("false"), frames[1]).count() == 0
    empty = spark.createDataFrame([], "id long, label long, vec array<bigint>")
    assert hardneg.mine(empty, F.col("id") % 100 == 0).count() == 0


# ---- 12


def vectors(seed=0, n=700, d=6, labels=4, spread_=40):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(labels), [rng.randint(-spread_, spread_) for _ in range(rng.choice([d, d, d, d - 2]))]) for i in range(n)]
    rows += [(n, 1, []), (n + 1, 99, [5] * d), (n + 2, 0, [1 << 40] * d), (n + 3, 1, [-(1 << 30)] * d)]
    return rows + rows[100:104] + [rows[100]] + [(50, 2, [1] * d)] * 80


def mined(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, v in rows:
        if is_anchor(a):
            scored = [(-dot(v, w), i, m) for i, m, w in rows if i != a]
            for s, p, m in sorted(x for x in scored if x[2] == label)[:positives]:
                fits = sorted((t, i) for t, i, k in scored if k != label and -low * s <= -100 * t <= -high * s)
                out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fits[:negatives])]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "id long, label long, vec array<bigint>")
    want = mined(rows, lambda i: i % 50 == 0)
    assert sorted(map(tuple, hardneg.mine(df, F.col("id") % 50 == 0).collect())) == want and len(want) > 100
    monkeypatch.setattr(hardneg, "BLOCK", 4)
    assert sorted(map(tuple, hardneg.mine(df, F.col("id") % 50 == 0).collect())) == want


def test_ball_trees_prune_and_stay_exact():
    rng = np.random.default_rng(5)
    middles = rng.integers(-400, 400, (30, 8))
    x = middles[rng.integers(0, 30, 6000)] + rng.integers(-9, 10, (6000, 8))
    ids, labels = np.arange(6000), rng.integers(0, 3, 6000)
    tree = balltree.BallTree.build(ids, labels, x)
    assert sorted(tree.ids.tolist()) == ids.tolist()
    for n in range(len(tree.begin)):
        assert (np.linalg.norm(tree.x[tree.begin[n] : tree.end[n]] - tree.centre[n], axis=1) <= tree.radius[n] + 1e-6).all()
    s = balltree.Search(ids[:40], labels[:40], x[:40], same=True, most=5)
    s.seed(ids[:40], labels[:40], x[:40])
    s.add(tree)
    for q in range(40):
        score = x @ x[q]
        fit = sorted((-int(score[i]), i) for i in range(6000) if labels[i] == labels[q] and i != q)[:5]
        assert [(-a, b) for a, b in zip(s.score[q].tolist(), s.found[q].tolist())] == fit
    assert s.opened < 40 * len(tree.begin) / 4  # of all nodes for all queries
    low, high = np.full(40, 1000), np.full(40, 90_000)
    w = balltree.Search(ids[:40], labels[:40], x[:40], same=False, most=10, low=low, high=high)
    w.add(tree)
    for q in range(40):
        score = x @ x[q]
        fit = sorted((-int(score[i]), i) for i in range(6000) if labels[i] != labels[q] and 1000 <= score[i] <= 90_000)[:10]
        assert [(-a, b) for a, b in zip(w.score[q].tolist(), w.found[q].tolist()) if a > balltree.NONE] == fit


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001], 1), (1, None, 1), (2, [0.1, None], 1), (3, [nan], 1), (4, [inf, 0.0], 1), (5, [1.0], None), (None, [1.0], 1), (6, [], 1), (7, [-1.0], 0)]
    got = hardneg.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vec_id", "label", "embedding").collect()
    assert sorted(map(tuple, got)) == [(0, 1, [128, -1]), (6, 1, []), (7, 0, [-256])]


# ---- 13


def ranked(docs, items, most):
    texts = [(d[0], collections.Counter(fold(d[1]))) for d in docs]
    n = sum(1 for _, c in texts if c)
    total = sum(sum(c.values()) for _, c in texts)
    df = collections.Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in texts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(fold(text)) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:most])]
    return out


def by_row(rows):
    return collections.Counter(tuple(r)[:4] for r in rows)


def test_ranked_search_against_brute_force(spark, data, frames, monkeypatch):
    want = by_row(ranked(*data, tiered.TOP))
    assert by_row(tiered.search(*frames).collect()) == want
    monkeypatch.setattr(tiered, "ITEMS", 5)
    monkeypatch.setattr(tiered, "_EXPAND", 50)
    assert by_row(tiered.search(*frames).collect()) == want


def test_items_are_proved_in_the_first_tier_that_can(spark, monkeypatch):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(20)]
    docs = [(i, " ".join(rng.choice(common) for _ in range(rng.randint(5, 60))) + (" rare gem" * rng.randint(1, 9) if i % 9 == 0 else "") + (f" odd{i % 40}" * (i % 5))) for i in range(900)]
    items = [(0, "rare"), (1, "gem rare odd3"), (2, " ".join(common)), (3, "c1 rare"), (4, "odd7 c2 c3"), (5, "nowhere")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = by_row(ranked(docs, items, 20))
    for limits in (((60, 64), (300, 8)), ((5, 1000), (40, 1000)), ((10**6, 1), (10**6, 1))):
        monkeypatch.setattr(tiered, "FIRST", limits)
        got = tiered.search(d, b, most=20).collect()
        assert by_row(got) == want
        tiers = {r.item_id: r.tier for r in got}
        assert len(set(tiers.values())) > 1 or limits[0][0] in (5, 10**6)
        if limits[0][0] == 10**6:
            assert set(tiers.values()) == {0}
    monkeypatch.setattr(tiered, "COMPLETE", 3)
    assert by_row(tiered.search(d, b, most=20).collect()) == want


def test_impacts_are_whole_numbers():
    n = np.array([1, 10**7, 5, 3], np.int64)
    tf = np.array([1, 3, 2, 10**6], np.int64)
    for docs, total in ((10, 100), (10**12, 10**15)):
        assert tiered.impacts(tf, n, docs, total).tolist() == [10**9 * t // (1000 * t + 20 * (50 + 50 * m * docs // total)) for t, m in zip(tf.tolist(), n.tolist())]
    assert tiered.weight(10, 10) >= 0


def test_digest_of_items(spark):
    rows = spark.createDataFrame([(["1", "10", "2"],), ([],)], "x array<string>").select(decontam.digest(F.col("x")).alias("d")).collect()
    assert [r.d for r in rows] == [hashlib.sha256(x).hexdigest() for x in (b"1,10,2", b"")]
