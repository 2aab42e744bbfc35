"""Damaged files, white space within white space, and rows of one id that have different texts."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import matroska, setjoin, suffixdedup, tokenfiles

DDL = "doc_id long, text string"


def mutated(rng, data):
    data = bytearray(data)
    for _ in range(rng.randint(1, 4)):
        kind, at = rng.random(), rng.randrange(len(data)) if data else 0
        if kind < 0.5 and data:
            data[at] = rng.randrange(256) if rng.random() < 0.6 else data[at] ^ 1 << rng.randrange(8)
        elif kind < 0.7:
            del data[at:]
        elif kind < 0.85:
            del data[at : at + rng.randint(1, 9)]
        else:
            data[at:at] = data[at // 2 : at // 2 + rng.randint(1, 40)]
        if not data:
            break
    return bytes(data)


def test_no_file_crashes_the_reader(spark):
    rng = random.Random(4)
    whole = [matroska.write(matroska.payload_of("x" * n)[1]) for n in (0, 100, 3000)]
    files = [mutated(rng, rng.choice(whole)) for _ in range(20_000)]
    told = 0
    for f in files:
        m = matroska.parse(f)
        told += m.error is not None
        for p in m.packets:
            assert 0 <= p.start and 0 <= p.length and p.start + p.length <= len(f)
    assert told > 3_000
    block = matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80abc")
    nested = b""
    for _ in range(1000):
        nested = matroska.element(matroska.SEGMENT, nested)
    far = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.element(matroska.TIMESTAMP, b"\xff" * 8) + block))
    track = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE_BLOCK, b"\x01\xff\xff\xff\xff\xff\xff\xfe\x00\x00\x80abc")))
    short = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00")))
    odd = [matroska.element(matroska.SEGMENT, block), nested, far, track, short, b"", b"\x00", None]
    assert [matroska.parse(f).error is not None for f in odd] == [True] * 5 + [False, True, True]
    df = spark.createDataFrame([(i, f) for i, f in enumerate([*files[:300], *odd])], "k long, media binary")
    assert matroska.packets(df, "k").count() >= 0
    rows = matroska.digest(df, "k", carry=()).collect()
    assert len(rows) == 308 and sum(r.error is not None for r in rows) > 50


def test_stored_files_are_told_whole(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "a", "a", "é" * 700, "x" * 5000, "x" * 5000, "\U0001f389 tail"])]
    df = matroska.media_column(spark.createDataFrame(rows, DDL))
    files = {r.doc_id: bytes(r.media) for r in df.collect()}
    got = {r.doc_id: r for r in matroska.digest(df).collect()}
    for i, text in rows:
        n, payload = matroska.payload_of(text)
        x = [b - 128 for b in payload]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.media_bytes, r.media_sha256, r.error) == (len(files[i]), hashlib.sha256(files[i]).hexdigest(), None)
        assert f"sum={sum(x)};energy={sum(v * v for v in x)};crossings={crossings}" in r.feature and f"packets={r.n_packets};" in r.feature
    for a, b in ((0, 1), (2, 3), (5, 6)):
        assert files[a] == files[b] and got[a][2:] == got[b][2:]
    assert struct.pack(">f", 0.0) == bytes(4)


def test_ids_of_white_space_within_white_space():
    enc = tokenfiles.encoder(tokenfiles.default_tokenizer())
    space = [" ", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\xa0", "\x85", " ", "　", "\x1c", "\x1f", " ", " ", "​"]
    other = ["a", "x", "Be", "don't", "é", "漢", "12", "½", "!!", "."]
    for seed in range(50_000):
        rng = random.Random(seed)
        t = "".join(rng.choice(space if rng.random() < 0.6 else other) for _ in range(rng.randint(0, 12)))
        assert enc.encode(t) == enc._library(t), t
    for t in ("x \xa0 \xa0 y", "a\n \xa0 \xa0 b", "1\n\n \xa0 \xa0 "):
        assert enc.encode(t) == enc._library(t)


def brute(rows):
    raw = [(t or "").encode() for _, t in rows]
    out = []
    for (own, _), data in zip(rows, raw):
        gone = bytearray(len(data))
        if own is not None:
            before = {other[i : i + 50] for (i2, _), other in zip(rows, raw) if i2 is not None and i2 < own for i in range(len(other) - 49)}
            for i in range(len(data) - 49):
                if data[i : i + 50] in before:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((own, len(data), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("clash", [True, False])
def test_rows_of_one_id_are_cut_by_their_own_texts(spark, clash):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(1, 30))] + [rng.choice(shared)[rng.randint(0, 40) :] for _ in range(rng.randint(0, 2))]
        rng.shuffle(parts)
        rows.append((rng.randint(-20, 20) * (1 << 40) if clash else i, " ".join(parts)))
    a = text(40)
    rows += [(1000, a), (2000, a + text(20)), (2000, text(40)), (None, a), (None, None), rows[0], (3000, None), (3000, "")]
    if not clash:
        rows = [r for r in rows if r[0] != 2000]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = suffixdedup.dedup(spark.createDataFrame(rows, DDL).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(brute(rows), key=key)
    assert sum(r.n_removed for r in got) > 500


def test_documents_are_numbered_by_text_only_where_ids_clash(spark):
    df = spark.createDataFrame([(5, "a"), (5, "a"), (7, "b"), (None, "c"), (None, "d")], "id long, text string")
    numbered, shift = suffixdedup.by_text(df)
    assert shift == 0 and {(r.id, r["__doc"]) for r in numbered.collect()} == {(5, 5), (7, 7), (None, None)}
    numbered, shift = suffixdedup.by_text(df.union(spark.createDataFrame([(7, "x"), (-(1 << 62), "y"), (7, "z")], "id long, text string")))
    of = {(r.id, r.text): r["__doc"] for r in numbered.filter(F.col("id").isNotNull()).collect()}
    assert shift == 2 and len(set(of.values())) == 5
    by = sorted(of, key=of.get)
    assert [x[0] for x in by] == [-(1 << 62), 5, 7, 7, 7] and len({of[x] >> shift for x in by}) == 3
    assert pa.array([1]).type == pa.int64()


def test_keys_are_found_in_place(spark):
    rng = random.Random(2)
    texts = [(i, "word " * rng.randint(0, 9) + str(i)) for i in rng.sample(range(10**6), 900)] + [(None, "nobody"), (-5, ""), (-6, None)]
    shards = tokenfiles.write(spark.createDataFrame(texts, DDL))
    known, seen = dict(texts), 0
    for r in shards.collect():
        row = r.asDict()
        there, start, count = tokenfiles.find(row, row["keys"])
        for k, t, s, c in zip(row["keys"], there, start, count):
            assert t and tokenfiles.place(row, k) == (s, c)
            seen += 1
        strange = [k for k in range(2_000_000, 2_000_300)]
        assert [tokenfiles.place(row, k) is not None for k in strange] == tokenfiles.find(row, strange)[0].tolist()
    assert seen == len(texts)
    wanted = rng.sample(sorted(k for k in known if k is not None), 200) + [77_000_000]
    got = {r.doc_id: r.ids for r in tokenfiles.lookup(shards, spark.createDataFrame([(k,) for k in wanted], "doc_id long")).collect()}
    enc = tokenfiles.encoder(tokenfiles.default_tokenizer())
    assert set(got) == set(wanted) - {77_000_000}
    for k, ids in got.items():
        assert ids == [*enc.whole.encode(known[k] or "", add_special_tokens=False).ids, 0]


def test_a_learned_list_decides_each_row(spark):
    from leafmill.llm import quality

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        words = [word() for _ in range(rng.randint(12, 60))]
        text = " ".join(w + ("#$" if bad and rng.random() < 0.7 else "") for w in words)
        rows.append((i, text if i % 50 else "few words", "x"))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, None, "x"), (1001, "", "x"), rows[5]]
    labels += [(5, 0), (None, 1), (77_777, 0), (6, None)]  # contradictory, without a document, null
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, rule string"), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality.fit(docs, known)
    assert rules
    judged = quality.judge(docs, known).collect()
    assert len(judged) == len(rows)
    import numpy as np

    stats = np.array([[r[c] for c in quality.STATS] for r in judged])
    first = np.zeros(len(judged), int)
    for n, rule in reversed(list(enumerate(rules, 1))):
        first[quality._covered(rule, quality.features(stats))] = n
    for r, n in zip(judged, first.tolist()):
        base = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert (r.base_failed, r.rule, r.kept) == (base, n or None, not base and not n)
    assert sum(not r.kept for r in judged) > 100 and sum(r.kept for r in judged) > 200
    kept = quality.keep(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in judged)


def test_stages_on_odd_input(spark, tmp_path):
    import corpus_pipeline as C

    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i}" for i in range(4000))
    rows = [(i, f"number {i} has these words and some more of them {i * i}\nshared line of all\n" + " ".join(f"u{i}x{k}" for k in range(20)), "en", None if i % 4 else "a", 9) for i in range(24)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \n\t", "en", "b", 3), (None, "a row without an id and with enough words to be kept by all of the tests", "en", "a", 1), (103, long, "en", "b", len(long)), (104, long, "en", "b", len(long)), rows[3], rows[3], (3, "another text of that id with words enough for any test that there is here", "de", "c", 1)]
    spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, none = spark.createDataFrame(rows, ddl), spark.createDataFrame([], ddl)
    counts = {}
    for name, stage in C.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert set(C.COLUMNS) <= set(got.columns)
        counts[name] = got.count()
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert counts["line dedup"] == len(rows) and counts["SentencePiece pieces"] == len(rows)
    assert counts["n-gram Jaccard join"] == len(rows) - 4  # two copies, a second text of an id, and one of two long texts
    assert 0 < counts["quality rules"] < len(rows) and counts["mixing sources"] > 0


def test_postings_without_partner_go():
    """of lists only what may still give a pair is sent on, and of a set's leaders only those that wide parities allow."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(1, 2**63, 3_000, dtype=np.uint64))
    near = np.unique(np.append(base[:-40], rng.integers(1, 2**63, 40, dtype=np.uint64)))
    other = np.unique(np.append(base[:5], rng.integers(1, 2**63, 2_990, dtype=np.uint64)))
    short = [np.unique(rng.integers(1, 2**63, 200, dtype=np.uint64)) for _ in range(40)]
    sets = [base, near, other, *short]
    odd = setjoin.parities(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])))
    # one list of two near sets and an unlike one, which no narrow parity tells apart, and one of forty unlike short sets
    rows = [(1, i, len(x) << 32, 1) for i, x in enumerate(sets[:3])] + [(2, 3 + i, len(x) << 32, 2) for i, x in enumerate(short)]
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    c = {n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("token", "id", "sp", "list"))}
    c |= {p: pa.array([int(odd[r[1], k]) for r in rows], pa.int64()) for k, p in enumerate(setjoin.PARITIES)}
    got = [r for b in setjoin._leaders(85, True)(iter([pa.RecordBatch.from_pydict(c)])) for r in b.to_pylist()]
    assert {r["id"] for r in got if r["list"] is not None} == {0, 1, 2}
    assert {r["a"] for r in got if r["a"] is not None} | {r["b"] for r in got if r["b"] is not None} <= {0, 1, 2}
    told = [np.frombuffer(setjoin._wide(x), np.uint64) for x in sets[:3]]
    test = setjoin._near(85)
    assert test(told[0], told[1]) is not None and test(told[0], told[2]) is None and test(told[1], told[2]) is None
