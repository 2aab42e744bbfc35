"""Work that is done once: markup taken away, ids looked up inside Spark."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leafmill.llm import linededup, setjoin, suffixdedup


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_markup_is_taken_away_once(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<p>one</p><p>two</p>"), (2, "http://a/y", None)], "page_id long, url string, html string")
    texts = pages.select("page_id", linededup.host_of(F.col("url")).alias("host"), linededup.page_text(F.col("html")).alias("text"))
    assert plan(linededup.boilerplate(texts, "text", "host")).count("<script") == 1
    found = linededup.op4(spark, "/root/testdata/sf0.001")
    assert "<script" not in plan(found) and found.count() == 50


def test_ids_are_looked_up_inside_spark(spark):
    docs = spark.range(20_000).select("id", F.concat(F.lit("t"), "id").alias("text")).unionByName(spark.createDataFrame([(None, "x")], "id long, text string"))
    wanted = spark.range(0, 20_000, 100).select("id")
    some = setjoin.rows_of(docs, wanted)
    assert "MapInArrow" not in plan(some) and some.columns == ["id", "text"]
    got = {r["id"]: r["text"] for r in some.collect()}
    assert all(got[i] == f"t{i}" for i in range(0, 20_000, 100)) and len(got) < 2_000 and None not in got
    assert setjoin.rows_of(docs, wanted.filter("id < 0")).count() == 0
    full = {r["id"] for r in setjoin.rows_of(docs, docs.filter("id is not null").select("id"), 17).collect()}
    assert full == set(range(20_000))


def test_all_texts_of_a_batch_are_cut_at_once():
    rng = random.Random(8)
    texts = [None if rng.random() < 0.1 else "é" * rng.randrange(3) + "".join(rng.choice("ab ") for _ in range(rng.choice([0, 40, 60, 300]))) for _ in range(60)]
    lost, want = [], []
    for t in texts:
        raw = (t or "").encode()
        rows = [[(rng.randrange(200), rng.randrange(1, 256)) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(3))]
        gone = {i for r in rows for s, c in r if s + c + 49 <= len(raw) for i in range(s, s + c + 49)}
        kept = bytes(x for i, x in enumerate(raw) if i not in gone)
        want.append((len(raw), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest(), kept))
        lost.append([{"n": len(r), "packed": np.array([s for s, _ in r], "<i4").tobytes() + bytes(c for _, c in r)} for r in rows] or None)
    kind = pa.list_(pa.struct([("n", pa.int32()), ("packed", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts, pa.string()), pa.array(lost, kind)], names=["id", "text", "lost"])
    for b in (batch, batch.slice(7, 20)):
        got = suffixdedup._cut_rows(b, True).to_pylist()
        assert [tuple(r.values())[1:] for r in got] == [want[r["id"]] for r in got] and [r["id"] for r in got] == b.column("id").to_pylist()
    assert sum(w[1] for w in want) > 1_000
