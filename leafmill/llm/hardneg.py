"""Hard-negative mining (operator 12): ball trees of each partition, searched for blocks of anchors by branch and bound.

Rows are dealt evenly, whatever their keys, and each task builds trees of at most TREE of its rows, written once as a table. A
block of anchors is sent to all tasks; a node is left out for an anchor where the upper bound of its inner products lies strictly
beneath the anchor's current last place, or the bounds lie outside its window of scores. Tasks return the best of all their trees,
and the best of all tasks are ranked. Anchors beyond a block take further passes over the trees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balltree import LAST, NONE, BallTree, Search
from .common import materialize, table

#: Rows of a tree, and anchors of a block, at most.
TREE, BLOCK = 1 << 14, 1 << 11
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256

_KINDS = {f: t for f, t in zip(BallTree.FIELDS, ("<i8", "<i8", "<i8", "<f8", "<f8", "<i8", "<i8", "<i8", "<i8", "u1", "<i8"))}
TREES = "dims int, " + ", ".join(f"{f} binary" for f in BallTree.FIELDS)


def matrix(vectors: pa.Array | list) -> np.ndarray:
    """Vectors as rows, shorter ones with zeros behind."""
    column = vectors if isinstance(vectors, pa.Array) else pa.array(vectors, pa.list_(pa.int64()))
    size = np.asarray(pa.compute.list_value_length(column)).astype(np.int64)
    flat = np.asarray(column.flatten())
    d = int(size.max(initial=0))
    if len(size) and (size == d).all():
        return flat.reshape(len(size), d)
    out = np.zeros((len(size), d), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _wide(parts: list[np.ndarray]) -> np.ndarray:
    d = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, d - p.shape[1]))) for p in parts])


def _planted(batches):
    held: list[tuple] = []
    size = 0

    def tree():
        t = BallTree.build(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), _wide([h[2] for h in held]))
        cols = [pa.array([t.x.shape[1]], pa.int32()), *(pa.array([getattr(t, f).astype(k).tobytes()], pa.binary()) for f, k in _KINDS.items())]
        return pa.RecordBatch.from_arrays(cols, names=["dims", *BallTree.FIELDS])

    for b in batches:
        for a in range(0, len(b), 1024):
            s = b.slice(a, 1024)
            held.append((np.asarray(s.column("id")), np.asarray(s.column("label")), matrix(s.column("vec"))))
            size += len(s)
            if size >= TREE:
                yield tree()
                held, size = [], 0
    if held:
        yield tree()


def trees(rows: DataFrame) -> DataFrame:
    """The trees of rows (id, label, vec), written."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.select("id", "label", "vec").repartition(n).mapInArrow(_planted, TREES), "trees")


def _grown(r: dict) -> BallTree:
    read = {f: np.frombuffer(r[f], k) for f, k in _KINDS.items()}
    d = r["dims"]
    read["x"], read["centre"] = read["x"].reshape(len(read["ids"]), d), read["centre"].reshape(len(read["begin"]), d)
    read["mixed"] = read["mixed"].astype(bool)
    return BallTree(**read)


def _search(sent):
    """The best rows of each query in all trees of a task."""

    def run(batches):
        ids, labels, x, kw = sent.value
        s = Search(ids, labels, x, **kw)
        s.seed(ids, labels, x)
        for b in batches:
            for i in range(len(b)):
                s.add(_grown({c: b.column(c)[i].as_py() for c in ("dims", *BallTree.FIELDS)}))
        q, place = np.nonzero(s.score > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s.score[q, place]), pa.array(s.found[q, place])], names=["q", "score", "id"])

    return run


def _best(forest: DataFrame, sent, most: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = forest.mapInArrow(_search(sent), "q int, score long, id long")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor its first rows of the same label
    and another id, and for each of these the first rows of other labels whose score is low to high percent of the positive's.

    rows: id, label and vec (array<bigint>), none null. Scores are inner products in 64 bits, a shorter vector having zeros
    behind. Ties go by id. Rows repeated are rows of their own, as anchors (their answers come repeated), positives and negatives."""
    spark = rows.sparkSession
    forest = trees(rows)
    anchors = rows.filter(is_anchor).groupBy("id", "label", "vec").agg(F.count(F.lit(1)).alias("n"))
    blocks = -(-anchors.count() // BLOCK)
    anchors = materialize(anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "vec"), F.lit(max(blocks, 1)))), "anchors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        some = anchors.filter(F.col("block") == block).collect()
        if not some:
            continue
        ids, labels = (np.array([r[c] for r in some], np.int64) for c in ("id", "label"))
        x = matrix([r.vec for r in some])
        near = _best(forest, spark.sparkContext.broadcast((ids, labels, x, {"same": True, "most": positives})), positives).collect()
        if not near:
            continue
        near.sort(key=lambda r: (r.q, r.rank))
        score = np.array([r.score for r in near], np.int64)
        # low * score <= 100 * s <= high * score, in whole numbers; none where the score is below zero
        least, most = -(-low * score // 100), high * score // 100
        kw = {"same": False, "most": negatives, "low": np.maximum(least, NONE + 1), "high": np.minimum(most, LAST - 1), "of": np.array([r.q for r in near])}
        pairs = spark.createDataFrame([(i, int(ids[r.q]), r.id, r.score, some[r.q].n) for i, r in enumerate(near)], "q int, anchor_id long, positive_id long, positive_score long, copies long")
        found = _best(forest, spark.sparkContext.broadcast((ids, labels, x, kw)), negatives)
        found = found.join(F.broadcast(pairs), "q").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        out = out.unionByName(found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out


def whole_vectors(rows: DataFrame, key: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id, label and vec, each component times scale as the whole number below. Rows with a null id, label or vector, or with a
    component that is null or not finite, go; components beyond 64 bits stop at their bounds; an empty vector scores 0 with all."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    some = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull()).filter(~odd)
    return some.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))


def op12(spark, sf_dir: str) -> DataFrame:
    rows = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("id") % 100 == 0)


#: The same in DuckDB's SQL, every anchor against every row.
SQL = f"""
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM (SELECT * FROM e WHERE id % 100 = 0) a JOIN e r ON a.id <> r.id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
