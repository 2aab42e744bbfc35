"""Connected components of a table of links, without gathering it on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Links up to this number are labelled in one task (some 24 MB there); more of them in rounds over all tasks.
TOGETHER = 500_000
LABELS = "node long, component long"


def labelled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v) and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, low[x], low[y])
        np.minimum.at(new, low[y], low[x])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, low):
            return nodes, nodes[low]
        low = new


def _together(batches):
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        u.append(b.column("u").to_numpy(zero_copy_only=False))
        v.append(b.column("v").to_numpy(zero_copy_only=False))
    nodes, low = labelled(np.concatenate(u), np.concatenate(v))
    for i in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 10_000]), pa.array(low[i : i + 10_000])], names=["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", together: int = TOGETHER) -> DataFrame:
    """node and component, the smallest node that links reach, for every node with a link.

    Of more than `together` links, each round takes the smallest label of the neighbours, then the label of that label,
    until none changes; every round is written to the shared folder. A star takes two rounds, a chain about the logarithm of its length."""
    both = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    once = materialize(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    if once.limit(together + 1).count() <= together:
        return materialize(once.coalesce(1).mapInArrow(_together, T.StructType.fromDDL(LABELS)), "labels")
    edges = materialize(once.union(once.select("v", "u")), "edges")
    labels = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("k"), F.col("component").alias("far"))
        new = materialize(lower.join(jump, F.col("low") == F.col("k"), "left").select("node", "was", F.least("low", F.coalesce("far", "low")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.filter("component <> was").isEmpty():
            return labels
