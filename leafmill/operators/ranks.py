"""Numbers of rows in one order over a whole table, without a task that holds the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: spark.checkpoint.dir, or one of our own where all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="leafmill-")
    sc.setCheckpointDir(found)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "n", down: int = 0) -> DataFrame:
    """Adds name, 1, 2, ... in the order, which should tell all rows apart; its first `down` columns descend.

    Rows are dealt by range and sorted there; a row's number is its place in its range plus the rows of the ranges before,
    of which there is one count each. The ranges are checkpointed, so that both come from the same deal."""
    checkpoints(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__o{i}" for i in range(len(order))]
    keyed = df.select("*", *(o.alias(k) for o, k in zip(order, keys)))
    by = [F.col(k).desc_nulls_last() if i < down else F.col(k).asc_nulls_first() for i, k in enumerate(keys)]
    dealt = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(*keys)
    dealt = dealt.withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33)).withColumn("__in", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = dealt.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select("__p", before.alias("__before"))  # a row a range
    return dealt.join(F.broadcast(ahead), F.col("__part") == F.col("__p")).withColumn(name, F.col("__in") + F.col("__before") + 1).drop("__at", "__part", "__in", "__p", "__before")
