"""Mixing sources to target weights by systematic sampling.

Every source has an expected number of copies per document, target / size. Documents of a source stand in order of size
and id; the running sum of their expected copies, shifted by one random offset of the source, crosses an integer once for
each copy. Since neighbours in that order have nearly the same size, the words taken come near the target.

Nulls and ties: a null text has size 0; a null source is a source of its own, the last; equal rows count separately, in
any order (they are equal); rows of one source, size and id are ordered by a hash of their other columns; a source without words has target 0 and, as any copy would be empty, takes nothing. Empty
input gives an empty result. Other columns of the input stay and may have any names but those of RESULT.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, materialize, plain_names

#: Given by code point of the source's name, in turn.
WEIGHTS = (5, 2, 1)
#: A source is repeated at most so many times.
MOST = 3
RESULT = ("size", "source_size", "target", "expected", "taken", "copies")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: a row for each source with its source_size. Adds target: water filling under the caps.

    The sources in order of cap / weight: the first ones stop at their caps, the rest share what is left by weight. The
    rows are one for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.lit(MOST) * F.col("source_size").cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("w")).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
    # the level of the first source that does not reach its cap holds for all that follow
    s = s.withColumn("final", F.min(F.when(F.col("ratio") > F.col("level"), F.struct(F.row_number().over(by_ratio).alias("at"), "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("w")), F.col("cap")).alias("target"))


def _ranked(source: str):
    def run(batches):
        from pyspark import TaskContext

        part, seen, last = TaskContext.get().partitionId(), 0, ()
        for b in batches:
            names = b.column(source).to_pylist()
            ranks = np.empty(len(names), np.int64)
            for i, x in enumerate(names):
                if last != (x,):
                    seen, last = 0, (x,)
                ranks[i] = seen
                seen += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(names), part, np.int32)), pa.array(ranks)], names=[*b.schema.names, "__part", "__rank"])

    return run


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17, carry: bool = True, partitions: int | None = None) -> DataFrame:
    """docs with the columns of RESULT; `taken` counts words. carry=False leaves only key and source of the input.

    The rank of a document within its source is local to a range partition by (source, size, key) plus the counts of the
    partitions before it, so no source, however large, lies in one task."""
    spark = docs.sparkSession
    base = docs if carry else docs.select(key, source, text)
    cols = base.columns
    base, (text, source, key) = plain_names(base, text, source, key)
    stay = {c: name for c, name in zip(base.columns, cols) if name not in RESULT and (carry or c != text)}
    told = F.xxhash64(*(c for c, kind in base.dtypes if "map<" not in kind)) if carry else F.lit(0).cast("long")
    base = base.withColumns({"__size": size_of(F.col(text)), "__tie": told}).select(*{source, key, *stay}, "__size", "__tie")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(source).asc_nulls_last(), F.col("__size"), F.col(key).asc_nulls_last(), F.col("__tie")]
    dealt = base.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__tie")
    schema = T.StructType([*dealt.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__rank", T.LongType())])
    ranked = materialize(dealt.mapInArrow(_ranked(source), schema), "mix")
    parts = ranked.groupBy(F.col(source).alias("source"), "__part").agg(F.count("*").alias("n"), F.sum("__size").alias("words"))
    goal = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("source").alias("__s"), F.col("__part").alias("__p"), "__before")
    plan = parts.join(goal, F.col("__s").eqNullSafe(F.col("source"))).drop("source")
    # one random offset in [0, 1) for each source
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("__s")), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    plan = plan.withColumn("__offset", offset).withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    out = ranked.join(plan, (F.col("__part") == F.col("__p")) & F.col(source).eqNullSafe(F.col("__s")))
    rank = F.col("__rank") + F.col("__before")
    crossed = F.floor((rank + 1) * F.col("expected") + F.col("__offset")) - F.floor(rank * F.col("expected") + F.col("__offset"))
    return out.select(*(F.col(c).alias(name) for c, name in stay.items()), F.col("__size").alias("size"), "source_size", "target", "expected", (F.least(crossed, F.lit(MOST)) * F.col("__size")).cast("long").alias("taken"), F.least(crossed, F.lit(MOST)).cast("long").alias("copies"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of a mix, each as often as it is taken."""
    return mixed.filter("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")


#: The same in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS ratio, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos, sum(source_size) OVER ()::DOUBLE AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM l WHERE ratio > level ORDER BY pos LIMIT 1) * w), cap) AS target FROM l),
k AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS expected,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS rank,
  ('0x' || substr(md5('17:' || coalesce('=' || d.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (least(floor((rank + 1) * expected + shift) - floor(rank * expected + shift), 3) * size)::BIGINT AS taken FROM k
"""


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents"), carry=False).select("doc_id", "size", "source_size", "target", "taken")
