"""How far letters of a font go on, learned from pages: a quantile for each letter, each size of a font, each font, and all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The least advance, the greatest in sizes, the quantiles of a letter and of a font, letters for an own quantile.
LEAST, GREATEST, OF_LETTER, OF_FONT, ENOUGH = 0.05, 1.8, 0.25, 0.35, 3
LEVELS = ("letter", "size", "font", "all")


def bucket(size: Column) -> Column:
    """A size to half a point, one point or more."""
    return F.bround(F.greatest(F.lit(1.0), size) * 2, 0) / 2


def advances(letters: DataFrame) -> DataFrame:
    """font, bucket, letter, advance: from each letter to the next of its line, along the line's direction. letters has page, line, n
    (their order), text, font, size, x, y, and dx, dy (null: to the right). Blank letters, and advances that no letter has, are
    left out, as are nulls."""
    by = Window.partitionBy("page", "line").orderBy("n")
    dx, dy = F.coalesce("dx", F.lit(1.0)), F.coalesce("dy", F.lit(0.0))
    nx, ny, after = (F.lead(c).over(by) for c in ("x", "y", "text"))
    told = letters.withColumns({"__a": ((nx - F.col("x")) * dx + (ny - F.col("y")) * dy) / F.greatest(F.lit(0.001), F.sqrt(dx * dx + dy * dy)), "__after": after})
    size = F.greatest(F.lit(1.0), F.col("size"))
    shown = lambda c: F.trim(F.regexp_replace(c, "\\s", "")) != ""
    return told.filter(shown("text") & shown("__after") & F.col("__a").between(F.lit(LEAST), size * GREATEST) & F.col("font").isNotNull()).select("font", bucket(F.col("size")).alias("bucket"), F.col("text").alias("letter"), F.col("__a").alias("advance"))


def model(found: DataFrame) -> DataFrame:
    """level (a place in LEVELS), font, bucket, letter, advance, n: what is learned, with null where a level holds for any. A letter
    needs ENOUGH advances.

    Equal advances are counted before they are put in order, so a font that most letters have is a row for each value."""
    counts = found.groupBy("font", "bucket", "letter", "advance").agg(F.count("*").alias("c"))
    null = lambda c: F.lit(None).cast(found.schema[c].dataType).alias(c)
    keys = ("font", "bucket", "letter")
    levels = [counts.select(F.lit(i).alias("level"), *(F.col(k) if k in keep else null(k) for k in keys), "advance", "c") for i, keep in enumerate((keys, keys[:2], keys[:1], ()))]
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    every = every.groupBy("level", *keys, "advance").agg(F.sum("c").alias("c"))
    group = Window.partitionBy("level", *keys)
    every = every.withColumn("n", F.sum("c").over(group)).withColumn("upto", F.sum("c").over(group.orderBy("advance")))
    q = F.when(F.col("level") == 0, OF_LETTER).otherwise(OF_FONT)
    place = F.floor((F.col("n") - 1) * q) + 1
    return every.filter((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place)).filter((F.col("level") > 0) | (F.col("n") >= ENOUGH)).select("level", *keys, "advance", "n")


def expected(letters: DataFrame, learned: DataFrame) -> DataFrame:
    """Adds expected and expected_by (one of LEVELS) to letters with text, font and size: the advance of the nearest level that the
    model has. All levels of all distinct letters are looked up in one join; null only if the model is empty."""
    own = letters.withColumn("__bucket", bucket(F.col("size")))
    keys = own.select("font", F.col("__bucket").alias("bucket"), F.col("text").alias("letter")).distinct()
    part = lambda level, c, i: F.when(F.lit(i) < 3 - F.col(level), F.coalesce(F.col(c).cast("string"), F.lit("\x00")))
    key = lambda level: F.concat_ws("\x01", F.col(level).cast("string"), *(part(level, c, i) for i, c in enumerate(("font", "bucket", "letter"))))
    asked = keys.withColumn("level", F.explode(F.array(*map(F.lit, range(4))))).withColumn("__key", key("level"))
    has = learned.withColumn("__key", key("level")).select("__key", F.col("advance").alias("__advance"))
    best = asked.join(has, "__key").groupBy(*(F.col(c).alias(f"__{c}_") for c in ("font", "bucket", "letter"))).agg(F.min_by(F.struct("__advance", "level"), "level").alias("__best"))
    joined = own.join(best, own["font"].eqNullSafe(F.col("__font_")) & own["__bucket"].eqNullSafe(F.col("__bucket_")) & own["text"].eqNullSafe(F.col("__letter_")), "left")
    names = F.array(*map(F.lit, LEVELS))
    return joined.select(*letters.columns, F.col("__best.__advance").alias("expected"), F.get(names, F.col("__best.level")).alias("expected_by"))
