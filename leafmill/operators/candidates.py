"""Which frames of a recording to look at for each slide, and which of them shows it best: a schedule from scans, a score from pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import choose
from .likeness import measured

# Scans of a slide, refined frames of a slide, and the seconds and frames a second of its dense beginning and end.
SCANS, REFINED = 16, 32
HEAD, TAIL, DENSE = 2.0, 1.25, 8.0
# The score: sharpness between the segment's 10th and 90th percentile, new handwriting, and support.
SHARP, WRITTEN, SUPPORT = 0.006, 2.40, 0.0015
NEAR = 0.0035
#: An edge: the sum of both slopes of grey (by Sobel's kernels) is this or more; handwriting: a channel differs by this from the
#: first picture, and blue or green is so much above red, and so much brighter than it was.
EDGE, DIFFERS, COLOURED, BRIGHTER = 160, 24, 40, 24


def _even(values: Column, k: Column) -> Column:
    """k of an array's values evenly, first and last among them, places rounded half to even; all if there are no more."""
    n = F.size(values)
    places = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1)), 0).cast("int"))
    return F.when(k <= 0, F.slice(values, F.lit(1), F.lit(0))).when(n <= k, values).otherwise(F.array_distinct(F.transform(places, lambda i: F.get(values, i))))


def _sorted(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def schedule(segments: DataFrame, scans: DataFrame, fps: float) -> DataFrame:
    """seq, segment, frames: the frames to look at for each segment, in order, REFINED at most.

    segments has seq, segment, first and last (numbers of scans); scans seq, n, ts and frame. These are up to SCANS of the
    segment's scans, evenly and with the first two and the last two, and DENSE frames a second from its first scan up to the
    scan HEAD seconds later, and from the scan TAIL seconds before its last one on. With too many, the dense ones have
    precedence, taken evenly if need be. Segments without a scan, or with nulls, have no frames."""
    s = segments.select("seq", "segment", "first", "last", F.explode(F.sequence("first", "last")).alias("n")).join(scans.select("seq", "n", "ts", "frame").dropna(), ["seq", "n"])
    whole = Window.partitionBy("seq", "segment")
    s = s.withColumn("t0", F.min("ts").over(whole)).withColumn("t1", F.max("ts").over(whole))
    first, last = F.col("first"), F.col("last")
    evenly = F.transform(F.sequence(F.lit(0), F.lit(SCANS - 5)), lambda i: F.when(i == SCANS - 5, last).otherwise(F.bround(first + i * ((last - first) / (SCANS - 5)), 0).cast("int")))
    own = (last - first < SCANS) | F.array_contains(F.concat(evenly, F.array(first, first + 1, last - 1, last)), F.col("n"))
    g = s.groupBy("seq", "segment").agg(
        F.min_by("frame", "n").alias("start"),
        F.max_by("frame", "n").alias("end"),
        F.min("t0").alias("t0"),
        F.max("t1").alias("t1"),
        F.min(F.when(F.col("ts") >= F.col("t0") + HEAD, F.col("frame"))).alias("head"),
        F.max(F.when(F.col("ts") <= F.col("t1") - TAIL, F.col("frame"))).alias("tail"),
        F.collect_set(F.when(own, F.col("frame"))).alias("base"),
    )
    elapsed = F.col("t1") - F.col("t0")
    local = F.when(elapsed > 1e-6, (F.col("end") - F.col("start")) / elapsed).otherwise(fps)
    stride = F.greatest(F.lit(1), F.bround(F.when(local > 0, local).otherwise(fps) / DENSE, 0)).cast("long")
    g = g.withColumns({"stride": stride, "head": F.coalesce("head", "end"), "tail": F.coalesce("tail", "start")})
    steps = lambda a, z: F.sequence(F.col(a).cast("long"), F.col(z).cast("long"), F.col("stride"))
    longs = lambda *c: F.array(*(F.col(x).cast("long") for x in c))
    dense = F.when((F.col("end") > F.col("start")) & F.lit(fps > 0), _sorted(steps("start", "head"), steps("tail", "end"), longs("head", "tail", "start", "end"))).otherwise(_sorted(longs("start", "end")))
    g = g.withColumn("dense", dense).withColumn("base", F.transform("base", lambda x: x.cast("long")))
    more = F.array_sort(F.array_except("base", "dense"))
    every = _sorted(F.col("base"), F.col("dense"))
    few = F.when(F.size("dense") > REFINED, _even(F.col("dense"), F.lit(REFINED))).otherwise(_sorted(F.col("dense"), _even(more, F.lit(REFINED) - F.size("dense"))))
    return g.select("seq", "segment", F.when(F.size(every) <= REFINED, every).otherwise(few).alias("frames"))


def frames_to_read(schedules: DataFrame) -> DataFrame:
    """seq, frame, segments: each frame once, in whatever many segments it is wanted."""
    return schedules.select("seq", "segment", F.explode("frames").alias("frame")).groupBy("seq", "frame").agg(F.array_sort(F.collect_set("segment")).alias("segments"))


def grey(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
    return (299 * red.astype(np.int64) + 587 * green.astype(np.int64) + 114 * blue.astype(np.int64)) // 1000


def _shifts(x: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The neighbours of all pixels, borders repeated."""
    h, w = x.shape[1:]
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="edge")
    return {(dy, dx): p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


def edges(x: np.ndarray, least: int = EDGE) -> np.ndarray:
    s = _shifts(x.astype(np.int64))
    across = s[-1, 1] + 2 * s[0, 1] + s[1, 1] - s[-1, -1] - 2 * s[0, -1] - s[1, -1]
    down = s[1, -1] + 2 * s[1, 0] + s[1, 1] - s[-1, -1] - 2 * s[-1, 0] - s[-1, 1]
    return np.abs(across) + np.abs(down) >= least


SUMS = ("pixels", "edges", "slope", "slopes", "written")
PLANES = ("red", "green", "blue")


def _sums(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    old, new = ([x[f"{p}_{s}"].astype(np.int64) for p in PLANES] for s in ("a", "b"))
    g = grey(*new)
    s = _shifts(g)
    bend = s[-1, 0] + s[1, 0] + s[0, -1] + s[0, 1] - 4 * g
    off = np.max([np.abs(a - b) for a, b in zip(old, new)], axis=0)
    coloured = np.maximum(new[1], new[2]) - new[0] >= COLOURED
    brighter = (new[2] - old[2] >= BRIGHTER) | (new[1] - old[1] >= BRIGHTER)
    usable = x["ignored"] == 0
    count = lambda m: m.sum((1, 2))
    return {"pixels": count(usable), "edges": count(edges(g)), "slope": count(bend), "slopes": count(bend * bend), "written": count((off >= DIFFERS) & coloured & brighter & usable)}


def scored(candidates: DataFrame) -> DataFrame:
    """Adds score to candidates: seq, segment, at (their order), width, height, red, green and blue (a byte for each pixel), ignored
    (not to be looked at; null: nothing), and support.

    The share of edges, a little for sharpness (the variance of grey's curvature, between the segment's percentiles), less the
    share of handwriting that the segment's first candidate hasn't, and a little for support (null: none). Null where a
    candidate's picture, or that of the first one, is null or not of its size."""
    area = F.col("width") * F.col("height")
    first = candidates.groupBy("seq", "segment").agg(F.min_by(F.struct("width", "height", *PLANES), F.struct("at", *(F.sha2(p, 256) for p in PLANES))).alias("f"))
    first = first.select(F.col("seq").alias("__seq"), F.col("segment").alias("__segment"), F.col("f.width").alias("__width"), F.col("f.height").alias("__height"), *(F.col(f"f.{p}").alias(f"{p}_a") for p in PLANES))
    c = candidates.drop("m", "score").withColumn("__row", F.monotonically_increasing_id())
    both = c.join(first, c["seq"].eqNullSafe(F.col("__seq")) & c["segment"].eqNullSafe(F.col("__segment"))).withColumns({f"{p}_b": F.col(p) for p in PLANES})
    both = both.withColumn("red_a", F.when((F.col("__width") == F.col("width")) & (F.col("__height") == F.col("height")), F.col("red_a"))).withColumn("__ignored", F.col("ignored"))
    told = measured(both.drop("__seq", "__segment", "__width", "__height"), [f"{p}_{s}" for s in "ab" for p in PLANES], _sums, SUMS, ["ignored"])
    n = area.cast("double")
    sharp = F.col("m.slopes") / n - (F.col("m.slope") / n) * (F.col("m.slope") / n)
    told = told.withColumn("__sharp", sharp)
    whole = Window.partitionBy("seq", "segment")
    low, high = (F.percentile("__sharp", F.lit(q)).over(whole) for q in (0.1, 0.9))
    told = told.withColumn("__low", low).withColumn("__span", high - low)
    between = F.when(F.col("__span") > F.greatest(F.lit(1e-6), F.abs("__low") * 1e-6), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("__sharp") - F.col("__low")) / F.col("__span")))).otherwise(0.0)
    score = F.col("m.edges") / n + SHARP * between - WRITTEN * F.col("m.written") / F.greatest(F.col("m.pixels"), F.lit(1)) + SUPPORT * F.coalesce("support", F.lit(0))
    return told.withColumn("score", score).select(*(F.col("__ignored").alias(x) if x == "ignored" else F.col(x) for x in candidates.columns if x not in ("m", "score")), "score")


def chosen(candidates: DataFrame, near: float = NEAR) -> DataFrame:
    """The last candidate of each segment whose score is within `near` of the best, of those with support if any has; candidates
    without a score are left out."""
    c = scored(candidates).filter("score is not null").withColumn("__key", F.struct("seq", "segment"))
    return choose(c, "__key", "score", "support", "at", near).drop("__key")
