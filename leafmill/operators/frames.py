"""Sequences of frames: sampling, change, boundaries, segments, near duplicates and the order of slides.

Signals are columns; frames of one sequence are a group, and a step that depends on the step before is a fold over one
group's rows in time order (applyInPandas), everything else is windows and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

TICKS = {"accurate": 0.5, "balanced": 1.0, "fast": 2.0}  # fixed values: seconds between samples
MOST_SAMPLES = 6000

# Fixed values, in seconds: the longest and the usual step within a still stretch, its least length, that of a last one;
# and the median deviation, in grey levels, up to which a pixel is stable.
LONGEST_GAP, DENSE_GAP, LEAST_STILL, LEAST_END = 1.05, 0.30, 0.55, 0.32
STEADY = 5.5
BIN = 3.0  # above the longest stretch, so that one begins and ends in the same bin or in neighbouring ones

Step = Callable[[Column, Column], Column]


def sample_ticks(frames: DataFrame, seq: str, ts: str, mode: str = "balanced", most: int = MOST_SAMPLES) -> DataFrame:
    """The first frame at or after each tick of a sequence; ticks widen so that there are `most` at most. ts: seconds."""
    span = frames.groupBy(seq).agg(F.min(ts).alias("__t0"), F.max(ts).alias("__t1"))
    f = frames.join(span, seq)
    step = F.greatest(F.lit(TICKS[mode]), (F.col("__t1") - F.col("__t0")) / F.lit(most))
    f = f.withColumn("tick", F.floor((F.col(ts) - F.col("__t0")) / step).cast("long"))
    w = Window.partitionBy(seq, "tick").orderBy(ts)
    return f.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__t0", "__t1")


def changes(frames: DataFrame, seq: str, ts: str, value: str, *tie: str) -> DataFrame:
    """Adds change: the absolute difference to the frame before; null for the first."""
    w = Window.partitionBy(seq).orderBy(ts, *tie)
    return frames.withColumn("change", F.abs(F.col(value) - F.lag(value).over(w)))


def frame_difference(a: Column, b: Column, at_least: int = 18) -> dict[str, Column]:
    """changed: share of pixels that differ by at_least or more; mean: mean difference over 255. Arrays of gray values."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x.cast("int") - y.cast("int")))
    n = F.nullif(F.size(d), F.lit(0))
    return {"changed": F.size(F.filter(d, lambda x: x >= at_least)) / n, "mean": F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + x) / n / 255}


def thresholds(changed: DataFrame, seq: str, base: float, change: str = "change", times: float = 6.0) -> DataFrame:
    """Adds threshold: the greater of base and median + times * median absolute deviation of the sequence's changes."""
    med = changed.groupBy(seq).agg(F.percentile(change, F.lit(0.5)).alias("__med"))
    dev = changed.join(med, seq).withColumn("__dev", F.abs(F.col(change) - F.col("__med"))).groupBy(seq).agg(F.first("__med").alias("__med"), F.percentile("__dev", F.lit(0.5)).alias("__mad"))
    got = dev.select(seq, F.coalesce(F.greatest(F.lit(float(base)), F.col("__med") + F.lit(times) * F.col("__mad")), F.lit(float(base))).alias("threshold"))
    return changed.join(got, seq)


def _accept(gap: float, ts: str, flag: str):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, "__tie"], kind="stable")
        last, out = None, []
        for t, f in zip(pdf[ts], pdf[flag]):
            ok = bool(f) and (last is None or t - last >= gap)
            if ok:
                last = t
            out.append(ok)
        pdf["boundary"] = out
        return pdf

    return one


def accepted_boundaries(flagged: DataFrame, seq: str, ts: str, flag: str, gap: float, tie: str) -> DataFrame:
    """Adds boundary: flags at least `gap` after the last ACCEPTED one, a fold over one sequence in time order."""
    f = flagged.withColumn("__tie", F.col(tie))
    schema = ", ".join(f"`{n}` {t}" for n, t in f.dtypes) + ", boundary boolean"
    return f.groupBy(seq).applyInPandas(_accept(gap, ts, flag), schema).drop("__tie")


def segments(frames: DataFrame, seq: str, ts: str, boundary: str, *tie: str) -> DataFrame:
    """seq, segment, first and last time, frames: stretches between boundaries."""
    w = Window.partitionBy(seq).orderBy(ts, *tie)
    numbered = frames.withColumn("segment", F.sum(F.coalesce(F.col(boundary).cast("int"), F.lit(0))).over(w))
    return numbered.groupBy(seq, "segment").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("frames"))


def _merge(least: int, near: float):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        for r in pdf.sort_values("segment").to_dict("records"):
            if rows and (r["frames"] < least or rows[-1]["frames"] < least or abs(r["level"] - rows[-1]["level"]) <= near):
                p = rows[-1]
                n = p["frames"] + r["frames"]
                p |= {"last_ts": r["last_ts"], "level": (p["level"] * p["frames"] + r["level"] * r["frames"]) / n, "frames": n}
            else:
                rows.append(dict(r))
        for i, r in enumerate(rows):
            r["segment"] = i
        return pd.DataFrame(rows, columns=pdf.columns)

    return one


def merge_segments(segs: DataFrame, seq: str, least: int = 2, near: float = 0.0) -> DataFrame:
    """Short segments, and those whose level is near the one before's, joined in order. segs has segment, first_ts, last_ts, frames, level."""
    return segs.groupBy(seq).applyInPandas(_merge(least, near), segs.schema)


def stable_support(candidates: DataFrame, seq: str, ts: str, quiet: Step, strict: Step, *tie: str) -> DataFrame:
    """Adds support (long): in how many still stretches of its sequence a candidate lies.

    quiet and strict take two candidates as structs and tell whether little changed from the first to the second. A step is
    still if it is quiet and no longer than the sequence's cadence allows. A stretch has three candidates or more, lasts
    from LEAST_STILL to a bound by the cadence, all its steps but the first are still, and strict holds for its two ends.
    A sequence with any stretch counts its last four candidates once more if they are a short stretch, and its last two if
    the step between them is still. Candidates without seq or time have no support; those of one time are in order of `tie`.

    Stretches are found by joining starts and ends within runs of still steps and spans of BIN seconds; support is a
    running sum of starts and ends, so no stretch is expanded into its members."""
    order = Window.partitionBy(seq).orderBy(ts, *tie)
    whole = Window.partitionBy(seq)
    step = F.col(ts) - F.lag(ts).over(order)
    c = candidates.withColumns({"__c": F.struct(*candidates.columns), "__n": F.row_number().over(order), "__gap": step})
    cadence = F.percentile(F.when(F.col("__gap") > 1e-6, F.col("__gap")), F.lit(0.3)).over(whole)
    c = c.withColumn("__reach", F.coalesce(F.least(F.lit(LONGEST_GAP), F.greatest(F.lit(DENSE_GAP), cadence * 2.25)), F.lit(DENSE_GAP)))
    still = (F.col("__gap") > 1e-6) & (F.col("__gap") <= F.col("__reach") + 1e-6) & quiet(F.lag("__c").over(order), F.col("__c"))
    c = c.withColumn("__still", F.coalesce(still, F.lit(False)))
    c = c.withColumn("__run", F.sum((~F.col("__still")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    c = c.withColumn("__next", F.lead("__run").over(order))
    span = F.floor(F.col(ts) / BIN)
    widest = F.greatest(F.lit(1.15), F.least(F.lit(2.5), F.col("__reach") * 2.2))
    starts = c.select(F.col(seq).alias("seq"), F.col("__next").alias("run"), F.explode(F.array(span, span + 1)).alias("span"), F.col("__n").alias("a"), F.col(ts).alias("ta"), widest.alias("widest"), F.col("__c").alias("ca"))
    ends = c.select(F.col(seq).alias("seq"), F.col("__run").alias("run"), span.alias("span"), F.col("__n").alias("b"), F.col(ts).alias("tb"), F.col("__c").alias("cb"))
    lasting = (F.col("tb") - F.col("ta")).between(F.lit(LEAST_STILL), F.col("widest"))
    found = starts.join(ends, ["seq", "run", "span"]).filter((F.col("b") >= F.col("a") + 2) & lasting & strict(F.col("ca"), F.col("cb")))
    turns = found.select("seq", F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("n"), F.lit(-1).alias("d")))).alias("x"))
    turns = turns.groupBy(F.col("seq").alias("__seq"), F.col("x.n").alias("__at")).agg(F.sum("x.d").alias("__turn"))

    c = c.join(turns, (F.col(seq) == F.col("__seq")) & (F.col("__n") == F.col("__at")), "left")
    c = c.withColumn("__support", F.sum(F.coalesce("__turn", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.count("*").over(whole) - F.col("__n")  # how many come after
    short = (F.sum(F.col("__still").cast("int")).over(order.rowsBetween(-2, 0)) == 3) & (F.col(ts) - F.lag(ts, 3).over(order) >= LEAST_END) & strict(F.lag("__c", 3).over(order), F.col("__c"))
    c = c.withColumns({"__left": left, "__short": F.coalesce(short, F.lit(False))})
    at_end = lambda flag: F.max(F.when(F.col("__left") == 0, F.col(flag))).over(whole)
    extra = (at_end("__short") & (F.col("__left") < 4)).cast("int") + (at_end("__still") & (F.col("__left") < 2)).cast("int")
    support = F.col("__support") + F.when(F.max("__support").over(whole) > 0, extra).otherwise(0)
    return c.withColumn("support", support.cast("long")).select(*candidates.columns, "support")


def choose(candidates: DataFrame, group: str, score: str, support: str, ts: str, near: float = 0.0035) -> DataFrame:
    """The LAST candidate of each group whose score is within `near` of the best, of those with support if any has."""
    best_pool = F.max(F.when(F.col(support) > 0, 1).otherwise(0)).over(Window.partitionBy(group))
    pool = candidates.withColumn("__pool", best_pool).filter((F.col("__pool") == 0) | (F.col(support) > 0))
    top = pool.withColumn("__top", F.max(score).over(Window.partitionBy(group))).filter(F.col(score) >= F.col("__top") - near)
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.col(ts).desc()))
    return top.withColumn("__n", n).filter("__n = 1").drop("__n", "__top", "__pool")


def hash_bits(vector: Column) -> Column:
    """64 bits of a 64-vector: whether each value is above the median of all but the first. The first is the highest bit."""
    median = F.get(F.array_sort(F.slice(vector, 2, 63)), F.lit(31))
    return let(median, lambda m: F.aggregate(vector, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x > m).cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(hashes: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """a < b, distance: pairs of 64-bit hashes that differ in `most` bits or fewer, exactly. The bits are cut into bands, so few
    that in one of them such a pair differs in two bits at most; one side is looked up by all values that near to its band, and a
    pair is taken at the first such band alone. Equal hashes are one class before and are joined to its smallest key, not to each other."""
    bands = most // 3 + 1
    flips = most // bands
    cuts = [64 * i // bands for i in range(bands + 1)]
    band = lambda x, i: F.shiftrightunsigned(x, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1) if bands > 1 else F.lit(-1))

    def around(i: int) -> Column:
        masks = [sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(cuts[i + 1] - cuts[i]), n)]
        return F.transform(F.array(*(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long") for m in masks)), lambda m: band(F.col("__h"), i).bitwiseXOR(m))

    classes = hashes.groupBy(F.col(bits).alias("__h")).agg(F.min(key).alias("__k"))
    x = classes.select("__k", "__h", F.posexplode(F.array(*(band(F.col("__h"), i) for i in range(bands)))).alias("__i", "__v")).alias("x")
    near = classes.select("__k", "__h", F.posexplode(F.array(*(around(i) for i in range(bands)))).alias("__i", "__vs"))
    y = near.select("__k", "__h", "__i", F.explode("__vs").alias("__v")).alias("y")
    found = x.join(y, (F.col("x.__i") == F.col("y.__i")) & (F.col("x.__v") == F.col("y.__v")) & (F.col("x.__k") < F.col("y.__k"))).withColumn("distance", hamming(F.col("x.__h"), F.col("y.__h"))).filter(F.col("distance") <= most)
    earlier = F.lit(False)
    for i in range(bands):
        earlier = earlier | ((F.col("x.__i") > i) & (hamming(band(F.col("x.__h"), i), band(F.col("y.__h"), i)) <= flips))
    pairs = found.filter(~earlier).select(F.col("x.__k").alias("a"), F.col("y.__k").alias("b"), "distance")
    same = hashes.select(F.col(key).alias("__key"), F.col(bits).alias("__bits")).join(classes, F.col("__bits") == F.col("__h")).filter(F.col("__key") > F.col("__k")).select(F.col("__k").alias("a"), F.col("__key").alias("b"), F.lit(0).alias("distance"))
    return pairs.unionByName(same)


#: Distinct hashes of a block; each two blocks are compared in one task.
BLOCK = 32_768


def nearest_before(hashes: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """Adds near_before to hashes: the smallest key, a whole number, below a row's own whose 64-bit hash differs in `most` bits or fewer;
    null without any, or without a hash.

    Equal hashes are one class. Classes are dealt into blocks and each two blocks compared in a task, which gives one row for a
    class at most: what is sent grows with classes times blocks, not with the pairs that are near."""
    classes = hashes.filter(F.col(bits).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(bits).alias("__h")).agg(F.min(key).cast("long").alias("__k"))
    blocks = -(-classes.count() // BLOCK) or 1
    own = F.pmod(F.xxhash64("__h"), F.lit(blocks)).cast("int")
    dealt = classes.withColumn("__b", own).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("__h", "__k", "__b", F.least("__b", "__o").alias("__p"), F.greatest("__b", "__o").alias("__q"))

    def compare(table: pa.Table) -> pa.Table:
        h, k, b, p, q = (table.column(c).to_numpy() for c in ("__h", "__k", "__b", "__p", "__q"))
        order = np.argsort(k, kind="stable")
        h, k, b = h[order].view(np.uint64), k[order], b[order]
        low = np.full(len(k), np.iinfo(np.int64).max)
        x, y = np.flatnonzero(b == p[0]), np.flatnonzero(b == q[0])
        for i in range(0, len(x), 64):
            part = x[i : i + 64]
            near = np.bitwise_count(h[part][:, None] ^ h[y][None, :]) <= most
            for one, other, hit in ((part, y, near), (y, part, near.T)):  # keys ascend: the first hit is the smallest
                any_ = hit.any(axis=1)
                low[one[any_]] = np.minimum(low[one[any_]], k[other[hit[any_].argmax(axis=1)]])
        met = low < k
        return pa.table({"__h": h[met].view(np.int64), "__low": low[met]})

    low = dealt.groupBy("__p", "__q").applyInArrow(compare, "__h long, __low long").groupBy("__h").agg(F.min("__low").alias("__low"))
    first = classes.join(low.withColumnRenamed("__h", "__g"), F.col("__h") == F.col("__g"), "left").select("__h", F.least("__k", "__low").alias("__first"))
    joined = hashes.join(first, F.col(bits) == F.col("__h"), "left")
    return joined.select(*hashes.columns, F.when(F.col("__first") < F.col(key), F.col("__first")).alias("near_before"))


def first_near_duplicate(hashes: DataFrame, key: str, bits: str, most: int) -> DataFrame:
    """Each key with the smallest earlier key of near_pairs, or null."""
    first = near_pairs(hashes, key, bits, most).groupBy(F.col("b").alias("__b")).agg(F.min("a").alias("duplicate_of"))
    return hashes.join(first, F.col(key) == F.col("__b"), "left").drop("__b")


def anchor(occurrences: Column, short: float = 2.25, least: float = 4.0, times: float = 2.5) -> Column:
    """The occurrence (start, end) that orders a slide: the first, unless it is short and a later one is much longer."""
    o = F.array_sort(occurrences)
    first = F.get(o, F.lit(0))
    length = lambda x: x["end"] - x["start"]
    later = F.filter(F.slice(o, F.lit(2), F.greatest(F.size(o) - 1, F.lit(0))), lambda x: length(x) >= F.greatest(F.lit(least), length(first) * times))
    return F.when((length(first) <= short) & (F.size(later) > 0), F.get(later, F.lit(0))).otherwise(first)


def timeline(slides: DataFrame, seq: str, occurrences: str, number: str) -> DataFrame:
    """Adds anchor_start, reason and position: slides in order of their anchors."""
    s = slides.withColumn("__a", anchor(F.col(occurrences))).withColumn("__f", F.get(F.array_sort(F.col(occurrences)), F.lit(0)))
    s = s.withColumns({"anchor_start": F.col("__a.start"), "reason": F.when(F.col("__a.start") == F.col("__f.start"), "first_occurrence").otherwise("short_preview_deferred")})
    return s.withColumn("position", F.row_number().over(Window.partitionBy(seq).orderBy("anchor_start", "__f.start", number))).drop("__a", "__f")


def timeline_faults(slides: DataFrame, seq: str, duration: str) -> DataFrame:
    """Slides of a timeline() that break its rules: positions without gaps, anchors that ascend, times within the duration."""
    w = Window.partitionBy(seq).orderBy("position")
    bad = (F.col("position") != F.row_number().over(w)) | (F.col("anchor_start") < F.coalesce(F.lag("anchor_start").over(w), F.col("anchor_start"))) | (F.col("anchor_start") < 0) | (F.col("anchor_start") > F.col(duration) + 0.05)
    return slides.withColumn("fault", bad).filter("fault").drop("fault")


def nearest_stable(requests: DataFrame, frames: DataFrame, seq: str, at: str, ts: str, support: str, quality: str, within: float) -> DataFrame:
    """For each request the frame within `within` seconds with the most support, then quality, then the latest. Both sides
    go to time buckets as wide as the reach, so the join is on keys."""
    bucket = lambda c: F.floor(c / F.lit(within)).cast("long")
    f = frames.select(seq, F.col(ts).alias("__ts"), F.struct(support, quality, F.col(ts).alias("ts")).alias("__best"), F.explode(F.array(*(bucket(F.col(ts)) + i for i in (-1, 0, 1)))).alias("__bucket"))
    r = requests.withColumn("__bucket", bucket(F.col(at)))
    near = r.join(f, [seq, "__bucket"]).filter(F.abs(F.col(at) - F.col("__ts")) <= within)
    best = near.groupBy(*requests.columns).agg(F.max("__best").alias("__best"))
    return requests.join(best, requests.columns, "left").select(*requests.columns, F.col("__best.ts").alias("frame_ts"), F.col(f"__best.{support}").alias("frame_support"))


def gray_correlation(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation; where a side has no variance, 1 if the centred values differ by 1 at most on average, else 0."""
    mean = pairs.groupBy(*keys).agg(F.avg(a).alias("__ma"), F.avg(b).alias("__mb"), F.var_pop(a).alias("__va"), F.var_pop(b).alias("__vb"), F.corr(a, b).alias("__c"))
    flat = pairs.join(mean, keys).groupBy(*keys).agg(F.first("__va").alias("__va"), F.first("__vb").alias("__vb"), F.first("__c").alias("__c"), F.avg(F.abs((F.col(a) - F.col("__ma")) - (F.col(b) - F.col("__mb")))).alias("__d"))
    return flat.select(*keys, F.when((F.col("__va") == 0) | (F.col("__vb") == 0), F.when(F.col("__d") <= 1, 1.0).otherwise(0.0)).otherwise(F.col("__c")).alias("correlation"))


def modal_medoid(samples: DataFrame, keys: list[str], value: str, order: str, bits: int = 4) -> DataFrame:
    """Per pixel the observed value nearest to the centre of its most frequent cell of the top `bits` bits."""
    width = 1 << (8 - bits)
    cell = F.floor(F.col(value) / width)
    counts = samples.groupBy(*keys, cell.alias("__cell")).agg(F.count("*").alias("__n"))
    mode = counts.groupBy(*keys).agg(F.max(F.struct("__n", (-F.col("__cell")).alias("__c"))).alias("__m")).select(*keys, (-F.col("__m.__c")).alias("__cell"))
    inside = samples.withColumn("__cell", cell).join(mode, [*keys, "__cell"])
    off = F.abs(F.col(value) - (F.col("__cell") * width + (width - 1) / 2))
    return inside.groupBy(*keys).agg(F.min(F.struct(off.alias("o"), F.col(order), F.col(value).alias("v"))).alias("__b")).select(*keys, F.col("__b.v").alias(value))


def _median(x: Column) -> Column:
    """The median of an array."""
    return let(F.array_sort(x), lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)


def fuse(samples: DataFrame, keys: Sequence[str], frame: str, channels: Sequence[str], sharp: str, edge: str) -> DataFrame:
    """One row for each pixel (keys) with its channels made of all its frames, stable, and total, the sum of the frames' weights.

    A frame's deviation is the mean distance of its channels from their medians. A pixel is stable if the median deviation is
    small. Frames weigh less the more they deviate; the pixel is their weighted mean, and with the share `edge` (0 to 1, the
    pixel's greatest) the frame that is sharpest among those that agree, the earliest of equals. Channels are within 0 and
    255, not yet whole numbers, and null where a pixel is not stable or weighs too little: there the original stays.

    The frames of a pixel are held in a row: take a dozen a recording, as values.even_picks chooses them. Samples with null
    in a channel are left out; an unknown sharpness is the least, an unknown edge is 0."""
    known = samples.dropna(subset=list(channels))
    names = [f"v{i}" for i in range(len(channels))]
    values = [F.col(c).cast("double").alias(n) for c, n in zip(channels, names)]
    one = F.struct(F.col(frame).alias("at"), F.coalesce(F.col(sharp).cast("double"), F.lit(-1.0)).alias("sharp"), *values)
    g = known.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("__f"), F.coalesce(F.max(edge), F.lit(0)).alias("__edge"))
    g = g.withColumns({f"__m_{n}": _median(F.col("__f")[n]) for n in names})
    off = lambda x: sum((F.abs(x[n] - F.col(f"__m_{n}")) for n in names), F.lit(0.0)) / len(names)
    g = g.withColumn("__off", F.transform("__f", off)).withColumn("__mad", _median(F.col("__off")))
    g = g.withColumn("__w", F.transform("__off", lambda d: 1 / (1 + (d / 4) * (d / 4))))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    agrees = F.greatest(F.lit(7.0), F.col("__mad") * 2.5 + 2)
    rated = F.transform("__f", lambda x, i: F.struct(F.when(F.get("__off", i) <= agrees, x["sharp"]).otherwise(-2.0).alias("s"), (-i).alias("i")))
    g = g.withColumns({"total": add(F.col("__w")), "stable": F.col("__mad") <= STEADY, "__best": -F.array_max(rated)["i"]})
    usable = F.col("stable") & (F.col("total") >= 1.5)
    out = []
    for c, n in zip(channels, names):
        mean = add(F.zip_with("__w", F.col("__f")[n], lambda w, v: w * v)) / F.greatest("total", F.lit(1e-6))
        mixed = mean * (1 - F.col("__edge")) + F.get(F.col("__f")[n], F.col("__best")) * F.col("__edge")
        out.append(F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(255.0), mixed))).alias(c))
    return g.select(*keys, *out, "stable", "total")


def presenter(pairs: DataFrame, seq: str) -> DataFrame:
    """Whether a region moves while the page around it stands still; pairs has region and outside change of consecutive scans."""
    stable = F.col("outside") <= 0.055
    active = stable & (F.col("region") >= 0.045) & (F.col("region") - 1.7 * F.col("outside") >= 0.025)
    g = pairs.groupBy(seq).agg(F.count("*").alias("n"), F.count_if(stable).alias("stable"), F.count_if(active).alias("active"), F.percentile(F.when(stable, F.col("region")), F.lit(0.7)).alias("r70"), F.percentile(F.when(stable, F.col("region") - 1.7 * F.col("outside")), F.lit(0.7)).alias("e70"))
    enough = (F.col("n") + 1 >= 8) & (F.col("stable") >= F.greatest(F.lit(6), F.ceil((F.col("n") + 1) / 12)))
    return g.withColumn("presenter", enough & (F.col("active") / F.col("stable") >= 0.18) & (F.col("r70") >= 0.055) & (F.col("e70") >= 0.028))


def block_audit(tiles: DataFrame) -> DataFrame:
    """Adds risky to tiles with mae, correlation, edge_recall and edge_ratio: those whose pixels go back to the original."""
    bad = ((F.col("mae") > 16) & (F.col("correlation") < 0.94)) | (F.col("edge_recall") < 0.6) | ~F.col("edge_ratio").between(0.5, 2.2)
    return tiles.withColumn("risky", bad)


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pages: list[tuple[int, str]] = []
    base = pdf[pdf.kind == "page"].sort_values("at")
    content = {int(r.at): r.value for r in base.itertuples()}
    for r in pdf[pdf.kind.isin(["replace_page_frame", "repair_region"])].sort_values("ord").itertuples():
        content[int(r.at)] = r.value if r.kind == "replace_page_frame" else f"{content[int(r.at)]}+{r.value}"
    pages = [(p, content[p]) for p in sorted(content)]
    offset = 0
    for r in pdf[pdf.kind == "insert_page"].sort_values(["at", "ord"]).itertuples():
        pages.insert(int(r.at) - 1 + offset, (0, r.value))
        offset += 1
    return pd.DataFrame({"doc": pdf.doc.iloc[0], "out_page": range(1, len(pages) + 1), "page": [p for p, _ in pages], "value": [v for _, v in pages]})


def apply_plan(pages: DataFrame, actions: DataFrame) -> DataFrame:
    """Pages (doc, at, value) after a plan's actions (doc, ord, kind, at, value): changes of pages in plan order, each on
    what the one before left, then insertions by position and plan order."""
    rows = pages.select("doc", F.lit(0).alias("ord"), F.lit("page").alias("kind"), "at", "value").unionByName(actions.select("doc", "ord", "kind", "at", "value"))
    return rows.groupBy("doc").applyInPandas(_plan, "doc long, out_page int, page int, value string")
