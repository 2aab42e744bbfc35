"""Scans of a video, thumbnails in time order: how they differ, where a slide ends, and which stretches are one slide.

A scan has seq, ts (seconds), width, height, gray and edges (a byte for each pixel, edges 0 or 1) and hash (64 bits); the
scans of a sequence have one size. Pixels are compared while a sequence streams by, or for stated pairs of scans. All
decisions are columns, and what depends on the decision before is a fold over a few numbers of one sequence."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .likeness import SUMS, any_holds, around, correlation, holds, mean_off, measured, share, sums
from .ranks import checkpoints

# Changed pixels, changed edges and hash distance that part slides; the same for small changes of structure.
CHANGE = {"conservative": (0.145, 0.115, 17), "balanced": (0.105, 0.085, 13), "sensitive": (0.075, 0.065, 10)}
SPARSE = {"conservative": (0.062, 0.040), "balanced": (0.048, 0.030), "sensitive": (0.034, 0.022)}
# What else parts slides. An abrupt step: mean difference; factors of the levels of edges and of pixels for a
# change of structure, and mean difference for one of tone; mean difference of a small change; hash distance beyond a slide's.
ABRUPT = {"mean": 0.065, "edges": 1.45, "pixels": 0.72, "tone": 0.05, "small": 0.010, "hash": 3}
# A gradual change: factors of the levels, mean difference, that of a small change, hash distance beyond a slide's,
# and the shares of ink and of edges kept by which a scan only adds to an earlier one; and what makes a step active.
GRADUAL = {"pixels": 0.88, "edges": 0.82, "mean": 0.050, "small": 0.012, "hash": 2, "ink": 0.96, "kept": 0.88}
ACTIVE = {"changed": 0.010, "mean": 0.003, "edge": 0.008}
# Levels are at least these, or the median step and so many of its deviations.
DEVIATIONS = {"changed": 6, "edge": 5, "tone": 2.5}
LEAST_TONE = 0.012
# A stretch that only adds to the one before: edges kept, ink, changed pixels, mean difference, changed edges.
ADDS = {"kept": 0.975, "ink": 0.96, "changed": 0.24, "mean": 0.050, "edge": 0.14}
# Bounds (least, most) of two equal slides, plainly, or but for coloured handwriting on one: hash distance,
# correlation, mean difference, the share of edges near the other's edges, that in both, of colour in the rest, of handwriting.
SLIDE_EITHER = (
    {"far": (None, 10), "alike": (0.938, None), "mean": (None, 0.060), "kept_least": (0.78, None), "shared": (0.55, None)},
    {"far": (None, 12), "alike": (0.82, None), "mean": (None, 0.015), "kept_most": (0.98, None), "shared": (0.50, None), "coloured": (0.45, None), "notes_least": (None, 0.001), "notes_most": (0.004, None)},
)
BETTER = 0.01
# Bounds of one printed page: changed pixels, mean difference, changed edges and changed pixels near print,
# in any case, and one of: alike with little change near print, alike with little change at all, or print only added.
PAGE_ALWAYS = {"changed": (None, 0.085), "mean": (None, 0.030), "edges": (None, 0.075)}
PAGE_EITHER = (
    {"alike": (0.955, None), "print": (None, 0.30)},
    {"alike": (0.955, None), "changed": (None, 0.025)},
    {"changed": (None, 0.040), "mean": (None, 0.018), "edges": (None, 0.035), "print": (None, 0.36)},
)
LEAST_SECONDS = 1.0
LOOK_BACK = 6

MEASURES = T.StructType([T.StructField(n, T.LongType() if n == "hash" else T.DoubleType()) for n in ("changed", "mean", "edge", "hash", "kept")])


def usable(width: int, height: int, ignored: Sequence[tuple[int, int, int, int]] = ()) -> np.ndarray:
    """The pixels to compare: those outside the ignored boxes (left, top, right, bottom), or all if too few are left."""
    mask = np.ones((height, width), bool)
    for left, top, right, bottom in ignored:
        mask[top:bottom, left:right] = False
    return mask if mask.sum() >= max(64, width * height // 8) else np.ones((height, width), bool)


def widened(mask: np.ndarray) -> np.ndarray:
    """A mask with all neighbours of its pixels."""
    out = mask.copy()
    out[1:] |= mask[:-1]
    out[:-1] |= mask[1:]
    sides = out.copy()
    out[:, 1:] |= sides[:, :-1]
    out[:, :-1] |= sides[:, 1:]
    return out


class _Scan:
    """The pixels of one scan, its widened edges computed once."""

    def __init__(self, row: dict):
        shape = row["height"], row["width"]
        self.gray = np.frombuffer(row["gray"], np.uint8).reshape(shape).astype(np.int16)
        self.edges = np.frombuffer(row["edges"], np.uint8).reshape(shape) > 0
        self.hash = row["hash"] & (1 << 64) - 1
        self.ink = int(self.edges.sum())
        self._wide: np.ndarray | None = None

    def against(self, earlier: _Scan, mask: np.ndarray) -> dict:
        """MEASURES; kept is the share of the earlier scan's edges that are here, or beside an edge here."""
        off = np.abs(self.gray - earlier.gray)[mask]
        if self._wide is None:
            self._wide = widened(self.edges)
        return {
            "changed": float((off >= 18).mean()),
            "mean": float(off.mean() / 255),
            "edge": float((self.edges != earlier.edges).mean()),
            "hash": (self.hash ^ earlier.hash).bit_count(),
            "kept": float((earlier.edges & self._wide).sum() / earlier.ink) if earlier.ink else 0.0,
        }


def numbered_scans(scans: DataFrame) -> DataFrame:
    """Adds n: 0, 1, ... in time order within each sequence; scans of one time are in order of their hashes."""
    order = Window.partitionBy("seq").orderBy("ts", "hash")
    return scans.repartition("seq").withColumn("n", F.row_number().over(order) - 1)


def differences(scans: DataFrame, ignored: Sequence[tuple[int, int, int, int]] = ()) -> DataFrame:
    """seq, n, ts, ink (edge pixels) and back: MEASURES against the scan before, the one before that, up to LOOK_BACK scans
    back. Scans stream by in order, and as many are held at once beside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[_Scan] = deque(maxlen=LOOK_BACK)
        mask = usable(1, 1)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                scan = _Scan(row)
                if row["n"] == 0:
                    held.clear()
                    mask = usable(row["width"], row["height"], ignored)
                rows.append({"seq": row["seq"], "n": row["n"], "ts": row["ts"], "ink": scan.ink, "back": [scan.against(e, mask) for e in reversed(held)]})
                held.append(scan)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([scans.schema["seq"], T.StructField("n", T.IntegerType()), T.StructField("ts", T.DoubleType()), T.StructField("ink", T.LongType()), T.StructField("back", T.ArrayType(MEASURES))])
    arrow = to_arrow_schema(schema)
    ordered = numbered_scans(scans).select("seq", "n", F.col("ts").cast("double").alias("ts"), "width", "height", "gray", "edges", "hash")
    return ordered.sortWithinPartitions("seq", "n").mapInArrow(run, schema)


def _levels(diffs: DataFrame, sensitivity: str) -> DataFrame:
    """For each sequence the levels of its gates, from the median steps and their deviations, and its distances in scans."""
    changed, edge, _ = CHANGE[sensitivity]
    steps = diffs.select("seq", "n", "ts", F.get("back", F.lit(0)).alias("s"))
    mid = steps.groupBy("seq").agg(
        F.coalesce(F.percentile("s.changed", F.lit(0.5)), F.lit(0.0)).alias("mid_changed"),
        F.coalesce(F.percentile("s.edge", F.lit(0.5)), F.lit(0.0)).alias("mid_edge"),
        F.greatest(F.lit(0.001), F.max(F.when(F.col("n") == 1, F.col("ts"))) - F.max(F.when(F.col("n") == 0, F.col("ts")))).alias("interval"),
        F.count("*").cast("int").alias("scans"),
    )
    off = steps.join(mid, "seq").groupBy("seq").agg(
        F.coalesce(F.percentile(F.abs(F.col("s.changed") - F.col("mid_changed")), F.lit(0.5)), F.lit(0.0)).alias("off_changed"),
        F.coalesce(F.percentile(F.abs(F.col("s.edge") - F.col("mid_edge")), F.lit(0.5)), F.lit(0.0)).alias("off_edge"),
    )
    return mid.join(off, "seq").select(
        "seq",
        "scans",
        F.greatest(F.lit(changed), F.col("mid_changed") + DEVIATIONS["changed"] * F.col("off_changed")).alias("changed_level"),
        F.greatest(F.lit(edge), F.col("mid_edge") + DEVIATIONS["edge"] * F.col("off_edge")).alias("edge_level"),
        F.greatest(F.lit(LEAST_TONE), F.col("mid_edge") + DEVIATIONS["tone"] * F.col("off_edge")).alias("tone_level"),
        F.greatest(F.lit(1), F.bround(LEAST_SECONDS / F.col("interval")).cast("int")).alias("least_scans"),
        F.greatest(F.lit(2), F.least(F.lit(LOOK_BACK), F.ceil(3.0 / F.col("interval")).cast("int"))).alias("reach"),
    )


def _abrupt(s: Column, sensitivity: str) -> Column:
    """Whether one step is a change of slide: a large area, a strong change of structure, of tone, or a small exact one."""
    h = CHANGE[sensitivity][2]
    small_area, small_edge = SPARSE[sensitivity]
    area = (s["changed"] >= F.col("changed_level")) & ((s["edge"] >= F.col("edge_level")) | (s["hash"] >= h) | (s["mean"] >= ABRUPT["mean"]))
    structure = (s["edge"] >= F.col("edge_level") * ABRUPT["edges"]) & (s["changed"] >= F.col("changed_level") * ABRUPT["pixels"])
    tone = (s["mean"] >= ABRUPT["tone"]) & (s["edge"] >= F.col("tone_level"))
    sparse = (s["changed"] >= small_area) & (s["edge"] >= small_edge) & (s["mean"] >= ABRUPT["small"])
    return area | ((structure | tone | sparse) & (s["hash"] >= h + ABRUPT["hash"]))


def _gradual(k: int, sensitivity: str) -> Column:
    """Whether the k steps up to a scan are a slow change of slide: many of them active, far apart in sum, and not the
    earlier scan with more on it."""
    h = CHANGE[sensitivity][2]
    small_area, small_edge = SPARSE[sensitivity]
    c = F.get("back", F.lit(k - 1))
    far = (c["changed"] >= F.col("changed_level") * GRADUAL["pixels"]) & ((c["edge"] >= F.col("edge_level") * GRADUAL["edges"]) | (c["hash"] >= h + GRADUAL["hash"]) | (c["mean"] >= GRADUAL["mean"]))
    sparse = (c["changed"] >= small_area) & (c["edge"] >= small_edge) & (c["mean"] >= GRADUAL["small"]) & (c["hash"] >= h + GRADUAL["hash"])
    in_order = Window.partitionBy("seq").orderBy("n")
    active = F.sum("active").over(in_order.rowsBetween(1 - k, 0)) >= max(2, k // 2)
    revealed = (F.col("ink") >= F.lag("ink", k).over(in_order) * GRADUAL["ink"]) & (c["kept"] >= GRADUAL["kept"])
    return F.coalesce((F.col("reach") >= k) & active & (far | sparse) & ~revealed, F.lit(False))


def segment_scans(diffs: DataFrame, sensitivity: str = "balanced") -> DataFrame:
    """seq, segment, first, last: stretches of scans between changes of slide, from differences().

    A scan can begin a stretch if its step is abrupt, or if the scans from some earlier one of the same stretch change
    gradually; stretches have the least length. Of these conditions only the distance to the last begin depends on earlier
    decisions, so each scan needs one number for the fold: the least distance at which it begins a stretch."""
    step = F.get("back", F.lit(0))
    d = diffs.join(_levels(diffs, sensitivity), "seq")
    active = (step["changed"] >= ACTIVE["changed"]) | (step["mean"] >= ACTIVE["mean"]) | (step["edge"] >= ACTIVE["edge"])
    d = d.withColumn("active", F.coalesce(active, F.lit(False)).cast("int"))
    need = F.when(_abrupt(step, sensitivity), 1)
    for k in range(2, LOOK_BACK + 1):
        need = need.when(_gradual(k, sensitivity), k)
    d = d.select("seq", "n", "scans", F.greatest(need, F.when(need.isNotNull(), F.col("least_scans"))).alias("need"))
    # all scans are counted, those that can begin a stretch are collected
    g = d.groupBy("seq").agg(F.first("scans").alias("scans"), F.array_sort(F.collect_list(F.when(F.col("need").isNotNull(), F.struct("n", "need")))).alias("able"))
    begins = F.aggregate("able", F.array(F.lit(0)), lambda kept, x: F.when(x["n"] - F.element_at(kept, -1) >= x["need"], F.array_append(kept, x["n"])).otherwise(kept))
    return _stretches(g.select("seq", "scans", begins.alias("begins")))


def _stretches(begins: DataFrame) -> DataFrame:
    """seq, segment, first, last of seq, scans and begins, the numbers of the scans that begin a stretch."""
    ends = F.concat(F.transform(F.slice("begins", F.lit(2), F.size("begins")), lambda b: b - 1), F.array(F.col("scans") - 1))
    both = F.zip_with("begins", ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return begins.select("seq", F.posexplode(both).alias("segment", "x")).select("seq", "segment", "x.first", "x.last")


def compared(scans: DataFrame, pairs: DataFrame, ignored: Sequence[tuple[int, int, int, int]] = ()) -> DataFrame:
    """pairs (seq, a, b: numbers of scans) with MEASURES of b against a as `m`, and ink_a and ink_b."""
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = pairs.select("seq", F.explode(F.array("a", "b")).alias("n")).distinct()
    found = numbered_scans(scans).join(wanted, ["seq", "n"])
    side = lambda s: found.select("seq", F.col("n").alias(s), F.struct("width", "height", "gray", "edges", "hash").alias(f"__{s}"))
    both = pairs.select("seq", "a", "b").distinct().join(side("a"), ["seq", "a"]).join(side("b"), ["seq", "b"])
    schema = T.StructType([scans.schema["seq"], *(T.StructField(n, T.IntegerType()) for n in ("a", "b")), T.StructField("m", MEASURES), *(T.StructField(n, T.LongType()) for n in ("ink_a", "ink_b"))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                a, b = _Scan(row["__a"]), _Scan(row["__b"])
                mask = usable(row["__a"]["width"], row["__a"]["height"], ignored)
                rows.append({"seq": row["seq"], "a": row["a"], "b": row["b"], "m": b.against(a, mask), "ink_a": a.ink, "ink_b": b.ink})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pairs.join(both.mapInArrow(run, schema), ["seq", "a", "b"])


def merge_scans(segments: DataFrame, scans: DataFrame, diffs: DataFrame, ignored: Sequence[tuple[int, int, int, int]] = ()) -> DataFrame:
    """seq, segment, first, last: segment_scans() with single scans, and stretches that only add to the one before, joined to it.

    A stretch's last scan is held against the one before's last scan a second before its end, since scans nearer to a change
    may show parts of both slides; where the joined stretch before is too short for that, against its very last one."""
    second = Window.partitionBy("seq").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    calm = diffs.select("seq", F.col("n").alias("end"), F.max("n").over(second).alias("calm"))
    s = segments.withColumn("end", F.col("first") - 1).join(calm, ["seq", "end"], "left")
    cases = s.filter("segment > 0").select("seq", "segment", F.explode(F.array_distinct(F.array_compact(F.array("calm", "end")))).alias("a"), F.col("last").alias("b"))
    m = compared(scans, cases, ignored)
    grows = (F.col("m.kept") >= ADDS["kept"]) & (F.col("ink_b") >= ADDS["ink"] * F.greatest(F.lit(1), F.col("ink_a")))
    for measure in ("changed", "mean", "edge"):
        grows &= F.col(f"m.{measure}") <= ADDS[measure]
    known = m.groupBy("seq", "segment").agg(F.map_from_entries(F.collect_list(F.struct("a", grows.alias("grows")))).alias("grows"))
    s = s.join(known, ["seq", "segment"], "left").select("seq", "segment", "first", "last", "end", "calm", (F.col("first") == F.col("last")).alias("single"), F.element_at("grows", F.col("end")).alias("from_end"), F.element_at("grows", F.col("calm")).alias("from_calm"))
    g = s.groupBy("seq").agg((F.max("last") + 1).alias("scans"), F.array_sort(F.collect_list(F.struct("first", "calm", "single", "from_end", "from_calm"))).alias("all"))
    joins = lambda kept, x: x["single"] | F.when(x["calm"] >= F.element_at(kept, -1), x["from_calm"]).otherwise(x["from_end"])
    begins = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.array(F.lit(0)), lambda kept, x: F.when(joins(kept, x), kept).otherwise(F.array_append(kept, x["first"])))
    return _stretches(g.select("seq", "scans", begins.alias("begins")))


def slides(scans: DataFrame, sensitivity: str = "balanced", ignored: Sequence[tuple[int, int, int, int]] = ()) -> DataFrame:
    """seq, segment, first, last: the slides of each sequence as numbers of scans. Scans without seq are of no
    sequence and in no slide; an empty table gives no rows."""
    present = scans.filter(F.col("seq").isNotNull())
    checkpoints(scans.sparkSession)  # pixels are compared once: what follows reads numbers
    diffs = differences(present, ignored).checkpoint()
    return merge_scans(segment_scans(diffs, sensitivity).checkpoint(), present, diffs, ignored)


PAGE_SUMS = ("area", *SUMS, "edges", "print", "print_13")


def _page_sums(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums over the pixels of pairs that no ink is near: all of them, those whose edges differ, those beside print."""
    one, two = x["edges_a"] > 0, x["edges_b"] > 0
    where = ~around((x["ink_a"] > 0) | (x["ink_b"] > 0), 2) & (x["ignored"] == 0)
    beside = around(one | two) & where
    got = sums(x["gray_a"], x["gray_b"], where)
    near = sums(x["gray_a"], x["gray_b"], beside)
    area = np.full(len(where), where[0].size)
    return {"area": area, **got, "edges": ((one != two) & where).sum((1, 2)), "print": near["pixels"], "print_13": near["off_13"]}


def same_structure(pairs: DataFrame) -> DataFrame:
    """Adds same: whether two pictures show one printed page, handwriting aside.

    pairs has width, height and, a byte for each pixel, gray_a, gray_b, edges_a, edges_b, ink_a, ink_b (handwriting) and
    ignored (not to be compared; null: none). Pixels within two of any ink aren't compared; with fewer than a fifth left,
    or 128, pages aren't the same. Null where a picture is null or not of its size."""
    names = [n + s for n in ("gray", "edges", "ink") for s in ("_a", "_b")]
    held = [c for c in pairs.columns if c not in ("same", "m")]
    kept = pairs.select(*(F.col(c) for c in held), *(F.col(c).alias(f"__{c}") for c in (*names, "ignored")))
    told = measured(kept, names, _page_sums, PAGE_SUMS, ["ignored"])
    changed = share("off_18", "pixels")
    measures = {"changed": changed, "mean": mean_off(), "edges": share("edges", "pixels"), "alike": correlation(1.0), "print": F.when(F.col("m.print") > 0, share("print_13", "print")).otherwise(changed)}
    enough = (F.col("m.pixels") >= 128) & (F.col("m.pixels") >= F.floor(F.col("m.area") / 5))
    same = F.when(F.col("m").isNotNull(), enough & holds(PAGE_ALWAYS, measures) & any_holds(PAGE_EITHER, measures))
    return told.select(*(F.col(f"__{c}").alias(c) if c in (*names, "ignored") else F.col(c) for c in held), same.alias("same"))


SLIDE_SUMS = (*SUMS, "edges_a", "edges_b", "near_a", "near_b", "shared", "either", "apart", "coloured", "notes_a", "notes_b")


def _slide_sums(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums over all pixels of pairs, and counts of edges: of each picture, near the other's, common, and of one alone."""
    one, two, count = x["edges_a"] > 0, x["edges_b"] > 0, lambda mask: mask.sum((1, 2))
    by_two, by_one = around(two), around(one)
    alone_a, alone_b = one & ~by_two, two & ~by_one
    coloured = (alone_a & (x["ink_a"] > 0)) | (alone_b & (x["ink_b"] > 0))
    counts = (count(one), count(two), count(one & by_two), count(two & by_one), count(one & two), count(one | two), count(alone_a | alone_b), count(coloured), count(x["notes_a"] > 0), count(x["notes_b"] > 0))
    return {**sums(x["gray_a"], x["gray_b"], np.ones(one.shape, bool)), **dict(zip(SLIDE_SUMS[len(SUMS) :], counts))}


def equal_slides(pictures: DataFrame) -> DataFrame:
    """seq, a, b: the pictures (seq, pic, width, height, hash and the images) of a sequence that show one slide, each pair both ways.

    Hashes of one slide differ in few bits, so they agree in one of a few more bands; only such pairs are measured."""
    far = max(rule["far"][1] for rule in SLIDE_EITHER)
    cuts = [64 * i // (far + 1) for i in range(far + 2)]
    bands = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("hash", cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1).alias("v")) for i in range(far + 1)))
    keyed = pictures.select("seq", "pic", "width", "height", "hash", F.explode(bands).alias("band"))
    on = ["seq", "width", "height", "band"]
    pairs = keyed.withColumnsRenamed({"pic": "a", "hash": "hash_a"}).join(keyed.withColumnsRenamed({"pic": "b", "hash": "hash_b"}), on).filter("a <= b")
    pairs = pairs.withColumn("far", F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))).filter(F.col("far") <= far).select("seq", "a", "b", "width", "height", "far").distinct()
    names = ("gray", "edges", "ink", "notes")
    side = lambda s: pictures.select("seq", F.col("pic").alias(s), *(F.col(n).alias(f"{n}_{s}") for n in names))
    told = measured(pairs.join(side("a"), ["seq", "a"]).join(side("b"), ["seq", "b"]), [f"{n}_{s}" for s in "ab" for n in names], _slide_sums, SLIDE_SUMS)
    near, notes = [share("near_a", "edges_a"), share("near_b", "edges_b")], [share("notes_a", "pixels"), share("notes_b", "pixels")]
    measures = {"far": F.col("far"), "alike": correlation(0.0), "mean": mean_off(), "kept_least": F.least(*near), "kept_most": F.greatest(*near), "shared": share("shared", "either"), "coloured": share("coloured", "apart"), "notes_least": F.least(*notes), "notes_most": F.greatest(*notes)}
    same = told.filter(any_holds(SLIDE_EITHER, measures)).select("seq", "a", "b")
    return same.unionByName(same.filter("a <> b").select("seq", F.col("b").alias("a"), F.col("a").alias("b")))


def _accept(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at", kind="stable").reset_index(drop=True)
    pics, scores, doubts = (pdf[c].tolist() for c in ("pic", "score", "doubtful"))
    stands: list[int] = []  # the row whose picture stands for each accepted slide
    slides: dict[str, list[int]] = {}  # for each picture a heap of the slides that it stands or has stood for
    number = []

    def first(pic: str) -> int:
        heap = slides.get(pic, [])
        while heap and pics[stands[heap[0]]] != pic:
            heapq.heappop(heap)
        return heap[0] if heap else len(stands)

    for i, same in enumerate(pdf["same"]):
        k = min(map(first, same), default=len(stands))
        number.append(k)
        if k == len(stands):
            stands.append(i)
        elif scores[i] - scores[stands[k]] > BETTER * max(abs(scores[stands[k]]), 0.001) and doubts[i] <= doubts[stands[k]]:
            stands[k] = i
        else:
            continue
        heapq.heappush(slides.setdefault(pics[i], []), k)
    return pd.DataFrame({"seq": pdf.seq, "segment": pdf.segment, "slide": number, "stands": [stands[k] == i for i, k in enumerate(number)]})


def accepted_slides(found: DataFrame) -> DataFrame:
    """seq, segment, slide (0, 1, ...), stands: which slide each segment of a recording shows, and whether its picture stands
    for the slide in the end. A segment is the first accepted slide that it equals, by the picture that stands for it at
    that time, or else a new one; a picture better by more than a hundredth, and with no more doubtful pixels, takes over.

    found has seq, segment, width, height, gray, edges, ink and notes (a byte for each pixel; ink: coloured, notes:
    handwriting), hash (64 bits), score and doubtful (a count). Rows with null in any of these are left out, and so are those
    with an image that isn't of its size; of one segment twice the order is free. Distinct pictures are measured pair by pair;
    each decision depends on the ones before, so the numbers of one recording, without its pixels, are held in one task."""
    checkpoints(found.sparkSession)
    images = ("gray", "edges", "ink", "notes")
    area = F.col("width") * F.col("height")
    rows = found.select("seq", "segment", "width", "height", *images, F.col("hash").cast("long").alias("hash"), F.col("score").cast("double").alias("score"), F.col("doubtful").cast("double").alias("doubtful")).dropna()
    for i in images:
        rows = rows.filter(F.length(i) == area)
    print_ = F.sha2(F.concat_ws("-", "width", "height", "hash", *(F.hex(i) for i in images)), 256)
    order = Window.partitionBy("seq").orderBy("segment")
    placed = rows.withColumn("pic", print_).withColumn("at", F.row_number().over(order)).checkpoint()
    same = equal_slides(placed.dropDuplicates(["seq", "pic"])).groupBy("seq", F.col("a").alias("pic")).agg(F.collect_list("b").alias("same"))
    numbers = placed.select("seq", "segment", "at", "pic", "score", "doubtful").join(same, ["seq", "pic"], "left")
    numbers = numbers.withColumn("same", F.coalesce("same", F.array().cast("array<string>")))
    schema = T.StructType([found.schema["seq"], found.schema["segment"], T.StructField("slide", T.IntegerType()), T.StructField("stands", T.BooleanType())])
    return numbers.groupBy("seq").applyInPandas(_accept, schema)
