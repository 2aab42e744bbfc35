"""Boxes, rules and lines on pages: predicates as columns, chains as windows, greedy unions as folds over one page."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import checkpoints

# Least width of a table's rules on a page, and how alike in width, near in centre (of the page's width),
# overlapping and near in height (of the page's height) rules of one table are.
RULE = {"share": 0.25, "alike": 0.70, "centre": 0.08, "overlap": 0.75, "gap": 0.30}


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Space between two intervals on an axis, 0 if they touch."""
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Share of the shorter interval that both have."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / F.nullif(F.least(a1 - a0, b1 - b0), F.lit(0))


def distance(a: str, b: str) -> Column:
    c = lambda s, n: F.col(f"{s}.{n}")
    return F.hypot(gap(c(a, "x0"), c(a, "x1"), c(b, "x0"), c(b, "x1")), gap(c(a, "y0"), c(a, "y1"), c(b, "y0"), c(b, "y1")))


CORNERS = ("x0", "y0", "x1", "y1")


def _kinds(boxes: DataFrame, page: str, key: str) -> DataFrame:
    """page, corners and kind of the boxes: equal boxes of a page are one kind, named by its smallest key and its corners."""
    every = boxes.dropna(subset=[page, key, *CORNERS]).groupBy(page, *CORNERS).agg(F.min(key).alias("__k"))
    return every.select(page, *CORNERS, F.struct("__k", *CORNERS).alias("kind"))


def _near_kinds(kinds: DataFrame, page: str, merge_gap: float, share: float) -> DataFrame:
    """page, ka <= kb: kinds whose boxes are neighbours, a kind of its own included where it has an extent. Kinds go to cells
    of a grid first, so that only those near each other meet."""
    size = 64.0 + merge_gap
    c = lambda v: F.floor(v / size).cast("long")
    grid = kinds.withColumn("__gx", F.explode(F.sequence(c(F.col("x0") - merge_gap), c(F.col("x1") + merge_gap)))).withColumn("__gy", F.explode(F.sequence(c(F.col("y0") - merge_gap), c(F.col("y1") + merge_gap))))
    a, b = grid.alias("a"), grid.alias("b")
    met = a.join(b, (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a.__gx") == F.col("b.__gx")) & (F.col("a.__gy") == F.col("b.__gy")) & (F.col("a.kind") <= F.col("b.kind")))
    p = lambda n: (F.col(f"a.{n}0"), F.col(f"a.{n}1"), F.col(f"b.{n}0"), F.col(f"b.{n}1"))
    gx, gy, ox, oy = gap(*p("x")), gap(*p("y")), F.coalesce(overlap(*p("x")), F.lit(0.0)), F.coalesce(overlap(*p("y")), F.lit(0.0))
    near = ((gx == 0) & (gy == 0)) | ((gx <= merge_gap) & (oy >= share)) | ((gy <= merge_gap) & (ox >= share))
    return met.filter(near).select(F.col(f"a.{page}").alias(page), F.col("a.kind").alias("ka"), F.col("b.kind").alias("kb")).distinct()


def _repeated(boxes: DataFrame, *keys: str) -> bool:
    return not boxes.groupBy(*keys).count().filter("count > 1").isEmpty()


def neighbours(boxes: DataFrame, page: str, key: str, merge_gap: float, share: float = 0.6) -> DataFrame:
    """a < b: boxes of a page that touch, or stand no further than merge_gap apart side by side. Equal boxes are one kind to
    begin with; near kinds are paired, and then their boxes, so that no pair of boxes is shuffled unless keys repeat on a page."""
    kinds = _kinds(boxes, page, key)
    rows = boxes.join(kinds, [page, *CORNERS]).filter(F.col(key).isNotNull())
    side = lambda s: rows.select(page, F.col("kind").alias(f"k{s}"), F.col(key).alias(f"__{s}"))
    met = _near_kinds(kinds, page, merge_gap, share).join(side("a"), [page, "ka"]).join(side("b"), [page, "kb"])
    met = met.filter((F.col("__a") < F.col("__b")) | ((F.col("__a") > F.col("__b")) & (F.col("ka") < F.col("kb"))))
    pairs = met.select(page, F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"))
    return pairs.distinct() if _repeated(boxes, page, key) else pairs


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component, its smallest member, by rounds of smallest labels with pointer jumps; each round is checkpointed."""
    checkpoints(edges.sparkSession)
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = both.union(both.select("v", "u")).distinct().checkpoint()
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")).checkpoint()
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        far = labels.select(F.col("node").alias("k"), F.col("component").alias("far"))
        new = low.join(far, F.col("low") == F.col("k"), "left").select("node", "was", F.least("low", F.coalesce("far", "low")).alias("component")).checkpoint()
        labels = new.select("node", "component")
        if new.filter("was <> component").isEmpty():
            return labels


def clusters(boxes: DataFrame, page: str, key: str, merge_gap: float) -> DataFrame:
    """Adds cluster, the smallest key of a box's cluster. Kinds of equal boxes are linked, not all pairs of boxes, unless keys repeat."""
    if _repeated(boxes, key):
        found = components(neighbours(boxes, page, key, merge_gap))
        return boxes.join(found, F.col(key) == F.col("node"), "left").withColumn("cluster", F.coalesce("component", F.col(key))).drop("node", "component")
    kinds = _kinds(boxes, page, key)
    near = _near_kinds(kinds, page, merge_gap, 0.6).select(F.col("ka.__k").alias("a"), F.col("kb.__k").alias("b"))
    found = kinds.join(components(near), F.col("kind.__k") == F.col("node")).select(page, *CORNERS, "component")
    cluster = F.when(F.col(key).isNotNull(), F.coalesce("component", F.col(key)))
    return boxes.join(found, [page, *CORNERS], "left").withColumn("cluster", cluster).select(*boxes.columns, "cluster")


def _greedy(gap_: float):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        unions: list[list[float]] = []
        for r in pdf.sort_values("ord").itertuples():
            box = [r.x0, r.y0, r.x1, r.y1]
            for u in unions:
                dx, dy = max(0.0, box[0] - u[2], u[0] - box[2]), max(0.0, box[1] - u[3], u[1] - box[3])
                if (dx * dx + dy * dy) ** 0.5 <= gap_:
                    u[:] = [min(u[0], box[0]), min(u[1], box[1]), max(u[2], box[2]), max(u[3], box[3])]
                    break
            else:
                unions.append(box)
        return pd.DataFrame([[pdf.page.iloc[0], i, *u] for i, u in enumerate(unions)], columns=["page", "cluster", "x0", "y0", "x1", "y1"])

    return one


def greedy_unions(boxes: DataFrame, gap_: float) -> DataFrame:
    """Each box joins the first union it is near to, which grows: depends on the order (ord), a fold over one page."""
    return boxes.select("page", "ord", "x0", "y0", "x1", "y1").groupBy("page").applyInPandas(_greedy(gap_), "page long, cluster int, x0 double, y0 double, x1 double, y1 double")


def merge_intervals(rows: DataFrame, keys: list[str], lo: str, hi: str, gap_: float) -> DataFrame:
    """Intervals no further than gap_ apart as one: gaps and islands."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *keys)  # all of them: fewer and larger ones would be sorted at once
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = rows.withColumn("__new", (reach.isNull() | (F.col(lo) > reach + gap_)).cast("int")).withColumn("__island", F.sum("__new").over(w))
    return r.groupBy(*keys, "__island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("merged")).drop("__island")


#: Fixed value: the least height of a band that a cut leaves.
LEAST_REST = 18.0


def subtract_intervals(rows: DataFrame, gone: DataFrame, key: str, lo: str, hi: str, least: float = LEAST_REST) -> DataFrame:
    """What is left of each interval (key, id, lo, hi) without those of gone (key, lo, hi): rests of `least` or more, and
    intervals that nothing cuts, whatever their length."""
    g = merge_intervals(gone.filter(F.col(hi) > F.col(lo)).select(key, F.col(lo).alias("glo"), F.col(hi).alias("ghi")), [key], "glo", "ghi", 0.0).select(F.col(key).alias("__k"), "glo", "ghi")
    cut = rows.join(g, (F.col(key) == F.col("__k")) & (F.col("glo") < F.col(hi)) & (F.col("ghi") > F.col(lo)), "left")
    lists = cut.groupBy(key, "id", lo, hi).agg(F.array_sort(F.collect_list(F.when(F.col("glo").isNotNull(), F.struct("glo", "ghi")))).alias("c"))
    starts = F.concat(F.array(F.col(lo)), F.transform("c", lambda x: x["ghi"]))
    ends = F.concat(F.transform("c", lambda x: x["glo"]), F.array(F.col(hi)))
    fits = lambda x: (F.size("c") == 0) | ((x["hi"] - x["lo"] >= least) & (x["lo"] < x["hi"]))
    parts = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("lo"), e.alias("hi"))), fits)
    return lists.select(key, "id", F.inline(parts))


def _boxes_of(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x0, y0, x1, y1 (ends exclusive) and pixels of the connected parts, by runs of set pixels that touch runs of the row above."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    turn = np.diff(padded, axis=1)
    rows, begin = np.nonzero(turn == 1)
    end = np.nonzero(turn == -1)[1]
    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(1, mask.shape[0]):
        above, here = int(first[y - 1]), int(first[y])
        while above < first[y] and here < first[y + 1]:
            if begin[here] <= end[above] and begin[above] <= end[here]:  # a corner is enough
                a, b = root(above), root(here)
                parent[max(a, b)] = min(a, b)
            if end[above] < end[here]:
                above += 1
            else:
                here += 1
    parts: dict[int, list[int]] = {}
    for i in range(len(rows)):
        y, x0, x1 = int(rows[i]), int(begin[i]), int(end[i])
        p = parts.setdefault(root(i), [x0, y, x1, y + 1, 0])
        p[:] = min(p[0], x0), p[1], max(p[2], x1), y + 1, p[4] + x1 - x0
    return [tuple(parts[k]) for k in sorted(parts)]


def connected_boxes(masks: DataFrame) -> DataFrame:
    """key, part (0, 1, ...), x0, y0, x1, y1 (ends exclusive), pixels: the parts of each mask whose set pixels touch, by
    sides or corners, in order of their first pixel from the top left.

    masks: key, width, height and mask (a byte for each pixel, set if not 0). One mask is one row's work. A mask without set
    pixels has no parts, nor has one that is null or not of its size."""
    names = ("part", "x0", "y0", "x1", "y1", "pixels")
    schema = T.StructType([T.StructField("key", masks.schema["key"].dataType), *(T.StructField(n, T.IntegerType()) for n in names)])

    def run(batches):
        for b in batches:
            rows = []
            for key, w, h, m in zip(b.key, b.width, b.height, b["mask"]):
                if m is not None and w == w and h == h and len(m) == w * h > 0:
                    found = _boxes_of(np.frombuffer(m, np.uint8).reshape(int(h), int(w)) > 0)
                    rows += [(key, i, *box) for i, box in enumerate(found)]
            yield pd.DataFrame(rows, columns=["key", *names])

    return masks.select("key", "width", "height", "mask").mapInPandas(run, schema)


def by_page(rows: DataFrame, one: Callable[[dict[str, np.ndarray]], dict[str, Sequence]], schema: T.StructType) -> DataFrame:
    """What `one` makes of the rows of each page, its columns as arrays. Pages are dealt over tasks and lie there one after the
    other; a batch is converted at once, not page by page."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in chain(batches, (None,)):
            if b is not None:
                if not len(b):
                    continue
                held.append(b)
                if held[0].page.iloc[0] == b.page.iloc[-1]:  # no page ends here
                    continue
            if not held:
                return
            t = pd.concat(held, ignore_index=True)
            page = t.page.to_numpy()
            heads = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
            last = len(t) if b is None else int(heads[-1])
            columns = {c: t[c].to_numpy() for c in t.columns}
            heads = [*heads[heads < last].tolist(), last]
            made = [one({c: v[lo:hi] for c, v in columns.items()}) for lo, hi in zip(heads, heads[1:])]
            out = pd.DataFrame({n: [x for m in made for x in m[n]] for n in names})
            if len(out):
                yield out
            held = [t.iloc[last:]] if last < len(t) else []

    return rows.repartition(parts, "page").sortWithinPartitions("page").mapInPandas(run, schema)


def _rule_groups(least: int):
    def run(p: dict[str, np.ndarray]) -> dict[str, Sequence]:
        wide, high = max(1.0, float(p["page_width"].max())), max(1.0, float(p["page_height"].max()))
        fit = p["x1"] - p["x0"] >= max(96.0, wide * RULE["share"])
        key, x0, y0, x1, y1 = p["key"][fit], *(p[c][fit].astype(float) for c in ("x0", "y0", "x1", "y1"))
        order = np.lexsort((key, x0, (y0 + y1) / 2))
        key, x0, y0, x1, y1 = key[order], x0[order], y0[order], x1[order], y1[order]
        width, middle = np.maximum(1.0, x1 - x0), (x0 + x1) / 2
        group = np.full(len(key), -1)
        for seed in range(len(key)):
            if group[seed] >= 0:
                continue
            new = np.arange(len(key)) == seed
            while new.any():  # all rules that fit the group's box join it at once, then the box grows
                group[new] = seed
                own, free = group == seed, group < 0
                left, top, right, bottom = x0[own].min(), y0[own].min(), x1[own].max(), y1[own].max()
                span = max(1.0, right - left)
                alike = np.minimum(span, width) / np.maximum(span, width) >= RULE["alike"]
                centred = np.abs(middle - (left + right) / 2) <= wide * RULE["centre"]
                shared = np.maximum(0.0, np.minimum(right, x1) - np.maximum(left, x0)) / np.maximum(1.0, np.minimum(right - left, x1 - x0))
                apart = np.maximum(np.maximum(y0 - bottom, top - y1), 0.0)
                new = free & alike & centred & (shared >= RULE["overlap"]) & (apart <= high * RULE["gap"])
        heights: dict[int, set[float]] = {}
        for g, m in zip(group.tolist(), ((y0 + y1) / 2).tolist()):
            heights.setdefault(g, set()).add(round(m, 1))
        number = {g: i for i, g in enumerate(sorted(g for g, v in heights.items() if len(v) >= least))}
        kept = [i for i, g in enumerate(group.tolist()) if g in number]
        return {"page": [p["page"][0]] * len(kept), "key": key[kept].tolist(), "group": [number[g] for g in group[kept].tolist()]}

    return run


def rule_groups(rules: DataFrame, least: int = 2) -> DataFrame:
    """page, key, group (0, 1, ...): the ruled lines that make up one table each, from the top of a page.

    rules: page, key, x0, y0, x1, y1 and the page's page_width and page_height. Narrow rules are left out; the topmost rule
    begins a group, and rules of like width, centre and place join until none does. Groups of fewer than `least` different
    heights are no tables. Equal rules belong together, in order of key. Rows with null in any of these columns are left
    out. The rules of a page are held in one task."""
    names = ("page", "key", "x0", "y0", "x1", "y1", "page_width", "page_height")
    schema = T.StructType([T.StructField("page", rules.schema["page"].dataType), T.StructField("key", rules.schema["key"].dataType), T.StructField("group", T.IntegerType())])
    return by_page(rules.select(*names).dropna(), _rule_groups(least), schema)


def _area(pdf: pd.DataFrame) -> pd.DataFrame:
    xs = sorted({*pdf.x0, *pdf.x1})
    total = 0.0
    for a, b in zip(xs, xs[1:]):
        live = pdf[(pdf.x0 <= a) & (pdf.x1 >= b)].sort_values("y0")
        reach = None
        for lo, hi in zip(live.y0, live.y1):
            start = lo if reach is None else max(lo, reach)
            if hi > start:
                total += (hi - start) * (b - a)
            reach = hi if reach is None else max(reach, hi)
    return pd.DataFrame({"page": [pdf.page.iloc[0]], "area": [total]})


def union_area(boxes: DataFrame) -> DataFrame:
    """Area that a page's boxes cover together, by a sweep."""
    return boxes.select("page", "x0", "y0", "x1", "y1").groupBy("page").applyInPandas(_area, "page long, area double")


def column_profile(lines: DataFrame, page: str, middle: Column) -> DataFrame:
    """Weights left, right and across of the middle of a page, and whether it has two columns. lines: x0, x1, weight."""
    left, right = F.col("x1") <= middle, F.col("x0") >= middle
    w = F.col("weight")
    g = lines.groupBy(page).agg(F.sum(F.when(left, w).otherwise(0)).alias("left_weight"), F.sum(F.when(right, w).otherwise(0)).alias("right_weight"), F.sum(F.when(~left & ~right, w).otherwise(0)).alias("across_weight"), F.count_if(left).alias("left_lines"), F.count_if(right).alias("right_lines"))
    total = F.col("left_weight") + F.col("right_weight") + F.col("across_weight")
    two = (F.col("left_lines") >= 6) & (F.col("right_lines") >= 6) & (total >= 160) & (F.col("left_weight") / total >= 0.18) & (F.col("right_weight") / total >= 0.18) & ((F.col("left_weight") + F.col("right_weight")) / total >= 0.62)
    return g.withColumn("two_column", two)


def best_split(lines: DataFrame, page: str, width: float) -> DataFrame:
    """The split of 22 to 78 percent of the width that confines the most weight, with .35 of the lighter side."""
    tries = lines.withColumn("split", F.explode(F.sequence(F.lit(22), F.lit(78))))  # 57 rows a line, summed before they are shuffled
    at = F.col("split") * F.lit(width) / 100
    g = tries.groupBy(page, "split").agg(F.sum(F.when(F.col("x1") <= at, F.col("weight")).otherwise(0)).alias("l"), F.sum(F.when(F.col("x0") >= at, F.col("weight")).otherwise(0)).alias("r"))
    g = g.withColumn("score", F.col("l") + F.col("r") + 0.35 * F.least("l", "r"))
    best = g.groupBy(page).agg(F.max(F.struct("score", (-F.col("split")).alias("s"))).alias("b"))
    return best.select(page, (-F.col("b.s")).alias("split"), F.col("b.score").alias("score"))


def reading_order(items: DataFrame, page: str, key: str) -> DataFrame:
    """Adds position: items with col full, left or right; full-width items part the page, and in each part the left column
    comes before the right one."""
    w = Window.partitionBy(page).orderBy("cy", key)
    band = F.sum((F.col("col") == "full").cast("int")).over(w)
    side = F.when(F.col("col") == "full", 0).when(F.col("col") == "left", 1).otherwise(2)
    return items.withColumn("__band", band).withColumn("position", F.row_number().over(Window.partitionBy(page).orderBy("__band", side, "cy", "x0", key))).drop("__band")


def two_columns(lines: DataFrame, page: str, width: float) -> DataFrame:
    """page and two_column: whether enough lines (x, x1) keep to either half of a page, but for a gutter of 4 percent."""
    middle, gutter = width / 2, width * 0.04
    left = (F.col("x1") <= middle + gutter) & (F.col("x") < middle)
    right = (F.col("x") >= middle - gutter) & (F.col("x1") > middle)
    least = F.greatest(F.lit(4), F.bround(F.count("*") * 0.14))
    return lines.groupBy(page).agg(((F.count_if(left) >= least) & (F.count_if(right) >= least)).alias("two_column"))


def column_of(x: Column, x1: Column, width: float, two_column: Column) -> Column:
    """main on a page of one column; else left, right, or full for what is wide or reaches far over the middle."""
    middle = width / 2
    wide = (x1 - x >= width * 0.62) | ((x < middle - width * 0.12) & (x1 > middle + width * 0.12))
    side = F.when(x1 <= middle + width * 0.04, "left").when(x >= middle - width * 0.04, "right")
    return F.when(~two_column, "main").when(wide, "full").otherwise(F.coalesce(side, F.lit("full")))


#: Fixed value: how an entry of a list of references begins.
REFERENCE = r"^[A-Z][A-Za-z'\u2019\-]+(?:,|\s+[A-Z]\.)"


def paragraphs(lines: DataFrame, page: str, order: str) -> DataFrame:
    """Adds paragraph, 1, 2, ... in a page: a line goes on with the one before in its column unless either is a heading, it
    stands too far below or above, has another size, or the one before ends a sentence and it is indented or begins a
    reference. lines: x, y, height (in twentieths of a point), font_size, bold, text, col. A null text is an empty one; other nulls part lines."""
    w = Window.partitionBy(page).orderBy(order)
    size = F.percentile("font_size", F.lit(0.5)).over(Window.partitionBy(page))
    written = F.coalesce("text", F.lit(""))
    text = F.trim(written)
    heading = (text != "") & (F.length(text) <= 140) & ((F.col("font_size") >= F.col("__size") * 1.18) | (F.col("bold") & (F.length(text) <= 90)))
    marked = lines.withColumn("__size", size).withColumn("__heading", heading)
    prev = lambda c: F.lag(c).over(w)
    space, tall = F.col("y") - prev("y") - prev("height"), F.greatest(prev("height"), F.col("height"))
    ended = prev(F.rtrim(written))
    indented = ended.rlike("[.!?:]$") & (F.col("x") - prev("x") > F.greatest(F.lit(120), F.bround(F.col("font_size") * 12)))
    reference = ended.endswith(".") & text.rlike(REFERENCE)
    near = (space >= -0.4 * tall) & (space <= F.greatest(F.lit(360), F.bround(tall * 1.35)))
    alike = F.abs(prev("font_size") - F.col("font_size")) <= F.greatest(F.lit(1.2), F.col("__size") * 0.16)
    on = (prev("col") == F.col("col")) & ~prev("__heading") & ~F.col("__heading") & near & alike & ~indented & ~reference
    begun = marked.withColumn("__new", (~F.coalesce(on, F.lit(False))).cast("int"))
    return begun.withColumn("paragraph", F.sum("__new").over(w)).drop("__new", "__size", "__heading")


def _rows(tolerance: float, x_gap: float):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out, row, first = [], -1, None
        for r in pdf.sort_values(["y", "x"]).to_dict("records"):
            if first is None or abs(r["y"] - first) > tolerance:
                row, first = row + 1, r["y"]
            out.append(r | {"row": row})
        out.sort(key=lambda r: (r["row"], r["x"]))
        part, last = -1, None
        for r in out:
            if last is None or last[0] != r["row"] or r["x"] - last[1] > x_gap:
                part += 1
            last = (r["row"], r["x"] + r["width"])
            r["cluster"] = part
        return pd.DataFrame(out)[["page", "row", "cluster", "x", "y", "width", "text"]]

    return one


def line_rows(frames: DataFrame, tolerance: float, x_gap: float) -> DataFrame:
    """Frames in rows by the height of each row's FIRST frame, and rows in clusters by their gaps: a fold over one page."""
    return frames.select("page", "x", "y", "width", "text").groupBy("page").applyInPandas(_rows(tolerance, x_gap), "page long, row int, cluster int, x double, y double, width double, text string")


#: The scale from which a sheet is readable, and the least printable side in points.
READABLE, LEAST_SIDE = 0.90, 72.0


def layout_choice(sheets: DataFrame, papers: list[tuple[str, float, float]], margins: list[tuple[str, float]]) -> DataFrame:
    """The paper, orientation and margin for each sheet (width, height in points) that fit its width to a page; margins
    after the first count as changed. Options whose scale is READABLE or more come first: of these the smallest paper, then the
    largest scale, the fewest pages, an unchanged margin, portrait. Without any the largest scale counts first, then paper,
    pages and margin. At last the order of the lists decides."""
    options = [(p, o, m, pw if o == "portrait" else ph, ph if o == "portrait" else pw, mm, k > 0, j, (i * 2 + j) * len(margins) + k) for i, (p, pw, ph) in enumerate(papers) for j, o in enumerate(("portrait", "landscape")) for k, (m, mm) in enumerate(margins)]

    def cost(paper: str, orientation: str, margin: str, pw: float, ph: float, mm: float, changed: bool, turned: int, rank: int) -> Column:
        usable_w, usable_h = max(LEAST_SIDE, pw - 2 * mm), max(LEAST_SIDE, ph - 2 * mm)
        scale = F.least(F.lit(1.0), F.lit(float(usable_w)) / F.greatest(F.lit(1.0), F.col("width")))
        pages = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1.0), F.col("height")) * scale / F.lit(float(usable_h)) - 1e-9))
        readable, area, none = scale >= READABLE, F.lit(float(pw * ph)), F.lit(0.0)
        first = F.struct((~readable).alias("x"), F.when(readable, area).otherwise(-scale).alias("y"), F.when(readable, -scale).otherwise(area).alias("z"))
        named = {"changed": F.lit(changed), "turned": F.when(readable, F.lit(float(turned))).otherwise(none), "rank": F.lit(rank), "paper": F.lit(paper), "orientation": F.lit(orientation), "margin": F.lit(margin), "scale": scale}
        return F.struct(first.alias("first"), pages.alias("n_pages"), *(c.alias(n) for n, c in named.items()))

    # the options are a list within each row; a sheet given twice is one
    parts = int(sheets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = sheets.repartition(parts, *sheets.columns).dropDuplicates()
    best = once.withColumn("b", F.array_min(F.array(*(cost(*o) for o in options))))
    return best.select(*sheets.columns, "b.paper", "b.orientation", "b.margin", "b.n_pages", "b.scale")
