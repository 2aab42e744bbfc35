"""Pages as islands to keep as pictures, and the text around them that stays text.

Lines, images, drawings and ruled lines of a page are four relations. They meet once, tagged, page by page: each kind proposes
regions with a reason, labels beside a region join it, regions that touch are one, and a region takes in whatever lines it
covers until nothing changes. All of these steps only let regions grow, so the result doesn't depend on any order. What is
decided from regions (which lines stay, whether the page is better kept whole) are joins and columns over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import plain_form, suspicious
from .geometry import by_page, rule_groups
from .ranks import checkpoints

# Fixed values, in points or as shares of the page. Images: least share, share that one needs alone, and how near two are one
# figure: side by side, one above the other, and their common extent.
FIGURE = {"least": 0.0015, "alone": 0.01, "side": 36.0, "stack": 20.0, "common": 0.45}
# Drawings within `gap` are one; what makes them a region: items, parts, or some items and a share of the page;
# white backgrounds from this share on and thin rules near the top of the page are no drawings.
VECTOR = {"gap": 4.0, "items": 100, "parts": 40, "some": 40, "share": 0.02, "background": 0.05, "top": 80.0, "thin": 3.0}
# Rules of a table, how far beyond them its rows may lie, and what a row shares with them.
TABLE = {"rules": 3, "beyond": 3.0, "common": 0.20}
# Formulas: least share of mathematical characters, widest line, its distance from the middle of the page; how far
# apart a formula's parts are in height and in all; words and characters of prose.
FORMULA = {"math": 0.30, "wide": 0.65, "middle": 0.30, "height": 22.0, "near": 12.0, "gap": 8.0, "words": 4, "characters": 36}
# Labels: distance, height, length in all and at a side, and the share of a line that touches.
LABEL = {"gap": 16.0, "height": 24.0, "characters": 180, "side": 32, "touch": 0.10}
# What is added around boxes; when regions are one; the share of a line that a region covers; the top and bottom of the page.
PADDING = {"box": 0.75, "table": 1.5, "line": 1.5, "label": 2.5}
MERGE = {"vector": 32.0, "all": 1.0}
COVERED = 0.35
BANDS = (0.06, 0.97)
# Pages kept whole: fewest characters, share of regions; figures in two columns; a wide table at the bottom.
WHOLE = {"characters": 8, "share": 0.85, "figures": 4, "each": 2, "wide": 0.58, "area": 0.28}
BOTTOM = {"wide": 0.88, "left": 0.12, "high": 0.34, "end": 0.94}
#: How captions begin.
CAPTION = "^\\s*(?:fig(?:ure)?|table|图|表)\\.?\\s*[0-9ivxlcdm]+(?:\\s|[:.]|$)"

REASONS = {"figure": "images", "vector": "dense drawing", "table": "ruled table", "formula": "formula", "encoding": "unreadable characters"}
REGIONS = "region int, x0 double, y0 double, x1 double, y1 double, kind string, reasons string, parts int"


def _sweep(boxes: np.ndarray, reach: float, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A label for each box: those joined by chains of near ones share one. Only boxes within `reach` in height are looked at."""
    parent = np.arange(len(boxes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = np.argsort(boxes[:, 1], kind="stable")
    tops = boxes[order, 1]
    for k, i in enumerate(order.tolist()):
        later = order[k + 1 : int(np.searchsorted(tops, boxes[i, 3] + reach, "right"))]
        for j in later[near(boxes[i], boxes[later])].tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(boxes))], np.int64)


def _gaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(np.maximum(b[..., 0] - a[..., 2], a[..., 0] - b[..., 2]), 0), np.maximum(np.maximum(b[..., 1] - a[..., 3], a[..., 1] - b[..., 3]), 0)


def _common(a: np.ndarray, b: np.ndarray, axis: int) -> np.ndarray:
    return np.maximum(0.0, np.minimum(a[..., axis + 2], b[..., axis + 2]) - np.maximum(a[..., axis], b[..., axis]))


def _within(gap: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda a, b: np.hypot(*_gaps(a, b)) <= gap


def _unions(boxes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of each label's boxes, and the place of each box's union."""
    _, place = np.unique(labels, return_inverse=True)
    out = np.empty((int(place.max(initial=-1)) + 1, 4))
    for axis, (start, pick) in enumerate(((np.inf, np.minimum), (np.inf, np.minimum), (-np.inf, np.maximum), (-np.inf, np.maximum))):
        column = np.full(len(out), start)
        pick.at(column, place, boxes[:, axis])
        out[:, axis] = column
    return out, place


def closed(boxes: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Unions of boxes no two of which are within gap, and the place of each box's union."""
    place = np.arange(len(boxes))
    while len(boxes):
        boxes, into = _unions(boxes, _sweep(boxes, gap, _within(gap)))
        place = into[place]
        if len(boxes) == len(into):
            break
    return boxes, place


def _area(boxes: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, boxes[..., 2] - boxes[..., 0]) * np.maximum(0.0, boxes[..., 3] - boxes[..., 1])


def _covers(region: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Lines whose middle is in the region, or so much of them."""
    x, y = (lines[:, 0] + lines[:, 2]) / 2, (lines[:, 1] + lines[:, 3]) / 2
    middle = (region[0] <= x) & (x <= region[2]) & (region[1] <= y) & (y <= region[3])
    return middle | (_common(region, lines, 0) * _common(region, lines, 1) >= COVERED * np.maximum(_area(lines), 1e-9))


class _Regions:
    def __init__(self):
        self.boxes, self.kinds, self.reasons, self.parts = np.empty((0, 4)), [], [], []

    def add(self, boxes: np.ndarray, kind: str, parts: list[int]) -> None:
        self.boxes = np.concatenate([self.boxes, boxes.reshape(-1, 4)])
        self.kinds += [kind] * len(parts)
        self.reasons += [{REASONS[kind]} for _ in parts]
        self.parts += parts

    def merge(self, gap: float, some: np.ndarray | None = None) -> None:
        """Regions (some of them) within gap become one; of several kinds, a complex one."""
        some = np.ones(len(self.kinds), bool) if some is None else some
        at = np.flatnonzero(some)
        boxes, place = closed(self.boxes[at], gap)
        out = _Regions()
        out.boxes = np.concatenate([self.boxes[~some], boxes])
        rest = np.flatnonzero(~some).tolist()
        groups = [[i] for i in rest] + [at[place == k].tolist() for k in range(len(boxes))]
        kinds = [{self.kinds[i] for i in g} for g in groups]
        self.kinds = [k.pop() if len(k) == 1 else "complex" for k in kinds]
        self.reasons = [set().union(*(self.reasons[i] for i in g)) for g in groups]
        self.parts = [sum(self.parts[i] for i in g) for g in groups]
        self.boxes = out.boxes


def _padded(boxes: np.ndarray, by: float, width: float, height: float) -> np.ndarray:
    return np.stack([np.maximum(0.0, boxes[:, 0] - by), np.maximum(0.0, boxes[:, 1] - by), np.minimum(width, boxes[:, 2] + by), np.minimum(height, boxes[:, 3] + by)], 1)


def _figures(found: _Regions, images: np.ndarray, captions: np.ndarray, page: float) -> None:
    images = images[_area(images) / page >= FIGURE["least"]]
    between = np.sort((captions[:, 1] + captions[:, 3]) / 2)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        across, down = _gaps(a, b)
        extent = lambda axis: _common(a, b, axis) / np.maximum(1.0, np.minimum(a[axis + 2] - a[axis], b[:, axis + 2] - b[:, axis]))
        upper, lower = np.minimum(a[3], b[:, 3]), np.maximum(a[1], b[:, 1])
        parted = (lower >= upper) & (np.searchsorted(between, lower, "right") > np.searchsorted(between, upper, "left"))
        return ((across <= FIGURE["side"]) & (extent(1) >= FIGURE["common"])) | ((down <= FIGURE["stack"]) & (extent(0) >= FIGURE["common"]) & ~parted)

    boxes, place = _unions(images, _sweep(images, FIGURE["stack"], near))
    parts = np.bincount(place, minlength=len(boxes))
    good = (parts >= 2) | (_area(boxes) / page >= FIGURE["alone"])
    found.add(boxes[good], "figure", parts[good].tolist())


def _vectors(found: _Regions, drawings: np.ndarray, items: np.ndarray, white: np.ndarray, page: float) -> None:
    items = np.maximum(items, 1)
    background = white & (items <= 1) & (_area(drawings) / page >= VECTOR["background"])
    rule = (drawings[:, 3] <= VECTOR["top"]) & (drawings[:, 3] - drawings[:, 1] <= VECTOR["thin"]) & (items < VECTOR["some"])
    drawings, items = drawings[~background & ~rule], items[~background & ~rule]
    boxes, place = closed(drawings, VECTOR["gap"])
    parts, total = np.bincount(place, minlength=len(boxes)), np.bincount(place, items, len(boxes))
    good = (total >= VECTOR["items"]) | (parts >= VECTOR["parts"]) | ((total >= VECTOR["some"]) & (_area(boxes) / page >= VECTOR["share"]))
    found.add(boxes[good], "vector", parts[good].tolist())


def _tables(found: _Regions, rules: np.ndarray, groups: np.ndarray, lines: np.ndarray, width: float, height: float) -> None:
    middle = (lines[:, 1] + lines[:, 3]) / 2
    for g in np.unique(groups).tolist():
        own = rules[groups == g]
        if len(own) < TABLE["rules"]:
            continue
        box = np.array([own[:, 0].min(), own[:, 1].min(), own[:, 2].max(), own[:, 3].max()])
        heights = (own[:, 1] + own[:, 3]) / 2
        row = (middle >= heights.min() - TABLE["beyond"]) & (middle <= heights.max() + TABLE["beyond"])
        row &= _common(box, lines, 0) >= TABLE["common"] * np.minimum(lines[:, 2] - lines[:, 0], box[2] - box[0])
        if row.any():
            box, _ = _unions(np.concatenate([box[None], lines[row]]), np.zeros(1 + int(row.sum()), int))
            found.add(_padded(box, PADDING["table"], width, height), "table", [len(own)])


def _formulas(found: _Regions, lines: np.ndarray, seed: np.ndarray, support: np.ndarray) -> None:
    middle = (lines[:, 1] + lines[:, 3]) / 2
    boxes = []
    for i in np.flatnonzero(seed).tolist():
        part = support & (np.abs(middle - middle[i]) <= FORMULA["height"]) & _within(FORMULA["near"])(lines[i], lines)
        part[i] = True
        boxes.append(_unions(lines[part], np.zeros(int(part.sum()), int))[0])
    if boxes:
        merged, place = closed(np.concatenate(boxes), FORMULA["gap"])
        found.add(merged, "formula", np.bincount(place).tolist())


def _labelled(found: _Regions, lines: np.ndarray, length: np.ndarray, caption: np.ndarray, width: float, height: float) -> None:
    for k, kind in enumerate(found.kinds):
        if kind in ("formula", "encoding"):
            continue
        base = found.boxes[k]
        across, down = _gaps(base, lines)
        area = _common(base, lines, 0) * _common(base, lines, 1) / np.maximum(_area(lines), 1e-9)
        x, y = (lines[:, 0] + lines[:, 2]) / 2, (lines[:, 1] + lines[:, 3]) / 2
        inside = (base[0] <= x) & (x <= base[2]) & (base[1] <= y) & (y <= base[3])
        beside = ((down <= LABEL["gap"]) & (_common(base, lines, 0) > 0)) | ((across <= LABEL["gap"]) & (_common(base, lines, 1) > 0) & (length <= LABEL["side"]))
        label = beside & (lines[:, 3] - lines[:, 1] <= LABEL["height"]) & (length <= LABEL["characters"])
        joins = (inside | (area >= LABEL["touch"]) | label) & ~(label & ~inside & (area <= 0) & caption)
        grown, _ = _unions(np.concatenate([base[None], lines[joins]]), np.zeros(1 + int(joins.sum()), int))
        found.boxes[k] = _padded(grown, PADDING["label"], width, height)[0]


def _closed_over(found: _Regions, lines: np.ndarray) -> None:
    while True:
        before = found.boxes.copy()
        found.merge(MERGE["all"])
        for k, box in enumerate(found.boxes):
            taken = _covers(box, lines)
            if taken.any():
                found.boxes[k] = _unions(np.concatenate([box[None], lines[taken]]), np.zeros(1 + int(taken.sum()), int))[0][0]
        if found.boxes.shape == before.shape and (found.boxes == before).all():
            return


def _page(p: dict[str, np.ndarray]) -> dict[str, Sequence]:
    width, height = float(p["width"][0]), float(p["height"][0])
    area = max(1.0, width * height)
    boxes = np.stack([p[c] for c in ("x0", "y0", "x1", "y1")], 1).astype(float)
    at = {what: np.flatnonzero(p["what"] == what) for what in ("line", "image", "drawing", "rule")}
    of = lambda what, by: _padded(boxes[at[what]], by, width, height)
    column = lambda what, name: p[name][at[what]]
    lines = of("line", 0.0)
    length, caption, bad = column("line", "length").astype(int), column("line", "caption").astype(bool), column("line", "bad").astype(bool)
    body = (lines[:, 3] > height * BANDS[0]) & (lines[:, 1] < height * BANDS[1])
    found = _Regions()
    _figures(found, of("image", PADDING["box"]), lines[caption], area)
    vectors = _Regions()
    _vectors(vectors, of("drawing", PADDING["box"]), column("drawing", "items").astype(int), column("drawing", "white").astype(bool), area)
    vectors.merge(MERGE["vector"])
    found.boxes = np.concatenate([found.boxes, vectors.boxes])
    found.kinds, found.reasons, found.parts = found.kinds + vectors.kinds, found.reasons + vectors.reasons, found.parts + vectors.parts
    _tables(found, of("rule", 0.0), column("rule", "items").astype(int), lines, width, height)
    wide, middle = (lines[:, 2] - lines[:, 0]) / width, np.abs((lines[:, 0] + lines[:, 2]) / 2 - width / 2) / width
    math, prose = column("line", "math").astype(float), column("line", "prose").astype(bool)
    seed = body & ~caption & ~prose & ~bad & (math >= FORMULA["math"]) & (wide <= FORMULA["wide"]) & (middle <= FORMULA["middle"])
    _formulas(found, lines, seed, body & ~caption & ~prose & (math > 0))
    unreadable, place = closed(_padded(lines[bad & body], PADDING["line"], width, height), MERGE["all"])
    found.add(unreadable, "encoding", np.bincount(place, minlength=len(unreadable)).tolist())
    _labelled(found, lines, length, caption, width, height)
    found.merge(MERGE["vector"], np.array([k == "vector" for k in found.kinds], bool))
    _closed_over(found, lines[body & ~caption])
    order = np.lexsort((found.boxes[:, 2], found.boxes[:, 3], found.boxes[:, 0], found.boxes[:, 1]))
    rows = [(p["page"][0], n, *found.boxes[i].tolist(), found.kinds[i], ", ".join(sorted(found.reasons[i])), int(found.parts[i])) for n, i in enumerate(order.tolist())]
    return {name: [r[k] for r in rows] for k, name in enumerate(["page", *(x.split()[0] for x in REGIONS.split(", "))])}


def _boxes(rows: DataFrame, what: str, sizes: DataFrame, **more: Column) -> DataFrame:
    """Boxes of one relation with the size of their page, corners in order; those with a null or unknown page or a null corner go."""
    low = lambda a: F.least(f"{a}0", f"{a}1").cast("double")
    high = lambda a: F.greatest(f"{a}0", f"{a}1").cast("double")
    kept = {"items": F.lit(0), "white": F.lit(False), "length": F.lit(0), "caption": F.lit(False), "bad": F.lit(False), "prose": F.lit(False), "math": F.lit(0.0)} | more
    shown = rows.dropna(subset=["page", "x0", "y0", "x1", "y1"]).select("page", F.lit(what).alias("what"), low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"), *(c.alias(n) for n, c in kept.items()))
    return shown.join(sizes, "page")


def islands(lines: DataFrame, images: DataFrame, drawings: DataFrame, rules: DataFrame, sizes: DataFrame) -> DataFrame:
    """page and REGIONS: what of each page is kept as pictures, from the top.

    All have page and x0, y0, x1, y1; lines also text and math (the share of mathematical characters, null: 0), drawings items
    (null: 1) and white (a white background, null: no), rules key. sizes has page, width and height, of each page once; pages
    without are left out, as are boxes with a null corner. Null texts are empty. The boxes of one page are held in one task."""
    sizes = sizes.dropna().filter("width > 0 and height > 0").select("page", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    text = F.coalesce("text", F.lit(""))
    prose = (F.regexp_count(text, F.lit("[A-Za-z]{3,}")) >= FORMULA["words"]) & (F.length(plain_form(text)) >= FORMULA["characters"])
    told = _boxes(lines, "line", sizes, length=F.length(F.trim(text)), caption=F.lower(text).rlike(CAPTION), bad=suspicious(text), prose=prose, math=F.coalesce(F.col("math").cast("double"), F.lit(0.0)))
    told = told.unionByName(_boxes(images, "image", sizes))
    told = told.unionByName(_boxes(drawings, "drawing", sizes, items=F.coalesce(F.col("items").cast("int"), F.lit(1)), white=F.coalesce("white", F.lit(False))))
    grouped = rule_groups(rules.join(sizes, "page").withColumnsRenamed({"width": "page_width", "height": "page_height"}))
    ruled = rules.join(grouped.withColumnRenamed("group", "__group"), ["page", "key"])
    told = told.unionByName(_boxes(ruled, "rule", sizes, items=F.col("__group")))
    schema = T.StructType([T.StructField("page", lines.schema["page"].dataType), *T.StructType.fromDDL(REGIONS).fields])
    return by_page(told, _page, schema)


def outside(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """The lines that no region of their page covers: they stay text."""
    r = regions.select("page", *(F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")))
    lo, hi = (lambda a: F.least(f"{a}0", f"{a}1")), (lambda a: F.greatest(f"{a}0", f"{a}1"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    common = lambda a: F.greatest(F.lit(0.0), F.least(hi(a), F.col(f"__{a}1")) - F.greatest(lo(a), F.col(f"__{a}0")))
    area = F.greatest((hi("x") - lo("x")) * (hi("y") - lo("y")), F.lit(1e-9))
    covered = (x.between(F.col("__x0"), F.col("__x1")) & y.between(F.col("__y0"), F.col("__y1"))) | (common("x") * common("y") >= COVERED * area)
    return lines.join(r, (lines["page"] == r["page"]) & covered, "left_anti")


def assessed(lines: DataFrame, regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """page, regions, share (of the page), characters, editable (characters outside of regions) and whole: why the page is better
    kept as one picture, or null. For each page of sizes; a page without lines has no characters, nor has a line with a null corner."""
    checkpoints(lines.sparkSession)
    regions = regions.checkpoint()  # the folds over all pages are made once
    lines = lines.dropna(subset=["page", "x0", "y0", "x1", "y1"])
    length = F.length(plain_form(F.coalesce("text", F.lit(""))))
    every = lines.groupBy("page").agg(F.sum(length).alias("characters"))
    kept = outside(lines, regions).groupBy("page").agg(F.sum(length).alias("editable"), F.max(suspicious(F.coalesce("text", F.lit("")))).alias("__bad"))
    r = regions.join(sizes, "page")
    wide, high, area = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("width") * F.col("height")
    figure, left = F.col("kind") == "figure", (F.col("x0") + F.col("x1")) / 2 <= F.col("width") / 2
    low = F.col("kind").isin("table", "complex") & (wide >= BOTTOM["wide"] * F.col("width")) & (F.col("x0") <= BOTTOM["left"] * F.col("width")) & (F.col("x1") >= (1 - BOTTOM["left"]) * F.col("width"))
    low &= (high >= BOTTOM["high"] * F.col("height")) & (F.col("y1") >= BOTTOM["end"] * F.col("height"))
    told = r.groupBy("page").agg(
        F.count("*").alias("regions"),
        F.least(F.lit(1.0), F.sum(wide * high / area)).alias("share"),
        F.count_if(figure & left).alias("__left"),
        F.count_if(figure & ~left).alias("__right"),
        F.max(figure & (wide > WHOLE["wide"] * F.col("width"))).alias("__wide"),
        F.coalesce(F.sum(F.when(figure, wide * high / area)), F.lit(0.0)).alias("__figures"),
        F.max(low).alias("__low"),
    )
    p = sizes.select("page").join(every, "page", "left").join(kept, "page", "left").join(told, "page", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    dense = (number("__left") >= WHOLE["each"]) & (number("__right") >= WHOLE["each"]) & (number("__left") + number("__right") >= WHOLE["figures"]) & ~flag("__wide") & (F.coalesce("__figures", F.lit(0.0)) >= WHOLE["area"])
    share = F.coalesce("share", F.lit(0.0))
    why = F.when(number("characters") < WHOLE["characters"], "little or no text").when(share >= WHOLE["share"], "regions fill the page").when(number("editable") < WHOLE["characters"], "no text outside of regions")
    why = why.when(flag("__bad"), "unreadable characters outside of regions").when(dense, "many figures in two columns").when(flag("__low"), "a wide region at the bottom")
    return p.select("page", number("regions").cast("long").alias("regions"), share.alias("share"), number("characters").cast("long").alias("characters"), number("editable").cast("long").alias("editable"), why.alias("whole"))
