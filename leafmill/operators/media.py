"""Images and media parts: manifests with duplicates, sizes and layouts as columns, pixels by numpy over Arrow batches.

Pixels are rows of (key, width, height, channels, data), data row by row with 8 bits a channel, as Spark's image source
gives them (there as blue, green, red)."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import natural_key
from .ranks import numbered

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp", "emf", "wmf", "svg")  # fixed values
AUDIO_SUFFIXES = ("mp3", "wav", "m4a", "aac", "wma", "ogg", "flac")
VIDEO_SUFFIXES = ("mp4", "mov", "avi", "wmv", "mkv", "mpg", "mpeg", "m4v", "webm")


def duplicates(items: DataFrame, content: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds sha256 and duplicate_of, the first item by order with the same content (null for the first itself)."""
    hashed = items.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    first = hashed.groupBy(*keys, "sha256").agg(F.min(order).alias("__first"))
    return hashed.join(first, [*keys, "sha256"]).withColumn("duplicate_of", F.when(F.col("__first") != F.col(order), F.col("__first"))).drop("__first")


def manifest(items: DataFrame, order: str, width: str, height: str, min_width: int = 1, min_height: int = 1, content: str = "content") -> DataFrame:
    """Items large enough, with duplicates named and those kept numbered."""
    kept = duplicates(items.filter((F.col(width) >= min_width) & (F.col(height) >= min_height)), content, order)
    first = numbered(kept.filter("duplicate_of IS NULL").select(F.col(order).alias("__first")), [F.col("__first")], "number")
    return kept.join(first, F.col(order) == F.col("__first"), "left").drop("__first")


def members(parts: DataFrame, path: str, name: str, prefix: str, suffixes: Sequence[str] | None = None) -> DataFrame:
    """Parts of a package under a prefix in natural order: adds number and out_name, <stem>_<nnn>_<name>."""
    p = parts.filter(F.col(name).startswith(prefix))
    base = F.element_at(F.split(F.col(name), "/"), -1)
    if suffixes is not None:
        p = p.filter(F.lower(F.element_at(F.split(base, "\\."), -1)).isin(list(suffixes)))
    p = p.withColumn("number", F.row_number().over(Window.partitionBy(path).orderBy(natural_key(F.col(name)), name)))
    stem = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), "\\.[^.]*$", "")
    n = F.col("number").cast("string")
    return p.withColumn("out_name", F.concat(stem, F.lit("_"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), "0"), F.lit("_"), base))


def fit(width: Column, height: Column, to_width: int, to_height: int, keep_aspect: bool = True) -> tuple[Column, Column]:
    """Size after a resize; with the aspect kept the image fits inside, also upwards."""
    if not keep_aspect:
        return F.lit(to_width), F.lit(to_height)
    s = F.least(F.lit(to_width) / width, F.lit(to_height) / height)
    return F.greatest(F.lit(1), F.bround(width * s, 0).cast("int")), F.greatest(F.lit(1), F.bround(height * s, 0).cast("int"))


def scaled(side: Column, percent: float) -> Column:
    return F.greatest(F.lit(1), F.bround(side * F.lit(percent / 100.0), 0).cast("int"))


def pdf_page_size(width: Column, height: Column, dpi: float) -> tuple[Column, Column]:
    """Points of a page that shows an image at a resolution."""
    return width * F.lit(72.0 / dpi), height * F.lit(72.0 / dpi)


def stitch(images: DataFrame, group: str, order: str, direction: str = "vertical", spacing: int = 0, alignment: str = "center") -> DataFrame:
    """Adds x and y of each image on its group's canvas, and the canvas's size; images: width, height."""
    along, across = ("height", "width") if direction == "vertical" else ("width", "height")
    w = Window.partitionBy(group).orderBy(order)
    every = Window.partitionBy(group)
    offset = F.coalesce(F.sum(F.col(along) + spacing).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.max(across).over(every)
    side = {"start": F.lit(0), "center": F.floor((most - F.col(across)) / 2), "end": most - F.col(across)}[alignment].cast("long")
    total = F.sum(along).over(every) + F.lit(spacing) * (F.count("*").over(every) - 1)
    x, y = (side, offset) if direction == "vertical" else (offset, side)
    cw, ch = (most, total) if direction == "vertical" else (total, most)
    return images.withColumns({"x": x.cast("long"), "y": y.cast("long"), "canvas_width": cw.cast("long"), "canvas_height": ch.cast("long")})


def renamed(files: DataFrame, order: str, stem: str, suffix: str, pattern: str, start: int = 1) -> DataFrame:
    """Adds new_name: {index}, {index:03d}, {stem} and {suffix} filled in."""
    from .textops import _format

    f = numbered(files, [F.col(order)], "index").withColumn("index", F.col("index") + start - 1)
    name = _format(pattern, [stem, suffix], "index")
    return f.withColumn("new_name", F.concat(name, F.lit("."), F.col(suffix)) if "{suffix}" not in pattern else name)


def anchor_box(width: Column, height: Column, w: Column, h: Column, position: str, margin: int) -> tuple[Column, Column]:
    """Left and top of a mark at one of nine anchors."""
    x = F.lit(margin) if "left" in position else width - w - margin if "right" in position else F.floor((width - w) / 2)
    y = F.lit(margin) if "top" in position else height - h - margin if "bottom" in position else F.floor((height - h) / 2)
    return x, y


def photographic(stats: DataFrame) -> DataFrame:
    """Adds photographic to images with colors, dominant, entropy, white, bytes."""
    return stats.withColumn("photographic", (F.col("colors") >= 512) & (F.col("dominant") <= 0.25) & (F.col("entropy") >= 5) & (F.col("white") <= 0.55) & (F.col("bytes") >= 131072))


def histogram_stats(pixels: DataFrame, key: str, value: str) -> DataFrame:
    """colors, dominant share and entropy of each image's values, by partial aggregates."""
    h = pixels.groupBy(key, value).agg(F.count("*").alias("n"))
    t = h.groupBy(key).agg(F.sum("n").alias("t"))
    return h.join(t, key).groupBy(key).agg(F.count("*").alias("colors"), (F.max("n") / F.first("t")).alias("dominant"), F.sum(-(F.col("n") / F.col("t")) * F.log2(F.col("n") / F.col("t"))).alias("entropy"))


def best_quality(sizes: DataFrame, key: str, quality: str, size: str, target: int, least: int) -> DataFrame:
    """The highest quality whose size is under the target, else the least quality allowed."""
    s = sizes.filter(F.col(quality) >= least)
    return s.groupBy(key).agg(F.coalesce(F.max(F.when(F.col(size) <= target, F.col(quality))), F.min(quality)).alias(quality))


NEAR = 0.05  # fixed value: how far the sides of one picture's box may lie apart


def _inline_page(page: str):
    """A page's placements with their blocks. Blocks of one box and size are a kind, whose blocks go in order; kinds lie in cells of a
    grid, so that a placement looks at the kinds near it and not at all blocks. As in Spark, a null side or size tells nothing:
    the other sides decide, and an unknown difference comes first."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        kinds: dict[tuple, list] = {}
        for r in rows:
            if not r["placed"]:
                kinds.setdefault((r["x0"], r["y0"], r["x1"], r["y1"], r["w"], r["h"]), []).append(r["block"])
        heaps = {k: sorted(v, key=lambda x: (x is not None, x if x is not None else 0)) for k, v in kinds.items()}
        next_ = dict.fromkeys(heaps, 0)
        cell = lambda x: int(x // (2 * NEAR))
        grid, loose = defaultdict(list), []  # kinds by the cell of their first corner; those without one meet all
        for k in heaps:
            if k[0] is None or k[1] is None or not math.isfinite(k[0]) or not math.isfinite(k[1]):
                loose.append(k)
            else:
                grid[cell(k[0]), cell(k[1])].append(k)

        @cache
        def near(x: tuple) -> tuple:
            """(off, kinds as near in size) of a placement's box and size, the nearest first."""
            if x[0] is None or x[1] is None or not math.isfinite(x[0]) or not math.isfinite(x[1]):
                some = list(heaps)
            else:
                i, j = cell(x[0]), cell(x[1])
                some = loose + [k for di in (-1, 0, 1) for dj in (-1, 0, 1) for k in grid.get((i + di, j + dj), ())]
            by_off = defaultdict(list)
            for k in some:
                far = [abs(p - q) for p, q in zip(x[:4], k[:4]) if p is not None and q is not None]
                if far and max(far) <= NEAR:
                    by_off[None if x[4] is None or x[5] is None else abs(k[4] - x[4]) + abs(k[5] - x[5])].append(k)
            return tuple(sorted(by_off.items(), key=lambda e: (e[0] is not None, e[0] or 0)))

        taken = set()

        def first(k: tuple):
            """(whether there is a block of the kind that is free, the first such one)"""
            own, i = heaps[k], next_[k]
            while i < len(own) and own[i] in taken:
                i += 1
            next_[k] = i
            return i < len(own), own[i] if i < len(own) else None

        def choose(boxes: list[tuple]):
            by_off = defaultdict(list)
            for x in boxes:
                for off, some in near(x):
                    by_off[off] += some
            for off in sorted(by_off, key=lambda e: (e is not None, e or 0)):
                free = [b for ok, b in map(first, by_off[off]) if ok]
                if free:
                    return None if None in free else min(free)
            return None

        of_ord = defaultdict(list)
        for r in rows:
            if r["placed"]:
                of_ord[r["ord"]].append((r["x0"], r["y0"], r["x1"], r["y1"], r["w"], r["h"]))
        found = []
        for o in sorted(of_ord, key=lambda x: (x is not None, x if x is not None else 0)):
            for _ in of_ord[o]:  # rows of one place in the order share what is near to any of them
                block = None if o is None else choose(of_ord[o])
                if block is not None:
                    taken.add(block)
                found.append((o, block))
        at = table.column(page)[0].as_py() if len(rows) else None
        fields = {n: table.schema.field(n).type for n in (page, "ord", "block")}
        columns = [[at] * len(found), [x[0] for x in found], [x[1] for x in found]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], names=list(fields))

    return run


def inline_matches(placements: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    """page, ord, block: each placed image (ord, x0, y0, x1, y1, width, height), in order, with the decoded block (block and
    the same) that no earlier one took and whose box differs by 0.05 at most: one of the same size first, then the nearest
    size, then the first. A placement without one has null. A block without a size has 1 by 1. The images of a page are
    matched in one task."""
    box = ("x0", "y0", "x1", "y1")
    size = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1)))
    placed = placements.select(page, F.col("ord").alias("ord"), F.lit(None).cast(blocks.schema["block"].dataType).alias("block"), *(F.col(c).cast("double").alias(c) for c in box), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"), F.lit(True).alias("placed"))
    given = blocks.filter(F.col(page).isNotNull()).select(page, F.lit(None).cast(placements.schema["ord"].dataType).alias("ord"), "block", *(F.col(c).cast("double").alias(c) for c in box), size(F.col("width")).cast("double").alias("w"), size(F.col("height")).cast("double").alias("h"), F.lit(False).alias("placed"))
    schema = T.StructType([placements.schema[page], placements.schema["ord"], blocks.schema["block"]])
    return placed.unionByName(given).groupBy(page).applyInArrow(_inline_page(page), T.StructType([T.StructField(f.name, f.dataType) for f in schema]))


def crossfade(slides: DataFrame, order: str, fps: int, duration: float, fade: float) -> DataFrame:
    """Frames of a slideshow: frame, slide, next_slide, alpha of the next one."""
    hold, k = max(1, round(duration * fps)), max(0, round(fade * fps))
    s = numbered(slides.select(F.col(order).alias("slide")), [F.col("slide")], "__n")
    s = s.join(s.select((F.col("__n") - 1).alias("__n"), F.col("slide").alias("__next")), "__n", "left")
    f = s.withColumn("__k", F.explode(F.sequence(F.lit(0), F.when(F.col("__next").isNull(), F.lit(hold - 1)).otherwise(F.lit(hold + k - 1)))))
    blend = F.col("__k") >= hold
    return f.select(((F.col("__n") - 1) * (hold + k) + F.col("__k")).alias("frame"), "slide", F.when(blend, F.col("__next")).alias("next_slide"), F.when(blend, (F.col("__k") - hold + 1) / F.lit(k + 1)).otherwise(0.0).alias("alpha"))


Transform = Callable[[np.ndarray], np.ndarray]
PIXELS = "key string, width int, height int, channels int, data binary"


def map_pixels(images: DataFrame, transform: Transform) -> DataFrame:
    """PIXELS of each image after a transform of its (height, width, channels) array. An image that fails has null data."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                try:
                    x = transform(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels))
                    rows.append((r.key, x.shape[1], x.shape[0], x.shape[2], np.ascontiguousarray(x, np.uint8).tobytes()))
                except Exception:
                    rows.append((r.key, r.width, r.height, r.channels, None))
            yield pd.DataFrame(rows, columns=["key", "width", "height", "channels", "data"])

    return images.select("key", "width", "height", "channels", "data").mapInPandas(run, PIXELS)


def crop(left: int, top: int, right: int, bottom: int) -> Transform:
    def run(x: np.ndarray) -> np.ndarray:
        if not (0 <= left < right <= x.shape[1] and 0 <= top < bottom <= x.shape[0]):
            raise ValueError("the box is outside the image")
        return x[top:bottom, left:right]

    return run


def rotate(angle: float, background: int = 255) -> Transform:
    """Counterclockwise; multiples of 90 exactly, others on a canvas that holds all. Each pixel of the canvas is turned back into the
    picture as a unit square that keeps its upright position, and takes each pixel there by the area of it that the square covers;
    what lies beyond the border is background."""

    def run(x: np.ndarray) -> np.ndarray:
        if angle % 90 == 0:
            return np.rot90(x, int(angle // 90) % 4)
        t = np.deg2rad(angle)
        h, w = x.shape[:2]
        c, s = np.cos(t), np.sin(t)
        nw, nh = int(np.ceil(abs(w * c) + abs(h * s) - 1e-9)), int(np.ceil(abs(w * s) + abs(h * c) - 1e-9))
        yy, xx = np.mgrid[0:nh, 0:nw]
        u, v = xx - (nw - 1) / 2, yy - (nh - 1) / 2
        sx, sy = u * c - v * s + (w - 1) / 2, u * s + v * c + (h - 1) / 2
        framed = np.full((h + 2, w + 2, x.shape[2]), float(background))
        framed[1:-1, 1:-1] = x
        x0, y0 = np.floor(sx), np.floor(sy)
        fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
        at = lambda dy, dx: framed[np.clip(y0 + dy + 1, 0, h + 1).astype(int), np.clip(x0 + dx + 1, 0, w + 1).astype(int)]
        out = at(0, 0) * (1 - fx) * (1 - fy) + at(0, 1) * fx * (1 - fy) + at(1, 0) * (1 - fx) * fy + at(1, 1) * fx * fy
        return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)

    return run


def flip(direction: str) -> Transform:
    return (lambda x: x[:, ::-1]) if direction == "horizontal" else (lambda x: x[::-1])


def grayscale(x: np.ndarray) -> np.ndarray:
    """Luma of red, green, blue with weights 299, 587, 114 of 1000."""
    g = (x[..., 0].astype(np.int64) * 299 + x[..., 1].astype(np.int64) * 587 + x[..., 2].astype(np.int64) * 114) // 1000
    return np.repeat(g[..., None], 3, axis=2).astype(np.uint8)


def black_white(intensity: float = 1.0) -> Transform:
    return lambda x: np.where(grayscale(x) >= min(255, int(128 * intensity)), 255, 0).astype(np.uint8)


def sepia(x: np.ndarray) -> np.ndarray:
    m = np.array([[0.393, 0.769, 0.189], [0.349, 0.686, 0.168], [0.272, 0.534, 0.131]])  # fixed values
    return np.clip(x[..., :3].astype(float) @ m.T, 0, 255).astype(np.uint8)


def convolve(kernel: Sequence[Sequence[float]], scale: float, offset: float = 0) -> Transform:
    """A 3 x 3 filter; the outermost pixels stay."""
    k = np.array(kernel, float)

    def run(x: np.ndarray) -> np.ndarray:
        out = x.copy()
        if min(x.shape[:2]) < 3:
            return out
        acc = sum(k[i, j] * x[i : x.shape[0] - 2 + i, j : x.shape[1] - 2 + j].astype(float) for i in range(3) for j in range(3))
        out[1:-1, 1:-1] = np.clip(np.floor(acc / scale + offset + 0.5), 0, 255).astype(np.uint8)
        return out

    return run


FILTERS: dict[str, Transform] = {
    "grayscale": grayscale,
    "black_white": black_white(),
    "sepia": sepia,
    "gaussian_blur": convolve([[1, 2, 1], [2, 4, 2], [1, 2, 1]], 16),
    "sharpen": convolve([[-2, -2, -2], [-2, 32, -2], [-2, -2, -2]], 16),
    "emboss": convolve([[-1, 0, 0], [0, 1, 0], [0, 0, 0]], 1, 128),
    "find_edges": convolve([[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]], 1),
    "smooth": convolve([[1, 1, 1], [1, 5, 1], [1, 1, 1]], 13),
}


def adjust(brightness: float = 1, contrast: float = 1, saturation: float = 1) -> Transform:
    """Brightness, then contrast about the mean luma, then saturation about the pixel's luma."""

    def run(x: np.ndarray) -> np.ndarray:
        y = np.clip(x.astype(float) * brightness, 0, 255).astype(np.uint8)
        mean = int(grayscale(y)[..., 0].mean() + 0.5)
        y = np.clip(mean + (y.astype(float) - mean) * contrast, 0, 255).astype(np.uint8)
        g = grayscale(y).astype(float)
        return np.clip(g + (y.astype(float) - g) * saturation, 0, 255).astype(np.uint8)

    return run


def border(widths: tuple[int, int, int, int], rgb: tuple[int, int, int]) -> Transform:
    """left, top, right, bottom."""
    l, t, r, b = widths

    def run(x: np.ndarray) -> np.ndarray:
        out = np.empty((x.shape[0] + t + b, x.shape[1] + l + r, x.shape[2]), np.uint8)
        out[:] = np.array(rgb[: x.shape[2]], np.uint8)
        out[t : t + x.shape[0], l : l + x.shape[1]] = x
        return out

    return run


def mosaic(block: int, box: tuple[int, int, int, int] | None = None) -> Transform:
    """Means of blocks inside a clipped box, the whole image by default."""

    def run(x: np.ndarray) -> np.ndarray:
        l, t, r, b = box or (0, 0, x.shape[1], x.shape[0])
        l, t, r, b = max(0, l), max(0, t), min(x.shape[1], r), min(x.shape[0], b)
        out = x.copy()
        for i in range(t, b, block):
            for j in range(l, r, block):
                part = x[i : min(i + block, b), j : min(j + block, r)]
                out[i : min(i + block, b), j : min(j + block, r)] = np.floor(part.reshape(-1, x.shape[2]).mean(axis=0) + 0.5)
        return out

    return run


#: Resampling kernels by name: how far each reaches, and its weight at a distance.
KERNELS: dict[str, tuple[float, Callable[[np.ndarray], np.ndarray]]] = {
    "box": (0.5, lambda d: ((d >= -0.5) & (d < 0.5)).astype(float)),
    "linear": (1.0, lambda d: np.maximum(0.0, 1.0 - np.abs(d))),
    "cubic": (2.0, lambda d: np.where(np.abs(d) < 1, 1.5 * np.abs(d) ** 3 - 2.5 * d * d + 1, np.where(np.abs(d) < 2, -0.5 * np.abs(d) ** 3 + 2.5 * d * d - 4 * np.abs(d) + 2, 0.0))),
    "lanczos": (3.0, lambda d: np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0)),
}


def kernel_weights(size: int, to: int, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """For each of `to` pixels along a side the pixels of the old side that it is made of, and their weights, which sum to 1.
    Downwards the kernel is stretched, so that each old pixel counts; beyond the border there is nothing."""
    reach, weight = KERNELS[kernel]
    scale = size / to
    stretch = max(1.0, scale)
    middle = (np.arange(to) + 0.5) * scale
    first = np.floor(middle - reach * stretch).astype(int)
    taps = first[:, None] + np.arange(int(np.ceil(2 * reach * stretch)) + 2)
    w = np.where((taps >= 0) & (taps < size), weight((taps + 0.5 - middle[:, None]) / stretch), 0.0)
    return np.clip(taps, 0, size - 1), w / w.sum(1, keepdims=True)


def resampled(x: np.ndarray, width: int, height: int, kernel: str = "lanczos") -> np.ndarray:
    """A picture of another size, columns first and then rows, a tap of all pixels at a time; rounded half up."""
    out = x.astype(float)
    for axis, to in ((1, width), (0, height)):
        if out.shape[axis] != to:
            taps, w = kernel_weights(out.shape[axis], to, kernel)
            shape = (-1, 1, 1) if axis == 0 else (1, -1, 1)
            out = sum(np.take(out, taps[:, k], axis) * w[:, k].reshape(shape) for k in range(taps.shape[1]))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def resize(width: int, height: int, keep_aspect: bool = True, kernel: str = "lanczos") -> Transform:
    """Into width and height, as it is or within them, by one of KERNELS."""

    def run(x: np.ndarray) -> np.ndarray:
        h, w = x.shape[:2]
        s = min(width / w, height / h)
        nw, nh = (max(1, round(w * s)), max(1, round(h * s))) if keep_aspect else (width, height)
        return resampled(x, nw, nh, kernel)

    return run


def overlay(mark: np.ndarray, position: str, opacity: float = 1.0, margin: int = 0) -> Transform:
    """A mark blended at one of nine anchors."""

    def run(x: np.ndarray) -> np.ndarray:
        h, w = mark.shape[:2]
        left = margin if "left" in position else x.shape[1] - w - margin if "right" in position else (x.shape[1] - w) // 2
        top = margin if "top" in position else x.shape[0] - h - margin if "bottom" in position else (x.shape[0] - h) // 2
        l, t, r, b = max(0, left), max(0, top), min(x.shape[1], left + w), min(x.shape[0], top + h)
        out = x.copy()
        if l < r and t < b:
            part = mark[t - top : b - top, l - left : r - left].astype(float)
            out[t:b, l:r] = np.floor(x[t:b, l:r] * (1 - opacity) + part * opacity + 0.5)
        return out

    return run


def perceptual_bits(gray: np.ndarray) -> int:
    """64 bits of the low 8 x 8 coefficients of a cosine transform of a 32 x 32 image, above the median without the first."""
    n = 32
    i = np.arange(n)
    c = np.cos(np.pi * (2 * i[None, :] + 1) * i[:, None] / (2 * n)) * np.where(i == 0, np.sqrt(1 / n), np.sqrt(2 / n))[:, None]
    low = (c @ gray.astype(float) @ c.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    return int(sum(1 << (63 - k) for k in range(64) if bits[k]))
