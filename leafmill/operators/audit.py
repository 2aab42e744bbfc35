"""Enhanced pictures held against their sources, tile by tile: where an enhancement lost or invented structure, the source's pixels
come back, blended in softly; where the picture as a whole is another one, all of it does.

All sums of all tiles come from one summed-area table each: a tile's sum is four reads, whatever its size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .candidates import edges, grey
from .likeness import around

TILE = 256
# Fixed values, for documents and for photographs: of a whole picture, least correlation, greatest mean difference, least share of
# edges kept, and bounds of the edges' number; of a tile, least share kept and greatest number.
WHOLE = {False: {"alike": 0.955, "off": 11.5, "kept": 0.89, "fewest": 0.68, "most": 2.15}, True: {"alike": 0.955, "off": 14.5, "kept": 0.84, "fewest": 0.68, "most": 2.7}}
TILES = {False: {"kept": 0.80, "most": 2.55}, True: {"kept": 0.73, "most": 3.2}}
# A tile's mean difference and correlation that are bad together.
BAD = {"off": 16.0, "alike": 0.94}
# A photograph whose weak edges went is right if this holds for its strong ones, as a whole and in a tile.
STRONG = {"alike": 0.985, "off": 8.5, "kept": 0.86, "fewest": 0.65, "most": 1.45}
STRONG_TILE = {"alike": 0.92, "kept": 0.78, "fewest": 0.50, "most": 1.75}
#: A strong edge has this slope; the width of the blend is this share of a tile.
STRONG_EDGE, SOFT = 340, 0.045
MEASURES = ("alike", "off", "kept", "ratio", "strong_kept", "strong_ratio")
AUDITED = "pixels binary, passed boolean, tiles int, risky int, " + ", ".join(f"{m} double" for m in MEASURES)


def table(x: np.ndarray) -> np.ndarray:
    """The summed-area table: at (y, x) the sum of all above and to the left."""
    out = np.zeros((x.shape[0] + 1, x.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(x, 0, dtype=np.int64), 1, out=out[1:, 1:])
    return out


def tile_sums(t: np.ndarray, tile: int) -> np.ndarray:
    h, w = t.shape[0] - 1, t.shape[1] - 1
    y, x = np.append(np.arange(0, h, tile), h), np.append(np.arange(0, w, tile), w)
    at = t[np.ix_(y, x)]
    return at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]


def measures(a: np.ndarray, b: np.ndarray, tile: int) -> dict[str, np.ndarray]:
    """MEASURES of each tile of two grey pictures: correlation (1 without contrast in both, 0 in one), mean difference, and of weak
    and strong edges the share kept, give or take a pixel (1 where there are none), and the number against the source's (1 where
    neither has any, and the number where the source has none)."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    add = lambda x: tile_sums(table(x), tile).astype(np.float64)
    n, sa, sb, saa, sbb, sab = (add(x) for x in (np.ones_like(a), a, b, a * a, b * b, a * b))
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    both = np.sqrt(va * vb)
    out = {"alike": np.where(both > 0, (n * sab - sa * sb) / np.where(both > 0, both, 1), np.where((va == 0) & (vb == 0), 1.0, 0.0)), "off": add(np.abs(a - b)) / n}
    for name, least in (("", None), ("strong_", STRONG_EDGE)):
        ea, eb = (edges(x[None], *([least] if least else []))[0] for x in (a, b))
        had, has, kept = add(ea), add(eb), add(ea & around(eb[None])[0])
        out[f"{name}kept"] = np.where(had > 0, kept / np.maximum(had, 1), 1.0)
        out[f"{name}ratio"] = np.where(had > 0, has / np.maximum(had, 1), np.where(has > 0, has, 1.0))
    return out


def passes(m: dict[str, float], photo: bool) -> bool:
    """Whether a whole picture is still its source."""
    r = WHOLE[photo]
    ordinary = m["kept"] >= r["kept"] and r["fewest"] <= m["ratio"] <= r["most"]
    quieter = photo and m["alike"] >= STRONG["alike"] and m["off"] <= STRONG["off"] and m["strong_kept"] >= STRONG["kept"] and STRONG["fewest"] <= m["strong_ratio"] <= STRONG["most"]
    return bool(m["alike"] >= r["alike"] and m["off"] <= r["off"] and (ordinary or quieter))


def risky(m: dict[str, np.ndarray], photo: bool) -> np.ndarray:
    """Which tiles lost or invented structure."""
    r = TILES[photo]
    fine = (m["kept"] >= r["kept"]) & (m["ratio"] <= r["most"])
    if photo:
        s = STRONG_TILE
        fine |= (m["alike"] >= s["alike"]) & (m["strong_kept"] >= s["kept"]) & (m["strong_ratio"] >= s["fewest"]) & (m["strong_ratio"] <= s["most"])
    return ((m["off"] > BAD["off"]) & (m["alike"] < BAD["alike"])) | ~fine


def softened(mask: np.ndarray, sigma: float) -> np.ndarray:
    """A mask blurred by a Gauss kernel of three sigmas on each side, rows and columns apart, borders repeated."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = mask.astype(np.float64)
    for axis in (0, 1):
        p = np.pad(out, [(reach, reach) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        size = out.shape[axis]
        out = sum(k * np.take(p, range(i, i + size), axis) for i, k in enumerate(kernel))
    return out


def audit(source: np.ndarray, output: np.ndarray, photo: bool, tile: int = TILE) -> tuple:
    """AUDITED of two (height, width, channels) pictures."""
    one, two = (grey(x[..., 0], x[..., 1], x[..., 2]) if x.shape[2] >= 3 else x[..., 0].astype(np.int64) for x in (source, output))
    h, w = one.shape
    whole = {k: float(v[0, 0]) for k, v in measures(one, two, max(h, w)).items()}
    whole["off"] = float(np.abs(source.astype(np.int64) - output.astype(np.int64)).mean())
    told = [whole[k] for k in MEASURES]
    if not passes(whole, photo):
        return source.tobytes(), False, 1, 1, *told
    bad = risky(measures(one, two, tile), photo)
    if bad.any():
        mask = np.repeat(np.repeat(bad, tile, 0), tile, 1)[:h, :w]
        weight = softened(mask, max(1.0, tile * SOFT))[..., None]
        output = np.clip(output * (1.0 - weight) + source * weight, 0, 255).astype(np.uint8)
    return output.tobytes(), True, bad.size, int(bad.sum()), *told


def audited(pairs: DataFrame, tile: int = TILE) -> DataFrame:
    """key and AUDITED: the pixels to keep of each enhanced picture, whether it passed as a whole, and how many tiles went back.

    pairs has key, width, height, channels, photo (null: no), source and output, of one size. Everything is null where a picture
    is null or not of its size, or a size isn't positive."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([pairs.schema["key"], *T.StructType.fromDDL(AUDITED).fields])
    arrow = to_arrow_schema(schema)
    size = F.col("width") * F.col("height") * F.col("channels")
    fits = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.col("channels") > 0) & (F.length("source") == size) & (F.length("output") == size), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # a picture at a time: some are large
                r = batch.slice(i, 1).to_pylist()[0]
                got = (None,) * (len(arrow) - 1)
                if r["fits"]:
                    shape = r["height"], r["width"], r["channels"]
                    got = audit(*(np.frombuffer(r[c], np.uint8).reshape(shape) for c in ("source", "output")), bool(r["photo"]), tile)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, 1), *(pa.array([v], f.type) for v, f in zip(got, list(arrow)[1:]))], schema=arrow)

    return pairs.select("key", "width", "height", "channels", "photo", "source", "output", fits.alias("fits")).mapInArrow(run, schema)
