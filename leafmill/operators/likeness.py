"""Pairs of pictures as counts and sums over their pixels, and rules over these.

A pair becomes one row of whole numbers, taken for many pairs of one size at once; shares, means and the correlation are columns
made of them. A rule states bounds of measures, and what it says of a pair is a column, too."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pixels of pairs that are measured at once, about.
TOGETHER = 1 << 21
SUMS = ("pixels", "sum_a", "sum_b", "squares_a", "squares_b", "products", "off", "off_13", "off_18")
Rule = Mapping[str, tuple[float | None, float | None]]


def around(masks: np.ndarray, reach: int = 1) -> np.ndarray:
    """Masks (one to a row of the first axis) with all pixels within `reach` of theirs."""
    wide = np.pad(masks, ((0, 0), (reach, reach), (reach, reach)))
    windows = np.lib.stride_tricks.sliding_window_view(wide, (2 * reach + 1, 2 * reach + 1), axis=(1, 2))
    return windows.any(axis=(3, 4))


def sums(a: np.ndarray, b: np.ndarray, where: np.ndarray) -> dict[str, np.ndarray]:
    """SUMS over the pixels of each pair that `where` has."""
    a, b, w = a.astype(np.int64), b.astype(np.int64), where.astype(np.int64)
    over = lambda x: (x * w).sum((1, 2))
    off = np.abs(a - b)
    return dict(zip(SUMS, (over(np.ones_like(a)), over(a), over(b), over(a * a), over(b * b), over(a * b), over(off), over(off >= 13), over(off >= 18))))


def measured(pairs: DataFrame, images: Sequence[str], measures: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], names: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Adds `m`, a struct of the named whole numbers, to pairs with width, height and images, a byte for each pixel. Null where
    an image is null (but for optional ones, then blank) or not of its size, or a size is null or not positive."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*(f for f in pairs.schema if f.name not in {"m", *images, *optional}), T.StructField("m", T.StructType([T.StructField(n, T.LongType()) for n in names]))])
    arrow = to_arrow_schema(schema)

    def fits(row: dict, area: int) -> bool:
        return all(row[i] is not None and len(row[i]) == area for i in images) and all(row[i] is None or len(row[i]) == area for i in optional)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict | None] = [None] * len(batch)
            of_size = defaultdict(list)
            rows = batch.select(["width", "height", *images, *optional]).to_pylist()
            for i, r in enumerate(rows):
                if r["width"] and r["height"] and r["width"] > 0 and r["height"] > 0 and fits(r, r["width"] * r["height"]):
                    of_size[r["height"], r["width"]].append(i)
            for (h, w), places in of_size.items():
                step = max(1, TOGETHER // (h * w))
                for k in range(0, len(places), step):
                    some = places[k : k + step]
                    stack = lambda name: np.frombuffer(b"".join(rows[i][name] if rows[i][name] is not None else bytes(h * w) for i in some), np.uint8).reshape(len(some), h, w)
                    got = measures({name: stack(name) for name in (*images, *optional)})
                    for j, i in enumerate(some):
                        found[i] = {n: int(got[n][j]) for n in names}
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in arrow if f.name != "m"), pa.array(found, arrow.field("m").type)], schema=arrow)

    return pairs.drop("m").mapInArrow(run, schema)


def share(part: str, whole: str) -> Column:
    """A count over another one, 0 where that is none."""
    return F.coalesce(F.try_divide(F.col(f"m.{part}"), F.col(f"m.{whole}")), F.lit(0.0))


def mean_off() -> Column:
    return F.col("m.off") / F.col("m.pixels") / 255


def correlation(flat: float) -> Column:
    """Of the two pictures' grey levels, from their sums; `flat` where one has no contrast."""
    n, a, b = F.col("m.pixels"), F.col("m.sum_a"), F.col("m.sum_b")
    spread = lambda q, s: (n * F.col(f"m.{q}") - s * s).cast("double")
    both = F.sqrt(spread("squares_a", a) * spread("squares_b", b))
    return F.when(both > 0, (n * F.col("m.products") - a * b) / both).otherwise(flat)


def holds(rule: Rule, measures: Mapping[str, Column]) -> Column:
    """Whether all measures that a rule names lie within its bounds."""
    said = F.lit(True)
    for name, (least, most) in rule.items():
        if least is not None:
            said &= measures[name] >= least
        if most is not None:
            said &= measures[name] <= most
    return said


def any_holds(rules: Sequence[Rule], measures: Mapping[str, Column]) -> Column:
    said = F.lit(False)
    for rule in rules:
        said |= holds(rule, measures)
    return said
