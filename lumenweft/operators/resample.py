"""Separable bilinear and nearest resampling of pixel relations.

The taps of one axis are a small literal array: for a source coordinate the
(destination, weight) pairs that read it.  A source pixel is sent to its at
most few destinations and the weighted values are summed by destination; there
is no join, so nothing is broadcast, and partial sums combine before the one
shuffle.  The two conventions differ and must not be mixed:

  half-pixel      source = max((d + 1/2) in / out - 1/2, 0)
  corner-aligned  source = d (in - 1) / max(out - 1, 1)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_PIXEL, CORNERS, NEAREST = "half-pixel", "corner-aligned", "nearest"


def taps(source: int, target: int, convention: str = HALF_PIXEL) -> list[list[tuple[int, float]]]:
    """For each source index the (target index, weight) pairs that use it; weights of a target sum to 1."""
    out: list[list[tuple[int, float]]] = [[] for _ in range(source)]
    for d in range(target):
        if convention == NEAREST:
            out[min(source - 1, d * source // target)].append((d, 1.0))
            continue
        at = max((d + 0.5) * source / target - 0.5, 0.0) if convention == HALF_PIXEL else d * (source - 1) / max(target - 1, 1)
        low = min(int(at), source - 1)
        high, part = min(low + 1, source - 1), at - min(int(at), source - 1)
        for i, w in ((low, 1.0 - part), (high, part)):
            if w > 0:
                out[i].append((d, w))
    return out


def _literal(axis: list[list[tuple[int, float]]]) -> Column:
    empty = F.array().cast("array<struct<d:int,w:double>>")
    cell = lambda pairs: F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in pairs]) if pairs else empty
    return F.array(*map(cell, axis))


def resize(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int], values: list[str], *, convention: str = HALF_PIXEL, key: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Resample the columns ``values`` of (key, y, x) rows from (width, height) ``source`` to ``target``."""
    if source == target:
        return pixels.select(*key, "y", "x", *values)
    xs, ys = (_literal(taps(s, t, convention)) for s, t in zip(source, target, strict=True))
    spread = pixels.select(*key, F.element_at(ys, F.col("y").cast("int") + 1).alias("ty"), F.element_at(xs, F.col("x").cast("int") + 1).alias("tx"), *values)
    spread = spread.withColumn("ty", F.explode("ty")).withColumn("tx", F.explode("tx"))
    weight = F.col("ty.w") * F.col("tx.w")
    return spread.groupBy(*key, F.col("ty.d").alias("y"), F.col("tx.d").alias("x")).agg(*[F.sum(F.col(v) * weight).alias(v) for v in values])


def resize_rgb8(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Corner-aligned, rounded and clamped to 0..255."""
    out = resize(pixels, source, target, ["r", "g", "b"], convention=CORNERS)
    return out.withColumns({c: F.least(F.greatest(F.round(F.round(c, 9)), F.lit(0.0)), F.lit(255.0)).cast("int") for c in "rgb"})


def upscale_depth(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Corner-aligned, not rounded."""
    return resize(pixels, source, target, ["depth"], convention=CORNERS)


def resize_nearest(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int], values: list[str]) -> DataFrame:
    """R04."""
    return resize(pixels, source, target, values, convention=NEAREST)
