"""Frame diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import gray


def minmax_u8(df: DataFrame, value: str, key: list[str], *, eps: float = 0.0, out: str = "u8") -> DataFrame:
    """A frame's values spread over 0..255, truncated.  The range of a frame is an aggregate that combines before its shuffle; no frame is sorted."""
    low, span = F.col("__low"), F.col("__high") - F.col("__low") + F.lit(eps)
    ranged = df.join(df.groupBy(*key).agg(F.min(value).alias("__low"), F.max(value).alias("__high")), key)
    return ranged.withColumn(out, F.when(span == 0, F.lit(0)).otherwise(F.floor((F.col(value) - low) / F.nullif(span, F.lit(0.0)) * 255.0)).cast("int")).select(*df.columns, out)


def abs_diff(a: DataFrame, b: DataFrame, key: list[str], channels: str = "rgb", gain: int = 5) -> DataFrame:
    """Amplified absolute difference of 8-bit channels, at most 255."""
    right = b.select(*key, *[F.col(c).alias(f"__{c}") for c in channels])
    both = a.join(right, key)
    return both.select(*key, *[F.least(F.abs(F.col(c) - F.col(f"__{c}")) * gain, F.lit(255)).cast("int").alias(c) for c in channels])


def channel_diff(a: DataFrame, b: DataFrame, key: list[str], gain: int = 5) -> DataFrame:
    """The same in long form, one row per channel."""
    diff = abs_diff(a, b, key, gain=gain)
    return diff.unpivot(key, ["r", "g", "b"], "channel", "diff")


def channel_stats(pixels: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Range, mean, population deviation and distinct values of each channel."""
    key = key or []
    long = pixels.unpivot(key, ["r", "g", "b"], "channel", "v")
    return long.groupBy(*key, "channel").agg(
        F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v"), F.count_distinct("v").alias("n_distinct")
    )


def block_variance(pixels: DataFrame, size: tuple[int, int], value=None, block: int = 8) -> DataFrame:
    """A10: population variance of each whole block of a frame; trailing rows and columns are left out."""
    w, h = size
    v = gray(F.col("r"), F.col("g"), F.col("b")) if value is None else value
    whole = pixels.where((F.col("x") < w // block * block) & (F.col("y") < h // block * block))
    by, bx = (F.floor(F.col(c) / block).cast("int").alias(f"b{c}") for c in "yx")
    return whole.groupBy("frame_id", by, bx).agg(F.var_pop(v).alias("variance"))


def flat_blocks(blocks: DataFrame, below: float = 1.0) -> DataFrame:
    """F16: share of blocks with a variance below 1, and the range of variances, by frame."""
    return blocks.groupBy("frame_id").agg(
        (F.avg((F.col("variance") < below).cast("double")) * 100.0).alias("flat_pct"), F.avg("variance").alias("mean_var"),
        F.min("variance").alias("min_var"), F.max("variance").alias("max_var"),
    )


def zone_bounds(depth: DataFrame, zones: int, key: list[str], value: str = "depth") -> DataFrame:
    """Zones + 1 exact quantiles with linear interpolation."""
    return depth.groupBy(*key).agg(F.percentile(value, [i / zones for i in range(zones + 1)]).alias("bounds"))


def zone_of(depth, bounds, zones: int, *, closed: bool = True):
    """the last zone z with bounds[z] <= d; the last zone takes its upper bound too where ``closed`` (A09: not)."""
    inside = lambda z: (depth >= bounds[z]) & ((depth < bounds[z + 1]) | (F.lit(closed and z == zones - 1) & (depth <= bounds[z + 1])))
    out = F.lit(None).cast("int")
    for z in range(zones):
        out = F.when(inside(z), z).otherwise(out)
    return out


def with_zones(depth: DataFrame, zones: int, key: list[str], value: str = "depth", *, closed: bool = True) -> DataFrame:
    """Every depth with its frame's zone."""
    joined = depth.join(zone_bounds(depth, zones, key, value), key)
    return joined.withColumn("zone", zone_of(F.col(value), F.col("bounds"), zones, closed=closed)).drop("bounds")


def zone_histogram(depth: DataFrame, zones: int, key: list[str], value: str = "depth") -> DataFrame:
    """Counts, shares and bars by zone; the greatest depth belongs to none (the upper bound is open here)."""
    marked = with_zones(depth, zones, key, value, closed=False)
    total = F.sum("n_all").over(Window.partitionBy(*key))
    counts = marked.groupBy(*key, "zone").agg(F.count("*").alias("n_all")).withColumn("total", total)
    pct = F.col("n_all") * 100.0 / F.col("total")
    return counts.where("zone IS NOT NULL").select(*key, "zone", F.col("n_all").alias("n"), pct.alias("pct"), F.repeat(F.lit("#"), F.floor(pct / 2).cast("int")).alias("bar"))


def accuracy(a: DataFrame, b: DataFrame, key: list[str], value: str, by: list[str]) -> DataFrame:
    """By group, greatest and 99th percentile difference, mean square error and PSNR over a range of 2.

    The percentile is the sorted difference at index floor(0.99 n); a group is a frame's worth of pixels.
    """
    both = a.select(*key, F.col(value).alias("__a")).join(b.select(*key, F.col(value).alias("__b")), key)
    d = F.abs(F.col("__a") - F.col("__b"))
    out = both.withColumn("__d", d).groupBy(*by).agg(F.max("__d").alias("max_diff"), F.sort_array(F.collect_list("__d")).alias("__s"), F.avg(F.col("__d") * F.col("__d")).alias("mse"))
    p99 = F.element_at("__s", F.least(F.floor(F.size("__s") * 0.99), F.size("__s") - 1).cast("int") + 1)
    return out.select(*by, "max_diff", p99.alias("p99"), "mse", (10.0 * F.log10(4.0 / F.greatest("mse", F.lit(1e-10)))).alias("psnr"))


def unlike_pixels(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that one of two relations holds more often: key, side (a or b) and how many times more."""
    counted = a.select(*key, F.lit(1).alias("__n")).unionByName(b.select(*key, F.lit(-1).alias("__n"))).groupBy(*key).agg(F.sum("__n").alias("__n"))
    return counted.where("__n <> 0").select(*key, F.when(F.col("__n") > 0, "a").otherwise("b").alias("side"), F.abs("__n").alias("n"))


def check_same_pixels(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """one row that says so, or an error, where two relations do not hold the same keys."""
    n = unlike_pixels(a, b, key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return n.select(F.when(F.col("n") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("frames differ in "), F.col("n").cast("string"), F.lit(" pixels"))).cast("boolean")).alias("same"))
