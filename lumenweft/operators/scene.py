"""Scene changes from colour histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import lag, running_sum

BINS, THRESHOLD = 64, 0.15


def histogram(pixels: DataFrame, key: list[str] = ["frame_id"]) -> DataFrame:  # noqa: B006
    """Key, channel, bin, n from r, g, b in 0..255; bin = v * 64 >> 8."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.shiftright(F.col(c) * BINS, 8).cast("int").alias("bin")) for i, c in enumerate("rgb")]))
    return pixels.select(*key, each.alias("e")).groupBy(*key, F.col("e.channel").alias("channel"), F.col("e.bin").alias("bin")).agg(F.count("*").alias("n"))


def histogram_arrays(pixels: DataFrame, key: list[str] = ["frame_id"]) -> DataFrame:  # noqa: B006
    """One row per frame: hist (3 * 64 counts) and the number of pixels."""
    counts = histogram(pixels, key)
    cell = F.map_from_entries(F.collect_list(F.struct((F.col("channel") * BINS + F.col("bin")).alias("k"), F.col("n").alias("v"))))
    filled = F.transform(F.sequence(F.lit(0), F.lit(3 * BINS - 1)), lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0).cast("long")))
    grouped = counts.groupBy(*key).agg(cell.alias("m"), (F.sum("n") / 3).cast("long").alias("pixels"))
    return grouped.select(*key, filled.alias("hist"), "pixels")


def distance(a, b, pixels):
    """The L1 distance of two histograms over 6 n; 0 without pixels."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, d: s + d)
    return F.when(pixels > 0, total / (6.0 * pixels)).otherwise(F.lit(0.0))


def scene_distances(pixels: DataFrame, clip: list[str] | None = None) -> DataFrame:
    """frame_id and its distance from the frame before, per clip."""
    clip = clip or []
    frames = histogram_arrays(pixels, [*clip, "frame_id"])
    pairs = lag(frames, "hist", clip, "frame_id", "before").where(F.col("before").isNotNull())
    return pairs.select(*clip, "frame_id", distance(F.col("before"), F.col("hist"), F.col("pixels")).alias("distance"))


def scene_cuts(pixels: DataFrame, threshold: float = THRESHOLD, clip: list[str] | None = None) -> DataFrame:
    """frames farther than the threshold from the one before."""
    return scene_distances(pixels, clip).where(F.col("distance") > threshold)


def scene_segments(pixels: DataFrame, threshold: float = THRESHOLD, clip: list[str] | None = None) -> DataFrame:
    """Segment numbers from 0, with their first and last frames."""
    clip = clip or []
    frames = histogram_arrays(pixels, [*clip, "frame_id"])
    moved = lag(frames, "hist", clip, "frame_id", "before")
    far = F.when(F.col("before").isNotNull(), distance(F.col("before"), F.col("hist"), F.col("pixels"))).otherwise(F.lit(0.0))
    cuts = moved.select(*clip, "frame_id", (far > threshold).cast("long").alias("cut"))
    numbered = running_sum(cuts, "cut", clip, "frame_id", "segment")
    return numbered.groupBy(*clip, "segment").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count("*").alias("frames"))
