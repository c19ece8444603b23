"""The historical depth-zoned grading (H01-H06, J06, J07, X23-X26, X29): documented, no longer part of the live path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color

# Hue centres and widths of the six qualifiers, in degrees.
CENTRES = (0.0, 40.0, 100.0, 170.0, 210.0, 290.0)
WIDTHS = (40.0, 40.0, 50.0, 40.0, 40.0, 50.0)
ACTIVE_FROM, GRAY_BELOW = 100.0, 0.08


@dataclass(frozen=True)
class Qualifier:
    h_offset: float = 0.0
    s_ratio: float = 1.0
    v_offset: float = 0.0
    weight: float = 0.0


@dataclass(frozen=True)
class GradeParams:
    """Explicit, since the documents give no defaults."""

    warmth: float
    strength: float
    contrast: float


def lattice(spark, size: int, zones: int = 1) -> DataFrame:
    """Zone, ri, gi, bi of every point, from a flat index."""
    i, n = F.col("id"), F.lit(size)
    part = lambda by: F.floor(i / by) % n
    return spark.range(zones * size**3).select(
        F.floor(i / size**3).cast("int").alias("zone"), part(size * size).cast("int").alias("ri"), part(size).cast("int").alias("gi"), (i % n).cast("int").alias("bi")
    )


def corners(size: int, rgb: tuple[str, str, str] = ("r", "g", "b")) -> Column:
    """The eight lattice points about a colour and their trilinear weights."""
    sides = []
    for c, name in zip(rgb, ("ri", "gi", "bi"), strict=True):
        at = F.col(c) * F.lit(float(size - 1))
        low = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(size - 2)).cast("int")
        part = color.clamp(at - low)
        sides.append([(name, low, F.lit(1.0) - part), (name, low + 1, part)])
    points = []
    for r in sides[0]:
        for g in sides[1]:
            for b in sides[2]:
                points.append(F.struct(r[1].alias("ri"), g[1].alias("gi"), b[1].alias("bi"), (r[2] * g[2] * b[2]).alias("w")))
    return F.array(*points)


#: Lattice points that are looked up in one broadcast row of arrays; a larger table is joined.
LOOKUP_POINTS = 1 << 18


def lookup_row(lut: DataFrame, size: int, zones: int = 1) -> DataFrame:
    """One row: the values of every lattice point as three arrays in the order of :func:`lattice`; an error where points are missing."""
    place = (F.col("ri") * size + F.col("gi")) * size + F.col("bi")
    place = F.col("zone") * size**3 + place if "zone" in lut.columns else place
    points = lut.agg(F.sort_array(F.collect_list(F.struct(place.alias("at"), "lr", "lg", "lb"))).alias("p"))
    whole = F.when((F.size("p") == zones * size**3) & (F.element_at("p", -1)["at"] == zones * size**3 - 1), F.col("p")).otherwise(F.raise_error(F.lit("a lattice point is missing")))
    return points.select(whole.alias("p")).select(*[F.col(f"p.l{c}").alias(f"__t{c}") for c in "rgb"])


def _placed(pixels: DataFrame, size: int) -> DataFrame:
    """The lower lattice index and the part beyond it, of each channel."""
    staged = {}
    for c in "rgb":
        at = F.col(c) * F.lit(float(size - 1))
        staged[f"__i{c}"] = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(size - 2)).cast("int")
    placed = pixels.withColumns(staged)
    return placed.withColumns({f"__f{c}": color.clamp(F.col(c) * F.lit(float(size - 1)) - F.col(f"__i{c}")) for c in "rgb"})


def _trilinear(channel: str, size: int, zone: int) -> Column:
    """Seven mixes of the eight points about a placed colour."""
    first = (F.col("__ir") * size + F.col("__ig")) * size + F.col("__ib") + zone * size**3 + 1
    mix = lambda low, high, part: low * (F.lit(1.0) - F.col(part)) + high * F.col(part)  # noqa: E731  each point once
    edge = lambda r, g: mix(*[F.element_at(f"__t{channel}", first + (r * size + g) * size + b) for b in (0, 1)], "__fb")
    return mix(*[mix(edge(r, 0), edge(r, 1), "__fg") for r in (0, 1)], "__fr")


def sample_lut(pixels: DataFrame, lut: DataFrame, size: int, key: list[str], extra: list[str] = []) -> DataFrame:  # noqa: B006
    """Trilinear samples of a table (extra, ri, gi, bi, lr, lg, lb) at r, g, b; key must be unique per row.

    A table of up to ``LOOKUP_POINTS`` points is one broadcast row of arrays
    that a projection indexes.  A larger one, or one with further columns, is
    joined point by point.
    """
    if not extra and size**3 <= LOOKUP_POINTS:
        placed = _placed(pixels.select(*key, "r", "g", "b").crossJoin(F.broadcast(lookup_row(lut.select("ri", "gi", "bi", "lr", "lg", "lb"), size))), size)  # one row
        return placed.withColumns({f"__s{c}": _trilinear(c, size, 0) for c in "rgb"}).select(*key, *[F.col(f"__s{c}").alias(c) for c in "rgb"])
    taps = pixels.select(*key, *extra, F.explode(corners(size)).alias("p")).select(*key, *extra, "p.*").where("w > 0")
    joined = taps.join(lut, [*extra, "ri", "gi", "bi"])
    return joined.groupBy(*key, *extra).agg(*[F.sum(F.col(f"l{c}") * F.col("w")).alias(c) for c in "rgb"])


def zone_weights(depth: Column, bounds: list[float]) -> Column:
    """Zone and weight of every zone with a weight; triangles about the zones' centres."""
    cells = []
    for z, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        width = high - low
        if width >= 1e-6:
            w = color.triangle(F.abs(depth - F.lit((low + high) / 2)), F.lit(width))
            cells.append(F.struct(F.lit(z).alias("zone"), w.alias("zw")))
    return F.filter(F.array(*cells), lambda c: c["zw"] >= 1e-6)


def _looked_up(pixels: DataFrame, lut: DataFrame, size: int, bounds: list[float]) -> DataFrame:
    """H01 as a projection over the broadcast row of all zones' points."""
    zones = len(bounds) - 1
    df = _placed(pixels.crossJoin(F.broadcast(lookup_row(lut, size, zones))), size)  # one row
    total, sums = F.lit(0.0), dict.fromkeys("rgb", F.lit(0.0))
    for z, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if high - low < 1e-6:
            continue
        w = color.triangle(F.abs(F.col("depth") - F.lit((low + high) / 2)), F.lit(high - low))
        df = df.withColumn(f"__w{z}", F.when(w >= 1e-6, w).otherwise(F.lit(0.0)))
        total = total + F.col(f"__w{z}")
        sums = {c: sums[c] + F.when(F.col(f"__w{z}") > 0, F.col(f"__w{z}") * _trilinear(c, size, z)).otherwise(F.lit(0.0)) for c in "rgb"}
    df = df.withColumns({"__w": total, **{f"__s{c}": v for c, v in sums.items()}})
    done = df.withColumns({c: F.when(F.col("__w") > 1e-6, F.col(f"__s{c}") / F.col("__w")).otherwise(F.col(c)) for c in "rgb"})
    return done.select(*[F.col(f"`{c}`") for c in pixels.columns])


def apply_zone_lut(pixels: DataFrame, lut: DataFrame, size: int, bounds: list[float], key: list[str]) -> DataFrame:
    """Weighted mean of the zones' samples; a pixel of no zone keeps its colour."""
    if (len(bounds) - 1) * size**3 <= LOOKUP_POINTS:
        return _looked_up(pixels, lut, size, bounds)
    zoned = pixels.select(*key, "r", "g", "b", F.explode(zone_weights(F.col("depth"), bounds)).alias("z")).select(*key, "r", "g", "b", "z.zone", "z.zw")
    sampled = sample_lut(zoned, lut, size, key, ["zone"]).withColumnsRenamed({c: f"s{c}" for c in "rgb"})
    mean = sampled.join(zoned.select(*key, "zone", "zw"), [*key, "zone"]).groupBy(*key).agg(
        F.sum("zw").alias("tw"), *[F.sum(F.col(f"s{c}") * F.col("zw")).alias(f"s{c}") for c in "rgb"]
    )
    joined = pixels.join(mean, key, "left")
    return joined.withColumns({c: F.when(F.coalesce("tw", F.lit(0.0)) > 1e-6, F.col(f"s{c}") / F.col("tw")).otherwise(F.col(c)) for c in "rgb"}).drop("tw", "sr", "sg", "sb")


def apply_qualifiers(pixels: DataFrame, qualifiers: list[Qualifier]) -> DataFrame:
    """The fold over at most six qualifiers; each sees what the ones before made of h, s and v."""
    h, s, v = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    df = pixels.withColumns({"__h": h, "__s": s, "__v": v})
    for q, centre, width in zip(qualifiers[:6], CENTRES, WIDTHS, strict=False):
        if q.weight < ACTIVE_FROM:
            continue
        mask = F.when(F.col("__s") < GRAY_BELOW, F.lit(0.0)).otherwise(color.triangle(color.hue_distance(F.col("__h"), centre), width))
        df = df.withColumn("__m", F.when(mask < 1e-6, F.lit(0.0)).otherwise(mask))
        df = df.withColumns({
            "__h": F.col("__h") + F.lit(q.h_offset) * F.col("__m"),
            "__s": F.col("__s") * (F.lit(1.0) + F.lit(q.s_ratio - 1.0) * F.col("__m")),
            "__v": F.col("__v") + F.lit(q.v_offset) * F.col("__m"),
        })
    r, g, b = color.rgb_of_hsv(F.pmod("__h", F.lit(360.0)), color.clamp(F.col("__s")), color.clamp(F.col("__v")))
    return df.withColumns({"r": r, "g": g, "b": b}).drop("__h", "__s", "__v", "__m")


def soft_knee(c: Column, knee: float, gain: Column | float = 1.0) -> Column:
    """Above the knee the rest of the range is bent by tanh."""
    room = F.lit(1.0 - knee)
    return F.when(c > knee, F.lit(knee) + room * F.tanh((c - knee) / room * gain)).otherwise(c)


def apply_tone(pixels: DataFrame, params: GradeParams) -> DataFrame:
    """Shadow lift, contrast, highlights, warmth and vibrance in CIELab, then the final knee; needs depth."""
    df = color.with_cielab(pixels, ("r", "g", "b"), ("__l", "__a", "__b"))
    d, l, a, b = (F.col(c) for c in ("depth", "__l", "__a", "__b"))
    df = df.withColumn("__l", l / 100.0)
    df = df.withColumn("__l", l + color.clamp((F.lit(0.15) - l) / 0.15) * (F.lit(0.2) + d * 0.15) * 0.15)
    amount = (F.lit(0.3) + d * 0.3) * params.contrast
    curve = F.lit(1.0) / (F.lit(1.0) + F.exp(-(l - 0.5) * (F.lit(4.0) + amount * 4.0)))
    df = df.withColumn("__l", l + (curve - l) * amount)
    df = df.withColumn("__l", soft_knee(l, 0.88, F.lit(1.4) + (F.lit(1.0) - d) * 0.2))
    light = l * 4.0 * (F.lit(1.0) - l)
    df = df.withColumns({"__a": a + (d * 5.0 + 1.0) * light, "__b": b + d * 4.0 * light})
    chroma = F.sqrt(a * a + b * b + 1e-8)
    boost = (d * 0.5 + 0.4) * (F.lit(1.0) - color.clamp(chroma / 40.0)) * F.least(l / 0.25, F.lit(1.0))
    warmth = 1.0 + (params.warmth - 1.0) * 0.3
    gain = (boost + 1.0) * (warmth if abs(warmth - 1.0) > 1e-4 else 1.0)
    df = df.withColumn("__gain", gain)
    df = df.withColumns({"__l": color.clamp(l * 100.0, 0.0, 100.0), "__a": color.clamp(a * F.col("__gain"), -128.0, 127.0), "__b": color.clamp(b * F.col("__gain"), -128.0, 127.0)})
    df = color.with_rgb_from_cielab(df, ("__l", "__a", "__b"), ("r", "g", "b"))
    return df.withColumns({c: color.clamp(soft_knee(F.col(c), 0.92)) for c in "rgb"}).drop("__l", "__a", "__b", "__gain")


def blend(pixels: DataFrame, strength: float, original: tuple[str, str, str]) -> DataFrame:
    """Nothing to do at full strength."""
    if strength >= 1.0 - 1e-4:
        return pixels
    return pixels.withColumns({c: F.col(o) * (1.0 - strength) + F.col(c) * strength for c, o in zip("rgb", original, strict=True)})


def grade_zoned(pixels: DataFrame, lut: DataFrame, size: int, bounds: list[float], qualifiers: list[Qualifier], params: GradeParams, key: list[str]) -> DataFrame:
    """H01 to H04 in order; pixels hold key, r, g, b and depth."""
    kept = pixels.withColumns({f"__o{c}": F.col(c) for c in "rgb"})
    toned = apply_tone(apply_qualifiers(apply_zone_lut(kept, lut, size, bounds, key), qualifiers), params)
    return blend(toned, params.strength, ("__or", "__og", "__ob")).drop("__or", "__og", "__ob")


def build_combined(spark, lut: DataFrame, size: int, grid: int, bounds: list[float], qualifiers: list[Qualifier], params: GradeParams) -> DataFrame:
    """The whole grading at every point of a grid and the depth of each zone's centre, as a table for :func:`sample_lut`."""
    centres = F.array(*[F.lit((a + b) / 2) for a, b in zip(bounds, bounds[1:], strict=False)])
    points = lattice(spark, grid, len(bounds) - 1).select("zone", "ri", "gi", "bi").withColumnsRenamed({"zone": "at_zone", "ri": "at_r", "gi": "at_g", "bi": "at_b"})
    pixels = points.withColumns({c: F.col(f"at_{c}") / float(grid - 1) for c in "rgb"}).withColumn("depth", F.element_at(centres, F.col("at_zone") + 1))
    graded = grade_zoned(pixels, lut, size, bounds, qualifiers, params, ["at_zone", "at_r", "at_g", "at_b"])
    named = {"at_zone": "zone", "at_r": "ri", "at_g": "gi", "at_b": "bi"}
    return graded.select(*[F.col(a).alias(b) for a, b in named.items()], *[F.col(c).alias(f"l{c}") for c in "rgb"])


def box_blur(pixels: DataFrame, value: str, radius: int = 30, passes: int = 1) -> DataFrame:
    """Mean over 2 radius + 1 pixels of the row, then of the column; fewer at the edges."""
    for _ in range(passes):
        for line, along in ((["frame_id", "y"], "x"), (["frame_id", "x"], "y")):
            near = Window.partitionBy(*line).orderBy(along).rowsBetween(-radius, radius)
            pixels = pixels.withColumn(value, F.avg(value).over(near))
    return pixels
