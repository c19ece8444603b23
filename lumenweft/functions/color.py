"""Colour columns: transfer curves, the rescaled OKLab space, CIELab and HSV.

All are built-in expressions and stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sRGB curves, the OKLab matrices and their scale to CIELab-like ranges.
SRGB_CUT, LINEAR_CUT = 0.04045, 0.0031308
L_SCALE, AB_SCALE = 100.0, 300.0
RGB_TO_LMS = (
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1073969566),
    (0.0883024619, 0.2817188376, 0.6299787005),
)
LMS_TO_LAB = (
    (0.2104542553, 0.7936177850, -0.0040720468),
    (1.9779984951, -2.4285922050, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.8086757660),
)
LAB_TO_LMS = (
    (1.0, 0.3963377774, 0.2158037573),
    (1.0, -0.1055613458, -0.0638541728),
    (1.0, -0.0894841775, -1.2914855480),
)
LMS_TO_RGB = (
    (4.0767416613, -3.3077115904, 0.2309699287),
    (-1.2684380041, 2.6097574007, -0.3413193963),
    (-0.0041960863, -0.7034186145, 1.7076147010),
)
# CIELab under D65.
WHITE = (0.95047, 1.0, 1.08883)
LAB_CUT, LAB_SLOPE = 0.008856, 0.128419
RGB_TO_XYZ = (
    (0.4124564, 0.3575761, 0.1804375),
    (0.2126729, 0.7151522, 0.0721750),
    (0.0193339, 0.1191920, 0.9503041),
)
XYZ_TO_RGB = (
    (3.2404542, -1.5371385, -0.4985314),
    (-0.9692660, 1.8760108, 0.0415560),
    (0.0556434, -0.2040259, 1.0572252),
)


def _mix(row: tuple[float, ...], xs: list[Column]) -> Column:
    first, *rest = (F.lit(w) * x for w, x in zip(row, xs, strict=True))
    for term in rest:
        first = first + term
    return first


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def unit_from_u16(c: Column) -> Column:
    """0..65535 to [0, 1]."""
    return c / F.lit(65535.0)


def u16_from_unit(c: Column) -> Column:
    """Clamp, scale, round half up."""
    return F.floor(clamp(c) * F.lit(65535.0) + F.lit(0.5)).cast("int")


def u8_from_u16(c: Column) -> Column:
    """The upper byte."""
    return F.shiftright(c, 8)


def u16_from_u8(c: Column) -> Column:
    """0..255 spread over 0..65535."""
    return c * F.lit(257)


def srgb_to_linear(c: Column) -> Column:
    """P03."""
    return F.when(c <= SRGB_CUT, c / F.lit(12.92)).otherwise(F.pow((c + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    """The floor of 1e-7 applies inside the power only."""
    return F.when(c <= LINEAR_CUT, c * F.lit(12.92)).otherwise(F.lit(1.055) * F.pow(F.greatest(c, F.lit(1e-7)), F.lit(1.0 / 2.4)) - F.lit(0.055))


def gray(r: Column, g: Column, b: Column) -> Column:
    """P16."""
    return (r + g + b) / F.lit(3.0)


def _staged(df: DataFrame, stages: list[dict[str, Column]]) -> DataFrame:
    """Columns in stages, so that no expression is written out twice."""
    for stage in stages:
        df = df.withColumns(stage)
    return df


def with_oklab(df: DataFrame, rgb: tuple[str, str, str], out: tuple[str, str, str] = ("lab_l", "lab_a", "lab_b")) -> DataFrame:
    """sRGB in [0, 1] to OKLab, L x 100 and a, b x 300."""
    lin, lms = [f"__lin{i}" for i in range(3)], [f"__lms{i}" for i in range(3)]
    zero = F.lit(0.0)
    df = _staged(df, [
        {n: srgb_to_linear(F.col(c)) for n, c in zip(lin, rgb, strict=True)},
        {n: F.cbrt(F.greatest(_mix(row, [F.col(c) for c in lin]), zero)) for n, row in zip(lms, RGB_TO_LMS, strict=True)},
        {n: _mix(row, [F.col(c) for c in lms]) * F.lit(s) for n, row, s in zip(out, LMS_TO_LAB, (L_SCALE, AB_SCALE, AB_SCALE), strict=True)},
    ])
    return df.drop(*lin, *lms)


def with_rgb(df: DataFrame, lab: tuple[str, str, str], out: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """Rescaled OKLab back to sRGB in [0, 1]."""
    ok, lms, lin = ([f"__{k}{i}" for i in range(3)] for k in ("ok", "lms", "lin"))
    cube = lambda c: c * c * c
    df = _staged(df, [
        {n: F.col(c) / F.lit(s) for n, c, s in zip(ok, lab, (L_SCALE, AB_SCALE, AB_SCALE), strict=True)},
        {n: _mix(row, [F.col(c) for c in ok]) for n, row in zip(lms, LAB_TO_LMS, strict=True)},
        {n: cube(F.col(n)) for n in lms},
        {n: F.greatest(_mix(row, [F.col(c) for c in lms]), F.lit(0.0)) for n, row in zip(lin, LMS_TO_RGB, strict=True)},
        {n: clamp(linear_to_srgb(F.col(c))) for n, c in zip(out, lin, strict=True)},
    ])
    return df.drop(*ok, *lms, *lin)


def with_cielab(df: DataFrame, rgb: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """sRGB to CIELab under D65."""
    lin, f = [f"__lin{i}" for i in range(3)], [f"__f{i}" for i in range(3)]
    shape = lambda t: F.when(t > LAB_CUT, F.cbrt(t)).otherwise(t / F.lit(LAB_SLOPE) + F.lit(4.0 / 29.0))
    df = _staged(df, [
        {n: srgb_to_linear(F.col(c)) for n, c in zip(lin, rgb, strict=True)},
        {n: _mix(row, [F.col(c) for c in lin]) / F.lit(w) for n, row, w in zip(f, RGB_TO_XYZ, WHITE, strict=True)},
        {n: shape(F.col(n)) for n in f},
        {out[0]: F.lit(116.0) * F.col(f[1]) - 16.0, out[1]: F.lit(500.0) * (F.col(f[0]) - F.col(f[1])), out[2]: F.lit(200.0) * (F.col(f[1]) - F.col(f[2]))},
    ])
    return df.drop(*lin, *f)


def with_rgb_from_cielab(df: DataFrame, lab: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """CIELab under D65 to sRGB in [0, 1]."""
    f, xyz, lin = ([f"__{k}{i}" for i in range(3)] for k in ("f", "xyz", "lin"))
    back = lambda s: F.when(s > 6.0 / 29.0, s * s * s).otherwise(F.lit(LAB_SLOPE) * (s - F.lit(4.0 / 29.0)))
    l, a, b = (F.col(c) for c in lab)
    df = _staged(df, [
        {f[1]: (l + 16.0) / 116.0},
        {f[0]: a / 500.0 + F.col(f[1]), f[2]: F.col(f[1]) - b / 200.0},
        {n: F.lit(w) * back(F.col(c)) for n, c, w in zip(xyz, f, WHITE, strict=True)},
        {n: F.greatest(_mix(row, [F.col(c) for c in xyz]), F.lit(0.0)) for n, row in zip(lin, XYZ_TO_RGB, strict=True)},
        {n: clamp(linear_to_srgb(F.col(c))) for n, c in zip(out, lin, strict=True)},
    ])
    return df.drop(*f, *xyz, *lin)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation, value."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = F.when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2.0).otherwise((r - g) / span + 4.0)
    hue = F.when(span < 1e-6, F.lit(0.0)).otherwise(F.pmod(turn * 60.0, F.lit(360.0)))
    return hue, F.when(top > 1e-6, span / top).otherwise(F.lit(0.0)), top


def rgb_of_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Channel n is v less v s max(0, min(k, 4 - k, 1)) with k = (n + h / 60) mod 6."""

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 60.0, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))

    return channel(5), channel(3), channel(1)


def hue_distance(h: Column, centre: float) -> Column:
    """The angle between two hues, 0..180."""
    d = F.pmod(h - F.lit(centre), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def triangle(distance: Column, width: float | Column) -> Column:
    """1 at 0, falling to 0 at width."""
    return F.greatest(F.lit(1.0) - distance / width, F.lit(0.0))
