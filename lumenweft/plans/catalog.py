"""Every operator as a query over the driver's tables, with its SQL where SQL can say it.

historical ones, x_ show the relational surface that the engine exposes.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color, media, registered as functions
from ..operators import bench, diagnostics, lut, packed, protocol, resample, scene, sequence, transfer, transfer_arrow
from ..sources import frames as frame_files
from ..sources.results import resolve
from ..sources.shared import remove_folder, shared_folder
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = ["frame_id", "y", "x"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})


# Colour arithmetic in SQL, from the constants of functions.color.
def _sum(row, names) -> str:
    return "(" + " + ".join(f"({w}) * {n}" for w, n in zip(row, names, strict=True)) + ")"


def _lin(c: str) -> str:
    return f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92::DOUBLE ELSE pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


def _srgb(c: str) -> str:
    return f"CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(greatest({c}, 1e-7::DOUBLE), 1.0::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE END"


def _u16(c: str) -> str:
    return f"floor(least(greatest({c}, 0.0::DOUBLE), 1.0::DOUBLE) * 65535.0::DOUBLE + 0.5::DOUBLE)::INT"


def lab_ctes(source: str, key: str, out: str, rgb: str = "rgb") -> str:
    """CTEs that end in ``out`` (key, lab_l, lab_a, lab_b) from a source with r, g, b in [0, 1]."""
    names = [f"l{c}" for c in "rgb"]
    lms = ", ".join(f"cbrt(greatest({_sum(row, names)}, 0.0::DOUBLE)) AS m{i}" for i, row in enumerate(color.RGB_TO_LMS))
    lab = ", ".join(f"{_sum(row, ['m0', 'm1', 'm2'])} * {s} AS lab_{c}" for c, row, s in zip("lab", color.LMS_TO_LAB, (100.0, 300.0, 300.0), strict=True))
    return (
        f"{out}_1 AS (SELECT {key}, " + ", ".join(f"{_lin(c)} AS l{c}" for c in rgb) + f" FROM {source}), "
        f"{out}_2 AS (SELECT {key}, {lms} FROM {out}_1), {out} AS (SELECT {key}, {lab} FROM {out}_2)"
    )


def rgb_ctes(source: str, key: str, out: str) -> str:
    """CTEs that end in ``out`` (key, r, g, b) from a source with lab_l, lab_a, lab_b."""
    ok = "lab_l / 100.0::DOUBLE AS k0, lab_a / 300.0::DOUBLE AS k1, lab_b / 300.0::DOUBLE AS k2"
    lms = ", ".join(f"{_sum(row, ['k0', 'k1', 'k2'])} AS n{i}" for i, row in enumerate(color.LAB_TO_LMS))
    lin = ", ".join(f"greatest({_sum(row, ['n0 * n0 * n0', 'n1 * n1 * n1', 'n2 * n2 * n2'])}, 0.0::DOUBLE) AS v{c}" for c, row in zip("rgb", color.LMS_TO_RGB, strict=True))
    return (
        f"{out}_1 AS (SELECT {key}, {ok} FROM {source}), {out}_2 AS (SELECT {key}, {lms} FROM {out}_1), {out}_3 AS (SELECT {key}, {lin} FROM {out}_2), "
        f"{out} AS (SELECT {key}, " + ", ".join(f"least(greatest({_srgb('v' + c)}, 0.0::DOUBLE), 1.0::DOUBLE) AS {c}" for c in "rgb") + f" FROM {out}_3)"
    )


UNIT = "unit AS (SELECT frame_id, y, x, r16 / 65535.0::DOUBLE AS r, g16 / 65535.0::DOUBLE AS g, b16 / 65535.0::DOUBLE AS b FROM px)"
U16 = ", ".join(f"{_u16(c)} AS {c}16" for c in "rgb")


# ---- colour -----------------------------------------------------------------


@query("q_srgb_to_linear", f"WITH {fx.PX}, {UNIT} SELECT frame_id, y, x, round({_lin('r')}, 6) AS lr, round({_lin('g')}, 6) AS lg, round({_lin('b')}, 6) AS lb FROM unit")
def _(spark, d):
    u = transfer.to_unit(fx.px(spark, d))
    return u.select(*KEY, *[F.round(color.srgb_to_linear(F.col(c)), 6).alias(f"l{c}") for c in "rgb"])


@query("q_linear_to_srgb", f"WITH {fx.PX}, {UNIT} SELECT frame_id, y, x, round({_srgb('r')}, 6) AS sr, round({_srgb('g')}, 6) AS sg, round({_srgb('b')}, 6) AS sb FROM unit")
def _(spark, d):
    u = transfer.to_unit(fx.px(spark, d))
    return u.select(*KEY, *[F.round(color.linear_to_srgb(F.col(c)), 6).alias(f"s{c}") for c in "rgb"])


@query("q_rgb_to_oklab", f"WITH {fx.PX}, {UNIT}, {lab_ctes('unit', 'frame_id, y, x', 'lab')} SELECT frame_id, y, x, round(lab_l, 4) + 0.0 AS lab_l, round(lab_a, 4) + 0.0 AS lab_a, round(lab_b, 4) + 0.0 AS lab_b FROM lab")
def _(spark, d):
    lab = color.with_oklab(transfer.to_unit(fx.px(spark, d)), ("r", "g", "b"))
    return r6(lab.select(*KEY, "lab_l", "lab_a", "lab_b"), "lab_l", "lab_a", "lab_b", digits=4)


@query("q_oklab_roundtrip_u16", f"WITH {fx.PX}, {UNIT}, {lab_ctes('unit', 'frame_id, y, x', 'lab')}, {rgb_ctes('lab', 'frame_id, y, x', 'back')} SELECT frame_id, y, x, {U16} FROM back")
def _(spark, d):
    lab = color.with_oklab(transfer.to_unit(fx.px(spark, d)), ("r", "g", "b"))
    back = color.with_rgb(lab.select(*KEY, "lab_l", "lab_a", "lab_b"), ("lab_l", "lab_a", "lab_b"))
    return back.select(*KEY, *[color.u16_from_unit(F.col(c)).alias(f"{c}16") for c in "rgb"])


_MOVED = "moved AS (SELECT frame_id, y, x, lab_l + d_l AS lab_l, lab_a + d_a AS lab_a, lab_b + d_b AS lab_b FROM lab JOIN delta USING (frame_id, y, x))"


@query("q_oklab_transfer", f"WITH {fx.PX}, {fx.DELTA}, {UNIT}, {lab_ctes('unit', 'frame_id, y, x', 'lab')}, {_MOVED}, {rgb_ctes('moved', 'frame_id, y, x', 'back')} SELECT frame_id, y, x, {U16} FROM back")
def oklab_transfer(spark, d):
    return transfer.transfer(fx.px(spark, d), fx.delta(spark, d)).select(*KEY, "r16", "g16", "b16")


_GAMMA = "modelled AS (SELECT frame_id, y, x, least(greatest((((r - 0.5) / 0.5 * 0.9 + 0.05) + 1.0) / 2.0, 0.0), 1.0)::DOUBLE AS r, least(greatest((((g - 0.5) / 0.5 * 0.9 + 0.05) + 1.0) / 2.0, 0.0), 1.0)::DOUBLE AS g, least(greatest((((b - 0.5) / 0.5 * 0.9 + 0.05) + 1.0) / 2.0, 0.0), 1.0)::DOUBLE AS b FROM unit)"


@query(
    "q_oklab_delta_mock_model",
    f"WITH {fx.PX}, {UNIT}, {_GAMMA}, {lab_ctes('unit', 'frame_id, y, x', 'la')}, {lab_ctes('modelled', 'frame_id, y, x', 'lm')} "
    "SELECT frame_id, y, x, round(lm.lab_l - la.lab_l, 4) + 0.0 AS d_l, round(lm.lab_a - la.lab_a, 4) + 0.0 AS d_a, round(lm.lab_b - la.lab_b, 4) + 0.0 AS d_b FROM la JOIN lm USING (frame_id, y, x)",
)
def _(spark, d):
    unit = transfer.to_unit(fx.px(spark, d))
    model = unit.select(*KEY, *[transfer.model_output(transfer.model_input(F.col(c)) * 0.9 + 0.05).alias(c) for c in "rgb"])
    return r6(transfer.oklab_delta(unit, model), "d_l", "d_a", "d_b", digits=4)


def _axis_sql(name: str, source: int, target: int, convention: str) -> str:
    """R01-R04 in SQL: name(s, d, w), the weight with which target d reads source s."""
    if convention == resample.NEAREST:
        return f"{name} AS (SELECT least({source - 1}, d * {source} // {target})::INT AS s, d::INT AS d, 1.0::DOUBLE AS w FROM range({target}) t(d))"
    at = f"greatest((d + 0.5::DOUBLE) * {source} / {target} - 0.5::DOUBLE, 0)" if convention == resample.HALF_PIXEL else f"d::DOUBLE * {source - 1} / {max(target - 1, 1)}"
    low = f"SELECT d::INT AS d, pos, least(floor(pos), {source - 1})::INT AS low FROM (SELECT d, {at} AS pos FROM range({target}) t(d))"
    return f"{name} AS (SELECT low AS s, d, 1 - (pos - low) AS w FROM ({low}) UNION ALL SELECT least(low + 1, {source - 1}) AS s, d, pos - low AS w FROM ({low}) WHERE pos > low)"


def _grade_sql(source: str, size: int, proxy: int, modelled: str, key: str = "frame_id") -> str:
    """CTEs from ``source`` (key, y, x, r16, g16, b16) to ``graded``: proxy, model, change, back, transfer."""
    down = ", ".join(f"sum({c}16 / 65535.0::DOUBLE * tx.w * ty.w) AS {c}" for c in "rgb")
    up = ", ".join(f"sum(d_{c} * ux.w * uy.w) AS d_{c}" for c in "lab")
    at = f"{key}, y, x"
    return (
        f"{_axis_sql('tx', size, proxy, resample.HALF_PIXEL)}, {_axis_sql('ty', size, proxy, resample.HALF_PIXEL)}, {_axis_sql('ux', proxy, size, resample.HALF_PIXEL)}, {_axis_sql('uy', proxy, size, resample.HALF_PIXEL)}, "
        f"small AS (SELECT {key}, ty.d AS y, tx.d AS x, {down} FROM {source} p JOIN tx ON tx.s = p.x JOIN ty ON ty.s = p.y GROUP BY {key}, ty.d, tx.d), "
        f"done AS (SELECT {at}, {', '.join(f'{modelled.format(c)} AS {c}' for c in 'rgb')} FROM small), {lab_ctes('small', at, 'before')}, {lab_ctes('done', at, 'after')}, "
        f"change AS (SELECT {at}, {', '.join(f'b.lab_{c} - a.lab_{c} AS d_{c}' for c in 'lab')} FROM before a JOIN after b USING ({at})), "
        f"whole AS (SELECT {key}, uy.d AS y, ux.d AS x, {up} FROM change p JOIN ux ON ux.s = p.x JOIN uy ON uy.s = p.y GROUP BY {key}, uy.d, ux.d), "
        f"unit AS (SELECT {at}, r16 / 65535.0::DOUBLE AS r, g16 / 65535.0::DOUBLE AS g, b16 / 65535.0::DOUBLE AS b FROM {source}), {lab_ctes('unit', at, 'lab')}, "
        f"moved AS (SELECT {at}, lab_l + d_l AS lab_l, lab_a + d_a AS lab_a, lab_b + d_b AS lab_b FROM lab JOIN whole USING ({at})), {rgb_ctes('moved', at, 'graded')}"
    )


_POWER = "pow(least(greatest({}, 0), 1), 0.8::DOUBLE)"


@query("q_grade", f"WITH {fx.TILE_PX}, {_grade_sql('px', 8, 4, _POWER, 'clip_id, frame_id')} SELECT clip_id, frame_id, y, x, {U16} FROM graded")
def _(spark, d):
    """Packed frames of two clips graded through a model that changes them, one pass over Arrow batches."""
    return packed.pixels_of(packed.grade_frames(fx.tile_frames(spark, d), (4, 4), transfer.gamma_model(0.8)))


@query("q_grade_rows", f"WITH {fx.FULL_PX}, {_grade_sql('full_px', 8, 4, _POWER)} SELECT frame_id, y, x, {U16} FROM graded")
def _(spark, d):
    """Z02 by relational operators over pixel rows, with the same model."""
    return transfer.grade(fx.full_px(spark, d), (8, 8), (4, 4), transfer.gamma_model(0.8))


@query("q_grade_identity", f"WITH {fx.TILE_PX} SELECT * FROM px")
def _(spark, d):
    """With the identity model nothing changes, whatever the proxy's size."""
    return packed.pixels_of(packed.grade_frames(fx.tile_frames(spark, d), 5))


_LINE = (
    "px AS (SELECT l_returnflag, (l_partkey * 7919 + l_suppkey * 31) % 65536 / 65535.0::DOUBLE AS r, (l_orderkey * 104729 + l_linenumber) % 65536 / 65535.0::DOUBLE AS g, "
    "round(l_extendedprice * 100)::BIGINT % 65536 / 65535.0::DOUBLE AS b, l_quantity / 5.0 - 5.0 AS d_l, l_discount * 100.0 - 5.0 AS d_a, l_tax * 100.0 - 4.0 AS d_b FROM lineitem)"
)


@query(
    "q_transfer_lineitem",
    f"WITH {_LINE}, {lab_ctes('px', 'l_returnflag, d_l, d_a, d_b', 'lab')}, moved AS (SELECT l_returnflag, lab_l + d_l AS lab_l, lab_a + d_a AS lab_a, lab_b + d_b AS lab_b FROM lab), {rgb_ctes('moved', 'l_returnflag', 'back')}, u AS (SELECT l_returnflag, {U16} FROM back) "
    "SELECT l_returnflag, count(*) AS n, sum(r16)::BIGINT AS r16, sum(g16)::BIGINT AS g16, sum(b16)::BIGINT AS b16 FROM u GROUP BY l_returnflag",
)
def _(spark, d):
    """The transfer as a pixel load of its own: one pixel and one delta per line item, summed."""
    c = F.col
    px = fx.table(spark, d, "lineitem").select(
        "l_returnflag", ((c("l_partkey") * 7919 + c("l_suppkey") * 31) % 65536 / 65535.0).alias("r"), ((c("l_orderkey") * 104729 + c("l_linenumber")) % 65536 / 65535.0).alias("g"),
        (F.round(c("l_extendedprice") * 100).cast("long") % 65536 / 65535.0).alias("b"), (c("l_quantity") / 5.0 - 5.0).alias("d_l"), (c("l_discount") * 100.0 - 5.0).alias("d_a"), (c("l_tax") * 100.0 - 4.0).alias("d_b"),
    )
    done = transfer.add_delta(px)
    return done.groupBy("l_returnflag").agg(F.count("*").alias("n"), *[F.sum(f"{x}16").alias(f"{x}16") for x in "rgb"])


@query("q_oklab_transfer_arrow", SQL["q_oklab_transfer"])
def _(spark, d):
    """The same over Arrow batches."""
    rows = transfer.to_unit(fx.px(spark, d)).select(*KEY, "r", "g", "b").join(fx.delta(spark, d), KEY)
    return transfer_arrow.grade_rows(rows, "arrow").select(*KEY, "r16", "g16", "b16")


@query("q_to_8bit", f"WITH {fx.PX} SELECT frame_id, y, x, r16 >> 8 AS r, g16 >> 8 AS g, b16 >> 8 AS b FROM px")
def _(spark, d):
    return fx.px(spark, d).select(*KEY, *[color.u8_from_u16(F.col(f"{c}16")).alias(c) for c in "rgb"])


@query("q_zero_extend", f"WITH {fx.SCENE_PX} SELECT frame_id, y, x, r * 257 AS r16, g * 257 AS g16, b * 257 AS b16 FROM scene_px")
def _(spark, d):
    return fx.rgb8(spark, d).select(*KEY, "r16", "g16", "b16")


@query("q_unit_u16_roundtrip", f"WITH {fx.PX} SELECT frame_id, y, x, r16, g16, b16 FROM px")
def _(spark, d):
    unit = transfer.to_unit(fx.px(spark, d))
    return unit.select(*KEY, *[color.u16_from_unit(F.col(c)).alias(f"{c}16") for c in "rgb"])


@query("q_gray", f"WITH {fx.SCENE_PX} SELECT frame_id, y, x, round((r + g + b) / 3.0::DOUBLE, 6) AS gray FROM scene_px")
def _(spark, d):
    return fx.scene_px(spark, d).select(*KEY, F.round(color.gray(*map(F.col, "rgb")), 6).alias("gray"))


# ---- resampling -------------------------------------------------------------


def _resize_sql(size: int, convention: str, source: str, value: str, digits: int = 6) -> str:
    s = f"round(sum({value} * tx.w * ty.w), {digits}) + 0.0"
    return f"{_axis_sql('tx', 8, size, convention)}, {_axis_sql('ty', 8, size, convention)} SELECT frame_id, ty.d AS y, tx.d AS x, {s} AS {value} FROM {source} p JOIN tx ON tx.s = p.x JOIN ty ON ty.s = p.y GROUP BY frame_id, ty.d, tx.d"


for _name, _size, _convention in (("q_resize_half_pixel", 5, resample.HALF_PIXEL), ("q_upscale_half_pixel", 13, resample.HALF_PIXEL), ("q_resize_corner_aligned", 5, resample.CORNERS), ("q_resize_nearest", 5, resample.NEAREST)):

    @query(_name, f"WITH {fx.TILE}, {_resize_sql(_size, _convention, 'tile', 'v')}")
    def _(spark, d, size=_size, convention=_convention):
        return r6(resample.resize(fx.tile(spark, d), (8, 8), (size, size), ["v"], convention=convention), "v")


@query("q_upscale_depth", f"WITH {fx.DEPTH}, {_resize_sql(13, resample.CORNERS, 'depth', 'depth', 12)}")
def _(spark, d):
    return r6(resample.upscale_depth(fx.depth(spark, d), (8, 8), (13, 13)), "depth", digits=12)


@query(
    "q_resize_rgb8",
    f"WITH {fx.SCENE_PX}, f AS (SELECT * FROM scene_px WHERE frame_id < (SELECT (max(event_id) + 1) // 64 FROM events)), {_axis_sql('tx', 8, 5, resample.CORNERS)}, {_axis_sql('ty', 8, 5, resample.CORNERS)} "
    "SELECT frame_id, ty.d AS y, tx.d AS x, " + ", ".join(f"least(greatest(round(round(sum({c} * tx.w * ty.w), 9)), 0), 255)::INT AS {c}" for c in "rgb") + " FROM f JOIN tx ON tx.s = f.x JOIN ty ON ty.s = f.y GROUP BY frame_id, ty.d, tx.d",
)
def _(spark, d):
    whole = fx.scene_px(spark, d).join(fx.full_px(spark, d).select(*KEY), KEY)
    return resample.resize_rgb8(whole, (8, 8), (5, 5))


# ---- scenes -----------------------------------------------------------------

_HIST = f"WITH {fx.SCENE_PX}, h AS (SELECT frame_id, channel, v * 64 >> 8 AS bin, count(*) AS n FROM (SELECT frame_id, unnest([0, 1, 2]) AS channel, unnest([r, g, b]) AS v FROM scene_px) GROUP BY ALL)"
_DIST = (
    _HIST + ", n AS (SELECT frame_id, sum(n)::DOUBLE / 3 AS pixels FROM h GROUP BY frame_id), pairs AS (SELECT frame_id, lag(frame_id) OVER (ORDER BY frame_id) AS before, pixels FROM n)"
    ", cells AS (SELECT p.frame_id, h.channel, h.bin, h.n AS n FROM pairs p JOIN h ON h.frame_id = p.frame_id WHERE before IS NOT NULL UNION ALL SELECT p.frame_id, h.channel, h.bin, -h.n FROM pairs p JOIN h ON h.frame_id = p.before)"
    ", dist AS (SELECT frame_id, sum(abs(d)) / (6.0::DOUBLE * any_value(pixels)) AS distance FROM (SELECT frame_id, channel, bin, sum(n) AS d FROM cells GROUP BY ALL) JOIN pairs USING (frame_id) GROUP BY frame_id)"
)


@query("q_color_histogram", _HIST + " SELECT frame_id, channel, bin::INT AS bin, n FROM h")
def _(spark, d):
    return scene.histogram(fx.scene_px(spark, d))


@query("q_hist_distance", _DIST + " SELECT frame_id, round(distance, 6) AS distance FROM dist")
def _(spark, d):
    return r6(scene.scene_distances(fx.scene_px(spark, d)), "distance")


@query("q_scene_cuts", _DIST + " SELECT frame_id, round(distance, 6) AS distance FROM dist WHERE distance > 0.15")
def _(spark, d):
    return r6(scene.scene_cuts(fx.scene_px(spark, d)), "distance")


@query("q_scene_segments", _DIST + ", f AS (SELECT frame_id, sum((coalesce(distance, 0) > 0.15)::BIGINT) OVER (ORDER BY frame_id)::BIGINT AS segment FROM n LEFT JOIN dist USING (frame_id)) SELECT segment, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(*) AS frames FROM f GROUP BY segment")
def _(spark, d):
    return scene.scene_segments(fx.scene_px(spark, d))


# ---- diagnostics ------------------------------------------------------------


@query("q_minmax_u8", f"WITH {fx.TILE} SELECT frame_id, y, x, floor((v - min(v) OVER f) / (max(v) OVER f - min(v) OVER f + 1e-8::DOUBLE) * 255)::INT AS u8 FROM tile WINDOW f AS (PARTITION BY frame_id)")
def _(spark, d):
    return diagnostics.minmax_u8(fx.tile(spark, d), "v", ["frame_id"], eps=1e-8).drop("v")


_SHIFTED = f"WITH {fx.SCENE_PX}, b AS (SELECT frame_id, y, x, (r + x) % 256 AS r2, (g + y * 2) % 256 AS g2, abs(b - 3) AS b2 FROM scene_px)"


def _shifted(px: DataFrame) -> DataFrame:
    return px.select(*KEY, ((F.col("r") + F.col("x")) % 256).alias("r"), ((F.col("g") + F.col("y") * 2) % 256).alias("g"), F.abs(F.col("b") - 3).alias("b"))


@query("q_abs_diff_x5", _SHIFTED + " SELECT frame_id, y, x, least(abs(r - r2) * 5, 255)::INT AS r, least(abs(g - g2) * 5, 255)::INT AS g, least(abs(a.b - b2) * 5, 255)::INT AS b FROM scene_px a JOIN b USING (frame_id, y, x)")
def _(spark, d):
    px = fx.scene_px(spark, d)
    return diagnostics.abs_diff(px, _shifted(px), KEY)


@query("q_channel_diff", _SHIFTED + " SELECT frame_id, y, x, unnest(['r', 'g', 'b']) AS channel, unnest([least(abs(r - r2) * 5, 255), least(abs(g - g2) * 5, 255), least(abs(a.b - b2) * 5, 255)])::INT AS diff FROM scene_px a JOIN b USING (frame_id, y, x)")
def _(spark, d):
    px = fx.scene_px(spark, d)
    return diagnostics.channel_diff(px, _shifted(px), KEY)


@query("q_channel_stats", f"WITH {fx.SCENE_PX} SELECT channel, min(v) AS min_v, max(v) AS max_v, round(avg(v), 6) AS mean_v, round(stddev_pop(v), 6) AS std_v, count(DISTINCT v) AS n_distinct FROM (SELECT unnest(['r', 'g', 'b']) AS channel, unnest([r, g, b]) AS v FROM scene_px) GROUP BY channel")
def _(spark, d):
    return r6(diagnostics.channel_stats(fx.scene_px(spark, d).select("r", "g", "b")), "mean_v", "std_v")


_BLOCKS = f"WITH {fx.SCENE_PX}, blocks AS (SELECT frame_id, (y // 3)::INT AS by_, (x // 3)::INT AS bx, var_pop((r + g + b) / 3.0::DOUBLE) AS variance FROM scene_px WHERE y < 6 AND x < 6 GROUP BY ALL)"


def _blocks(spark, d):
    return diagnostics.block_variance(fx.scene_px(spark, d), (8, 8), block=3)


@query("q_block_variance", _BLOCKS + " SELECT frame_id, by_ AS \"by\", bx, round(variance, 6) AS variance FROM blocks")
def _(spark, d):
    return r6(_blocks(spark, d), "variance")


@query("q_flat_blocks_pct", _BLOCKS + " SELECT frame_id, round(avg((round(variance, 6) < 5)::INT) * 100, 6) AS flat_pct, round(avg(variance), 6) AS mean_var, round(min(variance), 6) AS min_var, round(max(variance), 6) AS max_var FROM blocks GROUP BY frame_id")
def _(spark, d):
    b = _blocks(spark, d)
    flat = diagnostics.flat_blocks(b.withColumn("variance", F.round("variance", 6)), 5.0).select("frame_id", "flat_pct")
    return r6(flat.join(diagnostics.flat_blocks(b).drop("flat_pct"), "frame_id"), "flat_pct", "mean_var", "min_var", "max_var")


_ZONES = f"WITH {fx.DEPTH}, q AS (SELECT frame_id, round(quantile_cont(depth, 0.25), 9) AS b1, round(quantile_cont(depth, 0.5), 9) AS b2, round(quantile_cont(depth, 0.75), 9) AS b3, max(depth) AS b4 FROM depth GROUP BY frame_id)"


def _zoned(spark, d, closed: bool) -> DataFrame:
    depth = fx.depth(spark, d)
    bounds = diagnostics.zone_bounds(depth, 4, ["frame_id"]).withColumn("bounds", F.transform("bounds", lambda b: F.round(b, 9)))
    return depth.join(bounds, "frame_id").withColumn("zone", diagnostics.zone_of(F.col("depth"), F.col("bounds"), 4, closed=closed)).drop("bounds")


@query("q_zone_bounds", _ZONES + " SELECT frame_id, b1, b2, b3, b4 FROM q")
def _(spark, d):
    b = diagnostics.zone_bounds(fx.depth(spark, d), 4, ["frame_id"])
    return b.select("frame_id", *[F.round(F.col("bounds")[i], 9).alias(f"b{i}") for i in (1, 2, 3)], F.col("bounds")[4].alias("b4"))


@query("q_depth_zones", _ZONES + " SELECT frame_id, y, x, depth, CASE WHEN depth < b1 THEN 0 WHEN depth < b2 THEN 1 WHEN depth < b3 THEN 2 ELSE 3 END AS zone FROM depth JOIN q USING (frame_id)")
def _(spark, d):
    return _zoned(spark, d, True)


@query("q_zone_hist", _ZONES + ", z AS (SELECT frame_id, CASE WHEN depth < b1 THEN 0 WHEN depth < b2 THEN 1 WHEN depth < b3 THEN 2 WHEN depth < b4 THEN 3 END AS zone FROM depth JOIN q USING (frame_id)) SELECT frame_id, zone, count(*) AS n, round(count(*) * 100.0 / 64, 6) AS pct, repeat('#', floor(count(*) * 100.0 / 64 / 2)::INT) AS bar FROM z WHERE zone IS NOT NULL GROUP BY frame_id, zone")
def _(spark, d):
    return r6(diagnostics.zone_histogram(fx.depth(spark, d), 4, ["frame_id"]), "pct")


@query("q_accuracy", f"WITH {fx.TILE}, p AS (SELECT frame_id, abs(v - round(v, 1)) AS e FROM tile) SELECT frame_id, round(max(e), 6) AS max_diff, round(list_sort(list(e))[64], 6) AS p99, round(avg(e * e), 9) AS mse, round(10 * log10(4 / greatest(avg(e * e), 1e-10)), 4) AS psnr FROM p GROUP BY frame_id")
def _(spark, d):
    t = fx.tile(spark, d)
    out = diagnostics.accuracy(t, t.withColumn("v", F.round("v", 1)), KEY, "v", ["frame_id"])
    return r6(r6(r6(out, "max_diff", "p99"), "mse", digits=9), "psnr", digits=4)


# ---- media ------------------------------------------------------------------

_PROXY = "SELECT event_id, w, h, CASE WHEN greatest(w, h) <= 518 THEN w ELSE greatest(round(w * (518 / greatest(w, h)::DOUBLE)), 1)::INT END AS pw, CASE WHEN greatest(w, h) <= 518 THEN h ELSE greatest(round(h * (518 / greatest(w, h)::DOUBLE)), 1)::INT END AS ph FROM (SELECT event_id, (event_id * 37 % 4096 + 1)::INT AS w, (event_id * 53 % 2160 + 1)::INT AS h FROM events)"


@query("q_proxy_dims", _PROXY)
def _(spark, d):
    e = F.col("event_id")
    sizes = fx.table(spark, d, "events").select("event_id", (e * 37 % 4096 + 1).cast("int").alias("w"), (e * 53 % 2160 + 1).cast("int").alias("h"))
    p = media.proxy_dims(F.col("w"), F.col("h"), F.lit(518))
    return sizes.select("event_id", "w", "h", p["w"].alias("pw"), p["h"].alias("ph"))


_PROBE = """WITH p AS (
  SELECT event_id AS clip_id, (event_id % 4000 + 16)::INT AS width, (event_id % 2000 + 16)::INT AS height,
    [30000.0::DOUBLE / 1001, 25.0, 24.0, 30.0, 15.0, 50.0][event_id % 6 + 1] AS fps, (event_id % 97) + 0.5::DOUBLE AS duration_secs,
    ['hevc', 'prores', 'h264', 'h265', 'av1'][event_id % 5 + 1] AS codec_name, ['yuv420p10le', 'yuv420p', 'yuv422p12le'][event_id % 3 + 1] AS pix_fmt, event_id FROM events
), v AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN event_id * 3 ELSE round(duration_secs * fps)::BIGINT END AS frame_count,
  CASE WHEN event_id % 7 = 0 THEN 8 WHEN pix_fmt LIKE '%10%' THEN 10 WHEN pix_fmt LIKE '%12%' THEN 12 ELSE 8 END AS bits FROM p)"""


@query("q_probe_json", _PROBE + " SELECT clip_id, width, height, round(fps, 6) AS fps, duration_secs, frame_count, true AS has_audio, codec_name, pix_fmt, bits FROM v")
def _(spark, d):
    info = media.with_video_info(fx.probes(spark, d), "json", "i")
    return r6(info.select("clip_id", "i.width", "i.height", "i.fps", "i.duration_secs", "i.frame_count", "i.has_audio", "i.codec_name", "i.pix_fmt", F.col("i.bits_per_component").alias("bits")), "fps")


@query("q_detect_encoding", _PROBE + " SELECT clip_id, e.enc AS encoding, e.enc IN ('ilog', 'dlog-m') AS ten_bit, CASE WHEN e.enc = 'srgb' THEN 'h264' ELSE 'prores' END AS codec FROM v, LATERAL (SELECT CASE WHEN codec_name = 'prores' THEN 'ilog' WHEN bits >= 10 AND codec_name IN ('hevc', 'h265') THEN 'dlog-m' ELSE 'srgb' END AS enc) e")
def _(spark, d):
    info = media.with_video_info(fx.probes(spark, d), "json", "i")
    enc = info.select("clip_id", media.detect_encoding(F.col("i.codec_name"), F.col("i.bits_per_component")).alias("encoding"))
    return enc.select("clip_id", "encoding", media.is_10bit(F.col("encoding")).alias("ten_bit"), media.default_codec(F.col("encoding")).alias("codec"))


_NAMES = ["DLOG-M", "dlogm", "dlog_m", "ILog", "i-log", "sRGB", "rec709", "prores", "PRORES_KS", "hevc10", "HEVC", "h265", "h265_10", "h264", "avc", "vp9"]


@query(
    "q_codec_matrix",
    "WITH n AS (SELECT event_id, [" + ", ".join(f"'{n}'" for n in _NAMES) + "][event_id % 16 + 1] AS name FROM events), m AS (SELECT *, CASE WHEN lower(name) IN ('dlog-m','dlogm','dlog_m') THEN 'dlog-m' WHEN lower(name) IN ('ilog','i-log') THEN 'ilog' WHEN lower(name) IN ('srgb','rec709') THEN 'srgb' END AS encoding, "
    "CASE WHEN lower(name) IN ('prores','prores_ks') THEN 'prores' WHEN lower(name) IN ('hevc10','hevc','h265','h265_10') THEN 'hevc10' WHEN lower(name) IN ('h264','avc') THEN 'h264' END AS codec FROM n) "
    "SELECT event_id, name, encoding, codec, CASE codec WHEN 'prores' THEN 'prores_ks' WHEN 'hevc10' THEN 'hevc' WHEN 'h264' THEN 'h264' END AS encoder, CASE WHEN codec IN ('prores','hevc10') THEN 6 ELSE 3 END AS pixel_bytes, "
    "CASE codec WHEN 'prores' THEN 'yuv422p10le' WHEN 'hevc10' THEN 'yuv420p10le' ELSE 'yuv420p' END AS pix_fmt, CASE codec WHEN 'prores' THEN 3 END AS profile, "
    "'a/b.c/clip' || event_id || '_graded.' || CASE WHEN codec = 'prores' THEN 'mov' ELSE 'mp4' END AS output FROM m",
)
def _(spark, d):
    n = fx.table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 16 + 1).cast("int")).alias("name"))
    m = n.select("*", media.input_encoding(F.col("name"), strict=False).alias("encoding"), media.output_codec(F.col("name"), strict=False).alias("codec"))
    path = F.concat(F.lit("a/b.c/clip"), F.col("event_id").cast("string"), F.lit(".mkv"))
    return m.select("*", media.encoder_name(F.col("codec")).alias("encoder"), media.bytes_per_pixel(F.col("codec")).alias("pixel_bytes"), media.default_output(path, F.col("codec")).alias("output"), media.encoder_profile(media.encoder_name(F.col("codec")))["pix_fmt"].alias("pix_fmt"), media.encoder_profile(media.encoder_name(F.col("codec")))["profile"].alias("profile"))


@query("q_parse_rational", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN round(event_id / 1001.0::DOUBLE, 6) WHEN 1 THEN 30.0 WHEN 2 THEN 30.0 WHEN 3 THEN event_id::DOUBLE WHEN 4 THEN event_id::DOUBLE ELSE 30.0 END AS fps FROM events")
def _(spark, d):
    e = F.col("event_id").cast("string")
    text = F.element_at(F.array(F.concat(e, F.lit("/1001")), F.lit("x/1"), F.concat(e, F.lit("/0")), F.concat(e, F.lit("/z")), e, F.lit("abc")), (F.col("event_id") % 6 + 1).cast("int"))
    return fx.table(spark, d, "events").select("event_id", F.round(media.parse_rational(text), 6).alias("fps"))


# ---- benchmark analytics ----------------------------------------------------

def _log_frame(spark, d) -> DataFrame:
    """Run logs: run_id and text."""
    k = F.round("value").cast("long")
    num = lambda c, tail: F.concat(c.cast("string"), F.lit(tail))
    text = F.concat(
        F.lit("[filter] 16 frames (53%, 4.7 fps)\n[filter] done: "), (F.col("event_id") % 40 + 5).cast("string"), F.lit(" frames in "), num(k + 1, ".3"), F.lit("s ("), num(k, ".25"), F.lit(" fps)\n"),
        F.lit("[filter] stage timing (busy ms/frame): decode="), num(k, ".4"), F.lit(" gpu_thread="), num(k * 2, ".6"), F.lit(" gpu_kernel="), num(k * 2, ".5"), F.lit(" encode="), num(k, ".1"), F.lit(" wall="), num(k * 3, ".9"), F.lit("\n"),
    )
    return fx.table(spark, d, "events").select(F.col("event_id").alias("run_id"), text.alias("text"))


_LOG_SQL = """WITH k AS (SELECT event_id AS run_id, (event_id % 40 + 5)::INT AS total, round(value)::BIGINT AS k FROM events), e AS (
  SELECT run_id, total, ((k + 1) || '.3')::DOUBLE AS wall, (k || '.25')::DOUBLE AS fps, (k || '.4')::DOUBLE AS dec, (k * 2 || '.6')::DOUBLE AS thread, (k * 2 || '.5')::DOUBLE AS gpu,
    (k || '.1')::DOUBLE AS enc, (k * 3 || '.9')::DOUBLE AS wall_ms FROM k)"""


@query("q_parse_log", _LOG_SQL + " SELECT run_id, total AS total_frames, dec AS decode_thread_wall_ms_per_frame, thread AS gpu_thread_wall_ms_per_frame, gpu AS gpu_kernel_ms_per_frame, enc AS encode_thread_wall_ms_per_frame, wall_ms AS wall_ms_per_frame FROM e")
def _(spark, d):
    return bench.parse_logs(_log_frame(spark, d)).drop("text", "steady_state_fps")


@query("q_steady_fps", _LOG_SQL + " SELECT run_id, round(CASE WHEN total > 8 THEN (total - 8) / greatest(wall - 8.0 * wall_ms / 1000.0, 1e-6) ELSE fps END, 4) AS steady_state_fps FROM e")
def _(spark, d):
    return r6(bench.parse_logs(_log_frame(spark, d)).select("run_id", "steady_state_fps"), "steady_state_fps", digits=4)


# Published 0.975 quantiles of Student's t for 1 to 10 degrees of freedom.
_T975 = (12.7062047362, 4.30265272991, 3.18244630528, 2.7764451052, 2.57058183661, 2.44691184879, 2.36462425101, 2.30600413503, 2.26215716274, 2.22813885196)
_FEW = "few AS (SELECT event_id // 16 AS run, 'value' AS metric, value FROM events WHERE event_id % 16 < 2 + event_id // 16 % 10)"
_AGG = f"WITH {fx.SAMPLES}, a AS (SELECT run, metric, count(*)::INT AS n_samples, avg(value) AS mean, stddev_samp(value) AS stddev, median(value) AS median FROM samples GROUP BY run, metric)"


@query("q_metric_aggregate", _AGG + " SELECT run, metric, n_samples, round(mean, 6) AS mean, round(stddev, 6) AS stddev, round(median, 6) AS median FROM a")
def _(spark, d):
    agg = bench.aggregate_samples(fx.samples(spark, d), ["run", "metric"])
    return r6(agg.drop("ci95_lo", "ci95_hi"), "mean", "stddev", "median")


@query("q_ci95", f"WITH {_FEW}, a AS (SELECT run, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS s FROM few GROUP BY run, metric HAVING count(*) > 1), h AS (SELECT *, [{', '.join(f'{t}::DOUBLE' for t in _T975)}][n - 1] * s / sqrt(n) AS half FROM a) SELECT run, metric, round(mean - half, 5) AS ci95_lo, round(mean + half, 5) AS ci95_hi FROM h")
def _(spark, d):
    """Intervals of 2 to 11 samples; groups of fewer are left out."""
    e = F.col("event_id")
    few = fx.table(spark, d, "events").where(e % 16 < 2 + F.expr("event_id div 16") % 10).select(F.expr("event_id div 16").alias("run"), F.lit("value").alias("metric"), "value")
    return r6(bench.aggregate_samples(few, ["run", "metric"], strict=False).select("run", "metric", "ci95_lo", "ci95_hi"), "ci95_lo", "ci95_hi", digits=5)


@query(
    "q_permutation_test",
    f"""WITH {fx.PAIRED}, splits AS (SELECT unnest(range(256))::INT AS m), stat AS (
  SELECT metric, m, avg(value) FILTER ((m >> i) & 1 = 1) - avg(value) FILTER ((m >> i) & 1 = 0) AS d FROM paired, splits WHERE bit_count(m) = 4 GROUP BY metric, m),
seen AS (SELECT metric, d AS o FROM stat WHERE m = 15)
SELECT metric, round(least(1, 2 * least(avg((d <= o + 1e-9)::INT), avg((d >= o - 1e-9)::INT))), 6) AS p_raw FROM stat JOIN seen USING (metric) GROUP BY metric""",
)
def _(spark, d):
    return r6(bench.compare_runs(fx.paired_runs(spark, d), "a", "b").select("metric", "p_raw"), "p_raw")


_CMP = f"WITH {fx.PAIRED}, c AS (SELECT metric, avg(value) FILTER (run = 'a') AS mean_a, avg(value) FILTER (run = 'b') AS mean_b FROM paired GROUP BY metric)"


@query("q_compare_runs", _CMP + " SELECT metric, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round((mean_b - mean_a) / mean_a * 100, 6) + 0.0 AS delta_pct FROM c")
def _(spark, d):
    out = bench.compare_runs(fx.paired_runs(spark, d), "a", "b").select("metric", "mean_a", "mean_b", "delta_pct")
    return r6(out, "mean_a", "mean_b", "delta_pct")


_PVALUES = "p AS (SELECT event_id AS i, event_type AS family, round((value % 10) / 20000.0::DOUBLE, 9) AS p FROM events)"
_HOLM = f"WITH {_PVALUES}, s AS (SELECT *, least(1, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, i) + 1)) AS a FROM p), h AS (SELECT family, i, p, max(a) OVER (PARTITION BY family ORDER BY p, i ROWS UNBOUNDED PRECEDING) AS p_holm FROM s)"


def _pvalues(spark, d) -> DataFrame:
    return fx.table(spark, d, "events").select(F.col("event_id").alias("i"), F.col("event_type").alias("family"), F.round((F.col("value") % 10) / 20000.0, 9).alias("p"))


@query("q_holm", _HOLM + " SELECT family, i, p, round(p_holm, 9) AS p_holm FROM h")
def _(spark, d):
    return r6(bench.holm(_pvalues(spark, d), "p", "i", ["family"]), "p_holm", digits=9)


@query("q_verdict", _HOLM + " SELECT family, i, CASE WHEN abs(i % 7 - 3) / 2.0 < 1.5 THEN 'EQUIVALENT' WHEN p_holm < 0.01 AND abs(i % 7 - 3) / 2.0 > 1.5 THEN 'DIFFERENT' ELSE 'UNCLEAR' END AS verdict FROM h")
def _(spark, d):
    h = bench.holm(_pvalues(spark, d), "p", "i", ["family"])
    return h.select("family", "i", media.verdict((F.col("i") % 7 - 3) / 2.0, F.col("p_holm")).alias("verdict"))


_STATES = """states AS (SELECT event_type AS run, 'G' || (count(*) % 2) AS gpu_name, '8.' || (sum(event_id)::BIGINT % 2) AS gpu_compute_cap, (550 + count(*) % 2) || '.' || (sum(event_id)::BIGINT % 3) || '.' || (max(event_id) % 5) AS driver_version,
  '12.' || (min(event_id) % 2) AS cuda_version, '2.' || (max(user_id) % 2) AS torch_version, CASE WHEN count(*) % 3 = 0 THEN '10.' || (count(*) % 7) END AS trt_version FROM events GROUP BY event_type)"""
_HW = f"""WITH {_STATES}, p AS (SELECT a.run AS run_a, b.run AS run_b, a AS x, b AS y FROM states a JOIN states b ON a.run < b.run),
f AS (SELECT run_a, run_b, unnest(['gpu_name', 'gpu_compute_cap', 'driver_major', 'driver_patch', 'cuda_version', 'torch_version', 'trt_version']) AS field,
  unnest([x.gpu_name, x.gpu_compute_cap, regexp_extract(x.driver_version, '^\\d+\\.\\d+'), x.driver_version, x.cuda_version, x.torch_version, x.trt_version]) AS value_a,
  unnest([y.gpu_name, y.gpu_compute_cap, regexp_extract(y.driver_version, '^\\d+\\.\\d+'), y.driver_version, y.cuda_version, y.torch_version, y.trt_version]) AS value_b,
  regexp_extract(x.driver_version, '^\\d+\\.\\d+') = regexp_extract(y.driver_version, '^\\d+\\.\\d+') AS major FROM p)
SELECT run_a, run_b, field, value_a, value_b, CASE WHEN field IN ('gpu_name', 'gpu_compute_cap', 'driver_major') THEN 'fatal' ELSE 'advisory' END AS severity
FROM f WHERE value_a IS DISTINCT FROM value_b AND (field <> 'driver_patch' OR major)"""


@query("q_hw_diff", _HW)
def _(spark, d):
    """The machines of every two of five runs, made from the events of each type."""
    e = fx.table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(
        F.count("*").alias("n"), F.sum("event_id").alias("s"), F.max("event_id").alias("hi"), F.min("event_id").alias("lo"), F.max("user_id").alias("u")
    )
    states = e.select(
        "run", F.format_string("G%d", F.col("n") % 2).alias("gpu_name"), F.format_string("8.%d", F.col("s") % 2).alias("gpu_compute_cap"),
        F.format_string("%d.%d.%d", 550 + F.col("n") % 2, F.col("s") % 3, F.col("hi") % 5).alias("driver_version"), F.format_string("12.%d", F.col("lo") % 2).alias("cuda_version"),
        F.format_string("2.%d", F.col("u") % 2).alias("torch_version"), F.when(F.col("n") % 3 == 0, F.format_string("10.%d", F.col("n") % 7)).alias("trt_version"),
    )
    runs = sorted(r.run for r in states.select("run").collect())  # one row a run
    out = None
    for i, a in enumerate(runs):
        for b in runs[i + 1 :]:
            found = bench.hardware_diff(states, a, b).select(F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), "field", "value_a", "value_b", "severity")
            out = found if out is None else out.unionByName(found)
    return out


@query("q_pct_delta", "SELECT event_id, CASE WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN 0.0::DOUBLE WHEN event_id % 5 = 0 THEN 1e300::DOUBLE ELSE round((event_id % 3 - event_id % 5) / (event_id % 5)::DOUBLE * 100, 6) + 0.0 END AS delta_pct FROM events")
def _(spark, d):
    e = F.col("event_id")
    v = media.pct_delta((e % 5).cast("double"), (e % 3).cast("double"))
    return fx.table(spark, d, "events").select("event_id", (F.round(F.least(v, F.lit(1e300)), 6) + 0.0).alias("delta_pct"))


@query("q_stage_means", "SELECT event_type, round(sum(value) / count(*), 6) AS ms_per_frame, round(count(*) * 100.0 / 20000, 6) AS pct FROM events GROUP BY event_type")
def _(spark, d):
    g = fx.table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("busy"), F.count("*").alias("n"))
    return g.select("event_type", F.round(media.per_frame_ms(F.col("busy"), F.col("n")), 6).alias("ms_per_frame"), F.round(media.progress_pct(F.col("n"), F.lit(20000)), 6).alias("pct"))


@query("q_pcie_health", "SELECT event_id, CASE event_id % 5 WHEN 3 THEN value >= 12.0::DOUBLE * 0.8::DOUBLE WHEN 4 THEN value >= 25.0::DOUBLE * 0.8::DOUBLE ELSE true END AS healthy FROM events")
def _(spark, d):
    return fx.table(spark, d, "events").select("event_id", media.pcie_healthy(F.col("event_id") % 5, F.col("value")).alias("healthy"))


_FAN = ", ".join(f"'{m}'" for m in bench.METRICS)


@query(
    "q_metric_fanout",
    f"WITH w AS (SELECT event_type AS run, [{', '.join(f'round(value * {k}, 6)' for k in range(1, 7))}] AS vs FROM events), l AS (SELECT run, unnest([{_FAN}]) AS metric, unnest(vs) AS value FROM w) "
    "SELECT run, metric, count(*)::INT AS n_samples, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM l GROUP BY run, metric",
)
def _(spark, d):
    """Wide samples, one column a metric, fanned out and aggregated in one go."""
    wide = fx.table(spark, d, "events").select("event_id", F.col("event_type").alias("run"), *[F.round(F.col("value") * k, 6).alias(m) for k, m in enumerate(bench.METRICS, 1)])
    agg = bench.aggregate_samples(bench.long_samples(wide, ["event_id", "run"]), ["run", "metric"])
    return r6(agg.select("run", "metric", "n_samples", "mean", "median"), "mean", "median")


@query("q_sample_refusals", "WITH g AS (SELECT user_id AS run, count(*)::INT AS n_samples, avg(value) AS mean, bool_or(event_id % 97 = 0 OR event_id % 89 = 0) AS odd FROM events GROUP BY user_id) SELECT run, n_samples, round(mean, 6) AS mean FROM g WHERE n_samples > 1 AND NOT odd")
def _(spark, d):
    """groups of one sample, or with one that is no finite number, are left out."""
    e = F.col("event_id")
    value = F.when(e % 97 == 0, F.lit(float("nan"))).when(e % 89 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    agg = bench.aggregate_samples(fx.table(spark, d, "events").select(F.col("user_id").alias("run"), value.alias("value")), ["run"], strict=False)
    return r6(agg.select("run", "n_samples", "mean"), "mean")


@query("q_permutation_random", "SELECT 'm' || event_id // 40 AS metric, CASE WHEN event_id // 40 % 2 = 0 THEN 0.0002 ELSE 1.0 END::DOUBLE AS p_raw FROM events GROUP BY event_id // 40 HAVING count(*) = 40")
def _(spark, d):
    """U07 beyond 9,999 splits: of 20 samples a side, far apart (no random split comes near) or all alike (all do)."""
    e = F.col("event_id")
    rows = fx.table(spark, d, "events")
    value = F.when(F.expr("event_id div 40") % 2 == 0, F.col("value") + F.when(e % 2 == 0, 1e6).otherwise(0.0)).otherwise(F.lit(1.0))
    pairs = rows.select(F.concat(F.lit("m"), F.expr("event_id div 40").cast("string")).alias("metric"), F.when(e % 2 == 0, "a").otherwise("b").alias("run"), value.alias("value"))
    whole = pairs.groupBy("metric").count().where("count = 40").select("metric")
    return bench.compare_runs(pairs.join(whole, "metric"), "a", "b").select("metric", "p_raw")


@query("q_bandwidth", "SELECT event_id, round((event_id + 1) * 4096.0::DOUBLE / (user_id + 1) / 1e9::DOUBLE, 12) AS gbps FROM events")
def _(spark, d):
    """P24."""
    rate = media.bandwidth_gbps((F.col("event_id") + 1) * 4096.0, (F.col("user_id") + 1).cast("double"))
    return fx.table(spark, d, "events").select("event_id", F.round(rate, 12).alias("gbps"))


@query("q_verdict_label", _HOLM + " SELECT family, i, CASE WHEN abs(i % 7 - 3) / 2.0 < 1.5 THEN '≈ (within ROPE)' WHEN p_holm < 0.01 AND abs(i % 7 - 3) / 2.0 > 1.5 THEN '**DIFFERENT**' ELSE 'unclear' END AS label FROM h")
def _(spark, d):
    """X16."""
    h = bench.holm(_pvalues(spark, d), "p", "i", ["family"])
    return h.select("family", "i", media.verdict_label(media.verdict((F.col("i") % 7 - 3) / 2.0, F.col("p_holm"))).alias("label"))


# ---- strings, hashes, bytes -------------------------------------------------


@query("q_cache_key", """SELECT doc_id, substring(sha256('{"batch": ' || doc_id % 8 || ', "fp16": ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "h": 540, "onnx": "' || sha256(text) || '", "sm": "8.6", "trt": "10.9.0", "w": 960}'), 1, 16) AS key FROM documents""")
def _(spark, d):
    key = media.engine_cache_key(F.col("doc_id") % 8, F.col("doc_id") % 2 == 0, F.lit(540), F.sha2("text", 256), F.lit("8.6"), F.lit("10.9.0"), F.lit(960))
    return fx.table(spark, d, "documents").select("doc_id", key.alias("key"))


@query("q_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("digest"))


# bytes from the text's hex, and the polynomial's table from eight single steps
_CRC = """WITH RECURSIVE t(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS steps FROM t WHERE k = 8),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) AS crc,
  (1 + coalesce(list_sum(b), 0)::BIGINT) % 65521 + 65536 * ((len(b) + coalesce(list_sum(list_transform(b, lambda x, i: x * (len(b) - i + 1))), 0)::BIGINT) % 65521) AS adler FROM bytes, crc_table"""


@query("q_crc32", _CRC)
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.crc32(F.encode("text", "utf-8")).alias("crc"), protocol.adler32(F.encode("text", "utf-8")).alias("adler"))


@query("q_base64", "SELECT doc_id, md5(replace(to_base64(encode(text)), chr(10), '')) AS b64, text AS back FROM documents")
def _(spark, d):
    b = F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"[\r\n]", "")
    return fx.table(spark, d, "documents").select("doc_id", F.md5(b).alias("b64"), F.decode(F.unbase64(b), "utf-8").alias("back"))


@query("q_safe_label", "SELECT doc_id, coalesce(nullif(regexp_replace(text, '[^a-zA-Z0-9_-]', '_', 'g'), ''), 'unlabeled') AS label FROM documents")
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", media.safe_label(F.col("text")).alias("label"))


@query("q_result_name", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') || '_abc123_' || event_type || '_' || event_id || '.json' AS file_name FROM events")
def _(spark, d):
    return fx.table(spark, d, "events").select("event_id", media.result_name(F.col("ts"), F.lit("abc123"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).alias("file_name"))


@query("q_major_driver", "SELECT event_id, (event_id % 900) || '.' || (event_id % 77) AS major FROM events")
def _(spark, d):
    e = F.col("event_id")
    return fx.table(spark, d, "events").select("event_id", media.major_driver(F.concat_ws(".", (e % 900).cast("string"), (e % 77).cast("string"), F.lit("14"))).alias("major"))


# ---- sequences --------------------------------------------------------------


@query("q_batching", "SELECT event_id, event_type, pts, pts // 8 AS batch FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pts FROM events)")
def _(spark, d):
    e = fx.table(spark, d, "events").select("event_id", "event_type")
    return frame_files.batches(frame_files.renumber(e, ["event_type"], "event_id"), ["event_type"], 8, "event_id")


@query("q_progress", "SELECT event_id, event_type, done FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS done FROM events) WHERE done % 32 = 0")
def _(spark, d):
    return frame_files.progress_rows(fx.table(spark, d, "events").select("event_id", "event_type"), ["event_type"], 8, order="event_id")


@query("q_tail", "SELECT event_id, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 50")
def _(spark, d):
    return bench.tail_lines(fx.table(spark, d, "events").select("event_id", "event_type", "props"), 50, ["event_type"], "event_id")


@query("q_warmup_exclusion", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn > 8 GROUP BY event_type")
def _(spark, d):
    e = frame_files.renumber(fx.table(spark, d, "events"), ["event_type"], "event_id")
    return e.where("pts >= 8").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("q_split_records", "SELECT doc_id AS clip_id, i AS frame_id, md5(encode(text)[i * 100 + 1:(i + 1) * 100]) AS digest FROM (SELECT doc_id, text, unnest(range(octet_length(encode(text)) // 100)) AS i FROM documents)")
def _(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("clip_id"), F.encode("text", "utf-8").alias("payload"))
    return frame_files.split_records(docs, 100).select("clip_id", "frame_id", F.md5("pixels").alias("digest"))


@query("q_frame_at", "SELECT event_type AS clip_id, min(event_id) AS frame_id FROM events WHERE event_id >= ceil(3.5 * 24) GROUP BY event_type")
def _(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("clip_id"), F.col("event_id").alias("frame_id"))
    return frame_files.frame_at(e, 3.5, 24.0)


@query("q_first_error", "SELECT event_type, arg_min(props, ts) AS props FROM events GROUP BY event_type")
def _(spark, d):
    return fx.table(spark, d, "events").groupBy("event_type").agg(F.min_by("props", "ts").alias("props"))


@query("q_config_resolve", """SELECT c.i AS cli, f.i AS file, coalesce(c.batch_size, f.batch_size, 8)::INT AS batch_size, coalesce(c.proxy_size, f.proxy_size, 1440)::INT AS proxy_size, coalesce(c.output_codec, f.output_codec) AS output_codec, coalesce(c.scene_threshold, f.scene_threshold, 0.15)::DOUBLE AS scene_threshold
FROM (VALUES (0, NULL, NULL, NULL, NULL), (1, 6, NULL, NULL, 0.5), (2, NULL, 960, 'h264', NULL), (3, 1, 518, 'prores', 0.25)) c(i, batch_size, proxy_size, output_codec, scene_threshold),
  (VALUES (0, NULL, NULL, NULL, NULL), (1, 4, NULL, 'hevc10', NULL), (2, NULL, 720, NULL, 0.125), (3, 2, 640, 'h264', 0.75)) f(i, batch_size, proxy_size, output_codec, scene_threshold)""")
def _(spark, d):
    """Every two of four command lines and four files, resolved."""
    names = ("batch_size", "proxy_size", "output_codec", "scene_threshold")
    cli = [(None, None, None, None), (6, None, None, 0.5), (None, 960, "h264", None), (1, 518, "prores", 0.25)]
    file = [(None, None, None, None), (4, None, "hevc10", None), (None, 720, None, 0.125), (2, 640, "h264", 0.75)]
    rows = []
    for i, c in enumerate(cli):
        for k, f in enumerate(file):
            got = resolve(dict(zip(names, c, strict=True)), {n: v for n, v in zip(names, f, strict=True) if v is not None} | {"unknown": 1})
            rows.append((i, k, got.batch_size, got.proxy_size, got.output_codec, got.scene_threshold))
    return spark.createDataFrame(rows, "cli int, file int, batch_size int, proxy_size int, output_codec string, scene_threshold double")


# ---- messages ---------------------------------------------------------------


def _messages(spark, d) -> DataFrame:
    e = F.col("event_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (e % len(xs) + 1).cast("int"))
    known = {k: v for k, v in protocol.RESPONSES.items() if v}
    req = F.concat(F.lit('{"type":"'), pick(*known), F.lit('","id":"r'), e.cast("string"), F.lit('"}'))
    res = F.concat(F.lit('{"type":"'), pick(*known.values()), F.lit('","message":"m"}'))
    res = F.when(e % 13 == 0, F.lit('{"type":"error","message":"bad"}')).when(e % 17 == 0, F.lit("")).when(e % 19 == 0, F.lit('{"type":"odd"}')).otherwise(res)
    req = F.when(e % 23 == 0, F.lit('{"type":"what"}')).when(e % 29 == 0, F.lit('{"type":"shutdown"}')).when(e % 31 == 0, F.lit('{"type":"load_yolo_seg","model_path":"m"}')).otherwise(req)
    return fx.table(spark, d, "events").select(e.alias("msg_id"), req.alias("request"), res.alias("response"))


_OUTCOME = (
    "CASE WHEN event_id % 23 <> 0 AND event_id % 29 = 0 THEN CASE WHEN event_id % 13 <> 0 AND event_id % 17 = 0 THEN 'ok' ELSE 'unexpected' END WHEN event_id % 13 = 0 THEN 'error' WHEN event_id % 17 = 0 THEN 'crashed' "
    "WHEN event_id % 23 = 0 THEN 'unknown' WHEN event_id % 31 = 0 OR event_id % 12 = 8 THEN 'ok' WHEN event_id % 19 = 0 THEN 'unexpected' ELSE 'ok' END"
)


@query("q_protocol_dispatch", f"SELECT msg_id, outcome, CASE WHEN outcome = 'error' THEN 'ServerError' WHEN outcome <> 'ok' THEN 'Ipc' END AS error_kind FROM (SELECT event_id AS msg_id, {_OUTCOME} AS outcome FROM events)")
def _(spark, d):
    return protocol.dispatch(_messages(spark, d)).select("msg_id", "outcome", "error_kind")


@query("q_protocol_correlate", "SELECT event_id AS msg_id, i AS place, 'x' || i AS id, (event_id + i) % 5 = 0 AS missing, CASE WHEN (event_id + i) % 5 <> 0 THEN event_id + i END AS out_v FROM events, (SELECT unnest([0, 1, 2])::INT AS i)")
def _(spark, d):
    e = F.col("event_id")
    base = fx.table(spark, d, "events").select(e.alias("msg_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    ident = F.concat(F.lit("x"), F.col("i").cast("string"))
    items = base.select("msg_id", F.col("i").alias("place"), ident.alias("id"))
    results = base.where((F.col("msg_id") + F.col("i")) % 5 != 0).select("msg_id", ident.alias("id"), (F.col("msg_id") + F.col("i")).alias("v"))
    return protocol.correlate(items, results)


@query("q_protocol_items", "SELECT event_id AS msg_id, i AS place, 'i' || i AS id, (event_id % 9 + 1)::INT AS width FROM events, (SELECT unnest([0, 1])::INT AS i)")
def _(spark, d):
    w = (F.col("event_id") % 9 + 1).cast("string")
    item = lambda k: F.concat(F.lit(f'{{"id":"i{k}","width":'), w, F.lit(',"height":2}'))
    text = F.concat(F.lit('{"type":"depth_batch","items":['), item(0), F.lit(","), item(1), F.lit("]}"))
    return protocol.explode_items(fx.table(spark, d, "events").select(F.col("event_id").alias("msg_id"), text.alias("request"))).select("msg_id", "place", "id", "width")


@query("q_protocol_rejects", "SELECT event_id AS msg_id, CASE WHEN event_id % 11 = 0 THEN 'type' WHEN event_id % 7 = 0 THEN 'size' ELSE 'payload' END AS reason FROM events WHERE event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 5 = 0")
def _(spark, d):
    e = F.col("event_id")
    body = F.base64(F.when(e % 5 == 0, F.lit("abc")).otherwise(F.lit("x" * 24)).cast("binary"))
    kind = F.when(e % 11 == 0, "pong").otherwise("enhance_result")
    width = F.when(e % 7 == 0, "8").otherwise("4")
    res = F.concat(F.lit('{"type":"'), kind, F.lit('","width":'), width, F.lit(',"height":2,"image_b64":"'), body, F.lit('"}'))
    events = fx.table(spark, d, "events")
    return protocol.rejects(events.select(e.alias("msg_id"), res.alias("response")), events.select(e.alias("msg_id"), F.lit(4).alias("width"), F.lit(2).alias("height")))


@query("q_png_decode", f"WITH {fx.TILE}, g AS (SELECT frame_id, y, x, floor(least(greatest(v * 200 + 128, 0), 255))::INT AS r FROM tile) SELECT frame_id, y, x, r * 257 AS r16, (255 - r) * 257 AS g16, (r * 7 % 256) * 257 AS b16 FROM g")
def _(spark, d):
    """Tiles written as images with every row filter and read back."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("binary")
    def image(v: pd.Series) -> pd.Series:
        red = v.map(lambda x: np.clip(np.asarray(x, np.float64) * 200 + 128, 0, 255).astype(np.uint8).reshape(8, 8))
        return red.map(lambda r: protocol.encode_png(np.stack([r, 255 - r, r * np.uint8(7)], 2), [4, 3, 1, 2, 0, 3, 4, 4]))

    made = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), protocol.png_pixels(image("embedding")).alias("i"))
    return packed.pixels_of(made.select(F.lit("png").alias("clip_id"), "frame_id", "i.width", "i.height", "i.pixels")).drop("clip_id")


@query("q_f32_values", "SELECT vec_id, round(list_sum([x::DOUBLE FOR x IN embedding]), 4) + 0.0 AS total FROM embeddings")
def _(spark, d):
    import numpy as np
    import pandas as pd

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, "<f4").tobytes())

    values = fx.table(spark, d, "embeddings").select("vec_id", protocol.f32_values(packed("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return values.select("vec_id", (F.round(total, 4) + 0.0).alias("total"))


# ---- streams ----------------------------------------------------------------


def _ended(spark, root: str, out: DataFrame) -> DataFrame:
    """The stream's output; its inputs and its state are deleted."""
    for part in ("in", "state"):
        remove_folder(spark, f"{root}/{part}")
    return out


def _staged(spark, df: DataFrame, name: str, parts: int, order: str = "frame_id") -> tuple[str, str]:
    """A shared folder with the rows as files, written one after another in order, and one for the stream's state."""
    import uuid

    root = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is None:
        df.write.parquet(f"{root}/in")
    else:
        step = (hi - lo) / parts
        for k in range(parts):
            later = F.col(order) >= F.lit(lo + k * step) if k else F.lit(True)
            before = F.col(order) < F.lit(lo + (k + 1) * step) if k < parts - 1 else F.lit(True)
            df.where(later & before).sort(order).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return root, f"{root}/state"


@query("q_stream_transfer", SQL["q_oklab_transfer"])
def _(spark, d):
    """The flagship in micro-batches of files; each batch meets the delta in the stream's own join."""
    from ..streaming import frames as streams

    px = fx.px(spark, d)
    root, state = _staged(spark, px, "transfer", 4)
    stream = transfer.transfer(streams.stream_rows(spark, f"{root}/in", px.schema), fx.delta(spark, d))
    streams.run_to_end(stream.select(*KEY, "r16", "g16", "b16"), streams.parquet_sink(f"{root}/out"), state)
    return _ended(spark, root, spark.read.parquet(f"{root}/out").drop("batch"))


_CLIPS = SQL["q_hist_distance"].replace("FROM events", "FROM events WHERE event_id // 64 % 3 = {k}").replace("SELECT frame_id, round(distance, 6) AS distance FROM dist", "SELECT 'c{k}' AS clip_id, frame_id, round(distance, 6) AS distance FROM dist WHERE distance > 0.15")


@query("q_stream_scene_cuts", " UNION ALL ".join(f"({_CLIPS.format(k=k)})" for k in range(3)))
def _(spark, d):
    """Three clips, a file of each stretch of time at a trigger; every clip's last histogram is carried from batch to batch."""
    from ..streaming import frames as streams

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = scene.histogram_arrays(fx.scene_px(spark, d)).withColumn("clip_id", F.concat(F.lit("c"), (F.col("frame_id") % 3).cast("string")))
    root, state = _staged(spark, rows, "cuts", 3)
    cuts = streams.stream_cuts(streams.stream_rows(spark, f"{root}/in", rows.schema, files_per_trigger=1))
    streams.run_to_end(cuts, streams.parquet_sink(f"{root}/out"), state)
    return r6(_ended(spark, root, spark.read.schema("clip_id string, frame_id long, distance double").parquet(f"{root}/out").drop("batch")), "distance")


# a day's count is final once the watermark, a day behind the greatest time seen, has passed its end; what comes for it later is left out
_LATE = """e AS (SELECT ts, event_type, event_id % 40 = 0 AND ts < (SELECT min(ts) + INTERVAL 5 DAY FROM events) AS late FROM events)
SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, event_type, count(*) AS n FROM e WHERE NOT late GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM e)"""


@query("x_stream_windows", "WITH " + _LATE)
def _(spark, d):
    """Daily counts by event time under a watermark; rows of the first days that come last are late."""
    from ..streaming import frames as streams

    e = fx.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    first = e.agg(F.min("ts")).first()[0]
    late = (F.col("event_id") % 40 == 0) & (F.col("ts") < F.lit(first) + F.expr("interval 5 days"))
    at = F.when(late, F.lit(2.0**40)).otherwise(F.unix_micros("ts") / 1e6)
    rows = e.withColumn("at", F.when(late, F.lit(None).cast("double")).otherwise(at))
    last = rows.agg(F.max("at")).first()[0]
    arriving = rows.withColumn("at", F.coalesce("at", F.lit(last + (last - first.timestamp()) / 3)))
    root, state = _staged(spark, arriving, "windows", 4, "at")
    stream = streams.stream_rows(spark, f"{root}/in", arriving.schema)
    counts = streams.event_counts(stream, "ts", ["event_type"], "1 day", "1 day")
    streams.run_to_end(counts.select(F.col("w.start").cast("timestamp_ntz").alias("w"), "event_type", "n"), streams.parquet_sink(f"{root}/out"), state)
    return _ended(spark, root, spark.read.schema("w timestamp_ntz, event_type string, n long").parquet(f"{root}/out").drop("batch"))


# ---- historical grading -----------------------------------------------------

SIZE, BOUNDS = 3, [0.0, 0.3, 0.6, 1.0]


def _lut(spark) -> DataFrame:
    points = lut.lattice(spark, SIZE, len(BOUNDS) - 1)
    z = F.col("zone") + 1
    return points.select("zone", "ri", "gi", "bi", *[(F.col(f"{c}i") / 2.0 * (F.lit(1.0) - z * k)).alias(f"l{c}") for c, k in zip("rgb", (0.02, 0.05, 0.08), strict=True)])


_LUT = "lut AS (SELECT z AS zone, r AS ri, g AS gi, b AS bi, r / 2.0::DOUBLE * (1 - (z + 1) * 0.02::DOUBLE) AS lr, g / 2.0::DOUBLE * (1 - (z + 1) * 0.05::DOUBLE) AS lg, b / 2.0::DOUBLE * (1 - (z + 1) * 0.08::DOUBLE) AS lb FROM (SELECT unnest([0,1,2]) AS z), (SELECT unnest([0,1,2]) AS r), (SELECT unnest([0,1,2]) AS g), (SELECT unnest([0,1,2]) AS b))"


def _depth_px(spark, d) -> DataFrame:
    """Pixels of px with r, g, b and a depth from their place."""
    return transfer.to_unit(fx.px(spark, d)).select(*KEY, "r", "g", "b", ((F.col("y") * 8 + F.col("x")) / 63.0).alias("depth"))


# the table is linear in each channel, so its trilinear samples are too
_ZONED = f"""WITH {fx.PX}, p AS (SELECT frame_id, y, x, r16 / 65535.0::DOUBLE AS r, g16 / 65535.0::DOUBLE AS g, b16 / 65535.0::DOUBLE AS b, (y * 8 + x) / 63.0::DOUBLE AS depth FROM px),
w AS (SELECT *, greatest(1 - abs(depth - 0.15) / 0.3, 0)::DOUBLE AS w0, greatest(1 - abs(depth - 0.45) / 0.3, 0)::DOUBLE AS w1, greatest(1 - abs(depth - 0.8) / 0.4, 0)::DOUBLE AS w2 FROM p),
z AS (SELECT *, w0 + w1 + w2 AS tw, (w0 * 1 + w1 * 2 + w2 * 3) / nullif(w0 + w1 + w2, 0) AS m FROM w)"""


@query("h_lattice", "SELECT (i // 27)::INT AS zone, (i // 9 % 3)::INT AS ri, (i // 3 % 3)::INT AS gi, (i % 3)::INT AS bi FROM (SELECT unnest(range(81)) AS i)")
def _(spark, d):
    return lut.lattice(spark, 3, 3)


@query("h_zone_lut", _ZONED + " SELECT frame_id, y, x, round(CASE WHEN tw > 1e-6 THEN r * (1 - m * 0.02) ELSE r END, 5) AS r, round(CASE WHEN tw > 1e-6 THEN g * (1 - m * 0.05) ELSE g END, 5) AS g, round(CASE WHEN tw > 1e-6 THEN b * (1 - m * 0.08) ELSE b END, 5) AS b FROM z")
def _(spark, d):
    return r6(lut.apply_zone_lut(_depth_px(spark, d), _lut(spark), SIZE, BOUNDS, KEY).drop("depth"), "r", "g", "b", digits=5)


_HSV = """WITH {px}, {unit}, t AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS c FROM unit),
hsv AS (SELECT frame_id, y, x, CASE WHEN c < 1e-6 THEN 0.0::DOUBLE ELSE ((CASE WHEN v = r THEN (g - b) / c WHEN v = g THEN (b - r) / c + 2 ELSE (r - g) / c + 4 END * 60) % 360 + 360) % 360 END AS h, CASE WHEN v > 1e-6 THEN c / v ELSE 0.0::DOUBLE END AS s, v FROM t)""".format(px=fx.PX, unit=UNIT)


def _back(h: str, s: str, v: str, n: int) -> str:
    k = f"(({n} + {h} / 60.0) % 6)"
    return f"({v} - {v} * {s} * greatest(0, least({k}, 4 - {k}, 1)))"


_QUAL = (
    _HSV + ", m AS (SELECT *, abs(((h - 210) % 360 + 360) % 360) AS d0 FROM hsv), q AS (SELECT *, CASE WHEN s < 0.08 THEN 0 ELSE greatest(1 - least(d0, 360 - d0) / 40.0, 0) END AS k FROM m), "
    "o AS (SELECT frame_id, y, x, ((h + 12 * k) % 360 + 360) % 360 AS h, least(greatest(s * (1 + 0.2 * k), 0), 1) AS s, least(greatest(v - 0.05 * k, 0), 1) AS v FROM q) "
)


@query("h_hsl", _QUAL + f"SELECT frame_id, y, x, round({_back('h', 's', 'v', 5)}, 5) AS r, round({_back('h', 's', 'v', 3)}, 5) AS g, round({_back('h', 's', 'v', 1)}, 5) AS b FROM o")
def _(spark, d):
    q = [lut.Qualifier()] * 4 + [lut.Qualifier(12.0, 1.2, -0.05, 200.0)]
    return r6(lut.apply_qualifiers(transfer.to_unit(fx.px(spark, d)).select(*KEY, "r", "g", "b"), q), "r", "g", "b", digits=5)


@query("h_hsv_roundtrip", f"WITH {fx.PX}, {UNIT} SELECT frame_id, y, x, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b FROM unit")
def _(spark, d):
    u = transfer.to_unit(fx.px(spark, d)).select(*KEY, "r", "g", "b")
    h, s, v = color.hsv(*map(F.col, "rgb"))
    staged = u.select(*KEY, h.alias("h"), s.alias("s"), v.alias("v"))
    r, g, b = color.rgb_of_hsv(*map(F.col, "hsv"))
    return r6(staged.select(*KEY, r.alias("r"), g.alias("g"), b.alias("b")), "r", "g", "b", digits=5)


_CIE = (
    "c2 AS (SELECT frame_id, y, x, " + ", ".join(f"{_sum(row, ['lr', 'lg', 'lb'])} / {w} AS t{i}" for i, (row, w) in enumerate(zip(color.RGB_TO_XYZ, color.WHITE, strict=True)))
    + " FROM (SELECT frame_id, y, x, " + ", ".join(f"{_lin(c)} AS l{c}" for c in "rgb") + " FROM unit)), c3 AS (SELECT frame_id, y, x, "
    + ", ".join(f"CASE WHEN t{i} > 0.008856 THEN cbrt(t{i}) ELSE t{i} / 0.128419 + 4.0 / 29 END AS f{i}" for i in range(3)) + " FROM c2)"
)


@query("h_cielab", f"WITH {fx.PX}, {UNIT}, {_CIE} SELECT frame_id, y, x, round(116 * f1 - 16, 4) + 0.0 AS l, round(500 * (f0 - f1), 4) + 0.0 AS a, round(200 * (f1 - f2), 4) + 0.0 AS b FROM c3")
def _(spark, d):
    """X24's space: CIELab of every pixel."""
    u = transfer.to_unit(fx.px(spark, d)).select(*KEY, "r", "g", "b")
    return r6(color.with_cielab(u, ("r", "g", "b"), ("l_", "a_", "b_")).select(*KEY, F.col("l_").alias("l"), F.col("a_").alias("a"), F.col("b_").alias("b")), "l", "a", "b", digits=4)


@query("h_cielab_roundtrip", f"WITH {fx.PX}, {UNIT} SELECT frame_id, y, x, round(r * 255)::INT AS r, round(g * 255)::INT AS g, round(b * 255)::INT AS b FROM unit")
def _(spark, d):
    """There and back, to the nearest 8-bit value of the pixel itself."""
    u = transfer.to_unit(fx.px(spark, d)).select(*KEY, "r", "g", "b")
    there = color.with_cielab(u, ("r", "g", "b"), ("l_", "a_", "b_"))
    back = color.with_rgb_from_cielab(there.select(*KEY, "l_", "a_", "b_"), ("l_", "a_", "b_"), ("r", "g", "b"))
    return back.select(*KEY, *[F.round(F.col(c) * 255).cast("int").alias(c) for c in "rgb"])


def _tone_sql(strength: float = 0.9, digits: int = 4) -> str:
    """H03 and H04 in SQL over p (key, r, g, b, depth): warmth 1.1, contrast 1.1."""
    shape = lambda t: f"CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE {t} / 0.128419 + 4.0 / 29 END"
    back = lambda t: f"CASE WHEN {t} > 6.0 / 29 THEN {t} * {t} * {t} ELSE 0.128419 * ({t} - 4.0 / 29) END"
    keep = "frame_id, y, x, r AS r0, g AS g0, b AS b0, depth"
    key = "frame_id, y, x, r0, g0, b0, depth"
    xyz = ", ".join(f"{_sum(row, ['lr', 'lg', 'lb'])} / {w} AS t{i}" for i, (row, w) in enumerate(zip(color.RGB_TO_XYZ, color.WHITE, strict=True)))
    lin = ", ".join(f"greatest({_sum(row, ['cx', 'cy', 'cz'])}, 0) AS v{c}" for c, row in zip("rgb", color.XYZ_TO_RGB, strict=True))
    knee = lambda c: f"CASE WHEN {c} > 0.92 THEN 0.92 + 0.08 * tanh(({c} - 0.92) / 0.08) ELSE {c} END"
    return (
        f"a1 AS (SELECT {keep}, {', '.join(f'{_lin(c)} AS l{c}' for c in 'rgb')} FROM p), a2 AS (SELECT {key}, {xyz} FROM a1), "
        f"a3 AS (SELECT {key}, {', '.join(f'{shape(f"t{i}")} AS f{i}' for i in range(3))} FROM a2), "
        f"a4 AS (SELECT {key}, (116 * f1 - 16) / 100 AS l, 500 * (f0 - f1) AS a, 200 * (f1 - f2) AS b FROM a3), "
        f"a5 AS (SELECT {key}, l + least(greatest((0.15 - l) / 0.15, 0), 1) * (0.2 + 0.15 * depth) * 0.15 AS l, a, b, (0.3 + 0.3 * depth) * 1.1 AS cs FROM a4), "
        f"a6 AS (SELECT {key}, l + (1 / (1 + exp(-(l - 0.5) * (4 + 4 * cs))) - l) * cs AS l, a, b FROM a5), "
        f"a7 AS (SELECT {key}, CASE WHEN l > 0.88 THEN 0.88 + 0.12 * tanh((l - 0.88) / 0.12 * (1.4 + 0.2 * (1 - depth))) ELSE l END AS l, a, b FROM a6), "
        f"a8 AS (SELECT {key}, l, a + (1 + 5 * depth) * 4 * l * (1 - l) AS a, b + 4 * depth * 4 * l * (1 - l) AS b FROM a7), "
        f"a9 AS (SELECT {key}, l, a, b, (1 + (0.4 + 0.5 * depth) * (1 - least(sqrt(a * a + b * b + 1e-8) / 40, 1)) * least(l / 0.25, 1)) * 1.03 AS k FROM a8), "
        f"b1 AS (SELECT {key}, least(greatest(l * 100, 0), 100) AS l, least(greatest(a * k, -128), 127) AS a, least(greatest(b * k, -128), 127) AS b FROM a9), "
        f"b2 AS (SELECT {key}, (l + 16) / 116 AS f1, a / 500 + (l + 16) / 116 AS f0, (l + 16) / 116 - b / 200 AS f2 FROM b1), "
        f"b3 AS (SELECT {key}, 0.95047 * ({back('f0')}) AS cx, {back('f1')} AS cy, 1.08883 * ({back('f2')}) AS cz FROM b2), b4 AS (SELECT {key}, {lin} FROM b3), "
        f"b5 AS (SELECT {key}, {', '.join(f'least(greatest({_srgb("v" + c)}, 0), 1) AS {c}' for c in 'rgb')} FROM b4) "
        f"SELECT frame_id, y, x, {', '.join(f'round({c}0 * {1 - strength:.12g} + least(greatest({knee(c)}, 0), 1) * {strength}, {digits}) AS {c}' for c in 'rgb')} FROM b5"
    )


_P = "p AS (SELECT frame_id, y, x, r16 / 65535.0::DOUBLE AS r, g16 / 65535.0::DOUBLE AS g, b16 / 65535.0::DOUBLE AS b, (y * 8 + x) / 63.0::DOUBLE AS depth FROM px)"
PARAMS = lut.GradeParams(warmth=1.1, strength=0.9, contrast=1.1)


@query("h_tone", f"WITH {fx.PX}, {_P}, {_tone_sql()}")
def _(spark, d):
    px = _depth_px(spark, d).withColumns({f"{c}0": F.col(c) for c in "rgb"})
    toned = lut.blend(lut.apply_tone(px, PARAMS), PARAMS.strength, ("r0", "g0", "b0"))
    return r6(toned.select(*KEY, "r", "g", "b"), "r", "g", "b", digits=4)


_GRID = """g AS (SELECT i // 125 AS zone, i // 25 % 5 AS ri, i // 5 % 5 AS gi, i % 5 AS bi, [0.15, 0.45, 0.8][i // 125 + 1]::DOUBLE AS depth FROM range(375) t(i)),
gw AS (SELECT *, ri / 4.0::DOUBLE AS r, gi / 4.0::DOUBLE AS g, bi / 4.0::DOUBLE AS b, greatest(1 - abs(depth - 0.15) / 0.3, 0)::DOUBLE AS w0, greatest(1 - abs(depth - 0.45) / 0.3, 0)::DOUBLE AS w1, greatest(1 - abs(depth - 0.8) / 0.4, 0)::DOUBLE AS w2 FROM g),
gm AS (SELECT *, w0 + w1 + w2 AS tw, (w0 * 1 + w1 * 2 + w2 * 3) / nullif(w0 + w1 + w2, 0) AS m FROM gw),
p AS (SELECT zone AS frame_id, ri AS y, gi * 5 + bi AS x, CASE WHEN tw > 1e-6 THEN r * (1 - m * 0.02) ELSE r END AS r, CASE WHEN tw > 1e-6 THEN g * (1 - m * 0.05) ELSE g END AS g, CASE WHEN tw > 1e-6 THEN b * (1 - m * 0.08) ELSE b END AS b, depth FROM gm)"""


@query(
    "h_combined_lut",
    f"WITH {_GRID}, toned AS ({{tone}}) SELECT t.frame_id::INT AS zone, t.y::INT AS ri, (t.x // 5)::INT AS gi, (t.x % 5)::INT AS bi, "
    "round(t.y / 4.0 * 0.1 + t.r * 0.9, 4) AS lr, round(t.x // 5 / 4.0 * 0.1 + t.g * 0.9, 4) AS lg, round(t.x % 5 / 4.0 * 0.1 + t.b * 0.9, 4) AS lb FROM toned t",
)
def _(spark, d):
    """The whole grading at every point of a 5-point grid and each zone's centre, as one table."""
    made = lut.build_combined(spark, _lut(spark), SIZE, 5, BOUNDS, [lut.Qualifier(weight=0.0)] * 6, PARAMS)
    return r6(made.select("zone", "ri", "gi", "bi", "lr", "lg", "lb"), "lr", "lg", "lb", digits=4)


SQL["h_combined_lut"] = SQL["h_combined_lut"].replace("{tone}", f"WITH {_tone_sql(1.0, 12)}")


_BLUR = "WITH {}, a AS (SELECT frame_id, y, x, avg(v) OVER (PARTITION BY frame_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM tile) "


@query("h_box_blur", _BLUR.format(fx.TILE) + "SELECT frame_id, y, x, round(avg(v) OVER (PARTITION BY frame_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) + 0.0 AS v FROM a")
def _(spark, d):
    return r6(lut.box_blur(fx.tile(spark, d), "v", 2), "v", digits=9)


@query("q_same_pixels", f"WITH {fx.PX}, a AS (SELECT frame_id, y, x FROM px WHERE frame_id % 7 <> 3), b AS (SELECT frame_id, y, x FROM px WHERE x <> 5 OR frame_id % 11 <> 0 UNION ALL SELECT frame_id, y, x FROM px WHERE frame_id % 13 = 0), c AS (SELECT frame_id, y, x, sum(n) AS n FROM (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL HAVING sum(n) <> 0) SELECT frame_id, y, x, CASE WHEN n > 0 THEN 'a' ELSE 'b' END AS side, abs(n)::BIGINT AS n FROM c")
def _(spark, d):
    """which pixels two clips do not share, repeated ones counted."""
    px = fx.px(spark, d).select(*KEY)
    b = px.where("x <> 5 OR frame_id % 11 <> 0").unionByName(px.where("frame_id % 13 = 0"))
    return diagnostics.unlike_pixels(px.where("frame_id % 7 <> 3"), b, KEY)


# ---- relational surface -----------------------------------------------------


@query("x_joins", "SELECT n_name, count(*) AS customers, count(DISTINCT o_orderkey) AS orders FROM nation JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def _(spark, d):
    t = lambda n: fx.table(spark, d, n)
    j = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("n_name").agg(F.count("*").alias("customers"), F.count_distinct("o_orderkey").alias("orders"))


@query("x_semi_anti", "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    c, o = fx.table(spark, d, "customer"), fx.table(spark, d, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    count = lambda how, kind: c.join(o, on, how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


@query("x_full_outer", "SELECT coalesce(c_custkey, o.k) AS k, c_nationkey AS nation, o.n AS orders FROM customer FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o.k")
def _(spark, d):
    o = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    return c.join(o, "k", "full").select("k", "nation", "orders")


_RANGES = [(0, 1000), (1000, 50000), (50000, 200000), (200000, 1000000)]


@query("x_range_join", "SELECT bucket, count(*) AS n FROM orders JOIN (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_RANGES)) + ") r(bucket, lo, hi) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY bucket")
def _(spark, d):
    ranges = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(_RANGES)], "bucket int, lo double, hi double")
    o = fx.table(spark, d, "orders").join(F.broadcast(ranges), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi")))  # four rows
    return o.groupBy("bucket").agg(F.count("*").alias("n"))


@query("x_as_of_join", "SELECT e.event_id, e.user_id, p.price FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, event_id AS price FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def _(spark, d):
    e = fx.table(spark, d, "events")
    left = e.where("event_type = 'click'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("price"))
    return sequence.as_of(left, right, ["user_id"], "ts", ["price"]).select("event_id", "user_id", "price")


@query("x_interval_join", "SELECT a.event_id AS click_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR")
def _(spark, d):
    e = fx.table(spark, d, "events")
    a = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("t0"), F.col("event_id").alias("click_id"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("t1"), F.col("event_id").alias("buy_id"))
    return sequence.within(a, b, ["user_id"], "t0", "t1", 6 * 3600).select("click_id", "buy_id")


@query("x_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g1, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, d):
    c = fx.table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return c.agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("x_rollup", "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
def _(spark, d):
    t = lambda n: fx.table(spark, d, n)
    j = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("x_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def _(spark, d):
    fx.table(spark, d, "orders").createOrReplaceTempView("x_orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM x_orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("x_windows", "SELECT o_orderkey, rank() OVER w AS rk, lag(o_totalprice) OVER w AS before, max(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving, ntile(4) OVER w AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return fx.table(spark, d, "orders").select(
        "o_orderkey", F.rank().over(w).cast("long").alias("rk"), F.lag("o_totalprice").over(w).alias("before"),
        F.max("o_totalprice").over(w.rowsBetween(-2, 0)).alias("moving"), F.ntile(4).over(w).cast("long").alias("quarter"),
    )


@query("x_set_ops", "SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'only' FROM customer EXCEPT SELECT s_nationkey, 'only' FROM supplier)")
def _(spark, d):
    c, s = fx.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), fx.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("kind", F.lit("both")).unionByName(c.subtract(s).withColumn("kind", F.lit("only")))


@query("x_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("x_dates", "SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, date_trunc('month', o_orderdate)::TIMESTAMP AS m, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate)::INT AS days FROM orders")
def _(spark, d):
    t = F.col("o_orderdate")
    return fx.table(spark, d, "orders").select("o_orderkey", F.year(t).alias("y"), F.quarter(t).alias("q"), F.date_trunc("month", t).cast("timestamp_ntz").alias("m"), F.datediff(t, F.lit("1992-01-01")).alias("days"))


@query("x_event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    e = fx.table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("w"), "event_type", "n")


@query("x_stream_join", SQL["x_interval_join"])
def _(spark, d):
    """The interval join of two streams; state older than the interval is dropped by watermarks."""
    from ..streaming import frames as streams

    e = fx.table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    root, state = _staged(spark, e, "join", 3, "at")
    side = lambda kind: streams.stream_rows(spark, f"{root}/in", e.schema).where(F.col("event_type") == kind)
    pairs = streams.joined_within(side("click"), side("purchase"), ["user_id"], "ts", "6 hours")
    streams.run_to_end(pairs.select(F.col("a.event_id").alias("click_id"), F.col("b.event_id").alias("buy_id")), streams.parquet_sink(f"{root}/out"), state)
    return _ended(spark, root, spark.read.schema("click_id long, buy_id long").parquet(f"{root}/out").drop("batch"))


@query("x_sessions", "WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL 12 HOUR) IS NOT FALSE AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 12 HOUR AS end_ts, count(*) AS n FROM s GROUP BY user_id, session")
def _(spark, d):
    """Sessions that end after twelve hours without an event."""
    e = fx.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("first_ts"), F.col("w.end").cast("timestamp_ntz").alias("end_ts"), "n")


@query("x_functions", "WITH w AS (SELECT event_id, event_type, unnest([event_id % 7, event_id % 5]) AS part, unnest([0, 1])::INT AS nth FROM events) SELECT event_type, nth, round(sqrt(avg(part * part)), 6) AS rms FROM w GROUP BY event_type, nth")
def _(spark, d):
    """A table function and an aggregate function of one's own, registered and called from SQL."""
    functions.register(spark)
    fx.table(spark, d, "events").createOrReplaceTempView("x_events")
    return spark.sql("SELECT event_type, nth, round(root_mean_square(cast(part AS double)), 6) AS rms FROM x_events, LATERAL remainders(event_id, array(7, 5)) GROUP BY event_type, nth")


@query("x_subqueries", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.2 * avg(o_totalprice) FROM orders) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def _(spark, d):
    for name in ("orders", "lineitem"):
        fx.table(spark, d, name).createOrReplaceTempView(f"x_{name}")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM x_orders o WHERE o_totalprice > (SELECT 1.2 * avg(o_totalprice) FROM x_orders) AND EXISTS (SELECT 1 FROM x_lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")


@query("x_maps", "SELECT event_type, sum(event_id % 3)::BIGINT AS a, sum(event_id % 4)::BIGINT AS b FROM events GROUP BY event_type")
def _(spark, d):
    """Map functions: built, transformed, filtered and taken apart."""
    m = F.create_map(F.lit("a"), F.col("event_id") % 3, F.lit("b"), F.col("event_id") % 4, F.lit("c"), F.lit(-1).cast("long"))
    kept = F.map_filter(F.transform_values(m, lambda k, v: v * 2), lambda k, v: v >= 0)
    each = fx.table(spark, d, "events").select("event_type", F.explode(kept).alias("k", "v"))
    return each.groupBy("event_type").pivot("k", ["a", "b"]).agg((F.sum("v") / 2).cast("long"))


@query("x_json", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def _(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("x_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def _(spark, d):
    li = fx.table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net: Column = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
