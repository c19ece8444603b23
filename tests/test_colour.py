"""Colour goldens, resampling conventions and the grading path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweft.functions import color
from lumenweft.operators import diagnostics, lut, resample, scene, transfer


def row(df):
    return df.first()


@pytest.mark.parametrize(
    "rgb,lab",
    [
        ((0, 0, 0), (0, 0, 0)), ((1, 1, 1), (99.999999, 0.0, 0.000011)), ((32768 / 65535,) * 3, (59.818731, 0.0, 0.000007)), ((1, 0, 0), (62.795536, 67.458918, 37.753890)),
        ((0, 1, 0), (86.643961, -70.166272, 53.849544)), ((0, 0, 1), (45.201372, -9.737095, -93.458444)), ((0.6, 77 / 255, 0.2), (50.869746, 25.281907, 20.729998)),
    ],
)
def test_oklab(spark, rgb, lab):
    df = spark.createDataFrame([tuple(map(float, rgb))], "r double, g double, b double")
    r = row(color.with_oklab(df, ("r", "g", "b")))
    assert (r.lab_l, r.lab_a, r.lab_b) == pytest.approx(lab, abs=2e-5)


def test_eight_bit(spark):
    df = spark.createDataFrame([(0xFF00, 0), (0x8000, 0), (0x0100, 0), (0, 255)], "v int, w int")
    assert [r.x for r in df.select(color.u8_from_u16(F.col("v")).alias("x")).collect()] == [0xFF, 0x80, 0x01, 0]
    assert [r.x for r in df.select(color.u16_from_u8(F.col("w")).alias("x")).collect()][-1] == 65535


def frames(spark, *values, size=16):
    rows = [(f, y, x, v, v, v) for f, v in enumerate(values) for y in range(size) for x in range(size)]
    return spark.createDataFrame(rows, "frame_id long, y int, x int, r16 int, g16 int, b16 int")


@pytest.mark.parametrize("value", [0, 16384, 32768, 49152, 60000, 65535])
def test_identity_keeps_a_constant_frame(spark, value):
    out = transfer.grade(frames(spark, value), (16, 16), (8, 8))
    far = out.select(F.greatest(*[F.max(F.abs(F.col(f"{c}16") - value)) for c in "rgb"]).alias("d"), F.count("*").alias("n")).first()
    assert far.d <= 128 and far.n == 256


def test_a_model_changes_the_frame_as_numpy_says(spark):
    out = transfer.grade(frames(spark, 16384, 40000, size=4), (4, 4), (4, 4), transfer.gamma_model(0.9), batch_size=1)
    for r in out.collect():
        v = (16384, 40000)[r.frame_id] / 65535
        assert abs(r.r16 - v**0.9 * 65535) <= 2


def test_model_may_change_the_size(spark):
    grow = lambda batch: batch.repeat(2, 2).repeat(2, 3)
    px = transfer.to_unit(frames(spark, 30000, size=4))
    got = transfer.run_model(transfer.pack_frames(px), grow).collect()
    assert [(r.width, r.height, len(r.planes)) for r in got] == [(8, 8, 192)]


def grid(spark, values, w):
    return spark.createDataFrame([(0, i // w, i % w, float(v)) for i, v in enumerate(values)], "frame_id long, y int, x int, v double")


def resized(spark, values, w, target, convention):
    out = resample.resize(grid(spark, values, w), (w, len(values) // w), target, ["v"], convention=convention)
    return [round(r.v, 9) for r in out.orderBy("y", "x").collect()]


def test_conventions_differ(spark):
    assert resized(spark, range(16), 4, (2, 2), resample.CORNERS) == [0, 3, 12, 15]
    assert resized(spark, range(16), 4, (2, 2), resample.HALF_PIXEL) == [2.5, 4.5, 10.5, 12.5]
    assert resized(spark, [0, 1, 0, 0], 2, (3, 3), resample.CORNERS) == [0, 0.5, 1, 0, 0.25, 0.5, 0, 0, 0]
    assert resized(spark, range(16), 4, (4, 4), resample.CORNERS) == list(range(16))
    assert resized(spark, range(16), 4, (1, 1), resample.CORNERS) == [0]


@pytest.mark.parametrize("convention", [resample.HALF_PIXEL, resample.CORNERS, resample.NEAREST])
@pytest.mark.parametrize("source,target", [(8, 5), (5, 8), (1, 4), (7, 7), (9, 1)])
def test_weights_of_a_target_sum_to_one(source, target, convention):
    total = np.zeros(target)
    for pairs in resample.taps(source, target, convention):
        for d, w in pairs:
            total[d] += w
    assert np.allclose(total, 1)


def test_solid_stays_solid(spark):
    df = grid(spark, [7] * 16, 4).select("frame_id", "y", "x", *[F.lit(v).alias(c) for c, v in zip("rgb", (200, 100, 50))])
    assert {(r.r, r.g, r.b) for r in resample.resize_rgb8(df, (4, 4), (2, 2)).collect()} == {(200, 100, 50)}


def solid(spark, *values):
    rows = [(f, i, v, v, v) for f, v in enumerate(values) for i in range(16)]
    return spark.createDataFrame(rows, "frame_id long, i int, r int, g int, b int")


def test_scene_distance(spark):
    got = {r.frame_id: r.distance for r in scene.scene_distances(solid(spark, 10, 10, 245)).collect()}
    assert got == {1: 0.0, 2: 1.0}
    assert [r.frame_id for r in scene.scene_cuts(solid(spark, 0, 0, 255, 255)).collect()] == [2]
    assert [(r.segment, r.first_frame, r.last_frame) for r in scene.scene_segments(solid(spark, 0, 0, 255)).orderBy("segment").collect()] == [(0, 0, 1), (1, 2, 2)]


def test_trailing_pixels_are_not_in_a_block(spark):
    rows = [(0, y, x, x, x, x) for y in range(9) for x in range(17)]
    df = spark.createDataFrame(rows, "frame_id long, y int, x int, r int, g int, b int")
    assert diagnostics.block_variance(df, (17, 9)).count() == 2


def test_lattice_points_are_exact(spark):
    table = lut.lattice(spark, 5).select("ri", "gi", "bi", (F.col("ri") * 0.1).alias("lr"), (F.col("gi") * F.col("gi") * 0.05).alias("lg"), F.lit(0.5).alias("lb"))
    px = lut.lattice(spark, 5).select(F.monotonically_increasing_id().alias("k"), "ri", "gi", *[(F.col(f"{c}i") / 4.0).alias(c) for c in "rgb"])
    out = lut.sample_lut(px, table, 5, ["k"]).join(px.select("k", "ri", "gi"), "k").collect()
    assert len(out) == 125
    assert all(abs(r.r - r.ri * 0.1) < 1e-12 and abs(r.g - r.gi**2 * 0.05) < 1e-12 and r.b == 0.5 for r in out)


def test_pixel_without_zone_keeps_its_colour(spark):
    table = lut.lattice(spark, 2).select("zone", "ri", "gi", "bi", *[F.lit(0.0).alias(f"l{c}") for c in "rgb"])
    px = spark.createDataFrame([(1, 0.3, 0.4, 0.5, 5.0), (2, 0.3, 0.4, 0.5, 0.5)], "k int, r double, g double, b double, depth double")
    got = {r.k: (r.r, r.g, r.b) for r in lut.apply_zone_lut(px, table, 2, [0.0, 1.0], ["k"]).collect()}
    assert got == {1: (0.3, 0.4, 0.5), 2: (0.0, 0.0, 0.0)}


def test_qualifiers_see_what_came_before(spark):
    px = spark.createDataFrame([(0.2, 0.4, 0.9), (0.5, 0.5, 0.5)], "r double, g double, b double")
    idle = lut.apply_qualifiers(px, [lut.Qualifier(90, 2, 1, 99.0)] * 6).collect()
    assert all(abs(a - b) < 1e-12 for x, y in zip(idle, px.collect()) for a, b in zip(x, y))
    moved = lut.apply_qualifiers(px, [lut.Qualifier()] * 4 + [lut.Qualifier(80, 1, 0, 200), lut.Qualifier(0, 1, -0.5, 200)]).collect()
    assert moved[0] != px.first() and abs(moved[1].r - 0.5) < 1e-12


def test_both_engines_agree(spark):
    from lumenweft.operators import transfer_arrow
    from lumenweft.plans import fixtures as fx

    rows = transfer.to_unit(fx.px(spark, "/root/testdata/sf0.001")).select("frame_id", "y", "x", "r", "g", "b").join(fx.delta(spark, "/root/testdata/sf0.001"), ["frame_id", "y", "x"])
    sides = [transfer_arrow.grade_rows(rows, e).select("frame_id", "y", "x", "r16", "g16", "b16").collect() for e in ("sql", "arrow")]
    assert sorted(map(tuple, sides[0])) == sorted(map(tuple, sides[1])) and len(sides[0]) == 1000
    with pytest.raises(ValueError):
        transfer_arrow.grade_rows(rows, "gpu")


def test_unlike_frames_and_capacity(spark):
    a, b = frames(spark, 1, size=4), frames(spark, 1, size=3)
    assert diagnostics.check_same_pixels(a, a, ["frame_id", "y", "x"]).first().same
    with pytest.raises(Exception, match="frames differ in 7 pixels"):
        diagnostics.check_same_pixels(a, b, ["frame_id", "y", "x"]).collect()
    packed = transfer.pack_frames(transfer.to_unit(a))
    assert transfer.check_capacity(packed, 4, 4).count() == 1
    with pytest.raises(Exception, match="capacity"):
        transfer.check_capacity(packed, 3, 4).collect()


def test_a_worker_builds_its_model_once(spark):
    model = transfer.LazyModel("double", lambda: lambda batch: batch)
    assert transfer.run_model(transfer.pack_frames(transfer.to_unit(frames(spark, 9, 8, 7, size=2))), model, batch_size=1).count() == 3
    calls = []
    local = transfer.LazyModel("count", lambda: calls.append(1) or (lambda b: b))
    local(np.zeros(1)), local(np.zeros(1))
    assert calls == [1]
    transfer.LazyModel.unload("count")
    local(np.zeros(1))
    assert calls == [1, 1]


@pytest.mark.parametrize("bounds", [[0.0, 0.3, 0.6, 1.0], [0.2, 0.2, 0.7]])
def test_looked_up_and_joined_tables_agree(spark, monkeypatch, bounds):
    """The projection over arrays and the join point by point, for zones and for one table."""
    zones = len(bounds) - 1
    table = lut.lattice(spark, 4, zones).select("zone", "ri", "gi", "bi", *[(F.pmod(F.xxhash64("zone", f"{c}i", F.lit(c)), F.lit(1000)) / 1000.0).alias(f"l{c}") for c in "rgb"])
    value = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1001)) / 1000.0
    px = spark.range(300).select("id", *[value(c).alias(c) for c in "rgb"], value("d").alias("depth"))
    one = table.where("zone = 0").drop("zone")
    found = []
    for most in (1 << 18, 0):
        monkeypatch.setattr(lut, "LOOKUP_POINTS", most)
        zoned = {r.id: (r.r, r.g, r.b) for r in lut.apply_zone_lut(px, table, 4, bounds, ["id"]).collect()}
        alone = {r.id: (r.r, r.g, r.b) for r in lut.sample_lut(px, one, 4, ["id"]).collect()}
        found.append((zoned, alone))
    for a, b in zip(*found):
        assert set(a) == set(b) and all(np.allclose(a[i], b[i]) for i in a)


def test_a_table_with_a_missing_point_is_refused(spark):
    table = lut.lattice(spark, 3).select("ri", "gi", "bi", *[F.lit(0.5).alias(f"l{c}") for c in "rgb"]).where("ri + gi + bi < 6")
    with pytest.raises(Exception, match="lattice point"):
        lut.sample_lut(spark.range(1).select("id", *[F.lit(0.5).alias(c) for c in "rgb"]), table, 3, ["id"]).collect()
