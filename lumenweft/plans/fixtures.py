"""Frame, tile and sample tables derived from the driver's tables, in Spark and, under the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import u16_from_u8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit 8 x 8 frames from events; the last may be partial."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 64").alias("frame_id"), F.expr("cast(event_id % 64 div 8 as int)").alias("y"), (e % 8).cast("int").alias("x"),
        ((e * 7919 + F.col("user_id") * 31) % 65536).cast("int").alias("r16"), ((e * 104729 + 17) % 65536).cast("int").alias("g16"),
        ((F.round(F.col("value") * 100).cast("long") * 37) % 65536).cast("int").alias("b16"),
    )


def full_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the frames of which all pixels are there (a neighbour operator needs them)."""
    last = table(spark, sf_dir, "events").select(((F.max("event_id") + 1) / 64).alias("n"))
    return px(spark, sf_dir).join(F.broadcast(last), F.col("frame_id") < F.floor("n")).drop("n")  # one row


PX = """px AS (
  SELECT event_id // 64 AS frame_id, (event_id % 64 // 8)::INT AS y, (event_id % 8)::INT AS x,
    ((event_id * 7919 + user_id * 31) % 65536)::INT AS r16, ((event_id * 104729 + 17) % 65536)::INT AS g16,
    ((round(value * 100)::BIGINT * 37) % 65536)::INT AS b16 FROM events
)"""
FULL_PX = PX + """, full_px AS (SELECT * FROM px WHERE frame_id < (SELECT (max(event_id) + 1) // 64 FROM events))"""


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perceptual delta for every pixel of px."""
    return px(spark, sf_dir).select(
        "frame_id", "y", "x", ((F.col("x") - 3) * 1.5).cast("double").alias("d_l"), ((F.col("y") - 4) * 2.0).cast("double").alias("d_a"),
        ((F.col("x") + F.col("y") - 7) * 1.25).cast("double").alias("d_b"),
    )


DELTA = """delta AS (SELECT frame_id, y, x, (x - 3) * 1.5::DOUBLE AS d_l, (y - 4) * 2.0::DOUBLE AS d_a, (x + y - 7) * 1.25::DOUBLE AS d_b FROM px)"""


def scene_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-bit frames whose colour changes every ten frames."""
    scene = F.expr("event_id div 640")
    value = F.floor("value").cast("long")
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 64").alias("frame_id"), F.expr("cast(event_id % 64 div 8 as int)").alias("y"), (F.col("event_id") % 8).cast("int").alias("x"),
        ((scene * 53) % 224 + F.col("event_id") % 8).cast("int").alias("r"), ((scene * 97) % 224 + F.col("user_id") % 8).cast("int").alias("g"),
        ((scene * 31) % 224 + value % 8).cast("int").alias("b"),
    )


SCENE_PX = """scene_px AS (
  SELECT event_id // 64 AS frame_id, (event_id % 64 // 8)::INT AS y, (event_id % 8)::INT AS x,
    ((event_id // 640 * 53) % 224 + event_id % 8)::INT AS r, ((event_id // 640 * 97) % 224 + user_id % 8)::INT AS g,
    ((event_id // 640 * 31) % 224 + floor(value)::BIGINT % 8)::INT AS b FROM events
)"""


def tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 single-channel tiles from embeddings: frame_id, y, x, v."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("i", "v"))
    return rows.select("frame_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.col("v").cast("double").alias("v"))


TILE = """tile AS (
  SELECT vec_id AS frame_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, embedding[i]::DOUBLE AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)
)"""


def tile_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed 16-bit 8 x 8 frames out of embeddings, one a row: clip_id (two clips), frame_id, width, height, pixels."""
    from ..operators.protocol import u16_bytes

    v = lambda i: F.element_at("embedding", i).cast("double")
    value = lambda i, k: (F.floor(F.abs(v(i)) * k).cast("long") % 65536).cast("int")
    px16 = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.array(value(i, 400000.0), value(65 - i, 300000.0), value((i * 7) % 64 + 1, 200000.0)))
    clip = F.concat(F.lit("clip"), (F.col("vec_id") % 2).cast("string"))
    rows = table(spark, sf_dir, "embeddings").select(clip.alias("clip_id"), F.expr("vec_id div 2").alias("frame_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.flatten(px16).alias("v"))
    return rows.select("clip_id", "frame_id", "width", "height", u16_bytes("v").alias("pixels"))


TILE_PX = """px AS (
  SELECT 'clip' || (vec_id % 2) AS clip_id, vec_id // 2 AS frame_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x,
    (floor(abs(embedding[i]::DOUBLE) * 400000)::BIGINT % 65536)::INT AS r16, (floor(abs(embedding[65 - i]::DOUBLE) * 300000)::BIGINT % 65536)::INT AS g16,
    (floor(abs(embedding[(i * 7) % 64 + 1]::DOUBLE) * 200000)::BIGINT % 65536)::INT AS b16
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)
)"""


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles spread over [0, 1], rounded so that both engines hold the same numbers."""
    from pyspark.sql import Window

    frame = Window.partitionBy("frame_id")
    low, high = F.min("v").over(frame), F.max("v").over(frame)
    return tile(spark, sf_dir).select("frame_id", "y", "x", F.round((F.col("v") - low) / (high - low), 6).alias("depth"))


DEPTH = TILE + """, depth AS (
  SELECT frame_id, y, x, round((v - min(v) OVER f) / (max(v) OVER f - min(v) OVER f), 6) AS depth FROM tile WINDOW f AS (PARTITION BY frame_id)
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark samples: run is the event type, three metrics from the value."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), (F.lit(a) + F.col("value") * b).alias("value")) for m, a, b in SAMPLE_METRICS])
    each = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("run"), F.explode(entries).alias("e"))
    return each.select("event_id", "run", "e.metric", F.round("e.value", 6).alias("value"))


SAMPLE_METRICS = (("steady_state_fps", 40.0, 0.5), ("wall_ms_per_frame", 200.0, 1.0), ("decode_thread_wall_ms_per_frame", 20.0, 0.125))
SAMPLES = """samples AS (
  SELECT event_id, event_type AS run, metric, round(a + value * b, 6) AS value
  FROM events, (VALUES ('steady_state_fps', 40.0::DOUBLE, 0.5::DOUBLE), ('wall_ms_per_frame', 200.0, 1.0), ('decode_thread_wall_ms_per_frame', 20.0, 0.125)) m(metric, a, b)
)"""


def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small comparisons over all events: eight in a row are one metric, four samples of run a and four of run b."""
    e = F.col("event_id")
    run = F.when(e % 8 < 4, "a").otherwise("b")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.expr("event_id div 8").cast("string")).alias("metric"), run.alias("run"), (e % 8).alias("i"), "value")


PAIRED = "paired AS (SELECT 'm' || (event_id // 8) AS metric, CASE WHEN event_id % 8 < 4 THEN 'a' ELSE 'b' END AS run, (event_id % 8)::INT AS i, value FROM events)"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe documents: clip_id and json."""
    e = F.col("event_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (e % len(xs) + 1).cast("int"))
    text = F.concat(
        F.lit('{"streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": '), (e % 4000 + 16).cast("string"), F.lit(', "height": '), (e % 2000 + 16).cast("string"),
        F.lit(', "r_frame_rate": "'), pick("30000/1001", "25/1", "24", "0/0", "x/2", "50/y"), F.lit('", "codec_name": "'), pick("hevc", "prores", "h264", "h265", "av1"),
        F.lit('", "pix_fmt": "'), pick("yuv420p10le", "yuv420p", "yuv422p12le"), F.lit('"'),
        F.when(e % 2 == 0, F.concat(F.lit(', "nb_frames": "'), (e * 3).cast("string"), F.lit('"'))).otherwise(""),
        F.when(e % 7 == 0, F.lit(', "bits_per_raw_sample": "8"')).otherwise(""),
        F.lit('}], "format": {"duration": "'), (e % 97).cast("string"), F.lit('.5"}}'),
    )
    return table(spark, sf_dir, "events").select(e.alias("clip_id"), text.alias("json"))


def rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_px with 16-bit copies of its channels."""
    return scene_px(spark, sf_dir).withColumns({f"{c}16": u16_from_u8(F.col(c)) for c in "rgb"})
