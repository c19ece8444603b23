"""The grading job from options to frames written."""

from __future__ import annotations

import argparse
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import media
from ..operators import packed, transfer
from ..sources import frames as frame_files
from ..sources.results import Options, check_input, load_config, require_model, resolve


@dataclass(frozen=True)
class Clip:
    path: str
    width: int
    height: int
    bytes_per_pixel: int = 6
    codec: str = "prores"
    bits: int = 10


def plan(clip: Clip, options: Options) -> dict:
    """What a run would do: encoding, codec, proxy size and output path."""
    encoding = media.ENCODINGS[options.input_encoding.lower()] if options.input_encoding else "ilog" if clip.codec == "prores" else "dlog-m" if clip.bits >= 10 and clip.codec in ("hevc", "h265") else "srgb"
    codec = media.CODECS[options.output_codec.lower()] if options.output_codec else "prores" if encoding in ("dlog-m", "ilog") else "h264"
    stem = clip.path.rsplit("/", 1)
    name = stem[-1].rsplit(".", 1)[0] or stem[-1]
    out = "/".join([*stem[:-1], f"{name}_graded.{'mov' if codec == 'prores' else 'mp4'}"])
    return {"encoding": encoding, "codec": codec, "encoder": media.ENCODERS[codec], "proxy": packed.proxy_of(clip.width, clip.height, options.proxy_size), "output": out}


def frames_of(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Packed 16-bit frames out of pixel rows clip_id, frame_id, y, x, r16, g16, b16; a frame is one row."""
    from ..operators.protocol import u16_bytes

    cell = F.struct("y", "x", F.array("r16", "g16", "b16").alias("v"))
    packed_ = pixels.groupBy("clip_id", "frame_id").agg(F.sort_array(F.collect_list(cell)).alias("px"))
    values = F.flatten(F.transform("px", lambda p: p["v"]))
    return packed_.select("clip_id", "frame_id", F.lit(width).alias("width"), F.lit(height).alias("height"), u16_bytes(values).alias("pixels"))


def grade_frames(frames: DataFrame, size: tuple[int, int], proxy: tuple[int, int], model: transfer.Model = transfer.identity_model, *, batch_size: int = 8, engine: str = "arrow") -> DataFrame:
    """Packed frames graded by numpy over Arrow batches, or by relational operators over pixel rows."""
    if engine == "arrow":
        return packed.grade_frames(frames, proxy, model, batch_size=batch_size)
    if engine != "sql":
        raise ValueError("engine is arrow or sql")
    graded = transfer.grade(packed.pixels_of(frames), size, proxy, model, batch_size=batch_size, key=("clip_id", "frame_id"))
    return frames_of(graded, *size).repartitionByRange("clip_id", "frame_id").sortWithinPartitions("clip_id", "frame_id")


def run(spark: SparkSession, clip: Clip, options: Options, model: transfer.Model = transfer.identity_model, output: str | None = None, *, engine: str = "arrow", frame_count: int = 0) -> int:
    """Grade raw frames and write 16-bit ones; returns the number of frames written.

    Frames keep their clip and their order.  Fewer than ``frame_count``, or than
    the input holds, are reported by a warning (F14).
    """
    what = plan(clip, options)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(frame_files.BATCH_BYTES))
    read = frame_files.read_frames(spark, clip.path, clip.width, clip.height, clip.bytes_per_pixel)
    seen, done = Observation("read"), Observation("graded")
    graded = grade_frames(read.observe(seen, F.count("*").alias("n")), (clip.width, clip.height), what["proxy"], model, batch_size=options.batch_size, engine=engine)
    graded = graded.observe(done, F.count_if(F.col("pixels").isNotNull()).alias("n"))
    frame_files.write_frames(graded, output or what["output"], clip.width, clip.height, 6)
    written, expected = done.get["n"], max(frame_count, seen.get["n"])
    if written < expected:
        warnings.warn(f"incomplete grading: {written} frames written, {expected} expected", stacklevel=2)
    return written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenweft", description="Grade a raw clip.")
    p.add_argument("input")
    p.add_argument("-o", "--output")
    p.add_argument("--width", type=int, required=True)
    p.add_argument("--height", type=int, required=True)
    p.add_argument("--bytes-per-pixel", type=int, choices=(3, 6), default=6)
    p.add_argument("--codec", default="prores")
    p.add_argument("--bits", type=int, default=10)
    p.add_argument("--weights")
    p.add_argument("--models-dir")
    p.add_argument("--proxy-size", type=int)
    p.add_argument("--batch-size", type=int)
    p.add_argument("--input-encoding")
    p.add_argument("--output-codec")
    p.add_argument("--engine", choices=("arrow", "sql"), default="arrow")
    p.add_argument("--identity", action="store_true", help="run without a network: weights and models are not asked for")
    p.add_argument("--frame-count", type=int, default=0, help="frames that the probe found; fewer written ones are reported")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    check_input(a.input)
    config = load_config()
    options = resolve({k: v for k, v in vars(a).items() if v is not None}, {**config.get("models", {}), **config.get("grade", {})})
    model = transfer.identity_model if a.identity else transfer.LazyModel(*require_model(options))
    spark = SparkSession.builder.appName("lumenweft").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR")
    clip = Clip(a.input, a.width, a.height, a.bytes_per_pixel, a.codec, a.bits)
    print(f"{run(spark, clip, options, model, a.output, engine=a.engine, frame_count=a.frame_count)} frames")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
