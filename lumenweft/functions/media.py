"""Metadata, naming and derived-metric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted names and what they mean.
ENCODINGS = {"dlog-m": "dlog-m", "dlogm": "dlog-m", "dlog_m": "dlog-m", "ilog": "ilog", "i-log": "ilog", "srgb": "srgb", "rec709": "srgb"}
CODECS = {"prores": "prores", "prores_ks": "prores", "hevc10": "hevc10", "hevc": "hevc10", "h265": "hevc10", "h265_10": "hevc10", "h264": "h264", "avc": "h264"}
ENCODERS = {"hevc10": "hevc", "h264": "h264", "prores": "prores_ks"}
PCIE_GBPS = {3: 12.0, 4: 25.0}
# The pixel format that an encoder is opened with, others take the last; and its profile.
PIXEL_FORMATS = {"prores_ks": "yuv422p10le", "hevc": "yuv420p10le", "libx265": "yuv420p10le"}
OTHER_FORMAT, PROFILES = "yuv420p", {"prores_ks": 3}

PROBE_SCHEMA = (
    "streams array<struct<codec_type:string,width:int,height:int,r_frame_rate:string,nb_frames:string,codec_name:string,"
    "pix_fmt:string,bits_per_raw_sample:string>>, format struct<duration:string>"
)


def lookup(c: Column, names: dict[str, str], what: str | None = None) -> Column:
    """The meaning of a name whatever its case; unknown names give null, or an error that says ``what``."""
    found = F.lit(None).cast("string")
    low = F.lower(c)
    by_meaning: dict[str, list[str]] = {}
    for name, meaning in names.items():
        by_meaning.setdefault(meaning, []).append(name)
    out = None
    for meaning, known in by_meaning.items():
        out = F.when(low.isin(known), meaning) if out is None else out.when(low.isin(known), meaning)
    return out.otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), c)) if what else found)


def input_encoding(c: Column, strict: bool = True) -> Column:
    """X04."""
    return lookup(c, ENCODINGS, "input encoding" if strict else None)


def output_codec(c: Column, strict: bool = True) -> Column:
    """X05."""
    return lookup(c, CODECS, "output codec" if strict else None)


def encoder_name(codec: Column) -> Column:
    """X07."""
    return lookup(codec, ENCODERS)


def parse_rational(c: Column) -> Column:
    """X01: "n/d" or a number; 30 for d = 0, an unreadable n or an unreadable number; d = 1 if unreadable."""
    n = F.coalesce(F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double"), F.lit(30.0))
    d = F.coalesce(F.split_part(c, F.lit("/"), F.lit(2)).try_cast("double"), F.lit(1.0))
    ratio = F.when(d == 0, F.lit(30.0)).otherwise(n / F.nullif(d, F.lit(0.0)))
    return F.when(F.contains(c, F.lit("/")), ratio).otherwise(F.coalesce(c.try_cast("double"), F.lit(30.0)))


def bit_depth(raw_bits: Column, pix_fmt: Column) -> Column:
    """The stated bits, else by the pixel format's name."""
    guess = F.when(F.contains(pix_fmt, F.lit("10")), 10).when(F.contains(pix_fmt, F.lit("12")), 12).otherwise(8)
    return F.coalesce(raw_bits.try_cast("int"), guess).cast("int")


def frame_count(nb_frames: Column, duration: Column, fps: Column) -> Column:
    """The stated count, else duration times rate."""
    return F.coalesce(nb_frames.try_cast("long"), F.round(F.coalesce(duration, F.lit(0.0)) * fps).cast("long"))


def detect_encoding(codec: Column, bits: Column) -> Column:
    """F02."""
    return F.when(codec == "prores", "ilog").when((bits >= 10) & codec.isin("hevc", "h265"), "dlog-m").otherwise("srgb")


def is_10bit(name: Column) -> Column:
    """of an encoding or a codec."""
    return name.isin("dlog-m", "ilog", "prores", "hevc10")


def bytes_per_pixel(codec: Column) -> Column:
    """P18."""
    return F.when(is_10bit(codec), 6).otherwise(3)


def default_codec(encoding: Column) -> Column:
    """X08."""
    return F.when(is_10bit(encoding), "prores").otherwise("h264")


def encoder_profile(encoder: Column) -> Column:
    """pix_fmt and profile (null for none) of an encoder."""
    table = lambda d: F.try_element_at(F.create_map(*[F.lit(x) for pair in d.items() for x in pair]), encoder)
    return F.struct(F.coalesce(table(PIXEL_FORMATS), F.lit(OTHER_FORMAT)).alias("pix_fmt"), table(PROFILES).alias("profile"))


def default_output(path: Column, codec: Column) -> Column:
    """stem_graded.mov for prores, .mp4 otherwise, beside the input."""
    stem = F.regexp_extract(path, r"^((?:.*/)?(?:[^/]+?|\.[^/]*?))(?:\.[^./]*)?$", 1)
    return F.concat(stem, F.lit("_graded."), F.when(codec == "prores", "mov").otherwise("mp4"))


def proxy_dims(w: Column, h: Column, longest: Column) -> Column:
    """struct<w, h> with the long edge at most ``longest``."""
    scale = longest / F.greatest(w, h)
    side = lambda x: F.when(F.greatest(w, h) <= longest, x).otherwise(F.greatest(F.round(x * scale), F.lit(1.0))).cast("int")
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def pct_delta(a: Column, b: Column) -> Column:
    """In percent of a; from 0 it is 0 or infinite."""
    zero = F.when(b == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return F.when(a == 0, zero).otherwise((b - a) / F.nullif(a, F.lit(0.0)) * 100.0)


def steady_fps(total: Column, wall_s: Column, wall_ms: Column, fps: Column, warmup: int) -> Column:
    """P20: the rate without the first ``warmup`` frames, at the mean cost of a frame."""
    rest = F.greatest(wall_s - F.lit(float(warmup)) * wall_ms / 1000.0, F.lit(1e-6))
    return F.when((F.lit(warmup) > 0) & (total > warmup), (total - warmup) / rest).otherwise(fps)


def per_frame_ms(busy_ms: Column, frames: Column) -> Column:
    """Busy time by frame; no frames count as one."""
    return busy_ms / F.greatest(frames, F.lit(1))


def progress_pct(done: Column, total: Column) -> Column:
    """P21."""
    return done * 100.0 / F.greatest(total, F.lit(1))


def major_driver(version: Column) -> Column:
    """The first two parts; empty for null."""
    return F.coalesce(F.substring_index(version, ".", 2), F.lit(""))


def safe_label(label: Column) -> Column:
    """X13, K09."""
    return F.coalesce(F.nullif(F.regexp_replace(label, "[^a-zA-Z0-9_-]", "_"), F.lit("")), F.lit("unlabeled"))


def result_name(at: Column, sha: Column, label: Column) -> Column:
    """K09, X14."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss'Z'"), F.lit("_"), sha, F.lit("_"), safe_label(label), F.lit(".json"))


def engine_cache_key(batch: Column, fp16: Column, h: Column, onnx: Column, sm: Column, trt: Column, w: Column) -> Column:
    """16 hex digits of SHA-256 over the sorted JSON with ", " and ": "."""
    text = F.format_string(
        '{"batch": %d, "fp16": %s, "h": %d, "onnx": "%s", "sm": "%s", "trt": "%s", "w": %d}',
        batch, fp16.cast("string"), h, onnx, sm, trt, w,
    )
    return F.substring(F.sha2(text, 256), 1, 16)


def pcie_healthy(gen: Column, gbps: Column) -> Column:
    """at least 80 % of what the link generation should give; unknown generations pass."""
    want = F.lit(None).cast("double")
    for g, rate in PCIE_GBPS.items():
        want = F.when(gen == g, F.lit(rate)).otherwise(want)
    return F.coalesce(gbps >= want * 0.8, F.lit(True))


def bandwidth_gbps(n_bytes: Column, seconds: Column) -> Column:
    """P24."""
    return n_bytes / seconds / 1e9


def verdict(delta_pct: Column, p: Column, rope: float = 1.5, alpha: float = 0.01) -> Column:
    """X15."""
    size = F.abs(delta_pct)
    return F.when(size < rope, "EQUIVALENT").when((p < alpha) & (size > rope), "DIFFERENT").otherwise("UNCLEAR")


def verdict_label(v: Column) -> Column:
    """X16."""
    return F.when(v == "EQUIVALENT", "≈ (within ROPE)").when(v == "DIFFERENT", "**DIFFERENT**").otherwise("unclear")


def with_video_info(df: DataFrame, json: str, out: str = "info") -> DataFrame:
    """``out`` is a struct of a probe document's metadata; an error where streams, a video stream or its size are missing.

    In stages, so that a document is parsed once.
    """
    df = df.withColumn("__doc", F.from_json(json, PROBE_SCHEMA))
    doc = F.col("__doc")
    streams = F.when(doc["streams"].isNull(), F.raise_error(F.lit("no streams")).cast("string")).otherwise(F.lit(None))
    df = df.withColumn("__v", F.try_element_at(F.filter(doc["streams"], lambda s: s["codec_type"] == "video"), F.lit(1)))
    v = F.col("__v")
    duration = F.coalesce(doc["format"]["duration"].try_cast("double"), F.lit(0.0))
    df = df.withColumns({"__fps": parse_rational(F.coalesce(v["r_frame_rate"], F.lit("30"))), "__duration": duration, "__error": F.coalesce(streams, F.when(v.isNull(), F.raise_error(F.lit("no video stream")).cast("string")))})
    need = lambda c, what: F.coalesce(c, F.raise_error(F.lit(what)).cast("int"))
    info = F.struct(
        F.when(F.col("__error").isNull(), need(v["width"], "missing width")).alias("width"), need(v["height"], "missing height").alias("height"),
        F.col("__fps").alias("fps"), F.col("__duration").alias("duration_secs"), frame_count(v["nb_frames"], F.col("__duration"), F.col("__fps")).alias("frame_count"),
        F.exists(doc["streams"], lambda s: s["codec_type"] == "audio").alias("has_audio"),
        F.coalesce(v["codec_name"], F.lit("unknown")).alias("codec_name"), F.coalesce(v["pix_fmt"], F.lit("")).alias("pix_fmt"),
        bit_depth(v["bits_per_raw_sample"], F.coalesce(v["pix_fmt"], F.lit(""))).alias("bits_per_component"),
    )
    return df.withColumn(out, info).drop("__doc", "__v", "__fps", "__duration", "__error")
