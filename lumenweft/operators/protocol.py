"""The inference service's messages: dispatch, checks, correlation, image bytes."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Request types and the response each calls for; shutdown has none.
RESPONSES = {
    "ping": "pong", "raune": "raune_result", "depth": "depth_result", "depth_batch": "depth_batch_result", "raune_depth_batch": "raune_depth_batch_result",
    "enhance": "enhance_result", "unload_maxine": "ok", "unload_raune": "ok", "load_yolo_seg": "ok", "load_raune": "ok", "load_depth": "ok",
    "yolo_seg_batch": "yolo_seg_batch_result", "shutdown": None,
}
# Fixed value: a request that takes any response but an error.
LENIENT = "load_yolo_seg"
# The fields of requests and responses.
REQUEST = (
    "type string, id string, format string, width int, height int, max_size int, image_b64 string, no_artifact_reduce boolean, enable_maxine boolean, "
    "weights string, models_dir string, model_path string, "
    "items array<struct<id:string,format:string,width:int,height:int,image_b64:string,max_size:int,raune_max_size:int,depth_max_size:int>>"
)
RESPONSE = (
    "type string, id string, message string, width int, height int, image_b64 string, depth_f32_b64 string, mask_b64 string, "
    "results array<struct<id:string,width:int,height:int,image_b64:string,enhanced_width:int,enhanced_height:int,depth_f32_b64:string,depth_width:int,depth_height:int,mask_b64:string>>"
)
# Fixed value: bytes of one pixel of each payload.
PAYLOAD_BYTES = {"image_b64": 3, "depth_f32_b64": 4, "mask_b64": 1}


def expected_response(kind: Column) -> Column:
    """The response type that a request type calls for; null for an unknown one and for shutdown."""
    known = F.create_map(*[F.lit(x) for pair in RESPONSES.items() for x in pair])
    return F.try_element_at(known, kind)


def dispatch(pairs: DataFrame) -> DataFrame:
    """Outcome of each (request, response) JSON line, and the kind of its error.

    ok, error (the service says so), unexpected (another type), unknown (a
    request that is not one) or crashed (no line).  A shutdown wants no line.
    """
    req, res = F.from_json("request", REQUEST), F.from_json("response", RESPONSE)
    kind, said = F.col("req.type"), F.col("res.type")
    silent = F.coalesce(F.trim("response"), F.lit("")) == ""
    outcome = (
        F.when(kind == "shutdown", F.when(silent, "ok").otherwise("unexpected")).when(silent, "crashed").when(said == "error", "error")
        .when(~F.coalesce(kind.isin(*RESPONSES), F.lit(False)), "unknown").when((kind == LENIENT) & said.isNotNull(), "ok")
        .when(said == expected_response(kind), "ok").otherwise("unexpected")
    )
    error_kind = F.when(F.col("outcome") == "error", "ServerError").when(F.col("outcome") != "ok", "Ipc")
    return pairs.withColumns({"req": req, "res": res}).withColumn("outcome", outcome).withColumn("error_kind", error_kind)


def explode_items(requests: DataFrame) -> DataFrame:
    """The items of batch requests, with their place."""
    return requests.select("msg_id", F.posexplode(F.from_json("request", REQUEST)["items"]).alias("place", "item")).select("msg_id", "place", "item.*")


def correlate(items: DataFrame, results: DataFrame) -> DataFrame:
    """Results matched to request items by id, in request order; ``missing`` marks items without one."""
    right = results.select("msg_id", "id", *[F.col(c).alias(f"out_{c}") for c in results.columns if c not in ("msg_id", "id")], F.lit(False).alias("__found"))
    return items.join(right, ["msg_id", "id"], "left").withColumn("missing", F.col("__found").isNull()).drop("__found")


def payload_ok(b64: Column, width: Column, height: Column, pixel_bytes: int) -> Column:
    """base64 that decodes to width * height * pixel_bytes bytes."""
    return F.coalesce(F.octet_length(F.try_to_binary(b64, F.lit("base64"))) == width * height * pixel_bytes, F.lit(False))


def rejects(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """enhance responses whose type, size or payload does not fit the request; the id is not compared."""
    both = responses.withColumn("res", F.from_json("response", RESPONSE)).join(requests.select("msg_id", F.col("width").alias("w"), F.col("height").alias("h")), "msg_id")
    why = (
        F.when(F.col("res.type") != "enhance_result", "type").when((F.col("res.width") != F.col("w")) | (F.col("res.height") != F.col("h")), "size")
        .when(~payload_ok(F.col("res.image_b64"), F.col("w"), F.col("h"), 3), "payload")
    )
    return both.withColumn("reason", why).where("reason IS NOT NULL").select("msg_id", "reason")


def batch_results(responses: DataFrame) -> DataFrame:
    """The results of batch responses with their place, and why a payload does not fit its own size."""
    rows = responses.select("msg_id", F.posexplode(F.from_json("response", RESPONSE)["results"]).alias("place", "r")).select("msg_id", "place", "r.*")
    depth = payload_ok(F.col("depth_f32_b64"), F.coalesce("depth_width", "width"), F.coalesce("depth_height", "height"), PAYLOAD_BYTES["depth_f32_b64"])
    mask = payload_ok(F.col("mask_b64"), F.col("width"), F.col("height"), PAYLOAD_BYTES["mask_b64"])
    nothing = F.coalesce("image_b64", "depth_f32_b64", "mask_b64").isNull()
    why = F.when(nothing, "missing").when(F.col("depth_f32_b64").isNotNull() & ~depth, "depth").when(F.col("mask_b64").isNotNull() & ~mask, "mask")
    return rows.withColumn("reason", why)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def f32_values(payload: pd.Series) -> pd.Series:
    """Little-endian floats of a binary column."""
    return payload.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def u16_values(payload: pd.Series) -> pd.Series:
    """Little-endian unsigned 16-bit values of a binary column."""
    return payload.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 2 * 2], "<u2").astype(np.int32))


@F.pandas_udf(T.BinaryType())
def u16_bytes(values: pd.Series) -> pd.Series:
    """The reverse."""
    return values.map(lambda v: None if v is None else np.asarray(v, "<u2").tobytes())


@F.pandas_udf(T.LongType())
def adler32(payload: pd.Series) -> pd.Series:
    """X21."""
    return payload.map(lambda b: None if b is None else zlib.adler32(b))


_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_png(rgb: np.ndarray, filters: list[int] | None = None) -> bytes:
    """An 8-bit RGB image of shape (h, w, 3); filters picks 0 (none), 1 (left), 2 (up), 3 (average) or 4 (nearest) for each row."""
    h, w, _ = rgb.shape
    flat = rgb.reshape(h, w * 3).astype(np.int16)
    left = np.concatenate([np.zeros((h, 3), np.int16), flat[:, :-3]], 1)
    up = np.concatenate([np.zeros((1, w * 3), np.int16), flat[:-1]])
    corner = np.concatenate([np.zeros((1, w * 3), np.int16), left[:-1]])
    gaps = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    nearest = np.where((gaps[0] <= gaps[1]) & (gaps[0] <= gaps[2]), left, np.where(gaps[1] <= gaps[2], up, corner))
    guesses = np.zeros_like(flat), left, up, (left + up) >> 1, nearest
    kinds = filters or [0] * h
    rows = b"".join(bytes([k]) + ((flat[y] - guesses[k][y]) & 255).astype(np.uint8).tobytes() for y, k in enumerate(kinds))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 0)) + chunk(b"IEND", b"")


def _recurrence(kind: int, raw: list[int], above: list[int]) -> list[int]:
    """A row of one channel under filter 3 (average) or 4 (nearest of left, above and the corner); above has a leading 0."""
    out, a, c = [], 0, 0
    for x, r in enumerate(raw):
        b = above[x + 1]
        if kind == 3:
            a = (r + (a + b >> 1)) & 255
        else:
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - c - c)
            a = (r + (a if da <= db and da <= dc else b if db <= dc else c)) & 255
            c = b
        out.append(a)
    return out


def decode_png(data: bytes) -> np.ndarray:
    """An 8-bit RGB non-interlaced image as (h, w, 3); checksums are not verified."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, size, body = 8, None, []
    while at + 8 <= len(data):
        length, name = struct.unpack(">I4s", data[at : at + 8])
        content = data[at + 8 : at + 8 + length]
        if name == b"IHDR":
            w, h, *kind = struct.unpack(">IIBBBBB", content)
            if kind[:2] != [8, 2] or kind[4]:
                raise ValueError("only 8-bit RGB without interlace is read")
            size = h, w
        elif name == b"IDAT":
            body.append(content)
        elif name == b"IEND":
            break
        at += 12 + length
    if size is None:
        raise ValueError("no header")
    h, w = size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + 3 * w)
    out = np.zeros((h + 1, w + 1, 3), np.int32)  # a border of zeros above and to the left
    for y in range(h):
        kind, raw, above = int(rows[y, 0]), rows[y, 1:].reshape(w, 3).astype(np.int32), out[y]
        here = out[y + 1]
        if kind == 0:
            here[1:] = raw
        elif kind == 1:
            here[1:] = np.cumsum(raw, 0) & 255
        elif kind == 2:
            here[1:] = (raw + above[1:]) & 255
        elif kind in (3, 4):  # each value needs the one before: plain numbers, a channel at a time
            for k in range(3):
                here[1:, k] = _recurrence(kind, raw[:, k].tolist(), above[:, k].tolist())
        else:
            raise ValueError("unknown row filter")
    return out[1:, 1:].astype(np.uint8)


@F.pandas_udf(T.StructType().add("width", "integer").add("height", "integer").add("pixels", "binary"))
def png_pixels(payload: pd.Series) -> pd.DataFrame:
    """Size and interleaved RGB bytes of a binary column of images."""
    images = [decode_png(b) for b in payload]
    return pd.DataFrame({"width": [i.shape[1] for i in images], "height": [i.shape[0] for i in images], "pixels": [i.tobytes() for i in images]})


@F.pandas_udf(T.BinaryType())
def png_of(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Images of interleaved RGB bytes; write the column as a table or file by file."""
    rows = zip(pixels, width, height, strict=True)
    return pd.Series([None if p is None else encode_png(np.frombuffer(p, np.uint8).reshape(int(h), int(w), 3)) for p, w, h in rows])


@dataclass(frozen=True)
class ServiceOptions:
    """How an inference service is started."""

    python: str = "python"
    module: str = "service"
    weights: str | None = None
    models_dir: str | None = None
    depth_model: str | None = None
    device: str | None = None
    skip_enhance: bool = False
    skip_depth: bool = False
    maxine: bool = False
    maxine_upscale_factor: int = 2
    startup_timeout_s: int = 120

    def arguments(self) -> list[str]:
        """The command; leaving a model out goes before naming it, the folder of models is named either way."""
        named = lambda flag, value: [flag, str(value)] if value else []
        out = [self.python, "-m", self.module]
        out += ["--no-raune"] if self.skip_enhance else named("--raune-weights", self.weights)
        out += named("--raune-models-dir", self.models_dir)
        out += ["--no-depth"] if self.skip_depth else named("--depth-model", self.depth_model)
        out += named("--device", self.device)
        return out + (["--maxine", *named("--maxine-upscale-factor", self.maxine_upscale_factor)] if self.maxine else [])
