"""Grading of packed frames (Z02, P01, P07-P09, P11, P12, R01, U01, U05): one pass over Arrow batches, no shuffle.

A frame is one row; its bytes are seen as an array, made small, run through the
model, and the perceptual change is made large again strip by strip, so that a
4K frame needs its bytes twice and a strip of floating-point numbers.  Frames
of one size travel through numpy together as far as ``PIXELS`` allows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import FrameSizeError, MediaKind
from . import transfer_arrow as arithmetic
from .transfer import Model, identity_model

#: Pixels that one step of floating-point arithmetic holds.
PIXELS = 1 << 17
#: Linear light of every 16-bit value.
_LINEAR = arithmetic.linear(np.arange(65536) / 65535.0)


def proxy_of(width: int, height: int, longest: int) -> tuple[int, int]:
    """The size with the longer side at most ``longest``."""
    if max(width, height) <= longest:
        return width, height
    scale = longest / max(width, height)
    return max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))


def axis(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R01, half-pixel: for each target index the two source indexes and the share of the second."""
    at = np.maximum((np.arange(target) + 0.5) * source / target - 0.5, 0)
    low = np.minimum(at.astype(np.int64), source - 1)
    return low, np.minimum(low + 1, source - 1), at - low


def _along(values: np.ndarray, dim: int, taps: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    low, high, part = taps
    shape = [1] * values.ndim
    shape[dim] = len(part)
    part = part.reshape(shape)
    return values.take(low, dim) * (1 - part) + values.take(high, dim) * part


def shrink(frames: np.ndarray, proxy: tuple[int, int]) -> np.ndarray:
    """(n, h, w, 3) 16-bit frames at ``proxy`` (width, height) in [0, 1], a frame at a time."""
    _, h, w, _ = frames.shape
    if (w, h) == proxy:
        return frames / 65535.0
    ys, xs = axis(h, proxy[1]), axis(w, proxy[0])
    return np.stack([_along(_along(f.astype(np.float64), 0, ys), 1, xs) / 65535.0 for f in frames])


def modelled(small: np.ndarray, model: Model, batch_size: int) -> np.ndarray:
    """The model over (n, h, w, 3), at most ``batch_size`` frames at a time; another size is brought back."""
    done = np.empty_like(small)
    for at in range(0, len(small), batch_size):
        x = (small[at : at + batch_size].transpose(0, 3, 1, 2) - 0.5) / 0.5
        y = np.clip((np.asarray(model(x), np.float64) + 1) / 2, 0, 1).transpose(0, 2, 3, 1)
        if y.shape != small[at : at + batch_size].shape:
            y = _along(_along(y, 1, axis(y.shape[1], small.shape[1])), 2, axis(y.shape[2], small.shape[2]))
        done[at : at + batch_size] = y
    return done


# The spans of one batch, in order.
SPANS = ("upload", "proxy_downscale", "trt_inference", "oklab_delta", "apply_transfer", "download")


class Clock:
    """Seconds spent in each span; ``mark`` ends one."""

    def __init__(self) -> None:
        self.spent = dict.fromkeys(SPANS, 0.0)
        self.last = time.perf_counter()

    def mark(self, span: str) -> None:
        now = time.perf_counter()
        self.spent[span] += now - self.last
        self.last = now


def grade_stack(frames: np.ndarray, proxy: tuple[int, int], model: Model = identity_model, batch_size: int = 8, clock: Clock | None = None) -> np.ndarray:
    """16-bit frames (n, h, w, 3) graded through the model at ``proxy`` size."""
    clock = clock or Clock()
    n, h, w, _ = frames.shape
    small = shrink(frames, proxy)
    clock.mark("proxy_downscale")
    done = modelled(small, model, batch_size)
    clock.mark("trt_inference")
    delta = arithmetic.oklab(done) - arithmetic.oklab(small)
    across = delta if proxy[0] == w else _along(delta, 2, axis(proxy[0], w))
    clock.mark("oklab_delta")
    low, high, part = axis(proxy[1], h)
    out = np.empty(frames.shape, np.uint16)
    rows = max(1, PIXELS // (n * w))
    for y in range(0, h, rows):
        strip = slice(y, y + rows)
        change = across[:, strip] if proxy[1] == h else _along(across, 1, (low[strip], high[strip], part[strip]))
        lab = arithmetic.oklab_of_linear(_LINEAR[frames[:, strip]]) + change
        out[:, strip] = arithmetic.srgb(lab) * 65535 + 0.5  # whole part
    clock.mark("apply_transfer")
    return out


def _as_u16(data: memoryview, width: int, height: int) -> np.ndarray:
    """6 bytes a pixel as they are, 3 bytes times 257."""
    if len(data) == width * height * 6:
        return np.frombuffer(data, "<u2").reshape(height, width, 3)
    if len(data) == width * height * 3:
        return np.frombuffer(data, np.uint8).reshape(height, width, 3).astype(np.uint16) * 257
    raise FrameSizeError(MediaKind.DECODE_FAILED, f"a frame of {width} x {height} has {len(data)} bytes")


def _graded(batch: pa.RecordBatch, proxy: int | tuple[int, int], model: Model, batch_size: int, clock: Clock) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, bytes of graded frames) for stretches of a batch that hold frames of one size."""
    sizes = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
    pixels, at = batch.column(4), 0
    while at < len(sizes):
        w, h = sizes[at]
        end = at + 1
        if not (pixels[at].is_valid and w and h):
            yield at, [None]
        else:
            most = max(1, PIXELS // (w * h))
            while end < len(sizes) and end - at < most and sizes[end] == (w, h) and pixels[end].is_valid:
                end += 1
            stack = np.stack([_as_u16(memoryview(pixels[i].as_buffer()), w, h) for i in range(at, end)])
            size = proxy_of(w, h, proxy) if isinstance(proxy, int) else proxy
            clock.mark("upload")
            graded = grade_stack(stack, size, model, batch_size, clock)
            done = [f.astype("<u2", copy=False).tobytes() for f in graded]
            clock.mark("download")
            yield at, done
        at = end


_NAMES = ["clip_id", "frame_id", "width", "height", "pixels"]


def grade_frames(frames: DataFrame, proxy: int | tuple[int, int], model: Model = identity_model, *, batch_size: int = 8) -> DataFrame:
    """Packed frames (clip_id, frame_id, width, height, pixels) graded, 6 bytes a pixel, in the order they come.

    ``proxy`` is a size or the longest side.  A null frame stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, done in _graded(batch, proxy, model, batch_size, Clock()):
                some = batch.slice(at, len(done))
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(done, pa.binary())], _NAMES)

    return frames.select(*_NAMES).mapInArrow(run, "clip_id string, frame_id long, width int, height int, pixels binary")


def resize_frames(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Packed frames brought to one size by R01, 6 bytes a pixel; frames that have it are only widened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                clip, frame, w, h, data = (batch.column(k)[i] for k in range(5))
                out = None
                if data.is_valid:
                    px = _as_u16(memoryview(data.as_buffer()), w.as_py(), h.as_py())
                    if px.shape[:2] != (height, width):
                        px = (shrink(px[None], (width, height))[0] * 65535 + 0.5).astype(np.uint16)
                    out = px.astype("<u2", copy=False).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([out], pa.binary())], _NAMES)

    return frames.select(*_NAMES).mapInArrow(run, "clip_id string, frame_id long, width int, height int, pixels binary")


def profile_frames(frames: DataFrame, proxy: int | tuple[int, int], model: Model = identity_model, *, batch_size: int = 8) -> DataFrame:
    """Span, frames and busy ms_per_frame of a grading whose frames are thrown away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clock = Clock()
            n = sum(len(done) for _, done in _graded(batch, proxy, model, batch_size, clock))
            yield pa.RecordBatch.from_arrays([pa.array(SPANS), pa.array([n] * len(SPANS), pa.int64()), pa.array([clock.spent[x] * 1000 for x in SPANS])], ["span", "frames", "ms"])

    spent = frames.select(*_NAMES).mapInArrow(run, "span string, frames long, ms double").groupBy("span").agg(F.sum("frames").alias("frames"), F.sum("ms").alias("ms"))
    return spent.select("span", "frames", (F.col("ms") / F.col("frames")).alias("ms_per_frame"))


def pixels_of(frames: DataFrame) -> DataFrame:
    """Pixel rows clip_id, frame_id, y, x, r16, g16, b16 of packed frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                clip, frame, w, h, data = (batch.column(k)[i] for k in range(5))
                if not data.is_valid:
                    continue
                px = _as_u16(memoryview(data.as_buffer()), w.as_py(), h.as_py()).reshape(-1, 3).astype(np.int32)
                for at in range(0, len(px), PIXELS):
                    part = px[at : at + PIXELS]
                    place = np.arange(at, at + len(part), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([clip.as_py()] * len(part), pa.string()), pa.array(np.full(len(part), frame.as_py(), np.int64)), pa.array(place // w.as_py()), pa.array(place % w.as_py()), *[pa.array(part[:, k]) for k in range(3)]],
                        ["clip_id", "frame_id", "y", "x", "r16", "g16", "b16"],
                    )

    return frames.select("clip_id", "frame_id", "width", "height", "pixels").mapInArrow(run, "clip_id string, frame_id long, y int, x int, r16 int, g16 int, b16 int")
