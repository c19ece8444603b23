"""The grading path: proxy, model, perceptual delta, transfer to full resolution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import clamp, u16_from_unit, unit_from_u16, with_oklab, with_rgb
from .resample import resize

PIXEL = ["frame_id", "y", "x"]


def to_unit(pixels: DataFrame) -> DataFrame:
    """r16, g16, b16 as r, g, b in [0, 1]."""
    return pixels.withColumns({c: unit_from_u16(F.col(f"{c}16")) for c in "rgb"})


def model_input(c):
    """[0, 1] to [-1, 1]."""
    return (c - 0.5) / 0.5


def model_output(c):
    """[-1, 1] to [0, 1], clamped."""
    return clamp((c + 1.0) / 2.0)


def oklab_delta(before: DataFrame, after: DataFrame, key: list[str] = PIXEL) -> DataFrame:
    """Key, d_l, d_a, d_b; both sides hold r, g, b in [0, 1] under the same key."""
    a = with_oklab(before, ("r", "g", "b")).select(*key, *[F.col(f"lab_{c}").alias(f"p_{c}") for c in "lab"])
    b = with_oklab(after, ("r", "g", "b")).select(*key, *[F.col(f"lab_{c}").alias(f"q_{c}") for c in "lab"])
    return a.join(b, key).select(*key, *[(F.col(f"q_{c}") - F.col(f"p_{c}")).alias(f"d_{c}") for c in "lab"])


def add_delta(pixels: DataFrame) -> DataFrame:
    """P07 on rows that hold r, g, b and d_l, d_a, d_b: sets r, g, b and the 16-bit r16, g16, b16."""
    lab = with_oklab(pixels, ("r", "g", "b"), ("__l", "__a", "__b"))
    lab = lab.withColumns({f"__{c}": F.col(f"__{c}") + F.col(f"d_{c}") for c in "lab"})
    graded = with_rgb(lab, ("__l", "__a", "__b"), ("r", "g", "b")).drop("__l", "__a", "__b")
    return graded.withColumns({f"{c}16": u16_from_unit(F.col(c)) for c in "rgb"})


def transfer(pixels: DataFrame, delta: DataFrame, key: list[str] = PIXEL) -> DataFrame:
    """Add a delta field to pixels of the same key."""
    return add_delta(to_unit(pixels).join(delta, key))


Model = Callable[[np.ndarray], np.ndarray]


def identity_model(batch: np.ndarray) -> np.ndarray:
    """U08."""
    return batch


def gamma_model(gamma: float) -> Model:
    """A stand-in for a network: a power of the unit value."""
    return lambda batch: 2 * np.clip((batch + 1) / 2, 0, 1) ** gamma - 1


def run_model(frames: DataFrame, model: Model, *, batch_size: int = 8, key: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Apply a batch function (n, 3, h, w) -> (n, 3, h', w') in [-1, 1] to packed frames.

    frames: the key, width, height, planes (array<double>, planar r then g then
    b, in [0, 1]).  Arrow batches bound what a worker holds; frames of one size
    are stacked, at most ``batch_size`` at a time.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for (w, h), same in part.groupby(["width", "height"], sort=False):
                for at in range(0, len(same), batch_size):
                    some = same.iloc[at : at + batch_size]
                    x = np.stack([np.asarray(p, np.float64).reshape(3, h, w) for p in some.planes])
                    y = np.clip((model((x - 0.5) / 0.5) + 1) / 2, 0, 1)
                    yield pd.DataFrame({**{k: some[k].to_numpy() for k in key}, "width": y.shape[3], "height": y.shape[2], "planes": [f.ravel() for f in y]})

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*key).schema)
    return frames.select(*key, "width", "height", "planes").mapInPandas(run, f"{names}, width int, height int, planes array<double>")


def _plane(channel: str):
    return F.transform("px", lambda p: p[channel])


class LazyModel:
    """A model that each worker builds when it first meets a batch, and keeps for its life."""

    _built: dict[str, Model] = {}

    def __init__(self, name: str, build: Callable[[], Model]):
        self.name, self.build = name, build

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        if self.name not in self._built:
            self._built[self.name] = self.build()
        return self._built[self.name](batch)

    @classmethod
    def unload(cls, name: str) -> None:
        cls._built.pop(name, None)


def check_capacity(frames: DataFrame, width: int, height: int) -> DataFrame:
    """An error for a frame larger than the capacity asked for."""
    fits = (F.col("width") <= width) & (F.col("height") <= height)
    return frames.withColumn("width", F.when(fits, F.col("width")).otherwise(F.raise_error(F.lit("frame beyond the capacity")).cast("int")))


def pack_frames(pixels: DataFrame, key: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Planar frames out of pixel rows with r, g, b; a frame is bounded, so a row may hold one."""
    cell = F.struct("y", "x", "r", "g", "b")
    frames = pixels.groupBy(*key).agg(F.sort_array(F.collect_list(cell)).alias("px"), (F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    planes = F.concat(*[_plane(c) for c in "rgb"])
    return frames.select(*key, "width", "height", planes.alias("planes"))


def unpack_frames(frames: DataFrame, key: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Pixel rows out of planar frames."""
    n = F.col("width") * F.col("height")
    at = F.posexplode(F.slice("planes", F.lit(1), n)).alias("i", "r")
    rows = frames.select(*key, "width", n.alias("n"), "planes", at)
    plane = lambda k: F.element_at("planes", F.col("i") + 1 + F.col("n") * k)
    y = F.floor(F.col("i") / F.col("width")).cast("int")
    return rows.select(*key, y.alias("y"), (F.col("i") % F.col("width")).alias("x"), "r", plane(1).alias("g"), plane(2).alias("b"))


def grade(pixels: DataFrame, size: tuple[int, int], proxy: tuple[int, int], model: Model = identity_model, *, batch_size: int = 8, key: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Z02 over pixel rows (key, y, x, r16, g16, b16), all steps as relational operators.

    It shuffles every pixel: it is for small frames and for checking
    :func:`packed.grade_frames`, which grades packed frames without a shuffle.
    """
    at = [*key, "y", "x"]
    unit = to_unit(pixels)
    small = resize(unit, size, proxy, ["r", "g", "b"], key=key)
    done = unpack_frames(run_model(pack_frames(small, key), model, batch_size=batch_size, key=key), key)
    delta = oklab_delta(small, done, at)
    full = resize(delta, proxy, size, ["d_l", "d_a", "d_b"], key=key)
    return add_delta(unit.join(full, at)).select(*at, "r16", "g16", "b16")
