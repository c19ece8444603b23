"""Functions of one's own, for SQL (U10): a table function and an aggregate over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Remainders:
    """A row for each divisor: its place and what is left of the value."""

    def eval(self, value: int, divisors: list[int]) -> Iterator[tuple[int, int]]:
        if value is not None and divisors is not None:
            for nth, d in enumerate(divisors):
                yield nth, value % d


def root_mean_square(values: pd.Series) -> float:
    return float(np.sqrt(np.mean(np.square(values.to_numpy(float)))))


def register(spark: SparkSession) -> None:
    """``remainders(value, divisors)`` as a table, ``root_mean_square(value)`` as an aggregate."""
    spark.udtf.register("remainders", F.udtf(Remainders, returnType="nth int, part long"))
    spark.udf.register("root_mean_square", F.pandas_udf(_rms, "double"))


def _rms(values: pd.Series) -> float:
    return root_mean_square(values)
