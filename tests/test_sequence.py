"""Sequence operators against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenweft.operators import sequence


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("span", [1, 7, 4096])
def test_ranges_change_nothing(spark, by, span):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([None, 1, 2, 5])) for k in ("a", "b") for i in rng.sample(range(200), 60)]
    if not by:
        rows = [r for r in rows if r[0] == "a"]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    w = Window.partitionBy(*by).orderBy("i")
    want = df.select("k", "i", F.lag("v").over(w).alias("x"), F.sum("v").over(w).alias("s"), (F.row_number().over(w) - 1).alias("n")).collect()
    got = sequence.renumber(sequence.lag(df, "v", by, "i", "x", span), by, "i", "n", span)
    sums = {(r.k, r.i): r.s for r in sequence.running_sum(df.fillna(0), "v", by, "i", "s", span).collect()}
    assert sorted((r.k, r.i, repr(r.x), r.n) for r in got.collect()) == sorted((r.k, r.i, repr(r.x), r.n) for r in want)
    assert all(sums[r.k, r.i] == (r.s or 0) for r in want)
