"""Sequence operators that one long clip does not force into one task.

A window over a whole clip is one task's work.  These cut the order into ranges
of ``SPAN`` consecutive positions, work inside each range and carry what is
needed over its edge from a summary with one row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096


def _ranged(df: DataFrame, order: str, span: int) -> DataFrame:
    return df.withColumn("__range", F.floor(F.col(order) / span))


def lag(df: DataFrame, value: str, by: list[str], order: str, out: str, span: int = SPAN) -> DataFrame:
    """``out``: the value of the row before in integer order within ``by``; null for the first."""
    ranged = _ranged(df, order, span)
    inside = ranged.withColumn("__in", F.lag(F.struct(value)).over(Window.partitionBy(*by, "__range").orderBy(order)))
    ends = ranged.groupBy(*by, "__range").agg(F.max_by(F.struct(value), order).alias("__end"))
    carried = ends.select(*by, "__range", F.lag("__end").over(Window.partitionBy(*by).orderBy("__range")).alias("__edge"))
    joined = inside.join(carried, [*by, "__range"])
    return joined.withColumn(out, F.coalesce("__in", "__edge")[value]).drop("__in", "__edge", "__range")


def running_sum(df: DataFrame, value: str, by: list[str], order: str, out: str, span: int = SPAN) -> DataFrame:
    """``out``: the sum of the values up to and with the row, in integer order within ``by``."""
    ranged = _ranged(df, order, span)
    upto = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "__range").agg(F.sum(value).alias("__total"))
    offsets = totals.select(*by, "__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    joined = ranged.withColumn("__upto", F.sum(value).over(upto)).join(offsets, [*by, "__range"])
    return joined.withColumn(out, F.col("__upto") + F.col("__offset")).drop("__upto", "__offset", "__range")


def renumber(df: DataFrame, by: list[str], order: str, out: str, span: int = SPAN) -> DataFrame:
    """``out``: dense numbers from 0 in integer order within ``by``."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    return running_sum(one, "__one", by, order, out, span).withColumn(out, F.col(out) - 1).drop("__one")


def _micros(c):
    return F.unix_micros(c.cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], span: float = 86400.0) -> DataFrame:
    """The last right row at or before each left row: one union and a running last value, no fan-out.

    The order, a number or a time, is cut into ranges of ``span`` (seconds for
    times); inside a range the last value runs along, and the last one of the
    ranges before comes from a summary with a row per range, so that one long
    key is many tasks.  Of right rows at one moment the greatest is taken.
    """
    others = [c for c in left.columns if c not in (*by, at)]
    rights = right.select(*by, at, F.lit(0).alias("__k"), F.struct(*values).alias("__v"), F.lit(None).alias("__row"))
    lefts = left.select(*by, at, F.lit(1).alias("__k"), F.lit(None).alias("__v"), F.struct(*others).alias("__row"))
    timed = left.schema[at].dataType.typeName().startswith(("timestamp", "date"))
    place = _micros(F.col(at)) / 1e6 if timed else F.col(at).cast("double")
    both = rights.unionByName(lefts).withColumn("__range", F.floor(place / span))
    upto = Window.partitionBy(*by, "__range").orderBy(at, "__k", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("__in", F.last("__v", ignorenulls=True).over(upto)).where("__k = 1")
    ends = both.where("__k = 0").groupBy(*by, "__range").agg(F.max(F.struct(at, "__v"))["__v"].alias("__end"))
    ranges = both.select(*by, "__range").distinct().join(ends, [*by, "__range"], "left")
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(*by, "__range", F.last("__end", ignorenulls=True).over(before).alias("__edge"))
    filled = inside.join(carried, [*by, "__range"]).withColumn("__v", F.coalesce("__in", "__edge"))
    return filled.select(*by, at, "__row.*", *[F.col(f"__v.{v}").alias(v) for v in values])


def within(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, seconds: float) -> DataFrame:
    """Pairs whose right time lies at most ``seconds`` after the left one, both ends included.

    Times are dealt into buckets as long as the interval; a left row looks into
    its own bucket and the next, so a hot key joins bucket by bucket.
    """
    most = F.lit(int(seconds * 1_000_000)).cast("long")
    bucket = lambda c: F.call_function("div", _micros(F.col(c)), most)
    a = left.withColumn("__b", F.explode(F.array(bucket(left_at), bucket(left_at) + 1)))
    gap = _micros(F.col(right_at)) - _micros(F.col(left_at))
    return a.join(right.withColumn("__b", bucket(right_at)), [*by, "__b"]).where((gap >= 0) & (gap <= most)).drop("__b")
