"""Benchmark results: aggregation, permutation tests, corrected verdicts, reports."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import media

ROPE_PCT, RESAMPLES, SCHEMA_VERSION = 1.5, 9999, 2
METRICS = [
    "steady_state_fps", "gpu_kernel_ms_per_frame", "gpu_thread_wall_ms_per_frame",
    "wall_ms_per_frame", "decode_thread_wall_ms_per_frame", "encode_thread_wall_ms_per_frame",
]
# The two lines of a run's log.
TIMING = r"stage timing \(busy ms/frame\): decode=([\d.]+) gpu_thread=([\d.]+) gpu_kernel=([\d.]+) encode=([\d.]+) wall=([\d.]+)"
DONE = r"done: (\d+) frames in ([\d.]+)s \(([\d.]+) fps\)"


def student_t(df: int, p: float = 0.975) -> float:
    """The p-quantile of Student's t: bisection on the distribution by Simpson's rule in the angle atan(t / sqrt(df))."""
    if df < 1:
        raise ValueError("degrees of freedom must be positive")
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    def below(t: float) -> float:
        n, end = 400, math.atan(t / math.sqrt(df))
        ys = [math.cos(end * i / n) ** (df - 1) * (1 if i in (0, n) else 4 if i % 2 else 2) for i in range(n + 1)]
        return 0.5 + scale * sum(ys) * end / n / 3

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return (low + high) / 2


def t_critical(df):
    """The 0.975 quantile as a column: exact to 100 degrees, then two terms about the normal quantile."""
    z = 1.959963984540054
    series = F.lit(z) + (z**3 + z) / 4 / df + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (df * df)
    known = F.array(*[F.lit(student_t(k)) for k in range(1, 101)])
    return F.when(df <= 100, F.try_element_at(known, df.cast("int"))).otherwise(series)


def aggregate_samples(samples: DataFrame, by: list[str], value: str = "value", *, strict: bool = True) -> DataFrame:
    """N, mean, deviation, median and 95 % interval of each group.

    Where ``strict``, fewer than two samples or one that is not finite is an
    error; otherwise such groups are left out.
    """
    v = F.col(value)
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    out = samples.groupBy(*by).agg(
        F.count("*").cast("int").alias("n_samples"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"), F.median(v).alias("median"), F.max(odd).alias("__odd")
    )
    bad = (F.col("n_samples") < 2) | F.col("__odd")
    if strict:
        out = out.withColumn("n_samples", F.when(bad, F.raise_error(F.lit("an aggregate needs at least two samples, all finite")).cast("int")).otherwise(F.col("n_samples")))
    else:
        out = out.where(~bad)
    half = t_critical(F.col("n_samples") - 1) * F.col("stddev") / F.sqrt("n_samples")
    return out.withColumns({"ci95_lo": F.col("mean") - half, "ci95_hi": F.col("mean") + half}).drop("__odd")


def long_samples(samples: DataFrame, key: list[str]) -> DataFrame:
    """One row per metric of a sample."""
    return samples.unpivot(key, METRICS, "metric", "value")


def parse_logs(logs: DataFrame, text: str = "text", warmup: int = 8, *, strict: bool = True) -> DataFrame:
    """X11, P20: the metrics of each run's log; a missing line is an error or, unless ``strict``, a null row."""
    t = F.col(text)
    part = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit("")).cast("double")
    got = logs.withColumns({
        "decode_thread_wall_ms_per_frame": part(TIMING, 1), "gpu_thread_wall_ms_per_frame": part(TIMING, 2), "gpu_kernel_ms_per_frame": part(TIMING, 3),
        "encode_thread_wall_ms_per_frame": part(TIMING, 4), "wall_ms_per_frame": part(TIMING, 5),
        "total_frames": part(DONE, 1).cast("int"), "__wall": part(DONE, 2), "__fps": part(DONE, 3),
    })
    if strict:
        missing = F.when(F.col("wall_ms_per_frame").isNull(), "no stage timing line").when(F.col("total_frames").isNull(), "no done line")
        got = got.withColumn("total_frames", F.when(missing.isNotNull(), F.raise_error(missing).cast("int")).otherwise(F.col("total_frames")))
    fps = media.steady_fps(F.col("total_frames"), F.col("__wall"), F.col("wall_ms_per_frame"), F.col("__fps"), warmup)
    return got.withColumn("steady_state_fps", fps).drop("__wall", "__fps")


def tail_lines(lines: DataFrame, n: int = 50, by: list[str] | None = None, order: str = "line_no") -> DataFrame:
    """The last n lines of each log; of one log alone, each task keeps its own n before they meet."""
    if not by:
        return lines.orderBy(F.desc(order)).limit(n)
    last = Window.partitionBy(*(by or [])).orderBy(F.desc(order))
    return lines.withColumn("__rn", F.row_number().over(last)).where(F.col("__rn") <= n).drop("__rn")


@functools.lru_cache(64)
def _splits(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)))


def permutation_p(a: np.ndarray, b: np.ndarray, resamples: int = RESAMPLES, seed: int = 0) -> float:
    """Two-sided p of the difference of means, twice the lesser tail.

    All splits are taken where they are no more than ``resamples``; otherwise
    random ones, counting the observed split among them.
    """
    both = np.concatenate([a, b]).astype(float)
    n, k = len(both), len(a)
    seen = a.mean() - b.mean()
    slack = 1e-12 * max(1e-300, np.abs(both).max())  # equal sums of other order count as equal
    total = both.sum()
    if math.comb(n, k) <= resamples:
        sums = both[_splits(n, k)].sum(1)
        extra = 0
    else:
        rng = np.random.default_rng(seed)
        step = max(1, (1 << 20) // n)  # rows of random numbers; the k least of a row are a random split
        sums = np.concatenate([both[np.argpartition(rng.random((min(step, resamples - at), n)), k - 1, 1)[:, :k]].sum(1) for at in range(0, resamples, step)])
        extra = 1
    stat = sums / k - (total - sums) / (n - k)
    tails = [((stat <= seen + slack).sum() + extra) / (len(stat) + extra), ((stat >= seen - slack).sum() + extra) / (len(stat) + extra)]
    return float(min(1.0, 2 * min(tails)))


def compare_runs(samples: DataFrame, base: str, other: str, *, resamples: int = RESAMPLES) -> DataFrame:
    """Metric, means, delta in percent and p of two runs; samples: (run, metric, value).

    A metric's samples are few (one row per timed run), so they fit an array;
    the test runs over Arrow batches of metrics.
    """

    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([permutation_p(np.asarray(x), np.asarray(y), resamples) for x, y in zip(a, b, strict=True)], dtype=float)

    p_of = F.pandas_udf(test, T.DoubleType())
    v = F.col("value").cast("double")
    side = lambda run: F.sort_array(F.collect_list(F.when(F.col("run") == run, v)))
    both = samples.where(F.col("run").isin(base, other)).groupBy("metric").agg(
        side(base).alias("__a"), side(other).alias("__b"), F.avg(F.when(F.col("run") == base, v)).alias("mean_a"), F.avg(F.when(F.col("run") == other, v)).alias("mean_b")
    )
    few = F.least(F.size("__a"), F.size("__b")) < 2
    checked = both.withColumn("__a", F.when(few, F.raise_error(F.lit("a comparison needs at least two samples of each run")).cast("array<double>")).otherwise(F.col("__a")))
    return checked.select("metric", "mean_a", "mean_b", media.pct_delta(F.col("mean_a"), F.col("mean_b")).alias("delta_pct"), p_of("__a", "__b").alias("p_raw"))


def holm(df: DataFrame, p: str = "p_raw", order: str = "metric", by: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    """Step-down correction within each family; ties keep their order."""
    family = Window.partitionBy(*(by or []))
    ranked = family.orderBy(p, order)
    scaled = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(family) - F.row_number().over(ranked) + 1))
    return df.withColumn("__s", scaled).withColumn(out, F.max("__s").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__s")


def verdicts(compared: DataFrame, rope: float = ROPE_PCT) -> DataFrame:
    """Holm-corrected p and verdict of each metric."""
    return holm(compared).withColumn("verdict", media.verdict(F.col("delta_pct"), F.col("p_holm"), rope))


def hardware_diff(states: DataFrame, a: str, b: str) -> DataFrame:
    """Field, both values and severity of what differs; states: run and the hardware columns (null equals null)."""
    fatal, advisory = ["gpu_name", "gpu_compute_cap", "driver_major"], ["driver_patch", "cuda_version", "torch_version", "trt_version"]
    rows = states.withColumn("driver_major", media.major_driver(F.col("driver_version")))
    text = rows.select("run", "driver_major", F.col("driver_version").alias("driver_patch"), *[F.col(c).cast("string").alias(c) for c in ("gpu_name", "gpu_compute_cap", "cuda_version", "torch_version", "trt_version")])
    long = text.unpivot(["run"], [*fatal, *advisory], "field", "v")
    sides = long.where(F.col("run").isin(a, b)).groupBy("field").agg(F.max(F.when(F.col("run") == a, F.col("v"))).alias("value_a"), F.max(F.when(F.col("run") == b, F.col("v"))).alias("value_b"))
    major = F.substring_index("value_a", ".", 2) == F.substring_index("value_b", ".", 2)
    differ = ~F.col("value_a").eqNullSafe(F.col("value_b")) & ((F.col("field") != "driver_patch") | F.coalesce(major, F.lit(False)))
    return sides.where(differ).withColumn("severity", F.when(F.col("field").isin(fatal), "fatal").otherwise("advisory"))


class HardwareMismatch(Exception):
    """Two runs were measured on hardware that cannot be compared."""


def precision_of(metric: str) -> int:
    """X12."""
    return 1 if "ms" in metric and "fps" not in metric else 2


def _config_lines(configs: DataFrame, base: str, other: str) -> list[str]:
    """What the two configurations say differently, and the numbers of samples."""
    rows = {r.run: r.asDict() for r in configs.collect()}
    if base not in rows or other not in rows:
        return []
    a, b = rows[base], rows[other]
    sizes = [f"{r['proxy_w']}x{r['proxy_h']}" for r in (a, b)]
    pairs = [*[(k, a[k], b[k]) for k in ("tensorrt", "torch_compile")], ("proxy", *sizes), ("batch_size", a["batch_size"], b["batch_size"])]
    samples = f"- samples: {a['n_samples']} each" if a["n_samples"] == b["n_samples"] else f"- samples: {a['n_samples']} vs {b['n_samples']} (different N)"
    return ["**Config:**", *[f"- {k}: {x} → {y}" for k, x, y in pairs if x != y], samples, ""]


def report(verdict_rows: DataFrame, intervals: DataFrame, hardware: DataFrame, base: str, other: str, *, force: bool = False, rope: float = ROPE_PCT, configs: DataFrame | None = None) -> str:
    """The comparison as markdown; a handful of rows, so it is written on the driver.

    intervals: (run, metric, ci_half); configs: run and the fields of a result's
    configuration.  A fatal hardware difference raises unless forced.
    """
    differs = hardware.orderBy("severity", "field").collect()
    fatal = [f"{r.field}: {r.value_a} → {r.value_b}" for r in differs if r.severity == "fatal"]
    notes = [f"{r.field}: {r.value_a} → {r.value_b}" for r in differs if r.severity != "fatal"]
    if fatal and not force:
        raise HardwareMismatch("; ".join(fatal))
    half = {(r.run, r.metric): r.ci_half for r in intervals.collect()}
    rows = {r.metric: r for r in verdict_rows.collect()}
    out = [f"# Benchmark: {base} vs {other}", ""]
    out += ["**ERROR: the hardware differs; the numbers cannot be compared**", *[f"- {x}" for x in fatal], ""] if fatal else []
    out += ["**Warning: these differ too**", *[f"- {x}" for x in notes], ""] if notes else []
    out += _config_lines(configs, base, other) if configs is not None else []
    out += [f"## Throughput (means ± 95% CI, ROPE=±{rope}%)", ""]
    out += [f"| Metric | {base} | {other} | Δ | p_raw | p_holm | verdict |", "|---|---:|---:|---:|---:|---:|:---|"]
    # How the verdicts are printed.
    labels = {"EQUIVALENT": "≈ (within ROPE)", "DIFFERENT": "**DIFFERENT**", "UNCLEAR": "unclear"}
    for m in [*[x for x in METRICS if x in rows], *sorted(rows.keys() - set(METRICS))]:
        r, d = rows[m], precision_of(m)
        cells = [m, *[f"{v:.{d}f} ± {half.get((run, m), 0):.{d}f}" for v, run in ((r.mean_a, base), (r.mean_b, other))], f"{r.delta_pct:+.1f}%", f"{r.p_raw:.3g}", f"{r.p_holm:.3g}", labels[r.verdict]]
        out.append(f"| {' | '.join(cells)} |")
    out += ["", "## Interpretation", ""]
    out += [
        f"- ROPE ±{rope}%: a smaller change counts as equivalent whatever its p; measure it anew on other machines.",
        f"- p_raw: two-sided permutation test of the means; p_holm: corrected over the {len(rows)} metrics.",
        "- DIFFERENT: p_holm below 0.01 and a change beyond the ROPE; unclear: take more samples.",
        "- Samples of one run share heat and caches and their times are not normal, so the test assumes no distribution.",
    ]
    return "\n".join(out)


def least_p(n: int, m: int, metrics: int = len(METRICS)) -> float:
    """The least corrected p that samples of these sizes can reach: whether DIFFERENT is possible at all."""
    return min(1.0, 2 / math.comb(n + m, n) * metrics)
