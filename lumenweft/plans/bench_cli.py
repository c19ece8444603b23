"""Timed runs of a query as result documents, and their comparison.

    python -m lumenweft.plans.bench_cli run --query q_oklab_transfer --sf-dir DIR --samples 7 --label base --output-dir runs
    python -m lumenweft.plans.bench_cli compare runs/a.json runs/b.json
"""

from __future__ import annotations

import argparse
import datetime
import math
import re
import statistics
import sys
import threading
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bench
from ..sources import results

PROXY = re.compile(r"(\d+)x(\d+)")


def proxy_size(text: str) -> tuple[int, int]:
    """WIDTHxHEIGHT; what follows is not looked at."""
    m = PROXY.match(text)
    if not m:
        raise argparse.ArgumentTypeError(f"{text} is not WIDTHxHEIGHT")
    return int(m[1]), int(m[2])


def check_run(samples: int, frames: int, warmup: int) -> None:
    """F09."""
    if samples < 2:
        raise ValueError("at least two samples are needed")
    if frames <= warmup:
        raise ValueError(f"{frames} frames do not outlast {warmup} of warm-up")


def _seconds(df: DataFrame, limit_s: float | None = None) -> float:
    """How long a whole read of df takes; its jobs are cancelled at the limit."""
    context = df.sparkSession.sparkContext
    tag = f"timed-{time.monotonic_ns()}"
    over = threading.Event()

    def cancel() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    watch = threading.Timer(limit_s, cancel) if limit_s else None
    context.addJobTag(tag)
    began = time.perf_counter()
    try:
        if watch:
            watch.start()
        df.write.format("noop").mode("overwrite").save()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"a sample took more than {limit_s:g} s") from e
        raise
    finally:
        if watch:
            watch.cancel()
        context.removeJobTag(tag)
    return time.perf_counter() - began


def time_once(spark: SparkSession, query, sf_dir: str, frames: int, limit_s: float | None = 300.0) -> dict[str, float | None]:
    """One timed run.  Spark overlaps reading, work and writing, so only the whole is measured; the stages' metrics are null."""
    wall = _seconds(query(spark, sf_dir), limit_s)
    return dict.fromkeys(bench.METRICS) | {"steady_state_fps": frames / wall, "wall_ms_per_frame": wall * 1000.0 / frames}


def aggregate(values: list[float | None]) -> dict | None:
    """A03 for a handful of values on the driver; None for a metric that was not measured."""
    if values and all(v is None for v in values):
        return None
    if len(values) < 2 or not all(v is not None and math.isfinite(v) for v in values):
        raise ValueError("an aggregate needs at least two samples, all finite")
    mean, dev = statistics.fmean(values), statistics.stdev(values)
    half = bench.student_t(len(values) - 1) * dev / math.sqrt(len(values))
    return {"n_samples": len(values), "mean": mean, "stddev": dev, "median": statistics.median(values), "ci95_lo": mean - half, "ci95_hi": mean + half, "raw": values}


def run(spark: SparkSession, query_name: str, sf_dir: str, output_dir: str, *, label: str = "", samples: int = 5, warmup: int = 8, proxy: tuple[int, int] = (8, 8), batch_size: int = 8, limit_s: float = 300.0) -> Path:
    """Timed samples after one untimed run, saved under the usual name."""
    from .catalog import QUERIES

    frames = -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // 64)
    check_run(samples, frames, warmup)
    query = QUERIES[query_name]
    _seconds(query(spark, sf_dir))
    timed = [time_once(spark, query, sf_dir, frames, limit_s) for _ in range(samples)]
    sha, dirty = results.git_state()
    config = {
        "schema_version": bench.SCHEMA_VERSION, "git_sha": sha, "git_dirty": dirty, "label": label, "clip_path": sf_dir, "clip_frames_total": frames, "clip_frames_warmup": warmup,
        "clip_frames_measured": frames - warmup, "proxy_w": proxy[0], "proxy_h": proxy[1], "full_w": 8, "full_h": 8, "batch_size": batch_size, "tensorrt": False, "torch_compile": False,
        "n_samples": samples, "system_state": results.system_state(), "pinning_applied": None,
    }
    slots = ("top_ops", "dmon_samples", "dram_throughput_pct", "sm_throughput_pct", "pyspy_flamegraph_path", "torch_trace_path", "nsys_trace_path", "ncu_report_path")
    throughput = {m: aggregate([t[m] for t in timed]) for m in bench.METRICS}
    doc = {"schema_version": bench.SCHEMA_VERSION, "config": config, "throughput": throughput, "nvtx_spans": [], **dict.fromkeys(slots)}
    name = spark.createDataFrame([(config,)], "config struct<label:string,git_sha:string>")
    file_name = results.named(name, F.lit(datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)).cast("timestamp")).first().file_name
    Path(output_dir).mkdir(parents=True, exist_ok=True)
    out = Path(output_dir) / file_name
    out.write_text(results.document(doc) + "\n")
    return out


def compare(spark: SparkSession, base: str, other: str, *, force: bool = False, rope: float = bench.ROPE_PCT) -> str:
    """The markdown report of two result documents."""
    docs = [results.read_results(spark, p).withColumn("run", F.lit(k)) for k, p in (("a", base), ("b", other))]
    labels = [d.first().config.label or k for k, d in zip("ab", docs, strict=True)]
    labels = labels if labels[0] != labels[1] else [f"{labels[0]} (a)", f"{labels[1]} (b)"]
    renamed = [d.withColumn("config", F.col("config").withField("label", F.lit(n))).drop("run") for d, n in zip(docs, labels, strict=True)]
    both = renamed[0].unionByName(renamed[1])
    samples = results.long_metrics(both)
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"throughput.{m}.ci95_hi") - F.col(f"throughput.{m}.mean")).alias("ci_half")) for m in bench.METRICS])
    half = both.select(F.col("config.label").alias("run"), F.explode(entries).alias("e")).select("run", "e.*")
    states = both.select(F.col("config.label").alias("run"), "config.system_state.*")
    verdicts = bench.verdicts(bench.compare_runs(samples, *labels), rope)
    configs = both.select(F.col("config.label").alias("run"), "config.proxy_w", "config.proxy_h", "config.batch_size", "config.tensorrt", "config.torch_compile", "config.n_samples")
    return bench.report(verdicts, half, bench.hardware_diff(states, *labels), *labels, force=force, rope=rope, configs=configs)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="bench_cli")
    sub = p.add_subparsers(dest="what", required=True)
    r = sub.add_parser("run")
    r.add_argument("--query", default="q_oklab_transfer")
    r.add_argument("--sf-dir", required=True)
    r.add_argument("--output-dir", default="runs")
    r.add_argument("--label", default="")
    r.add_argument("--samples", type=int, default=5)
    r.add_argument("--warmup", type=int, default=8)
    r.add_argument("--proxy", type=proxy_size, default=(8, 8))
    r.add_argument("--batch-size", type=int, default=8)
    r.add_argument("--timeout", type=float, default=300.0)
    c = sub.add_parser("compare")
    c.add_argument("baseline")
    c.add_argument("candidate")
    c.add_argument("--output")
    c.add_argument("--force", action="store_true")
    c.add_argument("--rope", type=float, default=bench.ROPE_PCT)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("bench").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "run":
        print(run(spark, a.query, a.sf_dir, a.output_dir, label=a.label, samples=a.samples, warmup=a.warmup, proxy=a.proxy, batch_size=a.batch_size, limit_s=a.timeout))
        return 0
    try:
        text = compare(spark, a.baseline, a.candidate, force=a.force, rope=a.rope)
    except bench.HardwareMismatch as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    Path(a.output).write_text(text) if a.output else print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
