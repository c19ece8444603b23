"""Result documents, configuration and system state."""

from __future__ import annotations

import json
import os
import platform
import subprocess
import sys
import time
import tomllib
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media
from ..operators.bench import METRICS, SCHEMA_VERSION

# The documents of schema version 2, every field by its name.
_AGGREGATE = "struct<n_samples:int,mean:double,stddev:double,median:double,ci95_lo:double,ci95_hi:double,raw:array<double>>"
_STATE = (
    "struct<kernel_version:string,cpu_governor:string,cpu_turbo_enabled:boolean,thp_enabled:string,swappiness:int,gpu_name:string,gpu_compute_cap:string,driver_version:string,cuda_version:string,"
    "gpu_clock_graphics_mhz:int,gpu_clock_memory_mhz:int,gpu_clock_graphics_max_mhz:int,gpu_clock_memory_max_mhz:int,gpu_power_limit_w:int,gpu_persistence_mode:boolean,gpu_ecc_enabled:boolean,"
    "pcie_link_gen_current:int,pcie_link_width_current:int,pcie_link_gen_max:int,pcie_link_width_max:int,pcie_health_gbps:double,in_container:boolean,python_version:string,torch_version:string,trt_version:string>"
)
_PINNING = "struct<gpu_clocks_locked:boolean,gpu_mem_clocks_locked:boolean,persistence_mode:boolean,cpu_governor_set:string,page_caches_dropped:boolean,clip_prewarmed:boolean>"
_CONFIG = (
    "struct<schema_version:int,git_sha:string,git_dirty:boolean,label:string,clip_path:string,clip_frames_total:int,clip_frames_warmup:int,clip_frames_measured:int,proxy_w:int,proxy_h:int,full_w:int,full_h:int,"
    f"batch_size:int,tensorrt:boolean,torch_compile:boolean,n_samples:int,system_state:{_STATE},pinning_applied:{_PINNING}>"
)
_SPANS = f"array<struct<name:string,count_per_sample:{_AGGREGATE},p50_ms:{_AGGREGATE},p95_ms:{_AGGREGATE},total_ms:{_AGGREGATE}>>"
_SLOTS = f"top_ops array<string>, dmon_samples array<string>, dram_throughput_pct {_AGGREGATE}, sm_throughput_pct {_AGGREGATE}, pyspy_flamegraph_path string, torch_trace_path string, nsys_trace_path string, ncu_report_path string"
RESULT_SCHEMA = f"schema_version int, config {_CONFIG}, throughput struct<{','.join(f'{m}:{_AGGREGATE}' for m in METRICS)}>, nvtx_spans {_SPANS}, {_SLOTS}"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents of the current version; another version, or none, is an error."""
    docs = spark.read.schema(RESULT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    version = F.col("schema_version")
    checked = F.when(version.eqNullSafe(SCHEMA_VERSION), version).otherwise(F.raise_error(F.concat(F.lit("result of version "), F.coalesce(version.cast("string"), F.lit("none")))).cast("int"))
    return docs.withColumn("schema_version", checked)


def long_metrics(results: DataFrame) -> DataFrame:
    """J09's input: (run, metric, value), a row for every raw sample."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"throughput.{m}.raw").alias("raw")) for m in METRICS])
    return results.select(F.col("config.label").alias("run"), F.explode(entries).alias("e")).select("run", "e.metric", F.explode("e.raw").alias("value"))


def checked_results(results: DataFrame) -> DataFrame:
    """K08's guard: NaN and infinite numbers of the throughput are an error."""
    finite = lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))
    wrong = F.lit(False)
    for m in METRICS:
        for part in ("mean", "stddev", "median", "ci95_lo", "ci95_hi"):
            wrong = wrong | ~F.coalesce(finite(F.col(f"throughput.{m}.{part}")), F.lit(True))
        wrong = wrong | F.coalesce(F.exists(F.col(f"throughput.{m}.raw"), lambda v: ~F.coalesce(finite(v), F.lit(True))), F.lit(False))
    refused = F.raise_error(F.lit("a result holds NaN or infinity")).cast("int")
    return results.withColumn("schema_version", F.when(wrong, refused).otherwise(F.col("schema_version")))


def write_results(results: DataFrame, path: str) -> None:
    """One JSON document per row and line; null fields are written, so that every slot is there."""
    checked_results(results).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def document(row: dict) -> str:
    """One result as an indented document; NaN and infinity are an error."""
    return json.dumps(row, indent=2, allow_nan=False)


def named(results: DataFrame, at) -> DataFrame:
    """file_name of each document."""
    return results.withColumn("file_name", media.result_name(at, F.col("config.git_sha"), F.col("config.label")))


@dataclass(frozen=True)
class Options:
    """Resolved options of a grading run."""

    weights: str | None = None
    models_dir: str | None = None
    proxy_size: int = 1440
    batch_size: int = 8
    input_encoding: str | None = None
    output_codec: str | None = None
    scene_threshold: float = 0.15

    def check(self) -> Options:
        """F05."""
        if not 1 <= self.batch_size <= 32:
            raise ValueError("batch_size must be 1 to 32")
        if self.batch_size > 8:
            warnings.warn("a batch over 8 gains little and over 16 loses", stacklevel=2)
        return self


def require_model(options: Options) -> tuple[str, Callable]:
    """the weights and the model folder, which must both be named; a name and a builder for a lazy model."""
    for field, value in (("weights", options.weights), ("models_dir", options.models_dir)):
        if not value:
            raise ValueError(f"{field} required: set [models].{field} in the configuration or give --{field.replace('_', '-')}")
    weights, folder = options.weights, model_dir(options.models_dir, options.weights)

    def build():
        raise NotImplementedError(f"no runtime for networks is installed (weights {weights}, models {folder}); pass a model to run()")

    return f"{folder}:{weights}", build


def resolve(cli: Mapping, file: Mapping) -> Options:
    """The command line before the file before the defaults; unknown keys are ignored."""
    picked = {}
    for f in fields(Options):
        value = cli.get(f.name) if cli.get(f.name) is not None else file.get(f.name)
        if value is not None:
            picked[f.name] = value
    return Options(**picked).check()


def load_config(env: Mapping[str, str] | None = None, cwd: str = ".") -> dict:
    """The first readable file of $LUMENWEFT_CONFIG, the working folder, the user's and the system's.

    A named file that does not exist is passed over with a warning; one that
    cannot be parsed is an error.  Elsewhere an unreadable file is passed over.
    """
    env = os.environ if env is None else env
    home = env.get("XDG_CONFIG_HOME") or f"{env.get('HOME', '')}/.config"
    places = [(env.get("LUMENWEFT_CONFIG"), True), (f"{cwd}/lumenweft.toml", False), (f"{home}/lumenweft/config.toml", False), ("/etc/lumenweft/config.toml", False)]
    for path, named_ in places:
        if not path:
            continue
        if not os.path.isfile(path):
            if named_:
                warnings.warn(f"{path} does not exist", stacklevel=2)
            continue
        try:
            with open(path, "rb") as f:
                return tomllib.load(f)
        except tomllib.TOMLDecodeError as e:
            if named_:
                raise ValueError(f"{path}: {e}") from e
            warnings.warn(f"{path}: {e}", stacklevel=2)
    return {}


def check_input(path: str) -> Path:
    """an existing file, and no name of a former subcommand."""
    if path in ("grade", "calibrate", "preview", "probe"):
        raise ValueError(f"{path} is no longer a subcommand; give a file")
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return Path(path)


def _read(path: str, default: str = "unknown") -> str:
    try:
        return Path(path).read_text().strip()
    except OSError:
        return default


def _query_gpu(fields: list[str]) -> dict[str, str]:
    """One row of the vendor's tool; empty where there is none."""
    try:
        got = subprocess.run(["nvidia-smi", f"--query-gpu={','.join(fields)}", "--format=csv,noheader,nounits"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return {}
    line = got.stdout.strip().split("\n")[0] if got.returncode == 0 else ""
    values = [v.strip() for v in line.split(",")]
    return dict(zip(fields, values, strict=True)) if len(values) == len(fields) else {}


# The tool's name of each field.
_GPU = {
    "gpu_name": "name", "gpu_compute_cap": "compute_cap", "driver_version": "driver_version", "gpu_clock_graphics_mhz": "clocks.gr", "gpu_clock_memory_mhz": "clocks.mem",
    "gpu_clock_graphics_max_mhz": "clocks.max.gr", "gpu_clock_memory_max_mhz": "clocks.max.mem", "gpu_power_limit_w": "power.limit", "gpu_persistence_mode": "persistence_mode",
    "gpu_ecc_enabled": "ecc.mode.current", "pcie_link_gen_current": "pcie.link.gen.current", "pcie_link_width_current": "pcie.link.width.current",
    "pcie_link_gen_max": "pcie.link.gen.max", "pcie_link_width_max": "pcie.link.width.max",
}


def copy_bandwidth(megabytes: int = 64, rounds: int = 5) -> float:
    """GB a second that the driver's machine copies in memory, the best of a few rounds: the probe where no device is there."""
    source = bytearray(megabytes << 20)
    best = float("inf")
    for _ in range(rounds):
        began = time.perf_counter()
        bytes(source)
        best = min(best, time.perf_counter() - began)
    return megabytes / 1024 / best


def _package(name: str) -> str | None:
    try:
        return metadata.version(name)
    except metadata.PackageNotFoundError:
        return None


def system_state(*, probe: bool = True) -> dict:
    """All fields of a result's system_state; what the driver's machine does not say is unknown or null."""
    no_turbo = _read("/sys/devices/system/cpu/intel_pstate/no_turbo", "")
    boost = _read("/sys/devices/system/cpu/cpufreq/boost", "")
    thp = _read("/sys/kernel/mm/transparent_hugepage/enabled")
    swappiness = _read("/proc/sys/vm/swappiness", "-1")
    said = _query_gpu(list(_GPU.values()))
    found: dict = {
        "kernel_version": platform.release(),
        "cpu_governor": _read("/sys/devices/system/cpu/cpu0/cpufreq/scaling_governor"),
        "cpu_turbo_enabled": no_turbo == "0" if no_turbo else boost == "1" if boost else None,
        "thp_enabled": thp[thp.index("[") + 1 : thp.index("]")] if "[" in thp else thp,
        "swappiness": int(swappiness) if swappiness.lstrip("-").isdigit() else -1,
    }
    types = dict(f.split(":") for f in _STATE[len("struct<") : -1].split(","))
    for name, asked in _GPU.items():
        text = said.get(asked, "")
        if types[name] == "int":
            found[name] = int(float(text)) if text.replace(".", "", 1).isdigit() else None
        elif types[name] == "boolean":
            found[name] = text == "Enabled" if text else None
        else:
            found[name] = text or None
    found |= {
        "cuda_version": os.environ.get("CUDA_VERSION"),
        "pcie_health_gbps": copy_bandwidth() if probe else None,
        "in_container": os.path.exists("/.dockerenv") or "docker" in _read("/proc/1/cgroup", "") or "kubepods" in _read("/proc/1/cgroup", ""),
        "python_version": platform.python_version(),
        "torch_version": _package("torch"),
        "trt_version": _package("tensorrt"),
    }
    return {name: found[name] for name in types}


def system_state_frame(spark: SparkSession, *, probe: bool = True) -> DataFrame:
    schema = ", ".join(f.replace(":", " ") for f in _STATE[len("struct<") : -1].split(","))
    return spark.createDataFrame([tuple(system_state(probe=probe).values())], schema)


def git_state(path: str = ".") -> tuple[str, bool]:
    """Short commit and whether there are changes; unknown outside a repository."""
    run = lambda *a: subprocess.run(["git", "-C", path, *a], capture_output=True, text=True)
    sha = run("rev-parse", "--short", "HEAD")
    return (sha.stdout.strip(), bool(run("status", "--porcelain").stdout.strip())) if sha.returncode == 0 else ("unknown", False)


def model_dir(given: str | None, weights: str, module_file: str = __file__) -> str:
    """The given folder, one beside the weights, or one beside the code; the first that exists."""
    places = [given, str(Path(weights).parent / "models"), str(Path(module_file).resolve().parents[2] / "models")]
    for p in places:
        if p and os.path.isdir(p):
            return p
    raise FileNotFoundError(f"no model folder among {[p for p in places if p]}")


def interpreter() -> str:
    """Z16."""
    return sys.executable


def env_number(name: str, default: float, env: Mapping[str, str] | None = None) -> float:
    """A number from the environment; the default where it is unset or no number."""
    try:
        return float((os.environ if env is None else env)[name])
    except (KeyError, ValueError):
        return default


def scene_threshold(env: Mapping[str, str] | None = None) -> float:
    """$LUMENWEFT_SCENE_THRESHOLD or 0.15."""
    return env_number("LUMENWEFT_SCENE_THRESHOLD", 0.15, env)
