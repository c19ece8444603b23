"""Goldens of benchmark statistics, metadata, protocol, sources, sinks and streams."""

import json
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweft.functions import media
from lumenweft.operators import bench, protocol
from lumenweft.plans import options as plans
from lumenweft.sources import frames, results

LOG = """\
[filter] 16 frames (53%, 4.7 fps)
[filter] done: 30 frames in 6.4s (4.69 fps)
[filter] stage timing (busy ms/frame): decode=21.4 gpu_thread=190.2 gpu_kernel=190.1 encode=44.2 wall=213.0
"""


def test_log(spark):
    logs = spark.createDataFrame([(LOG,)], "text string")
    m = bench.parse_logs(logs, warmup=4).first()
    assert (m.total_frames, m.wall_ms_per_frame, m.gpu_kernel_ms_per_frame, m.gpu_thread_wall_ms_per_frame) == (30, 213.0, 190.1, 190.2)
    assert m.steady_state_fps == pytest.approx(4.686373, abs=1e-6)
    for warmup in (0, 1000):
        assert bench.parse_logs(logs, warmup=warmup).first().steady_state_fps == 4.69


@pytest.mark.parametrize("text,why", [(LOG.splitlines()[1], "stage timing"), (LOG.splitlines()[2], "done line"), ("", "stage timing"), (LOG[:-30], "stage timing")])
def test_log_without_a_line(spark, text, why):
    logs = spark.createDataFrame([(text,)], "text string")
    with pytest.raises(Exception, match=why):
        bench.parse_logs(logs).collect()
    assert bench.parse_logs(logs, strict=False).count() == 1


def test_aggregate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", float(v)) for v in (1, 2, 3, 4)], "k string, value double")
    got = {r.k: r for r in bench.aggregate_samples(df, ["k"]).collect()}
    assert (got["a"].mean, got["a"].median, got["b"].median) == (3.0, 3.0, 2.5)
    assert got["a"].stddev == pytest.approx(1.5811, abs=1e-4) and got["a"].ci95_hi - 3 == pytest.approx(1.963, abs=1e-3)


@pytest.mark.parametrize("values", [[5.0], [1.0, math.nan], [1.0, math.inf]])
def test_aggregate_refuses(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value double").withColumn("k", F.lit(1))
    with pytest.raises(Exception, match="two samples"):
        bench.aggregate_samples(df, ["k"]).collect()
    assert bench.aggregate_samples(df, ["k"], strict=False).count() == 0


@pytest.mark.parametrize("df,t", [(1, 12.706205), (2, 4.302653), (4, 2.776445), (9, 2.262157), (19, 2.093024)])
def test_student_t(df, t):
    assert bench.student_t(df) == pytest.approx(t, abs=1e-5)


@pytest.mark.parametrize("ps,want", [([0.01, 0.02, 0.03, 0.04], [0.04, 0.06, 0.06, 0.06]), ([0.04, 0.01, 0.03, 0.02], [0.06, 0.04, 0.06, 0.06]), ([0.5, 0.6, 0.7], [1, 1, 1]), ([], [])])
def test_holm(spark, ps, want):
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)], "i int, p double")
    assert [r.p_holm for r in bench.holm(df, "p", "i").orderBy("i").collect()] == pytest.approx(want)


def test_verdict(spark):
    df = spark.createDataFrame([(0.5, 0.001), (5.0, 0.001), (5.0, 0.05), (1.5, 0.001), (-5.0, 0.001)], "d double, p double")
    assert [r.v for r in df.select(media.verdict(F.col("d"), F.col("p")).alias("v")).collect()] == ["EQUIVALENT", "DIFFERENT", "UNCLEAR", "UNCLEAR", "DIFFERENT"]


def test_permutation():
    a, b = np.array([2.75, 2.76, 2.77, 2.78, 2.79, 2.80]), np.array([2.9, 2.91, 2.92, 2.93, 2.94, 2.95])
    assert bench.permutation_p(a, b) == pytest.approx(2 / math.comb(12, 6))
    assert bench.permutation_p(a, a) == 1.0
    rng = np.random.default_rng(1)
    many = bench.permutation_p(rng.normal(0, 1, 30), rng.normal(3, 1, 30))
    assert many == pytest.approx(2 / 10000)
    assert bench.least_p(5, 5) == pytest.approx(0.0476, abs=1e-4) and bench.least_p(7, 7) < 0.01


STATE = "run string, gpu_name string, gpu_compute_cap string, driver_version string, cuda_version string, torch_version string, trt_version string"


def hardware(spark, **change):
    base = {"gpu_name": "g", "gpu_compute_cap": "8.6", "driver_version": "550.54.14", "cuda_version": "12", "torch_version": "2", "trt_version": None}
    rows = [("a", *base.values()), ("b", *(base | change).values())]
    return bench.hardware_diff(spark.createDataFrame(rows, STATE), "a", "b")


def test_hardware(spark):
    kinds = lambda df: {(r.field, r.severity) for r in df.collect()}
    assert kinds(hardware(spark)) == set()
    assert kinds(hardware(spark, gpu_name="h")) == {("gpu_name", "fatal")}
    assert kinds(hardware(spark, driver_version="551.1.1")) == {("driver_major", "fatal")}
    assert kinds(hardware(spark, driver_version="550.54.15")) == {("driver_patch", "advisory")}
    assert kinds(hardware(spark, trt_version="10")) == {("trt_version", "advisory")}


def test_report(spark):
    rows = [(r, m, v * k) for r, k in (("a", 1.0), ("b", 1.1)) for m in bench.METRICS for v in (10.0, 10.1, 10.2, 10.3, 10.4, 10.5, 10.6)]
    samples = spark.createDataFrame(rows, "run string, metric string, value double")
    verdicts = bench.verdicts(bench.compare_runs(samples, "a", "b"))
    half = bench.aggregate_samples(samples, ["run", "metric"]).select("run", "metric", (F.col("ci95_hi") - F.col("mean")).alias("ci_half"))
    text = bench.report(verdicts, half, hardware(spark), "a", "b")
    assert text.count("**DIFFERENT**") == 6 and "+10.0%" in text
    with pytest.raises(bench.HardwareMismatch):
        bench.report(verdicts, half, hardware(spark, gpu_name="h"), "a", "b")
    assert "ERROR" in bench.report(verdicts, half, hardware(spark, gpu_name="h"), "a", "b", force=True)


def test_rational(spark):
    df = spark.createDataFrame([("30000/1001",), ("25/1",), ("24",), ("0/0",), ("x",)], "v string")
    assert [round(r.f, 2) for r in df.select(media.parse_rational(F.col("v")).alias("f")).collect()] == [29.97, 25, 24, 30, 30]


def test_names(spark):
    df = spark.createDataFrame([("bogus",)], "v string")
    with pytest.raises(Exception, match="unknown input encoding"):
        df.select(media.input_encoding(F.col("v"))).collect()
    key = df.select(media.engine_cache_key(F.lit(1), F.lit(True), F.lit(540), F.lit("ab"), F.lit("8.6"), F.lit("10.9.0"), F.lit(960)).alias("k")).first().k
    assert key == "69271a76647140ef"
    out = spark.createDataFrame([("a/b.mkv", "prores"), ("clip", "h264"), ("x.y/z.tar.mp4", "hevc10")], "p string, c string")
    assert [r.o for r in out.select(media.default_output(F.col("p"), F.col("c")).alias("o")).collect()] == ["a/b_graded.mov", "clip_graded.mp4", "x.y/z.tar_graded.mp4"]
    assert [r.s for r in spark.createDataFrame([("a b/c",), ("",), (None,)], "l string").select(media.safe_label(F.col("l")).alias("s")).collect()] == ["a_b_c", "unlabeled", "unlabeled"]


@pytest.mark.parametrize("dims,want", [((518, 292, 518), (518, 292)), ((100, 50, 1000), (100, 50)), ((3840, 2160, 518), (518, 291)), ((3840, 2160, 1440), (1440, 810)), ((9000, 1, 10), (10, 1))])
def test_proxy(spark, dims, want):
    p = spark.range(1).select(media.proxy_dims(*map(F.lit, dims)).alias("p")).first().p
    assert (p.w, p.h) == want


@pytest.mark.parametrize("doc,why", [("{}", "no streams"), ('{"streams":[{"codec_type":"audio"}]}', "no video"), ('{"streams":[{"codec_type":"video","height":2}]}', "width")])
def test_probe_errors(spark, doc, why):
    with pytest.raises(Exception, match=why):
        media.with_video_info(spark.createDataFrame([(doc,)], "j string"), "j").collect()


@pytest.mark.parametrize("filters", [None, [0, 1], [2, 1], [1, 2]])
def test_png(filters):
    rgb = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert (protocol.decode_png(protocol.encode_png(rgb, filters)) == rgb).all()
    with pytest.raises(ValueError):
        protocol.decode_png(b"no image")


def test_png_average_and_paeth():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (3, 4, 3)).astype(np.int32)
    rows = b""
    for y in range(3):
        kind = (4, 3, 4)[y]
        line = []
        for x in range(4):
            a = rgb[y, x - 1] if x else np.zeros(3, int)
            b = rgb[y - 1, x] if y else np.zeros(3, int)
            c = rgb[y - 1, x - 1] if x and y else np.zeros(3, int)
            if kind == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                guess = np.array([min((abs(p[i] - v), k, v) for k, v in enumerate((a[i], b[i], c[i])))[2] for i in range(3)])
            line.append((rgb[y, x] - guess) & 255)
        rows += bytes([kind]) + np.array(line, np.uint8).tobytes()
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + b"\0\0\0\0"  # noqa: E731  the checksum is not looked at
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (protocol.decode_png(data) == rgb).all()


def test_raw_frames(spark, tmp_path):
    data = os.urandom(4 * 2 * 3 * 5 + 7)
    (tmp_path / "c.raw").write_bytes(data)
    got = frames.read_frames(spark, str(tmp_path / "c.raw"), 4, 2).orderBy("frame_id").collect()
    assert [bytes(r.pixels) for r in got] == [data[i * 24 : i * 24 + 24] for i in range(5)] and got[0].clip_id == "c"
    df = spark.createDataFrame(got, frames.SCHEMA)
    out = df.coalesce(1).sortWithinPartitions("frame_id").write.format("raw_frames").options(path=str(tmp_path / "o"), width=4, height=2)
    out.mode("append").save()
    files = [f for f in os.listdir(tmp_path / "o")]
    assert len(files) == 1 and (tmp_path / "o" / files[0]).read_bytes() == data[:120]
    with pytest.raises(Exception):
        df.withColumn("pixels", F.lit(b"xx")).coalesce(1).write.format("raw_frames").options(path=str(tmp_path / "bad"), width=4, height=2).mode("append").save()
    assert os.listdir(tmp_path / "bad") == []
    with pytest.raises(Exception, match="wrong size"):
        frames.check_sizes(df, 6).collect()


def test_raw_frame_stream_restarts(spark, tmp_path):
    frames.register(spark)
    done = 0
    for _ in range(2):  # the file grows, also while the stream runs, and the stream begins anew from its checkpoint
        grow = lambda: open(tmp_path / "c.raw", "ab").write(bytes(range(240)))
        grow()
        stream = spark.readStream.format("raw_frames").options(path=str(tmp_path / "c.raw"), width=4, height=2, frames_per_trigger=3).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s")).start(str(tmp_path / "out"))
        q.processAllAvailable()
        first = q.lastProgress.batchId
        grow()
        q.processAllAvailable()
        assert q.lastProgress.batchId >= first + 4  # ten frames, three at a time
        q.stop()
        done += 20
        assert sorted(r.frame_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(done))


def test_offsets_of_a_new_reader_never_go_back(tmp_path):
    (tmp_path / "c.raw").write_bytes(bytes(24 * 100))
    reader = frames._StreamReader({"path": str(tmp_path / "c.raw"), "width": "4", "height": "2", "frames_per_trigger": "16"})
    assert reader.initialOffset() == {"frame": 0} and reader.latestOffset() == {"frame": 100}
    reader.partitions({"frame": 0}, {"frame": 40})
    assert reader.latestOffset() == reader.latestOffset() == {"frame": 56}


def test_folder_of_clips(spark, tmp_path):
    for name, n in (("b", 5), ("a", 3)):
        (tmp_path / f"{name}.raw").write_bytes(bytes([n]) * 24 * n)
    read = frames.read_frames(spark, str(tmp_path), 4, 2)
    assert sorted((r.clip_id, r.frame_id) for r in read.collect()) == [("a", i) for i in range(3)] + [("b", i) for i in range(5)]
    frames.write_frames(read, str(tmp_path / "out"), 4, 2, 3)
    again = frames.read_frames(spark, str(tmp_path / "out"), 4, 2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, read.collect()))
    with pytest.raises(Exception, match="none.raw"):
        frames.read_frames(spark, str(tmp_path / "none.raw"), 4, 2).collect()


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_grading_job(spark, tmp_path, engine):
    """Two clips of a folder, a proxy smaller than they are and a model that changes them."""
    from lumenweft.operators import packed, transfer

    rng = np.random.default_rng(2)
    clips = {c: rng.integers(0, 65536, (3, 4, 6, 3)).astype("<u2") for c in "pq"}
    (tmp_path / "in").mkdir()
    for c, raw in clips.items():
        (tmp_path / "in" / f"{c}.raw").write_bytes(raw.tobytes())
    clip, model = plans.Clip(str(tmp_path / "in"), 6, 4, 6), transfer.gamma_model(0.7)
    assert plans.run(spark, clip, results.Options(proxy_size=3), model, str(tmp_path / "out"), engine=engine) == 6
    back = {(r.clip_id, r.frame_id): np.frombuffer(bytes(r.pixels), "<u2").reshape(4, 6, 3) for r in frames.read_frames(spark, str(tmp_path / "out"), 6, 4, 6).collect()}
    assert set(back) == {(c, i) for c in "pq" for i in range(3)}
    for (c, i), got in back.items():
        want = packed.grade_stack(clips[c][i][None], (3, 2), model)[0]
        assert np.abs(got.astype(int) - want.astype(int)).max() <= 1
        assert np.abs(got.astype(int) - clips[c][i].astype(int)).max() > 2000


def test_grading_job_reports_missing_frames(spark, tmp_path):
    raw = np.random.default_rng(2).integers(0, 256, (3, 4, 6, 3)).astype(np.uint8)
    (tmp_path / "in.raw").write_bytes(raw.tobytes())
    clip = plans.Clip(str(tmp_path / "in.raw"), 6, 4, 3)
    with pytest.warns(UserWarning, match="3 frames written, 5 expected"):
        assert plans.run(spark, clip, results.Options(proxy_size=3), output=str(tmp_path / "out"), frame_count=5) == 3
    back = frames.read_frames(spark, str(tmp_path / "out"), 6, 4, 6).orderBy("frame_id").collect()
    got = np.stack([np.frombuffer(bytes(r.pixels), "<u2") for r in back])
    assert np.abs(got - raw.reshape(3, -1).astype(int) * 257).max() <= 128
    what = plans.plan(plans.Clip("/v/clip.mp4", 3840, 2160, codec="hevc", bits=10), results.Options())
    assert what == {"encoding": "dlog-m", "codec": "prores", "encoder": "prores_ks", "proxy": (1440, 810), "output": "/v/clip_graded.mov"}


def test_packed_grading_needs_no_shuffle(spark, tmp_path):
    from lumenweft.operators import packed

    (tmp_path / "c.raw").write_bytes(bytes(6 * 4 * 6))
    plan = packed.grade_frames(frames.read_frames(spark, str(tmp_path / "c.raw"), 6, 4, 6), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# Frame goldens of the grading path
@pytest.mark.parametrize("value,shape,proxy,low,high", [(32768, (16, 16), (8, 8), 32640, 32896), (60000, (16, 16), (8, 8), 50001, 65535), (32896, (16, 16), (8, 8), 32768, 33024), (0, (8, 8), (4, 4), 0, 128), (65535, (8, 8), (4, 4), 65000, 65535)])
def test_constant_frames(value, shape, proxy, low, high):
    from lumenweft.operators import packed

    got = packed.grade_stack(np.full((1, *shape, 3), value, np.uint16), proxy)
    assert got.shape == (1, *shape, 3) and got.dtype == np.uint16 and low <= got.min() <= got.max() <= high


def test_strips_and_stacks_do_not_matter(monkeypatch):
    from lumenweft.operators import packed, transfer

    rng = np.random.default_rng(5)
    frames_ = rng.integers(0, 65536, (3, 31, 17, 3)).astype(np.uint16)
    model = transfer.gamma_model(0.6)
    whole = packed.grade_stack(frames_, (9, 13), model)
    monkeypatch.setattr(packed, "PIXELS", 40)
    assert (packed.grade_stack(frames_, (9, 13), model, batch_size=2) == whole).all()
    assert (np.concatenate([packed.grade_stack(f[None], (9, 13), model) for f in frames_]) == whole).all()


def test_model_of_another_size_is_brought_back():
    from lumenweft.operators import packed

    f = np.full((1, 6, 8, 3), 30000, np.uint16)
    got = packed.grade_stack(f, (4, 3), lambda x: np.repeat(np.repeat(x, 2, 2), 2, 3))
    assert np.abs(got.astype(int) - 30000).max() <= 128


def test_weights_and_models_are_required(tmp_path):
    with pytest.raises(ValueError, match="weights required"):
        results.require_model(results.Options())
    with pytest.raises(ValueError, match="models_dir required"):
        results.require_model(results.Options(weights="w"))
    (tmp_path / "models").mkdir()
    name, build = results.require_model(results.Options(weights="w", models_dir=str(tmp_path / "models")))
    assert name.endswith("models:w")
    with pytest.raises(NotImplementedError):
        build()


def test_config(tmp_path):
    (tmp_path / "lumenweft.toml").write_text("[grade]\nbatch_size = 4\nunknown = 1\n")
    assert results.load_config({}, str(tmp_path)) == {"grade": {"batch_size": 4, "unknown": 1}}
    with pytest.warns(UserWarning, match="does not exist"):
        assert results.load_config({"LUMENWEFT_CONFIG": str(tmp_path / "no")}, str(tmp_path))["grade"]["batch_size"] == 4
    (tmp_path / "bad.toml").write_text("= x")
    with pytest.raises(ValueError):
        results.load_config({"LUMENWEFT_CONFIG": str(tmp_path / "bad.toml")}, str(tmp_path))
    assert results.resolve({"batch_size": 6}, {"batch_size": 4, "proxy_size": 960, "unknown": 1}) == results.Options(batch_size=6, proxy_size=960)
    for n in (0, 33):
        with pytest.raises(ValueError):
            results.resolve({"batch_size": n}, {})
    with pytest.warns(UserWarning):
        results.resolve({"batch_size": 9}, {})
    with pytest.raises(ValueError):
        results.check_input("grade")
    with pytest.raises(FileNotFoundError):
        results.check_input(str(tmp_path / "none.mov"))


# A result document of schema version 2 with every field
def document(label="x", version=2, value=1.0, **config):
    agg = {"n_samples": 2, "mean": value, "stddev": 0.1, "median": 1.0, "ci95_lo": 0.5, "ci95_hi": 1.5, "raw": [1.0, 1.2]}
    state = {
        "kernel_version": "6.17.0", "cpu_governor": "performance", "cpu_turbo_enabled": False, "thp_enabled": "madvise", "swappiness": 10, "gpu_name": "g", "gpu_compute_cap": "8.6",
        "driver_version": "550.54.14", "cuda_version": "12.4", "gpu_clock_graphics_mhz": 1777, "gpu_clock_memory_mhz": 7501, "gpu_clock_graphics_max_mhz": 2100, "gpu_clock_memory_max_mhz": 7501,
        "gpu_power_limit_w": 170, "gpu_persistence_mode": True, "gpu_ecc_enabled": False, "pcie_link_gen_current": 3, "pcie_link_width_current": 16, "pcie_link_gen_max": 4, "pcie_link_width_max": 16,
        "pcie_health_gbps": 11.8, "in_container": False, "python_version": "3.13.0", "torch_version": "2.7.0", "trt_version": None,
    }
    pinning = {"gpu_clocks_locked": True, "gpu_mem_clocks_locked": True, "persistence_mode": True, "cpu_governor_set": None, "page_caches_dropped": True, "clip_prewarmed": True}
    run = {
        "schema_version": 2, "git_sha": "abc", "git_dirty": False, "label": label, "clip_path": "c.mp4", "clip_frames_total": 30, "clip_frames_warmup": 8, "clip_frames_measured": 22, "proxy_w": 1440, "proxy_h": 810,
        "full_w": 3840, "full_h": 2160, "batch_size": 4, "tensorrt": True, "torch_compile": False, "n_samples": 2, "system_state": state, "pinning_applied": pinning,
    }
    slots = {"top_ops": None, "dmon_samples": None, "dram_throughput_pct": None, "sm_throughput_pct": agg, "pyspy_flamegraph_path": None, "torch_trace_path": "t", "nsys_trace_path": None, "ncu_report_path": None}
    spans = [{"name": "upload", "count_per_sample": agg, "p50_ms": agg, "p95_ms": agg, "total_ms": agg}]
    return {"schema_version": version, "config": run | config, "throughput": {m: agg for m in bench.METRICS}, "nvtx_spans": spans, **slots}


def test_results(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document(), indent=2))
    docs = results.read_results(spark, str(tmp_path / "a.json"))
    assert docs.first().asDict(recursive=True) == document()
    assert results.long_metrics(docs).count() == 12
    at = F.to_timestamp(F.lit("2026-01-02 03:04:05"))
    assert results.named(docs, at).first().file_name == "2026-01-02T03-04-05Z_abc_x.json"
    results.write_results(docs, str(tmp_path / "out"))
    assert results.read_results(spark, str(tmp_path / "out")).first() == docs.first()
    (written,) = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".json"]
    assert json.loads(written.read_text()) == document()
    assert json.loads(results.document(document())) == document() and "\n  " in results.document(document())
    for wrong in (document(version=999), {k: v for k, v in document().items() if k != "schema_version"}):
        (tmp_path / "b.json").write_text(json.dumps(wrong))
        with pytest.raises(Exception, match="result of version"):
            results.read_results(spark, str(tmp_path / "b.json")).collect()
    for bad in ({"mean": float("nan")}, {"raw": [1.0, float("inf")]}):
        (name, value) = next(iter(bad.items()))
        held = F.lit(value) if name == "mean" else F.array(*map(F.lit, value))
        broken = docs.withColumn("throughput", F.col("throughput").withField(f"steady_state_fps.{name}", held))
        with pytest.raises(Exception, match="NaN"):
            results.write_results(broken, str(tmp_path / "nan"))


def test_documents_compare(spark, tmp_path):
    from lumenweft.plans import bench_cli

    (tmp_path / "a.json").write_text(json.dumps(document("base")))
    (tmp_path / "b.json").write_text(json.dumps(document("new", batch_size=8, n_samples=5, proxy_w=960, proxy_h=540, tensorrt=False)))
    text = bench_cli.compare(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    for line in ("# Benchmark: base vs new", "- tensorrt: True → False", "- proxy: 1440x810 → 960x540", "- batch_size: 4 → 8", "- samples: 2 vs 5 (different N)", "## Interpretation"):
        assert line in text


def test_a_timed_run_is_cancelled_at_its_limit(spark):
    from lumenweft.plans import bench_cli

    began = time.perf_counter()
    with pytest.raises(TimeoutError):
        bench_cli._seconds(spark.range(0, 10**13, numPartitions=4).selectExpr("sum(sin(id))"), 2.0)
    assert time.perf_counter() - began < 15


def test_state(spark):
    state = results.system_state_frame(spark, probe=False)
    assert state.count() == 1 and len(state.columns) == 25
    assert results.copy_bandwidth(1, 1) > 0
    sha, dirty = results.git_state("/")
    assert sha == "unknown" and dirty is False


def test_payloads(spark):
    df = spark.createDataFrame([(b"\x00\x00\x80\x3f\x01", b"\x01\x02\xff\xff")], "f binary, u binary")
    r = df.select(protocol.f32_values("f").alias("f"), protocol.u16_values("u").alias("u"), protocol.u16_bytes(protocol.u16_values("u")).alias("b"), protocol.adler32("u").alias("a")).first()
    assert r.f == [1.0] and r.u == [513, 65535] and bytes(r.b) == b"\x01\x02\xff\xff" and r.a > 0


def test_late_frames_and_state(spark, tmp_path):
    from lumenweft.streaming import frames as streams

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    black, white = [16] + [0] * 3, [0] * 3 + [16]
    rows = [[("c", 0, black, 16), ("c", 1, black, 16)], [("c", 2, white, 16), ("d", 0, white, 16)], [("c", 1, white, 16), ("c", 3, white, 16)]]
    schema = "clip_id string, frame_id long, hist array<long>, pixels long"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = streams.stream_distances(streams.stream_rows(spark, str(tmp_path / "in"), schema))
        streams.run_to_end(q, streams.parquet_sink(str(tmp_path / "out")), str(tmp_path / "state"))
    got = sorted((r.clip_id, r.frame_id, round(r.distance, 3)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("c", 1, 0.0), ("c", 2, 0.333), ("c", 3, 0.0)]


def test_timed_runs_and_their_comparison(spark, tmp_path):
    from lumenweft.plans import bench_cli

    paths = [bench_cli.run(spark, "q_to_8bit", "/root/testdata/sf0.001", str(tmp_path), label=f"run {k}", samples=2) for k in range(2)]
    assert paths[0].name.endswith("_run_0.json")
    text = bench_cli.compare(spark, *map(str, paths))
    assert "run 0" in text and text.count("\n|") == 4  # the two metrics that a run measures
    assert bench_cli.proxy_size("960x540 and more") == (960, 540)
    for bad in ((1, 30, 8), (5, 8, 8)):
        with pytest.raises(ValueError):
            bench_cli.check_run(*bad)


def test_service_options():
    o = protocol.ServiceOptions(depth_model="d", skip_depth=True)
    assert "--no-depth" in o.arguments() and "--depth-model" not in o.arguments()
    # The flags of the service
    assert protocol.ServiceOptions(weights="w", depth_model="d").arguments()[3:] == ["--raune-weights", "w", "--depth-model", "d"]
    assert protocol.ServiceOptions(skip_enhance=True, weights="w", models_dir="m", device="cpu", maxine=True).arguments()[3:] == ["--no-raune", "--raune-models-dir", "m", "--device", "cpu", "--maxine", "--maxine-upscale-factor", "2"]


def test_environment_numbers():
    assert results.scene_threshold({"LUMENWEFT_SCENE_THRESHOLD": "0.3"}) == 0.3
    assert results.scene_threshold({"LUMENWEFT_SCENE_THRESHOLD": "x"}) == results.scene_threshold({}) == 0.15


def test_image_column(spark):
    df = spark.createDataFrame([(bytes(range(12)), 2, 2), (None, 1, 1)], "p binary, w int, h int")
    out = df.select(protocol.png_of("p", "w", "h").alias("png")).collect()
    assert protocol.decode_png(bytes(out[0].png)).ravel().tolist() == list(range(12)) and out[1].png is None


def test_spans_of_a_grading(spark, tmp_path):
    from lumenweft.operators import packed, transfer

    (tmp_path / "c.raw").write_bytes(np.random.default_rng(1).integers(0, 256, 64 * 48 * 6 * 3).astype(np.uint8).tobytes())
    spans = packed.profile_frames(frames.read_frames(spark, str(tmp_path / "c.raw"), 64, 48, 6), 16, transfer.gamma_model(0.8)).collect()
    assert {r.span for r in spans} == set(packed.SPANS) and all(r.frames == 3 and r.ms_per_frame >= 0 for r in spans)
    assert frames.count_frames(str(tmp_path / "c.raw"), 64, 48, 6) == 3


def test_errors_have_kinds(tmp_path):
    from lumenweft import errors

    with pytest.raises(errors.MediaError) as e:
        frames.count_frames(str(tmp_path / "none.raw"), 4, 2)
    assert e.value.kind == "NotFound" and isinstance(e.value, FileNotFoundError)
    with pytest.raises(errors.MediaError) as e:
        frames.count_frames(str(tmp_path), 0, 2)
    assert e.value.kind == "InvalidMetadata"


def test_surface():
    import lumenweft

    assert all(callable(getattr(lumenweft, name)) for name in lumenweft.__all__)
    with pytest.raises(AttributeError):
        lumenweft.nothing


def test_a_failing_batch_is_raised_once_and_comes_again(spark, tmp_path):
    """The stream stops at the error of a sink, and a restart writes the batch that failed, once."""
    from lumenweft.streaming import frames as streams

    spark.range(10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.range(10, 20).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    good = streams.parquet_sink(str(tmp_path / "out"))
    calls = []

    def failing(rows, number):
        calls.append(number)
        if number == 1:
            raise RuntimeError("the sink broke")
        good(rows, number)

    rows = lambda: streams.stream_rows(spark, str(tmp_path / "in"), "id long")
    with pytest.raises(Exception, match="the sink broke"):
        streams.run_to_end(rows(), failing, str(tmp_path / "state"))
    assert calls == [0, 1]
    streams.run_to_end(rows(), good, str(tmp_path / "state"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))


def test_a_key_is_many_ranges(spark):
    """The as-of and interval joins against plain loops, with gaps longer than a range and ties."""
    import datetime
    import random

    from lumenweft.operators import sequence

    rng = random.Random(3)
    t = lambda: datetime.datetime(2020, 1, 1) + datetime.timedelta(seconds=rng.choice([rng.randrange(400), rng.randrange(10**6)]))
    lefts = [(rng.randrange(2), t(), i) for i in range(150)]
    rights = [(rng.randrange(2), t(), 1000 + i) for i in range(40)]
    left, right = (spark.createDataFrame(rows, f"k int, ts timestamp, {v} int") for rows, v in ((lefts, "i"), (rights, "v")))
    got = {r.i: r.v for r in sequence.as_of(left, right, ["k"], "ts", ["v"], span=100.0).collect()}
    for k, ts, i in lefts:
        want = [(u, v) for j, u, v in rights if j == k and u <= ts]
        assert got[i] == (max(want)[1] if want else None)
    pairs = {(r.i, r.v) for r in sequence.within(left, right.withColumnRenamed("ts", "us"), ["k"], "ts", "us", 300).collect()}
    assert pairs == {(i, v) for k, ts, i in lefts for j, u, v in rights if j == k and 0 <= (u - ts).total_seconds() <= 300}


def test_late_rows_are_counted(spark, tmp_path):
    from lumenweft.streaming import frames as streams

    day = lambda n: f"2020-01-{n:02d} 12:00:00"
    for days in ((1, 2, 3), (9, 10), (1, 11)):
        spark.createDataFrame([(day(n), "x") for n in days], "t string, kind string").selectExpr("to_timestamp(t) AS ts", "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = streams.Progress()
    spark.streams.addListener(listener)
    try:
        counts = streams.event_counts(streams.stream_rows(spark, str(tmp_path / "in"), "ts timestamp, kind string"), "ts", ["kind"], "1 day", "1 day")
        streams.run_to_end(counts.select("w.start", "n"), streams.parquet_sink(str(tmp_path / "out")), str(tmp_path / "state"))
        for _ in range(50):
            if sum(p["late"] for p in listener.seen):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    out = spark.read.schema("start timestamp, n long").parquet(str(tmp_path / "out")).collect()
    assert sorted((r.start.day, r.n) for r in out) == [(1, 1), (2, 1), (3, 1), (9, 1)]
    assert sum(p["late"] for p in listener.seen) == 1 and all("triggerExecution_ms" in p for p in listener.seen)


def test_frames_of_several_sizes_become_one(spark, tmp_path):
    from lumenweft.operators import packed

    rng = np.random.default_rng(4)
    rows = [("a", 0, 8, 6, rng.integers(0, 65536, (6, 8, 3)).astype("<u2").tobytes()), ("b", 0, 4, 3, rng.integers(0, 256, (3, 4, 3)).astype(np.uint8).tobytes()), ("c", 0, 4, 3, None)]
    df = frames.lossless_temp(spark.createDataFrame(rows, frames.SCHEMA), str(tmp_path / "temp"))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
    out = {r.clip_id: r for r in packed.resize_frames(df, 4, 3).collect()}
    assert all((r.width, r.height) == (4, 3) for r in out.values()) and out["c"].pixels is None
    assert (np.frombuffer(out["b"].pixels, "<u2") == np.frombuffer(rows[1][4], np.uint8).astype(np.uint16) * 257).all()
    half = np.frombuffer(rows[0][4], "<u2").reshape(3, 2, 4, 2, 3).mean((1, 3))
    assert np.abs(np.frombuffer(out["a"].pixels, "<u2").reshape(3, 4, 3) - half).max() <= 1
