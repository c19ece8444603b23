"""Raw frame files as a data source and sink.

A file holds frames of w * h pixels, 3 bytes each (rgb24) or 6 (rgb48, little
endian).  The reader plans ranges of frames as partitions, so one large file is
read by many tasks, and hands over Arrow batches of bounded size; a short last
frame is dropped.  The sink writes a file for each task and clip, named by the
clip and its first frame, under a temporary name that the driver's commit
renames, so an aborted write leaves nothing behind, a repeated task replaces its
own file and the files of a clip sort in frame order.  Paths are plain ones that
all executors see, or URIs of a store (hdfs, s3, gs) that pyarrow opens.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import FrameSizeError, MediaKind, MediaNotFound
from ..operators import sequence

SCHEMA = "clip_id string, frame_id long, width int, height int, pixels binary"
ARROW_SCHEMA = pa.schema([("clip_id", pa.string()), ("frame_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])
#: Bytes of frames in one batch on its way; a larger frame goes alone.
BATCH_BYTES = 32 << 20
#: Bytes of frames that one task reads, at most 64 frames and at least one.
PARTITION_BYTES = 64 << 20


@dataclass
class FrameRange(InputPartition):
    path: str
    first: int
    last: int


class _Layout:
    def __init__(self, options: dict):
        self.given = options["path"]
        self.width, self.height = int(options["width"]), int(options["height"])
        self.pixel = int(options.get("bytes_per_pixel", "3"))
        if self.pixel not in (3, 6) or self.width < 1 or self.height < 1:
            raise FrameSizeError(MediaKind.INVALID_METADATA, "width, height and 3 or 6 bytes_per_pixel are needed")
        self.size = self.width * self.height * self.pixel
        self.step = int(options.get("frames_per_partition", 0)) or max(1, min(64, PARTITION_BYTES // self.size))

    def store(self) -> tuple[fs.FileSystem, str]:
        """The file system and the path within it; opened where it is used, since it does not travel."""
        if "://" in self.given:
            return fs.FileSystem.from_uri(self.given)
        return fs.LocalFileSystem(), self.given.removeprefix("file:")

    def files(self) -> list[fs.FileInfo]:
        store, path = self.store()
        info = store.get_file_info(path)
        if info.type == fs.FileType.Directory:
            inside = store.get_file_info(fs.FileSelector(path))
            return sorted((f for f in inside if f.is_file and f.path.endswith(".raw") and not f.base_name.startswith(".")), key=lambda f: f.path)
        if info.type == fs.FileType.NotFound:
            raise MediaNotFound(self.given)
        return [info]

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        clip, _, first = posixpath.basename(part.path).removesuffix(".raw").rpartition("@")
        base = int(first) if clip and first.isdigit() else 0
        clip = clip if clip and first.isdigit() else posixpath.basename(part.path).removesuffix(".raw")
        many = max(1, BATCH_BYTES // self.size)
        with self.store()[0].open_input_file(part.path) as file:
            for at in range(part.first, part.last, many):
                data = [file.read_at(self.size, k * self.size) for k in range(at, min(part.last, at + many))]
                data = [d for d in data if len(d) == self.size]  # the file may end within a frame
                n = len(data)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([clip] * n), pa.array(range(base + at, base + at + n), pa.int64()), pa.array([self.width] * n, pa.int32()), pa.array([self.height] * n, pa.int32()), pa.array(data, pa.binary())],
                        schema=ARROW_SCHEMA,
                    )


class _Reader(_Layout, DataSourceReader):
    def partitions(self):
        out = []
        for f in self.files():
            n = f.size // self.size
            out += [FrameRange(f.path, at, min(n, at + self.step)) for at in range(0, n, self.step)]
        return out


class _StreamReader(_Layout, DataSourceStreamReader):
    """One file as a stream.

    A new reader, at the start as after a restart, is not told how far the
    stream came: its first batch offers all that the file holds, in tasks of
    ``frames_per_partition``, which never lies before the last committed frame.
    What arrives later is taken ``frames_per_trigger`` frames at a time.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.most = int(options.get("frames_per_trigger", "16"))
        self.seen: int | None = None

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        (info,) = self.files()
        n = info.size // self.size
        return {"frame": n if self.seen is None else max(self.seen, min(n, self.seen + self.most))}

    def partitions(self, start: dict, end: dict):
        self.seen = end["frame"]
        path = self.store()[1]
        return [FrameRange(path, at, min(end["frame"], at + self.step)) for at in range(start["frame"], end["frame"], self.step)]

    def commit(self, end: dict) -> None:
        return None


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class _Writer(_Layout, DataSourceWriter):
    def write(self, rows) -> Written:
        store, path = self.store()
        store.create_dir(path, recursive=True)
        done, out, clip = Written(), None, None
        try:
            for row in rows:  # in the order given: sort within partitions before writing
                if len(row.pixels) != self.size:
                    raise FrameSizeError(MediaKind.ENCODE_FAILED, f"frame {row.frame_id} has {len(row.pixels)} bytes, not {self.size}")
                if out is None or row.clip_id != clip:
                    if out is not None:
                        out.close()
                    clip = row.clip_id
                    temporary = f"{path}/.{uuid.uuid4().hex}.tmp"
                    done.files.append((temporary, f"{path}/{clip or 'clip'}@{row.frame_id:012d}.raw"))
                    out = store.open_output_stream(temporary)
                out.write(row.pixels)
        except BaseException:
            if out is not None:
                out.close()
            self.abort([done])
            raise
        if out is not None:
            out.close()
        return done

    def commit(self, messages) -> None:
        store = self.store()[0]
        for temporary, final in (f for m in messages if m is not None for f in m.files):
            store.move(temporary, final)

    def abort(self, messages) -> None:
        store = self.store()[0]
        for temporary, _ in (f for m in messages if m is not None for f in m.files):
            if store.get_file_info(temporary).is_file:
                store.delete_file(temporary)


class RawFrames(DataSource):
    """``spark.read.format("raw_frames")`` with path, width, height, bytes_per_pixel."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawFrames)


def read_frames(spark: SparkSession, path: str, width: int, height: int, bytes_per_pixel: int = 3) -> DataFrame:
    """Frames of a raw file or a folder of .raw files."""
    register(spark)
    return spark.read.format("raw_frames").options(path=path, width=width, height=height, bytes_per_pixel=bytes_per_pixel).load()


def count_frames(path: str, width: int, height: int, bytes_per_pixel: int = 3) -> int:
    """Whole frames of a raw file or folder, counted without reading pixels."""
    layout = _Layout({"path": path, "width": str(width), "height": str(height), "bytes_per_pixel": str(bytes_per_pixel)})
    return sum(f.size // layout.size for f in layout.files())


def write_frames(frames: DataFrame, path: str, width: int, height: int, bytes_per_pixel: int = 6) -> None:
    """Frames in the order of their partitions, such as they are read and graded."""
    register(frames.sparkSession)
    frames.select("clip_id", "frame_id", "width", "height", "pixels").write.format("raw_frames").options(path=path, width=width, height=height, bytes_per_pixel=bytes_per_pixel).mode("append").save()


def lossless_temp(frames: DataFrame, folder: str) -> DataFrame:
    """Frames kept as they are in a shared folder, compressed without loss, and read back from there."""
    frames.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return frames.sparkSession.read.schema(frames.schema).parquet(folder)


def frame_at(frames: DataFrame, seconds: float, fps: float) -> DataFrame:
    """Of each clip the first frame at or after the moment (to the millisecond)."""
    wanted = round(seconds, 3) * fps
    later = frames.where(F.col("frame_id") >= F.ceil(F.lit(wanted - 1e-9)))
    return later.groupBy("clip_id").agg(F.min_by(F.struct(*[c for c in frames.columns if c != "clip_id"]), "frame_id").alias("f")).select("clip_id", "f.*")


def split_records(payloads: DataFrame, size: int) -> DataFrame:
    """Fixed-length records of a byte column; a short tail is dropped.  payloads: clip_id, payload."""
    n = F.floor(F.octet_length("payload") / size).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cut = payloads.select("clip_id", "payload", F.explode(index).alias("frame_id"))
    return cut.select("clip_id", F.col("frame_id").cast("long").alias("frame_id"), F.substring("payload", F.col("frame_id") * size + 1, F.lit(size)).alias("pixels"))


def renumber(frames: DataFrame, by: list[str], order: str = "frame_id", out: str = "pts") -> DataFrame:
    """Dense numbers from 0 in frame order."""
    return sequence.renumber(frames, by, order, out)


def batches(frames: DataFrame, by: list[str], size: int, order: str = "frame_id") -> DataFrame:
    """Batch numbers of ``size`` frames in order; the last batch may be short."""
    return renumber(frames, by, order, "__n").withColumn("batch", F.floor(F.col("__n") / size).cast("long")).drop("__n")


def progress_rows(frames: DataFrame, by: list[str], batch_size: int, every: int = 4, order: str = "frame_id") -> DataFrame:
    """The frames at which progress is reported, with the number done."""
    numbered = renumber(frames, by, order, "__n").withColumn("done", F.col("__n") + 1)
    return numbered.where(F.col("done") % (batch_size * every) == 0).drop("__n")


def check_sizes(frames: DataFrame, bytes_per_pixel: int) -> DataFrame:
    """An error for a frame whose bytes do not fit its size."""
    fits = F.octet_length("pixels") == F.col("width") * F.col("height") * bytes_per_pixel
    return frames.withColumn("pixels", F.when(fits, F.col("pixels")).otherwise(F.raise_error(F.lit("frame of a wrong size")).cast("binary")))
