"""Raw frames as a Spark data source: files of fixed-size RGB records, as a decoder writes them to a pipe or file."""
from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "video long, frame long, time double, height int, width int, pixels binary"


class Stretch(InputPartition):
    def __init__(self, video: int, path: str, first: int, last: int):
        self.video, self.path, self.first, self.last = video, path, first, last


class RawFrames(DataSource):
    """format("raw_frames") with options path (a file, or a folder of *.rgb files, on storage that all executors mount), width, height, fps (default 30), first and last (frames to read, all by default),
    crop ("x,y,w,h"), gray ("true": the mean of the channels, three times), and frames_per_task (default 300). A file's last record counts only if it is whole."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        get = options.get
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])
        self.fps, self.step = float(get("fps", "30")), int(get("frames_per_task", "300"))
        self.first, self.last = int(get("first", "0")), int(get("last", str(2**62)))
        self.crop = [int(x) for x in get("crop", f"0,0,{self.width},{self.height}").split(",")]
        self.gray = get("gray", "false").lower() == "true"

    def size(self) -> int:
        return 3 * self.width * self.height

    def partitions(self) -> list[InputPartition]:
        files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".rgb")) if os.path.isdir(self.path) else [self.path]
        out: list[InputPartition] = []
        for video, f in enumerate(files):
            end = min(os.path.getsize(f) // self.size(), self.last + 1)
            out += [Stretch(video, f, k, min(k + self.step, end)) for k in range(self.first, end, self.step)]
        return out

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        x, y, w, h = self.crop
        with open(part.path, "rb") as f:
            f.seek(part.first * self.size())
            for k in range(part.first, part.last):
                im = np.frombuffer(f.read(self.size()), np.uint8).reshape(self.height, self.width, 3)[y : y + h, x : x + w]
                if self.gray:
                    im = np.repeat(im.mean(axis=2).round().astype(np.uint8)[:, :, None], 3, axis=2)
                yield pa.RecordBatch.from_arrays([pa.array([part.video], pa.int64()), pa.array([k], pa.int64()), pa.array([k / self.fps]), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([np.ascontiguousarray(im).tobytes()], pa.binary())], ["video", "frame", "time", "height", "width", "pixels"])


def read_frames(spark: SparkSession, path: str, width: int, height: int, **options) -> DataFrame:
    """Frames of a file or folder; options as in RawFrames."""
    spark.dataSource.register(RawFrames)
    return spark.read.format("raw_frames").options(path=path, width=str(width), height=str(height), **{k: str(v) for k, v in options.items()}).load()


def sampled(frames: DataFrame, first: float, last: float, count: int, fps: float = 30.0) -> DataFrame:
    """The frames nearest to `count` even times from `first` to `last` seconds."""
    at = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.rint((first + (last - first) * k / max(1, count - 1)) * fps).cast("long"))
    wanted = frames.sparkSession.range(1).select(F.explode(F.array_distinct(at)).alias("frame"))
    return frames.join(wanted, "frame", "left_semi")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, changed of the files in a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", F.col("modificationTime").alias("changed"))


def valid_upload(length, judge_y, threshold):
    """Whether an upload is taken: not empty, 2 GiB at most, its judgement line within (.2, .97) of the height and its threshold within 80 to 245."""
    return F.coalesce((length > 0) & (length <= 2 << 30) & (judge_y > 0.2) & (judge_y < 0.97) & (threshold >= 80) & (threshold <= 245), F.lit(False))
