"""Files as ranges of bytes, for formats that are cut anywhere: a large file is as many tasks as it has ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range.
RANGE = 16 << 20


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path.removeprefix("file:"))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's name under spark.checkpoint.dir. Where that is unset, under a temporary folder, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='rasterflow-')}"
    return f"{base}/{label}-{uuid.uuid4().hex}"


class ByteRanges(DataSource):
    """spark.read.format("byte_ranges").option("size", n).option("overlap", k).load(folder or file): media_id (the path), start, size (of the range), length (of the file), content.

    The content is the size bytes from start on and overlap more, as far as the file goes. Ranges are read by their tasks, from
    any store whose scheme Arrow knows; names of files are listed by the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "media_id string, start long, size long, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("size", RANGE)), int(self.options.get("overlap", 0)))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, length: int):
        self.path, self.start, self.length = path, start, length


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int, overlap: int):
        self.path, self.size, self.overlap = path, size, overlap

    def partitions(self) -> list[InputPartition]:
        store, path = opened(self.path)
        found = store.get_file_info(path)
        files = [found] if found.is_file else [f for f in store.get_file_info(pa.fs.FileSelector(path, recursive=True)) if f.is_file]
        return [_Range(f.path, at, f.size) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.size)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        with store.open_input_file(part.path) as f:
            content = f.read_at(min(self.size + self.overlap, part.length - part.start), part.start)
        numbers = [pa.array([n], pa.int64()) for n in (part.start, min(self.size, part.length - part.start), part.length)]
        yield pa.RecordBatch.from_arrays([pa.array([part.path]), *numbers, pa.array([content], pa.binary())], ["media_id", "start", "size", "length", "content"])


def ranges_of(media: DataFrame, size: int = RANGE, overlap: int = 0) -> DataFrame:
    """The same rows from media (media_id, content)."""
    length = F.length("content")
    starts = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(size)))
    each = media.select("media_id", F.explode(starts).alias("start"), length.cast("long").alias("length"), "content")
    own = F.least(F.lit(size), F.col("length") - F.col("start")).cast("long")
    return each.select("media_id", F.col("start").cast("long").alias("start"), own.alias("size"), "length", F.substring("content", F.col("start") + 1, F.lit(size + overlap)).alias("content"))
