"""Raw images as tables of byte chunks: a Spark data source, batch and streaming, over files that all tasks can reach."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from bytelode.operators.scan import LOOKAHEAD

CHUNK = 16 << 20
SCHEMA = "image_id string, chunk_start long, owned_len int, data binary"


class Chunk(InputPartition):
    def __init__(self, path: str, start: int, owned: int, ahead: int):
        self.path, self.start, self.owned, self.ahead = path, start, owned, ahead


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path (s3://, hdfs://, gs://, file:// or a plain path, which all tasks must reach) and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def image_files(pattern: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files that the pattern names; its last part may hold *, ? and [...]."""
    store, path = _store(pattern)
    scheme = pattern[: len(pattern) - len(path)] if "://" in pattern and pattern.endswith(path) else ""
    folder, name = path.rsplit("/", 1) if "/" in path else ("", path)
    if any(c in name for c in "*?["):
        found = [x for x in store.get_file_info(fs.FileSelector(folder or ".")) if x.is_file and fnmatch.fnmatch(x.base_name, name)]
    else:
        found = [x for x in [store.get_file_info(path)] if x.is_file]
    return sorted((scheme + x.path, x.size) for x in found)


def read_range(path: str, start: int, size: int) -> bytes:
    store, inside = _store(path)
    with store.open_input_file(inside) as f:
        return f.read_at(max(0, min(size, f.size() - start)), start) if start < f.size() else b""


def _chunks(path: str, begin: int, end: int, size: int, ahead: int) -> list[InputPartition]:
    return [Chunk(path, at, min(size, end - at), ahead) for at in range(begin, end, size)]


def _read(part: Chunk) -> Iterator[pa.RecordBatch]:
    data = read_range(part.path, part.start, part.owned + part.ahead)
    yield pa.RecordBatch.from_arrays([pa.array([part.path.rsplit("/", 1)[-1]]), pa.array([part.start], pa.int64()), pa.array([part.owned], pa.int32()), pa.array([data], pa.binary())], names=["image_id", "chunk_start", "owned_len", "data"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.size, self.ahead = image_files(options["path"]), int(options.get("chunk", CHUNK)), int(options.get("lookahead", LOOKAHEAD))

    def partitions(self) -> list[InputPartition]:
        return [c for path, size in self.files for c in _chunks(path, 0, size, self.size, self.ahead)]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class _StreamReader(DataSourceStreamReader):
    """A growing image; the offset is how far it has been given out. A place is given out once the bytes that its hits may look ahead to are
    there; the rest follows when a file of the image's name and ".closed" says that nothing will be added."""

    def __init__(self, options: dict):
        self.path, self.size, self.ahead = options["path"], int(options.get("chunk", CHUNK)), int(options.get("lookahead", LOOKAHEAD))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        size = sum(n for _, n in image_files(self.path))
        return {"at": size if image_files(self.path + ".closed") else max(0, size - self.ahead)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _chunks(self.path, start["at"], end["at"], self.size, self.ahead)

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class RawImage(DataSource):
    """spark.read.format("rawimage").option("path", pattern).option("chunk", bytes); readStream follows one growing image."""

    @classmethod
    def name(cls) -> str:
        return "rawimage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_image(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    spark.dataSource.register(RawImage)
    return spark.read.format("rawimage").option("path", path).option("chunk", chunk).load()


def normalise_path(path: Column) -> Column:
    """Trimmed; a bare drive letter becomes its device name."""
    trimmed = F.trim(path)
    return F.when(trimmed.rlike(r"^[A-Za-z]:\\?$"), F.concat(F.lit("\\\\.\\"), F.substring(trimmed, 1, 2))).otherwise(trimmed)


def table_chunks(files: DataFrame, key: str, data: str) -> DataFrame:
    """Rows of a table as images of one chunk each."""
    return files.select(F.col(key).cast("string").alias("image_id"), F.lit(0).cast("long").alias("chunk_start"), F.length(data).cast("int").alias("owned_len"), F.col(data).alias("data"))
