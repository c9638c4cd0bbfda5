"""Shared pieces of the training-data operators: scratch tables, row numbering, components, word ids."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where that is unset, a temporary one, on a single machine only, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "bytelode-scratch")


#: Scratch folders that this process has made and not yet taken away.
_MADE: dict[str, Scratch] = {}


class Scratch:
    """Tables of one operator run in the shared folder. A table cuts the lineage and survives lost executors.

    A result may be read lazily from such tables, so they stay until drop(), clear_scratch() or the end of the driver's process."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        _MADE[self.path] = self
        df.write.option("compression", codec).parquet(f"{self.path}/{name}")
        return self.load(name, df)

    def load(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes the named tables, or all of this run."""
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if not names:
            _MADE.pop(self.path, None)


def clear_scratch() -> None:
    """Deletes the tables of all operator runs of this process. Call it when no result is read any more; a long session needs it."""
    for scratch in list(_MADE.values()):
        try:
            scratch.drop()
        except Exception:  # noqa: BLE001  the session may have ended before
            _MADE.pop(scratch.path, None)


atexit.register(clear_scratch)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has one of them in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text, so that a text need not be shuffled to be grouped."""
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("key_b")]


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """Connected components of edges(a, b) by minimum labels with pointer jumping: rows (node, component), the component being
    its smallest node. Nodes without an edge are not returned. Rounds grow with the logarithm of the longest chain; every
    round reads written tables, so a hot node only gives joins that adaptive execution splits."""
    both = scratch.save(
        edges.select("a", "b").where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        f"{tag}-edges",
    )
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{tag}-0")
    step = 0
    while True:
        step += 1
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        hooked = scratch.save(
            labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid")), f"{tag}-{step}m"
        )
        jumped = hooked.alias("l").join(hooked.select(F.col("node").alias("mid"), F.col("mid").alias("next")), "mid").select("node", "old", F.least("mid", "next").alias("component"))
        jumped = scratch.save(jumped, f"{tag}-{step}")
        changed = jumped.where("old <> component").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels


class WordIds(dict):
    """Word bytes -> 64-bit hash, remembered; the memory is emptied when it holds too many words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_WORDS = WordIds()


def word_hashes(text: bytes) -> np.ndarray:
    """One uint64 for each word of a whole text (bytes.split() parts at the six separators above)."""
    words = text.split()
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, n: int = 5) -> np.ndarray:
    """The sorted set of hashed word n-grams. A text of 1 to n-1 words has one shingle, of all its words; an empty one none."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix64(words[i : len(words) - size + 1 + i] + np.uint64(size))
    return np.unique(mix64(out))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def table_batches(rows: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of consecutive rows with equal keys, of a partition sorted by them."""
    key, group = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in keys)
            if k != key and group:
                yield key, group
                group = []
            key = k
            group.append(row)
    if group:
        yield key, group
