"""A bit-stream image from read attempts: what could be read, zeros for what could not, and the map of faults."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTOR = 512
#: Further attempts after the first.
RETRIES = 2
# Fixed value: what the fault map says of a sector.
STATUS = "BAD_SECTOR_ZERO_FILLED"


def image_sectors(reads: DataFrame, retries: int = RETRIES) -> DataFrame:
    """One row for each sector of reads(image_id, lba, attempt, data): data of the first attempt that gave a whole sector, or zeros; retries
    made until then; bad. Attempts beyond the retries don't count; a null or short read is a failed one. One hash aggregate: a
    sector has a few attempts at most, so no image is held by one task."""
    tried = reads.where(F.col("attempt").between(0, retries))
    whole = F.length("data") == SECTOR
    best = tried.groupBy("image_id", "lba").agg(F.min(F.when(whole, F.struct("attempt", "data"))).alias("good"), F.max("attempt").alias("last"))
    zeros = F.lit(bytes(SECTOR))
    return best.select("image_id", "lba", F.coalesce("good.data", zeros).alias("data"), F.coalesce("good.attempt", "last").cast("long").alias("retries"), F.col("good").isNull().alias("bad"))


def image_result(sectors: DataFrame) -> DataFrame:
    """For each image of image_sectors' rows: total_bytes, bad_sectors, retries, and whether nothing was lost."""
    out = sectors.groupBy("image_id").agg((F.count("*") * SECTOR).alias("total_bytes"), F.count_if("bad").alias("bad_sectors"), F.sum("retries").alias("retries"))
    return out.withColumn("complete", F.col("bad_sectors") == 0)


def fault_map(sectors: DataFrame) -> DataFrame:
    """The unreadable sectors of image_sectors' rows: image_id, lba, count (always 1), status."""
    return sectors.where("bad").select("image_id", "lba", F.lit(1).cast("long").alias("count"), F.lit(STATUS).alias("status"))


def write_fault_map(sectors: DataFrame, path: str) -> None:
    """The fault map as text in ascending order, a folder for each image: "lba, count, status"."""
    lines = fault_map(sectors).select("image_id", "lba", F.concat_ws(", ", F.col("lba").cast("string"), F.col("count").cast("string"), "status").alias("value"))
    ordered = lines.repartitionByRange("image_id", "lba").sortWithinPartitions("image_id", "lba")
    ordered.select("image_id", "value").write.mode("overwrite").partitionBy("image_id").text(path)


def image_digest(chunks: DataFrame) -> DataFrame:
    """SHA-256 of whole images from chunks(image_id, chunk_start, data): image_id, n_bytes, sha256. The digest depends on the order of all bytes,
    so an image streams through one task, a chunk at a time; images are independent."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, state, n = None, None, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([image]), pa.array([n], pa.int64()), pa.array([state.hexdigest()])], names=["image_id", "n_bytes", "sha256"])

        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or own != image:
                    if state is not None:
                        yield out()
                    image, state, n = own, hashlib.sha256(), 0
                state.update(data or b"")
                n += len(data or b"")
        if state is not None:
            yield out()

    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = chunks.select("image_id", "chunk_start", "data").repartition(tasks, "image_id").sortWithinPartitions("image_id", "chunk_start")
    return ordered.mapInArrow(digest, "image_id string, n_bytes long, sha256 string")
