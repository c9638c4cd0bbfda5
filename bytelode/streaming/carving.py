"""Streams: artifacts of arriving files, and a ledger that is appended to batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.operators.ledger import GENESIS, fold
from bytelode.operators.scan import scan
from bytelode.sources.rawimage import table_chunks


def stream_hits(spark: SparkSession, path: str, schema: str, key: str, data: str, extensions: list[str] | None = None, files_a_batch: int = 8) -> DataFrame:
    """Hits in the rows of Parquet files that arrive in a folder. A row's hits don't depend on other rows, so no state is kept."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return scan(table_chunks(files.withColumn("_bytes", F.encode(data, "UTF-8")), key, "_bytes"), extensions)


def ledger_sink(path: str):
    """A foreachBatch function that appends a batch's events(index, timestamp, operation, operator, detail) to the chain in `path`, by index.
    The last hash is read from what is written, and events up to the last index are skipped, so a repeated batch changes nothing.
    A chain is sequential: one ledger takes one batch at a time, of a size that a task can fold."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        last = None
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            last = spark.read.parquet(path).agg(F.max("index").alias("i"), F.max_by("entry_hash", "index").alias("h")).first()
        new = batch.where(F.col("index") > (last["i"] if last and last["i"] is not None else -1))
        rows = F.array_sort(F.collect_list(F.struct("index", "timestamp", "operation", "operator", "detail")))
        new.agg(rows.alias("e")).select(F.explode(fold("e", F.lit(last["h"] if last and last["h"] else GENESIS))).alias("r")).select("r.*").write.mode("append").parquet(path)

    return append
