"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous sweeps over runs of equal lengths."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelode.llm.common import Scratch, read_table
from bytelode.llm.encode import default_vocabulary, encoder

CAPACITY = 4096
#: Lengths are whole numbers up to the capacity, so their histogram, the gaps and the matches are bounded by it.
MAX_CAPACITY = 1 << 16

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The pieces of each row of docs(doc_id, text): its ids and the end id, cut only where they are longer than the capacity.

    copy tells apart rows with one doc_id. A null text is empty: one piece that holds the end id.
    """
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            rows, docs_, copies = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, _, ids, ends in words.slices(batch.column(2)):
                data, begin = memoryview(np.ascontiguousarray(ids)).cast("B"), 0
                for k, end in enumerate(ends.tolist(), first):
                    for piece, at in enumerate(range(begin, end, capacity)):
                        stop = min(at + capacity, end)
                        rows.append((docs_[k], copies[k], piece, at - begin, stop - at, zlib.crc32(data[4 * at : 4 * stop])))
                    begin = end
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("copy"), "text").mapInArrow(cut, PIECES)


def best_fit_sweeps(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Matches of runs of documents with runs of gaps: (length, rank of first document, documents, first sequence, documents in
    each sequence, offset), and the number of sequences.

    State: runs of equal documents (length, count) and runs of sequences with equal gaps. One sweep takes the longest unplaced
    run and walks its successors, the gaps of at least its length, smallest first. All documents of the run want the same gap;
    their ranks decide who gets it: rank r takes sequence r // k of the run, where k documents fit a gap. What finds none
    opens new sequences. Then the gaps are updated, and the next sweep follows. This is what placing the documents one by one,
    longest first, each into the fullest sequence it fits, arrives at.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first sequence, count)
    order: list[int] = []  # gaps, sorted
    placed, sequences = [], 0

    def add(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first = capacity, sequences
                count = -(-left // (capacity // length))
                sequences += count
            fit = gap // length
            full = min(count, left // fit)
            if full:
                placed.append((length, rank, full * fit, first, fit, capacity - gap))
                add(gap - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
            if left and full < count:  # the last documents of the run share one sequence
                placed.append((length, rank, left, first + full, left, capacity - gap))
                add(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            add(gap, first + full, count - full)
    return placed, sequences


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(doc_id, copy, piece, length, ...) with sequence_id and offset. Lengths are 1 to capacity.

    Documents are range-sorted by length; their ranks come from counts by partition and length (at most one row for each length
    and partition), never from one task. Matches are rows for runs, so that what is broadcast depends on the capacity alone.
    Ties are by doc_id (null first), then copy and piece. An empty table gives an empty result.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be 1 to {MAX_CAPACITY}")
    spark = pieces.sparkSession
    scratch = Scratch(spark, "pack")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = pieces.repartitionByRange(tasks, F.col("length").desc(), "doc_id", "copy", "piece").withColumn("_part", F.spark_partition_id())
    ranged = scratch.save(ranged, "ranged")
    local = ranged.groupBy("_part", "length").agg(F.count("*").alias("n"))
    counted = local.collect()  # partitions + capacity rows at most: a length that fills partitions is alone in them
    totals: dict[int, int] = {}
    offsets = []
    for r in sorted(counted, key=lambda r: (-r["length"], r["_part"])):
        offsets.append((r["_part"], r["length"], totals.get(r["length"], 0)))
        totals[r["length"]] = totals.get(r["length"], 0) + r["n"]
    placed, _ = best_fit_sweeps(totals, capacity)
    before = spark.createDataFrame(offsets, "_part int, length long, _before long")
    rank = F.row_number().over(Window.partitionBy("_part", "length").orderBy("doc_id", "copy", "piece")) - 1
    ranked = ranged.join(F.broadcast(before), ["_part", "length"]).withColumn("_rank", rank + F.col("_before"))
    runs = spark.createDataFrame(placed, "length long, _first long, _count long, _sequence long, _fit long, _offset long")
    by_length = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("_first", "_count", "_sequence", "_fit", "_offset"))).alias("_runs"))
    hit = F.filter("_runs", lambda x: (x["_first"] <= F.col("_rank")) & (F.col("_rank") < x["_first"] + x["_count"]))[0]
    out = ranked.join(F.broadcast(by_length), "length").withColumn("_hit", hit)
    within = F.col("_rank") - F.col("_hit._first")
    return out.select(
        *[c for c in pieces.columns if c != "copy"],
        (F.col("_hit._sequence") + F.floor(within / F.col("_hit._fit"))).cast("long").alias("sequence_id"),
        (F.col("_hit._offset") + within % F.col("_hit._fit") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Documents as pieces, each with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of docs is packed, repeated rows and null ids too; a null text is empty. Further columns are ignored.
    """
    spark = docs.sparkSession
    return best_fit_pack(Scratch(spark, "pieces").save(token_pieces(docs, capacity, vocabulary), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
