"""Signature scan: places in byte chunks where a rule's magic stands."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelode.functions.catalog import Rule, rules
from bytelode.session import durable

#: Bytes that a chunk holds beyond those it owns: more than any check of a header needs.
LOOKAHEAD = 16 * 1024
SECTOR = 512
HITS = "image_id string, offset long, sig_idx int"
# Sizes of bitmap headers.
DIB_SIZES = (12, 40, 52, 56, 64, 108, 124)


def _u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "little")


def adts_frame(b: bytes) -> int | None:
    """Length of the AAC frame that begins here, or None."""
    if len(b) < 7 or b[0] != 0xFF or b[1] & 0xF6 != 0xF0 or (b[2] >> 2) & 15 >= 12:
        return None
    size = (b[3] & 3) << 11 | b[4] << 3 | b[5] >> 5
    return size if 7 <= size <= 8192 else None


def header_ok(ext: str, w: bytes) -> bool:
    """The second look at a hit: whether the bytes from the magic on can be the header of such a file."""
    match ext:
        case "bmp":
            return len(w) >= 18 and w[6:10] == bytes(4) and _u32(w, 14) in DIB_SIZES and 54 <= _u32(w, 2) <= 200 << 20
        case "exe":
            return len(w) >= 64 and 64 <= (at := _u32(w, 60)) <= 1024 and w[at : at + 4] == b"PE\0\0"
        case "wav" | "webp":
            return w[8:12] == (b"WAVE" if ext == "wav" else b"WEBP")
        case "ico":
            return len(w) >= 6 and w[2:4] == b"\1\0" and w[4] > 0
        case "aac":
            if (size := adts_frame(w)) is None:
                return False
            return len(w) < size + 2 or w[size] == 0xFF and w[size + 1] & 0xF6 == 0xF0
        case "mp3":
            if w[:3] == b"ID3":
                return len(w) >= 10 and w[3] <= 4 and all(x < 128 for x in w[6:10])
            return len(w) >= 3 and w[0] == 0xFF and w[1] in (0xFA, 0xFB) and w[2] >> 4 not in (0, 15) and (w[2] >> 2) & 3 != 3
        case "json":
            if len(w) < 6 or w[:2] != b'{"':
                return len(w) >= 6
            close = w.find(b'"', 2, 48)
            if close < 0 or any(not 32 <= x < 127 for x in w[2:close]):
                return False
            rest = w[close + 1 : 56].lstrip(b" \t\r\n")
            return rest[:1] == b":"
    return True


@lru_cache(maxsize=16)
def _automaton(table: tuple[Rule, ...]) -> ahocorasick.Automaton:
    """All magics at once, as Latin-1 text: each with its rules."""
    found, by_magic = ahocorasick.Automaton(), {}
    for rule in table:
        by_magic.setdefault(rule.magic, []).append(rule)
    for magic, own in by_magic.items():
        found.add_word(magic.decode("latin-1"), (len(magic), own))
    found.make_automaton()
    return found


def hits_in(data: bytes, start: int, owned: int, table: list[Rule]) -> Iterator[tuple[int, int]]:
    """(offset, rule) of the hits that begin in the first `owned` bytes, in one pass over them and the longest magic's tail. Overlapping
    magics are all found; magics of two bytes count at sector starts only."""
    if not table:
        return
    longest = max(len(r.magic) for r in table)
    for end, (size, own) in _automaton(tuple(table)).iter(data[: owned + longest - 1].decode("latin-1")):
        at = end - size + 1
        if at >= owned or size <= 2 and (start + at) % SECTOR:
            continue
        for rule in own:
            if header_ok(rule.extension, data[at : at + LOOKAHEAD]):
                yield start + at, rule.number


def header_checks(rows: DataFrame) -> DataFrame:
    """rows(..., extension, data) with ok: whether the bytes can be the header of such a file."""

    @F.pandas_udf("boolean")
    def check(extension: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([header_ok(e, d or b"") for e, d in zip(extension, data, strict=True)], dtype=bool)

    return rows.withColumn("ok", check("extension", "data"))


def scan(chunks: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Hits of chunks(image_id, chunk_start, owned_len, data). A chunk owns the hits that begin in its first owned_len bytes and only looks
    at what follows, so chunks of any size give the same hits, each once, without a shuffle."""
    table = rules(extensions)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for image, start, owned, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(image, at, n) for at, n in sorted(hits_in(data or b"", start, owned, table))]
            yield pa.RecordBatch.from_pylist([dict(zip(("image_id", "offset", "sig_idx"), r, strict=True)) for r in out], schema=pa.schema([("image_id", pa.string()), ("offset", pa.int64()), ("sig_idx", pa.int32())]))

    return chunks.select("image_id", "chunk_start", "owned_len", "data").mapInArrow(find, HITS)


def virtual_layout(files: DataFrame, order: str, size: str) -> DataFrame:
    """Where files stand one after the other on an image, each from a sector's start: adds start. Bytes before a file are summed by
    ranges of the order first, so that no task sees all files. The ranges are checkpointed: dealt out twice, they need not be the same."""
    sectors = F.ceil(F.col(size) / SECTOR).cast("long") * SECTOR
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(files.repartitionByRange(tasks, order).withColumn("_part", F.spark_partition_id()).withColumn("_size", sectors))
    before = ranged.groupBy("_part").agg(F.sum("_size").alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("start", F.col("_before") + F.col("_inside")).drop("_part", "_size", "_before", "_inside")
