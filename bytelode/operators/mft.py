"""NTFS file records: which sectors hold one, what it says, and whether its times were tampered with."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelode.functions.binary import FILETIME_SECOND
from bytelode.sources.rawimage import image_files, read_range

RECORD = 1024
TIMES = "created long, modified long, mft_modified long, accessed long"
PARSED = (
    "image_id string, record_offset long, is_in_use boolean, is_directory boolean, filename string, parent_record long, file_size long, is_resident boolean, resident_preview string, "
    f"can_extract boolean, si struct<{TIMES.replace(' long', ':long')}>, fn struct<{TIMES.replace(' long', ':long')}>"
)


def accept_sectors(sectors: DataFrame) -> DataFrame:
    """Of sectors(image_id, lba) that begin like a record, those that a reader which steps over a record's second sector tests: in each run of
    neighbouring sectors the first, third, fifth ... Adds record_number, their ordinal in the image."""
    by_lba = Window.partitionBy("image_id").orderBy("lba")
    island = sectors.withColumn("_island", F.col("lba") - F.row_number().over(by_lba))
    inside = Window.partitionBy("image_id", "_island").orderBy("lba")
    taken = island.withColumn("_n", F.row_number().over(inside)).where("_n % 2 = 1")
    return taken.select("image_id", "lba", (F.row_number().over(by_lba) - 1).cast("long").alias("record_number"))


def fixed_up(b: bytes) -> bytes:
    """The record with the last two bytes of its sectors put back from the update sequence array."""
    data = bytearray(b)
    at, count = struct.unpack_from("<HH", b, 4)
    for k in range(1, count):
        if at + 2 * k + 2 <= len(b) and 512 * k <= len(b):
            data[512 * k - 2 : 512 * k] = b[at + 2 * k : at + 2 * k + 2]
    return bytes(data)


def _times(b: bytes, at: int) -> dict | None:
    if at + 32 > len(b):
        return None
    created, modified, changed, accessed = struct.unpack_from("<QQQQ", b, at)
    return {"created": created & (2**63 - 1), "modified": modified & (2**63 - 1), "mft_modified": changed & (2**63 - 1), "accessed": accessed & (2**63 - 1)}


def parse_record(b: bytes) -> dict | None:
    """The columns after record_offset of a raw record, or None if it is none. Attributes that don't fit end the walk; nothing raises."""
    if b[:4] != b"FILE" or len(b) < RECORD:
        return None
    b = fixed_up(b[:RECORD])
    flags = struct.unpack_from("<H", b, 22)[0]
    out = dict.fromkeys(("filename", "parent_record", "resident_preview", "si", "fn"))
    out |= {"is_in_use": bool(flags & 1), "is_directory": bool(flags & 2), "file_size": 0, "is_resident": False}
    space, at, has_data = None, struct.unpack_from("<H", b, 20)[0], False
    while at + 16 <= RECORD:
        kind, size = struct.unpack_from("<II", b, at)
        if kind in (0, 0xFFFFFFFF) or size < 16 or at + size > RECORD:
            break
        resident = b[at + 8] == 0
        content = at + struct.unpack_from("<H", b, at + 20)[0] if at + 22 <= RECORD else RECORD
        if kind == 0x10 and resident:
            out["si"] = _times(b, content)
        elif kind == 0x30 and resident and content + 66 <= RECORD:
            letters, own = b[content + 64], b[content + 65]
            if out["filename"] is None or space == 2 and own != 2:
                out["parent_record"] = struct.unpack_from("<Q", b, content)[0] & ((1 << 48) - 1)
                out["fn"] = _times(b, content + 8)
                out["filename"] = b[content + 66 : content + 66 + 2 * letters].decode("utf-16-le", "replace")
                space = own
        elif kind == 0x80:
            has_data = True
            out["is_resident"] = resident
            if resident:
                length = struct.unpack_from("<I", b, at + 16)[0]
                body = b[content : min(content + length, RECORD)]
                out["file_size"] = length
                out["resident_preview"] = "".join(chr(x) if 32 <= x < 127 else "." for x in body[:64])
            elif at + 56 <= RECORD:
                out["file_size"] = struct.unpack_from("<Q", b, at + 48)[0] & (2**63 - 1)
        at += size
    out["can_extract"] = has_data
    return out


def parse(records: DataFrame) -> DataFrame:
    """records(image_id, record_offset, data) that are file records, with their columns."""
    names = ["image_id", "record_offset", "is_in_use", "is_directory", "filename", "parent_record", "file_size", "is_resident", "resident_preview", "can_extract", "si", "fn"]
    times = pa.struct([(x, pa.int64()) for x in ("created", "modified", "mft_modified", "accessed")])
    schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), times, times], strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"image_id": i, "record_offset": o} | r for i, o, d in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (r := parse_record(d or b""))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return records.select("image_id", "record_offset", "data").mapInArrow(read, PARSED)


def timestomp(si_created: Column, si_modified: Column, fn_created: Column, fn_modified: Column) -> Column:
    """severity and delta_seconds of the first rule that holds, on raw FILETIMEs; null if none does."""
    late = F.lit(2 * FILETIME_SECOND)
    hit = lambda level, delta: F.struct(F.lit(level).alias("severity"), delta.cast("long").alias("delta_seconds"), (si_modified % FILETIME_SECOND == 0).alias("subsecond_zeroed"))
    return (
        F.when(si_modified + late < fn_created, hit("CRITICAL", F.floor((fn_created - si_modified) / F.lit(FILETIME_SECOND))))
        .when(si_created + late < fn_created, hit("CRITICAL", F.floor((fn_created - si_created) / F.lit(FILETIME_SECOND))))
        .when((si_modified % FILETIME_SECOND == 0) & (fn_modified % FILETIME_SECOND != 0), hit("WARNING", F.lit(0)))
    )


def with_alert(parsed: DataFrame) -> DataFrame:
    alert = timestomp(F.col("si.created"), F.col("si.modified"), F.col("fn.created"), F.col("fn.modified"))
    return parsed.withColumn("timestomp_alert", alert).withColumn("timestomp_detected", F.col("timestomp_alert").isNotNull())


def mft_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("scanned"), F.count_if("is_in_use").alias("active"), F.count_if(~F.col("is_in_use")).alias("deleted"), F.count_if("timestomp_detected").alias("timestomps"))


def runs_of(b: bytes, cluster: int = 4096) -> list[tuple[int | None, int]]:
    """(byte offset from the start of the image, or None if sparse; bytes) of each run of a run list."""
    out, at, lcn = [], 0, 0
    while at < len(b) and b[at]:
        n, m = b[at] & 15, b[at] >> 4
        if at + 1 + n + m > len(b):
            break
        count = int.from_bytes(b[at + 1 : at + 1 + n], "little")
        if m:
            lcn += int.from_bytes(b[at + 1 + n : at + 1 + n + m], "little", signed=True)
        out.append((lcn * cluster if m else None, count * cluster))
        at += 1 + n + m
    return out


def data_runs(record: bytes) -> tuple[bytes | None, list[tuple[int | None, int]], int] | None:
    """A record's first data attribute: its bytes if they stand in the record, else its runs, and its real size. None without one. Update
    sequences are not put back here. What doesn't fit in the record ends it."""
    if len(record) < 48:
        return None
    at = struct.unpack_from("<H", record, 20)[0]
    while at + 24 <= len(record):
        kind, size = struct.unpack_from("<II", record, at)
        if kind in (0, 0xFFFFFFFF) or size < 16 or at + size > len(record):
            return None
        if kind == 0x80:
            if record[at + 8] == 0:
                length, content = struct.unpack_from("<IH", record, at + 16)
                body = record[at + content : at + content + length]
                return body, [], len(body)
            if size < 56:
                return None
            first, real = struct.unpack_from("<H", record, at + 32)[0], struct.unpack_from("<Q", record, at + 48)[0]
            return None, runs_of(record[at + first : at + size]), real
        at += size
    return None


def extract(record: bytes, read, most: int = 1 << 30) -> bytes | None:
    """The content of a record's first data attribute, `most` bytes at most; read(offset, size) gives bytes of the image. Sparse runs are
    zeros; no more than the real size is ever made."""
    found = data_runs(record)
    if found is None or found[0] is not None:
        return found and found[0]
    out, left = [], min(found[2], most)
    for offset, size in found[1]:
        size = min(size, left)
        if size <= 0:
            break
        out.append(bytes(size) if offset is None else read(offset, size))
        left -= size
    return b"".join(out)


def record_sectors(chunks: DataFrame) -> DataFrame:
    """Sectors of chunks(image_id, chunk_start, owned_len, data) that begin like a record, with its bytes: image_id, lba, data. A chunk owns
    the sectors that begin in it and looks ahead for the rest of a record."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, start, owned, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = data.find(b"FILE") if data else -1
                while 0 <= at < owned:
                    if (start + at) % 512 == 0 and at + RECORD <= len(data):
                        rows.append((image, (start + at) // 512, data[at : at + RECORD]))
                    at = data.find(b"FILE", at + 1)
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["image_id", "lba", "data"])

    return chunks.select("image_id", "chunk_start", "owned_len", "data").mapInArrow(find, "image_id string, lba long, data binary")


def scan_records(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """All file records of images, or the first `most` of each in order of place, with record_number and their columns and alert."""
    sectors = record_sectors(chunks)
    taken = accept_sectors(sectors.select("image_id", "lba"))
    if most is not None:
        taken = taken.where(F.col("record_number") < most)
    records = sectors.join(taken, ["image_id", "lba"]).withColumn("record_offset", F.col("lba") * 512)
    parsed = with_alert(parse(records))
    return parsed.join(records.select("image_id", "record_offset", "record_number"), ["image_id", "record_offset"])


def extract_records(chunks: DataFrame, path: str, most_bytes: int = 1 << 30) -> DataFrame:
    """Content of the records of image files: image_id, record_offset, name (of safe letters), size, sha256, payload. path: the pattern that
    names the files; a record's runs are read from its file where it is extracted."""
    paths = {p.rsplit("/", 1)[-1]: p for p, _ in image_files(path)}
    sectors = record_sectors(chunks)
    records = sectors.join(accept_sectors(sectors.select("image_id", "lba")), ["image_id", "lba"]).select("image_id", (F.col("lba") * 512).alias("record_offset"), "data")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = extract(data, lambda o, n, p=paths.get(image): read_range(p, o, n) if p else b"", most_bytes)
                if body is not None:
                    name = (parse_record(data) or {}).get("filename") or f"record_{at}"
                    yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([at], pa.int64()), pa.array([re.sub(r"[^\w.\-]", "_", name)]), pa.array([len(body)], pa.int64()), pa.array([hashlib.sha256(body).hexdigest()]), pa.array([body], pa.binary())],
                                                     names=["image_id", "record_offset", "name", "size", "sha256", "payload"])

    return records.mapInArrow(read, "image_id string, record_offset long, name string, size long, sha256 string, payload binary")


def first_seen(records: DataFrame) -> DataFrame:
    """Records that come twice, as a stream of findings may bring them, once."""
    return records.dropDuplicates(["image_id", "record_number", "record_offset"])
