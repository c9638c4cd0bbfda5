"""Carving: where a candidate ends, whether its structure holds, how sure it is a file, and what it says about itself."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.functions.binary import confidence, tier
from bytelode.functions.catalog import MIB, Rule, rules, rules_frame
from bytelode.operators.scan import DIB_SIZES, SECTOR, adts_frame
from bytelode.sources.rawimage import image_files, read_range


def _u16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "little")


def _u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "little")


def _b32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "big")


# Where files end: a position, or None where the format gives none.


def jpeg_end(b: bytes) -> int | None:
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        mark = b[at + 1]
        if mark == 0xD9:
            return at + 2
        if mark == 0xDA:
            seek = at + 2
            while (seek := b.find(b"\xff", seek)) >= 0 and seek + 1 < len(b):
                if b[seek + 1] == 0xD9:
                    return seek + 2
                seek += 1 if b[seek + 1] == 0xFF else 2
            break
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
            continue
        at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    last = b.rfind(b"\xff\xd9")
    return last + 2 if last >= 0 else None


def png_end(b: bytes) -> int | None:
    at = 8
    for _ in range(10_000):
        if at + 8 > len(b):
            break
        if b[at + 4 : at + 8] == b"IEND":
            return min(at + 12, len(b))
        at += 12 + _b32(b, at)
    last = b.rfind(b"IEND\xaeB`\x82")
    return last + 8 if last >= 0 else None


def _past(b: bytes, at: int, blanks: bytes) -> int:
    while at < len(b) and b[at] in blanks:
        at += 1
    return at


def pdf_end(b: bytes) -> int | None:
    last = b.rfind(b"%%EOF", 0, MIB)
    return _past(b, last + 5, b"\r\n ") if last >= 0 else None


def zip_end(b: bytes) -> int | None:
    last = b.rfind(b"PK\5\6")
    if last < 0:
        return None
    return min(last + 22 + _u16(b, last + 20), len(b)) if last + 22 <= len(b) else last + 4


def bmp_end(b: bytes) -> int | None:
    return size if len(b) >= 6 and 54 <= (size := _u32(b, 2)) <= len(b) else None


def ico_end(b: bytes) -> int | None:
    count = _u16(b, 4) if len(b) >= 6 else 0
    if not 0 < count <= 128:
        return None
    ends = [_u32(b, at + 12) + _u32(b, at + 8) for at in range(6, 6 + 16 * count, 16) if at + 16 <= len(b)]
    most = max(ends, default=0)
    return most if 22 <= most <= len(b) else 6 + 16 * count if 6 + 16 * count <= len(b) else None


def svg_end(b: bytes) -> int | None:
    last = max(b.rfind(b"</svg>"), -1)
    if last < 0:
        last = b.rfind(b"</SVG>")
    return _past(b, last + 6, b" \t\r\n") if last >= 0 else None


def slack_start(b: bytes, run: int = 32) -> int | None:
    """Start of the last window of 32 zeros that does not touch the last byte."""
    last = b.rfind(bytes(run), 0, len(b) - 1)
    return last if last >= 0 else None


ENDS: dict[str, Callable[[bytes], int | None]] = {"jpg": jpeg_end, "png": png_end, "pdf": pdf_end, "zip": zip_end, "bmp": bmp_end, "ico": ico_end, "svg": svg_end}


def find_end(b: bytes, rule: Rule) -> tuple[int, bool]:
    """End of the candidate and whether it is cut off: by format, else by footer, else where zeros begin, else all that was read."""
    if (end := ENDS.get(rule.extension, lambda _: None)(b)) is not None:
        return end, False
    if rule.footer and (last := b.rfind(rule.footer, 0, rule.footer_window)) >= 0:
        return last + len(rule.footer), False
    if (zeros := slack_start(b)) is not None and zeros > len(rule.magic):
        return zeros, False
    return len(b), True


def probe_size(rule: Rule) -> int:
    """Bytes that are read for a candidate: at most 16 MiB with a footer, else 4 MiB; whole sectors."""
    most = min(rule.footer_window, 16 * MIB) if rule.footer else min(rule.max_size, 4 * MIB)
    return -(-most // SECTOR) * SECTOR


# Validators: whether the bytes are such a file.


def _jpeg(b: bytes) -> bool:
    if b[:2] != b"\xff\xd8":
        return False
    at, frame = 2, False
    while at + 2 <= len(b) and b[at] == 0xFF:
        mark = b[at + 1]
        if mark == 0xDA:
            return frame and b.endswith(b"\xff\xd9")
        if mark == 0xD9:
            return frame or at + 2 == len(b)
        frame |= 0xC0 <= mark <= 0xC3
        if at + 4 > len(b):
            break
        at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return b.endswith(b"\xff\xd9")


def _png(b: bytes) -> bool:
    if b[:8] != b"\x89PNG\r\n\x1a\n" or b[12:16] != b"IHDR":
        return False
    at, seen = 8, 0
    while seen < 1000 and at + 8 <= len(b):
        if b[at + 4 : at + 8] == b"IEND":
            return True
        at += 12 + _b32(b, at)
        seen += at <= len(b)
    return seen >= 2


def _mp3(b: bytes) -> bool:
    if b[:3] == b"ID3":
        return len(b) >= 10 and b[3] <= 4 and all(x < 128 for x in b[6:10])
    if len(b) < 4 or b[0] != 0xFF or b[1] not in (0xFA, 0xFB):
        return False
    # Bit rates and sample rates of MPEG-1 layer III.
    rates = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0)
    samples = (44100, 48000, 32000, 0)
    rate, sample = rates[b[2] >> 4], samples[(b[2] >> 2) & 3]
    if not rate or not sample:
        return False
    size = 144_000 * rate // sample + ((b[2] >> 1) & 1)
    return len(b) < size + 2 or b[size] == 0xFF and b[size + 1] & 0xE0 == 0xE0


def _aac(b: bytes) -> bool:
    size = adts_frame(b)
    return size is not None and size <= len(b) and (len(b) < size + 2 or b[size] == 0xFF and b[size + 1] & 0xF0 == 0xF0)


def _json(b: bytes) -> dict | list | None:
    text = b.strip()
    if b"\0" in text or not (text[:1] == b"{" and text[-1:] == b"}" or text[:1] == b"[" and text[-1:] == b"]"):
        return None
    try:
        return json.loads(text.decode("utf-8"))
    except (ValueError, RecursionError):
        return None


def _keystore(b: bytes) -> bool:
    said = _json(b)
    inner = said.get("crypto") or said.get("Crypto") if isinstance(said, dict) else None
    return isinstance(inner, dict) and "ciphertext" in inner and "cipher" in inner


def _jwt(b: bytes) -> bool:
    parts = (b.split() or [b""])[0].split(b".")
    return len(parts) >= 2 and all(re.fullmatch(rb"[A-Za-z0-9_-]+", p) for p in parts[:2])


VALIDATORS: dict[str, Callable[[bytes], bool]] = {
    "jpeg": _jpeg,
    "png": _png,
    "pdf": lambda b: b[:5] == b"%PDF-" and b"%%EOF" in b[-4096:],
    "zip": lambda b: len(b) >= 22 and b[:4] == b"PK\3\4" and b"PK\5\6" in b[-65536:],
    "bmp": lambda b: len(b) >= 18 and b[:2] == b"BM" and b[6:10] == bytes(4) and _u32(b, 14) in DIB_SIZES and 10 * len(b) >= 9 * _u32(b, 2),
    "wav": lambda b: b[:4] == b"RIFF" and b[8:12] == b"WAVE",
    "mp4": lambda b: b[4:8] == b"ftyp" and b[8:12] in (b"mp41", b"mp42", b"isom", b"iso2", b"avc1", b"M4V ", b"M4A ", b"qt  "),
    "elf": lambda b: len(b) >= 6 and b[:4] == b"\x7fELF" and b[4] in (1, 2) and b[5] in (1, 2),
    "pe": lambda b: len(b) >= 64 and b[:2] == b"MZ" and b[(at := _u32(b, 60)) : at + 4] == b"PE\0\0",
    "aac": _aac,
    "mp3": _mp3,
    "json": lambda b: _json(b) is not None,
    "aws_key": lambda b: re.match(rb"AKIA[A-Z0-9]{16}", b) is not None,
    "github_pat": lambda b: re.match(rb"ghp_[A-Za-z0-9]{36}", b) is not None,
    "jwt": _jwt,
    "pem": lambda b: len(b) >= 30 and b[:11] == b"-----BEGIN " and b"-----END " in b,
    "eth_keystore": _keystore,
}


def valid(name: str | None, b: bytes) -> bool:
    """False also where there is no validator: nothing then speaks for the structure."""
    return name is not None and VALIDATORS[name](b)


ARTIFACTS = (
    "image_id string, offset long, sig_idx int, size long, sha256 string, footer_found boolean, structure_ok boolean, truncated boolean, entropy double, "
    "metadata array<struct<k:string,v:string>>, payload binary"
)


def _entropy(b: bytes) -> float:
    c = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    p = c[c > 0] / len(b)
    return float(-(p * np.log2(p)).sum()) + 0.0


def carve_at(b: bytes, rule: Rule) -> tuple | None:
    """Columns after sig_idx of the candidate at the start of b, or None if it is too short or its structure fails."""
    from bytelode.operators.classify import metadata

    b = b[: probe_size(rule)]
    end, cut = find_end(b, rule)
    end = min(end, rule.max_size)
    data = b[:end]
    if len(data) < len(rule.magic) + 4:
        return None
    ok = valid(rule.validator, data)
    if rule.validator and not ok:
        return None
    return len(data), hashlib.sha256(data).hexdigest(), rule.footer is not None and end < len(b), ok, cut, _entropy(data), metadata(rule.extension, data), data


def carve(candidates: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Artifacts of candidates(image_id, offset, sig_idx, window): window holds the bytes from the offset on, as far as the rule's probe
    reads. Adds description, category, confidence, its label and a content-derived id."""
    table = {r.number: r for r in rules(extensions)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for image, offset, number, window in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number in table and (got := carve_at(window or b"", table[number])):
                    out.append((image, offset, number, *got))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])), pa.binary()]
            names = ["image_id", "offset", "sig_idx", "size", "sha256", "footer_found", "structure_ok", "truncated", "entropy", "metadata", "payload"]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    found = candidates.select("image_id", "offset", "sig_idx", "window").mapInArrow(cut, ARTIFACTS)
    named = found.join(F.broadcast(rules_frame(candidates.sparkSession, extensions)), "sig_idx")  # 134 rows at most
    score = confidence(F.col("confidence_base"), F.col("footer_found"), F.col("structure_ok"), F.col("truncated"), F.lit(False))
    return named.select(
        "image_id", F.substring("sha256", 1, 16).alias("id"), "offset", "size", "extension", "description", "category", score.alias("confidence"), tier(score).alias("confidence_label"), "sha256",
        "truncated", F.lit(False).alias("reconstructed"), F.lit(1).alias("fragment_count"), "entropy", "metadata", "payload", F.format_string("%s/%016x.%s", "category", "offset", "extension").alias("path"),
    )


def windows(hits: DataFrame, chunks: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """The bytes from each hit on. chunks(image_id, chunk_start, owned_len, data) must be of one size; a hit is joined to the chunks that
    its probe touches, and they are put together in order."""
    table = hits.sparkSession.createDataFrame([(r.number, probe_size(r)) for r in rules(extensions)], "sig_idx int, probe long")
    size = chunks.agg(F.max("owned_len")).first()[0] or 1
    want = hits.join(F.broadcast(table), "sig_idx").withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col("probe") - 1) / size))))
    parts = chunks.select("image_id", F.floor(F.col("chunk_start") / size).alias("_chunk"), "chunk_start", F.expr("substring(data, 1, owned_len)").alias("data"))
    got = want.join(parts, ["image_id", "_chunk"])
    piece = F.struct("chunk_start", F.expr(f"substring(data, cast(greatest(offset - chunk_start, 0) as int) + 1, cast(least(offset + probe - greatest(offset, chunk_start), {size}) as int))").alias("piece"))
    joined = got.groupBy("image_id", "offset", "sig_idx").agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    return joined.select("image_id", "offset", "sig_idx", F.aggregate("_p.piece", F.lit(b""), lambda a, x: F.concat(a, x)).alias("window"))


def validated(rows: DataFrame) -> DataFrame:
    """rows(..., validator, data) with ok: whether the bytes are such a file."""

    @F.pandas_udf("boolean")
    def check(name: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([valid(n, d or b"") for n, d in zip(name, data, strict=True)], dtype=bool)

    return rows.withColumn("ok", check("validator", "data"))


def bounded(rows: DataFrame) -> DataFrame:
    """rows(..., extension, data) with end: where a file of that kind ends, by its format alone; null if the bytes don't say."""

    @F.pandas_udf("long")
    def find(extension: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([ENDS.get(e, lambda _: None)(d or b"") for e, d in zip(extension, data, strict=True)], dtype="Int64")

    return rows.withColumn("end", find("extension", "data"))


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Artifacts with their payloads as Parquet, a folder for each category; a row's path column names it as a file."""
    artifacts.write.mode("append").partitionBy("category").parquet(path)


def file_windows(hits: DataFrame, path: str, extensions: list[str] | None = None) -> DataFrame:
    """The bytes from each hit on, read from the image files that the pattern names where they are carved: nothing of an image is shuffled.
    hits(image_id, offset, sig_idx); image_id is a file's name."""
    probes = {r.number: probe_size(r) for r in rules(extensions)}
    paths = {p.rsplit("/", 1)[-1]: p for p, _ in image_files(path)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, offset, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if image in paths and number in probes:
                    window = read_range(paths[image], offset, probes[number])
                    yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([offset], pa.int64()), pa.array([number], pa.int32()), pa.array([window], pa.binary())], names=["image_id", "offset", "sig_idx", "window"])

    return hits.select("image_id", "offset", "sig_idx").mapInArrow(read, "image_id string, offset long, sig_idx int, window binary")
