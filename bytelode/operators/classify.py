"""What a file says about itself in its first bytes, and how it can be shown."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pairs = list[tuple[str, str]]

# Media types by extension; others are octet streams.
MIME = {
    "jpg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml", "ico": "image/x-icon", "tif": "image/tiff",
    "pdf": "application/pdf", "zip": "application/zip", "rar": "application/vnd.rar", "7z": "application/x-7z-compressed", "gz": "application/gzip", "mp3": "audio/mpeg", "wav": "audio/wav",
    "ogg": "audio/ogg", "flac": "audio/flac", "aac": "audio/aac", "mp4": "video/mp4", "mkv": "video/x-matroska", "html": "text/html", "xml": "application/xml", "json": "application/json",
}
# Extensions by the way they are shown.
KINDS = {
    "image": "jpg jpeg png gif bmp webp svg ico tif tiff heic heif avif cr2 arw nef dng".split(),
    "video": "mp4 mov mkv webm avi flv 3gp mpg mpeg wmv ts".split(),
    "audio": "mp3 wav ogg flac aac m4a wma mid ape ac3".split(),
    "text": "txt md html htm xml json csv log ini conf yaml yml toml css js py rs c h cpp java go sh sql pem key".split(),
}


def _jpeg(b: bytes) -> Pairs:
    out = [("Format", "Exif" if b"Exif" in b[:64] else "JFIF")]
    at = 2
    while at + 9 <= len(b) and b[at] == 0xFF:
        if b[at + 1] in (0xC0, 0xC1, 0xC2):
            return [*out, ("Width", str(int.from_bytes(b[at + 7 : at + 9], "big"))), ("Height", str(int.from_bytes(b[at + 5 : at + 7], "big")))]
        at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return out


def _png(b: bytes) -> Pairs:
    if len(b) < 26:
        return []
    colour = {0: "Grayscale", 2: "RGB", 3: "Indexed", 4: "Grayscale+Alpha", 6: "RGBA"}.get(b[25], "Unknown")
    return [("Width", str(int.from_bytes(b[16:20], "big"))), ("Height", str(int.from_bytes(b[20:24], "big"))), ("Bit Depth", str(b[24])), ("Color Type", colour)]


def _pdf(b: bytes) -> Pairs:
    return [("PDF Version", b[5:8].decode("latin-1")), ("Approx Pages", str(b[:65536].count(b"/Page ")))]


def _zip(b: bytes) -> Pairs:
    return [("File Count", str(b.count(b"PK\3\4")))]


def _elf(b: bytes) -> Pairs:
    if len(b) < 18:
        return []
    kind = {1: "Relocatable", 2: "Executable", 3: "Shared Object", 4: "Core Dump"}.get(int.from_bytes(b[16:18], "little"), "Unknown")
    return [("Class", {1: "32-bit", 2: "64-bit"}.get(b[4], "Unknown")), ("Endian", {1: "Little", 2: "Big"}.get(b[5], "Unknown")), ("Type", kind)]


def _pe(b: bytes) -> Pairs:
    at = int.from_bytes(b[60:64], "little")
    machine = {0x14C: "x86", 0x8664: "x64", 0x1C0: "ARM", 0xAA64: "ARM64"}.get(int.from_bytes(b[at + 4 : at + 6], "little"), "Unknown")
    return [("Machine", machine)]


def _sqlite(b: bytes) -> Pairs:
    if len(b) < 100:
        return []
    n = lambda at, k=4: int.from_bytes(b[at : at + k], "big")
    page = 65536 if n(16, 2) == 1 else n(16, 2)
    names = [m.decode("latin-1") for m in re.findall(rb"(?i)CREATE TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"'`\[]?(\w+)", b)]
    out = [("Page Size", f"{page} bytes"), ("Page Count", str(n(28))), ("Freelist Pages", f"{n(36)} pages (Recoverable Deleted Rows)" if n(36) else "0 pages")]
    out += [("Encoding", {1: "UTF-8", 2: "UTF-16le", 3: "UTF-16be"}.get(n(56), "Unknown")), ("User Version", str(n(60))), ("SQLite Version", str(n(96)))]
    return [*out, ("Tables", ", ".join(dict.fromkeys(x for x in names if x.upper() != "IF")))] if names else out


def _mp3(b: bytes) -> Pairs:
    if b[:3] != b"ID3" or len(b) < 10:
        return []
    out = [("ID3 Version", f"2.{b[3]}.{b[4]}")]
    for frame, name in ((b"TIT2", "Title"), (b"TPE1", "Artist")):
        at = b.find(frame)
        if at >= 0 and (size := int.from_bytes(b[at + 4 : at + 8], "big")):
            out.append((name, b[at + 11 : at + 10 + min(size, 100)].decode("utf-8", "replace").strip("\0 ")))
    return out


CLASSIFIERS = {"jpg": _jpeg, "png": _png, "pdf": _pdf, "zip": _zip, "elf": _elf, "exe": _pe, "sqlite": _sqlite, "mp3": _mp3}


def metadata(extension: str, data: bytes) -> Pairs:
    """Pairs of name and value from the first 64 KiB; none where the format is not looked into."""
    return CLASSIFIERS.get(extension, lambda _: [])(data[:65536])


def mime(extension: Column) -> Column:
    pairs = [x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension), F.lit("application/octet-stream"))


def preview_kind(extension: Column) -> Column:
    out = F.lit("binary")
    for kind, names in reversed(KINDS.items()):
        out = F.when(extension.isin(names), kind).otherwise(out)
    return out


def classified(rows: DataFrame) -> DataFrame:
    """rows(..., extension, data) with metadata: what the file says about itself, as pairs of name and value."""

    @F.pandas_udf("array<struct<k:string,v:string>>")
    def look(extension: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([[{"k": k, "v": v} for k, v in metadata(e, d or b"")] for e, d in zip(extension, data, strict=True)])

    return rows.withColumn("metadata", look("extension", "data"))
