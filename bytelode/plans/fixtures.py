"""Small images with known content, built from literal bytes, for queries and tests whose answers are known exactly."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession

SECTOR = 512


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png() -> bytes:
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\xff\0\0")) + chunk(b"IEND", b"")


JPEG = bytes.fromhex("FFD8FFE000104A46494600010100000100010000FFD9")
PDF = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\ntrailer\n<<>>\n%%EOF\n"
ELF = b"\x7fELF\2\1\1" + bytes(9) + struct.pack("<HHI", 2, 62, 1)


def sqlite() -> bytes:
    head = bytearray(b"SQLite format 3\0" + bytes(84))
    struct.pack_into(">H", head, 16, 1024)
    struct.pack_into(">I", head, 28, 8)
    struct.pack_into(">I", head, 36, 2)
    struct.pack_into(">I", head, 56, 1)
    return bytes(head) + b"CREATE TABLE secret_evidence(id INTEGER)" + bytes(1024 - 140)


def file_record(name: str, si: tuple[int, int, int, int], fn: tuple[int, int, int, int], body: bytes | None, flags: int = 1, runs: bytes = b"", real: int = 0) -> bytes:
    """A clean record: update sequence, standard information, file name, data (resident body, or runs)."""

    def resident(kind: int, content: bytes) -> bytes:
        size = -(-(24 + len(content)) // 8) * 8
        return (struct.pack("<IIBBHHHIHH", kind, size, 0, 0, 0, 0, 0, len(content), 24, 0) + content).ljust(size, b"\0")

    wide = name.encode("utf-16-le")
    attributes = resident(0x10, struct.pack("<QQQQ", *si) + bytes(16))
    attributes += resident(0x30, struct.pack("<QQQQQ", 5, *fn) + bytes(24) + bytes([len(name), 1]) + wide)
    if body is not None:
        attributes += resident(0x80, body)
    elif runs:
        size = -(-(64 + len(runs)) // 8) * 8
        attributes += (struct.pack("<IIBBHHHQQHHIQQQ", 0x80, size, 1, 0, 0, 0, 0, 0, 0, 64, 0, 0, 0, real, real) + runs).ljust(size, b"\0")
    record = bytearray(b"FILE" + struct.pack("<HHQHHHHIIQH", 48, 3, 0, 1, 1, 56, flags, 0, 1024, 0, 0)).ljust(56, b"\0") + attributes + struct.pack("<I", 0xFFFFFFFF)
    record = bytearray(record.ljust(1024, b"\0"))
    # Update sequence: the last two bytes of each sector are kept in the array.
    for k in (1, 2):
        record[48 + 2 * k : 50 + 2 * k] = record[512 * k - 2 : 512 * k]
        record[512 * k - 2 : 512 * k] = b"\1\0"
    record[48:50] = b"\1\0"
    return bytes(record)


def planted_image(background: bytes | None = None) -> bytes:
    """2 MiB: at sectors 10, 100, 200, 500, 800 a JPEG, PNG, PDF, ELF head and SQLite page, at 1200 a file record."""
    image = bytearray(background or bytes(2 << 20))
    record = file_record("classified_report.txt", (132 * 10**15,) * 4, (1335 * 10**14,) * 4, b"top secret body", flags=0)
    for sector, data in ((10, JPEG), (100, png()), (200, PDF), (500, ELF), (800, sqlite()), (1200, record)):
        image[sector * SECTOR : sector * SECTOR + len(data)] = data
    return bytes(image)


def as_chunks(spark: SparkSession, image: bytes, size: int, ahead: int, name: str = "image") -> DataFrame:
    rows = [(name, at, min(size, len(image) - at), bytearray(image[at : at + size + ahead])) for at in range(0, len(image), size)]
    return spark.createDataFrame(rows, "image_id string, chunk_start long, owned_len int, data binary")


def split_archive() -> tuple[bytes, bytes]:
    """Head and tail of a stored archive whose bytes look alike throughout."""
    import random

    body = random.Random(7).randbytes(8192 - 4 - 22)
    whole = b"PK\3\4" + body + b"PK\5\6" + bytes(18)
    return whole[:4096], whole[4096:]


def _bmp(size: int, dib: int) -> bytes:
    return b"BM" + size.to_bytes(4, "little") + bytes(8) + dib.to_bytes(4, "little") + bytes(size - 18)


_MP3 = bytes.fromhex("FFFB9000")  # 128 kbit/s, 44,100 Hz: frames of 417 bytes
_AAC = bytes.fromhex("FFF1508001001C")  # a frame of 8 bytes
_PEM = b"-----BEGIN X-----\nabcdefghijk\n-----END X-----"
_PE = b"MZ".ljust(60, b"\0") + b"\x40\0\0\0PE\0\0\x64\x86"

#: (validator, bytes, whether they are such a file)
VALIDATOR_CASES = [
    ("jpeg", JPEG, True), ("jpeg", JPEG[:-2], False), ("png", png(), True), ("png", b"\x89PNX\r\n\x1a\n", False), ("pdf", PDF, True), ("pdf", b"plain text", False),
    ("zip", b"PK\3\4" + bytes(20) + b"PK\5\6" + bytes(18), True), ("zip", b"PK\3\4" + bytes(30), False), ("bmp", _bmp(60, 40), True), ("bmp", _bmp(60, 41), False), ("bmp", _bmp(60, 40)[:50], False),
    ("wav", b"RIFF\0\0\0\0WAVE", True), ("wav", b"RIFF\0\0\0\0WEBP", False), ("mp4", b"\0\0\0\x18ftypisom", True), ("mp4", b"\0\0\0\x18ftypxxxx", False),
    ("elf", b"\x7fELF\2\1" + bytes(58), True), ("elf", b"\x7fELF\3\1" + bytes(58), False), ("pe", _PE, True), ("pe", b"MZ" + bytes(80), False),
    ("aac", _AAC + b"\0" + _AAC, True), ("aac", _AAC + bytes(3), False), ("mp3", _MP3 + bytes(413) + _MP3, True), ("mp3", _MP3 + bytes(420), False), ("mp3", b"ID3\3\0\0\0\0\0\x7f", True), ("mp3", b"ID3\3\0\0\x80\0\0\0", False),
    ("json", b' {"a": [1]} ', True), ("json", b'{"a": 1', False), ("aws_key", b"AKIA" + b"A1" * 8, True), ("aws_key", b"AKIAshort", False), ("github_pat", b"ghp_" + b"a1B2" * 9, True), ("github_pat", b"ghp_a1B2", False),
    ("jwt", b"eyJa.b-_c.d rest", True), ("jwt", b"eyJabc", False), ("pem", _PEM, True), ("pem", _PEM[:30], False),
    ("eth_keystore", b'{"crypto": {"ciphertext": "x", "cipher": "y"}}', True), ("eth_keystore", b'{"crypto": {"ciphertext": "x"}}', False), ("eth_keystore", b'{"Crypto": {"ciphertext": "x", "cipher": "y"}}', True),
]
#: (extension, bytes from the magic on, whether they can be such a header)
HEADER_CASES = [
    ("bmp", _bmp(60, 40), True), ("bmp", _bmp(60, 41), False), ("exe", _PE, True), ("exe", b"MZ" + bytes(80), False), ("wav", b"RIFF\0\0\0\0WAVE", True), ("webp", b"RIFF\0\0\0\0WAVE", False), ("webp", b"RIFF\0\0\0\0WEBP", True),
    ("ico", b"\0\0\1\0\2\0", True), ("ico", b"\0\0\1\0\0\0", False), ("aac", _AAC + b"\0" + _AAC, True), ("aac", _AAC + bytes(3), False), ("mp3", _MP3, True), ("mp3", b"\xff\xfb\0\0", False), ("mp3", b"ID3\3\0\0\0\0\0\x7f", True),
    ("json", b'{"ab": 12', True), ("json", b'{"ab" 12', False), ("gif", b"anything", True),
]
#: (extension, bytes, where the file ends)
BOUNDARY_CASES = [
    ("jpg", JPEG + b"zz", 22), ("png", png() + b"zzz", 69), ("pdf", b"%PDF-1 %%EOF\r\n x", 15), ("zip", b"PK\3\4PK\5\6" + bytes(16) + b"\2\0abTAIL", 28), ("zip", b"PK\3\4PK\5\6", 8),
    ("bmp", _bmp(60, 40) + b"tail", 60), ("ico", b"\0\0\1\0\1\0" + bytes(8) + (10).to_bytes(4, "little") + (22).to_bytes(4, "little") + bytes(40), 32), ("svg", b"<svg></svg> \n<p>", 13), ("svg", b"<SVG></SVG>x", 11),
]
#: (extension, bytes, what they say of themselves)
METADATA_CASES = [
    ("jpg", JPEG[:2] + bytes.fromhex("FFC0000B08000700090103010100") + b"\xff\xd9", [("Format", "JFIF"), ("Width", "9"), ("Height", "7")]),
    ("png", png(), [("Width", "1"), ("Height", "1"), ("Bit Depth", "8"), ("Color Type", "RGB")]),
    ("pdf", PDF + b"/Type /Page /Page x", [("PDF Version", "1.4"), ("Approx Pages", "2")]),
    ("zip", b"PK\3\4abPK\3\4", [("File Count", "2")]),
    ("elf", ELF, [("Class", "64-bit"), ("Endian", "Little"), ("Type", "Executable")]),
    ("exe", _PE, [("Machine", "x64")]),
    ("mp3", b"ID3\3\0" + bytes(5) + b"TIT2\0\0\0\5\0\0\0Song" + b"TPE1\0\0\0\4\0\0\0Who", [("ID3 Version", "2.3.0"), ("Title", "Song"), ("Artist", "Who")]),
    ("sqlite", sqlite(), [("Page Size", "1024 bytes"), ("Page Count", "8"), ("Freelist Pages", "2 pages (Recoverable Deleted Rows)"), ("Encoding", "UTF-8"), ("User Version", "0"), ("SQLite Version", "0"), ("Tables", "secret_evidence")]),
]
