"""Column functions over bytes and sizes: statistics, times, labels, previews."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 100 ns steps between 1601 and 1970, and in a second.
FILETIME_EPOCH, FILETIME_SECOND = 116444736000000000, 10_000_000


def _counts(data: bytes | None) -> np.ndarray:
    return np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256)


def _entropy(x: bytes | None) -> float:
    c = _counts(x)
    p = c[c > 0] / max(1, c.sum())
    return float(-(p * np.log2(p)).sum()) + 0.0 if len(p) else 0.0


def entropy(data: Column) -> Column:
    """Shannon entropy of the bytes in bits; 0 for none."""

    def every(x: pd.Series) -> pd.Series:
        return x.map(_entropy, na_action=None).astype("float64")

    return F.pandas_udf(every, "double")(data)


def byte_counts(data: Column) -> Column:
    """How often each of the 256 byte values stands in the bytes. Project it before it goes into a lambda."""

    def every(x: pd.Series) -> pd.Series:
        return x.map(_counts, na_action=None)

    return F.pandas_udf(every, "array<long>")(data)


def _with_total(counts: Column, body) -> Column:
    """body(total of the counts), the total being computed once, also where body uses it inside of a lambda."""
    return F.transform(F.array(F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)), body)[0]


def entropy_of_counts(counts: Column) -> Column:
    return _with_total(counts, lambda n: F.aggregate(counts, F.lit(0.0), lambda a, c: F.when(c > 0, a - c / n * F.log2(c / n)).otherwise(a)))


def frequencies(counts: Column) -> Column:
    return _with_total(counts, lambda n: F.transform(counts, lambda c: c / F.greatest(n, F.lit(1))))


def kl_divergence(p: Column, q: Column) -> Column:
    """Divergence of two byte distributions in nats, each share raised by 1e-9; never below 0."""
    e = 1e-9
    terms = F.zip_with(p, q, lambda a, b: (a + e) * F.log((a + e) / (b + e)))
    return F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def chi_square(counts: Column) -> Column:
    """Chi-square statistic against equal shares of the 256 byte values."""
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    return _with_total(counts, lambda n: F.when(n > 0, squares * 256 / n - n).otherwise(F.lit(0.0)))


def randomness_label(h: Column, chi: Column, n: Column) -> Column:
    return F.when((h >= 7.85) & (chi <= 380) & (n >= 512), "Uniform random").when(h >= 7.5, "Compressed or encrypted").otherwise("Structured")


def format_size(n: Column) -> Column:
    """In whole numbers, so that every tie is rounded up."""

    # Units and their digits.
    def of(unit: int, digits: int, name: str) -> Column:
        scale = 10**digits
        parts = F.floor((n * (2 * scale) + unit) / (2 * unit)).cast("long")
        return F.format_string(f"%d.%0{digits}d {name}", F.floor(parts / scale).cast("long"), parts % scale)

    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1 << 20, of(1 << 10, 1, "KB")).when(n < 1 << 30, of(1 << 20, 1, "MB")).otherwise(of(1 << 30, 2, "GB"))


def filetime_text(ft: Column) -> Column:
    """A raw FILETIME as RFC 3339 seconds; 0 and times before 1970 are the epoch of 1601."""
    ok = ft >= FILETIME_EPOCH
    text = F.date_format(F.timestamp_seconds(F.floor((ft - FILETIME_EPOCH) / F.lit(FILETIME_SECOND)).cast("long")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(ok, F.concat(text, F.lit("+00:00"))).otherwise(F.lit("1601-01-01T00:00:00Z"))


def to_filetime(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 10 + FILETIME_EPOCH


def confidence(base: Column, footer: Column, valid: Column, truncated: Column, overlap: Column) -> Column:
    # What the findings add or take.
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base.cast("double") + add(footer, 0.05) + add(valid, 0.05) - add(truncated, 0.15) - add(overlap, 0.10))).cast("float")


def tier(score: Column) -> Column:
    # Edges of the tiers, compared as FLOAT.
    f = lambda x: F.lit(x).cast("float")
    return F.when(score >= f(0.85), "High").when(score >= f(0.60), "Medium").when(score >= f(0.40), "Low").otherwise("Fragment")


def hex_dump(files: DataFrame, key: str, data: str = "data") -> DataFrame:
    """Rows of 16 bytes of each file: key, offset, hex, ascii (printable text, else dots). Offsets are dealt out first, so that only a row's
    own bytes are looked at. No bytes and null: one empty row."""
    rows = files.select(key, data, F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(F.length(data), F.lit(0)) - 1, F.lit(0)), F.lit(16))).alias("_at"))
    piece = F.coalesce(F.substring(F.col(data), F.col("_at") + 1, F.lit(16)), F.lit(b""))
    ascii_ = F.regexp_replace(F.decode(piece, "ISO-8859-1"), "[^\\x20-\\x7E]", ".")
    return rows.select(key, F.col("_at").cast("long").alias("offset"), F.hex(piece).alias("hex"), ascii_.alias("ascii"))


def hex_window(files: DataFrame, key: str, data: str, offset: int, length: int) -> DataFrame:
    """Part of each file as a viewer asks for it: key, offset (at most the file's size), bytes (at most 4096), total_size."""
    total = F.coalesce(F.length(data), F.lit(0)).cast("long")
    at = F.least(F.lit(offset).cast("long"), total)
    return files.select(key, at.alias("offset"), F.coalesce(F.substring(F.col(data), (at + 1).cast("int"), F.lit(min(length, 4096))), F.lit(b"")).alias("bytes"), total.alias("total_size"))


def html_escape(text: Column) -> Column:
    # The characters that stand for markup, the ampersand first.
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, rounded down; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole)).otherwise(F.lit(0)).cast("int")


def with_namespace(svg: Column) -> Column:
    """An SVG text whose root names its namespace."""
    return F.when(F.contains(svg, F.lit("xmlns=")), svg).otherwise(F.regexp_replace(svg, "^([\\s\\S]*?)<svg", '$1<svg xmlns="http://www.w3.org/2000/svg"'))


def embedded_jpeg(data: Column) -> Column:
    """The first JPEG inside of other bytes, from its first start mark to the first end mark after it or else to the end; null without one."""
    latin = F.decode(data, "ISO-8859-1")
    start = F.locate("\u00ff\u00d8\u00ff", latin)
    end = F.locate("\u00ff\u00d9", F.substring(latin, start, F.length(latin)))
    return F.when(start > 0, F.substring(data, start, F.when(end > 0, end + 1).otherwise(F.length(data))))


def tier_class(label: Column) -> Column:
    # Style names of the tiers.
    return F.when(label == "High", "badge-high").when(label == "Medium", "badge-medium").when(label == "Low", "badge-low").otherwise("badge-fragment")


def data_uri(data: Column, mime: Column) -> Column:
    # Spark breaks base64 into lines of 76; a URI has none.
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), "\\s", ""))


def printable_ratio(data: Column) -> Column:
    """Share of printable ASCII and tab, line feed, carriage return among the first 4096 bytes."""
    head = F.decode(F.substring(data, F.lit(1), F.lit(4096)), "ISO-8859-1")
    return F.when(F.length(head) > 0, F.length(F.regexp_replace(head, "[^\\x20-\\x7E\\t\\n\\r]", "")) / F.length(head)).otherwise(F.lit(0.0))


def is_text(data: Column) -> Column:
    head = F.decode(F.substring(data, F.lit(1), F.lit(4096)), "ISO-8859-1")
    return ~F.contains(head, F.lit("\0")) & (printable_ratio(data) > 0.85)


def smart_log(log: Column) -> Column:
    """Temperature in Celsius, spare, wear, media errors and whether the drive is failing, of a 512-byte NVMe health page."""
    number = lambda at, n: F.conv(F.hex(F.reverse(F.substring(log, F.lit(at + 1), F.lit(n)))), 16, 10).cast("decimal(20,0)").cast("long")
    warning, kelvin, spare, wear = number(0, 1), number(1, 2), number(3, 1), number(5, 1)
    return F.struct((kelvin - 273).alias("celsius"), spare.alias("spare"), wear.alias("wear"), number(176, 8).alias("media_errors"), ((warning != 0) | (spare < 10) | (wear >= 100)).alias("failing"))
