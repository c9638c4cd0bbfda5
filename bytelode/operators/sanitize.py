"""Wipe plans as tables, and the check that a surface holds what its last pass wrote. Media are never written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.functions.binary import entropy

# Passes of the standards; R is random.
STANDARDS = {
    "Clear": ["00"],
    "Random": ["R"],
    "DoD": ["00", "FF", "R"],
    "Gutmann7": ["00", "FF", "R", "92", "49", "24", "R"],
    "Purge": ["00", "R"],
}
BLOCK = 512 * 1024


def wipe_plan(spark: SparkSession) -> DataFrame:
    rows = [(name, k, p) for name, passes in STANDARDS.items() for k, p in enumerate(passes, 1)]
    return spark.createDataFrame(rows, "standard string, pass int, pattern string")


def expected_last(standard: Column) -> Column:
    return F.when(standard == "Clear", "Zero").otherwise("Random")


def wipe_verify(sectors: DataFrame, mode: str) -> DataFrame:
    """For each image_id of sectors(image_id, lba, data): sectors_checked, mismatches, first_bad (lba), max_entropy, passed.

    mode Zero, Ones or a byte in hex: each whole 512-byte sector must hold only that byte. Random: a block of 512 KiB that is all zero is
    one mismatch. max_entropy is that of a sector for Zero, of a block for Random, else 0."""
    whole = sectors.where(F.length("data") == 512)
    zero = lambda c: F.replace(F.hex(c), F.lit("0"), F.lit("")) == ""
    if mode == "Random":
        per = BLOCK // 512
        blocks = whole.groupBy("image_id", F.floor(F.col("lba") / per).alias("b")).agg(F.min("lba").alias("lba"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("lba", "data"))).alias("d"))
        judged = blocks.select("image_id", "lba", "n", F.forall("d", lambda x: zero(x["data"])).alias("bad"), entropy(F.aggregate("d", F.lit(b""), lambda a, x: F.concat(a, x["data"]))).alias("h"))
    else:
        byte = {"Zero": "00", "Ones": "FF"}.get(mode, mode).upper()
        same = F.replace(F.hex("data"), F.lit(byte), F.lit("")) == ""
        judged = whole.select("image_id", "lba", F.lit(1).alias("n"), (~same).alias("bad"), (entropy(F.col("data")) if mode == "Zero" else F.lit(0.0)).alias("h"))
    out = judged.groupBy("image_id").agg(F.sum("n").cast("long").alias("sectors_checked"), F.count_if("bad").alias("mismatches"), F.min(F.when(F.col("bad"), F.col("lba"))).alias("first_bad"), F.max("h").alias("max_entropy"))
    return out.withColumn("passed", F.col("mismatches") == 0)


# The standards' ids and labels.
LABELS = {
    "Clear": ("nist_clear", "NIST SP 800-88 Clear"),
    "Random": ("random", "BSI TR-02102 Random"),
    "DoD": ("dod3", "DoD 5220.22-M (3-pass)"),
    "Gutmann7": ("gutmann7", "Gutmann 7-pass"),
    "Purge": ("nist_purge", "NIST SP 800-88 Purge (NVMe Sanitize & Flash TRIM)"),
}


def wipe_standards(spark: SparkSession) -> DataFrame:
    """The standards: standard, id, label, passes."""
    return spark.createDataFrame([(name, *LABELS[name], len(passes)) for name, passes in STANDARDS.items()], "standard string, id string, label string, passes int")


def block_pattern(pattern: Column, size: int, seed: Column) -> Column:
    """A block of bytes as a pass writes it: one byte in hex, repeated, or for R bytes that follow from the seed alone."""
    # 32 bytes of hash a piece; a seed and a piece's number make it.
    pieces = F.transform(F.sequence(F.lit(0), F.lit(-(-size // 32) - 1)), lambda k: F.sha2(F.concat_ws(":", seed.cast("string"), k.cast("string")), 256))
    random_ = F.substring(F.unhex(F.array_join(pieces, "")), 1, size)
    return F.when(pattern == "R", random_).otherwise(F.unhex(F.repeat(pattern, F.lit(size))))


def shred_summary(results: DataFrame) -> DataFrame:
    """Of results(path, ok): how many files were shredded and how many were not."""
    return results.agg(F.count_if("ok").alias("shredded"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))


def adversarial_summary(planted: int, before: DataFrame, verified: DataFrame, after: DataFrame) -> DataFrame:
    """One row of a trial: files planted, artifacts carved before the wipe, what wipe_verify found after it, hits that are left, passed."""
    carved, left = (x.agg(F.count("*").alias(n)) for x, n in ((before, "carved_files"), (after, "post_wipe_carved")))
    surface = verified.agg(F.sum("sectors_checked").alias("sectors_checked"), F.sum("mismatches").alias("sector_mismatches"))
    row = carved.crossJoin(surface).crossJoin(left).withColumn("planted_files", F.lit(planted))  # three rows of one
    return row.withColumn("passed", (F.col("sector_mismatches") == 0) & (F.col("post_wipe_carved") == 0))


def trial_phases(summary: DataFrame) -> DataFrame:
    """The five phases of a trial as rows: phase, title, status."""
    # The phases.
    titles = ("Image created", "Evidence planted", "Carving before the wipe", "Surface overwritten", "Carving after the wipe")
    rows = F.array(*[F.struct(F.lit(k).alias("phase"), F.lit(t).alias("title")) for k, t in enumerate(titles, 1)])
    out = summary.select("passed", F.explode(rows).alias("r")).select("r.*", "passed")
    return out.select("phase", "title", F.when((F.col("phase") < 5) | F.col("passed"), "success").otherwise("failed").alias("status"))
