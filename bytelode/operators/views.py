"""Filters, counts and maps that a workstation shows of artifacts, records, devices and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 140


def is_secret() -> Column:
    return F.col("category").isin("Certificate", "Secret") | F.col("extension").isin("pem", "jwt", "json")


def artifact_filter(rows: DataFrame, query: str = "", category: str | None = None, sure: str | None = None) -> DataFrame:
    """Artifacts whose extension, hash or id holds the query, of a category ("Secret" has its own rule), and high, good or stitched."""
    q = F.lit(query.lower())
    ok = F.contains(F.lower("extension"), q) | F.contains(F.lower("sha256"), q) | F.contains(F.lower("id"), q)
    if category:
        ok &= is_secret() if category == "Secret" else F.col("category") == category
    if sure:
        ok &= {"high": F.col("confidence") >= F.lit(0.90).cast("float"), "good": F.col("confidence") >= F.lit(0.70).cast("float"), "stitched": F.col("reconstructed")}[sure]
    return rows.where(ok)


def category_counts(rows: DataFrame) -> DataFrame:
    """Each artifact in the first class that fits: by category, then secrets by extension."""
    kind = (
        F.when(F.col("category") == "Image", "image").when(F.col("category") == "Document", "document").when(F.col("category").isin("Audio", "Video"), "media")
        .when(F.col("category") == "Archive", "archive").when(is_secret(), "secret").otherwise("other")
    )
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def mft_filter(rows: DataFrame, query: str = "", deleted: bool = False, tampered: bool = False) -> DataFrame:
    q = F.lit(query.lower())
    ok = F.contains(F.lower("filename"), q) | F.contains(F.col("record_number").cast("string"), q)
    if deleted:
        ok &= ~F.col("is_in_use")
    if tampered:
        ok &= F.col("timestomp_detected")
    return rows.where(ok)


def sector_map(hits: DataFrame, total: int) -> DataFrame:
    """140 equal parts of an image: bucket, n_hits and the first five extensions by offset."""
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(F.col("offset") / F.lit(total) * BUCKETS)).cast("int")
    # The five least of each part are kept on the way, so a crowded part needs no list of all.
    ranked = hits.withColumn("bucket", bucket)
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy("offset", "extension"))).where("_n <= 5")
    names = first.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "extension"))), lambda x: x["extension"]), ",").alias("extensions"))
    counts = ranked.groupBy("bucket").agg(F.count("*").alias("n_hits"))
    every = hits.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return every.join(F.broadcast(counts), "bucket", "left").join(F.broadcast(names), "bucket", "left").select("bucket", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("extensions", F.lit("")).alias("extensions"))


def device_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that came and went between two snapshots."""
    came = after.join(before, "path", "left_anti").select("path", F.lit("connected").alias("change"))
    return came.unionByName(before.join(after, "path", "left_anti").select("path", F.lit("disconnected").alias("change")))


def throughput(samples: DataFrame) -> DataFrame:
    """Of progress samples(job_id, ts_ms, bytes, total): speed since the sample before and, from the mean so far, seconds to go."""
    w = Window.partitionBy("job_id").orderBy("ts_ms")
    first = F.first("ts_ms").over(w.rowsBetween(Window.unboundedPreceding, 0))
    speed = (F.col("bytes") - F.lag("bytes").over(w)) * 1000.0 / F.nullif(F.col("ts_ms") - F.lag("ts_ms").over(w), F.lit(0))
    mean = F.col("bytes") * 1000.0 / F.nullif(F.col("ts_ms") - first, F.lit(0))
    out = samples.withColumn("speed", speed).withColumn("_mean", mean)
    return out.withColumn("eta", F.when(F.col("_mean") > 0, (F.col("total") - F.col("bytes")) / F.col("_mean"))).drop("_mean")


def slack_report(files: DataFrame, cluster: int = 4096) -> DataFrame:
    """Of files(id, logical_size, data), data being whole clusters: slack length, non-zero and printable bytes, whether it is an anomaly."""
    slack = F.when(F.col("logical_size") % cluster == 0, F.lit(0)).otherwise(cluster - F.col("logical_size") % cluster)
    text = F.decode(F.expr("substring(data, cast(logical_size as int) + 1)"), "ISO-8859-1")
    part = files.select("id", slack.cast("long").alias("slack_len"), F.when(slack > 0, text).otherwise(F.lit("")).alias("t"))
    nonzero = F.length(F.regexp_replace("t", "\\x00", "")).cast("long")
    return part.select("id", "slack_len", nonzero.alias("nonzero"), F.length(F.regexp_replace("t", "[^\\x20-\\x7E]", "")).cast("long").alias("printable"), (nonzero > 16).alias("anomaly"))


def wipe_map(jobs: DataFrame) -> DataFrame:
    """Of jobs(job_id, bytes_written, total_bytes) the 140 parts of each medium: bucket, state (wiped, writing, pending), start_lba, end_lba."""
    sectors = F.floor(F.col("total_bytes") / 512)
    done = F.when(F.col("total_bytes") > 0, F.least(F.lit(BUCKETS), F.floor(F.least(F.lit(1.0), F.col("bytes_written") / F.col("total_bytes")) * BUCKETS))).otherwise(F.lit(0))
    rows = jobs.select("job_id", sectors.alias("n"), done.alias("done"), F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
    first = F.floor(F.col("bucket") * F.col("n") / BUCKETS)
    last = F.least(F.col("n") - 1, F.floor((F.col("bucket") + 1) * F.col("n") / BUCKETS) - 1)
    state = F.when(F.col("bucket") < F.col("done"), "wiped").when(F.col("bucket") == F.col("done"), "writing").otherwise("pending")
    return rows.select("job_id", "bucket", state.alias("state"), first.cast("long").alias("start_lba"), F.greatest(first, last).cast("long").alias("end_lba"))


def sampled(samples: DataFrame, every_ms: int = 400) -> DataFrame:
    """Of progress samples(job_id, ts_ms, bytes, total) the last of each span of every_ms, for throughput()."""
    span = F.floor(F.col("ts_ms") / every_ms)
    last = samples.groupBy("job_id", span.alias("_span")).agg(F.max(F.struct("ts_ms", "bytes", "total")).alias("s"))
    return last.select("job_id", "s.*")


def block_devices(lines: DataFrame) -> DataFrame:
    """Devices of a partition listing(line) of the system: name, path, size_bytes, scheme. Lines of fewer than four fields, and names that
    don't end in a digit, are left out."""
    f = F.split(F.trim("line"), "\\s+")
    rows = lines.select(f.alias("f")).where((F.size("f") >= 4) & F.col("f")[3].rlike("[0-9]$") & F.col("f")[2].rlike("^[0-9]+$"))
    size = F.col("f")[2].cast("long") * 1024
    return rows.select(F.col("f")[3].alias("name"), F.concat(F.lit("/dev/"), F.col("f")[3]).alias("path"), size.alias("size_bytes"), F.when(size > 2_000_000_000_000, "GPT").otherwise("MBR").alias("scheme"))


def artifact(rows: DataFrame, artifact_id: str) -> DataFrame:
    """The artifact of an id; of several sessions' the first."""
    return rows.where(F.col("id") == artifact_id).orderBy("session_id").limit(1)
