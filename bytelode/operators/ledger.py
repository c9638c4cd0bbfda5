"""The audit ledger: hash chain, Merkle root, checks and reports; and custody of what was taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the hash before the first entry, and the root of an empty ledger.
GENESIS = "0" * 64
ENTRY = "index long, timestamp string, operation string, operator string, detail string, prev_hash string, entry_hash string, officer_sig string"


def canonical(index: Column, timestamp: Column, operation: Column, operator: Column, detail: Column, prev_hash: Column) -> Column:
    """The text that an entry's hash is taken of: compact JSON with sorted keys. detail is JSON already."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(
        F.lit('{"detail":'), detail, F.lit(',"index":'), index.cast("string"), F.lit(',"operation":'), quoted(operation), F.lit(',"operator":'), quoted(operator),
        F.lit(',"prev_hash":'), quoted(prev_hash), F.lit(',"timestamp":'), quoted(timestamp), F.lit("}"),
    )


def fold(entries: Column | str, last: Column) -> Column:
    """Ordered entries(index, timestamp, operation, operator, detail), chained on the hash `last`: with prev_hash and entry_hash."""
    kind = "array<struct<index:bigint,timestamp:string,operation:string,operator:string,detail:string,prev_hash:string,entry_hash:string>>"
    start = F.struct(last.alias("last"), F.array().cast(kind).alias("rows"))

    def step(acc: Column, e: Column) -> Column:
        digest = F.sha2(canonical(e["index"], e["timestamp"], e["operation"], e["operator"], e["detail"], acc["last"]), 256)
        row = F.struct(*[e[c].alias(c) for c in ("index", "timestamp", "operation", "operator", "detail")], acc["last"].alias("prev_hash"), digest.alias("entry_hash"))
        return F.struct(digest.alias("last"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    return F.aggregate(entries, start, step)["rows"]


def chain(events: DataFrame) -> DataFrame:
    """Gives ledger rows (ledger, index, timestamp, operation, operator, detail) their prev_hash and entry_hash. Each hash needs the one
    before, so a ledger is folded in one task; ledgers are independent."""
    fields = F.struct("index", "timestamp", "operation", "operator", "detail")
    ordered = events.groupBy("ledger").agg(F.array_sort(F.collect_list(fields)).alias("e"))
    return ordered.select("ledger", F.explode(fold("e", F.lit(GENESIS))).alias("r")).select("ledger", "r.*")


def verify_chain(entries: DataFrame) -> DataFrame:
    """For each ledger: n_entries, valid, and first_bad, the index of the first entry (by line_no) that doesn't follow from the one before
    or whose hash is wrong. Rows: ledger, line_no and the columns of an entry."""
    before = F.lag("entry_hash", 1, GENESIS).over(Window.partitionBy("ledger").orderBy("line_no"))
    digest = F.sha2(canonical(F.col("index"), F.col("timestamp"), F.col("operation"), F.col("operator"), F.col("detail"), F.col("prev_hash")), 256)
    bad = ~(F.col("prev_hash").eqNullSafe(F.col("_before")) & F.col("entry_hash").eqNullSafe(digest))
    judged = entries.withColumn("_before", before).withColumn("_bad", bad)
    first = F.min_by(F.when(F.col("_bad"), F.col("index")), F.when(F.col("_bad"), F.col("line_no")))
    return judged.groupBy("ledger").agg(F.count("*").alias("n_entries"), (F.count_if("_bad") == 0).alias("valid"), first.alias("first_bad"))


def merkle_root(leaves: DataFrame) -> str:
    """Root over leaves(pos, hash), pos from 0: a parent is the hash of both texts, an odd leaf is paired with itself. Each level is one
    aggregate of half as many rows; only the root is fetched."""
    level, n = leaves.select("pos", "hash"), leaves.count()
    if not n:
        return GENESIS
    depth = 0
    while n > 1:
        pair = level.groupBy(F.floor(F.col("pos") / 2).cast("long").alias("pos"))
        level = pair.agg(F.min_by("hash", "pos").alias("l"), F.max_by("hash", "pos").alias("r")).select("pos", F.sha2(F.concat("l", "r"), 256).alias("hash"))
        n = (n + 1) // 2
        depth += 1
    return level.first()["hash"]


def ledger_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("operation") == "Scan").alias("scans"), F.count_if(F.col("operation").isin("WipeDrive", "WipeFile")).alias("wipes"), F.countDistinct("operator").alias("operators"))


def read_ledger(spark, path: str) -> DataFrame:
    """A ledger of JSON lines; blank and unreadable lines are skipped. detail stays text."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    parsed = raw.select(F.from_json("value", ENTRY).alias("e"), F.get_json_object("value", "$.detail").alias("detail")).where("e.entry_hash is not null")
    return parsed.select("e.index", "e.timestamp", "e.operation", "e.operator", "detail", "e.prev_hash", "e.entry_hash", "e.officer_sig")


def report(entries: DataFrame, case: str) -> DataFrame:
    """One row with the report as JSON: header, chain result, entries in order (as many as a ledger has; one ledger a call)."""
    checked = verify_chain(entries)
    rows = entries.groupBy("ledger").agg(F.array_sort(F.collect_list(F.struct("line_no", "index", "timestamp", "operation", "operator", "detail", "prev_hash", "entry_hash"))).alias("entries"))
    return checked.join(rows, "ledger").select("ledger", F.to_json(F.struct(F.lit(case).alias("case"), "n_entries", "valid", "first_bad", "entries")).alias("report"))


def certificate(entries: DataFrame, wiped: DataFrame) -> DataFrame:
    """What a certificate states of each ledger, derived from the chain, the log's hash and wipe_verify's rows; nothing is taken for granted."""
    checked = verify_chain(entries).select("ledger", "n_entries", F.when(F.col("valid"), "INTACT").otherwise("BROKEN").alias("chain_status"))
    checked = checked.join(log_hash(entries), "ledger")
    surface = wiped.agg(F.sum("sectors_checked").alias("sectors_checked"), F.sum("mismatches").alias("mismatches"), F.max("max_entropy").alias("max_entropy"))
    # One row: an aggregate without groups.
    return checked.crossJoin(F.broadcast(surface.withColumn("result", F.when(F.col("mismatches") == 0, "PASSED").otherwise("FAILED"))))


def export_custody(extractions: DataFrame, exports: DataFrame) -> DataFrame:
    """Exports(file_id, destination, sha256) against the first extraction (by extracted_at, then source_offset) of the file: matches says
    whether the hashes agree; false for a file that was never extracted."""
    first = extractions.groupBy("file_id").agg(F.min_by("sha256_at_extract", F.struct("extracted_at", "source_offset")).alias("sha256_at_extract"))
    return exports.join(first, "file_id", "left").select("file_id", "destination", "sha256", F.coalesce(F.col("sha256") == F.col("sha256_at_extract"), F.lit(False)).alias("matches"))


def custody_badges(checked: DataFrame) -> DataFrame:
    return checked.groupBy("file_id").agg(F.count("*").alias("n_exports"), F.every("matches").alias("intact"))


def log_hash(entries: DataFrame) -> DataFrame:
    """SHA-256 of each ledger's lines in order: ledger, log_hash. A line is the canonical text of an entry and its hash. The digest depends on
    the order of all lines, so a ledger's hashes are put together in one task."""
    lines = entries.groupBy("ledger").agg(F.array_sort(F.collect_list(F.struct("line_no", "entry_hash"))).alias("e"))
    return lines.select("ledger", F.sha2(F.array_join(F.col("e.entry_hash"), "\n"), 256).alias("log_hash"))


def of_kind(entries: DataFrame, kind: str) -> DataFrame:
    """Entries of scans ("Scan") or of wipes ("Wipe": of drives and files)."""
    return entries.where(F.col("operation").isin("WipeDrive", "WipeFile") if kind == "Wipe" else F.col("operation") == kind)


def selected(artifacts: DataFrame, ids: DataFrame, session: str) -> DataFrame:
    """Artifacts(session_id, id, ...) with one of the ids: those of the session; an id that the session lacks is taken from the others."""
    named = artifacts.join(ids.select("id").distinct(), "id", "left_semi")
    own = named.where(F.col("session_id") == session)
    return own.unionByName(named.where(F.col("session_id") != session).join(own.select("id"), "id", "left_anti"))


def exported(artifacts: DataFrame, destination: str) -> DataFrame:
    """What exporting artifacts(id, payload, ...) records: file_id, destination and the hash of what was copied, taken anew."""
    return artifacts.select(F.col("id").alias("file_id"), F.concat(F.lit(destination.rstrip("/") + "/"), F.col("path")).alias("destination"), F.sha2("payload", 256).alias("sha256"))
