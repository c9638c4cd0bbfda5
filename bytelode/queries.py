"""All queries of the engine, with SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelode.functions import binary as B
from bytelode.functions.catalog import catalog_search, catalog_stats, rules, rules_frame
from bytelode.operators import carve as C
from bytelode.operators import anchor as A
from bytelode.operators import classify, fragment, imager, ledger, mft, sanitize, views
from bytelode.operators.scan import LOOKAHEAD, header_checks, scan, virtual_layout
from bytelode.plans import fixtures
from bytelode.sources.rawimage import table_chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: str):
    return F.col(c).cast("long").alias(c)


def _rules_sql() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    rows = ",".join(f"({r.number},'{r.magic.hex().upper()}','{r.extension}','{r.category}',{text(r.validator)})" for r in rules())
    return f"(VALUES {rows}) AS rules(sig_idx, magic, extension, category, validator)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data"))


def _doc_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


# Catalog


@query(f"SELECT category, count(*) AS n_rules, count(DISTINCT extension) AS n_extensions FROM {_rules_sql()} GROUP BY category")
def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_stats(rules_frame(spark))


@query(f"SELECT sig_idx, extension, category, magic FROM {_rules_sql()} WHERE lower(extension || chr(10) || extension || ' (' || category || ')' || chr(10) || category || chr(10) || magic) LIKE '%zip%'")
def catalog_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_search(rules_frame(spark), "ZIP").select("sig_idx", "extension", "category", F.hex("magic").alias("magic"))


# Scan and carve


@query("""SELECT page_id, CAST(coalesce(sum(s) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM (SELECT page_id, (octet_length(encode(html)) + 511) // 512 * 512 AS s FROM pages)""")
def virtual_image_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _pages(spark, sf_dir).select("page_id", F.length("data").alias("size"))
    return virtual_layout(files, "page_id", "size").select("page_id", "start")


_HTML_HITS = """SELECT image_id, "offset", sig_idx FROM (
 SELECT CAST(page_id AS VARCHAR) AS image_id, m.sig_idx, CAST(list_sum(list_transform(list_slice(string_split(html, m.magic), 1, i), lambda x: octet_length(encode(x)))) + (i - 1) * octet_length(encode(m.magic)) AS BIGINT) AS "offset"
 FROM pages, (VALUES (18, '<!DOCTYPE html'), (19, '<html')) AS m(sig_idx, magic), unnest(range(1, len(string_split(html, m.magic)))) AS t(i))"""


@query(_HTML_HITS)
def magic_scan_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table_chunks(_pages(spark, sf_dir), "page_id", "data"), ["html"])


@query(f"""WITH h AS ({_HTML_HITS}), b AS (SELECT CAST(page_id AS VARCHAR) AS image_id, html FROM pages),
w AS (SELECT h.image_id, h."offset", h.sig_idx, substr(hex(encode(b.html)), 2 * h."offset" + 1) AS x FROM h JOIN b USING (image_id))
SELECT image_id, "offset", CASE sig_idx WHEN 18 THEN 'Document' ELSE 'Document' END AS category, CAST(length(x) / 2 AS BIGINT) AS size, sha256(unhex(x)) AS sha256,
CASE WHEN sig_idx = 18 THEN 0.70 ELSE 0.65 END AS confidence, 'Medium' AS confidence_label FROM w""")
def carve_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("image_id"), "data")
    hits = scan(table_chunks(pages, "image_id", "data"), ["html"])
    found = hits.join(pages, "image_id").select("image_id", "offset", "sig_idx", F.expr("substring(data, cast(offset as int) + 1)").alias("window"))
    return C.carve(found, ["html"]).select("image_id", "offset", "category", "size", "sha256", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "confidence_label")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def artifact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))
    return rows.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def _flags(rows: list[tuple[str, bytes, bool]], names: str) -> str:
    """SQL of literal expectations: (name, number of the case, ok)."""
    return f"SELECT * FROM (VALUES {', '.join(f'({k}, {n!r}, {str(ok).lower()})' for k, (n, _, ok) in enumerate(rows))}) AS t(id, {names}, ok)"


def _cases(spark: SparkSession, rows: list[tuple[str, bytes, bool]], name: str) -> DataFrame:
    return spark.createDataFrame([(k, n, bytearray(d)) for k, (n, d, _) in enumerate(rows)], f"id int, {name} string, data binary")


@query(_flags(fixtures.VALIDATOR_CASES, "validator"))
def validator_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validated(_cases(spark, fixtures.VALIDATOR_CASES, "validator")).select("id", "validator", "ok")


@query(_flags(fixtures.HEADER_CASES, "extension"))
def header_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return header_checks(_cases(spark, fixtures.HEADER_CASES, "extension")).select("id", "extension", "ok")


@query(f"SELECT * FROM (VALUES {', '.join(f'({k}, {e!r}, {end})' for k, (e, _, end) in enumerate(fixtures.BOUNDARY_CASES))}) AS t(id, extension, \"end\")")
def boundary_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bounded(_cases(spark, fixtures.BOUNDARY_CASES, "extension")).select("id", "extension", F.col("end").cast("int").alias("end"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {e!r}, '{name}', '{value}')" for k, (e, _, pairs) in enumerate(fixtures.METADATA_CASES) for name, value in pairs) + ") AS t(id, extension, k, v)")
def metadata_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.classified(_cases(spark, fixtures.METADATA_CASES, "extension"))
    return rows.select("id", "extension", F.explode("metadata").alias("m")).select("id", "extension", "m.k", "m.v")


_SECRET_RULES = ["key", "token", "jwt", "pem"]


@query("""WITH h AS (SELECT doc_id, text, m.rule, m.magic, i, list_slice(string_split(text, m.magic), 1, i) AS before
 FROM documents, (VALUES ('aws_key', 'AKIA'), ('github_pat', 'ghp_'), ('jwt', 'eyJ'), ('pem', '-----BEGIN ')) AS m(rule, magic), unnest(range(1, len(string_split(text, m.magic)))) AS t(i)),
f AS (SELECT doc_id, rule, CAST(list_sum(list_transform(before, lambda x: octet_length(encode(x)))) + (i - 1) * length(magic) AS BIGINT) AS "offset", substr(text, CAST(list_sum(list_transform(before, lambda x: length(x))) + i * length(magic) + 1 AS BIGINT)) AS rest FROM h)
SELECT CAST(doc_id AS VARCHAR) AS image_id, rule, "offset" FROM f WHERE CASE rule WHEN 'aws_key' THEN regexp_matches(rest, '^[A-Z0-9]{16}') WHEN 'github_pat' THEN regexp_matches(rest, '^[A-Za-z0-9]{36}')
 WHEN 'jwt' THEN regexp_matches(rest, '^[A-Za-z0-9_-]*[.][A-Za-z0-9_-]+([.]|[ \\t-\\r]|$)') ELSE contains(rest, '-----END ') END""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents: hits of the rules for them whose text passes the rule's validator."""
    docs = _doc_bytes(spark, sf_dir).select(F.col("doc_id").cast("string").alias("image_id"), "data")
    hits = scan(table_chunks(docs, "image_id", "data"), _SECRET_RULES).join(F.broadcast(rules_frame(spark, _SECRET_RULES).where("validator is not null")), "sig_idx")
    found = hits.join(docs, "image_id").withColumn("data", F.expr("substring(data, cast(offset as int) + 1)"))
    return C.validated(found.select("image_id", "offset", "validator", "data")).where("ok").select("image_id", F.col("validator").alias("rule"), "offset")


@query("SELECT CAST(NULL AS VARCHAR) AS image_id, CAST(NULL AS BIGINT) AS \"offset\", CAST(NULL AS INTEGER) AS sig_idx WHERE false")
def scan_documents_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives, pictures and programs in documents: prose holds none."""
    docs = _doc_bytes(spark, sf_dir)
    return scan(table_chunks(docs, "doc_id", "data"), ["zip", "png", "jpg", "elf", "sqlite", "7z"])


# Byte statistics

_BYTES = "SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY 1, 2"


@query(f"WITH c AS ({_BYTES}), n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY 1), h AS (SELECT doc_id, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM c JOIN n USING (doc_id) GROUP BY 1) SELECT doc_id, coalesce(entropy, 0) AS entropy FROM documents LEFT JOIN h USING (doc_id)")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_bytes(spark, sf_dir).select("doc_id", F.round(B.entropy(F.col("data")), 6).alias("entropy"))


@query(f"WITH c AS ({_BYTES}), n AS (SELECT doc_id, sum(c) AS n, sum(c * c) AS s FROM c GROUP BY 1), h AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS h FROM c JOIN n USING (doc_id) GROUP BY 1) SELECT doc_id, coalesce(round(s * 256.0 / n - n, 4), 0) AS chi_square, CASE WHEN h >= 7.85 AND s * 256.0 / n - n <= 380 AND n >= 512 THEN 'Uniform random' WHEN h >= 7.5 THEN 'Compressed or encrypted' ELSE 'Structured' END AS label FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)")
def byte_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_bytes(spark, sf_dir).select("doc_id", F.length("data").alias("n"), B.byte_counts(F.col("data")).alias("c"))
    rows = rows.select("doc_id", "n", B.chi_square(F.col("c")).alias("chi"), B.entropy_of_counts(F.col("c")).alias("h"))
    return rows.select("doc_id", F.round("chi", 4).alias("chi_square"), B.randomness_label(F.col("h"), F.col("chi"), F.col("n")).alias("label"))


@query(f"SELECT b AS byte, CAST(sum(c) AS BIGINT) AS n, count(*) AS docs FROM ({_BYTES}) GROUP BY 1")
def byte_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_bytes(spark, sf_dir).select(F.posexplode(B.byte_counts(F.col("data"))).alias("k", "c")).where("c > 0")
    return rows.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("docs")).select(F.lpad(F.hex(F.col("k").cast("long")), 2, "0").alias("byte"), "n", "docs")


@query(f"""WITH c AS ({_BYTES}), n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY 1), f AS (SELECT doc_id, b, c / n AS p FROM c JOIN n USING (doc_id)),
s AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS other FROM documents), a AS (SELECT upper(printf('%02x', i)) AS b FROM range(256) AS t(i))
SELECT s.doc_id, s.other, round(greatest(0, sum((coalesce(x.p, 0) + 1e-9) * ln((coalesce(x.p, 0) + 1e-9) / (coalesce(y.p, 0) + 1e-9)))), 4) AS kl
FROM s CROSS JOIN a LEFT JOIN f x ON x.doc_id = s.doc_id AND x.b = a.b LEFT JOIN f y ON y.doc_id = s.other AND y.b = a.b WHERE s.other IS NOT NULL GROUP BY 1, 2""")
def kl_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select("doc_id", F.lead("doc_id").over(Window.partitionBy("lang").orderBy("doc_id")).alias("other")).where("other is not null")
    p = _doc_bytes(spark, sf_dir).select("doc_id", B.byte_counts(F.col("data")).alias("c")).select("doc_id", B.frequencies(F.col("c")).alias("p"))
    both = pairs.join(p, "doc_id").join(p.select(F.col("doc_id").alias("other"), F.col("p").alias("q")), "other")
    return both.select("doc_id", "other", F.round(B.kl_divergence(F.col("p"), F.col("q")), 4).alias("kl"))


@query("""WITH b AS (SELECT doc_id, regexp_extract_all(left(hex(encode(coalesce(text, ''))), 8192), '..') AS b FROM documents),
p AS (SELECT doc_id, b, CASE WHEN len(b) = 0 THEN 0 ELSE len(list_filter(b, lambda x: x BETWEEN '20' AND '7E' OR x IN ('09', '0A', '0D'))) / len(b) END AS p FROM b)
SELECT doc_id, round(p, 6) AS printable, p > 0.85 AND NOT list_contains(b, '00') AS is_text FROM p""")
def text_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_bytes(spark, sf_dir).select("doc_id", F.round(B.printable_ratio(F.col("data")), 6).alias("printable"), B.is_text(F.col("data")).alias("is_text"))


@query("""SELECT id, CASE WHEN n % 4096 = 0 THEN 0 ELSE 4096 - n % 4096 END AS slack_len, CASE WHEN n % 4096 = 0 THEN 0 ELSE least(40, 4096 - n % 4096) END AS nonzero,
CASE WHEN n % 4096 = 0 THEN 0 ELSE least(40, 4096 - n % 4096) END AS printable, CASE WHEN n % 4096 = 0 THEN 0 ELSE least(40, 4096 - n % 4096) END > 16 AS anomaly FROM (SELECT doc_id AS id, octet_length(encode(text)) AS n FROM documents)""")
def slack_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in clusters whose slack begins with 40 left-over letters."""
    rows = _doc_bytes(spark, sf_dir).select(F.col("doc_id").alias("id"), F.length("data").cast("long").alias("logical_size"), "data")
    slack = F.expr("cast(pmod(4096 - logical_size % 4096, 4096) as int)")
    left = F.least(slack, F.lit(40))
    padded = F.concat("data", F.encode(F.repeat(F.lit("x"), left), "UTF-8"), F.encode(F.repeat(F.lit("\0"), slack - left), "UTF-8"))
    return views.slack_report(rows.withColumn("data", padded))


# File records and times


@query("SELECT event_id, epoch_us(ts) * 10 + 116444736000000000 AS filetime, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS text FROM events")
def filetime_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", B.to_filetime(F.col("ts")).alias("filetime"))
    return rows.withColumn("text", B.filetime_text(F.col("filetime")))


_STOMP = """SELECT o_orderkey, l_linenumber, CAST(epoch_us(o_orderdate) * 10 + 116444736000000000 AS BIGINT) AS si, CAST(epoch_us(l_shipdate) * 10 + 116444736000000000 + (l_linenumber % 2) * 5 AS BIGINT) AS fn FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


@query(f"""SELECT o_orderkey, l_linenumber, CASE WHEN si + 20000000 < fn THEN 'CRITICAL' WHEN si % 10000000 = 0 AND fn % 10000000 <> 0 THEN 'WARNING' END AS severity,
CAST(CASE WHEN si + 20000000 < fn THEN (fn - si) // 10000000 WHEN si % 10000000 = 0 AND fn % 10000000 <> 0 THEN 0 END AS BIGINT) AS delta_seconds FROM ({_STOMP})""")
def timestomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as a file's standard times, ship dates as its name's times."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", B.to_filetime(F.col("o_orderdate")).alias("si"), (B.to_filetime(F.col("l_shipdate")) + F.col("l_linenumber") % 2 * 5).alias("fn"))
    alert = mft.timestomp(F.col("si"), F.col("si"), F.col("fn"), F.col("fn"))
    return rows.withColumn("a", alert).select("o_orderkey", "l_linenumber", "a.severity", "a.delta_seconds")


_GREEDY = """SELECT image_id, lba, row_number() OVER (PARTITION BY image_id ORDER BY lba) - 1 AS record_number FROM (
SELECT image_id, lba, row_number() OVER (PARTITION BY image_id, island ORDER BY lba) AS n FROM (
SELECT event_type AS image_id, event_id AS lba, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM events)) WHERE n % 2 = 1"""


@query(_GREEDY)
def mft_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mft.accept_sectors(table(spark, sf_dir, "events").select(F.col("event_type").alias("image_id"), F.col("event_id").alias("lba")))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_number"), F.concat(F.col("event_type"), F.lit("_"), F.col("user_id").cast("string"), F.lit(".dat")).alias("filename"),
        (F.col("event_id") % 3 != 0).alias("is_in_use"), (F.coalesce(F.col("value"), F.lit(0.0)) > 50).alias("timestomp_detected"),
    )


_RECORDS = "(SELECT event_id AS record_number, event_type || '_' || CAST(user_id AS VARCHAR) || '.dat' AS filename, event_id % 3 <> 0 AS is_in_use, coalesce(value, 0) > 50 AS timestomp_detected FROM events)"


@query(f"SELECT count(*) AS scanned, count(*) FILTER (is_in_use) AS active, count(*) FILTER (NOT is_in_use) AS deleted, count(*) FILTER (timestomp_detected) AS timestomps FROM {_RECORDS}")
def mft_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mft.mft_stats(_records(spark, sf_dir))


@query(f"SELECT record_number, filename FROM {_RECORDS} WHERE (filename LIKE '%12%' OR CAST(record_number AS VARCHAR) LIKE '%12%') AND NOT is_in_use AND timestomp_detected")
def mft_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.mft_filter(_records(spark, sf_dir), "12", deleted=True, tampered=True).select("record_number", "filename")


# Ledger and custody


def _ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a ledger of its own."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"))
    number = F.row_number().over(Window.partitionBy("ledger").orderBy("event_id")) - 1
    return rows.select("ledger", number.cast("long").alias("index"), "timestamp", F.col("event_type").alias("operation"), F.lit("analyst@host").alias("operator"), F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.lit("}")).alias("detail"))


_CHAIN = """WITH RECURSIVE e AS (SELECT user_id AS ledger, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS i, CAST(epoch_us(ts) AS VARCHAR) AS t, event_type AS o, event_id FROM events),
c(ledger, i, prev_hash, entry_hash) AS (
 SELECT ledger, i, repeat('0', 64), sha256('{"detail":{"event":' || event_id || '},"index":' || i || ',"operation":"' || o || '","operator":"analyst@host","prev_hash":"' || repeat('0', 64) || '","timestamp":"' || t || '"}') FROM e WHERE i = 0
 UNION ALL
 SELECT e.ledger, e.i, c.entry_hash, sha256('{"detail":{"event":' || e.event_id || '},"index":' || e.i || ',"operation":"' || e.o || '","operator":"analyst@host","prev_hash":"' || c.entry_hash || '","timestamp":"' || e.t || '"}')
 FROM c JOIN e ON e.ledger = c.ledger AND e.i = c.i + 1)"""


@query(f'{_CHAIN} SELECT ledger, i AS "index", prev_hash, entry_hash FROM c')
def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.chain(_ledger_events(spark, sf_dir)).select("ledger", "index", "prev_hash", "entry_hash")


@query("SELECT user_id AS ledger, count(*) AS n_entries, count(*) <= 3 AS valid, CASE WHEN count(*) > 3 THEN 3 END AS first_bad FROM events GROUP BY 1")
def ledger_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledgers with the detail of entry 3 changed."""
    rows = ledger.chain(_ledger_events(spark, sf_dir)).withColumn("line_no", F.col("index"))
    return ledger.verify_chain(rows.withColumn("detail", F.when(F.col("index") == 3, F.lit("{}")).otherwise(F.col("detail"))))


_LEVELS = 24


@query("WITH l0 AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, sha256(CAST(event_id AS VARCHAR)) AS h FROM events)" + "".join(
    f", l{k + 1} AS (SELECT pos // 2 AS pos, CASE WHEN (SELECT count(*) FROM l{k}) = 1 THEN min(h) ELSE sha256(arg_min(h, pos) || arg_max(h, pos)) END AS h FROM l{k} GROUP BY pos // 2)" for k in range(_LEVELS)
) + f" SELECT h AS merkle_root FROM l{_LEVELS}")
def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    # event_id is dense from 0 in this table; positions of other leaves come from virtual_layout's way of counting.
    pos = virtual_layout(events.withColumn("one", F.lit(1)), "event_id", "one").select((F.col("start") / 512).cast("long").alias("pos"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"))
    return spark.createDataFrame([(ledger.merkle_root(pos),)], "merkle_root string")


@query()
def anchor_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a root to be anchored; a customer signs."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("merkle_root"), F.col("o_custkey").cast("long").alias("records"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), F.col("o_orderpriority").alias("officer"),
        F.concat(F.lit("ed25519:"), F.sha2(F.col("o_custkey").cast("string"), 512)).alias("signature"),
    )
    made = A.anchor(rows, A.Domain("byte evidence ledger", "1.0.0", 137, "00" * 20))
    return made.select("o_orderkey", "digest", "call_data", "tx_hash")


_READS = """(SELECT event_type AS image_id, event_id AS lba, a AS attempt, (event_id + a) % 4 <> 0 AND event_id % 9 <> 0 AS ok FROM events, range(3) AS t(a))"""


@query(f"SELECT image_id, count(*) * 512 AS total_bytes, count(*) FILTER (good IS NULL) AS bad_sectors, CAST(sum(coalesce(good, 2)) AS BIGINT) AS retries, count(*) FILTER (good IS NULL) = 0 AS complete FROM (SELECT image_id, lba, min(attempt) FILTER (ok) AS good FROM {_READS} GROUP BY 1, 2) GROUP BY 1")
def image_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imager.image_result(_sectors(spark, sf_dir))


@query("SELECT event_type AS image_id, event_id AS lba, CAST(1 AS BIGINT) AS count, 'BAD_SECTOR_ZERO_FILLED' AS status FROM events WHERE event_id % 9 = 0")
def image_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imager.fault_map(_sectors(spark, sf_dir))


def _sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts at a sector for each event: one attempt in four fails, and one sector in nine always."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("image_id"), F.col("event_id").alias("lba"), F.explode(F.array(*map(F.lit, range(3)))).alias("attempt"))
    ok = ((F.col("lba") + F.col("attempt")) % 4 != 0) & (F.col("lba") % 9 != 0)
    return imager.image_sectors(rows.withColumn("data", F.when(ok, F.encode(F.repeat(F.lit("x"), F.lit(512)), "UTF-8"))))


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS scans, count(*) FILTER (event_type IN ('click', 'purchase')) AS wipes, count(DISTINCT user_id) AS operators FROM events")
def ledger_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "Scan").when(F.col("event_type") == "click", "WipeDrive").when(F.col("event_type") == "purchase", "WipeFile").otherwise("Other")
    return ledger.ledger_stats(table(spark, sf_dir, "events").select(kind.alias("operation"), F.col("user_id").alias("operator")))


@query("""SELECT o_orderkey AS file_id, CAST(o_custkey AS VARCHAR) AS destination, c_name IS NOT NULL AND o_orderkey % 5 <> 0 AS matches FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey""")
def custody_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as exports of files that customers not divisible by three were extracted for, one in five with another hash."""
    o = table(spark, sf_dir, "orders")
    taken = o.where("o_custkey % 3 <> 0").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("file_id"), F.lit("t").alias("extracted_at"), F.lit(0).cast("long").alias("source_offset"), F.sha2("c_name", 256).alias("sha256_at_extract"))
    named = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = named.select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").cast("string").alias("destination"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("other")).otherwise(F.sha2("c_name", 256)).alias("sha256"))
    return ledger.export_custody(taken, out).select("file_id", "destination", "matches")


@query("SELECT o_custkey AS file_id, count(*) AS n_exports, bool_and(o_orderkey % 7 <> 0) AS intact FROM orders GROUP BY 1")
def custody_intact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.custody_badges(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), (F.col("o_orderkey") % 7 != 0).alias("matches")))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def export_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("sha256"))


# Views


_ARTIFACTS = "(SELECT doc_id AS id, source AS extension, sha256(text) AS sha256, (ARRAY['Image','Document','Archive','Audio','Certificate','Executable'])[1 + doc_id % 6] AS category, (50 + doc_id % 50) / 100.0 AS confidence, doc_id % 11 = 0 AS reconstructed FROM documents)"


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Image", "Document", "Archive", "Audio", "Certificate", "Executable")))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("extension"), F.sha2("text", 256).alias("sha256"), F.get(names, (F.col("doc_id") % 6).cast("int")).alias("category"),
        ((50 + F.col("doc_id") % 50) / 100).cast("float").alias("confidence"), (F.col("doc_id") % 11 == 0).alias("reconstructed"),
    )


@query(f"SELECT CASE category WHEN 'Image' THEN 'image' WHEN 'Document' THEN 'document' WHEN 'Audio' THEN 'media' WHEN 'Archive' THEN 'archive' WHEN 'Certificate' THEN 'secret' ELSE 'other' END AS kind, count(*) AS n FROM {_ARTIFACTS} GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.category_counts(_artifacts(spark, sf_dir))


@query(f"SELECT CAST(id AS VARCHAR) AS id, category FROM {_ARTIFACTS} WHERE (extension LIKE '%a1%' OR sha256 LIKE '%a1%' OR CAST(id AS VARCHAR) LIKE '%a1%') AND category = 'Certificate' AND confidence >= 0.9")
def artifact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.artifact_filter(_artifacts(spark, sf_dir), "A1", "Secret", "high").select("id", "category")


@query(f"SELECT CAST(id AS VARCHAR) AS id, sha256 FROM {_ARTIFACTS} ORDER BY sha256, id LIMIT 25")
def topk_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifacts(spark, sf_dir).orderBy("sha256", F.col("id").cast("long")).limit(25).select("id", "sha256")


@query("""WITH t AS (SELECT CAST(max(doc_id) + 1 AS BIGINT) AS n FROM documents), h AS (SELECT least(139, doc_id * 140 // n) AS bucket, doc_id, source FROM documents, t),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS k FROM h)
SELECT CAST(b AS INTEGER) AS bucket, count(r.doc_id) AS n_hits, coalesce(string_agg(source, ',' ORDER BY k) FILTER (k <= 5), '') AS extensions FROM range(140) AS x(b) LEFT JOIN r ON r.bucket = b GROUP BY 1""")
def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.max("doc_id")).first()[0] + 1
    return views.sector_map(docs.select(F.col("doc_id").alias("offset"), F.col("source").alias("extension")), total)


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events), m AS (SELECT max(day) AS last FROM d), b AS (SELECT CAST(user_id AS VARCHAR) AS path FROM d, m WHERE day = last - 1), a AS (SELECT CAST(user_id AS VARCHAR) AS path FROM d, m WHERE day = last)
SELECT path, 'connected' AS change FROM a WHERE path NOT IN (SELECT path FROM b) UNION ALL SELECT path, 'disconnected' FROM b WHERE path NOT IN (SELECT path FROM a)""")
def device_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the last two days as devices of two snapshots."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("path")).distinct()
    last = days.agg(F.max("day")).first()[0]
    return views.device_diff(days.where(F.col("day") == F.date_sub(F.lit(last), 1)), days.where(F.col("day") == F.lit(last)))


@query("""WITH s AS (SELECT user_id AS job_id, epoch_us(ts) // 1000 AS ts_ms, event_id, sum(event_id % 100) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id ROWS UNBOUNDED PRECEDING) AS bytes FROM events),
g AS (SELECT job_id, ts_ms, max(bytes) AS bytes FROM s GROUP BY 1, 2), f AS (SELECT *, lag(bytes) OVER w AS pb, lag(ts_ms) OVER w AS pt, first(ts_ms) OVER w AS t0 FROM g WINDOW w AS (PARTITION BY job_id ORDER BY ts_ms))
SELECT job_id, ts_ms, round((bytes - pb) * 1000.0 / (ts_ms - pt), 6) AS speed, round(CASE WHEN ts_ms > t0 AND bytes > 0 THEN (1000000 - bytes) / (bytes * 1000.0 / (ts_ms - t0)) END, 3) AS eta FROM f""")
def progress_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ts_ms"), "event_id")
    run = F.sum(F.col("event_id") % 100).over(Window.partitionBy("job_id").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    samples = rows.withColumn("bytes", run).groupBy("job_id", "ts_ms").agg(F.max("bytes").alias("bytes")).withColumn("total", F.lit(1_000_000))
    return views.throughput(samples).select("job_id", "ts_ms", F.round("speed", 6).alias("speed"), F.round("eta", 3).alias("eta"))


@query("""SELECT page_id, CAST(16 * i AS BIGINT) AS "offset", substr(h, 32 * i + 1, 32) AS hex FROM (SELECT page_id, hex(encode(html)) AS h FROM pages), unnest(range((len(h) + 31) // 32)) AS t(i)""")
def hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hex_dump(_pages(spark, sf_dir), "page_id").select("page_id", "offset", "hex")


@query("SELECT page_id, 'data:text/html;base64,' || base64(encode(html)) AS uri FROM pages")
def data_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", B.data_uri(F.col("data"), classify.mime(F.lit("html"))).alias("uri"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n * 20 + 1024) // 2048 // 10 || '.' || (n * 20 + 1024) // 2048 % 10 || ' KB' WHEN n < 1073741824 THEN (n * 20 + 1048576) // 2097152 // 10 || '.' || (n * 20 + 1048576) // 2097152 % 10 || ' MB'
ELSE (n * 200 + 1073741824) // 2147483648 // 100 || '.' || lpad(CAST((n * 200 + 1073741824) // 2147483648 % 100 AS VARCHAR), 2, '0') || ' GB' END AS size FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * 2 AS n FROM orders)""")
def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", B.format_size(key * key * 2).alias("size"))


@query("SELECT e AS extension, k AS kind FROM (VALUES ('png', 'image'), ('mp4', 'video'), ('mp3', 'audio'), ('rs', 'text'), ('exe', 'binary')) AS t(e, k)")
def preview_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("png",), ("mp4",), ("mp3",), ("rs",), ("exe",)], "extension string")
    return rows.select("extension", classify.preview_kind(F.col("extension")).alias("kind"))


@query("SELECT standard, CAST(pass AS INTEGER) AS pass, pattern FROM (SELECT s AS standard, unnest(range(1, len(p) + 1)) AS pass, unnest(p) AS pattern FROM (VALUES ('Clear', ['00']), ('Random', ['R']), ('DoD', ['00','FF','R']), ('Gutmann7', ['00','FF','R','92','49','24','R']), ('Purge', ['00','R'])) AS t(s, p))")
def wipe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.wipe_plan(spark)


@query("SELECT event_type AS image_id, count(*) AS sectors_checked, count(*) FILTER (event_id % 10 = 0) AS mismatches, min(event_id) FILTER (event_id % 10 = 0) AS first_bad, round(max(CASE WHEN event_id % 10 = 0 THEN -(1 / 512.0 * log2(1 / 512.0) + 511 / 512.0 * log2(511 / 512.0)) ELSE 0 END), 6) AS max_entropy, count(*) FILTER (event_id % 10 = 0) = 0 AS passed FROM events GROUP BY 1")
def wipe_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zeroed sector for each event; one in ten is dirty."""
    return _verified(spark, sf_dir).withColumn("max_entropy", F.round("max_entropy", 6))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.when(F.col("event_id") % 10 == 0, F.lit("x")).otherwise(F.lit("\0"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("image_id"), F.col("event_id").alias("lba"), F.encode(F.concat(dirty, F.repeat(F.lit("\0"), F.lit(511))), "UTF-8").alias("data"))
    return sanitize.wipe_verify(rows, "Zero")


@query("SELECT * FROM (VALUES (0, 27, 100, 3, 5, false), (1, 27, 9, 3, 5, true), (2, 27, 100, 100, 5, true), (3, 27, 100, 3, 5, true)) AS t(id, celsius, spare, wear, media_errors, failing)")
def smart_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    def page(warning: int, spare: int, wear: int) -> bytearray:
        b = bytearray(512)
        b[0], b[3], b[5] = warning, spare, wear
        b[1:3] = (300).to_bytes(2, "little")
        b[176:184] = (5).to_bytes(8, "little")
        return b

    rows = spark.createDataFrame([(0, page(0, 100, 3)), (1, page(0, 9, 3)), (2, page(0, 100, 100)), (3, page(1, 100, 3))], "id int, log binary")
    out = rows.select("id", B.smart_log(F.col("log")).alias("s")).select("id", "s.*")
    return out.select("id", *[F.col(c).cast("int") for c in ("celsius", "spare", "wear", "media_errors")], "failing")


# Planted image: literal expectations


@query("""SELECT * FROM (VALUES (5120, 'jpg'), (5133, 'ico'), (51200, 'png'), (102400, 'pdf'), (256000, 'elf'), (409600, 'sqlite'), (614414, 'ico')) AS t("offset", extension)""")
def planted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = fixtures.as_chunks(spark, fixtures.planted_image(), 64 * 1024, LOOKAHEAD)
    return scan(chunks).join(F.broadcast(rules_frame(spark)), "sig_idx").select(F.col("offset").cast("int").alias("offset"), "extension")


@query("""SELECT * FROM (VALUES (5120, 'jpg', 22, 1.0, 'High'), (5133, 'ico', 22, 0.8, 'Medium'), (51200, 'png', 69, 1.0, 'High'), (102400, 'pdf', 48, 1.0, 'High'), (256000, 'elf', 1841119, 1.0, 'High'), (614414, 'ico', 1024, 0.8, 'Medium')) AS t("offset", extension, size, confidence, confidence_label)""")
def planted_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = fixtures.planted_image()
    chunks = fixtures.as_chunks(spark, image, 64 * 1024, LOOKAHEAD)
    found = C.carve(C.windows(scan(chunks, ["jpg", "ico", "png", "pdf", "elf"]), chunks))
    return found.select(F.col("offset").cast("int").alias("offset"), "extension", F.col("size").cast("int").alias("size"), F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "confidence_label")


@query("SELECT 'classified_report.txt' AS filename, false AS is_in_use, true AS is_resident, 15 AS file_size, 'top secret body' AS resident_preview, 'CRITICAL' AS severity, 150000000 AS delta_seconds")
def planted_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = mft.scan_records(fixtures.as_chunks(spark, fixtures.planted_image(), 64 * 1024, LOOKAHEAD))
    return parsed.select("filename", "is_in_use", "is_resident", F.col("file_size").cast("int").alias("file_size"), "resident_preview", "timestomp_alert.severity", F.col("timestomp_alert.delta_seconds").cast("int").alias("delta_seconds"))


@query("SELECT 'a' AS id, 8192 AS frag_offset, 4096 AS gap")
def best_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive's head, a gap of zeros and its tail."""
    import random

    body = random.Random(7).randbytes(8192)
    image = body[:4096] + bytes(4096) + body[4096:] + bytes(65536)
    probes = spark.createDataFrame([("i", at, bytearray(image[at : at + 4096])) for at in range(0, len(image) - 4095, 512)], "image_id string, pos long, data binary")
    tails = spark.createDataFrame([("i", "a", 4096, bytearray(body[:4096]))], "image_id string, id string, end long, data binary")
    best = fragment.best_windows(fragment.with_profile(tails), fragment.with_profile(probes))
    return best.select("id", F.col("frag_offset").cast("int").alias("frag_offset"), F.col("gap").cast("int").alias("gap"))


# An image of files: literal expectations


@query("""SELECT event_type AS image_id, CAST(sum(octet_length(encode(t))) AS BIGINT) AS n_bytes, sha256(string_agg(t, '' ORDER BY event_id)) AS sha256 FROM (SELECT event_type, event_id, event_type || ':' || event_id || ';' AS t FROM events) GROUP BY 1""")
def image_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("image_id"), F.col("event_id").alias("chunk_start"), F.encode(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"), F.lit(";")), "UTF-8").alias("data"))
    return imager.image_digest(rows)


@query("SELECT page_id, least(100, n) AS \"offset\", substr(h, 201, 64) AS hex, n AS total_size FROM (SELECT page_id, hex(encode(html)) AS h, CAST(octet_length(encode(html)) AS BIGINT) AS n FROM pages)")
def hex_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hex_window(_pages(spark, sf_dir), "page_id", "data", 100, 32).select("page_id", "offset", F.hex("bytes").alias("hex"), "total_size")


@query("""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS md5 FROM pages""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(B.html_escape(F.col("html"))).alias("md5"))


@query("""SELECT * FROM (VALUES (0, '<svg xmlns="http://www.w3.org/2000/svg" width="1"/>'), (1, 'x<svg xmlns="u"/>'), (2, 'no root')) AS t(id, svg)""")
def svg_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, '<svg width="1"/>'), (1, 'x<svg xmlns="u"/>'), (2, "no root")], "id int, svg string")
    return rows.select("id", B.with_namespace(F.col("svg")).alias("svg"))


@query("SELECT * FROM (VALUES (0, 'FFD8FF01FFD9'), (1, 'FFD8FF0102'), (2, NULL)) AS t(id, jpeg)")
def embedded_thumbnail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, bytearray(b"II*\0" + bytes.fromhex("FFD8FF01FFD9") + b"\xff\xd9tail")), (1, bytearray(b"MM" + bytes.fromhex("FFD8FF0102"))), (2, bytearray(b"nothing"))], "id int, data binary")
    return rows.select("id", F.hex(B.embedded_jpeg(F.col("data"))).alias("jpeg"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_partkey > 0 THEN 100 * l_linenumber // l_partkey ELSE 0 END AS INTEGER) AS percent FROM lineitem")
def percent_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", B.percent(F.col("l_linenumber"), F.col("l_partkey")).alias("percent"))


@query(f"SELECT CAST(id AS VARCHAR) AS id, CASE WHEN confidence >= 0.85 THEN 'badge-high' WHEN confidence >= 0.60 THEN 'badge-medium' WHEN confidence >= 0.40 THEN 'badge-low' ELSE 'badge-fragment' END AS style FROM {_ARTIFACTS}")
def tier_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifacts(spark, sf_dir).select("id", B.tier_class(B.tier(F.col("confidence"))).alias("style"))


@query("""WITH j AS (SELECT user_id AS job_id, CAST(count(*) AS BIGINT) * 1000000 AS b, CAST(1000000000 AS BIGINT) AS t FROM events GROUP BY 1)
SELECT job_id, CAST(k AS INTEGER) AS bucket, CASE WHEN k < d THEN 'wiped' WHEN k = d THEN 'writing' ELSE 'pending' END AS state, k * n // 140 AS start_lba, greatest(k * n // 140, least(n - 1, (k + 1) * n // 140 - 1)) AS end_lba
FROM (SELECT job_id, t // 512 AS n, least(140, CAST(floor(least(1.0, b / t) * 140) AS BIGINT)) AS d FROM j), range(140) AS x(k)""")
def wipe_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg((F.count("*") * 1_000_000).alias("bytes_written")).withColumn("total_bytes", F.lit(1_000_000_000).cast("long"))
    return views.wipe_map(jobs)


@query("""WITH s AS (SELECT user_id AS job_id, epoch_us(ts) // 1000 AS ts_ms, event_id, sum(event_id % 100) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id ROWS UNBOUNDED PRECEDING) AS bytes FROM events),
g AS (SELECT job_id, max(ts_ms) AS ts_ms, max(bytes) AS bytes FROM s GROUP BY job_id, ts_ms // 86400000) SELECT job_id, ts_ms, round((bytes - lag(bytes) OVER w) * 1000.0 / (ts_ms - lag(ts_ms) OVER w), 6) AS speed FROM g WINDOW w AS (PARTITION BY job_id ORDER BY ts_ms)""")
def progress_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress sampled once a day, events being further apart than the 400 ms of a live job."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ts_ms"), "event_id")
    run = F.sum(F.col("event_id") % 100).over(Window.partitionBy("job_id").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    samples = rows.withColumn("bytes", run).withColumn("total", F.lit(1_000_000))
    return views.throughput(views.sampled(samples.select("job_id", "ts_ms", "bytes", "total"), 86_400_000)).select("job_id", "ts_ms", F.round("speed", 6).alias("speed"))


@query("SELECT count(*) FILTER (event_id % 3 <> 0) AS shredded, count(*) FILTER (event_id % 3 = 0) AS failed FROM events")
def shred_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.shred_summary(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), (F.col("event_id") % 3 != 0).alias("ok")))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def ledger_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "Scan").when(F.col("event_type") == "click", "WipeDrive").when(F.col("event_type") == "purchase", "WipeFile").otherwise("Other")
    return ledger.of_kind(table(spark, sf_dir, "events").select("event_id", "event_type", kind.alias("operation")), "Wipe").select("event_id", "event_type")


@query(f"""{_CHAIN}, v AS (SELECT CAST(count(*) AS BIGINT) AS s, CAST(count(*) FILTER (event_id % 10 = 0) AS BIGINT) AS m FROM events)
SELECT ledger, count(*) AS n_entries, 'INTACT' AS chain_status, sha256(string_agg(entry_hash, chr(10) ORDER BY i)) AS log_hash, any_value(s) AS sectors_checked, any_value(m) AS mismatches, CASE WHEN any_value(m) = 0 THEN 'PASSED' ELSE 'FAILED' END AS result FROM c, v GROUP BY 1""")
def certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger.chain(_ledger_events(spark, sf_dir)).withColumn("line_no", F.col("index"))
    return ledger.certificate(entries, _verified(spark, sf_dir)).drop("max_entropy")


@query("""WITH a AS (SELECT user_id % 3 AS session_id, CAST(event_id % 500 AS VARCHAR) AS id, event_id FROM events), n AS (SELECT DISTINCT id FROM a WHERE CAST(id AS INTEGER) % 7 = 0), s AS (SELECT a.* FROM a JOIN n USING (id))
SELECT CAST(session_id AS VARCHAR) AS session_id, id, event_id FROM s WHERE session_id = 1 OR id NOT IN (SELECT id FROM s WHERE session_id = 1)""")
def session_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("string").alias("session_id"), (F.col("event_id") % 500).cast("string").alias("id"), "event_id")
    return ledger.selected(rows, rows.where(F.col("id").cast("int") % 7 == 0).select("id"), "1").select("session_id", "id", "event_id")


@query("SELECT * FROM (VALUES ('sda1', '/dev/sda1', CAST(524288000 AS BIGINT), 'MBR'), ('nvme0n1p2', '/dev/nvme0n1p2', CAST(4096000000000 AS BIGINT), 'GPT')) AS t(name, path, size_bytes, scheme)")
def block_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ["major minor  #blocks  name", "", "   8        0  976762584 sda", "   8        1     512000 sda1", " 259        2 4000000000 nvme0n1p2", "   8        3 12"]
    return views.block_devices(spark.createDataFrame([(x,) for x in lines], "line string"))


@query("SELECT * FROM (VALUES ('Clear', 'nist_clear', 1), ('Random', 'random', 1), ('DoD', 'dod3', 3), ('Gutmann7', 'gutmann7', 7), ('Purge', 'nist_purge', 2)) AS t(standard, id, passes)")
def wipe_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.wipe_standards(spark).select("standard", "id", "passes")


@query("SELECT standard, CASE standard WHEN 'Clear' THEN 'Zero' ELSE 'Random' END AS expected FROM (VALUES ('Clear'), ('Random'), ('DoD'), ('Gutmann7'), ('Purge')) AS t(standard)")
def wipe_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.wipe_standards(spark).select("standard", sanitize.expected_last(F.col("standard")).alias("expected"))


@query("SELECT standard, pass, CASE pattern WHEN 'R' THEN NULL ELSE repeat(pattern, 512) END AS hex, CAST(512 AS INTEGER) AS size FROM (VALUES ('DoD', 1, '00'), ('DoD', 2, 'FF'), ('DoD', 3, 'R')) AS t(standard, pass, pattern)")
def pass_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitize.wipe_plan(spark).where("standard = 'DoD'").withColumn("block", sanitize.block_pattern(F.col("pattern"), 512, F.col("pass")))
    return rows.select("standard", "pass", F.when(F.col("pattern") != "R", F.hex("block")).alias("hex"), F.length("block").alias("size"))


@query("SELECT 6 AS planted_files, 6 AS carved_files, 4096 AS sectors_checked, 0 AS sector_mismatches, 0 AS post_wipe_carved, true AS passed")
def adversarial_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image with planted files is carved, wiped and carved again."""
    return _trial(spark).select(*[F.col(c).cast("int") for c in ("planted_files", "carved_files", "sectors_checked", "sector_mismatches", "post_wipe_carved")], "passed")


@query("SELECT * FROM (VALUES (1, 'success'), (2, 'success'), (3, 'success'), (4, 'success'), (5, 'success')) AS t(phase, status)")
def trial_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.trial_phases(_trial(spark)).select("phase", "status")


def _trial(spark: SparkSession) -> DataFrame:
    image = fixtures.planted_image()
    before = fixtures.as_chunks(spark, image, 64 * 1024, LOOKAHEAD)
    wiped = fixtures.as_chunks(spark, bytes(len(image)), 64 * 1024, LOOKAHEAD)
    sectors = wiped.select("image_id", F.col("chunk_start").alias("at"), "owned_len", "data").select("image_id", F.explode(F.sequence(F.lit(0), F.col("owned_len") - 512, F.lit(512))).alias("o"), "at", "data")
    sectors = sectors.select("image_id", ((F.col("at") + F.col("o")) / 512).cast("long").alias("lba"), F.substring("data", F.col("o") + 1, F.lit(512)).alias("data"))
    carved = C.carve(C.windows(scan(before, ["jpg", "ico", "png", "pdf", "elf"]), before))
    return sanitize.adversarial_summary(6, carved, sanitize.wipe_verify(sectors, "Zero"), scan(wiped))


@query("SELECT * FROM (VALUES (0, 'classified_report.txt', 1200)) AS t(record_number, filename, lba)")
def mft_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mft.first_seen(mft.scan_records(fixtures.as_chunks(spark, fixtures.planted_image(), 100_000, LOOKAHEAD), 500))
    return found.select(F.col("record_number").cast("int").alias("record_number"), "filename", (F.col("record_offset") / 512).cast("int").alias("lba"))


@query("SELECT 'zip' AS extension, 12288 AS size, true AS reconstructed, 2 AS fragment_count, 8192 AS frag_offset, 4096 AS gap_bytes, 'High (Bi-Fragment Stitched)' AS confidence_label")
def reassembled_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive's head, a gap of zeros and its tail."""
    head, tail = fixtures.split_archive()
    artifact = C.carve(spark.createDataFrame([("i", 0, 13, bytearray(head))], "image_id string, offset long, sig_idx int, window binary"), ["zip"])
    cut = spark.createDataFrame([("i", 0, "zip", "Archive", len(head), bytearray(head), True, 0.85, "High")], "image_id string, offset long, extension string, category string, size long, payload binary, truncated boolean, confidence float, confidence_label string")
    whole = fragment.reassemble(cut.withColumn("sha256", F.sha2("payload", 256)), spark.createDataFrame([("i", 0, bytearray(bytes(4096) + tail + bytes(4096)))], "image_id string, offset long, follows binary"))
    return whole.join(artifact.select("offset"), "offset", "left_anti").select("extension", F.col("size").cast("int").alias("size"), "reconstructed", F.col("fragment_count").cast("int").alias("fragment_count"), F.col("frag_offset").cast("int").alias("frag_offset"), F.col("gap_bytes").cast("int").alias("gap_bytes"), "confidence_label")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which artifacts lie in the pages, where, of which type, and how sure that is."""
    return carve_artifacts(spark, sf_dir)
