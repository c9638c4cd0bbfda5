"""Queries against their SQL on the smallest tables, and operators on exact fixtures."""

import hashlib
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bytelode.functions import binary as B
from bytelode.functions.catalog import rules, rules_frame
from bytelode.functions.keccak import keccak256, keccak256_batch
from bytelode.operators import carve as C
from bytelode.operators import anchor, classify, imager, ledger, mft, sanitize, views
from bytelode.operators.scan import LOOKAHEAD, header_ok, scan, virtual_layout
from bytelode.plans import fixtures
from bytelode.queries import ORACLES, QUERIES
from bytelode.sources.rawimage import RawImage, normalise_path, read_image
from bytelode.streaming.carving import ledger_sink, stream_hits
from bytelode.streaming.progress import ProgressLog, cancellable, observed

TABLES = "customer documents events labels lineitem orders pages".split()
ROWS = 1_200_000


@pytest.fixture(scope="session")
def con(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, data, name):
    got, want = QUERIES[name](spark, data), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_catalog():
    every = rules()
    assert len(every) == 134 and len({r.extension for r in every}) == 109 and [r.number for r in every] == list(range(134))
    assert {r.extension for r in rules(["png", "zip"])} == {"png", "zip"} and len(rules([])) == 134


def test_hits_do_not_depend_on_chunks(spark):
    image = fixtures.planted_image(random.Random(5).randbytes(2 << 20))
    sets = [{(r["offset"], r["sig_idx"]) for r in scan(fixtures.as_chunks(spark, image, size, LOOKAHEAD)).collect()} for size in (65_536, 100_000, 2 << 20)]
    assert sets[0] == sets[1] == sets[2]
    assert {5120, 51200, 102400, 256000, 409600} <= {o for o, _ in sets[0]}
    assert scan(fixtures.as_chunks(spark, bytes(4096), 4096, 0)).count() == 0


def test_raw_image_source(spark, tmp_path):
    image = fixtures.planted_image()
    (tmp_path / "a.img").write_bytes(image)
    chunks = read_image(spark, str(tmp_path / "*.img"), 300_000)
    hits = scan(chunks).join(F.broadcast(rules_frame(spark)), "sig_idx")
    assert {(r["offset"], r["extension"]) for r in hits.collect()} >= {(5120, "jpg"), (51200, "png"), (102400, "pdf")}
    cut = {r["extension"]: r for r in C.carve(C.windows(scan(chunks, ["png", "sqlite"]), chunks)).collect()}
    assert cut["png"]["size"] == len(fixtures.png()) and cut["png"]["sha256"] == hashlib.sha256(fixtures.png()).hexdigest()
    assert ("Width", "1") in [tuple(x) for x in cut["png"]["metadata"]] and ("Tables", "secret_evidence") in [tuple(x) for x in cut["sqlite"]["metadata"]]


def test_validators():
    png = fixtures.png()
    ok = {"jpeg": fixtures.JPEG, "png": png, "pdf": fixtures.PDF, "zip": b"PK\3\4" + bytes(20) + b"PK\5\6" + bytes(18), "elf": b"\x7fELF\2\1" + bytes(58), "wav": b"RIFF\0\0\0\0WAVE",
          "mp4": b"\0\0\0\x18ftypisom", "json": b'{"a": 1}', "jwt": b"eyJa.b.c rest", "pem": b"-----BEGIN A-----\nxxxx\n-----END A-----", "aws_key": b"AKIA" + b"A" * 16,
          "github_pat": b"ghp_" + b"a" * 36, "eth_keystore": b'{"crypto": {"ciphertext": "x", "cipher": "y"}}', "pe": b"MZ".ljust(60, b"\0") + b"\x40\0\0\0PE\0\0",
          "bmp": b"BM" + (60).to_bytes(4, "little") + bytes(8) + (40).to_bytes(4, "little") + bytes(42)}
    for name, data in ok.items():
        assert C.valid(name, data), name
        assert not C.valid(name, b"\0" + data) and not C.valid(name, b""), name
    assert not C.valid(None, png) and not C.valid("jpeg", fixtures.JPEG[:-2]) and not C.valid("elf", b"\x7fELF\3\1") and not C.valid("mp3", b"\xff\xfb\0\0") and not C.valid("aac", bytes(9))


def test_boundaries():
    assert C.png_end(fixtures.png() + b"zzz") == len(fixtures.png()) and C.jpeg_end(fixtures.JPEG + b"zz") == 22
    assert C.zip_end(b"PK\3\4PK\5\6" + bytes(16) + b"\2\0abTAIL") == 28 and C.pdf_end(b"%PDF-1 %%EOF\r\n x") == 15
    assert C.slack_start(b"abc" + bytes(100)) == 70 and C.slack_start(b"abc") is None
    assert header_ok("wav", b"RIFF\0\0\0\0WAVE") and not header_ok("webp", b"RIFF\0\0\0\0WAVE") and not header_ok("json", b'{"ab" 12')


def test_sqlite_metadata():
    assert ("Freelist Pages", "2 pages (Recoverable Deleted Rows)") in classify.metadata("sqlite", fixtures.sqlite())
    assert classify.metadata("sqlite", b"short") == [] and classify.metadata("unknown", b"") == []


def test_records():
    times = (1, 2, 3, 4)
    clean = mft.parse_record(fixtures.file_record("ä.txt", times, times, b"hello\1"))
    assert clean["filename"] == "ä.txt" and clean["resident_preview"] == "hello." and clean["file_size"] == 6 and clean["is_in_use"] and clean["si"]["accessed"] == 4
    runs = bytes([0x11, 2, 5, 0x01, 1, 0x11, 1, 0xFE, 0])
    record = fixtures.file_record("r", times, times, None, runs=runs, real=14_000)
    body = mft.extract(record, lambda o, n: bytes([o // 4096]) * n)
    assert body == (b"\5" * 8192 + bytes(4096) + b"\3" * 4096)[:14_000]
    for bad in (b"", b"FILE", b"FILE" + bytes(1020), record[:56] + bytes([16, 0, 0, 0, 0, 0, 0, 0]) + record[64:]):
        mft.parse_record(bad)


def test_statistics(spark):
    rows = spark.createDataFrame([(0, bytearray(1024)), (1, bytearray(bytes(range(256)) * 10)), (2, bytearray()), (3, bytearray(random.Random(1).randbytes(16384)))], "id int, d binary")
    got = rows.withColumn("c", B.byte_counts("d")).select("id", B.entropy(F.col("d")).alias("h"), B.entropy_of_counts(F.col("c")).alias("n"), B.chi_square(F.col("c")).alias("x"), F.length("d").alias("l"))
    got = got.withColumn("label", B.randomness_label(F.col("h"), F.col("x"), F.col("l"))).orderBy("id").collect()
    assert [round(r["h"], 9) for r in got[:3]] == [0, 8, 0] and all(abs(r["h"] - r["n"]) < 1e-9 for r in got) and got[3]["label"] == "Uniform random"
    tiers = spark.sql("select stack(4, 0.85f, 0.6f, 0.4f, 0.39f) as s").select(B.tier(F.col("s"))).collect()
    assert [r[0] for r in tiers] == ["High", "Medium", "Low", "Fragment"]
    paths = spark.createDataFrame([(" E: ",), ("/a",)], "p string").select(normalise_path(F.col("p"))).collect()
    assert [r[0] for r in paths] == ["\\\\.\\E:", "/a"]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 11])
def test_merkle(spark, n):
    level = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    leaves = spark.createDataFrame(list(enumerate(level)), "pos long, hash string")
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
    assert ledger.merkle_root(leaves) == (level[0] if level else "0" * 64)


def test_wipe_verify(spark):
    dirty = bytearray(512)
    dirty[7] = 1
    rows = spark.createDataFrame([("a", 0, bytearray(512)), ("a", 1, dirty), ("a", 2, bytearray(100)), ("b", 5, bytearray(512))], "image_id string, lba long, data binary")
    got = {r["image_id"]: r for r in sanitize.wipe_verify(rows, "Zero").collect()}
    assert (got["a"]["sectors_checked"], got["a"]["mismatches"], got["a"]["first_bad"], got["a"]["passed"]) == (2, 1, 1, False) and got["b"]["passed"]
    got = {r["image_id"]: r for r in sanitize.wipe_verify(rows, "Random").collect()}
    assert got["a"]["passed"] and got["b"]["mismatches"] == 1


def test_streams_equal_batches(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    hits = stream_hits(spark, str(tmp_path / "in"), "page_id long, url string, html string", "page_id", "html", ["html"], files_a_batch=1)
    q = hits.writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    batch = QUERIES["magic_scan_html"](spark, data)
    assert sorted(map(tuple, spark.table("hits").collect())) == sorted(map(tuple, batch.collect()))
    events = spark.range(9).select(F.col("id").alias("index"), F.col("id").cast("string").alias("timestamp"), F.lit("Scan").alias("operation"), F.lit("a@b").alias("operator"), F.lit("{}").alias("detail"))
    sink, path = ledger_sink(str(tmp_path / "ledger")), str(tmp_path / "ledger")
    sink(events.where("index < 4"), 0)
    sink(events.where("index < 4"), 0)
    sink(events, 1)
    entries = spark.read.parquet(path).withColumn("ledger", F.lit(1)).withColumn("line_no", F.col("index"))
    got = ledger.verify_chain(entries).first()
    assert (got["n_entries"], got["valid"], got["first_bad"]) == (9, True, None)
    assert os.path.isdir(path)


def test_keccak(spark):
    known = {
        b"": "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470",
        b"abc": "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45",
        anchor.DOMAIN_TYPE: "8b73c3c69bb8fe3d512ecc4cf759cc79239f7b179b0ffacaa9a75d522b39400f",
    }
    assert [d.hex() for d in keccak256_batch(list(known))] == list(known.values())
    messages = [random.Random(n).randbytes(n) for n in (0, 1, 135, 136, 137, 271, 272, 273, 5000)]
    assert keccak256_batch(messages) == [keccak256_batch([m])[0] for m in messages]
    rows = spark.createDataFrame([(0, None), (1, bytearray())], "id int, data binary")
    assert [r[0] and r[0].hex() for r in rows.orderBy("id").select(keccak256("data")).collect()] == [None, known[b""]]


def test_anchor(spark):
    domain = anchor.Domain("ledger", "1", 137, "11" * 20)
    rows = [("ab" * 32, 3, 1_700_000_000, "a@b", "ed25519:" + "cd" * 64), ("short", 0, 0, "", None)]
    got = anchor.anchor(spark.createDataFrame(rows, "merkle_root string, records long, timestamp long, officer string, signature string"), domain).collect()
    for (root, records, at, officer, signature), r in zip(rows, got, strict=True):
        one = lambda m: keccak256_batch([m])[0]
        root = root if len(root) == 64 else "0" * 64
        sig = (signature or "").removeprefix("ed25519:")
        inner = one(one(anchor.ANCHOR_TYPE) + bytes.fromhex(root) + records.to_bytes(32, "big") + at.to_bytes(32, "big") + one(officer.encode()))
        digest = one(b"\x19\x01" + domain.separator() + inner)
        assert r["digest"] == "0x" + digest.hex() and r["tx_hash"] == "0x" + one(digest + sig.encode()).hex()
        assert r["call_data"] == f"0x{anchor.SELECTOR}{root}{records:064x}{0x60:064x}{len(sig) // 2:064x}{sig}"


def test_imager(spark, tmp_path):
    good = bytes(range(256)) * 2
    reads = [("a", 0, 0, good), ("a", 1, 0, None), ("a", 1, 1, good[:100]), ("a", 1, 2, good), ("a", 2, 0, None), ("a", 2, 1, None), ("a", 2, 2, None), ("a", 2, 3, good), ("b", 0, 0, good)]
    sectors = imager.image_sectors(spark.createDataFrame(reads, "image_id string, lba long, attempt int, data binary"))
    assert {(r["image_id"], r["lba"], bytes(r["data"]), r["retries"], r["bad"]) for r in sectors.collect()} == {("a", 0, good, 0, False), ("a", 1, good, 2, False), ("a", 2, bytes(512), 2, True), ("b", 0, good, 0, False)}
    imager.write_fault_map(sectors, f"{tmp_path}/map")
    assert [tuple(r) for r in spark.read.text(f"{tmp_path}/map").select("value", "image_id").collect()] == [("2, 1, BAD_SECTOR_ZERO_FILLED", "a")]
    assert imager.image_result(sectors.limit(0)).count() == 0


def test_progress(spark, tmp_path):
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        spark.range(10).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        stream.awaitTermination()
        for _ in range(100):
            events = log.frame(spark).where(F.col("job_id") == stream.id)
            if events.where("event = 'complete'").count():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert events.agg(F.sum("rows")).first()[0] == 10 and {"started", "progress", "complete"} <= {r["event"] for r in events.collect()}
    frame, seen = observed(spark.range(7).select(F.lit("ab").alias("t")), "seen", "t")
    with cancellable(spark, "job-7"):
        frame.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 7, "bytes": 14}


def test_layout_with_a_payload(spark):
    files = spark.range(0, ROWS, 1, 6).select((F.lit(ROWS) - F.col("id")).alias("file"), (F.col("id") % 1500).alias("size"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("payload"))
    laid = virtual_layout(files, "file", "size").withColumn("sectors", F.ceil(F.col("size") / 512) * 512)
    ends = laid.select("file", "start", (F.lag(F.col("start") + F.col("sectors"), 1, 0).over(Window.orderBy("file"))).alias("end"))
    assert ends.where("start <> end").count() == 0 and laid.count() == ROWS


def test_growing_image_stream(spark, tmp_path):
    path, png = tmp_path / "live.img", fixtures.png()
    path.write_bytes(bytes(600) + png[:4])
    spark.dataSource.register(RawImage)
    hits = scan(spark.readStream.format("rawimage").option("path", str(path)).option("chunk", 500).load(), ["png"])
    q = hits.writeStream.format("memory").queryName("live").start()
    q.processAllAvailable()
    with open(path, "ab") as f:
        f.write(png[4:] + bytes(LOOKAHEAD))
    q.processAllAvailable()
    with open(path, "ab") as f:
        f.write(png)
    (tmp_path / "live.img.closed").touch()
    q.processAllAvailable()
    q.stop()
    want = [600, 600 + len(png) + LOOKAHEAD]
    assert sorted(r["offset"] for r in spark.table("live").collect()) == want
    assert sorted(r["offset"] for r in scan(read_image(spark, str(path), 500), ["png"]).collect()) == want


def test_carving_and_records_from_files(spark, tmp_path):
    times = (132_000_000_000_000_000,) * 4
    body = random.Random(3).randbytes(9000)
    runs = bytes([0x11, 2, 20, 0x01, 1, 0x11, 1, 10, 0])
    image = bytearray(fixtures.planted_image(bytes(2 << 20)))
    image[20 * 4096 : 20 * 4096 + 8192], image[30 * 4096 : 30 * 4096 + 808] = body[:8192], body[8192:]
    image[700 * 512 : 702 * 512] = fixtures.file_record("a b/ä.bin", times, times, None, runs=runs, real=8192 + 4096 + 808)
    (tmp_path / "disk.img").write_bytes(image)
    path = str(tmp_path / "*.img")
    chunks = read_image(spark, path, 300_000)
    hits = scan(chunks, ["png", "pdf"])
    by_range, by_chunk = (C.carve(w, ["png", "pdf"]) for w in (C.file_windows(hits, path, ["png", "pdf"]), C.windows(hits, chunks)))
    assert sorted(by_range.select("offset", "sha256").collect()) == sorted(by_chunk.select("offset", "sha256").collect()) != []
    C.write_artifacts(by_range, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("category = 'Image'").count() == 1
    sent = ledger.exported(by_range, "/case/7")
    assert ledger.export_custody(by_range.select(F.col("id").alias("file_id"), F.lit("t").alias("extracted_at"), F.col("offset").alias("source_offset"), F.col("sha256").alias("sha256_at_extract")), sent).where("matches").count() == 2
    got = {r["name"]: r["payload"] for r in mft.extract_records(chunks, path).collect()}
    assert bytes(got["a_b_ä.bin"]) == body[:8192] + bytes(4096) + body[8192:] and bytes(got["classified_report.txt"]) == b"top secret body"
    assert mft.scan_records(chunks, 1).count() == 1 and mft.scan_records(chunks).count() == 2
    assert mft.extract(b"FILE" + bytes(4), None) is None and len(mft.extract(fixtures.file_record("s", times, times, None, runs=bytes([0x04, 0xFF, 0xFF, 0xFF, 0x7F, 0]), real=100), None)) == 100


def test_ledger_files_and_reports(spark, data, tmp_path):
    entries = ledger.chain(spark.createDataFrame([("l", k, str(k), "Scan", "a@b", '{"k":1}') for k in range(3)], "ledger string, index long, timestamp string, operation string, operator string, detail string"))
    lines = entries.select(F.to_json(F.struct("index", "timestamp", "operation", "operator", "prev_hash", "entry_hash", F.from_json("detail", "k int").alias("detail"))).alias("value")).orderBy("value")
    lines.unionByName(spark.createDataFrame([("",), ("{not json",)], "value string")).coalesce(1).write.text(f"{tmp_path}/log")
    back = ledger.read_ledger(spark, f"{tmp_path}/log").withColumn("ledger", F.lit("l")).withColumn("line_no", F.col("index"))
    assert ledger.verify_chain(back).first()["valid"] and '"valid":true' in ledger.report(back, "case 7").first()["report"]


def test_views_of_one(spark):
    rows = spark.createDataFrame([("s2", "a", 1), ("s1", "a", 2), ("s1", "b", 3)], "session_id string, id string, n int")
    assert [r["n"] for r in views.artifact(rows, "a").collect()] == [2] and views.artifact(rows, "z").count() == 0
