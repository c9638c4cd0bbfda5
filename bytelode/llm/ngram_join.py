"""N-gram Jaccard join: MinHash banding, shuffle on band hashes, verification on full n-gram sets, in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelode.llm.common import Scratch, components, mix64, read_table, runs, shingles, text_key, texts_of, unused

THRESHOLD = 0.8
WORDS = 5
ROWS = 8
RECALL = 0.9995
#: Documents, and n-grams, of a block's side; larger candidate groups are compared block by block.
BLOCK_DOCS = 256
BLOCK_GRAMS = 200_000
#: Candidate groups of up to so many texts are compared whole; larger ones by band bucket, so that chance chains cost what their buckets do.
WHOLE_GROUP = 8192


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands of so many rows that a pair at the threshold shares one with at least the target probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band: of the minima of `rows` multiply-add hashes (mod 2^32, taken from the upper bits) of the set."""
    n = bands * rows
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    times, plus = (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)
    x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    buffer = np.empty((64, min(len(x), 1024)), dtype=np.uint32)
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        for k in range(0, n, 64):
            out = buffer[: min(64, n - k), : len(part)]
            np.multiply(part[None, :], times[k : k + 64, None], out=out)
            np.add(out, plus[k : k + 64, None], out=out)
            np.bitwise_xor(out, out >> np.uint32(15), out=out)
            np.minimum(least[k : k + 64], out.min(axis=1), out=least[k : k + 64])
    rows_ = least.reshape(bands, rows).astype(np.uint64)
    code = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + rows_[:, r] + np.uint64(1))
    return code.view(np.int64)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of sets with Jaccard similarity of at least the threshold; with one list, i < j.

    Intersections are counted exactly: sets as rows of a 0/1 matrix over the n-grams that two or more of them hold, multiplied
    a slice of columns at a time."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate(([True], grams[1:] != grams[:-1])) if len(grams) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    many = np.bincount(column)[column] > 1 if len(grams) else np.empty(0, bool)
    column, owner = column[many], owner[many]
    if len(column):
        column = np.cumsum(np.concatenate(([0], np.diff(column) > 0)))
    a, b = len(left), len(right) if right is not None else len(left)
    common = np.zeros((a, b), dtype=np.float64)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for k in range(len(edges) - 1):
        lo, hi = edges[k], edges[k + 1]
        if lo == hi:
            continue
        m = np.zeros((len(sets), width), dtype=np.float32)
        m[owner[lo:hi], column[lo:hi] - k * width] = 1
        common += m[:a] @ (m[a:] if right is not None else m).T
    na, nb = sizes[:a, None], (sizes[a:] if right is not None else sizes)[None, :]
    union = na + nb - common
    good = (common >= threshold * union - 1e-9) & (union > 0)
    if right is None:
        good &= np.triu(np.ones_like(good), 1).astype(bool)
    return np.nonzero(good)


def forest(ids: list[int], i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that span the same groups as all the pairs do: fewer than there are documents."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = ids[a], ids[b]
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((min(a, b), max(a, b)))
    return out


#: Rows without a doc_id stand under numbers from here up.
NO_ID = 1 << 62
#: Classes in candidate groups that are sent to all tasks to pick their texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _signer(bands: int, rows: int, words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in texts_of(batch)]
            codes = np.concatenate([band_hashes(s, bands, rows) for s in sets]) if sets else np.empty(0, np.int64)
            offsets = pa.array(np.arange(0, len(codes) + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(codes))],
                names=["id", "key_a", "key_b", "has_id", "grams", "bands"],
            )

    return sign


def _verifier(threshold: float, words: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, others, counts = [], [], []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(counts, pa.int64())], names=["id", "other", "n"])
            for x in (ids, others, counts):
                x.clear()
            return batch

        for (_, band, _, i, j), rows in runs(batches, ["component", "band", "code", "i", "j"]):
            left = [r for r in rows if r["chunk"] == i]
            right = [r for r in rows if r["chunk"] == j] if i != j else None
            sets = [[shingles(r["text"].encode(), words) for r in side] for side in (left, right or [])]
            x, y = linked_pairs(sets[0], sets[1] if right is not None else None, threshold)
            every = left + (right or [])
            shift = len(left) if right is not None else 0
            y = y + shift
            if band > 0 and len(x):  # a pair counts in the first band that it shares
                codes = np.array([r["bands"][:band] for r in every], dtype=np.int64)
                first = np.concatenate([~(codes[x[k : k + 10_000]] == codes[y[k : k + 10_000]]).any(axis=1) for k in range(0, len(x), 10_000)])
                x, y = x[first], y[first]
            if not len(x):
                continue
            weight = np.array([r["n_copies"] for r in every], dtype=np.int64)
            n = np.zeros(len(every), dtype=np.int64)
            np.add.at(n, x, weight[y])
            np.add.at(n, y, weight[x])
            names = [r["node"] for r in every]
            for k in np.flatnonzero(n).tolist():
                ids.append(names[k])
                others.append(None)
                counts.append(int(n[k]))
            for a, b in forest(names, x, y):
                ids.append(a)
                others.append(b)
                counts.append(None)
            if len(ids) > 20_000:
                yield out()
        yield out()

    return verify


def _own_id(text: Column) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """Links between texts whose sets of word n-grams have a Jaccard similarity of at least the threshold.

    Returns one row for each row of docs(doc_id, text): doc_id, class_id (least doc_id reachable by links and copies), n_links (other
    rows linked directly, copies included), copy_id (least doc_id with the same text), n_copies (rows with the same text), kept (whether
    the text is the one that stands for its class: that of class_id; of several texts under that doc_id the one with the least hash;
    equal rows are kept alike).

    Words are runs of characters other than \\x20 and \\x09-\\x0D. A text of 1 to n-1 words has one n-gram, of all its words. Texts
    without words, null ones too, link with nothing: each is a class of its own, with 0 links. Rows with a null doc_id come back with
    it; where only such rows are of a class, class_id and copy_id are a number of at least 2^62 made from a text. Texts are told apart by
    their own hashes, so rows may share a doc_id. An empty table gives an empty result. Further columns are ignored.

    Copies are set aside first (a hash aggregate, so a hot text is one row a task). Band hashes of the distinct texts are counted, and
    those that two texts share are joined, each text to the least of its bucket: a star, never all pairs. Stars chain into
    candidate groups. Groups of up to WHOLE_GROUP texts are compared whole; in larger ones, which chance may have chained, texts are
    compared within each bucket, and a pair counts in its first shared band. Both go in blocks of bounded size, with exact intersections.
    """
    return _linked(docs, threshold, words, rows, recall).select(F.when(F.col("has_id"), F.col("id")).alias("doc_id"), F.col("group").alias("class_id"), "n_links", "copy_id", "n_copies", "kept")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """The rows of docs that stand for their class in jaccard_join, with all their columns; of equal rows (doc_id and text) one."""
    names = unused(docs.columns, "_id", "_a", "_b")
    kept = _linked(docs, threshold, words, rows, recall).where("kept").select(F.col("id").alias(names[0]), F.col("key_a").alias(names[1]), F.col("key_b").alias(names[2]))
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [k.alias(n) for k, n in zip(text_key(text), names[1:], strict=True)]
    out = docs.select("*", _own_id(text).alias(names[0]), *keys).join(kept.distinct(), names, "left_semi")
    if kept.groupBy(*names).count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(names)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _linked(docs: DataFrame, threshold: float, words: int, rows: int, recall: float) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    bands = bands_for(threshold, rows, recall)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = _own_id(text)
    keyed = docs.select(own.alias("id"), *text_key(text), text.alias("text"), F.col("doc_id").isNotNull().alias("has_id"))
    signed = scratch.save(keyed.mapInArrow(_signer(bands, rows, words), "id long, key_a long, key_b long, has_id boolean, grams long, bands array<long>"), "signed")
    worded = signed.where("grams > 0")
    # A class is a distinct text; its number is fixed when the table is written.
    classes = worded.groupBy("key_a", "key_b").agg(F.min("id").alias("copy_id"), F.count("*").alias("n_copies"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    whose = ["copy_id", "key_a", "key_b"]
    # The class's row of the least id; rows that repeat it are the same.
    first = worded.withColumnRenamed("id", "copy_id").join(classes.select("node", *whose), whose)
    first = scratch.save(first.select("node", "grams", "bands"), "banded")
    codes = first.select("node", "grams", F.posexplode("bands").alias("band", "code"))
    shared = codes.groupBy("band", "code").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    shared = scratch.save(shared.select("band", "code", "least"), "shared")
    stars = scratch.save(codes.join(shared, ["band", "code"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "stars")
    # A text meets the least of up to `bands` buckets: it keeps an edge to the least of those, and they get one to it, mostly the same few.
    met = stars.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    edges = met.select("a", F.col("m").alias("b")).unionByName(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
    groups = components(spark, edges, scratch, "candidates")
    chunks = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("chunks")
    members = scratch.save(first.join(groups, "node").dropDuplicates(["node"]).join(classes, "node"), "members")
    sizes = scratch.save(members.groupBy("component").agg(F.count("*").alias("texts"), chunks), "sizes")
    buckets = members.join(F.broadcast(sizes.where(F.col("texts") > WHOLE_GROUP).select("component")), "component")  # texts / WHOLE_GROUP rows at most
    buckets = buckets.select("node", "component", "grams", "bands", "n_copies", *whose, F.posexplode("bands").alias("band", "code")).join(shared.select("band", "code"), ["band", "code"])
    bucket_sizes = scratch.save(buckets.groupBy("component", "band", "code").agg(chunks), "bucket-sizes")
    own_columns = ["node", "component", "band", "code", "n_copies", "chunks", "bands", *whose]
    none = F.array().cast("array<long>")
    small = members.join(sizes.where(F.col("texts") <= WHOLE_GROUP).select("component", "chunks"), "component").withColumns({"band": F.lit(0), "code": F.lit(0).cast("long"), "bands": none})
    large = buckets.join(bucket_sizes, ["component", "band", "code"])
    wanted = scratch.save(
        small.select(*own_columns).unionByName(large.select(*own_columns)).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "wanted"
    )
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = keyed.withColumnRenamed("id", "copy_id").join(F.broadcast(wanted) if few else wanted, whose)
    # Equal rows (one doc_id, one text) would stand twice in a block: one of them is taken there.
    blocks = texts.dropDuplicates(["node", "band", "code"])
    blocks = blocks.select("component", "band", "code", "chunk", "node", "n_copies", "bands", "text", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("to"))
    blocks = blocks.select("component", "band", "code", F.least("chunk", "to").alias("i"), F.greatest("chunk", "to").alias("j"), "chunk", "node", "n_copies", "bands", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = ["component", "band", "code", "i", "j"]
    dealt = blocks.repartition(tasks, *group).sortWithinPartitions(*group, "node")
    found = scratch.save(dealt.mapInArrow(_verifier(threshold, words), "id long, other long, n long"), "found")
    scratch.drop("banded", "shared", "stars", "wanted", "members")
    linked = components(spark, found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch, "links")
    n_links = found.where("n is not null").groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
    named = scratch.save(classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    heads = named.groupBy("component").agg(F.min(F.struct(*whose)).alias("head"))
    table = scratch.save(
        named.join(n_links, "node", "left").join(heads, "component")
        .select("key_a", "key_b", "n_copies", "copy_id", (F.coalesce("n", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), F.col("head.copy_id").alias("group"), (F.struct(*whose) == F.col("head")).alias("heads")), "table"
    )
    every = signed.select("id", "key_a", "key_b", "has_id", "grams")
    out = every.where("grams > 0").join(table, ["key_a", "key_b"]).select("id", "has_id", "key_a", "key_b", "group", "n_links", "copy_id", "n_copies", (F.col("heads") & (F.col("id") == F.col("copy_id"))).alias("kept"))
    blank = every.where("grams = 0").select("id", "has_id", "key_a", "key_b", F.col("id").alias("group"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("kept"))
    return out.unionByName(blank)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))
