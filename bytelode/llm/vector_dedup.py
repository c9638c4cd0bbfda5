"""Embedding near-dedup: a forest of random-projection trees with spill overlap, exact comparison within leaves, union of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm.common import Scratch, components, read_table, runs

THRESHOLD = 0.9
#: Trees are fitted on so many vectors at most (the ones with the least hash); every vector is then put through them.
SAMPLE = 20_000
TREES = 8
LEAF = 1024
#: Share of a node's vectors on either side of the median that go to both children.
SPILL = 0.04
#: Vectors on a side of a block; a leaf with more is compared block by block.
BLOCK = 1024


class Forest:
    """Trees as arrays: child nodes 2k+1 and 2k+2 of node k, a direction and two thresholds for each split node."""

    def __init__(self, sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 7):
        self.trees: list[dict[int, tuple[np.ndarray, float, float]]] = []
        rng = np.random.default_rng(seed)
        scale = max(1.0, total / max(1, len(sample)))
        for _ in range(trees):
            splits: dict[int, tuple[np.ndarray, float, float]] = {}
            todo = [(0, np.arange(len(sample)), 0)]
            while todo:
                node, rows, depth = todo.pop()
                if len(rows) * scale <= leaf or len(rows) < 16 or depth >= 48:
                    continue
                way = rng.standard_normal(sample.shape[1])
                x = sample[rows] @ way
                low, high = np.quantile(x, [0.5 - spill, 0.5 + spill])
                if low >= high:
                    continue
                splits[node] = (way, float(low), float(high))
                left, right = rows[x <= high], rows[x >= low]
                if len(left) == len(rows) or len(right) == len(rows):
                    del splits[node]
                    continue
                todo += [(2 * node + 1, left, depth + 1), (2 * node + 2, right, depth + 1)]
            self.trees.append(splits)

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf number) for all rows and trees, sorted by row, then leaf. Leaf numbers hold the tree in the upper bits."""
        out_rows, out_leaves = [], []
        for t, splits in enumerate(self.trees):
            todo = [(0, np.arange(len(vectors)))]
            while todo:
                node, rows = todo.pop()
                if not len(rows):
                    continue
                if node not in splits:
                    out_rows.append(rows)
                    out_leaves.append(np.full(len(rows), (t << 50) | node, dtype=np.int64))
                    continue
                way, low, high = splits[node]
                x = vectors[rows] @ way
                todo += [(2 * node + 1, rows[x <= high]), (2 * node + 2, rows[x >= low])]
        rows, leaves = np.concatenate(out_rows), np.concatenate(out_leaves)
        order = np.lexsort((leaves, rows))
        return rows[order], leaves[order]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Directions, safe for very large and very small components."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _vectors(column: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def close_pairs(left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of unit vectors with a cosine of at least the threshold, in double precision; with one list, i < j."""
    good = left @ (left if right is None else right).T >= threshold
    if right is None:
        good &= np.triu(np.ones_like(good), 1).astype(bool)
    return np.nonzero(good)


def spanning(good: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that span the same groups as the symmetric matrix of links does, a walk by whole frontiers."""
    left = good.any(axis=1)
    out = []
    for start in np.flatnonzero(left).tolist():
        if not left[start]:
            continue
        left[start] = False
        front = np.array([start])
        while len(front):
            reached = good[front] & left
            new = np.flatnonzero(reached.any(axis=0))
            out += zip(front[reached[:, new].argmax(axis=0)].tolist(), new.tolist(), strict=True)
            left[new] = False
            front = new
    return out


def _blocks(rows: DataFrame, group: list[str], tasks: int) -> DataFrame:
    """rows(group, chunks, class_id, ...) -> the blocks (i, j) of each group's chunks, sorted: any two rows of a group stand together in one."""
    rest = [c for c in rows.columns if c not in (*group, "chunks")]
    spread = rows.withColumn("chunk", F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = spread.select(*group, F.least("chunk", "to").alias("i"), F.greatest("chunk", "to").alias("j"), "chunk", *rest)
    return blocks.repartition(tasks, *group, "i", "j").sortWithinPartitions(*group, "i", "j", "class_id")


def _sides(batches: Iterator[pa.RecordBatch], keys: list[str], kind: str) -> Iterator[tuple[list[dict], np.ndarray, int]]:
    """Each block's rows, their directions, and how many are of its left side (all of them where a chunk meets itself)."""
    for (*_, i, j), rows in runs(batches, [*keys, "i", "j"]):
        left = [r for r in rows if r["chunk"] == i]
        right = [r for r in rows if r["chunk"] == j] if i != j else []
        if left and (right or i == j):
            yield left + right, unit(_vectors([r["vector"] for r in left + right], kind)), len(left)


def _linker(threshold: float, kind: str):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every, vectors, n in _sides(batches, ["leaf", "dims"], kind):
            good = np.zeros((len(every), len(every)), dtype=bool)
            x, y = close_pairs(vectors[:n], vectors[n:] if n < len(every) else None, threshold)
            good[x, y + (n if n < len(every) else 0)] = True
            pairs = spanning(good | good.T)
            if pairs:
                names = [r["class_id"] for r in every]
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k, _ in pairs], pa.int64()), pa.array([names[k] for _, k in pairs], pa.int64())], names=["a", "b"])

    return link


def _counter(threshold: float, kind: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every, vectors, n in _sides(batches, ["component", "dims"], kind):
            x, y = close_pairs(vectors[:n], vectors[n:] if n < len(every) else None, threshold)
            y = y + (n if n < len(every) else 0)
            weight = np.array([r["n_copies"] for r in every], dtype=np.float64)
            links = np.bincount(x, weights=weight[y], minlength=len(every)) + np.bincount(y, weights=weight[x], minlength=len(every))
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([every[k]["class_id"] for k in some.tolist()], pa.int64()), pa.array(links[some].astype(np.int64))], names=["class_id", "n"])

    return count


def vector_dedup(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> DataFrame:
    """Links between vectors whose cosine, in double precision, is at least the threshold.

    Returns one row for each row of vectors(vec_id, embedding): vec_id, n_links (other rows linked directly), component_id (least vec_id
    reachable by links, its own included), kept (vec_id is component_id). Null, empty and zero vectors and those with null or
    non-finite components link with nothing; vectors of different lengths neither. Equal vectors are set aside as copies and count as
    linked. Rows with a null vec_id are not compared: null component, 0 links, not kept. Rows with one vec_id count apiece.
    An empty table gives an empty result. Further columns are ignored.

    Each class of equal vectors goes through all trees, into every leaf that the spill sends it to, and leaves are compared whole,
    in blocks; their links chain into components. Then each component's classes are compared exactly, in blocks, for n_links: a dense
    group larger than a leaf is parted by every tree, but its links are counted whole. A link is missed only if no chain of found ones
    spans it.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"  # how vectors are sent: without loss
    v = F.col("embedding").cast("array<double>")
    bad = F.coalesce(F.size("embedding") <= 0, F.lit(True)) | F.coalesce(F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))
    # 0.0 and -0.0 are one number.
    plain = F.transform(v, lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (bad | F.col("vec_id").isNull()).alias("bad"), plain.alias("v"))
    good = rows.where("not bad").select("vec_id", "v", F.xxhash64("v").alias("key_a"), F.xxhash64(F.lit("second"), F.size("v"), "v").alias("key_b"))
    classes = scratch.save(good.groupBy("key_a", "key_b").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n_copies")), "classes")
    total = classes.count()
    # The row of a class's least id; rows that repeat it are the same.
    reps = good.withColumnRenamed("vec_id", "class_id").join(classes, ["class_id", "key_a", "key_b"]).dropDuplicates(["class_id", "key_a"])
    reps = scratch.save(reps.select("class_id", "n_copies", F.size("v").alias("dims"), "v"), "reps")
    dims = [r["dims"] for r in reps.select("dims").distinct().limit(1000).collect()]
    picked = reps.orderBy(F.xxhash64("class_id"), "class_id").limit(sample).select("dims", "v").collect()
    forests = {}
    for d in dims:
        own = [r["v"] for r in picked if r["dims"] == d]
        forests[d] = Forest(unit(np.array(own)) if own else np.empty((0, d)), total * len(own) // max(1, len(picked)), trees, leaf, spill)
    shared = spark.sparkContext.broadcast(forests)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, sizes, data = (batch.column(k).to_pylist() for k in range(4))
            by_dims: dict[int, list[int]] = {}
            for k, d in enumerate(sizes):
                by_dims.setdefault(d, []).append(k)
            for d, own in by_dims.items():
                matrix = np.array([data[k] for k in own], dtype=np.float64)
                if d in shared.value:
                    r, l = shared.value[d].leaves(unit(matrix))
                else:
                    r, l = np.arange(len(own)), np.zeros(len(own), dtype=np.int64)
                edge = np.searchsorted(r, np.arange(len(own) + 1))
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in own], pa.int64()), pa.array([copies[k] for k in own], pa.int64()), pa.array([d] * n, pa.int32()),
                     pa.array([matrix[k].astype(kind).tobytes() for k in range(n)], pa.binary()), pa.array([l[edge[k] : edge[k + 1]].tolist() for k in range(n)], pa.list_(pa.int64()))],
                    names=["class_id", "n_copies", "dims", "vector", "at"],
                )

    placed = scratch.save(reps.mapInArrow(place, "class_id long, n_copies long, dims int, vector binary, at array<long>"), "placed")
    where = placed.select("class_id", "dims", F.explode("at").alias("leaf"))
    full = scratch.save(where.groupBy("dims", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK).select("dims", "leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")), "full")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = placed.select("class_id", "dims", "vector", F.explode("at").alias("leaf")).join(full, ["dims", "leaf"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    found = scratch.save(_blocks(leaves, ["leaf", "dims"], tasks).mapInArrow(_linker(threshold, kind), "a long, b long"), "found")
    linked = components(spark, found, scratch, "links")
    sizes = scratch.save(linked.groupBy("component").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("n"), F.ceil(F.count("*") / BLOCK).alias("chunks")).select("component", F.when(F.col("n") > 1, F.col("chunks")).otherwise(1).cast("int").alias("chunks")), "sizes")
    members = placed.select("class_id", "n_copies", "dims", "vector").join(linked.withColumnRenamed("node", "class_id"), "class_id").join(sizes, "component")
    n_links = _blocks(members, ["component", "dims"], tasks).mapInArrow(_counter(threshold, kind), "class_id long, n long").groupBy("class_id").agg(F.sum("n").alias("n"))
    table = scratch.save(
        classes.join(n_links, "class_id", "left").join(linked.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("key_a", "key_b", (F.coalesce("n", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id")), "table"
    )
    out = good.select("vec_id", "key_a", "key_b").join(table, ["key_a", "key_b"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("bad").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(read_table(spark, sf_dir, "embeddings"))
