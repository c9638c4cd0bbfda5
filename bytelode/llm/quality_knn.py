"""Quality classifier: nearest-neighbour voting among labelled documents in a latent-semantic space."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm.common import read_table
from bytelode.llm.words import Slice, word_slices

#: Labelled rows that the space is fitted on and that vote, at most: those with the least hash of doc_id.
SAMPLE = 4000
SHAPES, WORDS, STATS = 1024, 3072, 64
TERMS = SHAPES + WORDS + STATS
RANK = 64
NEIGHBOURS = 15
_RUNS = re.compile(r"(.)\1+")
_SHAPE = {c: "A" if chr(c).isupper() else "a" if chr(c).isalpha() else "9" if chr(c).isdigit() else chr(c) for c in range(128)}


class Terms(dict):
    """word -> (number of its shape, number of the word itself), remembered."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        shape = _RUNS.sub(r"\1", word[:256].translate(_SHAPE) if word.isascii() else "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word[:256]))
        if len(word) > 256:
            shape += "..."
        number = (xxhash.xxh64_intdigest(shape) % SHAPES) * WORDS + xxhash.xxh64_intdigest(word.lower()) % WORDS
        if len(word) <= 64:
            self[word] = number
        return number


_TERMS = Terms()


def term_weights(part: Slice) -> np.ndarray:
    """A row of term weights for each text of a slice: 1 + log of the counts of word shapes and hashed words, and marks of its length,
    share of distinct words, share of words that repeat the one before, and mean word length. A text without words has only marks."""
    n = part.last - part.first
    codes = np.fromiter(map(_TERMS.__getitem__, part.names), np.int64, len(part.names))
    code = codes[part.index]
    counts = np.bincount(part.owner * TERMS + code // WORDS, minlength=n * TERMS).astype(np.float32)
    counts += np.bincount(part.owner * TERMS + SHAPES + code % WORDS, minlength=n * TERMS)
    counts = counts.reshape(n, TERMS)
    weights = np.zeros_like(counts)
    some = counts > 0
    weights[some] = 1 + np.log(counts[some])
    words = np.bincount(part.owner, minlength=n)
    least = np.maximum(words, 1)
    pairs = np.unique(part.owner * (len(part.names) + 1) + part.index)
    distinct = np.bincount(pairs // (len(part.names) + 1), minlength=n) / least
    same = (part.index[1:] == part.index[:-1]) & (part.owner[1:] == part.owner[:-1])
    again = np.bincount(part.owner[1:][same], minlength=n) / least
    sizes = np.fromiter(map(len, part.names), np.int64, len(part.names))
    mean = np.bincount(part.owner, weights=sizes[part.index], minlength=n) / least
    row, at = np.arange(n), SHAPES + WORDS
    weights[row, at + np.minimum(15, np.log2(words + 1)).astype(int)] = 4
    weights[row, at + 16 + np.minimum(15, distinct * 16).astype(int)] = 4
    weights[row, at + 32 + np.minimum(15, again * 40).astype(int)] = 4
    weights[row, at + 48 + np.minimum(15, mean).astype(int)] = 4
    return weights


class NeighbourModel:
    """Labelled latent-semantic vectors, what puts a text among them, and the vote."""

    def __init__(self, weights: np.ndarray, labels: np.ndarray, rank: int = RANK, k: int = NEIGHBOURS, seed: int = 5):
        self.labels, self.k = labels.astype(np.float32), k
        self.prior = float(labels.mean()) if len(labels) else 1.0
        if not len(labels):
            return
        seen = (weights > 0).sum(axis=0)
        self.idf = np.log((1 + len(weights)) / (1 + seen)).astype(np.float32)
        x = self._scaled(weights)
        rank = min(rank, *x.shape)
        # Truncated singular vectors by a randomised range finder with two power steps.
        q = np.linalg.qr(x.T @ np.random.default_rng(seed).standard_normal((len(x), min(rank + 16, *x.shape))).astype(np.float32))[0]
        for _ in range(2):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.basis = (q @ v[:rank].T).astype(np.float32)
        self.points = self._unit(x @ self.basis)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _scaled(self, weights: np.ndarray) -> np.ndarray:
        return self._unit(weights * self.idf)

    def score(self, weights: np.ndarray) -> np.ndarray:
        """For each row: the labels of its nearest labelled vectors by exact cosine, weighted by it."""
        if not len(self.labels):
            return np.full(len(weights), self.prior)
        like = self._unit(self._scaled(weights) @ self.basis) @ self.points.T
        k = min(self.k, like.shape[1])
        near = np.argpartition(-like, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(like, near, axis=1), 0.0).astype(np.float64) ** 4 + 1e-9
        return np.clip((votes * self.labels[near]).sum(axis=1) / votes.sum(axis=1), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, may_learn, sample: int = SAMPLE) -> NeighbourModel:
    """Fits on at most `sample` labelled rows (labels(doc_id, label), the least label of a doc_id) that may be learned from."""
    known = labels.where("label is not null and doc_id is not null").where(may_learn).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in word_slices(batch.column(1)):
                weights = term_weights(part)
                at = [np.flatnonzero(w) for w in weights]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.last - part.first), batch.column(2).slice(part.first, part.last - part.first),
                     pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([w[a].astype("<f4").tobytes() for w, a in zip(weights, at, strict=True)], pa.binary())],
                    names=["doc_id", "label", "at", "weight"],
                )

    got = rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(features, "doc_id long, label int, at binary, weight binary").dropDuplicates(["doc_id"])
    got = sorted(got.limit(sample).collect(), key=lambda r: r["doc_id"])
    weights = np.zeros((len(got), TERMS), dtype=np.float32)
    for k, r in enumerate(got):
        weights[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["weight"], "<f4")
    return NeighbourModel(weights, np.array([r["label"] for r in got], dtype=np.float64))


def score_documents(docs: DataFrame, model: NeighbourModel) -> DataFrame:
    """doc_id and score of each row of docs(doc_id, text), from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in word_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.last - part.first), pa.array(shared.value.score(term_weights(part)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def crc_rest(modulus: int):
    """crc32 of a row's doc_id as text, modulo a number; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, held_out, score (0 to 1, likelihood of label 1), predicted (score >= 0.7).

    Labels are learned from rows of labels(doc_id, quality) whose crc32(doc_id as text) mod 4 is not 2, at most `sample` of them. A null
    or empty text is scored like any other; a null doc_id is held out. Without labels every score is 1. Repeated rows get a row each;
    further columns are ignored.
    """
    model = fit(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")), crc_rest(4) != 2, sample)
    held = F.coalesce(crc_rest(4) == 2, F.lit(True))
    return score_documents(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
