"""Token ids as binary shards under Re-Pair grammar compression, with expansion lengths for random-access decoding."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelode.llm.common import Scratch, read_table
from bytelode.llm.encode import default_vocabulary, encoder

MAGIC = b"RPS1"
#: First nonterminal; ids of the vocabulary lie below.
FIRST_RULE = 1 << 16
#: Ids in a shard, at most, unless one document alone is longer.
SHARD_IDS = 1 << 20
ROUNDS = 4
RULES_A_ROUND = 4096
LEAST_COUNT = 8

SHARD_SCHEMA = "part int, shard int, part_start long, n_ids long, n_docs long, payload binary"


#: Slots of the table in which pairs are looked up during a round.
_SLOTS = 18


def _slots(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((first * np.uint32(2654435761)) ^ (second * np.uint32(2246822519))) >> np.uint32(32 - _SLOTS)


def _frequent_pairs(symbols: np.ndarray, most: int, least: int) -> np.ndarray:
    """The most frequent pairs of neighbours by falling count, ties by key."""
    keys = np.sort((symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:])
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    counts = np.diff(edge)
    good = np.flatnonzero(counts >= least)
    return keys[edge[:-1][good[np.lexsort((good, -counts[good]))[:most]]]]


def repair(ids: np.ndarray, rounds: int = ROUNDS, most: int = RULES_A_ROUND, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair in rounds: count all pairs of neighbours, give each of the most frequent ones a nonterminal, replace them (of
    overlapping places the more frequent pair's goes first, then the left one), and repeat on the shorter sequence. Pairs whose
    slot in a round's table is taken by a more frequent one wait for the next round.
    Returns the sequence and the rules: row r is what FIRST_RULE + r stands for."""
    symbols, rules, n_rules = ids.astype(np.uint32), [], 0
    for _ in range(rounds):
        if len(symbols) < 2 * least:
            break
        pairs = _frequent_pairs(symbols, most, least)
        if not len(pairs):
            break
        left, right = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
        table = np.full(1 << _SLOTS, -1, np.int16)
        table[_slots(left, right)[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int16)
        rank = table[_slots(symbols[:-1], symbols[1:])]
        at = np.flatnonzero(rank >= 0)
        rank = rank[at]
        hit = (left[rank] == symbols[at]) & (right[rank] == symbols[at + 1])
        at, rank = at[hit], rank[hit]
        # A place yields to a neighbouring place of a more frequent pair, or of the same one before it.
        chosen = np.ones(len(at), dtype=bool)
        touch = np.flatnonzero(np.diff(at) == 1)
        lose_right = rank[touch] <= rank[touch + 1]
        chosen[touch[~lose_right]] = False
        chosen[touch[lose_right] + 1] = False
        at, rank = at[chosen], rank[chosen]
        if len(at) < least:
            break
        count = np.bincount(rank, minlength=len(pairs))
        names = np.flatnonzero(count)
        number = np.cumsum(count > 0) - 1
        rules.append(np.column_stack((left[names], right[names])))
        symbols[at] = (FIRST_RULE + n_rules + number[rank]).astype(np.uint32)
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        n_rules += len(names)
    return symbols, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def rule_spans(rules: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for; rules only use earlier ones."""
    spans = np.ones(FIRST_RULE + len(rules), dtype=np.int64)
    pairs = rules.astype(np.int64)
    todo = np.arange(len(rules))
    while len(todo):  # a level of the grammar at a time
        a, b = pairs[todo, 0], pairs[todo, 1]
        unready = np.zeros(FIRST_RULE + len(rules), dtype=bool)
        unready[todo + FIRST_RULE] = True
        ready = ~(unready[a] | unready[b])
        now = todo[ready]
        spans[now + FIRST_RULE] = spans[a[ready]] + spans[b[ready]]
        todo = todo[~ready]
    return spans[FIRST_RULE:]


def rule_table(rules: np.ndarray) -> np.ndarray:
    """What all rules stand for, one after the other."""
    symbols = rules.reshape(-1).astype(np.uint32)
    while len(symbols) and (high := symbols >= FIRST_RULE).any():
        wide = np.where(high, 2, 1)
        ends = np.cumsum(wide)
        out = np.empty(int(ends[-1]), dtype=np.uint32)
        out[(ends - wide)[~high]] = symbols[~high]
        both, first = rules[symbols[high].astype(np.int64) - FIRST_RULE], (ends - wide)[high]
        out[first], out[first + 1] = both[:, 0], both[:, 1]
        symbols = out
    return symbols


class Expander:
    """Symbols -> ids: the ids and all rules' expansions one after the other, where each begins, and how long it is. Built once a shard."""

    def __init__(self, rules: np.ndarray, spans: np.ndarray):
        self.source = np.concatenate((np.arange(FIRST_RULE, dtype=np.uint32), rule_table(rules)))
        self.sizes = np.concatenate((np.ones(FIRST_RULE, np.int64), spans.astype(np.int64)))
        self.starts = np.concatenate((np.arange(FIRST_RULE), FIRST_RULE + np.cumsum(self.sizes[FIRST_RULE:]) - self.sizes[FIRST_RULE:]))

    def __call__(self, symbols: np.ndarray) -> np.ndarray:
        if not len(symbols):
            return symbols.astype(np.uint32)
        n = self.sizes[symbols]
        ends = np.cumsum(n)
        return self.source[np.repeat(self.starts[symbols] - (ends - n), n) + np.arange(int(ends[-1]))]


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that a sequence of symbols stands for."""
    return Expander(rules, rule_spans(rules))(symbols)


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file format: magic, counts, document ids (and which are null), document lengths, rules, expansion lengths, symbols, and
    the id position of every 1024th symbol; all numbers little-endian."""
    if len(ids) and int(ids.max()) >= FIRST_RULE:
        raise ValueError(f"ids of the vocabulary must lie below {FIRST_RULE}")
    symbols, rules = repair(ids)
    spans = rule_spans(rules)
    wide = np.ones(len(symbols), dtype=np.int64)
    high = symbols >= FIRST_RULE
    wide[high] = spans[symbols[high].astype(np.int64) - FIRST_RULE]
    index = (np.cumsum(wide) - wide)[::1024].astype("<u8")
    head = struct.pack("<4sQQQQ", MAGIC, len(doc_ids), len(rules), len(symbols), len(ids))
    body = b"".join((
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), np.array(lengths, "<u8").tobytes(),
        rules.astype("<u4").tobytes(), spans.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(), index.tobytes(),
    ))
    return head + zstandard.ZstdCompressor(level=1).compress(body)


class Shard:
    """A shard that was read: whole or by document."""

    def __init__(self, payload: bytes):
        magic, docs, rules, symbols, self.n_ids = struct.unpack_from("<4sQQQQ", payload)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        body, at = zstandard.ZstdDecompressor().decompress(payload[36:]), 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids.tolist(), null.tolist(), strict=True)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.spans = take("<u4", rules)
        self.symbols = take("<u4", symbols)
        self.index = take("<u8", -(-symbols // 1024))

    @cached_property
    def expanded(self) -> Expander:
        """From the stored rules and their stored lengths."""
        return Expander(self.rules, self.spans)

    def ids(self) -> np.ndarray:
        return self.expanded(self.symbols)

    def slice(self, start: int, count: int) -> np.ndarray:
        """count ids from position start: only the symbols that cover them are expanded."""
        if not count:
            return np.empty(0, np.uint32)
        block = int(np.searchsorted(self.index, start, "right")) - 1
        last = int(np.searchsorted(self.index, start + count, "left"))
        part = self.symbols[block * 1024 : last * 1024]
        # Stored lengths say which of the symbols cover the ids; no others are expanded.
        ends = int(self.index[block]) + np.cumsum(self.expanded.sizes[part])
        first, stop = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, start + count, "left")) + 1
        out = self.expanded(part[first:stop])
        skip = start - (int(ends[first - 1]) if first else int(self.index[block]))
        return out[skip : skip + count]

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.lengths[:k].sum()), int(self.lengths[k]))


def write_shards(docs: DataFrame, scratch: Scratch, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes docs(doc_id, text), appends the end id to each, and writes shards in ascending doc_id order (null first, then equal ids
    by text): the table `shards`, in which (part, shard) is the order and payload the file format. Documents are dealt out by
    ranges of ids; a task holds one shard's ids at a time."""
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        shard, start, docs, sizes, parts, held, part = 0, 0, [], [], [], 0, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([pack_shard(docs, sizes, np.concatenate(parts))], pa.binary())],
                names=["part", "shard", "part_start", "n_ids", "n_docs", "payload"],
            )

        for batch in batches:
            ids, numbers = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, _, data, ends in words.slices(batch.column(1)):
                begin = 0
                for k, end in enumerate(ends.tolist()):
                    if docs and held + end - begin > shard_ids:
                        yield flush()
                        shard, start, docs, sizes, parts, held = shard + 1, start + held, [], [], [], 0
                    part = numbers[first + k]
                    docs.append(ids[first + k])
                    sizes.append(end - begin)
                    parts.append(data[begin:end])
                    held += end - begin
                    begin = end
        if docs:
            yield flush()

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    tie = F.xxhash64(F.col("text"))
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(tasks, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    shards = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(encode, SHARD_SCHEMA)
    return scratch.save(shards, "shards", codec="uncompressed")


def read_shards(shards: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and where it lies."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, start, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                shard = Shard(payload)
                data = memoryview(np.ascontiguousarray(shard.ids(), dtype="<u4")).cast("B")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(starts + start), pa.array(shard.lengths), pa.array(crc, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32())],
                    names=["doc_id", "part_start", "n_tokens", "ids_crc32", "part", "shard"],
                )

    # One row a part: as many as there were tasks.
    ends = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = ends.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = shards.select("part", "shard", "part_start", "payload").mapInArrow(decode, "doc_id long, part_start long, n_tokens long, ids_crc32 long, part int, shard int")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(read_table(spark, sf_dir, "documents"), Scratch(spark, "tokens")))
