"""Toxicity: class-conditional Kneser-Ney models of expressions, compared by length-normalised log-likelihood.

An expression is a word with the word before it. Real words and expressions are counted in tables that grow with the corpus; they are
dealt out by word, so that all a word's expressions, and what they fall back on, stand in one block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm.common import Scratch, mix64, read_table
from bytelode.llm.quality_knn import crc_rest
from bytelode.llm.words import Slice, word_slices

#: Rows that the scale of the score is fitted on, at most: those with the least hash of doc_id.
SCALE_ROWS = 20_000
#: Labels that are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Share of a toxic text's expressions that are taken to be toxic ones, in the mixture's likelihood.
TOXIC_SHARE = 0.003
#: Log ratios beyond which expressions are counted.
CLEAR = (0.5, 1.0, 2.0, 3.0, 4.0)
FEATURES = 2 + len(CLEAR)
#: Bytes and texts of a slice.
SLICE_BYTES = 6 << 20
SLICE_TEXTS = 4096
#: Bits that tell apart words, and what stands before one word; steps of a unit in which log ratios are sent.
WORD_BITS, BEFORE_BITS, STEPS = 40, 32, 1024
#: Words with a greater share of all words than one in this many (or in twice the blocks) are dealt out by expression.
HOT_SHARE = 2048
#: Frequent words that are sent by rank, in two bytes, not by hash. How many they are changes no result.
COMMON = 65_535
#: An expression has its own ratio from so many places on, in all learnable rows; with fewer, discounts leave it to its word.
LEAST_COUNT = 2

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def plain(text: bytes) -> bytes:
    """A-Z lowered, other ASCII than letters and digits made spaces."""
    return text.translate(_PLAIN)


class WordKeys(dict):
    """word -> hash of WORD_BITS, remembered; the memory is emptied when it holds too many words."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh64_intdigest(word) >> 64 - WORD_BITS
        if len(word) <= 64:
            self[word] = value
        return value


_KEYS = WordKeys()


def word_keys(names: list[str]) -> np.ndarray:
    return np.fromiter(map(_KEYS.__getitem__, names), np.uint64, len(names))


def before_keys(keys: np.ndarray) -> np.ndarray:
    """BEFORE_BITS of a word's key, for where it stands before another; 0 is the start of a text."""
    return (mix64(keys + np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << BEFORE_BITS) - 1)) | np.uint64(1)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mix64(keys) >> np.uint64(24)).astype(np.int64) % blocks


def pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Unsigned whole numbers as planes of equal bytes of all numbers, so that upper bytes, alike or rising, take next to nothing."""
    planes = [np.array([len(c) for c, _ in columns], "<u8").tobytes()]
    for values, width in columns:
        wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
        planes += [wide[:, k].tobytes() for k in range(width)]
    return _PACK.compress(b"".join(planes))


def unpack(blob: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    data = np.frombuffer(_UNPACK.decompress(blob), np.uint8)
    sizes, at, out = data[: 8 * len(widths)].view("<u8").astype(np.int64), 8 * len(widths), []
    for n, width in zip(sizes.tolist(), widths, strict=True):
        wide = np.zeros((n, 8), np.uint8)
        for k in range(width):
            wide[:, k] = data[at : at + n]
            at += n
        out.append(wide.view("<u8").reshape(-1).astype(np.uint64))
    return out


#: Bytes of: ranks of words, hashes of those without one, entries of each word, steps between the ranks of what stands before a word, hashes of
#: what has none, field (document or mark), count.
_ENTRIES = (2, 5, 4, 2, 4, 2, 4)
#: Bytes of: documents, sum of log ratios, log-likelihood of the mixture, counts beyond CLEAR.
_SUMS = (2, 5, 5, *(3 for _ in CLEAR))


class Lexicon:
    """hot: sorted keys of the words that are dealt out by expression. common: keys of frequent words by rank, from 1 on; before, their
    keys where they stand before a word, with the start of a text after them."""

    def __init__(self, hot: np.ndarray, common: np.ndarray):
        self.hot, self.common = hot, common
        self.before = np.concatenate((before_keys(common), np.zeros(1, np.uint64)))[:COMMON]
        self._orders = [np.argsort(x) for x in (self.common, self.before)]

    def ranks(self, keys: np.ndarray, before: bool) -> np.ndarray:
        """0 where a key has none."""
        k = int(before)
        table, order = (self.common, self.before)[k], self._orders[k]
        if not len(table):
            return np.zeros(len(keys), np.int64)
        at = order[np.minimum(np.searchsorted(table[order], keys), len(table) - 1)]
        return np.where(table[at] == keys, at + 1, 0)

    def decoded(self, ranks: np.ndarray, others: np.ndarray, before: bool) -> np.ndarray:
        out, known = np.empty(len(ranks), np.uint64), ranks > 0
        out[known] = (self.common, self.before)[int(before)][ranks[known].astype(np.int64) - 1]
        out[~known] = others
        return out


def dealt(part: Slice, field: np.ndarray, blocks: int, lexicon: Lexicon) -> Iterator[tuple[int, bytes]]:
    """(block, packed entries) of a slice's expressions: how often each stands with each value of the field (of a document; below 0:
    left out)."""
    keys = word_keys(part.names)
    before = np.zeros(len(part.index), np.int64)
    before[1:] = np.where(part.owner[1:] == part.owner[:-1], part.index[:-1].astype(np.int64) + 1, 0)
    used = field[part.owner] >= 0
    n = len(keys) + 1
    pairs, pair = np.unique(before[used] * n + part.index[used], return_inverse=True)
    if not len(pairs):
        return
    first, word = np.divmod(pairs, n)
    contexts = np.concatenate((np.zeros(1, np.uint64), before_keys(keys)))[first]
    block = block_of(keys, blocks)[word]
    spread = np.isin(keys, lexicon.hot)[word]
    block[spread] = block_of(keys[word[spread]] ^ contexts[spread], blocks)
    ranks = lexicon.ranks(contexts, True)
    order = np.lexsort((contexts, ranks, keys[word], block))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    entries, counts = np.unique(rank[pair] << 16 | field[part.owner[used]], return_counts=True)
    at = order[entries >> 16]
    edges = np.searchsorted(block[order], np.arange(blocks + 1))
    edges = np.searchsorted(entries >> 16, edges)
    for b in np.flatnonzero(np.diff(edges)).tolist():
        rows = slice(edges[b], edges[b + 1])
        words, own = keys[word[at[rows]]], ranks[at[rows]]
        new = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        named = lexicon.ranks(words[new], False)
        steps = np.diff(own, prepend=0)
        steps[new] = own[new]
        columns = (named, words[new][named == 0], np.diff(np.append(new, len(words))), steps, contexts[at[rows]][own == 0], entries[rows] & 0xFFFF, counts[rows])
        yield b, pack(list(zip(columns, _ENTRIES, strict=True)))


def entries_of(blob: bytes, lexicon: Lexicon) -> tuple[np.ndarray, ...]:
    """words (sorted), each entry's place among them, what stands before, field, count."""
    ranks, others, sizes, steps, before_others, field, count = unpack(blob, _ENTRIES)
    words, sizes, run = lexicon.decoded(ranks, others, False), sizes.astype(np.int64), np.cumsum(steps.astype(np.int64))
    place = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes) - sizes
    run -= (run[first] - steps[first].astype(np.int64))[place]
    return words, place, lexicon.decoded(run, before_others, True), field.astype(np.int64), count.astype(np.int64)


def heavy_words(docs: DataFrame, blocks: int) -> Lexicon:
    """hot: all words with at least one part in HOT_SHARE (or twice the blocks) of all words, and few others; common: COMMON frequent words
    at most. What has such a share of all words has it in a task, so tasks only name what is frequent there."""
    share = max(1, min(HOT_SHARE, 2 * blocks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for part in word_slices(batch.column(0), plain, SLICE_BYTES, SLICE_TEXTS):
                n = np.bincount(part.index, minlength=len(part.names))
                some = np.flatnonzero(n)
                own = np.concatenate((keys, word_keys([part.names[k] for k in some.tolist()])))
                keys, number = np.unique(own, return_inverse=True)
                counts = np.bincount(number, weights=np.concatenate((counts, n[some]))).astype(np.int64)
        total = int(counts.sum())
        often = counts * 6 * max(share, COMMON) >= total
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[often].view(np.int64), 0)), pa.array(np.append(counts[often], total)), pa.array(np.append(np.zeros(int(often.sum()), bool), True))], names=["word", "n", "total"])

    counted = docs.select("text").mapInArrow(count, "word long, n long, total boolean").groupBy("word", "total").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("total"), F.desc("n"), "word").limit(1 + COMMON).collect()
    every = sum(r["n"] for r in rows if r["total"])
    words = np.array([r["word"] for r in rows if not r["total"]], np.int64).view(np.uint64)
    hot = np.array([r["n"] * 2 * share >= every for r in rows if not r["total"]], bool)
    return Lexicon(np.sort(words[hot]), words)


class Counts:
    """Merged entries of a block: words (sorted), and for each expression its word's place, what stands before, and a count for each mark
    (0 and 1: the classes; 2 and 3: those of the scale's rows)."""

    def __init__(self, words: np.ndarray, place: np.ndarray, before: np.ndarray, counts: np.ndarray):
        self.words, self.place, self.before, self.counts = words, place, before, counts

    @classmethod
    def merged(cls, blobs: list[bytes], lexicon: Lexicon) -> Counts:
        none = tuple(np.empty(0, k) for k in (np.uint64, np.int64, np.uint64, np.int64, np.int64))
        parts = [none, *(entries_of(b, lexicon) for b in blobs)]
        key, before, mark, count = (np.concatenate([x[0][x[1]] if k == 0 else x[k + 1] for x in parts]) for k in range(4))
        words, place = np.unique(key, return_inverse=True)
        order = np.lexsort((before, place))
        place, before, mark, count = place[order], before[order], mark[order], count[order]
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (before[1:] != before[:-1]))) if len(place) else np.empty(0, bool)
        number = np.cumsum(new) - 1
        counts = np.bincount(number * 4 + mark, weights=count, minlength=4 * int(new.sum())).astype(np.int64).reshape(-1, 4)
        return cls(words, place[new], before[new], counts)

    def of(self, early: bool) -> np.ndarray:
        """Counts of the classes; early: without the scale's rows."""
        return self.counts[:, :2] if early else self.counts[:, :2] + self.counts[:, 2:]

    def by_word(self, early: bool) -> np.ndarray:
        """For each word: its continuation counts (expressions that end on it) in class 0, 1 and both together, and its count."""
        c = self.of(early)
        both = c.sum(axis=1)
        return np.column_stack([np.bincount(self.place, weights=w, minlength=len(self.words)) for w in (c[:, 0] > 0, c[:, 1] > 0, both > 0, both)]).astype(np.int64)

    def packed(self) -> bytes:
        """All words with by_word of both models, and the expressions that can have a ratio of their own."""
        keep = self.counts.sum(axis=1) >= LEAST_COUNT
        sizes = np.bincount(self.place[keep], minlength=len(self.words))
        return pack(list(zip((self.words, *self.by_word(True).T, *self.by_word(False).T, sizes, self.before[keep], *self.counts[keep].T), _TABLE, strict=True)))


#: Bytes of: words, by_word of the early and the whole model, expressions of each word, what stands before, counts.
_TABLE = (8, *(8 for _ in range(8)), 4, 5, 4, 4, 4, 4)


class Block:
    """A block's table as a model reads it."""

    def __init__(self, blob: bytes | None, early: bool):
        words, *columns = unpack(blob, _TABLE) if blob else [np.empty(0, np.uint64) for _ in _TABLE]
        self.words, self.by_word = words, np.column_stack(columns[0:4] if early else columns[4:8]).astype(np.int64)
        self.place, self.before = np.repeat(np.arange(len(words)), columns[8].astype(np.int64)), columns[9]
        counts = np.column_stack(columns[10:]).astype(np.int64)
        self.counts = counts[:, :2] if early else counts[:, :2] + counts[:, 2:]


def pair_tally(c: np.ndarray) -> np.ndarray:
    """Of expressions: words and kinds in class 0, class 1 and both, and kinds that stand once and twice in both."""
    both = c.sum(axis=1)
    return np.array([c[:, 0].sum(), c[:, 1].sum(), both.sum(), (c[:, 0] > 0).sum(), (c[:, 1] > 0).sum(), (both > 0).sum(), (both == 1).sum(), (both == 2).sum()], np.float64)


def word_tally(w: np.ndarray) -> np.ndarray:
    """The same of words and their continuation counts."""
    return np.array([*w[:, :3].sum(axis=0), *(w[:, :3] > 0).sum(axis=0), (w[:, 2] == 1).sum(), (w[:, 2] == 2).sum()], np.float64)


def discount(once: float, twice: float) -> float:
    """Kneser and Ney's estimate from the kinds that were seen once and twice."""
    return once / (once + 2 * twice) if once else 0.75


class Model:
    """What all blocks share: discounts, weights and totals, and the words that are dealt out by expression.

    P(expression | class) = (1 - a) * discounted share of the expression in the class + a * P(word | class) * share of the expression among
    those of its word in both classes; P(word | class) = (1 - b) * discounted share of the word's continuation count in the class
    + b * its share in both classes. a and b, the shares that discounting both classes' counts frees, and the shares at their ends come
    from both classes together: what neither class has seen tells them apart in nothing."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray, hot: np.ndarray, hot_counts: np.ndarray):
        self.pairs, self.words, self.hot, self.hot_counts = pairs, words, hot, hot_counts
        self.cut, self.low_cut = discount(pairs[6], pairs[7]), discount(words[6], words[7])
        self.a = self.cut * pairs[5] / pairs[2] if pairs[2] else 1.0
        self.b = self.low_cut * words[5] / words[2] if words[2] else 1.0

    def word_probabilities(self, w: np.ndarray) -> np.ndarray:
        """For each row of continuation counts (class 0, 1, both): P(word | class 0), P(word | class 1)."""
        t, cut = self.words, self.low_cut
        shared = (np.maximum(w[:, 2] - cut, 0) + cut * t[5] / (t[5] + 1)) / t[2] if t[2] else np.ones(len(w))
        out = []
        for c in (0, 1):
            mass = t[c] - cut * t[3 + c]
            out.append((1 - self.b) * np.maximum(w[:, c] - cut, 0) / mass + self.b * shared if mass > 0 else shared)
        return np.column_stack(out)

    def ratios(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """log P(... | toxic) - log P(... | ordinary) of a block's words, for expressions without a ratio of their own, and of its expressions."""
        w = block.by_word.astype(np.float64)
        at = np.minimum(np.searchsorted(self.hot, block.words), max(0, len(self.hot) - 1))
        is_hot = self.hot[at] == block.words if len(self.hot) else np.zeros(len(block.words), bool)
        w[is_hot] = self.hot_counts[at[is_hot]]
        low = self.word_probabilities(w)
        c, t = block.counts, self.pairs
        share = c.sum(axis=1) / np.maximum(w[block.place, 3], 1)
        p = []
        for k in (0, 1):
            mass = t[k] - self.cut * t[3 + k]
            back = low[block.place, k] * share
            p.append((1 - self.a) * np.maximum(c[:, k] - self.cut, 0) / mass + self.a * back if mass > 0 else back)
        with np.errstate(divide="ignore", invalid="ignore"):
            word, pair = np.log(low[:, 1] / low[:, 0]), np.log(p[1] / p[0])
        return word, np.where(c.sum(axis=1) >= LEAST_COUNT, pair, word[block.place])


def lookup(block: Block, ratios: tuple[np.ndarray, np.ndarray], words: np.ndarray, place: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The log ratio of each entry: of its expression, else of its word, else 0."""
    if not len(block.words):
        return np.zeros(len(place))
    at = np.minimum(np.searchsorted(block.words, words), len(block.words) - 1)
    known = block.words[at] == words
    out = np.where(known, ratios[0][at], 0.0)[place]
    key = block.place.astype(np.uint64) << np.uint64(BEFORE_BITS) | block.before
    want = at[place].astype(np.uint64) << np.uint64(BEFORE_BITS) | before
    hit = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
    seen = known[place] & (key[hit] == want) if len(key) else np.zeros(len(place), bool)
    out[seen] = ratios[1][hit[seen]]
    return out


def text_sums(ratio: np.ndarray, field: np.ndarray, count: np.ndarray) -> bytes:
    """Packed sums of each document's log ratios. Sums are whole steps, so their order changes nothing."""
    docs, own = np.unique(field, return_inverse=True)
    mixture = np.log1p(TOXIC_SHARE * np.expm1(ratio))
    total = lambda x: np.bincount(own, weights=x * count, minlength=len(docs))
    steps = [np.rint(total(np.rint(x * STEPS))).astype(np.int64) for x in (ratio, mixture)]
    steps = [np.where(x < 0, -2 * x - 1, 2 * x) for x in steps]  # small numbers of either sign have zeros above
    return pack(list(zip((docs, *steps, *(total(ratio > c) for c in CLEAR)), _SUMS, strict=True)))


def text_features(blobs: list[bytes], words: np.ndarray) -> np.ndarray:
    """FEATURES numbers of each text of a slice: the length-normalised difference of the log-likelihoods, that of a mixture in which
    TOXIC_SHARE of the expressions are toxic, and the logs of the numbers of expressions beyond each of CLEAR."""
    sums = np.zeros((len(words), FEATURES))
    for blob in blobs:
        docs, *columns = unpack(blob, _SUMS)
        for k, x in enumerate(columns):
            x = x.astype(np.int64)
            sums[docs.astype(np.int64), k] += np.where(x & 1, -(x + 1) // 2, x // 2) / STEPS if k < 2 else x
    least = np.maximum(words, 1)[:, None]
    return np.column_stack((sums[:, :2] / least, np.log1p(sums[:, 2:])))


def count_blocks(marked: DataFrame, blocks: int, lexicon: Lexicon, scratch: Scratch) -> DataFrame:
    """marked(mark, text) -> the table `pairs`: block, pairs (Counts.packed), tally (of the early and the whole model), and hot (packed: of
    the words that are dealt out by expression, key and by_word of both models)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in word_slices(batch.column(1), plain, SLICE_BYTES, SLICE_TEXTS):
                marks = batch.column(0).slice(part.first, part.last - part.first).to_numpy(zero_copy_only=False).astype(np.int64)
                rows = list(dealt(part, marks, blocks, shared.value))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["block", "blob"])

    def merge(rows: pa.Table) -> pa.Table:
        block = Counts.merged(rows.column("blob").to_pylist(), shared.value)
        is_hot = np.isin(block.words, shared.value.hot)
        tally, spread = [], [block.words[is_hot]]
        for early in (True, False):
            w = block.by_word(early)
            tally += [*pair_tally(block.of(early)), *word_tally(w[~is_hot])]
            spread += list(w[is_hot].T)
        return pa.table([rows.column("block").slice(0, 1), pa.array([block.packed()], pa.binary()), pa.array([tally], pa.list_(pa.float64())), pa.array([pack([(x, 8) for x in spread])], pa.binary())], names=["block", "pairs", "tally", "hot"])

    shared = marked.sparkSession.sparkContext.broadcast(lexicon)  # COMMON words at most
    dealt_out = marked.mapInArrow(deal, "block long, blob binary")
    return scratch.save(dealt_out.groupBy("block").applyInArrow(merge, "block long, pairs binary, tally array<double>, hot binary"), "pairs", codec="uncompressed")


def fit_models(pairs: DataFrame, lexicon: Lexicon) -> list[Model]:
    """The early and the whole model. What reaches the driver is one row of sums and one for each of the heavy words."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                columns = [c.view(np.int64) for c in unpack(blob, (8,) * 9)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", *(f"w{k}" for k in range(8))])

    hot = lexicon.hot
    total = pairs.agg(*(F.sum(F.get("tally", k)) for k in range(32))).first()
    tally = np.array([x or 0.0 for x in total]).reshape(2, 2, 8)
    counted = pairs.select("hot").mapInArrow(spread, "word long, " + ", ".join(f"w{k} long" for k in range(8))).groupBy("word").agg(*(F.sum(f"w{k}") for k in range(8))).collect() if len(hot) else []
    own = np.zeros((len(hot), 8))
    for r in counted:
        own[np.searchsorted(hot, np.array([r["word"]], np.int64).view(np.uint64))[0]] = r[1:]
    return [Model(tally[k, 0], tally[k, 1] + word_tally(own[:, 4 * k : 4 * k + 4]), hot, own[:, 4 * k : 4 * k + 4]) for k in (0, 1)]


def features(docs: DataFrame, pairs: DataFrame, model: Model, early: bool, blocks: int, lexicon: Lexicon, scale: Scale | None = None) -> DataFrame:
    """docs(doc_id, mark, text) -> doc_id, mark, and FEATURES numbers, or doc_id and the scale's score of them. Slices send their entries to the blocks and get back a row of sums for
    each block that they touch; ids take the same way, so that they match however a slice was cut."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in word_slices(batch.column(2), plain, SLICE_BYTES, SLICE_TEXTS):
                size = part.last - part.first
                ids, marks = (batch.column(k).slice(part.first, size) for k in (0, 1))
                head = [ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), ids.is_null().to_numpy(zero_copy_only=False), marks.to_numpy(zero_copy_only=False) + 1, np.bincount(part.owner, minlength=size)]
                rows = list(dealt(part, np.arange(size), blocks, shared.value))
                yield pa.RecordBatch.from_arrays([pa.array([n % blocks, *(b for b, _ in rows)], pa.int64()), pa.array([n] * (1 + len(rows)), pa.int64()), pa.array([True] + [False] * len(rows)), pa.array([pack(list(zip(head, (8, 1, 1, 4), strict=True))), *(x for _, x in rows)], pa.binary())],
                                                 names=["block", "slice", "head", "blob"])
                n += 1

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        block = Block(table.column("pairs")[0].as_py() if table.num_rows else None, early)
        ratios = model.ratios(block)
        out = []
        for k in range(asked.num_rows):
            blob = asked.column("blob")[k].as_py()
            if not asked.column("head")[k].as_py():
                words, place, before, field, count = entries_of(blob, shared.value)
                blob = text_sums(lookup(block, ratios, words, place, before), field, count)
            out.append(blob)
        return pa.table([asked.column("slice"), asked.column("head"), pa.array(out, pa.binary())], names=["slice", "head", "blob"])

    def finish(rows: pa.Table) -> pa.Table:
        head, blobs = None, []
        for is_head, blob in zip(rows.column("head").to_pylist(), rows.column("blob").to_pylist(), strict=True):
            if is_head:
                head = unpack(blob, (8, 1, 1, 4))
            else:
                blobs.append(blob)
        ids, null, marks, words = head
        x = text_features(blobs, words.astype(np.int64))
        ids = pa.array(ids.view(np.int64), mask=null.astype(bool))
        if scale:
            return pa.table([ids, pa.array(scale(x))], names=["doc_id", "score"])
        return pa.table([ids, pa.array(marks.astype(np.int32) - 1), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(FEATURES))], names=["doc_id", "mark", *(f"x{k}" for k in range(FEATURES))])

    asked = docs.select("doc_id", "mark", "text").mapInArrow(ask, "block long, slice long, head boolean, blob binary")
    answers = asked.groupBy("block").cogroup(pairs.select("block", "pairs").groupBy("block")).applyInArrow(answer, "slice long, head boolean, blob binary")
    return answers.groupBy("slice").applyInArrow(finish, "doc_id long, score double" if scale else "doc_id long, mark int, " + ", ".join(f"x{k} double" for k in range(FEATURES)))


class Scale:
    """A logistic curve over the standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.dev, self.weights = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1)
        if not len(y) or y.min() == y.max():
            self.weights[0] = -2.0 if not len(y) or not y.max() else 2.0
            self.weights[1] = 1.0
            return
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack((np.ones(len(x)), (x - self.mean) / self.dev))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.1 * np.eye(FEATURES + 1), z.T @ (y - p) - 0.1 * self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-6:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack((np.ones(len(x)), (x - self.mean) / self.dev))
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, held_out, score (0 to 1, likelihood of label 1), predicted (score >= 0.5).

    Labels are learned from rows of labels(doc_id, toxic) whose crc32(doc_id as text) mod 5 is not 0, and the models count all those.
    The scale of the score is fitted on rows with remainder 4, scored by models that count remainders 1 to 3 only. The least label of a
    doc_id counts. A null or empty text is scored like any other; a null doc_id is held out. Repeated rows get a row each; further
    columns are ignored. Documents are read three times (heavy words, counts, scores).
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    known = known.where(crc_rest(5) != 0).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"))
    scratch = Scratch(spark, "toxicity")
    marked = scratch.save(known.select("doc_id", (F.col("label") + F.when(crc_rest(5) == 4, 2).otherwise(0)).alias("mark")), "marks")
    few = marked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A block holds the entries of two shuffle partitions' worth of input.
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    lexicon = heavy_words(rows, blocks)
    pairs = count_blocks(rows.join(F.broadcast(marked) if few else marked, "doc_id").select("mark", "text"), blocks, lexicon, scratch)
    early, whole = fit_models(pairs, lexicon)
    chosen = marked.where("mark > 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SCALE_ROWS)
    fitted = features(rows.join(F.broadcast(chosen), "doc_id"), pairs, early, True, blocks, lexicon).select("mark", *(f"x{k}" for k in range(FEATURES))).limit(2 * SCALE_ROWS).toArrow()
    order = np.lexsort([fitted.column(k).to_numpy() for k in range(FEATURES + 1)])
    scale = Scale(np.column_stack([fitted.column(f"x{k}").to_numpy() for k in range(FEATURES)])[order], fitted.column("mark").to_numpy().astype(np.float64)[order] - 2)

    held = F.coalesce(crc_rest(5) == 0, F.lit(True))
    scored = features(rows.withColumn("mark", F.lit(-1)), pairs, whole, False, blocks, lexicon, scale)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
