"""Mixing sources to target weights: membership patterns, a min-cost flow with convex repetition costs, seeded selection."""

from __future__ import annotations

import json
import math
from collections import deque
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelode.llm.common import Scratch, WORD_CLASS, read_table

#: Sources and patterns are names in a recipe; more of them than this is refused, so what reaches the driver stays small.
MAX_PATTERNS = 100_000
MAX_REPEATS = 3
SEED = "mix-1"


def water_fill(sizes: list[int], weights: list[int], repeats: int = MAX_REPEATS) -> list[Fraction]:
    """Targets that share sum(sizes) by weight, none above repeats times its size; what is above is shared again by weight."""
    targets = [Fraction(0)] * len(sizes)
    open_ = [i for i in range(len(sizes)) if weights[i] > 0]
    left = Fraction(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > repeats * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = Fraction(repeats * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def min_cost_flow(patterns: list[tuple[int, tuple[int, ...]]], quotas: list[int], repeats: int = MAX_REPEATS) -> list[dict[int, int]]:
    """Words that each pattern (capacity, its sources) sends to each source, at least total cost.

    The k-th use of a pattern's capacity costs k-1 a word, so nothing is taken again before all has been taken once where that helps.
    The network is pattern layers -> patterns -> sources -> sink. Only a path's first arc costs anything, so the cheapest augmenting
    paths are those of the first layer, as long as there are any, then those of the second: each layer is filled up by shortest paths,
    which lead from a pattern to a source with room, past full sources by rerouting what other patterns send there. A pattern that
    reaches no room never does later. Ties go by number. What no member can supply stays unfilled.
    """
    sent: list[dict[int, int]] = [{} for _ in patterns]
    room = list(quotas)
    members: list[list[int]] = [[] for _ in quotas]
    for p, (_, own) in enumerate(patterns):
        for s in own:
            members[s].append(p)
    for _ in range(repeats):
        free = [capacity for capacity, _ in patterns]
        moved = True
        while moved:
            moved = False
            # For each source that leads to room: the next step, a pattern that it takes words of and the source that they go to instead.
            step: dict[int, tuple[int, int] | None] = {s: None for s, n in enumerate(room) if n}
            order = {s: k for k, s in enumerate(step)}
            todo = deque(step)
            while todo:
                t = todo.popleft()
                for p in members[t]:
                    for s, n in sent[p].items():
                        if n and s not in step:
                            step[s], order[s] = (p, t), len(order)
                            todo.append(s)
            for p, (_, own) in enumerate(patterns):
                for s in sorted((s for s in own if s in step), key=order.__getitem__):
                    path, at, n = [], s, free[p]
                    while (here := step[at]) is not None:
                        n = min(n, sent[here[0]][at])
                        path.append((here[0], at, here[1]))
                        at = here[1]
                    n = min(n, room[at])
                    if not n:
                        continue
                    for q, x, y in path:
                        sent[q][x] -= n
                        sent[q][y] = sent[q].get(y, 0) + n
                    sent[p][s] = sent[p].get(s, 0) + n
                    room[at] -= n
                    free[p] -= n
                    moved = True
    return sent


def mix(docs: DataFrame, members: str | list[str] = "source", weights: dict | None = None) -> DataFrame:
    """Adds size, source_size, target and taken (words the mix takes, repeats counted) to each row of docs.

    members: the column of a row's source (string, null is a source of its own), or of all its sources (array of strings).
    weights: by source; by default 5, 2, 1, repeating, in code point order, null last. For a row of several sources,
    source_size and target are the sums over its sources.
    Each pattern of sources gets the words that the flow sends through it: every document whole as often as that goes, then
    documents in the seeded order of md5(seed, doc_id) until the rest is used up, the document at the edge in part (its
    leading words). A pattern of n documents is cut into about sqrt(n) hash buckets, and only the bucket at the edge is sorted, so
    a hot source is spread over tasks. A null text has size 0, and rows of size 0 are taken 0 times. An empty table gives an empty result.
    Repeated rows are taken like different ones. Columns of docs named like the added ones are replaced.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[members]
    list_of = F.array_sort(F.array_distinct(F.coalesce(F.col(members), F.array(F.lit(None).cast("string"))))) if kind.startswith("array") else F.array(F.col(members).cast("string"))
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    order = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_CLASS)).cast("long").alias("size"),
        F.to_json(F.struct(list_of.alias("m")), {"ignoreNullFields": "false"}).alias("_pattern"),
        F.conv(F.substring(order, 1, 12), 16, 10).cast("long").alias("_order"),
    )
    scratch = Scratch(spark, "mix")
    lean = scratch.save(base.select("_pattern", "_order", "size", F.xxhash64("row").alias("_row")), "lean")
    counted = lean.groupBy("_pattern").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    patterns = counted.limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    lists = [(r["_pattern"], tuple(json.loads(r["_pattern"])["m"]), r["size"], r["docs"]) for r in patterns]
    names = sorted({s for _, ms, _, _ in lists for s in ms}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    lists.sort(key=lambda r: [number[s] for s in r[1]])
    sizes = [0] * len(names)
    for _, ms, size, _ in lists:
        for s in ms:
            sizes[number[s]] += size
    share = [(5, 2, 1)[i % 3] if weights is None else weights.get(s, 0) for i, s in enumerate(names)]
    overlap = sum(sizes)
    total = sum(r[2] for r in lists)
    targets = water_fill(sizes, share) if overlap == total else [t * total / overlap for t in water_fill(sizes, share)]
    quotas = _rounded(targets)
    flows = min_cost_flow([(size, tuple(number[s] for s in ms)) for _, ms, size, _ in lists], quotas)
    rows = [
        (p, max(1, math.isqrt(n)), size, sum(flow.values()), sum(sizes[number[s]] for s in ms), float(sum(targets[number[s]] for s in ms)))
        for (p, ms, size, n), flow in zip(lists, flows, strict=True)
    ]
    plan = spark.createDataFrame(rows, "_pattern string, _buckets long, _size long, _flow long, source_size long, target double")
    plan = plan.withColumn("_times", F.when(F.col("_size") > 0, F.floor(F.col("_flow") / F.greatest("_size", F.lit(1)))).otherwise(F.lit(0)))
    plan = plan.withColumn("_rest", F.col("_flow") - F.col("_times") * F.col("_size"))
    # 2^48 values of _order, cut into _buckets equal parts.
    bucket = F.expr("cast(floor(_order / 281474976710656D * _buckets) as long)")
    in_bucket = lean.join(F.broadcast(plan.select("_pattern", "_buckets")), "_pattern").withColumn("_bucket", bucket)
    sums = in_bucket.groupBy("_pattern", "_bucket").agg(F.sum("size").alias("_n"))
    ahead = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    edge = (
        sums.join(F.broadcast(plan.select("_pattern", "_rest")), "_pattern")
        .where("_before < _rest and _before + _n >= _rest").select("_pattern", "_bucket", "_before", "_rest")
    )
    edge = scratch.save(edge, "edge")  # one bucket for each pattern
    inside = Window.partitionBy("_pattern").orderBy("_order", "_row").rowsBetween(Window.unboundedPreceding, -1)
    in_edge = (
        in_bucket.join(F.broadcast(edge), ["_pattern", "_bucket"])
        .groupBy("_pattern", "_order", "_row", "_before", "_rest", "size").agg(F.count("*").alias("_same"))
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum(F.col("size") * F.col("_same")).over(inside), F.lit(0)))
    )
    last = in_edge.where("_start < _rest").groupBy("_pattern").agg(F.max(F.struct("_order", "_row", "_start", "_same")).alias("_last"))
    cut = scratch.save(last.select("_pattern", "_last.*"), "cut").select(
        "_pattern", F.col("_order").alias("_cut_order"), F.col("_row").alias("_cut_row"), F.col("_start").alias("_cut_start"), F.col("_same").alias("_cut_same")
    )
    full = plan.join(cut, "_pattern", "left")
    at = F.struct("_order", "_row")
    cut_at = F.struct(F.col("_cut_order").alias("_order"), F.col("_cut_row").alias("_row"))
    # Equal rows at the edge share what is left evenly, whole words each.
    extra = (
        F.when(F.col("_cut_order").isNull(), F.lit(0)).when(at < cut_at, F.col("size"))
        .when(at == cut_at, F.floor((F.col("_rest") - F.col("_cut_start")) / F.col("_cut_same"))).otherwise(F.lit(0))
    )
    return (
        base.withColumn("_row", F.xxhash64("row")).join(F.broadcast(full), "_pattern")
        .select(*[F.col("row")[c].alias(c) for c in own], "size", "source_size", "target", (F.col("size") * F.col("_times") + F.least(extra, F.col("size"))).cast("long").alias("taken"))
    )


def _rounded(targets: list[Fraction]) -> list[int]:
    """Whole words whose sum is that of the targets: largest remainders first, ties by number."""
    floors = [int(t) for t in targets]
    left = round(sum(targets)) - sum(floors)
    for i in sorted(range(len(targets)), key=lambda i: (floors[i] - targets[i], i))[:left]:
        floors[i] += 1
    return floors


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
