"""Quality rules: a decision list learned by sequential covering from labelled statistics. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm.common import Scratch, read_table
from bytelode.llm.line_dedup import let

#: Statistics that rules may test; all are shares or counts of the text alone.
FEATURES = ("n_words", "mean_word", "symbols", "dup_lines", "repeated", "upper", "distinct", "marks", "digits", "lines")
THRESHOLDS = 16  # for each statistic and class
MAX_RULES = 12
MAX_CONDITIONS = 4
LEAST_PRECISION = 0.9
LEAST_ROWS = 3


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the text."""

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda x, i: F.when(i + 1 < F.size(at), F.least(F.lit(3), F.get(at, i + 1) - x)).otherwise(F.lit(3))), F.lit(0), lambda a, b: a + b
        )

    def again(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        places = let(order, lambda s: F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (same(s, i, i - 1) | same(s, i, i + 1)).alias("d"))), lambda x: x["d"]), lambda x: x["i"]))
        return let(F.sort_array(places), covered)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(again(h)))).cast("long")


def text_statistics(text: Column) -> Column:
    """A struct of the base counts and the further statistics of a whole text; a null text is one without words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return let(
        F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), count("[#*$%&|<>]").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), count("\\p{Lu}").alias("n_upper"),
            count("[!?;]").alias("n_marks"), count("[0-9]").alias("n_digits"),
        ),
    )


def with_features(stats: DataFrame) -> DataFrame:
    """The rules' statistics, from the counts."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.select(
        "*",
        F.struct(
            F.col("n_words").cast("double").alias("n_words"), (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / words).alias("symbols"),
            (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_lines"), (F.col("n_repeat_words") / words).alias("repeated"), (F.col("n_upper") / chars).alias("upper"),
            (F.col("n_distinct") / words).alias("distinct"), (F.col("n_marks") / words).alias("marks"), (F.col("n_digits") / chars).alias("digits"), (F.col("n_lines") / words).alias("lines"),
        ).alias("f"),
    )


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float
    bin: int

    def sql(self) -> str:
        return f"f.{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"

    def on_bins(self) -> Column:
        value = F.col("bins")[self.feature]
        return value > self.bin if self.above else value <= self.bin


@dataclass
class DecisionList:
    """Ordered rules; each rejects what its conditions hold for. What no rule rejects is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def sql(self) -> str:
        cases = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {i + 1}" for i, rule in enumerate(self.rules))
        return f"CASE {cases} ELSE 0 END" if cases else "0"


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _bin(value: Column, grid: list[float]) -> Column:
    """How many thresholds lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, grid)).cast("array<double>"), lambda t: t < value))


def learn(features: DataFrame, labels: DataFrame, scratch: Scratch) -> DecisionList:
    """Learns from features(doc_id, f) and labels(doc_id, quality) what to reject (quality 0).

    All labelled rows take part, two thirds to grow rules, one to prune them, by hash of doc_id. A step counts labels by statistic
    and bin in one aggregate (bounded by statistics x bins) and takes the condition with the best information gain; pruning cuts a rule
    back to its best beginning; a rule stands if it is right often enough on all rows it covers, which then leave.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = features.select("doc_id", "f").join(marked, "doc_id").select((F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), F.array(*[f"f.{x}" for x in FEATURES]).alias("x"))
    rows = scratch.save(rows, "labelled")
    steps = F.array(*[F.lit((k + 0.5) / THRESHOLDS) for k in range(THRESHOLDS)])
    cuts = rows.groupBy("bad").agg(*[F.percentile_approx(F.col("x")[k], steps, F.lit(2000)).alias(f"c{k}") for k in range(len(FEATURES))]).collect()
    grid = [sorted({float(v) for r in cuts for v in r[f"c{k}"] or ()}) for k in range(len(FEATURES))]
    bins = F.array(*[_bin(F.col("x")[k], g) for k, g in enumerate(grid)])
    binned = scratch.save(rows.groupBy("bad", "grow", bins.alias("bins")).agg(F.count("*").alias("n")), "binned")
    out = DecisionList()
    left = binned
    bad, good = F.sum(F.when(F.col("bad"), F.col("n"))), F.sum(F.when(~F.col("bad"), F.col("n")))
    while len(out.rules) < MAX_RULES:
        rule: list[Condition] = []
        here = left.where("grow")
        while len(rule) < MAX_CONDITIONS:
            counts = here.select("bad", "n", F.posexplode("bins").alias("k", "bin")).groupBy("k", "bin").agg(bad.alias("p"), good.alias("q")).collect()
            table: dict[int, dict[int, tuple[int, int]]] = {}
            for r in counts:
                table.setdefault(r["k"], {})[r["bin"]] = (r["p"] or 0, r["q"] or 0)
            if not table:
                break
            p0, q0 = (sum(v[i] for v in table[0].values()) for i in (0, 1))
            if not p0 or not q0:
                break
            best: tuple[float, Condition | None] = (1e-9, None)
            for k in sorted(table):
                p = q = 0
                for b in range(len(grid[k])):
                    x = table[k].get(b, (0, 0))
                    p, q = p + x[0], q + x[1]
                    for above, pp, qq in ((False, p, q), (True, p0 - p, q0 - q)):
                        if pp >= LEAST_ROWS and (g := _gain(pp, qq, p0, q0)) > best[0]:
                            best = (g, Condition(k, above, grid[k][b], b))
            if best[1] is None:
                break
            rule.append(best[1])
            here = here.where(best[1].on_bins())
        if not rule:
            break
        # One aggregate judges all beginnings of the rule, on the pruning rows and on all.
        holds = [rule[0].on_bins()]
        for c in rule[1:]:
            holds.append(holds[-1] & c.on_bins())
        some = [F.coalesce(F.sum(F.when(h & side & (F.col("bad") == kind), F.col("n"))), F.lit(0)).alias(f"{i}{s}{kind}") for i, h in enumerate(holds) for s, side in (("p", ~F.col("grow")), ("a", F.lit(True))) for kind in (True, False)]
        judged = left.agg(*some).first()
        worth = [(judged[f"{i}pTrue"] - judged[f"{i}pFalse"]) / max(1, judged[f"{i}pTrue"] + judged[f"{i}pFalse"]) for i in range(len(rule))]
        size = max(range(len(rule)), key=lambda i: (worth[i], -i)) + 1
        p, q = judged[f"{size - 1}aTrue"], judged[f"{size - 1}aFalse"]
        if p < LEAST_ROWS or p / (p + q) < LEAST_PRECISION:
            size = len(rule)
            p, q = judged[f"{size - 1}aTrue"], judged[f"{size - 1}aFalse"]
            if p < LEAST_ROWS or p / (p + q) < LEAST_PRECISION:
                break
        out.rules.append(tuple(rule[:size]))
        left = left.where(~holds[size - 1])
    return out


def _counts(docs: DataFrame, own: list[Column]) -> DataFrame:
    s = docs.select(*own, text_statistics(F.col("text")).alias("s"))
    return s.select("*", *[f"s.{c}" for c in ("n_words", "word_chars", "n_symbols")], F.col("s.lines.dup").alias("n_dup_lines"), "s.n_repeat_words", F.col("s.lines.n").alias("n_lines"), "s.n_distinct", "s.n_upper", "s.n_marks", "s.n_digits").drop("s")


def _judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = with_features(stats).withColumn("base_failed", failed).withColumn("rule", F.expr(rules.sql()).cast("int"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and rule, the number of the learned rule that rejects it (0: none).

    Rules are learned from labels(doc_id, quality) on the statistics of the labelled rows of docs; labels that are null or of no row,
    and rows without doc_id, teach nothing; the least of several labels of one doc_id counts. Without labels of both kinds there
    are no rules, and base_failed alone decides. A null text has no words. Repeated rows get a row each; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    stats = scratch.save(_counts(docs, [F.col("doc_id").cast("long").alias("doc_id")]), "stats")
    rules = learn(with_features(stats), labels, scratch)
    return _judge(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep_by_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns."""
    scratch = Scratch(docs.sparkSession, "rules")
    row = F.struct(*docs.columns).alias("_row")
    stats = scratch.save(_counts(docs, [row, F.col("doc_id").cast("long").alias("doc_id")]), "stats")
    rules = learn(with_features(stats), labels, scratch)
    return _judge(stats, rules).where("kept").select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
