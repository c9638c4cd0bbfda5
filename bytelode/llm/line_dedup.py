"""Line dedup: exact copies by hash, near copies by a deletion-neighbourhood join; the earliest line stays. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelode.llm.common import Scratch, read_table

#: Lines that differ in so many characters at most (put in, left out or changed) are near copies: 0, 1 or 2.
EDITS = 1
#: Lines of fewer characters are only compared exactly, by default: an edit changes too much of them.
SHORTEST = 20
#: Blocks of a line of which the edits are in one or two, and the length up to which all variants are emitted.
PARTS, LEFT = 5, 10
#: Strings that are compared at once, and their length.
FEW, MODERATE = 16, 1000
#: Rows of lines or candidates that are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_NO_ID = 1 << 62
_PLACE = ("doc", "twin", "line_no")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside of a lambda."""
    return F.transform(F.array(value), body)[0]


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("key_a"), F.xxhash64(F.lit("second"), F.length(line), line).alias("key_b")]


def _doc_order() -> list[Column]:
    """Documents in order of doc_id, then of their texts' hashes; those without doc_id come last."""
    twin = F.xxhash64(F.coalesce("text", F.lit("")))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID) + twin.bitwiseAND(F.lit(_NO_ID - 1))).alias("doc"), twin.alias("twin")]


def _lines(docs: DataFrame) -> DataFrame:
    """All lines with a word: doc, twin, line_no from 1, line."""
    lines = docs.select(*_doc_order(), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).select("doc", "twin", (F.col("at") + 1).alias("line_no"), "line")


def _part(m: Column, edits: int) -> Column:
    """Length of an outer part of lines of which the shorter one has m characters."""
    parts = edits + 1
    return F.when(m < 8 * parts, F.floor(m / parts)).otherwise(F.floor(m / (8 * parts)) * 8).cast("int")


def _outer(line: Column, z: Column, edits: int) -> Column:
    """Hashes of which lines within the edits share one. Of edits + 1 parts of length z of the shorter line one is whole: its head, its
    tail, or, of three, if head and tail hold an edit each, what follows the head, moved by one place at most."""
    keys = [F.xxhash64(F.lit("head"), z, F.substring(line, F.lit(1), z)), F.xxhash64(F.lit("tail"), z, F.right(line, z))]
    return F.array(*keys, *([F.xxhash64(F.lit("mid"), z, F.substring(line, z + 1 + s, z)) for s in (-1, 0, 1)] if edits == 2 else []))


def _outer_keys(line: Column, edits: int) -> Column:
    """_outer() for all lengths that the shorter one of a pair may have: the line's own and up to `edits` less."""

    def every(n: Column) -> Column:
        out = _outer(line, _part(n, edits), edits)
        for k in range(1, edits + 1):
            z = _part(n - k, edits)
            out = F.when(z != _part(n - k + 1, edits), F.concat(out, _outer(line, z, edits))).otherwise(out)
        return F.array_distinct(out)

    return let(F.length(line), every)


def _left_out(edits: int) -> list[tuple[int, int, int, int]]:
    """Ways (i, j, shift, longer) to leave out blocks i and j of a line of which the shorter one of a pair, `longer` characters shorter, sets
    the blocks. i = j: all edits are in one block; else one is in each, and what stands between the blocks, if anything, is moved by `shift`."""
    out = [(i, j, 0, d) for i in range(PARTS) for j in (i, i + 1)[:edits] if j < PARTS for d in range(edits + 1)]
    if edits == 2:
        out += [(i, j, e, d) for i in range(PARTS) for j in range(i + 2, PARTS) for e, d in ((0, 0), (1, 0), (1, 1), (0, 1), (1, 2))]
    return out


def _pieces(s: Column, c: Column) -> tuple[list[Column], Column, Column]:
    """What a way leaves of s, and the two blocks that it takes out (i = j: the block and an empty one)."""
    n = F.length(s)
    m = n - c["d"]
    edge = lambda k: F.floor(k * m / PARTS).cast("int")
    i0, i1, j0, j1, e, d = edge(c["i"]), edge(c["i"] + 1), edge(c["j"]), edge(c["j"] + 1), c["e"], c["d"]
    one = c["i"] == c["j"]
    cut = lambda a, b: F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))
    between = F.when(one, F.lit("")).otherwise(cut(i1 + e, j0 + e))
    first = cut(i0, F.when(one, i1 + d).otherwise(i1 + e))
    second = F.when(one, F.lit("")).otherwise(cut(j0 + e, j1 + d))
    return [m, cut(F.lit(0), i0), between, cut(j1 + d, n)], first, second


def _narrowed(state: DataFrame, ways: list[tuple[int, int, int, int]], scratch: Scratch, step: int) -> DataFrame:
    """One step of state(rid, num, place, grp, s): strings of one group are within the edits only if they agree when some way leaves out one
    or two blocks; these blocks are the next strings, and what they agree on is the next group: num, place, grp, s."""
    c = F.col("c")
    rest, first, second = _pieces(F.col("s"), c)
    codes = F.array(*[F.struct(*[F.lit(x).alias(name) for x, name in zip(w, "ijed", strict=True)]) for w in ways])
    cut = state.select("rid", "num", "grp", "s", F.explode(codes).alias("c")).where(F.length("s") > F.col("c.d"))
    own, other = F.xxhash64(first), F.xxhash64(second)
    keys = cut.select("rid", "num", "c", F.xxhash64("grp", c["i"], c["j"], *rest).alias("h"), own.alias("u"), F.when(c["i"] == c["j"], own).otherwise(other).alias("v"))
    keys = scratch.save(keys, f"keys-{step}")
    # Strings that differ in one of two blocks only also agree when that block alone is left out.
    alike = keys.groupBy("h").agg(*[f(x).alias(f"{x}{k}") for x in ("num", "u", "v") for k, f in enumerate((F.min, F.max))])
    alike = scratch.save(alike.where("num0 <> num1 and u0 <> u1 and v0 <> v1").select("h"), f"alike-{step}")
    kept = keys.select("rid", "c", "h").join(alike, "h").join(state.select("rid", "num", "place", "s"), "rid")
    inner = F.when(c["j"] - c["i"] < 2, F.concat(first, second)).otherwise(F.concat(first, F.lit("\n"), second))
    return scratch.save(kept.select("num", "place", F.col("h").alias("grp"), inner.alias("s")).distinct(), f"next-{step}")


def _still_open(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Of rows(num, place, grp, s): those of lines that are not found near yet and have an earlier one in their group, and of what is
    earlier than such a line, found or not."""
    looked = rows.join(found.withColumn("found", F.lit(True)), "num", "left")
    last = looked.groupBy("grp").agg(F.max(F.when(F.col("found").isNull(), F.col("place"))).alias("last"), F.min("place").alias("head")).where("last > head")
    return rows.join(last, "grp").where("place <= last").select("num", "place", "grp", "s")


def _near(s: Column, other: Column, edits: int) -> Column:
    return F.when(F.abs(F.length(s) - F.length(other)) <= edits, F.levenshtein(s, other, edits) >= 0).otherwise(F.lit(False))


def _settled(groups: DataFrame, found: DataFrame, edits: int, scratch: Scratch, step: int) -> tuple[DataFrame, DataFrame]:
    """What groups(num, place, grp, s) settle: the lines found near so far, and the rows that are still to be looked at. A group of at most
    FEW strings of moderate length is compared in one row; a larger one only with its earliest member."""
    sizes = scratch.save(groups.groupBy("grp").agg(((F.count("*") <= FEW) & (F.max(F.length("s")) <= MODERATE)).alias("small")), f"sizes-{step}")
    small = groups.join(sizes.where("small"), "grp").groupBy("grp").agg(F.collect_list(F.struct("place", "num", "s")).alias("m"))
    hit = F.filter("m", lambda x: F.exists("m", lambda e: (e["place"] < x["place"]) & _near(x["s"], e["s"], edits)))
    near = small.select(F.explode(hit).alias("x")).select("x.num")
    large = groups.join(sizes.where("not small"), "grp")
    heads = large.groupBy("grp").agg(F.min(F.struct("place", "s")).alias("head"))
    by_head = large.join(heads, "grp").where((F.col("place") > F.col("head.place")) & _near(F.col("s"), F.col("head.s"), edits)).select("num")
    found = scratch.save(found.unionByName(near).unionByName(by_head).distinct(), f"found-{step}")
    # Found lines need no partner any more, so that dense groups do not multiply.
    rest = _still_open(large.select("num", "place", "grp", "s"), found).withColumn("rid", F.monotonically_increasing_id())
    return found, scratch.save(rest, f"state-{step}")


def _variants(state: DataFrame, edits: int) -> DataFrame:
    """All variants within the edits of strings of up to LEFT characters: num, place, kind, variant. A: up to `edits` characters at known places
    masked; b and B: a character fewer in B, after which one (or none) is masked in both; c and C: two fewer in C; D: one left out of
    either. Equal variants of kinds A and A, b and B, c and C, D and D are of strings within the edits, and all such strings have some."""
    ks = range(1, LEFT + 1)
    ways = [("A", p, q) for p in ks for q in (ks if edits == 2 else [p]) if p <= q]
    ways += [("b", 0, p) for p in ((0, *ks) if edits == 2 else (0,))] + [("B", r, p) for r in ks for p in ((0, *ks[:-1]) if edits == 2 else (0,))]
    if edits == 2:
        ways += [("c", 0, 0)] + [("C", r, t) for r in ks for t in ks if r < t] + [("D", r, 0) for r in ks]
    codes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, x, y in ways])
    s, k, x, y, n = F.col("s"), F.col("w.k"), F.col("w.x"), F.col("w.y"), F.length("s")
    without = lambda t, at: F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + 1, F.length(t)))).otherwise(t)
    mask = lambda t, at: F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.lit("\r"), F.substring(t, at + 1, F.length(t)))).otherwise(t)
    fits = F.when(k.isin("A", "C"), y <= n).when(k == "b", y <= n).when(k == "B", (x <= n) & (y <= n - 1)).otherwise(x <= n)
    value = (
        F.when(k == "A", F.xxhash64("grp", F.lit("A"), n, x, y, mask(mask(s, x), y))).when(k.isin("b", "B"), F.xxhash64("grp", F.lit("B"), y, mask(without(s, x), y)))
        .when(k.isin("c", "C"), F.xxhash64("grp", F.lit("C"), without(without(s, y), x))).otherwise(F.xxhash64("grp", F.lit("D"), without(s, x)))
    )
    return state.select("num", "place", "grp", "s", F.explode(codes).alias("w")).where(fits).select("num", "place", k.alias("kind"), value.alias("variant")).distinct()


def near_lines(first: DataFrame, texts, scratch: Scratch, edits: int) -> DataFrame:
    """Distinct lines that an earlier distinct line is within the edits of: key_a, key_b.

    first: key_a, key_b, doc, twin, line_no of each distinct line. texts: a function that gives the lines' texts. Lines that share an outer
    key are candidates; left-out blocks narrow them step by step to short strings, whose variants are joined. Groups of equal keys of FEW
    members are settled at once; larger ones are only ever reduced to their earliest member, which the others are compared with. No rows
    are made for pairs within a group, and what is settled leaves the search.
    """
    halves = scratch.load("halves")
    shared = halves.groupBy("half").agg(F.min("key_a").alias("least"), F.max("key_a").alias("most")).where("least <> most").select("half")
    shared = scratch.save(shared, "shared")
    some = scratch.save(halves.join(shared, "half").select("key_a", "key_b").distinct(), "some")
    few = some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = first.join(F.broadcast(some) if few else some, ["key_a", "key_b"])
    candidates = texts().join(F.broadcast(wanted) if few else wanted, ["key_a", "key_b", *_PLACE]).dropDuplicates(["key_a", "key_b"])
    candidates = scratch.save(candidates.select("key_a", "key_b", *_PLACE, "line").withColumn("num", F.monotonically_increasing_id()), "candidates")
    place = F.struct(*_PLACE, "num").alias("place")
    # Candidates once more, by outer key and the shorter line's length, which must be that of a line of the group.
    own = candidates.select("num", "line", F.length("line").alias("n")).withColumn("m", F.explode(F.array(*[F.col("n") - k for k in range(edits + 1)])))
    keys = own.select("num", (F.col("n") == F.col("m")).alias("shorter"), F.explode(F.array_distinct(_outer(F.col("line"), _part(F.col("m"), edits), edits))).alias("key"), "m")
    keys = scratch.save(keys.select("num", "shorter", F.xxhash64("m", "key").alias("grp")), "keys-0")
    alike = keys.groupBy("grp").agg(F.min("num").alias("least"), F.max("num").alias("most"), F.bool_or("shorter").alias("shorter")).where("least <> most and shorter").select("grp")
    alike = scratch.save(alike, "alike-0")
    groups = keys.select("num", "grp").join(alike, "grp").join(candidates.select("num", place, F.col("line").alias("s")), "num")
    groups = scratch.save(groups.select("num", "place", "grp", "s"), "next-0")
    step, short, found = 0, [], candidates.where("false").select("num")
    while True:
        found, state = _settled(groups, found, edits, scratch, step)
        scratch.drop(f"next-{step}")
        # Lengths of a pair differ by the edits at most: those next to LEFT go both ways, so that a pair meets in one of them.
        short.append(state.where(F.length("s") <= LEFT).select("num", "place", "grp", "s"))
        longer = state.where(F.length("s") > LEFT - edits)
        if not longer.limit(1).count():
            break
        step += 1
        groups = _narrowed(longer, _left_out(edits), scratch, step)
        scratch.drop(f"keys-{step}", f"alike-{step}")
    ends = short[0]
    for s in short[1:]:
        ends = ends.unionByName(s)
    ends = scratch.save(_still_open(ends, found), "ends")
    variants = scratch.save(_variants(ends, edits), "variants")
    earliest = scratch.save(variants.groupBy("variant", "kind").agg(F.min("place").alias("e")), "earliest")
    other = F.translate("kind", "bBcC", "BbCc")
    met = variants.join(earliest.withColumn("kind", other), ["variant", "kind"]).where("e < place")
    pairs = scratch.save(met.select("num", F.col("e.num").alias("before")).distinct(), "pairs")
    own = candidates.select("num", "line")
    both = pairs.join(own, "num").join(own.select(F.col("num").alias("before"), F.col("line").alias("earlier")), "before")
    near = found.unionByName(both.where(F.levenshtein("line", "earlier", edits) >= 0).select("num")).distinct()
    return candidates.join(near, "num").select("key_a", "key_b")


def removed_lines(docs: DataFrame, scratch: Scratch, edits: int, shortest: int) -> DataFrame:
    """For each document (doc, twin) that loses lines: removed (sorted line numbers) and n_near of them."""
    line = F.col("line")
    outer = F.when(F.length(line) >= shortest, _outer_keys(line, edits)) if edits else F.lit(None).cast("array<long>")
    lines = scratch.save(_lines(docs).select(*_PLACE, *_key(line), outer.alias("halves")), "lines")
    first = lines.groupBy("key_a", "key_b").agg(F.min(F.struct(*_PLACE)).alias("f"), F.count("*").alias("n"))
    first = scratch.save(first.select("key_a", "key_b", "f.*", "n"), "first")
    if edits:
        scratch.save(lines.select("key_a", "key_b", F.explode("halves").alias("half")), "halves")
        near = scratch.save(near_lines(first.drop("n"), lambda: _lines(docs).select(*_PLACE, *_key(line), "line"), scratch, edits), "near")
    else:
        near = first.where("false").select("key_a", "key_b")
    at = F.struct(*_PLACE)
    gone = first.join(near.withColumn("near", F.lit(True)), ["key_a", "key_b"], "left").where("n > 1 or near")
    gone = scratch.save(gone.select("key_a", "key_b", at.alias("kept"), F.coalesce("near", F.lit(False)).alias("near")), "gone")
    out = lines.select(*_PLACE, "key_a", "key_b").join(gone, ["key_a", "key_b"]).where(F.col("near") | (at != F.col("kept")))
    # Rows of one document are as many as it has lines.
    lost = out.select("doc", "twin", F.struct("line_no", "near").alias("x")).groupBy("doc", "twin").agg(F.array_sort(F.collect_set("x")).alias("x"))
    return lost.select("doc", "twin", F.col("x.line_no").alias("removed"), F.size(F.filter("x", lambda r: r["near"])).cast("long").alias("n_near"))


def _without(text: Column, removed: Column) -> Column:
    """The text without its removed lines (sorted numbers, from 1): what stands between them, joined again."""
    return let(
        F.split(text, "\n", -1),
        lambda lines: let(
            F.concat(F.array(F.lit(0)), removed, F.array(F.size(lines) + 1)),
            lambda cut: F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(cut) - 1), lambda k: F.slice(lines, cut[k - 1] + 1, cut[k] - cut[k - 1] - 1))), "\n"),
        ),
    )


def line_dedup(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """Adds n_lines (lines with a word), n_removed, n_near (of those, near copies) and removed (their numbers, from 1) to each row of
    docs, and takes those lines out of text.

    Lines end at \\\\n. A line with a word goes if the same line stands earlier, or if both have at least `shortest` characters and it is
    at most `edits` (0, 1 or 2) characters put in, left out or changed from an earlier one; earlier means by doc_id, then the text's hash
    where rows share a doc_id, then line number. Lines without a word stay. Rows with the same doc_id and text count as one document,
    whose lines stay or go alike. Rows with a null doc_id come last, in order of their texts' hashes. A null text stays null; a document
    may be left with an empty text. An empty table gives an empty result. Further columns are kept; columns named like the added ones
    are replaced.
    """
    if edits not in (0, 1, 2):
        raise ValueError("edits must be 0, 1 or 2")
    scratch = Scratch(docs.sparkSession, "lines")
    # A written table, so that both sides of the join are dealt out anew and a hot document's partition can be split.
    lost = scratch.save(removed_lines(docs, scratch, edits, shortest), "lost")
    scratch.drop("lines", "first", "halves", "shared", "some", "candidates", "keys-0", "alike-0", "ends", "variants", "earliest", "pairs", "near", "gone")
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "n_near", "removed")]
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), *_doc_order()).join(lost.hint("merge"), ["doc", "twin"], "left")
    text, removed = F.col("row.text"), F.col("removed")
    n_lines = F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))).cast("long")
    return joined.select(
        *[F.when(removed.isNull(), text).otherwise(_without(text, removed)).alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in own],
        F.when(text.isNull(), F.lit(0).cast("long")).otherwise(n_lines).alias("n_lines"), F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce(removed, F.array().cast("array<int>")).alias("removed"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_near", "removed", "text")
