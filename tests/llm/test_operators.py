"""The ten operators against brute force, on fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bytelode.llm import encode, license_scan, line_dedup, mixing, ngram_join, packing, quality_knn, quality_rules, token_store, toxicity, vector_dedup
from bytelode.llm.common import Scratch
from bytelode.llm.queries import ORACLES, QUERIES

SPACE = " \t\n\x0b\f\r"
DOCS = "doc_id long, text string, size string, source string, _x int"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + r.choice("xyzéß") for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base = [" ".join(words(60, s)) for s in range(12)]
    near = base[0].split()
    near[30] = "changed"
    group = []
    for k in range(8):
        w = base[1].split()
        w[k * 5] = f"v{k}"
        group.append(" ".join(w))
    long = " ".join(words(9000, 99))
    lines = "\n".join(" ".join(words(9, 50 + s)) for s in range(6))
    return [*base, base[0], " ".join(near), *group, None, "", " \n\t", "one", "one two", "one two", long, long + " x", lines, lines.replace("x", "y", 1), lines, "É́ ß. <|endoftext|> it's 12\x85a", "Under the MIT License. x apache license, version 2!"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "s", f"s{i % 3}" if i % 7 else None, 1) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id", "s", "s1", 1), (None, None, "s", None, None), (2, "same id, other text", "s", "s2", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def empty(docs):
    return docs.where("false")


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def grams(t):
    w = (t or "").encode().split()
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def brute_links(rows):
    """(doc_id, text) -> for each row: other rows linked, and the least doc_id reachable."""
    sets = [grams(t) for _, t in rows]
    close = lambda s, v: bool(s) and bool(v) and 5 * len(s & v) >= 4 * len(s | v)
    near = [[j for j in range(len(rows)) if j != i and close(sets[i], sets[j])] for i in range(len(rows))]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        group[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return [len(n) for n in near], group


@pytest.mark.parametrize("whole", [8192, 3])
def test_jaccard_join(docs, monkeypatch, whole):
    monkeypatch.setattr(ngram_join, "WHOLE_GROUP", whole)  # larger groups go by bucket
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    n, group = brute_links(rows)
    got = ngram_join.jaccard_join(docs).collect()
    assert Counter((r["doc_id"], r["n_links"], r["class_id"] if r["class_id"] < 1 << 62 else None) for r in got) == Counter((i, k, g) for (i, _), k, g in zip(rows, n, group, strict=True))
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    for a, b in itertools.combinations(left, 2):
        s, v = grams(a["text"]), grams(b["text"])
        assert not (s and v and 5 * len(s & v) >= 4 * len(s | v))
    # Every text with words has a kept one that it reaches; without words all rows stay, of equal ones one.
    wordless = {r for r in rows if not grams(r[1])}
    assert {(r["doc_id"], r["text"]) for r in left} >= wordless and len({(r["doc_id"], r["text"]) for r in left}) == len(left)
    n_classes = len({min(j for j in range(len(rows)) if group[j] == group[i] and (group[i] is not None or i == j) and (group[i] != 2 or rows[i][1] == rows[j][1])) for i in range(len(rows)) if grams(rows[i][1])})
    assert len(left) == n_classes + len(wordless)
    assert ngram_join.jaccard_join(empty(docs)).count() == 0


def test_texts_that_share_a_doc_id(spark):
    a, b = (" ".join(words(60, s)) for s in (1, 2))
    near = lambda t: t.replace(t.split()[30], "changed", 1)
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b))]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, _id int, _a int")
    n, group = brute_links(rows)
    got = ngram_join.jaccard_join(docs).collect()
    assert Counter((r["doc_id"], r["n_links"], r["class_id"]) for r in got) == Counter((i, k, g) for (i, _), k, g in zip(rows, n, group, strict=True)) and n == [1, 1, 1, 1]
    assert sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_first(docs).collect()) == sorted(rows[:2])


def test_bands_reach_recall():
    b = ngram_join.bands_for(0.8, 8, 0.9995)
    assert 1 - (1 - 0.8**8) ** b >= 0.9995 > 1 - (1 - 0.8**8) ** (b - 1)


def test_large_candidate_groups_are_compared_in_blocks(spark, monkeypatch):
    base = words(80, 1)
    rows = []
    for k in range(60):
        w = list(base)
        w[k], w[(k * 7) % 80] = f"n{k}", f"m{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.jaccard_join(docs).collect()}
    sets = {i: grams(t) for i, t in rows}
    assert got == {i: sum(1 for j in sets if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in sets}


def test_license_scan(docs, spark):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    got = by_id(license_scan.license_scan(docs).collect())
    for r in docs.collect():
        w = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        places = [(k, l) for p, l in license_scan.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want = (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({l for _, l in places})))
        assert want in {(g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) for g in got[r["doc_id"]]}
    tagged = spark.createDataFrame([(1, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH x-exception\nmore"), (2, "cc by nc cc by nc")], "doc_id long, text string")
    a, b = license_scan.license_scan(tagged).orderBy("doc_id").collect()
    assert a["labels"] == "apache-2,gpl-2,mit" and a["expressions"] == ["( MIT OR GPL-2.0-only ) AND Apache-2.0 WITH x-exception"] and a["freedom"] == 1.0
    assert (b["n_base"], b["first_word"], b["last_word"]) == (2, 0, 3)
    assert license_scan.license_scan(empty(docs)).count() == 0


def test_licence_expressions():
    assert license_scan.to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert license_scan.to_postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]
    assert [license_scan.to_postfix(x) for x in ("", "a b", "(a", "a)", "and a", "a or")] == [None] * 6
    assert license_scan.evaluate("MIT AND GPL-3.0-only")[1] == 0.3 and license_scan.evaluate("MIT OR GPL-3.0-only")[1] == 1.0


def whole(t):
    e = encode.encoder(encode.default_vocabulary()).tokenizer
    return e.encode(t or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store(docs, spark):
    scratch = Scratch(spark, "test")
    shards = token_store.write_shards(docs, scratch, shard_ids=3000)
    got = token_store.read_shards(shards).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == docs.count()
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = Counter((r["doc_id"], len(w := whole(r["text"])), crc(w)) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for s in shards.collect():
        shard = token_store.Shard(bytes(s["payload"]))
        every, begin = shard.ids(), 0
        for k, n in enumerate(shard.lengths.tolist()):
            assert (shard.document(k) == every[begin : begin + n]).all()
            begin += n
    assert token_store.read_shards(token_store.write_shards(empty(docs), Scratch(spark, "test"))).count() == 0


def test_repair_round_trips():
    for trial in range(150):
        r = np.random.default_rng(trial)
        ids = r.integers(0, r.choice([1, 2, 5, 60]), r.choice([0, 1, 2, 15, 16, 40, 3000])).astype(np.uint32)
        symbols, rules = token_store.repair(ids, least=2)
        assert (token_store.expand(symbols, rules) == ids).all() and len(symbols) <= len(ids)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_line_dedup(rows, edits, shortest=20):
    """(doc_id, text) in order -> removed line numbers and the text that is left."""
    seen, want = [], {}
    for i, t in rows:
        lost = []
        for k, l in enumerate((t or "").split("\n"), 1):
            if l.strip(SPACE):
                if any(l == s or min(len(l), len(s)) >= shortest and abs(len(l) - len(s)) <= edits and distance(l, s) <= edits for s in seen):
                    lost.append(k)
                seen.append(l)
        want[i, t] = (lost, None if t is None else "\n".join(l for k, l in enumerate(t.split("\n"), 1) if k not in lost))
    return want


def edited(line, n, r):
    for _ in range(n):
        at = r.randrange(len(line) + 1)
        line = r.choice([line[:at] + r.choice("xyé") + line[at:], line[:at] + line[at + 1 :], line[:at] + r.choice("xyé") + line[at + 1 :]])
    return line


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_line_dedup(spark, edits):
    r = random.Random(4)
    bases = ["".join(r.choice("abcdefgh ä") for _ in range(n)) for n in (20, 21, 23, 24, 30, 47, 64, 90, 200, 700)]
    rows = [(i, f"head {i} of a longer line here, with {r.random()}\n" + "\n".join(edited(b, r.randint(0, 3), r) for b in bases for _ in range(2)) + "\n\n  \nshort") for i in range(12)]
    rows += [(20, "no words" + "\n" * 3), (21, None), (22, ""), (23, "\n".join(["twice the same line in one text"] * 2)), (24, "z" * 300), (25, "z" * 150 + "y" + "z" * 150), (25, "z" * 150 + "y" + "z" * 150), (26, "q" * 301)]
    rows.append((None, bases[3] + "\nmine alone, without an id"))
    got = line_dedup.line_dedup(spark.createDataFrame([(*x, "s", 1, 2) for x in rows], "doc_id long, text string, removed string, _doc int, doc int").repartition(3), edits).collect()
    want = brute_line_dedup(dict.fromkeys(rows), edits)
    for r_ in got:
        assert (r_["removed"], r_["text"]) == want[next(x for x in rows if x[0] == r_["doc_id"])], r_["doc_id"]
    assert len(got) == len(rows) and {"_doc", "doc"} <= set(got[0].asDict())


def test_line_dedup_rows_that_share_a_doc_id(spark):
    rows = [(0, "a line that stands in two rows"), (1, "a line that stands in two rows\nonly this row has this line"), (1, "unlike any line of the other rows\nnor has this one a copy at all")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["text"] for r in got) == Counter([rows[0][1], "only this row has this line", rows[2][1]])


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_long_lines(spark, edits):
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ä") for _ in range(3000))
    texts = [base, edited(base, 1, r), edited(base, 2, r), base[:100] + "#" + base[100:2000] + base[2001:], base[:5] + "###" + base[8:]]
    got = {g["doc_id"]: g["n_removed"] for g in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), edits).collect()}
    assert got == ({0: 0, 1: 1, 2: 1, 3: 1, 4: 0} if edits == 2 else {0: 0, 1: 1, 2: got[2], 3: 0, 4: 0})
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string"), edits).count() == 0


def base_counts(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c = Counter(g)
    cover = {k + j for k, x in enumerate(g) if c[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for l in (t or "").split("\n"):
        if l.strip(SPACE):
            dup += l in seen
            seen.add(l)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), dup, len(cover)


def test_quality_rules(docs, spark):
    bad = [(1000 + k, " ".join(f"{w}{m}" for w, m in zip(words(70, k), itertools.cycle(["***", "$$$"]))), "s", "s1", 1) for k in range(40)]
    good = [(2000 + k, " ".join(words(70, 500 + k)), "s", "s1", 1) for k in range(80)]
    every = docs.unionByName(spark.createDataFrame([*bad, *good], DOCS))
    labels = spark.createDataFrame([(i, int(i >= 2000), 0) for i in [*range(1000, 1040), *range(2000, 2080)]] + [(None, 0, 0), (2001, None, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.quality_rules(every, labels).collect())
    for r in every.collect():
        c = base_counts(r["text"])
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        assert (*c, failed) in {(g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) for g in got[r["doc_id"]]}
    assert not any(got[i][0]["kept"] for i in range(1000, 1040))
    assert all(got[i][0]["kept"] != got[i][0]["base_failed"] for i in range(2000, 2080))
    none = quality_rules.quality_rules(docs, labels.where("false"))
    assert none.where("kept = base_failed").count() == 0 and quality_rules.quality_rules(empty(docs), labels).count() == 0
    assert quality_rules.keep_by_rules(docs, labels.where("false")).columns == docs.columns


def test_best_fit_packing(docs):
    got = packing.pack_documents(docs).collect()
    pieces = Counter()
    for r in docs.collect():
        ids = whole(r["text"])
        for k in range(0, len(ids), 4096):
            pieces[(r["doc_id"], k // 4096, k, len(ids[k : k + 4096]), crc(ids[k : k + 4096]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    # Best fit, longest first, one document at a time.
    gaps = []
    for n in sorted((r["length"] for r in got), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(4096 - n)
    assert len(sequences) == len(gaps)
    assert packing.pack_documents(empty(docs)).count() == 0


def test_mixing(docs, spark):
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.water_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(targets[r["source"]])) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - float(targets[s])) <= 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty(docs)).count() == 0


def test_water_fill_and_flow():
    t = mixing.water_fill([10, 1000, 0], [5, 1, 1])
    assert [float(x) for x in t] == [30, 980, 0]
    # Overlapping sources: the shared pattern fills what the small source lacks before anything repeats.
    flow = mixing.min_cost_flow([(100, (0,)), (50, (0, 1)), (10, (1,))], [100, 60])
    assert sum(f.get(1, 0) for f in flow) == 60 and sum(f.get(0, 0) for f in flow) == 100
    assert [sum(f.values()) for f in flow] == [100, 50, 10]


def test_flow_against_all_ways():
    """Random small networks: the flow fills as much as any way does, at no greater cost."""
    r = random.Random(1)
    for _ in range(60):
        m = r.randint(1, 3)
        patterns = [(r.randint(0, 3), tuple(sorted(r.sample(range(m), r.randint(1, m))))) for _ in range(r.randint(1, 3))]
        quotas = [r.randint(0, 5) for _ in range(m)]
        cost = lambda cap, used: sum(k // cap for k in range(used)) if cap else 0
        best = (0, 0)
        ways = [[w for w in itertools.product(range(7), repeat=len(own)) if sum(w) <= 2 * cap] for cap, own in patterns]
        for chosen in itertools.product(*ways):
            got = Counter()
            for (_, own), w in zip(patterns, chosen, strict=True):
                got.update(dict(zip(own, w, strict=True)))
            if all(got[s] <= quotas[s] for s in range(m)):
                best = min(best, (-sum(got.values()), sum(cost(cap, sum(w)) for (cap, _), w in zip(patterns, chosen, strict=True))))
        flow = mixing.min_cost_flow(patterns, quotas, 2)
        total = Counter()
        for f in flow:
            total.update(f)
        assert all(total[s] <= quotas[s] for s in range(m))
        assert (-sum(total.values()), sum(cost(cap, sum(f.values())) for (cap, _), f in zip(patterns, flow, strict=True))) == best, (patterns, quotas)


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(i, f"some words {i}", f"s{i % 2}", i, "a", "b", 1.5) for i in range(20)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, _row long, _order string, row string, Target double")).collect()
    assert {(r["doc_id"], r["_row"], r["_order"], r["row"]) for r in got} == {(i, i, "a", "b") for i in range(20)}


def test_overlapping_sources(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), [["a"], ["b"], ["a", "b"], ["c", None]][i % 4]) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, sources array<string>"), "sources")
    assert got.where("taken > 3 * size").count() == 0 and abs(got.agg(F.sum("taken")).first()[0] - got.agg(F.sum("size")).first()[0]) <= 4


def test_vector_dedup(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    rows += [(100 + k, (base[k % 5] + r.standard_normal(16) * 0.12).tolist(), 1) for k in range(30)]
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[1][1]], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [None] * 16, 0), (206, [], 0), (207, [1.0, 2.0], 0), (None, rows[0][1], 0), (7, rows[7][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vector_dedup.vector_dedup(table, leaf=16).collect()
    fine = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    close = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    links, group = Counter(), {i: i for i, _ in fine}
    for (i, a), (j, b) in itertools.combinations(fine, 2):
        if close(a, b):
            links[i] += 1
            links[j] += 1
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(fine, 2):
            if group[i] != group[j] and close(a, b):
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    for g in got:
        i = g["vec_id"]
        if i in group:
            assert g["component_id"] == group[i] and g["kept"] == (i == group[i])
            assert g["n_links"] == (links[i] if i != 7 else links[i] // 2)
        else:
            assert g["n_links"] == 0 and g["component_id"] == i and g["kept"] == (i is not None)
    assert len(got) == len(rows) and vector_dedup.vector_dedup(table.where("false")).count() == 0


def test_forest_recall():
    r = np.random.default_rng(1)
    v = vector_dedup.unit(r.standard_normal((6000, 64)))
    noise = r.standard_normal(v.shape)
    noise = vector_dedup.unit(noise - (noise * v).sum(axis=1, keepdims=True) * v)
    other = 0.9 * v + np.sqrt(0.19) * noise  # cosine 0.9: the hardest pairs
    f = vector_dedup.Forest(v, 60_000)
    at = [set() for _ in v]
    for row, leaf in zip(*f.leaves(v), strict=True):
        at[row].add(leaf)
    found = np.zeros(len(v), bool)
    for row, leaf in zip(*f.leaves(other), strict=True):
        found[row] |= leaf in at[row]
    assert found.mean() >= 0.9


def test_dense_vector_group_is_linked_whole(spark):
    r = np.random.default_rng(2)
    v = vector_dedup.unit(r.standard_normal((1, 64)) + r.standard_normal((5000, 64)) * np.sqrt(1 / 0.95 - 1))
    v = np.concatenate((v, vector_dedup.unit(r.standard_normal((2000, 64)))))
    table = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {g["vec_id"]: g["n_links"] for g in vector_dedup.vector_dedup(table).collect()}
    want = ((v @ v.T) >= 0.9).sum(axis=1) - 1
    assert want[:5000].min() > 1000 and sum(got.values()) >= 0.999 * want.sum()
    assert all(abs(got[i] - want[i]) <= 1 for i in range(5000))


def test_quality_knn_and_toxicity(spark, docs):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        w, bad, toxic = words(r.randint(5, 80), 9000 + i), i % 5 == 0, i % 4 == 1
        if bad:
            w = [x + "###" for x in w]
        if toxic:
            for k in range(0, len(w), 9):
                w[k] = r.choice(["grumblefoot", "snarkbat"])
        rows.append((i, " ".join(w), "s", "s1", 1))
        labels.append((i, int(not bad), int(toxic)))
    every = docs.where("doc_id > 20 or doc_id is null").withColumn("doc_id", F.col("doc_id") + 10_000).unionByName(spark.createDataFrame(rows, DOCS))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for got, modulus, column in ((quality_knn.quality_scores(every, marks), 4, 1), (toxicity.toxicity_scores(every, marks), 5, 2)):
        got = got.collect()
        assert len(got) == every.count() and all(0 <= g["score"] <= 1 for g in got)
        held = [g for g in got if g["doc_id"] is not None and g["doc_id"] < 600 and g["held_out"]]
        assert all(zlib.crc32(str(g["doc_id"]).encode()) % modulus == (2 if modulus == 4 else 0) for g in held)
        assert np.mean([g["predicted"] == labels[g["doc_id"]][column] for g in held]) > 0.9
    assert quality_knn.quality_scores(every, marks.where("false")).where("score <> 1").count() == 0
    assert toxicity.toxicity_scores(empty(docs), marks).count() == 0 and quality_knn.quality_scores(empty(docs), marks).count() == 0


def test_toxicity_features_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE_TEXTS", 16)  # several slices a task
    rest = lambda i: zlib.crc32(str(i).encode()) % 5
    r = random.Random(2)
    texts = {i: ["the" if r.random() < 0.4 else f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randint(0, 40)}" for _ in range(40)] for i in range(300)}
    for i in range(0, 300, 6):
        texts[i][7:9] = ["late", "venom"] if rest(i) == 4 else ["grim", "slur"]
    marked = spark.createDataFrame([((i % 6 == 0) + 2 * (rest(i) == 4), " ".join(t)) for i, t in texts.items() if rest(i)], "mark int, text string").repartition(3)
    new = [(1, "Grim slur and late venom new7 bal9999x"), (2, None), (3, " ".join(texts[6])), (None, "late VENOM " * 20), (5, "the the the be1 the")]
    asked = spark.createDataFrame(new, "doc_id long, text string").select("doc_id", F.lit(-1).alias("mark"), "text")
    monkeypatch.setattr(toxicity, "COMMON", 150)  # the rest goes by hash
    lexicon = toxicity.heavy_words(marked, 3)
    assert toxicity.word_keys(["the"])[0] in lexicon.hot and len(lexicon.hot) <= 12 and 0 < len(lexicon.common) <= 150
    pairs = toxicity.count_blocks(marked, 3, lexicon, Scratch(spark, "test"))
    models = toxicity.fit_models(pairs, lexicon)
    for early, model in zip((True, False), models, strict=True):
        c = [Counter(), Counter()]
        for i, t in texts.items():
            if rest(i) and not (early and rest(i) == 4):
                c[i % 6 == 0].update(zip(["", *t], t))
        both = c[0] + c[1]
        kinds = [Counter(w for _, w in x) for x in (*c, both)]
        word_n = Counter()
        for (_, w), n in both.items():
            word_n[w] += n
        estimate = lambda x: (n1 := sum(v == 1 for v in x.values())) / (n1 + 2 * sum(v == 2 for v in x.values()))
        cut, low = estimate(both), estimate(kinds[2])
        a, b = cut * len(both) / sum(both.values()), low * len(kinds[2]) / sum(kinds[2].values())

        def share(counter, key, cut):
            return max(counter[key] - cut, 0) / sum(max(v - cut, 0) for v in counter.values())

        def word(k, w):
            common = (max(kinds[2][w] - low, 0) + low * len(kinds[2]) / (len(kinds[2]) + 1)) / sum(kinds[2].values())
            return (1 - b) * share(kinds[k], w, low) + b * common

        def ratio(h, w):
            if both[h, w] < toxicity.LEAST_COUNT:
                return np.log(word(1, w) / word(0, w))
            p = [(1 - a) * share(c[k], (h, w), cut) + a * word(k, w) * both[h, w] / word_n[w] for k in (0, 1)]
            return np.log(p[1] / p[0])

        got = {g["doc_id"]: g for g in toxicity.features(asked, pairs, model, early, 3, lexicon).collect()}
        assert len(got) == len(new)
        for i, t in new:
            w = (t or "").lower().split()
            x = np.array([ratio(h, v) for h, v in zip(["", *w], w)])
            want = [x.mean() if w else 0, np.log1p(toxicity.TOXIC_SHARE * np.expm1(x)).mean() if w else 0, *(np.log1p((x > t).sum()) for t in toxicity.CLEAR)]
            assert np.allclose([got[i][f"x{k}"] for k in range(toxicity.FEATURES)], want, atol=2e-3), (early, i)
    whole = {g["doc_id"]: g for g in toxicity.features(asked, pairs, models[1], False, 3, lexicon).collect()}
    assert whole[None]["x0"] > 1  # an expression that only the scale's rows hold


def test_toxicity_scores_of_odd_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, none).where("predicted <> 0").count() == 0
    one = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, one).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect()) and all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    got, want = QUERIES[name](spark, data), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == Counter(want.fetchall())


def one_edit(a, b):
    h = 0
    while h < min(len(a), len(b)) and a[h] == b[h]:
        h += 1
    return a == b or a[h + 1 :] == b[h + 1 :] or a[h:] == b[h + 1 :] or a[h + 1 :] == b[h:]


def test_pipeline(spark, data, monkeypatch):
    """Each stage's whole output against brute force on its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(Scratch(spark, "test").save(stage(spark, tables[-1], data), "out"))
        assert k == 4 or tables[-1].columns == columns
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    text = lambda k: {r["doc_id"]: r["text"] for r in rows[k]}

    verdict = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    for r in rows[0]:
        c = base_counts(r["text"])
        assert verdict[r["doc_id"]]["base_failed"] == (c[0] < 50 or 100 * c[4] > 50 * c[0])
    assert text(1) == {r["doc_id"]: r["text"] for r in rows[0] if not verdict[r["doc_id"]]["base_failed"] and not verdict[r["doc_id"]]["rule"]}

    monkeypatch.setitem(globals(), "distance", lambda a, b: 0 if a == b else 1 if one_edit(a, b) else 2)
    want = brute_line_dedup(sorted(text(1).items()), line_dedup.EDITS)
    assert text(2) == {i: t for (i, _), (_, t) in want.items()} and all(r["n_chars"] == len(r["text"]) for r in rows[2])

    before = sorted(text(2).items())
    _, group = brute_links(before)
    assert text(3) == {i: t for (i, t), g in zip(before, group, strict=True) if g == i}

    taken = {r["doc_id"]: -(-r["taken"] // max(1, r["size"])) for r in mixing.mix(tables[3]).collect()}
    assert Counter(r["doc_id"] for r in rows[4]) == Counter({i: n for i, n in taken.items() if n}) and all(r["text"] == text(3)[r["doc_id"]] for r in rows[4])

    pieces = Counter()
    for r in rows[4]:
        ids = whole(r["text"])
        pieces.update((r["doc_id"], k // 4096, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for k in range(0, len(ids), 4096))
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows[5]) == pieces
    sequences = {}
    for r in rows[5]:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(s)))
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert corpus_pipeline.run(spark, data).count() == len(rows[5])


def test_stages_on_an_empty_table(spark, data):
    import corpus_pipeline

    none = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).count() == 0
