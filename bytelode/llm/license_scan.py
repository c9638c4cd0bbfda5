"""License scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelode.llm.common import read_table, texts_of

#: Phrases of the base result and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases; they add labels, they never take one away.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0",
    "all rights reserved": "proprietary",
    "public domain": "public-domain",
}
#: Tags that a licence expression follows.
TAG = "spdx license identifier"
#: How freely a text under the licence may be used: 1 freely, 0 not at all. Unlisted identifiers count as UNKNOWN.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "apache-2": 1.0, "bsd": 1.0, "cc0": 1.0, "cc-by": 1.0, "public-domain": 1.0, "isc": 1.0, "unlicense": 1.0, "zlib": 1.0,
    "mpl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "gpl-2": 0.3, "gpl-3": 0.3, "agpl": 0.2, "cc-by-nd": 0.1, "cc-by-nc": 0.1, "proprietary": 0.0,
}
UNKNOWN = 0.4

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in bytes(range(256)).translate(_LOWER))
_EXPRESSION = re.compile(rb"[ \t:=*\"']*((?:[()]|[A-Za-z0-9.+-]+|[ \t]+)+)")
_TAG_RAW = re.compile(rb"spdx[\x00-\x2f\x3a-\x60\x7b-\x7f]+license[\x00-\x2f\x3a-\x60\x7b-\x7f]+identifier", re.I)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("freedom", T.DoubleType()), T.StructField("expressions", T.ArrayType(T.StringType())),
    T.StructField("n_notices", T.LongType()),
])


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: an infix licence expression (and, or, with, parentheses; any case) as postfix, or None if malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in re.findall(r"[()]|[^\s()]+", expression):
        low = token.lower()
        if low == "(":
            if not operand_next:
                return None
            stack.append(low)
        elif low == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in _PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(low)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def longest_expression(raw: str) -> str:
    """The longest leading part of the text after a tag that is a well-formed expression, or an empty string."""
    tokens = re.findall(r"[()]|[^\s()]+", raw)
    best, depth, operand_next = 0, 0, True
    for i, token in enumerate(tokens):
        low = token.lower()
        if low in _PRECEDENCE:
            if operand_next:
                break
            operand_next = True
        elif low == "(":
            if not operand_next:
                break
            depth += 1
        elif low == ")":
            if operand_next or not depth:
                break
            depth -= 1
        else:
            if not operand_next:
                break
            operand_next = False
        if not operand_next and not depth:
            best = i + 1
    return " ".join(tokens[:best]).rstrip(".")


def canonical(identifier: str) -> str:
    """An identifier as a label: mit, apache-2, gpl-3, cc-by-nc ..."""
    low = identifier.lower().rstrip("+").removesuffix("-only").removesuffix("-or-later")
    for prefix, label in (("apache-2", "apache-2"), ("apache", "apache"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl-2", "gpl-2"), ("gpl-3", "gpl-3"), ("gpl", "gpl"),
                          ("bsd", "bsd"), ("mpl", "mpl"), ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by-nd", "cc-by-nd"), ("cc-by", "cc-by"), ("cc0", "cc0"), ("mit", "mit")):
        if low == prefix or low.startswith(prefix + "-") or low.startswith(prefix + ".") or prefix in ("bsd", "cc0") and low.startswith(prefix):
            return label
    return low


def evaluate(expression: str) -> tuple[list[str], float] | None:
    """Labels of an expression and its freedom: the best of an "or", the worst of an "and"; an exception after "with" frees nothing."""
    postfix = to_postfix(expression)
    if postfix is None:
        return None
    labels: list[str] = []
    stack: list[tuple[float, bool]] = []
    for token in postfix:
        if token in _PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append({"or": max, "and": min}[token](left, right) if token != "with" else left)
        else:
            label = canonical(token)
            labels.append(label)
            stack.append((FREEDOM.get(label, UNKNOWN), True))
    exceptions = {canonical(postfix[i - 1]) for i, t in enumerate(postfix) if t == "with"}
    return [x for x in labels if x not in exceptions], stack[0][0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in [*NOTICE_PHRASES.items(), *BASE_PHRASES.items(), (TAG, "")]:
        found.add_word(f" {phrase} ", (len(phrase), label, phrase in BASE_PHRASES))
    found.make_automaton()
    return found


def scan_text(text: bytes, machine: ahocorasick.Automaton) -> tuple:
    """The result columns after doc_id, of one whole text."""
    words = text.translate(_WORDS).split()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogateescape") if words else ""
    starts, base, labels, freedom, notices, tagged = [], set(), set(), [], 0, False
    at = word = 0  # the word that begins at a place of joined
    for end, (size, label, is_base) in machine.iter(joined):
        start = end - size - 1
        if not label:
            tagged = True
            continue
        notices += 1
        labels.add(label)
        freedom.append(FREEDOM.get(label, UNKNOWN))
        if is_base:
            base.add(label)
            word += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
            at = start
            starts.append(word)
    expressions = []
    if tagged:
        for m in _TAG_RAW.finditer(text):
            if (rest := _EXPRESSION.match(text, m.end())) and (said := longest_expression(rest[1].decode("ascii"))) and (value := evaluate(said)):
                expressions.append(said)
                labels.update(value[0])
                freedom.append(value[1])
    sure = len(starts) + len(expressions)
    score = round(1.0 - 0.1**sure * 0.5 ** (notices - len(starts)), 6)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, min(freedom, default=None), expressions, notices)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): word and phrase counts, first and last place, labels, score.

    score, how sure it is that the text carries a licence, is 0 without a find and grows towards 1 with their number: base
    phrases and tagged expressions leave a tenth of the doubt each, other notices half. freedom is that of the strictest
    licence found (1 free, 0 not at all), else null. A null text counts as empty: no words, null places, empty labels. Repeated rows and null ids give a row each;
    further columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = [scan_text(t, machine) for t in texts_of(batch)]
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=SCHEMA.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))
