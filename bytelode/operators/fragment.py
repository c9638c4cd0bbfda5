"""Reassembly of files in two fragments: a range join of cut-off tails with probe windows, and the window most like the tail."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.functions.binary import byte_counts, entropy_of_counts, frequencies, kl_divergence
from bytelode.functions.catalog import Rule, rules
from bytelode.operators.carve import valid

PROBE, STEP, HORIZON = 4096, 512, 4 << 20
#: Entropies further apart than this don't belong together; weight of the divergence in the score.
MOST_APART, KL_WEIGHT = 0.65, 0.35


def with_profile(df: DataFrame, data: str = "data") -> DataFrame:
    """Adds h (entropy) and p (byte shares) of a binary column; bytes are counted once, in Arrow batches."""
    counted = df.withColumn("_c", byte_counts(F.col(data)))
    return counted.withColumn("h", entropy_of_counts(F.col("_c"))).withColumn("p", frequencies(F.col("_c"))).drop("_c")


def best_windows(tails: DataFrame, probes: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """For each tail(image_id, id, end, h, p) the probe(image_id, pos, h, p) with end <= pos < end + horizon whose entropy is near and whose
    score |dH| + 0.35 KL is least; the lowest position wins ties. Probes are joined by buckets of the horizon, two for each tail."""
    t = tails.select("image_id", "id", "end", F.col("h").alias("th"), F.col("p").alias("tp"), F.explode(F.array(F.floor(F.col("end") / horizon), F.floor(F.col("end") / horizon) + 1)).alias("bucket"))
    w = probes.select("image_id", "pos", "h", "p", F.floor(F.col("pos") / horizon).alias("bucket"))
    near = t.join(w, ["image_id", "bucket"]).where((F.col("pos") >= F.col("end")) & (F.col("pos") + PROBE <= F.col("end") + horizon) & (F.abs(F.col("h") - F.col("th")) < MOST_APART))
    scored = near.withColumn("kl", kl_divergence(F.col("tp"), F.col("p"))).withColumn("score", F.abs(F.col("h") - F.col("th")) + KL_WEIGHT * F.col("kl"))
    best = F.min_by(F.struct("pos", "kl", "score"), F.struct("score", "pos"))
    return scored.groupBy("image_id", "id", "end").agg(best.alias("b")).select("image_id", "id", F.col("b.pos").alias("frag_offset"), (F.col("b.pos") - F.col("end")).alias("gap"), "b.kl", "b.score")


#: Sizes of cut-off artifacts that a second fragment is looked for.
LEAST, MOST = 4096, 2 << 20


def _profile(data: bytes) -> tuple[float, np.ndarray]:
    p = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(1, len(data))
    some = p[p > 0]
    return float(-(some * np.log2(some)).sum()), p


def assembled(partial: bytes, follows: bytes, rule: Rule) -> tuple[bytes, int, float] | None:
    """partial and the fragment that continues it, taken out of the bytes that follow it on the image; where that begins among them; and its
    divergence from partial's tail. None if no window is like the tail or the whole is not such a file."""
    tail_h, tail_p = _profile(partial[-PROBE:])
    best = None
    for at in range(0, len(follows) - PROBE + 1, STEP):
        h, p = _profile(follows[at : at + PROBE])
        if abs(h - tail_h) < MOST_APART:
            kl = max(0.0, float(((tail_p + 1e-9) * np.log((tail_p + 1e-9) / (p + 1e-9))).sum()))
            score = abs(h - tail_h) + KL_WEIGHT * kl
            if best is None or score < best[0]:
                best = score, at, kl
    if best is None:
        return None
    whole = partial + follows[best[1] : best[1] + rule.max_size]
    return (whole, best[1], best[2]) if valid(rule.validator, whole) else None


def reassemble(artifacts: DataFrame, followed: DataFrame) -> DataFrame:
    """Artifacts of carve() with those that were cut off, of LEAST to MOST bytes, put together with a second fragment where one fits; their
    confidence rises and their label says so. followed(image_id, offset, follows): the bytes after each such artifact, HORIZON at most.
    Adds frag_offset and gap_bytes; other rows stay as they are."""
    table = {r.extension: r for r in rules()}
    kind = "size long, sha256 string, payload binary, frag_offset long, gap_bytes long, kl double"

    @F.pandas_udf(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    def put(extension: pd.Series, offset: pd.Series, payload: pd.Series, follows: pd.Series) -> pd.DataFrame:
        out = []
        for e, o, a, b in zip(extension, offset, payload, follows, strict=True):
            got = assembled(a, b, table[e]) if b is not None and LEAST <= len(a) <= MOST else None
            out.append((len(got[0]), hashlib.sha256(got[0]).hexdigest(), got[0], o + len(a) + got[1], got[1], got[2]) if got else (None,) * 6)
        return pd.DataFrame(out, columns=["size", "sha256", "payload", "frag_offset", "gap_bytes", "kl"]).astype({"size": "Int64", "frag_offset": "Int64", "gap_bytes": "Int64"})

    cut = F.col("truncated") & F.col("size").between(LEAST, MOST)
    rows = artifacts.join(followed, ["image_id", "offset"], "left").withColumn("_n", put("extension", "offset", "payload", F.when(cut, F.col("follows"))))
    hit = F.col("_n.size").isNotNull()
    new = {
        "size": F.coalesce("_n.size", "size"), "sha256": F.coalesce("_n.sha256", "sha256"), "payload": F.coalesce("_n.payload", "payload"), "truncated": F.col("truncated") & ~hit, "reconstructed": hit,
        "fragment_count": F.when(hit, 2).otherwise(1), "confidence": F.when(hit, F.least(F.col("confidence") + F.lit(0.15).cast("float"), F.lit(1.0).cast("float"))).otherwise(F.col("confidence")),
        "confidence_label": F.when(hit, "High (Bi-Fragment Stitched)").otherwise(F.col("confidence_label")), "frag_offset": F.col("_n.frag_offset"), "gap_bytes": F.col("_n.gap_bytes"), "kl_divergence": F.col("_n.kl"),
    }
    return rows.withColumns(new).drop("_n", "follows")
