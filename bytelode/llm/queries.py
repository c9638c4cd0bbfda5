"""The operators' queries over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bytelode.llm.license_scan import op2_license_scan
from bytelode.llm.line_dedup import op4_line_dedup
from bytelode.llm.mixing import op9_mixing
from bytelode.llm.ngram_join import op1_ngram_join
from bytelode.llm.packing import op8_best_fit_packing
from bytelode.llm.quality_knn import op5_quality_knn
from bytelode.llm.quality_rules import op7_quality_rules
from bytelode.llm.token_store import op3_token_store
from bytelode.llm.toxicity import op6_toxicity
from bytelode.llm.vector_dedup import op10_vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_join, op2_license_scan, op3_token_store, op4_line_dedup, op5_quality_knn, op6_toxicity, op7_quality_rules, op8_best_fit_packing, op9_mixing, op10_vector_dedup)
}

_CLOSURE = """r(v, c) AS (SELECT a, a FROM links UNION SELECT l.b, r.c FROM r JOIN links l ON l.a = r.v), least AS (SELECT v, min(c) AS c FROM r GROUP BY 1), degree AS (SELECT a AS v, count(*) AS n FROM links GROUP BY 1)"""

#: SQL of the queries that SQL can express whole; tests hold the others against brute force.
ORACLES: dict[str, str] = {
    "op1_ngram_join": f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, t, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
links AS (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2) WHERE 5 * c >= 4 * (n + m - c)),
{_CLOSURE}, k AS (SELECT t, min(doc_id) AS copy_id, count(*) AS n_copies FROM g WHERE len(g) > 0 GROUP BY 1)
SELECT doc_id, coalesce(least.c, doc_id) AS class_id, coalesce(degree.n, 0) AS n_links, coalesce(k.copy_id, doc_id) AS copy_id, coalesce(k.n_copies, 1) AS n_copies, coalesce(least.c, doc_id) = doc_id AS kept
FROM g LEFT JOIN least ON least.v = doc_id LEFT JOIN degree ON degree.v = doc_id LEFT JOIN k ON k.t = g.t AND len(g.g) > 0""",
    "op10_vector_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM e WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
{_CLOSURE} SELECT vec_id, coalesce(degree.n, 0) AS n_links, coalesce(least.c, vec_id) AS component_id, coalesce(least.c, vec_id) = vec_id AS kept FROM e LEFT JOIN least ON least.v = vec_id LEFT JOIN degree ON degree.v = vec_id""",
}
