"""The registered queries of this subpackage: one thin query for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bpe, dac, decontam, html, langid, linededup, metric, neardup, quality, toxicity
from pathloom.llm.common import table


def word_bpe() -> str:
    """Path of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated line chunks from every document."""
    out = linededup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_lines", "n_removed", "n_by_chunk", "n_by_window", "n_by_line")), "text")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), word_bpe())


def op3_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find all benchmark windows in every document."""
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write and read back the ids of every document, end id 1."""
    return dac.write_and_digest(table(spark, sf_dir, "documents"), word_bpe(), end_id=1)


def op5_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by its nearest labelled examples."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link all embeddings at a cosine of 0.95 or more."""
    return metric.components(table(spark, sf_dir, "embeddings"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract the main text of every page."""
    return html.extract_table(table(spark, sf_dir, "pages"))


def op8_quality_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document's quality."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group near-duplicate documents: four-word shingles, similarity 0.8."""
    return neardup.components(table(spark, sf_dir, "documents"), width=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {f.__name__: f for f in (op1_line_dedup, op2_bpe_round_trip, op3_suffix_array_decontamination, op4_token_file, op5_toxicity_neighbours, op6_metric_range_join, op7_main_text, op8_quality_chain, op9_language_cross_parsing, op10_minhash_components)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP3 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, w, least(13, len(w)) AS size FROM (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, list_slice(w, s, s + size - 1) AS g FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM iw)),
sizes AS (SELECT DISTINCT size FROM iw),
places AS (SELECT doc_id, size, p, list_slice(w, p, p + size - 1) AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM dw, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, p, places.size FROM places JOIN win ON win.size = places.size AND win.g = places.g),
hits AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS x FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
_OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
low AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings JOIN low ON low.a = vec_id"""
_OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, list_slice(w, p, p + 3) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
low AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = documents.doc_id AS kept FROM documents JOIN low ON low.a = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name; the others are tested against brute force, round trips or held-out accuracy."""
    return {"op3_suffix_array_decontamination": _OP3, "op6_metric_range_join": _OP6, "op10_minhash_components": _OP10}
