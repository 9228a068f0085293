"""Queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language_id import op8_language_id
from .license_scan import op7_license_scan
from .lm_scoring import op4_lm_scoring
from .mixing import op9_mixing, source_targets, word_count
from .near_dedup import op5_near_dedup
from .packing import op3_packing
from .pii import op2_pii
from .quality_rules import op10_quality_rules
from .substring_dedup import op1_substring_dedup
from .topk_search import op6_topk_search



def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base part of op2's result: spans of each kind."""
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed part of op9's result: sizes and targets."""
    docs = table(spark, sf_dir, "documents").select("source", word_count("text").alias("size"))
    return source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed part of op10's result: counts and the base verdict."""
    return op10_quality_rules(spark, sf_dir).drop("kept", "distance", "pool")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_near_dedup": op5_near_dedup,
    "op6_topk_search": op6_topk_search,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "pii_base_counts": pii_base_counts,
    "mixing_targets": mixing_targets,
    "quality_counts": quality_counts,
}

#: Words of a text, as the queries see them.
WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

ORACLE_SQL = {
    "op1_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM w, unnest(range(1, len(ws) - 18)) t(i)),
        dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
        gone AS (SELECT doc_id, list(DISTINCT i + j) AS ps FROM dup, range(0, 20) r(j) GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id)""",
    "op6_topk_search": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM e q, e c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "pii_base_counts": r"""
        WITH m AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email,
          len(list_filter(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+){3}'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0)) AS n_ip,
          list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), lambda x: length(x) BETWEEN 13 AND 19) AS cards,
          len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone FROM m)
        SELECT doc_id, n_email, n_ip, len(list_filter(cards, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[i] AS INTEGER) WHEN CAST(x[i] AS INTEGER) > 4 THEN 2 * CAST(x[i] AS INTEGER) - 9 ELSE 2 * CAST(x[i] AS INTEGER) END)) % 10 = 0)) AS n_card, n_phone FROM n""",
    "mixing_targets": f"""
        WITH d AS (SELECT source, len({WORDS}) AS size FROM documents), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY 1),
        w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM s),
        l AS (SELECT *, cap / w AS r, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT arg_min(level, r) FILTER (level <= r) AS level FROM l)
        SELECT source, source_size, n, least(cap, t.level * w) AS target FROM l, t""",
    "quality_counts": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(ws) - 3)) x(i)),
        rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
        r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(0, 5) y(j) GROUP BY 1),
        ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
          coalesce(ln.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(ws) AS base_failed FROM d LEFT JOIN r USING (doc_id) LEFT JOIN ln USING (doc_id)""",
}
