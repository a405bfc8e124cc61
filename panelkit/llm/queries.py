"""The registered queries of this subpackage: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_documents(spark, sf_dir))


def op2_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_documents

    return simhash_documents(_documents(spark, sf_dir))


def op4_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .lines import dedup_units

    got = dedup_units(_documents(spark, sf_dir), "both")
    places = F.transform("removed", lambda c: F.concat_ws("-", c["first"].cast("string"), c["last"].cast("string")))
    return got.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", places).alias("removed"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^
]+
*|
+')) AS line,
         generate_subscripts(regexp_extract_all(text, '[^
]+
*|
+'), 1) AS lk
  FROM documents),
m AS (
  SELECT *, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY lk) AS BIGINT) AS line_last,
         trim(regexp_replace(lower(line), '[\x20\x09-\x0d]+', ' ', 'g')) AS line_norm
  FROM l),
a AS (SELECT *, line_norm <> '' AND row_number() OVER (PARTITION BY line_norm ORDER BY doc_id, lk) > 1 AS line_again FROM m),
u AS (
  SELECT *, unnest(regexp_extract_all(line, '[^.!?
]+[.!?]*
*|[.!?]+
*|
+')) AS unit,
         generate_subscripts(regexp_extract_all(line, '[^.!?
]+[.!?]*
*|[.!?]+
*|
+'), 1) AS k
  FROM a),
p AS (
  SELECT * EXCLUDE (line, line_norm), length(line) AS line_length,
         CAST(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY lk, k) AS BIGINT) AS last,
         trim(regexp_replace(lower(unit), '[\x20\x09-\x0d]+', ' ', 'g')) AS norm
  FROM u),
w AS (
  SELECT doc_id, lk, k, len(string_split(norm, ' ')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY lk, k) AS nth,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id, lk, k) > 1 AS again
  FROM p WHERE norm <> ''),
i AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id, again ORDER BY nth) AS run FROM w),
c AS (SELECT doc_id, lk, k, again AND sum(n) OVER (PARTITION BY doc_id, again, run) >= 16 AS gone FROM i),
r AS (SELECT p.*, coalesce(c.gone, false) AS gone FROM p LEFT JOIN c USING (doc_id, lk, k)),
t AS (SELECT doc_id, string_agg(CASE WHEN gone OR line_again THEN '' ELSE unit END, '' ORDER BY lk, k) AS text FROM r GROUP BY doc_id),
cuts AS (
  SELECT doc_id, line_last - line_length AS first, line_last AS last FROM r WHERE line_again AND k = 1
  UNION ALL SELECT doc_id, last - length(unit), last FROM r WHERE gone AND NOT line_again),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(first || '-' || last, ',' ORDER BY first) AS removed FROM cuts GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
       coalesce(g.n_removed, 0) AS n_removed, coalesce(g.removed, '') AS removed
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN g USING (doc_id)
"""


def op5_clause_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir))


def op7_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import token_round_trip

    return token_round_trip(_documents(spark, sf_dir))


def op9_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    return identify_languages(_documents(spark, sf_dir))


def op10_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketch import edited_fingerprints

    return edited_fingerprints(_documents(spark, sf_dir))


def op11_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(_documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 30),
l AS (SELECT lang, sum(n) AS total, count(*) AS terms FROM k GROUP BY 1),
o AS (SELECT c.lang, c.source, sum(c.n) AS own FROM c JOIN k USING (lang, term) GROUP BY ALL),
g AS (
  SELECT s.lang, s.source, coalesce(own, 0) AS own FROM (SELECT DISTINCT lang, source FROM d) s
  LEFT JOIN o ON o.lang = s.lang AND o.source = s.source),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.own + 5 * l.terms) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.terms) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM x WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_groups

    return spelling_groups(_documents(spark, sf_dir))


def queries() -> dict:
    return {
        "op1_hash_tree_shards": op1_hash_tree_shards,
        "op2_crf_main_text": op2_crf_main_text,
        "op3_simhash_golay": op3_simhash_golay,
        "op4_sentence_dedup": op4_sentence_dedup,
        "op5_clause_grammar_toxicity": op5_clause_grammar_toxicity,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_greedy_string_tiling": op7_greedy_string_tiling,
        "op8_huffman_tokens": op8_huffman_tokens,
        "op9_cross_parsing_language": op9_cross_parsing_language,
        "op10_bottom_k_fingerprints": op10_bottom_k_fingerprints,
        "op11_boosted_quality": op11_boosted_quality,
        "op12_source_divergence": op12_source_divergence,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_sentence_dedup": OP4_SQL, "op12_source_divergence": OP12_SQL}
