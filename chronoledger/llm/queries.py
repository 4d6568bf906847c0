"""The training-data queries, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe_codec, decontamination, exact_dedup, lattice_lm, licences, pii, quality, signature_join, token_counts, toxicity
from .common import table


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7, modulus=3, remainder=1)


def op4_decontamination(spark, sf_dir):
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10, k=5)


def op5_lattice_scores(spark, sf_dir):
    return lattice_lm.lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), modulus=7, remainder=2)


def op6_near_components(spark, sf_dir):
    return signature_join.near_components(table(spark, sf_dir, "documents"), n=5, percent=75)


def op7_licences(spark, sf_dir):
    return licences.licences(table(spark, sf_dir, "documents"), at_least=0.5)


def op8_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark, sf_dir):
    return bpe_codec.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark, sf_dir):
    """Grades: 0 low quality, 1 good but toxic, 2 good and clean. A text is kept for a grade of 1 at least."""
    grade = F.col("quality") * (F.lit(2) - F.coalesce("toxic", F.lit(0)))
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), grade, grades=3, select_from=1, at_least=0.5)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_exact_dedup, op3_toxicity, op4_decontamination, op5_lattice_scores, op6_near_components, op7_licences, op8_personal_data, op9_bpe_codec, op10_quality)}

ORACLES = {
    "op4_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), il AS (
  SELECT item, w, least(len(w), 10) AS n FROM iw WHERE len(w) > 0
), ip AS (
  SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM il
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM ip
), lens AS (
  SELECT DISTINCT n FROM win
), dl AS (
  SELECT doc_id, w, n FROM dw, lens WHERE len(w) >= n
), dp AS (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dl
), dg AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM dp
), hit AS (
  SELECT doc_id, p, dg.n, item FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g
), pos AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
""",
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), g AS (
  SELECT h, count(*) AS group_size FROM d GROUP BY h
), k AS (
  SELECT h, doc_id AS keep_id FROM (SELECT h, doc_id, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS r FROM d) WHERE r = 1
)
SELECT d.doc_id, k.keep_id, g.group_size, d.doc_id = k.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON g.h = d.h JOIN k ON k.h = d.h
""",
}
