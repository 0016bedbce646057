"""Registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import (
    avi, chunks, collocations, decontaminate, jaccard, lines, packing, pages, passages, quality, simple8b, toxicity, whiten,
)
from tallyspark.llm.store import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), percent=85, size=4)


def tokenizer() -> str:
    """The tokenizer file of the registered queries."""
    return public_tokenizers.path("byte_bpe_50k.json")


def op2_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_index(simple8b.write_tokens(table(spark, sf_dir, "documents"), tokenizer(), end_id=0))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages"))


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), percent=80).select("doc_id", "n_lines", "n_kept", "text")


def op6_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.avi_digest(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_simple8b_tokens": op2_simple8b_tokens,
    "op3_site_templates": op3_site_templates,
    "op4_compact_windows": op4_compact_windows,
    "op5_chunk_bpe": op5_chunk_bpe,
    "op6_crf_quality": op6_crf_quality,
    "op7_fm_toxicity": op7_fm_toxicity,
    "op8_template_decontamination": op8_template_decontamination,
    "op9_avi_media": op9_avi_media,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_bin_slack_packing": op13_bin_slack_packing,
}

#: Phrase counts in SQL: all runs of one to four words of every piece, counted by lang.
_COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
  g AS (SELECT lang, k, ws[i:i + k - 1] AS ph FROM (
          SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(ws) >= k)),
  c AS (SELECT lang, k, ph, count(*) AS f FROM g GROUP BY ALL),
  cand AS (SELECT * FROM c WHERE k > 1 AND f >= 30),
  cut AS (SELECT lang, ph, f AS a, j, ph[1:j] AS le, ph[j + 1:k] AS ri FROM cand, (VALUES (1), (2), (3)) v(j) WHERE j < k),
  s AS (SELECT cut.lang, cut.ph, cut.a, min({'score': 2000000 * cut.a // (x.f + y.f), 'j': cut.j, 'l': x.f, 'r': y.f}) AS b
          FROM cut JOIN c x ON x.lang = cut.lang AND x.ph = cut.le JOIN c y ON y.lang = cut.lang AND y.ph = cut.ri GROUP BY ALL),
  part AS (SELECT lang, f, ph[i:i + m - 1] AS ph FROM (
          SELECT lang, f, m, ph, unnest(range(1, k - m + 2)) AS i FROM cand, (VALUES (2), (3)) v(m) WHERE m < k)),
  hidden AS (SELECT DISTINCT cand.lang, cand.ph FROM cand JOIN part ON part.lang = cand.lang AND part.ph = cand.ph WHERE 100 * part.f >= 80 * cand.f),
  r AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, b.l AS l, b.r AS r, b.score AS score FROM s
          WHERE NOT EXISTS (SELECT 1 FROM hidden WHERE hidden.lang = s.lang AND hidden.ph = s.ph))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r)
JOIN (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op11_phrase_collocations": _COLLOCATIONS}
