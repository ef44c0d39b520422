"""The thin queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import chroma, cotrain, ctw, htmltext, packing, pii, simhash, suffixes, tiling, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.search(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), bpe_path())


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = winnow.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", F.col("n_removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count the base spans only; added ones are in spans."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.withColumns({f"n_{k}": F.regexp_count("base_spans", F.lit(f"{k}:")).cast("long") for k in pii.KINDS})


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_cotraining, op2_chroma, op3_ctw, op4_packing, op5_main_text, op6_line_dedup, op7_decontamination, op8_pii, op9_simhash, op10_suffix_dedup]
    return {f.__name__: f for f in found}


LINE_SQL = """
WITH lines AS (
  SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS i, unnest(l) AS line, l
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
counted AS (
  SELECT *, len(regexp_extract_all(line, '\\S+')) AS w, sum(len(regexp_extract_all(line, '\\S+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM lines),
windows AS (
  SELECT a.doc_id, a.i AS a, b.i AS b, array_to_string(list_slice(a.l, a.i, b.i), chr(10)) AS key
  FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND a.i <= b.i
  WHERE b.upto - a.upto + a.w >= 5 AND (b.upto - b.w - a.upto + a.w < 5 OR b.upto - a.upto < 5)),
later AS (
  SELECT doc_id, a, b FROM windows QUALIFY row(doc_id, a) <> min(row(doc_id, a)) OVER (PARTITION BY key)),
marked AS (
  SELECT c.doc_id, c.i, c.line, EXISTS (SELECT 1 FROM later x WHERE x.doc_id = c.doc_id AND c.i BETWEEN x.a AND x.b) AS gone FROM counted c)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
hit AS (SELECT doc_id, i FROM p WHERE s IN (SELECT s FROM p GROUP BY s HAVING count(*) > 1)),
island AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS fresh FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM island GROUP BY doc_id, g),
kept AS (
  SELECT doc_id, a, substr(h, 2 * prior + 1, 2 * (a - prior)) AS piece FROM (
    SELECT doc_id, h, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM (
      SELECT d.doc_id, h, a, b FROM d JOIN span USING (doc_id)
      UNION ALL SELECT doc_id, h, length(h) // 2, NULL FROM d))),
total AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  (SELECT sha256(unhex(coalesce(string_agg(piece, '' ORDER BY a), ''))) FROM kept k WHERE k.doc_id = d.doc_id) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": LINE_SQL, "op10_suffix_dedup": SUFFIX_SQL}
