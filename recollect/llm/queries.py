"""Queries of the driver's registry for the operators of this folder; SQL where SQL can tell the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..lineage import spread
from . import bpe, chat, forest, html, minhash, packing, pii, quality, substring, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(_table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(_table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(_table(spark, sf_dir, "documents")).drop("text_hash")


def op7_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(_table(spark, sf_dir, "conversations"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_packing, op3_pii, op4_topk, op5_quality, op6_substring, op7_forest, op8_html, op9_chat, op10_minhash)}


#: The first place of each run of 50 words, and maximal spans of later ones. doc_id is a key in the tables.
SUBSTRING_SQL = """
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') AS w FROM documents),
runs AS (SELECT doc_id, p, list_slice(w, p + 1, p + 50) AS r FROM docs, unnest(range(len(w) - 49)) AS u(p) WHERE len(w) >= 50),
hashed AS (SELECT doc_id, p, md5(array_to_string(r, ' ')) AS h FROM runs),
firsts AS (SELECT doc_id, p, first_value(doc_id) OVER g AS rd, first_value(p) OVER g AS rp FROM hashed WINDOW g AS (PARTITION BY h ORDER BY doc_id, p)),
again AS (SELECT * FROM firsts WHERE (doc_id, p) <> (rd, rp)),
marked AS (SELECT *, CASE WHEN p = lag(p) OVER o + 1 AND rd = lag(rd) OVER o THEN 0 ELSE 1 END AS s FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
spans AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM marked)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_word, CAST(count(*) + 49 AS BIGINT) AS n_words, min(rd) AS ref_doc_id, CAST(min(rp) AS BIGINT) AS ref_start_word
FROM spans GROUP BY doc_id, k
"""


TOPK_SQL = """
WITH vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
units AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM vecs),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_inner_product(a.e, b.e) / (a.norm * b.norm), 6) AS score FROM units a JOIN units b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank FROM pairs)
SELECT vec_id, CAST(rank AS BIGINT) AS rank, neighbor_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": TOPK_SQL, "op6_substring": SUBSTRING_SQL}
