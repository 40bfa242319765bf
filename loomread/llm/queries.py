"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomread.llm.common import table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomread.llm.exact_dedup import decide

    return decide(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomread.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op2_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomread.llm.webp import store_texts

    return store_texts(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomread.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomread.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"), "kept_chars")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomread.llm.lm_score import scores

    return scores(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomread.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomread.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS digest FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5('mix-7:' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
        / CASE WHEN chars >= 3 * size AND chars <= 12 * size AND size > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, weight * coalesce(max(level) FILTER (level <= ratio) OVER (), ratio)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS epochs FROM t),
b AS (SELECT *, CASE WHEN epochs >= 2 THEN 0 ELSE round(target - epochs * source_size) END::BIGINT AS budget FROM e)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - coalesce(sum(size)
    OVER (PARTITION BY k.source ORDER BY key, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
"""

def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomread.llm.token_counts import counts

    return counts(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomread.llm.simhash import cluster

    return cluster(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_webp_media": op2_webp_media,
    "op3_html_extract": op3_html_extract,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op7_mixing": OP7_SQL,
    "op10_exact_dedup": OP10_SQL,
}
