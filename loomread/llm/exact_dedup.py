"""Exact dedup against a persistent digest index.

The index is a table of digests, bucketed and sorted by digest. A batch is reduced to one row per digest (map-side
combine first), kept out of the index by a sort-merge anti-join and appended. Only digests and row identities are
shuffled, never texts.

Defined results: a null text counts as empty; texts that differ only in the case of A-Z are equal; of equal texts the
row with the largest ``doc_id`` stays (null ids lose), and of rows that repeat that id exactly one stays; an empty
table gives an empty result; further columns are ignored by the index and kept by :func:`drop_copies`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomread.llm.common import shared_path, spread_join, with_row_key, without_rows, written


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        # bytes.lower() changes A-Z only
        texts = [hashlib.sha256((t or "").encode().lower()).digest() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__lr_f"), b.column("__lr_i"), pa.array(texts, pa.binary())], ["doc_id", "__lr_f", "__lr_i", "digest"])


def digest_rows(docs: DataFrame) -> DataFrame:
    """Of rows that have a row key, ``doc_id, __lr_f, __lr_i, digest`` of each row, where ``digest`` is the SHA-256 of the text with A-Z in lower case."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__lr_f", "__lr_i", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_digests, "doc_id long, __lr_f long, __lr_i long, digest binary")


class DigestIndex:
    """Digests seen so far, in a table bucketed and sorted by ``digest``.

    ``path``: where the files live (the shared folder by default); an existing index is opened by giving its
    ``path`` and ``buckets`` again.
    """

    SCHEMA = "digest binary, keep_id long, keep_rf long, keep_ri long, group_size long"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.path = path or shared_path(spark, "digests")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"loomread_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_rf BIGINT, keep_ri BIGINT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        """The index as a frame."""
        return self.spark.table(self.name)

    def admit(self, groups: DataFrame) -> None:
        """Append the digests of ``groups`` (one row each, columns of ``SCHEMA``) that the index lacks."""
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti").select("digest", "keep_id", "keep_rf", "keep_ri", "group_size")
        # a row for each digest, dealt by it: one file a bucket, sorted in itself
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)


def decide(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs`` (:func:`decide_keyed` takes rows that have a row key): ``doc_id, __lr_f, __lr_i, digest, keep_id, group_size, kept``.

    With an ``index`` from earlier batches, a text that it holds already isn't kept again; ``keep_id`` is then the
    earlier row's.
    """
    return decide_keyed(with_row_key(docs), index)


def decide_keyed(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    rows = written(digest_rows(docs), "digest-rows")
    groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "__lr_f", "__lr_i")).alias("k"), F.count("*").alias("group_size"))
    groups = written(groups.select("digest", F.col("k.doc_id").alias("keep_id"), F.col("k.__lr_f").alias("keep_rf"), F.col("k.__lr_i").alias("keep_ri"), "group_size"), "digest-groups")
    index.admit(groups)
    # which digests many rows have is this batch's matter: the index may hold them from a single row
    held = groups.select("digest", F.col("group_size").alias("here")).join(index.rows().hint("merge"), "digest")
    joined = spread_join(rows, written(held, "digest-held"), ["digest"], "here", rows.count())
    stays = (F.col("keep_rf") == F.col("__lr_f")) & (F.col("keep_ri") == F.col("__lr_i"))
    return joined.select("doc_id", "__lr_f", "__lr_i", "digest", "keep_id", "group_size", stays.alias("kept"))


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` without the rows that repeat another's text."""
    keyed = with_row_key(docs)
    decided = written(decide_keyed(keyed, index), "digest-decisions")
    return without_rows(keyed, decided.where(~F.col("kept")), decided.count()).select(*docs.columns)
