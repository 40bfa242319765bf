"""Several samples in one, without a barcode or molecule of one standing for another's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.functions import alignments as A
from loomread.functions import barcodes as B
from loomread.operators.detect import alignments_chemistry, require
from loomread.plans.ordinals import with_ordinal


def concat_alignments(alns: DataFrame, chemistry: str | None = None, by_molecule: bool = False) -> DataFrame:
    """``alns`` of several files (``file_idx``) with new ``bx`` and ``mi``, one pair for each barcode of a file.

    ``by_molecule``: for each MI of a file instead; 0 and missing ones are left alone, as records without the key are.
    ``chemistry``: style of the new barcodes; by default that of the first file's.
    """
    style = chemistry or require(alignments_chemistry(alns.where(F.col("file_idx") == alns.agg(F.min("file_idx")).first()[0])))
    key = F.nullif(F.col("mi"), F.lit(0)).cast("string") if by_molecule else F.nullif(F.col("bx"), F.lit(""))
    rows = alns.withColumn("key", key)
    first = rows.where(F.col("key").isNotNull()).groupBy("file_idx", "key").agg(F.min("rec_idx").alias("first_pos"))
    numbered = with_ordinal(first, ["file_idx", "first_pos"], "n").select("file_idx", "key", (F.col("n") + 1).alias("new_mi"), B.nth(F.col("n"), style).alias("new_bx"))
    out = rows.join(numbered, ["file_idx", "key"], "left")
    has = F.col("new_mi").isNotNull()
    tags = A.with_tags(A.without_tags("BX", "MI"), (None, A.tag("BX", "Z", F.col("new_bx"))), (None, A.tag("MI", "i", F.col("new_mi"))))
    columns = {"tags": F.when(has, tags).otherwise(F.col("tags")), "bx": F.coalesce("new_bx", "bx"), "mi": F.coalesce("new_mi", "mi")}
    return out.withColumns(columns).drop("key", "new_mi", "new_bx")


def merged_header(header: dict[str, list[dict[str, str]]], command: str) -> dict[str, list[dict[str, str]]]:
    """The first file's header with one program line, and its first read group named ``concat``."""
    groups = [dict(g) for g in header.get("RG", [])] or [{}]
    groups[0] |= {"ID": "concat", "SM": "concat"}
    return {k: v for k, v in header.items() if k not in ("PG", "RG")} | {"RG": groups, "PG": [{"ID": "concatenate", "PN": "loomread", "CL": command}]}
