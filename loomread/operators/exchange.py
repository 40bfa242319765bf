"""Reads as unaligned alignments and back, nothing lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.functions import alignments as A
from loomread.functions.reads import mate_name

_TAG = r"(?<!\S)[A-Za-z][A-Za-z0-9]:[AifZHB]:\S*"
# Fixed values of the SAM format: unmapped first and second mates, unmapped single reads.
FIRST, SECOND, SINGLE = 77, 141, 4


def to_unaligned(reads: DataFrame, paired: bool = True) -> DataFrame:
    """Alignment rows of ``reads``: name without ``/1`` or ``/2``, tags of the comment, sequence and quality."""
    flag = F.when(F.col("file_idx") == 0, FIRST).otherwise(SECOND) if paired else F.lit(SINGLE)
    found = F.regexp_extract_all(F.coalesce("comment", F.lit("")), F.lit(_TAG), F.lit(0))
    tags = F.transform(found, lambda t: F.struct(F.substring(t, 1, 2).alias("tag"), F.substring(t, 4, 1).alias("type"), F.substring(t, 6, 1 << 20).alias("value")))
    zero = F.lit(0).cast("long")
    return reads.select(
        F.lit(0).alias("file_idx"), (F.col("rec_idx") * (2 if paired else 1) + F.col("file_idx") * int(paired)).alias("rec_idx"), mate_name(F.col("name")).alias("qname"), flag.cast("int").alias("flag"),
        F.lit(None).cast("string").alias("rname"), F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"), F.lit("*").alias("rnext"), F.lit(-1).cast("long").alias("pnext"), zero.alias("tlen"), "seq", "qual", tags.alias("tags"),
    )


def to_reads(alns: DataFrame) -> DataFrame:
    """Reads of primary alignments: ``/1`` or ``/2`` on the name, all tags in the comment, reverse ones turned back."""
    rows = alns.where(~A.flagged(0x900))
    second = A.flagged(0x80)
    back = A.flagged(0x10)
    mark = F.when(A.flagged(0x40), "/1").when(second, "/2").otherwise("")
    comment = F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["tag"], t["type"], t["value"])), "\t")
    return rows.select(
        F.when(second, 1).otherwise(0).alias("file_idx"), "rec_idx", F.concat("qname", mark).alias("name"), comment.alias("comment"),
        F.when(back, A.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(back & (F.col("qual") != "*"), F.reverse("qual")).otherwise(F.col("qual")).alias("qual"),
    )
