"""Alignments as column expressions: flags, tags, reference spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.functions import barcodes as B


def flagged(mask: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(mask)) != 0


def tag_value(tag: str, tags: str = "tags") -> Column:
    """The value of the first tag of that name, null without one."""
    return F.try_element_at(F.filter(tags, lambda t: t["tag"] == tag), F.lit(1))["value"]


def without_tags(*names: str, tags: str = "tags") -> Column:
    return F.filter(tags, lambda t: ~t["tag"].isin(*names))


def tag(name: str, kind: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("tag"), F.lit(kind).alias("type"), value.cast("string").alias("value"))


def no_tags() -> Column:
    return F.array().cast("array<struct<tag:string,type:string,value:string>>")


def with_tags(kept: Column, *added: tuple[Column | None, Column]) -> Column:
    """``kept`` and each tag whose condition holds (null: always)."""
    parts = [F.array(t) if when is None else F.when(when, F.array(t)).otherwise(no_tags()) for when, t in added]
    return F.concat(F.coalesce(kept, no_tags()), *parts)


_AHEAD = r"(\d+)([MDN=X])"


def spans(alns: DataFrame) -> DataFrame:
    """``alns`` with ``aln_start, aln_end`` (0-based, half-open; null without an aligned block).

    Operations before the first and after the last aligned block move neither end.
    """
    cigar = F.coalesce("cigar", F.lit("*"))
    lead = F.regexp_extract(cigar, r"^(?:\d+[^M=X\d])*", 0)
    whole = F.regexp_replace(cigar, r"(?:\d+[^M=X\d])*$", "")  # to the end of the last aligned block
    ahead = lambda c: F.aggregate(F.regexp_extract_all(c, F.lit(_AHEAD), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    has = cigar.rlike(r"\d+[M=X]")
    start = F.col("pos") + ahead(lead)
    return alns.withColumns({"aln_start": F.when(has, start), "aln_end": F.when(has, F.col("pos") + ahead(whole))})


def promoted(alns: DataFrame) -> DataFrame:
    """``alns`` with tags ``bx, vx, mi, dx``, the flags and the reference span as columns."""
    flags = {"is_paired": 0x1, "is_unmapped": 0x4, "is_reverse": 0x10, "is_read1": 0x40, "is_read2": 0x80}
    out = alns.withColumns({"bx": tag_value("BX"), "vx": tag_value("VX").cast("int"), "mi": tag_value("MI").cast("long"), "dx": tag_value("DX"), **{k: flagged(m) for k, m in flags.items()}})
    return spans(out)


def barcode_of(bx: Column, qname: Column) -> Column:
    """The BX tag, else the barcode at the end of the name, else null."""
    return F.coalesce(F.nullif(bx, F.lit("")), B.from_name(qname))


def name_valid(barcode: Column) -> Column:
    """Validity of a barcode found in a name: no part is zero, and there is no N."""
    zero = F.exists(F.split(barcode, "_"), lambda z: z.rlike(r"^0+$"))
    return ~(barcode.contains("N") | (barcode.contains("_") & zero))


def deconvolved(bx: Column) -> tuple[Column, Column]:
    """A barcode without the suffix after ``-``; whether there is one."""
    return F.substring_index(bx, "-", 1), bx.contains("-")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTUacgtuRYKMBVDHrykmbvdh", "TGCAAtgcaaYRMKVBHDyrmkvbhd"))
