"""Barcodes as column expressions: formats, validity, and the n-th barcode of a style."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAPLOTAGGING, STLFR, TELLSEQ, TENX, STANDARD = "haplotagging", "stlfr", "tellseq", "10x", "standard"
NCBI = "ncbi"  # barcodes of 20 bases; no command writes them
STYLES = (TENX, HAPLOTAGGING, STLFR, TELLSEQ)
CHEMISTRIES = (*STYLES, STANDARD)

# Formats of the barcodes.
STLFR_INVALID = r"^0_|_0_|_0$"
ANY_INVALID = r"(?:N|[ABCD]00|^0_|_0_|_0$)"
IN_COMMENT = {HAPLOTAGGING: r"BX:Z:A[0-9]{2}C[0-9]{2}B[0-9]{2}D[0-9]{2}"}
IN_NAME = {STLFR: r"#[0-9]+_[0-9]+_[0-9]+(\s|$)", TELLSEQ: r":[ATCGN]+(\s|$)"}
IN_TAG = {HAPLOTAGGING: r"A[0-9]{2}C[0-9]{2}B[0-9]{2}D[0-9]{2}", STLFR: r"[0-9]+_[0-9]+_[0-9]+$", TELLSEQ: r"[ATCGN]+$"}
TAG_INVALID = {HAPLOTAGGING: r"[ABCD]0{2,4}", STLFR: STLFR_INVALID, TELLSEQ: r"N"}
NAME_SUFFIX = r":[ATCGN]+$|#[0-9]+_[0-9]+_[0-9]+$"
INVALID = {HAPLOTAGGING: "A00C00B00D00", STLFR: "0_0_0", TELLSEQ: "N" * 18, TENX: "N" * 16, NCBI: "N" * 20}
BASES = "ATCG"
CAPACITY = {HAPLOTAGGING: 96**4, STLFR: 1537**3, TELLSEQ: 4**18, TENX: 4**16, NCBI: 4**20}


def is_invalid(barcode: Column) -> Column:
    """Whether a barcode of any style is marked as invalid."""
    return barcode.rlike(ANY_INVALID)


def is_valid(barcode: Column, chemistry: str) -> Column:
    """Validity by the rule of a chemistry's own parser."""
    if chemistry == STLFR:
        return ~barcode.rlike(STLFR_INVALID)
    if chemistry in (TELLSEQ, TENX):
        return ~barcode.contains("N")
    if chemistry == HAPLOTAGGING:
        return ~barcode.contains("00")
    return ~is_invalid(barcode)


def from_name(qname: Column) -> Column:
    """A barcode at the end of a read's name, null without one."""
    return F.nullif(F.substring(F.regexp_extract(qname, NAME_SUFFIX, 0), 2, 1 << 20), F.lit(""))


def nth(ordinal: Column, style: str) -> Column:
    """The barcode number ``ordinal`` (from 0) of a style, its last part counting fastest; beyond the style's capacity
    the query fails."""
    k = ordinal.cast("long")
    # quotients of exact multiples below 2**53: whole also as doubles
    digit = lambda base, place: (F.pmod(((k - F.pmod(k, F.lit(base**place))) / F.lit(base**place)).cast("long"), F.lit(base)) + 1).cast("string")
    if style == HAPLOTAGGING:
        part = lambda place: F.lpad(digit(96, place), 2, "0")
        text = F.concat(F.lit("A"), part(3), F.lit("C"), part(2), F.lit("B"), part(1), F.lit("D"), part(0))
    elif style == STLFR:
        text = F.concat_ws("_", *[digit(1537, place) for place in (2, 1, 0)])
    else:
        n = len(INVALID[style])
        text = F.concat(*[F.substring(F.lit(BASES), F.pmod(F.shiftright(k, 2 * p), F.lit(4)).cast("int") + 1, F.lit(1)) for p in range(n - 1, -1, -1)])
    return F.when((k >= 0) & (k < CAPACITY[style]), text).otherwise(F.raise_error(F.lit(f"more barcodes than the {style} style has ({CAPACITY[style]})")))
