"""Barcodes of one style as those of another, through a dictionary in the order of first appearance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.errors import CapacityError, LinkedReadError
from loomread.functions import alignments as A
from loomread.functions import barcodes as B
from loomread.functions import reads as R
from loomread.plans.joins import looked_up, sized
from loomread.plans.ordinals import with_ordinal
from loomread.plans.storage import written


@dataclass(frozen=True)
class Recoded:
    rows: DataFrame
    mapping: DataFrame  # barcode, new_barcode, valid, pos


def dictionary(rows: DataFrame, style: str, pos: tuple[str, ...], key: str = "barcode") -> DataFrame:
    """``barcode, new_barcode, valid, pos``: valid barcodes get the style's barcodes in the order of their first ``pos``
    (``rec_idx`` and, before or after it, ``file_idx``), invalid ones its invalid value. Only distinct barcodes are
    numbered."""
    if style not in B.STYLES:
        raise LinkedReadError(f"unknown style: {style}")
    # by hash: the least of a number; an aggregate of structs would sort all rows. The order of structs is that of their
    # first fields, so the least one of a barcode's few has the first row's validity
    files = [c for c in pos if c != "rec_idx"]
    each = rows.groupBy(F.col(key).alias("barcode"), "valid", *files).agg(F.min("rec_idx").alias("rec_idx"))
    place = F.struct(*pos) if files else F.col("rec_idx")
    least = each.groupBy("barcode").agg(F.min(F.struct(place.alias("pos"), "valid")).alias("f"))
    first = written(least.select("barcode", "f.pos", "f.valid"), "dictionary")
    numbered = with_ordinal(first.where("valid"), ["pos"], "n").withColumn("new_barcode", B.nth(F.col("n"), style)).drop("n")
    return numbered.unionByName(first.where(~F.col("valid")).withColumn("new_barcode", F.lit(B.INVALID[style]))).select("barcode", "new_barcode", "valid", "pos")


def _with_new(rows: DataFrame, mapping: DataFrame, style: str) -> DataFrame:
    """``rows`` with ``new_barcode``. Invalid rows, which may be many and share one barcode, get the style's invalid
    value in place; only valid ones are joined to the dictionary."""
    return looked_up(rows, mapping.where("valid").select("barcode", "new_barcode"), "barcode", F.col("valid"), {"new_barcode": F.lit(B.INVALID[style])})


def check_capacity(mapping: DataFrame, style: str) -> None:
    """An error before any output if the style has too few barcodes."""
    n = mapping.where("valid").count()
    if n > B.CAPACITY[style]:
        raise CapacityError(f"{n} barcodes; the {style} style has {B.CAPACITY[style]}")


def pair_10x(parsed: DataFrame, whitelist: DataFrame, length: int) -> DataFrame:
    """Parsed 10x reads whose reverse reads have their mates' barcodes; valid are those on the ``whitelist``
    (``barcode``). A reverse read without a mate has ``N`` for each base."""
    missing = F.lit("N" * length)
    mates = parsed.where("forward").select("rec_idx", F.col("barcode").alias("mate_barcode"))
    # forward reads have their own barcodes and stay where they are
    first = parsed.where("forward").withColumn("barcode", F.coalesce("barcode", missing))
    second = parsed.where(~F.col("forward")).join(mates, "rec_idx", "left").withColumn("barcode", F.coalesce("barcode", "mate_barcode", missing)).drop("mate_barcode")
    out = first.unionByName(second)
    listed = whitelist.select(F.col("barcode"), F.lit(True).alias("listed")).distinct()
    return out.join(sized(listed), "barcode", "left").withColumn("valid", F.coalesce("listed", F.lit(False))).drop("listed")


def convert(parsed: DataFrame, source: str, target: str) -> Recoded:
    """Parsed reads with barcodes and form of another style; a pair's forward read comes first in the dictionary."""
    if source == target:
        raise LinkedReadError(f"the barcodes are {source} already")
    mapping = dictionary(parsed, target, ("rec_idx", "file_idx"))
    return Recoded(R.render(_with_new(parsed, mapping, target), target, F.col("new_barcode")), mapping)


def standardize_reads(parsed: DataFrame, style: str | None = None) -> Recoded:
    """Parsed reads with BX and VX tags; with ``style`` also with its barcodes, all of the forward file first in the
    dictionary."""
    if style is None:
        return Recoded(R.render(parsed, B.STANDARD), parsed.select("barcode", F.col("barcode").alias("new_barcode"), "valid", F.struct("file_idx", "rec_idx").alias("pos")).limit(0))
    mapping = dictionary(parsed, style, ("file_idx", "rec_idx"))
    return Recoded(R.render(_with_new(parsed, mapping, style), B.STANDARD, F.col("new_barcode")), mapping)


def standardize_alignments(alns: DataFrame, style: str | None = None) -> Recoded:
    """Alignments with BX and VX tags. Records with both stay as they are unless ``style`` recodes them; those with BX
    get VX; those with a barcode at the end of their name get both, and lose it there; others stay as they are."""
    from_name = B.from_name(F.col("qname"))
    own = F.nullif("bx", F.lit(""))
    vx = F.when(own.isNotNull(), F.coalesce("vx", (~B.is_invalid(own)).cast("int"))).when(from_name.isNotNull(), A.name_valid(from_name).cast("int")).otherwise(F.col("vx"))
    moved = own.isNull() & from_name.isNotNull()
    short = F.regexp_replace("qname", f"(?:{B.NAME_SUFFIX})", "")
    rows = alns.withColumns({"barcode": F.coalesce(own, from_name), "new_vx": vx, "qname": F.when(moved, short).otherwise(F.col("qname")), "had_both": own.isNotNull() & F.col("vx").isNotNull()})
    rows = rows.withColumn("valid", F.coalesce(F.col("new_vx") == 1, F.lit(False)))
    if style is not None:
        mapping = dictionary(rows.where(F.col("barcode").isNotNull()), style, ("rec_idx",))
        rows = _with_new(rows, mapping, style).withColumn("new_barcode", F.when(F.col("barcode").isNotNull(), F.col("new_barcode")))
        same = F.lit(False)
    else:
        mapping = rows.select("barcode", F.col("barcode").alias("new_barcode"), "valid", F.col("rec_idx").alias("pos")).limit(0)
        rows = rows.withColumn("new_barcode", F.col("barcode"))
        same = F.col("had_both")
    has = F.col("new_barcode").isNotNull()
    tags = A.with_tags(A.without_tags("BX", "VX"), (None, A.tag("VX", "i", F.col("new_vx"))), (None, A.tag("BX", "Z", F.col("new_barcode"))))
    rows = rows.withColumns({"tags": F.when(has & ~same, tags).otherwise(F.col("tags")), "bx": F.when(has, F.col("new_barcode")).otherwise(F.col("bx")), "vx": F.when(has, F.col("new_vx")).otherwise(F.col("vx"))})
    return Recoded(rows.drop("barcode", "new_barcode", "new_vx", "had_both", "valid"), mapping)


def map_lines(mapping: DataFrame) -> DataFrame:
    """``value``: lines ``old TAB new`` in the order of first appearance."""
    return mapping.orderBy("pos").select(F.concat_ws("\t", "barcode", "new_barcode").alias("value"))
