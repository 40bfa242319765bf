"""Counts of barcodes, the barcodes themselves, and filters by them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.errors import LinkedReadError, SampleSizeError
from loomread.functions import alignments as A
from loomread.functions import barcodes as B
from loomread.plans.joins import sized
from loomread.plans.ordinals import with_ordinal
from loomread.plans.storage import written


@dataclass(frozen=True)
class Split:
    """Rows that stay and rows that go."""

    kept: DataFrame
    rejected: DataFrame


# ---- counts


def count_reads(parsed: DataFrame, invalid: bool = False) -> DataFrame:
    """``barcode, count, first_pos``: forward-file reads by barcode; a barcode that only the reverse file has counts 1.

    One pass: a barcode's rows of either file meet in one aggregate.
    """
    rows = parsed if invalid else parsed.where("valid")
    n = F.count_if(F.col("file_idx") == 0)
    return rows.groupBy("barcode").agg(F.greatest(n, F.lit(1)).cast("long").alias("count"), F.min(F.struct("file_idx", "rec_idx")).alias("first_pos"))


def count_alignments(alns: DataFrame, invalid: bool = False) -> DataFrame:
    """``barcode, count, first_pos``: first mates always count, second mates if unpaired or if their barcode had none yet."""
    rows = alns.where(F.col("bx").isNotNull())
    rows = rows if invalid else rows.where(~B.is_invalid(F.col("bx")))
    read1, read2 = F.col("is_read1"), F.col("is_read2") & ~F.col("is_read1")
    paired2 = read2 & F.col("is_paired")
    place = F.when(read1 | read2, F.col("rec_idx"))  # of rows that could count
    n = F.count_if(read1) + F.count_if(read2 & ~F.col("is_paired")) + F.coalesce(F.min_by(paired2, place).cast("int"), F.lit(0))
    return rows.groupBy(F.col("bx").alias("barcode")).agg(n.cast("long").alias("count"), F.min("rec_idx").alias("first_pos")).where(F.col("count") > 0)


def by_count(counts: DataFrame) -> DataFrame:
    """Counts from the highest, ties in the order of first appearance."""
    return counts.orderBy(F.desc("count"), "first_pos").select("barcode", "count")


# ---- barcodes


def read_barcodes(parsed: DataFrame) -> DataFrame:
    """``barcode, valid``: the barcodes of all files."""
    return parsed.select("barcode", "valid").distinct()


def alignment_barcodes(alns: DataFrame) -> DataFrame:
    """``barcode, valid``: BX tags, or where there is none the barcode at the end of the name."""
    rows = alns.select(A.barcode_of(F.col("bx"), F.col("qname")).alias("barcode")).where(F.col("barcode").isNotNull())
    return rows.distinct().withColumn("valid", ~B.is_invalid(F.col("barcode")))


# ---- filters


def split_invalid_reads(parsed: DataFrame) -> Split:
    return Split(parsed.where("valid"), parsed.where(~F.col("valid")))


def split_invalid_alignments(alns: DataFrame, chemistry: str) -> Split:
    """By the chemistry's rule on BX; records without BX are rejected."""
    good = F.coalesce(~F.col("bx").rlike(B.TAG_INVALID[B.TELLSEQ if chemistry == B.TENX else chemistry]), F.lit(False))
    return Split(alns.where(good), alns.where(~good))


def pair_counts(parsed: DataFrame) -> DataFrame:
    """``barcode, count``: each pair counts once for a barcode that either mate has; a single file's valid reads count."""
    return parsed.select("rec_idx", "barcode").distinct().groupBy("barcode").agg(F.count("*").alias("count"))


def split_singleton_reads(parsed: DataFrame, min_count: int = 2, paired: bool = True) -> Split:
    """Valid reads whose barcode is seen ``min_count`` times, and those whose isn't."""
    if not paired:
        return _by_count(parsed.where("valid"), "barcode", parsed.where("valid").groupBy("barcode").agg(F.count("*").alias("count")), min_count)
    return _by_linked(parsed.where("valid"), "barcode", _seen(parsed, min_count))


def _seen(parsed: DataFrame, min_count: int) -> DataFrame:
    """``barcode`` of those with :func:`pair_counts` of ``min_count`` and more.

    A file has one record at a place, so a barcode's pairs are at least its records in one file and at most those of all
    files. Only barcodes between the two, with few records each, have their pairs counted one by one.
    """
    files = parsed.groupBy("barcode", "file_idx").agg(F.count("*").alias("n"))
    bounds = written(files.groupBy("barcode").agg(F.max("n").alias("least"), F.sum("n").alias("most")), "barcode-bounds")
    sure = bounds.where(F.col("least") >= min_count).select("barcode")
    open_ = bounds.where((F.col("least") < min_count) & (F.col("most") >= min_count)).select("barcode")
    if open_.isEmpty():
        return sure
    told = pair_counts(parsed.join(sized(open_), "barcode", "left_semi"))
    return sure.unionByName(told.where(F.col("count") >= min_count).select("barcode"))


def split_singleton_alignments(alns: DataFrame, min_count: int = 3) -> Split:
    """As for reads; two alignments of a pair are one observation, so that three are needed. Records without any
    barcode are in neither part."""
    rows = alns.withColumn("barcode", A.barcode_of(F.col("bx"), F.col("qname")))
    rows = rows.where(F.col("barcode").isNotNull() & ~B.is_invalid(F.col("barcode")))
    return _by_count(rows, "barcode", rows.groupBy("barcode").agg(F.count("*").alias("count")), min_count)


def _by_count(rows: DataFrame, key: str, counts: DataFrame, min_count: int) -> Split:
    return _by_linked(rows, key, counts.where(F.col("count") >= min_count).select(key))


def _by_linked(rows: DataFrame, key: str, linked: DataFrame) -> Split:
    """By whether the key is one of ``linked``: few of these are broadcast, so that rows stay where they are."""
    linked = sized(written(linked, "linked"))
    return Split(rows.join(linked, key, "left_semi"), rows.join(linked, key, "left_anti"))


# ---- sampling


def sample_rank(barcode: Column, seed: int) -> Column:
    """What barcodes are drawn by: a digest, equal in each run with the seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), barcode))


def _first(rows: DataFrame, n: int, seed: int) -> DataFrame:
    order = [sample_rank(F.col("barcode"), seed), F.col("barcode")]
    return with_ordinal(rows, order, "__rank").where(F.col("__rank") < n).drop("__rank")


def sample_barcodes(barcodes: DataFrame, amount: float, invalid: float = 1.0, seed: int = 0) -> DataFrame:
    """``barcode``: as many barcodes as ``amount`` says, a number or, below 1, a share of the pool.

    ``invalid``: the share of invalid barcodes in the pool.
    """
    if amount is None or amount <= 0 or not 0 <= invalid <= 1:
        raise LinkedReadError("the amount has to be above 0, the share of invalid barcodes between 0 and 1")
    pool = written(barcodes.groupBy("barcode").agg(F.max("valid").alias("valid")), "barcode-pool")
    if invalid == 0:
        pool = pool.where("valid")
    elif invalid < 1:
        bad = pool.where(~F.col("valid"))
        pool = pool.where("valid").unionByName(_first(bad, round(bad.count() * invalid), seed))
    size = pool.count()
    n = int(size * amount) if amount < 1 else int(amount)
    if n > size:
        raise SampleSizeError(f"there are {size} barcodes, fewer than {n}")
    return _first(pool, n, seed).select("barcode")


def keep_barcodes(rows: DataFrame, chosen: DataFrame, column: str = "barcode") -> DataFrame:
    """All rows that have one of the ``chosen`` barcodes."""
    return rows.join(chosen.select(F.col("barcode").alias(column)), column, "left_semi")
