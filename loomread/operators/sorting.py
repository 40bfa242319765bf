"""Orders by a tag."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.errors import LinkedReadError
from loomread.functions import alignments as A
from loomread.functions.reads import mate_name


def _checked(tag: str) -> str:
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]", tag):
        raise LinkedReadError("a tag has two characters, a letter first")
    return tag


def comment_tag(tag: str, comment: Column | None = None) -> Column:
    """The value of a tag ``XX:T:value`` in a read's comment, null without it."""
    words = F.col("comment") if comment is None else comment
    return F.substring(F.regexp_substr(words, F.lit(rf"(?<!\S){_checked(tag)}:[A-Za-z]:\S*")), 6, 1 << 20)


def reads_keyed(reads: DataFrame, tag: str) -> tuple[DataFrame, list[Column]]:
    """``reads`` with the columns of their order, and it: by a tag of their comments, those without it first; then by
    name, the forward read first, and place. Columns, since a sort evaluates expressions at each comparison."""
    keyed = reads.withColumns({"__tag": comment_tag(tag), "__name": mate_name(F.col("name"))})
    return keyed, [F.col("__tag").asc_nulls_first(), F.col("__name").asc(), F.col("file_idx").asc(), F.col("rec_idx").asc()]


def alignments_keyed(alns: DataFrame, tag: str) -> tuple[DataFrame, list[Column]]:
    """``alns`` with the columns of their order, and it: by a tag, those without it first; then by contig, position,
    strand and place."""
    keyed = alns.withColumns({"__tag": A.tag_value(_checked(tag)), "__reverse": A.flagged(0x10)})
    return keyed, [F.col("__tag").asc_nulls_first(), F.col("rname").asc_nulls_last(), F.col("pos").asc(), F.col("__reverse").asc(), F.col("rec_idx").asc()]


def sort_reads(reads: DataFrame, tag: str) -> DataFrame:
    """``reads`` in the order of a tag: a range exchange and sorts that spill."""
    keyed, order = reads_keyed(reads, tag)
    return keyed.orderBy(*order).drop("__tag", "__name")


def sort_alignments(alns: DataFrame, tag: str) -> DataFrame:
    keyed, order = alignments_keyed(alns, tag)
    return keyed.orderBy(*order).drop("__tag", "__reverse")
