"""Lists of the barcodes that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomread.errors import WhitelistError

LONGEST = 60


def read_whitelist(spark: SparkSession, path: str, longest: int = LONGEST) -> tuple[DataFrame, int]:
    """``barcode`` of each line, and the barcodes' length; plain or gzip by the name's ending.

    Errors: more than one word on a line, anything but ACGT, barcodes that are too long or of several lengths, no
    barcode at all. One pass tells them all.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\r$", "")).alias("barcode")).where("barcode <> ''")
    word, size = F.col("barcode"), F.length("barcode")
    found = lines.agg(
        F.count("*").alias("n"), F.max(F.when(word.rlike(r"\s"), word)).alias("words"), F.max(F.when(~word.rlike(r"\s") & ~word.rlike("^[ACGT]*$"), word)).alias("bases"),
        F.max(size).alias("most"), F.min(size).alias("least"),
    ).first()
    if not found["n"]:
        raise WhitelistError(f"no barcodes in {path}")
    if found["words"]:
        raise WhitelistError(f"more than one word on a line: {found['words']}")
    if found["bases"]:
        raise WhitelistError(f"barcodes may have the letters A, C, G and T only: {found['bases']}")
    if found["most"] > longest:
        raise WhitelistError(f"a barcode has {found['most']} bases; {longest} are the most")
    if found["least"] != found["most"]:
        raise WhitelistError(f"barcodes of {found['least']} and of {found['most']} bases; all have to be of one length")
    return lines.distinct(), found["most"]
