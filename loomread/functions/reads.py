"""FASTQ reads as column expressions: direction, id, barcode; and their rendering in each style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.errors import LinkedReadError
from loomread.functions import barcodes as B

DESIGNATION_REST = ":N:0:CAGATC"
PARSED = ("forward", "designation", "id", "rest", "barcode", "valid")


def tokens(comment: Column) -> Column:
    """Words of a comment; none for null."""
    return F.filter(F.split(F.coalesce(comment, F.lit("")), r"\s+"), lambda t: t != "")


def _joined(text: Column) -> Column:
    """The words of ``text`` with a tab between each two."""
    return F.regexp_replace(F.trim(text, F.lit(" \t\n\x0b\f\r")), r"\s+", "\t")


def _without(text: Column, start: str) -> Column:
    """``text`` without the words that begin with the pattern ``start``; blanks stay. By one expression of code that is
    compiled, which filters of word arrays are not."""
    return F.regexp_replace(text, rf"(?<!\S)(?:{start})\S*", "")


def _unmarked(name: Column, comment: Column) -> Column:
    """``name`` without the mark of direction at its end; with another direction in the comment the query fails. The name
    occurs few times here: it may be an expression that each occurrence evaluates again."""
    mark = F.substring(name, -2, 2)
    head = F.ltrim(F.coalesce(comment, F.lit("")))
    other = F.when(name.endswith("/1"), head.startswith("2:")).otherwise(head.startswith("1:"))
    both = F.raise_error(F.concat(F.lit("a read is marked as forward and as reverse: "), name)).cast("string")
    return F.when(mark.isin("/1", "/2"), F.when(other, both).otherwise(F.substring(name, F.lit(1), F.length(name) - 2))).otherwise(name)


def mate_name(name: Column) -> Column:
    """A name without ``/1`` or ``/2`` at its end."""
    return F.when(F.substring(name, -2, 2).isin("/1", "/2"), F.substring(name, F.lit(1), F.length(name) - 2)).otherwise(name)


def is_forward(name: Column, comment: Column, file_idx: Column | None = None) -> Column:
    """Whether a read is a forward one. Without a mark it is a reverse one, or by ``file_idx`` where that is given; with
    both marks the query fails."""
    head = F.ltrim(F.coalesce(comment, F.lit("")))
    forward = name.endswith("/1") | head.startswith("1:")
    reverse = name.endswith("/2") | head.startswith("2:")
    both = F.raise_error(F.concat(F.lit("a read is marked as forward and as reverse: "), name)).cast("boolean")
    return F.when(forward & reverse, both).when(forward, True).when(reverse, False).otherwise(F.lit(False) if file_idx is None else file_idx == 0)


def _split_id(id_: Column, mark: str, missing: str, chemistry: str) -> tuple[Column, Column, Column]:
    """Id, barcode and validity where the barcode follows the id's last ``mark``; ``missing`` isn't valid."""
    none = id_.endswith(mark)
    barcode = F.when(none, F.lit(missing)).otherwise(F.substring_index(id_, mark, -1))
    before = F.substring(id_, F.lit(1), F.length(id_) - F.length(F.substring_index(id_, mark, -1)) - 1)  # none without a mark
    rest = F.when(none, F.rtrim(id_, F.lit(mark))).otherwise(before)
    return rest, barcode, B.is_valid(barcode, chemistry)


def parse(reads: DataFrame, chemistry: str, length: int | None = None, paired: bool = False) -> DataFrame:
    """``reads`` with ``forward, designation, id, rest, barcode, valid``.

    ``length``: of a 10x barcode, which is cut off the forward read's sequence and quality; reverse reads get none here.
    ``paired``: reads without a mark take their direction from ``file_idx``.
    """
    if chemistry not in B.CHEMISTRIES:
        raise LinkedReadError(f"unknown chemistry: {chemistry}")
    if chemistry == B.TENX and not length:
        raise LinkedReadError("the 10x chemistry needs the barcode's length")
    out = reads.withColumn("forward", is_forward(F.col("name"), F.col("comment"), F.col("file_idx") if paired else None))
    text = F.coalesce("comment", F.lit(""))
    by_digit = lambda f: F.when(F.col("forward"), f("1")).otherwise(f("2"))
    found = by_digit(lambda d: F.regexp_extract(text, rf"(?<!\S){d}\S*", 0))
    out = out.withColumn("designation", F.when(found != "", found).otherwise(by_digit(lambda d: F.lit(d + DESIGNATION_REST))))
    id_ = _unmarked(F.col("name"), F.col("comment"))
    if chemistry in (B.HAPLOTAGGING, B.STANDARD):
        tag = F.regexp_extract(text, r"(?s).*(?<!\S)(BX:Z\S*)", 1)  # the last one
        barcode = F.when(tag == "", B.INVALID[B.HAPLOTAGGING]).when(tag.startswith("BX:Z:"), F.substring(tag, 6, 1 << 20)).otherwise(tag)
        rest = by_digit(lambda d: _joined(_without(text, f"{d}|BX:Z")))
        return out.withColumns({"id": id_, "rest": rest, "barcode": barcode}).withColumn("valid", B.is_valid(F.col("barcode"), chemistry))
    out = out.withColumn("rest", by_digit(lambda d: _joined(_without(text, d))))
    if chemistry == B.TENX:
        own = F.when(F.col("forward"), F.substring("seq", 1, length))
        trim = lambda c: F.when(F.col("forward"), F.substring(c, length + 1, 1 << 30)).otherwise(F.col(c))
        return out.withColumns({"id": id_, "barcode": own, "valid": F.col("forward")}).withColumns({"seq": trim("seq"), "qual": trim("qual")})
    mark = "#" if chemistry == B.STLFR else ":"
    cut, barcode, valid = _split_id(id_, mark, B.INVALID[chemistry], chemistry)
    return out.withColumns({"id": cut, "barcode": barcode, "valid": valid})


def with_barcode(reads: DataFrame, barcode: Column) -> DataFrame:
    """Parsed reads that take a barcode given from outside: it counts as valid, marks of another are dropped."""
    rest = F.array_join(F.filter(F.split("rest", "\t"), lambda t: ~t.startswith("BX:Z")), "\t")
    cut = F.when(F.col("id").contains("#"), F.regexp_extract("id", "^(.*)#[^#]*$", 1)).otherwise(F.col("id"))
    return reads.withColumns({"barcode": barcode, "valid": F.lit(True), "rest": rest, "id": F.regexp_replace(cut, ":+$", "")})


def render(reads: DataFrame, style: str, barcode: Column | None = None) -> DataFrame:
    """Parsed reads with ``id, rest, seq, qual`` as a style writes them, with ``barcode`` (their own by default)."""
    code = F.col("barcode") if barcode is None else barcode
    if style == B.TENX:
        add = lambda c, more: F.when(F.col("forward"), F.concat(more, F.col(c))).otherwise(F.col(c))
        return reads.withColumns({"id": F.concat_ws(" ", "id", "designation"), "seq": add("seq", code), "qual": add("qual", F.repeat(F.lit("F"), F.length(code)))})
    if style in (B.STLFR, B.TELLSEQ):
        return reads.withColumn("id", F.concat(F.col("id"), F.lit("#" if style == B.STLFR else ":"), code, F.lit(" "), F.col("designation")))
    if style in (B.HAPLOTAGGING, B.STANDARD):
        words = _joined(_without(F.col("rest"), "BX|VX"))
        own = (F.concat(F.lit("VX:i:"), F.col("valid").cast("int").cast("string")), F.concat(F.lit("BX:Z:"), code))
        tagged = F.when(F.col("rest").isNotNull(), F.ltrim(F.concat_ws("\t", words, *own), F.lit("\t")))
        return reads.withColumns({"id": F.concat(F.col("id"), F.lit("/"), F.when(F.col("forward"), "1").otherwise("2")), "rest": tagged})
    raise LinkedReadError(f"unknown style: {style}")


def fastq_record(id_: Column | str = "id", rest: Column | str = "rest") -> Column:
    """The four lines of a rendered read, without the last line's end. The tab stands also before an empty comment."""
    return F.concat(F.lit("@"), F.col(id_) if isinstance(id_, str) else id_, F.lit("\t"), F.col(rest) if isinstance(rest, str) else rest, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))


def random_id(id_: Column, key: Column, seed: int = 0) -> Column:
    """The first four fields of an id and three numbers from 1000 to 99999 out of ``key``."""
    number = lambda k: (F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), key)), 1, 12), 16, 10).cast("long"), F.lit(99000)) + 1000).cast("string")
    return F.concat_ws(":", F.concat_ws(":", F.slice(F.split(id_, ":"), 1, 4)), number(1), number(2), number(3))
