"""Parsing and rendering of reads against records written by hand."""

import random

import pytest
from pyspark.sql import functions as F

from loomread.errors import LinkedReadError
from loomread.functions import alignments as A
from loomread.functions import barcodes as B
from loomread.functions import reads as R
from loomread.schema import READ

CASES = [
    ("haplotagging", "A:1:F:1:1:10:20/1", "BX:Z:A01C93B56D11", "A:1:F:1:1:10:20", "A01C93B56D11", True, True),
    ("haplotagging", "r1/1", "BX:Z:A00C93B56D11", "r1", "A00C93B56D11", False, True),
    ("haplotagging", "r2/1", "RX:Z:x", "r2", "A00C00B00D00", False, True),
    ("haplotagging", "r2/2", None, "r2", "A00C00B00D00", False, False),
    ("stlfr", "r3#12_3_45", "1:N:0:CAGATC", "r3", "12_3_45", True, True),
    ("stlfr", "r4#12_0_45", "1:N:0:CAGATC", "r4", "12_0_45", False, True),
    ("stlfr", "r5#100_20_3", "2:N:0:CAGATC", "r5", "100_20_3", True, False),
    ("stlfr", "r6#", "1:N:0:CAGATC", "r6", "0_0_0", False, True),
    ("stlfr", "r6##", "1:N:0:CAGATC", "r6", "0_0_0", False, True),
    ("stlfr", "12_3_45", "1:N:0:CAGATC", "", "12_3_45", True, True),
    ("tellseq", "A:1:GGCAAATATCGAGAAGTC", "1:N:0:CAGATC", "A:1", "GGCAAATATCGAGAAGTC", True, True),
    ("tellseq", "A:1:GGCANATATCGAGAAGTC", "1:N:0:CAGATC", "A:1", "GGCANATATCGAGAAGTC", False, True),
    ("tellseq", "A:1:", "1:N:0:CAGATC", "A:1", "N" * 18, False, True),
    ("standard", "r8/2", "VX:i:1\tBX:Z:A01C93B56D11", "r8", "A01C93B56D11", True, False),
    ("standard", "r8/2", "VX:i:1\tBX:Z:100_2_3", "r8", "100_2_3", True, False),
    ("stlfr", "r9#1_2_3", "neither", "r9", "1_2_3", True, False),
]


def reads(spark, *rows):
    return spark.createDataFrame([(f, i, n, c, s, q) for f, i, n, c, s, q in rows], READ)


@pytest.mark.parametrize("chemistry", ["haplotagging", "stlfr", "tellseq", "standard"])
def test_parse(spark, chemistry):
    cases = [c for c in CASES if c[0] == chemistry]
    got = R.parse(reads(spark, *[(0, i, c[1], c[2], "ACGT", "FFFF") for i, c in enumerate(cases)]), chemistry).orderBy("rec_idx").collect()
    assert [(r.id, r.barcode, r.valid, r.forward) for r in got] == [c[3:] for c in cases]


def test_parse_10x(spark):
    rows = reads(spark, (0, 0, "r7", "1:N:0:X", "A" * 16 + "CCGG", "F" * 16 + "IIII"), (1, 0, "r7", "2:N:0:X", "TTTT", "IIII"))
    a, b = R.parse(rows, "10x", 16).orderBy("file_idx").collect()
    assert (a.barcode, a.seq, a.qual, a.designation) == ("A" * 16, "CCGG", "IIII", "1:N:0:X")
    assert (b.barcode, b.seq) == (None, "TTTT")
    with pytest.raises(LinkedReadError):
        R.parse(rows, "10x")


def test_direction(spark):
    with pytest.raises(Exception, match="forward and as reverse"):
        R.parse(reads(spark, (0, 0, "r/1", "2:N:0:X", "A", "F")), "stlfr").collect()
    paired = R.parse(reads(spark, (0, 0, "r#1_1_1", None, "A", "F"), (1, 0, "r#1_1_1", None, "A", "F")), "stlfr", paired=True).orderBy("file_idx").collect()
    assert [r.forward for r in paired] == [True, False]


RENDERED = {
    "stlfr": ("@r#BC 1:N:0:CAGATC\t\nACGT\n+\nFFFF"),
    "tellseq": ("@r:BC 1:N:0:CAGATC\t\nACGT\n+\nFFFF"),
    "haplotagging": ("@r/1\tVX:i:1\tBX:Z:BC\nACGT\n+\nFFFF"),
    "standard": ("@r/1\tVX:i:1\tBX:Z:BC\nACGT\n+\nFFFF"),
    "10x": ("@r 1:N:0:CAGATC\t\nBCACGT\n+\nFFFFFF"),
}


@pytest.mark.parametrize("style", RENDERED)
def test_render(spark, style):
    parsed = R.parse(reads(spark, (0, 0, "r#1_2_3", "1:N:0:CAGATC", "ACGT", "FFFF")), "stlfr")
    assert R.render(parsed, style, F.lit("BC")).select(R.fastq_record()).first()[0] == RENDERED[style]


def test_render_keeps_other_tags(spark):
    parsed = R.parse(reads(spark, (0, 0, "r/1", "RX:Z:q VX:i:0 BX:Z:A01C01B01D01", "A", "F")), "haplotagging")
    assert R.render(parsed, "standard").first().rest == "RX:Z:q\tVX:i:1\tBX:Z:A01C01B01D01"


def test_with_barcode(spark):
    parsed = R.parse(reads(spark, (0, 0, "a#b:", "BX:Z:old RX:Z:1", "A", "F")), "standard")
    row = R.with_barcode(parsed, F.lit("N" * 16)).first()
    assert (row.id, row.barcode, row.valid, row.rest) == ("a", "N" * 16, True, "RX:Z:1")


def nth(style, k):
    if style == "haplotagging":
        d = [k // 96**p % 96 + 1 for p in (3, 2, 1, 0)]
        return "".join(f"{c}{x:02d}" for c, x in zip("ACBD", d, strict=True))
    if style == "stlfr":
        return "_".join(str(k // 1537**p % 1537 + 1) for p in (2, 1, 0))
    n = {"tellseq": 18, "10x": 16, "ncbi": 20}[style]
    return "".join("ATCG"[k // 4**p % 4] for p in range(n - 1, -1, -1))


@pytest.mark.parametrize("style", [*B.STYLES, B.NCBI])
def test_nth_barcode(spark, style):
    rng = random.Random(1)
    ks = [0, 1, 95, 96, 1536, 1537, B.CAPACITY[style] - 1, *(rng.randrange(B.CAPACITY[style]) for _ in range(200))]
    got = spark.createDataFrame([(k,) for k in ks], "k long").select("k", B.nth(F.col("k"), style).alias("b")).collect()
    assert all(r.b == nth(style, r.k) for r in got)
    with pytest.raises(Exception, match="more barcodes"):
        spark.createDataFrame([(B.CAPACITY[style],)], "k long").select(B.nth(F.col("k"), style)).collect()


def test_random_id(spark):
    got = spark.range(50).select(R.random_id(F.lit("a:b:c:d:e:f:g"), F.col("id").cast("string")).alias("i")).collect()
    parts = [r.i.split(":") for r in got]
    assert all(p[:4] == list("abcd") and len(p) == 7 and all(1000 <= int(x) <= 99999 for x in p[4:]) for p in parts)
    assert len({tuple(p) for p in parts}) == 50


@pytest.mark.parametrize(
    ("cigar", "start", "end"),
    [("10M", 100, 110), ("5S10M3S", 100, 110), ("3M2D3M", 100, 108), ("2D3M", 102, 105), ("3M4N3M2D", 100, 110), ("*", None, None), ("5S", None, None), ("3=1X2I2M", 100, 106), ("2H3M5P2M", 100, 105)],
)
def test_spans(spark, cigar, start, end):
    row = A.spans(spark.createDataFrame([(100, cigar)], "pos long, cigar string")).first()
    assert (row.aln_start, row.aln_end) == (start, end)


def test_names_and_tags(spark):
    rows = spark.createDataFrame([("q:ACGTN",), ("q#1_0_3",), ("q#1_2_3",), ("q",), ("q:ACGT:x",)], "n string")
    assert [r[0] for r in rows.select(B.from_name(F.col("n"))).collect()] == ["ACGTN", "1_0_3", "1_2_3", None, None]
    assert [r[0] for r in rows.select(A.name_valid(B.from_name(F.col("n")))).collect()] == [False, False, True, None, None]
    assert spark.range(1).select(A.reverse_complement(F.lit("ACGTN"))).first()[0] == "NACGT"


def test_words_of_comments(spark):
    """Words apart by any blanks; the last tag counts, words of the direction go."""
    comment = "\t1:x RX:Z:q  BX:Z:A01C01B01D01\n1:y BX:Z:A02C01B01D01\x0bxBX:Z:1 "
    row = R.render(R.parse(reads(spark, (0, 0, "r/1", comment, "A", "F")), "standard"), "standard").first()
    assert (row.designation, row.barcode, row.rest) == ("1:x", "A02C01B01D01", "RX:Z:q\txBX:Z:1\tVX:i:1\tBX:Z:A02C01B01D01")


@pytest.mark.parametrize("chemistry", ["standard", "stlfr"])
def test_compiled(spark, chemistry):
    """Parsing and rendering has no word arrays, whose filters are interpreted row by row."""
    parsed = R.parse(reads(spark, (0, 0, "r#1_2_3", "1:x", "A", "F")), chemistry)
    plan = R.render(parsed, "standard")._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan and "split(" not in plan
