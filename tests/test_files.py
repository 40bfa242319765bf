"""Files, commands and streams."""

import gzip
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomread import cli
from loomread.errors import LinkedReadError, WhitelistError
from loomread.functions import alignments as A
from loomread.operators import molecules
from loomread.sinks.alignments import END, bgzf, save_bam, save_sam, write_sam_parts
from loomread.sinks.fastq import write_fastq
from loomread.sources.bam import header_text, parse_header, read_alignments, read_header
from loomread.sources.files import check_fastq_paths, check_sam_paths
from loomread.sources.fastq import read_fastq
from loomread.sources.whitelist import read_whitelist

SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:c1\tLN:1000
@SQ\tSN:c2\tLN:500
@RG\tID:s\tSM:s
@CO\ta note
a\t99\tc1\t11\t60\t5S10M2D3M\t=\t50\t57\tACGTACGTACGTACGTAC\tFFFFFFFFFFFFFFFFFF\tBX:Z:A01C01B01D01\tVX:i:1\tXA:A:q\tXF:f:1.5\tXB:B:S,1,2,300\tNM:i:-3
b\t16\tc2\t1\t0\t4M\t*\t0\t0\tACGN\t*\tVX:i:0\tBX:Z:A00C01B01D01
c\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tFF
d\t0\tc1\t20\t60\t10M\t*\t0\t0\t*\t*\tBX:Z:A01C01B01D01-2\tVX:i:1
"""


@pytest.fixture
def fastq(tmp_path):
    r1, r2 = tmp_path / "x.R1.fq.gz", tmp_path / "x.R2.fq"
    with gzip.open(r1, "wt") as f:
        f.writelines(f"@r{i}#{i % 3}_1_2 1:N:0:CAG\nACGT\n+\nFFFF\n" for i in range(9))
    r2.write_text("".join(f"@r{i}#{i % 3}_1_2 2:N:0:CAG\nTTTT\n+\nIIII\n" for i in range(8)))
    return str(r1), str(r2)


def lines(path):
    with (gzip.open(path, "rt") if str(path).endswith(".gz") else open(path)) as f:
        return f.read().splitlines()


def test_fastq_source(spark, fastq):
    df = read_fastq(spark, *fastq)
    assert df.count() == 17
    row = df.where("file_idx = 1 and rec_idx = 4").first()
    assert (row.name, row.comment, row.seq, row.qual) == ("r4#1_1_2", "2:N:0:CAG", "TTTT", "IIII")


def blocks(data, size=300):
    return b"".join(bgzf(data[i : i + size]) for i in range(0, len(data), size)) + END


@pytest.mark.parametrize("kind", ["plain", "bgzf", "gzip", "no last line end", "crlf"])
def test_one_file_read_by_several_tasks(spark, tmp_path, kind):
    text = "".join(f"@r{i}#{i}_1_2 1:N:0:CAG\n{'ACGT' * (i % 9 + 1)}\n+\n{'F@+@' * (i % 9 + 1)}\n" for i in range(400))
    text = text.replace("\n", "\r\n") if kind == "crlf" else text.rstrip() if kind == "no last line end" else text
    path = str(tmp_path / ("x.fq.gz" if kind in ("bgzf", "gzip") else "x.fq"))
    Path(path).write_bytes(blocks(text.encode()) if kind == "bgzf" else gzip.compress(text.encode()) if kind == "gzip" else text.encode())
    want = read_fastq(spark, path).orderBy("rec_idx").collect()
    assert [r.rec_idx for r in want] == list(range(400)) and want[7].qual == "F@+@" * 8
    for step in (500, 777, 5000):
        df = read_fastq(spark, path, step=step)
        assert (df.rdd.getNumPartitions() > 1) == (kind != "gzip" and 2 * step < Path(path).stat().st_size)
        assert df.orderBy("rec_idx").collect() == want
    narrow = read_fastq(spark, path, columns=["rec_idx", "name"], step=777)
    assert narrow.columns == ["rec_idx", "name"] and narrow.orderBy("rec_idx").collect()[5].name == "r5#5_1_2"


@pytest.mark.parametrize("packed", [False, True])
def test_one_sam_file_read_by_several_tasks(spark, tmp_path, packed):
    text = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:9000\n" + "".join(f"q{i}\t0\tc1\t{i + 1}\t60\t4M\t*\t0\t0\tACGT\tFFFF\tBX:Z:A01C01B01D{i % 97:02d}\n" for i in range(300))
    path = str(tmp_path / "x.sam")
    Path(path).write_bytes(blocks(text.encode()) if packed else text.encode())
    want = read_alignments(spark, path).orderBy("rec_idx").collect()
    assert [r.rec_idx for r in want] == list(range(300))
    for step in (400, 1111):
        df = read_alignments(spark, path, step=step)
        assert df.rdd.getNumPartitions() > 1 and df.orderBy("rec_idx").collect() == want


def test_path_checks(tmp_path):
    for bad in (["a.fq", "a.fq"], ["a.txt"], ["a.fq"] * 3, []):
        with pytest.raises(LinkedReadError):
            check_fastq_paths(bad)
    assert check_fastq_paths(["A.FASTQ.GZ"]) and check_sam_paths(["x.BAM"])
    with pytest.raises(LinkedReadError):
        check_sam_paths(["x.cram"])


def test_broken_fastq(spark, tmp_path):
    p = tmp_path / "bad.fq"
    p.write_text("@a\nACGT\n+\nFFF\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        read_fastq(spark, str(p)).collect()


@pytest.mark.parametrize(("text", "error"), [("ACGT\nACGT AC\n", "more than one word"), ("acgt\n", "letters"), ("ACGX\n", "letters"), ("A" * 61 + "\n", "bases"), ("ACGT\nACG\n", "one length"), ("\n", "no barcodes")])
def test_whitelist_errors(spark, tmp_path, text, error):
    (tmp_path / "w.txt").write_text(text)
    with pytest.raises(WhitelistError, match=error):
        read_whitelist(spark, str(tmp_path / "w.txt"))


def test_whitelist(spark, tmp_path):
    with gzip.open(tmp_path / "w.txt.gz", "wt") as f:
        f.write("ACGT\nTTTT\nACGT\n")
    df, n = read_whitelist(spark, str(tmp_path / "w.txt.gz"))
    assert n == 4 and df.count() == 2


def test_sam_and_bam_round_trip(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    alns = read_alignments(spark, str(tmp_path / "x.sam"))
    header = read_header(str(tmp_path / "x.sam"))
    assert header_text(header) == "".join(x + "\n" for x in SAM.splitlines() if x[0] == "@")
    assert parse_header(header_text(header)) == header
    a, b, c, d = alns.orderBy("rec_idx").collect()
    assert (a.pos, a.aln_start, a.aln_end, a.bx, a.vx, a.is_read1) == (10, 10, 25, "A01C01B01D01", 1, True)
    assert (c.rname, c.is_unmapped, c.aln_start) == (None, True, None)
    with open(tmp_path / "y.bam", "wb") as f:
        save_bam(alns, header, f, ["rec_idx"])
    assert read_header(str(tmp_path / "y.bam")) == header
    with open(tmp_path / "z.sam", "wb") as f:
        save_sam(read_alignments(spark, str(tmp_path / "y.bam")), header, f, ["rec_idx"])
    assert (tmp_path / "z.sam").read_text() == SAM
    write_sam_parts(alns, str(tmp_path / "parts"), ["rec_idx"])
    assert "".join(p.read_text() for p in sorted(Path(tmp_path / "parts").glob("part-*"))) == "".join(x + "\n" for x in SAM.splitlines() if x[0] != "@")


def test_write_fastq_parts(spark, tmp_path, fastq):
    from loomread.functions import reads as R

    write_fastq(R.render(R.parse(read_fastq(spark, *fastq), "stlfr"), "stlfr"), str(tmp_path / "out"))
    got = [x for p in sorted(Path(tmp_path / "out.R1.fq.gz.parts").glob("part-*")) for x in lines(p)]
    assert got[::4] == [f"@r{i}#{i % 3}_1_2 1:N:0:CAG\t" for i in range(9)]


def run(spark, *args):
    return cli.main([str(a) for a in args])


def test_fastq_commands(spark, tmp_path, fastq, capsys):
    out = tmp_path / "o" / "p"
    assert run(spark, "fastq", "count", *fastq) == 0
    assert capsys.readouterr().out.splitlines() == ["1_1_2\t3", "2_1_2\t3"]
    assert run(spark, "fastq", "count", *fastq, "-i") == 0
    assert "0_1_2\t3" in capsys.readouterr().out
    run(spark, "fastq", "extract", *fastq)
    assert set(capsys.readouterr().out.split()) == {"0_1_2", "1_1_2", "2_1_2"}
    run(spark, "fastq", "filter-invalid", out, *fastq, "-i")
    assert len(lines(f"{out}.R1.fq.gz")) == 24 and len(lines(f"{out}.invalid.R2.fq.gz")) == 12
    run(spark, "fastq", "convert", out, "haplotagging", *fastq)
    assert lines(f"{out}.R1.fq.gz")[0] == "@r0/1\tVX:i:0\tBX:Z:A00C00B00D00" and lines(f"{out}.bc")[1] == "1_1_2\tA01C01B01D01"
    run(spark, "fastq", "filter-singletons", out, *fastq, "-s")
    assert len(lines(f"{out}.R1.fq.gz")) == 24 and lines(f"{out}.singletons.R1.fq.gz") == []
    run(spark, "fastq", "sample", "-d", "2", out, *fastq)
    assert len(lines(f"{out}.bc")) == 2
    run(spark, "fastq", "standardize", out, *fastq)
    assert lines(f"{out}.R2.fq.gz")[4] == "@r1/2\tVX:i:1\tBX:Z:1_1_2"
    run(spark, "fastq", "sort", "BX", f"{out}.s", f"{out}.R1.fq.gz", f"{out}.R2.fq.gz")
    assert [x.split("BX:Z:")[1] for x in lines(f"{out}.s.R1.fq.gz")[::4]] == sorted(x.split("BX:Z:")[1] for x in lines(f"{out}.s.R1.fq.gz")[::4])
    run(spark, "fastq", "spoof-hic", f"{out}.h", *fastq, "-s")
    assert len(lines(f"{out}.h.R1.fq.gz")) == len(lines(f"{out}.h.R2.fq.gz"))
    (tmp_path / "none.fq").write_text("@a\nA\n+\nF\n")
    assert run(spark, "fastq", "count", tmp_path / "none.fq") == 1
    assert "error:" in capsys.readouterr().err


def test_convert_10x(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@a 1:N:0:X\nAAAACC\n+\nFFFFFF\n@b 1:N:0:X\nCCCCGG\n+\nFFFFFF\n")
    (tmp_path / "b.fq").write_text("@a 2:N:0:X\nTT\n+\nII\n")
    (tmp_path / "w.txt").write_text("AAAA\n")
    assert run(spark, "fastq", "convert", "-b", tmp_path / "w.txt", tmp_path / "o", "stlfr", tmp_path / "a.fq", tmp_path / "b.fq") == 0
    assert lines(f"{tmp_path}/o.R1.fq.gz") == ["@a#1_1_1 1:N:0:X\t", "CC", "+", "FF", "@b#0_0_0 1:N:0:X\t", "GG", "+", "FF"]
    assert lines(f"{tmp_path}/o.R2.fq.gz")[0] == "@a#1_1_1 2:N:0:X\t"


def test_sam_commands(tmp_path):
    """In processes of their own, as they write to standard output."""
    (tmp_path / "x.sam").write_text(SAM)

    def out(*args):
        r = subprocess.run([sys.executable, "-m", "loomread", "sam", *map(str, args)], capture_output=True, timeout=300)
        assert r.returncode == 0, r.stderr.decode()[-2000:]
        return r.stdout

    bam = tmp_path / "x.bam"
    bam.write_bytes(out("assign-mi", "-c", "100", tmp_path / "x.sam"))
    text = out("standardize", "-S", bam).decode()
    assert "MI:i:1" in text and "DX:Z:A01C01B01D01-2" in text
    assert out("count", "-i", tmp_path / "x.sam").decode() == "A01C01B01D01\t1\n"


def test_more_sam_commands(spark, tmp_path, capfdbinary):
    (tmp_path / "x.sam").write_text(SAM)
    x = tmp_path / "x.sam"

    def out(*args):
        assert run(spark, "sam", *args) == 0
        sys.stdout.flush()
        return capfdbinary.readouterr().out.decode()

    names = lambda text: [r.split("\t")[0] for r in text.splitlines() if r[0] != "@"]
    assert set(out("extract", x).split()) == {"A01C01B01D01", "A00C01B01D01", "A01C01B01D01-2"}
    assert names(out("filter-invalid", "-S", "-i", tmp_path / "bad.sam", x)) == ["a", "d"]
    assert names((tmp_path / "bad.sam").read_text()) == ["b", "c"]
    assert names(out("sort", "-S", "BX", x)) == ["c", "b", "a", "d"]
    assert set(names(out("sample", "-S", "-d", "2", x))) == {"a", "d"}
    merged = out("concat", "-S", x, x)
    assert "ID:concat" in merged and len(names(merged)) == 8
    assert run(spark, "sam", "ncbi", tmp_path / "o", x) == 0
    assert lines(f"{tmp_path}/o.R1.fq.gz")[0].startswith("@a/1\tBX:Z:A01C01B01D01\tVX:i:1")
    assert run(spark, "sam", "filter-singletons", "-S", x) == 0


def test_stream_molecules(spark, tmp_path):
    from loomread.streaming.molecules import stream_counts, stream_molecules

    rows = [("c1", "b", i, p, p + 10, False, bool(i % 2)) for i, p in enumerate([0, 50, 300, 320, 900])] + [("c2", "b", 5, 0, 10, False, False)]
    schema = "rname string, bx string, rec_idx long, aln_start long, aln_end long, is_reverse boolean, is_paired boolean"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream_molecules(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 100).writeStream.format("memory").queryName("mols").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.rec_idx: r.start_rec for r in spark.table("mols").collect()}
    want = {r.rec_idx: r.start_rec for r in molecules.molecule_starts(df, 100).collect()}
    assert got == want and len(set(want.values())) == 4
    parsed = spark.createDataFrame([("x", True, 0), ("x", True, 0), ("y", True, 1), ("z", False, 0)], "barcode string, valid boolean, file_idx int")
    parsed.write.parquet(str(tmp_path / "in2"))
    q = stream_counts(spark.readStream.schema(parsed.schema).parquet(str(tmp_path / "in2"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r["barcode"]: r["count"] for r in spark.table("counts").collect()} == {"x": 2, "y": 1}


def test_with_tags_helper(spark):
    df = spark.range(1).select(A.with_tags(F.lit(None).cast("array<struct<tag:string,type:string,value:string>>"), (None, A.tag("BX", "Z", F.lit("q")))).alias("t"))
    assert [t.value for t in df.first().t] == ["q"]


def test_commands_write_parts(spark, fastq, tmp_path):
    assert cli.main(["fastq", "filter-invalid", "--parts", str(tmp_path / "p"), *fastq]) == 0
    assert cli.main(["fastq", "filter-invalid", str(tmp_path / "q"), *fastq]) == 0
    for n in (1, 2):
        parts = [x for p in sorted((tmp_path / f"p.R{n}.fq.gz.parts").glob("part-*.gz")) for x in lines(p)]
        assert parts == lines(tmp_path / f"q.R{n}.fq.gz")
    sam = tmp_path / "x.sam"
    sam.write_text(SAM)
    assert cli.main(["sam", "sort", "--parts", str(tmp_path / "sorted"), "BX", str(sam)]) == 0
    got = [x for p in sorted((tmp_path / "sorted").glob("part-*")) for x in lines(p)]
    assert sorted(x.split("\t")[0] for x in got) == ["a", "b", "c", "d"]
    assert lines(tmp_path / "sorted.header")[0].startswith("@HD")
