"""Commands over files: ``python -m loomread fastq ...`` and ``python -m loomread sam ...``.

Outputs of ``fastq`` commands go to ``PREFIX.*``, those of ``sam`` commands to standard output.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomread import __version__
from loomread.errors import LinkedReadError
from loomread.functions import barcodes as B
from loomread.functions import reads as R
from loomread.operators import concatenation, counting, detect, exchange, molecules, pairing, recoding, sorting
from loomread.sinks.alignments import save_bam, save_sam, write_sam_parts
from loomread.sinks.fastq import save_fastq, write_fastq
from loomread.sinks.lines import save_lines, write_lines
from loomread.sources.bam import header_text, read_alignments, read_header
from loomread.sources.files import check_fastq_paths, check_sam_paths
from loomread.sources.fastq import read_fastq
from loomread.sources.whitelist import read_whitelist


#: What barcodes are read from where they don't stand in the sequence.
_HEADS = ["file_idx", "rec_idx", "name", "comment"]


def session() -> SparkSession:
    """The session in use, or one of this machine."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = SparkSession.builder.appName("loomread").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if SparkSession.getActiveSession():
        return builder.getOrCreate()
    return builder.config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8)).master(os.environ.get("LOOMREAD_MASTER", "local[*]")).getOrCreate()


def _parsed(spark: SparkSession, a: argparse.Namespace, columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """Parsed reads of the command's files (all columns of the file, or those given), and their chemistry."""
    paths = check_fastq_paths(a.input)
    reads = read_fastq(spark, *paths, columns=columns if getattr(a, "chemistry", None) != B.TENX else None)
    chemistry = getattr(a, "chemistry", None) or detect.require(detect.reads_chemistry(reads.where("file_idx = 0")))
    return R.parse(reads, chemistry, paired=len(paths) == 2), chemistry


def _print(lines: Iterable[str]) -> None:
    for x in lines:
        sys.stdout.write(f"{x}\n")


def _values(df: DataFrame) -> Iterable[str]:
    return (r[0] for r in df.toLocalIterator())


def _save(rendered: DataFrame, prefix: str, a: argparse.Namespace, paired: bool = True) -> None:
    """Rendered reads as files of the command: single ones, or with ``--parts`` directories that the tasks write."""
    (write_fastq if a.parts else save_fastq)(rendered, prefix, paired)


def _own(rows: DataFrame, chemistry: str) -> DataFrame:
    return R.render(rows, chemistry)


# ---- fastq


def fq_count(spark: SparkSession, a: argparse.Namespace) -> None:
    parsed, _ = _parsed(spark, a, _HEADS)
    _print(f"{r['barcode']}\t{r['count']}" for r in counting.by_count(counting.count_reads(parsed, a.invalid)).toLocalIterator())


def fq_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    parsed, _ = _parsed(spark, a, _HEADS)
    _print(_values(parsed.select("barcode").distinct()))


def fq_filter_invalid(spark: SparkSession, a: argparse.Namespace) -> None:
    parsed, chemistry = _parsed(spark, a)
    split = counting.split_invalid_reads(parsed)
    _save(_own(split.kept, chemistry), a.prefix, a, len(a.input) == 2)
    if a.invalid:
        _save(_own(split.rejected, chemistry), f"{a.prefix}.invalid", a, len(a.input) == 2)


def fq_filter_singletons(spark: SparkSession, a: argparse.Namespace) -> None:
    parsed, chemistry = _parsed(spark, a)
    split = counting.split_singleton_reads(parsed, paired=len(a.input) == 2)
    if split.kept.isEmpty():
        sys.stderr.write("no barcode is on more than one read; nothing was written\n")
        return
    _save(_own(split.kept, chemistry), a.prefix, a, len(a.input) == 2)
    if a.singletons:
        _save(_own(split.rejected, chemistry), f"{a.prefix}.singletons", a, len(a.input) == 2)


def fq_sample(spark: SparkSession, a: argparse.Namespace) -> None:
    parsed, chemistry = _parsed(spark, a)
    chosen = counting.sample_barcodes(counting.read_barcodes(parsed), a.downsample, a.invalid, a.random_seed)
    save_lines(_values(chosen), f"{a.prefix}.bc")
    _save(_own(counting.keep_barcodes(parsed, chosen), chemistry), a.prefix, a, len(a.input) == 2)


def _save_map(mapping: DataFrame, path: str) -> None:
    save_lines(_values(recoding.map_lines(mapping)), path)


def fq_convert(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = check_fastq_paths(a.input)
    reads = read_fastq(spark, *paths)
    found = detect.reads_chemistry(reads.where("file_idx = 0")).first()["chemistry"]
    if found == detect.NONE and a.barcodes:
        wl, length = read_whitelist(spark, a.barcodes)
        found, parsed = B.TENX, recoding.pair_10x(R.parse(reads, B.TENX, length, paired=len(paths) == 2), wl, length)
    else:
        parsed = R.parse(reads, detect.require(detect.reads_chemistry(reads.where("file_idx = 0"))), paired=len(paths) == 2)
    out = recoding.convert(parsed, found, a.target)
    recoding.check_capacity(out.mapping, a.target)
    _save_map(out.mapping, f"{a.prefix}.bc")
    _save(out.rows, a.prefix, a, len(paths) == 2)


def fq_standardize(spark: SparkSession, a: argparse.Namespace) -> None:
    parsed, _ = _parsed(spark, a)
    out = recoding.standardize_reads(parsed, a.style)
    if a.style:
        recoding.check_capacity(out.mapping, a.style)
        _save_map(out.mapping, f"{a.prefix}.bc")
    _save(out.rows, a.prefix, a, len(a.input) == 2)


def fq_sort(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = check_fastq_paths(a.input)
    reads, order = sorting.reads_keyed(R.parse(read_fastq(spark, *paths), B.HAPLOTAGGING, paired=len(paths) == 2).drop("barcode", "valid"), a.tag)
    for n, forward in ((1, True), (2, False)) if len(paths) == 2 else ((1, None),):
        side = reads if forward is None else reads.where(F.col("forward") == forward)
        name = F.concat(F.col("id"), F.lit("/"), F.when(F.col("forward"), "1").otherwise("2"))
        text = R.fastq_record(name, F.array_join(R.tokens(F.col("comment")), "\t"))
        if a.parts:
            write_lines(side.select("*", text.alias("value")), f"{a.prefix}.R{n}.fq.gz.parts", order, "gzip")
        else:
            save_lines(_values(side.orderBy(*order).select(text)), f"{a.prefix}.R{n}.fq.gz")


def fq_spoof_hic(spark: SparkSession, a: argparse.Namespace) -> None:
    if len(a.input) != 2:
        raise LinkedReadError("a forward and a reverse file are needed")
    parsed, _ = _parsed(spark, a)
    pairs = pairing.spoof_pairs(parsed, a.max_pairs, a.singletons, a.invalid)
    _save(pairing.pair_reads(pairs), a.prefix, a)


def fq_ncbi(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = check_fastq_paths(a.input)
    save_bam(exchange.to_unaligned(read_fastq(spark, *paths), len(paths) == 2), {"HD": [{"VN": "1.6", "SO": "unsorted"}]}, sys.stdout.buffer, ["rec_idx"])


# ---- sam


def _emit(alns: DataFrame, header: dict, a: argparse.Namespace, order: list | None = None, out=None) -> None:  # noqa: ANN001
    order = order or ["file_idx", "rec_idx"]
    if a.parts and out is None:
        write_sam_parts(alns, a.parts, order)
        save_lines(header_text(header).splitlines(), f"{a.parts.rstrip('/')}.header")
    else:
        (save_sam if a.sam else save_bam)(alns, header, out or sys.stdout.buffer, order)


def sam_count(spark: SparkSession, a: argparse.Namespace) -> None:
    counts = counting.by_count(counting.count_alignments(read_alignments(spark, a.input), a.invalid))
    _print(f"{r['barcode']}\t{r['count']}" for r in counts.toLocalIterator())


def sam_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    _print(_values(counting.alignment_barcodes(read_alignments(spark, a.input)).select("barcode")))


def sam_filter_invalid(spark: SparkSession, a: argparse.Namespace) -> None:
    alns = read_alignments(spark, a.input)
    split = counting.split_invalid_alignments(alns, detect.require(detect.alignments_chemistry(alns)))
    _split(split, a, a.invalid)


def sam_filter_singletons(spark: SparkSession, a: argparse.Namespace) -> None:
    split = counting.split_singleton_alignments(read_alignments(spark, a.input))
    if split.kept.isEmpty():
        sys.stderr.write("no barcode is on more than two records; nothing was written\n")
        return
    _split(split, a, a.singletons)


def _split(split: counting.Split, a: argparse.Namespace, other: str | None) -> None:
    header = read_header(a.input)
    _emit(split.kept, header, a)
    if other:
        with open(other, "wb") as f:
            _emit(split.rejected, header, a, out=f)


def sam_sample(spark: SparkSession, a: argparse.Namespace) -> None:
    alns = read_alignments(spark, a.input)
    chosen = counting.sample_barcodes(counting.alignment_barcodes(alns), a.downsample, a.invalid, a.random_seed)
    _emit(counting.keep_barcodes(alns, chosen, "bx"), read_header(a.input), a)


def sam_sort(spark: SparkSession, a: argparse.Namespace) -> None:
    alns = read_alignments(spark, a.input)
    header = read_header(a.input)
    contigs = {s["SN"]: i for i, s in enumerate(header.get("SQ", []))}
    rank = F.element_at(F.create_map(*[F.lit(x) for p in contigs.items() for x in p]), F.col("rname")) if contigs else F.col("rname")
    keyed, (tag, _, *rest) = sorting.alignments_keyed(alns, a.tag)
    _emit(keyed.withColumn("__rank", rank), header | {"HD": [{"VN": "1.6", "SO": "unknown"}]}, a, [tag, F.col("__rank").asc_nulls_last(), *rest])


def sam_standardize(spark: SparkSession, a: argparse.Namespace) -> None:
    out = recoding.standardize_alignments(read_alignments(spark, a.input), a.style)
    if a.style:
        recoding.check_capacity(out.mapping, a.style)
        _save_map(out.mapping, f"{a.input}.bc")
    _emit(out.rows, read_header(a.input), a)


def sam_assign_mi(spark: SparkSession, a: argparse.Namespace) -> None:
    alns = read_alignments(spark, a.input)
    if not detect.is_standard(alns).first()["standard"]:
        raise LinkedReadError("no record has both BX and VX tags; standardize the file first")
    chemistry = detect.require(detect.alignments_chemistry(alns))
    _emit(molecules.assign_molecules(alns, chemistry, a.cutoff, a.keep_unmapped), read_header(a.input), a)


def sam_concat(spark: SparkSession, a: argparse.Namespace) -> None:
    check_sam_paths(a.input)
    out = concatenation.concat_alignments(read_alignments(spark, *a.input), a.mi, by_molecule=bool(a.mi))
    _emit(out, concatenation.merged_header(read_header(a.input[0]), " ".join(["loomread", *sys.argv[1:]])), a)


def sam_ncbi(spark: SparkSession, a: argparse.Namespace) -> None:
    reads = exchange.to_reads(read_alignments(spark, a.input))
    rows = reads.withColumns({"id": F.col("name"), "rest": F.col("comment"), "forward": F.col("file_idx") == 0})
    _save(rows, a.prefix, a)


# ---- arguments


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomread", description="Linked-read FASTQ and SAM/BAM files on Spark.")
    top.add_argument("--version", action="version", version=f"loomread {__version__}")
    groups = top.add_subparsers(dest="group", required=True)
    fq = groups.add_parser("fastq", help="FASTQ files").add_subparsers(dest="command", required=True)
    sam = groups.add_parser("sam", help="SAM and BAM files").add_subparsers(dest="command", required=True)

    def add(group, name: str, run: Callable, *, prefix: bool = False, many: bool = False, sam_out: bool = False, first: tuple = ()) -> argparse.ArgumentParser:  # noqa: ANN001
        p = group.add_parser(name)
        p.set_defaults(run=run)
        for args, options in first:
            p.add_argument(*args, **options)
        if prefix:
            p.add_argument("prefix")
        if sam_out:
            p.add_argument("-S", "--sam", action="store_true", help="write SAM instead of BAM")
            p.add_argument("--parts", help="a directory of SAM parts, each written by the task that has it; its header beside it")
        p.add_argument("input", **({"nargs": "+"} if many else {}))
        return p

    def amount(p: argparse.ArgumentParser, invalid: float) -> None:
        p.add_argument("-d", "--downsample", type=float, required=True)
        p.add_argument("-i", "--invalid", type=float, default=invalid)
        p.add_argument("--random-seed", type=int, default=0)

    style = {"choices": B.STYLES, "type": str.lower}
    flag = {"action": "store_true"}
    tag = ((("tag",), {}),)
    target = ((("prefix",), {}), (("target",), dict(style)))
    p = add(fq, "convert", fq_convert, many=True, first=target)
    p.add_argument("-b", "--barcodes")
    add(fq, "count", fq_count, many=True).add_argument("-i", "--invalid", **flag)
    add(fq, "extract", fq_extract, many=True)
    add(fq, "filter-invalid", fq_filter_invalid, prefix=True, many=True).add_argument("-i", "--invalid", **flag)
    add(fq, "filter-singletons", fq_filter_singletons, prefix=True, many=True).add_argument("-s", "--singletons", **flag)
    add(fq, "ncbi", fq_ncbi, many=True)
    amount(add(fq, "sample", fq_sample, prefix=True, many=True), 1.0)
    add(fq, "sort", fq_sort, prefix=True, many=True, first=tag)
    p = add(fq, "spoof-hic", fq_spoof_hic, prefix=True, many=True)
    p.add_argument("-i", "--invalid", **flag)
    p.add_argument("-s", "--singletons", **flag)
    p.add_argument("-m", "--max-pairs", type=int, default=1)
    add(fq, "standardize", fq_standardize, prefix=True, many=True).add_argument("-s", "--style", **style)
    for p in fq.choices.values():
        p.add_argument("--chemistry", choices=B.CHEMISTRIES, help="instead of detecting it")
        p.add_argument("--parts", action="store_true", help="write directories of parts, each by the task that has it")

    p = add(sam, "assign-mi", sam_assign_mi, sam_out=True)
    p.add_argument("-c", "--cutoff", type=int, default=0)
    p.add_argument("-u", "--keep-unmapped", **flag)
    add(sam, "concat", sam_concat, sam_out=True, many=True).add_argument("--mi", **style)
    add(sam, "count", sam_count).add_argument("-i", "--invalid", **flag)
    add(sam, "extract", sam_extract)
    add(sam, "filter-invalid", sam_filter_invalid, sam_out=True).add_argument("-i", "--invalid")
    add(sam, "filter-singletons", sam_filter_singletons, sam_out=True).add_argument("-s", "--singletons")
    add(sam, "ncbi", sam_ncbi, prefix=True).add_argument("--parts", action="store_true")
    amount(add(sam, "sample", sam_sample, sam_out=True), 0.0)
    add(sam, "sort", sam_sort, sam_out=True, first=tag)
    add(sam, "standardize", sam_standardize, sam_out=True).add_argument("-s", "--style", **style)
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        a.run(session(), a)
    except LinkedReadError as e:
        sys.stderr.write(f"error: {e}\n")
        return 1
    return 0
