"""Operators against plain sequential models of their rules."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomread.errors import CapacityError, LinkedReadError, SampleSizeError, UndeterminedChemistry
from loomread.functions import alignments as A
from loomread.functions import reads as R
from loomread.operators import concatenation, counting, detect, exchange, molecules, pairing, recoding, sorting
from loomread.plans.ordinals import with_ordinal, with_runs
from loomread.schema import ALN, READ


def make_reads(n, seed, barcodes=8, both=0.8):
    """Random stlfr pairs; some reverse reads are missing, some barcodes invalid, some mates differ."""
    rng = random.Random(seed)
    code = lambda: f"{rng.randrange(barcodes)}_{rng.randrange(3)}_1"
    rows = []
    for i in range(n):
        own = code()
        rows.append((0, i, f"r{i}#{own}", "1:N:0:C", "ACGT", "FFFF"))
        if rng.random() < both:
            rows.append((1, i, f"r{i}#{own if rng.random() < 0.7 else code()}", "2:N:0:C", "TTTT", "IIII"))
    return rows


def parsed_of(rows):
    return [(f, i, n.split("#")[1], all(int(x) for x in (n.split("#")[1].split("_")[0], n.split("#")[1].split("_")[1]))) for f, i, n, *_ in rows]


@pytest.fixture(params=[1, 2])
def pairs(request, spark):
    rows = make_reads(120, request.param)
    return rows, R.parse(spark.createDataFrame(rows, READ), "stlfr")


@pytest.mark.parametrize("invalid", [False, True])
def test_count_reads(pairs, invalid):
    rows, parsed = pairs
    want: Counter = Counter(b for f, _, b, v in parsed_of(rows) if f == 0 and (v or invalid))
    for f, _, b, v in parsed_of(rows):
        if f == 1 and (v or invalid) and b not in want:
            want[b] = 1
    assert {r["barcode"]: r["count"] for r in counting.count_reads(parsed, invalid).collect()} == dict(want)
    ordered = [r["count"] for r in counting.by_count(counting.count_reads(parsed, invalid)).collect()]
    assert ordered == sorted(ordered, reverse=True)


def test_pair_counts_and_singletons(pairs):
    rows, parsed = pairs
    by: dict = {}
    for f, i, b, _ in parsed_of(rows):
        by.setdefault(i, {})[f] = b
    want = Counter(b for d in by.values() for b in set(d.values()))
    assert {r["barcode"]: r["count"] for r in counting.pair_counts(parsed).collect()} == dict(want)
    split = counting.split_singleton_reads(parsed)
    valid = {(f, i) for f, i, b, v in parsed_of(rows) if v}
    kept = {(r.file_idx, r.rec_idx) for r in split.kept.collect()}
    assert kept == {(f, i) for f, i, b, v in parsed_of(rows) if v and want[b] > 1}
    assert {(r.file_idx, r.rec_idx) for r in split.rejected.collect()} == valid - kept


def test_split_invalid(pairs):
    rows, parsed = pairs
    split = counting.split_invalid_reads(parsed)
    assert split.kept.count() + split.rejected.count() == len(rows)
    assert split.kept.count() == sum(v for *_, v in parsed_of(rows))


def test_sample(pairs):
    _, parsed = pairs
    codes = counting.read_barcodes(parsed)
    every = codes.count()
    for amount, n in ((3, 3), (0.5, every // 2)):
        chosen = counting.sample_barcodes(codes, amount, seed=5)
        assert chosen.count() == n
        assert sorted(r[0] for r in chosen.collect()) == sorted(r[0] for r in counting.sample_barcodes(codes, amount, seed=5).collect())
        kept = counting.keep_barcodes(parsed, chosen)
        assert kept.count() == parsed.join(chosen, "barcode").count()
        assert kept.select("barcode").distinct().count() == n
    assert counting.sample_barcodes(codes, 0.999, 0.0).join(codes.where("valid"), "barcode", "left_anti").count() == 0
    with pytest.raises(SampleSizeError):
        counting.sample_barcodes(codes, every + 1)
    with pytest.raises(LinkedReadError):
        counting.sample_barcodes(codes, 0)


def test_convert_and_back(pairs):
    rows, parsed = pairs
    out = recoding.convert(parsed, "stlfr", "haplotagging")
    mapping = {r.barcode: r for r in out.mapping.collect()}
    first: list = []
    for _, _, b, v in sorted(parsed_of(rows), key=lambda x: (x[1], x[0])):
        if v and b not in first:
            first.append(b)
    assert [b for b, _ in sorted(((b, m.new_barcode) for b, m in mapping.items() if m.valid), key=lambda x: first.index(x[0]))] == first
    assert all(m.new_barcode == "A00C00B00D00" for m in mapping.values() if not m.valid)
    good = [m.new_barcode for m in mapping.values() if m.valid]
    assert len(set(good)) == len(good)
    assert mapping[first[0]].new_barcode == "A01C01B01D01"
    again = R.parse(out.rows.select("file_idx", "rec_idx", F.col("id").alias("name"), F.col("rest").alias("comment"), "seq", "qual"), "haplotagging", paired=True)
    back = recoding.convert(again, "haplotagging", "stlfr").rows.join(parsed.select("file_idx", "rec_idx", F.col("barcode").alias("was"), F.col("valid").alias("was_valid")), ["file_idx", "rec_idx"])
    groups = back.where("was_valid").groupBy("was").agg(F.countDistinct("new_barcode").alias("n")).collect()
    assert all(r.n == 1 for r in groups)
    with pytest.raises(LinkedReadError):
        recoding.convert(parsed, "stlfr", "stlfr")


def test_capacity(spark):
    mapping = spark.range(3).select(F.lit(True).alias("valid"))
    recoding.check_capacity(mapping, "10x")
    from loomread.functions import barcodes as B

    old = B.CAPACITY["10x"]
    B.CAPACITY["10x"] = 2
    try:
        with pytest.raises(CapacityError):
            recoding.check_capacity(mapping, "10x")
    finally:
        B.CAPACITY["10x"] = old


def test_pair_10x(spark):
    rows = [(0, 0, "a", "1:N:0:X", "AAAACC", "FFFFFF"), (1, 0, "a", "2:N:0:X", "GGGG", "FFFF"), (0, 1, "b", "1:N:0:X", "CCCCGG", "FFFFFF"), (1, 2, "c", "2:N:0:X", "TT", "FF")]
    got = recoding.pair_10x(R.parse(spark.createDataFrame(rows, READ), "10x", 4), spark.createDataFrame([("AAAA",)], "barcode string"), 4).collect()
    assert {(r.file_idx, r.rec_idx): (r.barcode, r.valid) for r in got} == {(0, 0): ("AAAA", True), (1, 0): ("AAAA", True), (0, 1): ("CCCC", False), (1, 2): ("NNNN", False)}


@pytest.mark.parametrize("m", [1, 2, 5])
def test_spoof_row_law(spark, m):
    rng = random.Random(m)
    rows = []
    for run, code in enumerate(["1_1_1", "2_1_1", "1_1_1", "0_1_1", "3_3_3", "4_1_1"]):
        for _ in range(rng.randrange(1, 7) if run != 4 else 1):
            i = len(rows) // 2
            rows += [(0, i, f"a:b:c:d:{i}#{code}", "1:N:0:C", "AC", "FF"), (1, i, f"a:b:c:d:{i}#{code if i % 5 else '0_0_0'}", "2:N:0:C", "GT", "FF")]
    parsed = R.parse(spark.createDataFrame(rows, READ), "stlfr")
    sizes, last = [], None
    bad = 0
    for i in range(len(rows) // 2):
        code = rows[2 * i][2].split("#")[1]
        if code.startswith("0_") or i % 5 == 0:
            bad += 1
            continue
        if code != last:
            sizes.append(0)
        sizes[-1] += 1
        last = code
    out = pairing.spoof_pairs(parsed, m, singletons=True, invalid=True).collect()
    assert len(out) == sum(1 if n == 1 else n * min(m, n) for n in sizes) + bad
    made = [r for r in out if r.id_1.count(":") == 6 and r.valid_1 and r.valid_2]
    assert len(made) == sum(n * min(m, n) for n in sizes if n > 1)
    assert all(r.id_1 == r.id_2 for r in made)
    assert len({(r.rec_idx, r.mate_idx) for r in made}) == len(made)
    if m == 1:
        assert all(r.rec_idx != r.mate_idx for r in made)
    assert pairing.pair_reads(pairing.spoof_pairs(parsed, m)).count() == 2 * sum(n * min(m, n) for n in sizes if n > 1)


def test_detect(spark):
    rows = lambda *x: spark.createDataFrame([(0, i, n, c, "A", "F") for i, (n, c) in enumerate(x)], READ)
    kind = lambda df: detect.reads_chemistry(df).first()[0]
    assert kind(rows(("a", None), ("b#1_2_3", None), ("c:ACGT", None))) == "stlfr"
    assert kind(rows(("a:ACGTN", None), ("b#1_2_3", None))) == "tellseq"
    assert kind(rows(("a#1_2_3", "x BX:Z:A01C01B01D01"))) == "haplotagging"
    assert kind(rows(*[("a", None)] * 100, ("b#1_2_3", None))) == "none"
    with pytest.raises(UndeterminedChemistry):
        detect.require(detect.reads_chemistry(rows(("a", None))))
    alns = spark.createDataFrame([(0, None, None), (1, "ACGTN", 1)], "rec_idx long, bx string, vx int")
    assert detect.alignments_chemistry(alns).first()[0] == "tellseq"
    assert detect.is_standard(alns).first()[0] is True
    assert detect.is_standard(alns.withColumn("vx", F.lit(None).cast("int"))).first()[0] is False


# ---- alignments


def alns_of(spark, rows):
    """Rows (qname, flag, rname, pos, cigar, tags) as promoted alignments."""
    full = [(0, i, q, f, c, p, 60, g, "*", -1, 0, "ACGT", "FFFF", [tuple(t.split(":", 2)) for t in tags.split()]) for i, (q, f, c, p, g, tags) in enumerate(rows)]
    return A.promoted(spark.createDataFrame(full, ALN))


def model_mi(rows, cutoff, keep_unmapped):
    """The rules one after the other: (kept, barcode, molecule) of each record."""
    out, state, mi, contig = [], {}, 0, None
    for r in rows:
        if contig is not None and r["rname"] != contig:
            state = {}
        contig = r["rname"]
        bx, vx = r["bx"], r["vx"]
        if r["is_unmapped"] and not keep_unmapped:
            out.append(None)
        elif vx == 0 and bx is not None:
            out.append((bx.split("-")[0], None))
        elif bx is None or vx is None:
            out.append(("A00C00B00D00", None))
        elif r["aln_start"] is None:
            out.append((bx.split("-")[0], None) if keep_unmapped else None)
        else:
            if bx not in state or (cutoff > 0 and max(0, r["aln_start"] - state[bx][0]) > cutoff):
                mi += 1
                state[bx] = [r["aln_end"], mi]
            elif r["is_reverse"] or not r["is_paired"]:
                state[bx][0] = r["aln_end"]
            out.append((bx.split("-")[0], state[bx][1]))
    return out


@pytest.mark.parametrize(("cutoff", "keep", "paired"), [(0, False, True), (100, False, True), (100, True, True), (30, True, True), (100, False, False)])
def test_assign_molecules(spark, cutoff, keep, paired):
    rng = random.Random(cutoff + keep)
    rows = []
    for contig in ("c1", "c2", "c3"):
        pos = 0
        for _ in range(80):
            pos += rng.randrange(60)
            flag = (rng.choice([0, 16]) if not paired else rng.choice([1, 17, 0, 16, 65, 145])) + (4 if rng.random() < 0.05 else 0)
            tags = rng.choice(["BX:Z:A01C01B01D01 VX:i:1", "BX:Z:A02C01B01D01 VX:i:1", "BX:Z:A02C01B01D01-2 VX:i:1", "BX:Z:A00C01B01D01 VX:i:0", "BX:Z:A01C01B01D01", "RX:Z:x", "BX:Z:A03C01B01D01 VX:i:1 MI:i:9 DI:i:3"])
            rows.append((f"q{len(rows)}", flag, contig, pos, rng.choice(["10M", "5S20M", "*"]) if rng.random() < 0.2 else "10M", tags))
    alns = alns_of(spark, rows)
    want = model_mi([r.asDict() for r in alns.orderBy("rec_idx").collect()], cutoff, keep)
    got = {r.rec_idx: r for r in molecules.assign_molecules(alns, "haplotagging", cutoff, keep, paired).collect()}
    assert {i: (r.bx, r.mi) for i, r in got.items()} == {i: w for i, w in enumerate(want) if w}
    for i, r in got.items():
        tags = {t.tag: t.value for t in r.tags}
        was = dict(t.split(":", 2)[::2] for t in rows[i][5].split())
        assert "DI" not in tags and tags["BX"] == r.bx and tags.get("MI") == (str(r.mi) if r.mi else None)
        assert tags.get("DX") == (was["BX"] if r.mi and "-" in was.get("BX", "") else None)
        assert r.tags[-1].tag == "BX"


def test_molecule_example(spark):
    spans = [(0, 1), (200, 1), (250, 17), (300, 1), (420, 1), (425, 17)]
    alns = alns_of(spark, [(f"q{i}", f, "c1", p, "10M", "BX:Z:A01C01B01D01 VX:i:1") for i, (p, f) in enumerate(spans)])
    got = [r.mi for r in molecules.assign_molecules(alns, "haplotagging", 100).orderBy("rec_idx").collect()]
    assert got == [1, 2, 2, 2, 3, 3]


@pytest.mark.parametrize(("flags", "n"), [([129, 65, 129], 2), ([65, 129], 1), ([129, 129], 1), ([128, 128], 2), ([0], None), ([193], 1)])
def test_count_alignments(spark, flags, n):
    alns = alns_of(spark, [(f"q{i}", f, "c", i, "5M", "BX:Z:A01C01B01D01") for i, f in enumerate(flags)])
    got = counting.count_alignments(alns).collect()
    assert [r["count"] for r in got] == ([n] if n else [])


def test_filters_of_alignments(spark):
    rows = [("a", 0, "c", 0, "5M", "BX:Z:A01C01B01D01")] * 3 + [("b", 0, "c", 0, "5M", "BX:Z:A02C01B01D01"), ("c:ACGT", 0, "c", 0, "5M", ""), ("d", 0, "c", 0, "5M", "BX:Z:A00C01B01D01"), ("e", 0, "c", 0, "5M", "")]
    alns = alns_of(spark, rows)
    split = counting.split_invalid_alignments(alns, "haplotagging")
    assert {r.qname for r in split.kept.collect()} == {"a", "b"}
    assert {r.qname for r in split.rejected.collect()} == {"c:ACGT", "d", "e"}
    single = counting.split_singleton_alignments(alns)
    assert {r.qname for r in single.kept.collect()} == {"a"}
    assert {r.qname for r in single.rejected.collect()} == {"b", "c:ACGT"}
    assert {(r.barcode, r.valid) for r in counting.alignment_barcodes(alns).collect()} == {("A01C01B01D01", True), ("A02C01B01D01", True), ("ACGT", True), ("A00C01B01D01", False)}


def test_concat(spark):
    one = alns_of(spark, [("a", 0, "c", 0, "5M", "BX:Z:A05C01B01D01"), ("b", 0, "c", 0, "5M", ""), ("c", 0, "c", 0, "5M", "BX:Z:A05C01B01D01"), ("d", 0, "c", 0, "5M", "BX:Z:A00C01B01D01 MI:i:7")])
    two = one.withColumn("file_idx", F.lit(1))
    got = concatenation.concat_alignments(one.unionByName(two)).orderBy("file_idx", "rec_idx").collect()
    assert [r.mi for r in got] == [1, None, 1, 2, 3, None, 3, 4]
    assert [r.bx for r in got][:4] == ["A01C01B01D01", None, "A01C01B01D01", "A01C01B01D02"]
    by_mi = concatenation.concat_alignments(one.unionByName(two), "tellseq", by_molecule=True).orderBy("file_idx", "rec_idx").collect()
    assert [r.mi for r in by_mi] == [None, None, None, 1, None, None, None, 2]
    assert by_mi[0].bx == "A05C01B01D01" and by_mi[3].bx == "A" * 18
    header = concatenation.merged_header({"HD": [{"VN": "1.6"}], "PG": [{"ID": "x"}], "RG": [{"ID": "s1", "SM": "s1", "PL": "p"}]}, "cmd")
    assert header["RG"] == [{"ID": "concat", "SM": "concat", "PL": "p"}] and len(header["PG"]) == 1


def test_standardize_alignments(spark):
    rows = [("a", 0, "c", 0, "5M", "BX:Z:A01C01B01D01 VX:i:0"), ("b", 0, "c", 0, "5M", "BX:Z:A01C01B01D01"), ("c#1_0_2", 0, "c", 0, "5M", "RG:Z:x"), ("d:ACGTN", 0, "c", 0, "5M", ""), ("e", 0, "c", 0, "5M", "")]
    out = recoding.standardize_alignments(alns_of(spark, rows)).rows.orderBy("rec_idx").collect()
    assert [(r.qname, r.bx, r.vx) for r in out] == [("a", "A01C01B01D01", 0), ("b", "A01C01B01D01", 1), ("c", "1_0_2", 0), ("d", "ACGTN", 0), ("e", None, None)]
    assert [t.tag for t in out[0].tags] == ["BX", "VX"] and [t.tag for t in out[2].tags] == ["RG", "VX", "BX"] and out[4].tags == []
    styled = recoding.standardize_alignments(alns_of(spark, rows[1:]), "stlfr")
    assert [r.bx for r in styled.rows.orderBy("rec_idx").collect()] == ["1_1_1", "0_0_0", "0_0_0", None]
    assert [r.value for r in recoding.map_lines(styled.mapping).collect()] == ["A01C01B01D01\t1_1_1", "1_0_2\t0_0_0", "ACGTN\t0_0_0"]


def test_sort_orders(spark):
    reads = spark.createDataFrame([(0, i, n, c, "A", "F") for i, (n, c) in enumerate([("b", "BX:Z:2"), ("a", "BX:Z:2"), ("c", "BX:Z:1"), ("d", None)])], READ)
    assert [r.name for r in sorting.sort_reads(reads, "BX").collect()] == ["d", "c", "a", "b"]
    with pytest.raises(LinkedReadError):
        sorting.sort_reads(reads, "BXX")
    alns = alns_of(spark, [("x", 16, "c2", 5, "5M", "BX:Z:b"), ("y", 0, "c1", 9, "5M", "BX:Z:b"), ("z", 0, "c1", 2, "5M", ""), ("w", 0, "c1", 3, "5M", "BX:Z:b")])
    assert [r.qname for r in sorting.sort_alignments(alns, "BX").collect()] == ["z", "w", "y", "x"]


def test_exchange_round_trip(spark):
    rows = [(0, 0, "a/1", "RX:Z:q\tBX:Z:b note", "ACGT", "ABCD"), (1, 0, "a/2", None, "GG", "EF")]
    alns = exchange.to_unaligned(spark.createDataFrame(rows, READ))
    assert [(r.qname, r.flag) for r in alns.orderBy("rec_idx").collect()] == [("a", 77), ("a", 141)]
    back = exchange.to_reads(alns).orderBy("file_idx").collect()
    assert [(r.name, r.comment, r.seq, r.qual) for r in back] == [("a/1", "RX:Z:q\tBX:Z:b", "ACGT", "ABCD"), ("a/2", "", "GG", "EF")]
    turned = exchange.to_reads(alns.withColumn("flag", F.lit(16 + 64 + 1))).orderBy("rec_idx").first()
    assert (turned.seq, turned.qual) == ("ACGT", "DCBA")
    single = exchange.to_unaligned(spark.createDataFrame(rows[:1], READ), paired=False).first()
    assert single.flag == 4


# ---- plans


def test_ordinals_by_ranges(spark):
    rng = random.Random(3)
    values = [rng.randrange(300) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(5)
    want = {i: n for n, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    for most in (10_000, 10):
        assert {r.i: r.n for r in with_ordinal(df, ["v", "i"], "n", most).collect()} == want


def test_shared_tables(spark):
    from loomread.plans.storage import shared_path, written

    df = written(spark.range(5), "five")
    assert df.count() == 5 and shared_path(spark, "x") != shared_path(spark, "x")
    assert all(spark.sparkContext.applicationId in f for f in df.inputFiles())


def test_runs(spark):
    rng = random.Random(4)
    places = sorted(rng.sample(range(5000), 400))
    keys = [rng.choice("ab") if rng.random() < 0.3 else "c" for _ in places]
    df = spark.createDataFrame(list(zip(places, keys, strict=True)), "at long, k string").repartition(3)
    want, run, last = {}, 0, None
    for p, k in zip(places, keys, strict=True):
        run = run if k == last else p
        want[p], last = run, k
    for width in (10_000, 100, 7):
        assert {r.at: r.run for r in with_runs(df, "k", "at", width=width).collect()} == want


def test_sort_by_columns(spark):
    """A sort evaluates expressions at each comparison: its keys are columns."""
    reads = spark.createDataFrame([(0, 0, "a/1", "BX:Z:1", "A", "F")], READ)
    plan = sorting.sort_reads(reads, "BX")._jdf.queryExecution().optimizedPlan().toString()
    keys = next(x for x in plan.splitlines() if "Sort [" in x)
    assert "regexp" not in keys and "filter" not in keys


def test_ordinal_keeps(spark):
    df = spark.range(500).select("id", (F.col("id") * 7 % 500).alias("v"))
    for most in (1000, 100):
        got = with_ordinal(df, ["v"], "n", most, keep=["id"], stored=True)
        assert got.columns == ["id", "n"] and all(r.n == r.id * 7 % 500 for r in got.collect())


@pytest.mark.parametrize("least", [2, 3])
def test_singletons_without_moving_reads(spark, least):
    """Barcodes of one record in each file of the same or of different pairs; few kept ones are broadcast."""
    rows = [(f, i, f"r{i}#{code}", f"{f + 1}:N:0:C", "A", "F") for i, two in enumerate(["1_1_1 1_1_1", "2_1_1 3_1_1", "3_1_1 2_1_1", "4_1_1 5_1_1", "6_1_1 6_1_1", "6_1_1 6_1_1", "6_1_1 7_1_1"]) for f, code in enumerate(two.split())]
    parsed = R.parse(spark.createDataFrame(rows, READ), "stlfr")
    want = {r.barcode for r in counting.pair_counts(parsed).collect() if r["count"] >= least}
    split = counting.split_singleton_reads(parsed, least)
    assert {r.barcode for r in split.kept.collect()} == want
    assert {(r.file_idx, r.rec_idx) for r in split.rejected.collect()} == {(f, i) for f, i, n, *_ in rows if n.split("#")[1] not in want}
    assert "BroadcastHashJoin" in split.rejected._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("m", [1, 3])
def test_spoof_counts(spark, m):
    rng = random.Random(m)
    rows = make_reads(200, m, barcodes=2)
    parsed = R.parse(spark.createDataFrame(rows, READ), "stlfr")
    for single, bad in ((False, False), (True, True)):
        pairs = pairing.spoof_pairs(parsed, m, single, bad)
        want = {r.barcode: r["count"] for r in pairs.groupBy("barcode").count().collect()}
        assert {r.barcode: r.pairs for r in pairing.spoof_counts(parsed, m, single, bad).collect()} == want
        narrow = pairing.spoof_pairs(parsed, m, single, bad, first=("id",), second=())
        key = lambda r: (r.rec_idx, r.mate_idx, r.k, r.barcode, r.id_1)
        assert sorted(map(key, narrow.collect())) == sorted(map(key, pairs.collect()))
        ids = pairing.spoof_pairs(parsed, m, single, bad, first=(), second=("id",))
        assert sorted((r.rec_idx, r.k, r.id_2) for r in ids.collect()) == sorted((r.rec_idx, r.k, r.id_2) for r in pairs.collect())


def test_pair_10x_leaves_forward_reads(spark):
    """Forward reads aren't shuffled for their own barcodes: with no reverse ones in a plan's part there is no join."""
    rows = [(0, 0, "a", "1:N:0:X", "AAAACC", "FFFFFF"), (1, 0, "a", "2:N:0:X", "GGGG", "FFFF")]
    out = recoding.pair_10x(R.parse(spark.createDataFrame(rows, READ), "10x", 4), spark.createDataFrame([("AAAA",)], "barcode string"), 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and [(r.file_idx, r.barcode) for r in out.orderBy("file_idx").collect()] == [(0, "AAAA"), (1, "AAAA")]


def test_dictionary_by_hash(spark):
    """No sort of all rows for a barcode's first place; in either order of files and places."""
    rows = [(0, 5, "a", True), (1, 2, "a", True), (1, 3, "b", True), (0, 4, "b", True), (0, 9, "c", False), (1, 9, "d", True)]
    df = spark.createDataFrame(rows, "file_idx int, rec_idx long, barcode string, valid boolean")
    for pos, order in ((("rec_idx", "file_idx"), "abd"), (("file_idx", "rec_idx"), "bad")):
        out = recoding.dictionary(df, "10x", pos)
        assert "".join(r.barcode for r in out.where("valid").orderBy("pos").collect()) == order
        assert [r.new_barcode[-1] for r in out.where("valid").orderBy("pos").collect()] == list("ATC")
    each = df.groupBy("barcode", "valid", "file_idx").agg(F.min("rec_idx").alias("rec_idx"))
    assert "SortAggregate" not in each._jdf.queryExecution().executedPlan().toString()
