"""Pairs of reads within a barcode, as if they came from proximity ligation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.functions import barcodes as B
from loomread.functions import reads as R
from loomread.plans.joins import sized
from loomread.plans.ordinals import stretch, with_ordinal, with_runs
from loomread.plans.storage import written

_PARTS = ("id", "rest", "seq", "qual", "designation", "barcode", "valid", "forward")


def _keys(parsed: DataFrame) -> DataFrame:
    """``__cut, rec_idx, barcode, good`` of each place with a forward and a reverse read: the forward barcode, and whether
    both are valid. Both files are dealt once, by stretches of places, which is how runs want them."""
    rows = parsed.where("file_idx in (0, 1)").select("rec_idx", "file_idx", F.when(F.col("file_idx") == 0, F.col("barcode")).alias("barcode"), F.coalesce("valid", F.lit(False)).alias("valid"))
    dealt = rows.withColumn("__cut", stretch("rec_idx")).repartition("__cut")
    pairs = dealt.groupBy("__cut", "rec_idx").agg(F.max("barcode").alias("barcode"), F.min("valid").alias("good"), F.min("file_idx").alias("f"), F.max("file_idx").alias("l"))
    return pairs.where("f = 0 and l = 1").drop("f", "l")


def _runs(keys: DataFrame) -> DataFrame:
    """``rec_idx, barcode, run`` of valid pairs: those of one barcode that follow each other are a run."""
    return with_runs(keys.where("good").drop("good"), "barcode", "rec_idx")


def spoof_counts(parsed: DataFrame, max_pairs: int = 1, singletons: bool = False, invalid: bool = False) -> DataFrame:
    """``barcode, pairs``: how many pairs :func:`spoof_pairs` makes. The runs' sizes tell it; no partner is looked for."""
    keys = _keys(parsed)
    runs = _runs(keys).groupBy("run", "barcode").agg(F.count("*").alias("n"))
    made = runs.select("barcode", F.when(F.col("n") > 1, F.col("n") * F.least(F.lit(max_pairs), "n")).otherwise(int(singletons)).alias("pairs"))
    if invalid:
        made = made.unionByName(keys.where("not good").groupBy("barcode").agg(F.count("*").alias("pairs")))
    return made.groupBy("barcode").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def spoof_pairs(parsed: DataFrame, max_pairs: int = 1, singletons: bool = False, invalid: bool = False, seed: int = 0, first: tuple[str, ...] = _PARTS, second: tuple[str, ...] = _PARTS) -> DataFrame:
    """``rec_idx, mate_idx, k, barcode`` and both reads' columns of each pair to write.

    Valid pairs in file order fall into runs of one forward barcode. In a run of n > 1 pairs each forward read meets
    min(``max_pairs``, n) reverse reads: those that follow in the order of a digest, round the run's end, beginning with
    the next one (so with one partner never its own mate) or, with several, at a place that its digest gives. Runs of one
    pair are kept with ``singletons``, pairs with an invalid read with ``invalid``; neither is changed.

    Partners are found by their place, so that the join makes as many rows as there are pairs to write. ``first`` and
    ``second``: the columns that are wanted of either read; the reads are met only for these.
    """
    keys = _keys(parsed)
    runs = _runs(keys)
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col("rec_idx").cast("string")))
    placed = with_ordinal(runs.withColumn("mark", F.unhex(mark)), ["run", "mark", "rec_idx"], "at", keep=["rec_idx", "barcode", "run"], stored=True)
    sizes = written(placed.groupBy("run").agg(F.count("*").alias("n"), F.min("at").alias("begin")), "pair-sizes")
    sized_runs = placed.join(sized(sizes), "run")
    several = sized_runs.where("n > 1").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(max_pairs), "n") - 1)))
    start = F.when(F.lit(max_pairs) == 1, 1).otherwise(F.pmod(F.conv(F.substring(mark, 1, 12), 16, 10).cast("long"), F.col("n")))
    # the mate's place in the whole order: a key that no two reads share, whatever the runs' sizes
    links = several.select("rec_idx", "k", (F.col("begin") + F.pmod(F.col("at") - F.col("begin") + start + F.col("k"), F.col("n"))).alias("at"))
    links = links.join(placed.select("at", F.col("rec_idx").alias("mate_idx"), "barcode"), "at").select("rec_idx", "mate_idx", "k", "barcode", F.lit(True).alias("new"))
    alike = lambda rows: rows.select("rec_idx", F.col("rec_idx").alias("mate_idx"), F.lit(0).cast("long").alias("k"), "barcode", F.lit(False).alias("new"))
    if singletons:
        links = links.unionByName(alike(sized_runs.where("n = 1")))
    if invalid:
        links = links.unionByName(alike(keys.where("not good")))
    ids = tuple(dict.fromkeys((*first, *(("id",) if "id" in second else ()))))  # a new pair's reads have one id, made of the first's
    out = links
    if ids:
        out = out.join(parsed.where("file_idx = 0").select("rec_idx", *[F.col(c).alias(f"{c}_1") for c in ids]), "rec_idx")
    if second:
        out = out.join(parsed.where("file_idx = 1").select(F.col("rec_idx").alias("mate_idx"), *[F.col(c).alias(f"{c}_2") for c in second]), "mate_idx")
    if "id" in ids:
        renamed = R.random_id(F.col("id_1"), F.concat_ws(":", "rec_idx", "k"), seed)
        out = out.withColumn("id_1", F.when(F.col("new"), renamed).otherwise(F.col("id_1")))
    if "id" in second:
        out = out.withColumn("id_2", F.when(F.col("new"), F.col("id_1")).otherwise(F.col("id_2")))
    return out.select("rec_idx", "mate_idx", "k", "barcode", *[f"{c}_1" for c in first], *[f"{c}_2" for c in second])


def pair_reads(pairs: DataFrame) -> DataFrame:
    """The reads of written pairs in tellseq form: ``file_idx, rec_idx`` and rendered columns."""
    sides = []
    for n in (1, 2):
        code = F.col("barcode") if n == 1 else F.when(F.col("valid_1") & F.col("valid_2"), F.col("barcode")).otherwise(F.col("barcode_2"))
        side = pairs.select(F.lit(n - 1).alias("file_idx"), "rec_idx", "k", code.alias("code"), *[F.col(f"{c}_{n}").alias(c) for c in _PARTS])
        sides.append(R.render(side, B.TELLSEQ, F.col("code")).drop("code"))
    return sides[0].unionByName(sides[1])
