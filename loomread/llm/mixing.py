"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A row's key is ``-ln(u) / w`` with a seeded uniform ``u`` of its id and text and its quality weight ``w``; a source's rows are
taken in the order of their keys until their running sum of words reaches the source's target. Targets above the
source's size take complete epochs first; the rest of the target is the fractional selection, and the row at which it
ends counts in part, so that a source's words meet the target.

The running sum isn't a window over a whole source: keys are dealt into about sqrt(rows) bins, sums by (source, bin)
say in which one bin of each source the budget ends, and only that bin's rows are sorted. A source of any share is so
spread over all tasks.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source, the last one; rows of
one id, or without one, are told apart by their texts; rows that repeat an id and text have the same key, follow each
other, and are alike in all that a result has of them; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomread.llm.common import size_checked_broadcast, text_of, written

SHARE = 1.5
MOST_EPOCHS = 2
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SEED = "mix-7"
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
#: Up to so many sources their targets are broadcast; beyond, joined by sort and merge.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    """The number of runs of characters other than space and 9-13."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit("x"), F.lit("")))).cast("long")


def quality_weight(size: Column, chars: Column) -> Column:
    """1 for texts whose words have 3 to 12 characters on average, as prose has; else a half."""
    return F.when((chars >= 3 * size) & (chars <= 12 * size) & (size > 0), 1.0).otherwise(0.5)


def uniform(doc_id: Column, digest: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the id and the text's digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest)), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def source_targets(sized: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` by source.

    Sharing out again what stands above the limits ends where each source has min(limit, weight x level) for one level:
    in order of limit / weight, the level is the first that doesn't exceed its source's ratio.
    """
    every = Window.orderBy(F.lit(1)).rowsBetween(*_ALL)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    out = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    out = out.withColumn("cap", F.col("source_size") * float(MOST_EPOCHS)).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    out = out.withColumn("cap_before", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("weight_from", F.sum("weight").over(ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    out = out.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    # past the first that doesn't exceed its ratio, levels only fall
    out = out.withColumn("found", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    return out.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce("found", "ratio")).alias("target"))


def _sized(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """``doc_id, source, size, digest, key`` of each row, and ``more``."""
    size, chars = words(text_of()), F.length(text_of())
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), chars.alias("chars"), F.md5(text_of()).alias("digest"), *more)
    return rows.withColumn("key", -F.log(uniform(F.col("doc_id"), F.col("digest"), seed)) / quality_weight(F.col("size"), F.col("chars"))).drop("chars")


def _taken(rows: DataFrame, ends: DataFrame, bins: int) -> DataFrame:
    """``rows`` (``doc_id, source, size, digest, key`` and more) with ``source_size, target, taken``.

    Only rows of the bins in which the budgets end are shuffled.
    """
    found = rows.withColumn("bin", _bin(bins)).join(size_checked_broadcast(ends, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")))
    end_bin = F.coalesce("end_bin", F.lit(-1))  # none where the budget is 0: nothing is taken beyond the epochs
    epochs = F.col("epochs") * F.col("size")
    whole = found.where(F.col("bin") != end_bin).withColumn("taken", epochs + F.when(F.col("bin") < end_bin, F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("end_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - first))
    ended = found.where(F.col("bin") == end_bin).withColumn("taken", epochs + part)
    return whole.unionByName(ended).withColumn("taken", F.col("taken").cast("long"))


def _bin(bins: int) -> Column:
    # never null: else a test of that, the key's whole expression with it, would be pushed below the projection
    return F.coalesce(F.floor(F.col("key") / (F.col("key") + 1) * bins), F.lit(0).cast("long"))


def _plan(sized: DataFrame, share: float, weights: tuple[int, ...]) -> tuple[DataFrame, int]:
    """By source: target, epochs, budget of the fractional selection, the bin in which it ends and the words before it."""
    bins = min(1 << 20, max(16, int(sized.count() ** 0.5)))
    targets = written(source_targets(sized, share, weights).coalesce(1), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(0)
    budget = F.when(F.col("epochs") >= MOST_EPOCHS, 0).otherwise(F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    targets = targets.withColumn("epochs", epochs).withColumn("budget", budget).withColumnRenamed("source", "of")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sized.withColumn("bin", _bin(bins)).groupBy("source", "bin").agg(F.sum("size").alias("words")).withColumn("before", before)
    at = sums.join(size_checked_broadcast(targets, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")))
    at = at.where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") >= F.col("budget")))
    at = at.select(F.col("of").alias("of2"), F.col("bin").alias("end_bin"), F.col("before").alias("end_before"))
    return written(targets.join(at, F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2").coalesce(1), "mix-ends"), bins


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row of ``docs``."""
    sized = written(_sized(docs, seed), "mix-sizes")
    return _taken(sized, *_plan(sized, share, weights)).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: a row for each time that a row of ``docs`` is taken. Texts stay whole: the row at which a source's
    budget ends is taken once more if half of its words or more belong to the mix."""
    plan = _plan(written(_sized(docs, seed), "mix-sizes"), share, weights)
    rows = _taken(_sized(docs, seed, F.struct(*docs.columns).alias("__row")), *plan)
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    out = rows.where("taken > 0").select("__row", F.explode(F.array_repeat(F.lit(0), times)).alias("__time"))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
