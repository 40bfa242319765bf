"""Places in a total order, running codes and runs, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomread.plans.joins import sized
from loomread.plans.storage import written

#: Up to so many rows are numbered by one window; more are numbered range by range.
ONE_WINDOW = 200_000
_LOCAL = (1 << 33) - 1  # the low bits of monotonically_increasing_id count within a partition


def with_ordinal(df: DataFrame, order: list[Column | str], name: str = "ordinal", one_window: int = ONE_WINDOW, keep: list[str] | None = None, stored: bool = False) -> DataFrame:
    """``df`` with each row's place (from 0) in the total ``order``.

    The rows are written first, so that they are made once; keep them narrow. Few rows: a window. Many: ranges of the
    order are sorted each on its own and written with their running ids; the sizes of the ranges, one row each, give
    where each begins.

    ``order``: of columns; an expression would be evaluated at each comparison of a sort. ``keep``: the columns of the
    result (all by default); what only the order needs isn't written. ``stored``: the rows are a projection of a table,
    as cheap to make again as to read, and aren't written first.
    """
    kept = df.columns if keep is None else keep
    df = df if stored else written(df, "ordinal-rows")
    if df.count() <= one_window:
        placed = df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")).select(*kept, name)
        return written(placed, "ordinals") if stored else placed
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*kept).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged, "ordinals").withColumn("__part", F.shiftright("__at", 33))
    sizes = ranged.groupBy("__part").count()  # as many rows as partitions
    begins = sizes.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__begin"))
    begins = written(begins, "ordinal-begins")
    return ranged.join(F.broadcast(begins), "__part").withColumn(name, F.col("__begin") + F.col("__at").bitwiseAND(F.lit(_LOCAL))).drop("__part", "__at", "__begin")


#: So many orders are a stretch.
WIDTH = 1_000_000


def stretch(order: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(order) / F.lit(width))


def with_runs(df: DataFrame, key: str, order: str, name: str = "run", width: int = WIDTH) -> DataFrame:
    """``df`` with the run of equal ``key`` each row stands in: the ``order`` (a whole number) of the run's first row.

    Rows are dealt into stretches of ``width`` orders. Within one, a window tells where the key changes; what a stretch
    needs of those before it, its predecessor's last key and last change, is a table with a row for each stretch. The result is a
    projection of a stored table. Rows that
    have their :func:`stretch` as ``__cut`` and are dealt by it aren't dealt again.
    """
    cut = df if "__cut" in df.columns else df.withColumn("__cut", stretch(order, width))
    inside = Window.partitionBy("__cut").orderBy(order)
    cut = cut.withColumn("__before", F.lag(key).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    cut = cut.withColumn("__change", F.when(~F.col("__first") & ~F.col("__before").eqNullSafe(F.col(key)), F.col(order)))
    own = F.max("__change").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = written(cut.withColumn("__own", own).drop("__before", "__first"), "runs")  # dealt and sorted once
    ends = cut.groupBy("__cut").agg(F.min(F.struct(order, key)).alias("f"), F.max(F.struct(order, key)).alias("l"), F.max("__change").alias("c"))
    by = Window.orderBy("__cut")
    ends = ends.withColumn("__new", F.coalesce(~F.lag(F.col(f"l.{key}")).over(by).eqNullSafe(F.col(f"f.{key}")), F.lit(True)) | (F.row_number().over(by) == 1))
    # the last change up to a stretch's end; its own beginning is one if the key differs from the last before
    ends = ends.withColumn("__last", F.coalesce("c", F.when(F.col("__new"), F.col(f"f.{order}"))))
    earlier = F.last("__last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("__cut", F.when(F.col("__new"), F.col(f"f.{order}")).otherwise(earlier).alias("__open"))
    ends = sized(written(ends, "run-ends"))
    return cut.join(ends, "__cut").withColumn(name, F.coalesce("__own", "__open")).drop("__cut", "__change", "__own", "__open")
