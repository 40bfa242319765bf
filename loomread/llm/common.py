"""Helpers shared by the corpus operators: tables, shared storage, row identity, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomread.plans.joins import BROADCAST_ROWS, sized
from loomread.plans.storage import shared_path, written

#: Most bits of a broadcast filter on row keys (16 MB).
FILTER_BITS = 1 << 27
#: Rows handed to a Python worker in one Arrow batch. Texts may be long, so a batch stays small.
ARROW_ROWS = 512
#: Bytes in one, about.
ARROW_BYTES = 4 << 20
#: Most keys that are joined by broadcast because many rows have them.
HOT_SHARE = 10_000
_LOCK = threading.Lock()


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on the executors and keep Arrow batches small. Idempotent."""
    sc = spark.sparkContext
    with _LOCK:
        if getattr(sc, "_loomread_shipped", None) is None:
            root = Path(__file__).resolve().parents[1]
            target = os.path.join(tempfile.mkdtemp(prefix="loomread-"), "loomread_src.zip")
            with zipfile.ZipFile(target, "w") as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, str(p.relative_to(root.parent)))
            sc.addPyFile(target)
            sc._loomread_shipped = target
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def delete_shared(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table made by :func:`written` that no later plan reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/loomread-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _read_once(df: DataFrame) -> bool:
    """Whether ``df`` takes rows, as they are or fewer, from one scan that reads each file once."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    kind = lambda x: x.getClass().getSimpleName()
    if plan.nodeName() != "LogicalRelation" or kind(plan.relation()) != "HadoopFsRelation" or kind(plan.relation().location()) != "InMemoryFileIndex":
        return False
    files = plan.relation().location().allFiles()
    return files.distinct().size() == files.size()


def with_row_key(df: DataFrame) -> DataFrame:
    """Add ``__lr_f, __lr_i``: an identity of each row that survives recomputation, also when ``doc_id`` repeats or is null.

    It is the row's file and place there. A frame that isn't a plain read of files, or that reads one of them more than
    once, is written to the shared folder first. Columns of these names are replaced.
    """
    df = df.drop("__lr_f", "__lr_i")
    if not _read_once(df):
        df = written(df, "rows")
    return df.select("*", F.xxhash64("_metadata.file_path").alias("__lr_f"), F.col("_metadata.row_index").alias("__lr_i"))


def size_checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows (counted, at most that many + 1), else ``df`` as it is."""
    return sized(df, max_rows)


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) to ``keyed``, which has one row for each of ``keys``, without a hot task.

    ``weight`` is the column that says how many of the ``total`` rows have the key. Keys with at least 1 / ``HOT_SHARE``
    of all rows, of which there can be ``HOT_SHARE``, are broadcast; the others are joined as they come.
    """
    least = max(2, -(-total // HOT_SHARE))
    hot = F.broadcast(keyed.where(F.col(weight) >= least).orderBy(F.desc(weight), *keys).limit(HOT_SHARE))
    names = F.broadcast(hot.select(*keys))
    cold = keyed.join(names, keys, "left_anti")
    return rows.join(hot, keys).unionByName(rows.join(names, keys, "left_anti").join(cold, keys, how))


def _row_filter(marked: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """A bit array with a bit for each row key of ``marked``: 16 bits for each of ``rows``, ``FILTER_BITS`` at most."""
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(16, (16 * rows).bit_length()))
    place = f"pmod(xxhash64(__lr_f, __lr_i), {bits})"
    words = marked.select(F.expr(f"{place} div 64").alias("w"), F.expr(f"shiftleft(1L, cast({place} % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["w"]] = r["b"]
    return out.view(np.uint8), bits


def _passed(keyed: DataFrame, marked: DataFrame, rows: int, marked_ones: bool, then: tuple[Callable, str] | None = None) -> DataFrame:
    held, bits = _row_filter(marked, rows)
    shared, names = keyed.sparkSession.sparkContext.broadcast(held), keyed.columns
    after, schema = then or (iter, keyed.schema)

    def passed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in it:
            place = b.column("__lr_p").to_numpy(zero_copy_only=False)
            hit = (own[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            yield b.filter(pa.array(hit == marked_ones)).select(names)

    return keyed.withColumn("__lr_p", F.expr(f"pmod(xxhash64(__lr_f, __lr_i), {bits})")).mapInArrow(lambda it: after(passed(it)), schema)


def only_rows(keyed: DataFrame, marked: DataFrame, rows: int, then: tuple[Callable, str] | None = None) -> DataFrame:
    """The rows of ``keyed`` whose row key is in ``marked``, and few others: a filter of bounded size, no shuffle.

    ``rows``: how many rows there are, for the filter's size. ``then``: a function of Arrow batches and the schema that
    it gives, applied to these rows by the same worker.
    """
    return _passed(keyed, marked, rows, True, then)


def without_rows(keyed: DataFrame, marked: DataFrame, rows: int) -> DataFrame:
    """The rows of ``keyed`` whose row key isn't in ``marked``. Only rows that a filter of bounded size can't tell are
    shuffled; the others stay where they are."""
    unsure = only_rows(keyed, marked, rows).join(marked.select("__lr_f", "__lr_i"), ["__lr_f", "__lr_i"], "left_anti")
    return _passed(keyed, marked, rows, False).unionByName(unsure.select(keyed.columns))


def text_of(name: str = "text") -> Column:
    """The text column, null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


__all__ = ["delete_shared", "only_rows", "prepare", "shared_path", "size_checked_broadcast", "spread_join", "table", "text_of", "with_row_key", "without_rows", "written"]
