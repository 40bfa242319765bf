"""Barcodes and molecules of a stream of alignments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomread.plans.storage import shared_path

STATE = "last long, start_rec long"


def stream_molecules(alns: DataFrame, cutoff: int = 0, watermark: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """``rname, bx, rec_idx, start_rec`` of a stream of valid, mapped alignments, each contig's in order.

    The state of a contig's barcode is the end of its current molecule and the record that it began with; as in a file,
    a forward mate that doesn't begin a molecule leaves the end where it is. With ``idle_ms``, states that get
    nothing for so long are dropped, as a file's are at the end of a contig; such a stream runs until it is stopped. Late rows count as overlapping. A molecule is named by ``start_rec``;
    numbers from 1 need all molecules before it and so aren't given on a stream.

    A trigger holds a barcode's new rows in memory: bound it at the source (``maxFilesPerTrigger``).

    ``watermark``: a column of event time, for streams that have one; rows later than a minute are dropped then.
    """
    moves = F.col("is_reverse") | ~F.col("is_paired")
    rows = alns if watermark is None else alns.withWatermark(watermark, "1 minute")
    rows = rows.select("rname", "bx", "rec_idx", "aln_start", "aln_end", moves.alias("moves"))

    def step(key: tuple[str, str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, start = state.get if state.exists else (None, None)
        part = pd.concat(list(parts)).sort_values("rec_idx")  # a key's rows of one trigger come in any order
        starts = []
        for rec, begin, end, moving in zip(part["rec_idx"], part["aln_start"], part["aln_end"], part["moves"], strict=True):
            new = last is None or (cutoff > 0 and begin - last > cutoff)
            if new:
                start = int(rec)
            if new or moving:
                last = int(end)
            starts.append(start)
        yield pd.DataFrame({"rname": key[0], "bx": key[1], "rec_idx": part["rec_idx"].to_numpy(), "start_rec": starts})
        state.update((last, start))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    return rows.groupBy("rname", "bx").applyInPandasWithState(step, "rname string, bx string, rec_idx long, start_rec long", STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def stream_counts(parsed: DataFrame) -> DataFrame:
    """``barcode, count`` of a stream of parsed reads: forward-file reads, or 1 for what only the reverse file has."""
    return parsed.where("valid").groupBy("barcode").agg(F.greatest(F.count_if(F.col("file_idx") == 0), F.lit(1)).cast("long").alias("count"))


def stream_window_counts(parsed: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """``window, barcode, count`` in tumbling windows of event time, with rows up to ``late`` behind."""
    rows = parsed.where("valid").withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("window"), "barcode").agg(F.count("*").alias("count"))


def drained(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """All that a stream has now, through files in the shared folder: its result as a table."""
    out = shared_path(spark, "stream")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode(mode).trigger(availableNow=True).start()
    else:
        save = lambda df, _: df.write.mode("overwrite").parquet(out)
        query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{out}-state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
