"""Text lines in order, as Spark part files or as one file."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame


def write_lines(df: DataFrame, path: str, order: list[Column | str] | None = None, compression: str = "none") -> None:
    """The single string column of ``df`` as part files under ``path`` whose names follow the order.

    A range exchange and sorts on each part; each part is written where it is sorted.
    """
    (df.orderBy(*order).select("value") if order else df.select("value")).write.mode("overwrite").option("compression", compression).text(path)


def save_lines(lines: Iterable[str], path: str) -> None:
    """Lines one after the other into one file (gzip by its name): for a command's output, streamed by parts."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with (gzip.open(path, "wt", compresslevel=5) if path.endswith(".gz") else open(path, "w")) as f:
        for x in lines:
            f.write(x)
            f.write("\n")
