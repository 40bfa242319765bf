"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.llm.common import delete_shared, written

#: Edges that one task thins to a spanning forest before the rounds; up to so many in all need no rounds.
THINNED = 100_000
_BATCH = 65_536


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while (up := parent.setdefault(root, root)) != root:
        root = up
    while parent[x] != root:
        parent[x], x = root, parent[x]
    return root


def _forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task without those that close a circle, about ``THINNED`` at a time."""
    parent: dict[int, int] = {}
    seen = 0
    for batch in it:
        keep = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            p, q = _find(parent, a), _find(parent, b)
            keep.append(p != q)
            parent[max(p, q)] = min(p, q)
        yield batch.filter(pa.array(keep, pa.bool_()))
        seen += len(keep)
        if seen >= 2 * THINNED:
            parent, seen = {}, 0


def _rooted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and roots of all edges, which are few."""
    parent: dict[int, int] = {}
    for batch in it:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            p, q = _find(parent, a), _find(parent, b)
            parent[max(p, q)] = min(p, q)
    found = [(x, root) for x in list(parent) if (root := _find(parent, x)) != x]
    for k in range(0, len(found), _BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[k : k + _BATCH], strict=True)], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (two long columns ``a, b``) that isn't its component's least node.

    Up to ``THINNED`` edges are joined by one task. Of more, those that close a circle within a task are left out, then
    each round is two joins with minima that are combined on the map side; a hub's rows are joined with one row and so can
    be split. A round's edges go to the shared folder; the number of rounds grows with the logarithm of the nodes. Loops
    and repeated edges don't matter; without edges the result is empty.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = written(now, "edges")
    parts = -(-now.count() // THINNED)
    if parts <= 1:
        return written(now.coalesce(1).mapInArrow(_rooted, "node long, root long"), "roots")
    # a crowd has many more edges than its spanning forest
    now = written(now.coalesce(parts).mapInArrow(_forest, "a long, b long"), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = written(small.where("a <> b").distinct(), "edges")
        delete_shared(now.sparkSession, now)
        now = after
        # sums of hashes tell a set of edges; equal before and after a round: all are stars
        new_state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.sum(F.hash("a", "b").cast("long"))).first()
        if new_state == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new_state
