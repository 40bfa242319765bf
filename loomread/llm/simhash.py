"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits; the counts of set bits in them are a point in a grid, and
the Manhattan distance of two points is at most the number of differing bits. The counts are held in unary: a segment's
bits sorted, so that the distance is the number of differing bits of two such words. The grid's axes are dealt into G
groups; points within distance D agree in at least G - D groups entirely, so points are joined on their coordinates in
each choice of G - D groups (a range join whose range is a cell). In a cell the Manhattan distance is tested, then the
fingerprints themselves. Only distinct fingerprints are joined, and a large cell gives a forest of links, not all pairs.

Cells with over ``SPLIT`` points are cut into blocks, and each pair of blocks is a cell of its own.

:func:`drop_similar` takes the same join for texts that are similar by their sets of shingles of five words: Jaccard 0.8
or more. A fingerprint of 64 bits tells that only roughly, so there are ``PRINTS`` of them over the same shingles, a pair
is looked at if one of them differs in ``SIMILAR_APART`` bits or fewer, and each link is verified on the whole sets.

Defined results: null and empty texts have fingerprint 0, which links like any other; repeated rows and ids share a
component; an empty table gives an empty result; null ids never are a ``component_id`` unless all of it are null; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.llm.common import only_rows, size_checked_broadcast, spread_join, with_row_key, without_rows, written
from loomread.llm.components import components

BITS_APART = 4
WORDS = 4
SEED = 42
#: Cells with more points are cut into blocks of about half as many.
SPLIT = 50_000
#: Groups of axes by the number of distinct fingerprints: more points need finer cells.
GROUPS = ((4_000_000, 2), (1_000_000_000, 4), (1 << 62, 6))  # up to so many: bits apart + ...
_EVEN = 0x5555555555555555
_CHUNK = 65_536
#: Words of a shingle, fingerprints and bits apart of similar texts; the least similarity in tenths.
SIMILAR_WORDS, PRINTS, SIMILAR_APART, TENTHS = 5, 4, 7, 8
#: Cells of up to so many points give all their pairs, unless there are over ``CROWD`` links a point.
ALL_PAIRS, CROWD = 2048, 1
#: Rows of one text's set in a join; more are dealt out to copies of it.
SALT = 5_000
#: Sets of a block of a crowd, about; a task holds two.
BLOCK_BYTES = 4 << 20


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats included."""
    parts = (text or "").encode().lower().split()  # A-Z only; at space and bytes 9-13
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words, len(parts))
    starts, ends = starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, __lr_f, __lr_i, fp`` of rows that have a row key; ``fp`` as a signed long."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__lr_f"), b.column("__lr_i"), pa.array(fps, pa.int64())], ["doc_id", "__lr_f", "__lr_i", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__lr_f", "__lr_i", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, __lr_f long, __lr_i long, fp long")


def unary(fp: Column) -> Column:
    """Counts of set bits in segments of two bits, in unary: low bit either, high bit both."""
    next_bit = F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(next_bit), fp.bitwiseAND(next_bit)
    return either.bitwiseAND(F.lit(_EVEN)).bitwiseOR(F.shiftleft(both.bitwiseAND(F.lit(_EVEN)), 1))


def _unary(x: np.ndarray) -> np.ndarray:
    even, one = np.uint64(_EVEN), np.uint64(1)
    return ((x | x >> one) & even) | ((x & x >> one) & even) << one


def masks(apart: int, more: int) -> list[int]:
    """Bit masks of each choice of ``more`` groups out of ``apart + more`` groups of segments, as signed longs."""
    groups = [sum(3 << (2 * s) for s in range(32) if s * (apart + more) // 32 == g) for g in range(apart + more)]
    out = [sum(c) for c in combinations(groups, more)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _near(x: np.ndarray, y: np.ndarray, apart: int) -> np.ndarray:
    """Places where x and y link: the Manhattan distance of the counts first, the bits where that passes."""
    at = np.flatnonzero(np.bitwise_count(_unary(x) ^ _unary(y)) <= apart)
    return at[np.bitwise_count((x ^ y)[at]) <= apart]


def _forest(ids: np.ndarray, points: np.ndarray, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among ``points``: a search in breadth that takes each point once.

    It begins at the point nearest to the majority of all, from which a crowd of copies is reached at once.
    """
    shifts = np.arange(64, dtype=np.uint64)
    most = np.array([int(2 * ((points >> k) & np.uint64(1)).sum() > len(points)) for k in shifts], np.uint64)
    by = np.lexsort((points, np.bitwise_count(points ^ np.uint64((most << shifts).sum()))))
    rest, own = points[by], ids[by]
    while len(rest) > 1:
        queue, rest, own = [(rest[:1], own[:1])], rest[1:], own[1:]
        while queue and len(rest):
            for p, i in zip(*queue.pop(), strict=True):
                at = _near(rest, p, apart)
                if len(at):
                    yield own[at], np.full(len(at), i)
                    queue.append((rest[at], own[at]))
                    rest, own = np.delete(rest, at), np.delete(own, at)
                if not len(rest):
                    break


def _links(cells: np.ndarray, ids: np.ndarray, points: np.ndarray, apart: int, small: int, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links in the cells of sorted rows, and whether each comes from a forest.

    All pairs of a cell of at most ``small`` points, over all such cells at once; cells with more than ``crowd`` links a
    point, and all larger cells, give forests instead.
    """
    starts = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]).any(axis=1))))
    sizes = np.diff(np.concatenate((starts, [len(points)])))
    whole = sizes <= small
    cell = np.repeat(np.arange(len(sizes)), sizes)
    few = whole[cell]
    left = np.repeat(starts + sizes, sizes) - np.arange(len(points))  # rows of the cell from here on
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(sizes[whole].max(initial=0))):
        at = np.flatnonzero(few & (left > d))
        hit = at[_near(points[at], points[at + d], apart)]
        one.append(hit)
        two.append(hit + d)
    x, y = np.concatenate(one), np.concatenate(two)
    whole &= np.bincount(cell[x], minlength=len(sizes)) <= crowd * sizes
    keep = whole[cell[x]]
    a, b, forest = [ids[x[keep]]], [ids[y[keep]]], [np.zeros(int(keep.sum()), bool)]
    for s, n in zip(starts[~whole].tolist(), sizes[~whole].tolist(), strict=True):
        for p, q in _forest(ids[s : s + n], points[s : s + n], apart):
            a.append(p)
            b.append(q)
            forest.append(np.ones(len(p), bool))
    return np.concatenate(a), np.concatenate(b), np.concatenate(forest)


def _met(points: DataFrame, n: int, apart: int, split: int, small: int, crowd: int) -> DataFrame:
    """``a, b, forest``: links by ``id`` between points (``t, id, fp``) of equal ``t`` whose ``fp`` differ in at most
    ``apart`` bits. ``n``: how many points a ``t`` has."""
    spark = points.sparkSession
    more = next(m for most, m in GROUPS if n <= most)
    chosen = masks(apart, more)
    keys = F.posexplode(F.array(*[F.col("u").bitwiseAND(F.lit(m)) for m in chosen]))
    own = ["id", "fp"]
    points = points.withColumn("u", unary(F.col("fp"))).select("t", *own, keys.alias("choice", "cell"))
    points = points.select((F.col("t") * len(chosen) + F.col("choice")).alias("choice"), "cell", *own)
    hot = written(points.groupBy("choice", "cell").agg(F.count("*").alias("n")).where(F.col("n") > split), "hot-cells")
    zero = F.lit(0).cast("int")
    if hot.isEmpty():
        rows = points.select("choice", "cell", zero.alias("i"), zero.alias("j"), *own)
    else:
        hot = size_checked_broadcast(hot.select("choice", "cell", F.ceil(F.col("n") / (split / 2)).cast("int").alias("k")), 100_000)
        joined = points.join(hot, ["choice", "cell"], "left")
        block = F.pmod(F.xxhash64("id"), F.coalesce("k", F.lit(1))).cast("int")
        other = F.explode(F.sequence(zero, F.coalesce("k", F.lit(1)) - 1))
        joined = joined.withColumn("block", block).withColumn("other", other)
        rows = joined.select("choice", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *own)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(parts, "choice", "cell", "i", "j").sortWithinPartitions("choice", "cell", "i", "j")
    long = lambda batch, k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, b, forest = _links(rows[:, :4], rows[:, 4], rows[:, 5].copy().view(np.uint64), apart, small, crowd)
            found = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b), forest), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.array(found[:, 2] == 1)], ["a", "b", "forest"])

        waiting: list[np.ndarray] = []
        held = 0
        for batch in it:
            waiting.append(np.stack([long(batch, k) for k in ("choice", "cell", "i", "j", *own)], axis=1))
            held += len(waiting[-1])
            if held < _CHUNK:
                continue
            rows = np.concatenate(waiting)
            cut = len(rows) - int((rows[::-1, :4] == rows[-1, :4]).all(axis=1).argmin() or len(rows))  # the last cell may go on
            if cut:
                yield out(rows[:cut])
            waiting, held = [rows[cut:]], len(rows) - cut if cut else 0
        if waiting and sum(map(len, waiting)):
            yield out(np.concatenate(waiting))

    return rows.mapInArrow(run, "a long, b long, forest boolean")


def links(fps: DataFrame, apart: int = BITS_APART, split: int = SPLIT) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect all that differ in ``apart`` bits or fewer."""
    points = fps.select(F.lit(0).alias("t"), F.col("fp").alias("id"), "fp")
    return _met(points, fps.count(), apart, split, 16, 16).select("a", "b")


def cluster_keyed(docs: DataFrame, apart: int = BITS_APART, words: int = WORDS) -> DataFrame:
    """``doc_id, __lr_f, __lr_i, fp, root, component_id`` of each row; rows have a row key."""
    rows = written(fingerprints(docs, words), "fingerprints")
    known = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_fp")), "known-fingerprints")
    roots = components(links(known.select("fp"), apart))
    found = written(known.join(roots, known.fp == roots.node, "left").select("fp", "least", "n_fp", F.coalesce("root", "fp").alias("root")), "roots")
    least = found.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_root"))
    placed = written(spread_join(found, written(least, "components"), ["root"], "n_root", found.count()), "placed")
    return spread_join(rows, placed, ["fp"], "n_fp", rows.count()).select("doc_id", "__lr_f", "__lr_i", "fp", "root", "component_id")


def cluster(docs: DataFrame, apart: int = BITS_APART, words: int = WORDS) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs``: rows whose fingerprints link share the least id reachable."""
    return cluster_keyed(with_row_key(docs), apart, words).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, apart: int = BITS_APART, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component: the one with its least id; of rows that repeat that id, one."""
    keyed = with_row_key(docs)
    rows = written(cluster_keyed(keyed, apart, words), "components")
    return without_rows(keyed, not_least(rows), rows.count()).select(*docs.columns)


def not_least(rows: DataFrame) -> DataFrame:
    """The rows (``doc_id``, row key, ``root``) that aren't the one of their component with its least id."""
    stays = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__lr_f", "__lr_i")).alias("k"), F.count("*").alias("n_rows"))
    placed = spread_join(rows, written(stays, "stays"), ["root"], "n_rows", rows.count())
    return placed.where(~((F.col("k.__lr_f") == F.col("__lr_f")) & (F.col("k.__lr_i") == F.col("__lr_i"))))


# ---- similar texts, verified on their sets of shingles


def shingles(text: str | None, words: int = SIMILAR_WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; a text of fewer words is one shingle."""
    parts = (text or "").encode().lower().split()
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts or [b""]]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words, len(ends))
    digest = xxhash.xxh64_intdigest
    got = [digest(joined[s:e], SEED) for s, e in zip(starts[: len(ends) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    return np.unique(np.array(got, np.uint64))


def prints(hashes: np.ndarray, n: int = PRINTS) -> np.ndarray:
    """``n`` fingerprints of a set of hashes, as signed longs: a bit is 1 if set in over half of them."""
    out = np.zeros((n, 64), np.int64)
    for i in range(0, len(hashes), _CHUNK):
        h = hashes[i : i + _CHUNK]
        for t in range(n):
            out[t] += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return np.packbits(2 * out > len(hashes), axis=1).view(">i8").ravel().astype(np.int64)


def _signatures(keyed: DataFrame) -> DataFrame:
    """``doc_id, __lr_f, __lr_i, prints, id`` of each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [prints(shingles(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "__lr_f", "__lr_i")), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "__lr_f", "__lr_i", "prints"])

    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "__lr_f", "__lr_i", F.col("text").cast("string").alias("text"))
    signed = rows.mapInArrow(run, "doc_id long, __lr_f long, __lr_i long, prints array<long>")
    return written(signed.withColumn("id", F.monotonically_increasing_id()), "signatures")


def _with_sets(pairs: DataFrame, sets: DataFrame, counted: DataFrame, side: str, other: str) -> DataFrame:
    """``pairs`` with the set of ``side`` as ``{side}_set``. A text of many pairs (``counted``: the pairs as a table) has
    several copies of its set."""
    parts = F.ceil(F.col("n") / SALT).cast("int").alias("parts")
    hot = counted.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > SALT).select(side, parts)
    many = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(size_checked_broadcast(hot), side, "left").withColumn("part", F.pmod(F.xxhash64(other), many).cast("int")).drop("parts")
    held = sets.select(F.col("id").alias(side), F.col("held").alias(f"{side}_set")).join(size_checked_broadcast(hot), side, "left")
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).drop("parts")
    return dealt.join(held, [side, "part"]).drop("part")


def _sets(keyed: DataFrame, rows: DataFrame, pairs: DataFrame, total: int) -> DataFrame:
    """``id, held``: the sets of shingles of the ids in ``pairs``."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ids = written(rows.select("id", "__lr_f", "__lr_i").join(ids, "id", "left_semi"), "similar-ids")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("__lr_f"), b.column("__lr_i"), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["__lr_f", "__lr_i", "held"])

    some = keyed.select("__lr_f", "__lr_i", F.col("text").cast("string").alias("text"))
    held = only_rows(some, ids, total, (sets, "__lr_f long, __lr_i long, held binary")).join(ids, ["__lr_f", "__lr_i"]).select("id", "held")
    return written(held, "similar-sets")


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets of shingles (``held``) are similar enough."""

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            hit = []
            for p, q in zip(b.column("a_set"), b.column("b_set"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 10 * min(len(x), len(y)) >= TENTHS * max(len(x), len(y)) else 0
                hit.append(10 * both >= TENTHS * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    both = _with_sets(_with_sets(pairs.select("a", "b"), held, pairs, "a", "b"), held, pairs, "b", "a")
    return written(both.select("a", "b", "a_set", "b_set").mapInArrow(compare, "a long, b long"), "similar-links")


def _joined(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """True links that connect what is connected in a pair of blocks: rows of side, id, root, fingerprints and set.

    Only texts of two roots are compared, of two sides where there are two; a link makes its roots one for what follows.
    """
    side, ids = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
    root = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)[1]
    points = np.array([r[3] for r in rows], np.int64).view(np.uint64)
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    n, two = np.array([len(s) for s in sets]), bool((side != side[0]).any())
    ends = np.cumsum(n)
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), np.int64)
    for x in range(len(rows) - 1):
        at = x + 1 + np.flatnonzero((root[x + 1 :] != root[x]) & ((side[x + 1 :] != side[x]) if two else True))
        at = at[10 * np.minimum(n[at], n[x]) >= TENTHS * np.maximum(n[at], n[x])]
        at = at[(np.bitwise_count(points[at] ^ points[x]) <= SIMILAR_APART).any(axis=1)]
        if not len(at):
            continue
        mine = codes[ends[x] - n[x] : ends[x]]
        mark[mine] = 1
        for y in at.tolist():
            if root[y] == root[x]:  # by a link of this round
                continue
            both = int(mark[codes[ends[y] - n[y] : ends[y]]].sum())
            if 10 * both >= TENTHS * (int(n[x] + n[y]) - both):
                root[root == root[y]] = root[x]
                yield int(ids[x]), int(ids[y])
        mark[mine] = 0


def _across(members: DataFrame, held: DataFrame) -> DataFrame:
    """``a, b``: links that connect the similar texts of each crowd whose roots differ; ``members`` are ``crowd, id, root,
    prints``. Pairs are compared where their sets meet, and only links that connect are rows.

    A crowd's texts are dealt into blocks of about ``BLOCK_BYTES`` of sets. Those of its most frequent root have blocks of
    their own, which meet the others but not each other.
    """
    size = F.octet_length("held") + 1024  # bounds their number as well
    members = written(members.join(held, "id"), "crowded")
    most = members.groupBy("crowd", "root").agg(F.sum(size).alias("n")).groupBy("crowd").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    blocks = lambda n: F.ceil(n / BLOCK_BYTES).cast("int")
    most = most.where("roots > 1").select("crowd", F.col("top.root").alias("top"), blocks(F.col("top.n")).alias("m"), blocks(F.col("n") - F.col("top.n")).alias("o"))
    dealt = members.join(size_checked_broadcast(written(most, "crowds")), "crowd").withColumn("is_top", F.col("root") == F.col("top"))
    dealt = dealt.withColumn("block", F.when(F.col("is_top"), F.pmod(F.xxhash64("id"), F.col("m"))).otherwise(F.col("m") + F.pmod(F.xxhash64("id"), F.col("o"))).cast("int"))
    first = F.when(F.col("is_top"), F.col("m")).otherwise(F.lit(0))
    dealt = dealt.withColumn("other", F.explode(F.sequence(first, F.col("m") + F.col("o") - 1)))
    dealt = dealt.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "root", "prints", "held")
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            found = list(_joined(rows))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        own, waiting = None, []
        for batch in it:
            for *cell, block, i, root, prints, held in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if cell != own and waiting:
                    yield out(waiting)
                    waiting = []
                own = cell
                waiting.append((block, i, root, prints, held))
        if waiting:
            yield out(waiting)

    return dealt.repartition(parts, "crowd", "i", "j").sortWithinPartitions("crowd", "i", "j").mapInArrow(run, "a long, b long")


def similar_groups(keyed: DataFrame) -> DataFrame:
    """``doc_id, __lr_f, __lr_i, root`` of rows that have a row key: rows linked by similar sets share a root."""
    rows = _signatures(keyed)
    n = rows.count()
    points = rows.select(F.posexplode("prints").alias("t", "fp"), "id")
    found = _met(points, n, SIMILAR_APART, SPLIT, ALL_PAIRS, CROWD).groupBy("a", "b").agg(F.max("forest").alias("forest"))
    found = written(found.where("a <> b"), "similar-pairs")
    held = _sets(keyed, rows, found, n)
    true = _verified(found, held)
    roots = written(components(true), "similar-roots")
    # a forest's link that isn't true may stand before others that are: such crowds are compared across components
    failed = found.where("forest").join(true, ["a", "b"], "left_anti")
    if not failed.isEmpty():
        crowds = written(components(found.where("forest").select("a", "b")), "crowds")
        crowds = crowds.unionByName(crowds.select(F.col("root").alias("node"), "root").distinct())
        open_ = crowds.join(failed.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("root").distinct()
        inside = crowds.join(size_checked_broadcast(open_), "root", "left_semi").select(F.col("node").alias("id"), F.col("root").alias("crowd"))
        placed = rows.select("id", "prints").join(written(inside, "crowded"), "id").join(roots, F.col("id") == F.col("node"), "left")
        more = written(_across(placed.select("crowd", "id", F.coalesce("root", "id").alias("root"), "prints"), held), "similar-links")
        if not more.isEmpty():
            roots = components(true.unionByName(more))
    return rows.join(roots, rows.id == roots.node, "left").select("doc_id", "__lr_f", "__lr_i", F.coalesce("root", "id").alias("root"))


def drop_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of similar texts: the one with its least id. Null and empty texts are
    alike; a row without an id goes before one that has one."""
    keyed = with_row_key(docs)
    rows = written(similar_groups(keyed), "components")
    return without_rows(keyed, not_least(rows), rows.count()).select(*docs.columns)
