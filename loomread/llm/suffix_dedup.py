"""Removal of repeated strings by difference-cover suffix sorting, one bucket of suffixes at a time.

A suffix here is the ``MATCH`` bytes from a place on; a byte goes if a suffix covers it that also starts elsewhere. A
suffix belongs to the bucket of its anchor: the ``ANCHOR`` bytes within it whose hash is least, the leftmost of them.
Equal suffixes have equal anchors at equal distances, and neighbours mostly share one, so that a run of suffixes travels
as one segment of text of at most ``2 * MATCH - ANCHOR`` bytes. Anchors that occur once in the corpus can't belong to a
repeated suffix; only segments of the others are dealt out, and of equal ones in a batch of texts one.

A task holds one bucket of segments at a time (``BUCKET_BYTES``, cut where the anchor changes) and sorts its suffixes by
their bytes. The places whose remainder by ``MODULUS`` is in ``COVER`` are ranked first: by ``MODULUS`` bytes, then by
pairs of such ranks, which doubles the length up to ``WINDOW``. Any two places have a shift below ``MODULUS`` that takes
both onto the cover, so that suffixes that agree for long are told apart by the rank there and the few bytes around that
window. All comparisons are of bytes or of exact ranks; hashes only choose anchors.

An anchor with over ``HEAVY`` occurrences would make a bucket without bound. Its suffixes are rows of their own, of 128-bit
digests of their bytes, that are counted and joined like any relation.

Whole copies of a text are told by digest before, and one stands for all.

Defined results: a null text counts as empty; texts below ``MATCH`` bytes lose nothing; repeated rows are copies of each
other; an empty table gives an empty result; other columns are ignored. Long texts are read in strips; a worker holds a
batch's texts, not a multiple of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.llm.common import only_rows, spread_join, with_row_key, without_rows, written

MATCH = 400
ANCHOR = 64
#: A perfect difference set: each remainder but 0 is the difference of one pair.
MODULUS = 7
COVER = (0, 1, 3)
#: Bytes that a cover place's rank stands for; with the 8 bytes around it, a suffix.
WINDOW = MATCH - 8
#: How far apart the ranks are that are paired: MODULUS bytes double to 32 of them, and 24 more make WINDOW.
STEPS = (1, 2, 4, 8, 16, 24)
#: Bytes of text in a batch, about; in a strip; of segments in a bucket.
BATCH_BYTES = 4_000_000
STRIP = 1 << 17
BUCKET_BYTES = 2_000_000
HEAVY = 4_000
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.uint64((1 << 24) - 1)
_SLOT = np.array([COVER.index(k) if k in COVER else -1 for k in range(MODULUS)])

# ---- anchors and segments


class _Roller:
    """Hashes of ``ANCHOR`` bytes from each place of a strip on, by sums over its beginnings."""

    def __init__(self) -> None:
        back = pow(_BASE, -1, 1 << 64)
        self.table = np.random.default_rng(7).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        most = 2 * STRIP + MATCH
        self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(most, np.uint64(_BASE)))))
        self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(most, np.uint64(back)))))

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[raw] * self.up[:n], out=sums[1:])
        x = (sums[ANCHOR:] - sums[:-ANCHOR]) * self.down[: n - ANCHOR + 1]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


_ROLLERS: list[_Roller] = []


def _roller() -> _Roller:
    if not _ROLLERS:
        _ROLLERS.append(_Roller())
    return _ROLLERS[0]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from blocks' running minima in both directions."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _strips(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Texts of ``MATCH`` bytes or more as strips: (bytes, pieces); a piece is (text, place there, place in the strip,
    length). Long texts are cut so that each suffix lies in one piece."""
    parts: list[bytes] = []
    pieces: list[tuple[int, int, int, int]] = []
    held = 0
    for k, raw in enumerate(texts):
        for at in range(0, len(raw) - MATCH + 1, STRIP):
            part = raw[at : at + STRIP + MATCH - 1]
            if held and held + len(part) > 2 * STRIP:
                yield b"".join(parts), pieces
                parts, pieces, held = [], [], 0
            pieces.append((k, at, held, len(part)))
            parts.append(part)
            held += len(part)
    if pieces:
        yield b"".join(parts), pieces


def segments(raw: bytes, pieces: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``piece, first, after, anchor``: runs of suffix starts of a strip that share an anchor, and its hash."""
    h = _roller().hashes(np.frombuffer(raw, np.uint8))
    least = sliding_least(h & ~_PLACES | np.arange(len(h), dtype=np.uint64), MATCH - ANCHOR + 1)
    place = (least & _PLACES).astype(np.int64)
    begins = np.array([p[2] for p in pieces], np.int64)
    ends = begins + np.array([p[3] for p in pieces], np.int64) - MATCH + 1
    n = ends - begins
    starts = np.repeat(begins - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    piece = np.repeat(np.arange(len(pieces)), n)
    own = place[starts]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (piece[1:] != piece[:-1]))))
    last = np.concatenate((new[1:] - 1, [len(starts) - 1]))
    return piece[new], starts[new], starts[last] + 1, h[own[new]]


def anchors(raw: bytes) -> np.ndarray:
    """Hashes of a text's anchors, as signed longs; those of several places twice."""
    found = [segments(*strip)[3] for strip in _strips([raw])]
    h, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
    return np.repeat(h, np.minimum(n, 2)).view(np.int64)


def _batches(it: Iterator[pa.RecordBatch], *more: str) -> Iterator[list[tuple]]:
    """Batches of rows in their order: (file, place, text, ...)."""
    rows: list[tuple] = []
    held = 0
    for b in it:
        for f, i, text, *rest in zip(*(b.column(c).to_pylist() for c in ("__lr_f", "__lr_i", "text", *more)), strict=True):
            raw = (text or "").encode()
            rows.append((f, i, raw, *rest))
            held += len(raw) + 64
            if held >= BATCH_BYTES:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _chosen(rows: list[tuple]) -> Iterator[tuple[int, bytes, int, int, int]]:
    """Segments whose anchor is among those of their text: anchor, bytes, file, place, first suffix. Rows end with their
    anchors."""
    wanted = [np.sort(np.array(r[3], np.int64)) for r in rows]
    for raw, pieces in _strips([r[2] for r in rows]):
        piece, first, after, h = segments(raw, pieces)
        h = h.view(np.int64)
        cuts = np.searchsorted(piece, np.arange(len(pieces) + 1))
        for (k, at, begin, _), a, b in zip(pieces, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            f, i = rows[k][:2]
            keep = a + np.flatnonzero(np.isin(h[a:b], wanted[k]))
            for x, y, own in zip(first[keep].tolist(), after[keep].tolist(), h[keep].tolist(), strict=True):
                yield own, raw[x : y + MATCH - 1], f, i, at + x - begin


# ---- one bucket


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def repeated(texts: list[bytes]) -> list[np.ndarray]:
    """For each suffix start of each text, whether its suffix starts at another one too."""
    size = sum(map(len, texts))
    raw = b"".join(texts) + bytes(MATCH + 8)
    words = np.ndarray((size + MATCH,), ">u8", raw, 0, (1,)).astype(np.uint64)  # 8 bytes from each place on
    cover = (np.arange(size // MODULUS + 1)[:, None] * MODULUS + np.array(COVER)).ravel()
    rank = _ranks(words[cover] >> np.uint64(8 * (8 - MODULUS)))
    for step in STEPS:
        ahead = np.concatenate((rank[len(COVER) * step :], np.zeros(min(len(rank), len(COVER) * step), np.int64)))
        rank = _ranks(rank * (int(rank.max()) + 1) + ahead)
    often = np.bincount(rank) > 1
    begins = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    n = np.diff(begins) - MATCH + 1
    first = np.concatenate(([0], np.cumsum(n)))
    starts = np.repeat(begins[:-1] - first[:-1], n) + np.arange(int(n.sum()))
    hit = np.zeros(len(starts), bool)
    for shift in range(MODULUS):
        slot = _SLOT[(starts + shift) % MODULUS]
        at = np.flatnonzero(slot >= 0)
        own = rank[(starts[at] + shift) // MODULUS * len(COVER) + slot[at]]
        at, own = at[often[own]], own[often[own]]
        tail = np.uint64((1 << 8 * (8 - shift)) - 1)  # the bytes after the window; those before it in the others
        around = words[starts[at]] & ~tail | words[starts[at] + WINDOW] & tail
        by = np.lexsort((around, own))
        same = (own[by][1:] == own[by][:-1]) & (around[by][1:] == around[by][:-1])
        hit[at[by[1:][same]]] = True
        hit[at[by[:-1][same]]] = True
    return [hit[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges in the order of their starts."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    at = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return starts[at], reach[np.concatenate((at[1:] - 1, [len(starts) - 1]))]


_FOUND = "__lr_f long, __lr_i long, start long, after long"
_KINDS = pa.schema([(c, pa.int64()) for c in ("__lr_f", "__lr_i", "start", "after")])


def _light(texts: DataFrame) -> DataFrame:
    """``__lr_f, __lr_i, start, after``: ranges of bytes to remove, from buckets of segments."""

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(it, "light"):
            found: dict[bytes, tuple[int, list[int], list[int], list[int]]] = {}
            for h, seg, f, i, at in _chosen(rows):
                _, fs, is_, ats = found.setdefault(seg, (h, [], [], []))
                fs.append(f)
                is_.append(i)
                ats.append(at)
            if found:
                h, *where = zip(*found.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(list(found), pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in where)], ["h", "seg", "f", "i", "at"])

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[list[int], list[int], list[int]]] = {}
        size, last = 0, None

        def sort() -> pa.RecordBatch:
            out: list[tuple[int, int, int, int]] = []
            for (seg, (fs, is_, ats)), hit in zip(held.items(), repeated(list(held)), strict=True):
                if len(ats) > 1:
                    hit = np.ones(len(hit), bool)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                for a, b in edges.reshape(-1, 2).tolist():
                    out += [(f, i, at + a, at + b + MATCH - 1) for f, i, at in zip(fs, is_, ats, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 4, schema=_KINDS)

        for b in it:
            for h, seg, fs, is_, ats in zip(*(b.column(c).to_pylist() for c in ("h", "seg", "f", "i", "at")), strict=True):
                if size >= BUCKET_BYTES and h != last:
                    yield sort()
                    held, size = {}, 0
                if seg in held:
                    for mine, theirs in zip(held[seg], (fs, is_, ats), strict=True):
                        mine += theirs
                else:
                    held[seg] = fs, is_, ats
                    size += len(seg)
                last = h
        if held:
            yield sort()

    sent = texts.where("size(light) > 0").mapInArrow(send, "h long, seg binary, f array<long>, i array<long>, at array<long>")
    return sent.repartition("h").sortWithinPartitions("h").mapInArrow(meet, _FOUND)


def _heavy(texts: DataFrame) -> DataFrame:
    """As :func:`_light` for the suffixes of heavy anchors: rows of digests, counted, joined."""

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _batches(it, "heavy"):
            found: dict[bytes, list[tuple[int, int, int]]] = {}
            for _, seg, f, i, at in _chosen(rows):
                found.setdefault(seg, []).append((f, i, at))
            prints: dict[bytes, tuple[list[int], list[int], list[int]]] = {}

            def out(prints: dict = prints) -> pa.RecordBatch:
                raw = np.frombuffer(b"".join(prints), ">i8").astype(np.int64).reshape(-1, 2)
                where = zip(*prints.values(), strict=True)
                b = pa.RecordBatch.from_arrays([pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy()), *(pa.array(x, pa.list_(pa.int64())) for x in where)], ["a", "b", "f", "i", "at"])
                prints.clear()
                return b

            for seg, where in found.items():
                for k in range(len(seg) - MATCH + 1):
                    fs, is_, ats = prints.setdefault(xxhash.xxh3_128_digest(seg[k : k + MATCH]), ([], [], []))
                    for f, i, at in where:
                        fs.append(f)
                        is_.append(i)
                        ats.append(at + k)
                if len(prints) >= 50_000:
                    yield out()
            if prints:
                yield out()

    sent = written(texts.where("size(heavy) > 0").mapInArrow(send, "a long, b long, f array<long>, i array<long>, at array<long>"), "repeat-heavy")
    often = written(sent.groupBy("a", "b").agg(F.sum(F.size("at")).alias("n"), F.count("*").alias("rows")).where("n > 1"), "repeat-often")
    hit = spread_join(sent, often, ["a", "b"], "rows", sent.count())
    one = F.explode(F.arrays_zip("f", "i", "at")).alias("o")
    return hit.select(one).select(F.col("o.f").alias("__lr_f"), F.col("o.i").alias("__lr_i"), F.col("o.at").alias("start"), (F.col("o.at") + MATCH).alias("after"))


# ---- all together


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of rows with ranges: ``spans`` by start and end."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    for b in it:
        out = []
        for f, i, text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("__lr_f", "__lr_i", "text", "starts", "ends")), strict=True):
            raw = text.encode()
            s = np.array(starts, np.int64)
            by = np.argsort(s, kind="stable")
            s, e = _runs(s[by], np.array(ends, np.int64)[by])
            edges = [0, *np.stack((s, e), axis=1).ravel().tolist(), len(raw)]
            kept, chars = hashlib.sha256(), 0
            for k in range(0, len(edges), 2):
                part = raw[edges[k] : edges[k + 1]]
                kept.update(part)
                chars += int(np.count_nonzero(np.frombuffer(part, np.uint8) & 0xC0 != 0x80))
            out.append((f, i, int((e - s).sum()), len(s), kept.digest(), chars, s.tolist(), e.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["__lr_f", "__lr_i", "n_removed", "n_spans", "kept", "kept_chars", "span_starts", "span_ends"])


def remove_repeats_keyed(keyed: DataFrame) -> DataFrame:
    """As :func:`remove_repeats`, of rows that have a row key, with it."""
    key = ["__lr_f", "__lr_i"]
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), *key, F.col("text").cast("string").alias("text"))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t or "" for t in b.column("text").to_pylist()]
            raw = [t.encode() for t in texts]
            cols = [pa.array([len(r) for r in raw], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(r).digest() for r in raw], pa.binary()), pa.array([anchors(r) for r in raw], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__lr_f"), b.column("__lr_i"), *cols], ["doc_id", "__lr_f", "__lr_i", "n_bytes", "n_chars", "digest", "anchors"])

    base = written(rows.mapInArrow(read, "doc_id long, __lr_f long, __lr_i long, n_bytes long, n_chars long, digest binary, anchors array<long>"), "repeat-rows")
    n = base.count()
    narrow = base.drop("anchors")
    groups = narrow.where(F.col("n_bytes") >= MATCH).groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct(*key)).alias("one")).where("copies > 1")
    groups = written(groups, "repeat-copies")
    first = (F.col("one.__lr_f") == F.col("__lr_f")) & (F.col("one.__lr_i") == F.col("__lr_i"))
    sure = spread_join(narrow, groups, ["digest"], "copies", n, "left").withColumn("copied", F.col("copies").isNotNull()).withColumn("stands", F.coalesce(first, F.lit(True)))
    narrow = written(sure.select(*narrow.columns, "copied", "stands"), "repeat-groups")
    # anchors that occur twice, and the texts that have them
    own = without_rows(base.where("size(anchors) > 0").select(*key, "anchors"), narrow.where("not stands"), n)
    own = written(own.select(*key, F.explode("anchors").alias("h")), "repeat-anchors")
    twice = written(own.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeat-twice")
    heavy = F.col("n") > HEAVY
    wanted = spread_join(own, twice, ["h"], "n", own.count()).groupBy(*key)
    wanted = written(wanted.agg(F.collect_set(F.when(~heavy, F.col("h"))).alias("light"), F.collect_set(F.when(heavy, F.col("h"))).alias("heavy")), "repeat-marks")
    some = only_rows(rows.select(*key, "text"), wanted, n)
    texts = written(some.join(wanted, key), "repeat-texts")
    ranges = _light(texts)
    if not twice.where(heavy).isEmpty():
        ranges = ranges.unionByName(_heavy(texts))
    ranges = ranges.groupBy(*key).agg(F.collect_list("start").alias("starts"), F.collect_list("after").alias("ends"))
    cut = texts.select(*key, "text").join(ranges, key).mapInArrow(_cut, "__lr_f long, __lr_i long, n_removed long, n_spans long, kept binary, kept_chars long, span_starts array<long>, span_ends array<long>")
    whole = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    every = lambda v: F.array(v.cast("long"))
    out = narrow.join(cut, key, "left")
    pick = lambda copied, name, otherwise: F.when(F.col("copied"), copied).otherwise(F.coalesce(F.col(name), otherwise)).alias(name)
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", *key, "n_bytes", pick(F.col("n_bytes"), "n_removed", zero), pick(one, "n_spans", zero), pick(whole, "kept", F.col("digest")), pick(zero, "kept_chars", F.col("n_chars")), pick(every(zero), "span_starts", none), pick(every(F.col("n_bytes")), "span_ends", none))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_chars, span_starts, span_ends`` of each row of ``docs``.

    ``kept`` is the SHA-256 of the bytes that stay, ``kept_chars`` the number of code points that begin in them (that of
    the text where nothing goes); the spans are the maximal runs of removed bytes.
    """
    return remove_repeats_keyed(with_row_key(docs)).drop("__lr_f", "__lr_i")
