"""Packing documents into fixed token windows with the sum-of-squares rule.

A document's ids are cut into full windows; what is left of it goes to the open window whose choice makes the sum of
squared counts of open windows by fill level least. The counts stand in an array over levels. Each task packs its own
partition; what it holds is bounded: when there are more than ``MAX_OPEN`` open windows, and at the end, the least filled
ones are dealt out again, piece by piece, to the others, by the same rule and cut where no other window has room. What is
left is one window, which is cut at powers of two, so that none needs padding.

Defined results: a null or empty text is the closing id alone; rows are packed as they come, also repeated ones; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
#: Open windows that a task holds at most (each holds up to ``WINDOW`` ids of 4 bytes).
MAX_OPEN = 2048
CLOSING_ID = 0
SPECIAL = "<|endoftext|>"
_ENCODERS: dict[tuple[str, str], Callable] = {}


def encoder(json_path: str, ranks_path: str) -> Callable[[str], np.ndarray]:
    """Text to ids of the byte-level BPE in ``json_path``.

    ``ranks_path`` holds the same vocabulary as ranks for a faster encoder with equal ids; texts that spell the special
    token, for which the two differ, go to the first one, and so do those with runs of white space that are too long for
    the faster one's pattern.
    """
    if (json_path, ranks_path) not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow: list[Tokenizer] = []

        def plain(text: str) -> np.ndarray:
            if not slow:
                slow.append(Tokenizer.from_file(json_path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

        def encode(text: str) -> np.ndarray:
            if SPECIAL in text:
                return plain(text)
            try:
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError as e:  # the pattern ran out of stack or steps
                if "Regex" not in str(e):
                    raise
                return plain(text)

        _ENCODERS[json_path, ranks_path] = encode
    return _ENCODERS[json_path, ranks_path]


class Levels:
    """Open windows by fill level, and the sum-of-squares rule over their counts."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window)]

    def place(self, size: int, new: bool = True) -> tuple[int, int | None]:
        """The level to put ``size`` ids on, and the open window taken from there (None: a new one, only with ``new``).

        Moving a window from level h to h + size changes the sum of squares by 2 (N[h + size] - N[h]) + 2; a new one, and
        one that becomes full, has only the one end. Of equal choices the fullest window is taken.
        """
        n, top = self.count, self.window - size
        gain = 2 * n[size : self.window + 1] + 1  # of level h + size, h = 0 ..
        gain[top] = 0  # full windows aren't counted
        gain[1:] += 1 - 2 * n[1 : top + 1]
        gain[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        if not new:
            gain[0] = np.iinfo(np.int64).max
        h = top - int(gain[::-1].argmin())
        if h == 0:
            return 0, None
        n[h] -= 1
        return h, self.open[h].pop()

    def least(self) -> int:
        """The lowest level with an open window; 0 if there is none."""
        return int((self.count[1:] > 0).argmax()) + 1 if self.count.any() else 0

    def take(self, level: int) -> int:
        self.count[level] -= 1
        return self.open[level].pop()

    def put(self, level: int, which: int) -> None:
        if level < self.window:
            self.count[level] += 1
            self.open[level].append(which)


def pieces(docs: Iterator[tuple[int | None, np.ndarray]], first: int, window: int = WINDOW, max_open: int = MAX_OPEN) -> Iterator[tuple]:
    """``doc_id, start, ids, doc_tokens, sequence_id, offset`` of each piece; sequence ids count up from ``first``."""
    levels, held, following = Levels(window), {}, first

    def full(which: int) -> Iterator[tuple]:
        at = 0
        for d, start, p, t in held.pop(which):
            yield d, start, p, t, which, at
            at += len(p)

    def drained() -> Iterator[tuple]:
        nonlocal following
        while len(held) > 1:
            rest, own = held.pop(levels.take(levels.least())), None
            for doc_id, start, ids, total in rest:
                while len(ids):
                    if own is not None or not (low := levels.least()):  # all others are full: the rest is a window again
                        if own is None:
                            own, following = following, following + 1
                        held.setdefault(own, []).append((doc_id, start, ids, total))
                        break
                    size = min(len(ids), window - low)
                    level, which = levels.place(size, False)
                    held[which].append((doc_id, start, ids[:size], total))
                    if level + size == window:
                        yield from full(which)
                    else:
                        levels.put(level + size, which)
                    start, ids = start + size, ids[size:]
            if own is not None:
                levels.put(sum(len(p[2]) for p in held[own]), own)
        if held:
            rest = held.pop(levels.take(levels.least()))
            left, size, fill = sum(len(p[2]) for p in rest), 0, 0
            for doc_id, start, ids, total in rest:
                while len(ids):
                    if fill == size:
                        following, fill = following + bool(size), 0
                        size = 1 << (left.bit_length() - 1)
                    part = ids[: size - fill]
                    yield doc_id, start, part, total, following, fill
                    start, ids, fill, left = start + len(part), ids[len(part) :], fill + len(part), left - len(part)
            following += 1

    for doc_id, ids in docs:
        total = len(ids)
        whole = total - total % window
        for start in range(0, whole, window):
            yield doc_id, start, ids[start : start + window], total, following, 0
            following += 1
        if whole == total:
            continue
        part = (doc_id, whole, ids[whole:].copy(), total)
        level, which = levels.place(total - whole)
        if which is None:
            which, following = following, following + 1
        parts = held.setdefault(which, [])
        parts.append(part)
        now = level + total - whole
        if now == window:
            yield from full(which)
        else:
            levels.put(now, which)
            if len(held) > max_open:
                yield from drained()
    yield from drained()


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of the packed ``docs``; with ``with_ids`` their ids too.

    No shuffle: each task packs the rows of its own partition in order, and its sequence ids start at its partition
    number times 2**40, so a task that runs again gives the same rows.
    """
    import public_tokenizers

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)

        def docs_of() -> Iterator[tuple[int | None, np.ndarray]]:
            for b in it:
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    yield doc_id, np.append(encode(text.as_py() or ""), np.uint32(CLOSING_ID)).astype("<u4")

        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            ids = cols[2]
            out = [pa.array(c, pa.int64()) for c in (cols[0], cols[1], [len(p) for p in ids], [zlib.crc32(p.tobytes()) for p in ids], cols[3], cols[4], cols[5])]
            if with_ids:
                out.append(pa.array([p.astype(np.int32) for p in ids], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in schema.split(", ")])

        for row in pieces(docs_of(), TaskContext.get().partitionId() << 40, window):
            rows.append(row)
            if len(rows) >= 4096:
                yield batch()
        if rows:
            yield batch()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
