"""Stupid-backoff language-model scores of all documents under counts over all documents.

The relations are the usual ones: n-gram counts partitioned by hash, joined to the documents' n-grams, summed by
document. Rows are packed so that the shuffle stays small: a task explodes a batch of documents into n-gram hashes,
adds up equal ones, and sends each range of hashes as one row of sorted differences (``bucket, batch, order``). A bucket
adds up its counts and answers each batch with the counts in the batch's own order; the batch's texts meet these answers
in a cogroup by batch, where each position takes the longest n-gram that was seen and the positions are summed by
document. A batch sends at most a row for each of its distinct n-grams, and one row for many while there are fewer
buckets: work and rows grow with the text, not with buckets times batches.

A word is a run of characters other than space and bytes 9-13, with A-Z in lower case. An n-gram of two or more words is
seen if it occurs ``MIN_COUNT`` times in the corpus at least (once is the document itself). With ``ORDER`` 3:
S(w3 | w1 w2) = c(w1 w2 w3) / c(w1 w2) if seen, else 0.4 S(w3 | w2); S(w3 | w2) likewise; S(w3) = c(w3) / N.
The first words of a document have shorter contexts, without a factor.

Defined results: a null or empty text has 0 tokens, log score 0 and a null mean; repeated rows are counted and scored as
often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.llm.common import with_row_key, written

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2
#: Bits of an n-gram's hash.
HASH_BITS = 56
#: Bytes of text in a batch, about, and n-grams in a bucket.
BATCH_BYTES = 10_000_000
BUCKET_NGRAMS = 2_500_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Words(dict):
    """Hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def ngram_hashes(texts: list[bytes], order: int, known: _Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """The documents' numbers of words; for n = 1 .. order the hash of the n-gram that ends at each word, where the
    document has n words before and with it (0 where not)."""
    docs = [t.lower().split() for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    words = np.fromiter((known[w] for d in docs for w in d), np.uint64, int(sizes.sum()))
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, h = [], words
    for n in range(1, order + 1):
        if n > 1:
            before = np.concatenate((np.zeros(1, np.uint64), out_full[:-1]))
            h = before * _MIX[0] + words
        out_full = _mixed(h + np.uint64(n))
        out.append(np.where(place >= n - 1, np.maximum(out_full >> np.uint64(64 - HASH_BITS), np.uint64(1)), np.uint64(0)))
    return sizes, out


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, as many as the largest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes (without 0), and their counts."""
    s = np.sort(h)
    s = s[np.searchsorted(s, 1) :]
    first = np.flatnonzero(np.concatenate((s[:1] == s[:1], s[1:] != s[:-1])))
    return s[first], np.diff(np.concatenate((first, [len(s)]))).astype(np.uint64)


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[int | None], list[bytes]]]:
    """Batches of rows in their order, named by their first row: its key, doc_ids and texts."""
    ids: list[int | None] = []
    texts: list[bytes] = []
    name, held = "", 0
    for b in it:
        cols = (b.column(c).to_pylist() for c in ("doc_id", "text", "__lr_f", "__lr_i"))
        for doc_id, text, f, i in zip(*cols, strict=True):
            name = name or f"{f}:{i}"
            raw = (text or "").encode()
            ids.append(doc_id)
            texts.append(raw)
            held += len(raw) + 16
            if held >= BATCH_BYTES:
                yield name, ids, texts
                ids, texts, name, held = [], [], "", 0
    if ids:
        yield name, ids, texts


def scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """``doc_id, n_tokens, log_score, mean_log_score`` of each row of ``docs``."""
    rows = with_row_key(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "__lr_f", "__lr_i")
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(8, size // 5 * order // BUCKET_NGRAMS)

    def explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for name, _, texts in _batches(it):
            for n, h in enumerate(ngram_hashes(texts, order, known)[1], 1):
                distinct, count = _distinct(h)
                bucket = ((distinct >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(distinct)]))  # only the buckets that it has
                at = bucket[cuts[:-1]].tolist()
                part = lambda x: [x[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]  # noqa: B023, E731
                hashes = [_packed(np.diff(x, prepend=np.uint64(0))) if len(x) < 2 else x[:1].tobytes() + _packed(np.diff(x)) for x in part(distinct)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array([name] * len(at), pa.string()), pa.array([n] * len(at), pa.int32()), pa.array([len(x) for x in part(distinct)], pa.int32()), pa.array(hashes, pa.binary()), pa.array([_packed(x) for x in part(count)], pa.binary())],
                    ["bucket", "batch", "n", "size", "hashes", "counts"],
                )

    def add_up(t: pa.Table) -> pa.Table:
        """Counts of a bucket's n-grams over all batches, as answers to each batch."""
        n, size = t.column("n").to_pylist(), t.column("size").to_pylist()
        hashes = []
        for raw, s in zip(t.column("hashes").to_pylist(), size, strict=True):
            hashes.append(_unpacked(raw) if s < 2 else np.cumsum(np.concatenate((np.frombuffer(raw, "<u8", 1).astype(np.uint64), _unpacked(raw[8:])))))
        counts = [_unpacked(raw) for raw in t.column("counts").to_pylist()]
        answers: list[bytes] = [b""] * len(n)
        for k in set(n):
            at = [i for i, x in enumerate(n) if x == k]
            h, c = np.concatenate([hashes[i] for i in at]), np.concatenate([counts[i] for i in at])
            by = np.argsort(h, kind="stable")
            first = np.concatenate(([True], h[by][1:] != h[by][:-1]))
            total = np.add.reduceat(c[by], np.flatnonzero(first))
            back = np.empty(len(h), np.uint64)
            back[by] = total[np.cumsum(first) - 1]
            ends = np.cumsum([len(hashes[i]) for i in at])
            for i, e in zip(at, ends.tolist(), strict=True):
                answers[i] = _packed(back[e - len(hashes[i]) : e])
        return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "n": t.column("n"), "counts": pa.array(answers, pa.binary())})

    def texts_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for name, ids, texts in _batches(it):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([pack.compress(b"".join(texts))], pa.binary())], ["batch", "ids", "sizes", "texts"])

    log_backoff = math.log(backoff)

    def sum_up(texts: pa.Table, counts: pa.Table) -> pa.Table:
        """Scores of a batch's documents, less log N for each word that came down to its own count."""
        ids, sizes = texts.column("ids").to_pylist()[0], texts.column("sizes").to_pylist()[0]
        raw, at, docs = zstandard.ZstdDecompressor().decompress(texts.column("texts").to_pylist()[0], max_output_size=max(1, sum(sizes))), 0, []
        for s in sizes:
            docs.append(raw[at : at + s])
            at += s
        words, hashes = ngram_hashes(docs, order, _Words())
        del raw, docs
        parts = sorted(zip(counts.column("n").to_pylist(), counts.column("bucket").to_pylist(), counts.column("counts").to_pylist(), strict=True), key=lambda x: x[:2])
        at_word = []
        for n, h in enumerate(hashes, 1):
            got = [_unpacked(x[2]) for x in parts if x[0] == n]
            distinct, _ = _distinct(h)
            c = np.concatenate([np.zeros(1, np.uint64), *got]).astype(float)
            if len(c) != len(distinct) + 1:
                raise RuntimeError("a batch of documents was dealt differently when it was read again")
            at_word.append(np.where(h > 0, c[np.searchsorted(distinct, h, side="right")], 0.0))
        total = len(at_word[0])
        score, left, steps = np.zeros(total), np.ones(total, bool), np.zeros(total)
        for n in range(order, 1, -1):
            c = at_word[n - 1]
            context = np.concatenate((np.ones(1), at_word[n - 2][:-1]))[:total]
            hit = left & (c >= min_count)
            score[hit] = np.log(c[hit] / context[hit]) + steps[hit] * log_backoff
            left &= ~hit
            steps += hashes[n - 1] > 0
        score[left] = np.log(at_word[0][left]) + steps[left] * log_backoff
        doc = np.repeat(np.arange(len(words)), words)
        sums, own = np.bincount(doc, score, len(words)), np.bincount(doc, left, len(words))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(words, pa.int64()), "sum": pa.array(sums, pa.float64()), "own": pa.array(own.astype(np.int64), pa.int64())})

    exploded = rows.mapInArrow(explode, "bucket int, batch string, n int, size int, hashes binary, counts binary")
    answers = exploded.groupBy("bucket").applyInArrow(add_up, "batch string, bucket int, n int, counts binary")
    texts = rows.mapInArrow(texts_of, "batch string, ids array<long>, sizes array<long>, texts binary")
    summed = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(sum_up, "doc_id long, n_tokens long, sum double, own long")
    summed = written(summed, "lm-sums")
    total = summed.agg(F.sum("n_tokens")).first()[0] or 0
    log_score = F.col("sum") - F.col("own") * F.lit(math.log(max(total, 1)))
    return summed.select("doc_id", "n_tokens", log_score.alias("log_score"), F.when(F.col("n_tokens") > 0, log_score / F.col("n_tokens")).alias("mean_log_score"))
