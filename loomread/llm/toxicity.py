"""Toxic passages by maximal scoring segments over token log-odds.

Each token scores its log-odds for toxic documents under nested Dirichlet priors (a word leans on its 6-letter
beginning, that on the 5-letter one, then 4 letters, then the base rate), less a drift, so that neutral text scores
negative on average. The odds come from documents that have a word, however often, so a word that was used ``gap`` tokens
before tells little anew: its log-odds count by 1 - exp(-gap / ``BURST``). A linear-time scan finds all maximal scoring
segments (Ruzzo and Tompa). Scores are calibrated as extreme values (Karlin and Altschul): lambda solves sum p(s)
exp(lambda s) = 1 over clean text, ln K comes from the highest segments of clean documents, and a segment of score S in
a text of n tokens has the normalised score lambda S - ln(K n), its -ln(E). A logistic curve over the best and the summed
normalised scores, of which each counts as ``SURE`` from there on, gives the score.

Bounds: the model is fitted on at most ``FIT_ROWS`` labelled rows, chosen by a hash of their ids; all of their words and
beginnings of words that two documents have are in it. All documents are scored, whole texts each.

Defined results: a null or empty text has no tokens and gets the curve's value without segments; without labels of both
kinds, the score is the rate of toxic labels (0 without any); a null id is never held out nor learned from; repeated
rows score alike; ids that repeat in the labels count once, as toxic if any row says so.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.llm.common import written

FIT_ROWS = 40_000
#: Weight of the prior at each step of the nesting, in documents.
PRIOR = 4.0
DRIFT = 1.0
#: Tokens after which a word tells 63 % as much again.
BURST = 16.0
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
#: From this normalised score on (a chance of e**-40) the curve sees no difference.
SURE = 40.0
_WORD = re.compile(r"[^\W\d_]+")
_EULER = 0.5772156649


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def units(word: str) -> list[str]:
    """The word, and its beginnings as ``length:letters``."""
    return [word, *(f"{k}:{word[:k]}" for k in BEGINNINGS if len(word) >= k)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, after last, score), in linear time.

    Candidates carry the running sums before and after them. A new one looks for the last candidate whose sum before is
    lower; each candidate remembers where its own look ended, so that looks skip what can't match.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    for i, lo, hi in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        start, j = i, len(first) - 1
        while True:
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                break
            start, lo, j, keep = first[j], low[j], link[j], j
            del first[keep:], last[keep:], low[keep:], high[keep:], link[keep:]
        first.append(start)
        last.append(i + 1)
        low.append(lo)
        high.append(hi)
        link.append(j)
    return [(a, b, h - lo) for a, b, lo, h in zip(first, last, low, high, strict=True)]


class Odds:
    """Log-odds by unit, in 12 bytes each: sorted 64-bit hashes and values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values[by].astype(np.float32)

    @classmethod
    def of(cls, odds: dict[str, float]) -> Odds:
        return cls(_hashes(list(odds)), np.array(list(odds.values()), float))

    def get(self, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values of units, and which of them are known."""
        h = _hashes(asked)
        if not len(self.keys):
            return np.zeros(len(h)), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.values[at].astype(float), self.keys[at] == h

    def __len__(self) -> int:
        return len(self.keys)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Odds) and np.array_equal(self.keys, other.keys) and np.array_equal(self.values, other.values)


def _hashes(asked: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(u) for u in asked), np.uint64, len(asked))


@dataclass
class Model:
    """Log-odds of words and beginnings, the calibration and the curve. As large as the sample's vocabulary."""

    odds: Odds = field(default_factory=lambda: Odds.of({}))
    lam: float = 1.0
    ln_k: float = 0.0
    curve: tuple[float, ...] | None = None  # constant, weights of the features
    rate: float = 0.0
    _known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if isinstance(self.odds, dict):
            self.odds = Odds.of(self.odds)

    def _learn(self, words: list[str]) -> None:
        """Scores of words: by the word itself, else by its longest beginning that is known."""
        if len(self._known) > 200_000:
            self._known.clear()
        for k in (None, *reversed(BEGINNINGS)):
            asked = [w if k is None else f"{k}:{w[:k]}" for w in words]
            values, found = self.odds.get(asked)
            found = found.tolist()
            self._known.update((w, v - DRIFT) for w, v, hit in zip(words, values.tolist(), found, strict=True) if hit)
            words = [w for w, hit in zip(words, found, strict=True) if not hit]
        self._known.update((w, -DRIFT) for w in words)

    def scores(self, words: list[str]) -> np.ndarray:
        if new := [w for w in set(words) if w not in self._known]:
            self._learn(new)
            if any(w not in self._known for w in words):  # forgotten just now
                self._learn(list(set(words)))
        out = np.array([self._known[w] for w in words], float)
        last: dict[str, int] = {}
        for i in np.flatnonzero(out > -DRIFT).tolist():
            before = last.get(words[i])
            last[words[i]] = i
            if before is not None:
                out[i] = (out[i] + DRIFT) * -math.expm1((before - i) / BURST) - DRIFT
        return out

    def statistics(self, text: str | None) -> tuple[tuple[float, float], list[tuple[int, int, float]]]:
        """The curve's features; the significant segments, whose E-value is below 1, with their normalised scores."""
        words = tokens(text)
        scores = self.scores(words)
        shift = self.ln_k + math.log(max(len(words), 1))
        found = [(a, b, self.lam * s - shift) for a, b, s in segments(scores)]
        good = [x for x in found if x[2] > 0]
        best = max((s for *_, s in found), default=-shift)  # without a segment, the normalised score of 0
        return (min(best, SURE), min(sum(x[2] for x in good), SURE)), good

    def score(self, features: tuple[float, float]) -> float:
        if self.curve is None:
            return self.rate
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def log_odds(names: list[str], toxic: np.ndarray, clean: np.ndarray, rate: float) -> Odds:
    """Log-odds over the base rate of units that ``toxic`` and ``clean`` documents have. A unit leans on its longest
    beginning among them; one that no document has is left out."""
    base, share = math.log(rate / (1 - rate)), {}  # shares of the beginnings, shorter ones first
    out = np.zeros(len(names))
    level = np.array([int(u[0]) if u[1:2] == ":" else 9 for u in names], np.int8)
    for k in (*BEGINNINGS, 9):
        for i in np.flatnonzero((level == k) & (toxic + clean > 0)).tolist():
            word = names[i] if k == 9 else names[i][2:]
            parent = next((share[b] for n in reversed(BEGINNINGS) if n < k and n <= len(word) and (b := f"{n}:{word[:n]}") in share), rate)
            p = (toxic[i] + PRIOR * parent) / (toxic[i] + clean[i] + PRIOR)
            if k != 9:
                share[names[i]] = p
            out[i] = math.log(p / (1 - p)) - base
    has = toxic + clean > 0
    return Odds(_hashes([n for n, own in zip(names, has.tolist(), strict=True) if own]), out[has])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's steps; the slopes aren't negative."""
    k = x.shape[1]
    a, w, ridge = np.c_[np.ones(len(x)), x], np.zeros(k + 1), np.diag([1e-3, *[1e-2] * k])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if k > 1 and (w[1:] < 0).any():  # fit again without the features that would lower the score
        keep = w[1:] >= 0
        held = iter(_curve(x[:, keep], y)) if keep.any() else iter((float(w[0]),))
        return next(held), *(next(held) if own else 0.0 for own in keep)
    return float(w[0]), *(max(float(v), 0.0) for v in w[1:])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled rows that aren't held out, at most ``fit_rows`` of them.

    A quarter of them is left out of the counts for the calibration and the curve; the final counts have all.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(1)), "doc_id").limit(fit_rows)
    chosen = chosen.withColumn("aside", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(4)) == 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = written(rows, "toxicity-fit")  # the one scan of all documents; what follows reads the sample

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str | None, bool, int], int] = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            b = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["unit", "aside", "toxic", "n"])
            seen.clear()
            return b

        for b in it:
            for text, aside, toxic in zip(b.column("text").to_pylist(), b.column("aside").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen.update((u, aside, toxic) for u in {u for w in set(tokens(text)) for u in units(w)})
                seen[None, aside, toxic] += 1  # the document itself
            if len(seen) > 500_000:
                yield out()
        if seen:
            yield out()

    n_of = lambda aside, toxic: F.sum(F.when((F.col("toxic") == toxic) & ((F.col("aside") == F.lit(False)) | F.lit(aside)), F.col("n")).otherwise(0))
    counts = rows.mapInArrow(count, "unit string, aside boolean, toxic int, n long").groupBy("unit").agg(n_of(True, 1).alias("t"), n_of(True, 0).alias("c"), n_of(False, 1).alias("t0"), n_of(False, 0).alias("c0"))
    # all units of two documents or more, as many as the sample's rows bring; they come in columns
    kept = counts.where(F.col("unit").isNull() | (F.col("t") + F.col("c") >= 2)).toArrow()
    names = kept.column("unit").to_pylist()
    n = {c: kept.column(c).to_numpy() for c in ("t", "c", "t0", "c0")}
    del kept
    documents = next((i for i, u in enumerate(names) if u is None), None)
    total = {c: 0 if documents is None else int(v[documents]) for c, v in n.items()}
    if not total["t"] or not total["c"]:
        return Model(rate=total["t"] / max(1, total["t"] + total["c"]))
    rate = total["t"] / (total["t"] + total["c"])
    names[documents] = ""
    for v in (n := {c: v.copy() for c, v in n.items()}).values():
        v[documents] = 0
    final = Model(log_odds(names, n["t"], n["c"], rate), rate=rate)
    if not total["t0"] or not total["c0"]:
        trial = final
    else:
        trial = Model(log_odds(names, n["t0"], n["c0"], rate), rate=rate)
    del names, n
    shared = spark.sparkContext.broadcast(trial.odds)

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for b in it:
            out = []
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = tokens(text)
                scores = model.scores(words)
                found = [s for *_, s in segments(scores)]
                values, n = np.unique(np.round(scores, 2), return_counts=True)
                out.append((toxic, len(scores), found, dict(zip(values.tolist(), n.tolist(), strict=True)) if not toxic else {}))
            hist: Counter = Counter()
            for x in out:
                hist.update(x[3])
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([[max(x[2])] if x[2] else [] for x in out], pa.list_(pa.float64()))], ["toxic", "n", "found"])
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(hist), pa.int32()), pa.array(list(hist.values()), pa.int64()), pa.array([[v] for v in hist], pa.list_(pa.float64()))], ["toxic", "n", "found"])

    aside = rows.where("aside" if trial is not final else "true")
    measured = aside.mapInArrow(measure, "toxic int, n long, found array<double>")
    got = measured.where("toxic >= 0").collect()  # at most fit_rows rows
    hist = measured.where("toxic < 0").groupBy(F.element_at("found", 1).alias("s")).agg(F.sum("n").alias("n")).collect()
    if hist:
        s, n = np.array([r["s"] for r in hist]), np.array([r["n"] for r in hist], float)
        final.lam = _weighted_lambda(s, n)
    top = [(max(r["found"]), r["n"]) for r in got if not r["toxic"] and r["found"]]
    if top:
        final.ln_k = float(np.mean([final.lam * m - math.log(n) for m, n in top])) - _EULER
    # the curve's features, as scoring has them: all significant segments under the final calibration
    lam, ln_k = final.lam, final.ln_k

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, lam, ln_k)
        for b in it:
            z = [model.statistics(t)[0] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([list(v) for v in z], pa.list_(pa.float64()))], ["toxic", "x"])

    seen = aside.mapInArrow(features, "toxic int, x array<double>").collect()  # at most fit_rows rows
    x, y = [r["x"] for r in seen], [r["toxic"] for r in seen]
    if len(set(y)) == 2:
        final.curve = _curve(np.array(x, float), np.array(y, float))
    return final


def _weighted_lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 for scores ``values`` with ``weights``; 1 if there is none."""
    p = weights / weights.sum()
    if values.max() <= 0 or p @ values >= 0:
        return 1.0
    over = lambda x: p @ np.exp(np.minimum(x * values, 600)) > 1
    low, high = 1e-6, 0.25
    while not over(high) and high < 16:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return high


SEGMENTS = "segments array<struct<first:int,after:int,score:double>>"


def score(docs: DataFrame, model: Model, with_segments: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_segments`` of each row; with ``with_segments`` the significant segments
    (token places and normalised scores)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.odds, model.lam, model.ln_k, model.curve, model.rate))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in it:
            got = [own.statistics(t) for t in b.column("text").to_pylist()]
            values = [own.score(x) for x, _ in got]
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(values, pa.float64()), pa.array([int(v >= THRESHOLD) for v in values], pa.int32()), pa.array([len(g) for _, g in got], pa.int32())]
            names = ["doc_id", "held_out", "score", "predicted", "n_segments"]
            if with_segments:
                cols.append(pa.array([[{"first": a, "after": z, "score": s} for a, z, s in g] for _, g in got], pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("score", pa.float64())]))))
                names.append("segments")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_segments int" + (f", {SEGMENTS}" if with_segments else ""))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that are predicted to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.odds, model.lam, model.ln_k, model.curve, model.rate))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in it:
            clean = [own.score(own.statistics(t)[0]) < THRESHOLD for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
