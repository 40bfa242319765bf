"""Token counts of a unigram tokenizer without its tokens: Viterbi over vocabulary matches that carries score and count.

White space is marked and split as by a ``Metaspace(split=True)`` pre-tokenizer (each space becomes a mark; a piece
starts at each mark; a first mark is put before the text), so a text's best path is that of its words, and a word's
count is found once for a worker. In a word an Aho-Corasick automaton enumerates the vocabulary's matches by their end;
each end keeps its best score, the pieces on that path, and whether it ends in an unknown character.

Ties as the tokenizer has them: of equal scores at an end, the match that starts first stays; a character counts as
unknown (score: the least one less 10) only where no entry is that very character; with byte fallback an unknown
character is as many pieces as it has bytes, else unknown characters next to each other are one piece.

The vocabulary is a parameter. By default it has the pieces of a public vocabulary file; as its scores are merge ranks,
the log-probability of rank r is taken by Zipf's rule: -ln(r + 2.7) - ln H.

Defined results: a null or empty text has 0 tokens and score 0; repeated rows give equal rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
ZIPF_SHIFT = 2.7
#: Words whose counts a worker remembers.
KNOWN_WORDS = 300_000


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces of a vocabulary file in their order, with scores by Zipf's rule; control pieces score least."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = m.get_piece_size()
    norm = math.log(sum(1 / (r + ZIPF_SHIFT) for r in range(n)))
    own = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.get_score(i) < -1e8 for i in range(n)]
    ranks, at = [], 0
    for special in own:
        ranks.append(n if special else at)
        at += not special
    return [(m.id_to_piece(i), -math.log(r + ZIPF_SHIFT) - norm) for i, r in enumerate(ranks)]


class Counter:
    """Counts of a unigram vocabulary ``(piece, score)``; ``unknown`` is the place of the unknown piece."""

    def __init__(self, vocab: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = True) -> None:
        self.trie = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocab):
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown_score = min(s for _, s in vocab) - UNKNOWN_PENALTY
        have = {p for p, _ in vocab}
        self.byte_fallback = byte_fallback and all(f"<0x{b:02X}>" in have for b in range(256))
        self.unknown_piece = vocab[unknown][0]
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best path through a word that starts with the mark."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            got = self.known[word] = self._path(word)
        return got

    def _path(self, word: str) -> tuple[int, float]:
        n = len(word)
        score, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, m in self.trie.iter(word):
            matches[end + 1].append(m)
        for end in range(1, n + 1):
            best, from_, single = None, -1, False
            for length, s in matches[end]:  # the longest first
                candidate = s + score[end - length]
                if best is None or candidate > best:
                    best, from_ = candidate, end - length
                single = single or length == 1
            if not single:
                candidate = self.unknown_score + score[end - 1]
                if best is None or candidate > best:
                    size = len(word[end - 1].encode()) if self.byte_fallback else 0 if open_[end - 1] else 1
                    score[end], count[end], open_[end] = candidate, count[end - 1] + size, True
                    continue
            score[end], count[end] = best, count[from_] + 1
        return count[n], score[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """Tokens of a whole text, and the score of its best path."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        tokens, score, word = 0, 0.0, self.word
        for w in marked.split(MARK)[1:]:
            n, s = word(MARK + w)
            tokens += n
            score += s
        return tokens, score


_COUNTERS: dict[str, Counter] = {}


def counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_prob, n_chars`` of each row of ``docs``."""
    import public_tokenizers

    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(vocabulary(path))
        counter = _COUNTERS[path]
        for b in it:
            texts = b.column("text").to_pylist()
            got = [counter.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64()), pa.array([len(t or "") for t in texts], pa.int64())], ["doc_id", "n_tokens", "log_prob", "n_chars"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, log_prob double, n_chars long")
