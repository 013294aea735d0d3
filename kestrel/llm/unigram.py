"""Token counts under a unigram model, by dynamic programming over a trie of the distinct pre-tokens.

Pre-tokens are the words of a text, each behind a word mark.  The distinct pre-tokens of a slice form a trie
(its nodes are the distinct prefixes, kept as hashes).  Level by level, the forward score of a node is the best
``score(shorter prefix) + log p(last piece)``; a prefix shared by many pre-tokens is computed once, and the node
where a pre-token ends stores its count of tokens and score.  Counts of a text are sums over its pre-tokens.

The pieces are those of a public vocabulary; their order by merge rank gives the log probabilities by Zipf's
law.  A character that is no piece is spelled in bytes, one token for each, below every piece in score.  Equal
scores: the longer last piece wins.

Defined results: null and empty texts count zero; other columns are ignored; repeated rows give repeated
results; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kestrel.llm.shared import plain, ship, shipped
from kestrel.llm.text import HashTable, Powers, code_points, mix, prefix, slices, span_hash

MARK = "▁"
SPACES = (0x20, 9, 10, 11, 12, 13)
BYTE_PENALTY = 10.0
ZIPF_SHIFT = 2.7
LONG = 256  # characters


def read_pieces(path: str) -> list[str]:
    """Normal pieces of a vocabulary file in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def log_probabilities(n: int) -> np.ndarray:
    weight = 1.0 / (np.arange(n) + 1 + ZIPF_SHIFT)
    return np.log(weight / weight.sum())


class Model:
    """Pieces as hashes with log probabilities (bounded by the vocabulary)."""

    def __init__(self, pieces: list[str]):
        pieces = list(dict.fromkeys(p for p in pieces if p))
        self.logs = log_probabilities(len(pieces))
        self.unknown = float(self.logs.min()) - BYTE_PENALTY
        self.longest = max(map(len, pieces))
        self.powers, self.table, self.kept = Powers(), HashTable(), None
        cps, offs = code_points(pieces)
        self.table.insert(self.hashes(self.prefix(cps), offs[:-1], offs[1:] - 1), np.arange(len(pieces)))
        self.powers = Powers()

    def prefix(self, cps):
        return prefix(mix(cps.astype(np.uint64) + np.uint64(13)), self.powers)

    def hashes(self, pre, starts, ends):
        return mix(span_hash(pre, starts, ends, self.powers) + (ends - starts).astype(np.uint64))

    def solve(self, cps: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, score) of distinct pre-tokens ``cps[first:first+size]``: very long ones one by one, the rest by their trie."""
        tokens, score = np.zeros(len(size), np.int64), np.zeros(len(size))
        long = size > LONG
        for i in np.flatnonzero(long):
            tokens[i], score[i] = self.solve_long(cps[first[i]:first[i] + size[i]])
        if not long.all():
            tokens[~long], score[~long] = self.solve_trie(cps, first[~long], size[~long])
        return tokens, score

    def solve_long(self, cps: np.ndarray) -> tuple[int, float]:
        """One pre-token, character by character (a trie of one branch would have a level for each)."""
        n, width = len(cps), self.longest
        pre = self.prefix(cps)
        spelled = (1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)).astype(np.int64)
        gain, more = np.full((n, width), -np.inf), np.ones((n, width), np.int64)  # by place and length, the longest first
        for k in range(1, min(width, n) + 1):
            end = np.arange(k, n + 1)
            piece = self.table.find(self.hashes(pre, end - k, end))
            gain[k - 1:, width - k] = np.where(piece >= 0, self.logs[piece], -np.inf if k > 1 else self.unknown * spelled)
            if k == 1:
                more[:, width - 1] = np.where(piece >= 0, 1, spelled)
        best, count = np.full(width + n, -np.inf), np.zeros(width + n, np.int64)
        best[width - 1] = 0.0
        for i in range(n):
            total = best[i:i + width] + gain[i]
            at = int(total.argmax())
            best[width + i], count[width + i] = total[at], count[i + at] + more[i, at]
        return int(count[-1]), float(best[-1])

    def solve_trie(self, cps: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pre = self.prefix(cps)
        depth = np.concatenate([np.arange(1, s + 1) for s in size]) if len(size) else np.zeros(0, np.int64)
        begin = np.repeat(first, size)
        keys, spot, node = np.unique(self.hashes(pre, begin, begin + depth), return_index=True, return_inverse=True)
        end, at_depth = (begin + depth)[spot], depth[spot]  # one place of each trie node
        score, tokens = np.full(len(keys), -np.inf), np.zeros(len(keys), np.int64)
        width = 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
        order = np.argsort(at_depth, kind="stable")
        level = np.searchsorted(at_depth[order], np.arange(1, (at_depth.max() if len(order) else 0) + 2))
        for d in range(1, len(level)):
            own = order[level[d - 1]:level[d]]
            for n in range(1, min(d, self.longest) + 1):
                piece = self.table.find(self.hashes(pre, end[own] - n, end[own]))
                gain = np.where(piece >= 0, self.logs[piece], -np.inf)
                more = np.ones(len(own), np.int64)
                if n == 1:
                    spelled = piece < 0
                    more[spelled] = width[end[own[spelled]] - 1]
                    gain[spelled] = self.unknown * more[spelled]
                if n < d:
                    back = node[spot[own] - n]  # the same pre-token, n characters shorter
                    gain, more = gain + score[back], more + tokens[back]
                better = gain >= score[own]
                better &= gain > -np.inf
                score[own[better]], tokens[own[better]] = gain[better], more[better]
        last = node[np.cumsum(size) - 1]
        return tokens[last], score[last]

    def counter(self) -> Counter:
        if self.kept is None:
            self.kept = Counter(self)
        return self.kept


class Counter:
    """Counts lists of texts; terminal counts of pre-tokens met before in the worker are kept."""

    CACHE = 1 << 18

    def __init__(self, model: Model):
        self.model = model
        self._empty()

    def _empty(self):
        self.table, self.n = HashTable(16), 0
        self.tokens, self.score = np.zeros(1 << 14, np.int64), np.zeros(1 << 14)

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pre-tokens, tokens, score) of each text."""
        model = self.model
        cps, offs = code_points(texts)
        inside = ~np.isin(cps, np.array(SPACES, np.uint32))
        inside[offs[1:] - 1] = False
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(offs, starts, side="right") - 1
        words = np.bincount(owner, minlength=len(texts))
        if not len(starts):
            return words, words, np.zeros(len(texts))
        if self.n > self.CACHE:
            self._empty()
        keys = model.hashes(model.prefix(cps), starts, ends)
        word = self.table.find(keys)
        new = np.flatnonzero(word < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            s, e = starts[new[at]], ends[new[at]]
            size = e - s + 1
            first = np.cumsum(size) - size
            marked = np.full(int(size.sum()), ord(MARK), np.uint32)
            body = np.ones(len(marked), bool)
            body[first] = False
            marked[body] = cps[np.repeat(s - (first - np.arange(len(first))), size - 1) + np.arange(int((size - 1).sum()))]
            tokens, score = model.solve(marked, first, size)
            while self.n + len(tokens) > len(self.tokens):
                self.tokens, self.score = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.score))
            self.tokens[self.n:self.n + len(tokens)], self.score[self.n:self.n + len(tokens)] = tokens, score
            self.table.insert(fresh, np.arange(self.n, self.n + len(tokens)))
            self.n += len(tokens)
            word[new] = self.table.find(keys[new])
        return (words, np.bincount(owner, weights=self.tokens[word], minlength=len(texts)).astype(np.int64),
                np.bincount(owner, weights=self.score[word], minlength=len(texts)))


def _counted(batches, broadcast):
    counter = shipped(broadcast).counter()
    for part in slices(batches, "text"):
        words, tokens, score = counter.count([t or "" for t in part.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(score, pa.float64())],
                                         names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_pretokens, n_tokens, log_prob`` of the best segmentation; nothing is shuffled."""
    broadcast = ship(docs.sparkSession, Model(pieces))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return plain(docs, "doc_id", "text").mapInArrow(lambda it: _counted(it, broadcast), f"doc_id {kind}, n_pretokens bigint, n_tokens bigint, log_prob double")
