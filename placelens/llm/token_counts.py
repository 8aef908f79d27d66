"""Counts of SentencePiece tokens by rank-synchronous merging of ragged arrays.

Method: the texts of a batch are cut into pre-tokens (where no piece can reach
across, see ``sentencepiece_bpe``); the distinct pre-tokens that the worker has
not met lie one after another in one numpy array of symbols. In each round every
sequence applies its pair of lowest rank; pre-tokens without a mergeable pair
leave the array. Surviving symbols are counted; a character outside the
vocabulary counts one token for each of its UTF-8 bytes.

A sequence merges the places of its lowest-ranked pair in one round, from the left
up to the first that makes a pair of this rank or a lower one, so that the result is
that of merging one pair at a time. Only pairs beside a merge are ranked anew. Long
pre-tokens are cut wherever no piece has the two characters beside each other, so
that texts without blanks stay cheap.

Defined results: a null text counts 0 tokens; rows are kept one to one; an empty
table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from placelens.llm.sentencepiece_bpe import BLANK, Vocabulary, byte_sizes, slices, texts_of

#: Pre-tokens whose count a worker remembers: the first it meets.
MEMO = 400_000
NEVER = 1 << 40
#: Characters from which a pre-token is cut further, and not remembered.
LONG = 64


class Merger:
    """Pair tables of a vocabulary, and the rounds of merging."""

    def __init__(self, model: bytes) -> None:
        v = self.vocabulary = Vocabulary(model)
        self.symbol = {t: k for k, t in enumerate(v.ids)}
        for t in v.ids:
            for c in t:
                self.symbol.setdefault(c, len(self.symbol))
        self.cost = np.array([1 if t in v.ids else len(t.encode()) for t in self.symbol], np.int64)
        self.base = len(self.symbol) + 1  # the last one stands for characters outside all pieces
        found = {}
        for t in v.ids:
            for k in range(1, len(t)):
                a, b = self.symbol.get(t[:k]), self.symbol.get(t[k:])
                if a is not None and b is not None:
                    found[a * self.base + b] = (v.rank[t], self.symbol[t])
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([found[k][1] for k in self.keys.tolist()], np.int64)
        own = np.full(self.base, NEVER, np.int64)
        own[self.made] = self.ranks
        lowest = np.full(self.base, NEVER, np.int64)  # of the pairs that a symbol takes part in
        np.minimum.at(lowest, self.keys // self.base, self.ranks)
        np.minimum.at(lowest, self.keys % self.base, self.ranks)
        self.at_once = lowest > own
        self.counts: dict[str, int] = {}

    def rank_pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NEVER: none) and its place in the table."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), at

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each of the (non-empty) pre-tokens, blanks as pieces have them."""
        outside = self.base - 1
        text = "".join(words)
        symbols = np.fromiter((self.symbol.get(c, outside) for c in text), np.int64, len(text))
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=bounds[1:])
        total = np.zeros(len(words), np.int64)
        owner = np.repeat(np.arange(len(words)), np.diff(bounds))
        lost = symbols == outside
        if lost.any():
            sizes = np.array([len(text[k].encode()) for k in np.flatnonzero(lost)], np.int64)
            np.add.at(total, owner[lost], sizes)
        rank, made = np.full(len(symbols), NEVER), np.zeros(len(symbols), np.int64)  # of each symbol with its right neighbour

        def update(at: np.ndarray) -> None:
            at = at[at + 1 < len(symbols)]
            joined = owner[at] == owner[at + 1]
            rank[at[~joined]] = NEVER
            at = at[joined]
            r, place = self.rank_pairs(symbols[at], symbols[at + 1])
            rank[at], made[at] = r, self.made[place]

        update(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            ended = low == NEVER
            if ended.any():
                known = ended & (symbols != outside)
                total += np.bincount(owner[known], self.cost[symbols[known]], len(words)).astype(np.int64)
                stay = ~ended
                symbols, owner, rank, made, low = symbols[stay], owner[stay], rank[stay], made[stay], low[stay]
                if not len(symbols):
                    break
            places = self._places(symbols, owner, rank, made, low)
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols[places] = made[places]
            rank[places[places + 2 >= len(symbols)]] = NEVER
            at = np.cumsum(keep)[places] - 1
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            rank[-1] = NEVER
            update(np.unique(np.concatenate([at, at[at > 0] - 1])))
        return total

    def _places(self, symbols: np.ndarray, owner: np.ndarray, rank: np.ndarray, made: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where each sequence merges in this round: its places of lowest rank, each second one of adjoining
        places, from the left up to the first that makes a pair of this rank or a lower one."""
        places = np.flatnonzero(rank == low)
        run = np.append(True, places[1:] != places[:-1] + 1)
        within = np.arange(len(places)) - np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
        places = places[within % 2 == 0]
        new = made[places]
        risky = np.flatnonzero(~self.at_once[new])
        if not len(risky):
            return places
        p, m, n = places[risky], new[risky], len(symbols)
        beyond = np.minimum(p + 2, n - 1)
        right = (p + 2 < n) & (owner[beyond] == owner[p])
        least = np.where(right, self.rank_pairs(m, symbols[beyond])[0], NEVER)
        before = np.maximum(p - 1, 0)
        left = (p > 0) & (owner[before] == owner[p])
        # a neighbour that is merged in this round is what that merge makes
        merged = (risky > 0) & (places[np.maximum(risky - 1, 0)] == p - 2)
        beside = np.where(merged, new[np.maximum(risky - 1, 0)], symbols[before])
        least = np.minimum(least, np.where(left, self.rank_pairs(beside, m)[0], NEVER))
        conflict = np.zeros(len(places), np.int64)
        conflict[risky] = least <= rank[p]
        if not conflict.any():
            return places
        seen = np.cumsum(conflict) - conflict  # conflicts left of a place, in all sequences before it as well
        first = np.flatnonzero(np.append(True, owner[places[1:]] != owner[places[:-1]]))
        return places[seen == np.repeat(seen[first], np.diff(np.append(first, len(places))))]

    def cut(self, word: str) -> list[str]:
        """A long pre-token, cut where no piece has the two characters beside each other."""
        beside, out, start = self.vocabulary.beside, [], 0
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in beside:
                out.append(word[start:k])
                start = k
        return [*out, word[start:]]

    def count_new(self, words: list[str]) -> list[int]:
        """Tokens of pre-tokens with spaces for blanks."""
        words = [w.replace(" ", BLANK) for w in words]
        parts = [self.cut(w) if len(w) >= LONG else [w] for w in words]
        sizes = np.array([len(p) for p in parts], np.int64)
        return np.add.reduceat(self.count([x for p in parts for x in p]), np.cumsum(sizes) - sizes).tolist()

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        counts, cut = self.counts, self.vocabulary.chunks
        words = [cut(t) for t in texts]
        new = list({w for ws in words for w in ws if w not in counts})
        fresh = dict(zip(new, self.count_new(new))) if new else {}
        for w in new[: max(0, MEMO - len(counts))]:
            if len(w) < LONG:
                counts[w] = fresh[w]
        both = _Either(counts, fresh)
        return [sum(map(both.__getitem__, ws)) for ws in words]


class _Either(dict):
    """Counts met before, and the batch's own."""

    def __init__(self, old: dict[str, int], fresh: dict[str, int]) -> None:
        super().__init__(fresh)
        self.old = old

    def __missing__(self, key: str) -> int:
        return self.old[key]


_loaded: dict[bytes, Merger] = {}


def worker_merger(model: bytes) -> Merger:
    """The merger of a model, kept for the life of a Python worker."""
    if model not in _loaded:
        _loaded[model] = Merger(model)
    return _loaded[model]


def count_tokens(documents: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text, one row per input row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        merger = worker_merger(shared.value)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(byte_sizes(texts)):
                counts = merger.count_texts(texts.slice(a, b - a).to_pylist())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(byte_sizes(part.column(1)), pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_tokens")])
    return texts_of(documents, id_col, text_col).mapInArrow(run, schema)


def with_limit(counts: DataFrame, limit: int) -> DataFrame:
    """``counts`` with over_limit: more tokens than ``limit``."""
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
