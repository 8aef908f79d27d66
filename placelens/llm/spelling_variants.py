"""Spelling variants: words one edit apart, found by PartEnum signatures of letter multisets.

Method: a word's letters are a binary vector with one dimension for each (letter, how
many times it came before). One replaced letter changes two dimensions, one inserted
or deleted letter changes one, so words one edit apart have vectors of Hamming
distance ``k`` <= 2. PartEnum deals the dimensions to ``outer`` parts, one of which
then differs in at most k // outer dimensions, and each part to ``inner`` subparts: for
every choice of k // outer subparts to leave out, the rest of the part is an exact
signature. Vectors within the distance share one at least. Signatures are hashed, joined
by equality, and every pair is verified by its edit distance.

Words that share a signature may be many (one key may hold a large share of all rows),
so a signature also carries what an edit cannot change: the length of the shorter
word, and one of its halves; an edit leaves the first or the second half of the
shorter word whole, so each signature exists once for either half. Both are
conditions of exact equality; no pair is lost, and none is emitted unverified.

Defined results: a null text has no words; a null id counts as the empty text in the
checksum; repeated rows count again; empty tables give an empty table. Columns other
than the id and the text are not read. Ties between near words go to the smallest
in code-point order.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placelens.llm.packed import U, mix
from placelens.scratch import discard, materialize

# What counts as a letter, and which occurrences lose one.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSES_LETTER = 97

#: Rounds of pointer doubling: 2 ** 8 links, while each link at least doubles a count of 64 bits.
MOST_ROUNDS = 8


class Scheme(NamedTuple):
    """A Hamming distance and the numbers of parts and of subparts that PartEnum enumerates."""

    k: int
    outer: int
    inner: int

    def signatures(self) -> list[tuple[int, tuple[int, ...]]]:
        """(part, subparts of it that count) of every signature."""
        out = self.k // self.outer
        if self.inner <= out:
            raise ValueError("more subparts are needed than a part may differ in")
        kept = combinations(range(self.inner), self.inner - out)
        return [(part, some) for some in kept for part in range(self.outer)]


#: Replaced letters (words of one length) and inserted or deleted ones (lengths that differ by one).
REPLACED, INSERTED = Scheme(2, 1, 4), Scheme(1, 1, 3)


def counted_words(documents: DataFrame, least_letters: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters over all texts, one in 97 less a letter, of enough letters and occurrences."""
    # a run that is too short as it stands stays so; longer ones are matched whole
    runs = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(f"{LETTERS}{{{least_letters},}}"), F.lit(0))
    run = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = run.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"), F.length("run").alias("l"))
    cut = F.concat(F.expr("substring(run, 1, int(h % l))"), F.expr("substring(run, int(h % l) + 2)"))
    word = run.select(F.when(F.col("h") % LOSES_LETTER == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def hashes(points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all letters of some words, in order: what names the dimension (letter and earlier occurrences), and its hash."""
    owner = np.repeat(np.arange(len(length)), length)
    order = np.lexsort((points, owner))
    new = np.ones(len(points), bool)
    new[1:] = (points[order][1:] != points[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    place = np.arange(len(points))
    before = np.empty(len(points), U)
    before[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(U)
    dimension = mix(points.astype(U) << U(32) | before)
    return dimension, mix(dimension ^ U(0x9E3779B97F4A7C15))


def sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of each stretch of ``values``, modulo 2 ** 64."""
    upto = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=upto[1:])
    return upto[end] - upto[start]


def keys(words: list[str], replaced: Scheme = REPLACED, inserted: Scheme = INSERTED) -> list[tuple[int, np.ndarray]]:
    """(role, a 64-bit key a word) of every signature.

    Role 2 meets itself: words of one length. Role 0, as the shorter word, meets
    role 1, as the longer one.
    """
    length = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    end = np.cumsum(length)
    start = end - length
    dimension, hashed = hashes(points, length)
    # hashes of letters at their place count from the left, or from the right
    ahead = np.arange(len(points)) - np.repeat(start, length)
    from_left = mix(mix(points.astype(U)) + ahead.astype(U))
    from_right = mix(mix(points.astype(U) + U(1)) + (np.repeat(length, length) - ahead).astype(U))
    out = []
    for scheme, roles in ((replaced, (2,)), (inserted, (0, 1))):
        subpart = (mix(dimension + U(scheme.k)) % U(scheme.outer * scheme.inner)).astype(np.int64)
        share = [sums(np.where(subpart == k, hashed, U(0)), start, end) for k in range(scheme.outer * scheme.inner)]
        for number, (part, kept) in enumerate(scheme.signatures()):
            letters = np.zeros(len(words), U)
            for k in kept:
                letters += share[part * scheme.inner + k]
            for role in roles:
                shorter = length - (role == 1)
                first = shorter // 2
                head = sums(from_left, start, start + first)
                tail = sums(from_right, end - (shorter - first), end)
                for half, text in enumerate((head, tail)):
                    label = U(((scheme.k * 1000 + number) * 2 + half) * 100_000)
                    out.append((role, mix(mix(letters + label) + mix(text ^ shorter.astype(U)))))
    return out


SIGNATURES = pa.schema([("key", pa.int64()), ("role", pa.int8()), ("word", pa.string()), ("n", pa.int64())])


def signatures(words: DataFrame, replaced: Scheme = REPLACED, inserted: Scheme = INSERTED) -> DataFrame:
    """(key, role, word, n): the signatures of every word."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for role, key in keys(batch.column(0).to_pylist(), replaced, inserted):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), role, np.int8)), batch.column(0), batch.column(1)], schema=SIGNATURES)

    return words.select("word", "n").mapInArrow(run, "key long, role byte, word string, n long")


def near_words(words: DataFrame, replaced: Scheme = REPLACED, inserted: Scheme = INSERTED) -> DataFrame:
    """(word, other, n_word, n_other): each pair of words one edit apart, in both directions, once."""
    every = signatures(words, replaced, inserted)
    a = every.where("role <> 1").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = every.where("role <> 0").select("key", "role", F.col("word").alias("b"), F.col("n").alias("n_b"))
    one_edit = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    # words of one length meet in both orders, one of which is enough; Spark would take the 24 signatures of a word for one row
    met = a.join(b.hint("merge"), (a["key"] == b["key"]) & ((b["role"] == 1) | (F.col("a") < F.col("b"))) & one_edit)
    pair = met.select("a", "b", "n_a", "n_b").distinct()
    ends = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_a").alias("n_word"), F.col("n_b").alias("n_other")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_b").alias("n_word"), F.col("n_a").alias("n_other")),
    )
    return pair.select(F.inline(ends))


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) with ``root``: the last word of the links from word to form.

    Each round every open link is replaced by the link of its target, so that its
    length doubles. A link leads to a word of at least twice the count, so links
    have no cycles and at most 64 steps. All words are on both sides of each join, so
    that neither is broadcast, however small their files are.
    """
    now = materialize(forms.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNotNull().alias("open")), "roots")
    for _ in range(MOST_ROUNDS):
        if now.where("open").isEmpty():
            break
        target = now.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("open").alias("on"))
        moved = now.where("open").join(target.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.coalesce("on", F.lit(False)).alias("open"))
        last, now = now, materialize(now.where("not open").unionByName(moved), "roots")
        discard(last)
    return forms.join(now.select("word", "root").hint("merge"), "word")


def spelling_variants(documents: DataFrame, least_letters: int = 5, least_count: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every counted word, how many words are near, and what it is a variant of.

    A word's form is its near word of the largest count, if that is at least
    ``ratio`` times its own; its root is where the links from word to form end.
    """
    words = materialize(counted_words(documents, least_letters, least_count, id_col, text_col), "words")
    best = F.min_by(F.struct("other", "n_other"), F.struct(-F.col("n_other"), F.col("other")))
    near = near_words(words).groupBy(F.col("word").alias("w")).agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near.hint("merge"), words["word"] == near["w"], "left")
    counts = F.col("best.n_other") >= ratio * F.col("n")
    forms = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(counts, F.col("best.other")).alias("form"), F.when(counts, F.col("best.n_other")).alias("form_n")
    )
    return with_roots(materialize(forms, "forms")).select("word", "form", "root", "n", "n_near", "form_n")
