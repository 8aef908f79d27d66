"""Benchmark decontamination by a BM25 index of test items and block-max WAND.

Method: test items are indexed by their words; the BM25 weight of a word in an item
is divided by the item's score for itself, so that one threshold fits all items.
Every document is cut into passages of twice the longest item, half overlapping, so
that each item-long stretch lies whole in one. Every passage is a query. Sums of
block maxima of the rarer words first tell, for all passages of a batch at once, in
which block of items one may reach the threshold (a cell); block-max WAND then goes
on from cell to cell: the maxima of all words of the passage in that block leave
most cells out, and the items of the others are scored. A retrieved item counts when both its question and its answer share
enough words with the passage, in runs of ``length`` words. Words are named by
64-bit hashes.

Size. Numbers of documents, document frequencies, mean and longest item are taken by
Spark over all items, whatever the groups. Items are dealt into groups whose index
has at most GROUP_BYTES (36 bytes a word); each group is broadcast for a pass of its
own over the documents. Results, scores included, do not depend on the groups.

Defined results: items without words or id are skipped, as are documents without
words; an item without question and answer columns is halved, the first half being
the question; parts shorter than a run use the whole item as run; one row for each
pair of document and item (repeated rows repeat it); empty tables give empty
tables. ``clean`` judges every row by its own text, with or without id. Only ids and
texts are read.
"""

from __future__ import annotations

from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placelens.llm.packed import U, byte_texts, mix, runs, sliced, word_hashes
from placelens.scratch import materialize

THRESHOLD = 0.6
OVERLAP = 0.5
RUN = 5
K1, B = 1.2, 0.75
BLOCK = 4
#: Share of the threshold that the words left out of the first bound may bring together.
ESSENTIAL = 0.9
#: Entries of a bound or score that are held at once.
HELD = 2_000_000
GROUP_BYTES = 64_000_000
WORD_BYTES = 36


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, size many."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def chunks(of: np.ndarray, sizes: np.ndarray):
    """Ranges of entries whose sizes add up to HELD or little more; those of one name (sorted) stay together."""
    ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)) if len(of) else np.zeros(0, np.int64)
    done = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(of):
        k = int(np.searchsorted(done[ends], done[a] + HELD))
        b = int(ends[min(k, len(ends) - 1)])
        yield a, b
        a = b


class Index:
    """Inverted index of items in flat arrays: postings sorted by item, in blocks of items with their maxima.

    ``items`` has (id, words, words of the question, distinct words, their document
    frequencies); ``n``, ``mean`` and ``longest`` are of all items, not of these alone.
    """

    def __init__(self, items: list[tuple], n: int, mean: float, longest: int, threshold: float, overlap: float, run: int) -> None:
        self.threshold, self.overlap, self.run, self.longest = threshold, overlap, run, max(1, longest)
        self.ids = [i[0] for i in items]
        self.words = [i[1] for i in items]
        self.question = [i[2] for i in items]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.width = np.minimum(run, self.size)
        own_runs = [run_hashes(w, int(k)) for w, k in zip(self.words, self.width)]
        self.runs = np.concatenate([np.zeros(0, U), *own_runs])
        self.run_start = np.cumsum([0, *(len(r) for r in own_runs)])
        term, item, score, frequency = [np.zeros(0, U)], [np.zeros(0, np.int32)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for k, (_, words, _, distinct, df) in enumerate(items):
            order = np.argsort(distinct)
            distinct, df = distinct[order], df[order]
            count = np.bincount(np.searchsorted(distinct, words), minlength=len(distinct))
            own = np.log(1 + (n - df + 0.5) / (df + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * len(words) / mean))
            term.append(distinct)
            item.append(np.full(len(distinct), k, np.int32))
            score.append(own / fsum(own))
            frequency.append(df)
        term, item, score, frequency = (np.concatenate(x) for x in (term, item, score, frequency))
        # rarest words first
        order = np.lexsort((item, term, frequency))
        term, self.item, self.score = term[order], item[order], score[order]
        at = runs(term)
        self.start = np.append(at, len(term))
        self.by_hash = np.argsort(term[at])
        self.hashes = term[at][self.by_hash]
        number = np.repeat(np.arange(len(at)), np.diff(self.start))
        block = runs(number, self.item // BLOCK)
        self.block = self.item[block] // BLOCK
        self.block_bound = np.maximum.reduceat(self.score, block) if len(block) else self.score
        self.block_start = np.searchsorted(block, self.start)
        self.block_item = np.append(block, len(self.item))
        self.block_key = number[block] * max(1, -(-len(items) // BLOCK)) + self.block
        # of each item the most common words, as many as cannot bring ESSENTIAL of the threshold together, are left out of
        # the first bound; what they may bring is added whole
        self.blocks = -(-len(items) // BLOCK)
        order = np.lexsort((-number, self.item))
        heads = runs(self.item[order])
        gone = np.cumsum(self.score[order])
        gone -= np.repeat(gone[heads] - self.score[order][heads], np.diff(np.append(heads, len(order))))
        left_out = np.zeros(len(order), bool)
        left_out[order] = gone <= threshold * ESSENTIAL
        common = np.bincount(self.item[left_out], self.score[left_out], self.blocks * BLOCK)
        self.common = common.reshape(self.blocks, BLOCK).max(axis=1) if self.blocks else common
        number, item, score = number[~left_out], self.item[~left_out], self.score[~left_out]
        block = runs(number, item // BLOCK)
        self.first_block = item[block] // BLOCK
        self.first_bound = np.maximum.reduceat(score, block) if len(block) else score
        self.first_start = np.searchsorted(number[block], np.arange(len(at) + 1))

    def terms_of(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the words that are terms; -1 for others."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.by_hash[at], -1)

    def promising(self, of: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Cells (passage * blocks + block) in which the block maxima reach the threshold; a pair for each distinct word of a passage."""
        n = self.first_start[term + 1] - self.first_start[term]
        out = [np.zeros(0, np.int64)]
        for a, b in chunks(of, n):
            at = spans(self.first_start[term[a:b]], n[a:b])
            cell, inverse = np.unique(np.repeat(of[a:b], n[a:b]) * self.blocks + self.first_block[at], return_inverse=True)
            total = np.bincount(inverse, self.first_bound[at], len(cell)) + self.common[cell % self.blocks]
            out.append(cell[total >= self.threshold - 1e-9])
        return np.concatenate(out)

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) of one passage's distinct terms with at least the threshold."""
        term = np.unique(np.array(terms, np.int64))
        return [x[1:] for x in self.retrieve_all(np.zeros(len(term), np.int64), term)]

    def retrieve_all(self, of: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float]]:
        """Block-max WAND: all (passage, item, score) with at least the threshold; a pair for each distinct word of a passage, sorted."""
        least, out = self.threshold - 1e-9, []
        cells = self.promising(of, term)
        first = np.searchsorted(of, cells // self.blocks)
        n = np.searchsorted(of, cells // self.blocks, "right") - first
        for a, b in chunks(np.arange(len(cells)), n):
            which = np.repeat(np.arange(a, b), n[a:b])
            key = term[spans(first[a:b], n[a:b])] * self.blocks + cells[which] % self.blocks
            at = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            met = self.block_key[at] == key
            which, at = which[met], at[met]
            bound = np.bincount(which - a, self.block_bound[at], b - a)
            good = bound[which - a] >= least
            which, at = which[good], at[good]
            size = self.block_item[at + 1] - self.block_item[at]
            place = spans(self.block_item[at], size)
            slot = np.repeat(which - a, size) * BLOCK + self.item[place] % BLOCK
            total = np.bincount(slot, self.score[place], (b - a) * BLOCK)
            won = total[slot] >= least - 1e-9
            slot, place = slot[won], place[won]
            order = np.argsort(slot, kind="stable")
            slot, place = slot[order], place[order]
            ends = np.append(runs(slot), len(slot))
            for x, y in zip(ends[:-1], ends[1:]):
                score = fsum(self.score[place[x:y]])
                if score >= least:
                    out.append((int(cells[a + slot[x] // BLOCK] // self.blocks), int(self.item[place[x]]), score))
        return out

    def overlaps(self, items: np.ndarray, begin: np.ndarray, end: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of each item's question and answer words in runs that its passage, flat[begin:end], has too; sorted by begin."""
        out = np.ones((2, len(items)))
        for k in np.unique(self.width[items]).tolist():
            mine = np.flatnonzero(self.width[items] == k)
            hashes = run_hashes(flat, k)
            for x, y in chunks(begin[mine], self.size[items[mine]] + end[mine] - begin[mine]):
                pair = mine[x:y]
                item, passage = items[pair], np.unique(begin[pair], return_inverse=True)[1]
                one = np.append(runs(begin[pair]), len(pair))[:-1]
                n = np.maximum(0, end[pair][one] - begin[pair][one] - k + 1)
                held = np.sort(marked(hashes[spans(begin[pair][one], n)], np.repeat(np.arange(len(one)), n)))
                size = self.size[item]
                asked = self.runs[spans(self.run_start[item], size - k + 1)]
                key = marked(asked, np.repeat(passage, size - k + 1))
                at = np.minimum(np.searchsorted(held, key), max(0, len(held) - 1))
                shared = held[at] == key if len(held) else np.zeros(len(key), bool)
                word = np.cumsum(size) - size
                start = spans(word, size - k + 1)[shared]
                cover = np.bincount(start, minlength=size.sum() + 1) - np.bincount(start + k, minlength=size.sum() + 1)
                done = np.append(0, np.cumsum(np.cumsum(cover)[:-1] > 0))
                middle = word + np.array(self.question)[item]
                for which, a, b in ((0, word, middle), (1, middle, word + size)):
                    out[which, pair] = np.where(b > a, (done[b] - done[a]) / np.maximum(1, b - a), 1.0)
        return out[0], out[1]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of all contaminated texts."""
        step = self.longest
        words = [word_hashes(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate([np.zeros(0, U), *words])
        terms = self.terms_of(flat)
        passages = np.maximum(1, -(-sizes // step))
        first = np.cumsum(passages) - passages
        within = spans(np.zeros(len(sizes), np.int64), sizes)
        late = np.repeat(first, sizes) + within // step
        early = late[within >= step] - 1
        passage, term = np.concatenate([late, early]), np.concatenate([terms, terms[within >= step]])
        many = len(self.hashes) + 1
        pair = np.unique(passage[term >= 0] * many + term[term >= 0])
        begin = np.cumsum(sizes) - sizes
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        found = sorted(self.retrieve_all(pair // many, pair % many))
        p, items = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        text = np.searchsorted(first, p, "right") - 1
        a = begin[text] + (p - first[text]) * step
        b = np.minimum(a + 2 * step, begin[text] + sizes[text])
        for t, item, x, q, r in zip(text.tolist(), items.tolist(), found, *(v.tolist() for v in self.overlaps(items, a, b, flat))):
            if q >= self.overlap and r >= self.overlap:
                best[t, item] = max(best.get((t, item), (0.0, 0.0, 0.0)), (x[2], q, r))
        return [(text, self.ids[item], *x) for (text, item), x in sorted(best.items())]


def marked(hashes: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """Hashes that tell in which passage a run stands."""
    return mix(hashes + (passage.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, k, U)
    for j in range(k):
        h = h * U(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix(h)


def halved(benchmark: DataFrame) -> DataFrame:
    """(item_id, question, answer) as bytes; an item with a text only is halved by words."""
    if {"question", "answer"} <= set(benchmark.columns):
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("question", "answer")]
        return benchmark.select(F.col("item_id").cast("long").alias("item_id"), *parts)
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    half = ((F.size("words") + 1) / 2).cast("int")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words.alias("words"))
    join = lambda a: F.array_join(a, " ").cast("binary")
    return items.select("item_id", join(F.slice("words", F.lit(1), half)).alias("question"), join(F.slice("words", half + 1, F.size("words"))).alias("answer"))


def indexed(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, n_question, terms): the distinct items, each distinct word with its document frequency."""
    items = halved(benchmark).where("item_id is not null").distinct()

    def hashed(batches):
        for batch in batches:
            question, answer = (batch.column(k).to_pylist() for k in (1, 2))
            words = [word_hashes(q + b" " + a).view(np.int64).tolist() for q, a in zip(question, answer)]
            asked = [len(q.split()) for q in question]
            names = [f"{mix(np.array([hash_of(q), hash_of(a)], U)).tolist()}" for q, a in zip(question, answer)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(words, pa.list_(pa.int64())), pa.array(asked, pa.int32())], ["item_id", "name", "words", "n_question"])

    rows = items.mapInArrow(hashed, "item_id long, name string, words array<long>, n_question int").where(F.size("words") > 0)
    term = rows.select("item_id", "name", F.explode(F.array_distinct("words")).alias("word"))
    frequency = term.groupBy("word").agg(F.count("*").alias("df"))
    terms = term.join(frequency, "word").groupBy("item_id", "name").agg(F.collect_list(F.struct("word", "df")).alias("terms"))
    return rows.join(terms, ["item_id", "name"]).select("item_id", "name", "words", "n_question", "terms")


def hash_of(text: bytes) -> int:
    return int(mix(np.append(word_hashes(text), U(len(text)))).sum(dtype=U))


def indexes(benchmark: DataFrame, threshold: float, overlap: float, run: int, group_bytes: int):
    """The broadcast index of each group of items."""
    spark = benchmark.sparkSession
    items = materialize(indexed(benchmark), "items")
    n, total, longest = items.agg(F.count("*"), F.sum(F.size("words")), F.max(F.size("words"))).first()
    groups = -(-(total or 0) * WORD_BYTES // group_bytes) or 1
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).orderBy("item_id", "name").collect()
        unpack = lambda x: np.array(x, np.int64).view(U)
        found = [(r.item_id, unpack(r.words), r.n_question, unpack([t.word for t in r.terms]), np.array([t.df for t in r.terms], np.int64)) for r in rows]
        yield spark.sparkContext.broadcast(Index(found, n, (total or 0) / max(1, n), longest or 1, threshold, overlap, run))


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, run: int = RUN, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of documents that hold a test item."""
    texts = byte_texts(documents)
    out = None
    for index in indexes(benchmark, threshold, overlap, run, group_bytes):
        found = texts.mapInArrow(_searcher(index), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(index):
    def run(batches):
        names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
        for batch in batches:
            for ids, texts in sliced(batch):
                if not index.value.ids:
                    continue
                rows = index.value.search(texts)
                docs = ids.take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([docs, pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4))], names)

    return run


def clean(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, run: int = RUN, group_bytes: int = GROUP_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, with all of their columns, whose text holds no test item."""
    at = documents.columns.index(text_col)
    out = documents
    for index in indexes(benchmark, threshold, overlap, run, group_bytes):

        def kept(batches, index=index):
            for batch in batches:
                texts = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), pa.compute.fill_null(batch.column(at), "").cast(pa.binary())], ["row", "text"])
                for rows, part in sliced(texts):
                    keep = np.ones(len(part), bool)
                    if index.value.ids:
                        keep[[r[0] for r in index.value.search(part)]] = False
                    yield batch.slice(rows[0].as_py(), len(part)).filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(kept, documents.schema)
    return out
