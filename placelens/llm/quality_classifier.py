"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Method: a text is a bag of terms: hashed words, word shapes, pairs of adjoining
shapes, repeats of the word before, and its length. Weights are log counts times
inverse document frequency; each family of terms has unit length. A truncated
singular value decomposition of labelled texts gives the latent space. The latent
vectors of the labelled texts are broadcast; every document is compared with all of
them by blocked cosine products, and its nearest neighbours vote for their labels
with their similarity.

The fit uses at most ``sample`` labelled rows, those of smallest hash of the id. Their
terms are counted in the workers, so that the driver gets sample * 1824 numbers at
most, whatever the texts' lengths, and broadcasts sample * rank numbers of 8 bytes
(3 MB by default) and the projection. Scores, in contrast, cover every whole text.

Ties. Cosines are taken in double precision and rounded to nine places; of neighbours
at the same distance those of smaller doc_id vote.

Defined results: null and empty texts are texts without terms and get the share of
label 1 among the fitted rows; so does everything when no label is known (then 0.5);
where a doc_id has several labels the largest counts; rows are kept one to one; rows
with a null id are never held out and never fitted. Only ids, texts and the labels'
doc_id and quality are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from placelens.llm.packed import byte_texts, sliced

SAMPLE = 6000
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 8.0
THRESHOLD = 0.3
FOLDS = 5
MEMO = 100_000
#: Rows that are scaled at once, so that no second table of the fitted rows stands in the driver.
STRIP = 256
#: Buckets of each family of terms: words, shapes, pairs of shapes, repeats and sizes.
FAMILIES = (1024, 256, 512, 32)
#: Lengths of the families' parts of a text's vector.
WEIGHTS = (0.4, 1.0, 1.0, 1.0)
_CLASSES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"))


def shape(word: bytes) -> bytes:
    """A word with runs of small letters, capitals and digits as one sign each; marks stay."""
    for pattern, sign in _CLASSES:
        word = pattern.sub(sign, word) if pattern is not _CLASSES[1][0] else pattern.sub(lambda m: b"A" if len(m[0]) == 1 else b"AA", word)
    return word[:12]


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh32_intdigest(word.lower()) | (xxhash.xxh32_intdigest(shape(word)) % FAMILIES[1]) << 32
        if len(self) < MEMO and len(word) < 64:
            self[word] = found
        return found


_terms = _Terms()


def counts(text: bytes) -> np.ndarray:
    """Term counts of a text, the families one after another."""
    words = text.split()
    both = np.fromiter(map(_terms.__getitem__, words), np.int64, len(words))
    word, form = both & 0xFFFFFFFF, both >> 32
    pair = (form[:-1] * 1009 + form[1:]) % FAMILIES[2]
    repeats = np.zeros(FAMILIES[3])
    if len(words):
        repeats[0] = (word[1:] == word[:-1]).sum() * 4.0
        repeats[1] = len(words) - repeats[0] / 4.0
        repeats[2 + min(15, int(np.log2(len(words))))] = 0.3 * len(words)
    return np.concatenate([np.bincount(word % FAMILIES[0], minlength=FAMILIES[0]), np.bincount(form, minlength=FAMILIES[1]), np.bincount(pair, minlength=FAMILIES[2]), repeats])


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts times idf, each family scaled to its weight."""
    x = np.log1p(rows)
    x *= idf
    at = 0
    for n, weight in zip(FAMILIES, WEIGHTS):
        for first in range(0, len(x), STRIP):
            part = x[first : first + STRIP, at : at + n]
            part *= weight / np.maximum(np.sqrt((part * part).sum(axis=1, keepdims=True)), 1e-12)
        at += n
    return x


class Model:
    """Latent vectors of labelled texts, and the way there."""

    def __init__(self, rows: np.ndarray, labels: list[int], rank: int = RANK, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> None:
        """``rows`` are term counts of the labelled texts, by doc_id."""
        self.neighbours, self.sharpness = neighbours, sharpness
        self.labels = np.array(labels, float)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(rows)) / (1 + np.count_nonzero(rows, axis=0))) + 0.2
        x = weighted(rows, self.idf)
        rank = min(rank, *x.shape)
        # randomised range finder: a few power rounds suffice for the leading directions
        probe = np.random.default_rng(7).standard_normal((x.shape[1], rank + 16))
        for _ in range(4 if rank else 0):
            probe, _ = np.linalg.qr(x.T @ (x @ probe))
        _, _, vt = np.linalg.svd(x @ probe, full_matrices=False) if rank else (0, 0, np.zeros((0, probe.shape[1])))
        self.project = probe @ vt.T[:, :rank]
        self.vectors = unit(x @ self.project)

    def cosines(self, texts: list[bytes]) -> np.ndarray:
        """Of texts and labelled rows, rounded so that blocks of any size agree."""
        y = unit(weighted(np.array([counts(t) for t in texts], float), self.idf) @ self.project)
        return np.round(y @ self.vectors.T, 9)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Share of label 1 among the nearest labelled texts, weighted by similarity."""
        out = np.full(len(texts), self.prior)
        if not len(self.vectors):
            return out
        for a in range(0, len(texts), 128):
            cosine = self.cosines(texts[a : a + 128])
            near = nearest(cosine, min(self.neighbours, cosine.shape[1]))
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** self.sharpness
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[a : a + 128] = np.where(total > 1e-9, np.minimum(vote, 1.0), self.prior)
        return out


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest values of each row; of equal values the first columns, all in order of columns."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
    for row in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):
        near[row] = np.argsort(-cosine[row], kind="stable")[:k]
    return np.sort(near, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Rows that are never fitted: crc32 of the id as text, modulo the folds, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """The model of at most ``sample`` labelled rows outside the held-out fold, one an id: of its texts that of the smallest hash."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = marks.where(~held_out(F.col("doc_id"), folds)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = byte_texts(documents).join(F.broadcast(chosen), "doc_id")
    labelled = labelled.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("quality").alias("quality"))

    def run(batches):
        for batch in batches:
            found = [counts(t) for t in batch.column(1).to_pylist()]
            terms = [np.flatnonzero(x) for x in found]
            packed = [pa.array([t.astype("<i4").tobytes() for t in terms], pa.binary()), pa.array([x[t].astype("<f8").tobytes() for x, t in zip(found, terms)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), *packed], ["doc_id", "quality", "terms", "counts"])

    # counts come as bytes: as lists of numbers they take several times the table that they are written to
    rows = sorted(labelled.mapInArrow(run, "doc_id long, quality int, terms binary, counts binary").collect(), key=lambda r: r.doc_id)
    dense = np.zeros((len(rows), sum(FAMILIES)))
    for k, r in enumerate(rows):
        dense[k, np.frombuffer(r.terms, "<i4")] = np.frombuffer(r.counts, "<f8")
    marks = [r.quality for r in rows]
    del rows
    return Model(dense, marks)


def classify(documents: DataFrame, model: Model, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for ids, texts in sliced(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array(shared.value.score(texts), pa.float64())], ["doc_id", "score"])

    scored = byte_texts(documents).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(documents: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``documents``, with all of their columns, that reach the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                keep = shared.value.score([(t or "").encode() for t in part.column(at).to_pylist()]) >= threshold
                yield part.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
