"""Hashed words, and arrays packed into few rows on their way through a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, functions as F

MEMO = 200_000
U = np.uint64


class Words(dict):
    """64-bit hashes of words; remembers the first it meets."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO and len(word) < 64:
            self[word] = found
        return found

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of a text's words, A-Z lower-cased, in order."""
        words = text.lower().split()  # ASCII only, at blanks and \\x09-\\x0D
        return np.fromiter(map(self.__getitem__, words), U, len(words))


_words = Words()


def word_hashes(text: bytes) -> np.ndarray:
    return _words.of(text)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary): null texts become empty."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def sliced(batch: pa.RecordBatch, most: int = 4_000_000):
    """Parts of a batch of (id, text binary), of about ``most`` bytes each: ids (null: None) and texts."""
    sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
    start = total = 0
    for k, n in enumerate([*sizes, most + 1]):
        if k > start and total + n > most:
            yield batch.column(0).slice(start, k - start), batch.column(1).slice(start, k - start).to_pylist()
            start, total = k, 0
        total += n


def deal(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by part, and the bounds of each part in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def by_part(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of ``part`` 0 to parts - 1, each part in a partition of its own."""
    return rows.repartitionById(parts, F.col("part"))
