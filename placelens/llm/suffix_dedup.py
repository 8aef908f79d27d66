"""Removal of repeated byte strings by sparse distributed prefix doubling.

Method: suffixes are ranked by growing prefixes and dropped from the work as soon
as their rank is unique. Equal prefixes get equal names (fingerprints) instead of
dense integer ranks, so a rank pair at an offset is computed in place and Spark
only sorts and groups. Three rounds reach the threshold:

1. SEED bytes, at sampled suffixes: in every string of ``length`` bytes the place
   whose SEED bytes have the smallest hash, the leftmost of equals, is its anchor.
   Equal strings have equal anchors, so suffixes with a unique anchor are done.
2. The stretch of text that all strings of one anchor cover (100 to 160 bytes).
   Where a stretch repeats, all strings of the later ones start earlier too.
3. Exactly ``length`` bytes, for the first of each stretch where an anchor has
   several different ones: these are the ends of repeated passages.

The first occurrence of a string always lies in the first one of its stretch, so
nothing is lost. Names count only among equal anchors, so they have 128 bits.

Hot groups: names are dealt by hash; the members of one anchor are sorted as
packed numbers (25 bytes each, 8 for each place in round 3), never expanded into pairs.

Defined results: a null text is empty; texts shorter than the string keep all
bytes; rows of equal doc_id and equal text are one document, their results are
equal; a null doc_id counts as the smallest; an empty table gives an empty table.
Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from placelens.llm.packed import U, by_part, byte_texts, deal, mix, runs, sliced
from placelens.scratch import materialize, partitions

LENGTH = 100
SEED = 40
LEAST = -(1 << 63)

_random = np.random.default_rng(20240229)
_tables = [(_random.integers(0, 1 << 63, 256).astype(U) * U(2) + U(1), int(_random.integers(1 << 61, 1 << 63)) * 2 + 1) for _ in range(2)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash's base and of its inverse, at least n of them."""
    if which not in _powers or len(_powers[which][0]) < n:
        m = max(1 << 16, 2 * n)
        base = _tables[which][1] % (1 << 64)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(m, b, U)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[which] = tuple(both)
    return _powers[which]


class Prefixes:
    """Fingerprints of any substring of a text in constant time."""

    def __init__(self, text: np.ndarray, which: int) -> None:
        up, self.down = _power(which, len(text) + 1)
        self.sums = np.zeros(len(text) + 1, U)
        np.cumsum(_tables[which][0][text] * up[: len(text)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def anchors(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` seeds, the leftmost place of its smallest."""
    value, place, w = seeds, np.arange(len(seeds), dtype=np.int32), 1
    while w < width:
        step = min(w, width - w)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        w += step
    return place


def keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, text binary, doc): doc has no nulls."""
    return byte_texts(documents).withColumn("doc", F.coalesce("doc_id", F.lit(LEAST).cast("long"))).select("doc", "text", "doc_id")


def text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


PACKED = "part int, docs binary, counts binary, places binary, names binary"


def packed_rows(docs: np.ndarray, owner: np.ndarray, places: np.ndarray, names: np.ndarray, parts: int):
    """Rows of PACKED: docs (doc, text key), then for each doc its places and names; dealt by the first name."""
    order, bounds = deal((names[:, 0] % U(parts)).astype(np.int64), parts)
    out = []
    for p in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[p] : bounds[p + 1]]
        used, counts = np.unique(owner[at], return_counts=True)
        out.append((int(p), docs[used].tobytes(), counts.astype(np.int32).tobytes(), places[at].tobytes(), names[at].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in range(1, 5))], ["part", "docs", "counts", "places", "names"])


def unpacked(batches, width: int = 2):
    """All of a part: docs, the doc of each place, places (start, count), names."""
    docs, counts, places, names = [], [], [], []
    for batch in batches:
        for d, c, p, n in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            docs.append(np.frombuffer(d, np.int64).reshape(-1, 2))
            counts.append(np.frombuffer(c, np.int32))
            places.append(np.frombuffer(p, PLACE))
            names.append(np.frombuffer(n, U).reshape(-1, width))
    if not docs:
        return None
    docs = np.concatenate(docs)
    return docs, np.repeat(np.arange(len(docs), dtype=np.int32), np.concatenate(counts)), np.concatenate(places), np.concatenate(names)


#: A start, and how many starts more belong to it.
PLACE = np.dtype([("start", "<i4"), ("more", "u1")])
SPANS = "doc long, text_key long, kind int, starts array<int>, ends array<int>, anchors array<long>"


def span_rows(kind: int, docs: np.ndarray, owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of SPANS; owner must be sorted."""
    at = runs(owner)
    offsets = pa.array(np.append(at, len(owner)).astype(np.int32))
    d = docs[owner[at]] if len(at) else docs[:0]
    arrays = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (starts, ends)]
    arrays.append(pa.nulls(len(at), pa.list_(pa.int64())) if names is None else pa.ListArray.from_arrays(offsets, pa.array(names.view(np.int64))))
    return pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.full(len(at), kind, np.int32)), *arrays], ["doc", "text_key", "kind", "starts", "ends", "anchors"])


def sampled(documents: DataFrame, length: int, seed: int, parts: int) -> DataFrame:
    """Rounds 1 and 2: the names of each anchor and its stretch."""

    def run(batches):
        for batch in batches:
            for ids, texts in sliced(batch, 4_000_000):
                docs, owner, places, names = [], [], [], []
                for doc, text in zip(ids.to_pylist(), texts):
                    if len(text) < length:
                        continue
                    raw = np.frombuffer(text, np.uint8)
                    seeds = Prefixes(raw, 0).all(seed)
                    anchor = anchors(seeds, length - seed + 1)
                    first = runs(anchor)
                    a, last = anchor[first], np.append(first[1:], len(anchor)) - 1
                    stretch = Prefixes(raw, 1).of(first, last + length)
                    p = np.empty(len(first), PLACE)
                    p["start"], p["more"] = first, last - first
                    names.append(np.stack([seeds[a], mix(stretch ^ mix(((last - first) * 1024 + (a - first)).astype(U)))], axis=1))
                    places.append(p)
                    owner.append(np.full(len(first), len(docs), np.int32))
                    docs.append((doc, text_key(text)))
                if docs:
                    yield packed_rows(np.array(docs, np.int64), np.concatenate(owner), np.concatenate(places), np.concatenate(names), parts)

    return by_part(keyed(documents).select("doc", "text").mapInArrow(run, PACKED), parts)


def repeated(packed: DataFrame, length: int) -> DataFrame:
    """Spans (kind 0) of the stretches that repeat earlier ones.

    The stretches that are first of several under one anchor are told as well
    (kind 1: first and last start, and the anchor's name).
    """

    def run(batches):
        found = unpacked(batches)
        if found is None:
            return
        docs, owner, places, names = found
        order = np.argsort(names[:, 0], kind="stable")
        key = names[order, 0]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        order = order[same]
        doc = docs[owner[order], 0]
        order = order[np.lexsort((places["start"][order], doc, names[order, 1], names[order, 0]))]
        doc, start = docs[owner[order], 0], places["start"][order]
        end = start.astype(np.int64) + places["more"][order] + length
        group = runs(names[order, 0], names[order, 1])
        head = np.repeat(group, np.diff(np.append(group, len(order))))
        later = (doc != doc[head]) | (start != start[head])
        by = np.flatnonzero(later)
        by = by[np.lexsort((start[by], owner[order[by]]))]
        yield span_rows(0, docs, owner[order[by]], start[by], end[by])
        if len(order):
            anchor = runs(names[order, 0])
            several = np.zeros(len(order), np.int64)
            several[group] = 1
            count = np.add.reduceat(several, anchor)
            by = np.flatnonzero(~later & (np.repeat(count, np.diff(np.append(anchor, len(order)))) > 1))
            by = by[np.lexsort((start[by], owner[order[by]]))]
            yield span_rows(1, docs, owner[order[by]], start[by], end[by] - length, names[order[by], 0].copy())

    return packed.mapInArrow(run, SPANS)


def exact(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """Round 3: names of the strings that start in each wanted range; (doc, text, starts, ends, anchors) come in."""

    def run(batches):
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
            for a, b in _ranges(sizes, 2_000_000):
                docs, owner, places, names, grams = [], [], [], [], []
                for doc, text, starts, ends, anchor in zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(5))):
                    lo, hi = np.array(starts, np.int64), np.array(ends, np.int64)
                    q = spread(lo, hi - lo + 1)
                    p = np.empty(len(lo), PLACE)
                    p["start"], p["more"] = lo, hi - lo
                    grams.append(Prefixes(np.frombuffer(text, np.uint8), 1).of(q, q + length))
                    names.append(np.array(anchor, np.int64).view(U))
                    places.append(p)
                    owner.append(np.full(len(lo), len(docs), np.int32))
                    docs.append((doc, text_key(text)))
                if not docs:
                    continue
                docs, owner, places, names, grams = np.array(docs, np.int64), *(np.concatenate(x) for x in (owner, places, names, grams))
                first = np.append(0, np.cumsum(places["more"].astype(np.int64) + 1))
                order, bounds = deal((names % U(parts)).astype(np.int64), parts)
                out = []
                for k in np.flatnonzero(np.diff(bounds)):
                    at = order[bounds[k] : bounds[k + 1]]
                    used, counts = np.unique(owner[at], return_counts=True)
                    own = grams[spread(first[at], first[at + 1] - first[at])]
                    out.append((int(k), docs[used].tobytes(), counts.astype(np.int32).tobytes(), places[at].tobytes(), names[at].tobytes(), own.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in range(1, 6))], ["part", "docs", "counts", "places", "names", "grams"])

    def first_of_all(batches):
        grams = []

        def noted():
            for batch in batches:
                grams.extend(np.frombuffer(x, U) for x in batch.column(5).to_pylist())
                yield batch

        found = unpacked(noted(), 1)
        if found is None:
            return
        docs, owner, places, names = found
        n = places["more"].astype(np.int64) + 1
        start, of = spread(places["start"].astype(np.int64), n), np.repeat(np.arange(len(n)), n)
        name, gram, doc = names[of, 0], np.concatenate(grams), docs[owner[of], 0]
        order = np.lexsort((start, doc, gram, name))
        group = runs(name[order], gram[order])
        head = order[np.repeat(group, np.diff(np.append(group, len(order))))]
        by = order[(doc[order] != doc[head]) | (start[order] != start[head])]
        by = by[np.lexsort((start[by], owner[of[by]]))]
        # neighbouring starts make one span
        mine = owner[of[by]]
        new = runs(mine, start[by] - np.arange(len(by)))
        last = np.append(new[1:], len(by)) - 1 if len(by) else new
        yield span_rows(0, docs, mine[new], start[by[new]], start[by[last]] + length)

    packed = by_part(texts.mapInArrow(run, PACKED + ", grams binary"), parts)
    return packed.mapInArrow(first_of_all, SPANS)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n of each."""
    return np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def _ranges(sizes: list[int], most: int):
    start = total = 0
    for k, n in enumerate([*sizes, most + 1]):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def repeated_spans(documents: DataFrame, length: int = LENGTH, seed: int = SEED, parts: int | None = None) -> DataFrame:
    """(doc, text_key, starts, ends): byte spans whose strings start earlier, per distinct row."""
    parts = parts or partitions(documents.sparkSession)
    rough = materialize(repeated(sampled(documents, length, seed, parts), length), "stretches")
    wanted = gathered(rough.where("kind = 1"))
    fine = materialize(exact(_with_text(documents, wanted), length, parts), "strings")
    return gathered(rough.where("kind = 0").unionByName(fine))


def gathered(spans: DataFrame) -> DataFrame:
    """One row per doc and text: its spans, which a text's length bounds."""
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return spans.groupBy("doc", "text_key").agg(flat("starts"), flat("ends"), flat("anchors"))


def _with_text(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, text, starts, ends, anchors) of the rows that spans tell of, each distinct row once."""

    def run(batches):
        for batch in batches:
            keep = [text_key(t) == k for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield part.select(["doc", "text", "starts", "ends", "anchors"])

    joined = keyed(documents).select("doc", "text").join(spans, "doc").select("doc", "text", "text_key", "starts", "ends", "anchors")
    return joined.mapInArrow(run, "doc long, text binary, starts array<int>, ends array<int>, anchors array<long>")


def remove_repeats(documents: DataFrame, length: int = LENGTH, seed: int = SEED, parts: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, starts, ends): one row per input row.

    Every byte covered by a string of ``length`` bytes that also starts earlier
    (smaller doc_id, or the same and an earlier start) is removed.
    """
    spans = repeated_spans(documents, length, seed, parts)
    per_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("text_key", "starts", "ends")).alias("found"))

    def run(batches):
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
            for a, b in _ranges(sizes, 4_000_000):
                part = batch.slice(a, b - a)
                rows = []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    own, k = [], text_key(text) if found else 0
                    for x in found or ():
                        if x["text_key"] == k:
                            own = merged(x["starts"], x["ends"])
                    kept, at = [], 0
                    for s, e in own:
                        kept.append(text[at:s])
                        at = e
                    kept.append(text[at:])
                    rows.append((len(text), sum(e - s for s, e in own), len(own), b"".join(kept), [s for s, _ in own], [e for _, e in own]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "starts", "ends"])

    joined = keyed(documents).join(per_doc, "doc", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<int>, ends array<int>")
