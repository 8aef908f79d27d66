"""Language-model scores from a log-frequency Bloom filter.

Method: bigram counts of the training documents are quantised to powers of two and
put into a Bloom filter, level by level: a count of level j is the presence of
(bigram, 1) to (bigram, j). A count is read by probing levels until one is missing,
and stands for the mean count of its level. The probability of a word w after u is

    (q(u, w) + m * base(w)) / (c(u) + m + e),    m = strength + share * c(u)

with base the smoothed frequency of w, c(u) the count of u, q at most c(u) and c(w),
and e the mass that false positives add over the whole vocabulary (0 where c(u) is
0). With few counts of u, or none of the bigram, the word's own frequency decides.
Over all words that were seen and one unseen word the probabilities sum to 1 but for
quantisation (within 0.05 in the tests). The sum of their log10 is a text's score.

False positives. A probe of level 1 asks so many bits that the vocabulary holds about
1 / SPARE of a false bigram for each word; a part reads the size of the vocabulary
from its own share of the words, which are dealt by hash. Deeper levels ask DEEP bits.

Size. The filter and the exact word counts follow the corpus, so they are never
gathered: they consist of one part for each shuffle partition, made in the task that
sums the part's counts. Slices of texts send their distinct words and bigrams to the
parts that own them, the part's tasks hold one part each and answer by probing, and
the answers meet the slice again. Only totals reach the driver.

Words are named by 64-bit hashes, bigrams by their part and 40 bits.

Defined results: a null text is empty, its only token is the end; rows are kept one
to one and each counts; a row with a null id is not learnt from and not held out;
without training rows every token is unknown (N = V = 0). Only the id and text
columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from placelens.llm.packed import U, by_part, byte_texts, deal, mix, sliced, word_hashes
from placelens.scratch import discard, materialize, partitions

#: Words for each false bigram of one word; bits that levels above the first ask.
SPARE, DEEP = 8, 7
STRENGTH, SHARE = 10.0, 1.0
#: Levels of counts, more than any count has.
LEVELS = 64
SLICE = 8_000_000
END, START = 0x7FB5D329728EA185, 0x81DADEF4BC2DD44D
OUT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def in_training(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held, F.lit(False))


def is_held_out(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts one after another, the token before each, and the bounds of the texts."""
    parts = []
    for t in texts:
        parts += [word_hashes(t), np.array([END], U)]
    flat = np.concatenate(parts)
    bounds = np.append(0, np.cumsum([len(p) for p in parts])[1::2])
    before = np.append(np.array([START], U), flat[:-1])
    before[bounds[:-1]] = U(START)
    return flat, before, bounds


def bigram(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * U(0x9E3779B97F4A7C15) + mix(token))


def counted(names: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names and their counts."""
    if counts is None:
        return np.unique(names, return_counts=True)
    order = np.argsort(names, kind="stable")
    names, counts = names[order], counts[order]
    at = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    return names[at], np.add.reduceat(counts, at) if len(at) else counts


def levels(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def short(names: np.ndarray) -> bytes:
    """The upper 40 bits of names, 5 bytes each; the part tells more of them."""
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def longer(packed: bytes) -> np.ndarray:
    """Names as ``short`` packed them, the lower bits 0."""
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def bit(a: np.ndarray, b: np.ndarray, k: int, size: int) -> np.ndarray:
    return (((a + U(k) * b) & U(0xFFFFFFFF)) * U(size) >> U(32)).astype(np.int64)


def hashed(names: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 32 bits for each (name, level), from which its bits follow."""
    h = mix(names + U(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    return h >> U(32), (h & U(0xFFFFFFFF)) | U(1)


class Part:
    """One part of the model: its words with their exact counts, and its filter of bigrams."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, bits: np.ndarray, probes: int) -> None:
        self.words, self.counts, self.bits, self.probes = words, counts, bits, probes

    @staticmethod
    def asked(level: int, probes: int) -> int:
        return probes if level == 1 else DEEP

    @classmethod
    def made(cls, words: np.ndarray, counts: np.ndarray, names: np.ndarray, level: np.ndarray, vocabulary: int) -> Part:
        """The part of sorted words and of bigrams with their levels."""
        probes = max(DEEP, int(np.ceil(np.log2(SPARE * max(2, vocabulary)))))
        deepest = int(level.max(initial=0))
        members = [names[level >= j] for j in range(1, deepest + 1)]
        filled = sum(len(m) * cls.asked(j, probes) for j, m in enumerate(members, 1))
        size = max(64, int(filled / np.log(2)) // 64 * 64 + 64)
        bits = np.zeros(size, bool)
        for j, m in enumerate(members, 1):
            a, b = hashed(m, j)
            for k in range(cls.asked(j, probes)):
                bits[bit(a, b, k, size)] = True
        return cls(words, counts, np.packbits(bits), probes)

    def false_rate(self) -> float:
        """Share of absent bigrams that level 1 takes for present."""
        return float(np.bitwise_count(self.bits).sum() / max(1, 8 * len(self.bits))) ** self.probes

    def counts_of(self, names: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.words, names), len(self.words) - 1)
        return np.where(self.words[at] == names, self.counts[at], 0)

    def levels_of(self, names: np.ndarray) -> np.ndarray:
        """Level of each bigram, by probes of level after level; 0 where the first is missing."""
        level, left, size = np.zeros(len(names), np.uint8), np.arange(len(names)), 8 * len(self.bits)
        for j in range(1, LEVELS):
            a, b = hashed(names[left], j)
            for k in range(self.asked(j, self.probes)):
                at = bit(a, b, k, size)
                hit = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                a, b, left = a[hit], b[hit], left[hit]
            if not len(left):
                break
            level[left] = j
        return level


def count_parts(training: DataFrame, parts: int) -> DataFrame:
    """One row for each part that has counts: words, counts, bits and probes of its ``Part``, the number of its
    tokens and of its distinct words, its rate of false positives, and its bigrams and their counts by level."""

    def gather(batches):
        for batch in batches:
            for _, texts in sliced(batch, SLICE):
                flat, before, _ = tokens(texts)
                out: dict[int, list] = {}
                for kind, names in enumerate((flat, bigram(before, flat))):
                    pack = (bytes, short)[kind]
                    names, counts = counted(names)
                    once = counts == 1
                    for which, (n, c) in enumerate(((names[once], None), (names[~once], counts[~once].astype(np.uint32)))):
                        order, bounds = deal((n % U(parts)).astype(np.int64), parts)
                        for p in np.flatnonzero(np.diff(bounds)).tolist():
                            at = order[bounds[p] : bounds[p + 1]]
                            row = out.setdefault(p, [b""] * 6)
                            row[3 * kind + which] = pack(n[at])
                            if c is not None:
                                row[3 * kind + 2] = c[at].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), *(pa.array([r[k] for r in out.values()], pa.binary()) for k in range(6))], ["part", "w1", "w2", "wc", "b1", "b2", "bc"])

    def total(batches):
        got = [[[], []], [[], []]]  # names and counts of words, of bigrams
        part = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            part = columns[0][0] if columns[0] else part
            for k, unpack in enumerate((lambda x: np.frombuffer(x, U), longer)):
                for once, more, counts in zip(*columns[1 + 3 * k : 4 + 3 * k]):
                    one = unpack(once)
                    got[k][0] += [one, unpack(more)]
                    got[k][1] += [np.ones(len(one), np.uint32), np.frombuffer(counts, np.uint32)]
        if part is None:
            return
        words, counts = counted(np.concatenate(got[0][0]), np.concatenate(got[0][1]).astype(np.int64))
        got[0] = None
        names, many = counted(np.concatenate(got[1][0]), np.concatenate(got[1][1]).astype(np.int64))
        got[1] = None
        level = levels(many)
        made = Part.made(words, counts, names, level, parts * len(words))
        by_level = [np.bincount(level, w, LEVELS).astype(np.int64) for w in (None, many)]
        row = (
            pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (words, counts, made.bits)), pa.array([made.probes], pa.int32()),
            pa.array([int(counts.sum())], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([made.false_rate()]), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in by_level),
        )
        yield pa.RecordBatch.from_arrays(list(row), ["part", "words", "counts", "bits", "probes", "tokens", "distinct", "false_rate", "level_bigrams", "level_counts"])

    packed = training.mapInArrow(gather, "part int, w1 binary, w2 binary, wc binary, b1 binary, b2 binary, bc binary")
    kinds = "part int, words binary, counts binary, bits binary, probes int, tokens long, distinct long, false_rate double, level_bigrams array<long>, level_counts array<long>"
    return by_part(packed, parts).mapInArrow(total, kinds)


class Totals:
    """What all scores need of the whole model: a few numbers."""

    def __init__(self, tokens: int, distinct: int, documents: int, false_mass: float, value: np.ndarray, strength: float) -> None:
        self.tokens, self.distinct, self.documents = tokens, distinct, documents
        self.false_mass, self.value, self.strength = false_mass, value, strength

    @classmethod
    def of(cls, made: DataFrame, parts: int, documents: int, strength: float) -> Totals:
        n, distinct, rate = made.agg(F.sum("tokens"), F.sum("distinct"), F.sum("false_rate")).first()
        value = np.zeros(LEVELS)
        by_level = made.select(F.posexplode(F.arrays_zip("level_bigrams", "level_counts")).alias("level", "x")).groupBy("level")
        for level, bigrams, counts in by_level.agg(F.sum("x.level_bigrams"), F.sum("x.level_counts")).collect():
            value[level] = counts / max(1, bigrams)
        return cls(n or 0, distinct or 0, documents, (distinct or 0) * (rate or 0.0) / parts * value[1], value, strength)

    def score(self, texts: list[bytes], look) -> list[np.ndarray]:
        """n_tokens, n_known, base score and score of each text.

        ``look`` has the counts of distinct words and the levels of bigrams.
        """
        flat, before, bounds = tokens(texts)
        names, inverse = np.unique(flat, return_inverse=True)
        count, level = look(names, bigram(before, flat))
        c = count[inverse]
        of_before = np.append(0.0, c[:-1])
        of_before[bounds[:-1]] = self.documents
        p = (c + 1) / (self.tokens + self.distinct + 1)
        add = lambda x: np.add.reduceat(x, bounds[:-1])
        return [np.diff(bounds), add((c > 0).astype(np.int64)), add(np.log10(p)), add(np.log10(self.probability(c, of_before, level)))]

    def probability(self, count: np.ndarray, of_before: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Of words with a count, after words with a count, by the level of the two."""
        p = (count + 1) / (self.tokens + self.distinct + 1)
        q = np.minimum(np.minimum(self.value[level], of_before), count)
        own = self.strength + SHARE * of_before
        return (q + own * p) / (of_before + own + np.where(of_before > 0, self.false_mass, 0.0))


def as_rows(ids: pa.Array, found: list[np.ndarray], n: int) -> pa.RecordBatch:
    cols = [pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
    return pa.RecordBatch.from_arrays([ids, cols[0], cols[1], pa.array(np.full(len(ids), n), pa.int64()), cols[2], cols[3]], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def unpacked(sizes: list[int], packed: bytes) -> list[bytes]:
    """The texts of a slice."""
    flat = pa.decompress(packed, sum(sizes), "zstd", asbytes=True) if any(sizes) else b""
    ends = np.cumsum(sizes).tolist()
    return [flat[end - size : end] for size, end in zip(sizes, ends)]


def slices_of(texts: DataFrame, parts: int) -> DataFrame:
    """(slice, home, ids, sizes, texts): texts packed into slices, each with a part where its answers meet it."""

    def pack(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for ids, part in sliced(batch, SLICE):
                packed = pa.compress(b"".join(part), "zstd", asbytes=True)
                row = (pa.array([(task << 32) + k], pa.int64()), pa.array([(3 * task + k) % parts], pa.int32()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([list(map(len, part))], pa.list_(pa.int64())), pa.array([packed], pa.binary()))
                yield pa.RecordBatch.from_arrays(list(row), ["slice", "home", "ids", "sizes", "texts"])
                k += 1

    return texts.mapInArrow(pack, "slice long, home int, ids array<long>, sizes array<long>, texts binary")


def answers_to(slices: DataFrame, made: DataFrame, parts: int) -> DataFrame:
    """(home, slice, part, counts, levels): what each part knows of the words and bigrams of each slice."""

    def ask(batches):
        for batch in batches:
            for name, home, sizes, packed in zip(*(c.to_pylist() for c in batch.columns)):
                flat, before, _ = tokens(unpacked(sizes, packed))
                out: dict[int, list] = {}
                for kind, names in enumerate((np.unique(flat), np.unique(bigram(before, flat)))):
                    pack = (bytes, short)[kind]
                    order, bounds = deal((names % U(parts)).astype(np.int64), parts)
                    for p in np.flatnonzero(np.diff(bounds)).tolist():
                        out.setdefault(p, [b"", b""])[kind] = pack(names[order[bounds[p] : bounds[p + 1]]])
                k, none = len(out), [None] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([name] * k, pa.int64()), pa.array([home] * k, pa.int32()), *(pa.array([r[i] for r in out.values()], pa.binary()) for i in range(2)), pa.array(none, pa.binary())], ["part", "slice", "number", "a", "b", "c"])

    def answer(batches):
        own = Part(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(8, np.uint8), DEEP)  # where nothing was learnt
        for batch in batches:
            out = []
            for p, name, number, a, b, c in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if name < 0:  # the part itself comes first
                    own = Part(np.frombuffer(a, U), np.frombuffer(c, np.int64), np.frombuffer(b, np.uint8), number)
                else:
                    out.append((number, name, p, own.counts_of(np.frombuffer(a, U)).tobytes(), own.levels_of(longer(b)).tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["home", "slice", "part", "counts", "levels"])

    asked = slices.select("slice", "home", "sizes", "texts").mapInArrow(ask, "part int, slice long, number int, a binary, b binary, c binary")
    owned = made.select("part", F.lit(-1).cast("long").alias("slice"), F.col("probes").alias("number"), F.col("words").alias("a"), F.col("bits").alias("b"), F.col("counts").alias("c"))
    return by_part(owned.unionByName(asked), parts).sortWithinPartitions("slice").mapInArrow(answer, "home int, slice long, part int, counts binary, levels binary")


def score(documents: DataFrame, parts: int | None = None, strength: float = STRENGTH, training: Column | None = None) -> DataFrame:
    """OUT for every document, learnt from the rows of ``training`` (by default all folds but one)."""
    parts = parts or partitions(documents.sparkSession)
    texts = byte_texts(documents)
    learnt = texts.where(in_training(F.col("doc_id")) if training is None else training)
    made = materialize(count_parts(learnt, parts), "counts")
    totals = Totals.of(made, parts, learnt.count(), strength)
    slices = materialize(slices_of(texts, parts), "slices")
    answers = materialize(answers_to(slices, made, parts), "answers")
    discard(made)

    def finish(ids: list, part: list[bytes], got: dict[int, tuple[bytes, bytes]]):
        def look(names, pairs):
            pairs, inverse = np.unique(pairs, return_inverse=True)
            out = []
            for k, (asked, kind) in enumerate(((names, np.int64), (pairs, np.uint8))):
                order, bounds = deal((asked % U(parts)).astype(np.int64), parts)
                values = np.zeros(len(asked), kind)
                for p in np.flatnonzero(np.diff(bounds)).tolist():
                    values[order[bounds[p] : bounds[p + 1]]] = np.frombuffer(got[p][k], kind)
                out.append(values)
            return out[0].astype(float), out[1].astype(np.int64)[inverse]

        return as_rows(pa.array(ids, pa.int64()), totals.score(part, look), totals.tokens)

    def run(batches):
        name, ids, part, got = None, [], [], {}
        for batch in batches:
            for at, p, counts, levels_, i, sizes, packed in zip(*batch.columns[1:]):
                if p.as_py() < 0:  # a slice's texts come before its answers
                    if name is not None:
                        yield finish(ids, part, got)
                    name, ids, part, got = at.as_py(), i.as_py(), unpacked(sizes.as_py(), packed.as_py()), {}
                else:
                    got[p.as_py()] = counts.as_py(), levels_.as_py()
        if name is not None:
            yield finish(ids, part, got)

    sent = slices.withColumn("part", F.lit(-1)).select("home", "slice", "part", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("levels"), "ids", "sizes", "texts")
    both = sent.unionByName(answers, allowMissingColumns=True)
    return both.repartitionById(parts, F.col("home")).sortWithinPartitions("slice", "part").mapInArrow(run, OUT)
