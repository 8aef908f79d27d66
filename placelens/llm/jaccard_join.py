"""N-gram Jaccard join by parity sketches.

Method: a document is its set of hashed word shingles. Per size band the set is
dealt by hash into N blocks; each block is a word of the sketch, the XOR of its
shingles' hashes. Adding or removing a shingle changes one block, so the number of
differing blocks (and the Hamming distance of the parity bits) bounds the sets'
symmetric difference from below. Sets that are similar enough differ in at most D
filled blocks, D following from the sizes, so among the D + 1 rarest filled blocks
of each there is one in common (pigeonhole). Documents meet in buckets of equal
blocks and are verified on their whole sets. The few sets whose shingles crowd into
D blocks or fewer meet in a bucket of their own.

Candidates are tried on parity sketches first: each shingle flips one bit, and the
Hamming distance of two sketches is at most the symmetric difference. A sketch has
four bits or more for each shingle, in a power of two, so that the longer of two
sketches folds to the other's length. What passes is verified on the whole sets.

Sizes. A set meets sets of its own band and, as the smaller side, of the next one;
bands grow by the reciprocal of the similarity, which reaches every possible
partner.

Hot groups. Documents with equal sets are one member of a bucket. A document whose
blocks are its own but for a few (passages that many documents share) has D + 1
blocks of its own and leaves; others meet in their rarest blocks only. In a bucket
every member is compared with the smallest one; what is left in different
components afterwards is compared by sketches in a second round, large buckets in a
grid of blocks, and only pairs within the bound are handed on. No link between
components is lost.

Defined results: null or empty texts have an empty set and no links; fewer words
than the shingle's length make the whole sequence one shingle; rows of one doc_id
are one node; rows with a null doc_id keep their row with component_id null; an
empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placelens.llm.packed import U, by_part, byte_texts, deal, mix, runs, sliced, word_hashes
from placelens.operators.graph import components
from placelens.scratch import discard, materialize, partitions

SHINGLE = 5
PERCENT = 75
#: Members of a bucket in one row, and in one block of a grid.
CHUNK, BLOCK = 4096, 1024
#: Members of a bucket that meet its verdict in one task.
SPREAD = 256
#: Tasks among which the rows of a set with more than SPREAD rows are dealt.
SALTS = 64
#: Documents up to which a list of ids (8 bytes each) is broadcast instead of shuffling texts.
BROADCAST_IDS = 2_000_000
#: What names a set: its size and fingerprint.
SET = ("n_shingles", "f1", "f2")
#: Stands for the block of crowded sets.
CROWDED = (1 << 40) - 1


def shingles(text: bytes, length: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted."""
    w = word_hashes(text)
    n = len(w) - length + 1
    if n <= 0:
        if not len(w):
            return w
        n, length = 1, len(w)
    h = np.full(n, length, U)
    for k in range(length):
        h = h * U(0x9E3779B97F4A7C15) + w[k : k + n]
    return np.unique(mix(h))


class Bands:
    """Size bands for a similarity in percent."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, -(-low[-1] * 100 // percent)))
        self.low = np.array(low)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, "right")) - 1

    def distance(self, band: int) -> int:
        """Largest symmetric difference of a linked pair of sets up to the band's largest size."""
        return 2 * (int(self.low[band + 1]) - 1) * (100 - self.percent) // (100 + self.percent)

    def prefix(self, size: int, band: int) -> int:
        """One more than the largest symmetric difference of a set of this size and a partner in the band."""
        partner = min(int(self.low[band + 1]) - 1, size * 100 // self.percent)
        return (size + partner) * (100 - self.percent) // (100 + self.percent) + 1

    def blocks(self, band: int) -> int:
        return max(64, 3 * (self.distance(band) + 1) // 2 + 1)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(np.bitwise_xor.reduce(s)) if len(s) else 0, int(mix(s + U(12345)).sum(dtype=U)) if len(s) else 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def parity(s: np.ndarray) -> bytes:
    """The parity sketch of a set."""
    bits = max(64, 1 << (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two parity sketches; the longer one is folded."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sets(documents: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sketch): size, 128-bit fingerprint and parity sketch of each row's set."""

    def run(batches):
        for batch in batches:
            for ids, texts in sliced(batch):
                found = [(len(s), *map(signed, fingerprint(s)), parity(s)) for s in (shingles(t, length) for t in texts)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in found], t) for k, t in enumerate(kinds))], ["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return byte_texts(documents).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


def plausible(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    of = own.select("doc_id", "n_shingles", "sketch")
    sized = pairs.join(of.toDF("a", "na", "sa"), "a").join(of.toDF("b", "nb", "sb"), "b")
    sized = sized.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)).select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            na, nb, sa, sb = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= (m + n) * (100 - percent) // (100 + percent) for m, n, x, y in zip(na, nb, sa, sb)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.mapInArrow(run, "a long, b long")


def sketch_blocks(s: np.ndarray, band: int, count: int) -> np.ndarray:
    """Filled blocks of a set's sketch: a key of band, block and XOR word for each."""
    block = ((s >> U(33)) % U(count)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block, s = block[order], s[order]
    starts = runs(block)
    word = np.bitwise_xor.reduceat(s, starts)
    return mix(word ^ mix(block[starts].astype(U) + U(band << 40)))


def keys_of(documents: DataFrame, length: int, bands: Bands, parts: int) -> DataFrame:
    """Sketch blocks dealt by key: packed (doc, fingerprint, band, filled blocks, prefix) and keys."""

    def run(batches):
        for batch in batches:
            for ids, texts in sliced(batch):
                entries, keys = [], []
                for doc, text in zip(ids.to_pylist(), texts):
                    s = shingles(text, length) if doc is not None else ()
                    if not len(s):
                        continue
                    own, fp = bands.of(len(s)), signed(fingerprint(s)[1])
                    for band in (own, own + 1):
                        if bands.distance(band):
                            k = sketch_blocks(s, band, bands.blocks(band))
                            prefix = bands.prefix(len(s), band)
                            entries.append((doc, fp, band, len(k), prefix))
                            if len(k) < prefix:
                                k = np.append(k, mix(np.array([(band << 40) + CROWDED], U)))
                            keys.append(k)
                if not keys:
                    continue
                flat = np.concatenate(keys)
                entry = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
                table = np.array(entries, np.int64)
                order, bounds = deal((flat % U(parts)).astype(np.int64), parts)
                out = []
                for p in np.flatnonzero(np.diff(bounds)):
                    at = order[bounds[p] : bounds[p + 1]]
                    used, counts = np.unique(entry[at], return_counts=True)  # at keeps the entries' order
                    out.append((int(p), table[used].tobytes(), counts.astype(np.int32).tobytes(), flat[at].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3))], ["part", "entries", "counts", "keys"])

    return by_part(byte_texts(documents).mapInArrow(run, "part int, entries binary, counts binary, keys binary"), parts)


def shared_blocks(keys: DataFrame, parts: int) -> DataFrame:
    """The blocks that documents share with others, packed as in ``keys_of`` with buckets' sizes, dealt by document."""

    def run(batches):
        entries, counts, keys = [], [], []
        for batch in batches:
            for e, c, k in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                entries.append(np.frombuffer(e, np.int64).reshape(-1, 5))
                counts.append(np.frombuffer(c, np.int32))
                keys.append(np.frombuffer(k, U))
        if not keys:
            return
        table = np.concatenate(entries)
        key = np.concatenate(keys)
        entry = np.repeat(np.arange(len(table), dtype=np.int32), np.concatenate(counts))
        del keys, entries
        order = np.argsort(key, kind="stable")
        key, entry = key[order], entry[order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[:-1] |= same[1:]
        key, entry = key[same], entry[same]
        # documents with equal sets: the smallest stands for them
        order = np.lexsort((table[entry, 0], table[entry, 1], key))
        key, entry = key[order], entry[order]
        first = runs(key, table[entry, 1])
        key, entry = key[first], entry[first]
        starts = runs(key)
        size = np.diff(np.append(starts, len(key)))
        of = np.repeat(size, size)
        key, entry, of = key[of > 1], entry[of > 1], of[of > 1]
        order, bounds = deal((mix(table[entry, 0].astype(U)) % U(parts)).astype(np.int64), parts)
        out = []
        for p in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[p] : bounds[p + 1]]
            at = at[np.argsort(entry[at], kind="stable")]
            used, counts = np.unique(entry[at], return_counts=True)
            out.append((int(p), table[used][:, [0, 2, 3, 4]].tobytes(), counts.astype(np.int32).tobytes(), key[at].tobytes(), of[at].astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in range(1, 5))], ["part", "entries", "counts", "keys", "sizes"])

    return keys.mapInArrow(run, "part int, entries binary, counts binary, keys binary, sizes binary")


def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.append(starts, len(values)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def groups(batches, keys: int):
    """Runs of rows that agree in the first ``keys`` columns, from batches of sorted rows."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        at = runs(*(table.column(k).to_numpy() for k in range(keys)))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield table.slice(a, b - a)
        rest = table.slice(int(at[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def needed_blocks(found: DataFrame, parts: int) -> DataFrame:
    """(part, docs, keys): the rarest blocks of each document, as many as are not its own among D + 1."""

    def run(batches):
        tables, counts, keys, sizes = [], [], [], []
        for batch in batches:
            for e, c, k, n in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                tables.append(np.frombuffer(e, np.int64).reshape(-1, 4))
                counts.append(np.frombuffer(c, np.int32))
                keys.append(np.frombuffer(k, U))
                sizes.append(np.frombuffer(n, np.int32))
        if not keys:
            return
        table, key, size = np.concatenate(tables), np.concatenate(keys), np.concatenate(sizes)
        entry = np.repeat(np.arange(len(table)), np.concatenate(counts))
        doc, band = table[entry, 0], table[entry, 1]
        order = np.lexsort((key, size, band, doc))
        entry, key, doc, band = entry[order], key[order], doc[order], band[order]
        at = runs(doc, band)
        n = np.diff(np.append(at, len(key)))
        head = table[entry[at]]
        take = head[:, 3] - (head[:, 2] - n)
        keep = np.arange(len(key)) - np.repeat(at, n) < np.repeat(take, n)
        if keep.any():
            yield _dealt(doc[keep], key[keep], parts)

    return by_part(by_part(found, parts).mapInArrow(run, "part int, docs binary, keys binary"), parts)


def _dealt(docs: np.ndarray, keys: np.ndarray, parts: int) -> pa.RecordBatch:
    order, bounds = deal((keys % U(parts)).astype(np.int64), parts)
    full = np.flatnonzero(np.diff(bounds))
    cut = lambda x: pa.array([x[order[bounds[p] : bounds[p + 1]]].tobytes() for p in full], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), cut(docs), cut(keys)], ["part", "docs", "keys"])


def buckets(needed: DataFrame) -> DataFrame:
    """(key, pivot, size, docs): members of each bucket of two or more, equal buckets once, in rows of CHUNK."""

    def run(batches):
        docs, keys = [], []
        for batch in batches:
            docs += [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            keys += [np.frombuffer(x, U) for x in batch.column(2).to_pylist()]
        if not docs:
            return
        doc, key = np.concatenate(docs), np.concatenate(keys)
        order = np.lexsort((doc, key))
        doc, key = doc[order], key[order]
        at = runs(key, doc)
        doc, key = doc[at], key[at]
        at = runs(key)
        ends = np.append(at[1:], len(key))
        more = ends - at > 1
        at, ends = at[more], ends[more]
        if not len(at):
            return
        name = _sums(mix(doc.astype(U)), at, ends)
        name, once = np.unique(name, return_index=True)
        rows = [(n, doc[at[i]], doc[k : min(k + CHUNK, ends[i])], int(ends[i] - at[i])) for n, i in zip(name.view(np.int64).tolist(), once) for k in range(int(at[i]), int(ends[i]), CHUNK)]
        for k in range(0, len(rows), 20_000):
            some = rows[k : k + 20_000]
            starts = np.append(0, np.cumsum([len(r[2]) for r in some])[:-1])
            key, pivot, size = (pa.array([r[k] for r in some], pa.int64()) for k in (0, 1, 3))
            yield pa.RecordBatch.from_arrays([key, pivot, size, lists(np.concatenate([r[2] for r in some]), starts)], ["key", "pivot", "size", "docs"])

    return needed.mapInArrow(run, "key long, pivot long, size long, docs array<long>").distinct()


def _sums(x: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.append(U(0), np.cumsum(x, dtype=U))
    return total[ends] - total[at]


def crossing(members: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's different components whose sizes and sketches allow a link.

    ``members`` has key, the bucket's size, doc_id and component. Buckets of more than
    BLOCK members are compared in a grid of blocks, each cell for itself.
    """
    cells = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "component")
    full = cells.join(own.select("doc_id", "n_shingles", "sketch"), "doc_id").select("key", "i", "j", "block", "doc_id", "component", "n_shingles", "sketch")
    ordered = full.repartition(partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        found: set = set()
        for rows in groups(batches, 3):
            found.update(_near(rows, percent))
            if len(found) > 200_000:
                yield _pairs(found)
                found = set()
        yield _pairs(found)

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _pairs(found: set) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _near(rows: pa.Table, percent: int):
    """Pairs of different components in one cell within the bound of their sizes and sketches."""
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    block, doc, part, n = (rows.column(k).to_numpy() for k in ("block", "doc_id", "component", "n_shingles"))
    sketch = [np.frombuffer(x, np.uint64) for x in rows.column("sketch").to_pylist()]
    for k in range(len(doc) - 1):
        rest = np.arange(k + 1, len(doc))
        ok = (part[rest] != part[k]) & (doc[rest] != doc[k]) & (np.minimum(n[rest], n[k]) * 100 >= np.maximum(n[rest], n[k]) * percent)
        if i != j:
            ok &= block[rest] != block[k]
        for m in rest[ok].tolist():
            if distance(sketch[k], sketch[m]) <= int(n[k] + n[m]) * (100 - percent) // (100 + percent):
                yield (int(min(doc[k], doc[m])), int(max(doc[k], doc[m])))


def verify(pairs: DataFrame, sets_of: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; each a's set is sent once to each of its tasks."""
    dealt = F.pmod(F.xxhash64("b"), F.lit(16)).cast("int")
    right = pairs.join(sets_of.withColumnsRenamed({"doc_id": "b"}), "b").select("a", dealt.alias("salt"), "b", "shingles")
    left = pairs.select("a", dealt.alias("salt")).distinct().join(sets_of.withColumnsRenamed({"doc_id": "a"}), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    both = left.unionByName(right).repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        mine, alike = None, []  # rows of one doc_id may hold several texts
        for batch in batches:
            a_out, b_out = [], []
            for a, b, blob in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                s = np.frombuffer(blob, U)
                if b is None:
                    if a != mine:
                        mine, alike = a, []
                    alike.append(s)
                elif any(similar(x, s, percent) for x in alike):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def whole_sets(documents: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc_id, shingles): the sets of the wanted documents as packed 64-bit integers."""

    def run(batches):
        for batch in batches:
            for ids, texts in sliced(batch):
                yield pa.RecordBatch.from_arrays([ids, pa.array([shingles(t, length).tobytes() for t in texts], pa.binary())], ["doc_id", "shingles"])

    texts = byte_texts(documents)
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return texts.join(side, "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles binary")


def checked(documents: DataFrame, own: DataFrame, near: DataFrame, percent: int, length: int) -> DataFrame:
    """The links among the pairs (a, b), by whole sets."""
    near = materialize(near.distinct(), "near")
    wanted = materialize(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wanted")
    if wanted.isEmpty():
        return near
    return materialize(verify(near, materialize(whole_sets(documents, wanted, length), "shingles"), percent), "links")


def similar_documents(documents: DataFrame, percent: int = PERCENT, length: int = SHINGLE, parts: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row.

    component_id is the smallest doc_id that links reach; documents link when
    100 * intersection >= percent * union of their shingle sets.
    """
    spark = documents.sparkSession
    bands = Bands(percent)
    parts = parts or partitions(spark)
    own = materialize(sets(documents, length), "sets")
    shared = materialize(shared_blocks(keys_of(documents, length, bands, parts), parts), "blocks")
    found = materialize(buckets(needed_blocks(shared, parts)), "buckets")
    discard(shared)
    pairs = found.select(F.col("pivot").alias("a"), F.explode("docs").alias("b")).where("a <> b").distinct()
    links = checked(documents, own, plausible(pairs, own, percent), percent, length)
    label = materialize(components(links, "a", "b"), "labels")
    # what shares a bucket but not yet a component
    members = found.select("key", "size", F.explode("docs").alias("doc_id"))
    placed = members.join(label, members.doc_id == label.node, "left").select("key", "size", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("key", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "size")
    # a large bucket's members meet its verdict in several tasks
    salts = F.ceil(F.col("size") / SPREAD).cast("int")
    verdict = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    dealt = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    rest = materialize(dealt.join(verdict, ["key", "size", "salt"], "left_semi").drop("salt"), "rest")
    more = checked(documents, own, crossing(rest, own, percent), percent, length)
    sound = own.where("n_shingles > 0 and doc_id is not null").select("doc_id", *SET)
    alike = materialize(sound.groupBy(*SET).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "alike")
    # a doc_id with several texts joins the groups of all of them
    repeated = materialize(sound.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        ties = sound.join(repeated, "doc_id", "left_semi").distinct().join(alike, list(SET)).where("doc_id <> rep")
        more = materialize(more.unionByName(ties.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "ties")
    if not more.isEmpty():
        label = materialize(components(links.unionByName(more), "a", "b"), "labels")
    nodes = alike.join(label, alike.rep == label.node, "left").select(*SET, "n", F.coalesce("component", "rep").alias("component"))
    return _by_sets(own, materialize(nodes, "nodes"))


def _by_sets(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, by its set's component.

    Sets of more than SPREAD rows are few (a SPREAD-th of the rows at most): they are
    repeated over SALTS tasks, and their rows are dealt among those (in any of them a
    row finds the same). What is left has at most SPREAD rows a set. Rows without words
    or id meet nothing.
    """
    out = [F.col("doc_id"), F.col("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")]
    slim = own.select("doc_id", *SET)
    sound = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    alone = slim.where(~sound).withColumn("component", F.lit(None).cast("long")).select(*out)
    hot = nodes.where(F.col("n") > SPREAD).drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = slim.where(sound).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    spread = salted.join(hot, [*SET, "salt"]).select(*out)
    rest = salted.join(hot, [*SET, "salt"], "left_anti").join(nodes.where(F.col("n") <= SPREAD).drop("n"), list(SET), "left").select(*out)
    return spread.unionByName(rest).unionByName(alone)


def without(documents: DataFrame, removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``documents`` less the ids in ``removed`` (doc_id); rows without id stay. A list of ids is broadcast up to BROADCAST_IDS."""
    removed = materialize(removed.select(F.col("doc_id").alias("__removed")).where("__removed is not null").distinct(), "removed")
    side = F.broadcast(removed) if removed.count() <= BROADCAST_IDS else removed
    return documents.join(side, documents[id_col] == F.col("__removed"), "left_anti")


def first_of_each(documents: DataFrame, percent: int = PERCENT, length: int = SHINGLE) -> DataFrame:
    """One row of each group of similar ones stays, with all columns: that of smallest doc_id.

    Where ids are missing or repeat, every row is judged by its own text: rows are
    numbered and linked by number, and of a group the row of smallest doc_id (null
    last), then of smallest hash of the text, then of the whole row, stays. Rows
    without words link with nothing and stay.
    """
    odd = documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return without(documents, similar_documents(documents, percent, length).where("component_id <> doc_id"))
    row = "__row"
    while row in documents.columns:
        row += "_"
    numbered = materialize(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = similar_documents(numbered.select(F.col(row).alias("doc_id"), "text"), percent, length).select(F.col("doc_id").alias(row), "component_id")
    plain = [f.name for f in documents.schema.fields if "map<" not in f.dataType.simpleString()]
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"), F.xxhash64(*plain).alias("d"), F.col(row).alias("e"))
    placed = materialize(numbered.select(row, place.alias("place")).join(groups, row).select(row, "place", "component_id"), "placed")
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    later = placed.join(first, "component_id").where("place <> first").select(F.col(row).alias("doc_id"))
    return without(numbered, later, row).select(*documents.columns)
