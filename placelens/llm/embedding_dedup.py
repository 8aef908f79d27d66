"""Near-duplicate embeddings by a forest of random-projection trees.

Method: each tree splits the vectors again and again at the median of a random
direction; vectors within a margin of the median go to both sides (spill), so that
near neighbours seldom part. Vectors that share a leaf of any tree, and their
label, are compared exactly in double precision; links are united to components.

The trees' directions and medians are fitted on at most SAMPLE vectors, those of
smallest hash of the id; every vector is then led through all trees. The margin is
0.75 standard deviations of the difference that a pair at the threshold has along a
random direction. A split parts such a pair with about 0.5 %, a tree of 20 levels
with less than 10 %, all TREES trees with less than one in 10,000 (recall is measured
in the tests). Spill multiplies rows at each level, by 1.12 here and by 1.24 at twice
this margin, so it decides how work grows with the table. The sample only
starts the trees: leaves that hold more than 2 * LEAF vectors of a label are split
further, at medians that Spark takes over all of their rows, so that leaves do not
grow with the table. A split that saves less than a quarter of the comparisons
(vectors too close to part) is undone, and the leaf compared as it is.

Hot groups: equal vectors of a label are one class with a multiplicity, so copies
are not compared. A leaf of more than BLOCK vectors of a label is compared in a
grid of blocks, each pair of blocks in a task of its own. A pair that shares
several leaves counts in the first of them only, so no pairs are sent around: tasks
give counts per vector, and edges to the smallest vector of what is connected in
their block.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without label or id, link with nothing and are kept (without
id: component_id null, not kept); vectors of different lengths do not link; repeated
rows are one vector and keep their rows; an empty table gives an empty table. Only
vec_id, embedding and label are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placelens.operators.graph import components
from placelens.scratch import materialize

COSINE = 0.98
TREES = 4
LEAF = 2048
SAMPLE = 20_000
BLOCK = 1024
MARGIN = 0.75
BROADCAST_LEAVES = 100_000
WAYS = 3
ROUNDS = 9


def margin(dim: int, cosine: float) -> float:
    return float(MARGIN * np.sqrt(2 * (1 - cosine)) / np.sqrt(dim))


class Forest:
    """Trees of (direction, median) nodes; leaves are numbered over all trees."""

    def __init__(self, sample: np.ndarray, leaf: float, trees: int, cosine: float, seed: int = 11) -> None:
        d = sample.shape[1]
        self.margin = margin(d, cosine)
        self.leaf, self.leaves, self.random = max(16.0, leaf), 0, np.random.default_rng(seed)
        self.roots = [self._grow(sample, 0) for _ in range(trees)]

    def _grow(self, x: np.ndarray, depth: int):
        if len(x) > self.leaf and depth < 40:
            for _ in range(3):
                r = self.random.standard_normal(x.shape[1])
                r /= np.sqrt(r @ r)
                p = x @ r
                t = float(np.median(p))
                left, right = p <= t + self.margin, p >= t - self.margin
                if max(left.sum(), right.sum()) < 0.9 * len(x):
                    return r, t, self._grow(x[left], depth + 1), self._grow(x[right], depth + 1)
        self.leaves += 1
        return self.leaves - 1

    def lead(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a vector reaches, sorted by row and leaf."""
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stack = [(root, np.arange(len(x))) for root in self.roots]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                rows.append(at)
                leaves.append(np.full(len(at), node))
                continue
            r, t, left, right = node
            p = x[at] @ r
            stack += [(left, at[p <= t + self.margin]), (right, at[p >= t - self.margin])]
        rows, leaves = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((leaves, rows))
        return rows[order], leaves[order]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def led(classes: DataFrame, forest, dim: int) -> DataFrame:
    """(label, leaf, rep, mult, embedding, leaves): each class in all of its leaves.

    Leaves are numbered from 2 ** 32, so that the numbers 8 * leaf + 0..7 of their parts are no other leaf's.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column(3)))
            row, leaf = forest.value.lead(x)
            leaf += 1 << 32
            starts = np.searchsorted(row, np.arange(len(x) + 1))
            every = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(leaf))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(leaf), batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), every.take(take)], ["label", "leaf", "rep", "mult", "embedding", "leaves"])

    return classes.select("label", "rep", "mult", "embedding").mapInArrow(run, "label long, leaf long, rep long, mult long, embedding array<float>, leaves array<long>")


def projected(large: DataFrame, dim: int, seed: int = 12) -> DataFrame:
    """``large`` with the places of each vector along its leaf's WAYS directions, one of 64 sets by the leaf's number."""
    pool = np.random.default_rng(seed).standard_normal((64, WAYS, dim))
    pool /= np.sqrt((pool * pool).sum(axis=2, keepdims=True))

    def run(batches):
        for batch in batches:
            x = unit(matrix(batch.column("embedding"))) if batch.num_rows else np.zeros((0, dim))
            leaf = batch.column("leaf").to_numpy().astype(np.uint64)
            of = (leaf * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(int)
            places = np.zeros((WAYS, len(x)))
            for k in np.unique(of):
                places[:, of == k] = pool[k] @ x[of == k].T
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, places)], [*batch.schema.names, *(f"p{k}" for k in range(WAYS))])

    return large.mapInArrow(run, "label long, leaf long, rep long, mult long, embedding array<float>, n long, " + ", ".join(f"p{k} double" for k in range(WAYS)))


def split(placed: DataFrame, dim: int, leaf: int, cosine: float) -> DataFrame:
    """``placed`` with all leaves of more than 2 * ``leaf`` vectors of a label split, as far as that saves work.

    Each round halves the large leaves along WAYS directions, with spill. Those that gain
    nothing from it stay whole; `leaves` is gathered anew once any leaf was split.
    """
    spill, finished = margin(dim, cosine), []
    for _ in range(ROUNDS):
        large = materialize(placed.groupBy("label", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf), "large")
        if large.isEmpty():
            break
        ways = projected(placed.drop("leaves").join(large, ["label", "leaf"]).select("label", "leaf", "rep", "mult", "embedding", "n"), dim)
        cuts = ways.groupBy("label", "leaf").agg(*(F.percentile_approx(f"p{k}", 0.5, 1000).alias(f"t{k}") for k in range(WAYS)))
        parts = ways.join(cuts, ["label", "leaf"]).withColumn("part", F.col("leaf"))
        for k in range(WAYS):
            low, high = F.col(f"p{k}") <= F.col(f"t{k}") + spill, F.col(f"p{k}") >= F.col(f"t{k}") - spill
            sides = F.when(low & high, F.array(F.lit(0), F.lit(1))).when(low, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
            parts = parts.withColumn("side", F.explode(sides)).withColumn("part", F.col("part") * 2 + F.col("side"))
        parts = materialize(parts.select("label", "leaf", "part", "rep", "mult", "embedding", "n"), "parts")
        work = parts.groupBy("label", "leaf", "part").agg(F.count("*").cast("double").alias("c"), F.first("n").cast("double").alias("n")).groupBy("label", "leaf").agg(F.sum(F.col("c") * F.col("c")).alias("work"), F.first("n").alias("n"))
        saved = materialize(work.where(F.col("work") <= 0.75 * F.col("n") * F.col("n")).select("label", "leaf"), "saved")
        finished.append(placed.select("label", "leaf", "rep", "mult", "embedding").join(saved, ["label", "leaf"], "left_anti"))
        placed = parts.join(saved, ["label", "leaf"], "left_semi").select("label", F.col("part").alias("leaf"), "rep", "mult", "embedding")
    if not finished:
        return placed
    for one in finished:
        placed = placed.unionByName(one)
    every = materialize(placed.withColumn("same", F.xxhash64("embedding")), "split")  # a vec_id may have several vectors
    lists = every.groupBy("label", "rep", "same").agg(F.collect_list("leaf").alias("leaves"))
    return every.join(lists, ["label", "rep", "same"]).drop("same")


def compare(table: pa.Table, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of one pair of blocks that have links: rep, links counted here, smallest rep connected here."""
    own, i, j = (table.column(c).to_numpy() for c in ("block", "i", "j"))
    rep, mult, leaf = table.column("rep").to_numpy(), table.column("mult").to_numpy(), int(table.column("leaf")[0].as_py())
    x = unit(matrix(table.column("embedding").combine_chunks()))
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if i[0] != j[0]:
        linked &= own[:, None] != own[None, :]  # pairs within a block are compared in its own cell
    rows = np.flatnonzero(linked.any(axis=1))
    if not len(rows):
        return rep[:0], mult[:0], rep[:0]
    linked, rep, mult = linked[np.ix_(rows, rows)], rep[rows], mult[rows]
    lists = table.column("leaves").combine_chunks().take(pa.array(rows))
    of = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
    code = lists.flatten().to_numpy()
    before = code < leaf
    once = linked
    if before.any():
        names, at = np.unique(code[before], return_inverse=True)
        member = np.zeros((len(rows), len(names)), np.float32)
        member[of[before], at] = 1
        once = linked & (member @ member.T == 0)
    links = once.astype(np.float64) @ mult.astype(np.float64)
    root = rep.copy()
    while True:  # smallest label over links until nothing changes
        low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == root).all():
            break
        root = low
    return rep, links.astype(np.int64), root


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("long").alias("label"))
    value = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", value) & F.exists("embedding", lambda v: v != 0)
    good = rows.where(F.coalesce(sound, F.lit(False)))
    classes = materialize(good.distinct().groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("dim", F.size("embedding")), "classes")
    found = None
    for dim, n in classes.groupBy("dim").count().orderBy("dim").collect():
        own = classes.where(F.col("dim") == dim)
        picked = own.orderBy(F.xxhash64("rep"), "rep", "label").select("embedding").limit(sample).toArrow().column(0).combine_chunks()
        forest = embeddings.sparkSession.sparkContext.broadcast(Forest(unit(matrix(picked)), leaf * len(picked) / n, trees, cosine))
        one = _linked(own, forest, dim, cosine, leaf, block)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "label long, rep long, links long, root long")
    found = materialize(found, "links")
    links = found.groupBy("label", "rep").agg(F.sum("links").alias("links"))
    label = components(found, "rep", "root").withColumnsRenamed({"node": "rep"})
    each = classes.join(links, ["label", "rep"], "left").join(label, "rep", "left")
    each = each.select("label", "embedding", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = good.join(each, ["label", "embedding"]).select("vec_id", "n", "component").unionByName(rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("component")))
    return out.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


def _linked(classes: DataFrame, forest, dim: int, cosine: float, leaf: int, block: int) -> DataFrame:
    """(label, rep, links, root) from every leaf."""
    placed = split(materialize(led(classes, forest, dim), "leaves"), dim, leaf, cosine)
    sizes = placed.groupBy("label", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    several = materialize(sizes.where(F.col("blocks") > 1), "blocks")
    if several.count() <= BROADCAST_LEAVES:
        several = F.broadcast(several)
    cells = placed.join(several, ["label", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")

    def run(table: pa.Table) -> pa.Table:
        rep, links, root = compare(table, cosine)
        label = np.full(len(rep), table.column("label")[0].as_py(), np.int64)
        return pa.table({"label": pa.array(label), "rep": pa.array(rep, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    cells = cells.repartition("label", "leaf", "i", "j")  # or a join dealt by leaf would keep all blocks of a leaf in one task
    return cells.groupBy("label", "leaf", "i", "j").applyInArrow(run, "label long, rep long, links long, root long")
