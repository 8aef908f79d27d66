"""Bag-of-words retrieval over a hierarchical vocabulary of descriptors.

Tables: nodes(node_id, parent_id, depth, is_leaf, centroid), paths(vec_id, source_id,
node_id, depth), postings(node_id, source_id, tf). The root is node 0 at depth 0;
the children of node n are n * k + 1 to n * k + k.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from placelens.scratch import discard, materialize

#: Nodes of a vocabulary up to which it is broadcast (about 2 KB each).
BROADCAST_NODES = 40_000


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def mean_vectors(df: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """(by, centroid, n): mean vector of each group, summed per component."""
    parts = df.select(*by, F.posexplode(vec).alias("pos", "v")).groupBy(*by, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count("*").alias("n"))
    rows = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("c"), F.max("n").alias("n"))
    return rows.select(*by, F.transform("c", lambda e: e["v"]).alias("centroid"), "n")


def train_tree(descriptors: DataFrame, k: int, depth: int, rounds: int = 3, key: str = "vec_id") -> DataFrame:
    """nodes: hierarchical k-means, level by level over all nodes at once.

    The seeds of a node are its k descriptors of smallest hash, so that training
    repeats. A node with one descriptor, or at the last level, is a leaf. Each
    Lloyd round assigns by a join with the node's centroids and averages per
    component; nothing is collected.
    """
    every = descriptors.select(F.col(key).alias("k_"), F.col("vec")).where(F.forall("vec", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))
    root = mean_vectors(every.withColumn("node_id", F.lit(0).cast("long")), ["node_id"]).select("node_id", F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("depth"), "centroid", "n")
    nodes, placed = root, materialize(every.withColumn("node_id", F.lit(0).cast("long")), "placed")
    for level in range(1, depth + 1):
        w = Window.partitionBy("node_id").orderBy(F.xxhash64("k_", F.lit(level)), "k_")
        inner = placed.join(placed.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").select("node_id"), "node_id", "left_semi")
        seeds = inner.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
        centres = materialize(seeds.select(F.col("node_id").alias("parent_id"), (F.col("node_id") * k + F.col("rn")).alias("node_id"), F.transform("vec", lambda v: v.cast("double")).alias("centroid")), "centres")
        for _ in range(rounds):
            near = _closest(inner, centres)
            moved = mean_vectors(near, ["parent_id", "node_id"]).select("parent_id", "node_id", "centroid")
            last, centres = centres, materialize(moved, "centres")
            discard(last)
        near = materialize(_closest(inner, centres), "placed")
        counts = near.groupBy("node_id").agg(F.count("*").alias("n"))
        made = centres.join(counts, "node_id").select("node_id", "parent_id", F.lit(level).alias("depth"), "centroid", "n")
        nodes = nodes.unionByName(made)
        placed = near.select("k_", "vec", "node_id")
    nodes = materialize(nodes, "nodes")
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id"), F.lit(False).alias("leaf")).distinct()
    return nodes.join(parents, "node_id", "left").select("node_id", "parent_id", "depth", F.coalesce("leaf", F.lit(True)).alias("is_leaf"), "centroid", "n")


def _closest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Rows of a node with the closest of its children."""
    side = centres.withColumnsRenamed({"node_id": "child"})
    pairs = rows.join(side, rows.node_id == side.parent_id).withColumn("d", squared_distance(F.col("vec"), F.col("centroid")))
    best = pairs.groupBy("k_").agg(F.min_by(F.struct("parent_id", "child", "vec"), F.struct("d", "child")).alias("m"))
    return best.select("k_", F.col("m.vec").alias("vec"), F.col("m.parent_id").alias("parent_id"), F.col("m.child").alias("node_id"))


def assign_paths(descriptors: DataFrame, nodes: DataFrame, depth: int, keep: tuple[str, ...] = ("vec_id", "source_id")) -> DataFrame:
    """paths: greedy descent by squared distance, the root included; ties by node_id."""
    small = nodes.count() <= BROADCAST_NODES
    side = nodes.select("parent_id", F.col("node_id").alias("child"), "centroid")
    side = F.broadcast(side) if small else side
    here = descriptors.select(*keep, "vec", F.lit(0).cast("long").alias("node_id"))
    out = here.select(*keep, "node_id", F.lit(0).alias("depth"))
    for level in range(1, depth + 1):
        pairs = here.join(side, F.col("node_id") == F.col("parent_id")).withColumn("d", squared_distance(F.col("vec"), F.col("centroid")))
        best = pairs.groupBy(*keep).agg(F.min_by(F.struct("child", "vec"), F.struct("d", "child")).alias("m"))
        here = best.select(*keep, F.col("m.vec").alias("vec"), F.col("m.child").alias("node_id"))
        out = out.unionByName(here.select(*keep, "node_id", F.lit(level).alias("depth")))
    return out


def word_distances(descriptors: DataFrame, words: DataFrame, bound: float | None, key: str = "vec_id", most: int = BROADCAST_NODES) -> DataFrame:
    """(key, word, d): all words closer than ``bound`` to each descriptor, or (None) the closest one, ties by word.

    ``words`` are node_id and centroid. A vocabulary of up to ``most`` words goes to the
    tasks at once, a larger one in slices of about that size, each of which is a pass
    over the descriptors; the closest word is then that of all slices. Descriptors and
    words that are null, hold nulls or numbers that are not finite, or differ in length
    have no distance.
    """
    spark = descriptors.sparkSession
    kind = descriptors.schema[key].dataType.simpleString()
    whole = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = descriptors.where(whole("vec")).select(key, "vec")
    words = words.where(whole("centroid")).select(F.col("node_id").cast("long").alias("node_id"), F.col("centroid").cast("array<double>").alias("centroid"))
    slices = -(-words.count() // most)

    def met(part: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast([(r["node_id"], np.array(r["centroid"])) for r in part.orderBy("node_id").collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    vecs = np.array(batch.column(1).take(pa.array(at)).flatten()).astype(np.float64).reshape(len(at), size)
                    out, near, name = [], np.full(len(at), np.inf), np.zeros(len(at), np.int64)
                    for word, centre in held.value:
                        if len(centre) != size:
                            continue
                        d = np.sqrt(np.square(vecs - centre).sum(axis=1))
                        if bound is None:
                            closer = d < near  # words come in order, so the first of equals stays
                            near[closer], name[closer] = d[closer], word
                        else:
                            hit = np.flatnonzero(d < bound)
                            out.append((hit, np.full(len(hit), word, np.int64), d[hit]))
                    if bound is None:
                        hit = np.flatnonzero(np.isfinite(near))
                        out = [(hit, name[hit], near[hit])]
                    for hit, word, d in out:
                        if len(hit):
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[hit])), pa.array(word), pa.array(d)], [key, "word", "d"])

        return rows.mapInArrow(run, f"{key} {kind}, word long, d double")

    if slices <= 1:
        return met(words)
    found = reduce(DataFrame.unionByName, (met(words.where(F.pmod(F.xxhash64("node_id"), F.lit(slices)) == k)) for k in range(slices)))
    if bound is not None:
        return found
    return found.groupBy(key).agg(F.min(F.struct("d", "word")).alias("m")).select(key, "m.word", "m.d")


def soft_matches(a: DataFrame, b: DataFrame, words: DataFrame, bound: float = 0.40, by: tuple[str, ...] = ("pair",), key: str = "vec_id") -> DataFrame:
    """(by, key, b_key, word, d): keypoints of ``b`` whose closest word is among those closer than ``bound`` to one of ``a``.

    Both have ``by`` (which frames meet), key and vec; d is the distance of a's keypoint to
    the word they share. Each descriptor's words are told once, however many frames its frame meets.
    """
    near = word_distances(a.select(key, "vec").dropDuplicates([key]), words, bound, key)
    best = word_distances(b.select(key, "vec").dropDuplicates([key]), words, None, key).drop("d")
    left = a.select(*by, key).join(near, key)
    right = b.select(*by, key).join(best, key).withColumnRenamed(key, f"b_{key}")
    return left.join(right, [*by, "word"]).select(*by, key, f"b_{key}", "word", "d")


def postings(paths: DataFrame, source: str = "source_id") -> DataFrame:
    """Term frequency of each node in each source; inner nodes hold their leaves' sum."""
    return paths.groupBy("node_id", "depth", F.col(source).alias("source_id")).agg(F.count("*").alias("tf"))


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings of both batches."""
    return old.unionByName(new).groupBy("node_id", "depth", "source_id").agg(F.sum("tf").alias("tf"))


def node_weights(posts: DataFrame, n: int) -> DataFrame:
    """(node_id, weight): log n - log of the sources in a node."""
    return posts.groupBy("node_id").agg((F.log(F.lit(float(n))) - F.log(F.countDistinct("source_id"))).alias("weight"))


def weighted(posts: DataFrame, weights: DataFrame, min_depth: int) -> DataFrame:
    """(source_id, node_id, v): weight times term frequency at or below a depth."""
    return posts.where(F.col("depth") >= min_depth).join(weights, "node_id").select("source_id", "node_id", (F.col("weight") * F.col("tf")).alias("v"))


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("source_id").agg(F.sum(F.abs("v")).alias("norm"))


def score(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, source_id, score): 1 - sum of minima over the larger norm; many queries at once.

    Only nodes that a query touches are scored: an equi-join on the node.
    """
    qn = norms(queries).select(F.col("source_id").alias("query_id"), F.col("norm").alias("qnorm"))
    dn = norms(vectors).withColumnsRenamed({"norm": "dnorm"})
    q = queries.select(F.col("source_id").alias("query_id"), "node_id", F.col("v").alias("q"))
    common = q.join(vectors, "node_id").groupBy("query_id", "source_id").agg(F.sum(F.least("q", "v")).alias("common"))
    return common.join(qn, "query_id").join(dn, "source_id").select("query_id", "source_id", (1 - F.col("common") / F.greatest("qnorm", "dnorm")).alias("score"))


def debug_score(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sum of residuals of the vectors, each divided by its own norm."""
    qn = norms(queries).select(F.col("source_id").alias("query_id"), F.col("norm").alias("qnorm"))
    dn = norms(vectors).withColumnsRenamed({"norm": "dnorm"})
    q = queries.select(F.col("source_id").alias("query_id"), "node_id", F.col("v").alias("q")).join(qn, "query_id")
    v = vectors.join(dn, "source_id")
    # |a - b| summed over all nodes is the sum of both less twice the minima, both having norm 1
    common = q.join(v, "node_id").groupBy("query_id", "source_id").agg(F.sum(F.least(F.col("q") / F.col("qnorm"), F.col("v") / F.col("dnorm"))).alias("common"))
    return common.select("query_id", "source_id", (2 - 2 * F.col("common")).alias("score"))


def cell_members(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """All descriptors on whose paths the nodes lie."""
    return paths.join(nodes.select("node_id").distinct(), "node_id", "left_semi")


def reweight(vectors: DataFrame, scores: DataFrame) -> DataFrame:
    """Vectors whose nodes are scaled by the mean score of the relevant sources in them."""
    factor = vectors.join(scores, "source_id").groupBy("node_id").agg(F.avg("relevance").alias("f"))
    return vectors.join(factor, "node_id", "left").select("source_id", "node_id", (F.col("v") * F.coalesce("f", F.lit(1.0))).alias("v"))


def grow_groups(candidates: DataFrame, parts: DataFrame, queries: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(query_id, group_id, subgroups, score): from the hinted subgroup on, the adjacent one that lowers the distance most joins.

    A group is one sweep; its vectors are a few kilobytes, so each (query, group)
    grows in a task of its own.
    """
    import pandas as pd

    q = queries.groupBy(F.col("source_id").alias("query_id")).agg(F.map_from_entries(F.collect_list(F.struct("node_id", "v"))).alias("q"))
    p = parts.groupBy("group_id", "subgroup_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "v"))).alias("p"))
    a = adjacency.groupBy("group_id").agg(F.collect_list(F.array("i", "j")).alias("near"))
    rows = candidates.join(q, "query_id").join(p, "group_id").join(a, "group_id", "left")

    def distance(query: dict, total: dict) -> float:
        common = sum(min(v, total.get(n, 0.0)) for n, v in query.items())
        return 1 - common / max(sum(query.values()), sum(total.values()), 1e-12)

    def one(df: pd.DataFrame) -> pd.DataFrame:
        query = dict(df["q"].iloc[0])
        part = {s: dict(m) for s, m in zip(df["subgroup_id"], df["p"])}
        pairs = df["near"].iloc[0]
        near: dict[int, set] = {}
        for i, j in pairs if pairs is not None else ():
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
        taken = [int(df["hint"].iloc[0])]
        total = dict(part[taken[0]])
        best = distance(query, total)
        while True:
            options = sorted({j for i in taken for j in near.get(i, ()) if j in part and j not in taken})
            tried = []
            for j in options:
                grown = {n: total.get(n, 0.0) + part[j].get(n, 0.0) for n in total.keys() | part[j].keys()}
                tried.append((distance(query, grown), j, grown))
            if not tried or min(tried)[0] >= best:
                break
            best, j, total = min(tried, key=lambda t: t[:2])
            taken.append(j)
        return pd.DataFrame({"query_id": [df["query_id"].iloc[0]], "group_id": [df["group_id"].iloc[0]], "subgroups": [sorted(taken)], "score": [best]})

    return rows.groupBy("query_id", "group_id").applyInPandas(one, "query_id long, group_id long, subgroups array<long>, score double")


def split_keypoints(points: DataFrame, by: list[str], size: int) -> DataFrame:
    """Column part: groups of at most ``size`` points, cut along the longest axis in turn.

    Equal sizes follow from ranks instead of repairing the sizes of clusters.
    """
    spread = points.groupBy(*by).agg(*((F.max(k) - F.min(k)).alias(f"s{k}") for k in "xyz"))
    longest = F.when((F.col("sx") >= F.col("sy")) & (F.col("sx") >= F.col("sz")), F.col("x")).when(F.col("sy") >= F.col("sz"), F.col("y")).otherwise(F.col("z"))
    w = Window.partitionBy(*by).orderBy("_along", "pt_idx")
    ranked = points.join(spread, by).withColumn("_along", longest).withColumn("part", F.floor((F.row_number().over(w) - 1) / size))
    return ranked.select(*points.columns, "part")
