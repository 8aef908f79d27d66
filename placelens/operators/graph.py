"""Graph operators on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from placelens.scratch import discard, materialize

#: Rounds after which an edge table that still changes counts as a defect.
MOST_ROUNDS = 60
#: Edges of an unfinished group that a task holds.
CARRIED = 200_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Alternates large-star and small-star rounds: every node first hands the smallest
    node near it to its larger neighbours, then to its smaller ones, until each node
    points at its root. Rounds are written to the shared folder, so that a lost
    executor costs one round at most. Edges with a null end and loops are ignored;
    the result does not depend on the order or number of repeats of edges.
    """
    pair = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).isNull().alias("a"), F.col(dst).isNull().alias("b"))
    now = materialize(pair.where("not a and not b and u <> v").select("u", "v").distinct(), "edges")
    before = _state(now)
    for _ in range(MOST_ROUNDS):
        # one exchange each serves the minimum and the join; no side is broadcast, as its files tell little of its size
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(near.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(root.hint("merge"), "u")
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(root.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, materialize(small, "edges")
        discard(last)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the edges (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _star(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The edges of a batch (.., src, dst) as stars: each node beside the smallest that it reaches within the batch."""
    batch = batch.filter(pc.not_equal(batch.column("src"), batch.column("dst")))  # nulls are filtered too
    group = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns[:-2]:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.unique(group * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
    ends = np.concatenate([batch.column("src").to_numpy(zero_copy_only=False), batch.column("dst").to_numpy(zero_copy_only=False)])
    node, code = np.unique(ends, return_inverse=True)
    key, first, at = np.unique(np.concatenate([group, group]) * max(1, len(node)) + code, return_index=True, return_inverse=True)
    root = _roots(at[: batch.num_rows], at[batch.num_rows :], len(key))
    leaf = np.flatnonzero(root != np.arange(len(key)))
    row = first[leaf] % max(1, batch.num_rows)
    own = batch.take(pa.array(row))
    return pa.RecordBatch.from_arrays([*own.columns[:-2], pa.array(ends[first[root[leaf]]], pa.int64()), pa.array(ends[first[leaf]], pa.int64())], names=batch.schema.names)


def stars(edges: DataFrame, ordered: bool = False) -> DataFrame:
    """Fewer edges (.., src, dst) with the same components: those of a batch become stars, repeats and circles go. Nothing is shuffled.

    Of ``ordered`` edges, by group, the last group of a batch goes on in the next one, up to ``CARRIED`` edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            star = _star(pa.concat_batches([held, batch]) if held is not None else batch)
            last = [c.slice(len(c) - 1) for c in batch.columns[:-2]]
            same = np.full(star.num_rows, ordered)
            for column, value in zip(star.columns, last):
                code = pa.concat_arrays([column, value]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                same &= code[:-1] == code[-1]
            if same.sum() > CARRIED:
                same[:] = False
            yield star.filter(pa.array(~same))
            held = star.filter(pa.array(same))
        if held is not None:
            yield held

    return edges.mapInArrow(run, edges.schema)


def components_by(edges: DataFrame, by: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """(by, node, component): ``components`` of each group of edges between whole numbers.

    Edges become stars where they stand and, brought together by group, once more, so
    that few rounds are left; a large group is split by the planner, its stars meet in the rounds.
    """
    whole = edges.select(*by, F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
    near = stars(stars(whole).hint("rebalance", *by).sortWithinPartitions(*by), True)
    keyed = near.select(F.struct(*by, F.col("src").alias("n")).alias("a"), F.struct(*by, F.col("dst").alias("n")).alias("b"))
    return components(keyed, "a", "b").select(*(F.col(f"node.{k}").alias(k) for k in by), F.col("node.n").alias("node"), F.col("component.n").alias("component"))


def largest_component(edges: DataFrame, by: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """(by, node): the nodes of each group's largest component, ties by the smallest node."""
    label = components_by(edges, by, src, dst)
    size = label.groupBy(*by, "component").agg(F.count("*").alias("size"))
    best = size.groupBy(*by).agg(F.min_by("component", F.struct(-F.col("size"), "component")).alias("component"))
    return label.join(best, [*by, "component"], "left_semi").select(*by, "node")


def merged_graph(edges: DataFrame, label: DataFrame, by: list[str]) -> DataFrame:
    """(by, src, dst, w, links): edges between the groups that ``label`` (by, node, component) merges nodes to."""
    a = label.select(*by, F.col("node").alias("src"), F.col("component").alias("ca"))
    b = label.select(*by, F.col("node").alias("dst"), F.col("component").alias("cb"))
    both = edges.join(a, [*by, "src"], "left").join(b, [*by, "dst"], "left")
    ends = both.select(*by, F.coalesce("ca", "src").alias("s"), F.coalesce("cb", "dst").alias("t"), "w", *(["links"] if "links" in edges.columns else [F.lit(1).cast("long").alias("links")])).where("s <> t")
    return ends.groupBy(*by, F.least("s", "t").alias("src"), F.greatest("s", "t").alias("dst")).agg(F.sum("w").alias("w"), F.sum("links").alias("links"))


def contract_edges(edges: DataFrame, by: list[str], threshold: float, least: float = 1.5) -> DataFrame:
    """(by, node, component): groups joined by more than ``least`` links of mean weight over the threshold, until none is left.

    Rounds are set-based: all such pairs of a round are merged together.
    """
    now, label = materialize(merged_graph(edges, edges.select(*by, F.col("src").alias("node"), F.col("src").alias("component")).limit(0), by), "merged"), None
    for _ in range(MOST_ROUNDS):
        strong = now.where((F.col("links") > least) & (F.col("w") / F.col("links") > threshold))
        if strong.isEmpty():
            break
        one = components_by(strong, by)
        if label is None:
            label = materialize(one, "labels")
        else:
            # nodes follow the group that they were merged to; groups new to the labels come in
            step = one.select(*by, F.col("component").alias("next"), F.col("node").alias("component"))
            followed = label.join(step, [*by, "component"], "left").select(*by, "node", F.coalesce("next", "component").alias("component"))
            label = materialize(followed.unionByName(one.join(label, [*by, "node"], "left_anti")), "labels")
        last, now = now, materialize(merged_graph(now, one, by), "merged")
        discard(last)
    if label is None:
        return edges.select(*by, F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return label


def euclidean_clusters(points: DataFrame, tolerance: float, least: int, most: int, by: list[str]) -> DataFrame:
    """(by, pt_idx, cluster): components of the radius graph with their number of points in limits.

    Points in one cell whose diagonal is within the tolerance belong together, so
    they stand as one node. Pairs of points in reach link their cells and become stars
    in the task in which they meet, so that pairs are not shuffled.
    """
    from placelens.functions.geometry import cell
    from placelens.operators.spatial import pairs_within

    edge = tolerance / 3**0.5 * 0.999
    fine = {f"f{k}": cell(k, edge) for k in "xyz"}
    node = F.min("pt_idx").over(Window.partitionBy(*by, "fx", "fy", "fz")).alias("node")
    placed = materialize(points.select(*by, "pt_idx", "x", "y", "z").withColumns(fine).select(*by, "pt_idx", "x", "y", "z", node), "placed")
    ends = placed.select(*by, "x", "y", "z", "node")
    links = pairs_within(ends, ends, tolerance, by).where("node < b_node")
    label = components_by(links, by, "node", "b_node").withColumnRenamed("component", "c")
    out = placed.join(label.hint("merge"), [*by, "node"], "left").select(*by, "pt_idx", F.coalesce("c", "node").alias("cluster"))
    size = out.groupBy(*by, "cluster").agg(F.count("*").alias("size")).where(F.col("size").between(least, most))
    return out.join(size.hint("merge"), [*by, "cluster"]).select(*by, "pt_idx", "cluster", "size")


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """Rows (.., e) of (.., e, o) that may be among the ``n`` of smallest o[h] of their group for some h: in each batch those that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, m = np.zeros(batch.num_rows, np.int64), batch.num_rows
            for column in batch.columns[:-2]:
                codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
                group = np.unique(group * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
            kept = np.zeros(m, bool)
            for o in batch.column("o").flatten().to_numpy().reshape(m, -1).T if m else ():
                order = np.lexsort((o, group))
                at = np.arange(m) - np.searchsorted(group[order], group[order])
                # what ties with the last one stays
                bound = np.full(group.max() + 1, np.iinfo(np.int64).max)
                bound[group[order[at == n - 1]]] = o[order[at == n - 1]]
                kept |= o <= bound[group]
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(kept))

    return rows.mapInArrow(run, rows.drop("o").schema)


def reject_planar(clusters: DataFrame, by: list[str], distance: float, share: float, hypotheses: int) -> DataFrame:
    """(by): clusters (by, pt_idx, x, y, z) of which no plane through three of their points holds more than ``share``.

    The three points of each hypothesis are those of smallest hash, so that runs repeat;
    batches leave at most three a hypothesis, whatever a cluster's size.
    """
    own = F.struct("pt_idx", "x", "y", "z").alias("e")
    seed = _smallest(clusters.select(*by, own, F.array(*(F.xxhash64("pt_idx", F.lit(h)) for h in range(hypotheses))).alias("o")), 3).groupBy(*by).agg(F.collect_list("e").alias("of"))
    ranked = lambda e: F.struct(F.xxhash64(e["pt_idx"], F.col("h")).alias("o"), e["x"].alias("x"), e["y"].alias("y"), e["z"].alias("z"))
    each = seed.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(hypotheses - 1))))
    three = each.select(*by, "h", F.slice(F.array_sort(F.transform("of", ranked)), 1, 3).alias("p")).where(F.size("p") == 3)
    p = [F.get("p", F.lit(i)) for i in range(3)]
    u = {k: p[1][k] - p[0][k] for k in "xyz"}
    v = {k: p[2][k] - p[0][k] for k in "xyz"}
    n = {"a": u["y"] * v["z"] - u["z"] * v["y"], "b": u["z"] * v["x"] - u["x"] * v["z"], "c": u["x"] * v["y"] - u["y"] * v["x"]}
    plane = three.select(*by, "h", *(e.alias(k) for k, e in n.items()), *(p[0][k].alias(f"o{k}") for k in "xyz")).withColumn("l", F.sqrt(F.expr("a * a + b * b + c * c"))).where("l > 0")
    # a cluster's planes stand in one row, so that its points are not multiplied by them
    planes = plane.groupBy(*by).agg(F.collect_list(F.struct("a", "b", "c", "ox", "oy", "oz", "l")).alias("planes"))
    off = lambda q: F.abs((F.col("x") - q["ox"]) * q["a"] + (F.col("y") - q["oy"]) * q["b"] + (F.col("z") - q["oz"]) * q["c"]) / q["l"]
    shares = [F.avg((off(F.get("planes", F.lit(i))) <= distance).cast("int")).alias(f"s{i}") for i in range(hypotheses)]
    s = F.array_max(F.array(*(f"s{i}" for i in range(hypotheses))))
    best = clusters.select(*by, "x", "y", "z").join(planes.hint("merge"), by).groupBy(*by).agg(*shares).select(*by, s.alias("s"))
    return clusters.select(*by).distinct().join(best, by, "left").where(F.coalesce("s", F.lit(0.0)) <= share).select(*by)
