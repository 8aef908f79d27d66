"""Spatial joins: distance predicates turned into equi-joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from placelens.functions.geometry import cell

AXES = ("x", "y", "z")
#: Columns of a point's cell; a point has one, in which it meets all points in reach.
CELL = ("cx", "cy", "cz")
#: Edge of a cell in radii: the smaller, the more copies of a point are shuffled (8 at 2, 4.6 at 3), the larger, the more pairs are compared.
EDGE = 3


def squared(a: str, b: str) -> Column:
    """Squared distance of the points of two aliases."""
    return sum(((F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) * (F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) for k in AXES), F.lit(0.0))


def with_cells(df: DataFrame, size: float, neighbours: bool = False, prefix: str = "c") -> DataFrame:
    """Columns cx, cy, cz of each point's cell; with neighbours a row for each of the 27 cells around it."""
    cells = {f"{prefix}{k}": cell(k, size) for k in AXES}
    if not neighbours:
        return df.withColumns(cells)
    near = [F.explode(F.sequence(v - 1, v + 1)) for v in cells.values()]
    for name, column in zip(cells, near):
        df = df.withColumn(name, column)
    return df


def in_reach(df: DataFrame, size: float, radius: float, prefix: str = "c") -> DataFrame:
    """A row for each cell that the ball around a point may touch: with cells wider than the ball up to 8 of them."""
    pad = radius * 1.000001  # more than rounding takes away; a cell too many brings no pair twice
    for k in AXES:
        df = df.withColumn(f"{prefix}{k}", F.explode(F.sequence(cell(F.col(k) - pad, size), cell(F.col(k) + pad, size))))
    return df


def pairs_within(a: DataFrame, b: DataFrame, radius: float, by: list[str], strict: bool = False, cells: bool = False) -> DataFrame:
    """(a.*, b.* prefixed b_, d2) of points with equal ``by`` at most (strictly: less than) a radius apart.

    With ``cells`` also the cell of the a point (CELL). All pairs of an a point are in the
    task of its cell, so what is grouped by its key and the cell is not shuffled again.

    The b side, which should be the smaller one, is repeated in the cells in reach of
    each point. Cells join by shuffle, so no side is compared with all of the other, and
    none is broadcast: the planner takes the repeated side for as small as its files.
    """
    left = with_cells(a, EDGE * radius).alias("a")
    right = in_reach(b, EDGE * radius, radius).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*by, *CELL]]
    d2 = squared("a", "b")
    hit = d2 < radius * radius if strict else d2 <= radius * radius
    joined = left.join(right.hint("merge"), on).where(hit)
    return joined.select(*[F.col(f"a.{k}") for k in [*a.columns, *(CELL if cells else ())]], *[F.col(f"b.{k}").alias(f"b_{k}") for k in b.columns if k not in by], d2.alias("d2"))


def _met(a: DataFrame, b: DataFrame, radius: float, by: list[str], strict: bool, how: str) -> DataFrame:
    """Rows of ``a`` with (semi) or without (anti) a point of ``b`` in reach: a point has one cell, ``b`` those in reach of
    each of its points, so that one join decides, and the first hit ends a point's search."""
    left = with_cells(a, EDGE * radius, prefix="_c").alias("a")
    right = in_reach(b.select(*by, *AXES), EDGE * radius, radius, prefix="_c").alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*by, "_cx", "_cy", "_cz"]]
    d2 = squared("a", "b")
    return left.join(right.hint("merge"), [*on, d2 < radius * radius if strict else d2 <= radius * radius], how).select(*a.columns)


def cloud_difference(a: DataFrame, b: DataFrame, squared_threshold: float, by: list[str]) -> DataFrame:
    """Points of ``a`` without a point of ``b`` within the (squared) threshold."""
    return _met(a, b, squared_threshold**0.5, by, False, "left_anti")


def cloud_intersection(a: DataFrame, b: DataFrame, squared_threshold: float, by: list[str]) -> DataFrame:
    """Points of ``a`` with a point of ``b`` closer than the (squared) threshold."""
    return _met(a, b, squared_threshold**0.5, by, True, "left_semi")


def nearest(a: DataFrame, b: DataFrame, radius: float, by: list[str], key: str = "pt_idx", attributes: tuple[str, ...] = ()) -> DataFrame:
    """(by, key, b_key, d2, b's attributes): the nearest b point within the radius; ties by b's key. A key names one point of ``a``."""
    pairs = pairs_within(a.select(*by, key, *AXES), b.select(*by, key, *AXES, *attributes), radius, by, cells=True)
    best = F.min(F.struct("d2", f"b_{key}", *[f"b_{k}" for k in attributes])).alias("m")
    return pairs.groupBy(*by, *CELL, key).agg(best).select(*by, key, "m.*")


def radius_count(a: DataFrame, radius: float, least: int, by: list[str], key: str = "pt_idx") -> DataFrame:
    """Points with at least ``least`` points (themselves included) within the radius, and their number."""
    p = a.select(*by, key, *AXES)
    n = pairs_within(p, p, radius, by, cells=True).groupBy(*by, *CELL, key).agg(F.count("*").alias("n_near")).where(F.col("n_near") >= least)
    return a.join(n.drop(*CELL), [*by, key])


def transfer_once(near: DataFrame, by: list[str], key: str = "pt_idx") -> DataFrame:
    """Of points with the same nearest b point, the first keeps it."""
    w = Window.partitionBy(*by, f"b_{key}").orderBy(key)
    return near.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def voxels(df: DataFrame, size: float, by: list[str]) -> DataFrame:
    """Distinct occupied cells."""
    return with_cells(df, size).select(*by, "cx", "cy", "cz").distinct()


def voxel_overlap(a: DataFrame, b: DataFrame, size: float, a_by: list[str], b_by: list[str], on: list[str]) -> DataFrame:
    """Intersection over union of occupied voxels, for each pair of groups that share one."""
    va, vb = voxels(a, size, a_by), voxels(b, size, b_by)
    na = va.groupBy(*a_by).agg(F.count("*").alias("na"))
    nb = vb.groupBy(*b_by).agg(F.count("*").alias("nb"))
    common = va.join(vb, [*on, "cx", "cy", "cz"]).groupBy(*dict.fromkeys([*a_by, *b_by])).agg(F.count("*").alias("common"))
    out = common.join(na, a_by).join(nb, b_by)
    return out.withColumn("overlap", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))


def voxel_downsample(df: DataFrame, leaf: float, by: list[str], columns: tuple[str, ...] = ("x", "y", "z", "r", "g", "b")) -> DataFrame:
    """Mean of the columns per voxel."""
    kept = [k for k in columns if k in df.columns]
    return with_cells(df, leaf).groupBy(*by, "cx", "cy", "cz").agg(*(F.avg(k).alias(k) for k in kept), F.count("*").alias("n_points"))


def centroid(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(k).alias(f"m{k}") for k in AXES), F.count("*").alias("n_points"))


def centroid_cutoff(df: DataFrame, far: float, by: list[str]) -> DataFrame:
    """Points no farther than ``far`` from their group's centroid; missing points stay."""
    d2 = sum(((F.col(k) - F.col(f"m{k}")) * (F.col(k) - F.col(f"m{k}")) for k in AXES), F.lit(0.0))
    keep = ~F.coalesce(d2 > far * far, F.lit(False))
    # frames without numbers do not count towards the centroid
    whole = df.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
    return df.join(centroid(whole, by).drop("n_points"), by).where(keep).drop("mx", "my", "mz")


def bbox(df: DataFrame, by: list[str]) -> DataFrame:
    """Bounds, sizes and volume."""
    out = df.groupBy(*by).agg(*(f(k).alias(f"{n}_{k}") for k in AXES for n, f in (("min", F.min), ("max", F.max))))
    for k in AXES:
        out = out.withColumn(f"size_{k}", F.col(f"max_{k}") - F.col(f"min_{k}"))
    return out.withColumn("volume", F.col("size_x") * F.col("size_y") * F.col("size_z"))


def occlusion(removed: DataFrame, added: DataFrame, by: list[str], bins: int) -> DataFrame:
    """Points of ``removed`` in front of, or behind, what ``added`` shows in the same direction.

    Both carry range, tbin and pbin. Of several points of ``added`` in a bin the
    farthest counts, ties by pt_idx.
    """
    far = added.where("tbin is not null").groupBy(*by, "tbin", "pbin").agg(F.max(F.struct("range", "pt_idx")).alias("m")).select(*by, "tbin", "pbin", F.col("m.range").alias("other"))
    side = F.when(F.col("range") < F.col("other"), "front").otherwise("behind")
    return removed.join(far.hint("merge"), [*by, "tbin", "pbin"]).withColumn("side", side)
