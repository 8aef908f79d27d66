"""Poses as hypotheses: pixels are moved by them, and meet the pixels that they then cover."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Largest scaled difference of depth that agrees; beyond it the moved pixel hides what is behind.
AGREES = 0.2003

#: Moved pixels that a task holds at once; candidates are tried together up to that.
TRIED_AT_ONCE = 1 << 15

SCORES = "src long, dst long, k int, score double, occ double"


def reproject(u, v, z, m: Column, cam: tuple[float, float, float, float]) -> dict[str, Column]:
    """Pixel (nearest whole one) and depth of a pixel with depth ``z`` after the pose ``m`` (12 numbers); null behind the camera."""
    fx, fy, cx, cy = cam
    x, y, z = (F.col(u) - cx) * F.col(z) / fx, (F.col(v) - cy) * F.col(z) / fy, F.col(z)
    p = [m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(3)]
    at = lambda c, f, o: F.when(p[2] > 0, F.floor(c * f / p[2] + o + 0.5))
    return {"pu": at(p[0], fx, cx), "pv": at(p[1], fy, cy), "pz": p[2]}


def posed_scores(pixels: DataFrame, poses: DataFrame, cam: tuple[float, float, float, float]) -> DataFrame:
    """(src, dst, score, occ) for one pose of each pair (src, dst, m): agreement and occlusion of the pixels that meet.

    ``pixels`` has frame_id, u, v, z, w and masked; masked pixels of src are moved to
    dst. Each pixel moves once and meets by equal pixel keys. Pairs that share no pixel
    are left out.
    """
    a = pixels.where("masked").select(F.col("frame_id").alias("src"), "u", "v", "z", "w").join(poses.select("src", "dst", "m"), "src")
    a = a.withColumns(reproject("u", "v", "z", F.col("m"), cam)).where("pu is not null").select("src", "dst", "pu", "pv", "pz", "w")
    b = pixels.select(F.col("frame_id").alias("dst"), F.col("u").cast("long").alias("pu"), F.col("v").cast("long").alias("pv"), F.col("z").alias("zb"))
    res = (F.col("zb") - F.col("pz")) / (F.col("pz") * F.col("pz") + F.col("zb") * F.col("zb"))
    met = a.join(b, ["dst", "pu", "pv"]).withColumn("res", res)
    worth = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
    return met.groupBy("src", "dst").agg(worth(F.abs("res") < AGREES).alias("score"), worth(F.col("res") > AGREES).alias("occ"))


class Pixels:
    """Places of pixels (whole u and v, each pair once) in an image, found by a table over its rectangle or, where that is sparse, by search."""

    def __init__(self, u: np.ndarray, v: np.ndarray) -> None:
        u, v = u.astype(np.int64), v.astype(np.int64)
        self.low = (u.min(), v.min()) if len(u) else (0, 0)
        self.size = (int(u.max()) - int(u.min()) + 1, int(v.max()) - int(v.min()) + 1) if len(u) else (0, 0)
        key = (u - self.low[0]) * self.size[1] + (v - self.low[1])
        self.dense = self.size[0] * self.size[1] <= max(1 << 16, 16 * len(u))
        if self.dense:
            self.places = np.full(self.size[0] * self.size[1] + 1, -1)
            self.places[key] = np.arange(len(u))
        else:
            self.order = np.argsort(key, kind="stable")
            self.keys = key[self.order]

    def find(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Places of the pixels (u, v), which may be any floats; -1 where there is none."""
        u, v = u - self.low[0], v - self.low[1]
        inside = (u >= 0) & (u < self.size[0]) & (v >= 0) & (v < self.size[1])
        key = np.where(inside, u, self.size[0]).astype(np.int64) * self.size[1] + np.where(inside, v, 0).astype(np.int64)
        if self.dense:
            return self.places[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(inside & (self.keys[at] == key), self.order[at], -1)


def hypothesis_scores(pixels: DataFrame, pairs: DataFrame, candidates: np.ndarray, cam: tuple[float, float, float, float]) -> DataFrame:
    """(src, dst, k, score, occ): ``posed_scores`` of every candidate pose (rows of 12 numbers) of every pair (src, dst).

    A task holds the two images of a pair and tries the poses there, so that pixels are
    shuffled once for each of their frame's pairs and not once for each hypothesis.
    A pixel of dst must stand once, as in an image. Pairs whose src has no masked pixel
    are left out; those that share no pixel score 0.
    """
    fx, fy, cx, cy = cam

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "k": pa.array([], pa.int32()), "score": pa.array([], pa.float64()), "occ": pa.array([], pa.float64())})
        u, v, z, w = (left.column(c).to_numpy() for c in ("u", "v", "z", "w"))
        pixel = Pixels(right.column("u").to_numpy(), right.column("v").to_numpy())
        depth = right.column("z").to_numpy()
        x, y = (u - cx) * z / fx, (v - cy) * z / fy
        score, occ = np.zeros(len(candidates)), np.zeros(len(candidates))
        some = max(1, TRIED_AT_ONCE // len(x))
        for k in range(0, len(candidates) if len(depth) else 0, some):
            m = candidates[k : k + some, :, None]
            px, py, pz = (m[:, 4 * i] * x + m[:, 4 * i + 1] * y + m[:, 4 * i + 2] * z + m[:, 4 * i + 3] for i in range(3))
            with np.errstate(divide="ignore", invalid="ignore"):
                at = pixel.find(np.floor(px * fx / pz + cx + 0.5), np.floor(py * fy / pz + cy + 0.5))
            of, n = np.nonzero((at >= 0) & (pz > 0))
            za, zb, own = pz[of, n], depth[at[of, n]], w[n]
            res = (zb - za) / (za * za + zb * zb)
            for total, met in ((score, np.abs(res) < AGREES), (occ, res > AGREES)):
                total[k : k + some] = np.bincount(of, np.where(met, own, 0.0), len(m))
        n = len(candidates)
        ends = {c: pa.array(np.full(n, left.column(c)[0].as_py(), np.int64)) for c in ("src", "dst")}
        return pa.table({**ends, "k": pa.array(np.arange(n, dtype=np.int32)), "score": pa.array(score), "occ": pa.array(occ)})

    ends = pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    image = pixels.select("frame_id", "u", "v", "z", "w", "masked")
    fresh = lambda df, *names: df.select(*(F.col(c).alias(c) for c in names))  # noqa: E731  (both sides come of one table)
    a = fresh(image.where("masked").withColumnRenamed("frame_id", "src").join(ends, "src"), "src", "dst", "u", "v", "z", "w")
    b = fresh(image.withColumnRenamed("frame_id", "dst").join(ends, "dst"), "src", "dst", "u", "v", "z")
    return a.groupBy("src", "dst").cogroup(b.groupBy("src", "dst")).applyInArrow(run, SCORES)


def best_pose(scores: DataFrame, by: list[str], unmoved: int) -> DataFrame:
    """(by, pose, gain, total): the candidate of largest agreement less occlusion, ties to the first.

    ``unmoved`` is the candidate that moves nothing; the pose is null where none is better.
    """
    total = scores.groupBy(*by, "k").agg(F.sum(F.col("score") - F.col("occ")).alias("total"))
    best = total.groupBy(*by).agg(F.max(F.struct("total", (-F.col("k")).alias("o"))).alias("m"), F.max(F.when(F.col("k") == unmoved, F.col("total"))).alias("before"))
    better = F.col("m.total") > F.col("before")
    return best.select(*by, F.when(better, (-F.col("m.o")).cast("long")).alias("pose"), F.when(better, F.col("m.total") - F.col("before")).otherwise(0.0).alias("gain"), F.col("m.total").alias("total"))
