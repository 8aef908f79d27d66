"""Rays through a grid of cells: which cells a line between two points crosses, and what that tells of them.

The kernel works on Arrow batches. A line is cut where it meets the planes between
cells; the middle of each cut lies in one cell. Evidence is counted in the task before
it is shuffled, so that the shuffle holds at most one row a cell and batch group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Cuts of a line shorter than this share of it do not count: they are where planes meet.
SHORTEST = 1e-9
#: Rows of partial counts that a task holds before it hands them on.
HELD_ROWS = 100_000
#: Lines that a task cuts at once; their cells are counted before the next ones are cut.
CUT_LINES = 2_000

#: Cells along an edge of the blocks by which rays are dealt to tasks.
BLOCK_CELLS = 16

FROM, TO = ("ox", "oy", "oz"), ("ex", "ey", "ez")
CELL = ("cx", "cy", "cz")


def crossings(start: np.ndarray, end: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, from, to, cell) of all cells that lines (n x 3 points each) cross, in order along each line; from and to are shares of it."""
    n = len(start)
    first, last = np.floor(start / size), np.floor(end / size)
    line, place = [np.arange(n), np.arange(n)], [np.zeros(n), np.ones(n)]
    for k in range(3):
        met = np.abs(last[:, k] - first[:, k]).astype(np.int64)
        of = np.repeat(np.arange(n), met)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(met) - met, met)
        plane = np.minimum(first[:, k], last[:, k])[of] + 1 + nth
        line.append(of)
        place.append((plane * size - start[of, k]) / (end[of, k] - start[of, k]))
    line, place = np.concatenate(line), np.concatenate(place)
    order = np.lexsort((place, line))
    line, place = line[order], place[order]
    leg = np.flatnonzero((line[1:] == line[:-1]) & (place[1:] - place[:-1] > SHORTEST)) if len(line) else np.zeros(0, np.int64)
    of, a, b = line[leg], place[leg], place[leg + 1]
    middle = ((a + b) / 2)[:, None]
    return of, a, b, np.floor((start[of] + (end[of] - start[of]) * middle) / size).astype(np.int64)


def _points(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    """Columns as an n x 3 array; nulls become NaN."""
    return np.stack([batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for k in names], axis=1) if batch.num_rows else np.zeros((0, 3))


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def crossed_cells(lines: DataFrame, size: float, keep: list[str]) -> DataFrame:
    """(keep, step, t0, t1, cx, cy, cz): the cells that lines from (ox, oy, oz) to (ex, ey, ez) cross, in order. Lines with a coordinate missing have none."""

    def run(batches):
        for batch in batches:
            start, end = _points(batch, FROM), _points(batch, TO)
            known = np.flatnonzero(np.isfinite(start).all(1) & np.isfinite(end).all(1))
            of, a, b, cells = crossings(start[known], end[known], size)
            # the place of a leg in its line
            step = np.arange(len(of)) - np.searchsorted(of, of)
            kept = pa.table(batch).select(keep).take(pa.array(known[of]))
            for name, values in zip(("step", "t0", "t1", *CELL), (step, a, b, *cells.T), strict=True):
                kept = kept.append_column(name, pa.array(values))
            yield from kept.to_batches(max_chunksize=50_000)

    def table(batches):
        yield from run(pa.RecordBatch.from_arrays(b.columns, schema=b.schema) for b in batches)

    return lines.select(*dict.fromkeys([*keep, *FROM, *TO])).mapInArrow(table, f"{_ddl(lines, keep)}, step long, t0 double, t1 double, cx long, cy long, cz long")


def evidence(points: DataFrame, size: float, by: list[str]) -> DataFrame:
    """(by, cx, cy, cz, hits, misses): how many points (x, y, z) lie in each cell, and how many rays from (ox, oy, oz) to points elsewhere cross it.

    Points without an origin only count as hits; points with a coordinate missing do not count.
    """

    def counted(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by([*by, *CELL], use_threads=False).aggregate([("hits", "sum"), ("misses", "sum")]).rename_columns([*by, *CELL, "hits", "misses"])

    def run(batches):
        held, rows = [], 0
        for batch in (b.slice(k, CUT_LINES) for b in batches for k in range(0, b.num_rows, CUT_LINES)):
            keys = pa.Table.from_batches([batch]).select(by)
            start, end = _points(batch, FROM), _points(batch, ("x", "y", "z"))
            here = np.isfinite(end).all(1)
            seen = np.flatnonzero(here & np.isfinite(start).all(1))
            own = np.flatnonzero(here)
            of, _, _, cells = crossings(start[seen], end[seen], size)
            home = np.floor(end[own] / size).astype(np.int64)
            passed = (cells != np.floor(end[seen[of]] / size).astype(np.int64)).any(1)
            rays = (keys.take(pa.array(own)), home, 1, 0), (keys.take(pa.array(seen[of[passed]])), cells[passed], 0, 1)
            cut = []
            for table, at, hit, miss in rays:
                for name, values in zip((*CELL, "hits", "misses"), (*at.T, np.full(len(at), hit), np.full(len(at), miss)), strict=True):
                    table = table.append_column(name, pa.array(values))
                cut.append(table)
            held.append(counted(cut))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [counted(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
        if held:
            yield from counted(held).to_batches(max_chunksize=50_000)

    # rays that end in one block of cells mostly cross the same ones, so that counts of a task are few; a large group has many blocks.
    # They follow one another in the task, which therefore needs to hold few counts at a time
    block = [F.floor(F.col(k) / (BLOCK_CELLS * size)) for k in "xyz"]
    part = points.select(*by, *FROM, "x", "y", "z").repartition(*(F.col(c) for c in by), *block).sortWithinPartitions(*by, *block).mapInArrow(run, f"{_ddl(points, by)}, cx long, cy long, cz long, hits long, misses long")
    return part.groupBy(*by, *CELL).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))


def occupancy(counts: DataFrame, hit: float, miss: float, low: float, high: float) -> DataFrame:
    """``counts`` (.., hits, misses) with ``p``: log odds of all hits and misses, clamped once, so that the order of rays does not matter."""
    odds = F.col("hits") * hit + F.col("misses") * miss
    return counts.withColumn("p", F.greatest(F.lit(low), F.least(F.lit(high), 1 - 1 / (1 + F.exp(odds))))).drop("hits", "misses")


def clip(o: tuple[str, ...], v: tuple[str, ...], low: tuple[float, ...], high: tuple[float, ...]) -> dict[str, Column]:
    """Entry distance and length, in units of the direction ``v``, of rays from ``o`` in a box by slabs; null where they miss it.

    A ray along a slab is in it everywhere or nowhere.
    """
    infinite = float("inf")

    def slab(p: str, q: str, a: float, b: float) -> tuple[Column, Column]:
        still = F.col(q) == 0
        within = F.col(p).between(a, b)
        one, two = ((F.lit(x) - F.col(p)) / F.when(still, None).otherwise(F.col(q)) for x in (a, b))
        near = F.when(still, F.when(within, F.lit(-infinite)).otherwise(F.lit(infinite))).otherwise(F.least(one, two))
        far = F.when(still, F.when(within, F.lit(infinite)).otherwise(F.lit(-infinite))).otherwise(F.greatest(one, two))
        return near, far

    slabs = [slab(*x) for x in zip(o, v, low, high, strict=True)]
    near, far = F.greatest(F.lit(0.0), *(s[0] for s in slabs)), F.least(*(s[1] for s in slabs))
    return {"entry": F.when(near < far, near), "length": F.when(near < far, far - near)}


def entropy(p: np.ndarray) -> np.ndarray:
    """Natural entropy of cells that are occupied with probability p; 0 where that is certain."""
    inside = (p > 0) & (p < 1)
    q = np.where(inside, p, 0.5)
    return np.where(inside, -(q * np.log(q) + (1 - q) * np.log(1 - q)), 0.0)


def walk_gain(p: np.ndarray, counts: np.ndarray, length: np.ndarray, transparency: float, blind: float = 1e-8) -> np.ndarray:
    """Entropy that each ray can remove from its cells, which follow one another in ``p`` and ``counts``, ``length`` a ray.

    Two recursions: the chance that a cell is visible, which sinks with each cell
    passed (``transparency`` to the power of its number) and with the one before being
    occupied, and the cell's occupancy as predicted from the one before through that
    chance, updated by its own p. Cells that do not count only carry both on. All rays
    take a step together, the longest ones first, so that those still on their way stay in front.
    """
    order = np.argsort(-length, kind="stable")
    start = (np.cumsum(length) - length)[order]
    n = len(length)
    seen, now, before, gain = np.ones(n), np.zeros(n), np.full(n, 0.5), np.zeros(n)
    left = np.searchsorted(-length[order], -np.arange(1, (length.max() if n else 0) + 1), side="right")
    for k, m in enumerate(left.tolist()):
        own = p[start[:m] + k]
        predicted = transparency ** (k + 1) * seen[:m] + blind * (1 - seen[:m])
        free = (1 - before[:m]) * predicted
        seen[:m] = free / (free + before[:m] * (1 - predicted))
        stays = 0.5 + seen[:m] / 2
        guess = stays * now[:m] + (1 - stays) * (1 - now[:m])
        mass = own * guess + (1 - own) * (1 - guess)
        now[:m] = np.where(mass == 0, 1.0, own * guess / np.where(mass == 0, 1.0, mass))
        gain[:m] += np.where(counts[start[:m] + k], entropy(own) - entropy(now[:m]), 0.0)
        before[:m] = own
    out = np.empty(n)
    out[order] = gain
    return out


def view_gain(rays: DataFrame, voxels: DataFrame, size: float, low: tuple[float, ...], high: tuple[float, ...], group: list[str], view: list[str], ray: str, transparency: float = 0.95) -> DataFrame:
    """(group, view, gain): the entropy that each view's rays (from (ox, oy, oz) in direction (vx, vy, vz)) can remove within a box.

    Rays that miss the box, or have no direction, do not count. A ray is walked from the sensor on, through
    cells before the box too, as those hide what is behind them. ``voxels`` (group, cx,
    cy, cz, p); others have p = 0.5.
    """
    clipped = rays.withColumns(clip(FROM, ("vx", "vy", "vz"), low, high)).where("entry is not null")
    far = F.col("entry") + F.col("length")
    ends = {f"e{k}": F.col(f"o{k}") + F.col(f"v{k}") * far for k in "xyz"}
    lines = clipped.withColumns(ends | {"inside": F.col("entry") / far})
    key = [*group, *view, ray]
    legs = crossed_cells(lines, size, [*key, "inside"]).withColumn("counts", F.col("t1") - F.col("inside") > SHORTEST)
    met = legs.join(voxels, [*group, *CELL], "left").select(*key, F.struct("step", F.coalesce("p", F.lit(0.5)).alias("p"), "counts").alias("cell"))
    walked = met.groupBy(*key).agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    walked = walked.select(*group, *view, F.transform("cells", lambda e: e["p"]).alias("p"), F.transform("cells", lambda e: e["counts"]).alias("counts"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p, counts = (batch.column(k).combine_chunks() if isinstance(batch.column(k), pa.ChunkedArray) else batch.column(k) for k in ("p", "counts"))
            length = np.diff(p.offsets.to_numpy())
            gain = walk_gain(p.flatten().to_numpy(), counts.flatten().to_numpy(zero_copy_only=False), length, transparency)
            yield from pa.Table.from_batches([batch]).select([*group, *view]).append_column("gain", pa.array(gain)).to_batches()

    return walked.mapInArrow(run, f"{_ddl(walked, [*group, *view])}, gain double").groupBy(*group, *view).agg(F.sum("gain").alias("gain"))
