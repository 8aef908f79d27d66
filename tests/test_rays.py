"""Rays through cells against plain walks along them."""

import math

import numpy as np
import pyarrow as pa
import pytest

from placelens.operators import rays


def cells_by_steps(a, b, size, steps=20_000):
    """Cells of many places along a line, in order, each run of one cell once."""
    out = []
    for k in range(steps + 1):
        c = tuple(math.floor((x + (y - x) * k / steps) / size) for x, y in zip(a, b))
        if not out or out[-1] != c:
            out.append(c)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_crossed_cells_are_those_on_the_way(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(-3, 3, (12, 3)), rng.uniform(-3, 3, (12, 3))
    b[0], b[1, :2], b[2, 2] = a[0], a[1, :2], a[2, 2]  # no way at all, and ways along an axis or a plane
    of, t0, t1, cells = rays.crossings(a, b, 0.7)
    for k in range(12):
        got = [tuple(c) for c in cells[of == k].tolist()]
        walked = cells_by_steps(a[k], b[k], 0.7)
        # a corner that is passed within a step may be missed by the walk
        assert [c for c in got if c in walked] == walked and len(got) - len(walked) <= 1
        assert t0[of == k][0] == 0 and t1[of == k][-1] == 1 and np.allclose(t0[of == k][1:], t1[of == k][:-1], atol=1e-8)


def test_no_lines():
    assert all(len(x) == 0 for x in rays.crossings(np.zeros((0, 3)), np.zeros((0, 3)), 1.0))


def test_evidence_counts_each_ray_once_a_cell(spark):
    rows = [(1, 0.5, 0.5, 0.5, 3.5, 0.5, 0.5), (1, 0.5, 0.5, 0.5, 3.6, 0.5, 0.5), (1, None, None, None, 1.5, 0.5, 0.5), (2, 0.5, 0.5, 0.5, 0.6, 0.5, 0.5), (2, 0.5, 0.5, 0.5, None, 0.5, 0.5), (None, 1.5, 0.5, 0.5, 0.5, 0.5, 0.5)]
    points = spark.createDataFrame(rows, "g int, ox double, oy double, oz double, x double, y double, z double")
    got = {(r.g, r.cx): (r.hits, r.misses) for r in rays.evidence(points, 1.0, ["g"]).collect()}
    assert got == {(1, 0): (0, 2), (1, 1): (1, 2), (1, 2): (0, 2), (1, 3): (2, 0), (2, 0): (1, 0), (None, 0): (1, 0), (None, 1): (0, 1)}


def test_evidence_is_the_same_however_it_is_held(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(3)), *rng.uniform(-4, 4, 6).tolist()) for _ in range(300)]
    points = spark.createDataFrame(rows, "g int, ox double, oy double, oz double, x double, y double, z double").repartition(3)
    whole = sorted(map(tuple, rays.evidence(points, 0.5, ["g"]).collect()))
    want = {}
    for g, *p in rows:
        o, e = np.array(p[:3]), np.array(p[3:])
        _, _, _, cells = rays.crossings(o[None], e[None], 0.5)
        home = tuple(np.floor(e / 0.5).astype(int).tolist())
        for c in map(tuple, cells.tolist()):
            if c != home:
                hits, misses = want.get((g, *c), (0, 0))
                want[(g, *c)] = (hits, misses + 1)
        hits, misses = want.get((g, *home), (0, 0))
        want[(g, *home)] = (hits + 1, misses)
    assert whole == sorted((*k, *v) for k, v in want.items())
    monkeypatch.setattr(rays, "HELD_ROWS", 50)
    assert sorted(map(tuple, rays.evidence(points, 0.5, ["g"]).collect())) == whole


def test_a_task_cuts_and_holds_few_rays(spark, monkeypatch):
    """However large a batch is, and in whatever order its groups came: a group's rays follow one another."""
    rng = np.random.default_rng(4)
    n = 3 * rays.CUT_LINES
    points = spark.range(n).selectExpr("cast(id % 30 as int) as g", *(f"rand({k}) * 5 as {c}" for k, c in enumerate(("ox", "oy", "oz", "x", "y", "z"))))
    kind, caught, cut = type(points), [], []
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, run, ddl: (caught.append((df, run)), whole(df, run, ddl))[1])
    rays.evidence(points, 0.5, ["g"])
    (given, run), crossings = caught[0], rays.crossings
    for part in given.rdd.glom().map(lambda p: [r.g for r in p]).collect():
        assert part == sorted(part)
    monkeypatch.setattr(rays, "crossings", lambda a, b, size: (cut.append(len(a)), crossings(a, b, size))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(rng.integers(0, 9, n)), *(pa.array(rng.uniform(0, 5, n)) for _ in range(6))], ["g", "ox", "oy", "oz", "x", "y", "z"])
    out = pa.Table.from_batches(list(run(iter([batch]))))
    assert max(cut) <= rays.CUT_LINES and sum(cut) == n and sum(out["hits"].to_pylist()) == n


def gain_by_steps(p, counts, a, blind=1e-8):
    h = lambda q: 0.0 if q <= 0 or q >= 1 else -q * math.log(q) - (1 - q) * math.log(1 - q)
    seen, now, before, gain = 1.0, 0.0, 0.5, 0.0
    for n, (own, c) in enumerate(zip(p, counts), 1):
        ahead = a**n * seen + blind * (1 - seen)
        seen = (1 - before) * ahead / ((1 - before) * ahead + before * (1 - ahead))
        t = 0.5 + seen / 2
        guess = t * now + (1 - t) * (1 - now)
        mass = own * guess + (1 - own) * (1 - guess)
        now = own * guess / mass if mass else 1.0
        gain += h(own) - h(now) if c else 0.0
        before = own
    return gain


def test_gains_of_rays_of_all_lengths():
    rng = np.random.default_rng(2)
    length = np.array([0, 5, 1, 9, 3, 3, 0, 14])
    p, counts = rng.choice([0.12, 0.3, 0.5, 0.97], length.sum()), rng.random(length.sum()) < 0.7
    ends = np.cumsum(length)
    want = [gain_by_steps(p[e - n : e], counts[e - n : e], 0.9) for e, n in zip(ends, length)]
    assert np.allclose(rays.walk_gain(p, counts, length, 0.9), want)
    assert len(rays.walk_gain(p[:0], counts[:0], length[:0], 0.9)) == 0


def test_views_see_gain_in_the_box_only(spark):
    schema = "g int, v int, r int, ox double, oy double, oz double, vx double, vy double, vz double"
    ahead, away, still, through = (1, 1, 1, 0.5, 0.5, 0.5, 1.0, 0.0, 0.0), (1, 2, 2, 0.5, 0.5, 0.5, -1.0, 0.0, 0.0), (1, 3, 3, 2.5, 0.5, 0.5, 0.0, 0.0, 0.0), (1, 4, 4, 2.5, 0.5, 0.5, 1.0, 0.0, 0.0)
    voxels = spark.createDataFrame([(1, 1, 0, 0, 0.9)], "g int, cx long, cy long, cz long, p double")
    got = {r.v: r.gain for r in rays.view_gain(spark.createDataFrame([ahead, away, still, through], schema), voxels, 1.0, (2.0, 0.0, 0.0), (4.0, 1.0, 1.0), ["g"], ["v"], "r", 0.9).collect()}
    assert set(got) == {1, 4}
    assert got[1] == pytest.approx(gain_by_steps([0.5, 0.9, 0.5, 0.5], [False, False, True, True], 0.9))
    assert got[4] == pytest.approx(gain_by_steps([0.5, 0.5], [True, True], 0.9))


def test_slabs_of_rays_along_them(spark):
    rows = [(0.5, 0.5, 0.5, 1.0, 0.0, 0.0), (0.5, 2.5, 0.5, 1.0, 0.0, 0.0), (-1.0, 0.5, 0.5, 1.0, 0.0, 0.0), (None, 0.5, 0.5, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "ox double, oy double, oz double, vx double, vy double, vz double")
    got = df.withColumns(rays.clip(rays.FROM, ("vx", "vy", "vz"), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))).select("entry", "length").collect()
    assert [tuple(r) for r in got[:3]] == [(0.0, 0.5), (None, None), (1.0, 1.0)]
