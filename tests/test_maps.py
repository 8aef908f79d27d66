"""Maps of places: matching, versions, compaction and repeated batches against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from placelens.plans.projections import binned
from placelens.streaming import maps as M

T0 = dt.datetime(2024, 1, 1)
MESSAGE = "kind string, sweep_id long, waypoint string, stamp timestamp, cx double, cy double, cz double, ids array<string>, initialize boolean"
POINT = "sweep_id long, pt_idx long, x double, y double, z double"


def sweep(i, waypoint, minute, x=0.0, y=0.0, z=0.0):
    return ("sweep", i, waypoint, None if minute is None else T0 + dt.timedelta(minutes=minute), x, y, z, None, None)


def reset(minute, ids, initialize):
    return ("reset", None, None, T0 + dt.timedelta(minutes=minute), None, None, None, ids, initialize)


def greedy(sweeps, maps):
    """Sweeps one after another: by name, else the first map in reach, else a map of its own."""
    known = sorted(((made, place, at) for place, made, at in maps), key=lambda k: k[:2])
    out = {}
    for _, i, name, t, x, y, z, *_ in sorted(sweeps, key=lambda s: (s[3], s[1])):
        place = name or None
        if place is None:
            near = [k for k in known if k[0] < (t, i) and sum((a - b) ** 2 for a, b in zip(k[2], (x, y, z))) < M.REACH**2]
            place = min(near)[1] if near else f"at:{i}"
        if all(k[1] != place for k in known):
            known.append(((t, i), place, (x, y, z)))
        out[i] = place
    return out


@pytest.mark.parametrize("seed", [1])
def test_matching_is_that_of_one_sweep_after_another(spark, seed):
    rnd = random.Random(seed)
    spot = lambda: tuple(rnd.uniform(0, 5) for _ in range(2)) + (0.0,)
    maps = [(f"M{k}", (T0 + dt.timedelta(minutes=k), -k), spot()) for k in range(3)]
    sweeps = [sweep(i, rnd.choice(["", None, None, None, "M1", f"N{i % 4}"]), 10 + rnd.randrange(20), *spot()) for i in range(40)]
    record = lambda made, at: (made[0], made[1], *at)
    live = spark.createDataFrame([(p, 0, 0, True, record(m, at), record(m, at)) for p, m, at in maps], M.POINTER)
    got = M.matched(spark.createDataFrame(sweeps, MESSAGE), live)
    assert {r.sweep_id: r.place for r in got.collect()} == greedy(sweeps, maps)


def updates(spark, points, **options):
    table = spark.createDataFrame(points, POINT)
    return M.MapUpdates(M.MapStore(spark, **options), lambda s: table.join(s.select("sweep_id"), "sweep_id", "left_semi"), 0.01, binned)


def held(updates):
    maps = updates.store.maps()
    return set() if maps is None else {(r.place, r.sweep_id, r.pt_idx) for r in maps.collect()}


#: Each sweep shows one point of its own, far from all others and in a direction of its own.
POINTS = [(i, 0, 10.0 + i, 3.0 * i, float(i % 3)) for i in range(12)]
MESSAGES = [
    [sweep(0, "A", 0), sweep(1, "B", 1, x=50.0), sweep(2, "A", 2), sweep(99, "A", 2), sweep(98, "A", None), ("sweep", 11, None, T0, None, 0.0, 0.0, None, None)],
    [sweep(3, None, 10, x=50.5), sweep(4, None, 11, x=90.0), reset(12, ["A"], True), sweep(5, "A", 13)],
    [reset(20, ["B"], False), sweep(6, None, 21, x=50.0), sweep(7, "B", 22, x=50.0)],
    [reset(30, None, True), sweep(8, "A", 31)],
]
WANT = [
    {("A", 0, 0), ("A", 2, 0), ("B", 1, 0)},
    {("A", 2, 0), ("A", 5, 0), ("B", 1, 0), ("B", 3, 0), ("at:4", 4, 0)},
    {("A", 2, 0), ("A", 5, 0), ("at:6", 6, 0), ("B", 7, 0), ("at:4", 4, 0)},
    {("A", 5, 0), ("A", 8, 0), ("at:6", 6, 0), ("B", 7, 0), ("at:4", 4, 0)},
]


def test_batches_resets_and_repeats(spark):
    """Maps after each batch; a batch repeated (as after a lost driver) changes nothing, compacted or not."""
    u = updates(spark, POINTS, buckets=2, keep=1)
    for number, (messages, want) in enumerate(zip(MESSAGES, WANT)):
        batch = spark.createDataFrame(messages, MESSAGE)
        for _ in range(2 if number in (1, 3) else 1):
            u(batch, number)
            assert held(u) == want
    errors = {r.sweep_id for r in u.status().where("status like 'error%'").collect()}
    assert errors == {99, 98, 11} and u.status().count() == 12
    assert max(len(v) for v in u.store._parts().values()) <= 6  # parts that compaction replaced are gone


def test_only_parts_of_the_places_asked_for_are_read(spark):
    store = M.MapStore(spark, buckets=8)
    record = (T0, 1, 0.0, 0.0, 0.0)
    places = [f"P{k}" for k in range(40)]
    points = spark.createDataFrame([(p, k, 0, 1.0, 2.0, 3.0) for k, p in enumerate(places)], "place string, " + POINT)
    store.write(points, spark.createDataFrame([(p, 0, 5, True, record, record) for p in places], M.POINTER), 5)
    one = store.read(store.pointers(6).where("place = 'P7'"))
    assert [r.place for r in one.collect()] == ["P7"] and len({f.rsplit("/", 1)[0] for f in one.inputFiles() if "/points/" in f}) == 1
    assert store.pointers(5).isEmpty() and store.maps(5) is None
    assert store.maps().select("place").distinct().count() == 40


def test_empty_batches(spark):
    u = updates(spark, POINTS)
    u(spark.createDataFrame([], MESSAGE), 0)
    u(spark.createDataFrame([reset(1, [], True), reset(1, ["A"], False)], MESSAGE), 1)
    assert held(u) == set() and u.status().count() == 0
    assert u.store.pointers(1 << 62).where(F.col("live")).isEmpty()
