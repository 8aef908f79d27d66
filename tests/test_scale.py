"""What keeps steps small on large tables: few copies of a point, no broadcast of data, work that does not grow with pairs."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from placelens.operators import graph, spatial as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def cloud(spark, n, seed):
    rng = random.Random(seed)
    rows = [(i % 3, i, *(rng.choice([-0.94, 0.0, 0.47, rng.uniform(-2, 2)]) for _ in "xyz")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g long, i long, x double, y double, z double")


@pytest.mark.parametrize("strict", [False, True])
def test_pairs_meet_in_few_cells(spark, strict):
    (a, da), (b, db) = cloud(spark, 150, 1), cloud(spark, 150, 2)
    near = lambda p, q: (d := sum((p[k] - q[k]) * (p[k] - q[k]) for k in (2, 3, 4))) < 0.47 * 0.47 or not strict and d <= 0.47 * 0.47
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and near(p, q))
    assert want == sorted((r.i, r.b_i) for r in S.pairs_within(da, db, 0.47, ["g"], strict).select("i", "b_i").collect())
    copies = S.in_reach(db, 0.94, 0.47).groupBy("i").count().agg(F.avg("count"), F.max("count")).first()
    assert copies[0] < 14 and copies[1] <= 27


def test_clusters_broadcast_no_points(spark, tmp_path):
    _, points = cloud(spark, 300, 3)
    points.withColumnRenamed("i", "pt_idx").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    for df in (S.pairs_within(p, p, 0.47, ["g"]), S.cloud_difference(p, p, 0.2209, ["g"]), graph.euclidean_clusters(p, 0.47, 1, 1000, ["g"])):
        assert "Broadcast" not in plan(df)


def test_map_update_broadcasts_no_points(spark, sf, tmp_path):
    from placelens.plans.projections import binned
    from placelens.streaming import maps

    _, points = cloud(spark, 200, 4)
    points.select(F.col("g").cast("string").alias("place"), F.col("i").alias("sweep_id"), F.col("i").alias("pt_idx"), "x", "y", "z").write.parquet(str(tmp_path / "m"))
    p = spark.read.parquet(str(tmp_path / "m"))
    assert "BroadcastHashJoin" not in plan(maps.updated(p, p, 0.2209, binned))


def rows_of(spark, sf, path, table):
    """A folder of the given tables in which ``table`` is replaced."""
    import os

    for f in os.listdir(sf):
        if f != f"{table}.parquet":
            os.symlink(f"{sf}/{f}", f"{path}/{f}")
    return spark.read.parquet(f"{sf}/{table}.parquet")


def test_trimmed_weights_count_in_whole_numbers(spark, sf, tmp_path):
    from placelens.plans import catalog

    short = next(n for n in range(10, 10_000, 10) if int(n * 0.7) != n * 7 // 10)
    one = rows_of(spark, sf, tmp_path, "lineitem").limit(1).crossJoin(spark.range(short))
    one.withColumn("l_orderkey", F.col("id").cast("long")).drop("id").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert catalog.QUERIES["p13_trimmed_weight"](spark, str(tmp_path)).agg(F.sum("weight")).first()[0] == short * 7 // 10


def test_rooms_of_a_spot_meet_once(spark, sf, tmp_path, monkeypatch):
    from placelens.plans import catalog, joins

    o = rows_of(spark, sf, tmp_path, "orders")
    rooms = o.limit(1).crossJoin(spark.range(400)).withColumn("o_orderkey", F.col("id") * 70).withColumn("o_custkey", F.when(F.col("id") % 2 == 0, 183).otherwise(63).cast(o.schema["o_custkey"].dataType))
    rooms.drop("id").write.parquet(f"{tmp_path}/orders.parquet")
    pairs, met = [], joins.S.pairs_within
    monkeypatch.setattr(joins.S, "pairs_within", lambda *a, **k: (out := met(*a, **k), pairs.append(out.count()))[0])
    got = catalog.QUERIES["j5_match_place"](spark, str(tmp_path)).collect()
    v = joins.V.observations(spark, str(tmp_path))
    assert len(got) == v.where("run_no = 1").count() and pairs == [1]


def test_eigenvalues_against_numpy(spark):
    """a13: its largest eigenvalues stay under the bound in frames that its SQL calls over it (sign of the product of the three outer terms)."""
    import numpy as np

    from placelens.plans import aggregates as A

    m = [[284.0, 19.0, 17.0], [19.0, 864.0, -17.0], [17.0, -17.0, 441.0]]
    row = spark.createDataFrame([(m[0][0], m[0][1], m[0][2], m[1][1], m[1][2], m[2][2])], "xx double, xy double, xz double, yy double, yz double, zz double")
    got = row.select(*A.symmetric_eigenvalues(*(F.col(k) for k in row.columns))).first()
    assert np.allclose(sorted(got), np.linalg.eigvalsh(np.array(m))) and max(got) < A.A13_MOST


@pytest.mark.parametrize("block", [16, 2048])
def test_histograms_meet_in_blocks(spark, block):
    from placelens.operators import histograms as H

    rng = random.Random(5)
    rows = [(i, b, rng.randint(1, 4) / 8) for i in range(90) for b in rng.sample(range(40), rng.randint(1, 6))]
    h = spark.createDataFrame(rows, "id long, bin int, w double")
    w = {}
    for i, b, v in rows:
        w.setdefault(i, {})[b] = v
    score = {(i, j): sum(min(w[i][b], w[j][b]) for b in w[i] if b in w[j]) for i in w for j in w if i != j and set(w[i]) & set(w[j])}
    told = lambda df: {(r.id, r.other): r.score for r in df.collect()}
    assert told(H.overlaps(h, h, 6, block=block)) == score
    over = {p: s for p, s in score.items() if s > 0.25}
    assert told(H.overlaps(h, h, 6, 0.25, block=block)) == over
    best = told(H.overlaps(h.where("id % 3 = 0"), h, 6, 0.25, most=2, both=True, block=block))
    assert best.items() <= over.items()
    for i in w:
        ends = sorted((-s, j) for (q, j), s in over.items() if q == i) if i % 3 == 0 else sorted((-s, q) for (q, j), s in over.items() if j == i and q % 3 == 0)
        assert {(i, j) if i % 3 == 0 else (j, i) for _, j in ends[:2]} <= best.keys()


def test_histogram_search_shuffles_no_pairs(spark, sf):
    from placelens.plans import catalog

    assert "FlatMapCoGroups" in plan(catalog.QUERIES["j18_histogram_search"](spark, sf))


def test_speckle_filter_aggregates_no_copies(spark, sf):
    from placelens.plans import catalog

    # the distinct voxels of both sides only, none of the copies around them
    assert plan(catalog.QUERIES["a24_speckle_filter"](spark, sf)).count("HashAggregate") <= 4


def test_fusion_round_shuffles_histograms_once(spark, sf):
    """No copy of a histogram for each block of the others."""
    from placelens.plans import catalog

    at = plan(catalog.QUERIES["m13_fusion_round"](spark, sf))
    assert "FlatMapCoGroups" not in at and "explode" not in at and "CartesianProduct" in at


@pytest.mark.parametrize("block,part", [(16, 32), (1024, 8192)])
@pytest.mark.parametrize("most", [1, 3, 200])
def test_nearest_histograms_are_those_of_all_pairs(spark, block, part, most):
    """Many ties; ids 90 to 95 are alike, and 96 shares nothing with the others."""
    from placelens.operators import histograms as H

    rng = random.Random(6)
    w = {i: {b: rng.randint(1, 4) / 8 for b in rng.sample(range(40), rng.randint(1, 6))} for i in range(90)}
    w |= {i: {7: 1 / 3, 9: 2 / 3} for i in range(90, 96)} | {96: {70000: 1.0}}
    h = spark.createDataFrame([(i, b, v) for i, bins in w.items() for b, v in bins.items()], "id long, bin int, w double")
    want = {}
    for i in w:
        score = {j: round(sum(min(v, w[j][b]) for b, v in w[i].items() if b in w[j]), 6) for j in w if i != j and w[i].keys() & w[j].keys()}
        if over := sorted((-s, j) for j, s in score.items() if s > 0.25)[:most]:
            want[i] = [(j, -s) for s, j in over]
    assert {r.id: list(zip(r.others, r.scores)) for r in H.nearest(h, 6, 0.25, most, block, part).collect()} == want
