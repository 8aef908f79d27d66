"""Hand-computed cases and invariants of the core operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

import pytest

from placelens.functions import geometry as G
from placelens.operators import graph, spatial, tables, vocabulary


def test_positions(spark):
    assert G.position_count((-160, 20, 160), (-30, 30, 30)) == 51
    one = spark.range(1).select(F.lit(17).alias("p"))
    row = one.select(*G.angles_of_position("p", (-160, 20, 160), (-30, 30, 30)).values()).first()
    assert tuple(row) == (160, 0)
    off = one.select(G.position_of_angles(F.lit(5), F.lit(0), (-160, 20, 160), (-30, 30, 30)).alias("x")).first()
    assert off.x == -1


def test_best_class(spark):
    df = spark.createDataFrame([({"Table": 0.2, "Football": 0.3},), ({},), (None,)], "m map<string,double>")
    best = G.best_class(F.col("m"))
    assert [tuple(r) for r in df.select(best["class"], best["confidence"]).collect()] == [("Football", 0.3), ("unknown", 1.0), ("unknown", 1.0)]


def test_upper_median(spark):
    df = spark.createDataFrame([(1, 0), (1, 5), (1, 7), (2, 0)], "u int, depth int")
    assert {r.u: r.depth for r in tables.depth_median(df, ["u"]).collect()} == {1: 7, 2: 0}


def test_session_gap(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0 + dt.timedelta(seconds=s)) for s in (0, 300, 601)], "name string, stamp timestamp")
    got = tables.sessions(df, ["name"], "stamp", 300).orderBy("stamp").select("session").collect()
    assert [r.session for r in got] == [1, 1, 2]


def test_base_62_keys(spark):
    df = spark.createDataFrame([(0,), (61,), (62,), (3843,)], "n long")
    assert [r.k for r in df.select(G.key_from_number("n").alias("k")).collect()] == ["", "0", "ba", "00"]


def test_difference_and_intersection_make_the_whole(spark):
    rnd = random.Random(3)
    pts = [(1, k, rnd.random(), rnd.random(), rnd.random()) for k in range(120)]
    df = spark.createDataFrame(pts, "obs_id int, pt_idx int, x double, y double, z double")
    a, b = df.where("pt_idx % 2 = 0"), df.where("pt_idx % 2 = 1")
    t = 0.0301
    near = {p[1] for p in pts if p[1] % 2 == 0 and any(sum((p[i] - q[i]) ** 2 for i in (2, 3, 4)) <= t for q in pts if q[1] % 2)}
    assert {r.pt_idx for r in spatial.cloud_intersection(a, b, t, ["obs_id"]).collect()} == near
    assert {r.pt_idx for r in spatial.cloud_difference(a, b, t, ["obs_id"]).collect()} == {p[1] for p in pts if p[1] % 2 == 0} - near


def test_components_and_clusters(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (None, 3)]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {n: find(n) for n in {x for e in edges if None not in e and e[0] != e[1] for x in e}}
    assert graph.components(df.limit(0)).count() == 0


def test_euclidean_clusters_against_all_pairs(spark):
    rnd = random.Random(9)
    pts = [(1, k, rnd.random() * 2, rnd.random() * 2, rnd.random()) for k in range(150)]
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(150):
        for j in range(i):
            if sum((pts[i][k] - pts[j][k]) ** 2 for k in (2, 3, 4)) <= 0.21**2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    size = {}
    for k in range(150):
        size[find(k)] = size.get(find(k), 0) + 1
    want = {k: find(k) for k in range(150) if 3 <= size[find(k)] <= 1000}
    df = spark.createDataFrame(pts, "obs_id int, pt_idx int, x double, y double, z double")
    got = {r.pt_idx: r.cluster for r in graph.euclidean_clusters(df, 0.21, 3, 1000, ["obs_id"]).collect()}
    assert got == want


def test_suppression_is_greedy(spark):
    rnd = random.Random(4)
    results = [(g, rnd.randrange(20), k, [rnd.randrange(12), rnd.randrange(12)]) for g in range(3) for k in range(12)]
    want = set()
    for g in range(3):
        kept = []
        for _, s, k, m in sorted((r for r in results if r[0] == g), key=lambda r: (r[1], r[2])):
            if not any(set(m) & set(x) for x in kept):
                kept.append(m)
                want.add((g, k))
    df = spark.createDataFrame(results, "g int, score int, key int, parts array<int>")
    got = tables.suppress_overlapping(df, ["g"], "score", "key", "parts")
    assert {(r.g, r.key) for r in got.collect()} == want


def test_suppression_ends_on_nulls_ties_and_empty_members(spark):
    rows = [
        (None, 1, 1, [1, 2]), (None, 2, 2, [2, 3]), (None, 3, 3, [3]), ("a", 5, 1, []), ("a", 5, 2, None), ("a", 5, None, [7]), ("a", 5, 3, [7, 8]), ("a", 5, 4, [8]),
        ("a", None, 9, [8, 9]), ("b", 1, 1, [1]), ("b", 1, 1, [1]), ("b", 2, 1, [1]), ("b", 3, 6, [None, 4]), ("b", 4, 5, [None]),
    ]
    df = spark.createDataFrame(rows, "g string, score int, key int, parts array<int>")
    got = sorted(map(str, tables.suppress_overlapping(df, ["g"], "score", "key", "parts").collect()))
    kept, used = [], set()
    for g, score, key, parts in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2] is not None, r[2] or 0)):
        here = {(g, m) for m in parts or []}
        if not here & used or (g, score, key) in kept:
            kept.append((g, score, key))
            used |= here
    assert got == sorted(f"Row(g={g!r}, score={s}, key={k})" for g, s, k in kept)
    assert tables.suppress_overlapping(df.limit(0), ["g"], "score", "key", "parts").collect() == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_joins_are_joins(spark, how):
    rows = spark.createDataFrame([("hot", k) for k in range(500)] + [("b", 1), ("c", 2), (None, 3)], "k string, v int").repartition(3)
    few = spark.createDataFrame([("hot", "x"), ("b", "y"), ("d", "z")], "k string, w string")
    got, want = tables.salted_join(rows, few, "k", how), rows.join(few, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tree_covers_all_descriptors(spark):
    rnd = random.Random(6)
    e = spark.createDataFrame([(k, k % 5, [rnd.gauss(k % 4, 0.1) for _ in range(4)]) for k in range(80)], "vec_id long, source_id int, vec array<double>")
    tree = vocabulary.train_tree(e, 4, 2, rounds=2)
    per_depth = {r.depth: r.n for r in tree.groupBy("depth").agg(F.sum("n").alias("n")).collect()}
    assert per_depth[0] == per_depth[1] == 80
    paths = vocabulary.assign_paths(e, tree, 2)
    posts = vocabulary.postings(paths)
    v = vocabulary.weighted(posts, vocabulary.node_weights(posts, 80), 1)
    self_score = vocabulary.score(v, v).where("query_id = source_id").collect()
    assert self_score and all(abs(r.score) < 1e-9 for r in self_score)


def test_vocabulary_of_a_first_sweep_beyond_the_bound(spark):
    from placelens.plans import retrieval

    rnd = random.Random(7)
    e = spark.createDataFrame([(k, k % 3, [rnd.gauss(k % 4, 0.1) for _ in range(4)]) for k in range(90)], "vec_id long, source_id int, vec array<double>")
    for most in (20, 30, 60, retrieval.TRAINING):  # a sweep has 30
        posts = retrieval.build_vocabulary(e, most).collect()
        for level in (range(1), range(1, 5), range(5, 21)):
            tf = {s: sum(r.tf for r in posts if r.node_id in level and r.source_id == s) for s in range(3)}
            assert tf == {0: 30, 1: 30, 2: 30}


def test_the_vocabulary_is_not_lost_as_the_embeddings_grow(spark, tmp_path):
    from placelens.plans import catalog

    rnd = random.Random(8)
    rows = [(k, [rnd.gauss(k % 4, 0.1) for _ in range(4)], 0) for k in range(201 * 50)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    tf = {r.depth: r.n for r in catalog.QUERIES["v19_build_vocabulary"](spark, str(tmp_path)).groupBy(F.when(F.col("node_id") == 0, 0).when(F.col("node_id") < 5, 1).otherwise(2).alias("depth")).agg(F.sum("tf").alias("n")).collect()}
    assert tf == {0: 201 * 50, 1: 201 * 50, 2: 201 * 50}


def test_as_of_takes_the_latest_before(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([("a", t(5), 1), ("a", t(1), 2), ("b", t(9), 3)], "k string, stamp timestamp, id int")
    right = spark.createDataFrame([("a", t(2), 0.5), ("a", t(5), 0.7), ("b", t(10), 0.1)], "k string, stamp timestamp, v double")
    got = {r.id: r.v for r in tables.as_of(left, right, ["k"], "stamp", "v").collect()}
    assert got == {1: 0.7, 2: None, 3: None}
