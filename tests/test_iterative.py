"""Queries and operators without SQL, against plain Python."""

import collections
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens.operators import fusion as U, graph as N, poses as P, rounds as D, vocabulary as B
from placelens.plans import catalog, models as M, retrieval as R
from placelens.scratch import shared_dir
from placelens.sources import catalog as C, views as V
from placelens.streaming import jobs as J


def rows(df):
    return df.collect()


def test_w7_patrols(spark, sf):
    groups = collections.defaultdict(list)
    for r in rows(V.observations(spark, sf)):
        groups[r.log_name, r.start_ts.date()].append((r.start_ts, r.obs_id, r.waypoint))
    want = {}
    for (log, _), seen in groups.items():
        patrol, places = 0, []
        for _, obs, place in sorted(seen):
            if place in places:
                patrol, places = patrol + 1, []
            want[obs] = (log, patrol, len(places))
            places.append(place)
    got = {r.obs_id: (r.log_name, r.patrol, r.room) for r in rows(catalog.QUERIES["w7_assign_patrol"](spark, sf))}
    assert got == want


def test_batches_replace_what_is_repeated(spark):
    store = J.Batches(spark, "again")
    one = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    store.write(one, 0)
    store.write(one.where("k = 1").withColumn("v", F.lit("b")), 1)
    store.write(one.where("k = 1").withColumn("v", F.lit("b")), 1)  # repeated after a break
    assert sorted((r.k, r.v) for r in rows(store.newest("k"))) == [(1, "b"), (2, "a")]
    assert sorted((r.k, r.v) for r in rows(store.newest("k", 1))) == [(1, "a"), (2, "a")] and store.newest("k", 0) is None


def test_pcd_headers(spark):
    root = f"{shared_dir(spark)}/pcd-test".removeprefix("file:")
    os.makedirs(f"{root}/obs_id=7", exist_ok=True)
    head = "# .PCD v.7\nVERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 2\nDATA binary\n"
    colour = struct.unpack("<f", struct.pack("<I", 0x010203))[0]
    with open(f"{root}/obs_id=7/cloud.pcd", "wb") as f:
        f.write(head.encode() + struct.pack("<8f", 1, 2, 3, colour, 4, 5, 6, colour))
    with open(f"{root}/plain.pcd", "w") as f:
        f.write("VERSION .7\nFIELDS intensity z y x\nSIZE 4 4 4 4\nTYPE U F F F\nCOUNT 1 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA ascii\n9 3.5 2.5 1.5\n")
    got = sorted(tuple(r) for r in rows(C.ingest_pcd(spark, root)))
    assert [r[:5] for r in got] == [(-1, 1, 1.5, 2.5, 3.5), (7, 1, 1.0, 2.0, 3.0), (7, 2, 4.0, 5.0, 6.0)]
    assert [r[5:] for r in got] == [(None, None, None), (1, 2, 3), (1, 2, 3)]


def test_pixels_are_found_by_table_or_search():
    """All candidates of a block ask at once (one by one they took four times as long); a sparse image is searched."""
    rng = np.random.default_rng(3)
    for reach in (20, 1 << 30):
        u, v = rng.integers(-reach, reach, (2, 300))
        u, v = np.unique(np.stack([u, v]), axis=1)
        image = P.Pixels(u, v)
        assert image.dense == (reach == 20)
        places = {(a, b): k for k, (a, b) in enumerate(zip(u.tolist(), v.tolist()))}
        asked = np.concatenate([np.stack([u, v]), rng.integers(-25, 25, (2, 500)), [[np.nan, np.inf, -np.inf, 1e300], [0, 0, np.nan, 1]]], axis=1)
        want = [places.get((a, b), -1) for a, b in asked.T.tolist()]
        assert image.find(*asked.reshape(2, 1, -1))[0].tolist() == want and image.find(*asked).max() >= 0


def test_clouds_share_folders(spark):
    """A file for each observation, but not a folder: those are made and listed one by one."""
    root = f"{shared_dir(spark)}/pcd-many".removeprefix("file:")
    want = [(obs, k, obs / 8, k / 4, -1.5, obs % 200, k, 255) for obs in (*range(60), -7, 123_456) for k in range(1, 1 + abs(obs) % 5 + 1)]
    C.write_pcd(spark.createDataFrame(want, "obs_id long, pt_idx long, x double, y double, z double, r int, g int, b int"), root)
    files = [f"{at}/{f}" for at, _, names in os.walk(root) for f in names if f.endswith(".txt")]
    assert len(files) == 62 and len({os.path.dirname(f) for f in files}) == 3
    assert sorted(tuple(r) for r in rows(C.ingest_pcd(spark, root))) == sorted(want)


def packed(data: bytes) -> bytes:
    """LZF data by plain search: the longest earlier copy of three or more bytes, else runs of up to 32."""
    out, run, at = bytearray(), bytearray(), 0

    def flush():
        for k in range(0, len(run), 32):
            out.extend([len(run[k : k + 32]) - 1, *run[k : k + 32]])
        run.clear()

    while at < len(data):
        length, back = 0, 0
        for start in range(max(0, at - 8192), at):
            k = 0
            while at + k < len(data) and k < 264 and data[start + k] == data[at + k]:
                k += 1
            if k > length:
                length, back = k, at - start - 1
        if length < 3:
            run.append(data[at])
            at += 1
            continue
        flush()
        n = length - 2
        out.extend([(min(n, 7) << 5) | back >> 8, *([n - 7] if n >= 7 else []), back & 255])
        at += length
    flush()
    return bytes(out)


def test_pcd_compressed(spark):
    rnd = np.random.default_rng(2)
    root = f"{shared_dir(spark)}/pcd-packed".removeprefix("file:")
    os.makedirs(f"{root}/obs_id=3", exist_ok=True)
    n = 200
    x, y, z = np.repeat(np.arange(20, dtype="<f4"), 10), np.zeros(n, "<f4"), rnd.random(n).astype("<f4")
    two, rgb = rnd.integers(0, 9, (n, 2)).astype("<u2"), np.full(n, 0x0A0B0C, "<u4")
    flat = b"".join(v.tobytes() for v in (x, y, two, z, rgb))
    head = f"VERSION .7\nFIELDS x y normal z rgb\nSIZE 4 4 2 4 4\nTYPE F F U F U\nCOUNT 1 1 2 1 1\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA binary_compressed\n"
    body = packed(flat)
    assert len(body) < len(flat) and C.unpacked(body, len(flat)) == flat
    with open(f"{root}/obs_id=3/cloud.pcd", "wb") as f:
        f.write(head.encode() + struct.pack("<II", len(body), len(flat)) + body)
    got = sorted(tuple(r) for r in rows(C.ingest_pcd(spark, root)))
    assert got == [(3, k + 1, float(x[k]), 0.0, float(z[k]), 10, 11, 12) for k in range(n)]
    with pytest.raises(ValueError):
        C.unpacked(body, len(flat) + 1)
    with pytest.raises(ValueError):
        C.unpacked(bytes([32, 5]), 3)


def test_soft_words(spark):
    """Near and closest words, also of a vocabulary in slices, against plain distances; odd vectors have none."""
    rnd = np.random.default_rng(6)
    vecs = rnd.standard_normal((80, 4)).round(1)
    words = np.vstack([rnd.standard_normal((30, 4)).round(1), vecs[:2], vecs[:1]])  # the last repeats another
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan")] * 4), (103, [1.0]), (104, [])]
    e = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)] + odd, "vec_id long, vec array<double>")
    w = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(words)] + [(99, None)], "node_id long, centroid array<double>")
    d = np.sqrt(np.square(vecs[:, None] - words[None]).sum(axis=2))
    for most in (1000, 7):
        near = {(r.vec_id, r.word) for r in rows(B.word_distances(e, w, 1.5, most=most))}
        assert near == {(int(a), int(b)) for a, b in zip(*np.nonzero(d < 1.5))}
        best = {r.vec_id: r.word for r in rows(B.word_distances(e, w, None, most=most))}
        assert best == {k: int(row.argmin()) for k, row in enumerate(d)}
    frame = e.withColumn("pair", F.lit(1))
    got = sorted((r.vec_id, r.b_vec_id) for r in rows(B.soft_matches(frame, frame, w, 1.5)))
    assert got == sorted((a, b) for a in range(80) for b in range(80) if d[a, d[b].argmin()] < 1.5)


def test_f12_planes(spark):
    rnd = np.random.default_rng(3)
    flat = [(1, 1, k, float(x), float(y), float(0.5 * x - y)) for k, (x, y) in enumerate(rnd.random((60, 2)))]
    round_ = [(1, 2, k, *map(float, v / np.linalg.norm(v))) for k, v in enumerate(rnd.standard_normal((60, 3)))]
    few = [(1, 3, k, 0.0, 0.0, float(k)) for k in range(2)]  # no plane through two points
    df = spark.createDataFrame(flat + round_ + few, "obs_id int, cluster int, pt_idx int, x double, y double, z double")
    assert sorted(r.cluster for r in rows(N.reject_planar(df, ["obs_id", "cluster"], 0.02, 0.9, 10))) == [2, 3]


def test_g7_contraction(spark):
    rnd = np.random.default_rng(9)
    edges = [(g, int(a), int(b), float(w)) for g in range(3) for a, b, w in zip(rnd.integers(0, 25, 120), rnd.integers(0, 25, 120), rnd.random(120)) if a != b]
    got = rows(N.contract_edges(spark.createDataFrame(edges, "g int, src int, dst int, w double"), ["g"], 0.6))
    for g in range(3):
        label = {n: n for e in edges if e[0] == g for n in e[1:3]}
        while True:
            total = collections.defaultdict(lambda: [0.0, 0])
            for _, a, b, w in (e for e in edges if e[0] == g):
                if label[a] != label[b]:
                    pair = total[min(label[a], label[b]), max(label[a], label[b])]
                    pair[0] += w
                    pair[1] += 1
            strong = [p for p, (w, n) in total.items() if n > 1.5 and w / n > 0.6]
            if not strong:
                break
            root = {n: n for n in label.values()}
            while any(root[a] != root[b] for a, b in strong):
                for a, b in strong:
                    root[a] = root[b] = min(root[a], root[b])
            label = {n: root[c] for n, c in label.items()}
        merged = {r.node: r.component for r in got if r.g == g}
        assert {n: merged.get(n, n) for n in label} == label


def grow(query, part, near, hint):
    distance = lambda t: 1 - sum(min(v, t.get(n, 0)) for n, v in query.items()) / max(sum(query.values()), sum(t.values()), 1e-12)
    taken, total = [hint], dict(part[hint])
    while True:
        tried = []
        for j in sorted({b for a in taken for b in near.get(a, ())} - set(taken)):
            both = collections.Counter(total)
            for n, v in part[j].items():
                both[n] += v
            tried.append((distance(both), j, dict(both)))
        if not tried or min(tried)[0] >= distance(total):
            return sorted(taken), distance(total)
        _, j, total = min(tried, key=lambda t: t[:2])
        taken.append(j)


def test_v13_and_v14_groups(spark, sf):
    vector = collections.defaultdict(dict)
    for r in rows(R.given_vectors(spark, sf)):
        vector[r.source_id][r.node_id] = r.v
    score = {(r.query_id, r.source_id): r.score for r in rows(B.score(*[R.given_vectors(spark, sf)] * 2))}
    got = {(r.query_id, r.group_id): (r.subgroups, r.score) for r in rows(catalog.QUERIES["v13_grow_group"](spark, sf))}
    assert len({q for q, _ in got}) == len(vector)
    for (q, g), (members, value) in got.items():
        own = {s: vector[s] for s in vector if s % 10 == g}
        near = {s: [t for t in (s - 10, s + 10) if t in own] for s in own}
        hint = min(own, key=lambda s: (score.get((q, s), 9), s))
        taken, distance = grow(vector[q], own, near, hint)
        assert abs(value - distance) < 2e-4 and (members == ",".join(map(str, taken)) or abs(value - distance) < 1e-4)
    best = collections.defaultdict(list)
    for r in rows(catalog.QUERIES["v14_query_grouped"](spark, sf)):
        best[r.query_id].append((r["rank"], r.score, r.group_id))
    for q, found in best.items():  # groups share no members, so that the five best stay
        want = sorted((s, g) for (p, g), (_, s) in got.items() if p == q)[:5]
        assert [s for _, s, _ in sorted(found)] == [s for s, _ in want]


def fused(counts, least, accepted=lambda a, b: True):
    """All pairs are compared again in each round."""
    counts = {m: collections.Counter(c) for m, c in counts.items()}
    label = {m: m for m in counts}
    while True:
        share = lambda a, b: round(sum(min(n / sum(a.values()), b[k] / sum(b.values())) for k, n in a.items() if k in b), 6)
        best = {}
        for a in counts:
            found = sorted((-share(counts[a], counts[b]), b) for b in counts if b != a and accepted(a, b))
            if found and -found[0][0] > least:
                best[a] = found[0][1]
        merges = [(a, b) for a, b in best.items() if a < b and best.get(b) == a]
        if not merges:
            return label
        for a, b in merges:
            counts[a] += counts.pop(b)
            label = {m: a if x == b else x for m, x in label.items()}


def test_m13_searches_only_what_changed(spark):
    rng = np.random.default_rng(4)
    rows_ = [(int(m), int(b), int(rng.integers(1, 6))) for m in range(24) for b in {0, *(m // 3 * 5 + rng.integers(0, 9, 6)).tolist()}]
    counts = collections.defaultdict(collections.Counter)
    for m, b, n in rows_:
        counts[m][b] += n
    want = fused(counts, 0.35, lambda a, b: (a + b) % 3 > 0)
    table = spark.createDataFrame(rows_, "model long, bin long, n long").coalesce(1)
    some, every = [], []
    accepted = lambda pairs, _: pairs.where("(model + other) % 3 > 0")
    got = {everything: {r.member: r.model for r in rows(U.fuse(table, 0.35, accepted, everything, n))} for everything, n in ((False, some), (True, every))}
    assert got[False] == got[True] == want and len(set(want.values())) < 20
    assert len(some) == len(every) > 2 and sum(some) < sum(every)


def test_m13_poses_decide(spark, sf):
    counts = collections.defaultdict(collections.Counter)
    for r in rows(M.model_counts(spark, sf)):
        counts[r.model][r.bin] += r.n
    pairs = spark.createDataFrame([(a, b) for a in counts for b in counts if a < b], "model long, other long")
    label = spark.createDataFrame([(a, a) for a in counts], "member long, model long")
    kept = M.agreeing(spark, sf)(pairs, label).count()
    assert 0 < kept < pairs.count()  # both answers occur
    alone = fused(counts, M.LEAST)
    got = {r.member: r.model for r in rows(U.fuse(M.model_counts(spark, sf), M.LEAST, M.agreeing(spark, sf)))}
    assert got.keys() == alone.keys() and all(got[m] <= m for m in got)


def test_m13_fuses_until_nothing_changes(spark, sf):
    counts = collections.defaultdict(collections.Counter)
    for r in rows(M.model_counts(spark, sf)):
        counts[r.model][r.bin] += r.n
    assert {r.member: r.model for r in rows(catalog.QUERIES["m13_fuse_models"](spark, sf))} == fused(counts, M.LEAST)


def random_models(rng, kind):
    n, bins = int(rng.integers(2, 40)), int(rng.integers(2, 24))
    near = rng.integers(0, 8, (4, bins))[rng.integers(0, 4, n)] + rng.integers(0, 2, (n, bins))
    some = [rng.integers(0, 4, (n, bins)), rng.multinomial(60, np.ones(bins) / bins, size=n), near, (rng.random((n, bins)) < 0.2) * rng.integers(1, 3, (n, bins))][kind]
    return some[some.sum(axis=1) > 0].astype(np.int32)


@pytest.mark.parametrize("kind", range(4))
def test_m13_rounds_in_a_task_are_those_of_all_pairs(kind):
    """Lists of few candidates, and ends before the last round, after which all are searched again."""
    rng = np.random.default_rng(kind)
    early = 0
    for _ in range(40):
        n = first = random_models(rng, kind)
        least, listed, ids, label, done = float(rng.choice([0.0, 0.3003, 0.5, 0.7])), int(rng.choice([1, 2, 8])), np.arange(len(n)), np.arange(len(n)), False
        while not done:
            w = n / n.sum(axis=1, keepdims=True)
            others, scores = np.full((len(n), listed), -1), np.full((len(n), listed), -np.inf)
            for i in range(len(n)):
                s = np.minimum(w, w[i]).sum(axis=1)
                best = sorted((-round(s[j], 6), j) for j in range(len(n)) if j != i and s[j] > 0 and round(s[j], 6) > least)[:listed]
                others[i, : len(best)], scores[i, : len(best)] = [j for _, j in best], [-v for v, _ in best]
            rounds = D.Rounds(n.copy(), others, scores, least, *((1 << 22, 1 << 26) if rng.random() < 0.5 else (int(rng.integers(1, 8)) * len(n), int(rng.integers(1, 400)))))
            done, ends = rounds.run(), rounds.ends()
            early += not done
            label = ids[ends[np.searchsorted(ids, label)]]
            kept, merged = np.unique(ends), np.zeros_like(n)
            np.add.at(merged, ends, n)
            n, ids = merged[kept], ids[kept]
        assert dict(enumerate(label.tolist())) == fused({m: {b: int(v) for b, v in enumerate(row) if v} for m, row in enumerate(first)}, least)
    assert early


def test_m13_one_model_takes_in_the_others_one_by_one(spark, monkeypatch):
    """There are nearly as many rounds as models, but not a search and a table for each."""
    rng = np.random.default_rng(2)
    rows_ = [(int(m) * 7 - 50, int(b), int(n)) for m, row in enumerate(rng.multinomial(300, np.ones(40) / 40, size=60)) for b, n in enumerate(row) if n]
    counts = collections.defaultdict(collections.Counter)
    for m, b, n in rows_:
        counts[m][b] += n
    tags, met = [], U.materialize
    monkeypatch.setattr(U, "materialize", lambda df, tag: (tags.append(tag), met(df, tag))[1])
    table = spark.createDataFrame(rows_, "model long, bin int, n long")
    assert {r.member: r.model for r in rows(U.fuse(table, 0.82))} == fused(counts, 0.82)
    assert tags.count("histograms") == 1
    monkeypatch.setattr(D, "HELD", 300)  # the task ends early
    assert {r.member: r.model for r in rows(U.fuse(table, 0.82))} == fused(counts, 0.82)
    assert 2 < tags.count("histograms") < 20


def pixels_of(spark, seed, n):
    rng = np.random.default_rng(seed)
    seen = {(f, int(rng.integers(0, 64)), int(rng.integers(0, 48))) for f in range(3) for _ in range(n)}
    table = [(f, u, v, float(rng.integers(5, 40)) / 20, float(rng.choice([0.5, 1.0])), bool(rng.integers(0, 4))) for f, u, v in sorted(seen)]
    return spark.createDataFrame(table, "frame_id long, u int, v int, z double, w double, masked boolean")


def test_all_hypotheses_of_a_pair_agree_with_one_at_a_time(spark):
    image, poses = pixels_of(spark, 3, 400), M.candidate_poses()
    pairs = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (7, 1), (0, 9)], "src long, dst long")
    got = {(r.src, r.dst, r.k): (r.score, r.occ) for r in rows(P.hypothesis_scores(image, pairs, poses, M.SMALL))}
    assert {k[:2] for k in got} <= {(0, 1), (1, 0), (2, 1), (0, 9)} and all(v == (0, 0) for k, v in got.items() if k[1] == 9)
    ks = [0, 25, 31, 60, 99, 100, 149]
    each = spark.createDataFrame([(a, b, poses[k].tolist(), k) for a, b in ((0, 1), (1, 0), (2, 1)) for k in ks], "src long, dst long, m array<double>, k int")
    met = 0
    for k in ks:
        one = {(r.src, r.dst): (r.score, r.occ) for r in rows(P.posed_scores(image, each.where(F.col("k") == k), M.SMALL))}
        met += len(one)
        assert {p: got[(*p, k)] for p in one} == one
    assert met > 15


def test_trees_and_words(spark, sf):
    tree = rows(catalog.QUERIES["v1_train_tree"](spark, sf))
    total = V.descriptors(spark, sf).count()
    for depth in range(1, R.DEPTH + 1):
        assert sum(r.n for r in tree if r.depth == depth) <= total
    parents = {r.node_id for r in tree} | {0}
    assert all(r.parent_id in parents for r in tree if r.depth > 1) and sum(r.n for r in tree if r.depth == 1) == total
    words = rows(catalog.QUERIES["v21_flat_words"](spark, sf))
    assert sum(r.n for r in words) == total and len(words) <= 8
    posts = rows(catalog.QUERIES["v19_build_vocabulary"](spark, sf))
    assert sum(r.tf for r in posts if r.node_id == 0) == total


def test_s6_clusters_come_back(spark, sf):
    first, again = (sorted(map(str, rows(catalog.QUERIES["s6_read_clusters"](spark, sf)))) for _ in range(2))
    assert first and first == again


@pytest.mark.parametrize("name", ["g1_euclidean_clusters", "g3_dynamic_clusters"])
def test_clusters_have_their_size(spark, sf, name):
    found = rows(catalog.QUERIES[name](spark, sf))
    assert found
    if name.startswith("g1"):
        size = collections.Counter((r.obs_id, r.cluster) for r in found)
        assert all(size[r.obs_id, r.cluster] == r.size >= 5 for r in found)
    else:
        assert all(r.n >= 3 for r in found)


def test_every_answer_occurs(spark, sf):
    occurs = lambda name, column: {r[0] for r in rows(catalog.QUERIES[name](spark, sf.replace("sf0.001", "sf0.01")).select(column).distinct())}
    assert occurs("a13_normal_scatter", "usable") == {True, False}
    assert occurs("m4_accept_if_better", "accepted") == {True, False}
    poses = occurs("m5_choose_pose", F.col("pose").isNull())
    assert False in poses
