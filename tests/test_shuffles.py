"""What is shuffled: pairs of points meet once, and what a task can settle alone stays there."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from placelens.operators import graph as N, spatial as S
from tests.test_scale import plan


def by_point(df) -> list[str]:
    """Exchanges by single points of the left side."""
    return re.findall(r"Exchange hashpartitioning\([^)]*[( ]pt_idx#[^)]*\)", plan(df))


@pytest.mark.parametrize("name", ["g5_edge_convexness", "j11_segments_covering", "j19_mutual_matches", "j3_nearest"])
def test_pairs_of_a_point_are_settled_in_its_cell(spark, sf, name):
    assert not by_point(__spark_entry__.queries()[name](spark, sf))


def test_a_point_has_few_copies(spark):
    p = spark.range(2000).select(F.lit(0).alias("g"), F.col("id").alias("i"), *((F.rand(k) * 40).alias(c) for k, c in enumerate("xyz")))
    at = plan(S.cloud_difference(p, p, 0.2209, ["g"]))
    edges = {float(e) for e in re.findall(r"/ (\d+\.\d+)", at)}
    assert len(edges) == 1
    assert S.in_reach(p, edges.pop(), 0.47).groupBy("i").count().agg(F.avg("count")).first()[0] < 6


@pytest.mark.parametrize("carried", [N.CARRIED, 0])
def test_components_of_groups_end_after_a_round(spark, monkeypatch, carried):
    """Chains in random order, groups over several batches, a null group, loops, repeats and null ends."""
    rng = random.Random(8)
    rows = [(g, i, i + 1) for g in (None, 1, 2) for i in range(3000) if i % 1000 != 999] + [(1, 5, 5), (2, None, 7), (2, 8, None), (1, 0, 1), (3, -2, 4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, src long, dst long").repartition(3)
    monkeypatch.setattr(N, "CARRIED", carried)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    rounds = []
    monkeypatch.setattr(N, "materialize", lambda t, tag, met=N.materialize: (rounds.append(tag), met(t, tag))[1])
    try:
        got = {(r.g, r.node): r.component for r in N.components_by(df, ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(g, i): i // 1000 * 1000 for g in (None, 1, 2) for i in range(3000)} | {(3, -2): -2, (3, 4): -2}
    assert not carried or len(rounds) == 2


def test_planar_rejection_shuffles_no_hypotheses(spark, sf):
    """Points meet their cluster's planes once, not once for each of the twenty."""
    at = plan(__spark_entry__.queries()["f12_reject_planar"](spark, sf))
    assert not re.findall(r"Exchange hashpartitioning\([^)]*[( ]h#[^)]*\)", at)


def test_few_points_of_a_cluster_are_gathered(spark):
    df = spark.range(4000).coalesce(1).select((F.col("id") % 2).alias("g"), F.struct("id").alias("e"), F.array(*(F.xxhash64("id", F.lit(h)) for h in range(4))).alias("o"))
    got = N._smallest(df, 3).select("g", "e.id").collect()
    want = {(r.g, r.id) for h in range(4) for g in (0, 1) for r in df.where(F.col("g") == g).orderBy(F.col("o")[h]).limit(3).select("g", "e.id").collect()}
    assert len(got) <= 24 and want == {(r.g, r.id) for r in got}


def test_fusion_leaves_only_its_labels(spark, monkeypatch, tmp_path):
    """Tables of rounds do not pile up in the shared folder."""
    from placelens import scratch
    from placelens.operators import fusion as U

    rows = [(m, b, 1) for m in range(12) for b in (m // 4 * 10, m // 2 * 100 + 7, m // 4 * 10 + 1)]
    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    got = {r.member: r.model for r in U.fuse(spark.createDataFrame(rows, "model long, bin int, n long"), 0.3).collect()}
    assert got == {m: m // 4 * 4 for m in range(12)}
    assert [p.name.split("-")[0] for p in tmp_path.iterdir() if p.is_dir()] == ["labels"]
