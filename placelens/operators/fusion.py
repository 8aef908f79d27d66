"""Models that are each other's best candidate are merged, until none is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from placelens.operators import histograms as H, rounds as R
from placelens.scratch import discard, materialize


def weighted(counts: DataFrame) -> DataFrame:
    """(model, bin, w): a bin's share of its model."""
    size = counts.groupBy("model").agg(F.sum("n").alias("total"))
    return counts.join(size, "model").select("model", "bin", (F.col("n") / F.col("total")).alias("w"))


def similar(h: DataFrame, least: float, work: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(model, other, score): for the models of ``work`` (all without it) those whose histograms share more than ``least``.

    With ``most`` at least the best so many of each model and of each other; blocks of
    models are compared as a whole, so that no pairs are shuffled but those told.
    """
    named = h.withColumnRenamed("model", "id")
    mine = named.join(work.select(F.col("model").alias("id")), "id", "left_semi") if work is not None else named
    return H.overlaps(mine, named, 6, least, most, both=work is not None).withColumnRenamed("id", "model")


def candidates(h: DataFrame, least: float, most: int) -> DataFrame:
    """(model, others, scores): the ``most`` best of each model, in order."""
    return H.nearest(h.withColumnRenamed("model", "id"), 6, least, most).withColumnRenamed("id", "model")


def best_of(pairs: DataFrame) -> DataFrame:
    """(model, other, score): the best candidate of each model, ties to the smaller one."""
    best = pairs.groupBy("model").agg(F.max(F.struct("score", (-F.col("other")).alias("o"))).alias("m"))
    return best.select("model", (-F.col("m.o")).alias("other"), F.col("m.score").alias("score"))


def similar_models(counts: DataFrame, nearest: int, least: float) -> DataFrame:
    """(model, other): for each model the best of its ``nearest`` candidates, if their histograms share more than ``least``."""
    h = materialize(weighted(counts), "histograms")
    # the best of the nearest is the best of all
    return candidates(h, least, min(nearest, 1)).select("model", F.col("others")[0].alias("other"))


def mutual(best: DataFrame) -> DataFrame:
    """(model, other), model < other: pairs that are each other's best candidate."""
    back = best.select(F.col("other").alias("model"), F.col("model").alias("other"))
    return best.where("model < other").join(back, ["model", "other"], "left_semi").select("model", "other")


def fusion_outcome(assigned: DataFrame) -> DataFrame:
    """(pair, outcome, parts) of (pair, model, part): one part merges both models, parts equal to the models change nothing, others split them."""
    n = assigned.groupBy("pair", "model").agg(F.countDistinct("part").alias("n")).groupBy("pair").agg(F.max("n").alias("n"))
    parts = assigned.groupBy("pair").agg(F.countDistinct("part").alias("parts")).join(n, "pair")
    return parts.select("pair", F.when(F.col("parts") == 1, "merge").when(F.col("n") == 1, "keep").otherwise("split").alias("outcome"), "parts")


#: Candidates of each model that a task of many rounds begins with.
LISTED = 8


def fuse_in_task(now: DataFrame, label: DataFrame, bins: int, points: int, least: float) -> DataFrame:
    """``fuse`` without ``accepted``: all models are searched at once, then rounds run in one task, for as long as what it holds serves it."""
    done = False
    while not done:
        h = materialize(weighted(now), "histograms")
        lists = materialize(candidates(h, least, LISTED), "candidates")
        models = label.select("model").distinct().count()
        ends = materialize(R.together(now, lists, models, bins, points, least, LISTED), "ends")
        done = ends.where("not done").isEmpty()
        moved = ends.where("model <> into").select("model", "into")
        follow = lambda df: df.join(moved, "model", "left").withColumn("model", F.coalesce("into", "model")).drop("into")
        before, label = label, materialize(follow(label).select("member", "model"), "labels")
        last = now
        if not done:
            now = materialize(follow(now).groupBy("model", "bin").agg(F.sum("n").alias("n")), "counts")
        for table in (h, lists, ends, before, last):
            discard(table)
    return label


def fuse(counts: DataFrame, least: float, accepted: Callable[[DataFrame, DataFrame], DataFrame] | None = None, everything: bool = False, searched: list[int] | None = None) -> DataFrame:
    """(member, model): what each model of (model, bin, n) ends in.

    Candidates are the pairs (model, other), model < other, that share more than
    ``least`` and that ``accepted`` returns, given them and the labels so far. In each
    round the models that are each other's best candidate merge into the smaller one.
    A work list holds the models that are searched: those that changed, and those whose
    best candidate did. All others keep their best candidate unless a searched model
    beats it, so that no pair is judged again while neither changes. ``everything``
    searches all models in each round instead, with the same result. ``searched`` gets
    the number of searches of each round. Every round is written to the shared folder,
    and what the next one does not need is deleted there. Where nothing but histograms
    decides, and their counts fit a task, rounds run there.
    """
    now = materialize(counts.select("model", "bin", "n"), "counts")
    label = materialize(now.select(F.col("model").alias("member"), "model").distinct(), "labels")
    if accepted is None and not everything and searched is None:
        bins, points = now.agg(F.countDistinct("bin"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if label.count() * bins <= R.CELLS:
            return fuse_in_task(now, label, bins, points, least)
    work, best, stale = label.select("model").distinct(), None, []
    while True:
        if everything:
            work = label.select("model").distinct()
        if searched is not None:
            searched.append(work.count())
        h = materialize(weighted(now), "histograms")
        ends = F.least("model", "other").alias("model"), F.greatest("model", "other").alias("other")
        found = materialize(similar(h, least, work, None if accepted else 1).select(*ends, "score").distinct(), "found")
        spent = [h, found]
        if accepted:
            found = materialize(found.join(accepted(found.select("model", "other"), label), ["model", "other"], "left_semi"), "accepted")
            spent.append(found)
        pairs = found.unionByName(found.select(F.col("other").alias("model"), F.col("model").alias("other"), "score"))
        if best is not None:
            pairs = pairs.unionByName(best.join(work, "model", "left_anti"))
        chosen = materialize(best_of(pairs), "best")
        # the work list and the best candidates so far stood on the tables of the round before
        for table in [*spent, *stale]:
            discard(table)
        best, merges = chosen, materialize(mutual(chosen), "merges")
        stale = [chosen, merges]
        if merges.isEmpty():
            for table in [*stale, now]:
                discard(table)
            return label
        moved = merges.select(F.col("other").alias("model"), F.col("model").alias("into"))
        changed = merges.select("model").unionByName(moved.select("model"))
        lost = best.join(changed.withColumnRenamed("model", "other"), "other", "left_semi").select("model")
        work = merges.select("model").unionByName(lost).join(moved, "model", "left_anti").distinct()
        best = best.join(moved, "model", "left_anti")
        follow = lambda df: df.join(moved, "model", "left").withColumn("model", F.coalesce("into", "model")).drop("into")
        before, label = label, materialize(follow(label).select("member", "model"), "labels")
        last, now = now, materialize(follow(now).groupBy("model", "bin").agg(F.sum("n").alias("n")), "counts")
        discard(last)
        discard(before)
