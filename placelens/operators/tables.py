"""Operators on catalog, history, result and frame tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def seconds(stamp: Column | str) -> Column:
    """Seconds since the epoch, with fractions, of either kind of timestamp."""
    return F.unix_micros((F.col(stamp) if isinstance(stamp, str) else stamp).cast("timestamp")) / 1e6


def latest(df: DataFrame, by: list[str], *order: Column, n: int = 0) -> DataFrame:
    """The row at place n of each group in the given order; groups that end earlier have none."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == n + 1).drop("_rn")


def top(df: DataFrame, by: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def sessions(df: DataFrame, by: list[str], stamp: str, gap_s: float) -> DataFrame:
    """Column session: a new one, counted from 1, when more than the gap has passed since the row before."""
    w = Window.partitionBy(*by).orderBy(stamp)
    wait = seconds(stamp) - F.lag(seconds(stamp)).over(w)
    new = F.when(wait.isNull() | (wait > gap_s), 1).otherwise(0)
    running = Window.partitionBy(*by).orderBy(stamp).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(running)).drop("_new")


def neighbours_in_time(df: DataFrame, by: list[str], stamp: str) -> DataFrame:
    """Columns prev_stamp and next_stamp: the nearest other stamps of the group, strictly before and after."""
    distinct = df.select(*by, stamp).distinct()
    w = Window.partitionBy(*by).orderBy(stamp)
    around = distinct.withColumn("prev_stamp", F.lag(stamp).over(w)).withColumn("next_stamp", F.lead(stamp).over(w))
    return df.join(around, [*by, stamp])


def as_of(left: DataFrame, right: DataFrame, by: list[str], stamp: str, value: str) -> DataFrame:
    """The right value of the latest stamp not after each left row; one pass over the union, no range join."""
    # right rows sort before left rows of the same stamp; of right rows of one stamp the largest value counts
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.groupBy(*by, stamp).agg(F.max(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(stamp, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def nearest_in_time(df: DataFrame, by: list[str], stamp: str, at: Column, key: str) -> DataFrame:
    """The row of each group whose stamp is closest to ``at``; ties by stamp, then key."""
    gap = F.abs(seconds(stamp) - seconds(at))
    return df.groupBy(*by).agg(F.min(F.struct(gap.alias("gap"), F.col(stamp), F.col(key))).alias("m")).select(*by, f"m.{stamp}", f"m.{key}", "m.gap")


def alive_at(df: DataFrame, at: Column) -> DataFrame:
    """Rows whose life started before and has not ended at a time."""
    return df.where((F.col("life_start") < at) & (F.col("life_end").isNull() | (F.col("life_end") > at)))


def soft_remove(df: DataFrame, names: DataFrame, key: str, at: Column) -> DataFrame:
    """removed_at is set for live rows of the named keys."""
    hit = names.select(F.col(key), F.lit(True).alias("_hit")).distinct()
    return df.join(hit, key, "left").withColumn("removed_at", F.when(F.col("_hit") & F.col("removed_at").isNull(), at).otherwise(F.col("removed_at"))).drop("_hit")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def depth_median(frames: DataFrame, by: list[str]) -> DataFrame:
    """Upper median of non-zero depths; 0 where there is none."""
    sorted_depths = F.sort_array(F.collect_list(F.when(F.col("depth") != 0, F.col("depth"))))
    out = frames.groupBy(*by).agg(sorted_depths.alias("d"))
    return out.select(*by, F.when(F.size("d") == 0, 0).otherwise(F.element_at("d", (F.floor(F.size("d") / 2) + 1).cast("int"))).alias("depth"))


def depth_mean(frames: DataFrame, by: list[str]) -> DataFrame:
    """Whole-number mean of non-zero depths; 0 where there is none."""
    seen = F.when(F.col("depth") != 0, F.col("depth"))
    return frames.groupBy(*by).agg(F.coalesce(F.floor(F.sum(seen) / F.count(seen)), F.lit(0)).cast("long").alias("depth"))


def suppress_overlapping(results: DataFrame, by: list[str], score: str, key: str, members: str) -> DataFrame:
    """Greedy in score order per group: a result that shares a member with a better kept one is dropped.

    Smaller scores are better, ties go to the smaller key, null scores come last. Null
    groups and keys are values like any other, equal rows stand or fall together, and a
    result without members has no rival. Set-based rounds: in each, results without a
    better live rival are kept and leave with their rivals, so that the best of every
    group leaves in each round, and the longest chain of rivals bounds their number.
    """
    from placelens.scratch import discard, materialize

    # structs are never null themselves, so that nulls in them meet
    place = F.struct(F.col(score).isNull().alias("last"), F.col(score).alias("score"), F.col(key).alias("key"))
    live = materialize(results.select(F.struct(*by).alias("_g"), place.alias("_r"), F.col(members).alias("_in")), "live")
    kept = None
    while not live.isEmpty():
        flat = live.select("_g", "_r", F.explode("_in").alias("_m")).select(F.struct("_g", "_m").alias("_at"), "_g", "_r").distinct()
        best = flat.groupBy("_at").agg(F.min("_r").alias("_b"))
        losing = flat.join(best, "_at").where(F.col("_r") > F.col("_b")).select("_g", "_r").distinct()
        winners = materialize(live.join(losing, ["_g", "_r"], "left_anti"), "winners")
        kept = winners if kept is None else kept.unionByName(winners)
        taken = winners.select("_g", F.explode("_in").alias("_m")).select(F.struct("_g", "_m").alias("_at")).distinct()
        gone = flat.join(taken, "_at", "left_semi").select("_g", "_r").unionByName(winners.select("_g", "_r")).distinct()
        last, live = live, materialize(live.join(gone, ["_g", "_r"], "left_anti"), "live")
        discard(last)
    if kept is None:
        return results.select(*by, score, key)
    return kept.select(*(F.col(f"_g.{c}").alias(c) for c in by), F.col("_r.score").alias(score), F.col("_r.key").alias(key))


#: Tasks that the rows of one key are dealt to.
SALTS = 16


def salted_join(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``few``, which has one row a key: rows of one key are dealt to ``salts`` tasks, each with a copy of the key's row."""
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")
