"""Queries of windows and top-k (W) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from placelens.functions import geometry as G
from placelens.operators import spatial as S, tables as T, vocabulary as B
from placelens.plans.aggregates import MEANS, VOXEL
from placelens.plans.joins import BY, R2, _HIST, _SEGMENTS, cloud, distance, histograms, segment_overlaps
from placelens.plans.projections import catalog_paths
from placelens.plans.registry import q4, query, r4
from placelens.plans.retrieval import _PATHS, given_vectors, voc
from placelens.scratch import materialize
from placelens.sources import views as V


def newest():
    return F.desc("start_ts"), F.desc("obs_id")


@query("w1_catalog_order", V.sql("select obs_id, row_number() over (order by strftime(start_ts, '%Y%m%d'), run_no, obs_id % 13, obs_id) as place from observations", "observations"))
def w1(spark, d):
    """Places in the whole catalog: counted within a day, plus the days before, so that no task sees all rows."""
    o = catalog_paths(spark, d).select("obs_id", *(c.alias(k) for k, c in G.path_parts("path").items()))
    days = o.groupBy("date").agg(F.count("*").alias("n"))
    before = days.select("date", F.coalesce(F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = o.withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy("patrol", "room", "obs_id")))
    return own.join(before, "date").select("obs_id", (F.col("before") + F.col("k")).alias("place"))


@query("w2_latest_per_waypoint", V.sql("select waypoint, arg_max(obs_id, {'t': start_ts, 'o': obs_id}) as obs_id from observations group by 1", "observations"))
def w2(spark, d):
    return T.latest(V.observations(spark, d), ["waypoint"], *newest()).select("waypoint", "obs_id")


@query("w3_instance_n", V.sql("select waypoint, obs_id from observations qualify row_number() over (partition by waypoint order by start_ts, obs_id) = 6", "observations"))
def w3(spark, d):
    return T.latest(V.observations(spark, d), ["waypoint"], F.asc("start_ts"), F.asc("obs_id"), n=5).select("waypoint", "obs_id")


@query("w4_sensor_origin", V.sql(f"""select waypoint, {q4("arg_min(tx, view_no)")} as ox, {q4("arg_min(ty, view_no)")} as oy, {q4("arg_min(tz, view_no)")} as oz
from (select waypoint, arg_max(obs_id, {{'t': start_ts, 'o': obs_id}}) as obs_id from observations group by 1) left join transforms using (obs_id) group by 1""", "observations", "transforms"))
def w4(spark, d):
    """Origin of the first pose of the latest observation; null without poses."""
    last = T.latest(V.observations(spark, d), ["waypoint"], *newest()).select("waypoint", "obs_id")
    pose = last.join(V.transforms(spark, d), "obs_id", "left").groupBy("waypoint").agg(F.min_by(F.struct("tx", "ty", "tz"), "view_no").alias("t"))
    return pose.select("waypoint", *(r4(F.col(f"t.t{k}")).alias(f"o{k}") for k in "xyz"))


@query("w5_retain_newest", V.sql("select waypoint, obs_id, row_number() over (partition by waypoint order by start_ts desc, obs_id desc) <= 5 as kept from observations", "observations"))
def w5(spark, d):
    """The newest five of each place are kept; the rest is the archive."""
    place = F.row_number().over(Window.partitionBy("waypoint").orderBy(*newest()))
    return V.observations(spark, d).select("waypoint", "obs_id", (place <= 5).alias("kept"))


@query("w6_observation_sessions", V.sql("select name, session, count(*) as n from (select name, sum(new) over (partition by name order by stamp) as session from (select name, stamp, case when lag(stamp) over w is null or epoch_us(stamp) - epoch_us(lag(stamp) over w) > 14400::bigint * 1000000 then 1 else 0 end as new from wobj_obs window w as (partition by name order by stamp))) group by all", "wobj_obs"))
def w6(spark, d):
    return T.sessions(V.wobj_obs(spark, d), ["name"], "stamp", 14_400).groupBy("name", "session").agg(F.count("*").alias("n"))


def assign_patrol(observations):
    """Patrol and room numbers in arrival order: a place seen again in the patrol begins the next one.

    The numbers follow one after another by nature; each robot's (log's) day is a
    group of its own.
    """
    import pandas as pd

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start_ts", "obs_id"])
        patrol, seen, out = 0, set(), []
        for place in rows["waypoint"]:
            if place in seen:
                patrol, seen = patrol + 1, set()
            out.append((patrol, len(seen)))
            seen.add(place)
        return pd.DataFrame({"obs_id": rows["obs_id"], "log_name": rows["log_name"], "patrol": [p for p, _ in out], "room": [r for _, r in out]})

    return observations.select("obs_id", "log_name", "waypoint", "start_ts").groupBy("log_name", F.to_date("start_ts")).applyInPandas(one, "obs_id long, log_name string, patrol int, room int")


@query("w7_assign_patrol")
def w7(spark, d):
    return assign_patrol(V.observations(spark, d))


def _results(spark, d):
    """Retrieval results: a descriptor's score for its label, with the parts it uses."""
    e = V.descriptors(spark, d)
    parts = F.array(F.col("vec_id") % 23, F.col("vec_id") % 29 + 100)
    return e.select("label", (F.col("vec_id") * 7919 % 1009).alias("score"), "vec_id", parts.alias("parts"))


@query("w8_suppress_overlapping")
def w8(spark, d):
    return T.suppress_overlapping(_results(spark, d), ["label"], "score", "vec_id", "parts")


@query("w9_top_k", V.sql(f"select label, vec_id, rank from (select label, vec_id, row_number() over (partition by label order by vec_id * 7919 % 1009, vec_id) as rank from descriptors where vec_id % 11 <> 0) where rank <= 10", "descriptors"))
def w9(spark, d):
    """Scores that are not numbers are dropped."""
    scored = _results(spark, d).withColumn("score", F.when(F.col("vec_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("score")))
    return T.top(scored.where(~F.isnan("score")), ["label"], 10, F.asc("score"), F.asc("vec_id")).select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("w10_exclude_self_then_top", voc("select source, other, rank from (select query_id as source, source_id as other, row_number() over (partition by query_id order by round(score, 6), source_id) as rank from scores where query_id <> source_id) where rank <= 10"))
def w10(spark, d):
    """Of the sources that a sweep's search finds, its own is left out, then the ten best stay."""
    v = materialize(given_vectors(spark, d), "vectors")
    hits = B.score(v, v).where("query_id <> source_id").withColumn("score", F.round("score", 6))
    return T.top(hits, ["query_id"], 10, F.asc("score"), F.asc("source_id")).select(F.col("query_id").alias("source"), F.col("source_id").alias("other"), F.col("rank").cast("long").alias("rank"))


@query("w11_path_length", V.sql(f"select waypoint, {q4('sum(sqrt(dx * dx + dy * dy))')} as length from (select waypoint, cx - lag(cx) over w as dx, cy - lag(cy) over w as dy from observations window w as (partition by waypoint order by start_ts, obs_id)) group by 1", "observations"))
def w11(spark, d):
    w = Window.partitionBy("waypoint").orderBy("start_ts", "obs_id")
    step = V.observations(spark, d).select("waypoint", *((F.col(k) - F.lag(k).over(w)).alias(n) for k, n in (("cx", "dx"), ("cy", "dy"))))
    return step.groupBy("waypoint").agg(r4(F.sum(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))).alias("length"))


@query("w12_rotate_to_longest_gap", V.sql("""select waypoint, obs_id, cast((k - start + n) % n as bigint) as turn from (select waypoint, obs_id, k, count(*) over (partition by waypoint) as n,
first_value(k) over (partition by waypoint order by gap desc, k) as start from (select waypoint, obs_id, row_number() over w - 1 as k, coalesce(epoch_us(start_ts) - epoch_us(lag(start_ts) over w), 0) as gap from observations window w as (partition by waypoint order by start_ts, obs_id)))""", "observations"))
def w12(spark, d):
    """A round trip begins behind its longest leg."""
    w = Window.partitionBy("waypoint").orderBy("start_ts", "obs_id")
    gap = F.coalesce(T.seconds("start_ts") - F.lag(T.seconds("start_ts")).over(w), F.lit(0.0))
    legs = V.observations(spark, d).select("waypoint", "obs_id", (F.row_number().over(w) - 1).alias("k"), gap.alias("gap"))
    longest = legs.groupBy("waypoint").agg(F.max(F.struct("gap", (-F.col("k")).alias("nk"))).alias("m"), F.count("*").alias("n"))
    return legs.join(longest, "waypoint").select("waypoint", "obs_id", ((F.col("k") + F.col("m.nk") + F.col("n")) % F.col("n")).alias("turn"))


@query("w13_latest_pose", V.sql(f"select name, kind, arg_max(event_id, {{'s': stamp, 'e': event_id}}) as event_id from wobj_obs group by all", "wobj_obs"))
def w13(spark, d):
    """Latest entry of each object for each classifier (kind)."""
    return V.wobj_obs(spark, d).groupBy("name", "kind").agg(F.max_by("event_id", F.struct("stamp", "event_id")).alias("event_id"))


@query("w14_first_ids", V.sql("select label, vec_id from (select label, vec_id, row_number() over (partition by label order by vec_id) rn from descriptors where source_id <> 0) where rn <= 7", "descriptors"))
def w14(spark, d):
    return T.top(V.descriptors(spark, d).where("source_id <> 0"), ["label"], 7, F.asc("vec_id")).select("label", "vec_id")


@query("w15_best_cluster_to_view", V.sql("select obs_id, arg_max(seg, {'n': n, 's': -seg}) as seg, max(n) as views from (select obs_id, cast(floor(pt_idx / 50) as bigint) as seg, count(*) filter (x > 1.03 and x < 4.07) as n from points group by all) group by 1", "points"))
def w15(spark, d):
    """The cluster with most reachable views (here: points inside the free strip)."""
    n = V.points(spark, d).groupBy("obs_id", F.floor(F.col("pt_idx") / 50).alias("seg")).agg(F.count_if((F.col("x") > 1.03) & (F.col("x") < 4.07)).alias("n"))
    return n.groupBy("obs_id").agg(F.max_by("seg", F.struct("n", (-F.col("seg")).alias("s"))).alias("seg"), F.max("n").alias("views"))


@query("w16_log_results", V.sql("select event_id, case when kind in ('purchase', 'signup') then 'model' else 'room' end as type, cast(floor(epoch_us(stamp) / 1000000) as bigint) as epoch, row_number() over (partition by name order by stamp, event_id) - 1 as step from wobj_obs", "wobj_obs"))
def w16(spark, d):
    step = F.row_number().over(Window.partitionBy("name").orderBy("stamp", "event_id")) - 1
    return V.wobj_obs(spark, d).select("event_id", F.when(F.col("kind").isin("purchase", "signup"), "model").otherwise("room").alias("type"), F.floor(T.seconds("stamp")).alias("epoch"), step.cast("long").alias("step"))


@query("w17_start_segment", V.sql(_SEGMENTS + f""", {_PATHS} select obs_id, label, arg_min(view_no, {{'s': round(score, 6), 'v': view_no}}) as view_no from ov join scores on query_id = obs_id % 50 and source_id = (obs_id * 3 + view_no) % 50
where overlap > 0.1 group by all""", "points", "label_points", "descriptors").replace("\n, ", ",\n"))
def w17(spark, d):
    """Of the segments that overlap an object, the one with the lowest score against the query's source."""
    v = materialize(given_vectors(spark, d), "vectors")
    score = B.score(v, v).withColumn("score", F.round("score", 6))
    ov = segment_overlaps(spark, d).where("overlap > 0.1").select("obs_id", "label", "view_no", (F.col("obs_id") % 50).cast("int").alias("query_id"), ((F.col("obs_id") * 3 + F.col("view_no")) % 50).cast("int").alias("source_id"))
    return ov.join(score, ["query_id", "source_id"]).groupBy("obs_id", "label").agg(F.min_by("view_no", F.struct("score", "view_no")).alias("view_no"))


# Set operations


@query("u1_merge_clouds", V.sql("select obs_id, count(*) as n, sum(pt_idx)::bigint as s from (select * from points where view_no = 0 union all select * from points where view_no = 1) group by 1", "points"))
def u1(spark, d):
    return cloud(spark, d, 0).unionByName(cloud(spark, d, 1)).groupBy("obs_id").agg(F.count("*").alias("n"), F.sum("pt_idx").alias("s"))


def _near(a: int, b: int) -> str:
    return f"(view_no = {a} and not exists (select 1 from points b where b.obs_id = a.obs_id and b.view_no = {b} and {distance('a', 'b')} <= {R2}))"


@query("u2_apply_update", V.sql(f"select obs_id, pt_idx from points a where {_near(0, 1)} or view_no = 2", "points"))
def u2(spark, d):
    """Static points less the removed ones, and the added ones."""
    kept = S.cloud_difference(cloud(spark, d, 0), cloud(spark, d, 1), R2, BY)
    return kept.unionByName(cloud(spark, d, 2)).select("obs_id", "pt_idx")


@query("u3_symmetric_difference", V.sql(f"select obs_id, pt_idx, 'a' as side from points a where {_near(0, 1)} union all select obs_id, pt_idx, 'b' from points a where {_near(1, 0)}", "points"))
def u3(spark, d):
    a, b = cloud(spark, d, 0), cloud(spark, d, 1)
    return S.cloud_difference(a, b, R2, BY).select("obs_id", "pt_idx", F.lit("a").alias("side")).unionByName(S.cloud_difference(b, a, R2, BY).select("obs_id", "pt_idx", F.lit("b").alias("side")))


@query("u4_merge_models", V.sql(f"select frame_id, model, {q4('tx')} as tx from (select distinct frame_id, 1 as model, frame_id * 0.1::double as tx from pixels where frame_id % 2 = 0 union all select distinct frame_id, 1, 0.8::double * (frame_id * 0.1::double) + 1.0 from pixels where frame_id % 2 = 1)", "pixels"))
def u4(spark, d):
    """Frames of a second model join the first under the pose between the models."""
    from placelens.plans.projections import POSE

    f = V.pixels(spark, d).select("frame_id").distinct()
    own = f.select("frame_id", F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0)), F.col("frame_id") * 0.1, *(F.lit(v) for v in (0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0))).alias("m"))
    moved = own.where("frame_id % 2 = 1").withColumn("m", G.compose(F.array(*(F.lit(v) for v in POSE)), F.col("m")))
    return own.where("frame_id % 2 = 0").unionByName(moved).select("frame_id", F.lit(1).alias("model"), r4(F.col("m")[3]).alias("tx"))


@query("u5_archive_object", V.sql("select name, case when life_end is null then parent end as parent, life_end is not null as archived from wobjects", "wobjects"))
def u5(spark, d):
    """Ended objects move to the archive and leave their parent."""
    w = V.wobjects(spark, d)
    gone = w.where("life_end is not null").select("name")
    live = w.join(gone, "name", "left_anti").select("name", "parent", F.lit(False).alias("archived"))
    return live.unionByName(gone.select("name", F.lit(None).cast("string").alias("parent"), F.lit(True).alias("archived")))


@query("u6_merge_catalogs", V.sql("select waypoint, count(*) as n from (select waypoint, obs_id from observations where run_no < 5 union select waypoint, obs_id from observations where run_no > 2) group by 1", "observations"))
def u6(spark, d):
    """The listings of the disk and of the store, which share some rooms."""
    o = V.observations(spark, d).select("waypoint", "obs_id", "run_no")
    both = o.where("run_no < 5").unionByName(o.where("run_no > 2")).select("waypoint", "obs_id").distinct()
    return both.groupBy("waypoint").agg(F.count("*").alias("n"))


@query("u7_common_keys", V.sql(f", {_HIST} select a.obs_id, bin, {q4('a.w')} as a_w, {q4('b.w')} as b_w from h a join h b using (bin) where b.obs_id = a.obs_id + 1", "points").replace("\n, ", ",\n"))
def u7(spark, d):
    """Values of the keys that two neighbouring histograms share."""
    h = histograms(spark, d)
    return h.join(h.select((F.col("obs_id") - 1).alias("obs_id"), "bin", F.col("w").alias("v")), ["obs_id", "bin"]).select("obs_id", "bin", r4("w").alias("a_w"), r4("v").alias("b_w"))


@query("u8_categories", V.sql("select label, count(*) as instances from (select distinct label, source_id from descriptors where label <> 5 except select label, source_id from descriptors where vec_id < 100) group by 1", "descriptors"))
def u8(spark, d):
    """Categories with their instances, one category and some instances removed."""
    e = V.descriptors(spark, d)
    live = e.where("label <> 5").select("label", "source_id").subtract(e.where("vec_id < 100").select("label", "source_id"))
    return live.groupBy("label").agg(F.count("*").alias("instances"))


@query("u9_map_cloud", V.sql(f"select obs_id, {VOXEL.format('0.97')}, {q4('avg(x)')} as x, count(*) as n from (select obs_id, avg(x) + view_no * 0.5 as x, avg(y) as y, avg(z) as z from (select *, {VOXEL.format('0.53')} from points) group by obs_id, view_no, cx, cy, cz) group by all", "points"))
def u9(spark, d):
    """Each view is down-sampled, moved by its pose, united with the others and down-sampled again."""
    frames = S.voxel_downsample(V.points(spark, d), 0.53, ["obs_id", "view_no"], ("x", "y", "z")).drop("cx", "cy", "cz", "n_points")
    moved = frames.withColumn("x", F.col("x") + F.col("view_no") * 0.5)
    return S.voxel_downsample(moved, 0.97, BY, ("x", "y", "z")).select("obs_id", "cx", "cy", "cz", r4("x").alias("x"), F.col("n_points").alias("n"))
