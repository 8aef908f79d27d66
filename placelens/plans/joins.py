"""Queries of joins (J)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from placelens.functions import geometry as G
from placelens.operators import histograms as H, spatial as S, tables as T, vocabulary as B
from placelens.plans.projections import POSE, SMALL_CAM, binned, in_frustum, _BINS, _FRUSTUM
from placelens.plans.registry import q4, query, r4
from placelens.scratch import materialize
from placelens.sources import views as V

R = 0.47
R2 = 0.2209
BY = ["obs_id"]


def cloud(spark, d, view: int):
    return V.points(spark, d).where(F.col("view_no") == view)


def distance(a: str, b: str) -> str:
    return " + ".join(f"({a}.{k} - {b}.{k}) * ({a}.{k} - {b}.{k})" for k in "xyz")


_NEAR = f"exists (select 1 from points b where b.obs_id = a.obs_id and b.view_no = 1 and {distance('a', 'b')} {{op}} {R2})"


@query("j1_cloud_difference", V.sql(f"select obs_id, pt_idx from points a where view_no = 0 and not {_NEAR.format(op='<=')}", "points"))
def j1(spark, d):
    return S.cloud_difference(cloud(spark, d, 0), cloud(spark, d, 1), R2, BY).select("obs_id", "pt_idx")


@query("j2_cloud_intersection", V.sql(f"select obs_id, pt_idx from points a where view_no = 0 and {_NEAR.format(op='<')}", "points"))
def j2(spark, d):
    return S.cloud_intersection(cloud(spark, d, 0), cloud(spark, d, 1), R2, BY).select("obs_id", "pt_idx")


_NEAREST = f"""nearest as (select a.obs_id, a.pt_idx, arg_min(b.pt_idx, {{'d': {distance('a', 'b')}, 'i': b.pt_idx}}) as b_pt_idx, min({distance('a', 'b')}) as d2
from points a join points b on a.obs_id = b.obs_id and a.view_no = 0 and b.view_no = 1 and {distance('a', 'b')} <= {R2} group by all)"""


@query("j3_nearest", V.sql(f", {_NEAREST} select obs_id, pt_idx, b_pt_idx, {q4('d2')} as d2 from nearest", "points").replace("\n, ", ",\n"))
def j3(spark, d):
    return S.nearest(cloud(spark, d, 0), cloud(spark, d, 1), R, BY).select("obs_id", "pt_idx", "b_pt_idx", r4("d2").alias("d2"))


@query("j4_radius_count", V.sql(f"select a.obs_id, a.pt_idx, count(*) as n_near from points a join points b on a.obs_id = b.obs_id and a.view_no = 0 and b.view_no = 0 and {distance('a', 'b')} <= {R2} group by all having count(*) >= 2", "points"))
def j4(spark, d):
    return S.radius_count(cloud(spark, d, 0), R, 2, BY).select("obs_id", "pt_idx", "n_near")


@query("j5_match_place", V.sql("""select r.obs_id, arg_min(m.obs_id, {'a': m.start_ts, 'b': m.obs_id}) as metaroom from (select *, case when waypoint not in ('WP3', 'WP7') then waypoint end as id from observations where run_no = 1) r
join (select *, case when waypoint not in ('WP3', 'WP7') then waypoint end as id from observations where run_no = 0) m on r.id = m.id or (r.id is null and (r.cx - m.cx) * (r.cx - m.cx) + (r.cy - m.cy) * (r.cy - m.cy) + (r.cz - m.cz) * (r.cz - m.cz) < 1.53 * 1.53) group by 1""", "observations"))
def j5(spark, d):
    """By waypoint; rooms without one by the distance of their centroids. The first match in catalog order."""
    o = V.observations(spark, d).withColumn("id", F.when(~F.col("waypoint").isin("WP3", "WP7"), F.col("waypoint"))).select("obs_id", "id", "start_ts", "run_no", *(F.col(f"c{k}").alias(k) for k in "xyz"))
    rooms, meta = o.where("run_no = 1"), o.where("run_no = 0")
    first, spot = F.min(F.struct("start_ts", "obs_id")).alias("m"), ["x", "y", "z"]
    named = rooms.join(meta.groupBy("id").agg(first), "id").select("obs_id", "m")
    # rooms and maps at one spot meet once: only the first map of a spot counts
    unnamed = rooms.where("id is null")
    met = S.pairs_within(unnamed.select(*spot).distinct(), meta.groupBy(*spot).agg(first), 1.53, [], strict=True).groupBy(*spot).agg(F.min("b_m").alias("m"))
    both = named.unionByName(unnamed.join(met, spot).select("obs_id", "m"))
    return both.groupBy("obs_id").agg(F.min("m").alias("m")).select("obs_id", F.col("m.obs_id").alias("metaroom"))


_SEEN = _BINS.replace("select obs_id, pt_idx, r,", "select obs_id, view_no, pt_idx, r,").replace("(select obs_id, pt_idx, x -", "(select obs_id, view_no, pt_idx, x -")


@query("j6_occlusion_points", V.sql(f""", seen as ({_SEEN}), far as (select obs_id, tbin, pbin, max(r) as other from seen where view_no = 1 group by all)
select obs_id, pt_idx, case when r < other then 'front' else 'behind' end as side from seen join far using (obs_id, tbin, pbin) where view_no = 0""", "points").replace("\n, ", ",\n"))
def j6(spark, d):
    seen = binned(V.points(spark, d))
    return S.occlusion(seen.where("view_no = 0"), seen.where("view_no = 1"), BY, 61).select("obs_id", "pt_idx", "side")


@query("j7_occlusion_clusters", V.sql(f""", seen as ({_SEEN}), far as (select obs_id, tbin, pbin, max(r) as other from seen where view_no = 1 group by all)
select obs_id, cast(floor(pt_idx / 50) as bigint) as cluster, count(*) as shared, count(*) filter (r < other) as front, count(*) filter (r < other) * 2 < count(*) as occluded from seen join far using (obs_id, tbin, pbin) where view_no = 0 group by all""", "points").replace("\n, ", ",\n"))
def j7(spark, d):
    """A cluster is occluded when less than half of its shared directions are in front."""
    seen = binned(V.points(spark, d))
    sides = S.occlusion(seen.where("view_no = 0"), seen.where("view_no = 1"), BY, 61).withColumn("cluster", F.floor(F.col("pt_idx") / 50))
    front = F.count_if(F.col("side") == "front")
    return sides.groupBy("obs_id", "cluster").agg(F.count("*").alias("shared"), front.alias("front"), (front * 2 < F.count("*")).alias("occluded"))


_CELL = "cast(floor(x / 0.53) as bigint) cx, cast(floor(y / 0.53) as bigint) cy, cast(floor(z / 0.53) as bigint) cz"


def _overlap_sql(a: str, b: str, a_by: str, b_by: str, both: str) -> str:
    return f""", va as (select distinct obs_id, {a_by} {_CELL} from {a}), vb as (select distinct obs_id, {b_by} {_CELL} from {b}),
na as (select obs_id, {a_by} count(*) na from va group by all), nb as (select obs_id, {b_by} count(*) nb from vb group by all),
cm as (select obs_id, {both} count(*) common from va join vb using (obs_id, cx, cy, cz) group by all), ov as (select *, common / (na + nb - common) as overlap from cm join na using (obs_id{', ' + a_by.strip(', ') if a_by else ''}) join nb using (obs_id{', ' + b_by.strip(', ') if b_by else ''}))"""


@query("j8_voxel_overlap", V.sql(_overlap_sql("(select * from points where view_no = 0)", "(select * from points where view_no = 1)", "", "", "") + f" select obs_id, {q4('overlap')} as overlap from ov", "points").replace("\n, ", ",\n"))
def j8(spark, d):
    return S.voxel_overlap(cloud(spark, d, 0), cloud(spark, d, 1), 0.53, BY, BY, BY).select("obs_id", r4("overlap").alias("overlap"))


_SEGMENTS = _overlap_sql("points", "label_points", "view_no,", "label,", "view_no, label,")


def segment_overlaps(spark, d):
    """Overlap of each segment (view) with each label of its observation."""
    return S.voxel_overlap(V.points(spark, d), V.label_points(spark, d), 0.53, ["obs_id", "view_no"], ["obs_id", "label"], BY)


@query("j9_best_label", V.sql(_SEGMENTS + ", best as (select obs_id, view_no, max(label) as label from ov join (select obs_id, view_no, max(overlap) m from ov group by all) using (obs_id, view_no) where overlap = m and overlap > 0.25 group by all) select obs_id, view_no, coalesce(label, '') as label from (select distinct obs_id, view_no from points) left join best using (obs_id, view_no)", "points", "label_points").replace("\n, ", ",\n"))
def j9(spark, d):
    best = segment_overlaps(spark, d).groupBy("obs_id", "view_no").agg(F.max(F.struct("overlap", "label")).alias("m")).where("m.overlap > 0.25").select("obs_id", "view_no", "m.label")
    return V.points(spark, d).select("obs_id", "view_no").distinct().join(best, ["obs_id", "view_no"], "left").withColumn("label", F.coalesce("label", F.lit("")))


@query("j10_best_overlap", V.sql(_SEGMENTS + f" select label, {q4('avg(m)')} as mean_overlap, count(*) as n from (select obs_id, label, max(overlap) m from ov group by all) group by 1", "points", "label_points").replace("\n, ", ",\n"))
def j10(spark, d):
    best = segment_overlaps(spark, d).groupBy("obs_id", "label").agg(F.max("overlap").alias("m"))
    return best.groupBy("label").agg(r4(F.avg("m")).alias("mean_overlap"), F.count("*").alias("n"))


_COVER = f"""select l.obs_id, l.label, p.view_no, count(distinct l.pt_idx) as hit from label_points l join points p on p.obs_id = l.obs_id and {distance('l', 'p')} <= {R2} and p.pt_idx <> l.pt_idx group by all"""


@query("j11_segments_covering", V.sql(f"select obs_id, label, view_no, {q4('hit / n')} as share from ({_COVER}) join (select obs_id, label, count(*) n from label_points group by all) using (obs_id, label) where hit / n > 0.1", "points", "label_points"))
def j11(spark, d):
    objects, segments = V.label_points(spark, d), V.points(spark, d).select("obs_id", "view_no", "pt_idx", "x", "y", "z")
    # all hits of an object's point are in its cell, where they are told once
    hits = S.pairs_within(objects, segments, R, BY, cells=True).where("pt_idx <> b_pt_idx").select("obs_id", *S.CELL, "label", F.col("b_view_no").alias("view_no"), "pt_idx").distinct()
    n = objects.groupBy("obs_id", "label").agg(F.count("*").alias("n"))
    share = hits.groupBy("obs_id", "label", "view_no").agg(F.count("*").alias("hit")).join(n, ["obs_id", "label"]).withColumn("share", F.col("hit") / F.col("n"))
    return share.where("share > 0.1").select("obs_id", "label", "view_no", r4("share").alias("share"))


@query("j12_children", V.sql("select c.name, p.name as parent, p.parent is null as below_root from wobjects c join wobjects p on c.parent = p.name", "wobjects"))
def j12(spark, d):
    w = V.wobjects(spark, d)
    p = w.select(F.col("name").alias("parent"), F.col("parent").isNull().alias("below_root"))
    return w.select("name", "parent").join(p, "parent").select("name", "parent", "below_root")


@query("j13_objects_observed", V.sql("select distinct name from wobj_obs where exists (select 1 from events e where e.ts = stamp and e.event_type = 'error')", "wobj_obs"))
def j13(spark, d):
    stamps = V.table(spark, d, "events").where("event_type = 'error'").select(F.col("ts").alias("stamp"))
    return V.wobj_obs(spark, d).join(stamps, "stamp", "left_semi").select("name").distinct()


@query("j14_alive_at", V.sql("select name, parent from wobjects where life_start < timestamp '1995-04-01' and (life_end is null or life_end > timestamp '1995-04-01')", "wobjects"))
def j14(spark, d):
    return T.alive_at(V.wobjects(spark, d), F.lit("1995-04-01").cast("timestamp")).select("name", "parent")


@query("j15_nearest_in_time", V.sql("select name, arg_min(event_id, {'g': abs(epoch_us(stamp) - epoch_us(timestamp '2024-01-05 12:00:00.5')), 's': stamp, 'k': event_id}) as event_id from wobj_obs group by 1", "wobj_obs"))
def j15(spark, d):
    return T.nearest_in_time(V.wobj_obs(spark, d), ["name"], "stamp", F.lit("2024-01-05 12:00:00.5").cast("timestamp"), "event_id").select("name", "event_id")


@query("j16_next_and_previous_stamp", V.sql("select event_id, lag(stamp) over w as prev_stamp, lead(stamp) over w as next_stamp from (select distinct name, stamp from wobj_obs) join wobj_obs using (name, stamp) window w as (partition by name order by stamp)", "wobj_obs"))
def j16(spark, d):
    return T.neighbours_in_time(V.wobj_obs(spark, d), ["name"], "stamp").select("event_id", "prev_stamp", "next_stamp")


@query("j17_pose_at", V.sql(f"select m.event_id, {q4('max(p.value)')} as pose from wobj_obs m left join lateral (select value from wobj_obs p where p.name = m.name and p.kind = 'view' and p.stamp <= m.stamp order by p.stamp desc, p.value desc limit 1) p on true where m.kind = 'click' group by 1", "wobj_obs"))
def j17(spark, d):
    e = V.wobj_obs(spark, d)
    out = T.as_of(e.where("kind = 'click'").select("name", "stamp", "event_id"), e.where("kind = 'view'").select("name", "stamp", "value"), ["name"], "stamp", "value")
    return out.select("event_id", r4("value").alias("pose"))


_HIST = "h as (select obs_id, 64 * (r * 8 // 256) + 8 * (g * 8 // 256) + b * 8 // 256 as bin, count(*) / max(n) as w from points join (select obs_id, count(*) n from points group by 1) using (obs_id) group by obs_id, bin)"


def histograms(spark, d):
    """Normalised colour histograms of the observations, as rows."""
    p = V.points(spark, d).select("obs_id", G.rgb_bin("r", "g", "b", 8).alias("bin"))
    n = p.groupBy("obs_id").agg(F.count("*").alias("n"))
    return p.groupBy("obs_id", "bin").agg(F.count("*").alias("k")).join(n, "obs_id").select("obs_id", "bin", (F.col("k") / F.col("n")).alias("w"))


@query("j18_histogram_search", V.sql(f", {_HIST}, s as (select a.obs_id, b.obs_id as other, {q4('sum(least(a.w, b.w))')} as score from h a join h b using (bin) where a.obs_id <> b.obs_id and a.obs_id % 20 = 0 group by all) select obs_id, other, score, rank from (select *, row_number() over (partition by obs_id order by score desc, other) as rank from s) where rank <= 5", "points").replace("\n, ", ",\n"))
def j18(spark, d):
    h = materialize(histograms(spark, d).withColumnRenamed("obs_id", "id"), "histograms")
    s = H.overlaps(h.where("id % 20 = 0"), h, 4, most=5, tilt=1e-9).withColumnRenamed("id", "obs_id")
    return T.top(s, ["obs_id"], 5, F.desc("score"), F.asc("other")).select("obs_id", "other", "score", F.col("rank").cast("long").alias("rank"))


_MUTUAL = f"""m as (select a.obs_id, a.pt_idx, b.pt_idx as b_pt_idx, 0.5 * bit_count(xor(a.r * 65536 + a.g * 256 + a.b, b.r * 65536 + b.g * 256 + b.b)) / 24 + 0.5 * ({distance('a', 'b')}) as cost
from points a join points b on a.obs_id = b.obs_id and a.view_no = 0 and b.view_no = 1 and {distance('a', 'b')} <= {R2})"""


@query("j19_mutual_matches", V.sql(f", {_MUTUAL} select obs_id, pt_idx, b_pt_idx from (select *, row_number() over (partition by obs_id, pt_idx order by cost, b_pt_idx) as f, row_number() over (partition by obs_id, b_pt_idx order by cost, pt_idx) as g from m) where f = 1 and g = 1", "points").replace("\n, ", ",\n"))
def j19(spark, d):
    """Costs of colour (differing bits) and place; pairs that are each other's best."""
    code = lambda p: F.col(f"{p}r") * 65536 + F.col(f"{p}g") * 256 + F.col(f"{p}b")
    one = lambda view: cloud(spark, d, view).select("obs_id", "pt_idx", "x", "y", "z", "r", "g", "b")
    cost = 0.5 * F.bit_count(code("").bitwiseXOR(code("b_"))) / 24 + 0.5 * F.col("d2")
    pairs = S.pairs_within(one(0), one(1), R, BY, cells=True).withColumn("cost", cost)
    # a point's first choice shows in its cell; of each b point only the best of a task is shuffled
    first = F.row_number().over(Window.partitionBy("obs_id", *S.CELL, "pt_idx").orderBy("cost", "b_pt_idx")) == 1
    best = pairs.withColumn("first", first).groupBy("obs_id", "b_pt_idx").agg(F.min(F.struct("cost", "pt_idx", "first")).alias("m"))
    return best.where("m.first").select("obs_id", "m.pt_idx", "b_pt_idx")


#: The given vectors lie farther apart than image features, whose bound is 0.40.
SOFT = 1.3
_WORD_D = "sqrt(list_sum(list_transform(list_zip(d.vec, n.vec), lambda t: (t[1]::double - t[2]::double) * (t[1]::double - t[2]::double))))"


@query("j20_bow_candidates", V.sql(f""", near as materialized (select d.vec_id, d.source_id, n.vec_id as word, {_WORD_D} as d from descriptors d join descriptors n on n.vec_id between 1 and 20),
best as materialized (select vec_id, source_id, arg_min(word, {{'d': d, 'w': word}}) as word from near group by all)
select a.source_id, a.vec_id, b.vec_id as b_vec_id, word, {q4('a.d')} as d from near a join best b using (word) where b.source_id = (a.source_id + 1) % 50 and a.d < {SOFT}""", "descriptors").replace("\n, ", ",\n"))
def j20(spark, d):
    """Keypoints of each frame and the next that share a word: the next one's closest of twenty, any near one of the frame's own."""
    e = V.descriptors(spark, d)
    words = e.where("vec_id between 1 and 20").select(F.col("vec_id").alias("node_id"), F.col("vec").alias("centroid"))
    later = e.withColumn("source_id", F.pmod(F.col("source_id") - 1, F.lit(50)).cast("int"))
    found = B.soft_matches(e, later, words, SOFT, ("source_id",))
    return found.select("source_id", "vec_id", "b_vec_id", "word", r4("d").alias("d"))


_CENTRES = "c as (select obs_id, cast(floor(pt_idx / 20) as bigint) as seg, avg(x) x, avg(y) y, avg(z) z from points group by all)"


def segment_centres(spark, d):
    p = V.points(spark, d).withColumn("seg", F.floor(F.col("pt_idx") / 20))
    return p.groupBy("obs_id", "seg").agg(*(F.avg(k).alias(k) for k in "xyz"))


@query("j21_adjacent_segments", V.sql(f", {_CENTRES} select a.obs_id, a.seg as i, b.seg as j from c a join c b on a.obs_id = b.obs_id and a.seg > b.seg and {distance('a', 'b')} <= 0.9013 * 0.9013", "points").replace("\n, ", ",\n"))
def j21(spark, d):
    c = segment_centres(spark, d)
    return S.pairs_within(c, c, 0.9013, BY).where("seg > b_seg").select("obs_id", F.col("seg").alias("i"), F.col("b_seg").alias("j"))


@query("j22_best_view", V.sql(f"""select obs_id, label, arg_max(cam, {{'n': n, 'c': -cam}}) as view, max(n) as n from (select obs_id, label, cam, count(*) n from (select obs_id, label, cam, x - cam * 0.51::double - 1.03::double as x, z - 0.93::double as y, y + 0.11::double as z
from label_points, (values (0), (1), (2), (3), (4), (5), (6)) t(cam)) where {_FRUSTUM} group by all) group by all""", "label_points"))
def j22(spark, d):
    """Of seven cameras in a row, the one whose frustum holds most points of a label."""
    cam = F.explode(F.array(*(F.lit(k) for k in range(7)))).alias("cam")
    p = V.label_points(spark, d).select("obs_id", "label", "x", "y", "z", cam)
    seen = p.select("obs_id", "label", "cam", (F.col("x") - F.col("cam") * 0.51 - 1.03).alias("x"), (F.col("z") - 0.93).alias("y"), (F.col("y") + 0.11).alias("z")).where(in_frustum())
    n = seen.groupBy("obs_id", "label", "cam").agg(F.count("*").alias("n"))
    return n.groupBy("obs_id", "label").agg(F.max(F.struct("n", (-F.col("cam")).alias("c"))).alias("m")).select("obs_id", "label", (-F.col("m.c")).alias("view"), F.col("m.n").alias("n"))


_PAIRS = """pairs as (select a.frame_id as src, b.frame_id as dst, (b.z - a.z) / (a.z * a.z + b.z * b.z) as res, 1 - abs(a.nx) / 2 as w from (select *, depth * 0.001 as z from pixels where depth > 0) a join (select *, depth * 0.001 as z from pixels where depth > 0) b
on a.u = b.u and a.v = b.v and b.frame_id - a.frame_id in (1, -1) and a.mask = 1)"""
_SCORES = f"{_PAIRS}, scores as (select src, dst, sum(case when abs(res) < 0.2003 then w else 0.0 end) as score, sum(case when res > 0.2003 then w else 0.0 end) as occ from pairs group by all)"


def frame_pairs(spark, d, shift: str = "0"):
    """(src, dst, za, zb, w): pixels of neighbouring frames that share a place, frames moved along their view."""
    p = V.pixels(spark, d).where("depth > 0").withColumn("z", F.col("depth") * 0.001 + F.expr(shift))
    a = p.where("mask = 1").select(F.col("frame_id").alias("src"), "u", "v", F.col("z").alias("za"), (1 - F.abs("nx") / 2).alias("w"))
    # only neighbouring frames are compared: each frame meets the one before and the one after
    b = p.select(F.explode(F.array(F.col("frame_id") - 1, F.col("frame_id") + 1)).alias("src"), F.col("frame_id").alias("dst"), "u", "v", F.col("z").alias("zb"))
    return a.join(b, ["src", "u", "v"]).select("src", "dst", "za", "zb", "w")


def frame_scores(spark, d, shift: str = "0"):
    """Agreement and occlusion of pixels of neighbouring frames that share a place."""
    res = (F.col("zb") - F.col("za")) / (F.col("za") * F.col("za") + F.col("zb") * F.col("zb"))
    pairs = frame_pairs(spark, d, shift).withColumn("res", res)
    return pairs.groupBy("src", "dst").agg(F.sum(F.when(F.abs("res") < 0.2003, F.col("w")).otherwise(0.0)).alias("score"), F.sum(F.when(F.col("res") > 0.2003, F.col("w")).otherwise(0.0)).alias("occ"))


@query("j23_view_pair_scores", V.sql(f", {_SCORES} select src, dst, {q4('score')} as score, {q4('occ')} as occ from scores", "pixels").replace("\n, ", ",\n"))
def j23(spark, d):
    return frame_scores(spark, d).select("src", "dst", r4("score").alias("score"), r4("occ").alias("occ"))


@query("j24_existing_only", V.sql("select waypoint, obs_id, rank from (select waypoint, obs_id, row_number() over (partition by waypoint order by start_ts desc, obs_id) as rank from observations where exists (select 1 from lineitem where l_orderkey = obs_id)) where rank <= 10", "observations"))
def j24(spark, d):
    """Results whose files (here: line items) exist, the ten newest of each place."""
    store = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("obs_id"))
    found = V.observations(spark, d).join(store, "obs_id", "left_semi")
    return T.top(found, ["waypoint"], 10, F.desc("start_ts"), F.asc("obs_id")).select("waypoint", "obs_id", F.col("rank").cast("long").alias("rank"))


_VIEWER = """scene as (select obs_id, (obs_id % 7) * 0.5::double as vx, (obs_id % 5) * 0.5::double as vy, 1.2::double as vz, avg(x) as mx, avg(y) as my from label_points group by 1),
turned as (select *, (mx - vx) / sqrt((mx - vx) * (mx - vx) + (my - vy) * (my - vy)) as c, (my - vy) / sqrt((mx - vx) * (mx - vx) + (my - vy) * (my - vy)) as s from scene),
o as (select obs_id, label, c * (x - vx) + s * (y - vy) as x, c * (y - vy) - s * (x - vx) as y, z - vz as z from (select obs_id, label, avg(x) as x, avg(y) as y, avg(z) as z from label_points group by all) join turned using (obs_id))"""


def viewed(objects, viewpoints, by):
    """Poses (``pose``, 12 numbers) of objects in the frame of their scene's viewpoint (``viewpoint``)."""
    both = objects.join(viewpoints, by)
    return both.withColumn("pose", G.compose(G.inverse(F.col("viewpoint")), F.col("pose"))).drop("viewpoint")


def object_pairs(objects, by, name):
    """Ordered pairs of different objects of a scene with the places of both: what relations between them are told from."""
    at = [F.col("pose")[i].alias(k) for i, k in ((3, "x"), (7, "y"), (11, "z"))]
    side = lambda p: objects.select(*by, F.col(name).alias(p), F.struct(*at).alias(f"at_{p}"))
    return side("a").join(side("b"), by).where("a <> b")


@query("j25_object_pairs", V.sql(f", {_VIEWER} select a.obs_id, a.label as a, b.label as b, {q4('a.x')} as ax, {q4('a.y')} as ay, {q4('b.x')} as bx, {q4('b.y')} as by, {q4('b.z - a.z')} as dz from o a join o b on a.obs_id = b.obs_id and a.label <> b.label", "label_points").replace("\n, ", ",\n"))
def j25(spark, d):
    """Objects of each scene in the frame of a viewer that looks at the scene's middle."""
    p = V.label_points(spark, d)
    pose = lambda c, s, x, y, z: F.array(*(k if not isinstance(k, float) else F.lit(k) for k in (c, -s, F.lit(0.0), x, s, c, F.lit(0.0), y, 0.0, 0.0, 1.0, z)))
    middle = p.groupBy("obs_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    own = middle.withColumns({"vx": F.col("obs_id") % 7 * 0.5, "vy": F.col("obs_id") % 5 * 0.5})
    dx, dy = F.col("mx") - F.col("vx"), F.col("my") - F.col("vy")
    n = F.sqrt(dx * dx + dy * dy)
    viewpoints = own.select("obs_id", pose(dx / n, dy / n, F.col("vx"), F.col("vy"), F.lit(1.2)).alias("viewpoint"))
    objects = p.groupBy("obs_id", "label").agg(*(F.avg(k).alias(k) for k in "xyz")).select("obs_id", "label", pose(F.lit(1.0), F.lit(0.0), *map(F.col, "xyz")).alias("pose"))
    pairs = object_pairs(viewed(objects, viewpoints, BY), BY, "label")
    return pairs.select("obs_id", "a", "b", *(r4(F.col(f"at_{o}.{k}")).alias(f"{o}{k}") for o in "ab" for k in "xy"), r4(F.col("at_b.z") - F.col("at_a.z")).alias("dz"))


@query("j26_previous_observation", V.sql("select obs_id, lag(obs_id) over (partition by waypoint order by start_ts, obs_id) as previous from observations", "observations"))
def j26(spark, d):
    return V.observations(spark, d).select("obs_id", F.lag("obs_id").over(Window.partitionBy("waypoint").orderBy("start_ts", "obs_id")).alias("previous"))


@query("j27_transfer_color", V.sql(f", {_NEAREST}, once as (select *, row_number() over (partition by obs_id, b_pt_idx order by pt_idx) as rn from nearest) select o.obs_id, o.pt_idx, p.r, p.g, p.b from once o join points p on p.obs_id = o.obs_id and p.pt_idx = o.b_pt_idx where rn = 1", "points").replace("\n, ", ",\n"))
def j27(spark, d):
    near = S.nearest(cloud(spark, d, 0), cloud(spark, d, 1), R, BY, attributes=("r", "g", "b"))
    return S.transfer_once(near, BY).select("obs_id", "pt_idx", *(F.col(f"b_{k}").alias(k) for k in "rgb"))


@query("j28_segment_surfels", V.sql(f", {_NEAREST} select obs_id, pt_idx, cast(floor(pt_idx / 20) as bigint) as seg, b_pt_idx as surfel from nearest", "points").replace("\n, ", ",\n"))
def j28(spark, d):
    near = S.nearest(cloud(spark, d, 0), cloud(spark, d, 1), R, BY)
    return near.select("obs_id", "pt_idx", F.floor(F.col("pt_idx") / 20).alias("seg"), F.col("b_pt_idx").alias("surfel"))
