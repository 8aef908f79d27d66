"""Queries of object models and view planning (M)."""

from __future__ import annotations

from math import cos, sin

import numpy as np
from pyspark.sql import functions as F

from placelens.functions import geometry as G
from placelens.operators import fusion as U, poses as P, rays as rays_op
from placelens.plans.aggregates import _PAIR, VOXEL, crossed_sql, pair_scores, tidy
from placelens.plans.joins import _HIST, histograms
from placelens.plans.projections import CAM, POLYGON, POSE, _EDGES, inside_polygon
from placelens.plans.registry import q4, query, r4
from placelens.scratch import materialize
from placelens.sources import views as V


def model_points(pixels):
    """Masked pixels with depth as points in the map frame, weighted by 1 / z squared."""
    seen = pixels.where("mask <> 0 and depth <> 0").withColumns(G.backproject("u", "v", "depth", *CAM))
    return seen.withColumn("weight", 1 / (F.col("z") * F.col("z"))).withColumns(G.apply_pose(POSE))


_MODEL = """(select frame_id, u, v, 0.8 * px + -0.6 * py + 0.0 * pz + 1.0 as x, 0.6 * px + 0.8 * py + 0.0 * pz + -2.0 as y, pz + 0.5 as z, 1 / (pz * pz) as weight from (select frame_id, u, v, (u - 317.0) * d / 528.0 as px, (v - 245.0) * d / 525.0 as py, d as pz
from (select *, depth * 0.001::double as d from pixels where mask <> 0 and depth <> 0)))"""


@query("m1_model_points", V.sql(f"select frame_id, u, v, {q4('x')} as x, {q4('y')} as y, {q4('z')} as z, {q4('weight')} as weight from {_MODEL}", "pixels"))
def m1(spark, d):
    return model_points(V.pixels(spark, d)).select("frame_id", "u", "v", *(r4(k).alias(k) for k in ("x", "y", "z", "weight")))


@query("m2_recompute_model", V.sql(f"select frame_id, count(*) as n, {q4('sum(weight)')} as weight from {_MODEL} group by 1", "pixels"))
def m2(spark, d):
    return model_points(V.pixels(spark, d)).groupBy("frame_id").agg(F.count("*").alias("n"), r4(F.sum("weight")).alias("weight"))


@query("m3_recompute_scores", V.sql(f", {_PAIR} select i // 10 as model, {q4('sum(total)')} as total from pair group by 1", "pixels").replace("\n, ", ",\n"))
def m3(spark, d):
    return pair_scores(spark, d).groupBy(F.floor(F.col("i") / 10).alias("model")).agg(r4(F.sum("total")).alias("total"))


#: Camera of the given pixels, whose images are 64 x 48.
SMALL = (52.8, 52.5, 31.7, 24.5)

#: Candidate poses: 50 along the view, 50 sideways, 50 turns about the upright axis; the middle one of each moves nothing.
STEPS = 0.0120771, 0.0200917, 0.0101327
POSES, UNMOVED = 150, 25


def candidate_poses() -> np.ndarray:
    """(POSES, 12)"""
    out = np.zeros((POSES, 3, 4))
    out[:, range(3), range(3)] = 1.0
    for k in range(POSES):
        step = (k % 50 - 25) * STEPS[k // 50]
        if k < 50:
            out[k, 2, 3] = step
        elif k < 100:
            out[k, 0, 3] = step
        else:
            out[k, 0, 0] = out[k, 2, 2] = cos(step)
            out[k, 0, 2], out[k, 2, 0] = sin(step), -sin(step)
    return out.reshape(POSES, 12)


def images(spark, d):
    """(frame_id, u, v, z, w, masked): pixels that have a depth."""
    p = V.pixels(spark, d).where("depth > 0")
    return p.select("frame_id", "u", "v", (F.col("depth") * 0.001).alias("z"), (1 - F.abs("nx") / 2).alias("w"), (F.col("mask") == 1).alias("masked"))


def neighbours(frames):
    """(src, dst): each frame and the ones before and after it."""
    return frames.select(F.col("frame_id").alias("src"), F.explode(F.array(F.col("frame_id") - 1, F.col("frame_id") + 1)).alias("dst"))


_IMAGE = "image as (select frame_id, u, v, depth * 0.001 as z, 1 - abs(nx) / 2 as w, mask = 1 as masked from pixels where depth > 0)"
_WORTH = "case when abs((b.z - pz) / (pz * pz + b.z * b.z)) < 0.2003 then a.w when (b.z - pz) / (pz * pz + b.z * b.z) > 0.2003 then -a.w else 0.0 end"
_HITS = "pz > 0 and b.u = floor(px * 52.8::double / pz + 31.7::double + 0.5) and b.v = floor(y * 52.5::double / pz + 24.5::double + 0.5)"
_SPACE = "select frame_id, w, (u - 31.7::double) * z / 52.8::double as x, (v - 24.5::double) * z / 52.5::double as y, z from image where masked"
_TURN = "turns as (select frame_id, (frame_id % 5 - 2) * 0.0303::double as t, (frame_id % 3 - 1) * 0.0511::double as sx, (frame_id % 4 - 1) * 0.0407::double as sz from image group by all)"
_TOTALS = f"""{_IMAGE}, {_TURN}, space as ({_SPACE}),
ends as (select a.frame_id as src, b.frame_id as dst, a.t as ta, b.t as tb, a.sx - b.sx as sx, a.sz - b.sz as sz from turns a join turns b on abs(a.frame_id - b.frame_id) = 1),
moved as (select src, dst, w, x as px, y, z as pz, 'old' as kind from space join ends on src = frame_id union all
select src, dst, w, cos(tb) * (cos(ta) * x + sin(ta) * z + sx) - sin(tb) * (-sin(ta) * x + cos(ta) * z + sz), y, sin(tb) * (cos(ta) * x + sin(ta) * z + sx) + cos(tb) * (-sin(ta) * x + cos(ta) * z + sz), 'new' from space join ends on src = frame_id),
met as (select src // 10 as model, sum(case when kind = 'old' then worth else 0 end) as before, sum(case when kind = 'new' then worth else 0 end) as after from (select src, kind, {_WORTH} as worth from moved a join image b on b.frame_id = a.dst and {_HITS}) group by 1)"""


def frame_poses(frames):
    """(frame_id, m): a second set of poses, in which each frame is turned and moved a little."""
    f = F.col("frame_id")
    t, zero, one = (f % 5 - 2) * 0.0303, F.lit(0.0), F.lit(1.0)
    m = F.array(F.cos(t), zero, F.sin(t), (f % 3 - 1) * 0.0511, zero, one, zero, zero, -F.sin(t), zero, F.cos(t), (f % 4 - 1) * 0.0407)
    return frames.select("frame_id", m.alias("m"))


@query("m4_accept_if_better", V.sql(f", {_TOTALS} select model, coalesce(after, 0) >= coalesce(before, 0) as accepted, {q4('greatest(coalesce(before, 0), coalesce(after, 0))')} as total from (select distinct frame_id // 10 as model from image) left join met using (model)", "pixels").replace("\n, ", ",\n"))
def m4(spark, d):
    """Of two sets of poses of the frames (none moved; each turned and moved) the second stays when its total is not lower."""
    image = images(spark, d)
    frames = image.select("frame_id").distinct()
    posed = frame_poses(frames)
    ends = neighbours(frames).join(posed.toDF("src", "a"), "src").join(posed.toDF("dst", "b"), "dst").select("src", "dst", G.compose(G.inverse(F.col("b")), F.col("a")).alias("m"))
    unmoved = ends.select("src", "dst", F.array(*(F.lit(float(i % 5 == 0)) for i in range(12))).alias("m"))
    model = F.floor(F.col("src") / 10).alias("model")
    total = lambda poses, name: P.posed_scores(image, poses, SMALL).groupBy(model).agg(F.sum(F.col("score") - F.col("occ")).alias(name))
    models = frames.select(F.floor(F.col("frame_id") / 10).alias("model")).distinct()
    t = models.join(total(unmoved, "before"), "model", "left").join(total(ends, "after"), "model", "left").fillna(0.0, ["before", "after"])
    return t.select("model", (F.col("after") >= F.col("before")).alias("accepted"), r4(F.greatest("before", "after")).alias("total"))


_CANDIDATES = f"""cands as (select k, case when k < 50 then step else 0 end as sz, case when k between 50 and 99 then step else 0 end as sx, case when k > 99 then cos(step) else 1 end as c, case when k > 99 then sin(step) else 0 end as s
from (select k, (k % 50 - 25) * case k // 50 when 0 then {STEPS[0]}::double when 1 then {STEPS[1]}::double else {STEPS[2]}::double end as step from range({POSES}) r(k)))"""


@query("m5_choose_pose", V.sql(f""", {_IMAGE}, {_CANDIDATES}, tried as (select frame_id as src, k, w, c * x + s * z + sx as px, y, -s * x + c * z + sz as pz from ({_SPACE}), cands),
met as (select src, k, sum({_WORTH}) as total from tried a join image b on abs(b.frame_id - a.src) = 1 and {_HITS} group by all),
total as (select src, k, coalesce(total, 0) as total from (select distinct frame_id as src from image where masked) cross join cands left join met using (src, k)),
best as (select src, arg_max(k, {{'t': total, 'k': -k}}) as k, max(total) as most, max(total) filter (k = {UNMOVED}) as before from total group by 1)
select src, case when most > before then k end as pose, {q4('case when most > before then most - before else 0.0 end')} as gain from best""", "pixels").replace("\n, ", ",\n"))
def m5(spark, d):
    """The best of 150 candidate poses of each frame against its neighbours."""
    image = images(spark, d)
    scores = P.hypothesis_scores(image, neighbours(image.select("frame_id").distinct()), candidate_poses(), SMALL)
    return P.best_pose(scores, ["src"], UNMOVED).select("src", "pose", r4("gain").alias("gain"))


_RAY = "select obs_id, pt_idx, x - 2.53 as vx, y - 4.07 as vy, z - 1.03 as vz from points"
_SLAB = lambda f: ", ".join(f"{f}((1.01 - 2.53) / vx, (4.02 - 2.53) / vx)".replace("vx", f"v{k}").replace("2.53", o).replace("1.01", a).replace("4.02", b) for k, o, a, b in (("x", "2.53", "3.01", "4.52"), ("y", "4.07", "1.03", "6.04"), ("z", "1.03", "-0.52", "1.51")))


#: Lowest and highest corner of the box in which planning looks for gain.
BOX = (3.01, 1.03, -0.52), (4.52, 6.04, 1.51)


@query("m6_rays_clip", V.sql(f"select obs_id, pt_idx, {q4('near')} as entry, {q4('far - near')} as length from (select obs_id, pt_idx, greatest(0.0, {_SLAB('least')}) as near, least({_SLAB('greatest')}) as far from ({_RAY})) where near < far", "points"))
def m6(spark, d):
    """Rays from a sensor to every point, clipped to a box."""
    rays = V.points(spark, d).select("obs_id", "pt_idx", (F.col("x") - 2.53).alias("vx"), (F.col("y") - 4.07).alias("vy"), (F.col("z") - 1.03).alias("vz")).withColumns({"ox": F.lit(2.53), "oy": F.lit(4.07), "oz": F.lit(1.03)})
    clip = rays_op.clip(rays_op.FROM, ("vx", "vy", "vz"), *BOX)
    return rays.withColumns(clip).where("entry is not null").select("obs_id", "pt_idx", r4("entry").alias("entry"), r4("length").alias("length"))


@query("m7_sensor_rays", V.sql(f"select waypoint, u.i * 160 as u, v.i * 160 as v, {q4('min(cx + (u.i * 160 - 317.0) / 528.0)')} as x, {q4('min(cy + (v.i * 160 - 245.0) / 525.0)')} as y from observations, range(4) u(i), range(3) v(i) group by waypoint, u.i, v.i", "observations"))
def m7(spark, d):
    """One ray for each sub-sampled pixel of the westernmost camera of a waypoint."""
    at = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n), F.lit(160)).cast("array<long>"))
    o = V.observations(spark, d).groupBy("waypoint").agg(F.min("cx").alias("cx"), F.min("cy").alias("cy")).withColumn("u", at(639)).withColumn("v", at(479))
    return o.select("waypoint", "u", "v", r4(F.col("cx") + (F.col("u") - 317.0) / 528.0).alias("x"), r4(F.col("cy") + (F.col("v") - 245.0) / 525.0).alias("y"))


#: Chance that a cell lets the next one be seen.
TRANSPARENCY = 0.95


def gain_sql() -> str:
    """gains: the two recursions over the cells of each ray, as lists (seen, p, before, n, gain)."""
    h = lambda p: f"case when {p} <= 0 or {p} >= 1 then 0 else -({p} * ln({p}) + (1 - {p}) * ln(1 - {p})) end"
    near = ", ".join(f"case when v{k} = 0 then case when o{k} between {a} and {b} then '-inf'::double else 'inf'::double end else least(({a} - o{k}) / v{k}, ({b} - o{k}) / v{k}) end" for k, a, b in zip("xyz", *BOX))
    far = ", ".join(f"case when v{k} = 0 then case when o{k} between {a} and {b} then 'inf'::double else '-inf'::double end else greatest(({a} - o{k}) / v{k}, ({b} - o{k}) / v{k}) end" for k, a, b in zip("xyz", *BOX))
    predicted = f"({TRANSPARENCY}::double ** (a[4] + 1) * a[1] + 1e-8::double * (1 - a[1]))"
    seen = "((1 - a[3]) * w / ((1 - a[3]) * w + a[3] * (1 - w)))"
    guess = "((0.5 + s / 2) * a[2] + (0.5 - s / 2) * (1 - a[2]))"
    return f"""vox as (select obs_id, {VOXEL.format('0.97')}, least(0.97, 0.2 + 0.1 * count(*)) as p from points group by all),
rays as (select p.obs_id, p.view_no, pt_idx, tx as ox, ty as oy, tz as oz, x - tx as vx, y - ty as vy, z - tz as vz from points p join transforms using (obs_id, view_no)),
clipped as (select *, greatest(0.0::double, {near}) as near, least({far}) as far from rays),
lines as (select *, near + (far - near) as reach, near / (near + (far - near)) as inside, {", ".join(f"o{k} + v{k} * (near + (far - near)) as e{k}" for k in "xyz")} from clipped where near < far and far < 'inf'::double),
{crossed_sql("lines", "0.97")},
cells as (select r.obs_id, r.view_no, pt_idx, list([coalesce(p, 0.5), case when t1 - inside > 1e-9 then 1.0 else 0.0 end]::double[] order by step) as cs
  from legs r left join vox v on v.obs_id = r.obs_id and v.cx = r.cx and v.cy = r.cy and v.cz = r.cz group by all),
walked as (select obs_id, view_no, list_reduce(cs, lambda a, e: list_transform([{predicted}], lambda w: list_transform([{seen}], lambda s: list_transform([{guess}], lambda g:
    list_transform([case when e[1] * g + (1 - e[1]) * (1 - g) = 0 then 1 else e[1] * g / (e[1] * g + (1 - e[1]) * (1 - g)) end], lambda p:
      [s, p, e[1], a[4] + 1, a[5] + e[2] * (({h('e[1]')}) - ({h('p')}))]::double[])[1])[1])[1])[1], [1, 0, 0.5, 0, 0]::double[])[5] as gain from cells),
gains as (select obs_id, view_no, sum(gain) as gain from walked group by all)"""


def gains(spark, d):
    """Gain of every view that has a pose: rays go from there through each of its points."""
    p = V.points(spark, d)
    vox = p.groupBy("obs_id", *(G.cell(k, 0.97).alias(f"c{k}") for k in "xyz")).agg(F.least(F.lit(0.97), 0.2 + 0.1 * F.count("*")).alias("p"))
    posed = p.join(V.transforms(spark, d), ["obs_id", "view_no"])
    along = {f"v{k}": F.col(k) - F.col(f"t{k}") for k in "xyz"} | {f"o{k}": F.col(f"t{k}") for k in "xyz"}
    return rays_op.view_gain(posed.withColumns(along), vox, 0.97, *BOX, ["obs_id"], ["view_no"], "pt_idx", TRANSPARENCY)


@query("m8_view_gain", tidy(V.sql(f", {gain_sql()} select obs_id, view_no, {q4('gain')} as gain from gains", "points", "transforms")))
def m8(spark, d):
    return gains(spark, d).select("obs_id", "view_no", r4("gain").alias("gain"))


_NEXT = "select obs_id, arg_max(view_no, {'g': round(gain, 6), 'v': -view_no}) as view_no from gains where view_no <> 1 and gain > 0 group by 1"


@query("m9_next_view", tidy(V.sql(f", {gain_sql()} {_NEXT}", "points", "transforms")))
def m9(spark, d):
    """The largest positive gain among the views not used yet (view 1 is)."""
    g = gains(spark, d).where("view_no <> 1 and gain > 0")
    return g.groupBy("obs_id").agg(F.max_by("view_no", F.struct(F.round("gain", 6), -F.col("view_no"))).alias("view_no"))


_FREE = "g as (select obs_id, cast(floor(x / 0.53) as bigint) cx, cast(floor(y / 0.53) as bigint) cy, case when max(z) > 3.503 then 100 else 0 end as val from points group by all)"


_FREE_CELLS = "select a.obs_id, a.cx, a.cy from g a join g b on a.obs_id = b.obs_id and abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 group by all having max(b.val) = 0"


def footprint_free(points):
    """(obs_id, cx, cy): seen cells around which a robot's footprint touches nothing occupied."""
    g = points.groupBy("obs_id", G.cell("x", 0.53).alias("cx"), G.cell("y", 0.53).alias("cy")).agg(F.when(F.max("z") > 3.503, 100).otherwise(0).alias("val"))
    near = g
    for k in ("cx", "cy"):
        near = near.withColumn(k, F.explode(F.sequence(F.col(k) - 1, F.col(k) + 1)))
    worst = near.groupBy("obs_id", "cx", "cy").agg(F.max("val").alias("worst")).where("worst = 0")
    return g.join(worst, ["obs_id", "cx", "cy"], "left_semi").select("obs_id", "cx", "cy")


@query("m11_footprint_free", V.sql(f", {_FREE} {_FREE_CELLS}", "points").replace("\n, ", ",\n"))
def m11(spark, d):
    return footprint_free(V.points(spark, d))


_RING = f"""{{free}}, ring as (select obs_id, a, k, mx + (0.3 + k * 0.1) * cos(a * 2 * pi() / 25) as x, my + (0.3 + k * 0.1) * sin(a * 2 * pi() / 25) as y from (select obs_id, avg(x) + 0.0137 as mx, avg(y) + 0.0171 as my from points group by 1), range(25) t(a), range(100) s(k))
select obs_id, cast(a as int) as angle, min(k) as step from ring where ({_EDGES}) % 2 = 1 and exists (select 1 from free f where f.obs_id = ring.obs_id and f.cx = cast(floor(x / 0.53) as bigint) and f.cy = cast(floor(y / 0.53) as bigint)) group by all"""


@query("m10_ring_views", V.sql(", " + _RING.format(free=_FREE + ", free as (" + _FREE_CELLS + ")"), "points").replace("\n, ", ",\n"))
def m10(spark, d):
    """For each of 25 angles around a target, the first of 100 radii that lies in the region and where the robot fits."""
    t = V.points(spark, d).groupBy("obs_id").agg((F.avg("x") + 0.0137).alias("mx"), (F.avg("y") + 0.0171).alias("my"))
    ring = t.withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(99)).cast("array<long>")))
    turn = F.col("angle") * 2 * F.pi() / 25
    at = ring.withColumns({"x": F.col("mx") + (0.3 + F.col("step") * 0.1) * F.cos(turn), "y": F.col("my") + (0.3 + F.col("step") * 0.1) * F.sin(turn)}).where(inside_polygon("x", "y"))
    at = at.withColumns({"cx": G.cell("x", 0.53), "cy": G.cell("y", 0.53)}).join(footprint_free(V.points(spark, d)), ["obs_id", "cx", "cy"], "left_semi")
    return at.groupBy("obs_id", "angle").agg(F.min("step").alias("step"))



_PART = "select frame_id, frame_id // 4 as pair, frame_id % 4 // 2 as model, (frame_id * 7 + depth) % 5 // 3 as part from pixels"


@query("m12_fusion_outcome", V.sql(f"""select pair, case when parts = 1 then 'merge' when intact = 1 then 'keep' else 'split' end as outcome, parts from (select pair, count(distinct part) as parts, case when max(n) = 1 then 1 else 0 end as intact from
({_PART}) join (select pair, model, count(distinct part) as n from ({_PART}) group by all) using (pair, model) group by 1)""", "pixels"))
def m12(spark, d):
    """One part merges both models, parts equal to the models change nothing, others split them."""
    f = F.col("frame_id")
    p = V.pixels(spark, d).select(F.floor(f / 4).alias("pair"), F.floor(f % 4 / 2).alias("model"), F.floor((f * 7 + F.col("depth")) % 5 / 3).alias("part"))
    return U.fusion_outcome(p)


NEAREST, LEAST = 150, 0.3003


#: Agreement less occlusion that two models need in their best pose; the given images are sparse.
AGREEMENT = 15.0


def agreeing(spark, d):
    """Which pairs of models merge: the best of 150 poses of the one against the other decides whether they are one part or two.

    A model's image holds the nearest pixel of its members. Models are taken whole, so
    that a pair is merged or kept; it is never split.
    """
    image = materialize(images(spark, d), "images")
    poses = candidate_poses()

    def accepted(pairs, label):
        near = image.join(label.withColumnRenamed("member", "frame_id"), "frame_id").groupBy("model", "u", "v").agg(F.min(F.struct("z", "w", "masked")).alias("p"))
        rendered = materialize(near.select(F.col("model").alias("frame_id"), "u", "v", "p.*"), "rendered")
        ends = pairs.select(F.col("model").alias("src"), F.col("other").alias("dst"))
        best = P.best_pose(P.hypothesis_scores(rendered, ends, poses, SMALL), ["src", "dst"], UNMOVED)
        one = F.col("total") > AGREEMENT
        each = F.explode(F.array(*(F.struct(F.col(k).alias("model"), F.when(one, F.col("src")).otherwise(F.col(k)).alias("part")) for k in ("src", "dst")))).alias("e")
        outcome = U.fusion_outcome(best.select(F.struct("src", "dst").alias("pair"), each).select("pair", "e.model", "e.part"))
        return outcome.where("outcome = 'merge'").select(F.col("pair.src").alias("model"), F.col("pair.dst").alias("other"))

    return accepted


def model_counts(spark, d):
    p = V.points(spark, d)
    return p.groupBy(F.col("obs_id").alias("model"), G.rgb_bin("r", "g", "b", 8).alias("bin")).agg(F.count("*").alias("n"))


@query("m13_fusion_round", V.sql(f""", {_HIST}, s as (select a.obs_id, b.obs_id as other, round(sum(least(a.w, b.w)), 6) as score from h a join h b using (bin) where a.obs_id <> b.obs_id group by all),
best as (select obs_id, arg_max(other, {{'s': score, 'o': -other}}) as other from s where score > {LEAST} group by 1)
select a.obs_id as model, a.other from best a join best b on a.other = b.obs_id and b.other = a.obs_id where a.obs_id < a.other""", "points").replace("\n, ", ",\n"))
def m13(spark, d):
    """One round over all models: the changes to apply."""
    return U.mutual(U.similar_models(model_counts(spark, d), NEAREST, LEAST))


@query("m13_fuse_models")
def m13_all(spark, d):
    """All rounds: the model that each observation ends in; ``agreeing`` lets poses decide too, at 150 poses a candidate pair."""
    return U.fuse(model_counts(spark, d), LEAST)
