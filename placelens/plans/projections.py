"""Queries of scalar functions (P) and filters (F)."""

from __future__ import annotations

from pyspark.sql import functions as F, Window

from placelens.functions import geometry as G
from placelens.operators import spatial as S
from placelens.plans.registry import q4, query, r4
from placelens.operators.tables import seconds
from placelens.sources import views as V

CAM = (528.0, 525.0, 317.0, 245.0)
SMALL_CAM = (40.0, 40.0, 32.0, 24.0)
POSE = [0.8, -0.6, 0.0, 1.0, 0.6, 0.8, 0.0, -2.0, 0.0, 0.0, 1.0, 0.5]
KEY = ["obs_id", "pt_idx"]
PAN, TILT = (-160, 20, 160), (-30, 30, 30)
XYZ = ", ".join(f"{q4(k)} as {k}" for k in "xyz")


def rounded(df, *keep, cols=("x", "y", "z")):
    return df.select(*keep, *(r4(k).alias(k) for k in cols))


@query("p1_backproject", V.sql(f"select frame_id, u, v, {XYZ} from (select frame_id, u, v, (u - 317.0) * d / 528.0 as x, (v - 245.0) * d / 525.0 as y, d as z from (select *, case when depth <> 0 then depth * 0.001::double end as d from pixels))", "pixels"))
def p1(spark, d):
    return rounded(V.pixels(spark, d).select("frame_id", "u", "v", *(c.alias(k) for k, c in G.backproject("u", "v", "depth", *CAM).items())), "frame_id", "u", "v")


@query("p2_project", V.sql("select * from (select obs_id, pt_idx, cast(trunc((x * 40.0 + z * 32.0) / z) as int) as u, cast(trunc((y * 40.0 + z * 24.0) / z) as int) as v from points where z > 0) where u >= 0 and u < 640 and v >= 0 and v < 480", "points"))
def p2(spark, d):
    uv = G.project("x", "y", "z", *SMALL_CAM)
    return V.points(spark, d).where("z > 0").select(*KEY, *(c.alias(k) for k, c in uv.items())).where(G.inside_image("u", "v", 640, 480))


@query("p3_rgbd_from_points", V.sql("select obs_id, pt_idx, cast(trunc(z * 1000) as int) as depth, r, g, b from points", "points"))
def p3(spark, d):
    return V.points(spark, d).select(*KEY, G.depth_of("z").alias("depth"), "r", "g", "b")


@query("p4_reproject_corrected", V.sql(f"select obs_id, pt_idx, {XYZ} from (select obs_id, pt_idx, (pt_idx % 640 - 317.0) * d / 528.0 as x, (pt_idx // 640 - 245.0) * d / 525.0 as y, d as z from (select *, case when trunc(z * 1000) <> 0 then trunc(z * 1000) * 0.001::double end as d from points))", "points"))
def p4(spark, d):
    flat = V.points(spark, d).select(*KEY, (F.col("pt_idx") % 640).alias("u"), F.floor(F.col("pt_idx") / 640).alias("v"), G.depth_of("z").alias("depth"))
    return rounded(flat.select(*KEY, *(c.alias(k) for k, c in G.backproject("u", "v", "depth", *CAM).items())), *KEY)


_MOVED = "0.8::double * x + -0.6::double * y + 0.0::double * z + 1.0::double as x, 0.6::double * x + 0.8::double * y + 0.0::double * z + -2.0::double as y, 0.0::double * x + 0.0::double * y + 1.0::double * z + 0.5::double as z"


@query("p5_transform", V.sql(f"select obs_id, pt_idx, {XYZ} from (select obs_id, pt_idx, {_MOVED} from points)", "points"))
def p5(spark, d):
    return rounded(V.points(spark, d).select(*KEY, *(c.alias(k) for k, c in G.apply_pose(POSE).items())), *KEY)


@query("p6_rebuild_registered", V.sql(f"select obs_id, pt_idx, view_no, {XYZ} from (select obs_id, pt_idx, view_no, x + view_no * 0.5::double as x, y - view_no * 0.25::double as y, z from points)", "points"))
def p6(spark, d):
    poses = V.points(spark, d).select("view_no").distinct().select("view_no", (F.col("view_no") * 0.5).alias("tx"), (F.col("view_no") * -0.25).alias("ty"))
    moved = V.points(spark, d).join(F.broadcast(poses), "view_no").select(*KEY, "view_no", *(c.alias(k) for k, c in G.apply_pose([1.0, 0.0, 0.0, "tx", 0.0, 1.0, 0.0, "ty", 0.0, 0.0, 1.0, 0.0]).items()))
    return rounded(moved, *KEY, "view_no")


@query("p7_compose_inverse", V.sql(f"select obs_id, {q4('0.8 * ox + -0.6 * oy + 1.0')} as tx, {q4('0.6 * ox + 0.8 * oy - 2.0')} as ty, {q4('-(0.8 * ox2 + 0.6 * oy2)')} as ix, {q4('-(-0.6 * ox2 + 0.8 * oy2)')} as iy from (select obs_id, cx as ox, cy as oy, 0.8 * cx + -0.6 * cy + 1.0 as ox2, 0.6 * cx + 0.8 * cy - 2.0 as oy2 from observations)", "observations"))
def p7(spark, d):
    base = F.array(*(F.lit(v) for v in POSE))
    own = F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0)), F.col("cx"), *(F.lit(v) for v in (0.0, 1.0, 0.0)), F.col("cy"), *(F.lit(v) for v in (0.0, 0.0, 1.0, 0.0)))
    both = V.observations(spark, d).withColumn("m", G.compose(base, own)).withColumn("i", G.inverse(F.col("m")))
    return both.select("obs_id", r4(F.col("m")[3]).alias("tx"), r4(F.col("m")[7]).alias("ty"), r4(F.col("i")[3]).alias("ix"), r4(F.col("i")[7]).alias("iy"))


_QUAT = "select name, event_id, value % 7 as w, event_id % 5 - 2.0 as qx, event_id % 3 - 1.0 as qy, event_id % 2 + 0.0 as qz from wobj_obs"


def _quaternions(spark, d):
    e = F.col("event_id")
    return V.wobj_obs(spark, d).select("event_id", (F.floor("value") % 7).cast("double").alias("w"), (e % 5 - 2).cast("double").alias("qx"), (e % 3 - 1).cast("double").alias("qy"), (e % 2).cast("double").alias("qz"))


@query("p8_quat_to_matrix", V.sql(f"""select event_id, {q4('1 - s * (qy * qy + qz * qz)')} as m00, {q4('s * (qx * qy - w * qz)')} as m01, {q4('s * (qx * qz + w * qy)')} as m02, {q4('1 - s * (qx * qx + qz * qz)')} as m11 from
(select *, case when n > 0 then 2.0 / n else 0.0 end as s from (select *, w * w + qx * qx + qy * qy + qz * qz as n from (select event_id, cast(floor(value) % 7 as double) as w, cast(event_id % 5 - 2 as double) as qx, cast(event_id % 3 - 1 as double) as qy, cast(event_id % 2 as double) as qz from wobj_obs)))""", "wobj_obs"))
def p8(spark, d):
    m = G.quat_to_matrix("w", "qx", "qy", "qz")
    return _quaternions(spark, d).select("event_id", *(r4(m[i]).alias(n) for i, n in ((0, "m00"), (1, "m01"), (2, "m02"), (4, "m11"))))


@query("p9_matrix_to_quat", V.sql(f"""select event_id, {q4('abs(w) / sqrt(n)')} as w, {q4('abs(qx) / sqrt(n)')} as x, {q4('abs(qy) / sqrt(n)')} as y, {q4('abs(qz) / sqrt(n)')} as z from
(select *, w * w + qx * qx + qy * qy + qz * qz as n from (select event_id, cast(floor(value) % 7 as double) as w, cast(event_id % 5 - 2 as double) as qx, cast(event_id % 3 - 1 as double) as qy, cast(event_id % 2 as double) as qz from wobj_obs)) where n > 0""", "wobj_obs"))
def p9(spark, d):
    """Back from the matrix: the same quaternion, up to its sign and length."""
    n = F.col("w") * F.col("w") + F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + F.col("qz") * F.col("qz")
    m = G.quat_to_matrix("w", "qx", "qy", "qz")
    rows = _quaternions(spark, d).where(n > 0).select("event_id", *(c.alias(f"m{i}") for i, c in enumerate(m)))
    quat = G.matrix_to_quat([F.col(f"m{i}") for i in range(9)])
    return rows.select("event_id", *(r4(F.abs(c)).alias(k) for k, c in quat.items()))


_BINS = "select obs_id, pt_idx, r, least(60, cast(floor((pi() + acos(z / r)) / (2 * pi()) * 61) as int)) as tbin, least(60, cast(floor((pi() + atan2(y, x)) / (2 * pi()) * 61) as int)) as pbin from (select *, sqrt(x * x + y * y + z * z) as r from (select obs_id, pt_idx, x - 2.03 as x, y - 4.01 as y, z - 1.07 as z from points)) where r > 0"


def binned(df):
    """Range and bins seen from a sensor off the points' lattice."""
    moved = df.withColumns({"x": F.col("x") - 2.03, "y": F.col("y") - 4.01, "z": F.col("z") - 1.07})
    return moved.withColumns(G.spherical_bin("x", "y", "z", 61)).where("range > 0")


@query("p10_spherical_bin", V.sql(f"select obs_id, pt_idx, {q4('r')} as range, tbin, pbin from ({_BINS})", "points"))
def p10(spark, d):
    return binned(V.points(spark, d)).select(*KEY, r4("range").alias("range"), "tbin", "pbin")


_HS = """select *, case when hi = 0 then 0.0 else d / hi end as sat, case when hue < 0 then hue + 360 else hue end as h from (select *, case when d = 0 then 0.0 when hi = r then (g - b) / d * 60 when hi = g then ((b - r) / d + 2) * 60 else ((r - g) / d + 4) * 60 end as hue
from (select *, greatest(r, g, b) as hi, cast(greatest(r, g, b) - least(r, g, b) as double) as d from points))"""


@query("p11_rgb_to_hs", V.sql(f"select obs_id, pt_idx, {q4('h')} as hue, {q4('sat')} as sat from ({_HS})", "points"))
def p11(spark, d):
    return V.points(spark, d).select(*KEY, *(r4(c).alias(k) for k, c in G.rgb_to_hs("r", "g", "b").items()))


@query("p12_robust_weight", V.sql(f"""select obs_id, pt_idx, case when a < 1.03 then 1.0 else 0.0 end as threshold, {q4('0.7 / (pow(a, 1.3) + 1e-8)')} as pnorm, {q4('case when a < 1.03 then pow(1 - pow(a / 1.03, 2), 2) else 0.0 end')} as tukey,
{q4('1 / (1 + a / 1.03)')} as fair, {q4('case when a = 0 then 1.0 else 1.03 / a * ((exp(2 * a / 1.03) - 1) / (exp(2 * a / 1.03) + 1)) end')} as logistic, 1.0 as none from (select obs_id, pt_idx, abs(x - 2.52) as a from points)""", "points"))
def p12(spark, d):
    r = V.points(spark, d).withColumn("res", F.col("x") - 2.52)
    kinds = {"threshold": 1.03, "pnorm": 0.7, "tukey": 1.03, "fair": 1.03, "logistic": 1.03, "none": 0.0}
    plain = ("threshold", "none")
    return r.select(*KEY, *((G.robust_weight("res", k, p) if k in plain else r4(G.robust_weight("res", k, p))).alias(k) for k, p in kinds.items()))


@query("p13_trimmed_weight", V.sql("select obs_id, pt_idx, case when row_number() over (partition by obs_id order by abs(x - 2.52), pt_idx) <= cast(floor(count(*) over (partition by obs_id) * 0.7) as bigint) then 1.0 else 0.0 end as weight from points", "points"))
def p13(spark, d):
    w = Window.partitionBy("obs_id")
    rank = F.row_number().over(w.orderBy(F.abs(F.col("x") - 2.52), "pt_idx"))
    # seven tenths in whole numbers: 0.7 times a count may fall short of its whole
    return V.points(spark, d).withColumn("n", F.count("*").over(w)).select(*KEY, F.when(rank <= F.expr("7 * n div 10"), 1.0).otherwise(0.0).alias("weight"))


_ANGLES = """select event_id, p as position, case when p < 51 then -160 + (case when (p // 17) % 2 = 0 then p % 17 else 16 - p % 17 end) * 20 end as pan, case when p < 51 then -30 + (p // 17) * 30 end as tilt from (select event_id, event_id % 60 as p from events)"""


@query("p14_positions_and_angles", f"select event_id, cast(position as int) as position, cast(pan as int) as pan, cast(tilt as int) as tilt, cast(case when pan is null then -1 else position end as int) as back from ({_ANGLES})")
def p14(spark, d):
    p = V.table(spark, d, "events").select("event_id", (F.col("event_id") % 60).cast("int").alias("position"))
    p = p.withColumns(G.angles_of_position("position", PAN, TILT))
    return p.select("event_id", "position", F.col("pan").cast("int").alias("pan"), F.col("tilt").cast("int").alias("tilt"), F.coalesce(G.position_of_angles("pan", "tilt", PAN, TILT), F.lit(-1)).cast("int").alias("back"))


@query("p15_position_count", "select user_id % 4 as kind, cast(max((320 // (20 + user_id % 4 * 20) + 1) * (60 // 30 + 1)) as bigint) as positions, count(*) as n from events group by 1")
def p15(spark, d):
    step = 20 + F.col("kind") * 20
    return V.table(spark, d, "events").select((F.col("user_id") % 4).alias("kind")).groupBy("kind").agg(F.max((F.floor(F.lit(320) / step) + 1) * G.steps(*TILT)).cast("long").alias("positions"), F.count("*").alias("n"))


@query("p16_match_positions", f"with a as (select distinct position, pan, tilt from ({_ANGLES}) where pan is not null) select cast(a.position as int) as a_position, cast(b.position as int) as b_position from a join a b on a.pan = b.pan and a.tilt = b.tilt and b.pan % 40 = 0")
def p16(spark, d):
    p = V.table(spark, d, "events").select((F.col("event_id") % 60).cast("int").alias("position")).distinct().withColumns(G.angles_of_position("position", PAN, TILT)).where("pan is not null")
    return p.withColumnRenamed("position", "a_position").join(p.withColumnRenamed("position", "b_position").where("pan % 40 = 0"), ["pan", "tilt"]).select("a_position", "b_position")


@query("p17_class_type", V.sql(f"select name, coalesce(kind, 'unknown') as class, {q4('coalesce(s, 1.0)')} as confidence from (select name, arg_max(kind, {{'s': s, 'k': kind}}) as kind, max(s) as s from (select name, kind, avg(value) as s from wobj_obs group by all) group by name)", "wobj_obs"))
def p17(spark, d):
    conf = V.wobj_obs(spark, d).groupBy("name", "kind").agg(F.avg("value").alias("s")).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("kind", "s"))).alias("conf"))
    best = G.best_class(F.col("conf"))
    return conf.select("name", best["class"].alias("class"), r4(best["confidence"]).alias("confidence"))


@query("p18_epoch_to_text", V.sql("select event_id, strftime(stamp, '%Y-%m-%d %H:%M:%S') as text from wobj_obs", "wobj_obs"))
def p18(spark, d):
    return V.wobj_obs(spark, d).select("event_id", F.date_format(F.timestamp_seconds(F.floor(seconds("stamp"))), "yyyy-MM-dd HH:mm:ss").alias("text"))


_DIGIT = f"substr('{G.DIGITS}', cast(n // {{p}} % 62 as int) + 1, 1)"


@query("p19_key_from_number", f"select n, regexp_replace({' || '.join(_DIGIT.format(p=62**k) for k in range(10, -1, -1))}, '^a+', '') as key from (select o_orderkey * 7919 * 104729 as n from orders)")
def p19(spark, d):
    n = V.table(spark, d, "orders").select((F.col("o_orderkey") * 7919 * 104729).alias("n"))
    return n.select("n", G.key_from_number("n").alias("key"))


@query("p20_view_heading", V.sql(f"select obs_id, {q4('a')} as yaw, {q4('sin(a / 2)')} as qz, {q4('cos(a / 2)')} as qw from (select obs_id, atan2(4.013 - cy, 9.017 - cx) as a from observations)", "observations"))
def p20(spark, d):
    return V.observations(spark, d).select("obs_id", *(r4(c).alias(k) for k, c in G.view_heading("cx", "cy", F.lit(9.017), F.lit(4.013)).items()))


@query("p21_rgb_bin", V.sql("select obs_id, pt_idx, 64 * (r * 8 // 256) + 8 * (g * 8 // 256) + b * 8 // 256 as bin from points", "points"))
def p21(spark, d):
    return V.points(spark, d).select(*KEY, G.rgb_bin("r", "g", "b", 8).alias("bin"))


_PATH = "'/data/' || strftime(start_ts, '%Y%m%d') || '/patrol_run_' || run_no || '/room_' || (obs_id % 13) || '/room.xml'"


def catalog_paths(spark, d):
    """Observations with the path of their catalog entry."""
    o = V.observations(spark, d)
    return o.withColumn("path", F.concat(F.lit("/data/"), F.date_format("start_ts", "yyyyMMdd"), F.lit("/patrol_run_"), F.col("run_no").cast("string"), F.lit("/room_"), (F.col("obs_id") % 13).cast("string"), F.lit("/room.xml")))


@query("p22_path_parts", V.sql("select obs_id, strftime(start_ts, '%Y%m%d') as date, run_no as patrol, cast(obs_id % 13 as int) as room from observations", "observations"))
def p22(spark, d):
    return catalog_paths(spark, d).select("obs_id", *(c.alias(k) for k, c in G.path_parts("path").items()))


@query("p23_relative_path", V.sql(f"select obs_id, substr({_PATH}, 7) as path from observations", "observations"))
def p23(spark, d):
    return catalog_paths(spark, d).select("obs_id", G.relative_path("path", F.lit("/data/")).alias("path"))


# Filters


@query("f1_drop_missing", V.sql("select obs_id, count(*) as n from points where z <> 0 group by 1", "points"))
def f1(spark, d):
    """Depth 0 is missing."""
    p = V.points(spark, d).withColumn("z", F.when(F.col("z") == 0, F.lit(float("nan"))).otherwise(F.col("z")))
    return p.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z"))).groupBy("obs_id").agg(F.count("*").alias("n"))


@query("f2_centroid_cutoff", V.sql("select obs_id, count(*) as n from points join (select obs_id, avg(x) mx, avg(y) my, avg(z) mz from points group by 1) using (obs_id) where (x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz) <= 3.137 * 3.137 group by 1", "points"))
def f2(spark, d):
    return S.centroid_cutoff(V.points(spark, d), 3.137, ["obs_id"]).groupBy("obs_id").agg(F.count("*").alias("n"))


@query("f3_range_filter", V.sql("select obs_id, pt_idx from points where x * x + y * y + z * z < 3.013 * 3.013", "points"))
def f3(spark, d):
    return V.points(spark, d).where("x * x + y * y + z * z < 3.013 * 3.013").select(*KEY)


@query("f4_pass_through", V.sql("select obs_id, count(*) as n from points where not (z between -1 and 0.21) group by 1", "points"))
def f4(spark, d):
    return V.points(spark, d).where(~F.col("z").between(-1, 0.21)).groupBy("obs_id").agg(F.count("*").alias("n"))


TAN_V, TAN_H = 0.41421356, 0.52056705  # tangents of half of 45 and 55 degrees


def in_frustum(x: str = "x", y: str = "y", z: str = "z", near: float = 0.2, far: float = 4.0):
    """Points of the camera frame (z forwards) that the camera sees."""
    z_ = F.col(z)
    return (z_ >= near) & (z_ <= far) & (F.abs(F.col(y)) <= z_ * TAN_V) & (F.abs(F.col(x)) <= z_ * TAN_H)


_FRUSTUM = f"z >= 0.2 and z <= 4.0 and abs(y) <= z * {TAN_V} and abs(x) <= z * {TAN_H}"
_SEEN = "select obs_id, pt_idx, x - 2.53::double as x, z - 0.93::double as y, y + 0.11::double as z from points"


@query("f5_frustum", V.sql(f"select obs_id, pt_idx from ({_SEEN}) where {_FRUSTUM}", "points"))
def f5(spark, d):
    """The camera stands beside the points and looks along y."""
    seen = V.points(spark, d).select(*KEY, (F.col("x") - 2.53).alias("x"), (F.col("z") - 0.93).alias("y"), (F.col("y") + 0.11).alias("z"))
    return seen.where(in_frustum()).select(*KEY)


@query("f6_frustum_bounds", V.sql(f"""select waypoint, {q4('min(cx - s * ' + str(TAN_H) + ')')} as min_x, {q4('max(cx + s * ' + str(TAN_H) + ')')} as max_x, {q4('min(cz + s)')} as min_z, {q4('max(cz + s)')} as max_z
from observations, (values (0.2::double), (4.0::double)) t(s) group by 1""", "observations"))
def f6(spark, d):
    """Bounds of the corners of all frustums at a waypoint."""
    corner = F.explode(F.array(*(F.struct(F.lit(s * k * TAN_H).alias("x"), F.lit(s * j * TAN_V).alias("y"), F.lit(s).alias("z")) for s in (0.2, 4.0) for k in (-1, 1) for j in (-1, 1))))
    c = V.observations(spark, d).select("waypoint", "cx", "cz", corner.alias("k")).select("waypoint", (F.col("cx") + F.col("k.x")).alias("x"), (F.col("cz") + F.col("k.z")).alias("z"))
    return c.groupBy("waypoint").agg(r4(F.min("x")).alias("min_x"), r4(F.max("x")).alias("max_x"), r4(F.min("z")).alias("min_z"), r4(F.max("z")).alias("max_z"))


_UV = "select *, cast(trunc((x * 40.0 + z * 32.0) / z) as int) as u, cast(trunc((y * 40.0 + z * 24.0) / z) as int) as v from points where z > 0"


def _projected(spark, d):
    return V.points(spark, d).where("z > 0").withColumns(G.project("x", "y", "z", *SMALL_CAM))


@query("f7_mask_filter", V.sql(f"select p.obs_id, pt_idx from ({_UV}) p where exists (select 1 from pixels m where m.frame_id = p.obs_id and m.u = p.u % 64 and m.v = p.v % 48 and mask <> 0)", "points", "pixels"))
def f7(spark, d):
    p = _projected(spark, d).withColumns({"u": F.col("u") % 64, "v": F.col("v") % 48})
    mask = V.pixels(spark, d).where("mask <> 0").select(F.col("frame_id").alias("obs_id"), "u", "v")
    return p.join(mask, ["obs_id", "u", "v"], "left_semi").select(*KEY)


@query("f8_depth_consistent", V.sql(f"select obs_id, view_no, count(*) as hits from ({_UV}) p join pixels m on m.frame_id = p.obs_id and m.u = p.u % 64 and m.v = p.v % 48 and abs(m.depth * 0.001 - z) <= 0.5003 group by all having count(*) >= 5", "points", "pixels"))
def f8(spark, d):
    p = _projected(spark, d).withColumns({"u": F.col("u") % 64, "v": F.col("v") % 48})
    seen = V.pixels(spark, d).select(F.col("frame_id").alias("obs_id"), "u", "v", "depth")
    return p.join(seen, ["obs_id", "u", "v"]).where("abs(depth * 0.001D - z) <= 0.5003").groupBy("obs_id", "view_no").agg(F.count("*").alias("hits")).where("hits >= 5")


@query("f9_confidence_filter", V.sql("select obs_id, count(*) as n from points where (r + g + b) / 765.0 >= 0.4003 group by 1", "points"))
def f9(spark, d):
    """A surfel's confidence stands in for its brightness."""
    return V.points(spark, d).where("(r + g + b) / 765.0D >= 0.4003D").groupBy("obs_id").agg(F.count("*").alias("n"))


@query("f10_finite_descriptors", V.sql("select source_id, count(*) as n from descriptors where len(list_filter(vec, lambda v: isnan(v) or isinf(v))) = 0 group by 1", "descriptors"))
def f10(spark, d):
    finite = F.forall("vec", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return V.descriptors(spark, d).where(finite).groupBy("source_id").agg(F.count("*").alias("n"))


@query("f11_cluster_distance", V.sql("select obs_id, view_no, n from (select obs_id, view_no, count(*) n, avg(x) x, avg(y) y, avg(z) z from points group by all) where sqrt(x * x + y * y + z * z) <= 5.6007", "points"))
def f11(spark, d):
    c = S.centroid(V.points(spark, d), ["obs_id", "view_no"])
    return c.where("sqrt(mx * mx + my * my + mz * mz) <= 5.6007").select("obs_id", "view_no", F.col("n_points").alias("n"))


POLYGON = [(0.51, 0.52), (4.53, 1.07), (4.11, 8.03), (2.57, 4.19), (0.83, 7.91)]


def inside_polygon(x: str, y: str, corners=POLYGON):
    """Odd number of edges crossed by a ray to the right."""
    hits = F.lit(0)
    for (xa, ya), (xb, yb) in zip(corners, corners[1:] + corners[:1]):
        crosses = (F.col(y) < ya) != (F.col(y) < yb)
        at = F.lit(xa) + (F.col(y) - ya) * ((xb - xa) / (yb - ya))
        hits = hits + F.when(crosses & (F.col(x) < at), 1).otherwise(0)
    return hits % 2 == 1


_EDGES = " + ".join(f"case when (y < {ya}) <> (y < {yb}) and x < {xa} + (y - {ya}) * ({(xb - xa) / (yb - ya)!r}) then 1 else 0 end" for (xa, ya), (xb, yb) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]))


@query("f13_inside_polygon", V.sql(f"select obs_id, pt_idx from points where ({_EDGES}) % 2 = 1", "points"))
def f13(spark, d):
    return V.points(spark, d).where(inside_polygon("x", "y")).select(*KEY)


@query("f14_label_prefix", V.sql("select label, count(*) as n from label_points where starts_with(label, 'STANDARD') or starts_with(label, 'SMALL') or starts_with(label, 'P') group by 1", "label_points"))
def f14(spark, d):
    allowed = F.exists(F.array(*(F.lit(x) for x in ("STANDARD", "SMALL", "P"))), lambda p: F.col("label").startswith(p))
    return V.label_points(spark, d).where(allowed).groupBy("label").agg(F.count("*").alias("n"))


@query("f15_min_size", V.sql("select obs_id, view_no, count(*) as n from points group by all having count(*) >= 200", "points"))
def f15(spark, d):
    return V.points(spark, d).groupBy("obs_id", "view_no").agg(F.count("*").alias("n")).where("n >= 200")


@query("f16_live_only", V.sql("select source_id, count(*) as n from descriptors d where vec_id % 7 <> 3 and not exists (select 1 from descriptors t where t.vec_id = d.vec_id and t.label = 4) group by 1", "descriptors"))
def f16(spark, d):
    rows = V.descriptors(spark, d)
    trained = rows.where("label = 4").select("vec_id")
    return rows.where("vec_id % 7 <> 3").join(trained, "vec_id", "left_anti").groupBy("source_id").agg(F.count("*").alias("n"))


@query("f17_complete_sweeps_only", V.sql("select waypoint, count(*) as n from observations where run_no % 3 = 0 and waypoint <> 'WP3' group by 1", "observations"))
def f17(spark, d):
    """Parameters (here: the run's kind) must equal those of the complete sweep, null for null."""
    complete = F.struct(F.lit(0).alias("kind"), F.lit(None).cast("int").alias("extra"))
    kind = F.struct((F.col("run_no") % 3).alias("kind"), F.when(F.col("waypoint") == "WP3", 1).alias("extra"))
    return V.observations(spark, d).where(kind["kind"].eqNullSafe(complete["kind"]) & kind["extra"].eqNullSafe(complete["extra"])).groupBy("waypoint").agg(F.count("*").alias("n"))
