"""Queries of aggregations (A)."""

from __future__ import annotations

from math import exp

from pyspark.sql import Window, functions as F

from placelens.functions import geometry as G
from placelens.operators import rays, spatial as S, tables as T
from placelens.plans.joins import _HIST, _NEAREST, _SCORES, _SEGMENTS, BY, R, cloud, frame_scores, histograms, segment_overlaps
from placelens.plans.projections import _HS
from placelens.plans.registry import q4, query, r4
from placelens.sources import views as V

VOXEL = "cast(floor(x / {0}) as bigint) cx, cast(floor(y / {0}) as bigint) cy, cast(floor(z / {0}) as bigint) cz"
MEANS = ", ".join(f"{q4(f'avg({k})')} as {k}" for k in "xyzrgb")


def tidy(sql: str) -> str:
    """Views first, then the further ones that begin with a comma."""
    return sql.replace("\n, ", ",\n")


@query("a1_voxel_downsample", V.sql(f"select obs_id, {VOXEL.format('0.53')}, {MEANS}, count(*) as n_points from points group by all", "points"))
def a1(spark, d):
    return S.voxel_downsample(V.points(spark, d), 0.53, BY).select("obs_id", "cx", "cy", "cz", *(r4(k).alias(k) for k in "xyzrgb"), "n_points")


_BY_RES = "select *, 0.5 + (obs_id % 3) * 0.5 as leaf from points"


@query("a2_voxel_downsample_by", V.sql(f"select obs_id, {q4('leaf')} as leaf, count(*) as n from (select obs_id, leaf, cast(floor(x / leaf) as bigint) cx, cast(floor(y / leaf) as bigint) cy, cast(floor(z / leaf) as bigint) cz from ({_BY_RES}) group by all) group by all", "points"))
def a2(spark, d):
    """Each observation asks for a resolution of its own."""
    p = V.points(spark, d).withColumn("leaf", 0.5 + F.col("obs_id") % 3 * 0.5)
    cells = p.select("obs_id", "leaf", *(F.floor(F.col(k) / F.col("leaf")).alias(f"c{k}") for k in "xyz")).distinct()
    return cells.groupBy("obs_id", "leaf").agg(F.count("*").alias("n")).select("obs_id", r4("leaf").alias("leaf"), "n")


@query("a3_depth_median", V.sql("select u, v, case when len(d) = 0 then 0 else d[len(d) // 2 + 1] end as depth from (select u, v, list_sort(coalesce(list(depth) filter (depth <> 0), [])) as d from pixels group by all)", "pixels"))
def a3(spark, d):
    return T.depth_median(V.pixels(spark, d), ["u", "v"])


@query("a4_depth_mean", V.sql("select u, v, cast(coalesce(floor(sum(depth) filter (depth <> 0) / count(*) filter (depth <> 0)), 0) as bigint) as depth from pixels group by all", "pixels"))
def a4(spark, d):
    return T.depth_mean(V.pixels(spark, d), ["u", "v"])


@query("a5_centroid", V.sql(f"select obs_id, {q4('avg(x)')} as mx, {q4('avg(y)')} as my, {q4('avg(z)')} as mz, count(*) as n_points from points group by 1", "points"))
def a5(spark, d):
    return S.centroid(V.points(spark, d), BY).select("obs_id", *(r4(k).alias(k) for k in ("mx", "my", "mz")), "n_points")


@query("a6_bbox", V.sql(f"select obs_id, {q4('max(x) - min(x)')} as size_x, {q4('max(y) - min(y)')} as size_y, {q4('max(z) - min(z)')} as size_z, {q4('(max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z))')} as volume from points group by 1", "points"))
def a6(spark, d):
    return S.bbox(V.points(spark, d), BY).select("obs_id", *(r4(k).alias(k) for k in ("size_x", "size_y", "size_z", "volume")))


@query("a7_voxel_volume", V.sql(f"select obs_id, {q4('count(*) * 0.53 * 0.53 * 0.53')} as volume from (select distinct obs_id, {VOXEL.format('0.53')} from points) group by 1", "points"))
def a7(spark, d):
    return S.voxels(V.points(spark, d), 0.53, BY).groupBy("obs_id").agg(r4(F.count("*") * F.lit(0.53 * 0.53 * 0.53)).alias("volume"))


@query("a8_mean_volume_by_category", V.sql(f"select label, {q4('avg(n)')} as mean_voxels from (select obs_id, label, count(*) n from (select distinct obs_id, label, {VOXEL.format('0.53')} from label_points) group by all) group by 1", "label_points"))
def a8(spark, d):
    n = S.voxels(V.label_points(spark, d), 0.53, ["obs_id", "label"]).groupBy("obs_id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("label").agg(r4(F.avg("n")).alias("mean_voxels"))


@query("a9_fitness", V.sql(tidy(f", {_NEAREST} select obs_id, {q4('coalesce(avg(d2), 1.7976931348623157e308)')} as fitness, count(d2) as inliers from (select distinct obs_id from points) left join nearest using (obs_id) group by 1"), "points").replace("\n, ", ",\n"))
def a9(spark, d):
    near = S.nearest(cloud(spark, d, 0), cloud(spark, d, 1), R, BY)
    each = V.points(spark, d).select("obs_id").distinct().join(near, "obs_id", "left")
    return each.groupBy("obs_id").agg(r4(F.coalesce(F.avg("d2"), F.lit(1.7976931348623157e308))).alias("fitness"), F.count("d2").alias("inliers"))


@query("a10_match_score", V.sql(_SEGMENTS + f" select obs_id, view_no, label, {q4('greatest(coalesce(overlap, 0.0), 0.05)')} as score from (select distinct obs_id, view_no from points) join (select distinct obs_id, label from label_points) using (obs_id) left join ov using (obs_id, view_no, label)", "points", "label_points").replace("\n, ", ",\n"))
def a10(spark, d):
    pairs = V.points(spark, d).select("obs_id", "view_no").distinct().join(V.label_points(spark, d).select("obs_id", "label").distinct(), "obs_id")
    both = pairs.join(segment_overlaps(spark, d), ["obs_id", "view_no", "label"], "left")
    return both.select("obs_id", "view_no", "label", r4(F.greatest(F.coalesce("overlap", F.lit(0.0)), F.lit(0.05))).alias("score"))


@query("a11_color_histogram", V.sql(f", {_HIST} select obs_id, bin, {q4('w')} as w from h", "points").replace("\n, ", ",\n"))
def a11(spark, d):
    return histograms(spark, d).select("obs_id", "bin", r4("w").alias("w"))


@query("a12_hs_gaussian", V.sql(f"select obs_id, view_no, {q4('avg(h)')} as mh, {q4('avg(sat)')} as ms, {q4('var_pop(h)')} as vh, {q4('var_pop(sat)')} as vs, {q4('covar_pop(h, sat)')} as cov from ({_HS}) group by all", "points"))
def a12(spark, d):
    p = V.points(spark, d).withColumns(G.rgb_to_hs("r", "g", "b"))
    return p.groupBy("obs_id", "view_no").agg(r4(F.avg("hue")).alias("mh"), r4(F.avg("sat")).alias("ms"), r4(F.var_pop("hue")).alias("vh"), r4(F.var_pop("sat")).alias("vs"), r4(F.covar_pop("hue", "sat")).alias("cov"))


def symmetric_eigenvalues(xx, xy, xz, yy, yz, zz):
    """Eigenvalues of a symmetric 3x3 matrix, largest first, in closed form."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))).otherwise(1.0)
    phi = F.acos(r) / 3
    hi, lo = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2.0943951023931953)
    return hi, 3 * q - hi - lo, lo


def normal_scatter(pixels, least: int = 500, most: float = 500.0):
    """Sum of n nT and one, the number of pixels, and whether a frame is usable: enough pixels, no eigenvalue over ``most``."""
    terms = {"xx": ("nx", "nx"), "xy": ("nx", "ny"), "xz": ("nx", "nz"), "yy": ("ny", "ny"), "yz": ("ny", "nz"), "zz": ("nz", "nz")}
    s = pixels.where("mask <> 0").groupBy("frame_id").agg(*((F.sum(F.col(a) * F.col(b)) + (1.0 if a == b else 0.0)).alias(k) for k, (a, b) in terms.items()), F.count("*").alias("n"))
    e = symmetric_eigenvalues(*(F.col(k) for k in terms))
    return s.select("frame_id", "xx", "xy", "yy", (e[0] + e[1] + e[2]).alias("trace"), "n", ((F.col("n") >= least) & (e[0] <= most)).alias("usable"))


# frames of the given tables have some 400 pixels with normals of length 1 to 2.4
A13_LEAST, A13_MOST = 400, 865.3
# no eigenvalue is over m when m times one less the matrix is positive definite, that is, its leading minors are positive
_A13 = f"""select frame_id, {q4('xx')} as xx, {q4('xy')} as xy, {q4('yy')} as yy, {q4('xx + yy + zz')} as trace, n, n >= {A13_LEAST} and a > 0 and a * b - xy * xy > 0 and a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz) > 0 as usable
from (select *, {A13_MOST} - xx as a, {A13_MOST} - yy as b, {A13_MOST} - zz as c from (select frame_id, sum(nx * nx) + 1 as xx, sum(nx * ny) as xy, sum(nx * nz) as xz, sum(ny * ny) + 1 as yy, sum(ny * nz) as yz, sum(nz * nz) + 1 as zz, count(*) as n from pixels where mask <> 0 group by 1))"""


@query("a13_normal_scatter", V.sql(_A13, "pixels"))
def a13(spark, d):
    """The trace comes from the eigenvalues."""
    return normal_scatter(V.pixels(spark, d), A13_LEAST, A13_MOST).select("frame_id", *(r4(k).alias(k) for k in ("xx", "xy", "yy", "trace")), "n", "usable")


@query("a14_waypoint_counts", V.sql("select waypoint, count(*) as n from observations group by 1", "observations"))
def a14(spark, d):
    return V.observations(spark, d).groupBy("waypoint").agg(F.count("*").alias("n"))


@query("a15_waypoint_timestamps", V.sql("select waypoint, string_agg(strftime(start_ts, '%Y%m%d'), ',' order by start_ts) as stamps from observations group by 1", "observations"))
def a15(spark, d):
    """All start times of a waypoint, in order (a waypoint's list is its history of visits)."""
    stamps = F.transform(F.sort_array(F.collect_list("start_ts")), lambda t: F.date_format(t, "yyyyMMdd"))
    return V.observations(spark, d).groupBy("waypoint").agg(F.array_join(stamps, ",").alias("stamps"))


@query("a16_retrieval_stats", V.sql("select n as results, count(*) as queries from (select name, kind, count(*) n from wobj_obs group by all) group by 1", "wobj_obs"))
def a16(spark, d):
    """How many (query, room) pairs have so many results."""
    n = V.wobj_obs(spark, d).groupBy("name", "kind").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("n").alias("results")).agg(F.count("*").alias("queries"))


_HITS = "select case when label = 3 then 2 else label end as label, vec_id % 5 <> 0 as hit from descriptors"


@query("a17_correct_ratio", V.sql(f"select label, sum(hit::int) as hits, count(*) as total, {q4('sum(hit::int) / count(*)')} as ratio from ({_HITS}) group by rollup(label)", "descriptors"))
def a17(spark, d):
    """Per label and overall; label 3 counts as label 2."""
    h = V.descriptors(spark, d).select(F.when(F.col("label") == 3, 2).otherwise(F.col("label")).alias("label"), (F.col("vec_id") % 5 != 0).cast("int").alias("hit"))
    return h.rollup("label").agg(F.sum("hit").alias("hits"), F.count("*").alias("total"), r4(F.sum("hit") / F.count("*")).alias("ratio"))


@query("a18_parameter_sweep_rates", V.sql(f"select source_id % 4 as setting, label, {q4('avg((vec_id % 5 <> 0)::int)')} as rate, grouping(label) = 1 as is_total from descriptors group by grouping sets ((setting, label), (setting))", "descriptors"))
def a18(spark, d):
    h = V.descriptors(spark, d).select((F.col("source_id") % 4).alias("setting"), "label", (F.col("vec_id") % 5 != 0).cast("int").alias("hit"))
    out = h.groupingSets([["setting", "label"], ["setting"]], "setting", "label").agg(r4(F.avg("hit")).alias("rate"), (F.grouping("label") == 1).alias("is_total"))
    return out.select("setting", "label", "rate", "is_total")


@query("a19_mean_overlap_by_object", V.sql(_SEGMENTS + f" select label, {q4('avg(overlap)')} as mean_overlap from ov group by 1", "points", "label_points").replace("\n, ", ",\n"))
def a19(spark, d):
    return segment_overlaps(spark, d).groupBy("label").agg(r4(F.avg("overlap")).alias("mean_overlap"))


BINS, SIGMA = 50, 2.0
_RES_HIST = f"hist as (select b as bin, coalesce(n, 0) as n from range({BINS}) t(b) left join (select cast(floor(abs(x - 2.52) / 2.6 * {BINS - 1} + 0.5) as bigint) as bin, count(*) n from points group by 1) on bin = b)"


def residual_histogram(df, value, bins: int, most: float):
    """Counts of the nearest bin of a residual's size, empty bins included."""
    n = df.where(F.abs(value) <= most).groupBy(F.floor(F.abs(value) / most * (bins - 1) + 0.5).cast("long").alias("bin")).agg(F.count("*").alias("k"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(F.broadcast(n), "bin", "left").select("bin", F.coalesce("k", F.lit(0)).alias("n"))


@query("a20_residual_histogram", V.sql(f", {_RES_HIST} select bin, n from hist", "points").replace("\n, ", ",\n"))
def a20(spark, d):
    return residual_histogram(V.points(spark, d), F.col("x") - 2.52, BINS, 2.6)


def blur(hist, bins: int, sigma: float):
    """Gaussian blur mirrored at the ends; each bin hands its whole count on."""
    reach = int(4 * sigma) + 1
    weights = [exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total = sum(weights)
    to = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / total).alias("w")) for k, w in zip(range(-reach, reach + 1), weights))))
    moved = hist.select(F.col("bin"), "n", to.alias("t")).select((F.col("bin") + F.col("t.k")).alias("at"), (F.col("n") * F.col("t.w")).alias("v"))
    mirrored = F.when(F.col("at") < 0, -F.col("at") - 1).when(F.col("at") >= bins, 2 * bins - 1 - F.col("at")).otherwise(F.col("at"))
    return moved.groupBy(mirrored.alias("bin")).agg(F.sum("v").alias("n"))


_REACH = int(4 * SIGMA) + 1
_TOTAL = sum(exp(-k * k / (2 * SIGMA * SIGMA)) for k in range(-_REACH, _REACH + 1))


@query("a21_blur_histogram", V.sql(f""", {_RES_HIST} select case when p < 0 then -p - 1 when p >= {BINS} then {2 * BINS - 1} - p else p end as bin, {q4('sum(v)')} as n
from (select bin + k as p, n * exp(-k * k / {2 * SIGMA * SIGMA}::double) / {_TOTAL!r}::double as v from hist, range({-_REACH}, {_REACH + 1}) t(k)) group by 1""", "points").replace("\n, ", ",\n"))
def a21(spark, d):
    return blur(residual_histogram(V.points(spark, d), F.col("x") - 2.52, BINS, 2.6), BINS, SIGMA).select("bin", r4("n").alias("n"))


HIT, MISS, LOW, HIGH = 0.8472978603872037, -0.4054651081081643, 0.12, 0.97  # log odds of .7 and .4, and bounds


def sensor_origins(spark, d):
    """(obs_id, ox, oy, oz): where each observation's first pose stands (as W4 says of the latest one of a place)."""
    first = V.transforms(spark, d).groupBy("obs_id").agg(F.min_by(F.struct("tx", "ty", "tz"), "view_no").alias("t"))
    return first.select("obs_id", *(F.col(f"t.t{k}").alias(f"o{k}") for k in "xyz"))


def occupancy(spark, d, size: float):
    """(obs_id, cx, cy, cz, p): evidence of hits and of the cells that rays from the sensor pass."""
    seen = V.points(spark, d).join(sensor_origins(spark, d), "obs_id", "left")
    return rays.occupancy(rays.evidence(seen, size, BY), HIT, MISS, LOW, HIGH)


def crossed_sql(source: str, size: str) -> str:
    """legs: the cells on the lines (ox, oy, oz) to (ex, ey, ez) of ``source`` in order (step): the same planes met, in SQL."""
    size = f"{size}::double"
    low, high = (f"cast({f}(floor(o{{0}} / {size}), floor(e{{0}} / {size})) as bigint) + 1" for f in ("least", "greatest"))
    cuts = " || ".join(f"[(k * {size} - o{v}) / (e{v} - o{v}) for k in range({low.format(v)}, {high.format(v)})]" for v in "xyz")
    cells = ", ".join(f"cast(floor((o{v} + (e{v} - o{v}) * ((t0 + t1) / 2)) / {size}) as bigint) as c{v}" for v in "xyz")
    return f"""cuts as (select *, list_sort([0.0::double, 1.0::double] || {cuts}) as ts from {source}),
legs as (select *, {cells} from (select *, ts[step] as t0, ts[step + 1] as t1 from (select *, unnest(range(1, len(ts))) as step from cuts)) where t1 - t0 > 1e-9)"""


_CELLS = ", ".join(f"cast(floor({k} / 0.53::double) as bigint) as h{k}" for k in "xyz")
_ORIGINS = "origins as (select obs_id, arg_min(tx, view_no) as ox, arg_min(ty, view_no) as oy, arg_min(tz, view_no) as oz from transforms group by 1)"
_OCC = f"""{_ORIGINS}, lines as (select p.*, {_CELLS}, ox, oy, oz, x as ex, y as ey, z as ez from points p join origins using (obs_id)),
{crossed_sql("lines", "0.53")}, occ as (select obs_id, cx, cy, cz, greatest({LOW}, least({HIGH}, 1 - 1 / (1 + exp(sum(e))))) as p
from (select obs_id, hx as cx, hy as cy, hz as cz, {HIT!r}::double as e from (select *, {_CELLS} from points)
union all select obs_id, cx, cy, cz, {MISS!r}::double from legs where cx <> hx or cy <> hy or cz <> hz) group by all)"""


@query("a22_occupancy", tidy(V.sql(f", {_OCC} select obs_id, cx, cy, cz, {q4('p')} as p from occ", "points", "transforms")))
def a22(spark, d):
    return occupancy(spark, d, 0.53).select("obs_id", "cx", "cy", "cz", r4("p").alias("p"))


_GRID = "grid as (select obs_id, cx, cy, case when max(p) > 0.5003 then 100 else 0 end as val from occ where cz between 0 and 3 group by all)"


def grid_2d(voxels, low: int, high: int):
    """Columns of voxels: 100 where any is occupied, 0 where all are free."""
    return voxels.where(F.col("cz").between(low, high)).groupBy("obs_id", "cx", "cy").agg(F.when(F.max("p") > 0.5003, 100).otherwise(0).alias("val"))


def dense(grid, size: int):
    """Every cell of size x size; -1 where nothing is known."""
    cells = grid.select("obs_id").distinct().withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(size - 1)).cast("array<long>"))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(size - 1)).cast("array<long>")))
    return cells.join(grid, ["obs_id", "cx", "cy"], "left").withColumn("val", F.coalesce("val", F.lit(-1)))


_DENSE = """select obs_id, c.cx, c.cy, coalesce(val, -1) as val
from (select obs_id, x.i as cx, y.i as cy from (select distinct obs_id from grid), range(20) x(i), range(20) y(i)) c left join grid using (obs_id, cx, cy)"""


@query("a23_grid_2d", tidy(V.sql(f", {_OCC}, {_GRID} {_DENSE}", "points", "transforms")))
def a23(spark, d):
    return dense(grid_2d(occupancy(spark, d, 0.53), 0, 3), 20)


_VOX = f"vox as (select distinct obs_id, {VOXEL.format('0.53')} from points)"


@query("a24_speckle_filter", V.sql(f", {_VOX} select a.* from vox a where exists (select 1 from vox b where a.obs_id = b.obs_id and abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 and abs(a.cz - b.cz) <= 1 and (a.cx, a.cy, a.cz) <> (b.cx, b.cy, b.cz))", "points").replace("\n, ", ",\n"))
def a24(spark, d):
    """Voxels with an occupied one among their 26 neighbours."""
    v = S.voxels(V.points(spark, d), 0.53, BY)
    # blocks of four voxels a side: a voxel reaches 1 to 8 of them, its neighbours are sought in its own
    block = lambda e: F.floor(e / 4).cast("long")
    near = v.select("obs_id", *(F.col(f"c{k}").alias(f"o{k}") for k in "xyz"))
    for k in "xyz":
        near = near.withColumn(f"b{k}", F.explode(F.sequence(block(F.col(f"o{k}") - 1), block(F.col(f"o{k}") + 1))))
    placed = v.withColumns({f"b{k}": block(F.col(f"c{k}")) for k in "xyz"}).alias("v")
    on = [F.col(f"v.{k}") == F.col(f"n.{k}") for k in ("obs_id", "bx", "by", "bz")]
    beside = F.expr("abs(cx - ox) <= 1 and abs(cy - oy) <= 1 and abs(cz - oz) <= 1 and (cx <> ox or cy <> oy or cz <> oz)")
    return placed.join(near.alias("n").hint("merge"), [*on, beside], "left_semi").drop("bx", "by", "bz")


@query("a25_unobserved_cells", V.sql(f", {_VOX} select obs_id, 10 * 19 * 4 - count(*) as unobserved from vox where cx between 0 and 9 and cy between 0 and 18 and cz between 0 and 3 group by 1", "points").replace("\n, ", ",\n"))
def a25(spark, d):
    """Cells of a box without a voxel."""
    v = S.voxels(V.points(spark, d), 0.53, BY)
    box = v.select("obs_id").distinct()
    for k, n in (("cx", 10), ("cy", 19), ("cz", 4)):
        box = box.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    return box.join(v, ["obs_id", "cx", "cy", "cz"], "left_anti").groupBy("obs_id").agg(F.count("*").alias("unobserved"))


_PAIR = f"{_SCORES}, pair as (select a.src as i, a.dst as j, case when a.src // 50 = a.dst // 50 and a.src % 50 = 0 then 999999 else a.score + b.score - 10.0 * (a.occ + b.occ) end as total from scores a join scores b on a.src = b.dst and a.dst = b.src where a.src < a.dst)"


def pair_scores(spark, d):
    """Both directions of a pair of frames; frames of one sweep always belong together."""
    s = frame_scores(spark, d)
    t = s.toDF("dst", "src", "score2", "occ2")
    one_sweep = (F.floor(F.col("src") / 50) == F.floor(F.col("dst") / 50)) & (F.col("src") % 50 == 0)
    both = s.join(t, ["src", "dst"]).where("src < dst")
    return both.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.when(one_sweep, 999999.0).otherwise(F.col("score") + F.col("score2") - 10.0 * (F.col("occ") + F.col("occ2"))).alias("total"))


@query("a26_score_total", V.sql(f", {_PAIR} select {q4('sum(total)')} as whole, {q4('sum(case when i % 3 = j % 3 or i % 2 = 0 then total else 0 end)')} as partition_total from pair", "pixels").replace("\n, ", ",\n"))
def a26(spark, d):
    """All pairs, and those whose frames the partition keeps together."""
    together = (F.col("i") % 3 == F.col("j") % 3) | (F.col("i") % 2 == 0)
    return pair_scores(spark, d).agg(r4(F.sum("total")).alias("whole"), r4(F.sum(F.when(together, F.col("total")).otherwise(0))).alias("partition_total"))


@query("a27_pair_score", V.sql(f", {_PAIR} select i, j, {q4('total')} as total from pair", "pixels").replace("\n, ", ",\n"))
def a27(spark, d):
    return pair_scores(spark, d).select("i", "j", r4("total").alias("total"))


@query("a28_cluster_descriptors_count", V.sql(f"select group_id, subgroup_id, count(*) as n, {q4('count(*) / count(distinct label)')} as mean_per_label from descriptors group by all", "descriptors"))
def a28(spark, d):
    return V.descriptors(spark, d).groupBy("group_id", "subgroup_id").agg(F.count("*").alias("n"), r4(F.count("*") / F.countDistinct("label")).alias("mean_per_label"))


@query("a29_category_ratio", V.sql(f"select split_part(label, ' ', 1) as category, {q4('sum(hit) / sum(n)')} as ratio from (select label, count(*) filter (pt_idx % 3 <> 0) as hit, count(*) as n from label_points group by 1) group by rollup(category)", "label_points"))
def a29(spark, d):
    each = V.label_points(spark, d).groupBy("label").agg(F.count_if(F.col("pt_idx") % 3 != 0).alias("hit"), F.count("*").alias("n"))
    return each.withColumn("category", F.substring_index("label", " ", 1)).rollup("category").agg(r4(F.sum("hit") / F.sum("n")).alias("ratio"))


@query("a30_feature_count", V.sql("select group_id, sum(n)::bigint as features from (select group_id, subgroup_id, label, count(*) n from descriptors group by all having count(*) >= 2) group by 1", "descriptors"))
def a30(spark, d):
    n = V.descriptors(spark, d).groupBy("group_id", "subgroup_id", "label").agg(F.count("*").alias("n")).where("n >= 2")
    return n.groupBy("group_id").agg(F.sum("n").alias("features"))


@query("slice_points_per_observation", V.sql(f"""select obs_id, count(*) as n_voxels, sum(n)::bigint as n_points from (select obs_id, avg(x) x, avg(y) y, avg(z) z, count(*) n from (select *, {VOXEL.format('0.53')} from points) group by obs_id, cx, cy, cz)
join (select obs_id, avg(x) mx, avg(y) my, avg(z) mz from (select obs_id, avg(x) x, avg(y) y, avg(z) z from (select *, {VOXEL.format('0.53')} from points) group by obs_id, cx, cy, cz) group by 1) using (obs_id) where (x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz) <= 4.0037 * 4.0037 group by 1""", "points"))
def slice_points(spark, d):
    """The first slice: down-sample, cut off far points, count per observation."""
    down = S.voxel_downsample(V.points(spark, d), 0.53, BY)
    return S.centroid_cutoff(down, 4.0037, BY).groupBy("obs_id").agg(F.count("*").alias("n_voxels"), F.sum("n_points").alias("n_points"))
