"""Queries of clustering and graphs (G), and of planar rejection (F12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.functions import geometry as G
from placelens.operators import graph as N, spatial as S
from placelens.plans.joins import BY, R, R2, _CENTRES, cloud, distance, segment_centres
from placelens.plans.projections import _HS
from placelens.plans.registry import q4, query, r4
from placelens.scratch import materialize
from placelens.sources import views as V

_EDGES = f"{_CENTRES}, edges as (select a.obs_id, b.seg as src, a.seg as dst, 1 / (1 + {distance('a', 'b')}) as w from c a join c b on a.obs_id = b.obs_id and a.seg > b.seg and {distance('a', 'b')} <= 0.4513 * 0.4513)"


def segment_edges(spark, d):
    """Edges between near segments of an observation, heavier the nearer."""
    c = segment_centres(spark, d)
    return S.pairs_within(c, c, 0.4513, BY).where("seg < b_seg").select("obs_id", F.col("seg").alias("src"), F.col("b_seg").alias("dst"), (1 / (1 + F.col("d2"))).alias("w"))


_LABEL = f"""{_EDGES}, twice as (select obs_id, src, dst from edges union select obs_id, dst, src from edges),
reach as (select obs_id, src, dst from twice union select r.obs_id, r.src, b.dst from reach r join twice b on b.obs_id = r.obs_id and b.src = r.dst), label as (select obs_id, src as node, least(src, min(dst)) as component from reach group by obs_id, src)"""


def rec(body: str, *views: str) -> str:
    return "with recursive" + V.sql(body, *views).removeprefix("with").replace("\n, ", ",\n")


def labels(spark, d):
    return N.components_by(segment_edges(spark, d), BY)


@query("g1_euclidean_clusters")
def g1(spark, d):
    return N.euclidean_clusters(V.points(spark, d), R, 5, 100_000, BY)


@query("g2_components", rec(f", {_LABEL} select obs_id, node, component from label", "points"))
def g2(spark, d):
    return labels(spark, d)


@query("g3_dynamic_clusters")
def g3(spark, d):
    """New points of view 0 against view 1, clustered; far and planar clusters go."""
    new = materialize(S.cloud_difference(cloud(spark, d, 0), cloud(spark, d, 1), R2, BY), "new")
    found = materialize(N.euclidean_clusters(new, R, 3, 10_000, BY).join(new.select("obs_id", "pt_idx", "x", "y", "z").hint("merge"), ["obs_id", "pt_idx"]), "clusters")
    near = S.centroid(found, ["obs_id", "cluster"]).where("sqrt(mx * mx + my * my + mz * mz) <= 7.0013").select("obs_id", "cluster")
    kept = found.join(near, ["obs_id", "cluster"], "left_semi")
    solid = N.reject_planar(kept, ["obs_id", "cluster"], 0.02, 0.9, 10)
    return kept.join(solid, ["obs_id", "cluster"], "left_semi").groupBy("obs_id", "cluster").agg(F.count("*").alias("n"))


@query("f12_reject_planar")
def f12(spark, d):
    p = V.points(spark, d).withColumn("cluster", F.floor(F.col("pt_idx") / 20)).select("obs_id", "cluster", "pt_idx", "x", "y", "z")
    return N.reject_planar(p, ["obs_id", "cluster"], 0.2003, 0.5, 20)


@query("g4_object_from_clusters", rec(f", {_LABEL} select obs_id, component, 'scan' || obs_id || '_object_' || (row_number() over (partition by obs_id order by count(*) desc, component) - 1) as name, count(*) as n from label group by obs_id, component", "points"))
def g4(spark, d):
    from pyspark.sql import Window

    n = labels(spark, d).groupBy("obs_id", "component").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("obs_id").orderBy(F.desc("n"), "component")) - 1
    return n.select("obs_id", "component", F.concat(F.lit("scan"), F.col("obs_id").cast("string"), F.lit("_object_"), place.cast("string")).alias("name"), "n")


_NORMAL = "cast(pt_idx % 3 - 1 as double) as nx, cast(pt_idx % 5 - 2 as double) as ny, 1.0::double as nz"


@query("g5_edge_convexness", V.sql(f"""select obs_id, i, j, {q4('avg(case when flat then 0.0 else c end)')} as convexness from (select a.obs_id, a.view_no as i, b.view_no as j,
(a.nx * b.nx + a.ny * b.ny + 1) / sqrt((a.nx * a.nx + a.ny * a.ny + 1) * (b.nx * b.nx + b.ny * b.ny + 1)) > 0.92387953 as flat, -((b.x - a.x) * (b.nx - a.nx) + (b.y - a.y) * (b.ny - a.ny)) as c
from (select *, {_NORMAL} from points) a join (select *, {_NORMAL} from points) b on a.obs_id = b.obs_id and a.view_no < b.view_no and {distance('a', 'b')} <= {R2}
qualify row_number() over (partition by a.obs_id, a.view_no, a.pt_idx, b.view_no order by {distance('a', 'b')}, b.pt_idx) = 1) group by all""", "points"))
def g5(spark, d):
    """Mean convexity over the points of a segment and their nearest ones in another; pairs with almost equal normals are flat."""
    p = V.points(spark, d).select("obs_id", "view_no", "pt_idx", "x", "y", "z")
    near = S.pairs_within(p, p, R, BY, cells=True).where("view_no < b_view_no").groupBy("obs_id", *S.CELL, F.col("view_no").alias("i"), F.col("b_view_no").alias("j"), "pt_idx")
    pairs = near.agg(F.min(F.struct("d2", "b_pt_idx", "x", "y", "b_x", "b_y")).alias("m")).select("obs_id", "i", "j", "pt_idx", "m.*")
    normal = lambda k: {f"{k}nx": (F.col(f"{k}pt_idx") % 3 - 1).cast("double"), f"{k}ny": (F.col(f"{k}pt_idx") % 5 - 2).cast("double")}
    pairs = pairs.withColumns(normal("") | normal("b_"))
    cosine = F.expr("(nx * b_nx + ny * b_ny + 1) / sqrt((nx * nx + ny * ny + 1) * (b_nx * b_nx + b_ny * b_ny + 1))")
    c = -((F.col("b_x") - F.col("x")) * (F.col("b_nx") - F.col("nx")) + (F.col("b_y") - F.col("y")) * (F.col("b_ny") - F.col("ny")))
    return pairs.groupBy("obs_id", "i", "j").agg(r4(F.avg(F.when(cosine > 0.92387953, 0.0).otherwise(c))).alias("convexness"))


_KL = "0.5 * (ln(({q}.vh * {q}.vs - {q}.cov * {q}.cov) / ({p}.vh * {p}.vs - {p}.cov * {p}.cov)) - 2 + ({q}.vs * {p}.vh - 2 * {q}.cov * {p}.cov + {q}.vh * {p}.vs) / ({q}.vh * {q}.vs - {q}.cov * {q}.cov) + ({q}.vs * (({q}.mh - {p}.mh) * ({q}.mh - {p}.mh)) - 2 * {q}.cov * ({q}.mh - {p}.mh) * ({q}.ms - {p}.ms) + {q}.vh * (({q}.ms - {p}.ms) * ({q}.ms - {p}.ms))) / ({q}.vh * {q}.vs - {q}.cov * {q}.cov))"
_STATS = "avg(h) mh, avg(sat) ms, var_pop(h) vh, var_pop(sat) vs, covar_pop(h, sat) cov"


def divergence(p: str, q: str):
    """Kullback-Leibler divergence of two Gaussians over hue and saturation, in closed form."""
    return F.expr(_KL.format(p=p, q=q))


@query("g6_color_reweight", V.sql(f""", {_EDGES}, hs as (select obs_id, cast(floor(pt_idx / 20) as bigint) as seg, {_STATS} from ({_HS}) group by all), g as (select obs_id, {_STATS} from ({_HS}) group by 1)
select e.obs_id, src, dst, {q4(f"w - 0.005 * {_KL.format(p='u', q='v')} / least({_KL.format(p='g', q='u')}, {_KL.format(p='g', q='v')})")} as w from edges e join hs u on u.obs_id = e.obs_id and u.seg = src join hs v on v.obs_id = e.obs_id and v.seg = dst join g on g.obs_id = e.obs_id
where u.vh * u.vs - u.cov * u.cov > 1e-6 and v.vh * v.vs - v.cov * v.cov > 1e-6 and g.vh * g.vs - g.cov * g.cov > 1e-6""", "points").replace("\n, ", ",\n"))
def g6(spark, d):
    """Edges weigh less the more the colours of their ends differ; degenerate colours are skipped."""
    p = V.points(spark, d).withColumns(G.rgb_to_hs("r", "g", "b")).withColumn("seg", F.floor(F.col("pt_idx") / 20))
    stats = [F.avg("hue").alias("mh"), F.avg("sat").alias("ms"), F.var_pop("hue").alias("vh"), F.var_pop("sat").alias("vs"), F.covar_pop("hue", "sat").alias("cov")]
    solid = "vh * vs - cov * cov > 1e-6"
    one, whole = p.groupBy("obs_id", "seg").agg(*stats).where(solid), p.groupBy("obs_id").agg(*stats).where(solid)
    e, u, v, g = segment_edges(spark, d).alias("e"), one.alias("u"), one.alias("v"), whole.alias("g")
    both = e.join(u, (F.col("u.obs_id") == F.col("e.obs_id")) & (F.col("u.seg") == F.col("e.src"))).join(v, (F.col("v.obs_id") == F.col("e.obs_id")) & (F.col("v.seg") == F.col("e.dst"))).join(g, F.col("g.obs_id") == F.col("e.obs_id"))
    w = F.col("w") - 0.005 * divergence("u", "v") / F.least(divergence("g", "u"), divergence("g", "v"))
    return both.select("e.obs_id", "src", "dst", r4(w).alias("w"))


def doubled(spark, d):
    """Segment edges, each seen twice (as from both of its ends)."""
    e = segment_edges(spark, d)
    return e.unionByName(e)


@query("g7_contract_edges")
def g7(spark, d):
    return N.contract_edges(doubled(spark, d), BY, 0.8513)




@query("g8_merged_graph", V.sql(f", {_EDGES} select obs_id, least(src // 3, dst // 3) * 3 as src, greatest(src // 3, dst // 3) * 3 as dst, {q4('sum(w)')} as w, count(*) as links from edges where src // 3 <> dst // 3 group by all", "points").replace("\n, ", ",\n"))
def g8(spark, d):
    """Segments merged by threes."""
    label = segment_centres(spark, d).select("obs_id", F.col("seg").alias("node"), (F.floor(F.col("seg") / 3) * 3).alias("component"))
    return N.merged_graph(segment_edges(spark, d), label, BY).select("obs_id", "src", "dst", r4("w").alias("w"), "links")


@query("g9_merge_segments", rec(f", {_LABEL} select p.obs_id, coalesce(component, cast(floor(pt_idx / 20) as bigint)) as segment, count(*) as n from points p left join label l on l.obs_id = p.obs_id and node = cast(floor(pt_idx / 20) as bigint) group by all", "points"))
def g9(spark, d):
    p = V.points(spark, d).select("obs_id", F.floor(F.col("pt_idx") / 20).alias("node"))
    return p.join(labels(spark, d), ["obs_id", "node"], "left").groupBy("obs_id", F.coalesce("component", "node").alias("segment")).agg(F.count("*").alias("n"))


@query("g10_mean_edge_weight", V.sql(f", {_EDGES} select obs_id, {q4('avg(abs(w))')} as mean_weight, count(*) as n_edges from edges group by 1", "points").replace("\n, ", ",\n"))
def g10(spark, d):
    return segment_edges(spark, d).groupBy("obs_id").agg(r4(F.avg(F.abs("w"))).alias("mean_weight"), F.count("*").alias("n_edges"))


@query("g11_largest_component", rec(f", {_LABEL}, size as (select obs_id, component, count(*) n from label group by all), best as (select obs_id, arg_min(component, {{'n': -n, 'c': component}}) as component from size group by 1) select obs_id, node from label join best using (obs_id, component)", "points"))
def g11(spark, d):
    return N.largest_component(segment_edges(spark, d), BY)
