"""Queries of sources and sinks (S): what is written to the shared folder is read back."""

from __future__ import annotations

from datetime import timedelta

import uuid

from pyspark.sql import functions as F

from placelens.operators import spatial as S, tables as T
from placelens.operators.graph import euclidean_clusters
from placelens.plans.models import _MODEL, model_points
from placelens.plans.projections import _MOVED, POSE, XYZ, catalog_paths
from placelens.plans.registry import q4, query, r4
from placelens.functions import geometry as G
from placelens.scratch import shared_dir
from placelens.sources import catalog as C, views as V


def folder(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def rooms(spark, d):
    """Observations as room metadata; folders are by month, to keep files large."""
    o = V.observations(spark, d)
    return o.select("obs_id", "waypoint", "log_name", "run_no", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), F.concat_ws(" ", *(F.format_string("%.3f", f"c{k}") for k in "xyz")).alias("centroid"), F.date_format("start_ts", "yyyyMM01").alias("date"))


@query("s1_scan_catalog", V.sql("select obs_id, waypoint, run_no, strftime(start_ts, '%Y%m01') as date from observations", "observations"))
def s1(spark, d):
    root = folder(spark, "rooms")
    C.write_rooms(rooms(spark, d), root)
    return C.scan_catalog(spark, root).select("obs_id", "waypoint", "run_no", "date")


@query("s2_parse_catalog", V.sql(f"select waypoint, {q4('sum(round(cx, 3))')} as cx, {q4('sum(round(cy, 3))')} as cy, count(*) as n from observations group by 1", "observations"))
def s2(spark, d):
    root = folder(spark, "rooms")
    C.write_rooms(rooms(spark, d), root)
    return C.scan_catalog(spark, root).groupBy("waypoint").agg(r4(F.sum("cx")).alias("cx"), r4(F.sum("cy")).alias("cy"), F.count("*").alias("n"))


@query("s3_write_catalog", V.sql("select strftime(start_ts, '%Y%m01') as date, count(*) as n from observations group by 1", "observations"))
def s3(spark, d):
    root = folder(spark, "catalog")
    C.write_catalog(rooms(spark, d), root)
    return spark.read.parquet(root).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


@query("s4_read_points", V.sql("select obs_id, count(*) as n from points group by 1", "points"))
def s4(spark, d):
    """Points stored by waypoint, read for each observation."""
    root = folder(spark, "points")
    V.points(spark, d).withColumn("waypoint", F.col("obs_id") % 20).repartition("waypoint").write.partitionBy("waypoint").parquet(root)
    wanted = V.points(spark, d).select("obs_id", (F.col("obs_id") % 20).cast("int").alias("waypoint")).distinct()
    return spark.read.parquet(root).join(wanted, ["waypoint", "obs_id"], "left_semi").groupBy("obs_id").agg(F.count("*").alias("n"))


@query("s5_read_views", V.sql(f"""select obs_id, view_no, camera_id, count(*) as n, {q4('sum(p.x + coalesce(tx, 0.0))')} as sx, {q4('sum(case when p.z > 0 then fx * p.x / p.z + c.cx end)')} as su, {q4('sum(case when p.z > 0 then fy * p.y / p.z + c.cy end)')} as sv
from points p left join transforms t using (obs_id, view_no) join cameras c on camera_id = view_no group by all""", "points", "transforms", "cameras"))
def s5(spark, d):
    """Clouds of each position with the position's pose, moved to the map, and with its camera, as pixels."""
    p = V.points(spark, d).join(V.transforms(spark, d), ["obs_id", "view_no"], "left").withColumn("camera_id", F.col("view_no"))
    p = p.join(V.cameras(spark, d), "camera_id")
    ahead = lambda f, k, c: F.sum(F.when(F.col("z") > 0, F.col(f) * F.col(k) / F.col("z") + F.col(c)))
    return p.groupBy("obs_id", "view_no", "camera_id").agg(F.count("*").alias("n"), r4(F.sum(F.col("x") + F.coalesce("tx", F.lit(0.0)))).alias("sx"), r4(ahead("fx", "x", "cx")).alias("su"), r4(ahead("fy", "y", "cy")).alias("sv"))


@query("s6_read_clusters")
def s6(spark, d):
    """The dynamic cloud (view 0), clustered when it is read."""
    p = V.points(spark, d).where("view_no = 0")
    return euclidean_clusters(p, 0.47, 3, 10_000, ["obs_id"]).groupBy("obs_id", "cluster").agg(F.count("*").alias("n"))


@query("s7_read_labels", V.sql(f"select obs_id, label, count(*) as n, {q4('avg(x)')} as cx, strftime(max(o_orderdate), '%Y%m%d') as day from label_points left join orders on o_orderkey = obs_id group by all", "label_points"))
def s7(spark, d):
    """Labelled objects with centre and the sweep's time."""
    p = V.label_points(spark, d).groupBy("obs_id", "label").agg(F.count("*").alias("n"), r4(F.avg("x")).alias("cx"))
    o = V.observations(spark, d).select("obs_id", F.date_format("start_ts", "yyyyMMdd").alias("day"))
    return p.join(o, "obs_id", "left")


@query("s8_read_objects", V.sql("select l.obs_id, l.label, count(distinct p.view_no) as views, count(*) as n from label_points l join points p using (obs_id, pt_idx) group by all", "label_points", "points"))
def s8(spark, d):
    p = V.points(spark, d).select("obs_id", "pt_idx", "view_no")
    return V.label_points(spark, d).join(p, ["obs_id", "pt_idx"]).groupBy("obs_id", "label").agg(F.countDistinct("view_no").alias("views"), F.count("*").alias("n"))


@query("s9_summary", V.sql("select waypoint, count(*) as n, max(run_no) as last_run from observations group by 1", "observations"))
def s9(spark, d):
    root = folder(spark, "summary")
    s = V.observations(spark, d).groupBy("waypoint").agg(F.count("*").alias("n"), F.max("run_no").alias("last_run"))
    C.write_json(s, root)
    return C.read_json(spark, root, s.schema)


@query("s10_segment_uris", V.sql("select obs_id, case obs_id % 3 when 0 then 'file:///abs/' || obs_id when 1 then 'mongodb://db/' || obs_id else 'file:///root/' || obs_id end as uri from observations", "observations"))
def s10(spark, d):
    name = F.col("obs_id").cast("string")
    o = V.observations(spark, d).select("obs_id", F.when(F.col("obs_id") % 3 == 0, F.concat(F.lit("/abs/"), name)).when(F.col("obs_id") % 3 == 1, F.concat(F.lit("mongodb://db/"), name)).otherwise(name).alias("path"))
    return o.select("obs_id", C.segment_uris(o, "/root").alias("uri"))


@query("s11_log_observation", V.sql("select log_name || '___' || run_no || '___room___' || obs_id as name from observations", "observations"))
def s11(spark, d):
    root = folder(spark, "log")
    o = V.observations(spark, d)
    o.where("run_no < 3").select(C.log_name(o).alias("name")).write.mode("append").parquet(root)
    o.where("run_no >= 3").select(C.log_name(o).alias("name")).write.mode("append").parquet(root)
    return spark.read.parquet(root)


@query("s12_lookup_named", V.sql("select log_name as log, run_no as run, obs_id as obs from observations where log_name = '1-URGENT'", "observations"))
def s12(spark, d):
    o = V.observations(spark, d)
    return o.select(C.log_name(o).alias("name")).select(*(c.alias(k) for k, c in C.parse_log_name().items())).where("log = '1-URGENT'")


@query("s13_soft_remove", V.sql("select name, life_end is null and parent is not null as live from wobjects", "wobjects"))
def s13(spark, d):
    """Models are inserted live and removed by a stamp; live ones have none."""
    w = V.wobjects(spark, d)
    store = w.select("name", F.lit(None).cast("timestamp").alias("removed_at"))
    gone = w.where("life_end is not null or parent is null").select("name")
    return T.soft_remove(store, gone, "name", F.lit("1996-01-01").cast("timestamp")).select("name", F.col("removed_at").isNull().alias("live"))


@query("s14_write_masks", V.sql("select frame_id, count(*) as n from pixels where mask <> 0 group by 1", "pixels"))
def s14(spark, d):
    root = folder(spark, "masks")
    p = V.pixels(spark, d).where("mask <> 0").select((F.col("frame_id") % 10).alias("object_id"), "frame_id", (F.col("v") * 640 + F.col("u")).alias("index"))
    p.repartition("object_id").write.partitionBy("object_id").parquet(root)
    return spark.read.parquet(root).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("s15_write_benchmark", V.sql("select label, count(*) as total, sum((vec_id % 5 <> 0)::int)::bigint as hits from descriptors group by 1", "descriptors"))
def s15(spark, d):
    root = folder(spark, "result")
    r = V.descriptors(spark, d).groupBy("label").agg(F.count("*").alias("total"), F.sum((F.col("vec_id") % 5 != 0).cast("long")).alias("hits"))
    C.write_json(r, root)
    return C.read_json(spark, root, r.schema)


@query("s16_ingest_pcd", V.sql(f"select obs_id, count(*) as n, {q4('sum(x)')} as sx, {q4('sum(z)')} as sz, sum(r)::bigint as sr, sum(g)::bigint as sg, sum(b)::bigint as sb from points group by 1", "points"))
def s16(spark, d):
    root = folder(spark, "pcd")
    C.write_pcd(V.points(spark, d), root)
    total = [F.sum(k).alias(f"s{k}") for k in "rgb"]
    return C.ingest_pcd(spark, root).groupBy("obs_id").agg(F.count("*").alias("n"), r4(F.sum("x")).alias("sx"), r4(F.sum("z")).alias("sz"), *total)


@query("s17_export_models", V.sql(f"select frame_id, count(*) as n, {q4('avg(x)')} as cx from {_MODEL} group by 1", "pixels"))
def s17(spark, d):
    root = folder(spark, "models")
    model_points(V.pixels(spark, d)).select("frame_id", "x", "y", "z", "weight").write.mode("append").parquet(root)
    return spark.read.parquet(root).groupBy("frame_id").agg(F.count("*").alias("n"), r4(F.avg("x")).alias("cx"))


@query("s18_upsert_object", V.sql("select waypoint, log_name, case when max(run_no) >= 3 then 'new' else 'old' end as version from observations group by all", "observations"))
def s18(spark, d):
    o = V.observations(spark, d)
    old = o.where("run_no < 3").select("waypoint", "log_name").distinct().withColumn("version", F.lit("old"))
    new = o.where("run_no >= 3").select("waypoint", "log_name").distinct().withColumn("version", F.lit("new"))
    return T.upsert(old, new, ["waypoint", "log_name"])


@query("s19_backfill_store", V.sql("select run_no as run, count(*) as n from observations group by 1", "observations"))
def s19(spark, d):
    """Every catalogued room is logged to the store."""
    source, store = folder(spark, "rooms"), folder(spark, "store")
    C.write_rooms(rooms(spark, d), source)
    scanned = C.scan_catalog(spark, source)
    scanned.select(C.log_name(scanned).alias("name")).write.mode("append").parquet(store)
    return spark.read.parquet(store).select(*(c.alias(k) for k, c in C.parse_log_name().items())).groupBy("run").agg(F.count("*").alias("n"))


@query("s20_reload_if_changed", V.sql("select held, reloaded, case when reloaded then n end as n from (select count(distinct waypoint) as n from observations), (values ('nothing', true), ('present', false), ('older', true)) t(held, reloaded)", "observations"))
def s20(spark, d):
    """An index is read anew when the summary's stamp differs from the one held, and only then."""
    o = V.observations(spark, d)
    summary = o.agg(F.max("start_ts").alias("last_updated"))
    present = summary.first()[0]
    read = lambda: o.agg(F.countDistinct("waypoint").alias("n"))
    out = None
    for held, stamp in (("nothing", None), ("present", present), ("older", present - timedelta(seconds=1))):
        found = C.reload_if_changed(spark, summary, stamp, read)
        row = summary.select(F.lit(None).cast("long").alias("n")) if found is None else found
        row = row.select(F.lit(held).alias("held"), F.lit(found is not None).alias("reloaded"), "n")
        out = row if out is None else out.unionByName(row)
    return out
