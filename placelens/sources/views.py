"""Operator input views over the given tables, as DataFrames and as DuckDB SQL.

The views are deterministic: points, pixels and label points come from lineitem,
observations from orders, object observations and control messages from events,
descriptors from embeddings, world objects from nation and region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(obs_id, view_no, pt_idx, x, y, z, r, g, b)."""
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*LINE_ORDER)).cast("long")
    raw = table(spark, sf_dir, "lineitem").select("*", rank.alias("pt_idx"))
    return raw.select(
        F.col("l_suppkey").alias("obs_id"),
        (F.col("pt_idx") % 3).cast("int").alias("view_no"),
        "pt_idx",
        (F.col("l_quantity") / 10).alias("x"),
        ((F.col("l_partkey") % 97) / 10).alias("y"),
        (F.col("l_discount") * 20).alias("z"),
        (F.col("l_orderkey") % 256).cast("int").alias("r"),
        (F.col("l_partkey") * 7 % 256).cast("int").alias("g"),
        (F.col("l_linenumber") * 36 % 256).cast("int").alias("b"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observations(obs_id, waypoint, log_name, run_no, start_ts, end_ts, cx, cy, cz)."""
    place = F.col("o_custkey") % 20
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("obs_id"),
        F.concat(F.lit("WP"), place.cast("string")).alias("waypoint"),
        F.col("o_orderpriority").alias("log_name"),
        (F.col("o_custkey") % 7).cast("int").alias("run_no"),
        F.col("o_orderdate").alias("start_ts"),
        (F.col("o_orderdate") + F.expr("interval 10 minutes")).alias("end_ts"),
        (place * 3.0 + F.col("o_orderkey") % 10 / 10).alias("cx"),
        (place % 4 * 2.0 + F.col("o_orderkey") % 7 / 10).alias("cy"),
        (F.col("o_custkey") % 3 * 0.5).alias("cz"),
    )


def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transforms(obs_id, view_no, tx, ty, tz): one pose for each line of an order, the last one listed."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obs_id"), (F.col("l_linenumber") - 1).alias("view_no"), F.struct((F.col("l_quantity") / 10).alias("tx"), (F.col("l_partkey") % 97 / 10).alias("ty"), (F.col("l_tax") * 20).alias("tz")).alias("t"))
    return line.groupBy("obs_id", "view_no").agg(F.max("t").alias("t")).select("obs_id", "view_no", "t.*")


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cameras(camera_id, fx, fy, cx, cy, width, height): one for each region, all of one make."""
    make = {"fx": 528.0, "fy": 525.0, "cx": 317.0, "cy": 245.0}
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("camera_id"), *((F.lit(v) + F.col("r_regionkey")).alias(k) for k, v in make.items()), F.lit(640).alias("width"), F.lit(480).alias("height"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels(frame_id, u, v, depth, r, g, b, nx, ny, nz, mask): one row per pixel and frame."""
    raw = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("frame_id"), (F.col("l_partkey") % 64).cast("int").alias("u"), (F.col("l_orderkey") % 48).cast("int").alias("v")
    )
    one = raw.agg(F.max(F.when(F.col("l_linenumber") == 7, 0).otherwise((F.col("l_quantity") * 40).cast("int"))).alias("depth"), F.max(F.col("l_orderkey")).alias("k"))
    return one.select(
        "frame_id", "u", "v", "depth",
        (F.col("k") % 256).cast("int").alias("r"), (F.col("k") * 7 % 256).cast("int").alias("g"), (F.col("k") * 13 % 256).cast("int").alias("b"),
        (F.col("k") % 3 - 1).cast("double").alias("nx"), (F.col("k") % 5 - 2).cast("double").alias("ny"), F.lit(1.0).alias("nz"),
        F.when(F.col("k") % 4 == 0, 0).otherwise(1).alias("mask"),
    )


def label_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_points(obs_id, label, pt_idx, x, y, z): a label's points are those of one part type."""
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*LINE_ORDER)).cast("long")
    raw = table(spark, sf_dir, "lineitem").select("*", rank.alias("pt_idx"))
    kind = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("label"))
    return raw.join(kind, "l_partkey").select(
        F.col("l_suppkey").alias("obs_id"), "label", "pt_idx", (F.col("l_quantity") / 10).alias("x"), ((F.col("l_partkey") % 97) / 10).alias("y"), (F.col("l_discount") * 20).alias("z")
    )


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """descriptors(vec_id, source_id, group_id, subgroup_id, label, vec)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("vec_id") % 50).cast("int").alias("source_id"),
        (F.col("vec_id") % 50 % 10).cast("int").alias("group_id"),
        (F.col("vec_id") % 50).cast("int").alias("subgroup_id"),
        "label",
        F.col("embedding").alias("vec"),
    )


def wobj_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wobj_obs(name, stamp, event_id, kind, value)."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("obj"), F.col("user_id").cast("string")).alias("name"), F.col("ts").alias("stamp"), "event_id", F.col("event_type").alias("kind"), "value")


def wobjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wobjects(name, parent, life_start, life_end): nations below regions, regions at the root."""
    day = lambda n: F.to_timestamp(F.lit("1995-01-01")) + F.make_dt_interval(n.cast("int"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    below = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("name"), F.col("r_name").alias("parent"), day(F.col("n_nationkey") * 10).alias("life_start"), F.when(F.col("n_nationkey") % 3 != 0, day(F.col("n_nationkey") * 20 + 5)).alias("life_end")
    )
    roots = region.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"), day(F.col("r_regionkey") * 5).alias("life_start"), F.lit(None).cast("timestamp").alias("life_end"))
    return below.unionByName(roots)


_RANK = f"row_number() over (partition by l_suppkey order by {', '.join(LINE_ORDER)})"

#: The same views in DuckDB SQL.
SQL = {
    "points": f"""points as (select l_suppkey as obs_id, cast(pt_idx % 3 as int) as view_no, pt_idx, l_quantity / 10 as x, (l_partkey % 97) / 10 as y, l_discount * 20 as z,
  cast(l_orderkey % 256 as int) as r, cast(l_partkey * 7 % 256 as int) as g, cast(l_linenumber * 36 % 256 as int) as b from (select *, {_RANK} as pt_idx from lineitem))""",
    "observations": """observations as (select o_orderkey as obs_id, 'WP' || (o_custkey % 20) as waypoint, o_orderpriority as log_name, cast(o_custkey % 7 as int) as run_no, o_orderdate as start_ts,
  o_orderdate + interval 10 minutes as end_ts, (o_custkey % 20) * 3.0::double + (o_orderkey % 10) / 10 as cx, (o_custkey % 20 % 4) * 2.0::double + (o_orderkey % 7) / 10 as cy, (o_custkey % 3) * 0.5::double as cz from orders)""",
    "transforms": """transforms as (select obs_id, view_no, t.tx as tx, t.ty as ty, t.tz as tz from (select l_orderkey as obs_id, l_linenumber - 1 as view_no, max({'tx': l_quantity / 10, 'ty': (l_partkey % 97) / 10, 'tz': l_tax * 20}) as t from lineitem group by all))""",
    "cameras": """cameras as (select cast(r_regionkey as int) as camera_id, 528.0::double + r_regionkey as fx, 525.0::double + r_regionkey as fy, 317.0::double + r_regionkey as cx, 245.0::double + r_regionkey as cy, 640 as width, 480 as height from region)""",
    "pixels": """pixels as (select frame_id, u, v, depth, cast(k % 256 as int) as r, cast(k * 7 % 256 as int) as g, cast(k * 13 % 256 as int) as b, cast(k % 3 - 1 as double) as nx, cast(k % 5 - 2 as double) as ny, 1.0::double as nz,
  case when k % 4 = 0 then 0 else 1 end as mask from (select l_suppkey as frame_id, cast(l_partkey % 64 as int) as u, cast(l_orderkey % 48 as int) as v,
  max(case when l_linenumber = 7 then 0 else cast(trunc(l_quantity * 40) as int) end) as depth, max(l_orderkey) as k from lineitem group by all))""",
    "label_points": f"""label_points as (select l_suppkey as obs_id, p_type as label, pt_idx, l_quantity / 10 as x, (l_partkey % 97) / 10 as y, l_discount * 20 as z
  from (select *, {_RANK} as pt_idx from lineitem) join part on p_partkey = l_partkey)""",
    "descriptors": """descriptors as (select vec_id, cast(vec_id % 50 as int) as source_id, cast(vec_id % 50 % 10 as int) as group_id, cast(vec_id % 50 as int) as subgroup_id, label, embedding as vec from embeddings)""",
    "wobj_obs": """wobj_obs as (select 'obj' || user_id as name, ts as stamp, event_id, event_type as kind, value from events)""",
    "wobjects": """wobjects as (select n_name as name, r_name as parent, timestamp '1995-01-01' + to_days(cast(n_nationkey * 10 as int)) as life_start,
  case when n_nationkey % 3 <> 0 then timestamp '1995-01-01' + to_days(cast(n_nationkey * 20 + 5 as int)) end as life_end from nation join region on n_regionkey = r_regionkey
  union all select r_name, null, timestamp '1995-01-01' + to_days(cast(r_regionkey * 5 as int)), null from region)""",
}


def sql(body: str, *views: str) -> str:
    """A query over the named views."""
    return f"with {', '.join(SQL[v] for v in views)}\n{body}"
