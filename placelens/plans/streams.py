"""Queries of streaming jobs (T); each replays files and says what its batch twin says."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.functions import geometry as G
from placelens.operators import spatial as S, vocabulary as B
from placelens.plans.joins import _SEEN, BY, R2, cloud, distance
from placelens.plans.projections import binned
from placelens.plans.registry import q4, query, r4
from placelens.plans.retrieval import DEPTH, given_tree, voc
from placelens.plans.windows import _near
from placelens.sources import views as V
from placelens.streaming import jobs as J, maps as M, state as K


_DAY = "86400000000::bigint"


@query("t1_sync_frames", V.sql(f""", best as (select a.event_id, b.kind, arg_min(b.event_id, {{'g': abs(epoch_us(a.stamp) - epoch_us(b.stamp)), 'i': b.event_id}}) as partner
from wobj_obs a join wobj_obs b on a.name = b.name and a.kind = 'view' and b.kind in ('click', 'purchase', 'signup') and abs(epoch_us(a.stamp) - epoch_us(b.stamp)) <= {_DAY}
where (epoch_us(a.stamp) // (2 * {_DAY}) + 1) * 2 * {_DAY} + {_DAY} <= (select max(epoch_us(stamp)) // 1000 * 1000 from wobj_obs) - 10 * {_DAY} group by all)
select event_id, max(partner) filter (kind = 'click') as click, max(partner) filter (kind = 'purchase') as purchase, max(partner) filter (kind = 'signup') as signup from best group by 1 having count(*) = 3""", "wobj_obs").replace("\n, ", ",\n"))
def t1(spark, d):
    """Sets of four kinds within a day of each view, told once the stream is ten days past them."""
    sets = J.matched_sets(J.events(spark, d, 10_000), "view", ["click", "purchase", "signup"], 86_400, "10 days")
    return J.run_to(sets).select("event_id", "click", "purchase", "signup")


#: Seconds without a message after which an open sweep is given up.
SILENCE = 5 * 86_400


def _sweeps_sql(start: str, stop: str, positions: int, where: str = "true") -> str:
    """sweeps (name, sweep, position, frames, median): each start begins a run of messages, whose first stop or silence ends it."""
    return f""", past as (select * from wobj_obs where {where}),
told as (select name, event_id, kind, value, epoch_us(stamp) as us from past where epoch_us(stamp) <= ((select epoch_ms(max(stamp)) from past) - 86400000) * 1000),
runs as (select *, us - lag(us) over w > {SILENCE}000000::bigint as silent, count(*) filter (kind = '{start}') over w as run, row_number() over w as i from told window w as (partition by name order by us, event_id)),
ends as (select name, run, min(i) as stop, arg_min(coalesce(silent, false), i) as lost from runs where run > 0 and (kind = '{stop}' or silent and kind <> '{start}') group by all),
done as (select name, run, stop, row_number() over (partition by name order by run) - 1 as sweep from ends where not lost),
sweeps as (select name, cast(sweep as int) as sweep, cast(event_id % {positions} as int) as position, cast(count(*) as int) as frames, list_sort(list(value))[cast(count(*) // 2 as int) + 1] as median
from runs join done using (name, run) where kind <> '{start}' and i < stop and value is not null group by all)"""


@query("t2_assemble_sweep", V.sql(f"{_sweeps_sql('signup', 'purchase', 3)} select name, sweep, position, frames, {q4('median')} as median from sweeps", "wobj_obs").replace("\n, ", ",\n"))
def t2(spark, d):
    """signup opens a sweep, purchase finishes it; frames at one of three positions become their median, once the stream is a day past them."""
    with J.rocksdb(spark):
        found = J.run_to(K.assembled(J.events(spark, d, 10_000), "signup", "purchase", 3, "1 day", SILENCE))
    return found.select("name", "sweep", "position", "frames", r4("median").alias("median"))


_FAR = f"seen as ({_SEEN}), far as (select obs_id, tbin, pbin, max(r) as other from seen where view_no = 1 group by all)"


#: Places dropped after the first hour, and begun anew after the second.
DROPPED, RENEWED = ["WP1", "WP2", "WP5"], ["WP3", "WP4"]


def sweep_messages(spark, d, resets=()):
    """Each supplier's place is swept once an hour (its views 0 to 2), in one stream with the resets named.

    Every fifth robot loses its waypoint after its first sweep, so that centroids decide; its third sweep is an hour late
    and at the next place. Every fourth sends a sweep (3) whose points are missing.
    """
    s, view = F.col("s_suppkey"), F.col("view")
    lost = (s % 5 == 0) & (view > 0)
    hour = F.when(lost & (view == 2), 3).otherwise(view)
    at = lambda hours: F.timestamp_seconds(F.lit(1_704_067_200) + 3600 * hours)
    each = J.read_stream(spark, d, "supplier", 10_000).select("s_suppkey", F.explode(F.sequence(F.lit(0), F.when(s % 4 == 0, 3).otherwise(2))).alias("view"))
    sweeps = each.select(
        F.lit("sweep").alias("kind"), (s * 4 + view).cast("long").alias("sweep_id"), F.when(~lost, F.concat(F.lit("WP"), s.cast("string"))).alias("waypoint"), at(hour).alias("stamp"),
        F.when(lost & (view == 2), (s + 1) * 3.0 + 0.2).otherwise(s * 3.0 + view * 0.4).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("cz"),
        F.lit(None).cast("array<string>").alias("ids"), F.lit(None).cast("boolean").alias("initialize"),
    )
    calls = {"drop": (0, 0.5, DROPPED, False), "renew": (1, 1.5, RENEWED, True), "all": (2, 1.5, [], True)}
    for name in resets:
        region, hours, ids, initialize = calls[name]
        one = J.read_stream(spark, d, "region", 10_000).where(F.col("r_regionkey") == region)
        sweeps = sweeps.unionByName(
            one.select(F.lit("reset").alias("kind"), at(F.lit(hours)).alias("stamp"), F.array(*map(F.lit, ids)).cast("array<string>").alias("ids"), F.lit(initialize).alias("initialize")), allowMissingColumns=True
        )
    return sweeps


def sweep_points(spark, d):
    """Points of the sweeps handed in."""
    every = V.points(spark, d).select((F.col("obs_id") * 4 + F.col("view_no")).alias("sweep_id"), "pt_idx", "x", "y", "z")
    return lambda sweeps: every.join(sweeps.select("sweep_id"), "sweep_id", "left_semi")


def map_updates(spark, d, resets=()):
    """The maps after all sweeps and resets, and their statuses."""
    updates = M.MapUpdates(M.MapStore(spark), sweep_points(spark, d), R2, binned)
    J.run_batches(sweep_messages(spark, d, resets), updates)
    return updates


def _maps(tag: str, dropped=(), renewed=()) -> str:
    """SQL of the maps m3 after sweeps (turns 0 to 3) and resets; ``renewed`` None begins all anew."""
    listed = lambda names: ", ".join(f"'{n}'" for n in names) or "''"
    alone = "s_suppkey % 5 = 0 and view = 2 and s_suppkey = (select max(s_suppkey) from supplier)"
    left = f"s_suppkey % 5 = 0 and view = 1 and 'WP' || s_suppkey in ({listed(dropped)})"
    place = f"case when {alone} or {left} then 'at:' || (s_suppkey * 4 + view) when s_suppkey % 5 = 0 and view = 2 then 'WP' || (s_suppkey + 1) else 'WP' || s_suppkey end"
    met = lambda a, b: " and ".join((f"{a}.place = {b}.place", f"{distance(a, b)} <= {R2}"))
    kept = "place, obs_id, pt_idx, x, y, z, r, tbin, pbin"

    def step(new: str, old: str, turn: int) -> str:
        return f"""far{tag}{turn} as (select place, tbin, pbin, max(r) as other from swept{tag} where turn = {turn} and r is not null group by all),
{new} as materialized (select {kept} from {old} a where exists (select 1 from swept{tag} b where b.turn = {turn} and {met('a', 'b')}) or not exists (select 1 from far{tag}{turn} f where f.place = a.place and f.tbin = a.tbin and f.pbin = a.pbin and a.r < f.other)
union all select {kept} from swept{tag} a where turn = {turn} and not exists (select 1 from {old} b where {met('a', 'b')}))"""

    again = "true" if renewed is None else f"place in ({listed(renewed)})"
    return f"""visits{tag} as (select s_suppkey as s, view, {place} as place, case when s_suppkey % 5 = 0 and view = 2 then 3 else view end as turn from supplier, (values (0), (1), (2)) v(view)),
swept{tag} as materialized (select place, turn, obs_id, pt_idx, x, y, z, seen.r, tbin, pbin from points join visits{tag} on obs_id = s and view_no = view left join seen using (obs_id, view_no, pt_idx)),
begun{tag} as (select {kept} from swept{tag} where turn = 0 and place not in ({listed(dropped)})),
{step(f'one{tag}', f'begun{tag}', 1)},
reset{tag} as (select * from one{tag} where not ({again}) union all select {kept} from swept{tag} where turn = 1 and {again}),
{step(f'two{tag}', f'reset{tag}', 2)},
{step(f'm3{tag}', f'two{tag}', 3)}"""


def _maps_sql(body: str, *parts: str) -> str:
    return V.sql(f", seen as ({_SEEN}), {', '.join(parts)} {body}", "points").replace("\n, ", ",\n")


@query("t3_update_metaroom_stream", _maps_sql("select place, obs_id, pt_idx from m3", _maps("")))
def t3(spark, d):
    """Each arriving sweep is matched with the map of its place, compared both ways, tested for occlusion, and updates the map."""
    return map_updates(spark, d).store.maps().select("place", F.floor(F.col("sweep_id") / 4).alias("obs_id"), "pt_idx")


@query("t4_newest_clusters_mode", V.sql(f""", {_FAR} select obs_id, count(*) as n, count(*) filter (front) as front from (select obs_id, exists (select 1 from seen s join far using (obs_id, tbin, pbin) where s.view_no = 2 and s.obs_id = a.obs_id and s.pt_idx = a.pt_idx and r < other) as front from points a where {_near(2, 1)}) group by 1""", "points").replace("\n, ", ",\n"))
def t4(spark, d):
    """Against the sweep before (view 1) instead of the map: what is new, and how much of it stands in front."""
    store = J.Batches(spark, "newest")

    def step(batch, number):
        arrived = batch.select(F.col("s_suppkey").alias("obs_id"))
        pick = lambda k: cloud(spark, d, k).join(arrived, "obs_id", "left_semi")
        new = S.cloud_difference(pick(2), pick(1), R2, BY)
        front = S.occlusion(binned(new), binned(pick(1)), BY, 61).where("side = 'front'").select("obs_id", "pt_idx", F.lit(True).alias("front"))
        each = new.join(front, ["obs_id", "pt_idx"], "left")
        store.write(each.groupBy("obs_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce("front", F.lit(False))).alias("front")), number)

    J.run_batches(J.read_stream(spark, d, "supplier"), step)
    return store.newest("obs_id").select("obs_id", "n", "front")


_RESETS = (_maps("_some", DROPPED, RENEWED), _maps("_all", renewed=None))


@query("t5_reset_metaroom", _maps_sql("select 'some' as kind, place, obs_id, pt_idx from m3_some union all select 'all', place, obs_id, pt_idx from m3_all", *_RESETS))
def t5(spark, d):
    """Map points after sweeps among which maps are dropped, and two begun anew; or all (no names given) begun anew."""
    each = {kind: map_updates(spark, d, calls).store.maps().withColumn("kind", F.lit(kind)) for kind, calls in (("some", ("drop", "renew")), ("all", ("all",)))}
    return each["some"].unionByName(each["all"]).select("kind", "place", F.floor(F.col("sweep_id") / 4).alias("obs_id"), "pt_idx")


_KEEP = 43_200
_LATEST = """arg_max(b.event_id, {{'s': b.stamp, 'e': b.event_id}}) filter (b.kind = '{0}') as {1}, arg_max(b.value, {{'s': b.stamp, 'e': b.event_id}}) filter (b.kind = '{0}') as {1}_value"""


@query("t6_transform_buffer", V.sql(f""", found as (select a.event_id, {_LATEST.format('view', 'base')}, {_LATEST.format('purchase', 'camera')}
from wobj_obs a join wobj_obs b on a.name = b.name and b.kind in ('view', 'purchase') and epoch_us(b.stamp) between epoch_us(a.stamp) - {_KEEP}000000::bigint and epoch_us(a.stamp)
where a.kind = 'click' and (epoch_us(a.stamp) // {4 * _KEEP}000000::bigint + 1) * {4 * _KEEP}000::bigint <= (select epoch_ms(max(stamp)) from wobj_obs where kind in ('click', 'view', 'purchase')) - 86400000 group by 1)
select event_id, base, camera, {q4('base_value + cos(base % 63 * 0.1) * camera_value')} as x, {q4('sin(base % 63 * 0.1) * camera_value')} as y from found where base is not null and camera is not null""", "wobj_obs").replace("\n, ", ",\n"))
def t6(spark, d):
    """For each query (click) the camera's pose in the map, from the latest pose of the base (view) and of the camera on it (purchase) in a buffer of twelve hours.

    The base stands at (value, 0), turned by its id; the camera value ahead of it.
    """
    with J.rocksdb(spark):
        found = J.run_to(K.transform_buffer(J.events(spark, d, 10_000), ["view", "purchase"], "click", _KEEP, 4, "1 day"))
    each = found.select("event_id", F.col("poses")[0].alias("base"), F.col("poses")[1].alias("camera"), F.col("values")[0].alias("at"), F.col("values")[1].alias("ahead"))
    turn = F.col("base") % 63 * 0.1
    c, s, zero, one = F.cos(turn), F.sin(turn), F.lit(0.0), F.lit(1.0)
    base = F.array(c, -s, zero, F.col("at"), s, c, zero, zero, zero, zero, one, zero)
    camera = F.array(one, zero, zero, F.col("ahead"), zero, one, zero, zero, zero, zero, one, zero)
    pose = each.withColumn("m", G.compose(base, camera))
    return pose.select("event_id", "base", "camera", r4(F.col("m")[3]).alias("x"), r4(F.col("m")[7]).alias("y"))


_VIEWING = _sweeps_sql("signup", "error", 1, "kind in ('signup', 'view', 'error')")


@query("t7_collect_views", V.sql(f"{_VIEWING} select name, sweep, frames as views from sweeps", "wobj_obs").replace("\n, ", ",\n"))
def t7(spark, d):
    """Views between a signup (start of viewing) and an error (its end), per selected object."""
    with J.rocksdb(spark):
        found = J.run_to(K.assembled(J.events(spark, d, 10_000).where("kind in ('signup', 'view', 'error')"), "signup", "error", 1, "1 day", SILENCE))
    return found.select("name", "sweep", F.col("frames").alias("views"))


def vocabulary_stream(spark, d, train, sweeps: int = 20, root: str | None = None):
    """Postings by batch: descriptors are held until more than ``sweeps`` sweeps are there, a tree is trained once, then batches are appended."""
    held, tree, posts = (J.Batches(spark, k, root and f"{root}/{k}") for k in ("held", "tree", "postings"))

    def step(batch, number):
        e = batch.select("vec_id", (F.col("vec_id") % 50).cast("int").alias("source_id"), F.col("embedding").alias("vec"))
        nodes = tree.read(number)
        if nodes is None:
            held.write(e, number)
            waiting = held.read(number + 1).drop("batch")
            if waiting.select("source_id").distinct().count() <= sweeps:
                return
            tree.write(train(waiting), number)
            nodes, e = tree.read(number + 1), waiting
        posts.write(B.postings(B.assign_paths(e, nodes.drop("batch"), DEPTH)), number)

    J.run_batches(J.read_stream(spark, d, "embeddings"), step, root and f"{root}/state")
    return posts.read().groupBy("node_id", "depth", "source_id").agg(F.sum("tf").alias("tf"))


@query("t8_vocabulary_stream", voc("select cast(node_id as bigint) as node_id, source_id, tf from posts"))
def t8(spark, d):
    """Training picks the tree of the retrieval queries, so that the postings can be told in SQL."""
    return vocabulary_stream(spark, d, lambda waiting: given_tree(spark, d)).select("node_id", "source_id", "tf")


@query("t9_skip_indexed", V.sql("select name, count(*) as n from wobj_obs where event_id % 4 <> 0 group by 1", "wobj_obs"))
def t9(spark, d):
    """Messages of sweeps that the index has already are ignored (stream-static anti join)."""
    indexed = V.wobj_obs(spark, d).where("event_id % 4 = 0").select("event_id", F.lit(True).alias("known"))
    fresh = J.events(spark, d).join(indexed, "event_id", "left").where("known is null").select("name", "event_id")
    return J.run_to(fresh).groupBy("name").agg(F.count("*").alias("n"))


@query("t10_status_events", V.sql("select s_suppkey * 4 + view as sweep_id, case when exists (select 1 from points where obs_id = s_suppkey and view_no = view) then 'finished' else 'error' end || '_processing_observation' as status from supplier, (values (0), (1), (2), (3)) v(view) where view < 3 or s_suppkey % 4 = 0", "points"))
def t10(spark, d):
    """What the map updates tell about each sweep, written by the same micro-batches as the maps."""
    return map_updates(spark, d).status()


@query("t11_streaming_sessions", V.sql("select name, sum(new)::bigint as n from (select name, case when lag(stamp) over w is null or epoch_us(stamp) - epoch_us(lag(stamp) over w) > 14400::bigint * 1000000 then 1 else 0 end as new from wobj_obs window w as (partition by name order by stamp)) group by 1", "wobj_obs"))
def t11(spark, d):
    """Number of sessions of each object."""
    found = J.run_to(J.sessions(J.events(spark, d), "14400 seconds", "100 days"), mode="complete")
    return found.groupBy("name").agg(F.count("*").alias("n"))
