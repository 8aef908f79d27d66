"""Queries of vocabulary retrieval (V) and evaluation functions (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placelens.operators import histograms as H, tables as T, vocabulary as B
from placelens.plans.graphs import _LABEL, labels, rec
from placelens.plans.joins import _HIST, histograms
from placelens.plans.registry import q4, query, r4
from placelens.scratch import materialize
from placelens.sources import views as V

K, DEPTH = 4, 2
#: Descriptors to train a vocabulary on.
TRAINING = 400_000


def given_tree(spark, d) -> DataFrame:
    """A tree from the data itself: four descriptors below the root, and four below each of them."""
    e = V.descriptors(spark, d)
    first = e.where("vec_id between 1 and 4").select(F.col("vec_id").alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.lit(1).alias("depth"), F.lit(False).alias("is_leaf"), F.col("vec").alias("centroid"))
    second = e.where("vec_id between 5 and 20").select(F.col("vec_id").alias("node_id"), F.floor((F.col("vec_id") - 1) / 4).alias("parent_id"), F.lit(2).alias("depth"), F.lit(True).alias("is_leaf"), F.col("vec").alias("centroid"))
    return first.unionByName(second)


def given_postings(spark, d) -> DataFrame:
    return B.postings(B.assign_paths(V.descriptors(spark, d), given_tree(spark, d), DEPTH))


def given_vectors(spark, d, min_depth: int = 1) -> DataFrame:
    posts = given_postings(spark, d)
    return B.weighted(posts, B.node_weights(posts, V.descriptors(spark, d).count()), min_depth)


_D2 = "list_sum(list_transform(list_zip(d.vec, n.vec), lambda t: (t[1]::double - t[2]::double) * (t[1]::double - t[2]::double)))"
_PATHS = f"""l1 as (select d.vec_id, d.source_id, arg_min(n.vec_id, {{'d': {_D2}, 'n': n.vec_id}}) as node_id from descriptors d join descriptors n on n.vec_id between 1 and 4 group by all),
l2 as (select d.vec_id, d.source_id, arg_min(n.vec_id, {{'d': {_D2}, 'n': n.vec_id}}) as node_id from descriptors d join l1 using (vec_id) join descriptors n on n.vec_id between 5 and 20 and (n.vec_id - 1) // 4 = l1.node_id group by all),
paths as (select vec_id, source_id, 0 as node_id, 0 as depth from descriptors union all select *, 1 from l1 union all select *, 2 from l2),
posts as (select node_id, depth, source_id, count(*) as tf from paths group by all),
weights as (select node_id, ln((select count(*) from descriptors)) - ln(count(distinct source_id)) as weight from posts group by 1),
vectors as (select source_id, node_id, weight * tf as v from posts join weights using (node_id) where depth >= 1),
norms as (select source_id, sum(abs(v)) as norm from vectors group by 1),
scores as (select q.source_id as query_id, d.source_id, 1 - sum(least(q.v, d.v)) / max(greatest(qn.norm, dn.norm)) as score, 2 - 2 * sum(least(q.v / qn.norm, d.v / dn.norm)) as debug from vectors q join vectors d using (node_id)
join norms qn on qn.source_id = q.source_id join norms dn on dn.source_id = d.source_id group by all)"""


def voc(body: str) -> str:
    return V.sql(f", {_PATHS} {body}", "descriptors").replace("\n, ", ",\n")


@query("v1_train_tree")
def v1(spark, d):
    tree = B.train_tree(V.descriptors(spark, d), K, DEPTH)
    return tree.select("node_id", "parent_id", "depth", "is_leaf", "n", r4(F.col("centroid")[0]).alias("c0"))


@query("v2_assign_path", voc("select vec_id, cast(node_id as bigint) as node_id, depth from paths"))
def v2(spark, d):
    return B.assign_paths(V.descriptors(spark, d), given_tree(spark, d), DEPTH).select("vec_id", "node_id", "depth")


@query("v3_postings", voc("select cast(node_id as bigint) as node_id, source_id, tf from posts"))
def v3(spark, d):
    return given_postings(spark, d).select("node_id", "source_id", "tf")


@query("v4_append", voc("select cast(node_id as bigint) as node_id, source_id, tf from posts"))
def v4(spark, d):
    """Two batches give the same as one."""
    e, tree = V.descriptors(spark, d), given_tree(spark, d)
    one, two = (B.postings(B.assign_paths(e.where(F.col("vec_id") % 3 == 0 if k else F.col("vec_id") % 3 != 0), tree, DEPTH)) for k in (0, 1))
    return B.append(one, two).select("node_id", "source_id", "tf")


@query("v5_node_weights", voc(f"select cast(node_id as bigint) as node_id, {q4('weight')} as weight from weights"))
def v5(spark, d):
    return B.node_weights(given_postings(spark, d), V.descriptors(spark, d).count()).select("node_id", r4("weight").alias("weight"))


@query("v6_source_norms", voc(f"select source_id, {q4('norm')} as norm from norms"))
def v6(spark, d):
    return B.norms(given_vectors(spark, d)).select("source_id", r4("norm").alias("norm"))


@query("v7_query_vector", voc(f"select source_id, cast(node_id as bigint) as node_id, {q4('v')} as v, {q4('norm')} as norm from vectors join norms using (source_id) where v <> 0"))
def v7(spark, d):
    """Every source as a query; words without weight, or of none that is a number, are dropped."""
    v = given_vectors(spark, d)
    finite = v.where("v <> 0 and not isnan(v) and abs(v) < double('inf')")
    return finite.join(B.norms(v), "source_id").select("source_id", "node_id", r4("v").alias("v"), r4("norm").alias("norm"))


@query("v8_score", voc(f"select query_id, source_id, {q4('score')} as score from scores"))
def v8(spark, d):
    v = materialize(given_vectors(spark, d), "vectors")
    return B.score(v, v).select("query_id", "source_id", r4("score").alias("score"))


@query("v9_debug_score", voc(f"select query_id, source_id, {q4('debug')} as score from scores"))
def v9(spark, d):
    v = materialize(given_vectors(spark, d), "vectors")
    return B.debug_score(v, v).select("query_id", "source_id", r4("score").alias("score"))


@query("v10_vector_distance", voc(f"select query_id, source_id, {q4('score')} as distance from scores where query_id < source_id"))
def v10(spark, d):
    v = materialize(given_vectors(spark, d), "vectors")
    return B.score(v, v).where("query_id < source_id").select("query_id", "source_id", r4("score").alias("distance"))


@query("v11_subgroup_vectors", voc(f"select source_id % 10 as group_id, source_id as subgroup_id, cast(node_id as bigint) as node_id, {q4('v')} as v, {q4('norm')} as norm from vectors join norms using (source_id)"))
def v11(spark, d):
    v = given_vectors(spark, d)
    return v.join(B.norms(v), "source_id").select((F.col("source_id") % 10).alias("group_id"), F.col("source_id").alias("subgroup_id"), "node_id", r4("v").alias("v"), r4("norm").alias("norm"))


@query("v12_group_candidates", voc("select query_id, group_id, subgroup_id, rank from (select query_id, source_id % 10 as group_id, source_id as subgroup_id, row_number() over (partition by query_id order by round(score, 6), source_id) as rank from scores) where rank <= 20"))
def v12(spark, d):
    v = materialize(given_vectors(spark, d), "vectors")
    best = T.top(B.score(v, v).withColumn("score", F.round("score", 6)), ["query_id"], 20, F.asc("score"), F.asc("source_id"))
    return best.select("query_id", (F.col("source_id") % 10).alias("group_id"), F.col("source_id").alias("subgroup_id"), F.col("rank").cast("long").alias("rank"))


def grown(spark, d) -> DataFrame:
    """Groups grown from each query's best subgroup; subgroups of a group are adjacent in a row."""
    v = materialize(given_vectors(spark, d), "vectors")
    parts = v.select((F.col("source_id") % 10).cast("long").alias("group_id"), F.col("source_id").cast("long").alias("subgroup_id"), "node_id", "v")
    queries = v.withColumn("source_id", F.col("source_id").cast("long"))
    best = B.score(queries, v).withColumn("group_id", (F.col("source_id") % 10).cast("long"))
    hints = best.groupBy("query_id", "group_id").agg(F.min_by(F.col("source_id").cast("long"), F.struct("score", "source_id")).alias("hint"))
    near = parts.select("group_id", F.col("subgroup_id").alias("i"), (F.col("subgroup_id") + 10).alias("j")).distinct()
    return B.grow_groups(hints, parts, queries, near)


@query("v13_grow_group")
def v13(spark, d):
    return grown(spark, d).select("query_id", "group_id", F.array_join(F.col("subgroups").cast("array<string>"), ",").alias("subgroups"), r4("score").alias("score"))


@query("v14_query_grouped")
def v14(spark, d):
    """Candidates, grown groups, overlapping ones suppressed, the five best of each query."""
    g = materialize(grown(spark, d).withColumn("key", F.col("group_id")), "grown")
    kept = T.suppress_overlapping(g, ["query_id"], "score", "key", "subgroups")
    return T.top(kept, ["query_id"], 5, F.asc("score"), F.asc("key")).select("query_id", F.col("key").alias("group_id"), r4("score").alias("score"), "rank")


@query("v15_reweight", voc(f""", factor as (select node_id, avg(1.0 / (1 + source_id % 5)) as f from vectors where source_id < 20 group by 1) select source_id, {q4('sum(abs(v * coalesce(f, 1.0)))')} as norm from vectors left join factor using (node_id) group by 1""").replace(" , factor", ", factor"))
def v15(spark, d):
    v = materialize(given_vectors(spark, d), "vectors")
    relevant = v.where("source_id < 20").select("source_id", (F.lit(1.0) / (1 + F.col("source_id") % 5)).alias("relevance")).distinct()
    return B.norms(B.reweight(v, relevant)).select("source_id", r4("norm").alias("norm"))


@query("v16_id_of", V.sql("select group_id, subgroup_id, min(source_id) as source_id, count(*) as members from descriptors group by all", "descriptors"))
def v16(spark, d):
    return V.descriptors(spark, d).groupBy("group_id", "subgroup_id").agg(F.min("source_id").alias("source_id"), F.count("*").alias("members"))


@query("v17_cell_members", voc("select q.vec_id as query_id, cast(q.node_id as bigint) as node_id, n, first, last from l1 q join (select node_id, count(*) as n, min(vec_id) as first, max(vec_id) as last from l1 group by 1) using (node_id) where q.vec_id % 20 = 0"))
def v17(spark, d):
    """For each query the node that it passes at the first level, and how many descriptors lie below it, from which to which.

    Members are gathered once a node, not once a query.
    """
    paths = materialize(B.assign_paths(V.descriptors(spark, d), given_tree(spark, d), 1), "paths").where("depth = 1")
    asked = paths.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "node_id")
    members = B.cell_members(paths, asked).groupBy("node_id").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))
    return asked.join(members, "node_id").select("query_id", "node_id", "n", "first", "last")


@query("v18_split_keypoints", V.sql("select obs_id, part, count(*) as n from (select obs_id, (row_number() over (partition by obs_id order by case when sx >= sy and sx >= sz then x when sy >= sz then y else z end, pt_idx) - 1) // 30 as part from points join (select obs_id, max(x) - min(x) sx, max(y) - min(y) sy, max(z) - min(z) sz from points group by 1) using (obs_id)) group by all", "points"))
def v18(spark, d):
    return B.split_keypoints(V.points(spark, d), ["obs_id"], 30).groupBy("obs_id", "part").agg(F.count("*").alias("n"))


def build_vocabulary(e: DataFrame, most: int = TRAINING) -> DataFrame:
    """Train on the first sweeps up to ``most`` descriptors, the very first in any case, then append the rest."""
    from pyspark.sql import Window

    upto = e.groupBy("source_id").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("source_id")))
    first = F.col("upto") == F.col("n")
    train = e.join(upto.where((F.col("upto") <= most) | first).select("source_id"), "source_id", "left_semi")
    rest = e.join(upto.where((F.col("upto") > most) & ~first).select("source_id"), "source_id", "left_semi")
    tree = materialize(B.train_tree(train, K, DEPTH), "tree")
    posts = B.append(B.postings(B.assign_paths(train, tree, DEPTH)), B.postings(B.assign_paths(rest, tree, DEPTH)))
    return posts.select("node_id", "source_id", "tf")


@query("v19_build_vocabulary")
def v19(spark, d):
    return build_vocabulary(V.descriptors(spark, d))


@query("v20_subsegment_search", voc(f"select query_id, source_id, {q4('score')} as score from scores where query_id % 20 = 0 and source_id % 7 <> 2 and source_id <> query_id"))
def v20(spark, d):
    """Stored sources among the live others."""
    v = materialize(given_vectors(spark, d), "vectors")
    return B.score(v.where("source_id % 20 = 0"), v.where("source_id % 7 <> 2")).where("source_id <> query_id").select("query_id", "source_id", r4("score").alias("score"))


@query("v21_flat_words")
def v21(spark, d):
    """Plain k-means, the best of a few restarts by cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = V.descriptors(spark, d).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    e = materialize(e, "features")
    models = [KMeans(k=8, seed=s, maxIter=10).fit(e) for s in (1, 2, 3)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(e).groupBy(F.col("prediction").alias("word")).agg(F.count("*").alias("n"))


@query("v22_frame_words", V.sql(f"select source_id, cast(word as bigint) as word, {q4('count(*) / max(n)')} as share from (select d.vec_id, d.source_id, arg_min(n.vec_id, {{'d': {_D2}, 'n': n.vec_id}}) as word from descriptors d join descriptors n on n.vec_id between 1 and 8 group by all) join (select source_id, count(*) n from descriptors group by 1) using (source_id) group by all", "descriptors"))
def v22(spark, d):
    """Nearest of eight words for each descriptor; a frame's histogram."""
    e = V.descriptors(spark, d)
    words = e.where("vec_id between 1 and 8").select(F.lit(0).cast("long").alias("parent_id"), F.col("vec_id").alias("node_id"), F.col("vec").alias("centroid"))
    near = B.assign_paths(e, words, 1).where("depth = 1")
    n = near.groupBy("source_id").agg(F.count("*").alias("n"))
    return near.groupBy("source_id", F.col("node_id").alias("word")).agg(F.count("*").alias("k")).join(n, "source_id").select("source_id", "word", r4(F.col("k") / F.col("n")).alias("share"))


# Functions that users pass in


def evaluate(queries: DataFrame, retrieve, truth: str = "label", k: int = 10) -> DataFrame:
    """Hit ratio per label of a retrieval function (queries -> query_id, rank, label)."""
    found = retrieve(queries).where(F.col("rank") <= k).join(queries.select("query_id", F.col(truth).alias("want")), "query_id")
    return found.groupBy(F.col("want").alias("label")).agg(r4(F.avg((F.col("label") == F.col("want")).cast("int"))).alias("ratio"))


def source_labels(spark, d) -> DataFrame:
    """(source_id, label): the most frequent label of a source, the smallest of equals."""
    n = V.descriptors(spark, d).groupBy("source_id", "label").agg(F.count("*").alias("n"))
    return n.groupBy("source_id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))


_MODE = "mode as (select source_id, arg_min(label, {'n': -n, 'l': label}) as label from (select source_id, label, count(*) as n from descriptors group by all) group by 1)"


@query("x1_evaluate_retrieval", voc(f""", {_MODE} select a.label, {q4('avg((b.label = a.label)::int)')} as ratio from (select query_id, source_id, row_number() over (partition by query_id order by round(score, 6), source_id) as rank from scores where query_id <> source_id) r
join mode a on a.source_id = query_id join mode b on b.source_id = r.source_id where rank <= 10 group by 1""").replace(" , mode", ", mode"))
def x1(spark, d):
    """The evaluator with the vocabulary's search; a hit has the query's label."""
    label = materialize(source_labels(spark, d), "labels")
    v = materialize(given_vectors(spark, d), "vectors")

    def by_words(q: DataFrame) -> DataFrame:
        s = B.score(v.join(q.select(F.col("query_id").alias("source_id")), "source_id", "left_semi"), v).where("query_id <> source_id")
        return T.top(s.withColumn("score", F.round("score", 6)), ["query_id"], 10, F.asc("score"), F.asc("source_id")).join(label, "source_id").select("query_id", "rank", "label")

    return evaluate(label.select(F.col("source_id").alias("query_id"), "label"), by_words)


def evaluate_segmentation(objects: DataFrame, segment) -> DataFrame:
    """Per label the mean size of the pieces that a segmentation function (points -> points with a column segment) cuts objects into."""
    n = segment(objects).groupBy("obs_id", "label", "segment").agg(F.count("*").alias("n"))
    return n.groupBy("label").agg(r4(F.avg("n")).alias("mean_size"))


def by_components(spark, d):
    """A segmentation: runs of points, joined where their centres are near (connected components)."""
    label = labels(spark, d)

    def segment(points: DataFrame) -> DataFrame:
        runs = points.withColumn("node", F.floor(F.col("pt_idx") / 20))
        return runs.join(label, ["obs_id", "node"], "left").withColumn("segment", F.coalesce("component", "node"))

    return segment


@query("x2_evaluate_segmentation", rec(f", {_LABEL} select label, {q4('avg(n)')} as mean_size from (select p.obs_id, p.label, coalesce(component, cast(floor(pt_idx / 20) as bigint)) as segment, count(*) as n from label_points p left join label l on l.obs_id = p.obs_id and node = cast(floor(pt_idx / 20) as bigint) group by all) group by 1", "points", "label_points"))
def x2(spark, d):
    """The evaluator with the segmentation by components."""
    return evaluate_segmentation(V.label_points(spark, d), by_components(spark, d))


def add(store: DataFrame | None, rows: DataFrame, key: str) -> DataFrame:
    """A model store with rows added; models of a key that it has already are replaced."""
    return rows if store is None else T.upsert(store, rows, [key])


def remove(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """A model store without some models."""
    return store.join(ids.select(key).distinct(), key, "left_anti")


def search(name: str, store: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, other, rank): the n best models of a store for each query; stores are histogram, vocabulary and first.

    Histograms are rows of obs_id, bin and w, vocabularies of source_id, node_id and
    v; of the first store the smallest ids win.
    """
    if name == "histogram":
        named = lambda h: h.select(F.col("obs_id").alias("id"), "bin", "w")
        s = H.overlaps(named(queries), named(store), 6, most=n).select(F.col("id").alias("query_id"), "other", (-F.col("score")).alias("score"))
    elif name == "vocabulary":
        s = B.score(queries, store).withColumnsRenamed({"source_id": "other"})
    elif name == "first":
        # no more than n + 1 smallest ids can be among the n best of any query
        least = store.select(F.col("source_id").alias("other")).distinct().orderBy("other").limit(n + 1)
        s = queries.select(F.col("source_id").alias("query_id")).distinct().join(F.broadcast(least)).withColumn("score", F.col("other").cast("double"))
    else:
        raise ValueError(f"unknown store {name}")
    return T.top(s.where("other <> query_id").withColumn("score", F.round("score", 6)), ["query_id"], n, F.asc("score"), F.asc("other")).select("query_id", "other", F.col("rank").cast("long").alias("rank"))


_FOUND = "select '{0}' as store, query_id, other, rank from (select *, row_number() over (partition by query_id order by {1}, other) as rank from ({2}) where other <> query_id and other % 7 <> 2) where rank <= 5"


@query("x3_model_search", V.sql(f", {_PATHS}, {_HIST} " + " union all ".join(_FOUND.format(*x) for x in (
    ("histogram", "score desc", "select a.obs_id as query_id, b.obs_id as other, round(sum(least(a.w, b.w)), 6) as score from h a join h b using (bin) where a.obs_id % 20 = 0 group by all"),
    ("vocabulary", "score", "select query_id, source_id as other, round(score, 6) as score from scores where query_id % 20 = 0"),
    ("first", "other", "select q.source_id as query_id, s.source_id as other from (select distinct source_id from descriptors where source_id % 20 = 0) q, (select distinct source_id from descriptors) s"),
)), "descriptors", "points").replace("\n, ", ",\n"))
def x3(spark, d):
    """Models are added to each store in two parts, some are removed, the rest is searched."""
    v, h = materialize(given_vectors(spark, d), "vectors"), materialize(histograms(spark, d), "histograms")
    ids = v.select("source_id").distinct()
    out = None
    for name, rows, key in (("histogram", h, "obs_id"), ("vocabulary", v, "source_id"), ("first", ids, "source_id")):
        store = add(add(None, rows.where(F.col(key) % 2 == 0), key), rows.where(F.col(key) % 2 == 1), key)
        store = remove(store, rows.where(F.col(key) % 7 == 2), key)
        found = search(name, store, rows.where(F.col(key) % 20 == 0), 5).select(F.lit(name).alias("store"), F.col("query_id").cast("long").alias("query_id"), F.col("other").cast("long").alias("other"), "rank")
        out = found if out is None else out.unionByName(found)
    return out


@query("x4_query_kind", V.sql("select kind, count(*) as n from (select 'all' as kind, event_id from wobj_obs union all select 'models', event_id from wobj_obs where kind in ('purchase', 'signup') union all select 'rooms', event_id from wobj_obs where kind not in ('purchase', 'signup')) group by 1", "wobj_obs"))
def x4(spark, d):
    """Each kind of query sees its own part of the store."""
    model = F.col("kind").isin("purchase", "signup")
    kinds = F.explode(F.array(F.lit("all"), F.when(model, "models").otherwise("rooms")))
    return V.wobj_obs(spark, d).select(kinds.alias("k")).groupBy(F.col("k").alias("kind")).agg(F.count("*").alias("n"))
