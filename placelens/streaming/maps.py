"""Maps of places, kept in versions and changed by one stream of sweeps and resets.

A map is the static points of a place. Every change of a place writes its whole map
as a new version, and a pointer says which version is the latest; what was written
before is never touched, so a micro-batch that broke off is repeated under the same
versions and gives the same maps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placelens.operators import spatial as S
from placelens.scratch import materialize
from placelens.streaming.jobs import folder

#: Versions of one micro-batch; the last of them is that of a compaction.
STEPS = 1 << 20
#: Farthest distance of the centroids of a sweep without waypoint and the map of its place, in metres.
REACH = 1.53
SWEEP = ("sweep_id", "stamp", "cx", "cy", "cz")
POINTER = (
    "place string, bucket int, at bigint, live boolean, made struct<stamp: timestamp, sweep_id: bigint, cx: double, cy: double, cz: double>,"
    " last struct<stamp: timestamp, sweep_id: bigint, cx: double, cy: double, cz: double>"
)


def _record() -> Column:
    return F.struct("stamp", "sweep_id", "cx", "cy", "cz")


class MapStore:
    """Points of maps by version and bucket of places, and pointers to the latest version of each place.

    Places are dealt to ``buckets`` by hash, so that a reader opens only the parts that
    the places asked for stand in. A bucket with more than ``keep`` parts is written
    anew as one (``compact``); its older parts go when the micro-batch after that
    begins (``clean``), as only then nobody repeats the one before.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int = 64, keep: int = 16) -> None:
        self.spark, self.root, self.buckets, self.keep = spark, root or folder(spark, "maps"), buckets, keep
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, where: str, key: str) -> list[int]:
        """Values of a partition column below a folder."""
        path = self._path(where)
        names = [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(int(n.removeprefix(f"{key}=")) for n in names if n.startswith(f"{key}="))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("place"), F.lit(self.buckets)).cast("int")

    def pointers(self, before: int) -> DataFrame:
        """Of each place that had a map in a version before ``before`` the latest pointer."""
        found = [v for v in self._numbers(f"{self.root}/pointers", "version") if v < before]
        whole = max((v for v in found if v % STEPS == STEPS - 1), default=0)
        paths = [f"{self.root}/pointers/version={v}" for v in found if v >= whole]
        if not paths:
            return self.spark.createDataFrame([], POINTER)
        rows = self.spark.read.schema(f"{POINTER}, version bigint").option("basePath", f"{self.root}/pointers").parquet(*paths)
        kept = [c for c in rows.columns if c not in ("place", "version")]
        newest = rows.groupBy("place").agg(F.max_by(F.struct(*kept), "version").alias("p"))
        return newest.select("place", "p.*")

    def read(self, pointers: DataFrame) -> DataFrame | None:
        """Points of the maps that live pointers name; None if there are none."""
        live = pointers.where("live").select("place", "at", "bucket")
        # at most one row a bucket and version that was not compacted yet
        parts = [f"{self.root}/points/version={r['at']}/bucket={r['bucket']}" for r in live.select("at", "bucket").distinct().collect()]
        parts = [p for p in sorted(parts) if self._fs.exists(self._path(p))]
        if not parts:
            return None
        rows = self.spark.read.option("basePath", f"{self.root}/points").parquet(*parts)
        return rows.join(live.select("place", F.col("at").alias("version")), ["place", "version"], "left_semi").drop("version", "bucket")

    def write(self, points: DataFrame | None, pointers: DataFrame, version: int) -> None:
        """The maps of a version and then its pointers, which make it visible."""
        if points is not None:
            dealt = points.withColumn("bucket", self.bucket()).hint("rebalance", F.col("bucket"))
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/points/version={version}")
        pointers.withColumn("bucket", self.bucket()).select("place", "bucket", "at", "live", "made", "last").write.mode("overwrite").parquet(f"{self.root}/pointers/version={version}")

    def _parts(self) -> dict[int, list[int]]:
        """Versions of each bucket's parts."""
        out: dict[int, list[int]] = {}
        for v in self._numbers(f"{self.root}/points", "version"):
            for b in self._numbers(f"{self.root}/points/version={v}", "bucket"):
                out.setdefault(b, []).append(v)
        return out

    def compact(self, batch: int) -> list[int]:
        """Write buckets of more than ``keep`` parts as one part each, and all pointers; the buckets written."""
        version = batch * STEPS + STEPS - 1
        many = [b for b, found in self._parts().items() if len([v for v in found if v < version]) > self.keep]
        if many:
            now = self.pointers(version)
            moved = now.withColumn("at", F.when(F.col("bucket").isin(many), F.lit(version)).otherwise(F.col("at")))
            self.write(self.read(now.where(F.col("bucket").isin(many))), moved, version)
        return many

    def clean(self, batch: int) -> None:
        """Delete what compactions of batches before ``batch`` replaced."""
        done = lambda found: max((v for v in found if v < batch * STEPS and v % STEPS == STEPS - 1), default=0)
        pointers = self._numbers(f"{self.root}/pointers", "version")
        for v in pointers:
            if v < done(pointers):
                self._fs.delete(self._path(f"{self.root}/pointers/version={v}"), True)
        for b, found in self._parts().items():
            for v in found:
                if v < done(found):
                    self._fs.delete(self._path(f"{self.root}/points/version={v}/bucket={b}"), True)

    def maps(self, before: int = 1 << 62) -> DataFrame | None:
        """All points of all live maps."""
        return self.read(self.pointers(before))


def matched(sweeps: DataFrame, maps: DataFrame, reach: float = REACH) -> DataFrame:
    """Sweeps with their place: the waypoint, or the first map made before them whose centroid is closer than ``reach``.

    Sweeps without waypoint (null or empty) that no map is near make one of their own,
    ``at:<sweep_id>``, which later ones match. ``maps`` are pointers of live maps;
    maps that the sweeps make themselves count from their first sweep on. Of the
    sweeps still open those before all others in the 27 cells around them make a map
    in a round, so that no pairs of sweeps are formed.
    """
    none = F.coalesce(F.trim("waypoint"), F.lit("")) == ""
    named = sweeps.where(~none).withColumn("place", F.col("waypoint"))
    order = F.struct("stamp", "sweep_id")
    open_ = materialize(sweeps.where(none).select(*SWEEP, order.alias("since"), *(F.col(f"c{k}").alias(k) for k in "xyz")), "open")
    if open_.isEmpty():
        return named.select(*SWEEP, "place")
    begun = named.join(maps.select("place"), "place", "left_anti").groupBy("place").agg(F.min(_record()).alias("made"))
    spot = lambda df: df.select("place", F.struct("made.stamp", "made.sweep_id").alias("since"), *(F.col(f"made.c{k}").alias(k) for k in "xyz"))
    known = materialize(spot(maps).unionByName(spot(begun)), "known")

    def near(rows: DataFrame, spots: DataFrame) -> DataFrame:
        return S.pairs_within(rows.select("sweep_id", "since", "x", "y", "z"), spots, reach, [], strict=True).where("b_since < since")

    left = materialize(open_.join(near(open_, known).select("sweep_id").distinct(), "sweep_id", "left_anti"), "left")
    while not left.isEmpty():
        first = S.with_cells(left, reach, True, "k").groupBy("kx", "ky", "kz").agg(F.min("since").alias("first"))
        makers = S.with_cells(left, reach, prefix="k").join(first, ["kx", "ky", "kz"]).where("first = since")
        made = makers.select(F.concat(F.lit("at:"), F.col("sweep_id").cast("string")).alias("place"), "since", "x", "y", "z", "sweep_id")
        made = materialize(made, "made")
        known = known.unionByName(made.drop("sweep_id"))
        rest = left.join(made.select("sweep_id"), "sweep_id", "left_anti")
        left = materialize(rest.join(near(rest, made.drop("sweep_id")).select("sweep_id").distinct(), "sweep_id", "left_anti"), "left")
    best = near(open_, known).groupBy("sweep_id").agg(F.min(F.struct("b_since", "b_place")).alias("m"))
    placed = open_.join(best, "sweep_id", "left").select(*SWEEP, F.coalesce("m.b_place", F.concat(F.lit("at:"), F.col("sweep_id").cast("string"))).alias("place"))
    return named.select(*SWEEP, "place").unionByName(placed)


def updated(old: DataFrame, sweep: DataFrame, squared: float, seen: Callable[[DataFrame], DataFrame], bins: int = 61) -> DataFrame:
    """Maps after a sweep of each: points that the sweep sees past go, points that it adds come.

    A map point without a sweep point near it goes only when it stands in front of
    what the sweep shows in its direction; behind that, or where the sweep shows
    nothing, it may be hidden and stays. ``seen`` adds range, tbin and pbin.
    """
    by, key = ["place"], ["place", "sweep_id", "pt_idx"]
    gone = S.cloud_difference(old, sweep, squared, by)
    front = S.occlusion(seen(gone), seen(sweep), by, bins).where("side = 'front'").select(*key)
    return old.join(front.hint("merge"), key, "left_anti").unionByName(S.cloud_difference(sweep, old, squared, by))


class MapUpdates:
    """One micro-batch step over sweeps and resets.

    Messages have kind ("sweep" or "reset"), sweep_id, waypoint, stamp, cx, cy, cz, and for
    resets ids (places, empty or null: all) and initialize. Sweeps apply in order of
    (stamp, sweep_id), those of different places side by side; a reset applies after the
    sweeps up to its stamp: maps are dropped, and begun anew with the latest sweep of
    their place if asked. Resets are calls of an operator, a few a batch; the driver
    holds one batch's. ``points`` gives (sweep_id, pt_idx, x, y, z) of the sweeps handed in.

    ``status`` gets a row for each sweep: finished, or error for one without points,
    stamp, or both waypoint and centroid, which changes no map.
    """

    def __init__(self, store: MapStore, points: Callable[[DataFrame], DataFrame], squared: float, seen: Callable[[DataFrame], DataFrame]) -> None:
        self.store, self.points, self.squared, self.seen = store, points, squared, seen
        self.status_root = f"{store.root}/status"

    def __call__(self, batch: DataFrame, number: int) -> None:
        store, version = self.store, number * STEPS
        store.clean(number)
        batch = materialize(batch, "batch")
        sweeps = batch.where("kind = 'sweep'").select(*SWEEP, "waypoint")
        cloud = materialize(self.points(sweeps), "clouds")
        named = F.coalesce(F.trim("waypoint"), F.lit("")) != ""
        placed = F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("cz").isNotNull() & ~(F.isnan("cx") | F.isnan("cy") | F.isnan("cz"))
        found = sweeps.join(cloud.select("sweep_id").distinct().withColumn("found", F.lit(True)), "sweep_id", "left")
        good = F.coalesce(F.col("found"), F.lit(False)) & F.col("stamp").isNotNull() & (named | placed)
        told = materialize(found.withColumn("good", good), "told")
        good_sweeps = told.where("good").select(*SWEEP, "waypoint")
        after = None
        for reset in [*batch.where("kind = 'reset' and stamp is not null").orderBy("stamp", "ids", "initialize").select("stamp", "ids", "initialize").collect(), None]:
            part = good_sweeps if after is None else good_sweeps.where(F.col("stamp") > F.lit(after))
            if reset is not None:
                part = part.where(F.col("stamp") <= F.lit(reset["stamp"]))
            version = self.apply(part, cloud, version)
            if reset is not None:
                version = self.reset(list(reset["ids"] or []), bool(reset["initialize"]), version)
                after = reset["stamp"]
        status = F.when(F.col("good"), "finished_processing_observation").otherwise("error_processing_observation")
        told.select("sweep_id", status.alias("status")).write.mode("overwrite").parquet(f"{self.status_root}/batch={number}")
        store.compact(number)

    def apply(self, sweeps: DataFrame, cloud: DataFrame, version: int) -> int:
        """Update the maps of the sweeps' places, one version for each further sweep of a place; the next version."""
        live = self.store.pointers(version).where("live")
        order = F.row_number().over(Window.partitionBy("place").orderBy("stamp", "sweep_id"))
        ranked = materialize(matched(sweeps, live).withColumn("turn", order), "ranked")
        turns = ranked.agg(F.max("turn")).first()[0] or 0
        for turn in range(1, turns + 1):
            now = ranked.where(F.col("turn") == turn)
            old = self.store.pointers(version).where("live").join(now.select("place"), "place", "left_semi")
            fresh = cloud.join(now.select("place", "sweep_id"), "sweep_id")
            maps = self.store.read(old)
            points = fresh if maps is None else updated(maps.select(*fresh.columns), fresh, self.squared, self.seen)
            made = now.join(old.select("place", "made"), "place", "left").select(
                "place", F.lit(version).alias("at"), F.lit(True).alias("live"), F.coalesce("made", _record()).alias("made"), _record().alias("last")
            )
            self.store.write(points, made, version)
            version += 1
        return version

    def reset(self, ids: list[str], initialize: bool, version: int) -> int:
        """Drop the maps of ``ids`` (empty: all), and begin them anew with the latest sweep of their place if asked."""
        named = self.store.pointers(version)
        if ids:
            named = named.where(F.col("place").isin(*ids))
        named = materialize(named, "named")
        if initialize:
            last = named.select("place", F.col("last.sweep_id").alias("sweep_id"))
            points = self.points(last.select("sweep_id")).join(last, "sweep_id")
            now = named.select("place", F.lit(version).alias("at"), F.lit(True).alias("live"), F.col("last").alias("made"), "last")
        else:
            points, now = None, named.withColumn("live", F.lit(False))
        self.store.write(points, now, version)
        return version + 1

    def status(self) -> DataFrame:
        """(sweep_id, status) of all sweeps so far."""
        return self.store.spark.read.schema("sweep_id bigint, status string, batch bigint").parquet(self.status_root).drop("batch")
