"""Structured Streaming forms of the pipelines.

Sources are replayed from files; watermarks are parameters. Each job runs until the
files at hand are read and writes to the shared folder.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placelens.scratch import shared_dir
from placelens.streaming.state import ROCKS


def read_stream(spark: SparkSession, sf_dir: str, table: str, files: int = 1) -> DataFrame:
    """A table's files as a stream, a few files for each trigger."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{table}.parqu[e]t")


def events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """name, stamp (timestamp), event_id, kind, value from the events stream."""
    e = read_stream(spark, sf_dir, "events", files)
    return e.select(F.concat(F.lit("obj"), F.col("user_id").cast("string")).alias("name"), F.col("ts").cast("timestamp").alias("stamp"), "event_id", F.col("event_type").alias("kind"), "value")


def folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which stateful processors need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_to(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what there is; append and update go to Parquet, complete replaces it."""
    spark = stream.sparkSession
    out, state = folder(spark, "stream"), folder(spark, "state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, step, state: str | None = None) -> None:
    """Hand each micro-batch and its number to ``step``.

    With a ``state`` folder of the caller's, batches that ended before a restart are
    not repeated; one that broke off is, under the same number.
    """
    state = state or folder(stream.sparkSession, "state")
    query = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()


def sessions(stream: DataFrame, gap: str, watermark: str) -> DataFrame:
    """(name, start, stop, n); a gap of exactly the limit stays in the session, hence the microsecond."""
    window = F.session_window("stamp", f"{gap} 1 microsecond")
    return stream.withWatermark("stamp", watermark).groupBy("name", window).agg(F.count("*").alias("n"), F.max("stamp").alias("stop")).select("name", F.col("session_window.start").alias("start"), "stop", "n")


def matched_sets(stream: DataFrame, pivot: str, others: list[str], slack_s: int, watermark: str) -> DataFrame:
    """(name, stamp, event_id, one id for each of ``others``): for each pivot message the closest message of every other kind.

    Partners are at most the slack away, ties by id; a pivot that lacks one makes no set.
    Messages of a name stand in windows of four slacks, two slacks apart, so that each
    pivot has all of its partners in the one window whose middle half it is in. A window
    is told when the watermark has passed its end, and forgotten: the state holds the
    messages of open windows, and a busy name is spread over its windows.
    """
    micros = slack_s * 1_000_000
    w = F.window("stamp", f"{4 * slack_s} seconds", f"{2 * slack_s} seconds", f"-{slack_s} seconds")
    message = F.struct(F.unix_micros("stamp").alias("at"), "event_id", "stamp")
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, message))
    lists = stream.withWatermark("stamp", watermark).groupBy("name", w.alias("w")).agg(of(pivot).alias("_pivots"), *(of(k).alias(f"_{k}") for k in others))
    middle = lambda m: (m["at"] >= F.unix_micros("w.start") + micros) & (m["at"] < F.unix_micros("w.end") - micros)
    each = lists.withColumn("p", F.explode(F.filter("_pivots", middle)))

    def closest(kind: str) -> Column:
        gap = lambda m: F.abs(m["at"] - F.col("p.at"))
        near = F.filter(f"_{kind}", lambda m: gap(m) <= micros)
        return F.array_min(F.transform(near, lambda m: F.struct(gap(m).alias("gap"), m["event_id"].alias("event_id"))))["event_id"]

    sets = each.select("name", "p.stamp", "p.event_id", *(closest(k).alias(k) for k in others))
    return sets.dropna(subset=others)


class Batches:
    """A table in a folder that each micro-batch adds its own part to; a repeated batch replaces its part."""

    def __init__(self, spark: SparkSession, tag: str, root: str | None = None) -> None:
        self.spark, self.root = spark, root or folder(spark, tag)

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def read(self, before: int | None = None) -> DataFrame | None:
        """All parts, or those of batches before one; None where there is none."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        found = [n for n in names if n.startswith("batch=") and (before is None or int(n[6:]) < before)]
        return self.spark.read.option("basePath", self.root).parquet(*(f"{self.root}/{n}" for n in found)) if found else None

    def newest(self, by: str, before: int | None = None) -> DataFrame | None:
        """Of each key the rows of the latest batch that wrote it."""
        rows = self.read(before)
        if rows is None:
            return None
        last = rows.groupBy(by).agg(F.max("batch").alias("batch"))
        return rows.join(last, [by, "batch"], "left_semi").drop("batch")
