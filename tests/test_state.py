"""Stateful processors over several files, against plain Python; what their state holds."""

import collections
import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placelens.plans import streams
from placelens.streaming import jobs as J, state as K

START = dt.datetime(2024, 1, 1)
SCHEMA = "name string, stamp timestamp, event_id long, kind string, value double"


def messages(seed: int, n: int, late: float) -> list[tuple]:
    """Messages of four names, one of which (and the null name) is busy, that arrive up to ``late`` seconds out of order."""
    rng = random.Random(seed)
    rows, now = [], 0.0
    for i in range(n):
        now += rng.choice([0.0, 0.3, 1.0, 2.0, 40.0 if i % 50 == 0 else 0.5])
        kind = rng.choice(["map", "base", "ask", "ask", "open", "close", "frame", "frame"])
        rows.append((rng.choice(["a", "a", "a", None, "b", "c"]), now, i // 2 if i % 30 == 0 else i, kind, None if i % 41 == 0 else float(i % 17)))
    rows.sort(key=lambda r: r[1] + rng.uniform(0, late))
    return rows


def written(spark, tmp_path, rows: list[tuple], files: int):
    """The rows as a stream of ``files`` files in their order."""
    size = -(-len(rows) // files)
    for k in range(files):
        part = [(n, START + dt.timedelta(seconds=s) if s is not None else None, *rest) for n, s, *rest in rows[k * size : (k + 1) * size]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")


@pytest.mark.parametrize("spans", [1, 3])
def test_buffer_answers_from_its_last_seconds(spark, tmp_path, spans):
    rows = messages(5, 260, 3) + [("a", None, 1, "ask", 1.0), ("b", 1e6, 10**6, "ask", 1.0)]
    with J.rocksdb(spark):
        found = J.run_to(K.transform_buffer(written(spark, tmp_path, rows, 3), ["map", "base"], "ask", 10, spans, "4 seconds")).collect()
    want = collections.Counter()
    for name, at, number, kind, _ in rows:
        if kind != "ask" or at is None:
            continue
        own = [[r for r in rows if r[0] == name and r[3] == link and r[1] is not None and at - 10 <= r[1] <= at] for link in ("map", "base")]
        if all(own):
            last = [max(o, key=lambda r: (r[1], r[2])) for o in own]
            want[name, number, tuple(r[2] for r in last), tuple(r[4] for r in last)] += 1
    assert want and collections.Counter((r.name, r.event_id, tuple(r.poses), tuple(r["values"])) for r in found) == want


def swept(rows, positions: int, silence: float, until: float) -> set[tuple]:
    """(name, sweep, position, frames, median) of the messages up to a time."""
    out = set()
    for name in {r[0] for r in rows}:
        sweep, frames, last = 0, None, None
        for _, at, number, kind, value in sorted((r for r in rows if r[0] == name and r[1] is not None and r[1] <= until), key=lambda r: (r[1], r[2])):
            if last is not None and at - last > silence:
                frames = None
            last = at
            if kind == "open":
                frames = collections.defaultdict(list)
            elif kind == "close" and frames is not None:
                out |= {(name, sweep, p, len(v), sorted(v)[len(v) // 2]) for p, v in frames.items()}
                sweep, frames = sweep + 1, None
            elif frames is not None and value is not None:
                frames[number % positions].append(value)
    return out


def test_sweeps_do_not_depend_on_batches(spark, tmp_path):
    rows = [r for r in messages(6, 240, 3) if r[3] in ("open", "close", "frame")]
    stream = written(spark, tmp_path, rows, 3)
    with J.rocksdb(spark):
        found = J.run_to(K.assembled(stream, "open", "close", 3, "4 seconds", 30)).collect()
    want = swept(rows, 3, 30, max(r[1] for r in rows) - 4)
    assert want and {tuple(r) for r in found} == want and len(found) == len(want)
    assert swept(rows, 3, 1e9, 1e9) != want  # silence and the watermark both matter


def test_names_share_a_bucket(spark, tmp_path):
    """All names in one key, whose state serves them together, as each alone."""
    rows = [r for r in messages(7, 240, 3) if r[3] in ("open", "close", "frame")]
    with J.rocksdb(spark):
        found = J.run_to(K.assembled(written(spark, tmp_path, rows, 3), "open", "close", 3, "4 seconds", 30, buckets=1)).collect()
    want = swept(rows, 3, 30, max(r[1] for r in rows) - 4)
    assert len({w[0] for w in want}) > 1 and {tuple(r) for r in found} == want and len(found) == len(want)


def test_buffer_forgets(spark, tmp_path):
    """The state holds the messages of spans that the watermark has not passed, however long the stream."""
    rows = [("a", float(k), k, ("map", "base", "ask")[k % 3], 1.0) for k in range(1200)]
    stream = K.transform_buffer(written(spark, tmp_path, rows, 4), ["map", "base"], "ask", 10, 2, "5 seconds")
    state, out = J.folder(spark, "state"), J.folder(spark, "out")
    with J.rocksdb(spark):
        query = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out)
        query.awaitTermination()
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    # 300 s arrive with each file, of which at most a span, the watermark's delay and a buffer stay behind it
    told = spark.read.parquet(out).agg(F.max("event_id")).first()[0]
    assert told > 1150 and kept[-1] < 100, kept


def test_lookups_of_many_keys_are_answered_together(spark):
    """One call answers a batch of 3,000 keys (a call, and state, for each key took most of the time), as plain loops do."""
    rng = random.Random(8)
    lists = [[{"link": rng.choice([-1, 0, 1]), "at": rng.randrange(40), "event_id": 100 * k + n, "value": rng.choice([None, 1.0, 2.5])} for n in range(rng.randrange(9))] for k in range(3000)]
    kind = pa.list_(pa.struct([("link", pa.int32()), ("at", pa.int64()), ("event_id", pa.int64()), ("value", pa.float64())]))
    names = [None if k % 7 == 0 else f"n{k}" for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array(lists, kind)], ["name", "messages"])
    (found,) = K.answered(2, 10)(iter([batch]))
    want = set()
    for name, messages in zip(names, lists):
        for a in (m for m in messages if m["link"] < 0):
            own = [[m for m in messages if m["link"] == n and a["at"] - 10 <= m["at"] <= a["at"]] for n in (0, 1)]
            if all(own):
                last = [max(o, key=lambda m: (m["at"], m["event_id"])) for o in own]
                want.add((name, a["event_id"], tuple(m["event_id"] for m in last), tuple(m["value"] for m in last)))
    got = [(r["name"], r["event_id"], tuple(r["poses"]), tuple(r["values"])) for r in found.to_pylist()]
    assert len(want) > 100 and len(got) == len(want) and set(got) == want
    empty = batch.slice(0, 0)
    assert next(K.answered(2, 10)(iter([empty]))).num_rows == 0 and np.array_equal(next(K.answered(2, 10)(iter([batch.slice(900, 1200)])))["event_id"], [r[1] for r in got if 90000 <= r[1] < 210000])


def thirds(spark, sf, tmp_path) -> str:
    """The events in three files that all reach over the whole time."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", [streams.t2, streams.t6, streams.t7])
def test_files_that_overlap_in_time_are_not_late(spark, sf, tmp_path, query):
    want, got = (sorted(map(tuple, query(spark, d).collect())) for d in (sf, thirds(spark, sf, tmp_path)))
    assert want and got == want
