"""Streams with state that forget what no answer can need any more: by windows, or by a stateful processor's timers.

Both wait for the watermark before they answer, so that the order and the batches in
which messages arrive do not change a row. State lives in RocksDB, below the query's
checkpoint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _joined(batches, columns: list[str]) -> pd.DataFrame:
    return pd.concat([b[columns] for b in batches], ignore_index=True)


ANSWER = "name string, event_id long, poses array<long>, values array<double>"


def answered(links: int, keep: int):
    """Kernel over rows (name, messages): for each lookup the latest pose of every link that is at most ``keep`` older, ties by the larger id."""

    def run(batches):
        for batch in batches:
            lists = batch.column("messages")
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            each = lists.flatten()
            link, at, number = (each.field(c).to_numpy() for c in ("link", "at", "event_id"))
            value = each.field("value").to_numpy(zero_copy_only=False)
            missing = each.field("value").is_null().to_numpy(zero_copy_only=False)
            asked = np.flatnonzero(link < 0)
            found, known = [], np.ones(len(asked), bool)
            for n in range(links):
                # poses and lookups in order of time, poses first: a lookup's pose is the last one before it
                own = np.concatenate([np.flatnonzero(link == n), asked])
                poses = len(own) - len(asked)
                order = np.lexsort((np.where(missing, -np.inf, value)[own], number[own], np.arange(len(own)) >= poses, at[own], row[own]))
                last = np.empty(len(own), np.int64)
                last[order] = np.maximum.accumulate(np.where(order < poses, np.arange(len(own)), -1))
                last = last[poses:]
                pose = own[order[np.maximum(last, 0)]]
                known &= (last >= 0) & (row[pose] == row[asked]) & (at[pose] >= at[asked] - keep)
                found.append(pose)
            pose = np.stack([f[known] for f in found], axis=1).ravel()
            starts = pa.array(np.arange(0, len(pose) + 1, links, dtype=np.int32))
            ids, values = pa.array(number[pose]), pa.array(value[pose], pa.float64(), mask=missing[pose])
            columns = [batch.column("name").take(pa.array(row[asked[known]])), pa.array(number[asked[known]]), pa.ListArray.from_arrays(starts, ids), pa.ListArray.from_arrays(starts, values)]
            yield pa.RecordBatch.from_arrays(columns, ["name", "event_id", "poses", "values"])

    return run


def transform_buffer(stream: DataFrame, links: list[str], lookup: str, keep_s: int = 10, spans: int = 64, watermark: str = "10 seconds") -> DataFrame:
    """(name, event_id, poses, values): each lookup's latest pose of every link, from a buffer of ``keep_s`` seconds.

    ``stream`` has name, stamp, event_id, kind and value; ``links`` name the kinds that
    a chain of transforms is made of, from the root on. A lookup that misses a link has
    no answer; other kinds, and messages without a stamp or an id, are ignored. Time is cut into spans of
    ``spans`` buffers, whose windows begin one buffer earlier, so that a pose stands in the next span too if it is
    still in the buffer there: a busy name is thus spread over its spans, a key holds the messages
    of one span, and all of them are forgotten when the watermark passes its end. Keys are many and small,
    so their lists are kept by Spark's aggregation, and lookups of a whole batch of keys are answered together.
    """
    keep = keep_s * 1_000_000
    span = keep * spans
    kind = F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(links)), F.when(F.col("kind") == lookup, -1))
    rows = stream.withColumns({"link": kind, "at": F.unix_micros("stamp")}).where("link is not null and at is not null and event_id is not null").withWatermark("stamp", watermark)
    w = F.window("stamp", f"{span + keep} microseconds", f"{span} microseconds", f"-{keep % span} microseconds")
    placed = rows.select("name", w.alias("w"), F.struct("link", "at", "event_id", F.col("value").cast("double").alias("value")).alias("m"))
    due = placed.where((F.col("m.link") >= 0) | (F.col("m.at") >= F.unix_micros("w.start") + keep))
    lists = due.groupBy("name", "w").agg(F.collect_list("m").alias("messages")).select("name", "messages")
    return lists.mapInArrow(answered(len(links), keep), ANSWER)


class SweepAssembly(StatefulProcessor):
    """Messages of a bucket of names, each in order of time: what waits for the watermark; of each name its open sweep's frames and its number.

    Calls for state cost more than the messages of one name, so a bucket's wait in one
    list, and only names that have a message due, or fall silent, are written anew.
    """

    WAITING = "name string, at long, event_id long, kind int, value double"
    NAME = "name string"
    OPEN = "sweep int, opened boolean, last long, positions array<int>, values array<double>"
    ROWS = "name string, sweep int, position int, frames int, median double"
    START, STOP, FRAME = 0, 1, 2

    def __init__(self, positions: int, silence: int) -> None:
        self.positions, self.silence = positions, silence
        self.now, self.told = None, set()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.sweeps = handle.getMapState("sweeps", self.NAME, self.OPEN)

    def handleInputRows(self, key, rows, timerValues):
        new = _joined(rows, ["name", "at", "event_id", "kind", "value"])
        columns = (new[c].tolist() for c in ("name", "at", "event_id", "kind", "value"))
        self.waiting.appendList([(n, t, e, k, None if v != v else v) for n, t, e, k, v in zip(*columns)])
        self.handle.registerTimer(int(new["at"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if now != self.now:
            self.now, self.told = now, set()
        if key in self.told:  # one of the bucket's timers has done all that is due at this watermark
            return
        self.told.add(key)
        due, later, out, silent = {}, [], [], []
        for name, at, number, kind, value in self.waiting.get():
            if at <= now:
                due.setdefault(name, []).append((at, number, kind, value))
            else:
                later.append((name, at, number, kind, value))
        held = {k[0]: tuple(v) for k, v in self.sweeps.iterator()}
        for name in due.keys() | {n for n, (_, opened, last, *_) in held.items() if opened and now - last > self.silence}:
            before = held.get(name)
            after, found = self.moved(name, before or (0, False, 0, [], []), sorted(due.get(name, ()), key=lambda m: (m[:3], m[3] is not None, m[3])), now)
            out += found
            if after == (0, False, 0, [], []):
                if before:
                    self.sweeps.removeKey((name,))
            elif after != before:
                self.sweeps.updateValue((name,), after)
            held[name] = after
        self.waiting.clear()
        if later:
            self.waiting.appendList(later)
            self.handle.registerTimer(min(at for _, at, *_ in later) // 1000 + 1)
        lasts = [last for _, opened, last, *_ in held.values() if opened]
        if lasts:
            self.handle.registerTimer((min(lasts) + self.silence) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["name", "sweep", "position", "frames", "median"])

    def moved(self, name, state: tuple, due: list[tuple], now: int) -> tuple[tuple, list[tuple]]:
        """State of a name after its messages that are due, and rows of the sweeps that they finish."""
        sweep, opened, last, places, values = state
        frames, out = {}, []
        for place, value in zip(places, values):
            frames.setdefault(place, []).append(value)
        for at, number, kind, value in due:
            if opened and at - last > self.silence:
                opened, frames = False, {}
            if kind == self.START:
                opened, frames = True, {}
            elif kind == self.STOP and opened:
                out += [(name, sweep, p, len(v), sorted(v)[len(v) // 2]) for p, v in sorted(frames.items())]
                sweep, opened, frames = sweep + 1, False, {}
            elif kind == self.FRAME and opened and value is not None:
                frames.setdefault(number % self.positions, []).append(value)
            last = at
        if not opened or now - last > self.silence:
            return (sweep, False, 0, [], []), out
        return (sweep, True, last, [p for p, v in frames.items() for _ in v], [x for v in frames.values() for x in v]), out


def assembled(stream: DataFrame, start: str, stop: str, positions: int, watermark: str, silence_s: int = 86_400, buckets: int = 4096) -> DataFrame:
    """Rows for each position of each finished sweep of a name: its frames between the start and stop messages, and their upper median.

    A message's position is its event_id modulo ``positions``; frames without a value,
    and messages without a stamp or an id, are ignored. A start while a sweep is open
    begins it anew, a stop without a start is ignored, and a sweep is given up when a
    name is silent for longer than ``silence_s``: a timer then forgets its frames. The
    state of a name holds the messages that the watermark has not passed, and the open
    sweep's frames. Names are dealt to ``buckets`` keys by their hash: a call for state serves all names of
    one, and a bucket must fit a task, as a name must.
    """
    kind = F.when(F.col("kind") == start, SweepAssembly.START).when(F.col("kind") == stop, SweepAssembly.STOP).otherwise(SweepAssembly.FRAME)
    rows = stream.where("stamp is not null and event_id is not null").withWatermark("stamp", watermark)
    bucket = F.pmod(F.xxhash64("name"), F.lit(buckets)).alias("bucket")
    keyed = rows.select(bucket, "name", "stamp", F.unix_micros("stamp").alias("at"), "event_id", kind.alias("kind"), F.col("value").cast("double").alias("value"))
    return keyed.groupBy("bucket").transformWithStateInPandas(SweepAssembly(positions, silence_s * 1_000_000), SweepAssembly.ROWS, "append", "eventTime")
