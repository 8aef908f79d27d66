"""WARC archives of pages, and their index by an external merge of sorted capture runs.

Writing: pages with equal payloads share one response record, all others are revisits
that refer to it. Tasks pack records into archives of bounded size, which Spark
writes as files; a record is UTF-8, so the two line ends that close it are the
separator of a text sink.

Reading: each task parses the archives it is dealt, checks every payload against its
digest, and leaves its captures as one run sorted by URL key and time. Runs are cut at
splitters into ranges; each range merges the slices of all runs by a k-way loser tree.
Ranges one after another are the captures of all archives in order, each URL's
history together. A range is bounded by ``RANGE_ROWS``, also where one URL holds a
large share of all captures, as the order ends with a capture's place in its archive.

Defined results: a null payload is empty; a null url is an empty target; a null id
stands as "null" in record names. The smallest id of equal payloads is the response
(nulls count last), and so is every row that has this id; repeated rows give repeated
records. Empty tables give no archive and an empty index. Only the named columns are read.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from placelens.llm.packed import by_part
from placelens.scratch import materialize, shared_dir

#: Bytes of an archive; a longer record has one of its own.
ARCHIVE_BYTES = 16_000_000
#: Captures that a range of the merge has, up to the chance of the splitters.
RANGE_ROWS = 200_000
#: Splitter candidates of a range.
CANDIDATES = 16
#: Payload groups of more than one page up to which they are broadcast (about 60 bytes each).
BROADCAST_GROUPS = 200_000
#: Share of all pages from which a group counts as large: there are 1,000 of them at most.
LARGE = 1e-3

# What the WARC format prescribes.
END = b"\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> DataFrame:
    """(page_id, url, captured, payload, digest): captured in seconds; where the table has no time, the id stands for it."""
    when = F.unix_seconds(F.col(date_col).cast("timestamp")) if date_col else F.pmod(F.col(id_col).cast("long"), F.lit(2**31))
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(when, F.lit(0)).cast("long").alias("captured"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))


def with_first(found: DataFrame, least_bytes: int = 0, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``found`` with ``first``: the page whose payload equals this one's, null for pages that no other equals.

    Few groups are broadcast, by their number. Of many, those that hold a large share
    of all pages are broadcast (their number is bounded by the share), so that no key
    of the join that follows is a large one.
    """
    slim = found.select("page_id", "digest", F.length("payload").alias("size")).where(F.col("size") >= least_bytes)
    groups = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = materialize(groups, "payloads")
    if groups.count() <= broadcast_groups:
        return found.join(F.broadcast(groups.drop("copies")), "digest", "left")
    large = int(found.count() * LARGE)
    many = groups.where(F.col("copies") > large).select(F.col("digest").alias("key"), F.col("first").alias("of_large"))
    few = groups.where(F.col("copies") <= large).select(F.col("digest").alias("key"), F.col("first").alias("of_small"))
    found = found.join(F.broadcast(many), F.col("digest") == F.col("key"), "left").drop("key")
    # rows that have their page already get a key of their own that meets nothing
    key = F.when(F.col("of_large").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    found = found.withColumn("meets", key).join(few, F.col("meets") == F.col("key"), "left")
    return found.select("page_id", "url", "captured", "payload", "digest", F.coalesce("of_large", "of_small").alias("first"))


def urn(page: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"null" if page is None else b"%d" % page)


def page_of(name: str) -> int | None:
    page = name.rpartition(":")[2].rstrip(">")
    return None if page == "null" else int(page)


def record(page: int | None, url: str, captured: int, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record without the line ends that close it; a revisit of ``first`` has the response's headers only."""
    date = datetime.datetime.fromtimestamp(captured, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode()
    revisit = first is not None and first != page
    lines = [
        b"WARC/1.1",
        b"WARC-Type: revisit" if revisit else b"WARC-Type: response",
        b"WARC-Record-ID: " + urn(page),
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)),
    ]
    if revisit:
        lines += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + urn(first)]
    block = HTTP % len(payload) + (b"" if revisit else payload)
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + END + block


def packed(rows: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Archives of records, each one string of about ``most`` bytes that starts with a warcinfo record."""
    info = b"software: placelens\r\nformat: WARC File Format 1.1"
    start = b"\r\n".join([b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.UUID(int=0)).encode(), b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(info)]) + END + info
    held, size = [], 0

    def archive() -> pa.RecordBatch:
        text = END.join([start, *held])
        return pa.RecordBatch.from_arrays([pa.array([text], pa.binary()).cast(pa.string())], ["archive"])

    for batch in rows:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one = record(*row)
            if held and size + len(one) > most:
                yield archive()
                held, size = [], 0
            held.append(one)
            size += len(one) + len(END)
    if held:
        yield archive()


def write_archives(found: DataFrame, path: str, compression: str = "none", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records of ``found`` (of ``with_first``) as WARC files below ``path``."""
    rows = found.select("page_id", "url", "captured", "payload", "digest", "first")
    archives = rows.mapInArrow(lambda batches: packed(batches, archive_bytes), "archive string")
    archives.write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).option("compression", compression).text(path)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of each record of an archive."""
    at = 0
    while at < len(archive):
        head = archive.find(END, at)
        if head < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = archive[at:head].decode().split("\r\n")[1:]
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        start = head + len(END)
        stop = start + int(headers["content-length"])
        if archive[stop : stop + len(END)] != END:
            raise ValueError(f"the record at byte {at} does not end as its length says")
        yield headers, archive[start:stop], at, stop + len(END) - at
        at = stop + len(END)


def url_key(url: str) -> str:
    """Sort key of a url: its host's labels from the last to the first, ")", and the rest up to a fragment."""
    head, found, tail = url.partition("://")
    if not found:
        tail = "/" + url
    host = re.match(r"[^/?#]*", tail)[0]
    rest = tail[len(host) :].partition("#")[0]
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), host) if found else ""
    return ",".join(reversed(lower.split("."))) + ")" + rest


CAPTURES = pa.schema(
    [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())]
    + [("length", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
)
CAPTURE_DDL = "url_key string, captured string, page_id long, archive string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def captures_of(name: str, archive: bytes) -> Iterator[tuple]:
    """The captures of one archive; a payload that is not what its digest says is an error."""
    for headers, block, offset, length in records(archive):
        kind = headers["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        head, _, payload = block.partition(END)
        size = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{name}: the payload at byte {offset} is damaged")
        refers = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
        yield url_key(headers["warc-target-uri"]), headers["warc-date"], page_of(headers["warc-record-id"]), name, offset, length, kind, size, digest, refers


def order_of(row: tuple) -> tuple:
    """The order of captures: URL key, time, page (null first), place."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


RUN = CAPTURES.append(pa.field("run", pa.string())).append(pa.field("seq", pa.int64()))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives below ``path``, with ``run`` and ``seq``: what one task read, sorted."""

    def run(batches):
        rows = []
        for batch in batches:
            for name, archive in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = archive.as_py()
                rows += captures_of(name.rpartition("/")[2], gzip.decompress(data) if name.endswith(".gz") else data)
        rows.sort(key=order_of)
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            yield columns([(*r, rows[0][3], at + k) for k, r in enumerate(part)], RUN)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, f"{CAPTURE_DDL}, run string, seq long")


def splitters(runs: DataFrame, range_rows: int) -> list[tuple]:
    """Keys at which the captures fall into ranges of about ``range_rows``: quantiles of an evenly hashed choice, 16 a range."""
    ranges = -(-runs.count() // range_rows)
    if ranges <= 1:
        return []
    step = max(1, range_rows // CANDIDATES)
    chosen = runs.where(F.pmod(F.xxhash64("archive", "offset"), F.lit(step)) == 0).select("url_key", "captured", "page_id", "archive", "offset")
    keys = sorted(order_of(tuple(r)) for r in chosen.toLocalIterator())
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


class LoserTree:
    """Merges sorted lists: each inner node holds the list that lost there, the top holds the list that lost to none."""

    def __init__(self, lists: list[list]):
        self.lists, self.at = lists, [0] * len(lists)
        self.losers = [-1] * max(1, len(lists))
        for k in range(len(lists)):
            self._play(k)

    def _less(self, a: int, b: int) -> bool:
        """Whether list a's head comes before list b's; ended lists come last."""
        if self.at[a] >= len(self.lists[a]):
            return False
        if self.at[b] >= len(self.lists[b]):
            return True
        return self.lists[a][self.at[a]] < self.lists[b][self.at[b]]

    def _play(self, k: int) -> None:
        """List k plays its way up; while the tree fills, the first to come to a node waits there."""
        node, n = (k + len(self.lists)) // 2, len(self.lists)
        while node and n > 1:
            if self.losers[node] < 0:
                self.losers[node] = k
                return
            if self._less(self.losers[node], k):
                self.losers[node], k = k, self.losers[node]
            node //= 2
        self.losers[0] = k

    def runner_up(self) -> int:
        """The best of the lists that lost to the winner itself, which stand on its way up; -1 if there is none."""
        best, node = -1, (self.losers[0] + len(self.lists)) // 2
        while node and len(self.lists) > 1:
            if best < 0 or self._less(self.losers[node], best):
                best = self.losers[node]
            node //= 2
        return best

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(list, from, to): stretches in order."""
        while self.lists and self.at[w := self.losers[0]] < len(self.lists[w]):
            start, second = self.at[w], self.runner_up()
            stop = len(self.lists[w])
            if second >= 0 and self.at[second] < len(self.lists[second]):
                stop = max(start + 1, bisect_left(self.lists[w], self.lists[second][self.at[second]], start))
            yield w, start, stop
            self.at[w] = stop
            self._play(w)


def merged_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range, which come as slices of runs, merged."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    for part in pa.compute.unique(table.column("part")).to_pylist():
        rows = table.filter(pa.compute.equal(table.column("part"), part)).sort_by([("run", "ascending"), ("seq", "ascending")])
        names = rows.column("run").combine_chunks().dictionary_encode()
        if isinstance(names, pa.ChunkedArray):
            names = names.combine_chunks()
        code = names.indices.to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        keys = [order_of(r) for r in zip(*(rows.column(c).to_pylist() for c in CAPTURES.names[:5]), strict=True)]
        tree = LoserTree([keys[a:b] for a, b in zip(bounds, bounds[1:])])
        taken = np.concatenate([np.arange(bounds[k] + a, bounds[k] + b) for k, a, b in tree])
        out = rows.select(["part", *CAPTURES.names]).take(pa.array(taken)).append_column("place", pa.array(np.arange(len(taken))))
        yield from out.to_batches(max_chunksize=10_000)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs with ``position``, their place in the order of all captures (from 0)."""
    bounds = splitters(runs, range_rows)

    def cut(batches):
        for batch in batches:
            keys = [order_of(r) for r in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)]
            part, at = np.zeros(len(keys), np.int32), 0
            # a slice ends where its run passes a splitter; another run begins anew
            for k, key in enumerate(keys):
                if k and key < keys[k - 1]:
                    at = 0
                if at < len(bounds) and bounds[at] <= key:
                    at = bisect_left(bounds, key, at)
                    at += at < len(bounds) and bounds[at] == key
                part[k] = at
            yield batch.append_column("part", pa.array(part))

    slices = runs.mapInArrow(cut, f"{CAPTURE_DDL}, run string, seq long, part int")
    ranged = materialize(by_part(slices, len(bounds) + 1).mapInArrow(merged_range, f"part int, {CAPTURE_DDL}, place long"), "captures")
    ends, total = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):
        ends.append((part, total))
        total += n
    first = runs.sparkSession.createDataFrame(ends, "part int, before long")
    return ranged.join(F.broadcast(first), "part").withColumn("position", F.col("before") + F.col("place")).select("position", *CAPTURES.names)


def write_index(merged: DataFrame, path: str, parts: int = 1) -> None:
    """Write merged captures as text lines (key, time, JSON), files one after another in order."""
    facts = F.to_json(F.struct("record_type", "payload_digest", "payload_bytes", "archive", "offset", "length"))
    line = F.concat_ws(" ", "url_key", F.regexp_replace("captured", "[^0-9]", ""), facts)
    merged.repartitionByRange(parts, "position").sortWithinPartitions("position").select(line.alias("line")).write.text(path)


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date_col: str | None = None, compression: str = "none", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the pages' archives below ``path`` (default: the shared folder) and return it."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(with_first(captures(pages, date_col=date_col), least_bytes), path, compression, archive_bytes)
    return path


def index_of(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of the archives below ``path``, in the order of their URL keys and times."""
    return merge_runs(materialize(read_runs(spark, path), "runs"), range_rows)
