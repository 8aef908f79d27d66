"""Sources and sinks of observations, points, models and summaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


ROOM = "obs_id long, waypoint string, log_name string, run_no int, start_ts string, centroid string"


def write_rooms(rooms: DataFrame, root: str) -> None:
    """Room metadata as XML files below date folders (columns of ROOM, and date)."""
    rooms.repartition("date").write.partitionBy("date").format("xml").option("rowTag", "room").option("rootTag", "rooms").mode("overwrite").save(root)


def scan_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Rooms below date folders of eight digits, with date and centroid read from text."""
    raw = spark.read.format("xml").option("rowTag", "room").option("recursiveFileLookup", "true").schema(ROOM).load(root)
    date = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:date=)?(\d{8})/", 1)
    part = F.split("centroid", " ")
    return raw.withColumn("date", date).where("date <> ''").select("*", *(part[k].cast("double").alias(f"c{n}") for k, n in enumerate("xyz"))).drop("centroid")


def write_catalog(df: DataFrame, root: str) -> None:
    df.write.partitionBy("date").mode("overwrite").parquet(root)


# Fixed value: the header of a cloud file.
PCD_HEADER = "VERSION .7|FIELDS x y z rgb|SIZE 8 8 8 4|TYPE F F F U|COUNT 1 1 1 1|WIDTH {n}|HEIGHT 1|VIEWPOINT 0 0 0 1 0 0 0|POINTS {n}|DATA ascii"
#: Observations that share a folder.
FOLDER_CLOUDS = 1000


def write_pcd(points: DataFrame, root: str) -> None:
    """One PCD text file for each observation; a cloud is a file by nature. Colours are one number, red first.

    A comment in its first line names the observation. Folders hold ``FOLDER_CLOUDS``
    of them, since making and listing one for each file takes longer than its points.
    Tasks move their own files when they end (the second commit algorithm), not the driver.
    """
    colour = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    line = F.concat_ws(" ", *(F.col(k).cast("string") for k in "xyz"), colour.cast("string"))
    cloud = points.groupBy("obs_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pt_idx", line.alias("l")))), lambda e: e["l"]), "\n").alias("body"), F.count("*").alias("n"))
    head = F.replace(F.replace(F.lit(PCD_HEADER), F.lit("{n}"), F.col("n").cast("string")), F.lit("|"), F.lit("\n"))
    name = F.concat(F.lit("# obs_id="), F.coalesce(F.col("obs_id").cast("string"), F.lit("")), F.lit("\n"))
    files = cloud.select(F.floor(F.col("obs_id") / FOLDER_CLOUDS).alias("folder"), F.concat(name, head, F.lit("\n"), "body").alias("value"))
    files.write.partitionBy("folder").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("overwrite").text(root)


def unpacked(data: bytes, size: int) -> bytes:
    """Bytes of LZF data: runs as they are (control byte below 32), else copies of what came 1 to 8192 bytes before."""
    out, at = bytearray(), 0
    while at < len(data):
        control, at = data[at], at + 1
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length, at = length + data[at], at + 1
        back, at, length = (control & 31) * 256 + data[at] + 1, at + 1, length + 2
        if back > len(out):
            raise ValueError("compressed data refers to bytes before its start")
        while length > 0:  # a copy may reach into itself
            piece = out[-back:][:length]
            out += piece
            length -= len(piece)
    if len(out) != size:
        raise ValueError(f"compressed data holds {len(out)} bytes where its header says {size}")
    return bytes(out)


def parse_pcd(content: bytes) -> dict[str, np.ndarray]:
    """The columns of a PCD file, as its header names them; text, binary and compressed binary data."""
    head, at = {}, 0
    while "DATA" not in head:
        end = content.index(b"\n", at)
        key, *values = content[at:end].decode().split() or ["#"]
        head[key], at = values, end + 1
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    kinds = [{"F": "f", "I": "i", "U": "u"}[t] + s for t, s in zip(head["TYPE"], head["SIZE"])]
    row = np.dtype([(f, "<" + k, (c,)) if c > 1 else (f, "<" + k) for f, k, c in zip(head["FIELDS"], kinds, counts)])
    n = int(head["POINTS"][0])
    if head["DATA"] == ["binary"]:
        table = np.frombuffer(content, row, n, at)
        return {f: table[f] for f in row.names}
    if head["DATA"] == ["binary_compressed"]:
        packed, size = (int.from_bytes(content[k : k + 4], "little") for k in (at, at + 4))
        flat, out, k = unpacked(content[at + 8 : at + 8 + packed], size), {}, 0
        for f in row.names:  # column after column, where plain binary data goes row by row
            kind, shape = row[f].subdtype or (row[f], ())
            out[f] = np.frombuffer(flat, kind, n * (shape[0] if shape else 1), k).reshape(n, *shape)
            k += n * row[f].itemsize
        return out
    if head["DATA"] != ["ascii"]:
        raise ValueError(f"PCD data of kind {head['DATA']} is not supported")
    flat = np.array(content[at:].split(), "S32").reshape(n, -1)
    first = np.cumsum([0, *counts])
    return {f: flat[:, a].astype(row[f].base if c == 1 else "f8") for f, a, c in zip(head["FIELDS"], first, counts)}


def colours(columns: dict[str, np.ndarray]) -> np.ndarray | None:
    """Packed colours of a file, whether stored as a number or in the bits of a float."""
    packed = columns.get("rgb", columns.get("rgba"))
    if packed is None:
        return None
    return (packed.astype("<f4").view("<u4") if packed.dtype.kind == "f" else packed).astype(np.int64)


def ingest_pcd(spark: SparkSession, root: str, pattern: str = "*.{txt,pcd}") -> DataFrame:
    """points(obs_id, pt_idx, x, y, z, r, g, b) of all PCD files below a folder; one bulk job.

    A file's first line or its folder names the observation (``obs_id=``), others are of
    observation -1. Files without colours have null ones.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                obs, columns = re.match(rb"# obs_id=(-?\d+)\n", content) or re.search(r"obs_id=(-?\d+)/", path), parse_pcd(content)
                n, packed = len(columns["x"]), colours(columns)
                rgb = [pa.nulls(n, pa.int32()) if packed is None else pa.array((packed >> k & 255).astype(np.int32)) for k in (16, 8, 0)]
                xyz = [pa.array(columns[k].astype(np.float64)) for k in "xyz"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, int(obs[1]) if obs else -1)), pa.array(np.arange(1, n + 1)), *xyz, *rgb], ["obs_id", "pt_idx", *"xyzrgb"])

    return files.mapInArrow(run, "obs_id long, pt_idx long, x double, y double, z double, r int, g int, b int")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def segment_uris(df: DataFrame, root: str, path: str = "path"):
    """Absolute URIs; relative paths are below the root."""
    p = F.col(path)
    return F.when(p.startswith("file://") | p.startswith("mongodb://"), p).when(p.startswith("/"), F.concat(F.lit("file://"), p)).otherwise(F.concat(F.lit("file://" + root.rstrip("/") + "/"), p))


def log_name(df: DataFrame):
    """Name under which an observation is logged."""
    return F.concat_ws("___", "log_name", F.col("run_no").cast("string"), F.lit("room"), F.col("obs_id").cast("string"))


def parse_log_name(name: str = "name"):
    part = F.split(F.col(name), "___")
    return {"log": part[0], "run": part[1].cast("int"), "obs": part[3].cast("long")}


def reload_if_changed(spark: SparkSession, summary: DataFrame, last_updated, read):
    """``read()`` when the summary's stamp differs from the one held, else None."""
    stamp = summary.select("last_updated").first()
    return read() if stamp is not None and stamp[0] != last_updated else None


