"""Scans and sinks (group SC): text tables, archives, recordings, Parquet, inventories."""

from __future__ import annotations

import hashlib
import io
import itertools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import ContractError, require_columns

#: Characters of members, or bytes of records, that a task holds at a time, about.
PIECE = 1 << 22


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); in local mode a temporary one if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    jvm = spark.sparkContext._jvm
    uri = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    parent = jvm.org.apache.hadoop.fs.Path(uri)
    store = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(parent)
    store.deleteOnExit(parent)
    return f"{uri}/data"


def cut(df: DataFrame) -> DataFrame:
    """The table, written once to the shared folder: cuts its lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_bytes(uri: str, content: bytes) -> None:
    """Write a file from a task, under a temporary name first, so that a repeated task leaves the same."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        out.write(content)
    store.move(temporary, path)


def read_task_tables(spark: SparkSession, path: str, schema: str, id_pattern: str = r"([0-9]+)[^/]*$", drop: Sequence[str] = ()) -> DataFrame:
    """SC1: tab-separated files with a header and ``#`` comments, typed by the schema; ``file_id`` from the file's name."""
    out = spark.read.csv(path, sep="\t", comment="#", header=True, schema=schema)
    return out.withColumn("file_id", F.regexp_extract(F.input_file_name(), id_pattern, 1).try_cast("int")).drop(*drop)


def read_zip_members(spark: SparkSession, path: str, extensions: Sequence[str]) -> DataFrame:
    """SC2: rows (archive, member, text, status) for the members with these endings; a broken archive gives one error row.

    Spark lists the archives; a task opens its own and reads member by member, so memory follows the largest member.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for p in part["path"]:
                rows, size = [], 0
                try:
                    with open_file(p) as source, zipfile.ZipFile(source) as z:
                        names = sorted(n for n in z.namelist() if n.lower().endswith(tuple(extensions)))
                        for n in names:
                            rows.append((p, n, z.read(n).decode("utf-8", "replace"), "ok"))
                            size += len(rows[-1][2])
                            if size > PIECE:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, size = [], 0
                        if not names:
                            rows.append((p, None, None, "no_member"))
                except (zipfile.BadZipFile, OSError, RuntimeError, ValueError) as e:
                    kind = "BadZipFile" if isinstance(e, ValueError) else type(e).__name__  # a seek before the start of a short file
                    rows.append((p, None, None, f"error: {kind}"))
                yield pd.DataFrame(rows, columns=columns)

    columns = ["archive", "member", "text", "status"]
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(run, "archive string, member string, text string, status string")


def open_file(uri: str):
    """A file for reading in a task, with seek."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    return store.open_input_file(path)


def recording_header(source) -> tuple[int, int, float, dict[str, list[str]]]:
    """(bytes of the header, records or -1, seconds a record, the signals' fields) of a recording with a fixed-width header."""
    text = lambda raw: raw.decode("ascii", "replace").strip()
    head = source.read(256)
    header, records, seconds, signals = int(text(head[184:192])), int(text(head[236:244])), float(text(head[244:252])), int(text(head[252:256]))
    fields = source.read(256 * signals)
    at, columns = 0, {}
    #: Names and widths of the per-signal fields, in file order.
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("count", 8), ("reserved", 32)):
        columns[name] = [text(fields[at + k * width : at + (k + 1) * width]) for k in range(signals)]
        at += signals * width
    return header, records, seconds, columns


def recording_chunks(source, chunk_seconds: float) -> Iterator[tuple[str, str, float, int, float, np.ndarray]]:
    """(label, unit, rate, chunk, start, samples) of every signal, a few interleaved 16-bit records at a time."""
    header, records, seconds, columns = recording_header(source)
    counts = [int(x) for x in columns["count"]]
    rates = [n / seconds for n in counts]
    sizes = [max(1, round(r * chunk_seconds)) for r in rates]
    width, starts = 2 * sum(counts), np.concatenate([[0], np.cumsum(counts)])
    scale = [[float(columns[x][k]) for x in ("pmin", "pmax", "dmin", "dmax")] for k in range(len(counts))]
    source.seek(header)
    held: list[list[np.ndarray]] = [[] for _ in counts]
    done, left = [0] * len(counts), records if records >= 0 else 1 << 62
    step = max(1, -(-round(chunk_seconds / seconds) // 1), PIECE // max(width, 1))
    while left > 0:
        raw = source.read(width * min(step, left))
        table = np.frombuffer(raw[: len(raw) // width * width], "<i2").reshape(-1, sum(counts)) if width else np.zeros((0, 0), "<i2")
        left -= len(table)
        if not len(table):
            break
        for k, n in enumerate(sizes):
            pmin, pmax, dmin, dmax = scale[k]
            values = np.concatenate([*held[k], (table[:, starts[k] : starts[k + 1]].ravel().astype(float) - dmin) * (pmax - pmin) / (dmax - dmin) + pmin])
            whole = len(values) // n * n
            for at in range(0, whole, n):
                yield columns["label"][k], columns["unit"][k], rates[k], done[k] // n, done[k] / rates[k], values[at : at + n]
                done[k] += n
            held[k] = [values[whole:]]
    for k, n in enumerate(sizes):
        rest = np.concatenate([*held[k], np.zeros(0)])
        if len(rest):
            yield columns["label"][k], columns["unit"][k], rates[k], done[k] // n, done[k] / rates[k], rest


def read_recordings(spark: SparkSession, path: str, chunk_seconds: float = 10.0) -> DataFrame:
    """SC3: rows (recording, channel, unit, fs, chunk, t0, samples).

    Spark lists the files; a task opens its own and decodes a few records at a time, so memory doesn't follow a file's
    size. A last chunk that isn't whole is kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for p in part["path"]:
                with open_file(p) as source:
                    chunks = recording_chunks(source, chunk_seconds)
                    while rows := [(p, *c) for c in itertools.islice(chunks, 64)]:
                        yield pd.DataFrame(rows, columns=["recording", "channel", "unit", "fs", "chunk", "t0", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(run, "recording string, channel string, unit string, fs double, chunk bigint, t0 double, samples array<double>")


def read_table(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """SC4: a Parquet scan of the required columns only."""
    return require_columns(spark.read.parquet(path), required).select(*required)


def read_csv_checked(spark: SparkSession, path: str, required: Sequence[str], schema: str | None = None) -> DataFrame:
    """SC5: a CSV scan with a header; all text unless a schema is given."""
    return require_columns(spark.read.csv(path, header=True, schema=schema), required)


def file_inventory(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """SC6: one row per file: relative path, size, modification time, SHA-256 of the content, and ``unchanged``.

    Content is never a column: a task reads a file in ranges of a few MB into a running digest, so files of any size take the same memory.
    A file whose read bytes differ from its listed size (it grew or shrank meanwhile) is marked as changed. Spark lists no empty files.
    """

    def digest(batches):
        for part in batches:
            found = []
            for uri, length in zip(part["path"], part["length"], strict=True):
                whole, n = hashlib.sha256(), 0
                with open_file(uri) as stream:
                    while piece := stream.read(PIECE):
                        whole.update(piece)
                        n += len(piece)
                found.append((whole.hexdigest(), n == length))
            yield part.assign(sha256=[f[0] for f in found], unchanged=[f[1] for f in found])

    # Without the column of contents Spark lists the files only.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    hashed = files.mapInPandas(digest, "path string, length bigint, modificationTime timestamp, sha256 string, unchanged boolean")
    relative = F.regexp_replace("path", "^.*?" + root.replace("\\", "\\\\"), "") if root else F.col("path")
    return hashed.select(relative.alias("relative_path"), "length", "modificationTime", "sha256", "unchanged")


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> None:
    """SC7: Parquet with zstd and a fixed order of columns."""
    out = require_columns(df, columns).select(*columns) if columns else df
    out.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def combine_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """SC8: shards as one table, if all have the same columns and types."""
    shapes = {p: [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(p).schema] for p in paths}
    first = next(iter(shapes.values()))
    odd = [p for p, s in shapes.items() if s != first]
    if odd:
        raise ContractError(f"shards of another schema: {odd}")
    return spark.read.parquet(*paths)


def write_csv(df: DataFrame, path: str) -> None:
    """SC9: CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def dim(spark: SparkSession, path: str, schema: str | None = None, max_rows: int = 100_000) -> DataFrame:
    """SC10: a small dimension from CSV, marked for broadcast; larger ones are refused."""
    out = spark.read.csv(path, header=True, schema=schema)
    if out.limit(max_rows + 1).count() > max_rows:
        raise ContractError(f"{path} has more than {max_rows} rows")
    return F.broadcast(out)


def write_recording(path: str, channels: Mapping[str, tuple[float, np.ndarray]], unit: str = "uV") -> None:
    """A small recording in the layout that SC3 reads (one-second records); for tests and examples."""
    names = list(channels)
    rates = [int(channels[n][0]) for n in names]
    seconds = min(len(channels[n][1]) // r for n, r in zip(names, rates, strict=True))
    pad = lambda s, w: str(s)[:w].ljust(w).encode()
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("01.01.24", 8) + pad("00.00.00", 8) + pad(256 * (len(names) + 1), 8) + pad("", 44) + pad(seconds, 8) + pad(1, 8) + pad(len(names), 4)
    peak = {n: max(1.0, float(np.ceil(np.abs(channels[n][1]).max()))) for n in names}
    fields = [(names, 16), ([""] * len(names), 80), ([unit] * len(names), 8), ([-peak[n] for n in names], 8), ([peak[n] for n in names], 8), ([-32767] * len(names), 8), ([32767] * len(names), 8), ([""] * len(names), 80), (rates, 8), ([""] * len(names), 32)]
    body = b"".join(pad(v, w) for values, w in fields for v in values)
    rows = [np.concatenate([np.rint(channels[n][1][s * r : (s + 1) * r] / peak[n] * 32767).astype("<i2") for n, r in zip(names, rates, strict=True)]).tobytes() for s in range(seconds)]
    with open(path, "wb") as f:
        f.write(head + body + b"".join(rows))
