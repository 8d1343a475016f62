"""Sorted hash arrays in the shared folder, memory-mapped by workers.

A table maps a 64-bit key to a row of numbers. Spark ranges the keys into shards; the task that holds a shard sorts
it and writes two plain files, keys and values. A worker maps the files: in place where the shared folder is
mounted, else from a copy in the host's temporary folder, one for all workers of the application there, which goes when one of them turns to
another table; other applications' copies are left alone. Maps hold no file open, and a worker keeps a bounded number of them. Nothing passes through the driver but the shards' sizes. Files are written under a temporary name and renamed, so a repeated task leaves the same result.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Attempts to copy a file that vanishes; shards that a worker keeps mapped.
TRIES, OPEN_SHARDS = 5, 2_000


def _mounted(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put_file(uri: str, data: np.ndarray) -> None:
    path = _mounted(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        data.tofile(temporary)
        os.replace(temporary, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as out:
        out.write(memoryview(np.ascontiguousarray(data)).cast("B"))
    store.move(temporary, path)


def _own(uri: str) -> tuple[str, str]:
    """(application's folder, table) that a path in the shared folder names; the path itself twice where it is another."""
    own = re.search(r"(epochlake-[^/]+)/([^/]+)", uri)
    return (own[1], own[2]) if own else (uri, uri)


def _copies(uri: str) -> str:
    """Where this application's copies lie on the host."""
    return os.path.join(tempfile.gettempdir(), "epochlake-copies", hashlib.sha256(_own(uri)[0].encode()).hexdigest()[:24])


def _copy_folder(uri: str) -> str:
    """Where copies of the files of one table lie."""
    return os.path.join(_copies(uri), hashlib.sha256(_own(uri)[1].encode()).hexdigest()[:24])


def _copied(uri: str) -> str:
    """Path of the host's copy of a file. A worker that has turned to another table may clear the folder meanwhile; then it is copied again."""
    from pyarrow import fs

    path = os.path.join(_copy_folder(uri), hashlib.sha256(uri.encode()).hexdigest()[:32])
    store, remote = fs.FileSystem.from_uri(uri)
    for attempt in range(TRIES):
        if os.path.exists(path):
            return path
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False) as local, store.open_input_stream(remote) as source:
                shutil.copyfileobj(source, local, 1 << 20)
            os.replace(local.name, path)
        except FileNotFoundError:
            if attempt == TRIES - 1:
                raise
    return path


def map_file(uri: str, dtype: str) -> np.ndarray:
    for attempt in range(TRIES):
        try:
            with open(_mounted(uri) or _copied(uri), "rb") as f:
                if not os.fstat(f.fileno()).st_size:
                    return np.zeros(0, dtype)
                # The map lives without the descriptor.
                return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), dtype)
        except FileNotFoundError:
            if _mounted(uri) or attempt == TRIES - 1:
                raise
    raise FileNotFoundError(uri)


def mix(key: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them evenly."""
    key = key.astype(np.uint64)
    for _ in range(2):
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(32))


#: The five primes of XXH64.
PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def xxhash_long(key: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of 64-bit numbers: a bijection, so tables keyed by it hold no false hits."""
    p1, p2, p3, p4, p5 = PRIMES
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = np.full(len(key), seed, np.uint64) + p5 + np.uint64(8)
        h ^= turned(key.astype(np.uint64) * p2, 31) * p1
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def lead_bits(shards: int) -> int:
    """How many leading bits of a key decide its shard; at least 16, at most 31."""
    return min(31, max(16, (shards - 1).bit_length()))


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the key's leading bits: shard numbers follow the order of keys."""
    bits = lead_bits(shards)
    return ((key >> np.uint64(64 - bits)) * np.uint64(shards) >> np.uint64(bits)).astype(np.int32)


def write_table(df: DataFrame, uri: str, shards: int, width: int) -> None:
    """Write rows (key bigint read as unsigned, v array<float> of ``width``) as sorted shards.

    The keys are expected to be spread evenly (``mix``); a shard's rows are held by one task.
    """
    bits = lead_bits(shards)
    number = F.shiftrightunsigned(F.shiftrightunsigned("key", 64 - bits) * F.lit(shards).cast("bigint"), bits).cast("int")
    dealt = df.select(number.alias("shard"), "key", "v").repartition(shards, "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        shard = np.concatenate([b.column(0).to_numpy() for b in parts])
        key = np.concatenate([b.column(1).to_numpy() for b in parts]).view(np.uint64)
        v = np.concatenate([b.column(2).flatten().to_numpy() for b in parts]).astype(np.float32).reshape(-1, width)
        for s in np.unique(shard).tolist():
            own = np.flatnonzero(shard == s)
            own = own[np.argsort(key[own], kind="stable")]
            put_file(f"{uri}/{s:06d}.key", key[own])
            put_file(f"{uri}/{s:06d}.val", v[own])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "n": pa.array([len(own)], pa.int64())})

    written = {r["shard"]: r["n"] for r in dealt.mapInArrow(run, "shard int, n bigint").collect()}
    empty = [s for s in range(shards) if s not in written]
    for s in empty:
        put_file(f"{uri}/{s:06d}.key", np.zeros(0, np.uint64))
        put_file(f"{uri}/{s:06d}.val", np.zeros(0, np.float32))


class HashTable:
    """Read side of ``write_table``; maps a shard when a key first falls into it."""

    def __init__(self, uri: str, shards: int, width: int, dtype: str = "<f4"):
        self.uri, self.shards, self.width, self.dtype = uri, shards, width, dtype
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shard(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        if s not in self.open:
            if len(self.open) >= OPEN_SHARDS:
                del self.open[next(iter(self.open))]  # the one mapped first
            self.open[s] = (map_file(f"{self.uri}/{s:06d}.key", "<u8"), map_file(f"{self.uri}/{s:06d}.val", self.dtype).reshape(-1, self.width))
        return self.open[s]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values) for each key; values of absent keys are 0."""
        found, out = np.zeros(len(key), bool), np.zeros((len(key), self.width), self.dtype)
        if self.shards == 1:
            self._find(0, key, slice(None), found, out)
            return found, out
        number = shard_of(key, self.shards)
        order = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(bounds)).tolist():
            at = order[bounds[s] : bounds[s + 1]]
            self._find(s, key[at], at, found, out)
        return found, out

    def _find(self, s: int, key: np.ndarray, at: np.ndarray | slice, found: np.ndarray, out: np.ndarray) -> None:
        keys, values = self.shard(s)
        if len(keys):
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[where] == key
            found[at] = hit
            out[at] = np.where(hit[:, None], values[where], 0)


def worker_cache(name: str, build: Callable):
    """One object per Python worker under a name; older ones are dropped, and so are copies of files that they mapped."""
    if _CACHE.get("name") != name:
        if _CACHE and _own(_CACHE["name"])[1] != _own(name)[1]:
            shutil.rmtree(_copy_folder(_CACHE["name"]), ignore_errors=True)  # what other workers have mapped stays readable to them
        _CACHE.clear()
        _CACHE.update(name=name, value=build())
    return _CACHE["value"]


_CACHE: dict = {}
