"""Links between texts of a Jaccard similarity of shingle sets, all of them and no others.

* a task writes its texts' sets (sorted 64-bit shingle hashes) to a file in the shared folder, each after a sketch; a
  row keeps the set's fingerprint and where they stand. Equal sets are one class, linked to others once.
* ``close_links``: the grid of ``simhash`` over the fingerprints holds every pair within its radius, without loss. Pairs
  are checked by the embedding, by the fingerprints, then exactly by the sets.
* ``far_links``: the pairs beyond the radius, and only those, come from a prefix join. In any order of all hashes, of two sets that are similar enough the first n - ceil(s * n) + 1 members of both
  meet, so a cell per such member holds every pair that links, without loss. The order is: hashes that at most
  ``FREQUENT`` sets have before the others, then by the hash. So a line or passage that many texts share makes no cells
  where a text has enough of its own. Tasks and Spark count the lower hashes of all sets; those that stand in several sets
  are written as sorted hash arrays that workers map, and only they make cells. What isn't counted is taken for rare
  and shared, which costs time, not links.
* within such a cell the sizes are compared first, then the sketches: a sketch has a bit per ``BITS`` residues that says
  whether an odd number of hashes fall on it, so two sketches never differ in more bits than the sets in hashes. What is
  left is compared exactly.
* pairs already joined, by fingerprints or in the task, are not looked at, and a task reports a spanning forest.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_path, partitions_of, small_batches
from .hash_arrays import HashTable, put_file, worker_cache, write_table

#: Bits of a sketch; sets and open files that a task keeps.
BITS, KEPT_SETS, OPEN_FILES = 256, 5_000, 200
#: Rows of cells that a task compares, about.
TASK_ROWS = 200_000
LANES = BITS // 64
#: What is known of a class: its node, where its set stands, its fingerprint, its component by what was found before.
PLACED = ("node", "file", "at", "n", "fp", "known")
#: Share of all hashes that is counted: those below the bound.
COUNTED_SHARE = 0.4
COUNTED = np.uint64(int(COUNTED_SHARE * 2**64))
#: Sets that a hash may stand in before it comes last in the order.
FREQUENT = 100
#: Hashes that a task counts together; shared hashes per shard of their table.
FLUSH, SHARD_ROWS = 1_000_000, 2_000_000


def sketch(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def prefix(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def write_sets(df: DataFrame, id_col: str, text: str, words: int, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Rows (id, node, fp, file, at, n) and the columns of ``keep``, one per row of ``df``, and the folder of the sets."""
    from .simhash import shingle_hashes, signs

    small_batches(df.sparkSession)
    uri = fresh_path(df.sparkSession, "shingle-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            file, parts, rows, at = uuid.uuid4().int >> 65, [], [], 0
            for t in batch.column(1):
                own = np.unique(shingle_hashes(t.as_py(), words))
                parts += [sketch(own), own]
                rows.append((xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63), signs(own), at, len(own)))
                at += LANES + len(own)
            put_file(f"{uri}/{file:016x}", np.concatenate(parts))
            node, fp, place, n = zip(*rows, strict=True)
            made = pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (node, fp, [file] * len(node), place, n))], names=["id", "node", "fp", "file", "at", "n"])
            yield pa.RecordBatch.from_arrays([*made.columns, *batch.columns[2:]], names=[*made.schema.names, *keep])

    keep = keep or []
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"), *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema[2:])
    return source.mapInArrow(run, f"id bigint, node bigint, fp bigint, file bigint, at bigint, n bigint{kept}"), uri


class Sets:
    """Reads sketches and sets where they stand; holds a bounded number."""

    def __init__(self, uri: str):
        self.uri, self.open, self.kept = uri, {}, {}
        parts = urlparse(uri)
        self.path = parts.path if parts.scheme in ("", "file") else None

    def read(self, file: int, at: int, n: int) -> np.ndarray:
        if file not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.close()
            if self.path is not None:
                self.open[file] = os.open(f"{self.path}/{file:016x}", os.O_RDONLY)
            else:
                from pyarrow import fs

                store, path = fs.FileSystem.from_uri(f"{self.uri}/{file:016x}")
                self.open[file] = store.open_input_file(path)
        source = self.open[file]
        return np.frombuffer(os.pread(source, 8 * n, 8 * at) if self.path is not None else source.read_at(8 * n, 8 * at), "<u8")

    def close(self) -> None:
        for source in self.open.values():
            os.close(source) if self.path is not None else source.close()
        self.open.clear()

    def hashes(self, file: int, at: int, n: int) -> np.ndarray:
        if (file, at) not in self.kept:
            if len(self.kept) >= KEPT_SETS:
                self.kept.clear()
            self.kept[file, at] = self.read(file, at + LANES, n)
        return self.kept[file, at]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def root(parent: np.ndarray, x: int) -> int:
    while (up := int(parent[x])) != x:
        x = up
    return x


def forest(key: np.ndarray, member: np.ndarray, place: np.ndarray, sets: Sets, similarity: float, known: np.ndarray, may_link: Callable) -> np.ndarray:
    """For each place (file, at, n) the one it is joined to by links inside cells; rows are sorted by key.

    Places of the same ``known`` component are joined from the start. Only pairs that ``may_link`` are compared.
    """
    _, first, group = np.unique(known, return_index=True, return_inverse=True)
    parent, failed = first[group], set()
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(heads, len(key)))
    end = np.repeat(heads + sizes, sizes)
    n, live, d = place[:, 2], np.arange(len(key)), 1
    while len(live := live[end[live] > live + d]):
        for first in range(0, len(live), 1_000_000):
            rows, joined = live[first : first + 1_000_000], False
            a, b = member[rows], member[rows + d]
            open_ = parent[a] != parent[b]
            a, b = a[open_], b[open_]
            fits = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9
            a, b = a[fits], b[fits]
            fits = may_link(a, b)
            for x, y in np.unique(np.stack([np.minimum(a, b)[fits], np.maximum(a, b)[fits]], axis=1), axis=0).tolist():
                rx, ry = root(parent, x), root(parent, y)
                if rx == ry or (x, y) in failed:
                    continue
                shared = common(sets.hashes(*place[x].tolist()), sets.hashes(*place[y].tolist()))
                if shared >= similarity * (n[x] + n[y] - shared) - 1e-9:
                    parent[max(rx, ry)] = min(rx, ry)
                    joined = True
                else:
                    failed.add((x, y))
            while joined and not (parent == (up := parent[parent])).all():
                parent[:] = up
        d += 1
    return parent


def low_hashes(sets: Sets, file: int, at: int, n: int) -> np.ndarray:
    """The hashes of a set below ``COUNTED``, which is the same bound for all sets."""
    likely = min(n, int(COUNTED_SHARE * n + 4 * math.sqrt(n)) + 8)
    own = sets.read(file, at + LANES, likely)
    low = own[: np.searchsorted(own, COUNTED)]
    if len(low) < likely or likely == n:
        return low
    own = sets.read(file, at + LANES, n)
    return own[: np.searchsorted(own, COUNTED)]


def by_file(classes: DataFrame) -> DataFrame:
    """The rows so that a task reads whole files from front to back."""
    tasks = max(partitions_of(classes.sparkSession), classes.count() // 20_000)
    return classes.select(*PLACED).repartition(tasks, "file").sortWithinPartitions("file", "at")


def shared_hashes(classes: DataFrame, uri: str) -> DataFrame:
    """Rows (key, n): in how many sets each of the counted hashes stands that stands in several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, size = Sets(uri), [np.zeros(0, np.uint64)], 0

        def flushed() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for file, at, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                held.append(low_hashes(sets, file, at, n))
                size += len(held[-1])
                if size >= FLUSH:
                    yield flushed()
                    held, size = [np.zeros(0, np.uint64)], 0
        yield flushed()
        sets.close()

    return by_file(classes).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")


def cells_of(classes: DataFrame, uri: str, similarity: float) -> DataFrame:
    """Rows (node, file, at, n, fp, known, cell): those of the first members of each set in the global order that other sets may have."""
    spark = classes.sparkSession
    table = fresh_path(spark, "shared-shingles")
    often = fresh_path(spark, "shared-counts")
    shared_hashes(classes, uri).write.parquet(often)
    counts = spark.read.parquet(often)
    shards = max(1, counts.count() // SHARD_ROWS)
    write_table(counts.select("key", F.array(F.col("n").cast("float")).alias("v")), table, shards, 1)
    discard(spark, often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = worker_cache(table, lambda: HashTable(table, shards, 1))
        sets = Sets(uri)
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True))
            lows = [low_hashes(sets, file, at, n) for file, at, n in rows]
            if not rows:
                continue
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lows])])
            times = shared.find(np.concatenate(lows))[1][:, 0]
            chosen = []
            for k, (file, at, n) in enumerate(rows):
                own, t, need = lows[k], times[bounds[k] : bounds[k + 1]], prefix(n, similarity)
                rare = t <= FREQUENT
                if np.count_nonzero(rare) < need:  # too few rare ones among the low: look at the whole set
                    rest = sets.read(file, at + LANES + len(own), n - len(own)) if n > len(own) else own[:0]
                    own, t = np.concatenate([own, rest]), np.concatenate([t, np.full(len(rest), 2.0)])  # not counted: taken for rare and shared
                    rare = t <= FREQUENT
                first = np.concatenate([np.flatnonzero(rare), np.flatnonzero(~rare)])[:need]
                chosen.append(own[first[t[first] > 1]])
            sizes = [len(c) for c in chosen]
            repeated = [pa.array(np.repeat(np.array(batch.column(k).to_numpy()), sizes)) for k in range(len(PLACED))]
            yield pa.RecordBatch.from_arrays([*repeated, pa.array(np.concatenate(chosen).view(np.int64))], names=[*PLACED, "cell"])
        sets.close()

    path = fresh_path(spark, "cells")
    by_file(classes).mapInArrow(run, ", ".join(f"{c} bigint" for c in (*PLACED, "cell"))).write.parquet(path)
    discard(spark, table)
    return spark.read.parquet(path)


def close_links(classes: DataFrame, uri: str, similarity: float, radius: int) -> DataFrame:
    """Rows (a, b), a > b, whose components are those of the links between fingerprints within the radius; rows (node, file, at, n, fp)."""
    from .simhash import cell_masks, grid_cells, group_count

    n = classes.count()
    masks = [(m,) for m in cell_masks(group_count(n, radius), radius)]
    cells = grid_cells(classes.withColumn("known", F.col("node")).select(*PLACED), ["fp"], masks)

    def near(fp: np.ndarray, place: np.ndarray, sets: Sets) -> Callable:
        half, low = fp >> np.uint64(1), np.uint64(0x5555555555555555)
        unary = ((fp & half & low) << np.uint64(1)) | ((fp | half) & low)

        def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            fits = np.bitwise_count(unary[a] ^ unary[b]) <= radius
            fits[fits] = np.bitwise_count(fp[a[fits]] ^ fp[b[fits]]) <= radius
            return fits

        return may_link

    return linked(cells, max(partitions_of(classes.sparkSession), n * len(masks) // TASK_ROWS), uri, similarity, near)


def far_links(classes: DataFrame, uri: str, similarity: float, radius: int) -> DataFrame:
    """Rows (a, b), a > b: links between components ``known`` of rows (node, file, at, n, fp, known), by pairs beyond the radius."""
    cells = cells_of(classes, uri, similarity)

    def near(fp: np.ndarray, place: np.ndarray, sets: Sets) -> Callable:
        sketches = np.zeros((len(place), LANES), np.uint64)
        for k, (file, at) in enumerate(place[:, :2].tolist()):
            sketches[k] = sets.read(file, at, LANES)
        n = place[:, 2]

        def may_link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            apart = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64)
            fits = apart <= (1 - similarity) / (1 + similarity) * (n[a] + n[b]) + 1e-9
            return fits & (np.bitwise_count(fp[a] ^ fp[b]) > radius)

        return may_link

    return linked(cells, max(partitions_of(classes.sparkSession), cells.count() // TASK_ROWS), uri, similarity, near)


def linked(cells: DataFrame, tasks: int, uri: str, similarity: float, near: Callable) -> DataFrame:
    """Rows (a, b), a > b: between the ``known`` of rows that share a cell, may link by ``near`` and are similar enough."""
    from .simhash import dealt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(k).to_numpy() for k in range(len(PLACED) + 1)] for b in batches if b.num_rows]
        if not parts:
            return
        node, file, at, n, fp, known, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((node, key))
        key = key[order]
        same = key[1:] == key[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        order, key = order[shared], key[shared]
        if not len(order):
            return
        _, first, member = np.unique(node[order], return_index=True, return_inverse=True)
        first = order[first]
        place, known, fp = np.stack([x[first] for x in (file, at, n)], axis=1), known[first], fp[first].view(np.uint64)
        sets = Sets(uri)
        parent = forest(key, member, place, sets, similarity, known, near(fp, place, sets))
        sets.close()
        a, b = known, known[parent]
        moved = a != b
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[moved]), pa.array(np.minimum(a, b)[moved])], names=["a", "b"])

    return dealt(cells, list(PLACED)).repartition(tasks, "key").mapInArrow(run, "a bigint, b bigint").distinct()
