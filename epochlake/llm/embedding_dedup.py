"""Embedding near-dedup (operator 4): iterative quantisation, Hamming tables of part codes, components, exact counts.

Equal vectors of a label are one class. ``fit_rotation`` learns, on a bounded sample, an orthonormal projection
whose leading signs are balanced binary codes (principal axes, then the ITQ rotation). Coordinates are cut into
``TABLES`` parts, each with its part of the code.

Retrieval loses nothing. Unit vectors of cosine c are sqrt(2 - 2c) apart, and the projection doesn't lengthen
that, so in one of the m parts they differ by at most (2 - 2c) / m in square. A coordinate whose sign differs adds at
least the squares of both values, so one of the two vectors has flipped coordinates whose squares sum to at most
half of that. Each vector is therefore sent, as one byte a coordinate, home to the bucket of the leading bits of its own part, and
as a guest to those that such a flip set makes; the bucket's task goes on by further bits in memory and compares homes
with homes and guests at the leaves. Bytes are floors, so distances are bounded from below.

A group of near copies has links in the square of its size, so pairs are never rows: a leaf gives a spanning forest of
what may be near, whose components hold every link. The members of a component meet in tiles of ``TILE`` x ``TILE``;
there every pair is checked by the cosine of the original vectors in double precision, once, and a tile gives counts and a forest.

Ids may repeat: a vector is known by a number of its own. Defined results: a vector without id, label or components, with null, NaN or infinite components, or of zero length
links with nothing and is its own component. Vectors of different lengths never link. Equal rows count as vectors
of their own. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, fresh_path, partitions_of
from .components import components

#: Vectors that the rotation is learned on: the stated bound of the sample.
FIT_ROWS = 4096
#: Bits of a code, axes that distances are bounded by, tables, steps of ITQ.
BITS, AXES, TABLES, STEPS = 64, 256, 4, 30
#: Codes a vector is looked up under in a table, at most; bits between the lengths at which that is tested.
PROBES, STEP = 512, 4
#: Homes that a bucket is meant to hold; rows that a vector may have for each bit that buckets are led by, in powers of this.
BUCKET_ROWS, SPREAD = 1 << 18, 1.6
#: Homes that are compared without further bits; rows and columns compared at once; members of a tile's side.
LEAF, ROWS, COLUMNS, TILE = 128, 256, 1 << 14, 8192
MIN_COSINE = 0.98
#: Which of some rows are near which of some columns.
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def fit_rotation(sample: np.ndarray, bits: int = BITS, steps: int = STEPS, axes: int = AXES) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, projection with orthonormal columns, bits) of unit vectors; as many bits as the sample has axes of note, then further axes."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    value, axis = np.linalg.eigh(centred.T @ centred)
    order = np.argsort(-value, kind="stable")[:axes]
    order = order[value[order] > 1e-9 * max(value.max(), 1e-300)]
    axis = axis[:, order] if len(order) else np.eye(sample.shape[1])[:, :1]
    axis, rest = axis[:, :bits], axis[:, bits:]
    v = centred @ axis
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(axis.shape[1],) * 2))[0]
    for _ in range(steps):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return mean, np.concatenate([axis @ rotation, rest], axis=1), axis.shape[1]


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def codes_of(coordinates: np.ndarray) -> np.ndarray:
    """Signs as bits; the first coordinate is the lowest bit."""
    return ((coordinates >= 0) @ (1 << np.arange(coordinates.shape[1], dtype=np.int64))).astype(np.int64)


def probes(coordinates: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, level, code of the first ``level`` bits) of each code that flipping coordinates whose squares sum to at most the budget makes.

    A row goes on to the next ``STEP`` bits as long as it has at most ``PROBES`` codes; the first step has 2**STEP at most.
    """
    n, s = coordinates.shape
    square, code = coordinates**2, codes_of(coordinates)
    owner, flip, spent, out = np.arange(n), np.zeros(n, np.int64), np.zeros(n), []
    for low in range(0, s, STEP):
        high = min(low + STEP, s)
        o, f, e = owner, flip, spent
        for j in range(low, high):
            cost = e + square[o, j]
            more = cost <= budget
            o, f, e = np.concatenate([o, o[more]]), np.concatenate([f, f[more] | (1 << j)]), np.concatenate([e, cost[more]])
        many = np.bincount(o, minlength=n) > (PROBES if low else 1 << STEP)
        stop = many[owner]
        out.append((owner[stop], np.full(stop.sum(), low), (code[owner[stop]] ^ flip[stop]) & ((1 << low) - 1)))
        go = ~many[o]
        owner, flip, spent = o[go], f[go], e[go]
    out.append((owner, np.full(len(owner), s), code[owner] ^ flip))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def lists_to_array(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def forest(homes: int, guests: int, hh: Near, hg: Near) -> tuple[np.ndarray, np.ndarray]:
    """Parents and children of a spanning forest of the near pairs of homes, and of homes and guests; guests are numbered from ``homes`` on.

    ``hh`` and ``hg`` say which of some homes are near some homes and some guests. A component is complete before the next begins, so what
    has been reached is compared no more: a group of near copies costs about its size.
    """
    home, guest = np.ones(homes, bool), np.ones(guests, bool)
    parents, children = [], []

    def reach(rows: np.ndarray, open_: np.ndarray, near: Near, row_at: int, at: int) -> np.ndarray:
        """Open columns near one of the rows, which are open no more."""
        if not len(rows):
            return rows
        got = []
        for low in range(0, len(rows), ROWS):
            if not len(rest := np.flatnonzero(open_)):
                break
            some = rows[low : low + ROWS]
            for left in range(0, len(rest), COLUMNS):
                columns = rest[left : left + COLUMNS]
                hits = near(some, columns)
                new = np.flatnonzero(hits.any(axis=0))
                open_[columns[new]] = False
                parents.append(some[hits[:, new].argmax(axis=0)] + row_at)
                children.append(columns[new] + at)
                got.append(columns[new])
        return np.concatenate([*got, np.zeros(0, np.int64)]).astype(np.int64)

    for low in range(0, homes, ROWS):
        block = np.flatnonzero(home[low : low + ROWS]) + low
        if not len(block):
            continue
        busy, later, others = np.zeros(len(block), bool), np.flatnonzero(home[low:]) + low, np.flatnonzero(guest)
        for left in range(0, len(later), COLUMNS):
            columns = later[left : left + COLUMNS]
            busy |= (hh(block, columns) & (block[:, None] != columns[None, :])).any(axis=1)
        for left in range(0, len(others), COLUMNS):
            busy |= hg(block, others[left : left + COLUMNS]).any(axis=1)
        for head in block[busy]:
            if home[head]:
                home[head], new, met = False, np.array([head]), np.zeros(0, np.int64)
                while len(new) or len(met):
                    more, known = reach(new, home, hh, 0, 0), reach(new, guest, hg, 0, homes)
                    new, met = np.concatenate([more, reach(met, home, lambda g, h: hg(h, g).T, homes, 0)]), known
        home[block] = False
    none = [np.zeros(0, np.int64)]
    return np.concatenate([*none, *parents]), np.concatenate([*none, *children])


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", min_cosine: float = MIN_COSINE) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of ``df``."""
    spark, kind = df.sparkSession, "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.col(label).cast("string").alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    for seed in count():
        nodes = rows.withColumn("node", F.when(F.col("good"), node_of(seed)))
        path = fresh_path(spark, "embedding-classes")
        name = "epochlake_" + path.rsplit("-", 1)[1]
        other = F.xxhash64(F.lit("second"), "v", "label")
        classes = nodes.filter("good").withColumn("other", other).groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"), (F.min("other") < F.max("other")).alias("clash"))
        # Bucketed by node: the joins below move numbers to the vectors, never all vectors.
        classes.withColumn("size", F.size("v")).write.format("parquet").option("path", path).bucketBy(partitions_of(spark), "node").saveAsTable(name)
        classes = spark.table(name)
        if not classes.filter("clash").limit(1).count():  # else two different vectors share a number
            break
        _drop(spark, name, path)
    sizes = [r[0] for r in classes.select("size").distinct().collect()]
    near = spark.createDataFrame([], "a bigint, b bigint")
    for size in sizes:
        near = near.unionByName(_near(classes.filter(F.col("size") == size), min_cosine))
    checked = cut(_checked(classes, components(near), min_cosine))
    degree = checked.filter("w is not null").groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("others"))
    joined = components(checked.filter("b is not null").select("a", "b"))
    joined = joined.join(classes.select("node", "first"), "node")
    linked = joined.join(joined.groupBy("component").agg(F.min("first").alias("component_id")), "component").join(degree, "node", "left").select("node", "others", "component_id")
    known = classes.select("node", "n", "first").join(linked, "node", "left")
    known = cut(known.select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")))
    _drop(spark, name, path)
    out = nodes.select("id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def node_of(seed: int) -> Column:
    """The number of a vector's class."""
    return F.xxhash64(F.lit(seed), "label", "v")


def _drop(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE {name}")
    discard(spark, path)


def _near(classes: DataFrame, min_cosine: float) -> DataFrame:
    """Rows (a, b): a forest whose components hold every link of these classes, which have one number of components."""
    sample = classes.select("v", "node").orderBy("node").limit(FIT_ROWS).collect()
    vectors = unit(np.array([r[0] for r in sample]))
    mean, projection, bits = fit_rotation(vectors)
    m = min(TABLES, bits)
    codes, rest = np.array_split(np.arange(bits), m), np.array_split(np.arange(bits, projection.shape[1]), m)
    parts, widths = [np.concatenate(x) for x in zip(codes, rest, strict=True)], [len(x) for x in codes]
    square = (2 - 2 * min_cosine) / m + 1e-9
    at = (vectors - mean) @ projection
    scale = [max(np.abs(at[:, part]).max(), 1e-9) / 127 for part in parts]
    largest, labels = classes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    slots = max(64, -(-labels // BUCKET_ROWS))
    lead = min(max(0, math.ceil(math.log2(largest / BUCKET_ROWS))), 2 * STEP, *widths)  # with more bits ``probes`` may stop early
    while lead and any(len(probes(at[:, part[:lead]], square / 2)[0]) > len(at) * SPREAD**lead for part in parts):
        lead -= 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), lists_to_array(batch.column(2))))
                n += batch.num_rows
                if n * len(mean) >= 1 << 20:
                    yield from dealt(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if held:
            yield from dealt(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def dealt(node: np.ndarray, label: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, slot = (unit(v) - mean) @ projection, label.view(np.uint64) % np.uint64(slots)
        for t, part in enumerate(parts):
            low = np.clip(np.floor(at[:, part] / scale[t]), -128, 127).astype(np.int8)
            row = np.concatenate([node[:, None].view(np.uint8), label[:, None].view(np.uint8)[:, :4], low.view(np.uint8)], axis=1)
            home = codes_of(at[:, part[:lead]])
            owner, _, code = probes(at[:, part[:lead]], square / 2)
            guest = code != home[owner]
            for own, who, where in ((True, np.arange(len(at)), home), (False, owner[guest], code[guest])):
                key = ((slot[who].astype(np.int64) * m + t) << lead) | where
                order = np.argsort(key, kind="stable")
                key, cuts = np.unique(key[order], return_index=True)
                ends = np.append(cuts, len(order)) * row.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(row[who[order]])])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), own)), packed], names=["bucket", "own", "rows"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        bucket, own, packed = key[0].as_py(), table.column("own").to_numpy(), table.column("rows").to_pylist()
        t = (bucket >> lead) % m
        home, guest = (np.frombuffer(b"".join(x for x, o in zip(packed, own, strict=True) if o == w), np.uint8).reshape(-1, 12 + len(parts[t])) for w in (True, False))
        row = np.concatenate([home, guest])
        node, label, low = row[:, :8].copy().view(np.int64)[:, 0], row[:, 8:12].copy().view(np.uint32)[:, 0], row[:, 12:].view(np.int8)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(label, kind="stable")
        for one in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            for x, y in _forests(low[one], one < len(home), bucket & ((1 << lead) - 1), lead, widths[t], square / scale[t] ** 2):
                a.append(node[one[x]])
                b.append(node[one[y]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    stored = classes.select("node", F.xxhash64("label").alias("label"), "v").mapInArrow(deal, "bucket bigint, own boolean, rows binary")
    return stored.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint")


def _forests(low: np.ndarray, own: np.ndarray, prefix: int, lead: int, bits: int, square: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forests of the pairs of homes, or of a home and a guest, whose distance in square may be ``square`` or less; all in units of a byte's step."""
    up = low[:, :bits] >= 0
    least = np.where(up, low[:, :bits], -1 - low[:, :bits]).astype(np.int16) ** 2
    half = square / 2 + 1e-6
    most = math.ceil((math.sqrt(square) + math.sqrt(low.shape[1])) ** 2)
    # Their product is the distance in square less ``most``, in whole numbers below 2^24.
    left, width = np.ones((len(low), low.shape[1] + 2), np.float32), low.shape[1]
    left[:, :width] = low
    size = np.einsum("nd,nd->n", left[:, :width], left[:, :width])
    right = left * np.float32(-2)
    right[:, width], right[:, width + 1], left[:, width + 1] = size, 1, size - most
    spent = np.zeros(len(low), np.int32)
    for j in range(lead):
        spent += np.where(up[:, j] != bool(prefix >> j & 1), least[:, j], 0)

    def leaf(home: np.ndarray, guest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        def near(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
            return left[rows] @ right[columns].T <= 0

        if len(home) * (len(home) + len(guest)) <= ROWS * COLUMNS:
            hh, hg = near(home, home), near(home, guest)
            np.fill_diagonal(hh, False)
            rows = np.flatnonzero(hh.any(axis=1) | hg.any(axis=1))
            if not len(rows):
                return
            columns = np.flatnonzero(hg[rows].any(axis=0))
            hh, hg, home, guest = hh[np.ix_(rows, rows)], hg[np.ix_(rows, columns)], home[rows], guest[columns]
            x, y = forest(len(home), len(guest), lambda r, c: hh[r[:, None], c], lambda r, c: hg[r[:, None], c])
        else:
            x, y = forest(len(home), len(guest), lambda r, c: near(home[r], home[c]), lambda r, c: near(home[r], guest[c]))
        if len(x):
            both = np.concatenate([home, guest])
            yield both[x], both[y]

    def split(home: np.ndarray, guest: np.ndarray, spent: np.ndarray, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(home) or len(home) + len(guest) < 2:
            return
        if len(home) <= LEAF or j == bits:
            yield from leaf(home, guest)
            return
        side, other, cost = up[home, j], up[guest, j], least[home, j]
        far = spent + least[guest, j]
        pays, goes = cost <= half, far <= half
        sides, work = [], 0
        for s in (False, True):
            mine, same = side == s, other == s
            come, cross = ~mine & pays, ~same & goes
            sides.append((mine, come, same, cross))
            h = int(mine.sum())
            work += h * (h + int(come.sum()) + int(same.sum()) + int(cross.sum()))
        if 0 < side.sum() < len(side) and work > 0.9 * len(home) * (len(home) + len(guest)):
            yield from leaf(home, guest)
            return
        for mine, come, same, cross in sides:
            if mine.any():
                yield from split(home[mine], np.concatenate([home[come], guest[same], guest[cross]]), np.concatenate([cost[come], spent[same], far[cross]]), j + 1)

    guest = np.flatnonzero(~own)
    return split(np.flatnonzero(own), guest, spent[guest], lead)


def _checked(classes: DataFrame, groups: DataFrame, min_cosine: float) -> DataFrame:
    """Rows (a, w): how many vectors a class is linked with, to be summed, and (a, b): a forest of the links. ``groups`` has (node, component)."""
    bundles = max(partitions_of(classes.sparkSession), groups.count() // TILE)
    large = groups.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("k")).filter("k > 1")
    placed = groups.join(large, "component", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    placed = placed.join(classes.select("node", "n", "label", "size", "v"), "node").withColumn("chunk", F.pmod(F.xxhash64("node"), "k").cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    tile = lambda x: F.when(F.col("k") > 1, x).otherwise(-1)
    placed = placed.withColumns({"g": F.when(F.col("k") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bundles))), "i": tile(F.least("chunk", "with")), "j": tile(F.greatest("chunk", "with"))})

    def check(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[2].as_py(), key[3].as_py()
        node, n, component, chunk = (table.column(c).to_numpy() for c in ("node", "n", "component", "chunk"))
        label = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)[1]
        v = unit(lists_to_array(table.column("v").combine_chunks()))
        others, a, b = np.zeros(len(node), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if i < j:
            sides = [(np.flatnonzero(chunk == i), np.flatnonzero(chunk == j))]
        else:
            order = np.argsort(component, kind="stable")
            sides = [(x, x) for x in np.split(order, np.flatnonzero(np.diff(component[order])) + 1)]
        for x, y in sides:
            link = np.zeros((len(x), len(y)), bool)
            for low in range(0, len(x), ROWS):
                some = x[low : low + ROWS]
                cosine = v[some] @ v[y].T
                r, c = np.nonzero(np.abs(cosine - min_cosine) < 1e-12)  # the product's order of summation is not to decide
                cosine[r, c] = np.einsum("nd,nd->n", v[some[r]], v[y[c]])
                link[low : low + ROWS] = (cosine >= min_cosine) & (label[some][:, None] == label[y][None, :]) & (some[:, None] != y[None, :])
            for low in range(0, len(x), ROWS):
                some, part = x[low : low + ROWS], link[low : low + ROWS].astype(np.float64)
                others[some] += (part @ n[y]).astype(np.int64)
                if i < j:
                    others[y] += (n[some] @ part).astype(np.int64)
            if i < j:
                p, q = forest(len(x), len(y), lambda r, c: np.zeros((len(r), len(c)), bool), lambda r, c, link=link: link[r[:, None], c])
                both = np.concatenate([x, y])
            else:
                p, q = forest(len(x), 0, lambda r, c, link=link: link[r[:, None], c], lambda r, c: np.zeros((len(r), 0), bool))
                both = x
            a.append(node[both[p]])
            b.append(node[both[q]])
        has = others > 0
        a, b, none = np.concatenate(a), np.concatenate(b), pa.nulls
        return pa.table({"a": np.concatenate([node[has], a]), "b": pa.concat_arrays([none(has.sum(), pa.int64()), pa.array(b)]), "w": pa.concat_arrays([pa.array(others[has]), none(len(a), pa.int64())])})

    return placed.select("size", "g", "i", "j", "component", "chunk", "node", "n", "label", "v").groupBy("size", "g", "i", "j").applyInArrow(check, "a bigint, b bigint, w bigint")
