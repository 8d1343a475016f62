"""Hard-negative mining (operator 12): STR-packed R-trees searched best first.

Anchors are a stated set of rows. An anchor's positives are the rows of its label with the highest scores; for each positive
the hardest rows of other labels whose score lies in a window below the positive's are its negatives. A score is the inner product of
vectors of whole numbers (``floor(scale * x)``), higher first, ties by smaller id.

* packing (sort-tile-recursive): Spark ranges all rows by label and the coordinate that varies most into slabs; a task takes
  a slab in pieces of at most ``TREE_ROWS`` rows and tiles each by the next coordinates into leaves of ``LEAF`` rows, whose minimum
  bounding boxes are gathered ``FAN`` at a time up to a root;
* bounds: over a box each coordinate's product with the anchor's lies in an interval; their sums bound all scores inside;
* search: a queue holds boxes by upper bound. A box goes unopened if its bounds lie outside the score window or its upper bound
  lies strictly below the k-th score found; a box that ties is opened, since a smaller id may be inside. The search is exact;
* anchors meet trees in a grid of blocks (slices of anchors x trees), each cell a task of bounded size: anchors move to the trees that
  hold their label (positives) or another (negatives), and only the best few per cell and anchor come back to be ranked.

Work grows with anchors x trees that the bounds can't exclude; random vectors in many dimensions exclude little.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part; vectors of different
length have no score with each other; rows with one id are one row (the smallest label, then vector). An anchor without
positives, or a positive without negatives in its window, has no row. Fewer than asked for are all returned. Scores
beyond 64 bits raise ValueError. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, fresh_path

#: Rows of a tree, of a leaf, and children of a box.
TREE_ROWS, LEAF, FAN = 16_384, 128, 8
#: Anchors of a slice, about.
SLICE = 4_096
#: Trees whose numbers and labels are broadcast; Spark joins more than these by itself.
TREE_NAMES = 200_000

TREE = "tree bigint, dim int, labels array<bigint>, n int, ids binary, row_labels binary, vectors binary"


# ---- trees, in the tasks


def tiles(vectors: np.ndarray, order: list[int], rows: np.ndarray, leaf: int = LEAF) -> Iterator[np.ndarray]:
    """Sort-tile-recursive: rows in runs of at most ``leaf``, slab by slab along the coordinates in ``order``."""
    if len(rows) <= leaf:
        yield rows
        return
    axis, rest = (order[0], order[1:]) if order else (0, [])
    rows = rows[np.argsort(vectors[rows, axis], kind="stable")] if vectors.shape[1] else rows
    leaves = -(-len(rows) // leaf)
    slabs = leaves if not rest else min(leaves, max(2, round(leaves ** (1 / min(len(order), 3)))))
    size = -(-leaves // slabs) * leaf
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        if rest:
            yield from tiles(vectors, rest, part, leaf)
        else:
            yield from (part[k : k + leaf] for k in range(0, len(part), leaf))


class Tree:
    """A packed R-tree: vectors in the order of leaves, and a level of boxes after the other up to one root."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels = ids, labels
        self.largest = int(np.abs(vectors).max(initial=0))
        self.vectors = vectors
        starts = np.arange(0, len(ids), LEAF)
        low, high = np.minimum.reduceat(vectors, starts, axis=0), np.maximum.reduceat(vectors, starts, axis=0)
        self.levels = [(low, high)]  # leaves first
        while len(low) > 1:
            starts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)
            self.levels.append((low, high))
        first, last = np.minimum.reduceat(labels, np.arange(0, len(ids), LEAF)), np.maximum.reduceat(labels, np.arange(0, len(ids), LEAF))
        self.leaf_label = np.where(first == last, first, -1), first == last

    def exact(self, anchor: np.ndarray) -> np.ndarray:
        """The anchor in a kind of number in which all sums are exact."""
        bound = max(1, len(anchor)) * max(1, self.largest) * max(1, int(np.abs(anchor).max(initial=0)))
        if bound >= 1 << 63:
            raise ValueError("scores don't fit 64 bits")
        return anchor.astype(np.float64 if bound < 1 << 53 else np.int64)

    def bounds(self, anchor: np.ndarray) -> list[tuple[list[int], list[int]]]:
        """Per level, (least, greatest) score that the intervals of the coordinates allow in each box."""
        up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
        kind = anchor.dtype
        boxes = [(low.astype(kind), high.astype(kind)) for low, high in self.levels] if self.levels[0][0].dtype != kind else self.levels
        return [((low @ up + high @ down).tolist(), (high @ up + low @ down).tolist()) for low, high in boxes]

    def search(self, anchor: np.ndarray, label: int, same: bool, windows: list[tuple[int | None, int | None]], k: int, but: int | None = None) -> list[list[tuple[int, int]]]:
        """For each window of scores (inclusive, None for open), the best k rows (score, id) of the label or of the others."""
        anchor = self.exact(anchor)
        if self.vectors.dtype != anchor.dtype:
            self.vectors = self.vectors.astype(anchor.dtype)
            self.levels = [(low.astype(anchor.dtype), high.astype(anchor.dtype)) for low, high in self.levels]
        bounds, opened = self.bounds(anchor), {}
        top = len(self.levels) - 1
        pure_label, pure = self.leaf_label

        def leaf(b: int) -> tuple[np.ndarray, np.ndarray]:
            """Scores and ids of a leaf's rows that have the right label."""
            if b not in opened:
                rows = slice(b * LEAF, (b + 1) * LEAF)
                fits = ((self.labels[rows] == label) == same) & (self.ids[rows] != but if but is not None else True)
                opened[b] = (self.vectors[rows] @ anchor)[fits], self.ids[rows][fits]
            return opened[b]

        def least_of(upper, high: int | None):
            """No score that counts lies above the window."""
            return upper if high is None or upper < high else high

        out = []
        for low, high in windows:
            best: list[tuple[int, int]] = []  # the worst of the best first
            queue = [(-least_of(bounds[top][1][0], high), top, 0)]
            while queue:
                upper, level, b = heapq.heappop(queue)
                if len(best) == k and -upper < best[0][0]:
                    break  # no box left reaches the k-th
                if level == 0:
                    scores, ids = leaf(b)
                    floor = best[0][0] if len(best) == k else low
                    fits = scores <= high if high is not None else np.ones(len(scores), bool)
                    fits = fits & (scores >= floor) if floor is not None else fits
                    if fits.any():
                        # Of the rows that may count the best k, by score and then by id.
                        scores, ids = scores[fits], ids[fits]
                        for i in np.lexsort((ids, -scores))[:k]:
                            row = (int(scores[i]), -int(ids[i]))
                            if len(best) < k:
                                heapq.heappush(best, row)
                            elif row > best[0]:
                                heapq.heapreplace(best, row)
                    continue
                least, greatest = bounds[level - 1]
                for c in range(b * FAN, min((b + 1) * FAN, len(least))):
                    if (low is not None and greatest[c] < low) or (high is not None and least[c] > high):
                        continue
                    if level == 1 and pure[c] and (pure_label[c] == label) != same:
                        continue
                    if len(best) < k or greatest[c] >= best[0][0]:
                        heapq.heappush(queue, (-least_of(greatest[c], high), level - 1, c))
            out.append([(s, -i) for s, i in sorted(best, reverse=True)])
        return out


def _pack(axes: list[int], tree_rows: int):
    """Rows (id, label, vector) of a slab, in order of dimension and label, to packed trees of at most ``tree_rows`` rows."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32  # of the tree

        def packed(ids, labels, vectors):
            nonlocal number
            ids, labels = np.array(ids, np.int64), np.array(labels, np.int64)
            order = np.concatenate([r for label in np.unique(labels) for r in tiles(vectors, [a for a in axes if a < vectors.shape[1]], np.flatnonzero(labels == label))])
            row = (number, vectors.shape[1], sorted(set(labels.tolist())), len(ids), ids[order].tobytes(), labels[order].tobytes(), np.ascontiguousarray(vectors[order]).tobytes())
            number += 1
            types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in TREE.split(", ")])

        ids, labels, vectors = [], [], []
        for batch in batches:
            for id_, label, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                vector = vector.values.to_numpy()
                if ids and (len(ids) == tree_rows or len(vector) != len(vectors[0])):
                    yield packed(ids, labels, np.stack(vectors))
                    ids, labels, vectors = [], [], []
                ids.append(id_)
                labels.append(label)
                vectors.append(vector)
        if ids:
            yield packed(ids, labels, np.stack(vectors))

    return run


def _search(same: bool, k: int):
    """A cell of the grid: one tree and a slice of anchors, to rows (anchor, positive, score, other, other_score)."""

    def run(key, trees: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if trees.num_rows and anchors.num_rows:
            one = {c: trees.column(c)[0].as_py() for c in trees.column_names}
            own = [np.frombuffer(one[c], np.int64) for c in ("ids", "row_labels", "vectors")]
            tree = Tree(own[0], own[1], own[2].reshape(one["n"], one["dim"]))
            for anchor, label, vector, windows in zip(*(anchors.column(c).to_pylist() for c in ("anchor", "label", "vector", "windows")), strict=True):
                sought = [(w["low"], w["high"]) for w in windows]
                for w, found in zip(windows, tree.search(np.array(vector, np.int64), label, same, sought, k, anchor), strict=True):
                    out += [(anchor, w["positive"], w["score"], i, s) for s, i in found]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor", "positive", "score", "other", "other_score"])

    return run


# ---- with Spark


def whole_numbers(vectors: DataFrame, scale: int, id_col: str, label: str, vector: str) -> DataFrame:
    """Rows (id, label, vector of bigint) that take part, one per id."""
    x = F.col("v")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v")).filter(fine)
    huge = rows.filter(F.exists("v", lambda c: F.abs(c) * scale >= float(1 << 62)))
    if not huge.isEmpty():
        raise ValueError("scores don't fit 64 bits")
    rows = rows.select("id", "label", F.transform("v", lambda c: F.floor(c * scale).cast("bigint")).alias("vector"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("one")).select("id", "one.label", "one.vector")


def pack(rows: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """R-trees over rows (id, label, vector), one per row, written in the shared folder by the caller."""
    n, dim = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    spread = rows.agg(*[F.coalesce(F.var_pop(F.get("vector", F.lit(k))), F.lit(0.0)) for k in range(dim or 0)]).first() if dim else []
    axes = sorted(range(dim or 0), key=lambda k: -spread[k])[:3]
    slabs = max(1, -(-n // tree_rows))
    keys = [F.size("vector"), F.col("label"), F.get("vector", F.lit(axes[0] if axes else 0)), F.col("id")]
    slabbed = rows.repartitionByRange(slabs, *keys).sortWithinPartitions(F.size("vector"), F.col("label"))
    return slabbed.mapInArrow(_pack(axes[1:] or axes, tree_rows), TREE)


def _grid(anchors: DataFrame, trees: DataFrame, same: bool, k: int, slices: int) -> DataFrame:
    """Best rows of each cell for anchors (anchor, label, vector, windows)."""
    names = trees.select(F.col("tree").alias("at"), "dim", "labels")
    names = F.broadcast(names) if names.count() <= TREE_NAMES else names
    fits = F.array_contains("labels", F.col("label")) if same else (F.size("labels") > 1) | ~F.array_contains("labels", F.col("label"))
    dealt = anchors.withColumn("slice", F.pmod(F.xxhash64("anchor"), F.lit(slices)).cast("int"))
    dealt = dealt.join(names, fits & (F.size("vector") == F.col("dim"))).select("at", "slice", "anchor", "label", "vector", "windows")
    blocks = trees.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    cells = blocks.groupBy("tree", "slice").cogroup(dealt.groupBy("at", "slice"))
    return cells.applyInArrow(_search(same, k), "anchor bigint, positive bigint, score bigint, other bigint, other_score bigint")


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, tree_rows: int = TREE_ROWS, slice_rows: int = SLICE,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchors`` is a condition on the column ``id``.

    A negative's score lies between ``low`` and ``high`` percent of the positive's, both included.
    """
    spark = vectors.sparkSession
    whole_numbers(vectors, scale, id_col, label, vector).write.parquet(path := fresh_path(spark, "negatives-rows"))
    rows = spark.read.parquet(path)
    pack(rows, tree_rows).write.parquet(trees_path := fresh_path(spark, "negatives-trees"))
    trees = spark.read.parquet(trees_path)
    own = rows.filter(anchors).select(F.col("id").alias("anchor"), "label", "vector")
    slices = max(1, -(-own.count() // slice_rows))
    none = F.lit(None).cast("bigint")
    open_ = F.array(F.struct(none.alias("positive"), none.alias("score"), none.alias("low"), none.alias("high")))
    ranked = Window.partitionBy("anchor", "positive").orderBy(F.desc("other_score"), "other")
    near = _grid(own.withColumn("windows", open_), trees, True, positives, slices)
    near = near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= positives)
    score = F.col("other_score")
    # The window in whole numbers: percentages rounded up and down by integer division.
    least = F.expr(f"-((-other_score * {low} - pmod(-other_score * {low}, 100)) div 100)")
    greatest = F.expr(f"(other_score * {high} - pmod(other_score * {high}, 100)) div 100")
    windows = near.select("anchor", F.struct(F.col("other").alias("positive"), score.alias("score"), least.alias("low"), greatest.alias("high")).alias("w"))
    windows = cut(windows.filter("w.low <= w.high").groupBy("anchor").agg(F.collect_list("w").alias("windows")))
    hard = _grid(own.join(windows, "anchor"), trees, False, negatives, slices)
    hard = cut(hard.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives))
    discard(spark, path)
    discard(spark, trees_path)
    return hard.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("positive_score"), F.col("other_score").alias("negative_score"))
