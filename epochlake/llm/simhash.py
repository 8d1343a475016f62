"""SimHash near-dedup (operator 6): popcount embedding, grid range-join, exact verification.

``fingerprints`` makes a 64-bit fingerprint from the word shingles of each whole text. ``near_duplicates`` finds all
pairs of different fingerprints within ``radius`` bits:

* embedding: the fingerprint is cut into 32 segments of two bits, each mapped to its number of set bits. Written in
  unary (0, 1, 2 -> 00, 01, 11) the vector fits in 64 bits, and the Manhattan distance of two vectors is the
  popcount of their exclusive or. It never exceeds the Hamming distance.
* grid: the segments form ``groups`` groups. Vectors within Manhattan distance r agree in at least ``groups - r``
  groups, so a grid cell of unit width per choice of that many groups holds every such pair: the range join is an
  equi-join on cells, without loss.
* within a cell the Manhattan distance is checked first, then the exact Hamming distance.

Equal fingerprints are one class before any of this. A cell with more than ``CELL_ROWS`` members is dealt out as
pairs of blocks. A task reports a spanning forest of the links it found, never all pairs, so a group of n near
copies costs at most n rows per cell. The links are joined up to components.

``near_texts`` links by the Jaccard similarity of the shingle sets. The same grid over the fingerprints of the sets gives
the candidates, which are verified by the sets. A similarity doesn't bound the distance of fingerprints, so similar texts
beyond the radius, and no others, come from a prefix join (``shingle_sets``).

Defined results: a text without words (null, empty, white space) has fingerprint zero and links like any other;
with fewer words than a shingle the whole sequence is the one shingle. Repeated rows stay; a null id takes part but
never names a component. Extra columns are not read. A text is taken whole: n bytes take some 12 n in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingle_sets
from .common import cut, discard, partitions_of, refuse_columns, small_batches
from .components import components
from .hash_arrays import mix

SEED = 42
#: Members of a grid cell that one task compares; larger cells are dealt out as pairs of blocks of this size.
CELL_ROWS = 4096
#: Hashes whose bits are counted at once.
BIT_ROWS = 65_536
#: Keys of dropped documents (8 bytes each) up to this number are broadcast; above it both sides are shuffled.
BROADCAST_IDS = 500_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(joined))
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of their 64 bits set; bytes are added in groups that cannot overflow."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BIT_ROWS):
        bits = np.unpackbits(hashes[at : at + BIT_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        out += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return out


def signs(hashes: np.ndarray) -> int:
    """The fingerprint of hashes as a signed 64-bit word: the bits that over half of them have set."""
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int, lanes: int = 1) -> list[int]:
    """``lanes`` signed 64-bit words; the first is from the shingles' hashes themselves, further ones from mixed hashes."""
    hashes, out = shingle_hashes(text, words), []
    for lane in range(lanes):
        out.append(signs(hashes if lane == 0 else mix(hashes + np.uint64(lane))))
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, lanes: int = 1) -> DataFrame:
    """Rows (id, f0, f1, ...): one per row of ``df``."""
    small_batches(df.sparkSession)
    names = [f"f{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words, lanes) for t in batch.column(1)], np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in made.T)], names=["id", *names])

    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, ", ".join(["id bigint", *(f"{n} bigint" for n in names)]))


def unary_popcounts(fp: Column) -> Column:
    """Set bits of each two-bit segment, in unary: the embedding as one 64-bit word."""
    low = F.lit(0x5555555555555555).cast("bigint")
    right = F.shiftrightunsigned(fp, 1)
    both, either = fp.bitwiseAND(right).bitwiseAND(low), fp.bitwiseOR(right).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(either)


def group_count(n: int, radius: int) -> int:
    """Groups of segments: more for more fingerprints, so that cells stay small. Any number above the radius is exact."""
    return radius + 2 + (n > 1 << 24) + (n > 1 << 28)


def cell_masks(groups: int, radius: int) -> list[int]:
    """Bit masks (signed) of each choice of groups that a linked pair may agree in."""
    bounds = [32 * k // groups for k in range(groups + 1)]
    own = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(bounds, bounds[1:], strict=False)]
    masks = [sum(own[k] for k in chosen) for chosen in combinations(range(groups), groups - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def grid_cells(prints: DataFrame, names: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """Each row of ``prints`` once per grid, with its ``cell`` there; the fingerprint is in the columns ``names``.

    Each entry of ``masks`` is a grid: the bits, per lane, of the embedding's segments that make its cells.
    """
    unary = [f"u{k}" for k in range(len(names))]
    embedded = prints.select("*", *[unary_popcounts(F.col(f)).alias(u) for f, u in zip(names, unary, strict=True)])

    def cell(mask: tuple[int, ...], grid: int) -> Column:
        return F.xxhash64(F.lit(grid), *[F.col(u).bitwiseAND(F.lit(m).cast("bigint")) for u, m in zip(unary, mask, strict=True) if m])

    return embedded.select(*prints.columns, F.explode(F.array(*[cell(m, k) for k, m in enumerate(masks)])).alias("cell"))


def dealt(cells: DataFrame, names: list[str]) -> DataFrame:
    """Rows (names, key) that meet by key: a cell of more than ``CELL_ROWS`` rows is dealt out as pairs of blocks by node."""
    crowded = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > CELL_ROWS).select("cell", F.ceil(F.col("n") / (CELL_ROWS // 2)).cast("int").alias("blocks")))
    if not (many := crowded.count()):
        return cells.select(*names, F.col("cell").alias("key"))
    sides = F.broadcast(crowded) if many <= 100_000 else crowded
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = cells.join(sides, "cell", "left").withColumn("own", F.coalesce(block, F.lit(0))).withColumn("with", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    return other.select(*names, F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("own", "with"), F.greatest("own", "with"))).alias("key"))


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[k] and b[k] for all k; ``parent`` points to the smallest member known."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def forest(cell: np.ndarray, prints: np.ndarray, unary: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by cell: the row that each is joined to by links inside cells (itself if by none).

    ``prints`` and ``unary`` have a column per lane. Pairs whose Manhattan distance exceeds the radius are out before
    their Hamming distance is looked at.
    """
    parent = np.arange(len(cell))
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(heads, len(cell)))
    small = np.repeat(sizes <= 64, sizes)
    lanes = range(prints.shape[1])

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.arange(len(a))
        for codes in (unary, prints):
            ok = ok[sum(np.bitwise_count(codes[a[ok], k] ^ codes[b[ok], k]).astype(np.int16) for k in lanes) <= radius]
        return ok

    for d in range(1, int(sizes[sizes <= 64].max(initial=1))):
        at = np.flatnonzero(small[d:] & (cell[d:] == cell[:-d]))
        at = at[near(at, at + d)]
        hook(parent, at, at + d)
    for head, n in zip(heads[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        end, step = head + n, max(1, 1_000_000 // n)
        for at in range(head, end, step):
            last = min(at + step, end)
            apart = sum(np.bitwise_count(unary[at:last, None, k] ^ unary[None, at:end, k]).astype(np.int16) for k in lanes)
            a, b = np.nonzero(apart <= radius)
            a, b = at + a[a < b], at + b[a < b]
            ok = near(a, b)
            hook(parent, a[ok], b[ok])
    return parent


def links(prints: DataFrame, radius: int, masks: list[tuple[int, ...]]) -> DataFrame:
    """Rows (a, b), a > b: a spanning forest of the links that share a cell, between rows (node, f0, f1, ...)."""
    spark, lanes = prints.sparkSession, len(masks[0])
    n = prints.count()
    names = [f"f{k}" for k in range(lanes)]
    rows = dealt(grid_cells(prints.select("node", *names), names, masks), ["node", *names])
    tasks = max(partitions_of(spark), n * len(masks) // 400_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(k).to_numpy() for k in range(lanes + 2)] for b in batches if b.num_rows]
        if parts:
            node, *own, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((node, key))
            node, key = node[order], key[order]
            prints = np.stack([f[order].view(np.uint64) for f in own], axis=1)  # bits of a signed number are those of its absolute value
            low = np.uint64(0x5555555555555555)
            half = prints >> np.uint64(1)
            parent = forest(key, prints, ((prints & half & low) << np.uint64(1)) | ((prints | half) & low), radius)
            at = np.flatnonzero(node != node[parent])
            a, b = node[at], node[parent[at]]
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.repartition(tasks, "key").mapInArrow(run, "a bigint, b bigint").distinct()


def named(prints: DataFrame, classes: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (id, keys, component_id) from classes (node, first, keys) and their links."""
    members = classes.join(components(found), "node", "left").select(*keys, "first", F.coalesce("component", "node").alias("component"))
    least = cut(members.groupBy("component").agg(F.min("first").alias("component_id")))  # so that Spark can split a large component's join
    return prints.join(members.join(least, "component").select(*keys, "component_id"), keys, "left").select("id", *keys, "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """Rows (id, fp, component_id): one per row of ``df``; a component's id is the smallest document id in it. Loses no link."""
    prints = cut(fingerprints(df, id_col, text, words))
    classes = cut(prints.groupBy("f0").agg(F.min("id").alias("first")).withColumn("node", F.col("f0")))
    masks = [(m,) for m in cell_masks(group_count(classes.count(), radius), radius)]
    return named(prints, classes, links(classes.select("node", "f0"), radius, masks), ["f0"]).withColumnRenamed("f0", "fp")


def near_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """Rows (id, node, component_id): texts whose shingle sets have a Jaccard similarity of ``similarity`` or more link, no others.

    Pairs whose fingerprints differ in at most ``radius`` bits come from the grid, the rest from the prefix join; both
    are compared as sets. What links doesn't depend on the radius or on the input's size.
    """
    found = _near_rows(df, id_col, text, words, similarity, radius)
    return found.select("id", "node", F.col("least.id").alias("component_id"))


def _row_key(id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("bigint"), F.col(text).cast("string"))


def _near_rows(df: DataFrame, id_col: str, text: str, words: int, similarity: float, radius: int) -> DataFrame:
    """Rows (id, key, node, least): least is the smallest (id, key) of the component, null if none of its rows has an id."""
    keyed = df.select(F.col(id_col).cast("bigint").alias("id"), _row_key(id_col, text).alias("key"), F.col(text).cast("string").alias("text"))
    rows, uri = shingle_sets.write_sets(keyed, "id", "text", words, keep=["key"])
    rows = cut(rows)
    own = F.when(F.col("id").isNotNull(), F.struct("id", "key"))
    classes = cut(rows.groupBy("node").agg(F.min(own).alias("first"), F.first(F.struct("file", "at", "n", "fp")).alias("own")).select("node", "first", "own.*"))
    close = components(shingle_sets.close_links(classes, uri, similarity, radius))
    classes = cut(classes.join(close, "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component"))
    far = components(shingle_sets.far_links(classes, uri, similarity, radius)).withColumnRenamed("node", "known")
    discard(df.sparkSession, uri)
    members = classes.select("node", "first", "known").join(far, "known", "left").select("node", "first", F.coalesce("component", "known").alias("component"))
    least = cut(members.groupBy("component").agg(F.min("first").alias("least")))
    return rows.select("id", "key", "node").join(members.join(least, "component").select("node", "least"), "node", "left").select("id", "key", "node", "least")


def drop_near_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """The rows of ``df`` but for near copies: of each group one row stays, that of the smallest id.

    Rows without id stay. Ids may repeat: rows are told apart by id and text, so a text that is no near copy is never
    lost. Of rows with the same id and text the least in all columns (as JSON) stays.
    """
    refuse_columns(df.columns, ["__key", "__row"])
    found = cut(_near_rows(df, id_col, text, words, similarity, radius).filter("id is not null").select("key", F.col("least.key").alias("stays")))
    gone = found.filter("key <> stays").select(F.col("key").alias("__key")).distinct()
    twice = cut(found.filter("key = stays").groupBy(F.col("key").alias("__key")).count().filter("count > 1").select("__key"))
    keyed = df.withColumn("__key", F.when(F.col(id_col).isNotNull(), _row_key(id_col, text)))
    kept = keyed.join(_if_few(gone), "__key", "left_anti")
    if not twice.limit(1).count():
        return kept.drop("__key")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    once = kept.join(_if_few(twice), "__key", "left_semi").groupBy("__key").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return kept.join(_if_few(twice), "__key", "left_anti").drop("__key").unionByName(once)


def _if_few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else keys
