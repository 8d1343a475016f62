"""Suffix-array dedup (operator 13): maximal repeats from the common-prefix interval tree of an enhanced suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or in another;
overlaps count, all copies go, and strings are judged on the input. Matches never cross texts.

The suffix array is sparse and lies in pieces, so that no task holds more than a bounded part of it:

* of each window of ``length`` bytes the least gram (hash of ``gram`` bytes, leftmost of equals) is its anchor. Equal
  windows have equal anchors at equal offsets, and neighbours share theirs: two anchors in some 140 bytes. Only anchors
  whose gram stands at two places are looked at. Equal texts are one text with a number of copies;
* an anchor's context is what its windows cover. Equal contexts are one class; a class of several occurrences is repeated as
  a whole. Classes of one gram are suffixes that begin with it: Spark sorts them by gram and what follows, which is the
  suffix array; neighbours' common prefixes enhance it;
* a scan with a stack builds the tree of common-prefix intervals. In each interval the members are ordered by what goes
  before them, read backwards; where neighbours there agree over ``depth`` bytes and the next byte differs (or the reach
  ends), the left extensions are diverse, and the members that agree are one maximal group: all occurrences of one string.
  A group of at least ``length`` bytes in all is repeated text of each of its members, not just of neighbours;
* a gram with more than ``group_rows`` classes is dealt by halves of the offsets that its windows have: a half's windows share
  a longer string, which is the new key, and contexts that agree over the half are one class again. At a single offset the key
  is the whole window, so every group ends below the bound and nothing is dropped.

A group's string reaches as far as the anchor's windows do (at most ``2 * length - gram`` bytes); longer repeats are chains of
overlapping groups, and spans are their union. Time per text grows with its bytes; a text of one repeated byte has an anchor
at each. Memory of a task: a batch of texts, or ``group_rows`` contexts.

Defined results: null text is empty; a text shorter than ``length`` keeps all, as does an empty one; equal texts of at least
``length`` bytes lose all, in every copy, repeated rows and null ids included; rows are never lost or merged. Extra columns are not read; internal
names start with ``__``. Bytes are judged, so a kept text need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fresh_path, partitions_of, small_batches
from .hash_arrays import mix

#: Bytes that a string must have to count as repeated.
LENGTH = 200
#: Classes of one gram that a task takes; a gram with more is dealt by offsets.
GROUP_ROWS = 4_000
#: Windows looked at together.
BLOCK = 1 << 16
#: Multiplier of the gram's polynomial.
BASE = 0x9E3779B97F4A7C15


def gram_of(length: int) -> int:
    """Bytes of an anchor's gram: the largest power of two up to a third of the length."""
    return 1 << max(0, (length // 3).bit_length() - 1)


# ---- in the tasks


def least_grams(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(place, first, last, hash): the windows that start from ``first`` to ``last`` have the gram at ``place`` as their least.

    ``ends`` are the places in ``data`` where texts end; windows that cross one are left out.
    """
    gram = gram_of(length)
    width, found = length - gram + 1, []
    for at in range(0, len(data) - length + 1, BLOCK):
        count = min(BLOCK, len(data) - length + 1 - at)
        h = data[at : at + count + length - 1].astype(np.uint64) + np.uint64(1)
        size, power = 1, BASE
        while size < gram:
            h = h[:-size] * np.uint64(power) + h[size:]
            size, power = 2 * size, power * power % (1 << 64)
        h = mix(h)
        value, arg, span = (h >> np.uint64(32)).astype(np.uint32), np.arange(len(h), dtype=np.int32), 1
        while span < width:
            step = min(span, width - span)
            arg = np.where(value[step:] < value[:-step], arg[step:], arg[:-step])
            value = np.minimum(value[step:], value[:-step])
            span += step
        for end in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + count + length - 1)]:
            arg[max(end - at - length + 1, 0) : end - at] = -1
        edge = np.flatnonzero(np.diff(arg, prepend=-2))
        last = np.append(edge[1:], count) - 1
        edge, last = edge[arg[edge] >= 0], last[arg[edge] >= 0]
        found.append((arg[edge].astype(np.int64) + at, edge + at, last + at, h[arg[edge]]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    place, first, last, value = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.flatnonzero(np.diff(place, prepend=-1))  # a block's first windows may go on with the anchor before
    return place[new], first[new], np.append(last[new[1:] - 1], last[-1:]) if len(new) else last, value[new]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each text begins (and the last one ends)."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def named(string: bytes) -> bytes:
    """The name of a string, as ``digest`` gives it in Spark."""
    return hashlib.sha256(string).digest()[:16]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def intervals(prefixes: list[int], ranks: list[int]) -> Iterator[tuple[int, list[list[int]]]]:
    """The tree of common-prefix intervals, leaves first: (depth, ranks of each child in order).

    ``prefixes[i]`` is the common prefix of the suffixes i and i + 1; ``ranks`` are the suffixes' ranks by what goes before.
    """
    open_: list[tuple[int, list[list[int]]]] = []
    for i, rank in enumerate(ranks):
        child, depth = [rank], prefixes[i] if i < len(prefixes) else -1
        while open_ and open_[-1][0] > depth:
            own, children = open_.pop()
            children.append(child)
            yield own, children
            child = sorted(r for c in children for r in c)
        if open_ and open_[-1][0] == depth:
            open_[-1][1].append(child)
        else:
            open_.append((depth, [child]))


class Least:
    """Least value of any stretch of a list, from tables of powers of two."""

    def __init__(self, values: list[int]):
        self.tables = [np.asarray(values, np.int64)]
        while 2 << len(self.tables) - 1 <= len(values):
            t, half = self.tables[-1], 1 << len(self.tables) - 1
            self.tables.append(np.minimum(t[:-half], t[half:]))

    def of(self, first: np.ndarray, upto: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), np.int64)
        level = np.frexp(upto - first)[1] - 1
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.tables[k][first[own]], self.tables[k][upto[own] - (1 << k)])
        return out


class Suffixes:
    """The enhanced suffix array of one gram: contexts in order of what follows, and their order by what goes before."""

    def __init__(self, rights: list[bytes], lefts: list[bytes], length: int):
        self.length = length
        self.prefixes = [common(a, b) for a, b in zip(rights, rights[1:], strict=False)]
        self.by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
        self.left_prefixes = [common(lefts[a], lefts[b]) for a, b in zip(self.by_left, self.by_left[1:], strict=False)]
        self.ranks = [0] * len(lefts)
        for rank, i in enumerate(self.by_left):
            self.ranks[i] = rank
        self.most = max(self.left_prefixes, default=0)
        self.least = Least(self.left_prefixes) if len(lefts) > 48 else None

    def agreeing(self) -> Iterator[tuple[int, list[list[int]], list[int], list[int]]]:
        """(depth, children, ranks in order, bytes that neighbours there agree over to the left) of each interval that can hold a group."""
        for depth, children in intervals(self.prefixes, self.ranks):
            if depth + self.most < self.length:
                continue
            order = sorted(r for c in children for r in c)
            if self.least is None:
                gaps = [min(self.left_prefixes[a:b]) for a, b in zip(order, order[1:], strict=False)]
            else:
                places = np.asarray(order)
                gaps = self.least.of(places[:-1], places[1:]).tolist()
            yield depth, children, order, gaps

    def reach(self) -> tuple[list[int], list[int]]:
        """Bytes to the left and to the right of each context's anchor that its groups cover; zero where none does.

        All groups of a context hold its anchor, so their union is one stretch.
        """
        left, right = [0] * len(self.ranks), [0] * len(self.ranks)
        for depth, _, order, gaps in self.agreeing():
            need = self.length - depth
            for k, gap in enumerate(gaps):
                if gap >= need:
                    for i in (self.by_left[order[k]], self.by_left[order[k + 1]]):
                        left[i], right[i] = max(left[i], gap), max(right[i], depth)
        return left, right

    def groups(self) -> Iterator[tuple[int, int, list[int]]]:
        """(bytes to the left, to the right, members) of each maximal group: diverse on both sides."""
        for depth, children, order, gaps in self.agreeing():
            child = {r: k for k, c in enumerate(children) for r in c}
            for before, parts in intervals(gaps, order):
                members = [r for p in parts for r in p]
                if before + depth >= self.length and len({child[r] for r in members}) > 1:
                    yield before, depth, sorted(self.by_left[r] for r in members)


#: Columns of a context: its gram or part of one, the text's digest, the anchor's place there, whether it stands only there, bytes before the anchor.
CONTEXT = "node bigint, d binary, pos bigint, single boolean, l int, context binary"


def _array_scan(length: int, with_groups: bool):
    """Rows in order of (node, what follows the anchor) to what the groups cover, a row per context, or to the groups' members."""

    def done(node, rows):
        rights, lefts = [c[l:] for _, _, _, l, c in rows], [c[:l][::-1] for _, _, _, l, c in rows]
        array = Suffixes(rights, lefts, length)
        if with_groups:
            for left, right, members in array.groups():
                _, _, _, l, context = rows[members[0]]
                name = named(context[l - left : l + right])
                yield from ((name, left + right, node, rows[i][0], rows[i][1], left) for i in members)
            return
        for (d, pos, single, _, _), left, right in zip(rows, *array.reach(), strict=True):
            if single and right:
                yield d, pos - left, pos + right

    schema = pa.schema([("name", pa.binary()), ("n_bytes", pa.int64()), ("node", pa.int64()), ("d", pa.binary()), ("pos", pa.int64()), ("l", pa.int64())] if with_groups else [("d", pa.binary()), ("start", pa.int64()), ("upto", pa.int64())])

    def run(batches):
        node, rows, out = None, [], []
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    out += done(node, rows)
                    node, rows = key, []
                rows.append(row)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if rows:
            out += done(node, rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


# ---- with Spark


def digest(text: Column) -> Column:
    """16 bytes of SHA-256: the name of a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


class Repeats:
    """Distinct texts, their anchors and the contexts' classes, as tables in the shared folder."""

    def __init__(self, docs: DataFrame, text: str = "text", length: int = LENGTH, group_rows: int = GROUP_ROWS):
        if length < 3:
            raise ValueError("length must be 3 at least")
        self.spark, self.length, self.group_rows = docs.sparkSession, length, group_rows
        self.folders: list[str] = []
        small_batches(self.spark)
        whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
        texts = docs.select(digest(whole).alias("d"), whole.alias("text")).groupBy("d").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        # Bucketed by name: the joins below move places to the texts, never the texts.
        name = "epochlake_" + (path := self._path("suffix-texts")).rsplit("-", 1)[1]
        texts.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(partitions_of(self.spark), "d").saveAsTable(name)
        self.texts = self.spark.table(name)
        anchors = self._written(self.texts.filter(F.octet_length("text") >= length).select("d", "text").mapInArrow(_anchors(length), "h bigint, d binary, pos bigint, l int, r int"), "suffix-anchors")
        # Written, so that Spark shuffles both sides for the join alone and can split a gram that stands very often.
        often = cut(anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
        places = anchors.join(often, "h").groupBy("d").agg(F.collect_list(F.struct("h", "pos", "l", "r")).alias("places"))
        schema = "h bigint, class binary, d binary, pos bigint, l int, r int"
        self.places = self._written(self._with_texts(places).mapInArrow(_classes, schema), "suffix-places")
        named = F.min(F.struct("d", "pos", "l", "r")).alias("one")
        self.classes = self._written(self.places.groupBy("class").agg(F.first("h").alias("h"), F.count("*").alias("n"), named), "suffix-classes")

    def _path(self, name: str) -> str:
        self.folders.append(fresh_path(self.spark, name))
        return self.folders[-1]

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path := self._path(name))
        return self.spark.read.schema(df.schema).parquet(path)

    def _with_texts(self, places: DataFrame) -> DataFrame:
        return self.texts.select("d", "text").join(places, "d").select("d", "text", "places")

    def _contexts(self, classes: DataFrame) -> DataFrame:
        own = F.struct("h", (F.col("n") == 1).alias("single"), "one.pos", "one.l", "one.r")
        return self._with_texts(classes.groupBy("one.d").agg(F.collect_list(own).alias("places"))).mapInArrow(_cut_out, CONTEXT)

    def contexts(self) -> Iterator[tuple[DataFrame, DataFrame | None, list[DataFrame]]]:
        """One triple a round of dealing: contexts of groups within the bound, stretches that are settled by then, and maps.

        Maps (node, d1, pos1, up, d, pos) lead from the anchor that stands for a class in a node to all of the class and
        their node of the round before; the last map comes first.
        """
        several = self.classes.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
        hot = cut(several.filter(F.col("m") > self.group_rows).select("h"))
        ones = self.classes.select("class", F.col("one.d").alias("d1"), F.col("one.pos").alias("pos1"))
        maps = [self.places.select("class", F.col("h").alias("node"), F.col("h").alias("up"), "d", "pos").join(ones, "class").drop("class")]
        yield self._contexts(self.classes.join(several.filter(F.col("m") <= self.group_rows).select("h"), "h", "left_semi")), None, maps
        if not hot.isEmpty():
            span = self.length - gram_of(self.length)
            rows = self._contexts(self.classes.join(hot, "h", "left_semi")).select("*", F.lit(0).alias("a"), F.lit(span).alias("b"))
            while rows is not None:
                rows, maps = yield from self._dealt(rows, maps)

    def _dealt(self, rows: DataFrame, maps: list[DataFrame]):
        """One round for crowded nodes: halves of the offsets, equal contexts as one, and what is still crowded."""
        reach, n = F.octet_length("context") - F.col("l"), self.length
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        half = F.explode(F.array(F.struct("a", middle.alias("b")), F.struct((middle + 1).alias("a"), "b"))).alias("half")
        halves = rows.select("node", "d", "pos", "single", "l", "context", reach.alias("r"), half).filter("half.a <= half.b")
        halves = halves.withColumns({"low": F.greatest("half.a", n - F.col("r")), "high": F.least("half.b", "l")}).filter("low <= high")
        key = F.substring("context", F.col("l") - F.col("half.a") + 1, F.col("half.a") + n - F.col("half.b"))
        context = F.substring("context", F.col("l") - F.col("high") + 1, F.col("high") + n - F.col("low"))
        halves = halves.select(F.col("node").alias("up"), F.xxhash64("node", "half.a", key).alias("node"), "d", "pos", "single", F.col("high").alias("l"), context.alias("context"), "half.a", "half.b")
        halves = self._written(halves.withColumn("class", digest(F.col("context"))), "suffix-halves")
        firsts = [F.first(c).alias(c) for c in ("l", "context", "a", "b")]
        one = F.min(F.struct("d", "pos")).alias("one")
        merged = self._written(halves.groupBy("node", "class").agg(((F.count("*") == 1) & F.bool_and("single")).alias("single"), one, *firsts), "suffix-merged")
        ones = merged.select("node", "class", (~F.col("single")).alias("several"), F.col("one.d").alias("d1"), F.col("one.pos").alias("pos1"))
        members = halves.join(ones, ["node", "class"])
        settled = members.filter("several").select(F.col("class").alias("name"), F.octet_length("context").cast("bigint").alias("n_bytes"), F.col("up").alias("node"), "d", "pos", F.col("l").cast("bigint").alias("l"), "single")
        maps = [members.select("node", "d1", "pos1", "up", "d", "pos"), *maps]
        counts = merged.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1")
        hot = cut(counts.filter(F.col("m") > self.group_rows).select("node"))
        merged = merged.select("node", "one.d", "one.pos", "single", "l", "context", "a", "b")
        yield merged.join(counts.filter(F.col("m") <= self.group_rows).select("node"), "node", "left_semi").drop("a", "b"), settled, maps
        return (None if hot.isEmpty() else merged.join(hot, "node", "left_semi")), maps

    def _scanned(self, contexts: DataFrame, with_groups: bool) -> DataFrame:
        follows = F.substring("context", F.col("l") + 1, F.octet_length("context"))
        array = contexts.repartition("node").withColumn("follows", follows).sortWithinPartitions("node", "follows").drop("follows")
        schema = "name binary, n_bytes bigint, node bigint, d binary, pos bigint, l bigint" if with_groups else "d binary, start bigint, upto bigint"
        return array.select("node", "d", "pos", "single", "l", "context").mapInArrow(_array_scan(self.length, with_groups), schema)

    def spans(self) -> DataFrame:
        """Stretches (d, start, upto) of distinct texts that repeat between them; they may overlap."""
        start = F.col("pos") - F.col("l")
        often = self.classes.filter("n > 1").select("class")
        found = self.places.join(often, "class", "left_semi").select("d", start.alias("start"), (F.col("pos") + F.col("r")).alias("upto"))
        for contexts, settled, _ in self.contexts():
            found = found.unionByName(self._scanned(contexts, False))
            if settled is not None:
                found = found.unionByName(settled.filter("single").select("d", start.alias("start"), (start + F.col("n_bytes")).alias("upto")))
        return found

    def groups(self) -> DataFrame:
        """Maximal groups as rows (name, n_bytes, d, start): all occurrences of each string, in distinct texts."""
        rows = ["name", "n_bytes", "node", "d", "pos", "l"]
        size = (F.col("l") + F.col("r")).cast("bigint").alias("n_bytes")
        often = self.places.join(self.classes.filter("n > 1").select("class"), "class", "left_semi")
        found = often.select(F.col("class").alias("name"), size, F.col("h").alias("node"), "d", "pos", F.col("l").cast("bigint").alias("l"))
        for contexts, settled, maps in self.contexts():
            got = self._scanned(contexts, True)
            for k, map_ in enumerate(maps):
                got = got.withColumnsRenamed({"d": "d1", "pos": "pos1"}).join(map_, ["node", "d1", "pos1"]).select("name", "n_bytes", F.col("up").alias("node"), "d", "pos", "l")
                got = got if settled is None or k else got.unionByName(settled.select(rows))
            found = found.unionByName(got)
        return found.select("name", "n_bytes", "d", (F.col("pos") - F.col("l")).alias("start")).distinct()

    def discard(self) -> None:
        for path in self.folders:
            discard(self.spark, path)


def _anchors(length: int):
    def run(batches):
        for batch in batches:
            data, at = bytes_of(batch.column(1))
            place, first, last, value = least_grams(data, at[1:], length)
            row = np.searchsorted(at, place, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(value.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(place - at[row]),
                    pa.array((place - first).astype(np.int32)), pa.array((last + length - place).astype(np.int32)),
                ],
                names=["h", "d", "pos", "l", "r"],
            )

    return run


def _pieces(batch) -> tuple[list[bytes], pa.StructArray, pa.Array]:
    """Contexts of all places of a batch (d, text, places), the places in one array and their texts' names."""
    places, made = batch.column(2).flatten(), []
    counts = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
    pos, left, right = (places.field(c).to_numpy() for c in ("pos", "l", "r"))
    first, upto, at = (pos - left).tolist(), (pos + right).tolist(), 0
    for text, n in zip(batch.column(1), counts.tolist(), strict=True):
        whole = text.as_py()
        made += [whole[a:b] for a, b in zip(first[at : at + n], upto[at : at + n], strict=True)]
        at += n
    return made, places, batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))


def _classes(batches):
    """Anchors' contexts by name. A context settles where its anchor stands: that is the least gram of its first window."""
    for batch in batches:
        made, places, d = _pieces(batch)
        columns = [places.field("h"), pa.array([named(c) for c in made], pa.binary()), d, *(places.field(c) for c in ("pos", "l", "r"))]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "class", "d", "pos", "l", "r"])


def _cut_out(batches):
    """The contexts themselves."""
    for batch in batches:
        made, places, d = _pieces(batch)
        columns = [places.field("h"), d, places.field("pos"), places.field("single"), places.field("l"), pa.array(made, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "d", "pos", "single", "l", "context"])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of stretches that overlap or touch."""
    runs: list[tuple[int, int]] = []
    for first, upto in sorted(spans):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(upto, runs[-1][1]))
        else:
            runs.append((first, upto))
    return runs


def _left_over(batches):
    """Texts (d, text, spans) to what is left of them."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("upto", pa.int64())]))
    for batch in batches:
        flat, at, out = batch.column(2).flatten(), 0, []
        spans = list(zip(flat.field("start").to_pylist(), flat.field("upto").to_pylist(), strict=True))
        for text, n in zip(batch.column(1), pc.list_value_length(batch.column(2)).to_pylist(), strict=True):
            whole, removed = text.as_py(), union(spans[at : at + n])
            borders = [0, *(x for run in removed for x in run), len(whole)]
            kept = b"".join(whole[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))
            out.append((len(whole), [{"start": a, "upto": b} for a, b in removed], kept))
            at += n
        size, where, kept = zip(*out, strict=True) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(where, kind), pa.array(kept, pa.binary())], names=["d", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row (id, n_bytes, spans, kept) per row of ``docs``: ``spans`` (start, upto) are the removed runs, ``kept`` the remaining bytes."""
    found = Repeats(docs, text, length, group_rows)
    spans = found.spans().groupBy("d").agg(F.collect_list(F.struct("start", "upto")).alias("spans"))
    size = F.octet_length("text").cast("bigint")
    whole = F.when((F.col("copies") > 1) & (size >= length), F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("upto"))))
    none = F.array().cast("array<struct<start:bigint,upto:bigint>>")
    texts = found.texts.join(spans, "d", "left").select("d", "text", F.coalesce(whole, "spans", none).alias("spans"))
    left = texts.mapInArrow(_left_over, "d binary, n_bytes bigint, spans array<struct<start:bigint,upto:bigint>>, kept binary")
    names = docs.select(F.col(id_col).alias("id"), digest(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("d"))
    return names.join(left, "d").drop("d")


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Maximal repeat groups: rows (name, n_bytes, id, start), one per occurrence of the string, in every copy of a text.

    Only repeats between different texts, or inside one, are groups; that a text has copies is seen from their ids.
    """
    found = Repeats(docs, text, length, group_rows)
    names = docs.select(F.col(id_col).alias("id"), digest(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("d"))
    return found.groups().join(names, "d").select("name", "n_bytes", "id", "start")

