"""Benchmark decontamination (operator 2): q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised alike: letters and digits in lower case, all else one space. An item of m
characters occurs where some stretch of a document is within k = ``edit_rate`` * m edits of the whole item. By the q-gram
lemma such a stretch shares at least m - q + 1 - k * q q-grams with the item, on diagonals (place in the document less place in the
item) that lie within k of each other. Shared q-grams are counted, text by text, in overlapping bands of diagonals, twice k + 1
wide and k + 1 apart, so each occurrence lies whole in one band; bands that reach the bound are verified by an alignment
confined to the band (widened by k on both sides) and to the text. An item's q is ``q``, or less where the bound would be under 1.

Tasks index the items in blocks of ``BLOCK_CHARS`` and write sorted arrays to the shared folder; workers map them. Documents
are scanned once, whole, by arrays over ``CHUNK`` characters of text at a time, without a shuffle; hits are expanded in
slices of ``HITS``, so an item's or a q-gram's frequency doesn't bound memory. A text of n characters takes some 70 n bytes.

Defined results: an item of fewer than q normalised characters would stand in most texts; it matches a document whose
whole normalised text equals it, and nothing else. Items without letters and digits, null and empty texts match nothing.
Equal items each match; an item without id matches like any other, with a null item_id; a repeated row has its own
matches. Whether a text matches doesn't depend on its neighbours. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, small_batches
from .hash_arrays import map_file, mix, put_file, worker_cache
from .word_hashes import BASE, _inverse

Q = 10
EDIT_RATE = 0.06
#: Characters of benchmark text per block of items, about.
BLOCK_CHARS = 2_000_000
#: Characters of documents looked at together; a longer document is still taken whole.
CHUNK = 400_000
#: Shared q-grams expanded together; cells of alignments computed together.
HITS, CELLS = 2_000_000, 200_000
FILTER_BITS = 22
SPACE, GAP = 32, 0
ROWS = "id bigint, item_id bigint, edits bigint, start bigint, end bigint"
#: The arrays of an index and their types.
ARRAYS = {"keys": "<u8", "first": "<i8", "item": "<i4", "place": "<i4", "filter": "?", "code": "<u4", "bounds": "<i8", "edits": "<i8", "ids": "<i8", "named": "?"}
_CODES: list[np.ndarray] = []
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def codes() -> np.ndarray:
    """Code of each code point: letters and digits in lower case, a space for all else."""
    if not _CODES:
        out = np.full(0x110000, SPACE, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalnum():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _CODES.append(out)
    return _CODES[0]


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes with a GAP before each text, text number of each, place in the original text of each)."""
    parts = [t or "" for t in texts]
    code = codes()[np.frombuffer("".join("\x00" + t for t in parts).encode("utf-32-le"), "<u4")]
    heads = np.cumsum([0] + [len(t) + 1 for t in parts])[:-1]
    code[heads] = GAP
    row = np.zeros(len(code), np.int32)
    row[heads[1:]] = 1
    row = np.cumsum(row)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != SPACE) | ((code[:-1] != SPACE) & (code[:-1] != GAP))
    at = np.flatnonzero(keep)
    return code[at], row[at], at - heads[row[at]] - 1


def normal_items(texts: list[str | None]) -> list[np.ndarray]:
    """Codes of each text without spaces at its ends."""
    code, row, _ = normalised(texts)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    own = [code[bounds[k] + 1 : bounds[k + 1]] for k in range(len(texts))]
    return [t[:-1] if len(t) and t[-1] == SPACE else t for t in own]


def qgrams(code: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place on (the last q - 1 places have none)."""
    n = len(code) + 1
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS[:] = [tuple(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (BASE, np.uint64(_inverse(int(BASE)))))]
    up, down = _POWERS[0]
    total = np.zeros(n, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0xD6E8FEB86659FD93) * up[: n - 1], out=total[1:])
    return mix((total[q:] - total[:-q]) * down[: max(n - q, 0)]) if n > q else np.zeros(0, np.uint64)


def gram_size(m: int, q: int, edits: int) -> int:
    """The item's q: ``q``, or the largest that leaves the bound m - q + 1 - edits * q at 1 or more; 0 for whole matches."""
    return min(q, m // (edits + 1)) if m >= q else 0


def make_index(items: list[tuple[int | None, np.ndarray]], q: int, edit_rate: float) -> dict[str, np.ndarray]:
    """The arrays of an index of items that go by one q (0: whole matches), given as (id, codes)."""
    texts = [t for _, t in items]
    size = np.array([len(t) for t in texts], np.int64)
    grams = [qgrams(t, q) if q else qgrams(t, len(t)) for t in texts]
    key = np.concatenate([*grams, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    some = np.zeros(1 << FILTER_BITS, bool)
    some[keys >> np.uint64(64 - FILTER_BITS)] = True
    return {
        "keys": keys, "first": np.append(first, len(key)), "item": item[order], "place": place[order], "filter": some, "code": np.concatenate([*texts, np.zeros(0, np.uint32)]), "bounds": np.concatenate([[0], np.cumsum(size)]),
        "edits": (size * edit_rate).astype(np.int64), "ids": np.array([-1 if i is None else i for i, _ in items], np.int64), "named": np.array([i is not None for i, _ in items], bool),
    }


def indexes_of(items: list[tuple[int | None, str | None]], q: int, edit_rate: float) -> dict[int, dict[str, np.ndarray]]:
    """An index for each q that the items go by."""
    by_q: dict[int, list] = {}
    for (i, _), t in zip(items, normal_items([t for _, t in items]), strict=True):
        if len(t):
            by_q.setdefault(gram_size(len(t), q, int(len(t) * edit_rate)), []).append((i, t))
    return {k: make_index(own, k, edit_rate) for k, own in sorted(by_q.items())}


class Index:
    """Read side of an index's arrays."""

    def __init__(self, q: int, arrays: dict[str, np.ndarray]):
        self.q, self.filter = q, arrays["filter"]
        self.keys, self.first, self.item, self.place = (arrays[x] for x in ("keys", "first", "item", "place"))
        self.code, self.bounds, self.edits, self.ids, self.named = (arrays[x] for x in ("code", "bounds", "edits", "ids", "named"))
        self.size = np.diff(self.bounds)
        self.least = self.size - q + 1 - self.edits * q

    def name(self, item: int) -> int | None:
        return int(self.ids[item]) if self.named[item] else None

    def shared(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the codes, place among the keys) of each q-gram that some item has."""
        at = np.flatnonzero(self.filter[gram >> np.uint64(64 - FILTER_BITS)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.minimum(np.searchsorted(self.keys, gram[at]), len(self.keys) - 1)
        same = self.keys[where] == gram[at]
        return at[same], where[same]

    def candidates(self, gram: np.ndarray, row: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, text, first place of the band's lowest diagonal) of each band that reaches its item's bound.

        ``head`` holds where each text's characters start, and where the codes end.
        """
        at, where = self.shared(gram)
        texts, out = len(head) - 1, []
        span = int(np.diff(head).max(initial=0) + self.size.max(initial=0)) + 3
        times = self.first[where + 1] - self.first[where]
        total = np.cumsum(times)
        key, count, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while done < len(at):
            last = max(done + 1, int(np.searchsorted(total, total[done] - times[done] + HITS, "right")))
            n, a = times[done:last], at[done:last]
            entry = np.repeat(self.first[where[done:last]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, item = np.repeat(a, n), self.item[entry].astype(np.int64)
            text = row[a]
            low = (a - head[text] - self.place[entry] + self.size[item]) // (self.edits[item] + 1)  # diagonals from 0 on
            fresh = (item * texts + text) * span + low + 1
            both = np.concatenate([key, fresh, fresh - 1])
            weight = np.concatenate([count, np.ones(2 * len(fresh), np.int64)])
            order = np.argsort(both, kind="stable")
            both, weight = both[order], weight[order]
            heads = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            key, count = both[heads], np.add.reduceat(weight, heads)
            done = last
            item, text, low = key // span // texts, key // span % texts, key % span - 1
            start = head[text] + low * (self.edits[item] + 1) - self.size[item]
            reach = start + 2 * (self.edits[item] + 1) + self.size[item]  # no q-gram of the band starts here or later
            over = np.ones(len(key), bool) if done == len(at) else reach <= at[done]
            good = over & (count >= self.least[item])
            out.append((item[good], text[good], start[good]))
            key, count = key[~over], count[~over]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def whole(self, code: np.ndarray, head: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, 0, start, end) of each text that is an item, for items that only match whole texts."""
        out, longest = [], int(self.size.max(initial=0))
        for text in np.flatnonzero(np.diff(head) <= longest + 2).tolist():
            a, b = int(head[text]), int(head[text + 1]) - (text + 2 < len(head))
            b -= b > a and code[b - 1] == SPACE
            if b > a:
                where = self.shared(qgrams(code[a:b], b - a))[1]
                for k in np.concatenate([self.item[self.first[w] : self.first[w + 1]] for w in where] or [[]]).astype(int).tolist():
                    if np.array_equal(self.code[self.bounds[k] : self.bounds[k + 1]], code[a:b]):
                        out.append((text, k, 0, a, b))
        return out


def align(index: Index, item: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, edits: int, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """(which, edits, start, end) of the best stretch of each candidate that stays within ``edits``; start and end are places in ``code``.

    A candidate is an item and a band of diagonals from place ``first`` on, in a text that stands from ``low`` to ``high``. The
    stretch lies in the text. Candidates whose every cell exceeds the budget are given up on the way.
    """
    width = 4 * edits + 2
    one, big = np.int64(1) << 24, np.int64(1) << 48
    d = np.arange(width, dtype=np.int64)
    who = np.argsort(-index.size[item], kind="stable")
    size, base = index.size[item[who]], index.bounds[item[who]]
    low, high, reach = low[who, None], high[who, None], first[who, None] + d
    v = np.where((reach >= low) & (reach <= high), d, big)  # cost << 24 | diagonal of the start
    out, i = [], 0
    while len(who):
        live = int(np.searchsorted(-size, -i))  # those longer than i
        if live < len(who):
            best = v[live:].argmin(axis=1)
            cost = v[live:][np.arange(len(best)), best]
            good = (cost >> 24) <= edits
            begin = reach[live:, 0] + (cost & (one - 1))
            out.append((who[live:][good], (cost >> 24)[good], begin[good], (reach[live:, 0] + size[live:] + best)[good]))
        if live < len(who) or i % 16 == 15:
            keep = np.flatnonzero((v[:live] >> 24).min(axis=1) <= edits)
            who, size, base, low, high, reach, v = (x[keep] for x in (who, size, base, low, high, reach, v))
            if not len(who):
                break
        at = reach + i
        inside = (at >= low) & (at < high)
        same = code[np.where(inside, at, 0)] == index.code[base + i][:, None]
        step = np.where(inside, v + np.where(same, np.int64(0), one), big)
        step[:, :-1] = np.minimum(step[:, :-1], v[:, 1:] + one)
        v = np.minimum.accumulate(step - d * one, axis=1) + d * one  # further characters of the document in between
        v[(at + 1 < low) | (at + 1 > high)] = big
        v = np.minimum(v, big)
        i += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def find(texts: list[str | None], indexes: list[Index]) -> list[tuple[int, int | None, int, int, int]]:
    """(text number, item id, edits, start, end) of each occurrence; start and end are characters of the text."""
    code, row, origin = normalised(texts)
    head = np.append(np.searchsorted(row, np.arange(len(texts))) + 1, len(code))
    grams: dict[int, np.ndarray] = {}
    out = []
    for index in indexes:
        if not index.q:
            out += [(r, index.name(k), n, int(origin[a]), int(origin[b - 1]) + 1) for r, k, n, a, b in index.whole(code, head)]
            continue
        if index.q not in grams:
            grams[index.q] = qgrams(code, index.q)
        item, text, first = index.candidates(grams[index.q], row, head)
        found = []
        for edits in np.unique(index.edits[item]).tolist():
            own = np.flatnonzero(index.edits[item] == edits)
            for part in np.array_split(own, len(own) * (4 * edits + 2) // CELLS + 1):
                high = head[text[part] + 1] - (text[part] + 2 < len(head))
                which, cost, start, end = align(index, item[part], head[text[part]], high, first[part] - edits, edits, code)
                found += zip(text[part][which].tolist(), item[part][which].tolist(), end.tolist(), cost.tolist(), start.tolist(), strict=True)
        last: tuple | None = None
        for hit in [*sorted(x for x in found if x[2] > x[4]), None]:
            if last and hit and hit[:2] == last[:2] and hit[4] < last[2]:  # the same stretch, seen in a neighbouring band
                last = min(last, hit, key=lambda x: (x[3], x[4], x[2]))
                continue
            if last:
                r, k, b, c, a = last
                out.append((r, index.name(k), c, int(origin[a]), int(origin[b - 1]) + 1))
            last = hit
    return out


def text_groups(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= CHUNK):
            size += len(texts[last] or "")
            last += 1
        yield first, texts[first:last]
        first = last


class Indexes:
    """Where a benchmark's indexes lie; small and picklable. Workers map the arrays once."""

    def __init__(self, uri: str, parts: list[tuple[int, int]]):
        self.uri, self.parts = uri, parts

    def open(self) -> list[Index]:
        return worker_cache(self.uri, lambda: [Index(q, {x: map_file(f"{self.uri}/{b:06d}-{q}.{x}", kind) for x, kind in ARRAYS.items()}) for b, q in self.parts])


def write_indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", q: int = Q, edit_rate: float = EDIT_RATE) -> Indexes:
    """Index the items, a block a task; only the blocks' numbers reach the driver."""
    uri = fresh_path(benchmark.sparkSession, "benchmark-index")
    rows = benchmark.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    blocks = max(1, -(-(rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // BLOCK_CHARS))

    def build(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        items = sorted(zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        made = indexes_of(items, q, edit_rate)
        for k, arrays in made.items():
            for x, kind in ARRAYS.items():
                put_file(f"{uri}/{block:06d}-{k}.{x}", arrays[x].astype(kind))
        return pa.table({"block": pa.array([block] * len(made), pa.int32()), "q": pa.array(list(made), pa.int32())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    return Indexes(uri, sorted(tuple(r) for r in dealt.groupBy("block").applyInArrow(build, "block int, q int").collect()))


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, edit_rate: float = EDIT_RATE) -> DataFrame:
    """Rows (id, item_id, edits, start, end): each stretch of a document that is within the budget of a benchmark item."""
    small_batches(df.sparkSession)
    indexes = write_indexes(benchmark, item_id, item_text, q, edit_rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(ids[first + r], *rest) for first, part in text_groups(texts) for r, *rest in find(part, indexes.open())]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "item_id", "edits", "start", "end"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, ROWS)


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, edit_rate: float = EDIT_RATE) -> DataFrame:
    """The rows of ``df`` whose text holds no benchmark item, all columns unchanged."""
    small_batches(df.sparkSession)
    indexes = write_indexes(benchmark, item_id, item_text, q, edit_rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            good = np.ones(batch.num_rows, bool)
            for first, part in text_groups(texts):
                for r, *_ in find(part, indexes.open()):
                    good[first + r] = False
            yield batch.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)
