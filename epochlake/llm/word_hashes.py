"""Hashes of all words of many texts at once, straight from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .hash_arrays import mix

#: Bytes of text looked at together; a longer text is still taken whole.
CHUNK = 500_000
#: Rows looked at together, at most: row numbers inside a group fit 16 bits.
ROWS = 65_000
#: Hash of the token that ends each text, and of the context before its first word.
END, BEGIN = np.uint64(0x5EED_0E4D_0000_0001), np.uint64(0x5EED_0BE6_0000_0002)
BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    """Inverse of an odd number modulo 2**64, by Newton steps."""
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % (1 << 64)
    return x


class _Tables:
    def __init__(self):
        self.byte = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        lower = np.arange(256)
        lower[ord("A") : ord("Z") + 1] += 32
        self.value = self.byte[lower]
        self.in_word = np.ones(256, bool)
        self.in_word[[32, *range(9, 14)]] = False
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (BASE, np.uint64(_inverse(int(BASE)))))
        return self.up[:n], self.down[:n]


_TABLES: list[_Tables] = []


def token_chunks(texts: pa.Array, openings: tuple[int, ...] = ()) -> Iterator[tuple]:
    """(first row, row after the last, tokens, row of each token) of groups of texts; a null text is empty.

    Then, for each number of bytes in ``openings``, the hashes of the words' first bytes (0 for shorter words, the end).

    A word's hash is a polynomial of its lower-cased (A-Z) bytes, from one prefix sum over the whole group; each
    text ends with ``END``, so every row has at least one token.
    """
    if not _TABLES:
        _TABLES.append(_Tables())
    t = _TABLES[0]
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = min(len(texts), first + ROWS, max(first + 1, int(np.searchsorted(offset, offset[first] + CHUNK, "right")) - 1))
        raw, own = data[offset[first] : offset[last]], offset[first : last + 1] - offset[first]
        inside = t.in_word[raw]
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        heads = own[:-1][own[:-1] < own[1:]]
        before[heads] = False
        after[heads[1:] - 1] = False
        start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        up, down = t.powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(t.value[raw] * up[: len(raw)], out=total[1:])
        word = mix((total[stop] - total[start]) * down[start])
        row = np.searchsorted(own, start, "right") - 1
        token = np.full(len(word) + last - first, END, np.uint64)
        at = np.arange(len(word)) + row
        token[at] = word
        more = []
        for n in openings:
            enough = stop - start >= n
            opening = np.zeros(len(token), np.uint64)
            opening[at[enough]] = mix((total[start[enough] + n] - total[start[enough]]) * down[start[enough]])
            more.append(opening)
        yield first, last, token, np.repeat(np.arange(first, last), np.bincount(row, minlength=last - first) + 1), *more
        first = last
