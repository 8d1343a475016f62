"""Periodic run detection (operator 11): a dictionary of basic factors over the words of each text.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), which has at least
``max(least, times * q)`` words and which no neighbouring word extends with that period.

* dictionary of basic factors: each stretch of 2^k words has a number, equal stretches of one text have equal numbers; those of
  2^(k+1) words are pairs of those of 2^k. Stretches that stand once in their text are left out from there on, so ordinary
  prose ends after a few levels;
* proposals: at level k the next occurrence of a stretch is looked at if both lie within twice its length, that is at a
  distance p of at most 2^k. The occurrences of one stretch so near to each other are an arithmetic progression, whose step is
  the period it proposes. A period belongs to the one level with 2^(k-1) < p <= 2^k: there the stretch holds a whole period, so inside
  a run no occurrence comes earlier, and each place of the run but its last p + 2^k words proposes the same p;
* extension: neighbouring places that propose the same p are one stretch of period p, which ends where words p apart
  differ: it is maximal, and its smallest period is p;
* deduplication: each run comes from one level once; what is shorter than the rule asks goes.

Three times the period is needed at least (``times >= 3``): then a run shows itself at its level. Texts are independent, so tasks
take batches of them as they lie; no shuffle, memory of a batch or of one text. Time is n log n per level of a text of n words.

Defined results: null, empty and blank texts have no words and no runs; equal texts have equal results; a repeated row is
another row; ids may be null or repeated. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, words

#: Words a run has at least, and how often its period.
LEAST, TIMES = 24, 3
#: Bytes of text cut into words at once, and words of texts looked at together (one text is always taken whole).
PIECE, TOGETHER = 1 << 20, 1 << 20
BREAK = re.compile(rb"[\x20\x09-\x0D]")


def word_numbers(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of a text's words in order, and the distinct words."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        border = BREAK.search(text, min(at + PIECE, len(text)))
        upto = border.end() if border else len(text)
        # Without an argument, bytes are split at exactly the six bytes that separate words.
        parts.append(np.array([known.setdefault(w, len(known)) for w in text[at:upto].split()], np.int64))
        at = upto
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), list(known)


def runs_of(names: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs in texts laid end to end, by start and period. Texts share no numbers."""
    n = len(names)
    longest = int(np.diff(ends, prepend=0).max(initial=0))
    end_of = np.repeat(ends, np.diff(ends, prepend=0))
    places, key, found, k = np.arange(n), names, [], 0
    while len(places) and times * ((1 << k) // 2 + 1) <= longest:
        size = 1 << k
        order = np.argsort(key, kind="stable")
        ordered, at = key[order], places[order]
        same = ordered[1:] == ordered[:-1]
        # Successor occurrences within twice the length; smaller steps belong to lower levels.
        step = at[1:] - at[:-1]
        near = same & (step <= size) & (2 * step > size)
        first, period = at[:-1][near], step[near]
        by_place = np.argsort(first, kind="stable")
        first, period = first[by_place], period[by_place]
        if len(first):
            opens = np.flatnonzero(np.append(True, (np.diff(first) != 1) | (np.diff(period) != 0)))
            closes = np.append(opens[1:], len(first)) - 1
            p = period[opens]
            length = first[closes] - first[opens] + p + size
            good = length >= np.maximum(least, times * p)
            found.append(np.stack([first[opens], length, p], axis=1)[good])
        # The next level's stretches are pairs of stretches that stand more than once.
        number = np.append(0, np.cumsum(~same))
        often = np.append(False, same) | np.append(same, False)
        table = np.full(n, -1)
        table[at[often]] = number[often]
        places = np.sort(at[often])
        places = places[places + 2 * size <= end_of[places]]
        places = places[table[places + size] >= 0]
        key = table[places] * (number[-1] + 1) + table[places + size]
        k += 1
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _batches(column: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, list[bytes]]]]]:
    """(first row, words of some rows), so that together they have about ``TOGETHER`` words."""
    first, own, n = 0, [], 0
    for row, text in enumerate(column):
        numbers, known = word_numbers(text.as_py() or b"")
        if own and n + len(numbers) > TOGETHER:
            yield first, own
            first, own, n = row, [], 0
        own.append((numbers, known))
        n += len(numbers)
    if own:
        yield first, own


def _collapsed(numbers: np.ndarray, known: list[bytes]) -> bytes:
    return b" ".join([known[i] for i in numbers.tolist()])


def _find(least: int, times: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for first, own in _batches(batch.column(1)):
                sizes = np.array([len(numbers) for numbers, _ in own], np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                base = np.cumsum([0, *(len(known) for _, known in own)])
                names = np.concatenate([numbers + b for (numbers, _), b in zip(own, base, strict=False)])
                runs = runs_of(names, ends, least, times)
                # Words after a run's first period, of any run.
                change = np.zeros(len(names) + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(change)[:-1] == 0
                row = np.searchsorted(ends, runs[:, 0], "right")
                start, length, period = runs[:, 0] - starts[row], runs[:, 1], runs[:, 2]
                offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(own)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], names=["start", "length", "period"]))
                texts = [_collapsed(numbers[kept[a:b]], known) for (numbers, known), a, b in zip(own, starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(own)), pa.array(sizes), lists.cast(kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str | Column = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row (id, n_words, runs, collapsed) per row of ``docs``.

    ``runs`` holds (start, length, period) in words from 0, by start and period; ``collapsed`` the words that no run contains after
    its first period, joined by one space.
    """
    if times < 3 or least < 1:
        raise ValueError("a run must have its period three times at least")
    small_batches(docs.sparkSession)
    text = F.col(text) if isinstance(text, str) else text
    source = docs.select(F.col(id_col).alias("id"), text.cast("string").cast("binary").alias("text"))
    kind = dict(source.dtypes)["id"]
    return source.mapInArrow(_find(least, times), f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def made_periodic(text: Column, doc_id: Column) -> Column:
    """The text, or for one id in ten its words with a tail that repeats: the fixed rule by which the query's documents are altered.

    With h the crc32 of the id, g = h div 10 and n words: if h mod 10 is 0, each word i from a = g mod n on is the word
    a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def altered(own: Column) -> Column:
        n = F.size(own)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        rest = n - a
        p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
        cycle = F.array_repeat(F.slice(own, a + 1, p), F.ceil(rest / p).cast("int"))
        tail = F.slice(F.flatten(cycle), F.lit(1), rest)
        return F.when(n > 0, F.array_join(F.concat(F.slice(own, F.lit(1), a), tail), " "))

    # The lambda names the words, so that they are split once.
    made = F.get(F.transform(F.array(words(text)), altered), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)
