"""LM scoring (operator 1): an interpolated modified Kneser-Ney bigram model over words.

Training, two passes over the texts:

1. heavy words: each task reports the words that make up at least half of ``HEAVY`` of a piece of text; a word
   with that share of all tokens is among the at most 2 / ``HEAVY`` that are kept. Pairs that follow a heavy word
   are spread over all buckets, so no bucket depends on one key.
2. counts: tasks sort and count the pairs of a few million tokens at a time and send each bucket one packed row;
   the bucket's task merges the rows, writes the bucket's pair counts and context totals as sorted hash arrays, and
   sends the words' continuation counts on, packed likewise, to the task that writes the word arrays.

Only sums, the heavy words and their totals reach the driver. Scoring maps the arrays in each worker and looks up
the tokens of a few megabytes of text at a time. Buckets grow in number with the tokens (``BUCKET_TOKENS``).

Words are known by 64-bit hashes. Unknown words share one outcome, as in the plain base model. Defined results: a
null or empty text has one token, its end. With nothing to train on all scores are those of an empty model (0).
Repeated rows stay; extra columns are not read; a row without id is learned from and scored. A text is taken whole:
n bytes take some 60 n in its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, small_batches
from .hash_arrays import HashTable, lead_bits, mix, put_file, shard_of, worker_cache
from .language_id import discounts
from .word_hashes import BEGIN, END, token_chunks

#: Share of all tokens from which a word counts as heavy.
HEAVY = 1e-3
#: Training tokens per bucket of pairs.
BUCKET_TOKENS = 2_000_000
#: Tokens that a task counts together before it sends pairs on.
FLUSH_TOKENS = 2_000_000
TOTAL = np.uint64(0)
#: From so many training tokens on, counts are written in 64 bits; below it none can pass 32.
WIDE = 1 << 32
PACKED = "bucket int, kind string, a binary, b binary, c binary, d binary"
KINDS = [pa.int32(), pa.string(), *[pa.binary()] * 4]


def heavy_words(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(tokens in all, sorted hashes of the heavy words and of the begin mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, token, _ in token_chunks(batch.column(0)):
                word, n = np.unique(token, return_counts=True)
                much = n >= max(1, HEAVY / 2 * len(token))
                word, n = np.append(word[much], TOTAL), np.append(n[much], len(token))
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    sums = texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    total = sums.filter(F.col("word") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = sums.filter((F.col("word") != 0) & (F.col("n") >= HEAVY / 2 * total)).select("word").collect()
    return total, np.unique(np.array([r[0] for r in found] + [np.uint64(BEGIN).view(np.int64)], np.int64).view(np.uint64))


def is_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def count_kind(tokens: int) -> str:
    return "<u4" if tokens < WIDE else "<u8"


def pair_key(context: np.ndarray, word: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    """Key of a pair: led by the context's leading bits, so that its pairs share a bucket, or spread if it is heavy."""
    key = mix(context * np.uint64(0x9E3779B97F4A7C15) + word)
    low = np.uint64((1 << (64 - lead_bits(buckets))) - 1)
    return np.where(is_in(heavy, context), key, (context & ~low) | (key & low))


def contexts(token: np.ndarray) -> np.ndarray:
    """The token before each, or BEGIN at the start of a text."""
    out = np.empty_like(token)
    out[0] = BEGIN
    out[1:] = np.where(token[:-1] == END, BEGIN, token[:-1])
    return out


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the sums of the values, and the place of one row of each key."""
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[heads], *(np.add.reduceat(v[order], heads) if len(key) else v for v in values), order[heads])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)], names=["bucket", "kind", "a", "b", "c", "d"])


def packed_pairs(context: np.ndarray, word: np.ndarray, heavy: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket: distinct contexts, their run lengths, the words, the counts."""
    key, n, at = summed(pair_key(context, word, heavy, buckets), np.ones(len(word), np.int64))
    bucket, context, word = shard_of(key, buckets), context[at], word[at]
    order = np.lexsort((context, bucket))
    bucket, context, word, n = bucket[order], context[order], word[order], n[order].astype(np.uint32)
    bounds, rows = np.searchsorted(bucket, np.arange(buckets + 1)), []
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        c = context[bounds[k] : bounds[k + 1]]
        heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        rows.append((k, "pairs", c[heads].tobytes(), np.diff(np.append(heads, len(c))).astype(np.uint32).tobytes(), word[bounds[k] : bounds[k + 1]].tobytes(), n[bounds[k] : bounds[k + 1]].tobytes()))
    return batch_of(rows)


def _arrays(table: pa.Table, column: str, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in table.column(column).to_pylist()]


class Model:
    """Where the arrays lie, and the sums; small and picklable."""

    def __init__(self, uri: str, tokens: int):
        self.uri, self.tokens, self.kinds = uri, tokens, 0
        self.count_kind = count_kind(tokens)
        self.pair_buckets = max(1, math.ceil(tokens / BUCKET_TOKENS))
        self.word_buckets = max(1, math.ceil(self.pair_buckets / 4))
        self.heavy = np.array([BEGIN])
        self.heavy_totals = np.zeros((1, 4))
        self.pair_discounts = self.word_discounts = (0.5, 0.75, 0.9)
        self.continuations = 0
        self.word_mass = 0.0


def train(df: DataFrame, text: str = "text") -> Model:
    """Learn from every row of ``df``."""
    small_batches(df.sparkSession)
    texts = df.select(F.col(text).cast("string").alias("text"))
    tokens, heavy = heavy_words(texts)
    model = Model(fresh_path(df.sparkSession, "ngram-lm"), tokens)
    if not tokens:
        return model
    model.heavy = heavy
    uri, buckets, word_buckets, wide = model.uri, model.pair_buckets, model.word_buckets, model.count_kind

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, token, _ in token_chunks(batch.column(0)):
                held.append((contexts(token), token))
                size += len(token)
                if size >= FLUSH_TOKENS:
                    yield packed_pairs(*(np.concatenate(x) for x in zip(*held, strict=True)), heavy, buckets)
                    held, size = [], 0
        if held:
            yield packed_pairs(*(np.concatenate(x) for x in zip(*held, strict=True)), heavy, buckets)

    def merge_pairs(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        context = np.concatenate([np.repeat(c, r) for c, r in zip(_arrays(table, "a", "<u8"), _arrays(table, "b", "<u4"), strict=True)])
        word, n = np.concatenate(_arrays(table, "c", "<u8")), np.concatenate(_arrays(table, "d", "<u4")).astype(np.int64)
        key, n, at = summed(pair_key(context, word, heavy, buckets), n)
        put_file(f"{uri}/pair/{b:06d}.key", key)
        put_file(f"{uri}/pair/{b:06d}.val", n.astype(wide))
        context, word = context[at], word[at]
        of_counts = np.bincount(np.minimum(n, 5), minlength=6)[1:5].astype(np.int64)
        own, total, n1, n2, n3, _ = summed(context, n.astype(np.int64), *((n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64)))
        stats = np.stack([total, n1, n2, n3], axis=1)
        hot = is_in(heavy, own)
        put_file(f"{uri}/context/{b:06d}.key", own[~hot])
        put_file(f"{uri}/context/{b:06d}.val", stats[~hot].astype(wide))
        rows = [(b % word_buckets, "counts", of_counts.tobytes(), b"", b"", b"")]
        for w, s in zip(own[hot], stats[hot], strict=True):
            rows.append((int(shard_of(np.array([w]), word_buckets)[0]), "heavy", w.tobytes(), s.astype("<i8").tobytes(), b"", b""))
        word, before, n, _ = summed(word, np.ones(len(word), np.int64), n.astype(np.int64))
        bounds = np.searchsorted(shard_of(word, word_buckets), np.arange(word_buckets + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[k], bounds[k + 1])
            rows.append((k, "words", word[own].tobytes(), n[own].astype("<u8").tobytes(), before[own].astype("<u8").tobytes(), b""))
        return pa.Table.from_batches([batch_of(rows)])

    def merge_words(table: pa.Table) -> pa.Table:
        q, kind = table.column("bucket")[0].as_py(), np.array(table.column("kind").to_pylist(), object)
        words, counts, hot = (table.take(np.flatnonzero(kind == k)) for k in ("words", "counts", "heavy"))
        rows = []
        if words.num_rows:
            word, n, before, _ = summed(np.concatenate(_arrays(words, "a", "<u8")), *(np.concatenate(_arrays(words, c, "<u8")).astype(np.int64) for c in "bc"))
            put_file(f"{uri}/word/{q:06d}.key", word)
            put_file(f"{uri}/word/{q:06d}.val", np.stack([n, before], axis=1).astype(wide))
            few = [int((before == k).sum()) for k in (1, 2, 3, 4)]
            rows.append((q, "sums", np.array([len(word), n.sum(), before.sum(), *few], "<i8").tobytes(), b"", b"", b""))
        if counts.num_rows:
            rows.append((q, "counts", np.sum(_arrays(counts, "a", "<i8"), axis=0).tobytes(), b"", b"", b""))
        if hot.num_rows:
            word = np.concatenate(_arrays(hot, "a", "<u8"))
            stats = np.stack(_arrays(hot, "b", "<i8"))
            word, *cols, _ = summed(word, *stats.T)
            rows.append((q, "heavy", word.tobytes(), np.stack(cols, axis=1).astype("<i8").tobytes(), b"", b""))
        return pa.Table.from_batches([batch_of(rows)])

    done = texts.mapInArrow(count, PACKED).groupBy("bucket").applyInArrow(merge_pairs, PACKED).groupBy("bucket").applyInArrow(merge_words, PACKED).collect()
    sums = np.sum([np.frombuffer(r["a"], "<i8") for r in done if r["kind"] == "sums"], axis=0)
    pairs = np.sum([np.frombuffer(r["a"], "<i8") for r in done if r["kind"] == "counts"], axis=0)
    model.kinds, model.continuations = int(sums[0]), int(sums[2])
    model.pair_discounts, model.word_discounts = discounts(*pairs.tolist()), discounts(*sums[3:7].tolist())
    few = sums[3:6]
    model.word_mass = float(few[0] * model.word_discounts[0] + few[1] * model.word_discounts[1] + (sums[0] - few[0] - few[1]) * model.word_discounts[2]) / model.continuations
    found = {int(w): s for r in done if r["kind"] == "heavy" for w, s in zip(np.frombuffer(r["a"], "<u8"), np.frombuffer(r["b"], "<i8").reshape(-1, 4), strict=True)}
    model.heavy_totals = np.array([found.get(int(w), np.zeros(4)) for w in heavy], float)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.pair = HashTable(f"{model.uri}/pair", model.pair_buckets, 1, model.count_kind)
        self.context = HashTable(f"{model.uri}/context", model.pair_buckets, 4, model.count_kind)
        self.word = HashTable(f"{model.uri}/word", model.word_buckets, 2, model.count_kind)

    @staticmethod
    def left(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        """Counts less their discounts."""
        return np.maximum(n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0)

    def tokens(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count, probability) of each token of whole texts in a row."""
        m = self.m
        if not m.tokens:
            return np.zeros(len(token), np.int64), np.ones(len(token))
        kind, at = np.unique(token, return_inverse=True)
        _, counts = self.word.find(kind)
        alone = self.left(counts[:, 1], m.word_discounts) / m.continuations + m.word_mass / (m.kinds + 1)
        kinds = np.append(kind, BEGIN)
        _, totals = self.context.find(kinds)
        totals = totals.astype(float)
        hot = is_in(m.heavy, kinds)
        totals[hot] = m.heavy_totals[np.searchsorted(m.heavy, kinds[hot])]
        seen = totals[:, 0] > 0
        rest = np.where(seen, totals[:, 1:] @ np.array(m.pair_discounts) / np.maximum(totals[:, 0], 1), 1.0)
        before = np.concatenate([[len(kind)], np.where(token[:-1] == END, len(kind), at[:-1])])
        _, pairs = self.pair.find(pair_key(kinds[before], token, m.heavy, m.pair_buckets))
        p = self.left(pairs[:, 0], m.pair_discounts) / np.maximum(totals[before, 0], 1) + rest[before] * alone[at]
        return counts[at, 0].astype(np.int64), p


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score, perplexity), one per row of ``df``."""
    source = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    whole = model.tokens + 0.5 * (model.kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(model.uri, lambda: Scorer(model))
        for batch in batches:
            rows = batch.num_rows
            n_tokens, n_known = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            base, own = np.zeros(rows), np.zeros(rows)
            for _, _, token, row in token_chunks(batch.column(1)):
                c, p = scorer.tokens(token)
                heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                for out, v in ((n_tokens, np.ones(len(row), np.int64)), (n_known, (c > 0).astype(np.int64)), (base, np.log10((c + 0.5) / whole)), (own, np.log10(p))):
                    out[row[heads]] = np.add.reduceat(v, heads)
            made = [pa.array(n_tokens), pa.array(n_known), pa.array(np.full(rows, model.tokens, np.int64)), pa.array(base), pa.array(own), pa.array(10 ** (-own / np.maximum(n_tokens, 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
