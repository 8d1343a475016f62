"""Quality classifier (operator 5): weak labels by expectation-maximisation, a hashed linear scorer on top.

Two targets, poor quality and toxicity, are learned in the same way:

1. overlapping heuristic labellers vote yes, no or nothing on each document: shapes of the text for quality; for
   toxicity marks mined from hand labels: words, openings of words and word pairs that occur in many toxic texts and
   hardly elsewhere (``mine_marks``, counted over all labelled documents). Without enough hand labels a short list of
   seed words stands for the mined words;
2. Spark counts the vote patterns over all documents; expectation-maximisation on these counts estimates how each labeller
   votes for either class, and the posterior of each pattern;
3. the posteriors of about ``FIT_ROWS`` documents, picked by a hash of id and text, train a logistic model on hashed
   words and votes with Spark's own optimiser; several estimated accuracies, not one list, decide what it learns;
4. the model scores every whole text where it lies. Its probability, ``poor`` or ``toxic``, is what counts.

Patterns are at most 3 to the power of the number of labellers, so what the driver holds is bounded. Defined results: a null or
empty text gets no votes but "no words", which counts as poor. Where no document or only one class is seen, the
posterior itself is the score. Repeated rows get equal scores; extra columns are carried along, names that the result
adds are refused. A text is taken whole: n bytes take some 150 n in its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, refuse_columns, small_batches
from .hash_arrays import mix
from .word_hashes import END, token_chunks

#: Documents that the linear scorer is fitted on, about: the stated bound of the sample.
FIT_ROWS = 8000
#: Tasks that the fit's rows are dealt to; the optimiser passes over them many times.
FIT_TASKS = 8
HASH_BITS = 13
STEPS = 60
#: Words that stand for mined ones where hand labels are too few to mine any.
SEEDS = ["bastard", "clown", "disgusting", "filthy", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]

QUALITY = ["symbols", "capitals", "variety", "top word", "bars", "pairs", "exclaims", "endings", "echoes"]
TOXIC = ["words", "openings", "pairs", "several", "none"]
#: Bytes of a word's opening that the mined list goes by; least number and share of toxic texts with an opening, least precision.
OPENINGS = (4, 5, 6, 7, 8, 9)
#: Kinds of marks besides openings: whole words and pairs of neighbouring words.
WORD, PAIR = 0, -1
KINDS = (WORD, PAIR, *OPENINGS)
LEAST_TEXTS, LEAST_SHARE, LEAST_PRECISION = 8, 0.005, 0.95
#: Hand labels up to this number are broadcast; above it they are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: For each labeller of quality, the figure up to which it votes "fine" and that from which it votes "poor".
LIMITS = {"symbols": (0.03, 0.08), "capitals": (0.12, 0.4), "variety": (0.6, 0.8), "top word": (0.15, 0.3), "bars": (0.005, 0.02), "pairs": (0.25, 0.45), "exclaims": (0.01, 0.05), "endings": (0.05, 0.2), "echoes": (0.05, 0.25)}


def word_hashes(words: list[str]) -> np.ndarray:
    out = [t[:-1] for _, _, t, _ in token_chunks(pa.array([" ".join(words)]))]
    return np.unique(np.concatenate(out))


def bare_hashes(words: list[str]) -> np.ndarray:
    """Hashes of the words, also with common punctuation around them."""
    return word_hashes([a + w + b for w in words for a in ("", '"', "(") for b in ("", ".", ",", "!", "?", ";", ":", '"', ")")])


def by_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs: the value's leading 48 bits, the row (below 65,536), how often each occurs."""
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    key, times = key[heads], np.diff(np.append(heads, len(key)))
    return key & np.uint64((1 << 48) - 1), (key >> np.uint64(48)).astype(np.int64), times


def among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


class Marks:
    """A sorted list of hashes behind a table of their leading 16 bits."""

    def __init__(self, known: np.ndarray):
        self.known, self.table = known, np.zeros(1 << 16, bool)
        self.table[known >> np.uint64(48)] = True

    def hits(self, opening: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[opening >> np.uint64(48)])
        return at[among(self.known, opening[at])]

    def mask(self, value: np.ndarray) -> np.ndarray:
        out = np.zeros(len(value), bool)
        out[self.hits(value)] = True
        return out


def figures(texts: pa.Array) -> Iterator[tuple]:
    """(first row, row after the last, figures by QUALITY, tokens, their rows, openings) of groups of texts."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    for first, last, token, row, *openings in token_chunks(texts, OPENINGS):
        part, n = texts.slice(first, last - first), last - first
        offset = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + n + 1]
        raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]
        own = offset - offset[0]

        def share(mask: np.ndarray, own=own) -> np.ndarray:
            total = np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
            return total[own[1:]] - total[own[:-1]]

        upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
        letters = share(upper | lower | (raw >= 128))
        space = (raw == 32) | (raw == 10)
        digits = (raw >= 48) & (raw <= 57)
        plain = np.isin(raw, np.frombuffer(b".,;:'-()\"?!", np.uint8))
        odd = ~(upper | lower | (raw >= 128) | space | digits | plain)
        size = np.maximum(share(~space), 1)
        before_space = np.zeros(len(raw), bool)
        before_space[:-1] = space[1:]
        words = np.bincount(row - first, minlength=n) - 1
        some = np.maximum(words, 1)
        word, at = token[token != END], (row - first)[token != END]
        kind, r, times = by_row(at, word)
        top = np.zeros(n)
        np.maximum.at(top, r, times)
        kinds = np.bincount(r, minlength=n)
        same_row = at[1:] == at[:-1]
        pair, pair_row = mix(word[:-1] * np.uint64(3) + word[1:])[same_row], at[1:][same_row]
        pair_kinds = np.bincount(by_row(pair_row, pair)[1], minlength=n)
        expected = np.minimum(some, 60 + 0.15 * some)  # words seldom stay new in a long text
        out = np.stack(
            [
                share(odd) / size,
                np.where(letters >= 20, share(upper) / np.maximum(letters, 1), 0),
                1 - np.minimum(kinds / expected, 1),
                np.where(words >= 20, top / some, 0),
                share(raw == 124) / size,
                1 - np.where(words >= 20, pair_kinds / np.maximum(words - 1, 1), 1),
                share(raw == 33) / size,
                share(odd & before_space) / some,
                np.where(words >= 8, np.bincount(at[1:][same_row & (word[1:] == word[:-1])], minlength=n) / some, 0),
            ],
            axis=1,
        )
        out[words == 0, 0] = 1.0
        yield first, last, out, token, row, openings


def marks_of(token: np.ndarray, row: np.ndarray, openings: list[np.ndarray]) -> list[np.ndarray]:
    """For each of KINDS the hash at each token (0 where there is none)."""
    word = np.where(token == END, np.uint64(0), token)
    pair = np.zeros(len(token), np.uint64)
    both = (row[1:] == row[:-1]) & (token[1:] != END)
    pair[1:][both] = mix(token[:-1][both] * np.uint64(3) + token[1:][both])
    return [word, pair, *openings]


def votes(texts: pa.Array, lists: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, votes on quality, votes on toxicity, tokens, their rows); a vote is 1 (yes, bad), 0 (no) or 2 (none)."""
    low, high = (np.array([LIMITS[k][j] for k in QUALITY]) for j in (0, 1))
    mined = [Marks(x) for x in lists]
    for first, last, figure, token, row, openings in figures(texts):
        quality = np.where(figure >= high, 1, np.where(figure <= low, 0, 2)).astype(np.int8)
        n = last - first
        seen, at = np.zeros((3, n), bool), np.zeros(len(token), bool)
        for kind, known, value in zip(KINDS, mined, marks_of(token, row, openings), strict=True):
            hits = known.hits(value)
            seen[{WORD: 0, PAIR: 2}.get(kind, 1), (row - first)[hits]] = True
            at[hits] = True
        times = np.bincount((row - first)[at], minlength=n)
        toxic = np.stack([*np.where(seen, 1, 2), np.where(times > 1, 1, 2), np.where(times == 0, 0, 2)], axis=1).astype(np.int8)
        yield first, last, quality, toxic, token, row


def code_of(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """From patterns (rows of votes) and how often each occurs: (posterior of "bad" per pattern, vote[class, labeller, vote], prior).

    Labellers are independent given the class; a labeller may abstain with any frequency. It starts from the shares
    of votes, so the classes keep their names.
    """
    yes, no = (patterns == 1).sum(axis=1), (patterns == 0).sum(axis=1)
    post = (yes + 0.1) / (yes + no + 1.0)
    hot = np.stack([patterns == k for k in (0, 1, 2)], axis=2).astype(float)
    vote, prior = np.zeros((2, patterns.shape[1], 3)), 0.0
    for _ in range(steps):
        weight = np.stack([(1 - post) * n, post * n])
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        vote = np.einsum("cp,plv->clv", weight, hot) + np.array([[[2.0, 0.5, 1.0]], [[0.5, 2.0, 1.0]]])
        vote /= vote.sum(axis=2, keepdims=True)
        log = np.einsum("plv,clv->cp", hot, np.log(vote)) + np.log([1 - prior, prior])[:, None]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, vote, prior


@dataclass
class Target:
    """One target's pattern posteriors and linear scorer."""

    names: list[str]
    posterior: dict[int, float] = field(default_factory=dict)
    prior: float = 0.5
    vote: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: float = 0.0


@dataclass
class Model:
    quality: Target
    toxic: Target
    lists: list[np.ndarray]


def feature_rows(v: np.ndarray, first: int, token: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features (row, column, value): hashed words as shares of the text, and the votes."""
    n = len(v)
    size = 1 << HASH_BITS
    count = np.bincount(row - first, minlength=n)
    column = (token >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    cells, times = np.unique((row - first) * np.int64(size) + column, return_counts=True)
    r, c = cells // size, cells % size
    vote_row, labeller = np.repeat(np.arange(n), v.shape[1]), np.tile(np.arange(v.shape[1]), n)
    return np.concatenate([r, vote_row]), np.concatenate([c, size + 3 * labeller + v.ravel()]), np.concatenate([times / count[r], np.ones(v.size)])


def mine_marks(df: DataFrame, labels: DataFrame, id_col: str, text: str) -> list[np.ndarray]:
    """For each of ``KINDS``, the hashes of words, pairs and openings typical of toxic texts.

    A mark must occur in ``LEAST_SHARE`` of the toxic texts, so the list is bounded by the marks per text; only those are
    then counted in the other texts.
    """
    marks = labels.filter("toxic is not null").groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    if marks.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    known = df.select(F.col(id_col).alias("__id"), F.col(text).cast("string").alias("text")).join(marks, "__id").select("text", "toxic")

    def counted(texts: DataFrame, only: list[np.ndarray] | None) -> DataFrame:
        """Rows (k, mark, n): in how many texts a mark occurs, of all marks or of those in ``only``."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, token, row, *openings in token_chunks(batch.column(0), OPENINGS):
                    for j, (k, mark) in enumerate(zip(KINDS, marks_of(token, row, openings), strict=True)):
                        own = mark != 0 if only is None else Marks(only[j]).mask(mark)
                        value, n = np.unique(_distinct(mark[own], row[own])[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, np.int32)), pa.array(value.view(np.int64)), pa.array(n)], names=["k", "mark", "n"])

        return texts.select("text").mapInArrow(count, "k int, mark bigint, n bigint").groupBy("k", "mark").agg(F.sum("n").alias("n"))

    bad, good = known.filter("toxic = 1"), known.filter("toxic = 0")
    least = max(LEAST_TEXTS, LEAST_SHARE * bad.count())
    often = {(r["k"], r["mark"]): r["n"] for r in counted(bad, None).filter(F.col("n") >= least).collect()}
    if not often:
        return [np.zeros(0, np.uint64) for _ in KINDS]
    likely = [np.unique(np.array([o for j, o in often if j == k], np.int64).view(np.uint64)) for k in KINDS]
    clean = {(r["k"], r["mark"]): r["n"] for r in counted(good, likely).collect()}
    typical = [x for x, n in often.items() if n >= LEAST_PRECISION * (n + clean.get(x, 0) + 0.5)]
    return [np.unique(np.array([o for j, o in typical if j == k], np.int64).view(np.uint64)) for k in KINDS]


def _distinct(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((row, value))
    value, row = value[order], row[order]
    fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])]) if len(value) else np.zeros(0, bool)
    return value[fresh], row[fresh]


def train(df: DataFrame, text: str = "text", labels: DataFrame | None = None, id_col: str = "doc_id") -> Model:
    """Learn both targets from the texts and, for the mined list, from ``labels`` (id, toxic 0/1) if given."""
    small_batches(df.sparkSession)
    lists = mine_marks(df, labels, id_col, text) if labels is not None else [np.zeros(0, np.uint64) for _ in KINDS]
    if not any(len(x) for x in lists):
        lists[KINDS.index(WORD)] = bare_hashes(SEEDS)
    own_id = F.col(id_col).cast("string") if id_col in df.columns else F.lit(None).cast("string")
    texts = df.select(F.col(text).cast("string").alias("text"), own_id.alias("id"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, q, t, _, _ in votes(batch.column(0), lists):
                both, n = np.unique(np.stack([code_of(q), code_of(t)], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(n)], names=["quality", "toxic", "n"])

    counted = cut(texts.select("text").mapInArrow(patterns, "quality bigint, toxic bigint, n bigint").groupBy("quality", "toxic").agg(F.sum("n").alias("n")))
    model = Model(Target(QUALITY), Target(TOXIC), lists)
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return model
    for name, target in (("quality", model.quality), ("toxic", model.toxic)):
        found = counted.groupBy(name).agg(F.sum("n").alias("n")).orderBy(name).collect()
        code, n = np.array([r[name] for r in found]), np.array([r["n"] for r in found], float)
        post, target.vote, target.prior = expectation_maximisation(code[:, None] // 3 ** np.arange(len(target.names)) % 3, n)
        target.posterior = dict(zip(code.tolist(), post.tolist(), strict=True))
    every = max(1, total // FIT_ROWS)
    sample = cut(texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0).select("text").repartition(FIT_TASKS))
    for name, target in (("quality", model.quality), ("toxic", model.toxic)):
        fit(sample, name, target, model)
    return model


def fit(sample: DataFrame, name: str, target: Target, model: Model) -> None:
    width = (1 << HASH_BITS) + 3 * len(target.names)
    lists, posterior = model.lists, target.posterior

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, q, t, token, row in votes(batch.column(0), lists):
                v = q if name == "quality" else t
                r, c, x = feature_rows(v, first, token, row)
                order = np.lexsort((c, r))
                bounds = np.searchsorted(r[order], np.arange(last - first + 1))
                c, x = c[order].astype(np.int32), x[order]
                p = [posterior.get(k, target.prior) for k in code_of(v).tolist()]
                ats, xs = ([a[bounds[k] : bounds[k + 1]] for k in range(last - first)] for a in (c, x))
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(ats, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float64()))], names=["p", "at", "x"])

    made = cut(sample.mapInArrow(rows, "p double, at array<int>, x array<double>"))  # so that no stage needs two Python workers a task
    vector = F.udf(lambda at, x: Vectors.sparse(width, at, x), VectorUDT())
    data = made.select("p", vector("at", "x").alias("features"))
    data = cut(data.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("y")).select("features", "y.*").filter("weight > 1e-6"))
    if data.select("label").distinct().count() < 2:
        return
    fitted = LogisticRegression(weightCol="weight", regParam=1e-5, maxIter=100, standardization=False).fit(data)
    target.weights, target.bias = fitted.coefficients.toArray(), float(fitted.intercept)


def judge(df: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``df`` and ``poor``, ``toxic`` (probabilities), ``poor_label``, ``toxic_label`` (posteriors of the votes)."""
    names = [f"{prefix}{x}" for x in ("poor", "toxic", "poor_label", "toxic_label")]
    refuse_columns(df.columns, names)
    schema = T.StructType([*df.schema.fields, *[T.StructField(x, T.DoubleType()) for x in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((4, batch.num_rows))
            for first, last, q, t, token, row in votes(batch.column(batch.schema.get_field_index(text)), model.lists):
                for k, (target, v) in enumerate(((model.quality, q), (model.toxic, t))):
                    label = np.array([target.posterior.get(c, target.prior) for c in code_of(v).tolist()])
                    out[2 + k, first:last] = label
                    out[k, first:last] = label
                    if target.weights is not None:
                        column = (token >> np.uint64(64 - HASH_BITS)).astype(np.int64)
                        own = np.bincount(row - first, target.weights[column], last - first) / np.bincount(row - first, minlength=last - first)
                        own += target.weights[(1 << HASH_BITS) + 3 * np.arange(v.shape[1]) + v].sum(axis=1) + target.bias
                        out[k, first:last] = 1 / (1 + np.exp(-np.clip(own, -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in out]], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)
