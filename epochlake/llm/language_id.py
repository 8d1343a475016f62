"""Language ID (operator 7): an interpolated Kneser-Ney character model per language, in sorted hash arrays.

Text is lower-cased, what isn't a letter becomes one space, and each document starts with start marks. A gram of up
to four characters is packed into 64 bits (16 a character), so keys are exact; letters beyond the first plane share
16-bit codes. Tasks count the grams of the highest order; Spark adds them up, derives the lower orders'
continuation counts, the modified Kneser-Ney discounts and the interpolated probabilities by joins, and writes one
sorted hash array per order whose rows hold the log probability in every language. A document's language is the
one of least cross-entropy per character.

Calibration: one labelled document in ``HELD`` (by a hash of id and text) isn't counted but scored. Their cross-entropies set, per
language, the limit above which a prediction is rejected, and the temperature that makes the score, the posterior
of the language given the whole text, most likely. No document is scored by a model that counted it, whatever the language's size; a language
without such documents has no limit, and one that would have nothing else keeps them for its counts. Percentiles are Spark's mergeable sketches, so this covers all data at any size.

Defined results: null or letterless text is ``und`` with score 0. Without labelled text every document is ``und``.
Ties go to the language that sorts first. Rows are kept one for one; extra columns are not read. A text is taken
whole: n characters take some (60 + 16 x languages) n bytes in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, small_batches
from .hash_arrays import HashTable, worker_cache, write_table, xxhash_long

ORDER = 4
BITS = 16
#: One labelled document in so many is held out of the counts.
HELD = 10
#: Powers to which likelihoods may be raised for the score.
TEMPERATURES = [2.0**-k for k in range(13)]
#: Share of a language's own documents that the rejection limit keeps.
KEPT_SHARE = 0.999
#: Characters looked at together; a longer document is still taken whole.
CHUNK = 400_000
#: Rows of the model per shard, about.
SHARD_ROWS = 2_000_000
SPACE, START, MARK = 32, 0, 0x10FFFF
UNDETERMINED = "und"

_CODES: list[np.ndarray] = []


def codes() -> np.ndarray:
    """Code of each code point: its lower case in 16 bits, or a space if it isn't a letter."""
    if not _CODES:
        out = np.full(MARK + 1, SPACE, np.uint16)
        for c in range(MARK):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                cp = ord(low) if len(low) == 1 else c
                out[c] = cp if cp < 1 << BITS else 0xE000 + cp % 0x1800
        out[MARK] = START
        _CODES.append(out)
    return _CODES[0]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, codes with START marks, row of each code) for groups of texts."""
    first, mark = 0, chr(MARK) * (ORDER - 1)
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= CHUNK):
            size += len(texts[last] or "")
            last += 1
        joined = "".join(mark + (t or "").replace(chr(MARK), " ") for t in texts[first:last])
        code = codes()[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
        starts = np.cumsum([0] + [len(t or "") + ORDER - 1 for t in texts[first:last]])[:-1]
        row = np.zeros(len(code), np.int32)
        row[starts[1:]] = 1
        row = np.cumsum(row)
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != SPACE) | ((code[:-1] != SPACE) & (code[:-1] != START))
        yield first, code[keep], row[keep]
        first = last


def packed(code: np.ndarray) -> np.ndarray:
    """The last ORDER codes at each place, packed; the oldest is highest."""
    out = code.astype(np.uint64)
    for k in range(1, ORDER):
        out[k:] |= code[:-k].astype(np.uint64) << np.uint64(BITS * k)
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """Rows (lang, gram, n) over all labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                seen, times = [], []
                for _, code, _ in chunks([texts[k] for k in np.flatnonzero(langs == lang)]):
                    gram, n = np.unique(packed(code)[code != START], return_counts=True)
                    seen.append(gram)
                    times.append(n)
                gram, at = np.unique(np.concatenate(seen), return_inverse=True)
                n = np.bincount(at, np.concatenate(times)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; where those are too few, a plain 0.5, 0.75 and 0.9."""
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.01), 0.99), min(max(d2, 0.01), 1.99), min(max(d3, 0.01), 2.99)


class Model:
    """Where the arrays lie, and the calibration; small and picklable."""

    def __init__(self, uri: str, langs: list[str], shards: list[tuple[int, int]], floor: float):
        self.uri, self.langs, self.shards, self.floor = uri, langs, shards, floor
        self.limit = np.full(len(langs), np.inf)
        self.temperature = 1.0


def train(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id") -> Model | None:
    """Train on all rows whose language and text aren't null; a missing id column counts as null. The number of languages is expected to be small."""
    spark = docs.sparkSession
    small_batches(spark)
    own_id = F.col(id_col).cast("string") if id_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), own_id.alias("id")).filter("lang is not null and text is not null")
    rows = rows.withColumn("held", F.pmod(F.xxhash64("id", "text"), F.lit(HELD)) == 0)
    # A language all of whose documents would be held out couldn't be learned.
    only = rows.groupBy("lang").agg(F.bool_and("held").alias("only")).filter("only")
    rows = rows.join(F.broadcast(only), "lang", "left").withColumn("held", F.col("held") & F.col("only").isNull())
    grams = cut(count_grams(rows.filter(~F.col("held"))))
    langs = [r[0] for r in grams.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    uri, shards = fresh_path(spark, "language-id"), []
    levels = [grams]
    for k in range(ORDER - 1, 0, -1):
        levels.insert(0, levels[0].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")).agg(F.count("*").alias("n")))
    alphabet = levels[0].select("gram").distinct().count() + 1
    floor = 1.0 / alphabet
    below: DataFrame | None = None
    for k, level in enumerate(levels, 1):
        level = cut(level)
        found = {r["lang"]: r for r in level.groupBy("lang").agg(*[F.count_if(F.col("n") == j).alias(f"n{j}") for j in (1, 2, 3, 4)]).collect()}
        rate = [discounts(*[found[x][f"n{j}"] if x in found else 0 for j in (1, 2, 3, 4)]) for x in langs]

        def per_lang(f, langs=langs) -> Column:
            return F.array(*[f(F.col("lang") == x, j) for j, x in enumerate(langs)])

        def picked(case: Column, value: Column) -> Column:
            return F.coalesce(F.sum(F.when(case, value)), F.lit(0)).cast("double")

        def taken(j: int, rate=rate) -> Column:
            d = rate[j]
            return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])

        context = F.shiftrightunsigned("gram", BITS)
        ctx = level.groupBy(context.alias("ctx")).agg(per_lang(lambda c, j: picked(c, F.col("n"))).alias("total"), per_lang(lambda c, j: picked(c, taken(j))).alias("mass"))
        ctx = cut(ctx.select("ctx", "total", F.zip_with("mass", "total", lambda m, t: F.when(t > 0, m / t).otherwise(F.lit(1.0))).alias("gamma")))
        own = level.groupBy("gram").agg(per_lang(lambda c, j: picked(c, F.greatest(F.col("n") - taken(j), F.lit(0.0)))).alias("num")).withColumn("ctx", context)
        joined = own.join(ctx, "ctx")
        if below is None:
            p = F.transform(F.arrays_zip("num", "total", "gamma"), lambda x: F.when(x["total"] > 0, x["num"] / x["total"]).otherwise(F.lit(0.0)) + x["gamma"] * F.lit(floor))
        else:
            joined = joined.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(below.select(F.col("gram").alias("low"), F.col("p").alias("q")), "low")
            p = F.transform(F.arrays_zip("num", "total", "gamma", "q"), lambda x: F.when(x["total"] > 0, x["num"] / x["total"]).otherwise(F.lit(0.0)) + x["gamma"] * x["q"])
        below = cut(joined.select("gram", p.alias("p")))
        sizes = [max(1, t.count() // SHARD_ROWS) for t in (below, ctx)]
        log = lambda c: F.transform(c, lambda x: F.ln(x).cast("float"))
        write_table(below.select(F.xxhash64("gram").alias("key"), log("p").alias("v")), f"{uri}/p{k}", sizes[0], len(langs))
        write_table(ctx.select(F.xxhash64("ctx").alias("key"), log("gamma").alias("v")), f"{uri}/g{k}", sizes[1], len(langs))
        shards.append((sizes[0], sizes[1]))
    model = Model(uri, langs, shards, floor)
    calibrate(model, rows.filter("held"))
    return model


class Scorer:
    """Log probabilities per language from the mapped arrays."""

    def __init__(self, model: Model):
        n = len(model.langs)
        self.n, self.floor = n, np.float32(np.log(model.floor))
        self.p = [HashTable(f"{model.uri}/p{k + 1}", s[0], n) for k, s in enumerate(model.shards)]
        self.g = [HashTable(f"{model.uri}/g{k + 1}", s[1], n) for k, s in enumerate(model.shards)]

    def log_p(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Back off where no language has the gram: its context's weight times the shorter gram's probability."""
        if order == 0:
            return np.full((len(gram), self.n), self.floor, np.float32)
        found, out = self.p[order - 1].find(xxhash_long(gram))
        if not found.all():
            rest = gram[~found]
            _, weight = self.g[order - 1].find(xxhash_long(rest >> np.uint64(BITS)))
            low = rest & np.uint64((1 << BITS * (order - 1)) - 1)
            out[~found] = weight + self.log_p(low, order - 1)
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per character in each language, characters, letters) for each text."""
        total, size, letters = np.zeros((len(texts), self.n)), np.zeros(len(texts)), np.zeros(len(texts))
        for first, code, row in chunks(texts):
            real = code != START
            gram, owner, letter = packed(code)[real], row[real] + first, (code != SPACE)[real]
            if len(gram):
                value = self.log_p(gram)
                heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                total[owner[heads]] = np.add.reduceat(value, heads, axis=0, dtype=np.float64)
                size += np.bincount(owner, minlength=len(texts))
                letters += np.bincount(owner, letter, minlength=len(texts))
        return -total / np.maximum(size, 1)[:, None], size, letters


def calibrate(model: Model, rows: DataFrame) -> None:
    """Rejection limits and temperature from the given labelled rows, scored where they lie."""
    names = ["lang", "ce", *[f"t{k}" for k in range(len(TEMPERATURES))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(model.uri, lambda: Scorer(model))
        for batch in batches:
            ce, size, letters = scorer.cross_entropies(batch.column(1).to_pylist())
            own = np.array([model.langs.index(x) for x in batch.column(0).to_pylist()], np.int64)
            at = np.arange(len(own))
            apart = -(ce - ce.min(axis=1, keepdims=True)) * size[:, None]
            likely = [pa.array((apart[at, own] * t) - np.log(np.exp(apart * t).sum(axis=1))) for t in TEMPERATURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ce[at, own]), *likely], names=names).filter(pa.array(letters > 0))

    scored = cut(rows.select("lang", "text").mapInArrow(run, ", ".join(["lang string", *(f"{n} double" for n in names[1:])])))
    for r in scored.groupBy("lang").agg(F.percentile_approx("ce", F.lit(KEPT_SHARE), F.lit(10_000)).alias("high"), F.stddev_samp("ce").alias("sd")).collect():
        model.limit[model.langs.index(r["lang"])] = r["high"] + 3 * (r["sd"] or 0.0)
    mean = scored.agg(*[F.avg(n).alias(n) for n in names[2:]]).first()
    if mean[0] is not None:
        model.temperature = TEMPERATURES[int(np.argmax(np.array(mean)))]


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, cross_entropy, rejected)."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    if model is None:
        return source.select("id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(model.uri, lambda: Scorer(model))
        names = np.array(model.langs, object)
        for batch in batches:
            ce, size, letters = scorer.cross_entropies(batch.column(1).to_pylist())
            best = ce.argmin(axis=1)
            low = ce[np.arange(len(ce)), best]
            weight = np.exp(-(ce - low[:, None]) * size[:, None] * model.temperature)
            none = letters == 0
            score = np.where(none, 0.0, 1 / weight.sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(none, UNDETERMINED, names[best]).tolist(), pa.string()), pa.array(score), pa.array(low, mask=none), pa.array(none | (low > model.limit[best]))], names=["id", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
