"""Model tables and inference tables (group M)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from . import aggs, checks, shape
from .windows import within_between

Keys = Sequence[str]


def trial_predictors(lineage: DataFrame, unit: Keys, rating: str, error: str, scope: Column, codes: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """M1: rating split within and between units, log error inside the scope, half-sum codes, validity."""
    out = within_between(lineage, unit, rating, scope)
    out = out.withColumn("log_error", F.when(F.coalesce(scope, F.lit(False)) & (F.col(error) > 0), F.ln(error)))
    out = out.withColumns({f"{name}_code": c.code_factor(F.col(name), levels) for name, levels in codes.items()})
    return out.withColumn("error_status", F.when(~F.coalesce(scope, F.lit(False)), "out_of_scope").when(F.col(error) > 0, "valid").otherwise("not_positive"))


def general_table(lineage: DataFrame, roi: DataFrame, roles: DataFrame, k: Keys, on: Keys) -> DataFrame:
    """M2: one row per trial and role: region values that a role asks for (``on``), joined to the trial, with a digest key."""
    rows = shape.select_roles(roi, roles, on).join(lineage, list(k))
    return rows.withColumn("row_key", c.digest_key(*[F.col(x) for x in k], F.col("role")))


def add_eligibility(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """M3: eligible rows break no rule; the others list the reasons."""
    out = df.withColumn("exclusion_reasons", F.array_join(c.issue_codes(rules), ";"))
    return out.withColumns({"eligible": F.col("exclusion_reasons") == "", "inclusion": F.when(F.col("exclusion_reasons") == "", "included").otherwise("excluded")})


def model_views(df: DataFrame, predicates: Mapping[str, Column]) -> tuple[dict[str, DataFrame], DataFrame]:
    """M4: named views and their counts."""
    return shape.views(df, predicates), aggs.surface_counts(df, predicates)


def design_rank(df: DataFrame, terms: Mapping[str, Column]) -> tuple[int, int]:
    """M5: (rank, columns) of a design matrix with intercept, from sums of products; only the small Gram matrix reaches the driver."""
    names = ["1", *terms]
    cols = [F.lit(1.0), *[t.cast("double") for t in terms.values()]]
    usable = df.select(*[x.alias(f"t{i}") for i, x in enumerate(cols)]).na.drop()
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = usable.agg(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    return int(np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-9)), len(names)


def value_identity(table: DataFrame, source: DataFrame, k: Keys, cols: Keys) -> DataFrame:
    """M6: per column the rows compared and those that differ; null equals null."""
    b = source.select(*k, *[F.col(x).alias(f"__{x}") for x in cols])
    j = table.select(*k, *cols).join(b, list(k))
    one = j.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(~F.col(x).eqNullSafe(F.col(f"__{x}"))).alias(x) for x in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col("__n").alias("n_compared"), F.col(x).alias("n_different")) for x in cols])).alias("__s")).select("__s.*")


def pooled_scale(df: DataFrame, col: str) -> DataFrame:
    """M7: median and MAD x 1.4826 of a whole column, by ranks: no task holds the column."""
    from .windows import quantiles_by_rank

    middle = quantiles_by_rank(df, col, {"median": 0.5}).select("median")
    away = df.select(col).crossJoin(F.broadcast(middle)).select(F.abs(F.col(col) - F.col("median")).alias("__away"))
    spread = quantiles_by_rank(away, "__away", {"__mad": 0.5})
    return middle.crossJoin(F.broadcast(spread)).select("median", (F.col("__mad") * 1.4826).alias("mad"))


def quantile_bins(df: DataFrame, col: str, ps: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """M8: ``bin`` low or high outside the cut points, which are kept; the middle is dropped. Cut points come from ranks."""
    from .windows import quantiles_by_rank

    cuts = F.broadcast(quantiles_by_rank(df, col, {"cut_low": ps[0], "cut_high": ps[1]}).drop("n"))
    out = df.crossJoin(cuts)
    return out.withColumn("bin", F.when(F.col(col) <= F.col("cut_low"), "low").when(F.col(col) >= F.col("cut_high"), "high")).filter("bin is not null")


def cell_factor(cols: Keys) -> Column:
    """M9: one factor of several; null if any is."""
    return F.when(~_any_null(cols), F.concat_ws(".", *[F.col(x).cast("string") for x in cols]))


def _any_null(cols: Keys) -> Column:
    out = F.lit(False)
    for x in cols:
        out = out | F.col(x).isNull()
    return out


def effect_maps(df: DataFrame, unit: str, groups: Keys, label: str, a, b, value: str) -> DataFrame:
    """Contrast of condition means within each unit, then mean, sd, se and t per group."""
    cells = df.groupBy(unit, *groups, label).agg(F.avg(value).alias("__v"))
    return aggs.two_level(aggs.contrast(cells, [unit, *groups], label, a, b, "__v"), unit, groups, "contrast")


def map_spec(spark, specs: Mapping[str, Sequence[tuple[Mapping[str, str], float]]]) -> DataFrame:
    """Rows (map, factors, weight, n_terms) from maps given as weighted cells, each a mapping of factors to levels.

    A difference is two cells with weights 1 and -1, a double contrast four, a mean of conditions two with 0.5, a raw condition map one.
    """
    names = sorted({f for cells in specs.values() for levels, _ in cells for f in levels})
    if any(set(levels) != set(names) for cells in specs.values() for levels, _ in cells):
        raise ValueError(f"each cell must name a level of {names}")
    rows = [(name, *[levels[f] for f in names], float(w), len(cells)) for name, cells in specs.items() for levels, w in cells]
    return spark.createDataFrame(rows, ", ".join(["map string", *[f"`{f}` string" for f in names], "weight double, n_terms int"]))


def contrast_maps(df: DataFrame, spec: DataFrame, unit: str, groups: Keys, value: str) -> DataFrame:
    """All maps of a spec in one pass: cell means per unit, their weighted sum, then units, mean, sd, se and t per map and group.

    A unit that lacks one of a map's cells has no effect there and isn't counted. t is 0 where the se is 0.
    """
    factors = [x for x in spec.columns if x not in ("map", "weight", "n_terms")]
    cells = df.groupBy(unit, *groups, *factors).agg(F.avg(value).alias("__m")).filter("__m is not null")
    for f in factors:
        cells = cells.withColumn(f, F.col(f).cast("string"))
    effects = cells.join(F.broadcast(spec), factors).groupBy("map", unit, *groups).agg(F.sum(F.col("weight") * F.col("__m")).alias("__e"), F.count(F.lit(1)).alias("__n"), F.max("n_terms").alias("__k")).filter("__n = __k")
    out = effects.groupBy("map", *groups).agg(F.count(F.lit(1)).alias("n"), F.avg("__e").alias("mean"), F.stddev_samp("__e").alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return out.withColumn("se", se).withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")).when(F.col("se") == 0, 0.0))


def estimands(draws: DataFrame, registry: DataFrame, k: Keys = ("sample",)) -> DataFrame:
    """Weighted sums of terms per draw, by a registry (estimand, term, weight)."""
    return draws.join(registry, "term").groupBy(*k, "estimand").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def estimand_routes(by_terms: DataFrame, by_predictions: DataFrame, k: Keys) -> DataFrame:
    """Largest difference between the two routes to the same estimands."""
    return checks.max_difference(by_terms, by_predictions, k, "value")


def draw_summary(draws: DataFrame, truth: DataFrame, k: Keys, level: float = 0.95) -> DataFrame:
    """Interval and point per parameter, and whether it covers the truth (k, truth)."""
    out = aggs.summarize_draws(draws, k, level).join(truth, list(k), "left")
    return out.withColumn("covered", (F.col("truth") >= F.col("lo")) & (F.col("truth") <= F.col("hi")))


def max_t(draws: DataFrame, observed: DataFrame, alpha: float = 0.05, plus_one: bool = False) -> DataFrame:
    """Family-wise threshold and p values from null draws (draw, t) and observed rows (..., t).

    p is the share of draws whose largest |t| reaches the observed one (``plus_one``: the observed table counts as a
    draw), and a test is significant from the threshold on. Counted by one pass over both tables in the order of |t|,
    ranged by value: no pair of draw and test is formed.
    """
    from .windows import order_index, quantiles_by_rank

    maxima = draws.groupBy("draw").agg(F.max(F.abs("t")).alias("at")).select("at", F.lit(True).alias("__draw"))
    limits = quantiles_by_rank(maxima, "at", {"threshold": 1 - alpha}).withColumnRenamed("n", "n_draws")
    both = observed.withColumns({"at": F.abs("t"), "__draw": F.lit(False)}).unionByName(maxima, allowMissingColumns=True)
    both = both.withColumns({"__down": -F.col("at"), "__later": ~F.col("__draw")})
    order = ["__down", "__later", *[x for x in observed.columns if x != "t"]]
    ranked = order_index(both, order, "__place").filter("not __draw")  # draws at least as large, and larger tests, stand before
    tests = order_index(ranked, ["__place"], "__test")
    out = tests.withColumn("n_reach", F.col("__place") - F.col("__test")).crossJoin(F.broadcast(limits))
    more = 1 if plus_one else 0
    return out.select(*observed.columns, "threshold", c.safe_divide(F.col("n_reach") + more, F.col("n_draws") + more).alias("p_fwe"), (F.abs("t") >= F.col("threshold")).alias("significant"))


def null_draws(spark, covariance: np.ndarray, n: int, df: float | None, seed: int) -> DataFrame:
    """N correlated draws (draw, test, t), normal or Student's t with ``df``; each draw is seeded by its own number."""
    factor = np.linalg.cholesky(np.asarray(covariance, float))
    size = len(factor)

    def run(batches):
        for part in batches:
            rows = []
            for d in part["id"]:
                rng = np.random.default_rng([seed, int(d)])
                z = factor @ rng.standard_normal(size)
                rows.append(z / np.sqrt(rng.chisquare(df) / df) if df else z)
            yield pd.DataFrame({"draw": np.repeat(part["id"].to_numpy(), size), "test": np.tile(np.arange(size), len(part)), "t": np.concatenate(rows) if rows else np.zeros(0)})

    return spark.range(n).mapInPandas(run, "draw bigint, test bigint, t double")


#: Rows of factors, and draws, that are multiplied at once.
FACTOR_ROWS, DRAW_BLOCK = 4096, 256


def contrast_factors(weights: DataFrame, terms: Sequence[str], covariance: np.ndarray) -> DataFrame:
    """Rows (test, factor) from contrasts (test, term, weight) of model terms with the given covariance (terms x terms).

    A test's row is its weights times the covariance's lower root, so that rows times independent normals are draws of all tests with their
    covariances; the covariance of the tests among themselves is never formed. Terms of the model are few; tests may be many.
    """
    root = np.linalg.cholesky(np.asarray(covariance, float))
    place = {t: i for i, t in enumerate(terms)}
    unknown = weights.filter(~F.col("term").isin(list(terms))).limit(1).count()
    if unknown or len(root) != len(place):
        raise checks.ContractError("contrasts must use the terms of the covariance")

    def run(batches):
        for part in batches:
            rows = []
            for ws in part["ws"]:
                w = np.zeros(len(root))
                for x in ws:
                    w[place[x["term"]]] += x["weight"]
                rows.append(w @ root)
            yield pd.DataFrame({"test": part["test"], "factor": rows})

    kind = weights.schema["test"].dataType.simpleString()
    return weights.groupBy("test").agg(F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight"))).alias("ws")).mapInPandas(run, f"test {kind}, factor array<double>")


def _normals(seed: int, first: int, upto: int, size: int, df: float | None) -> np.ndarray:
    """Independent normals (size x draws) of the draws from ``first`` on, each seeded by its own number; Student's t with ``df``."""
    z = np.empty((size, upto - first))
    for k, d in enumerate(range(first, upto)):
        rng = np.random.default_rng([seed, d])
        z[:, k] = rng.standard_normal(size)
        if df:
            z[:, k] /= np.sqrt(rng.chisquare(df) / df)
    return z


def null_maxima(factors: DataFrame, n: int, df: float | None, seed: int) -> DataFrame:
    """Rows (draw, t): the largest |t| over all tests of each of n null draws, for ``max_t``; tests are rows (test, factor).

    Draws are made again in each task from their numbers, in blocks, and multiplied with the task's blocks of tests; only maxima leave it, so
    a table of draws x tests is never formed. A test is scaled by its standard error, one without variance counts as 0.
    """

    def run(batches):
        best = np.zeros(n)

        def taken(rows):
            nonlocal best
            f = np.stack(rows)
            se = np.sqrt((f * f).sum(axis=1, keepdims=True))
            f = np.divide(f, se, out=np.zeros_like(f), where=se > 0)
            for first in range(0, n, DRAW_BLOCK):
                upto = min(first + DRAW_BLOCK, n)
                best[first:upto] = np.maximum(best[first:upto], np.abs(f @ _normals(seed, first, upto, f.shape[1], df)).max(axis=0))

        rows = []
        for part in batches:
            for f in part["factor"]:
                rows.append(np.asarray(f, float))
                if len(rows) == FACTOR_ROWS:
                    taken(rows)
                    rows = []
        if rows:
            taken(rows)
        if n:
            yield pd.DataFrame({"draw": np.arange(n), "t": best})

    return factors.select("factor").mapInPandas(run, "draw bigint, t double").groupBy("draw").agg(F.max("t").alias("t"))


def draw_moments(factors: DataFrame, n: int, df: float | None, seed: int) -> DataFrame:
    """Per test the mean, variance and largest |t| of its n scaled draws, as a check of the null."""

    def run(batches):
        for part in batches:
            f = np.stack([np.asarray(x, float) for x in part["factor"]]) if len(part) else np.zeros((0, 1))
            se = np.sqrt((f * f).sum(axis=1, keepdims=True))
            f = np.divide(f, se, out=np.zeros_like(f), where=se > 0)
            total, square, best = np.zeros(len(f)), np.zeros(len(f)), np.zeros(len(f))
            for first in range(0, n if len(f) else 0, DRAW_BLOCK):
                t = f @ _normals(seed, first, min(first + DRAW_BLOCK, n), f.shape[1], df)
                total, square, best = total + t.sum(axis=1), square + (t * t).sum(axis=1), np.maximum(best, np.abs(t).max(axis=1))
            yield pd.DataFrame({"test": part["test"], "n": n, "se": se[:, 0], "mean": total / n, "variance": square / n - (total / n) ** 2, "largest": best})

    kind = factors.schema["test"].dataType.simpleString()
    return factors.select("test", "factor").mapInPandas(run, f"test {kind}, n bigint, se double, mean double, variance double, largest double")


def results_table(effects: DataFrame, k: Keys, channel: str, t: str, significant: str) -> DataFrame:
    """Per effect the tests, significant ones and their share, the peak channel and the three strongest."""
    counts = effects.groupBy(*k).agg(F.count(F.lit(1)).alias("n_tests"), F.count_if(significant).alias("n_significant"))
    counts = counts.withColumn("share_significant", F.col("n_significant") / F.col("n_tests"))
    top = shape.topn_wide(effects, k, t, channel, 3)
    return counts.join(top, list(k))


def results_summary(effects: DataFrame, k: Keys, channel: str, effect: str, t: str, significant: str, pairs: DataFrame, hemispheres: DataFrame, cut: float = 2.0) -> DataFrame:
    """M16 in full: per map the tests, significant ones, share, peak channel with its effect and t, laterality, significant channels per hemisphere, tests beyond ``cut``, and the three strongest as text.

    ``pairs`` (left_ch, right_ch) gives the mean and sd of left less right over the whole map, ``hemispheres`` (channel, hemi: L, R or M)
    the counts; the peak is the largest absolute effect, ties by channel.
    """
    joined = effects.join(hemispheres.select(F.col(channel), "hemi"), channel, "left")
    shown = F.struct((-F.abs(effect)).alias("o"), F.col(channel).alias("channel"), F.col(effect).alias("e"), F.col(t).alias("t"))
    sig = F.coalesce(F.col(significant), F.lit(False))
    counts = joined.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if(sig).alias("n_significant"), F.min(shown).alias("__peak"), F.count_if(F.abs(t) >= cut).alias("n_beyond_cut"),
        *[F.count_if(sig & (F.col("hemi") == h)).alias(f"n_{name}") for h, name in (("L", "left"), ("M", "mid"), ("R", "right"))],
    )
    counts = counts.select(*k, "n_tests", "n_significant", (F.col("n_significant") / F.col("n_tests")).alias("share_significant"), F.col("__peak.channel").alias("peak_channel"), F.col("__peak.e").alias("peak_effect"), F.col("__peak.t").alias("peak_t"), "n_left", "n_mid", "n_right", "n_beyond_cut")
    text = effects.withColumn("__text", F.format_string("%s (c=%.3f, t=%.2f)", F.col(channel).cast("string"), effect, t))
    top = shape.topn_wide(text, k, t, "__text", 3)
    sides = aggs.laterality(effects, k, channel, effect, pairs).withColumnsRenamed({"mean": "mean_left_less_right", "sd": "sd_left_less_right"})
    return counts.join(sides, list(k), "left").join(top, list(k), "left")


def draw_contrasts(draws: DataFrame, groups: Keys, label: str, a, b, level: float = 0.95) -> DataFrame:
    """Contrasts of draws with interval, point and credibility by any grouping."""
    return aggs.credible_diff(draws, groups, label, a, b, level)


def assert_no_outcomes(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The frame itself, unless a column name holds a forbidden pattern (in any case)."""
    found = [x for x in df.columns if any(p.lower() in x.lower() for p in patterns)]
    if found:
        raise checks.ContractError(f"outcome columns: {found}")
    return df
