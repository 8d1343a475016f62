"""Grouped aggregates (group A)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_divide
from .windows import step_dist

Keys = Sequence[str]


def summary(c: str) -> list[Column]:
    """A1: sum, mean, sd, min, max, count; nulls are skipped."""
    return [F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n")]


def paired_sd(c: Column) -> Column:
    """A2: sqrt(sum(x^2) / (n - 1)); null for fewer than two."""
    return F.sqrt(F.when(F.count(c) > 1, F.sum(c * c) / (F.count(c) - 1)))


#: Fixed value: the middle of the screen, in pixels.
SCREEN_MIDDLE = 960.0


def trace_shape(df: DataFrame, k: Keys, x: str = "x", y: str = "y", middle: float = SCREEN_MIDDLE) -> DataFrame:
    """A3: larger side of the bounding box, and the signed shift of its centre from the screen's middle in half widths (null without width)."""
    width = F.max(x) - F.min(x)
    shift = (safe_divide(F.min(x) - F.lit(middle), width) + 0.5) * 2
    return df.groupBy(*k).agg(F.greatest(width, F.max(y) - F.min(y)).alias("size"), shift.alias("shift"))


def path_length(df: DataFrame, k: Keys, o: Keys, x: str = "x", y: str = "y") -> DataFrame:
    """A4: sum of the distances between neighbours."""
    return df.withColumn("__d", step_dist(k, o, x, y)).groupBy(*k).agg(F.sum("__d").alias("path_length"))


def count_where(flags: Mapping[str, Column]) -> list[Column]:
    """A5: count and share of true flags; null is false in the count and left out of the share."""
    return [c for n, f in flags.items() for c in (F.count_if(f).alias(f"n_{n}"), F.avg(f.cast("double")).alias(f"share_{n}"))]


def any_flag(f: Column) -> Column:
    """A6."""
    return F.coalesce(F.bool_or(f), F.lit(False))


def all_flag(f: Column) -> Column:
    """A null counts as false."""
    return F.bool_and(F.coalesce(f, F.lit(False)))


def first_by(x: str, o) -> Column:
    """Value of the first row in order."""
    return F.min_by(x, o)


def first_nonmissing(x: str, o) -> Column:
    """First value that isn't null."""
    return F.min_by(x, F.when(F.col(x).isNotNull(), F.col(o) if isinstance(o, str) else o))


def last_by(x: str, o) -> Column:
    """Value of the last row in order."""
    return F.max_by(x, o)


def first_where(x: str, condition: Column, o: str) -> Column:
    """Value of the first row that satisfies the condition."""
    return F.min_by(x, F.when(condition, F.col(o)))


def quantiles(df: DataFrame, k: Keys, col: str, ps: Sequence[float], exact: bool = True) -> DataFrame:
    """A10: quantiles with linear interpolation. ``exact=False`` takes Spark's sketch, whose state is bounded at any size."""
    made = [(F.percentile(col, F.lit(p)) if exact else F.percentile_approx(col, p, 10000)).alias(f"q{round(100 * p)}") for p in ps]
    return df.groupBy(*k).agg(*made)


def mad(df: DataFrame, k: Keys, col: str, scale: float = 1.0) -> DataFrame:
    """Median and median absolute deviation (times ``scale``), in two passes."""
    medians = df.groupBy(*k).agg(F.percentile(col, F.lit(0.5)).alias("median"))
    return df.join(medians, list(k)).groupBy(*k).agg(F.first("median").alias("median"), (F.percentile(F.abs(F.col(col) - F.col("median")), F.lit(0.5)) * scale).alias("mad"))


def robust_log_z(df: DataFrame, k: Keys, col: str, out: str = "robust_z") -> DataFrame:
    """Z of log10 against the group's median and MAD / 0.6744897501960817; 0 where the MAD is 0."""
    logged = df.withColumn("__l", F.when(F.col(col) > 0, F.log10(col)))
    centre = mad(logged, k, "__l", 1 / 0.6744897501960817).withColumnsRenamed({"median": "__median", "mad": "__mad"})
    z = F.when(F.col("__mad") == 0, F.lit(0.0)).otherwise((F.col("__l") - F.col("__median")) / F.col("__mad"))
    return logged.join(centre, list(k)).withColumn(out, z).drop("__l", "__median", "__mad")


def collect_sorted(c: str, sep: str = ";") -> Column:
    """Distinct values, sorted, as a text."""
    return F.array_join(F.sort_array(F.collect_set(c)), sep)


def union_codes(df: DataFrame, k: Keys, col: str, sep: str = ";") -> DataFrame:
    """Union of the code lists in a text column, sorted."""
    codes = df.select(*k, F.explode_outer(F.split(col, sep)).alias("__c")).withColumn("__c", F.when(F.trim("__c") != "", F.trim("__c")))
    return codes.groupBy(*k).agg(F.array_join(F.sort_array(F.collect_set("__c")), sep).alias("codes"))


def n_distinct(*cols: str) -> Column:
    """Distinct tuples; those with a null are left out."""
    return F.count_distinct(*cols)


def pivot_events(df: DataFrame, k: Keys, label: str, onset: str, names: Sequence[str]) -> DataFrame:
    """Per event name its count and first onset, in one row per group."""
    made = [c for n in names for c in (F.count_if(F.col(label) == n).alias(f"{n}_count"), F.min(F.when(F.col(label) == n, F.col(onset))).alias(f"{n}_onset"))]
    return df.groupBy(*k).agg(*made)


def expected_members(df: DataFrame, k: Keys, label: str, names: Sequence[str]) -> DataFrame:
    """Expected labels that are missing, and labels that are not expected or occur more than once, sorted."""
    counts = df.groupBy(*k, label).agg(F.count(F.lit(1)).alias("__n"))
    sets = counts.groupBy(*k).agg(F.collect_set(label).alias("__s"), F.collect_set(F.when((F.col("__n") > 1) | ~F.col(label).isin(list(names)), F.col(label))).alias("__e"))
    want = F.array(*[F.lit(n) for n in names])
    return sets.select(*k, F.array_join(F.sort_array(F.array_except(want, "__s")), ";").alias("missing"), F.array_join(F.sort_array("__e"), ";").alias("extra"))


def event_span(df: DataFrame, k: Keys, label: str, onset: str, a: str, b: str) -> DataFrame:
    """First onset of b less first onset of a."""
    at = lambda n: F.min(F.when(F.col(label) == n, F.col(onset)))
    return df.groupBy(*k).agg((at(b) - at(a)).alias("span"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (column, value, n) for several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("__p")).groupBy("__p.column", "__p.value").agg(F.count(F.lit(1)).alias("n"))


def multi_dim_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts by each dimension alone, as (dimension, value, n), by grouping sets."""
    view = df.select(*[F.col(d).cast("string").alias(d) for d in dims])
    sets = view.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"__g_{d}") for d in dims])
    name = F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, F.col(d)) for d in dims])
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def status_counts(df: DataFrame, dims: Keys, flags: Mapping[str, Column]) -> DataFrame:
    """Rows and rows per predicate, by group."""
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_{n}") for n, c in flags.items()])


def surface_counts(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Rows (surface, n), one per predicate, from one scan."""
    one = df.agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("surface"), F.col(n).alias("n")) for n in flags])).alias("__s")).select("__s.*")


def two_level(df: DataFrame, unit: str, groups: Keys, value: str) -> DataFrame:
    """Mean of unit means, their sd, se and t = mean / se (0 if se is 0 or null)."""
    units = df.groupBy(unit, *groups).agg(F.avg(value).alias("__m"))
    out = units.groupBy(*groups).agg(F.count("__m").alias("n"), F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("sd"))
    out = out.withColumn("se", F.col("sd") / F.sqrt("n"))
    return out.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")).otherwise(F.lit(0.0)))


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection of its distribution, integrated by Simpson's rule."""
    from math import lgamma, pi, sqrt

    scale = np.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi)

    def cdf(x: float) -> float:
        u = np.linspace(0, np.arctan(x / sqrt(df)), 2001)  # x = sqrt(df) tan u keeps the tails finite
        y = scale * sqrt(df) * np.cos(u) ** (df - 1)
        h = u[1] - u[0]
        return 0.5 + h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())

    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def mean_ci(df: DataFrame, groups: Keys, value: str, level: float = 0.95) -> DataFrame:
    """Mean and t-based confidence interval. Critical values are looked up by degrees of freedom, 1 to 200, then the normal limit's."""
    spark = df.sparkSession
    p = 0.5 + level / 2
    table = spark.createDataFrame([(d, float(t_quantile(p, d))) for d in [*range(1, 201)]], "__d bigint, __t double")
    limit = float(t_quantile(p, 10**6))
    out = df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    joined = out.join(F.broadcast(table), F.col("n") - 1 == F.col("__d"), "left")
    half = F.when(F.col("n") > 1, F.coalesce("__t", F.lit(limit)) * F.col("sd") / F.sqrt("n"))
    return joined.withColumns({"lo": F.col("mean") - half, "hi": F.col("mean") + half}).drop("__d", "__t")


def contrast(df: DataFrame, k: Keys, label: str, a, b, value: str, out: str = "contrast") -> DataFrame:
    """The group's value at label a less that at b."""
    at = lambda x: F.max(F.when(F.col(label) == x, F.col(value)))
    return df.groupBy(*k).agg((at(a) - at(b)).alias(out))


def double_contrast(df: DataFrame, k: Keys, outer: str, a, b, inner: str, c, d, value: str) -> DataFrame:
    """(c - d at a) less (c - d at b)."""
    return contrast(contrast(df, [*k, outer], inner, c, d, value, "__v"), k, outer, a, b, "__v", "double_contrast")


def summarize_draws(df: DataFrame, k: Keys, level: float = 0.95) -> DataFrame:
    """Interval of the draws (sample > 0) and the point estimate (sample 0)."""
    draws = F.when(F.col("sample") > 0, F.col("value"))
    return df.groupBy(*k).agg(F.percentile(draws, F.lit((1 - level) / 2)).alias("lo"), F.max(F.when(F.col("sample") == 0, F.col("value"))).alias("point"), F.percentile(draws, F.lit((1 + level) / 2)).alias("hi"))


def credible_diff(df: DataFrame, k: Keys, label: str, a, b, level: float = 0.95) -> DataFrame:
    """Interval of a - b per draw, and whether it excludes 0."""
    out = summarize_draws(contrast(df, [*k, "sample"], label, a, b, "value", "value"), k, level)
    return out.withColumn("credible", (F.col("lo") > 0) | (F.col("hi") < 0))


def correlation(df: DataFrame, k: Keys, a: str, b: str) -> DataFrame:
    """Pearson correlation."""
    return df.groupBy(*k).agg(F.corr(a, b).alias("r"))


def signal_moments(c: str) -> list[Column]:
    """Population variance, peak to peak, min, max over finite values, and their number."""
    x = F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    return [F.var_pop(x).alias("variance"), (F.max(x) - F.min(x)).alias("ptp"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n_finite")]


def cv_percent(c: str) -> Column:
    """Sd over absolute mean, in percent; null for mean 0."""
    return safe_divide(F.stddev_samp(c) * 100, F.abs(F.avg(c)))


def group_range(df: DataFrame, g: Keys, c: str) -> DataFrame:
    """Range of the finite values; groups without any are left out."""
    finite = df.filter(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    return finite.groupBy(*g).agg(F.min(c).alias("lo"), F.max(c).alias("hi"))


def grand_mean(df: DataFrame, unit: str, cell: Keys, value: str) -> DataFrame:
    """Mean per unit and cell, and the mean of those as unit 0."""
    units = df.groupBy(unit, *cell).agg(F.avg(value).alias("mean"))
    return units.unionByName(units.groupBy(*cell).agg(F.avg("mean").alias("mean")).withColumn(unit, F.lit(0).cast(units.schema[unit].dataType)))


def mean_cells(df: DataFrame, group: Keys, arr: str) -> DataFrame:
    """Mean of arrays place by place, in place order."""
    cells = df.select(*group, F.posexplode(arr).alias("__p", "__v")).groupBy(*group, "__p").agg(F.avg("__v").alias("__m"))
    return cells.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__m"))), lambda x: x["__m"]).alias("mean"))


def saturation(df: DataFrame, k: Keys, c: str, lo: float, hi: float) -> DataFrame:
    """Values below and above a scale, extremes, percent outside."""
    out = df.groupBy(*k).agg(F.count_if(F.col(c) < lo).alias("n_below"), F.count_if(F.col(c) > hi).alias("n_above"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n"))
    return out.withColumn("percent_saturated", safe_divide((F.col("n_below") + F.col("n_above")) * 100.0, F.col("n")))


def stage_counts(audits: Mapping[str, DataFrame], k: Keys) -> DataFrame:
    """Audit rows and distinct trials per stage."""
    both = None
    for name, df in audits.items():
        part = df.select(F.lit(name).alias("stage"), *k)
        both = part if both is None else both.unionByName(part)
    return both.groupBy("stage").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*k).alias("n_trials"))


def stage_runtime(df: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Runs, total, median, least and most seconds per stage."""
    return df.groupBy(stage).agg(F.count(seconds).alias("n"), F.sum(seconds).alias("total"), F.percentile(seconds, F.lit(0.5)).alias("median"), F.min(seconds).alias("min"), F.max(seconds).alias("max"))


def laterality(df: DataFrame, k: Keys, channel: str, value: str, pairs: DataFrame) -> DataFrame:
    """Mean and sd of left less right over a table of pairs (left_ch, right_ch)."""
    side = lambda s: df.select(*k, F.col(channel).alias(f"{s}_ch"), F.col(value).alias(f"__{s}"))
    both = side("left").join(pairs, "left_ch").join(side("right"), [*k, "right_ch"])
    return both.groupBy(*k).agg(F.avg(F.col("__left") - F.col("__right")).alias("mean"), F.stddev_samp(F.col("__left") - F.col("__right")).alias("sd"))


def count_complete(df: DataFrame, k: Keys, c: str, levels: Sequence[str]) -> DataFrame:
    """Count per level as columns, 0 where a level is absent."""
    return df.groupBy(*k).pivot(c, list(levels)).count().fillna(0, list(levels))


def stream_balance(df: DataFrame, part: Keys, code: str, codes: Sequence[str], ratio: float) -> DataFrame:
    """Largest over smallest count of the core codes, and a status."""
    counts = count_complete(df, part, code, codes)
    most, least = F.greatest(*[F.col(c) for c in codes]), F.least(*[F.col(c) for c in codes])
    status = F.when(least == 0, "missing_code").when(most > least * ratio, "unbalanced").otherwise("coherent")
    return counts.withColumns({"balance": safe_divide(most, least), "status": status})


def describe_units(df: DataFrame, unit: str, group: Keys, cols: Sequence[str]) -> DataFrame:
    """One row per unit (its least values), then count, mean and sd by group."""
    units = df.groupBy(unit, *group).agg(*[F.min(c).alias(c) for c in cols])
    return units.groupBy(*group).agg(F.count(F.lit(1)).alias("n_units"), *[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def run_aggregate(df: DataFrame, status: str, warnings: str, size: str) -> DataFrame:
    """One row: units, units per status as JSON, distinct warnings, total bytes."""
    by_status = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"), F.collect_set(warnings).alias("w"), F.sum(size).alias("b"))
    return by_status.agg(
        F.sum("n").alias("n_units"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", status, F.col("n").cast("string")))), ";").alias("statuses"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))), ";").alias("warnings"),
        F.sum("b").alias("bytes"),
    )


def range_text(c: str) -> Column:
    """``min-max``, or the one value."""
    return F.when(F.min(c) == F.max(c), F.min(c).cast("string")).otherwise(F.concat_ws("-", F.min(c).cast("string"), F.max(c).cast("string")))


def mode_of(df: DataFrame, k: Keys, c: str) -> DataFrame:
    """Most frequent value, the smallest on ties."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(*k, c).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*k).agg(F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias("mode"))
