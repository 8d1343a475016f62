"""Joins on keys, positions, ranges and neighbourhoods (group J)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def join_all(df: DataFrame, summaries: Sequence[DataFrame], k: Keys) -> DataFrame:
    """Left join of several summaries on the same key."""
    for s in summaries:
        df = df.join(s, list(k), "left")
    return df


def join_keys(df: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "left") -> DataFrame:
    """Join on differently named keys; the right ones are dropped."""
    renamed = right
    for l, r in keys.items():
        renamed = renamed.withColumnRenamed(r, f"__{l}")
    condition = [F.col(l) == F.col(f"__{l}") for l in keys]
    return df.join(renamed, condition, how).drop(*[f"__{l}" for l in keys])


def reconcile(left: DataFrame, right: DataFrame, k: Keys, status: str = "join_status") -> DataFrame:
    """Full outer join with a status: both, left_only or right_only. Other columns must have different names."""
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    joined = a.join(b, list(k), "full_outer")
    return joined.withColumn(status, F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")).drop("__l", "__r")


def zip_by_position(a: DataFrame, b: DataFrame, k: Keys, oa: Keys, ob: Keys) -> DataFrame:
    """Rows paired by their place in the group; groups without any row in b are dropped."""
    number = lambda df, o: df.withColumn("position", F.row_number().over(Window.partitionBy(*k).orderBy(*o)))
    return number(a, oa).join(number(b, ob), [*k, "position"], "full_outer").join(b.select(*k).distinct(), list(k), "left_semi")


def drop_trials(df: DataFrame, bad: DataFrame, k: Keys) -> DataFrame:
    """Rows whose key isn't in ``bad``."""
    return df.join(bad.select(*k).distinct(), list(k), "left_anti")


def keep_trials(df: DataFrame, good: DataFrame, k: Keys) -> DataFrame:
    """Rows whose key is in ``good``."""
    return df.join(good.select(*k).distinct(), list(k), "left_semi")


def right_join(observed: DataFrame, expected: DataFrame, k: Keys) -> DataFrame:
    """Every expected row, with what was observed."""
    return observed.join(expected, list(k), "right")


#: Rows of a table of definitions that every row is held against, at most.
MAX_DEFINITIONS = 10_000


def definitions(table: DataFrame, max_rows: int = MAX_DEFINITIONS) -> DataFrame:
    """A table that every task gets whole; one with more rows is refused."""
    if table.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} definitions; join them by keys or cells")
    return F.broadcast(table)


def range_join(df: DataFrame, ranges: DataFrame, value: str, lo: str = "lo", hi: str = "hi", width: float | None = None) -> DataFrame:
    """Each row with every range that holds its value, ends included.

    A short table of definitions (``MAX_DEFINITIONS``) goes to all tasks. With ``width`` both sides are cut into cells of that width and
    joined on them, for range tables that grow with the data.
    """
    inside = F.col(value).between(F.col(lo), F.col(hi))
    if width is None:
        return df.join(definitions(ranges), inside)
    cell = lambda c: F.floor(c / F.lit(float(width))).cast("bigint")
    dealt = ranges.withColumn("__cell", F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi)))))
    return df.withColumn("__cell", cell(F.col(value))).join(dealt, "__cell").filter(inside).drop("__cell")


def nearby_candidates(problems: DataFrame, offsets: DataFrame, part: Keys, index: str, candidate: str, width: int = 5) -> DataFrame:
    """Rows of ``offsets`` whose index lies within ``width`` of a problem's in the same part; cells of the width's size."""
    cell = lambda c: F.floor(c / (width + 1)).cast("bigint")
    spread = problems.withColumn("__cell", F.explode(F.sequence(cell(F.col(index)) - 1, cell(F.col(index)) + 1)))
    near = offsets.withColumn("__cell", cell(F.col(candidate)))
    joined = spread.join(near, [*part, "__cell"]).drop("__cell")
    return joined.filter(F.abs(F.col(candidate) - F.col(index)) <= width).withColumn("index_distance", F.col(candidate) - F.col(index))


def cut_epochs(samples: DataFrame, anchors: DataFrame, part: Keys, sample: str, anchor: str, lo: int, hi: int) -> DataFrame:
    """Samples from anchor + lo to anchor + hi, ends included, joined by cells of the window's length."""
    size = hi - lo + 1
    cell = lambda c: F.floor(c / size).cast("bigint")
    spread = anchors.withColumn("__cell", F.explode(F.sequence(cell(F.col(anchor) + lo), cell(F.col(anchor) + hi))))
    joined = samples.withColumn("__cell", cell(F.col(sample))).join(spread, [*part, "__cell"]).drop("__cell")
    return joined.filter(F.col(sample).between(F.col(anchor) + lo, F.col(anchor) + hi)).withColumn("offset", F.col(sample) - F.col(anchor))


def label_segments(samples: DataFrame, events: DataFrame, k: Keys, t: str, label: str) -> DataFrame:
    """Each sample with the label of the latest event at or before it; no as-of join, one window over both."""
    both = samples.drop(label).withColumn("__e", F.lit(1)).unionByName(events.select(*k, t, label).withColumn("__e", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*k).orderBy(t, "__e").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(label, F.last(label, ignorenulls=True).over(w)).filter("__e = 1").drop("__e")


def join_baseline(df: DataFrame, k: Keys, value: str, base: Column) -> DataFrame:
    """Each cell with the mean of its group's baseline cells."""
    means = df.filter(base).groupBy(*k).agg(F.avg(value).alias("baseline"))
    return df.join(means, list(k), "left")


def remap_ids(df: DataFrame, mapping: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the mapped id, rows whose id has no mapping); never falls back to the source id."""
    return df.join(mapping.select(source, target), source), df.join(mapping.select(source), source, "left_anti")


def cross_registry(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Each row with every entry of a small registry."""
    return df.crossJoin(definitions(registry))


def explode_crosswalk(df: DataFrame, col: str, sep: str = ";") -> DataFrame:
    """One row per entry of a list in a text, trimmed; rows without entries are dropped."""
    return df.withColumn(col, F.explode(F.filter(F.transform(F.split(col, sep), lambda x: F.trim(x)), lambda x: x != "")))


def pair_streams(a: DataFrame, b: DataFrame, part: Keys, order: Keys, at: str, tolerance: float) -> DataFrame:
    """The n-th event of one stream with the n-th of the other; whether they lie within the tolerance."""
    number = lambda df, s: df.withColumn("position", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).select(*part, "position", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in part])
    joined = number(a, "a").join(number(b, "b"), [*part, "position"])
    difference = F.col(f"{at}_b") - F.col(f"{at}_a")
    return joined.withColumn("difference", difference).withColumn("within", F.abs(difference) <= tolerance)


def pairwise(df: DataFrame, part: Keys, item: str) -> DataFrame:
    """Unordered pairs of a group's items. For groups of bounded size, such as methods or channels."""
    a, b = df.select(*part, F.col(item).alias("item_a")), df.select(*part, F.col(item).alias("item_b"))
    return a.join(b, list(part)).filter("item_a < item_b")


def backfill_unique(df: DataFrame, parent: DataFrame, k: Keys, col: str) -> DataFrame:
    """A missing value from the parent, if exactly one parent row has the key."""
    only = parent.groupBy(*k).agg(F.count(F.lit(1)).alias("__n"), F.first(col).alias("__v")).filter("__n = 1").drop("__n")
    return df.join(only, list(k), "left").withColumn(col, F.coalesce(col, "__v")).drop("__v")


def exists_flags(df: DataFrame, facts: DataFrame, k: Keys, flags: Mapping[str, Column]) -> DataFrame:
    """Per row, whether any fact of its key satisfies each predicate."""
    found = facts.groupBy(*k).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    return df.join(found, list(k), "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in flags})
