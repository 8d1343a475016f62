"""Set operations and reshaping (group U), sorts and top-k (group T)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggs import grand_mean  # noqa: F401  (U and A share it)

Keys = Sequence[str]


def stack(dfs: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Union by name; missing columns are null; the label names the source."""
    out = None
    for name, df in dfs.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_all(df: DataFrame, label: str, name: str = "all") -> DataFrame:
    """The rows, and again under the label ``all``."""
    return df.unionByName(df.withColumn(label, F.lit(name)))


def distinct(df: DataFrame, cols: Keys) -> DataFrame:
    """U3."""
    return df.select(*cols).distinct()


def snapshot_diff(before: DataFrame, after: DataFrame, k: Keys, cols: Keys) -> DataFrame:
    """U4: per key added, removed, changed or same; null equals null."""
    a = before.select(*k, F.struct(*cols).alias("__a"), F.lit(True).alias("__l"))
    b = after.select(*k, F.struct(*cols).alias("__b"), F.lit(True).alias("__r"))
    status = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    return a.join(b, list(k), "full_outer").select(*k, status.alias("change"))


def set_compare(a: Column, b: Column) -> list[Column]:
    """Union, intersection, a only, b only (sorted arrays) and the Jaccard index; of two empty sets it is 1."""
    both, either = F.array_intersect(a, b), F.array_union(a, b)
    jaccard = F.when(F.size(either) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(either))
    return [F.array_sort(either).alias("either"), F.array_sort(both).alias("both"), F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b"), jaccard.alias("jaccard")]


def set_change(base: Column, now: Column) -> list[Column]:
    """Members retained, lost and gained against a base set."""
    return [F.array_sort(F.array_intersect(base, now)).alias("retained"), F.array_sort(F.array_except(base, now)).alias("lost"), F.array_sort(F.array_except(now, base)).alias("gained")]


def criteria_union(df: DataFrame, unit: Keys, item: str, primary: Mapping[str, Column], report: Mapping[str, Column], warn_at: float) -> DataFrame:
    """Items that meet any primary criterion, items that only meet report-only ones, the share of the former, a warning."""
    meets = lambda c: F.collect_set(F.when(c, F.col(item)))
    sets = df.groupBy(*unit).agg(meets(_any(primary)).alias("__p"), meets(_any(report)).alias("__r"), F.count_distinct(item).alias("__n"))
    share = F.size("__p") / F.col("__n")
    return sets.select(*unit, F.array_join(F.array_sort("__p"), ";").alias("primary_items"), F.array_join(F.array_sort(F.array_except("__r", "__p")), ";").alias("report_items"), share.alias("share"), (share > warn_at).alias("warning"))


def _any(cases: Mapping[str, Column]) -> Column:
    out = F.lit(False)
    for c in cases.values():
        out = out | F.coalesce(c, F.lit(False))
    return out


def determinism(df: DataFrame, keys: Keys, result: str, success: Column) -> DataFrame:
    """U8: runs, successful runs, distinct results of those, and whether there is just one."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(success).alias("n_success"), F.count_distinct(F.when(success, F.col(result))).alias("n_results"))
    return out.withColumn("deterministic", F.col("n_results") == 1)


def melt(df: DataFrame, ids: Keys, values: Keys, name: str = "variable", value: str = "value") -> DataFrame:
    """U9."""
    return df.unpivot(list(ids), list(values), name, value)


def spread(df: DataFrame, k: Keys, name: str, levels: Sequence, value: str) -> DataFrame:
    """One column per level; the first value counts."""
    return df.groupBy(*k).pivot(name, list(levels)).agg(F.first(value, ignorenulls=True))


def explode_text(df: DataFrame, col: str, sep: str, at: str = "position") -> DataFrame:
    """One row per part of a text, numbered from 0; ``sep`` is a pattern."""
    return df.select(*[c for c in df.columns if c != col], F.posexplode(F.split(col, sep)).alias(at, col))


def separate(c: Column, names: Mapping[str, str], sep: str) -> list[Column]:
    """Parts of a text as typed columns; what is missing or doesn't fit is null."""
    parts = F.split(c, sep)
    return [F.get(parts, F.lit(k)).try_cast(kind).alias(n) for k, (n, kind) in enumerate(names.items())]


def nest(df: DataFrame, k: Keys, o: Keys, cols: Keys, out: str = "rows") -> DataFrame:
    """A group's rows as an array of structs in order."""
    return df.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct(*o, *[c for c in cols if c not in o]))).alias(out))


def unnest(df: DataFrame, col: str = "rows") -> DataFrame:
    """The other way round."""
    return df.select(*[c for c in df.columns if c != col], F.inline(col))


def views(df: DataFrame, predicates: Mapping[str, Column], register: bool = False) -> dict[str, DataFrame]:
    """Named lazy subsets, also as temporary views if asked for."""
    out = {n: df.filter(p) for n, p in predicates.items()}
    if register:
        for n, v in out.items():
            v.createOrReplaceTempView(n)
    return out


def select_roles(df: DataFrame, roles: DataFrame, on: Keys) -> DataFrame:
    """Rows that a role asks for, with the role's columns; a row may serve several roles."""
    return df.join(roles, list(on))


def data_grid(df: DataFrame, cols: Keys, nested: Keys = ()) -> DataFrame:
    """U16: all combinations of the columns' distinct values, times the observed combinations of ``nested``."""
    out = df.select(*nested).distinct() if nested else None
    for c in cols:
        level = df.select(c).distinct()
        out = level if out is None else out.crossJoin(level)
    return out


def registry(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small constant table."""
    return spark.createDataFrame(list(rows), schema)


def exceptions(df: DataFrame, unit: Keys, codes: Column) -> DataFrame:
    """One row per unit and violated rule, each once."""
    return df.select(*unit, F.explode(codes).alias("issue")).distinct()


# ---- sorts, limits, top-k


def order_by(df: DataFrame, cols: Keys) -> DataFrame:
    """Ascending, nulls last; end with a unique column."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def top1_abs(df: DataFrame, part: Keys, c: str, tie: str) -> DataFrame:
    """The row of the largest absolute value, the smallest ``tie`` on equal ones."""
    return top_n(df, part, [F.abs(F.col(c)).desc_nulls_last(), F.col(tie)], 1)


def top_n(df: DataFrame, part: Keys, order: Sequence[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def topn_wide(df: DataFrame, part: Keys, c: str, name: str, n: int) -> DataFrame:
    """Names of the n largest absolute values as columns top1, top2, ..."""
    w = Window.partitionBy(*part).orderBy(F.abs(F.col(c)).desc_nulls_last(), name)
    ranked = df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n)
    return ranked.groupBy(*part).agg(*[F.max(F.when(F.col("__n") == k, F.col(name))).alias(f"top{k}") for k in range(1, n + 1)])


def best_candidate(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """T4: the best row per problem."""
    return top_n(df, keys, order, 1)


def first_n(df: DataFrame, cls: Keys, o: Keys, n: int) -> DataFrame:
    """T5: the first n of each class by name: a deterministic sample."""
    return top_n(df, cls, [F.col(c) for c in o], n)


def decimate(df: DataFrame, k: Keys, o: Keys, n: int, r: int = 0) -> DataFrame:
    """Every n-th row of the group, from row r (counted from 0)."""
    w = Window.partitionBy(*k).orderBy(*o)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.pmod(F.col("__n") - 1, F.lit(n)) == r).drop("__n")


def page_number(grp: Keys, unit: str, per_page: int) -> Column:
    """Page, from 1, of a unit among its group's units."""
    return (F.floor((F.dense_rank().over(Window.partitionBy(*grp).orderBy(unit)) - 1) / per_page) + 1).cast("bigint")


def split_units(df: DataFrame, unit: Keys, item: str, p: float, seed: int) -> DataFrame:
    """Test rows are the first floor(n * p) of each unit by a hash of seed, unit and item (SHA-256, so any engine agrees)."""
    rank = F.row_number().over(Window.partitionBy(*unit).orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(u).cast("string") for u in unit], F.col(item).cast("string")), 256), item))
    size = F.count(F.lit(1)).over(Window.partitionBy(*unit))
    return df.withColumn("split", F.when(rank <= F.floor(size * p), "test").otherwise("train"))


def select_surface(inventory: DataFrame, files: DataFrame, name: str, readable: Column) -> DataFrame:
    """Readable inventory rows for the listed files. Raises if a listed file is missing or unreadable, or twice in the inventory."""
    good = inventory.filter(readable)
    state = files.select(name).distinct().join(good.groupBy(name).agg(F.count(F.lit(1)).alias("__n")), name, "left")
    wrong = state.filter(F.coalesce("__n", F.lit(0)) != 1).orderBy(name).limit(5).collect()
    if wrong:
        raise ValueError(f"listed files without exactly one readable row: {[r[0] for r in wrong]}")
    return good.join(files.select(name).distinct(), name, "left_semi")
