"""Contract checks (group Q). Each returns the violations as a DataFrame (or list); ``ensure`` turns any into an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


class ContractError(ValueError):
    """A table breaks its contract."""


def ensure(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raise with a few examples if there is any violation."""
    rows = violations.limit(show).collect()
    if rows:
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def require_columns(df: DataFrame, cols: Keys) -> DataFrame:
    """Q1: the frame itself if it has all columns."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def duplicates(df: DataFrame, k: Keys) -> DataFrame:
    """Q2: keys that occur more than once."""
    return df.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, k: Keys) -> None:
    ensure(duplicates(df, k), f"duplicate keys {list(k)}")


def count_mismatches(counts: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Q3: surfaces (surface, n) whose count isn't the expected one; absent ones too."""
    want = counts.sparkSession.createDataFrame(list(expected.items()), "surface string, expected bigint")
    return want.join(counts, "surface", "left").filter(~F.col("n").eqNullSafe(F.col("expected")))


def key_mismatches(a: DataFrame, b: DataFrame, k: Keys, o: Keys) -> DataFrame:
    """Q4: places (``place``, from 0) at which the ordered keys of two tables differ; numbered without gathering a table in one task."""
    from .windows import order_index

    number = lambda df, s: order_index(df.select(*k, *[c for c in o if c not in k]), o, "place").select("place", F.struct(*k).alias(s))
    return number(a, "a").join(number(b, "b"), "place", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


def out_of_bounds(df: DataFrame, c: str, lo, hi, k: Keys = ()) -> DataFrame:
    """Q5: values outside lo .. hi (null too), and values that occur twice in a group."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(*k, c)) > 1 if k else F.lit(False)
    return df.withColumn("__t", twice).filter(F.col(c).isNull() | ~F.col(c).between(lo, hi) | F.col("__t")).drop("__t")


def not_finite(df: DataFrame, cols: Keys, positive: bool = False) -> DataFrame:
    """Q6: rows (column, n) of columns with null, NaN, infinite or, if asked, non-positive values."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | (F.col(c) <= 0 if positive else F.lit(False))
    one = df.agg(*[F.count_if(bad(c)).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in cols])).alias("__s")).select("__s.*").filter("n > 0")


def outside_domain(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Q7: distinct values that aren't allowed, null included."""
    return df.select(col).distinct().filter(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def wrong_members(df: DataFrame, k: Keys, member: str, n: int) -> DataFrame:
    """Q8: groups that don't have exactly n distinct members."""
    return df.groupBy(*k).agg(F.count_distinct(member).alias("n")).filter(F.col("n") != n)


def max_difference(a: DataFrame, b: DataFrame, k: Keys, col: str) -> DataFrame:
    """Q9: one row: matched keys, largest absolute difference, unmatched keys."""
    x, y = a.select(*k, F.col(col).alias("__a"), F.lit(True).alias("__l")), b.select(*k, F.col(col).alias("__b"), F.lit(True).alias("__r"))
    j = x.join(y, list(k), "full_outer")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return j.agg(F.count_if(both).alias("n"), F.max(F.when(both, F.abs(F.col("__a") - F.col("__b")))).alias("max_difference"), F.count_if(~both).alias("n_unmatched"))


def assert_close(a: DataFrame, b: DataFrame, k: Keys, col: str, tol: float) -> None:
    ensure(max_difference(a, b, k, col).filter((F.coalesce("max_difference", F.lit(0.0)) > tol) | (F.col("n_unmatched") > 0)), f"{col} differs")


def broken_implications(df: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Q10: rows (rule, n): how often a is true and b isn't."""
    one = df.agg(*[F.count_if(F.coalesce(a, F.lit(False)) & ~F.coalesce(b, F.lit(False))).alias(n) for n, (a, b) in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("__s")).select("__s.*")


def missing_reasons(df: DataFrame, status: Keys) -> DataFrame:
    """Q11: rows (status, n): false statuses whose ``<status>_reason`` is null or blank."""
    one = df.agg(*[F.count_if(~F.coalesce(F.col(s), F.lit(False)) & (F.trim(F.coalesce(f"{s}_reason", F.lit(""))) == "")).alias(s) for s in status])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in status])).alias("__s")).select("__s.*")


def null_scope(df: DataFrame, cols: Keys, scope: Column) -> DataFrame:
    """Q12: rows (column, n_null_inside, n_value_outside)."""
    inside = F.coalesce(scope, F.lit(False))
    one = df.agg(*[x for c in cols for x in (F.count_if(inside & F.col(c).isNull()).alias(f"{c}__i"), F.count_if(~inside & F.col(c).isNotNull()).alias(f"{c}__o"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__i").alias("n_null_inside"), F.col(f"{c}__o").alias("n_value_outside")) for c in cols])).alias("__s")).select("__s.*")


def member_set(df: DataFrame, k: Keys, member: str, o: Keys, expected: Sequence[str]) -> DataFrame:
    """Q13: per group missing, unexpected and duplicate members (sorted texts), and whether the order is the expected one."""
    want = F.array(*[F.lit(x) for x in expected])
    got = df.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct(*o, F.col(member).alias("__m")))), lambda x: x["__m"]).alias("__g"))
    twice = F.array_distinct(F.filter("__g", lambda x: F.size(F.filter("__g", lambda y: y == x)) > 1))
    text = lambda c: F.array_join(F.array_sort(c), ";")
    return got.select(*k, text(F.array_except(want, "__g")).alias("missing"), text(F.array_except("__g", want)).alias("unexpected"), text(twice).alias("duplicate"), (F.col("__g") == want).alias("in_order"))


def null_counts(df: DataFrame, cols: Keys) -> DataFrame:
    """Q14: rows (column, n) of null counts."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in cols])).alias("__s")).select("__s.*")
