"""Continuity of recordings that were split, concatenated or begun anew.

Trials carry the unit, the file, their number in the recording and an onset on the unit's clock. Each file is held against the files of its
unit before it, in order of their first onsets; files that go on from each other form chains (gaps and islands over the sequence).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c

Keys = Sequence[str]

#: Relations of a file to those before it, and those that begin a new chain.
RELATIONS = ("first", "overlapping", "continues", "gap", "restarted")
BREAKS = ("first", "overlapping", "restarted")


def file_spans(trials: DataFrame, unit: Keys, file: str, number: str, onset: str, tie: Keys = (), restart: Column | None = None) -> DataFrame:
    """One row per file: trials, range of onsets and numbers, and restarts inside: places where the number falls or ``restart`` marks one."""
    w = Window.partitionBy(*unit, file).orderBy(onset, *tie)
    falls = F.coalesce(F.col(number) < F.lag(number).over(w), F.lit(False))
    marked = F.lit(False) if restart is None else F.coalesce(restart, F.lit(False)) & (F.row_number().over(w) > 1)
    return trials.withColumn("__r", falls | marked).groupBy(*unit, file).agg(
        F.count(F.lit(1)).alias("n_trials"), F.min(onset).alias("first_onset"), F.max(onset).alias("last_onset"),
        F.min(number).alias("low_number"), F.max(number).alias("high_number"), F.count_if("__r").alias("n_restarts"),
    )


def file_chain(spans: DataFrame, unit: Keys, file: str) -> DataFrame:
    """Adds per file its ``part`` in the unit, ``relation`` to what came before, ``n_missing`` or ``n_repeated`` numbers at the border, and ``chain``.

    overlapping: begins before an earlier file has ended; restarted: begins at a number that was reached before; gap: numbers between
    are missing; continues: begins with the next number.
    """
    order = Window.partitionBy(*unit).orderBy("first_onset", file)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ended, reached = F.max("last_onset").over(before), F.max("high_number").over(before)
    out = spans.withColumns({"part": F.row_number().over(order), "__ended": ended, "__reached": reached})
    step = F.col("low_number") - F.col("__reached")
    relation = c.case_map([(F.col("part") == 1, "first"), (F.col("first_onset") < F.col("__ended"), "overlapping"), (step <= 0, "restarted"), (step > 1, "gap")], "continues")
    later = F.col("part") > 1
    out = out.withColumns({"relation": relation, "n_missing": F.when(later & (step > 1), step - 1).otherwise(0), "n_repeated": F.when(later & (step <= 0), F.least(F.col("high_number"), F.col("__reached")) - F.col("low_number") + 1).otherwise(0)})
    return out.withColumn("chain", F.sum(F.col("relation").isin(*BREAKS).cast("int")).over(order)).drop("__ended", "__reached")


def unit_classes(chain: DataFrame, unit: Keys) -> DataFrame:
    """One row per unit: files, chains, restarts, missing and repeated numbers, and the class of the worst thing that holds.

    overlapping: files overlap in time; restarted: a later file begins anew; concatenated: a file begins anew inside; split_with_gap and
    split: files go on from each other, with or without missing numbers; single: one file without restart.
    """
    has = lambda r: F.count_if(F.col("relation") == r)
    sums = [F.sum(x).alias(x) for x in ("n_trials", "n_restarts", "n_missing", "n_repeated")]
    out = chain.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_files"), F.max("chain").alias("n_chains"), *sums, *[has(r).alias(f"n_{r}") for r in RELATIONS[1:]])
    kind = c.case_map([(F.col("n_overlapping") > 0, "overlapping"), (F.col("n_restarted") > 0, "restarted"), (F.col("n_restarts") > 0, "concatenated"), (F.col("n_gap") > 0, "split_with_gap"), (F.col("n_files") > 1, "split")], "single")
    return out.withColumn("continuity", kind)


def join_facts(audit: DataFrame, unit: Keys, file: str) -> DataFrame:
    """Audit rows counted per file and, with a null file, per unit: matched, observed only, expected only, with issues, strictly clean, duplicate keys.

    Expected-only rows have no file, so they count for the unit alone.
    """
    status, issues = F.col("join_status"), F.coalesce("issues", F.lit(""))
    counts = {
        "join_rows": F.lit(True), "matched_rows": status == "both", "raw_only_rows": status == "left_only", "offset_only_rows": status == "right_only",
        "duplicate_rows": issues.contains("duplicate"), "issue_rows": issues != "", "strict_clean_rows": (status == "both") & (issues == ""),
    }
    both = audit.withColumn("__scope", F.explode(F.array(F.lit("split_part"), F.lit("unit_total")))).filter((F.col("__scope") == "unit_total") | F.col(file).isNotNull())
    rows = both.withColumn(file, F.when(F.col("__scope") == "split_part", F.col(file)))
    return rows.groupBy(*unit, "__scope", file).agg(*[F.count_if(e).alias(n) for n, e in counts.items()]).withColumnRenamed("__scope", "row_kind")


def continuity_audit(trials: DataFrame, audit: DataFrame, unit: Keys, file: str, number: str, onset: str, tie: Keys = (), restart: Column | None = None) -> DataFrame:
    """One row per file and one total per unit (``row_kind``): range, relation, chain, class of the unit, counts of the audit and an observation.

    ``audit`` holds the unit, the file (null where no trial was observed), ``join_status`` and ``issues``.
    """
    chain = file_chain(file_spans(trials, unit, file, number, onset, tie, restart), unit, file)
    classes = unit_classes(chain, unit)
    facts = join_facts(audit, unit, file)
    shown = ["n_trials", "low_number", "high_number", "n_restarts", "n_missing", "n_repeated"]
    parts = chain.select(*unit, F.lit("split_part").alias("row_kind"), file, "part", "relation", "chain", *shown)
    total = chain.groupBy(*unit).agg(F.sum("n_trials").alias("n_trials"), F.min("low_number").alias("low_number"), F.max("high_number").alias("high_number"), *[F.sum(x).alias(x) for x in shown[3:]])
    blank = {file: chain.schema[file].dataType, "part": "int", "relation": "string", "chain": "bigint"}
    total = total.select(*unit, F.lit("unit_total").alias("row_kind"), *[F.lit(None).cast(t).alias(x) for x, t in blank.items()], *shown)
    rows = parts.unionByName(total).join(classes.select(*unit, "continuity"), list(unit))
    same = [rows[x].eqNullSafe(facts[x]) for x in (*unit, "row_kind", file)]
    names = [x for x in facts.columns if x not in (*unit, "row_kind", file)]
    on = same[0]
    for e in same[1:]:
        on = on & e
    out = rows.join(facts, on, "left").select(*[rows[x] for x in rows.columns], *[F.coalesce(facts[x], F.lit(0)).alias(x) for x in names])
    seen = c.case_map([
        (F.col("relation").isin("restarted", "overlapping") | (F.col("n_restarts") > 0), "numbers_begin_anew"),
        ((F.col("duplicate_rows") > 0) | (F.col("offset_only_rows") > 0) | (F.col("raw_only_rows") > 0), "not_resolved_on_join"),
        (F.col("n_missing") > 0, "numbers_missing_between_files"),
    ], "no_problem_visible")
    return out.withColumn("observation", seen)
