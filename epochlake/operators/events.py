"""Event stream reconciliation (group V): recordings of ordered events against expected trials."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from . import aggs, joins, shape
from .windows import carried, dup_flag, first_problem, lag, ordered, segment_by, whole

Keys = Sequence[str]


def trigger_events(samples: DataFrame, rec: Keys, o: Keys, stim: str, mask: int = 255) -> DataFrame:
    """V1: rows at which the masked stimulus value rises to a new non-zero value."""
    coded = samples.withColumn("code", c.mask_code(F.col(stim), mask))
    before = coded.withColumn("__p", F.coalesce(lag("code", rec, o), F.lit(0).cast("bigint")))
    return before.filter((F.col("code") > F.col("__p")) & (F.col("code") != 0)).drop("__p")


def map_codes(df: DataFrame, code_map: DataFrame, code: str) -> DataFrame:
    """V2: ``event_name`` of a code (null if unknown) and whether it is a task event."""
    return df.join(code_map, code, "left").withColumn("task_event", F.col("event_name").isNotNull())


def assess_stream(df: DataFrame, part: Keys, code: str, codes: Sequence[str], ratio: float) -> DataFrame:
    """V3: counts of the core codes, their balance, a status, per recording and source."""
    return aggs.stream_balance(df, part, code, codes, ratio)


def compare_streams(a: DataFrame, b: DataFrame, part: Keys, order: Keys, at: str, code: str, tol: float) -> DataFrame:
    """V4: per recording the events of both sources, the pairs by position, differing codes, largest difference, a class."""
    pairs = joins.pair_streams(a, b, part, order, at, tol)
    stats = pairs.groupBy(*part).agg(F.count(F.lit(1)).alias("n_paired"), F.count_if(~F.col(f"{code}_a").eqNullSafe(F.col(f"{code}_b"))).alias("n_code_differs"), F.max(F.abs("difference")).alias("max_difference"))
    size = lambda df, n: df.groupBy(*part).agg(F.count(F.lit(1)).alias(n))
    out = size(a, "n_a").join(size(b, "n_b"), list(part), "full_outer").join(stats, list(part), "left")
    out = out.fillna(0, ["n_a", "n_b", "n_paired", "n_code_differs"])
    kind = c.case_map([(F.col("n_a") == 0, "only_b"), (F.col("n_b") == 0, "only_a"), (F.col("n_a") != F.col("n_b"), "counts_differ"), (F.col("n_code_differs") > 0, "codes_differ"), (F.col("max_difference") > tol, "times_differ")], "equivalent")
    return out.withColumn("comparison", kind)


def select_source(comparison: DataFrame, a: DataFrame, b: DataFrame, part: Keys, prefer_b: Sequence[str] = ("only_b",)) -> DataFrame:
    """V5: the events of the chosen source per recording (a unless the comparison's class prefers b), with the reason."""
    chosen = comparison.select(*part, F.when(F.col("comparison").isin(list(prefer_b)), "b").otherwise("a").alias("selected_source"), F.col("comparison").alias("selection_reason"))
    both = shape.stack({"a": a, "b": b}, "selected_source")
    return both.join(chosen, [*part, "selected_source"])


def propose_sequence(events: DataFrame, part: Keys, o: Keys, label: str, onset: str, order: Sequence[str], gap: float = 0.002) -> DataFrame:
    """V6: for interior rows that repeat the raw label before them, a duplicate (next event within ``gap``) or the next label in the order.

    The last label of the order has no next one and stays unresolved. Labels outside the order are skipped.
    """
    name = F.col(label)
    known = name.isin(list(order))
    interior = lag(label, part, o).isNotNull() & F.lead(onset).over(ordered(part, o)).isNotNull() & (F.row_number().over(ordered(part, o)) > 1)
    again = interior & (name == lag(label, part, o))
    soon = F.lead(onset).over(ordered(part, o)) - F.col(onset) < gap
    following = c.case_map([(name == x, y) for x, y in zip(order, order[1:])])
    out = events.withColumns({"__again": F.coalesce(again, F.lit(False)), "__soon": F.coalesce(soon, F.lit(False))})
    action = c.case_map([(F.col("__again") & F.col("__soon"), "duplicated"), (F.col("__again") & following.isNull(), "unresolved"), (F.col("__again"), "relabeled"), (~known, "skipped")], "unchanged")
    proposed = F.when(action == "duplicated", None).when(action == "relabeled", following).when(known, name)
    return out.withColumns({"sequence_action": action, "proposed_label": proposed}).drop("__again", "__soon")


def number_trials(events: DataFrame, part: Keys, o: Keys, label: str, onset: str, start: str, follow: str, practice_over: float) -> DataFrame:
    """V7: a trial begins at ``start``, or at a ``follow`` that no start precedes (a bad start).

    Trials whose time from start to follow exceeds ``practice_over`` are practice and get no number; the others are
    numbered on; of those, bad starts lose their number again, so later trials keep theirs.
    """
    previous = lag(label, part, o)
    bad = (F.col(label) == follow) & ~previous.eqNullSafe(F.lit(start))
    out = events.withColumn("bad_start", bad)
    out = out.withColumn("sequence", segment_by((F.col(label) == start) | F.col("bad_start"), part, o))
    out = out.withColumn("__wait", F.when((F.col(label) == follow) & ~F.col("bad_start"), F.col(onset) - lag(onset, part, o)))
    trials = out.filter("sequence > 0").groupBy(*part, "sequence").agg(F.min_by("__wait", F.when(F.col("__wait").isNotNull(), F.struct(*o))).alias("wait"), F.bool_or("bad_start").alias("bad_trial"))
    trials = trials.withColumn("practice", F.coalesce(F.col("wait") > practice_over, F.lit(False)))
    number = F.sum((~F.col("practice")).cast("int")).over(ordered(part, ["sequence"]).rowsBetween(Window.unboundedPreceding, 0))
    trials = trials.withColumn("trial", F.when(~F.col("practice") & ~F.col("bad_trial"), number))
    return out.drop("__wait").join(trials.select(*part, "sequence", "practice", "trial"), [*part, "sequence"], "left")


def summarize_trials(events: DataFrame, k: Keys, label: str, onset: str, names: Sequence[str]) -> DataFrame:
    """V8: per trial the counts and first onsets of the expected events, missing and repeated ones, span, issue codes."""
    out = aggs.pivot_events(events, k, label, onset, names)
    missing = c.issue_codes([(F.col(f"{n}_count") == 0, f"missing_{n}") for n in names])
    twice = c.issue_codes([(F.col(f"{n}_count") > 1, f"repeated_{n}") for n in names])
    out = out.withColumn("issues", F.array_join(F.concat(missing, twice), ";"))
    return out.withColumns({"duration": F.col(f"{names[-1]}_onset") - F.col(f"{names[0]}_onset"), "complete": F.col("issues") == ""})


def expected_offsets(task: DataFrame, traces: DataFrame, k: Keys) -> DataFrame:
    """V9: expected timing per trial: from the task (it, mt, stimulus_mt) and, where a trace exists, its onset and duration.

    ``real_start`` and ``real_end`` count from the stimulus; a trial without a trace keeps the task's times.
    """
    out = task.join(traces, list(k), "left")
    physical = F.col("movement_time").isNotNull()
    start = F.col("it") + F.coalesce("start_shift", F.lit(0.0))
    end = start + F.when(physical, F.col("movement_time")).otherwise(F.col("mt"))
    return out.withColumns({"physical": physical, "real_start": start, "real_end": end, "end_trigger": F.col("it") + F.col("mt")})


def offset_join_audit(trials: DataFrame, offsets: DataFrame, k: Keys, observed: str, expected: str, tolerances: Sequence[float] = (0.15, 0.25)) -> DataFrame:
    """Observed against expected trials: join status, duration mismatches at each tolerance, duplicate keys, issue codes."""
    a = trials.withColumn("__da", dup_flag(k))
    b = offsets.withColumn("__db", dup_flag(k))
    out = joins.reconcile(a, b, k)
    gap = F.abs(F.col(observed) - F.col(expected))
    flags = {f"mismatch_{round(1000 * t)}ms": F.coalesce(gap > t, F.lit(False)) for t in tolerances}
    out = out.withColumns(flags)
    rules = [(F.col("join_status") == "left_only", "no_expected_trial"), (F.col("join_status") == "right_only", "no_observed_trial"), (F.coalesce(F.col("__da"), F.lit(False)), "duplicate_observed"), (F.coalesce(F.col("__db"), F.lit(False)), "duplicate_expected")]
    rules += [(F.col(n), n) for n in flags]
    return out.withColumn("issues", F.array_join(c.issue_codes(rules), ";")).drop("__da", "__db")


def candidate_audit(problems: DataFrame, offsets: DataFrame, part: Keys, index: str, candidate: str, value: str, other: str, width: int = 5) -> DataFrame:
    """Expected trials near a problem's number, scored by the difference of durations; rank 1 is best; whether it beats the nominal one."""
    near = joins.nearby_candidates(problems, offsets, part, index, candidate, width).withColumn("score", F.abs(F.col(value) - F.col(other)))
    rank = F.row_number().over(whole([*part, index]).orderBy(F.col("score").asc_nulls_last(), F.abs("index_distance"), candidate))
    nominal = F.min(F.when(F.col("index_distance") == 0, F.col("score"))).over(whole([*part, index]))
    return near.withColumns({"candidate_rank": rank, "better_than_nominal": F.coalesce(F.col("score") < nominal, F.lit(False))})


def first_mismatch(audit: DataFrame, part: Keys, o: str, flag: Column) -> DataFrame:
    """Per recording the first problem and the share of problems after it."""
    return first_problem(audit, part, o, flag)


def join_metrics_table(audit: DataFrame, label: str) -> DataFrame:
    """Counts of the join's states under a label (before or after a repair)."""
    states = {s: F.col("join_status") == s for s in ("both", "left_only", "right_only")}
    return aggs.surface_counts(audit, {**states, "with_issues": F.col("issues") != ""}).withColumn("label", F.lit(label))


def strict_clean(df: DataFrame) -> Column:
    """Matched without any issue."""
    return (F.col("join_status") == "both") & (F.col("issues") == "")


def continuity_audit(events: DataFrame, part: Keys, o: Keys, label: str, marker: str, onset: str) -> DataFrame:
    """Per recording its segments between restart markers: number, events, first and last onset, whether it follows a restart."""
    cut = events.withColumn("segment", segment_by(F.col(label) == marker, part, o))
    out = cut.filter(F.col(label) != marker).groupBy(*part, "segment").agg(F.count(F.lit(1)).alias("n_events"), F.min(onset).alias("first_onset"), F.max(onset).alias("last_onset"))
    return out.withColumn("position", F.when(F.col("segment") == 0, "before_restart").otherwise("after_restart"))


def classify_raw_only(audit: DataFrame, offsets: DataFrame, part: Keys, index: str, candidate: str, candidates: DataFrame | None = None) -> DataFrame:
    """Observed trials without an expected one: before, inside or after the expected range, or near a candidate."""
    ranges = offsets.groupBy(*part).agg(F.min(candidate).alias("__lo"), F.max(candidate).alias("__hi"))
    out = audit.filter(F.col("join_status") == "left_only").join(ranges, list(part), "left")
    if candidates is not None:
        out = joins.exists_flags(out, candidates, [*part, index], {"__near": F.col("better_than_nominal")})
    else:
        out = out.withColumn("__near", F.lit(False))
    kind = c.case_map([(F.col("__lo").isNull(), "no_expected_unit"), (F.col("__near"), "near_candidate"), (F.col(index) < F.col("__lo"), "before_range"), (F.col(index) > F.col("__hi"), "after_range")], "inside_range")
    return out.withColumn("raw_only_class", kind).drop("__lo", "__hi", "__near")


def surface_regression(old: DataFrame, new: DataFrame, k: Keys, cols: Keys, skip: DataFrame | None = None) -> DataFrame:
    """Keys that changed between two surfaces, outside the skipped ones."""
    out = shape.snapshot_diff(old, new, k, cols).filter("change <> 'same'")
    return out if skip is None else joins.drop_trials(out, skip, [x for x in k if x in skip.columns])


def trial_anchors(events: DataFrame, k: Keys, label: str, onset: str, preference: Sequence[str]) -> DataFrame:
    """Per trial the first event of the most preferred kind, and all events as an ordered array."""
    rank = c.case_map([(F.col(label) == n, i) for i, n in enumerate(preference)])
    chosen = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col(onset).alias("at"), F.col(label).alias("name"))))
    rows = F.array_sort(F.collect_list(F.struct(F.col(onset), F.col(label))))
    return events.groupBy(*k).agg(chosen.alias("__c"), rows.alias("provenance")).select(*k, F.col("__c.at").alias("anchor_onset"), F.col("__c.name").alias("anchor_event"), F.coalesce(F.col("__c.rank") > 0, F.lit(False)).alias("anchor_fallback"), "provenance")


def eligibility_ledger(audit: DataFrame, anchors: DataFrame, k: Keys, duration: str, min_duration: float) -> DataFrame:
    """One row per trial with its statuses (primary, strict), reasons and a digest key. Strict implies primary."""
    out = audit.join(anchors.select(*k, "anchor_onset", "anchor_fallback"), list(k), "left")
    matched, anchored = F.col("join_status") == "both", F.col("anchor_onset").isNotNull()
    long_enough = F.coalesce(F.col(duration) >= min_duration, F.lit(False))
    primary = matched & anchored & long_enough
    decision = c.first_rule([(~matched, "exclude", "not_matched", "no counterpart"), (~anchored, "exclude", "no_anchor", "no anchor event"), (~long_enough, "exclude", "short", "under the least duration")], ("include", "eligible", "meets all rules"))
    strict = primary & (F.col("issues") == "") & ~F.coalesce(F.col("anchor_fallback"), F.lit(False))
    out = out.select("*", *decision, *c.status_fields("strict", strict, ("clean", "no issue"), ("issues", "see issues")))
    return out.withColumns({"primary": primary, "trial_key": c.digest_key(*[F.col(x) for x in k])})


def ledger_summaries(ledger: DataFrame, dims: Keys) -> DataFrame:
    """Trials, primary and strict ones and those with issues, by dimension."""
    return aggs.status_counts(ledger, dims, {"primary": F.col("primary"), "strict": F.col("strict"), "issues": F.col("issues") != ""})


def append_events(events: DataFrame, offsets: DataFrame, k: Keys, label: str, onset: str, end: str) -> DataFrame:
    """Expected start and end added to a trial's events as ``real_start`` and ``real_end``, in order; trials without ``end`` are dropped."""
    made = [offsets.select(*k, F.col(n).alias(onset), F.lit(n).alias(label)) for n in ("real_start", "real_end")]
    both = events.select(*k, onset, label).unionByName(made[0]).unionByName(made[1]).filter(F.col(onset).isNotNull())
    has_end = F.coalesce(F.bool_or(F.col(label) == end).over(whole(k)), F.lit(False))
    out = both.withColumn("__e", has_end).filter("__e").drop("__e")
    return out.withColumn("event_order", F.row_number().over(ordered(k, [onset, label])))


def unit_manifest(spine: DataFrame, summaries: Sequence[DataFrame], k: Keys, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Every expected unit with its summaries and issue codes."""
    return joins.join_all(spine, summaries, k).withColumn("issues", F.array_join(c.issue_codes(rules), ";"))


def cut_at_marker(df: DataFrame, part: Keys, label: str, onset: str, marker: str) -> DataFrame:
    """Rows before a recording's first restart marker; recordings without one stay whole."""
    first = F.min(F.when(F.col(label) == marker, F.col(onset))).over(whole(part))
    return df.withColumn("__m", first).filter(F.col("__m").isNull() | (F.col(onset) < F.col("__m"))).drop("__m")


def recording_summary(events: DataFrame, part: Keys, label: str, low: int) -> DataFrame:
    """Per recording that has events their number, counts by name as text, and a flag for few (``file_facts`` knows the others)."""
    counts = events.groupBy(*part, label).agg(F.count(F.lit(1)).alias("__n"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", label, F.col("__n").cast("string")))), ";")
    out = counts.groupBy(*part).agg(F.sum("__n").alias("n_events"), text.alias("counts"))
    return out.withColumns({"few_events": F.col("n_events") < low})


def file_facts(inventory: DataFrame, events: DataFrame, part: Keys, label: str, order: Sequence[str], low: int, rules: Sequence[tuple[Column, str]] = (), provenance: Keys = ()) -> DataFrame:
    """V24 per recording of the inventory, with or without events: counts, a pattern of named events in a given order, flags, issue codes and provenance.

    ``no_events`` and ``few_events`` (some, but under ``low``) are flags and codes; ``rules`` (condition on the inventory and the counts, code) add to them.
    Events of recordings that the inventory lacks are counted as ``not_in_inventory`` rows of their own.
    """
    counts = events.groupBy(*part).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(label).alias("n_names"), *[F.count_if(F.col(label) == x).alias(f"__{i}") for i, x in enumerate(order)])
    known = inventory.select(*part, *[x for x in provenance if x not in part]).withColumn("__known", F.lit(True))
    out = known.join(counts, list(part), "full").withColumns({"n_events": F.coalesce("n_events", F.lit(0)), "n_names": F.coalesce("n_names", F.lit(0)), "in_inventory": F.coalesce("__known", F.lit(False))})
    shown = F.array_compact(F.array(*[F.when(F.col(f"__{i}") > 0, F.concat(F.lit(f"{x}="), F.col(f"__{i}").cast("string"))) for i, x in enumerate(order)]))
    none, few = F.col("n_events") == 0, (F.col("n_events") > 0) & (F.col("n_events") < low)
    codes = c.issue_codes([(none, "no_events"), (few, "few_events"), (~F.col("in_inventory"), "not_in_inventory"), *rules])
    out = out.withColumns({"pattern": F.array_join(shown, ";"), "no_events": none, "few_events": few, "issues": F.array_join(codes, ";")})
    return out.drop("__known", *[f"__{i}" for i in range(len(order))])


def last_label(df: DataFrame, part: Keys, o: Keys, label: Column) -> Column:
    """The latest label at or before each row."""
    return carried(label, part, o)
