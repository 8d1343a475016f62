"""Queries of the event stream chain (group V): observed trials from ``events``, expected ones from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import continuity as ct
from ..operators import events as v
from ..operators import policies as pol
from ..operators.windows import ordered, whole
from .base import EV, query, rounded

col = F.col
P, O = ["user_id"], ["onset", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY onset, event_id)"
WU = "OVER (PARTITION BY user_id ORDER BY onset, event_id ROWS UNBOUNDED PRECEDING)"
#: Trials: a segment from one view event to the next.
TR = EV + f", tr AS (SELECT *, sum((event_type = 'view')::INTEGER) {WU} AS trial FROM ev)"
SUM = TR + ", su AS (SELECT user_id, trial, count(*) FILTER (event_type = 'view') AS nv, min(onset) FILTER (event_type = 'view') AS ov, count(*) FILTER (event_type = 'click') AS nc, min(onset) FILTER (event_type = 'click') AS oc, count(*) FILTER (event_type = 'purchase') AS np, min(onset) FILTER (event_type = 'purchase') AS op FROM tr WHERE trial > 0 GROUP BY 1, 2), ts AS (SELECT *, op - ov AS duration, concat_ws(';', CASE WHEN nv = 0 THEN 'missing_view' END, CASE WHEN nc = 0 THEN 'missing_click' END, CASE WHEN np = 0 THEN 'missing_purchase' END, CASE WHEN nv > 1 THEN 'repeated_view' END, CASE WHEN nc > 1 THEN 'repeated_click' END, CASE WHEN np > 1 THEN 'repeated_purchase' END) AS issues FROM su)"
#: Expected trials: a customer's orders by date; the n-th has a number and a duration in seconds.
EX = "ex AS (SELECT o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS trial, o_totalprice / 10 AS expected FROM orders)"
AUD = SUM + ", " + EX + ", au AS (SELECT coalesce(ts.user_id, ex.user_id) AS user_id, coalesce(ts.trial, ex.trial)::BIGINT AS trial, duration, expected, CASE WHEN ts.user_id IS NULL THEN 'right_only' WHEN ex.user_id IS NULL THEN 'left_only' ELSE 'both' END AS join_status, coalesce(abs(duration - expected) > 3000, false) AS a, coalesce(abs(duration - expected) > 15000, false) AS b FROM ts FULL JOIN ex ON ts.user_id = ex.user_id AND ts.trial = ex.trial), aud AS (SELECT *, concat_ws(';', CASE WHEN join_status = 'left_only' THEN 'no_expected_trial' END, CASE WHEN join_status = 'right_only' THEN 'no_observed_trial' END, CASE WHEN a THEN 'mismatch_3000000ms' END, CASE WHEN b THEN 'mismatch_15000000ms' END) AS issues FROM au)"


def trials(t):
    from ..operators.windows import segment_by

    return t.ev().withColumn("trial", segment_by(col("event_type") == "view", P, O).cast("bigint"))


def summary(t):
    return v.summarize_trials(trials(t).filter("trial > 0"), ["user_id", "trial"], "event_type", "onset", ["view", "click", "purchase"])


def expected(t):
    n = F.row_number().over(ordered(["o_custkey"], ["o_orderdate", "o_orderkey"])).cast("bigint")
    return t.orders.select(col("o_custkey").alias("user_id"), n.alias("trial"), (col("o_totalprice") / 10).alias("expected"))


def audit(t):
    return v.offset_join_audit(summary(t).select("user_id", "trial", "duration"), expected(t), ["user_id", "trial"], "duration", "expected", (3000, 15000))


@query("v1_trigger_events", f"WITH {EV}, m AS (SELECT event_id, user_id, onset, k & 63 AS code FROM ev) SELECT event_id, code FROM (SELECT *, coalesce(lag(code) {W}, 0) AS p FROM m) WHERE code > p AND code <> 0")
def _(t):
    return v.trigger_events(t.ev(), P, O, "k", 63).select("event_id", "code")


@query("v2_map_codes", "SELECT event_id, name AS event_name, name IS NOT NULL AS task_event FROM events LEFT JOIN (VALUES ('view', 'stim_on'), ('click', 'red_on')) m(event_type, name) USING (event_type)")
def _(t):
    m = t.spark.createDataFrame([("view", "stim_on"), ("click", "red_on")], "event_type string, event_name string")
    return v.map_codes(t.events, m, "event_type").select("event_id", "event_name", "task_event")


@query("v3_assess_stream", "WITH c AS (SELECT user_id, event_id % 2 AS source, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1, 2) SELECT user_id, source, CASE WHEN least(v, c) = 0 THEN 'missing_code' WHEN greatest(v, c) > least(v, c) * 2.0 THEN 'unbalanced' ELSE 'coherent' END AS status FROM c")
def _(t):
    return v.assess_stream(t.events.withColumn("source", col("event_id") % 2), ["user_id", "source"], "event_type", ["view", "click"], 2.0).select("user_id", "source", "status")


CMP = EV + ", a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY onset, event_id) AS p FROM ev WHERE event_id % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY onset, event_id) AS p FROM ev WHERE event_id % 2 = 1), pr AS (SELECT user_id, count(*) AS n_paired, count(*) FILTER (a.event_type <> b.event_type) AS n_code_differs, max(abs(b.onset - a.onset)) AS d FROM a JOIN b USING (user_id, p) GROUP BY 1), cm AS (SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_paired, 0) AS n_paired, coalesce(n_code_differs, 0) AS n_code_differs, d FROM (SELECT user_id, count(*) AS n_a FROM a GROUP BY 1) x FULL JOIN (SELECT user_id, count(*) AS n_b FROM b GROUP BY 1) y ON x.user_id = y.user_id LEFT JOIN pr ON pr.user_id = coalesce(x.user_id, y.user_id)), cl AS (SELECT *, CASE WHEN n_a = 0 THEN 'only_b' WHEN n_b = 0 THEN 'only_a' WHEN n_a <> n_b THEN 'counts_differ' WHEN n_code_differs > 0 THEN 'codes_differ' WHEN d > 60 THEN 'times_differ' ELSE 'equivalent' END AS comparison FROM cm)"


def compared(t):
    ev = t.ev()
    return v.compare_streams(ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1"), P, O, "onset", "event_type", 60)


@query("v4_compare_streams", f"WITH {CMP} SELECT user_id, n_a, n_b, n_paired, n_code_differs, round(d, 6) AS max_difference, comparison FROM cl")
def _(t):
    return rounded(compared(t))


@query("v5_select_source", f"WITH {CMP} SELECT event_id, CASE WHEN comparison = 'codes_differ' THEN 'b' ELSE 'a' END AS selected_source, comparison AS selection_reason FROM ev JOIN cl USING (user_id) WHERE event_id % 2 = (comparison = 'codes_differ')::INTEGER")
def _(t):
    ev = t.ev()
    return v.select_source(compared(t), ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1"), P, ("only_b", "codes_differ")).select("event_id", "selected_source", "selection_reason")


@query("v6_propose_sequence", f"WITH {EV}, l AS (SELECT event_id, event_type AS e, lag(event_type) {W} AS p, lead(onset) {W} - onset AS g FROM ev), x AS (SELECT *, e = p AND g IS NOT NULL AS again, CASE e WHEN 'view' THEN 'click' WHEN 'click' THEN 'purchase' END AS nxt FROM l), y AS (SELECT *, CASE WHEN again AND g < 600 THEN 'duplicated' WHEN again AND nxt IS NULL THEN 'unresolved' WHEN again THEN 'relabeled' WHEN e NOT IN ('view', 'click', 'purchase') THEN 'skipped' ELSE 'unchanged' END AS sequence_action FROM x) SELECT event_id, sequence_action, CASE WHEN sequence_action = 'duplicated' THEN NULL WHEN sequence_action = 'relabeled' THEN nxt WHEN e IN ('view', 'click', 'purchase') THEN e END AS proposed_label FROM y")
def _(t):
    return v.propose_sequence(t.ev(), P, O, "event_type", "onset", ["view", "click", "purchase"], 600).select("event_id", "sequence_action", "proposed_label")


@query("v7_number_trials", f"WITH {EV}, l AS (SELECT *, event_type = 'click' AND lag(event_type) {W} IS DISTINCT FROM 'view' AS bad_start, CASE WHEN event_type = 'click' AND lag(event_type) {W} = 'view' THEN onset - lag(onset) {W} END AS w FROM ev), s AS (SELECT *, sum((event_type = 'view' OR bad_start)::INTEGER) {WU} AS sequence FROM l), g AS (SELECT user_id, sequence, coalesce(arg_min(w, onset) FILTER (w IS NOT NULL) > 20000, false) AS practice, bool_or(bad_start) AS bad FROM s WHERE sequence > 0 GROUP BY 1, 2), n AS (SELECT *, sum((NOT practice)::INTEGER) OVER (PARTITION BY user_id ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT event_id, s.sequence::BIGINT AS sequence, bad_start, practice, CASE WHEN NOT practice AND NOT bad THEN n END::BIGINT AS trial FROM s LEFT JOIN n ON n.user_id = s.user_id AND n.sequence = s.sequence")
def _(t):
    out = v.number_trials(t.ev(), P, O, "event_type", "onset", "view", "click", 20000)
    return out.select("event_id", col("sequence").cast("bigint").alias("sequence"), "bad_start", "practice", col("trial").cast("bigint").alias("trial"))


@query("v8_summarize_trials", f"WITH {SUM} SELECT user_id, trial::BIGINT AS trial, nv AS view_count, round(ov, 6) AS view_onset, nc AS click_count, round(oc, 6) AS click_onset, np AS purchase_count, round(op, 6) AS purchase_onset, issues, round(duration, 6) AS duration, issues = '' AS complete FROM ts")
def _(t):
    return rounded(summary(t))


@query("v9_expected_offsets", "SELECT o.o_orderkey, m IS NOT NULL AS physical, round(o.o_custkey / 10 + coalesce(s, 0), 6) AS real_start, round(o.o_custkey / 10 + coalesce(s, 0) + coalesce(m, o.o_totalprice), 4) AS real_end, round(o.o_custkey / 10 + o.o_totalprice, 4) AS end_trigger FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS m, min(l_tax) AS s FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def _(t):
    task = t.orders.select("o_orderkey", (col("o_custkey") / 10).alias("it"), col("o_totalprice").alias("mt"))
    traces = t.lineitem.groupBy(col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("movement_time"), F.min("l_tax").alias("start_shift"))
    out = v.expected_offsets(task, traces, ["o_orderkey"])
    return out.select("o_orderkey", "physical", F.round("real_start", 6).alias("real_start"), F.round("real_end", 4).alias("real_end"), F.round("end_trigger", 4).alias("end_trigger"))


@query("v10_offset_join_audit", f"WITH {AUD} SELECT user_id, trial, round(duration, 6) AS duration, round(expected, 6) AS expected, join_status, a AS mismatch_3000000ms, b AS mismatch_15000000ms, issues FROM aud")
def _(t):
    return rounded(audit(t))


CAND = AUD + ", nr AS (SELECT p.user_id, p.trial, e.trial AS candidate, e.trial - p.trial AS index_distance, abs(p.duration - e.expected) AS score FROM aud p JOIN ex e ON e.user_id = p.user_id AND abs(e.trial - p.trial) <= 5 WHERE p.a), rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, trial ORDER BY score NULLS LAST, abs(index_distance), candidate) AS candidate_rank, coalesce(score < min(score) FILTER (index_distance = 0) OVER (PARTITION BY user_id, trial), false) AS better_than_nominal FROM nr)"


def candidates(t):
    problems = audit(t).filter("mismatch_3000000ms").select("user_id", "trial", "duration")
    return v.candidate_audit(problems, expected(t).select("user_id", col("trial").alias("candidate"), "expected"), P, "trial", "candidate", "duration", "expected")


@query("v11_candidate_audit", f"WITH {CAND} SELECT user_id, trial, candidate, index_distance, round(score, 4) AS score, candidate_rank::INTEGER AS candidate_rank, better_than_nominal FROM rk")
def _(t):
    return rounded(candidates(t).select("user_id", "trial", "candidate", "index_distance", "score", "candidate_rank", "better_than_nominal"), 4)


@query("v12_first_mismatch", f"WITH {AUD}, m AS (SELECT *, min(CASE WHEN issues <> '' THEN trial END) OVER (PARTITION BY user_id) AS first FROM aud), g AS (SELECT user_id, max(first) AS first_problem, count(*) FILTER (issues <> '') AS n_problems, count(*) FILTER (trial > first) AS n_after, count(*) FILTER (trial > first AND issues <> '') AS n_problems_after FROM m GROUP BY 1) SELECT *, CASE WHEN n_after > 0 THEN round(n_problems_after / n_after, 6) END AS share_after FROM g")
def _(t):
    return rounded(v.first_mismatch(audit(t), P, "trial", col("issues") != ""))


@query("v13_join_metrics", f"WITH {AUD} SELECT s AS surface, n, 'before' AS label FROM (SELECT unnest(['both', 'left_only', 'right_only', 'with_issues']) AS s, unnest([count(*) FILTER (join_status = 'both'), count(*) FILTER (join_status = 'left_only'), count(*) FILTER (join_status = 'right_only'), count(*) FILTER (issues <> '')]) AS n FROM aud)")
def _(t):
    return v.join_metrics_table(audit(t), "before")


@query("v14_strict_clean", f"WITH {AUD} SELECT user_id, trial FROM aud WHERE join_status = 'both' AND issues = ''")
def _(t):
    return audit(t).filter(v.strict_clean(audit(t))).select("user_id", "trial")


@query("v15_continuity_audit", f"WITH {EV}, s AS (SELECT *, sum((event_type = 'error')::INTEGER) {WU} AS segment FROM ev) SELECT user_id, segment::BIGINT AS segment, count(*) AS n_events, round(min(onset), 6) AS first_onset, round(max(onset), 6) AS last_onset, CASE WHEN segment = 0 THEN 'before_restart' ELSE 'after_restart' END AS position FROM s WHERE event_type <> 'error' GROUP BY user_id, s.segment")
def _(t):
    return rounded(v.continuity_audit(t.ev(), P, O, "event_type", "error", "onset").withColumn("segment", col("segment").cast("bigint")))


#: Trials in files: by time, or every other trial, or all in one; numbers that go on, begin anew in each file or inside one, or leave some out.
FILES = "WITH " + AUD + """, tl AS (SELECT user_id, trial, min(onset) AS onset FROM tr WHERE trial > 0 GROUP BY 1, 2), fl AS (
  SELECT *, (CASE WHEN user_id % 5 = 0 THEN trial % 2 WHEN user_id % 7 = 0 THEN 0 ELSE floor(onset / 700000) END)::BIGINT AS file FROM tl
), nm AS (
  SELECT *, CASE WHEN user_id % 14 = 0 THEN trial % 4 WHEN user_id % 3 = 0 THEN trial - min(trial) OVER (PARTITION BY user_id, file) + 1 WHEN user_id % 4 = 1 THEN trial + file ELSE trial END AS number FROM fl
), st AS (
  SELECT *, coalesce(number < lag(number) OVER (PARTITION BY user_id, file ORDER BY onset, trial), false) AS r FROM nm
), sp AS (
  SELECT user_id, file, count(*) AS n_trials, min(onset) AS a, max(onset) AS z, min(number) AS low_number, max(number) AS high_number, count(*) FILTER (r) AS n_restarts FROM st GROUP BY 1, 2
), od AS (
  SELECT *, row_number() OVER w AS part, max(z) OVER b AS ended, max(high_number) OVER b AS reached FROM sp
  WINDOW w AS (PARTITION BY user_id ORDER BY a, file), b AS (PARTITION BY user_id ORDER BY a, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rl AS (
  SELECT *, CASE WHEN part = 1 THEN 'first' WHEN a < ended THEN 'overlapping' WHEN low_number <= reached THEN 'restarted' WHEN low_number > reached + 1 THEN 'gap' ELSE 'continues' END AS relation,
    CASE WHEN low_number > reached + 1 THEN low_number - reached - 1 ELSE 0 END AS n_missing, CASE WHEN low_number <= reached THEN least(high_number, reached) - low_number + 1 ELSE 0 END AS n_repeated FROM od
), ch AS (
  SELECT *, sum((relation IN ('first', 'overlapping', 'restarted'))::INTEGER) OVER (PARTITION BY user_id ORDER BY a, file) AS chain FROM rl
), un AS (
  SELECT user_id, count(*) AS n_files, max(chain) AS n_chains, sum(n_trials) AS n_trials, min(low_number) AS low_number, max(high_number) AS high_number, sum(n_restarts) AS n_restarts, sum(n_missing) AS n_missing, sum(n_repeated) AS n_repeated,
    CASE WHEN count(*) FILTER (relation = 'overlapping') > 0 THEN 'overlapping' WHEN count(*) FILTER (relation = 'restarted') > 0 THEN 'restarted' WHEN sum(n_restarts) > 0 THEN 'concatenated' WHEN count(*) FILTER (relation = 'gap') > 0 THEN 'split_with_gap' WHEN count(*) > 1 THEN 'split' ELSE 'single' END AS continuity FROM ch GROUP BY 1
)"""
FACTS = "count(*) AS join_rows, count(*) FILTER (join_status = 'both') AS matched_rows, count(*) FILTER (join_status = 'left_only') AS raw_only_rows, count(*) FILTER (join_status = 'right_only') AS offset_only_rows, count(*) FILTER (issues LIKE '%duplicate%') AS duplicate_rows, count(*) FILTER (issues <> '') AS issue_rows, count(*) FILTER (join_status = 'both' AND issues = '') AS strict_clean_rows"
FACT_NAMES = ("join_rows", "matched_rows", "raw_only_rows", "offset_only_rows", "duplicate_rows", "issue_rows", "strict_clean_rows")
CONTINUITY = FILES + f""", af AS (SELECT aud.*, file FROM aud LEFT JOIN fl ON fl.user_id = aud.user_id AND fl.trial = aud.trial), al AS (
  SELECT user_id, 'split_part' AS row_kind, file, {FACTS} FROM af WHERE file IS NOT NULL GROUP BY user_id, file UNION ALL SELECT user_id, 'unit_total', NULL, {FACTS} FROM af GROUP BY user_id
), ro AS (
  SELECT user_id, 'split_part' AS row_kind, file, part, relation, chain, n_trials, low_number, high_number, n_restarts, n_missing, n_repeated FROM ch
  UNION ALL SELECT user_id, 'unit_total', NULL, NULL, NULL, NULL, n_trials, low_number, high_number, n_restarts, n_missing, n_repeated FROM un
) SELECT ro.*, continuity, {", ".join(f"coalesce({x}, 0) AS {x}" for x in FACT_NAMES)},
  CASE WHEN coalesce(relation IN ('restarted', 'overlapping'), false) OR ro.n_restarts > 0 THEN 'numbers_begin_anew' WHEN duplicate_rows > 0 OR offset_only_rows > 0 OR raw_only_rows > 0 THEN 'not_resolved_on_join' WHEN ro.n_missing > 0 THEN 'numbers_missing_between_files' ELSE 'no_problem_visible' END AS observation
FROM ro JOIN un USING (user_id) LEFT JOIN al ON al.user_id = ro.user_id AND al.row_kind = ro.row_kind AND al.file IS NOT DISTINCT FROM ro.file"""
WHOLE = ("part", "chain", "low_number", "high_number", "n_trials", "n_restarts", "n_missing", "n_repeated")


def whole_numbers(df, names):
    return df.withColumns({x: col(x).cast("bigint") for x in names})


def in_files(t):
    """The observed trials with their file and number."""
    u, n = col("user_id"), col("trial")
    rows = trials(t).filter("trial > 0").groupBy("user_id", "trial").agg(F.min("onset").alias("onset"))
    file = F.when(u % 5 == 0, n % 2).when(u % 7 == 0, 0).otherwise(F.floor(col("onset") / 700000)).cast("bigint")
    first = F.min("trial").over(whole(["user_id", "file"]))
    number = F.when(u % 14 == 0, n % 4).when(u % 3 == 0, n - first + 1).when(u % 4 == 1, n + col("file")).otherwise(n)
    return rows.withColumn("file", file).withColumn("number", number)


@query("v15_file_continuity", CONTINUITY)
def _(t):
    rows = in_files(t)
    audited = audit(t).join(rows.select("user_id", "trial", "file"), ["user_id", "trial"], "left")
    return whole_numbers(ct.continuity_audit(rows, audited, P, "file", "number", "onset", ["trial"]), WHOLE)


@query("v15_unit_classes", FILES + " SELECT user_id, n_files, n_chains, n_trials, n_restarts, n_missing, n_repeated, continuity FROM un")
def _(t):
    out = ct.unit_classes(ct.file_chain(ct.file_spans(in_files(t), P, "file", "number", "onset", ["trial"]), P, "file"), P)
    return whole_numbers(out.select("user_id", "n_files", "n_chains", "n_trials", "n_restarts", "n_missing", "n_repeated", "continuity"), ("n_chains",))


@query("v16_classify_raw_only", f"WITH {CAND}, r AS (SELECT user_id, min(trial) AS lo, max(trial) AS hi FROM ex GROUP BY 1) SELECT aud.user_id, aud.trial, CASE WHEN lo IS NULL THEN 'no_expected_unit' WHEN EXISTS (SELECT 1 FROM rk WHERE rk.user_id = aud.user_id AND rk.trial = aud.trial AND better_than_nominal) THEN 'near_candidate' WHEN aud.trial < lo THEN 'before_range' WHEN aud.trial > hi THEN 'after_range' ELSE 'inside_range' END AS raw_only_class FROM aud LEFT JOIN r ON r.user_id = aud.user_id WHERE join_status = 'left_only'")
def _(t):
    return v.classify_raw_only(audit(t), expected(t), P, "trial", "trial", candidates(t)).select("user_id", "trial", "raw_only_class")


@query("v17_surface_regression", "SELECT o_orderkey, 'changed' AS change FROM orders WHERE o_orderkey % 10 = 3 AND o_custkey % 2 = 0")
def _(t):
    new = t.orders.withColumn("o_totalprice", col("o_totalprice") + F.when(col("o_orderkey") % 10 == 3, 1).otherwise(0))
    return v.surface_regression(t.orders, new, ["o_orderkey"], ["o_totalprice"], t.orders.filter("o_custkey % 2 = 1").select("o_orderkey"))


@query("v18_trial_anchors", f"WITH {TR} SELECT user_id, trial::BIGINT AS trial, round(CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN min(onset) FILTER (event_type = 'purchase') ELSE min(onset) FILTER (event_type = 'click') END, 6) AS anchor_onset, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'purchase' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'click' END AS anchor_event, count(*) FILTER (event_type = 'purchase') = 0 AND count(*) FILTER (event_type = 'click') > 0 AS anchor_fallback, count(*)::INTEGER AS n FROM tr GROUP BY 1, 2")
def _(t):
    out = v.trial_anchors(trials(t), ["user_id", "trial"], "event_type", "onset", ["purchase", "click"])
    return rounded(out.withColumn("n", F.size("provenance")).drop("provenance"))


LED = AUD + ", an AS (SELECT user_id, trial, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN min(onset) FILTER (event_type = 'purchase') ELSE min(onset) FILTER (event_type = 'click') END AS ao, count(*) FILTER (event_type = 'purchase') = 0 AND count(*) FILTER (event_type = 'click') > 0 AS af FROM tr GROUP BY 1, 2), lj AS (SELECT aud.*, ao, coalesce(af, false) AS af FROM aud LEFT JOIN an ON an.user_id = aud.user_id AND an.trial = aud.trial), led AS (SELECT *, join_status = 'both' AND ao IS NOT NULL AND coalesce(duration >= 100, false) AS primary_, CASE WHEN join_status <> 'both' THEN 'not_matched' WHEN ao IS NULL THEN 'no_anchor' WHEN NOT coalesce(duration >= 100, false) THEN 'short' ELSE 'eligible' END AS code FROM lj)"


def ledger(t):
    anchors = v.trial_anchors(trials(t), ["user_id", "trial"], "event_type", "onset", ["purchase", "click"])
    return v.eligibility_ledger(audit(t), anchors, ["user_id", "trial"], "duration", 100)


@query("v19_eligibility_ledger", f"WITH {LED} SELECT user_id, trial, primary_ AS \"primary\", primary_ AND issues = '' AND NOT af AS strict, code, CASE WHEN code = 'eligible' THEN 'include' ELSE 'exclude' END AS decision, substr(sha256('v1|' || user_id || '|' || trial), 1, 20) AS trial_key FROM led")
def _(t):
    return ledger(t).select("user_id", "trial", "primary", "strict", "code", "decision", "trial_key")


#: Two policies as data: (policy, step, decision, code, reason, terms).
GATES = [
    ("first_pass", 5, "tag", "fallback_anchor", "anchored by a second choice", [("anchor_fallback", "eq", "true")]),
    ("first_pass", 6, "tag", "with_issues", "the audit names issues", [("issues", "ne", "")]),
    ("first_pass", 10, "exclude", "split_recording", "split recordings wait for a decision", [("join_status", "eq", "both"), ("special", "eq", "split")]),
    ("first_pass", 20, "exclude", "no_anchor", "no anchor event", [("join_status", "eq", "both"), ("anchor_onset", "null", None)]),
    ("first_pass", 30, "exclude", "short", "under the least duration", [("join_status", "eq", "both"), ("duration", "lt", "100")]),
    ("first_pass", 40, "exclude", "no_duration", "no duration", [("join_status", "eq", "both"), ("duration", "null", None)]),
    ("first_pass", 50, "include", "candidate", "matched and anchored", [("join_status", "eq", "both")]),
    ("first_pass", 60, "exclude", "special_raw_only", "split or repeated recording", [("join_status", "eq", "left_only"), ("special", "in", "split;repeated")]),
    ("first_pass", 70, "exclude", "no_expected_match", "observed only", [("join_status", "eq", "left_only")]),
    ("first_pass", 80, "exclude", "no_observed_trial", "expected only", [("join_status", "eq", "right_only")]),
    ("strict", 10, "exclude", "not_matched", "no counterpart", [("join_status", "ne", "both")]),
    ("strict", 20, "exclude", "mismatch", "durations differ", [("issues", "contains", "mismatch")]),
    ("strict", 30, "exclude", "fallback_anchor", "anchored by a second choice", [("anchor_fallback", "eq", "true")]),
    ("strict", 40, "exclude", "too_short", "under the strict duration", [("duration", "lt", "2000")]),
    ("strict", 50, "include", "clean", "matched, anchored and long enough", [("anchor_onset", "not_null", None), ("duration", "ge", "2000")]),
]
POLICY_LEDGER = "WITH " + LED + """, cs AS (SELECT *, CASE WHEN user_id % 9 = 0 THEN 'split' WHEN user_id % 10 = 0 THEN 'repeated' ELSE 'regular' END AS special FROM lj), fp AS (
  SELECT *, 'first_pass' AS policy, CASE WHEN join_status = 'both' AND special = 'split' THEN 'split_recording' WHEN join_status = 'both' AND ao IS NULL THEN 'no_anchor' WHEN join_status = 'both' AND duration < 100 THEN 'short' WHEN join_status = 'both' AND duration IS NULL THEN 'no_duration' WHEN join_status = 'both' THEN 'candidate' WHEN join_status = 'left_only' AND special <> 'regular' THEN 'special_raw_only' WHEN join_status = 'left_only' THEN 'no_expected_match' ELSE 'no_observed_trial' END AS reason_code,
    concat_ws(';', CASE WHEN af THEN 'fallback_anchor' END, CASE WHEN issues <> '' THEN 'with_issues' END) AS tags FROM cs
  UNION ALL
  SELECT *, 'strict', CASE WHEN join_status <> 'both' THEN 'not_matched' WHEN issues LIKE '%mismatch%' THEN 'mismatch' WHEN af THEN 'fallback_anchor' WHEN duration < 2000 THEN 'too_short' WHEN ao IS NOT NULL AND duration >= 2000 THEN 'clean' ELSE 'no_gate' END, '' FROM cs
), dv AS (
  SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 11 = 0 THEN 2 ELSE 1 END AS post, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS pre FROM customer
), pl AS (
  SELECT fp.*, reason_code IN ('candidate', 'clean') AS eligible, coalesce(post, 0) = 1 AS post_available, CASE coalesce(post, 0) WHEN 0 THEN 'post_missing' WHEN 1 THEN 'post_available' ELSE 'post_ambiguous' END AS post_reason_code, coalesce(pre, 0) = 1 AS pre_available,
    (CASE WHEN join_status <> 'right_only' THEN 'observed' ELSE 'expected_only' END) || '|user_id=' || fp.user_id || '|trial=' || trial AS key_basis FROM fp LEFT JOIN dv ON dv.user_id = fp.user_id
), pr AS (
  SELECT *, eligible AND post_available AS ready, CASE WHEN NOT eligible THEN 'policy_' || reason_code WHEN NOT post_available THEN post_reason_code ELSE 'ready' END AS readiness_code, 'v1:' || substr(sha256(key_basis), 1, 20) AS trial_key FROM pl
)"""


def policy_ledger(t):
    rows = [(p, s, d, code, reason, *term) for p, s, d, code, reason, terms in GATES for term in terms]
    special = F.when(col("user_id") % 9 == 0, "split").when(col("user_id") % 10 == 0, "repeated").otherwise("regular")
    anchors = v.trial_anchors(trials(t), ["user_id", "trial"], "event_type", "onset", ["purchase", "click"])
    held = audit(t).join(anchors.select("user_id", "trial", "anchor_onset", "anchor_fallback"), ["user_id", "trial"], "left").withColumn("special", special)
    c = col("c_custkey")
    kinds = F.array(F.when(c % 3 != 0, "post"), F.when((c % 3 != 0) & (c % 11 == 0), "post"), F.when(c % 5 != 0, "pre"))
    derivatives = t.customer.select(c.alias("user_id"), F.explode(F.array_compact(kinds)).alias("kind"))
    return pol.policy_ledger(held, t.spark.createDataFrame(rows, pol.POLICY), derivatives, P, ["post", "pre"], "post", col("join_status") != "right_only", ["user_id", "trial"], ["user_id", "trial"])


@query("v19_policy_ledger", POLICY_LEDGER + " SELECT user_id, trial, policy, eligible, reason_code, tags, post_available, post_reason_code, pre_available, ready, readiness_code, key_basis, trial_key FROM pr")
def _(t):
    return policy_ledger(t).select("user_id", "trial", "policy", "eligible", "reason_code", "tags", "post_available", "post_reason_code", "pre_available", "ready", "readiness_code", "key_basis", "trial_key")


@query("v20_policy_reasons", POLICY_LEDGER + " SELECT policy, CASE WHEN eligible THEN 'eligible' ELSE 'ineligible' END AS status, reason_code, count(*) AS n, count(DISTINCT user_id) AS n_units, count(*) FILTER (ready) AS n_ready, round(count(*) / sum(count(*)) OVER (PARTITION BY policy), 6) AS share FROM pr GROUP BY policy, eligible, reason_code")
def _(t):
    return rounded(pol.reason_counts(policy_ledger(t), P))


@query("v20_ledger_summaries", f"WITH {LED} SELECT code, count(*) AS n, count(*) FILTER (primary_) AS n_primary, count(*) FILTER (primary_ AND issues = '' AND NOT af) AS n_strict, count(*) FILTER (issues <> '') AS n_issues FROM led GROUP BY 1")
def _(t):
    return v.ledger_summaries(ledger(t), ["code"])


@query("v21_append_events", f"WITH {EV}, b AS (SELECT user_id, onset, event_type FROM ev UNION ALL SELECT user_id, min(onset) - 1, 'real_start' FROM ev GROUP BY 1 UNION ALL SELECT user_id, max(onset) + 1, 'real_end' FROM ev GROUP BY 1) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY onset, event_type)::INTEGER AS event_order FROM b WHERE user_id IN (SELECT user_id FROM ev WHERE event_type = 'purchase')")
def _(t):
    ev = t.ev()
    offsets = ev.groupBy("user_id").agg((F.min("onset") - 1).alias("real_start"), (F.max("onset") + 1).alias("real_end"))
    return v.append_events(ev, offsets, P, "event_type", "onset", "purchase").select("user_id", "event_type", "event_order")


@query("v22_unit_manifest", "SELECT c_custkey, n, m, concat_ws(';', CASE WHEN n IS NULL THEN 'no_orders' END, CASE WHEN m IS NULL THEN 'no_events' END) AS issues FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS m FROM events GROUP BY 1) e ON user_id = c_custkey")
def _(t):
    a = t.orders.groupBy(col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    b = t.events.groupBy(col("user_id").alias("c_custkey")).agg(F.count("*").alias("m"))
    return v.unit_manifest(t.customer.select("c_custkey"), [a, b], ["c_custkey"], [(col("n").isNull(), "no_orders"), (col("m").isNull(), "no_events")])


@query("v23_cut_at_marker", f"WITH {EV}, m AS (SELECT *, min(onset) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS m FROM ev) SELECT event_id FROM m WHERE m IS NULL OR onset < m")
def _(t):
    return v.cut_at_marker(t.ev(), P, "event_type", "onset", "error").select("event_id")


@query("v24_recording_summary", "SELECT user_id, sum(n)::BIGINT AS n_events, string_agg(event_type || '=' || n, ';' ORDER BY event_type || '=' || n) AS counts, sum(n) < 60 AS few_events FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return v.recording_summary(t.events, P, "event_type", 60)


@query("v24_file_facts", "WITH e AS (SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_names, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'purchase') AS p FROM events WHERE user_id % 4 <> 0 GROUP BY 1), i AS (SELECT c_custkey AS user_id, c_mktsegment, c_nationkey, true AS k FROM customer WHERE c_custkey % 5 <> 0), j AS (SELECT coalesce(e.user_id, i.user_id) AS user_id, c_mktsegment, coalesce(n_events, 0) AS n_events, coalesce(n_names, 0) AS n_names, coalesce(k, false) AS in_inventory, v, p, c_nationkey FROM e FULL JOIN i ON i.user_id = e.user_id) SELECT user_id, c_mktsegment, n_events, n_names, in_inventory, concat_ws(';', CASE WHEN v > 0 THEN 'view=' || v END, CASE WHEN p > 0 THEN 'purchase=' || p END) AS pattern, n_events = 0 AS no_events, n_events BETWEEN 1 AND 59 AS few_events, concat_ws(';', CASE WHEN n_events = 0 THEN 'no_events' END, CASE WHEN n_events BETWEEN 1 AND 59 THEN 'few_events' END, CASE WHEN NOT in_inventory THEN 'not_in_inventory' END, CASE WHEN c_nationkey = 3 THEN 'remapped' END) AS issues FROM j")
def _(t):
    inventory = t.customer.filter("c_custkey % 5 <> 0").withColumnRenamed("c_custkey", "user_id")
    out = v.file_facts(inventory, t.events.filter("user_id % 4 <> 0"), P, "event_type", ["view", "purchase"], 60, [(col("c_nationkey") == 3, "remapped")], ["c_mktsegment", "c_nationkey"])
    return out.drop("c_nationkey")
