"""Queries of trial cleaning and shape metrics (groups C and X) on samples made from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trace as tr
from .base import EV, SM, query, rounded

col = F.col
K, O = ["trial"], ["time", "o"]
#: Samples spread over a screen, their trial's first point as origin.
SC = SM + ", s0 AS (SELECT trial, o, x * 60 AS x, y * 10 AS y, time / 1000 AS time FROM sm), og AS (SELECT trial, arg_min(x, o) AS ox, arg_min(y, o) AS oy FROM s0 GROUP BY 1), s1 AS (SELECT s0.*, ox, oy, sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)) AS od FROM s0 JOIN og USING (trial))"
W = "OVER (PARTITION BY trial ORDER BY time, o)"
WU = "OVER (PARTITION BY trial ORDER BY time, o ROWS UNBOUNDED PRECEDING)"
#: Steps that arrive, their heading, the turn against the step before, and that of the chord which leaves the next point out (degrees).
TURN = lambda e: f"degrees(CASE WHEN {e} > pi() THEN {e} - 2 * pi() WHEN {e} <= -pi() THEN {e} + 2 * pi() ELSE {e} END)"
STEPS = f"st0 AS (SELECT *, x - lag(x) {W} AS dx, y - lag(y) {W} AS dy, coalesce(time - lag(time) {W}, 0) AS gap FROM s1), st1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, atan2(dy, dx) AS h, dx + lead(dx) {W} AS dx2, dy + lead(dy) {W} AS dy2 FROM st0), st2 AS (SELECT *, h - lag(h) {W} AS t1, atan2(dy2, dx2) - lag(h) {W} AS t2 FROM st1), st AS (SELECT *, {TURN('t1')} AS a, {TURN('t2')} AS a2 FROM st2)"


def screen(t):
    return t.sm().select("trial", "o", (col("x") * 60).alias("x"), (col("y") * 10).alias("y"), (col("time") / 1000).alias("time"))


def with_origin(t):
    s = screen(t)
    origin = s.groupBy("trial").agg(F.min_by("x", "o").alias("origin_x"), F.min_by("y", "o").alias("origin_y"))
    return s.join(origin, "trial")


def figures(t):
    return t.sm().groupBy("trial").agg((F.max("x") * 70).alias("figure_size"), F.sum("x").alias("figure_length"), F.avg("y").alias("__s")).withColumn("figure_shift", col("__s") / 50).drop("__s")


@query("c1_attach_origin", f"WITH {SC}, l AS (SELECT *, x = lag(x) {W} AND y = lag(y) {W} AS again, time - first_value(time) {W} AS since FROM s1) SELECT o, round(since, 6) AS time, round(ox, 6) AS origin_x, round(oy, 6) AS origin_y FROM l WHERE again IS NOT TRUE")
def _(t):
    points = screen(t).select("trial", col("o").alias("point_index"), "x", "y")
    return rounded(tr.attach_origin(screen(t), points, K, O).select("o", "time", "origin_x", "origin_y"))


@query("c2_drop_no_shape", f"WITH {SC}, z AS (SELECT trial, greatest(max(x) - min(x), max(y) - min(y)) AS size FROM s0 GROUP BY 1), f AS (SELECT trial, max(x) * 70 AS fs FROM sm GROUP BY 1) SELECT o FROM s0 WHERE trial NOT IN (SELECT trial FROM z JOIN f USING (trial) WHERE size = 0 OR fs / size > 1.2)")
def _(t):
    return tr.drop_no_shape(screen(t), figures(t), K, 1.2).select("o")


DONE_SQL = f"WITH {SC}, a AS (SELECT *, row_number() {W} / count(*) OVER (PARTITION BY trial) AS prop, lag(od) {W} AS pod, time - lag(time) {W} AS gap, bool_or(od > 1100) OVER (PARTITION BY trial ORDER BY time, o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS far FROM s1), b AS (SELECT *, coalesce(bool_or(od < 300 AND pod >= 300 AND NOT far AND prop >= 0.5) {WU}, false) AS ret FROM a), c AS (SELECT *, bool_or(ret AND od > pod) {WU} AS missed, bool_or(gap > 60 AND prop >= 0.8 AND pod < 500) {WU} AS paused FROM b) SELECT o FROM c WHERE NOT (coalesce(missed, false) OR coalesce(paused, false))"


@query("c3_trim_after_done", DONE_SQL)
def _(t):
    p = {"origin_radius": 300, "end_radius": 1100, "pause_radius": 500, "min_prop": 0.5, "end_prop": 0.8, "min_pause": 60}
    return tr.trim_after_done(with_origin(t), K, O, [p]).select("o")


@query("c4_drop_glitches", f"WITH {SC}, {STEPS}, g0 AS (SELECT *, coalesce(d > 600 AND lead(d) {W} > 600 AND abs(lead(a) {W}) > 120, false) AS g FROM st), g1 AS (SELECT *, sum(g::INTEGER) OVER (PARTITION BY trial) AS n, coalesce(lead(g) {W}, false) AS ga, coalesce(lead(g, 2) {W}, false) AS gb, lead(a2) {W} AS na2 FROM g0), g2 AS (SELECT *, g AND (n <= 1 OR gb OR NOT (na2 IS NOT NULL AND ga) OR coalesce(abs(na2) > 90, false)) AS gl FROM g1), g3 AS (SELECT *, gl OR coalesce(lead(gl) {W} AND (x = lead(x) {W} OR y = lead(y) {W}), false) OR coalesce(lag(gl) {W} AND (x = lag(x) {W} OR y = lag(y) {W}), false) OR (d IS NULL AND coalesce(lead(d) {W} > 600, false) AND od > 600) OR (lead(d) {W} IS NULL AND coalesce(od - lag(od) {W} > 600, false)) OR (x = 239 AND y = 1079) AS bad FROM g2) SELECT trial, o FROM g3 WHERE NOT bad")
def _(t):
    return tr.drop_glitches(with_origin(t), K, O, min_dist=600, min_angle=120, min_angle_alt=90).select("trial", "o")


FALSE_START = f"WITH {SC}, a AS (SELECT *, row_number() {W} / count(*) OVER (PARTITION BY trial) AS prop, time - lag(time) {W} AS gap FROM s1), b AS (SELECT *, coalesce(gap > 30 AND prop <= 0.3 AND od < 500, false)::INTEGER AS st FROM a), c AS (SELECT *, sum(st) {WU} < sum(st) OVER (PARTITION BY trial) AS drop_ FROM b)"


@query("c5_drop_false_start", FALSE_START + " SELECT o, round(time, 6) AS time FROM c WHERE NOT drop_")
def _(t):
    return rounded(tr.drop_false_start(with_origin(t), K, O, start_radius=500, max_prop=0.3, min_pause=30).select("o", "time"))


@query("c5_false_start_shifts", FALSE_START + " SELECT trial, count(*) AS samples, count(*) FILTER (drop_) AS flagged, round(arg_min(time, (time, o)) FILTER (NOT drop_), 6) AS start_shift FROM c GROUP BY 1 HAVING count(*) FILTER (drop_) > 0")
def _(t):
    return rounded(tr.false_start_shifts(with_origin(t), K, O, start_radius=500, max_prop=0.3, min_pause=30))


@query("c6_drop_hand_noise", f"WITH {SC}, {STEPS}, n0 AS (SELECT *, coalesce(d > 120 AND abs(a) + abs(lead(a) {W}) > 90, false) AS sharp, (list_reverse_sort(list(d) FILTER (d IS NOT NULL) OVER (PARTITION BY trial)))[2] AS second, last_value(od) OVER (PARTITION BY trial ORDER BY time, o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS od_end, coalesce(od - lag(od) {W} > 100, false)::INTEGER AS away FROM st), n1 AS (SELECT *, coalesce(bool_or(sharp) OVER (PARTITION BY trial) AND a IS NOT NULL AND gap < 100 AND ((d > 120 AND abs(a) > 30) OR d > 300) AND d >= second, false)::INTEGER AS jump, od_end < 100 AS near FROM n0), n2 AS (SELECT *, sum(jump) {WU} AS jumps, sum(jump) OVER (PARTITION BY trial) AS all_, sum(away) {WU} AS aways, sum(away) OVER (PARTITION BY trial) AS total FROM n1), n3 AS (SELECT *, (jumps % 2 = 1 AND all_ % 2 = 0) OR (NOT near AND aways = greatest(1, total)) AS noise FROM n2), n4 AS (SELECT *, greatest(max(x) FILTER (noise) OVER (PARTITION BY trial) - min(x) FILTER (noise) OVER (PARTITION BY trial), max(y) FILTER (noise) OVER (PARTITION BY trial) - min(y) FILTER (noise) OVER (PARTITION BY trial)) AS box FROM n3) SELECT trial, o FROM n4 WHERE NOT (noise AND box <= 900)")
def _(t):
    return tr.drop_hand_noise(with_origin(t), K, O, max_gap=100, max_size=900).select("trial", "o")


@query("c7_drop_incomplete", f"WITH {SC}, {STEPS}, z AS (SELECT trial, greatest(max(x) - min(x), max(y) - min(y)) AS size, ((min(x) - 2000) / nullif(max(x) - min(x), 0) + 0.5) * 2 AS shift, coalesce(sum(d), 0) AS len, abs(arg_max(od, (time, o)) - arg_min(od, (time, o))) AS gap FROM st GROUP BY 1), f AS (SELECT trial, max(x) * 70 AS fs, sum(x) AS fl, avg(y) / 50 AS fsh FROM sm GROUP BY 1), b AS (SELECT trial FROM z LEFT JOIN f USING (trial) WHERE coalesce(fs / nullif(size, 0) > 1.3, false) OR coalesce(gap > 1500, false) OR coalesce(fl / nullif(len, 0) > 0.012 AND abs(shift) - abs(fsh) > 0.3, false)) SELECT o FROM s1 WHERE trial NOT IN (SELECT trial FROM b)")
def _(t):
    return tr.drop_incomplete(with_origin(t), figures(t), K, O, max_end_gap=1500, max_size_ratio=1.3, max_length_ratio=0.012, max_shift=0.3, middle=2000.0).select("o")


GAP_SQL = f"WITH {SC}, {STEPS}, f0 AS (SELECT *, abs(a) + abs(lead(a) {W}) AS turns FROM st), f1 AS (SELECT *, gap > 4e5 OR coalesce(gap > 150 AND (d > 2500 OR (d > 1500 AND turns > 90) OR (d > 1300 AND turns > 200)), false) AS gap_ FROM f0)"
LEVELS = ((2500, None), (1500, 90), (1300, 200))


@query("c8_drop_large_gaps", GAP_SQL + " SELECT trial, o FROM (SELECT *, bool_or(gap_) OVER (PARTITION BY trial) AS any_ FROM f1) WHERE NOT any_")
def _(t):
    return tr.drop_large_gaps(screen(t), K, O, pause=4e5, min_gap=150, levels=LEVELS).select("trial", "o")


@query("c8_gap_flags", GAP_SQL + " SELECT trial, o, gap_ AS gap FROM f1")
def _(t):
    return tr.with_gap_flags(screen(t), K, O, pause=4e5, min_gap=150, levels=LEVELS).select("trial", "o", "gap")


@query("c9_flag_edges", f"WITH {SC} SELECT trial, bool_or(x <= 0 OR x >= 1919 OR y <= 0 OR y >= 979) AS edge_hit FROM s0 GROUP BY 1")
def _(t):
    return tr.flag_edges(screen(t), K, 1920, 980)


FLAGS = f"WITH {SC}, e AS (SELECT o FROM s0 WHERE x < 1500), f AS (SELECT o FROM s0 WHERE x < 1500 AND y < 800), g AS (SELECT s0.trial, s0.o, s0.o NOT IN (SELECT o FROM e) AS wide, s0.o IN (SELECT o FROM e) AND s0.o NOT IN (SELECT o FROM f) AS tall FROM s0)"


def flags(t):
    s = screen(t)
    a = s.filter("x < 1500")
    return tr.flag_table(s.select("trial", "o"), ["o"], {"wide": a, "tall": a.filter("y < 800")})


@query("c10_flag_table", FLAGS + " SELECT trial, o, wide, tall, CASE WHEN wide THEN 'wide' WHEN tall THEN 'tall' END AS removed_by FROM g")
def _(t):
    return flags(t).select("trial", "o", "wide", "tall", "removed_by")


@query("c11_filter_summary", FLAGS + " SELECT trial, count(*) AS n_samples, count(*) FILTER (wide) AS n_wide, count(*) FILTER (tall) AS n_tall, count(*) FILTER (NOT wide AND NOT tall) AS n_left FROM g GROUP BY 1")
def _(t):
    return tr.filter_summary(flags(t), K, ["wide", "tall"])


LONG_AUDIT = FLAGS + """, a AS (SELECT trial, count(*) AS n, count(*) FILTER (wide) AS w, count(*) FILTER (tall AND NOT wide) AS t FROM g GROUP BY 1), l AS (
  SELECT trial, 'wide' AS stage, 1 AS stage_order, n AS n_before, w AS n_removed, n - w AS n_after FROM a UNION ALL SELECT trial, 'tall', 2, n - w, t, n - w - t FROM a
)"""


@query("c11_filter_audit", LONG_AUDIT + " SELECT *, round(CASE WHEN n_before <> 0 THEN n_removed / n_before END, 6) AS share_removed, n_removed > 0 AND n_after = 0 AS trial_removed FROM l")
def _(t):
    return rounded(tr.filter_audit(flags(t), K, ["wide", "tall"]))


@query("c11_stage_totals", LONG_AUDIT + " SELECT stage, stage_order, count(*) FILTER (n_removed > 0) AS n_trials_touched, count(*) FILTER (n_removed > 0 AND n_after = 0) AS n_trials_removed, sum(n_removed)::BIGINT AS n_removed, sum(n_after)::BIGINT AS n_after FROM l GROUP BY 1, 2")
def _(t):
    return tr.stage_totals(tr.filter_audit(flags(t), K, ["wide", "tall"]))


@query("c12_trace_summary", f"WITH {SC}, l AS (SELECT *, x - lag(x) {W} AS dx, y - lag(y) {W} AS dy FROM s0), z AS (SELECT trial, max(time) - min(time) AS m, sum(sqrt(dx * dx + dy * dy)) AS p FROM l GROUP BY 1) SELECT trial, round(m, 4) AS movement_time, round(p, 3) AS path_length, CASE WHEN m <> 0 THEN round(p / m, 4) END AS speed FROM z")
def _(t):
    out = tr.trace_summary(screen(t), K, O)
    return out.select("trial", F.round("movement_time", 4).alias("movement_time"), F.round("path_length", 3).alias("path_length"), F.round("speed", 4).alias("speed"))


def segments(t):
    return t.ev().select(col("user_id").alias("trial"), col("event_id").alias("segment_index"), col("value").alias("start_x"), col("k").cast("double").alias("start_y"), (col("value") + 50).alias("end_x"), (col("k") * 2.0).alias("end_y"), (col("value") * 3).alias("ctrl_x"), F.lit(75.0).alias("ctrl_y"))


@query("x1_figure_summary", f"WITH {EV}, i AS (SELECT user_id AS trial, value AS sx, k AS sy, value + 50 AS ex, k * 2.0 AS ey, value * 3 AS cx, 75.0 AS cy, unnest(range(2001)) AS n FROM ev), d AS (SELECT trial, n, sx, sy, ex, ey, sqrt(pow(2 * (1 - n / 2000.0) * (cx - sx) + 2 * n / 2000.0 * (ex - cx), 2) + pow(2 * (1 - n / 2000.0) * (cy - sy) + 2 * n / 2000.0 * (ey - cy), 2)) AS v FROM i) SELECT trial, round(sum(v * CASE WHEN n IN (0, 2000) THEN 1 WHEN n % 2 = 1 THEN 4 ELSE 2 END) / 6000 , 1) AS curve_length, round(sum(CASE WHEN n = 0 THEN sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) END), 4) AS chord_length FROM d GROUP BY 1")
def _(t):
    return tr.figure_summary(segments(t), K).select("trial", F.round("curve_length", 1).alias("curve_length"), F.round("chord_length", 4).alias("chord_length"))


@query("x2_turning_summary", f"WITH {EV}, i AS (SELECT user_id AS trial, event_id AS seg, value AS sx, k::DOUBLE AS sy, value + 50 AS ex, k * 2.0 AS ey, value * 3 AS cx, 75.0 AS cy, unnest(range(20)) AS n FROM ev), p AS (SELECT trial, seg, n, cx + (sx - cx) * pow(1 - n / 20.0, 2) + (ex - cx) * pow(n / 20.0, 2) AS x, cy + (sy - cy) * pow(1 - n / 20.0, 2) + (ey - cy) * pow(n / 20.0, 2) AS y FROM i), d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY trial ORDER BY seg, n)), h AS (SELECT trial, atan2(dy, dx) - lag(atan2(dy, dx)) OVER (PARTITION BY trial ORDER BY seg, n) AS t FROM d), a AS (SELECT trial, abs(CASE WHEN abs(t) > pi() THEN t - 2 * pi() * sign(t) ELSE t END) AS t FROM h) SELECT trial, round(sum(t), 4) AS turn_sum, round(avg(t), 4) AS turn_mean, round(stddev_samp(t), 4) AS turn_sd FROM a GROUP BY 1")
def _(t):
    return rounded(tr.turning_summary(segments(t), K, 20), 4)


@query("x3_total_abs_curvature", f"WITH {EV}, i AS (SELECT user_id AS trial, value AS sx, k::DOUBLE AS sy, value + 50 AS ex, k * 2.0 AS ey, value * 3 AS cx, 75.0 AS cy, unnest(range(61)) AS n FROM ev), d AS (SELECT *, 2 * (1 - n / 60.0) * (cx - sx) + 2 * n / 60.0 * (ex - cx) AS dx, 2 * (1 - n / 60.0) * (cy - sy) + 2 * n / 60.0 * (ey - cy) AS dy, 2 * (ex - 2 * cx + sx) AS ddx, 2 * (ey - 2 * cy + sy) AS ddy FROM i) SELECT trial, round(sum(CASE WHEN n IN (0, 60) THEN 1 WHEN n % 2 = 1 THEN 4 ELSE 2 END * abs(dx * ddy - dy * ddx) / pow(dx * dx + dy * dy, 1.5)) / 180, 3) AS total_abs_curvature FROM d GROUP BY 1")
def _(t):
    return rounded(tr.total_abs_curvature(segments(t), K), 3)


#: Matches of templates by comparing all pairs of a trial: with itself, of 2 and 3 values; then those of sample entropy.
ENTROPY = f"""WITH {SM}, s AS (
  SELECT trial, x, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY trial) AS n,
    0.2 * stddev_samp(x) OVER (PARTITION BY trial) AS tol
  FROM sm WHERE x IS NOT NULL WINDOW w AS (PARTITION BY trial ORDER BY o)
), p AS (
  SELECT a.trial, a.i, a.n, a.i <= a.n - 3 AND b.i <= a.n - 3 AS goes_on, abs(a.x2 - b.x2) <= a.tol AS third
  FROM s a JOIN s b ON a.trial = b.trial AND abs(a.x - b.x) <= a.tol AND abs(a.x1 - b.x1) <= a.tol WHERE a.i <= a.n - 2 AND b.i <= b.n - 2
), c AS (
  SELECT trial, i, any_value(n) AS n, count(*) AS short, count(*) FILTER (goes_on AND third) AS long, count(*) FILTER (goes_on) AS b FROM p GROUP BY 1, 2
), e AS (
  SELECT trial, any_value(n) AS n, avg(ln(short / (n - 1))) AS phi2, avg(ln(long / (n - 2))) FILTER (i <= n - 3) AS phi3, sum(b) - any_value(n - 2) AS b, sum(long) - any_value(n - 2) AS a FROM c GROUP BY 1
) SELECT t.trial, round(CASE WHEN n >= 4 THEN phi2 - phi3 END, 6) AS approximate_entropy, round(CASE WHEN n >= 4 AND a > 0 AND b > 0 THEN -ln(a / b) END, 6) AS sample_entropy FROM (SELECT DISTINCT trial FROM sm) t LEFT JOIN e USING (trial)"""


@query("x4_series_entropy", ENTROPY)
def _(t):
    return rounded(tr.series_entropy(t.sm(), K, "o", "x", 2, 0.2).select("trial", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("approximate_entropy", "sample_entropy")]), 6)


def interpolated_sql(source: str, grid: str) -> str:
    """``source`` (trial, ax, ...) with one row per place, interpolated at ``grid`` (trial, i, g): x, y and time."""
    mean = f"SELECT trial, ax, avg(x) AS x, avg(y) AS y, avg(time) AS time, lead(ax) OVER w AS ax2, lead(avg(x)) OVER w AS x2, lead(avg(y)) OVER w AS y2, lead(avg(time)) OVER w AS time2 FROM {source} GROUP BY trial, ax WINDOW w AS (PARTITION BY trial ORDER BY ax)"
    part = lambda v: f"round(CASE WHEN ax2 IS NULL THEN {v} ELSE {v} + (g - ax) / (ax2 - ax) * ({v}2 - {v}) END, 4) AS {v}"
    return f"SELECT g.trial, i, {part('x')}, {part('y')}, {part('time')} FROM {grid} g ASOF JOIN ({mean}) m ON g.trial = m.trial AND g.g >= m.ax"


@query("x5_reinterpolate", f"WITH {SM}, d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM sm WINDOW w AS (PARTITION BY trial ORDER BY o)), p AS (SELECT *, sum(coalesce(sqrt(dx * dx + dy * dy), 0)) OVER (PARTITION BY trial ORDER BY o ROWS UNBOUNDED PRECEDING) AS ax FROM d), g AS (SELECT trial, i, max(ax) * i / 39 AS g FROM p, range(40) r(i) GROUP BY trial, i), r AS ({interpolated_sql('p', 'g')}) SELECT trial, i AS point_index, x, y, time FROM r")
def _(t):
    return rounded(tr.reinterpolate(t.sm(), K, "o", 40, equidistant=True), 4)


def pairs(t):
    sm = t.sm()
    return tr.match_lengths(sm.filter("o % 2 = 0"), sm.filter("o % 2 = 1"), K, "o")


@query("x6_match_lengths", f"WITH {SM}, a AS (SELECT *, time AS ax FROM sm WHERE o % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY trial) AS n FROM sm WHERE o % 2 = 1), e AS (SELECT trial, min(ax) AS lo, max(ax) AS hi FROM a GROUP BY 1), g AS (SELECT b.trial, i, CASE WHEN n = 1 THEN lo ELSE lo + (hi - lo) * i / (n - 1) END AS g FROM b JOIN e ON e.trial = b.trial), r AS ({interpolated_sql('a', 'g')}) SELECT b.trial, b.i AS point_index, round(b.x, 4) AS x, round(b.y, 4) AS y, r.x AS fx, r.y AS fy FROM b JOIN r ON r.trial = b.trial AND r.i = b.i")
def _(t):
    return rounded(pairs(t), 4)


MATCHED = f"WITH {SM}, m AS (SELECT trial, x, y, x * 0.5 - y AS fx, y + 3 AS fy FROM sm)"


def matched(t):
    return t.sm().select("trial", "x", "y", (col("x") * 0.5 - col("y")).alias("fx"), (col("y") + 3).alias("fy"))


@query("x7_point_error", MATCHED + ", e AS (SELECT trial, sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)) AS e FROM m) SELECT trial, round(sum(e), 4) AS error_total, round(avg(e), 6) AS error_mean, round(stddev_samp(e), 6) AS error_sd, round(sqrt(sum(e * e) / (count(*) - 1)), 6) AS error_paired_sd FROM e GROUP BY 1")
def _(t):
    out = tr.point_error(matched(t), K)
    return out.select("trial", F.round("error_total", 4).alias("error_total"), *[F.round(x, 6).alias(x) for x in ("error_mean", "error_sd", "error_paired_sd")])


FIT = MATCHED + ", g0 AS (SELECT trial, avg(x) AS mx, avg(y) AS my, avg(fx) AS mfx, avg(fy) AS mfy, covar_pop(x, fx) * count(*) AS a, covar_pop(x, fy) * count(*) AS b, covar_pop(y, fx) * count(*) AS c, covar_pop(y, fy) * count(*) AS d, (var_pop(x) + var_pop(y)) * count(*) AS own, sqrt(pow(avg(x) - avg(fx), 2) + pow(avg(y) - avg(fy), 2)) AS tr FROM m GROUP BY 1), g1 AS (SELECT *, a * d - b * c < 0 AS reflected, CASE WHEN a * d - b * c < 0 THEN a - d ELSE a + d END AS p, CASE WHEN a * d - b * c < 0 THEN b + c ELSE b - c END AS q FROM g0), g AS (SELECT *, sqrt(p * p + q * q) AS h, sqrt(p * p + q * q) / own AS scale FROM g1)"


@query("x8_procrustes", FIT + " SELECT trial, round(tr, 4) AS translation, round(scale, 4) AS scale, round(acos(least(1, greatest(-1, p / h))), 4) AS rotation, reflected FROM g")
def _(t):
    return rounded(tr.procrustes(matched(t), K).select("trial", "translation", "scale", "rotation", "reflected"), 4)


#: The distances of fitted points, and their figures.
SHAPE = ", e AS (SELECT m.trial, sqrt(pow(scale * ((x - mx) * p / h + (y - my) * CASE WHEN reflected THEN q / h ELSE -q / h END) + mfx - fx, 2) + pow(scale * ((x - mx) * q / h + (y - my) * CASE WHEN reflected THEN -p / h ELSE p / h END) + mfy - fy, 2)) AS e FROM m JOIN g USING (trial)) SELECT trial, round(sum(e), 3) AS shape_error_total, round(avg(e), 4) AS shape_error_mean, round(stddev_samp(e), 4) AS shape_error_sd, round(sqrt(sum(e * e) / (count(*) - 1)), 4) AS shape_error_paired_sd FROM e GROUP BY 1"


def shape_figures(out):
    return out.select("trial", F.round("shape_error_total", 3).alias("shape_error_total"), *[F.round(x, 4).alias(x) for x in ("shape_error_mean", "shape_error_sd", "shape_error_paired_sd")])


@query("x8_procrustes_error", FIT + SHAPE)
def _(t):
    return shape_figures(tr.procrustes_error(matched(t), K))


#: The warping by a recursion over rows of costs, and back from the last point by the cheapest step; pairs as ``m``.
WARPED = f"""WITH RECURSIVE {SM}, f AS (
  SELECT trial, list(x ORDER BY o) AS fx, list(y ORDER BY o) AS fy, len(fx) AS m FROM sm WHERE o % 2 = 0 GROUP BY trial
), q AS (
  SELECT trial, x, y, row_number() OVER (PARTITION BY trial ORDER BY o) AS i, count(*) OVER (PARTITION BY trial) AS n FROM sm WHERE o % 2 = 1
), r AS (SELECT * FROM q JOIN f USING (trial) WHERE m < 2 * n), costs(trial, i, n, m, cost) AS (
  SELECT trial, i, n, m, list_transform(range(1, m + 1), lambda j: CASE WHEN j = 1 THEN sqrt(pow(x - fx[1], 2) + pow(y - fy[1], 2)) ELSE 'infinity'::DOUBLE END) FROM r WHERE i = 1
  UNION ALL
  SELECT r.trial, r.i, r.n, r.m, list_transform(range(1, r.m + 1), lambda j: least(cost[j], CASE WHEN j > 1 THEN cost[j - 1] END, CASE WHEN j > 2 THEN cost[j - 2] END) + sqrt(pow(x - fx[j], 2) + pow(y - fy[j], 2)))
  FROM costs c JOIN r ON r.trial = c.trial AND r.i = c.i + 1
), way(trial, i, j) AS (
  SELECT trial, i, m FROM costs WHERE i = n
  UNION ALL
  SELECT w.trial, c.i, CASE WHEN cost[j] <= least(CASE WHEN j > 1 THEN cost[j - 1] END, CASE WHEN j > 2 THEN cost[j - 2] END, 'infinity'::DOUBLE) THEN j WHEN cost[j - 1] <= coalesce(CASE WHEN j > 2 THEN cost[j - 2] END, 'infinity'::DOUBLE) THEN j - 1 ELSE j - 2 END
  FROM way w JOIN costs c ON c.trial = w.trial AND c.i = w.i - 1
), m AS (SELECT trial, x, y, fx[j] AS fx, fy[j] AS fy FROM way JOIN r USING (trial, i))"""


def warped(t):
    sm = t.sm()
    return tr.dtw_align(sm.filter("o % 2 = 0"), sm.filter("o % 2 = 1"), K, "o")


@query("x9_dtw_align", WARPED + ", e AS (SELECT trial, sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)) AS e FROM m) SELECT trial, round(sum(e), 4) AS error_total, round(avg(e), 5) AS error_mean, round(stddev_samp(e), 5) AS error_sd, round(sqrt(sum(e * e) / (count(*) - 1)), 5) AS error_paired_sd FROM e GROUP BY 1")
def _(t):
    return rounded(tr.point_error(warped(t), K).withColumn("error_total", F.round("error_total", 4)), 5)


@query("x9_dtw_shape", FIT.replace(MATCHED, WARPED) + SHAPE)
def _(t):
    return shape_figures(tr.procrustes_error(warped(t), K))


@query("x9_dtw_status", f"WITH {SM}, f AS (SELECT trial, count(*) AS figure_points FROM sm WHERE o % 3 <> 0 GROUP BY 1), t AS (SELECT trial, count(*) AS trace_points FROM sm WHERE o % 3 = 0 GROUP BY 1) SELECT trial, figure_points, trace_points, CASE WHEN figure_points IS NULL THEN 'no figure' WHEN trace_points IS NULL THEN 'no trace' WHEN figure_points >= 2 * trace_points THEN 'figure too long' ELSE 'aligned' END AS status FROM f FULL JOIN t USING (trial)")
def _(t):
    sm = t.sm()
    return tr.dtw_status(sm.filter("o % 3 <> 0"), sm.filter("o % 3 = 0"), K)


@query("x10_join_metrics", "SELECT c_custkey, n, m FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) a ON a.user_id = c_custkey LEFT JOIN (SELECT user_id, max(value) AS m FROM events GROUP BY 1) b ON b.user_id = c_custkey")
def _(t):
    g = t.events.groupBy("user_id")
    return tr.join_metrics(t.customer.select("c_custkey"), [g.agg(F.count("*").alias("n")), g.agg(F.max("value").alias("m"))], {"c_custkey": "user_id"})


ODDS = "0.5 + (-ln(8.0) - (value - 15) * (value - 15) / 128) - (-ln(2.0) - (value - 3) * (value - 3) / 8)"


@query("x11_outlier_labels", f"WITH l AS (SELECT event_id, event_type, value, {ODDS} AS odds, abs((value - 3) / 2) > 1.96 AS tail FROM events), g AS (SELECT *, odds > 0 AS outlier, NOT odds > 0 AND NOT tail AS good FROM l), r AS (SELECT *, CASE WHEN outlier THEN 'outlier' WHEN tail THEN 'tail' ELSE 'good' END AS label, min(value) FILTER (good) OVER (PARTITION BY event_type) AS lo, max(value) FILTER (good) OVER (PARTITION BY event_type) AS hi FROM g) SELECT event_id, round(odds, 6) AS log_odds, outlier, tail, good, label, CASE WHEN label <> 'good' THEN lo END AS good_low, CASE WHEN label <> 'good' THEN hi END AS good_high FROM r UNION ALL SELECT event_id, round(odds, 6), outlier, tail, good, 'all', NULL, NULL FROM r")
def _(t):
    p = {"mean": 3, "sd": 2.0, "outlier_mean": 15, "outlier_sd": 8.0, "logit": 0.5}
    return rounded(tr.outlier_labels(t.events, "value", ["event_type"], p, 1.96, with_all=True).select("event_id", "log_odds", "outlier", "tail", "good", "label", "good_low", "good_high"))


@query("x12_behaviour_table", f"WITH {EV}, f AS (SELECT event_id, user_id, event_type, value, coalesce(CASE WHEN event_type = 'view' THEN k END, max(CASE WHEN event_type = 'view' THEN k END) OVER (PARTITION BY user_id)) AS k FROM ev WHERE user_id >= 5), g AS (SELECT * FROM f WHERE event_type <> 'error') SELECT event_id, k, round((value - (SELECT avg(value) FROM g)) / (SELECT stddev_samp(value) FROM g), 6) AS value_z FROM g")
def _(t):
    ev = t.ev().withColumn("k", F.when(col("event_type") == "view", col("k")))
    out = tr.behaviour_table(ev, ev.filter("event_type = 'error'").select("event_id"), ["event_id"], ["user_id"], ["value"], ["k"], col("user_id") < 5)
    return rounded(out.select("event_id", "k", "value_z"))


@query("x12_analysis_table", f"WITH {EV}, f AS (SELECT *, CASE WHEN event_type = 'click' THEN coalesce(CASE WHEN k % 3 = 0 THEN k END, max(CASE WHEN k % 3 = 0 THEN k END) OVER (PARTITION BY user_id)) END AS vivid FROM ev WHERE user_id >= 5 AND event_type IN ('view', 'click')), g AS (SELECT event_id, event_type, vivid, CASE event_type WHEN 'view' THEN 'physical' WHEN 'click' THEN 'imagery' END AS condition, CASE WHEN k % 2 = 0 THEN k / 2.0 ELSE onset END AS mt, value AS complexity, CASE WHEN k <> 0 THEN value / k END AS skill FROM f WHERE NOT (event_type = 'click' AND event_id % 7 = 0) AND NOT (event_type = 'view' AND k % 5 = 0)) SELECT event_id, condition, vivid, round(mt, 5) AS mt, complexity, round((complexity - avg(complexity) OVER ()) / stddev_samp(complexity) OVER (), 6) AS complexity_z, round((skill - avg(skill) OVER ()) / stddev_samp(skill) OVER (), 6) AS skill_z FROM g")
def _(t):
    k = col("k")
    ev = t.ev().filter("event_type in ('view', 'click')").withColumns({"vivid": F.when(k % 3 == 0, k), "clip": F.when(k % 2 == 0, k / 2.0), "own": F.when(k % 5 != 0, k), "condition": col("event_type"), "mt": col("onset")})
    out = tr.analysis_table(
        ev, ["event_id"], "event_type", {"click": ev.filter("event_id % 7 = 0").select("event_id")}, {"view": "own"}, {"vivid": (["user_id"], "click")},
        {"condition": {"view": "physical", "click": "imagery"}}, {"complexity": "value"}, {"mt": "clip"}, "value", "k", ["complexity", "skill"], col("user_id") < 5,
    )
    return rounded(out.select("event_id", "condition", "vivid", F.round("mt", 5).alias("mt"), "complexity", "complexity_z", "skill_z"))
