"""Values that stand on a border of a rule, where the last bit of a float would decide."""

import math
import random

import pytest

from epochlake.operators import signal as g
from epochlake.operators import trace
from epochlake.operators import windows as w


def queue(spark):
    rows = [(i, 1, i // 2, float(i), 0.0) for i in range(1, 21)]
    t = spark.createDataFrame(rows, "vec_id int, label int, file int, peak double, ptp double")
    return g.candidate_queue(t, "label", ["ptp"], [], 0.9, (t.vec_id > 0, "peak"))


def test_low_rank_of_just_one_tenth_is_extreme(spark):
    got = {r["vec_id"]: r["reasons"] for r in queue(spark).collect() if r["reasons"]}
    assert got == {1: "extreme_low_scale", 2: "extreme_low_scale", 18: "extreme_high_scale", 19: "extreme_high_scale", 20: "extreme_high_scale"}


def test_summary_counts_low_rank_of_just_one_tenth(spark):
    got = {r["file"]: (r["n_channels"], r["n_candidates"], r["top_reason"]) for r in g.queue_summary(queue(spark), ["file"], "label", [1]).collect()}
    assert got[1] == (2, 1, "extreme_low_scale") and got[0] == (1, 1, "extreme_low_scale") and got[2] == (2, 0, None)


@pytest.mark.parametrize("skip", [0, 1])
def test_steps_straight_back_turn_as_in_c(spark, skip):
    draw = random.Random(1)
    rows, want = [], {}
    for trial in range(3000):
        dx, dy, x = draw.randint(1, 99) / 100, draw.randint(1, 60) * 1.0, [round(draw.uniform(0, 300), 2)]
        y = [float(draw.randint(0, 99))]
        for m in (1, *([0] * skip), -2):
            x, y = [*x, round(x[-1] + m * dx, 2)], [*y, y[-1] + m * dy]
        rows += [(trial, i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))]
        chord = lambda v: v[2] - v[1] if not skip else (v[2] - v[1]) + (v[3] - v[2])
        a = math.atan2(chord(y), chord(x)) - math.atan2(y[1] - y[0], x[1] - x[0])
        want[trial] = a - 2 * math.pi if a > math.pi else a + 2 * math.pi if a <= -math.pi else a
    t = spark.createDataFrame(rows, "trial int, o int, x double, y double")
    got = {r["trial"]: r["turn"] for r in t.select("trial", "o", w.turn_angle(["trial"], ["o"], skip=skip).alias("turn")).filter("o = 1").collect()}
    assert got == want and {round(v, 6) for v in want.values()} == {-3.141593, 3.141593}


def test_chord_over_a_missing_sample_is_missing(spark):
    t = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, None, 0.0), (3, 2.0, 1.0)], "o int, x double, y double").withColumn("trial", w.F.lit(1))
    assert [r["turn"] for r in t.select("o", w.turn_angle(["trial"], ["o"], skip=1).alias("turn")).orderBy("o").collect()] == [None] * 4


def test_curvature_of_a_segment_that_stands_still_is_no_number(spark):
    # The second turns back at t = 0.5 on its own line, a point of the grid; the third is one point.
    rows = [(1, 0.0, 0.0, 4.0, 0.0, 2.0, 3.0), (2, 0.0, 0.0, 0.0, 0.0, 2.0, 3.0), (3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (4, None, 0.0, 4.0, 0.0, 2.0, 3.0)]
    t = spark.createDataFrame(rows, "k int, start_x double, start_y double, end_x double, end_y double, ctrl_x double, ctrl_y double")
    got = {r["k"]: r["total_abs_curvature"] for r in trace.total_abs_curvature(t, ["k"]).collect()}
    assert math.isfinite(got[1]) and math.isnan(got[2]) and math.isnan(got[3]) and got[4] is None
