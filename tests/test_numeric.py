"""Numeric jobs against closed forms, sources against files they wrote, checks against tables that break them."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.functions import columns as c
from epochlake.operators import checks, kernels, models, shape, signal, trace, windows
from epochlake.operators.aggs import t_quantile
from epochlake.operators.fingerprint import table_fingerprint
from epochlake.sources import io

FS = 256.0
T = np.arange(1024) / FS


def wave(f):
    return np.sin(2 * np.pi * f * T)


def frame(spark, **signals):
    return spark.createDataFrame([(n, [float(x) for x in v]) for n, v in signals.items()], "ch string, samples array<double>")


# ---- signals


def test_welch_finds_the_line(spark):
    df = frame(spark, line=wave(60) + 0.01 * wave(20), slow=wave(5))
    got = {r["ch"]: r for r in signal.welch_psd(df, ["ch"], FS, 256, {"low": (1, 10), "high": (50, 70)}).collect()}
    assert got["line"]["line_ratio"] > 100 and got["slow"]["low_high_ratio"] > 1000
    f, p = kernels.welch(wave(32), FS, 256)
    assert f[p.argmax()] == 32 and p.sum() * (f[1] - f[0]) == pytest.approx(0.5, rel=0.01)


def test_filters_pass_and_stop(spark):
    df = frame(spark, both=wave(5) + wave(60))
    low = np.array(signal.fir_bandpass(df, ["ch"], None, 20, FS, 101).first()["samples"])
    assert np.abs(low - wave(5))[100:-100].max() < 0.02
    band = np.array(signal.fir_bandpass(df, ["ch"], 40, 80, FS, 101).first()["samples"])
    assert np.abs(band - wave(60))[100:-100].max() < 0.05
    notched = np.array(signal.notch(df, ["ch"], 60, FS).first()["samples"])
    assert np.abs(notched - wave(5))[250:-250].max() < 0.05
    smooth = np.array(signal.rectify_smooth(frame(spark, s=wave(60)), ["ch"], 5, FS, 201).first()["samples"])
    assert np.allclose(smooth[200:-200], 2 / np.pi, atol=0.02)


def test_resample_and_wavelets(spark):
    df = frame(spark, s=wave(5))
    down = np.array(signal.resample(df, ["ch"], 256, 64).first()["samples"])
    assert np.abs(down - wave(5)[::4])[20:-20].max() < 0.01
    power = {r["frequency"]: np.nanmean([np.nan if x is None else x for x in r["power"]]) for r in signal.morlet_power(df, ["ch"], [5, 10, 20], FS).collect()}
    assert power[5.0] > 50 * power[10.0] > 0 and power[5.0] > 50 * power[20.0]


def test_channel_metrics_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=500)
    v[95:130], v[300:303] = v[95], 9.0
    out = []
    for size in (500, 64, 7):
        rows = [("a", k, [float(x) for x in v[s : s + size]]) for k, s in enumerate(range(0, 500, size))]
        out.append(signal.channel_metrics(spark.createDataFrame(rows, "ch string, chunk int, samples array<double>"), ["ch"], clip=8.0).first())
    for r in out:
        assert r["variance"] == pytest.approx(v.var()) and r["max_step"] == pytest.approx(np.abs(np.diff(v)).max())
        assert (r["n"], r["flat_run"], r["clip_run"]) == (500, 35, 3)


def test_channel_metrics_skip_what_is_not_finite(spark):
    rows = [("a", 0, [float("nan"), 1.0, 3.0]), ("a", 1, [float("nan")]), ("a", 2, [2.0, float("inf")]), ("b", 0, [float("nan")]), ("c", 0, [])]
    got = {r["ch"]: r for r in signal.channel_metrics(spark.createDataFrame(rows, "ch string, chunk int, samples array<double>"), ["ch"]).collect()}
    assert (got["a"]["n"], got["a"]["n_finite"], got["a"]["mean"], got["a"]["ptp"]) == (6, 3, 2.0, 2.0)
    assert (got["b"]["n"], got["b"]["n_finite"], got["c"]["n"]) == (1, 0, 0)


# ---- shapes


def path(spark, rows):
    return spark.createDataFrame([(1, i, float(x), float(y), float(i)) for i, (x, y) in enumerate(rows)], "k int, o int, x double, y double, time double")


def test_dtw_of_equal_curves_is_zero(spark):
    p = path(spark, [(np.cos(a), np.sin(a)) for a in np.linspace(0, 3, 30)])
    assert trace.point_error(trace.dtw_align(p, p, ["k"], "o"), ["k"]).first()["error_total"] == 0
    assert trace.dtw_align(p, p.filter("o < 15"), ["k"], "o").count() == 0
    got = trace.dtw_align(p, path(spark, [(x, y) for x, y in ((np.cos(a), np.sin(a)) for a in np.linspace(0, 3, 45))]), ["k"], "o").orderBy("point_index").collect()
    assert len(got) == 45 and (got[0]["fx"], got[-1]["fx"]) == (1.0, pytest.approx(np.cos(3)))


def test_procrustes_of_a_moved_copy_is_exact(spark):
    rng = np.random.default_rng(3)
    p, a = rng.normal(size=(40, 2)), 0.7
    q = 2.5 * p @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + [3, -4]
    df = spark.createDataFrame([(1, *map(float, (*u, *v))) for u, v in zip(p, q)], "k int, x double, y double, fx double, fy double")
    r = trace.procrustes(df, ["k"]).first()
    assert (r["scale"], r["rotation"]) == (pytest.approx(2.5), pytest.approx(a)) and r["residual"] < 1e-6 and not r["reflected"]
    u, s, w = np.linalg.svd((p - p.mean(0)).T @ (q - q.mean(0)))
    assert r["scale"] == pytest.approx(s.sum() / ((p - p.mean(0)) ** 2).sum())
    fitted = trace.procrustes_error(df, ["k"]).first()
    assert fitted["shape_error_total"] < 1e-6 and fitted["rotation"] == pytest.approx(a)
    mirror = trace.procrustes_error(df.withColumn("fy", -F.col("fy")), ["k"]).first()
    assert mirror["reflected"] and mirror["shape_error_total"] < 1e-6


def test_bezier_figures(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 0.0, 4.0, 0.0, 2.0, 3.0), (2, 0, 0.0, 0.0, 4.0, 0.0, 2.0, 0.0)], "k int, segment_index int, start_x double, start_y double, end_x double, end_y double, ctrl_x double, ctrl_y double")
    t = np.linspace(0, 1, 100_001)
    x, y = 4 * t, 6 * t * (1 - t)
    got = {r["k"]: r for r in trace.figure_summary(s, ["k"]).collect()}
    assert got[1]["curve_length"] == pytest.approx(np.hypot(np.diff(x), np.diff(y)).sum(), rel=1e-6) and got[2]["sinuosity"] == 1
    curvature = 48 / np.hypot(4, 6 - 12 * t) ** 3
    got = {r["k"]: r["total_abs_curvature"] for r in trace.total_abs_curvature(s, ["k"]).collect()}
    assert got[1] == pytest.approx(curvature.mean(), rel=1e-3) and got[2] == 0
    turns = {r["k"]: r for r in trace.turning_summary(s, ["k"], 200).collect()}
    assert turns[1]["turn_sum"] == pytest.approx(2 * np.arctan2(6, 4), rel=0.02)


def test_entropy_and_interpolation(spark):
    flat = path(spark, [(np.sin(k), 0) for k in range(200)])
    noise = path(spark, [(x, 0) for x in np.random.default_rng(0).normal(size=200)])
    a, b = (trace.series_entropy(d, ["k"], "o", "x", 2, 0.2).first() for d in (flat, noise))
    assert a["sample_entropy"] < b["sample_entropy"] and a["approximate_entropy"] < b["approximate_entropy"]
    even = trace.reinterpolate(path(spark, [(0, 0), (1, 0), (10, 0)]), ["k"], "o", 11, equidistant=True).orderBy("point_index").collect()
    assert [r["x"] for r in even] == pytest.approx(range(11))


def plain_matches(v, length, tol):
    w = np.lib.stride_tricks.sliding_window_view(v, length)
    return np.array([(np.abs(w - row).max(axis=1) <= tol).sum() for row in w])


@pytest.mark.parametrize("kind", ["normal", "ties", "constant", "walk"])
def test_entropy_counts_equal_all_pairs(kind, monkeypatch):
    rng = np.random.default_rng(5)
    v = {"normal": rng.normal(size=700), "ties": rng.integers(0, 6, 600) * 0.1, "constant": np.ones(300), "walk": np.cumsum(rng.normal(size=900))}[kind]
    for plain in (0, 10**6):
        monkeypatch.setattr(kernels, "PLAIN", plain)
        for length in (1, 2, 3, 4):
            for tol in (0.0, 0.1, 0.2 * v.std(ddof=1), 0.30000000000000004):
                assert np.array_equal(kernels.template_matches(v, length, tol), plain_matches(v, length, tol))
        m, n, tol = 2, len(v), 0.2 * v.std(ddof=1)
        w = lambda q: np.lib.stride_tricks.sliding_window_view(v, q)[: n - m]
        b, a = ((np.abs(w(q)[:, None] - w(q)[None]).max(axis=2) <= tol).sum() - (n - m) for q in (m, m + 1))
        phi = [np.log(plain_matches(v, q, tol) / (n - q + 1)).mean() for q in (m, m + 1)]
        assert kernels.entropies(v, m, 0.2) == pytest.approx((phi[0] - phi[1], -np.log(a / b)), abs=1e-12)


def test_entropy_of_a_long_series():
    """A hundred thousand values: all pairs would be 10^10 comparisons a template length."""
    approximate, sample = kernels.entropies(np.random.default_rng(1).normal(size=100_000), 2, 0.2)
    assert 2.1 < sample < 2.3 and 2.2 < approximate < 2.4


def plain_warping(query, reference):
    n, m = len(query), len(reference)
    cost, came = np.full((n, m), np.inf), np.zeros((n, m), int)
    cost[0, 0] = np.hypot(*(query[0] - reference[0]))
    for i in range(1, n):
        for j in range(m):
            options = [cost[i - 1, j - s] if j >= s else np.inf for s in range(3)]
            came[i, j] = int(np.argmin(options))
            cost[i, j] = min(options) + np.hypot(*(query[i] - reference[j]))
    at = [m - 1]
    for i in range(n - 1, 0, -1):
        at.append(at[-1] - came[i, at[-1]])
    return at[::-1]


@pytest.mark.parametrize(("n", "m"), [(1, 1), (2, 3), (30, 30), (30, 59), (41, 7), (64, 100)])
def test_warping_equals_the_whole_table(n, m):
    rng = np.random.default_rng(n * m)
    for step in (1.0, 0.01):
        q, r = (np.round(np.cumsum(rng.normal(size=(k, 2)), axis=0) / step) * step for k in (n, m))  # rounded, so that ties occur
        for cells in (1, 50, 10**6):
            assert kernels.dtw_asymmetric(q, r, cells).tolist() == plain_warping(q, r)


def test_warping_of_long_curves():
    """Twenty thousand points on both sides: a whole table would hold 4 * 10^8 steps."""
    t = np.linspace(0, 40, 20_000)
    q, r = np.stack([np.cos(t), np.sin(t)], axis=1), np.stack([np.cos(t**1.01), np.sin(t**1.01)], axis=1)
    at = kernels.dtw_asymmetric(q, r, cells=1 << 20)
    assert at[0] == 0 and at[-1] == len(r) - 1 and set(np.diff(at)) <= {0, 1, 2}
    assert np.hypot(*(q - r[at]).T).mean() < np.hypot(*(q - r).T).mean() / 5


def test_order_index_deals_ties(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).alias("v"), "id").repartition(4)
    out = windows.order_index(df, ["v"]).withColumn("p", F.spark_partition_id())
    rows = out.collect()
    assert sorted(r["order_index"] for r in rows) == list(range(4000))
    assert [r["v"] for r in sorted(rows, key=lambda r: r["order_index"])] == sorted(r["v"] for r in rows)
    assert ranged_sizes(df, ["v"]).max() <= 2 * 4000 / 4


def ranged_sizes(df, cols):
    return np.array([r["count"] for r in windows.ranged(df, cols, 4).groupBy("__p").count().collect()])


def test_glitch_and_false_start(spark):
    rows = [(10 * k, 0) for k in range(40)]
    rows[20] = (200, 900)
    df = path(spark, rows).withColumns({"origin_x": F.lit(0.0), "origin_y": F.lit(0.0)})
    assert sorted(set(range(40)) - {r["o"] for r in trace.drop_glitches(df, ["k"], ["o"]).collect()}) == [20]
    slow = df.withColumn("time", F.when(F.col("o") < 3, F.col("o") * 0.01).otherwise(F.col("o") * 0.01 + 5))
    left = trace.drop_false_start(slow, ["k"], ["o"]).orderBy("o").collect()
    assert left[0]["o"] == 3 and left[0]["time"] == pytest.approx(5.03)
    shift = trace.false_start_shifts(slow, ["k"], ["o"]).first()
    assert (shift["samples"], shift["flagged"], shift["start_shift"]) == (40, 3, pytest.approx(5.03))


def test_closed_traces_stay_and_open_ones_go(spark):
    turn = [(500 + 400 * np.cos(t), 500 + 400 * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 60)]
    figure = spark.createDataFrame([(1, 800.0, 2513.0, -1.15)], "k int, figure_size double, figure_length double, figure_shift double")
    for rows, n in ((turn, 60), (turn[:40], 0), ([(x / 3, y / 3) for x, y in turn], 0)):
        df = path(spark, rows).withColumns({"origin_x": F.lit(float(rows[0][0])), "origin_y": F.lit(float(rows[0][1]))})
        assert trace.drop_incomplete(df, figure, ["k"], ["o"]).count() == n
    df = path(spark, turn).withColumns({"origin_x": F.lit(900.0), "origin_y": F.lit(500.0)})
    assert trace.drop_incomplete(df, figure.filter("k = 2"), ["k"], ["o"]).count() == 60


def test_a_straight_figure_does_not_turn(spark):
    s = spark.createDataFrame([(1, i, 10.0 * i, 0.0, 10.0 * i + 10, 0.0, 10.0 * i + 5, 0.0) for i in range(4)], "k int, segment_index int, start_x double, start_y double, end_x double, end_y double, ctrl_x double, ctrl_y double")
    assert trace.turning_summary(s, ["k"]).first()["turn_sum"] == pytest.approx(0, abs=1e-9)


# ---- sources


def test_recording_round_trip(spark, tmp_path):
    io.write_recording(str(tmp_path / "a.edf"), {"C3": (256, 50 * wave(5)), "EMG": (128, 10 * wave(9)[::2])})
    rows = io.read_recordings(spark, str(tmp_path / "*.edf"), 1.0).orderBy("channel", "chunk").collect()
    got = {ch: np.concatenate([r["samples"] for r in rows if r["channel"] == ch]) for ch in ("C3", "EMG")}
    assert np.abs(got["C3"] - 50 * wave(5)).max() < 0.01 and len(got["EMG"]) == 512 and rows[0]["fs"] == 256 and rows[1]["t0"] == 1.0


def test_text_sources(spark, tmp_path):
    (tmp_path / "task_12.txt").write_text("# a comment\nid\tsex\n1\tf\n2\tm\n")
    assert [tuple(r) for r in io.read_task_tables(spark, str(tmp_path / "*.txt"), "id int, sex string").orderBy("id").collect()] == [(1, "f", 12), (2, "m", 12)]
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("p.tlf", "[(1, 2)]")
    (tmp_path / "broken.zip").write_bytes(b"PK no")
    got = {r["status"]: r["text"] for r in io.read_zip_members(spark, str(tmp_path / "*.zip"), [".tlf"]).collect()}
    assert got == {"ok": "[(1, 2)]", "error: BadZipFile": None}
    inventory = io.file_inventory(spark, str(tmp_path), f"{tmp_path}/").collect()
    assert len(inventory) == 3 and {len(r["sha256"]) for r in inventory} == {64}


def test_sinks_and_shards(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") * 2).alias("v"))
    io.write_table(df, str(tmp_path / "a"), ["v", "id"])
    io.write_table(df, str(tmp_path / "b"), ["v", "id"])
    io.write_table(df.withColumn("v", F.col("v").cast("int")), str(tmp_path / "c"))
    assert io.combine_shards(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 10
    with pytest.raises(checks.ContractError):
        io.combine_shards(spark, [str(tmp_path / "a"), str(tmp_path / "c")])
    io.write_csv(df, str(tmp_path / "d"))
    assert io.read_csv_checked(spark, str(tmp_path / "d"), ["v"], "id long, v long").agg(F.sum("v")).first()[0] == 20
    assert io.dim(spark, str(tmp_path / "d")).count() == 5
    with pytest.raises(checks.ContractError):
        io.dim(spark, str(tmp_path / "d"), max_rows=3)
    with pytest.raises(checks.ContractError):
        io.read_table(spark, str(tmp_path / "a"), ["absent"])


# ---- the rest


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, v double")
    with pytest.raises(checks.ContractError):
        checks.assert_unique(df, ["k"])
    with pytest.raises(checks.ContractError):
        checks.assert_close(df.filter("v = 1"), df.filter("v = 2"), ["k"], "v", 0.5)
    checks.assert_close(df.filter("v = 1"), df.filter("v = 2"), ["k"], "v", 1.0)
    with pytest.raises(checks.ContractError):
        models.assert_no_outcomes(df.withColumnRenamed("v", "Power_db"), ["power"])
    with pytest.raises(ValueError):
        shape.select_surface(df, df, "k", F.lit(True))


def test_half_sample_tie_fails(spark):
    with pytest.raises(Exception, match="half-sample"):
        spark.range(1).select(c.to_sample(F.lit(0.05), 10.0)).collect()


def test_max_t_counts_draws(spark):
    rng = np.random.default_rng(2)
    null = rng.normal(size=(60, 5)).round(1)
    seen = [(k, float(x)) for k, x in enumerate([0.1, -3.0, 1.5, 2.2, 1.5])]
    draws = spark.createDataFrame([(i, float(x)) for i, r in enumerate(null) for x in r], "draw int, t double")
    got = {r["k"]: r["p_fwe"] for r in models.max_t(draws, spark.createDataFrame(seen, "k int, t double")).collect()}
    top = np.abs(null).max(axis=1)
    assert got == {k: pytest.approx((top >= abs(t)).mean()) for k, t in seen}
    got = {r["k"]: r["p_fwe"] for r in models.max_t(draws, spark.createDataFrame(seen, "k int, t double"), plus_one=True).collect()}
    assert got == {k: pytest.approx((1 + (top >= abs(t)).sum()) / 61) for k, t in seen}


def test_null_draws_follow_the_covariance(spark):
    cov = np.array([[1.0, 0.8], [0.8, 1.0]])
    rows = models.null_draws(spark, cov, 4000, None, 1).orderBy("draw", "test").collect()
    again = models.null_draws(spark, cov, 4000, None, 1).repartition(5).orderBy("draw", "test").collect()
    x = np.array([r["t"] for r in rows]).reshape(-1, 2)
    assert rows == again and np.allclose(np.cov(x.T), cov, atol=0.06)


def test_rank_quantile_and_fingerprint(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    assert models.design_rank(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("a") + F.col("b")}) == (3, 4)
    assert t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5) and t_quantile(0.975, 10**6) == pytest.approx(1.959966, abs=1e-4)
    one, two = (table_fingerprint(d, ["a"]).first() for d in (df, df.repartition(9)))
    assert one == two and table_fingerprint(df).first() == table_fingerprint(df.repartition(3)).first()
    assert table_fingerprint(df.withColumn("b", F.lit(0.0)), ["a"]).first() != one


def test_order_index_numbers_every_row_once(spark):
    df = spark.range(40_000).select("id", F.rand(5).alias("v"), F.repeat(F.lit("x"), 50).alias("other")).repartition(7)
    got = windows.order_index(df, ["v"], "i").select("v", "i", "other").collect()
    assert sorted(r["i"] for r in got) == list(range(40_000))
    assert [r["v"] for r in sorted(got, key=lambda r: r["i"])] == sorted(r["v"] for r in got)
    got = windows.quantiles_by_rank(df, "v", {"a": 0.5, "b": 0.999}).first()
    want = np.quantile([r["v"] for r in df.select("v").collect()], [0.5, 0.999])
    assert (got["a"], got["b"]) == (pytest.approx(want[0]), pytest.approx(want[1])) and got["n"] == 40_000


def test_inventory_of_a_large_file(spark, tmp_path):
    """A sparse file of over 2 GB: its bytes fit no column."""
    import hashlib

    size, end = (1 << 31) + 12_345, b"the end"
    with open(tmp_path / "large.bin", "wb") as f:
        f.seek(size - len(end))
        f.write(end)
    whole, zeros = hashlib.sha256(), bytes(1 << 22)
    for at in range(0, size - len(end), len(zeros)):
        whole.update(zeros[: min(len(zeros), size - len(end) - at)])
    whole.update(end)
    rows = {r["relative_path"]: r for r in io.file_inventory(spark, str(tmp_path), f"{tmp_path}/").collect()}
    assert (rows["large.bin"]["length"], rows["large.bin"]["sha256"], rows["large.bin"]["unchanged"]) == (size, whole.hexdigest(), True)


def test_maxima_equal_the_long_table(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4, 4))
    v = a @ a.T
    weights = [(f"t{i}", f"x{k}", float(w)) for i, row in enumerate(rng.integers(-1, 2, (9, 4))) for k, w in enumerate(row)]
    factors = models.contrast_factors(spark.createDataFrame(weights, "test string, term string, weight double").repartition(3), [f"x{k}" for k in range(4)], v)
    got = {r["draw"]: r["t"] for r in models.null_maxima(factors, 700, 12.0, 3).collect()}
    root = np.linalg.cholesky(v)
    w = np.zeros((9, 4))
    for t, x, value in weights:
        w[int(t[1:]), int(x[1:])] = value
    f = w @ root
    se = np.sqrt((f**2).sum(axis=1))
    for d in range(700):
        r = np.random.default_rng([3, d])
        z = r.standard_normal(4) / np.sqrt(r.chisquare(12.0) / 12.0)
        assert got[d] == pytest.approx(np.abs(np.divide(f @ z, se, out=np.zeros(9), where=se > 0)).max())
    observed = spark.createDataFrame([(k, 0.5 * k) for k in range(8)], "test int, t double")
    long = spark.createDataFrame([(d, t) for d, t in got.items()] + [(d, 0.0) for d in got], "draw bigint, t double")
    short = spark.createDataFrame(list(got.items()), "draw bigint, t double")
    assert sorted(map(tuple, models.max_t(short, observed).collect())) == sorted(map(tuple, models.max_t(long, observed).collect()))


def test_maxima_of_many_tests(spark):
    """20,000 draws of 10,000 tests in 40 terms: 2 * 10^8 values that are never a table."""
    factors = spark.range(10_000).select(F.col("id").alias("test"), F.array(*[F.sin(F.col("id") * (k + 1) + k) for k in range(40)]).alias("factor"))
    rows = models.null_maxima(factors.repartition(4), 20_000, None, 1).agg(F.count(F.lit(1)), F.min("t"), F.percentile("t", F.lit(0.95))).first()
    assert rows[0] == 20_000 and rows[1] > 1 and 3.5 < rows[2] < 5
