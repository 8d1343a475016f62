"""Long recordings in chunks of any lengths against the whole signal."""

import numpy as np
import pytest

from epochlake.operators import kernels
from epochlake.operators import recordings as rec

RNG = np.random.default_rng(7)
SIGNALS = {"a": RNG.normal(size=1000), "b": np.cumsum(RNG.normal(size=337)), "c": RNG.normal(size=40), "d": RNG.normal(size=3), "e": np.sin(np.arange(64) * 0.7)}


def cut(v, sizes):
    at, out = 0, []
    while at < len(v):
        n = int(next(sizes))
        out.append((at, v[at : at + n]))
        at += n
    return out


def chunked(spark, longest, seed=1, signals=SIGNALS):
    rng = np.random.default_rng(seed)
    rows = [(name, k, at, [float(x) for x in v]) for name, whole in signals.items() for k, (at, v) in enumerate(cut(whole, iter(lambda: rng.integers(1, longest + 1), None)))]
    rng.shuffle(rows)
    return spark.createDataFrame([(r[0], int(r[1]), int(r[2]), r[3]) for r in rows], "ch string, chunk int, start bigint, samples array<double>")


def together(df):
    out = {}
    for r in df.orderBy("ch", "start").collect():
        have = out.setdefault(r["ch"], [])
        assert r["start"] == len(have)
        have += r["samples"]
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize(("longest", "tile"), [(1, 7), (50, 64), (400, 30), (2000, 65_536)])
def test_filters_equal_the_whole_signal(spark, longest, tile):
    df = chunked(spark, longest)
    kernel = kernels.fir(4, 12, 64, 51)
    got = together(rec.bandpass(df, ["ch"], 4, 12, 64, 51, tile))
    assert set(got) == set(SIGNALS)
    for name, v in SIGNALS.items():
        np.testing.assert_allclose(got[name], kernels.filtered(v, kernel), atol=1e-9)
    got = together(rec.rectify_smooth(df, ["ch"], 6, 64, 31, tile))
    for name, v in SIGNALS.items():
        np.testing.assert_allclose(got[name], kernels.filtered(np.abs(v - np.median(v)), kernels.fir(None, 6, 64, 31)), atol=1e-9)
    got = together(rec.resample(df, ["ch"], 64, 16, 51, tile))
    for name, v in SIGNALS.items():
        np.testing.assert_allclose(got[name], kernels.filtered(v, kernels.fir(None, 7.2, 64, 51))[::4], atol=1e-9)


@pytest.mark.parametrize(("longest", "tile", "nperseg"), [(1, 7, 16), (50, 64, 32), (400, 30, 33), (2000, 65_536, 64)])
def test_spectra_equal_the_whole_signal(spark, longest, tile, nperseg):
    df = chunked(spark, longest)
    rows = rec.welch_density(rec.spectrum_sums(df, ["ch"], 64.0, nperseg, tile), ["ch"], 64.0).collect()
    for name, v in SIGNALS.items():
        got = dict(sorted((round(r["frequency"], 9), r["density"]) for r in rows if r["ch"] == name))
        f, p = kernels.welch(v, 64.0, nperseg)
        np.testing.assert_allclose(list(got), f)
        np.testing.assert_allclose(list(got.values()), p, atol=1e-9)
    bands = rec.welch_psd(df, ["ch"], 64.0, 32, {"low": (2, 8), "high": (16, 30)}, 20.0, tile).collect()
    for r in bands:
        f, p = kernels.welch(SIGNALS[r["ch"]], 64.0, 32)
        want = kernels.band_mean(f, p, 2, 8)
        assert r["low"] == pytest.approx(want, abs=1e-9) if want == want else r["low"] is None


def test_starts_medians_and_gaps(spark):
    df = chunked(spark, 30)
    assert {(r["ch"], r["chunk"], r["start"]) for r in rec.with_starts(df.drop("start"), ["ch"]).collect()} == {(r["ch"], r["chunk"], r["start"]) for r in df.collect()}
    odd = {**SIGNALS, "nan": np.array([1.0, np.nan, 2.0]), "ties": np.array([2.0, -0.0, 0.0, -5.0, 2.0, 2.0]), "far": np.array([-1e300, 1e-300, 1e300, -1e-300]), "one": np.array([-3.5])}
    got = {r["ch"]: r["median"] for r in rec.medians(chunked(spark, 2, signals=odd), ["ch"]).collect()}
    assert set(got) == set(odd)
    for name, v in odd.items():
        assert got[name] == np.median(v) or np.isnan(got[name]) and np.isnan(np.median(v))
    with pytest.raises(Exception, match="gaps"):
        rec.bandpass(df.filter("ch <> 'a' or chunk <> 5"), ["ch"], 4, 12, 64, 51, 64).collect()


def test_no_row_holds_a_channel(spark):
    long = chunked(spark, 100, signals={"a": RNG.normal(size=5000)})
    sizes = [len(r["samples"]) for r in rec.tiles(long, ["ch"], 128, 25, 25).collect()]
    assert len(sizes) == 40 and max(sizes) <= 178


def test_branches(spark):
    df = chunked(spark, 60)
    notched = rec.notch(df, ["ch"], 20.0, 64.0, taps=31, tile=50)
    rows = rec.compare_branches(df, notched, ["ch"], 64.0, 32, {"line": (18, 22)}, tile=70).collect()
    assert {r["ch"] for r in rows} == set(SIGNALS)
    for r in rows:
        x = SIGNALS[r["ch"]]
        y = x - kernels.filtered(x, kernels.fir(18, 22, 64.0, 31))
        rms = lambda v: np.sqrt((v**2).mean())
        assert (r["rms_a"], r["rms_b"], r["rms_difference"]) == pytest.approx((rms(x), rms(y), rms(x - y)), abs=1e-9)
        assert r["correlation"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
        (f, p), (_, q) = kernels.welch(x, 64.0, 32), kernels.welch(y, 64.0, 32)
        want = kernels.band_mean(f, q, 18, 22) / kernels.band_mean(f, p, 18, 22) - 1
        assert r["change_line"] is None if want != want else r["change_line"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("longest", "tile"), [(5, 16), (700, 65_536)])
def test_windows(spark, longest, tile):
    df = chunked(spark, longest).selectExpr("'r' AS rec", "ch", "case when ch in ('a', 'b') then 'x' else 'y' end AS type", "start", "samples")
    windows = spark.createDataFrame([("r", 1, 10, 49), ("r", 2, 30, 30), ("r", 3, 200, 320), ("r", 4, 5000, 6000), ("q", 5, 0, 9), ("r", 6, -5, 20)], "rec string, window int, lo int, hi int")
    rows = {(r["type"], r["window"]): r for r in rec.sampled_qc(df, windows, ["ch"], ["rec"], ["type"], 64.0, 16, {"low": (2, 12)}, tile).collect()}
    assert set(rows) == {("x", 1), ("y", 1), ("x", 2), ("y", 2), ("x", 3), ("x", 6), ("y", 6)}
    for (kind, w), r in rows.items():
        lo, hi = {1: (10, 49), 2: (30, 30), 3: (200, 320), 6: (0, 20)}[w]
        parts = [v[lo : hi + 1] for n, v in SIGNALS.items() if (n in "ab") == (kind == "x") and len(v) > lo]
        whole = np.concatenate(parts)
        assert (r["n_channels"], r["n"]) == (len(parts), len(whole))
        assert (r["mean"], r["variance"], r["ptp"]) == pytest.approx((whole.mean(), whole.var(), np.ptp(whole)), abs=1e-9)
    segments = np.concatenate([kernels.segment_density(v[10:50], 64.0, 16, 8) for v in (SIGNALS["a"], SIGNALS["b"])])
    f = np.fft.rfftfreq(16, 1 / 64)
    assert rows[("x", 1)]["low"] == pytest.approx(segments.mean(axis=0)[(f >= 2) & (f <= 12)].mean(), abs=1e-9)
