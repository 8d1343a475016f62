"""Signal and time-frequency jobs (group G).

Signals are rows (recording, channel, chunk, t0, fs, samples array<double>), time-frequency power rows (trial, channel,
frequency, power array<float>) over a shared time axis. Long rows are made only for the window asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from . import aggs, joins, kernels
from .trace import schema_of
from .windows import pct_rank_avg, rank_min

Keys = Sequence[str]


def channel_metrics(chunks: DataFrame, k: Keys, chunk: str = "chunk", samples: str = "samples", flat: float = 1e-12, clip: float | None = None) -> DataFrame:
    """G1: full-scan metrics per channel, in two phases.

    Each chunk gives counts, extremes, sums, flat and clipped runs with those at its borders, and its first and last
    sample; the merge joins runs and steps across borders in chunk order. State per chunk is a few numbers.
    """
    part = "chunk_no bigint, n bigint, n_finite bigint, lo double, hi double, mean double, m2 double, max_step double, first double, last double, run bigint, lead bigint, trail bigint, clip_run bigint, clip_lead bigint, clip_trail bigint"
    schema = schema_of(chunks, k, part)

    def reduce(batches):
        for df in batches:
            rows = []
            for r in df.itertuples(index=False):
                v = np.asarray(getattr(r, samples), float)
                ok = np.isfinite(v)
                x, step = v[ok], np.abs(np.diff(v))
                still = np.concatenate([[False], step <= flat]) if len(v) else np.zeros(0, bool)
                top = np.abs(v) >= (clip if clip is not None else np.inf)
                mean = x.mean() if len(x) else 0.0
                rows.append((*[getattr(r, q) for q in k], getattr(r, chunk), len(v), len(x), x.min() if len(x) else np.nan, x.max() if len(x) else np.nan, mean, ((x - mean) ** 2).sum(), np.nanmax(step) if len(step) and np.isfinite(step).any() else np.nan, v[0] if len(v) else np.nan, v[-1] if len(v) else np.nan, *kernels.longest_run(still[1:]), *kernels.longest_run(top)))
            yield pd.DataFrame(rows, columns=[f.split()[0].strip("`") for f in schema.split(", ")])

    partial = chunks.select(*k, F.col(chunk).cast("bigint").alias(chunk), samples).mapInPandas(reduce, schema)

    numbers = [f.split()[0] for f in part.split(", ")]

    def merged(rows) -> tuple:
        """The chunks' numbers, in order, as those of the whole channel."""
        n = mean = m2 = 0.0
        size, step, lo, hi, before = 0, -np.inf, np.inf, -np.inf, np.nan
        run = open_run = clip_run = open_clip = 0
        for r in rows:
            if not r["n"]:
                continue
            size += r["n"]
            if r["n_finite"]:
                d, total = r["mean"] - mean, n + r["n_finite"]
                m2 += r["m2"] + d * d * n * r["n_finite"] / total
                mean += d * r["n_finite"] / total
                n, lo, hi = total, min(lo, r["lo"]), max(hi, r["hi"])
            first, last, inner = (np.nan if r[x] is None else r[x] for x in ("first", "last", "max_step"))
            jump = abs(first - before)
            step = max([step, *(x for x in (inner, jump) if x == x)])
            joined = jump <= flat
            open_run = open_run + 1 if joined else 0
            run = max(run, open_run + r["lead"] if joined else 0, r["run"])
            open_run = open_run + r["trail"] if r["trail"] == r["n"] - 1 else r["trail"]
            clip_run = max(clip_run, open_clip + r["clip_lead"], r["clip_run"])
            open_clip = open_clip + r["clip_trail"] if r["clip_trail"] == r["n"] else r["clip_trail"]
            before = last
        nan = float("nan")
        return size, int(n), mean if n else nan, m2 / n if n else nan, hi - lo if n else nan, lo if n else nan, hi if n else nan, step if step >= 0 else nan, run + 1 if run else int(n > 0), clip_run

    out = "n bigint, n_finite bigint, mean double, variance double, ptp double, min double, max double, max_step double, flat_run bigint, clip_run bigint"

    def merge(batches):
        for df in batches:
            rows = [merged(r) for r in df["__parts"]]
            made = pd.DataFrame(rows, columns=[f.split()[0] for f in out.split(", ")])
            yield pd.concat([df[list(k)].reset_index(drop=True), made], axis=1)

    lists = partial.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct(*numbers))).alias("__parts"))
    return lists.mapInPandas(merge, schema_of(chunks, k, out))


def whole_signals(chunks: DataFrame, k: Keys, chunk: str = "chunk", samples: str = "samples") -> DataFrame:
    """Chunks of a channel put together in order, as ``samples``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(chunk), F.col(samples).alias("s"))))
    return chunks.groupBy(*k).agg(F.flatten(F.transform(rows, lambda r: r["s"])).alias(samples))


def map_arrays(df: DataFrame, f, keep: Keys, column: str, out: str) -> DataFrame:
    """A kernel on each array of a column, in Arrow batches; the other kept columns stay."""
    schema = ", ".join([*(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in keep), f"`{out}` array<double>"])

    def run(batches):
        for part in batches:
            yield pd.DataFrame({**{x: part[x] for x in keep}, out: [f(np.asarray(v, float)) for v in part[column]]})

    return df.select(*keep, F.col(column)).mapInPandas(run, schema)


def welch_psd(signals: DataFrame, k: Keys, fs: float, nperseg: int, bands: Mapping[str, tuple[float, float]], line: float = 60.0, samples: str = "samples") -> DataFrame:
    """Mean power density per band, line noise over its neighbours (2-5 Hz off), lowest over highest band."""
    names = list(bands)
    schema = schema_of(signals, k, ", ".join([*(f"`{b}` double" for b in names), "line_ratio double, low_high_ratio double"]))

    def run(batches):
        for part in batches:
            rows = []
            for r in part.itertuples(index=False):
                f, p = kernels.welch(np.asarray(getattr(r, samples), float), fs, nperseg)
                means = [kernels.band_mean(f, p, *bands[b]) for b in names]
                near = np.nanmean([kernels.band_mean(f, p, line - 5, line - 2), kernels.band_mean(f, p, line + 2, line + 5)]) if line + 5 <= fs / 2 else np.nan
                at = kernels.band_mean(f, p, line - 1, line + 1)
                rows.append((*[getattr(r, q) for q in k], *means, at / near if near and near > 0 else np.nan, means[0] / means[-1] if means[-1] > 0 else np.nan))
            yield pd.DataFrame(rows, columns=[*k, *names, "line_ratio", "low_high_ratio"])

    return signals.select(*k, samples).mapInPandas(run, schema)


def rank_candidates(metrics: DataFrame, part: Keys, value: str, pct: float) -> DataFrame:
    """Rank and average percentile rank inside a type, and whether the value is a candidate (at or above ``pct``)."""
    out = metrics.withColumns({"rank": rank_min(part, value), "pct_rank": pct_rank_avg(part, value)})
    return out.withColumn("candidate", F.coalesce(F.col("pct_rank") >= pct, F.lit(False)))


def candidate_queue(metrics: DataFrame, kind: str, ranked: Sequence[str], hard: Sequence[tuple[Column, str]], pct: float, comparable: tuple[Column, str] | None = None) -> DataFrame:
    """Channels worth a look, with reasons in order, their number and a priority.

    ``hard`` rules (condition, code) are exceptions by themselves. Each of the scale-free ``ranked`` measures adds a reason where it is positive and at or
    above the average percentile rank ``pct`` of its channel type. ``comparable`` (condition, measure) ranks an absolute measure among the rows whose
    units allow it, at both ends. A queue is no verdict: no channel is called bad.
    """
    out, rules = metrics, list(hard)
    for v in ranked:
        out = out.withColumn(f"pct_{v}", pct_rank_avg([kind], v))
        rules.append(((F.col(v) > 0) & (F.col(f"pct_{v}") >= pct), f"extreme_{v}"))
    if comparable:
        fine, v = comparable
        out = out.withColumn("__fine", F.coalesce(fine, F.lit(False)))
        out = out.withColumn("pct_absolute", F.when(F.col("__fine"), pct_rank_avg([kind, "__fine"], v))).drop("__fine")
        rules += [(F.col("pct_absolute") >= pct, "extreme_high_scale"), (F.col("pct_absolute") <= float(1 - Decimal(str(pct))), "extreme_low_scale")]  # 1 - 0.9 is 0.1, not the float below
    out = out.withColumn("__codes", c.issue_codes(rules))
    is_hard = F.arrays_overlap("__codes", F.array(*[F.lit(code) for _, code in hard])) if hard else F.lit(False)
    out = out.withColumns({"reasons": F.array_join("__codes", ";"), "n_reasons": F.size("__codes"), "priority": F.when(is_hard, "hard_exception").when(F.size("__codes") > 0, "extreme_rank")})
    return out.drop("__codes")


def queue_summary(queue: DataFrame, file: Keys, kind: str, kinds: Sequence[str]) -> DataFrame:
    """G3 per file: channels, those of each type, candidates, hard exceptions, and the most frequent first reason by count then name."""
    reason = F.when(F.col("n_reasons") > 0, F.substring_index("reasons", ";", 1))
    counts = queue.groupBy(*file).agg(
        F.count(F.lit(1)).alias("n_channels"), *[F.count_if(F.col(kind) == x).alias(f"n_{x}") for x in kinds],
        F.count_if(F.col("n_reasons") > 0).alias("n_candidates"), F.count_if(F.col("priority") == "hard_exception").alias("n_hard"),
    )
    firsts = queue.withColumn("__r", reason).filter("__r is not null").groupBy(*file, "__r").agg(F.count(F.lit(1)).alias("__n"))
    top = firsts.groupBy(*file).agg(F.min_by("__r", F.struct(-F.col("__n"), "__r")).alias("top_reason"))
    return counts.join(top, list(file), "left")


def rereference(df: DataFrame, k: Keys, channel: str, value: str, sources: Sequence) -> DataFrame:
    """Each sample less the mean of the source channels at the same place."""
    mean = F.avg(F.when(F.col(channel).isin(list(sources)), F.col(value))).over(Window.partitionBy(*k))
    return df.withColumn(f"{value}_reref", F.col(value) - mean)


def fir_bandpass(signals: DataFrame, keep: Keys, lo: float | None, hi: float | None, fs: float, taps: int = 101, samples: str = "samples") -> DataFrame:
    """Zero-phase windowed-sinc filter of whole signals (use ``whole_signals``, or chunks that overlap by taps // 2)."""
    kernel = kernels.fir(lo, hi, fs, taps)
    return map_arrays(signals, lambda v: kernels.filtered(v, kernel), keep, samples, samples)


def rectify_smooth(signals: DataFrame, keep: Keys, cutoff: float, fs: float, taps: int = 101, samples: str = "samples") -> DataFrame:
    """Absolute distance from the median, low-passed. A FIR filter replaces the reference's recursive one: gain differs by under 1 dB below half the cutoff."""
    kernel = kernels.fir(None, cutoff, fs, taps)
    return map_arrays(signals, lambda v: kernels.filtered(np.abs(v - np.median(v)) if len(v) else v, kernel), keep, samples, samples)


def emg_flags(df: DataFrame, unit: Keys, trial: str, muscle: str, epoch: str, value: str, active: str, rest: str, physical: Column, q: float = 0.25) -> DataFrame:
    """MAD-scaled activity per trial, muscle and epoch, active less rest; a trial of the other class is bad if every muscle
    reaches its unit's lower quantile of the physical class. What is unknown reaches nothing; physical trials are never bad.
    """
    k = [*unit, trial]
    cells = aggs.mad(df, [*k, muscle, epoch], value, 1.4826).withColumnRenamed("mad", "activity")
    diff = aggs.contrast(cells, [*k, muscle], epoch, active, rest, "activity", "difference").withColumn("__p", F.coalesce(physical, F.lit(False)))
    limit = F.percentile(F.when(F.col("__p"), F.col("difference")), F.lit(q)).over(Window.partitionBy(*unit, muscle))
    reached = diff.withColumn("__bad", F.coalesce(~F.col("__p") & (F.col("difference") >= limit), F.lit(False)))
    return reached.groupBy(*k).agg(F.bool_and("__bad").alias("bad"), F.max("difference").alias("max_difference"))


def epochs(samples: DataFrame, anchors: DataFrame, part: Keys, sample: str, anchor: str, families: Mapping[str, tuple[int, int]], value: str) -> DataFrame:
    """One array per trial and family around its anchor, bounds included; incomplete epochs are marked, never padded."""
    out = None
    for name, (lo, hi) in families.items():
        rows = joins.cut_epochs(samples, anchors, part, sample, anchor, lo, hi)
        one = rows.groupBy(*part, anchor).agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.col(value).alias("v")))), lambda r: r["v"]).alias("samples"), F.count_distinct("offset").alias("__n"))
        one = one.withColumns({"family": F.lit(name), "complete": (F.col("__n") == hi - lo + 1) & (F.size("samples") == hi - lo + 1)}).drop("__n")
        out = one if out is None else out.unionByName(one)
    return out


def resample(signals: DataFrame, keep: Keys, fs_in: float, fs_out: float, samples: str = "samples") -> DataFrame:
    """Low-pass, then every n-th sample."""
    return map_arrays(signals, lambda v: kernels.resampled(v, fs_in, fs_out), keep, samples, samples)


def wavelet_cycles(freqs: np.ndarray) -> np.ndarray:
    return 4 + (freqs - 4) / 6


def morlet_power(signals: DataFrame, k: Keys, freqs: Sequence[float], fs: float, cycles=wavelet_cycles, samples: str = "samples") -> DataFrame:
    """One row per signal and frequency with ``power`` over time; NaN where the wavelet leaves the signal."""
    f = np.asarray(freqs, float)
    n = np.maximum(np.asarray(cycles(f), float), 1.0)
    schema = schema_of(signals, k, "frequency double, power array<double>")

    def run(batches):
        for part in batches:
            rows = [(*[getattr(r, q) for q in k], float(f[i]), p.tolist()) for r in part.itertuples(index=False) for i, p in enumerate(kernels.morlet_power(np.asarray(getattr(r, samples), float), f, n, fs))]
            yield pd.DataFrame(rows, columns=[*k, "frequency", "power"])

    return signals.select(*k, samples).mapInPandas(run, schema)


def wavelet_power(signals: DataFrame, k: Keys, freqs: Sequence[float], fs: float, trim: int = 0, baseline: tuple[int, int] | None = None, cycles: float = 6.0, samples: str = "samples") -> DataFrame:
    """Fixed-cycle wavelets, ``trim`` samples off both ends, in decibel against the mean over ``baseline`` if given."""
    out = morlet_power(signals, k, freqs, fs, lambda f: np.full(len(f), cycles), samples)
    out = out.withColumn("power", F.slice("power", trim + 1, F.greatest(F.size("power") - 2 * trim, F.lit(0)))) if trim else out
    if baseline is None:
        return out
    base = c.array_span_mean(F.col("power"), *baseline)
    return out.withColumn("__b", base).withColumn("power", F.transform("power", lambda p: c.to_db(p, F.col("__b")))).drop("__b")


def baseline_db(task: DataFrame, ref: DataFrame, k: Keys, t0: int, t1: int, base: tuple[int, int], arr: str = "power") -> DataFrame:
    """Task power from t0 to t1 in decibel against the reference's mean over ``base`` (mean first, then the ratio), and its log10."""
    means = ref.select(*k, c.array_span_mean(F.col(arr), *base).alias("baseline"))
    out = task.select(*k, c.slice_by(F.col(arr), t0, t1).alias(arr)).join(means, list(k))
    return out.withColumns({"power_db": F.transform(arr, lambda p: c.to_db(p, F.col("baseline"))), "log_power": F.transform(arr, c.log_power)})


def artifact_flags(epochs_: DataFrame, k: Keys, group: Keys, samples: str, max_ptp: float, max_jump: float, min_ptp: float, max_z: float) -> DataFrame:
    """Per trial whether any channel exceeds a peak-to-peak, step or robust z limit, or is flat."""
    cells = epochs_.withColumns({"ptp": c.ptp(F.col(samples)), "jump": c.max_step(F.col(samples))})
    scored = aggs.robust_log_z(cells, group, "ptp")
    flags = {"large": F.col("ptp") > max_ptp, "jumpy": F.col("jump") > max_jump, "flat": F.col("ptp") < min_ptp, "deviant": F.abs("robust_z") > max_z}
    return scored.groupBy(*k).agg(*[F.coalesce(F.bool_or(e), F.lit(False)).alias(n) for n, e in flags.items()])


def band_window_features(cells: DataFrame, k: Keys, definitions: DataFrame, frequency: str, t: str, value: str, width: float | None = None) -> DataFrame:
    """Mean of the cells in each definition's band and window (f_lo, f_hi, t_lo, t_hi), ends included.

    A short table of definitions goes to all tasks; with ``width`` cells and definitions meet in stretches of time of that width, so their number
    may grow with the data.
    """
    band = F.col(frequency).between(F.col("f_lo"), F.col("f_hi"))
    wide = definitions.withColumns({"t_lo": F.col("t_lo") - 1e-12, "t_hi": F.col("t_hi") + 1e-12})
    return joins.range_join(cells, wide, t, "t_lo", "t_hi", width).filter(band).groupBy(*k, "feature").agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n_cells"))


def roi_means(features: DataFrame, k: Keys, channel: str, value: str, rois: DataFrame, on: Keys = ()) -> DataFrame:
    """Equal-weight mean per region (roi, channel and the columns ``on``, such as the hand), with its contributors."""
    joined = features.join(rois, [channel, *on])
    return joined.groupBy(*k, "roi").agg(F.avg(value).alias("value"), F.count_distinct(channel).alias("n_channels"))


def roi_check(features: DataFrame, roi: DataFrame, k: Keys, channel: str, value: str, rois: DataFrame, on: Keys = ()) -> DataFrame:
    """Largest difference between stored region means and recomputed ones, and unmatched rows."""
    from .checks import max_difference

    return max_difference(roi, roi_means(features, k, channel, value, rois, on), [*k, "roi"], "value")


def map_task_hand(df: DataFrame, codes: DataFrame, overrides: DataFrame, k: Keys, code: str) -> DataFrame:
    """Hand of a code, unless the unit has an override."""
    out = df.join(codes, code, "left").join(overrides.withColumnRenamed("hand", "__o"), list(k), "left")
    return out.withColumns({"hand": F.coalesce("__o", "hand"), "hand_source": F.when(F.col("__o").isNotNull(), "override").when(F.col("hand").isNotNull(), "code")}).drop("__o")


def link_trials(trials: DataFrame, behaviour: DataFrame, keys: Mapping[str, str], duration: str, short: float) -> DataFrame:
    """Trials with their behaviour rows, whether linked, and a flag for short ones."""
    out = joins.join_keys(trials, behaviour.withColumn("linked", F.lit(True)), keys)
    return out.withColumns({"linked": F.coalesce("linked", F.lit(False)), "short_duration": F.coalesce(F.col(duration) < short, F.lit(False))})


def band_power(tfr: DataFrame, k: Keys, frequency: str, value: str, bands: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Mean power per band, without time."""
    return tfr.withColumn("band", c.assign_band(F.col(frequency), bands)).filter("band is not null").groupBy(*k, "band").agg(F.avg(value).alias("power"))


def prepare_model_rows(df: DataFrame, coords: DataFrame, channel: str, hand: str, trial: str, block_size: int = 20) -> DataFrame:
    """Coordinates mirrored by hand and tidied, and the block of the trial."""
    out = df.join(coords, channel)
    lat, lon = c.sphere_to_latlon(c.mirror(F.col("x"), F.col(hand)), F.col("y"), F.col("z"))
    out = out.withColumns({"lat": lat, "lon": lon}).withColumn("block", c.trial_to_block(F.col(trial), block_size))
    tidy = c.tidy_coord(F.col("lat"), F.col("lon"))
    return out.withColumns({"lat": tidy[0], "lon": tidy[1]})


def tf_means(tfr: DataFrame, unit: str, group: Keys, cell: Keys, value: str) -> DataFrame:
    """Unit means per cell, the group's mean as unit 0, and the group's range for a shared scale."""
    means = aggs.grand_mean(tfr, unit, [*group, *cell], value)
    return means.join(aggs.group_range(means, group, "mean"), list(group))


def atlas_means(tfr: DataFrame, lineage: DataFrame, k: Keys, condition: str, arr: str, lo: float, hi: float) -> DataFrame:
    """Mean array per assigned condition, trials averaged, and the share of its values outside the scale."""
    out = aggs.mean_cells(tfr.join(lineage.select(*k, condition), list(k)), [condition], arr)
    outside = F.size(F.filter("mean", lambda v: (v < lo) | (v > hi)))
    return out.withColumns({"n_outside": outside, "percent_saturated": c.safe_divide(outside * 100.0, F.size("mean"))})


def compare_branches(a: DataFrame, b: DataFrame, k: Keys, fs: float, nperseg: int, bands: Mapping[str, tuple[float, float]], samples: str = "samples") -> DataFrame:
    """RMS of both branches and of their difference, correlation, relative change per band.

    The notch branch is built with ``notch`` (a FIR band-stop in place of the reference's spectrum fit).
    """
    both = a.select(*k, F.col(samples).alias("__a")).join(b.select(*k, F.col(samples).alias("__b")), list(k))
    names = list(bands)
    schema = schema_of(a, k, ", ".join(["rms_a double, rms_b double, rms_difference double, correlation double", *(f"change_{n} double" for n in names)]))

    def run(batches):
        for part in batches:
            rows = []
            for r in part.to_dict("records"):
                x, y = np.asarray(r["__a"], float), np.asarray(r["__b"], float)
                f, p = kernels.welch(x, fs, nperseg)
                _, q = kernels.welch(y, fs, nperseg)
                rms = lambda v: float(np.sqrt((v**2).mean()))
                change = [(kernels.band_mean(f, q, *bands[n]) - kernels.band_mean(f, p, *bands[n])) / kernels.band_mean(f, p, *bands[n]) for n in names]
                rows.append((*[r[x_] for x_ in k], rms(x), rms(y), rms(x - y), float(np.corrcoef(x, y)[0, 1]), *change))
            yield pd.DataFrame(rows, columns=[*k, "rms_a", "rms_b", "rms_difference", "correlation", *(f"change_{n}" for n in names)])

    return both.mapInPandas(run, schema)


def notch(signals: DataFrame, keep: Keys, line: float, fs: float, width: float = 2.0, taps: int = 401, samples: str = "samples") -> DataFrame:
    """Band-stop around the line frequency: the signal less its narrow band-pass."""
    kernel = kernels.fir(line - width, line + width, fs, taps)
    return map_arrays(signals, lambda v: v - kernels.filtered(v, kernel), keep, samples, samples)


def feature_ranges(features: DataFrame, groups: Keys, a: str, b: str) -> DataFrame:
    """Ranges and means of two representations and their correlation."""
    return features.groupBy(*groups).agg(F.min(a).alias(f"{a}_min"), F.max(a).alias(f"{a}_max"), F.avg(a).alias(f"{a}_mean"), F.avg(b).alias(f"{b}_mean"), F.corr(a, b).alias("r"))


def sampled_qc(samples: DataFrame, windows: DataFrame, part: Keys, sample: str, value: str) -> DataFrame:
    """Amplitude figures in fixed windows (window, lo, hi) of each recording."""
    inside = samples.join(joins.definitions(windows), F.col(sample).between(F.col("lo"), F.col("hi")))
    return inside.groupBy(*part, "window").agg(*aggs.signal_moments(value), F.sqrt(F.avg(F.col(value) ** 2)).alias("rms"))


def coordinate_coverage(channels: DataFrame, coords: DataFrame, part: Keys, channel: str) -> DataFrame:
    """Per recording the channels, those with coordinates, and the unmatched names."""
    known = coords.select(c.norm_name(F.col(channel)).alias("__c")).distinct().withColumn("__k", F.lit(True))
    joined = channels.withColumn("__c", c.norm_name(F.col(channel))).join(known, "__c", "left")
    return joined.groupBy(*part).agg(F.count(F.lit(1)).alias("n_channels"), F.count("__k").alias("n_matched"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("__k").isNull(), F.col("__c")))), ";").alias("unmatched"))
