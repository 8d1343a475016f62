"""Long recordings in chunks: filters, spectra and figures equal to those of the whole signal, without a row that holds one.

A recording is rows (keys, start, samples array<double>): ``start`` is the number of the chunk's first sample in its channel.
Chunks may have any lengths; they follow each other without gaps (a gap raises an error). The samples are dealt to tiles of a
fixed length together with the samples that their neighbours lend them (the halo): half a kernel on both sides for a
filter, the rest of the last segment for a spectrum. A tile is bounded whatever the chunks' length, and tiles of one channel lie in many
tasks. What a channel needs as a whole (medians, moments, densities) is merged from small partial results.

Null or empty arrays hold no samples; NaN goes through filters as in numpy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .trace import schema_of

Keys = Sequence[str]

#: Samples of a tile.
TILE = 65_536
#: Chunks whose lengths are summed together before a channel's blocks are.
BLOCK = 1024
#: Rows of a lookup table that is sent to all tasks.
BROADCAST_ROWS = 100_000


def with_starts(chunks: DataFrame, k: Keys, chunk: str = "chunk", samples: str = "samples") -> DataFrame:
    """Adds ``start`` from the lengths of the chunks before (whole, dense numbers ``chunk``), in two levels, so that no task orders a whole channel's chunks."""
    size = F.greatest(F.size(F.coalesce(samples, F.array().cast("array<double>"))), F.lit(0)).cast("bigint")
    meta = chunks.select(*k, chunk, F.floor(F.col(chunk) / BLOCK).alias("__block"), size.alias("__n"))
    blocks = meta.groupBy(*k, "__block").agg(F.sum("__n").alias("__sum"))
    blocks = blocks.withColumn("__before", F.sum("__sum").over(Window.partitionBy(*k).orderBy("__block")) - F.col("__sum")).drop("__sum")
    inside = F.sum("__n").over(Window.partitionBy(*k, "__block").orderBy(chunk)) - F.col("__n")
    starts = meta.withColumn("__inside", inside).join(blocks, [*k, "__block"]).select(*k, chunk, (F.col("__inside") + F.col("__before")).alias("start"))
    return chunks.join(starts, [*k, chunk])


def tiles(chunks: DataFrame, k: Keys, tile: int, before: int, after: int, samples: Sequence[str] = ("samples",)) -> DataFrame:
    """Rows (keys, tile, first, samples): samples from ``before`` the tile to ``after`` it, as far as the signal goes; ``first`` is the first one's number.

    Several columns of samples stay side by side.
    """
    names, lead = list(samples), samples[0]
    n, s = F.size(lead), F.col("start")
    rows = chunks.select(*k, F.col("start").cast("bigint").alias("start"), *[F.col(c).cast("array<double>").alias(c) for c in names]).filter(F.size(lead) > 0)
    own = F.sequence(F.greatest(F.floor((s - after) / tile), F.lit(0)), F.ceil((s + n + before) / tile) - 1)
    rows = rows.withColumn("tile", F.explode(own))
    low = F.greatest(s, F.col("tile") * tile - before)
    high = F.least(s + n, (F.col("tile") + 1) * tile + after)
    piece = F.struct(low.alias("first"), high.alias("upto"), *[F.slice(c, (low - s + 1).cast("int"), (high - low).cast("int")).alias(c) for c in names])
    parts = rows.select(*k, "tile", piece.alias("__p")).groupBy(*k, "tile").agg(F.array_sort(F.collect_list("__p")).alias("__p"))
    first, upto = F.array_min(F.col("__p")["first"]), F.array_max(F.col("__p")["upto"])
    held = F.aggregate("__p", F.lit(0).cast("bigint"), lambda a, p: a + p["upto"] - p["first"])
    whole = F.when(held == upto - first, first).otherwise(F.raise_error(F.lit("chunks of a channel must follow each other without gaps")).cast("bigint"))
    joined = [F.flatten(F.col("__p")[c]).alias(c) for c in names]
    # A tile of lent samples alone lies behind the signal's end.
    return parts.filter(upto > F.col("tile") * tile).select(*k, "tile", whole.alias("first"), *joined)


def filtered_core(v: np.ndarray, first: int, lo: int, tile: int, kernel: np.ndarray) -> np.ndarray:
    """The tile's own samples under a centred kernel; the signal's ends are mirrored as ``kernels.filtered`` does."""
    half, upto = len(kernel) // 2, first + len(v)
    hi = min(lo + tile, upto)
    left, right = (half - lo if lo < half else 0), max(0, half - (upto - hi))
    if left and right and len(v) <= half:  # the whole signal, shorter than half a kernel
        return kernels.filtered(v, kernel)[lo:hi]
    left = min(left, half) if first == 0 else 0
    return np.convolve(np.pad(v, (left, right), mode="reflect"), kernel, mode="valid")


def _mapped(tiled: DataFrame, k: Keys, f, tile: int, samples: str, every: int) -> DataFrame:
    schema = schema_of(tiled, k, "start bigint, samples array<double>")

    def run(batches):
        for part in batches:
            rows = []
            for r in part.to_dict("records"):
                lo = int(r["tile"]) * tile
                out = f(np.asarray(r[samples], float), int(r["first"]), lo)
                rows.append((*[r[q] for q in k], lo // every, out[::every]))
            yield pd.DataFrame(rows, columns=[*k, "start", "samples"])

    return tiled.mapInPandas(run, schema)


def filter_chunks(chunks: DataFrame, k: Keys, kernel: np.ndarray, tile: int = TILE, every: int = 1, less: bool = False, samples: str = "samples") -> DataFrame:
    """Rows (keys, start, samples) of the channel under a symmetric kernel, tile by tile, by overlap and save.

    ``every`` keeps each n-th sample (the tile must be a multiple); ``less`` gives the signal less what the kernel lets through.
    """
    if tile % every:
        raise ValueError("a tile must hold whole steps")
    half = len(kernel) // 2

    def f(v, first, lo):
        out = filtered_core(v, first, lo, tile, kernel)
        return v[lo - first : lo - first + len(out)] - out if less else out

    return _mapped(tiles(chunks, k, tile, half, half, [samples]), k, f, tile, samples, every)


def bandpass(chunks: DataFrame, k: Keys, lo: float | None, hi: float | None, fs: float, taps: int = 101, tile: int = TILE) -> DataFrame:
    """Zero-phase windowed-sinc filter."""
    return filter_chunks(chunks, k, kernels.fir(lo, hi, fs, taps), tile)


def notch(chunks: DataFrame, k: Keys, line: float, fs: float, width: float = 2.0, taps: int = 401, tile: int = TILE) -> DataFrame:
    """Band-stop around the line frequency: the signal less its narrow band-pass (a FIR filter in place of the reference's spectrum fit)."""
    return filter_chunks(chunks, k, kernels.fir(line - width, line + width, fs, taps), tile, less=True)


def resample(chunks: DataFrame, k: Keys, fs_in: float, fs_out: float, taps: int = 101, tile: int = TILE) -> DataFrame:
    """Low-pass below the new Nyquist frequency, then every n-th sample; ``start`` counts the new samples."""
    step = fs_in / fs_out
    if abs(step - round(step)) > 1e-9:
        raise ValueError("the rates' ratio must be whole")
    every = int(round(step))
    return filter_chunks(chunks, k, kernels.fir(None, 0.45 * fs_out, fs_in, taps), -(-tile // every) * every, every)


def _sortable(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order."""
    bits = (np.asarray(v, float) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(float)[0])


def _lookup(df: DataFrame, table: DataFrame, on: Keys) -> DataFrame:
    """Join with a table of a row per channel, sent to all tasks if it is short."""
    return df.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, list(on))


def medians(chunks: DataFrame, k: Keys, samples: str = "samples") -> DataFrame:
    """Rows (keys, median): exact medians of channels by radix selection, NaN where a sample is NaN; channels without samples are absent.

    Doubles are read as numbers of 64 bits in the same order; four passes fix 16 bits each. A chunk sends only its counts per value of
    those bits, so a pass moves at most 65,536 counts a channel and chunk, and no task holds a channel.
    """
    from ..sources.io import cut

    rows = chunks.select(*k, F.col(samples).cast("array<double>").alias("v")).filter(F.size("v") > 0)
    sizes = rows.groupBy(*k).agg(F.sum(F.size("v")).alias("n"), F.bool_or(F.exists("v", lambda x: x.isNull() | F.isnan(x))).alias("nan"))
    ranks = F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    targets = cut(sizes.filter("not nan").select(*k, ranks.alias("rank")).distinct().withColumns({"key": F.lit("0"), "at": F.col("rank")}))
    schema = schema_of(chunks, k, "rank bigint, bucket int, c bigint")
    for shift in (48, 32, 16, 0):

        def counts(batches, shift=shift):
            for part in batches:
                out = []
                for r in part.to_dict("records"):
                    u = _sortable(np.asarray(r["v"], float))
                    for t in r["__t"]:
                        own = u if shift == 48 else u[u >> np.uint64(shift + 16) == np.uint64(int(t["key"]))]
                        bucket, c = np.unique((own >> np.uint64(shift)) & np.uint64(0xFFFF), return_counts=True)
                        out += [(*[r[q] for q in k], t["rank"], int(b), int(n)) for b, n in zip(bucket, c, strict=True)]
                yield pd.DataFrame(out, columns=[*k, "rank", "bucket", "c"])

        sought = targets.groupBy(*k).agg(F.collect_list(F.struct("rank", "key")).alias("__t"))
        found = _lookup(rows, sought, k).mapInPandas(counts, schema).groupBy(*k, "rank", "bucket").agg(F.sum("c").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*k, "rank").orderBy("bucket"))
        placed = found.withColumn("__upto", upto).join(targets, [*k, "rank"]).filter((F.col("at") < F.col("__upto")) & (F.col("at") >= F.col("__upto") - F.col("c")))
        key = (F.col("key").cast("decimal(20,0)") * 65536 + F.col("bucket")).cast("decimal(20,0)").cast("string")
        targets = cut(placed.select(*k, "rank", key.alias("key"), (F.col("at") - F.col("__upto") + F.col("c")).alias("at")))

    def values(keys: pd.Series) -> pd.Series:
        return keys.map(lambda x: _double(int(x))).astype(float)

    middle = targets.withColumn("median", F.pandas_udf(values, "double")("key")).groupBy(*k).agg(F.avg("median").alias("median"))
    return middle.unionByName(sizes.filter("nan").select(*k, F.lit(float("nan")).alias("median")))


def rectify_smooth(chunks: DataFrame, k: Keys, cutoff: float, fs: float, taps: int = 101, tile: int = TILE) -> DataFrame:
    """Absolute distance from the channel's median, low-passed. A FIR filter replaces the reference's recursive one: gain differs by under 1 dB below half the cutoff."""
    centred = _lookup(chunks.select(*k, "start", "samples"), medians(chunks, k), k)
    distance = centred.select(*k, "start", F.transform(F.col("samples").cast("array<double>"), lambda v: F.abs(v - F.col("median"))).alias("samples"))
    return filter_chunks(distance, k, kernels.fir(None, cutoff, fs, taps), tile)


def spectrum_sums(chunks: DataFrame, k: Keys, fs: float, nperseg: int, tile: int = TILE, samples: str = "samples") -> DataFrame:
    """Rows (keys, tile, n_segments, nperseg, density): sums over the tile's segments of Welch's power density, to be added up.

    Segments start every half length from the signal's first sample; one that begins in a tile is the tile's, borders notwithstanding. A signal
    shorter than a segment is one segment of its length.
    """
    step = max(1, nperseg // 2)
    tile = -(-tile // step) * step
    schema = schema_of(chunks, k, "tile bigint, n_segments bigint, nperseg int, density array<double>")

    def run(batches):
        for part in batches:
            rows = []
            for r in part.to_dict("records"):
                v, first = np.asarray(r[samples], float), int(r["first"])
                own = min(nperseg, len(v)) if first == 0 else nperseg
                if len(v) >= own:
                    rows.append((*[r[q] for q in k], r["tile"], (len(v) - own) // step + 1, own, kernels.segment_density(v, fs, own, step).sum(axis=0)))
            yield pd.DataFrame(rows, columns=[*k, "tile", "n_segments", "nperseg", "density"])

    return tiles(chunks, k, tile, 0, nperseg - step, [samples]).mapInPandas(run, schema)


def welch_density(sums: DataFrame, k: Keys, fs: float) -> DataFrame:
    """Rows (keys, frequency, density) from ``spectrum_sums``: mean density over all segments of the keys."""
    bins = sums.select(*k, "n_segments", "nperseg", F.posexplode("density").alias("__f", "__d"))
    return bins.groupBy(*k, "nperseg", "__f").agg((F.sum("__d") / F.sum("n_segments")).alias("density")).select(*k, (F.col("__f") * F.lit(float(fs)) / F.col("nperseg")).alias("frequency"), "density")


def band_densities(density: DataFrame, k: Keys, bands: Mapping[str, tuple[float, float]], line: float | None = None, nyquist: float | None = None) -> DataFrame:
    """Mean density per band, the line's over its neighbours' (2 to 5 Hz off; null if those leave the spectrum), and lowest over highest band."""
    f = F.col("frequency")
    mean = lambda lo, hi: F.avg(F.when(f.between(lo, hi), F.col("density")))
    names = list(bands)
    out = [mean(*bands[b]).alias(b) for b in names]
    if line is not None:
        out += [mean(line - 1, line + 1).alias("__at"), mean(line - 5, line - 2).alias("__below"), mean(line + 2, line + 5).alias("__above")]
    found = density.groupBy(*k).agg(*out)
    if line is not None:
        sides = F.array_compact(F.array("__below", "__above"))
        near = F.aggregate(sides, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(sides), F.lit(0))
        near = near if nyquist is None or line + 5 <= nyquist else F.lit(None).cast("double")
        found = found.withColumn("line_ratio", F.when(near > 0, F.col("__at") / near)).drop("__at", "__below", "__above")
    return found.withColumn("low_high_ratio", F.when(F.col(names[-1]) > 0, F.col(names[0]) / F.col(names[-1])))


def welch_psd(chunks: DataFrame, k: Keys, fs: float, nperseg: int, bands: Mapping[str, tuple[float, float]], line: float = 60.0, tile: int = TILE) -> DataFrame:
    """G2 of channels in chunks."""
    return band_densities(welch_density(spectrum_sums(chunks, k, fs, nperseg, tile), k, fs), k, bands, line, fs / 2)


#: Sums from which moments of two aligned signals follow.
MOMENTS = ("n", "a", "b", "aa", "bb", "ab", "dd")


def moment_sums(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds per row the sums over the aligned arrays ``a`` and ``b``: n, a, b, aa, bb, ab and dd of their difference."""
    both = F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))
    total = lambda f: F.aggregate(both, F.lit(0.0), lambda s, r: s + f(r["a"], r["b"]))
    sums = {"n": F.size(a).cast("double"), "a": total(lambda x, y: x), "b": total(lambda x, y: y), "aa": total(lambda x, y: x * x), "bb": total(lambda x, y: y * y), "ab": total(lambda x, y: x * y), "dd": total(lambda x, y: (x - y) * (x - y))}
    return pairs.withColumns(sums)


def branch_figures(sums: DataFrame, k: Keys) -> DataFrame:
    """RMS of both branches and of their difference, and their correlation (null where one is constant), from sums per piece."""
    t = sums.groupBy(*k).agg(*[F.sum(c).alias(c) for c in MOMENTS])
    c = F.col
    spread = lambda q, s: c(q) - c(s) * c(s) / c("n")
    scale = F.sqrt(spread("aa", "a") * spread("bb", "b"))
    rms = {f"rms_{x}": F.sqrt(c(s) / c("n")) for x, s in (("a", "aa"), ("b", "bb"), ("difference", "dd"))}
    return t.select(*k, c("n").cast("bigint").alias("n"), *[e.alias(x) for x, e in rms.items()], F.when(scale > 0, (c("ab") - c("a") * c("b") / c("n")) / scale).alias("correlation"))


def compare_branches(a: DataFrame, b: DataFrame, k: Keys, fs: float, nperseg: int, bands: Mapping[str, tuple[float, float]], tile: int = TILE) -> DataFrame:
    """Two branches of channels in chunks: RMS of both and of their difference, correlation, relative change of density per band.

    The branches may be cut differently; both are dealt to tiles. Moments and densities are merged from tiles. Channels that one branch
    lacks are left out; branches of different lengths raise an error.
    """
    left, right = (tiles(x, k, tile, 0, 0).withColumnRenamed("samples", name) for x, name in ((a, "__a"), (b, "__b")))
    same = F.when(F.size("__a") == F.size("__b"), F.col("__a")).otherwise(F.raise_error(F.lit("branches differ in length")).cast("array<double>"))
    pairs = left.join(right.drop("first"), [*k, "tile"]).withColumn("__a", same)
    figures = branch_figures(moment_sums(pairs, "__a", "__b"), k)
    density = [band_densities(welch_density(spectrum_sums(x, k, fs, nperseg, tile), k, fs), k, bands).select(*k, *[F.col(n).alias(f"__{s}_{n}") for n in bands]) for x, s in ((a, "a"), (b, "b"))]
    change = [F.when(F.col(f"__a_{n}") > 0, (F.col(f"__b_{n}") - F.col(f"__a_{n}")) / F.col(f"__a_{n}")).alias(f"change_{n}") for n in bands]
    return figures.join(density[0], list(k), "left").join(density[1], list(k), "left").select(*k, "n", "rms_a", "rms_b", "rms_difference", "correlation", *change)


def branch_summary(compared: DataFrame, k: Keys, bands: Sequence[str], least: float = 0.99) -> DataFrame:
    """G23 per file: channels, RMS over all of them, median correlation, channels below ``least``, and mean change per band."""
    c, n = F.col, F.sum("n")
    rms = [F.sqrt(F.sum(c(x) * c(x) * c("n")) / n).alias(x) for x in ("rms_a", "rms_b", "rms_difference")]
    low = F.count_if(F.coalesce(c("correlation") < least, F.lit(True))).alias("n_low_correlation")
    out = compared.groupBy(*k).agg(F.count(F.lit(1)).alias("n_channels"), *rms, F.percentile("correlation", F.lit(0.5)).alias("median_correlation"), low, *[F.avg(f"change_{b}").alias(f"change_{b}") for b in bands])
    return out.withColumn("difference_share", F.when(c("rms_a") > 0, c("rms_difference") / c("rms_a")))


def windows_of(chunks: DataFrame, windows: DataFrame, k: Keys, on: Keys, width: int = TILE) -> DataFrame:
    """Samples inside windows (columns ``on``, window, lo, hi; ends included) as chunks of signals of their own: rows (keys, window, start, samples).

    Chunks are cut into cells of ``width`` samples, in which they meet the windows, so any number of windows per recording may be
    asked for.
    """
    cell = lambda c: F.floor(c / width)
    n = F.size("samples")
    held = chunks.filter(n > 0).withColumn("__cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + n - 1))))
    first, upto = F.greatest("start", F.col("__cell") * width), F.least(F.col("start") + n, (F.col("__cell") + 1) * width)
    held = held.withColumns({"samples": F.slice("samples", (first - F.col("start") + 1).cast("int"), (upto - first).cast("int")), "start": first})
    asked = windows.select(*on, "window", F.col("lo").cast("bigint").alias("__lo"), F.col("hi").cast("bigint").alias("__hi")).filter("__lo <= __hi")
    asked = asked.withColumn("__cell", F.explode(F.sequence(cell(F.col("__lo")), cell(F.col("__hi")))))
    low, high = F.greatest("start", "__lo"), F.least(F.col("start") + n - 1, F.col("__hi"))
    met = held.join(asked, [*on, "__cell"]).filter(low <= high)
    piece = F.slice("samples", (low - F.col("start") + 1).cast("int"), (high - low + 1).cast("int"))
    return met.select(*k, "window", "__lo", low.alias("__at"), piece.alias("samples")).withColumn("start", F.col("__at") - F.greatest(F.col("__lo"), F.lit(0))).select(*k, "window", "start", "samples")


def sampled_qc(chunks: DataFrame, windows: DataFrame, k: Keys, on: Keys, types: Keys, fs: float, nperseg: int, bands: Mapping[str, tuple[float, float]], tile: int = TILE) -> DataFrame:
    """Figures of amplitude and density in fixed windows of each recording, per window and channel type.

    ``k`` names a channel, ``types`` (some columns of ``chunks``) what is summed up: moments over all samples of the type, mean density over all
    segments of its channels. Segments begin at the window's first sample and cross the borders of chunks.
    """
    own = list(dict.fromkeys([*k, *types]))
    inside = windows_of(chunks.select(*dict.fromkeys([*own, *on]), "start", F.col("samples").cast("array<double>").alias("samples")), windows, own, on, tile)
    sums = moment_sums(inside, "samples", "samples")
    low, high = F.min(F.array_min("samples")), F.max(F.array_max("samples"))
    total = sums.groupBy(*types, "window").agg(F.count_distinct(*k).alias("n_channels"), *[F.sum(x).alias(x) for x in ("n", "a", "aa")], low.alias("min"), high.alias("max"))
    mean = F.col("a") / F.col("n")
    total = total.select(*types, "window", "n_channels", F.col("n").cast("bigint").alias("n"), mean.alias("mean"), (F.col("aa") / F.col("n") - mean * mean).alias("variance"), "min", "max", (F.col("max") - F.col("min")).alias("ptp"), F.sqrt(F.col("aa") / F.col("n")).alias("rms"))
    density = welch_density(spectrum_sums(inside, [*own, "window"], fs, nperseg, tile), [*types, "window"], fs)
    return total.join(band_densities(density, [*types, "window"], bands).drop("low_high_ratio"), [*types, "window"], "left")

