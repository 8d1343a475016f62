"""Numeric kernels on one trial, channel or array: plain numpy, called from grouped pandas functions."""

from __future__ import annotations

import numpy as np


#: Templates up to which all pairs are compared at once.
PLAIN = 256


class Wavelet:
    """Counts of values below a bound inside stretches of an array of whole numbers, one pass over its bits per query."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros, self.rows = [], []
        for bit in reversed(range(self.bits)):
            one = (values >> bit) & 1
            self.rows.append(np.concatenate([[0], np.cumsum(one == 0)]))  # zeros before each place
            self.zeros.append(int(self.rows[-1][-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def below(self, first: np.ndarray, upto: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values from ``first`` to ``upto`` (exclusive) are less than ``bound``."""
        found = np.where(bound >> self.bits > 0, upto - first, 0)
        open_ = bound >> self.bits == 0
        for bit, zeros, row in zip(reversed(range(self.bits)), self.zeros, self.rows, strict=True):
            a, b = row[first], row[upto]
            one = (bound >> bit) & 1 == 1
            found += np.where(open_ & one, b - a, 0)
            first, upto = np.where(one, zeros + first - a, a), np.where(one, zeros + upto - b, b)
        return found


def _inside(first: np.ndarray, upto: np.ndarray, order: np.ndarray, codes: list[np.ndarray], low: list[np.ndarray], high: list[np.ndarray]) -> np.ndarray:
    """How many of the points at ``order[first:upto]`` have each further code from ``low`` to ``high`` (exclusive), per query.

    The last code is counted by a wavelet. Before it, stretches are split into aligned blocks of powers of two: in each
    level's blocks points are ordered by the next code, where what fits is one stretch again.
    """
    if len(codes) == 1:
        counter = Wavelet(codes[0][order])
        return counter.below(first, upto, high[0]) - counter.below(first, upto, low[0])
    found, places = np.zeros(len(first), np.int64), np.arange(len(order))
    width, level = int(codes[0].max(initial=0)) + 2, 0
    a, b = first.copy(), upto.copy()
    while (a < b).any():
        left, right = (a < b) & (a & 1 == 1), (a < b) & (b & 1 == 1)
        who = np.concatenate([np.flatnonzero(left), np.flatnonzero(right)])
        block = np.concatenate([a[left], b[right] - 1])
        if len(who):
            key = (places >> level) * width + codes[0][order]
            by_key = np.argsort(key, kind="stable")
            key, own = key[by_key], order[by_key]
            start, stop = np.searchsorted(key, block * width + low[0][who]), np.searchsorted(key, block * width + high[0][who])
            np.add.at(found, who, _inside(start, stop, own, codes[1:], [x[who] for x in low[1:]], [x[who] for x in high[1:]]))
        a, b = np.where(left, a + 1, a) >> 1, np.where(right, b - 1, b) >> 1
        level += 1
    return found


def template_matches(v: np.ndarray, length: int, tol: float) -> np.ndarray:
    """For each template of ``length`` successive values how many templates, itself included, differ by at most ``tol`` in every place.

    Values are numbered in order; those within the tolerance of one are a stretch of numbers, so matches are points in a box. Boxes are
    counted in n log n (length 2) or n log^2 n (length 3) steps, with memory of n log n numbers.
    """
    n = len(v) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if n <= PLAIN:
        w = np.lib.stride_tricks.sliding_window_view(v, length)
        return (np.abs(w[:, None] - w[None]).max(axis=2) <= tol).sum(axis=1)
    values, code = np.unique(v, return_inverse=True)
    low, high = np.searchsorted(values, values - tol, "left"), np.searchsorted(values, values + tol, "right")
    # Sums round; the rule is on differences, so the borders are moved until it holds there.
    last = len(values) - 1
    for _ in range(4):
        low -= (low > 0) & (np.abs(values - values[np.maximum(low - 1, 0)]) <= tol)
        low += np.abs(values - values[low]) > tol
        high += (high <= last) & (np.abs(values - values[np.minimum(high, last)]) <= tol)
        high -= np.abs(values - values[high - 1]) > tol
    codes = [code[k : k + n] for k in range(length)]
    order = np.argsort(codes[0], kind="stable")
    ordered = codes[0][order]
    first, upto = np.searchsorted(ordered, low[codes[0]]), np.searchsorted(ordered, high[codes[0]])
    if length == 1:
        return upto - first
    return _inside(first, upto, order, codes[1:], [low[c] for c in codes[1:]], [high[c] for c in codes[1:]])


def entropies(v: np.ndarray, m: int, r: float) -> tuple[float, float]:
    """(approximate, sample) entropy; NaN where undefined."""
    n = len(v)
    if n < m + 2:
        return float("nan"), float("nan")
    tol = r * v.std(ddof=1)
    short, long = template_matches(v, m, tol), template_matches(v, m + 1, tol)
    phi = [np.log(c / len(c)).mean() for c in (short, long)]
    # Sample entropy knows only the n - m templates that can go on, so matches with the last short one are taken off.
    end = v[n - m :]
    with_last = np.all([np.abs(v[k : n - m + k] - end[k]) <= tol for k in range(m)], axis=0)
    b, a = int(short[:-1].sum() - with_last.sum()) - (n - m), int(long.sum()) - (n - m)
    return float(phi[0] - phi[1]), float(-np.log(a / b)) if a > 0 and b > 0 else float("nan")


def resample_path(x: np.ndarray, y: np.ndarray, t: np.ndarray, n: int | None, fps: float, equidistant: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points spaced evenly in time or along the path; equal axis values are averaged first."""
    axis = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))]) if equidistant else t
    at, where = np.unique(axis, return_inverse=True)
    mean = lambda v: np.bincount(where, v) / np.bincount(where)
    if n is None:
        n = max(2, int(round((t.max() - t.min()) * fps)) + 1)
    grid = np.linspace(at[0], at[-1], n)
    return np.interp(grid, at, mean(x)), np.interp(grid, at, mean(y)), np.interp(grid, at, mean(t))


#: Cells of a table of steps that is held at once.
CELLS = 1 << 24


def dtw_asymmetric(query: np.ndarray, reference: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """For each query point the reference point of the cheapest path from first to last that advances by 0, 1 or 2 a step; of equally cheap steps the smallest.

    Divide and conquer: from the costs of one row those of the middle row follow; the second half gives the place where the path
    passes the middle, which ends the first half. Tables of steps are made for parts of at most ``cells`` cells, so memory is
    that and a row of costs per halving; the numbers added are those of one whole table, so the path is the same. Rows
    hold only what a path from the first to the last point can reach.
    """
    n, m = len(query), len(reference)
    at = np.zeros(n, np.int64)
    # Places that are reachable from the start and from which the end is.
    low, high = np.maximum(0, m - 1 - 2 * (n - 1 - np.arange(n))), np.minimum(m - 1, 2 * np.arange(n))

    def step(i: int, cost: np.ndarray, end: int, came: np.ndarray | None = None) -> np.ndarray:
        """Costs of row i up to the place ``end`` from those of the row before (from its lowest place on)."""
        lo, hi = int(low[i]), min(int(high[i]), end)
        before = np.full(hi - lo + 3, np.inf)  # places lo - 2 .. hi of the row before
        own = int(low[i - 1]) - (lo - 2)
        cut = max(0, -own)
        part = cost[cut : cut + len(before) - max(own, 0)]
        before[max(own, 0) : max(own, 0) + len(part)] = part
        options = np.stack([before[2:], before[1:-1], before[:-2]])
        if came is not None:
            came[lo : hi + 1] = options.argmin(axis=0)
        return options.min(axis=0) + np.hypot(*(query[i] - reference[lo : hi + 1]).T)

    def solve(first: int, last: int, cost: np.ndarray, end: int) -> None:
        """Places of rows first .. last - 1, given the costs of row ``first`` and the place of row ``last``."""
        if last - first < 2 or (last - first) * (end + 1) <= cells:
            came = np.zeros((last - first, end + 1), np.int8)
            for i in range(first + 1, last + 1):
                cost = step(i, cost, end, came[i - first - 1])
            for i in range(last, first, -1):
                at[i - 1] = at[i] - came[i - first - 1, at[i]]
            return
        middle, half = (first + last) // 2, cost
        for i in range(first + 1, middle + 1):
            half = step(i, half, end)
        solve(middle, last, half, end)
        del half
        solve(first, middle, cost, int(at[middle]))

    at[-1] = m - 1
    if n > 1:
        solve(0, n - 1, np.hypot(*(query[0] - reference[: int(high[0]) + 1]).T), m - 1)
    return at


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def segment_density(v: np.ndarray, fs: float, nperseg: int, step: int) -> np.ndarray:
    """Power density of each Hann segment, one every ``step`` samples, its mean removed."""
    seg = np.lib.stride_tricks.sliding_window_view(v, nperseg)[::step]
    w = hann(nperseg)
    spec = np.abs(np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w**2).sum())
    spec[:, 1 : (-1 if nperseg % 2 == 0 else None)] *= 2
    return spec


def welch(v: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power density) by Welch's method: Hann segments, half overlapping."""
    nperseg = min(nperseg, len(v))
    return np.fft.rfftfreq(nperseg, 1 / fs), segment_density(v, fs, nperseg, max(1, nperseg // 2)).mean(axis=0)


def band_mean(f: np.ndarray, p: np.ndarray, lo: float, hi: float) -> float:
    inside = (f >= lo) & (f <= hi)
    return float(p[inside].mean()) if inside.any() else float("nan")


def fir(lo: float | None, hi: float | None, fs: float, taps: int) -> np.ndarray:
    """Windowed-sinc (Hamming) low-pass, high-pass or band-pass kernel of odd length."""
    if taps % 2 == 0:
        raise ValueError("taps must be odd")
    n = np.arange(taps) - taps // 2
    window = 0.54 + 0.46 * np.cos(2 * np.pi * n / (taps - 1))
    low = lambda f: (lambda h: h / h.sum())(2 * f / fs * np.sinc(2 * f / fs * n) * window)
    pulse = (n == 0).astype(float)
    if lo is None:
        return low(hi)
    if hi is None:
        return pulse - low(lo)
    return low(hi) - low(lo)


def filtered(v: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Zero-phase: the symmetric kernel is centred, the ends are mirrored."""
    half = len(kernel) // 2
    if len(v) == 0:
        return v
    return np.convolve(np.pad(v, half, mode="reflect" if len(v) > half else "edge"), kernel, mode="valid")


def resampled(v: np.ndarray, fs_in: float, fs_out: float, taps: int = 101) -> np.ndarray:
    """Low-pass below the new Nyquist frequency, then every n-th sample; the rates' ratio must be whole."""
    step = fs_in / fs_out
    if abs(step - round(step)) > 1e-9:
        raise ValueError("the rates' ratio must be whole")
    return filtered(v, fir(None, 0.45 * fs_out, fs_in, taps))[:: int(round(step))]


def morlet_power(v: np.ndarray, freqs: np.ndarray, cycles: np.ndarray, fs: float) -> np.ndarray:
    """Power of v at each frequency and sample by complex Morlet wavelets of unit energy; NaN where the wavelet leaves the signal."""
    out = np.full((len(freqs), len(v)), np.nan)
    for k, (f, c) in enumerate(zip(freqs, cycles, strict=True)):
        sd = c / (2 * np.pi * f)
        half = int(np.floor(5 * sd * fs))
        t = np.arange(-half, half + 1) / fs
        w = np.exp(2j * np.pi * f * t) * np.exp(-(t**2) / (2 * sd**2))
        w /= np.sqrt((np.abs(w) ** 2).sum())
        if len(v) >= len(w):
            full = np.abs(np.convolve(v, w, mode="valid")) ** 2
            out[k, half : half + len(full)] = full
    return out


def longest_run(flag: np.ndarray) -> tuple[int, int, int]:
    """(longest, leading, trailing) run of true."""
    n = len(flag)
    if n == 0:
        return 0, 0, 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    runs = edges[1::2] - edges[::2]
    if not len(runs):
        return 0, 0, 0
    return int(runs.max()), int(runs[0]) if flag[0] else 0, int(runs[-1]) if flag[-1] else 0
