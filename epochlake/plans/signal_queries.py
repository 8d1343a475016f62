"""Queries of signal and model operators (groups G, M) and scans (SC) on ``embeddings``, ``orders`` and ``events``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import models as m
from ..operators import recordings as rec
from ..operators import signal as g
from ..sources import io
from .base import EV, SG, query, rounded

col = F.col
FS = 64.0


def signals(t):
    return t.embeddings.select("vec_id", "label", col("embedding").cast("array<double>").alias("samples"))


def chunks(t):
    parts = F.sequence(F.lit(0), F.lit(3))
    return signals(t).select("vec_id", F.explode(F.transform(parts, lambda k: F.struct(k.alias("chunk"), F.slice("samples", k * 16 + 1, F.lit(16)).alias("samples")))).alias("r")).select("vec_id", "r.*")


def longest(t):
    return t.sg().withColumn("pos", col("pos").cast("bigint"))


#: Runs in SQL: steps of at most FLAT (at least one sample), and values of at least CLIP in size.
FLAT, CLIP = 0.02, 0.1
RUNS = f"r AS (SELECT *, coalesce(s <= {FLAT}, false) AS st, abs(v) >= {CLIP} AS cl, pos - sum(coalesce(s <= {FLAT}, false)::INTEGER) OVER (PARTITION BY vec_id ORDER BY pos) AS i, pos - sum((abs(v) >= {CLIP})::INTEGER) OVER (PARTITION BY vec_id ORDER BY pos) AS j FROM l), fr AS (SELECT vec_id, max(n) + 1 AS flat_run FROM (SELECT vec_id, count(*) FILTER (st) AS n FROM r GROUP BY vec_id, i) GROUP BY 1), cr AS (SELECT vec_id, max(n) AS clip_run FROM (SELECT vec_id, count(*) FILTER (cl) AS n FROM r GROUP BY vec_id, j) GROUP BY 1)"


@query("g1_channel_metrics", f"WITH {SG}, l AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY vec_id ORDER BY pos)) AS s FROM sg), {RUNS} SELECT vec_id, count(*) AS n, count(*) AS n_finite, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(max(v) - min(v), 6) AS ptp, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(s), 6) AS max_step, max(flat_run) AS flat_run, max(clip_run) AS clip_run FROM l JOIN fr USING (vec_id) JOIN cr USING (vec_id) GROUP BY 1")
def _(t):
    return rounded(g.channel_metrics(chunks(t), ["vec_id"], flat=FLAT, clip=CLIP))


def psd_sql(source: str, starts: str, nperseg: int, keys: str = "vec_id") -> str:
    """Mean power density (keys, f, d) over the segments of ``source`` that begin at ``starts`` (vec_id, o), by sums of sines and cosines."""
    w, turn = f"(0.5 - 0.5 * cos(2 * pi() * i / {nperseg}))", f"2 * pi() * i * k / {nperseg}"
    seg = f"SELECT {keys}, b.o, pos - b.o AS i, v FROM {source} JOIN {starts} b USING (vec_id) WHERE pos BETWEEN b.o AND b.o + {nperseg - 1}"
    flat = f"SELECT *, (v - avg(v) OVER (PARTITION BY vec_id, o)) * {w} AS x FROM ({seg.replace('SELECT ', 'SELECT vec_id, ' if keys != 'vec_id' else 'SELECT ', 1)})"
    power = f"SELECT {keys}, o, vec_id AS vec, k, pow(sum(x * cos({turn})), 2) + pow(sum(x * sin({turn})), 2) AS p FROM ({flat}), range({nperseg // 2 + 1}) q(k) GROUP BY ALL"
    return f"SELECT {keys}, k * {FS} / {nperseg} AS f, avg(p) * CASE WHEN k IN (0, {nperseg // 2}) THEN 1 ELSE 2 END / ({FS} * (SELECT sum({w} * {w}) FROM range({nperseg}) q(i))) AS d FROM ({power}) GROUP BY {keys}, k"


def band_sql(lo: float, hi: float) -> str:
    return f"avg(d) FILTER (f BETWEEN {lo} AND {hi})"


def recordings(t):
    """Each vector is a channel of 64 samples in four chunks; the first sample of each is counted."""
    return rec.with_starts(chunks(t), ["vec_id"])


HALVES = "(SELECT vec_id, 16 * j AS o FROM embeddings, range(3) r(j))"


@query("g2_welch_psd", f"WITH {SG}, ps AS ({psd_sql('sg', HALVES, 32)}), b AS (SELECT vec_id, {band_sql(2, 8)} AS low, {band_sql(8, 16)} AS mid, {band_sql(16, 30)} AS high, {band_sql(19, 21)} AS own, ({band_sql(15, 18)} + {band_sql(22, 25)}) / 2 AS near FROM ps GROUP BY 1) SELECT vec_id, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high, round(own / near, 4) AS line_ratio, round(low / high, 4) AS low_high_ratio FROM b")
def _(t):
    out = rec.welch_psd(recordings(t), ["vec_id"], FS, 32, {"low": (2, 8), "mid": (8, 16), "high": (16, 30)}, line=20.0, tile=24)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("line_ratio", "low_high_ratio")}))


def _(t):
    return rounded(g.welch_psd(signals(t), ["vec_id"], FS, 32, {"low": (2, 8), "mid": (8, 16), "high": (16, 30)}, line=20.0))


@query("g3_rank_candidates", f"WITH {SG}, p AS (SELECT vec_id, label, max(v) - min(v) AS ptp FROM sg GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY ptp DESC) AS rank, (rank() OVER (PARTITION BY label ORDER BY ptp) + (count(*) OVER (PARTITION BY label, ptp) - 1) / 2) / count(*) OVER (PARTITION BY label) AS pct FROM p) SELECT vec_id, rank::INTEGER AS rank, round(pct, 6) AS pct_rank, pct >= 0.9 AS candidate FROM r")
def _(t):
    p = t.sg().groupBy("vec_id", "label").agg((F.max("v") - F.min("v")).alias("ptp"))
    return rounded(g.rank_candidates(p, ["label"], "ptp", 0.9).select("vec_id", "rank", "pct_rank", "candidate"))


#: Channels with a type (label), a measure without scale, and an absolute one; every third is comparable.
QUEUE = f"""WITH {SG}, p AS (SELECT vec_id, label, vec_id // 10 AS file, max(v) - min(v) AS ptp, greatest(max(v), 0) AS peak, count(*) FILTER (v > 0.25) AS n_high FROM sg GROUP BY 1, 2), r AS (
  SELECT *, (rank() OVER (PARTITION BY label ORDER BY ptp) + (count(*) OVER (PARTITION BY label, ptp) - 1) / 2) / count(*) OVER (PARTITION BY label) AS pct_ptp,
    CASE WHEN vec_id % 3 = 0 THEN (rank() OVER (PARTITION BY label, vec_id % 3 = 0 ORDER BY peak) + (count(*) OVER (PARTITION BY label, vec_id % 3 = 0, peak) - 1) / 2) / count(*) OVER (PARTITION BY label, vec_id % 3 = 0) END AS pct_absolute FROM p
), q AS (
  SELECT *, concat_ws(';', CASE WHEN n_high >= 6 THEN 'many_high_samples' END, CASE WHEN ptp > 0 AND pct_ptp >= 0.9 THEN 'extreme_ptp' END, CASE WHEN pct_absolute >= 0.9 THEN 'extreme_high_scale' END, CASE WHEN pct_absolute <= 1 - 0.9 THEN 'extreme_low_scale' END) AS reasons FROM r
), c AS (SELECT *, CASE WHEN reasons = '' THEN 0 ELSE len(string_split(reasons, ';')) END::INTEGER AS n_reasons, CASE WHEN n_high >= 6 THEN 'hard_exception' WHEN reasons <> '' THEN 'extreme_rank' END AS priority FROM q)"""


def queue(t):
    v = col("v")
    p = t.sg().groupBy("vec_id", "label").agg((F.max(v) - F.min(v)).alias("ptp"), F.greatest(F.max(v), F.lit(0.0)).alias("peak"), F.count_if(v > 0.25).alias("n_high"))
    return g.candidate_queue(p.withColumn("file", F.floor(col("vec_id") / 10)), "label", ["ptp"], [(col("n_high") >= 6, "many_high_samples")], 0.9, (col("vec_id") % 3 == 0, "peak"))


@query("g3_candidate_queue", QUEUE + " SELECT vec_id, reasons, n_reasons, priority FROM c")
def _(t):
    return queue(t).select("vec_id", "reasons", "n_reasons", "priority")


@query("g3_queue_summary", QUEUE + ", t AS (SELECT file, string_split(reasons, ';')[1] AS top, count(*) AS n FROM c WHERE n_reasons > 0 GROUP BY 1, 2) SELECT c.file, count(*) AS n_channels, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1, count(*) FILTER (n_reasons > 0) AS n_candidates, count(*) FILTER (priority = 'hard_exception') AS n_hard, any_value(top_reason) AS top_reason FROM c LEFT JOIN (SELECT file, first(top ORDER BY n DESC, top) AS top_reason FROM t GROUP BY 1) x ON x.file = c.file GROUP BY c.file")
def _(t):
    return g.queue_summary(queue(t), ["file"], "label", [0, 1])


@query("g4_rereference", f"WITH {SG} SELECT vec_id, pos, round(v - avg(CASE WHEN vec_id % 10 IN (1, 2) THEN v END) OVER (PARTITION BY label, vec_id // 10, pos), 6) AS v_reref FROM sg")
def _(t):
    sg = longest(t).withColumns({"rec": F.floor(col("vec_id") / 10), "ch": col("vec_id") % 10})
    return rounded(g.rereference(sg, ["label", "rec", "pos"], "ch", "v", [1, 2]).select("vec_id", "pos", "v_reref"))


def low_pass_sql(name: str, cutoff: float, taps: int) -> str:
    """A windowed-sinc low-pass kernel (j, h) by its formula."""
    x, half = f"{2 * cutoff / FS}", taps // 2
    return f"{name} AS (SELECT j, r / sum(r) OVER () AS h FROM (SELECT j, {x} * (CASE WHEN j = 0 THEN 1 ELSE sin(pi() * {x} * j) / (pi() * {x} * j) END) * (0.54 + 0.46 * cos(2 * pi() * j / {taps - 1})) AS r FROM (SELECT unnest(range({-half}, {half + 1})) AS j)))"


def convolved_sql(source: str, kernel: str) -> str:
    """The 64-sample signals of ``source`` under a symmetric kernel, ends mirrored."""
    return f"SELECT o.vec_id, o.pos, sum(i.v * k.h) AS v FROM {source} o, {kernel} k, {source} i WHERE i.vec_id = o.vec_id AND i.pos = CASE WHEN o.pos + k.j < 0 THEN -(o.pos + k.j) WHEN o.pos + k.j > 63 THEN 126 - o.pos - k.j ELSE o.pos + k.j END GROUP BY 1, 2"


def placed(out):
    """Samples of tiles with their numbers."""
    rows = out.select("vec_id", "start", F.posexplode("samples").alias("i", "v")).select("vec_id", (col("start") + col("i")).cast("int").alias("pos"), "v")
    return rounded(rows).withColumn("v", col("v") + F.lit(0.0))  # no negative zero


@query("g5_fir_bandpass", f"WITH {SG}, {low_pass_sql('hi', 12, 31)}, {low_pass_sql('lo', 4, 31)}, bp AS (SELECT j, hi.h - lo.h AS h FROM hi JOIN lo USING (j)), f AS ({convolved_sql('sg', 'bp')}) SELECT vec_id, pos::INTEGER AS pos, round(v, 6) + 0.0 AS v FROM f")
def _(t):
    return placed(rec.bandpass(recordings(t), ["vec_id"], 4, 12, FS, 31, tile=24))


@query("g6_rectify_smooth", f"WITH {SG}, re AS (SELECT vec_id, pos, abs(v - median(v) OVER (PARTITION BY vec_id)) AS v FROM sg), {low_pass_sql('lo', 6, 31)}, f AS ({convolved_sql('re', 'lo')}) SELECT vec_id, pos::INTEGER AS pos, round(v, 6) + 0.0 AS v FROM f")
def _(t):
    return placed(rec.rectify_smooth(recordings(t), ["vec_id"], 6, FS, 31, tile=10))


@query("g7_emg_flags", f"WITH {SG}, c AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 'a' ELSE 'b' END AS muscle, pos < 32 AS rest FROM sg), md AS (SELECT *, median(v) OVER (PARTITION BY label, vec_id, muscle, rest) AS m FROM c), act AS (SELECT label, vec_id, muscle, rest, median(abs(v - m)) * 1.4826 AS a FROM md GROUP BY ALL), df AS (SELECT label, vec_id, muscle, max(a) FILTER (NOT rest) - max(a) FILTER (rest) AS d FROM act GROUP BY ALL), th AS (SELECT label, muscle, quantile_cont(d, 0.25) FILTER (vec_id % 2 = 0) AS q FROM df GROUP BY ALL) SELECT label, vec_id, bool_and(coalesce(vec_id % 2 = 1 AND d >= q, false)) AS bad, round(max(d), 6) AS max_difference FROM df JOIN th USING (label, muscle) GROUP BY ALL")
def _(t):
    sg = longest(t).withColumns({"muscle": F.when(col("pos") % 2 == 0, "a").otherwise("b"), "epoch": F.when(col("pos") < 32, "rest").otherwise("active")})
    return rounded(g.emg_flags(sg, ["label"], "vec_id", "muscle", "epoch", "v", "active", "rest", col("vec_id") % 2 == 0))


@query("g8_epochs", f"WITH {SG}, a AS (SELECT vec_id, 10 + vec_id % 50 AS anchor FROM embeddings), r AS (SELECT a.vec_id, anchor, list(v ORDER BY pos) AS s FROM a JOIN sg ON sg.vec_id = a.vec_id AND pos BETWEEN anchor - 4 AND anchor + 5 GROUP BY 1, 2) SELECT vec_id, anchor, len(s) = 10 AS complete, round(list_sum(s), 6) AS total FROM r")
def _(t):
    anchors = t.embeddings.select("vec_id", (10 + col("vec_id") % 50).alias("anchor"))
    out = g.epochs(longest(t), anchors, ["vec_id"], "pos", "anchor", {"main": (-4, 5)}, "v")
    return rounded(out.select("vec_id", "anchor", "complete", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("g9_resample", f"WITH {SG}, {low_pass_sql('lo', 7.2, 101)}, f AS ({convolved_sql('sg', 'lo')}) SELECT vec_id, (pos // 4)::INTEGER AS pos, round(v, 6) + 0.0 AS v FROM f WHERE pos % 4 = 0")
def _(t):
    return placed(rec.resample(recordings(t), ["vec_id"], 64, 16, tile=20))


def tfr(t, freqs=(8.0, 16.0, 24.0)):
    return g.morlet_power(signals(t).select("vec_id", "label", "samples"), ["vec_id", "label"], freqs, FS, lambda f: np.full(len(f), 2.0))


#: Wavelets of two cycles in SQL: frequency, place and the real and imaginary part, of unit energy.
WAVELETS = "wv AS (SELECT f, j, half, c / sqrt(sum(e) OVER (PARTITION BY f)) AS re, s / sqrt(sum(e) OVER (PARTITION BY f)) AS im FROM (SELECT f, j, half, g * cos(2 * pi() * f * j / 64) AS c, g * sin(2 * pi() * f * j / 64) AS s, g * g AS e FROM (SELECT f, half, j, exp(-pow(j / 64.0, 2) / (2 * sd * sd)) AS g FROM (SELECT f, sd, half, unnest(range(-half, half + 1)) AS j FROM (SELECT f, sd, floor(5 * sd * 64)::BIGINT AS half FROM (SELECT f, 1 / (pi() * f) AS sd FROM (VALUES (8.0::DOUBLE), (16.0), (24.0)) v(f)))))))"


@query("g10_morlet_power", f"WITH {SG}, {WAVELETS} SELECT o.vec_id, f AS frequency, o.pos::INTEGER AS pos, round(pow(sum(i.v * re), 2) + pow(sum(i.v * im), 2), 6) AS p FROM sg o JOIN wv ON o.pos - half >= 0 AND o.pos + half <= 63 JOIN sg i ON i.vec_id = o.vec_id AND i.pos = o.pos - j GROUP BY 1, 2, 3")
def _(t):
    return rounded(tfr(t).select("vec_id", "frequency", F.posexplode("power").alias("pos", "p")).filter("p is not null and not isnan(p)"))


@query("g11_wavelet_power", f"WITH {SG}, {WAVELETS}, p AS (SELECT o.vec_id, f AS frequency, o.pos - 20 AS pos, pow(sum(i.v * re), 2) + pow(sum(i.v * im), 2) AS p FROM sg o JOIN wv ON f > 8 AND o.pos - half >= 0 AND o.pos + half <= 63 JOIN sg i ON i.vec_id = o.vec_id AND i.pos = o.pos - j WHERE o.pos BETWEEN 20 AND 43 GROUP BY 1, 2, 3), b AS (SELECT vec_id, frequency, avg(p) AS b FROM p WHERE pos BETWEEN 0 AND 4 GROUP BY 1, 2) SELECT vec_id, frequency, pos::INTEGER AS pos, round(10 * log10(p / b), 5) + 0.0 AS db FROM p JOIN b USING (vec_id, frequency)")
def _(t):
    out = g.wavelet_power(signals(t), ["vec_id"], [16.0, 24.0], FS, trim=20, baseline=(0, 4), cycles=2.0)
    return rounded(out.select("vec_id", "frequency", F.posexplode("power").alias("pos", "db")).filter("db is not null and not isnan(db)"), 5).withColumn("db", col("db") + F.lit(0.0))


@query("g12_baseline_db", f"WITH {SG}, p AS (SELECT vec_id, pos, v * v + 0.01 AS p FROM sg), b AS (SELECT vec_id, avg(p) AS b FROM p WHERE pos BETWEEN 0 AND 9 GROUP BY 1) SELECT vec_id, (pos - 20)::INTEGER AS at, round(10 * log10(p / b), 5) AS db, round(log10(p), 5) AS lp FROM p JOIN b USING (vec_id) WHERE pos BETWEEN 20 AND 29")
def _(t):
    power = signals(t).select("vec_id", F.transform("samples", lambda v: v * v + 0.01).alias("power"))
    out = g.baseline_db(power, power, ["vec_id"], 20, 29, (0, 9))
    return rounded(out.select("vec_id", F.posexplode(F.arrays_zip("power_db", "log_power")).alias("at", "r")).select("vec_id", "at", col("r.power_db").alias("db"), col("r.log_power").alias("lp")), 5)


@query("g13_artifact_flags", f"WITH {SG}, p AS (SELECT vec_id, any_value(label) AS label, max(v) - min(v) AS ptp, max(s) AS jump FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY vec_id ORDER BY pos)) AS s FROM sg) GROUP BY 1), l AS (SELECT *, log10(ptp) AS l, median(log10(ptp)) OVER (PARTITION BY label) AS md FROM p), z AS (SELECT *, median(abs(l - md)) OVER (PARTITION BY label) / 0.6744897501960817 AS d FROM l) SELECT vec_id // 3 AS trial, bool_or(ptp > 0.7) AS \"large\", bool_or(jump > 0.5) AS jumpy, bool_or(ptp < 0.4) AS flat, bool_or(abs(CASE WHEN d = 0 THEN 0 ELSE (l - md) / d END) > 2.5) AS deviant FROM z GROUP BY 1")
def _(t):
    s = signals(t).withColumn("trial", F.floor(col("vec_id") / 3))
    return g.artifact_flags(s, ["trial"], ["label"], "samples", 0.7, 0.5, 0.4, 2.5)


DEF = "(VALUES ('a', 0, 3, 0, 15), ('b', 2, 6, 16, 40)) d(feature, f_lo, f_hi, t_lo, t_hi)"


def features(t, width=None):
    d = t.spark.createDataFrame([("a", 0, 3, 0, 15), ("b", 2, 6, 16, 40)], "feature string, f_lo int, f_hi int, t_lo int, t_hi int")
    cells = longest(t).withColumns({"trial": F.floor(col("vec_id") / 10), "ch": (col("vec_id") % 10), "f": col("vec_id") % 7})
    return g.band_window_features(cells, ["trial", "ch"], d, "f", "pos", "v", width)


FEAT = f"{SG}, ft AS (SELECT vec_id // 10 AS trial, vec_id % 10 AS ch, feature, avg(v) AS value, count(*) AS n_cells FROM sg JOIN {DEF} ON vec_id % 7 BETWEEN f_lo AND f_hi AND pos BETWEEN t_lo AND t_hi GROUP BY 1, 2, 3)"


@query("g14_band_window_features_cells", f"WITH {FEAT} SELECT trial, ch, feature, round(value, 6) AS value, n_cells FROM ft")
def _(t):
    return rounded(features(t, 10.0))


@query("g14_band_window_features", f"WITH {FEAT} SELECT trial, ch, feature, round(value, 6) AS value, n_cells FROM ft")
def _(t):
    return rounded(features(t))


def rois(t):
    return t.spark.createDataFrame([("front", 0), ("front", 1), ("front", 2), ("back", 2), ("back", 7)], "roi string, ch bigint")


ROI = FEAT + ", ro AS (SELECT trial, feature, roi, avg(value) AS value, count(DISTINCT ch) AS n_channels FROM ft JOIN (VALUES ('front', 0), ('front', 1), ('front', 2), ('back', 2), ('back', 7)) r(roi, ch) USING (ch) GROUP BY 1, 2, 3)"


@query("g15_roi_means", f"WITH {ROI} SELECT trial, feature, roi, round(value, 6) AS value, n_channels FROM ro")
def _(t):
    return rounded(g.roi_means(features(t), ["trial", "feature"], "ch", "value", rois(t)))


@query("g16_roi_check", f"WITH {ROI} SELECT count(*) AS n, 0.0::DOUBLE AS max_difference, 0::BIGINT AS n_unmatched FROM ro")
def _(t):
    stored = g.roi_means(features(t), ["trial", "feature"], "ch", "value", rois(t))
    return rounded(g.roi_check(features(t), stored, ["trial", "feature"], "ch", "value", rois(t)))


@query("g17_map_task_hand", "SELECT c_custkey, CASE WHEN c_custkey % 100 = 0 THEN 'both' WHEN c_nationkey = 1 THEN 'left' WHEN c_nationkey = 2 THEN 'right' END AS hand, CASE WHEN c_custkey % 100 = 0 THEN 'override' WHEN c_nationkey IN (1, 2) THEN 'code' END AS hand_source FROM customer")
def _(t):
    codes = t.spark.createDataFrame([(1, "left"), (2, "right")], "c_nationkey int, hand string")
    overrides = t.customer.filter("c_custkey % 100 = 0").select("c_custkey", F.lit("both").alias("hand"))
    return g.map_task_hand(t.customer, codes, overrides, ["c_custkey"], "c_nationkey").select("c_custkey", "hand", "hand_source")


@query("g18_link_trials", "SELECT o_orderkey, c_custkey IS NOT NULL AS linked, o_totalprice < 20000 AS short_duration FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def _(t):
    return g.link_trials(t.orders, t.customer.filter("c_acctbal > 0").select("c_custkey"), {"o_custkey": "c_custkey"}, "o_totalprice", 20000).select("o_orderkey", "linked", "short_duration")


@query("g19_band_power", f"WITH {SG}, b AS (SELECT vec_id, CASE WHEN pos BETWEEN 4 AND 7 THEN 'theta' WHEN pos BETWEEN 8 AND 12 THEN 'alpha' END AS band, v * v AS p FROM sg) SELECT vec_id, band, round(avg(p), 6) AS power FROM b WHERE band IS NOT NULL GROUP BY 1, 2")
def _(t):
    return rounded(g.band_power(longest(t).withColumn("p", col("v") * col("v")), ["vec_id"], "pos", "p", [("theta", 4, 7), ("alpha", 8, 12)]))


@query("g20_prepare_model_rows", "WITH x AS (SELECT o_orderkey, o_custkey % 3 AS ch, o_orderkey + 1 AS trial, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS s FROM orders), y AS (SELECT o_orderkey, trial, s * CASE ch WHEN 0 THEN 0.6 WHEN 1 THEN 0.0 ELSE 0.8 END AS x, CASE ch WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE 0.6 END AS y, CASE ch WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 ELSE 0.0 END AS z FROM x) SELECT o_orderkey, round(degrees(asin(z)), 1) + 0.0 AS lat, CASE WHEN abs(round(degrees(asin(z)), 1)) >= 90 THEN 0.0 ELSE round(degrees(atan2(y, x)), 1) END AS lon, (trial - 1) // 20 + 1 AS block FROM y")
def _(t):
    coords = t.spark.createDataFrame([(0, 0.6, 0.0, 0.8), (1, 0.0, 0.0, 1.0), (2, 0.8, 0.6, 0.0)], "ch bigint, x double, y double, z double")
    rows = t.orders.select("o_orderkey", (col("o_custkey") % 3).alias("ch"), (col("o_orderkey") + 1).alias("trial"), F.when(col("o_orderstatus") == "F", "left").otherwise("right").alias("hand"))
    return g.prepare_model_rows(rows, coords, "ch", "hand", "trial").select("o_orderkey", "lat", "lon", "block")


@query("g21_tf_means", f"WITH {SG}, u AS (SELECT vec_id AS unit, label, pos // 16 AS cell, avg(v) AS m FROM sg GROUP BY 1, 2, 3), a AS (SELECT * FROM u UNION ALL SELECT 0, label, cell, avg(m) FROM u GROUP BY 2, 3) SELECT unit, label, cell, round(m, 6) AS mean, round(min(m) OVER (PARTITION BY label), 6) AS lo, round(max(m) OVER (PARTITION BY label), 6) AS hi FROM a")
def _(t):
    cells = longest(t).withColumns({"unit": col("vec_id"), "cell": F.floor(col("pos") / 16)})
    return rounded(g.tf_means(cells, "unit", ["label"], ["cell"], "v").select("unit", "label", "cell", "mean", "lo", "hi"))


@query("g22_atlas_means", f"WITH {SG}, a AS (SELECT vec_id % 4 AS condition, pos, avg(v) AS m FROM sg GROUP BY 1, 2) SELECT condition, list(round(m, 6) ORDER BY pos) AS mean, count(*) FILTER (m < -0.02 OR m > 0.02)::INTEGER AS n_outside, round(count(*) FILTER (m < -0.02 OR m > 0.02) * 100.0 / count(*), 6) AS percent_saturated FROM a GROUP BY 1")
def _(t):
    lineage = t.embeddings.select("vec_id", (col("vec_id") % 4).alias("condition"))
    out = g.atlas_means(signals(t), lineage, ["vec_id"], "condition", "samples", -0.02, 0.02)
    return rounded(out).withColumn("mean", F.transform("mean", lambda x: F.round(x, 6)))


NOTCHED = f"{SG}, {low_pass_sql('hi', 22, 31)}, {low_pass_sql('lo', 18, 31)}, bp AS (SELECT j, hi.h - lo.h AS h FROM hi JOIN lo USING (j)), f AS ({convolved_sql('sg', 'bp')}), nt AS (SELECT label, vec_id, pos, sg.v AS a, sg.v - f.v AS b FROM sg JOIN f USING (vec_id, pos)), nb AS (SELECT vec_id, pos, b AS v FROM nt)"
CHANGES = f"pa AS (SELECT vec_id, {band_sql(2, 8)} AS low, {band_sql(18, 22)} AS line FROM ({psd_sql('sg', HALVES, 32)}) GROUP BY 1), pb AS (SELECT vec_id, {band_sql(2, 8)} AS low, {band_sql(18, 22)} AS line FROM ({psd_sql('nb', HALVES, 32)}) GROUP BY 1), cm AS (SELECT label, vec_id, count(*) AS n, sqrt(avg(a * a)) AS rms_a, sqrt(avg(b * b)) AS rms_b, sqrt(avg(pow(a - b, 2))) AS rms_difference, corr(a, b) AS correlation FROM nt GROUP BY 1, 2), cb AS (SELECT cm.*, pb.low / pa.low - 1 AS change_low, pb.line / pa.line - 1 AS change_line FROM cm JOIN pa USING (vec_id) JOIN pb USING (vec_id))"
FIGURES = ", ".join(f"round({c}, 5) AS {c}" for c in ("rms_a", "rms_b", "rms_difference", "correlation", "change_low", "change_line"))


def branches(t):
    """The channels and their notched branch, compared per label (a file) and channel."""
    own = recordings(t).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return rec.compare_branches(own, rec.notch(own, ["label", "vec_id"], 20.0, FS, taps=31, tile=24), ["label", "vec_id"], FS, 32, {"low": (2, 8), "line": (18, 22)}, tile=20)


@query("g23_compare_branches", f"WITH {NOTCHED}, {CHANGES} SELECT label, vec_id, n, {FIGURES} FROM cb")
def _(t):
    return rounded(branches(t), 5)


@query("g23_branch_summary", f"WITH {NOTCHED}, {CHANGES} SELECT label, count(*) AS n_channels, round(sqrt(sum(rms_a * rms_a * n) / sum(n)), 5) AS rms_a, round(sqrt(sum(rms_b * rms_b * n) / sum(n)), 5) AS rms_b, round(sqrt(sum(rms_difference * rms_difference * n) / sum(n)), 5) AS rms_difference, round(median(correlation), 5) AS median_correlation, count(*) FILTER (correlation < 0.95) AS n_low_correlation, round(avg(change_low), 5) AS change_low, round(avg(change_line), 5) AS change_line, round(sqrt(sum(rms_difference * rms_difference * n) / sum(rms_a * rms_a * n)), 5) AS difference_share FROM cb GROUP BY 1")
def _(t):
    return rounded(rec.branch_summary(branches(t), ["label"], ["low", "line"], 0.95), 5)


def _(t):
    s = signals(t)
    return rounded(g.compare_branches(s, g.notch(s, ["vec_id"], 20.0, FS, taps=31), ["vec_id"], FS, 32, {"low": (2, 8), "line": (18, 22)}))


@query("g24_feature_ranges", "SELECT l_returnflag, min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max, round(avg(l_tax), 6) AS l_tax_mean, round(avg(l_discount), 6) AS l_discount_mean, round(corr(l_tax, l_discount), 6) AS r FROM lineitem GROUP BY 1")
def _(t):
    return rounded(g.feature_ranges(t.lineitem, ["l_returnflag"], "l_tax", "l_discount"))


WINDOWS = "(VALUES (1, 5, 44), (2, 30, 63)) w(\"window\", lo, hi)"
INSIDE = f"iw AS (SELECT sg.*, \"window\" FROM sg JOIN {WINDOWS} ON pos BETWEEN lo AND hi), am AS (SELECT label, \"window\", count(DISTINCT vec_id) AS n_channels, count(*) AS n, avg(v) AS mean, var_pop(v) AS variance, min(v) AS min, max(v) AS max, max(v) - min(v) AS ptp, sqrt(avg(v * v)) AS rms FROM iw GROUP BY 1, 2)"
SEGMENTS = f"(SELECT vec_id, \"window\", lo + 8 * j AS o FROM embeddings, {WINDOWS}, range(8) r(j) WHERE lo + 8 * j + 15 <= hi)"
DENSITIES = f"ds AS (SELECT label, \"window\", {band_sql(2, 8)} AS low, {band_sql(8, 30)} AS high FROM ({psd_sql('sg', SEGMENTS, 16, 'label, \"window\"')}) GROUP BY 1, 2)"


@query("g25_sampled_qc", f"WITH {SG}, {INSIDE}, {DENSITIES} SELECT label, \"window\", n_channels, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "variance", "min", "max", "ptp", "rms", "low", "high")) + " FROM am JOIN ds USING (label, \"window\")")
def _(t):
    windows = t.embeddings.select("label").distinct().withColumn("w", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("window", "lo", "hi"), w, strict=True)]) for w in ((1, 5, 44), (2, 30, 63))]))).select("label", "w.*")
    own = recordings(t).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return rounded(rec.sampled_qc(own, windows, ["vec_id"], ["label"], ["label"], FS, 16, {"low": (2, 8), "high": (8, 30)}, tile=24))


def _(t):
    windows = t.spark.createDataFrame([(1, 0, 15), (2, 30, 49)], "window int, lo int, hi int")
    return rounded(g.sampled_qc(longest(t), windows, ["vec_id"], "pos", "v"))


@query("g26_coordinate_coverage", "SELECT user_id, count(*) AS n_channels, count(*) FILTER (event_type IN ('view', 'click')) AS n_matched, coalesce(string_agg(DISTINCT upper(event_type), ';' ORDER BY upper(event_type)) FILTER (event_type NOT IN ('view', 'click')), '') AS unmatched FROM events GROUP BY 1")
def _(t):
    coords = t.spark.createDataFrame([(" View",), ("CLICK ",)], "event_type string")
    return g.coordinate_coverage(t.events, coords, ["user_id"], "event_type")


# ---- models


@query("m1_trial_predictors", "WITH m AS (SELECT *, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_custkey) AS mu FROM orders) SELECT o_orderkey, round(o_totalprice - mu, 0) AS o_totalprice_within, CASE WHEN o_orderstatus = 'F' AND o_custkey > 0 THEN round(ln(o_custkey), 6) END AS log_error, CASE o_orderpriority WHEN '1-URGENT' THEN -0.5 WHEN '5-LOW' THEN 0.5 END::DOUBLE AS o_orderpriority_code, CASE WHEN o_orderstatus <> 'F' THEN 'out_of_scope' WHEN o_custkey > 0 THEN 'valid' ELSE 'not_positive' END AS error_status FROM m")
def _(t):
    out = m.trial_predictors(t.orders, ["o_custkey"], "o_totalprice", "o_custkey", col("o_orderstatus") == "F", {"o_orderpriority": {"1-URGENT": -0.5, "5-LOW": 0.5}})
    return out.select("o_orderkey", F.round("o_totalprice_within", 0).alias("o_totalprice_within"), F.round("log_error", 6).alias("log_error"), "o_orderpriority_code", "error_status")


ROLES = "(VALUES ('F', 'N', 'lead'), ('O', 'R', 'follow'), ('F', 'N', 'check')) r(linestatus, flag, role)"


@query("m2_general_table", "SELECT l_orderkey, role, count(*) AS n FROM lineitem JOIN (VALUES ('F', 'N', 'lead'), ('O', 'R', 'follow'), ('F', 'N', 'check')) r(l_linestatus, l_returnflag, role) USING (l_linestatus, l_returnflag) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def _(t):
    roles = t.spark.createDataFrame([("F", "N", "lead"), ("O", "R", "follow"), ("F", "N", "check")], "l_linestatus string, l_returnflag string, role string")
    out = m.general_table(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), t.lineitem, roles, ["l_orderkey"], ["l_linestatus", "l_returnflag"])
    return out.groupBy("l_orderkey", "role").agg(F.count("row_key").alias("n"))


@query("m3_add_eligibility", "SELECT o_orderkey, o_totalprice >= 5000 AND o_orderstatus <> 'P' AS eligible, concat_ws(';', CASE WHEN o_totalprice < 5000 THEN 'small' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END) AS exclusion_reasons, CASE WHEN o_totalprice >= 5000 AND o_orderstatus <> 'P' THEN 'included' ELSE 'excluded' END AS inclusion FROM orders")
def _(t):
    return m.add_eligibility(t.orders, [(col("o_totalprice") < 5000, "small"), (col("o_orderstatus") == "P", "pending")]).select("o_orderkey", "eligible", "exclusion_reasons", "inclusion")


@query("m4_model_views", "SELECT 'final' AS surface, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 'urgent', count(*) FILTER (o_orderpriority = '1-URGENT') FROM orders")
def _(t):
    return m.model_views(t.orders, {"final": col("o_orderstatus") == "F", "urgent": col("o_orderpriority") == "1-URGENT"})[1]


@query("m5_design_rank", "SELECT 3 AS rank, 4 AS columns")
def _(t):
    rank, n = m.design_rank(t.lineitem, {"q": col("l_quantity"), "d": col("l_discount"), "both": col("l_quantity") * 2 + col("l_discount")})
    return t.lineitem.agg(F.lit(rank).alias("rank"), F.lit(n).alias("columns"))


@query("m6_value_identity", "SELECT 'o_totalprice' AS \"column\", count(*) AS n_compared, count(*) FILTER (o_orderkey % 11 = 0) AS n_different FROM orders")
def _(t):
    return m.value_identity(t.orders, t.orders.withColumn("o_totalprice", F.when(col("o_orderkey") % 11 != 0, col("o_totalprice"))), ["o_orderkey"], ["o_totalprice"])


@query("m7_pooled_scale", "WITH x AS (SELECT *, (SELECT median(o_totalprice) FROM orders) AS md FROM orders) SELECT round(max(md), 4) AS median, round(median(abs(o_totalprice - md)) * 1.4826, 4) AS mad FROM x")
def _(t):
    return rounded(m.pooled_scale(t.orders, "o_totalprice"), 4)


@query("m8_quantile_bins", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.2) AS a, quantile_cont(o_totalprice, 0.8) AS b FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 'low' ELSE 'high' END AS bin, round(a, 4) AS cut_low, round(b, 4) AS cut_high FROM orders, q WHERE o_totalprice <= a OR o_totalprice >= b")
def _(t):
    return rounded(m.quantile_bins(t.orders, "o_totalprice").select("o_orderkey", "bin", "cut_low", "cut_high"), 4)


@query("m9_cell_factor", "SELECT o_orderkey, o_orderstatus || '.' || o_orderpriority AS cell FROM orders")
def _(t):
    return t.orders.select("o_orderkey", m.cell_factor(["o_orderstatus", "o_orderpriority"]).alias("cell"))


@query("m10_effect_maps", "WITH u AS (SELECT o_custkey, c_mktsegment, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O') AS d FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) SELECT c_mktsegment, count(d) AS n, round(avg(d), 2) AS mean, round(stddev_samp(d), 2) AS sd, round(stddev_samp(d) / sqrt(count(d)), 2) AS se, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 4) AS t FROM u GROUP BY 1")
def _(t):
    joined = t.orders.join(t.customer, col("o_custkey") == col("c_custkey"))
    out = m.effect_maps(joined, "o_custkey", ["c_mktsegment"], "o_orderstatus", "F", "O", "o_totalprice")
    return out.select("c_mktsegment", "n", *[F.round(x, 2).alias(x) for x in ("mean", "sd", "se")], F.round("t", 4).alias("t"))


#: Three differences, a double contrast, a mean of two conditions and a raw map, over an order's status and priority.
URGENT, LOW = "1-URGENT", "5-LOW"
MAPS = {
    "status": [({"o_orderstatus": "F", "o_orderpriority": URGENT}, 1.0), ({"o_orderstatus": "O", "o_orderpriority": URGENT}, -1.0)],
    "priority": [({"o_orderstatus": "F", "o_orderpriority": URGENT}, 1.0), ({"o_orderstatus": "F", "o_orderpriority": LOW}, -1.0)],
    "double": [({"o_orderstatus": s, "o_orderpriority": p}, a * b) for s, a in (("F", 1.0), ("O", -1.0)) for p, b in ((URGENT, 0.5), (LOW, 0.5))],
    "raw": [({"o_orderstatus": "O", "o_orderpriority": LOW}, 1.0)],
}
CELL = lambda s, p: f"avg(o_totalprice) FILTER (o_orderstatus = '{s}' AND o_orderpriority = '{p}')"
MAP_SQL = " UNION ALL ".join(f"SELECT '{name}' AS map, c_nationkey, " + " + ".join(f"{w} * {CELL(c['o_orderstatus'], c['o_orderpriority'])}" for c, w in cells) + " AS e, c_mktsegment FROM j GROUP BY c_nationkey, c_mktsegment" for name, cells in MAPS.items())


@query("m10_contrast_maps", f"WITH j AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey), u AS ({MAP_SQL}) SELECT map, c_mktsegment, count(e) AS n, round(avg(e), 0) AS mean, round(stddev_samp(e), 0) AS sd, round(stddev_samp(e) / sqrt(count(e)), 0) AS se, round(CASE WHEN stddev_samp(e) > 0 THEN avg(e) / (stddev_samp(e) / sqrt(count(e))) WHEN stddev_samp(e) = 0 THEN 0 END, 4) AS t FROM u WHERE e IS NOT NULL GROUP BY 1, 2")
def _(t):
    joined = t.orders.join(t.customer, col("o_custkey") == col("c_custkey"))
    out = m.contrast_maps(joined, m.map_spec(t.spark, MAPS), "c_nationkey", ["c_mktsegment"], "o_totalprice")
    return out.select("map", "c_mktsegment", "n", *[F.round(x, 0).alias(x) for x in ("mean", "sd", "se")], F.round("t", 4).alias("t"))


#: Draws in SQL: a vector is a draw, its values are terms.
DRAWS = SG + ", dr AS (SELECT vec_id AS sample, 't' || pos AS term, v AS value FROM sg)"
TERMS = 64


def term_draws(t):
    return longest(t).select(col("vec_id").alias("sample"), F.concat(F.lit("t"), col("pos").cast("string")).alias("term"), col("v").alias("value"))


def registry(t):
    return t.spark.createDataFrame([*(("sum", f"t{k}", 1.0) for k in range(TERMS)), ("diff", "t2", 1.0), ("diff", "t3", -1.0)], "estimand string, term string, weight double")


REG = f"(SELECT 'sum' AS estimand, 't' || i AS term, 1.0 AS weight FROM range({TERMS}) x(i) UNION ALL VALUES ('diff', 't2', 1.0), ('diff', 't3', -1.0)) r"


@query("m11_estimands", f"WITH {DRAWS} SELECT sample, estimand, round(sum(weight * value), 6) AS value FROM dr JOIN {REG} USING (term) GROUP BY 1, 2")
def _(t):
    return rounded(m.estimands(term_draws(t), registry(t)))


@query("m12_estimand_routes", f"WITH {DRAWS} SELECT count(*) AS n, 0.0::DOUBLE AS max_difference, 0::BIGINT AS n_unmatched FROM (SELECT DISTINCT sample, estimand FROM dr, (VALUES ('sum'), ('diff')) r(estimand))")
def _(t):
    d = term_draws(t)
    wide = signals(t).select(col("vec_id").alias("sample"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("sum"), (col("samples")[2] - col("samples")[3]).alias("diff"))
    other = wide.select("sample", F.explode(F.array(*[F.struct(F.lit(e).alias("estimand"), col(e).alias("value")) for e in ("sum", "diff")])).alias("r")).select("sample", "r.*")
    return rounded(m.estimand_routes(m.estimands(d, registry(t)), other, ["sample", "estimand"]))


@query("m13_draw_summary", f"WITH {DRAWS}, s AS (SELECT term, quantile_cont(value, 0.025) FILTER (sample > 0) AS lo, max(value) FILTER (sample = 0) AS point, quantile_cont(value, 0.975) FILTER (sample > 0) AS hi FROM dr GROUP BY 1) SELECT term, round(lo, 6) AS lo, round(point, 6) AS point, round(hi, 6) AS hi, 0.1 BETWEEN lo AND hi AS covered FROM s")
def _(t):
    truth = t.spark.createDataFrame([(f"t{k}", 0.1) for k in range(TERMS)], "term string, truth double")
    return rounded(m.draw_summary(term_draws(t), truth, ["term"]).drop("truth"))


@query("m14_max_t", f"WITH {SG}, mx AS (SELECT vec_id, max(abs(v)) AS mx FROM sg GROUP BY 1), ob AS (SELECT o_orderkey, o_totalprice / 1000000 AS t FROM orders) SELECT o_orderkey, t, round((SELECT quantile_cont(mx, 0.95) FROM mx), 6) AS threshold, round((SELECT count(*) FROM mx WHERE mx >= abs(t)) / (SELECT count(*) FROM mx), 6) AS p_fwe, abs(t) >= (SELECT quantile_cont(mx, 0.95) FROM mx) AS significant FROM ob")
def _(t):
    draws = longest(t).select(col("vec_id").alias("draw"), col("v").alias("t"))
    observed = t.orders.select("o_orderkey", (col("o_totalprice") / 1000000).alias("t"))
    out = m.max_t(draws, observed)
    return out.select("o_orderkey", "t", F.round("threshold", 6).alias("threshold"), F.round("p_fwe", 6).alias("p_fwe"), "significant")


@query("m15_null_draws")
def _(t):
    rows = t.embeddings.select(*[F.get("embedding", F.lit(k)).cast("double").alias(f"v{k}") for k in range(3)])
    pairs = [(i, j) for i in range(3) for j in range(3)]
    r = rows.agg(*[F.corr(f"v{i}", f"v{j}").alias(f"c{i}{j}") for i, j in pairs], F.count(F.lit(1)).alias("n")).first()
    return rounded(m.null_draws(t.spark, np.array([[r[f"c{i}{j}"] for j in range(3)] for i in range(3)]) + 1e-9 * np.eye(3), r["n"], 20.0, 5))


PLACES = 6


def contrast_tests(t):
    """All differences of the first places of the vectors as tests, with the vectors' covariance as that of the terms."""
    pairs = [(i, j) for i in range(PLACES) for j in range(i + 1)]
    x = lambda k: F.get("embedding", F.lit(k)).cast("double")
    found = t.embeddings.agg(*[F.covar_pop(x(i), x(j)).alias(f"c{i}_{j}") for i, j in pairs], F.count(F.lit(1)).alias("n")).first()
    v = np.array([[found[f"c{max(i, j)}_{min(i, j)}"] for j in range(PLACES)] for i in range(PLACES)])
    weights = [(f"{i}-{j}", f"v{k}", w) for i, j in pairs if i != j for k, w in ((i, 1.0), (j, -1.0))]
    return m.contrast_factors(t.spark.createDataFrame(weights, "test string, term string, weight double"), [f"v{k}" for k in range(PLACES)], v), found["n"]


DIFFERENCES = f"pl AS (SELECT a.vec_id, a.pos || '-' || b.pos AS test, a.v - b.v AS d FROM sg a JOIN sg b ON a.vec_id = b.vec_id AND b.pos < a.pos AND a.pos < {PLACES})"


@query("m15_draw_moments", f"WITH {SG}, {DIFFERENCES} SELECT test, 4 * count(*) AS n, round(stddev_pop(d), 6) AS se, true AS mean_is_0, true AS variance_is_1 FROM pl GROUP BY 1")
def _(t):
    factors, n = contrast_tests(t)
    out = m.draw_moments(factors, 4 * n, None, 5)
    bound = 5 / F.sqrt(col("n"))
    return rounded(out.select("test", "n", "se", (F.abs("mean") < bound).alias("mean_is_0"), (F.abs(col("variance") - 1) < bound * F.sqrt(F.lit(2.0))).alias("variance_is_1")))


@query("m15_null_maxima")
def _(t):
    """Observed mean differences against the null of largest values."""
    factors, n = contrast_tests(t)
    observed = t.sg().filter(col("pos") < PLACES).groupBy(col("pos").alias("test")).agg((F.avg("v") / F.stddev_pop("v") * F.sqrt(F.count(F.lit(1)))).alias("t"))
    return rounded(m.max_t(m.null_maxima(factors, n, 20.0, 5), observed))


@query("m16_results_table", f"WITH {SG}, r AS (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, pos) AS n, abs(v) > 0.2 AS s FROM sg) SELECT vec_id, count(*) AS n_tests, count(*) FILTER (s) AS n_significant, round(count(*) FILTER (s) / count(*), 6) AS share_significant, max(pos) FILTER (n = 1) AS top1, max(pos) FILTER (n = 2) AS top2, max(pos) FILTER (n = 3) AS top3 FROM r GROUP BY 1")
def _(t):
    return rounded(m.results_table(longest(t).withColumn("s", F.abs("v") > 0.2), ["vec_id"], "pos", "v", "s"))


TOP3 = ", ".join(f"max(pos || ' (c=' || printf('%.3f', v) || ', t=' || printf('%.2f', t) || ')') FILTER (n3 = {n}) AS top{n}" for n in (1, 2, 3))


@query("m16_results_summary", f"WITH {SG}, e AS (SELECT vec_id, pos, v, v * 10 AS t, abs(v) > 0.2 AS s, CASE WHEN pos < 28 THEN 'L' WHEN pos < 36 THEN 'M' ELSE 'R' END AS hemi FROM sg), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, pos) AS n1, row_number() OVER (PARTITION BY vec_id ORDER BY abs(t) DESC, pos || ' (c=' || printf('%.3f', v) || ', t=' || printf('%.2f', t) || ')') AS n3 FROM e), lt AS (SELECT l.vec_id, avg(l.v - x.v) AS m, stddev_samp(l.v - x.v) AS sd FROM sg l JOIN sg x ON l.vec_id = x.vec_id AND x.pos = 63 - l.pos WHERE l.pos < 28 GROUP BY 1) SELECT r.vec_id, count(*) AS n_tests, count(*) FILTER (s) AS n_significant, round(count(*) FILTER (s) / count(*), 6) AS share_significant, max(pos) FILTER (n1 = 1) AS peak_channel, round(max(v) FILTER (n1 = 1), 6) AS peak_effect, round(max(t) FILTER (n1 = 1), 6) AS peak_t, count(*) FILTER (s AND hemi = 'L') AS n_left, count(*) FILTER (s AND hemi = 'M') AS n_mid, count(*) FILTER (s AND hemi = 'R') AS n_right, count(*) FILTER (abs(t) >= 2.0) AS n_beyond_cut, round(any_value(m), 6) AS mean_left_less_right, round(any_value(sd), 6) AS sd_left_less_right, {TOP3} FROM r JOIN lt USING (vec_id) GROUP BY 1")
def _(t):
    pairs = t.spark.createDataFrame([(k, 63 - k) for k in range(28)], "left_ch bigint, right_ch bigint")
    hemi = t.spark.createDataFrame([(k, "L" if k < 28 else "M" if k < 36 else "R") for k in range(64)], "pos bigint, hemi string")
    effects = longest(t).select("vec_id", "pos", "v", (col("v") * 10).alias("t"), (F.abs("v") > 0.2).alias("s"))
    return rounded(m.results_summary(effects, ["vec_id"], "pos", "v", "t", "s", pairs, hemi))


@query("m17_draw_contrasts", f"WITH {DRAWS}, c AS (SELECT sample % 3 AS grp, sample, max(value) FILTER (term = 't0') - max(value) FILTER (term = 't1') AS value FROM dr GROUP BY 1, 2), s AS (SELECT grp, quantile_cont(value, 0.4) FILTER (sample > 0) AS lo, max(value) FILTER (sample = 0) AS point, quantile_cont(value, 0.6) FILTER (sample > 0) AS hi FROM c GROUP BY 1) SELECT grp, round(lo, 6) AS lo, round(point, 6) AS point, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS credible FROM s")
def _(t):
    d = term_draws(t).withColumn("grp", col("sample") % 3)
    return rounded(m.draw_contrasts(d, ["grp"], "term", "t0", "t1", 0.2))


# ---- scans


@query("sc4_read_table", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return io.read_table(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"])


#: The rows as JSON, as both engines write them; orders have no null.
ORDER_JSON = "'{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}'"


@query("f37_table_fingerprint", f"WITH n AS (SELECT sha256({ORDER_JSON}) AS h, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), b AS (SELECT i // 4096 AS b, count(*) AS c, sha256(string_agg(h, '' ORDER BY i)) AS d FROM n GROUP BY 1) SELECT sum(c)::BIGINT AS n, sha256(string_agg(d, '' ORDER BY b)) AS fingerprint FROM b")
def _(t):
    from ..operators.fingerprint import table_fingerprint

    return table_fingerprint(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"])
