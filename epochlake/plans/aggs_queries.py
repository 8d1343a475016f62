"""Queries of aggregates and reshaping (groups A and U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs as a
from ..operators import shape as u
from .base import EV, SG, SM, query, rounded

col = F.col
TYPES = ["click", "error", "purchase", "signup", "view"]
#: Draws in SQL: one vector is one draw of a condition; the vector of the least id is the point estimate.
DR = "dr AS (SELECT label AS cond, embedding[1]::DOUBLE AS value, vec_id % 2 AS side, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS sample FROM embeddings)"


def draws(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("label", col("vec_id") % 2).orderBy("vec_id")) - 1
    return t.embeddings.select(col("label").alias("cond"), F.get("embedding", F.lit(0)).cast("double").alias("value"), (col("vec_id") % 2).alias("side"), n.alias("sample"))


@query("a1_summary", f"WITH {EV} SELECT event_type, round(sum(value), 3) AS sum, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max, count(value) AS n FROM ev GROUP BY 1")
def _(t):
    return t.ev().groupBy("event_type").agg(*a.summary("value")).withColumns({"sum": F.round("sum", 3), "mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("a2_paired_sd", "SELECT user_id, CASE WHEN count(value) > 1 THEN round(sqrt(sum(value * value) / (count(value) - 1)), 6) END AS psd FROM events GROUP BY 1")
def _(t):
    return rounded(t.events.groupBy("user_id").agg(a.paired_sd(col("value")).alias("psd")))


@query("a3_trace_shape", f"WITH {SM} SELECT trial, round(greatest(max(x) - min(x), max(y) - min(y)), 6) AS size, round(((min(x) - 50) / nullif(max(x) - min(x), 0) + 0.5) * 2, 6) AS shift FROM sm GROUP BY 1")
def _(t):
    return rounded(a.trace_shape(t.sm(), ["trial"], middle=50.0))


@query("a4_path_length", f"WITH {SM}, l AS (SELECT trial, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM sm WINDOW w AS (PARTITION BY trial ORDER BY time, o)) SELECT trial, round(sum(sqrt(dx * dx + dy * dy)), 4) AS path_length FROM l GROUP BY 1")
def _(t):
    return rounded(a.path_length(t.sm(), ["trial"], ["time", "o"]), 4)


@query("a5_count_where", "SELECT o_custkey, count(*) FILTER (o_totalprice > 200000) AS n_big, round(avg((o_totalprice > 200000)::INTEGER), 6) AS share_big FROM orders GROUP BY 1")
def _(t):
    return rounded(t.orders.groupBy("o_custkey").agg(*a.count_where({"big": col("o_totalprice") > 200000})))


@query("a6_any_all", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_totalprice > 1000) AS all_big FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(a.any_flag(col("o_orderstatus") == "F").alias("any_f"), a.all_flag(col("o_totalprice") > 1000).alias("all_big"))


@query("a7_a8_a9_by_order", f"WITH {EV} SELECT user_id, arg_min(k, onset) AS first, arg_max(k, onset) AS last, arg_min(k, onset) FILTER (event_type = 'view') AS first_view, arg_min(CASE WHEN event_type = 'error' THEN k END, onset) AS first_value FROM ev GROUP BY 1")
def _(t):
    ev = t.ev().withColumn("e", F.when(col("event_type") == "error", col("k")))
    return ev.groupBy("user_id").agg(a.first_by("k", "onset").alias("first"), a.last_by("k", "onset").alias("last"), a.first_where("k", col("event_type") == "view", "onset").alias("first_view"), a.first_nonmissing("e", "onset").alias("first_value"))


@query("a10_quantiles", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.9), 4) AS q90 FROM orders GROUP BY 1")
def _(t):
    return rounded(a.quantiles(t.orders, ["o_orderstatus"], "o_totalprice", [0.25, 0.5, 0.9]), 4)


@query("a11_mad", "WITH m AS (SELECT *, median(value) OVER (PARTITION BY user_id) AS m FROM events) SELECT user_id, round(max(m), 6) AS median, round(median(abs(value - m)) * 1.4826, 6) AS mad FROM m GROUP BY 1")
def _(t):
    return rounded(a.mad(t.events, ["user_id"], "value", 1.4826))


@query("a12_robust_log_z", f"WITH {SG}, p AS (SELECT vec_id, label, max(v) - min(v) AS ptp FROM sg GROUP BY 1, 2), l AS (SELECT *, log10(ptp) AS l FROM p), m AS (SELECT *, median(l) OVER (PARTITION BY label) AS m FROM l), d AS (SELECT *, median(abs(l - m)) OVER (PARTITION BY label) / 0.6744897501960817 AS d FROM m) SELECT vec_id, CASE WHEN d = 0 THEN 0.0 ELSE round((l - m) / d, 5) END AS robust_z FROM d")
def _(t):
    p = t.sg().groupBy("vec_id", "label").agg((F.max("v") - F.min("v")).alias("ptp"))
    return rounded(a.robust_log_z(p, ["label"], "ptp").select("vec_id", "robust_z"), 5)


@query("a13_collect_sorted", "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS types FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(a.collect_sorted("event_type").alias("types"))


@query("a14_union_codes", "SELECT user_id, string_agg(DISTINCT c, ';' ORDER BY c) AS codes FROM (SELECT user_id, unnest([event_type, CASE WHEN value > 10 THEN 'high' END]) AS c FROM events) GROUP BY 1")
def _(t):
    lists = t.events.select("user_id", F.concat_ws(";", "event_type", F.when(col("value") > 10, "high")).alias("codes"))
    return a.union_codes(lists, ["user_id"], "codes")


@query("a15_n_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(a.n_distinct("l_partkey").alias("parts"), a.n_distinct("l_partkey", "l_suppkey").alias("pairs"))


@query("a16_pivot_events", f"WITH {EV} SELECT user_id, count(*) FILTER (event_type = 'view') AS view_count, min(onset) FILTER (event_type = 'view') AS view_onset, count(*) FILTER (event_type = 'error') AS error_count, min(onset) FILTER (event_type = 'error') AS error_onset FROM ev GROUP BY 1")
def _(t):
    return a.pivot_events(t.ev(), ["user_id"], "event_type", "onset", ["view", "error"])


@query("a17_expected_members", "WITH c AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_custkey, array_to_string(list_sort(list_filter(['F', 'O', 'X'], lambda x: NOT list_contains(list(s), x))), ';') AS missing, coalesce(string_agg(s, ';' ORDER BY s) FILTER (n > 1 OR s NOT IN ('F', 'O', 'X')), '') AS extra FROM c GROUP BY 1")
def _(t):
    return a.expected_members(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "X"])


@query("a18_event_span", f"WITH {EV} SELECT user_id, round(min(onset) FILTER (event_type = 'error') - min(onset) FILTER (event_type = 'view'), 6) AS span FROM ev GROUP BY 1")
def _(t):
    return rounded(a.event_span(t.ev(), ["user_id"], "event_type", "onset", "view", "error"))


@query("a19_value_counts", "SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def _(t):
    return a.value_counts(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("a20_multi_dim_counts", "SELECT 'l_returnflag' AS dimension, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2")
def _(t):
    return a.multi_dim_counts(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("a21_status_counts", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_final, count(*) FILTER (o_totalprice > 250000) AS n_big FROM orders GROUP BY 1")
def _(t):
    return a.status_counts(t.orders, ["o_orderpriority"], {"final": col("o_orderstatus") == "F", "big": col("o_totalprice") > 250000})


@query("a22_surface_counts", "SELECT 'final' AS surface, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 'big', count(*) FILTER (o_totalprice > 250000) FROM orders")
def _(t):
    return a.surface_counts(t.orders, {"final": col("o_orderstatus") == "F", "big": col("o_totalprice") > 250000})


TWO = "WITH u AS (SELECT o_custkey, c_mktsegment, avg(o_totalprice) AS m FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), g AS (SELECT c_mktsegment, count(m) AS n, avg(m) AS mean, stddev_samp(m) AS sd FROM u GROUP BY 1)"


def trials(t):
    return t.orders.join(t.customer, col("o_custkey") == col("c_custkey"))


@query("a23_two_level", TWO + " SELECT c_mktsegment, n, round(mean, 2) AS mean, round(sd, 2) AS sd, round(sd / sqrt(n), 2) AS se, round(mean / (sd / sqrt(n)), 2) AS t FROM g")
def _(t):
    return rounded(a.two_level(trials(t), "o_custkey", ["c_mktsegment"], "o_totalprice"), 2)


#: Critical values of Student's t at 97.5 %, by degrees of freedom.
T_TABLE = "(VALUES " + ", ".join(f"({d}, {a.t_quantile(0.975, d)!r})" for d in range(1, 201)) + ") t(d, t)"


@query("a24_mean_ci", f"WITH s AS (SELECT user_id, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1), h AS (SELECT s.*, CASE WHEN n > 1 THEN coalesce(t, 1.959966) * sd / sqrt(n) END AS h FROM s LEFT JOIN {T_TABLE} ON d = n - 1) SELECT user_id, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - h, 5) AS lo, round(mean + h, 5) AS hi FROM h")
def _(t):
    out = a.mean_ci(t.events, ["user_id"], "value")
    return rounded(out).withColumns({x: F.round(x, 5) for x in ("lo", "hi")})


@query("a25_contrast", "SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') - max(o_totalprice) FILTER (o_orderstatus = 'O') AS contrast FROM orders GROUP BY 1")
def _(t):
    return a.contrast(t.orders, ["o_custkey"], "o_orderstatus", "F", "O", "o_totalprice")


@query("a26_double_contrast", "WITH c AS (SELECT o_custkey, o_orderpriority AS p, max(o_totalprice) FILTER (o_orderstatus = 'F') - max(o_totalprice) FILTER (o_orderstatus = 'O') AS v FROM orders GROUP BY 1, 2) SELECT o_custkey, round(max(v) FILTER (p = '1-URGENT') - max(v) FILTER (p = '5-LOW'), 2) AS double_contrast FROM c GROUP BY 1")
def _(t):
    return rounded(a.double_contrast(t.orders, ["o_custkey"], "o_orderpriority", "1-URGENT", "5-LOW", "o_orderstatus", "F", "O", "o_totalprice"), 2)


@query("a27_summarize_draws", f"WITH {DR} SELECT cond, round(quantile_cont(value, 0.025) FILTER (sample > 0), 6) AS lo, round(max(value) FILTER (sample = 0), 6) AS point, round(quantile_cont(value, 0.975) FILTER (sample > 0), 6) AS hi FROM dr WHERE side = 0 GROUP BY 1")
def _(t):
    return rounded(a.summarize_draws(draws(t).filter("side = 0"), ["cond"]))


@query("a28_credible_diff", f"WITH {DR}, c AS (SELECT cond, sample, max(value) FILTER (side = 0) - max(value) FILTER (side = 1) AS value FROM dr GROUP BY 1, 2), s AS (SELECT cond, quantile_cont(value, 0.25) FILTER (sample > 0) AS lo, max(value) FILTER (sample = 0) AS point, quantile_cont(value, 0.75) FILTER (sample > 0) AS hi FROM c GROUP BY 1) SELECT cond, round(lo, 6) AS lo, round(point, 6) AS point, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS credible FROM s")
def _(t):
    return rounded(a.credible_diff(draws(t), ["cond"], "side", 0, 1, 0.5))


@query("a29_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def _(t):
    return rounded(a.correlation(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query("a30_signal_moments", f"WITH {SG} SELECT vec_id, round(var_pop(v), 6) AS variance, round(max(v) - min(v), 6) AS ptp, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n_finite FROM sg GROUP BY 1")
def _(t):
    return rounded(t.sg().groupBy("vec_id").agg(*a.signal_moments("v")))


@query("a31_cv_percent", "SELECT user_id, round(stddev_samp(value) * 100 / abs(avg(value)), 4) AS cv FROM events GROUP BY 1")
def _(t):
    return rounded(t.events.groupBy("user_id").agg(a.cv_percent("value").alias("cv")), 4)


@query("a32_group_range", "SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def _(t):
    return a.group_range(t.events, ["event_type"], "value")


@query("a33_grand_mean", "WITH u AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2) SELECT user_id, event_type, round(m, 6) AS mean FROM u UNION ALL SELECT 0, event_type, round(avg(m), 6) FROM u GROUP BY 2")
def _(t):
    return rounded(a.grand_mean(t.events, "user_id", ["event_type"], "value"))


@query("a34_mean_cells", f"WITH {SG} SELECT label, pos, round(avg(v), 6) AS m FROM sg GROUP BY 1, 2")
def _(t):
    cells = a.mean_cells(t.embeddings, ["label"], "embedding")
    return rounded(cells.select("label", F.posexplode("mean").alias("pos", "m")).withColumn("pos", col("pos").cast("bigint")))


@query("a35_saturation", "SELECT user_id, count(*) FILTER (value < 1) AS n_below, count(*) FILTER (value > 15) AS n_above, min(value) AS min, max(value) AS max, count(*) AS n, round((count(*) FILTER (value < 1) + count(*) FILTER (value > 15)) * 100.0 / count(*), 6) AS percent_saturated FROM events GROUP BY 1")
def _(t):
    return rounded(a.saturation(t.events, ["user_id"], "value", 1, 15))


@query("a36_stage_counts", "SELECT 'discount' AS stage, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_trials FROM lineitem WHERE l_discount > 0.08 UNION ALL SELECT 'tax', count(*), count(DISTINCT l_orderkey) FROM lineitem WHERE l_tax = 0")
def _(t):
    li = t.lineitem
    return a.stage_counts({"discount": li.filter("l_discount > 0.08"), "tax": li.filter("l_tax = 0")}, ["l_orderkey"])


@query("a37_stage_runtime", "SELECT event_type, count(value) AS n, round(sum(value), 3) AS total, round(median(value), 6) AS median, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def _(t):
    return rounded(a.stage_runtime(t.events, "event_type", "value"), 3).withColumn("median", F.round("median", 6))


@query("a38_laterality", f"WITH {SG} SELECT l.vec_id, round(avg(l.v - r.v), 6) AS mean, round(stddev_samp(l.v - r.v), 6) AS sd FROM sg l JOIN sg r ON l.vec_id = r.vec_id AND r.pos = 63 - l.pos WHERE l.pos < 4 GROUP BY 1")
def _(t):
    pairs = t.spark.createDataFrame([(k, 63 - k) for k in range(4)], "left_ch int, right_ch int")
    return rounded(a.laterality(t.sg(), ["vec_id"], "pos", "v", pairs))


@query("a39_count_complete", "SELECT user_id, count(*) FILTER (event_type = 'view') AS \"view\", count(*) FILTER (event_type = 'refund') AS refund FROM events GROUP BY 1")
def _(t):
    return a.count_complete(t.events, ["user_id"], "event_type", ["view", "refund"])


@query("a40_stream_balance", "WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1) SELECT user_id, v AS \"view\", c AS click, CASE WHEN least(v, c) <> 0 THEN round(greatest(v, c) / least(v, c), 6) END AS balance, CASE WHEN least(v, c) = 0 THEN 'missing_code' WHEN greatest(v, c) > least(v, c) * 1.5 THEN 'unbalanced' ELSE 'coherent' END AS status FROM c")
def _(t):
    return rounded(a.stream_balance(t.events, ["user_id"], "event_type", ["view", "click"], 1.5))


@query("a41_describe_units", "WITH u AS (SELECT o_custkey, o_orderstatus, min(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT o_orderstatus, count(*) AS n_units, round(avg(v), 2) AS o_totalprice_mean, round(stddev_samp(v), 2) AS o_totalprice_sd FROM u GROUP BY 1")
def _(t):
    return rounded(a.describe_units(t.orders, "o_custkey", ["o_orderstatus"], ["o_totalprice"]), 2)


@query("a42_run_aggregate", "SELECT count(*) AS n_units, (SELECT string_agg(s || '=' || n, ';' ORDER BY s || '=' || n) FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)) AS statuses, (SELECT string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) FROM orders) AS warnings, sum(o_custkey)::BIGINT AS bytes FROM orders")
def _(t):
    return a.run_aggregate(t.orders, "o_orderstatus", "o_orderpriority", "o_custkey")


@query("a43_range_and_mode", "WITH c AS (SELECT user_id, event_id % 7 AS m, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT user_id, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1) SELECT c.user_id, arg_min(m, n * -1000 + m) AS mode, max(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END) AS text FROM c JOIN r USING (user_id) GROUP BY 1")
def _(t):
    ev = t.events.withColumn("m", col("event_id") % 7)
    return a.mode_of(ev, ["user_id"], "m").join(ev.groupBy("user_id").agg(a.range_text("event_id").alias("text")), "user_id")


@query("u1_stack", "SELECT o_orderkey AS id, o_totalprice AS amount, NULL::VARCHAR AS name, 'orders' AS source FROM orders UNION ALL SELECT c_custkey, NULL, c_name, 'customer' FROM customer")
def _(t):
    return u.stack({"orders": t.orders.select(col("o_orderkey").alias("id"), col("o_totalprice").alias("amount")), "customer": t.customer.select(col("c_custkey").alias("id"), col("c_name").alias("name"))}, "source")


@query("u3_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return u.distinct(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("u4_snapshot_diff", "WITH b AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT c_custkey, c_acctbal + (c_custkey % 3 = 0)::INTEGER AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0) SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed' WHEN a.c_acctbal IS NOT DISTINCT FROM b.c_acctbal THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.c_custkey = b.c_custkey")
def _(t):
    c = t.customer.select("c_custkey", "c_acctbal")
    after = c.filter("c_custkey % 7 <> 0").withColumn("c_acctbal", col("c_acctbal") + F.when(col("c_custkey") % 3 == 0, 1).otherwise(0))
    return u.snapshot_diff(c.filter("c_custkey % 5 <> 0"), after, ["c_custkey"], ["c_acctbal"])


SETS = "WITH s AS (SELECT user_id, coalesce(list_sort(list(DISTINCT k) FILTER (half = 0)), []) AS a, coalesce(list_sort(list(DISTINCT k) FILTER (half = 1)), []) AS b FROM (SELECT user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_id % 2 AS half FROM events) GROUP BY 1)"


def two_sets(t):
    ev = t.ev()
    both = ev.groupBy("user_id").agg(F.collect_set(F.when(col("event_id") % 2 == 0, col("k"))).alias("a"), F.collect_set(F.when(col("event_id") % 2 == 1, col("k"))).alias("b"))
    return t.events.select("user_id").distinct().join(both, "user_id", "left").select("user_id", *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in "ab"])


@query("u5_set_compare", SETS + " SELECT user_id, list_sort(list_distinct(list_concat(a, b))) AS either, list_sort(list_intersect(a, b)) AS both, list_filter(a, lambda x: NOT list_contains(b, x)) AS only_a, list_filter(b, lambda x: NOT list_contains(a, x)) AS only_b, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard FROM s")
def _(t):
    return rounded(two_sets(t).select("user_id", *u.set_compare(col("a"), col("b"))))


@query("u6_set_change", SETS + " SELECT user_id, list_sort(list_intersect(a, b)) AS retained, list_filter(a, lambda x: NOT list_contains(b, x)) AS lost, list_filter(b, lambda x: NOT list_contains(a, x)) AS gained FROM s")
def _(t):
    return two_sets(t).select("user_id", *u.set_change(col("a"), col("b")))


@query("u7_criteria_union", "WITH s AS (SELECT user_id, event_type AS i, bool_or(value > 20 OR event_id % 97 = 0) AS p, bool_or(value > 12) AS r FROM events GROUP BY 1, 2) SELECT user_id, coalesce(string_agg(i, ';' ORDER BY i) FILTER (p), '') AS primary_items, coalesce(string_agg(i, ';' ORDER BY i) FILTER (r AND NOT p), '') AS report_items, round(count(*) FILTER (p) / count(*), 6) AS share, count(*) FILTER (p) / count(*) > 0.5 AS warning FROM s GROUP BY 1")
def _(t):
    return rounded(u.criteria_union(t.events, ["user_id"], "event_type", {"high": col("value") > 20, "odd": col("event_id") % 97 == 0}, {"mid": col("value") > 12}, 0.5))


@query("u8_determinism", "SELECT l_orderkey, count(*) AS n_runs, count(*) FILTER (l_tax > 0.02) AS n_success, count(DISTINCT CASE WHEN l_tax > 0.02 THEN l_returnflag END) AS n_results, count(DISTINCT CASE WHEN l_tax > 0.02 THEN l_returnflag END) = 1 AS deterministic FROM lineitem GROUP BY 1")
def _(t):
    return u.determinism(t.lineitem, ["l_orderkey"], "l_returnflag", col("l_tax") > 0.02)


@query("u9_melt", "SELECT c_custkey, 'c_name' AS variable, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer")
def _(t):
    return u.melt(t.customer, ["c_custkey"], ["c_name", "c_mktsegment"])


@query("u10_spread", "SELECT user_id, max(n) FILTER (event_type = 'view') AS \"view\", max(n) FILTER (event_type = 'error') AS error FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return u.spread(t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], "event_type", ["view", "error"], "n")


@query("u11_explode_text", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name, unnest(range(len(string_split(p_name, ' '))))::INTEGER AS position FROM part")
def _(t):
    return u.explode_text(t.part.select("p_partkey", "p_name"), "p_name", " ")


@query("u12_separate", "SELECT o_orderkey, TRY_CAST(string_split(o_orderpriority, '-')[1] AS INTEGER) AS level, string_split(o_orderpriority, '-')[2] AS word FROM orders")
def _(t):
    return t.orders.select("o_orderkey", *u.separate(col("o_orderpriority"), {"level": "int", "word": "string"}, "-"))


@query("u13_nest", f"WITH {EV} SELECT user_id, unnest(list(k ORDER BY onset, event_id)) AS k, unnest(range(1, count(*) + 1)) AS n FROM ev GROUP BY 1")
def _(t):
    back = u.unnest(u.nest(t.ev(), ["user_id"], ["onset", "event_id"], ["k"]))
    from ..operators.windows import ordered

    return back.select("user_id", "k", F.row_number().over(ordered(["user_id"], ["onset", "event_id"])).cast("bigint").alias("n"))


@query("u14_views", "SELECT 'final' AS name, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'")
def _(t):
    v = u.views(t.orders, {"final": col("o_orderstatus") == "F", "open": col("o_orderstatus") == "O"})
    return u.stack({n: d.agg(F.count("*").alias("n")) for n, d in v.items()}, "name")


@query("u15_select_roles", "SELECT o_orderkey, role FROM orders JOIN (VALUES ('F', '1-URGENT', 'lead'), ('F', '1-URGENT', 'check'), ('O', '5-LOW', 'rest')) r(o_orderstatus, o_orderpriority, role) USING (o_orderstatus, o_orderpriority)")
def _(t):
    roles = u.registry(t.spark, [("F", "1-URGENT", "lead"), ("F", "1-URGENT", "check"), ("O", "5-LOW", "rest")], "o_orderstatus string, o_orderpriority string, role string")
    return u.select_roles(t.orders, roles, ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "role")


@query("u16_data_grid", "SELECT s.o_orderstatus, p.o_orderpriority, n.l_returnflag FROM (SELECT DISTINCT o_orderstatus FROM orders) s, (SELECT DISTINCT o_orderpriority FROM orders) p, (SELECT DISTINCT l_returnflag FROM lineitem) n")
def _(t):
    both = t.orders.join(t.lineitem, col("o_orderkey") == col("l_orderkey"))
    return u.data_grid(both, ["o_orderstatus", "o_orderpriority"], ["l_returnflag"])


@query("u18_exceptions", "SELECT DISTINCT l_orderkey, issue FROM (SELECT l_orderkey, unnest([CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_tax = 0 THEN 'untaxed' END]) AS issue FROM lineitem) WHERE issue IS NOT NULL")
def _(t):
    from ..functions.columns import issue_codes

    return u.exceptions(t.lineitem, ["l_orderkey"], issue_codes([(col("l_discount") > 0.09, "discount"), (col("l_tax") == 0, "untaxed")]))
