"""Queries of windows, sorts and top-k (groups W and T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shape
from ..operators import windows as w
from .base import EV, SG, SM, query, rounded

col = F.col
K, O = ["user_id"], ["onset", "event_id"]
KS, OS = ["trial"], ["time", "o"]
WIN = "OVER (PARTITION BY user_id ORDER BY onset, event_id)"
WS = "OVER (PARTITION BY trial ORDER BY time, o)"


@query("w1_lag", f"WITH {EV} SELECT event_id, lag(value) {WIN} AS before, lead(value, 2) {WIN} AS after FROM ev")
def _(t):
    return t.ev().select("event_id", w.lag("value", K, O).alias("before"), w.lag("value", K, O, -2).alias("after"))


@query("w2_step_dist", f"WITH {SM}, l AS (SELECT *, lag(x) {WS} AS px, lag(y) {WS} AS py FROM sm) SELECT o, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 6) AS d FROM l")
def _(t):
    return rounded(t.sm().select("o", w.step_dist(KS, OS).alias("d")))


@query("w3_turn_angle", f"""WITH {SM}, l AS (SELECT o, x - lag(x) {WS} AS ax, y - lag(y) {WS} AS ay, lead(x) {WS} - x AS bx, lead(y) {WS} - y AS b2 FROM sm),
  a AS (SELECT o, atan2(b2, bx) - atan2(ay, ax) AS a FROM l) SELECT o, round(CASE WHEN a > pi() THEN a - 2 * pi() WHEN a <= -pi() THEN a + 2 * pi() ELSE a END, 6) AS turn FROM a""")
def _(t):
    return rounded(t.sm().select("o", w.turn_angle(KS, OS).alias("turn")))


@query("w3_turn_angle_skip", f"""WITH {SM}, l AS (SELECT o, x - lag(x) {WS} AS ax, y - lag(y) {WS} AS ay, lead(x) {WS} - x AS bx, lead(y) {WS} - y AS b2 FROM sm),
  s AS (SELECT l.o, ax, ay, bx + lead(bx) OVER v AS cx, b2 + lead(b2) OVER v AS cy FROM l JOIN (SELECT o, trial, time FROM sm) p USING (o) WINDOW v AS (PARTITION BY trial ORDER BY time, o)),
  a AS (SELECT o, atan2(cy, cx) - atan2(ay, ax) AS a FROM s) SELECT o, round(CASE WHEN a > pi() THEN a - 2 * pi() WHEN a <= -pi() THEN a + 2 * pi() ELSE a END, 6) AS turn FROM a""")
def _(t):
    return rounded(t.sm().select("o", w.turn_angle(KS, OS, skip=1).alias("turn")))


@query("w4_rezero", f"WITH {SM} SELECT o, round(time - first_value(time) {WS}, 6) AS since FROM sm")
def _(t):
    return rounded(t.sm().select("o", w.rezero("time", KS, OS).alias("since")))


@query("w5_proportion", f"WITH {SM} SELECT o, round(row_number() {WS} / count(*) OVER (PARTITION BY trial), 6) AS share FROM sm")
def _(t):
    return rounded(t.sm().select("o", w.proportion(KS, OS).alias("share")))


@query("w6_segment_by", f"WITH {EV} SELECT event_id, coalesce(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY onset, event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS segment, last_value(CASE WHEN event_type = 'view' THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY onset, event_id ROWS UNBOUNDED PRECEDING) AS label FROM ev")
def _(t):
    start = col("event_type") == "view"
    return t.ev().select("event_id", w.segment_by(start, K, O).cast("bigint").alias("segment"), w.carried(F.when(start, col("k")), K, O).alias("label"))


@query("w7_latch", f"WITH {EV} SELECT event_id, bool_or(value > 20) OVER (PARTITION BY user_id ORDER BY onset, event_id ROWS UNBOUNDED PRECEDING) AS seen, bool_or(value > 20) OVER (PARTITION BY user_id ORDER BY onset, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS coming FROM ev")
def _(t):
    f = col("value") > 20
    return t.ev().select("event_id", w.latch(f, K, O).alias("seen"), w.reverse_latch(f, K, O).alias("coming"))


@query("w8_before_last", f"WITH {EV} SELECT event_id, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY onset, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS more FROM ev")
def _(t):
    return t.ev().select("event_id", w.before_last(col("event_type") == "error", K, O).alias("more"))


@query("w9_rank_first", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice ASC NULLS LAST, o_orderkey)::INTEGER AS r FROM orders")
def _(t):
    return t.orders.select("o_orderkey", w.rank_first(["o_custkey"], "o_totalprice", ["o_orderkey"]).alias("r"))


@query("w10_ranks", "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC)::INTEGER AS r, round((rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2) / count(*) OVER (PARTITION BY l_returnflag), 6) AS pct FROM lineitem")
def _(t):
    return rounded(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", w.rank_min(["l_returnflag"], "l_quantity").alias("r"), w.pct_rank_avg(["l_returnflag"], "l_quantity").alias("pct")))


@query("w11_over_partition", f"WITH {EV} SELECT event_id, min(CASE WHEN event_type = 'view' THEN value END) OVER (PARTITION BY user_id) AS low FROM ev")
def _(t):
    return t.ev().select("event_id", w.over_partition(F.min(F.when(col("event_type") == "view", col("value"))), K).alias("low"))


@query("w12_dup_flag", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS dup FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", w.dup_flag(["l_orderkey", "l_linenumber"]).alias("dup"))


@query("w13_nth_largest", "SELECT o_orderkey, list_reverse_sort(list(o_totalprice) OVER (PARTITION BY o_custkey))[2] AS second FROM orders")
def _(t):
    return t.orders.select("o_orderkey", w.nth_largest("o_totalprice", 2, ["o_custkey"]).alias("second"))


@query("w14_longest_run", f"WITH {EV}, n AS (SELECT user_id, event_type <> 'error' AS f, row_number() {WIN} AS n, sum((event_type <> 'error')::INTEGER) OVER (PARTITION BY user_id ORDER BY onset, event_id ROWS UNBOUNDED PRECEDING) AS s FROM ev), g AS (SELECT user_id, n - s AS i, count(*) FILTER (f) AS c FROM n GROUP BY 1, 2) SELECT user_id, max(c) AS longest_run FROM g GROUP BY 1")
def _(t):
    return w.longest_run(t.ev(), K, O, col("event_type") != "error")


@query("w15_zscore", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus)) / stddev_samp(o_totalprice) OVER (PARTITION BY o_orderstatus), 4) AS o_totalprice_z FROM orders")
def _(t):
    return rounded(w.zscore(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_totalprice"], ["o_orderstatus"]).select("o_orderkey", "o_totalprice_z"), 4)


@query("w15_zscore_table", "SELECT o_orderkey, round((o_totalprice - m) / s, 4) AS o_totalprice_z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)")
def _(t):
    return rounded(w.zscore(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", "o_totalprice_z"), 4)


@query("w16_within_between", "WITH m AS (SELECT *, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_custkey) AS mu FROM orders), c AS (SELECT avg(mu) AS centre FROM (SELECT o_custkey, max(mu) AS mu FROM m GROUP BY 1)) SELECT o_orderkey, round(o_totalprice - mu, 0) AS o_totalprice_within, round(mu - centre, 0) AS o_totalprice_between FROM m, c")
def _(t):
    return rounded(w.within_between(t.orders, ["o_custkey"], "o_totalprice", col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice_within", "o_totalprice_between"), 0)


@query("w17_fill_group", f"WITH {EV} SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN k END, max(CASE WHEN event_type = 'view' THEN k END) OVER (PARTITION BY user_id)) AS filled FROM ev")
def _(t):
    return t.ev().select("event_id", w.fill_group(F.when(col("event_type") == "view", col("k")), K).alias("filled"))


@query("w18_baseline_over", f"WITH {SG} SELECT vec_id, pos, round(v - avg(CASE WHEN pos BETWEEN 0 AND 9 THEN v END) OVER (PARTITION BY vec_id), 6) AS corrected FROM sg")
def _(t):
    return rounded(t.sg().select("vec_id", col("pos").cast("bigint").alias("pos"), (col("v") - w.baseline_over("v", "pos", 0, 9, ["vec_id"])).alias("corrected")))


@query("w19_renumber", f"WITH {EV} SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY k)::INTEGER AS n FROM ev WHERE event_type <> 'error'")
def _(t):
    return t.ev().filter(col("event_type") != "error").select("event_id", w.renumber(K, ["k"]).alias("n"))


@query("w20_order_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS order_index FROM orders")
def _(t):
    return w.order_index(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", col("order_index").cast("bigint").alias("order_index"))


@query("w21_first_problem", f"WITH {EV}, n AS (SELECT user_id, row_number() {WIN} AS p, value > 15 AS f FROM ev), m AS (SELECT *, min(CASE WHEN f THEN p END) OVER (PARTITION BY user_id) AS first FROM n), g AS (SELECT user_id, max(first) AS first_problem, count(*) FILTER (f) AS n_problems, count(*) FILTER (p > first) AS n_after, count(*) FILTER (p > first AND f) AS n_problems_after FROM m GROUP BY 1) SELECT *, CASE WHEN n_after > 0 THEN round(n_problems_after / n_after, 6) END AS share_after FROM g")
def _(t):
    placed = t.ev().withColumn("p", F.row_number().over(w.ordered(K, O)).cast("bigint"))
    return rounded(w.first_problem(placed, K, "p", col("value") > 15))


@query("w22_transitions", f"WITH {EV}, l AS (SELECT user_id, event_type IS DISTINCT FROM lag(event_type) {WIN} AS d, row_number() {WIN} AS n FROM ev) SELECT user_id, count(*) FILTER (d AND n > 1) AS n_transitions FROM l GROUP BY 1")
def _(t):
    return w.transitions(t.ev(), K, O, "event_type")


@query("w23_step_stats", f"WITH {EV}, l AS (SELECT user_id, abs(value - lag(value) {WIN}) AS s FROM ev), g AS (SELECT user_id, max(s) AS a, quantile_cont(s, 0.5) AS b, quantile_cont(s, 0.999) AS c FROM l GROUP BY 1) SELECT user_id, round(a, 6) AS max_step, round(b, 6) AS median_step, round(c, 6) AS p999_step, CASE WHEN b > 0 THEN round(a / b, 4) END AS step_ratio FROM g")
def _(t):
    out = w.step_stats(t.ev(), K, O, "value")
    return out.select("user_id", *[F.round(x, 6).alias(x) for x in ("max_step", "median_step", "p999_step")], F.round("step_ratio", 4).alias("step_ratio"))


@query("t1_order_by", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey NULLS LAST, o_orderkey) AS n FROM orders")
def _(t):
    ordered_rows = shape.order_by(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])
    return w.order_index(ordered_rows, ["o_custkey", "o_orderkey"], "n").select("o_orderkey", (col("n") + 1).cast("bigint").alias("n"))


@query("t2_top1_abs", f"WITH {SG} SELECT vec_id, pos FROM sg QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, pos) = 1")
def _(t):
    return shape.top1_abs(t.sg(), ["vec_id"], "v", "pos").select("vec_id", col("pos").cast("bigint").alias("pos"))


@query("t3_topn_wide", f"WITH {SG}, r AS (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, pos) AS n FROM sg) SELECT vec_id, max(pos) FILTER (n = 1) AS top1, max(pos) FILTER (n = 2) AS top2, max(pos) FILTER (n = 3) AS top3 FROM r GROUP BY 1")
def _(t):
    return shape.topn_wide(t.sg().withColumn("pos", col("pos").cast("bigint")), ["vec_id"], "v", "pos", 3)


@query("t4_best_candidate", "SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_extendedprice, l_partkey, l_suppkey) = 1")
def _(t):
    return shape.best_candidate(t.lineitem, ["l_orderkey"], [col("l_discount").desc(), col("l_extendedprice"), col("l_partkey"), col("l_suppkey")]).select("l_orderkey", "l_partkey")


@query("t5_first_n", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) <= 2")
def _(t):
    return shape.first_n(t.part, ["p_brand"], ["p_name", "p_partkey"], 2).select("p_brand", "p_partkey")


@query("t6_decimate", f"WITH {EV} SELECT event_id FROM ev QUALIFY (row_number() {WIN} - 1) % 10 = 3")
def _(t):
    return shape.decimate(t.ev(), K, O, 10, 3).select("event_id")


@query("t7_page_number", "SELECT p_partkey, (dense_rank() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1) // 6 + 1 AS page FROM part")
def _(t):
    return t.part.select("p_partkey", shape.page_number(["p_type"], "p_partkey", 6).alias("page"))


@query("t8_split_units", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('7|' || o_custkey || '|' || o_orderkey), o_orderkey) <= floor(count(*) OVER (PARTITION BY o_custkey) * 0.3) THEN 'test' ELSE 'train' END AS split FROM orders")
def _(t):
    return shape.split_units(t.orders, ["o_custkey"], "o_orderkey", 0.3, 7).select("o_orderkey", "split")


@query("t9_select_surface", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(t):
    files = t.customer.filter("c_acctbal > 5000").select("c_custkey")
    return shape.select_surface(t.customer, files, "c_custkey", col("c_acctbal") > 0).select("c_custkey")
