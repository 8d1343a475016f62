"""Queries of joins and contract checks (groups J and Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as q
from ..operators import joins as j
from .base import EV, query, rounded

col = F.col
A = "SELECT user_id, event_id, onset, value FROM ev WHERE event_id % 2 = 0"
B = "SELECT user_id, event_id, onset, value FROM ev WHERE event_id % 2 = 1"


@query("j1_join_all", "SELECT c_custkey, n, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c_custkey")
def _(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    a, b = o.groupBy("c_custkey").agg(F.count("*").alias("n")), o.filter("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.round(F.max("o_totalprice"), 2).alias("total"))
    return j.join_all(t.customer.select("c_custkey"), [a, b], ["c_custkey"])


@query("j2_join_keys", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def _(t):
    return j.join_keys(t.orders, t.customer, {"o_custkey": "c_custkey"}).select("o_orderkey", "c_mktsegment")


@query("j3_reconcile", "SELECT coalesce(o_orderkey, l_orderkey) AS k, n, CASE WHEN o_orderkey IS NULL THEN 'right_only' WHEN l_orderkey IS NULL THEN 'left_only' ELSE 'both' END AS join_status FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def _(t):
    left = t.orders.filter("o_orderstatus <> 'P'").select(col("o_orderkey").alias("k"))
    return j.reconcile(left, t.lineitem.groupBy(col("l_orderkey").alias("k")).agg(F.count("*").alias("n")), ["k"])


@query("j4_zip_by_position", f"WITH {EV}, a AS (SELECT user_id, event_id AS ea, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ({A})), b AS (SELECT user_id, event_id AS eb, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM ({B})) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.p, b.p)::INTEGER AS position, ea, eb FROM a FULL JOIN b ON a.user_id = b.user_id AND a.p = b.p WHERE coalesce(a.user_id, b.user_id) IN (SELECT user_id FROM b)")
def _(t):
    ev = t.ev().select("user_id", "event_id")
    a, b = ev.filter("event_id % 2 = 0").withColumnRenamed("event_id", "ea"), ev.filter("event_id % 2 = 1").withColumnRenamed("event_id", "eb")
    return j.zip_by_position(a, b, ["user_id"], ["ea"], ["eb"])


@query("j5_drop_trials", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)")
def _(t):
    return j.drop_trials(t.orders.select("o_orderkey"), t.lineitem.filter("l_discount > 0.09").select(col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("j6_keep_trials", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def _(t):
    return j.keep_trials(t.orders.select("o_orderkey"), t.lineitem.filter("l_quantity > 49").select(col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("j7_right_join", "SELECT c_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o RIGHT JOIN customer ON c_custkey = o_custkey")
def _(t):
    return j.right_join(t.orders.groupBy(col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), t.customer.select("c_custkey"), ["c_custkey"])


@query("j8_range_join", "SELECT event_id, band FROM events JOIN (VALUES ('a', 0.0, 3.0), ('b', 2.0, 6.0), ('c', 6.0, 30.0)) b(band, lo, hi) ON value BETWEEN lo AND hi")
def _(t):
    bands = t.spark.createDataFrame([("a", 0.0, 3.0), ("b", 2.0, 6.0), ("c", 6.0, 30.0)], "band string, lo double, hi double")
    return j.range_join(t.events, bands, "value").select("event_id", "band")


@query("j8_range_join_cells", "SELECT event_id, o_orderkey FROM events JOIN orders ON event_id BETWEEN o_orderkey * 3 AND o_orderkey * 3 + 10")
def _(t):
    ranges = t.orders.select("o_orderkey", (col("o_orderkey") * 3).alias("lo"), (col("o_orderkey") * 3 + 10).alias("hi"))
    return j.range_join(t.events, ranges, "event_id", width=16).select("event_id", "o_orderkey")


@query("j9_nearby_candidates", f"WITH {EV}, n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY onset, event_id) AS p FROM ev) SELECT a.event_id AS problem, b.event_id AS candidate, b.p - a.p AS index_distance FROM n a JOIN n b ON a.user_id = b.user_id AND abs(a.p - b.p) <= 5 WHERE a.event_type = 'error' AND b.event_type = 'purchase'")
def _(t):
    from ..operators.windows import ordered

    n = t.ev().withColumn("p", F.row_number().over(ordered(["user_id"], ["onset", "event_id"])).cast("bigint"))
    a = n.filter("event_type = 'error'").select("user_id", "p", col("event_id").alias("problem"))
    b = n.filter("event_type = 'purchase'").select("user_id", col("p").alias("at"), col("event_id").alias("candidate"))
    return j.nearby_candidates(a, b, ["user_id"], "p", "at").select("problem", "candidate", "index_distance")


@query("j10_cut_epochs", f"WITH {EV} SELECT a.event_id AS anchor, s.event_id AS sample, s.event_id - a.event_id AS \"offset\" FROM ev a JOIN ev s ON s.user_id % 3 = a.user_id % 3 AND s.event_id BETWEEN a.event_id - 4 AND a.event_id + 9 WHERE a.event_type = 'purchase'")
def _(t):
    ev = t.ev().withColumn("part", col("user_id") % 3)
    anchors = ev.filter("event_type = 'purchase'").select("part", col("event_id").alias("anchor"))
    return j.cut_epochs(ev.select("part", col("event_id").alias("sample")), anchors, ["part"], "sample", "anchor", -4, 9).select("anchor", "sample", "offset")


@query("j11_label_segments", f"WITH {EV} SELECT s.event_id, e.k AS label FROM ev s ASOF LEFT JOIN (SELECT user_id, onset, k FROM ev WHERE event_type = 'view') e ON s.user_id = e.user_id AND s.onset >= e.onset")
def _(t):
    ev = t.ev()
    return j.label_segments(ev.select("user_id", "event_id", "onset"), ev.filter("event_type = 'view'").select("user_id", "onset", col("k").alias("label")), ["user_id"], "onset", "label").select("event_id", "label")


@query("j12_join_baseline", f"WITH {EV}, b AS (SELECT user_id, avg(value) AS m FROM ev WHERE event_type = 'view' GROUP BY 1) SELECT event_id, round(value - m, 6) AS above FROM ev LEFT JOIN b USING (user_id)")
def _(t):
    return rounded(j.join_baseline(t.ev(), ["user_id"], "value", col("event_type") == "view").select("event_id", (col("value") - col("baseline")).alias("above")))


@query("j13_remap_ids", "SELECT 'mapped' AS kind, event_id, user_id + 1000 AS id FROM events WHERE user_id % 2 = 0 UNION ALL SELECT 'refused', event_id, NULL FROM events WHERE user_id % 2 = 1")
def _(t):
    mapping = t.events.filter("user_id % 2 = 0").select("user_id", (col("user_id") + 1000).alias("id")).distinct()
    good, refused = j.remap_ids(t.events.select("event_id", "user_id"), mapping, "user_id", "id")
    return good.select(F.lit("mapped").alias("kind"), "event_id", "id").unionByName(refused.select(F.lit("refused").alias("kind"), "event_id", F.lit(None).cast("bigint").alias("id")))


@query("j14_cross_registry", "SELECT c_custkey, role FROM customer, (VALUES ('lead'), ('check')) r(role)")
def _(t):
    return j.cross_registry(t.customer.select("c_custkey"), t.spark.createDataFrame([("lead",), ("check",)], "role string"))


@query("j15_explode_crosswalk", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    lists = t.events.groupBy("user_id").agg(F.array_join(F.collect_set("event_type"), " ; ").alias("event_type"))
    return j.explode_crosswalk(lists, "event_type")


@query("j16_pair_streams", f"WITH {EV}, a AS (SELECT user_id, event_id, onset, row_number() OVER (PARTITION BY user_id ORDER BY onset, event_id) AS p FROM ({A})), b AS (SELECT user_id, event_id, onset, row_number() OVER (PARTITION BY user_id ORDER BY onset, event_id) AS p FROM ({B})) SELECT a.event_id AS event_id_a, b.event_id AS event_id_b, round(b.onset - a.onset, 6) AS difference, abs(b.onset - a.onset) <= 3600 AS within FROM a JOIN b USING (user_id, p)")
def _(t):
    ev = t.ev().select("user_id", "event_id", "onset")
    return rounded(j.pair_streams(ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1"), ["user_id"], ["onset", "event_id"], "onset", 3600).select("event_id_a", "event_id_b", "difference", "within"))


@query("j17_pairwise", "WITH s AS (SELECT DISTINCT user_id, event_type AS item FROM events) SELECT user_id, a.item AS item_a, b.item AS item_b FROM s a JOIN s b USING (user_id) WHERE a.item < b.item")
def _(t):
    return j.pairwise(t.events.select("user_id", "event_type").distinct(), ["user_id"], "event_type")


@query("j18_backfill_unique", "WITH p AS (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1 HAVING count(*) = 1) SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_custkey END, s) AS v FROM orders LEFT JOIN p ON l_orderkey = o_orderkey")
def _(t):
    child = t.orders.select("o_orderkey", F.when(col("o_orderstatus") == "F", col("o_custkey")).alias("v"))
    return j.backfill_unique(child, t.lineitem.select(col("l_orderkey").alias("o_orderkey"), col("l_suppkey").alias("v")), ["o_orderkey"], "v")


@query("j19_exists_flags", "SELECT c_custkey, coalesce(f, false) AS has_final, coalesce(b, false) AS has_big FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_totalprice > 400000) AS b FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def _(t):
    facts = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return j.exists_flags(t.customer.select("c_custkey"), facts, ["c_custkey"], {"has_final": col("o_orderstatus") == "F", "has_big": col("o_totalprice") > 400000})


@query("q2_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return q.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("q3_count_mismatches", "SELECT 'large' AS surface, 1::BIGINT AS expected, count(*) FILTER (o_totalprice > 300000) AS n FROM orders UNION ALL SELECT 'absent', 5, NULL")
def _(t):
    from ..operators.aggs import surface_counts

    counts = surface_counts(t.orders, {"large": col("o_totalprice") > 300000, "none": col("o_totalprice") < 0})
    return q.count_mismatches(counts, {"large": 1, "none": 0, "absent": 5})


@query("q5_out_of_bounds", "SELECT event_id, value FROM events WHERE value NOT BETWEEN 0.5 AND 18 OR value IS NULL")
def _(t):
    return q.out_of_bounds(t.events.select("event_id", "value"), "value", 0.5, 18)


@query("q6_not_finite", "SELECT 'l_discount' AS \"column\", count(*) FILTER (l_discount <= 0) AS n FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax <= 0) FROM lineitem")
def _(t):
    return q.not_finite(t.lineitem, ["l_discount", "l_tax", "l_quantity"], positive=True)


@query("q7_outside_domain", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click')")
def _(t):
    return q.outside_domain(t.events, "event_type", ["view", "click"])


@query("q8_wrong_members", "SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) <> 3")
def _(t):
    return q.wrong_members(t.lineitem, ["l_orderkey"], "l_linenumber", 3)


@query("q9_max_difference", "SELECT count(*) AS n, max(abs(o_totalprice - (o_totalprice + o_orderkey % 3))) AS max_difference, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS n_unmatched FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    b = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", (col("o_totalprice") + col("o_orderkey") % 3).alias("o_totalprice"))
    return rounded(q.max_difference(t.orders, b, ["o_orderkey"], "o_totalprice"), 4)


@query("q10_broken_implications", "SELECT 'big_is_final' AS rule, count(*) FILTER (o_totalprice > 300000 AND o_orderstatus <> 'F') AS n FROM orders")
def _(t):
    return q.broken_implications(t.orders, {"big_is_final": (col("o_totalprice") > 300000, col("o_orderstatus") == "F")})


@query("q11_missing_reasons", "SELECT 'paid' AS status, count(*) FILTER (o_totalprice <= 100000 AND o_orderstatus = 'P') AS n FROM orders")
def _(t):
    df = t.orders.select((col("o_totalprice") > 100000).alias("paid"), F.when(col("o_orderstatus") == "P", "  ").otherwise("because").alias("paid_reason"))
    return q.missing_reasons(df, ["paid"])


@query("q12_null_scope", "SELECT 'v' AS \"column\", count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 5 = 0) AS n_null_inside, count(*) FILTER (o_orderstatus <> 'F' AND o_custkey % 5 <> 0) AS n_value_outside FROM orders")
def _(t):
    df = t.orders.withColumn("v", F.when(col("o_custkey") % 5 != 0, 1))
    return q.null_scope(df, ["v"], col("o_orderstatus") == "F")


@query("q13_member_set", f"WITH {EV}, g AS (SELECT user_id, list(event_type ORDER BY onset, event_id) AS g FROM ev GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_filter(['click', 'refund', 'view'], lambda x: NOT list_contains(g, x))), ';') AS missing, array_to_string(list_sort(list_distinct(list_filter(g, lambda x: NOT list_contains(['click', 'refund', 'view'], x)))), ';') AS unexpected, array_to_string(list_sort(list_distinct(list_filter(g, lambda x: len(list_filter(g, lambda y: y = x)) > 1))), ';') AS duplicate, g = ['click', 'refund', 'view'] AS in_order FROM g")
def _(t):
    return q.member_set(t.ev(), ["user_id"], "event_type", ["onset", "event_id"], ["click", "refund", "view"])


@query("q14_null_counts", "SELECT 'o_custkey' AS \"column\", count(*) FILTER (o_custkey IS NULL) AS n FROM orders UNION ALL SELECT 'o_orderdate', count(*) FILTER (o_orderdate IS NULL) FROM orders")
def _(t):
    return q.null_counts(t.orders, ["o_custkey", "o_orderdate"])


@query("q4_key_mismatches", "WITH a AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders), m AS (SELECT o_orderkey + (o_orderkey % 1000 = 7)::INTEGER AS k FROM orders WHERE o_orderkey % 5000 <> 11), b AS (SELECT k, row_number() OVER (ORDER BY k) AS n FROM m) SELECT coalesce(a.n, b.n) AS place, a.k AS a, b.k AS b FROM a FULL JOIN b USING (n) WHERE a.k IS DISTINCT FROM b.k")
def _(t):
    a = t.orders.select("o_orderkey")
    b = a.filter("o_orderkey % 5000 <> 11").select(F.when(col("o_orderkey") % 1000 == 7, col("o_orderkey") + 1).otherwise(col("o_orderkey")).alias("o_orderkey"))
    return q.key_mismatches(a, b, ["o_orderkey"], ["o_orderkey"]).select((col("place") + 1).alias("place"), col("a.o_orderkey").alias("a"), col("b.o_orderkey").alias("b"))


