"""Queries of the column expressions (groups P and F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import shape
from .base import EV, query, rounded

col = F.col


@query("p1_select_ordered", "SELECT o_orderstatus, o_custkey, o_orderkey FROM orders")
def _(t):
    return c.select_ordered(t.orders.select("o_orderkey", "o_orderstatus", "o_custkey"), ["o_orderstatus", "o_custkey"])


@query("p2_keep_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def _(t):
    return c.keep_rows(t.orders, (col("o_totalprice") > 300000) & (col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("p3_case_map", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS level FROM orders")
def _(t):
    return t.orders.select("o_orderkey", c.case_map([(col("o_totalprice") < 50000, "low"), (col("o_totalprice") < 200000, "mid")], "high").alias("level"))


@query("p4_isin_table", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def _(t):
    return c.isin_table(t.customer, t.orders.select(col("o_custkey").alias("c_custkey")), "c_custkey", negate=True).select("c_custkey")


@query("p5_combine_first", "SELECT o.o_orderkey, coalesce(l.q, o.o_custkey) AS v FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_partkey) AS q FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey")
def _(t):
    q = t.lineitem.groupBy(col("l_orderkey").alias("o_orderkey")).agg(F.max("l_partkey").alias("q"))
    return t.orders.join(q, "o_orderkey", "left").select("o_orderkey", c.combine_first(col("q"), col("o_custkey")).alias("v"))


@query("p6_safe_divide", "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) END AS ratio FROM lineitem")
def _(t):
    return rounded(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", c.safe_divide(col("l_tax"), col("l_discount")).alias("ratio")))


@query("p7_to_number", "SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS brand, TRY_CAST(p_type AS BIGINT) AS kind, TRY_CAST(p_name AS DOUBLE) AS name FROM part")
def _(t):
    return t.part.select("p_partkey", c.to_int(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("brand"), c.to_int(col("p_type")).alias("kind"), c.to_double(col("p_name")).alias("name"))


@query("p8_bool_value", "SELECT doc_id, CASE WHEN quality = 1 THEN true WHEN quality = 0 THEN false END AS flag FROM labels")
def _(t):
    return t.labels.select("doc_id", c.bool_value(col("quality")).alias("flag"))


@query("p9_normalize_label", "SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'f' THEN 'final' WHEN 'o' THEN 'open' END AS status FROM orders")
def _(t):
    return t.orders.select("o_orderkey", c.normalize_label(col("o_orderstatus"), {"f": "final", "o": "open"}).alias("status"))


@query("p10_assign_band", "SELECT event_id, CASE WHEN value BETWEEN 0 AND 2 THEN 'low' WHEN value BETWEEN 2 AND 5 THEN 'mid' ELSE 'high' END AS band FROM events WHERE value BETWEEN 0 AND 20")
def _(t):
    return t.events.select("event_id", c.assign_band(col("value"), [("low", 0, 2), ("mid", 2, 5), ("high", 5, 20)]).alias("band")).filter("band is not null")


@query("p11_trial_to_block", "SELECT o_orderkey, (o_orderkey // 20) + 1 AS block, o_orderkey % 20 + 1 AS trial, o_orderkey + 1 AS running FROM orders")
def _(t):
    n = col("o_orderkey") + 1
    block, trial = c.trial_to_block(n, 20), col("o_orderkey") % 20 + 1
    return t.orders.select("o_orderkey", block.alias("block"), trial.alias("trial"), c.block_trial_count(block, trial, 20).alias("running"))


@query("p12_code_factor", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN -0.5::DOUBLE WHEN 'O' THEN 0.5::DOUBLE END AS code FROM orders")
def _(t):
    return t.orders.select("o_orderkey", c.code_factor(col("o_orderstatus"), {"F": -0.5, "O": 0.5}).alias("code"))


@query("p13_status_fields", "SELECT o_orderkey, p AS paid, CASE WHEN p THEN 'pass' ELSE 'fail' END AS paid_status, CASE WHEN p THEN 'ok' ELSE 'low' END AS paid_reason_code, CASE WHEN p THEN 'enough' ELSE 'under limit' END AS paid_reason FROM (SELECT o_orderkey, coalesce(o_totalprice > 100000, false) AS p FROM orders)")
def _(t):
    return t.orders.select("o_orderkey", *c.status_fields("paid", col("o_totalprice") > 100000, ("ok", "enough"), ("low", "under limit")))


@query("p14_first_rule", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'hold' WHEN o_totalprice > 250000 THEN 'check' ELSE 'take' END AS decision, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 250000 THEN 'large' ELSE 'none' END AS code, CASE WHEN o_orderstatus = 'P' THEN 'still pending' WHEN o_totalprice > 250000 THEN 'large sum' ELSE 'no rule' END AS reason FROM orders")
def _(t):
    return t.orders.select("o_orderkey", *c.first_rule([(col("o_orderstatus") == "P", "hold", "pending", "still pending"), (col("o_totalprice") > 250000, "check", "large", "large sum")], ("take", "none", "no rule")))


@query("p15_issue_codes", "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, concat_ws(';', CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_tax = 0 THEN 'untaxed' END, CASE WHEN l_quantity > 40 THEN 'bulk' END) AS issues FROM lineitem")
def _(t):
    codes = c.issue_codes([(col("l_discount") > 0.05, "discount"), (col("l_tax") == 0, "untaxed"), (col("l_quantity") > 40, "bulk")])
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.array_join(codes, ";").alias("issues"))


@query("p16_flags", "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, (l_quantity > 45 OR l_extendedprice < 5000 OR (l_tax < 0.02 AND l_discount > 0.08)) AS incomplete, (l_quantity > 48 OR (l_extendedprice > 80000 AND abs(l_tax) > 0.05) OR (l_extendedprice > 90000 AND abs(l_tax) > 0.01)) AS gap FROM lineitem")
def _(t):
    a = c.incomplete_flag(col("l_quantity"), col("l_extendedprice"), col("l_tax"), col("l_discount"), max_gap=45, min_size=5000, min_length=0.02, max_shift=0.08)
    b = c.gap_flag(col("l_quantity"), col("l_extendedprice"), col("l_tax"), pause=48, levels=[(80000, 0.05), (90000, 0.01)])
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", a.alias("incomplete"), b.alias("gap"))


@query("p17_category_of", "SELECT o_orderkey, CASE WHEN o_custkey IN (1, 3, 5) THEN 'watch' WHEN o_custkey IN (2, 3) THEN 'special' ELSE 'regular' END AS category FROM orders")
def _(t):
    return t.orders.select("o_orderkey", c.category_of(col("o_custkey"), {"watch": [1, 3, 5], "special": [2, 3]}).alias("category"))


@query("f1_parse_name", "SELECT page_id, CASE WHEN regexp_matches(url, '^([a-z]+)://([^/]+)/([a-z]+)/') THEN regexp_extract(url, '^([a-z]+)://([^/]+)/([a-z]+)/', 1) END AS scheme, CASE WHEN regexp_matches(url, '^([a-z]+)://([^/]+)/([a-z]+)/') THEN regexp_extract(url, '^([a-z]+)://([^/]+)/([a-z]+)/', 3) END AS folder, CASE WHEN regexp_matches(url, '^([a-z]+)://([^/]+)/([a-z]+)/') THEN 'parsed' ELSE 'unparsed' END AS parse_status FROM pages")
def _(t):
    return t.pages.select("page_id", *c.parse_name(col("url"), "^([a-z]+)://([^/]+)/([a-z]+)/", ["scheme", "host", "folder"])).drop("host")


@query("f2_find_all", "SELECT page_id, array_to_string(regexp_extract_all(url, '[0-9]+'), ';') AS numbers FROM pages")
def _(t):
    return t.pages.select("page_id", c.find_all(col("url"), "[0-9]+").alias("numbers"))


@query("f3_numeric_stem", "SELECT doc_id, TRY_CAST(regexp_replace(source, '[^0-9]', '', 'g') AS BIGINT) AS stem FROM documents")
def _(t):
    return t.documents.select("doc_id", c.numeric_stem(col("source")).alias("stem"))


@query("f4_strip_ends", "SELECT p_partkey, substr(p_name, 2, greatest(length(p_name) - 3, 0)) AS core FROM part")
def _(t):
    return t.part.select("p_partkey", c.strip_ends(col("p_name"), 1, 2).alias("core"))


@query("f5_norm_name", "SELECT p_partkey, upper(trim(p_name)) AS name FROM part")
def _(t):
    return t.part.select("p_partkey", c.norm_name(col("p_name")).alias("name"))


@query("f6_pad_id", "SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 3 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 3, '0') END AS id FROM customer")
def _(t):
    return t.customer.select("c_custkey", c.pad_id(col("c_custkey"), 3).alias("id"))


@query("f7_has_token", "SELECT p_partkey, contains(lower(p_name), 'widget') AS widget FROM part")
def _(t):
    return t.part.select("p_partkey", c.has_token(col("p_name"), "Widget").alias("widget"))


@query("f8_classify_unit", "SELECT event_id, CASE event_type WHEN 'view' THEN 'calibrated' WHEN 'click' THEN 'digital' ELSE 'unknown' END AS unit_class FROM events")
def _(t):
    unit = c.case_map([(col("event_type") == "view", " µV "), (col("event_type") == "click", "ADC")], "ohm")
    return t.events.select("event_id", c.classify_unit(unit).alias("unit_class"))


@query("f9_file_role", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'concatenated' WHEN doc_id % 3 = 1 THEN 'split_part' ELSE 'single' END AS file_role, CASE WHEN doc_id % 3 = 1 THEN CAST(doc_id % 7 AS INTEGER) END AS part_number FROM documents")
def _(t):
    name = F.concat("source", c.case_map([(col("doc_id") % 3 == 0, "_concat.edf"), (col("doc_id") % 3 == 1, F.concat(F.lit("_Part"), (col("doc_id") % 7).cast("string"), F.lit(".edf")))], ".edf"))
    return t.documents.select("doc_id", *c.file_role(name))


@query("f10_digest_key", "SELECT event_id, substr(sha256('v1|' || CAST(user_id AS VARCHAR) || '|' || event_type), 1, 20) AS key FROM events")
def _(t):
    return t.events.select("event_id", c.digest_key(col("user_id"), col("event_type")).alias("key"))


@query("f11_first_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(t):
    return t.orders.select("o_orderkey", c.first_date(F.concat(F.lit("run "), col("o_orderdate").cast("string"), F.lit("; 2001-01-01"))).alias("day"))


@query("f12_length", f"WITH {EV} SELECT event_id, round(sqrt((value - 1) * (value - 1) + (k - 2) * (k - 2)), 6) AS d FROM ev")
def _(t):
    return rounded(t.ev().select("event_id", c.length_of(F.lit(1.0), F.lit(2.0), col("value"), col("k")).alias("d")))


@query("f14_bezier_points", f"WITH {EV} SELECT event_id, i AS point_index, round((1-i/5.0)*(1-i/5.0)*value + 2*(1-i/5.0)*(i/5.0)*1.0 + (i/5.0)*(i/5.0)*10.0, 6) AS x, round((1-i/5.0)*(1-i/5.0)*k + 2*(1-i/5.0)*(i/5.0)*2.0 + (i/5.0)*(i/5.0)*20.0, 6) AS y FROM ev, (SELECT CAST(unnest(range(5)) AS INTEGER) AS i)")
def _(t):
    seg = t.ev().select("event_id", col("value").alias("start_x"), col("k").cast("double").alias("start_y"), F.lit(10.0).alias("end_x"), F.lit(20.0).alias("end_y"), F.lit(1.0).alias("ctrl_x"), F.lit(2.0).alias("ctrl_y"))
    return rounded(c.bezier_points(seg, 5).select("event_id", "point_index", "x", "y"))


@query("f17_to_db", "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, CASE WHEN l_tax > 0 AND l_discount > 0 THEN round(10 * log10(l_tax / l_discount), 6) END AS db, CASE WHEN l_tax > 0 THEN round(log10(l_tax), 6) END AS log_power FROM lineitem")
def _(t):
    return rounded(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", c.to_db(col("l_tax"), col("l_discount")).alias("db"), c.log_power(col("l_tax")).alias("log_power")))


@query("f18_sphere_to_latlon", "SELECT vec_id, round(degrees(asin(z / sqrt(x*x + y*y + z*z))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon, CASE WHEN label % 2 = 0 THEN round(-x, 6) ELSE round(x, 6) END AS mirrored FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)")
def _(t):
    x, y, z = (F.get("embedding", F.lit(k)).cast("double") for k in range(3))
    hand = F.when(col("label") % 2 == 0, "left").otherwise("right")
    return rounded(t.embeddings.select("vec_id", *c.sphere_to_latlon(x, y, z), c.mirror(x, hand).alias("mirrored")))


@query("f19_tidy_coord", "SELECT c_custkey, round(c_acctbal / 100.0, 1) + 0.0 AS lat, CASE WHEN abs(round(c_acctbal / 100.0, 1)) >= 90 THEN 0.0 ELSE round(c_custkey / 7.0, 1) END AS lon FROM customer")
def _(t):
    return t.customer.select("c_custkey", *c.tidy_coord(col("c_acctbal") / 100.0, col("c_custkey") / 7.0))


@query("f20_scale_range", "SELECT o_orderkey, round(-1 + (o_totalprice - lo) / (hi - lo) * 2, 6) AS scaled FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def _(t):
    return rounded(c.scale_range(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", (-1.0, 1.0)).select("o_orderkey", "scaled"))


@query("f21_unit_disk", f"WITH {EV} SELECT event_id, round(value / r * (1 - 1e-6), 6) AS value_unit, round(k / r * (1 - 1e-6), 6) AS k_unit FROM ev, (SELECT max(sqrt(value * value + k * k)) AS r FROM ev)")
def _(t):
    return rounded(c.unit_disk(t.ev().select("event_id", "value", col("k").cast("double").alias("k")), "value", "k").select("event_id", "value_unit", "k_unit"))


@query("f22_extreme", "SELECT event_id, abs((value - 5) / 3) > 1.96 AS tail FROM events")
def _(t):
    return t.events.select("event_id", c.extreme((col("value") - 5) / 3, 1.96).alias("tail"))


@query("f23_to_sample", f"WITH {EV} SELECT event_id, CAST(round_even(floor(onset) * 10 + 0.0, 0) AS BIGINT) AS sample, CAST(floor(onset) * 10 AS BIGINT) + 11 AS n FROM ev")
def _(t):
    s = F.floor("onset").cast("double")
    return t.ev().select("event_id", c.to_sample(s, 10.0).alias("sample"), c.n_samples(F.lit(-1.0), s, 10.0).alias("n"))


@query("f24_mask_code", "SELECT event_id, event_id & 255 AS code FROM events")
def _(t):
    return t.events.select("event_id", c.mask_code(col("event_id"), 255).alias("code"))


@query("f25_rel_change", "SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, CASE WHEN l_tax <> 0 THEN round((l_discount - l_tax) / l_tax, 6) END AS change FROM lineitem")
def _(t):
    return rounded(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", c.rel_change(col("l_discount"), col("l_tax")).alias("change")))


@query("f26_mixture_label", "SELECT event_id, round(0.2 + (-ln(3.0) - (value - 9) * (value - 9) / 18) - (-ln(1.5) - (value - 2) * (value - 2) / 4.5), 6) AS log_odds FROM events")
def _(t):
    return rounded(t.events.select("event_id", c.mixture_label(col("value"), 2, 1.5, 9, 3.0, 0.2).alias("log_odds")))


@query("f27_slice", "SELECT vec_id, embedding[3:6] AS part FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", c.slice_by(col("embedding"), 2, 5).alias("part"))


@query("f28_span_mean", "SELECT vec_id, round((CAST(embedding[3] AS DOUBLE) + CAST(embedding[4] AS DOUBLE) + CAST(embedding[5] AS DOUBLE)) / 3, 6) AS mean FROM embeddings")
def _(t):
    return rounded(t.embeddings.select("vec_id", c.array_span_mean(col("embedding").cast("array<double>"), 2, 4).alias("mean")))


@query("f29_ptp_max_step", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_max(e) - list_min(e), 6) AS ptp, round(list_max(list_transform(range(1, len(e)), lambda i: abs(e[i + 1] - e[i]))), 6) AS step FROM v")
def _(t):
    e = col("embedding").cast("array<double>")
    return rounded(t.embeddings.select("vec_id", c.ptp(e).alias("ptp"), c.max_step(e).alias("step")))


@query("f30_repeat_rows", "SELECT o_orderkey, CAST(unnest(range(3)) AS INTEGER) AS copy FROM orders")
def _(t):
    return c.repeat_rows(t.orders.select("o_orderkey"), 3)


@query("f31_parse_tuples", f"WITH {EV} SELECT event_id, CAST(k AS DOUBLE) AS first, CAST(k + 1 AS DOUBLE) AS last FROM ev")
def _(t):
    text = F.concat(F.lit("[("), col("k").cast("string"), F.lit(", 1.5), ("), (col("k") + 1).cast("string"), F.lit(", 2)]"))
    arr = c.parse_tuples(text)
    return t.ev().select("event_id", arr[0][0].alias("first"), arr[1][0].alias("last"))


@query("f32_json_element", f"WITH {EV} SELECT event_id, CASE WHEN event_type = 'view' THEN k END AS onset FROM ev")
def _(t):
    text = F.to_json(F.array(F.struct(F.when(col("event_type") == "view", "start").otherwise("stop").alias("role"), col("k").alias("at")), F.struct(F.lit("stop").alias("role"), F.lit(0).cast("bigint").alias("at"))))
    return t.ev().select("event_id", c.json_element(text, "start", "at bigint")["at"].alias("onset"))


@query("f33_count_json", "SELECT user_id, '{' || string_agg('\"' || event_type || '\":' || n, ',' ORDER BY event_type) || '}' AS counts FROM (SELECT user_id, event_type, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(c.count_json(F.collect_list("event_type")).alias("counts"))


@query("f34_codes", "SELECT user_id, CAST(count(DISTINCT event_type) AS INTEGER) AS n_codes, bool_or(event_type = 'error') AS has_error FROM events GROUP BY 1")
def _(t):
    lists = t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("codes"))
    return lists.select("user_id", F.size(c.split_codes(col("codes"))).alias("n_codes"), c.has_code(col("codes"), "error").alias("has_error"))


@query("f35_code_candidate", "SELECT o_orderkey, CASE o_custkey WHEN 3 THEN 30 WHEN 4 THEN 40 ELSE o_custkey END AS candidate_code, CASE WHEN o_custkey IN (3, 4) THEN 'mapped' ELSE 'identity' END AS candidate_rule FROM orders")
def _(t):
    return t.orders.select("o_orderkey", *c.code_candidate(col("o_custkey"), {3: 30, 4: 40}))


@query("f36_next_label", "SELECT event_id, CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'purchase' WHEN 'purchase' THEN 'view' END AS next FROM events")
def _(t):
    return t.events.select("event_id", c.next_label(col("event_type"), ["view", "click", "purchase"]).alias("next"))


@query("f38_unscale", "SELECT o_orderkey, round((o_totalprice - m) / s * s + m, 2) AS back FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)")
def _(t):
    stats = F.broadcast(t.orders.agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s")))
    z = (col("o_totalprice") - col("m")) / col("s")
    return rounded(t.orders.crossJoin(stats).select("o_orderkey", c.unscale(z, col("m"), col("s")).alias("back")), 2)


@query("f13_f15_f16_bezier", f"""WITH {EV}, g AS (SELECT event_id, value AS sx, CAST(k AS DOUBLE) AS sy, 100.0 AS ex, 20.0 AS ey, 3.0 AS cx, 150.0 AS cy FROM ev),
  b AS (SELECT *, 2 * (cx - sx) * 0.5 + 2 * (ex - cx) * 0.5 AS dx, 2 * (cy - sy) * 0.5 + 2 * (ey - cy) * 0.5 AS dy, 2 * (ex - 2 * cx + sx) AS ddx, 2 * (ey - 2 * cy + sy) AS ddy FROM g)
  SELECT event_id, round((dx * ddy - dy * ddx) / pow(dx * dx + dy * dy, 1.5), 6) AS curvature, round(sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) / 10.0, 6) AS sinuosity FROM b""")
def _(t):
    sx, sy, ex, ey, cx, cy = col("value"), col("k").cast("double"), F.lit(100.0), F.lit(20.0), F.lit(3.0), F.lit(150.0)
    return rounded(t.ev().select("event_id", c.bezier_curvature(F.lit(0.5), sx, sy, ex, ey, cx, cy).alias("curvature"), c.sinuosity(c.length_of(sx, sy, ex, ey), F.lit(10.0)).alias("sinuosity")))


@query("u2_with_all", "SELECT o_orderkey, o_orderstatus AS grp FROM orders UNION ALL SELECT o_orderkey, 'all' FROM orders")
def _(t):
    return shape.with_all(t.orders.select("o_orderkey", col("o_orderstatus").alias("grp")), "grp")
