"""Policies as data, derivative statuses, and continuity classes planted one by one."""

import pytest
from pyspark.sql import functions as F

from epochlake.operators import continuity, policies


def gates(spark, rows):
    return spark.createDataFrame(rows, policies.POLICY)


def test_gates_decide_in_order_and_missing_values_fail(spark):
    table = gates(spark, [
        ("a", 30, "include", "rest", "", None, None, None),
        ("a", 10, "exclude", "low", "", "x", "lt", "5"),
        ("a", 20, "exclude", "named", "", "name", "in", "p;q"),
        ("a", 20, "exclude", "named", "", "x", "ge", "7"),
        ("a", 1, "tag", "odd", "", "x", "in", "5;7;9"),
        ("a", 2, "tag", "nameless", "", "name", "null", None),
        ("b", 1, "include", "big", "", "x", "gt", "6"),
    ])
    rows = spark.createDataFrame([(1, 3.0, "p"), (2, 6.0, "p"), (3, 7.0, "q"), (4, None, None), (5, 9.0, "z")], "id int, x double, name string").withColumn("x", F.col("x").cast("int"))
    got = {(r["id"], r["policy"]): (r["eligible"], r["reason_code"], r["tags"]) for r in policies.policy_decisions(rows, table).collect()}
    assert got == {
        (1, "a"): (False, "low", ""), (2, "a"): (True, "rest", ""), (3, "a"): (False, "named", "odd"), (4, "a"): (True, "rest", "nameless"), (5, "a"): (True, "rest", "odd"),
        (1, "b"): (False, "no_gate", ""), (2, "b"): (False, "no_gate", ""), (3, "b"): (True, "big", ""), (4, "b"): (False, "no_gate", ""), (5, "b"): (True, "big", ""),
    }
    with pytest.raises(ValueError, match="test"):
        policies.read_policies(gates(spark, [("a", 1, "include", "x", "", "x", "like", "y")]))
    with pytest.raises(ValueError, match="one decision"):
        policies.read_policies(gates(spark, [("a", 1, "include", "x", "", "x", "eq", "1"), ("a", 1, "exclude", "x", "", "x", "eq", "2")]))


def test_derivatives_and_readiness(spark):
    rows = spark.createDataFrame([(1, True, "ok"), (2, True, "ok"), (3, True, "ok"), (4, False, "bad"), (None, True, "ok")], "unit int, eligible boolean, reason_code string")
    kinds = spark.createDataFrame([(1, "post"), (2, "pre"), (3, "post"), (3, "post"), (4, "post"), (9, "post")], "unit int, kind string")
    out = policies.readiness(policies.derivative_statuses(rows, kinds, ["unit"], ["post", "pre"]), "post")
    assert {r["unit"]: (r["post_status"], r["pre_available"], r["ready"], r["readiness_code"]) for r in out.collect()} == {
        1: ("available", False, True, "ready"), 2: ("unavailable", True, False, "post_missing"), 3: ("unavailable", False, False, "post_ambiguous"),
        4: ("available", False, False, "policy_bad"), None: ("unavailable", False, False, "no_unit"),
    }


def test_continuity_classes(spark):
    files = {
        "single": {"f1": [(1, 0), (2, 10), (3, 20)]},
        "split": {"f1": [(1, 0), (2, 10)], "f2": [(3, 20), (4, 30)], "f3": [(5, 40)]},
        "split_with_gap": {"f1": [(1, 0), (2, 10)], "f2": [(6, 20)]},
        "concatenated": {"f1": [(1, 0), (2, 10), (1, 20), (2, 30)]},
        "restarted": {"f1": [(1, 0), (2, 10), (3, 15)], "f2": [(2, 20), (3, 30), (4, 40)]},
        "overlapping": {"f1": [(1, 0), (4, 30)], "f2": [(2, 10), (3, 20)]},
    }
    trials = spark.createDataFrame([(u, f, n, float(at)) for u, fs in files.items() for f, rows in fs.items() for n, at in rows], "unit string, file string, number int, onset double")
    chain = continuity.file_chain(continuity.file_spans(trials, ["unit"], "file", "number", "onset"), ["unit"], "file")
    classes = {r["unit"]: r for r in continuity.unit_classes(chain, ["unit"]).collect()}
    assert {u: r["continuity"] for u, r in classes.items()} == {u: u for u in files}
    assert (classes["split"]["n_chains"], classes["restarted"]["n_chains"], classes["overlapping"]["n_chains"]) == (1, 2, 2)
    assert (classes["split_with_gap"]["n_missing"], classes["restarted"]["n_repeated"], classes["concatenated"]["n_restarts"]) == (3, 2, 1)
    assert {r["file"]: r["relation"] for r in chain.filter("unit = 'split'").collect()} == {"f1": "first", "f2": "continues", "f3": "continues"}
    marked = continuity.file_spans(trials.filter("unit = 'single'"), ["unit"], "file", "number", "onset", restart=F.col("onset") == 20)
    assert marked.first()["n_restarts"] == 1


def test_continuity_audit_counts(spark):
    trials = spark.createDataFrame([("u", "f1", 1, 0.0), ("u", "f1", 2, 5.0), ("u", "f2", 3, 9.0)], "unit string, file string, number int, onset double")
    audit = spark.createDataFrame([("u", "f1", "both", ""), ("u", "f1", "both", "mismatch"), ("u", "f2", "left_only", "no_expected_trial"), ("u", None, "right_only", "no_observed_trial")], "unit string, file string, join_status string, issues string")
    rows = {(r["row_kind"], r["file"]): r for r in continuity.continuity_audit(trials, audit, ["unit"], "file", "number", "onset").collect()}
    assert set(rows) == {("split_part", "f1"), ("split_part", "f2"), ("unit_total", None)}
    assert [rows[("unit_total", None)][x] for x in ("n_trials", "join_rows", "matched_rows", "raw_only_rows", "offset_only_rows", "strict_clean_rows")] == [3, 4, 2, 1, 1, 1]
    assert (rows[("split_part", "f1")]["observation"], rows[("split_part", "f2")]["observation"]) == ("no_problem_visible", "not_resolved_on_join")
