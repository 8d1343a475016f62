"""Eligibility by policy tables (V19, V20): rules are data, derivatives are joined per key, every row keeps its reasons.

A policy is an ordered list of gates; a gate holds if all its terms (field, test, value) hold, and the first gate that holds decides.
Tests: ``eq``, ``ne``, ``in``, ``not_in`` (values parted by ``;``), ``lt``, ``le``, ``gt``, ``ge`` (numbers), ``contains`` (text), ``null``,
``not_null``. A test of a missing value is false, but for ``null``. A gate without terms always holds. Gates that tag instead of
deciding collect their codes. Policies are definitions: a table of at most 10,000 terms, read once and turned into one expression, so
all policies are evaluated in one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .joins import MAX_DEFINITIONS

Keys = Sequence[str]

#: Columns of a policy table, a row per term (or one with a null field for a gate without terms). ``decision`` is include, exclude or tag.
POLICY = "policy string, step int, decision string, code string, reason string, field string, test string, value string"


def _holds(field: str, test: str, value: str | None) -> Column:
    x, text = F.col(field), F.col(field).cast("string")
    tests = {
        "eq": lambda: text == value, "ne": lambda: text != value, "in": lambda: text.isin(value.split(";")), "not_in": lambda: ~text.isin(value.split(";")),
        "lt": lambda: x < float(value), "le": lambda: x <= float(value), "gt": lambda: x > float(value), "ge": lambda: x >= float(value),
        "contains": lambda: text.contains(value), "null": lambda: x.isNull(), "not_null": lambda: x.isNotNull(),
    }
    if test not in tests:
        raise ValueError(f"no test {test!r}; there are {sorted(tests)}")
    return F.coalesce(tests[test](), F.lit(False))


def read_policies(table: DataFrame) -> dict[str, list[tuple[Column, str, str, str]]]:
    """Per policy its gates in order of ``step``: (condition, decision, code, reason)."""
    rows = table.select("policy", "step", "decision", "code", "reason", "field", "test", "value").limit(MAX_DEFINITIONS + 1).collect()
    if len(rows) > MAX_DEFINITIONS:
        raise ValueError(f"more than {MAX_DEFINITIONS} terms")
    gates: dict[tuple, list] = {}
    for r in rows:
        gates.setdefault((r["policy"], r["step"]), []).append(r)
    out: dict[str, list[tuple[Column, str, str, str]]] = {}
    for (policy, step), terms in sorted(gates.items()):
        heads = {(t["decision"], t["code"], t["reason"]) for t in terms}
        if len(heads) > 1 or next(iter(heads))[0] not in ("include", "exclude", "tag"):
            raise ValueError(f"gate {step} of {policy!r} must have one decision (include, exclude, tag), code and reason")
        conditions = [_holds(t["field"], t["test"], t["value"]) for t in terms if t["field"] is not None]
        out.setdefault(policy, []).append((reduce(lambda a, b: a & b, conditions, F.lit(True)), *next(iter(heads))))
    return out


def policy_decisions(df: DataFrame, policies: DataFrame) -> DataFrame:
    """One row per row and policy: ``policy``, ``eligible``, ``status``, ``reason_code``, ``reason`` and ``tags`` (codes of all tagging gates that hold)."""
    made = []
    for name, gates in read_policies(policies).items():
        deciding, tags = [g for g in gates if g[1] != "tag"], [(g[0], g[2]) for g in gates if g[1] == "tag"]
        decision, code, reason = c.first_rule(deciding, ("exclude", "no_gate", "no gate of the policy holds")) if deciding else [F.lit("exclude").alias("decision"), F.lit("no_gate").alias("code"), F.lit("no gate of the policy holds").alias("reason")]
        eligible = decision == "include"
        codes = F.array_join(c.issue_codes(tags), ";") if tags else F.lit("")
        made.append(F.struct(F.lit(name).alias("policy"), eligible.alias("eligible"), F.when(eligible, "eligible").otherwise("ineligible").alias("status"), code.alias("reason_code"), reason.alias("reason"), codes.alias("tags")))
    return df.withColumn("__d", F.explode(F.array(*made))).select(*df.columns, "__d.*")


def derivative_statuses(df: DataFrame, derivatives: DataFrame, on: Keys, kinds: Sequence[str], kind: str = "kind") -> DataFrame:
    """Per kind of derivative a status family (flag, status, code, reason) from the table (``on``, kind): available, missing, several, or the row has no unit.

    Derivatives are counted per unit before the join, so repeated ones add no rows.
    """
    have = derivatives.groupBy(*on).agg(*[F.count_if(F.col(kind) == k).alias(f"__n_{k}") for k in kinds])
    out = df.join(have, list(on), "left")
    for k in kinds:
        n = F.coalesce(f"__n_{k}", F.lit(0))
        mapped = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in on])
        code = F.when(~mapped, "no_unit").when(n == 0, f"{k}_missing").when(n > 1, f"{k}_ambiguous").otherwise(f"{k}_available")
        text = F.when(~mapped, "the row names no unit").when(n == 0, f"no {k} derivative is linked to the unit").when(n > 1, f"several {k} derivatives are linked to the unit").otherwise(f"one {k} derivative is linked to the unit")
        fine = mapped & (n == 1)
        out = out.withColumns({f"{k}_available": fine, f"{k}_status": F.when(fine, "available").otherwise("unavailable"), f"{k}_reason_code": code, f"{k}_reason": text})
    return out.drop(*[f"__n_{k}" for k in kinds])


def readiness(df: DataFrame, needed: str) -> DataFrame:
    """A row is ready if its policy takes it and the derivative it needs is there; the reason names what fails first."""
    ready = F.col("eligible") & F.col(f"{needed}_available")
    code = F.when(~F.col("eligible"), F.concat(F.lit("policy_"), "reason_code")).when(~F.col(f"{needed}_available"), F.col(f"{needed}_reason_code")).otherwise("ready")
    return df.withColumns({"ready": ready, "readiness_code": code})


def canonical_key(version: str, present: Column, observed: Sequence[str], expected: Sequence[str]) -> tuple[Column, Column]:
    """(readable basis, versioned digest): observed rows are named by ``observed`` fields, others by ``expected`` ones."""
    text = lambda kind, names: F.concat_ws("|", F.lit(kind), *[F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit(""))) for n in names])
    basis = F.when(present, text("observed", observed)).otherwise(text("expected_only", expected))
    return basis, F.concat(F.lit(f"{version}:"), F.substring(F.sha2(basis, 256), 1, 20))


def policy_ledger(rows: DataFrame, policies: DataFrame, derivatives: DataFrame, on: Keys, kinds: Sequence[str], needed: str, present: Column, observed: Keys, expected: Keys, version: str = "v1") -> DataFrame:
    """One row per trial and policy with its decision, tags, derivative statuses, readiness and key.

    ``rows`` are audited trials with what gates read; ``on`` names the unit that derivatives belong to, ``needed`` the kind without which
    no row is ready; ``present`` says whether the trial was observed.
    """
    basis, key = canonical_key(version, F.coalesce(present, F.lit(False)), observed, expected)
    keyed = rows.withColumns({"key_basis": basis, "trial_key": key})
    return readiness(policy_decisions(derivative_statuses(keyed, derivatives, on, kinds), policies), needed)


def reason_counts(ledger: DataFrame, on: Keys, dims: Keys = ("policy", "status", "reason_code")) -> DataFrame:
    """Rows, units, ready rows and share of the policy's rows, by policy and reason."""
    counts = ledger.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*on).alias("n_units"), F.count_if("ready").alias("n_ready"))
    whole = ledger.groupBy("policy").agg(F.count(F.lit(1)).alias("__all"))
    return counts.join(whole, "policy").withColumn("share", F.col("n") / F.col("__all")).drop("__all")
