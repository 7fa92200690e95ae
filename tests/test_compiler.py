"""Nobody gets data past a contract."""

import pytest
from pyspark.sql import functions as F

from tidemark.contracts import CONTRACTS, Session
from tidemark.plans.compiler import MASKED, AuditLog, Denied, compile_measure, national_total

CFO = Session("ana", "cfo")
RSM = Session("ravi", "rsm", {"region": "ASIA"})


@pytest.mark.parametrize("role", ["guest", "rsm", "intern"])
def test_denied_by_default_and_by_rule(spark, sf, role):
    with pytest.raises(Denied) as e:
        compile_measure(spark, sf, "blended_roas", ["iso_week"], Session("x", role, {"region": "ASIA"}))
    assert e.value.row[1:3] == (role, "blended_roas") and e.value.row[3]


def test_alias_has_the_same_policy():
    assert CONTRACTS["net_revenue"].policy("rsm_north") == CONTRACTS["net_revenue"].policy("rsm")


def test_rows_outside_the_region_never_leak(spark, sf):
    out = compile_measure(spark, sf, "net_revenue", ["region"], RSM).collect()
    assert {r["region"] for r in out} <= {"ASIA"}
    assert compile_measure(spark, sf, "net_revenue", ["region"], RSM, {"region": ["EUROPE"]}).count() == 0


def test_headline_is_national(spark, sf):
    whole = compile_measure(spark, sf, "net_revenue", ["region"], CFO).agg(F.sum("net_revenue")).first()[0]
    assert national_total(spark, sf, "net_revenue", RSM).first()[0] == pytest.approx(whole)


def test_masked_values_are_never_computed(spark, sf):
    df = compile_measure(spark, sf, ["margin_pct", "unit_volume"], ["category"], RSM)
    assert {r["margin_pct"] for r in df.collect()} == {MASKED}
    assert "p_retailprice" not in df._jdf.queryExecution().executedPlan().toString()


def test_row_filter_reaches_the_scan(spark, sf):
    plan = compile_measure(spark, sf, "net_revenue", ["category"], RSM)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(r_name,ASIA)" in plan and "l_comment" not in plan


@pytest.mark.parametrize("value", ["ASIA' OR '1'='1", "'; drop table sales; --", "ASIA\\' or true"])
def test_values_cannot_change_the_query(spark, sf, value):
    assert compile_measure(spark, sf, "unit_volume", ["region"], CFO, {"region": [value]}).count() == 0


@pytest.mark.parametrize("bad", ["1; select 1", "o_custkey", "cost_e4", "region) or (1=1"])
def test_only_dimensions_are_names(spark, sf, bad):
    with pytest.raises(ValueError):
        compile_measure(spark, sf, "unit_volume", [bad], CFO)
    with pytest.raises(ValueError):
        compile_measure(spark, sf, "unit_volume", ["region"], CFO, {bad: ["x"]})


def test_audit_has_every_request(spark, sf):
    log = AuditLog(spark)
    for n, session in enumerate((CFO, RSM, Session("g", "guest"))):
        for kpi, c in CONTRACTS.items():
            try:
                compile_measure(spark, sf, kpi, [c.dimensions[0]], session, log=log)
            except Denied:
                pass
        rows = log.read().collect()  # appended, never rewritten
        assert len(rows) == (n + 1) * len(CONTRACTS)
    assert all(r["outcome"] == "denied" and r["reason"] for r in rows if r["role"] == "guest")
    assert all(len(r["plan_sha256"]) == 64 and r["request"].startswith(r["kpi"]) for r in rows if r["outcome"] == "allowed")
    assert {r["request"].split("|")[2] for r in rows if r["role"] == "rsm" and r["outcome"] == "allowed"} == {"region=ASIA"}
