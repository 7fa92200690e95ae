"""KPI contracts: what a measure is, who may see it, and the limits that decide about its movements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Access of a role: all, rows, mask or deny; rows: column that must equal the session's attribute."""

    access: str = "all"
    row_filter: tuple[str, str] | None = None
    masked: tuple[str, ...] = ()
    reason: str = ""


@dataclass(frozen=True)
class Contract:
    kpi: str
    fact: str
    unit: str
    tier: int
    dimensions: tuple[str, ...]
    measure: Callable[[], Column]
    policies: dict[str, Policy] = field(default_factory=dict)
    z_threshold: float = 3.0
    fdr_q: float = 0.05
    persistence: int = 3
    floor_abs: float = 0.0
    floor_pct: float = 0.0
    min_history: int = 28
    sla_hours: int = 30
    restatement_days: int = 0
    psi_limit: float = 0.2
    sources: tuple[str, ...] = ()

    def policy(self, role: str) -> Policy:
        """Roles that a contract doesn't list are denied."""
        return self.policies.get(ALIASES.get(role, role), Policy("deny", reason="role not listed"))


@dataclass(frozen=True)
class Session:
    user: str
    role: str
    attributes: dict[str, str] = field(default_factory=dict)


ALIASES = {"rsm_north": "rsm", "analyst": "analyst_full"}
_ALL = {"cfo": Policy(), "analyst_full": Policy()}
_DENY = Policy("deny", reason="aggregate revenue is restricted")


def _ratio(a: str, b: str) -> Column:
    """A ratio of sums, never a mean of ratios; no denominator, no value."""
    return F.sum(a) / F.nullif(F.sum(b), F.lit(0))


_SALES = ("region", "nation", "category", "sales_channel", "segment", "sku", "d", "iso_week")
CONTRACTS = {
    c.kpi: c
    for c in (
        Contract("net_revenue", "sales", "INR", 1, _SALES, lambda: (F.sum("net_e4") - F.sum("ret_e4")) / 10000.0, {**_ALL, "rsm": Policy("rows", ("region", "region"), ("margin_pct", "discount_depth")), "marketing_lead": Policy("mask", masked=("margin_pct",)), "intern": _DENY}, floor_abs=1e6, floor_pct=0.02, sources=("oms",)),
        Contract("unit_volume", "sales", "units", 2, _SALES, lambda: F.sum("units"), {**_ALL, "rsm": Policy("rows", ("region", "region"))}, sources=("oms",)),
        Contract("asp", "sales", "INR", 2, _SALES, lambda: _ratio("net_e4", "units") / 10000.0, {**_ALL, "rsm": Policy("rows", ("region", "region"))}, sources=("oms",)),
        Contract("margin_pct", "sales", "ratio", 2, _SALES, lambda: 1 - _ratio("cost_e4", "net_e4"), {**_ALL, "rsm": Policy("mask", ("region", "region"), ("margin_pct",)), "marketing_lead": Policy("mask", masked=("margin_pct",))}, sources=("oms", "erp")),
        Contract("discount_depth", "sales", "ratio", 3, _SALES, lambda: F.sum("discount_e4") / (10000.0 * F.count(F.lit(1))), {**_ALL, "rsm": Policy("mask", ("region", "region"), ("discount_depth",))}, sources=("oms",)),
        Contract("returns_rate", "sales", "ratio", 3, _SALES, lambda: _ratio("ret_e4", "net_e4"), {**_ALL, "rsm": Policy("rows", ("region", "region"))}, sources=("oms",)),
        Contract("order_fill_rate", "fulfilment", "percent", 2, ("warehouse", "region", "sku", "d"), lambda: _ratio("shipped_ok", "ordered"), {**_ALL, "rsm": Policy("rows", ("region", "region")), "intern": Policy("mask", masked=("supplier_name",))}, persistence=2, floor_abs=0.03, sla_hours=72, sources=("wms",)),
        Contract("marketing_spend", "marketing", "INR", 2, ("iso_week", "media_channel"), lambda: F.sum("spend_e2") / 100.0, {**_ALL, "marketing_lead": Policy()}, restatement_days=14, sla_hours=56, sources=("martech",)),
        Contract("blended_roas", "marketing", "ratio", 2, ("iso_week",), lambda: _ratio("attributed_e2", "spend_e2"), {**_ALL, "marketing_lead": Policy(), "rsm": Policy("deny", reason="marketing domain"), "intern": Policy("deny", reason="marketing domain")}, z_threshold=2.5, persistence=2, floor_pct=0.1, floor_abs=5e5, min_history=8, sla_hours=56, restatement_days=14, psi_limit=0.25, sources=("martech", "oms")),
    )
}
