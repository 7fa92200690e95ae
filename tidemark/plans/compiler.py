"""The only way from a contract to data: measures with row filters, masks and denials compiled in.

Identifiers come from the contract's dimensions, values travel as literals, so no filter value can change the query.
The row filter is applied to the fact itself, below anything a caller asks for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import CONTRACTS, Contract, Session
from tidemark.session import work_dir
from tidemark.sources import tables

MASKED = "MASKED"
FACT_TABLES = {"sales": tables.sales, "fulfilment": tables.fulfilment, "marketing": tables.marketing}


class Denied(Exception):
    def __init__(self, session: Session, kpi: str, reason: str) -> None:
        super().__init__(f"{session.role} may not see {kpi}: {reason}")
        self.row = (session.user, session.role, kpi, reason)


class AuditLog:
    """An append-only table of requests: who asked for what, whether it was compiled, and the hash of what was compiled."""

    SCHEMA = "n int, user string, role string, kpi string, outcome string, reason string, request string, plan_sha256 string"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path, self.n = spark, path or work_dir(spark, "audit"), 0

    def note(self, session: Session, kpi: str, outcome: str, reason: str, request: str) -> None:
        """Write a row at once: what was asked for stays on record though the driver dies before it is answered."""
        row = (self.n, session.user, session.role, kpi, outcome, reason, request, hashlib.sha256(request.encode()).hexdigest())
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").partitionBy("outcome").parquet(self.path)
        self.n += 1

    def read(self) -> DataFrame:
        """The whole log."""
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)


def request_text(kpis: Sequence[str], grain: Sequence[str], rows: Sequence[tuple[str, str]], masked: Sequence[str], filters: dict[str, Sequence] | None) -> str:
    """What is compiled, in one order: measures, grain, row filters, masks and the caller's filters."""
    asked = ";".join(f"{c}={','.join(map(str, v))}" for c, v in sorted((filters or {}).items()))
    return f"{','.join(kpis)}|{','.join(grain)}|{';'.join(f'{c}={v}' for c, v in sorted(rows))}|{','.join(sorted(masked))}|{asked}"


def _fact(spark: SparkSession, sf_dir: str, contract: Contract) -> DataFrame:
    fact = FACT_TABLES[contract.fact](spark, sf_dir)
    return fact.withColumn("iso_week", tables.iso_week(F.col("d"))) if "iso_week" in contract.dimensions and "d" in fact.columns else fact


def compile_measure(spark: SparkSession, sf_dir: str, kpi: str | Sequence[str], grain: Sequence[str], session: Session, filters: dict[str, Sequence] | None = None, log: AuditLog | None = None) -> DataFrame:
    """grain columns and one column for each KPI, which share a fact. A masked KPI is the text MASKED in each row."""
    contracts = [CONTRACTS[k] for k in ([kpi] if isinstance(kpi, str) else kpi)]
    first = contracts[0]
    rows, masked = set(), set()
    for c in contracts:
        policy = c.policy(session.role)
        if policy.access == "deny":
            if log:
                log.note(session, c.kpi, "denied", policy.reason, "")
            raise Denied(session, c.kpi, policy.reason)
        if policy.row_filter:
            column, attribute = policy.row_filter
            rows.add((column, session.attributes[attribute]))
        masked |= set(policy.masked)
    unknown = [g for g in (*grain, *(filters or {})) if g not in first.dimensions]
    if unknown or any(c.fact != first.fact for c in contracts):
        raise ValueError(f"not dimensions of {first.kpi}: {unknown}")
    if log:
        text = request_text([c.kpi for c in contracts], grain, sorted(rows), masked & {c.kpi for c in contracts}, filters)
        for c in contracts:
            log.note(session, c.kpi, "allowed", "", text)
    fact = _fact(spark, sf_dir, first)
    for column, value in sorted(rows):
        fact = fact.where(F.col(column) == F.lit(value))
    for column, values in (filters or {}).items():
        fact = fact.where(F.col(column).isin(*[F.lit(v) for v in values]))
    measures = [F.when(F.count(F.lit(1)) >= 0, F.lit(MASKED)).alias(c.kpi) if c.kpi in masked else c.measure().alias(c.kpi) for c in contracts]
    return fact.groupBy(*grain).agg(*measures)


def national_total(spark: SparkSession, sf_dir: str, kpi: str, session: Session) -> DataFrame:
    """The headline without dimensions, which roles with a row filter see whole."""
    policy = CONTRACTS[kpi].policy(session.role)
    if policy.access == "deny":
        raise Denied(session, kpi, policy.reason)
    return _fact(spark, sf_dir, CONTRACTS[kpi]).agg(CONTRACTS[kpi].measure().alias(kpi))
