"""Every query of the catalogue over a small scale, against its SQL in DuckDB."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tidemark.catalog import ORACLES, QUERIES


def plain(v):
    """One form for values of both engines."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float):
        return float(f"{v:.10g}")
    if type(v).__name__ == "Decimal":
        return float(v)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


#: Queries that print, round or break ties, which a larger scale tries harder.
LARGER = ["narrative_template", "signals_c1_c6", "decide_abstain", "fmt_inr", "index_topk", "cause_sets", "bootstrap_ranking", "rolling_origin", "driver_lags", "freshness_timers", "insight_chain", "effective_dates"]


@pytest.fixture(scope="module")
def duck(sf):
    return views(sf)


def views(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    if name not in ORACLES:
        assert got.collect()
        return
    equal(got, duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", LARGER)
def test_query_at_a_larger_scale(spark, name):
    sf = "/root/testdata/sf0.01"
    equal(QUERIES[name](spark, sf), views(sf).sql(ORACLES[name]))


def equal(got, want):
    rows = got.collect()
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    a = sorted((tuple(plain(v) for v in r) for r in rows), key=str)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert a == b
