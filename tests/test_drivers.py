"""Lags, coefficients and mediators that are planted."""

import numpy as np
import pytest

from tidemark.operators import drivers as D


def edges(spark, rows):
    return spark.createDataFrame(rows, D.EDGES)


def test_reachability(spark):
    e = edges(spark, [("b", "a", 0, 0), ("c", "b", 0, 0), ("d", "c", 0, 0), ("d", "x", 0, 0), ("a", "d", 0, 0)])  # a to d and back
    got = {(r["source"], r["target"]) for r in D.reachable(e).collect()}
    assert got == {(s, t) for s in "abcd" for t in "abcd"} | {("x", t) for t in "abcd"}
    chain = edges(spark, [(f"n{i + 1}", f"n{i}", 0, 0) for i in range(12)])
    assert D.reachable(chain).count() == 12 * 13 // 2


def test_mediators_are_left_out(spark):
    e = edges(spark, D.UNITS)
    got = {(r["driver"], r["other"]) for r in D.controls(e, "units").collect()}
    assert got == {("price", "discount"), ("price", "breadth"), ("discount", "breadth"), ("breadth", "price"), ("breadth", "discount")}


@pytest.fixture(scope="module")
def planted(spark):
    """Units follow spend three weeks later (0.5), and price at once (-1.2); spend lowers the price too (-0.4), which is the
    rest of its effect at lag 3 by way of a mediator."""
    rng = np.random.default_rng(3)
    rows = []
    for s in ("north", "south"):
        n = 260
        spend = rng.normal(0, 1, n)
        price = -0.4 * np.r_[np.zeros(3), spend[:-3]] + rng.normal(0, 0.5, n)
        noise = np.zeros(n)
        for t in range(1, n):
            noise[t] = 0.4 * noise[t - 1] + rng.normal(0, 0.15)
        units = 5 + 0.5 * np.r_[np.zeros(3), spend[:-3]] - 1.2 * price + noise
        rows += [(s, t, m, float(v)) for m, ys in (("units", units), ("spend", spend), ("price", price)) for t, v in enumerate(ys)]
    graph = [("units", "spend", 0, 6), ("units", "price", 0, 2), ("price", "spend", 3, 3)]
    return spark.createDataFrame(rows, "series string, t int, measure string, y double"), edges(spark, graph)


def test_planted_lags_and_effects(spark, planted):
    panel, graph = planted
    lags = {(r["series"], r["driver"]): r["lag"] for r in D.choose_lags(panel, graph, "units").collect()}
    assert lags == {(s, d): k for s in ("north", "south") for d, k in (("spend", 3), ("price", 0))}
    got = {(r["series"], r["driver"]): r for r in D.effects(panel, graph, "units").collect()}
    for s in ("north", "south"):
        spend, price = got[s, "spend"], got[s, "price"]
        assert spend["beside"] == "" and spend["beta"] == pytest.approx(0.5 + 1.2 * 0.4, rel=0.2)  # direct, and through the price
        assert price["beside"] == "spend" and price["beta"] == pytest.approx(-1.2, rel=0.2)
        assert 0 < price["hac_se"] < 0.2 and abs(spend["beta"] - 0.98) < 4 * spend["hac_se"]


def test_a_window_without_the_lag_finds_little(spark, planted):
    panel, _ = planted
    got = D.choose_lags(panel, edges(spark, [("units", "spend", 5, 6)]), "units").collect()
    assert all(abs(r["r"]) < 0.3 for r in got)
