"""Planted causes over several dimensions, overlaps by brute force, reversals, and the bootstrap's shares."""

import itertools
import random
from functools import partial

import pytest

from tidemark.operators import causes

DIMS = ("region", "category", "channel")
VALUES = {"region": "ABCDE", "category": "pqrst", "channel": "xyz"}
SCHEMA = "y int, region string, category string, channel string, a long, f long, ua long, uf long, n long"
_sets = partial(causes._sets, DIMS, 2)


def cube(spark, change, seed=1, scope=2020):
    """Leaves of about 1000; change(region, category, channel) is the factor on this period's value."""
    rng = random.Random(seed)
    rows = []
    for r, c, h in itertools.product(*VALUES.values()):
        f = rng.randint(900, 1100) * 10000
        a = int(f * change(r, c, h) * rng.uniform(0.995, 1.005))
        rows.append((scope, r, c, h, a, f, a // 10000, f // 10000, 20))
    return spark.createDataFrame(rows, SCHEMA)


def leaves(key):
    names, values = key.split("=")
    fixed = dict(zip(names.split("+"), values.split("+"), strict=True))
    return {x for x in itertools.product(*VALUES.values()) if all(dict(zip(DIMS, x, strict=True))[d] == v for d, v in fixed.items())}


def named(spark, df, **kw):
    return [(r["key"], r["ep"], r["explained"], r["reversed"]) for r in sorted(causes.cause_sets(df, ("y",), DIMS, **kw).collect(), key=lambda r: r["rk"])]


def test_a_cause_across_two_dimensions_comes_first(spark):
    got = named(spark, cube(spark, lambda r, c, h: 0.4 if (r, h) == ("B", "y") else 1.0))
    assert got[0][0] == "region+channel=B+y" and got[0][1] == pytest.approx(1, abs=0.1) and len(got) == 1


def test_two_causes_of_different_dimensions_and_no_overlap(spark):
    got = named(spark, cube(spark, lambda r, c, h: 0.5 if r == "A" else 0.6 if (c, h) == ("q", "z") else 1.0))
    assert [k for k, *_ in got[:2]] == ["region=A", "category+channel=q+z"] or got[0][0] == "region=A"
    for one, other in itertools.combinations([k for k, *_ in got], 2):
        assert not leaves(one) & leaves(other)


@pytest.mark.parametrize("seed", range(4))
def test_causes_never_share_a_leaf_and_scopes_are_apart(spark, seed):
    rng = random.Random(seed)
    odd = {x: rng.choice([0.3, 0.7, 1, 1, 1, 1.2]) for x in itertools.product(*VALUES.values())}
    both = cube(spark, lambda *x: odd[x], seed, 1).union(cube(spark, lambda r, c, h: 0.4 if c == "t" else 1.0, seed, 2))
    rows = causes.cause_sets(both, ("y",), DIMS).collect()
    one = sorted((r for r in rows if r["y"] == 1), key=lambda r: r["rk"])
    assert [r["rk"] for r in one] == list(range(1, len(one) + 1))
    for a, b in itertools.combinations(one, 2):
        assert not leaves(a["key"]) & leaves(b["key"])
    assert all(r["explained"] < causes.ENOUGH for r in one[:-1])
    assert [r["key"] for r in rows if r["y"] == 2 and r["rk"] == 1] == ["category=t"]
    found = causes.segments(both, ("y",), DIMS).where("y = 1").collect()  # greedy choice by brute force
    left, want, total = {r["key"]: (-r["score"], len(r["dims"]), r["key"], r["ep"]) for r in found if r["ep"] is not None and r["ep"] >= causes.LEAST}, [], 0.0
    while left and len(want) < causes.MOST and total < causes.ENOUGH:
        best = min(left.values())
        want.append(best[2])
        total += best[3]
        left = {k: v for k, v in left.items() if not leaves(k) & leaves(best[2])}
    assert [r["key"] for r in one] == want


def test_a_reversal_is_flagged(spark):
    """Region A's price falls in both channels, but units move to the dear one, so A's price rises."""
    rows = [(2020, r, "p", h, v, w, u, x, 40) for r, h, v, w, u, x in [("A", "x", 900, 100, 95, 10), ("A", "y", 80, 1000, 85, 1000), ("B", "x", 200, 1000, 20, 100), ("B", "y", 1300, 500, 130, 50)]]
    rows = [(y, r, c, h, v * 10000, w * 10000, u, x, n) for y, r, c, h, v, w, u, x, n in rows]
    got = {k: rev for k, _, _, rev in named(spark, spark.createDataFrame(rows, SCHEMA), max_dims=1)}
    assert "channel" in got["region=A"]


def test_bootstrap(spark):
    planted = causes.bootstrap_ranking(cube(spark, lambda r, c, h: 0.5 if r == "C" else 1.0), ("y",), DIMS, 1).collect()
    first = next(r for r in planted if r["dims"] == "region" and r["rk"] == 1)
    assert first["key"] == "region=C" and first["wins"] > 0.9
    flat = causes.bootstrap_ranking(cube(spark, lambda r, c, h: 1.0), ("y",), DIMS, 1).collect()
    assert all(r["wins"] < 0.9 for r in flat if r["dims"] == "category") and all(r["wins"] <= r["kept"] and r["ranking"] <= r["wins"] for r in planted + flat)


def test_copies_have_mean_one(spark):
    x = spark.range(20000).select(causes.copies(causes.uniform("t", "id")).alias("w")).groupBy("w").count().collect()
    total = {r["w"]: r["count"] for r in x}
    assert abs(sum(w * n for w, n in total.items()) / 20000 - 1) < 0.03 and abs(total[0] / 20000 - 0.3679) < 0.015
