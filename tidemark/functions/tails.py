"""Tails of distributions as column expressions: incomplete gamma and beta functions, without a Python worker.

Series and continued fractions are folds over a sequence of term numbers, as long as the argument asks for. The log gamma
function is Stirling's series, eight steps up.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of a continued fraction; terms of a series beside four for each unit of the shape.
TERMS, FIRST = 300, 120


def _bound(*values: Column, body: Callable[..., Column]) -> Column:
    """``body`` of the values, each evaluated once a row."""
    return F.transform(F.array(F.struct(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])), lambda s: body(*[s[f"v{i}"] for i in range(len(values))])).getItem(0)


def lgamma(x: Column) -> Column:
    """log of the gamma function of a positive number."""
    z = x + 8
    steps = reduce(lambda a, i: a + F.log(x + i), range(1, 8), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7)) - steps


def _fraction(a: Callable[[Column], Column], b: Callable[[Column], Column]) -> Column:
    """a(1) / (b(1) + a(2) / (b(2) + ...)), from the last of TERMS terms back."""
    return F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(0.0), lambda v, i: a(i.cast("double")) / (b(i.cast("double")) + v))


def gamma_tail(a: Column, x: Column) -> Column:
    """The upper incomplete gamma function Q(a, x), a > 0."""

    def body(a: Column, x: Column) -> Column:
        scale = F.exp(a * F.log(x) - x - lgamma(a))
        terms = F.sequence(F.lit(1), (FIRST + 4 * a).cast("int"))
        start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
        low = F.aggregate(terms, start, lambda s, i: F.struct((s["term"] * x / (a + i)).alias("term"), (s["sum"] + s["term"] * x / (a + i)).alias("sum")), lambda s: s["sum"])
        high = _fraction(lambda i: F.when(i == 1, 1.0).otherwise(-(i - 1) * (i - 1 - a)), lambda i: x + 2 * i - 1 - a)
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - scale * low).otherwise(scale * high)

    return _bound(a, x, body=body)


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""

    def front(a: Column, b: Column, x: Column) -> Column:
        even = lambda m: m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = lambda m: -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        k = lambda i: i - 1
        term = lambda i: F.when(i == 1, 1.0).when(k(i) % 2 == 0, even(k(i) / 2)).otherwise(odd((k(i) - 1) / 2))
        scale = F.exp(a * F.log(x) + b * F.log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
        return scale * _fraction(term, lambda i: F.lit(1.0))

    def body(a: Column, b: Column, x: Column) -> Column:
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), front(a, b, x)).otherwise(1 - front(b, a, 1 - x))

    return _bound(a, b, x, body=body)


def chi2_tail(x: Column, k: Column) -> Column:
    """The chance of more than x with k degrees of freedom."""
    return gamma_tail(k.cast("double") / 2, x / 2)


def t_two_sided(t: Column, k: Column) -> Column:
    """The chance of a t value as far from 0, with k degrees of freedom."""
    k = k.cast("double")
    return beta_share(k / 2, F.lit(0.5), k / (k + t * t))


def f_tail(f: Column, k: Column, m: Column) -> Column:
    """The chance of more than f with k and m degrees of freedom."""
    k, m = k.cast("double"), m.cast("double")
    return beta_share(m / 2, k / 2, m / (m + k * f))
