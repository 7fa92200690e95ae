"""Random draws that depend on their keys alone: the same for any partitioning, order or engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *keys: str) -> Column:
    """A number in [0, 1) from the first 32 bits of the keys' MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / 4294967296.0


def normal(seed: str, *keys: str) -> Column:
    """A standard normal draw, by Box and Muller from two uniform ones."""
    a, b = uniform(f"{seed}:a", *keys), uniform(f"{seed}:b", *keys)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)


def uniform_sql(seed: str, *keys: str) -> str:
    text = ", ".join(f"cast({k} as varchar)" for k in keys)
    return f"(cast('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 8) as bigint) / 4294967296.0::double)"


def normal_sql(seed: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform_sql(seed + ':a', *keys)})) * cos(2 * pi() * {uniform_sql(seed + ':b', *keys)}))"
