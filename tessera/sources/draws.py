"""Seeded draws from hashes: equal for equal keys in every task, on every retry and at any partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = 1 << 40


def uniform(seed: int, *keys: Column | str | int) -> Column:
    """A number strictly between 0 and 1 for each combination of keys."""
    own = [F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k for k in keys]
    return (F.pmod(F.xxhash64(*own, F.lit(seed)), F.lit(_UNITS)) + 0.5) / float(_UNITS)


def normal(seed: int, *keys: Column | str | int) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1_000_003, *keys))


def choice(u: Column, shares: Sequence[float]) -> Column:
    """The number of the share in which u falls; the shares need not sum to one."""
    total, at, out = float(sum(shares)), 0.0, F.lit(0)
    for share in shares[:-1]:
        at += share / total
        out = out + (u >= at).cast("int")
    return out


def poisson(u: Column, rate: Column, most: int = 6) -> Column:
    """A Poisson count of at most so many, by the inverse of its distribution."""
    term = F.exp(-rate)
    done, out = term, F.lit(0)
    for k in range(1, most + 1):
        out = out + (u > done).cast("int")
        term = term * rate / k
        done = done + term
    return out


def by_code(code: Column | str, values: Sequence[float]) -> Column:
    """The value of a code from 0."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col(code) if isinstance(code, str) else code).cast("int") + 1)
