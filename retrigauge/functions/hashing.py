"""Deterministic choices from hashes instead of random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _head(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def hash_choice(key: Column, n) -> Column:
    """0..n-1 from the first eight hex digits of md5."""
    return F.pmod(_head(F.md5(key), 8), n if isinstance(n, Column) else F.lit(n))


def chosen(key: Column, options: Column) -> Column:
    return F.element_at(options, (hash_choice(key, F.size(options)) + 1).cast("int"))


def stable_seed(key: Column) -> Column:
    return _head(F.sha1(key), 8)


def hash_uniform(key: Column) -> Column:
    """A number in [0, 1) from twelve hex digits of md5."""
    return _head(F.md5(key), 12) / F.lit(float(16**12))


def weighted_key(key: Column, weight: Column) -> Column:
    """The n least of these keys are a sample of n without replacement, drawn in proportion to weight."""
    return -F.ln(F.lit(1.0) - hash_uniform(key)) / weight


def jitter(key: Column) -> Column:
    """-0.04..0.04 in steps of 0.01."""
    return (F.pmod(_head(F.md5(key), 6), F.lit(9)) - 4) / F.lit(100.0)


def narrowed(options: Column, strength: Column) -> Column:
    """The last two options for strong, the first two for subtle, all otherwise."""
    tail = F.slice(options, F.greatest(F.size(options) - 1, F.lit(1)), 2)
    return F.when(strength == "strong", tail).when(strength == "subtle", F.slice(options, 1, 2)).otherwise(options)
