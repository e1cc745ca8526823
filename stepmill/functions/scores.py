"""Probabilities and scores as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    """Sum of an array of doubles; 0 for the empty array."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once for each row, also where it stands inside a lambda of ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(scores: Column) -> Column:
    """Stable softmax of an array; empty stays empty, a total of zero gives the uniform distribution."""
    def shares(exps: Column) -> Column:
        return bind(total(exps), lambda whole: F.transform(exps, lambda e: F.when(whole > 0, e / F.nullif(whole, F.lit(0.0))).otherwise(1.0 / F.size(exps))))

    exps = bind(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return F.when(F.size(scores) == 0, scores).otherwise(bind(exps, shares))


def first_argmax(values: Column) -> Column:
    """0-based position of the first greatest value; null for an empty array and for one with a value that is no number."""
    top = F.array_max(values)
    at = F.array_position(values, top).cast("int") - 1
    return F.when((at >= 0) & ~F.isnan(top), at)


def brier(probs: Column, gold: Column) -> Column:
    """Multi-class Brier score: the squared distance to the one-hot gold, 0 to 2."""
    return F.aggregate(
        F.transform(probs, lambda p, i: F.pow(p - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x
    )


def renormalise(values: Column) -> Column:
    """Values divided by their sum where that is positive; nulls count as 0, all zeros stay."""
    def shares(filled: Column) -> Column:
        return bind(total(filled), lambda whole: F.when(whole > 0, F.transform(filled, lambda v: v / F.nullif(whole, F.lit(0.0)))).otherwise(filled))

    return bind(F.transform(values, lambda v: F.coalesce(v, F.lit(0.0))), shares)


def by_keys(probs: Column, keys: tuple[str, ...]) -> Column:
    """The values of a map at fixed keys, 0 where a key is missing."""
    return F.array(*[F.coalesce(F.try_element_at(probs, F.lit(k)), F.lit(0.0)) for k in keys])


def pick(names: tuple[str, ...], at: Column) -> Column:
    """The name at a 0-based position."""
    return F.get(F.array(*[F.lit(n) for n in names]), at)


def seeded(key: Column, seed: str, tag: str = "") -> Column:
    """The text whose order is the seeded random order: md5 of seed, key and tag."""
    return F.md5(F.concat_ws(":", F.lit(seed), key, F.lit(tag)) if tag else F.concat_ws(":", F.lit(seed), key))


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the same digest: its first 13 hexadecimal digits."""
    return F.conv(F.substring(seeded(key, seed), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
