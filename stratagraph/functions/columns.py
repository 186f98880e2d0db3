"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) that depends on the parts alone, from 32 bits of their MD5: it can be told again by any engine."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def unit(vector: Column) -> Column:
    """L2-normalised; the zero vector stays."""
    size = norm(vector)
    return F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(vector)


def pick(dsts: Column, sums: Column, at: Column) -> Column:
    """The first neighbour whose running weight exceeds `at`; the last one if rounding leaves none.

    `at` is bound before the list is gone through, so that it is worked out once and not for each entry."""
    place = lambda x: F.least(F.size(F.filter(sums, lambda s: s <= x)) + 1, F.size(dsts))
    return F.element_at(F.transform(F.array(at), lambda x: F.element_at(dsts, place(x))), 1)
