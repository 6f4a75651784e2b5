"""Small helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column used inside a lambda may be inlined by the optimizer and then
    recomputed for every element; a bound lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_n(n: Column) -> Column:
    """``[0, n)`` as an array of int; empty for n <= 0."""
    n = n.cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def count_value(array: Column, value: Column) -> Column:
    """How often ``value`` occurs, in generated code rather than by a lambda."""
    return F.size(array) - F.size(F.array_remove(array, value))


def as_text(array: Column) -> Column:
    return F.array_join(array.cast("array<string>"), ",")
