"""Small expression helpers used across the package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Projection collapsing copies an expression into a lambda that names it and
    then evaluates it per element; a lambda variable is bound once and stays so.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def int_div(value: Column, divisor: Column | int) -> Column:
    """Whole-number division as a long, without the detour through doubles."""
    return F.call_function("div", value, divisor if isinstance(divisor, Column) else F.lit(divisor))
