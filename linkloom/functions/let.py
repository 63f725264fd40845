"""Name an intermediate value inside one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    Column expressions are trees: a value used five times is planned five
    times, and nesting multiplies. Binding it to a lambda variable keeps both
    the plan and the work linear.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(value: Column, keep: Callable[[Column], Column]) -> Column:
    """A generator of ``value``, of no row where ``keep(value)`` isn't true.

    A filter on a computed column is pushed below it, even into a join's condition,
    and computes the value there once more; what a generator makes is computed once.
    """
    return F.explode(F.filter(F.array(value), keep))
