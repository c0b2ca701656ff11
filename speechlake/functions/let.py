"""Name a value inside a column expression.

A lambda of a higher-order function evaluates whatever it captures once per
element; binding the captured value as a lambda variable evaluates it once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
