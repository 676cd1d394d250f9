"""Small helpers to build Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it.

    A one-element transform binds the value to a lambda variable. It keeps long CASE
    ladders from being multiplied into each other, which would make generated methods
    too large to compile.
    """
    return F.transform(F.array(value), body)[0]
