"""Values that an expression names several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once for a row, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
