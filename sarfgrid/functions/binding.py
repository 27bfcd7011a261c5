"""Binding a value to a name inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value written out and computed once however often body uses it.

    Columns that build on each other grow by multiplication when the optimiser writes one
    out inside the next; a lambda's variable keeps the sum of their sizes.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
