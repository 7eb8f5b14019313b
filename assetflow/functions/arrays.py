"""Helpers for higher-order array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Catalyst inlines a column computed in an earlier projection into every
    place it is referenced; inside a lambda that means once per array
    element.  The argument of a higher-order function, by contrast, is
    evaluated once, so a one-element ``transform`` acts as a ``let``.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
