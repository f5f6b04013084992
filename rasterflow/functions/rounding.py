"""Rounding and storing of channel values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, for negative values too."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float = 0, high: float = 255) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def channel(x: Column) -> Column:
    """A value rounded and clamped to 0..255, as int."""
    return clamp(half_up(x)).cast("int")


def wrapped(x: Column) -> Column:
    """A byte store without a clamp: truncated, modulo 256."""
    return F.pmod(x.cast("long"), F.lit(256)).cast("int")
