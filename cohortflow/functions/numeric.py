"""Null-safe numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_VARIANCE = 1e-12
CONSTANT_STD = 1e-15


def nan_to_null(col: Column) -> Column:
    """NaN becomes NULL, the only missing marker used after the read boundary."""
    return F.when(~F.isnan(col), col)


def finite(col: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    return F.coalesce(F.abs(col) < F.lit(float("inf")), F.lit(False))


def rounded(col: Column, digits: int = 6) -> Column:
    return F.round(col, digits)


def safe_log2(col: Column) -> Column:
    return F.when(col > 0, F.log2(col))


def dead_sign(col: Column) -> Column:
    """Sign with a 1e-12 dead zone around zero."""
    return F.when(col >= ZERO_VARIANCE, 1).when(col <= -ZERO_VARIANCE, -1).otherwise(0)


def dot(left: Column, right: Column) -> Column:
    """Inner product of two array<double> columns of equal length."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
