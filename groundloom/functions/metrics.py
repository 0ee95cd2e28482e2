"""Grounding, preservation and risk as columns. Undefined is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cfi(eg: Column, rp: Column, alpha: Column | float) -> Column:
    """EG alone where RP is undefined."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.when(rp.isNull(), eg).otherwise(a * eg + (F.lit(1.0) - a) * rp)


def risk(eg: Column, rp: Column, alpha: Column | float, impute: float | None = None) -> Column:
    h = F.lit(1.0) - cfi(eg, rp, alpha)
    return h if impute is None else F.coalesce(h, F.lit(float(impute)))


def complement(x: Column) -> Column:
    return F.lit(1.0) - x


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
