"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-6
MISSING, OTHER = "__missing__", "__other__"


def finite(c: Column) -> Column:
    """The double of ``c``, null where it is null, NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(math.inf)), d)


def normalised(df: DataFrame) -> DataFrame:
    """Floats of ``df`` with NaN and infinities as null; the other columns as they are."""
    return df.select(*[finite(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p.cast("double"), F.lit(EPS)), F.lit(1 - EPS))


def flag(c: Column) -> Column:
    """1 after truncation, null as 0."""
    return F.coalesce(c.cast("int"), F.lit(0)) == 1


def observable_mask(df: DataFrame, cols) -> Column:
    """Rows whose outcome counts: by flag, else by a known target, else all."""
    if cols.col_obs and cols.col_obs in df.columns:
        return flag(F.col(cols.col_obs))
    if cols.col_target and cols.col_target in df.columns:
        return F.col(cols.col_target).isNotNull()
    return F.lit(True)


def fantomas_mask(df: DataFrame, cols) -> Column:
    if cols.col_fantomas and cols.col_fantomas in df.columns:
        return flag(F.col(cols.col_fantomas))
    return F.lit(False)


def vintage(c: Column, freq: str = "M") -> Column:
    """The label of a date's month (``M``), quarter, year or day; null if it is no date."""
    ts = F.try_to_timestamp(c.cast("string"))
    forms = {"M": F.date_format(ts, "yyyy-MM"), "D": F.date_format(ts, "yyyy-MM-dd"), "Y": F.date_format(ts, "yyyy"), "Q": F.concat(F.date_format(ts, "yyyy"), F.lit("Q"), F.quarter(ts))}
    return forms[freq.upper()[0]]


def levels(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def logit_transform(v: Column, impute: float | None = None, eps: float = EPS) -> Column:
    """ln(p / (1 - p)) of p clipped by ``eps``; ``impute`` where p is null or outside (0, 1)."""
    p = finite(v)
    inside = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.when((p > 0) & (p < 1), F.ln(inside / (1 - inside))).otherwise(F.lit(impute).cast("double"))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def wilson(events: Column, n: Column, z: float = 1.64) -> tuple[Column, Column]:
    """The Wilson interval of a rate, inside 0 and 1; null without rows."""
    rate, zz = events / n, z * z
    middle = (rate + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(rate * (1 - rate) / n + zz / (4 * n * n)) / (1 + zz / n)
    some = n > 0
    return F.when(some, F.greatest(middle - half, F.lit(0.0))), F.when(some, F.least(middle + half, F.lit(1.0)))
