"""Guarded casts and comparisons.

Spark's casts differ from what delimited data means: ANSI casts throw, ``12d`` is a Java double and
NaN is a value.  These expressions take plain decimal notation only, and NaN for missing.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER = r"^\s*[+-]?\d+\s*$"
INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def ref(name: str) -> Column:
    """A column whose name may hold dots, brackets or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def no_nan(c: Column, kind: T.DataType) -> Column:
    return F.when(F.isnan(c), None).otherwise(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


def to_double(c: Column, kind: T.DataType) -> Column:
    """The number, or null; never NaN."""
    if is_numeric(kind):
        return no_nan(c.cast("double"), T.DoubleType())
    infinite = F.when(F.trim(c).startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double")).when(c.rlike(INFINITE), infinite)


def to_long(c: Column, kind: T.DataType) -> Column:
    """A number truncated toward zero; a text only if it is a whole number; else null."""
    if is_numeric(kind):
        return no_nan(c.cast("double"), T.DoubleType()).try_cast("long") if isinstance(kind, (T.DoubleType, T.FloatType)) else c.try_cast("long")
    return F.when(c.rlike(INTEGER), F.trim(c).try_cast("long"))


def equals(c: Column, kind: T.DataType, value: Any, ci: bool = False) -> Column:
    """Equality as the data means it: numbers with numbers, text with text, nothing across."""
    if is_numeric(kind):
        return c.cast("double") == float(value) if isinstance(value, (bool, int, float)) else F.lit(False)
    if isinstance(value, str):
        return F.lower(c) == value.lower() if ci else c == value
    return F.lit(False)


def is_one_of(c: Column, kind: T.DataType, values: list, ci: bool = False) -> Column:
    if is_numeric(kind):
        some = [float(v) for v in values if isinstance(v, (bool, int, float))]
        return c.cast("double").isin(some) if some else F.lit(False)
    some = [v.lower() if ci else v for v in values if isinstance(v, str)]
    return (F.lower(c) if ci else c).isin(some) if some else F.lit(False)


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType
