"""Cleaning operators: each takes a DataFrame and what a profile says, and gives a lazy DataFrame."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import equals, is_numeric, is_one_of, no_nan, ref, to_double, to_long, type_of
from ..plans.profile import Band, ColumnSpec, DropRule, TargetSpec, parse_bound
from .quantiles import group_quantiles, quantiles
from .stats import first_of_each


def drop_condition(df: DataFrame, rule: DropRule) -> Column:
    """Whether a row is to go; never null.  A rule on an absent column drops nothing."""
    if rule.operator not in ("equals", "in", "lt", "gt"):
        raise ValueError(f"drop rule on {rule.column!r}: unknown operator {rule.operator!r}")
    if rule.column not in df.columns:
        return F.lit(False)
    c, kind = ref(rule.column), type_of(df, rule.column)
    if rule.operator in ("equals", "in"):
        values = rule.value if isinstance(rule.value, (list, tuple, set)) and rule.operator == "in" else [rule.value]
        hit = is_one_of(c, kind, list(values), rule.case_insensitive) if rule.operator == "in" else equals(c, kind, rule.value, rule.case_insensitive)
    else:
        left, right = (c.cast("double"), float(rule.value)) if is_numeric(kind) else (c, F.lit(str(rule.value)))
        hit = left < right if rule.operator == "lt" else left > right
    return F.coalesce(hit, F.lit(False))


def drop_rows(df: DataFrame, rule: DropRule) -> DataFrame:
    return df.filter(~drop_condition(df, rule))


def scale(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, to_double(ref(column), type_of(df, column)) * F.lit(float(factor)))


def map_values(c: Column, kind: T.DataType, mapping: dict[Any, Any]) -> Column:
    """All replacements at once; what no key matches stays.

    Keys match by kind: numbers match a numeric column, texts a text column.  The result is
    numeric where column and replacements are, else text.
    """
    usable = [(k, v) for k, v in mapping.items() if isinstance(k, str) != is_numeric(kind)]
    if is_numeric(kind):
        numbers = all(isinstance(v, (int, float)) for _, v in usable)
        whole = isinstance(kind, (T.IntegralType, T.BooleanType)) and all(float(v).is_integer() for _, v in usable) if numbers else False
        turn = (lambda v: F.lit(int(v)).cast("long")) if whole else (lambda v: F.lit(float(v))) if numbers else (lambda v: F.lit(str(v)))
        rest = c.cast("long") if whole else c.cast("double") if numbers else c.cast("string")
    else:
        turn, rest = (lambda v: F.lit(str(v))), c
    out: Column | None = None
    for k, v in usable:
        hit = equals(c, kind, k)
        out = F.when(hit, turn(v)) if out is None else out.when(hit, turn(v))
    return c if out is None else out.otherwise(rest)


def apply_mapping(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    if not spec.mapping or spec.source not in df.columns:
        return df
    return df.withColumn(spec.source, map_values(ref(spec.source), type_of(df, spec.source), spec.mapping))


def band(value: Column, bands: list[Band]) -> Column:
    """The first band whose bound is above the value, the last one beyond all; null for null."""
    out: Column | None = None
    for b in bands[:-1]:
        out = (F.when if out is None else out.when)(value < F.lit(float(b.upper_exclusive)), b.label)
    last = F.lit(bands[-1].label)
    return F.when(value.isNotNull(), last if out is None else out.otherwise(last))


def add_bands(df: DataFrame, source: str, new: str, bands: list[Band]) -> DataFrame:
    """No change where the source column is absent."""
    if source not in df.columns:
        return df
    return df.withColumn(new, band(to_double(ref(source), type_of(df, source)), bands))


def impute_constant(df: DataFrame, column: str, value: Any) -> DataFrame:
    c, kind = ref(column), type_of(df, column)
    if is_numeric(kind) and not isinstance(value, (int, float)):
        return df.withColumn(column, F.coalesce(c.cast("string"), F.lit(str(value))))
    return df.withColumn(column, F.coalesce(c, F.lit(value if is_numeric(kind) else str(value))))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of several columns in one pass."""
    found = quantiles(df, {c: to_double(ref(c), type_of(df, c)) for c in columns}, [0.5])
    return {c: found[c][0] for c in columns}


def impute_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become their column's median; all medians come from one pass."""
    found = medians(df, columns)
    return df.withColumns({c: F.coalesce(to_double(ref(c), type_of(df, c)), F.lit(found[c])) for c in columns})


def group_stats(df: DataFrame, column: str, label: Column, without: bool = False) -> DataFrame:
    """(band, median, missing) of the values of a column; a row without a band is in none, or counts as missing ``without`` one.  The bands are those of a profile, so few."""
    rows = df.select(label.alias("band"), to_double(ref(column), type_of(df, column)).alias("v"))
    banded = rows.filter("band is not null")
    counts = (rows if without else banded).groupBy("band").agg(F.count_if(F.col("v").isNull()).alias("missing"))
    middle = df.sparkSession.createDataFrame([(b, v[0]) for b, v in group_quantiles(banded, "band", "v", [0.5]).items()], "band string, median double")
    return counts.join(F.broadcast(middle), "band", "left").select("band", "median", "missing")


def impute_grouped_median(df: DataFrame, column: str, rule: dict[str, Any]) -> tuple[DataFrame, list[dict]]:
    """Nulls become the median of their band of another column, then, if asked for and any are left, that of the filled column.

    A value that is there always stays, whatever its band.  Also gives a report: for every band
    its median to 3 places and its missing values before.
    """
    bands = [Band(str(b["label"]), parse_bound(b["upper_exclusive"])) for b in rule["group_bands"]]
    by = rule["group_source_column"]
    label = band(to_double(ref(by), type_of(df, by)), bands)
    stats = {r["band"]: r for r in group_stats(df, column, label, without=True).collect()}
    left = sum(r["missing"] for b, r in stats.items() if b is None or r["median"] is None)  # what no band fills
    stats.pop(None, None)
    value, filled = to_double(ref(column), type_of(df, column)), None
    for name, r in sorted(stats.items()):
        if r["median"] is not None:
            hit = label == name
            filled = F.when(hit, r["median"]) if filled is None else filled.when(hit, r["median"])
    df = df.withColumn(column, F.coalesce(value, filled) if filled is not None else value)
    if rule.get("fallback") == "global_median" and left:
        df = impute_medians(df, [column])
    report = [{"band": b.label, "median": None if b.label not in stats or stats[b.label]["median"] is None else round(stats[b.label]["median"], 3), "missing": stats[b.label]["missing"] if b.label in stats else 0} for b in bands]
    return df, report


def domain_violations(df: DataFrame, specs: list[ColumnSpec]) -> dict[str, list[str]]:
    """The first 20 values, in order, of each column that are not in its domain; one pass for all columns."""
    checked = [s for s in specs if s.domain and s.source in df.columns]
    if not checked:
        return {}
    pairs = [F.struct(F.lit(s.source).alias("column"), F.when(~F.coalesce(is_one_of(ref(s.source), type_of(df, s.source), s.domain), F.lit(True)), ref(s.source).cast("string")).alias("value")) for s in checked]
    odd = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("value is not null").distinct()
    found: dict[str, list[str]] = {}
    for r in first_of_each(odd, "column", ["value"], 20).orderBy("column", "rank").collect():
        found.setdefault(r["column"], []).append(r["value"])
    return found


def encode_label(c: Column, kind: T.DataType, target: TargetSpec) -> Column:
    """Positive and negative values become their integers; another number stays, another text is null."""
    other = to_long(c, kind) if is_numeric(kind) else F.when(c.rlike(r"^\s*[+-]?\d+(\.0+)?\s*$"), F.trim(c).try_cast("double").try_cast("long"))
    same = lambda v: F.coalesce(equals(c, kind, v), F.lit(False)) | (F.coalesce(c == str(v), F.lit(False)) if not is_numeric(kind) else F.lit(False))
    return F.when(same(target.positive_value), target.positive_int).when(same(target.negative_value), target.negative_int).otherwise(other).cast("int")


def normalise(c: Column, kind: T.DataType, attribute: str) -> Column:
    """The fact table's value: a double, a whole number or text."""
    if attribute == "numeric":
        return to_double(c, kind)
    if attribute == "binary":
        return to_long(c, kind).try_cast("int")
    return to_long(c, kind) if attribute == "identifier" else no_nan(c, kind).cast("string")


def null_counts(df: DataFrame) -> dict[str, int]:
    """The nulls (and NaNs) of every column, in one pass."""
    row = df.agg(*[F.count_if(no_nan(ref(f.name), f.dataType).isNull()).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]).first()
    return {f.name: row[f"c{i}"] or 0 for i, f in enumerate(df.schema.fields)}
