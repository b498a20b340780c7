"""The clean plan: a profile's operators in their order, and what they did."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import equals, ref, type_of
from ..operators import clean as ops
from ..operators.stats import duplicate_rows, missing_cells, value_counts
from ..sources.delimited import read_delimited, strip_strings
from .profile import DatasetProfile, TargetSpec


@dataclass
class Lineage:
    raw_rows: int = 0
    raw_columns: int = 0
    raw_missing_cells: int = 0
    duplicate_rows: int = 0
    raw_target: dict[str, int] = field(default_factory=dict)
    removed_rows_total: int = 0
    removed_rows_positive: int = 0
    cleaned_rows: int = 0
    cleaned_columns: int = 0
    cleaned_target: dict[str, int] = field(default_factory=dict)
    transformations: list[str] = field(default_factory=list)
    drop_rules: list[dict[str, Any]] = field(default_factory=list)
    imputations: list[dict[str, Any]] = field(default_factory=list)


def read_source(spark: SparkSession, profile: DatasetProfile, root: str = "") -> DataFrame:
    path = str(profile.source_path) if not root or "://" in str(profile.source_path) else f"{root}/{profile.source_path}"
    if profile.source_format == "parquet":
        return spark.read.parquet(path)
    return read_delimited(spark, path, profile.delimiter, profile.na_values, multiline=True)


def clean(raw: DataFrame, profile: DatasetProfile) -> tuple[DataFrame, Lineage]:
    """Strip, drop rows, drop columns, scale, impute, band, map, check domains, encode the label, refuse nulls.

    Numeric mappings of a band's source (codes for ages) come before the bands.  The passes over
    the data are the raw counts, the medians, the domain check and the final counts.
    """
    log, target = Lineage(), profile.target
    for rule in profile.cleaning.drop_rows_where:
        ops.drop_condition(raw, rule)
    for spec in profile.columns:
        if spec.imputation and spec.imputation.get("strategy") not in ("median", "constant", "grouped_median"):
            raise ValueError(f"column {spec.source!r}: unknown imputation {spec.imputation.get('strategy')!r}")
    shape = missing_cells(raw).first()
    log.raw_rows, log.raw_columns, log.raw_missing_cells = shape["rows"], shape["columns"], shape["missing"]
    log.duplicate_rows = duplicate_rows(raw).first()["duplicates"]
    if target.column in raw.columns:
        log.raw_target = {str(r["value"]): r["n"] for r in value_counts(raw, target.column).collect()}

    df = raw
    if profile.cleaning.strip_whitespace:
        df = strip_strings(df)
        log.transformations.append("stripped string whitespace")

    rules = profile.cleaning.drop_rows_where
    if rules:
        # one pass: a row counts for the first rule that drops it
        hits = [ops.drop_condition(df, r) for r in rules]
        positive = F.coalesce(equals(ref(target.column), type_of(df, target.column), target.positive_value), F.lit(False)) if target.column in df.columns else F.lit(False)
        live, aggs = F.lit(True), []
        for i, hit in enumerate(hits):
            aggs += [F.count_if(live & hit).alias(f"n{i}"), F.count_if(live & hit & positive).alias(f"p{i}")]
            live = live & ~hit
        row = df.agg(*aggs).first()
        for i, rule in enumerate(rules):
            log.drop_rules.append({"column": rule.column, "operator": rule.operator, "matched": row[f"n{i}"], "skipped": rule.column not in df.columns, "note": rule.note})
            log.removed_rows_total += row[f"n{i}"]
            log.removed_rows_positive += row[f"p{i}"]

    df = row_level(df, profile, log.transformations.append, lambda d: _impute(d, profile, log))
    if odd := ops.domain_violations(df, profile.columns):
        raise ValueError(f"profile {profile.name}: values outside their domains: {odd}")
    df, label = labelled(df, target), target.rename_to
    if left := {c: n for c, n in ops.null_counts(df).items() if n}:
        raise ValueError(f"profile {profile.name}: missing values remain after cleaning: {left}")
    counts = df.agg(F.count("*").alias("n"), *([F.count_if(ref(label) == target.positive_int).alias("p"), F.count_if(ref(label) == target.negative_int).alias("q")] if label in df.columns else [])).first()
    log.cleaned_rows, log.cleaned_columns = counts["n"], len(df.columns)
    if label in df.columns:
        log.cleaned_target = {"positive": counts["p"], "negative": counts["q"]}
    return df, log


def row_level(df: DataFrame, profile: DatasetProfile, note: Callable[[str], Any] = lambda said: None, fill: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Drop rows, drop columns, scale, fill, map what bands need, band, map: all but ``fill`` looks at one row at a time."""
    for rule in profile.cleaning.drop_rows_where:
        df = ops.drop_rows(df, rule)
    for spec in profile.columns:
        if spec.drop and spec.source in df.columns:
            df = df.drop(spec.source)
            note(f"dropped column {spec.source}")
    for spec in profile.columns:
        if spec.scale_factor is not None and spec.source in df.columns:
            df = ops.scale(df, spec.source, spec.scale_factor)
            note(f"scaled {spec.source} by {spec.scale_factor}")
    df = fill(df)
    first = {s.source for s in profile.columns if s.mapped_first}
    for spec in profile.columns:
        if spec.source in first:
            df = ops.apply_mapping(df, spec)
    for h in profile.hierarchies:
        if h.source_column in df.columns:
            df = ops.add_bands(df, h.source_column, h.new_column, h.bands)
            note(f"built hierarchy {h.new_column} from {h.source_column}")
    for spec in profile.columns:
        if spec.source not in first:
            df = ops.apply_mapping(df, spec)
    return df


def labelled(df: DataFrame, target: TargetSpec) -> DataFrame:
    """The target under its new name, encoded; no change where it is absent."""
    if target.column not in df.columns:
        return df
    label = target.rename_to
    df = df.withColumnRenamed(target.column, label)
    return df.withColumn(label, ops.encode_label(ref(label), type_of(df, label), target))


def _impute(df: DataFrame, profile: DatasetProfile, log: Lineage) -> DataFrame:
    """Median and constant rules need one pass for all; grouped medians one or two each, in the profile's order."""
    specs = [s for s in profile.columns if s.imputation and s.source in df.columns]
    if not specs:
        return df
    before = ops.null_counts(df.select(*[ref(s.source) for s in specs]))
    plain = [s.source for s in specs if s.imputation["strategy"] == "median"]
    if plain:
        df = ops.impute_medians(df, plain)
    for s in specs:
        rule, entry = s.imputation, {"column": s.source, "strategy": s.imputation["strategy"], "missing_before": before[s.source]}
        if rule["strategy"] == "constant":
            df = ops.impute_constant(df, s.source, rule.get("value"))
        elif rule["strategy"] == "grouped_median":
            df, entry["groups"] = ops.impute_grouped_median(df, s.source, rule)
        log.imputations.append(entry)
        log.transformations.append(f"imputed {s.source} via {rule['strategy']}")
    after = ops.null_counts(df.select(*[ref(s.source) for s in specs]))
    for entry in log.imputations:
        entry["missing_after"] = after[entry["column"]]
    return df
