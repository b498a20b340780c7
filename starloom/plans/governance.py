"""Governance rows: data dictionary, lineage and audits, made on the driver from a few counts."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_numeric, type_of
from ..operators.stats import profile_columns
from .clean import Lineage
from .profile import DatasetProfile


def json_or_none(value: Any) -> str | None:
    return json.dumps(value, default=str) if value else None


def column_records(raw: DataFrame, profile: DatasetProfile) -> list[dict[str, Any]]:
    """One record a profile column, from the raw data; an absent column is recorded as absent."""
    there = [c.source for c in profile.columns if c.source in raw.columns]
    stats = profile_columns(raw, there) if there else {}
    records = []
    for spec in profile.columns:
        base = {"dataset": profile.name, "source_column": spec.source, "fact_column": spec.fact_column, "declared_type": spec.type, "attribute_type": spec.type, "role": spec.role, "description": spec.description}
        if spec.source not in stats:
            records.append(base | {"inferred_type": "absent", "dtype": "absent", "null_count": 0, "null_pct": 0.0, "distinct_count": 0, "sample_values": [], "numeric_stats": {}, "categorical_stats": {}})
            continue
        s = stats[spec.source]
        numeric = is_numeric(type_of(raw, spec.source))
        top = s.get("top", {})
        records.append(
            base
            | {
                "inferred_type": "numeric" if numeric else "categorical",
                "dtype": s["dtype"],
                "null_count": s["nulls"],
                "null_pct": round(100 * s["nulls"] / max(s["rows"], 1), 4),
                "distinct_count": s["distinct"],
                "sample_values": s["samples"],
                "numeric_stats": s.get("numbers", {}),
                "categorical_stats": {} if numeric else {"top_values": top, "mode": next(iter(top), None)},
            }
        )
    return records


def dictionary_rows(records: list[dict[str, Any]], snapshot_id: int) -> list[tuple]:
    fields = ("fact_column", "source_column", "declared_type", "inferred_type", "attribute_type", "role", "description", "dtype", "null_count", "null_pct", "distinct_count")
    return [(i, snapshot_id, r["dataset"], f"fact_{r['dataset']}", *(r[f] for f in fields), *(json_or_none(r[f]) for f in ("sample_values", "numeric_stats", "categorical_stats"))) for i, r in enumerate(records, 1)]


def lineage_rows(profiles: list[DatasetProfile], logs: dict[str, Lineage], facts: dict[str, int], snapshot_id: int) -> list[tuple]:
    """Three rows a dataset.  Raw positives are those whose raw value the target encoding or mapping turns into the positive label."""
    rows = []
    for p in profiles:
        log, cleaned = logs[p.name], f"cleaned/{p.name}"
        positive, negative = log.cleaned_target.get("positive"), log.cleaned_target.get("negative")
        raw = [_raw_count(p, log, wanted) for wanted in (p.target.positive_int, p.target.negative_int)] if log.raw_target else [None, None]
        rows += [
            (p.name, "raw", str(p.source_path), str(p.source_path), log.raw_rows, *raw, log.raw_missing_cells, log.duplicate_rows, "source read as it is"),
            (p.name, "cleaned", str(p.source_path), cleaned, log.cleaned_rows, positive, negative, 0, log.duplicate_rows, "; ".join(log.transformations) or "nothing to clean"),
            (p.name, "warehouse", cleaned, p.fact_table, facts[p.fact_table], positive, negative, 0, log.duplicate_rows, f"written to {p.fact_table} with keys to its dimensions"),
        ]
    return [(i, snapshot_id, *r) for i, r in enumerate(rows, 1)]


def _raw_count(p: DatasetProfile, log: Lineage, wanted: int) -> int:
    mapping = next((c.mapping or {} for c in p.columns if c.source == p.target.column), {})
    total = 0
    for text, n in log.raw_target.items():
        code = _code(text, mapping)
        code = p.target.positive_int if _same(code, p.target.positive_value) else p.target.negative_int if _same(code, p.target.negative_value) else code
        total += n if _same(code, wanted) else 0
    return total


def _code(text: str, mapping: dict) -> Any:
    return next((v for k, v in mapping.items() if _same(text.strip(), k)), text.strip())


def _same(a: Any, b: Any) -> bool:
    try:
        return float(a) == float(b)
    except (TypeError, ValueError):
        return str(a) == str(b)


def audit_rows(profiles: list[DatasetProfile], logs: dict[str, Lineage], fact_nulls: dict[str, int], snapshot_id: int) -> list[tuple]:
    """Four rows a dataset, two more with a label and two for each imputation; one more where fact cells are null."""
    rows: list[tuple] = []
    for p in profiles:
        log = logs[p.name]
        rows += [
            (p.name, "row_reconciliation", "raw_rows", float(log.raw_rows), "PASS", "rows read"),
            (p.name, "row_reconciliation", "cleaned_rows", float(log.cleaned_rows), "PASS", "rows after cleaning"),
            (p.name, "missing_value_audit", "cleaned_missing_cells", 0.0, "PASS", "no cell is missing after cleaning"),
            (p.name, "duplicate_audit", "duplicate_rows", float(log.duplicate_rows), "INFO", "raw rows that repeat another; they stay"),
        ]
        for side in log.cleaned_target:
            rows.append((p.name, "target_reconciliation", f"{side}_count", float(log.cleaned_target[side]), "PASS", f"{side} labels after cleaning"))
        for i in log.imputations:
            rows.append((p.name, "imputation", f"{i['column']}_missing_before", float(i["missing_before"]), "INFO", f"{i['strategy']} of {i['column']}: before"))
            rows.append((p.name, "imputation", f"{i['column']}_missing_after", float(i["missing_after"]), "PASS", f"{i['strategy']} of {i['column']}: after"))
        if fact_nulls.get(p.name):
            rows.append((p.name, "fact_null_audit", "fact_null_cells", float(fact_nulls[p.name]), "WARN", "cells that the declared types made null"))
    return [(n, snapshot_id, *r) for n, r in enumerate(rows, 1)]


def lineage_counts(raw: DataFrame, cleaned: DataFrame, label: str) -> DataFrame:
    """(stage, row_count, positive_count) of a raw and a cleaned frame."""
    one = lambda df, stage, positive: df.agg(F.lit(stage).alias("stage"), F.count("*").alias("row_count"), positive.alias("positive_count"))
    return one(raw, "raw", F.lit(None).cast("long")).unionAll(one(cleaned, "cleaned", F.count_if(F.col(label) == 1)))
