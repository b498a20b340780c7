"""The star schema as a Mermaid entity diagram."""

from __future__ import annotations

import re

from .ddl import SHARED, fact_schema
from .profile import DatasetProfile

_KIND = {"BIGINT": "int", "INT": "int", "DOUBLE": "float", "STRING": "string"}
_LINKS = [("dim_etl_snapshot", "dim_dataset", "loads"), ("dim_etl_snapshot", "dim_patient_record", "loads"), ("dim_dataset", "dim_patient_record", "contains"), ("dim_gender", "dim_patient_record", "describes"), ("dim_age_bracket", "dim_patient_record", "groups"), ("dim_etl_snapshot", "metadata_data_dictionary", "documents"), ("dim_etl_snapshot", "metadata_lineage", "traces"), ("dim_etl_snapshot", "etl_audit_log", "audits")]


def _entity(name: str, columns: dict[str, str], primary: str) -> str:
    lines = []
    for column, kind in columns.items():
        mark = " PK" if column == primary else " FK" if column.endswith("_id") else ""
        lines.append(f"        {_KIND[kind.split()[0]]} {re.sub(r'[^A-Za-z0-9_]', '_', column)}{mark}")
    return f"    {re.sub(r'[^A-Za-z0-9_]', '_', name)} {{\n" + "\n".join(lines) + "\n    }"


def mermaid(profiles: list[DatasetProfile]) -> str:
    out = ["erDiagram"]
    for name, columns in SHARED.items():
        pairs = dict(c.strip().split(" ", 1) for c in columns.split(","))
        out.append(_entity(name, pairs, next(iter(pairs))))
    for p in profiles:
        out.append(_entity(p.fact_table, fact_schema(p), "fact_id"))
    links = [*_LINKS, *((parent, p.fact_table, word) for p in profiles for parent, word in (("dim_patient_record", "records"), ("dim_dataset", "holds"), ("dim_etl_snapshot", "loads")))]
    return "\n".join([*out, *(f"    {a} ||--o{{ {b} : {w}" for a, b, w in links)]) + "\n"


def markdown(profiles: list[DatasetProfile], rows: dict[str, int], stamp: str) -> str:
    table = "\n".join(f"| {p.fact_table} | {p.display_name} | {p.domain} | {rows.get(p.fact_table, 0):,} |" for p in profiles)
    return f"# Warehouse\n\nSnapshot: {stamp}\n\n| Fact | Dataset | Domain | Rows |\n| --- | --- | --- | ---: |\n{table}\n\n```mermaid\n{mermaid(profiles)}```\n"
