"""Drafts as YAML, with a REVIEW note above what is uncertain."""

from __future__ import annotations

import re
from typing import Any

import yaml

from .engine import LOW, MEDIUM, Draft

_ORDER = ("source", "fact_column", "role", "type", "mapping", "domain", "scale_factor", "imputation", "drop", "description")


def scalar(value: Any) -> str:
    """One value in YAML: texts that would read as something else are quoted."""
    if isinstance(value, str):
        if value == ".inf":
            return value
        plain = re.fullmatch(r"[A-Za-z][A-Za-z0-9 _./+-]*", value) and value == value.strip() and value.lower() not in ("yes", "no", "on", "off", "true", "false", "null", "y", "n")
        return value if plain else '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
    return yaml.safe_dump(value, default_flow_style=True).split("\n")[0].removesuffix("...").strip()


def flow(value: Any) -> str:
    if isinstance(value, dict):
        return "{" + ", ".join(f"{scalar(k)}: {flow(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(flow, value)) + "]"
    return scalar(value)


def emit(draft: Draft, header: bool = True) -> str:
    p, best = draft.profile, draft.effective()
    out = []
    if header:
        counts = {c: sum(v == c for v in best.values()) for c in ("HIGH", MEDIUM, LOW)}
        out += [f"# Draft profile. Decisions: {counts['HIGH']} high, {counts[MEDIUM]} medium, {counts[LOW]} low.", "# Each REVIEW note is an open question.", ""]
    out += [f"{k}: {scalar(p[k])}" for k in ("name", "display_name", "domain", "description")]
    for block in ("source", "target"):
        out += ["", f"{block}:"]
        if block == "target" and best.get((p["target"]["column"], "target")) != "HIGH":
            out.append("  # REVIEW: is this the target?")
        out += [f"  {k}: {flow(v)}" for k, v in p[block].items()]
    out += ["", "columns:"]
    for entry in p["columns"]:
        notes = [d for d in draft.decisions if d.column == entry["source"] and d.confidence == LOW and best.get((d.column, d.field)) == LOW]
        out += [f"  # REVIEW: {d.field}: {d.reason}" for d in notes]
        keys = [k for k in _ORDER if k in entry and entry[k] is not None]
        out += [f"  {'- ' if i == 0 else '  '}{k}: {flow(entry[k])}" for i, k in enumerate(keys)]
    out += ["", "cleaning:", f"  strip_whitespace: {flow(p['cleaning']['strip_whitespace'])}", f"  drop_rows_where: {flow(p['cleaning']['drop_rows_where'])}", ""]
    if p["hierarchies"]:
        out.append("hierarchies:")
        for h in p["hierarchies"]:
            out += [f"  - source_column: {scalar(h['source_column'])}", f"    new_column: {h['new_column']}", "    bands:", *(f"      - {flow(b)}" for b in h["bands"])]
    else:
        out.append("hierarchies: []")
    return "\n".join(out) + "\n"
