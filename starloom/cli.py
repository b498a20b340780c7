"""Commands: build, list-profiles, inspect and scaffold."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .inference.emit import emit
from .inference.engine import infer_profile
from .inference.providers import BATCH, Chain, chain_for, resolve_preset
from .inference.tables import PRESETS, PRIVACY
from .plans.clean import read_source
from .plans.governance import column_records
from .plans.profile import discover_profiles, load_profile
from .plans.warehouse import Warehouse


def session() -> SparkSession:
    return SparkSession.builder.appName("starloom").config("spark.sql.caseSensitive", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def build(args: argparse.Namespace) -> int:
    profiles = discover_profiles(args.profiles_dir)
    if args.profile:
        if unknown := set(args.profile) - {p.name for p in profiles}:
            print(f"unknown profiles: {sorted(unknown)}", file=sys.stderr)
            return 2
        profiles = [p for p in profiles if p.name in args.profile]
    done = Warehouse(session(), args.root_dir, args.output_dir).build(profiles)
    for line in build_report(profiles, done, args.output_dir):
        print(line)
    return 0


def build_report(profiles: list, done: dict, output: str) -> list[str]:
    """What a build did: for each dataset rows, labels, rules and imputations, then totals and where things are."""
    lines = [f"Built {len(profiles)} datasets, snapshot {done['snapshot_id']}:"]
    for p in profiles:
        log = done["lineage"][p.name]
        share = f", {100 * log.cleaned_target['positive'] / max(1, log.cleaned_rows):.2f} % positive" if log.cleaned_target else ""
        lines.append(f"  {p.name} -> {p.fact_table}: {log.raw_rows} rows read, {log.cleaned_rows} kept{share}")
        lines += [f"    {r['column']} {r['operator']}: {r['matched']} rows dropped" + (" (no such column)" if r["skipped"] else "") for r in log.drop_rules]
        lines += [f"    {i['column']} imputed by {i['strategy']}: {i['missing_before']} missing, {i['missing_after']} left" for i in log.imputations]
    total = sum(done["tables"].values())
    return [*lines, f"{total} patient records in {len(done['tables'])} fact tables; tables, schema and governance files are in {done.get('folder', output)}"]


def list_profiles(args: argparse.Namespace) -> int:
    for p in discover_profiles(args.profiles_dir):
        print(f"{p.name}\t{p.domain}\t{p.source_path}\t{len(p.columns)} columns")
    return 0


def inspect(args: argparse.Namespace) -> int:
    profile = load_profile(args.profile_path)
    print(json.dumps(column_records(read_source(session(), profile, args.root_dir), profile), indent=2, default=str))
    return 0


def scaffold(args: argparse.Namespace) -> int:
    source = Path(args.csv) if Path(args.csv).is_absolute() else Path(args.root_dir) / args.csv
    name = args.name or source.stem.lower().replace("-", "_").replace(" ", "_")
    out = Path(args.profiles_dir) / f"{name}.yaml"
    if not source.exists():
        print(f"no such file: {source}", file=sys.stderr)
        return 2
    if out.exists() and not args.force:
        print(f"{out} exists; --force replaces it", file=sys.stderr)
        return 2
    preset = args.slm if args.use_llm is None else "cloud" if args.use_llm and args.slm == "auto" else "off" if not args.use_llm else args.slm
    privacy = "cloud-only" if args.use_llm and args.slm == "auto" and args.privacy == "balanced" else args.privacy
    enrich = None
    if preset != "off":
        enrich = Chain(chain_for(preset, privacy, args.slm_no_embed), resolve_preset(preset, privacy), args.slm_model, source.parent, args.slm_batch_size)
    shown = source.relative_to(args.root_dir).as_posix() if source.is_relative_to(args.root_dir) else str(source)
    draft = infer_profile(session(), str(source), name, args.target, shown, enrich)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(emit(draft), encoding="utf-8")
    best = draft.effective()
    print(f"{out}: " + ", ".join(f"{c} {sum(v == c for v in best.values())}" for c in ("HIGH", "MEDIUM", "LOW")))
    target = draft.profile["target"]
    print(f"  target {target['column']}: {target['positive_value']!r} is {target['positive_int']}, {target['negative_value']!r} is {target['negative_int']}")
    for kind in sorted({c["type"] for c in draft.profile["columns"]}):
        print(f"  {kind}: " + ", ".join(c["source"] + (" (dropped)" if c.get("drop") else "") for c in draft.profile["columns"] if c["type"] == kind))
    for d in draft.decisions:
        if (d.column, d.field) == ("<file>", "llm"):
            print(f"  providers: {d.value}")
    for d in draft.reviews():
        if best.get((d.column, d.field)) == "LOW":
            print(f"  review {d.column}.{d.field}: {d.reason}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="starloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--root-dir", default=".")
        return p

    p = command("build", build)
    p.add_argument("--profiles-dir", default="profiles")
    p.add_argument("--output-dir", default="outputs")
    p.add_argument("--profile", action="append")
    command("list-profiles", list_profiles).add_argument("--profiles-dir", default="profiles")
    command("inspect", inspect).add_argument("profile_path")
    p = command("scaffold", scaffold)
    p.add_argument("csv")
    p.add_argument("--name")
    p.add_argument("--target")
    p.add_argument("--profiles-dir", default="profiles")
    p.add_argument("--force", action="store_true")
    p.add_argument("--use-llm", dest="use_llm", action="store_true", default=None)
    p.add_argument("--no-llm", dest="use_llm", action="store_false")
    p.add_argument("--slm", default="auto", choices=["auto", *PRESETS])
    p.add_argument("--slm-model")
    p.add_argument("--slm-batch-size", type=int, default=BATCH)
    p.add_argument("--slm-no-embed", action="store_true")
    p.add_argument("--privacy", default="balanced", choices=PRIVACY)
    args = parser.parse_args(argv)
    return args.run(args)
