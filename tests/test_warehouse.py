"""The build over a small file, profile by profile, with hand-computed values."""

import json
import os
import random
import statistics
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from starloom import discover_profiles, load_profile
from starloom.plans.clean import clean, read_source
from starloom.plans.profile import parse_profile
from starloom.plans.warehouse import Warehouse, catalog
from starloom.sources.delimited import read_delimited
from starloom.sources.files import Files

ROOT = Path(__file__).resolve().parent.parent

CSV = """﻿id;age;sex;kind;lab;note;out
1;17;Male;a;1.5;x;yes
2;18;Female;b;?;y ;no
3;60;Other;a;2.5;x;yes
4;80;female;b;NA;;no
5;40;Male; a;4.5;x;yes
5;40;Male; a;4.5;x;yes
"""

PROFILE = {
    "name": "demo",
    "source": {"path": "demo.csv", "delimiter": ";"},
    "target": {"column": "out", "positive_value": "yes", "negative_value": "no"},
    "columns": [
        {"source": "id", "type": "identifier", "drop": True},
        {"source": "age", "type": "numeric", "role": "age"},
        {"source": "sex", "type": "binary", "role": "gender", "mapping": {"Male": 1, "Female": 0}},
        {"source": "kind", "type": "nominal", "role": "lab", "domain": ["a", "b"]},
        {"source": "lab", "type": "numeric", "role": "lab", "imputation": {"strategy": "median"}},
        {"source": "note", "type": "nominal", "imputation": {"strategy": "constant", "value": "Unknown"}},
        {"source": "out", "type": "binary"},
        {"source": "gone", "type": "numeric"},
    ],
    "cleaning": {"drop_rows_where": [{"column": "sex", "value": "other", "ci": True}]},
    "hierarchies": [{"source_column": "age", "new_column": "age_bracket", "bands": [{"label": "young", "upper_exclusive": 40}, {"label": "old", "upper_exclusive": ".inf"}]}, {"source_column": "lab", "new_column": "lab_band", "bands": [{"label": "low", "upper_exclusive": 3}, {"label": "high", "upper_exclusive": ".inf"}]}],
}


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("demo")
    (root / "demo.csv").write_text(CSV, encoding="utf-8")
    profile = parse_profile(PROFILE)
    warehouse = Warehouse(spark, root, root / "out")
    return profile, warehouse, warehouse.build([profile])


def test_lineage(demo):
    log = demo[2]["lineage"]["demo"]
    assert (log.raw_rows, log.raw_columns, log.raw_missing_cells, log.duplicate_rows) == (6, 7, 3, 1)
    assert (log.removed_rows_total, log.removed_rows_positive, log.cleaned_rows) == (1, 1, 5)
    assert log.cleaned_target == {"positive": 3, "negative": 2}
    assert [(i["column"], i["missing_before"], i["missing_after"]) for i in log.imputations] == [("lab", 2, 0), ("note", 1, 0)]


def test_gold(demo, spark):
    profile, warehouse, _ = demo
    facts = warehouse.table("fact_demo").orderBy("fact_id").collect()
    assert [(r.fact_id, r.patient_record_id, r.kind, r.lab, r.note, r.lab_band, r.label) for r in facts] == [(1, 1, "a", 1.5, "x", "low", 1), (2, 2, "b", 4.5, "y", "high", 0), (3, 3, "b", 4.5, "Unknown", "high", 0), (4, 4, "a", 4.5, "x", "high", 1), (5, 5, "a", 4.5, "x", "high", 1)]
    people = warehouse.table("dim_patient_record").orderBy("patient_record_id").collect()
    assert [(r.age, r.gender_id, r.age_bracket) for r in people] == [(17.0, 1, "0-17"), (18.0, 0, "18-39"), (80.0, -1, "80+"), (40.0, 1, "40-59"), (40.0, 1, "40-59")]
    assert spark.sql("select * from vw_disease_summary").collect()[0][:] == ("demo", 5, 3, 60.0)
    view = spark.sql("select * from vw_demo_full order by patient_record_id")
    assert view.columns[:6] == ["patient_record_id", "snapshot_id", "source_record_num", "age", "gender", "age_bracket"] and view.columns[-1] == "demo_label"
    assert [r.gender for r in view.collect()] == ["Male", "Female", "Unknown", "Male", "Male"]
    assert not any(warehouse.check([profile]).values())
    assert {"vw_demo_full", "fact_demo"} <= {r.name for r in catalog(spark).collect()}


def test_governance(demo):
    profile, warehouse, _ = demo
    rows = {r.source_column: r for r in warehouse.table("metadata_data_dictionary").collect()}
    assert len(rows) == 8 and rows["gone"].inferred_type == "absent" and rows["lab"].null_count == 2 and rows["lab"].null_pct == pytest.approx(33.3333)
    assert json.loads(rows["lab"].numeric_stats_json)["median"] == 3.5
    assert json.loads(rows["kind"].categorical_stats_json)["top_values"] == {"a": 2, "b": 2, " a": 2}
    lineage = warehouse.table("metadata_lineage").orderBy("lineage_id").collect()
    assert [(r.pipeline_stage, r.row_count, r.positive_count, r.negative_count) for r in lineage] == [("raw", 6, 4, 2), ("cleaned", 5, 3, 2), ("warehouse", 5, 3, 2)]
    assert warehouse.table("etl_audit_log").count() == 4 + 2 + 2 * 2
    assert "CREATE OR REPLACE VIEW vw_disease_summary" in Path(warehouse.path("schema.sql")).read_text()
    assert Path(warehouse.path("schema.mmd")).read_text().startswith("erDiagram")
    assert "| fact_demo |" in Path(warehouse.path("schema.md")).read_text()
    assert json.loads(Path(warehouse.path("data_dictionary.json")).read_text())["datasets"][0]["name"] == "demo"


def test_rebuild_replaces(demo):
    profile, warehouse, _ = demo
    warehouse.build([profile])
    assert warehouse.table("dim_patient_record").count() == 5


def test_failures(spark, tmp_path):
    (tmp_path / "demo.csv").write_text(CSV, encoding="utf-8")
    bad = parse_profile(PROFILE | {"columns": [c if c["source"] != "kind" else c | {"domain": ["a"]} for c in PROFILE["columns"]]})
    with pytest.raises(ValueError, match="domains.*'b'"):
        clean(read_source(spark, bad, str(tmp_path)), bad)
    holes = parse_profile(PROFILE | {"columns": [{k: v for k, v in c.items() if k != "imputation"} for c in PROFILE["columns"]]})
    with pytest.raises(ValueError, match="missing values remain.*'lab': 2"):
        clean(read_source(spark, holes, str(tmp_path)), holes)
    rule = parse_profile(PROFILE | {"columns": [c | ({"imputation": {"strategy": "guess"}} if c["source"] == "lab" else {}) for c in PROFILE["columns"]]})
    with pytest.raises(ValueError, match="guess"):
        clean(read_source(spark, rule, str(tmp_path)), rule)


def test_bundled_profiles():
    found = discover_profiles(ROOT / "profiles")
    assert [p.name for p in found] == ["cardio", "cdc_diabetes", "cdc_heart_disease", "chronic_kidney_disease", "diabetes", "heart_disease", "stroke"]
    by = {p.name: p for p in found}
    assert by["diabetes"].columns[2].mapping == {"Yes": 1, "No": 0}
    assert by["cdc_diabetes"].by_role("age").mapped_first and not by["stroke"].by_role("gender").mapped_first
    assert [c.fact_column for c in by["heart_disease"].fact_columns()] == ["cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang", "oldpeak", "slope", "ca", "thal"]
    assert by["heart_disease"].fact_bands() == ["chol_band", "bp_band"]


#: A folder with the public files that the profiles name, if there is one.
HEART = Path(os.environ.get("STARLOOM_DATASETS", "datasets")) / "heart_disease_cleveland.csv"


@pytest.mark.skipif(not HEART.exists(), reason="the public file is not here")
def test_heart_file(spark):
    """The public Cleveland file through its profile."""
    profile = load_profile(ROOT / "profiles/heart_disease.yaml")
    raw = read_delimited(spark, str(HEART), ",", profile.na_values)
    df, log = clean(raw, profile)
    assert (log.raw_rows, log.raw_columns, log.raw_missing_cells, log.duplicate_rows) == (303, 14, 6, 0)
    assert log.raw_target == {"0": 164, "1": 55, "2": 36, "3": 35, "4": 13}
    assert log.cleaned_target == {"positive": 139, "negative": 164} and log.cleaned_columns == 17
    count = lambda c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}
    assert count("ca") == {0.0: 180, 1.0: 65, 2.0: 38, 3.0: 20}
    assert count("thal") == {3.0: 168, 7.0: 117, 6.0: 18}
    assert count("age_bracket") == {"18-39": 15, "40-59": 197, "60-79": 91}
    assert count("chol_band") == {"desirable": 49, "borderline": 98, "high": 156}
    assert count("bp_band") == {"normal": 60, "elevated": 75, "stage-1-htn": 70, "stage-2-htn": 93, "crisis": 5}


def heart_rows():
    """A stand-in for the public Cleveland file: the same columns and kinds of values, drawn by a fixed rule."""
    rng = random.Random(7)
    rows = []
    for _ in range(303):
        ca, thal = rng.choice(["0.0", "1.0", "2.0", "3.0"]), rng.choice(["3.0", "6.0", "7.0"])
        rows.append([f"{rng.randrange(29, 78)}.0", f"{rng.randrange(2)}.0", f"{rng.randrange(1, 5)}.0", f"{rng.randrange(94, 201)}.0", f"{rng.randrange(126, 565)}.0", f"{rng.randrange(2)}.0", f"{rng.randrange(3)}.0", f"{rng.randrange(71, 203)}.0", f"{rng.randrange(2)}.0", f"{rng.randrange(63) / 10}", f"{rng.randrange(1, 4)}.0", ca, thal, str(rng.choice([0, 0, 1, 2, 3, 4]))])
    for i in (5, 90, 177, 300):
        rows[i][11] = "?"
    for i in (11, 200):
        rows[i][12] = "?"
    return rows


def test_heart_stand_in(spark, tmp_path):
    names, rows = "age sex cp trestbps chol fbs restecg thalach exang oldpeak slope ca thal num".split(), heart_rows()
    profile = load_profile(ROOT / "profiles/heart_disease.yaml")
    file = tmp_path / profile.source_path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text("\n".join(",".join(r) for r in [names, *rows]), encoding="utf-8")
    warehouse = Warehouse(spark, tmp_path, tmp_path / "out")
    log = warehouse.build([profile])["lineage"]["heart_disease"]
    assert (log.raw_rows, log.raw_columns, log.raw_missing_cells, log.duplicate_rows) == (303, 14, 6, 0)
    assert log.raw_target == dict(Counter(r[13] for r in rows))
    sick = sum(r[13] != "0" for r in rows)
    assert log.cleaned_target == {"positive": sick, "negative": 303 - sick}
    fact = warehouse.table("fact_heart_disease").orderBy("fact_id").collect()
    for at, name in ((11, "ca"), (12, "thal")):
        middle = statistics.median([float(r[at]) for r in rows if r[at] != "?"])
        assert [float(r[name]) for r in fact] == [middle if r[at] == "?" else float(r[at]) for r in rows]
    patients = {r["age_bracket"]: r["n"] for r in warehouse.table("dim_patient_record").groupBy("age_bracket").agg(F.count("*").alias("n")).collect()}
    bracket = lambda a: "0-17" if a < 18 else "18-39" if a < 40 else "40-59" if a < 60 else "60-79" if a < 80 else "80+"
    assert patients == dict(Counter(bracket(float(r[0])) for r in rows))
    assert not any(warehouse.check([profile]).values())


class Gone(Exception):
    pass


def test_a_build_that_dies_leaves_the_old_warehouse(spark, tmp_path, monkeypatch):
    """The machine goes before the files are whole and before the manifest is there, a second warehouse looks at the folder each time."""
    (tmp_path / "demo.csv").write_text(CSV, encoding="utf-8")
    profile, out = parse_profile(PROFILE), tmp_path / "out"
    first = Warehouse(spark, tmp_path, out)
    with pytest.raises(FileNotFoundError):
        first.table("fact_demo")
    old = first.build([profile])["folder"]
    rows = sorted(map(tuple, first.table("fact_demo").collect()), key=str)
    bigger = parse_profile(PROFILE | {"cleaning": {}})
    for name, step in (("write", 3), ("claim", 1)):
        calls, real = [0], getattr(Files, name)

        def stop(self, *args, calls=calls, real=real, step=step):
            calls[0] += 1
            if calls[0] == step:
                raise Gone
            return real(self, *args)

        monkeypatch.setattr(Files, name, stop)
        with pytest.raises(Gone):
            first.build([bigger])
        monkeypatch.undo()
        second = Warehouse(spark, tmp_path, out)
        assert second.latest().folder == old and sorted(map(tuple, second.table("fact_demo").collect()), key=str) == rows
    # a manifest that was not written to its end is no manifest, and its number is not taken again
    (out / "manifests" / "00000002.json").write_text('{"snapshot": "ha')
    assert Warehouse(spark, tmp_path, out).latest().folder == old
    done = first.build([profile])
    assert done["build"] == 3 and second.latest().folder == done["folder"]
    # after the manifest is there the new build counts, even if the machine goes before the old ones do
    monkeypatch.setattr(Warehouse, "_tidy", lambda self: (_ for _ in ()).throw(Gone()))
    with pytest.raises(Gone):
        first.build([profile])
    monkeypatch.undo()
    assert second.latest().folder not in (old, done["folder"]) and second.table("fact_demo").count() == 5


def test_builders_and_a_reader_at_once(spark, tmp_path):
    """Builders that publish at the same moment all get a number of their own, a reader stays with its snapshot."""
    out = tmp_path / "out"
    houses = [Warehouse(spark, tmp_path, out, keep=100) for _ in range(8)]
    for i in range(8):
        (out / "snapshots" / f"s{i}").mkdir(parents=True)
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: houses[i]._publish({"snapshot": f"s{i}", "buckets": 1, "bucketed": []}), range(8)))
    assert sorted(numbers) == list(range(1, 9))
    assert [m["snapshot"] for _, m in houses[0]._manifests()] == [f"s{i}" for i in sorted(range(8), key=lambda i: -numbers[i])]
    (tmp_path / "demo.csv").write_text(CSV, encoding="utf-8")
    profile, house = parse_profile(PROFILE), Warehouse(spark, tmp_path, tmp_path / "two")
    house.build([profile])
    reader = house.latest()
    before = reader.table("fact_demo")
    (tmp_path / "demo.csv").write_text("\n".join(CSV.splitlines()[:3]) + "\n9;30;Male;a;1;x;yes\n8;30;Male;b;1;x;no\n", encoding="utf-8")
    other = Warehouse(spark, tmp_path, tmp_path / "two")
    other.build([profile])
    assert before.count() == 5 and reader.table("dim_patient_record").count() == 5 and other.table("fact_demo").count() == 4
    assert not any(house.check([profile]).values())
    other.keep = 1
    other._tidy()
    assert [p.name for p in (tmp_path / "two" / "snapshots").iterdir()] == [other.latest().folder.rsplit("/", 1)[-1]]


def test_views_move_no_rows(demo, spark):
    _, warehouse, _ = demo
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts, patients = warehouse.table("fact_demo"), warehouse.table("dim_patient_record")
        plan = facts.join(patients, "patient_record_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
