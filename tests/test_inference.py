"""Inference rules on small columns, the maternal file, providers and the command line."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import numpy as np
import pytest
import yaml

from starloom.cli import main
from starloom.inference import engine, providers
from starloom.inference.emit import emit, flow, scalar
from starloom.inference.providers import Chain, Column, Suggestion, chain_for, coerce, resolve_preset, tolerant_json
from starloom.plans.profile import parse_profile
from starloom.plans.warehouse import Warehouse

#: A public file, if there is one.
MATERNAL = Path(os.environ.get("STARLOOM_DATASETS", "datasets")) / "maternal_health_risk.csv"


def column(name="x", rows=100, nulls=0, distinct=2, numeric=False, fractional=False, whole=False, listed=None, **more):
    return Column(name, rows, nulls, distinct, numeric, fractional, whole, listed, listed or [], **more)


@pytest.mark.parametrize(
    ("name", "role", "key"),
    [("Age", "age", "age_bracket"), ("AP_HI", "lab", "bp_band"), ("A/G Ratio", "lab", None), ("SBP mmHg", "lab", "bp_band"), ("ag", "age", "age_bracket"), ("Patient-ID", None, None)],
)
def test_name_patterns(name, role, key):
    found = engine.match_pattern(name)
    assert found[:2] == (role, key)
    assert engine.match_pattern("MDVP:Jitter(%)") is None


def test_ranges():
    window = lambda lo, mid, hi, n=50: engine.match_range(column(numeric=True, rows=n, p5=lo, median=mid, p95=hi))
    assert window(90, 120, 150)[0] == "systolic-BP" and window(60, 76, 88)[0] == "diastolic-BP" and window(5, 40, 70)[0] == "age-years"
    assert window(90, 120, 150, 9) is None and window(5, 5, 5) is None


def test_classify():
    assert engine.classify(column(rows=51, distinct=51, numeric=True, whole=True))[0] == "identifier"
    assert engine.classify(column(rows=51, distinct=51, numeric=True, fractional=True, whole=True))[0] == "numeric"
    assert engine.classify(column(distinct=2))[0] == "binary"
    assert engine.classify(column(distinct=8, numeric=True, whole=True))[:2] == ("ordinal", "MEDIUM")
    assert engine.classify(column(distinct=20))[:2] == ("nominal", "HIGH") and engine.classify(column(distinct=21))[:2] == ("nominal", "LOW")


def test_target():
    columns = {n: column(n, distinct=d) for n, d in (("a", 2), ("b", 2), ("c", 9))}
    assert engine.detect_target(columns)[:2] == ("b", "MEDIUM")
    assert engine.detect_target(columns | {"y": column("y", distinct=9), "Class": column("Class")})[0] == "Class"
    assert engine.detect_target(columns, "c")[:2] == ("c", "HIGH")
    for bad in ({"c": column("c", distinct=9)}, {}):
        with pytest.raises(ValueError):
            engine.detect_target(bad)
    with pytest.raises(ValueError):
        engine.detect_target(columns, "z")


def test_target_encoding():
    code = lambda *v: engine.target_encoding(list(v))
    assert (code(1, 2)[0]["positive_value"], code(1, 2)[0]["negative_value"]) == (1, 2)
    assert code("ckd", "notckd")[0]["positive_value"] == "ckd" and code("sick", "not sick")[0]["positive_value"] == "sick"
    assert code("A", "B")[0]["positive_value"] == "B" and code("No", "Yes")[0]["positive_value"] == "Yes"
    assert code(0, 1, 2)[1] == {0: 0, 1: 1, 2: 1}
    spec, mapping = code("high risk", "low risk", "mid risk")
    assert mapping == {"high risk": 1, "low risk": 0, "mid risk": 1} and (spec["positive_value"], spec["negative_value"]) == ("high risk", "low risk")
    assert code("x", "severe", "z")[1] == {"severe": 1, "x": 0, "z": 0}
    assert code("x", "y", "z")[1] is None


def test_mapping():
    propose = lambda *v: engine.propose_mapping(column(listed=list(v)))
    assert propose("YES", "no")[:2] == ({"YES": 1, "no": 0}, "HIGH") and propose("Good", "Poor")[0] == {"Good": 0, "Poor": 1}
    assert propose("ill", "not_ill")[0] == {"ill": 1, "not_ill": 0} and propose("b", "a")[:2] == ({"a": 0, "b": 1}, "LOW")
    assert propose("a", "b", "c") is None and engine.propose_mapping(column(numeric=True, listed=[0, 1])) is None
    assert engine.not_pair("no", "yes") is None and engine.not_pair("disease", "no_disease") == ("disease", "no_disease")


def test_units():
    ages = lambda m: engine.age_unit(column(numeric=True, max=m))
    assert ages(23000)[0] == pytest.approx(1 / 365.25) and ages(90) is None and ages(13)[0] is None and ages(60000)[0] is None


@pytest.mark.skipif(not MATERNAL.exists(), reason="the public file is not here")
def test_maternal_file(spark):
    draft = engine.infer_profile(spark, str(MATERNAL))
    by = {c["source"]: c for c in draft.profile["columns"]}
    assert {n: (c["type"], c.get("role")) for n, c in by.items()} == {"Age": ("numeric", "age"), "SystolicBP": ("numeric", "lab"), "DiastolicBP": ("numeric", "lab"), "BS": ("numeric", None), "BodyTemp": ("numeric", None), "HeartRate": ("numeric", "lab"), "RiskLevel": ("nominal", None)}
    assert by["RiskLevel"]["mapping"] == {"high risk": 1, "low risk": 0, "mid risk": 1}
    assert draft.profile["target"]["column"] == "RiskLevel" and draft.delimiter == ","
    assert [h["new_column"] for h in draft.profile["hierarchies"]] == ["age_bracket", "bp_band"]
    best = list(draft.effective().values())
    assert (best.count("HIGH"), best.count("MEDIUM"), best.count("LOW")) == (13, 7, 4)
    text = emit(draft)
    assert text.count("# REVIEW: role") == 2
    assert parse_profile(yaml.safe_load(text)).target.negative_value == "low risk"


def test_yaml_scalars_round_trip():
    for v in ["yes", "No", "1", "1.0", "null", 'a "b"', "x: y", "", " a", "true", "-", "é", 1, 1.5, True, None, "2020-01-01", "\t"]:
        assert yaml.safe_load(f"k: {scalar(v)}")["k"] == v
    assert yaml.safe_load(flow({"No": 0, "a": ["x", {"b": 1}]})) == {"No": 0, "a": ["x", {"b": 1}]}


def test_presets_and_privacy(monkeypatch):
    monkeypatch.setattr(providers, "local_model_open", lambda: False)
    monkeypatch.setattr(providers, "has_embedder", lambda: True)
    monkeypatch.setenv("GEMINI_API_KEY", "k")
    assert chain_for("cloud", "strict") == ["embedding"] and chain_for("small", "balanced") == ["embedding", "ollama", "gemini"]
    assert chain_for("small", "balanced", True) == ["ollama", "gemini"] and chain_for("auto", "cloud-only") == ["gemini"]
    assert resolve_preset("auto", "strict") == "embed-only" and resolve_preset("auto", "balanced") == "cloud"
    monkeypatch.delenv("GEMINI_API_KEY")
    monkeypatch.setattr(providers, "has_embedder", lambda: False)
    assert resolve_preset("auto", "balanced") == "off" and chain_for("auto", "balanced") == []
    with pytest.raises(KeyError):
        resolve_preset("huge", "strict")


def test_replies():
    assert tolerant_json('Sure:\n```json\n[{"a": 1}]\n```') == [{"a": 1}] and tolerant_json('x {"a": 2} y') == {"a": 2} and tolerant_json("none") is None
    s = coerce({"name": "c", "role": "identifier", "mapping": '{"a": "1", "b": "z"}', "confidence": "sure", "reason": "r" * 300})
    assert s == Suggestion("c", None, None, {"a": 1}, "LOW", "r" * 200)
    assert coerce({"role": "lab"}) is None


def test_chain(tmp_path, monkeypatch):
    calls = []

    class Fake:
        def available(self):
            return True, ""

        def suggest(self, columns, target, file, model):
            calls.append([c.name for c in columns])
            return [{"column": c.name, "role": "lab", "confidence": "HIGH"} for c in columns if c.name != "c"]

    class Broken(Fake):
        def suggest(self, *a):
            raise RuntimeError("down")

    monkeypatch.setitem(providers.PROVIDERS, "fake", Fake)
    monkeypatch.setitem(providers.PROVIDERS, "broken", Broken)
    columns = {n: column(n) for n in "abc"}
    chain = Chain(["broken", "nothing", "fake"], cache_dir=tmp_path, batch=2)
    found, said = chain(columns, list("abc"), "t", "f.csv")
    assert sorted(found) == ["a", "b"] and calls == [["a", "b"], ["c"]] and "broken: failed" in said and "still open: 1" in said
    again, _ = chain(columns, list("abc"), "t", "f.csv")
    assert sorted(again) == ["a", "b"] and len(calls) == 2
    assert json.loads((tmp_path / ".llm_cache.json").read_text())
    assert chain({}, [], "t", "f") == ({}, "no open columns")
    entries = [{"source": "a", "description": "TODO: describe a"}, {"source": "b", "role": "age", "mapping": {}}]
    done = engine.merge(entries, columns, {"a": Suggestion("a", "lab", "text", {"zz": 1}, "MEDIUM"), "b": Suggestion("b", "lab")})
    assert entries[0] == {"source": "a", "description": "text", "role": "lab"} and entries[1]["role"] == "age" and len(done) == 2


def test_word_provider():
    got = providers.WordProvider().suggest([column("blood pressure"), column("zq")], "t", "f", "")
    assert [(g["column"], g["role"]) for g in got] == [("blood pressure", "lab")]


def test_command_line(spark, tmp_path, capsys):
    rows = "\n".join(f"{i},{20 + i % 60},{'Yes' if i % 2 else 'No'}" for i in range(80))
    (tmp_path / "d.csv").write_text(f"id,age,class\n{rows}\n")
    base = ["--root-dir", str(tmp_path), "--profiles-dir", str(tmp_path / "profiles")]
    assert main(["scaffold", "d.csv", "--no-llm", *base]) == 0
    assert main(["scaffold", "d.csv", "--no-llm", *base]) == 2 and main(["scaffold", "none.csv", *base]) == 2
    assert main(["list-profiles", *base]) == 0
    assert main(["build", "--output-dir", str(tmp_path / "out"), *base]) == 0
    assert main(["build", "--output-dir", str(tmp_path / "out"), "--profile", "zz", *base]) == 2
    capsys.readouterr()
    assert main(["inspect", str(tmp_path / "profiles/d.yaml"), "--root-dir", str(tmp_path)]) == 0
    assert [r["source_column"] for r in json.loads(capsys.readouterr().out)] == ["id", "age", "class"]
    summary = Warehouse(spark, tmp_path, tmp_path / "out").table("fact_d").groupBy("label").count().collect()
    assert sorted(map(tuple, summary)) == [(0, 40), (1, 40)]


class Replies(BaseHTTPRequestHandler):
    """Answers like a local daemon and like a cloud model."""

    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked.append((self.path, body, self.headers.get("x-goog-api-key")))
        text = json.dumps({"columns": [{"name": "bs", "role": "lab", "description": "Blood sugar.", "confidence": "HIGH", "reason": "name"}, "odd"]})
        reply = {"response": f"```json\n{text}\n```"} if self.path == "/api/generate" else {"candidates": [{"content": {"parts": [{"text": text}]}}]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())

    def log_message(self, *args):
        pass


def test_models_over_http(monkeypatch, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Replies)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, columns = f"http://127.0.0.1:{server.server_port}", {"bs": column("bs", numeric=True, min=1.0, max=9.0, median=4.0)}
    monkeypatch.setenv("GEMINI_API_KEY", "key")
    monkeypatch.setitem(providers.PROVIDERS, "ollama", lambda: providers.OllamaProvider(url))
    monkeypatch.setitem(providers.PROVIDERS, "gemini", lambda: providers.GeminiProvider(url))
    for backend, model in (("ollama", "small"), ("gemini", "cloud")):
        found, said = Chain([backend], model, "m", tmp_path)(columns, ["bs"], "out", "file.csv")
        assert (found["bs"].role, found["bs"].confidence, found["bs"].provider) == ("lab", "HIGH", backend) and "1 calls" in said
    (path, body, _), (cloud, asked, key) = Replies.asked
    assert path == "/api/generate" and body["options"]["temperature"] == 0 and body["format"] == "json" and '"median": 4.0' in body["prompt"]
    assert cloud.endswith(":generateContent") and key == "key" and asked["generationConfig"]["responseMimeType"] == "application/json"
    server.shutdown()
    server.server_close()  # else the port still takes connections, and the call waits its five minutes
    assert Chain(["ollama"], "small", "m")(columns, ["bs"], "out", "f")[0] == {}


def test_nearest_role():
    names, reference = ["x", "y"], np.array([[1.0, 0], [0, 1]])
    (first, cosine, lead), zero = providers.nearest(np.array([[3.0, 4], [0, 0]]), names, reference)
    assert first == "y" and abs(cosine - 0.8) < 1e-12 and abs(lead - 0.2) < 1e-12 and zero == ("x", 0.0, 0.0)
    sure = providers.by_similarity([column("a"), column("b")], [("lab", 0.8, 0.2), ("age", 0.6, 0.01)])
    assert [(s["column"], s["confidence"]) for s in sure] == [("a", "HIGH")]
