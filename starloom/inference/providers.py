"""Providers that say what rules leave open: a protocol, a chain with a cache, and presets that respect privacy.

A provider sees column statistics and at most a dozen sample values, never rows.  Local and cloud
models are asked over HTTP; other back-ends register a factory under a name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import socket
import urllib.parse
import urllib.request
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Protocol

import numpy as np

from . import tables

ROLES = tuple(tables.ROLE_TEXTS)
RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
#: Least similarity to a role, least lead over the next one, and the similarity that is certain.
ACCEPT, MARGIN, CERTAIN = 0.55, 0.07, 0.72
#: Columns of one request, and characters of a reason.
BATCH, REASON = 40, 200
#: Tokens of a local model's context.
CONTEXT = 8192
CACHE_FILE = ".llm_cache.json"


@dataclass
class Column:
    name: str
    rows: int
    nulls: int
    distinct: int
    numeric: bool
    fractional: bool
    whole: bool
    listed: list[Any] | None
    samples: list[Any]
    min: float | None = None
    max: float | None = None
    p5: float | None = None
    median: float | None = None
    p95: float | None = None

    @property
    def values(self) -> int:
        return self.rows - self.nulls

    def payload(self) -> dict[str, Any]:
        """What a provider may see."""
        stats: dict[str, Any] = {"rows": self.rows, "nulls": self.nulls, "distinct": self.distinct}
        if self.numeric and self.min is not None:
            stats |= {"min": self.min, "max": self.max, "median": self.median}
        plain = [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in self.samples[:12]]
        return {"samples": plain, "stats": stats}

    def digest(self) -> str:
        return hashlib.sha1(json.dumps(self.payload(), sort_keys=True, default=str).encode()).hexdigest()[:16]


@dataclass
class Suggestion:
    column: str
    role: str | None = None
    description: str | None = None
    mapping: dict[str, int] | None = None
    confidence: str = "LOW"
    reason: str = ""
    provider: str = ""


class Provider(Protocol):
    def available(self) -> tuple[bool, str]: ...

    def suggest(self, columns: list[Column], target: str, file: str, model: str) -> list[dict[str, Any]]:
        """Raw suggestions; they are checked before use."""


def coerce(raw: Any, provider: str = "") -> Suggestion | None:
    """A checked suggestion: known roles, whole-number mappings, known confidences; None without a column name."""
    if not isinstance(raw, dict):
        return None
    name = raw.get("name") or raw.get("column")
    if not isinstance(name, str):
        return None
    mapping = raw.get("mapping")
    if isinstance(mapping, str):
        mapping = tolerant_json(mapping)
    codes: dict[str, int] = {}
    for k, v in mapping.items() if isinstance(mapping, dict) else ():
        try:
            codes[str(k)] = int(v)
        except (TypeError, ValueError):
            continue
    text, sure = raw.get("description"), str(raw.get("confidence", "LOW")).upper()
    return Suggestion(name, raw.get("role") if raw.get("role") in ROLES else None, text if isinstance(text, str) and text.strip() else None, codes or None, sure if sure in RANK else "LOW", str(raw.get("reason", ""))[:REASON], provider)


def tolerant_json(text: str) -> Any:
    """The JSON in a reply: as it is, inside a fence, or between its outer brackets; None if there is none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    tries = [text, *([fenced[1]] if fenced else [])]
    for a, b in ("{}", "[]"):
        if 0 <= text.find(a) < text.rfind(b):
            tries.append(text[text.find(a) : text.rfind(b) + 1])
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


class WordProvider:
    """Role by the words that a column's name and texts share with the roles' descriptions; needs no model."""

    def available(self) -> tuple[bool, str]:
        return True, ""

    @staticmethod
    def vector(text: str) -> Counter:
        words = re.findall(r"[a-z]+", text.lower())
        return Counter(w[i : i + 4] for w in words for i in range(max(1, len(w) - 3)))

    def suggest(self, columns: list[Column], target: str, file: str, model: str) -> list[dict[str, Any]]:
        out = []
        roles = {r: self.vector(t) for r, t in tables.ROLE_TEXTS.items()}
        for c in columns:
            q = self.vector(f"{c.name} " + " ".join(s for s in map(str, c.samples[:5]) if not re.fullmatch(r"[\d.\-]+", s)))
            near = sorted(((sum(min(n, v[g]) for g, n in q.items()) / max(1, sum(q.values())), r) for r, v in roles.items()), reverse=True)
            (best, role), (second, _) = near[0], near[1]
            if best >= ACCEPT and best - second >= MARGIN:
                out.append({"column": c.name, "role": role, "confidence": "HIGH" if best >= CERTAIN else "MEDIUM", "reason": f"similarity {best:.2f}, lead {best - second:.2f}"})
        return out


def nearest(vectors: np.ndarray, names: list[str], references: np.ndarray) -> list[tuple[str, float, float]]:
    """(name, cosine, lead over the next one) of each vector's nearest reference; the first of equals, 0 for a zero vector."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    cosine = unit(np.asarray(vectors, float)) @ unit(np.asarray(references, float)).T
    best = cosine.argmax(axis=1)
    ordered = np.sort(cosine, axis=1)
    lead = ordered[:, -1] - ordered[:, -2] if len(names) > 1 else ordered[:, -1]
    return [(names[b], float(row[b]), float(m)) for b, row, m in zip(best, cosine, lead, strict=True)]


def by_similarity(columns: list[Column], found: list[tuple[str, float, float]]) -> list[dict[str, Any]]:
    """Roles that are near enough and clearly nearest."""
    sure = lambda c: "HIGH" if c >= CERTAIN else "MEDIUM"
    return [{"column": c.name, "role": role, "confidence": sure(cosine), "reason": f"cosine {cosine:.2f}, lead {lead:.2f}"} for c, (role, cosine, lead) in zip(columns, found, strict=True) if cosine >= ACCEPT and lead >= MARGIN]


class EmbeddingProvider:
    """The same with an installed sentence-embedding model."""

    def __init__(self):
        self.model = None

    def available(self) -> tuple[bool, str]:
        return has_embedder(), "sentence-transformers is not installed"

    def suggest(self, columns: list[Column], target: str, file: str, model: str) -> list[dict[str, Any]]:
        from sentence_transformers import SentenceTransformer

        self.model = self.model or SentenceTransformer(model)
        roles = list(tables.ROLE_TEXTS)
        texts = [f"{c.name}: {', '.join(map(str, c.samples[:5]))}" for c in columns]
        vectors = np.asarray(self.model.encode([*tables.ROLE_TEXTS.values(), *texts]))
        return by_similarity(columns, nearest(vectors[len(roles) :], roles, vectors[: len(roles)]))


def question(columns: list[Column], target: str, file: str) -> str:
    """What a language model is asked: statistics and samples of the open columns, and the shape of the answer."""
    asked = json.dumps([{"name": c.name} | c.payload() for c in columns], default=str)
    return (
        f"The columns below come from the table {file}; its target is {target}. For each, give its role (one of {', '.join(ROLES)}, or null), "
        "a description of at most twelve words, a mapping of its texts to whole numbers if they are codes (else null), "
        'a confidence (HIGH, MEDIUM or LOW) and a short reason. Answer with JSON alone: {"columns": [{"name", "role", "description", "mapping", "confidence", "reason"}]}.\n' + asked
    )


def _post(url: str, body: dict[str, Any], headers: dict[str, str] | None = None, timeout: float = 300) -> Any:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def _answers(text: str) -> list[dict[str, Any]]:
    found = tolerant_json(text)
    found = found.get("columns", [found]) if isinstance(found, dict) else found
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


class OllamaProvider:
    """A local daemon's generate call: JSON answers at temperature 0, within five minutes."""

    def __init__(self, url: str | None = None):
        self.url = url or os.environ.get("OLLAMA_HOST", "http://127.0.0.1:11434")

    def available(self) -> tuple[bool, str]:
        at = urllib.parse.urlsplit(self.url)
        return local_model_open(at.hostname or "127.0.0.1", at.port or 11434), f"nothing answers at {self.url}"

    def suggest(self, columns: list[Column], target: str, file: str, model: str) -> list[dict[str, Any]]:
        body = {"model": model, "prompt": question(columns, target, file), "stream": False, "format": "json", "options": {"temperature": 0, "num_ctx": CONTEXT}}
        return _answers(_post(f"{self.url}/api/generate", body).get("response", ""))


class GeminiProvider:
    """A cloud model's structured answer; needs GEMINI_API_KEY."""

    def __init__(self, url: str = "https://generativelanguage.googleapis.com/v1beta"):
        self.url = url

    def available(self) -> tuple[bool, str]:
        return cloud_key(), "GEMINI_API_KEY is not set"

    def suggest(self, columns: list[Column], target: str, file: str, model: str) -> list[dict[str, Any]]:
        body = {"contents": [{"parts": [{"text": question(columns, target, file)}]}], "generationConfig": {"temperature": 0, "responseMimeType": "application/json"}}
        reply = _post(f"{self.url}/models/{model}:generateContent", body, {"x-goog-api-key": os.environ["GEMINI_API_KEY"]})
        parts = reply["candidates"][0]["content"]["parts"]
        return _answers("".join(p.get("text", "") for p in parts))


#: Factories by back-end name; others can be registered.
PROVIDERS: dict[str, Callable[[], Provider]] = {"embedding": EmbeddingProvider, "words": WordProvider, "ollama": OllamaProvider, "gemini": GeminiProvider}


def register(name: str, factory: Callable[[], Provider]) -> None:
    PROVIDERS[name] = factory


def has_embedder() -> bool:
    from importlib.util import find_spec

    return find_spec("sentence_transformers") is not None


def local_model_open(host: str = "127.0.0.1", port: int = 11434, timeout: float = 0.3) -> bool:
    try:
        with socket.create_connection((host, port), timeout):
            return True
    except OSError:
        return False


def cloud_key() -> bool:
    return bool(os.environ.get("GEMINI_API_KEY"))


def resolve_preset(preset: str, privacy: str) -> str:
    """A preset by name; ``auto`` is the first in this ranking that is to be had here."""
    if preset in tables.PRESETS:
        return preset
    if preset != "auto":
        raise KeyError(f"unknown preset {preset!r}; known: {sorted(tables.PRESETS)}")
    ranking = {"small": local_model_open, "cloud": lambda: privacy != "strict" and cloud_key(), "embed-only": has_embedder}
    return next((name for name, there in ranking.items() if there()), "off")


def chain_for(preset: str, privacy: str, no_embedding: bool = False) -> list[str]:
    """Back-ends in order.  Privacy wins over any preset: ``strict`` never names a cloud back-end."""
    if privacy not in tables.PRIVACY:
        raise ValueError(f"unknown privacy {privacy!r}")
    if privacy == "cloud-only":
        return ["gemini"] if cloud_key() and preset != "off" else []
    kind = resolve_preset(preset, privacy)
    backend = tables.PRESETS[kind][0]
    if backend == "noop":
        return []
    chain = ["embedding"] if has_embedder() and not no_embedding else []
    chain += ["ollama"] if backend == "ollama" else []
    return chain + (["gemini"] if privacy != "strict" and cloud_key() else [])


class Chain:
    """Runs back-ends over the columns that are still open, keeps the best answers and remembers replies by sample digest."""

    def __init__(self, backends: list[str], preset: str = "small", model: str | None = None, cache_dir: str | Path | None = None, batch: int = BATCH):
        self.backends, self.preset, self.model, self.batch = backends, preset, model, batch
        self.cache_path = Path(cache_dir) / CACHE_FILE if cache_dir else None

    def _model(self, backend: str) -> str:
        own = tables.PRESETS.get(self.preset, ("", "", 0))
        default = {"embedding": "embed-only", "ollama": "small", "gemini": "cloud"}.get(backend)
        return self.model if self.model and own[0] == backend else own[1] if own[0] == backend else tables.PRESETS[default][1] if default else ""

    def _load(self) -> dict:
        try:
            return json.loads(self.cache_path.read_text()) if self.cache_path else {}
        except (OSError, ValueError):
            return {}

    def __call__(self, columns: dict[str, Column], names: list[str], target: str, file: str) -> tuple[dict[str, Suggestion], str]:
        if not names:
            return {}, "no open columns"
        if not self.backends:
            return {}, "skipped: no provider is available"
        cache, best, open_, said = self._load(), {}, list(names), []
        for backend in self.backends:
            if not open_:
                break
            if (factory := PROVIDERS.get(backend)) is None:
                said.append(f"{backend}: no plugin")
                continue
            try:
                provider = factory()
                ok, why = provider.available()
                if not ok:
                    said.append(f"{backend}: skipped ({why})")
                    continue
                kept = cache.setdefault(f"{file}::{backend}::{self._model(backend)}", {})
                new = [columns[n] for n in open_ if kept.get(n, {}).get("digest") != columns[n].digest()]
                calls = 0
                for at in range(0, len(new), self.batch):
                    some = new[at : at + self.batch]
                    calls += 1
                    answers = {s.column: raw for raw in provider.suggest(some, target, file, self._model(backend)) if (s := coerce(raw))}
                    for c in some:
                        kept[c.name] = {"digest": c.digest(), "raw": answers.get(c.name)}
                found = [s for n in open_ if (s := coerce(kept.get(n, {}).get("raw"), backend)) and s.column == n]
            except Exception as e:  # noqa: BLE001  a provider's failure leaves its columns open
                said.append(f"{backend}: failed ({type(e).__name__}: {e})")
                continue
            for s in found:
                if s.column not in best or RANK[s.confidence] < RANK[best[s.column].confidence]:
                    best[s.column] = s
            open_ = [n for n in open_ if n not in {s.column for s in found if s.role}]
            said.append(f"{backend}: {len(found)} columns, {calls} calls")
        if self.cache_path:
            try:
                self.cache_path.parent.mkdir(parents=True, exist_ok=True)
                self.cache_path.write_text(json.dumps(cache, indent=2, default=str))
            except OSError as e:
                said.append(f"no cache ({e})")
        return best, "; ".join(said) + (f"; still open: {len(open_)}" if open_ else "")
