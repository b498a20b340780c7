"""URL filters: rules indexed by their rarest literal token.

A rule is a host (with all its subdomains) and a beginning of the path, in which ``*`` stands for
any characters.  Each rule is filed under the token of its literal parts that is rarest among the
rules; a URL's tokens fetch candidate rules, and only those run their regular expressions.  Of the
rules that fit, the longest decides; of equally long ones, allow.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_texts, shared

_TOKEN = re.compile(r"[^\W_]+")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def patterns(self) -> tuple[re.Pattern, re.Pattern]:
        """One for the whole host, one for the beginning of the path."""
        host, path = (re.escape(x).replace(r"\*", ".*") for x in (self.host, self.path))
        return re.compile(rf"(?:.*\.)?{host}", re.S), re.compile(path, re.S)

    def tokens(self) -> set[str]:
        """Tokens that any URL that fits has whole: not those that a ``*`` or the end of the path may go on."""
        host = [t for part in self.host.split(".") if "*" not in part for t in _TOKEN.findall(part)]
        path = [m[0] for m in _TOKEN.finditer(self.path) if m.end() < len(self.path) and self.path[m.end()] != "*" and self.path[m.start() - 1 : m.start()] != "*"]
        return {*host, *path}


#: The rules of the query.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


class RuleIndex:
    def __init__(self, rules: list[Rule]):
        often = Counter(t for r in rules for t in r.tokens())
        self.by: dict[str, list[tuple[Rule, re.Pattern, re.Pattern]]] = {}
        for r in rules:
            key = min(r.tokens(), key=lambda t: (often[t], t), default="")
            self.by.setdefault(key, []).append((r, *r.patterns()))

    def best(self, host: str, path: str) -> Rule | None:
        fits = None
        for token in {"", *_TOKEN.findall(host), *_TOKEN.findall(path)}:
            for rule, of_host, of_path in self.by.get(token, ()):
                if of_host.fullmatch(host) and of_path.match(path) and (fits is None or (len(rule.text), rule.verdict == "allow") > (len(fits.text), fits.verdict == "allow")):
                    fits = rule
        return fits


_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def split_url(url: bytes | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty for null and for a text without ``://``."""
    _, found, rest = (url or b"").partition(b"://")
    if not found:
        return "", ""
    m = re.match(rb"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(_UPPER).decode(), m[2].decode()


def url_filter(df: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row; repeated rows stay.

    Null and empty urls have an empty host and path.  Urls of any length are judged whole.  An empty
    table gives an empty table; other columns are left behind.
    """
    index = shared(df.sparkSession, RuleIndex(rules))

    def make(batch, urls):
        parts = [split_url(u) for u in urls]
        best = index().best
        fits = [best(*p) for p in parts]
        return {
            "page_id": column(batch, "page_id"),
            "host": pa.array([h for h, _ in parts], pa.string()),
            "path": pa.array([p for _, p in parts], pa.string()),
            "rule": pa.array([r and r.text for r in fits], pa.string()),
            "verdict": pa.array([r.verdict if r else default for r in fits], pa.string()),
        }

    kind = df.schema[id_col].dataType.simpleString().replace("bigint", "long")
    return map_texts(df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url", make, f"page_id {kind}, host string, path string, rule string, verdict string")
