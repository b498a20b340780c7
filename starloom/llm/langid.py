"""Language ID by hierarchical discrimination.

A first linear machine names the language family; inside a family, one-versus-one linear support
vector machines separate the languages.  Features are hashed byte n-grams of the whole text.  The
machines are fitted on the driver to a hash sample of at most about ``MAX_TRAIN`` labelled rows,
dealt evenly over the languages, whose features are computed on the executors.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import TABLE, fold, map_batches, rows_of, shared

#: Labelled rows to learn from at most (in expectation), and the number of features.
MAX_TRAIN, FEATURES = 2400, 1 << 13
ORDERS = (2, 3, 4)

#: Families of languages by ISO 639-1 code; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "baltic": "lt lv".split(),
    "uralic": "et fi hu".split(),
    "celtic": "br cy ga gd".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
    "iranian": "fa ku ps tg".split(),
    "turkic": "az kk ky tr uz".split(),
    "semitic": "am ar he mt".split(),
    "austronesian": "id jv ms tl".split(),
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row for each text: roots of hashed n-gram counts, of length one, and a constant."""
    out = np.zeros((len(texts), FEATURES + 1), np.float32)
    mul = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
    for i, text in enumerate(texts):
        b = TABLE[np.frombuffer(b" " + (text or b"") + b" ", np.uint8)].astype(np.uint32)
        h = b * mul[0]
        counts = np.zeros(FEATURES)
        for n in range(2, max(ORDERS) + 1):
            if len(b) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * mul[n - 1] + b[n - 1 :] * mul[0]
            if n in ORDERS:
                counts += np.bincount((h ^ (h >> np.uint32(16))) * mul[1] >> np.uint32(19), minlength=FEATURES)
        row = np.sqrt(counts)
        out[i, :-1] = row / max(1.0, np.sqrt(counts.sum()))
        out[i, -1] = 1
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by dual coordinate descent; y is 1 or -1."""
    w, alpha = np.zeros(x.shape[1], np.float64), np.zeros(len(x))
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * c * weight)
    norm = np.einsum("ij,ij->i", x, x) + slack
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class Model:
    """Families, and in each family languages, told apart by votes of pairwise machines."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        of = np.array([FAMILY.get(c, f"={c}") for c in langs], object)
        lang = np.array(langs, object)
        self.groups = {f: sorted(set(lang[of == f])) for f in sorted(set(of))}
        self.machines: list[tuple[str, str]] = []
        weights = []
        for names, label, rows in [(sorted(self.groups), of, np.full(len(of), True)), *((g, lang, of == f) for f, g in self.groups.items())]:
            for a, b in combinations(names, 2):
                use = rows & ((label == a) | (label == b))
                self.machines.append((a, b))
                weights.append(fit_svm(x[use], np.where(label[use] == a, 1.0, -1.0)))
        self.weights = np.array(weights, np.float32).reshape(len(weights), x.shape[1] if len(weights) else FEATURES + 1)

    def _elect(self, names: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The name with most votes (then largest sum of margins), and how sure its closest contest is."""
        votes, total, closest = Counter(), defaultdict(float), defaultdict(lambda: 30.0)
        for a, b in combinations(names, 2):
            m = margin[a, b]
            votes[a if m >= 0 else b] += 1
            for name, x in ((a, m), (b, -m)):
                total[name] += x
                closest[name] = min(closest[name], x)
        best = max(names, key=lambda n: (votes[n], total[n], n))
        return best, float(1 / (1 + np.exp(-4 * closest[best])))

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        scores = features(texts) @ self.weights.T
        out = []
        for text, row in zip(texts, scores.tolist(), strict=True):
            if not text or not self.groups or not has_letter(text):
                out.append(("und", 0.0))
                continue
            margin = dict(zip(self.machines, row, strict=True))
            family, p = self._elect(list(self.groups), margin)
            lang, q = self._elect(self.groups[family], margin)
            out.append((lang, p * q))
        return out


def has_letter(text: bytes) -> bool:
    return text.upper() != text.lower() or not text.isascii() and any(map(str.isalpha, text.decode()))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """Fit to rows with a lang and a text whose crc32 remainder is not 2; rows with a null id teach nothing.

    Repeated rows teach as often as they occur; an empty table gives a model without languages.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 2))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    shares = sizes.select("lang", (F.lit(max_train / max(1, sizes.count())) / F.col("n")).alias("share"))
    sample = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("share") * 1_000_003)

    def run(batches):
        for batch, texts in rows_of(batches, "text"):
            for at in range(0, len(texts), 128):
                x = features(texts[at : at + 128])[:, :-1]
                at_of = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(x)), batch.column(2).slice(at, len(x)), pa.array([a.astype("<u2").tobytes() for a in at_of], pa.binary()), pa.array([r[a].astype("<f2").tobytes() for r, a in zip(x, at_of, strict=True)], pa.binary())], names=["doc_id", "lang", "at", "value"])

    kind = rows.schema["doc_id"].dataType.simpleString().replace("bigint", "long")
    got = sorted(map_batches(sample.select("text", "doc_id", "lang"), run, f"doc_id {kind}, lang string, at binary, value binary").collect(), key=lambda r: (r["lang"], str(r["doc_id"])))
    x = np.zeros((len(got), FEATURES + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], "<f2")
    return Model(x, [r["lang"] for r in got])


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add lang_pred and lang_score to every row; columns with these names give way.

    A text that is null or has no letter is ``und`` with score 0, and so is every text where nothing
    was learned.  Texts of any length are read whole; of equal votes and margins the name that
    comes last in order wins.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("lang_pred", "lang_score")])
    known = shared(df.sparkSession, model)

    def run(batches):
        for batch, texts in rows_of(batches, text_col):
            got = [p for at in range(0, len(texts), 128) for p in known().predict(texts[at : at + 128])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p for p, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return map_batches(df, run, StructType([*df.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType()))


def language_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out (false for a null id), lang_pred and score of every row."""
    model = train(df, id_col, text_col, lang_col, max_train)
    found = identify(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return found.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
