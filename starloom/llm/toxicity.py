"""Toxicity by maximum-scoring segments.

Words and beginnings of words get log-odds of toxic against clean documents, smoothed by a
Dirichlet prior that follows their frequency.  A word scores the log-odds of its feature that most
clearly speaks for toxicity; any other word scores ``GAP`` less than its log-odds, which count as
0 where they are positive or unknown.  A linear scan finds every maximal segment of the word
sequence.  Extreme-value theory calibrates segments: with the decay that the clean background
gives, a segment of score S is as rare as n * exp(-decay * S) in a text of n words.  What the
segments of a document add up to goes through a logistic curve fitted to the learning rows.

The counts are taken on the executors over a hash sample of at most about ``MAX_TRAIN`` labelled
rows; only words that speak for toxicity, or against it in ``KNOWN`` documents or more, reach the
driver, so what it holds and broadcasts is bounded by the sample.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import column, fold, map_batches, map_texts, prefix_hashes, rows_of, shared, words_of

#: Labelled rows to learn from at most (in expectation).
MAX_TRAIN = 20_000
#: Bytes of the beginnings of words that are features as well; flat part of the prior; share of false features to allow; cost of a word.
PREFIXES, FLAT, FALSE_SHARE, GAP = (4, 5, 6), 0.25, 0.05, 0.7
#: Documents with a word from which its log-odds count against toxicity.
KNOWN = 5
#: The score from which a document counts as toxic.
THRESHOLD = 0.3


def word_features(texts: list[bytes | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(feature hashes, word numbers) for whole words and for beginnings; where each text's words begin."""
    words = words_of(texts)
    return [(words.hash, np.arange(len(words.hash))), *(prefix_hashes(words, p) for p in PREFIXES)], words.begin


def log_odds(toxic, clean, n_toxic: int, n_clean: int):
    """Log-odds from the documents that have a feature; the prior's mass follows the feature's frequency."""
    share = (toxic + clean) / max(1, n_toxic + n_clean)
    return np.log((toxic + FLAT + share) / (n_toxic + 1)) - np.log((clean + FLAT + share) / (n_clean + 1))


def clear_features(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, tested: int) -> np.ndarray:
    """Which features clearly speak for toxicity: Benjamini and Hochberg's rule over Chernoff bounds of all ``tested`` features."""
    if not len(toxic):
        return np.zeros(0, bool)
    base, m = (n_toxic + 0.5) / (n_toxic + n_clean + 1), toxic + clean
    r = toxic / m
    bound = -m * (r * np.log(r / base) + np.where(r < 1, (1 - r) * np.log(np.maximum(1 - r, 1e-12) / (1 - base)), 0))
    p = np.where(r > base, np.exp(bound), 1.0)
    ranked = np.sort(p)
    under = np.flatnonzero(ranked <= FALSE_SHARE * np.arange(1, len(p) + 1) / max(tested, len(p)))
    return p <= ranked[under[-1]] if len(under) else np.zeros(len(p), bool)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) in linear time (Ruzzo and Tompa).

    Each candidate links to the last one before it that begins lower, so none is looked at again
    once it is passed over.  Of equal sums the shorter segment is taken.
    """
    total = np.cumsum(score)
    at = np.flatnonzero(score > 0)
    first: list[int] = []
    last: list[int] = []
    left: list[float] = []
    right: list[float] = []
    link: list[int] = []
    for p, low, high in zip(at.tolist(), (total[at] - score[at]).tolist(), total[at].tolist(), strict=True):
        begin, j = p, len(first) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                break
            begin, low, back = first[j], left[j], link[j]
            for some in (first, last, left, right, link):
                del some[j:]
            j = back
        for some, x in ((first, begin), (last, p), (left, low), (right, high), (link, j)):
            some.append(x)
    return [(f, e, r - x) for f, e, x, r in zip(first, last, left, right, strict=True)]


class Model:
    """Scores of features: ``keys`` speak for toxicity, ``plain`` are words that speak against it."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, plain: tuple[np.ndarray, np.ndarray, np.ndarray]):
        order = np.argsort(keys)
        self.keys, self.toxic, self.clean = keys[order], toxic[order], clean[order]
        self.n = n_toxic, n_clean
        self.score = np.maximum(0, log_odds(self.toxic, self.clean, *self.n))
        fewer = np.maximum(0, log_odds(self.toxic - 1, self.clean, max(1, n_toxic - 1), n_clean))
        self.loo = np.where(self.toxic - 1 >= self.toxic.min(initial=2), fewer, 0)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        order = np.argsort(plain[0])
        self.plain, self.cost = plain[0][order], np.minimum(0, log_odds(plain[1], plain[2], *self.n))[order]
        self.decay, self.curve = self._decay(plain[2][order]), (1.0, -1.0)

    def _decay(self, clean: np.ndarray) -> float:
        """The positive root of E[exp(decay * score)] = 1 for a word of a clean document (some 200 words long)."""
        live = self.score > 0
        p = np.concatenate([self.clean[live] + FLAT, clean + FLAT]) / (200.0 * (self.n[1] + 1))
        s, rest = np.concatenate([self.score[live], self.cost - GAP]), max(0.0, 1 - p.sum())
        low, high = 0.0, 10.0
        for _ in range(60):
            mid = (low + high) / 2
            over = (p * np.exp(np.minimum(mid * s, 700))).sum() + rest * math.exp(-mid * GAP) > 1
            low, high = (low, mid) if over else (mid, high)
        return max(0.05, low)

    def evidence(self, texts: list[bytes | None], known: list[int] | None = None) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """For each text: sum over its segments of log(1 / expected number), and the segments.  A known toxic text doesn't count for itself."""
        kinds, begin = word_features(texts)
        n = int(begin[-1])
        value = np.zeros((2, n))
        for h, which in kinds:
            some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(self.keys, h[some]), max(0, len(self.keys) - 1))
            some, at = (some[hit := self.keys[at] == h[some]], at[hit]) if len(some) else (some, at)
            for row, score in enumerate((self.score, self.loo)):
                np.maximum.at(value[row], which[some], score[at])
        out = []
        for d in range(len(texts)):
            v = value[1 if known and known[d] else 0, begin[d] : begin[d + 1]]
            found = segments(self._signed(kinds[0][0][begin[d] : begin[d + 1]], v)) if v.any() else []
            rare = [self.decay * s - math.log(max(1, len(v))) for _, _, s in found]
            out.append((sum(max(0.0, r) for r in rare) or max(rare, default=-math.log(max(1, len(v))) - 1), found))
        return out

    def _signed(self, words: np.ndarray, positive: np.ndarray) -> np.ndarray:
        """Each word's score: its positive one, or else its log-odds less ``GAP``."""
        against = np.zeros(len(words))
        if len(self.plain):
            at = np.minimum(np.searchsorted(self.plain, words), len(self.plain) - 1)
            against = np.where(self.plain[at] == words, self.cost[at], 0.0)
        return np.where(positive > 0, positive, against - GAP)

    def probability(self, x: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * _squash(x) + b))))


def _squash(x: float) -> float:
    return math.copysign(math.log1p(abs(x)), x)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not under 0) and intercept of a logistic curve with a small ridge, by Newton's method."""
    if not len(y) or y.min() == y.max():
        return (1.0, -1.0 if not len(y) or not y.max() else 1.0)
    x1, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + [0.02 * w[0], 0]
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag([0.02, 1e-6])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return max(0.0, float(w[0])), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Learn from labelled rows whose crc32 remainder is not 2; null ids, texts and labels teach nothing.

    Of several labels of an id the highest counts; a repeated document row teaches each time.
    """
    spark = docs.sparkSession
    marked = labels.filter(F.col(label_col).isNotNull() & F.coalesce(fold(id_col) != 2, F.lit(False)))
    marked = marked.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col)).alias("y"))
    share = min(1.0, max_train / max(1, marked.count()))
    marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    sample = rows.join(F.broadcast(marked), "doc_id").select("text", F.col("y").cast("int").alias("y"))

    def count(batches):
        for batch, texts in rows_of(batches, "text"):
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            kinds, begin = word_features(texts)
            doc = np.repeat(np.arange(len(texts)), np.diff(begin))
            f = np.concatenate([h for h, _ in kinds])
            d = np.concatenate([doc[which] for _, which in kinds])
            order = np.lexsort((d, f))
            f, d = f[order], d[order]
            once = np.ones(len(f), bool)
            once[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
            f, t, w = f[once], y[d[once]], np.concatenate([np.full(len(h), k == 0) for k, (h, _) in enumerate(kinds)])[order][once]
            head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
            toxic = np.add.reduceat(t.astype(np.int64), head) if len(f) else head
            both = np.diff(np.append(head, len(f)))
            yield pa.RecordBatch.from_arrays([pa.array(f[head].view(np.int64)), pa.array(w[head]), pa.array(toxic), pa.array(both - toxic)], names=["f", "whole", "toxic", "clean"])

    n = {r["y"]: r["n"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    counted = map_batches(sample, count, "f long, whole boolean, toxic long, clean long").groupBy("f").agg(F.max("whole").alias("whole"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (n_toxic + 1) / (n_clean + 1)
    tests = Observation()
    counted = counted.observe(tests, F.count_if(F.col("toxic") + F.col("clean") >= 2).alias("n"))
    speaks = (F.col("toxic") >= 2) & (F.col("toxic") > 1.5 * ratio * F.col("clean"))
    against = F.col("whole") & (F.col("toxic") + F.col("clean") >= KNOWN) & (F.col("toxic") < ratio * F.col("clean"))
    held = counted.withColumn("speaks", speaks).filter(F.col("speaks") | against).toPandas()

    def arrays(rows):
        return rows["f"].to_numpy(np.int64).view(np.uint64), *(rows[c].to_numpy(np.float64) for c in ("toxic", "clean"))

    keys, toxic, clean = arrays(held[held["speaks"].astype(bool)])
    live = clear_features(toxic, clean, n_toxic, n_clean, int(tests.get["n"] or 0))
    model = Model(keys[live], toxic[live], clean[live], n_toxic, n_clean, arrays(held[~held["speaks"].astype(bool)]))
    known = shared(spark, model)

    def weigh(batches):
        for batch, texts in rows_of(batches, "text"):
            y = batch.column(1).to_pylist()
            x = [_squash(e) for e, _ in known().evidence(texts, y)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array([int(v > 0) for v in y], pa.int32())], names=["x", "y"])

    got = map_batches(sample, weigh, "x double, y int").groupBy("x", "y").agg(F.count("*").alias("n")).toPandas().sort_values(["x", "y"])
    x, y = (np.repeat(got[c].to_numpy(np.float64), got["n"]) for c in ("x", "y"))
    model.curve = fit_curve(x, y)
    return model


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and passages (first word, last word, score) of every row.

    Null and empty texts have no passage and the lowest evidence.  Texts of any length are read
    whole, in linear time; equal texts get equal scores, repeated rows stay, other columns are left
    behind, and an empty table gives an empty table.
    """
    known = shared(df.sparkSession, model)
    kind = df.schema[id_col].dataType.simpleString().replace("bigint", "long")
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def make(batch, texts):
        got = known().evidence(texts)
        found = [[{"first": f, "last": e, "score": s} for f, e, s in p] for _, p in got]
        return {"doc_id": column(batch, "doc_id"), "score": pa.array([known().probability(x) for x, _ in got], pa.float64()), "passages": pa.array(found, passage)}

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(rows, "text", make, f"doc_id {kind}, score double, passages array<struct<first:bigint,last:bigint,score:double>>")


def toxicity_report(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out (false for a null id), score and predicted of every row."""
    scored = score_texts(docs, train(docs, labels, max_train=max_train))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
