"""Benchmark decontamination: Wu-Manber search for the word windows of benchmark items.

The symbols are words.  For each window length a shift table over blocks of two words says how far
the search may move on; a shift of nothing leads to the bucket of the windows that end in that
block, and the words themselves are compared there.  Items are cut into overlapping pieces and
dealt into blocks of about ``max_bytes`` of text, each block's tables are built and broadcast by
themselves, and documents are read once for each block.  With one block documents are never
shuffled; with more, only those that are hit leave anything behind, by a 128-bit hash of their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import TABLE, checkpoint, column, fresh, map_batches, map_texts, mix, rows_of, shared, words_of

#: Words of a window, bytes of items that one pass searches for (its tables take some six times that), and windows of a piece.
WINDOW, MAX_BYTES, PIECE = 13, 16 << 20, 1000

_SPACED = bytes(int(c) or 32 for c in TABLE)
_NEW = ("n_words", "runs", "items")


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_SPACED).split()


class WuManber:
    """The windows of one length in some pieces of items, each piece as (item number, words).

    All windows are places in one row of words: where a window's words stand in ``data`` follows
    from ``begin``, the places of the words.  Windows are in order of the block that ends them.
    """

    def __init__(self, pieces: list[tuple[int, list[bytes]]], size: int):
        self.size, self.block = size, min(2, size)
        words = [w for _, some in pieces for w in some]
        self.data = b" ".join(words)
        self.begin = np.cumsum([0] + [len(w) + 1 for w in words])
        hashes = words_of([self.data]).hash
        n = np.array([len(some) - size + 1 for _, some in pieces])
        start = np.repeat(np.cumsum([0] + [len(some) for _, some in pieces])[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
        blocks = self.blocks(hashes, self.block)
        end = blocks[start + size - self.block]
        order = np.argsort(end, kind="stable")
        self.end, self.start, self.item = end[order], start[order].astype(np.int32), np.repeat([i for i, _ in pieces], n)[order].astype(np.int32)
        self.bits = max(10, (8 * len(start)).bit_length())
        self.shift = np.full(1 << self.bits, size - self.block + 1, np.uint8 if size < 256 else np.int64)
        for back in range(size - self.block, -1, -1):
            self.shift[(blocks[start + size - self.block - back] >> np.uint64(64 - self.bits)).astype(np.int64)] = back

    @staticmethod
    def blocks(words: np.ndarray, size: int) -> np.ndarray:
        """The hash of the block of words that begins at each word but the last."""
        return mix(words) if size == 1 else mix(words[:-1] * np.uint64(3) + words[1:])

    def search(self, hashes: np.ndarray, words: list[list[bytes]], text: bytes) -> list[tuple[int, int]]:
        """(first word, item number) of every occurrence; ``words`` holds the text's words once they are needed."""
        n, found = len(hashes), []
        if n < self.size:
            return found
        blocks = self.blocks(hashes, self.block)
        shift = self.shift[(blocks >> np.uint64(64 - self.bits)).astype(np.int64)].tolist()
        at, end = self.size - self.block, len(shift)
        while at < end:
            if step := shift[at]:
                at += step
                continue
            low = int(np.searchsorted(self.end, blocks[at]))
            if low < len(self.end) and self.end[low] == blocks[at]:
                if not words:
                    words.append(split_words(text))
                first = at - self.size + self.block
                here = b" ".join(words[0][first : first + self.size])
                while low < len(self.end) and self.end[low] == blocks[at]:
                    s = int(self.start[low])
                    if self.data[self.begin[s] : self.begin[s + self.size] - 1] == here:
                        found.append((first, int(self.item[low])))
                    low += 1
            at += 1
        return found


def _pieces(items: DataFrame, size: int) -> DataFrame:
    """(i, w): items as words with one space between, in overlapping pieces of ``PIECE`` windows at most."""

    def run(batches):
        for batch, texts in rows_of(batches, "t"):
            of, out = [], []
            for d, text in enumerate(texts):
                words = split_words(text)
                for s in range(0, max(1, len(words) - size + 1) if words else 0, PIECE):
                    of.append(d)
                    out.append(b" ".join(words[s : s + PIECE + size - 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(out, pa.binary()).cast(pa.string())], names=["i", "w"])

    return map_batches(items, run, "i string, w string").distinct()


def build(rows: list[tuple[str | None, str]], size: int) -> tuple[list[WuManber], list[str | None]]:
    """A machine for each window length, and the item ids that their numbers stand for."""
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i))
    number = {i: k for k, i in enumerate(ids)}
    by: dict[int, list[tuple[int, list[bytes]]]] = {}
    for i, w in sorted(rows, key=lambda r: (r[0] is not None, r)):
        words = w.encode().split()
        by.setdefault(min(size, len(words)), []).append((number[i], words))
    return [WuManber(by[m], m) for m in sorted(by)], ids


def find_windows(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add n_words, runs (starts and ends of the hit words, disjoint and in order) and items (ids as text).

    Columns of the input with these names give way.  Null and empty texts have no words and no
    hits; texts and items of any length are taken whole.  Items without words have no windows;
    items with a null id hit but are not listed; repeated items count once, and equal windows of
    several items count for each.  With an empty benchmark nothing is hit; an empty table gives an
    empty table.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in _NEW and c != text_col])
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    pieces = checkpoint(_pieces(items, window))
    total = pieces.agg(F.sum(F.octet_length("w") + 16)).first()[0] or 0
    parts = -(-total // max_bytes) or 1
    tables = [pieces.filter(F.pmod(F.xxhash64("w"), F.lit(parts)) == p) for p in range(parts)]
    machines = (shared(df.sparkSession, build([tuple(r) for r in t.collect()], window)) for t in tables)
    if parts == 1:
        return _add_hits(df, text_col, next(machines))
    texts = df.select(F.col(text_col).alias("text")).filter("text is not null")
    hits = [checkpoint(_hits(texts, m)) for m in machines]
    return _join_hits(df, text_col, hits)


def _search(texts: list[bytes | None], machines: list[WuManber], ids: list[str | None]):
    """(n_words, runs, items) of each text."""
    words = words_of(texts)
    for d, text in enumerate(texts):
        hashes, split = words.hash[words.begin[d] : words.begin[d + 1]], []
        spans, found = [], set()
        for m in machines:
            for first, item in m.search(hashes, split, text):
                spans.append((first, first + m.size))
                found.add(ids[item])
        yield len(hashes), _flat(spans), sorted(found - {None})


def _flat(spans) -> list[int]:
    flat: list[int] = []
    for s, e in sorted(spans):
        if flat and s <= flat[-1]:
            flat[-1] = max(flat[-1], e)
        else:
            flat += (s, e)
    return flat


def _add_hits(df: DataFrame, text_col: str, machines) -> DataFrame:
    def run(batches):
        for batch, texts in rows_of(batches, text_col):
            n_words, runs, items = zip(*_search(texts, *machines()), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names, *_NEW])

    return map_batches(df, run, StructType([*df.schema.fields]).add("n_words", LongType()).add("runs", ArrayType(LongType())).add("items", ArrayType(StringType())))


def _text_key(text_col: str) -> list[Column]:
    """Two 64-bit hashes of the text; null for one without words, so that those meet nothing."""
    return [F.when(F.length(text_col) > 0, F.xxhash64(F.lit(k), text_col)).alias(f"__k{k}") for k in (1, 2)]


def _hits(texts: DataFrame, machines) -> DataFrame:
    """(k1, k2, runs, items) of the texts that a block of items hits."""

    def make(batch, some):
        got = [(d, r, i) for d, (_, r, i) in enumerate(_search(some, *machines())) if r]
        at, runs, items = zip(*got, strict=True) if got else ((), (), ())
        take = pa.array(at, pa.int64())
        return {"__k1": column(batch, "__k1").take(take), "__k2": column(batch, "__k2").take(take), "runs": pa.array(runs, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}

    found = map_texts(texts.select("text", *_text_key("text")), "text", make, "__k1 long, __k2 long, runs array<long>, items array<string>")
    return found.dropDuplicates(["__k1", "__k2"])


def _join_hits(df: DataFrame, text_col: str, hits: list[DataFrame]) -> DataFrame:
    """What all blocks found, for every row: the hits of equal texts, united."""
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    united = every.groupBy("__k1", "__k2").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = [F.array().cast("array<long>"), F.array().cast("array<string>")]
    own = fresh(df, "__k1", "__k2")
    keyed = df.withColumns(dict(zip(own, _text_key(text_col), strict=True)))
    joined = keyed.join(united.withColumnsRenamed(dict(zip(("__k1", "__k2"), own, strict=True))), own, "left").drop(*own)
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    count = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(words)), F.lit(0)).cast("long")
    # runs of several blocks: in order, those that touch are one
    pairs = "array_sort(transform(sequence(0, size(runs) div 2 - 1), k -> array(runs[2 * k], runs[2 * k + 1])))"
    merged = f"aggregate({pairs}, cast(array() as array<bigint>), (s, p) -> if(size(s) > 0 and p[0] <= element_at(s, -1), concat(slice(s, 1, size(s) - 1), array(greatest(element_at(s, -1), p[1]))), concat(s, p)))"
    runs = F.when(F.coalesce(F.size("runs"), F.lit(0)) > 0, F.expr(merged)).otherwise(none[0])
    return joined.select(*[c for c in joined.columns if c not in _NEW], count.alias("n_words"), runs.alias("runs"), F.coalesce("items", none[1]).alias("items"))


def n_hit() -> Column:
    """Words in the runs: the ends less the starts."""
    return F.expr("aggregate(transform(runs, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)")


def contaminated() -> Column:
    """At least a twentieth of the words are hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def contamination_report(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found = find_windows(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))
