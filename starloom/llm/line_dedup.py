"""Line dedup: hash normalised lines, count the documents of each hash, drop frequent lines.

A line's key is the line without leading and trailing ASCII white space, A-Z lower-cased.  Keys are
compared by 128-bit hashes.  A row is a document.  The texts are read twice; hashes are shuffled,
after each document has named each of its keys once.  Texts themselves are shuffled only where
there are more than ``BROADCAST_KEYS`` frequent keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import checkpoint, column, fresh, map_batches, map_texts, rows_of

#: Up to so many frequent keys (16 bytes each) are broadcast; more are joined.
BROADCAST_KEYS = 1_000_000


def _keys(text: bytes | None, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and each line's 16-byte hash (None for a key of under ``least`` code points)."""
    lines = (text or b"").split(b"\n")
    keys = [x.strip(b" \t\n\x0b\x0c\r").lower() for x in lines]
    long_enough = (lambda k: len(k) >= least) if least <= 1 else (lambda k: len(k) >= least and len(k.decode()) >= least)
    return lines, [xxhash.xxh3_128_digest(k) if long_enough(k) else None for k in keys]


def frequent_keys(df: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): hashes of the keys found in at least ``min_docs`` rows."""

    def emit(batch, texts):
        found = b"".join(h for t in texts for h in {*_keys(t, min_chars)[1]} if h is not None)
        h = np.frombuffer(found, "<i8").reshape(-1, 2)
        return {"h1": h[:, 0], "h2": h[:, 1]}

    seen = map_texts(df.select(text_col), text_col, emit, "h1 long, h2 long")
    return seen.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)


def line_dedup(df: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Add ``kept_text``, ``n_lines`` and ``n_dropped`` to every row.

    Columns of the input with these names give way.  A null or empty text is one empty line, which
    has no key and stays; a text whose lines all go becomes empty.  Texts of any length are taken
    whole.  Repeated rows count as documents of their own; a key goes or stays for all alike.  An
    empty table gives an empty table.
    """
    new = ["kept_text", "n_lines", "n_dropped"]
    df = df.drop(*[c for c in df.columns if c.lower() in new and c != text_col])
    frequent = checkpoint(frequent_keys(df, text_col, min_docs, min_chars).select("h1", "h2"))
    if (n := frequent.count()) <= broadcast_keys:
        pairs = frequent.toPandas().to_numpy(np.int64).reshape(n, 2)
        known = df.sparkSession.sparkContext.broadcast(frozenset(pairs[i].astype("<i8").tobytes() for i in range(n)))
        return _cut(df, text_col, min_chars, lambda batch: [known.value] * batch.num_rows)
    # beyond the bound each document gets its own frequent keys by joins on hashes; a text without a
    # line that could go has no hash and meets nothing
    row = [F.when(F.length(text_col) > 0, F.xxhash64(F.lit(i), F.col(text_col))) for i in (1, 2)]
    r1, r2, keys = fresh(df, "__r1", "__r2", "__keys")

    def emit(batch, texts):
        mine = [[h for h in {*_keys(t, min_chars)[1]} if h is not None] for t in texts]
        h = np.frombuffer(b"".join(x for m in mine for x in m), "<i8").reshape(-1, 2)
        times = [len(m) for m in mine]
        return {n: np.repeat(column(batch, n).to_numpy(zero_copy_only=False), times) for n in (r1, r2)} | {"h1": h[:, 0], "h2": h[:, 1]}

    distinct = df.select(row[0].alias(r1), row[1].alias(r2), F.col(text_col).alias("text")).filter(f"{r1} is not null").dropDuplicates([r1, r2])
    mine = map_texts(distinct, "text", emit, f"{r1} long, {r2} long, h1 long, h2 long").join(frequent, ["h1", "h2"])
    mine = mine.groupBy(r1, r2).agg(F.collect_list(F.struct("h1", "h2")).alias(keys))

    def sets(batch):
        return [frozenset(np.array([[k["h1"], k["h2"]]], "<i8").tobytes() for k in ks or ()) for ks in column(batch, keys).to_pylist()]

    return _cut(df.withColumns({r1: row[0], r2: row[1]}).join(mine, [r1, r2], "left").drop(r1, r2), text_col, min_chars, sets).drop(keys)


def _cut(df: DataFrame, text_col: str, min_chars: int, sets) -> DataFrame:
    def run(batches):
        for batch, texts in rows_of(batches, text_col):
            kept, total, gone = [], [], []
            for text, drop in zip(texts, sets(batch), strict=True):
                lines, keys = _keys(text, min_chars)
                stay = [x for x, k in zip(lines, keys, strict=True) if k is None or k not in drop]
                kept.append(b"\n".join(stay))
                total.append(len(lines))
                gone.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*batch.schema.names, "kept_text", "n_lines", "n_dropped"])

    schema = StructType([*df.schema.fields]).add("kept_text", StringType()).add("n_lines", LongType()).add("n_dropped", LongType())
    return map_batches(df, run, schema)


def line_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row."""
    cut = line_dedup(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **options)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
