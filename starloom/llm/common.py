"""What the operators share: Arrow passes over texts, hashed words, checkpoints and text pairs.

A *word* here is a maximal run of digits, letters and non-ASCII characters; A-Z are lower-cased.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised pass holds at once (a longer text is one step).
STEP_BYTES = 2 << 20
#: Rows that go to Python at once.
BATCH_ROWS = 1000
#: Words that one task holds at once when it compares texts with a centre (a longer text is one group).
GROUP_WORDS = 100_000
#: A key with over this part (one in so many) of the rows is hot; there are no more such keys than this.
HOT = 1000
#: Rows from which a key is worth the trouble.
LEAST_HOT = 1000

_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the cluster's shared checkpoint folder, which the session names.

    Only a session on one machine (a test) may name none; it gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="starloom-checkpoint-"))
    return df.checkpoint(eager=True)


def forget(*checkpoints: DataFrame) -> None:
    """Delete the files of checkpoints that no DataFrame needs any more."""
    for df in checkpoints:
        sc, file = df.sparkSession.sparkContext, df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast a value of a known size; what comes back gives it in a task.

    It is pickled together with its classes, so workers need no copy of the package, and unpickled
    once in each worker.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        kept = vars(sent)
        if "loaded" not in kept:
            kept["loaded"] = pickle.loads(sent.value)
        return kept["loaded"]

    return get


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have, one for each name."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def rows_of(batches: Iterator[pa.RecordBatch], col: str, step: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Batches with the UTF-8 bytes of a text column, a few megabytes of text at a time."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(col))
        texts = texts.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + step, side="right")) - 1)
            yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
            at = to


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_ROWS`` rows.

    The session's setting is lowered: the default of 10,000 rows of text takes hundreds of megabytes
    outside the heap of each executor.
    """
    setting, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(setting)) <= BATCH_ROWS:
        conf.set(setting, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, text_col: str, make: Callable, schema: str) -> DataFrame:
    """``make(batch, texts) -> dict of columns`` over whole rows; null texts come as None."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch, texts in rows_of(batches, text_col):
            got = make(batch, texts)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (got[n] for n in names)], names=names)

    return map_batches(df, run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64)."""
    z = z + _GAMMA
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def _table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    t[keep] = keep
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


TABLE = _table()
_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], np.uint64)


class Words(NamedTuple):
    """All words of some texts: 64-bit hashes, byte lengths, first eight bytes, and where each text's words begin (one more: the end)."""

    hash: np.ndarray
    length: np.ndarray
    head: np.ndarray
    begin: np.ndarray


def words_of(texts: list[bytes | None]) -> Words:
    joined = TABLE[np.frombuffer(b" ".join([t or b"" for t in texts]) + b" " * 9, np.uint8)]
    word = joined != 0
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    start, length = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    begin = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    return Words(hash_runs(joined, start, length), length, eight[start], np.searchsorted(start, begin))


def count_words(texts: list[bytes | None]) -> np.ndarray:
    """How many words each text has."""
    word = TABLE[np.frombuffer(b" " + b" ".join([t or b"" for t in texts]), np.uint8)] != 0
    starts = np.concatenate([[0], np.cumsum(word[1:] & ~word[:-1])])
    return np.diff(starts[np.cumsum([0] + [len(t or b"") + 1 for t in texts][:-1] + [len(texts[-1] or b"")])]) if texts else np.zeros(0, np.int64)


def hash_runs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes; eight bytes more stand behind the last."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = mix(length.astype(np.uint64))
    live, at = np.arange(len(start)), 0
    while len(live):
        left = length[live] - at
        h[live] = mix(h[live] ^ (eight[start[live] + at] & _MASK[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    return h


def prefix_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first n (under 9) bytes of the words longer than that, and which words those are."""
    which = np.flatnonzero(words.length > n)
    return mix(mix(words.head[which] & _MASK[n]) + np.uint64(n)), which


_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; a shorter text with words has one, of all its words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h += words[i : i + n] * _ODD[i % 64]
    return mix(h)


def hot_of(counts: DataFrame, key: str, n: str = "n") -> tuple[dict, int]:
    """{key: n} of the hot keys, ``HOT`` at most, and the number of rows, from a row for each key."""
    rows = Observation()
    most = counts.observe(rows, F.sum(n).alias("total")).select(key, n).orderBy(F.desc(n)).limit(HOT).collect()
    total = rows.get["total"] or 0
    return {k: m for k, m in most if m * HOT >= total and m >= LEAST_HOT}, total


def hot_keys(df: DataFrame, key: str) -> tuple[dict, int]:
    """As ``hot_of``, from the rows themselves."""
    return hot_of(df.groupBy(key).agg(F.count("*").alias("n")), key)


def join_hot(left: DataFrame, right: DataFrame, hot: dict, key: str) -> DataFrame:
    """An inner join on a key that is unique on the right; the left rows of hot keys stay where they are."""
    if not hot:
        return left.join(right, key)
    few = F.col(key).isin(*hot)
    return left.filter(few).join(F.broadcast(right.filter(few)), key).unionByName(left.filter(~few).join(right.filter(~few), key))


def one_text_each(texts: DataFrame, hot: dict) -> DataFrame:
    """(key, id, text) with one row, of the least id, for each hot key; other rows as they are."""
    if not hot:
        return texts.select("key", "id", "text")
    few = F.col("key").isin(*hot)
    one = texts.filter(few).groupBy("key").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    return texts.filter(~few).select("key", "id", "text").unionByName(one)


def star_groups(pairs: DataFrame, texts: DataFrame, judge: Callable, schema: str) -> DataFrame:
    """Compare texts with the text of their centre.

    pairs has (member, centre, n_words), distinct (member, centre); texts has distinct (key, text).
    ``judge(centre_key, centre_text, [(key, text)])`` yields tuples of the schema.  A centre with
    many members gets as many groups as its members' words need, so neither a hot centre nor long
    texts meet in one task.
    """
    sizes = checkpoint(pairs.groupBy("centre").agg(F.ceil(F.sum(F.col("n_words") + 20) / GROUP_WORDS).alias("parts"), F.count("*").alias("n")))
    dealt = join_hot(pairs, sizes.drop("n"), hot_of(sizes, "centre")[0], "centre").select("centre", F.col("member").alias("key"), F.pmod(F.xxhash64("member"), F.col("parts")).alias("part"))
    heads = sizes.select("centre", F.col("centre").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    sent = texts.join(dealt.unionByName(heads), "key").select("centre", "part", "key", "text")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        centre = table["centre"][0].as_py()
        some = dict(zip(table["key"].to_pylist(), table["text"].cast(pa.binary()).to_pylist(), strict=True))
        head = some.pop(centre, b"")
        out = list(zip(*judge(centre, head, sorted(some.items())), strict=True)) or [[] for _ in names]
        return pa.table({n: pa.array(c, type=t) for n, c, t in zip(names, out, types, strict=True)})

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]
    return sent.groupBy("centre", "part").applyInArrow(run, schema)
