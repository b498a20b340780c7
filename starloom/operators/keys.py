"""Surrogate keys: contiguous numbers without moving rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import ref

#: Ranges for each shuffle partition, and keys drawn for each range.
RANGES, DRAWN = 4, 32


def with_row_number(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Add contiguous numbers in the order of partitions and rows, as a file is read.

    One pass counts the rows of each partition; the second adds what precedes it.  Nothing is
    shuffled; a global window would move all rows to one task.  The input is to give the same
    partitions twice: a scan, a checkpoint or a narrow plan over one.
    """
    place = F.monotonically_increasing_id()
    marked = df.withColumn("__place", place)
    counts = marked.groupBy(F.shiftright("__place", 33).alias("p")).agg(F.count("*").alias("n")).collect()
    before, at = {}, start
    for r in sorted(counts, key=lambda r: r["p"]):
        before[r["p"]], at = at, at + r["n"]
    if not before:
        return df.withColumn(name, F.lit(None).cast("long"))
    partitions = df.sparkSession.createDataFrame(list(before.items()), "__p int, __before long").hint("broadcast")
    keyed = marked.withColumn("__p", F.shiftright("__place", 33).cast("int")).join(partitions, "__p", "left")
    return keyed.withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__place", "__before")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder, which the session names; only a session on one machine may name none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="starloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def numbered_by(df: DataFrame, name: str, *keys: str, ranges: int | None = None) -> DataFrame:
    """Add numbers from 1 in the order of keys that are unique together.

    Two passes over the keys alone come first: one draws bounds of ranges (the keys with the least
    hashes), one counts the keys of each range, which gives a table of what precedes it.  Rows are then
    dealt by range, once, and numbered inside their range.  Bounds only balance the work: the numbers
    do not depend on them, nor on how the shuffle is cut, so nothing needs a checkpoint.
    """
    ranges = ranges or RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[ref(k) for k in keys])
    drawn = df.select(*[ref(k) for k in keys]).orderBy(F.xxhash64(*[ref(k) for k in keys]), *[ref(k) for k in keys]).limit(ranges * DRAWN)
    sample = [r[0] for r in drawn.sort(*[ref(k) for k in keys]).select(F.to_json(F.struct(*[ref(k) for k in keys]))).collect()]
    bounds = sample[DRAWN::DRAWN] if len(sample) == ranges * DRAWN else []  # fewer keys than that are one range
    if not bounds:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*[ref(k) for k in keys])).cast("long"))
    kind = df.select(key.alias("k")).schema["k"].dataType.simpleString()
    within = _place(key, F.from_json(F.lit("[" + ",".join(bounds) + "]"), f"array<{kind}>"), len(bounds))
    counts = dict(df.select(within.alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect())
    before = [0]
    for p in range(len(bounds)):
        before.append(before[-1] + counts.get(p, 0))
    part = fresh(df, "part")
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*[ref(k) for k in keys]))
    placed = df.withColumn(part, within).withColumn(name, nth + F.get(F.from_json(F.lit(str(before)), "array<bigint>"), F.col(part)))
    return placed.drop(part)


def _place(key: Column, bounds: Column, n: int) -> Column:
    """How many of the ascending bounds are not above the key, by bisection."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) <= key), at + s).otherwise(at))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
