"""Exact quantiles of any size by radix selection: only counters are shuffled, never values.

A pass maps each value to one of some thousand ordered cells and counts the cells of every key; a
running sum says which cell holds a wanted rank.  The first pass takes sign and a thirty-second of an
octave; each later one divides the cells that hold a wanted rank, between their least and greatest
value, into 65,536.  Five passes tell any two doubles apart; most data need two or three, as a cell
of one value, or a rank at the end of its cell, is settled.  All keys, columns or groups, share a pass.
"""

from __future__ import annotations

import math
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells of an octave in the first pass, and of a cell in later ones; a number beyond all octaves.
PER_OCTAVE, CELLS, BEYOND = 32, 65536, 100_000


class Open(NamedTuple):
    """A cell that holds a wanted rank: its values and how many values of the key are before it."""

    key: Any
    low: float
    high: float
    before: int


def quantiles(df: DataFrame, values: dict[str, Column], probabilities: list[float]) -> dict[str, list[float | None]]:
    """For each name the quantiles of its expression, which gives doubles, interpolated; null ones without values."""
    if not values:
        return {}
    cells = [F.struct(F.lit(i).alias("key"), v.alias("v")) for i, v in enumerate(values.values())]
    found = group_quantiles(df.select(F.explode(F.array(*cells)).alias("c")).select("c.*"), "key", "v", probabilities)
    return {n: found.get(i, [None] * len(probabilities)) for i, n in enumerate(values)}


def group_quantiles(df: DataFrame, key: str, value: str, probabilities: list[float], cells: int = CELLS) -> dict[Any, list[float]]:
    """The quantiles of the values of each key that has any; keys are few.  NaN counts as no value, a null key as a key."""
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    first = _histogram(rows.withColumns({"low": F.lit(0.0), "before": F.lit(0).cast("long")}), _octave(F.col("v")))
    whole = Window.partitionBy("key")
    place = lambda p: F.lit(p) * (F.sum("n").over(whole) - 1)
    wanted = F.array(*[f(place(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)])
    total: dict[Any, int] = {}
    ranks: dict[Any, set[int]] = {}
    at: dict[tuple[Any, int], float] = {}
    pending = []
    for r in _holding(first.withColumns({"wanted": wanted, "total": F.sum("n").over(whole)})).collect():
        total[r["key"]] = r["total"]
        ranks.setdefault(r["key"], set()).update(r["wanted"])
        pending += _settle(r, ranks[r["key"]], at)
    while pending:
        pending = _divide(rows, pending, ranks, at, cells)

    def between(key: Any, p: float) -> float:
        place = p * (total[key] - 1)
        low, high = at[key, math.floor(place)], at[key, math.ceil(place)]
        return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high

    return {key: [between(key, p) for p in probabilities] for key in total}


def _octave(v: Column) -> Column:
    """The cell of the first pass: ascends with the value; zeros and infinities have their own."""
    size = F.abs(v)
    cell = F.when(size == float("inf"), BEYOND).when(size > 0, F.floor(F.log2(size) * PER_OCTAVE) + BEYOND // 2).otherwise(0)
    return F.when(v < 0, -cell).otherwise(cell).cast("int")


def _histogram(rows: DataFrame, cell: Column) -> DataFrame:
    """(key, low, before, cell, n, least, most): counters; a task sends one row for each of its cells."""
    return rows.groupBy("key", "low", "before", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


def _holding(counted: DataFrame) -> DataFrame:
    """The cells in which a wanted rank lies, with ``upto``, how many values are before their end."""
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("key", "low").orderBy("cell"))
    return counted.withColumn("upto", upto).filter(F.exists("wanted", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))))


def _settle(r: Any, ranks: set[int], at: dict) -> list[Open]:
    """Note the ranks that a cell tells; the cell itself if it leaves one open."""
    start, end, left = r["upto"] - r["n"], r["upto"] - 1, False
    for rank in ranks:
        if start <= rank <= end:
            if rank == start or r["least"] == r["most"]:
                at[r["key"], rank] = r["least"]
            elif rank == end:
                at[r["key"], rank] = r["most"]
            else:
                left = True
    return [Open(r["key"], r["least"], r["most"], start)] if left else []


def _divide(rows: DataFrame, pending: list[Open], ranks: dict, at: dict, cells: int) -> list[Open]:
    """One more pass, over the values of the cells that hold open ranks; there are two for each probability and key at most."""
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.sparkSession.createDataFrame([(*p, sorted(r for r in ranks[p.key] if (p.key, r) not in at)) for p in pending], f"key {kind}, low double, high double, before bigint, wanted array<bigint>")
    inside = rows.join(F.broadcast(found.withColumnRenamed("key", "of")), F.col("key").eqNullSafe(F.col("of")) & F.col("v").between(F.col("low"), F.col("high")))
    cell = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * (cells - 1)).cast("int")
    counted = _histogram(inside, cell).join(F.broadcast(found.select(F.col("key").alias("of"), F.col("low").alias("from"), "wanted")), F.col("key").eqNullSafe(F.col("of")) & (F.col("low") == F.col("from")))
    return [p for r in _holding(counted).collect() for p in _settle(r, ranks[r["key"]], at)]
