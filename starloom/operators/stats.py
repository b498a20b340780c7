"""Column statistics: every pass takes all columns at once, as one record for each column and task, or as hashes."""

from __future__ import annotations

import pickle
import sys
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.values import is_numeric, no_nan, ref, to_double, type_of
from .keys import checkpoint_folder
from .quantiles import quantiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Values listed of a column; sample values; values drawn by hash; rows looked at before a whole pass for first values.
TOP, SAMPLES, DRAWN, HEAD = 20, 5, 12, 1000
#: Cells and different values that a task is to count; cells of a sample, and the part of it (one in so many) that makes a value frequent.
IN_A_TASK, SAMPLED, FREQUENT = 1_000_000, 100_000, 1000
#: Types whose values Spark hashes one to one to 64 bits.
ONE_TO_ONE = (T.IntegralType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
NUMBERS = ("min", "max", "mean", "median", "std", "q25", "q75")
QUARTILES = [0.25, 0.5, 0.75]


def hashes(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a value or a row; a null counts by its place."""
    some = [x for c in columns for x in ((c, c.isNull()) if len(columns) > 1 else (c,))]
    return F.xxhash64(*some), F.xxhash64(F.lit(0x9E3779B97F4A7C15 - (1 << 64)), *some)


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: rows, columns and missing (nulls and NaNs of all columns)."""
    total = reduce(lambda a, b: a + b, [no_nan(ref(f.name), f.dataType).isNull().cast("long") for f in df.schema.fields])
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.coalesce(F.sum(total), F.lit(0)).alias("missing"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one; nulls are equal.

    Rows are known by 64-bit hashes, which alone are shuffled.  The hashes that come again are settled
    first; only rows that have one are compared whole, so the count is exact.
    """
    columns = [ref(c) for c in df.columns]
    h = hashes(*columns)[0].alias("h")
    told = df.agg(F.count("*").alias("n"), F.approx_count_distinct(h).alias("about")).first()
    cells = df.select(F.lit(0).alias("i"), h, F.lit(None).cast("long").alias("g"))
    checkpoint_folder(df.sparkSession)
    again = _by_hash(cells, told["n"], [0] if told["about"] > IN_A_TASK else []).filter("n > 1").select(F.col("h").alias("__h")).checkpoint()
    found = again.count()
    if not found:
        return df.sparkSession.createDataFrame([(0,)], "duplicates bigint")
    marked = df.select(h.alias("__h"), F.struct(*columns).alias("__row"))
    repeated = marked.join(F.broadcast(again) if found <= IN_A_TASK else again, "__h", "left_semi").groupBy("__row").agg(F.count("*").alias("__n"))
    return repeated.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) with the value as text; null is a value."""
    return df.groupBy(ref(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def numeric_stats(df: DataFrame, column: str) -> DataFrame:
    """One row of min, max, mean, median, std (n - 1), q25 and q75; all null without values."""
    v = to_double(ref(column), type_of(df, column))
    q25, median, q75 = quantiles(df, {column: v}, QUARTILES)[column]
    plain = df.select(v.alias("v")).agg(*_number_aggs(F.col("v"), ""))
    return plain.select("min", "max", "mean", F.lit(median).cast("double").alias("median"), "std", F.lit(q25).cast("double").alias("q25"), F.lit(q75).cast("double").alias("q75"))


def _number_aggs(v, suffix: str) -> list:
    found = [F.min(v), F.max(v), F.avg(v), F.stddev_samp(v)]
    return [a.alias(n + suffix) for a, n in zip(found, ("min", "max", "mean", "std"), strict=True)]


def fingerprint_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: n, p5, median and p95 of the values."""
    v = to_double(ref(column), type_of(df, column))
    p5, median, p95 = (F.lit(x).cast("double") for x in quantiles(df, {column: v}, [0.05, 0.5, 0.95])[column])
    return df.agg(F.count(v).alias("n")).select("n", p5.alias("p5"), median.alias("median"), p95.alias("p95"))


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, h, g, d, whole): a row for each cell, by its hashes and, of numbers, its value; no hashes where nothing is there.

    The 64-bit hash of a value of up to 64 bits is one to one, so a second hash is there of others only.
    """
    cells = []
    for i, name in enumerate(columns):
        kind = type_of(df, name)
        c = no_nan(ref(name), kind)
        same = F.when(c == 0, F.lit(0).cast(kind)).otherwise(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c
        one, two = (F.xxhash64(same), F.lit(None).cast("long")) if isinstance(kind, ONE_TO_ONE) else hashes(same)
        d = to_double(c, kind) if is_numeric(kind) else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(i).alias("i"), F.when(c.isNotNull(), one).alias("h"), F.when(c.isNotNull(), two).alias("g"), d.alias("d"), (d % 1 == 0).alias("whole")))
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _by_hash(cells: DataFrame, total: int, many: list[int]) -> DataFrame:
    """(i, h, n, g1, g2): cells, of which there are ``total``, by column and hash.

    Tasks count their own cells first, but not those of columns with ``many`` values: these are dealt
    as they are to tasks of about ``IN_A_TASK`` cells, so no task's table of values grows with the data.
    Values that are frequent in a sample are counted first all the same, so none fills a task; the
    sample only balances the work.
    """
    counts = [F.count("*").alias("n"), F.min("g").alias("g1"), F.max("g").alias("g2")]
    if not many:
        return cells.groupBy("i", "h").agg(*counts)
    wide = F.col("i").isin(many)
    sample = cells.filter(wide).sample(min(1.0, SAMPLED / max(total, 1)), seed=7)
    frequent = [r["h"] for r in sample.groupBy("i", "h").agg(F.count("*").alias("n")).filter(F.col("n") * FREQUENT > SAMPLED).collect()]
    dealt = wide & ~F.col("h").isin(frequent) if frequent else wide
    alone = cells.filter(dealt).select("i", "h", "g").repartition(-(-total // IN_A_TASK), "h").groupBy("i", "h").agg(*counts)
    return cells.filter(~dealt).groupBy("i", "h").agg(*counts).unionAll(alone)


def column_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """For each column: rows, nulls, distinct values and whether all numbers are whole."""
    return {c: {k: r[k] for k in ("rows", "nulls", "distinct", "whole")} for c, r in column_records(df, columns).items()}


def column_records(df: DataFrame, columns: list[str] | None = None) -> dict[str, dict]:
    """For each column: rows, nulls, distinct values, whether all numbers are whole, least and greatest number, and hashes of some values.

    Two passes for any number of columns: one gives a record for each column and task, with about how
    many values there are; one counts cells by (column, 64-bit hash), which alone are shuffled, and then
    by column.  A hash that two values share shows by their second hashes; the values behind such hashes
    are then counted themselves.
    """
    columns = columns or df.columns
    cells = _cells(df, columns)
    plain = cells.groupBy("i").agg(F.count("*").alias("rows"), F.count("h").alias("n"), F.min("d").alias("min"), F.max("d").alias("max"), F.min("whole").alias("whole"), F.approx_count_distinct("h").alias("about")).collect()
    room, many = IN_A_TASK, []
    for r in sorted(plain, key=lambda r: r["about"]):
        room -= r["about"]
        many += [r["i"]] if room < 0 else []
    values = _by_hash(cells.filter("h is not null"), sum(r["n"] for r in plain if r["i"] in many), many)
    drawn = [F.min(F.when(F.pmod("h", F.lit(DRAWN)) == j, F.col("h"))).alias(f"s{j}") for j in range(DRAWN)]
    none = {"rows": 0, "nulls": 0, "distinct": 0, "whole": False, "min": None, "max": None, "drawn": []}
    found, clashing = {c: dict(none) for c in columns}, []
    for r in plain:
        found[columns[r["i"]]] |= {"rows": r["rows"], "nulls": r["rows"] - r["n"], "whole": bool(r["whole"]), "min": r["min"], "max": r["max"]}
    for r in values.groupBy("i").agg(F.count("*").alias("distinct"), F.count_if(F.col("g1") != F.col("g2")).alias("clashes"), *drawn).collect():
        found[columns[r["i"]]] |= {"distinct": r["distinct"], "drawn": [r[f"s{j}"] for j in range(DRAWN) if r[f"s{j}"] is not None]}
        clashing += [r["i"]] if r["clashes"] else []
    for i in clashing:  # two values of a column share a 64-bit hash
        shared = values.filter((F.col("i") == i) & (F.col("g1") != F.col("g2"))).select(F.col("h").alias("__h"))
        c = no_nan(ref(columns[i]), type_of(df, columns[i]))
        behind = df.select(c.alias("c"), hashes(c)[0].alias("__h")).filter("c is not null").join(shared, "__h", "left_semi")
        true, told = behind.select("c").distinct().count(), shared.count()
        found[columns[i]]["distinct"] += true - told
    return found


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) with values as text."""
    cells = [F.struct(F.lit(c).alias("column"), no_nan(ref(c), type_of(df, c)).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def first_of_each(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key in ascending order, with their ``rank``.

    Each task keeps n rows of a key and no more, whatever it reads, so only tasks * keys * n rows are
    shuffled and sorted.  Keys are few.
    """

    def run(batches):
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if kept is None else pa.concat_tables([kept, table])).sort_by([(c, "ascending") for c in (key, *order)])
            codes = table[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            kept = table.take(np.flatnonzero(np.arange(len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes))) < n))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    return df.mapInArrow(run, df.schema).withColumn("rank", rank).filter(F.col("rank") <= n)


def top_values(df: DataFrame, columns: list[str], n: int = TOP) -> DataFrame:
    """(column, value, n, rank): the most frequent values, ties by value.  Counted, then the first n of each task compete."""
    counted = unpivoted(df, columns).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    best = first_of_each(counted.select("column", "value", (-F.col("n")).alias("less")), "column", ["less", "value"], n)
    return best.select("column", "value", (-F.col("less")).alias("n"), "rank")


def sample_values(df: DataFrame, columns: list[str], ordinal: str, n: int = SAMPLES) -> DataFrame:
    """(column, value, rank): the first values that are there, in order of ``ordinal``."""
    cells = [F.struct(F.lit(c).alias("column"), no_nan(ref(c), type_of(df, c)).cast("string").alias("value")) for c in columns]
    long = df.select(ref(ordinal).alias("__o"), F.explode(F.array(*cells)).alias("cell")).filter("cell.value is not null")
    return first_of_each(long.select("__o", "cell.*"), "column", ["__o"], n).select("column", "value", "rank")


def moments(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """min, max, mean and std of numeric columns, a record for each column and task."""
    cells = [F.struct(F.lit(i).alias("i"), to_double(ref(c), type_of(df, c)).alias("v")) for i, c in enumerate(columns)]
    if not cells:
        return {}
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("i").agg(*_number_aggs(F.col("v"), "")).collect()
    return {columns[r["i"]]: {n: r[n] for n in ("min", "max", "mean", "std")} for r in rows}


def profile_columns(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Everything the data dictionary says about columns; the number of jobs does not depend on theirs."""
    counts = column_counts(df, columns)
    numeric = [c for c in columns if is_numeric(type_of(df, c))]
    other = [c for c in columns if c not in numeric]
    plain, middle = moments(df, numeric), quantiles(df, {c: to_double(ref(c), type_of(df, c)) for c in numeric}, QUARTILES)
    for c in numeric:
        found = plain.get(c, {"min": None}) | dict(zip(("q25", "median", "q75"), middle[c], strict=True))
        counts[c]["numbers"] = {n: found[n] for n in NUMBERS} if found["min"] is not None else {}
    if other:
        for r in top_values(df, other).orderBy("column", "rank").collect():
            counts[r["column"]].setdefault("top", {})[r["value"]] = r["n"]
    samples = first_values(df, columns)
    for c in columns:
        kind = type_of(df, c)
        counts[c]["samples"] = samples[c]
        counts[c]["dtype"] = {"bigint": "int64", "double": "float64", "boolean": "bool"}.get(kind.simpleString(), "object" if isinstance(kind, T.StringType) else kind.simpleString())
    return counts


def first_values(df: DataFrame, columns: list[str], n: int = SAMPLES, head: int = HEAD) -> dict[str, list]:
    """The first n values of each column that are there, as the file is read.

    The first rows are looked at alone; columns that are too sparse there take one pass, in which a
    task keeps its first n values of each.
    """
    if not columns:
        return {}
    plain = df.select(*[no_nan(ref(c), type_of(df, c)).alias(f"v{i}") for i, c in enumerate(columns)])
    rows = plain.limit(head).collect()
    out: dict[str, list] = {c: [r[i] for r in rows if r[i] is not None][:n] for i, c in enumerate(columns)}
    sparse = [i for i, c in enumerate(columns) if len(out[c]) < n] if len(rows) == head else []
    if not sparse:
        return out

    def run(batches):
        kept: dict[int, list[tuple[int, Any]]] = {i: [] for i in sparse}
        for batch in batches:
            for i in sparse:
                values = batch.column(batch.schema.get_field_index(f"v{i}"))
                for at in np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))[: n - len(kept[i])].tolist():
                    kept[i].append((batch.column(0)[at].as_py(), values[at].as_py()))
        flat = [(i, place, pickle.dumps(v)) for i, some in kept.items() for place, v in some]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["i", "place", "value"])

    marked = plain.select(F.monotonically_increasing_id().alias("place"), *[f"v{i}" for i in sparse])
    firsts = first_of_each(marked.mapInArrow(run, "i int, place long, value binary"), "i", ["place"], n)
    for i in sparse:
        out[columns[i]] = []
    for r in firsts.orderBy("i", "place").collect():
        out[columns[r["i"]]].append(pickle.loads(r["value"]))
    return out


def drawn_values(df: DataFrame, drawn: dict[str, list[int]]) -> dict[str, list]:
    """The values of each column behind some hashes, in order of the hashes; one job for all columns."""
    out: dict[str, list] = {c: [] for c in drawn}
    columns = [c for c in drawn if drawn[c]]
    if not columns:
        return out
    cells = []
    for i, name in enumerate(columns):
        kind = type_of(df, name)
        c = no_nan(ref(name), kind)
        h = hashes(F.when(c == 0, F.lit(0).cast(kind)).otherwise(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c)[0]
        cells.append(F.when(c.isNotNull() & h.isin(*drawn[name]), F.struct(F.lit(i).alias("i"), h.alias("h"), c.cast("string").alias("text"))))
    there = df.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("c")).select("c.*").distinct()
    seen = set()
    for r in sorted(there.collect()):
        name = columns[r["i"]]
        kind = type_of(df, name)
        if (r["i"], r["h"]) not in seen:
            out[name].append(int(r["text"]) if isinstance(kind, T.IntegralType) else float(r["text"]) if isinstance(kind, (T.DoubleType, T.FloatType)) else r["text"])
        seen.add((r["i"], r["h"]))
    return out
