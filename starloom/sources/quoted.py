"""Delimited files whose quoted cells hold line breaks, read by as many tasks as the files have splits.

A line break ends a record only outside quotes, and whether a split starts inside quotes depends on
all that is before it.  So one pass tells, for each split, where it ends up from either state; the
states at the splits' starts follow from those one after the other.  A second pass then puts lines
together to records, split by split.  Of a record that crosses splits, the first split keeps the
beginning and the others hand over the rest.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

#: Bytes of rests of records that are broadcast; more of them come as rows behind all others.
MOST_RESTS = 64 << 20


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a line break behind this text is inside quotes; a quote opens only at the start of a cell, two of them are one."""
    at, start = 0, not inside
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
            else:
                inside, start, at = False, False, at + 1
        elif start and line.startswith('"', at):
            inside, at = True, at + 1
        else:
            at = line.find(delimiter, at)
            if at < 0:
                return False
            start, at = True, at + 1


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the lines of each split, in order; a carriage return stays at its end."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of each batch by split; a task reads a split whole and in order."""
    for batch in batches:
        files, starts, at = batch.column("file"), batch.column("start"), 0
        while at < batch.num_rows:
            key = (files[at].as_py(), starts[at].as_py())
            same = pc.and_(pc.equal(starts.slice(at), key[1]), pc.equal(files.slice(at), key[0]))
            n = pc.index(same, pa.scalar(False)).as_py()
            n = batch.num_rows - at if n < 0 else n
            yield key, batch.column("value").slice(at, n)
            at += n


def transitions(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file, start, outside, inside, closes, opens) of each split.

    Whether it ends inside quotes if it starts outside or inside; whether the record that it starts
    inside ends in it; whether any of its lines, read from outside, leaves quotes open.
    """

    def run(batches):
        found: dict[tuple[str, int], list[bool]] = {}
        for key, values in _pieces(batches):
            now = found.setdefault(key, [False, True, False, False])
            for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                ends = {s: ends_inside(line, s, delimiter) for s in {now[0], now[1]}}
                now[:] = [ends[now[0]], ends[now[1]], now[2] or not ends[now[1]], now[3] or ends[now[0]]]
        rows = [(f, s, *x) for (f, s), x in found.items()]
        kinds = (pa.string(), pa.int64(), *[pa.bool_()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "start", "outside", "inside", "closes", "opens"])

    return lines.mapInArrow(run, "file string, start long, outside boolean, inside boolean, closes boolean, opens boolean")


def owners(splits: list) -> dict[tuple[str, int], int]:
    """For each split that starts inside quotes, the start of the split in which that record began."""
    found: dict[tuple[str, int], int] = {}
    last, owner = None, None  # the split that the open record began in, if one is open
    for r in sorted(splits, key=lambda r: (r["file"], r["start"])):
        owner = owner if r["file"] == last else None
        last = r["file"]
        if owner is not None:
            found[last, r["start"]] = owner
            if r["closes"]:
                owner = r["start"] if r["inside"] else None
        elif r["outside"]:
            owner = r["start"]
    return found


def _records(lines: DataFrame, begun: dict[tuple[str, int], int], delimiter: str) -> DataFrame:
    """(file, start, kind, seq, text): records (kind 0), beginnings of records at the end of a split (1), and rests for the split in which they began (2)."""

    def run(batches):
        out: list[list] = [[], [], [], [], []]
        now, inside, resting, header, pending = None, False, False, False, []

        def put(kind: int, text: str) -> None:
            nonlocal header
            if kind != 2 and header and text.strip():
                header = False
            elif kind or text.strip():
                for c, x in zip(out, (now[0], begun[now] if kind == 2 else now[1], kind, now[1], text), strict=True):
                    c.append(x)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["file", "start", "kind", "seq", "text"])
            for c in out:
                c.clear()
            return batch

        for key, values in _pieces(batches):
            if key != now:
                if pending:
                    put(2 if resting else 1, "\n".join(pending))
                now, inside, resting, header, pending = key, key in begun, key in begun, key[1] == 0, []
            for line in values.to_pylist():
                pending.append(line)
                inside = ends_inside(line, inside, delimiter) if '"' in line else inside
                if not inside:
                    put(2 if resting else 0, "\n".join(pending))
                    resting, pending = False, []
            yield flush()
        if pending:
            put(2 if resting else 1, "\n".join(pending))
        yield flush()

    return lines.mapInArrow(run, "file string, start long, kind int, seq long, text string")


def read_quoted(spark: SparkSession, path: str, delimiter: str, plain: DataFrame, whole: DataFrame) -> DataFrame:
    """Every column as text, in the order of the header and of the file.

    ``plain`` reads line by line and ``whole`` file by file; the first is used where no cell holds a line break, the
    second only for the names of the columns.
    """
    lines = lines_of(spark, path)
    splits = transitions(lines, delimiter).collect()  # a row for each split
    if not any(r["opens"] for r in splits):
        return plain
    rows = _records(lines, owners(splits), delimiter)
    rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    rests = rows.filter("kind = 2").groupBy("file", "start").agg(rest.alias("rest"), F.lit(1).alias("kind"))
    size = rests.agg(F.coalesce(F.sum(F.octet_length("rest")), F.lit(0))).first()[0]
    stay = rows.filter("kind < 2").select("file", "start", "kind", "text")
    texts = stay.join(F.broadcast(rests), ["file", "start", "kind"], "left") if size <= MOST_RESTS else stay.filter("kind = 0").withColumn("rest", F.lit(None).cast("string")).unionByName(stay.filter("kind = 1").join(rests, ["file", "start", "kind"], "left"))
    text = F.regexp_replace(F.concat_ws("\n", "text", "rest"), "\r$", "")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in whole.columns)
    options = {"sep": delimiter, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return texts.select(F.from_csv(text, schema, options).alias("r")).select("r.*")
