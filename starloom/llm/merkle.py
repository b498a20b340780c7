"""A Merkle manifest of a dataset: one digest for all rows, a subroot for each group, and a proof for each row.

Rows are sorted by ranges of (group, id), so a partition holds neighbouring leaves.  It hashes what
it can by itself; what is left are a few nodes on its left and right edge, its fragment.  Fragments
are sparse forests: nodes keyed by group, level and index.  Two of them merge into their union, in
which every sibling run that is complete (the number of its members is known from the group's size)
becomes its parent.  That is associative, so ``treeReduce`` merges all fragments; the nodes that
merges used up are kept, as they are the siblings that the proofs of other partitions need.

A partition has at most ``2 * log2(rows)`` such nodes, so what reaches the driver and is broadcast
grows with the number of partitions, some 40 nodes for each half million rows, and with the number
of groups, which are to be few (languages).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, column, map_batches, shared

#: The columns of a leaf, members of a sibling run, leaves of a partition, and rows that come out at once.
COLUMNS, ARITY, ROWS, OUT_ROWS = ("doc_id", "source", "lang", "n_chars", "text"), 2, 1 << 19, 5000
#: Rows of one in so many ids are tampered with in the report.
TAMPER = 7

#: A fragment: open nodes and nodes that merges used up, by (group, level, index).
Fragment = tuple[dict, dict]


def joined(digests: Any) -> bytes:
    """H of the digests, as hex text."""
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def width(leaves: int, level: int, arity: int) -> int:
    """How many nodes a level has."""
    for _ in range(level):
        leaves = -(-leaves // arity)
    return leaves


def climb(digests: np.ndarray, first: int, size: int, arity: int = ARITY) -> list[tuple[int, np.ndarray]]:
    """For each level the nodes that follow from the leaves ``first`` and on of a tree of ``size`` leaves: index of the first, digests."""
    levels = [(first, digests)]
    while size > 1 and len(digests):
        parent, stop = -(-first // arity), (-(-size // arity) if first + len(digests) == size else (first + len(digests)) // arity)
        made = [joined(digests[max(p * arity - first, 0) : (p + 1) * arity - first].tolist()) for p in range(parent, stop)]
        first, digests, size = parent, np.array(made, "S64"), -(-size // arity)
        levels.append((first, digests))
    return levels


def fragment(group: Any, levels: list[tuple[int, np.ndarray]], arity: int = ARITY) -> dict:
    """The nodes of ``climb`` whose parents it could not make: those left and right of the complete runs."""
    found = {}
    for level, (first, digests) in enumerate(levels):
        above, made = levels[level + 1] if level + 1 < len(levels) else (0, ())
        left, right = (above * arity - first, (above + len(made)) * arity - first) if len(made) else (len(digests), len(digests))
        found |= {(group, level, first + i): digests[i] for i in (*range(left), *range(right, len(digests)))}
    return found


def merge(a: Fragment, b: Fragment, sizes: dict, arity: int = ARITY) -> Fragment:
    """The union of two fragments, with every complete sibling run replaced by its parent."""
    (open_nodes, used), (more, more_used) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    open_nodes.update(more)
    used.update(more_used)
    for key in more:
        while key in open_nodes:
            group, level, index = key
            n, start = width(sizes[group], level, arity), index // arity * arity
            run = [(group, level, i) for i in range(start, min(start + arity, n))]
            if n == 1 or not all(k in open_nodes for k in run):
                break
            used.update((k, open_nodes.pop(k)) for k in run)
            key = (group, level + 1, index // arity)
            open_nodes[key] = joined(used[k] for k in run)
    return open_nodes, used


def siblings(index: int, levels: list[tuple[int, np.ndarray]], used: dict, group: Any, sizes: list[int], arity: int = ARITY) -> Iterator[tuple[bytes, bytes]]:
    """For each level the digests to the left and to the right of a leaf's node in its run."""
    for level, n in enumerate(sizes[:-1]):
        start = index // arity * arity
        first, digests = levels[level] if level < len(levels) else (0, ())
        end = first + len(digests)
        run = [digests[i - first] if first <= i < end else used.get((group, level, i), b"") for i in range(start, min(start + arity, n)) if i != index]
        yield b"".join(run[: index - start]), b"".join(run[index - start :])
        index //= arity


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = joined((left, leaf, right))
    return leaf


def widths(size: int, arity: int) -> list[int]:
    found = [size]
    while found[-1] > 1:
        found.append(-(-found[-1] // arity))
    return found


def cell(name: str) -> Column:
    """A value as a leaf holds it: ``-`` for null, else its bytes, a colon and the value."""
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: tuple[str, ...] = COLUMNS, changed: dict[str, Column] | None = None) -> Column:
    """H of the columns; some may be changed."""
    cells = [cell(c) for c in columns]
    for i, c in enumerate(columns):
        if changed and c in changed:
            text = changed[c].cast("string")
            cells[i] = F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*cells), 256)


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None, changed: dict[str, Column] | None = None, arity: int = ARITY, rows: int = ROWS, with_path: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, and if asked for its group, position and path.

    Leaves ascend by id inside their group, null ids first; equal ids by their leaves, so repeated
    rows come out each and the digests do not depend on the order of the table.  Groups ascend bytewise,
    the null group first; a group of one leaf has that leaf as subroot, one group's subroot is the
    root.  Where ``tampered`` holds, the proof starts from the leaf of the ``changed`` columns.
    Other columns are not looked at, whatever their names.  An empty table gives an empty table.
    """
    suspect = F.when(tampered, leaf_digest(columns, changed)) if tampered is not None else F.lit(None).cast("string")
    leaves = df.select(F.col(group_col).cast("string").alias("lang"), F.col(id_col).alias("doc_id"), leaf_digest(columns).alias("leaf"), suspect.alias("tampered"), F.monotonically_increasing_id().alias("row"))
    spark, total = df.sparkSession, df.count()
    parts = max(-(-total // rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 1000 + 1))
    order = ["lang", "doc_id", "leaf", "row"]
    ranged = checkpoint(leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")).withColumn("part", F.spark_partition_id())

    # where each partition's leaves stand in their group
    counts = sorted(((r["lang"], r["part"], r["n"]) for r in ranged.groupBy("part", "lang").agg(F.count("*").alias("n")).collect()), key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    sizes: dict[Any, int] = {}
    starts: dict[tuple, int] = {}
    for group, part, n in counts:
        starts[part, group] = sizes.get(group, 0)
        sizes[group] = starts[part, group] + n
    known = shared(spark, (starts, sizes))

    def fragments(batches):
        starts, sizes = known()
        for part, group, some in _runs(batches, ("leaf",)):
            digests = np.array(some["leaf"], "S64")
            nodes = fragment(group, climb(digests, starts[part, group], sizes[group], arity), arity)
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(nodes), pa.string()), pa.array([k[1] for k in nodes], pa.int32()), pa.array([k[2] for k in nodes], pa.int64()), pa.array(list(nodes.values()), pa.binary())], names=["lang", "level", "at", "digest"])

    edges = map_batches(ranged.select("part", "lang", "leaf"), fragments, "lang string, level int, at long, digest binary").rdd
    one_each = edges.mapPartitions(lambda rows: [({(r[0], r[1], r[2]): bytes(r[3]) for r in rows}, {})])
    open_nodes, used = one_each.treeReduce(lambda a, b: merge(a, b, known()[1], arity)) if counts else ({}, {})

    groups = list(sizes)  # in order
    subroots = [open_nodes[g, len(widths(sizes[g], arity)) - 1, 0] for g in groups]
    upper = climb(np.array(subroots, "S64"), 0, len(groups), arity)
    tops = {g: list(siblings(i, upper, {}, None, widths(len(groups), arity), arity)) for i, g in enumerate(groups)}
    root = upper[-1][1][0] if groups else b""
    beyond = shared(spark, (used, dict(zip(groups, subroots, strict=True)), tops, root))
    kind = ranged.schema["doc_id"].dataType.simpleString()

    def proofs(batches):
        (starts, sizes), (used, subroots, tops, root) = known(), beyond()
        for part, group, some in _runs(batches, ("doc_id", "leaf", "tampered")):
            first, size = starts[part, group], sizes[group]
            levels, sized = climb(np.array(some["leaf"], "S64"), first, size, arity), widths(size, arity)
            for at in range(0, len(some["leaf"]), OUT_ROWS):
                leaf, tampered = some["leaf"][at : at + OUT_ROWS].to_pylist(), some["tampered"][at : at + OUT_ROWS].to_pylist()
                paths = [[*siblings(first + at + i, levels, used, group, sized, arity), *tops[group]] for i in range(len(leaf))]
                folded = [fold((t or x).encode(), p) for t, x, p in zip(tampered, leaf, paths, strict=True)]
                n = len(leaf)
                text = lambda x, n=n: pa.array([x.decode()] * n)
                out = {"doc_id": some["doc_id"][at : at + OUT_ROWS], "leaf": pa.array(leaf), "subroot": text(subroots[group]), "root": text(root), "proof_sha256": pa.array([joined(x for pair in p for x in pair).decode() for p in paths]), "folded_root": pa.array([f.decode() for f in folded]), "verified": pa.array([f == root for f in folded])}
                if with_path:
                    out |= {"lang": pa.array([group] * n, pa.string()), "position": pa.array(range(first + at, first + at + n), pa.int64()), "path": pa.array([[{"left": a.decode(), "right": b.decode()} for a, b in p] for p in paths])}
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out.values()], names=list(out))

    more = ", lang string, position bigint, path array<struct<left: string, right: string>>" if with_path else ""
    return map_batches(ranged.select("part", "lang", "doc_id", "leaf", "tampered"), proofs, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean{more}")


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, Any, dict[str, pa.ChunkedArray]]]:
    """(partition, group, columns) of each run of a group in a sorted partition."""
    held, now = [], None
    for batch in batches:
        groups = column(batch, "lang")
        codes = groups.dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            key = (column(batch, "part")[a].as_py(), groups[a].as_py())
            if held and key != now:
                yield *now, {n: pa.chunked_array([column(x, n) for x in held]) for n in names}
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield *now, {n: pa.chunked_array([column(x, n) for x in held]) for n in names}


def proof_report(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The manifest where rows of one in seven ids are tampered with: 1 is added to n_chars (a null stays)."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % TAMPER == 0
    return manifest(df, id_col, group_col, columns, hit, {"n_chars": F.col("n_chars") + 1})
