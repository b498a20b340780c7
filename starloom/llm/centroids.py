"""Centroid clustering by Lloyd's rounds with Elkan's bounds, in exact whole numbers.

Each vector carries an upper bound of the distance to its centroid and a lower bound of the distance
to every centroid.  Half the distance between two centroids, and the bounds, tell which distances
need not be computed.  Bounds are rounded away from the truth and a distance is skipped only if the
bound is strictly beyond it, so ties are seen; what decides is the exact squared distance.

Vectors live in blocks of a hundred.  A round is one narrow pass over the blocks that moves bounds,
assigns vectors and sums them by cluster; only the sums, a row for each cluster and component, reach
the driver.  Blocks are checkpointed after each round, as the next one starts from their bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, column, forget, map_batches

#: Components of a vector, clusters, rounds, what a component is multiplied by, and what is hashed before an id.
DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors of a block (some 35 kilobytes: a thousand blocks may go to Python at once), and blocks that are worked on together.
BLOCK, TOGETHER = 100, 20
#: Components beyond this are set to it: squared distances then fit 64 bits.
MOST = (1 << 27) - 1


class Step(NamedTuple):
    """What a round needs: centroids, how far each has moved since the last round (rounded up), and half their distances (rounded down)."""

    centroids: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray | None = None) -> Step:
        gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        moved = np.zeros(len(centroids)) if before is None else _up(np.sqrt(((centroids - before) ** 2).sum(axis=1)))
        return cls(centroids, moved, _down(_down(np.sqrt(gaps)) / 2))


def _up(x: np.ndarray) -> np.ndarray:
    """Not less than the exact value, of a float that is within one unit of it."""
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf), -np.inf), 0)


def assign(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: Step) -> int:
    """One round over some vectors, in place; gives how many distances were computed.

    ``cluster`` has the nearest centroid of the last round (0 before the first), ``upper`` an upper
    bound of its distance and ``lower`` lower bounds of all distances, before the centroids moved.
    Afterwards ``cluster`` is the nearest centroid, the smallest number of ties.
    """
    k, computed = len(step.centroids), 0
    np.maximum(_down(lower - step.moved), 0, out=lower)
    np.copyto(upper, _up(upper + step.moved[cluster]))
    apart = step.half.copy()
    np.fill_diagonal(apart, np.inf)
    live = np.flatnonzero(~(upper < apart.min(axis=1)[cluster])) if k > 1 else np.zeros(0, np.int64)
    exact = np.full(len(live), -1, np.int64)  # squared distance to the own centroid, once known
    for c in range(k):
        own = cluster[live]
        may = (own != c) & ~(upper[live] < lower[live, c]) & ~(upper[live] < step.half[own, c])
        stale = may & (exact < 0)
        at = live[stale]
        if len(at):  # tighten the upper bound first, then look again
            near = ((vectors[at].astype(np.int64) - step.centroids[cluster[at]]) ** 2).sum(axis=1)
            exact[stale] = near
            upper[at], lower[at, cluster[at]] = _up(np.sqrt(near)), _down(np.sqrt(near))
            computed += len(at)
            may &= ~(upper[live] < lower[live, c]) & ~(upper[live] < step.half[own, c])
        some = np.flatnonzero(may)
        at = live[some]
        if not len(at):
            continue
        far = ((vectors[at].astype(np.int64) - step.centroids[c]) ** 2).sum(axis=1)
        computed += len(at)
        lower[at, c] = _down(np.sqrt(far))
        better = (far < exact[some]) | ((far == exact[some]) & (c < cluster[at]))
        exact[some[better]] = far[better]
        cluster[at[better]] = c
        upper[at[better]] = _up(np.sqrt(far[better]))
    return computed


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors with all their components, none null, NaN or infinite: floor(scale * x), x as double."""
    there = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(F.size("v") == dimensions)
    sound = there.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))))
    whole = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double"), F.lit(1e9)), F.lit(-1e9)) * scale), F.lit(MOST)), F.lit(-MOST)).cast("int")
    return sound.select("vec_id", F.transform("v", whole).alias("v"))


def _blocks(vectors: DataFrame, dimensions: int, k: int) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors: ids, components, and clusters and bounds before the first round."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = column(part, "v").flatten().to_numpy(zero_copy_only=False).astype("<i4")
                n = part.num_rows
                state = {"v": v.tobytes(), "cluster": np.zeros(n, "<i4").tobytes(), "upper": np.full(n, np.inf).tobytes(), "lower": np.zeros((n, k)).tobytes(), "computed": 0}
                ids = column(part, "vec_id")
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), *(pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in state.values())], names=["ids", *state])

    return map_batches(vectors, run, f"ids array<{kind}>, v binary, cluster binary, upper binary, lower binary, computed bigint")


def _loaded(batches: Iterator[pa.RecordBatch], k: int, dimensions: int):
    """Some blocks at a time: their rows, where each block's vectors begin, and all their vectors, clusters and bounds."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            v, cluster, upper, lower = (np.frombuffer(b"".join(column(part, n).to_pylist()), t).copy() for n, t in (("v", "<i4"), ("cluster", "<i4"), ("upper", "<f8"), ("lower", "<f8")))
            begin = np.cumsum([0] + [len(x) // 4 for x in column(part, "cluster").to_pylist()])
            yield part, begin, v.reshape(-1, dimensions), cluster, upper, lower.reshape(-1, k)


def _round(blocks: DataFrame, step: Step, dimensions: int) -> DataFrame:
    k = len(step.centroids)

    def run(batches):
        for part, begin, v, cluster, upper, lower in _loaded(batches, k, dimensions):
            computed = assign(v, cluster, upper, lower, step)
            state = [pa.array([x[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary()) for x in (cluster, upper, lower)]
            share = np.zeros(part.num_rows, np.int64)
            share[0] = computed  # of all these blocks
            yield pa.RecordBatch.from_arrays([column(part, "ids"), column(part, "v"), *state, pa.array(share)], names=part.schema.names)

    return map_batches(blocks, run, blocks.schema)


def _sums(blocks: DataFrame, k: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and component sums (Python integers) of the clusters; a task sends one row for each of its clusters."""

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for v, c in zip(column(batch, "v"), column(batch, "cluster"), strict=True):
                v, c = np.frombuffer(v.as_buffer(), "<i4").reshape(-1, dimensions), np.frombuffer(c.as_buffer(), "<i4")
                count += np.bincount(c, minlength=k)
                for j in np.unique(c):
                    total[j] += v[c == j].sum(axis=0, dtype=np.int64)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([[int(count[j]), *total[j].tolist()] for j in used], pa.list_(pa.int64()))], names=["cluster", "sums"])

    rows = map_batches(blocks.select("v", "cluster"), run, "cluster int, sums array<bigint>")
    cells = rows.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    count, total = np.zeros(k, object), np.zeros((k, dimensions), object)
    for r in cells.collect():  # a row for each cluster and component
        if r["at"]:
            total[r["cluster"], r["at"] - 1] = int(r["x"])
        else:
            count[r["cluster"]] = int(r["x"])
    return count, total


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids have the least hashes; equal ids by their components, null ids last."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    rows = hashed.orderBy(F.asc_nulls_last("hash"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every sound vector.

    A vector is sound with exactly ``dimensions`` components, none null, NaN or infinite; others give
    no row.  Repeated rows and repeated ids count and come out each.  Fewer sound vectors than k make
    as many clusters; none make no rows.  Ties go to the smaller cluster.  A component beyond
    2^27 - 1 after scaling counts as that; an inertia beyond 64 bits comes out as 2^63 - 1.  Rounds end
    early only when no centroid moves, which changes nothing.  Other columns are not looked at.
    """
    vectors = quantised(df, id_col, vector_col, dimensions, scale)
    centroids = first_centroids(vectors, k, seed)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))])
    k = len(centroids)
    blocks, step = checkpoint(_blocks(vectors, dimensions, k)), Step.of(centroids)
    for _ in range(rounds):
        last, blocks = blocks, checkpoint(_round(blocks, step, dimensions))
        forget(last)
        count, total = _sums(blocks, k, dimensions)
        centroids = np.array([[t // n for t in row] if n else old.tolist() for n, row, old in zip(count, total, step.centroids, strict=True)], np.int64)
        step = Step.of(centroids, step.centroids)
        if not step.moved.any():
            break
    final = step

    def run(batches):
        for part, _, v, c, upper, lower in _loaded(batches, k, dimensions):
            assign(v, c, upper, lower, final)
            distance = ((v.astype(np.int64) - final.centroids[c]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([column(part, "ids").flatten(), pa.array(c, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    placed = checkpoint(map_batches(blocks, run, f"vec_id {kind}, cluster int, distance bigint"))
    forget(blocks)
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    held = lambda n: min(n, (1 << 63) - 1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.centroids.tolist()]
    per_cluster = placed.sparkSession.createDataFrame([(c, held(s), held(sum(sums.values())), digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
