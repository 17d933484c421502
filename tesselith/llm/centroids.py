"""Centroid clustering of integer vectors, with block-norm screening.

A vector is cut into segments, whose norms are worked out once and stand for it in compressed form; so are a centroid's. By Cauchy-Schwarz the squared
distance of two segments is no less than the squared difference of their norms, so the squared distance of two short vectors of norms
bounds the whole from below. A centroid whose bound lies above the best exact distance so far is left out; the others receive exact integer
distances. Tasks add up their vectors per cluster, so a round shuffles a row for each task and cluster, however many vectors a cluster holds, and the
driver gets the sums of the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm.common import drop_written, written

#: Components of a vector, components of a segment, and by what components are multiplied before they are rounded down.
DIMS, SEGMENT, SCALE = 64, 8, 256
#: Integers beyond this have squared distances that a long can't hold.
LIMIT = 1 << 27
STEP = 4096


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors with `dims` components, none null or non-finite; x holds floor(scale * component), in double."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < LIMIT))
    return vectors.where((F.size(v) == dims) & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("x"))


def segment_norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Norms of each row's segments; the last may be shorter."""
    x = x.astype(np.float64)
    return np.sqrt(np.stack([(x[:, lo : lo + segment] ** 2).sum(1) for lo in range(0, x.shape[1], segment)], 1))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, the smaller number in a tie, and how many exact distances that took."""
    bound = ((norms[:, None, :] - centroid_norms[None]) ** 2).sum(2)
    # rounding of the norms can't lift a bound above the distance
    bound -= 1e-12 * ((norms**2).sum(1)[:, None] + (centroid_norms**2).sum(1)[None]) + 1e-6
    exact = lambda rows, j: ((x[rows] - centroids[j]) ** 2).sum(1)
    first = bound.argmin(1)
    best, cluster, done = exact(np.arange(len(x)), first), first.copy(), len(x)
    for j in range(len(centroids)):
        rows = np.flatnonzero((bound[:, j] <= best) & (first != j))
        if len(rows):
            d = exact(rows, j)
            better = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = d[better], j
            done += len(rows)
    return cluster, best, done


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept.

    The k vectors whose sha256 of "<seed>:<vec_id>" is smallest are the first centroids, in that order (equal vec_ids: in the order of their
    components; fewer vectors: as many centroids). A round assigns vectors to their nearest centroid, the smaller number in a tie,
    and replaces each centroid that has vectors by their mean, rounded down; then vectors are assigned once more. Vectors that are null, of another
    length, hold a null or non-finite component, or one of 2^27 / scale or more (squared distances might exceed a long) are left out.
    Rows of one vec_id are vectors of their own; a null vec_id hashes as an empty one. Without vectors the result is empty. Other columns aren't read.
    """
    spark = vectors.sparkSession
    blocks = -(-dims // segment)

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = segment_norms(_matrix(batch.column(1), np.int64, dims), segment)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(norms), pa.list_(pa.float64()))], ["vec_id", "x", "norms"])

    kept = written(integer_vectors(vectors, id_col, vec_col, dims, scale).mapInArrow(compressed, "vec_id long, x array<int>, norms array<double>"), "centroid-vectors")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = np.array([r["x"] for r in kept.select(draw.alias("h"), "x").orderBy("h", "x").limit(k).collect()], np.int64).reshape(-1, dims)  # k rows

    def assigning(centroids: np.ndarray):
        norms = segment_norms(centroids, segment)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for lo in range(0, batch.num_rows, STEP):
                    part = batch.slice(lo, STEP)
                    x = _matrix(part.column(1), np.int64, dims)
                    yield part, x, *nearest(x, _matrix(part.column(2), np.float64, blocks), centroids, norms)[:2]

        return each

    def summing(centroids: np.ndarray):
        each = assigning(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
            for _, x, cluster, _ in each(batches):
                n += np.bincount(cluster, minlength=len(n))
                order = np.argsort(cluster, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(cluster[order]) > 0])
                sums[cluster[order[starts]]] += np.add.reduceat(x[order], starts)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

        return run

    for _ in range(rounds if len(centroids) else 0):
        parts = kept.mapInArrow(summing(centroids), "cluster int, n long, s array<long>")
        totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s"))
        centroids = centroids.copy()
        for r in totals.collect():  # a row a centroid
            centroids[r["cluster"]] = [s // r["n"] for s in r["s"]]

    each = assigning(centroids)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance in each(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    out = written((kept if len(centroids) else kept.limit(0)).mapInArrow(final, "vec_id long, cluster int, distance long"), "centroid-clusters")
    drop_written(kept)
    inertia = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    return out.join(F.broadcast(spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
