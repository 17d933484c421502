"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by the order of its nearest pivots (reference points drawn from the data, a bounded and
documented sample, spread apart so that a group of near copies holds one of them); each vector is posted in the inverted
lists of its pivots. Two vectors are candidates if they have the same nearest pivot or share so many pivots of a prefix as
PREFIXES says; then the cosine is verified in double precision. The first are compared in a list of their own, which makes a dense
group's comparison exact; sharing s of a prefix of p means sharing one of its p - s + 1 rarest
pivots, so only those lists are kept besides. Long lists are cut into tiles by hash, and tiles meet in pairs: no list,
however hot, is one task. Every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselith.llm.common import connected_components, drop_written, spread_join, written

TILE_ROWS = 2048
#: Pivots: PIVOTS_PER_ROOT times the square root of the vectors, within these bounds. The sample of reference points is no larger.
PIVOTS_PER_ROOT, MIN_PIVOTS, MAX_PIVOTS = 2.0, 16, 16384
#: So many vectors are looked at for each pivot: those close to a pivot already taken are passed over.
DRAWN_PER_PIVOT = 4
#: From so many pivots on: the prefix, and how many of it are shared. Measured on pairs of random directions at cosine 0.951, of 32, 64 and 128
#: dimensions, these find 0.98 of the pairs or more; with 8 and 4 it is 0.96 at 1024 pivots, 0.91 at 4096 and 0.87 at 16384.
PREFIXES = [(0, 8, 4), (256, 10, 4), (2048, 12, 4)]


def prefix_for(n_pivots: int) -> tuple[int, int]:
    return next((p, s) for least, p, s in reversed(PREFIXES) if n_pivots >= least)


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & some)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spread_pivots(x: np.ndarray, most: int, threshold: float) -> np.ndarray:
    """At most `most` of the unit vectors x, first come first taken, no two of them within twice the threshold's angle."""
    limit = math.cos(2 * math.acos(min(1.0, max(-1.0, threshold)))) if threshold > 0 else -1.0
    free, taken = np.ones(len(x), bool), []
    for i in range(len(x)):
        if free[i]:
            taken.append(i)
            if len(taken) == most:
                break
            free &= x @ x[i] < limit
    return x[taken]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", prefix: int | None = None, min_shared: int | None = None, tile_rows: int = TILE_ROWS, max_pivots: int = MAX_PIVOTS, pivots_per_root: float = PIVOTS_PER_ROOT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    n_links counts the other vectors at that cosine or more; component_id is the smallest vec_id reachable.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
    lengths don't link. Equal vectors form one class first; a class stands for all its members. Rows of one vec_id are one vector,
    each returned; should they differ, the one whose hash is least stands for them. Rows with a null vec_id are
    left out. Without rows the result is empty. Other columns aren't read.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)
    good = _valid(vectors, id_col, vec_col).withColumn("key", F.concat_ws(":", F.xxhash64("v").cast("string"), F.xxhash64(F.lit(7), F.col("v")).cast("string")))
    least = Window.partitionBy("vec_id").orderBy("key")
    narrow = written(good.select("vec_id", "key").withColumn("place", F.row_number().over(least)).where("place = 1").drop("place"), "vec-ids")
    classes = written(narrow.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members")), "vec-classes")
    member = written(spread_join(narrow, classes, "key", "vec_id", "inner").select("vec_id", "rep", "members"), "vec-member")
    first = classes.select(F.col("rep").alias("vec_id"), "key", "members")
    reps = good.join(first, ["vec_id", "key"]).select("vec_id", "members", F.col("v").cast("array<float>" if single else "array<double>").alias("v"))
    reps = written(reps.dropDuplicates(["vec_id"]), "vec-reps")
    n_pivots = int(min(max_pivots, max(MIN_PIVOTS, math.ceil(pivots_per_root * math.sqrt(reps.count())))))
    # at most DRAWN_PER_PIVOT * MAX_PIVOTS rows
    sample = [r["v"] for r in reps.select("v", "vec_id").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(DRAWN_PER_PIVOT * n_pivots).collect()]
    pivots = {k: spread_pivots(_unit(np.array([v for v in sample if len(v) == k])), n_pivots, threshold) for k in {len(v) for v in sample}}
    width = max([0, *(len(p) for p in pivots.values())])
    usual = prefix_for(width)
    prefix, min_shared = prefix or usual[0], min_shared or usual[1]
    held = spark.sparkContext.broadcast(pivots)  # MAX_PIVOTS vectors of each length in the sample

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors as bytes, and the numbers of their nearest pivots, nearest first."""
        near = held.value
        for batch in batches:
            v = batch.column(2)
            flat, sizes = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(sizes)]
            for k in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == k)
                x = flat[(starts[at][:, None] + np.arange(k)).ravel()].reshape(len(at), k).astype(kind)
                if k in near:
                    order = np.concatenate([np.argsort(-(_unit(x[lo : lo + 2048]) @ near[k].T), axis=1, kind="stable")[:, :prefix] for lo in range(0, len(x), 2048)])
                else:  # no pivot of that length: one list for all of them
                    order = np.zeros((len(at), 1), np.int64)
                lists = (order + k * max(1, width)).astype(np.int64)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(lists), pa.list_(pa.int64()))], ["id", "members", "x", "pivots"])

    described = written(reps.mapInArrow(describe, "id long, members long, x binary, pivots array<long>"), "vec-index")
    # at most two rows a pivot, of which there are few; -1 - p is the list of those whose nearest pivot is p
    sizes = {r["p"]: r["n"] for r in described.select(F.explode(F.concat("pivots", F.array(-1 - F.col("pivots")[0]))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths = spark.sparkContext.broadcast(sizes)
    shared = min(min_shared, max(1, width))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each list and tile pair that a vector meets others in; its pivots go along, rarest first, the nearest in front of them."""
        n_of = lengths.value
        for batch in batches:
            lists = batch.column(3)
            count = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(count)]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            mixed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
            for m in np.unique(count).tolist():
                rows = np.flatnonzero(count == m)
                pv = flat[(starts[rows][:, None] + np.arange(m)).ravel()].reshape(len(rows), m)
                known, back = np.unique(pv, return_inverse=True)
                common = np.array([n_of[p] for p in known.tolist()])[back].reshape(pv.shape)
                ranked = np.take_along_axis(pv, np.lexsort((pv, common), axis=1), 1)
                packed = np.column_stack([pv[:, 0], ranked]).astype("<i8")
                where = np.column_stack([-1 - pv[:, 0], ranked[:, : max(1, m - shared + 1)]])
                each, back = np.unique(where, return_inverse=True)
                tiles = -(-np.array([n_of[p] for p in each.tolist()]) // tile_rows)[back].ravel()
                at, where = np.repeat(np.arange(len(rows)), where.shape[1]), where.ravel()
                own = mixed[rows][at] % tiles
                again = np.repeat(np.arange(len(at)), tiles)
                other = np.arange(len(again)) - np.repeat(np.r_[0, np.cumsum(tiles)[:-1]], tiles)
                at, where, own = at[again], where[again], own[again]
                for lo in range(0, len(at), 4096):
                    s = slice(lo, lo + 4096)
                    take = pa.array(rows[at[s]])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(where[s]), pa.array(np.minimum(own, other)[s], pa.int32()), pa.array(np.maximum(own, other)[s], pa.int32()), pa.array(own[s], pa.int32()),
                        batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array([r.tobytes() for r in packed[at[s]]], pa.binary()),
                    ], ["list", "t1", "t2", "own", "id", "members", "x", "pivots"])

    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        p, one, two = (k.as_py() for k in key)
        ids, own, weights = (rows.column(c).to_numpy() for c in ("id", "own", "members"))
        order = np.argsort(ids, kind="stable")
        ids, own, weights = ids[order], own[order], weights[order]
        sides = [order, order] if one == two else [order[own == one], order[own == two]]
        pick = [np.arange(len(ids))] * 2 if one == two else [np.flatnonzero(own == one), np.flatnonzero(own == two)]
        if not len(sides[0]) or not len(sides[1]):
            return _found([], [], [])
        vectors_, pivots_ = rows.column("x").to_pylist(), rows.column("pivots").to_pylist()
        x = _unit(np.frombuffer(b"".join(vectors_), kind).reshape(len(order), -1)[order])
        pv = np.frombuffer(b"".join(pivots_), "<i8").reshape(len(order), -1)[order]
        near, pv = pv[:, 0], pv[:, 1:]
        need = min(shared, pv.shape[1])
        head = pv.shape[1] - need + 1
        total, label, pairs = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        left, right = pick
        y = x[right]
        for lo in range(0, len(left), 256):
            i, j = np.nonzero(x[left[lo : lo + 256]] @ y.T >= threshold)
            i, j = left[i + lo], right[j]
            ok = ids[i] < ids[j] if one == two else ids[i] != ids[j]
            if p >= 0:  # pairs with one nearest pivot are counted in its own list
                ok &= near[i] != near[j]
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 50_000):
                u, v = i[at : at + 50_000], j[at : at + 50_000]
                if p >= 0:
                    same = pv[u][:, :, None] == pv[v][:, None, :]
                    # enough pivots shared, and this is the first list that both are posted in: a pair counts once
                    first = same[:, :head, :head].any(2)
                    ok = (same.sum((1, 2)) >= need) & first.any(1) & (pv[u, first.argmax(1)] == p)
                    u, v = u[ok], v[ok]
                total += np.bincount(u, weights[v], len(ids)).astype(np.int64) + np.bincount(v, weights[u], len(ids)).astype(np.int64)
                pairs.append((u.astype(np.int32), v.astype(np.int32)))
        u, v = (np.concatenate(z) for z in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int32),) * 2
        while len(u):
            low = np.minimum(label[u], label[v])
            if (label[u] == low).all() and (label[v] == low).all():
                break
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            label = label[label]
        hit = total > 0
        return _found(ids[hit], total[hit], ids[label[hit]])

    posted = described.mapInArrow(post, "list long, t1 int, t2 int, own int, id long, members long, x binary, pivots binary")
    found = written(posted.groupBy("list", "t1", "t2").applyInArrow(verify, "id long, links long, root long"), "vec-links")
    component = connected_components(found.select("id", "root"), "id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = written(links.join(component, "id").withColumnRenamed("id", "rep"), "vec-linked")
    drop_written(described, reps, classes, narrow)
    of_member = spread_join(member, linked, "rep", "vec_id", "left").select("vec_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    every = vectors.select(F.col(id_col).alias("vec_id")).where("vec_id is not null")
    out = every.join(of_member, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _found(ids, links, roots) -> pa.Table:
    return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(roots, pa.int64())})
