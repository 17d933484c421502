"""Search over transcripts and frames as two indexes, either of which may be missing or unusable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.operators.retrieval import dense_topk, merged_evidence
from tesselith.sources.scratch import written

SIDE = "query_id long, doc_id long, score double"


def usable_frames(frames: DataFrame, indexes: DataFrame, current: dict) -> DataFrame:
    """Frames (source_id, frame_id, embedding) of the sources whose index can be searched.

    indexes: (source_id, backend, model, dim, vectors). A source is left out if its index was made by another backend or model, holds vectors of another dimension than the
    current one, or another number of vectors than its manifest says; one without a backend and model (an older manifest) is judged by dimension and number alone.
    """
    have = frames.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))
    d = indexes.join(have, "source_id")
    older = F.col("backend").isNull() & F.col("model").isNull()
    same = older | ((F.col("backend") == current["backend"]) & (F.col("model") == current["model"]))
    fits = (F.col("dim") == current["dim"]) & (F.col("low") == current["dim"]) & (F.col("high") == current["dim"]) & (F.col("vectors") == F.col("n"))
    good = d.where(F.coalesce(same & fits, F.lit(False))).select("source_id")
    return frames.join(good, "source_id", "left_semi")


def frame_search(frames: DataFrame, indexes: DataFrame, current: dict, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): the k best frames of each query over all usable sources; doc_id is the frame's id."""
    v = usable_frames(frames, indexes, current).select(F.col("frame_id").alias("vec_id"), "embedding")
    return dense_topk(v, queries, k).select("query_id", F.col("vec_id").alias("doc_id"), F.col("dense_score").alias("score"))


def or_empty(spark, side: Callable[[], DataFrame], schema: str = SIDE) -> DataFrame:
    """What side() gives, worked out and written; empty if it fails, when it is planned or when it runs: search goes on with the other side."""
    try:
        return written(side().select(*[c.split()[0] for c in schema.split(", ")]), "search-side")
    except Exception:  # noqa: BLE001  whatever is wrong with one index
        return spark.createDataFrame([], schema)


def multimodal_search(spark, transcript: Callable[[int], DataFrame] | None, frames: Callable[[int], DataFrame] | None, k: int) -> DataFrame:
    """(query_id, doc_id, score, kind, rank): the k best of both kinds by score, from 2k candidates of each. A side that isn't asked for or fails is empty."""
    n = max(k, 2 * k)
    sides = [or_empty(spark, lambda f=f: f(n)).withColumn("kind", F.lit(kind)) for kind, f in (("transcript", transcript), ("frame", frames)) if f is not None]
    return merged_evidence(*sides, k=max(1, k)) if sides else spark.createDataFrame([], f"{SIDE}, kind string, rank int")
