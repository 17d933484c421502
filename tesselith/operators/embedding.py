"""Hash embeddings of characters, and norms."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Texts whose vectors are made at once.
PART = 512


def hash_vector(text: str | None, dim: int = 768, seen: dict | None = None) -> list[float]:
    """Each character of the cleaned text adds or takes one at a place, both from its 8-byte BLAKE2b digest; then unit length."""
    seen = {} if seen is None else seen
    v = np.zeros(max(128, dim))
    for c, n in Counter(" ".join((text or "").split())).items():
        if c not in seen:
            d = hashlib.blake2b(c.encode(), digest_size=8).digest()
            seen[c] = (int.from_bytes(d[:4], "little") % len(v), 1.0 if d[4] & 1 == 0 else -1.0)
        at, sign = seen[c]
        v[at] += sign * n
    norm = np.sqrt((v * v).sum())
    return (v / norm if norm else v).tolist()


def hash_embeddings(texts: DataFrame, dim: int = 768) -> DataFrame:
    """(doc_id, embedding) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, PART):
                part = batch.slice(lo, PART)
                x = np.array([hash_vector(t, dim, seen) for t in part.column(1).to_pylist()])
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], ["doc_id", "embedding"])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, embedding array<double>")


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))
