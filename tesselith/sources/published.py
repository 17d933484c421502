"""Stores that are published whole: rows in buckets by key, generations of buckets, and a manifest that says which of them hold.

A change writes the buckets it touches under a new generation and then one small manifest, by way of a temporary name. Readers take the newest manifest, so they
see the store before the change or after it, never between, and an attempt that breaks off leaves nothing that is read. Manifests are never overwritten. Everything goes through
the file system of the path, on whatever it lies. One writer at a time; a change that is made again under its number gives the same store.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path, *parts]))


def write_file(spark: SparkSession, path: str, name: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    fs, at = _fs(spark, path)
    out = fs.create(at(f".{name}.tmp"), True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at(name), False)
    if not fs.rename(at(f".{name}.tmp"), at(name)):
        raise OSError(f"{path}/{name}: can't be renamed into place")


def read_file(spark: SparkSession, path: str, name: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at(name))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests, oldest first."""
    fs, at = _fs(spark, path)
    if not fs.exists(at()):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at())]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, generation: int | None = None) -> dict | None:
    """The newest manifest, or that of a generation; None if nothing was published."""
    known = generations(spark, path)
    if not known:
        return None
    return json.loads(read_file(spark, path, f"manifest-{known[-1] if generation is None else generation:09d}.json"))


def bucket_of(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, generation: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The store as of its newest manifest, or a generation's; some buckets only, if they are named."""
    m = manifest(spark, path, generation)
    if m is None:
        raise FileNotFoundError(f"{path}: nothing was published")
    schema = StructType.fromJson(m["schema"])
    files = [f"{path}/data/g{g:09d}/bucket={b}" for b, g in m["buckets"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def publish(rows: DataFrame, path: str, key: list[str], buckets: int = BUCKETS, facts: dict | None = None) -> dict:
    """rows in place of all that the store holds."""
    known = generations(rows.sparkSession, path)
    return _written(rows, path, key, buckets, (known[-1] if known else 0) + 1, {}, range(buckets), facts)


def merge(changes: DataFrame, path: str, key: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame], gone: DataFrame | None = None, buckets: int = BUCKETS, generation: int | None = None, facts: dict | None = None) -> dict:
    """combine(old, changes) in the buckets that changes touch; rows whose key is in `gone` leave. Other buckets aren't read or written.

    With a generation (the number of a stream's batch), a change that is already published isn't made again.
    """
    spark = changes.sparkSession
    m = manifest(spark, path)
    if m and generation is not None and generation <= m["generation"]:
        return m
    n = generation if generation is not None else (m["generation"] if m else 0) + 1
    buckets = m["of"] if m else buckets
    touched = changes.select(*key) if gone is None else changes.select(*key).union(gone.select(*key))
    numbers = sorted(r[0] for r in touched.select(bucket_of(key, buckets)).distinct().collect())  # as many numbers as buckets at most
    old = read(spark, path, buckets=numbers) if m else changes.limit(0)
    if gone is not None:
        old = old.join(gone.select(*key).distinct(), key, "left_anti").select(*old.columns)
    return _written(combine(old, changes), path, key, buckets, n, m["buckets"] if m else {}, numbers, facts)


def _written(rows: DataFrame, path: str, key: list[str], buckets: int, n: int, before: dict, touched, facts: dict | None) -> dict:
    spark, schema = rows.sparkSession, rows.schema
    fs, at = _fs(spark, path)
    folder = f"g{n:09d}"
    placed = rows.withColumn("bucket", bucket_of(key, buckets))
    placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(at("data", folder))]
    now = {b: g for b, g in before.items() if int(b) not in set(touched)} | {x[7:]: n for x in names if x.startswith("bucket=")}
    m = {"generation": n, "of": buckets, "key": key, "buckets": now, "schema": json.loads(schema.json()), "facts": facts or {}}
    write_file(spark, path, f"manifest-{n:09d}.json", json.dumps(m, sort_keys=True))
    return m


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all manifests but the newest `keep`, which readers may still hold, and the generations' files that none of these names."""
    known = generations(spark, path)
    fs, at = _fs(spark, path)
    held = {int(g) for n in known[-keep:] for g in manifest(spark, path, n)["buckets"].values()}
    if not fs.exists(at("data")):
        return []
    for n in known[:-keep]:
        fs.delete(at(f"manifest-{n:09d}.json"), False)
    gone = [int(name[1:]) for s in fs.listStatus(at("data")) if (name := s.getPath().getName())[1:].isdigit() and int(name[1:]) not in held and int(name[1:]) <= (known[-1] if known else 0)]
    for n in gone:
        fs.delete(at("data", f"g{n:09d}"), True)
    return gone
