"""Sharding over fixed virtual slots. DataFrame operations only.

Rows hash into thousands of virtual slots; only bytes and rows per slot are aggregated, and a map from slot
to shard, kept in versions, says where each slot lies. Rebalancing edits the map: slots stay where they are
unless their shard is too full. The map has N_SLOTS rows whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.llm.common import scratch_path, text_bytes, written

N_SLOTS = 4096


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, text_hash): size is UTF-8 bytes and 8; a null text has no bytes and the checksum of none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (text_bytes(F.col(text_col)) + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))


def with_slots(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """rows of sized() and `vslot`, 0 to n_slots - 1: a hash of the record, its id and text, so no slot is hot whatever repeats."""
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(17)), F.lit(n_slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(vslot, bytes, rows) of the rows of with_slots()."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _placed(slots: DataFrame, loads: Column | None, n_shards: int) -> DataFrame:
    """(vslot, bytes, rows, shard): slots in order of falling size, each to the shard least loaded, the first of equals.

    slots has at most the virtual slots; loads is an array of what the shards hold before.
    """
    start = loads if loads is not None else F.array_repeat(F.lit(0).cast("long"), n_shards)
    one = slots.agg(F.sort_array(F.collect_list(F.struct("bytes", F.col("vslot"), "rows")), asc=False).alias("s"), *([F.first(loads).alias("l")] if loads is not None else []))
    one = one.withColumn("l", F.col("l") if loads is not None else start).where("size(s) > 0")
    fold = f"""
        aggregate(s, named_struct('l', l, 'p', cast(array() as array<bigint>)),
          (acc, x) -> transform(array(array_min(transform(acc.l, (v, i) -> v * {n_shards} + i)) % {n_shards}), p -> named_struct(
             'l', transform(acc.l, (v, i) -> if(i = p, v + x.bytes, v)), 'p', array_append(acc.p, p)))[0],
          acc -> acc.p)
    """
    d = one.select(F.explode(F.arrays_zip(F.col("s"), F.expr(fold).alias("p"))).alias("z"))
    return d.select(F.col("z.s.vslot").alias("vslot"), F.col("z.s.bytes").alias("bytes"), F.col("z.s.rows").alias("rows"), F.col("z.p").cast("int").alias("shard"))


def first_map(sizes: DataFrame, n_shards: int) -> DataFrame:
    """Version 1 of the map: (version, vslot, shard, bytes, rows)."""
    return _placed(sizes, None, n_shards).select(F.lit(1).alias("version"), "vslot", "shard", "bytes", "rows")


def edited_map(old: DataFrame, sizes: DataFrame, n_shards: int, slack: float = 0.02) -> DataFrame:
    """The next version for new sizes or another number of shards.

    A slot stays unless its shard is gone or, with the shard's larger slots, holds more than the mean and the slack.
    Slots new to the map and those freed go, large ones first, to the least loaded shards.
    """
    held = sizes.join(old.select("vslot", F.col("shard").alias("was"), "version"), "vslot", "left")
    all_slots = Window.partitionBy(F.lit(0))
    held = held.withColumn("cap", F.sum("bytes").over(all_slots) / n_shards * (1 + slack)).withColumn("next", F.coalesce(F.max("version").over(all_slots), F.lit(0)) + 1)
    full = Window.partitionBy("was").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("stays", F.coalesce((F.col("was") < n_shards) & (F.sum("bytes").over(full) <= F.col("cap")), F.lit(False)))
    loads = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: F.aggregate(F.filter("k", lambda x: x["was"] == i), F.lit(0).cast("long"), lambda a, x: a + x["bytes"]))
    kept = F.collect_list(F.when(F.col("stays"), F.struct("was", "bytes"))).over(all_slots)
    held = held.withColumn("k", kept).withColumn("loads", loads)
    moved = _placed(held.where("not stays"), F.col("loads"), n_shards)
    out = held.where("stays").select("vslot", F.col("was").alias("shard"), "bytes", "rows").unionByName(moved.select("vslot", "shard", "bytes", "rows"))
    version = held.agg(F.max("next").alias("version"), F.lit(0).alias("one"))
    return out.withColumn("one", F.lit(0)).join(F.broadcast(version), "one").select("version", "vslot", "shard", "bytes", "rows")


class SlotMapStore:
    """Versions of a slot-to-shard map, one folder each, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, new: DataFrame, version: int) -> DataFrame:
        new.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")


def sharded(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text", store: SlotMapStore | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, vslot, shard (bytes near equal) and slot, its place in the shard.

    Places are gapless from 0: an offset per virtual slot from the map, and the rank inside the virtual slot by id.
    Null and empty texts count 8 bytes. Equal ids are equal rows: each is kept, in any order. Without rows the result
    is empty. Other columns of docs aren't read.
    """
    spark = docs.sparkSession
    # four narrow columns: the texts are read once
    rows = written(with_slots(sized(docs, id_col, text_col), n_slots), "shard-rows")
    store = store or SlotMapStore(spark, scratch_path(spark, "slot-map"))
    slot_map = store.save(first_map(slot_sizes(rows), n_shards), 1)
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    starts = slot_map.select("vslot", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_hash")) - 1
    # n_slots rows at most: a fixed bound for the broadcast
    d = rows.withColumn("place", place).join(F.broadcast(starts), "vslot")
    return d.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
