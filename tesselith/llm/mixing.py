"""Mixing sources to target weights by Pfair scheduling. DataFrame operations only.

Documents of a source are put in an order fixed by the md5 of their ids and cut into blocks of equal
size. Time is a row of slots, one block each. Target weights are whole parts of a period. A source with quota q in a period of D slots has a k-th
block (from 0) with release time floor(k*D/q) and deadline ceil((k+1)*D/q); at each slot the released
block with the earliest deadline runs. Quotas sum to D, so every deadline is met and no source is ever a
whole block ahead of or behind its weight. All windows repeat after D slots, so one period (bounded
by the parts) is scheduled by a fold, and every block finds its slot by arithmetic and one equi-join.

A source that has run out leaves its slots empty; the others keep their proportions to each other.
No document is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.llm.common import text_bytes

#: Slots of a period where weights don't say another; the most that given weights may need to be taken exactly; slots a source has at least on average.
PERIOD, EXACT, PER_SOURCE = 1000, 10_000, 4
BLOCK_BYTES = 1 << 14


def default_weight(size: Column) -> Column:
    """Square-root smoothing of a source's bytes, as an integer."""
    return F.greatest(F.lit(1), F.round(F.sqrt(size.cast("double")) * 1000).cast("long"))


def quotas(sources: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, quota, period) of (source, weight, given): the slots of each source in a period, which sum to it.

    Where all weights are given and come to EXACT parts or fewer in lowest terms, those are the quotas, and no rounding takes place. Otherwise
    weights are taken in parts of a period (of `period` slots, or PER_SOURCE a source if that is more): one slot each and the rest in proportion, by largest
    remainders, ties to the source that sorts first. Either way the quotas are the target weights, and the mix never drifts from them.
    Weights below 1 raise an error.
    """
    everyone = Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(everyone)
    weight = F.when(F.col("weight") < 1, F.raise_error(F.concat(F.lit("not a positive weight: "), F.col("weight").cast("string"))).cast("long")).otherwise(F.col("weight"))
    d = sources.select("source", weight.alias("weight"), "given", n.alias("n"))
    divisor = F.aggregate(F.collect_set("weight").over(everyone), F.lit(0).cast("long"), _gcd)
    d = d.withColumn("least", F.floor(F.col("weight") / divisor).cast("long"))
    d = d.withColumn("exact", F.min("given").over(everyone) & (F.sum("least").over(everyone) <= EXACT))
    d = d.withColumn("period", F.when(F.col("exact"), F.sum("least").over(everyone)).otherwise(F.greatest(F.lit(period).cast("long"), PER_SOURCE * F.col("n"))))
    d = d.withColumn("share", (F.col("period") - F.col("n")).cast("decimal(38,0)") * F.col("weight")).withColumn("total", F.sum("weight").over(everyone))
    d = d.withColumn("base", F.expr("1 + share div total")).withColumn("rest", F.expr("share % total"))
    d = d.withColumn("left", F.col("period") - F.sum("base").over(everyone))
    d = d.withColumn("place", F.row_number().over(everyone.orderBy(F.desc("rest"), F.col("source"))))
    rounded = F.col("base") + (F.col("place") <= F.col("left")).cast("int")
    return d.select("source", F.when(F.col("exact"), F.col("least")).otherwise(rounded).cast("long").alias("quota"), "period")


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's, by a fold of 92 steps: enough for any two longs."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("x"), b.alias("y")), lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y"))), lambda s: s["x"])


def pattern(quota: DataFrame) -> DataFrame:
    """(source, k, slot): the earliest-deadline-first schedule of one period of quotas().

    A fold over the slots; ties between deadlines go to the source that sorts first.
    """
    one = quota.agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("s"), F.max("period").alias("d")).where("size(s) > 0")
    # one candidate per source: deadline and place of the source in one number
    pick = """array_min(transform(acc.c, (c, i) ->
                 if(c < s[i].quota and (c * d) div s[i].quota <= t,
                    (((c + 1) * d + s[i].quota - 1) div s[i].quota) * size(s) + i, null))) % size(s)"""
    fold = f"""
        aggregate(sequence(0L, d - 1),
          named_struct('c', transform(s, x -> 0L), 'picks', cast(array() as array<bigint>)),
          (acc, t) -> transform(array({pick}), p -> named_struct(
            'c', transform(acc.c, (c, i) -> if(i = p, c + 1, c)),
            'picks', array_append(acc.picks, p)))[0],
          acc -> acc.picks)
    """
    picks = one.select("s", F.posexplode(F.expr(fold)).alias("slot", "p"))
    picked = picks.select(F.col("slot").cast("long").alias("slot"), F.expr("s[int(p)].source").alias("source"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return picked.select("source", nth.cast("long").alias("k"), "slot")


def scheduled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, period: int = PERIOD, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Every row with its place in the mix: source, size, block, release_slot, deadline_slot, slot, block_offset.

    The mix is the order of (slot, block_offset). weights: (source, weight long > 0), one row a source; those of sources without
    rows don't count. Sources it lacks take default_weight of their bytes, in the proportion that it has to the weights given
    for the others; without `weights` all take it. `keep` names further columns to carry.

    Sizes are UTF-8 bytes, at least 1, so null and empty texts count 1. A null source is a source of its own.
    A text longer than a block leaves the following blocks without a start; their slots stay empty.
    Ties of md5 (equal ids) are broken by id, and equal rows are interchangeable. Without rows the result is empty.
    Columns of the input that aren't named are not read, so their names can't clash.
    """
    d = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("given"), F.greatest(F.lit(1).cast("long"), text_bytes(F.col(text_col))).alias("size"),
        F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))).alias("source"),
        F.when(F.col(id_col).isNull(), F.md5(F.concat(F.lit("null"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))).otherwise(F.md5(F.col(id_col).cast("string").cast("binary"))).alias("h"),
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep or []]).alias("kept"),
    ).withColumn("bucket", F.substring("h", 1, 3))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("b"))
    per_source = sums.groupBy("source").agg(F.sum("b").alias("bytes"))
    sized = per_source.withColumns({"weight": default_weight(F.col("bytes")), "given": F.lit(False)})
    if weights is not None:
        named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
        sized = sized.join(weights.select(named.alias("source"), F.col("weight").cast("long").alias("set")), "source", "left")
        everyone = Window.partitionBy(F.lit(0))
        scale = F.sum("set").over(everyone) / F.sum(F.when(F.col("set").isNotNull(), F.col("weight"))).over(everyone)
        some = F.max(F.col("set").isNull()).over(everyone)
        # in thousandths of the weights given where some aren't, so that small ones are not lost
        own = F.when(some, F.col("set") * 1000).otherwise(F.col("set"))
        other = F.greatest(F.lit(1), F.round(F.col("weight") * F.coalesce(scale, F.lit(1.0)) * 1000).cast("long"))
        sized = sized.withColumn("given", ~some).withColumn("weight", F.coalesce(own, other))
    quota = quotas(sized.select("source", "weight", "given"), period)
    # The slots that the longest source needs, with the quotas: one row a source.
    q = quota.join(per_source, "source").withColumn("last", F.expr(f"(bytes - 1) div {block_bytes}"))
    ends = F.max(F.expr("(last div quota) * period + ((last % quota + 1) * period + quota - 1) div quota")).over(Window.partitionBy(F.lit(0)))
    quota = q.select("source", "quota", "period", ends.alias("slots"))
    # a period's slots: EXACT, or `period`, or PER_SOURCE a source, whatever the rows
    plan = F.broadcast(pattern(quota))
    before = F.sum("b").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("start", F.coalesce(before, F.lit(0))).join(F.broadcast(quota), "source").drop("b")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("run", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["source", "bucket"])
    d = d.withColumn("cum", F.col("start") + F.col("run")).withColumn("block", F.expr(f"cum div {block_bytes}"))
    d = d.withColumn("k", F.expr("block % quota")).withColumn("base", F.expr("(block div quota) * period"))
    d = d.join(plan, ["source", "k"])
    return d.select(
        "doc_id", F.col("given").alias("source"), "size", "block",
        F.expr("base + (k * period) div quota").alias("release_slot"),
        F.expr("base + ((k + 1) * period + quota - 1) div quota").alias("deadline_slot"),
        (F.col("base") + F.col("slot")).alias("slot"),
        F.expr(f"cum - block * {block_bytes}").alias("block_offset"), *(["kept", "slots"] if keep else []),
    )


def mixed(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The rows of docs, all their columns, laid out in the order of the mix: contiguous runs of slots, sorted inside."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = scheduled(docs, keep=docs.columns, **options).withColumn("part", F.expr(f"int(least({n - 1}, (slot * {n}) div slots))"))
    by_id = getattr(d, "repartitionById", None)
    d = by_id(n, "part") if by_id else d.repartition(n, "part")
    return d.sortWithinPartitions("slot", "block_offset").select(*[F.col("kept").getField(c).alias(c) for c in docs.columns])
