"""What several operators share: the shared folder, written tables and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselith.sources.scratch import scratch_path


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation. options are Parquet's."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_levels: int = 64) -> DataFrame:
    """(id, component) for every id that an edge names; component is the smallest id reachable.

    Each level points every vertex at the neighbour of least hash (itself included) and contracts
    along the pointers. Hash order keeps chains short in expectation, whatever the ids are. Levels are
    written to the shared folder; no more than one count reaches the driver. Nulls name no vertex;
    loops give a component of one. An edge table without rows gives an empty result.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    first = level = written(pairs.distinct(), "cc-edges")
    vertices = first.select(F.col("a").alias("id")).union(first.select("b")).distinct()
    pointers: list[DataFrame] = []
    old: list[DataFrame] = []
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    while True:
        level = level.where("a <> b")
        if level.isEmpty():
            break
        if len(pointers) == max_levels:
            raise RuntimeError(f"components: not contracted after {max_levels} levels")
        both = level.union(level.select("b", "a"))
        to = both.groupBy("a").agg(F.least(F.first(rank("a")), F.min(rank("b"))).alias("m"))
        to = written(to.select(F.col("a").alias("id"), F.col("m.v").alias("to")), "cc-to")
        pointers.append(to)
        nxt = (
            level.join(to.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a")
            .join(to.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        old.append(level := written(nxt, "cc-edges"))
    root = vertices.select("id", F.col("id").alias("root"))
    for to in pointers:
        step = to.select(F.col("id").alias("root"), F.col("to").alias("next"))
        root = root.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    root = written(root, "cc-root")
    drop_written(*pointers, *old, first)
    least = root.groupBy("root").agg(F.min("id").alias("component"))
    return root.join(least, "root").select("id", "component")


#: Rows that small() lets a plan send to every task.
SMALL_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A written table of a few narrow columns, to be sent to every task if it has SMALL_ROWS rows or fewer; else as it is, for a join that shuffles both sides."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


#: Keys that hot_keys() finds at most.
HOT_KEYS = 1000


def hot_keys(rows: DataFrame, key: str, least: int = 256) -> DataFrame:
    """(key, parts) of the keys that hold more than 1/HOT_KEYS of the rows, and more than `least`: HOT_KEYS rows at most.

    parts: into how many a key's rows are to be dealt so that each has about that share. rows should be a written table.
    """
    limit = max(least, rows.count() // HOT_KEYS)
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    picked = found.select(key, F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    return rows.sparkSession.createDataFrame(picked.collect(), picked.schema)


def spread_join(rows: DataFrame, one: DataFrame, key: str, spread_by: str, how: str = "left", count_rows: DataFrame | None = None) -> DataFrame:
    """rows joined with `one` (a row a key); the rows of a hot key are dealt over several tasks by `spread_by`, and its row of `one` is sent to each.

    count_rows: a written table with the same keys about as often, if counting rows itself would be dear.
    """
    hot = F.broadcast(hot_keys(count_rows if count_rows is not None else rows, key))
    left = rows.join(hot, key, "left").withColumn("__salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread_by, F.lit(5)), F.col("parts"))).cast("int")).drop("parts")
    right = one.join(hot, key, "left").withColumn("__salt", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")
    return left.join(right, [key, "__salt"], how).drop("__salt")
