"""Loose JSON: stores that are a list, an object by key, or lines, read as variants by one plan; what can't be read is set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def records(rows: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """(found, bad) of rows (…, json): found (…, ord, key, record variant) has a row for each entry, bad (…, ord, json) one for each text or line that can't be read.

    A list gives its elements; an object that has `field` is a record itself, another gives its values with their keys; other texts are read line by line, each a record or a list or object of some.
    Entries that are no objects are bad. Null and blank texts, and blank lines, hold nothing. ord counts a text's entries from 0, in order.
    """
    others = [c for c in rows.columns if c != "json"]
    lines = F.filter(F.split("json", "\n"), lambda x: F.trim(x) != "")
    d = rows.where("trim(json) <> ''").withColumn("lines", lines)
    # the parser takes the first value of a text and leaves the rest: a first line that is a value by itself makes the text one of lines
    by_line = F.try_parse_json("json").isNull() | ((F.size("lines") > 1) & F.try_parse_json(F.get("lines", F.lit(0))).isNotNull())
    d = d.select(*others, F.posexplode(F.when(by_line, F.col("lines")).otherwise(F.array("json"))).alias("line", "text")).withColumn("v", F.try_parse_json("text"))
    single = F.try_variant_get("v", f"$.{field}", "string").isNotNull()
    d = d.withColumns({"kind": F.schema_of_variant("v"), "single": single})
    entries = F.col("kind").startswith("ARRAY") | (F.col("kind").startswith("OBJECT") & ~F.col("single"))
    spark = rows.sparkSession
    several = d.where(entries).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*others, "line", "pos", "key", F.col("value").alias("record"))
    one = d.where(F.col("kind").startswith("OBJECT") & F.col("single")).select(*others, "line", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.col("v").alias("record"))
    all_ = several.union(one).withColumn("object", F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False)))
    place = (F.col("line").cast("long") * (1 << 32) + F.col("pos")).alias("ord")
    found = all_.where("object").select(*others, place, "key", "record")
    unread = d.where(F.col("v").isNull() | ~(F.col("kind").startswith("ARRAY") | F.col("kind").startswith("OBJECT"))).select(*others, (F.col("line").cast("long") * (1 << 32)).alias("ord"), F.col("text").alias("json"))
    return found, unread.union(all_.where("not object").select(*others, place, F.to_json("record")))


def got(record: str, kind: str, *paths: str) -> Column:
    """The value at the first of several paths that holds one of that type; null if none does."""
    return F.coalesce(*[F.try_variant_get(record, p, kind) for p in paths])
