"""Canonical tables of the engine from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.sources.tables import table


def with_lines(documents: DataFrame, *more: str) -> DataFrame:
    """(doc_id, lang, source, lines[, more]): the lines of a text that aren't blank, with start and end in tenths of a second; more columns of the documents stay beside them.

    A line takes a second and a tenth per character; lines follow each other. Running totals within the row: nothing is shuffled.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    took = lambda x: (F.length(x) + 10).cast("long")
    timed = lambda ls: F.zip_with(ls, T.running_totals(F.transform(ls, took)), lambda x, at: F.struct(at.alias("start_ds"), (at + took(x)).alias("end_ds"), x.alias("text")))
    return documents.select("doc_id", "lang", "source", T.let(lines, timed).alias("lines"), *more)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ord, start_ds, end_ds, text) of documents."""
    d = with_lines(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "lang", "source", F.posexplode("lines").alias("ord", "x")).select("doc_id", "lang", "source", F.col("ord").cast("long").alias("ord"), "x.start_ds", "x.end_ds", "x.text")


def query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, terms) of benchmark items: their tokens."""
    b = table(spark, sf_dir, "benchmark")
    terms = T.latin_tokens(F.col("text"))
    return b.select(F.col("item_id").alias("query_id"), F.array_join(terms, " ").alias("query"), terms.alias("terms"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback records from labels: good quality is relevant; the query is the benchmark item of the id modulo their number; updated hours after a fixed time."""
    y = table(spark, sf_dir, "labels")
    items = table(spark, sf_dir, "benchmark").select(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    return y.select(
        F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % items).alias("query_id"),
        F.when(F.col("quality") == 1, "relevant").otherwise("not_relevant").alias("label"),
        F.expr("timestamp_seconds(1700000000 + (doc_id % 2000) * 3600)").alias("updated_at"),
    )
