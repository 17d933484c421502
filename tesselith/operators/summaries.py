"""Summaries: segments and prompt lines, checks of generated items, their normal form, and map-reduce with an injected model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T

# Points of a summary and of a window, window and compact sizes in characters, line budgets, sentences of an item.
MAX_POINTS, MAP_POINTS = 5, 3
WINDOW_CHARS, COMPACT_CHARS, SINGLE_CHARS, LINE_OVERHEAD = 7000, 18000, 16000, 48
LINE_LEAST, LINE_MOST, LINE_MARGIN = 42, 180, 20
MIN_SENTENCES, MAX_SENTENCES = 4, 5
JAPANESE_SHARE = 0.7


def summary_segments(lines: DataFrame) -> DataFrame:
    """lines with `segments`, array<struct<start_ds, end_ds, ord, text>>: cleaned, without blanks, no end before its start, by start and end.

    A null or empty array gives an empty one. Ties keep the order of the lines.
    """
    rows = F.transform(F.coalesce("lines", F.expr("cast(array() as array<struct<start_ds:bigint,end_ds:bigint,text:string>>)")), lambda x, i: F.struct(
        x["start_ds"].alias("start_ds"), F.greatest(x["start_ds"], F.coalesce(x["end_ds"], x["start_ds"])).alias("end_ds"), i.alias("ord"), T.clean(x["text"]).alias("text")))
    return lines.withColumn("segments", F.array_sort(F.filter(rows, lambda x: x["text"] != "")))


def prompt_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, n, line): segments numbered from 1, with minutes and seconds from and to."""
    d = summary_segments(lines).select("doc_id", F.posexplode("segments").alias("i", "x"))
    at = lambda c: T.minutes_clock(F.col(c) / 10.0)
    line = F.concat(F.format_string("[%04d] ", F.col("i") + 1), at("x.start_ds"), F.lit("-"), at("x.end_ds"), F.lit(" "), F.col("x.text"))
    return d.select("doc_id", (F.col("i") + 1).cast("long").alias("n"), line.alias("line"))


def compact_lines(lines: DataFrame, target: int = COMPACT_CHARS) -> DataFrame:
    """(doc_id, n, line): as prompt_lines, with the start alone and each text cut to its share of the target, with an ellipsis."""
    d = summary_segments(lines).withColumn("m", F.size("segments")).select("doc_id", "m", F.posexplode("segments").alias("i", "x"))
    d = d.withColumn("budget", F.greatest(F.lit(LINE_LEAST), F.least(F.lit(LINE_MOST), F.floor(F.lit(float(target)) / F.col("m")) - LINE_MARGIN)).cast("int"))
    text = F.when(F.length("x.text") <= F.col("budget"), F.col("x.text")).otherwise(F.concat(F.rtrim(F.expr("substring(x.text, 1, budget - 1)")), F.lit("…")))
    line = F.concat(F.format_string("[%04d] ", F.col("i") + 1), T.minutes_clock(F.col("x.start_ds") / 10.0), F.lit(" "), text)
    return d.select("doc_id", (F.col("i") + 1).cast("long").alias("n"), line.alias("line"))


def sentence_count(text: Column, language: Column) -> Column:
    """Sentences: Japanese ends at 。！？, other languages where white space follows . ! or ?."""
    t = T.clean(text)
    count = lambda c, p: F.size(F.filter(F.split(c, p), lambda x: F.trim(x) != ""))
    return F.when(F.coalesce(language, F.lit("")) == "ja", count(t, "[。！？]+")).otherwise(count(t, r"(?<=[.!?])\s+"))


def sentences_in_range(items: DataFrame, low: int = MIN_SENTENCES, high: int = MAX_SENTENCES) -> DataFrame:
    """(doc_id, items, in_range): whether every item's tldr has low to high sentences; items: (doc_id, tldr, language)."""
    n = sentence_count(F.col("tldr"), F.col("language"))
    return items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.bool_and(n.between(low, high)).alias("in_range"))


def language_fits(items: DataFrame) -> DataFrame:
    """(doc_id, fits): items in the language asked for; items: (doc_id, title, tldr, language), one language a document.

    English: no Japanese at all, and Latin letters in each. Japanese: at least the share's whole number of items, and one, with Japanese.
    Other languages fit.
    """
    row = F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("tldr", F.lit(""))))
    d = items.select("doc_id", "language", T.has_japanese(row).alias("ja"), row.rlike("[A-Za-z]").alias("latin"))
    g = d.groupBy("doc_id").agg(F.min("language").alias("language"), F.count(F.lit(1)).alias("n"), F.count_if("ja").alias("ja"), F.bool_and("latin").alias("latin"))
    english = (F.col("ja") == 0) & F.col("latin")
    japanese = F.col("ja") >= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(JAPANESE_SHARE)))
    return g.select("doc_id", F.when(F.col("language") == "en", english).when(F.col("language") == "ja", japanese).otherwise(True).alias("fits"))


def normalised_items(items: DataFrame, spans: DataFrame, max_points: int = MAX_POINTS) -> DataFrame:
    """(doc_id, point, title, tldr, start_ds, end_ds) of model items (doc_id, ord, rank, title, tldr, start_ds, end_ds, language).

    spans: (doc_id, low, high), a document's time. Items without a tldr go; times are held to the span. If any item of a document has a
    positive rank, ranked items come first by it. Of items with the same title and tldr, whatever their case, the first stays; then max_points are kept.
    Missing titles become an intro or a numbered topic.
    """
    d = items.join(spans, "doc_id", "left").select(
        "doc_id", "ord", F.when(F.col("rank") > 0, F.col("rank")).alias("rank"), T.clean(F.col("title")).alias("title"), T.clean(F.col("tldr")).alias("tldr"), "language",
        F.coalesce("low", F.lit(0).cast("long")).alias("low"), F.coalesce("high", "low", F.lit(0).cast("long")).alias("high"), "start_ds", "end_ds",
    ).where("tldr <> ''")
    start = F.greatest("low", F.least(F.coalesce("start_ds", "low"), "high"))
    d = d.withColumn("start", start).withColumn("end", F.greatest("start", F.least(F.coalesce("end_ds", "start_ds", "low"), F.greatest("low", "high"))))
    order = [F.col("rank").isNull(), F.coalesce("rank", F.lit(0)), F.col("ord")]
    first = F.row_number().over(Window.partitionBy("doc_id", F.lower("title"), F.lower("tldr")).orderBy(*order))
    d = d.withColumn("copy", first).where("copy = 1")
    d = d.withColumn("point", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("point") <= max_points)
    ja = F.coalesce("language", F.lit("")) != "en"
    blank = F.when(F.col("point") == 1, F.when(ja, "導入").otherwise("Intro")).otherwise(F.concat(F.when(ja, "トピック").otherwise("Topic "), (F.col("point") - 1).cast("string")))
    return d.select("doc_id", F.col("point").cast("long").alias("point"), F.when(F.col("title") == "", blank).otherwise(F.col("title")).alias("title"), "tldr", F.col("start").alias("start_ds"), F.col("end").alias("end_ds"))


def first_lines(window: DataFrame, points: int) -> DataFrame:
    """An extractive stand-in for a model: a window's first lines, each an item without a title."""
    return window.where(F.col("place") <= points).select("doc_id", "window", F.col("place").alias("rank"), F.lit("").alias("title"), F.col("text").alias("tldr"), "start_ds", "end_ds")


def map_reduce(windows: DataFrame, spans: DataFrame, language: DataFrame, model: Callable[[DataFrame, int], DataFrame] = first_lines, map_points: int = MAP_POINTS, max_points: int = MAX_POINTS) -> DataFrame:
    """A summary by windows: the model gives up to map_points items for each, and the merge keeps max_points of a document, in turn from its windows.

    windows: (doc_id, window, place, text, start_ds, end_ds), segments by window and place in it from 1; model(windows, points) gives (doc_id, window, rank,
    title, tldr, start_ds, end_ds). language: (doc_id, language). The result is that of normalised_items, with the number of windows and the strategy.
    """
    mapped = model(windows, map_points).where(F.col("rank") <= map_points)
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "window"))
    items = mapped.withColumn("ord", turn).join(language, "doc_id").select("doc_id", "ord", F.lit(None).cast("int").alias("rank"), "title", "tldr", "start_ds", "end_ds", "language")
    n = windows.groupBy("doc_id").agg(F.countDistinct("window").alias("windows"))
    out = normalised_items(items, spans, max_points).join(n, "doc_id")
    return out.withColumn("strategy", F.when(F.col("windows") > 1, "map_reduce").otherwise("single_pass"))
