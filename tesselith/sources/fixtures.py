"""Fixture corpora: one JSON text of videos with segments, chunks and scores written down per query, read into long tables with a table of what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T

SCHEMA = (
    "name string, videos array<struct<video_id:string,title:string,language:string,url:string,transcript_segments:array<struct<start:double,end:double,text:string>>,"
    "chunks:array<struct<start:double,end:double,text:string,embed_text:string,semantic_terms:array<string>,dense_scores:map<string,double>>>>>"
)


def corpus(texts: DataFrame) -> dict[str, DataFrame]:
    """Tables videos, segments, chunks, dense_scores and problems of corpora (corpus, json), a row a corpus.

    Titles, urls, languages, ends of chunks and texts to embed have the defaults that a library has; blank segments are left out. Problems name the corpus, the place and what is wrong: a corpus that isn't
    JSON or has no videos, a video without an id (left out) or with another's (the first stands), a chunk without text, and a score that isn't a number or is written for a blank query (left out).
    """
    d = texts.select("corpus", F.from_json("json", SCHEMA).alias("c")).select("corpus", F.col("c.videos").alias("vs"))
    # by id and place, so that the first of an id is known within the row
    ids = F.array_sort(F.transform("vs", lambda v, i: F.struct(F.trim(v["video_id"]).alias("video_id"), i.alias("place"))))
    placed = T.let(ids, lambda s: F.transform(s, lambda x, i: F.struct(x["place"].alias("place"), x["video_id"].alias("video_id"), (~F.equal_null(F.get(s, i - 1)["video_id"], x["video_id"]) | (i == 0)).alias("first"), F.get("vs", x["place"]).alias("v"))))
    d = d.select("corpus", F.coalesce(F.size("vs"), F.lit(-1)).alias("n"), F.explode_outer(placed).alias("x")).select("corpus", "n", "x.place", "x.video_id", "x.first", "x.v")
    named = F.coalesce("video_id", F.lit("")) != ""
    good = d.where(named & F.col("first"))
    videos = good.select(
        "corpus", "video_id", F.coalesce(F.nullif("v.title", F.lit("")), F.concat(F.lit("Video "), "video_id")).alias("title"), F.coalesce(F.nullif("v.url", F.lit("")), F.concat(F.lit("https://media.example/watch?v="), "video_id")).alias("url"),
        F.coalesce(F.nullif("v.language", F.lit("")), F.lit("ja")).alias("language"), F.coalesce(F.size("v.chunks"), F.lit(0)).alias("n_chunks"),
    )
    zero = F.lit(0.0)
    s = good.select("corpus", "video_id", F.posexplode("v.transcript_segments").alias("at", "s")).where("trim(s.text) <> ''")
    order = F.row_number().over(Window.partitionBy("corpus", "video_id").orderBy("at")) - 1
    segments = s.select("corpus", "video_id", order.cast("long").alias("ord"), F.coalesce("s.start", zero).alias("start"), F.coalesce("s.end", "s.start", zero).alias("end"), F.trim("s.text").alias("text"))
    c = good.select("corpus", "video_id", F.posexplode("v.chunks").alias("chunk_index", "k"))
    text = F.coalesce("k.text", F.lit(""))
    chunks = c.select("corpus", "video_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.coalesce("k.start", zero).alias("start"), F.coalesce("k.end", "k.start", zero).alias("end"), text.alias("text"), F.coalesce(F.nullif("k.embed_text", F.lit("")), text).alias("embed_text"), F.coalesce("k.semantic_terms", F.array().cast("array<string>")).alias("semantic_terms"))
    e = c.select("corpus", "video_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.explode("k.dense_scores").alias("query", "score"))
    fine = F.col("score").isNotNull() & ~F.isnan("score") & (F.trim("query") != "")
    at = lambda *parts: F.concat_ws(":", *parts)
    say = lambda rows, place, text: rows.select("corpus", place.alias("place"), F.lit(text).alias("problem"))
    problems = [
        say(d.where("n <= 0"), F.lit(""), "no videos"), say(d.where(F.col("v").isNotNull() & ~named), F.col("place").cast("string"), "no video_id"),
        say(d.where(named & ~F.col("first")), F.col("place").cast("string"), "video_id repeated"),
        say(chunks.where("trim(text) = ''"), at("video_id", "chunk_index"), "chunk without text"), say(e.where(~fine), at("video_id", "chunk_index"), "score not usable"),
    ]
    wrong = problems[0]
    for p in problems[1:]:
        wrong = wrong.union(p)
    return {"videos": videos, "segments": segments, "chunks": chunks, "dense_scores": e.where(fine), "problems": wrong}


def read_corpora(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """corpus() of the files under path, each named by its file."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("corpus"), F.col("value").alias("json"))
    return corpus(rows)
