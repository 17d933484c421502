"""The library: listings, what to take in, caption tracks, playlists, frames and their text, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.operators.retrieval import ranked

# The id of a video in a playlist's page; prefixes of an embedding model's family.
PLAYLIST_ID = '"videoId":"([a-zA-Z0-9_-]{11})"'
FAMILY, QUERY_PREFIX, PASSAGE_PREFIX = "e5", "query: ", "passage: "


def listing(records: DataFrame, history: DataFrame, current_version: str) -> DataFrame:
    """(doc_id, title, language, num_chunks, chunking_version, chunking_stale, ask_history_count, last_ask_at) for each record.

    records: (doc_id, title, language, chunks array, chunking_version); history: (doc_id, created_at). Null versions are unknown and stale.
    """
    asked = history.groupBy("doc_id").agg(F.count(F.lit(1)).alias("ask_history_count"), F.max("created_at").alias("last_ask_at"))
    version = F.coalesce("chunking_version", F.lit("unknown"))
    d = records.join(asked, "doc_id", "left")
    return d.select("doc_id", F.coalesce("title", F.concat(F.lit("Video "), F.col("doc_id").cast("string"))).alias("title"), F.coalesce("language", F.lit("ja")).alias("language"), F.greatest(F.size("chunks"), F.lit(0)).cast("long").alias("num_chunks"), version.alias("chunking_version"), (version != current_version).alias("chunking_stale"), F.coalesce("ask_history_count", F.lit(0)).alias("ask_history_count"), "last_ask_at")


def ingest_plan(targets: DataFrame, stored: DataFrame, current_version: str, force: bool = False) -> DataFrame:
    """(doc_id, action): what to do with each target: created, skipped (already there), or taken in again (forced or cut by another version).

    targets: (doc_id), each taken once; stored: (doc_id, chunking_version).
    """
    d = targets.select("doc_id").distinct().join(stored.select("doc_id", F.coalesce("chunking_version", F.lit("unknown")).alias("v"), F.lit(True).alias("known")), "doc_id", "left")
    return d.select("doc_id", F.when(F.col("known").isNull(), "created").when(F.lit(force), "reingest_forced").when(F.col("v") != current_version, "reingest_stale").otherwise("already_indexed").alias("action"))


def backfill_candidates(sources: DataFrame, force: bool = False) -> DataFrame:
    """Sources whose metadata is to be fetched anew: those from a fallback or of old, or all if forced."""
    return sources if force else sources.where(F.coalesce("provider", F.lit("legacy")).isin("fallback", "legacy"))


def caption_track(tracks: DataFrame, preferred: list[str]) -> DataFrame:
    """(doc_id, ord, code): the track of the first preferred code; else the first whose code starts with a preferred primary tag, in that order; else the first.

    tracks: (doc_id, ord, code).
    """
    code = F.coalesce("code", F.lit(""))
    exact = F.coalesce(*[F.when(code == c, F.lit(i)) for i, c in enumerate(preferred)], F.lit(None).cast("int"))
    near = F.coalesce(*[F.when(F.startswith(code, F.lit(c.split("-")[0])), F.lit(i)) for i, c in enumerate(preferred)], F.lit(None).cast("int"))
    kind = F.when(exact.isNotNull(), 0).when(near.isNotNull(), 1).otherwise(2)
    best = F.min(F.struct(kind.alias("kind"), F.coalesce(exact, near, F.lit(0)).alias("at"), F.col("ord"), F.col("code")))
    return tracks.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.ord", "b.code")


def playlist_ids(html: Column, pattern: str = PLAYLIST_ID) -> Column:
    """Ids on a page in the order of their first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1)))


def json3_url(url: Column) -> Column:
    """The URL with fmt=json3 in its query: in the place of another fmt, or at the end."""
    base, query, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    is_fmt = lambda x: F.split_part(x, F.lit("="), F.lit(1)) == "fmt"
    new = F.when(F.exists(parts, is_fmt), F.transform(parts, lambda x: F.when(is_fmt(x), F.lit("fmt=json3")).otherwise(x))).otherwise(F.concat(parts, F.array(F.lit("fmt=json3"))))
    return F.concat(base, F.lit("?"), F.array_join(F.array_distinct(new), "&"), tail)


def frame_times(duration: Column, interval: int) -> Column:
    """Seconds at which frames are taken: 0, then every interval up to the whole seconds of the duration; 0 alone without one."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    return F.when(F.coalesce(duration, F.lit(0.0)) <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.floor(duration).cast("long"), F.lit(interval).cast("long")))


def finite(value: Column) -> Column:
    """A number, if the text is a finite one; else null."""
    x = F.expr("0D") + value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def frame_text(items: DataFrame) -> DataFrame:
    """(doc_id, frame, id, text, confidence): recognised texts of a frame joined by line feeds, with the mean of their numeric confidences.

    items: (doc_id, frame, ord, text, confidence string). Blank texts count for nothing; frames without text are left out.
    """
    d = items.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text <> ''")
    g = d.groupBy("doc_id", "frame").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"), F.avg(finite(F.col("confidence"))).alias("confidence"))
    return g.select("doc_id", "frame", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("frame").cast("string"), F.lit("ocr")).alias("id"), F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"), "confidence")


def dominant_language(rows: DataFrame, by: str) -> DataFrame:
    """(by, language, n): the commonest language of each group; of equals the one that sorts first. A null language is Japanese."""
    g = rows.groupBy(by, F.coalesce("language", F.lit("ja")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return ranked(g, by, [F.desc("n"), F.asc("language")], 1).drop("rank")


def result_language(results: DataFrame) -> DataFrame:
    """(query_id, language): the commonest language among a query's results (query_id, rank, language); of equals the one met first."""
    g = results.groupBy("query_id", F.coalesce("language", F.lit("ja")).alias("language")).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    return ranked(g, "query_id", [F.desc("n"), F.asc("first")], 1).select("query_id", "language")


def known_language(value: Column, known: tuple[str, ...] = ("ja", "en"), fallback: str = "ja") -> Column:
    low = F.lower(F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit(fallback))))
    return F.when(low.isin(*known), low).otherwise(fallback)


def query_text(query: Column, language: Column, model: str = "", known: tuple[str, ...] = ("ja", "en")) -> Column:
    """What a query is embedded as: the model family's prefix, the cleaned query, and its tokens on a line of their own if its language is known."""
    prefix = QUERY_PREFIX if FAMILY in model.lower() else ""
    q = T.clean(query)
    tokens = F.when(language == "ja", F.array_join(T.lexical_tokens(q, language), " ")).otherwise(F.array_join(T.english_tokens(q), " "))
    return F.when(language.isin(*known), F.concat(F.lit(prefix), q, F.lit("\n"), tokens)).otherwise(F.concat(F.lit(prefix), q))


def passage_text(raw: Column, model: str = "") -> Column:
    return F.concat(F.lit(PASSAGE_PREFIX if FAMILY in model.lower() else ""), F.coalesce(raw, F.lit("")))


def run_id(at: Column, key: Column) -> Column:
    """A run's stamp: UTC time and 8 hex digits of a key's hash, so that a run made again has the same id."""
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.substring(F.sha2(key, 256), 1, 8))


def merged_logs(logs: list[DataFrame], limit: int = 200, level: str | None = None, since: str | None = None) -> DataFrame:
    """Log lines of several files, newest first, at most `limit`, held to 1..5000: a page, which is the feature. Lines of one time follow each other by their content."""
    rows = logs[0]
    for other in logs[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    if level:
        rows = rows.where(F.lower("level") == level.strip().lower())
    if since:
        rows = rows.where(F.col("ts") >= since)
    return rows.orderBy(F.desc("ts"), *[F.asc(c) for c in sorted(rows.columns)]).limit(max(1, min(int(limit), 5000)))


def index_vectors(chunks: DataFrame, path: str, embed, dimension: int) -> DataFrame:
    """The vector index as a table under path: (doc_id, chunk_index, embedding) with a manifest of dimension and count beside it; returns the table read back.

    embed(chunks) gives the rows with `embedding`. An empty index has a manifest too.
    """
    spark = chunks.sparkSession
    embed(chunks).select("doc_id", "chunk_index", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    out = spark.read.parquet(f"{path}/vectors")
    out.agg(F.count(F.lit(1)).alias("vectors"), F.lit(dimension).alias("dimension")).write.mode("overwrite").json(f"{path}/manifest")
    return out


def usable_index(spark, path: str, dimension: int) -> DataFrame | None:
    """The table of an index, or None if its manifest says another dimension, another number of vectors, or isn't there."""
    try:
        m = spark.read.json(f"{path}/manifest").first()
        vectors = spark.read.parquet(f"{path}/vectors")
    except Exception:  # noqa: BLE001  no index there
        return None
    return vectors if m and m["dimension"] == dimension and vectors.count() == m["vectors"] else None


def chunk_count(records: DataFrame, scope: list | None = None) -> DataFrame:
    """One row: how many chunks the records (doc_id, chunks) in scope have, all without a scope; 0 without any."""
    if scope is not None:
        records = records.where(F.col("doc_id").isin(scope))
    return records.agg(F.coalesce(F.sum(F.size(F.coalesce("chunks", F.array().cast(records.schema["chunks"].dataType)))), F.lit(0)).cast("long").alias("chunks"))


def latest_first(rows: DataFrame, by: str, time: str, key: str) -> DataFrame:
    """rows with `place` in their group, newest first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(time), F.asc(key))))
