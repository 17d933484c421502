"""Readers and writers of JSON stores: libraries of records, JSON lines, feedback, predictions, artifacts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesselith.functions import text as T
from tesselith.operators.retrieval import keep_latest
from tesselith.sources import loose, published

SEGMENT = "struct<start:double,end:double,text:string>"
CHUNK = "struct<start:double,end:double,raw_text:string,embed_text:string>"
RECORD = f"video_id string, url string, title string, language string, source struct<platform:string,video_id:string,url:string,channel:struct<id:string,name:string,url:string>,metadata_provider:string,fetched_at:string>, chunks array<{CHUNK}>, full_transcript struct<version:int,text:string,segments:array<{SEGMENT}>,segment_count:int,char_count:int>, chunking struct<version:string,strategy:string,window_seconds:int,overlap_seconds:int>"


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Records of `path`/videos/<id>/record.json that the manifest `path`/library.json lists; missing files are skipped."""
    manifest = spark.read.json(f"{path}/library.json", multiLine=True, schema="videos array<string>")
    listed = manifest.select(F.explode("videos").alias("video_id"))
    records = spark.read.schema(RECORD).json(f"{path}/videos/*/record.json", multiLine=True)
    return normalised(records).join(listed, "video_id", "left_semi")


def read_single_file(spark: SparkSession, path: str) -> DataFrame:
    """The older layout: one file whose `videos` maps ids to records."""
    inner = RECORD.replace("video_id string, url", "url", 1)
    d = spark.read.json(path, multiLine=True, schema=f"videos map<string,struct<{','.join(_fields(inner))}>>")
    e = d.select(F.explode("videos").alias("video_id", "r"))
    return normalised(e.select("video_id", "r.*"))


def _fields(ddl: str) -> list[str]:
    return [f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields]


def normalised(records: DataFrame) -> DataFrame:
    """Defaults for what a record may lack."""
    return records.withColumns({
        "title": F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Video "), F.col("video_id"))), "language": T.canonical_language(F.col("language")),
        "chunks": F.coalesce("chunks", F.array().cast(f"array<{CHUNK}>")), "url": F.coalesce("url", F.concat(F.lit("https://media.example/watch?v="), F.col("video_id"))),
    })


def chunks_of(records: DataFrame, language: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """A row per chunk. With a language, records of another go; those without one stay. Unknown ids are an error."""
    if ids is not None:
        if unknown := set(ids) - {r[0] for r in records.where(F.col("video_id").isin(ids)).select("video_id").collect()}:
            raise KeyError(f"unknown: {sorted(unknown)}")
        records = records.where(F.col("video_id").isin(ids))
    if language:
        records = records.where((F.coalesce("language", F.lit("")) == "") | (F.col("language") == language))
    d = records.select("video_id", "title", "language", "url", F.posexplode("chunks").alias("chunk_index", "c"))
    return d.select("video_id", "title", "language", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.raw_text").alias("text"), T.timed_url(F.col("url"), F.coalesce("c.start", F.lit(0.0))).alias("url"))


def write_library(records: DataFrame, path: str) -> dict:
    """The library under path brought up to `records`: what is new or changed is written, ids that are gone leave, and readers see it before or after. Returns how many of each.

    A record is unchanged if the hash of all its columns is. Only buckets that hold a change are written.
    """
    spark = records.sparkSession
    now = records.withColumn("record_hash", F.xxhash64(F.to_json(F.struct(*sorted(records.columns)))))
    if published.manifest(spark, path) is None:
        m = published.publish(now, path, ["video_id"])
        return {"written": now.count(), "removed": 0, "generation": m["generation"]}
    have = published.read(spark, path).select("video_id", "record_hash")
    changed, gone = now.join(have, ["video_id", "record_hash"], "left_anti").select(*now.columns), have.join(now, "video_id", "left_anti").select("video_id")
    n, m = (changed.count(), gone.count()), published.manifest(spark, path)
    if any(n):
        m = published.merge(changed, path, ["video_id"], lambda old, new: old.unionByName(new), gone.union(changed.select("video_id")))
    return {"written": n[0], "removed": n[1], "generation": m["generation"]}


def stored_library(spark: SparkSession, path: str) -> DataFrame:
    return published.read(spark, path).drop("record_hash")


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line fails, or, if not strict, is dropped. Paths named twice are read once."""
    paths = list(dict.fromkeys([paths] if isinstance(paths, str) else paths))
    return spark.read.schema(schema).json(paths, mode="FAILFAST" if strict else "DROPMALFORMED")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where("trim(value) <> ''").count()


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.select(*sorted(rows.columns)).write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, lists: tuple[str, ...] = ()) -> None:
    """CSV with a header, quotes doubled; lists joined by bars."""
    rows.withColumns({c: F.array_join(c, "|") for c in lists}).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, ranked) from JSON lines, a JSON array, or an object keyed by query id."""
    fields = "query_id string, ranked_video_ids array<string>"
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    as_list = F.from_json("v", f"array<struct<{','.join(_fields(fields))}>>")
    as_map = F.from_json("v", "map<string,struct<ranked_video_ids:array<string>>>")
    lines = F.transform(F.filter(F.split("v", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, fields))
    keyed = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("query_id"), e["value"]["ranked_video_ids"].alias("ranked_video_ids")))
    several = F.expr("size(filter(split(v, '\n'), x -> trim(x) <> '' and get_json_object(x, '$.query_id') is not null)) > 0")
    rows = F.when(F.substring("v", 1, 1) == "[", as_list).when(several, lines).otherwise(keyed)
    return text.select(F.explode(rows).alias("r")).select("r.query_id", F.col("r.ranked_video_ids").alias("ranked"))


FEEDBACK = "id string, key string, chunk_key string, query string, retrieval_mode string, label string, video_id string, chunk_index bigint, start double, end double, query_tokens array<string>, token_version string, created_at string, updated_at string"


def normalised_feedback(rows: DataFrame, token_version: str = "latin_v1") -> DataFrame:
    """Records with a known label and a key, newest per key; tokens of another version are made again.

    Ties of time, and times that can't be read, go to the later `ord` if there is such a column.
    """
    label = F.lower(F.trim("label"))
    key = F.coalesce("chunk_key", T.chunk_key(F.col("video_id"), F.col("chunk_index"), F.col("start"), F.col("end")))
    mode = F.coalesce("retrieval_mode", F.lit("hybrid"))
    d = rows.withColumns({"label": label, "chunk_key": key, "retrieval_mode": mode}).where(label.isin("relevant", "not_relevant") & (F.trim("chunk_key") != ""))
    d = d.withColumn("key", F.concat_ws(":", "chunk_key", T.query_hash(F.col("query"), F.col("retrieval_mode"))))
    d = d.withColumn("query_tokens", F.when(F.col("token_version") == token_version, F.col("query_tokens")).otherwise(T.lexical_tokens(F.col("query")))).withColumn("token_version", F.lit(token_version))
    when = F.coalesce(T.parsed_time(F.col("updated_at")), T.parsed_time(F.col("created_at")))
    order: list[Column] = [F.desc_nulls_last(when), *([F.desc("ord")] if "ord" in rows.columns else []), F.desc("id")]
    return keep_latest(d, ["key"], order)


def read_feedback(spark: SparkSession, path: str, token_version: str = "latin_v1") -> tuple[DataFrame, DataFrame]:
    """(normalised feedback, entries that can't be read) of a store that is a list, an object by key, or JSON lines; times may stand in timestamp_range."""
    rows = spark.read.text(path, wholetext=True).select(F.lit(0).alias("file"), F.col("value").alias("json"))
    found, bad = loose.records(rows, "label")
    fields = [x.split(" ", 1) for x in FEEDBACK.split(", ")]
    paths = {"start": ("$.start", "$.timestamp_range.start"), "end": ("$.end", "$.timestamp_range.end")}
    d = found.select("ord", *[loose.got("record", kind, *paths.get(name, (f"$.{name}",))).alias(name) for name, kind in fields])
    return normalised_feedback(d, token_version), bad


def upserted(store: DataFrame, incoming: DataFrame, now: str) -> DataFrame:
    """The store with incoming records by key: id and created_at stay, the rest and updated_at are new."""
    old = store.select("key", F.col("id").alias("old_id"), F.col("created_at").alias("old_created"))
    new = incoming.join(old, "key", "left").withColumns({"id": F.coalesce("old_id", "id"), "created_at": F.coalesce("old_created", F.lit(now)), "updated_at": F.lit(now)}).drop("old_id", "old_created")
    return store.join(incoming.select("key"), "key", "left_anti").unionByName(new)


def deleted(store: DataFrame, video_id: str | None = None, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, removed); at least one filter is needed."""
    if not video_id and not label:
        raise ValueError("video_id or label is required")
    hit = F.lit(True)
    if video_id:
        hit = hit & (F.col("video_id") == video_id)
    if label:
        hit = hit & (F.col("label") == label)
    hit = F.coalesce(hit, F.lit(False))
    return store.where(~hit), store.where(hit)


def write_json_object(spark: SparkSession, value: dict, path: str) -> None:
    """One small object, by way of a temporary name, on any file system that Spark writes to."""
    folder, _, name = path.rpartition("/")
    published.write_file(spark, folder, name, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))


def read_config(spark: SparkSession, path: str) -> dict:
    """A run configuration on any file system that Spark reads: JSON, or YAML where a parser for it is installed."""
    folder, _, name = path.rpartition("/")
    raw = published.read_file(spark, folder, name)
    try:
        return json.loads(raw)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: not JSON, and no YAML parser is installed") from e
        return yaml.safe_load(raw)


def caption_segments(payloads: DataFrame) -> DataFrame:
    """(video_id, segments) of caption JSON (events with tStartMs, dDurationMs, segs): seconds, texts joined, blank ones dropped."""
    t = "struct<events:array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>>"
    e = F.filter(F.from_json("payload", t)["events"], lambda x: x["segs"].isNotNull())
    s = F.transform(e, lambda x: F.struct((x["tStartMs"] / 1000.0).alias("start"), ((x["tStartMs"] + F.coalesce(x["dDurationMs"], F.lit(0.0))) / 1000.0).alias("end"), T.clean(F.array_join(F.transform(x["segs"], lambda y: F.coalesce(y["utf8"], F.lit(""))), "")).alias("text")))
    return payloads.select("video_id", F.filter(s, lambda x: x["text"] != "").alias("segments"))
