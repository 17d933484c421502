"""The routing index: identity, overview and section vectors of sources, refreshed by fingerprint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.sources import published
from tesselith.sources.scratch import written

#: Changed documents whose ids are sent to every task; with more, both sides are shuffled.
FEW = 500_000
#: Version of the profiles' form: another one makes all vectors again.
PROFILE_VERSION = 1


def with_fingerprints(profiles: DataFrame) -> DataFrame:
    """profiles (doc_id, title, language, url, channel, chunking_version, overview, sections) with fingerprint: the hash of all that vectors are made of."""
    parts = F.to_json(F.struct(F.lit(PROFILE_VERSION).alias("profile_version"), "doc_id", "title", "language", "url", "channel", "chunking_version", "overview", "sections"), {"ignoreNullFields": "false"})
    return profiles.withColumn("fingerprint", F.sha2(parts, 256))


def vector_texts(profiles: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, vector_type, section, start_ds, end_ds, text): what a source is found by. The channel stands in the identity alone."""
    channel = F.when(F.trim(F.coalesce("channel", F.lit(""))) != "", F.concat(F.lit("Channel: "), "channel"))
    identity = F.concat_ws("\n", F.concat(F.lit("Video title: "), "title"), channel, F.lit("Source: media"), F.concat(F.lit("URL: "), "url"), F.concat(F.lit("Video ID: "), F.col("doc_id").cast("string")))
    none = F.lit(None).cast("long")
    whole = lambda kind, text: F.struct(F.lit(kind).alias("vector_type"), F.lit(-1).alias("section"), none.alias("start_ds"), none.alias("end_ds"), text.alias("text"))
    label = lambda x: F.concat(F.lit("Transcript section ["), T.padded_clock(x["start_ds"] / 10.0), F.lit("-"), T.padded_clock(x["end_ds"] / 10.0), F.lit("]: "), x["text"])
    sections = F.transform("sections", lambda x: F.struct(F.lit("section").alias("vector_type"), x["idx"].cast("int").alias("section"), x["start_ds"].alias("start_ds"), x["end_ds"].alias("end_ds"), label(x).alias("text")))
    rows = F.concat(F.array(whole("identity", identity), whole("overview", F.concat(F.lit("Video overview: "), "overview"))), sections)
    return profiles.select("doc_id", "fingerprint", F.inline(rows))


def refreshed(profiles: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], settings: dict, buckets: int = published.BUCKETS) -> dict:
    """The index under path brought up to `profiles`; returns what was done: built, embedded (documents), kept and removed.

    Documents whose fingerprint the store holds keep their vectors; new and changed ones are embedded, gone ones leave. Only buckets with such documents are written, and readers see the index before
    or after, whole. Other settings (the embedding's name, its dimension) make all vectors again. embed adds `embedding` to rows with `text`.
    """
    spark = profiles.sparkSession
    now = with_fingerprints(profiles.where("doc_id is not null"))
    m = published.manifest(spark, path)
    if m is None or m["facts"].get("settings") != settings:
        documents = now.count()
        published.publish(embed(vector_texts(now)), path, ["doc_id"], buckets, {"settings": settings, "documents": documents})
        return {"built": True, "embedded": documents, "kept": 0, "removed": 0}
    have = published.read(spark, path).where("vector_type = 'identity'").select("doc_id", "fingerprint")
    # by ids alone: profiles are the bulk of the work
    ids = written(now.select("doc_id", "fingerprint").join(have, ["doc_id", "fingerprint"], "left_anti").select("doc_id").distinct(), "router-changed")
    removed = written(have.join(now, "doc_id", "left_anti").select("doc_id").distinct(), "router-removed")
    n_changed, n_removed, n_now = ids.count(), removed.count(), now.count()
    if n_changed or n_removed:
        changed = now.join(F.broadcast(ids) if n_changed <= FEW else ids, "doc_id", "left_semi")
        stale = removed.union(ids)
        published.merge(embed(vector_texts(changed)), path, ["doc_id"], lambda old, new: old.unionByName(new), stale, facts={"settings": settings, "documents": n_now})
    return {"built": False, "embedded": n_changed, "kept": n_now - n_changed, "removed": n_removed}
