"""Quality scores, eligibility, topics and reports of evidence chunks; rows that can't be read are set apart."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.functions import vocab as V


LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: By ASCII code: whether a letter or digit.
_ALNUM = np.array([chr(c) in LETTERS + DIGITS for c in range(128)])
#: Ranges of Japanese characters, as in V.JAPANESE.
_JAPANESE = [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF)]
#: Texts looked at together.
_STEP = 1000


def _top_chars(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How often the commonest meaningful character occurs in each text, and how many meaningful characters the text has."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    plain = codes < 128
    plain[plain] = _ALNUM[codes[plain]]
    table = np.bincount(row[plain] * 128 + codes[plain], minlength=len(lengths) * 128).reshape(-1, 128)
    top, n = table.max(1, initial=0), table.sum(1)
    other = np.any([(codes >= lo) & (codes <= hi) for lo, hi in _JAPANESE], axis=0)
    if other.any():
        key, count = np.unique((row[other].astype(np.int64) << 32) | codes[other], return_counts=True)
        np.maximum.at(top, key >> 32, count)
        n = n + np.bincount(row[other], minlength=len(lengths))
    return top, n


def _top_char_facts(low: pa.Array) -> pa.Array:
    parts = [_top_chars(pc.fill_null(low.slice(lo, _STEP), "")) for lo in range(0, len(low), _STEP)] or [(np.zeros(0, np.int64),) * 2]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([x[i] for x in parts]), pa.int64()) for i in (0, 1)], ["top", "n"])


def _topic_names(low: pa.Array) -> pa.Array:
    """Keywords are looked for in all texts of a batch at once."""
    low = pc.fill_null(low, "")
    has = lambda w: pc.match_substring(low, w.lower()).to_numpy(zero_copy_only=False)
    flags = np.stack([np.logical_or.reduce([has(w) for w in words]) for words in V.TOPICS.values()] or [np.zeros(len(low), bool)], 1)
    none = ~flags.any(1)
    some = _top_char_facts(low).field("n").to_numpy() > 0 if none.any() else none
    flags = np.column_stack([flags, none & some, none & ~some])
    row, topic = np.nonzero(flags)
    ends = pa.array(np.searchsorted(row, np.arange(len(low) + 1)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array([*V.TOPICS, "general", "unknown"]).take(pa.array(topic)))


def signals(chunks: DataFrame, target_language: Column | None = None) -> DataFrame:
    """chunks (…, text, language, start_sec, end_sec) with cleaned text and its quality signals.

    Characters are counted by what translate() takes away; the commonest one by tables of whole Arrow batches.
    """
    d = T.worked_out(chunks.withColumn("text", T.clean(F.col("text"))))
    t = F.col("text")
    lang = F.lower(F.trim(F.coalesce(target_language if target_language is not None else F.col("language"), F.lit(""))))
    less = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    facts = F.arrow_udf(_top_char_facts, "top long, n long")
    d = d.withColumns({
        "text_length": F.length(t).cast("long"), "latin": less(LETTERS).cast("long"), "digits": less(DIGITS).cast("long"),
        "japanese": F.when(F.length(t) == F.octet_length(t), 0).otherwise(F.regexp_count(t, F.lit(f"[{V.JAPANESE}]"))).cast("long"),
        "chars": facts(F.lower(t)), "target": lang,
    })
    # words are counted where they decide: texts of less than eight characters have no eight words
    words = F.regexp_extract_all(F.lower(t), F.lit(V.WORD), F.lit(0))
    d = d.withColumn("meaningful", F.col("latin") + F.col("digits") + F.col("japanese")).withColumn("w", T.let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))))
    m = F.greatest(F.lit(1), F.col("meaningful")).cast("double")
    ja, la = F.col("japanese") / m, F.col("latin") / m
    d = d.withColumns({
        "has_timestamp": F.coalesce((F.col("start_sec") >= 0) & (F.col("end_sec") > F.col("start_sec")), F.lit(False)),
        "language_matches": F.when(F.col("target") == "", True).when(F.col("target").startswith("ja"), ja >= 0.20).when(F.col("target").startswith("en"), (la >= 0.45) & (ja < 0.20)).otherwise(True),
        "top_char": F.when(F.col("chars.n") == 0, 1.0).otherwise(F.col("chars.top") / F.col("chars.n")), "n_words": F.col("w.n"),
        "unique_ratio": F.when(F.col("chars.n") == 0, 0.0).when(F.col("w.n") == 0, 1.0).otherwise(F.col("w.distinct") / F.col("w.n")),
        "ratio": F.col("meaningful") / F.greatest(F.lit(1), F.col("text_length")).cast("double"),
    })
    some = F.col("chars.n") > 0
    d = d.withColumn("repetitive", some & ((F.col("top_char") >= 0.55) | ((F.col("n_words") >= 8) & (F.col("unique_ratio") <= 0.25))))
    # a text without meaningful characters doesn't pass the repetition test
    return d.withColumn("passes_repetition", some & ~F.col("repetitive")).drop("chars", "w", "digits")


def scored(chunks: DataFrame, min_quality_score: float = 0.6, target_language: Column | None = None) -> DataFrame:
    """signals() with reasons, quality_score, quality_label, included, inclusion_reason and exclusion_reason."""
    d = signals(chunks, target_language)
    c, n = F.col, F.col("text_length")
    empty = c("text") == ""
    reason = lambda cond, name: F.when(cond, name)
    reasons = F.array_compact(F.array(
        reason(~c("has_timestamp"), "missing_timestamp"), reason((c("meaningful") < 12) | (n < 20), "too_short"), reason(n > 4000, "too_long"),
        reason(c("ratio") < 0.35, "mostly_punctuation"), reason(c("meaningful") < 12, "low_meaningful_text"), reason(~c("passes_repetition"), "too_repetitive"), reason(~c("language_matches"), "wrong_language"),
    ))
    score = (
        F.lit(0.15) + F.when((n >= 40) & (n <= 1800), 0.15).otherwise(0.07) + F.when(c("has_timestamp"), 0.15).otherwise(0.0)
        + F.when(c("ratio") >= 0.55, 0.15).when(c("ratio") >= 0.35, 0.07).otherwise(0.0) + F.when(c("meaningful") >= 30, 0.15).when(c("meaningful") >= 12, 0.05).otherwise(0.0)
        + F.when(c("passes_repetition"), 0.15).otherwise(0.0) + F.when(c("language_matches"), 0.10).otherwise(0.0) - F.when(n > 4000, 0.15).otherwise(0.0)
    )
    d = d.withColumn("reasons", F.when(empty, F.array(F.lit("empty_text"))).otherwise(reasons))
    d = d.withColumn("quality_score", F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 4)))))
    q = c("quality_score")
    d = d.withColumn("quality_label", F.when(empty, "invalid").when(q >= 0.80, "high_signal").when(q >= 0.60, "medium_signal").when(q >= 0.30, "low_signal").otherwise("invalid"))
    d = d.withColumn("included", c("quality_label").isin("high_signal", "medium_signal") & (q >= min_quality_score) & (F.size("reasons") == 0))
    why = F.when(c("included"), "").when(F.size("reasons") > 0, F.array_join("reasons", ";")).when(q < min_quality_score, "below_quality_threshold").otherwise("low_quality")
    return d.withColumns({"inclusion_reason": F.when(c("included"), "quality_threshold_met").otherwise(""), "exclusion_reason": why})


def topics(text: Column, cleaned: bool = False) -> Column:
    """Topics of which a keyword occurs in the text, in their order; else general, or unknown without meaningful characters."""
    return F.arrow_udf(_topic_names, "array<string>")(F.lower(text if cleaned else T.clean(text)))


def manifest(chunks: DataFrame, dataset_id: str, dataset_version: str, run_id: str, created_at: str, min_quality_score: float = 0.6) -> DataFrame:
    """A row per chunk (doc_id, chunk_index, title, text, language, start_sec, end_sec)."""
    d = scored(chunks, min_quality_score)
    lit = F.lit
    return d.select(
        lit(dataset_id).alias("dataset_id"), lit(dataset_version).alias("dataset_version"), lit(run_id).alias("pipeline_run_id"),
        F.format_string("%s:%s:%s:transcript:%06d", lit(dataset_id), lit(dataset_version), F.col("doc_id").cast("string"), F.col("chunk_index")).alias("evidence_id"),
        "doc_id", "title", lit("transcript").alias("source_type"), "chunk_index", "start_sec", "end_sec", "text", "language", "text_length",
        T.token_estimate(F.col("text"), F.col("language"), cleaned=True).alias("token_estimate"), "has_timestamp", "quality_score", "quality_label",
        topics(F.col("text"), cleaned=True).alias("topic_tags"), "included", "inclusion_reason", "exclusion_reason", lit(created_at).alias("created_at"), "reasons",
    )


def checked(raw: DataFrame) -> DataFrame:
    """Raw chunks, whose columns may hold text in place of numbers, with their types and `error`: what is wrong with the row, or null.

    A row fails by itself: what can't be read becomes null beside its message, and no other row is touched. Null times are allowed (they are
    missing timestamps), a null id or index isn't. With several faults the first is named.
    """
    number = lambda c, kind: F.expr(f"try_cast({c} as {kind})")
    says = lambda name, c: F.concat(F.lit(f"ValueError: {name} is not a number: "), c.cast("string"))
    doc, index = number("doc_id", "bigint"), number("chunk_index", "bigint")
    faults = [
        F.when(F.col("doc_id").isNull() | F.col("chunk_index").isNull(), "KeyError: doc_id and chunk_index are required"),
        *[F.when(F.col(c).isNotNull() & number(c, kind).isNull(), says(c, F.col(c))) for c, kind in (("doc_id", "bigint"), ("chunk_index", "bigint"), ("start_sec", "double"), ("end_sec", "double"))],
        F.when(index < 0, "ValueError: chunk_index is negative"),
    ]
    return raw.withColumns({"error": F.coalesce(*faults), "raw_id": F.col("doc_id").cast("string"), "doc_id": doc, "chunk_index": index, "start_sec": number("start_sec", "double"), "end_sec": number("end_sec", "double")})


def failures(rows: DataFrame, dataset_id: str, dataset_version: str, run_id: str, created_at: str) -> DataFrame:
    """The inference rows of what checked() found wrong: failed, invalid, without a score, with the message."""
    lit = F.lit
    evidence = F.format_string("%s:%s:%s:transcript:%06d", lit(dataset_id), lit(dataset_version), F.coalesce("raw_id", lit("unknown")), F.coalesce("chunk_index", lit(0)))
    d = rows.where("error is not null").withColumn("evidence_id", evidence)
    return d.select(
        F.concat_ws(":", lit(run_id), "evidence_id").alias("inference_run_id"), lit(run_id).alias("pipeline_run_id"), "evidence_id", lit("transcript").alias("source_type"), lit("heuristic_quality_scorer").alias("model_name"),
        lit("v1").alias("model_version"), lit("heuristic_quality_scoring").alias("inference_type"), lit("failed").alias("status"), lit(0.0).alias("score"),
        lit("invalid").alias("label"), lit("{}").alias("output_json"), lit(False).alias("fallback_used"), F.col("error").alias("error_message"), lit(created_at).alias("created_at"),
    )


def curated(raw: DataFrame, dataset_id: str, dataset_version: str, run_id: str, created_at: str, min_quality_score: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(manifest, inferences) of raw chunks: rows that can't be read are in no manifest, and failed in the inferences."""
    rows = checked(raw)
    good = manifest(rows.where("error is null").drop("error", "raw_id"), dataset_id, dataset_version, run_id, created_at, min_quality_score)
    return good, inferences(good).unionByName(failures(rows, dataset_id, dataset_version, run_id, created_at))


def inferences(rows: DataFrame) -> DataFrame:
    """The scorer's trace of each manifest row, its output as JSON."""
    out = F.to_json(F.struct("quality_score", "quality_label", F.col("included").alias("retrieval_eligible"), "exclusion_reason", "topic_tags", "reasons"))
    lit = F.lit
    return rows.select(
        F.concat_ws(":", "pipeline_run_id", "evidence_id").alias("inference_run_id"), "pipeline_run_id", "evidence_id", "source_type", lit("heuristic_quality_scorer").alias("model_name"),
        lit("v1").alias("model_version"), lit("heuristic_quality_scoring").alias("inference_type"), lit("completed").alias("status"), F.col("quality_score").alias("score"),
        F.col("quality_label").alias("label"), out.alias("output_json"), lit(False).alias("fallback_used"), lit("").alias("error_message"), "created_at",
    )


def report(rows: DataFrame) -> DataFrame:
    """One row: totals, rate, scores and missing fields of a manifest."""
    inc = F.col("included")
    r = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(inc).alias("eligible_records"), F.count_if(~inc).alias("excluded_records"), r(F.count_if(inc) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("eligibility_rate"),
        r(F.avg("quality_score")).alias("avg_quality_score"), r(F.min("quality_score")).alias("min_quality_score"), r(F.max("quality_score")).alias("max_quality_score"),
        F.count_if(~F.col("has_timestamp")).alias("records_missing_timestamp"), F.count_if(F.col("text") == "").alias("records_empty_text"),
    )


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("quality_label").agg(F.count(F.lit(1)).alias("n"))


def topic_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("topic_tags").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def filtered(rows: DataFrame, doc_id=None, quality: str | None = None, included: bool | None = None, topic: str | None = None, text: str | None = None) -> DataFrame:
    """Manifest rows by equality, topic (any case) and a substring of id, title, text or exclusion reason (any case)."""
    rows = T.worked_out(rows)
    if doc_id is not None:
        rows = rows.where(F.col("doc_id") == doc_id)
    if quality:
        rows = rows.where(F.col("quality_label") == quality)
    if included is not None:
        rows = rows.where(F.col("included") == included)
    if topic:
        rows = rows.where(F.array_contains(F.transform("topic_tags", F.lower), topic.lower()))
    if text:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "evidence_id", "title", "text", "exclusion_reason")), F.lit(text.lower())))
    return rows


def browsed(rows: DataFrame, doc_id=None, quality: str | None = None, included: bool | None = None, topic: str | None = None, text: str | None = None) -> DataFrame:
    """What a browser of the manifest shows: equality, a topic as it is written, and a substring (any case) of id, document, title, text, label or topics."""
    rows = filtered(rows, doc_id, quality, included)
    if topic:
        rows = rows.where(F.array_contains("topic_tags", topic))
    if text and text.strip():
        hay = F.concat_ws(" ", "evidence_id", F.col("doc_id").cast("string"), "title", "text", "quality_label", F.array_join("topic_tags", " "))
        rows = rows.where(F.contains(F.lower(hay), F.lit(text.strip().lower())))
    return rows


def inferences_of(rows: DataFrame, evidence_id: str | None = None, run_id: str | None = None) -> DataFrame:
    """Inference rows of an evidence id, a run, both, or all."""
    for c, v in (("evidence_id", evidence_id), ("pipeline_run_id", run_id)):
        if v and v.strip():
            rows = rows.where(F.col(c) == v.strip())
    return rows


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 1000) -> DataFrame:
    """A page of rows in a total order."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))
