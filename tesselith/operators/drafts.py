"""What models hand back, made safe: grounded answers, study decks, drafts of evaluation cases, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T

# Card types, generic questions, lengths and shares of the study checks.
CARD_TYPES = ["concept", "detail", "comparison", "application"]
GENERIC_QUESTIONS = ["what key point should you remember", "what should you remember from around", "付近の発言から押さえるべき要点"]
CONCISE_CHARS, CONCISE_SHARE = 360, 0.85
# Kinds of evaluation cases are given by the caller; fewer valid ones than this fail.
MIN_VALID_CASES = 3

_ANSWER = "status string, confidence string, answer string, warnings array<string>, has_conflict boolean, citations array<struct<citation_id:string,reason:string>>"


def normalised_answers(payloads: DataFrame, citations: DataFrame) -> DataFrame:
    """(query_id, status, confidence, answer, citation_ids, n_warnings) of model payloads (query_id, payload JSON).

    Unknown statuses are insufficient, unknown confidences low; citations count once and only if they exist; a conflict makes the
    confidence low; an answer without citations or text is insufficient; citations that its text lacks are appended.
    """
    known = citations.groupBy("query_id").agg(F.collect_set("citation_id").alias("known"))
    d = payloads.join(known, "query_id", "left").withColumn("p", F.from_json("payload", _ANSWER)).withColumn("known", F.expr("coalesce(known, array())"))
    ids = F.expr("array_distinct(filter(transform(coalesce(p.citations, array()), c -> try_cast(c.citation_id as int)), i -> i is not null and array_contains(known, i)))")
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    d = d.withColumns({"ids": ids, "text": F.trim(F.coalesce("p.answer", F.lit(""))), "conflict": F.coalesce("p.has_conflict", F.lit(False))})
    said = low(F.col("p.status")) == "answered"
    answered = said & (F.size("ids") > 0) & (F.col("text") != "")
    confidence = F.when(low(F.col("p.confidence")).isin("high", "medium", "low") & answered & ~F.col("conflict"), low(F.col("p.confidence"))).otherwise("low")
    missing = F.expr("filter(ids, i -> not contains(text, concat('[', cast(i as string), ']')))")
    cited = F.trim(F.concat_ws(" ", "text", F.array_join(F.transform(missing, lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), " ")))
    fallback = "Insufficient transcript evidence to answer confidently from the retrieved excerpts."
    given = F.size(F.filter(F.expr("coalesce(p.warnings, array())"), lambda w: F.trim(w) != ""))
    return d.select(
        "query_id", F.when(answered, "answered").otherwise("insufficient_evidence").alias("status"), confidence.alias("confidence"),
        F.when(answered, cited).when(F.col("text") == "", fallback).otherwise(F.col("text")).alias("answer"), F.array_join("ids", ",").alias("citation_ids"),
        (given + F.col("conflict").cast("int") + (said & (F.size("ids") == 0)).cast("int")).alias("n_warnings"),
    )


def study_quality(cards: DataFrame, by: str = "deck_id", digits: int = 3) -> DataFrame:
    """A row per deck of cards (question, answer, source_cue, card_type, learning_objective, why_it_matters, start, has_evidence): shares, checks passed, score and verdict."""
    text = lambda c: T.clean(F.col(c))
    q = F.lower(text("question"))
    key = F.trim(F.regexp_replace(q, r"[^\p{L}\p{N}_]+", " "))
    d = cards.select(
        by, key.alias("key"), F.col("has_evidence").alias("evidence"), (text("source_cue") != "").alias("cue"), (F.col("has_evidence") & F.col("start").isNotNull()).alias("timed"),
        (F.col("has_evidence") & (text("answer") != "") & (text("source_cue") != "")).alias("answerable"), F.lower(text("card_type")).isin(*CARD_TYPES).alias("typed"),
        (text("learning_objective") != "").alias("objective"), (text("why_it_matters") != "").alias("valued"), (F.length(text("answer")) <= CONCISE_CHARS).alias("concise"),
        (~F.exists(F.array(*[F.lit(x) for x in GENERIC_QUESTIONS]), lambda g: F.contains(q, g))).alias("specific"), (~(q.rlike(r"(^|[^\p{L}\p{N}_])\d{1,2}:\d{2}(:\d{2})?($|[^\p{L}\p{N}_])") | F.contains(q, F.lit("付近")))).alias("untimed"),
    )
    flags = ["evidence", "cue", "timed", "answerable", "typed", "objective", "valued", "concise", "specific", "untimed"]
    g = d.groupBy(by).agg(F.count(F.lit(1)).alias("cards"), F.round(1 - F.count_distinct("key") / F.count(F.lit(1)), digits).alias("duplicate_rate"), *[F.round(F.avg(F.col(f).cast("double")), digits).alias(f"{f}_rate") for f in flags])
    checks = [F.col(f"{f}_rate") >= 1 for f in ("evidence", "timed", "answerable", "typed", "specific", "untimed")]
    checks += [F.col("concise_rate") >= CONCISE_SHARE, (F.col("objective_rate") >= 1) & (F.col("valued_rate") >= 1), F.col("duplicate_rate") <= 0]
    passed = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int"))
    g = g.withColumn("score", F.round(passed / float(len(checks)), digits))
    return g.withColumn("verdict", F.when(F.col("score") >= 1, "pass").otherwise("review"))


def canonical_cases(cases: DataFrame, chunks: DataFrame, case_types: list[str]) -> DataFrame:
    """(draft_id, ord, query, outcome, n_evidence, repeated_type): draft cases (draft_id, ord, query, case_type, facts, evidence array<struct<doc_id,chunk_index>>).

    In order: blank or repeated queries (any case) are omitted, then unknown types, then cases without valid evidence or facts.
    Evidence counts once and only if the chunk (doc_id, chunk_index) exists.
    """
    e = cases.select("draft_id", "ord", F.explode("evidence").alias("e")).select("draft_id", "ord", "e.doc_id", "e.chunk_index").distinct()
    n = e.join(chunks.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_semi").groupBy("draft_id", "ord").agg(F.count(F.lit(1)).alias("n_evidence"))
    d = cases.join(n, ["draft_id", "ord"], "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    d = d.withColumns({"query": T.clean(F.col("query")), "facts": F.filter(F.expr("coalesce(facts, array())"), lambda x: F.trim(x) != "")})
    ok = (F.col("query") != "") & F.col("case_type").isin(*case_types) & (F.col("n_evidence") > 0) & (F.size("facts") > 0)
    first = F.row_number().over(Window.partitionBy("draft_id", F.lower("query"), ok).orderBy("ord")) == 1
    d = d.withColumns({"ok": ok, "first": first})
    # a query counts as seen only once a case with it was taken
    taken = F.min(F.when(F.col("ok") & F.col("first"), F.col("ord"))).over(Window.partitionBy("draft_id", F.lower("query")))
    d = d.withColumn("taken", taken)
    outcome = (
        F.when((F.col("query") == "") | (F.col("ord") > F.col("taken")), "blank_or_duplicate").when(~F.col("case_type").isin(*case_types), "invalid_type").when(~F.col("ok"), "no_evidence_or_facts").otherwise("valid")
    )
    d = d.withColumn("outcome", outcome)
    nth = F.row_number().over(Window.partitionBy("draft_id", "case_type", "outcome").orderBy("ord"))
    return d.select("draft_id", "ord", "query", "outcome", "n_evidence", ((F.col("outcome") == "valid") & (nth > 1)).alias("repeated_type"))


def draft_status(canonical: DataFrame) -> DataFrame:
    """(draft_id, valid, status): insufficient with fewer than three valid cases."""
    g = canonical.groupBy("draft_id").agg(F.count_if(F.col("outcome") == "valid").alias("valid"))
    return g.withColumn("status", F.when(F.col("valid") >= MIN_VALID_CASES, "pending_review").otherwise("insufficient_valid_cases"))


def copied(candidate: Column, texts: Column, least: int = 24) -> Column:
    """Whether a candidate of some length stands word for word in one of the texts."""
    c = T.clean(candidate)
    return (F.length(c) >= least) & F.exists(texts, lambda t: F.contains(T.clean(t), c))


def newest_summary(cache: DataFrame, version: int, fingerprint: Column) -> DataFrame:
    """The newest row per (doc_id, language) of a summary cache with the version and the source's fingerprint; ties to the larger key."""
    d = cache.where((F.col("version") == version) & (F.col("source_fingerprint") == fingerprint))
    return d.groupBy("doc_id", "language").agg(F.max_by("result", F.struct("generated_at", "key")).alias("result"))
