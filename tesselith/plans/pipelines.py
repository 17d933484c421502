"""Compositions: retrieval, the agentic loop, staged routing, a curation run, index reconciliation, evaluation reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.operators import answers, curation, metrics, retrieval

MODES = ("dense", "lexical", "hybrid")


def candidate_count(k: int, total: int | None = None) -> tuple[int, int]:
    """k held to 1..12 and the candidates for it: 8k, at least 30, at most all."""
    k = max(1, min(12, int(k)))
    n = max(30, 8 * k)
    return k, n if total is None else min(n, total)


def retrieve(chunks: DataFrame, vectors: DataFrame | None, queries: DataFrame, k: int = 5, mode: str = "hybrid", profile: str = "rrf", feedback: DataFrame | None = None, as_of: str | None = None, score_fn: Callable | None = None, scope: list | None = None) -> DataFrame:
    """(query_id, doc_id, source, score, rank) for a table of queries (query_id, query, terms[, embedding]).

    chunks: (doc_id, source, start, text); vectors: (doc_id, embedding). Candidates are fused, reranked by an injected
    scorer, moved by feedback and diversified. scope limits sources before any statistics; an empty scope finds nothing.
    Without vectors dense search is empty and hybrid passes the lexical side through.
    """
    if mode not in MODES:
        raise ValueError(f"mode: {mode}")
    k, n = candidate_count(k)
    if scope is not None:
        known = {r[0] for r in chunks.select("source").where(F.col("source").isin(scope)).distinct().collect()}
        if unknown := set(scope) - known:
            raise KeyError(f"unknown: {sorted(unknown)}")
        chunks = chunks.where(F.col("source").isin(scope))
    tokens = chunks.select("doc_id", "source", "start", "text", T.lexical_tokens(F.col("text")).alias("tokens"))
    spark = chunks.sparkSession
    lexical = dense = None
    if mode != "dense":
        lexical = retrieval.bm25(tokens.select("doc_id", "tokens"), queries.select("query_id", "terms"), n)
    if mode != "lexical" and vectors is not None:
        v = vectors.join(chunks.select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "vec_id")
        dense = retrieval.dense_topk(v, queries.where("embedding is not null"), n).withColumnRenamed("vec_id", "doc_id")
    none = "query_id long, doc_id long, {} double, rank int"
    lexical = lexical if lexical is not None else spark.createDataFrame([], none.format("lexical_score"))
    dense = dense if dense is not None else spark.createDataFrame([], none.format("dense_score"))
    rows = retrieval.hybrid(dense, lexical, profile, n).select("query_id", "doc_id", "score", "rank")
    if score_fn is not None:
        r = retrieval.reranked(rows.join(queries.select("query_id", "query"), "query_id").join(chunks.select("doc_id", "text"), "doc_id"), score_fn)
        rows = r.select("query_id", "doc_id", F.col("rerank_score").alias("score"), "rank")
    if feedback is not None:
        a = retrieval.feedback_adjustments(rows.join(queries.select("query_id", F.col("terms").alias("query_tokens")), "query_id"), feedback, as_of or "1970-01-01")
        rows = retrieval.feedback_reranked(rows, a).select("query_id", "doc_id", "score", "rank")
    picked = retrieval.diverse(rows.join(tokens.select("doc_id", "source", "start", "tokens"), "doc_id"), k)
    return picked.join(rows.select("query_id", "doc_id", "score"), ["query_id", "doc_id"])


def agentic(question: str, search: Callable[[str, str, int], DataFrame], assess: Callable[[DataFrame], dict], rewrite: Callable[[str], str | None] | None = None, mode: str = "hybrid", k: int = 5, attempts: int = 3) -> dict:
    """Retry until the evidence suffices: reword, switch modes, then widen; the same query and mode is never tried twice.

    search(question, mode, k) gives rows, assess(rows) a dict with sufficient. At most `attempts` searches run; k doubles to 12.
    """
    order = {"hybrid": ("lexical", "dense"), "dense": ("hybrid", "lexical"), "lexical": ("hybrid", "dense")}
    tried: set[tuple[str, str, int]] = set()
    trace: list[dict] = []
    plan: tuple[str, str, int, str] | None = (question.strip(), mode, k, "initial")
    best = None
    while plan and len(trace) < attempts:
        q, m, n, why = plan
        tried.add((q.lower(), m, n))
        rows = search(q, m, n)
        seen = assess(rows)
        trace.append({"query": q, "mode": m, "k": n, "strategy": why, **seen})
        if best is None or (seen.get("sufficient"), seen.get("count", 0)) > (best[1].get("sufficient"), best[1].get("count", 0)):
            best = (rows, seen)
        if seen.get("sufficient"):
            return {"rows": rows, "attempts": trace, "stopped": "sufficient_evidence"}
        reworded = rewrite(q) if rewrite else None
        options = [(reworded.strip(), m, n, "rewrite_query")] if reworded else []
        options += [(q, other, n, "switch_mode") for other in order[m]] + [(q, m, min(12, 2 * n), "broaden_top_k")]
        plan = next((o for o in options if (o[0].lower(), o[1], o[2]) not in tried), None)
    return {"rows": best[0] if best else None, "attempts": trace, "stopped": "max_attempts" if len(trace) >= attempts else "no_new_strategy"}


def routed_retrieval(route: Callable[[int], list], search: Callable[[list | None], DataFrame], assess: Callable[[DataFrame], bool], total: int, k: int = 3) -> dict:
    """Search the k best sources, then max(k + 1, 2k) of them (at most 10), then all, until the evidence suffices."""
    stages = []
    for name, n in (("routed_top_k", min(k, total)), ("expanded", min(max(k + 1, 2 * k), 10, total)), ("global_fallback", None)):
        scope = None if n is None else route(n)
        if scope is not None and (not scope or any(s["scope"] == scope for s in stages)):
            continue
        rows = search(scope)
        stages.append({"stage": name, "scope": scope, "sufficient": assess(rows)})
        if stages[-1]["sufficient"]:
            break
    return {"rows": rows, "stages": stages}


def curate(chunks: DataFrame, path: str, dataset_id: str, version: str, run_id: str, started: str, min_quality_score: float = 0.6, dry_run: bool = False) -> DataFrame:
    """A curation run: manifest, inferences and quality report written under path, and the run's row, which is returned.

    A dry run writes nothing. The manifest is read back for the other artifacts, so chunks are scored once. Rows that can't be read become failed
    inferences, and the run completed_with_errors.
    """
    if not 0 <= min_quality_score <= 1:
        raise ValueError("min_quality_score must be from 0 to 1")
    read = curation.checked(chunks)
    rows = curation.manifest(read.where("error is null").drop("error", "raw_id"), dataset_id, version, run_id, started, min_quality_score)
    failed = curation.failures(read, dataset_id, version, run_id, started)
    if not dry_run:
        rows.write.mode("overwrite").parquet(f"{path}/manifest")
        rows = chunks.sparkSession.read.parquet(f"{path}/manifest")
    report = curation.report(rows).select(F.lit(run_id).alias("pipeline_run_id"), F.lit(dataset_id).alias("dataset_id"), F.lit(version).alias("dataset_version"), "*")
    n_failed = failed.count()
    run = report.select(
        "pipeline_run_id", F.lit("evidence_curation").alias("pipeline_name"), "dataset_id", "dataset_version", (F.col("total_records") + n_failed).alias("input_record_count"), F.col("total_records").alias("output_record_count"),
        F.col("eligible_records").alias("eligible_record_count"), F.col("excluded_records").alias("excluded_record_count"), F.lit(n_failed).alias("failed_record_count"), F.lit("completed_with_errors" if n_failed else "completed").alias("status"), F.lit(started).alias("started_at"),
    )
    if not dry_run:
        curation.inferences(rows).unionByName(failed).write.mode("overwrite").json(f"{path}/inferences")
        report.write.mode("overwrite").json(f"{path}/report")
        run.write.mode("append").json(f"{path}/runs")
    return run


def index_action(stored: dict | None, wanted: dict, vectors: int, chunks: int) -> str:
    """What to do with stored vectors: reuse them, rebuild them, or keep them and search without (a fallback backend must not replace a model's)."""
    if not chunks:
        return "empty"
    if not stored:
        return "rebuild"
    same = all(stored.get(x) == wanted.get(x) for x in ("backend", "model", "dim"))
    if same:
        return "reuse" if vectors == chunks else "rebuild"
    if wanted.get("backend") == "hashing" and stored.get("backend") != "hashing":
        return "preserve_and_disable_dense"
    return "rebuild"


def stale_reasons(manifest: dict | None, current: dict, profiles: dict[str, str], stored_vectors: int) -> list[str]:
    """Why routing profiles no longer fit: keys of the manifest that changed, profiles gone, new or changed, counts that differ."""
    if not manifest:
        return ["manifest_missing"]
    reasons = [f"{k}_changed" for k in ("profile_version", "embedding_backend", "embedding_model", "embedding_dim", "source_fingerprint", "chunking_version") if manifest.get(k) != current.get(k)]
    if manifest.get("profile_fingerprints") != profiles:
        reasons.append("profile_fingerprints_changed")
    if manifest.get("vector_count") != stored_vectors:
        reasons.append("vector_count_changed")
    return reasons


def leaderboard(runs: DataFrame, columns: list[str]) -> str:
    """Runs, of which there are few, as a Markdown table by quality; four decimals, a dash for null."""
    rows = metrics.with_quality(runs).orderBy(F.desc("quality"), "run").collect()
    cell = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = ["run", "quality", *columns]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(cell(r[c]) for c in head) + " |" for r in rows)])


def write_report(runs: DataFrame, scores: DataFrame, path: str) -> None:
    """Per-query scores by run, and the runs."""
    scores.write.mode("overwrite").partitionBy("run").json(f"{path}/per_query")
    runs.write.mode("overwrite").json(f"{path}/results")


def contextual(rows: DataFrame, lines: DataFrame, window_ds: int = 300, first: int = 3) -> DataFrame:
    """Rows (query_id, doc_id, rank, start_ds, end_ds, text) with the first of each query widened to their context; originals kept as retrieval_*."""
    head = rows.where(F.col("rank") <= first).select("doc_id", F.col("start_ds").alias("at_ds"), F.lit(window_ds).cast("long").alias("window_ds")).distinct()
    c = answers.read_context(lines, head).where("status = 'ok'")
    c = c.select("doc_id", F.col("at_ds").alias("start_ds"), F.col("start").alias("cs"), F.col("end").alias("ce"), F.col("text").alias("ct"))
    d = rows.join(c, ["doc_id", "start_ds"], "left").withColumn("wide", (F.col("rank") <= first) & F.col("ct").isNotNull())
    pick = lambda new, old: F.when(F.col("wide"), F.col(new)).otherwise(F.col(old))
    return d.select("query_id", "doc_id", "rank", pick("cs", "start_ds").alias("start_ds"), pick("ce", "end_ds").alias("end_ds"), pick("ct", "text").alias("text"), F.col("start_ds").alias("retrieval_start_ds"), F.col("end_ds").alias("retrieval_end_ds"), F.col("text").alias("retrieval_text"))
