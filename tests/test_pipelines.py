"""Compositions on small tables."""

import pytest
from pyspark.sql import functions as F

from tesselith.plans import pipelines

TEXTS = ["the red fox runs", "a red fox sleeps", "blue whales sing", "the fox and the whale", "red red wine", "nothing at all"]


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame([(i, f"s{i % 2}", float(i * 100), t) for i, t in enumerate(TEXTS)], "doc_id long, source string, start double, text string")
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(6)]) for i in range(6)], "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(100, "red fox", ["red", "fox"], [0.0, 1.0, 0.1, 0.0, 0.0, 0.0]), (101, "zzz", ["zzz"], None)], "query_id long, query string, terms array<string>, embedding array<double>")
    return chunks, vectors, queries


def test_retrieve(spark, tables):
    chunks, vectors, queries = tables
    got = pipelines.retrieve(chunks, vectors, queries, 3).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {100} and got[0].doc_id == 1 and len(got) == 3
    lex = pipelines.retrieve(chunks, None, queries, 2, scope=["s0"]).collect()
    assert {r.source for r in lex} == {"s0"}
    assert pipelines.retrieve(chunks, vectors, queries, 2, scope=[]).count() == 0
    with pytest.raises(KeyError):
        pipelines.retrieve(chunks, vectors, queries, scope=["zz"])
    with pytest.raises(ValueError):
        pipelines.retrieve(chunks, vectors, queries, mode="other")
    up = pipelines.retrieve(chunks, vectors, queries, 3, mode="lexical", score_fn=lambda q, t: [0.9 if "sleeps" in x else 0.1 for x in t]).orderBy("rank").first()
    assert up.doc_id == 1
    votes = spark.createDataFrame([(4, "relevant", ["red", "fox"])], "chunk_id long, label string, query_tokens array<string>").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    moved = pipelines.retrieve(chunks, vectors, queries, 3, feedback=votes, as_of="2024-01-02").orderBy("rank").first()
    assert moved.doc_id == 4


def test_agentic_loop():
    calls = []

    def search(q, m, k):
        calls.append((q, m, k))
        return len(calls)

    out = pipelines.agentic("What is it?", search, lambda rows: {"sufficient": rows == 3, "count": rows}, lambda q: "it" if q != "it" else None)
    assert out["stopped"] == "sufficient_evidence" and [c[:2] for c in calls] == [("What is it?", "hybrid"), ("it", "hybrid"), ("it", "lexical")]
    out = pipelines.agentic("q", lambda q, m, k: 0, lambda rows: {"sufficient": False}, None, k=12)
    assert out["stopped"] == "max_attempts" and len(out["attempts"]) == 3


def test_staged_routing():
    out = pipelines.routed_retrieval(lambda n: list(range(n)), lambda scope: scope, lambda rows: rows is None, 20)
    assert [s["stage"] for s in out["stages"]] == ["routed_top_k", "expanded", "global_fallback"]
    out = pipelines.routed_retrieval(lambda n: list(range(n)), lambda scope: scope, lambda rows: True, 2)
    assert len(out["stages"]) == 1


def test_curation_run(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "t", "The committee reviewed how systems shape the pacing of stories.", "en", 0.0, 5.0), (1, 1, "t", "", "en", 5.0, 9.0)], "doc_id long, chunk_index long, title string, text string, language string, start_sec double, end_sec double")
    assert pipelines.curate(rows, str(tmp_path / "x"), "d", "v", "r", "now", dry_run=True).first().eligible_record_count == 1
    assert not (tmp_path / "x").exists()
    pipelines.curate(rows, str(tmp_path / "x"), "d", "v", "r", "now")
    assert spark.read.json(str(tmp_path / "x/inferences")).count() == 2 and spark.read.json(str(tmp_path / "x/runs")).first().status == "completed"
    raw = spark.createDataFrame([("1", "0", "t", "The committee reviewed how systems shape the pacing of stories.", "en", "0", "5.0"), ("1", "1", "t", "x", "en", "soon", None), ("x", "2", "t", "x", "en", None, None), (None, "3", "t", "x", "en", None, None), ("2", "-1", "t", "x", "en", "1", "2"), ("2", "4", "t", None, None, None, None)], "doc_id string, chunk_index string, title string, text string, language string, start_sec string, end_sec string")
    run = pipelines.curate(raw, str(tmp_path / "y"), "d", "v", "r", "now").first()
    assert (run.status, run.input_record_count, run.output_record_count, run.failed_record_count) == ("completed_with_errors", 6, 2, 4)
    bad = {r.evidence_id: r.error_message for r in spark.read.json(str(tmp_path / "y/inferences")).where("status = 'failed'").collect()}
    assert bad == {"d:v:1:transcript:000001": "ValueError: start_sec is not a number: soon", "d:v:x:transcript:000002": "ValueError: doc_id is not a number: x", "d:v:unknown:transcript:000003": "KeyError: doc_id and chunk_index are required", "d:v:2:transcript:-00001": "ValueError: chunk_index is negative"}
    with pytest.raises(ValueError):
        pipelines.curate(rows, "x", "d", "v", "r", "now", min_quality_score=2)


def test_index_and_staleness():
    a, h = {"backend": "model", "model": "m", "dim": 8}, {"backend": "hashing", "model": "h", "dim": 8}
    assert [pipelines.index_action(*x) for x in ((None, a, 0, 5), (a, a, 5, 5), (a, a, 4, 5), (a, h, 5, 5), (h, a, 5, 5), (a, a, 0, 0))] == ["rebuild", "reuse", "rebuild", "preserve_and_disable_dense", "rebuild", "empty"]
    m = {"profile_version": 2, "profile_fingerprints": {"a": "1"}, "vector_count": 3}
    assert pipelines.stale_reasons(m, {"profile_version": 2}, {"a": "1"}, 3) == []
    assert pipelines.stale_reasons(m, {"profile_version": 3}, {"a": "2"}, 4) == ["profile_version_changed", "profile_fingerprints_changed", "vector_count_changed"]
    assert pipelines.stale_reasons(None, {}, {}, 0) == ["manifest_missing"]


def test_leaderboard_and_context(spark):
    runs = spark.createDataFrame([("a", 0.5, 0.5, 0.5, 10.0, 0), ("b", 1.0, 1.0, 1.0, 5.0, 1)], "run string, r_5 double, mrr double, ndcg double, p95_latency_ms double, failed_query_count long")
    text = pipelines.leaderboard(runs, ["mrr", "selected"])
    assert text.splitlines()[2].startswith("| b | 1.0000 | 1.0000 | False") and "| a | 0.5000 | 0.5000 | True" in text
    lines = spark.createDataFrame([(1, [(0, 100, "x"), (100, 200, "y"), (900, 990, "z")])], "doc_id long, lines array<struct<start_ds:long,end_ds:long,text:string>>")
    rows = spark.createDataFrame([(7, 1, 1, 100, 200, "y"), (7, 1, 4, 900, 990, "z")], "query_id long, doc_id long, rank int, start_ds long, end_ds long, text string")
    got = {r["rank"]: r for r in pipelines.contextual(rows, lines).collect()}
    assert got[1].text == "x\ny" and got[1].retrieval_text == "y" and got[1].start_ds == 0 and got[4].text == "z"
