"""Compositions about an injected model, the new operators' edges, and artifacts."""

import json

import pytest
from pyspark.sql import functions as F

from tesselith.operators import evaluation, library, review, study, summaries
from tesselith.plans import services as S


def cite(n):
    return [{"citation_id": i + 1, "title": "T", "label": "0:00", "url": "u", "text": "alpha"} for i in range(n)]


def test_ask():
    calls = []

    def model(prompt):
        calls.append(prompt)
        return 'Sure: {"status": "answered", "confidence": "high", "answer": "Yes [1]", "warnings": ["w"]}'

    keep = lambda reply, c: reply
    assert S.ask("q", [], {"sufficient": True}, model, keep)["warnings"] == ["no_results"]
    weak = S.ask("q", cite(1), {"sufficient": False, "warnings": ["low_score"]}, model, keep, "ja")
    assert weak["status"] == "insufficient_evidence" and weak["warnings"] == ["low_score"] and not calls
    good = S.ask("q", cite(2), {"sufficient": True, "warnings": ["w"], "confidence_cap": "medium"}, model, keep)
    assert good["confidence"] == "medium" and good["warnings"] == ["w"] and "[2] T (0:00) u" in calls[0]
    assert S.ask("q", cite(1), {"sufficient": True}, lambda p: "no json", keep)["status"] == "error"
    assert S.ask("q", cite(1), {"sufficient": True}, lambda p: 1 / 0, keep)["warnings"] == ["division by zero"]
    assert S.simple_ask("q", " ", model) == S.INSUFFICIENT["en"] and S.simple_ask("q", "c", lambda p: f" {p} ") == "Context:\nc\n\nQuestion: q"


def test_best_effort():
    assert S.best_effort(lambda: {"results": [1]})["results"] == [1]
    out = S.best_effort(lambda: 1 / 0, "router_unavailable")
    assert out["fallback_reason"] == "router_unavailable" and out["results"] == [] and out["latency_ms"] >= 0


def test_query_variants(spark):
    def translate(q, own, targets):
        if q == "bad":
            raise ValueError
        return {t: f"{t}:{q}" for t in targets if t != "fr"}

    q = spark.createDataFrame([(1, "hello", "en"), (2, "bad", "ja")], "query_id long, query string, language string")
    langs = spark.createDataFrame([("en",), ("ja",), ("fr",), (None,)], "language string")
    got = sorted(tuple(r) for r in S.query_variants(q, langs, translate).collect())
    assert got == sorted([
        (1, "en", "hello", "en", "original"), (1, "fr", "hello", "en", "untranslated_fallback"), (1, "ja", "ja:hello", "ja", "translated"),
        (2, "ja", "bad", "ja", "original"), (2, "en", "bad", "ja", "untranslated_fallback"), (2, "fr", "bad", "ja", "untranslated_fallback"),
    ])


def items(n, sentences=4):
    return [{"title": f"T{i}", "tldr": " ".join(f"Point {i} part {j}." for j in range(sentences))} for i in range(n)]


def test_summaries_with_a_model():
    reply = lambda x: json.dumps({"items": x})
    lines = ["one line of the transcript, long enough"]
    assert S.generated("p", lines, "en", lambda p: reply(items(5)))[1] == 1
    assert "copy" in S.faults([{"title": "x", "tldr": lines[0]}], lines, "en") and "language" in S.faults(items(1), lines, "ja")
    tries = iter(["junk", reply(items(4)), reply(items(5))])
    assert S.generated("p", lines, "en", lambda p: next(tries))[1] == 3
    with pytest.raises(S.SummaryError):
        S.generated("p", lines, "en", lambda p: reply(items(4)))
    assert S.generated("p", lines, "en", lambda p: reply(items(5, 9)), rewrite=lambda x: items(5))[0] == items(5)
    assert S.summarised(lines, [], "en", lambda p: reply(items(5, 6))) == {"items": items(5, 6), "strategy": "single_pass", "relaxed": True}
    long = [f"line {i} " + "x" * 100 for i in range(200)]
    windows = [long[:100], long[100:]]
    by_windows = lambda p: reply(items(5)) if p.startswith('{"items"') else reply(items(3))
    assert S.summarised(long, [], "en", lambda p: reply(items(5)))["strategy"] == "compact_single_pass"
    assert S.summarised(long, windows, "en", by_windows)["strategy"] == "map_reduce"


def test_cache(tmp_path):
    c = S.ResultCache(str(tmp_path / "c"))
    assert c.get("v/1", "k", "f") is None
    c.put("v/1", "k", "f", {"a": 1}, "now")
    assert c.get("v/1", "k", "f") == {"a": 1} and c.get("v/1", "k", "other") is None and S.ResultCache(str(tmp_path / "c"), 3).get("v/1", "k", "f") is None
    next((tmp_path / "c").glob("*.json")).write_text("{")
    assert c.get("v/1", "k", "f") is None


def test_evaluated():
    def retrieve(case):
        if case["id"] == 2:
            raise KeyError("x")
        return {"results": [1, 2], "details": {"reranker": {"applied": case["id"] != 3}}}

    out = S.evaluated("r", [{"id": 1}, {"id": 2}, {"id": 3}], retrieve, lambda c, r: {"mrr": c["id"] / 4}, 3, "ce")
    assert out["metrics"] == {"mrr": 0.5} and out["failed_query_count"] == 1 and out["reranker_applied"] is False and len(out["failures"]) == 2
    assert S.evaluated("r", [], retrieve, lambda c, r: {})["metrics"] == {}


def test_datasets(tmp_path):
    case = lambda i, d: {"id": i, "language": "en", "query": f"q{i}", "query_type": "fact", "difficulty": "easy", "required_facts": [], "case_type": "fact", "gold_evidence": [{"video_id": "v", "chunk_index": 1, "start": 0, "end": 1, "text": "t"}], "review": {"decision": d}}
    for cases, error in (([case(1, "pending")], "REVIEW_INCOMPLETE"), ([case(1, "rejected")], "NO_APPROVED_CASES")):
        with pytest.raises(ValueError, match=error):
            S.finalised({"cases": cases}, "d", "t")
    d = S.finalised({"cases": [case(1, "approved"), case(2, "rejected"), case(3, "edited")]}, "dataset_a", "2024")
    assert [r["id"] for r in d["rows"]] == [1, 3] and "text" not in d["rows"][0]["gold_evidence"][0] and d["query_set"]["language"] == "en"
    S.written_dataset(d, str(tmp_path))
    S.written_dataset(d | {"dataset_id": "dataset_b", "created_at": "2025"}, str(tmp_path))
    (tmp_path / "dataset_c.json").write_text("{")
    assert [x["dataset_id"] for x in S.listed_datasets(str(tmp_path))] == ["dataset_b", "dataset_a"] and S.listed_datasets(str(tmp_path / "no")) == []
    assert '"query": "q"' in S.review_prompt([{"review_item_id": 1, "query": "q"}], "a reviewer")


def test_router_and_index(spark, tmp_path):
    p = spark.createDataFrame([(1, "over", [(0, 10, "a"), (10, 20, "b")]), (2, "", [])], "doc_id long, overview string, sections array<struct<start_ds:long,end_ds:long,text:string>>")
    embed = lambda d: d.withColumn("embedding", F.array(F.length("text").cast("double"), F.lit(1.0)))
    v = S.built_router(p, str(tmp_path / "r"), embed, {"model": "hash"})
    assert sorted((r.doc_id, r.vector_type, r.section) for r in v.collect()) == [(1, "overview", -1), (1, "section", 0), (1, "section", 1)]
    m = spark.read.json(str(tmp_path / "r/manifest")).first()
    assert (m["vector_count"], m["document_count"], json.loads(m["settings"])) == (3, 1, {"model": "hash"})
    chunks = spark.createDataFrame([(1, 0, "abc")], "doc_id long, chunk_index long, text string")
    assert library.index_vectors(chunks, str(tmp_path / "i"), embed, 2).count() == 1
    assert library.usable_index(spark, str(tmp_path / "i"), 2).count() == 1
    assert library.usable_index(spark, str(tmp_path / "i"), 3) is None and library.usable_index(spark, str(tmp_path / "no"), 2) is None


def test_empty_and_null_lines(spark):
    schema = "doc_id long, lines array<struct<start_ds:bigint,end_ds:bigint,text:string>>"
    d = spark.createDataFrame([(1, []), (2, None), (3, [(5, 1, " a \n b "), (0, None, "z"), (0, 2, "  ")])], schema)
    got = {r.doc_id: [(x.start_ds, x.end_ds, x.text) for x in r.segments] for r in summaries.summary_segments(d).collect()}
    assert got == {1: [], 2: [], 3: [(0, 0, "z"), (5, 5, "a b")]}
    assert [r.line for r in summaries.prompt_lines(d).orderBy("n").collect()] == ["[0001] 0:00-0:00 z", "[0002] 0:00-0:00 a b"]
    assert evaluation.budgeted_chunks(d, 10).count() == 2 and study.evidence_rows(d, 1).count() == 1
    assert evaluation.budgeted_chunks(d, 0).count() == 1


def test_marks_of_small_operators(spark):
    x = spark.createDataFrame([("https://a/b?x=1&fmt=srv#t",), ("https://a/b",)], "u string")
    assert [r[0] for r in x.select(library.json3_url(F.col("u"))).collect()] == ["https://a/b?x=1&fmt=json3#t", "https://a/b?fmt=json3"]
    assert spark.range(1).select(library.frame_times(F.lit(0.0), 5), library.frame_times(F.lit(11.9), 5)).first()[:] == ([0], [0, 5, 10])
    with pytest.raises(ValueError):
        library.frame_times(F.lit(1.0), 0)
    y = spark.createDataFrame([(" JA ",), ("",), (None,), ("de",)], "l string")
    assert [r[0] for r in y.select(library.known_language(F.col("l"))).collect()] == ["ja", "ja", "ja", "ja"]
    s = spark.createDataFrame([("fallback",), ("data_api",), (None,)], "provider string")
    assert library.backfill_candidates(s).count() == 2 and library.backfill_candidates(s, True).count() == 3
    assert spark.range(1).select(study.sentences(F.lit("はい。とても長い文章がここにあります、そして続く。")).alias("s")).first().s == ["とても長い文章がここにあります、そして続く"]
    assert review.histogram(s.withColumnRenamed("provider", "p"), "p").count() == 3
