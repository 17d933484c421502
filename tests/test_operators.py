"""Facts about operators that the driver's tables don't show: Japanese, edges, stores, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.operators import answers, chunking, curation, embedding, metrics, retrieval, review
from tesselith.sources import records
from tesselith.streaming import events


def one(spark, expr, **cols):
    d = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in cols.items()))
    return d.select(expr.alias("x")).first().x


def test_cleaning_and_tokens(spark):
    c = F.col("t")
    assert one(spark, T.clean(c), t="  a　b\r\n c\t") == "a b c"
    assert one(spark, T.clean(c), t=None) == ""
    assert one(spark, T.lexical_tokens(c), t="日本 AI") == ["日本", "本a", "ai", "日本", "ai"]
    assert one(spark, T.lexical_tokens(c), t="東") == ["東", "東"]
    assert one(spark, T.lexical_tokens(c), t="Hello, World_1") == ["hello", "world_1"]
    assert one(spark, T.lexical_tokens(c), t="  ") == []
    assert one(spark, T.english_tokens(c), t="The Café, isn't it?") == ["café", "isn", "t"]
    assert one(spark, T.routing_tokens(c), t="AI と 日本 AI") == ["ai", "と日", "日本"]
    assert one(spark, T.inferred_language(c), t="カナ") == "ja"


def test_rewrite_and_tool(spark):
    c = F.col("t")
    assert one(spark, T.query_rewrite(c), t="What is the capital of France?") == "capital france"
    assert one(spark, T.query_rewrite(c), t="capital france") is None
    assert one(spark, T.query_rewrite(c), t="what is it") is None
    assert one(spark, T.query_rewrite(c), t="魔法とは何ですか？") == "魔法"
    assert one(spark, T.initial_tool(c), t="plain words") == "semantic_search"
    for t in ("see 42", "the API", "「引用」", 'a "quote"'):
        assert one(spark, T.initial_tool(c), t=t) == "keyword_search"


def test_clocks_and_ids(spark):
    c = F.col("t")
    assert [one(spark, f(c), t=3725.9) for f in (T.hhmmss, T.clock, T.padded_clock, T.minutes_clock)] == ["01:02:05", "1:02:05", "01:02:05", "62:05"]
    assert one(spark, T.clock(c), t=-4.0) == "0:00" and one(spark, T.padded_clock(c), t=65.0) == "01:05"
    assert one(spark, T.media_id(c), t="https://www.youtube.com/watch?v=abcdefghijk&t=3") == "abcdefghijk"
    assert one(spark, T.media_id(c), t="https://youtu.be/abcdefghijk") == "abcdefghijk" and one(spark, T.media_id(c), t="nothing here") is None
    assert one(spark, T.snippet(c, 5), t="abcd  efgh") == "abcd…"
    assert one(spark, T.token_estimate(c, F.lit("ja")), t="日本語です") == 3
    assert one(spark, T.token_estimate(c, F.lit("en")), t="...!") == 1


def test_json_recovery():
    assert T.recovered_json('text ```json\n{"a": 1}\n``` more') == {"a": 1}
    assert T.recovered_json('so: {"a": [1, 2]} done') == {"a": [1, 2]}
    assert T.recovered_json("none") is None
    assert T.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def lines_of(spark, docs):
    rows = [(i, [(int(s * 10), int(e * 10), t) for s, e, t in ls]) for i, ls in docs.items()]
    return spark.createDataFrame(rows, "doc_id long, lines array<struct<start_ds:long,end_ds:long,text:string>>")


def test_chunking(spark):
    five = lines_of(spark, {1: [(i * 5, i * 5 + 5, f"line {i}.") for i in range(12)], 2: [], 3: [(7, 9, "only")]})
    t = chunking.by_time(five, 20, 5).orderBy("doc_id", "chunk_index").collect()
    assert [(r.start_ds, r.end_ds) for r in t if r.doc_id == 1] == [(0, 200), (150, 350), (300, 500), (450, 600)]
    assert [r.raw_text for r in t if r.doc_id == 3] == ["only"]
    with pytest.raises(ValueError):
        chunking.by_time(five, 20, 20)
    s = chunking.by_sentence(lines_of(spark, {1: [(0, 1, "aaaa"), (1, 2, "bb。"), (2, 3, "cccc"), (3, 4, "dddddd")]}), 10).collect()
    assert [r.raw_text for r in s] == ["aaaa bb。", "cccc dddddd"]
    k = chunking.by_tokens(lines_of(spark, {1: [(i, i + 1, "a b c") for i in range(6)], 2: [(0, 1, "。")]}), 5, 0.2).orderBy("chunk_index").collect()
    assert [(r.first_ord, r.n_lines) for r in k] == [(0, 2), (1, 2), (2, 3), (4, 2), (5, 1)]
    assert chunking.chunked(five, "time", window=1, overlap=99).count() > 0
    with pytest.raises(ValueError):
        chunking.chunked(five, "other")


def test_token_chunks_against_a_loop(spark):
    r = random.Random(3)
    docs = {i: [(j, j + 1, " ".join("w" for _ in range(r.randrange(5)))) for j in range(r.randrange(1, 15))] for i in range(30)}
    got = {}
    for x in chunking.by_tokens(lines_of(spark, docs), 7, 0.3).collect():
        got[x.doc_id, x.chunk_index] = (x.first_ord, x.n_lines)
    want = {}
    for i, ls in docs.items():
        bounds, total = [], 0
        for _, _, t in ls:
            bounds.append((total, total + len(t.split())))
            total = bounds[-1][1]
        pos = n = 0
        while pos < total:
            end = min(pos + 7, total)
            hit = [j for j, (a, b) in enumerate(bounds) if b > pos and a < end]
            want[i, n] = (hit[0], hit[-1] - hit[0] + 1)
            if end >= total:
                break
            pos, n = pos + 5, n + 1
    assert got == want


def test_curation(spark):
    good = "The committee reviewed how magic systems shape the pacing of long stories."
    rows = [(1, 0, "t", good, "en", 0.0, 5.0), (1, 1, "t", "", "en", 5.0, 9.0), (1, 2, "t", good, "en", None, None), (1, 3, "t", "ああああああああああああああああああああああ", "ja", 0.0, 5.0), (1, 4, "t", good, "ja", 0.0, 5.0)]
    m = curation.manifest(spark.createDataFrame(rows, "doc_id long, chunk_index long, title string, text string, language string, start_sec double, end_sec double"), "d", "v", "r", "now")
    x = {r.chunk_index: r for r in m.collect()}
    assert x[0].included and x[0].quality_score == 1.0 and x[0].inclusion_reason == "quality_threshold_met"
    assert x[1].exclusion_reason == "empty_text" and x[1].quality_label == "invalid" and x[1].topic_tags == ["unknown"]
    assert x[2].exclusion_reason == "missing_timestamp" and "too_repetitive" in x[3].exclusion_reason
    assert x[4].exclusion_reason == "wrong_language" and x[0].evidence_id == "d:v:1:transcript:000000"
    rep = curation.report(m).first()
    assert (rep.total_records, rep.eligible_records, rep.records_empty_text, rep.records_missing_timestamp) == (5, 1, 1, 1)
    assert curation.report(m.limit(0)).first().eligibility_rate == 0.0
    assert [r.chunk_index for r in curation.filtered(m, included=True, text="MAGIC").collect()] == [0]


def test_interval_gold_is_used_once(spark):
    r = [(1, 5, None, 0.0, 10.0, 1), (1, 5, None, 2.0, 4.0, 2), (1, 5, None, 12.0, 11.0, 3), (1, 6, 2, 0.0, 0.0, 4)]
    g = [(1, 0, 5, None, 3.0, 5.0), (1, 1, 5, None, 10.5, 12.0), (1, 2, 6, 2, 50.0, 60.0), (1, 3, 6, 3, 0.0, 1.0)]
    res = spark.createDataFrame(r, "query_id long, doc_id long, chunk_index long, start double, end double, rank int")
    gold = spark.createDataFrame(g, "query_id long, gold_id long, doc_id long, chunk_index long, start double, end double")
    x = metrics.interval_scores(res, gold, 10).first()
    assert x.recall == 0.75


def test_diversity_backfill(spark):
    rows = [(1, i, "a", float(i), [f"t{i}"], i) for i in range(1, 6)] + [(1, 10, "b", 0.0, ["z"], 6)]
    d = spark.createDataFrame(rows, "query_id long, doc_id long, source string, start double, tokens array<string>, rank int")
    got = [r.doc_id for r in retrieval.diverse(d, 4).orderBy("rank").collect()]
    assert got == [1, 10, 2, 3]


def test_rerank_squeezes_the_tail(spark):
    d = spark.createDataFrame([(1, i, "q", f"t{i}", 1.0 / i, i) for i in range(1, 6)], "query_id long, doc_id long, query string, text string, score double, rank int")
    got = {r.doc_id: r.rerank_score for r in retrieval.reranked(d, lambda q, t: [float(len(x)) * (3.0 if x == "t2" else -1.0) for x in t], top=3).collect()}
    assert got[2] > got[1] >= got[3] > got[4] > got[5] > 0


def test_hybrid_falls_back(spark):
    den = spark.createDataFrame([(1, 1, 0.9, 1)], "query_id long, doc_id long, dense_score double, rank int")
    lex = spark.createDataFrame([(1, 1, 3.0, 1), (2, 1, 2.0, 1)], "query_id long, doc_id long, lexical_score double, rank int")
    got = {r.query_id: (r.fallback, r.score) for r in retrieval.hybrid(den, lex).collect()}
    assert got[2] == (True, 2.0) and got[1][0] is False and abs(got[1][1] - 2 / 61) < 1e-6


def test_assessment_reasons(spark):
    def reason(rows, mode="lexical"):
        d = spark.createDataFrame([(1, k, ["a", "b", "c"], toks, de, le) for k, toks, de, le in rows], "query_id long, rank int, query_tokens array<string>, row_tokens array<string>, dense_score double, lexical_score double")
        return answers.assessed(d, mode).first().reason_code

    full = ["a", "b", "c"]
    assert reason([(1, full, None, 2.0), (2, full, None, 2.0)]) == "multi_chunk_support"
    assert reason([(1, full, None, 2.0), (5, [], None, 0.1)]) == "strong_single_chunk"
    assert reason([(1, [], None, 1.0)]) == "single_weak_chunk"
    assert reason([(1, [], None, 1.0), (2, [], None, 0.1)]) == "thin_support"


def test_cross_lingual_rows_use_the_dense_score(spark):
    d = spark.createDataFrame([(1, k, ["a"], ["日本"], 0.9, None, "ja") for k in (1, 2)], "query_id long, rank int, query_tokens array<string>, row_tokens array<string>, dense_score double, lexical_score double, language string")
    assert answers.assessed(d, "dense", F.lit("en")).first().sufficient
    assert not answers.assessed(d, "dense").first().sufficient


def test_confidence_cap(spark):
    d = spark.createDataFrame([("high", "medium"), ("low", "high"), ("odd", "high")], "a string, b string")
    assert [r.x for r in d.select(answers.capped_confidence(F.col("a"), F.col("b")).alias("x")).collect()] == ["medium", "low", "low"]


def test_shards_and_positions(spark):
    d = spark.createDataFrame([("b", i) for i in range(12)], "batch string, item_id long")
    over = spark.createDataFrame([("b", 0), ("b", 11)], "batch string, item_id long")
    got = {(r.shard, r.item_id, r.role) for r in review.review_shards(d, "batch", [F.asc("item_id")], over, 5).collect()}
    assert (2, 0, "overlap") in got and (1, 11, "overlap") in got and len(got) == 14
    assert review.sampled_positions(20) == sorted(random.Random(7).sample(range(20), 3))
    pos = lambda n, c: spark.range(1).select(review.even_positions(F.lit(n), F.lit(c)).alias("x")).first().x
    assert (pos(10, 4), pos(3, 6), pos(9, 1), pos(0, 5)) == ([0, 3, 6, 9], [0, 1, 2], [4], [])


def test_hash_embedding_counts_characters(spark):
    a, b, c = (embedding.hash_vector(t, 128) for t in ("abc", "cab", "abd"))
    assert a == b and a != c and abs(sum(x * x for x in a) - 1) < 1e-9 and embedding.hash_vector("", 128) == [0.0] * 128
    got = embedding.hash_embeddings(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string"), 128).collect()
    assert list(got[0].embedding) == a


def test_stores(spark, tmp_path):
    for v in ("a1", "b2"):
        (tmp_path / "lib/videos" / v).mkdir(parents=True)
        (tmp_path / "lib/videos" / v / "record.json").write_text(json.dumps({"video_id": v, "title": "", "language": "ja_JP", "chunks": [{"start": 61.5, "end": 70.0, "raw_text": "x"}]}))
    (tmp_path / "lib/library.json").write_text(json.dumps({"videos": ["a1", "gone"]}))
    lib = records.read_library(spark, str(tmp_path / "lib"))
    r = records.chunks_of(lib).collect()
    assert [(x.video_id, x.title, x.language, x.chunk_index) for x in r] == [("a1", "Video a1", "ja", 0)] and r[0].url.endswith("&t=61s")
    with pytest.raises(KeyError):
        records.chunks_of(lib, ids=["zz"])
    (tmp_path / "old.json").write_text(json.dumps({"videos": {"c3": {"title": "T", "language": "en", "chunks": []}}}))
    assert records.read_single_file(spark, str(tmp_path / "old.json")).first().video_id == "c3"
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbad\n{"a": 2}\n')
    assert records.count_lines(spark, str(tmp_path / "x.jsonl")) == 3
    assert records.read_jsonl(spark, [str(tmp_path / "x.jsonl")] * 2, "a int", strict=False).count() == 2
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    for name, body in (("l", '{"query_id": "q", "ranked_video_ids": ["v"]}\n{"query_id": "p", "ranked_video_ids": []}'), ("a", '[{"query_id": "q", "ranked_video_ids": ["v"]}, {"query_id": "p", "ranked_video_ids": []}]'), ("m", '{"q": {"ranked_video_ids": ["v"]}, "p": {"ranked_video_ids": []}}')):
        (tmp_path / f"{name}.json").write_text(body)
        assert {x.query_id: list(x.ranked) for x in records.read_predictions(spark, str(tmp_path / f"{name}.json")).collect()} == {"q": ["v"], "p": []}


def test_feedback_store(spark):
    base = ("id string, key string, chunk_key string, query string, retrieval_mode string, label string, video_id string, chunk_index bigint, start double, end double, query_tokens array<string>, token_version string, created_at string, updated_at string, ord int")
    row = lambda i, label, at, o: (f"i{i}", None, "v:1", "What  Now", "hybrid", label, "v", 1, 0.0, 1.0, ["stale"], "old", at, at, o)
    d = spark.createDataFrame([row(1, "relevant", "2024-01-01T00:00:00Z", 0), row(2, "not_relevant", "2024-02-01T00:00:00Z", 1), row(3, "unclear", "2025-01-01T00:00:00Z", 2), row(4, "relevant", "bad", 3)], base)
    got = records.normalised_feedback(d).collect()
    assert [(r.id, r.query_tokens) for r in got] == [("i2", ["what", "now"])]
    store = records.normalised_feedback(d)
    again = records.upserted(store, store.withColumn("label", F.lit("relevant")).withColumn("id", F.lit("new")), "2024-03-01T00:00:00Z").collect()
    assert [(r.id, r.label, r.created_at[:7], r.updated_at[:7]) for r in again] == [("i2", "relevant", "2024-02", "2024-03")]
    kept, gone = records.deleted(store, label="not_relevant")
    assert (kept.count(), gone.count()) == (0, 1)
    with pytest.raises(ValueError):
        records.deleted(store)


def test_captions(spark):
    p = json.dumps({"events": [{"tStartMs": 1500, "dDurationMs": 500, "segs": [{"utf8": "a "}, {"utf8": "b"}]}, {"tStartMs": 2000}, {"tStartMs": 3000, "segs": [{"utf8": "\n"}]}]})
    s = records.caption_segments(spark.createDataFrame([("v", p)], "video_id string, payload string")).first().segments
    assert [(x.start, x.end, x.text) for x in s] == [(1.5, 2.0, "a b")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:0{i}:00", "level": "info", "event": "e", "job_id": f"j{i % 2}", "message": str(i)}) for i in range(4)) + "\nbad\n")
    run = lambda: events.keep_newest(events.log_stream(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "c"), ["job_id"], "ts").awaitTermination()
    run()
    assert {r.job_id: r.message for r in events.current(spark, str(tmp_path / "t")).collect()} == {"j0": "2", "j1": "3"}
    (src / "2.json").write_text(json.dumps({"ts": "2024-01-01T00:09:00", "level": "info", "event": "e", "job_id": "j0", "message": "9"}) + "\n" + json.dumps({"ts": "2023-01-01T00:00:00", "level": "info", "event": "e", "job_id": "j1", "message": "late"}))
    run()
    assert {r.job_id: r.message for r in events.current(spark, str(tmp_path / "t")).collect()} == {"j0": "9", "j1": "3"}


def test_percentiles_are_exact(spark, monkeypatch):
    """Against numpy: ties, few values, one group that holds most rows, brackets of a few ranks, nulls."""
    import numpy as np

    from tesselith.operators import metrics

    g = np.random.default_rng(4)
    groups = {"hot": np.r_[np.full(4000, 7.0), g.normal(size=9000) * 100], "ties": g.integers(0, 3, 500).astype(float), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "few": g.normal(size=37)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("few", None)]
    d = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = {"low": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "top": 1.0}
    for bracket, accuracy in ((metrics.BRACKET, metrics.ACCURACY), (0.05, 100)):
        monkeypatch.setattr(metrics, "BRACKET", bracket)
        monkeypatch.setattr(metrics, "ACCURACY", accuracy)
        got = {r.k: r for r in metrics.percentiles(d, "k", "v", shares).collect()}
        for k, vs in groups.items():
            for name, q in shares.items():
                assert abs(got[k][name] - np.percentile(vs, 100 * q)) < 1e-6, (k, name)
        assert got["none"].p50 is None and len(got) == 6


def test_tokens_take_time_by_their_length(spark):
    """As many characters in ten times longer texts take about as long: nothing is quadratic."""
    import time

    from pyspark.sql import functions as F

    from tesselith.functions import text as T

    def seconds(n, rows):
        d = spark.range(rows).select(F.concat(F.lit("あ"), F.repeat(F.concat(F.lit("いろは ab"), F.col("id").cast("string")), n // 7)).alias("t")).coalesce(1)
        took = []
        for _ in range(3):
            start = time.perf_counter()
            d.select(F.size(T.lexical_tokens(F.col("t"))), F.size(T.routing_tokens(F.col("t")))).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(60_000, 10) < 4 * seconds(3_000, 200) + 0.5
    got = spark.createDataFrame([("東京都 x",), ("あ",), ("",), (None,), ("😀あ",)], "t string").select(T.lexical_tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [["東京", "京都", "都x", "東京都", "x"], ["あ", "あ"], [], [], ["😀あ", "😀あ"]]


def test_characters_and_topics_of_batches(spark):
    """The commonest meaningful character, and topics, against a count in Python."""
    import random
    from collections import Counter

    from pyspark.sql import functions as F

    from tesselith.functions import vocab as V
    from tesselith.operators import curation

    r = random.Random(8)
    texts = ["".join(r.choice("aAbB1 .,é東あ漫画Ω😀") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", None, "...", "The API of the Company", "aaaa" * 4000, "マンガの企業"]
    d = spark.createDataFrame([(i, t, "en", 0.0, 1.0) for i, t in enumerate(texts)], "i long, text string, language string, start_sec double, end_sec double").repartition(2)
    good = lambda c: ("a" <= c <= "z") or ("A" <= c <= "Z") or ("0" <= c <= "9") or any(lo <= ord(c) <= hi for lo, hi in curation._JAPANESE)
    for x in curation.signals(d).withColumn("topics", curation.topics(F.col("text"), cleaned=True)).collect():
        text = " ".join((texts[x.i] or "").split())
        n = Counter(c for c in text.lower() if good(c))
        assert x.meaningful == sum(map(good, text)) and abs(x.top_char - (max(n.values()) / sum(n.values()) if n else 1.0)) < 1e-12
        found = [t for t, ws in V.TOPICS.items() if any(w.lower() in text.lower() for w in ws)]
        assert x.topics == (found or (["general"] if n else ["unknown"]))
