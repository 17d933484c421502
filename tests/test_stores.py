"""Published stores, the router's refresh, job states as stream and batch, loose JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tesselith.operators import answers, router, segmenter
from tesselith.sources import adapters, connector, fixtures, loose, published, records
from tesselith.streaming import jobs


def test_readers_see_a_store_before_or_after(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = lambda pairs: spark.createDataFrame(pairs, "k long, v string")
    got = lambda d: {r.k: r.v for r in d.collect()}
    newer = lambda old, new: old.join(new, "k", "left_anti").select("k", "v").unionByName(new)
    with pytest.raises(FileNotFoundError):
        published.read(spark, path)
    published.publish(rows([(i, "a") for i in range(40)]), path, ["k"], 8)
    reader = published.read(spark, path)
    before = published.manifest(spark, path)
    m = published.merge(rows([(3, "b"), (100, "b")]), path, ["k"], newer, gone=rows([(5, "")]))
    # the reader's files are still there, and only touched buckets are new
    assert got(reader) == {i: "a" for i in range(40)}
    assert 1 <= sum(before["buckets"].get(b) != g for b, g in m["buckets"].items()) <= 3
    now = {i: "a" for i in range(40) if i != 5} | {3: "b", 100: "b"}
    assert got(published.read(spark, path)) == now and got(published.read(spark, path, before["generation"])) == {i: "a" for i in range(40)}
    # an attempt that broke off wrote files but no manifest
    rows([(1, "broken")]).write.parquet(f"{path}/data/g000000009/bucket=1")
    assert got(published.read(spark, path)) == now
    # a batch that runs again is merged once
    published.merge(rows([(7, "c")]), path, ["k"], newer, generation=3)
    published.merge(rows([(7, "other")]), path, ["k"], newer, generation=3)
    assert got(published.read(spark, path))[7] == "c"
    published.prune(spark, path, keep=1)  # files that the newest manifest names stay
    assert got(published.read(spark, path)) == now | {7: "c"} and published.generations(spark, path) == [3]
    published.publish(rows([]), path, ["k"], 8)
    assert 3 in published.prune(spark, path, keep=1) and got(published.read(spark, path)) == {}


def test_library_is_written_where_it_changed(spark, tmp_path):
    path = str(tmp_path / "lib")
    lib = lambda pairs: spark.createDataFrame(pairs, "video_id string, title string")
    assert records.write_library(lib([("a", "1"), ("b", "1"), ("c", "1")]), path)["written"] == 3
    out = records.write_library(lib([("a", "1"), ("b", "2"), ("d", "1")]), path)
    assert (out["written"], out["removed"]) == (2, 1)
    assert {tuple(r) for r in records.stored_library(spark, path).collect()} == {("a", "1"), ("b", "2"), ("d", "1")}
    assert records.write_library(records.stored_library(spark, path), path)["generation"] == out["generation"]
    records.write_json_object(spark, {"b": 1, "a": "é"}, f"{path}/one.json")
    records.write_json_object(spark, {"b": 2, "a": "é"}, f"{path}/one.json")
    assert records.read_config(spark, f"{path}/one.json") == {"a": "é", "b": 2} and not list((tmp_path / "lib").glob("*.tmp"))


def profile_rows(spark, rows):
    kind = "doc_id long, title string, language string, url string, channel string, chunking_version string, overview string, sections array<struct<idx:int,start_ds:bigint,end_ds:bigint,text:string>>"
    return spark.createDataFrame([(i, t, "en", f"u{i}", c, "v1", f"about {t}", [(0, 0, 650, "one"), (1, 650, 36000, "two")]) for i, t, c in rows], kind)


def test_router_embeds_what_changed(spark, tmp_path):
    path, seen = str(tmp_path / "r"), spark.sparkContext.accumulator(0)

    def embed(rows):
        def count(t):
            seen.add(1)
            return [float(len(t))]

        return rows.withColumn("embedding", F.udf(count, "array<double>")("text"))

    first = profile_rows(spark, [(1, "A", "ch"), (2, "B", None), (3, "C", "")])
    assert router.refreshed(first, path, embed, {"model": "m"}, 4) == {"built": True, "embedded": 3, "kept": 0, "removed": 0}
    texts = {(r.doc_id, r.vector_type, r.section): r.text for r in published.read(spark, path).collect()}
    assert texts[1, "identity", -1] == "Video title: A\nChannel: ch\nSource: media\nURL: u1\nVideo ID: 1" and "Channel" not in texts[2, "identity", -1] + texts[3, "identity", -1]
    assert texts[1, "overview", -1] == "Video overview: about A" and texts[1, "section", 1] == "Transcript section [01:05-01:00:00]: two" and len(texts) == 12
    made = seen.value
    assert router.refreshed(first, path, embed, {"model": "m"}) == {"built": False, "embedded": 0, "kept": 3, "removed": 0} and seen.value == made
    second = profile_rows(spark, [(1, "A", "ch"), (2, "B2", None), (4, "D", None)])
    assert router.refreshed(second, path, embed, {"model": "m"}) == {"built": False, "embedded": 2, "kept": 1, "removed": 1} and seen.value == made + 8
    now = published.read(spark, path)
    assert {r.doc_id for r in now.collect()} == {1, 2, 4} and now.count() == 12 and now.where("doc_id = 2 and text like '%B2%'").count() == 2
    assert router.refreshed(second, path, embed, {"model": "other"})["built"]


def test_job_states_as_stream_and_batch(spark, tmp_path):
    """A stream that stops after each file and comes back from its checkpoint ends with the batch's states."""
    r, t, events = random.Random(3), 1_704_067_200, []
    for n in range(240):
        t += r.choice([5, 60, 400])
        events.append((r.randrange(30), t, n, r.choice(["queued", "queued", "running", "completed", "failed", "odd"])))
    events.append((99, t + 100_000, 1000, "queued"))  # the watermark passes all limits
    schema, src = "job_id long, ts timestamp, event_id long, status string", tmp_path / "in"
    src.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, part in enumerate((events[:120], events[120:], [(98, t + 100_001, 1001, "queued")])):
            text = [json.dumps({"job_id": j, "ts": f"{at}", "event_id": n, "status": s}) for j, at, n, s in part]
            (src / f"{i}.json").write_text("\n".join(text).replace('"ts": "', '"ts": "@'))
            stream = spark.readStream.schema("job_id long, ts string, event_id long, status string").json(str(src)).withColumn("ts", F.timestamp_seconds(F.substring("ts", 2, 20).cast("long")))
            out = jobs.job_stream(stream, 9000, "1 minute").writeStream.foreachBatch(lambda b, n, i=i: b.withColumn("n", F.lit(i * 1000 + n)).write.mode("append").parquet(str(tmp_path / "out")))
            out.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(str(tmp_path / "out")).where("job_id < 90").orderBy("n").collect()
    last = {x.job_id: (x.status, x.reason, x.changed_at, x.applied, x.rejected) for x in rows}
    e = spark.createDataFrame([(j, at, n, s) for j, at, n, s in events if j < 90] + [(None, 1, 1, "queued")], "job_id long, ts long, event_id long, status string").withColumn("ts", F.timestamp_seconds("ts"))
    want = {x.job_id: (x.status, x.reason, x.changed_at, x.applied, x.rejected) for x in jobs.job_states(e, 9000, "2024-03-01").collect()}
    assert last == want and {x[0] for x in want.values()} >= {"completed", "failed"} and any(x[1] == "stalled" for x in want.values())
    # by hand, in order
    for j in want:
        state = ("", "", None, 0, 0, 0)
        for _, at, n, s in (x for x in events if x[0] == j):
            state = jobs.step(state, at * 1_000_000, n, s, 9000)
        if state[0] in ("queued", "running"):
            state = ("failed", "stalled", *state[2:])
        assert (state[0] or "unknown", state[1], state[4], state[5]) == (want[j][0], want[j][1], want[j][3], want[j][4])
    assert jobs.job_states(e.limit(0), 900, "2024-03-01").count() == 0


def test_loose_json(spark, tmp_path):
    rows = [
        (1, '[{"id": "a", "n": 1}, {"id": "b"}, 5, null]'), (2, '{"a": {"n": 1}, "b": {"n": "2"}, "c": [1]}'), (3, '{"id": "a", "n": 3}'), (4, '{"id": "a"}\n\n{"id": "b"}\n{"id": "c'),
        (5, "not json"), (6, ""), (7, None), (8, '"text"'), (9, '{\n "id": "a",\n "n": 9\n}'), (10, "[]"), (11, '{"id": "a"}\n[{"id": "b"}, {"id": "c"}]'),
    ]
    found, bad = loose.records(spark.createDataFrame(rows, "f long, json string"), "id")
    got = sorted((r.f, r.ord >> 32, r.ord & 0xFFFFFFFF, r.i or r.key, r.n) for r in found.select("f", "ord", "key", loose.got("record", "string", "$.id").alias("i"), loose.got("record", "int", "$.n", "$.m").alias("n")).collect())
    assert got == [(1, 0, 0, "a", 1), (1, 0, 1, "b", None), (2, 0, 0, "a", 1), (2, 0, 1, "b", 2), (3, 0, 0, "a", 3), (4, 0, 0, "a", None), (4, 1, 0, "b", None), (9, 0, 0, "a", 9), (11, 0, 0, "a", None), (11, 1, 0, "b", None), (11, 1, 1, "c", None)]
    assert sorted((r.f, r.json) for r in bad.collect()) == [(1, "5"), (1, "null"), (2, "[1]"), (4, '{"id": "c'), (5, "not json"), (8, '"text"')]
    one = {"id": "1", "chunk_key": "v:1", "query": "red fox", "label": "Relevant", "video_id": "v", "timestamp_range": {"start": 2.5}, "updated_at": "2024-01-01T00:00:00Z"}
    for i, text in enumerate((json.dumps([one, {"label": "odd"}]), json.dumps({"k": one}), json.dumps(one) + "\nbroken")):
        p = tmp_path / f"{i}.json"
        p.write_text(text)
        good, unread = records.read_feedback(spark, str(p))
        assert [(r.id, r.label, r.start, r.query_tokens) for r in good.collect()] == [("1", "relevant", 2.5, ["red", "fox"])] and unread.count() == (i == 2)


def test_services_in_batches_with_retries_and_fallbacks(spark):
    calls, ids = spark.sparkContext.accumulator(0), [(f"v{i}",) for i in range(130)] + [("v1",), (None,), (" ",)]

    def api(batch):
        calls.add(1)
        assert len(batch) <= 50
        if "v7" in batch:
            raise ValueError("down")
        return {i: {"title": i.upper()} for i in batch if not i.endswith("5")}

    def page(batch):
        assert len(batch) == 1
        return {i: {"title": "page"} for i in batch if i != "v15"}

    got = {r.video_id: r for r in connector.enriched(spark.createDataFrame(ids, "video_id string"), [("api", 50, api), ("page", 1, page)], retries=2, partitions=1).collect()}
    assert set(got) == {f"v{i}" for i in range(130)} and calls.value == 5  # two good batches, and one three times
    down = {k for k, r in got.items() if r.error}
    assert "v7" in down and len(down) in (30, 50) and all(got[k].error == "ValueError: down" and got[k].provider == ("fallback" if k == "v15" else "page") and got[k].calls == 4 for k in down)
    assert got["v15"].provider == "fallback" and got["v15"].title is None and all(got[k].provider == ("page" if k.endswith("5") else "api") for k in set(got) - down - {"v15"})


def brute_split(text, costs, unknown):
    """The best of all ways to cut a text."""
    ways = []
    for mask in range(1 << max(0, len(text) - 1)):
        cuts = [0, *[i + 1 for i in range(len(text) - 1) if mask >> i & 1], len(text)]
        words = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        if all(w in costs or len(w) == 1 for w in words):
            ways.append((sum(costs.get(w, unknown) for w in words), len(words), [-len(w) for w in words], words))
    return min(ways)[3]


def test_words_of_texts_without_spaces(spark):
    r = random.Random(6)
    lexicon = [("東京", 3), ("京都", 3), ("東京都", 4), ("都", 5), ("に", 1), ("住む", 4), ("ab", 2), ("abc", 2), ("c", 1), ("bc", 2), ("a", 2), ("aa", 3), ("都に", 7), ("ab", 9), (" ", 1), (None, 1), ("x", None)]
    costs = {"東京": 3, "京都": 3, "東京都": 4, "都": 5, "に": 1, "住む": 4, "ab": 2, "abc": 2, "c": 1, "bc": 2, "a": 2, "aa": 3, "都に": 7}
    texts = [(i, "".join(r.choice("東京都に住む" if i % 2 else "aabcd") for _ in range(r.randint(0, 11)))) for i in range(60)] + [(100, None), (101, "東京都に 住むab\nx"), (102, "a" * 30_000)]
    got = {x.id: x.words for x in segmenter.segmented(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(lexicon, "surface string, cost long"), 6).collect()}
    for i, t in texts[:60]:
        assert got[i] == (brute_split(t, costs, 6) if t else [])
    assert got[100] == [] and got[101] == ["東京都", "に", "住む", "ab", "x"] and "".join(got[102]) == "a" * 30_000
    assert {x.id: x.words for x in segmenter.segmented(spark.createDataFrame([(1, "ab")], "id long, text string"), spark.createDataFrame([], "surface string, cost long")).collect()} == {1: ["a", "b"]}


def test_fixture_corpora(spark, tmp_path):
    good = {"name": "x", "videos": [
        {"video_id": "a", "title": "A", "language": "en", "transcript_segments": [{"start": 0, "end": 2.5, "text": " one "}, {"start": 3, "text": " "}, {"start": 4, "text": "two"}],
         "chunks": [{"start": 0, "end": 5, "text": "one", "dense_scores": {"q1": 0.5, "q2": None, " ": 1}}, {"text": "", "embed_text": "e", "semantic_terms": ["t"]}]},
        {"video_id": " "}, {"video_id": "a", "title": "again"}, {"video_id": "b"},
    ]}
    for name, text in (("g.json", json.dumps(good)), ("broken.json", "{"), ("none.json", '{"videos": []}')):
        (tmp_path / name).write_text(text)
    t = fixtures.read_corpora(spark, str(tmp_path))
    rows = lambda name: sorted(tuple(r) for r in t[name].collect())
    assert rows("videos") == [("g.json", "a", "A", "https://media.example/watch?v=a", "en", 2), ("g.json", "b", "Video b", "https://media.example/watch?v=b", "ja", 0)]
    assert rows("segments") == [("g.json", "a", 0, 0.0, 2.5, "one"), ("g.json", "a", 1, 4.0, 4.0, "two")]
    assert rows("chunks") == [("g.json", "a", 0, 0.0, 5.0, "one", "one", []), ("g.json", "a", 1, 0.0, 0.0, "", "e", ["t"])]
    assert rows("dense_scores") == [("g.json", "a", 0, "q1", 0.5)]
    assert rows("problems") == [("broken.json", "", "no videos"), ("g.json", "1", "no video_id"), ("g.json", "2", "video_id repeated"), ("g.json", "a:0", "score not usable"), ("g.json", "a:0", "score not usable"), ("g.json", "a:1", "chunk without text"), ("none.json", "", "no videos")]


def test_profiles_without_a_shuffle(spark):
    """Titles and languages stand beside the lines, so that a source's profile is made within its row."""
    docs = spark.createDataFrame([(1, "One\n\ntwo  words\nthree", "fr", "a"), (2, None, "de", None), (3, "", None, "b"), (4, "\nfirst", "en", "c"), (None, "x", "en", "c")], "doc_id long, text string, lang string, source string")
    titled = docs.withColumn("title", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)))
    alone = answers.profiles(adapters.with_lines(titled, "title"), keep=("lang", "source"))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    joined = answers.profiles(adapters.with_lines(docs), titled.select("doc_id", "title")).join(docs.select("doc_id", "lang", "source"), "doc_id")
    key = lambda r: r.doc_id
    assert sorted(alone.collect(), key=key) == sorted(joined.select(*alone.columns).collect(), key=key) and alone.count() == 4


def test_fixture_corpora_without_a_shuffle(spark):
    """The first video of an id is found within its corpus's row."""
    ids = [["b", "a", " b", None, "a ", "", "c"], [], ["a"], None, ["z"] * 300 + ["y"]]
    texts = [(f"c{n}", json.dumps({"videos": x and [{"video_id": i, "title": f"t{k}"} for k, i in enumerate(x)]})) for n, x in enumerate(ids)] + [("n", '{"videos":[null]}'), ("x", None)]
    t = fixtures.corpus(spark.createDataFrame(texts, "corpus string, json string"))
    assert "Exchange" not in t["videos"]._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.corpus, r.video_id, r.title) for r in t["videos"].collect()) == [("c0", "a", "t1"), ("c0", "b", "t0"), ("c0", "c", "t6"), ("c2", "a", "t0"), ("c4", "y", "t300"), ("c4", "z", "t0")]
    wrong = [(r.corpus, r.place, r.problem) for r in t["problems"].collect()]
    assert sorted(w for w in wrong if w[0] != "c4") == [("c0", "2", "video_id repeated"), ("c0", "3", "no video_id"), ("c0", "4", "video_id repeated"), ("c0", "5", "no video_id"), ("c1", "", "no videos"), ("c3", "", "no videos"), ("x", "", "no videos")]
    assert len([w for w in wrong if w[0] == "c4" and w[2] == "video_id repeated"]) == 299
