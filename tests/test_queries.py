"""Every query with SQL against DuckDB on the smallest tables, and shapes of the plans."""

import duckdb
import numpy as np
import pytest

from tesselith.plans import library_oracles, library_queries, oracles, people_queries, search_queries, store_queries
from tesselith.plans import queries as Q

QUERIES = Q.QUERIES | library_queries.QUERIES | people_queries.QUERIES | store_queries.QUERIES | search_queries.QUERIES
ORACLES = oracles.ORACLES | library_oracles.ORACLES | people_queries.ORACLES | store_queries.ORACLES | search_queries.ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.6f}"
    return str(list(v)) if isinstance(v, list | np.ndarray) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, result.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products_and_pruned_scans(spark):
    for name in ("lexical_bm25_topk", "hybrid_rrf", "feedback_rerank", "routing_search", "nearest_segment"):
        assert "CartesianProduct" not in plan(Q.QUERIES[name](spark, SF))
    p = plan(Q.lexical_bm25_topk(spark, SF))
    assert "n_chars" not in p and "WindowGroupLimit" in p


def test_read_side_needs_no_shuffle(spark):
    for name in ("chunk_time", "chunk_token", "chunk_sentence", "curate_manifest", "read_context"):
        p = plan(Q.QUERIES[name](spark, SF))
        assert "Exchange hashpartitioning" not in p or name == "read_context"


def test_routing_scores_without_a_prediction(spark):
    p = spark.createDataFrame([(1, [3, 2])], "query_id long, ranked array<long>")
    c = spark.createDataFrame([(1, [2], [3]), (2, [2], [3])], "query_id long, relevant array<long>, distractors array<long>")
    got = {r.query_id: (r.status, r.recall_5, r.mrr, r.distractor_error) for r in Q.metrics.routing_scores(p, c).collect()}
    assert got == {1: ("scored", 1.0, 0.5, True), 2: ("missing", 0.0, 0.0, False)}


def test_days_of_jobs_round_as_in_sql(spark, tmp_path):
    """Events at the end of a day, some in its last half second or at its very middle."""
    c = duckdb.connect()
    c.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-05 23:59:58' + to_microseconds(i * 250000) AS ts, i % 3 AS user_id, ['signup', 'view', 'purchase', 'error', 'click'][i % 5 + 1] AS event_type FROM range(20) t(i)")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    got, result = QUERIES["job_state_table"](spark, str(tmp_path)), c.execute(ORACLES["job_state_table"])
    columns = [d[0] for d in result.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, result.fetchall())


def test_chunks_are_cut_in_parts_of_a_batch(spark, monkeypatch):
    lines = [(i, [(10 * j, 10 * j + 10, f" Line {j}. " if j % 2 else "word") for j in range(i % 5)]) for i in range(300)]
    d = spark.createDataFrame(lines, "doc_id long, lines array<struct<start_ds:long,end_ds:long,text:string>>").coalesce(1)
    got = Q.chunking.by_sentence(d, 12)
    assert "MapInArrow" in plan(got) and "MapInPandas" not in plan(got)
    texts = lambda rows: sorted((r.doc_id, r.chunk_index, r.first_ord, r.n_lines, r.start_ds, r.end_ds, r.raw_text) for r in rows)
    whole = texts(got.collect())
    assert [x for x in whole if x[0] == 4] == [(4, 0, 0, 2, 0, 20, "word Line 1."), (4, 1, 2, 2, 20, 40, "word Line 3.")] and {x[0] for x in whole} == {i for i in range(300) if i % 5}
    monkeypatch.setattr(Q.chunking, "DOCS", 1)
    monkeypatch.setattr(Q.chunking, "CHARS", 1)
    assert texts(Q.chunking.by_sentence(d, 12).collect()) == whole


def test_dense_scores_a_few_queries_at_a_time(spark, monkeypatch):
    """A block of scores is bounded whatever the tile, and rows without a scope match none, as in SQL."""
    rows = [(i, [float(i % 7), float(i % 5), 1.0], None if i % 4 == 0 else i % 3) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, scope long")
    q = v.withColumnRenamed("vec_id", "query_id")
    plain_top = lambda: sorted(tuple(r) for r in Q.retrieval.dense_topk(v, q, 3, scoped=True).collect())
    whole = plain_top()
    assert {x[0] for x in whole} == {i for i in range(60) if i % 4}
    monkeypatch.setattr(Q.retrieval, "SCORES", 1)
    assert plain_top() == whole


def test_scores_are_summed_in_the_row(spark, monkeypatch):
    """(query, document) pairs aren't shuffled: the plan has no aggregate; ties, repeated terms and repeated ids as by the join."""
    r = np.random.default_rng(5)
    docs = [(i, [f"t{x}" for x in r.integers(0, 12, r.integers(0, 9))]) for i in range(400)]
    queries = [(i, [f"t{x}" for x in r.integers(0, 15, i % 5)]) for i in range(30)]
    q = spark.createDataFrame(queries, "query_id long, terms array<string>")
    got = lambda rows: Q.retrieval.bm25(spark.createDataFrame(rows, "doc_id long, tokens array<string>"), q, 7)
    found = lambda rows: sorted(tuple(x) for x in got(rows).collect())
    p = plan(got(docs))
    assert "MapInArrow" in p and "Aggregate" not in p and "WindowGroupLimit" in p
    first, twice = found(docs), found([*docs, (3, ["t1"]), (None, ["t2"])])
    monkeypatch.setattr(Q.retrieval, "KEPT", -1000)
    monkeypatch.setattr(Q.retrieval, "SCORES", 90)
    assert found(docs) == first
    monkeypatch.setattr(Q.retrieval, "HELD", 0)
    assert found(docs) == first and found([*docs, (3, ["t1"]), (None, ["t2"])]) == twice


def test_pairs_that_are_wanted_become_rows(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c", "a", "b"]), (2, ["b"]), (3, ["a"]), (4, ["b", "a"]), (5, [])], "doc_id long, tokens array<string>").coalesce(1)
    got = lambda wanted: sorted(tuple(r) for r in Q.retrieval.pairs_found(d, wanted).collect())
    assert got([("a", "b"), ("b", "a"), ("b", "x")]) == [(1, "a b"), (4, "b a")] and got([]) == []


def test_overlap_is_counted_in_the_row(spark):
    """The first k are those of the join, halves rounded up as in SQL; no pairs are shuffled."""
    from tesselith.operators import answers

    r = np.random.default_rng(9)
    some = lambda n: sorted({f"t{x}" for x in r.integers(0, 20, n)})
    s = spark.createDataFrame([(i, some(i % 12)) for i in range(300)] + [(900, [f"t{i}" for i in range(16384)])], "source_id long, tokens array<string>")
    q = spark.createDataFrame([(i, some(i % 6)) for i in range(20)] + [(99, ["t16000"])], "query_id long, tokens array<string>")
    top, whole = answers.lexical_overlap(q, s, k=6), answers.lexical_overlap(q, s)
    assert "Aggregate" not in plan(top)
    wanted = Q.retrieval.ranked(whole, "query_id", [Q.F.desc("lexical_score"), Q.F.asc("source_id")], 6).drop("rank")
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, wanted.collect()))
    assert (99, 900, 0.007813) in {tuple(x) for x in top.collect()}


def test_routes_are_found_without_ranking_all_pairs(spark, monkeypatch):
    """The same first k, scores and ranks, with many equal scores and few candidates."""
    from tesselith.operators import answers

    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(12, 4)), 1)
    vectors = spark.createDataFrame([(i, x[r.integers(12)].tolist()) for i in range(70)] + [(80, None)], "vec_id long, embedding array<double>")  # many equal scores
    queries = spark.createDataFrame([(i, r.normal(size=4).round(1).tolist()) for i in (0, 3, 99)], "query_id long, embedding array<double>")
    words = list("abcdefgh")
    some = lambda n: sorted(set(r.choice(words, n).tolist()))
    sources = spark.createDataFrame([(i, some(int(r.integers(1, 7)))) for i in range(20, 90)], "source_id long, tokens array<string>").repartition(3)
    tokens = spark.createDataFrame([(0, ["a", "b", "c"]), (3, ["h"]), (7, ["a", "d"]), (99, ["none"])], "query_id long, tokens array<string>")
    monkeypatch.setattr(answers.V, "RRF_K", 0)  # eight candidates of a side
    monkeypatch.setattr(Q.retrieval, "SCORES", 100)
    dense = Q.retrieval.dense_topk(vectors, queries, None).select("query_id", Q.F.col("vec_id").alias("source_id"), "dense_score")
    key = ["query_id", "rank", "source_id", "score", "dense_score", "lexical_score"]
    want = sorted(tuple(r) for r in answers.routed(dense, answers.lexical_overlap(tokens, sources), 4).select(*key).collect())
    monkeypatch.setattr(answers, "routed", None)
    assert sorted(tuple(r) for r in answers.routed_search(vectors, queries, sources, tokens, 4).select(*key).collect()) == want and len(want) == 16


def test_cards_are_made_once(spark):
    """The joins read the written cards, not the texts."""
    files = QUERIES["study_cards_normalised"](spark, SF).inputFiles()
    assert files and not any("documents" in f for f in files)


def test_written_scores_are_kept_in_the_row(spark, monkeypatch):
    """The first k are those of the join; no pairs of query and chunk are shuffled."""
    from tesselith.operators import evaluation

    r = np.random.default_rng(4)
    some = lambda n: [f"t{x}" for x in r.integers(0, 30, n)]
    chunks = spark.createDataFrame([(i, i % 7, some(int(r.integers(0, 40)))) for i in range(400)] + [(900, 1, ["t1"] * 3 + [f"x{i}" for i in range(31)])], "doc_id long, chunk_index long, tokens array<string>").repartition(3)
    queries = spark.createDataFrame([(i, some(6)) for i in range(9)] + [(50, []), (51, ["no"]), (52, ["t1"])], "query_id long, tokens array<string>")
    pairs = sorted({(int(r.integers(0, 10)), int(r.integers(0, 420))) for _ in range(300)})
    given = spark.createDataFrame([(q, i, [0.3, None, -1.0, 0.1234565][i % 4]) for q, i in pairs], "query_id long, doc_id long, score double")
    monkeypatch.setattr(Q.retrieval, "SCORES", 100)
    monkeypatch.setattr(evaluation, "KEPT", 10)
    got = evaluation.fixture_dense(queries, chunks, given, 12)
    assert "MapInArrow" in plan(got) and "explode" not in plan(got)
    monkeypatch.setattr(evaluation, "overlap_rows", lambda *a: None)
    want = evaluation.fixture_dense(queries, chunks, given, 12)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 120


def blank_documents(path):
    """Documents of which some have no lines: '', null, blank lines."""
    c = duckdb.connect()
    c.execute("CREATE TABLE documents AS SELECT i AS doc_id, CASE i % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN chr(10) || ' ' || chr(10) ELSE array_to_string([printf('Some Line %d of text %d', j, i) FOR j IN range(i)], chr(10)) END AS text, 'en' AS lang, 'src1' AS source FROM range(15) t(i)")
    c.execute(f"COPY documents TO '{path}/documents.parquet' (FORMAT PARQUET)")
    return c


@pytest.mark.parametrize("name", ["read_context", "study_section_topics", "study_summary_sections", "topic_sources"])
def test_documents_without_lines(spark, tmp_path, name):
    c = blank_documents(tmp_path)
    got, result = QUERIES[name](spark, str(tmp_path)), c.execute(ORACLES[name])
    columns, rows = [d[0] for d in result.description], result.fetchall()
    assert rows and rows_of(got.columns, got.collect()) == rows_of(columns, rows)
