"""Queries of the engine over the driver's tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.operators import answers, chunking, curation, drafts, embedding, metrics, retrieval, review
from tesselith.plans.pipelines import candidate_count
from tesselith.sources import adapters
from tesselith.sources.scratch import written
from tesselith.sources.tables import table

AS_OF = "2024-02-01 00:00:00"
Q = {}


def query(f):
    Q[f.__name__] = f
    return f


def doc_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "source", T.latin_tokens(F.col("text")).alias("tokens"))


#: Candidates of a side for ten results, and for five.
TEN, FIVE = candidate_count(10)[1], candidate_count(5)[1]


def lexical_top(s: SparkSession, d: str, k: int = 30) -> DataFrame:
    return retrieval.bm25(doc_tokens(s, d).drop("source"), adapters.query_table(s, d), k)


def dense_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries: benchmark items search by the vector of their own number."""
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    return v, v.join(table(s, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id")


def dense_top(s: SparkSession, d: str, k: int | None = 30) -> DataFrame:
    """Benchmark items search by the vector of their own number; vectors stand for the documents of their number."""
    return retrieval.dense_topk(*dense_sides(s, d), k).withColumnRenamed("vec_id", "doc_id")


def lines(s: SparkSession, d: str) -> DataFrame:
    return adapters.with_lines(table(s, d, "documents"))


def line_chunks(s: SparkSession, d: str) -> DataFrame:
    """Segments as curation chunks."""
    g = adapters.segments(s, d)
    return g.select("doc_id", F.col("ord").alias("chunk_index"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "text", F.col("lang").alias("language"), (F.col("start_ds") / 10.0).alias("start_sec"), (F.col("end_ds") / 10.0).alias("end_sec"))


def manifest(s: SparkSession, d: str) -> DataFrame:
    return curation.manifest(line_chunks(s, d), "corpus", "v1", "run-1", "2024-01-01T00:00:00Z")


def feedback_rows(s: SparkSession, d: str) -> DataFrame:
    q = adapters.query_table(s, d).select("query_id", F.col("terms").alias("query_tokens"))
    return adapters.feedback(s, d).join(q, "query_id")


def candidates(s: SparkSession, d: str) -> DataFrame:
    x = lexical_top(s, d).withColumn("score", F.col("lexical_score"))
    return x.join(adapters.query_table(s, d).select("query_id", F.col("terms").alias("query_tokens")), "query_id")


def candidate_rows(s: SparkSession, d: str) -> DataFrame:
    t = doc_tokens(s, d).withColumn("start", (F.col("doc_id") * 5).cast("double"))
    return lexical_top(s, d).select("query_id", "doc_id", "rank").join(t, "doc_id")


def gold(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark item.

    Items are the stated query set. Pairs meet on the second and third token of the item: no document is compared with every item. With HELD such pairs or fewer
    tasks hold them, and only those that a document has become rows.
    """
    b = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("p"))
    b = b.where("p is not null").withColumn("t", T.latin_tokens(F.col("p")))
    # shorter items have no two tokens that a document must hold as they are: those few meet all documents
    short, b = b.where("size(t) < 4"), b.where("size(t) >= 4").withColumn("key", F.array_join(F.slice("t", 2, 2), " "))
    docs = table(s, d, "documents").select("doc_id", "text")
    tokens = docs.select("doc_id", T.latin_tokens(F.col("text")).alias("tokens"))
    wanted = [(r["a"], r["b"]) for r in b.select(F.get("t", F.lit(1)).alias("a"), F.get("t", F.lit(2)).alias("b")).distinct().limit(retrieval.HELD + 1).collect()]
    if len(wanted) <= retrieval.HELD:
        keys = retrieval.pairs_found(tokens, wanted)
    else:
        pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("tokens") - 2), lambda i: F.concat_ws(" ", F.get("tokens", i), F.get("tokens", i + 1))))
        keys = tokens.where("size(tokens) >= 2").select("doc_id", F.explode(pairs).alias("key"))
    hit = keys.join(b, "key").select("doc_id", "query_id", "p").distinct()
    found = hit.join(docs, "doc_id").where(F.contains("text", F.col("p"))).select("query_id", "doc_id")
    return found.union(docs.join(short.select("query_id", "p"), F.contains("text", F.col("p"))).select("query_id", "doc_id"))


# search


@query
def lexical_bm25_topk(s, d):
    return lexical_top(s, d, 10).select("query_id", "doc_id", "lexical_score", "rank")


@query
def bm25_scoped_by_source(s, d):
    q = adapters.query_table(s, d).withColumn("scope", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return retrieval.bm25(doc_tokens(s, d).withColumnRenamed("source", "scope"), q, 10).select("query_id", "doc_id", "lexical_score", "rank")


@query
def postings_stats(s, d):
    return retrieval.term_counts(doc_tokens(s, d))


@query
def dense_exact_topk(s, d):
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    return retrieval.dense_topk(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)


@query
def dense_scoped_topk(s, d):
    v = table(s, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("scope"))
    return retrieval.dense_topk(v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5, scoped=True)


@query
def hybrid_rrf(s, d):
    return retrieval.fused_rrf(dense_top(s, d, TEN), lexical_top(s, d, TEN), 10).select("query_id", "doc_id", "hybrid_score", "dense_rank", "lexical_rank", "rank")


@query
def hybrid_weighted(s, d):
    return retrieval.fused_weighted(dense_top(s, d, TEN), lexical_top(s, d, TEN), 10).select("query_id", "doc_id", "hybrid_score", "rank")


@query
def minmax_normalise(s, d):
    x = lexical_top(s, d)
    return x.select("query_id", "doc_id", F.round(retrieval.normalised(x, "lexical_score"), 6).alias("normalised"))


@query
def multimodal_merge(s, d):
    x = lexical_top(s, d, 10).select("query_id", F.col("doc_id"), F.col("lexical_score").alias("score"), F.lit("transcript").alias("kind"))
    pages = table(s, d, "pages").select(F.col("page_id").alias("doc_id"), T.latin_tokens(F.regexp_replace("html", "<[^>]*>", " ")).alias("tokens"))
    y = retrieval.bm25(pages, adapters.query_table(s, d), 10).select("query_id", "doc_id", F.col("lexical_score").alias("score"), F.lit("page").alias("kind"))
    return retrieval.merged_evidence(x, y, k=10)


# feedback


@query
def feedback_index(s, d):
    return retrieval.feedback_counts(adapters.feedback(s, d))


@query
def feedback_adjustment(s, d):
    return retrieval.feedback_adjustments(candidates(s, d), feedback_rows(s, d), AS_OF)


@query
def feedback_rerank(s, d):
    c = candidates(s, d)
    return retrieval.feedback_reranked(c, retrieval.feedback_adjustments(c, feedback_rows(s, d), AS_OF)).select("query_id", "doc_id", "score", "adjustment", "rank")


@query
def feedback_latest(s, d):
    f = adapters.feedback(s, d)
    return retrieval.keep_latest(f, ["query_id"], [F.desc("updated_at"), F.desc("chunk_id")]).select("query_id", "chunk_id", "label")


@query
def feedback_by_source(s, d):
    f = adapters.feedback(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    return retrieval.feedback_counts(f, "source")


@query
def feedback_filter_page(s, d):
    f = adapters.feedback(s, d).where("label = 'not_relevant'")
    return curation.page(f.select("chunk_id", "query_id"), [F.desc("updated_at"), F.asc("chunk_id")], 25, 10)


@query
def diversity_select(s, d):
    return retrieval.diverse(candidate_rows(s, d), 6)


@query
def jaccard_near_dup_pairs(s, d):
    return retrieval.near_duplicate_pairs(candidate_rows(s, d))


# chunks and context


@query
def chunk_time(s, d):
    return chunking.by_time(lines(s, d), 60, 15)


@query
def chunk_sentence(s, d):
    return chunking.by_sentence(lines(s, d), 1000)


@query
def chunk_token(s, d):
    return chunking.by_tokens(lines(s, d), 256, 0.25)


@query
def chunk_stats(s, d):
    c = chunking.by_tokens(lines(s, d), 128, 0.25)
    return chunking.stats(c, ["doc_id"])


@query
def segments_full_transcript(s, d):
    x = lines(s, d)
    return x.select("doc_id", F.array_join(F.transform("lines", lambda v: v["text"]), "\n").alias("text"), F.size("lines").cast("long").alias("segment_count")).withColumn("char_count", F.length("text").cast("long"))


@query
def read_context(s, d):
    x = lines(s, d)
    r = x.select("doc_id", F.expr("int(coalesce(get(lines, size(lines) div 2).start_ds, 0))").cast("long").alias("at_ds"), F.lit(300).cast("long").alias("window_ds"))
    return answers.read_context(x, r).drop("at_ds")


@query
def nearest_segment(s, d):
    g = adapters.segments(s, d)
    ends = g.groupBy("doc_id").agg(F.max("end_ds").alias("e"))
    a = ends.select("doc_id", "e", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("anchor")).select("doc_id", F.col("anchor").cast("long").alias("anchor"), F.expr("anchor * e div 5").alias("at_ds"))
    return answers.nearest(a, g)


@query
def interval_overlap(s, d):
    g = adapters.segments(s, d)
    c = chunking.by_time(lines(s, d), 60, 15).select("doc_id", "chunk_index", F.col("start_ds").alias("cs"), F.col("end_ds").alias("ce"))
    return g.join(c, "doc_id").where(metrics.overlap(F.col("start_ds"), F.col("end_ds"), F.col("cs"), F.col("ce"))).groupBy("doc_id", "chunk_index").agg(F.count(F.lit(1)).alias("segments"), F.min("ord").alias("first_ord"))


@query
def summary_windows(s, d):
    return chunking.budget_windows(lines(s, d), 2000)


@query
def hash_embedding(s, d):
    e = embedding.hash_embeddings(table(s, d, "documents"), 128)
    return e.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


# curation


@query
def curate_manifest(s, d):
    m = manifest(s, d)
    return m.select("evidence_id", "doc_id", "chunk_index", "text_length", "token_estimate", "has_timestamp", "quality_score", "quality_label", F.array_join("topic_tags", "|").alias("topics"), "included", "inclusion_reason", "exclusion_reason")


@query
def curate_report(s, d):
    return curation.report(manifest(s, d))


@query
def curate_labels(s, d):
    return curation.label_counts(manifest(s, d))


@query
def curate_topics(s, d):
    return curation.topic_counts(manifest(s, d))


@query
def curate_inference(s, d):
    """Raw chunks whose times are text: every seventh line's start can't be read, and every eleventh's end."""
    raw = line_chunks(s, d)
    raw = raw.withColumns({"start_sec": F.when(F.col("chunk_index") % 7 == 6, "soon").otherwise(F.col("start_sec").cast("string")), "end_sec": F.when(F.col("chunk_index") % 11 == 10, "late").otherwise(F.col("end_sec").cast("string"))})
    _, rows = curation.curated(raw, "corpus", "v1", "run-1", "2024-01-01T00:00:00Z")
    return rows.select("inference_run_id", "status", "score", "label", F.get_json_object("output_json", "$.exclusion_reason").alias("exclusion_reason"), "error_message")


@query
def manifest_filter_page(s, d):
    m = curation.filtered(manifest(s, d), quality="high_signal", included=True, topic="Technology")
    return curation.page(m.select("evidence_id", "quality_score"), [F.desc("quality_score"), F.asc("evidence_id")], 50, 20)


@query
def token_estimate(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", T.token_estimate(F.col("text"), F.col("lang")).alias("tokens"))


@query
def language_match(s, d):
    x = table(s, d, "documents").select("doc_id", "text", F.lit("en").alias("language"), F.lit(0.0).alias("start_sec"), F.lit(1.0).alias("end_sec"))
    return curation.signals(x).select("doc_id", "japanese", "latin", "meaningful", "language_matches")


@query
def repetition_signals(s, d):
    x = table(s, d, "documents").select("doc_id", "text", F.col("lang").alias("language"), F.lit(0.0).alias("start_sec"), F.lit(1.0).alias("end_sec"))
    return curation.signals(x).select("doc_id", F.round("top_char", 4).alias("top_char"), F.round("unique_ratio", 4).alias("unique_ratio"), "passes_repetition")


@query
def keywords_topk(s, d):
    return review.keywords(table(s, d, "documents"), 8)


# text


@query
def query_rewrite(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", T.query_rewrite(F.col("text")).alias("rewrite"))


@query
def tool_choice(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", T.initial_tool(F.col("text")).alias("tool"))


@query
def english_tokens(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(T.english_tokens(F.col("text")), " ").alias("tokens"))


@query
def char_bigrams(s, d):
    b = table(s, d, "benchmark").select("item_id", T.bigrams(F.replace(F.lower(T.clean(F.col("text"))), F.lit(" "), F.lit(""))).alias("b"))
    return b.select("item_id", F.posexplode("b").alias("pos", "bigram"))


@query
def snippets_and_clocks(s, d):
    t = table(s, d, "documents")
    sec = F.col("n_chars").cast("double") * 1.5
    return t.select("doc_id", T.snippet(F.col("text"), 240).alias("snippet"), T.clipped(F.col("text"), 100).alias("clipped"), T.hhmmss(sec).alias("hhmmss"), T.clock(sec).alias("clock"), T.padded_clock(sec).alias("padded"), T.minutes_clock(sec).alias("minutes"))


@query
def query_hashes(s, d):
    return adapters.query_table(s, d).select("query_id", T.query_hash(F.col("query"), F.lit("hybrid")).alias("query_hash"))


@query
def json_props(s, d):
    e = table(s, d, "events")
    p = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(p)), ",").alias("keys"))


@query
def url_parts(s, d):
    p = table(s, d, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"), T.timed_url(F.col("url"), F.lit(12.7)).alias("timed"))


@query
def page_title(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


# metrics


def lexical_scores(s, d):
    return metrics.query_scores(lexical_top(s, d, 10), gold(s, d), adapters.query_table(s, d))


def both_scores(s, d):
    """Scores of lexical search and of the fusion, from one lexical search; it and the gold are written, so each is worked out once."""
    lexical, g, q = written(lexical_top(s, d, TEN), "lexical-top"), written(gold(s, d), "gold"), adapters.query_table(s, d)
    return metrics.query_scores(lexical.where("rank <= 10"), g, q), metrics.query_scores(retrieval.fused_rrf(dense_top(s, d, TEN), lexical, 10), g, q)


@query
def precision_recall_mrr_ndcg(s, d):
    return lexical_scores(s, d)


@query
def interval_gold_scores(s, d):
    """Time chunks of a document against its third and fourth segment, found again by interval."""
    c = chunking.by_time(lines(s, d), 60, 15)
    r = c.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(None).cast("long").alias("chunk_index"), F.col("start_ds").alias("start"), F.col("end_ds").alias("end"), (F.col("chunk_index") + 1).alias("rank"))
    g = adapters.segments(s, d).where("ord in (2, 3)").select(F.col("doc_id").alias("query_id"), F.col("ord").alias("gold_id"), "doc_id", F.lit(None).cast("long").alias("chunk_index"), F.col("start_ds").alias("start"), F.col("end_ds").alias("end"))
    return metrics.interval_scores(r, g, 5)


def runs(s, d):
    q, h = both_scores(s, d)
    scores = q.withColumn("run", F.lit("lexical")).unionByName(h.withColumn("run", F.lit("hybrid")))
    e = table(s, d, "events").select(F.when(F.col("event_id") % 2 == 0, "lexical").otherwise("hybrid").alias("run"), F.round(F.coalesce("value", F.lit(0.0)), 3).alias("latency_ms"), F.lit(False).alias("failed"))
    return metrics.run_summary(scores, e, ["p_5", "r_5", "mrr", "ndcg"])


@query
def run_metrics(s, d):
    return runs(s, d)


@query
def run_select(s, d):
    return metrics.with_quality(runs(s, d)).select("run", "quality", "selected")


@query
def thresholds(s, d):
    r = runs(s, d)
    return metrics.threshold_checks(r.where("run = 'hybrid'"), r.where("run = 'lexical'"), {"r_5": (0.85, 0.10), "mrr": (0.70, 0.10), "ndcg": (0.75, 0.05)}, adapters.query_table(s, d).select(F.count(F.lit(1))).scalar())


@query
def latency_percentiles(s, d):
    e = table(s, d, "events")
    mean = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return metrics.percentiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95}).join(mean, "event_type")


@query
def labelled_metrics(s, d):
    y = adapters.feedback(s, d).select(F.col("chunk_id").alias("doc_id"), "label")
    return metrics.labelled_scores(lexical_top(s, d, 30).join(y, "doc_id", "left"))


@query
def run_compare(s, d):
    q = adapters.query_table(s, d).select("query_id", "query").dropDuplicates(["query"])
    a, b = both_scores(s, d)
    return metrics.compared(a.join(q, "query_id"), b.join(q, "query_id"), ["r_5", "mrr", "ndcg"])


@query
def vector_recall_by_label(s, d):
    v = table(s, d, "embeddings")
    top = dense_exact_topk(s, d).join(v.select("vec_id", F.col("label").alias("found")), "vec_id")
    x = top.join(v.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return x.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("found")).cast("double")), 6).alias("precision"))


def routing_cases(s, d):
    """For each vector query: labels ranked by their best hit; its own label is relevant, the next two are distractors."""
    v = table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("l"))
    hits = dense_exact_topk(s, d).join(v, "vec_id").groupBy("query_id", "l").agg(F.min("rank").alias("r"))
    p = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "l"))), lambda x: x["l"]).alias("ranked"))
    c = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.array("l").alias("relevant"), F.when(F.col("vec_id") % 100 == 0, F.array().cast("array<bigint>")).otherwise(F.array((F.col("l") + 1) % 10, (F.col("l") + 2) % 10)).alias("distractors"))
    return metrics.routing_scores(p, c)


@query
def distractor_errors(s, d):
    return routing_cases(s, d)


@query
def routing_eval_report(s, d):
    return metrics.routing_report(routing_cases(s, d))


@query
def dataset_violations(s, d):
    """Labels without a document, and benchmark items without gold."""
    y, docs = table(s, d, "labels"), table(s, d, "documents")
    a = y.join(docs, "doc_id", "left_anti").select(F.lit("unknown_document").alias("problem"), F.col("doc_id").alias("id"))
    b = table(s, d, "benchmark").select(F.col("item_id").alias("query_id")).join(gold(s, d), "query_id", "left_anti").select(F.lit("no_gold").alias("problem"), F.col("query_id").alias("id"))
    return a.unionByName(b)


# answers and routing


@query
def evidence_assessment(s, d):
    x = retrieval.fused_rrf(dense_top(s, d, FIVE), lexical_top(s, d, FIVE), 5)
    q = adapters.query_table(s, d).select("query_id", F.col("terms").alias("query_tokens"))
    rows = x.join(doc_tokens(s, d).select("doc_id", F.array_distinct("tokens").alias("row_tokens")), "doc_id").join(q, "query_id")
    return answers.with_no_results(answers.assessed(rows, "hybrid"), q)


def tool_side(s, d, rows, mode, tool):
    """What a tool's results (query_id, doc_id, rank and its score) are worth: (query_id, tool, sufficient, n_rows)."""
    q = adapters.query_table(s, d).select("query_id", F.col("terms").alias("query_tokens"))
    t = doc_tokens(s, d).select("doc_id", F.array_distinct("tokens").alias("row_tokens"))
    other = "dense_score" if mode == "lexical" else "lexical_score"
    rows = rows.withColumn(other, F.lit(None).cast("double"))
    a = answers.assessed(rows.join(t, "doc_id").join(q, "query_id"), mode)
    n = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return answers.with_no_results(a, q).join(n, "query_id", "left").select("query_id", F.lit(tool).alias("tool"), "sufficient", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query
def tool_policy(s, d):
    return answers.tool_choice(tool_side(s, d, lexical_top(s, d, 5), "lexical", "keyword_search"), tool_side(s, d, dense_top(s, d, 5), "dense", "semantic_search"))


@query
def citations(s, d):
    c = lexical_top(s, d, 5).join(table(s, d, "documents").select("doc_id", "text", F.col("n_chars").cast("double").alias("start")), "doc_id")
    return answers.citations(c.withColumns({"end": F.col("start") + 30.0, "url": F.concat(F.lit("https://media.example/watch?v="), F.col("doc_id").cast("string"))}))


def titled_lines(s, d, *more):
    """lines() with the first line as title beside them, and more columns of the documents."""
    return adapters.with_lines(table(s, d, "documents").withColumn("title", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))), "title", *more)


@query
def routing_profiles(s, d):
    p = answers.profiles(titled_lines(s, d))
    return p.select("doc_id", "overview", F.size("sections").cast("long").alias("n_sections"), F.array_join(F.transform("sections", lambda x: x["start_ds"].cast("string")), ",").alias("starts"), F.md5("lexical_text").alias("lexical_md5"))


def source_hits(s, d):
    """Vectors of a label are that source's; the least id is its identity."""
    v = table(s, d, "embeddings")
    first = v.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id", F.lit("identity").alias("vector_type"))
    kinds = v.select("vec_id", "embedding", F.col("label").cast("long").alias("source_id")).join(first, "vec_id", "left").withColumn("vector_type", F.coalesce("vector_type", F.lit("section")))
    return retrieval.dense_by_source(kinds, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@query
def routing_vector_agg(s, d):
    return answers.multi_vector_scores(source_hits(s, d))


def route_sides(s, d):
    """Tokens of the sources and of the queries."""
    p = answers.profiles(titled_lines(s, d)).select(F.col("doc_id").alias("source_id"), T.routing_tokens(F.col("lexical_text")).alias("tokens"))
    return p, adapters.query_table(s, d).select("query_id", F.array_distinct("terms").alias("tokens"))


def lexical_routes(s, d, k=None):
    p, q = route_sides(s, d)
    return answers.lexical_overlap(q, p, k=k)


@query
def routing_search(s, d):
    return answers.routed_search(*dense_sides(s, d), *route_sides(s, d), 5).select("query_id", "source_id", "score", "rank")


@query
def routing_variants(s, d):
    # by the lexical side alone a score falls with its rank, so the first ten of that are the first ten
    a = answers.routed(None, lexical_routes(s, d, 10), 10).select("query_id", F.lit("original").alias("kind"), "source_id", "rank", "lexical_score")
    b = dense_top(s, d, 10).select("query_id", F.lit("translated").alias("kind"), F.col("doc_id").alias("source_id"), "rank", F.lit(None).cast("double").alias("lexical_score"))
    return answers.routed_variants(a.unionByName(b), 5)


# review, study, history


@query
def review_shards(s, d):
    y = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id").select("source", F.col("doc_id").alias("item_id"))
    h = retrieval.ranked(y, "source", [F.md5(F.col("item_id").cast("string").cast("binary"))], None)
    n = y.groupBy("source").agg(F.bround(F.count(F.lit(1)) * 0.15, 0).alias("m"))
    over = h.join(n, "source").where("rank <= m").select("source", "item_id")
    return review.review_shards(y, "source", [F.asc("item_id")], over, size=5)


@query
def adjudication(s, d):
    y = table(s, d, "labels")
    r = y.select((F.col("doc_id") % 97).alias("item_id"), F.when(F.col("quality") == 1, "relevant").otherwise("not_relevant").alias("recommended_label"), F.when(F.col("doc_id") % 5 == 0, "low").otherwise("high").alias("confidence"))
    return review.adjudicated(r)


@query
def study_groups(s, d):
    return review.grouped_sections(lines(s, d), 5)


@query
def section_select(s, d):
    g = review.grouped_sections(lines(s, d), 5)
    return review.selected_sections(review.section_scores(g, ["the", "thing", "ation"], ["over", "with"]), 3).select("doc_id", "section", "focus_score", "query_match_count", "rank")


@query
def even_sampling(s, d):
    x = lines(s, d).select("doc_id", F.size("lines").alias("n"))
    return x.select("doc_id", F.explode(review.even_positions(F.col("n"), F.lit(6))).alias("pos"))


@query
def anchor_timestamps(s, d):
    """Each document's first, middle and last lines as items, their whole text as anchors."""
    x = lines(s, d).where("size(lines) > 0")
    at = "named_struct('item', {i}L, 'anchor', lines[{p}].text, 'at_ds', lines[{p}].start_ds)"
    items = x.select("doc_id", F.expr(f"array({at.format(i=0, p=0)}, {at.format(i=1, p='size(lines) div 2')}, {at.format(i=2, p='size(lines) - 1')})").alias("items"))
    return review.anchors_resolved(items, x)


def log(s, d):
    return table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("level"), F.col("user_id").alias("job_id"))


@query
def log_filter_since(s, d):
    return review.log_rows(log(s, d), since="2024-01-10T00:00:00", level="click").select("event_id", "ts")


@query
def log_latest_job(s, d):
    return review.latest_jobs(log(s, d), "job_id", [F.desc("ts"), F.desc("event_id")])


@query
def history_top20(s, d):
    return review.bounded_history(log(s, d), "job_id", [F.desc("ts"), F.desc("event_id")]).select("job_id", "event_id", "rank")


@query
def source_merge(s, d):
    t = table(s, d, "documents")
    provider = lambda m: F.element_at(F.array(F.lit("data_api"), F.lit("oembed"), F.lit("fallback"), F.lit("legacy")), (F.col("doc_id") % m % 4 + 1).cast("int"))
    a = t.select("doc_id", provider(4).alias("provider"), F.col("source").alias("channel_id"), F.lit("old").alias("channel_name"), F.lit("2024-01-01").alias("fetched_at"))
    b = t.join(table(s, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", provider(7).alias("provider"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.lit("new")).alias("channel_id"), F.when(F.col("doc_id") % 2 == 0, "named").alias("channel_name"), F.lit("2024-02-01").alias("fetched_at"))
    return review.merged_sources(a, b)


@query
def study_quality(s, d):
    """Lines as cards: the next line answers, every third lacks a cue, every fifth an objective."""
    g = adapters.segments(s, d)
    cards = g.select(
        F.col("doc_id").alias("deck_id"), F.col("text").alias("question"), F.col("text").alias("answer"), F.when(F.col("ord") % 3 == 2, "").otherwise("cue").alias("source_cue"), F.lit("Concept").alias("card_type"),
        F.when(F.col("ord") % 5 == 4, "").otherwise("objective").alias("learning_objective"), F.lit("value").alias("why_it_matters"), F.col("start_ds").alias("start"), (F.col("ord") % 7 != 6).alias("has_evidence"),
    )
    return drafts.study_quality(cards).select("deck_id", "cards", "duplicate_rate", "evidence_rate", "answerable_rate", "concise_rate", "untimed_rate", "score", "verdict")


@query
def draft_cases(s, d):
    """Conversation turns as draft cases: four types and an odd one, evidence by number."""
    c = table(s, d, "conversations")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("fact", "compare", "summary", "negative", "odd")]), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    ev = F.array(F.struct((F.col("conv_id") * 2).alias("doc_id"), F.col("turn").alias("chunk_index")), F.struct((F.col("conv_id") * 2).alias("doc_id"), (F.col("turn") + 40).alias("chunk_index")))
    cases = c.select((F.col("conv_id") % 20).alias("draft_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.col("text").alias("query"), kind.alias("case_type"), F.when(F.col("turn") % 4 == 3, F.array(F.lit(" "))).otherwise(F.array(F.lit("fact"))).alias("facts"), ev.alias("evidence"))
    chunks = adapters.segments(s, d).select("doc_id", F.col("ord").alias("chunk_index"))
    return drafts.canonical_cases(cases, chunks, ["fact", "compare", "summary", "negative"])


@query
def answer_payloads(s, d):
    """Model payloads made of benchmark items, against citations 1 to 3."""
    q = adapters.query_table(s, d).select("query_id", "query")
    cites = F.array(F.struct((F.col("query_id") % 5).cast("string").alias("citation_id"), F.lit("r").alias("reason")), F.struct(F.lit("2").alias("citation_id"), F.lit("r").alias("reason")))
    payload = F.to_json(F.struct(F.when(F.col("query_id") % 7 == 0, "odd").otherwise("Answered").alias("status"), F.lit("high").alias("confidence"), F.when(F.col("query_id") % 6 == 0, "").otherwise(F.concat("query", F.lit(" [2]"))).alias("answer"), (F.col("query_id") % 9 == 0).alias("has_conflict"), F.when(F.col("query_id") % 4 != 0, cites).alias("citations")))
    known = q.select("query_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("citation_id"))
    return drafts.normalised_answers(q.select("query_id", payload.alias("payload")), known)


QUERIES = dict(Q)
