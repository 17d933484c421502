"""More queries over the driver's tables: summaries, study, the library, evaluation, review."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.operators import chunking, embedding, evaluation, library, metrics, retrieval, review, study, summaries
from tesselith.plans import pipelines
from tesselith.plans.queries import both_scores, dense_top, doc_tokens, lexical_top, lines
from tesselith.plans.queries import gold as gold_of
from tesselith.sources import adapters
from tesselith.sources.scratch import written
from tesselith.sources.tables import table

Q = {}


def query(f):
    Q[f.__name__] = f
    return f


# summaries


@query
def summary_prompt_lines(s, d):
    return summaries.prompt_lines(lines(s, d))


@query
def summary_compact_lines(s, d):
    return summaries.compact_lines(lines(s, d), 4000)


@query
def sentence_counts(s, d):
    return table(s, d, "documents").select("doc_id", summaries.sentence_count(F.col("text"), F.col("lang")).cast("long").alias("sentences"))


@query
def sentence_ranges(s, d):
    x = adapters.segments(s, d).select("doc_id", F.col("text").alias("tldr"), F.col("lang").alias("language"))
    return summaries.sentences_in_range(x, 1, 5)


@query
def items_language(s, d):
    x = adapters.segments(s, d).select("doc_id", F.lit("").alias("title"), F.col("text").alias("tldr"), F.when(F.col("doc_id") % 3 == 0, "ja").otherwise("en").alias("language"))
    return summaries.language_fits(x)


@query
def summary_items(s, d):
    """Lines as model items: every fourth without a title, odd ones repeating, ranks on a third of the documents."""
    g = adapters.segments(s, d)
    spans = g.groupBy("doc_id").agg((F.min("start_ds") + 5).alias("low"), (F.max("end_ds") - 5).alias("high"))
    items = g.select(
        "doc_id", "ord", F.when(F.col("doc_id") % 3 == 0, (F.col("ord") % 4).cast("int")).alias("rank"), F.when(F.col("ord") % 4 == 0, "").otherwise(F.concat(F.lit("Point  "), (F.col("ord") % 3).cast("string"))).alias("title"),
        F.when(F.col("ord") % 2 == 1, F.concat(F.when(F.col("ord") % 4 == 1, "item ").otherwise("Item "), (F.col("ord") % 7).cast("string"))).otherwise(F.col("text")).alias("tldr"),
        (F.col("start_ds") - 50).alias("start_ds"), (F.col("end_ds") + 50).alias("end_ds"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise("ja").alias("language"),
    )
    return summaries.normalised_items(items, spans)


@query
def summary_map_reduce(s, d):
    x = lines(s, d)
    w = chunking.budget_windows(x, 2000).select("doc_id", "window", "first_ord", "n_lines")
    g = adapters.segments(s, d)
    rows = w.select("doc_id", "window", F.explode(F.expr("sequence(first_ord, first_ord + n_lines - 1)")).alias("ord"), (F.col("ord") - F.col("first_ord") + 1).alias("place"))
    windows = rows.join(g.select("doc_id", "ord", "text", "start_ds", "end_ds"), ["doc_id", "ord"])
    spans = g.groupBy("doc_id").agg(F.min("start_ds").alias("low"), F.max("end_ds").alias("high"))
    return summaries.map_reduce(windows, spans, table(s, d, "documents").select("doc_id", F.lit("en").alias("language")))


# study


@query
def study_tokens(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(study.search_tokens(F.col("text")), " ").alias("tokens"))


@query
def study_sentences(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(study.sentences(F.col("text")), "|").alias("sentences"))


@query
def study_evidence(s, d):
    return study.evidence_rows(lines(s, d), 8)


@query
def focused_evidence(s, d):
    """Lines in three sections by turns; a section's concepts are its lines."""
    g = adapters.segments(s, d).groupBy("doc_id", (F.col("ord") % 3).alias("section")).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"))
    sections = g.select("doc_id", "section", F.concat(F.lit("Section "), (F.col("section") + 1).cast("string")).alias("title"), F.transform("t", lambda x: x["text"]).alias("concepts"))
    return study.focused_evidence(sections, 8)


@query
def topic_sources(s, d):
    x = lines(s, d).where("size(lines) > 0")
    end = F.expr("get(lines, size(lines) - 1).end_ds")  # the filter may be evaluated after this
    span = lambda i, a, b: F.struct(F.lit(i).cast("long").alias("topic"), a.cast("long").alias("start_ds"), b.cast("long").alias("end_ds"))
    topics = x.select("doc_id", F.array(span(0, F.lit(0), F.floor(end / 3)), span(1, F.floor(end / 2), F.floor(end / 2) + 200)).alias("topics"))
    return study.topic_sources(topics, x.select("doc_id", "lines"))


def cards(s, d):
    e = study.evidence_rows(lines(s, d), 8)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return study.local_cards(e.withColumn("place", place), 6)


@query
def study_cards(s, d):
    return cards(s, d)


@query
def study_cards_normalised(s, d):
    """The local cards as a model's reply: other kinds, blanks, unknown evidence, and documents with a single card."""
    f = written(cards(s, d), "cards")  # read by several joins
    raw = f.where((F.col("doc_id") % 4 != 0) | (F.col("card") == 1)).select(
        "doc_id", "card", F.when(F.col("card") % 2 == 0, "odd").otherwise(F.lit(" Detail ")).alias("card_type"), F.when(F.col("card") % 3 == 0, "  ").otherwise("Why?").alias("question"),
        F.when(F.col("card") % 2 == 1, None).otherwise("Because").alias("answer"), F.when(F.col("card") % 3 == 1, "none").otherwise(F.col("evidence_id")).alias("evidence_id"), F.lit(None).cast("string").alias("source_cue"),
    )
    return study.normalised_cards(raw, f, 5)


@query
def section_types(s, d):
    g = review.grouped_sections(lines(s, d), 5).select("doc_id", "section", "text")
    return study.marked_profiles(g, {"intro": ["The ", "and the"], "background": ["hand", "of the", "ing"], "closing": ["que ", "ción"]})


# library


def version(c):
    return F.element_at(F.array(F.lit(None).cast("string"), F.lit("v1"), F.lit("v2")), (F.col(c) % 3 + 1).cast("int"))


@query
def library_list(s, d):
    x = lines(s, d)
    records = x.select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).alias("title"), F.col("lang").alias("language"), F.col("lines").alias("chunks"), version("doc_id").alias("chunking_version"))
    history = table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    return library.listing(records, history, "v2")


@query
def ingest_actions(s, d):
    targets = table(s, d, "events").select(F.col("user_id").alias("doc_id"))
    # stored are the documents with labels
    stored = table(s, d, "documents").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", version("doc_id").alias("chunking_version"))
    return library.ingest_plan(targets, stored, "v2")


@query
def caption_tracks(s, d):
    codes = F.array(*[F.lit(x) for x in ("fr", "ja-JP", "en-GB", "de", "en")])
    t = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.element_at(codes, ((F.col("conv_id") + F.col("turn") * 2) % 5 + 1).cast("int")).alias("code"))
    return library.caption_track(t, ["ja", "en"])


@query
def page_links(s, d):
    """The playlist reader with another pattern: links of a page in the order of their first appearance."""
    p = table(s, d, "pages")
    return p.select("page_id", F.posexplode(library.playlist_ids(F.col("html"), 'href="([^"]+)"')).alias("pos", "link"))


@query
def json3_urls(s, d):
    return table(s, d, "pages").select("page_id", library.json3_url(F.col("url")).alias("url"))


@query
def frame_plan(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", F.explode(library.frame_times((F.col("n_chars") - 40) / 10.0, 60)).alias("second"))


@query
def frame_texts(s, d):
    conf = F.element_at(F.array(F.lit("0.5"), F.lit("bad"), F.lit("0.75"), F.lit(None).cast("string"), F.lit("NaN")), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    items = table(s, d, "conversations").select((F.col("conv_id") % 50).alias("doc_id"), F.col("conv_id").alias("frame"), F.col("turn").alias("ord"), F.when(F.col("turn") % 4 == 3, "  ").otherwise(F.col("text")).alias("text"), conf.alias("confidence"))
    return library.frame_text(items).withColumn("confidence", F.round("confidence", 6))


@query
def dominant_languages(s, d):
    return library.dominant_language(table(s, d, "documents").select("source", F.col("lang").alias("language")), "source")


@query
def result_languages(s, d):
    r = lexical_top(s, d, 10).join(table(s, d, "documents").select("doc_id", F.col("lang").alias("language")), "doc_id")
    return library.result_language(r)


@query
def query_texts(s, d):
    b = table(s, d, "benchmark")
    return b.select("item_id", library.query_text(F.col("text"), F.when(F.col("item_id") % 2 == 0, "en"), "multi-e5").alias("query_text"), library.passage_text(F.col("text"), "plain").alias("passage_text"))


@query
def run_ids(s, d):
    return table(s, d, "events").select("event_id", library.run_id(F.col("ts"), F.col("event_id").cast("string")).alias("run_id"))


@query
def finite_values(s, d):
    odd = F.element_at(F.array(F.lit("nan"), F.lit("Infinity"), F.lit("x"), F.lit(None).cast("string")), (F.col("event_id") % 4 + 1).cast("int"))
    raw = F.when(F.col("event_id") % 3 == 0, odd).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    return table(s, d, "events").select("event_id", library.finite(raw).alias("value"))


@query
def merged_log_page(s, d):
    e = table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("level"))
    return library.merged_logs([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")], 100, level=" CLICK ").select("event_id", "ts")


# evaluation


@query
def prediction_checks(s, d):
    e = table(s, d, "events")
    u = F.col("user_id").cast("string")
    ranked = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("array<string>")).when(F.col("event_id") % 7 == 1, F.array(u, F.lit(" "))).when(F.col("event_id") % 7 == 2, F.array(u, F.concat(F.lit(" "), u))).otherwise(F.array(u))
    late = F.element_at(F.array(F.lit(None).cast("string"), F.lit("12.5"), F.lit("-1"), F.lit("soon"), F.lit("NaN")), (F.col("event_id") % 5 + 1).cast("int"))
    p = e.select(F.col("event_id").alias("ord"), F.when(F.col("event_id") % 11 == 0, " ").otherwise(u).alias("query_id"), ranked.alias("ranked"), late.alias("latency_ms"))
    return evaluation.checked_predictions(p, e.where("event_type = 'click'").select(F.col("user_id").alias("query_id")))


@query
def chunk_recall(s, d):
    place = lambda c: (F.floor(F.col(c) / 10).cast("long").alias("doc_id"), (F.col(c) % 10).alias("chunk_index"))
    r = lexical_top(s, d, 10).select("query_id", "rank", *place("doc_id"))
    return evaluation.chunk_recall(r, gold_of(s, d).select("query_id", *place("doc_id")))


@query
def ablation_report(s, d):
    lexical, hybrid = both_scores(s, d)
    return evaluation.ablation(hybrid, lexical, ["r_1", "r_5", "mrr"])


@query
def eval_requests(s, d):
    b = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("en").alias("language"), F.when(F.col("item_id") % 2 == 0, "ordinary").otherwise("channel_targeted").alias("categories"), F.lit(1).alias("gold"))
    return evaluation.requests(b)


@query
def slim_results(s, d):
    r = lexical_top(s, d, 10).select("query_id", "rank", "doc_id", F.col("lexical_score").alias("score")).join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    return evaluation.slim_results(r)


@query
def budgeted_chunks(s, d):
    return evaluation.budgeted_chunks(lines(s, d), 1500)


@query
def fixture_dense(s, d):
    q = adapters.query_table(s, d).select("query_id", F.col("terms").alias("tokens"))
    c = doc_tokens(s, d).select("doc_id", (F.col("doc_id") % 7).alias("chunk_index"), "tokens")
    given = adapters.feedback(s, d).where("label = 'relevant'").select("query_id", F.col("chunk_id").alias("doc_id"), F.lit(0.3).alias("score"))
    return evaluation.fixture_dense(q, c, given, 10)


@query
def merged_languages(s, d):
    return evaluation.merged_languages([lexical_top(s, d, 10), dense_top(s, d, 10)], 10)


@query
def context_blocks(s, d):
    t = table(s, d, "documents").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("n_chars").cast("double").alias("start"), (F.col("n_chars") + 30).cast("double").alias("end"), "text")
    return evaluation.context_block(lexical_top(s, d, 5).join(t, "doc_id"))


# review


@query
def review_batch(s, d):
    q = adapters.query_table(s, d).select("query_id", "query")
    t = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("chunk_index"), (F.col("n_chars") / 4.0).alias("start"), (F.col("n_chars") / 5.0).alias("end"))
    r = lexical_top(s, d, 10).join(q, "query_id").join(t, "doc_id")
    return review.review_items(r.withColumn("score", F.col("lexical_score")))


def recommendations(s, d):
    pick = lambda xs, m: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (m % len(xs) + 1).cast("int"))
    i = F.col("doc_id")
    y = table(s, d, "labels").select(
        F.when(i % 4 > 0, F.concat(F.lit("r"), i.cast("string"))).alias("review_item_id"), pick([" What  is it ", None, ""], i).alias("query"), pick([None, "src1"], i).alias("source"), pick(["Relevant", None, "odd", "not_relevant", "unclear"], i).alias("recommended_label"),
        pick([None, "relevant", None, "UNCLEAR"], i).alias("final_label"), pick(["High", "sure", None], i).alias("confidence"), (i % 2 == 0).alias("approved"), F.struct(F.concat(F.lit("s"), i.cast("string")).alias("review_item_id"), pick(["q", None], i).alias("query"), F.lit("src2").alias("source")).alias("ref"),
    )
    return review.normalised_recommendations(y)


@query
def normalised_recommendations(s, d):
    return recommendations(s, d)


@query
def feedback_payloads(s, d):
    return review.feedback_payloads(recommendations(s, d))


@query
def source_histogram(s, d):
    return review.histogram(table(s, d, "documents").select(F.when(F.col("doc_id") % 10 > 0, F.col("source")).alias("source")), "source")


@query
def ask_records(s, d):
    pick = lambda xs, m: F.element_at(F.array(*[F.lit(x) for x in xs]), (m % len(xs) + 1).cast("int"))
    i = F.col("conv_id") + F.col("turn")
    c = table(s, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(i % 7 > 0, F.col("conv_id")).alias("doc_id"), F.when(i % 5 > 0, F.concat(F.lit("  "), F.col("text"))).alias("question"), F.lit(None).cast("string").alias("answer"), (i % 4 - 1).cast("int").alias("k"),
        pick([" Lexical", "", "hybrid"], i).alias("retrieval_mode"), F.lit("x").alias("provider"), pick(["Error", "odd", "answered"], i).alias("status"), pick(["HIGH", "odd"], i).alias("confidence"), F.lit("2024-01-01").alias("created_at"),
    )
    return review.ask_records(c)


# search in several scripts


@query
def lexical_multilingual(s, d):
    """BM25 over tokens of both kinds: half of the documents and items are put into kana, whose tokens are bigrams and the parts between spaces."""
    put = lambda i: F.when(F.col(i) % 2 == 0, F.translate("text", "aeiou", "あえいおう")).otherwise(F.col("text"))
    docs = table(s, d, "documents").select("doc_id", T.lexical_tokens(put("doc_id")).alias("tokens"))
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), T.lexical_tokens(put("item_id")).alias("terms"))
    return retrieval.bm25(docs, q, 10).select("query_id", "doc_id", "lexical_score", "rank")


# compositions


def _chunks(s, d):
    return table(s, d, "documents").select("doc_id", "source", (F.col("doc_id") * 5).cast("double").alias("start"), "text")


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _queries(s, d):
    q = adapters.query_table(s, d)
    return q.join(table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


@query
def retrieve_hybrid(s, d):
    """Candidates of both kinds, fused, moved by feedback and diversified."""
    f = adapters.feedback(s, d).join(adapters.query_table(s, d).select("query_id", F.col("terms").alias("query_tokens")), "query_id")
    return pipelines.retrieve(_chunks(s, d), _vectors(s, d), _queries(s, d), 5, feedback=f, as_of="2024-02-01 00:00:00")


def overlap_scores(queries, texts):
    """A fixed scorer that stands for a cross-encoder: shared words over the query's."""
    words = [set(x.lower().split()) for x in queries]
    return [len(q & set(t.lower().split())) / max(1, len(q)) for q, t in zip(words, texts, strict=True)]


@query
def rerank(s, d):
    x = lexical_top(s, d).join(adapters.query_table(s, d).select("query_id", "query"), "query_id").join(table(s, d, "documents").select("doc_id", "text"), "doc_id")
    return retrieval.reranked(x.withColumn("score", F.col("lexical_score")), overlap_scores, 20)


@query
def chunk_search(s, d):
    """Documents cut by time, embedded by hashing, and searched exactly with the benchmark items."""
    # chunks are named by a hash of (doc_id, chunk_index), which is looked up again; cut and embedded once
    c = chunking.by_time(lines(s, d), 60, 15).select("doc_id", "chunk_index", F.xxhash64("doc_id", "chunk_index").alias("name"), F.col("raw_text").alias("text"))
    names, v = written(c.select("name", "doc_id", "chunk_index"), "chunk-names"), embedding.hash_embeddings(c.select(F.col("name").alias("doc_id"), "text"), 64)
    v = written(v.select(F.col("doc_id").alias("vec_id"), "embedding"), "chunk-vectors")
    q = embedding.hash_embeddings(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), 64).select(F.col("doc_id").alias("query_id"), "embedding")
    r = retrieval.dense_topk(v, q, 5)
    return r.withColumnRenamed("vec_id", "name").join(names, "name").select("query_id", "doc_id", "chunk_index", F.round("dense_score", 4).alias("score"), "rank")


QUERIES = dict(Q)
