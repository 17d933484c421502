"""Context windows, evidence sufficiency, citations, the tool policy and routing of queries to sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.functions import vocab as V
from tesselith.operators.retrieval import HELD, dense_ranks, dense_topk, overlap_best, overlap_ranks, overlap_rows, overlap_topk, ranked
from tesselith.sources.scratch import written


def read_context(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """(doc_id, at_ds, status, requested_start, requested_end, start, end, segment_count, text) for requests (doc_id, at_ds, window_ds).

    Segments that touch the window, clamped to the transcript; 'out_of_bounds' outside it, 'no_transcript' without lines.
    """
    d = requests.join(lines.select("doc_id", "lines"), "doc_id")
    lo, hi = F.array_min(F.transform("lines", lambda x: F.least(x["start_ds"], x["end_ds"]))), F.array_max(F.transform("lines", lambda x: F.greatest(x["start_ds"], x["end_ds"])))
    d = d.withColumns({"lo": lo, "hi": hi})
    d = d.withColumn("status", F.when(F.size("lines") == 0, "no_transcript").when((F.col("at_ds") < F.col("lo")) | (F.col("at_ds") > F.col("hi")), "out_of_bounds").otherwise("ok"))
    d = d.withColumns({"rs": F.greatest("lo", F.col("at_ds") - F.col("window_ds")), "re": F.least("hi", F.col("at_ds") + F.col("window_ds"))})
    d = d.withColumn("hit", F.expr("if(status = 'ok', filter(lines, x -> greatest(x.start_ds, x.end_ds) >= rs and least(x.start_ds, x.end_ds) <= re), filter(lines, x -> false))"))
    ok = F.col("status") == "ok"
    return d.select(
        "doc_id", "at_ds", "status", F.when(ok, F.col("rs")).alias("requested_start"), F.when(ok, F.col("re")).alias("requested_end"),
        F.array_min(F.transform("hit", lambda x: F.least(x["start_ds"], x["end_ds"]))).alias("start"), F.array_max(F.transform("hit", lambda x: F.greatest(x["start_ds"], x["end_ds"]))).alias("end"),
        F.size("hit").cast("long").alias("segment_count"), F.array_join(F.transform("hit", lambda x: F.trim(x["text"])), "\n").alias("text"),
    )


def nearest(anchors: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, anchor, ord, apart): the segment whose start is nearest to each anchor (doc_id, anchor, at_ds), the first of equals.

    The last segment at or before the anchor and the first after it, by running windows over both tables together: no pairs.
    """
    rows = segments.select("doc_id", F.col("start_ds").alias("t"), F.lit(0).alias("kind"), F.struct("start_ds", "ord").alias("s"), F.lit(None).cast("long").alias("anchor"))
    rows = rows.unionByName(anchors.select("doc_id", F.col("at_ds").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["s"].dataType).alias("s"), F.col("anchor").cast("long").alias("anchor")))
    w = Window.partitionBy("doc_id")
    before = F.max("s").over(w.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    after = F.min("s").over(w.orderBy(F.desc("t"), F.asc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    d = rows.withColumns({"p": before, "n": after}).where("kind = 1")
    side = lambda c, a: F.when(F.col(c).isNotNull(), F.struct(a.alias("apart"), F.col(f"{c}.ord").alias("ord")))
    pick = F.least(side("p", F.col("t") - F.col("p.start_ds")), side("n", F.col("n.start_ds") - F.col("t")))
    return d.select("doc_id", "anchor", pick["ord"].alias("ord"), pick["apart"].alias("apart"))


def assessed(rows: DataFrame, mode: str, query_language: Column | None = None, digits: int = 6) -> DataFrame:
    """(query_id, sufficient, confidence_cap, reason_code, top_strength) of retrieved rows.

    rows: (query_id, rank, query_tokens, row_tokens, dense_score, lexical_score[, language]). A row in another language than the query's, with
    a dense score, is judged by that in place of token overlap.
    """
    w = Window.partitionBy("query_id")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    top = F.max(F.coalesce("lexical_score", F.lit(0.0))).over(w)
    q = F.array_distinct("query_tokens")
    d = rows.withColumn("overlap", F.size(F.array_intersect(q, F.col("row_tokens"))) / F.greatest(F.size(q), F.lit(1)))
    dense = F.when(F.col("dense_score").isNull(), 0.0).otherwise(clamp((F.col("dense_score") - 0.55) / 0.30))
    lexical = F.when(F.col("lexical_score").isNull() | (top <= 0), 0.0).otherwise(clamp(F.col("lexical_score") / top))
    d = d.withColumns({"rs": clamp(1.0 - (F.col("rank") - 1) / 5.0), "ds": dense, "ls": lexical, "os": clamp(F.col("overlap") / 0.6)})
    cross = (F.col("language") != query_language) & F.col("dense_score").isNotNull() if query_language is not None and mode in ("dense", "hybrid") else F.lit(False)
    uses = [(F.lit(0.15), F.col("rs")), (F.when(cross, 0.0).otherwise(0.45), F.col("os"))]
    if mode in ("dense", "hybrid"):
        uses.append((F.lit(0.25), F.col("ds")))
    if mode in ("lexical", "hybrid"):
        uses.append((F.lit(0.15), F.col("ls")))
    total, weight = F.lit(0.0), F.lit(0.0)
    for wt, signal in uses:
        total, weight = total + wt * signal, weight + wt
    d = d.withColumn("strength", F.round(total / weight, digits)).withColumn("eff", F.when(cross, F.col("ds")).otherwise(F.col("overlap")))
    g = d.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("strength", (-F.col("rank")).alias("r"), "eff")), asc=False).alias("a"))
    g = g.withColumn("support", F.filter("a", lambda x: (x["strength"] >= 0.55) & (x["eff"] >= 0.18)))
    first, second = F.col("a")[0], F.get("a", F.lit(1))
    many = F.size("support") >= 2
    high = (first["strength"] >= 0.78) & (F.get("support", F.lit(1))["strength"] >= 0.60)
    single = (first["strength"] >= 0.72) & (first["eff"] >= 0.28) & F.coalesce(second["strength"] < 0.48, F.lit(True))
    return g.select(
        "query_id", (many | single).alias("sufficient"), F.when(many & high, "high").when(many | single, "medium").otherwise("low").alias("confidence_cap"),
        F.when(many, "multi_chunk_support").when(single, "strong_single_chunk").when(F.size("a") == 1, "single_weak_chunk").when(second["strength"] >= 0.45, "mixed_signals").otherwise("thin_support").alias("reason_code"),
        first["strength"].alias("top_strength"),
    )


def with_no_results(assessment: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries without rows, as no_results."""
    d = queries.select("query_id").join(assessment, "query_id", "left")
    return d.select("query_id", F.coalesce("sufficient", F.lit(False)).alias("sufficient"), F.coalesce("confidence_cap", F.lit("low")).alias("confidence_cap"), F.coalesce("reason_code", F.lit("no_results")).alias("reason_code"), "top_strength")


def tool_choice(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, tool, attempts) from two assessed tools (query_id, tool, sufficient, n_rows): the first if sufficient, else the sufficient one, then the one with more rows."""
    b = second.select("query_id", F.col("tool").alias("tool2"), F.col("sufficient").alias("s2"), F.col("n_rows").alias("n2"))
    d = first.join(b, "query_id", "left")
    use2 = ~F.col("sufficient") & (F.coalesce("s2", F.lit(False)) | (F.coalesce("n2", F.lit(0)) > F.col("n_rows")))
    return d.select("query_id", F.when(use2, F.col("tool2")).otherwise(F.col("tool")).alias("tool"), F.when(F.col("sufficient"), 1).otherwise(2).alias("attempts"))


def capped_confidence(confidence: Column, cap: Column) -> Column:
    order = lambda c: F.coalesce(F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.lower(F.trim(c))), F.lit(0))
    n = F.greatest(F.lit(1), F.least(order(confidence), order(cap)))
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), n.cast("int"))


def citations(rows: DataFrame) -> DataFrame:
    """(query_id, citation_id, doc_id, label, snippet, reason, url) of rows (query_id, rank, doc_id, start, end, text, url).

    Ids count all rows in rank order, then rows without a source are left out.
    """
    d = rows.withColumn("citation_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("doc_id is not null")
    return d.select("query_id", "citation_id", "doc_id", T.clock_range(F.col("start"), F.col("end")).alias("label"), T.snippet(F.col("text"), 240).alias("snippet"), F.format_string("Retrieved chunk #%d for the question.", F.col("rank")).alias("reason"), T.timed_url(F.col("url"), F.col("start")).alias("url"))


def profiles(lines: DataFrame, titles: DataFrame | None = None, max_sections: int = 5, overview_chars: int = 2400, section_chars: int = 1800, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, title, overview, sections, lexical_text[, keep]): what a source is routed by. A text's lines are its chunks.

    Sections cut the lines at floor(g*n/k); the overview takes up to 8 lines at floor(i*n/8). All within the row. Without titles, lines have a title and the columns
    to keep beside them, and nothing is shuffled; rows without an id are left out either way.
    """
    if titles is None:
        d = lines.select("doc_id", "title", "lines", *keep).where("doc_id is not null")
    else:
        d = titles.select("doc_id", "title").join(lines.select("doc_id", "lines", *keep), "doc_id")
    # the sequences end before they begin without lines
    d = d.withColumn("n", F.size("lines")).withColumn("k", F.least(F.lit(max_sections), F.size("lines"))).withColumn("m", F.least(F.lit(8), F.size("lines")))
    over = F.expr(f"if(n = 0, '', rtrim(substring(array_join(transform(sequence(0, greatest(m, 1) - 1), i -> trim(regexp_replace(lines[int(i * n div m)].text, '(?U)\\\\s+', ' '))), ' '), 1, {overview_chars})))")
    d = d.withColumn("overview", F.when(over == "", F.col("title")).otherwise(over))
    sections = F.expr(f"""if(n = 0, cast(array() as array<struct<idx:int,start_ds:bigint,end_ds:bigint,text:string>>),
        transform(sequence(0, greatest(k, 1) - 1), g -> named_struct('idx', g, 'start_ds', lines[int(g * n div k)].start_ds, 'end_ds', lines[int((g + 1) * n div k) - 1].end_ds,
          'text', rtrim(substring(array_join(transform(slice(lines, int(g * n div k) + 1, int((g + 1) * n div k) - int(g * n div k)), x -> trim(regexp_replace(x.text, '(?U)\\\\s+', ' '))), ' '), 1, {section_chars})))))""")
    d = d.withColumn("sections", sections)
    return d.select("doc_id", "title", "overview", "sections", F.concat_ws("\n", "title", "overview", F.array_join(F.transform("sections", lambda s: s["text"]), "\n")).alias("lexical_text"), *keep)


def multi_vector_scores(hits: DataFrame, digits: int = 9) -> DataFrame:
    """(query_id, source_id, dense_score): 0.7 and 0.3 of the best two vectors, then 0.85 of that and 0.15 of the identity vector.

    hits: (query_id, source_id, vector_type, score). A source with one vector takes its score; one without an identity vector
    its own. No more than the best two are gathered.
    """
    best = ranked(hits, ["query_id", "source_id"], [F.desc("score")], 2)
    two = best.groupBy("query_id", "source_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"))
    one = hits.where("vector_type = 'identity'").groupBy("query_id", "source_id").agg(F.max("score").alias("identity"))
    mv = F.when(F.col("s2").isNull(), F.col("s1")).otherwise(0.7 * F.col("s1") + 0.3 * F.col("s2"))
    d = two.join(one, ["query_id", "source_id"], "left").withColumn("mv", mv)
    return d.select("query_id", "source_id", F.round(0.85 * F.col("mv") + 0.15 * F.coalesce("identity", "mv"), digits).alias("dense_score"))


def lexical_overlap(queries: DataFrame, sources: DataFrame, digits: int = 6, k: int | None = None) -> DataFrame:
    """(query_id, source_id, lexical_score): shared tokens over the root of the product of the set sizes, by a join on tokens.

    queries: (query_id, tokens); sources: (source_id, tokens); both arrays distinct. With k only each query's first k, ties by source_id, where they can be counted within a source's row: no pairs are shuffled.
    """
    if k and (best := overlap_topk(queries, sources, k, digits)) is not None:
        return best
    q = queries.select("query_id", F.size("tokens").alias("qn"), F.explode("tokens").alias("t"))
    s = sources.select("source_id", F.size("tokens").alias("sn"), F.explode("tokens").alias("t"))
    g = s.join(q, "t").groupBy("query_id", "source_id").agg(F.count(F.lit(1)).alias("n"), F.first("qn").alias("qn"), F.first("sn").alias("sn"))
    return g.select("query_id", "source_id", F.round(F.col("n") / F.sqrt(F.col("qn").cast("double") * F.col("sn")), digits).alias("lexical_score"))


def routed(dense: DataFrame | None, lexical: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, source_id, score, dense_score, lexical_score, rank): ranks fused, and 0.02 of the lexical score added."""
    x = ranked(lexical, "query_id", [F.desc("lexical_score"), F.asc("source_id")], None, "lr")
    if dense is None:
        d = x.withColumn("dense_score", F.lit(None).cast("double")).withColumn("dr", F.lit(None).cast("int"))
    else:
        d = ranked(dense, "query_id", [F.desc("dense_score"), F.asc("source_id")], None, "dr").join(x, ["query_id", "source_id"], "full")
    return _fused_routes(d, k, digits)


def _fused_routes(d: DataFrame, k: int, digits: int) -> DataFrame:
    part = F.coalesce(1.0 / (V.RRF_K + F.col("dr")), F.lit(0.0)) + F.coalesce(1.0 / (V.RRF_K + F.col("lr")) + 0.02 * F.col("lexical_score"), F.lit(0.0))
    d = d.withColumn("score", F.round(part, digits)).drop("dr", "lr")
    return ranked(d, "query_id", [F.desc("score"), F.asc("source_id")], k)


def routed_search(vectors: DataFrame, vector_queries: DataFrame, sources: DataFrame, token_queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """routed() of all dense scores of vectors (vec_id, embedding) by vector_queries (query_id, embedding) and of lexical_overlap() of token_queries and sources; a vector's id is its source's.

    Only the first 2 * (RRF_K + k) of a side can be among the first k: a source beyond them on both sides has less than twice 1 / (2 * (RRF_K + k)) and no larger lexical score than the first k of a side,
    each of which has 1 / (RRF_K + k) or more. Those candidates' ranks on the other side are counted among all sources, so no task holds a row for each query and source.
    With more than HELD candidates, ids that repeat or are null, or a k so large that rounding might hide the difference, all pairs are ranked.
    """
    whole = lambda: routed(dense_topk(vectors, vector_queries, None).select("query_id", F.col("vec_id").alias("source_id"), "dense_score"), lexical_overlap(token_queries, sources), k, digits)
    once = lambda rows, c: rows.groupBy(c).count().where(f"count > 1 or {c} is null").isEmpty()
    if k > 1000 or not once(vectors, "vec_id") or not once(vector_queries, "query_id") or (counted := overlap_rows(token_queries, sources)) is None:
        return whole()
    most, pair = 2 * (V.RRF_K + k), ["query_id", "source_id"]
    dense = written(dense_topk(vectors, vector_queries, most).withColumnsRenamed({"vec_id": "source_id", "rank": "dr"}), "routed-dense")
    lexical = written(ranked(overlap_best(*counted, most), "query_id", [F.desc("lexical_score"), F.asc("source_id")], None, "lr"), "routed-lexical")
    if max(dense.count(), lexical.count()) > HELD:
        return whole()
    more = dense_ranks(vectors, vector_queries, lexical.join(dense, pair, "left_anti").select("query_id", F.col("source_id").alias("vec_id")))
    other = overlap_ranks(*counted, dense.join(lexical, pair, "left_anti").select(*pair))
    dense = dense.unionByName(more.withColumnsRenamed({"vec_id": "source_id", "rank": "dr"}))
    lexical = lexical.unionByName(other.withColumnRenamed("rank", "lr"))
    return _fused_routes(dense.join(lexical, pair, "full"), k, digits)


def routed_variants(variants: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Fusion of rankings of language variants (query_id, kind, source_id, rank, lexical_score); translated ones weigh a tenth more."""
    w = F.when(F.col("kind") == "translated", 1.1).otherwise(1.0)
    g = variants.groupBy("query_id", "source_id").agg(F.round(F.sum(w * (1.0 / (V.RRF_K + F.col("rank")) + 0.02 * F.coalesce("lexical_score", F.lit(0.0)))), digits).alias("score"), F.count(F.lit(1)).alias("hits"))
    return ranked(g, "query_id", [F.desc("score"), F.asc("source_id")], k)
