"""Review shards and adjudication, study sections and samples, histories and logs."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.operators.retrieval import ranked


def sampled_positions(n: int, ratio: float = 0.15, seed: int = 7) -> list[int]:
    """Positions of one batch that a second shard reviews too: a reproducible sample."""
    return sorted(random.Random(seed).sample(range(n), min(n, max(0, round(n * ratio)))))


def review_shards(items: DataFrame, batch: str, order: list[Column], overlap: DataFrame | None = None, size: int = 50) -> DataFrame:
    """(batch, shard, item_id, role): items in order, `size` to a shard; overlap items (batch, item_id) also go to the next shard.

    With one shard nothing overlaps.
    """
    pos = F.row_number().over(Window.partitionBy(batch).orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(batch))
    d = items.select(batch, "item_id", pos.alias("pos"), n.alias("n")).withColumn("shards", F.ceil(F.col("n") / float(size)))
    d = d.withColumn("shard", F.floor(F.col("pos") / float(size)))
    out = d.select(batch, (F.col("shard") + 1).alias("shard"), "item_id", F.lit("primary").alias("role"))
    if overlap is None:
        return out
    more = d.join(overlap, [batch, "item_id"], "left_semi").where("shards > 1")
    return out.unionByName(more.select(batch, (F.pmod(F.col("shard") + 1, F.col("shards")) + 1).alias("shard"), "item_id", F.lit("overlap").alias("role")))


def adjudicated(recommendations: DataFrame) -> DataFrame:
    """(item_id, n, outcome, final_label): consensus of two or more confident reviewers is approved; a single one waits; else a case.

    recommendations: (item_id, recommended_label, confidence).
    """
    sure = F.min(F.col("confidence").isin("medium", "high").cast("int")) == 1
    label, n = F.min("recommended_label"), F.count(F.lit(1))
    agree = (n >= 2) & (F.min("recommended_label") == F.max("recommended_label")) & F.min("recommended_label").isin("relevant", "not_relevant") & sure
    g = recommendations.groupBy("item_id").agg(n.alias("n"), F.when(agree, "auto_approved").when(n == 1, "single_reviewer").otherwise("needs_adjudication").alias("outcome"), label.alias("l"))
    return g.select("item_id", "n", "outcome", F.when(F.col("outcome") == "auto_approved", F.col("l")).alias("final_label"))


def applied(recommendations: DataFrame) -> DataFrame:
    """(status, n): what applying recommendations (approved, final_label, recommended_label) would do."""
    label = F.coalesce("final_label", F.when(F.col("approved"), F.col("recommended_label")))
    status = F.when(~F.coalesce("approved", F.lit(False)), "skipped_unapproved").when(label == "unclear", "skipped_unclear").when(label.isin("relevant", "not_relevant"), "applied").otherwise("invalid")
    return recommendations.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def even_positions(n: Column, count: Column) -> Column:
    """round(i*(n-1)/(count-1)) for i below count, halves to even, each once; one position is the middle."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.bround(i * (n - 1) / F.greatest(count - 1, F.lit(1)).cast("double"), 0).cast("int")))
    return F.when(n <= 0, F.array().cast("array<int>")).when(count <= 1, F.array(F.floor(n / 2.0).cast("int"))).when(n <= count, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(many)


def grouped_sections(lines: DataFrame, groups: int = 5) -> DataFrame:
    """(doc_id, section, start_ds, end_ds, n_lines, text): contiguous groups of lines with bounds round(g*n/groups), halves to even."""
    d = lines.withColumn("n", F.size("lines")).where("n > 0").withColumn("k", F.least(F.lit(groups), F.col("n")))
    d = d.select("doc_id", "lines", "n", "k", F.explode(F.expr("sequence(0, k - 1)")).alias("section"))
    d = d.withColumn("lo", F.bround(F.col("section") * F.col("n") / F.col("k").cast("double"), 0).cast("int")).withColumn("hi", F.bround((F.col("section") + 1) * F.col("n") / F.col("k").cast("double"), 0).cast("int"))
    d = d.withColumn("part", F.expr("slice(lines, lo + 1, hi - lo)")).where("size(part) > 0")
    return d.select("doc_id", "section", F.expr("part[0].start_ds").alias("start_ds"), F.expr("part[size(part)-1].end_ds").alias("end_ds"), F.size("part").cast("long").alias("n_lines"), F.array_join(F.transform("part", lambda x: F.trim(x["text"])), " ").alias("text"))


def keywords(texts: DataFrame, k: int, min_chars: int = 4, max_chars: int = 18) -> DataFrame:
    """(doc_id, keyword, n, rank): tokens by count, the earlier first among equals; stop words and odd lengths left out."""
    tok = texts.select("doc_id", F.posexplode(T.latin_tokens(F.col("text"))).alias("pos", "keyword"))
    from tesselith.functions.vocab import STOP_WORDS

    tok = tok.where((F.length("keyword") >= min_chars) & (F.length("keyword") <= max_chars) & ~F.col("keyword").isin(*STOP_WORDS))
    g = tok.groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return ranked(g, "doc_id", [F.desc("n"), F.asc("first")], k).drop("first")


def section_scores(sections: DataFrame, terms: list[str], preset_terms: list[str], digits: int = 3) -> DataFrame:
    """sections (doc_id, section, text) with focus_score and query_match_count: 5 for a term that is a token, 2.5 for one inside."""
    low = F.lower("text")
    toks = T.latin_tokens(F.col("text"))
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    worth = lambda xs, w: F.aggregate(arr(xs), F.lit(0.0), lambda a, t: a + F.when(F.array_contains(toks, t), w).when(F.contains(low, t), w / 2).otherwise(0.0))
    hits = F.size(F.filter(arr(terms), lambda t: F.contains(low, t)))
    return sections.withColumns({"focus_score": F.round(worth(terms, 5.0) + worth(preset_terms, 0.5 if terms else 2.0), digits), "query_match_count": hits})


def selected_sections(scored: DataFrame, k: int) -> DataFrame:
    """The first k sections of a document: those that match by matches, score and place; without a match by score, or by place if none scores."""
    w = Window.partitionBy("doc_id")
    d = scored.withColumns({"m": F.max("query_match_count").over(w), "s": F.max("focus_score").over(w)})
    d = d.where((F.col("m") == 0) | (F.col("query_match_count") > 0))
    by_score = F.when((F.col("m") > 0) | (F.col("s") > 0), F.col("focus_score")).otherwise(0.0)
    return ranked(d, "doc_id", [F.desc("query_match_count"), F.desc(by_score), F.asc("section")], k).drop("m", "s")


def latest_jobs(log: DataFrame, job: str, order: list[Column]) -> DataFrame:
    return ranked(log, job, order, 1).drop("rank")


def log_rows(log: DataFrame, since: str | None = None, level: str | None = None, job=None) -> DataFrame:
    """Log lines by level, job and an ISO time compared as text."""
    if since:
        log = log.where(F.col("ts") >= since)
    if level:
        log = log.where(F.col("level") == level)
    return log.where(F.col("job_id") == job) if job is not None else log


def bounded_history(rows: DataFrame, by: str, order: list[Column], keep: int = 20) -> DataFrame:
    return ranked(rows, by, order, keep)


def merged_sources(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Channel metadata of (doc_id, provider, channel_id, channel_name, fetched_at) refreshed.

    An update counts for provider and time if it is useful (not fallback or legacy, or with a channel) and of no lower
    priority; a channel field comes from the update if it has one.
    """
    from itertools import chain

    rank = {"data_api": 2, "oembed": 1, "fallback": 0, "legacy": 0}
    prio = lambda c: F.coalesce(F.create_map(*[F.lit(x) for x in chain(*rank.items())])[c], F.lit(0))
    i = incoming.select("doc_id", *[F.col(c).alias(f"new_{c}") for c in ("provider", "channel_id", "channel_name", "fetched_at")])
    d = current.join(i, "doc_id", "left")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    useful = ~F.col("new_provider").isin("fallback", "legacy") | blank("new_channel_id").isNotNull() | blank("new_channel_name").isNotNull()
    take = F.coalesce(useful & (prio(F.col("new_provider")) >= prio(F.col("provider"))), F.lit(False))
    return d.select(
        "doc_id", F.when(take, F.col("new_provider")).otherwise(F.col("provider")).alias("provider"), F.coalesce(blank("new_channel_id"), blank("channel_id")).alias("channel_id"),
        F.coalesce(blank("new_channel_name"), blank("channel_name")).alias("channel_name"), F.when(take, F.col("new_fetched_at")).otherwise(F.col("fetched_at")).alias("fetched_at"),
    )


def anchors_resolved(items: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, item, segment_index, source): each item's anchor text placed at the best segment.

    items: (doc_id, items array<struct<item, anchor, at_ds>>). Exact containment, else at least 0.55 of the anchor's tokens; nearer to
    the item's time is better, reuse of a segment worse; a fold over the items of a document, in Python by row.
    """
    import re
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norm = lambda t: re.sub(r"[^\w぀-ヿ㐀-鿿]+", "", t.lower())
        toks = lambda t: set(re.findall(r"[a-z0-9_]+", t.lower()))
        for f in frames:
            out = []
            for doc, its, segs in zip(f.doc_id, f["items"], f.lines, strict=True):
                used: dict[int, int] = {}
                texts, sets = [norm(s["text"]) for s in segs], [toks(s["text"]) for s in segs]
                for it in its:
                    a, want, best = norm(it["anchor"] or ""), toks(it["anchor"] or ""), None
                    worth = lambda i, m: 2.5 * m - abs(segs[i]["start_ds"] - it["at_ds"]) / 200.0 - 2.0 * used.get(i, 0) - 1e-4 * i  # noqa: B023, E731
                    exact = [i for i, t in enumerate(texts) if len(it["anchor"] or "") >= 8 and a and a in t]
                    if exact:
                        best = max(exact, key=lambda i: worth(i, 1.0))
                    elif want:
                        near = [(worth(i, len(want & s) / len(want)), -i, len(want & s) / len(want)) for i, s in enumerate(sets) if want & s]
                        if near and max(near)[2] >= 0.55:
                            best = -max(near)[1]
                    if best is not None:
                        used[best] = used.get(best, 0) + 1
                    out.append((doc, it["item"], best, "anchor_match" if best is not None else "model_fallback"))
            yield pd.DataFrame(out, columns=["doc_id", "item", "segment_index", "source"]).astype({"segment_index": "Int64"})

    return items.join(lines.select("doc_id", "lines"), "doc_id").select("doc_id", "items", "lines").mapInPandas(run, "doc_id long, item long, segment_index long, source string")


def review_items(results: DataFrame) -> DataFrame:
    """(review_item_id, feedback_key, query, timestamp_label, rank, score) of results (query, source, chunk_index, start, end, rank, score); without a source none."""
    q = T.clean(F.col("query"))
    key = T.chunk_key(F.col("source"), F.col("chunk_index"), F.col("start"), F.greatest("start", F.coalesce("end", "start")))
    d = results.where(F.trim(F.coalesce("source", F.lit(""))) != "").withColumn("feedback_key", key)
    return d.select(F.concat(F.substring(F.sha1(q), 1, 10), F.lit(":"), "feedback_key").alias("review_item_id"), "feedback_key", q.alias("query"), T.clock(F.col("start")).alias("timestamp_label"), "rank", "score")


def normalised_recommendations(rows: DataFrame) -> DataFrame:
    """Recommendations with their fields from the row or else its source: (review_item_id, query, source, recommended_label, final_label, confidence, approved).

    rows: these, nullable strings (approved boolean), and `ref`, a struct of review_item_id, query and source. Without a known label, an id, a query or a source a row goes.
    """
    blank = lambda c: F.nullif(T.clean(c), F.lit(""))
    either = lambda n: F.coalesce(blank(F.col(n)), blank(F.col("ref").getField(n)))
    label = lambda c: F.when(F.lower(T.clean(c)).isin("relevant", "not_relevant", "unclear"), F.lower(T.clean(c)))
    final = label(F.col("final_label"))
    sure = F.lower(T.clean(F.col("confidence")))
    d = rows.select(
        either("review_item_id").alias("review_item_id"), either("query").alias("query"), either("source").alias("source"),
        label(F.coalesce(blank(F.col("recommended_label")), blank(F.col("final_label")))).alias("recommended_label"), final.alias("final_label"),
        F.when(sure.isin("low", "medium", "high"), sure).otherwise("low").alias("confidence"), F.coalesce("approved", F.lit(False)).alias("approved"),
    )
    return d.where("recommended_label is not null and review_item_id is not null and query is not null and source is not null")


def in_review_order(items: DataFrame) -> DataFrame:
    """Review items (query_index, query, rank, review_item_id, …) with `place` from 1: by their query's number, its text in any case, rank and id.

    The window is of one query's items: a batch has few queries, each with few results.
    """
    before = items.groupBy("query_index").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("query_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("query_index").orderBy(F.lower("query"), F.coalesce("rank", F.lit(0)), "review_item_id"))
    return items.join(before.select("query_index", "before"), "query_index").withColumn("place", F.col("before") + own).drop("before")


def feedback_payloads(recommendations: DataFrame) -> DataFrame:
    """(review_item_id, query, source, label): what is stored of normalised recommendations that are approved or have a final label; unclear ones aren't."""
    label = F.coalesce("final_label", F.when(F.col("approved"), F.col("recommended_label")))
    return recommendations.select("review_item_id", "query", "source", label.alias("label")).where(F.col("label").isin("relevant", "not_relevant"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(label, n, place): values by count, those of equal counts by name; a null is 'unknown'."""
    g = rows.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("label"))).cast("long"))


def ask_records(rows: DataFrame) -> DataFrame:
    """Ask-history records in their normal form; those without a video or question go.

    rows: (id, doc_id, question, answer, k, retrieval_mode, provider, status, confidence, created_at), all nullable. Modes and providers are lower-cased; an unknown
    status is answered, an unknown confidence low; k is 1 at least.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    low = lambda c, d: F.lower(F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))))
    held = lambda c, known, d: F.when(low(c, d).isin(*known), low(c, d)).otherwise(d)
    d = rows.select(
        "id", "doc_id", text("question").alias("question"), text("answer").alias("answer"), F.greatest(F.lit(1), F.coalesce(F.nullif(F.col("k"), F.lit(0)), F.lit(5))).cast("long").alias("k"),
        low("retrieval_mode", "hybrid").alias("retrieval_mode"), held("status", ["answered", "insufficient_evidence", "error"], "answered").alias("status"), held("confidence", ["low", "medium", "high"], "low").alias("confidence"), "created_at",
    )
    return d.where("doc_id is not null and question <> ''")
