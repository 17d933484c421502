"""Evaluation of ranked results against gold evidence, runs, thresholds, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether intervals share more than a point; reversed ends are swapped, nulls don't overlap."""
    return F.coalesce(F.greatest(F.least(s1, e1), F.least(s2, e2)) < F.least(F.greatest(s1, e1), F.greatest(s2, e2)), F.lit(False))


def query_scores(results: DataFrame, gold: DataFrame, queries: DataFrame, cuts: tuple[int, ...] = (1, 5, 10), digits: int = 6) -> DataFrame:
    """A row per query of `queries`: p_k, r_k, mrr, ndcg (the last two at the largest cut). Queries without gold score 0.

    results: (query_id, doc_id, rank); gold: (query_id, doc_id), one row a piece of evidence. Precision counts every relevant
    row, recall and nDCG a piece of gold once.
    """
    top = max(cuts)
    g = gold.select("query_id", "doc_id").distinct()
    size = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    hits = results.where(F.col("rank") <= top).join(g, ["query_id", "doc_id"], "left_semi")
    first = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"), *[F.count_if(F.col("rank") <= k).alias(f"rows_{k}") for k in cuts])
    h = first.groupBy("query_id").agg(
        *[F.sum(f"rows_{k}").alias(f"h_{k}") for k in cuts], *[F.count_if(F.col("rank") <= k).alias(f"g_{k}") for k in cuts],
        F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    d = queries.select("query_id").join(size, "query_id", "left").join(h, "query_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(top)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return d.select(
        "query_id", *[F.round(z(F.col(f"h_{k}") / float(k)), digits).alias(f"p_{k}") for k in cuts], *[F.round(z(F.col(f"g_{k}") / F.col("n_gold")), digits).alias(f"r_{k}") for k in cuts],
        F.round(z(1.0 / F.col("first")), digits).alias("mrr"), F.round(z(F.col("dcg") / F.when(F.col("n_gold") > 0, ideal)), digits).alias("ndcg"),
    )


def interval_scores(results: DataFrame, gold: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, recall, ndcg) with gold by chunk or interval: each row takes the first gold still free that it matches.

    results: (query_id, doc_id, chunk_index, start, end, rank); gold: (query_id, gold_id, doc_id, chunk_index, start, end). A fold
    over the first k rows of a query.
    """
    r = results.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "chunk_index", "start", "end"))).alias("rows"))
    g = gold.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("gold_id", "doc_id", "chunk_index", "start", "end"))).alias("gold"))
    d = g.join(r, "query_id", "left").withColumn("rows", F.expr("coalesce(rows, array())"))
    hit = """filter(gold, x -> not array_contains(a.used, x.gold_id) and x.doc_id = r.doc_id and
        if(x.chunk_index is not null and r.chunk_index is not null, x.chunk_index = r.chunk_index,
           coalesce(greatest(least(x.start, x.end), least(r.start, r.end)) < least(greatest(x.start, x.end), greatest(r.start, r.end)), false)))"""
    fold = f"""aggregate(rows, named_struct('used', cast(array() as array<bigint>), 'dcg', 0D), (a, r) ->
        transform(array({hit}), m -> if(size(m) > 0, named_struct('used', array_append(a.used, m[0].gold_id), 'dcg', a.dcg + 1 / log2(r.rank + 1)), a))[0])"""
    d = d.withColumn("f", F.expr(fold))
    ideal = F.expr(f"aggregate(sequence(1, least(size(gold), {k})), 0D, (a, i) -> a + 1 / log2(i + 1))")
    return d.select("query_id", F.round(F.size("f.used") / F.size("gold"), digits).alias("recall"), F.round(F.col("f.dcg") / ideal, digits).alias("ndcg"))


def labelled_scores(items: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, precision, recall, mrr, ndcg) where labels decide relevance; recall is null without a relevant label.

    items: (query_id, rank, label). The ideal order is that of the whole list returned.
    """
    rel = F.col("label") == "relevant"
    d = items.withColumn("rel", F.coalesce(rel, F.lit(False)).cast("int"))
    d = d.withColumn("ideal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank")))
    gain = lambda r: F.sum(F.when((F.col(r) <= k) & (F.col("rel") == 1), 1 / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    g = d.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias("h"), F.sum("rel").alias("n"), F.min(F.when((F.col("rel") == 1) & (F.col("rank") <= k), F.col("rank"))).alias("first"), gain("rank").alias("dcg"), gain("ideal").alias("idcg")
    )
    return g.select(
        "query_id", F.round(F.col("h") / float(k), digits).alias("precision"), F.round(F.col("h") / F.nullif("n", F.lit(0)), digits).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), digits).alias("mrr"), F.round(F.coalesce(F.col("dcg") / F.when(F.col("idcg") > 0, F.col("idcg")), F.lit(0.0)), digits).alias("ndcg"),
    )


def run_summary(scores: DataFrame, latencies: DataFrame, metrics: list[str], digits: int = 6) -> DataFrame:
    """A row per run: means of the metrics over its scored queries (0 without any), latency mean and p95, failed queries.

    scores: (run, query_id, metrics); latencies: (run, latency_ms, failed).
    """
    q = scores.groupBy("run").agg(*[F.avg(m).alias(m) for m in metrics])
    t = latencies.groupBy("run").agg(F.avg("latency_ms").alias("mean_latency_ms"), F.sum(F.col("failed").cast("long")).alias("failed_query_count"))
    t = t.join(percentiles(latencies, "run", "latency_ms", {"p95_latency_ms": 0.95}, digits), "run")
    d = t.join(q, "run", "left")
    return d.select("run", *[F.round(F.coalesce(m, F.lit(0.0)), digits).alias(m) for m in metrics], F.round("mean_latency_ms", digits).alias("mean_latency_ms"), "p95_latency_ms", "failed_query_count")


def with_quality(runs: DataFrame, digits: int = 6) -> DataFrame:
    """Runs with quality = 0.40 r_5 + 0.35 mrr + 0.25 ndcg, and `selected`: the best without failures; ties by p95, then the later name."""
    d = runs.withColumn("quality", F.round(0.40 * F.col("r_5") + 0.35 * F.col("mrr") + 0.25 * F.col("ndcg"), digits))
    best = F.max(F.when(F.col("failed_query_count") == 0, F.struct("quality", (-F.col("p95_latency_ms")).alias("l"), "run"))).over(Window.partitionBy(F.lit(0)))
    return d.withColumn("selected", F.coalesce(best["run"] == F.col("run"), F.lit(False)))


def threshold_checks(base: DataFrame, candidates: DataFrame, targets: dict[str, tuple[float, float]], n_queries: int | Column, min_relative: int = 20, latency_rise: float = 0.20, allowed_failed: int = 0, digits: int = 6) -> DataFrame:
    """(run, metric, baseline, candidate, passed): targets are metric -> (absolute, relative); few queries check the absolute only.

    base: one run; candidates: runs. A rise over a baseline of 0 is infinite.
    """
    b = base.select(*[F.col(m).alias(f"b_{m}") for m in targets], F.col("p95_latency_ms").alias("b_p95"), F.lit(0).alias("one"))
    d = candidates.withColumn("one", F.lit(0)).join(F.broadcast(b), "one")  # one row
    rows = []
    for m, (absolute, relative) in targets.items():
        c, o = F.col(m), F.col(f"b_{m}")
        rise = F.when(o == 0, F.when(c > 0, float("inf")).otherwise(0.0)).otherwise((c - o) / F.abs(o))
        ok = (c >= absolute) | ((F.lit(n_queries) >= min_relative) & (rise >= relative))
        rows.append(F.struct(F.lit(m).alias("metric"), o.alias("baseline"), c.alias("candidate"), ok.alias("passed")))
    p95 = F.col("p95_latency_ms")
    rows.append(F.struct(F.lit("p95_latency_ms").alias("metric"), F.col("b_p95").alias("baseline"), p95.alias("candidate"), ((F.col("b_p95") <= 0) | (p95 <= F.col("b_p95") * (1 + latency_rise))).alias("passed")))
    failed = F.col("failed_query_count")
    rows.append(F.struct(F.lit("failed_query_count").alias("metric"), F.lit(float(allowed_failed)).alias("baseline"), failed.cast("double").alias("candidate"), (failed <= allowed_failed).alias("passed")))
    return d.select("run", F.explode(F.array(*rows)).alias("c")).select("run", "c.metric", F.round("c.baseline", digits).alias("baseline"), F.round("c.candidate", digits).alias("candidate"), "c.passed")


def compared(a: DataFrame, b: DataFrame, metrics: list[str], digits: int = 6) -> DataFrame:
    """(query, deltas): runs of one query text, trimmed; null where a side is null."""
    side = lambda d, p: d.select(F.trim("query").alias("query"), *[F.col(m).alias(f"{p}_{m}") for m in metrics])
    d = side(a, "a").join(side(b, "b"), "query")
    return d.select("query", *[F.round(F.col(f"b_{m}") - F.col(f"a_{m}"), digits).alias(f"delta_{m}") for m in metrics])


def routing_scores(predictions: DataFrame, cases: DataFrame, digits: int = 6) -> DataFrame:
    """A row per case: coverage, recall at 1, 3 and 5, mrr, distractor_error.

    predictions: (query_id, ranked array); cases: (query_id, relevant array, distractors array). Cases without a prediction are
    missing, with an empty ranking; the error is null without distractors, and true if one stands before all relevant ids.
    """
    d = cases.join(predictions, "query_id", "left").withColumn("status", F.when(F.col("ranked").isNull(), "missing").otherwise("scored"))
    d = d.withColumn("ranked", F.expr("coalesce(ranked, array())")).withColumn("relevant", F.array_distinct("relevant"))
    recall = lambda k: F.round(F.coalesce(F.size(F.array_intersect("relevant", F.slice("ranked", 1, k))) / F.nullif(F.size("relevant"), F.lit(0)), F.lit(0.0)), digits)
    first = lambda c: F.expr(f"array_min(filter(transform({c}, x -> array_position(ranked, x)), p -> p > 0))")
    d = d.withColumn("fr", first("relevant")).withColumn("fd", first("distractors"))
    return d.select(
        "query_id", "status", *[recall(k).alias(f"recall_{k}") for k in (1, 3, 5)], F.round(F.coalesce(1.0 / F.col("fr"), F.lit(0.0)), digits).alias("mrr"),
        F.when(F.size("distractors") > 0, F.coalesce(F.col("fd") < F.coalesce("fr", F.lit(1 << 40)), F.lit(False))).alias("distractor_error"),
    )


def routing_report(scores: DataFrame, digits: int = 6) -> DataFrame:
    """One row: counts, coverage and means (null without scored cases)."""
    s = F.col("status") == "scored"
    d = scores.agg(F.count(F.lit(1)).alias("n"), F.count_if(s).alias("scored"), *[F.round(F.avg(F.when(s, F.col(c))), digits).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")], F.round(F.avg(F.when(s, F.col("distractor_error").cast("double"))), digits).alias("distractor_error_rate"))
    return d.withColumn("coverage", F.when(F.col("scored") == 0, "empty").when(F.col("scored") < F.col("n"), "partial").otherwise("complete"))


#: Ranks on either side of a percentile that are looked at, as a share of the group; sketches err by a tenth of it at most.
BRACKET, ACCURACY = 0.001, 10_000


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], digits: int = 6) -> DataFrame:
    """(by, *shares): percentiles of the values that aren't null, interpolated between neighbours; null in a group without any.

    Exact, without sorting groups: mergeable sketches give a bracket around each percentile, values below it are counted, and only those inside, a five-hundredth of a
    large group, are numbered. Of groups of less than ACCURACY values the sketch holds all.
    """
    names = list(shares)
    d = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("group"), F.col(value).cast("double").alias("v"))
    ends = [min(1.0, max(0.0, q + e)) for q in shares.values() for e in (-BRACKET, BRACKET)]
    g = d.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("ends"))
    # a small sketch may end a bracket between the two neighbours that are interpolated: the neighbours beyond are counted and kept as well
    x = d.join(g, "group")
    low, high = (lambda i: F.get("ends", F.lit(2 * i))), (lambda i: F.get("ends", F.lit(2 * i + 1)))
    around = x.groupBy("group").agg(
        *[F.count_if(F.col("v") < low(i)).alias(f"below_{i}") for i in range(len(names))], *[F.max(F.when(F.col("v") < low(i), F.col("v"))).alias(f"before_{i}") for i in range(len(names))],
        *[F.count_if(F.col("v") <= high(i)).alias(f"to_{i}") for i in range(len(names))], *[F.min(F.when(F.col("v") > high(i), F.col("v"))).alias(f"after_{i}") for i in range(len(names))],
    )
    inside = F.filter(F.array(*[F.when((F.col("v") >= low(i)) & (F.col("v") <= high(i)), F.lit(i)) for i in range(len(names))]), lambda k: k.isNotNull())
    few = x.select("group", "n", "v", F.explode(inside).alias("k"))
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("group", "k").orderBy("v")) - 1).join(around, "group")
    of = lambda name: F.element_at(F.array(*[F.col(f"{name}_{i}") for i in range(len(names))]), F.col("k") + 1)
    spot = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(q)) for q in shares.values()]), F.col("k") + 1)
    few = few.withColumns({"at": of("below") + F.col("place"), "spot": spot, "before": of("before"), "below": of("below"), "after": of("after"), "to": of("to")})
    pick = lambda c: F.coalesce(F.max(F.when(c == F.col("at"), F.col("v"))), F.max(F.when(c == F.col("below") - 1, F.col("before"))), F.max(F.when(c == F.col("to"), F.col("after"))), F.raise_error(F.lit("a percentile outside its bracket")).cast("double"))
    z = few.groupBy("group", "k").agg(pick(F.floor("spot")).alias("lo"), pick(F.ceil("spot")).alias("hi"), F.first("spot").alias("spot"))
    between = F.round(F.col("lo") + (F.col("spot") - F.floor("spot")) * (F.col("hi") - F.col("lo")), digits)
    out = z.groupBy("group").agg(*[F.max(F.when(F.col("k") == i, between)).alias(name) for i, name in enumerate(names)])
    return rows.select(by).distinct().join(out.withColumnRenamed("group", by), by, "left")
