"""Evaluation beside the metrics: checks of predictions, ablations, chunk recall, context budgets, requests without gold, fixture scores."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.operators.retrieval import KEPT, overlap_rows, ranked, scored, sent_terms

# Score of a fixture row without overlap and the weight of its overlap; characters of a result's text and of a context; chunks at least.
FIXTURE_BASE, FIXTURE_WEIGHT = 0.05, 0.75
SLIM_CHARS, CONTEXT_CHARS, LEAST_CHUNKS = 240, 150_000, 6


def checked_predictions(predictions: DataFrame, known: DataFrame) -> DataFrame:
    """(ord, query_id, status): valid, or what is wrong with a prediction (ord, query_id string, ranked array<string>, latency_ms string).

    In this order: no query id; a repeat of one that came before, valid or not; a query that is unknown; a list that is missing, holds blanks or
    repeats; a latency that is no finite number of 0 or more.
    """
    q = F.trim(F.coalesce("query_id", F.lit("")))
    names = F.transform("ranked", lambda x: F.trim(F.coalesce(x, F.lit(""))))
    ms = F.col("latency_ms").try_cast("double")
    bad_time = F.col("latency_ms").isNotNull() & F.coalesce(~(ms >= 0) | F.isnan(ms) | (ms == F.lit(float("inf"))), F.lit(True))
    d = predictions.select("ord", q.alias("query_id"), F.when(F.col("ranked").isNull(), "ranked_missing").when(F.array_contains(names, ""), "ranked_blank").when(F.size(F.array_distinct(names)) < F.size(names), "ranked_repeats").when(bad_time, "latency").alias("wrong"))
    d = d.withColumn("copy", F.row_number().over(Window.partitionBy("query_id").orderBy("ord")))
    k = known.select(F.col("query_id").cast("string").alias("query_id"), F.lit(True).alias("known")).distinct()
    d = d.join(k, "query_id", "left")
    return d.select("ord", "query_id", F.when(F.col("query_id") == "", "no_query_id").when(F.col("copy") > 1, "duplicate_prediction").when(F.col("known").isNull(), "unknown_query").otherwise(F.coalesce("wrong", F.lit("valid"))).alias("status"))


def chunk_recall(ranked_chunks: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, recall): the share of a query's gold chunks (query_id, doc_id, chunk_index) among its first k (with rank); each counts once."""
    g = gold.select("query_id", "doc_id", "chunk_index").distinct()
    hit = ranked_chunks.where(F.col("rank") <= k).select("query_id", "doc_id", "chunk_index", F.lit(1).alias("hit")).distinct()
    d = g.join(hit, ["query_id", "doc_id", "chunk_index"], "left")
    return d.groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


def ablation(scores_with: DataFrame, scores_without: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, query_count, with_channel, without_channel, delta) over queries scored both ways; nulls where there is none.

    Scores: (query_id, *metrics).
    """
    both = scores_with.select("query_id", *[F.col(m).alias(f"w_{m}") for m in metrics]).join(scores_without.select("query_id", *[F.col(m).alias(f"o_{m}") for m in metrics]), "query_id")
    g = both.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"{s}_{m}").alias(f"{s}_{m}") for m in metrics for s in "wo"])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(f"w_{m}", 6).alias("w"), F.round(f"o_{m}", 6).alias("o"), F.round(F.col(f"w_{m}") - F.col(f"o_{m}"), 6).alias("d")) for m in metrics]))
    return g.select("n", rows.alias("r")).select("r.metric", F.col("n").alias("query_count"), F.col("r.w").alias("with_channel"), F.col("r.o").alias("without_channel"), F.col("r.d").alias("delta"))


def requests(cases: DataFrame) -> DataFrame:
    """What a system under test may see of a case: (query_id, query, language, categories), no gold."""
    return cases.select("query_id", "query", "language", "categories")


def slim_results(results: DataFrame) -> DataFrame:
    """Results with the beginning of their text: (query_id, rank, doc_id, score, text); the cut is the report's form."""
    return results.select("query_id", "rank", "doc_id", "score", F.substring(F.coalesce("text", F.lit("")), 1, SLIM_CHARS).alias("text"))


def budgeted_chunks(lines: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chunk_index, text): all readable chunks of a document if they fit the budget of characters, else the most that do, evenly apart.

    The count begins at the budget over the mean length, but six and at most all, and falls until the texts fit; if not even two do, the middle one stays.
    """
    rows = F.transform("lines", lambda x, i: F.struct(i.alias("i"), T.clean(x["text"]).alias("text")))
    d = lines.select("doc_id", F.filter(rows, lambda x: x["text"] != "").alias("r")).where("size(r) > 0")
    d = d.withColumn("total", F.expr("aggregate(r, 0L, (a, x) -> a + length(x.text))")).withColumn("n", F.size("r"))
    d = d.withColumn("most", F.expr(f"cast(greatest({LEAST_CHUNKS}, least(n, {budget} div greatest(1, cast(ceil(total / n) as int)))) as int)"))
    at = "if({c} >= n, sequence(0, n - 1), array_distinct(transform(sequence(0, {c} - 1), i -> cast(bround(cast(i as double) * (n - 1) / ({c} - 1), 0) as int))))"
    fits = f"aggregate({at.format(c='c')}, 0L, (a, p) -> a + length(r[p].text)) <= {budget}"
    # the first count that fits, going down: a fold that looks no further once it has one
    fold = f"aggregate(if(most >= 2, sequence(most, 2, -1), array(2)), 0, (b, c) -> if(b > 0, b, if({fits}, c, 0)))"
    d = d.withColumn("count", F.when(F.col("total") <= budget, F.col("n")).otherwise(F.expr(fold)))
    d = d.withColumn("p", F.expr(f"if(count = 0, array(n div 2), {at.format(c='count')})"))
    return d.select("doc_id", F.explode(F.expr("transform(p, q -> r[q])")).alias("x")).select("doc_id", F.col("x.i").cast("long").alias("chunk_index"), "x.text")


def fixture_dense(queries: DataFrame, chunks: DataFrame, given: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): a written-down score where there is one, else a base and the weighted overlap of token sets.

    queries, chunks: (query_id | doc_id, tokens), chunks with chunk_index; given: (query_id, doc_id, score). Rows without a shared token and without a given score
    have the base score and are left out. Order: score falling, chunk rising, document falling. Where tokens can be counted within a chunk's row (retrieval.overlap_rows()) tasks keep
    their best k, and no pairs of query and chunk are shuffled; documents, and pairs of given, don't repeat there.
    """
    sets = lambda rows, name: rows.select(name, F.array_distinct("tokens").alias("tokens"))
    longs = "bigint" == dict(chunks.dtypes)["chunk_index"] == dict(given.dtypes)["query_id"] == dict(given.dtypes)["doc_id"]
    if longs and given.groupBy("query_id", "doc_id").count().where("count > 1").isEmpty() and given.where("isnan(score) or abs(score) = double('infinity')").isEmpty():
        sources = chunks.select(F.col("doc_id").alias("source_id"), "chunk_index", F.array_distinct("tokens").alias("tokens"))
        counted = overlap_rows(sets(queries, "query_id"), sources, F.col("chunk_index"))
        if counted and counted[1].where("scope is null").isEmpty():
            best = _fixture_best(*counted, given, k)
            return ranked(best, "query_id", [F.desc("score"), F.asc("chunk_index"), F.desc("doc_id")], k).select("query_id", "doc_id", "score", "rank")
    q = queries.select("query_id", F.array_distinct("tokens").alias("qt"))
    c = chunks.select("doc_id", "chunk_index", F.array_distinct("tokens").alias("ct"))
    sizes = c.select("doc_id", "chunk_index", F.size("ct").alias("cn"))
    hit = q.select("query_id", F.size("qt").alias("qn"), F.explode("qt").alias("t")).join(c.select("doc_id", F.explode("ct").alias("t")), "t")
    n = hit.groupBy("query_id", "doc_id", "qn").agg(F.count(F.lit(1)).alias("both")).join(sizes, "doc_id")
    d = n.join(given, ["query_id", "doc_id"], "left")
    overlap = F.col("both") / (F.col("qn") + F.col("cn") - F.col("both"))
    d = d.withColumn("score", F.round(F.coalesce("score", F.lit(FIXTURE_BASE) + FIXTURE_WEIGHT * overlap), 6))
    return ranked(d, "query_id", [F.desc("score"), F.asc("chunk_index"), F.desc("doc_id")], k).select("query_id", "doc_id", "score", "rank")


def _fixture_best(q: DataFrame, rows: DataFrame, given: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, chunk_index, score): each task's first k of every query, over the written rows of overlap_rows(); given scores lie in the rows, too."""
    g = given.where("score is not null").groupBy("doc_id").agg(F.collect_list(F.struct("query_id", F.round("score", 6).alias("score"))).alias("g"))
    rows = rows.join(g, "doc_id", "left").select("doc_id", "len", "terms", "tfs", F.col("scope").alias("chunk_index"), F.col("g.query_id").alias("given"), F.col("g.score").cast("array<double>").alias("scores"))
    sent = sent_terms(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sent.value[4]
        n, found, least, size = len(ids), [], np.full(len(ids), -np.inf), 0
        known: dict[tuple[int, int], float] = {}

        def rounded(both: int, either: int) -> float:
            """As SQL rounds: halves of the decimal number go up."""
            if (both, either) not in known:
                known[both, either] = float(Decimal(repr(FIXTURE_BASE + FIXTURE_WEIGHT * (both / either))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
            return known[both, either]

        def score(shared: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, digits: int) -> np.ndarray:
            some = shared > 0
            both, either = shared[some].astype(np.int64), (sizes + lengths - shared)[some].astype(np.int64)
            pairs, at = np.unique(both << 32 | either, return_inverse=True)
            s = np.full(shared.shape, -np.inf)
            s[some] = np.array([rounded(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs], np.float64)[at]
            return s

        def best() -> tuple:
            x, doc, chunk, s = (np.concatenate(c) for c in zip(*found, strict=True))
            at = np.lexsort((-doc, chunk, -s, x))
            x, doc, chunk, s = x[at], doc[at], chunk[at], s[at]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            least[x[place == k - 1]] = s[place == k - 1]
            return x[place < k], doc[place < k], chunk[place < k], s[place < k]

        for part, s in scored(batches, sent.value, 6, score):
            row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(part.column(5)), 0).to_numpy())
            asked, instead = part.column(5).flatten().to_numpy(), part.column(6).flatten().to_numpy()
            at = np.minimum(np.searchsorted(ids, asked), n - 1)
            some = (ids[at] == asked) & np.isfinite(s[row, at])
            s[row[some], at[some]] = instead[some]
            i, j = np.nonzero(np.isfinite(s) & (s >= least))
            found.append((j, part.column(0).to_numpy()[i], part.column(4).to_numpy()[i], s[i, j]))
            size += len(i)
            if size > KEPT + 2 * n * k:
                found = [best()]
                size = len(found[0][0])
        if found:
            x, doc, chunk, s = best()
            yield pa.RecordBatch.from_arrays([pa.array(ids[x], pa.int64()), pa.array(doc, pa.int64()), pa.array(chunk, pa.int64()), pa.array(s, pa.float64())], ["query_id", "doc_id", "chunk_index", "score"])

    return rows.mapInArrow(run, "query_id long, doc_id long, chunk_index long, score double")


def merged_languages(sets: list[DataFrame], k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): result sets of a query in several languages, fused by 1/(60 + rank); ties by document."""
    rows = sets[0].select("query_id", "doc_id", "rank")
    for other in sets[1:]:
        rows = rows.unionByName(other.select("query_id", "doc_id", "rank"))
    g = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("score"))
    return ranked(g, "query_id", [F.desc("score"), F.asc("doc_id")], k).select("query_id", "doc_id", "score", "rank")


def context_block(results: DataFrame) -> DataFrame:
    """(query_id, context): results (query_id, rank, title, start, end, text) as a model is given them, in order of rank."""
    part = F.concat(F.lit("【"), "title", F.lit("】("), T.minutes_clock(F.col("start")), F.lit("-"), T.minutes_clock(F.col("end")), F.lit(")\n"), "text")
    g = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("r"))
    return g.select("query_id", F.array_join(F.transform("r", lambda x: x["p"]), "\n\n---\n\n").alias("context"))
