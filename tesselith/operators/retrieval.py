"""Search over tables of queries: lexical (BM25), exact dense, fusion, feedback, diversity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.functions import vocab as V
from tesselith.sources.scratch import written


def term_counts(tokens: DataFrame) -> DataFrame:
    """(term, df, cf) over (doc_id, tokens): documents with the term, and occurrences."""
    per_doc = tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").cast("long").alias("cf"))


#: Wanted terms that tasks hold, and rows of (query, term) that go to every task; with more, both sides are shuffled.
HELD = 200_000


def counted_terms(tokens: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(scope, doc_id, len, terms, tfs) over (scope, doc_id, tokens): each row's distinct terms, of those wanted, and their numbers. Counted within the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else pa.array(wanted, pa.string())
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                lists = part.column(2)
                flat, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                if known is None:
                    coded = flat.dictionary_encode()
                    names, code = coded.dictionary, coded.indices.to_numpy()
                else:
                    at = pc.index_in(flat, value_set=known)
                    some = pc.is_valid(at)
                    names, code, row = known, at.filter(some).to_numpy(), row[some.to_numpy(zero_copy_only=False)]
                key, tf = np.unique(row.astype(np.int64) * max(1, len(names)) + code, return_counts=True)
                row, code = np.divmod(key, max(1, len(names)))
                ends = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
                lists_of = [pa.ListArray.from_arrays(ends, x) for x in (names.take(pa.array(code)), pa.array(tf, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), *lists_of], ["scope", "doc_id", "len", "terms", "tfs"])

    kinds = dict(tokens.dtypes)
    return tokens.select("scope", "doc_id", "tokens").mapInArrow(run, f"scope {kinds['scope']}, doc_id {kinds['doc_id']}, len int, terms array<string>, tfs array<int>")


def bm25(tokens: DataFrame, queries: DataFrame, k: int | None, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, lexical_score, rank) of queries (query_id, terms[, scope]) over (doc_id, tokens[, scope]).

    With a scope column on both sides, statistics and results are of the query's scope. Texts are read once: their wanted terms are counted
    within the row and written, a row a document; with HELD rows of (query, term) or fewer, without scopes and with k, scores are summed within the row too, and tasks keep their best k. A term repeated in the query weighs a fifth more each time. Ties go to the smaller doc_id; k bounds the ranks.
    """
    plain = "scope" not in tokens.columns
    if plain:
        tokens, queries = tokens.withColumn("scope", F.lit(0)), queries.withColumn("scope", F.lit(0))
    q = queries.select("scope", "query_id", F.explode("terms").alias("term")).groupBy("scope", "query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    q = written(q, "bm25-queries")
    n = q.count()
    few = n <= HELD
    wanted = [r["term"] for r in q.select("term").distinct().collect()] if few else None  # HELD terms at most
    rows = written(counted_terms(tokens, wanted), "bm25-terms")
    stats = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("docs"), F.avg(F.col("len").cast("double")).alias("avg_len"))
    df = rows.select("scope", F.explode("terms").alias("term")).groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    terms = q.join(df, ["scope", "term"]).join(stats, "scope")
    idf = F.log(1.0 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = terms.select("scope", "term", "query_id", (idf * (1.0 + V.QUERY_REPEAT * (F.col("qtf") - 1))).alias("w"), "avg_len")
    if plain and few and k and "bigint" == dict(rows.dtypes)["doc_id"] == dict(q.dtypes)["query_id"] and rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty() and q.where("query_id is null").isEmpty():
        return ranked(_best_by_row(rows, terms, k, digits), "query_id", [F.desc("lexical_score"), F.asc("doc_id")], k)
    post = rows.select("scope", "doc_id", "len", F.inline(F.arrays_zip("terms", "tfs"))).withColumnRenamed("terms", "term")
    tf = F.col("tfs").cast("double")
    part = F.col("w") * (tf * (V.K1 + 1.0)) / (tf + V.K1 * (1.0 - V.B + V.B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1e-9))))
    both = post.join(F.broadcast(terms) if few else terms, ["scope", "term"])
    scored = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), digits).alias("lexical_score")).where("lexical_score > 0")
    return ranked(scored, "query_id", [F.desc("lexical_score"), F.asc("doc_id")], k)


def overlap_topk(queries: DataFrame, sources: DataFrame, k: int, digits: int = 6) -> DataFrame | None:
    """The first k of answers.lexical_overlap() of each query, by score and then source_id: (query_id, source_id, lexical_score). None with more than HELD rows of (query, token), or ids that aren't longs, are null or repeat."""
    counted = overlap_rows(queries, sources)
    return counted and overlap_best(*counted, k, digits)


def overlap_rows(queries: DataFrame, sources: DataFrame, scope: Column | None = None) -> tuple[DataFrame, DataFrame] | None:
    """The queries' tokens and the sources' counted ones, written, for overlap_best() and overlap_ranks(); None where overlap_topk() gives none. A scope is a value of the sources to keep in their rows."""
    q = written(queries.select("query_id", F.explode("tokens").alias("term"), F.size("tokens").cast("double").alias("w"), F.lit(0.0).alias("avg_len")), "overlap-queries")
    if q.count() > HELD or not "bigint" == dict(q.dtypes)["query_id"] == dict(sources.dtypes)["source_id"]:
        return None
    wanted = [r["term"] for r in q.select("term").distinct().collect()]
    rows = written(counted_terms(sources.select((F.lit(0) if scope is None else scope).alias("scope"), F.col("source_id").alias("doc_id"), "tokens"), wanted), "overlap-terms")
    if not rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty() or not q.where("query_id is null").isEmpty() or not q.groupBy("query_id", "term").count().where("count > 1").isEmpty():
        return None
    return q, rows


def overlap_best(q: DataFrame, rows: DataFrame, k: int, digits: int = 6) -> DataFrame:
    best = ranked(_best_by_row(rows, q, k, digits, True), "query_id", [F.desc("lexical_score"), F.asc("doc_id")], k)
    return best.select("query_id", F.col("doc_id").alias("source_id"), "lexical_score")


def overlap_ranks(q: DataFrame, rows: DataFrame, pairs: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, source_id, lexical_score, rank) of pairs (query_id, source_id), HELD at most: their ranks among all sources, found by counting those before them. Pairs without a shared token are left out."""
    p = pairs.join(q.groupBy("query_id").agg(F.collect_list("term").alias("mine"), F.first("w").alias("w")), "query_id").join(rows.select(F.col("doc_id").alias("source_id"), "len", "terms"), "source_id")
    p = p.withColumn("n", F.size(F.array_intersect("mine", "terms"))).where("n > 0")
    p = p.select("query_id", "source_id", (F.floor(F.col("n") / F.sqrt(F.greatest(F.col("w") * F.col("len"), F.lit(1.0))) * 10**digits + 0.5) / 10**digits).alias("lexical_score"))
    p = written(p, "overlap-pairs")
    held = p.toPandas()  # HELD rows at most
    terms = sent_terms(q)
    wanted = rows.sparkSession.sparkContext.broadcast((np.searchsorted(terms.value[4], held.query_id.to_numpy(np.int64)), held.lexical_score.to_numpy(np.float64), held.source_id.to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, score, docs = wanted.value
        n = np.zeros(len(x), np.int64)
        for part, s in scored(batches, terms.value, digits, overlap_of_sets):
            i, j = np.nonzero(s > 0)
            n += _before(x, score, docs, j, s[i, j], part.column(0).to_numpy()[i])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(terms.value[4][x[some]], pa.int64()), pa.array(docs[some], pa.int64()), pa.array(n[some], pa.int64())], ["query_id", "source_id", "n"])

    counts = rows.select("doc_id", "len", "terms", "tfs").mapInArrow(run, "query_id long, source_id long, n long")
    return _with_ranks(p, counts, ["query_id", "source_id"])


def _before(x: np.ndarray, score: np.ndarray, ids: np.ndarray, x2: np.ndarray, score2: np.ndarray, ids2: np.ndarray) -> np.ndarray:
    """How many of the second rows (query, score, id) come before each of the first in its query: by score falling, then by id."""
    order = np.lexsort((np.r_[ids, ids2], -np.r_[score, score2], np.r_[x, x2]))  # stable: of equals the first rows come first
    seen = np.empty(len(order), np.int64)
    seen[order] = np.cumsum(order >= len(x))
    return seen[: len(x)] - np.searchsorted(np.sort(x2), x)


def _with_ranks(pairs: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    n = counts.groupBy(*key).agg(F.sum("n").alias("n"))
    return pairs.join(n, key, "left").withColumn("rank", (F.coalesce("n", F.lit(0)) + 1).cast("int")).drop("n")


def pairs_found(tokens: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, key) over (doc_id, tokens): the wanted pairs of neighbouring tokens that a row holds, each once, joined by a space. Only those that are found become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {w: i for i, w in enumerate(sorted({w for pair in wanted for w in pair}))}
        known, keys = pa.array(list(words), pa.string()), pa.array([" ".join(pair) for pair in wanted], pa.string())
        places = pa.array([words[a] * len(words) + words[b] for a, b in wanted], pa.int64())
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                code = pc.fill_null(pc.index_in(part.column(1).flatten(), value_set=known), -1).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy())
                both = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (row[:-1] == row[1:]))
                at = pc.index_in(pa.array(code[both] * len(words) + code[both + 1]), value_set=places)
                some = pc.is_valid(at).to_numpy(zero_copy_only=False)
                row, at = np.divmod(np.unique(row[both][some] * len(wanted) + at.drop_null().to_numpy()), max(1, len(wanted)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), keys.take(pa.array(at))], ["doc_id", "key"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, key string")


#: Results that a task keeps back before it drops those beyond each query's first k.
KEPT = 1 << 18


def sent_terms(terms: DataFrame):
    """A broadcast of (term, query_id, w, avg_len), HELD rows at most: names of terms, where each one's rows begin, their queries' places and weights by term, the queries' sorted ids, and the mean length."""
    held = terms.select("term", "query_id", "w", "avg_len").toPandas()
    of, names = pd.factorize(held.term)
    order = np.argsort(of, kind="stable")
    ids, query = np.unique(held.query_id.to_numpy(np.int64), return_inverse=True)
    first = np.searchsorted(of[order], np.arange(len(names) + 1))
    return terms.sparkSession.sparkContext.broadcast((names.tolist(), first, query[order], held.w.to_numpy(np.float64)[order], ids, float(held.avg_len.iloc[0]) if len(held) else 0.0))


def overlap_of_sets(shared: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, digits: int) -> np.ndarray:
    """Shared tokens over the root of the product of the sizes. Such scores may lie in the middle, which SQL rounds up."""
    return np.floor(shared / np.sqrt(np.maximum(sizes * lengths, 1.0)) * 10**digits + 0.5) / 10**digits


def scored(batches: Iterator[pa.RecordBatch], sent: tuple, digits: int, sets=None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(part, scores of its rows for every query) of counted rows (doc_id, len, terms, tfs, …), SCORES at once: sets() of shared tokens, or BM25."""
    names, first, query, w, ids, avg = sent
    known, n = pa.array(names, pa.string()), len(ids)
    sizes = np.zeros(n)
    sizes[query] = w
    for batch in batches:
        for lo in range(0, batch.num_rows if n else 0, max(1, SCORES // max(1, n))):
            part = batch.slice(lo, max(1, SCORES // n))
            count = pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy()
            row, code, tf = np.repeat(np.arange(len(count)), count), pc.index_in(part.column(2).flatten(), value_set=known), part.column(3).flatten().to_numpy().astype(np.float64)
            some = pc.is_valid(code).to_numpy(zero_copy_only=False)
            row, code, tf = row[some], code.filter(pa.array(some)).to_numpy(), tf[some]
            length = part.column(1).to_numpy()
            share = np.ones(len(row)) if sets else tf * (V.K1 + 1.0) / (tf + V.K1 * (1.0 - V.B + V.B * length[row] / max(avg, 1e-9)))
            each = first[code + 1] - first[code]
            at = np.repeat(first[code] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum()) if len(code) else np.zeros(0, np.int64)
            s = np.bincount(np.repeat(row, each) * n + query[at], weights=np.repeat(share, each) * (1.0 if sets else w[at]), minlength=len(count) * n).reshape(-1, n)
            yield part, sets(s, sizes[None, :], length[:, None], digits) if sets else np.round(s, digits)


def _best_by_row(rows: DataFrame, terms: DataFrame, k: int, digits: int, overlap: bool = False) -> DataFrame:
    """(query_id, doc_id, lexical_score): each task's best k documents of every query. A document's counted terms lie in its row, so scores are summed there and nothing but the best is shuffled.

    rows: counted_terms() of one scope, a row a document; terms: (term, query_id, w, avg_len), HELD rows at most, which go to every task. With overlap, over sets of tokens,
    the score is the number of shared ones over the root of the product of the sizes; w is the size of the query's set.
    """
    sent = sent_terms(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sent.value[4]
        n = len(ids)
        found, least, size = [], np.zeros(n), 0

        def best() -> tuple:
            x, doc, s = (np.concatenate(c) for c in zip(*found, strict=True))
            at = np.lexsort((doc, -s, x))
            x, doc, s = x[at], doc[at], s[at]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            least[x[place == k - 1]] = s[place == k - 1]
            return x[place < k], doc[place < k], s[place < k]

        for part, s in scored(batches, sent.value, digits, overlap_of_sets if overlap else None):
            i, j = np.nonzero((s > 0) & (s >= least))
            found.append((j, part.column(0).to_numpy()[i], s[i, j]))
            size += len(i)
            if size > KEPT + 2 * n * k:
                found = [best()]
                size = len(found[0][0])
        if found:
            x, doc, s = best()
            yield pa.RecordBatch.from_arrays([pa.array(ids[x], pa.int64()), pa.array(doc, pa.int64()), pa.array(s, pa.float64())], ["query_id", "doc_id", "lexical_score"])

    return rows.select("doc_id", "len", "terms", "tfs").mapInArrow(run, "query_id long, doc_id long, lexical_score double")


def ranked(rows: DataFrame, by: str | list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Rank from 1 in each group; with k only the first k, which the optimizer limits before the shuffle."""
    d = rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return d.where(F.col(name) <= k) if k else d


#: Vectors and queries that meet in one task, at most; vectors at least, where there are cores for more tasks.
TILE, TILE_LEAST = 65_536, 1024
#: Scores that a task holds at once.
SCORES = 1 << 20


def _tiled(vectors: DataFrame, queries: DataFrame, each, schema: str, tile: int = TILE) -> DataFrame:
    """each(queries, vectors) of every tile of queries with every tile of vectors, as pandas frames without null embeddings.

    vectors: (vec_id, embedding, …); queries: (query_id, embedding, …). Both sides are dealt by hash, each copied as often as the other has tiles: nothing passes the driver.
    """
    # columns of their own: both may come from one table
    v, q = vectors.where("embedding is not null"), queries.toDF(*queries.columns).where("embedding is not null")
    n = v.count()
    nv = max(1, math.ceil(n / tile), min(v.sparkSession.sparkContext.defaultParallelism, n // TILE_LEAST))
    nq = max(1, math.ceil(q.count() / tile))
    own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    v = v.withColumn("__v", own("vec_id", nv)).withColumn("__q", every(nq))
    q = q.withColumn("__q", own("query_id", nq)).withColumn("__v", every(nv))
    return q.groupBy("__v", "__q").cogroup(v.groupBy("__v", "__q")).applyInPandas(lambda x, y: each(x, y), schema)


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows.embedding.to_numpy()).astype(np.float64)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int | None, scoped: bool = False, digits: int = 6, tile: int = TILE) -> DataFrame:
    """(query_id, vec_id, dense_score, rank): exact inner products of every query with every vector but itself.

    vectors: (vec_id, embedding[, scope]); queries: (query_id, embedding[, scope]). Tiles of both meet in tasks, which multiply in
    double precision and keep their own best k, so only those are shuffled on. Without k all are ranked.
    """
    cols = ["scope"] if scoped else []

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            x, ids, names = _matrix(v), v.vec_id.to_numpy(), q.query_id.to_numpy()
            at_once = max(1, SCORES // len(v))
            if scoped:  # equal numbers stand for equal scopes; a missing one has none
                of = pd.factorize(pd.concat([q.scope, v.scope]))[0]
                mine, theirs = of[: len(q)], np.where(of[len(q) :] < 0, -2, of[len(q) :])
            for lo in range(0, len(q), at_once):
                some = q.iloc[lo : lo + at_once]
                s = _matrix(some) @ x.T
                np.round(s, digits, out=s)
                s[names[lo : lo + at_once, None] == ids[None, :]] = -np.inf
                if scoped:
                    s[mine[lo : lo + at_once, None] != theirs[None, :]] = -np.inf
                least = np.partition(s, -k, axis=1)[:, -k, None] if k and k < s.shape[1] else -np.inf
                i, j = np.nonzero((s >= least) & np.isfinite(s))
                order = np.lexsort((ids[j], -s[i, j], i))
                i, j = i[order], j[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                if k:
                    i, j = i[place < k], j[place < k]
                out.append(pd.DataFrame({"query_id": names[lo + i], "vec_id": ids[j], "dense_score": s[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "dense_score": []})

    rows = _tiled(vectors.select("vec_id", "embedding", *cols), queries.select("query_id", "embedding", *cols), best, "query_id long, vec_id long, dense_score double", tile)
    return ranked(rows, "query_id", [F.desc("dense_score"), F.asc("vec_id")], k)


def dense_ranks(vectors: DataFrame, queries: DataFrame, pairs: DataFrame, digits: int = 6, tile: int = TILE) -> DataFrame:
    """(query_id, vec_id, dense_score, rank) of pairs (query_id, vec_id): their ranks in dense_topk() without k, found by counting the vectors before them. Ids don't repeat; pairs without a vector, or of a query with itself, are left out.

    A query's pairs lie in its row: they are few.
    """
    dot = F.aggregate(F.zip_with("mine", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    p = pairs.where("query_id <> vec_id").join(queries.select("query_id", F.col("embedding").alias("mine")), "query_id").join(vectors.select("vec_id", "embedding"), "vec_id")
    p = p.select("query_id", "vec_id", F.round(dot, digits).alias("dense_score")).where("not isnan(dense_score) and abs(dense_score) <> double('infinity')")
    p = written(p, "dense-pairs")
    lists = p.groupBy("query_id").agg(F.collect_list(F.struct("dense_score", "vec_id")).alias("p")).select("query_id", F.col("p.dense_score").alias("scores"), F.col("p.vec_id").alias("places"))

    def count(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            x, ids, names = _matrix(v), v.vec_id.to_numpy(), q.query_id.to_numpy()
            at_once = max(1, SCORES // len(v))
            for lo in range(0, len(q), at_once):
                some = q.iloc[lo : lo + at_once]
                s = np.round(_matrix(some) @ x.T, digits)
                s[names[lo : lo + at_once, None] == ids[None, :]] = -np.inf
                of, score, places = np.repeat(np.arange(len(some)), some.scores.map(len)), np.concatenate(some.scores.to_list()), np.concatenate(some.places.to_list())
                i, j = np.nonzero(np.isfinite(s))
                out.append(pd.DataFrame({"query_id": names[lo + of], "vec_id": places, "n": _before(of, score, places, i, s[i, j], ids[j])}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "n": []})

    counts = _tiled(vectors.select("vec_id", "embedding"), queries.select("query_id", "embedding").join(lists, "query_id"), count, "query_id long, vec_id long, n long", tile)
    return _with_ranks(p, counts, ["query_id", "vec_id"])


def dense_by_source(vectors: DataFrame, queries: DataFrame, digits: int = 6, tile: int = TILE) -> DataFrame:
    """(query_id, source_id, vector_type, score): of every query and source, the best two vectors and the identity vectors.

    vectors: (vec_id, embedding, source_id, vector_type); queries: (query_id, embedding). All vectors are scored but the query's own;
    tasks keep the best two of each tile, so a pair may have more rows than the best two of all.
    """

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            v = v.sort_values(["source_id", "vec_id"])
            x, ids, kind, names = _matrix(v), v.vec_id.to_numpy(), v.vector_type.to_numpy(), q.query_id.to_numpy()
            of, sources = pd.factorize(v.source_id, use_na_sentinel=False)
            ends = np.r_[np.flatnonzero(np.diff(of)) + 1, len(of)]
            at_once = max(1, SCORES // len(v))
            for lo in range(0, len(q), at_once):
                s = np.round(_matrix(q.iloc[lo : lo + at_once]) @ x.T, digits)
                s[names[lo : lo + at_once, None] == ids[None, :]] = -np.inf
                keep = np.broadcast_to(kind == "identity", s.shape).copy()
                for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
                    np.put_along_axis(keep[:, start:end], np.argsort(-s[:, start:end], axis=1, kind="stable")[:, :2], True, 1)
                i, j = np.nonzero(keep & np.isfinite(s))
                out.append(pd.DataFrame({"query_id": names[lo + i], "source_id": np.asarray(sources)[of[j]], "vector_type": kind[j], "score": s[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "source_id": [], "vector_type": [], "score": []})

    return _tiled(vectors.select("vec_id", "embedding", "source_id", "vector_type"), queries.select("query_id", "embedding"), best, "query_id long, source_id long, vector_type string, score double", tile)


def normalised(rows: DataFrame, score: str, by: str = "query_id") -> Column:
    """Min-max in the group; a flat group gives 1 if its score is positive, else 0."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(F.abs(high - low) <= 1e-12, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((F.col(score) - low) / (high - low))


def fused_rrf(dense: DataFrame, lexical: DataFrame, k: int | None = None, digits: int = 6) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, dense_score, rank) and (query_id, doc_id, lexical_score, rank).

    Ties: dense score, lexical score, smaller doc_id.
    """
    d = dense.select("query_id", "doc_id", "dense_score", F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "doc_id", "lexical_score", F.col("rank").alias("lexical_rank"))
    both = d.join(x, ["query_id", "doc_id"], "full")
    part = lambda c: F.coalesce(1.0 / (V.RRF_K + F.col(c)), F.lit(0.0))
    both = both.withColumn("hybrid_score", F.round(part("dense_rank") + part("lexical_rank"), digits))
    zero = lambda c: F.desc(F.coalesce(c, F.lit(0.0)))
    return ranked(both, "query_id", [F.desc("hybrid_score"), zero("dense_score"), zero("lexical_score"), F.asc("doc_id")], k)


def fused_weighted(dense: DataFrame, lexical: DataFrame, k: int | None = None, digits: int = 6) -> DataFrame:
    """Weighted sum of min-max scores, and a share for rows that both sides have. Ties: scores, ranks, doc_id."""
    d = dense.select("query_id", "doc_id", "dense_score", F.col("rank").alias("dense_rank"), normalised(dense, "dense_score").alias("dn"))
    x = lexical.select("query_id", "doc_id", "lexical_score", F.col("rank").alias("lexical_rank"), normalised(lexical, "lexical_score").alias("ln"))
    both = d.join(x, ["query_id", "doc_id"], "full")
    two = F.when(F.col("dn").isNotNull() & F.col("ln").isNotNull(), V.BOTH_WEIGHT).otherwise(0.0)
    score = V.DENSE_WEIGHT * F.coalesce("dn", F.lit(0.0)) + V.LEXICAL_WEIGHT * F.coalesce("ln", F.lit(0.0)) + two
    both = both.withColumn("hybrid_score", F.round(score, digits)).drop("dn", "ln")
    order = [F.desc("hybrid_score"), F.desc(F.coalesce("lexical_score", F.lit(0.0))), F.desc(F.coalesce("dense_score", F.lit(0.0))), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("dense_rank"), F.asc("doc_id")]
    return ranked(both, "query_id", order, k)


def hybrid(dense: DataFrame, lexical: DataFrame, profile: str = "rrf", k: int | None = None) -> DataFrame:
    """Fusion per query; a query with one side empty passes the other's raw scores through (`fallback`)."""
    if profile not in ("rrf", "weighted"):
        raise ValueError(f"profile: {profile}")
    fused = (fused_rrf if profile == "rrf" else fused_weighted)(dense, lexical)
    w = Window.partitionBy("query_id")
    sides = F.max(F.col("dense_rank").isNotNull()).over(w) & F.max(F.col("lexical_rank").isNotNull()).over(w)
    d = fused.withColumn("fallback", ~sides)
    d = d.withColumn("score", F.when(F.col("fallback"), F.coalesce("dense_score", "lexical_score")).otherwise(F.col("hybrid_score"))).drop("rank")
    return ranked(d, "query_id", [F.desc("score"), F.desc(F.coalesce("dense_score", F.lit(0.0))), F.desc(F.coalesce("lexical_score", F.lit(0.0))), F.asc("doc_id")], k)


def feedback_counts(feedback: DataFrame, key: str = "chunk_id") -> DataFrame:
    rel = F.col("label") == "relevant"
    return feedback.groupBy(key).agg(F.count_if(rel).alias("relevant_count"), F.count_if(~rel).alias("not_relevant_count"))


def feedback_adjustments(candidates: DataFrame, feedback: DataFrame, as_of: str, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, adjustment, query_matches, relevant_count, not_relevant_count) for candidates that have feedback.

    candidates: (query_id, doc_id, query_tokens); feedback: (chunk_id, label, query_tokens, updated_at). Votes weigh by token
    similarity to the query (at least a fifth) and by age, halving every 30 days before as_of; a smoothed prior of all votes
    is added; the sum is held to the bound.
    """
    f = feedback.select(F.col("chunk_id").alias("doc_id"), F.col("query_tokens").alias("past"), F.when(F.col("label") == "relevant", 1.0).otherwise(-1.0).alias("vote"), "updated_at")
    d = candidates.select("query_id", "doc_id", "query_tokens").join(f, "doc_id")
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("updated_at")) / 86400e6)
    sim = T.jaccard(F.col("query_tokens"), F.col("past"))
    weight = F.when(sim >= V.MIN_SIMILARITY, sim * F.exp(-F.log(F.lit(2.0)) * F.coalesce(age, F.lit(0.0)) / V.HALF_LIFE_DAYS))
    g = d.withColumn("w", weight).groupBy("query_id", "doc_id").agg(
        F.sum("w").alias("ws"), F.sum(F.col("w") * F.col("vote")).alias("vs"), F.count("w").alias("query_matches"),
        F.count_if(F.col("vote") > 0).alias("relevant_count"), F.count_if(F.col("vote") < 0).alias("not_relevant_count"),
    )
    prior = (F.col("relevant_count") - F.col("not_relevant_count")) / (F.col("relevant_count") + F.col("not_relevant_count") + 2.0)
    raw = V.ALPHA_QUERY * F.coalesce(F.col("vs") / F.col("ws"), F.lit(0.0)) + V.BETA_GLOBAL * prior
    held = F.greatest(F.lit(-V.MAX_ADJUST), F.least(F.lit(V.MAX_ADJUST), raw))
    return g.select("query_id", "doc_id", F.round(held, digits).alias("adjustment"), "query_matches", "relevant_count", "not_relevant_count")


def feedback_reranked(rows: DataFrame, adjustments: DataFrame, digits: int = 6) -> DataFrame:
    """rows (query_id, doc_id, score, rank) with base_score, adjustment and a new score and rank; ties keep the prior rank."""
    a = adjustments.select("query_id", "doc_id", "adjustment")
    d = rows.select("query_id", "doc_id", F.col("score").alias("base_score"), F.col("rank").alias("prior_rank")).join(a, ["query_id", "doc_id"], "left")
    d = d.withColumn("adjustment", F.coalesce("adjustment", F.lit(0.0))).withColumn("score", F.round(F.col("base_score") + F.col("adjustment"), digits))
    return ranked(d, "query_id", [F.desc("score"), F.asc("prior_rank")])


def keep_latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return ranked(rows, key, order, 1, "__keep").drop("__keep")


def near_duplicate_pairs(rows: DataFrame) -> DataFrame:
    """Pairs within a query's candidates (bounded by k) of one source: starts within 8 s, or token Jaccard 0.85 or more.

    rows: (query_id, doc_id, source, start, tokens).
    """
    side = lambda p: rows.select("query_id", "source", F.col("doc_id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("tokens").alias(f"{p}_tokens"))
    d = side("left").join(side("right"), ["query_id", "source"]).where("left_id < right_id")
    d = d.withColumn("jaccard", F.round(T.jaccard(F.col("left_tokens"), F.col("right_tokens")), 6)).withColumn("apart", F.abs(F.col("left_start") - F.col("right_start")))
    return d.where((F.col("apart") <= V.NEAR_SECONDS) | (F.col("jaccard") >= V.NEAR_JACCARD)).select("query_id", "source", "left_id", "right_id", "apart", "jaccard")


def diverse(rows: DataFrame, k: int) -> DataFrame:
    """Greedy selection of k per query from (query_id, doc_id, source, start, tokens, rank), with its new rank.

    A row is passed over if its source has max(2, ceil(k/2)) rows already or it is a near duplicate of a selected row; passed
    rows fill up in order if fewer than k remain. Candidates are bounded per query, so a group is small.
    """
    most = max(2, math.ceil(k / 2))

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, passed, seen, per = [], [], set(), {}
        for r in pdf.sort_values("rank").itertuples():
            tokens = {t for t in r.tokens if t}
            if r.doc_id in seen:
                continue
            near = any(
                r.source == c.source and (abs(r.start - c.start) <= V.NEAR_SECONDS or (tokens and t and len(tokens & t) / len(tokens | t) >= V.NEAR_JACCARD))
                for c, t in chosen
            )
            if per.get(r.source, 0) >= most or near:
                passed.append((r, tokens))
                continue
            chosen.append((r, tokens))
            seen.add(r.doc_id)
            per[r.source] = per.get(r.source, 0) + 1
            if len(chosen) >= k:
                break
        for r, t in passed:
            if len(chosen) >= k:
                break
            if r.doc_id not in seen:
                chosen.append((r, t))
                seen.add(r.doc_id)
        return pd.DataFrame({"query_id": [r.query_id for r, _ in chosen], "doc_id": [r.doc_id for r, _ in chosen], "source": [r.source for r, _ in chosen], "rank": range(1, len(chosen) + 1)})

    return rows.groupBy("query_id").applyInPandas(select, "query_id long, doc_id long, source string, rank int")


def reranked(rows: DataFrame, score_fn, top: int = 50, digits: int = 6) -> DataFrame:
    """Rescore the first `top` rows of a query by an injected model: score_fn(queries, texts) -> scores, in Arrow batches.

    If a score of the query lies outside 0 to 1, all of its scores go through the logistic function. The tail is squeezed
    below the head's lowest score. rows: (query_id, doc_id, query, text, score, rank).
    """

    @F.pandas_udf("double")
    def scores(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(score_fn(q.tolist(), t.tolist()), float))

    w = Window.partitionBy("query_id")
    head = rows.where(F.col("rank") <= top).withColumn("m", scores("query", "text"))
    outside = F.max(((F.col("m") < 0) | (F.col("m") > 1)).cast("int")).over(w) == 1
    head = head.withColumn("rerank_score", F.when(outside, 1 / (1 + F.exp(-F.col("m")))).otherwise(F.col("m"))).drop("m")
    tail = rows.where(F.col("rank") > top).withColumn("rerank_score", F.lit(None).cast("double"))
    d = head.unionByName(tail).withColumn("floor", F.greatest(F.lit(0.0), F.min("rerank_score").over(w)))
    n, i = F.count_if(F.col("rank") > top).over(w), F.col("rank") - top - 1
    d = d.withColumn("rerank_score", F.round(F.coalesce("rerank_score", F.col("floor") * (n - i) / (n + 1)), digits))
    return ranked(d.select("query_id", "doc_id", F.col("score").alias("base_score"), F.col("rank").alias("prior_rank"), "rerank_score"), "query_id", [F.desc("rerank_score"), F.asc("prior_rank")])


def merged_evidence(*sides: DataFrame, k: int) -> DataFrame:
    """Union of evidence kinds by raw score: score falling, then the order of the sides, then id."""
    d = sides[0].withColumn("side", F.lit(0))
    for i, s in enumerate(sides[1:], 1):
        d = d.unionByName(s.withColumn("side", F.lit(i)), allowMissingColumns=True)
    return ranked(d, "query_id", [F.desc("score"), F.asc("side"), F.asc("doc_id")], k).drop("side")
