"""More queries of search, review and study, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselith.functions import text as T
from tesselith.operators import answers, curation, evaluation, library, metrics, multimodal, retrieval, review, speakers, study
from tesselith.plans.oracles import CLEAN, CUR, DENSE, GOLD, LEX, LINES, PROFILE, QRY, RRF, assess, both, scores
from tesselith.plans.people_queries import episodes
from tesselith.plans.queries import TEN, dense_top, gold, lexical_top, lines, manifest, titled_lines, tool_side
from tesselith.sources import adapters, fixtures
from tesselith.sources.scratch import written
from tesselith.sources.tables import table

Q = {}


def query(f):
    Q[f.__name__] = f
    return f


@query
def multimodal_two_indexes(s, d):
    """Vectors of even labels are transcripts, those of odd labels frames with an index a label: 3's was made by another model, 5's manifest counts one vector too many, 7's is of the older form."""
    v = table(s, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    frames = v.where("label % 2 = 1").select(F.col("label").alias("source_id"), F.col("vec_id").alias("frame_id"), "embedding")
    i = F.col("source_id")
    indexes = frames.groupBy("source_id").agg((F.count(F.lit(1)) + F.when(i == 5, 1).otherwise(0)).alias("vectors"), F.max(F.size("embedding")).alias("dim"))
    indexes = indexes.withColumns({"backend": F.when(i != 7, "model"), "model": F.when(i == 3, "old").when(i != 7, "new")})
    transcript = lambda n: retrieval.dense_topk(v.where("label % 2 = 0").select("vec_id", "embedding"), q, n).select("query_id", F.col("vec_id").alias("doc_id"), F.col("dense_score").alias("score"))
    frame = lambda n: multimodal.frame_search(frames, indexes, {"backend": "model", "model": "new", "dim": 64}, q, n)
    return multimodal.multimodal_search(s, transcript, frame, 5)


@query
def transcript_side_alone(s, d):
    """The frames' side fails: its table isn't there."""
    lexical = lambda n: lexical_top(s, d, n).select("query_id", "doc_id", F.col("lexical_score").alias("score"))
    broken = lambda n: s.read.parquet(f"{d}/no-such-frames.parquet")
    return multimodal.multimodal_search(s, lexical, broken, 5)


@query
def inference_filter(s, d):
    rows = curation.inferences(manifest(s, d))
    return curation.inferences_of(rows, " corpus:v1:1:transcript:000000 ", "run-1").select("inference_run_id", "score")


@query
def manifest_browse(s, d):
    m = curation.browsed(manifest(s, d), included=True, topic="technology", text=" High_Signal ")
    return m.select("evidence_id", "quality_score")


@query
def scope_chunk_count(s, d):
    """Chunks by time of the documents of a source, counted a source at a time."""
    x = lines(s, d).select("doc_id", "source", F.col("lines").alias("chunks"))
    counts = [library.chunk_count(x.where(c)).withColumn("scope", F.lit(name)) for name, c in (("all", "true"), ("src1", "source = 'src1'"), ("none", "false"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def review_order(s, d):
    r = lexical_top(s, d, 5).join(adapters.query_table(s, d).select("query_id", "query"), "query_id")
    items = r.select((F.col("query_id") % 7).alias("query_index"), "query", "rank", F.concat_ws(":", "query_id", "doc_id").alias("review_item_id"))
    return review.in_review_order(items).select("query_index", "review_item_id", "place")


def route_scores(s, d, channel: bool, found):
    """found: the gold, as a written table."""
    p = answers.profiles(titled_lines(s, d), keep=("source",))
    text = F.concat_ws("\n", *(["source"] if channel else []), "lexical_text")
    sources = p.select(F.col("doc_id").alias("source_id"), T.routing_tokens(text).alias("tokens"))
    q = adapters.query_table(s, d).select("query_id", F.array_distinct("terms").alias("tokens"))
    top = retrieval.ranked(answers.lexical_overlap(q, sources, k=5), "query_id", [F.desc("lexical_score"), F.asc("source_id")], 5, "r")
    ranked = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "source_id"))), lambda x: x["source_id"]).alias("ranked"))
    cases = found.groupBy("query_id").agg(F.collect_set("doc_id").alias("relevant")).withColumn("distractors", F.array().cast("array<bigint>"))
    return metrics.routing_scores(ranked, cases)


@query
def routing_ablation(s, d):
    """Benchmark items routed to the documents that hold them by two routers: profiles with their channel (source), and without."""
    found = written(gold(s, d), "gold")
    return evaluation.ablation(route_scores(s, d, True, found), route_scores(s, d, False, found), ["recall_1", "recall_3", "recall_5", "mrr"])


def _sections(s, d):
    x = lines(s, d)
    at = "named_struct('ord', {i}, 'rank', cast({r} as int), 'title', {t}, 'tldr', get(lines, {p}).text, 'anchor', {a}, 'start_ds', get(lines, {p}).start_ds + 7, 'end_ds', get(lines, {p}).end_ds)"
    last = "size(lines) - 1"
    three = ", ".join([at.format(i=0, r="null", t="'First  theme'", p="0", a="''"), at.format(i=1, r="9", t="''", p="size(lines) div 2", a="'given anchor'"), at.format(i=2, r="null", t="get(lines, 0).text", p=last, a="null")])
    items = x.where("size(lines) > 0").select("doc_id", F.expr(f"array({three})").alias("items"))
    return study.summary_sections(items, x, speakers.episode_context(episodes(s, d)))


@query
def study_summary_sections(s, d):
    """Three items a document: its first, middle and last lines, with and without titles and anchors."""
    return _sections(s, d).select("doc_id", "section", "rank", "title", "tldr", "anchor_text", "start_ds", "end_ds", "evidence_ord")


@query
def study_section_topics(s, d):
    return study.section_topics(_sections(s, d)).select("doc_id", "rank", "title", "timestamp", "evidence_text")


@query
def baseline_runs(s, d):
    """The five runs of the baseline configuration over the benchmark: dense, lexical, both fusions, and the agent that goes by its tool policy; one search of each kind."""
    lexical, dense, q = written(lexical_top(s, d, TEN), "lexical-top"), written(dense_top(s, d, TEN), "dense-top"), adapters.query_table(s, d)
    policy = answers.tool_choice(tool_side(s, d, lexical.where("rank <= 5"), "lexical", "keyword_search"), tool_side(s, d, dense.where("rank <= 5"), "dense", "semantic_search"))
    ten = lambda x: x.where("rank <= 10").select("query_id", "doc_id", "rank")
    of = lambda tool, x: ten(x).join(policy.where(F.col("tool") == tool).select("query_id"), "query_id", "left_semi")
    runs = {
        "dense": ten(dense), "lexical": ten(lexical), "hybrid_baseline": ten(retrieval.fused_rrf(dense, lexical, 10)), "optimized_hybrid": ten(retrieval.fused_weighted(dense, lexical, 10)),
        "agentic": of("keyword_search", lexical).union(of("semantic_search", dense)),
    }
    g, rows = written(gold(s, d), "gold"), None
    for name, r in runs.items():
        x = metrics.query_scores(r, g, q).withColumn("run", F.lit(name))
        rows = x if rows is None else rows.union(x)
    m = rows.groupBy("run").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p_5", "r_5", "mrr", "ndcg")])
    return m.withColumn("quality", F.round(0.40 * F.col("r_5") + 0.35 * F.col("mrr") + 0.25 * F.col("ndcg"), 5))


@query
def fixture_corpora(s, d):
    """Ten documents as a fixture corpus: their first lines are chunks, with a score for a benchmark item and another; some ids are blank or repeated, some scores null."""
    i = F.col("doc_id")
    score = F.create_map(F.concat(F.lit("q"), (i % 40).cast("string")), F.when(i % 6 > 0, i / 1000.0), F.when(i % 5 == 0, "  ").otherwise("other"), F.lit(0.5))
    chunk = lambda t: F.struct((t["start_ds"] / 10.0).alias("start"), t["text"].alias("text"), score.alias("dense_scores"))
    name = F.when(i % 10 == 9, "").otherwise(F.concat(F.lit("v"), F.when(i % 10 == 8, i - 8).otherwise(i).cast("string")))
    one = F.to_json(F.struct(name.alias("video_id"), F.transform(F.slice("lines", 1, 2), chunk).alias("chunks")), {"ignoreNullFields": "false"})
    g = lines(s, d).select(F.floor(i / 10).cast("string").alias("corpus"), F.struct(i.alias("n"), one.alias("v")).alias("x")).groupBy("corpus").agg(F.array_sort(F.collect_list("x")).alias("x"))
    # written, as eight reads of it follow
    t = fixtures.corpus(written(g.select("corpus", F.concat(F.lit('{"videos":['), F.array_join(F.transform("x", lambda y: y["v"]), ","), F.lit("]}")).alias("json")), "fixture-corpora"))
    counted = [t[name].groupBy("corpus", *(["problem"] if name == "problems" else [])).agg(F.count(F.lit(1)).alias("n")).select("corpus", (F.col("problem") if name == "problems" else F.lit(name)).alias("what"), "n") for name in ("videos", "chunks", "dense_scores", "problems")]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


QUERIES = dict(Q)

_VS = "(SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (SELECT x.vec_id AS query_id, y.vec_id, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS score FROM embeddings x JOIN embeddings y ON y.vec_id <> x.vec_id AND {on} WHERE x.vec_id % 20 = 0))"
_CLIP = lambda c, n: f"CASE WHEN length({CLEAN.format(c=c)}) <= {n} THEN {CLEAN.format(c=c)} ELSE regexp_replace(substr({CLEAN.format(c=c)}, 1, {n}), '\\s\\S*$', '') || '...' END"


def _routes(name: str, text: str) -> str:
    return f"""{name}t AS (SELECT px.doc_id AS source_id, list_distinct(regexp_extract_all(lower({text}), '[a-z0-9_]+')) AS tokens FROM px JOIN documents d ON d.doc_id = px.doc_id),
{name}o AS (SELECT query_id, source_id, round(count(*) / sqrt(any_value(qn)::DOUBLE * any_value(sn)), 6) AS l FROM (SELECT source_id, len(tokens) AS sn, unnest(tokens) AS t FROM {name}t) JOIN (SELECT query_id, len(list_distinct(terms)) AS qn, unnest(list_distinct(terms)) AS t FROM q) USING (t) GROUP BY 1, 2),
{name}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l DESC, source_id) AS r FROM {name}o QUALIFY r <= 5),
{name} AS (SELECT g.query_id, n, coalesce(h1, 0)::DOUBLE / n AS recall_1, coalesce(h3, 0)::DOUBLE / n AS recall_3, coalesce(h5, 0)::DOUBLE / n AS recall_5, coalesce(1.0::DOUBLE / f, 0) AS mrr FROM (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) g
  LEFT JOIN (SELECT query_id, count(*) FILTER (r <= 1) AS h1, count(*) FILTER (r <= 3) AS h3, count(*) AS h5, min(r) AS f FROM {name}r JOIN gold ON gold.query_id = {name}r.query_id AND doc_id = source_id GROUP BY ALL) USING (query_id))""".replace("SELECT query_id, count(*) FILTER", f"SELECT {name}r.query_id, count(*) FILTER")


_SS = f"""{LINES}, sn AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, first(text) OVER (PARTITION BY doc_id ORDER BY ord) AS t0 FROM seg),
si AS (SELECT doc_id, unnest([1, 2, 3]) AS section, unnest([0, n // 2, n - 1]) AS p FROM (SELECT DISTINCT doc_id, n FROM sn)),
sx AS (SELECT si.doc_id, section, sn.text, t0, sn.start_ds + 7 AS start_ds, sn.end_ds FROM si JOIN sn ON sn.doc_id = si.doc_id AND sn.ord = p),
se AS (SELECT sx.doc_id, section, arg_min(seg.text, abs(seg.start_ds - sx.start_ds) * 1000000 + seg.ord) AS ev, arg_min(seg.ord, abs(seg.start_ds - sx.start_ds) * 1000000 + seg.ord) AS eo FROM sx JOIN seg ON seg.doc_id = sx.doc_id GROUP BY 1, 2),
ss AS (SELECT doc_id, section::INT AS section, CASE section WHEN 2 THEN 9 ELSE section END::INT AS rank, CASE section WHEN 1 THEN 'First theme' WHEN 2 THEN 'Theme 2' ELSE coalesce(nullif({_CLIP('t0', 140)}, ''), 'Theme 3') END AS title, {_CLIP('text', 600)} AS tldr,
  CASE section WHEN 2 THEN 'given anchor' ELSE {_CLIP('ev', 220)} END AS anchor_text, start_ds, end_ds, eo::INT AS evidence_ord FROM sx JOIN se USING (doc_id, section))"""

ORACLES: dict[str, str] = {
    "multimodal_two_indexes": f"""WITH u AS (SELECT query_id, vec_id AS doc_id, score, 'transcript' AS kind, 0 AS side FROM {_VS.format(on="y.label % 2 = 0")} WHERE r <= 10 UNION ALL SELECT query_id, vec_id, score, 'frame', 1 FROM {_VS.format(on="y.label % 2 = 1 AND y.label NOT IN (3, 5)")} WHERE r <= 10)
SELECT query_id, doc_id, score, kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, side, doc_id)::INT AS rank FROM u QUALIFY rank <= 5""",
    "baseline_runs": f"""WITH {LEX}, {DENSE}, {both()}, {RRF}, {GOLD},
l5 AS (SELECT query_id, doc_id, rank, NULL::DOUBLE AS dense_score, lexical_score FROM lex WHERE rank <= 5), d5 AS (SELECT query_id, doc_id, rank, dense_score, NULL::DOUBLE AS lexical_score FROM den WHERE rank <= 5), {assess('l5', 'al', 'lexical')}, {assess('d5', 'ad', 'dense')},
tp AS (SELECT al.query_id, NOT al.sufficient AND (ad.sufficient OR ad.n > al.n) AS semantic FROM al JOIN ad USING (query_id)),
wd AS (SELECT *, CASE WHEN hi - lo <= 1e-12 THEN (hi > 0)::INT ELSE (dense_score - lo) / (hi - lo) END AS dn FROM (SELECT *, min(dense_score) OVER w AS lo, max(dense_score) OVER w AS hi FROM den WHERE rank <= 80 WINDOW w AS (PARTITION BY query_id))),
wx AS (SELECT *, CASE WHEN hi - lo <= 1e-12 THEN (hi > 0)::INT ELSE (lexical_score - lo) / (hi - lo) END AS ln FROM (SELECT *, min(lexical_score) OVER w AS lo, max(lexical_score) OVER w AS hi FROM lex WHERE rank <= 80 WINDOW w AS (PARTITION BY query_id))),
wj AS (SELECT coalesce(wd.query_id, wx.query_id) AS query_id, coalesce(wd.doc_id, wx.doc_id) AS doc_id, dense_score, lexical_score, wd.rank AS dr, wx.rank AS lr,
  round(0.475::DOUBLE * coalesce(dn, 0) + 0.475::DOUBLE * coalesce(ln, 0) + CASE WHEN dn IS NOT NULL AND ln IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END, 6) AS hybrid_score FROM wd FULL JOIN wx ON wd.query_id = wx.query_id AND wd.doc_id = wx.doc_id),
w10 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, coalesce(lexical_score, 0) DESC, coalesce(dense_score, 0) DESC, lr NULLS LAST, dr NULLS LAST, doc_id) AS rank FROM wj QUALIFY rank <= 10),
l10 AS (SELECT query_id, doc_id, rank FROM lex WHERE rank <= 10), d10 AS (SELECT query_id, doc_id, rank FROM den WHERE rank <= 10), r10 AS (SELECT query_id, doc_id, rank FROM rrf WHERE rank <= 10),
a10 AS (SELECT query_id, doc_id, rank FROM l10 JOIN tp USING (query_id) WHERE NOT semantic UNION ALL SELECT query_id, doc_id, rank FROM d10 JOIN tp USING (query_id) WHERE semantic),
{scores("d10", "sd")}, {scores("l10", "sl")}, {scores("r10", "sr")}, {scores("w10", "sw")}, {scores("a10", "sa")},
sc AS (SELECT 'dense' AS run, * FROM sd UNION ALL SELECT 'lexical', * FROM sl UNION ALL SELECT 'hybrid_baseline', * FROM sr UNION ALL SELECT 'optimized_hybrid', * FROM sw UNION ALL SELECT 'agentic', * FROM sa),
m AS (SELECT run, round(avg(p_5), 6) AS p_5, round(avg(r_5), 6) AS r_5, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM sc GROUP BY 1)
SELECT *, round(0.40::DOUBLE * r_5 + 0.35::DOUBLE * mrr + 0.25::DOUBLE * ndcg, 5) AS quality FROM m""",
    "fixture_corpora": f"""WITH {LINES}, dd AS (SELECT doc_id, (doc_id // 10)::VARCHAR AS source, least(2, (SELECT count(*) FROM seg WHERE seg.doc_id = documents.doc_id)) AS n FROM documents),
k AS (SELECT *, doc_id % 10 = 9 AS blank, doc_id % 10 = 8 AND doc_id - 8 IN (SELECT doc_id FROM documents) AS twice FROM dd), ok AS (SELECT * FROM k WHERE NOT blank AND NOT twice)
SELECT source AS corpus, 'videos' AS what, count(*) AS n FROM ok GROUP BY 1 UNION ALL SELECT source, 'chunks', sum(n)::BIGINT FROM ok GROUP BY 1 HAVING sum(n) > 0 UNION ALL
SELECT source, 'dense_scores', sum(n * ((doc_id % 6 > 0)::INT + (doc_id % 5 > 0)::INT))::BIGINT FROM ok GROUP BY 1 HAVING sum(n * ((doc_id % 6 > 0)::INT + (doc_id % 5 > 0)::INT)) > 0 UNION ALL SELECT source, 'no video_id', count(*) FROM k WHERE blank GROUP BY 1 UNION ALL SELECT source, 'video_id repeated', count(*) FROM k WHERE twice GROUP BY 1
UNION ALL SELECT source, 'score not usable', sum(n * ((doc_id % 6 = 0)::INT + (doc_id % 5 = 0)::INT))::BIGINT FROM ok GROUP BY 1 HAVING sum(n * ((doc_id % 6 = 0)::INT + (doc_id % 5 = 0)::INT)) > 0""",
    "transcript_side_alone": f"WITH {LEX} SELECT query_id, doc_id, lexical_score AS score, 'transcript' AS kind, rank FROM lex WHERE rank <= 5",
    "inference_filter": f"WITH {CUR} SELECT 'run-1:' || evidence_id AS inference_run_id, qs AS score FROM ce WHERE evidence_id = 'corpus:v1:1:transcript:000000'",
    "manifest_browse": f"""WITH {CUR} SELECT evidence_id, qs AS quality_score FROM ce WHERE inc AND list_contains(tags, 'technology')
  AND contains(lower(evidence_id || ' ' || doc_id || ' Document ' || doc_id || ' ' || text || ' ' || ql || ' ' || array_to_string(tags, ' ')), 'high_signal')""",
    "scope_chunk_count": f"WITH {LINES} SELECT count(*) AS chunks, 'all' AS scope FROM seg UNION ALL SELECT count(*), 'src1' FROM seg WHERE source = 'src1' UNION ALL SELECT 0, 'none'",
    "review_order": f"""WITH {LEX}, i AS (SELECT query_id % 7 AS query_index, array_to_string(terms, ' ') AS query, rank, query_id || ':' || doc_id AS review_item_id FROM lex JOIN q USING (query_id) WHERE rank <= 5)
SELECT query_index, review_item_id, row_number() OVER (ORDER BY query_index, lower(query), rank, review_item_id) AS place FROM i""",
    "routing_ablation": f"""WITH {PROFILE}, {QRY}, {GOLD}, {_routes("wc", "coalesce(d.source || chr(10), '') || lexical_text")}, {_routes("oc", "lexical_text")},
b AS (SELECT count(*) AS n, {", ".join(f"avg(round(wc.{m}, 6)) AS w_{m}, avg(round(oc.{m}, 6)) AS o_{m}" for m in ("recall_1", "recall_3", "recall_5", "mrr"))} FROM wc JOIN oc USING (query_id))
{" UNION ALL ".join(f"SELECT '{m}' AS metric, n AS query_count, round(w_{m}, 6) AS with_channel, round(o_{m}, 6) AS without_channel, round(w_{m} - o_{m}, 6) AS delta FROM b" for m in ("recall_1", "recall_3", "recall_5", "mrr"))}""",
    "study_summary_sections": f"WITH {_SS} SELECT * FROM ss",
    "study_section_topics": f"""WITH {_SS}, st AS (SELECT *, start_ds // 10 AS s FROM ss)
SELECT doc_id, section AS rank, title, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS timestamp, coalesce(nullif(anchor_text, ''), tldr) AS evidence_text FROM st""",
}
