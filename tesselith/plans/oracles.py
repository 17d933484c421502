"""DuckDB SQL for the rows of the queries in plans.queries, written apart from the operators."""

from __future__ import annotations

from tesselith.functions import vocab as V

CJK = V.JAPANESE
_words = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"

TOK = "tok AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9_]+') AS tokens FROM documents)"
QRY = """q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS terms FROM benchmark),
qu AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY 1, 2)"""
WEIGHT = "ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (1 + 0.2::DOUBLE * (qtf - 1)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / greatest(al, 1e-9)))"


def lexical(source: str = "tok", name: str = "lex") -> str:
    """CTEs ending in one with all BM25 ranks."""
    n = name
    return f"""{n}_st AS (SELECT count(*) AS docs, avg(len(tokens)) AS al FROM {source}),
{n}_p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(tokens) AS len, unnest(tokens) AS term FROM {source}) GROUP BY 1, 2),
{n}_df AS (SELECT term, count(*) AS df FROM {n}_p GROUP BY 1),
{n}_s AS (SELECT query_id, doc_id, round(sum({WEIGHT}), 6) AS lexical_score FROM qu JOIN {n}_p USING (term) JOIN {n}_df USING (term), {n}_st GROUP BY 1, 2),
{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, doc_id)::INT AS rank FROM {n}_s WHERE lexical_score > 0)"""


LEX = f"{TOK}, {QRY}, {lexical()}"
DENSE = """den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, doc_id)::INT AS rank FROM (
  SELECT b.item_id AS query_id, y.vec_id AS doc_id, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS dense_score
  FROM benchmark b JOIN embeddings x ON x.vec_id = b.item_id JOIN embeddings y ON y.vec_id <> x.vec_id))"""
VQ = """vq AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, vec_id)::INT AS rank FROM (
  SELECT x.vec_id AS query_id, y.vec_id, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS dense_score
  FROM embeddings x JOIN embeddings y ON y.vec_id <> x.vec_id {on} WHERE x.vec_id % 20 = 0))"""


def both(d: int = 80, x: int = 80) -> str:
    return f"""d AS (SELECT * FROM den WHERE rank <= {d}), x AS (SELECT * FROM lex WHERE rank <= {x}),
j AS (SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.doc_id, x.doc_id) AS doc_id, dense_score, lexical_score, d.rank AS dense_rank, x.rank AS lexical_rank
  FROM d FULL JOIN x ON d.query_id = x.query_id AND d.doc_id = x.doc_id)"""


RRF = """rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, coalesce(dense_score, 0) DESC, coalesce(lexical_score, 0) DESC, doc_id)::INT AS rank FROM (
  SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 6) AS hybrid_score FROM j))"""
FB = "fb AS (SELECT doc_id AS chunk_id, doc_id % (SELECT count(*) FROM benchmark) AS query_id, CASE WHEN quality = 1 THEN 'relevant' ELSE 'not_relevant' END AS label, 1700000000 + (doc_id % 2000) * 3600 AS upd FROM labels)"
ADJ = f"""adj AS (SELECT query_id, doc_id, round(greatest(-0.35, least(0.35, 0.30::DOUBLE * coalesce(vs / ws, 0) + 0.10::DOUBLE * (r - n) / (r + n + 2))), 6) AS adjustment, m AS query_matches, r AS relevant_count, n AS not_relevant_count FROM (
  SELECT query_id, doc_id, sum(w) AS ws, sum(w * v) AS vs, count(w) AS m, count(*) FILTER (v > 0) AS r, count(*) FILTER (v < 0) AS n FROM (
    SELECT c.query_id, c.doc_id, CASE WHEN label = 'relevant' THEN 1.0::DOUBLE ELSE -1.0 END AS v,
      CASE WHEN sim >= 0.2 THEN sim * exp(-ln(2) * greatest(0, (1706745600 - upd) / 86400.0::DOUBLE) / 30) END AS w
    FROM (SELECT l.query_id, l.doc_id, f.label, f.upd,
        len(list_intersect(a.terms, b.terms))::DOUBLE / len(list_distinct(list_concat(a.terms, b.terms))) AS sim
      FROM lex l JOIN fb f ON f.chunk_id = l.doc_id JOIN q a ON a.query_id = l.query_id JOIN q b ON b.query_id = f.query_id WHERE l.rank <= 30) c)
  GROUP BY 1, 2))"""
LINES = """ln0 AS (SELECT doc_id, lang, source, list_filter(string_split(text, chr(10)), lambda z: trim(z) <> '') AS l FROM documents),
ln1 AS (SELECT doc_id, lang, source, unnest(l) AS text, unnest(range(len(l))) AS ord FROM ln0),
seg AS (SELECT doc_id, lang, source, ord, text, e - 10 - length(text) AS start_ds, e AS end_ds FROM (
  SELECT *, (sum(10 + length(text)) OVER (PARTITION BY doc_id ORDER BY ord))::BIGINT AS e FROM ln1))"""
GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def scores(rows: str, name: str) -> str:
    cuts = ", ".join(f"count(*) FILTER (rank <= {k}) AS g{k}" for k in (1, 5, 10))
    pr = ", ".join(f"round(coalesce(g{k} / {k}.0::DOUBLE, 0), 6) AS p_{k}" for k in (1, 5, 10)) + ", " + ", ".join(f"round(coalesce(g{k}::DOUBLE / n, 0), 6) AS r_{k}" for k in (1, 5, 10))
    return f"""{name}_n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1),
{name}_h AS (SELECT query_id, {cuts}, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM {rows} JOIN gold USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1),
{name} AS (SELECT q.query_id, {pr}, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg
  FROM q LEFT JOIN {name}_n USING (query_id) LEFT JOIN {name}_h USING (query_id))"""


CLEAN = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
MEAN, JP = f"[A-Za-z0-9{CJK}]", f"[{CJK}]"


def cur(rows: str) -> str:
    """CTEs of curation over rows (doc_id, chunk_index, title, raw, language, start_sec, end_sec), ending in cm."""
    topic = ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{w.lower()}')" for w in ws) + f" THEN '{t}' END" for t, ws in V.TOPICS.items())
    return f"""c0 AS (SELECT *, {CLEAN.format(c="raw")} AS text FROM {rows}),
c1 AS (SELECT *, length(text) AS n, lower(text) AS low, len(regexp_extract_all(text, '{MEAN}')) AS me, len(regexp_extract_all(text, '{JP}')) AS ja, len(regexp_extract_all(text, '[A-Za-z]')) AS la,
  regexp_extract_all(lower(text), '{MEAN}') AS ch, regexp_extract_all(lower(text), '{V.WORD}') AS wd, lower(trim(coalesce(language, ''))) AS tg FROM c0),
c2 AS (SELECT *, coalesce(start_sec >= 0 AND end_sec > start_sec, false) AS ts, me::DOUBLE / greatest(1, n) AS ratio,
  CASE WHEN tg = '' THEN true WHEN starts_with(tg, 'ja') THEN ja::DOUBLE / greatest(1, me) >= 0.2 WHEN starts_with(tg, 'en') THEN la::DOUBLE / greatest(1, me) >= 0.45 AND ja::DOUBLE / greatest(1, me) < 0.2 ELSE true END AS lm,
  CASE WHEN len(ch) = 0 THEN 1.0::DOUBLE ELSE list_max(list_transform(list_distinct(ch), lambda z: length(low) - length(replace(low, z, ''))))::DOUBLE / len(ch) END AS tc,
  CASE WHEN len(ch) = 0 THEN 0.0::DOUBLE WHEN len(wd) = 0 THEN 1.0 ELSE len(list_distinct(wd))::DOUBLE / len(wd) END AS ur FROM c1),
c3 AS (SELECT *, len(ch) > 0 AND NOT (tc >= 0.55 OR (len(wd) >= 8 AND ur <= 0.25)) AS pr FROM c2),
c4 AS (SELECT *, CASE WHEN text = '' THEN ['empty_text'] ELSE list_filter([CASE WHEN NOT ts THEN 'missing_timestamp' END, CASE WHEN me < 12 OR n < 20 THEN 'too_short' END, CASE WHEN n > 4000 THEN 'too_long' END,
    CASE WHEN ratio < 0.35 THEN 'mostly_punctuation' END, CASE WHEN me < 12 THEN 'low_meaningful_text' END, CASE WHEN NOT pr THEN 'too_repetitive' END, CASE WHEN NOT lm THEN 'wrong_language' END], lambda z: z IS NOT NULL) END AS reasons,
  CASE WHEN text = '' THEN 0.0::DOUBLE ELSE round((15 + CASE WHEN n BETWEEN 40 AND 1800 THEN 15 ELSE 7 END + CASE WHEN ts THEN 15 ELSE 0 END + CASE WHEN ratio >= 0.55 THEN 15 WHEN ratio >= 0.35 THEN 7 ELSE 0 END
    + CASE WHEN me >= 30 THEN 15 WHEN me >= 12 THEN 5 ELSE 0 END + CASE WHEN pr THEN 15 ELSE 0 END + CASE WHEN lm THEN 10 ELSE 0 END - CASE WHEN n > 4000 THEN 15 ELSE 0 END) / 100.0::DOUBLE, 4) END AS qs FROM c3),
c5 AS (SELECT *, CASE WHEN text = '' THEN 'invalid' WHEN qs >= 0.8 THEN 'high_signal' WHEN qs >= 0.6 THEN 'medium_signal' WHEN qs >= 0.3 THEN 'low_signal' ELSE 'invalid' END AS ql,
  list_filter([{topic}], lambda z: z IS NOT NULL) AS t0 FROM c4),
cm AS (SELECT *, ql IN ('high_signal', 'medium_signal') AND qs >= 0.6 AND len(reasons) = 0 AS inc, CASE WHEN len(t0) > 0 THEN t0 WHEN me > 0 THEN ['general'] ELSE ['unknown'] END AS tags,
  'corpus:v1:' || doc_id || ':transcript:' || lpad(chunk_index::VARCHAR, 6, '0') AS evidence_id FROM c5),
ce AS (SELECT *, CASE WHEN inc THEN '' WHEN len(reasons) > 0 THEN array_to_string(reasons, ';') WHEN qs < 0.6 THEN 'below_quality_threshold' ELSE 'low_quality' END AS why FROM cm)"""


SEGROWS = "rows0 AS (SELECT doc_id, ord AS chunk_index, text AS raw, lang AS language, start_ds / 10.0::DOUBLE AS start_sec, end_ds / 10.0::DOUBLE AS end_sec FROM seg)"
CUR = f"{LINES}, {SEGROWS}, {cur('rows0')}"
ESTIMATE = """(CASE WHEN {t} = '' THEN 0 WHEN {l} = 'ja' OR regexp_matches({t}, '{jp}') THEN greatest(1, ceil(length(replace({t}, ' ', '')) / 2.0)) WHEN len(regexp_extract_all({t}, '{w}')) > 0 THEN len(regexp_extract_all({t}, '{w}')) ELSE greatest(1, ceil(length({t}) / 4.0)) END)::BIGINT"""
TIME = f"""WITH RECURSIVE {LINES}, tc AS (
  SELECT doc_id, 0::BIGINT AS i, min(start_ds) AS s FROM seg GROUP BY 1
  UNION ALL SELECT tc.doc_id, tc.i + 1, (SELECT min(start_ds) FROM seg g WHERE g.doc_id = tc.doc_id AND g.start_ds >= tc.s + 450) FROM tc
  WHERE EXISTS (SELECT 1 FROM seg g WHERE g.doc_id = tc.doc_id AND g.start_ds >= tc.s + 450)),
ct AS (SELECT tc.doc_id, i AS chunk_index, min(start_ds) AS start_ds, max(end_ds) AS end_ds, min(ord) AS first_ord, count(*) AS n_lines, trim(string_agg(trim(text), ' ' ORDER BY ord)) AS raw_text
  FROM tc JOIN seg ON seg.doc_id = tc.doc_id AND start_ds >= s AND start_ds < s + 600 GROUP BY 1, 2)"""
TOKC = """tl AS (SELECT *, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n FROM seg),
tr AS (SELECT *, coalesce(sum(n) OVER w, 0) AS lo, coalesce(sum(n) OVER w, 0) + n AS hi, sum(n) OVER (PARTITION BY doc_id) AS total FROM tl WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tw AS (SELECT doc_id, total, unnest(range(0, greatest(0, ceil((total - {n}) / {step}.0))::BIGINT + 1)) AS i FROM (SELECT DISTINCT doc_id, total FROM tr WHERE total > 0)),
tk AS (SELECT tw.doc_id, i AS chunk_index, min(start_ds) AS start_ds, max(end_ds) AS end_ds, min(ord) AS first_ord, count(*) AS n_lines, string_agg(trim(text), ' ' ORDER BY ord) AS raw_text
  FROM tw JOIN tr ON tr.doc_id = tw.doc_id AND hi > i * {step} AND lo < least(i * {step} + {n}, tw.total) GROUP BY 1, 2)"""
RUNS = f"""{LEX}, {DENSE}, {both()}, {RRF}, {GOLD}, l10 AS (SELECT * FROM lex WHERE rank <= 10), r10 AS (SELECT * FROM rrf WHERE rank <= 10), {scores("l10", "sl")}, {scores("r10", "sr")},
sc AS (SELECT 'lexical' AS run, * FROM sl UNION ALL SELECT 'hybrid', * FROM sr),
lat AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'lexical' ELSE 'hybrid' END AS run, round(coalesce(value, 0), 3) AS ms FROM events),
rs AS (SELECT run, {", ".join(f"round(coalesce({m}, 0), 6) AS {m}" for m in ("p_5", "r_5", "mrr", "ndcg"))}, round(a, 6) AS mean_latency_ms, round(p, 6) AS p95_latency_ms, 0::BIGINT AS failed_query_count
  FROM (SELECT run, avg(ms) AS a, quantile_cont(ms, 0.95) AS p FROM lat GROUP BY 1) JOIN (SELECT run, avg(p_5) AS p_5, avg(r_5) AS r_5, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM sc GROUP BY 1) USING (run))"""
CAND = f"{LEX}, cd AS (SELECT query_id, doc_id, rank, source, tokens, (doc_id * 5)::DOUBLE AS start FROM lex JOIN tok USING (doc_id) WHERE rank <= 30)"
PROFILE = f"""{LINES}, pl AS (SELECT doc_id, ord, start_ds, end_ds, {CLEAN.format(c="text")} AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM seg),
po AS (SELECT doc_id, rtrim(substr(string_agg(t, ' ' ORDER BY ord), 1, 2400)) AS o FROM pl WHERE list_contains(list_transform(range(0, least(8, n)), lambda i: i * n // least(8, n)), ord) GROUP BY 1),
pg AS (SELECT *, list_filter(range(0, least(5, n)), lambda g: ord >= g * n // least(5, n) AND ord < (g + 1) * n // least(5, n))[1] AS g FROM pl),
ps AS (SELECT doc_id, g, min(start_ds) AS start_ds, rtrim(substr(string_agg(t, ' ' ORDER BY ord), 1, 1800)) AS t FROM pg GROUP BY 1, 2),
pa AS (SELECT doc_id, count(*) AS n, string_agg(start_ds::VARCHAR, ',' ORDER BY g) AS starts, string_agg(t, chr(10) ORDER BY g) AS st FROM ps GROUP BY 1),
pf AS (SELECT d.doc_id, split_part(coalesce(d.text, ''), chr(10), 1) AS title, coalesce(nullif(o, ''), split_part(coalesce(d.text, ''), chr(10), 1)) AS overview, coalesce(n, 0) AS n_sections, coalesce(starts, '') AS starts, coalesce(st, '') AS st FROM documents d LEFT JOIN po USING (doc_id) LEFT JOIN pa USING (doc_id)),
px AS (SELECT *, title || chr(10) || overview || chr(10) || st AS lexical_text FROM pf)"""
ROUTES = f"""{PROFILE}, {QRY}, rt AS (SELECT doc_id AS source_id, list_distinct(list_concat(regexp_extract_all(lower(lexical_text), '[a-z0-9_]+'), [])) AS tokens FROM px),
ro AS (SELECT query_id, source_id, round(count(*) / sqrt(any_value(qn)::DOUBLE * any_value(sn)), 6) AS lexical_score FROM (SELECT source_id, len(tokens) AS sn, unnest(tokens) AS t FROM rt)
  JOIN (SELECT query_id, len(list_distinct(terms)) AS qn, unnest(list_distinct(terms)) AS t FROM q) USING (t) GROUP BY 1, 2),
rl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, source_id)::INT AS lr FROM ro)"""


def assess(rows: str, name: str, mode: str) -> str:
    parts = ["0.15::DOUBLE * rs + 0.45::DOUBLE * os", "0.60::DOUBLE"]
    if mode in ("dense", "hybrid"):
        parts = [parts[0] + " + 0.25::DOUBLE * ds", parts[1] + " + 0.25"]
    if mode in ("lexical", "hybrid"):
        parts = [parts[0] + " + 0.15::DOUBLE * ls", parts[1] + " + 0.15"]
    return f"""{name}0 AS (SELECT r.*, len(list_intersect(q.terms, tok.tokens))::DOUBLE / greatest(len(list_distinct(q.terms)), 1) AS ov, max(coalesce(lexical_score, 0)) OVER (PARTITION BY query_id) AS top FROM {rows} r JOIN tok USING (doc_id) JOIN q USING (query_id)),
{name}1 AS (SELECT *, greatest(0, least(1, 1 - (rank - 1) / 5.0::DOUBLE)) AS rs, greatest(0, least(1, ov / 0.6::DOUBLE)) AS os,
  CASE WHEN dense_score IS NULL THEN 0 ELSE greatest(0, least(1, (dense_score - 0.55) / 0.30::DOUBLE)) END AS ds, CASE WHEN lexical_score IS NULL OR top <= 0 THEN 0 ELSE greatest(0, least(1, lexical_score / top)) END AS ls FROM {name}0),
{name}2 AS (SELECT *, round(({parts[0]}) / ({parts[1]}), 6) AS st FROM {name}1),
{name}3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY st DESC, rank) AS k, CASE WHEN st >= 0.55 AND ov >= 0.18 THEN 1 END AS sup FROM {name}2),
{name}4 AS (SELECT *, sum(sup) OVER (PARTITION BY query_id ORDER BY k) AS sk FROM {name}3),
{name}5 AS (SELECT query_id, count(*) AS n, max(st) FILTER (k = 1) AS s1, max(ov) FILTER (k = 1) AS o1, max(st) FILTER (k = 2) AS s2, count(sup) AS ns, max(st) FILTER (sup = 1 AND sk = 2) AS p2 FROM {name}4 GROUP BY 1),
{name} AS (SELECT q.query_id, coalesce(ns >= 2 OR (s1 >= 0.72 AND o1 >= 0.28 AND coalesce(s2 < 0.48, true)), false) AS sufficient,
  CASE WHEN ns >= 2 AND s1 >= 0.78 AND p2 >= 0.60 THEN 'high' WHEN ns >= 2 OR (s1 >= 0.72 AND o1 >= 0.28 AND coalesce(s2 < 0.48, true)) THEN 'medium' ELSE 'low' END AS confidence_cap,
  CASE WHEN n IS NULL THEN 'no_results' WHEN ns >= 2 THEN 'multi_chunk_support' WHEN s1 >= 0.72 AND o1 >= 0.28 AND coalesce(s2 < 0.48, true) THEN 'strong_single_chunk' WHEN n = 1 THEN 'single_weak_chunk' WHEN s2 >= 0.45 THEN 'mixed_signals' ELSE 'thin_support' END AS reason_code,
  s1 AS top_strength, coalesce(n, 0) AS n FROM q LEFT JOIN {name}5 USING (query_id))"""


LOG = "lg AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type AS level, user_id AS job_id FROM events)"
CASES = f"""{VQ.format(on="")}, v AS (SELECT vec_id, label::BIGINT AS l FROM embeddings), h AS (SELECT query_id, l, min(rank) AS r FROM vq JOIN v USING (vec_id) WHERE rank <= 10 GROUP BY 1, 2),
p AS (SELECT query_id, list(l ORDER BY r) AS ranked FROM h GROUP BY 1),
c AS (SELECT vec_id AS query_id, l, CASE WHEN vec_id % 100 = 0 THEN [] ELSE [(l + 1) % 10, (l + 2) % 10] END AS ds FROM v WHERE vec_id % 20 = 0),
k AS (SELECT query_id, CASE WHEN ranked IS NULL THEN 'missing' ELSE 'scored' END AS status, list_position(ranked, l) AS fr, list_min(list_filter(list_transform(ds, lambda z: list_position(ranked, z)), lambda z: z > 0)) AS fd, len(ds) AS nd FROM c LEFT JOIN p USING (query_id)),
rc AS (SELECT query_id, status, {", ".join(f"CASE WHEN fr > 0 AND fr <= {x} THEN 1.0::DOUBLE ELSE 0.0 END AS recall_{x}" for x in (1, 3, 5))}, CASE WHEN fr > 0 THEN round(1.0::DOUBLE / fr, 6) ELSE 0.0 END AS mrr,
  CASE WHEN nd > 0 THEN coalesce(fd < CASE WHEN fr > 0 THEN fr ELSE 1099511627776 END, false) END AS distractor_error FROM k)"""
PARTS = "grp AS (SELECT doc_id, ord, start_ds, end_ds, text, list_filter(range(0, k), lambda g: ord >= round_even(g * n / k::DOUBLE, 0) AND ord < round_even((g + 1) * n / k::DOUBLE, 0))[1]::INT AS section FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, least(5, count(*) OVER (PARTITION BY doc_id)) AS k FROM seg)), sg AS (SELECT doc_id, section, min(start_ds) AS start_ds, max(end_ds) AS end_ds, count(*) AS n_lines, string_agg(trim(text), ' ' ORDER BY ord) AS text FROM grp GROUP BY 1, 2)"
CLOCK = "CASE WHEN s >= 3600 THEN printf('{a}', s // 3600, (s % 3600) // 60, s % 60) ELSE printf('{b}', s // 60, s % 60) END"
PROVIDER = "['data_api', 'oembed', 'fallback', 'legacy'][doc_id % {m} % 4 + 1]"
PRIO = "CASE {c} WHEN 'data_api' THEN 2 WHEN 'oembed' THEN 1 ELSE 0 END"

ORACLES = {
    "lexical_bm25_topk": f"WITH {LEX} SELECT query_id, doc_id, lexical_score, rank FROM lex WHERE rank <= 10",
    "bm25_scoped_by_source": f"""WITH {TOK}, {QRY}, p AS (SELECT source, doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT source, doc_id, len(tokens) AS len, unnest(tokens) AS term FROM tok) GROUP BY 1, 2, 3),
df AS (SELECT source, term, count(*) AS df FROM p GROUP BY 1, 2), st AS (SELECT source, count(*) AS docs, avg(len(tokens)) AS al FROM tok GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum({WEIGHT}), 6) AS lexical_score FROM qu JOIN p ON p.term = qu.term AND p.source = 'src' || (query_id % 20) JOIN df ON df.source = p.source AND df.term = p.term JOIN st ON st.source = p.source GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, doc_id)::INT AS rank FROM s WHERE lexical_score > 0) SELECT * FROM r WHERE rank <= 10""",
    "postings_stats": f"WITH {TOK} SELECT term, count(*) AS df, sum(n)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY 1, 2) GROUP BY 1",
    "dense_exact_topk": f"WITH {VQ.format(on='')} SELECT query_id, vec_id, dense_score, rank FROM vq WHERE rank <= 10",
    "dense_scoped_topk": f"WITH {VQ.format(on='AND y.label = x.label')} SELECT query_id, vec_id, dense_score, rank FROM vq WHERE rank <= 5",
    "hybrid_rrf": f"WITH {LEX}, {DENSE}, {both()}, {RRF} SELECT query_id, doc_id, hybrid_score, dense_rank, lexical_rank, rank FROM rrf WHERE rank <= 10",
    "hybrid_weighted": f"""WITH {LEX}, {DENSE}, d AS (SELECT *, CASE WHEN hi - lo <= 1e-12 THEN (hi > 0)::INT ELSE (dense_score - lo) / (hi - lo) END AS dn FROM (SELECT *, min(dense_score) OVER w AS lo, max(dense_score) OVER w AS hi FROM den WHERE rank <= 80 WINDOW w AS (PARTITION BY query_id))),
x AS (SELECT *, CASE WHEN hi - lo <= 1e-12 THEN (hi > 0)::INT ELSE (lexical_score - lo) / (hi - lo) END AS ln FROM (SELECT *, min(lexical_score) OVER w AS lo, max(lexical_score) OVER w AS hi FROM lex WHERE rank <= 80 WINDOW w AS (PARTITION BY query_id))),
j AS (SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.doc_id, x.doc_id) AS doc_id, dense_score, lexical_score, d.rank AS dr, x.rank AS lr,
  round(0.475::DOUBLE * coalesce(dn, 0) + 0.475::DOUBLE * coalesce(ln, 0) + CASE WHEN dn IS NOT NULL AND ln IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END, 6) AS hybrid_score FROM d FULL JOIN x ON d.query_id = x.query_id AND d.doc_id = x.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, coalesce(lexical_score, 0) DESC, coalesce(dense_score, 0) DESC, lr NULLS LAST, dr NULLS LAST, doc_id)::INT AS rank FROM j)
SELECT query_id, doc_id, hybrid_score, rank FROM r WHERE rank <= 10""",
    "minmax_normalise": f"WITH {LEX} SELECT query_id, doc_id, round(CASE WHEN abs(hi - lo) <= 1e-12 THEN (hi > 0)::INT ELSE (lexical_score - lo) / (hi - lo) END, 6) AS normalised FROM (SELECT *, min(lexical_score) OVER w AS lo, max(lexical_score) OVER w AS hi FROM lex WHERE rank <= 30 WINDOW w AS (PARTITION BY query_id))",
    "multimodal_merge": f"""WITH {LEX}, pt AS (SELECT page_id AS doc_id, regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[a-z0-9_]+') AS tokens FROM pages), {lexical("pt", "pg")},
u AS (SELECT query_id, doc_id, lexical_score AS score, 'transcript' AS kind, 0 AS side FROM lex WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, lexical_score, 'page', 1 FROM pg WHERE rank <= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, side, doc_id)::INT AS rank FROM u) SELECT query_id, doc_id, score, kind, rank FROM r WHERE rank <= 10""",
    "feedback_index": f"WITH {FB} SELECT chunk_id, count(*) FILTER (label = 'relevant') AS relevant_count, count(*) FILTER (label <> 'relevant') AS not_relevant_count FROM fb GROUP BY 1",
    "feedback_adjustment": f"WITH {LEX}, {FB}, {ADJ} SELECT * FROM adj",
    "feedback_rerank": f"WITH {LEX}, {FB}, {ADJ}, b AS (SELECT query_id, doc_id, round(lexical_score + coalesce(adjustment, 0), 6) AS score, coalesce(adjustment, 0) AS adjustment, rank AS pr FROM lex LEFT JOIN adj USING (query_id, doc_id) WHERE rank <= 30) SELECT query_id, doc_id, score, adjustment, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pr)::INT AS rank FROM b",
    "feedback_latest": f"WITH {FB} SELECT query_id, chunk_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY upd DESC, chunk_id DESC) AS k FROM fb) WHERE k = 1",
    "feedback_by_source": f"WITH {FB} SELECT source, count(*) FILTER (label = 'relevant') AS relevant_count, count(*) FILTER (label <> 'relevant') AS not_relevant_count FROM fb JOIN documents ON doc_id = chunk_id GROUP BY 1",
    "feedback_filter_page": f"WITH {FB} SELECT chunk_id, query_id FROM fb WHERE label = 'not_relevant' ORDER BY upd DESC, chunk_id LIMIT 25 OFFSET 10",
    "jaccard_near_dup_pairs": f"""WITH {CAND}, pr AS (SELECT a.query_id, a.source, a.doc_id AS left_id, b.doc_id AS right_id, abs(a.start - b.start) AS apart,
  round(CASE WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN 0 ELSE len(list_intersect(a.tokens, b.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens, b.tokens))) END, 6) AS jaccard
  FROM cd a JOIN cd b ON a.query_id = b.query_id AND a.source = b.source AND a.doc_id < b.doc_id) SELECT * FROM pr WHERE apart <= 8 OR jaccard >= 0.85""",
    "chunk_time": f"{TIME} SELECT * FROM ct",
    "chunk_token": f"WITH {LINES}, {TOKC.format(n=256, step=192)} SELECT * FROM tk",
    "chunk_stats": f"WITH {LINES}, {TOKC.format(n=128, step=96)} SELECT doc_id, count(*) AS chunks, sum(length(raw_text))::BIGINT AS chars, round(avg(length(raw_text)), 1) AS avg_chars, min(length(raw_text)) AS min_chars, max(length(raw_text)) AS max_chars FROM tk GROUP BY 1",
    "segments_full_transcript": "SELECT doc_id, array_to_string(l, chr(10)) AS text, len(l) AS segment_count, length(array_to_string(l, chr(10))) AS char_count FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda z: trim(z) <> '') AS l FROM documents)",
    "read_context": f"""WITH {LINES}, b AS (SELECT d.doc_id, coalesce(n, 0) AS n, lo, hi, coalesce(m, 0) AS tm FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, min(start_ds) AS lo, max(end_ds) AS hi FROM seg GROUP BY 1) USING (doc_id)
  LEFT JOIN (SELECT doc_id, start_ds AS m FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM seg) WHERE ord = n // 2) USING (doc_id)),
w AS (SELECT *, greatest(lo, tm - 300) AS rs, least(hi, tm + 300) AS re FROM b),
h AS (SELECT w.doc_id, min(start_ds) AS s, max(end_ds) AS e, count(*) AS c, string_agg(trim(text), chr(10) ORDER BY ord) AS t FROM w JOIN seg ON seg.doc_id = w.doc_id AND end_ds >= rs AND start_ds <= re GROUP BY 1)
SELECT doc_id, CASE WHEN n = 0 THEN 'no_transcript' ELSE 'ok' END AS status, CASE WHEN n > 0 THEN rs END AS requested_start, CASE WHEN n > 0 THEN re END AS requested_end, s AS start, e AS "end", coalesce(c, 0) AS segment_count, coalesce(t, '') AS text FROM w LEFT JOIN h USING (doc_id)""",
    "nearest_segment": f"""WITH {LINES}, e AS (SELECT doc_id, max(end_ds) AS e FROM seg GROUP BY 1), a AS (SELECT doc_id, unnest(range(5)) AS anchor, unnest(range(5)) * e // 5 AS tm FROM e)
SELECT doc_id, anchor, ord, apart FROM (SELECT a.doc_id, anchor, ord, abs(start_ds - tm) AS apart, row_number() OVER (PARTITION BY a.doc_id, anchor ORDER BY abs(start_ds - tm), ord) AS k FROM a JOIN seg USING (doc_id)) WHERE k = 1""",
    "interval_overlap": f"{TIME} SELECT ct.doc_id, chunk_index, count(*) AS segments, min(ord) AS first_ord FROM ct JOIN seg ON seg.doc_id = ct.doc_id AND greatest(seg.start_ds, ct.start_ds) < least(seg.end_ds, ct.end_ds) GROUP BY 1, 2",
    "summary_windows": f"""WITH RECURSIVE {LINES}, f AS (SELECT doc_id, ord, length(text) AS n, 0::BIGINT AS w, (length(text) + 48)::BIGINT AS used FROM seg WHERE ord = 0
  UNION ALL SELECT f.doc_id, s.ord, length(s.text), CASE WHEN f.used + length(s.text) + 48 > 2000 THEN f.w + 1 ELSE f.w END, CASE WHEN f.used + length(s.text) + 48 > 2000 THEN 0 ELSE f.used END + length(s.text) + 48
  FROM f JOIN seg s ON s.doc_id = f.doc_id AND s.ord = f.ord + 1)
SELECT doc_id, w AS "window", min(ord) AS first_ord, count(*) AS n_lines, sum(n)::BIGINT AS chars FROM f GROUP BY 1, 2""",
    "curate_manifest": f"WITH {CUR} SELECT evidence_id, doc_id, chunk_index, n AS text_length, {ESTIMATE.format(t='text', l='language', jp=JP, w=V.WORD)} AS token_estimate, ts AS has_timestamp, qs AS quality_score, ql AS quality_label, array_to_string(tags, '|') AS topics, inc AS included, CASE WHEN inc THEN 'quality_threshold_met' ELSE '' END AS inclusion_reason, why AS exclusion_reason FROM ce",
    "curate_report": f"WITH {CUR} SELECT count(*) AS total_records, count(*) FILTER (inc) AS eligible_records, count(*) FILTER (NOT inc) AS excluded_records, round(count(*) FILTER (inc)::DOUBLE / count(*), 4) AS eligibility_rate, round(avg(qs), 4) AS avg_quality_score, round(min(qs), 4) AS min_quality_score, round(max(qs), 4) AS max_quality_score, count(*) FILTER (NOT ts) AS records_missing_timestamp, count(*) FILTER (text = '') AS records_empty_text FROM ce",
    "curate_labels": f"WITH {CUR} SELECT ql AS quality_label, count(*) AS n FROM ce GROUP BY 1",
    "curate_topics": f"WITH {CUR} SELECT topic, count(*) AS n FROM (SELECT unnest(tags) AS topic FROM ce) GROUP BY 1",
    "curate_inference": f"WITH {CUR} SELECT 'run-1:' || evidence_id AS inference_run_id, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN 0.0::DOUBLE ELSE qs END AS score, CASE WHEN bad THEN 'invalid' ELSE ql END AS label, CASE WHEN NOT bad THEN why END AS exclusion_reason, CASE WHEN chunk_index % 7 = 6 THEN 'ValueError: start_sec is not a number: soon' WHEN bad THEN 'ValueError: end_sec is not a number: late' ELSE '' END AS error_message FROM (SELECT *, chunk_index % 7 = 6 OR chunk_index % 11 = 10 AS bad FROM ce)",
    "manifest_filter_page": f"WITH {CUR} SELECT evidence_id, qs AS quality_score FROM ce WHERE ql = 'high_signal' AND inc AND list_contains(tags, 'technology') ORDER BY qs DESC, evidence_id LIMIT 50 OFFSET 20",
    "token_estimate": f"SELECT doc_id, {ESTIMATE.format(t='t', l='lang', jp=JP, w=V.WORD)} AS tokens FROM (SELECT doc_id, lang, {CLEAN.format(c='text')} AS t FROM documents)",
    "language_match": f"WITH rows0 AS (SELECT doc_id, 0 AS chunk_index, text AS raw, 'en' AS language, 0.0::DOUBLE AS start_sec, 1.0::DOUBLE AS end_sec FROM documents), {cur('rows0')} SELECT doc_id, ja AS japanese, la AS latin, me AS meaningful, lm AS language_matches FROM c2",
    "repetition_signals": f"WITH rows0 AS (SELECT doc_id, 0 AS chunk_index, text AS raw, lang AS language, 0.0::DOUBLE AS start_sec, 1.0::DOUBLE AS end_sec FROM documents), {cur('rows0')} SELECT doc_id, round(tc, 4) AS top_char, round(ur, 4) AS unique_ratio, pr AS passes_repetition FROM c3",
    "keywords_topk": f"""WITH {TOK}, k AS (SELECT doc_id, keyword, count(*) AS n, min(pos) AS f FROM (SELECT doc_id, unnest(tokens) AS keyword, unnest(range(len(tokens))) AS pos FROM tok) WHERE length(keyword) BETWEEN 4 AND 18 AND NOT list_contains({_words(V.STOP_WORDS)}, keyword) GROUP BY 1, 2)
SELECT doc_id, keyword, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f)::INT AS rank FROM k) WHERE rank <= 8""",
    "query_rewrite": f"""WITH t AS (SELECT conv_id, turn, text AS t FROM conversations), r AS (SELECT *, array_to_string(list_filter(regexp_extract_all(lower(t), '[a-z0-9_]+'), lambda z: NOT list_contains({_words(V.QUESTION_WORDS)}, z)), ' ') AS n, lower({CLEAN.format(c='t')}) AS o FROM t)
SELECT conv_id, turn, CASE WHEN n = '' OR n = o OR o = '' THEN NULL ELSE n END AS rewrite FROM r""",
    "tool_choice": f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{JP}') OR regexp_matches(text, '[\"“”「」『』]') OR regexp_matches(text, '\\d') OR regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z]{{2,}}($|[^\\p{{L}}\\p{{N}}_])') THEN 'keyword_search' ELSE 'semantic_search' END AS tool FROM conversations",
    "english_tokens": f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda z: z <> '' AND NOT list_contains({_words(V.STOP_WORDS)}, z)), ' ') AS tokens FROM documents",
    "char_bigrams": f"WITH t AS (SELECT item_id, replace(lower({CLEAN.format(c='text')}), ' ', '') AS t FROM benchmark) SELECT item_id, (i - 1)::INT AS pos, substr(t, i, 2) AS bigram FROM (SELECT item_id, t, unnest(range(1, length(t))) AS i FROM t)",
    "snippets_and_clocks": f"""WITH t AS (SELECT doc_id, {CLEAN.format(c='text')} AS t, floor(n_chars * 1.5)::BIGINT AS s FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(substr(t, 1, 239)) || '…' END AS snippet, CASE WHEN length(t) <= 100 THEN t ELSE regexp_replace(substr(t, 1, 100), '\\s\\S*$', '') || '...' END AS clipped,
printf('%02d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) AS hhmmss, {CLOCK.format(a='%d:%02d:%02d', b='%d:%02d')} AS clock, {CLOCK.format(a='%02d:%02d:%02d', b='%02d:%02d')} AS padded, printf('%d:%02d', s // 60, s % 60) AS minutes FROM t""",
    "query_hashes": f"""WITH {QRY} SELECT query_id, substr(sha256('{{"query":"' || array_to_string(terms, ' ') || '","retrieval_mode":"hybrid"}}'), 1, 16) AS query_hash FROM q""",
    "json_props": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "url_parts": "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 't=12s' AS timed FROM pages",
    "page_title": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
    "precision_recall_mrr_ndcg": f"WITH {LEX}, {GOLD}, l10 AS (SELECT * FROM lex WHERE rank <= 10), {scores('l10', 'sl')} SELECT * FROM sl",
    "run_metrics": f"WITH {RUNS} SELECT * FROM rs",
    "run_select": f"WITH {RUNS}, z AS (SELECT run, round(0.40::DOUBLE * r_5 + 0.35::DOUBLE * mrr + 0.25::DOUBLE * ndcg, 6) AS quality, p95_latency_ms FROM rs) SELECT run, quality, row_number() OVER (ORDER BY quality DESC, p95_latency_ms, run DESC) = 1 AS selected FROM z",
    "thresholds": f"""WITH {RUNS}, b AS (SELECT * FROM rs WHERE run = 'hybrid'), c AS (SELECT * FROM rs WHERE run = 'lexical'),
k AS ({" UNION ALL ".join(f"SELECT 'lexical' AS run, '{m}' AS metric, b.{m} AS baseline, c.{m} AS candidate, c.{m} >= {a} OR CASE WHEN b.{m} = 0 THEN c.{m} > 0 ELSE (c.{m} - b.{m}) / abs(b.{m}) >= {r} END AS passed FROM b, c" for m, (a, r) in {"r_5": (0.85, 0.10), "mrr": (0.70, 0.10), "ndcg": (0.75, 0.05)}.items())}
UNION ALL SELECT 'lexical', 'p95_latency_ms', b.p95_latency_ms, c.p95_latency_ms, b.p95_latency_ms <= 0 OR c.p95_latency_ms <= b.p95_latency_ms * 1.2 FROM b, c
UNION ALL SELECT 'lexical', 'failed_query_count', 0.0::DOUBLE, c.failed_query_count::DOUBLE, c.failed_query_count <= 0 FROM c) SELECT * FROM k""",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "labelled_metrics": f"""WITH {LEX}, {FB}, i AS (SELECT l.query_id, rank, coalesce(label = 'relevant', false)::INT AS rel FROM lex l LEFT JOIN fb ON chunk_id = doc_id WHERE rank <= 30),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ir FROM i),
g AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS h, sum(rel) AS n, min(CASE WHEN rel = 1 AND rank <= 10 THEN rank END) AS f, sum(CASE WHEN rank <= 10 AND rel = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ir <= 10 AND rel = 1 THEN 1 / log2(ir + 1) ELSE 0 END) AS idcg FROM o GROUP BY 1)
SELECT query_id, round(h / 10.0::DOUBLE, 6) AS precision, round(h::DOUBLE / nullif(n, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, round(coalesce(dcg / CASE WHEN idcg > 0 THEN idcg END, 0), 6) AS ndcg FROM g""",
    "run_compare": f"WITH {RUNS}, u AS (SELECT query_id, trim(array_to_string(terms, ' ')) AS query FROM q) SELECT query, round(sr.r_5 - sl.r_5, 6) AS delta_r_5, round(sr.mrr - sl.mrr, 6) AS delta_mrr, round(sr.ndcg - sl.ndcg, 6) AS delta_ndcg FROM u JOIN sl USING (query_id) JOIN sr USING (query_id)",
    "vector_recall_by_label": f"WITH {VQ.format(on='')} SELECT x.label, count(*) AS n, round(avg((x.label = y.label)::INT), 6) AS precision FROM vq JOIN embeddings x ON x.vec_id = vq.query_id JOIN embeddings y ON y.vec_id = vq.vec_id WHERE rank <= 10 GROUP BY 1",
    "distractor_errors": f"WITH {CASES} SELECT * FROM rc",
    "routing_eval_report": f"WITH {CASES} SELECT count(*) AS n, count(*) FILTER (status = 'scored') AS scored, {', '.join(f'round(avg({m}) FILTER (status = {chr(39)}scored{chr(39)}), 6) AS {m}' for m in ('recall_1', 'recall_3', 'recall_5', 'mrr'))}, round(avg(distractor_error::INT) FILTER (status = 'scored'), 6) AS distractor_error_rate, CASE WHEN count(*) FILTER (status = 'scored') = 0 THEN 'empty' WHEN count(*) FILTER (status = 'scored') < count(*) THEN 'partial' ELSE 'complete' END AS coverage FROM rc",
    "dataset_violations": f"WITH {GOLD} SELECT 'unknown_document' AS problem, doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'no_gold', item_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM gold)",
    "evidence_assessment": f"WITH {LEX}, {DENSE}, {both(40, 40)}, {RRF}, r5 AS (SELECT query_id, doc_id, rank, dense_score, lexical_score FROM rrf WHERE rank <= 5), {assess('r5', 'ev', 'hybrid')} SELECT query_id, sufficient, confidence_cap, reason_code, top_strength FROM ev",
    "tool_policy": f"""WITH {LEX}, {DENSE}, l5 AS (SELECT query_id, doc_id, rank, NULL::DOUBLE AS dense_score, lexical_score FROM lex WHERE rank <= 5), d5 AS (SELECT query_id, doc_id, rank, dense_score, NULL::DOUBLE AS lexical_score FROM den WHERE rank <= 5), {assess('l5', 'al', 'lexical')}, {assess('d5', 'ad', 'dense')}
SELECT al.query_id, CASE WHEN NOT al.sufficient AND (ad.sufficient OR ad.n > al.n) THEN 'semantic_search' ELSE 'keyword_search' END AS tool, CASE WHEN al.sufficient THEN 1 ELSE 2 END AS attempts FROM al JOIN ad USING (query_id)""",
    "citations": f"""WITH {LEX}, r AS (SELECT l.query_id, rank AS citation_id, l.doc_id, n_chars AS s, n_chars + 30 AS e, {CLEAN.format(c='text')} AS t FROM lex l JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT query_id, citation_id, doc_id, {CLOCK.format(a='%d:%02d:%02d', b='%d:%02d')} || '-' || {CLOCK.format(a='%d:%02d:%02d', b='%d:%02d').replace(' s ', ' e ').replace('s ', 'e ')} AS label, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(substr(t, 1, 239)) || '…' END AS snippet,
'Retrieved chunk #' || citation_id || ' for the question.' AS reason, 'https://media.example/watch?v=' || doc_id || '&t=' || s || 's' AS url FROM r""",
    "routing_profiles": f"WITH {PROFILE} SELECT doc_id, overview, n_sections, starts, md5(lexical_text) AS lexical_md5 FROM px",
    "routing_vector_agg": f"""WITH {VQ.format(on='')}, f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1), h AS (SELECT query_id, e.label::BIGINT AS source_id, f.vec_id IS NOT NULL AS idt, dense_score AS s FROM vq JOIN embeddings e USING (vec_id) LEFT JOIN f ON f.vec_id = e.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY s DESC) AS r FROM h), g AS (SELECT query_id, source_id, max(s) FILTER (r = 1) AS a, max(s) FILTER (r = 2) AS b, max(s) FILTER (idt) AS i FROM k GROUP BY 1, 2), m AS (SELECT *, CASE WHEN b IS NULL THEN a ELSE 0.7::DOUBLE * a + 0.3::DOUBLE * b END AS mv FROM g)
SELECT query_id, source_id, round(0.85::DOUBLE * mv + 0.15::DOUBLE * coalesce(i, mv), 9) AS dense_score FROM m""",
    "routing_search": f"""WITH {ROUTES}, {DENSE}, j AS (SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.doc_id, l.source_id) AS source_id, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + lr) + 0.02::DOUBLE * lexical_score, 0), 6) AS score FROM den d FULL JOIN rl l ON d.query_id = l.query_id AND d.doc_id = l.source_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id)::INT AS rank FROM j) WHERE rank <= 5""",
    "routing_variants": f"""WITH {ROUTES}, {DENSE}, a AS (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source_id) AS rank, lexical_score AS ls FROM (SELECT *, round(1.0::DOUBLE / (60 + lr) + 0.02::DOUBLE * lexical_score, 6) AS s FROM rl)),
v AS (SELECT query_id, source_id, 1.0::DOUBLE AS w, rank, ls FROM a WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 1.1::DOUBLE, rank, 0 FROM den WHERE rank <= 10), g AS (SELECT query_id, source_id, round(sum(w * (1.0::DOUBLE / (60 + rank) + 0.02::DOUBLE * ls)), 6) AS score, count(*) AS hits FROM v GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id)::INT AS rank FROM g) WHERE rank <= 5""",
    "review_shards": """WITH y AS (SELECT source, doc_id AS item_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS h, count(*) OVER (PARTITION BY source) AS n FROM labels JOIN documents USING (doc_id))
SELECT source, pos // 5 + 1 AS shard, item_id, 'primary' AS role FROM y UNION ALL SELECT source, (pos // 5 + 1) % ceil(n / 5.0)::BIGINT + 1, item_id, 'overlap' FROM y WHERE h <= round_even(n * 0.15::DOUBLE, 0) AND n > 5""",
    "adjudication": """WITH r AS (SELECT doc_id % 97 AS item_id, CASE WHEN quality = 1 THEN 'relevant' ELSE 'not_relevant' END AS l, doc_id % 5 <> 0 AS ok FROM labels), g AS (SELECT item_id, count(*) AS n, min(l) AS a, max(l) AS b, bool_and(ok) AS ok FROM r GROUP BY 1), o AS (SELECT *, CASE WHEN n >= 2 AND a = b AND ok THEN 'auto_approved' WHEN n = 1 THEN 'single_reviewer' ELSE 'needs_adjudication' END AS outcome FROM g)
SELECT item_id, n, outcome, CASE WHEN outcome = 'auto_approved' THEN a END AS final_label FROM o""",
    "study_groups": f"WITH {LINES}, {PARTS} SELECT * FROM sg",
    "section_select": f"""WITH {LINES}, {PARTS}, t AS (SELECT *, lower(text) AS low, regexp_extract_all(lower(text), '[a-z0-9_]+') AS k FROM sg),
s AS (SELECT doc_id, section, round({" + ".join(f"CASE WHEN list_contains(k, '{w}') THEN {v} WHEN contains(low, '{w}') THEN {v / 2} ELSE 0 END" for w, v in (("the", 5.0), ("thing", 5.0), ("ation", 5.0), ("over", 0.5), ("with", 0.5)))}, 3)::DOUBLE AS focus_score, ({" + ".join(f"contains(low, '{w}')::INT" for w in ("the", "thing", "ation"))})::INT AS query_match_count FROM t),
m AS (SELECT *, max(query_match_count) OVER (PARTITION BY doc_id) AS mm, max(focus_score) OVER (PARTITION BY doc_id) AS ms FROM s)
SELECT doc_id, section, focus_score, query_match_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query_match_count DESC, CASE WHEN mm > 0 OR ms > 0 THEN focus_score ELSE 0 END DESC, section)::INT AS rank FROM m WHERE mm = 0 OR query_match_count > 0) WHERE rank <= 3""",
    "even_sampling": f"WITH {LINES}, c AS (SELECT doc_id, count(*) AS n FROM seg GROUP BY 1) SELECT doc_id, unnest(CASE WHEN n <= 6 THEN range(n) ELSE list_distinct(list_transform(range(6), lambda i: round_even(i * (n - 1) / 5.0::DOUBLE, 0)::BIGINT)) END)::INT AS pos FROM c",
    "log_filter_since": f"WITH {LOG} SELECT event_id, ts FROM lg WHERE ts >= '2024-01-10T00:00:00' AND level = 'click'",
    "log_latest_job": f"WITH {LOG} SELECT event_id, ts, level, job_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS k FROM lg) WHERE k = 1",
    "history_top20": f"WITH {LOG} SELECT job_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM lg) WHERE rank <= 20",
    "source_merge": f"""WITH a AS (SELECT doc_id, {PROVIDER.format(m=4)} AS p, source AS ci, doc_id IN (SELECT doc_id FROM labels) AS has, {PROVIDER.format(m=7)} AS np, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'new' END AS nci, CASE WHEN doc_id % 2 = 0 THEN 'named' END AS ncn FROM documents),
b AS (SELECT *, has AND (np NOT IN ('fallback', 'legacy') OR nci IS NOT NULL OR ncn IS NOT NULL) AND {PRIO.format(c='np')} >= {PRIO.format(c='p')} AS take FROM a)
SELECT doc_id, CASE WHEN take THEN np ELSE p END AS provider, coalesce(CASE WHEN has THEN nci END, ci) AS channel_id, coalesce(CASE WHEN has THEN ncn END, 'old') AS channel_name, CASE WHEN take THEN '2024-02-01' ELSE '2024-01-01' END AS fetched_at FROM b""",
    "study_quality": f"""WITH {LINES}, c AS (SELECT doc_id AS deck_id, trim(regexp_replace(lower({CLEAN.format(c="text")}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS k, ord % 7 <> 6 AS ev, ord % 7 <> 6 AND ord % 3 <> 2 AND {CLEAN.format(c="text")} <> '' AS an, ord % 5 <> 4 AS ob, length({CLEAN.format(c="text")}) <= 360 AS co,
  NOT regexp_matches(lower({CLEAN.format(c="text")}), '(^|[^\\p{{L}}\\p{{N}}_])\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?($|[^\\p{{L}}\\p{{N}}_])') AS un FROM seg),
g AS (SELECT deck_id, count(*) AS cards, round(1 - count(DISTINCT k)::DOUBLE / count(*), 3) AS duplicate_rate, round(avg(ev::INT), 3) AS evidence_rate, round(avg(an::INT), 3) AS answerable_rate, round(avg(co::INT), 3) AS concise_rate, round(avg(un::INT), 3) AS untimed_rate, round(avg(ob::INT), 3) AS o FROM c GROUP BY 1),
h AS (SELECT *, round(((evidence_rate >= 1)::INT * 2 + (answerable_rate >= 1)::INT + 2 + (untimed_rate >= 1)::INT + (concise_rate >= 0.85)::INT + (o >= 1)::INT + (duplicate_rate <= 0)::INT) / 9.0::DOUBLE, 3) AS score FROM g)
SELECT deck_id, cards, duplicate_rate, evidence_rate, answerable_rate, concise_rate, untimed_rate, score, CASE WHEN score >= 1 THEN 'pass' ELSE 'review' END AS verdict FROM h""",
    "draft_cases": f"""WITH RECURSIVE {LINES}, n AS (SELECT doc_id, count(*) AS n FROM seg GROUP BY 1),
c AS (SELECT conv_id % 20 AS draft_id, conv_id * 100 + turn AS ord, {CLEAN.format(c="text")} AS query, ['fact', 'compare', 'summary', 'negative', 'odd'][(conv_id + turn) % 5 + 1] AS ty, turn % 4 <> 3 AS facts, (turn < coalesce(n, 0))::INT + (turn + 40 < coalesce(n, 0))::INT AS ev FROM conversations LEFT JOIN n ON doc_id = conv_id * 2),
o AS (SELECT *, query <> '' AND ty <> 'odd' AND ev > 0 AND facts AS ok FROM c), t AS (SELECT *, min(CASE WHEN ok THEN ord END) OVER (PARTITION BY draft_id, lower(query)) AS tk FROM o),
r AS (SELECT *, CASE WHEN query = '' OR ord > tk THEN 'blank_or_duplicate' WHEN ty = 'odd' THEN 'invalid_type' WHEN NOT ok THEN 'no_evidence_or_facts' ELSE 'valid' END AS outcome FROM t)
SELECT draft_id, ord, query, outcome, ev::BIGINT AS n_evidence, outcome = 'valid' AND row_number() OVER (PARTITION BY draft_id, ty, outcome ORDER BY ord) > 1 AS repeated_type FROM r""",
    "answer_payloads": f"""WITH {QRY}, p AS (SELECT query_id, array_to_string(terms, ' ') AS query, query_id % 7 <> 0 AS said, CASE WHEN query_id % 6 = 0 THEN '' ELSE array_to_string(terms, ' ') || ' [2]' END AS t, query_id % 9 = 0 AS cf,
  CASE WHEN query_id % 4 = 0 THEN [] WHEN query_id % 5 IN (1, 3) THEN [query_id % 5, 2] ELSE [2] END AS ids FROM q), a AS (SELECT *, said AND len(ids) > 0 AND t <> '' AS ok FROM p)
SELECT query_id, CASE WHEN ok THEN 'answered' ELSE 'insufficient_evidence' END AS status, CASE WHEN ok AND NOT cf THEN 'high' ELSE 'low' END AS confidence,
CASE WHEN ok THEN t || CASE WHEN len(ids) = 2 THEN ' [' || ids[1] || ']' ELSE '' END WHEN t = '' THEN 'Insufficient transcript evidence to answer confidently from the retrieved excerpts.' ELSE t END AS answer, array_to_string(ids, ',') AS citation_ids, (cf::INT + (said AND len(ids) = 0)::INT)::INT AS n_warnings FROM a""",
}
