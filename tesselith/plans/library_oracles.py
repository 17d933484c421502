"""DuckDB SQL for the rows of the queries in plans.library_queries, written apart from the operators."""

from __future__ import annotations

from tesselith.functions import vocab as V
from tesselith.plans.oracles import CAND, CLEAN, DENSE, GOLD, LEX, LINES, RRF, TIME, _words, both, lexical, scores

EVEN = "CASE WHEN n <= {k} THEN range(n) ELSE list_distinct(list_transform(range({k}), lambda i: round_even(i * (n - 1) / {k1}.0::DOUBLE, 0)::BIGINT)) END"
MS = "printf('%d:%02d', ({s}) // 60, ({s}) % 60)"
CLOCK = "CASE WHEN {s} >= 3600 THEN printf('%d:%02d:%02d', {s} // 3600, ({s} % 3600) // 60, {s} % 60) ELSE printf('%d:%02d', {s} // 60, {s} % 60) END"
T = CLEAN.format(c="text")
CLIP = "CASE WHEN length({t}) <= {k} THEN {t} ELSE regexp_replace(substr({t}, 1, {k}), '\\s\\S*$', '') || '...' END"
SUM = f"sm AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_ds, end_ds, ord) AS n, count(*) OVER (PARTITION BY doc_id) AS m FROM (SELECT doc_id, ord, {T} AS t, start_ds, greatest(start_ds, end_ds) AS end_ds FROM seg) WHERE t <> '')"
ENDS = "len(list_filter(string_split(regexp_replace({t}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z) <> ''))"
ITEMS = """nrm AS (SELECT doc_id, ord, CASE WHEN rank > 0 THEN rank END AS rank, {title} AS title, {tldr} AS tldr, language, low, high,
  greatest(low, least(coalesce(start_ds, low), high)) AS s, end_ds FROM items JOIN spans USING (doc_id)),
n1 AS (SELECT *, greatest(s, least(end_ds, greatest(low, high))) AS e, row_number() OVER (PARTITION BY doc_id, lower(title), lower(tldr) ORDER BY rank IS NULL, coalesce(rank, 0), ord) AS copy FROM nrm WHERE tldr <> ''),
n2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank IS NULL, coalesce(rank, 0), ord) AS point FROM n1 WHERE copy = 1),
pts AS (SELECT doc_id, point, CASE WHEN title <> '' THEN title WHEN language = 'en' THEN CASE WHEN point = 1 THEN 'Intro' ELSE 'Topic ' || (point - 1) END ELSE CASE WHEN point = 1 THEN '導入' ELSE 'トピック' || (point - 1) END END AS title, tldr, s AS start_ds, e AS end_ds FROM n2 WHERE point <= 5)""".format(title=CLEAN.format(c="title"), tldr=CLEAN.format(c="tldr"))
SENT = """snt AS (SELECT {id}, t, list_filter(list_transform(regexp_split_to_array(t, '[。.!?！？]\\s*|\\n+'), lambda z: regexp_replace(regexp_replace(z, '^[ 、,]+', ''), '[ 、,]+$', '')),
  lambda z: z <> '' AND NOT list_contains(['はい', 'うん', 'ええ', 'ああ', 'そう', 'そうですね', 'えっと', 'あの', 'わあ', 'へえ', 'ほう'], regexp_replace(z, '[、,\\s]+', '', 'g')) AND length(regexp_replace(z, '[、,\\s]+', '', 'g')) >= 12) AS g FROM ({src})),
sns AS (SELECT {id}, t, CASE WHEN t = '' THEN [] WHEN len(g) > 0 THEN g ELSE [coalesce(nullif(trim(regexp_replace(substr(t, 1, 260), ' [^ ]*$', '')), ''), trim(substr(t, 1, 260)))] END AS g FROM snt)"""
EVID = f"""ev0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, ord, start_ds, end_ds, {T} AS text FROM seg) WHERE text <> ''),
evd AS (SELECT doc_id, 'segment_' || (ord + 1) AS evidence_id, ord, start_ds, end_ds, {CLOCK.format(s="(start_ds // 10)")} AS timestamp, text FROM ev0 WHERE list_contains({EVEN.format(k=8, k1=7)}, p))"""
CARDS = f"""{LINES}, {EVID}, ep AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS place FROM evd),
{SENT.format(id="doc_id, evidence_id, place, timestamp", src=f"SELECT doc_id, evidence_id, place, timestamp, {T} AS t FROM ep WHERE place < 6")},
crd AS MATERIALIZED (SELECT doc_id, place + 1 AS card, ['recall', 'concept', 'detail', 'application'][place % 4 + 1] AS card_type, evidence_id,
  ['What is said at ', 'Which idea comes up at ', 'Which detail is given at ', 'How would you explain what is said at '][place % 4 + 1] || timestamp || '?' AS question, {CLIP.format(t=CLEAN.format(c="g[1]"), k=150)} AS answer, {CLIP.format(t="t", k=180)} AS source_cue FROM sns)"""
REC = f"""i AS (SELECT doc_id AS i FROM labels),
r0 AS (SELECT i, CASE WHEN i % 4 > 0 THEN 'r' || i END AS rid, [' What  is it ', NULL, ''][i % 3 + 1] AS q, [NULL, 'src1'][i % 2 + 1] AS src, ['Relevant', NULL, 'odd', 'not_relevant', 'unclear'][i % 5 + 1] AS lab, [NULL, 'relevant', NULL, 'UNCLEAR'][i % 4 + 1] AS fin, ['High', 'sure', NULL][i % 3 + 1] AS cf, ['q', NULL][i % 2 + 1] AS rq FROM i),
r1 AS (SELECT coalesce(rid, 's' || i) AS review_item_id, coalesce(nullif(trim(regexp_replace(q, '\\s+', ' ', 'g')), ''), rq) AS query, coalesce(src, 'src2') AS source,
  CASE WHEN lower(coalesce(lab, fin)) IN ('relevant', 'not_relevant', 'unclear') THEN lower(coalesce(lab, fin)) END AS recommended_label, lower(fin) AS final_label, CASE WHEN lower(cf) IN ('low', 'medium', 'high') THEN lower(cf) ELSE 'low' END AS confidence, i % 2 = 0 AS approved FROM r0),
rec AS (SELECT * FROM r1 WHERE recommended_label IS NOT NULL AND query IS NOT NULL)"""
KANA = """lower({clean}) AS low""".format(clean=CLEAN.format(c="CASE WHEN {i} % 2 = 0 THEN translate(text, 'aeiou', 'あえいおう') ELSE text END"))
MIXED = """CASE WHEN regexp_matches(low, '[{jp}]') THEN list_concat(CASE WHEN replace(low, ' ', '') = '' THEN [] ELSE list_transform(range(1, greatest(length(replace(low, ' ', '')), 2)), lambda i: substr(replace(low, ' ', ''), i, 2)) END,
  list_filter(string_split(low, ' '), lambda z: z <> '')) ELSE regexp_extract_all(low, '[a-z0-9_]+') END""".format(jp=V.JAPANESE)
END = "[.!?。！？]\\s*$"
VER = "[NULL, 'v1', 'v2'][doc_id % 3 + 1]"
BASE_ABL = f"{LEX}, {DENSE}, {both()}, {RRF}, {GOLD}, l10 AS (SELECT * FROM lex WHERE rank <= 10), r10 AS (SELECT * FROM rrf WHERE rank <= 10), {scores('l10', 'sl')}, {scores('r10', 'sr')}"

ORACLES = {
    "summary_prompt_lines": f"WITH {LINES}, {SUM} SELECT doc_id, n, printf('[%04d] ', n) || {MS.format(s='start_ds // 10')} || '-' || {MS.format(s='end_ds // 10')} || ' ' || t AS line FROM sm",
    "summary_compact_lines": f"""WITH {LINES}, {SUM}, b AS (SELECT *, greatest(42, least(180, floor(4000.0::DOUBLE / m)::BIGINT - 20)) AS k FROM sm)
SELECT doc_id, n, printf('[%04d] ', n) || {MS.format(s='start_ds // 10')} || ' ' || CASE WHEN length(t) <= k THEN t ELSE rtrim(substr(t, 1, k - 1)) || '…' END AS line FROM b""",
    "sentence_counts": f"WITH t AS (SELECT doc_id, {CLEAN.format(c='text')} AS t, lang FROM documents) SELECT doc_id, CASE WHEN lang = 'ja' THEN len(list_filter(regexp_split_to_array(t, '[。！？]+'), lambda z: trim(z) <> '')) ELSE {ENDS.format(t='t')} END AS sentences FROM t",
    "sentence_ranges": f"WITH {LINES}, t AS (SELECT doc_id, {T} AS t FROM seg) SELECT doc_id, count(*) AS items, bool_and({ENDS.format(t='t')} BETWEEN 1 AND 5) AS in_range FROM t GROUP BY 1",
    "items_language": f"""WITH {LINES}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(text, '[{V.JAPANESE}]')) AS ja, bool_and(regexp_matches(text, '[A-Za-z]')) AS la FROM seg GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ja >= greatest(1, floor(n * 0.7::DOUBLE)) ELSE ja = 0 AND la END AS fits FROM c""",
    "summary_items": f"""WITH {LINES}, spans AS (SELECT doc_id, min(start_ds) + 5 AS low, max(end_ds) - 5 AS high FROM seg GROUP BY 1),
items AS (SELECT doc_id, ord, CASE WHEN doc_id % 3 = 0 THEN ord % 4 END AS rank, CASE WHEN ord % 4 = 0 THEN '' ELSE 'Point  ' || (ord % 3) END AS title,
  CASE WHEN ord % 2 = 1 THEN CASE WHEN ord % 4 = 1 THEN 'item ' ELSE 'Item ' END || (ord % 7) ELSE text END AS tldr, start_ds - 50 AS start_ds, end_ds + 50 AS end_ds, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'ja' END AS language FROM seg), {ITEMS}
SELECT * FROM pts""",
    "summary_map_reduce": f"""WITH RECURSIVE {LINES}, f AS (SELECT doc_id, ord, 0::BIGINT AS w, (length(text) + 48)::BIGINT AS used FROM seg WHERE ord = 0
  UNION ALL SELECT seg.doc_id, seg.ord, CASE WHEN f.used + length(text) + 48 > 2000 THEN w + 1 ELSE w END, CASE WHEN f.used + length(text) + 48 > 2000 THEN 0 ELSE f.used END + length(text) + 48 FROM f JOIN seg ON seg.doc_id = f.doc_id AND seg.ord = f.ord + 1),
wn AS (SELECT doc_id, w, ord, row_number() OVER (PARTITION BY doc_id, w ORDER BY ord) AS place FROM f), spans AS (SELECT doc_id, min(start_ds) AS low, max(end_ds) AS high FROM seg GROUP BY 1),
items AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, w) AS ord, NULL::INT AS rank, '' AS title, text AS tldr, start_ds, end_ds, 'en' AS language FROM wn JOIN seg USING (doc_id, ord) WHERE place <= 3), {ITEMS},
k AS (SELECT doc_id, count(DISTINCT w) AS windows FROM wn GROUP BY 1)
SELECT pts.*, windows, CASE WHEN windows > 1 THEN 'map_reduce' ELSE 'single_pass' END AS strategy FROM pts JOIN k USING (doc_id)""",
    "study_tokens": "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''_-]{2,}|[ぁ-んァ-ヴー一-龥]{2,12}|[一-龥]'), lambda z: lower(z)), ' ') AS tokens FROM documents",
    "study_sentences": f"WITH {SENT.format(id='doc_id', src='SELECT doc_id, ' + T + ' AS t FROM documents')} SELECT doc_id, array_to_string(g, '|') AS sentences FROM sns",
    "study_evidence": f"WITH {LINES}, {EVID} SELECT * FROM evd",
    "focused_evidence": f"""WITH {LINES}, c AS (SELECT doc_id, ord % 3 AS section, ord, {T} AS t FROM seg), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) - 1 AS point FROM c WHERE t <> ''),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY point, section) - 1 AS a0, count(*) OVER (PARTITION BY doc_id) AS n FROM p), x AS (SELECT *, unnest(range(a0, 8, n)) AS place FROM a WHERE a0 < 8)
SELECT doc_id, place, 'section_' || (section + 1) || '_point_' || (point + 1) || CASE WHEN place // n = 0 THEN '' ELSE '_review_' || (place // n + 1) END AS evidence_id, section, {CLEAN.format(c="'Section ' || (section + 1) || ': ' || t")} AS text FROM x""",
    "topic_sources": f"""WITH {LINES}, e AS (SELECT doc_id, max(end_ds) AS e FROM seg GROUP BY 1), t AS (SELECT doc_id, 0::BIGINT AS topic, 0 AS a, floor(e / 3.0::DOUBLE)::BIGINT AS b FROM e UNION ALL SELECT doc_id, 1, floor(e / 2.0::DOUBLE)::BIGINT, floor(e / 2.0::DOUBLE)::BIGINT + 200 FROM e),
m AS (SELECT doc_id, topic, ord, start_ds, {T} AS text, row_number() OVER (PARTITION BY doc_id, topic ORDER BY ord) - 1 AS p, count(*) OVER (PARTITION BY doc_id, topic) AS n FROM seg JOIN t USING (doc_id) WHERE end_ds >= a AND start_ds <= b AND {T} <> '')
SELECT doc_id, topic, ord, start_ds, {CLOCK.format(s="(start_ds // 10)")} AS timestamp, {CLIP.format(t="text", k=900)} AS text FROM m WHERE list_contains({EVEN.format(k=5, k1=4)}, p)""",
    "study_cards": f"WITH {CARDS} SELECT * FROM crd",
    "study_cards_normalised": f"""WITH {CARDS}, z AS (SELECT doc_id, count(*) AS local, count(*) FILTER ((doc_id % 4 <> 0 OR card = 1) AND card <= 5) AS given FROM crd GROUP BY 1), w AS (SELECT *, given < greatest(1, least(5, local)) AS few FROM z)
SELECT doc_id, card, CASE WHEN few THEN c.card_type WHEN card % 2 = 0 THEN c.card_type ELSE 'detail' END AS card_type, CASE WHEN few OR card % 3 = 0 THEN c.question ELSE 'Why?' END AS question, CASE WHEN few OR card % 2 = 1 THEN c.answer ELSE 'Because' END AS answer, c.evidence_id, c.source_cue FROM crd c JOIN w USING (doc_id) WHERE card <= 5""",
    "section_types": f"""WITH {LINES}, sz AS (SELECT doc_id, count(*) AS n FROM seg GROUP BY 1), g AS (SELECT doc_id, n, least(5, n) AS k, unnest(range(least(5, n))) AS section FROM sz),
b AS (SELECT doc_id, section, string_agg(trim(text), ' ' ORDER BY ord) AS text FROM g JOIN seg USING (doc_id) WHERE ord >= round_even(section * n / k::DOUBLE, 0) AND ord < round_even((section + 1) * n / k::DOUBLE, 0) GROUP BY 1, 2),
c AS (SELECT doc_id, section, contains(text, 'The ')::INT + contains(text, 'and the')::INT AS a, contains(text, 'hand')::INT + contains(text, 'of the')::INT + contains(text, 'ing')::INT AS b, contains(text, 'que ')::INT + contains(text, 'ción')::INT AS c FROM b)
SELECT doc_id, section, CASE WHEN greatest(a, b, c) = 0 THEN 'estimated' WHEN a >= b AND a >= c THEN 'intro' WHEN b >= c THEN 'background' ELSE 'closing' END AS section_type, CASE WHEN greatest(a, b, c) = 0 THEN 'estimated_keywords' ELSE 'matched_markers' END AS confidence FROM c""",
    "library_list": f"""WITH {LINES}, n AS (SELECT doc_id, count(*) AS n FROM seg GROUP BY 1), h AS (SELECT user_id AS doc_id, count(*) AS c, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS l FROM events GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN 'Document ' ELSE 'Video ' END || doc_id AS title, coalesce(lang, 'ja') AS language, coalesce(n, 0) AS num_chunks, coalesce({VER}, 'unknown') AS chunking_version, coalesce({VER}, 'unknown') <> 'v2' AS chunking_stale, coalesce(c, 0) AS ask_history_count, l AS last_ask_at
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)""",
    "ingest_actions": f"""WITH t AS (SELECT DISTINCT user_id AS doc_id FROM events), s AS (SELECT doc_id, coalesce({VER}, 'unknown') AS v FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, CASE WHEN v IS NULL THEN 'created' WHEN v <> 'v2' THEN 'reingest_stale' ELSE 'already_indexed' END AS action FROM t LEFT JOIN s USING (doc_id)""",
    "caption_tracks": """WITH t AS (SELECT conv_id AS doc_id, turn AS ord, ['fr', 'ja-JP', 'en-GB', 'de', 'en'][(conv_id + turn * 2) % 5 + 1] AS code FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE code WHEN 'ja' THEN 0 WHEN 'en' THEN 1 ELSE CASE WHEN starts_with(code, 'ja') THEN 10 WHEN starts_with(code, 'en') THEN 11 ELSE 20 END END, ord) AS p FROM t) SELECT doc_id, ord, code FROM r WHERE p = 1""",
    "page_links": """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages), u AS (SELECT page_id, unnest(l) AS link, unnest(range(len(l))) AS a0 FROM l), f AS (SELECT page_id, link, min(a0) AS a0 FROM u GROUP BY 1, 2)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY a0) - 1)::INT AS pos, link FROM f""",
    "json3_urls": r"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '?' || CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?([^#]*)', 1) || '&' ELSE '' END || 'fmt=json3' || regexp_extract(url, '(#.*)$', 1) AS url FROM pages""",
    "frame_plan": "SELECT doc_id, unnest(CASE WHEN n_chars <= 40 THEN [0::BIGINT] ELSE range(0, floor((n_chars - 40) / 10.0)::BIGINT + 1, 60) END) AS second FROM documents",
    "frame_texts": """WITH i AS (SELECT conv_id % 50 AS doc_id, conv_id AS frame, turn, trim(text) AS t, CASE (conv_id + turn) % 5 WHEN 0 THEN 0.5::DOUBLE WHEN 2 THEN 0.75::DOUBLE END AS c FROM conversations WHERE turn % 4 <> 3)
SELECT doc_id, frame, doc_id || ':' || frame || ':ocr' AS id, string_agg(t, chr(10) ORDER BY turn) AS text, round(avg(c), 6) AS confidence FROM i WHERE t <> '' GROUP BY 1, 2""",
    "dominant_languages": "SELECT source, language, n FROM (SELECT source, coalesce(lang, 'ja') AS language, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, coalesce(lang, 'ja')) AS p FROM documents GROUP BY 1, 2) WHERE p = 1",
    "result_languages": f"WITH {LEX}, r AS (SELECT query_id, coalesce(lang, 'ja') AS language, count(*) AS n, min(rank) AS f FROM lex JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY 1, 2) SELECT query_id, language FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS p FROM r) WHERE p = 1",
    "query_texts": f"""SELECT item_id, 'query: ' || {T} || CASE WHEN item_id % 2 = 0 THEN chr(10) || array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({T}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda z: z <> '' AND NOT list_contains({_words(V.STOP_WORDS)}, z)), ' ') ELSE '' END AS query_text, text AS passage_text FROM benchmark""",
    "run_ids": "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '_' || substr(sha256(event_id::VARCHAR), 1, 8) AS run_id FROM events",
    "finite_values": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id + 0.5::DOUBLE END AS value FROM events",
    "merged_log_page": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM events WHERE event_type = 'click' ORDER BY events.ts DESC, event_id LIMIT 100",
    "prediction_checks": """WITH p AS (SELECT event_id AS ord, CASE WHEN event_id % 11 = 0 THEN '' ELSE user_id::VARCHAR END AS query_id, event_id % 7 AS r, event_id % 5 AS l FROM events), k AS (SELECT DISTINCT user_id::VARCHAR AS query_id, true AS known FROM events WHERE event_type = 'click'),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS copy FROM p)
SELECT ord, query_id, CASE WHEN query_id = '' THEN 'no_query_id' WHEN copy > 1 THEN 'duplicate_prediction' WHEN known IS NULL THEN 'unknown_query' WHEN r = 0 THEN 'ranked_missing' WHEN r = 1 THEN 'ranked_blank' WHEN r = 2 THEN 'ranked_repeats' WHEN l >= 2 THEN 'latency' ELSE 'valid' END AS status FROM c LEFT JOIN k USING (query_id)""",
    "chunk_recall": f"""WITH {LEX}, {GOLD}, r AS (SELECT DISTINCT query_id, doc_id // 10 AS d, doc_id % 10 AS c FROM lex WHERE rank <= 5), g AS (SELECT DISTINCT query_id, doc_id // 10 AS d, doc_id % 10 AS c FROM gold)
SELECT g.query_id, round(count(r.d) / count(*)::DOUBLE, 6) AS recall FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.d = g.d AND r.c = g.c GROUP BY 1""",
    "ablation_report": f"""WITH {BASE_ABL}, b AS (SELECT count(*) AS n, {", ".join(f"avg(a.{m}) AS w_{m}, avg(o.{m}) AS o_{m}" for m in ("r_1", "r_5", "mrr"))} FROM sr a JOIN sl o USING (query_id))
{" UNION ALL ".join(f"SELECT '{m}' AS metric, n AS query_count, round(w_{m}, 6) AS with_channel, round(o_{m}, 6) AS without_channel, round(w_{m} - o_{m}, 6) AS delta FROM b" for m in ("r_1", "r_5", "mrr"))}""",
    "eval_requests": "SELECT item_id AS query_id, text AS query, 'en' AS language, CASE WHEN item_id % 2 = 0 THEN 'ordinary' ELSE 'channel_targeted' END AS categories FROM benchmark",
    "slim_results": f"WITH {LEX} SELECT query_id, rank, doc_id, lexical_score AS score, substr(text, 1, 240) AS text FROM lex JOIN documents USING (doc_id) WHERE rank <= 10",
    "budgeted_chunks": f"""WITH {LINES}, b0 AS (SELECT doc_id, ord, {T} AS t FROM seg), b1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n, (sum(length(t)) OVER (PARTITION BY doc_id))::BIGINT AS total FROM b0 WHERE t <> ''),
b2 AS (SELECT DISTINCT doc_id, n, total, greatest(6, least(n, 1500 // greatest(1, ceil(total / n::DOUBLE)::BIGINT))) AS most FROM b1), b3 AS (SELECT *, unnest(range(2, most + 1)) AS c FROM b2 WHERE total > 1500),
b4 AS (SELECT doc_id, c, unnest(CASE WHEN c >= n THEN range(n) ELSE list_distinct(list_transform(range(c), lambda i: round_even(i * (n - 1) / (c - 1)::DOUBLE, 0)::BIGINT)) END) AS p FROM b3),
b5 AS (SELECT doc_id, c FROM b4 JOIN b1 USING (doc_id, p) GROUP BY 1, 2 HAVING sum(length(t)) <= 1500), b6 AS (SELECT doc_id, max(c) AS c FROM b5 GROUP BY 1)
SELECT doc_id, ord AS chunk_index, t AS text FROM b1 LEFT JOIN b6 USING (doc_id) WHERE total <= 1500 OR (c IS NULL AND p = n // 2) OR (c IS NOT NULL AND EXISTS (SELECT 1 FROM b4 WHERE b4.doc_id = b1.doc_id AND b4.c = b6.c AND b4.p = b1.p))""",
    "fixture_dense": f"""WITH {LEX}, qd AS (SELECT query_id, list_distinct(terms) AS t FROM q), dd AS (SELECT doc_id, list_distinct(tokens) AS t FROM tok), qe AS (SELECT query_id, len(t) AS qn, unnest(t) AS w FROM qd), de AS (SELECT doc_id, len(t) AS dn, unnest(t) AS w FROM dd),
n AS (SELECT query_id, doc_id, qn, dn, count(*) AS b FROM qe JOIN de USING (w) GROUP BY ALL), g AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id, 0.3::DOUBLE AS score FROM labels WHERE quality = 1),
s AS (SELECT query_id, doc_id, round(coalesce(score, 0.05::DOUBLE + 0.75::DOUBLE * (b::DOUBLE / (qn + dn - b))), 6) AS score FROM n LEFT JOIN g USING (query_id, doc_id))
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id % 7, doc_id DESC)::INT AS rank FROM s) WHERE rank <= 10""",
    "merged_languages": f"""WITH {LEX}, {DENSE}, u AS (SELECT query_id, doc_id, rank FROM lex WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, rank FROM den WHERE rank <= 10), g AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM u GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM g) WHERE rank <= 10""",
    "context_blocks": f"WITH {LEX} SELECT query_id, string_agg('【Document ' || doc_id || '】(' || {MS.format(s='n_chars')} || '-' || {MS.format(s='(n_chars + 30)')} || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM lex JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1",
    "rerank": f"""WITH {LEX}, r AS (SELECT query_id, doc_id, lexical_score AS base_score, rank AS prior_rank, CASE WHEN rank <= 20 THEN len(list_intersect(list_distinct(terms), string_split_regex(lower(text), '\\s+')))::DOUBLE / greatest(1, len(list_distinct(terms))) END AS m
  FROM lex JOIN q USING (query_id) JOIN documents USING (doc_id) WHERE rank <= 30),
f AS (SELECT *, greatest(0, min(m) OVER w) AS fl, count(*) FILTER (prior_rank > 20) OVER w AS n FROM r WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT query_id, doc_id, base_score, prior_rank, round(coalesce(m, fl * (n - (prior_rank - 21)) / (n + 1)), 6) AS rerank_score FROM f)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, prior_rank)::INT AS rank FROM s""",
    "lexical_multilingual": f"""WITH t0 AS (SELECT doc_id, {KANA.format(i='doc_id')} FROM documents), tokm AS (SELECT doc_id, {MIXED} AS tokens FROM t0), q0 AS (SELECT item_id, {KANA.format(i='item_id')} FROM benchmark), q1 AS (SELECT item_id AS query_id, {MIXED} AS terms FROM q0),
qu AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM q1) GROUP BY 1, 2), {lexical("tokm")} SELECT query_id, doc_id, lexical_score, rank FROM lex WHERE rank <= 10""",
    "review_batch": f"""WITH {LEX}, r AS (SELECT array_to_string(terms, ' ') AS query, source, doc_id, n_chars / 4.0::DOUBLE AS s, greatest(n_chars / 4.0::DOUBLE, n_chars / 5.0::DOUBLE) AS e, rank, lexical_score FROM lex JOIN q USING (query_id) JOIN documents USING (doc_id) WHERE rank <= 10 AND doc_id % 9 > 0 AND source IS NOT NULL),
k AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN source || ':' || doc_id ELSE source || ':' || floor(s * 1000)::BIGINT || ':' || floor(e * 1000)::BIGINT END AS feedback_key FROM r)
SELECT substr(sha1(query), 1, 10) || ':' || feedback_key AS review_item_id, feedback_key, query, {CLOCK.format(s="floor(s)::BIGINT")} AS timestamp_label, rank, lexical_score AS score FROM k""",
    "normalised_recommendations": f"WITH {REC} SELECT * FROM rec",
    "feedback_payloads": f"WITH {REC} SELECT * FROM (SELECT review_item_id, query, source, coalesce(final_label, CASE WHEN approved THEN recommended_label END) AS label FROM rec) WHERE label IN ('relevant', 'not_relevant')",
    "source_histogram": "WITH g AS (SELECT coalesce(CASE WHEN doc_id % 10 > 0 THEN source END, 'unknown') AS label, count(*) AS n FROM documents GROUP BY 1) SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM g",
    "ask_records": """WITH c AS (SELECT *, conv_id + turn AS i FROM conversations)
SELECT conv_id * 100 + turn AS id, conv_id AS doc_id, trim('  ' || text) AS question, '' AS answer, greatest(1, CASE WHEN i % 4 - 1 = 0 THEN 5 ELSE i % 4 - 1 END) AS k, ['lexical', 'hybrid', 'hybrid'][i % 3 + 1] AS retrieval_mode, ['error', 'answered', 'answered'][i % 3 + 1] AS status, ['high', 'low'][i % 2 + 1] AS confidence, '2024-01-01' AS created_at
FROM c WHERE i % 7 > 0 AND i % 5 > 0 AND trim(text) <> ''""",
    "interval_gold_scores": f"""{TIME}, gg AS (SELECT doc_id, max(start_ds) FILTER (ord = 2) AS s2, max(end_ds) FILTER (ord = 2) AS e2, max(start_ds) FILTER (ord = 3) AS s3, max(end_ds) FILTER (ord = 3) AS e3, count(*) AS n FROM seg WHERE ord IN (2, 3) GROUP BY 1),
hx AS (SELECT gg.doc_id, k.r, coalesce(ct.doc_id IS NOT NULL AND greatest(s2, start_ds) < least(e2, end_ds), false) AND s2 IS NOT NULL AS m2, coalesce(ct.doc_id IS NOT NULL AND greatest(s3, start_ds) < least(e3, end_ds), false) AND s3 IS NOT NULL AS m3 FROM gg CROSS JOIN (SELECT unnest(range(1, 6)) AS r) k LEFT JOIN ct ON ct.doc_id = gg.doc_id AND chunk_index + 1 = k.r),
sg AS (SELECT doc_id, 0::BIGINT AS r, false AS u2, false AS u3, 0.0::DOUBLE AS dcg FROM gg UNION ALL
  SELECT sg.doc_id, hx.r, u2 OR m2, u3 OR (m3 AND (NOT m2 OR u2)), dcg + CASE WHEN (m2 AND NOT u2) OR (m3 AND NOT u3 AND (NOT m2 OR u2)) THEN 1 / log2(hx.r + 1) ELSE 0 END FROM sg JOIN hx ON hx.doc_id = sg.doc_id AND hx.r = sg.r + 1)
SELECT doc_id AS query_id, round((u2::INT + u3::INT) / n::DOUBLE, 6) AS recall, round(dcg / CASE WHEN n = 1 THEN 1 ELSE 1 + 1 / log2(3) END, 6) AS ndcg FROM sg JOIN gg USING (doc_id) WHERE r = 5""",
    "chunk_sentence": f"""WITH RECURSIVE {LINES}, l AS (SELECT doc_id, ord, start_ds, end_ds, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM seg),
w AS (SELECT *, (sum(length(t)) OVER o)::BIGINT AS cum, max(CASE WHEN regexp_matches(t, '{END}') THEN ord END) OVER o AS last FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY ord)),
g AS (SELECT doc_id, ord, 0::BIGINT AS first, length(t)::BIGINT AS size, NULL::BIGINT AS cut_from, NULL::BIGINT AS cut_to, cum, last FROM w WHERE ord = 0 UNION ALL
  SELECT doc_id, ord, CASE WHEN c THEN at0 ELSE first END, CASE WHEN c THEN pcum - (CASE WHEN at0 = 0 THEN 0 ELSE acum END) ELSE size END + len, CASE WHEN c THEN first END, CASE WHEN c THEN at0 END, cum, last FROM (
    SELECT x.*, a.cum AS acum FROM (SELECT w.doc_id, w.ord, g.first, g.size, g.cum AS pcum, w.cum, w.last, length(w.t) AS len, g.size > 0 AND g.size + length(w.t) > 1000 AS c, CASE WHEN g.last >= g.first THEN g.last + 1 ELSE w.ord END AS at0 FROM g JOIN w ON w.doc_id = g.doc_id AND w.ord = g.ord + 1) x LEFT JOIN w a ON a.doc_id = x.doc_id AND a.ord = x.at0 - 1)),
b AS (SELECT doc_id, cut_from AS f, cut_to AS e FROM g WHERE cut_to IS NOT NULL UNION ALL SELECT g.doc_id, first, n FROM g JOIN w USING (doc_id, ord) WHERE ord = n - 1),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, e) - 1 AS chunk_index FROM b)
SELECT i.doc_id, chunk_index, min(start_ds) AS start_ds, max(end_ds) AS end_ds, f AS first_ord, count(*) AS n_lines, string_agg(t, ' ' ORDER BY ord) AS raw_text FROM i JOIN l ON l.doc_id = i.doc_id AND ord >= f AND ord < e GROUP BY ALL""",
    "diversity_select": f"""WITH RECURSIVE {CAND}, nr AS (SELECT a.query_id, a.doc_id, list(b.doc_id) AS near FROM cd a JOIN cd b ON a.query_id = b.query_id AND a.source = b.source AND a.doc_id <> b.doc_id
  AND (abs(a.start - b.start) <= 8 OR (len(a.tokens) > 0 AND len(b.tokens) > 0 AND len(list_intersect(a.tokens, b.tokens))::DOUBLE / len(list_distinct(list_concat(a.tokens, b.tokens))) >= 0.85)) GROUP BY 1, 2),
g AS (SELECT query_id, 0 AS r, []::BIGINT[] AS ch, []::BIGINT[] AS pa, []::VARCHAR[] AS ss FROM cd GROUP BY 1 UNION ALL
  SELECT query_id, r, CASE WHEN NOT done AND NOT bad THEN list_append(ch, doc_id) ELSE ch END, CASE WHEN NOT done AND bad THEN list_append(pa, doc_id) ELSE pa END, CASE WHEN NOT done AND NOT bad THEN list_append(ss, source) ELSE ss END FROM (
    SELECT cd.query_id, cd.rank AS r, ch, pa, ss, cd.doc_id, cd.source, len(ch) >= 6 AS done, len(list_filter(ss, lambda z: z = cd.source)) >= 3 OR len(list_intersect(ch, coalesce(near, []))) > 0 AS bad
    FROM g JOIN cd ON cd.query_id = g.query_id AND cd.rank = g.r + 1 LEFT JOIN nr ON nr.query_id = cd.query_id AND nr.doc_id = cd.doc_id)),
f AS (SELECT query_id, list_concat(ch, pa)[1:6] AS x FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC) = 1)
SELECT query_id, u.doc_id, source, u.rank::INT AS rank FROM (SELECT query_id, unnest(x) AS doc_id, unnest(range(1, len(x) + 1)) AS rank FROM f) u JOIN documents USING (doc_id)""",
}
