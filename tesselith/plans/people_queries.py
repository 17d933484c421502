"""Queries about people: episode contexts, names in texts, speakers; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselith.operators import speakers
from tesselith.plans.oracles import LINES
from tesselith.sources import adapters
from tesselith.sources.tables import table

Q = {}


def query(f):
    Q[f.__name__] = f
    return f


def episodes(s, d):
    """Documents as episodes: titles made of the text's first capitalised words, in several forms; the first lines are the intro, which names a role."""
    t = table(s, d, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][a-z]{3,}"), F.lit(0)).alias("c"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("line"))
    t = t.select("doc_id", "line", *[F.coalesce(F.get("c", F.lit(i)), F.lit("Nobody")).alias(f"c{i}") for i in range(4)])
    forms = F.array(
        F.format_string("The %s %s Interview | MIND | %s %s", "c0", "c1", "c2", "c3"), F.format_string("Evening | %s %s and %s %s, Mind The Game", "c0", "c1", "c2", "c3"),
        F.format_string("夜の会 出演：%s %s、%s／ %s %s", "c0", "c1", "c2", "c0", "c1"), F.format_string("Plain title of %s", "c0"),
    )
    return t.select("doc_id", F.get(forms, (F.col("doc_id") % 4).cast("int")).alias("title"), F.concat(F.lit("主人公役の"), "c0", F.lit(" "), "c1", F.lit(" と "), "c2", F.lit("役の"), "c3", F.lit(" "), "line").alias("intro"))


@query
def episode_contexts(s, d):
    e = speakers.episode_context(episodes(s, d))
    claims = F.array_join(F.transform("role_claims", lambda c: F.concat(c["name"], F.lit("="), c["role"])), "|")
    return e.select("doc_id", F.array_join("cast_names", "|").alias("cast_names"), "primary_subject", F.array_join("participants", "|").alias("participants"), claims.alias("role_claims"))


@query
def speaker_attribution(s, d):
    """Lines as sections: a third is followed by a verb of speech, a third speaks of people together."""
    e = speakers.episode_context(episodes(s, d)).select("doc_id", "participants", "primary_subject", "role_claims")
    tail = F.element_at(F.array(F.lit(" explains why"), F.lit(" in a conversation"), F.lit("")), (F.col("ord") % 3 + 1).cast("int"))
    g = adapters.segments(s, d).select("doc_id", "ord", F.concat("text", tail).alias("value"))
    return speakers.attributed(g.join(e, "doc_id")).select("doc_id", "ord", "speaker", "speaker_role", "speaker_confidence")


@query
def name_mentions(s, d):
    """Names made of the benchmark items' first two long capitalised words, in all documents."""
    b = table(s, d, "benchmark").select(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][a-z]{3,}"), F.lit(0)).alias("c")).where("size(c) >= 2")
    names = b.select(F.concat_ws(" ", F.get("c", F.lit(0)), F.get("c", F.lit(1))).alias("name"))
    m = speakers.mentions(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), names)
    return m.withColumnRenamed("id", "doc_id")


QUERIES = dict(Q)

_W = r"[\p{L}\p{N}_]"
_EPISODES = """ep0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{3,}') AS c, split_part(coalesce(text, ''), chr(10), 1) AS line FROM documents),
ep1 AS (SELECT doc_id, line, coalesce(c[1], 'Nobody') AS c0, coalesce(c[2], 'Nobody') AS c1, coalesce(c[3], 'Nobody') AS c2, coalesce(c[4], 'Nobody') AS c3 FROM ep0),
ep2 AS (SELECT doc_id, c0, c1, c2, c3, doc_id % 4 AS f, regexp_extract_all('主人公役の' || c0 || ' ' || c1 || ' と ' || c2 || '役の' || c3 || ' ' || line, '([ぁ-んァ-ヴー一-龥A-Za-z0-9・ー]{2,20})役の([ぁ-んァ-ヴー一-龥A-Za-z・ー﨑]{2,16})', 1) AS ro,
  regexp_extract_all('主人公役の' || c0 || ' ' || c1 || ' と ' || c2 || '役の' || c3 || ' ' || line, '([ぁ-んァ-ヴー一-龥A-Za-z0-9・ー]{2,20})役の([ぁ-んァ-ヴー一-龥A-Za-z・ー﨑]{2,16})', 2) AS na FROM ep1),
ep AS (SELECT *, CASE f WHEN 2 THEN [c0 || ' ' || c1, c2, c0 || ' ' || c1] ELSE [] END AS casts, CASE f WHEN 0 THEN c0 || ' ' || c1 ELSE '' END AS subj,
  CASE f WHEN 0 THEN CASE WHEN c0 = c2 AND c1 = c3 THEN [c0 || ' ' || c1] ELSE [c0 || ' ' || c1, c2 || ' ' || c3] END WHEN 1 THEN CASE WHEN c0 = c2 AND c1 = c3 THEN [c0 || ' ' || c1] ELSE [c0 || ' ' || c1, c2 || ' ' || c3] END
    WHEN 2 THEN [c0 || ' ' || c1, c2] ELSE [] END AS parts FROM ep2)"""
_ALIAS = "[n, CASE WHEN contains(n, ' ') AND length(regexp_extract(n, '[^ ]+$')) >= 4 THEN regexp_extract(n, '[^ ]+$') END]"
_SAID = f"([^\\p{{L}}\\p{{N}}_.!?]([^.!?]{{0,46}}[^\\p{{L}}\\p{{N}}_.!?])?)({speakers.SPEECH})($|[^\\p{{L}}\\p{{N}}_])".replace("'", "''")

ORACLES: dict[str, str] = {
    "episode_contexts": f"""WITH {_EPISODES} SELECT doc_id, array_to_string(casts, '|') AS cast_names, subj AS primary_subject, array_to_string(parts, '|') AS participants,
  array_to_string(list_transform((list_distinct_ordered(list_transform(range(1, len(ro) + 1), lambda i: na[i] || '=' || ro[i])))[1:8], lambda z: z), '|') AS role_claims FROM ep""".replace("list_distinct_ordered(list_transform(range(1, len(ro) + 1), lambda i: na[i] || '=' || ro[i]))", "list_filter(list_transform(range(1, len(ro) + 1), lambda i: CASE WHEN NOT list_contains(list_transform(range(1, i), lambda j: na[j] || '=' || ro[j]), na[i] || '=' || ro[i]) THEN na[i] || '=' || ro[i] END), lambda z: z IS NOT NULL)"),
    "speaker_attribution": f"""WITH {LINES}, {_EPISODES},
v AS (SELECT seg.doc_id, ord, seg.text || [' explains why', ' in a conversation', ''][ord % 3 + 1] AS value, parts, subj, ro, na FROM seg JOIN ep USING (doc_id)),
n AS (SELECT doc_id, ord, n, {_ALIAS} AS al, value FROM (SELECT doc_id, ord, value, unnest(parts) AS n FROM v)),
m AS (SELECT doc_id, ord, count(*) AS k, min(n) AS one FROM n WHERE len(list_filter(al, lambda a: a IS NOT NULL AND regexp_matches(lower(value), '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(lower(a)) || '($|[^\\p{{L}}\\p{{N}}_])'))) > 0 GROUP BY 1, 2),
r AS (SELECT v.doc_id, ord, value, parts, subj, CASE WHEN k = 1 THEN one END AS one, list_filter(list_transform(range(1, len(ro) + 1), lambda i: CASE WHEN na[i] = one THEN ro[i] END), lambda z: z IS NOT NULL)[1] AS claim FROM v LEFT JOIN m USING (doc_id, ord)),
q AS (SELECT *, one IS NOT NULL AND regexp_matches(value, '(?i)(' || regexp_escape(one) || CASE WHEN contains(one, ' ') THEN '|' || regexp_escape(regexp_extract(one, '[^ ]+$')) ELSE '' END || '){_SAID}') AS said FROM r),
z AS (SELECT *, one IS NOT NULL AND NOT said AND len(parts) > 1 AND regexp_matches(value, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({speakers.TOGETHER})($|[^\\p{{L}}\\p{{N}}_])') AS tog FROM q)
SELECT doc_id, ord, CASE WHEN said THEN one WHEN tog THEN 'Multiple speakers' ELSE 'Unknown speaker' END AS speaker,
  CASE WHEN said THEN coalesce(claim, CASE WHEN one = subj THEN 'interview subject' ELSE 'participant' END) WHEN tog THEN array_to_string(parts, ', ') ELSE '' END AS speaker_role,
  CASE WHEN said THEN 'named_in_section' WHEN tog THEN 'episode_context' ELSE 'unattributed' END AS speaker_confidence FROM z""",
    "name_mentions": f"""WITH n AS (SELECT DISTINCT c[1] || ' ' || c[2] AS n FROM (SELECT regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS c FROM benchmark) WHERE len(c) >= 2),
al AS (SELECT DISTINCT n AS name, lower(unnest({_ALIAS})) AS alias FROM n), am AS (SELECT alias, count(*) > 1 AS ambiguous FROM al WHERE alias IS NOT NULL GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_W}+') AS w, regexp_split_to_array(lower(text), '{_W}+') AS g FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS s, unnest(g[1:len(w)]) AS before, unnest(list_concat(w[2:], [NULL])) AS s2, unnest(g[2:len(w) + 1]) AS after FROM d),
p AS (SELECT *, sum(length(before) + length(s)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM u),
x AS (SELECT doc_id, e - length(s) AS "start", e AS "end", s AS alias FROM p UNION ALL SELECT doc_id, e - length(s), e + length(after) + length(s2), s || after || s2 FROM p WHERE s2 IS NOT NULL)
SELECT doc_id, name, min("start") AS "start", "end", bool_and(ambiguous) AS ambiguous FROM x JOIN al USING (alias) JOIN am USING (alias) GROUP BY doc_id, name, "end\"""",
}
