"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.llm import centroids, classifier, jaccard, mixing, packing, pseudo_lm, quality_rules, secrets, sharding, tiered, tokencount, vecdedup, warc
from tesselith.sources.tables import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scheduled(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.sharded(table(spark, sf_dir, "documents"), 24)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), 4096)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rated(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.lm_scores(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.found(table(spark, sf_dir, "documents")))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"), 40, 5, "2")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_sharding, op3_token_counts, op4_embedding_dedup, op5_warc, op6_quality_rules, op7_jaccard_join, op8_packing, op9_quality_classifier, op10_lm_scoring,
        op11_secret_scan, op12_centroid_clusters, op13_lexical_search,
    )
}
#: Smallest id reachable over links (a, b), both ways, for every id of a table.
_REACH = "reach AS (SELECT a AS id, b AS o FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.o)"

#: Terms of ranked search.
_TERMS = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: The nearest centroid of each vector by centroids c<i>, as distance * 64 + number, and the next centroids.
_NEAREST = lambda i: f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + c) AS m FROM v, c{i} GROUP BY vec_id)"
_MEANS = lambda i: f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(z, y) AS y FROM c{i} LEFT JOIN
  (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS z FROM (SELECT m % 64 AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY c) USING (c))"""  # noqa: E731

ORACLES: dict[str, str] = {
    "op1_mixing": f"""WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s, greatest(1, strlen(coalesce(text, ''))) AS size, md5(doc_id::VARCHAR) AS h FROM documents),
b AS (SELECT s, greatest(1, round(sqrt(sum(size)::DOUBLE) * 1000)::BIGINT) AS w FROM d GROUP BY 1),
w AS (SELECT s, ({mixing.PERIOD} - count(*) OVER ()) * w AS share, sum(w) OVER ()::BIGINT AS total FROM b),
r AS (SELECT s, 1 + share // total AS base, row_number() OVER (ORDER BY share % total DESC, s) AS place FROM w),
q AS (SELECT s, (base + (place <= {mixing.PERIOD} - sum(base) OVER ())::INT)::BIGINT AS q FROM r),
l AS (SELECT list(q ORDER BY s) AS qs, list(s ORDER BY s) AS ss FROM q),
f AS (SELECT -1 AS t, list_transform(qs, lambda z: 0::BIGINT) AS c, 0::BIGINT AS pick FROM l UNION ALL
  SELECT t + 1, list_transform(range(len(c)), lambda i: c[i + 1] + (i = p)::INT), p FROM (
    SELECT t, c, list_min(list_filter(list_transform(range(len(c)), lambda i: CASE WHEN c[i + 1] < qs[i + 1] AND c[i + 1] * {mixing.PERIOD} // qs[i + 1] <= t + 1 THEN (((c[i + 1] + 1) * {mixing.PERIOD} + qs[i + 1] - 1) // qs[i + 1]) * len(c) + i END), lambda z: z IS NOT NULL)) % len(c) AS p
    FROM f, l WHERE t < {mixing.PERIOD} - 1)),
pt AS (SELECT ss[pick + 1] AS s, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM f, l WHERE t >= 0),
c AS (SELECT *, (sum(size) OVER (PARTITION BY s ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS cum FROM d),
e AS (SELECT c.*, cum // {mixing.BLOCK_BYTES} AS block, q.q FROM c JOIN q USING (s))
SELECT doc_id, source, size, block, block // q * {mixing.PERIOD} + (block % q) * {mixing.PERIOD} // q AS release_slot, block // q * {mixing.PERIOD} + ((block % q + 1) * {mixing.PERIOD} + q - 1) // q AS deadline_slot,
  block // q * {mixing.PERIOD} + slot AS slot, cum % {mixing.BLOCK_BYTES} AS block_offset FROM e JOIN pt ON pt.s = e.s AND pt.k = block % q""",
    "op4_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.95), {_REACH},
n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1), c AS (SELECT id, min(o) AS c FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(c, vec_id), vec_id) AS component_id, coalesce(least(c, vec_id), vec_id) = vec_id AS kept FROM v LEFT JOIN n ON n.id = vec_id LEFT JOIN c ON c.id = vec_id""",
    "op5_warc": r"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS g, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 2147483648), '%Y-%m-%dT%H:%M:%SZ') AS ts,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host, rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY g) AS top, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || lower(CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END) AS url_key FROM p)
SELECT page_id, b AS payload_bytes, g AS payload_digest, CASE WHEN b >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN b >= 1000 AND page_id < top THEN top END AS refers_to,
  url_key, ts, row_number() OVER (ORDER BY url_key, ts, page_id) - 1 AS capture_rank FROM m""",
    "op7_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), j AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM j WHERE 100 * c >= 90 * (na + nb - c)), {_REACH}, c AS (SELECT id, min(o) AS c FROM reach GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, coalesce(least(c, doc_id), doc_id) AS component_id FROM s LEFT JOIN c ON c.id = doc_id""",
    "op12_centroid_clusters": f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x AS y FROM v QUALIFY c < 40),
{", ".join(f"{_NEAREST(i)}, {_MEANS(i)}" for i in range(5))}, {_NEAREST(5)}
SELECT vec_id, (m % 64)::INT AS cluster, m // 64 AS distance, sum(m // 64) OVER (PARTITION BY m % 64)::BIGINT AS cluster_inertia, sum(m // 64) OVER ()::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
  FROM a5 JOIN c5 ON c = m % 64""",
    "op13_lexical_search": f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS("text")} AS t FROM documents),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY r, term),
s AS (SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
f AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, nn),
q AS (SELECT item_id, row_number() OVER () AS i, {_TERMS("text")} AS t FROM benchmark), qt AS (SELECT item_id, i, unnest(t) AS term FROM q),
x AS (SELECT i, r, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM qt JOIN f USING (term) JOIN p USING (term), s GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 20""",
}
