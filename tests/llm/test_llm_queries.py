"""The registered queries: SQL beside them where there is some, the contract's columns, and the pipeline from end to end."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tesselith.llm import classifier, jaccard, mixing, packing, quality_rules
from tesselith.llm.queries import ORACLES, QUERIES, tokenizer_path
from tesselith.sources.tables import table

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "benchmark")
COLUMNS = {
    "op1_mixing": "doc_id bigint, source string, size bigint, block bigint, release_slot bigint, deadline_slot bigint, slot bigint, block_offset bigint",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_lm_scoring": "doc_id bigint, n_words bigint, log_prob double, mean_log_prob double",
    "op11_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op12_centroid_clusters": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_sql(spark, name):
    got = QUERIES[name](spark, SF)
    types = dict(got.dtypes)
    for column in COLUMNS[name].split(", "):
        c, t = column.split()
        assert types[c] == t
    rows = [tuple(r) for r in got.collect()]
    first = {"op4_embedding_dedup": "embeddings", "op12_centroid_clusters": "embeddings", "op5_warc": "pages"}.get(name, "documents")
    if name not in ("op8_packing", "op13_lexical_search"):
        assert len(rows) == table(spark, SF, first).count()
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        at = [got.columns.index(c) for c in names]
        plain = lambda r: tuple("" if x is None else str(x) for x in r)
        assert sorted(plain(r[i] for i in at) for r in rows) == sorted(plain(r) for r in want.fetchall())


def test_sharding_laws(spark):
    """Bytes per shard nearly equal, slots gapless: recomputed from the table."""
    rows = QUERIES["op2_sharding"](spark, "/root/testdata/sf0.01").collect()
    loads, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(loads) == set(range(24)) and max(loads.values()) <= 1.1 * min(loads.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline(spark):
    """Every stage against its operator's rows, all columns handed on, the mix's order kept in the packing, and each kept document packed once."""
    docs, kept = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        kept.append((before, {r.doc_id for r in docs.select("doc_id").collect()}))
    rated = {r.doc_id for r in quality_rules.rated(kept[0][0]).where("kept").collect()}
    assert kept[0][1] == rated
    scores = {r.doc_id: r.predicted for r in classifier.scored(kept[1][0], table(spark, SF, "labels")).collect()}
    assert sum((scores[i] == 1) != (i in kept[1][1]) for i in scores) <= 2
    components = jaccard.jaccard_components(kept[2][0], 5, 80).collect()
    assert kept[2][1] == {r.doc_id for r in components if r.doc_id == r.component_id}
    assert kept[3][1] == kept[2][1]
    packed = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    encode = packing.encoder(tokenizer_path("byte_bpe_50k.json"), special_strings=True)
    ids = {r.doc_id: np.r_[encode([r.text or ""])[0], 0] for r in docs.collect()}
    place = {r.doc_id: (r.slot, r.block_offset) for r in mixing.scheduled(kept[3][0]).collect()}
    order = {d: i for i, d in enumerate(sorted(place, key=place.get))}
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids[d]) == own[0].doc_tokens
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[d][r.start : r.start + r.length].astype("<u4").tobytes())
    x, y = np.array([[r.sequence_id, order[r.doc_id]] for r in packed], float).T
    rank = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable")
    assert np.corrcoef(rank(x), rank(y))[0, 1] > 0.9


def test_pipeline_on_odd_rows(spark):
    """Nulls in any column, empty and repeated rows, and no rows at all."""
    schema = table(spark, SF, "documents").schema
    some = [tuple(r) for r in table(spark, SF, "documents").limit(40).collect()]
    odd = [(None, "a b c " * 30, None, None, None), (10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0), some[0], some[0]]
    for rows in (some + odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, SF), f"odd-{name}")
        packed = corpus_pipeline.packing_stage(spark, docs, SF).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
