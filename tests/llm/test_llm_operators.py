"""The operators against brute force, on fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesselith.llm import classifier, jaccard, mixing, packing, pseudo_lm, quality_rules, sharding, tokencount, vecdedup, warc
from tesselith.llm.common import connected_components
from tesselith.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot int, bytes string, id int, n_words int, score double, vslot int, kept int"
WORDS = [f"w{i}" for i in range(400)]


def make_docs(n=160, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 120)))
        if i % 11 == 3:
            text = rows[i // 2][1]
        if i % 13 == 5 and rows[i - 1][1]:
            w = rows[i - 1][1].split()
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None]), len(text), 1, "x", 2, 3, 0.5, 4, 5))
    tail = (0, 1, "x", 2, 3, 0.5, 4, 5)
    rows[7] = (7, None, "en", "a", *tail)
    rows[9] = (9, "", "en", "a", *tail)
    rows[12] = (12, " \n\t ", "en", "b", *tail)
    rows[15] = (15, " ".join(r.choice(WORDS) for _ in range(30_000)), "en", "a", *tail)
    rows[20] = (20, "éa ÉA zwei Wörter\nzwei Wörter\n\n|#*", None, None, *tail)
    rows[21] = (21, "one two", "en", "a", *tail)
    rows[22] = (22, "ONE two", "en", "a", *tail)
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def union_find(pairs, ids):
    p = {i: i for i in ids}

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(500, 500)]
    want = union_find(pairs, {x for p in pairs for x in p})
    got = {x.id: x.component for x in connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# mixing


def brute_schedule(quota, period):
    done, out = Counter(), []
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // q), s) for s, q in sorted(quota.items()) if done[s] < q and done[s] * period // q <= t]
        s = min(ready)[1]
        out.append((s, done[s], t))
        done[s] += 1
    return out


def test_pattern_follows_weights(spark):
    sources = spark.createDataFrame([("=a", 70, False), ("=b", 21, False), ("=c", 8, False), ("=d", 1, False)], "source string, weight long, given boolean")
    q = mixing.quotas(sources, 100)
    quota = {r.source: r.quota for r in q.collect()}
    assert sum(quota.values()) == 100 and min(quota.values()) >= 1
    got = sorted((r.slot, r.source, r.k) for r in mixing.pattern(q).collect())
    assert got == sorted((t, s, k) for s, k, t in brute_schedule(quota, 100))
    done = Counter()
    for t, s, _ in got:
        done[s] += 1
        assert all(abs(done[x] - quota[x] * (t + 1) / 100) < 1 for x in quota)


def test_mixing(docs, rows, empty):
    got = mixing.scheduled(docs, period=50, block_bytes=500).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
        assert r.release_slot <= r.slot < r.deadline_slot
    order = {r[0]: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]) for r in rows}
    for own in by_source.values():
        cum = 0
        for r in sorted(own, key=lambda r: order[r.doc_id]):
            assert (r.block, r.block_offset) == (cum // 500, cum % 500)
            cum += r.size
    assert len({(r.slot, r.block_offset) for r in got}) == len(got)
    assert mixing.scheduled(empty).count() == 0
    laid = mixing.mixed(docs, 4, period=50, block_bytes=500)
    assert laid.columns == docs.columns
    place = {r.doc_id: (r.slot, r.block_offset) for r in got}
    assert [r.doc_id for r in laid.collect()] == sorted(place, key=place.get)
    assert mixing.mixed(empty).count() == 0


def test_mixing_weights(spark, docs):
    w = spark.createDataFrame([("a", 1), (None, 98), ("b", 1), ("unknown", 5)], "source string, weight long")
    got = mixing.scheduled(docs, weights=w, period=100, block_bytes=500).collect()
    first = sorted(got, key=lambda r: (r.slot, r.block_offset))[:3]
    assert {r.source for r in first} == {None}


def test_mixing_takes_weights_exactly(spark):
    """Given weights are the quotas in lowest terms, over many periods; sources they lack get a share in proportion; bad ones raise."""
    rows = [(i, "x" * 100, "abc"[i % 3]) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = spark.createDataFrame([("a", 700), ("b", 200), ("c", 100)], "source string, weight long")
    got = mixing.scheduled(d, weights=w, block_bytes=100).collect()
    share = {"a": 0.7, "b": 0.2, "c": 0.1}
    done = Counter()
    for at, r in enumerate(sorted(got, key=lambda r: r.slot)[:1400]):
        assert r.slot == at
        done[r.source] += 1
        assert all(abs(done[s] - share[s] * (at + 1)) < 1 for s in share)
    some = mixing.scheduled(d, weights=w.where("source <> 'c'"), block_bytes=100).collect()
    first = Counter(r.source for r in sorted(some, key=lambda r: r.slot)[:900])
    assert abs(first["a"] / first["b"] - 3.5) < 0.1 and abs(first["c"] - 300) < 5
    for bad in (0, -3):
        with pytest.raises(Exception, match="not a positive weight"):
            mixing.scheduled(d, weights=spark.createDataFrame([("a", bad)], "source string, weight long")).collect()


def test_mixing_many_sources_and_repeats(spark):
    rows = [(i, "x" * (i % 50 + 1), f"s{i % 1300}") for i in range(2600)] + [(3, "xxxx", "s3"), (None, "a", "s3"), (None, "b", "s3"), (None, "a", "s3")]
    got = mixing.scheduled(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_bytes=30).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((i or -1, len(t)) for i, t, _ in rows)
    assert all(r.release_slot <= r.slot < r.deadline_slot for r in got)
    assert len({(r.slot, r.block_offset) for r in got}) == len(got)


# sharding


def test_sharding(spark, docs, rows, empty):
    got = sharding.sharded(docs, 5, 64).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text = {r[0]: r[1] or "" for r in rows}
    by_shard = defaultdict(list)
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        by_shard[r.shard].append(r)
    assert set(by_shard) == set(range(5))
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    vslot_shard = defaultdict(set)
    for r in got:
        vslot_shard[r.vslot].add(r.shard)
    assert all(len(s) == 1 for s in vslot_shard.values())
    assert sharding.sharded(empty, 5, 64).count() == 0


def test_sharding_balance_hot_group_and_edit(spark):
    rows = [(i, "same text " * 20) for i in range(3000)] + [(5000 + i, f"text number {i} " * (i % 9 + 1)) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.sharded(d, 6, 512)
    sizes = [r.b for r in got.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert max(sizes) < 1.03 * min(sizes)
    sized = sharding.slot_sizes(sharding.with_slots(sharding.sized(d), 512))
    one = sharding.first_map(sized, 6)
    store = sharding.SlotMapStore(spark, sharding.scratch_path(spark, "test-map"))
    one = store.save(one, 1)
    more = store.save(sharding.edited_map(one, sized, 7), 2)
    a, b = ({r.vslot: r for r in m.collect()} for m in (one, store.load(2)))
    assert set(a) == set(b) and {r.version for r in b.values()} == {2}
    moved = [k for k in a if a[k].shard != b[k].shard]
    assert len(moved) < 0.25 * len(a)
    load = Counter()
    for r in b.values():
        load[r.shard] += r.bytes
    assert len(load) == 7 and max(load.values()) < 1.06 * sum(load.values()) / 7
    fewer = {r.vslot: r.shard for r in sharding.edited_map(more, sized, 5).collect()}
    assert set(fewer) == set(a) and set(fewer.values()) == set(range(5))


# token counts


def test_token_counts(docs, rows, empty):
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in tokencount.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"), 100, batch_bytes=5000, piece_bytes=300).collect()}
    for r in rows:
        t = r[1] or ""
        n = len(sp.encode(t))
        assert (got[r[0]].n_bytes, got[r[0]].n_tokens, got[r[0]].over_limit) == (len(t.encode()), n, n > 100)
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), 100).collect()}
    assert got == {r[0]: len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    assert tokencount.count_tokens(empty, tokenizer_path("piece_bpe_32k.model"), 1).count() == 0


def test_cuts_are_safe():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    r = random.Random(2)
    for _ in range(400):
        t = "".join(r.choice(" \n\tab1é▁s<|.") for _ in range(60))
        assert sum(len(sp.encode(p)) for p in tokencount.cut(t, 7)) == len(sp.encode(t))
    parts = tokencount.cut("éé " * 10_000, 1000)
    assert len(parts) > 1 and max(tokencount.utf8(p) for p in parts) < 1100


# vectors


def brute_vectors(rows, threshold):
    ok = {i: np.array(v, np.float64) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= threshold]
    n = Counter(x for p in links for x in p)
    c = union_find(links, [i for i, _ in rows])
    return {i: (n[i], c[i], c[i] == i) for i, _ in rows}


def test_vectors(spark):
    g = np.random.default_rng(4)
    rows = []
    for c in range(40):
        base = g.normal(size=16)
        for _ in range(int(g.integers(1, 9))):
            rows.append((len(rows), [float(np.float32(x)) for x in base + g.normal(size=16) * 0.05]))
    hot = [1.0] * 16
    rows += [(1000 + i, hot) for i in range(50)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] + [1.0] * 15), (2005, [None] + [1.0] * 15), (2006, [2.0] * 16), (2007, [1.0] * 5), (2008, [1.0] * 5)]
    d = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, members int").repartition(3)
    want = brute_vectors(rows, 0.95)
    for tile in (2048, 7):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vecdedup.near_duplicates(d, 0.95, tile_rows=tile).collect()}
        assert set(got) == set(want)
        found, all_links = sum(min(got[i][0], want[i][0]) for i in want), sum(v[0] for v in want.values())
        assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.97 * all_links
    assert vecdedup.near_duplicates(spark.createDataFrame([], d.schema), 0.95).count() == 0


def test_vector_recall_at_the_threshold(spark):
    """Pairs at a cosine just above the threshold, among unrelated vectors."""
    g = np.random.default_rng(9)
    rows = []
    for _ in range(300):
        a, b = g.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        cos = g.uniform(0.951, 0.97)
        rows += [a.tolist(), (cos * a + np.sqrt(1 - cos * cos) * b).tolist()]
    rows += g.normal(size=(400, 64)).tolist()
    d = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = vecdedup.near_duplicates(d, 0.95).where("n_links > 0").count()
    assert got >= 0.9 * 600


@pytest.mark.parametrize("n_pivots", [64, 453, 1024, 4096])
def test_vector_recall_by_number_of_pivots(n_pivots):
    """Of pairs just above the threshold, those that the prefix for so many pivots finds; the rule is that of the index."""
    g = np.random.default_rng(11)
    for dim in (32, 64, 128):
        unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(g.normal(size=(n, dim)))  # noqa: E731, B023
        p, a, b = unit(n_pivots), unit(400), unit(400)
        b -= (b * a).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        c = g.uniform(0.951, 0.96, (400, 1))
        prefix, shared = vecdedup.prefix_for(n_pivots)
        x, y = (np.argsort(-(v @ p.T), axis=1)[:, :prefix] for v in (a, c * a + np.sqrt(1 - c * c) * b))
        assert np.mean([len(set(u) & set(v)) >= shared or u[0] == v[0] for u, v in zip(x.tolist(), y.tolist(), strict=True)]) >= 0.96


def test_vectors_with_many_pivots(spark):
    """The index with as many pivots as a large table has, against brute force."""
    g = np.random.default_rng(12)
    a = g.normal(size=(3000, 64))
    rows = np.vstack([a, a + g.normal(size=a.shape) * 0.3])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r.n_links for r in vecdedup.near_duplicates(d, 0.95, pivots_per_root=60.0, max_pivots=4096).collect()}
    x = rows.astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert want.sum() > 2000 and all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.95 * want.sum()


def test_vectors_repeated(spark):
    """Rows of one id are one vector, each returned; where they differ, one of them stands for the id, always the same."""
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, v), (1, v), (2, v), (3, [2.0, 0.1, 0.0]), (4, w), (None, v), (5, w), (5, [0.0, 0.0, 1.0]), (5, [0.0, 0.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, two = (sorted(tuple(r) for r in vecdedup.near_duplicates(d.repartition(n)).collect()) for n in (1, 5))
    assert one == two and len(one) == 8
    assert [r for r in one if r[0] < 4] == [(1, 2, 1, True)] * 2 + [(2, 2, 1, False), (3, 2, 1, False)]


def test_vector_recall_in_a_dense_group(spark):
    """A third of the rows are distinct near copies of one vector: every link among them is found."""
    g = np.random.default_rng(10)
    base = g.normal(size=64)
    rows = [*(base + g.normal(size=(3000, 64)) * 0.1), *g.normal(size=(6000, 64))]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecdedup.near_duplicates(d, 0.95).collect()}
    x = np.stack(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert want[:3000].min() == 2999
    assert all(got[i] == (2999, 0) for i in range(3000))
    assert all(got[i][0] <= want[i] for i in range(9000))


# WARC


def test_warc(spark):
    big, other = "<p>ü</p>" * 200, "<q>" * 500
    rows = [(i, f"http://www.example.org/p/{i % 5}?b=2&a=1", big if i % 3 else other, 1) for i in range(40)]
    rows += [(100, None, None, 1), (101, "http://x.example/a\r\nb", "", 1), (102, "::bad::[", "small", 1), (103, "http://y/", "small", 1), (104, "", "x" * 200_000, 1)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, position int").repartition(3)
    got = {r.page_id: r for r in warc.archived(d, file_bytes=9000).collect()}
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, _, h, _ in rows:
        groups[h or ""].append(i)
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        top = max(groups[h or ""])
        revisit = len(raw) >= 1000 and i < top
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", top) if revisit else ("response", None))
    keys = sorted((warc.url_key(u), warc.stamp(i), i) for i, u, _, _ in rows)
    assert [(r.url_key, r.ts, r.page_id) for r in sorted(got.values(), key=lambda r: r.capture_rank)] == keys
    assert sorted(r.capture_rank for r in got.values()) == list(range(len(rows)))
    path = warc.scratch_path(spark, "warc-test")
    manifest = warc.write_archives(d, path, file_bytes=9000)
    back = warc.read_archives(manifest, path)
    assert {r.page_id: bytes(r.payload).decode() for r in back.where("record_type = 'response'").collect()} == {i: h or "" for i, _, h, _ in rows if got[i].record_type == "response"}
    # many small ranges, and levels of merges before them
    for fan_in in (256, 3):
        index = sorted(warc.merged_index(manifest, path, range_rows=4, fan_in=fan_in).collect(), key=lambda r: (r.range_id, r.position))
        assert [(r.url_key, r.ts, r.page_id) for r in index] == keys
    assert warc.archived(d.limit(0)).count() == 0


def test_warc_repeated_rows_and_null_ids(spark):
    big = "<p>" * 400
    rows = [(1, "http://a/", big), (1, "http://a/", big), (2, "http://a/", big), (2, "http://a/", "other"), (None, "http://b/", big), (None, None, None)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == sorted(
        [(1, 1200, "revisit", 2)] * 2 + [(2, 1200, "response", 0), (2, 5, "response", 0), (0, 1200, "response", 0), (0, 0, "response", 0)]
    )
    assert sorted(r.capture_rank for r in got) == list(range(6))


def test_warc_runs(tmp_path):
    """A run is read from any key on, batch by batch; archives of many members are read in steps."""
    import gzip
    import io

    from pyarrow import fs

    store, entries = fs.LocalFileSystem(), sorted([("a", i, 1, "r", i % 700, f"k{i % 900:04d}", "t", "response") for i in range(5000)], key=warc._key)
    writer = warc.RunWriter(store, f"{tmp_path}/x.run")
    for e in entries:
        writer.add(e)
    assert writer.close() == 5000
    reader = warc.RunReader(store, f"{tmp_path}/x.run")
    for low, high in ((None, None), (warc._key(entries[1024]), None), (warc._key(entries[17]), warc._key(entries[3000])), (None, warc._key(entries[1]))):
        assert list(reader.rows(low, high)) == [e for e in entries if (low is None or warc._key(e) >= low) and (high is None or warc._key(e) < high)]
    parts = [b"x" * n for n in (0, 5, 70_000, 1)]
    data = b"".join(gzip.compress(p) for p in parts)
    found = list(warc.members(io.BytesIO(data), 7))
    assert [d for _, d in found] == parts and found[1][0] == len(gzip.compress(b""))
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-9])))


def test_loser_tree():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted(r.randrange(30) for _ in range(r.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_warc_digest_header():
    data = warc.record(3, "http://a/", b"abc", None)
    assert base64.b32encode(hashlib.sha1(b"abc").digest()) in data
    assert warc.parsed(data)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"abc", b"abd"))


# quality rules

SPACE = " \t\n\x0b\x0c\r"


def brute_counts(text):
    t = text or ""
    for c in SPACE[1:]:
        t = t.replace(c, " ") if c != "\n" else t
    words = [w for w in t.replace("\n", " ").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if any(c not in SPACE for c in x)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {p + j for v in at.values() if len(v) > 1 for p in v for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, rows, empty):
    extra = [(900 + i, t, "en", "a", 0, 1, "x", 2, 3, 0.5, 4, 5) for i, t in enumerate(["a b c d e " * 4, "a b c d e f a b c d e", "a a a a a", "a a a a a a", "x y\nx y\nz\n\n \n \nx y\r", "a\x0bb\x0cc\rd e  f | # <b>", " a b c"])]
    d = docs.union(spark.createDataFrame(extra, DOCS))
    got = {r.doc_id: r for r in quality_rules.rated(d).collect()}
    for r in [*rows, *extra]:
        want = brute_counts(r[1])
        x = got[r[0]]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, r[1]
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (x.base_failed and x.kept)
    kept = quality_rules.filtered(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.rated(empty).count() == 0 and quality_rules.filtered(empty).count() == 0


def test_quality_thresholds_adapt(spark):
    r = random.Random(8)
    plain = lambda: " ".join(r.choice(WORDS) for _ in range(60))
    coded = lambda: " ".join(r.choice(WORDS) + r.choice(["", "", "#", "|"]) for _ in range(60))
    rows = [(i, plain(), "en", "prose") for i in range(300)] + [(1000 + i, coded(), "en", "code") for i in range(300)]
    rows += [(5000, coded(), "en", "prose"), (5001, coded(), "en", "code"), (5002, " ".join(w + "###" for w in WORDS[:60]), "en", "code")]
    got = {x.doc_id: x.kept for x in quality_rules.rated(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[5000] and got[5001] and not got[5002]
    assert sum(not got[i] for i in range(300)) == 0


def test_each_quality_ratio_rejects(spark):
    """Among plain texts, one that stands out in a single ratio is rejected by the fences, not by the base rules."""
    r = random.Random(9)
    words = lambda n: [r.choice(WORDS) for _ in range(n)]
    rows = [(i, "\n".join(" ".join(words(20)) for _ in range(6)), "en", "a") for i in range(400)]
    lines = [" ".join(words(12)) for _ in range(10)]
    again = words(11)
    odd = {
        "mean_word": " ".join(w * 3 for w in words(120)),
        "symbol_ratio": " ".join(w + "#" * (i % 3 == 0) for i, w in enumerate(words(120))),
        "dup_line_ratio": "\n".join([*lines, *[x for x in (" ".join(words(3)),) for _ in range(9)]]),
        "repeat_ratio": " ".join([*words(60), *again, *words(60), *again]),
    }
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(odd.values())]
    got = {x.doc_id: x for x in quality_rules.rated(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(not got[i].kept for i in range(400)) == 0
    for i, name in enumerate(odd):
        assert not got[1000 + i].base_failed and not got[1000 + i].kept, name


def test_quality_fences_are_of_quartiles(spark):
    """Fences against exact quartiles within the sketches' error; small groups lean on their language, without a step."""
    g = np.random.default_rng(3)
    n = 20_000
    rows = [(int(i), 100, int(c), 0, 0, 0, "en" if i % 2 else "de", "a" if i < n - 50 else f"s{i}") for i, c in enumerate(g.normal(500, 40, n))]
    d = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string, source string")
    got = {(r.lang_key, r.source_key): r.fences.mean_word for r in quality_rules.thresholds(d).collect()}
    v = np.sort([r[2] / 100 for r in rows if r[6] == "en" and r[7] == "a"])
    at = lambda q: v[int(q * len(v))]
    low, high = (at(0.25 + e) - 3 * (at(0.75 - e) - at(0.25 + e)) - 0.5 for e in (-0.02, 0.02))
    assert low <= got["=en", "=a"][0] <= high
    one = next(k for k in got if k[0] == "=en" and k[1] != "=a")
    assert abs(got[one][0] - got["=en", "=a"][0]) < 0.3


# Jaccard


def brute_sets(text, k):
    w = (text or "").encode().translate(jaccard._LOWER).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows, k, percent):
    sets = {r[0]: brute_sets(r[1], k) for r in rows}
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    c = union_find(links, ids)
    return {i: (len(sets[i]), c[i]) for i in ids}


def test_jaccard(spark, docs, rows, empty):
    for k, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, percent).collect()}
        assert got == brute_components(rows, k, percent)
    kept = jaccard.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute_components(rows, 5, 80).items() if c == i}
    assert jaccard.jaccard_components(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_jaccard_chains_at_the_threshold(spark):
    """Texts that drift word by word, groups of edited copies, texts of few words: links at and about the limit."""
    r = random.Random(12)
    rows = []
    for n in (3, 4, 5, 7, 12, 25, 60):
        w = [r.choice(WORDS) for _ in range(n)]
        for _ in range(12):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            w[r.randrange(n)] = r.choice(WORDS)
    base = [r.choice(WORDS) for _ in range(150)]
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(150)] = r.choice(WORDS)
        rows.append((len(rows), " ".join(w[r.randint(0, 4) :])))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k, percent in ((3, 90), (5, 80), (1, 80)):
        for block in (512, 4):
            got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(d, k, percent, block_rows=block).collect()}
            assert got == brute_components(rows, k, percent)


def test_jaccard_tiles_lose_no_pair():
    """Any two sets at the limit share a tile."""
    g = np.random.default_rng(3)
    for percent in (80, 90):
        for _ in range(600):
            n = int(g.integers(1, 400))
            pool = g.integers(0, 1 << 63, 2 * n + 20, dtype=np.uint64)
            d = jaccard.most_apart(2 * n, percent)
            gone, added = int(g.integers(0, d + 1)), int(g.integers(0, d + 1))
            x, y = np.unique(pool[:n]), np.unique(np.r_[pool[min(gone, n) : n], pool[n : n + added]])
            common = len(np.intersect1d(x, y))
            if not len(y) or 100 * common < percent * (len(x) + len(y) - common):
                continue
            b = jaccard.Bands(percent)
            assert set(b.tiles(x).tolist()) & set(b.tiles(y).tolist())


# packing


def test_encoder_matches_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(1)
    texts = ["", " ", "a  b", "x\n\n y", "<|endoftext|> it's 's １２3", "😀 é　x\x1cb"] + ["".join(r.choice(" \n\t'sab1é!. <|") for _ in range(40)) for _ in range(500)]
    got = packing.encoder(tokenizer_path("byte_bpe_50k.json"))(texts)
    assert [x.tolist() for x in got] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_gives_special_strings_the_library_s_ids(spark):
    """Against an unmodified Tokenizer, which gives a special string inside a text the token's id."""
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(7)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n\n b", "<|endoftext"]
    texts += ["".join(r.choice(["<|endoftext|>", " ", "\n", "it's", "ab", "é", "<|", "1"]) for _ in range(30)) for _ in range(300)]
    got = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    check_packing(got, {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}, 1024, 64, None)


def test_packing_holds_very_long_white_space():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [" " * 2_000_000, "a" + "\n" * 60_000 + "b <|endoftext|>", "x" * 300_000]
    got = packing.encoder(path, special_strings=True)(texts)
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def check_packing(got, ids, max_tokens, max_segments, max_loss):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_tokens and len(own) <= max_segments
        assert max_loss is None or sum(r.loss_tokens for r in own) <= max_loss
    return by_seq


def test_packing(docs, rows, empty):
    encode = packing.encoder(tokenizer_path("byte_bpe_50k.json"))
    ids = {r[0]: [*encode([r[1] or ""])[0].tolist(), 0] for r in rows}
    got = packing.packed(docs.coalesce(2), tokenizer_path("byte_bpe_50k.json")).collect()
    seqs = check_packing(got, ids, 1024, 64, None)
    total = sum(map(len, ids.values()))
    assert len(seqs) <= -(-total // 1024) + 2
    assert packing.packed(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing_under_three_limits(spark, docs, rows):
    encode = packing.encoder(tokenizer_path("byte_bpe_50k.json"))
    ids = {r[0]: [*encode([r[1] or ""])[0].tolist(), 0] for r in rows}
    got = packing.packed(docs.withColumn("loss", docs.n_chars % 90), tokenizer_path("byte_bpe_50k.json"), 256, 5, 200, loss_col="loss").collect()
    check_packing(got, ids, 256, 5, 200)


def test_place_takes_the_largest_dot_product():
    g = np.random.default_rng(6)
    sizes = np.column_stack([g.integers(1, 100, 200), np.ones(200, int), g.integers(0, 60, 200)])
    limits = packing.Limits(100, 6, 80)
    bins = packing.place(sizes, limits)
    assert sorted(i for b in bins for i in b) == list(range(200))
    rest = set(range(200))
    for b in bins:
        left = limits.each.astype(float)
        for i in b:
            fits = [j for j in rest if (sizes[j] <= left).all()]
            dot = lambda j: (sizes[j] / limits.each) @ (left / limits.each)  # noqa: E731, B023
            assert dot(i) >= max(map(dot, fits)) - 1e-12
            rest.discard(i)
            left -= sizes[i]
        assert not [j for j in rest if (sizes[j] <= left).all()]


# classifier


def test_classifier(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        good = r.random() < 0.7
        words = [r.choice(WORDS) for _ in range(r.randint(20, 120))]
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words[:8] for _ in range(9)]
        rows.append((i, " ".join(words), 1.0, 0))
        if i % 5:
            labels.append((i, int(good), 0))
    rows += [(2000, None, 1.0, 0), (2001, "", 1.0, 0), (2002, "\n ", 1.0, 0), (2003, "x" * 300_000, 1.0, 0)]
    labels += [(2000, None, 0), (None, 1, 0), (3, 9, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int").repartition(3)
    y = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    got = {x.doc_id: x for x in classifier.scored(d, y).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got.values())
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and x.predicted == int(x.score >= 0.7) for i, x in got.items())
    held = [(got[i].predicted, q) for i, q, _ in labels if i is not None and q in (0, 1) and got[i].held_out]
    assert len(held) > 150 and sum(p == q for p, q in held) / len(held) > 0.95
    # held-out labels change nothing
    flipped = spark.createDataFrame([(i, 1 - q if i is not None and q in (0, 1) and zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels], y.schema)
    again = {x.doc_id: x.score for x in classifier.scored(d, flipped).collect()}
    assert all(abs(again[i] - x.score) < 1e-6 for i, x in got.items())
    # an id with both labels counts for neither, a repeated label once
    both = y.union(spark.createDataFrame([(i, 1 - q, 0) for i, q, _ in labels[:40] if q in (0, 1)], y.schema)).union(y)
    less = y.where(~y.doc_id.isin([i for i, q, _ in labels[:40] if q in (0, 1)]))
    one, two = ({x.doc_id: x.score for x in classifier.scored(d, z).collect()} for z in (both, less))
    assert all(abs(one[i] - s) < 1e-6 for i, s in two.items())
    kept = {x.doc_id for x in classifier.filtered(d, y).collect()}
    assert sum((i in kept) != (x.predicted == 1) for i, x in got.items()) <= 2
    assert classifier.scored(d.limit(0), y).count() == 0
    assert {x.score for x in classifier.scored(d.limit(5), y.limit(0)).collect()} == {0.5}


def test_isotonic_rises():
    g = np.random.default_rng(1)
    p, t = g.integers(0, 6, 30).astype(float), np.full(30, 6.0)
    x, y = classifier.isotonic(np.arange(30.0), p, t)
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


def test_classifier_adds_arrays_whole(spark, monkeypatch):
    """Partial sums of partitions are added as arrays: taken apart, they'd be a row a number and partition."""

    def refused(*_):
        raise AssertionError("exploded")

    monkeypatch.setattr(classifier.F, "posexplode", refused)
    rows = spark.range(100).selectExpr("cast(id as double) as x").repartition(7)

    def run(batches):
        s = sum(sum(b.column(0).to_pylist()) for b in batches)
        yield classifier.pa.RecordBatch.from_arrays([classifier.pa.array([0, 1], classifier.pa.int32()), classifier.pa.array([[s, 1.0, 0.5], [2 * s]], classifier.pa.list_(classifier.pa.float64()))], ["i", "x"])

    got = classifier._summed(rows, run, 2)
    assert got[0].tolist() == [4950.0, 7.0, 3.5] and got[1].tolist() == [9900.0]
    assert classifier._summed(rows.limit(0), lambda batches: iter(()), 2) == {}


def test_classifier_against_a_direct_fit(spark):
    """The scores are those of one ridge regression over all labelled rows at once, in double precision, and of shares counted in plain bins."""
    r = random.Random(11)
    rows = [(i, " ".join(r.choice(WORDS).upper() if i % 3 == 0 else r.choice(WORDS) for _ in range(r.randint(0, 80)))) for i in range(600)]
    labels = {i: int((i % 3 > 0) != (r.random() < 0.1)) for i in range(600) if i % 7}
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.score for x in classifier.scored(d, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    part = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in rows}
    stats = np.array([classifier.statistics(t) for _, t in rows])
    train = [i for i in labels if part[i] in (0, 1)]
    x, y = stats[train], np.array([labels[i] for i in train], float)
    g = np.random.default_rng(classifier.SEED)
    width = x.shape[1]
    waves, phases = g.normal(size=(width, classifier.FEATURES)) / classifier.BANDWIDTH, g.uniform(0, 2 * np.pi, classifier.FEATURES)
    z = np.clip((stats - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    z = np.hstack([np.sqrt(2 / len(phases)) * np.cos(z @ waves + phases), z * 0.05, np.ones((len(z), 1))])
    # ridge as least squares over more rows
    root = np.sqrt(np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())))
    a = np.vstack([z[train] * root[:, None], np.sqrt(classifier.RIDGE) * np.eye(z.shape[1])])
    raw = z @ np.linalg.lstsq(a, np.r_[y * root, np.zeros(z.shape[1])], rcond=None)[0]
    bins = defaultdict(list)
    for i in labels:
        if part[i] == 3:
            bins[min(classifier.BINS - 1, max(0, int((raw[i] + 0.5) / 2 * classifier.BINS)))].append(i)
    knots = classifier.isotonic(*(np.array([f(bins[b]) for b in sorted(bins)]) for f in (lambda k: raw[k].mean(), lambda k: float(sum(labels[i] for i in k)), lambda k: float(len(k)))))
    want = np.clip(np.interp(raw, *knots), 0, 1)
    assert max(abs(got[i] - want[i]) for i in got) < 1e-6


# pseudo-likelihood


def test_gradient():
    net = pseudo_lm.Network()
    g = np.random.default_rng(2)
    net = pseudo_lm.Network(net.flat + g.normal(size=len(net.flat)) * 0.05)
    ctx, target = g.integers(0, pseudo_lm.CLASSES + 1, (40, 4)), g.integers(0, pseudo_lm.CLASSES, 40)
    grad, loss = net.gradient(ctx, target)
    assert abs(loss + net.log_probs(ctx, target).mean()) < 1e-4
    for _ in range(5):
        v = g.normal(size=len(net.flat)).astype(np.float32)
        up, down = (pseudo_lm.Network(net.flat + s * 2e-3 * v).gradient(ctx, target)[1] for s in (1, -1))
        assert abs((up - down) / 4e-3 - grad @ v) < 0.02 * max(1, abs(grad @ v))


def test_lm_scores(spark, docs, rows, empty):
    counts = pseudo_lm.word_counts(docs, most=50)
    truth = Counter(w for r in rows for w in pseudo_lm.words(r[1]))
    assert {bytes(r.word): r.n for r in counts.collect()} == truth
    vocab = pseudo_lm.vocabulary(counts)
    top = sorted(truth, key=lambda w: (-truth[w], w))[: pseudo_lm.TOP]
    assert vocab.own == top
    net = pseudo_lm.trained(docs, vocab)
    got = {r.doc_id: r for r in pseudo_lm.scores(docs, vocab, net).collect()}
    assert len(got) == len(rows)
    for r in rows[:25]:
        c = vocab.encode(r[1])
        cls = vocab.classes(c)
        total = 0.0
        for i in range(len(c)):
            ctx = [cls[j] if 0 <= j < len(c) else pseudo_lm.PAD for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(sum(net.e[k] @ net.w[p] for p, k in enumerate(ctx)) + net.b)
            g, size = cls[i] // net.size, net.last if cls[i] // net.size == net.n_groups - 1 else net.size
            for z, t in ((h @ net.u + net.a, g), (h @ net.v[g, :, :size] + net.c[g, :size], cls[i] % net.size)):
                z = z.astype(np.float64)
                total += z[t] - z.max() - np.log(np.exp(z - z.max()).sum())
            total += vocab.shares(c[i : i + 1])[0]
            if i > 300:
                break
        if len(c) <= 300:
            assert got[r[0]].n_words == len(c) and abs(got[r[0]].log_prob - total) < 1e-3 * max(1, len(c))
    assert got[7].n_words == 0 and got[7].log_prob == 0 and got[7].mean_log_prob is None
    assert pseudo_lm.lm_scores(empty).count() == 0


def test_lm_prefers_what_it_knows(spark):
    r = random.Random(4)
    rows = [(i, " ".join(w for _ in range(30) for w in r.choice(["the cat sat down", "a dog ran off", "we all went home"]).split())) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    vocab = pseudo_lm.vocabulary(pseudo_lm.word_counts(d))
    net = pseudo_lm.trained(d, vocab)
    probe = spark.createDataFrame([(1, "the cat sat down a dog ran off"), (2, "off cat the a down dog ran sat")], "doc_id long, text string")
    s = {x.doc_id: x.mean_log_prob for x in pseudo_lm.scores(probe, vocab, net).collect()}
    assert s[1] > s[2] + 0.5


def test_lm_weights_depend_on_rows_alone(spark, docs):
    vocab = pseudo_lm.vocabulary(pseudo_lm.word_counts(docs))
    one, two = (pseudo_lm.trained(d, vocab, shard_words=5000).flat for d in (docs.coalesce(1), docs.repartition(7)))
    assert pseudo_lm.shards(vocab.n_words, shard_words=5000) > 2 and np.abs(one - two).max() < 1e-5


def test_lm_words_are_split_alike():
    import pyarrow as pa

    texts = [None, "", " ", "a", " A\tb\n\x0b\x0cc\r", "é\u00a0É x\x1cy", "ÀB  c "]
    flat, counts = pseudo_lm.split_words(pa.array(texts))
    want = [pseudo_lm.words(t) for t in texts]
    assert counts.tolist() == list(map(len, want)) and flat.to_pylist() == [w for ws in want for w in ws]
    assert pseudo_lm.split_words(pa.array([], pa.string()))[1].tolist() == []


def test_lm_probabilities_sum_to_one():
    g = np.random.default_rng(5)
    for classes in (10, 512, 517):
        net = pseudo_lm.Network(classes=classes)
        net = pseudo_lm.Network(net.flat + g.normal(size=len(net.flat)) * 0.3, classes)
        ctx = np.repeat(g.integers(0, classes + 1, (1, 4)), classes, 0)
        assert abs(np.exp(net.log_probs(ctx, np.arange(classes)).astype(float)).sum() - 1) < 1e-4


def test_lm_trains_on_ends_and_short_texts(spark):
    """Every word of a short text is a training target, so the last ones are known too."""
    d = spark.createDataFrame([(i, "red green blue") for i in range(8000)], "doc_id long, text string").coalesce(1)
    vocab = pseudo_lm.vocabulary(pseudo_lm.word_counts(d))
    net = pseudo_lm.trained(d, vocab)
    assert pseudo_lm.scores(d.limit(1), vocab, net).first().log_prob > -0.5


def test_lm_shares_are_of_words(spark):
    """A word's share of its class follows its own count, whatever hashes alike; classes grow with the corpus."""
    common = next(w for i in range(10**6) if zlib.crc32(w := b"c%d" % i) % pseudo_lm.class_numbers(pseudo_lm.TOP + 2)[1] == zlib.crc32(b"junk") % pseudo_lm.class_numbers(pseudo_lm.TOP + 2)[1])
    rows = [(bytearray(b"f%d" % i), 1000) for i in range(pseudo_lm.TOP)] + [(bytearray(common), 500), (bytearray(b"junk"), 1)]
    vocab = pseudo_lm.vocabulary(spark.createDataFrame(rows, "word binary, n long"))
    a, b = vocab.shares(vocab.encode(common.decode() + " junk"))
    assert abs(a - b - np.log(500)) < 1e-3
    small, large = pseudo_lm.class_numbers(10_000), pseudo_lm.class_numbers(10**8)
    assert large[0] > 4 * small[0] and large[1] > 4 * small[1]


def test_lm_joins_the_counts_it_does_not_hold(spark, docs):
    counts = pseudo_lm.word_counts(docs)
    whole, part = pseudo_lm.vocabulary(counts), pseudo_lm.vocabulary(counts, known=5)
    assert whole.complete and not part.complete
    net = pseudo_lm.trained(docs, whole)
    want, got = ({r.doc_id: (r.n_words, r.log_prob) for r in pseudo_lm.scores(docs, v, net, counts=counts).collect()} for v in (whole, part))
    assert set(got) == set(want)
    assert all(got[i][0] == n and abs(got[i][1] - p) < 1e-3 * max(1, n) for i, (n, p) in want.items())


def test_jaccard_repeats_and_groups(spark):
    """Every row comes back; a large group of copies and near copies, a passage that many texts share, and rows with null ids."""
    r = random.Random(21)
    word = lambda: f"v{r.randrange(5000)}"
    base, passage = [word() for _ in range(80)], [word() for _ in range(60)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 700):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(80)] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join([word() for _ in range(90)] + passage)) for i in range(700, 900)]
    rows += [(5, " ".join(base)), (700, rows[700][1]), (None, " ".join(base)), (None, None), (950, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block in (512, 16):
        got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_shingles, -1 if x.component_id is None else x.component_id) for x in jaccard.jaccard_components(d, 5, 80, block_rows=block).collect())
        want = brute_components([x for x in rows if x[0] is not None], 5, 80)
        assert got == sorted((-1, len(brute_sets(t, 5)), -1) if i is None else (i, *want[i]) for i, t in rows)
    assert {x.doc_id for x in jaccard.one_of_each(d, 5, 80).collect()} == {None} | {i for i, (_, c) in want.items() if c == i}


def test_repeated_rows_are_each_returned(spark, docs, rows):
    """Equal rows, and a null id, in the operators that return a row for each row: repeats have equal results, and places of their own."""
    again = [rows[4], rows[4], rows[16], (None, *rows[5][1:])]
    d = docs.union(spark.createDataFrame(again, DOCS)).repartition(4)
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 > 0)) for r in rows if r[0] % 2], "doc_id long, quality int")
    n = len(rows) + len(again)
    shards = sharding.sharded(d, 5, 64).collect()
    assert len(shards) == n and len({(r.shard, r.slot) for r in shards}) == n
    tokens = tokencount.count_tokens(d, tokenizer_path("piece_bpe_32k.model"), 100).collect()
    rated = quality_rules.rated(d).collect()
    scored = classifier.scored(d, labels).collect()
    vocab = pseudo_lm.vocabulary(pseudo_lm.word_counts(d))
    lm = pseudo_lm.scores(d, vocab, pseudo_lm.Network(classes=vocab.n_classes)).collect()
    for got in (tokens, rated, scored, lm):
        assert len(got) == n and sum(r.doc_id is None for r in got) == 1
        assert len([r for r in got if r.doc_id == rows[4][0]]) == 3 and len({tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got if r.doc_id == rows[4][0]}) == 1
    packed = packing.packed(d.coalesce(1), tokenizer_path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in packed if r.doc_id == rows[4][0]) == 3 * next(r.doc_tokens for r in packed if r.doc_id == rows[4][0])
    assert sum(r.length for r in packed if r.doc_id is None) == next(r.doc_tokens for r in packed if r.doc_id is None)


def test_isotonic_against_every_other_rising_line():
    """Pooled means are the rising values of least squares: no other rising choice of a small grid comes nearer."""
    import itertools

    g = np.random.default_rng(8)
    for _ in range(20):
        t = g.integers(1, 5, 5).astype(float)
        p = np.array([g.integers(0, k + 1) for k in t.astype(int)], float)
        pools: list[list[float]] = []
        for a, b in zip(p, t, strict=True):
            pools.append([a, b, 1])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
        fit = np.concatenate([np.full(int(k), a / b) for a, b, k in pools])
        loss = lambda y: float((t * (p / t - np.array(y)) ** 2).sum())  # noqa: B023, E731
        grid = sorted({*(p / t), *fit})
        assert loss(fit) <= min(loss(y) for y in itertools.combinations_with_replacement(grid, 5)) + 1e-12
        x, y = classifier.isotonic(np.arange(5.0), p, t)
        inner = y[1:-1]
        prior = (p.sum() + 1) / (t.sum() + 2)
        assert len(inner) == len(pools) and np.allclose(inner, np.maximum.accumulate([(a + prior) / (b + 1) for a, b, _ in pools]))
