"""Ranked lexical search by a tiered index.

Documents are dealt to blocks in the order they are read. A block lists each of its terms' postings by falling impact, the part of the score that doesn't
depend on the query, and cuts the list into tiers: those of highest impact first, where they end following from the list's length. Beside a tier stand the residual bounds
of the terms that go on below it, the largest impact that lower tiers hold. The index is a written table, a row a block and a column a tier, so a search that needs the first tier reads no more.

A search probes the first tier of all blocks: the k-th best of these partial scores is a score that k documents reach. Then each item goes through a block's tiers:
what a tier has seen plus the bounds of what it hasn't limits every document of the block from above. While that limit is below the k-th best
score known, the block is proven to hold no result of the item; otherwise the item falls through to the next tier, and at the last one scores are
exact. Tasks keep k documents an item, so no posting is shuffled and no term, however frequent, is one task's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselith.llm.common import drop_written, written

#: Words of a block, about; one text is never cut.
BLOCK_TERMS = 1 << 18
#: Of a term's n postings in a block, tiers end at max(least, n / part).
TIERS = ((8, 16), (32, 4))
#: Terms of all items that are searched for at once, about.
CHUNK_TERMS = 200_000
#: The score's fixed values: saturation, length norm in hundredths, and the scale of an impact.
K1, B, UNIT = 12, 25, 1_000_000_000
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SPLIT = 1000
#: Parquet would look at the size of pages and row groups after 100 rows only, and hold a large row group in memory while it writes or reads it.
_FEW_LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false"}
#: Lists of a block are bytes of 32-bit numbers, rows of 16-bit numbers where they suffice; terms are their bytes one after another, and where each ends.
_TIER = "struct<rows:binary,impacts:binary,rest:binary>"
INDEX = "block long, n_docs long, n_terms long, ids array<long>, term_ends binary, term_bytes binary, df binary, " + ", ".join(f"t{i} {_TIER}" for i in range(len(TIERS) + 1))


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of all texts in one binary array, A-Z lower-cased, and how many each text has. Terms are apart at ASCII characters that are no letters or digits; null has none."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = memoryview(texts.buffers()[2] or b"")[at[0] : at[-1]].tobytes().translate(_TERM_BYTES)
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(data)]))
    flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    keep = pc.not_equal(flat, "")
    before = np.r_[0, np.cumsum(keep.to_numpy(zero_copy_only=False))]
    counts = np.diff(np.r_[0, before[ends]]) if len(ends) else np.zeros(0, np.int64)
    return flat.filter(keep).cast(pa.binary()), counts


def length_stats(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = total = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, _SPLIT):
                n = split_terms(batch.column(0).slice(lo, _SPLIT))[1]
                some, total = some + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([total])], ["n", "l"])

    r = docs.select(text_col).mapInArrow(run, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    return r["n"], r["l"]


def tier_ends(df: np.ndarray, tiers: tuple = TIERS) -> list[np.ndarray]:
    """Where each tier ends in lists of these lengths."""
    return [np.minimum(df, np.maximum(least, -(-df // part))) for least, part in tiers] + [df]


def row_kind(n_docs: int) -> type:
    return np.uint16 if n_docs <= 1 << 16 else np.int32


def block_row(block: int, n_docs: int, n_terms: int, ids: pa.Array, flat: pa.Array, counts: np.ndarray, tiers: tuple = TIERS) -> pa.RecordBatch:
    """The index of one block: counts[i] of the terms `flat` belong to the document ids[i]."""
    coded = flat.dictionary_encode()
    size = max(1, len(counts))
    key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * size + np.repeat(np.arange(len(counts)), counts), return_counts=True)
    term, row = key // size, key % size
    m = 100 - B + (B * counts.astype(np.int64) * n_docs) // n_terms
    impact = (UNIT * tf) // (1000 * tf + K1 * m[row])
    order = np.lexsort((-impact, term))
    term, row, impact = term[order], row[order], impact[order]
    df = np.bincount(term, minlength=len(coded.dictionary))
    first = np.r_[0, np.cumsum(df)]
    place = np.arange(len(term)) - first[term]
    ends = tier_ends(df, tiers)
    columns, begin = [], np.zeros(len(df), np.int64)
    ints = lambda x, kind=np.int32: pa.array([x.astype(kind).tobytes()], pa.binary())
    for end in ends:
        here = (place >= begin[term]) & (place < end[term])
        rest = impact[(first[:-1] + end)[end < df]]
        columns.append(pa.StructArray.from_arrays([ints(row[here], row_kind(len(ids))), ints(impact[here]), ints(rest)], ["rows", "impacts", "rest"]))
        begin = end
    names = coded.dictionary.to_pylist()
    arrays = [pa.array([block]), pa.array([n_docs]), pa.array([n_terms]), pa.ListArray.from_arrays([0, len(ids)], ids), ints(np.cumsum([0, *map(len, names)])), pa.array([b"".join(names)], pa.binary()), ints(df), *columns]
    return pa.RecordBatch.from_arrays(arrays, ["block", "n_docs", "n_terms", "ids", "term_ends", "term_bytes", "df", *[f"t{i}" for i in range(len(ends))]])


def numbers(cell: pa.Scalar, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def terms_of(batch: pa.RecordBatch, i: int) -> pa.Array:
    """The terms of the block in row i."""
    ends = batch.column("term_ends")[i].as_buffer()
    return pa.Array.from_buffers(pa.binary(), ends.size // 4 - 1, [None, ends, batch.column("term_bytes")[i].as_buffer()])


def tiered_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The index of every text, a written table with a row a block. Texts without a term are in no block."""
    n_docs, n_terms = length_stats(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 36, []

        def out() -> pa.RecordBatch:
            ids, flat, counts = zip(*held, strict=True)
            return block_row(block, n_docs, n_terms, pa.concat_arrays(ids), pa.concat_arrays(flat), np.concatenate(counts))

        for batch in batches:
            for lo in range(0, batch.num_rows, _SPLIT):
                part = batch.slice(lo, _SPLIT)
                flat, counts = split_terms(part.column(1))
                ends, at = np.cumsum(counts), 0
                while at < len(counts):  # as many documents as the block has room for, one at least
                    before = int(ends[at - 1]) if at else 0
                    room = block_terms - sum(len(f) for _, f, _ in held)
                    to = max(int(np.searchsorted(ends, before + room, "right")), at + (not held))
                    if to > at:
                        some = np.flatnonzero(counts[at:to]) + at
                        held.append((part.column(0).take(pa.array(some)), flat.slice(before, int(ends[to - 1]) - before), counts[some]))
                    if to < len(counts):
                        if sum(len(f) for _, f, _ in held):
                            yield out()
                            block += 1
                        held = []
                    at = to
        if sum(len(f) for _, f, _ in held):
            yield out()

    return written(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, INDEX), "tier-index", **_FEW_LARGE_ROWS)


@dataclass
class Items:
    """Items to search for: the terms of item i are term[start[i]:start[i + 1]], numbers in `vocab`, with weights."""

    keys: np.ndarray
    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    vocab: pa.Array


class Block:
    """A block's tiers, as far as they were read, and its terms by their numbers in a vocabulary."""

    def __init__(self, batch: pa.RecordBatch, i: int, vocab: pa.Array):
        own = pc.index_in(terms_of(batch, i), value_set=vocab).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(~np.isnan(own.astype(np.float64)))
        self.at = np.full(len(vocab), -1)
        self.at[own[known].astype(np.int64)] = known
        self.ids = batch.column("ids")[i].values
        df = numbers(batch.column("df")[i]).astype(np.int64)
        self.tiers, begin = [], np.zeros(len(df), np.int64)
        for t, end in enumerate(tier_ends(df)):
            if f"t{t}" in batch.schema.names:
                c = batch.column(f"t{t}")
                rest = np.zeros(len(df), np.int64)
                rest[end < df] = numbers(c.field("rest")[i])
                self.tiers.append((np.r_[0, np.cumsum(end - begin)], numbers(c.field("rows")[i], row_kind(len(self.ids))), numbers(c.field("impacts")[i]), rest))
            begin = end

    def partial(self, term: np.ndarray, weight: np.ndarray, tiers: int) -> tuple[np.ndarray, int]:
        """Each document's score by the first `tiers` tiers, and the bound of all documents' whole scores."""
        at = self.at[term]
        here = at >= 0
        at, weight = at[here], weight[here].astype(np.int64)
        rest = self.tiers[tiers - 1][3][at]
        rows, seen, over = [], [], []
        for starts, row, impact, _ in self.tiers[:tiers]:
            n = starts[at + 1] - starts[at]
            place = np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
            w, x = np.repeat(weight, n), impact[place].astype(np.int64)
            rows.append(row[place])
            seen.append(w * x)
            over.append(w * (x - np.repeat(rest, n)))
        rows, left = np.concatenate(rows), int((weight * rest).sum())
        score = summed(rows, np.concatenate(seen), len(self.ids))
        return score, left + max(0, int(summed(rows, np.concatenate(over), len(self.ids)).max(initial=0)) if left else int(score.max(initial=0)))


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers by row, exact."""
    if float(np.abs(values).sum(dtype=np.float64)) < 2.0**52:  # doubles add such integers exactly
        return np.bincount(rows, values, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, rows, values)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    return np.lexsort((ids, -scores))[:k]


_LAST = np.iinfo(np.int64).max


def _searches(items: Items, k: int, floor: np.ndarray | None):
    """Without a floor, the probe: the k best partial scores an item, of the first tier. With one (a score an item), the search: the k best documents an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(items.keys)
        least = np.zeros(n, np.int64) if floor is None else floor.copy()
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, items.vocab)
                ids = block.ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
                for i in range(n):
                    term, weight = (x[items.start[i] : items.start[i + 1]] for x in (items.term, items.weight))
                    for tiers in range(1, len(block.tiers) + 1):
                        score, bound = block.partial(term, weight, tiers)
                        if bound <= 0 or bound < least[i]:
                            break  # proven: no document of the block is among the best
                    else:
                        found = np.flatnonzero((score >= least[i]) & (score > 0))
                        if len(found):
                            s, d = np.r_[best[i][0], score[found]], np.r_[best[i][1], ids[found]]
                            top = _best(s, d, k)
                            best[i] = s[top], d[top]
                            if len(top) == k:
                                least[i] = max(least[i], s[top[-1]])
        own = [len(s) for s, _ in best]
        if sum(own):
            s, d = (np.concatenate([x[j] for x in best]) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(items.keys, own)), pa.array(d, mask=d == _LAST), pa.array(s)], ["key", "doc_id", "score"])

    return run


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item_id, term, n), written: the terms of each row with their number; key is the row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _SPLIT):
                part = batch.slice(lo, _SPLIT)
                flat, counts = split_terms(part.column(2))
                row = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), flat], ["key", "item_id", "term"])

    rows = items.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["item_id"]
    return written(rows.mapInArrow(run, f"key long, item_id {kind}, term binary").groupBy("key", "item_id", "term").agg(F.count(F.lit(1)).alias("n")), "tier-items")


def search(index: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by rising doc_id.

    Items are searched for in chunks, whose terms and weights tasks hold; a chunk reads the index three times: document frequencies, probe, search.
    """
    spark = index.sparkSession
    terms = item_terms(items, id_col, text_col)
    chunks = max(1, -(-terms.count() // chunk_terms))
    size = index.select("n_docs").limit(1).collect()
    n_docs = size[0]["n_docs"] if size else 0
    found = None
    for c in range(chunks):
        own = terms.where(F.pmod(F.xxhash64("key"), F.lit(chunks)) == c).select("key", "term", "n").collect()  # about chunk_terms rows
        vocab = sorted({bytes(r["term"]) for r in own})
        number = {t: i for i, t in enumerate(vocab)}
        held = pa.array(vocab, pa.binary())

        def counted(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(held), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    at = pc.index_in(terms_of(batch, i), value_set=held)
                    wanted = pc.is_valid(at)
                    np.add.at(total, at.filter(wanted).to_numpy(), numbers(batch.column("df")[i])[wanted.to_numpy(zero_copy_only=False)])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["t", "df"])

        df = {r["t"]: r["df"] for r in index.select("term_ends", "term_bytes", "df").mapInArrow(counted, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
        rows = sorted((r["key"], t, r["n"] * weight[t]) for r in own if weight.get(t := number[bytes(r["term"])], 0) > 0)
        keys, start = np.unique(np.array([r[0] for r in rows], np.int64), return_index=True)
        one = Items(keys, np.r_[start, len(rows)], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), held)
        best = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = lambda d: d.withColumn("rank", F.row_number().over(best))  # noqa: B023, E731
        schema = "key long, doc_id long, score long"
        probe = ranked(index.select("ids", "term_ends", "term_bytes", "df", "t0").mapInArrow(_searches(one, k, None), schema)).where(F.col("rank") == k)
        known = {r["key"]: r["score"] for r in probe.collect()}  # a row an item of the chunk
        floor = np.array([known.get(key, 0) for key in keys.tolist()], np.int64)
        part = ranked(index.select("ids", "term_ends", "term_bytes", "df", *[f"t{i}" for i in range(len(TIERS) + 1)]).mapInArrow(_searches(one, k, floor), schema)).where(F.col("rank") <= k)
        part = written(part, "tier-found")
        found = part if found is None else found.union(part)
    named = terms.select("key", "item_id").distinct()
    return found.join(named, "key").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, by an index of all documents made for it.

    A null or empty text has no terms: such a document is found by no item and counts nowhere, such an item has no rows. Rows of equal ids are
    documents, or items, of their own; a null doc_id sorts last among equal scores. Equal texts have equal scores. A text is never cut, however long. An empty table of either
    kind gives an empty result. Other columns aren't read.
    """
    index = tiered_index(docs)
    out = search(index, items, k)
    drop_written(index)
    return out
