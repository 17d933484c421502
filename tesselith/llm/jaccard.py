"""Jaccard join on word shingles: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Sets at similarity t or more differ in at most d = (1-t)/(1+t) * (a+b) shingles. Sizes fall into bands; each band cuts
the hash space into p > d parts, so of two such sets at least p - d parts hold the same shingles. A tile
is (band, part, content of that part): pairs meet only inside tiles, in their own band or in the next for sizes near
its edge. That loses no pair, and needs no comparison of all sets in a band with each other. Sets share p - d tiles, so
each leaves out its commonest ones, and what many documents have in common makes no pairs.

In a tile each set is first held against one centre, not against all others. Pairs pass, in order: sizes; the bit counts
of hashed bitmaps as wide as the band needs, which bound the overlap from above; the exact intersection of sorted arrays, for one
centre of each set. Sets that links to a centre have joined need no further comparison. What is left of a centre's group is
compared by bitmaps, block by block; the texts of sets with a possible partner go once to a group of all those connected so, and are
intersected there, a task a pair of blocks. Only links are given out.

Shingles are 64-bit hashes of their words; different shingles are taken to have different hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselith.llm.common import connected_components, drop_written, hot_keys, small, spread_join, text_bytes, written

BAND_RATIO = 1.5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class _WordHashes(dict):
    """Hashes of words seen; emptied when it has grown to its bound."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, seen: dict | None = None) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles, A-Z lower-cased, words apart at ASCII white space.

    With fewer than k words the whole sequence is the one shingle; without words there is none.
    """
    seen = _WordHashes() if seen is None else seen
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, n)
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * _STEP + h[i : n - width + 1 + i])
    return np.unique(out)


def most_apart(total: int, percent: int) -> int:
    """The most shingles by which two sets of `total` together may differ at `percent` similarity or more."""
    return (100 - percent) * total // (100 + percent)


class Bands:
    """Bands of sizes, their parts, and the tiles of a set."""

    def __init__(self, percent: int, ratio: float = BAND_RATIO):
        self.percent, self.ratio, self.low = percent, ratio, [1]

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * self.ratio)))
        b = int(np.searchsorted(self.low, n, side="right")) - 1
        return b

    def tiles(self, s: np.ndarray) -> np.ndarray:
        """Tile keys of a sorted set of hashes."""
        b = self.band(len(s))
        keys = self._keys(s, b)
        return np.concatenate([keys, self._keys(s, b + 1)]) if self._reaches(len(s), b) else keys

    def parts(self, b: int) -> tuple[int, int]:
        """Parts of a band, and the most parts in which two of its sets at the limit differ."""
        d = most_apart(2 * (self.low[b + 1] - 1), self.percent)
        return d + 1 + (d + 4) // 5, d

    def spare(self, s: np.ndarray) -> tuple[int, int]:
        """Tiles that the set can do without among those of its band and the next, by the evenness of the band's number.

        Two sets share p - d parts or more; those where both are empty are no tiles. One less than what is left can go.
        """
        out = [0, 0]
        if len(s):
            b = self.band(len(s))
            for at in (b, b + 1) if self._reaches(len(s), b) else (b,):
                p, d = self.parts(at)
                empty = p - len(np.unique(self._part(s, p)))
                out[at & 1] = max(0, p - d - 1 - empty)
        return out[0], out[1]

    def _reaches(self, n: int, b: int) -> bool:
        """Whether a set of the next band may be similar enough."""
        self.band(self.low[b + 1])
        return n * 100 // self.percent >= self.low[b + 1]

    @staticmethod
    def _part(s: np.ndarray, p: int) -> np.ndarray:
        # the upper half of a hash picks its part; s is sorted, so parts are runs
        return ((s >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)

    def _keys(self, s: np.ndarray, b: int) -> np.ndarray:
        p, d = self.parts(b)
        part = self._part(s, p)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums = np.add.reduceat(_mix(s + _STEP), starts)
        ids = part[starts]
        # as many empty parts as the set can spare are left out; with more of them, the first ones are tiles too
        if (more := p - len(starts) - (p - d - 1)) > 0:
            empty = np.setdiff1d(np.arange(p, dtype=np.uint64), ids, assume_unique=True)[:more]
            sums, ids = np.r_[sums, np.zeros(more, np.uint64)], np.r_[ids, empty]
        # the last bit says whether the band's number is odd
        return _mix(sums + _mix(ids + (np.uint64(b) << np.uint64(40)) + _STEP)) & ~np.uint64(1) | np.uint64(b & 1)


def _width(n: int, low: list[int], b: int) -> int:
    """Bits of a bitmap: a power of two, at least four for each shingle of the band's largest set."""
    return 1 << max(6, (4 * low[b + 1] - 1).bit_length())


def bitmap(s: np.ndarray, bits: int) -> bytes:
    flags = np.zeros(bits, np.uint8)
    flags[(s & np.uint64(bits - 1)).astype(np.intp)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (rows of 64-bit words) as one of fewer bits: a bit's place is taken modulo the width, so halves are put together."""
    return np.bitwise_or.reduce(x.reshape(*x.shape[:-1], -1, words), axis=-2)


def most_common(n: np.ndarray, bits: np.ndarray, n_one: int, one: np.ndarray) -> np.ndarray:
    """The most shingles that sets (n, rows of bits) can have in common with one set.

    Each bit that only one side has stands for a shingle that the other lacks.
    """
    words = min(bits.shape[-1], one.shape[-1])
    x, y = _folded(bits, words), _folded(one, words)
    return np.minimum(n - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), n_one - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _meta(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, h, bits, drop0, drop1) of each row: size, hash and bitmap of its set, and how many of its commonest tiles it can do without in bands of even and odd number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bands = _WordHashes(), Bands(percent)
        for batch in batches:
            n, h, bits, drops = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, k, seen)
                n.append(len(s))
                h.append(xxhash.xxh3_128_digest(s.tobytes()))
                b = bands.band(max(1, len(s)))
                bits.append(bitmap(s, _width(len(s), bands.low, b)))
                drops.append(bands.spare(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(bits, pa.binary()), *(pa.array([x[g] for x in drops], pa.int32()) for g in (0, 1))], ["id", "n", "h", "bits", "drop0", "drop1"])

    return docs.mapInArrow(run, "id long, n long, h binary, bits binary, drop0 int, drop1 int")


#: Hashes of sets that a task remembers, to give equal sets' tiles once.
REMEMBERED = 200_000


def _tiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(tile, id): sets with no shingle are in none. Of equal sets in a task the first alone gives tiles; classes by hash hold the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bands, given = _WordHashes(), Bands(percent), set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, keys = [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingles(text, k, seen)
                    if i is None or not len(s):
                        continue
                    if (h := xxhash.xxh3_128_digest(s.tobytes())) in given:
                        continue
                    if len(given) >= REMEMBERED:
                        given.clear()
                    given.add(h)
                    keys.append(bands.tiles(s))
                    ids.append(np.full(len(keys[-1]), i, np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], ["tile", "id"])

    return docs.mapInArrow(run, "tile long, id long")


def _kept_tiles(docs: DataFrame, meta: DataFrame, k: int, percent: int) -> DataFrame:
    """(tile, id, known): tiles with two members or more, less those that a set can do without, the commonest first.

    Sets that may link share a known number of tiles, so of each set's tiles, in one order for all sets (rare ones first),
    the last that many but one can go. What many documents share, such as a common passage, goes so.
    """
    live = _tiles(docs, k, percent).withColumn("freq", F.count(F.lit(1)).over(Window.partitionBy("tile"))).where("freq > 1")
    own = Window.partitionBy("id")
    commonest = Window.partitionBy("id", "g").orderBy(F.desc("freq"), "tile")
    d = live.withColumn("known", F.count(F.lit(1)).over(own)).withColumn("g", F.expr("tile & 1")).withColumn("place", F.row_number().over(commonest))
    drops = meta.where("n > 0").groupBy("id").agg(F.min("drop0").alias("drop0"), F.min("drop1").alias("drop1"))
    return d.join(drops, "id").where("place > if(g = 0, drop0, drop1)").select("tile", "id", "known")


def _dealt_by_centre(pairs: DataFrame) -> DataFrame:
    """pairs (id, m, …) with `salt`: a centre with very many members has several groups."""
    parts = hot_keys(pairs, "m")
    d = pairs.join(F.broadcast(parts), "m", "left")
    return d.withColumn("salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts"))).cast("int")).drop("parts")


def _streamed(rows: DataFrame, columns: list[str], against, out: str) -> DataFrame:
    """Groups (m, salt), each its centre's rows first (first = 0) and then its members', one after another: against(centre rows, member row) gives an output row or None."""
    names = [x.split()[0] for x in out.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, []
        for batch in batches:
            found = []
            for m, salt, first, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (m, salt) != key:
                    key, centre = (m, salt), []
                if first == 0:
                    centre.append(against(None, m, rest))
                elif (x := against(centre, m, rest)) is not None:
                    found.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], names)

    dealt = rows.repartition("m", "salt").sortWithinPartitions("m", "salt", "first")
    return dealt.select("m", "salt", "first", *columns).mapInArrow(run, out)


def _bounded(spokes: DataFrame, some: DataFrame, percent: int) -> DataFrame:
    """Pairs (id, m, shared) that sizes and bitmaps leave; `sure` where the sets are the same."""
    d = _dealt_by_centre(spokes)
    members = d.join(some, "id").select("m", "salt", F.lit(1).alias("first"), "id", "n", "h", "bits", "shared")
    centres = d.select("m", "salt").distinct().join(some.withColumnRenamed("id", "m"), "m").select("m", "salt", F.lit(0).alias("first"), F.col("m").alias("id"), "n", "h", "bits", F.lit(0).cast("long").alias("shared"))

    def against(centre, m, row):
        i, n, h, bits, shared = row
        bits = np.frombuffer(bits, np.uint64)
        if centre is None:
            return n, h, bits
        left = [c for c in centre if 100 * min(n, c[0]) >= percent * max(n, c[0]) and 100 * (x := int(most_common(np.int64(n), bits, c[0], c[2]))) >= percent * (n + c[0] - x)]
        return (i, m, shared, any(c[1] == h for c in left)) if left else None

    return _streamed(members.union(centres), ["id", "n", "h", "bits", "shared"], against, "id long, m long, shared long, sure boolean")


def _linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of (id, m) whose texts link. A text goes once to each of its centre's groups, or to its own centre's."""
    d = written(_dealt_by_centre(pairs.select("id", "m")), "jac-pairs")
    roles = d.select("id", "m", "salt", F.lit(1).alias("first")).union(d.select("m", "m", "salt", F.lit(0)).distinct())
    roles = written(roles, "jac-roles")
    seen = _WordHashes()

    def against(centre, m, row):
        s = shingles(row[1], k, seen)
        if centre is None:
            return s
        for c in centre:
            common = len(np.intersect1d(s, c, assume_unique=True))
            if 100 * common >= percent * (len(s) + len(c) - common):
                return row[0], m
        return None

    links = written(_streamed(docs.join(small(roles), "id"), ["id", "text"], against, "a long, b long"), "jac-links")
    drop_written(d, roles)
    return links


#: Sets of a block, and bytes of text that they hold together.
BLOCK_ROWS, BLOCK_TEXT = 2048, 24 << 20


def _blocks(rows: DataFrame, columns: list[str], compared, names: str) -> DataFrame:
    """What compared(rows, lo, hi) gives of each (group, lo, hi), as rows of `names` (longs); rows are (own, *columns)."""
    heads = names.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def give() -> pa.RecordBatch:
            found = compared(held, *key[1:]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(len(heads))], heads)

        for batch in batches:
            for group, lo, hi, *rest in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (group, lo, hi) != key:
                    if key:
                        yield give()
                    key, held = (group, lo, hi), []
                held.append(tuple(rest))
        if key:
            yield give()

    dealt = rows.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "id")
    return dealt.select("group", "lo", "hi", "own", *columns).mapInArrow(run, ", ".join(f"{x} long" for x in heads))


def _partners(bits: list[bytes], n: np.ndarray, label: np.ndarray, own: np.ndarray, lo: int, hi: int, percent: int):
    """A function that gives, for row i, the rows of block hi (after i, if it is the block's own) with another label that sizes and bitmaps leave."""
    widths, stacks = np.array([len(x) for x in bits]), []
    for w in np.unique(widths).tolist():
        at = np.flatnonzero((widths == w) & ((own == hi) | (lo == hi)))
        stacks.append((at, np.frombuffer(b"".join(bits[x] for x in at.tolist()), np.uint64).reshape(len(at), -1 if len(at) else w // 8)))

    def partners(i: int) -> list[int]:
        one, out = np.frombuffer(bits[i], np.uint64), []
        for at, stack in stacks:
            ok = (label[at] != label[i]) & (100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i]))
            if lo == hi:
                ok &= at > i
            if ok.any():
                j = at[ok]
                most = most_common(n[j], stack[ok], int(n[i]), one)
                out += j[100 * most >= percent * (n[j] + n[i] - most)].tolist()
        return out

    return partners


def _possible(members: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """(a, b): edges that connect whatever sizes and bitmaps leave of pairs in one group but different components.

    members: (group, id, c, n, bits). Rows of a group's largest component aren't held against each other; the others are held
    against all. A block pair gives no more edges than it has rows, however many pairs are possible.
    """
    counts = members.groupBy("group", "c").agg(F.count(F.lit(1)).alias("rows"))
    sizes = counts.groupBy("group").agg(F.max(F.struct("rows", "c")).alias("top"), F.sum("rows").alias("all"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    blocks = lambda x: f"cast(ceil({x} / {block_rows}) as int)"
    sizes = sizes.select("group", F.col("top.c").alias("major"), F.expr(blocks("(all - top.rows)")).alias("p"), F.expr(blocks("top.rows")).alias("q"))
    d = spread_join(members, written(sizes, "jac-open"), "group", "id", "inner")
    at = F.xxhash64("id", F.lit(9))
    d = d.withColumn("own", F.when(F.col("c") == F.col("major"), F.col("p") + F.pmod(at, F.col("q"))).otherwise(F.pmod(at, F.col("p"))).cast("int"))
    d = d.withColumn("other", F.explode(F.expr("sequence(0, if(own < p, p + q, p) - 1)")))
    d = d.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def compared(rows: list[tuple], lo: int, hi: int) -> list[tuple[int, int]]:
        own, ids, label, n = (np.array([r[i] for r in rows]) for i in range(4))
        parent = list(range(len(rows)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        partners = _partners([r[4] for r in rows], n, label, own, lo, hi, percent)
        out = []
        for i in range(len(rows)) if lo == hi else np.flatnonzero(own == lo).tolist():
            for j in partners(i):
                x, y = find(i), find(j)
                if x != y:
                    parent[x] = y
                    out.append((int(ids[i]), int(ids[j])))
        return out

    return _blocks(d, ["id", "c", "n", "bits"], compared, "a, b")


def _among(groups: DataFrame, docs: DataFrame, k: int, percent: int, block_rows: int) -> DataFrame:
    """Links (a, b) between members of a group in different components, one for each two components that a block joins; groups: (group, id, c).

    A task holds the texts of two blocks of one group and intersects the sets of what bitmaps leave; only links are given out.
    """
    rows = docs.join(small(groups), "id").where("text is not null")
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.sum(text_bytes(F.col("text"))).alias("bytes"))
    sizes = written(sizes.select("group", F.expr(f"cast(greatest(1, ceil(rows / {block_rows}), ceil(bytes / {BLOCK_TEXT})) as int)").alias("p")), "jac-sizes")
    d = spread_join(rows, sizes, "group", "id", "inner", count_rows=groups).withColumn("own", F.pmod(F.xxhash64("id", F.lit(9)), F.col("p")).cast("int"))
    d = d.withColumn("other", F.explode(F.expr("sequence(0, p - 1)"))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    seen = _WordHashes()

    def compared(rows: list[tuple], lo: int, hi: int) -> list[tuple[int, int]]:
        own, ids, label = (np.array([r[i] for r in rows]) for i in range(3))
        sets = [shingles(r[3], k, seen) for r in rows]
        n = np.array([len(s) for s in sets])
        out = []
        bits = [bitmap(s, 1 << max(6, (4 * len(s)).bit_length())) for s in sets]
        partners = _partners(bits, n, label, own, lo, hi, percent)
        for i in range(len(rows)) if lo == hi else np.flatnonzero(own == lo).tolist():
            for j in partners(i):
                if label[j] != label[i]:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= percent * (n[i] + n[j] - common):
                        out.append((int(ids[i]), int(ids[j])))
                        label[label == label[j]] = label[i]
        return out

    return _blocks(d, ["id", "c", "text"], compared, "a, b")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: links join texts whose shingle sets are at least percent/100 similar.

    component_id is the smallest id reachable by links, itself included. Null, empty and blank texts have no shingle and no
    link. Every row is returned; rows of one id are one vertex, which links if one of their texts does. A null id links with
    nothing and has a null component. An empty table gives an empty result. Other columns aren't read. Whole texts
    are processed, and no cap is set on tiles or partners.
    """
    d = _documents(docs, id_col, text_col)
    meta = written(_meta(d, k, percent), "jac-meta")
    named = meta.where("id is not null and n > 0")
    kept = written(_kept_tiles(d, named, k, percent), "jac-tiles")
    # a tile's centre is the member that shares the most tiles: of edited copies that is the original, or nearest to it
    best = Window.partitionBy("tile").orderBy(F.desc("known"), "id").rowsBetween(Window.unboundedPreceding, 0)
    spokes = kept.select("id", F.first("id").over(best).alias("m")).groupBy("id", "m").agg(F.count(F.lit(1)).alias("shared")).where("id <> m")
    spokes = written(spokes, "jac-spokes")
    ids = spokes.select("id").union(spokes.select("m")).distinct()
    some = written(named.select("id", "n", "h", "bits").join(ids, "id", "left_semi").distinct(), "jac-some")
    near = written(_bounded(spokes, some, percent), "jac-near")
    # each set goes to one centre first, the one with which it shares most
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sure"), F.desc("shared"), "m"))).where("place = 1")
    links = _linked(first.where("not sure"), d, k, percent).union(near.where("sure").select("id", "m"))
    links = written(links.union(some.select("id", F.min("id").over(Window.partitionBy("h")).alias("m")).where("id <> m")), "jac-links")
    component = written(connected_components(links), "jac-comp")
    # two sets that share a tile share its centre: groups by centre hold every pair that may link
    label = some.join(component, "id", "left").select("id", "n", "bits", F.coalesce("component", "id").alias("c"))
    members = spokes.select(F.col("m").alias("group"), "id").union(spokes.select("m", "m").distinct()).join(label, "id")
    possible = written(_possible(written(members, "jac-members"), percent, block_rows), "jac-possible")
    if not possible.isEmpty():
        groups = connected_components(possible).withColumnRenamed("component", "group").join(label.select("id", "c").distinct(), "id")
        more = written(_among(written(groups, "jac-groups"), d, k, percent, block_rows), "jac-more")
        component = written(connected_components(links.union(more)), "jac-comp")
    # classes of equal sets, of which tiles hold a few members, take the component of those
    classes = named.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"))
    of_hash = some.select("id", "h").join(component, "id").select("h", "component").distinct()
    classes = written(classes.join(of_hash, "h", "left").where("members > 1 or component is not null"), "jac-classes")
    least = classes.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    names = written(classes.join(least, "component", "left").groupBy("h").agg(F.min(F.coalesce("least", "rep")).alias("component_id")), "jac-names")
    drop_written(kept, spokes, near, some, links, component, possible, classes)
    out = spread_join(named.select("id", "n", "h"), names, "h", "id", "left").select("id", "n", F.coalesce("component_id", "id").alias("c"))
    out = out.union(meta.where("id is null or n = 0").select("id", "n", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """Rows of docs, all their columns, without those in a component with a smaller id. Rows of one id go or stay together; those with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    components = jaccard_components(docs, k, percent, **options)
    gone = components.where("component_id < doc_id").select(F.col("doc_id").alias("__tl_gone")).distinct()
    gone = written(gone, "jac-gone")
    drop_written(components)
    return docs.join(small(gone), F.col(id_col) == F.col("__tl_gone"), "left_anti")
