"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Frequent words are classes of their own, other words share hashed classes, and both kinds grow with the number of distinct
words; a word's probability is that of its class in context times its share of the class. The share is the word's own count
in the whole corpus over the class's: tasks hold the counts of frequent words, those of the others are joined. The network reads the classes of SIDE words on
either side: embeddings, a tanh layer and a softmax of two levels, groups of classes and classes in their group, so a window's cost
grows with the square root of the classes. It is trained in numpy on shards of texts, whose number and order follow the
corpus and not the cluster: each shard starts from the common weights and trains on every window of its texts, and the weights are
averaged by tokens; each round takes another part of the texts. Sums of conditional log-probabilities score documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm.common import written

#: Own classes and hashed classes, at least; own classes a cube root of the distinct words; the count from which a word may be own.
TOP, TAIL, PER_ROOT, MIN_COUNT = 384, 128, 5.0, 2
#: Words besides whose counts tasks hold; the counts of rarer ones are joined.
KNOWN = 1 << 17
#: Ranges of counts for each doubling, among which the most frequent words are found.
STEPS = 8
CLASSES = TOP + TAIL
PAD = CLASSES
SIDE, EMBED, HIDDEN = 2, 16, 32
#: ROUNDS of averaging, each over its part of the texts; words of a shard, about; windows of a step.
ROUNDS, SHARD_WORDS, BATCH, RATE, SEED = 2, 3_000_000, 4096, 0.02, 11
#: Digits after the point of a text's log-probability: what the order of a double sum leaves equal.
DIGITS = 6
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _groups(classes: int) -> tuple[int, int]:
    """Groups, and classes of a group."""
    size = math.ceil(math.sqrt(classes))
    return -(-classes // size), size


def _shapes(classes: int) -> list[tuple[str, tuple[int, ...]]]:
    g, size = _groups(classes)
    return [("e", (classes + 1, EMBED)), ("w", (2 * SIDE, EMBED, HIDDEN)), ("b", (HIDDEN,)), ("u", (HIDDEN, g)), ("a", (g,)), ("v", (g, HIDDEN, size)), ("c", (g, size))]


def class_numbers(distinct: int) -> tuple[int, int]:
    """Own classes and hashed classes for so many distinct words."""
    top = max(TOP, math.ceil(PER_ROOT * distinct ** (1 / 3)))
    return top, max(TAIL, top * TAIL // TOP)


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, apart at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words() of each text, all in one binary array, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    keep = pc.not_equal(flat, "")  # white space at an end leaves an empty part
    before = np.r_[0, np.cumsum(keep.to_numpy(zero_copy_only=False))]
    counts = np.diff(np.r_[0, before[ends]]) if len(ends) else np.zeros(0, np.int64)
    return (flat if before[-1] == len(flat) else flat.filter(keep)).cast(pa.binary()), counts


#: Texts that are split together.
SPLIT = 1000


class Vocabulary:
    """Codes of words, and by code the class and the log of the word's share of its class.

    A code is the class of an own word, then the places of words whose counts are held, then hashed classes of all others. A word without a
    count stands for one more occurrence in its class, so shares of a class sum to one with it.
    Unless `complete`, words that are not held may have counts: their share is that of a word seen once, and scores() joins the rest.
    """

    def __init__(self, own: list[bytes], known: list[tuple[bytes, int]], totals: dict[int, int], top: int = TOP, tail: int = TAIL, complete: bool = True, n_words: int = 0):
        self.n_words, self.top, self.tail, self.n_classes, self.complete = n_words, top, tail, top + tail, complete
        self.own, self.held = own, [*own, *(w for w, _ in known)]
        self.code_of = np.concatenate([np.arange(len(own)), self.n_classes + np.arange(len(known))]).astype(np.int64)
        self.first_rare = self.n_classes + len(known)
        n = np.ones(tail)
        for t, c in totals.items():
            n[t] += c
        of_known = np.array([zlib.crc32(w) % tail for w, _ in known], np.int64)
        kind = np.int16 if self.n_classes < 1 << 15 else np.int32
        self.class_of = np.concatenate([np.arange(self.n_classes), top + of_known, top + np.arange(tail)]).astype(kind)
        self.share_of = np.concatenate([np.zeros(self.n_classes), np.log(np.array([c for _, c in known], np.float64)) - np.log(n[of_known]), -np.log(n)]).astype(np.float32)

    def codes(self, ws: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words, and which of them are rare (not held)."""
        found = pc.index_in(ws, pa.array(self.held, pa.binary()))
        rare = found.is_null().to_numpy(zero_copy_only=False)
        codes = self.code_of.take(pc.fill_null(found, 0).to_numpy(zero_copy_only=False)) if len(self.held) else np.zeros(len(ws), np.int64)
        if rare.any():
            codes[rare] = [self.first_rare + zlib.crc32(w) % self.tail for w in ws.filter(pa.array(rare)).to_pylist()]
        return codes, rare

    def encode(self, text: str | None) -> np.ndarray:
        return self.codes(split_words(pa.array([text], pa.string()))[0])[0]

    def classes(self, codes: np.ndarray) -> np.ndarray:
        return self.class_of.take(codes)

    def shares(self, codes: np.ndarray) -> np.ndarray:
        return self.share_of.take(codes)


def word_counts(docs: DataFrame, text_col: str = "text", most: int = 4_000_000) -> DataFrame:
    """(word, n) over all texts; tasks count first, `most` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            c = pc.value_counts(pa.chunked_array(held, pa.binary()))
            return pa.RecordBatch.from_arrays([c.field(0), c.field(1)], ["word", "n"])

        for batch in batches:
            for lo in range(0, batch.num_rows, SPLIT):
                held.append(split_words(batch.column(0).slice(lo, SPLIT))[0])
                size += len(held[-1])
                if size >= most:
                    yield out()
                    held, size = [], 0
        yield out()

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """The most frequent words with their counts, `known` and the own ones at most, and a sum for each hashed class reach the driver. Ties between own words go to the one that sorts first."""
    size = counts.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    distinct = size["distinct"]
    top, tail = class_numbers(distinct)
    # how many words lie in each of at most 64 * STEPS ranges of counts; the ranges from the top that hold `known` words or fewer are collected
    level = F.floor(F.log2(F.col("n").cast("double")) * STEPS).cast("int")
    sizes, held, least = {r["level"]: r["words"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()}, 0, None
    for at in sorted(sizes, reverse=True):
        if held + sizes[at] > known:
            break
        held, least = held + sizes[at], at
    most = [] if least is None else [(bytes(r["word"]), r["n"]) for r in counts.where(level >= least).collect()]
    # own words may be more than those: the class numbers' worth of rows
    most += [(bytes(r["word"]), r["n"]) for r in counts.where(level < least if least is not None else F.lit(True)).orderBy(F.desc("n"), "word").limit(max(0, top - held)).collect()] if held < min(top, distinct) else []
    most.sort(key=lambda x: (-x[1], x[0]))
    own = [w for w, n in most[:top] if n >= MIN_COUNT]
    totals = {int(r["t"]): r["n"] for r in counts.groupBy((F.crc32("word") % tail).alias("t")).agg(F.sum("n").alias("n")).collect()}
    for w, n in most[: len(own)]:
        totals[zlib.crc32(w) % tail] -= n
    return Vocabulary(own, most[len(own) :], totals, top, tail, distinct <= len(most), size["words"])


def _softmax(z: np.ndarray, bounded: bool) -> np.ndarray:
    """In place; logits that are known to be small need no maximum taken away."""
    if not bounded:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]
    return z


def _log_sum(z: np.ndarray, bounded: bool) -> np.ndarray:
    top = 0 if bounded else z.max(1, keepdims=True)
    e = np.exp(z - top) if not bounded else np.exp(z)
    return np.log(e @ np.ones(z.shape[1], z.dtype)) + (0 if bounded else top[:, 0])


class Network:
    def __init__(self, flat: np.ndarray | None = None, classes: int = CLASSES):
        self.classes, shapes = classes, _shapes(classes)
        self.n_groups, self.size = _groups(classes)
        #: classes that the last group really has
        self.last = classes - (self.n_groups - 1) * self.size
        if flat is None:
            rng = np.random.default_rng(SEED)
            parts = [rng.normal(size=s) * (0.3 if k == "e" else 0 if k in "abc" else 1 / math.sqrt(2 * SIDE * EMBED if k == "w" else HIDDEN)) for k, s in shapes]
            flat = np.concatenate([p.ravel() for p in parts])
        self.flat = flat.astype(np.float32)
        at = 0
        for k, s in shapes:
            n = math.prod(s)
            setattr(self, k, self.flat[at : at + n].reshape(s))
            at += n
        self.tables = None  # made at the first use in scoring

    def _bounded(self) -> bool:
        """Whether no logit can be large: hidden units lie between -1 and 1. exp is safe below 80."""
        return float(max(np.abs(self.u).sum(0).max() + np.abs(self.a).max(), np.abs(self.v).sum(1).max() + np.abs(self.c).max())) < 60

    def _slices(self, group: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(group, from, to, its classes) of rows sorted by group."""
        cuts = np.searchsorted(group, np.arange(self.n_groups + 1)).tolist()
        return [(g, lo, hi, self.last if g == self.n_groups - 1 else self.size) for g, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if lo < hi]

    def log_probs(self, ctx: np.ndarray, target: np.ndarray, step: int = 8192) -> np.ndarray:
        """log p(class | both sides) of each target. ctx: (n, 2 * SIDE) classes, PAD outside the text.

        Position-wise tables stand for embedding and first layer; targets of one group are taken together. In double precision: products of
        matrices of other shapes round in other places, and a window's value must not depend on the windows beside it.
        """
        if self.tables is None:
            e, w, b, u, a, v, c = (x.astype(np.float64) for x in (self.e, self.w, self.b, self.u, self.a, self.v, self.c))
            self.tables, self.safe, self.double = np.matmul(e, w) + b / (2 * SIDE), self._bounded(), (u, a, v, c)
        out, (u, a, v, c) = np.empty(len(target)), self.double
        for lo in range(0, len(target), step):
            x, t = ctx[lo : lo + step], target[lo : lo + step]
            group = (t // self.size).astype(np.int16)
            order = np.argsort(group, kind="stable")
            x, t, group = x[order], t[order], group[order]
            h = self.tables[0].take(x[:, 0], 0)
            for p in range(1, 2 * SIDE):
                h += self.tables[p].take(x[:, p], 0)
            np.tanh(h, out=h)
            z = h @ u + a
            each = z[np.arange(len(t)), group] - _log_sum(z, self.safe)
            for g, first, last, m in self._slices(group):
                z = h[first:last] @ v[g, :, :m] + c[g, :m]
                each[first:last] += z[np.arange(last - first), t[first:last] - g * self.size] - _log_sum(z, self.safe)
            out[lo + order] = each
        return out

    def gradient(self, ctx: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the mean loss of a batch."""
        n = len(target)
        group = (target // self.size).astype(np.int16)
        order = np.argsort(group, kind="stable")
        ctx, target, group = ctx[order], target[order], group[order]
        flat = np.zeros_like(self.flat)
        d = Network.__new__(Network)
        at = 0
        for k, s in _shapes(self.classes):
            m = math.prod(s)
            setattr(d, k, flat[at : at + m].reshape(s))
            at += m
        safe = self._bounded()
        x = self.e.take(ctx.ravel(), 0).reshape(n, -1)
        w = self.w.reshape(-1, HIDDEN)
        h = np.tanh(x @ w + self.b)
        p, rows = _softmax(h @ self.u + self.a, safe), np.arange(n)
        loss = -float(np.log(p[rows, group] + 1e-12).sum())
        p[rows, group] -= 1
        d.u[:], d.a[:] = h.T @ p, p.sum(0)
        dh = p @ self.u.T
        for g, first, last, m in self._slices(group):
            own, t, k = h[first:last], target[first:last] - g * self.size, np.arange(last - first)
            p = _softmax(own @ self.v[g, :, :m] + self.c[g, :m], safe)
            loss -= float(np.log(p[k, t] + 1e-12).sum())
            p[k, t] -= 1
            d.v[g, :, :m], d.c[g, :m] = own.T @ p, p.sum(0)
            dh[first:last] += p @ self.v[g, :, :m].T
        dh *= 1 - h * h
        d.w[:], d.b[:] = (x.T @ dh).reshape(self.w.shape), dh.sum(0)
        # rows of one class are added up in a sorted run
        dx, place = (dh @ w.T).reshape(-1, EMBED), ctx.ravel()
        by_class = np.argsort(place, kind="stable")
        place = place[by_class]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        d.e[place[starts]] = np.add.reduceat(dx.take(by_class, 0), starts)
        flat /= n
        return flat, loss / n


def contexts(classes: np.ndarray, pad: int = PAD) -> np.ndarray:
    """(n, 2 * SIDE): the words before, nearest last, then those after, nearest first."""
    n = len(classes)
    padded = np.full(n + 2 * SIDE, pad, np.int16 if pad < 1 << 15 else np.int32)
    padded[SIDE : SIDE + n] = classes
    return np.stack([padded[i : i + n] for i in [*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)]], 1)


class _Adam:
    """Steps of a falling rate on the weights of a network, in place."""

    def __init__(self, model: Network, rate: float = RATE):
        self.model, self.rate, self.steps = model, rate, 0
        self.m, self.s, self.x = (np.zeros_like(model.flat) for _ in range(3))

    def step(self, g: np.ndarray) -> None:
        self.steps += 1
        self.m *= 0.9
        self.m += np.multiply(g, 0.1, out=self.x)
        self.s *= 0.99
        np.multiply(g, g, out=self.x)
        self.x *= 0.01
        self.s += self.x
        # bias corrections are of the rate
        rate = self.rate / math.sqrt(1 + self.steps / 50) * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        np.sqrt(self.s, out=self.x)
        self.x += 1e-8
        np.divide(self.m, self.x, out=self.x)
        self.x *= rate
        self.model.flat -= self.x


def shards(total: int, rounds: int = ROUNDS, shard_words: int = SHARD_WORDS) -> int:
    """Shards of a round over its part of so many words."""
    return max(1, math.ceil(total / rounds / shard_words))


def trained(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, shard_words: int = SHARD_WORDS) -> Network:
    """Local training with averaging: every window of every text trains in one of the rounds, so what is gathered follows the corpus.

    Texts are dealt to rounds, shards and places in them by a hash of id and text, as arrays of classes. The weights thus depend on the
    rows alone, up to the order of sums. Averages are summed in two levels of partitions before the driver adds what is left: arrays of one size.
    """
    spark = docs.sparkSession
    net = Network(classes=vocab.n_classes)
    words_of = spark.sparkContext.broadcast(vocab)  # own words and KNOWN counts
    n_shards = shards(vocab.n_words, rounds, shard_words)
    placed = docs.select(F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit(29)).alias("h"), F.col(text_col).alias("text"))
    small = vocab.class_of.dtype

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words_of.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SPLIT):
                part = batch.slice(lo, SPLIT)
                ws, n = split_words(part.column(1))
                data = v.classes(v.codes(ws)[0])
                ends = np.r_[0, np.cumsum(n) * data.itemsize].astype(np.int32)
                codes = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column(0), codes], ["h", "c"])

    for i in range(rounds):
        start = net.flat.copy()

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            model = Network(start, words_of.value.n_classes)
            by, windows, held = _Adam(model), 0, 0
            queue: list[tuple[np.ndarray, np.ndarray]] = []

            def learn(final: bool) -> None:
                nonlocal windows, queue, held
                ctx, target = (np.concatenate(z) for z in zip(*queue, strict=True))
                whole = len(target) if final else len(target) // BATCH * BATCH
                for lo in range(0, whole, BATCH):
                    by.step(model.gradient(ctx[lo : min(whole, lo + BATCH)], target[lo : min(whole, lo + BATCH)])[0])
                windows += whole
                queue, held = ([(ctx[whole:], target[whole:])], len(target) - whole) if whole < len(target) else ([], 0)

            for batch in batches:
                for text in batch.column(1):
                    if c := text.as_buffer().size:
                        c = np.frombuffer(text.as_buffer(), small)
                        queue.append((contexts(c, model.classes), c))
                        held += len(c)
                    if held >= 16 * BATCH:
                        learn(False)
            if queue:
                learn(True)
            if windows:
                yield pa.RecordBatch.from_arrays([pa.array([(model.flat.astype(np.float64) * windows).tobytes()], pa.binary()), pa.array([float(windows)])], ["x", "n"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(start)), 0.0
            for batch in batches:
                for x, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total += np.frombuffer(x)
                    n += k
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n])], ["x", "n"])

        sent = placed.where(F.pmod("h", F.lit(rounds)) == i).mapInArrow(encode, "h long, c binary").withColumn("g", F.expr(f"int(pmod(shiftright(h, 8), {n_shards}))"))
        by_id = getattr(sent, "repartitionById", None)
        dealt = by_id(n_shards, "g") if by_id else sent.repartition(n_shards, "g")
        parts = dealt.sortWithinPartitions("h", "c").select("h", "c").mapInArrow(run, "x binary, n double")
        for level in (math.ceil(n_shards**0.5), math.ceil(n_shards**0.25)):
            parts = parts.repartition(level).mapInArrow(summed, "x binary, n double")
        total, n = np.zeros(len(start)), 0.0
        for r in parts.collect():
            total, n = total + np.frombuffer(r["x"]), n + r["n"]
        net = Network((total / n) if n else start, vocab.n_classes)
    return net


def scores(docs: DataFrame, vocab: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """counts: (word, n) of all words, needed where the vocabulary doesn't hold them all."""
    if not vocab.complete and counts is None:
        raise ValueError("the vocabulary doesn't hold all counts: give them")
    both = docs.sparkSession.sparkContext.broadcast((vocab, net.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = both.value
        model, row = Network(flat, v.n_classes), TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo in range(0, batch.num_rows, SPLIT):
                part = batch.slice(lo, SPLIT)
                ws, n = split_words(part.column(1))
                codes, rare = v.codes(ws)
                sums = np.zeros(len(n))
                starts = np.r_[0, np.cumsum(n)]
                for first in range(0, len(n), 64):
                    k = n[first : first + 64]
                    own_codes = codes[starts[first] : starts[first] + k.sum()]
                    if not len(own_codes):
                        continue
                    # texts one after another with PAD between them
                    at = np.arange(len(own_codes)) + np.repeat(SIDE * (np.arange(len(k)) + 1), k)
                    padded = np.full(len(own_codes) + SIDE * (len(k) + 1), v.n_classes, v.class_of.dtype)
                    padded[at] = own = v.classes(own_codes)
                    ctx = np.stack([padded.take(at + i) for i in [*range(-SIDE, 0), *range(1, SIDE + 1)]], 1)
                    each = model.log_probs(ctx, own) + v.shares(own_codes)
                    some = np.flatnonzero(k)
                    sums[first + some] = np.add.reduceat(each, (starts[first : first + len(k)] - starts[first])[some])
                if v.complete:
                    rare = np.zeros(len(ws), bool)
                ends = np.r_[0, np.cumsum(rare)][starts].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), ws.filter(pa.array(rare)))
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(n)), pa.int64()), part.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), lists], ["row", "doc_id", "n_words", "log_prob", "words"])
                row += len(n)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = picked.mapInArrow(run, "row long, doc_id long, n_words long, log_prob double, words array<binary>")
    if not vocab.complete:
        d = written(d, "lm-scored")
        # words seen once or never have their share already
        each = d.selectExpr("row", "explode(words) as word").join(counts.where("n > 1"), "word")
        more = each.groupBy("row").agg(F.sum(F.log(F.col("n").cast("double"))).alias("more"))
        d = d.join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    d = d.withColumn("log_prob", F.round("log_prob", DIGITS))
    return d.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of each row: the pseudo-log-likelihood of the whole text.

    A null, empty or blank text has no words, log_prob 0 and a null mean. Equal rows are scored each, and train each.
    An empty table gives an empty result. Other columns aren't read.
    """
    counts = written(word_counts(docs, text_col), "lm-counts")
    vocab = vocabulary(counts)
    return scores(docs, vocab, trained(docs, vocab, id_col, text_col, **options), id_col, text_col, counts)
