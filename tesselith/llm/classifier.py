"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics come from the text alone. Their standardised values go through random Fourier features, which stand for a
Gaussian kernel; each partition sums its part of the normal equations, and the sums (fixed in size by the number of
features) give the ridge weights. Scores of other labelled rows, counted in bins, give an isotonic calibration.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm.common import small, written

FEATURES, RIDGE, BANDWIDTH, BINS, SEED, THRESHOLD = 256, 1e-3, 4.0, 2048, 7, 0.7
STATS = [
    "log_words", "log_chars", "mean_word", "sd_word", "max_word", "distinct_words", "distinct_pairs", "top_word", "top_pair",
    "dup_lines", "words_per_line", "short_lines", "upper", "digit", "space", "stop_marks", "commas", "symbols", "pipes", "bangs",
    "other_marks", "high_bytes", "entropy", "compressed", "capital_words", "marked_words", "adjacent_same", "url_like",
]
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", b".?:;", b",", b"#*$%&<>", b"|", b"!", b"()[]{}\"'/\\@_-+=~^`"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 10


def statistics(text: str | None) -> list[float]:
    """The STATS of a text; of null, an empty or a blank text all that have no meaning are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATS)
    n, size = len(words), len(raw)
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.float64, n)
    octets = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=octets, minlength=11) / size
    p = octets[octets > 0] / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spans = [len(x.split()) for x in lines]
    return [
        np.log1p(n), np.log1p(size), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(seen) / n, len(pairs) / max(1, n - 1),
        max(seen.values()) / n, max(pairs.values(), default=0) / max(1, n - 1), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum(x < 4 for x in spans) / len(spans), *kinds[[1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], float(-(p * np.log2(p)).sum()),
        len(zlib.compress(raw, 1)) / size, sum(w[:1].isupper() for w in words) / n, sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(b"://" in w or b"www." in w for w in words) / n,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


class Model:
    """A fitted classifier: small arrays, the same size whatever the corpus."""

    def __init__(self, mean, scale, waves, phases, weights=None, knots=None):
        self.mean, self.scale, self.waves, self.phases, self.weights, self.knots = mean, scale, waves, phases, weights, knots

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, with the standardised statistics and a constant beside them."""
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.waves + self.phases)
        return np.hstack([z, x * 0.05, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lifted(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated, from 0 to 1."""
        return np.interp(self.raw(stats), *self.knots)


def isotonic(values: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order of value: knots of a rising line through the pools' centres.

    Each pool's share of positives is drawn a little to the overall share, so no score is exactly 0 or 1.
    """
    prior = (positive.sum() + 1) / (total.sum() + 2)
    pools: list[list[float]] = []  # positives, rows, sum of values
    for v, p, t in zip(values, positive, total, strict=True):
        pools.append([p + 0.0, t + 0.0, v * t])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    if not pools:
        return np.array([0.0, 1.0]), np.array([0.5, 0.5])
    x = np.array([s / n for _, n, s in pools])
    y = np.array([(p + prior) / (n + 1) for p, n, _ in pools])
    # a slight slope outside the outer pools keeps the order of scores
    x = np.r_[x[0] - 2, x, x[-1] + 2]
    return x, np.maximum.accumulate(np.r_[y[0] * 0.9, y, y[-1] + 0.1 * (1 - y[-1])])


def _summed(rows: DataFrame, run, names: int) -> dict[int, np.ndarray]:
    """Sums of the arrays (i, values) that partitions emit, by i: `names` rows reach the driver. Arrays are added whole, a row a partition: none is taken apart into rows."""

    def total(group: pa.Table) -> pa.Table:
        x = group.column("x").combine_chunks()
        return pa.table({"i": group.column("i").slice(0, 1), "x": pa.array([x.flatten().to_numpy().reshape(len(x), -1).sum(0)], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(run, "i int, x array<double>").groupBy("i").applyInArrow(total, "i int, x array<double>")
    return {r["i"]: np.array(r["x"]) for r in sums.limit(names).collect()}


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    stats = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, len(STATS))
    return stats, batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE, bandwidth: float = BANDWIDTH, seed: int = SEED) -> Model:
    """rows: (stats, y, part) of labelled documents; part 0 fits the weights, part 1 the calibration.

    The classes count alike in the fit. With a class missing every score is the share of the other.
    """
    width = len(STATS)

    def moments(batches):
        total = np.zeros((3, width))
        for b in batches:
            s, y = _arrays(b)
            total += [np.full(width, len(s)), s.sum(0), (s * s).sum(0)]
            counts[0] += len(s)
            counts[1] += y.sum()
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3], pa.int32()), pa.array([*total.tolist(), [float(c) for c in counts]], pa.list_(pa.float64()))], ["i", "x"])

    counts = [0.0, 0.0]
    train = rows.where("part = 0").select("stats", "y")
    got = _summed(train, moments, 4)
    rng = np.random.default_rng(seed)
    if not got or got[3][0] == 0:
        n, mean, var, pos = 0, np.zeros(width), np.ones(width), 0.0
    else:
        n, pos = got[3][0], got[3][1]
        mean = got[1] / n
        var = np.maximum(got[2] / n - mean**2, 0)
    model = Model(mean, np.sqrt(var) + 1e-6, rng.normal(size=(width, features)) / bandwidth, rng.uniform(0, 2 * np.pi, features))
    size = features + width + 1
    if n == 0 or pos in (0, n):
        model.weights = np.zeros(size)
        model.knots = (np.array([0.0, 1.0]), np.full(2, (pos + 1) / (n + 2)))
        return model
    weight = {1: 0.5 / pos, 0: 0.5 / (n - pos)}

    def normal(batches):
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            s, y = _arrays(batch)
            for lo in range(0, len(s), 4096):
                z, t = model.lifted(s[lo : lo + 4096]), y[lo : lo + 4096]
                w = np.where(t == 1, weight[1], weight[0])
                a += (z * w[:, None]).T @ z
                b += z.T @ (w * t)
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array([*a.tolist(), b.tolist()], pa.list_(pa.float64()))], ["i", "x"])

    eq = _summed(train, normal, size + 1)
    a = np.stack([eq[i] for i in range(size)])
    model.weights = np.linalg.solve(a + ridge * np.eye(size), eq[size])

    def binned(batches):
        # positives, rows and values of each bin of the raw score
        total = np.zeros((3, BINS))
        for batch in batches:
            s, y = _arrays(batch)
            r = model.raw(s)
            at = np.clip(((r + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            total += [np.bincount(at, weights=w, minlength=BINS) for w in (y, np.ones(len(y)), r)]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "x"])

    got = _summed(rows.where("part = 1").select("stats", "y"), binned, 3)
    some = got[1] > 0 if got else np.zeros(0, bool)
    model.knots = isotonic(got[2][some] / got[1][some], got[0][some], got[1][some]) if some.any() else (np.array([-0.5, 1.5]), np.array([0.0, 1.0]))
    return model


def remainder(id_col: str) -> F.Column:
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4).cast("int")


def scored_stats(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(model)  # a fixed size, by the number of features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(STATS))
            score = np.clip(held.value.score(s), 0, 1) if len(s) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double, predicted int")


def _labelled(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    known = known.withColumn("r", remainder("doc_id")).where("r <> 2")
    return stats.join(known, "doc_id").select("stats", "y", (F.col("r") == 3).cast("int").alias("part"))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs.

    Labels of rows whose crc32(doc_id as text) mod 4 is 2 are never read; of the others 0 and 1 fit the weights and 3 the
    calibration, all of them. Labels other than 0 and 1, null ids and ids with both labels don't count; a label that is repeated counts once. Null and
    empty texts are scored as texts without words. Statistics are written once, so texts are read once. Without rows
    the result is empty; without labels every score is 0.5. Only the named columns are read.
    """
    stats = written(with_statistics(docs, id_col, text_col), "qc-stats")
    model = fit(written(_labelled(stats, labels, id_col, label_col), "qc-train"))
    out = scored_stats(stats, model, threshold)
    return out.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "score", "predicted")


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all their columns, scored at the threshold or more, as scored() scores them. Only labelled rows are joined; texts are shuffled only if the labels are too many to send.

    Null and empty texts are scored as texts without words, null ids count for no label and stay or go by their text, equal rows stay or go together, and an empty table gives an empty result. Columns may have any names.
    """
    known = written(labels.select(F.col(id_col).alias("__tl_id")).distinct(), "qc-labelled")
    some = docs.join(small(known), F.col(id_col) == F.col("__tl_id"), "left_semi").select(id_col, text_col)
    stats = with_statistics(some, id_col, text_col)
    model = fit(written(_labelled(stats, labels, id_col, label_col), "qc-train"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([statistics(t) for t in batch.column(at).to_pylist()], np.float64).reshape(-1, len(STATS))
            yield batch.filter(pa.array(held.value.score(s) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
