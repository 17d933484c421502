"""Chunking of timed lines: by time, by sentence, by token count. A document's lines are an array in its row, so nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.functions import text as T

CHUNK = "doc_id long, chunk_index long, start_ds long, end_ds long, first_ord long, n_lines long, raw_text string"
_END = re.compile(r"[.!?。！？]\s*$")


#: Documents whose lines are Python objects at once, and characters of chunks that are kept back for a batch.
DOCS, CHARS = 64, 1 << 21


def _mapped(lines: DataFrame, cut) -> DataFrame:
    """cut: list of (start, end, text) -> list of (first, last + 1). Memory is a batch of Arrow, and a few documents and chunks: batches are read and written in parts."""
    names = [c.split()[0] for c in CHUNK.split(", ")]
    kinds = pa.schema([(n, pa.string() if n == "raw_text" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS):
                part = batch.slice(lo, DOCS)
                x = part.column(1).flatten()
                rows = list(zip(*(x.field(c).to_pylist() for c in ("start_ds", "end_ds", "text")), strict=True))
                at = 0
                for doc, n in zip(part.column(0).to_pylist(), pc.list_value_length(part.column(1)).to_pylist(), strict=True):
                    mine, at = rows[at : at + (n or 0)], at + (n or 0)
                    for i, (a, b) in enumerate(cut(mine)):
                        out.append((doc, i, mine[a][0], mine[b - 1][1], a, b - a, " ".join(r[2].strip() for r in mine[a:b]).strip()))
                        held += len(out[-1][-1])
                        if held > CHARS:
                            yield batch_of(out)
                            out, held = [], 0
            if out:
                yield batch_of(out)
                out, held = [], 0

    return lines.select(F.col("doc_id").cast("long").alias("doc_id"), "lines").mapInArrow(run, CHUNK)


def by_time(lines: DataFrame, window: float = 60, overlap: float = 15) -> DataFrame:
    """Windows of `window` seconds, each starting at a line: the first that starts window - overlap or more after the last window's."""
    if overlap >= window:
        raise ValueError("overlap must be less than window")
    width, step = int(window * 10), int((window - overlap) * 10)

    def cut(rows: list) -> list[tuple[int, int]]:
        i, out = 0, []
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] < rows[i][0] + width:
                j += 1
            out.append((i, j))
            nxt, first = rows[i][0] + step, i
            while i < len(rows) and rows[i][0] < nxt:
                i += 1
            i += i == first
        return out

    return _mapped(lines, cut)


def by_sentence(lines: DataFrame, max_chars: int = 1000) -> DataFrame:
    """Up to max_chars, cut after the last line that ends a sentence, else after all lines; what remains may be too long."""

    def cut(rows: list) -> list[tuple[int, int]]:
        out, first, size = [], 0, 0
        for i, (_, _, t) in enumerate(rows):
            t = t.strip()
            if size > 0 and size + len(t) > max_chars:
                at = next((k + 1 for k in range(i - 1, first - 1, -1) if _END.search(rows[k][2].strip())), i)
                out.append((first, at))
                first, size = at, sum(len(r[2].strip()) for r in rows[at:i])
            size += len(t)
        if rows:
            out.append((first, len(rows)))
        return out

    return _mapped(lines, cut)


def by_tokens(lines: DataFrame, token_count: int = 256, overlap_fraction: float = 0.25) -> DataFrame:
    """Windows of token_count latin tokens, stepping by the rest of the overlap; a chunk is all lines that a window touches.

    Built-in functions only, within the row: running token offsets by a fold, windows by a sequence.
    """
    step = max(1, token_count - max(0, int(token_count * overlap_fraction)))
    counted = F.transform("lines", lambda x: F.struct(F.size(T.latin_tokens(x["text"])).cast("long").alias("n"), x.alias("x")))
    d = lines.select("doc_id", counted.alias("c"))
    spans = F.zip_with("c", T.running_totals(F.transform("c", lambda x: x["n"])), lambda x, at: F.struct(at.alias("lo"), (at + x["n"]).alias("hi")))
    d = d.withColumn("o", spans).withColumn("total", F.expr("coalesce(get(o, size(o) - 1).hi, 0L)")).where("total > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - token_count) / float(step))).cast("long")
    d = d.select("doc_id", "c", "o", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    d = d.withColumn("pos", F.col("i") * step).withColumn("stop", F.least(F.col("pos") + token_count, F.col("total")))
    d = d.withColumn("first", F.expr("size(filter(o, x -> x.hi <= pos))")).withColumn("after", F.expr("size(filter(o, x -> x.lo < stop))"))
    part = F.expr("slice(c, int(first) + 1, int(after) - int(first))")
    d = d.withColumn("part", part)
    return d.select(
        "doc_id", F.col("i").alias("chunk_index"), F.expr("part[0].x.start_ds").alias("start_ds"), F.expr("part[size(part) - 1].x.end_ds").alias("end_ds"),
        F.col("first").cast("long").alias("first_ord"), F.size("part").cast("long").alias("n_lines"), F.array_join(F.transform("part", lambda x: F.trim(x["x"]["text"])), " ").alias("raw_text"),
    )


def chunked(lines: DataFrame, strategy: str, **options) -> DataFrame:
    """By name, with the options held to their bounds."""
    held = lambda v, lo, hi: max(lo, min(hi, v))
    if strategy == "time":
        window = held(options.get("window", 60), 10, 300)
        return by_time(lines, window, held(options.get("overlap", 15), 0, window - 1))
    if strategy == "sentence":
        return by_sentence(lines, held(options.get("max_chars", 1000), 100, 5000))
    if strategy == "token":
        return by_tokens(lines, held(options.get("token_count", 256), 32, 1024), held(options.get("overlap_fraction", 0.25), 0.0, 0.5))
    raise ValueError(f"strategy: {strategy}")


def stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    n = F.length("raw_text")
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.sum(n).cast("long").alias("chars"), F.round(F.avg(n), 1).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"))


def budget_windows(lines: DataFrame, max_chars: int = 7000, each: int = 48) -> DataFrame:
    """(doc_id, window, first_ord, n_lines, chars): lines in turn until a window would exceed max_chars, each line with an allowance."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, sizes in zip(f.doc_id, f.sizes, strict=True):
                first = used = window = 0
                for i, n in enumerate(sizes):
                    if used > 0 and used + n + each > max_chars:
                        out.append((doc, window, first, i - first, used - each * (i - first)))
                        first, used, window = i, 0, window + 1
                    used += int(n) + each
                if len(sizes):
                    out.append((doc, window, first, len(sizes) - first, used - each * (len(sizes) - first)))
            yield pd.DataFrame(out, columns=["doc_id", "window", "first_ord", "n_lines", "chars"])

    return lines.select("doc_id", F.transform("lines", lambda x: F.length(x["text"]).cast("long")).alias("sizes")).mapInPandas(run, "doc_id long, window long, first_ord long, n_lines long, chars long")
