"""Packing by vector bin packing.

Each example is a vector: tokens, segments (one) and loss-bearing tokens. Bins limit all three. A bin
takes, among the examples that fit, the one whose vector has the largest dot product with what the bin has left (both
as shares of the limits). Texts are cut where a sequence is full, so only the last part of a text
is an example to place; parts that remain over are cut once more to fill the gaps. Tasks pack on their own
within bounded windows, so nothing is shuffled, and a lost task is made again alike.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Examples of one window, and bytes of ids it holds at most.
WINDOW, WINDOW_BYTES = 4096, 32 << 20


#: How the byte-level pre-tokenizer cuts text, as its library documents it.
LONG_SPACE = 50_000
_LONG_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _same_merges(spec: dict):
    """A tiktoken encoding with the merges of a byte-level BPE file, or None if ids don't follow the merges."""
    import tiktoken

    model = spec["model"]
    vocab = model["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or model.get("ignore_merges") or model.get("unk_token"):
        return None
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("merges", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(json_path: str, special_strings: bool = False) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids (uint32) of texts as the tokenizers file gives them: no special tokens added.

    special_strings: whether a special token's string inside a text gets the token's id, as is the library's default; else it is ordinary text.

    A byte-level BPE goes through tiktoken with the merges of the same file, which gives the same ids for less
    work (held to in the tests); any other file goes through tokenizers, and so do texts with a run of LONG_SPACE characters
    of white space or more, which tiktoken's pattern matcher can't hold.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(json_path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    # tokens that take the space about them or stand as whole words only are left to the library
    exact = not special_strings or not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", []))
    if plain and exact and (fast := _same_merges(spec)):
        quick = (lambda x: fast.encode(x, allowed_special="all", disallowed_special=())) if special_strings else fast.encode_ordinary
        library = []

        def ids(x: str) -> np.ndarray:
            if len(x) >= LONG_SPACE and _LONG_SPACE.search(x):
                if not library:
                    library.append(_library(json_path, special_strings))
                return library[0]([x])[0]
            return np.array(quick(x), np.uint32)

        return lambda texts: [ids(x) for x in texts]
    return _library(json_path, special_strings)


def _library(json_path: str, special_strings: bool) -> Callable[[list[str]], list[np.ndarray]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(json_path)
    t.encode_special_tokens = not special_strings
    return lambda texts: [np.array(x.ids, np.uint32) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


class Limits:
    """Limits of a sequence: tokens, segments, loss-bearing tokens."""

    def __init__(self, tokens: int = 1024, segments: int = 64, loss: int | None = None):
        self.each = np.array([tokens, segments, tokens if loss is None else loss], np.int64)


def place(sizes: np.ndarray, limits: Limits) -> list[list[int]]:
    """Bins of example numbers. sizes: (n, 3) tokens, segments, loss. Each example must fit an empty bin.

    Examples of one size share a count, so a bin looks at distinct sizes only. Ties go to the larger, then the smaller loss.
    """
    order = np.lexsort((sizes[:, 2], -sizes[:, 0]))
    kinds, start, count = np.unique(sizes[order][:, [0, 2]] * [-1, 1], axis=0, return_index=True, return_counts=True)
    vectors = np.column_stack([-kinds[:, 0], np.ones(len(kinds), np.int64), kinds[:, 1]])
    share = vectors / limits.each
    used, bins = np.zeros(len(kinds), np.int64), []
    while True:
        open_ = np.flatnonzero(used < count)
        if not len(open_):
            return bins
        left, items = limits.each.copy(), []
        vs, shs = vectors[open_], share[open_]
        while True:
            fits = (vs <= left).all(1) & (used[open_] < count[open_])
            if not fits.any():
                break
            score = np.where(fits, shs @ (left / limits.each), -1.0)
            best = int(score.argmax())
            kind = open_[best]
            items.append(int(order[start[kind] + used[kind]]))
            used[kind] += 1
            left -= vectors[kind]
        bins.append(items)


def pack_window(lengths: list[int], losses: list[int], limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (example, start, length) for examples shorter than a sequence.

    Bins left short are filled by cutting the examples of the emptiest bins, which so disappear; limits hold throughout.
    Loss-bearing tokens of a piece are taken as the larger of its share and what its example's others leave: all of a cut
    example's loss counts for each piece up to the piece's length, which never breaks a limit.
    """
    sizes = np.array([[n, 1, s] for n, s in zip(lengths, losses, strict=True)], np.int64).reshape(-1, 3)
    bins = place(sizes, limits)
    full, most_segments, most_loss = (int(x) for x in limits.each)
    loss_of = lambda e, n: min(losses[e], n)
    seqs = [[(e, 0, lengths[e]) for e in b] for b in bins]
    fill = lambda s: sum(p[2] for p in s)
    seqs.sort(key=fill, reverse=True)
    fills, at = [fill(s) for s in seqs], 0
    while at < len(seqs) - 1:
        gap = full - fills[at]
        spare = most_loss - sum(loss_of(e, n) for e, _, n in seqs[at])
        if gap <= 0 or len(seqs[at]) >= most_segments or spare <= 0:
            at += 1
            continue
        e, start, n = seqs[-1].pop()
        take = min(gap, n, spare)
        seqs[at].append((e, start, take))
        fills[at] += take
        fills[-1] -= take
        if take < n:
            seqs[-1].append((e, start + take, n - take))
        if not seqs[-1]:
            seqs.pop()
            fills.pop()
    return seqs


def packed(docs: DataFrame, json_path: str, max_tokens: int = 1024, max_segments: int = 64, max_loss: int | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document is its ids and then end_id; a null text has only that id. loss_col: a column with the number
    of loss-bearing tokens (held to 0 and the document's ids); without it every id bears loss. Whole sequences
    of a document's first ids are sequences of their own if the limits allow. Each id lies in exactly one piece; pieces
    tile their sequence from offset 0. Equal rows are packed each. A document whose loss-bearing ids exceed max_loss
    is cut where it reaches it. Windows follow the order of the rows, and so do sequence_ids (task, then place in the task) up to a window's
    examples. Other columns aren't read; without rows the result is empty.
    """
    limits = Limits(max_tokens, max_segments, max_loss)
    cap = int(min(limits.each[0], limits.each[2])) if max_loss is not None else max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, special_strings=True)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple[int, int, np.ndarray, int, int]] = []  # doc, start, ids, tokens of the document, loss
        weight = 0
        rows: list[tuple] = []

        def put(seq: list[tuple[int, int, np.ndarray, int, int]]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total, loss in seq:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, loss))
                offset += len(ids)
            sequence += 1

        def pack(final: bool) -> None:
            nonlocal held, weight
            seqs = pack_window([len(x[2]) for x in held], [x[4] for x in held], limits)
            back, short = [], seqs[-1]
            # sequences in the order of their examples, as far as packing leaves one
            for seq in sorted(seqs, key=lambda s: (s is short, sum(e * n for e, _, n in s) / sum(n for *_, n in s))):
                pieces = [(held[e][0], held[e][1] + s, held[e][2][s : s + n], held[e][3], min(held[e][4], n)) for e, s, n in seq]
                # the last sequence may be short: unless it is the task's last, its pieces wait for the next window
                if not final and seq is short:
                    back = pieces
                else:
                    put(pieces)
            held, weight = back, sum(len(x[2]) for x in back) * 4

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        for batch in batches:
            losses = batch.column(2).to_pylist() if loss_col else None
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                docs_, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                for i, (doc, ids) in enumerate(zip(docs_, encode(texts), strict=True)):
                    ids = np.concatenate([ids, tail])
                    loss = len(ids) if losses is None else max(0, min(len(ids), losses[lo + i] or 0))
                    total, start = len(ids), 0
                    while total - start >= cap:
                        n = min(cap, loss)
                        loss -= n
                        put([(doc, start, ids[start : start + cap], total, n)])
                        start += cap
                    if start < total:
                        held.append((doc, start, ids[start:].copy(), total, loss))
                        weight += 4 * (total - start)
                    if len(held) >= WINDOW or weight >= WINDOW_BYTES:
                        pack(False)
                if len(rows) >= 10_000:
                    yield flush()
        if held:
            pack(True)
        yield flush()

    loss = [F.col(loss_col).cast("long").alias("loss")] if loss_col else []
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *loss)
    return picked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long")
