"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts of a batch hold so many bytes together; a text beyond PIECE_BYTES is cut at safe boundaries.
BATCH_BYTES, PIECE_BYTES = 1 << 20, 1 << 15

#: One space between two characters that aren't white space: there a new word piece begins in any context.
_SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def cut(text: str, most: int = PIECE_BYTES) -> list[str]:
    """Parts of about `most` bytes (UTF-8) whose token counts add up to that of the text.

    The space at a boundary goes: the encoder itself puts a word mark before each part. A text without a safe boundary
    stays whole.
    """
    out, at, size = [], 0, utf8(text)
    if size <= most:
        return [text]
    step = max(1, most * len(text) // size)  # as many characters as `most` bytes hold here on average
    while len(text) - at > step and (m := _SAFE.search(text, at + step)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def utf8(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _crosses_words(processor) -> bool:
    """Whether a piece of the vocabulary has a word mark after another character: then no space is safe."""
    return any("▁" in processor.id_to_piece(i).lstrip("▁") for i in range(processor.get_piece_size()))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row, of whole texts.

    tokenizer: path of a .model (sentencepiece) or .json (tokenizers) file, which every executor can read. No begin, end or
    other special tokens are added, and nothing is cut off. A null text counts as empty; equal rows are counted each.
    Only the two columns are read, so other columns can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            parts_of = (lambda t: [t]) if _crosses_words(processor) else (lambda t: cut(t, piece_bytes))
            lengths = lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            processor = Tokenizer.from_file(tokenizer)
            parts_of = lambda t: [t]  # noqa: E731  no boundary is safe for every such file
            lengths = lambda texts: [len(x.ids) for x in processor.encode_batch_fast(texts, add_special_tokens=False)]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, queue, held = [0] * len(texts), [], 0
            sizes = [utf8(t) for t in texts]
            for row, text in enumerate(texts):
                for part in parts_of(text):
                    queue.append((row, part))
                    held += utf8(part)
                    if held >= batch_bytes:
                        for (r, _), n in zip(queue, lengths([p for _, p in queue]), strict=True):
                            counts[r] += n
                        queue, held = [], 0
            for (r, _), n in zip(queue, lengths([p for _, p in queue]) if queue else [], strict=True):
                counts[r] += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
