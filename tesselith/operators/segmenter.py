"""Words of texts without spaces: the least-cost path through a lattice of a lexicon's words. Where there is no lexicon, bigrams stand for words (functions.text)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words of a lexicon that tasks hold, at most: a dictionary is of a language, and doesn't grow with the corpus.
MOST = 2_000_000


class Lattice:
    """Words and their costs. A character that is no word costs `unknown`."""

    def __init__(self, costs: dict[str, int], unknown: int):
        self.costs, self.unknown = costs, unknown
        self.lengths: dict[str, list[int]] = {}
        for n, first in sorted({(len(w), w[0]) for w in costs}):
            self.lengths.setdefault(first, []).append(n)

    def split(self, text: str) -> list[str]:
        """The words of the cheapest path; of equals that of fewer words, and then the one whose first word is longest, and so on. From the end to the beginning."""
        n = len(text)
        best: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        step = [1] * n
        for i in range(n - 1, -1, -1):
            cost, words = best[i + 1]
            top = (cost + self.costs.get(text[i], self.unknown), words + 1)
            for k in self.lengths.get(text[i], ()):
                if k > 1 and i + k <= n and (c := self.costs.get(text[i : i + k])) is not None:
                    way = (best[i + k][0] + c, best[i + k][1] + 1)
                    if way <= top:
                        top, step[i] = way, k
            best[i] = top
        out, at = [], 0
        while at < n:
            out.append(text[at : at + step[at]])
            at += step[at]
        return out


def segmented(texts: DataFrame, lexicon: DataFrame, unknown: int = 20) -> DataFrame:
    """(id, words) of texts (id, text): the text between white space cut by the lexicon (surface, cost), whose costs are whole and not negative.

    A surface that is given twice costs the least of its costs; null and blank ones don't count. A null text has no words. Without a lexicon every character is a word. The work of a text grows with its length
    times the number of word lengths that begin with a character; texts aren't shuffled.
    """
    given = lexicon.where("trim(surface) <> '' and cost is not null").selectExpr("surface", "cast(cost as long) as cost").groupBy("surface").min("cost").limit(MOST + 1).collect()
    if len(given) > MOST:
        raise ValueError(f"a lexicon of more than {MOST} words")
    held = texts.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in given})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(held.value, unknown)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                words = [[w for run in (t or "").split() for w in lattice.split(run)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.list_(pa.string()))], ["id", "words"])

    return texts.select("id", "text").mapInArrow(run, f"id {dict(texts.dtypes)['id']}, words array<string>")
