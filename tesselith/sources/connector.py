"""Metadata of media by id, from foreign services: batches of ids a call, retries, and a chain of fallbacks. The services are injected; a table of ids says what is fetched."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "channel_id", "channel_name")
#: Ids of one call to a service that takes several.
BATCH = 50


def enriched(ids: DataFrame, services: list[tuple[str, int, Callable[[list[str]], dict[str, dict]]]], retries: int = 2, wait_s: float = 0.0, partitions: int | None = None) -> DataFrame:
    """(video_id, title, channel_id, channel_name, provider, calls, error) of every distinct id.

    services: (name, ids of a call, fetch) in the order they are asked; fetch gives what it knows by id. A call that fails is made again, `retries` times at most; what a service lacks or fails at goes
    to the next, and in the end to "fallback" without fields. A service's failure is its ids' own: other batches go on. calls counts those made for the id's batch, error is the last failure.
    Ids are dealt evenly, so calls run side by side: about one for each batch, however many tasks there are. Null and blank ids are left out.
    """

    def attempt(fetch, batch: list[str]) -> tuple[dict, int, str]:
        error = ""
        for n in range(1, retries + 2):
            try:
                return fetch(batch) or {}, n, ""
            except Exception as e:  # noqa: BLE001  foreign code
                error = f"{type(e).__name__}: {e}"
                time.sleep(wait_s if n <= retries else 0)
        return {}, retries + 1, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(batch: list[str]) -> pd.DataFrame:
            got, calls, errors, left = {}, dict.fromkeys(batch, 0), dict.fromkeys(batch, ""), list(batch)
            for name, size, fetch in services:
                for lo in range(0, len(left), size):
                    part = left[lo : lo + size]
                    found, n, error = attempt(fetch, part)
                    for i in part:
                        calls[i] += n
                        errors[i] = error or errors[i]
                        if i in found:
                            got[i] = (name, found[i])
                left = [i for i in left if i not in got]
            rows = [(i, *[got.get(i, ("", {}))[1].get(f) for f in FIELDS], got[i][0] if i in got else "fallback", calls[i], errors[i]) for i in batch]
            return pd.DataFrame(rows, columns=["video_id", *FIELDS, "provider", "calls", "error"])

        held: list[str] = []
        for f in frames:
            held += f.video_id.tolist()
            while len(held) >= BATCH:
                yield out(held[:BATCH])
                held = held[BATCH:]
        if held:
            yield out(held)

    d = ids.select(F.trim("video_id").alias("video_id")).where("video_id <> ''").distinct()
    d = d.repartition(partitions or max(1, d.sparkSession.sparkContext.defaultParallelism), "video_id")
    return d.mapInPandas(run, "video_id string, title string, channel_id string, channel_name string, provider string, calls int, error string")
