"""WARC archives and their index.

Every page becomes a WARC 1.1 record; of equal payloads of some size one is kept whole and the others become revisit
records. Beside each archive file (gzip, a member per record) lies a run of index entries sorted by URL key and
timestamp. Runs are merged externally by loser trees, level by level and at last by range of the key, a batch of each run in memory at
a time, so the ranges in order are capture histories in global order.

Files are named by the attempt that wrote them, and only those that the manifest names are read, so a task made again does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import parse_qsl, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselith.llm.common import scratch_path, spread_join, text_bytes, written

MIN_REVISIT = 1000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: Payload bytes of an archive file, before compression; one record may be longer.
FILE_BYTES = 16 << 20
#: Entries of a batch of a run, of a range of the index, and runs that a task merges.
RUN_BATCH, RANGE_ROWS, FAN_IN = 1024, 100_000, 256
INDEX = "archive string, offset long, length long, record_id string, page_id long, url_key string, ts string, record_type string"
MANIFEST = "archive string, run string, rows long"
CUT = "url_key string, ts string, page_id long, archive string, offset long"
PARSED = "archive string, offset long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and sorted query, lower-cased: captures of one page sort together."""
    if not url:
        return ")/"
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
        query = "&".join(f"{k}={v}" for k, v in sorted(parse_qsl(u.query, keep_blank_values=True)))
    except ValueError:
        return ")/" + url.lower()
    return (",".join(reversed(host.split("."))) + ")" + (u.path.rstrip("/") or "/") + (f"?{query}" if query else "")).lower()


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next smallest costs one match a level."""

    def __init__(self, runs: list[Iterable], key):
        self.key = key
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        x = next(self.runs[i], None)
        return None if x is None else (self.key(x), i, x)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None or (a is not None and a[:2] < b[:2])

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] == -1:
                self.losers[node] = i
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[winner := self.losers[0]]) is not None:
            yield head[2]
            self.heads[winner] = self._next(winner)
            node = (winner + self.k) // 2
            while node > 0:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def stamp(page_id: int | None) -> str:
    """The capture time of a page: the table has none, so a second of the epoch by id."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, without compression. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url or "urn:none")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {stamp(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {digest}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Date: {stamp(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The record of one uncompressed gzip member."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    if h["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload: {h['warc-record-id']}")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("x-page-id"), "record_type": h["warc-type"], "payload_bytes": length, "payload_digest": digest, "refers_to": number("x-refers-to-page-id"), "url": h["warc-target-uri"], "payload": payload if h["warc-type"] == "response" else None}


def members(stream, step: int = 1 << 14) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of an open file, one at a time, read in steps of bounded size."""
    start = at = 0
    z, out, ahead = zlib.decompressobj(31), [], b""
    while ahead := ahead or stream.read(step):
        out.append(z.decompress(ahead))
        at += len(ahead) - len(z.unused_data)
        ahead = z.unused_data
        if z.eof:
            yield start, b"".join(out)
            start, z, out = at, zlib.decompressobj(31), []
    if out:
        raise ValueError("an archive ends within a record")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def assigned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads of min_bytes or more, those but the largest page_id refer to it.

    Only digests are grouped, and only ids of revisits are joined back: payloads are shuffled if those are many, and never dealt by digest.
    """
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    d = d.withColumn("digest", F.when(text_bytes(F.col("html")) >= min_bytes, F.sha1("html")))
    narrow = written(d.where("digest is not null and page_id is not null").select("page_id", "digest"), "warc-digests")
    kept = narrow.groupBy("digest").agg(F.max("page_id").alias("kept"), F.min("page_id").alias("least")).where("least < kept").select("digest", "kept")
    revisits = spread_join(narrow, written(kept, "warc-kept"), "digest", "page_id", "inner").where("page_id < kept").distinct()
    revisits = written(revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "kept"), "warc-revisits")
    d = d.join(revisits, (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    return d.select("page_id", "url", "html", F.col("kept").alias("refers_to"))


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], columns: str) -> pa.RecordBatch:
    heads = [c.split() for c in columns.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(heads)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, heads, strict=True)], [n for n, _ in heads])


def _key(r: tuple) -> tuple:
    """Of a row of INDEX: URL key, time, page, and what tells repeated rows apart."""
    return r[5], r[6], -1 if r[4] is None else r[4], r[0], r[1]


class RunWriter:
    """Writes sorted index entries to a run: an Arrow file of batches of RUN_BATCH rows, which can be read from any batch on."""

    def __init__(self, store, path: str):
        self.schema = _table([], INDEX).schema
        self.sink = store.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.n = [], 0

    def add(self, row: tuple) -> None:
        self.held.append(row)
        self.n += 1
        if len(self.held) == RUN_BATCH:
            self._flush()

    def _flush(self) -> None:
        self.out.write_batch(_table(self.held, INDEX))
        self.held = []

    def close(self) -> int:
        if self.held:
            self._flush()
        self.out.close()
        self.sink.close()
        return self.n


class RunReader:
    """Rows of a run from a key on, a batch in memory at a time."""

    def __init__(self, store, path: str):
        self.source = store.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)

    def batch(self, i: int) -> list[tuple]:
        return list(zip(*(c.to_pylist() for c in self.file.get_batch(i).columns), strict=True))

    def rows(self, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
        """Those with low <= key < high."""
        first, last = 0, self.file.num_record_batches
        while low is not None and last - first > 1:  # the last batch that begins at or below low
            middle = (first + last) // 2
            if _key(self.batch(middle)[0]) <= low:
                first = middle
            else:
                last = middle
        for i in range(first, self.file.num_record_batches):
            for r in self.batch(i):
                k = _key(r)
                if high is not None and k >= high:
                    return
                if low is None or k >= low:
                    yield r

    def sampled(self, n: int) -> list[tuple]:
        """The first keys of n batches, evenly apart, or of all."""
        every = self.file.num_record_batches
        return [_key(self.batch(i)[0]) for i in sorted({x * every // n for x in range(min(n, every))} if every > n else range(every))]

    def close(self) -> None:
        self.source.close()


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, level: int = 1, **columns) -> DataFrame:
    """Write the records under `path`, with a sorted index run beside each archive; returns (archive, run, rows), a written table.

    A record is written per row; null html is an empty payload, null urls and ids are allowed. Rows of equal ids are
    written each. A task writes its files in turn, so memory holds one archive. Names are of the attempt: files of
    a task that was lost are in no row of the result, and so never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _store(path)
        store.create_dir(root, recursive=True)
        part, attempt, n = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        buffer, entries, held = io.BytesIO(), [], 0

        def close() -> pa.RecordBatch:
            nonlocal buffer, entries, held, n
            name = f"part-{part:05d}-{attempt}-{n:05d}"
            with store.open_output_stream(f"{root}/{name}.warc.gz") as f:
                f.write(buffer.getbuffer())
            writer = RunWriter(store, f"{root}/{name}.run")
            for e in sorted(((f"{name}.warc.gz", *e[1:]) for e in entries), key=_key):
                writer.add(e)
            out = _table([(f"{name}.warc.gz", f"{name}.run", writer.close())], MANIFEST)
            buffer, entries, held, n = io.BytesIO(), [], 0, n + 1
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = batch.slice(lo, 64)
                for page, url, html, to in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    if held and held + len(payload) > file_bytes:
                        yield close()
                    at = buffer.tell()
                    buffer.write(gzip.compress(record(page, url, payload, to), level, mtime=0))
                    entries.append(("", at, buffer.tell() - at, record_id(page), page, url_key(url), stamp(page), "response" if to is None else "revisit"))
                    held += len(payload)
        if entries:
            yield close()

    return written(assigned(pages, **columns).mapInArrow(run, MANIFEST), "warc-manifest")


def _fewer_runs(runs: DataFrame, path: str, fan_in: int) -> DataFrame:
    """Runs (run, rows) merged, about fan_in to one, each group by a loser tree in a task of its own."""
    groups = -(-2 * runs.count() // fan_in)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _store(path)
        names = [x for b in batches for x in b.column(0).to_pylist()]
        if names:
            name = f"merged-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.run"
            writer, readers = RunWriter(store, f"{root}/{name}"), [RunReader(store, f"{root}/{x}") for x in names]
            for row in LoserTree([r.rows() for r in readers], _key):
                writer.add(row)
            for r in readers:
                r.close()
            yield _table([(name, writer.close())], "run string, rows long")

    return written(runs.repartition(groups, "run").select("run").mapInArrow(run, "run string, rows long"), "warc-runs")


def merged_index(manifest: DataFrame, path: str, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Index entries with range_id and position in the range: all captures in the order of (url_key, ts, page_id).

    The merge is external: while there are more than fan_in runs, groups of them are merged to longer ones; then each task opens all
    of the last runs, reads the batches of its range alone, and merges them. Ranges are cut on the whole key, so that a URL or host with
    very many captures spreads over ranges, at keys taken evenly from the runs; their number follows that of the entries.
    """
    spark = manifest.sparkSession
    runs = manifest.select("run", "rows")
    while runs.count() > fan_in:
        runs = _fewer_runs(runs, path, fan_in)
    last = [(r["run"], r["rows"]) for r in runs.collect()]  # fan_in rows at most
    if not last:
        return spark.createDataFrame([], f"{INDEX}, range_id long, position long")
    ranges = max(1, -(-sum(n for _, n in last) // range_rows))
    names = [x for x, _ in sorted(last)]
    per_run = max(2, -(-8 * ranges // len(names)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for b in batches:
            for i in b.column(0).to_pylist():
                reader = RunReader(store, f"{root}/{names[i]}")
                yield _table(reader.sampled(per_run), CUT)
                reader.close()

    # about eight keys for each range of range_rows entries
    keys = sorted(tuple(r) for r in spark.range(0, len(names), 1, min(len(names), 32)).mapInArrow(sample, CUT).collect()) if ranges > 1 else []
    cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    held = spark.sparkContext.broadcast((names, [None, *cuts, None]))  # a key for each range_rows entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        files, bounds = held.value
        for b in batches:
            for part in b.column(0).to_pylist():
                readers, rows, at = [RunReader(store, f"{root}/{x}") for x in files], [], 0
                for row in LoserTree([r.rows(bounds[part], bounds[part + 1]) for r in readers], _key):
                    rows.append((*row, part, at))
                    at += 1
                    if len(rows) == 4096:
                        yield _table(rows, f"{INDEX}, range_id long, position long")
                        rows = []
                yield _table(rows, f"{INDEX}, range_id long, position long")
                for r in readers:
                    r.close()

    return spark.range(0, len(cuts) + 1, 1, len(cuts) + 1).mapInArrow(run, f"{INDEX}, range_id long, position long")


def read_archives(manifest: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives that the manifest names (PARSED). Payloads of responses are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as f:
                    for offset, data in members(f):
                        p = parsed(data)
                        rows.append((name, offset, p["page_id"], p["record_type"], p["payload_bytes"], p["payload_digest"], p["refers_to"], p["url"], p["payload"] if payloads else None))
                        held += len(data) if payloads else 0
                        if len(rows) == 1024 or held > FILE_BYTES:
                            yield _table(rows, PARSED)
                            rows, held = [], 0
                yield _table(rows, PARSED)

    tasks = max(1, min(manifest.count(), 3 * manifest.sparkSession.sparkContext.defaultParallelism + manifest.count() // 64))
    return manifest.select("archive").repartition(tasks).mapInArrow(run, PARSED)


def archived(pages: DataFrame, path: str | None = None, file_bytes: int = FILE_BYTES, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN, **columns) -> DataFrame:
    """Write pages to archives, merge the index runs, read the archives back and give each record its place in the index.

    One row per row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, ts, capture_rank, which is the place of
    the record in the order of (url_key, ts, page_id), from 0. Repeated rows get a record each, with ranks that follow one another.
    A null id is written and never a revisit. Without rows the result is empty. Other columns of pages aren't read.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, path, file_bytes, **columns)
    index = written(merged_index(manifest, path, range_rows, fan_in).select("archive", "offset", "url_key", "ts", "range_id", "position"), "warc-index")
    # a row for each range of range_rows entries
    before = F.sum("n").over(Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(index.groupBy("range_id").agg(F.count(F.lit(1)).alias("n")).select("range_id", F.coalesce(before, F.lit(0)).alias("start")), "warc-starts")
    # written, so that their size is known: a plan would take it for that of the manifest and send them to every task
    records = written(read_archives(manifest, path, payloads=False).drop("payload", "url"), "warc-records")
    d = records.join(index.join(starts, "range_id"), ["archive", "offset"])
    return d.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", (F.col("start") + F.col("position")).cast("long").alias("capture_rank"))
