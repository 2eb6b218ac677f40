"""WARC archives and a globally ordered capture index.

Pages are written as WARC records, one gzip member each, in archives of bounded
size in the shared folder; equal payloads are stored once and revisited. Reading
an archive back, in one pass, checks every payload and gives the archive's run:
its captures sorted by URL key and time. The runs are cut at common splitters and
every range is merged by a loser tree over its runs' segments, so that the ranges
in order are one index of all captures.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_folder, written

#: Bytes of archive after which a task begins the next one.
ARCHIVE_BYTES = 64_000_000
#: Payloads shorter than this are never revisited.
LEAST_REVISITED = 100
#: Captures aimed at for each range of the index.
RANGE_CAPTURES = 50_000
#: Pages carry no time of capture: the n-th page has the n-th second from here.
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """The sort key of a URL: host labels from the last one, then port, path and query, in lower case; what has no scheme sorts by itself."""
    try:
        found = urlsplit(url)
        port = found.port
    except ValueError:
        return url.lower()
    if not found.scheme or not found.netloc:
        return url.lower()
    host = (found.hostname or "").removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){found.path or '/'}{f'?{found.query}' if found.query else ''}".lower()


def capture_time(page: int | None) -> str:
    """The time of capture, in the form of WARC headers; pages without an id have the first."""
    try:
        return (EPOCH + timedelta(seconds=page or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return (EPOCH + timedelta(seconds=(page or 0) % 1_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: the page as a response, or a revisit of an earlier one with its headers but not its payload."""
    http = _HTTP.format(len(payload)).encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {capture_time(page)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member of an archive, read in pieces."""
    at = 0
    held, ended = b"", False
    while True:
        unzip, out, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not held:
                held = stream.read(size)
                if not held:
                    ended = True
                    break
            used += len(held)
            out.append(unzip.decompress(held))
            held = unzip.unused_data
            used -= len(held)
        if ended:
            if used:
                raise ValueError("the archive ends within a record")
            return
        yield at, used, b"".join(out)
        at += used


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: Sequence[Iterator]):
        self._runs = list(runs)
        k = self._size = max(1, len(self._runs))
        self._heads = [self._next(i) for i in range(k)] if self._runs else [None]
        self._losers = [-1] * k
        self._winner = -1
        for i in range(k):
            self._play(i)

    def _next(self, i: int):
        return next(self._runs[i], None)

    def _before(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        return y is None if x is not None and y is None else x is not None and (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node = (i + self._size) // 2
        while node:
            other = self._losers[node]
            if other < 0:  # the first to come waits for its match
                self._losers[node] = i
                return
            if self._before(other, i):
                self._losers[node], i = i, other
            node //= 2
        self._winner = i

    def __iter__(self) -> Iterator:
        while self._heads[self._winner] is not None:
            i = self._winner
            yield self._heads[i]
            self._heads[i] = self._next(i)
            node = (i + self._size) // 2
            while node:
                other = self._losers[node]
                if self._before(other, i):
                    self._losers[node], i = i, other
                node //= 2
            self._winner = i


def revisits(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, url, payload, digest, refers) of every page: the smallest key with an equal payload, where that is another and the payload is long enough.

    Only digests and keys are aggregated; a payload travels once, to its digest's
    smallest key, and a crowded digest can be split over tasks.
    """
    body = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("page"), F.col("url").cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= LEAST_REVISITED).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return rows.join(first, "digest", "left").withColumn("refers", F.when(F.col("first") < F.col("page"), F.col("first"))).drop("first")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Write the records of ``rows`` (page, url, payload, digest, refers) as archives; returns their list (path, records, bytes).

    A name holds the task's attempt and files are listed only by attempts that
    end well, so a repeated or lost task leaves at most a file that nobody reads.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        made = False
        task = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        out, path, records, size = None, "", 0, 0
        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(c) for c in ("page", "url", "payload", "digest", "refers")), strict=True):
                if out is None:
                    if not made:
                        store.create_dir(root, recursive=True)
                        made = True
                    path = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):05d}.warc.gz"
                    out, records, size = store.open_output_stream(path, compression=None), 0, 0
                member = gzip.compress(record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py()), compresslevel=level, mtime=0)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return rows.mapInArrow(run, schema)


_CAPTURE = T.StructType(
    [
        T.StructField("urlkey", T.StringType()), T.StructField("time", T.StringType()), T.StructField("page", T.LongType()), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
        T.StructField("archive", T.StringType()), T.StructField("place", T.LongType()), T.StructField("length", T.LongType()), T.StructField("nth", T.LongType()),
    ]
)
_ARROW = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in _CAPTURE])


def _page_id(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def read_archives(listed: DataFrame, folder: str) -> DataFrame:
    """The captures of every listed archive, each archive's sorted by URL key, time and page: its run. Payloads of responses are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for at, length, raw in members(stream):
                        fields, http, payload = parse(raw)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] == "response":
                            size, digest_found = len(payload), hashlib.sha256(payload).hexdigest()
                            if digest_found != digest:
                                raise ValueError(f"{path} at {at}: the payload is not what its digest says")
                        else:
                            size = int(http["Content-Length"])
                        rows.append((url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], _page_id(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page_id(fields.get("WARC-Refers-To")), path, at, length))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[8]))
                rows = [(*r, n) for n, r in enumerate(rows)]  # the place in the run
                for low in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[low : low + 10_000], strict=True), _ARROW, strict=True)], schema=_ARROW)

    return listed.select("path").mapInArrow(run, _CAPTURE)


def _rank_in(cuts: list[str]):
    """A function that numbers values by how many of the sorted ``cuts`` are not above them."""

    @F.pandas_udf("int")
    def rank(values: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in values], dtype="int32")

    return rank


def merged_index(captures: DataFrame) -> DataFrame:
    """All captures with ``range`` and ``rank`` in it: ordered by (range, rank) they are ordered by URL key, time and page.

    Splitters are quantiles of (URL key, time, page), so that they also cut within
    one URL. A range gets a segment of each run, and merges the segments.
    """
    total = captures.count()
    parts = max(1, -(-total // RANGE_CAPTURES))
    sort_key = F.concat(F.coalesce("urlkey", F.lit("")), F.lit("\x00"), F.coalesce("time", F.lit("")), F.lit("\x00"), F.lpad(F.coalesce("page", F.lit(0)).cast("string"), 20, "0"))
    keyed = captures.withColumn("_k", sort_key)
    if parts > 1:
        # a sample of bounded size in expectation; the cuts only balance, any cuts are right
        sample = sorted(r[0] for r in keyed.where(F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 100 * parts / total, 100_000 / total))).select("_k").collect())
        cuts = [sample[len(sample) * i // parts] for i in range(1, parts)] if len(sample) >= parts else []
    else:
        cuts = []
    if cuts:
        keyed = keyed.withColumn("range", _rank_in(sorted(set(cuts)))("_k"))
    else:
        keyed = keyed.withColumn("range", F.lit(0))
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("rank", T.LongType()), *_CAPTURE.fields[:-1]])
    names = _CAPTURE.fieldNames()[:-1]

    def merge(table: pa.Table) -> pa.Table:
        of = table.column("range")[0].as_py() if table.num_rows else 0
        # a segment is what one run has in this range: its rows come in any order and are put back by their places in the run
        table = table.sort_by([("archive", "ascending"), ("nth", "ascending")])
        columns = {c: table.column(c).to_pylist() for c in ("archive", "urlkey", "time", "page", "place")}
        archives = columns["archive"]
        starts = [i for i in range(len(archives)) if not i or archives[i] != archives[i - 1]]

        def segment(low: int, high: int) -> Iterator[tuple]:
            for i in range(low, high):
                page = columns["page"][i]
                yield columns["urlkey"][i], columns["time"][i], page is None, page or 0, i

        order = [x[-1] for x in LoserTree([segment(a, b) for a, b in zip(starts, [*starts[1:], len(archives)], strict=True)])]
        table = table.take(pa.array(order, pa.int64())).select(names)
        n = table.num_rows
        return pa.table([pa.array([of] * n, pa.int32()), pa.array(range(n), pa.int64()), *table.columns], names=["range", "rank", *names])

    return keyed.select("range", *names, "nth").groupBy("range").applyInArrow(merge, schema)


def archive_pages(pages: DataFrame, key: str = "page_id", html: str = "html", folder: str | None = None) -> DataFrame:
    """Write ``pages`` (key, url, html) to WARC archives, read them back, and return the ordered index of captures.

    Columns: key, payload_bytes, payload_digest, record_type, refers_to, and urlkey,
    time, archive, place, length, range, rank. A null html is an empty payload; a
    null URL an empty one. Null keys come last among equals, are never referred to
    while another key has the payload, and are responses. Repeated rows are each a
    record; the smallest key is a response wherever it stands. An empty table gives
    an empty result. The key must be an integer; other columns, whatever their
    names, are ignored.
    """
    if not isinstance(pages.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be an integer")
    spark = pages.sparkSession
    kind = pages.schema[key].dataType
    pages = pages.select(F.col(key).alias("page_key"), F.col(html).cast("string").alias("html"), (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string").alias("url"))
    folder = folder or new_folder(spark, "warc")
    listed = written(write_archives(revisits(pages, "page_key", "html"), folder), "archives")
    spread = listed.repartition(max(1, listed.count()))
    captures = written(read_archives(spread, folder), "runs")
    index = merged_index(captures)
    return index.withColumn("page", F.col("page").cast(kind)).withColumnRenamed("page", key)
