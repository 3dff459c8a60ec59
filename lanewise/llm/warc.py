"""WARC archives in the shared folder, and a globally ordered capture index by external merge.

1. Payload digests are counted (pre-aggregated); of equal payloads of at least MIN_REVISIT bytes the
   smallest page_id is the response, the others revisit it. Payloads of a digest found once, which a Bloom filter
   tells, are written where they are read; only possible repeats shuffle to meet their digest (all payloads, where the repeats are too many for a filter).
2. Each task writes archives of gzip members, one record each, under a name of its own attempt, and reports the files that it finished.
3. Each archive is read back record by record, digests are checked, and every RUN_ROWS captures are sorted by URL
   key, time, page_id, archive and place and written to a file of their own in the shared folder: a run, in slices of SLICE captures.
   A fence tells the first and last key of a slice.
4. While there are more than FAN_IN runs, groups of GROUP of them are merged into longer ones. Then the whole order is cut into ranges at splitters
   (quantiles of a bounded sample of fences, which steers balance only; whole sort keys, so one hot URL or host spreads, and so do equal captures). Each
   range is merged by a loser tree from all runs that reach into it, which are read slice by slice: a task holds one slice of each run, whatever the
   length of its range. Partition i of the result holds range i in order, so the rows are globally ordered.

A null html is an empty payload; a null url gives an empty key. Without a time column a capture's time is
2024-01-01 plus page_id seconds, modulo 10**9. Pages without page_id can't be referred to: they are the response only where
their payload has no page with an id. Rows of one page_id and one payload are one page. An empty table gives an empty table; other
columns, of any name, are not read. A long payload is held whole by the task that writes or reads it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .shared import for_python, new_path, scratch, stored

MIN_REVISIT = 100
ARCHIVE_BYTES = 128 << 20
SAMPLE = 20_000
SLICE = 256  # captures of a run that are in memory at a time
RUN_ROWS = 1 << 16
FAN_IN, GROUP = 512, 256  # runs, and open files, of a task
RANGE_ROWS, RANGES = 8192, 2000
CAPTURE = "url_key string, captured_at string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, position bigint, length bigint"
_NAMES = [c.split()[0] for c in CAPTURE.split(", ")]
_CAPTURE_ARROW = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (c.split() for c in CAPTURE.split(", "))])
_START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Sortable key: the host's labels reversed, ")", then path and query; no scheme, port, "www." or fragment."""
    if not url:
        return ""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]*)(?::[0-9]*)?([^#]*)", url)
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] if m[2].startswith("/") else "/" + m[2])


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]", "", value)


def record(page_id: int | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"" if revisit else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(position, length, content) of each gzip member of a stream."""
    held, at = b"", 0
    while True:
        if not held:
            held = stream.read(1 << 20)
            if not held:
                return
        unpack, out, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not held:
                held = stream.read(1 << 20)
                if not held:
                    raise ValueError("the archive ends inside a record")
            out.append(unpack.decompress(held))
            used += len(held) - len(unpack.unused_data)
            held = unpack.unused_data
        yield at, used, b"".join(out)
        at += used


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and len(urn) > 11 else None


def write_archives(pages: DataFrame, folder: str, time_column: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``folder``; returns the finished files: archive, records, bytes."""
    when = F.date_format(F.col(time_column), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_column else F.lit(None).cast("string")
    rows = for_python(pages).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), when.alias("date"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("key", F.xxhash64("digest"))
    repeated = stored(rows.filter(F.length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first", F.xxhash64("digest").alias("key")), "payloads", files_a_core=4)
    suspects = bloom.shared_filter(repeated, "key")

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(bloom.may_hold(suspects, batch.column(5)) == wanted)).select(range(5))

        return run

    schema = "page_id bigint, url string, date string, payload binary, digest string"
    alone = rows.mapInArrow(part(False), schema).withColumn("first", F.lit(None).cast("bigint"))
    again = rows.mapInArrow(part(True), schema).join(repeated.select("digest", "first"), "digest", "left").select("page_id", "url", "date", "payload", "digest", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        out = name = None
        count = size = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, count, size))
                out = None

        for batch in batches:
            for page_id, url, date, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(root, recursive=True)
                    name, count, size = f"captures-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                date = date or (_START + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = pack.compress(record(page_id, url, date, payload, digest, first, first is not None and first != page_id)) + pack.flush()
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], names=["archive", "records", "bytes"])

    return stored(alone.unionAll(again).mapInArrow(write, "archive string, records bigint, bytes bigint"), "archives")


def _order(row: tuple) -> tuple:
    """The sort key of a capture; archive and place make it its own."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


_KEY = "struct<url_key:string,captured_at:string,known:boolean,page_id:bigint,archive:string,position:bigint>"
FENCE = f"run string, slice int, n int, first {_KEY}, last {_KEY}"
_KEY_ARROW = pa.struct([("url_key", pa.string()), ("captured_at", pa.string()), ("known", pa.bool_()), ("page_id", pa.int64()), ("archive", pa.string()), ("position", pa.int64())])


def _struct(key: tuple) -> dict:
    return dict(zip((f.name for f in _KEY_ARROW), key))


def _write_run(system: fs.FileSystem, root: str, rows: Iterator[tuple], slice_rows: int) -> pa.RecordBatch:
    """Write sorted captures as a file of slices, under a name of this attempt; their fences."""
    task = TaskContext.get()
    name = f"run-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.arrow"
    fences: list[tuple] = []
    with system.open_output_stream(f"{root}/{name}", compression=None) as sink, pa.ipc.new_file(sink, _CAPTURE_ARROW) as writer:
        while some := list(islice(rows, slice_rows)):
            writer.write_batch(_captures(some))
            fences.append((name, len(fences), len(some), _struct(_order(some[0])), _struct(_order(some[-1]))))
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*fences), (pa.string(), pa.int32(), pa.int32(), _KEY_ARROW, _KEY_ARROW))], names=["run", "slice", "n", "first", "last"])


def _read_run(system: fs.FileSystem, root: str, name: str, slices: list[int] | None = None) -> Iterator[tuple]:
    """Captures of a run, or of some slices of it; one slice at a time is in memory."""
    with system.open_input_file(f"{root}/{name}") as source:
        run = pa.ipc.open_file(source)
        for i in slices if slices is not None else range(run.num_record_batches):
            yield from zip(*(c.to_pylist() for c in run.get_batch(i).columns))


def read_archives(files: DataFrame, folder: str, run_rows: int = RUN_ROWS, slice_rows: int = SLICE) -> DataFrame:
    """Read every archive in ``files`` back and write its captures as sorted runs under ``folder``: FENCE per slice."""

    def captures(system: fs.FileSystem, root: str, name: str) -> Iterator[tuple]:
        with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
            for at, length, content in members(stream):
                fields, block = parse(content)
                digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
                if not revisit and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"{name} at {at}: the payload does not match its digest")
                n = int(fields["X-Payload-Length"]) if revisit else len(block)
                yield url_key(fields.get("WARC-Target-URI")), fields["WARC-Date"], _page(fields["WARC-Record-ID"]), n, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), name, at, length

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        rows = (row for batch in batches for name in batch.column(0).to_pylist() for row in captures(system, root, name))
        while some := list(islice(rows, run_rows)):
            yield _write_run(system, root, iter(sorted(some, key=_order)), slice_rows)

    parts = max(1, min(files.count(), 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return stored(files.select("archive").repartition(parts, "archive").mapInArrow(read, FENCE), "fences")


class LoserTree:
    """k-way merge of sorted iterators. Inner nodes keep the loser of their match; a pop replays one path."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.head = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.head]
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int) -> None:
        node = (leaf + self.k) // 2
        while node > 0:
            rival = self.losers[node]
            if rival < 0:
                self.losers[node] = leaf
                return
            if self._beats(rival, leaf):
                self.losers[node], leaf = leaf, rival
            node //= 2
        self.winner = leaf

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.head[self.winner] is not None:
            i = self.winner
            yield self.head[i]
            self.head[i] = next(self.runs[i], None)
            self.keys[i] = None if self.head[i] is None else self.key(self.head[i])
            self._play(i)


def _longer_runs(fences: DataFrame, folder: str, group: int, slice_rows: int) -> DataFrame:
    """Merge groups of about ``group`` runs into one each: FENCE per slice."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for batch in batches for name in batch.column(0).to_pylist()]
        if names:
            system, root = fs.FileSystem.from_uri(folder)
            yield _write_run(system, root, iter(LoserTree([_read_run(system, root, n) for n in names], _order)), slice_rows)

    runs = fences.select("run").distinct()
    return stored(runs.repartition(-(-runs.count() // group), "run").mapInArrow(merge, FENCE), "fences")


def merge_runs(fences: DataFrame, folder: str, ranges: int | None = None, fan_in: int = FAN_IN, group: int = GROUP, slice_rows: int = SLICE) -> DataFrame:
    """Merge the sorted runs under ``folder`` that ``fences`` lists into one globally ordered table: CAPTURE."""
    spark = fences.sparkSession
    while fences.select("run").distinct().count() > fan_in:
        fences = _longer_runs(fences, folder, group, slice_rows)
    n, slices = fences.agg(F.sum("n"), F.count(F.lit(1))).first()
    ranges = ranges or max(1, min(RANGES, (n or 0) // RANGE_ROWS))
    step = max(1, slices // SAMPLE)
    key = F.struct(F.substring("first.url_key", 1, 256).alias("url_key"), *(F.col(f"first.{f.name}").alias(f.name) for f in list(_KEY_ARROW)[1:]), (F.length("first.url_key") > 256).alias("cut"))
    sample = [r[0] for r in fences.filter(F.pmod(F.xxhash64("run", "slice"), F.lit(step)) == 0).select(key).collect()] if ranges > 1 else []
    # A URL key of any length gives a splitter of bounded size: the start of a long one stands before all that begin so.
    sample = sorted(tuple(r)[:1] if r["cut"] else tuple(r)[:6] for r in sample)
    splitters = spark.sparkContext.broadcast([sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else [])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each range that a slice reaches into."""
        cuts = splitters.value
        for batch in batches:
            out = []
            for run, at, first, last in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                for part in range(bisect_right(cuts, tuple(first.values())), bisect_right(cuts, tuple(last.values())) + 1):
                    out.append((part, run, at))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.int32()))], names=["part", "run", "slice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, by_run, part = splitters.value, {}, -1
        for batch in batches:
            for part, run, at in zip(*(c.to_pylist() for c in batch.columns)):  # noqa: B007  a task has one range
                by_run.setdefault(run, []).append(at)
        if not by_run:
            return
        system, root = fs.FileSystem.from_uri(folder)
        low, high = cuts[part - 1] if part else (), cuts[part] if part < len(cuts) else None
        within = lambda rows: (row for row in rows if (key := _order(row)) >= low and (high is None or key < high))
        rows = iter(LoserTree([within(_read_run(system, root, run, at)) for run, at in by_run.items()], _order))
        while some := list(islice(rows, 8192)):
            yield _captures(some)

    placed = fences.mapInArrow(place, "part int, run string, slice int")
    return placed.repartitionById(len(splitters.value) + 1, F.col("part")).sortWithinPartitions("run", "slice").mapInArrow(merge, CAPTURE)


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _CAPTURE_ARROW.types)], names=_NAMES)


def archive_pages(pages: DataFrame, folder: str | None = None, time_column: str | None = None) -> DataFrame:
    """Write, read back and merge: CAPTURE per row of ``pages``, ordered by URL key, time and page_id. Archives and runs stay in ``folder``."""
    folder = folder or new_path(pages.sparkSession, "warc")
    with scratch() as keep:
        fences = keep(read_archives(write_archives(pages, folder, time_column), folder))
    return merge_runs(fences, folder)
