"""Exact deduplication over an extendible-hash index on shared files.

Texts are equal when their UTF-8 bytes are; a null text counts as the empty text. The row with
the largest doc_id of a group stays. A row without doc_id stays only where its group has no
doc_id at all; rows that repeat a doc_id are one document and share its fate. An empty table gives an empty table; other columns of any
name are not read. A long text is held whole by the task that reads it.

Four steps, each skew-safe:

1. Keys. Every row gets a 64-bit key and a SHA-256; both are stored in a light table.
2. Directory. Key counts by prefix are pre-aggregated on the executors, with longer prefixes until no count is above
   a bucket's rows; the driver doubles the directory until no bucket is overfull. The directory is a table in the shared folder:
   at most about 4 * BUCKETS rows, since buckets hold BUCKET_ROWS keys or as many as make BUCKETS of them.
3. Owner tasks. Keys found once enter the index as they are. Texts of repeated keys are fetched
   by a Bloom filter (all texts, where the repeated keys are too many for one), combined in each map task (a hot text is one row a task), and sent to the task that owns
   the bucket's key range. The owner chains texts of one key and compares bytes; each distinct
   text gets a slot. Owners hold one key's chain at a time. The index is a table in the shared folder, in order of bucket and key.
4. Look-up. A light row's prefix gives its bucket by the directory, and bucket, key and digest give its slot; all sides are small per row and
   adaptive execution splits a hot key on the row side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .shared import for_python, scratch, stored

PREFIX_BITS, MOST_BITS = 16, 26  # of the first count, and of the last: a longer prefix is taken while a count is above a bucket's rows
BUCKET_ROWS, BUCKETS = 1 << 16, 1 << 20
HELD_BYTES = 16 << 20
ENTRY = "bucket int, key bigint, slot int, sha binary, n_bytes bigint, keep_id bigint, group_size bigint"


class Directory:
    """Extendible-hash directory over prefixes of the keys' addresses (``address``).

    ``slots[p]`` is the bucket of the addresses whose first ``depth`` bits are p. ``split`` replaces an
    overfull bucket by two of one bit more and doubles ``slots`` when its depth is the directory's.
    """

    def __init__(self) -> None:
        self.depth, self.slots = 0, np.zeros(1, np.int32)
        self.local, self.first = [0], [0]  # bits that a bucket's keys share, and those bits

    def split(self, bucket: int) -> int:
        if self.local[bucket] == self.depth:
            self.slots = np.repeat(self.slots, 2)
            self.depth += 1
        self.local[bucket] += 1
        self.first[bucket] *= 2
        new = len(self.local)
        self.local.append(self.local[bucket])
        self.first.append(self.first[bucket] + 1)
        span = 1 << (self.depth - self.local[new])
        self.slots[self.first[new] * span : (self.first[new] + 1) * span] = new
        return new

    @classmethod
    def over(cls, counts: np.ndarray, capacity: int) -> Directory:
        """Split until every bucket holds at most ``capacity`` of ``counts`` or spans one prefix."""
        bits = len(counts).bit_length() - 1
        total = np.r_[0, np.cumsum(counts)]
        out = cls()
        todo = [(0, 0, 0)]  # bucket, prefix, depth
        while todo:
            bucket, prefix, depth = todo.pop()
            width = 1 << (bits - depth)
            if depth < bits and total[(prefix + 1) * width] - total[prefix * width] > capacity:
                new = out.split(bucket)
                todo += [(bucket, 2 * prefix, depth + 1), (new, 2 * prefix + 1, depth + 1)]
        return out

    def bucket_of(self, addresses: np.ndarray) -> np.ndarray:
        return self.slots[(addresses.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(addresses), np.int32)


def address(key: str) -> Column:
    """64 evenly spread bits of a key, so that few of them tell different keys apart whatever made the keys."""
    return F.xxhash64(key)


def _prefix(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(address(key), 64 - bits) if bits else F.lit(0).cast("bigint")


def directory_of(keys: DataFrame, bucket_rows: int = BUCKET_ROWS) -> Directory:
    """Directory over distinct ``key`` values, from counts by prefix: at most some 16 rows a bucket reach the driver, as Arrow.

    A bucket that MOST_BITS bits don't split stays overfull; its owner streams it, key by key.
    """
    capacity, bits = max(bucket_rows, keys.count() // BUCKETS), PREFIX_BITS
    while True:
        found = keys.groupBy(_prefix("key", bits).alias("p")).agg(F.count(F.lit(1)).alias("n")).toArrow()
        counts = np.zeros(1 << bits, np.int64)
        counts[found.column("p").to_numpy()] = found.column("n").to_numpy()
        if counts.max() <= capacity or bits >= MOST_BITS:
            return Directory.over(counts, capacity)
        bits += 2


def hash_key(text: Column) -> Column:
    return F.xxhash64(text)


def build_index(docs: DataFrame, key_of=hash_key, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(light rows: doc_id, key, sha; directory: prefix, bucket, depth; index: ENTRY), all stored. ``key_of`` maps the text column to a bigint key."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = for_python(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("key", key_of(F.col("text"))).withColumn("address", address("key"))
    light = stored(rows.select("doc_id", "key", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("bigint").alias("n_bytes")), "exact-rows")
    keys = stored(light.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("doc_id"), F.min("sha").alias("sha"), F.max("n_bytes").alias("n_bytes")), "exact-keys", files_a_core=4)
    made = directory_of(keys, bucket_rows)
    table = pa.table({"prefix": np.arange(len(made.slots)), "bucket": made.slots, "depth": np.full(len(made.slots), made.depth, np.int32)})
    stored_directory = stored(spark.createDataFrame(table), "exact-directory", files_a_core=1)
    directory = spark.sparkContext.broadcast(made)
    repeated = keys.filter("n > 1")
    suspects = bloom.shared_filter(repeated, "key")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of suspected keys, one for each distinct text that a task holds; it holds HELD_BYTES of them at most."""
        held: dict[tuple[int, str], list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            k = np.array([k for k, _ in held], np.int64)
            places = np.array([v[2] for v in held.values()], np.int64)
            return pa.record_batch(
                [pa.array(directory.value.bucket_of(places), pa.int32()), pa.array(k), pa.array([t.encode() for _, t in held], pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())],
                names=["bucket", "key", "text", "doc_id", "n"],
            )

        for batch in batches:
            key, place = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
            for i in np.flatnonzero(bloom.may_hold(suspects, batch.column(2))).tolist():
                doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if (seen := held.get((key[i], text))) is None:
                    held[key[i], text] = [doc, 1, place[i]]
                    size += len(text)
                else:
                    seen[1] += 1
                    seen[0] = doc if seen[0] is None else seen[0] if doc is None else max(seen[0], doc)
                if size > HELD_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains of one key at a time; rows arrive sorted by key."""
        at, chain = None, []
        done: list[tuple] = []

        def close() -> None:
            for slot, (text, doc, n) in enumerate(chain):
                done.append((at[0], at[1], slot, hashlib.sha256(text).digest(), len(text), doc, n))

        for batch in batches:
            for bucket, key, text, doc, n in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (bucket, key):
                    close()
                    at, chain = (bucket, key), []
                for link in chain:
                    if link[0] == text:
                        link[1] = doc if link[1] is None else link[1] if doc is None else max(link[1], doc)
                        link[2] += n
                        break
                else:
                    chain.append([text, doc, n])
            if len(done) > 10_000:
                yield _entries(done)
                done.clear()
        close()
        if done:
            yield _entries(done)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = ~bloom.may_hold(suspects, batch.column(0))
            part = batch.filter(pa.array(single))
            places = part.column(4).to_numpy().astype(np.int64)
            yield pa.record_batch(
                [pa.array(directory.value.bucket_of(places), pa.int32()), part.column(0), pa.array(np.zeros(part.num_rows, np.int32)), part.column(1), part.column(2), part.column(3), pa.array(np.ones(part.num_rows, np.int64))],
                names=["bucket", "key", "slot", "sha", "n_bytes", "keep_id", "group_size"],
            )

    parts = max(len(made.local), int(spark.conf.get("spark.sql.shuffle.partitions")))
    chained = rows.mapInArrow(combine, "bucket int, key bigint, text binary, doc_id bigint, n bigint").repartition(parts, "bucket", F.shiftrightunsigned(address("key"), 56)).sortWithinPartitions("bucket", "key").mapInArrow(own, ENTRY)
    # A key outside the filter is in no chain; a key found once that the filter lets through is.
    alone = keys.select("key", "sha", "n_bytes", "doc_id", address("key")).mapInArrow(place, ENTRY)
    index = chained.unionAll(alone).repartition(len(made.local), "bucket").sortWithinPartitions("bucket", "key")
    return light, stored_directory, stored(index, "exact-index", files_a_core=4)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["bucket", "key", "slot", "sha", "n_bytes", "keep_id", "group_size"])


def look_up(rows: DataFrame, directory: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` (key, sha, ...) with keep_id and group_size of their text, through the directory; rows of other texts are left out."""
    depth = directory.agg(F.max("depth")).first()[0]
    placed = rows.withColumn("prefix", _prefix("key", depth)).join(directory.select("prefix", "bucket"), "prefix").drop("prefix")
    return placed.join(index.select("bucket", "key", "sha", "keep_id", "group_size"), ["bucket", "key", "sha"])


def exact_dedup(docs: DataFrame, key_of=hash_key, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    with scratch() as keep:
        light, directory, index = map(keep, build_index(docs, key_of, bucket_rows))
    found = look_up(light.select("doc_id", "key", "sha"), directory, index)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
