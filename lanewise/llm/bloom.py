"""Bloom filters: one that is broadcast while its size is checked, and pairs of once-seen and twice-seen filters by key range.

A filter is a row of segments of 2**16 bits. A key's segment comes from the high half of a mixed
64-bit hash and its three bits from the low half, so a key touches one segment only.

``of_column`` makes one filter of a whole column, to be broadcast: tasks send the offsets that they set, segments are merged on the executors.
Its size follows the number of keys and is checked: above MOST_KEYS there is no filter (None), and its users take the plain
join that stands beside each use. ``suspects`` has no such bound: keys are dealt into ranges of bounded size, and each range has its own pair of
filters where its keys are. A filter never loses a key, and users confirm exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import for_python, scratch, stored

SEGMENT = 1 << 16
CEILING = 1 << 28  # bits of a filter that is broadcast: 32 MB
BITS_A_KEY = 16
MOST_KEYS = CEILING // 8  # eight bits a key at least: beyond, a filter that is broadcast would tell too little
MERGE_TASKS = 64  # for MOST_KEYS keys at most, three offsets of two bytes each


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segments_for(n_keys: int, ceiling: int = CEILING) -> int:
    bits = min(ceiling, max(SEGMENT, int(n_keys) * BITS_A_KEY))
    return 1 << (bits // SEGMENT - 1).bit_length()


def places(keys: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each key (n,) and its three bit offsets (3, n)."""
    h = mix(keys.view(np.uint64) if keys.dtype == np.int64 else keys)
    segment = ((h >> np.uint64(32)) * np.uint64(n_segments)) >> np.uint64(32)
    offsets = np.stack([(h >> np.uint64(s)) & np.uint64(0xFFFF) for s in (0, 16)] + [((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))])
    return segment.astype(np.int64), offsets.astype(np.int64)


class Filter:
    """The merged bits; ``bits`` is a packed uint8 array of ``n_segments * SEGMENT / 8`` bytes."""

    def __init__(self, bits: np.ndarray, n_segments: int):
        self.bits, self.n_segments = bits, n_segments

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        segment, offsets = places(keys, self.n_segments)
        at = segment[None, :] * SEGMENT + offsets
        return ((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def _grouped(keys: np.ndarray, n_segments: int) -> dict[int, bytes]:
    if not len(keys):
        return {}
    segment, offsets = places(keys, n_segments)
    at = np.unique((segment[None, :] * SEGMENT + offsets).ravel())
    starts = np.flatnonzero(np.r_[True, np.diff(at >> 16) > 0])
    low = (at & 0xFFFF).astype(np.uint16)
    return {int(at[a] >> 16): low[a:b].tobytes() for a, b in zip(starts, np.r_[starts[1:], len(at)])}


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, offsets in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(s, np.zeros(SEGMENT, bool))[np.frombuffer(offsets, np.uint16)] = True
    if held:
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([np.packbits(v).tobytes() for v in held.values()], pa.binary())], names=["segment", "bits"])


def of_column(df: DataFrame, column: str, n_keys: int) -> Filter | None:
    """Filter of a bigint column that holds about ``n_keys`` values; None if they are more than MOST_KEYS."""
    if n_keys > MOST_KEYS:
        return None
    n = segments_for(n_keys)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = _grouped(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64), n)
            yield pa.record_batch([pa.array(list(by), pa.int32()), pa.array(list(by.values()), pa.binary())], names=["segment", "bits"])

    schema = "segment int, bits binary"
    rows = df.select(column).mapInArrow(local, schema).repartition(min(MERGE_TASKS, n), "segment").mapInArrow(_merge, schema).collect()
    bits = np.zeros(n * SEGMENT // 8, np.uint8)
    for segment, data in rows:
        bits[segment * SEGMENT // 8 : (segment + 1) * SEGMENT // 8] = np.frombuffer(data, np.uint8)
    return Filter(bits, n)


def shared_filter(hashes: DataFrame, column: str = "h"):
    """Broadcast of ``of_column``; None if there are too many rows."""
    made = of_column(hashes, column, hashes.count())
    return made and hashes.sparkSession.sparkContext.broadcast(made)


class Pair:
    """Once-seen and twice-seen filters of one range of keys, both packed."""

    def __init__(self, n_keys: int):
        n = segments_for(n_keys, 1 << 62)
        self.once, self.twice = (Filter(np.zeros(n * SEGMENT // 8, np.uint8), n) for _ in range(2))

    @staticmethod
    def _set(f: Filter, keys: np.ndarray) -> None:
        segment, offsets = places(keys, f.n_segments)
        at = (segment[None, :] * SEGMENT + offsets).ravel()
        np.bitwise_or.at(f.bits, at >> 3, (0x80 >> (at & 7)).astype(np.uint8))

    def add(self, once: np.ndarray, twice: np.ndarray) -> None:
        """``once``: distinct keys of one sender; ``twice``: those of them that it saw in two documents itself."""
        self._set(self.twice, np.concatenate([once[self.once.maybe(once)], twice]))
        self._set(self.once, once)


FLUSH = 1 << 18  # entries that a task holds before it sends them
RANGES, LEAST_KEYS, MOST_RANGE_KEYS = 4096, 1 << 18, 1 << 25


def keys_a_range(n_keys: int) -> int:
    """Ranges of LEAST_KEYS, or as many as make RANGES of them; at MOST_RANGE_KEYS (64 MB a filter) there are more ranges instead."""
    return min(MOST_RANGE_KEYS, max(LEAST_KEYS, -(-n_keys // RANGES)))


def suspects(entries: DataFrame, n_entries: int) -> DataFrame:
    """Rows (doc_id bigint, digest binary of 16 bytes) of ``entries`` whose digest may occur with two doc_ids or more.

    1. Tasks deal their entries by ranges of the digest's high half. A digest that a task sees often is one key in what it sends to the filters.
    2. A range's task sets once-seen bits, and twice-seen bits for keys that two senders sent or one saw twice.
    3. The twice-seen filter meets the range's entries, dealt over as many tasks as they need, and lets
       through those in it: about the true repeats, whatever the number of entries.
    """
    spark = entries.sparkSession
    wide = keys_a_range(n_entries)
    n_ranges = max(1, -(-n_entries // wide))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        digests: list[bytes] = []
        size = serial = 0

        def send() -> pa.RecordBatch:
            nonlocal size, serial
            digest = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
            doc = np.concatenate(docs)
            docs.clear(), digests.clear()
            order = np.lexsort((doc, digest[:, 1], digest[:, 0]))
            high, low, doc = digest[order, 0], digest[order, 1], doc[order]
            new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])]
            high, low, doc = high[new], low[new], doc[new]
            of = ((high >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out = []
            for a, b in zip(cuts, np.r_[cuts[1:], len(of)]):
                key, first = np.unique(high[a:b], return_index=True)
                ends = np.r_[first[1:], b - a] - 1
                packed = np.stack([doc[a:b].view(np.uint64), high[a:b], low[a:b]], axis=1)
                out.append((int(of[a]), serial, int(b - a), key.tobytes(), key[doc[a:b][first] != doc[a:b][ends]].tobytes(), packed.tobytes()))
                serial += 1
            size = 0
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["range", "serial", "n", "once", "twice", "entries"])

        for batch in batches:
            if batch.num_rows:
                docs.append(batch.column(0).to_numpy().astype(np.int64))
                digests.append(b"".join(batch.column(1).to_pylist()))
                size += batch.num_rows
                if size >= FLUSH:
                    yield send()
        if size:
            yield send()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pair = None, None
        done = lambda: pa.record_batch([pa.array([at], pa.int32()), pa.array([pair.twice.bits.tobytes()], pa.binary())], names=["range", "bits"])
        for batch in batches:
            for r, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if r != at:
                    if pair:
                        yield done()
                    at, pair = r, Pair(wide)
                pair.add(np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64))
        if pair:
            yield done()

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = None
        for batch in batches:
            for is_entries, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not is_entries:
                    twice = Filter(np.frombuffer(data, np.uint8), segments_for(wide, 1 << 62))
                    continue
                rows = np.frombuffer(data, np.uint64).reshape(-1, 3)
                rows = rows[twice.maybe(rows[:, 1])]
                digest = rows[:, 1:].astype(">u8").tobytes()
                yield pa.record_batch([pa.array(rows[:, 0].view(np.int64)), pa.array([digest[i : i + 16] for i in range(0, len(digest), 16)], pa.binary())], names=["doc_id", "digest"])

    dealt = stored(for_python(entries).select("doc_id", "digest").mapInArrow(deal, "range int, serial bigint, n bigint, once binary, twice binary, entries binary"), "dealt")
    filters = stored(dealt.select("range", "once", "twice").repartition(n_ranges, "range").sortWithinPartitions("range").mapInArrow(build, "range int, bits binary"), "twice")
    sizes = stored(dealt.groupBy("range").agg(F.ceil(F.sum("n") / wide).cast("int").alias("tasks")), "ranges", files_a_core=1)
    tasks = sizes.agg(F.sum("tasks")).first()[0] or 1
    sent = filters.join(sizes, "range").select("range", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"), F.col("bits").alias("data"))
    met = dealt.join(sizes, "range").select("range", F.pmod(F.xxhash64("serial", F.length("entries")), F.col("tasks")).cast("int").alias("task"), F.lit(1), "entries")
    return stored(sent.unionAll(met).repartition(int(tasks), "range", "task").sortWithinPartitions("range", "task", "kind").mapInArrow(test, "doc_id bigint, digest binary"), "suspects")


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``docs``, whole, whose ``keys`` (null-safe) are not among the rows of ``dropped``, which has columns of those names.

    Rows that a filter of the dropped keys clears pass where they are read. Of the others, only keys are compared first:
    those that the filter took wrongly are few, and get a filter of their own, so that dropped rows are
    discarded where they are read and hardly any whole row meets a join. Too many dropped keys for a filter: all rows meet them in a join.
    """
    with scratch() as keep:
        return _without(docs, dropped, keys, keep)


def _without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column], keep) -> DataFrame:
    names = list(keys)
    dropped = stored(dropped.select(*names).distinct(), "dropped", files_a_core=4)
    own = F.xxhash64(*keys.values()).alias("h")
    packed = for_python(docs).select(own, F.struct("*").alias("doc"), F.struct(*(c.alias(n) for n, c in keys.items())).alias("key"))
    seen = shared_filter(dropped.select(F.xxhash64(*names).alias("h")))
    if seen is None:
        every, dropped = packed.select("doc", "key.*"), keep(dropped)
        return every.join(dropped, _same(every, dropped, names), "left_anti").select("doc.*")
    light = docs.select(own, F.struct(*(c.alias(n) for n, c in keys.items())).alias("key"))
    taken = light.mapInArrow(_part(seen, True), light.schema).select("key.*")
    wrongly = keep(stored(taken.join(dropped, _same(taken, dropped, names), "left_anti").distinct(), "wrongly", files_a_core=1))
    again = shared_filter(wrongly.select(F.xxhash64(*names).alias("h")))
    clear = packed.mapInArrow(_part(seen, False), packed.schema)
    unsure = packed.mapInArrow(_part(seen, True, again), packed.schema).select("doc", "key.*")
    return clear.select("doc.*").unionAll(unsure.join(wrongly, _same(unsure, wrongly, names), "left_semi").select("doc.*"))


def one_of_each(docs: DataFrame, repeated: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The least row of ``docs``, whole, of each of the ``keys`` (null-safe) in ``repeated``, which has columns of those names, each row once.

    Rows of a key are combined in each task before they meet, so a hot key is one row a task.
    """
    names = list(keys)
    seen = shared_filter(repeated.select(F.xxhash64(*names).alias("h")))
    packed = for_python(docs).select(F.xxhash64(*keys.values()).alias("h"), F.struct("*").alias("doc"), F.struct(*(c.alias(n) for n, c in keys.items())).alias("key"))
    if seen is not None:
        packed = packed.mapInArrow(_part(seen, True), packed.schema)
    least = packed.select("doc", "key.*").groupBy(*names).agg(F.min("doc").alias("doc"))
    return least.join(repeated, _same(least, repeated, names), "left_semi").select("doc.*")


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def _part(first, wanted: bool, second=None):
    """Keep the rows whose hash, in column 0, is ``wanted`` in the first filter, and in the second if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().astype(np.int64)
            keep = first.value.maybe(h) == wanted
            if second is not None:
                keep &= second.value.maybe(h)
            yield batch.filter(pa.array(keep))

    return run


def may_hold(found, ids: pa.Array) -> np.ndarray:
    """Whether each id, if not null, may be in a broadcast filter; without a filter any id may."""
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    return there if found is None else there & found.value.maybe(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
