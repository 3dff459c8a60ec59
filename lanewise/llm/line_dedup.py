"""Line deduplication with two Bloom filters.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. A key of at
least ``min_chars`` code points that occurs in two documents or more loses all its lines, except in
the smallest doc_id that holds it. Lines are split at \\n only; a null or empty text is one empty line.

1. Every document gives its keys as 128 bits of SHA-256 each; these meet the once-seen and twice-seen filters of their
   range (see ``bloom.suspects``), which grow with the input. No text moves.
2. Only keys that the twice-seen filter lets through are confirmed exactly, by their digests: the first document of a
   key and whether there is another come from a pre-aggregated minimum and maximum.
3. Only texts of documents that lose a line are shuffled, picked by a filter of bounded size, to meet their dropped keys;
   where those documents are too many for such a filter, all texts are.

Rows without doc_id hold lines of no document: they stay whole and count for nothing. Rows of one
doc_id are one document, and rows that repeat are each cut alike. An empty table gives an empty table; other columns, of
any name, are not read. A long text is held whole by the task that reads it, and so are the dropped keys of one doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .shared import for_python, scratch, stored

_WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(_WHITE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode(errors="replace")) < min_chars):
        return None
    return key


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    return {k for line in (text or b"").split(b"\n") if (k := line_key(line, min_chars)) is not None}


def _digest(key: bytes) -> bytes:
    return sha256(key).digest()[:16]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes | None]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def line_dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text (kept lines), n_lines, n_dropped."""
    rows = for_python(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    n_lines = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            out: list[bytes] = []
            for doc, text in _texts(batch):
                if doc is not None:
                    own = _keys(text, min_chars)
                    ids += [doc] * len(own)
                    out += map(_digest, own)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "digest"])

    with scratch() as keep:
        suspects = bloom.suspects(rows.mapInArrow(digests, "doc_id bigint, digest binary"), n_lines)
        # Stored, so that the join below has plain exchanges and a hot key's rows can be split.
        first = stored(suspects.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first"), "line-first", files_a_core=4)
        drops = suspects.join(first, "digest").filter("doc_id > first").select("doc_id", "digest")
        # Stored as well, so that the texts' side of the last join can be split where a doc_id has many rows.
        by_doc = keep(stored(drops.groupBy("doc_id").agg(F.collect_set("digest").alias("gone")), "line-drops", files_a_core=4))
    losers = bloom.shared_filter(by_doc, "doc_id")

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text, and whether its document may lose lines."""
        for batch in batches:
            may = bloom.may_hold(losers, batch.column(0))
            n = [0 if m else (t or b"").count(b"\n") + 1 for m, t in zip(may, batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(may)], names=["doc_id", "text", "n_lines", "may"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            n_all: list[int] = []
            n_out: list[int] = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = (text or b"").split(b"\n")
                gone = set(gone or ())
                kept = [x for x in lines if (k := line_key(x, min_chars)) is None or _digest(k) not in gone] if gone else lines
                out.append(b"\n".join(kept))
                n_all.append(len(lines))
                n_out.append(len(lines) - len(kept))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary()), pa.array(n_all, pa.int64()), pa.array(n_out, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    sorted_out = rows.mapInArrow(sort_out, "doc_id bigint, text binary, n_lines bigint, may boolean")
    whole = sorted_out.filter("not may").select("doc_id", F.coalesce(F.col("text"), F.lit(b"")).alias("text"), "n_lines", F.lit(0).cast("bigint").alias("n_dropped"))
    cut_out = sorted_out.filter("may").select("doc_id", "text").join(by_doc, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(cut, "doc_id bigint, text binary, n_lines bigint, n_dropped bigint")
    return whole.unionAll(cut_out).withColumn("text", F.col("text").cast("string"))
