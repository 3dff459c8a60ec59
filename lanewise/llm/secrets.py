"""Secret scan: three base patterns, and sliding-window Shannon entropy over candidate strings.

Base kinds, leftmost and non-overlapping per kind: ``assign`` (a key word, = or :, and a value of 12
characters or more), ``access`` (AKIA keys of 18 or more) and ``hex`` (16 or more lower-case hex digits).

Kind ``entropy``: a run of ``[A-Za-z0-9+/_=-]`` of 20 characters or more is cut at its placeholders (strings of letters and digits
that hold ``example``, ``00000000`` and the like). Each character class has a window and a threshold in bits, and every longest string of its characters in a
part is a candidate of that class, so a name, path or ``key=`` before a secret does not move it to a wider class. The window slides over
the candidate; its entropy follows from counts that change by one character in and one out. Windows at or above the
threshold merge into a span. Allowed are candidates that an allow-list pattern matches whole (words, numbers, paths, identifiers,
UUIDs), and spans of a candidate that lie in a base span.

Spans are code-point offsets, end exclusive, ordered by start, then kind as listed in KINDS.
A null text counts as empty. Null doc_ids are kept, repeated rows are scanned each, an empty table gives an empty table, and other
columns of any name are not read. Time is linear in a text, however long its candidates or its rows of separators are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import for_python

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")

#: name, characters, window, threshold in bits. Narrow classes first.
CLASSES = (
    ("hex", re.compile(r"[0-9a-f]{20,}+"), 20, 3.0),
    ("hex", re.compile(r"[0-9A-F]{20,}+"), 20, 3.0),
    ("upper_alnum", re.compile(r"[A-Z0-9]{20,}+"), 20, 3.5),
    ("alnum", re.compile(r"[A-Za-z0-9]{20,}+"), 20, 3.7),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}+"), 20, 3.9),
)
# Alternatives share no string, so that a long row of separators is matched in one way only.
_PIECE = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})?"
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"[A-Z]?[a-z]+|[A-Z]+",  # a word
        r"[0-9]+",  # a number
        rf"{_PIECE}(?:[-_/=+]{_PIECE})*",  # words and short numbers with separators
        r"[a-z]+(?:[A-Z][a-z]+)+[0-9]{0,4}",  # camel case
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # a UUID
    )
)
_LETTERS = re.compile(r"[A-Za-z0-9]+")
_PLACEHOLDER = re.compile(r"example|placeholder|changeme|x{6}|0{8}|abcdefgh|01234567", re.IGNORECASE)


def _plogp(window: int) -> list[float]:
    return [c * math.log2(c) if c else 0.0 for c in range(window + 1)]


def hot_windows(text: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``text`` whose Shannon entropy is at least ``threshold`` bits."""
    if len(text) < window:
        return []
    clog, counts, total = _plogp(window), {}, 0.0
    out: list[tuple[int, int]] = []
    for i, new in enumerate(text):
        c = counts.get(new, 0)
        total += clog[c + 1] - clog[c] if c < window else 0.0
        counts[new] = c + 1
        if i >= window - 1:
            if math.log2(window) - total / window >= threshold - 1e-9:
                start = i + 1 - window
                if out and start <= out[-1][1]:
                    out[-1] = out[-1][0], i + 1
                else:
                    out.append((start, i + 1))
            old = text[i + 1 - window]
            c = counts[old]
            total += clog[c - 1] - clog[c]
            counts[old] = c - 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end)"""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def _parts(run: str) -> Iterator[tuple[int, str]]:
    """(start, text) of what lies between the placeholders of a run."""
    at = 0
    if _PLACEHOLDER.search(run):
        for m in _LETTERS.finditer(run):
            if _PLACEHOLDER.search(m[0]):
                yield at, run[at : m.start()]
                at = m.end()
    yield at, run[at:]


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    # Spans of one kind don't overlap, so the last that starts at or before a string is the only one that may hold it.
    known = [([x for x, k, _ in base if k == kind], [y for _, k, y in base if k == kind]) for kind in range(3)]
    for m in _CANDIDATE.finditer(text):
        hot = set()
        for at, part in _parts(m[0]):
            if len(part) < 20 or any(p.fullmatch(part) for p in ALLOWED):
                continue
            for _, characters, window, threshold in CLASSES:
                for c in characters.finditer(part):
                    if not any(p.fullmatch(c[0]) for p in ALLOWED):
                        start = m.start() + at + c.start()
                        hot.update((start + a, start + b) for a, b in hot_windows(c[0], window, threshold))
        for a, b in sorted(hot):
            if any((i := bisect_right(s, a)) and e[i - 1] >= b for s, e in known):
                continue
            if out and a <= out[-1][2]:
                out[-1] = out[-1][0], 3, max(out[-1][2], b)
            else:
                out.append((a, 3, b))
    return out


def find_spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + entropy_spans(text, base))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, spans array<struct<kind, start, end>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    return for_python(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) of ``find_secrets``'s rows."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind != "entropy")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
