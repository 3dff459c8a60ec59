"""SentencePiece encoding and decoding with a unigram Viterbi over a double-array trie.

A model file (its path is a parameter) gives pieces with log scores. Encoding puts the marker U+2581
for each space, and one in front; the best segmentation maximises the sum of scores; of equal sums the one
whose last piece starts first wins. A character that no piece covers costs 10 less than the lowest
score and is written as its UTF-8 bytes' pieces. Decoding joins pieces, turns markers into spaces and
drops the one put in front, so every text without U+2581 comes back unchanged.

No piece crosses from a letter into a marker, so a text falls into units, one marker run and what
follows it, that are segmented on their own and remembered, within bounds. Units that a batch brings new go
through the trie together, one array step for all; long ones are walked singly. Tables built from the model
are fixed by its vocabulary and broadcast. A null text counts as empty, an empty table gives an empty table, repeated rows are encoded
each, and other columns, of any name, are not read. A long text is encoded whole, in steps in proportion to it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import for_python

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
LONG = 64  # bytes
REMEMBERED = 100_000
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            byte = data[i]
            i += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[i : i + n]
            i += n


class Trie:
    """Double-array trie: from node s by byte c to ``base[s] + c``, if ``check`` there is s."""

    def __init__(self, items: dict[bytes, int]):
        keys = sorted(items)
        room = 1 << 10
        while room < 2 * sum(map(len, keys)) + 1024:
            room *= 2
        self.base, self.check, self.value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
        self.check[0] = 0
        used = np.zeros(room, bool)
        used[0] = True
        todo = [(0, 0, len(keys), 0)]
        low = dense = 1  # no slot below low is free; below dense only single children are placed
        while todo:
            node, a, b, depth = todo.pop()
            if a < b and len(keys[a]) == depth:
                self.value[node] = items[keys[a]]
                a += 1
            if a == b:
                continue
            groups: list[tuple[int, int, int]] = []
            start = a
            for i in range(a + 1, b + 1):
                if i == b or keys[i][depth] != keys[start][depth]:
                    groups.append((keys[start][depth], start, i))
                    start = i
            children = np.array([c for c, _, _ in groups])
            while used[low]:
                low += 1
            if len(children) == 1 and low > children[0]:
                base = low - int(children[0])
            else:
                base = self._fit(used, max(low, dense), children)
                dense = max(dense, base + int(children[0]) - 256)
            at = base + children
            used[at] = True
            self.base[node] = base
            self.check[at] = node
            todo += [(int(n), x, y, depth + 1) for n, (_, x, y) in zip(at, groups)]
        end = int(np.flatnonzero(used)[-1]) + 257  # a child's slot is within 256 of its base
        self.base, self.check, self.value = (np.concatenate([x[:end], np.full(max(0, end - len(x)), f, np.int32)]) for x, f in ((self.base, 0), (self.check, -1), (self.value, -1)))

    @staticmethod
    def _fit(used: np.ndarray, low: int, children: np.ndarray) -> int:
        """The first base at which all children's slots are free."""
        width = 1024
        while True:
            free = low + np.flatnonzero(~used[low : low + width])
            bases = free - children[0]
            bases = bases[(bases > 0) & (bases + 256 < len(used))]
            fits = ~used[bases[:, None] + children].any(axis=1)
            if fits.any():
                return int(bases[fits.argmax()])
            width *= 4


class Model:
    def __init__(self, data: bytes):
        self.pieces: list[bytes] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        self.prefix = True
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b""))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 3:
                self.prefix = bool(dict(_fields(value)).get(3, 1))
        plain = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        if any(MARK in p.lstrip(b"\xe2\x96\x81") for p in plain):
            raise ValueError("a piece has a space marker after its start; units cannot be segmented on their own")
        self.trie = Trie(plain)
        self.unknown = min(self.scores[i] for i in plain.values()) - 10
        self.unknown_id = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.score = np.array(self.scores)
        self.cuts_lines = not any(b"\n" in p for p in plain)
        self.unit = re.compile(b"\n|(?:" + MARK + b")*(?:(?!" + MARK + b")[^\n])+|(?:" + MARK + b")+" if self.cuts_lines else b"(?:" + MARK + b")*(?:(?!" + MARK + b")[\\s\\S])+|(?:" + MARK + b")+")
        out = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, b" ") if k in (NORMAL, USER) else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds)]
        self.length = np.array([len(p) for p in out], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(out), np.uint8)
        self.memory: dict[bytes, bytes] = {}  # of units; a worker keeps it from task to task

    def _ids(self, unit: bytes, at: list[int], ids: list[int]) -> bytes:
        """``at``: starts of the path's pieces and its end; ``ids``: a piece or -1 for an unknown character."""
        out: list[int] = []
        for k, i in enumerate(ids):
            if i >= 0:
                out.append(i)
            else:
                raw = unit[at[k] : at[k + 1]]
                out += [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown_id]
        return np.array(out, np.int32).tobytes()

    def one(self, unit: bytes) -> bytes:
        """Ids of a unit, as int32 bytes."""
        n = len(unit)
        base, check, value, scores = self._lists()
        best, back, via = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            if best[s] == float("-inf") or unit[s] & 0xC0 == 0x80:
                continue
            first = unit[s]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            node, single = 0, False
            for e in range(s, n):
                child = base[node] + unit[e]
                if check[child] != node or not base[node]:
                    break
                node = child
                if (piece := value[node]) >= 0:
                    single |= e + 1 - s == width
                    if (score := best[s] + scores[piece]) > best[e + 1]:
                        best[e + 1], back[e + 1], via[e + 1] = score, s, piece
            e = min(n, s + width)
            if not single and (score := best[s] + self.unknown) > best[e]:
                best[e], back[e], via[e] = score, s, -1
        at, ids = [n], []
        while at[-1]:
            ids.append(via[at[-1]])
            at.append(back[at[-1]])
        return self._ids(unit, at[::-1], ids[::-1])

    @lru_cache(maxsize=1)  # noqa: B019
    def _lists(self):
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores

    def many(self, units: list[bytes]) -> list[bytes]:
        """Ids of units of at most LONG bytes, one array step of the trie for all."""
        size = np.array([len(u) for u in units])
        width = int(size.max())
        text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(len(units), width).astype(np.int32)
        best, back, via = np.full((len(units), width + 1), -np.inf), np.zeros((len(units), width + 1), np.int32), np.full((len(units), width + 1), -1, np.int32)
        best[:, 0] = 0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(width):
            rows = np.flatnonzero((size > s) & (best[:, s] > -np.inf) & ((text[:, s] & 0xC0) != 0x80))
            if not len(rows):
                continue
            first = text[rows, s]
            step = 1 + (first >= 0xC0).astype(np.int32) + (first >= 0xE0) + (first >= 0xF0)
            single = np.zeros(len(units), bool)
            here, node = rows, np.zeros(len(rows), np.int32)
            for e in range(s, width):
                live = size[here] > e
                here, node = here[live], node[live]
                child = base[node] + text[here, e]
                live = (check[child] == node) & (base[node] > 0)
                here, node = here[live], child[live]
                if not len(here):
                    break
                piece = value[node]
                hit = piece >= 0
                got, ids = here[hit], piece[hit]
                score = best[got, s] + self.score[ids]
                better = score > best[got, e + 1]
                up = got[better]
                best[up, e + 1], back[up, e + 1], via[up, e + 1] = score[better], s, ids[better]
                lead = text[got, s]
                single[got[(e + 1 - s) == 1 + (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0)]] = True
            lone = ~single[rows]
            rows, end = rows[lone], np.minimum(s + step[lone], size[rows[lone]])
            score = best[rows, s] + self.unknown
            better = score > best[rows, end]
            rows, end = rows[better], end[better]
            best[rows, end], back[rows, end], via[rows, end] = score[better], s, -1
        # All paths are walked back together; step k of a unit is its k-th piece from the end.
        rows, at = np.arange(len(units)), size.astype(np.int64)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        odd = np.zeros(len(units), bool)  # has an unknown character
        while len(rows):
            ids = via[rows, at]
            odd[rows[ids < 0]] = True
            steps.append((rows, ids))
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        count = np.zeros(len(units), np.int64)
        for rows, _ in steps:
            count[rows] += 1
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]), np.int32)
        for k, (rows, ids) in enumerate(steps):
            flat[ends[rows] - 1 - k] = ids
        data = flat.tobytes()
        out = [data[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), count.tolist())]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.one(units[i])
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as int32 bytes. Units' ids are remembered between calls, about REMEMBERED of them."""
        memory = self.memory
        units = [self.unit.findall((MARK if self.prefix and t else b"") + t.replace(b" ", MARK)) for t in texts]
        if len(memory) > REMEMBERED:
            memory.clear()
        new = [u for u in {u for own in units for u in own} if u not in memory]
        fresh = {u: self.one(u) for u in new if len(u) > LONG}
        short = sorted((u for u in new if len(u) <= LONG), key=len)
        for i in range(0, len(short), 8192):
            part = short[i : i + 8192]
            memory.update(zip(part, self.many(part)))
        if fresh:
            return [b"".join([fresh[u] if u in fresh else memory[u] for u in own]) for own in units]
        return [b"".join(map(memory.__getitem__, own)) for own in units]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        total = int(n.sum())
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(total)
        text = self.blob[at].tobytes()
        return text[1:] if self.prefix and text[:1] == b" " else text


def load(path: str = DEFAULT_MODEL) -> Model:
    return Model(Path(path).read_bytes())


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ids. A null text counts as empty and has no ids."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _parts(batch):
                ids = model.value.encode(part)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.record_batch([batch.column(0).slice(at, len(part)), lists], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def _rows(docs: DataFrame) -> DataFrame:
    return for_python(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _parts(batch: pa.RecordBatch, column: int = 1, size: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows of about ``size`` bytes: their start and texts."""
    at, held, total = 0, [], 0
    for text in batch.column(column):
        held.append(text.as_py() or b"")
        total += len(held[-1])
        if total >= size:
            yield at, held
            at, held, total = at + len(held), [], 0
    if held:
        yield at, held


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids): doc_id, text. Null ids give the empty text; bytes that are not UTF-8 become U+FFFD."""
    model = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.values.to_numpy(zero_copy_only=False)
            ends = column.offsets.to_numpy()
            texts = [_readable(model.value.decode(flat[a:b])) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return for_python(encoded).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def _readable(text: bytes) -> str:
    return text.decode(errors="replace")


def round_trip(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids, decoded_sha256 (of the text decoded from the ids), same (it is the text)."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _parts(batch):
                ids = [np.frombuffer(x, np.int32) for x in model.value.encode(part)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                texts = [model.value.decode(x) for x in ids]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.record_batch(
                    [batch.column(0).slice(at, len(part)), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array([sha256(t).hexdigest() for t in texts]), pa.array([a == b for a, b in zip(texts, part)])],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256", "same"],
                )

    return _rows(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string, same boolean")
