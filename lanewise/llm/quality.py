"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated.

Words are runs of letters and digits (any byte from 0x80 counts as a letter), and runs of punctuation; case
counts. A word's index vector is a sparse vector of small integers drawn from its hash. Its context
vector sums its neighbours' index vectors over the fitting sample, in integers, so that no order of rows changes it. Both are kept at unit length for ROWS hashed words, a table of fixed size. A
document is the mean of its words' index and context vectors, with the norms of both means, how
much neighbouring words agree, and the logarithm of its length; norms and agreement tell repetition from prose.

The network has one hidden layer, is written in numpy and trained by Adam with early stopping. Its logits are divided by a
temperature fitted on rows kept out of the training.

Fitting takes at most ``sample`` labelled documents (a documented bound; those of the smallest hashes of doc_id; of rows that repeat a doc_id, the one of
the least words). Their words stay on the executors: the driver gets the context sums, ROWS * DIM numbers, and FEATURES
numbers a document, whatever the length of the texts. Rows whose crc32(doc_id as text) mod 3 is 1 are held out: their labels are never read.
Inputs of a score are the text's words only. A null text counts as empty; empty texts get the score
of the zero vector. Without a single fitting row, or with labels of one kind only, every score is that share. An empty table gives an empty table,
repeated rows are scored each, a long text is pooled in bounded pieces, and other columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .shared import for_python, scratch, stored

ROWS, DIM, NONZERO, WINDOW = 1 << 16, 48, 4, 2
SAMPLE = 16_000
TOKENS = 1 << 15  # words pooled at a time
HIDDEN = 32
SEED = 11
FEATURES = 2 * DIM + 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def word_rows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices of texts, words per text, table row of each word)"""
    for at, counts, hashes in textkit.whole(texts, textkit.MARKS, False):
        yield at, counts, (hashes >> np.uint64(48)).astype(np.int64)


def index_counts() -> np.ndarray:
    """The index vectors as integers."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((ROWS, DIM), np.int8)
    for _ in range(NONZERO):
        out[np.arange(ROWS), rng.integers(0, DIM, ROWS)] += rng.choice([-1, 1], ROWS).astype(np.int8)
    return out


def context_sums(index: np.ndarray, docs: Iterable[np.ndarray]) -> np.ndarray:
    """Sums of the index vectors of the words up to WINDOW places away from each word."""
    out = np.zeros(index.shape, np.int64)
    for own in docs:
        for s in range(0, len(own), TOKENS):  # a long text in pieces that overlap by the window
            a, b = max(0, s - WINDOW), min(len(own), s + TOKENS + WINDOW)
            part = own[a:b]
            v, near = index[part], np.zeros((len(part), index.shape[1]), np.int32)
            for k in range(1, min(WINDOW, len(part) - 1) + 1):
                near[k:] += v[:-k]
                near[:-k] += v[k:]
            inner = slice(s - a, min(len(own), s + TOKENS) - a)
            part, near = part[inner], near[inner]
            order = np.argsort(part, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(part[order].astype(np.int64)) > 0])
            out[part[order][starts]] += np.add.reduceat(near[order], starts, axis=0)
    return out


def word_vectors(index: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Index and context vector of each word at unit length, side by side; a word never seen has its index vector for both."""
    own = _unit_rows(index.astype(np.float64))
    context = np.where(sums.any(axis=1, keepdims=True), _unit_rows(sums.astype(np.float64)), own)
    return np.concatenate([own, context], axis=1).astype(np.float32)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def _means(vectors: np.ndarray, starts: np.ndarray, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean vector of each text, a bounded number of words at a time; a long text is summed in pieces."""
    out = np.zeros((len(starts), vectors.shape[1]), np.float64)
    for at in range(0, len(rows), TOKENS):
        first = np.searchsorted(starts, at, "right") - 1
        last = np.searchsorted(starts, at + TOKENS, "left")
        cuts = np.maximum(starts[first:last] - at, 0)
        out[first:last] += np.add.reduceat(vectors[rows[at : at + TOKENS]], cuts, axis=0)
    return (out / n).astype(np.float32)


def pool(vectors: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) from words per text and their table rows; zeros for a text without words."""
    out = np.zeros((len(counts), FEATURES), np.float32)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    starts = (np.cumsum(counts) - counts)[has]
    n = counts[has].astype(np.float32)[:, None]
    mean = _means(vectors, starts, rows, n)
    out[has, : 2 * DIM] = mean
    text = np.repeat(np.arange(len(has)), counts[has])
    out[has, 2 * DIM] = np.linalg.norm(mean[:, :DIM], axis=1)
    out[has, 2 * DIM + 1] = np.linalg.norm(mean[:, DIM:], axis=1)
    for lag in (1, 2):  # the next word, and the next but one: a mark may stand between
        same = np.zeros(len(rows), np.float32)
        same[lag:] = (rows[lag:] == rows[:-lag]) & (text[lag:] == text[:-lag])
        out[has, 2 * DIM + 1 + lag] = np.add.reduceat(same, starts) / n[:, 0]
    out[has, 2 * DIM + 4] = np.log1p(n[:, 0]) / 8
    return out


@dataclass
class Network:
    """Standardised features to tanh units to a logit, over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logits(x) / self.temperature).clip(-40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60) -> Network:
    """Adam on mini-batches; every fifth row is kept out to stop early and to fit the temperature."""
    rng = np.random.default_rng(SEED)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    flat = Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(y) < 10 or len(np.unique(y)) < 2:
        return flat
    order = rng.permutation(len(y))
    out, fit = order[::5], np.setdiff1d(order, order[::5])
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    net = Network(mean, scale, rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), flat.b2)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z = ((x - mean) / scale).clip(-8, 8).astype(np.float64)
    best, kept, step = np.inf, None, 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for s in range(0, len(fit), 64):
            b = fit[s : s + 64]
            hidden = np.tanh(z[b] @ params[0] + params[1])
            slip = 1 / (1 + np.exp(-(hidden @ params[2] + params[3]))) - y[b]
            back = slip[:, None] * params[2] * (1 - hidden**2)
            grads = [z[b].T @ back / len(b) + 1e-4 * params[0], back.mean(axis=0), hidden.T @ slip / len(b) + 1e-4 * params[2], np.array([slip.mean()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        loss = _loss(np.tanh(z[out] @ params[0] + params[1]) @ params[2] + params[3], y[out])
        if loss < best:
            best, kept = loss, [p.copy() for p in params]
    net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3][0])
    logits = net.logits(x[out])
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: _loss(logits / t, y[out])))
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for at, counts, rows in word_rows(texts):
            out[at] = self.network.scores(pool(self.vectors, counts, rows))
        return out


CHUNKS = 16  # of the table of context sums, added up in a task each


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` documents of ``labels`` (doc_id, ``label``) that are not held out, and their texts in ``docs``."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    some = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)
    texts = for_python(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list[bytes] = [b""] * batch.num_rows
            for at, counts, rows in word_rows([t or b"" for t in batch.column(2).to_pylist()]):
                ends = np.cumsum(counts)
                for i, a, b in zip(at, ends - counts, ends):
                    packed[i] = rows[a:b].astype(np.uint16).tobytes()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "y", "rows"])

    index = index_counts()

    def unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (np.frombuffer(r.as_py(), np.uint16) for r in batch.column(batch.num_columns - 1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = context_sums(index, (own for batch in batches for own in unpacked(batch)))
        if total.any():
            for i, c in enumerate(np.split(total, CHUNKS)):
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
                held[chunk] = held.get(chunk, 0) + np.frombuffer(data, np.int64)
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["chunk", "sums"])

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Each document alone, so that its neighbours in a batch change nothing.
            x = [pool(vectors.value, np.array([len(own)]), own.astype(np.int64))[0].tolist() for own in unpacked(batch)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    with scratch():
        # At most ``sample`` pairs of integers: bounded, so it may be broadcast.
        found = texts.join(F.broadcast(some), "doc_id").select("doc_id", "y", "text").mapInArrow(to_rows, "doc_id bigint, y int, rows binary")
        chosen = stored(found.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("rows").alias("rows")), "quality-sample", files_a_core=1)
        total = np.zeros((CHUNKS, ROWS * DIM // CHUNKS), np.int64)
        schema = "chunk int, sums binary"
        for chunk, data in chosen.select("rows").mapInArrow(sums, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema).collect():
            total[chunk] = np.frombuffer(data, np.int64)
        table = word_vectors(index, total.reshape(ROWS, DIM))
        vectors = docs.sparkSession.sparkContext.broadcast(table)
        made = chosen.mapInArrow(pooled, "doc_id bigint, y int, x array<float>").orderBy("doc_id").toArrow()
    y = (made.column("y").to_numpy() > 0).astype(np.float64)
    x = np.asarray(made.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(y), FEATURES)
    return Classifier(table, train(x, y))


def score_quality(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores([t or b"" for t in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = for_python(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, classifier: Classifier, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, whose score is at least ``least``; a row without text has the score of the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(shared.value.scores(texts) >= least))

    return for_python(docs).mapInArrow(run, schema)
