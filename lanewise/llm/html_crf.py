"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each leaf block (see ``html_blocks``) is labelled main or other. Features are the tags and the class and id
words of its ancestors, and shape features of its text: length, link density, sentence ends, key words,
place on the page. Weights and transitions maximise the likelihood of labelled pages (``html_pages`` writes them, from a
seed), by Adam on gradients of the forward-backward recursion; Viterbi decodes. The main blocks' texts are joined
in page order by two newlines. Nothing is dropped or capped otherwise.

A null or empty page has the empty text. Rows without page_id or url keep their places, repeated rows are pages of their own, an
empty table gives an empty table, and other columns of any name are not read. Time and memory are linear in a page, however long or deeply nested.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_blocks import Block, Place, leaf_blocks
from .html_pages import labelled_pages
from .shared import exists, for_python, rename, shared_dir, stored

FEATURES = 1 << 14
DENSE = 40  # key words tell something where one of so many words is one, digits where one of so many characters is one
PAGES, EPOCHS, SEED = 1500, 120, 5
_KEYWORDS = re.compile(
    r"\b(cookies?|consent|privacy|accept|subscribe|newsletter|sign ?(?:up|in)|log ?(?:in|out)|register|advert\w*|sponsor\w*|promo\w*|copyright|all rights|share|tweet|comments?|repl(?:y|ies)|said|read more|related|next|previous|home|menu|search|contact|terms|tags?|posted|"
    r"anzeige|werbung|kommentare?|datenschutz|impressum|publicité|commentaires?|abonne\w*|partager|publicidad|comentarios?|compartir|suscr\w*)\b|©"
)

@lru_cache(maxsize=1 << 16)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) & (FEATURES - 1)


def _own_names(place: Place | None) -> list[str]:
    """Features of the innermost element and the one around it."""
    if place is None:
        return []
    up = place.up
    return [f"own {place.tag}", f"pair {up.tag if up else '-'} {place.tag}", *(f"own name {w}" for w in place.names), *(f"up {w}" for w in (up.names if up else ()))]


def path_features(place: Place | None) -> list[int]:
    names, at = ["bias", *_own_names(place)], place
    while at is not None:
        names += at.new
        at = at.up
    return [_slot(x) for x in names]


def _bucket(value: float, edges: tuple) -> int:
    return sum(value >= e for e in edges)


def text_features(block: Block, at: int, n: int) -> list[int]:
    text = block.text
    words = text.count(" ") + 1
    size = _bucket(words, (2, 4, 8, 15, 30, 60))
    link = _bucket(block.linked / len(text), (0.01, 0.25, 0.6, 0.9))
    ends = text[-1] in ".!?…:;\"'”»)"
    tag = block.place.tag if block.place else "-"
    names = [f"size {size}", f"link {link}", f"ends {ends}", f"size {size} link {link} ends {ends}", f"{tag} size {size} ends {ends}", f"place {_bucket(at / n, (0.1, 0.3, 0.7, 0.9))}", f"first {min(at, 3)}", f"last {min(n - 1 - at, 3)}"]
    if (keys := _KEYWORDS.findall(text.lower())) and DENSE * len(keys) >= words:
        names += [f"key {k}" for k in set(keys)]
    if DENSE * sum(map(text.count, "0123456789")) >= len(text):
        names.append("digit")
    return [_slot(x) for x in names]


def features(blocks: list[Block]) -> list[list[int]]:
    return [path_features(b.place) + text_features(b, i, len(blocks)) for i, b in enumerate(blocks)]


@dataclass
class Crf:
    """State 1 is main. ``weights`` are those of state 1; ``steps[a, b]`` is the score of b after a."""

    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray
    def path_score(self, place: Place | None) -> float:
        """Sum of the weights of ``path_features``; each element of a page adds its own to its ancestors' sum once."""
        if place is None:
            return float(self.weights[_slot("bias")])
        todo, at = [], place
        while at is not None and at.inner is None:
            todo.append(at)
            at = at.up
        for p in reversed(todo):
            p.inner = (p.up.inner if p.up else float(self.weights[_slot("bias")])) + sum(float(self.weights[_slot(x)]) for x in p.new)
        if place.score is None:
            place.score = place.inner + sum(float(self.weights[_slot(x)]) for x in _own_names(place))
        return place.score

    def emissions(self, blocks: list[Block]) -> list[float]:
        return [self.path_score(b.place) + float(self.weights[text_features(b, i, len(blocks))].sum()) for i, b in enumerate(blocks)]

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """The best labelling; of equal ones, that with the earlier other."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        back: list[tuple[int, int]] = []
        e = self.emissions(blocks)
        zero, one = float(self.start[0]), float(self.start[1]) + e[0]
        for x in e[1:]:
            a, b = zero + s00, one + s10
            c, d = zero + s01, one + s11
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), max(c, d) + x
        state = int(one > zero)
        out = [state]
        for pair in reversed(back):
            state = pair[state]
            out.append(state)
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], epochs: int = EPOCHS) -> Crf:
    """Maximum likelihood with a small quadratic penalty; all pages in each step, the longest first, block by block."""
    pages = sorted((p for p in pages if p[1]), key=lambda p: -len(p[1]))
    size = np.array([len(y) for _, y in pages])
    b, t = len(pages), int(size.max())
    on = [int((size > k).sum()) for k in range(t)]  # pages that have a block k
    live = np.arange(t)[:, None] < size
    y = np.zeros((t, b), np.int64)
    for i, (_, labels) in enumerate(pages):
        y[: len(labels), i] = labels
    slots = np.array([s for f, _ in pages for own in f for s in own])
    owner = np.repeat([k * b + i for i, (f, _) in enumerate(pages) for k in range(len(f))], [len(own) for f, _ in pages for own in f])
    params = [np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    seen = live[1:]
    pairs = np.array([[(seen & (y[:-1] == p) & (y[1:] == q)).sum() for q in (0, 1)] for p in (0, 1)], float)
    starts = np.bincount(y[0], minlength=2).astype(float)
    last = (size - 1, np.arange(b))
    alpha, beta = np.zeros((2, t, b)), np.zeros((2, t, b))
    for step in range(1, epochs + 1):
        w, steps, start = params
        e = np.zeros((2, t, b))
        e[1] = np.bincount(owner, w[slots], b * t).reshape(t, b)
        alpha[:, 0] = start[:, None] + e[:, 0]
        for k in range(1, t):
            n = on[k]
            before = alpha[:, k - 1, :n]
            for q in (0, 1):
                alpha[q, k, :n] = np.logaddexp(before[0] + steps[0, q], before[1] + steps[1, q]) + e[q, k, :n]
        total = np.logaddexp(alpha[0][last], alpha[1][last])
        beta[:] = 0
        for k in range(t - 2, -1, -1):
            n = on[k + 1]
            after = e[:, k + 1, :n] + beta[:, k + 1, :n]
            for p in (0, 1):
                beta[p, k, :n] = np.logaddexp(steps[p, 0] + after[0], steps[p, 1] + after[1])
        one = np.where(live, np.exp(np.where(live, alpha[1] + beta[1] - total, 0)), 0)
        expected = np.zeros((2, 2))
        for p in (0, 1):
            for q in (0, 1):
                expected[p, q] = np.exp(np.where(seen, alpha[p, :-1] + steps[p, q] + e[q, 1:] + beta[q, 1:] - total, -np.inf)).sum()
        slip = (one - y * live).ravel()
        first_block = np.exp(alpha[:, 0] + beta[:, 0] - total).sum(axis=1)
        grads = [np.bincount(slots, slip[owner], FEATURES) / b + 1e-4 * w, (expected - pairs) / b + 2e-4 * steps, (first_block - starts) / b]
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(*params)


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED) -> Crf:
    """The model of ``pages`` labelled pages written from ``seed``."""
    made = []
    for html, main in labelled_pages(pages, seed):
        blocks = leaf_blocks(html)
        made.append((features(blocks), [int(b.text in main) for b in blocks]))
    return train(made)


_SOURCES = ("html_blocks.py", "html_crf.py", "html_pages.py")


def trained_once(spark: SparkSession) -> Crf:
    """The model of ``trained``, kept as a small table in the shared folder, so that later sessions read it.

    The table is named by a digest of the reader's, the writer's and this module's source: a change trains anew.
    """
    digest = sha256(b"".join((Path(__file__).parent / n).read_bytes() for n in _SOURCES)).hexdigest()[:24]
    path = f"{shared_dir(spark)}/html-crf-{digest}"
    schema = "weights array<double>, steps array<double>, start array<double>"
    if not exists(spark, f"{path}/_SUCCESS"):
        made = trained()
        rows = spark.createDataFrame([(made.weights.tolist(), made.steps.ravel().tolist(), made.start.tolist())], schema)
        rename(spark, stored(rows, "html-crf")._stored_at, path)
    found = spark.read.schema(schema).parquet(path).first()
    return Crf(np.array(found["weights"]), np.array(found["steps"]).reshape(2, 2), np.array(found["start"]))


def main_text(html: str | None, model: Crf) -> str:
    blocks = leaf_blocks(html or "")
    return "\n\n".join(b.text for b, y in zip(blocks, model.viterbi(blocks)) if y)


def extract_main(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained_once(pages.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [main_text(h.as_py(), model) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = for_python(pages).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
