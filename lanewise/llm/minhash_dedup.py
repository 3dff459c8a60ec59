"""Near-duplicate documents by MinHash: banding, signature verification, exact confirmation, components.

A document's set is its distinct ``width``-word shingles (words as in ``textkit``); a document of
fewer words has its whole sequence as its one shingle, a document without words has the empty set
and is linked with nothing. Two documents are linked when 100 * |A & B| >= threshold * |A | B|.

1. Sign. One pass makes, per document, the set's size, a 128-bit digest of the set, and one key per
   band of its MINIMA universal minima (``bands_for`` cuts them by the threshold). Rows with equal sets form a class; its
   smallest doc_id represents it, so a group of copies of any size goes on as one row.
2. Candidates. Every representative is tied to the smallest one in each of its band buckets (a
   pre-aggregated minimum, one tie a row, no pairs). Alternating large-star and small-star turn the ties
   into clusters, which hold all pairs that share a bucket.
3. Verify. A second pass makes sets and signatures of the clustered representatives only, which a
   Bloom filter picks out, or a join where they are too many for one. A cluster that fits is one tile. A larger one is dealt
   twice at random into tiles of bounded size, which connects most of it at a cost in proportion to
   its rows; only rows outside its main component then meet all others, by pairs of bounded blocks of
   like set size, since pairs within the component are connected. In a tile, pairs pass the
   signatures' estimate first (MARGIN is six standard errors below the threshold) and are then confirmed on
   full sets; connected pairs are skipped. A tile returns its components, as stars.
4. Components of the confirmed links, then of every row by its class.

Words have 128-bit hashes and so have shingles; sets are compared by both halves. Rows of one doc_id are one document; rows without
doc_id are linked with nothing (component_id null, kept). An empty table gives an empty table; other columns of any name are not
read. A long text is held whole by the task that reads it, and so is its set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, textkit
from .bloom import mix
from .graph import as_stars, components
from .shared import for_python, scratch, stored, tasks_for

MINIMA = 256
MISS = 1e-5  # at most so often do all bands miss a pair at the threshold
SCREEN = 128  # minima that screen pairs, counted in a byte
MARGIN = 0.215
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 18
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, MINIMA, np.uint32)
_W = _rng.integers(0, 1 << 63, (64, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(threshold: int) -> tuple[int, int]:
    """(bands, rows a band): the longest bands that miss a pair at the threshold with a probability of at most MISS.

    Long bands keep documents that merely resemble each other out of one bucket.
    """
    return max(((MINIMA // r, r) for r in range(1, 17) if (1 - (threshold / 100) ** r) ** (MINIMA // r) <= MISS), key=lambda x: x[1], default=(MINIMA, 1))


def shingle_hashes(counts: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles per text, their (n, 2) hashes, repeats included) from words per text and (words, 2) hashes."""
    ends = np.cumsum(counts)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    if len(hashes) >= width:
        rolled = hashes[: len(hashes) - width + 1] * _W[0]
        for k in range(1, width):
            rolled += hashes[k : len(hashes) - width + 1 + k] * _W[k]
        rolled = mix(rolled)
    else:
        rolled = np.zeros((0, 2), np.uint64)
    starts = ends - counts
    first = np.cumsum(n) - n
    index = np.repeat(starts - first, n) + np.arange(n.sum())
    out = rolled[np.minimum(index, max(0, len(rolled) - 1))] if len(rolled) else np.zeros((len(index), 2), np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = hashes[starts[i] : ends[i]]
        out[first[i]] = mix((own * _W[: len(own)]).sum(axis=0, dtype=np.uint64) + np.uint64(len(own)))
    return n, out


def minima(n: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """(texts with shingles, MINIMA) uint32 minima of the universal hashes a * x + b modulo 2**32 of the shingles' high halves."""
    starts = np.cumsum(n) - n
    starts = starts[n > 0]
    out = np.empty((len(starts), MINIMA), np.uint32)
    if len(starts):
        x = (shingles[:, 0] >> np.uint64(32)).astype(np.uint32)
        held = np.empty_like(x)
        for j in range(MINIMA):
            np.multiply(x, _A[j], out=held)
            held += _B[j]
            out[:, j] = np.minimum.reduceat(held, starts)
    return out


def distinct(shingles: np.ndarray) -> np.ndarray:
    """The different rows of (n, 2) hashes, in order."""
    out = shingles[np.argsort(shingles[:, 0])]
    same = out[1:] == out[:-1]
    if (same[:, 0] & ~same[:, 1]).any():  # one half is equal by chance: order by both
        out = out[np.lexsort((out[:, 1], out[:, 0]))]
        same = out[1:] == out[:-1]
    return out[np.r_[True, ~same.all(axis=1)]] if len(out) else out


def _sets(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(indices of texts, shingles per text, minima, distinct shingles of each text)."""
    for at, counts, hashes in textkit.words(texts):
        n, shingles = shingle_hashes(counts, hashes, width)
        cuts = np.cumsum(n)
        yield at, n, minima(n, shingles), [distinct(shingles[b - k : b]) for b, k in zip(cuts, n)]


def _digest(own: np.ndarray) -> tuple[int, int]:
    high, low = mix(own ^ _W[9]).sum(axis=0, dtype=np.uint64).view(np.int64)
    return int(high), int(low)


def _binary_texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).to_pylist()]


def sign(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2, bands; d1 to bands are null for the empty set."""
    n_bands, n_rows = bands_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            count = np.zeros(size, np.int64)
            digests: list[tuple] = [(None, None)] * size
            bands: list = [None] * size
            for at, n, low, sets in _sets(_binary_texts(batch, 1), width):
                keys = mix((low[:, : n_bands * n_rows].reshape(-1, n_bands, n_rows).astype(np.uint64) * _W[:n_rows, 0]).sum(axis=2, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64) * _W[40, 0]).view(np.int64)
                row = iter(keys)
                for i, own in zip(at, sets):
                    count[i] = len(own)
                    if len(own):
                        digests[i], bands[i] = _digest(own), next(row)
            d1, d2 = zip(*digests) if size else ((), ())
            yield pa.record_batch([batch.column(0), pa.array(count), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return _rows(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>")


def _rows(docs: DataFrame) -> DataFrame:
    return for_python(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def links_in_tile(side: np.ndarray, sets: list[np.ndarray], signatures: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between rows of a tile; ``side`` 0 and 1 meet only each other, 2 meets all.

    Signatures screen the pairs. A row that has candidates it is not connected with gets its exact
    intersections with all rows at once, from the rows listed under each of its shingles.
    """
    size = np.array([len(s) for s in sets])
    m = len(sets)
    agree = np.zeros((m, m), np.uint8)
    for column in signatures.T[:SCREEN]:
        agree += column[:, None] == column[None, :]
    may = agree >= math.floor((threshold / 100 - MARGIN) * SCREEN)
    may &= 100 * np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :])
    if (side != 2).any():
        may &= side[:, None] != side[None, :]
    np.fill_diagonal(may, False)
    if not may.any():
        return []
    row = np.repeat(np.arange(m), size)
    both_halves = np.concatenate(sets)
    high, low = (np.unique(both_halves[:, k], return_inverse=True)[1] for k in (0, 1))
    _, shingle = np.unique(high * (int(low.max()) + 1) + low, return_inverse=True)
    listed = row[np.argsort(shingle, kind="stable")]
    ends = np.cumsum(np.bincount(shingle))
    cuts = np.cumsum(size)
    label, found = np.arange(m), []
    for i in np.flatnonzero(may.any(axis=1)).tolist():
        js = np.flatnonzero(may[i])
        js = js[label[js] != label[i]]
        if not len(js):
            continue
        own = shingle[cuts[i] - size[i] : cuts[i]]
        first = np.where(own > 0, ends[own - 1], 0)
        n = ends[own] - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(listed[at], minlength=m)[js]
        js = js[100 * both >= threshold * (size[i] + size[js] - both)]
        for other, j in zip(*(x.tolist() for x in np.unique(label[js], return_index=True))):
            label[label == other] = label[i]
            found.append((i, int(js[j])))
    return found


_ROW = ("rep", "set", "signature")


def _first_tiles(members: DataFrame, totals: DataFrame) -> DataFrame:
    """Each small cluster in a tile of its own; each row of a large one in two tiles, one of each of two random dealings."""
    sized = members.join(totals, "cluster")
    dealt = lambda k: F.pmod(F.xxhash64("rep", F.lit(k)), F.col("blocks"))
    tiles = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.array(dealt(1), F.col("blocks") + dealt(2)))
    return sized.select(F.explode(tiles).alias("i"), "cluster", *_ROW).select(F.xxhash64("cluster", "i").alias("tile"), F.lit(2).alias("side"), *_ROW)


def _rest_tiles(large: DataFrame, threshold: int) -> DataFrame:
    """Tiles for what the first left open in large clusters (``large`` has the component found so far).

    Pairs inside a cluster's main component, that of most rows, are connected already. The rows outside
    it (side 0) meet all rows (side 1) of their own and the next cells of set size, by blocks of both.
    Every sum is over a stored table, so that it is pre-aggregated whatever the join before it was.
    """
    large = stored(large, "large-clusters")
    counts = large.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("m"))
    main = stored(counts.groupBy("cluster").agg(F.max(F.struct("m", -F.col("component"))).alias("top")).select("cluster", (-F.col("top.col2")).alias("main")), "mains", files_a_core=1)
    cell = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold / 100 - 0.001))).cast("int")
    rows = stored(large.join(main, "cluster").withColumn("outside", F.col("component") != F.col("main")).withColumn("cell", cell).drop("component", "main"), "large-rows")
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES))
    out = F.col("outside")
    cells = stored(
        rows.groupBy("cluster", "cell").agg(
            blocks(F.sum(F.when(out, 1).otherwise(0)), F.sum(F.when(out, F.col("n")).otherwise(0))).cast("int").alias("few"), blocks(F.count(F.lit(1)), F.sum("n")).cast("int").alias("all")
        ),
        "cells",
        files_a_core=1,
    )
    near = cells.select("cluster", F.explode(F.array(*(F.col("cell") + k for k in (-1, 0, 1)))).alias("cell"), F.struct(F.col("cell").alias("of"), "few", "all").alias("next"))
    near = stored(near.groupBy("cluster", "cell").agg(F.collect_list("next").alias("next")), "next-cells", files_a_core=1)
    own = cells.withColumnsRenamed({"few": "own_few", "all": "own_all"})
    rows = rows.join(own, ["cluster", "cell"]).join(near, ["cluster", "cell"])
    block = lambda n: F.pmod(F.xxhash64("rep", F.lit(3)), n).cast("int")
    made = F.struct

    def tiles(side: int):
        """For side 0 a tile for each block of all rows nearby, for side 1 one for each block of outside rows nearby."""

        def of(x):
            many = F.sequence(F.lit(0), (x["all"] if side == 0 else x["few"]) - 1)
            if side == 0:
                one = lambda y: made(F.col("cell").alias("a"), block(F.col("own_few")).alias("i"), x["of"].alias("b"), y.alias("j"))
            else:
                one = lambda y: made(x["of"].alias("a"), y.alias("i"), F.col("cell").alias("b"), block(F.col("own_all")).alias("j"))
            return F.transform(many, one)

        return F.flatten(F.transform(F.filter("next", lambda x: (x["all"] if side == 0 else x["few"]) > 0), of))

    each = [rows.filter("outside"), rows]
    parts = [each[k].select("cluster", *_ROW, F.explode(tiles(k)).alias("t"), F.lit(k).alias("side")) for k in (0, 1)]
    return parts[0].unionAll(parts[1]).select(F.xxhash64("cluster", "t.a", "t.i", "t.b", "t.j").alias("tile"), "side", *_ROW)


def _verify(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            sets = [np.frombuffer(s, np.uint64).reshape(-1, 2) for _, _, s, _ in held]
            low = np.stack([np.frombuffer(s, np.uint32) for _, _, _, s in held])
            got = links_in_tile(np.array([s for s, *_ in held]), sets, low, threshold)
            stars = as_stars([(held[i][1], held[j][1]) for i, j in got])
            return pa.record_batch([pa.array([a for a, _ in stars], pa.int64()), pa.array([b for _, b in stars], pa.int64())], names=["a", "b"])

        for batch in batches:
            for tile, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != at:
                    if out := close():
                        yield out
                    at, held = tile, []
                held.append(row)
        if out := close():
            yield out

    return run


def _links(tiles: DataFrame, threshold: int, n_bytes: int) -> DataFrame:
    parts = tasks_for(tiles.sparkSession, n_bytes)
    return stored(tiles.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_verify(threshold), "a bigint, b bigint"), "links")


def minhash_dedup(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    with scratch() as keep:
        signed, by_class = map(keep, _solved(docs, width, threshold))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(by_class, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _solved(docs: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``sign``, and the component_id of each class (d1, d2), both stored."""
    signed = stored(sign(docs, width, threshold), "signed")
    named = signed.filter("d1 is not null and doc_id is not null")
    classes = stored(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "classes")
    bands = classes.select("rep", F.explode("bands").alias("key"))
    pivots = stored(bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot < last").select("key", "pivot"), "pivots", files_a_core=4)
    ties = bands.join(pivots, "key").filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    clusters = stored(components(ties).withColumnsRenamed({"node": "rep", "component": "cluster"}), "clusters", files_a_core=4)
    picked = bloom.shared_filter(clusters, "rep")
    texts = _rows(docs)
    if picked is None:
        texts = texts.join(clusters.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(bloom.may_hold(picked, batch.column(0))))
            doc = part.column(0).to_pylist()
            for at, n, low, sets in _sets(_binary_texts(part, 1), width):
                has = [i for i in range(len(at)) if n[i]]
                d = [_digest(sets[i]) for i in has]
                yield pa.record_batch(
                    [pa.array([doc[at[i]] for i in has], pa.int64()), pa.array([x for x, _ in d], pa.int64()), pa.array([x for _, x in d], pa.int64()), pa.array([len(sets[i]) for i in has], pa.int64()), pa.array([sets[i].tobytes() for i in has], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary())],
                    names=["rep", "d1", "d2", "n", "set", "signature"],
                )

    found = texts.mapInArrow(full_sets, "rep bigint, d1 bigint, d2 bigint, n bigint, set binary, signature binary")
    keys = clusters.join(classes.select("rep", "d1", "d2"), "rep")
    members = stored(found.join(keys, ["rep", "d1", "d2"]).select("cluster", "rep", "n", "set", "signature"), "members")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("bigint")
    totals = stored(members.groupBy("cluster").agg(blocks.alias("blocks"), F.sum("n").alias("shingles")), "totals", files_a_core=1)
    shingles = totals.agg(F.sum(F.when(F.col("blocks") > 1, 2 * F.col("shingles")).otherwise(F.col("shingles")))).first()[0] or 0
    links = _links(_first_tiles(members, totals.select("cluster", "blocks")), threshold, 16 * shingles)
    linked = components(links)
    if not totals.filter("blocks > 1").isEmpty():
        linked = stored(linked, "first-components", files_a_core=4).withColumnsRenamed({"node": "rep"})
        large = members.join(totals.filter("blocks > 1"), "cluster").join(linked, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        tiles = _rest_tiles(large.drop("blocks", "shingles"), threshold)
        rest = _links(tiles, threshold, tiles.agg(F.sum(F.length("set"))).first()[0] or 0)
        linked = components(rest.unionAll(linked.select("rep", "component")))
    component = F.coalesce("component", "rep").alias("component_id")
    return signed, stored(classes.select("d1", "d2", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", component), "class-components", files_a_core=4)
