"""Embedding near-duplicates: exact threshold pairs by a dual traversal of cover trees.

Vectors of one label link when their cosine in double precision reaches the threshold. On unit vectors that is a chord
of at most sqrt(2 - 2 * threshold), a metric, so balls of centres and covering radii bound all pairs.

1. Equal vectors of a label form a class (pre-aggregated), which goes on as one row with its multiplicity.
2. Top level: centres are a hash sample of the classes, as many as SITE_BYTES hold; every class joins
   its nearest centre of its label (labels without a centre are one cell). A cell above BLOCK classes is
   dealt into blocks by hash. A tile is a pair of blocks whose balls come within the chord; a class
   goes only to tiles whose other ball it can reach.
3. In a tile, each block gets a cover tree (nested levels, radii halving, centres repeated as their own
   children). The traversal drops node pairs whose covering radii keep them apart, counts
   node pairs whose covering radii keep them together in bulk, splits the wider node of any other pair, and checks pairs of points by
   their cosine. Many node pairs are taken in one array step, but none is ever replaced by its points.
   A tile returns link counts and a spanning forest.
4. Link counts are summed by class, components found by large-star and small-star.

Rows whose label, id or vector is null, whose vector is empty, zero, or holds a null or non-finite component, link
with nothing (component_id is the vec_id, kept). Vectors of different length never link. Repeated rows count as vectors of their own. An
empty table gives an empty table; other columns, of any name, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import for_python, scratch, stored, tasks_for

BLOCK = 8192
SITE_BYTES = 32 << 20  # of all centres together, which are broadcast
SLACK = 1e-6
STEP = 1 << 16  # node pairs in an array step
WIDE = 1 << 12  # child pairs of one node pair that are worth a matrix product


def _chords(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


class Tree:
    """Cover tree of the unit vectors ``x[points]``, from the first of them, as arrays by node.

    ``order[low:high]`` are a node's points, ``centre`` one of them, ``radius`` the distance of the farthest; its children are the
    ``n_children`` nodes from ``first``. A child's radius is at most half the level at which its parent was split; a centre is its own child's centre.
    """

    def __init__(self, x: np.ndarray, points: np.ndarray):
        far = _chords(x[points], x[points[:1]])[:, 0]
        self.order = points.copy()
        centre, radius, low, high, first, n_children = [int(points[0])], [float(far.max()) if len(points) > 1 else 0.0], [0], [len(points)], [0], [0]
        todo = [(0, 2.0)]
        while todo:
            node, level = todo.pop()
            a, b = low[node], high[node]
            if b - a == 1:
                continue
            level /= 2
            while level >= max(radius[node], 1e-9):
                level /= 2
            if radius[node] < 2 * SLACK:
                level = -1.0  # as good as equal: every point is a child of its own
            own_points = self.order[a:b]
            alive = np.concatenate([[centre[node]], own_points[own_points != centre[node]]])
            first[node], at = len(centre), a
            groups: list[np.ndarray] = []
            while len(alive):
                some = alive[:64]
                d = _chords(x[alive], x[some])
                taken = np.zeros(len(alive), bool)
                for j in range(len(some)):
                    if taken[j]:
                        continue
                    own = (d[:, j] <= level) & ~taken
                    own[j] = True
                    taken |= own
                    size = int(np.count_nonzero(own))
                    groups.append(alive[own])
                    if size > 1:
                        todo.append((len(centre), level))
                    centre.append(int(some[j]))
                    radius.append(float(d[own, j].max()) if size > 1 else 0.0)
                    low.append(at)
                    high.append(at + size)
                    first.append(0)
                    n_children.append(0)
                    at += size
                alive = alive[~taken]
            n_children[node] = len(groups)
            self.order[a:b] = np.concatenate(groups)
        self.centre, self.radius, self.low, self.high, self.first, self.n_children = (np.array(v) for v in (centre, radius, low, high, first, n_children))
        self.size = self.high - self.low


class Links:
    """Counts and components of the links that a traversal finds; ``measured`` counts the distances that it took."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, threshold: float):
        self.x, self.weight, self.threshold = x, weight, threshold
        self.chord = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.count = np.zeros(len(x), np.int64)
        self.label = np.arange(len(x))
        self.measured = 0

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect points by pairs; a label is the least point of its component."""
        while len(a):
            p, q = self.label[a], self.label[b]
            apart = p != q
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            up = np.arange(len(self.label))
            np.minimum.at(up, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
            while (up[up] != up).any():
                up = up[up]
            self.label = up[self.label]

    def traverse(self, p: Tree, q: Tree) -> None:
        """All links between two trees, or within one if they are the same."""
        same = p is q
        sums = [np.r_[0, np.cumsum(self.weight[t.order])] for t in (p, q)]
        added = [np.zeros(len(t.order) + 1, np.int64) for t in (p, q)]  # steps of what bulks add along each tree's order
        joined = [np.zeros(len(t.centre), bool) for t in (p, q)]  # nodes all of whose points are connected
        own = np.zeros(len(p.order) + 1, np.int64)  # bulks of a node with itself
        todo: list[tuple[np.ndarray, np.ndarray]] = []
        selves: list[int] = []

        def settle(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
            """Drop, count or keep different nodes ``a`` of p and ``b`` of q at distance ``d``."""
            self.measured += len(d)
            reach = p.radius[a] + q.radius[b]
            near = d <= reach + (self.chord + SLACK)
            a, b, d, reach = a[near], b[near], d[near], reach[near]
            lone = (p.size[a] == 1) & (q.size[b] == 1)
            if lone.any():
                i, j = p.centre[a[lone]], q.centre[b[lone]]
                for s in range(0, len(i), STEP):
                    u, v = i[s : s + STEP], j[s : s + STEP]
                    hit = np.einsum("nd,nd->n", self.x[u], self.x[v]) >= self.threshold
                    u, v = u[hit], v[hit]
                    np.add.at(self.count, u, self.weight[v])
                    np.add.at(self.count, v, self.weight[u])
                    self.tie(u, v)
                a, b, d, reach = a[~lone], b[~lone], d[~lone], reach[~lone]
            within = d + reach <= self.chord - SLACK
            if within.any():
                i, j = a[within], b[within]
                for k, (t, n, u, m) in enumerate(((p, i, q, j), (q, j, p, i))):
                    w = sums[1 - k][u.high[m]] - sums[1 - k][u.low[m]]
                    np.add.at(added[k], t.low[n], w)
                    np.add.at(added[k], t.high[n], -w)
                    joined[k][n] = True
                self.tie(p.centre[i], q.centre[j])
                a, b = a[~within], b[~within]
            if len(a):
                todo.append((a, b))

        def matrix(rows: np.ndarray, columns: np.ndarray, upper: bool) -> None:
            for s in range(0, len(rows), 512):
                r = s if upper else 0
                d = _chords(self.x[p.centre[rows[s : s + 512]]], self.x[q.centre[columns[r:]]])
                self.measured += d.size
                i, j = np.nonzero(d <= p.radius[rows[s : s + 512], None] + q.radius[None, columns[r:]] + (self.chord + SLACK))
                if upper:
                    i, j = i[j > i], j[j > i]
                self.measured -= len(i)
                for t in range(0, len(i), STEP):
                    u, v = i[t : t + STEP], j[t : t + STEP]
                    settle(rows[s + u], columns[r + v], d[u, v])

        def children(t: Tree, node: int) -> np.ndarray:
            return np.arange(t.first[node], t.first[node] + t.n_children[node])

        def split(a: np.ndarray, b: np.ndarray) -> None:
            """Meet the children of the wider node of each pair with the other."""
            wider = (q.size[b] == 1) | ((p.size[a] > 1) & (p.radius[a] >= q.radius[b]))
            for of_p, t, n, other in ((True, p, a[wider], b[wider]), (False, q, b[~wider], a[~wider])):
                n_all = t.n_children[n]
                start = 0
                while start < len(n):
                    end = max(start + 1, int(np.searchsorted(np.cumsum(n_all[start:]), 4 * STEP, "right")) + start)
                    many = n_all[start:end]
                    child = np.repeat(t.first[n[start:end]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    rest = np.repeat(other[start:end], many)
                    i, j = (child, rest) if of_p else (rest, child)
                    settle(i, j, np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nd->n", self.x[p.centre[i]], self.x[q.centre[j]]), 0)))
                    start = end

        if same:
            selves.append(0)
        else:
            settle(np.zeros(1, np.int64), np.zeros(1, np.int64), _chords(self.x[p.centre[:1]], self.x[q.centre[:1]])[0])
        while selves or todo:
            if selves:
                node = selves.pop()
                if 2 * p.radius[node] <= self.chord - SLACK:
                    added[0][p.low[node]] += sums[0][p.high[node]] - sums[0][p.low[node]]
                    added[0][p.high[node]] -= sums[0][p.high[node]] - sums[0][p.low[node]]
                    own[p.low[node]] += 1
                    own[p.high[node]] -= 1
                    joined[0][node] = True
                else:
                    kids = children(p, node)
                    selves += kids[p.size[kids] > 1].tolist()
                    matrix(kids, kids, True)
                continue
            a, b = todo.pop()
            if len(a) > STEP:
                todo.append((a[STEP:], b[STEP:]))
                a, b = a[:STEP], b[:STEP]
            wide = np.minimum(p.n_children[a], q.n_children[b]) * np.maximum(p.n_children[a], q.n_children[b]) > WIDE
            for i, j in zip(a[wide].tolist(), b[wide].tolist()):
                matrix(children(p, i), children(q, j), False)
            if not wide.all():
                split(a[~wide], b[~wide])
        for k, t in enumerate((p, q)):
            np.add.at(self.count, t.order, np.cumsum(added[k])[:-1])
            nodes = np.flatnonzero(joined[k])
            n = t.size[nodes]
            at = np.repeat(t.low[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.tie(np.repeat(t.centre[nodes], n), t.order[at])
        np.add.at(self.count, p.order, -np.cumsum(own)[:-1] * self.weight[p.order])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("nd,nd->n", vectors, vectors))[:, None]


def tile_links(vectors: np.ndarray, weight: np.ndarray, side: np.ndarray, threshold: float) -> Links:
    """Links of a tile; ``side`` 0 and 1 meet only each other, 2 meets all."""
    x = _unit(vectors)
    links = Links(x, weight, threshold)
    if (side == 2).all():
        tree = Tree(x, np.arange(len(x)))
        links.traverse(tree, tree)
    elif (side == 0).any() and (side == 1).any():
        links.traverse(Tree(x, np.flatnonzero(side == 0)), Tree(x, np.flatnonzero(side == 1)))
    return links


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


_TILE = "space string, x int, y int, p int, q int, side int, cid bigint, rep bigint, n bigint, vector array<double>"
_TILE_KEY = ("space", "x", "y", "p", "q")
_OUT = "cid bigint, links bigint, a bigint, b bigint"


def embedding_dedup(embeddings: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """Per row of ``embeddings`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    vector = F.transform(F.col("embedding"), lambda v: v.cast("double") + F.lit(0.0))
    rows = for_python(embeddings).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("vector"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("vector", lambda v: v != 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.withColumn("cid", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", "vector")))
    with scratch() as keep:
        by_class = keep(_solved(rows, threshold, block))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    out = rows.select("vec_id", "cid").join(by_class, "cid", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _solved(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """cid, n_links, c (component) of every class, stored."""
    spark = rows.sparkSession
    classes = stored(rows.filter("cid is not null").groupBy("cid", "label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")
    total, longest = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    step = max(block, -(-total * 8 * (longest or 1) // SITE_BYTES))
    space = lambda label, width: f"{width}:{label}"  # noqa: E731  vectors of other lengths are in another space
    centres: dict[str, list] = {}
    # About SITE_BYTES at most, whatever the input: one class of ``step``.
    for label, v in zip(*(c.to_pylist() for c in classes.filter(F.pmod(F.xxhash64("cid", F.lit(17)), F.lit(step)) == 0).orderBy("cid").select("label", "vector").toArrow().columns)):
        centres.setdefault(space(label, len(v)), []).append(v)
    sites = spark.sparkContext.broadcast({k: _unit(np.array(v)) for k, v in centres.items()})
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
        """Rows of each space."""
        sizes = batch.column(2).value_lengths().to_pylist()
        names = [space(k, n) for k, n in zip(batch.column(1).to_pylist(), sizes)]
        for name in sorted(set(names)):
            yield name, batch.take(pa.array([i for i, k in enumerate(names) if k == name]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, part in _grouped(batch):
                cell, far = np.full(part.num_rows, -1, np.int32), np.full(part.num_rows, 2.0)
                if name in sites.value:
                    x = _unit(_matrix(part.column(2)))
                    for s in range(0, len(x), 256):
                        d = _chords(x[s : s + 256], sites.value[name])
                        cell[s : s + 256], far[s : s + 256] = d.argmin(axis=1), d.min(axis=1)
                yield pa.record_batch([*part.columns, pa.array([name] * part.num_rows), pa.array(cell), pa.array(far)], names=["cid", "label", "vector", "rep", "n", "space", "cell", "far"])

    placed = stored(classes.select("cid", "label", "vector", "rep", "n").mapInArrow(assign, "cid bigint, label string, vector array<double>, rep bigint, n bigint, space string, cell int, far double"), "placed")
    sizes = stored(placed.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("m"), F.max("far").alias("far")).withColumn("blocks", F.ceil(F.col("m") / block).cast("int")), "vector-cells", files_a_core=1)
    # Cells that have a centre: no more than there are centres.
    of_space: dict[str, list] = {}
    for row in sizes.filter("cell >= 0").select("space", "cell", "blocks", "far").orderBy("space", "cell").collect():
        of_space.setdefault(row["space"], []).append(row[1:])
    balls = spark.sparkContext.broadcast({k: (np.array([c for c, _, _ in v]), np.array([b for _, b, _ in v]), np.array([f for _, _, f in v])) for k, v in of_space.items()})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tile of each class: of its own cell's blocks, and of the blocks of every ball that it reaches."""
        for batch in batches:
            for name, part in _grouped(batch):
                cid, cell, blocks = (part.column(i).to_numpy() for i in (0, 5, 6))
                own = cid % blocks
                row, other_cell, many = np.arange(len(cid)), cell.copy(), blocks.copy()
                if name in balls.value:
                    cells, n_blocks, far = balls.value[name]
                    x, near = _unit(_matrix(part.column(2))), []
                    for s in range(0, len(x), 256):
                        i, j = np.nonzero(_chords(x[s : s + 256], sites.value[name][cells]) <= far + chord)
                        near.append((i + s, j))
                    i, j = (np.concatenate(v) for v in zip(*near))
                    i, j = i[cells[j] != cell[i]], j[cells[j] != cell[i]]
                    row, other_cell, many = np.concatenate([row, i]), np.concatenate([other_cell, cells[j]]), np.concatenate([many, n_blocks[j]])
                other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, other_cell = np.repeat(row, many), np.repeat(other_cell, many)
                x, p = cell[row], own[row]
                inside = x == other_cell
                first = np.where(inside, p <= other, x < other_cell)
                side = np.where(inside & (p == other), 2, np.where(first, 0, 1))
                for s in range(0, len(row), 4096):
                    at = slice(s, s + 4096)
                    r, f = row[at], first[at]
                    low, high = (np.where(f, u[at], v[at]) for u, v in ((x, other_cell), (p, other)))
                    low2, high2 = (np.where(f, v[at], u[at]) for u, v in ((x, other_cell), (p, other)))
                    ints = (pa.array(v.astype(np.int32)) for v in (low, low2, high, high2, side[at]))
                    taken = part.take(pa.array(r))
                    yield pa.record_batch([pa.array([name] * len(r)), *ints, taken.column(0), taken.column(3), taken.column(4), taken.column(2)], names=["space", "x", "y", "p", "q", "side", "cid", "rep", "n", "vector"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            cid, rep = table.column("cid").to_numpy(), table.column("rep").to_numpy()
            links = tile_links(_matrix(table.column("vector").combine_chunks()), table.column("n").to_numpy(), table.column("side").to_numpy(), threshold)
            has, tied = np.flatnonzero(links.count), np.flatnonzero(links.label != np.arange(len(cid)))
            none = lambda n: pa.nulls(n, pa.int64())
            yield pa.record_batch([pa.array(cid[has]), pa.array(links.count[has]), none(len(has)), none(len(has))], names=["cid", "links", "a", "b"])
            yield pa.record_batch([none(len(tied)), none(len(tied)), pa.array(rep[tied]), pa.array(rep[links.label[tied]])], names=["cid", "links", "a", "b"])

        for batch in batches:
            tiles = list(zip(*(batch.column(i).to_pylist() for i in range(len(_TILE_KEY)))))
            start = 0
            for i in range(1, len(tiles) + 1):
                if i == len(tiles) or tiles[i] != tiles[start]:
                    if tiles[start] != at:
                        yield from close()
                        at, held = tiles[start], []
                    held.append(batch.slice(start, i - start))
                    start = i
        yield from close()

    tiled = placed.join(sizes.select("space", "cell", "blocks"), ["space", "cell"]).select("cid", "label", "vector", "rep", "n", "cell", "blocks").mapInArrow(spread, _TILE)
    met = sizes.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
    parts = tasks_for(spark, met * 8 * (longest or 1))
    solved = stored(tiled.repartition(parts, *_TILE_KEY).sortWithinPartitions(*_TILE_KEY).mapInArrow(solve, _OUT), "vector-links")
    counts = solved.filter("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(solved.filter("a is not null").select("a", "b")).withColumnsRenamed({"node": "rep", "component": "c"})
    every = classes.select("cid", "rep", "n").join(counts, "cid", "left").join(linked, "rep", "left")
    return stored(every.select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("c", "rep").alias("c")), "vector-classes", files_a_core=4)
