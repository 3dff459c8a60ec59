"""Embedding near copies, archives, and mixing."""

import hashlib
import io
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import cover_tree, mixing, warc

# Vectors


def brute_vectors(table, threshold=0.93):
    def sound(r):
        return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    good = [(i, r) for i, r in enumerate(table) if sound(r)]
    links = Counter()
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = root(a[0]), root(b[0])
                    up[max(p, q)] = min(p, q)
    component = lambda r: None if r[0] is None else root(r[0])
    return sorted(repr((r[0], links[i], component(r), r[0] == component(r))) for i, r in enumerate(table))


VECTORS = "vec_id bigint, embedding array<float>, label int"


def found(frame, **more):
    return sorted(repr(tuple(r)) for r in cover_tree.embedding_dedup(frame, **more).collect())


def test_vectors_of_every_kind(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    table = [(1, one, 0), (2, [2.0, 4.0, 6.0], 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [], 0), (7, [0.0, -0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [nan, 2.0, 3.0], 0), (10, [inf, 2.0, 3.0], 0), (None, one, 0), (11, [1.0, 2.0], 0), (12, one, 0), (12, one, 0)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in table], VECTORS + ", cell string, cid int")
    assert found(frame) == brute_vectors(table)
    assert cover_tree.embedding_dedup(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16, 8192])
def test_pairs_are_exact_across_cells_and_blocks(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(12, 8))
    table = []
    for i in range(260):
        v = centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2, 0.5])
        table.append((int(i * 37 % 1009), [float(np.float32(x)) for x in v], int(rng.integers(2))))
    assert found(spark.createDataFrame(table, VECTORS), block=block) == brute_vectors(table)


@pytest.mark.parametrize("sides", [1, 2])
def test_points_of_one_direction_keep_all_their_links(sides):
    rng = np.random.default_rng(5)
    for _ in range(40):
        v, other = rng.normal(size=(2, 32)).astype(np.float32).astype(np.float64)
        other -= v * (other @ v) / (v @ v)
        w = 0.95 * v / np.linalg.norm(v) + math.sqrt(1 - 0.95**2) * other / np.linalg.norm(other)
        vectors, weight = np.array([v, 2 * v, 4 * v, w, 2 * w, 8 * w]), np.array([1, 2, 1, 3, 1, 1])
        side = np.full(6, 2) if sides == 1 else np.array([0, 0, 0, 1, 1, 1])
        links = cover_tree.tile_links(vectors, weight, side, 0.93)
        assert links.count.tolist() == [weight[(side != side[i]) if sides == 2 else np.arange(6) != i].sum() for i in range(6)]
        assert links.label.tolist() == [0] * 6


def test_lengths_of_one_direction_are_linked_to_a_neighbour(spark):
    rng = np.random.default_rng(6)
    table = []
    for label in range(12):
        v, other = rng.normal(size=(2, 32))
        v = [float(np.float32(x)) for x in v]
        other -= np.array(v) * (other @ v) / np.dot(v, v)
        w = 0.95 * np.array(v) / np.linalg.norm(v) + math.sqrt(1 - 0.95**2) * other / np.linalg.norm(other)
        rows = [v, [2 * x for x in v], [4 * x for x in v], [float(np.float32(x)) for x in w]]
        table += [(label * 10 + k, r, label) for k, r in enumerate(rows)]
    assert found(spark.createDataFrame(table, VECTORS)) == brute_vectors(table)


def test_tree_covers_its_points():
    rng = np.random.default_rng(3)
    x = cover_tree._unit(rng.normal(size=(300, 5)))
    x[40:60] = x[40]
    tree = cover_tree.Tree(x, np.arange(300))
    todo, leaves = [0], 0
    while todo:
        node = todo.pop()
        points = tree.order[tree.low[node] : tree.high[node]]
        kids = range(tree.first[node], tree.first[node] + tree.n_children[node])
        assert np.linalg.norm(x[points] - x[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-6
        if len(points) == 1:
            leaves += 1
            continue
        assert [p for k in kids for p in tree.order[tree.low[k] : tree.high[k]]] == points.tolist()
        assert any(tree.centre[k] == tree.centre[node] for k in kids)  # nested
        assert max(tree.radius[k] for k in kids) <= max(tree.radius[node], 1e-5)
        todo += kids
    assert leaves == 300 and sorted(tree.order.tolist()) == list(range(300))


def clustered(n, groups, noise, dim, seed):
    rng = np.random.default_rng(seed)
    centres = cover_tree._unit(rng.normal(size=(groups, dim)))
    return cover_tree._unit(centres[rng.integers(groups, size=n)] + rng.normal(size=(n, dim)) * noise)


def least_labels(hit):
    """The least row that each row reaches."""
    label = np.arange(len(hit))
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], len(hit)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("two", [False, True])
@pytest.mark.parametrize(("noise", "dim"), [(0.002, 64), (0.02, 64), (0.045, 64), (0.1, 8), (0.6, 3)])
def test_traversal_finds_the_links_of_all_pairs(two, noise, dim):
    """Equal vectors, near ones, dense groups counted in bulk, hubs and strangers, with weights."""
    x = clustered(900, 60, noise, dim, 1)
    x[100:140] = x[100]
    weight = np.random.default_rng(2).integers(1, 5, 900)
    side = np.arange(900) % 2 if two else np.full(900, 2)
    hit = x @ x.T >= 0.93
    np.fill_diagonal(hit, False)
    if two:
        hit &= side[:, None] != side[None, :]
    links = cover_tree.tile_links(x, weight, side, 0.93)
    assert links.count.tolist() == (hit @ weight).tolist()
    assert links.label.tolist() == least_labels(hit).tolist()


@pytest.mark.parametrize(("noise", "most"), [(0.03, 0.05), (0.045, 0.12)])
def test_traversal_prunes_most_pairs_of_clustered_vectors(noise, most):
    """4,000 vectors in 400 groups of 64 dimensions: far fewer distances than pairs, none replaced by a comparison of all."""
    x = clustered(4000, 400, noise, 64, 3)
    links = cover_tree.tile_links(x, np.ones(4000, np.int64), np.full(4000, 2), 0.93)
    assert links.measured < most * 4000 * 3999 / 2
    hit = x @ x.T >= 0.93
    assert links.count.sum() == hit.sum() - 4000 > 200


def test_planted_links_across_cells(spark):
    """Copies, a chain of near vectors that crosses cells, a hub, lengths of one direction and strangers, in many small cells."""
    rng = np.random.default_rng(12)
    table = [(i, [float(v) for v in rng.normal(size=16)], i % 3) for i in range(400)]
    base = rng.normal(size=16)
    for k in range(60):  # a chain: each step turns by some degrees
        base = base / np.linalg.norm(base)
        turn = rng.normal(size=16)
        turn -= base * (turn @ base)
        base = base * 0.96 + turn / np.linalg.norm(turn) * 0.28
        table.append((1000 + k, [float(v) for v in base * rng.uniform(0.1, 50)], 0))
    hub = rng.normal(size=16)
    hub /= np.linalg.norm(hub)
    for k in range(80):
        turn = rng.normal(size=16)
        turn -= hub * (turn @ hub)
        table.append((2000 + k, [float(v) for v in hub * 0.94 + turn / np.linalg.norm(turn) * 0.341], 1))
    table.append((1999, [float(v) for v in hub], 1))
    table += [(3000 + k, table[k % 20][1], table[k % 20][2]) for k in range(60)]
    rng.shuffle(table)
    frame = spark.createDataFrame([(int(a), b, int(c)) for a, b, c in table], "vec_id bigint, embedding array<double>, label int")
    want = brute_vectors([(int(a), b, int(c)) for a, b, c in table])
    assert sum("True" in r for r in want) < len(table) - 150
    assert found(frame, block=16) == want == found(frame)


# Archives


def page_rows(n, rng):
    html = ["<p>" + "same " * 40, "<p>short", "", None]
    out = []
    for i in range(n):
        body = rng.choice(html) if rng.random() < 0.5 else f"<p>{i} " + "é text " * rng.randrange(60)
        out.append((i * 13 % 997, rng.choice([f"http://a.example.com/{i % 7}", f"https://www.B.example.org:8080/x?q={i % 5}#f", None, "odd", f"http://hot.example.net/{i}"]), body))
    return out


def brute_archive(table):
    payload = [(p, (h or "").encode()) for p, _, h in table]
    first = {}
    for p, data in payload:
        if p is not None and len(data) >= 100:
            first[data] = min(p, first.get(data, p))
    out = []
    for (p, url, _), (_, data) in zip(table, payload):
        refers = first.get(data)
        revisit = refers is not None and refers != p and sum(d == data for _, d in payload) > 1
        out.append(repr((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", refers if revisit else None, warc.url_key(url))))
    return sorted(out)


CONTRACT = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key")


def test_archive_round_trip_and_order(spark, tmp_path):
    table = [*page_rows(150, random.Random(1)), (None, "http://a.example.com/", "<p>" + "same " * 40), (None, None, None), (5, "u", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, "a", 1) for r in table], "page_id bigint, url string, html string, digest string, archive int").repartition(5)
    files = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=2000)
    assert files.count() > 5 and files.agg(F.sum("records")).first()[0] == len(table)
    fences = warc.read_archives(files, f"file://{tmp_path}/w", run_rows=20, slice_rows=3)
    assert fences.select("run").distinct().count() > 6 and fences.agg(F.sum("n")).first()[0] == len(table)
    merged = warc.merge_runs(fences, f"file://{tmp_path}/w", ranges=4)
    got = merged.collect()
    assert sorted(repr(tuple(r[c] for c in CONTRACT)) for r in got) == brute_archive(table)
    order = [(r["url_key"], r["captured_at"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert order == sorted(order)  # partitions come in order
    assert merged.rdd.getNumPartitions() == 4
    row = next(r for r in got if r["page_id"] == 5)
    with open(f"{tmp_path}/w/{row['archive']}", "rb") as f:  # a record can be read on its own
        f.seek(row["position"])
        (_, _, content), *_ = warc.members(io.BytesIO(f.read(row["length"])))
    assert warc.parse(content)[1] == b"x" * 200_000


def test_many_runs_are_merged_in_levels_and_equal_captures_are_split(spark, tmp_path):
    """900 captures of one URL, time and page and 100 others, in runs of 10, two merged at a time."""
    pages = spark.range(1000).select(F.when(F.col("id") >= 900, F.col("id")).alias("page_id"), F.when(F.col("id") >= 900, F.concat(F.lit("http://y.z/"), F.repeat(F.lit("long/"), 100), "id")).otherwise("http://x.y/").alias("url"), F.lit("").alias("html")).repartition(3)
    folder = f"file://{tmp_path}/w"
    fences = warc.read_archives(warc.write_archives(pages, folder), folder, run_rows=10, slice_rows=4)
    merged = warc.merge_runs(fences, folder, ranges=8, fan_in=12, group=5, slice_rows=4)
    got = merged.collect()
    order = [(r["url_key"], r["captured_at"], r["page_id"] or 0, r["archive"], r["position"]) for r in got]
    assert order == sorted(order) and len(set(order)) == 1000
    sizes = merged.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 400
    assert warc.archive_pages(spark.createDataFrame([(10**17, "u", "a"), (-5, "u", "b")], "page_id bigint, url string, html string")).count() == 2


def test_archive_of_nothing_and_with_times(spark):
    pages = spark.createDataFrame([(1, "http://x.y/", "a"), (2, "http://x.y/", "b")], "page_id bigint, url string, html string")
    assert warc.archive_pages(pages.limit(0)).count() == 0
    timed = pages.withColumn("at", F.when(F.col("page_id") == 1, F.lit("2024-05-01 00:00:00")).otherwise("2024-04-01 00:00:00").cast("timestamp"))
    assert [r["page_id"] for r in warc.archive_pages(timed, time_column="at").collect()] == [2, 1]


def test_damaged_archives_are_noticed():
    import zlib

    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    data = pack.compress(b"x" * 5000) + pack.flush()
    assert [(a, n) for a, n, _ in warc.members(io.BytesIO(data * 3))] == [(i * len(data), len(data)) for i in range(3)]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-3])))


def test_loser_tree():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(50), i, n) for n in range(rng.randrange(20))) for i in range(k)]
        merged = list(warc.LoserTree([iter(r) for r in runs], lambda x: x[0]))
        assert merged == sorted((x for r in runs for x in r), key=lambda x: (x[0], x[1]))


@pytest.mark.parametrize(
    ("url", "key"),
    [("HTTP://www.Example.com:80/A?b#c", "com,example)/A?b"), ("https://m.x.org", "org,x,m)/"), ("a.b/c", "b,a)/c"), ("http://x?y", "x)/?y"), (None, ""), ("", "")],
)
def test_url_keys(url, key):
    assert warc.url_key(url) == key


# Mixing


def brute_times(doc_id, mean, seed=1):
    draws = max(1, math.ceil(mean / mixing.CHUNK))
    out = 0
    for j in range(1, draws + 1):
        u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-mean / draws)
        for k in range(1, mixing.TERMS + 1):
            if c > u:
                break
            out += 1
            p *= mean / draws / k
            c += p
    return out


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, None: 0.5, "c": 9.0}, {"a": 1.0, "b": 0.0}])
def test_repetition_inverts_the_poisson_distribution(odd_docs, weights):
    table = [(r["doc_id"], r["source"]) for r in odd_docs.collect()]
    n = Counter(s for _, s in table)
    share = {s: (1.0 if weights is None else max(0.0, weights.get(s, 0.0))) for s in n}
    mean = {s: share[s] * 300 / sum(share.values()) / n[s] for s in n}
    want = Counter()
    for d, s in table:
        for k in range(brute_times(d, mean[s])):
            want[d, s, k + 1] += 1
    out = mixing.mix_sources(odd_docs, weights, total=300)
    assert out.columns == [*odd_docs.columns, "copy_", "order_key_"]
    assert Counter(tuple(r) for r in out.select("doc_id", "source", "copy_").collect()) == want


def test_mixing_meets_its_target_and_shuffles(spark, no_docs):
    assert mixing.mix_sources(no_docs).count() == 0
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6000, "hot").when(F.col("id") < 8900, "mid").otherwise("rare").alias("source"))
    out = mixing.mix_sources(docs, {"hot": 1, "mid": 2, "rare": 1}, total=8000)
    by = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert all(abs(by[s] - t) < 5 * math.sqrt(t) for s, t in (("hot", 2000), ("mid", 4000), ("rare", 2000)))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix_sources(docs, {"hot": 1, "mid": 2, "rare": 1}, total=8000).collect()))
    first = [r["source"] for r in out.limit(400).collect()]
    assert 40 < first.count("hot") < 160  # not in the order of the input
