"""Exact, line and near deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import bloom, exact_dedup, graph, minhash_dedup, textkit
from lanewise.llm.exact_dedup import Directory
from lanewise.llm.line_dedup import line_dedup


def rows(frame, *columns):
    return sorted(map(repr, (tuple(r) for r in (frame.select(*columns) if columns else frame).collect())))


def find_roots(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# Exact


def brute_exact(table):
    groups = defaultdict(list)
    for d, t in table:
        groups[t or ""].append(d)
    out = []
    for d, t in table:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((d, keep, len(own), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(repr, out))


def pairs(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("key_of", [exact_dedup.hash_key, lambda t: F.length(t).cast("bigint") % 3, lambda t: F.lit(-1).cast("bigint")])
def test_exact_dedup_even_when_keys_collide(odd_docs, key_of):
    assert rows(exact_dedup.exact_dedup(odd_docs, key_of, bucket_rows=2)) == brute_exact(pairs(odd_docs))


def test_exact_dedup_of_nothing_and_of_one_hot_text(spark, no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    assert rows(exact_dedup.exact_dedup(hot)) == brute_exact(pairs(hot))


def test_directory_doubles_until_buckets_fit():
    counts = np.zeros(256, np.int64)
    counts[:8], counts[200] = 10, 500
    d = Directory.over(counts, 25)
    table = d.slots
    assert len(table) == 256 and d.depth == 8
    assert d.bucket_of(np.array([200 << 56], np.uint64).view(np.int64)).tolist() == [table[200]]
    load = np.bincount(table, counts)
    assert all(load[b] <= 25 or (table == b).sum() == 1 for b in set(table.tolist()))
    assert all((np.diff(np.flatnonzero(table == b)) == 1).all() for b in set(table.tolist()))  # each owns one key range
    assert Directory.over(np.zeros(16, np.int64), 1).slots.tolist() == [0]


def test_prefixes_grow_until_buckets_fit(spark, monkeypatch):
    """Keys that share their first 18 bits, in buckets of 50."""
    monkeypatch.setattr(exact_dedup, "address", lambda key: F.shiftrightunsigned(F.xxhash64(key), 18))
    keys = spark.range(1000).select(F.col("id").alias("key"))
    made = exact_dedup.directory_of(keys, 50)
    load = np.bincount(made.bucket_of(np.array([r[0] for r in keys.select(exact_dedup.address("key")).collect()])))
    assert made.depth > 18 and load.max() <= 50 and load.sum() == 1000


def test_look_up_goes_through_the_stored_directory(spark):
    docs = spark.range(500).select("id", F.col("id").alias("doc_id"), (F.col("id") % 300).cast("string").alias("text"))
    light, directory, index = exact_dedup.build_index(docs, bucket_rows=16)
    assert directory.count() == 2 ** directory.first()["depth"] and index.select("bucket").distinct().count() >= 300 / 16
    new = spark.createDataFrame([("7",), ("299",), ("no such text",)], "text string").select("text", exact_dedup.hash_key(F.col("text")).alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"))
    assert sorted((r["text"], r["keep_id"], r["group_size"]) for r in exact_dedup.look_up(new, directory, index).collect()) == [("299", 299, 1), ("7", 307, 2)]
    lost = directory.withColumn("bucket", F.lit(-1))
    assert exact_dedup.look_up(light, lost, index).count() == 0


# Bloom filters


def test_filter_never_loses_a_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    made = bloom.of_column(keys, "h", 5000)
    got = np.array([r[0] for r in keys.collect()])
    assert made.maybe(got).all()
    others = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    assert made.maybe(others).mean() < 0.02
    assert not made.maybe(np.zeros(0, np.int64)).size
    assert bloom.segments_for(10**12) * bloom.SEGMENT == bloom.CEILING
    assert bloom.of_column(keys, "h", bloom.MOST_KEYS + 1) is None


def digests_of(frame):
    """(doc_id, digest) of (doc_id, key)."""
    return frame.select("doc_id", F.substring(F.unhex(F.sha2(F.col("key").cast("string"), 256)), 1, 16).alias("digest"))


def test_suspects_are_about_the_true_repeats_in_small_filters(spark, monkeypatch):
    """200,000 keys in 20 ranges, 2,000 of them in two documents or more, one in 5,000, and one often in one document."""
    monkeypatch.setattr(bloom, "LEAST_KEYS", 10_000)
    monkeypatch.setattr(bloom, "FLUSH", 3_000)
    lone = spark.range(200_000).select(F.col("id").alias("doc_id"), F.col("id").alias("key"))
    again = spark.range(0, 200_000, 100).select((F.col("id") + 7).alias("doc_id"), F.col("id").alias("key"))
    hot = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit(-1).cast("bigint").alias("key"))
    own = spark.range(3_000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit(-2).cast("bigint").alias("key"))
    frame = digests_of(lone.unionAll(again).unionAll(hot).unionAll(own)).repartition(7)
    n = frame.count()
    assert n / bloom.keys_a_range(n) > 20
    got = bloom.suspects(frame, n).distinct()
    true = frame.distinct().join(frame.groupBy("digest").agg(F.count_distinct("doc_id").alias("n")).filter("n > 1"), "digest").select("doc_id", "digest")
    assert true.exceptAll(got).count() == 0
    assert true.count() == 9_000 and got.count() < 9_000 + 0.01 * n


def test_ranges_follow_the_number_of_keys():
    for n in (1, 10**6, 10**9, 10**12):
        wide = bloom.keys_a_range(n)
        assert wide <= bloom.MOST_RANGE_KEYS and bloom.segments_for(wide, 1 << 62) * bloom.SEGMENT >= bloom.BITS_A_KEY * wide
    assert bloom.keys_a_range(10**12) == bloom.MOST_RANGE_KEYS


def test_operators_without_filters(spark, odd_docs, monkeypatch):
    """More keys than a broadcast filter may hold: joins take over, with the same rows."""
    from lanewise.llm import warc

    pages = spark.createDataFrame([(i, f"http://x.y/{i}", "same " * 30 if i % 3 else f"{i} " * 60) for i in range(60)], "page_id bigint, url string, html string")
    dropped = spark.createDataFrame([(1,), (None,), (77,)], "doc_id bigint")
    results = []
    for most in (bloom.MOST_KEYS, 0):
        monkeypatch.setattr(bloom, "MOST_KEYS", most)
        left = bloom.without(odd_docs, dropped, {"doc_id": F.col("doc_id")})
        least = bloom.one_of_each(odd_docs, spark.createDataFrame([(1,), (None,)], "doc_id bigint"), {"doc_id": F.col("doc_id")})
        archived = warc.archive_pages(pages).select("page_id", "payload_digest", "record_type", "refers_to", "url_key")
        results.append([rows(left), rows(least), rows(line_dedup(odd_docs), "doc_id", "n_lines", "n_dropped", "text"), rows(minhash_dedup.minhash_dedup(odd_docs, 3, 85)), rows(exact_dedup.exact_dedup(odd_docs)), rows(archived)])
    assert results[0] == results[1]


def test_without(odd_docs, spark):
    dropped = spark.createDataFrame([(1,), (None,), (77,)], "doc_id bigint")
    left = bloom.without(odd_docs, dropped, {"doc_id": F.col("doc_id")})
    assert left.columns == odd_docs.columns
    assert rows(left) == rows(odd_docs.filter("doc_id is not null and doc_id <> 1"))


# Components


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(200)] + [(5, None)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == find_roots({x for ab in real for x in ab}, real)
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert sorted(graph.as_stars([(5, 3), (3, 4), (9, 8)])) == [(4, 3), (5, 3), (9, 8)]


# Lines


def brute_lines(table, min_chars=10):
    white = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(white))
    holders = defaultdict(set)
    for d, t in table:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders[key(line)].add(d)
    out = []
    for d, t in table:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


def test_line_dedup(spark, odd_docs, no_docs):
    out = line_dedup(odd_docs)
    assert rows(out, "doc_id", "n_lines", "n_dropped", "text") == brute_lines(pairs(odd_docs))
    assert line_dedup(no_docs).count() == 0
    rng = random.Random(3)
    pool = [rng.choice(["short", "A Longer Line Here", " a longer line here\t", "éééééééééé", "ééééééééé", "unique line %d"]) + (" %d" % rng.randrange(30) if rng.random() < 0.5 else "") for _ in range(60)]
    table = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(200)]
    frame = spark.createDataFrame(table, "doc_id bigint, text string").repartition(5)
    assert rows(line_dedup(frame), "doc_id", "n_lines", "n_dropped", "text") == brute_lines(table)


# Near copies


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_near(table, width, threshold):
    shingles = []
    for _, t in table:
        w = words(t)
        shingles.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    links = []
    for i in range(len(table)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            both = len(a & b) if a and b else 0
            if both and None not in (table[i][0], table[j][0]) and 100 * both >= threshold * (len(a) + len(b) - both):
                links.append((table[i][0], table[j][0]))
    root = find_roots({d for d, _ in table if d is not None}, links)
    return sorted(repr((d, len(s), root.get(d), d == root.get(d))) for (d, _), s in zip(table, shingles))


def test_words_are_the_pattern():
    texts = ["A  bB\tc\x0b\x0cd\r\ne", "", "é À\x85x y", "x" * 3000, "one " * 5000]
    seen = [[] for _ in texts]
    for at, counts, hashes in textkit.words([t.encode() for t in texts]):
        ends = np.cumsum(counts)
        for i, a, b in zip(at, ends - counts, ends):
            seen[i] = [tuple(h) for h in hashes[a:b].tolist()]
    by_word = {}
    for t, own in zip(texts, seen):
        assert len(words(t)) == len(own)
        for w, h in zip(words(t), own):
            assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def near_table(rng, groups, members):
    table = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(2, 150))]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            table.append((len(table) * 7 % 1009, " ".join(own)))
    return table


@pytest.mark.parametrize(("width", "threshold"), [(3, 85), (5, 80)])
def test_minhash_dedup(spark, odd_docs, no_docs, width, threshold):
    out = minhash_dedup.minhash_dedup(odd_docs, width, threshold)
    assert rows(out) == brute_near(pairs(odd_docs), width, threshold)
    assert minhash_dedup.minhash_dedup(no_docs, width, threshold).count() == 0
    table = near_table(random.Random(width), 25, 6)
    frame = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    assert rows(minhash_dedup.minhash_dedup(frame, width, threshold)) == brute_near(table, width, threshold)


def test_minhash_dedup_of_a_group_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_ROWS", 8)
    rng = random.Random(8)
    table = near_table(rng, 2, 90) + near_table(rng, 3, 1)[:0]
    frame = spark.createDataFrame(table, "doc_id bigint, text string")
    assert rows(minhash_dedup.minhash_dedup(frame, 3, 85)) == brute_near(table, 3, 85)


def test_banding_misses_next_to_nothing_and_ties_little():
    for threshold, most in ((80, 0.04), (85, 0.01), (50, 1)):
        bands, r = minhash_dedup.bands_for(threshold)
        assert bands * r <= minhash_dedup.MINIMA
        assert (1 - (threshold / 100) ** r) ** bands <= minhash_dedup.MISS
        assert 1 - (1 - 0.3**r) ** bands < most


def test_words_that_polynomials_confuse_are_different(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    frame = spark.createDataFrame([(1, word), (2, other), (3, word), (4, f"{word} {other} x"), (5, f"{other} {word} x")], "doc_id bigint, text string")
    assert [r["component_id"] for r in minhash_dedup.minhash_dedup(frame, 3, 85).orderBy("doc_id").collect()] == [1, 2, 1, 4, 5]


def test_halves_of_shingle_hashes_both_count():
    one = np.array([[1, 1], [1, 2], [1, 1], [2, 1]], np.uint64)
    assert minhash_dedup.distinct(one).tolist() == [[1, 1], [1, 2], [2, 1]]
    assert minhash_dedup.distinct(one[:0]).shape == (0, 2)
    sets = [one[[0, 3]], one[[1, 3]], one[[0, 3]]]
    signs = np.zeros((3, minhash_dedup.MINIMA), np.uint32)
    assert minhash_dedup.links_in_tile(np.full(3, 2), sets, signs, 85) == [(0, 2)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for similarity in (0.3, 0.6, 0.8, 0.9):
        for _ in range(40):
            both, n = rng.integers(0, 1 << 63, (round(300 * similarity), 2), np.uint64), 300 - round(300 * similarity)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 63, (k, 2), np.uint64)]) for k in (n // 2, n - n // 2))
            low = minhash_dedup.minima(np.array([len(a), len(b)]), np.concatenate([a, b]))
            errors.append((low[0] == low[1]).mean() - similarity)
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 6 * (0.25 / minhash_dedup.MINIMA) ** 0.5


def test_intermediate_tables_are_removed(spark, odd_docs):
    from pathlib import Path

    from lanewise.llm import shared

    folder = Path(shared.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.glob("*")}
    minhash_dedup.minhash_dedup(odd_docs, 3, 85).count()
    line_dedup(odd_docs).count()
    assert sorted(p.name.rsplit("-", 1)[0] for p in folder.glob("*") if p.name not in before) == ["class-components", "line-drops", "signed"]
