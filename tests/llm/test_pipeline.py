"""The stages against plain Python, and the queries against their SQL."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanewise.llm import pieces
from lanewise.llm.quality import fit
from lanewise.llm.queries import ORACLES, QUERIES
from tests.llm.test_dedup import brute_near
from tests.llm.test_vectors_and_archives import brute_times


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLES[name])


def test_names():
    assert [n for n in sorted(QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == [q for i in range(1, 11) for q in QUERIES if q.startswith(f"op{i}_")]
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing sources", "SentencePiece"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows in and out of each stage, as lists."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{at}/{i}")
        out.append(spark.read.parquet(f"{at}/{i}"))
    return out


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def table(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1]) and stages[-1].columns == ["doc_id", "ids"]


def test_quality_stage(spark, sf_dir, stages):
    model = fit(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = table(stages[0])
    scores = model.scores([(t or "").encode() for _, t in rows])
    assert ids(stages[1]) == sorted(d for (d, _), s in zip(rows, scores) if s >= 0.5)
    clean = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").join(stages[0], "doc_id")
    assert clean.join(stages[1].select("doc_id"), "doc_id", "left_anti").count() <= 0.03 * clean.count()


def test_exact_stage(stages):
    keep = {}
    for d, t in table(stages[1]):
        keep[t or ""] = max(d, keep.get(t or "", d))
    assert ids(stages[2]) == sorted(keep.values())


def test_exact_stage_keeps_one_row_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "a", "x"), (None, "a", "y"), (7, "b", "x"), (7, "b", "x"), (7, "b", "w"), (3, "b", "x"), (None, "b", "x"), (7, "c", "x"), (8, None, "x"), (8, "", "x"), (9, "d", "x"), (None, "e", "x"), (None, "f", "x"), (9, "g", "x"), (9, "g", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = corpus_pipeline.exact(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    want = [(None, "a", "x"), (7, "b", "w"), (7, "c", "x"), (8, None, "x"), (9, "d", "x"), (None, "e", "x"), (None, "f", "x"), (9, "g", "x")]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    hot = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit(5).cast("bigint")).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("text"), F.lit("x").alias("source"))
    assert corpus_pipeline.exact(spark, hot, str(tmp_path)).count() == 4


def test_near_stage(stages):
    rows = table(stages[2])
    kept = [eval(x)[0] for x in brute_near(rows, 5, 80) if eval(x)[3]]  # noqa: S307
    assert ids(stages[3]) == sorted(kept)


def test_mixing_stage(stages):
    rows = [(r["doc_id"], r["source"]) for r in stages[3].collect()]
    n = {s: sum(x == s for _, x in rows) for _, s in rows}
    assert ids(stages[4]) == sorted(d for d, s in rows for _ in range(brute_times(d, len(rows) / (len(n) * n[s]))))


def test_token_stage(stages):
    model = pieces.load()
    texts = {d: t for d, t in table(stages[4])}
    got = stages[5].collect()
    assert sorted(r["doc_id"] for r in got) == ids(stages[4])
    assert all(model.decode(np.array(r["ids"], np.int32)).decode() == texts[r["doc_id"]] for r in got)


def test_run_is_the_stages_in_turn(spark, sf_dir, stages):
    show = lambda f: sorted(repr(tuple(r)) for r in f.collect())
    assert show(corpus_pipeline.run(spark, sf_dir)) == show(stages[-1])


def test_stages_take_odd_rows(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (odd_docs, no_docs):
        docs = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = str(tmp_path / f"{start is no_docs}{i}")
            stage(spark, docs, str(tmp_path)).write.parquet(at)
            docs = spark.read.parquet(at)
            assert i == 4 or docs.columns == start.columns
        assert (docs.count() == 0) == (start is no_docs)


def test_digests_of_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name in ("op1_quality", "op5_sentencepiece", "op7_secrets"):
        out = QUERIES[name](spark, sf_dir)
        assert out.count() == n and out.select("doc_id").distinct().count() == n
    base = QUERIES["op7_secrets"](spark, sf_dir).filter("n_assign + n_access + n_hex = 0").select("base_sha256").distinct().collect()
    assert [r[0] for r in base] == [hashlib.sha256(b"").hexdigest()]
    assert QUERIES["op5_sentencepiece"](spark, sf_dir).filter(~F.col("same")).count() == 0
