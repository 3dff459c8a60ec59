"""From raw documents to token ids: five stages, each written as Parquet and read again.

All stages take an empty table, and give one; columns of any further name travel with their rows up to the last stage. A null text counts as
empty. No stage looks at a row's place, so ties are settled by values alone, and a run gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import pieces
from lanewise.llm.bloom import one_of_each, without
from lanewise.llm.exact_dedup import exact_dedup
from lanewise.llm.minhash_dedup import minhash_dedup
from lanewise.llm.mixing import mix_sources
from lanewise.llm.quality import fit, quality_filter
from lanewise.llm.shared import scratch, stored

NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half, rows without doc_id or text among them; repeated rows share their score.

    The labels of held-out documents are not read. Without usable labels every score is one half, and all rows stay.
    """
    return quality_filter(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, null and empty ones together: that of the largest doc_id, and of its rows the least.

    Where all doc_ids of a group are null, the least row stays.
    """
    keys = {"doc_id": F.col("doc_id").cast("bigint"), "text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)}
    found = exact_dedup(docs)
    dropped = found.filter("not kept").select(*keys)
    # exact_dedup keeps all rows that share the kept doc_id.
    repeated = stored(found.filter("kept and group_size > 1").groupBy(*keys).count().filter("count > 1").select(*keys), "repeated", files_a_core=4)
    if repeated.isEmpty():
        return without(docs, dropped, keys)
    return without(docs, dropped.unionAll(repeated), keys).unionAll(one_of_each(docs, repeated, keys))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    Rows without doc_id or without words are linked with nothing and stay; rows of one doc_id share its fate.
    """
    dropped = minhash_dedup(docs, NEAR_WORDS, NEAR_PERCENT).filter("not kept")
    return without(docs, dropped, {"doc_id": F.col("doc_id").cast("bigint")})


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same share of every source, a null one among them, by repetition; as many rows as came in, on average.

    Rows of one doc_id, and all rows without one, share their number of copies.
    """
    return mix_sources(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every row; a row without text has no ids."""
    return pieces.encode(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing sources", mix), ("SentencePiece", tokens)]

#: Scores of a trained network have no SQL twin; tests compare the stages with plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch() as keep:  # what a stage stored on its way is removed when its rows are written
            docs = keep(stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower()))
    return docs
