"""The training-data queries, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces, secrets, sql, warc
from .cover_tree import embedding_dedup
from .exact_dedup import exact_dedup
from .html_crf import extract_main
from .line_dedup import line_dedup
from .minhash_dedup import minhash_dedup
from .mixing import mix_sources
from .quality import fit, score_quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(_table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    docs = _table(spark, sf_dir, "documents")
    return pieces.round_trip(docs)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(_table(spark, sf_dir, "documents"), width=3, threshold=85)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"), min_chars=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_main_text, op3_exact_dedup, op4_embedding_dedup, op5_sentencepiece, op6_minhash_dedup, op7_secrets, op8_warc, op9_line_dedup, op10_mix_sources)}
ORACLES = sql.ORACLES
