"""Mixing sources to target weights by Poisson replication.

A source of weight w (weights are normalised over the sources that occur) and n rows gets the mean
repetition rate ``w * total / n``. Each row is repeated by a Poisson variate of that mean, which inverts
the distribution at a uniform number made from md5(seed, doc_id, draw). A mean above CHUNK is the
sum of several draws of equal mean, so no probability underflows. Copies are then dealt over all
partitions by a hash of (seed, doc_id, copy) and ordered by it within each: a global shuffle that
needs no range sample and knows no hot source.

Rates are one row a source, pre-aggregated and stored; Spark broadcasts that table only while its
measured size is under its threshold and otherwise splits a hot source in the join.

A null source is a source of its own (key None in ``weights``). Rows of one doc_id, and all rows
without one, share their draw. Sources without a weight, and weights of 0 or less, are left out. An
empty table gives an empty table. All columns are kept; added names that clash get a trailing "_".
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scratch, stored

CHUNK = 16.0
TERMS = 96  # of the distribution's table: beyond it lies less than 2 ** -53 at a mean of CHUNK


def free_name(name: str, taken: list[str]) -> str:
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _table(mean: Column) -> Column:
    """The distribution function at 0, 1, ... TERMS - 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = lambda acc, k: F.struct((acc.p * mean / k).alias("p"), F.concat(acc.c, F.array(F.element_at(acc.c, -1) + acc.p * mean / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc.c)


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None, total: int | None) -> DataFrame:
    """source, mean, draws, cdf (of mean / draws). ``weights`` None: the same for every source."""
    counts = stored(docs.groupBy(F.col("source").alias("source")).agg(F.count(F.lit(1)).alias("n")), "sources", files_a_core=1)
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0], "key string, w double")
        weighted = counts.join(given, F.col("source").cast("string").eqNullSafe(F.col("key"))).drop("key")
    rows, all_w = counts.agg(F.sum("n")).first()[0] or 0, weighted.agg(F.sum("w")).first()[0] or 1.0
    mean = F.col("w") * F.lit(float(rows if total is None else total)) / (F.lit(float(all_w)) * F.col("n"))
    out = weighted.withColumn("mean", mean).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("mean") / CHUNK)).cast("int"))
    return stored(out.withColumn("cdf", _table(F.col("mean") / F.col("draws"))).select("source", "mean", "draws", "cdf"), "rates", files_a_core=1)


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: int | None = None, seed: int = 1) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, ...) repeated, with their copy number from 1 and the key that orders them."""
    copy, order = free_name("copy", docs.columns), free_name("order_key", docs.columns)
    with scratch() as keep:
        table = keep(rates(docs, weights, total))
    row = docs.select(F.struct("*").alias("doc"), F.col("source").alias("of"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    drawn = row.join(table, F.col("of").eqNullSafe(F.col("source")))
    # The uniform numbers are a column of their own, so that each is made once and not for every entry of the table.
    draws = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: _uniform(F.lit(str(seed)), F.col("id"), j.cast("string")))
    times = F.aggregate("uniforms", F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda c: c <= u)))
    copies = drawn.withColumn("uniforms", draws).withColumn("times", times).filter("times > 0").select("doc", "id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.col("id"), F.col("copy").cast("string")))
    dealt = copies.select("doc", "copy", key.alias("order_key")).repartition("order_key").sortWithinPartitions("order_key")
    return dealt.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns), F.col("copy").alias(copy), F.col("order_key").alias(order))
