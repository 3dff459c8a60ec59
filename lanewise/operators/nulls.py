"""Required values: counts, profiles and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.columns import flag, is_blank
from lanewise.sources.contracts import contract_for

FAILED = "__failed_null_columns"


def critical_columns_for_entity(entity: str) -> list[str]:
    contract = contract_for(entity)
    return contract.required_columns if contract else []


def check_required_nulls(df: DataFrame | None, required_columns: Sequence[str]) -> dict[str, int]:
    """Null or blank values by column, in one pass. An absent column counts as null in every row."""
    if df is None or not required_columns:
        return dict.fromkeys(required_columns, 0)
    counts = [F.sum(flag(is_blank(F.col(c)))).alias(f"n{i}") if c in df.columns else F.count(F.lit(1)).alias(f"n{i}") for i, c in enumerate(required_columns)]
    row = df.agg(*counts).first()
    return {c: int(row[i] or 0) for i, c in enumerate(required_columns)}


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, null_count, total_count, null_rate (0.0 of an empty table); one aggregate, then turned to rows."""
    names = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("total"), *(F.sum(flag(is_blank(F.col(c))) if c in df.columns else F.lit(1)).alias(f"n{i}") for i, c in enumerate(names)))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("bigint").alias("null_count"), F.col("total").alias("total_count")) for i, c in enumerate(names)))
    rate = F.when(F.col("total_count") > 0, F.col("null_count") / F.col("total_count")).otherwise(F.lit(0.0))
    return counts.select(F.inline(rows)).withColumn("null_rate", rate)


def _failed(df: DataFrame, required_columns: Sequence[str]) -> Column:
    there = [F.when(is_blank(F.col(c)), F.lit(c)) for c in required_columns if c in df.columns]
    return F.array_compact(F.array(*there)).cast("array<string>") if there else F.array().cast("array<string>")


def filter_rows_with_required_nulls(df: DataFrame, required_columns: Sequence[str]) -> DataFrame:
    """Rows that lack a required value, with the columns that lack it; absent columns are ignored."""
    return df.withColumn(FAILED, _failed(df, required_columns)).filter(F.size(FAILED) > 0)


def split_by_required_nulls(df: DataFrame, required_columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid)"""
    valid = df.withColumn(FAILED, _failed(df, required_columns)).filter(F.size(FAILED) == 0).drop(FAILED)
    return valid, filter_rows_with_required_nulls(df, required_columns)
