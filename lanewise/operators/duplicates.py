"""Duplicate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.sources.contracts import contract_for


def key_columns_for_entity(entity: str) -> list[str]:
    contract = contract_for(entity)
    return list(contract.primary_key) if contract else []


def _need_keys(df: DataFrame, keys: Sequence[str]) -> None:
    missing = [k for k in keys if k not in df.columns]
    if not keys or missing:
        raise ValueError(f"Key columns are missing: {missing or 'none given'}")


def find_duplicate_keys(df: DataFrame | None, key_columns: Sequence[str]) -> DataFrame | None:
    """Keys of two rows or more, null keys too, with duplicate_count."""
    if df is None:
        return None
    _need_keys(df, key_columns)
    return df.groupBy(*key_columns).agg(F.count(F.lit(1)).alias("duplicate_count")).filter("duplicate_count > 1")


def find_entity_duplicates(df: DataFrame | None, entity: str) -> DataFrame | None:
    return find_duplicate_keys(df, key_columns_for_entity(entity))


def duplicate_records(df: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    """All rows of duplicate keys; null keys match nothing."""
    return df.join(find_duplicate_keys(df, key_columns).select(*key_columns), list(key_columns), "left_semi").select(*df.columns)


def split_by_duplicates(df: DataFrame, key_columns: Sequence[str], order_by: Sequence[str] = (), ties: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(first row of each key by ``order_by`` descending, then by ``ties`` ascending, all other rows)

    Every further column that can be ordered decides last, so that both parts, which are computed apart, agree on the first row.
    """
    _need_keys(df, key_columns)
    rest = [f.name for f in df.schema if f.name not in {*key_columns, *order_by, *ties} and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    by = [F.col(c).desc_nulls_last() for c in order_by] + [F.col(c).asc_nulls_last() for c in (*ties, *rest)]
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key_columns).orderBy(*(by or [F.lit(1)]))))
    return ranked.filter("__rank = 1").drop("__rank"), ranked.filter("__rank > 1").drop("__rank")
