"""Partition contract, partitioned tables and their catalog entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.sources.files import write_parquet

PARTITIONS = ("p_date", "region_code", "carrier_id")
# What stands for a missing partition value.
DEFAULTS = {"p_date": "1970-01-01", "region_code": "UNKNOWN", "carrier_id": "UNKNOWN"}
_DATED_BY = ("p_date", "event_ts", "pickup_ts", "actual_delivery_ts", "promised_delivery_ts", "updated_at")


def required_partition_columns() -> list[str]:
    return list(PARTITIONS)


def default_partition_values() -> dict[str, str]:
    return dict(DEFAULTS)


def ensure_partition_columns(df: DataFrame, partitions: Sequence[str] | None = None, defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """Every partition column there and never null. Running it again changes nothing."""
    fill = DEFAULTS | dict(defaults or {})
    values = {}
    for name in partitions or PARTITIONS:
        if name == "p_date":
            dates = [F.to_date(F.col(c)) for c in _DATED_BY if c in df.columns]
            values[name] = F.coalesce(*dates, F.to_date(F.lit(str(fill[name]))))
        else:
            default = F.lit(fill.get(name, "UNKNOWN"))
            values[name] = F.coalesce(F.col(name), default) if name in df.columns else default
    return df.withColumns(values)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "") + "`"


def ensure_curated_database(spark: SparkSession, database: str = "curated", location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)}{at}")


def table_exists(spark: SparkSession, database: str, table_name: str) -> bool:
    return spark.catalog.tableExists(f"{database}.{table_name}")


def register_parquet_table(spark: SparkSession, table_name: str, output_path: str, schema: T.StructType, partitions: Sequence[str], database: str = "curated", repair_partitions: bool = True) -> None:
    """An external table over a partitioned folder. Partition columns are typed and among the columns, as Spark asks."""
    plain = [f for f in schema if f.name not in partitions]
    if not plain:
        raise ValueError("Cannot register a table that has partition columns only")
    ensure_curated_database(spark, database)
    table = f"{_quoted(database)}.{_quoted(table_name)}"
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in [*plain, *(schema[p] for p in partitions)])
    path = output_path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING PARQUET PARTITIONED BY ({', '.join(map(_quoted, partitions))}) LOCATION '{path}'")
    if repair_partitions:
        spark.sql(f"MSCK REPAIR TABLE {table}")
    spark.sql(f"REFRESH TABLE {table}")


def write_partitioned_table(
    df: Any,
    table_name: str,
    output_path: str,
    partitions: Sequence[str] | None = None,
    mode: str = "overwrite",
    spark: SparkSession | None = None,
    database: str = "curated",
    register_hive_table: bool = True,
    repair_partitions: bool = True,
    writer_options: Mapping[str, Any] | None = None,
) -> str:
    """Write a table by its partitions and register it; returns its path. What has no columns is not written."""
    if df is None or not hasattr(df, "columns"):
        return output_path
    by = list(partitions or PARTITIONS)
    ready = ensure_partition_columns(df, by)
    write_parquet(ready, output_path, mode, by, writer_options)
    if register_hive_table:
        register_parquet_table(spark or ready.sparkSession, table_name, output_path, ready.schema, by, database, repair_partitions)
    return output_path
