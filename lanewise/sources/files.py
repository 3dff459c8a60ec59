"""Reading and writing files, and finding a day's sources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CSV_DEFAULTS = {"header": "true", "inferSchema": "false", "mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssX"}
_URI = re.compile(r"([a-z][a-z0-9+.-]+):(?://(?=/))?", re.IGNORECASE)
CLOUD = re.compile(r"^s3[an]?://", re.IGNORECASE)


def is_cloud_path(path: str) -> bool:
    return bool(CLOUD.match(str(path)))


def join_path(base: str, *parts: str) -> str:
    return "/".join([str(base).rstrip("/\\"), *(p.strip("/\\") for p in parts)])


def path_exists(path: str) -> bool:
    """Local paths, file URIs among them, are looked up; paths of other file systems are taken to exist."""
    uri = _URI.match(str(path))
    return Path(str(path)[uri.end() :] if uri else path).exists() if uri is None or uri[1] == "file" else True


def _text(options: Mapping[str, Any] | None) -> dict[str, str]:
    return {str(k): str(v).lower() if isinstance(v, bool) else str(v) for k, v in (options or {}).items()}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, options: Mapping[str, Any] | None = None) -> DataFrame:
    if not path_exists(path):
        raise FileNotFoundError(f"there is no file to read at {path}")
    reader = spark.read.options(**(CSV_DEFAULTS | _text(options)))
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_parquet(spark: SparkSession, path: str, options: Mapping[str, Any] | None = None) -> DataFrame:
    return spark.read.options(**_text(options)).parquet(path)


def write_frame(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = (), options: Mapping[str, Any] | None = None) -> str:
    """Write as parquet, json or csv (with a header)."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"{fmt} is none of parquet, json and csv")
    given = ({"header": "true"} if fmt == "csv" else {}) | _text(options)
    writer = df.write.format(fmt).mode(mode).options(**given)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] | None = None, options: Mapping[str, Any] | None = None) -> tuple[str, str]:
    """Write a table, snappy by default; returns its format and path.

    Rows meet their partition's other rows before the write, so a partition folder gets a few files, not one a
    task. The shuffle is a rebalance: small folders are joined and large ones split at run time.
    """
    partitions = list(partition_by or ())
    if partitions:
        df = df.hint("rebalance", *partitions)
    return "parquet", write_frame(df, path, "parquet", mode, partitions, {"compression": "snappy"} | dict(options or {}))


def write_quarantine(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> str:
    return write_frame(df, path, fmt, mode)


_DATED = re.compile(r"_(\d{4}-\d{2}-\d{2})\.csv$")


def latest_date(base: str, entities: Sequence[str]) -> str | None:
    """The latest date in local file names ``<entity>_<date>.csv``."""
    if is_cloud_path(base) or not Path(base).exists():
        return None
    dates = (m[1] for e in entities for f in Path(base).glob(f"{e}_*.csv") if (m := _DATED.search(f.name)))
    return max(dates, default=None)


def source_path(base: str, entity: str, date: str) -> str:
    """``<entity>_<date>.csv``, else ``<entity>.csv``, else the latest dated local file."""
    for name in (f"{entity}_{date}.csv", f"{entity}.csv"):
        if path_exists(path := join_path(base, name)):
            return path
    if found := sorted(Path(base).glob(f"{entity}_*.csv")):
        return str(found[-1])
    raise FileNotFoundError(f"{base} has no {entity} file, neither of {date} nor of another day")


def region_lookup_path(base: str) -> str:
    path = join_path(base, "region_lookup.csv")
    if not path_exists(path):
        raise FileNotFoundError(f"there are no region codes at {path}")
    return path
