"""Spark sessions by profile. A session that was there before is never stopped."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

# Settings of each profile.
_SHARED = {"spark.sql.session.timeZone": "UTC", "spark.sql.parquet.compression.codec": "snappy", "spark.sql.adaptive.enabled": "true"}
PROFILES = {"local": _SHARED | {"spark.master": "local[*]", "spark.sql.shuffle.partitions": "4"}, "emr": _SHARED | {"spark.sql.shuffle.partitions": "200"}}


def build_spark_conf(profile: str = "local", app_conf: Mapping[str, Any] | None = None, extra_conf: Mapping[str, Any] | None = None) -> dict[str, str]:
    """The profile's settings, under the application's, under the extra ones."""
    if profile not in PROFILES:
        raise ValueError(f"Unknown Spark profile: {profile}")
    text = lambda conf: {str(k): str(v).lower() if isinstance(v, bool) else str(v) for k, v in (conf or {}).items() if v is not None}
    return PROFILES[profile] | text(app_conf) | text(extra_conf)


def create_spark_session(app_name: str, profile: str = "local", enable_hive_support: bool = True, conf: Mapping[str, Any] | None = None) -> SparkSession:
    before = SparkSession.getActiveSession()
    builder = SparkSession.builder.appName(app_name).config(map=build_spark_conf(profile, extra_conf=conf))
    spark = (builder.enableHiveSupport() if enable_hive_support else builder).getOrCreate()
    if before is None:
        spark._lanewise_owned = True
    return spark


def create_spark_session_from_config(config: Mapping[str, Any], profile: str | None = None, app_name: str | None = None, extra_conf: Mapping[str, Any] | None = None) -> SparkSession:
    own = config.get("spark") or {}
    conf = {**(own.get("conf") or {}), **(extra_conf or {})}
    return create_spark_session(app_name or str(own.get("app_name", "lanewise")), profile or str(own.get("profile", "local")), bool(own.get("enable_hive_support", True)), conf)


def stop_spark_session(spark: SparkSession | None, *, only_if_owned: bool = True) -> None:
    if spark is not None and (not only_if_owned or getattr(spark, "_lanewise_owned", False)):
        spark.stop()
