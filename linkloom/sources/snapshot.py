"""Snapshots: several tables saved together as one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.sources.tables import store, stored

_MARK = T.StructType([T.StructField("parts", T.StringType())])


def latest(spark: SparkSession, path: str) -> int | None:
    """Newest complete version, or None."""
    return stored(spark, f"{path}/complete", _MARK, "version").agg(F.max("version")).first()[0]


def save(spark: SparkSession, path: str, **parts: DataFrame) -> int:
    """Write every part, then the mark that makes the version visible."""
    version = (latest(spark, path) or 0) + 1
    for name, df in parts.items():
        store(df, f"{path}/{name}", version, "version")
    store(spark.createDataFrame([(",".join(sorted(parts)),)], _MARK), f"{path}/complete", version, "version")
    return version


def load(spark: SparkSession, path: str, **schemas: T.StructType) -> dict[str, DataFrame]:
    """Parts of the newest version; empty tables where there is none."""
    version = latest(spark, path) or 0
    return {
        name: stored(spark, f"{path}/{name}", schema, "version").where(F.col("version") == version).drop("version")
        for name, schema in schemas.items()
    }
