"""Reading input tables and stored versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.session import remove

_FOLD = T.StructType([T.StructField("complete", T.BooleanType())])


#: Session setting: partitions that input tables are dealt out to. For files of
#: few row groups, which no scan can split; unset, as on a cluster, scans stay as they are.
DEAL = "spark.linkloom.deal"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Deal a table out by its key if the session asks for it."""
    partitions = df.sparkSession.conf.get(DEAL, None)
    return df.repartition(int(partitions), key) if partitions else df


def with_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add an expensive column that later filters and projections reuse.

    A plain projection would be merged into each of them and computed anew, or
    pushed below a repartition. A generator is not moved or repeated.
    """
    return df.select("*", F.explode_outer(F.array(column)).alias(name))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_source(pages: DataFrame) -> DataFrame:
    """Fetched pages; where a status is known, only status 200."""
    return pages.where(F.col("status") == 200) if "status" in pages.columns else pages


def stored(spark: SparkSession, path: str, schema: T.StructType, version: str = "batch_id") -> DataFrame:
    """A versioned table, empty when nothing was stored yet."""
    full = T.StructType([*schema.fields, T.StructField(version, T.LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def store(df: DataFrame, path: str, version_id: int, version: str = "batch_id", parts: Sequence[str] = ()) -> None:
    """Write one version of a table, in folders of ``parts`` if given; writing it again replaces it."""
    df.write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/{version}={version_id}")


def newest_fold(spark: SparkSession, path: str, below: int) -> int | None:
    folds = stored(spark, f"{path}_folds", _FOLD, "upto")
    return folds.where(F.col("upto") < below).agg(F.max("upto")).first()[0]


def versions_below(spark: SparkSession, path: str, schema: T.StructType, below: int) -> DataFrame:
    """All rows of versions below ``below``: the newest fold and the versions since."""
    base = newest_fold(spark, path, below)
    rows = stored(spark, path, schema).where(F.col("batch_id") < below)
    if base is None:
        return rows.select(*schema.names)
    folded = stored(spark, f"{path}_folded", schema, "upto").where(F.col("upto") == base)
    since = rows.where(F.col("batch_id") > base)
    return folded.select(*schema.names).unionByName(since.select(*schema.names))


def fold(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    upto: int,
    combine: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    parts: Sequence[str] = (),
) -> None:
    """Rewrite the versions up to ``upto`` as one and remove them, so later reads open few files.

    ``combine`` may add columns named in ``parts``, by whose folders the fold is then stored.

    Only versions of committed batches may be folded: none of them is replayed.
    The mark that makes readers use the fold comes before the removal, and a
    fold that was cut short is done again.
    """
    base = newest_fold(spark, path, upto + 1)
    if base != upto:
        store(combine(versions_below(spark, path, schema, upto + 1)), f"{path}_folded", upto, "upto", parts)
        store(spark.createDataFrame([(True,)], _FOLD), f"{path}_folds", upto, "upto")
    for folder, last in ((path, upto), (f"{path}_folds", upto - 1), (f"{path}_folded", upto - 1)):
        for version, place in _versions(spark, folder):
            if version <= last:
                remove(spark, place)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """``(version, path)`` of the versions of a table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        return []
    paths = [status.getPath() for status in system.listStatus(target)]
    return [(int(p.getName().split("=")[1]), p.toString()) for p in paths if "=" in p.getName()]


def discard_above(spark: SparkSession, path: str, last: int) -> None:
    """Remove the versions above ``last``, such as one that was cut short."""
    for version, place in _versions(spark, path):
        if version > last:
            remove(spark, place)


def discard_below(spark: SparkSession, path: str, first: int) -> None:
    """Remove the versions below ``first``."""
    for version, place in _versions(spark, path):
        if version < first:
            remove(spark, place)


def all_versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a versioned table, folded or not."""
    return versions_below(spark, path, schema, 1 << 62)


def create_if_absent(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Set up an empty versioned table unless one is there."""
    if stored(spark, path, schema).isEmpty():
        store(spark.createDataFrame([], schema), path, -1)


def exclude_stored(candidates: DataFrame, known: DataFrame, key: str | list[str]) -> DataFrame:
    """Candidates whose key is not stored yet.

    The store is first narrowed to the candidates' keys, so a small batch is
    broadcast (by its measured size) and the large store is not shuffled.
    ``candidates`` should be a written table: it is read twice.
    """
    keys = [key] if isinstance(key, str) else key
    hits = known.select(*keys).join(candidates.select(*keys), keys, "left_semi")
    return candidates.join(hits, keys, "left_anti")
