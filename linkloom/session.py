"""Session settings and the shared scratch folder for intermediate tables."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_OPEN: list[list[str]] = []


def local_session(cpus: int | str = 8, app: str = "linkloom", memory: str = "8g") -> SparkSession:
    """Single-JVM session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.linkloom.deal", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    go without: executors of a real cluster cannot see each other's /tmp.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="linkloom-")
    return _LOCAL_ROOTS[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the innermost ``scratch`` ends."""
    path = os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Remove the intermediate tables made inside when it ends.

    Results are lazy: consume them inside, too. Outside of any ``scratch``
    tables stay until the shared folder is cleaned.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, in whatever file system it is; one that is not there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint and survives lost executors, and being
    columnar it lets each reader scan only the columns it needs.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """Write ``df`` to the shared folder in sorted hash buckets of ``key`` and read it back.

    A join on the key with a side of ``buckets`` partitions then leaves this side
    where it is. Only the files last: the catalog entry that buckets need goes.
    """
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, label)).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved while the entry is there
    spark.sql(f"DROP TABLE {name}")
    return table


@contextlib.contextmanager
def bucketed_versions(spark: SparkSession, path: str, key: str, version: str, buckets: int):
    """The name of a table ``(key string, version bigint)`` over ``path``, in hash buckets of ``key`` within each version.

    ``insertInto`` adds a version; readers by the key leave what is stored where it is. Only the files last.
    """
    name = f"versions_{uuid.uuid4().hex}"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({key} STRING, {version} BIGINT) USING parquet PARTITIONED BY ({version}) "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        yield name
    finally:
        spark.sql(f"DROP TABLE {name}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
