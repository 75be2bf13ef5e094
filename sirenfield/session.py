"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "sirenfield", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a local temporary
    folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/sirenfield"
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Gives ``write(df)``, which writes a table to the shared folder and reads it back; the tables go with the block.

    Unlike a checkpoint they stay columnar, and they survive the loss of executors. ``write(df, keep=True)`` writes what
    the block returns, which stays.
    """
    folder, kept = shared_dir(spark), shared_dir(spark)
    count = 0

    def write(df: DataFrame, keep: bool = False) -> DataFrame:
        nonlocal count
        path = f"{kept if keep else folder}/t{count}"
        count += 1
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield write
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a loop's state; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def bucketed(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """Writes ``df`` in buckets by ``keys`` and reads it back: steps that group or join by them need no exchange.

    There are as many buckets as the session has shuffle partitions, so that :func:`spread` by the same keys falls away
    as well. A second write of the same path would need another name; take a new path.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(n, *keys).write.format("parquet").bucketBy(n, keys[0], *keys[1:]).sortBy(*keys)
    writer.option("path", path).saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions by ``keys`` into the session's full shuffle width.

    For stages that are heavy on CPU but small in bytes: AQE would merge them
    into a few tasks by size, an explicit width it leaves alone. The grouping or
    join that follows on the same keys reuses this shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
