"""Where intermediate tables live.

A lost executor must never lose data that a later job needs, so lineage is cut
only with tables in the folder that the cluster names in
``spark.checkpoint.dir``, which driver and executors share. Functions marked
``scoped`` leave only the tables that their result reads.
"""

from __future__ import annotations

import contextlib
import gc

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from popweave.sources.scratch import claim, drop, scoped

__all__ = ["drop_stored", "free_names", "release", "scoped", "scratch_path", "shuffle_parts", "stored"]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return claim(spark, tag)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (a lineage cut)."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later plan reads."""
    drop(*frames)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner delete shuffle files that nothing refers to.

    The scheduler refers to its last job until the next one, and events on their
    way to listeners to finished queries; so a job of one row comes first, and
    events are waited for. Where they take longer, files are deleted later.
    """
    gc.collect()
    spark.range(1).count()
    with contextlib.suppress(Py4JError):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        spark.sparkContext._jvm.System.gc()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
