"""Result tables that grow batch by batch and can be resumed.

Rows carry the key of their configuration. What is done is read from the table
itself, so a sweep that was interrupted goes on with the rest; the streaming
sink leaves out keys that are already there, so a batch that is replayed after
a failure changes nothing.

Any number of workers may append to one table (`sources/batches.py`): a batch is
published under the number after those whose keys it has left out. Of two workers with
the same number one is told so, leaves out what the other has published, and tries the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from popweave.sources import batches


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all published batches, and of files that were there before there were batches."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def completed(like: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Keys in the result table; none if it doesn't exist yet."""
    spark = like.sparkSession
    try:
        return read_results(spark, path).select(*keys).distinct()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        return spark.createDataFrame([], like.select(*keys).schema)


def pending(configs: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Configurations without results."""
    return configs.join(completed(configs, path, keys), list(keys), "left_anti")


def append_results(results: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Publishes the rows of configurations that have none yet as one batch; its number, 0 for no rows."""
    spark = results.sparkSession
    write = lambda df, folder: df.write.parquet(folder)
    rows, folders = results, []
    try:
        while True:
            # The number first: what is published after it makes this batch's own number taken.
            number = batches.published(spark, path) + 1
            fresh = rows.join(completed(results, path, keys), list(keys), "left_anti").select(*results.columns)
            folders.append(batches.staged(fresh, path, write))
            rows = spark.read.schema(results.schema).parquet(folders[-1])
            if rows.isEmpty():
                return 0
            if batches.publish(spark, folders[-1], path, number):
                folders.pop()
                return number
    finally:
        for folder in folders:
            batches.remove(spark, folder)


def run_in_batches(configs: DataFrame, path: str, keys: Sequence[str], run: Callable[[DataFrame], DataFrame], parts: int = 4) -> int:
    """Runs what is pending in ``parts`` batches, each appended when done; returns the number of batches run."""
    done = 0
    for b in range(parts):
        part = pending(configs.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == b), path, keys)
        if not part.isEmpty():
            append_results(run(part), path, keys)
            done += 1
    return done


def append_stream(results: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """A streaming query that appends new configurations' rows and then ends."""
    sink = lambda batch, _: append_results(batch, path, keys)
    return results.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
