"""Tables that cut lineage in iterative operators.

They go to the folder that the cluster names in ``spark.checkpoint.dir``, which
the driver and all executors share, so a lost executor loses nothing. A function
marked :func:`scoped` deletes the tables it has made when it returns, but for
those that its result still reads; these, and all others, are deleted when the
application's JVM ends.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a session in one process
    gets a temporary folder; on a cluster that is an error, as no folder of the
    driver's is seen by the executors."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="popweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def claim(spark: SparkSession, tag: str) -> str:
    """A path of its own for a table or a folder of files. What is written there
    goes when the innermost scope or the application ends."""
    folder = f"{shared_root(spark)}/popweave-{uuid.uuid4().hex}"
    path, fs = _hadoop(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    if open_scopes := getattr(_scopes, "stack", None):
        open_scopes[-1].append(folder)
    return f"{folder}/{tag}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` there and read it back."""
    spark = df.sparkSession
    path = claim(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later plan reads."""
    for frame in frames:
        for folder in _folders(frame):
            _remove(frame.sparkSession, folder)


def scoped[**P, R](run: Callable[P, R]) -> Callable[P, R]:
    """Deletes the tables that ``run`` has made, but for those that its result (frames,
    or tuples, lists, dicts and objects that hold them) reads; these pass to the scope around it."""

    @functools.wraps(run)
    def inner(*args: P.args, **kwargs: P.kwargs) -> R:
        stack = _scopes.__dict__.setdefault("stack", [])
        stack.append([])
        try:
            out = run(*args, **kwargs)
        except BaseException:
            stack.pop()  # what a failed run leaves goes when the application ends
            raise
        made = stack.pop()
        frames = list(_frames(out))
        if made and frames:
            read = {folder for frame in frames for folder in _folders(frame)}
            for folder in made:
                if _bare(folder) not in read:
                    _remove(frames[0].sparkSession, folder)
                elif stack:
                    stack[-1].append(folder)
        return out

    return inner


def _frames(out: object) -> Iterator[DataFrame]:
    if isinstance(out, DataFrame):
        yield out
    elif isinstance(out, dict):
        yield from _frames(list(out.values()))
    elif isinstance(out, (tuple, list)):
        for x in out:
            yield from _frames(x)
    elif hasattr(out, "__dict__"):
        for x in vars(out).values():
            if isinstance(x, (DataFrame, dict, tuple, list)):
                yield from _frames(x)


def _folders(frame: DataFrame) -> set[str]:
    """The claimed folders that a frame reads, without scheme."""
    found = set()
    for f in frame.inputFiles():
        before, name, rest = f.rpartition("/popweave-")
        if name and "/" in rest:
            found.add(_bare(f"{before}/popweave-{rest.partition('/')[0]}"))
    return found


def _bare(path: str) -> str:
    """A path without scheme and host."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return "/" + rest.lstrip("/").partition("/")[2] if rest.startswith("//") and not rest.startswith("///") else "/" + rest.lstrip("/")


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, folder: str) -> None:
    path, fs = _hadoop(spark, folder)
    fs.delete(path, True)
    fs.cancelDeleteOnExit(path)
