"""Where long plans are cut.

Iterative operators need their intermediate result on storage that survives the
loss of an executor, so each cut writes a Parquet table below the folder the
cluster names in ``spark.checkpoint.dir`` and reads it back.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
# Folders of the passages that are open in this thread, the innermost last.
_passages: ContextVar[tuple[str, ...]] = ContextVar("khata_passages", default=())
# Removes the shuffle files of an execution when it ends, instead of when the driver's memory is next cleaned.
SPENT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
# Per session: passages that are open in it, and what its setting was before the first of them.
_open: dict[int, tuple[int, str]] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder every executor can reach"
            )
        _own_folder[app] = tempfile.mkdtemp(prefix="khata-cut-")
    return _own_folder[app]


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once and return a plan that starts at the written table; inside a ``passage`` it is removed at the end of it."""
    return _write(df, label, _passages.get())


def kept(df: DataFrame, label: str = "cut") -> DataFrame:
    """A ``cut`` that outlives the innermost ``passage``."""
    return _write(df, label, _passages.get()[:-1])


def _write(df: DataFrame, label: str, passages: tuple[str, ...]) -> DataFrame:
    spark = df.sparkSession
    folder = passages[-1] if passages else checkpoint_folder(spark)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passage(spark: SparkSession, label: str = "passage") -> Iterator[None]:
    """Work of which only what is ``kept`` is used later: its cuts are removed at the end, its shuffles as soon as they were read.

    Nothing lazy that reads one of its cuts may leave it.
    """
    session = spark._jsparkSession.hashCode()
    folder = f"{(_passages.get() or (checkpoint_folder(spark),))[-1]}/{label}-{uuid.uuid4().hex}"
    token = _passages.set((*_passages.get(), folder))
    with _lock:
        count, before = _open.get(session, (0, spark.conf.get(SPENT, "false")))
        _open[session] = (count + 1, before)
        spark.conf.set(SPENT, "true")
    try:
        yield
    finally:
        _passages.reset(token)
        with _lock:
            count, before = _open.pop(session)
            if count > 1:
                _open[session] = (count - 1, before)
            else:
                spark.conf.set(SPENT, before)
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
