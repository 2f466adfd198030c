"""Tables that cut lineage, kept in the shared folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: Used only by local masters that name no folder, as in tests.
DEFAULT_ROOT = "/tmp/checkpoints"
#: Rows of an Arrow batch at most while a table is written; the session's own limit holds again after it.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
_OPEN: list[Scratch] = []
_BATCHES = threading.Lock()
_held: dict[int, tuple[int, str]] = {}


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, rows go to Python and back in batches that stay small with long texts. Several threads may be in it at
    once: the session's own limit is noted by the first of them and holds again after the last."""
    key = id(spark)
    with _BATCHES:
        inside, own = _held.get(key, (0, spark.conf.get(BATCH_CONF)))
        _held[key] = inside + 1, own
        if not inside:
            spark.conf.set(BATCH_CONF, min(int(own), rows) if int(own) > 0 else rows)
    try:
        yield
    finally:
        with _BATCHES:
            inside, own = _held.pop(key)
            if inside > 1:
                _held[key] = inside - 1, own
            else:
                spark.conf.set(BATCH_CONF, own)


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or DEFAULT_ROOT).rstrip("/")


class Scratch:
    """A folder of Parquet tables for one run of an operator.

    A task that is lost after a table was written reads the table again instead of recomputing its
    ancestors. Tables stay until ``drop``, ``close`` or the end of the program: a result that was returned
    lazily may read them. Whoever has written such a result down can release them with ``released``.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark = spark
        self.root = f"{root or shared_root(spark)}/weftline-{name}-{uuid.uuid4().hex}"
        _OPEN.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def put(self, df: DataFrame, table: str) -> DataFrame:
        """df, written and read again."""
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        self._delete(self.path(table))

    def close(self) -> None:
        self._delete(self.root)
        if self in _OPEN:
            _OPEN.remove(self)

    def _delete(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def released() -> Iterator[None]:
    """Closes, at its end, the scratch folders that were opened within it."""
    before = list(_OPEN)
    try:
        yield
    finally:
        for scratch in [s for s in _OPEN if s not in before]:
            scratch.close()


@atexit.register
def close_all() -> None:
    """What is left at the end of the program goes, as far as its session still answers."""
    for scratch in list(_OPEN):
        with suppress(Exception):
            scratch.close()
