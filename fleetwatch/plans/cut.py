"""Cut a plan's lineage by writing it to the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session.

    Where it is unset, a local master (tests, the bench) gets a temporary folder of its own;
    on a cluster that would be a folder that executors don't share, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, kind: str = "cut") -> str:
    """A new path under the checkpoint folder; all of a session's paths share one sub-folder, so that it can be removed whole."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/fleetwatch-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


#: Paths made inside each open `dropping`, innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """Removes what is written to new shared paths inside, once its results have been written elsewhere.

    Frames that read those paths can't be used after.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write once and read back: later uses scan columns instead of redoing the plan,
    and the data outlives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Remove what this session wrote under the checkpoint folder; frames made from it can't be read after."""
    _remove(spark, f"{checkpoint_dir(spark).rstrip('/')}/fleetwatch-{spark.sparkContext.applicationId}")
