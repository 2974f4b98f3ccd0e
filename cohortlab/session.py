"""Session helper and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

from pyspark import RDD, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

A, B = TypeVar("A"), TypeVar("B")
_CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "cohortlab") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read, as the cluster names it.

    Only a local master, where driver and executors share one disk, may fall
    back to a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get(_CHECKPOINT_CONF, None) or sc.getConf().get(_CHECKPOINT_CONF)
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_CONF} to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlab-"))
    return sc.getCheckpointDir()


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside, but for those to keep, are deleted at the end.

    For work that has read all of them by then; what it returns may only
    depend on the tables it kept and on its input.
    """
    paths: list[str] = []
    token = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str, by: str | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several jobs read the same shuffled result. The copy is
    columnar, outlives lost executors, and ends the lineage. With ``by`` it
    is partitioned by that column, so a filter on it skips the other files.
    Inside ``scratch`` it is deleted at the end, unless it is to ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    passing = _passing.get()
    if passing is not None and not keep:
        passing.append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def stage_blocks(spark: SparkSession, blocks: RDD, name: str) -> RDD:
    """``stage`` for packed blocks of rows, as files of pickled objects.

    A loop of many short passes reads them without planning a query for each.
    Their name is the path, for ``drop_blocks``.
    """
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    passing = _passing.get()
    if passing is not None:
        passing.append(path)
    blocks.saveAsPickleFile(path, 1)
    return spark.sparkContext.pickleFile(path, 1).setName(path)


def drop_blocks(spark: SparkSession, blocks: RDD) -> None:
    """Delete the files of ``stage_blocks`` inside ``scratch``, once later ones took their place."""
    path, passing = blocks.name(), _passing.get()
    if passing is not None and path in passing:
        passing.remove(path)
        _delete(spark, path)


def side_by_side(spark: SparkSession, work: Callable[[A], B], items: Iterable[A]) -> list[B]:
    """Submit independent jobs together, results in order.

    A fit is a chain of short jobs with waits on the driver in between; with
    a few chains at once the cluster has work during those waits.
    """
    items = list(items)
    with ThreadPoolExecutor(max_workers=max(1, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))
