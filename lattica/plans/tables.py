"""Table access and plan shaping shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if the optimizer proves it below this size.
BROADCAST_LIMIT_BYTES = 16 << 20


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Read one Parquet table of a data directory, pruned to `columns` if any are given."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where set; on a local master (tests, one machine) one of this process.

    On a cluster it must be set: a folder of one machine would lose rows there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, folder, True)
        where = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_written: list[str] = []
#: made: what `settled` has seen written.
_inside = threading.local()


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    The lineage ends at files every executor can reach, so a lost executor costs the
    tasks it ran and not the whole plan, and a frame read twice is computed once. `release` deletes the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    if (made := getattr(_inside, "made", None)) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*frames: DataFrame) -> None:
    """Deletes the folders of frames that `cut` returned; what reads them must have been written before."""
    for df in frames:
        if df._folder in _written:
            _written.remove(df._folder)
            _delete(df.sparkSession, df._folder)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, cut, without the folders written on the way to it (in this thread)."""
    outer, own = getattr(_inside, "made", None), []
    _inside.made = own
    try:
        out = cut(make(), name)
    finally:
        _inside.made = outer
        if outer is not None:
            outer.extend(own)
    for path in own[:-1]:
        if path in _written:
            _written.remove(path)
            _delete(out.sparkSession, path)
    return out


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files are deleted when the write that made them ends, not when the driver next collects garbage, and what is cut is packed closer."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release(spark: SparkSession, since: int = 0) -> int:
    """Deletes what `cut` has written in this process, from its `since`-th folder on; frames that read it end with it. Returns the number of folders."""
    gone, _written[since:] = _written[since:], []
    for path in gone:
        _delete(spark, path)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was written inside; results must have been stored by then."""
    since = len(_written)
    try:
        yield
    finally:
        release(spark, since)


def bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a table that must stay small by its nature; raises rather than truncates beyond `max_rows`."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; it cannot be held on the driver")
    return rows


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a frame, for deciding on a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimated size is under the limit; otherwise leave the join to shuffle."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def local_path(uri: str) -> str:
    """A file system path of a file: URI or plain path."""
    return uri[len("file:"):].replace("//", "/", 1) if uri.startswith("file:") else os.fspath(uri)
