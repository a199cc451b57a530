"""Scratch tables in the cluster's shared folder: written once, read back, deleted when nothing reads them."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[int, str] = {}
#: For file: paths; other stores don't look at it. Hadoop's usual local file system writes a checksum file beside each file
#: and, without its native library, starts a `chmod` process for either and for each task's folder. The raw one spares
#: the checksum file and its process. It is not to be cached, as the cache knows a file system by its scheme alone.
RAW_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: In place of those files the checksums that Parquet keeps with its pages are verified, whatever the store.
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}
#: Tables written while a collector is open, so that whoever opened it can delete them.
_collectors: list[list[DataFrame]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on a local master, as in tests.

    On a cluster every executor would write a temporary folder of its own, so an unset folder is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master}")
    key = id(spark.sparkContext)
    if key not in _local:
        _local[key] = tempfile.mkdtemp(prefix="terraloom-")
        atexit.register(shutil.rmtree, _local[key], ignore_errors=True)
    return f"file://{_local[key]}"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, so that its lineage ends in files every executor sees.

    The files go when the application ends, if nothing deletes them before.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/terraloom-{name}-{uuid.uuid4().hex}"
    df.write.options(**RAW_LOCAL, **{"parquet.page.write-checksum.enabled": "true"}).parquet(path)
    target, system = _path(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).options(**VERIFIED).parquet(path)
    out._terraloom_path = path
    for tables in _collectors:
        tables.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a scratch table that nothing will read again."""
    if path := getattr(df, "_terraloom_path", None):
        target, system = _path(df.sparkSession, path)
        system.delete(target, True)


@contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """The scratch tables written inside the block."""
    tables: list[DataFrame] = []
    _collectors.append(tables)
    try:
        yield tables
    finally:
        _collectors[:] = [x for x in _collectors if x is not tables]


def roots(df: DataFrame) -> str:
    """The folders that df's plan reads, in one text."""
    found, leaves = [], df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found.append(leaf.relation().location().rootPaths().mkString("\n"))
    return "\n".join(found)


def tidied(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The function, deleting the scratch tables it wrote that its result does not read."""

    @functools.wraps(function)
    def run(*args, **kwargs) -> DataFrame:
        with collected() as tables:
            out = function(*args, **kwargs)
        read = roots(out)
        for t in tables:
            if t._terraloom_path.rsplit("/", 1)[-1] not in read:
                discard(t)
        return out

    return run
